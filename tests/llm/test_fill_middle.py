import hashlib
import random
import re

import duckdb
import pytest

from skein.llm import fill_middle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, form string, output string, n int"
_UNITS = re.compile("[A-Za-z]+|[^A-Za-z]").findall


def plainly(doc_id, text):
    """What the contract says, unit by unit."""
    text = text or ""
    units, digest = _UNITS(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def expected(rows):
    out = []
    for doc_id, text in rows:
        n, form, prefix, middle, whole = plainly(doc_id, text)
        out.append((doc_id, n, form, prefix, middle, hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def some_texts(n, seed=1):
    r = random.Random(seed)
    parts = ["<", "P", "S", ">", "<P", "M>", "<M>", "a", "word", " ", "\n", "\r\n", "é", "漢", "\U0001f600", "7", "\x00", "<<P", "x" * 50, " " * 9]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 4, 7, 64, 512])
def test_cuts_against_the_units(block):
    texts = some_texts(1500) + ["", "x" * 5000, "漢" * 700, "<P", "<P>", "a<P>b", "<<S>", "<M" + ">" * 3]
    for i, (text, (n, form, parts)) in enumerate(zip(texts, fill_middle.cut(texts, list(range(len(texts))), block))):
        out = fill_middle.output(text, form, parts)
        sizes = (len(parts[0].decode()), len(parts[1].decode())) if parts else (None, None)
        assert (n, form, *sizes, out.decode()) == plainly(i, text)
        assert fill_middle.restored(out, form).decode() == text


def test_last_bytes_decide_the_state():
    assert fill_middle.WARM == 3
    assert fill_middle.cut([], []) == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two " * 60000), (4, "same"), (4, "same"), (None, "no id"), (None, None), (5, "has <M> inside"), (6, "x" * 100000), (7, "\U0001f600漢")]
    docs = spark.createDataFrame([(*r, "psm", "clash", 3) for r in rows], DOCS)
    assert sorted(map(tuple, fill_middle.digests(docs).collect()), key=str) == expected(rows)
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_outputs_and_their_texts(spark):
    rows = [*enumerate(some_texts(300, 5)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = fill_middle.transform(docs)
    assert sorted((r.doc_id, r.n, r.form, r.output) for r in made.where("doc_id IS NOT NULL").collect()) == sorted((i, *(plainly(i, t)[k] for k in (0, 1, 4))) for i, t in rows if i is not None)
    assert sorted(map(tuple, fill_middle.restore(made).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    empty = spark.createDataFrame([(1, None, None)], "doc_id bigint, form string, output string")
    assert [tuple(r) for r in fill_middle.restore(empty).collect()] == [(1, "")]


def test_query_against_sql_and_plain_version(spark):
    got = sorted(map(tuple, fill_middle.query(spark, SF).collect()), key=str)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == expected(map(tuple, docs))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(db.execute(fill_middle.SQL).fetchall(), key=str)
