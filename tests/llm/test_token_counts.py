import random

import pytest

from skein.llm import token_counts

DOCS = "doc_id bigint, text string, chunk string, row_no int, n int, head string, doc_ids string"


@pytest.fixture(scope="module")
def machine():
    return token_counts.transducer(token_counts.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path())


def texts(names, seed, n):
    r = random.Random(seed)
    letters = [" ", "  ", "\n", "\t", "a", "th", "ing", "é", "漢字", "\U0001f600", "▁", "<s>", "<0x41>", "_", "=", "и", "\x00", "9", "Qu"]
    return ["".join(r.choice(letters if r.random() < 0.5 else names) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_counts_of_the_library(machine, library):
    some = texts(machine.names, 1, 3000) + ["", " ", "  ", "a" * 5000, " " * 999, "漢" * 3000, "ab" * 4000 + " c"]
    assert [machine.count(t) for t in some] == [len(library.encode(t)) for t in some]


def test_few_states_change_nothing(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "MOST_PAIRS", 20)
    monkeypatch.setattr(token_counts, "MOST_WORDS", 10)
    own = token_counts.Transducer(machine.scores)
    some = texts(machine.names, 2, 400)
    assert [own.count(t) for t in some] == [len(library.encode(t)) for t in some]
    assert len(own.states) <= 50


def test_maps_compose_in_any_grouping(machine):
    r = random.Random(3)
    for text in [*texts(machine.names, 4, 400), "a" * 300, "ab" * 200, "1" * 99]:
        if not text:
            continue
        width, fan = r.randint(1, 9), r.randint(2, 5)
        maps = [machine.chunk_map(text[k : k + width], k == 0) for k in range(0, len(text), width)]
        right = machine.compose([maps[0], machine.compose(maps[1:])]) if len(maps) > 1 else maps[0]
        while len(maps) > 1:
            maps = [machine.compose(maps[k : k + fan]) for k in range(0, len(maps), fan)]
        assert maps[0][0] == right[0] == "" and maps[0][1] == right[1] == machine.count(text)


def test_state_survives_writing(machine):
    state, _ = machine.run(machine.start, "▁unbeliev")
    again = machine.read(machine.written(state))
    assert (again.char, again.active) == (state.char, state.active)


def test_odd_rows_and_long_texts(spark, library):
    rows = [(1, None), (2, ""), (3, "one two " * 9000), (4, "a" * 40001), (4, "a" * 40001), (None, "x" * 17000 + " y"), (5, " "), (6, "漢字\U0001f600\n" * 5000), (7, "short")]
    docs = spark.createDataFrame([(*r, "c", 1, 2, "h", "d") for r in rows], DOCS)
    want = sorted([(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows], key=str)
    assert sorted(map(tuple, token_counts.counts(docs).collect()), key=str) == want
    assert sorted(map(tuple, token_counts.counts(docs, chunk=100, fan=3).collect()), key=str) == want
    assert token_counts.counts(docs.limit(0)).count() == 0


def test_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = token_counts.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
