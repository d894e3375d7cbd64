"""Fill-in-the-middle: texts cut at unit borders and put together in another order.

A unit is a run of ASCII letters, or any other single character. One scan of a text's bytes through a
table-driven automaton finds them: its states tell whether a byte goes on with a UTF-8 character, goes
on with a run of letters or begins a unit, and how far a sentinel has been recognised. Texts are laid
out in blocks that step through the table side by side; as the last few bytes alone decide the state,
a block begins with those before it. Each block yields its transitions, counted by what they emit:
units begun, sentinels ended. The second pass looks up the block in which a cut lies by these counts,
and scans these blocks alone again for the byte at which the unit begins.

Which document becomes what follows from a hash of its doc_id, so reruns agree. Texts that hold a
sentinel stay plain, so that an output can always be taken apart again; so do empty ones and a fixed
share of the others. Null texts are empty; a null doc_id is written as nothing in the hash. Texts of
any length are read whole; repeated rows get equal results; an empty table gives an empty result. Only
doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents: those from here on stay plain; of the others, those below have the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of a block, and blocks that step side by side.
BLOCK, SIDE = 512, 4096

#: States, each by what its last byte was; those whose name ends in + have just begun a unit.
STATES = ("start", "other", "other+", "letter", "letter+", "open+", "named+", "closed+")
BEGINS = np.array([name.endswith("+") for name in STATES])
CLOSED = STATES.index("closed+")
_MARKS = {ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)}


def _next(state: str, byte: int) -> str:
    """open: a "<" that may begin a sentinel; named: its letter too; closed: its end."""
    if 0x80 <= byte < 0xC0:  # goes on with a character
        return "other"
    if chr(byte).isalpha() and byte < 0x80:
        if state == "open+":
            return "named+" if byte in _MARKS else "letter+"
        return "letter" if state in ("letter", "letter+", "named+") else "letter+"
    if byte == ord("<"):
        return "open+"
    return "closed+" if byte == ord(">") and state == "named+" else "other+"


#: state * 256 + byte -> the next state.
TABLE = np.array([STATES.index(_next(state, byte)) for state in STATES for byte in range(256)], np.uint8)


def _memory() -> int:
    """The number of bytes that decide the state, whatever was before them."""
    kinds = np.unique(TABLE.reshape(len(STATES), 256), axis=1, return_index=True)[1]  # a byte of each column of the table
    n = 1
    while True:
        for word in product(kinds, repeat=n):
            states = np.arange(len(STATES))
            for byte in word:
                states = TABLE[states * 256 + byte].astype(np.int64)
            if len(set(states.tolist())) > 1:
                break
        else:
            return n
        n += 1


WARM = _memory()


class Scan:
    """Texts' bytes with the counts of their transitions, block by block."""

    def __init__(self, texts: list[bytes], block: int = BLOCK):
        self.block = max(block, WARM)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.bytes = np.frombuffer(bytes(WARM) + b"".join(texts) + bytes(self.block), np.uint8)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        blocks = -(-self.sizes // self.block)
        #: Of each text, its first block; of each block, its place in its text and its bytes.
        self.first = np.cumsum(blocks) - blocks
        own = np.repeat(np.arange(len(texts)), blocks)
        self.place = (np.arange(len(own)) - self.first[own]) * self.block
        self.start = self.offsets[own] + self.place
        self.width = np.minimum(self.sizes[own] - self.place, self.block)
        begun, ended = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for at in range(0, len(own), SIDE):
            some = np.arange(at, min(at + SIDE, len(own)))
            visited, there = self._visited(some)
            begun[some] = (BEGINS[visited] & there).sum(axis=0)
            ended[some] = ((visited == CLOSED) & there).sum(axis=0)
        self.units, self.sentinels = (np.bincount(own, x, len(texts)).astype(np.int64) for x in (begun, ended))
        #: Units of all texts that begin before a block, and before a text.
        self.before = np.cumsum(begun) - begun
        self.total = np.cumsum(self.units) - self.units

    def _visited(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """bytes x blocks: the state after each byte, and whether it is in the block."""
        windows = np.lib.stride_tricks.sliding_window_view(self.bytes, WARM + self.block)
        columns = np.ascontiguousarray(windows[self.start[some]].T)
        state, fresh = np.zeros(len(some), np.uint16), self.place[some] == 0
        visited = np.empty((self.block, len(some)), np.uint8)
        for k, column in enumerate(columns):
            state = TABLE[(state << 8) | column].astype(np.uint16)
            if k < WARM:  # nothing stands before a text
                state[fresh] = 0
            else:
                visited[k - WARM] = state
        return visited, np.arange(self.block)[:, None] < self.width[some]

    def starts(self, texts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Of texts, the byte at which a unit (from 0) begins; the end for the one after the last."""
        out = self.sizes[texts].copy()
        for at in range(0, len(texts), SIDE):
            inside = at + np.flatnonzero(units[at : at + SIDE] < self.units[texts[at : at + SIDE]])
            if not len(inside):
                continue
            sought = self.total[texts[inside]] + units[inside]
            # The last block that no more units stand before than are sought: blocks in which none begins come before it.
            blocks = np.searchsorted(self.before, sought, side="right") - 1
            visited, there = self._visited(blocks)
            nth = np.cumsum(BEGINS[visited] & there, axis=0)
            out[inside] = self.place[blocks] + np.argmax(nth == sought - self.before[blocks] + 1, axis=0)
        return out


def numbers(doc_id: object) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(texts: list[str], doc_ids: list, block: int = BLOCK) -> list[tuple[int, str, tuple[bytes, bytes, bytes] | None]]:
    """Of each text n, form, and prefix, middle and suffix in UTF-8 unless the form is plain."""
    data = [t.encode("utf-8", "replace") for t in texts]
    scan = Scan(data, block)
    hashes = np.array([numbers(i) for i in doc_ids], np.int64).reshape(-1, 4)
    cuts = np.sort(hashes[:, :2] % (scan.units + 1)[:, None], axis=1)
    plain = (scan.sizes == 0) | (scan.sentinels > 0) | (hashes[:, 2] % 100 >= PLAIN_FROM)
    some = np.flatnonzero(~plain)
    ends = scan.starts(np.repeat(some, 2), cuts[some].ravel()).reshape(-1, 2)
    out: list = [(int(n), "plain", None) for n in scan.units]
    for i, (first, second) in zip(some.tolist(), ends.tolist()):
        form = "spm" if hashes[i, 3] % 100 < SPM_BELOW else "psm"
        out[i] = out[i][0], form, (data[i][:first], data[i][first:second], data[i][second:])
    return out


def output(text: str, form: str, parts: tuple[bytes, bytes, bytes] | None) -> bytes:
    if parts is None:
        return text.encode("utf-8", "replace")
    prefix, middle, suffix = parts
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def restored(out: bytes, form: str) -> bytes:
    """The text, from the output and its form alone: no part holds a sentinel, so each is found by the first one after it."""
    if form == "plain":
        return out
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    one, two = (p, s) if form == "psm" else (s, p)
    first, _, rest = out[len(one) :].partition(two)
    second, _, middle = rest.partition(m)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def _chars(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def _cut(batches):
    for batch in batches:
        made, texts = [], batch.column("text").to_pylist()
        for text, (n, form, parts) in zip(texts, cut(texts, batch.column("doc_id").to_pylist())):
            out = output(text, form, parts)
            again = hashlib.sha256(restored(out, form)).hexdigest()
            made.append((n, form, *((_chars(parts[0]), _chars(parts[1])) if parts else (None, None)), hashlib.sha256(out).hexdigest(), again))
        yield _batch(batch, made, _DIGESTS)


def _formed(batches):
    for batch in batches:
        made, texts = [], batch.column("text").to_pylist()
        for text, (n, form, parts) in zip(texts, cut(texts, batch.column("doc_id").to_pylist())):
            made.append((n, form, output(text, form, parts).decode("utf-8", "replace")))
        yield _batch(batch, made, _OUTPUTS)


def _rebuilt(batches):
    for batch in batches:
        made = [(restored(o.encode("utf-8", "replace"), f).decode("utf-8", "replace"),) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
        yield _batch(batch, made, _TEXTS)


_DIGESTS = [("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
_OUTPUTS = [("n", "bigint"), ("form", "string"), ("output", "string")]
_TEXTS = [("text", "string")]
_ARROW = {"bigint": pa.int64(), "string": pa.string()}


def _batch(batch, made: list[tuple], fields: list[tuple[str, str]]):
    columns = [pa.array([m[i] for m in made], _ARROW[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(name for name, _ in fields)])


def _mapped(rows: DataFrame, function, fields, name: str) -> DataFrame:
    return common.mapped(rows, function, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(" ".join(f) for f in fields), name)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", common.text_or_empty().alias("text"))


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form and the output of every row; staged."""
    return _mapped(_rows(docs), _formed, _OUTPUTS, "fill_middle")


def restore(outputs: DataFrame) -> DataFrame:
    """doc_id and the text that an output (null: empty) was made of; a null form counts as plain; staged."""
    rows = outputs.select("doc_id", F.coalesce("output", F.lit("")).alias("output"), F.coalesce("form", F.lit("plain")).alias("form"))
    return _mapped(rows, _rebuilt, _TEXTS, "restored")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, sizes of the parts, and digests of the output and of the text rebuilt from it; staged."""
    return _mapped(_rows(docs), _cut, _DIGESTS, "fill_middle_digests")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return digests(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents
), k AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
    coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
