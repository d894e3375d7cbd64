"""BPE encoding by backtracking, and decoding by an offset table.

A piece of text is encoded left to right. An Aho-Corasick automaton over all tokens gives, in one
pass, the longest token at every position. A token may follow another if the pair is compatible:
if undoing the two tokens' merges, latest first, never shows a merge across their border that
would have come earlier. Where no token fits, the encoder falls back to the token's longest proper
prefix or gives up the position for good, so each position is tried a bounded number of times. The
result is the one the merge list gives. Verdicts on pairs are kept in a table.

Decoding takes each id's offset and length in one byte string of all tokens.

Null and empty texts have no tokens. Texts of any length are read whole; strings of special tokens
become those tokens. Repeated rows get repeated results; an empty table gives an empty result. Only
doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: Unicode's White_Space.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pattern(letters: str, numbers: str) -> str:
    """The pre-tokenizer's pattern of byte-level BPE (a fixed form), with the given insides of character classes."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{_WS}{letters}{numbers}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def _ranges(kind: str) -> str:
    """The characters of plane 0 in a general category, as the inside of a class."""
    codes = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if c + 1 != after]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


class Splitter:
    """Text -> its pieces. Texts of plane 0 alone take a faster form of the same pattern."""

    def __init__(self):
        self.plane_0 = re.compile(pattern(_ranges("L"), _ranges("N"))).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.every = regex.compile(pattern(r"\p{L}", r"\p{N}")).findall

    def __call__(self, text: str) -> list[str]:
        return (self.every if self.beyond(text) else self.plane_0)(text)


#: Encoded pieces that a worker keeps, none longer than so many characters; beyond it, it starts afresh.
KEPT_PIECES, KEPT_LENGTH = 600_000, 64
assert array("I").itemsize == 4 and sys.byteorder == "little"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Encoder(dict):
    """As a dict: piece of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        import ahocorasick

        super().__init__()
        self.letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(self.letters)}
        self.to_letters = {b: c for b, c in enumerate(self.letters)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank[pair] = rank
            self.parts.setdefault(whole, (rank, *pair))
        self.trie = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) > 1:  # single letters need no search
                self.trie.add_word(token, (len(token), i))
        self.single = {token: i for token, i in vocab.items() if len(token) == 1}
        self.trie.make_automaton()
        self.size = most = max(vocab.values()) + 1
        self.length, self.shorter = [0] * most, [-1] * most
        for token, i in vocab.items():
            self.length[i] = len(token)
            self.shorter[i] = next((vocab[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in vocab), -1)
        #: left * size + right -> whether they may stand side by side.
        self.compatible: dict[int, bool] = {}
        self.added = added
        self.split_at = re.compile("|".join(re.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.pieces = Splitter()
        texts = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()} | {i: s.encode() for s, i in added.items()}
        each = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.bytes = np.frombuffer(b"".join(each), np.uint8)
        self.widths = np.array([len(b) for b in each], np.int64)
        self.offsets = np.cumsum(self.widths) - self.widths

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging keeps a border between two tokens that stand side by side.

        Both tokens' merges are undone at the border, the latest first. At each step the two tokens
        at the border must not have a merge that ranks before the one undone last on its side: it
        would have been made while both were there.
        """
        a, b, bound = left, right, len(self.rank)
        while True:
            if self.rank.get((a, b), bound) < bound:
                return False
            of_a, of_b = self.parts.get(a), self.parts.get(b)
            if of_a is None and of_b is None:
                return True
            # A tie in rank is one merge made at two places, from the left: the right one is undone first.
            if of_b is None or (of_a is not None and of_a[0] > of_b[0]):
                bound, a = of_a[0], of_a[2]
            else:
                # A merge across the border with the same rank would come first, being further left.
                bound, b = of_b[0] + 1, of_b[1]

    def encode_letters(self, piece: str) -> list[int]:
        end = len(piece)
        longest = [*map(self.single.__getitem__, piece)]
        for at, (n, token) in self.trie.iter(piece):
            start = at - n + 1
            longest[start] = token  # matches come by their end, so the last one is the longest
        if self.length[longest[0]] == end:
            return [longest[0]]
        length, shorter, known, size = self.length, self.shorter, self.compatible.get, self.size
        dead = bytearray(end + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < end:
            while token >= 0:
                after = at + length[token]
                if not dead[after]:
                    if last < 0:
                        break
                    fits = known(last * size + token)
                    if fits is None:
                        fits = self._remember(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = after, token
                token = longest[at] if at < end else -1
            else:  # nothing leads on from here after the last token: give the position up, and shorten that token
                dead[at] = 1
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
                token = shorter[token]
        return out

    def _remember(self, left: int, right: int) -> bool:
        if len(self.compatible) >= 2_000_000:
            self.compatible.clear()
        fits = self.compatible[left * self.size + right] = self._fits(left, right)
        return fits

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        letters = piece.encode().decode("latin-1").translate(self.to_letters)
        ids = array("I", self.encode_letters(letters)).tobytes()
        if len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.split_at is None or not self.split_at.search(text):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        out, at = [], 0
        for m in self.split_at.finditer(text):
            out += map(self.__getitem__, self.pieces(text[at : m.start()]))
            out.append(array("I", [self.added[m[0]]]).tobytes())
            at = m.end()
        return b"".join(out + [*map(self.__getitem__, self.pieces(text[at:]))])

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; bytes that aren't become U+FFFD."""
        which = np.frombuffer(ids, "<u4")
        widths = self.widths[which]
        ends = np.cumsum(widths)
        if not len(ends):
            return b""
        at = np.repeat(self.offsets[which] - ends + widths, widths)
        at += np.arange(ends[-1])
        raw = self.bytes[at].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Encoder(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


def vocabulary_path() -> str:
    """The default vocabulary, installed on every node; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoded(path: str | None):
    def run(batches):
        bpe = encoder(path or vocabulary_path())
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = bpe.encode(text)
                counts.append(len(tokens) // 4)
                ids.append(hashlib.sha256(tokens).hexdigest())
                texts.append(hashlib.sha256(bpe.decode(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str | None):
    def run(batches):
        bpe = encoder(path or vocabulary_path())
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decoded(path: str | None):
    def run(batches):
        bpe = encoder(path or vocabulary_path())
        for batch in batches:
            texts = [bpe.decode(np.array(i or [], "<u4").tobytes()).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", common.text_or_empty().alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids; staged."""
    return common.mapped(_rows(docs), _ids(path), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>", "ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, text; null ids give an empty text; staged."""
    return common.mapped(encoded.select("doc_id", "ids"), _decoded(path), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string", "decoded")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text they decode to; staged."""
    kind = dict(docs.dtypes)["doc_id"]
    return common.mapped(_rows(docs), _encoded(path), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "token_digests")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return digests(common.table(spark, sf_dir, "documents"))
