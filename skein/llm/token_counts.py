"""Token counts by a finite-state transducer.

A BPE vocabulary with scores is compiled, as texts need it, to a deterministic transducer over
characters. The tokens of a prefix of a text follow from the last token of each shorter prefix: the
last token of the new prefix is the one token that ends here and may follow the last token of what
stands before it. So a state holds, for each place where a token that reaches up to here could begin,
how far it has come (a node of the trie of tokens), the last token before that place, and how many
tokens the prefix up to there has, relative to now. There are finitely many such states, and entering
one changes the token count by a fixed number, which may be negative, as a longer token takes the
place of several. States are made on first use; beyond a fixed number all are dropped and made anew.

Where two characters stand side by side in no token, the state forgets what was before. This makes
texts divisible: a chunk's map from states to states is its head (what stands before the first such
place), and from there on a count and an end state that no longer depend on the entry. Such maps
compose associatively, by running the second one's head from the first one's end state; a text's
maps are composed in rounds of a tree, each over a bounded number of neighbours, which is the scan.
Chunks of long texts are dealt over the cluster, so that one text isn't one task.

Null and empty texts have no tokens. Texts of any length are read whole. Repeated rows are counted
each by itself; an empty table gives an empty result. Only doc_id and text are read, whatever other
columns are called.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate
from operator import attrgetter, getitem

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: Texts with more characters are cut into chunks of so many.
CHUNK = 16384
#: Maps that one round composes to one.
FAN = 64
#: States, and verdicts on pairs of tokens, that a worker keeps; beyond it, it starts afresh.
MOST_STATES, MOST_PAIRS = 150_000, 1_000_000
#: Words whose counts a worker keeps, none longer than so many characters.
MOST_WORDS, WORD_LENGTH = 1_000_000, 48
#: Tokens above which a document is over the limit of the registered query.
LIMIT = 4096
#: How the vocabulary writes a space.
SPACE = "▁"
#: No token goes on with a space after anything else, and none holds a line's end, so words end there.
_WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+").findall
_GAIN = attrgetter("gain")
NEVER = float("-inf")


class State(dict):
    """As a dict: the next character -> the next state; ``gain`` is what entering it adds to the count."""

    __slots__ = ("machine", "char", "gain", "active")
    __hash__ = object.__hash__

    def __init__(self, machine: Transducer, char: str, gain: int, active: tuple):
        self.machine, self.char, self.gain, self.active = machine, char, gain, active

    def __missing__(self, char: str) -> State:
        to = self.machine.step(self, char)
        self[char] = to
        return to


class Words(dict):
    """As a dict: a word with the spaces before it -> its number of tokens."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = sum(map(_GAIN, accumulate(word, getitem, initial=self.machine.start)))
        if len(word) <= WORD_LENGTH:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = n
        return n


class Transducer:
    """Transducer of a vocabulary: scores gives each token that merges may make; single characters outside it fall back to bytes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.children: list[dict[str, int]] = [{}]
        self.token: list[int] = [-1]
        self.names = sorted(scores)
        for i, name in enumerate(self.names):
            node = 0
            for c in name:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][c]
            self.token[node] = i
        #: Characters that stand side by side in some token.
        self.pairs = {name[k : k + 2] for name in self.names for k in range(len(name) - 1)}
        self.states: dict[tuple, State] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        #: Of each token: the merges that make it of its characters, each as its score and the first and last part after it.
        self.merges: dict[int, list[tuple[float, str, str]]] = {}
        self.start = State(self, "", 0, ((0, -1, 0),))
        self.words = Words(self)

    def _merges(self, token: int) -> list[tuple[float, str, str]]:
        """Merging the token's characters, best score first and from the left; empty where that doesn't give the token."""
        known = self.merges.get(token)
        if known is not None:
            return known
        parts, get, made = list(self.names[token]), self.scores.get, []
        joined = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while joined and (best := max(joined)) > NEVER:
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1], NEVER)
            made.append((best, parts[0], parts[-1]))
        made.append((NEVER, "", ""))
        self.merges[token] = made = made if len(parts) == 1 else []
        return made

    def _follows(self, left: int, right: int) -> bool:
        """Whether a token may stand after another one (-1: nothing that matters stands before).

        Both make their own merges, the best score of the two first, unless the parts at the border
        can be merged with a better one; what stands further left goes first in a tie.
        """
        of_right = self._merges(right)
        if not of_right or left < 0:
            return bool(of_right)
        pair = left, right
        known = self.fits.get(pair)
        if known is not None:
            return known
        of_left, get = self._merges(left), self.scores.get
        x, y, i, j = self.names[left][-1], self.names[right][0], 0, 0
        across = get(x + y, NEVER)
        while True:
            a, b = of_left[i][0], of_right[j][0]
            if across > a and across >= b:
                known = False
                break
            if a >= b:
                if a == NEVER:
                    known = True
                    break
                x = of_left[i][2]
                i += 1
            else:
                y = of_right[j][1]
                j += 1
            across = get(x + y, NEVER)
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        self.fits[pair] = known
        return known

    def step(self, state: State, char: str) -> State:
        active = state.active if state.char + char in self.pairs else self.start.active
        going = [(self.children[node].get(char), last, n) for node, last, n in active]
        going = [g for g in going if g[0] is not None]
        for node, last, n in going:
            token = self.token[node]
            if token >= 0 and self._follows(last, token):
                gain = n + 1
                break
        else:  # no token holds this character: it becomes its bytes
            return self.state(char, len(char.encode("utf-8", "replace")), self.start.active)
        open_ones = tuple((node, last, n - gain) for node, last, n in going if self.children[node])
        return self.state(char, gain, (*open_ones, (0, token, 0)))

    def state(self, char: str, gain: int, active: tuple) -> State:
        key = char, gain, active
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= MOST_STATES:
                for old in self.states.values():
                    old.clear()
                self.states.clear()
                self.start.clear()
            found = self.states[key] = State(self, *key)
        return found

    def count(self, text: str) -> int:
        """Tokens of a whole text, which begins with a space of its own."""
        return sum(map(self.words.__getitem__, _WORD(SPACE + text.replace(" ", SPACE)))) if text else 0

    def run(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for c in text:
            state = state[c]
            n += state.gain
        return state, n

    def written(self, state: State) -> list[int]:
        """The state as numbers, the same in every worker."""
        return [ord(state.char) if state.char else -1, *(x for part in state.active for x in part)]

    def read(self, numbers: list[int]) -> State:
        active = tuple(zip(*(iter(numbers[1:]),) * 3))
        return self.state(chr(numbers[0]) if numbers[0] >= 0 else "", 0, active)

    def chunk_map(self, text: str, first: bool) -> tuple[str, int | None, list[int] | None]:
        """head, and the count and end state of what follows it; both are None if the whole chunk is head."""
        text = text.replace(" ", SPACE)
        if first:
            at, text = 0, SPACE + text
        else:
            at = next((k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.pairs), None)
            if at is None:
                return text, None, None
        *words, last = _WORD(text, at)
        end, n = self.run(self.start, last)
        return text[:at], n + sum(map(self.words.__getitem__, words)), self.written(end)

    def compose(self, maps) -> tuple[str, int | None, list[int] | None]:
        """One map for several neighbouring ones."""
        heads, total, state = [], None, None
        for head, n, end in maps:
            if state is None:
                heads.append(head)
                total = n
            else:
                state, own = self.run(state, head)
                total += own + (n or 0)
            if end is not None:
                state = self.read(end)
        return "".join(heads), total, None if state is None else self.written(state)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """Of a model with merges by score, text as it is but for a space before it, and bytes for unknown characters; others are refused."""
    from sentencepiece import sentencepiece_model_pb2 as model

    spec = model.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    kinds = model.ModelProto.SentencePiece
    normal, trainer = spec.normalizer_spec, spec.trainer_spec
    plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and normal.escape_whitespaces
    if trainer.model_type != model.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not plain:
        raise ValueError(f"{path}: not a byte-fallback BPE model over unchanged text")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
        raise ValueError(f"{path}: user-defined and unused tokens aren't covered")
    scores = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
    if any(c not in scores for token in scores for c in token):
        raise ValueError(f"{path}: a token holds a character that is no token")
    if any(SPACE in token.lstrip(SPACE) or "\n" in token for token in scores):
        raise ValueError(f"{path}: a token goes on with a space after something else, or holds a line's end")
    return Transducer(scores)


def vocabulary_path() -> str:
    """The default vocabulary, installed on every node; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _counted(path: str | None):
    def run(batches):
        machine = transducer(path or vocabulary_path())
        for batch in batches:
            counts = [machine.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


_MAPS = [("head", pa.string()), ("n", pa.int64()), ("end", pa.list_(pa.int32()))]


def _mapped(path: str | None):
    def run(batches):
        machine = transducer(path or vocabulary_path())
        for batch in batches:
            made = [machine.chunk_map(t, k == 0) for t, k in zip(batch.column("text").to_pylist(), batch.column("chunk").to_pylist())]
            yield _with_maps(batch, made)

    return run


def _composed(path: str | None):
    def run(batches):
        machine = transducer(path or vocabulary_path())
        for batch in batches:
            made = [machine.compose((m["head"], m["n"], m["end"]) for m in maps) for maps in batch.column("maps").to_pylist()]
            yield _with_maps(batch, made)

    return run


def _with_maps(batch, made):
    keys = ["row_no", "doc_id", "n_bytes", "chunk"]
    columns = [pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(_MAPS)]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, *(name for name, _ in _MAPS)])


def counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; staged."""
    kind = dict(docs.dtypes)["doc_id"]
    text = common.text_or_empty()
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"), F.monotonically_increasing_id().alias("row_no"))
    long = F.char_length("text") > chunk
    with common.scratch() as keep:
        short = common.mapped(rows.where(~long).drop("row_no"), _counted(path), f"doc_id {kind}, n_bytes bigint, n_tokens bigint", "counts")
        chunks = F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("chunk", "text")
        chunks = rows.where(long).select("row_no", "doc_id", "n_bytes", chunks).repartition("row_no", "chunk")
        schema = f"row_no bigint, doc_id {kind}, n_bytes bigint, chunk int, head string, n bigint, end array<int>"
        maps = common.mapped(chunks, _mapped(path), schema, "chunk_maps")
        last = maps.agg(F.max("chunk")).first()[0] or 0
        while last > 0:
            part = F.sort_array(F.collect_list(F.struct("chunk", "head", "n", "end"))).alias("maps")  # ``fan`` of them at most
            groups = maps.groupBy("row_no", F.floor(F.col("chunk") / fan).cast("int").alias("chunk")).agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), part)
            maps = common.mapped(groups.select("row_no", "doc_id", "n_bytes", "chunk", "maps"), _composed(path), schema, "chunk_maps", batch_rows=64)
            last //= fan
        return keep(short.unionByName(maps.select("doc_id", "n_bytes", F.col("n").alias("n_tokens"))), "token_counts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    out = counts(common.table(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
