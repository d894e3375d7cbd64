"""Secret scans: fixed rules, and character Markov models of random strings and of identifiers.

Everything runs in DataFrame expressions. The fixed rules find assignments, access keys and long
hex runs. The method then looks at every long run of token characters: two first-order Markov
models over 64 character classes, one of random strings and one of ordinary identifiers, give a
log-likelihood ratio, and runs that look random by a margin are secrets too unless they overlap a
fixed span; so are the long parts, between '/', '_' and '-', of runs that don't. The models are
bigram counts of labelled samples: random are strings that the fixed rules find and generated ones,
identifiers are the other words of the sampled documents and made-up names of programs.

Spans are kind:start:end in code points, end exclusive. Null and empty texts have none. Texts of any
length are read whole; what is done with their matches takes little more than linear time. Repeated
rows get equal results; an empty table gives an empty result. Only doc_id and text are read, whatever
other columns are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: The rules' patterns; keywords in either case.
#: The looks ahead and behind change no match: they only let the search pass over other places at once.
ASSIGN = r"""(?=[PpSsTtAa])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_LETTERS = 12
KINDS = ("assign", "access", "hex", "random")

#: A candidate of the method: a run of token characters that is as long as this.
RUN_LENGTH = 16
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{RUN_LENGTH},}}"
#: Also a part of a run between '/', '_' and '-', as words beside a secret would dilute it.
PART = rf"(?<![A-Za-z0-9+])[A-Za-z0-9+]{{{RUN_LENGTH},}}"
#: Log-likelihood ratio in nats a character, and in all, from which a run counts as random.
MARGIN_EACH, MARGIN = 0.5, 12.0
#: Documents (about) whose words train the models, those of the smallest hashes, and generated strings.
TRAIN_DOCS, GENERATED = 1000, 2000
#: Words that names in programs are made of.
CODE_WORDS = (
    "abstract access account action adapter address admin agent array async attribute author base batch bean binary block boolean buffer build button byte cache call case channel char check child class client "
    "code collection column command common component config connection const constant container content context control controller copy core count create current custom data database date default delete "
    "description detail device directory document double element email empty entity entry enum error event exception execute export factory field file filter final find float folder format function get group "
    "handler hash header helper id image impl import index info input instance int integer interface internal is item iterator job json key label language length level library line list listener load local lock log "
    "logger long main manager map mapper master max message method min mode model module name node null number object offset option order output package page param parent parser password path pattern payload point "
    "policy pool port process processor product profile property provider proxy query queue read record reference registry remote remove repository request resource response result return root row rule run scheduler "
    "schema scope search server service session set settings single singleton size source stack start state status stop store stream string style table target task template test text thread time timeout title token "
    "tree type update upload url user util value vector version view void web width window worker wrapper write xml"
).split()
CLASSES = 64
#: Different characters of a random string, at least: rules of dashes and the like aren't secrets.
DIFFERENT = 8


def char_class(code: Column) -> Column:
    """Of an ASCII code: 0-9 digits, 10-35 upper, 36-61 lower case, 62 for '+/', 63 for what is left."""
    return (
        F.when(code.between(48, 57), code - 48)
        .when(code.between(65, 90), code - 55)
        .when(code.between(97, 122), code - 61)
        .when(code.isin(43, 47), F.lit(62))
        .otherwise(F.lit(63))
    )


def bigrams(text: Column) -> Column:
    """first class * 64 + second class of every two neighbouring characters, in time linear in the text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: char_class(F.ascii(c)))
    n = F.size(codes)
    pairs = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: a * CLASSES + b)
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<int>"))


def _random_string(letters: str, n: int) -> Column:
    """A string that follows from the row's id."""
    at = lambda i: (F.pmod(F.xxhash64("id", i, F.lit(letters)), F.lit(len(letters))) + 1).cast("int")
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.lit(letters), at(i), F.lit(1))))


def labelled_samples(docs: DataFrame, rows: int = TRAIN_DOCS, generated: int = GENERATED) -> DataFrame:
    """(value, random): strings to train on.

    Of about ``rows`` documents, what the rules find is random and other words with a letter are
    ordinary. Generated strings add random ones over hex, base 32 and base 64 letters.
    """
    spark = docs.sparkSession
    n = max(1, docs.count())
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no"))
    texts = numbered.where(common.unit_hash() < min(1.0, rows / n)).select(common.text_or_empty().alias("text"))
    found = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LETTERS)
    secrets = texts.select(F.explode(F.concat(found, *(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (ACCESS, HEX)))).alias("value"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_-]+"), F.lit(0))).alias("value"))
    words = words.where(~F.col("value").rlike(f"{HEX}|{ACCESS}") & ~F.col("value").rlike("[0-9].*[A-Za-z].*[0-9]"))
    # Identifiers are also words joined by the usual signs.
    joins = F.explode(F.array(*(F.concat_ws(sign, "value", "value") for sign in "_-/")))
    words = words.unionByName(words.distinct().select(joins.alias("value")))
    # And names in programs, of two and three words, in their usual spellings.
    word = lambda step, k: F.element_at(F.array(*map(F.lit, CODE_WORDS)), (F.pmod(F.col("id") * step + k, F.lit(len(CODE_WORDS))) + 1).cast("int"))
    code = spark.range(len(CODE_WORDS)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12))))
    code = code.select(F.array(word(1, F.lit(0)), word(3, F.col("k")), word(7, F.col("k"))).alias("p"))
    spellings = [F.array_join(F.transform("p", F.initcap), ""), F.array_join("p", "_"), F.array_join("p", "/"), F.upper(F.array_join("p", "_"))]
    words = words.unionByName(code.select(F.explode(F.array(*spellings)).alias("value")))
    made = None
    for letters in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        some = spark.range(generated).select(_random_string(letters, 32).alias("value"))
        made = some if made is None else made.unionByName(some)
    yes, no = F.lit(True).alias("random"), F.lit(False).alias("random")
    # Each different string once: frequent words would drown what the rare ones have to say.
    return secrets.unionByName(made).select("value", yes).unionByName(words.select("value", no)).distinct()


def train(samples: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) for every pair of classes, as first * 64 + second.

    Bigrams are counted on the executors; at most 2 * 64 * 64 counts come to the driver.
    """
    counts = samples.select("random", F.explode(bigrams(F.col("value"))).alias("pair")).groupBy("random", "pair").count()
    tables = {True: [1.0] * CLASSES**2, False: [1.0] * CLASSES**2}
    for random, pair, n in counts.collect():
        tables[random][pair] += n
    out = []
    for a in range(CLASSES):
        rows = [tables[r][a * CLASSES : (a + 1) * CLASSES] for r in (True, False)]
        out += [math.log(x / sum(rows[0])) - math.log(y / sum(rows[1])) for x, y in zip(*rows)]
    return out


# ---------------------------------------------------------------- spans


def running_totals(rows: DataFrame, name: str, values: Column) -> DataFrame:
    """Adds ``name``: the sums of an array's first 1, 2, ... values.

    In two levels, by blocks of about the square root of the length, so that a text with very many
    matches doesn't take time with the square of their number. Each level is a column of its own: an
    expression inside a lambda would be worked out again for each element.
    """
    add = lambda s, x: s + x
    none = F.array().cast("array<int>")
    n = F.size("__values")
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.ceil((n - 1) / width).cast("int")), lambda b: F.slice("__values", b * width + 1, width))
    rows = rows.withColumn("__values", values)
    rows = rows.withColumn("__blocks", F.when(n > 0, cut).otherwise(F.array().cast("array<array<int>>")))
    rows = rows.withColumn("__sums", F.transform("__blocks", lambda b: F.aggregate(b, F.lit(0), add)))
    rows = rows.withColumn("__before", F.transform("__sums", lambda _, k: F.when(k > 0, F.aggregate(F.slice("__sums", 1, k), F.lit(0), add)).otherwise(0)))
    whole = F.zip_with("__blocks", "__before", lambda b, o: F.transform(b, lambda _, i: o + F.aggregate(F.slice(b, 1, i + 1), F.lit(0), add)))
    return rows.withColumn(name, F.when(n > 0, F.flatten(whole)).otherwise(none)).drop("__values", "__blocks", "__sums", "__before")


def clear_of(rows: DataFrame, spans: str, fixed: str) -> DataFrame:
    """Leaves of ``spans`` those that overlap none of ``fixed``; spans must lie one after another, fixed ones need not.

    All ends are put in one order. A span is met by a fixed one if more of them have begun before its
    end than have ended by its start.
    """
    at = lambda pos, order: F.struct(pos.alias("pos"), F.lit(order).alias("order"))
    events = F.array_sort(F.concat(
        F.transform(fixed, lambda f: at(f["end"], 0)), F.transform(spans, lambda s: at(s["start"], 1)),
        F.transform(spans, lambda s: at(s["end"], 2)), F.transform(fixed, lambda f: at(f["start"], 3)),
    ))
    both = (F.size(spans) > 0) & (F.size(fixed) > 0)
    rows = rows.withColumn("__orders", F.when(both, F.transform(events, lambda e: e["order"])).otherwise(F.array().cast("array<int>")))
    rows = running_totals(rows, "__begun", F.transform("__orders", lambda o: F.when(o == 3, 1).otherwise(0)))
    rows = running_totals(rows, "__ended", F.transform("__orders", lambda o: F.when(o == 0, 1).otherwise(0)))
    pick = lambda counts, order: F.filter(F.zip_with("__orders", counts, lambda o, n: F.when(o == order, n)), lambda n: n.isNotNull())
    rows = rows.withColumn("__met", F.zip_with(pick("__begun", 2), pick("__ended", 1), lambda begun, ended: begun > ended))
    free = F.filter(F.zip_with(spans, "__met", lambda s, m: F.when(~m, s)), lambda s: s.isNotNull())
    return rows.withColumn(spans, F.when(F.size("__met") > 0, free).otherwise(F.col(spans))).drop("__orders", "__begun", "__ended", "__met")


def spans(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id and, of every row, an array of spans for each kind: structs of start and end."""
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    empty = F.array().cast("array<string>")
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", RUN), ("part", PART)):
        there = F.col("text").rlike(pattern)
        rows = rows.withColumn(f"{kind}_m", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
        # The piece after the last match has no match behind it.
        before = F.when(there, F.slice(F.split("text", pattern, -1), 1, F.size(f"{kind}_m"))).otherwise(empty)
        rows = rows.withColumn(f"{kind}_b", F.transform(before, lambda x: F.char_length(x)))
    group = F.when(F.size("assign_m") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(empty)
    rows = rows.withColumn("assign_v", F.transform(group, lambda v: F.char_length(v))).drop("text")
    for kind in (*KINDS, "part"):
        rows = running_totals(rows, f"{kind}_e", F.zip_with(f"{kind}_b", f"{kind}_m", lambda b, m: b + F.char_length(m)))
    place = lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("m"))
    for kind in (*KINDS, "part"):
        rows = rows.withColumn(kind, F.zip_with(f"{kind}_e", f"{kind}_m", place))
    long = F.zip_with("assign", "assign_v", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("v")))
    rows = rows.withColumn("assign", F.filter(long, lambda s: s["v"] >= ASSIGN_LETTERS))
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    # The table of ratios is a literal of fixed size, folded once.
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    score = lambda m: F.aggregate(bigrams(m), F.lit(0.0), lambda s, p: s + F.element_at(table, p + 1))
    fixed = F.concat(*(F.transform(k, bare) for k in KINDS[:3]))

    def likely(kind: str) -> Column:
        scored = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.char_length(s["m"]).alias("n"), score(s["m"]).alias("score"), F.size(F.array_distinct(F.split(s["m"], ""))).alias("letters")))
        return F.filter(scored, lambda s: (s["score"] >= MARGIN) & (s["score"] >= MARGIN_EACH * s["n"]) & (s["letters"] >= DIFFERENT))

    rows = rows.withColumn("fixed", fixed).withColumn("random", likely("random")).withColumn("part", likely("part"))
    for kind in ("random", "part"):
        rows = rows.withColumn(kind, F.transform(kind, bare))
    for kind, other in (("random", "fixed"), ("part", "fixed"), ("part", "random")):
        rows = clear_of(rows, kind, other)
    apart = F.array_sort(F.concat("random", "part"))
    return rows.select("doc_id", *(F.transform(k, bare).alias(k) for k in KINDS[:3]), apart.alias("random"))


def _joined(kinds) -> Column:
    """kind:start:end by start, then by kind as listed, comma-joined."""
    def named(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("text")))

    each = [named(i, kind) for i, kind in enumerate(kinds)]
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*each)), lambda s: s["text"]))


def scan(docs: DataFrame) -> DataFrame:
    """Trains the models on docs and returns the spans of every row."""
    return spans(docs, train(labelled_samples(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _joined(KINDS).alias("spans"),
    )
