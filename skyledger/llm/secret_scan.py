"""Secret scans in SQL functions only: known shapes, and strings that look random to two Markov models.

Both models are character bigrams, one of random strings and one of ordinary identifiers and words, fitted
on labelled samples. A candidate is a secret when the log-likelihood ratio of its transitions, summed and
per transition, exceeds two limits. Candidates are all runs of ``LEAST`` or more ASCII letters, digits and
``+/_=-``, letters alone and digits alone among them, but for whole UUIDs, dates and times, which name things;
shorter strings are found by their shape only.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import bounded_sample, unused_name

#: The shapes that count as secrets by themselves.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: The strings that the models judge.
LEAST = 12
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Whole candidates that name things and are no secrets by themselves: UUIDs, dates and times. What is assigned to a name of a secret is found by its shape all the same.
ORDINARY = r"^(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9]{2,6}(?:Z|[+-][0-9]{2,4})?)$"
#: Characters that the models tell apart; all others share one more class.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
KINDS = ("assign", "access", "hex", "markov")
#: Matches whose offsets are summed in one fold.
FOLD = 256
#: The bound of the corpus sample: documents, characters of one, and in how many of them a word has to stand.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TIMES = 2000, 30_000, 3
_WORDS = (
    "user name get set value index count list item file path read write load save open close start stop page view data time date "
    "zone code type text line word node tree edge graph table row column key map hash block cache queue stack state event handler "
    "request response client server session config option default field model train test batch version release update create delete"
).split()
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets of random strings: hexadecimal, base 32, 36, 62, 64 and its form for urls, letters alone.
RANDOM = ("0123456789abcdef", "0123456789ABCDEF", _UPPER + "234567", _LOWER + _DIGIT, _UPPER + _DIGIT, _UPPER + _LOWER + _DIGIT, _UPPER + _LOWER + _DIGIT + "+/", _UPPER + _LOWER + _DIGIT + "_-", _LOWER, _UPPER, _UPPER + _LOWER)


def _number(n: int, *salt: Column | str) -> Column:
    """A number below ``n`` by hash of the row and a salt."""
    return F.pmod(F.xxhash64(F.col("id"), *(F.lit(s) if isinstance(s, str) else s for s in salt)), F.lit(n)).cast("int")


def random_samples(spark: SparkSession, rows: int = 4400) -> DataFrame:
    """(text, label 1): strings of 12 to 43 characters, each of one of the alphabets ``RANDOM``."""
    alphabet = F.element_at(F.array(*map(F.lit, RANDOM)), (F.col("id") % len(RANDOM) + 1).cast("int"))
    letter = lambda i: F.substring("alphabet", F.pmod(F.xxhash64("id", i, F.lit("letter")), F.length("alphabet").cast("long")).cast("int") + 1, F.lit(1))
    text = F.array_join(F.transform(F.sequence(F.lit(1), 12 + _number(32, "size")), letter), "")
    return spark.range(rows).withColumn("alphabet", alphabet).select(text.alias("text"), F.lit(1).alias("label"))


def identifier_samples(spark: SparkSession, rows: int = 4400) -> DataFrame:
    """(text, label 0): identifiers of several words in several cases, with numbers or dates behind them, paths, numbers and rules of one sign."""
    words = F.array(*map(F.lit, _WORDS))
    pick = lambda salt: F.element_at(words, _number(len(_WORDS), salt) + 1)
    parts = [pick(s) for s in ("p", "q", "r", "s")]
    tail = F.when(_number(3, "t") == 0, F.concat(F.lit("_"), _number(100, "n").cast("string"))).when(_number(3, "t") == 1, F.concat(F.lit("-20"), (10 + _number(20, "y")).cast("string"), F.lit("-0"), (1 + _number(9, "m")).cast("string"))).otherwise(F.lit(""))
    camel = F.concat(parts[0], *(F.initcap(p) for p in parts[1:]))
    digits = F.substring(F.concat(*(_number(10**9, s).cast("string") for s in ("a", "b", "c"))), 1, 12)
    number = F.concat(digits, F.lpad(_number(10**6, "d").cast("string"), 6, "0"))
    rule = F.repeat(F.element_at(F.array(*map(F.lit, "-=_+/")), _number(5, "rule") + 1), 20)
    kinds = [F.concat_ws("_", *parts), F.concat_ws("-", *parts), camel, F.concat(*map(F.initcap, parts)), F.upper(F.concat_ws("_", *parts)), F.concat(F.lit("/"), F.concat_ws("/", *parts)), F.concat(*parts)]
    name = F.concat(F.element_at(F.array(*kinds), _number(len(kinds), "kind") + 1), tail)
    text = F.when(_number(10, "class") == 0, number).when(_number(10, "class") == 1, rule).otherwise(name)
    return spark.range(rows).select(text.alias("text"), F.lit(0).alias("label"))


def word_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, label 0): words of four or more ASCII letters that stand in at least ``SAMPLE_TIMES`` different texts of
    a bounded sample of the corpus, so that a string that stands in one text and its copies does not count as
    ordinary; each as it stands and in capitals."""
    texts = docs.select(F.xxhash64(text_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    some = bounded_sample(texts, texts, SAMPLE_DOCS).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}(?![A-Za-z0-9+/_=-])"), F.lit(0)))).alias("word"))
    common = some.groupBy("word").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= SAMPLE_TIMES)
    return common.select(F.explode(F.array_distinct(F.array("word", F.upper("word")))).alias("text"), F.lit(0).alias("label"))


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """(text, label): random strings (1), identifiers by rule and, if ``docs`` is given, its common words (0)."""
    made = random_samples(spark).union(identifier_samples(spark))
    return made if docs is None else made.union(word_samples(docs, text_col))


def _class(c: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at > 0, at - 1).otherwise(CLASSES - 1)


def fit_markov(samples: DataFrame) -> list[float]:
    """Log ratio of transition probabilities, random over ordinary, for each pair of character classes.

    Counts come from all samples; one row for each pair and label reaches the driver. Null texts and
    texts of one character count nothing; without samples all ratios are 0.
    """
    pairs = samples.filter(F.length("text") > 1).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, F.lit(2)))).alias("two"))
    pairs = pairs.select("label", (_class(F.substring("two", 1, 1)) * CLASSES + _class(F.substring("two", 2, 1))).alias("pair"))
    count = {(r.label, r.pair): r.n for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    total = {(label, a): sum(count.get((label, a * CLASSES + b), 0) for b in range(CLASSES)) for label in (0, 1) for a in range(CLASSES)}
    chance = lambda label, pair: (count.get((label, pair), 0) + 0.5) / (total[label, pair // CLASSES] + 0.5 * CLASSES)
    return [round(math.log(chance(1, p) / chance(0, p)), 4) for p in range(CLASSES * CLASSES)]


def _found(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Array of (start, end, kind, size of ``group``, match), from the pieces of text between the matches.

    Offsets are summed within slices of ``FOLD`` matches and over the slices, so that the work grows with the
    number of matches and not with its square.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), F.arrays_zip(whole.alias("m"), value.alias("v")), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit["m"]).alias("n"), F.length(hit["v"]).alias("v"), hit["m"].alias("hit")))
    row = "struct<start:int,end:int,kind:int,v:int,hit:string>"
    none = F.from_json(F.lit("[]"), f"array<{row}>")
    one = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("v"), x["hit"].alias("hit")).cast(row)
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(one(acc["at"], x))).alias("out"))
    sliced = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda j: F.aggregate(F.slice(all_, j * FOLD + 1, F.lit(FOLD)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    slices = F.flatten(F.transform(F.array(pieces), sliced))  # through an array of one, so that the pieces are made once
    moved = lambda out, by: F.transform(out, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["kind"].alias("kind"), x["v"].alias("v"), x["hit"].alias("hit")).cast(row))
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), f"array<array<{row}>>").alias("out"))
    every = F.flatten(F.aggregate(slices, start, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved(x["out"], acc["at"]))).alias("out")))["out"])
    return F.when(text.rlike(pattern), every).otherwise(none)


def log_ratio(table: Column, s: Column) -> Column:
    """The summed log ratio of the transitions of a string of two or more characters."""
    code = lambda i: _class(F.substring(s, i, F.lit(1)))
    start = F.struct(code(F.lit(1)).alias("from"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.transform(F.array(code(i)), lambda c: F.struct(c.alias("from"), (acc["sum"] + F.element_at(table, (acc["from"] * CLASSES + c + 1).cast("int"))).alias("sum")))[0]
    return F.aggregate(F.sequence(F.lit(2), F.length(s)), start, step)["sum"]


def scan_secrets(docs: DataFrame, model: list[float] | None = None, text_col: str = "text", least_sum: float = 10.0, least_mean: float = 0.5, base_col: str = "__base", spans_col: str = "__spans") -> DataFrame:
    """``docs`` with two more columns, arrays of (start, end, kind), ``kind`` a number in ``KINDS``.

    ``base_col`` holds assign, access and hex matches, ``spans_col`` those and the strings that the models call
    random, unless these lie within a base match. Null and empty texts have none. Repeated rows are each
    answered; an empty table gives no rows; a text may be of any length. Columns of the new names must not
    exist yet. ``model`` comes from ``fit_markov``; by default it is fitted with words of ``docs``.
    """
    if taken := {base_col, spans_col} & set(docs.columns):
        raise ValueError(f"columns exist already: {', '.join(sorted(taken))}")
    model = fit_markov(labelled_samples(docs.sparkSession, docs, text_col)) if model is None else model
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trim = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    base = F.concat(F.filter(_found(text, ASSIGN, 1, 0), lambda x: x["v"] >= 8), _found(text, ACCESS, 0, 1), _found(text, HEX, 0, 2))
    rows = docs.withColumn(base_col, F.array_sort(trim(base)))
    random = lambda x: log_ratio(table, x["hit"]) >= F.greatest(F.lit(least_sum), least_mean * (F.length(x["hit"]) - 1))
    beyond = lambda x: ~F.exists(base_col, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    more = F.filter(_found(text, CANDIDATE, 0, 3), lambda x: beyond(x) & ~x["hit"].rlike(ORDINARY) & random(x))
    return rows.withColumn(spans_col, F.array_sort(F.concat(base_col, trim(more))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``; nulls and the like as in ``scan_secrets``."""
    found = scan_secrets(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), model)
    n = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, model: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by a mark; all rows stay, null texts stay null, columns of any name too."""
    base, spans = (unused_name(docs, c) for c in ("__base", "__spans"))
    found = scan_secrets(docs, model, text_col, base_col=base, spans_col=spans)
    return found.withColumn(text_col, redacted(F.col(spans), F.col(text_col))).select(*docs.columns)


def redacted(spans: Column, text: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``. Null stays null."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.concat(acc["out"], F.when(x["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
