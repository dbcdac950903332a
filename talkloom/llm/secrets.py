"""Secret scans with DataFrame functions only: base patterns, and a battery of randomness tests.

Candidates of the battery are runs of LEAST_LENGTH key characters and more. The encoding inferred from a candidate gives its
alphabet; its characters become positions in it. Three tests ask whether they look uniform and independent: chi-squared
uniformity, runs above and below the middle, and serial correlation. Their squared z values sum to a chi-squared variable
with three degrees of freedom (`p_random`). `p_text` is the chance of a chi-squared value as low as this for text of the
same length, whose characters repeat far more often; it falls with length. Runs of under LONG characters or without a digit are mostly words, so there
`p_text` also takes in how often letters and digits alternate and capitals stand inside, and each value is one test however often it stands; they are
families of their own. Within each family and length class the false-discovery rate over
all candidates of the corpus is held at RATE, from a histogram of `p_text`, so nothing is sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.frames import stored

RATE = 0.01  # false discoveries among the found
LEAST_RANDOM = 1e-4  # candidates that fail the battery at this level are not random
TEXT_REPEAT = 0.066  # chance that two letters of ordinary text are equal
LEAST_LENGTH = 12  # characters of the shortest candidate
LONG = 20  # runs of so many characters with a digit are tested by their repeats alone, once for each place
TEXT_SWITCH = 0.05  # chance that a digit meets a letter, or a capital follows a letter of a text not all in capitals, from one character to the next
BROADCAST_VALUES = 500_000  # found values (about 40 MB) that may be sent to every executor
_DIGIT_SWITCH = "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"
_SWITCH = rf"(?<=[A-Za-z])[A-Z]|{_DIGIT_SWITCH}"
_BINS, _PER_TEN = 400, 10

# The base patterns; letters of the assignment's name in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}"
_ALPHABETS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
_EMPTY = "array<struct<start:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value) in code points.

    The pieces between matches and the matches themselves alternate, so positions are running lengths. `least`: length
    the first group must have; shorter matches count for the positions only.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("value"), group.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["piece"])
        end = begin + F.length(F.coalesce(p["value"], F.lit("")))
        span = F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value"))
        keep = p["value"].isNotNull() & (F.length(p["part"]) >= least) if least else p["value"].isNotNull()
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda s: s["spans"])).otherwise(F.array().cast(_EMPTY))


def _battery(candidates: DataFrame) -> DataFrame:
    """candidates(…, value) with encoding, p_random, p_text."""
    plain = F.regexp_replace("value", "=+$", "")
    url = F.translate(plain, "-_", "+/")
    encoding, symbols = F.lit(_ALPHABETS[-1][0]), F.lit(_ALPHABETS[-1][2])
    for name, pattern, alphabet in reversed(_ALPHABETS[:-1]):
        encoding, symbols = F.when(plain.rlike(pattern), name).otherwise(encoding), F.when(plain.rlike(pattern), alphabet).otherwise(symbols)
    folded = F.when(encoding == "base64", F.translate(plain, "-_", "+/")).otherwise(F.lower(plain))
    rows = stored(candidates.withColumn("plain", plain).withColumn("encoding", encoding).withColumn("symbols", symbols).withColumn("folded", folded).withColumn("switches", F.when(plain.rlike("[a-z]"), F.regexp_count(plain, F.lit(_SWITCH))).otherwise(F.regexp_count(plain, F.lit(_DIGIT_SWITCH)))), "candidates")
    x = F.filter(F.transform(F.split("folded", ""), lambda c: F.instr(F.col("symbols"), c) - 1), lambda i: i >= 0)
    rows = stored(rows.withColumn("x", x).withColumn("a", F.length("symbols").cast("double")).filter(F.size("x") >= 8), "positions")
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda s, v: s + v.cast("double"))
    rows = rows.withColumn("n", F.size("x").cast("double")).withColumn("mean", total("x") / F.size("x"))
    rows = rows.withColumn("high", F.transform("x", lambda i: (i * 2 >= F.col("a")).cast("int"))).withColumn("c", F.transform("x", lambda i: i - F.col("mean")))
    rows = stored(rows, "centred")

    def neighbours(of: str, fn) -> Column:
        return total(F.zip_with(F.slice(of, F.lit(1), F.size(of) - 1), F.slice(of, F.lit(2), F.size(of) - 1), fn))

    squares = total(F.transform(F.array_distinct("x"), lambda s: F.pow(F.size(F.filter("x", lambda v: v == s)).cast("double"), F.lit(2.0))))
    rows = rows.withColumn("chi", F.col("a") / F.col("n") * squares - F.col("n"))
    rows = rows.withColumn("ones", total("high")).withColumn("runs", neighbours("high", lambda p, q: (p != q).cast("int")) + 1)
    rows = rows.withColumn("lagged", neighbours("c", lambda p, q: p * q)).withColumn("own", total(F.transform("c", lambda v: v * v)))
    rows = stored(rows.withColumn("letters", total(F.transform("x", lambda i: (i >= 10).cast("int")))).drop("high", "c", "x"), "sums")
    free = F.col("a") - 1
    spread = 2 / (9 * free)
    rows = rows.withColumn("z_chi", (F.cbrt(F.greatest("chi", F.lit(0.0)) / free) - (1 - spread)) / F.sqrt(spread))
    pairs = 2 * F.col("ones") * (F.col("n") - F.col("ones"))
    mean = pairs / F.col("n") + 1
    var = pairs * (pairs - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    rows = rows.withColumn("z_runs", F.when(var > 0, (F.col("runs") - mean) / F.sqrt(var)).otherwise(F.sqrt("n")))
    rows = rows.withColumn("z_serial", F.when(F.col("own") > 0, F.col("lagged") / F.col("own") * F.sqrt("n") + 1 / F.sqrt("n")).otherwise(F.sqrt("n")))
    rows = rows.withColumn("q", F.pow("z_chi", F.lit(2.0)) + F.pow("z_runs", F.lit(2.0)) + F.pow("z_serial", F.lit(2.0)))
    p_random = 2 * _upper(F.sqrt("q")) + F.sqrt(2 * F.col("q") / math.pi) * F.exp(-F.col("q") / 2)
    expected = free + (F.col("n") - 1) * (F.col("a") * TEXT_REPEAT - 1)
    deviation = F.sqrt(2 * free + 4 * F.col("n") * F.col("a") * TEXT_REPEAT * 0.1)
    low = (expected - F.col("chi")) / deviation
    # Letters a-f alone spell little: in hex the evidence is how often letters stand where a number would have digits.
    chance = F.when(~F.col("plain").rlike("[A-Za-z]"), F.lit(1.0)).when(F.col("encoding") == "hex", F.pow(F.lit(6 / 26), F.col("letters"))).otherwise(_upper(low))
    # In a short text so few equal pairs are not rare: Chernoff's bound of the Poisson tail. Likewise the binomial tail of switches; together by Fisher's method.
    log = lambda c: F.log(F.greatest(c, F.lit(1e-300)))
    equal = F.greatest((F.col("chi") + F.col("n")) * F.col("n") / F.col("a") - F.col("n"), F.lit(0.0)) / 2
    usual = F.col("n") * (F.col("n") - 1) / 2 * TEXT_REPEAT
    few = F.when(F.col("encoding") == "hex", chance).when(equal < usual, F.exp(equal - usual - equal * log(equal / usual))).otherwise(F.lit(1.0))
    few = F.when(F.col("plain").rlike("[A-Za-z]"), few).otherwise(F.lit(1.0))
    share = F.least(F.col("switches") / (F.col("n") - 1), F.lit(1.0))
    apart = share * log(share / TEXT_SWITCH) + (1 - share) * log((1 - share) / (1 - TEXT_SWITCH))
    switched = F.when(share > TEXT_SWITCH, F.exp(-(F.col("n") - 1) * apart)).otherwise(F.lit(1.0))
    both = F.greatest(few * switched, F.lit(1e-39))
    rows = rows.withColumn("p_random", p_random).withColumn("long", (F.length("value") >= LONG) & F.col("value").rlike("[0-9]"))
    return rows.withColumn("p_text", F.greatest(F.when(F.col("long"), chance).otherwise(F.least(both * (1 - F.log(both)), F.lit(1.0))), F.lit(1e-39)))


def _upper(z: Column) -> Column:
    """Upper tail of the normal distribution (a rational approximation, error below 1e-7; by symmetry for z < 0)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _discoveries(tested: DataFrame) -> DataFrame:
    """Step-up false-discovery control by family and length class, over a histogram of -log10 p_text."""
    tested = tested.withColumn("class", F.floor(F.log2("n")).cast("int")).withColumn("bin", F.least(F.floor(-F.log10("p_text") * _PER_TEN), F.lit(_BINS)).cast("int"))
    bins = tested.groupBy("long", "class", "bin").agg(F.sum(F.when(F.col("long"), F.col("places")).otherwise(1)).alias("k"))
    down = Window.partitionBy("long", "class").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("found", F.sum("k").over(down)).withColumn("tests", F.sum("k").over(Window.partitionBy("long", "class")))
    # All of a bin have p at most 10 ** (-bin / _PER_TEN).
    passed = bins.filter(F.pow(F.lit(10.0), -F.col("bin") / _PER_TEN) <= RATE * F.col("found") / F.col("tests"))
    passed = passed.groupBy("long", "class").agg(F.min("bin").alias("from_bin"))
    return tested.join(passed, ["long", "class"]).filter((F.col("bin") >= F.col("from_bin")) & (F.col("p_random") >= LEAST_RANDOM))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, random) of every row of docs(doc_id, text): arrays of (start, end, value).

    Positions are code points, end exclusive. `random` are spans the battery adds, none of which overlaps a base span. Null and empty texts
    have no spans. Rows with one id, or none, are looked at each; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _spans(text, ASSIGN, 12).alias("assign"), _spans(text, ACCESS).alias("access"),
                       _spans(text, HEX).alias("hex"), _spans(text, CANDIDATE).alias("candidates"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "spans")
    base = F.concat("assign", "access", "hex")
    free = F.filter("candidates", lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    # The base spans are tested as well: they are part of the family of tests.
    tried = rows.filter(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.start", "c.end", "c.value")
    values = tried.groupBy("value").agg(F.count("*").alias("places"))
    found = stored(_discoveries(_battery(values)).select("value"), "found")
    few = F.broadcast(found) if found.count() <= BROADCAST_VALUES else found
    added = tried.join(few, "value").groupBy("row").agg(F.collect_list(F.struct("start", "end", "value")).alias("random"))
    rows = rows.withColumn("free", free).join(added, "row", "left")
    rows = rows.withColumn("random", F.coalesce(F.filter("free", lambda c: F.exists("random", lambda r: (r["start"] == c["start"]))), F.array().cast(_EMPTY)))
    return rows.select("doc_id", "assign", "access", "hex", "random")


def digest(rows: DataFrame) -> DataFrame:
    """Counts and digests of secrets()'s rows."""

    def placed(place: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def listed(*kinds: str) -> Column:
        spans = F.sort_array(F.concat(*[placed(i, kind) for i, kind in enumerate(kinds)]))
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                       F.sha2(listed("assign", "access", "hex"), 256).alias("base_sha256"), listed("assign", "access", "hex", "random").alias("spans"))
