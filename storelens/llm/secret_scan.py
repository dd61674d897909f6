"""Secret scan in DataFrame functions only: given patterns, then a battery of randomness tests.

Base spans come from three patterns.  ``split`` gives the text between the matches and ``regexp_extract_all`` the
matches, so running lengths are the positions.

Every other run of 20 or more key characters is a candidate with an inferred encoding (hex, base32, base62, base64),
or, for tokens of one class of characters alone, digits (base10) and letters of one case (base26) from ``ONE_CLASS``
symbols on, where the tests tell a word from a key.  Three tests ask whether its symbols look drawn at random from
that alphabet: chi-squared uniformity, runs above and below the middle of the alphabet, and correlation of neighbours.
Their p-values are combined (Fisher).  A token that is not random is found out by a small p-value; the Benjamini-
Hochberg procedure at rate ``FDR`` decides how small, separately for each encoding and length class, as the tests'
power grows with length.  Candidates that are not rejected are secrets: the rate bounds the keys that are wrongly taken
for patterned tokens, not the patterned tokens that pass.  The procedure needs only counts of p-values
by class, so no p-value list is ever sorted in one place.

Defined cases: null text = empty; null ids keep their rows; equal rows get equal results; an empty table gives no
rows.  Extra columns, whatever their names, are not read.  Very long texts are read whole; positions are added up in
blocks, so time follows the number of matches.  Spans of one start come in the order of their kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import stored

KINDS = ("assign", "access", "hex", "random")
FDR = 0.05
BLOCK = 256  # matches whose positions are added up at a time
ONE_CLASS = 32  # symbols that a token of digits or of letters of one case alone must have
BINS = 100  # classes of -log10 p to a decade
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"

# the given patterns; letters of the first one's key words in either case
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# shorter matches of these two are dropped: a run of the least length gives the same spans and fewer matches
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ALPHABETS = {  # fixed values
    "base10": "0123456789",
    "base26": "abcdefghijklmnopqrstuvwxyz",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, token>> of all matches, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("token")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["token"])
        one = F.struct(start.alias("start"), end.alias("end"), x["token"].alias("token"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    # positions within a block count from its start; appending copies an array, so blocks are short
    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
                         lambda k: F.aggregate(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)), zero, step))
    starts = F.aggregate(
        blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, k: F.struct((acc["at"] + k["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"])
    run = F.flatten(F.zip_with(blocks, starts, lambda k, at: F.transform(k["out"], lambda m: F.struct(
        (m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["token"].alias("token")))))
    return F.when(F.size(found) > 0, run).otherwise(empty)


def spans_of(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"),
                                                 m["end"].alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(rows: DataFrame) -> DataFrame:
    """doc_id, row, the base spans and the candidates of each (doc_id, text, row)."""
    text = F.col("text")
    long_enough = lambda a, n: F.filter(a, lambda m: F.length(m["token"]) >= n)
    with_value = F.zip_with(located(text, ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
                            lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"),
                                                  v.alias("token")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")
    # each pattern's cheap test first; only texts that pass are split
    return rows.select(
        "doc_id", "row",
        F.when(text.rlike(r"(?i:password|passwd|secret|token|api_?key)"), long_enough(with_value, 6)).otherwise(
            none).alias("assign"),
        F.when(text.contains("AKIA"), long_enough(located(text, ACCESS), 20)).otherwise(none).alias("access"),
        F.when(text.rlike("[0-9a-f]{24}"), long_enough(located(text, HEX), 24)).otherwise(none).alias("hex"),
        F.when(text.rlike(r"[A-Za-z0-9+/=_-]{20}"), located(text, CANDIDATE)).otherwise(none).alias("runs"))


# ---------------------------------------------------------------- tests

def upper_normal(z: Column) -> Column:
    """P(Z > z), by the classical rational approximation of the error function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-30))


def tested(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n and p of each candidate ``token``; rows that are no key material are dropped."""
    tok = F.regexp_replace("token", "^[-=_/+]+|[-=_/+]+$", "")
    df = tokens.withColumn("core", tok).where(F.length("core") >= 20)
    has = lambda p: F.col("core").rlike(p)
    only = lambda c: has(f"^{c}{{{ONE_CLASS},}}$")
    encoding = (F.when(only("[0-9]"), "base10").when(only("[a-z]"), "base26").when(only("[A-Z]"), "BASE26")
                .when(has("^[0-9]+$") | has("^[a-z_-]+$") | has("^[A-Z_-]+$") | has("^[A-Z]?[a-z]+$"), None)
                .when(has("^[0-9a-f]+$"), "hex").when(has("^[0-9A-F]+$"), "HEX")
                .when(has("^[A-Z2-7]+$"), "base32").when(has("^[0-9a-z]+$"), "base36")
                .when(has("^[0-9A-Za-z]+$"), "base62").otherwise("base64"))
    df = df.withColumn("encoding", encoding).where("encoding is not null")
    plain = F.when(F.col("encoding").isin("HEX", "BASE26"), F.lower("core")).when(
        F.col("encoding") == "base64", F.translate("core", "-_=", "+/")).otherwise(F.col("core"))
    alphabet = F.when(F.col("encoding") == "HEX", F.lit(ALPHABETS["hex"])).when(
        F.col("encoding") == "BASE26", F.lit(ALPHABETS["base26"]))
    for k, v in ALPHABETS.items():
        alphabet = alphabet.when(F.col("encoding") == k, F.lit(v))
    df = df.withColumn("plain", plain).withColumn("alphabet", alphabet)
    df = df.withColumn("code", F.expr("transform(split(plain, ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    df = df.withColumn("n", F.size("code").cast("double")).withColumn("a", F.length("alphabet").cast("double"))
    squares = F.expr("aggregate(split(alphabet, ''), 0.0D, (s, c) -> s + pow(length(plain) - length(replace(plain, c, "
                     "'')), 2))")
    n, a = F.col("n"), F.col("a")
    df = df.withColumn("chi", squares * a / n - n)
    z1 = (F.col("chi") - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    df = df.withColumn("side", F.expr("transform(code, x -> if(2 * x < a - 1, 0, 1))"))
    df = df.withColumn("n1", F.expr("aggregate(side, 0, (s, x) -> s + x)").cast("double")) \
        .withColumn("runs", F.expr("1 + size(filter(sequence(1, size(side) - 1), i -> side[i] != side[i - 1]))")
                    .cast("double"))
    n1 = F.col("n1")
    n2 = n - n1
    both = 2 * n1 * n2
    var = both * (both - n) / (n * n * (n - 1))
    z2 = F.when(var > 0, (F.col("runs") - 1 - both / n) / F.sqrt(F.when(var > 0, var))).otherwise(F.lit(10.0))
    df = df.withColumn("mean", F.expr("aggregate(code, 0.0D, (s, x) -> s + x) / n")) \
        .withColumn("ss", F.expr("aggregate(code, 0.0D, (s, x) -> s + pow(x - mean, 2))")) \
        .withColumn("lag", F.expr("aggregate(sequence(1, size(code) - 1), 0.0D, (s, i) -> s + (code[i] - mean) * "
                                  "(code[i - 1] - mean))"))
    r = F.col("lag") / F.when(F.col("ss") > 0, F.col("ss"))
    z3 = F.coalesce((r + 1 / n) * F.sqrt(n), F.lit(10.0))
    p1, p2, p3 = upper_normal(z1), F.least(F.lit(1.0), 2 * upper_normal(F.abs(z2))), F.least(
        F.lit(1.0), 2 * upper_normal(F.abs(z3)))
    x = -(F.log(p1) + F.log(p2) + F.log(p3))
    return df.withColumn("p", F.exp(-x) * (1 + x + x * x / 2)).drop("code", "side", "alphabet", "plain")


def not_rejected(tests: DataFrame, fdr: float) -> DataFrame:
    """The tests that Benjamini-Hochberg does not reject, by encoding and length class (powers of sqrt(2))."""
    tests = tests.withColumn("long", F.floor(2 * F.log2("n"))) \
        .withColumn("bin", F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * BINS))
    count = tests.groupBy("encoding", "long", "bin").agg(F.count("*").alias("k"))
    of = Window.partitionBy("encoding", "long")  # at most 30 x BINS rows a class
    cum = count.withColumn("rank", F.sum("k").over(of.orderBy(F.col("bin").desc()))).withColumn(
        "m", F.sum("k").over(of))
    cut = cum.where(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= F.col("rank") * fdr / F.col("m")) \
        .groupBy(F.col("encoding").alias("e"), F.col("long").alias("l")).agg(F.min("bin").alias("cut"))
    return tests.join(cut, (F.col("encoding") == F.col("e")) & (F.col("long") == F.col("l")), "left") \
        .where(F.col("cut").isNull() | (F.col("bin") < F.col("cut")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row"))
    got = stored(scan(rows), "secrets")
    tokens = got.where(F.size("runs") > 0).select("doc_id", "row", F.explode("runs").alias("m")).select(
        "doc_id", "row", "m.start", "m.end", "m.token")
    # a token is tested once, however often it occurs
    secret = not_rejected(tested(tokens.select("token").distinct()), fdr).select(F.col("token").alias("t"))
    secret = tokens.join(secret, F.col("token") == F.col("t")).groupBy(
        F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(
        F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more"))
    base = F.concat(spans_of(F.col("assign"), 0), spans_of(F.col("access"), 1), spans_of(F.col("hex"), 2))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return got.join(secret, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.coalesce("more", none))).alias("spans"),
        F.size(F.coalesce("more", none)).cast("long").alias("n_random"))
