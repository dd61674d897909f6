"""Quality rules: perplexity bands of a modified Kneser-Ney n-gram model, one model and one band a language.

The model is over characters (order 4): its tables follow the alphabet rather than the corpus, it needs no word list,
and it tells junk from prose in any language.  Spark counts the 4-grams of all documents by language; lower orders,
discounts and interpolated probabilities are aggregations and joins over the counted table.  The result is stored as
sorted hash arrays in the shared folder and memory-mapped by the scoring tasks.

A document passes if its log perplexity lies between its language's bounds: the median plus and minus ``width`` robust
deviations (1.4826 x median absolute deviation, at least ``floor``), both taken over all documents that the base rules
keep.  The log perplexity of a short text varies more, so the bounds of a text of n words are wider by
sqrt(1 + SHORT / n).

Defined cases: null text = empty (0 words, base_failed); null lang is a language of its own; repeated rows are judged
one by one; a language with one document keeps it; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm import arrays
from storelens.llm.common import (ROLL1, SPACE, Texts, covered, free_names, i64, mix, runs, small_batches, stored,
                                  text_chunks, word_hashes, words)
from storelens.session import fresh_dir

ORDER = 4
WIDTH, FLOOR, SHORT = 5.0, 0.05, 200
MIN_WORDS, REPEAT_SHARE = 50, 50
SHARD_GRAMS = 4_000_000
HELD_GRAMS = 500_000
CHUNK = 1 << 20  # bytes of text at a time; n-grams take about 100 bytes of memory for each

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# ---------------------------------------------------------------- base measures

def measure(t: Texts) -> dict[str, np.ndarray]:
    n = len(t)
    starts, ends, first = words(t)
    n_words = np.diff(first)
    upto = lambda mask: np.append(0, np.cumsum(mask))
    in_word = ~SPACE[t.data] & ((t.data & 0xC0) != 0x80)
    chars, symbols = upto(in_word), upto(SYMBOL[t.data])
    per_doc = lambda c: c[t.offs[1:]] - c[t.offs[:-1]]
    # words in 3-word windows that are found twice or more
    h = word_hashes(t, starts, ends)
    p = ROLL1.prefix(h)
    count = np.maximum(n_words - 2, 0)
    w = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    doc = np.repeat(np.arange(n), count)
    wh = ROLL1.ranges(p, w, w + 3)
    order = np.lexsort((wh, doc))
    cut = runs(doc[order], wh[order])
    often = np.repeat(np.diff(cut) > 1, np.diff(cut))
    twice = w[order[often]]
    hit = upto(covered(len(starts), twice, twice + 3))
    # lines with a word that equal an earlier line
    ends_line = t.data == 10
    inner = t.offs[1:-1]
    cuts = np.unique(np.concatenate([t.offs[:-1], np.flatnonzero(ends_line) + 1]))
    cuts = cuts[cuts < len(t.data)]
    line_end = np.append(cuts[1:], len(t.data))
    line_end = line_end - (ends_line[line_end - 1] if len(line_end) else 0)
    line_doc = np.searchsorted(t.offs, cuts, side="right") - 1
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, cuts)
    lh = ROLL1.ranges(ROLL1.prefix(t.data), cuts[has], line_end[has])
    ld = line_doc[has]
    order = np.lexsort((lh, ld))
    cut = runs(ld[order], lh[order])
    distinct = np.bincount(ld[order][cut[:-1]], minlength=n)
    return {"n_words": n_words, "word_chars": per_doc(chars), "n_symbols": per_doc(symbols),
            "n_dup_lines": np.bincount(ld, minlength=n) - distinct,
            "n_repeat_words": hit[first[1:]] - hit[first[:-1]]}


# ---------------------------------------------------------------- character n-grams

FOLD = np.arange(0x110000, dtype=np.uint32)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32
FOLD[0] = 1
FOLD[0xE000:] = 0xE000 + FOLD[0xE000:] % 0x2000  # 16 bits a symbol; 0 stands before a text's first character


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): for each character its 4-gram, 16 bits a symbol; first[i]:first[i+1] are document i's."""
    s = FOLD[np.frombuffer(t.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)].astype(np.uint64)
    lead = np.append(0, np.cumsum((t.data & 0xC0) != 0x80))
    first = lead[t.offs]
    key = s.copy()
    at = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
    for k in (1, 2, 3):
        prev = np.zeros_like(s)
        prev[k:] = s[:-k]
        prev[at < k] = 0
        key |= prev << np.uint64(16 * k)
    return key, first


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, key, c): the 4-grams of all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (k, c) in held.items():
                for a in range(0, len(k), 100_000):
                    m = len(k[a:a + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(i64(k[a:a + m])),
                                                      pa.array(c[a:a + m])], names=["lang", "key", "c"])
            held.clear()

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for t in text_chunks(b.column(1), CHUNK):
                key, first = grams(t)
                mine = langs[t.rows]
                for lang in set(mine):
                    rows = np.repeat(mine == lang, np.diff(first))
                    k, c = np.unique(key[rows], return_counts=True)
                    if lang in held:
                        k, at = np.unique(np.concatenate([held[lang][0], k]), return_inverse=True)
                        c = np.bincount(at, np.concatenate([held[lang][1], c]), len(k)).astype(np.int64)
                    held[lang] = (k, c)
                if sum(len(k) for k, _ in held.values()) > HELD_GRAMS:
                    yield from out()
        yield from out()

    return docs.mapInArrow(count, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def discounted(name: str) -> Column:
    """The count less its discount."""
    return F.col(name) - F.when(F.col(name) == 1, F.col("d1")).when(F.col(name) == 2, F.col("d2")).otherwise(
        F.col("d3"))


def ratio(a: Column, b: Column, other: float) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(other))


def with_discounts(level: DataFrame) -> DataFrame:
    """Adds d1, d2, d3 of each language from its counts of counts."""
    of = level.groupBy("lang").agg(*(F.sum((F.col("c") == k).cast("double")).alias(f"m{k}") for k in (1, 2, 3, 4)))
    y = ratio(F.col("m1"), F.col("m1") + 2 * F.col("m2"), 0.5)
    within = lambda x, i: F.least(F.greatest(x, F.lit(0.05 * i)), F.lit(i - 0.05))
    d = of.select(F.col("lang").alias("l"),
                  within(1 - 2 * y * ratio(F.col("m2"), F.col("m1"), 0.25), 1).alias("d1"),
                  within(2 - 3 * y * ratio(F.col("m3"), F.col("m2"), 0.33), 2).alias("d2"),
                  within(3 - 4 * y * ratio(F.col("m4"), F.col("m3"), 0.37), 3).alias("d3"))
    return level.join(d, F.col("lang").eqNullSafe(F.col("l"))).drop("l")


def build_model(counts: DataFrame) -> list[tuple[str | None, str, int, int, str]]:
    """Stores the model's arrays; (lang, table, shard, shards, address) of each."""
    spark = counts.sparkSession
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # distinct predecessors of each shorter gram
        levels[k] = stored(levels[k + 1].groupBy("lang", F.col("key").bitwiseAND((1 << 16 * k) - 1).alias("key"))
                           .agg(F.count("*").alias("c")), "grams")
    tables = []
    below = None
    for k in range(1, ORDER + 1):
        level = with_discounts(levels[k]).withColumn("ctx", F.shiftrightunsigned("key", 16))
        ctx = level.groupBy("lang", "ctx").agg(
            F.sum("c").alias("t"),
            (F.sum(F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
             / F.sum("c")).alias("g"))
        key = [F.col("lang").alias("cl"), F.col("ctx").alias("ck"), "t", "g"]
        p = level.join(ctx.select(*key), F.col("lang").eqNullSafe(F.col("cl")) & (F.col("ctx") == F.col("ck")))
        p = p.withColumn("own", discounted("c") / F.col("t"))
        if below is None:
            size = levels[1].groupBy(F.col("lang").alias("vl")).agg((1.0 / (F.count("*") + 1)).alias("low"))
            p = p.join(size, F.col("lang").eqNullSafe(F.col("vl")))
        else:
            low = below.select(F.col("lang").alias("bl"), F.col("key").alias("bk"), F.col("p").alias("low"))
            p = p.join(low, F.col("lang").eqNullSafe(F.col("bl"))
                       & (F.col("key").bitwiseAND((1 << 16 * (k - 1)) - 1) == F.col("bk")))
        below = stored(p.select("lang", "key", (F.col("own") + F.col("g") * F.col("low")).alias("p")), "grams-p")
        tables.append(below.select("lang", F.lit(f"p{k}").alias("kind"), "key", F.col("p").alias("value")))
        tables.append(ctx.select("lang", F.lit(f"g{k}").alias("kind"), F.col("ctx").alias("key"),
                                 F.col("g").alias("value")))
    size = levels[1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("value"))
    tables.append(size.select("lang", F.lit("p0").alias("kind"), F.lit(0).cast("long").alias("key"), "value"))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    rows = stored(rows, "grams-model")
    shards = max(1, -(-rows.count() // SHARD_GRAMS))
    folder = fresh_dir(spark, "quality")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema)
        for group in got.group_by(["lang", "kind", "shard"]).aggregate([("key", "list"), ("value", "list")]).to_pylist():
            key = mix(np.array(group["key_list"], np.int64).view(np.uint64))
            order = np.argsort(key)
            address = arrays.save(folder, {"key": key[order],
                                           "value": np.array(group["value_list"], np.float64)[order]})
            yield pa.RecordBatch.from_arrays(
                [pa.array([group["lang"]], pa.string()), pa.array([group["kind"]], pa.string()),
                 pa.array([group["shard"]], pa.int32()), pa.array([address], pa.string())],
                names=["lang", "kind", "shard", "address"])

    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("shard", pa.int32()), ("key", pa.int64()),
                        ("value", pa.float64())])
    made = rows.select("lang", "kind", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key",
                       "value").repartition("lang", "kind", "shard").mapInArrow(
        write, "lang string, kind string, shard int, address string").collect()  # one row a language, table, shard
    return [(r["lang"], r["kind"], r["shard"], shards, r["address"]) for r in made]


class Model:
    def __init__(self, made: list[tuple[str | None, str, int, int, str]]):
        self.files: dict[tuple[str | None, str], list[str]] = {}
        for lang, kind, _, _, address in made:
            self.files.setdefault((lang, kind), []).append(address)

    def values(self, lang: str | None, kind: str, key: np.ndarray) -> np.ndarray:
        """The stored value of each key, NaN where there is none."""
        out = np.full(len(key), np.nan)
        h = mix(key)
        for address in self.files.get((lang, kind), ()):
            a = arrays.load(address)
            at = arrays.find(a["key"], h)
            out[at >= 0] = a["value"][at[at >= 0]]
        return out

    def log_p(self, lang: str | None, key: np.ndarray) -> np.ndarray:
        """Natural log of p(last symbol | the three before) for distinct 4-grams."""
        p = self.values(lang, "p0", np.zeros(len(key), np.uint64))
        for k in range(1, ORDER + 1):
            part = key & np.uint64((1 << 16 * k) - 1)
            g = self.values(lang, f"g{k}", part >> np.uint64(16))
            stored_p = self.values(lang, f"p{k}", part)
            p = np.where(np.isnan(stored_p), np.where(np.isnan(g), 1.0, g) * p, stored_p)
        return np.log(p)


SCORES = ("doc_id long, lang string, " + ", ".join(f"{m} long" for m in MEASURES)
          + ", base_failed boolean, log_perplexity double, row long")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Measures and log perplexity of each document; ``row`` is passed through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for t in text_chunks(b.column(1), CHUNK):
                got = measure(t)
                key, first = grams(t)
                mine = langs[t.rows]
                lp = np.zeros(len(key))
                for lang in set(mine):
                    rows = np.flatnonzero(np.repeat(mine == lang, np.diff(first)))
                    u, back = np.unique(key[rows], return_inverse=True)
                    lp[rows] = m.log_p(lang, u)[back]
                total = np.append(0, np.cumsum(lp))
                n = np.diff(first)
                per = -(total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
                bad = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > REPEAT_SHARE * got["n_words"])
                cut = slice(t.rows.start, t.rows.stop)
                yield pa.RecordBatch.from_arrays(
                    [b.column(2)[cut.start:cut.stop], b.column(0)[cut.start:cut.stop]]
                    + [pa.array(got[x].astype(np.int64)) for x in MEASURES]
                    + [pa.array(bad), pa.array(np.where(n > 0, per, 0.0)), b.column(3)[cut.start:cut.stop]],
                    names=[c.split()[0] for c in SCORES.split(", ")])

    return docs.mapInArrow(run, SCORES)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
          width: float = WIDTH, floor: float = FLOOR) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, kept, log_perplexity, lower, upper, lang, row."""
    small_batches(docs.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(lang.alias("lang"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row"))
    model = Model(build_model(stored(count_grams(rows.select("lang", "text")), "grams")))
    got = stored(score(rows, model), "scores")
    good = got.where("not base_failed")
    mid = good.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("mid"))
    mid = mid.select(F.col("lang").alias("ml"), "mid")
    wider = F.sqrt(1 + F.lit(float(SHORT)) / F.greatest("n_words", F.lit(1)))
    off = good.join(mid, F.col("lang").eqNullSafe(F.col("ml"))).groupBy("ml", "mid").agg(F.percentile_approx(
        F.abs(F.col("log_perplexity") - F.col("mid")) / wider, 0.5, 10_000).alias("mad"))
    bands = off.select("ml", "mid", F.greatest(F.lit(width * 1.4826) * F.col("mad"), F.lit(floor)).alias("half"))
    judged = got.join(bands, F.col("lang").eqNullSafe(F.col("ml")), "left")
    judged = judged.withColumn("lower", F.col("mid") - F.col("half") * wider) \
        .withColumn("upper", F.col("mid") + F.col("half") * wider).drop("ml", "mid", "half")
    ok = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(False)))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that pass, with all their columns; rows equal in id, text and language share a verdict."""
    i, r, of = free_names(docs, "__id", "__row", "__lang")
    keep = judge(docs, id_col, text_col, **kw).where("kept").select(
        F.col("row").alias(r), F.col("doc_id").alias(i), F.col("lang").alias(of)).distinct()
    same = (F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string")) == F.col(r)) \
        & docs[id_col].cast("long").eqNullSafe(F.col(i))
    lang_col = kw.get("lang_col", "lang")
    if lang_col and lang_col in docs.columns:
        same = same & docs[lang_col].cast("string").eqNullSafe(F.col(of))
    return docs.join(keep, same, "left_semi")
