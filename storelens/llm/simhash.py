"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints are computed per document; equal ones are merged first, so copies, however many, are one fingerprint.
For radius r, each of 2**(r+1) - 1 tables keys a fingerprint by its bits under a structured mask: bit i carries a
vector of r+1 bits, and mask v keeps the bits whose vector has odd overlap with v.  The vectors of r differing bits
span at most r dimensions, so some v misses all of them: every pair within the radius has equal keys in some table.

Keys are grouped by one shuffle.  A group's links are checked exactly and leave the group as a spanning forest, so a
group of m fingerprints gives at most m - 1 rows.  Groups beyond ``HOT`` fingerprints are dealt out again by a second
family of masks over the whole fingerprint (any pair within the radius meets there, too); that bounds the groups
compared at a time unless far over ``HOT`` fingerprints agree under two masks, and such groups are compared in blocks.

Components come from label propagation over the forest edges (large-star, small-star), cut at each round by a table in
the shared folder.

Defined cases: null or empty text, or one without words: fingerprint zero, linked like any other; repeated rows are
nodes of their own with equal fingerprints; null ids take part but never name a component unless no other id is
there (then component_id is null); an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import (LOWER, Texts, expand, free_names, i64, runs, small_batches, stored, text_chunks,
                                  words)

SHINGLE, RADIUS, SEED = 3, 3, 42
HOT = 2000
PIECE = 25_000  # shingles whose bits are spread out at a time


# ---------------------------------------------------------------- fingerprints

def fingerprints(t: Texts, shingle: int, seed: int) -> np.ndarray:
    starts, ends, first = words(t)
    n_words = np.diff(first)
    raw = LOWER[t.data].tobytes()
    # joined by one space: where words stand one space apart the shingle is a slice of the text
    count = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    w, doc = expand(first[:-1], count)
    last = np.minimum(w + shingle, first[doc + 1]) - 1
    gaps = np.append(0, np.cumsum(np.append(starts[1:] - ends[:-1], 1) != 1))
    spaces = np.zeros(len(starts), bool)
    if len(starts) > 1:
        spaces[:-1] = t.data[ends[:-1]] != 0x20
    odd = np.append(0, np.cumsum(spaces))
    plain = (gaps[last] == gaps[w]) & (odd[last] == odd[w])
    h = np.empty(len(w), np.uint64)
    digest = xxhash.xxh64_intdigest
    s, e = starts[w], ends[last]
    if plain.all():
        h[:] = [digest(raw[a:b], seed) for a, b in zip(s.tolist(), e.tolist())]
    else:
        h[plain] = [digest(raw[a:b], seed) for a, b in zip(s[plain].tolist(), e[plain].tolist())]
        h[~plain] = [digest(b" ".join(raw[a:b].split()), seed) for a, b in zip(s[~plain].tolist(), e[~plain].tolist())]
    sums = np.zeros((len(t), 64), np.int64)
    for a in range(0, len(h), PIECE):
        bits = np.unpackbits(h[a:a + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = runs(doc[a:a + PIECE])
        np.add.at(sums, doc[a + cut[:-1]], np.add.reduceat(bits, cut[:-1], axis=0, dtype=np.int64))
    on = 2 * sums > count[:, None]
    return np.packbits(on, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint_rows(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, row) of each (doc_id, text, row) row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.rows.start, len(t)), pa.array(i64(fingerprints(t, shingle, seed))),
                     b.column(2).slice(t.rows.start, len(t))], names=["doc_id", "fp", "row"])
    return docs.mapInArrow(run, "doc_id long, fp long, row long")


# ---------------------------------------------------------------- covering masks

def covering_masks(radius: int, family: int = 0, bits: int = 64) -> np.ndarray:
    """2**(radius+1) - 1 masks; two words that differ in at most ``radius`` bits agree under one of them."""
    m = (1 << (radius + 1)) - 1
    rng = np.random.Generator(np.random.PCG64(family + 1))
    vec = rng.permutation(np.arange(bits) % m + 1)  # every non-zero vector equally often
    masks = np.zeros(m, np.uint64)
    for v in range(1, m + 1):
        odd = np.array([bin(int(x) & v).count("1") & 1 for x in vec], bool)
        masks[v - 1] = sum(1 << int(i) for i in np.flatnonzero(odd))
    return masks


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of the links between distinct fingerprints, compared in blocks."""
    n = len(fp)
    label = np.arange(n)
    out_i, out_j = [], []
    for i in range(n):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= radius) + i + 1
        for j in near:
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                out_i.append(i)
                out_j.append(j)
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a long, b long): forest edges between distinct fingerprints (fp), linked as the whole link graph is."""
    first, second = covering_masks(radius, 0), covering_masks(radius, 1)

    def keyed(masks: np.ndarray):
        """Rows (at, outer, key, fp): the table's number, the key under an earlier mask, the key under this one."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, outer, fp = (b.column(k).to_numpy() for k in range(3))
                for k, mask in enumerate(masks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at * len(masks) + k), pa.array(outer), pa.array(fp & mask.astype(np.int64)),
                         pa.array(fp)], names=["at", "outer", "key", "fp"])
        return run

    def within(hot: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            at, outer, key, fp = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(4))
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, key, outer, at))
            at, outer, key, fp = at[order], outer[order], key[order], fp[order]
            cut = runs(at, outer, key)
            size = np.diff(cut)
            # pairs are compared at once for all groups of two; larger groups one by one
            two = cut[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, b = [fp[near]], [fp[near + 1]]
            more_at, more_key, more_fp = [], [], []
            for s, n in zip(cut[:-1][size > 2], size[size > 2]):
                group = fp[s:s + n]
                if hot is not None and n > hot:
                    more_at.append(at[s:s + n])
                    more_key.append(key[s:s + n])
                    more_fp.append(group)
                    continue
                i, j = forest(group, radius)
                a.append(group[i])
                b.append(group[j])
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.empty(
                (0, 2), np.uint64)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(i64(pairs[:, 0].copy())), pa.array(i64(pairs[:, 1].copy())),
                                              pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                                             names=["a", "b", "at", "key"])
            for p, k, f in zip(more_at, more_key, more_fp):
                yield pa.RecordBatch.from_arrays([pa.array(i64(f)), pa.nulls(len(f), pa.int64()), pa.array(p),
                                                  pa.array(k)], names=["a", "b", "at", "key"])
        return run

    none = F.lit(0).cast("long")
    tables = fps.select(none.alias("at"), none.alias("outer"), "fp").mapInArrow(
        keyed(first), "at long, outer long, key long, fp long")
    found = stored(tables.repartition("at", "key").mapInArrow(within(HOT), "a long, b long, at long, key long"),
                   "simhash-links")
    hot = found.where("b is null").select("at", F.col("key").alias("outer"), F.col("a").alias("fp"))
    again = hot.mapInArrow(keyed(second), "at long, outer long, key long, fp long") \
        .repartition("at", "outer", "key").mapInArrow(within(None), "a long, b long, at long, key long")
    return found.where("b is not null").select("a", "b").unionByName(again.select("a", "b")).distinct()


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for nodes with an edge (a, b).

    Large-star and small-star in turn; each round is written to the shared folder, and the edge set is final when a
    round leaves its checksum unchanged.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(),
                 "components")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: greater neighbours join the least neighbour (or the node itself)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # small-star: smaller neighbours and the node itself join the least of them
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("b"), "a")
        now = stored(small.select(F.col("x").alias("a"), "b").unionByName(small.select("a", "b"))
                     .where("a != b").distinct(), "components")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
        mark = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least id that links reach), and
    ``kept``: true for the rows that stand for their component (equal rows share it)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row"))
    rows = stored(fingerprint_rows(rows, shingle, seed), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    fps = stored(rows.groupBy("fp").agg(first.alias("least")), "fingerprint-classes")
    label = components(links(fps.select("fp"), radius))
    named = fps.join(label, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    heads = named.groupBy(F.col("label").alias("of")).agg(F.min("least").alias("head"))
    classes = stored(named.join(heads, F.col("label") == F.col("of")).select(F.col("fp").alias("f"), "head"),
                     "simhash-classes")
    return rows.join(classes, F.col("fp") == F.col("f")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"), "row",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row") == F.col("head.row"))).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each component, the one that names it, with all its columns; of equal rows one stays."""
    got = near_duplicates(docs, id_col, text_col, **kw)
    i, r = free_names(docs, "__id", "__row")
    heads = got.where("kept").select(F.col("doc_id").alias(i), F.col("row").alias(r)).distinct()
    row = F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))
    kept = docs.join(heads, docs[id_col].cast("long").eqNullSafe(F.col(i)) & (row == F.col(r)))
    return kept.dropDuplicates([i, r]).select(*(docs[c] for c in docs.columns))
