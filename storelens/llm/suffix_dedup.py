"""Suffix-array dedup of 100-byte strings over sampled suffixes.

A byte is removed if a 100-byte string over it also starts earlier (smaller id, or the same document, further left).
A full suffix array holds one entry a byte; here a suffix enters only where it begins with the smallest-hashed 24-byte
gram of some 100-byte window.  That choice depends on the window's bytes alone, so equal windows pick equally placed
suffixes, and every window belongs to exactly one suffix: about 1 in 39 bytes starts one.

1. Splitters are quantiles of the suffixes' leading 8 bytes over a sample of documents (they only balance the
   buckets).  Suffixes are range-partitioned by them.  Leading bytes that fill several buckets are spread over those by
   the hash of their surroundings, and their runs are then taken to cross bucket boundaries.
2. Each bucket sorts its suffixes by multikey quicksort over their leading words and compares neighbours.  A suffix
   that shares its gram with none is dropped; in a run whose surroundings are equal throughout, all but the first
   occurrence are repeats.  What is left, and every run that may cross a boundary, is extended.
3. Extension: these suffixes go out once more with the bytes around them, all windows over a gram meet in one task,
   and equal windows (128-bit hashes) but the first are repeats.  A gram with over ``HEAVY`` suffixes, or one whose
   run may cross a boundary, is dealt out by where its windows start as well, ``BLOCK`` starts to a task, each with
   only the bytes it needs.
4. Removed windows are gathered by document, joined to the texts, and applied.

Within a chunk of documents, suffixes with equal gram and surroundings are settled before the shuffle, so a large
group of copies reaches it as one row a chunk.

Defined cases: null text = empty; rows that repeat a document (equal id and text) are one document, each row keeps the
same bytes; of different texts under one id, the one with the smaller row hash counts as earlier; rows with null ids
neither lose bytes nor take them from others; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import ROLL1, ROLL2, Texts, covered, expand, i64, mix, release, runs, small_batches, stored, text_chunks

LENGTH, GRAM = 100, 24
SAMPLE = 16          # one document in 16 gives splitters
PIECE = 5_000        # suffixes extended at a time
CHUNK = 1 << 19      # bytes of text at a time; hashing takes about 100 bytes of memory for each
BUCKETS = 4          # buckets for each shuffle partition, as sorting takes about 200 bytes a suffix
HEAVY, BLOCK = 4_000, 4
SIGN = np.uint64(1 << 63)

SUFFIX = "bucket int, w0 long, w1 long, w2 long, reach long, doc_id long, row long, place long"


def eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number (zeros beyond the end)."""
    out = np.zeros(len(data) + 8, np.uint64)
    wide = data.astype(np.uint64)
    for k in range(8):
        n = max(0, len(data) - k)
        out[:n] |= wide[k:] << np.uint64(56 - 8 * k)
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours (van Herk): one running minimum from either side of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    pad = -len(x) % w
    b = np.append(x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


class Suffixes:
    """Sampled suffixes of a chunk: byte position, first and last window start, document ordinal, gram and reach."""

    def __init__(self, t: Texts, length: int):
        w = length - GRAM + 1
        n = len(t.data)
        none = np.empty(0, np.int64)
        self.at = self.lo = self.hi = self.doc = none
        self.p1 = ROLL1.prefix(t.data)
        if n < length:
            return
        start = np.arange(n - GRAM + 1)
        gram = ROLL1.ranges(self.p1, start, start + GRAM)
        key = (gram & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
        least = (sliding_min(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = np.diff(t.offs)
        ok = np.zeros(n + 1, np.int64)  # windows that lie in one document
        full = size >= length
        np.add.at(ok, t.offs[:-1][full], 1)
        np.add.at(ok, t.offs[1:][full] - length + 1, -1)
        s = np.flatnonzero(np.cumsum(ok)[:len(least)] > 0)
        if len(s) == 0:
            return
        m = least[s]
        doc = np.searchsorted(t.offs, s, side="right") - 1
        cut = runs(m, doc)
        self.at, self.lo, self.hi, self.doc = m[cut[:-1]], s[cut[:-1]], s[cut[1:] - 1], doc[cut[:-1]]

    def reach(self, length: int) -> np.ndarray:
        """Hash of all bytes that windows of the suffix can hold, and of where it lies among them."""
        left = (self.at - self.lo).astype(np.uint64)
        return mix(ROLL1.ranges(self.p1, self.lo, self.hi + length) + left * np.uint64(0x9E3779B97F4A7C15))


def place_of(pos: np.ndarray, dl: np.ndarray, dr: np.ndarray) -> np.ndarray:
    """Position, and the distances back to the first and last window start, in one number."""
    return pos << 20 | dl << 10 | dr


def unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos = place >> 20
    return pos, pos - (place >> 10 & 1023), pos - (place & 1023)


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by their words: sort by one word, then sort only what ties by the next."""
    order = np.argsort(words[0], kind="stable")
    cut = runs(words[0][order])
    for word in words[1:]:
        size = np.diff(cut)
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        group = np.repeat(np.arange(len(size)), size)[tied]
        at = order[tied]
        order[tied] = at[np.lexsort((word[at], group))]
        group = np.repeat(np.arange(len(size)), size)
        cut = runs(group, word[order])
    return order


def first_of(keys: list[np.ndarray], doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows have an equal row (all keys) that lies earlier; the same place read twice is not earlier."""
    order = np.lexsort((pos, row, doc, *keys[::-1]))
    cut = runs(*(k[order] for k in keys))
    head = np.repeat(order[cut[:-1]], np.diff(cut))
    out = np.zeros(len(doc), bool)
    out[order] = (doc[order] != doc[head]) | (row[order] != row[head]) | (pos[order] != pos[head])
    return out


def splitters(texts: DataFrame, n: int, length: int) -> np.ndarray:
    """Quantiles of the leading 8 bytes over a sample of documents; sorted, with repeats for frequent ones."""
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_chunks(b.column(1), CHUNK):
                s = Suffixes(t, length)
                yield pa.RecordBatch.from_arrays([pa.array(i64(eight(t.data)[s.at] ^ SIGN))], names=["w0"])
    sample = texts.where(F.pmod("row", F.lit(SAMPLE)) == 0).mapInArrow(lead, "w0 long")
    if n < 2:
        return np.empty(0, np.int64)
    got = sample.agg(F.percentile_approx("w0", [k / n for k in range(1, n)], 20 * n).alias("cut")).first()["cut"]
    return np.array(got or [], np.int64)


def bucket_of(w0: np.ndarray, reach: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    lo, hi = np.searchsorted(cuts, w0, "left"), np.searchsorted(cuts, w0, "right")
    return (lo + (mix(reach) % (hi - lo + 1).astype(np.uint64)).astype(np.int64)).astype(np.int32)


def suffix_rows(texts: DataFrame, cuts: np.ndarray, length: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_numpy(), b.column(2).to_numpy()
            for t in text_chunks(b.column(1), CHUNK):
                s = Suffixes(t, length)
                if len(s.at) == 0:
                    continue
                w8 = eight(t.data)
                w = [w8[s.at], w8[s.at + 8], w8[s.at + 16]]
                reach = s.reach(length)
                base = t.offs[s.doc]
                doc, row = ids[t.rows][s.doc], rows[t.rows][s.doc]
                pos, dl, dr = s.at - base, s.at - s.lo, s.at - s.hi
                again = first_of([reach, w[0]], doc, row, pos)
                bucket = bucket_of(i64(w[0] ^ SIGN), reach, shared.value)
                new = ~again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[new])] + [pa.array(i64(x[new] ^ SIGN)) for x in w]
                    + [pa.array(i64(reach[new])), pa.array(doc[new]), pa.array(row[new]),
                       pa.array(place_of(pos[new], dl[new], dr[new]))],
                    names=[c.split()[0] for c in SUFFIX.split(", ")])
                if again.any():  # settled here: one row for each run of windows, spread by document
                    lo, hi = s.lo[again] - base[again], s.hi[again] - base[again]
                    d, r = doc[again], row[again]
                    cut = np.ones(len(lo), bool)
                    cut[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (lo[1:] != hi[:-1] + 1)
                    cut = np.append(np.flatnonzero(cut), len(lo))
                    a, e = cut[:-1], cut[1:] - 1
                    n = len(a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((mix(i64(r[a]).view(np.uint64)) % np.uint64(len(shared.value) + 1)).astype(np.int32)),
                         pa.array(hi[e]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                         pa.array(d[a]), pa.array(r[a]), pa.array(lo[a])],
                        names=[c.split()[0] for c in SUFFIX.split(", ")])
    return texts.mapInArrow(run, SUFFIX)


# place null: windows lo..hi are repeats; else a suffix to extend, heavy if its gram has many
FOUND = "doc_id long, row long, lo long, hi long, place long, heavy boolean"


def found_rows(doc, row, lo, hi, place=None, heavy=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(row), pa.array(lo), pa.array(hi),
         pa.nulls(n, pa.int64()) if place is None else pa.array(place),
         pa.nulls(n, pa.bool_()) if heavy is None else pa.array(heavy)],
        names=["doc_id", "row", "lo", "hi", "place", "heavy"])


def compare(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            early = b.filter(b.column("reach").is_null())
            if early.num_rows:
                yield found_rows(*(early.column(k).to_numpy() for k in (5, 6, 7, 1)))
            b = b.filter(b.column("reach").is_valid())
            if b.num_rows:
                got.append(b)
        if not got:
            return
        w0, w1, w2, reach, doc, row, place = (np.concatenate([b.column(k).to_numpy() for b in got])
                                              for k in range(1, 8))
        got.clear()
        order = multikey_order([w0, w1, w2])
        cut = runs(w0[order], w1[order], w2[order])
        size = np.diff(cut)
        crossing = np.searchsorted(shared.value, w0, "left") != np.searchsorted(shared.value, w0, "right")
        live = np.zeros(len(w0), bool)
        live[order] = np.repeat(size > 1, size)
        live |= crossing
        i = np.flatnonzero(live)
        if len(i) == 0:
            return
        again = first_of([reach[i], w0[i]], doc[i], row[i], place[i])
        run_no = np.empty(len(w0), np.int64)
        run_no[order] = np.repeat(np.arange(len(size)), size)
        by = np.lexsort((reach[i], run_no[i]))
        j = i[by]
        c = runs(run_no[j])
        mixed = np.repeat(reach[j[c[:-1]]] != reach[j[c[1:] - 1]], np.diff(c))
        extend = np.zeros(len(w0), bool)
        extend[j] = mixed
        extend |= crossing
        done = i[again]
        _, lo, hi = unplace(place[done])
        yield found_rows(doc[done], row[done], lo, hi)
        extend[done] = False
        k = np.flatnonzero(extend)
        _, lo, hi = unplace(place[k])
        # all suffixes of a gram agree on this: they are in one run here, or every bucket calls them crossing
        yield found_rows(doc[k], row[k], lo, hi, place[k], crossing[k] | (size[run_no[k]] > HEAVY))
        release()

    return rows.repartitionById(len(cuts) + 1, F.col("bucket")).mapInArrow(run, FOUND)


def extend(texts: DataFrame, ask: DataFrame, length: int) -> DataFrame:
    """Repeated windows over the suffixes in ``ask``."""
    spots = ask.groupBy("doc_id", "row").agg(
        F.collect_list("place").alias("places"), F.collect_list("heavy").alias("heavies")) \
        .withColumnsRenamed({"doc_id": "d", "row": "r"})
    asked = texts.join(spots, (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r"))) \
        .select("doc_id", "text", "row", "places", "heavies")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, rows = b.column(0).to_numpy(), b.column(2).to_numpy()
            for t in text_chunks(b.column(1), CHUNK):
                some = b.column(3).slice(t.rows.start, len(t))
                n = some.value_lengths().to_numpy()
                place = some.flatten().to_numpy()
                heavy = b.column(4).slice(t.rows.start, len(t)).flatten().to_numpy(zero_copy_only=False).astype(bool)
                of = np.repeat(np.arange(len(t)), n)
                # window starts lie dr..dl bytes before the suffix; heavy suffixes go out BLOCK starts at a time
                dl, dr = place >> 10 & 1023, place & 1023
                parts = np.where(heavy, dl // BLOCK - dr // BLOCK + 1, 1)
                block, each = expand(dr // BLOCK, parts)
                split = heavy[each]
                dl = np.where(split, np.minimum(dl[each], block * BLOCK + BLOCK - 1), dl[each])
                dr = np.where(split, np.maximum(dr[each], block * BLOCK), dr[each])
                of, pos = of[each], place[each] >> 20
                place = place_of(pos, dl, dr)
                lo, hi = pos - dl, pos - dr
                base = t.offs[of]
                prefix = ROLL1.prefix(t.data)
                key = ROLL1.ranges(prefix, base + pos, base + pos + GRAM)
                key = np.where(split, mix(key + block.astype(np.uint64) + np.uint64(1)), key)
                reach = mix(ROLL1.ranges(prefix, base + lo, base + hi + length)
                            + (pos - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                doc, row = docs[t.rows][of], rows[t.rows][of]
                again = first_of([reach, key], doc, row, pos)
                raw = t.data.tobytes()
                around = [None if x else raw[a:e] for x, a, e in zip(
                    again.tolist(), (base + lo).tolist(), (base + hi + length).tolist())]
                spread = np.where(again, mix(np.arange(len(key)).astype(np.uint64)), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i64(spread)), pa.array(doc), pa.array(row), pa.array(place),
                     pa.array(around, pa.binary())], names=["key", "doc_id", "row", "place", "around"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        tab = pa.Table.from_batches(got)
        early = tab.filter(pa.compute.is_null(tab.column("around")))
        if early.num_rows:
            _, lo, hi = unplace(early.column("place").to_numpy())
            yield found_rows(early.column("doc_id").to_numpy(), early.column("row").to_numpy(), lo, hi)
        tab = tab.filter(pa.compute.is_valid(tab.column("around"))).sort_by("key")
        key = tab.column("key").to_numpy()
        cut = runs(key)
        a = 0
        while a < len(cut) - 1:
            e = max(a + 1, int(np.searchsorted(cut, cut[a] + PIECE, "right")) - 1)
            yield from repeats(tab.slice(int(cut[a]), int(cut[e] - cut[a])), length)
            a = e
        release()

    return asked.mapInArrow(emit, "key long, doc_id long, row long, place long, around binary").repartition("key") \
        .mapInArrow(judge, FOUND)


def repeats(tab: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Of whole groups of suffixes with their surroundings, the windows that an equal, earlier window makes repeats."""
    doc, row, place = (tab.column(x).to_numpy() for x in ("doc_id", "row", "place"))
    around = tab.column("around").combine_chunks().cast(pa.large_binary())
    offs = np.frombuffer(around.buffers()[1], np.int64)[around.offset:around.offset + len(around) + 1]
    data = np.frombuffer(around.buffers()[2], np.uint8)[offs[0]:offs[-1]]
    offs = offs - offs[0]
    pos, lo, hi = unplace(place)
    p1, p2 = ROLL1.prefix(data), ROLL2.prefix(data)
    # a group far over PIECE is compared some window offsets at a time
    step = max(1, (length - GRAM + 1) * PIECE // max(len(doc), 1))
    back = pos - hi
    for o in range(0, length - GRAM + 1, step):
        # windows that start o .. o+step-1 before the suffix
        first = np.maximum(lo, pos - (o + step - 1))
        last = np.minimum(hi, pos - o)
        n = np.maximum(last - first + 1, 0)
        start, of = expand(first, n)
        at = offs[of] + start - lo[of]
        h1, h2 = ROLL1.ranges(p1, at, at + length), ROLL2.ranges(p2, at, at + length)
        again = first_of([h1, h2], doc[of], row[of], start)
        k = np.flatnonzero(again)
        if len(k) == 0:
            continue
        s, f = start[k], of[k]
        new = np.ones(len(k), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1] + 1)
        cut = np.append(np.flatnonzero(new), len(k))
        a, e = cut[:-1], cut[1:] - 1
        yield found_rows(doc[f[a]], row[f[a]], s[a], s[e])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def apply_removals(rows: DataFrame, removed: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    spans = removed.groupBy("doc_id", "row").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")) \
        .withColumnsRenamed({"doc_id": "d", "row": "r"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left") \
        .select("doc_id", "text", "los", "his")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_chunks(b.column(1), CHUNK):
                los, his = (b.column(k).slice(t.rows.start, len(t)).to_pylist() for k in (2, 3))
                n_removed, n_spans, sha, kept = [], [], [], []
                for i in range(len(t)):
                    data = t.data[t.offs[i]:t.offs[i + 1]]
                    gone = 0
                    spans = 0
                    if los[i]:
                        mask = covered(len(data), np.array(los[i]), np.array(his[i]) + length)
                        gone = int(mask.sum())
                        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                        data = data[~mask]
                    raw = data.tobytes()
                    n_removed.append(gone)
                    n_spans.append(spans)
                    sha.append(hashlib.sha256(raw).hexdigest())
                    kept.append(raw if with_bytes else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.rows.start, len(t)), pa.array(np.diff(t.offs)), pa.array(n_removed, pa.int64()),
                     pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null unless ``with_bytes``)."""
    if not GRAM < length <= 1000:
        raise ValueError(f"length must be in {GRAM + 1}..1000")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row"))
    known = rows.where("doc_id is not null")
    cuts = splitters(known, BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), length)
    # each step's shuffle files go before the next step writes its own
    found = stored(compare(suffix_rows(known, cuts, length), cuts), "suffixes", free=True)
    more = stored(extend(known, found.where("place is not null"), length), "extended", free=True)
    removed = found.where("place is null").unionByName(more).select("doc_id", "row", "lo", "hi")
    return apply_removals(rows, removed, length, with_bytes)
