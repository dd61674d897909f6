"""Substring dedup of word windows with difference-cover anchors.

A window of 50 words is removed where the same words also start in a document with a smaller id.  The positions of
{1, 5, 11, 24, 25, 27} modulo 31 form a difference cover: for any shift between two documents some position is in the
cover on both sides.  So only the 20-word windows that start at cover positions are hashed (6 of 31), and any two
equal 50-word windows hold an equal, equally placed anchor.

1. Each anchor goes out as one row: its hash, the hash of all that the windows over it can reach (30 words to either
   side), document and position.  Within a chunk of documents, rows that agree in both leave one representative; the
   others are settled where they are, so a large group of copies reaches the shuffle as one row a chunk.
2. One shuffle by anchor hash.  An anchor of one document is dropped.  Where the reach is equal, too, all windows over
   the anchor are repeats for every document but the least.  What is left differs somewhere in its reach.
3. Those anchors are extended: their documents' text gives the 50-word windows over them (128-bit hashes), settled
   by one more shuffle in the same way.
4. The removed windows are gathered by document, joined to the texts, and applied.

Defined cases: null text = no words; a null id is never smaller than another and has none smaller, so nothing is
removed from it; rows that repeat an id never remove each other's words; an empty table gives no rows.  Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import (ROLL1, ROLL2, Texts, covered, expand, i64, runs, small_batches, stored, text_chunks, word_hashes,
                                  words)

WINDOW = 50
# a perfect difference set modulo 31: every non-zero residue is the difference of exactly one pair
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

ROW = "key long, reach long, doc_id long, row long, pos int, lo int, hi int"  # windows lo..hi, hi inclusive
NAMES = ["key", "reach", "doc_id", "row", "pos", "lo", "hi"]
SETTLED = "doc_id long, row long, pos int, lo int, hi int"


def settle(key: np.ndarray, reach: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows hold a (key, reach) that a smaller document holds as well."""
    order = np.lexsort((doc, reach, key))
    cut = runs(key[order], reach[order])
    least = np.repeat(doc[order[cut[:-1]]], np.diff(cut))
    out = np.zeros(len(key), bool)
    out[order] = doc[order] > least
    return out


def anchors(t: Texts, doc: np.ndarray, row: np.ndarray, window: int) -> list[np.ndarray]:
    size = window - PERIOD + 1
    starts, ends, first = words(t)
    n = np.diff(first)
    at = np.arange(len(starts)) - np.repeat(first[:-1], n)
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    length = np.repeat(n, n)
    w = np.flatnonzero(in_cover[at % PERIOD] & (at + size <= length) & (length >= window))
    of = np.searchsorted(first, w, side="right") - 1
    p1 = ROLL1.prefix(word_hashes(t, starts, ends, roll=ROLL1))
    p2 = ROLL2.prefix(word_hashes(t, starts, ends, roll=ROLL2))
    key = ROLL1.ranges(p1, w, w + size)
    pos = at[w]
    left = np.minimum(pos, PERIOD - 1)
    right = np.minimum(n[of] - pos, window)
    reach = ROLL2.ranges(p2, w - left, w + right) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lo = pos - left
    hi = np.minimum(pos, n[of] - window)
    return [i64(key), i64(reach), doc[of], row[of], pos, lo, hi]


def rows_out(cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    ints = {"pos", "lo", "hi"}
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if x in ints else np.int64))
                                       for x, c in zip(names, cols)], names=names)


def with_early_settling(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Marks the rows that a smaller document of the same chunk settles by pos = -1 and a key of their own."""
    done = settle(cols[0], cols[1], cols[2])
    if done.any():
        cols[4] = np.where(done, -1, cols[4])
        spread = i64(np.arange(len(done)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        cols[0] = np.where(done, cols[0] ^ spread, cols[0])
        # windows of neighbouring anchors overlap: one row for each run of them
        d = np.flatnonzero(done)
        new = np.ones(len(d), bool)
        new[1:] = (cols[3][d][1:] != cols[3][d][:-1]) | (cols[5][d][1:] > cols[6][d][:-1] + 1) | (
            cols[5][d][1:] < cols[5][d][:-1])
        cut = np.append(np.flatnonzero(new), len(d))
        head = d[cut[:-1]]
        cols[6][head] = np.maximum.reduceat(cols[6][d], cut[:-1])
        keep = ~done
        keep[head] = True
        cols = [c[keep] for c in cols]
    return cols


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = b.column(0).to_numpy(), b.column(2).to_numpy()
            for t in text_chunks(b.column(1)):
                cols = anchors(t, doc[t.rows], row[t.rows], window)
                yield rows_out(with_early_settling(cols), NAMES)
    return docs.mapInArrow(run, ROW)


def compare(rows: DataFrame) -> DataFrame:
    """Settled window ranges (pos -1) and anchors still to extend (pos >= 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        key, reach, doc, row, pos, lo, hi = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(7))
        early = pos < 0
        order = np.lexsort((doc, key))
        cut = runs(key[order])
        begin, last = cut[:-1], cut[1:] - 1
        several = doc[order[begin]] != doc[order[last]]
        live = np.zeros(len(key), bool)
        live[order] = np.repeat(several, np.diff(cut))
        live &= ~early
        done = np.zeros(len(key), bool)
        i = np.flatnonzero(live)
        done[i] = settle(key[i], reach[i], doc[i])
        # groups whose reach is the same everywhere need no extension
        i = i[np.lexsort((reach[i], key[i]))]
        cut = runs(key[i])
        if len(i):
            mixed = reach[i[cut[:-1]]] != reach[i[cut[1:] - 1]]
            extend = np.zeros(len(key), bool)
            extend[i] = np.repeat(mixed, np.diff(cut))
        else:
            extend = live
        out = early | done | (extend & ~done)
        at = np.flatnonzero(out)
        p = np.where(extend[at] & ~done[at], pos[at], -1)
        yield rows_out([doc[at], row[at], p, lo[at], hi[at]], NAMES[2:])
    return rows.repartition("key").mapInArrow(run, SETTLED)


def windows_out(docs: DataFrame, ask: DataFrame, window: int) -> DataFrame:
    """Settled windows over the anchors in ``ask``: the documents' text is joined to them and extended."""
    spots = ask.groupBy("doc_id", "row").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")) \
        .withColumnsRenamed({"doc_id": "d", "row": "r"})
    texts = docs.join(spots, (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r"))) \
        .select("doc_id", "text", "row", "los", "his")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = b.column(0).to_numpy(), b.column(2).to_numpy()
            for t in text_chunks(b.column(1)):
                starts, ends, first = words(t)
                p1 = ROLL1.prefix(word_hashes(t, starts, ends, roll=ROLL1))
                p2 = ROLL2.prefix(word_hashes(t, starts, ends, roll=ROLL2))
                w, of = [], []
                for i in range(len(t)):
                    k = t.rows.start + i
                    n = first[i + 1] - first[i]
                    mask = covered(n, np.array(b.column(3)[k].as_py()), np.array(b.column(4)[k].as_py()) + 1)
                    mine = np.flatnonzero(mask) + first[i]
                    w.append(mine)
                    of.append(np.full(len(mine), i))
                w, of = np.concatenate(w), np.concatenate(of)
                key, more = ROLL1.ranges(p1, w, w + window), ROLL2.ranges(p2, w, w + window)
                at = w - first[of]
                yield rows_out(with_early_settling([i64(key), i64(more), doc[t.rows][of], row[t.rows][of], at,
                                                    at.copy(), at.copy()]), NAMES)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        key, more, doc, row, pos, lo, hi = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(7))
        out = pos < 0
        i = np.flatnonzero(~out)
        out[i] = settle(key[i], more[i], doc[i])
        at = np.flatnonzero(out)
        yield rows_out([doc[at], row[at], np.full(len(at), -1), lo[at], hi[at]], NAMES[2:])

    return texts.mapInArrow(emit, ROW).repartition("key").mapInArrow(judge, SETTLED)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def apply_removals(docs: DataFrame, removed: DataFrame, window: int, with_text: bool) -> DataFrame:
    spans = removed.groupBy("doc_id", "row").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")) \
        .withColumnsRenamed({"doc_id": "d", "row": "r"})
    all_docs = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left") \
        .select("doc_id", "text", "los", "his")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_chunks(b.column(1)):
                starts, ends, first = words(t)
                los, his = (b.column(k).slice(t.rows.start, len(t)).to_pylist() for k in (2, 3))
                n_removed, sha, kept = [], [], []
                for i in range(len(t)):
                    parts = t.raw(i).split()
                    if los[i]:
                        gone = covered(len(parts), np.array(los[i]), np.array(his[i]) + window)
                        parts = [parts[k] for k in np.flatnonzero(~gone)]
                        n_removed.append(int(gone.sum()))
                    else:
                        n_removed.append(0)
                    text = b" ".join(parts)
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.rows.start, len(t)), pa.array(np.diff(first)), pa.array(n_removed, pa.int64()),
                     pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return all_docs.mapInArrow(cut, RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless ``with_text``)."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row"))
    known = rows.where("doc_id is not null")
    found = stored(compare(anchor_rows(known, window)), "anchors")
    extended = windows_out(known, found.where("pos >= 0"), window)
    removed = found.where("pos < 0").unionByName(extended).select("doc_id", "row", "lo", "hi")
    return apply_removals(rows, removed, window, with_text)
