"""Hard-negative mining: exact integer scores by Strassen products of tiles, and mergeable heaps.

Anchors score all rows by integer inner product.  An anchor's positives are its best other rows of the same label; for
each positive, its hard negatives are the best rows of other labels whose score lies in a window below the positive's.

* **Tiles.**  Rows are dealt into blocks by a hash, anchors too.  A cell of the grid holds one block of anchors and
  streams one block of rows past it, so a task holds at most one block of anchors and one Arrow batch of rows,
  whatever the label or the table.  The number of blocks follows the counted rows; nothing is broadcast or collected.
* **Strassen.**  A tile's scores are the product of an anchors x dimensions and a dimensions x rows matrix of int64,
  split recursively into quarters (7 products, 18 additions); odd sides are padded with zeros.  Additions and products
  are exact modulo 2**64, so a score is exact whenever it fits a long, whatever the terms in between.
* **Heaps.**  Each cell keeps the first few rows of each anchor (first pass: same label) or of each window (second
  pass: other labels), ordered by score, then id.  Heaps of tiles merge in the cell; those of cells merge in Spark by a
  ranked window with a limit for each group, which drops losers before the shuffle.

The second pass needs the positives' scores, so the products are made twice rather than stored.

Defined cases: a row without id, label or vector, or with a component that is null, not finite or too large for a
scaled long (beyond 2**53 in size) takes no part.  Shorter vectors are filled up with zeros to the longest; an empty
vector scores 0.  Rows that agree in id, label and vector are one row; rows that share an id but differ are rows of
their own (ties: by id, then by a hash of the row).  Ties in score go to the smaller id.  An empty table, or one
without anchors, gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import batch, stored

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
ANCHOR_BLOCK, ROW_BLOCK, TILE = 4096, 1 << 16, 4096
MAX_TASKS = 4096
LEAF = 8
ABSENT = np.iinfo(np.int64).min


def scaled_rows(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
                label_col: str = "label") -> DataFrame:
    """(vec_id long, label long, vec array<long>): floor(scale * x) of each component; rows that take no part are out."""
    x = F.col(vec_col)
    big = F.lit(float(1 << 53))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) > big))
    return (table.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~bad)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vec")))


# ---------------------------------------------------------------- products

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    i, j, l = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((m, n), np.int64)
    c[:i, :l] = p1 + p4 - p5 + p7
    c[:i, l:] = p3 + p5
    c[i:, :l] = p2 + p4
    c[i:, l:] = p1 - p2 + p3 + p6
    return c


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros to ``width``."""
    offs = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    n = np.diff(offs)
    out = np.zeros((len(n), width), np.int64)
    inside = np.arange(width) < n[:, None]
    out[inside] = flat[offs[0]:offs[-1]]
    return out


# ---------------------------------------------------------------- heaps

class Heaps:
    """The first ``size`` entries of each of ``n`` groups, by score (largest first), id, row."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.score = np.full((n, size), ABSENT)
        self.id, self.row = np.zeros((2, n, size), np.int64)
        self.there = np.zeros((n, size), bool)

    def push(self, scores: np.ndarray, member: np.ndarray, ids: np.ndarray, rows: np.ndarray,
             groups: np.ndarray | slice = slice(None)) -> None:
        """Merges a tile: ``scores`` and ``member`` (groups x rows); the rows are sorted by id, then row."""
        x = np.where(member, scores, ABSENT)
        left = member.copy()
        lines = np.arange(len(x))
        found = []
        for _ in range(self.size):
            at = np.argmax(x, axis=1)
            ok = left[lines, at]
            # the least long itself may be a score: then the first member that is left stands in for argmax
            odd = np.flatnonzero(~ok & left.any(axis=1))
            at[odd] = np.argmax(left[odd], axis=1)
            ok[odd] = True
            if not ok.any():
                break
            found.append((np.where(ok, scores[lines, at], ABSENT), np.where(ok, ids[at], 0),
                          np.where(ok, rows[at], 0), ok))
            x[lines, at] = ABSENT
            left[lines, at] = False
        if not found:
            return
        score, vid, row, there = (np.concatenate([own[groups], np.stack(new, axis=1)], axis=1) for own, new in zip(
            (self.score, self.id, self.row, self.there), zip(*found)))
        order = np.lexsort((row, vid, ~score, ~there), axis=1)[:, :self.size]
        for own, new in zip((self.score, self.id, self.row, self.there), (score, vid, row, there)):
            own[groups] = np.take_along_axis(new, order, axis=1)


def windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score within low/100 and high/100 of a positive's score, without overflow."""
    whole, rest = scores // 100, scores % 100
    return low * whole + -(-(low * rest) // 100), high * whole + high * rest // 100


class Cell:
    """One block of anchors past which a block of rows streams."""

    def __init__(self, anchors: pa.Table, width: int, size: int, low: int, high: int, second: bool):
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in anchors.columns]
        self.id, self.row, self.label = (c.to_numpy() for c in cols[2:5])
        self.vec = matrix(cols[5], width)
        n = len(self.id)
        self.width, self.second = width, second
        if second:
            targets = cols[6]
            offs = targets.offsets.to_numpy().astype(np.int64)
            self.targets = targets.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]]
            self.owner = np.repeat(np.arange(n), np.diff(offs))
            self.place = np.arange(len(self.owner)) - np.repeat(offs[:-1] - offs[0], np.diff(offs))
            self.lo, self.hi = windows(self.targets, low, high)
            self.heaps = Heaps(len(self.owner), size)
        else:
            self.heaps = Heaps(n, size)

    def push(self, rows: pa.RecordBatch) -> None:
        ids, row, label = (rows.column(i).to_numpy() for i in (2, 3, 4))
        vec = matrix(rows.column(5), self.width)
        if not self.second:  # only anchors and rows of one label meet
            order = np.lexsort((row, ids, label))
            ids, row, label, vec = ids[order], row[order], label[order], vec[order]
            for one in np.unique(label):
                group = np.flatnonzero(self.label == one)
                if not len(group):
                    continue
                a, b = np.searchsorted(label, [one, one + 1]) if one < np.iinfo(np.int64).max else (
                    np.searchsorted(label, one), len(label))
                scores = strassen(self.vec[group], np.ascontiguousarray(vec[a:b].T))
                other = (ids[a:b] != self.id[group, None]) | (row[a:b] != self.row[group, None])
                self.heaps.push(scores, other, ids[a:b], row[a:b], group)
            return
        order = np.lexsort((row, ids))
        ids, row, label, vec = ids[order], row[order], label[order], vec[order]
        scores = strassen(self.vec, np.ascontiguousarray(vec.T))
        differs = label != self.label[:, None]
        for at in range(0, len(self.owner), 1024):
            g = slice(at, at + 1024)
            s = scores[self.owner[g]]
            member = differs[self.owner[g]] & (s >= self.lo[g, None]) & (s <= self.hi[g, None])
            some = np.flatnonzero(member.any(axis=1))
            if len(some):
                self.heaps.push(s[some], member[some], ids, row, some + at)

    def result(self) -> pa.RecordBatch:
        h = self.heaps
        group, k = np.nonzero(h.there)
        owner = self.owner[group] if self.second else group
        return batch(anchor_id=self.id[owner], anchor_row=self.row[owner],
                     place=self.place[group] if self.second else np.zeros(len(group), np.int64),
                     id=h.id[group, k], row=h.row[group, k], score=h.score[group, k])


def cell_batches(batches: Iterator[pa.RecordBatch], width: int, size: int, low: int, high: int, second: bool):
    """Cells come one after another, each with its anchors first."""
    held: list[pa.RecordBatch] = []
    cell, number = None, None
    for b in batches:
        cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(cells)]):
            if cells[lo] != number:
                if cell is not None:
                    yield cell.result()
                cell, number, held = None, cells[lo], []
            part = b.slice(lo, hi - lo)
            if kinds[lo] == 0:
                held.append(part)
                continue
            if cell is None:
                if not held:
                    continue
                cell = Cell(pa.Table.from_batches(held), width, size, low, high, second)
            for at in range(0, part.num_rows, TILE):
                cell.push(part.slice(at, TILE))
    if cell is not None:
        yield cell.result()


# ---------------------------------------------------------------- grid

def grid(rows: DataFrame, anchors: DataFrame, counted: tuple[int, int, int], size: int, low: int, high: int,
         second: bool) -> DataFrame:
    """Partial heaps of all cells: anchor_id, anchor_row, place, id, row, score."""
    spark = rows.sparkSession
    n, n_anchors, width = counted
    by_anchor = max(1, -(-n_anchors // ANCHOR_BLOCK))
    by_row = max(1, -(-n // ROW_BLOCK), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // by_anchor))
    tasks = min(MAX_TASKS, by_anchor * by_row)

    def block(salt: int, count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "row", F.lit(salt)), F.lit(count))

    empty = F.array().cast("array<long>")
    a = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(by_row - 1))).alias("other"), block(1, by_anchor).alias("own"), "vec_id",
        "row", "label", "vec", (F.col("targets") if second else empty).alias("targets")).select(
        (F.col("own") * by_row + F.col("other")).alias("cell"), F.lit(0).alias("kind"), "vec_id", "row", "label", "vec",
        "targets")
    b = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(by_anchor - 1))).alias("other"), block(2, by_row).alias("own"), "vec_id",
        "row", "label", "vec").select(
        (F.col("other") * by_row + F.col("own")).alias("cell"), F.lit(1).alias("kind"), "vec_id", "row", "label", "vec",
        empty.alias("targets"))
    dealt = (a.unionByName(b).repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int"))
             .sortWithinPartitions("cell", "kind"))
    return dealt.mapInArrow(lambda it: cell_batches(it, width, size, low, high, second),
                            "anchor_id long, anchor_row long, place long, id long, row long, score long")


def first(heaps: DataFrame, size: int) -> DataFrame:
    """Merges the heaps of the cells: adds ``rank`` from 1."""
    order = Window.partitionBy("anchor_id", "anchor_row", "place").orderBy(F.desc("score"), "id", "row")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    ``rows``: vec_id, label, vec (longs); ``is_anchor`` is a condition on them.  A negative's score lies between
    ``low`` and ``high`` hundredths of the positive's.
    """
    if min(positives, negatives) < 1:
        raise ValueError("at least one positive and one negative")
    table = stored(rows.select("vec_id", "label", "vec").distinct()
                   .withColumn("row", F.xxhash64("label", "vec")), "negatives-rows")
    n, n_anchors, width = table.agg(F.count(F.lit(1)), F.count_if(is_anchor),
                                    F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    anchors = table.where(is_anchor)
    counted = (n, n_anchors, width)
    best = stored(first(grid(table, anchors, counted, positives, low, high, False), positives)
                  .drop("place"), "negatives-positives")
    targets = best.groupBy("anchor_id", "anchor_row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("targets"))
    near = anchors.join(targets, (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row")))
    found = first(grid(table, near, counted, negatives, low, high, True), negatives)
    named = best.select("anchor_id", "anchor_row", (F.col("rank") - 1).cast("long").alias("place"),
                        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (found.join(named, ["anchor_id", "anchor_row", "place"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
