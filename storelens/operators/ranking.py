"""Exact order statistics and rank-based buckets at any scale.

``pd.qcut(x.rank(method='first'), q)`` puts the row of rank ``r`` (1-based,
ties broken by a unique key) among ``n`` rows into bucket
``max(1, ceil(q (r-1) / (n-1)))``.  Bucket ``j`` therefore ends at rank
``k_j = floor(j (n-1) / q) + 1``, so a row's bucket is
``1 + #{j : key(row) > key at rank k_j}``.  Only the ``q - 1`` boundary keys
are needed, never a full ranking.

:func:`search` finds the keys at given ranks, for any number of orderings of
one frame at a time, without a global sort and without a window.  A round is
two jobs, whatever the number of orderings and live candidate ranges:

1. a sample of about ``OVERSAMPLE * fanout`` keys of each live range gives its
   ``fanout - 1`` evenly spaced cut keys (picked in Spark);
2. one aggregation counts rows per cut bucket (partial aggregation first, so a
   hot key costs nothing extra), and the bucket that holds the wanted rank is
   the next candidate range.

A range of at most ``fanout ** 2`` keys ends the search: one job sorts the keys
of all such ranges in an aggregate and picks the wanted ones.  From the second
round on only the live ranges are scanned, from a persisted copy.

Keys are lexicographic structs ending in a unique tie-break column, so even a
value shared by a third of all rows is split by the tie-break, and every round
shrinks the candidate range by about ``fanout``.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.session import path_exists
from storelens.sources.sinks import stored

FANOUT = 64
OVERSAMPLE = 32


def _key_struct(cols: list[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def _sql_value(v, dt: T.DataType) -> str | None:
    """SQL text of one typed literal, or None for a type not rendered here."""
    name = dt.simpleString()
    if v is None:
        return f"CAST(NULL AS {name})"
    if isinstance(dt, T.StringType):
        # hex bytes decoded as UTF-8: no quoting or escaping of the text
        return f"CAST(X'{v.encode('utf-8').hex()}' AS STRING)"
    if isinstance(dt, T.DecimalType):
        return f"CAST('{v}' AS {name})"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({int(v)} AS {name})"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        text = "NaN" if v != v else ("Infinity" if v == float("inf") else
                                     "-Infinity" if v == float("-inf") else repr(float(v)))
        return f"CAST('{text}' AS {name})"
    if isinstance(dt, T.DateType):
        return f"DATE '{v.isoformat()}'"
    if isinstance(dt, T.BooleanType):
        return "TRUE" if v else "FALSE"
    return None


def _sql_key(values: tuple, key_type: T.StructType) -> str | None:
    parts = []
    for v, f in zip(values, key_type.fields):
        text = _sql_value(v, f.dataType)
        if text is None:
            return None
        parts.append(f"'{f.name}', {text}")
    return f"named_struct({', '.join(parts)})"


def _key_literal(values: tuple, key_type: T.StructType) -> Column:
    # Each gateway call costs milliseconds, so a key is one SQL expression when
    # its types allow (a search round builds dozens of them).
    text = _sql_key(values, key_type)
    if text is not None:
        return F.expr(text)
    return F.struct(*[F.lit(v).cast(f.dataType.simpleString()).alias(f.name)
                      for v, f in zip(values, key_type.fields)])


@dataclass
class _Range:
    """Candidates ``lo < key <= hi`` of one ordering, and the wanted ranks among them."""
    lo: tuple | None
    hi: tuple | None
    size: int
    wanted: list[tuple[int, int]]  # (rank in the whole ordering, rank within the range)
    cuts: list[tuple] = field(default_factory=list)


def _in_range(name: str, rng: _Range, key_type: T.StructType) -> Column:
    key = F.col(name)
    pred = key.isNotNull()
    if rng.lo is not None:
        pred = pred & (key > _key_literal(rng.lo, key_type))
    if rng.hi is not None:
        pred = pred & (key <= _key_literal(rng.hi, key_type))
    return pred


def _bucket_expr(name: str, bounds: list[tuple], key_type: T.StructType) -> Column:
    """Bucket b in 0..len(bounds): bounds[b-1] < key <= bounds[b], by binary search.

    The search tree is one SQL expression (one gateway call) when every bound
    renders as SQL text.
    """
    texts = [_sql_key(c, key_type) for c in bounds]
    if all(t is not None for t in texts):
        def sql_tree(lo: int, hi: int) -> str:
            if lo == hi:
                return str(lo)
            mid = (lo + hi) // 2
            return f"CASE WHEN {name} <= {texts[mid]} THEN {sql_tree(lo, mid)} ELSE {sql_tree(mid + 1, hi)} END"
        return F.expr(sql_tree(0, len(bounds)))
    lits = [_key_literal(c, key_type) for c in bounds]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(name) <= lits[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def _spaced(every: Column, fanout: int) -> Column:
    """All of a sorted array of at most ``fanout`` keys, else ``fanout - 1`` evenly spaced ones; distinct."""
    step = F.size(every) / F.lit(float(fanout))
    some = F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)),
                       lambda k: F.element_at(every, F.floor(k * step).cast("int") + 1))
    return F.array_distinct(F.when(F.size(every) <= fanout, every).otherwise(some))


def _sample_cuts(current: DataFrame, names: list[str], types: list[T.StructType], live: list[list[_Range]],
                 fanout: int, seed: int) -> None:
    """Fills in the cut keys of every live range: one job."""
    arrays, of = [], []
    for i, (name, ranges) in enumerate(zip(names, live)):
        for r, rng in enumerate(ranges):
            hit = _in_range(name, rng, types[i]) & (F.col("draw") < OVERSAMPLE * fanout / rng.size)
            arrays.append(F.sort_array(F.collect_list(F.when(hit, F.col(name)))).alias(f"a{len(of)}"))
            of.append(rng)
    cuts = [_spaced(F.col(f"a{j}"), fanout).alias(f"a{j}") for j in range(len(of))]
    for rng, got in zip(of, current.select("*", F.rand(seed).alias("draw")).agg(*arrays).select(*cuts).first()):
        rng.cuts = [tuple(c) for c in got]


def _count_buckets(current: DataFrame, names: list[str], types: list[T.StructType],
                   live: list[list[_Range]]) -> dict[tuple[int, int], int]:
    """Rows per (ordering, bucket between neighbouring bounds) over all live ranges: one job."""
    entries = []
    for i, (name, ranges) in enumerate(zip(names, live)):
        if ranges:
            b = _bucket_expr(name, _bounds(ranges), types[i])
            entries.append(F.when(F.col(name).isNotNull(), F.struct(F.lit(i).alias("i"), b.alias("b"))))
    rows = current.select(F.explode(F.array(*entries)).alias("e")).where("e is not null")
    return {(r["i"], r["b"]): r["count"] for r in rows.groupBy("e.i", "e.b").count().collect()}


def _settle(current: DataFrame, names: list[str], types: list[T.StructType], live: list[list[_Range]],
            found: list[dict[int, tuple]], most: int) -> None:
    """Finds the wanted keys of every range of at most ``most`` keys and drops those ranges: one job."""
    arrays, picks, of = [], [], []
    for i, (name, ranges) in enumerate(zip(names, live)):
        for rng in ranges:
            if rng.size > most:
                continue
            j = len(arrays)
            arrays.append(F.sort_array(F.collect_list(F.when(_in_range(name, rng, types[i]), F.col(name)))).alias(f"a{j}"))
            for rank, k in rng.wanted:
                picks.append(F.element_at(F.col(f"a{j}"), k).alias(f"p{len(of)}"))
                of.append((i, rank))
    if not arrays:
        return
    for (i, rank), key in zip(of, current.agg(*arrays).select(*picks).first()):
        found[i][rank] = tuple(key)
    live[:] = [[rng for rng in ranges if rng.size > most] for ranges in live]


def _bounds(ranges: list[_Range]) -> list[tuple]:
    """All range ends and cuts of an ordering, ascending (ranges are disjoint and in order)."""
    out: list[tuple] = []
    for rng in ranges:
        for c in ([rng.lo] if rng.lo is not None else []) + rng.cuts + ([rng.hi] if rng.hi is not None else []):
            if not out or out[-1] != c:
                out.append(c)
    return out


def search(keys: DataFrame, ranks: Callable[[list[int]], list[list[int]]], *, fanout: int = FANOUT,
           seed: int = 42) -> tuple[list[int], list[dict[int, tuple]]]:
    """Keys at 1-based ranks of every key column of ``keys``.

    Each column of ``keys`` is one ordering: a struct key, null where the row
    takes no part.  ``ranks`` maps the columns' row counts to the wanted ranks.
    Returns the counts and, per ordering, rank -> key tuple.
    """
    names = keys.columns
    one = keys.agg(*[F.count(n).alias(n) for n in names]).first()
    sizes = [one[n] for n in names]
    live: list[list[_Range]] = []
    for n, rs in zip(sizes, ranks(sizes)):
        rs = sorted({r for r in rs if 1 <= r <= n})
        live.append([_Range(None, None, n, [(r, r) for r in rs])] if rs else [])
    return sizes, _narrow(keys, live, fanout, seed)


def _narrow(keys: DataFrame, live: list[list[_Range]], fanout: int = FANOUT, seed: int = 42) -> list[dict[int, tuple]]:
    """Rank -> key of every ordering, from candidate ranges on."""
    names = keys.columns
    types = [keys.schema[n].dataType for n in names]
    found: list[dict[int, tuple]] = [{} for _ in names]
    current, owned, rounds = keys, None, 0
    try:
        while True:
            _settle(current, names, types, live, found, fanout * fanout)
            if not any(live):
                break
            rounds += 1
            if rounds > 64:
                raise RuntimeError("rank search made no progress; are the keys unique?")
            if rounds > 1:
                pred = F.lit(False)
                for i, ranges in enumerate(live):
                    for rng in ranges:
                        pred = pred | _in_range(names[i], rng, types[i])
                narrowed = current.where(pred).persist(StorageLevel.MEMORY_AND_DISK)
                current, before, owned = narrowed, owned, narrowed
                _sample_cuts(current, names, types, live, fanout, seed + 1000 * rounds)
                if before is not None:
                    before.unpersist()
            else:
                _sample_cuts(current, names, types, live, fanout, seed)
            counts = _count_buckets(current, names, types, live)
            for i, ranges in enumerate(live):
                live[i] = _next_ranges(i, ranges, counts)
    finally:
        if owned is not None:
            owned.unpersist()
    return found


def _next_ranges(i: int, ranges: list[_Range], counts: dict[tuple[int, int], int]) -> list[_Range]:
    """The buckets that hold wanted ranks."""
    bounds = _bounds(ranges)
    out: list[_Range] = []
    for rng in ranges:
        first = bounds.index(rng.lo) + 1 if rng.lo is not None else 0
        last = bounds.index(rng.hi) if rng.hi is not None else len(bounds)
        ends = [bounds[first - 1] if first else None, *bounds[first:last + 1]]
        if rng.hi is None:
            ends = [ends[0], *bounds[first:], None]
        for rank, k in rng.wanted:
            before = 0
            for j in range(first, last + 1):
                c = counts.get((i, j), 0)
                if before + c >= k:
                    lo, hi = ends[j - first], ends[j - first + 1]
                    if out and (out[-1].lo, out[-1].hi) == (lo, hi):
                        out[-1].wanted.append((rank, k - before))
                    else:
                        out.append(_Range(lo, hi, c, [(rank, k - before)]))
                    break
                before += c
    return out


def kth_keys(keys: DataFrame, ranks: list[int], **kw) -> dict[int, tuple]:
    """Key tuples at the given 1-based ranks of a one-column frame ``key`` (struct)."""
    return search(keys.select("key"), lambda sizes: [list(ranks)], **kw)[1][0]


def bucket_of(order_cols: list[Column], cuts: list[tuple], key_type: T.StructType | None = None) -> Column:
    """1-based bucket of a row given boundary keys (null when the value is null)."""
    if not cuts:
        return F.lit(None).cast("int")
    key = _key_struct(order_cols)
    if key_type is None:
        raise ValueError("key_type is required")
    b = F.lit(1)
    for c in cuts:
        b = b + (key > _key_literal(c, key_type)).cast("int")
    return F.when(order_cols[0].isNull(), F.lit(None).cast("int")).otherwise(b)


def rank_buckets(df: DataFrame, order_cols: list[Column], q: int = 4, **kw) -> Column:
    """Column expression: ``pd.qcut(rank(method='first'), q, labels=1..q)`` exactly.

    Runs the boundary search eagerly (a few small jobs) and returns a pure
    expression with the ``q - 1`` boundary keys as literals.
    """
    return rank_buckets_many(df, [order_cols], q, **kw)[0]


def rank_buckets_kept(table: DataFrame, histogram: "KeyHistogram", q: int = 4) -> Column:
    """:func:`rank_buckets` of a stored table by the key columns of its histogram."""
    found = histogram.keys_at(table, lambda n: [(j * (n - 1)) // q + 1 for j in range(1, q)] if n else [])
    cols = [F.col(c) for c in histogram.cols]
    n = histogram.refresh(table)[2]
    return bucket_of(cols, [found[(j * (n - 1)) // q + 1] for j in range(1, q)] if n else [],
                     table.select(_key_struct(cols).alias("key")).schema["key"].dataType)


def rank_buckets_many(df: DataFrame, orderings: list[list[Column]], q: int = 4, **kw) -> list[Column]:
    """:func:`rank_buckets` for several orderings of the same frame, in one search."""
    structs = [_key_struct(cols) for cols in orderings]
    types = df.select(*[s.alias(f"key{i}") for i, s in enumerate(structs)]).schema
    keys = df.select(*[F.when(cols[0].isNotNull(), s).alias(f"key{i}")
                       for i, (s, cols) in enumerate(zip(structs, orderings))])

    def ranks(sizes: list[int]) -> list[list[int]]:
        return [[(j * (n - 1)) // q + 1 for j in range(1, q)] if n else [] for n in sizes]

    sizes, found = search(keys, ranks, **kw)
    return [bucket_of(cols, [f[r] for r in rs], types[f"key{i}"].dataType)
            for i, (cols, f, rs) in enumerate(zip(orderings, found, ranks(sizes)))]


def pct_ranks(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds pandas ``rank(pct=True)`` of each value under its name: average rank of ties / count of non-null values.

    No window spans the frame.  Equal values are counted first (map-side, so a
    value of a third of all rows is one row); the counts are dealt by ranges of
    the value and written once; a part's offset is the sum of the parts before
    it (one row a part), and the ranks, written too, join back on the value.  A null value
    has no rank.
    """
    names = list(values)
    df = df.select("*", *[(c.cast("double") + F.lit(0.0)).alias(f"__v{i}") for i, c in enumerate(values.values())])
    flat = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("which"), F.col(f"__v{i}").alias("v"))
                                        for i in range(len(names))])))
    counts = flat.where("v IS NOT NULL").groupBy("which", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = stored(counts.repartitionByRange("which", "v").withColumn("part", F.spark_partition_id()), "rank-counts")
    before = Window.partitionBy("which").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("which")
    offsets = (parts.groupBy("which", "part").agg(F.sum("n").alias("m"))
               .select("which", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"),
                       F.sum("m").over(whole).alias("all")))
    inside = Window.partitionBy("which", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.lit(1)
    ranks = stored(parts.join(F.broadcast(offsets), ["which", "part"])  # one row a part
                   .select("which", "v", ((first + (F.col("n") - F.lit(1)) / F.lit(2.0)) / F.col("all")).alias("pct")),
                   "ranks")
    for i, name in enumerate(names):
        one = ranks.where(F.col("which") == i).select(F.col("v").alias(f"__k{i}"), F.col("pct").alias(name))
        df = df.join(one, F.col(f"__v{i}") == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return df.drop(*[f"__v{i}" for i in range(len(names))])


# ---------------------------------------------------------------- stored histograms of keys

HISTOGRAM = "files array<string>, cuts string, counts string, n long"


class KeyHistogram:
    """Counts of a growing table's keys between fixed cuts, stored with the names of the files that they cover.

    Histograms with the same cuts merge by addition.  After files were added, only those are read to bring the counts up
    to date, and a wanted rank is then looked for among the rows between two cuts alone; the first column of the key
    bounds that read.  Cuts come from the first files; if later ones fill one bucket, the search inside it goes on by
    rounds, so the keys are exact whatever the growth.  Files may be added, not changed or removed.
    """

    def __init__(self, spark: SparkSession, path: str, order_cols: list[str], size: int = 256):
        self.spark, self.path, self.cols, self.size = spark, path, list(order_cols), size

    def _keys(self, df: DataFrame) -> DataFrame:
        return df.select(F.when(F.col(self.cols[0]).isNotNull(), _key_struct([F.col(c) for c in self.cols])).alias("key"))

    def _stored(self) -> tuple[list[str], list[tuple], dict[int, int], int] | None:
        if not path_exists(self.spark, f"{self.path}/_SUCCESS"):
            return None
        r = self.spark.read.schema(HISTOGRAM).json(self.path).first()
        return r["files"], json.loads(r["cuts"]), {int(k): v for k, v in json.loads(r["counts"]).items()}, r["n"]

    def refresh(self, table: DataFrame) -> tuple[list[tuple], dict[int, int], int, list[str]]:
        """(cuts, counts by bucket, rows, files that were read) of ``table``, a frame read from Parquet files."""
        kept = self._stored()
        files = sorted(table.inputFiles())
        known, cuts, counts, n = kept or ([], None, {}, 0)
        new = sorted(set(files) - set(known))
        if set(known) - set(files):
            raise ValueError("files that the histogram covers are gone")
        if new:
            # the reader of the whole table names the columns; partition columns are no part of a key
            part = self.spark.read.schema(table.select(*self.cols).schema).parquet(*new)
            keys = self._keys(part)
            more = keys.agg(F.count("key")).first()[0]
            types = [keys.schema["key"].dataType]
            if cuts is None:
                rng = _Range(None, None, max(1, more), [])
                _sample_cuts(keys, ["key"], types, [[rng]], self.size, 42)
                cuts = rng.cuts
            else:
                cuts = [_typed(c, types[0]) for c in cuts]
            got = _count_buckets(keys, ["key"], types, [[_Range(None, None, more, [], cuts)]]) if cuts else {(0, 0): more}
            for (_, b), c in got.items():
                counts[b] = counts.get(b, 0) + c
            n += more
            line = json.dumps({"files": files, "cuts": json.dumps(cuts, default=str), "counts": json.dumps(counts), "n": n})
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
        else:
            cuts = [_typed(c, self._keys(table).schema["key"].dataType) for c in cuts or []]
        return cuts, counts, n, new

    def keys_at(self, table: DataFrame, ranks: Callable[[int], list[int]]) -> dict[int, tuple]:
        """Rank -> key of ``table``'s rows with a first key column, in order of the key columns."""
        cuts, counts, n, _ = self.refresh(table)
        wanted = sorted({r for r in ranks(n) if 1 <= r <= n})
        if not wanted:
            return {}
        whole = _Range(None, None, n, [(r, r) for r in wanted], cuts)
        live = [_next_ranges(0, [whole], {(0, b): c for b, c in counts.items()})]
        first = self.cols[0]
        kind = table.schema[first].dataType
        near = F.lit(False)
        for rng in live[0]:  # plain bounds of the first column reach the scan
            at = F.col(first).isNotNull()
            if rng.lo is not None:
                at = at & (F.col(first) >= _plain(rng.lo[0], kind))
            if rng.hi is not None:
                at = at & (F.col(first) <= _plain(rng.hi[0], kind))
            near = near | at
        return _narrow(self._keys(table.where(near)), live)[0]


def _plain(v, kind: T.DataType) -> Column:
    return F.expr(_sql_value(v, kind))


def _typed(cut: list, key_type: T.StructType) -> tuple:
    """A cut read from JSON, in the types of its key."""
    out = []
    for v, f in zip(cut, key_type.fields):
        if v is not None and isinstance(f.dataType, T.DecimalType):
            v = Decimal(str(v))
        elif v is not None and isinstance(f.dataType, T.DateType) and isinstance(v, str):
            v = dt.date.fromisoformat(v)
        out.append(v)
    return tuple(out)
