"""Benchmark decontamination with a distributed positional inverted index.

1. ``benchmark_windows``: the benchmark's 10-word windows as term sequences (a shorter item is one window).
2. ``build_index``: every shard (a few megabytes of whole documents) stores the sorted positions of each benchmark
   term's occurrences, Parquet in the shared folder, one row a shard.
3. Collection frequencies of the terms come from the stored postings.
4. ``search``: per shard, each window starts from the postings of its rarest term, shifts them by the term's offset
   and intersects with the next rarest term's postings, and so on.  A posting up to ``slop`` words off keeps a
   candidate alive as a proximity match; a phrase match has every term in place.

The index is document-partitioned: a hot term, source or group of copies is spread like its documents, and no list
of a term is ever gathered in one task.  Windows go to the tasks in blocks of ``BLOCK_WINDOWS``, one pass over the
stored index for each; vocabulary and frequencies are broadcast up to ``BROADCAST_TERMS`` terms (a larger benchmark
indexes every term, and each block brings only its own frequencies).

Defined cases: null text = no words; a document or item without words matches nothing; repeated document rows are
judged one by one; items with equal text each count, a repeated item id counts once, null item ids cannot be named
and are left out; empty tables give empty or all-clean results.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import (Texts, covered, doc_key, expand, free_names, i64, runs, small_batches, stored,
                                  text_chunks, word_hashes, words)

WINDOW, SLOP = 10, 2
SHARD_BYTES = 2 << 20
BLOCK_WINDOWS = 50_000      # at most 50,000 x 10 terms of 8 bytes at a time
BROADCAST_TERMS = 1_000_000  # 8 MB

# words are runs of [0-9a-z] (after lower-casing A-Z) and of bytes of non-ASCII characters
GAP = np.ones(256, dtype=bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:256] = False

INDEX_SCHEMA = ("doc_id binary, no_id binary, row binary, n_words binary, base binary, terms binary, bounds binary, "
                "positions binary")
MATCH_SCHEMA = ("shard long, doc long, doc_id long, row long, n_words long, items array<string>, lo array<long>, "
                "hi array<long>, exact array<boolean>")
SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "n_near_items long")
ROW_SCHEMA = SCHEMA + ", row long"


def terms_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(t, GAP)
    return i64(word_hashes(t, starts, ends, lower=True)), first


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """(terms array<long>, items array<string>): every distinct window with the items that hold it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(0).to_pylist()
            for t in text_chunks(b.column(1)):
                h, first = terms_of(t)
                out_i, out_w = [], []
                for i in range(len(t)):
                    w = h[first[i]:first[i + 1]]
                    for s in range(max(1, len(w) - window + 1) if len(w) else 0):
                        out_i.append(items[t.rows.start + i])
                        out_w.append(w[s:s + window])
                yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.list_(pa.int64())),
                                                  pa.array(out_i, pa.string())], names=["terms", "item"])
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"),
                            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .where("item is not null")
    return rows.mapInArrow(cut, "terms array<long>, item string").dropDuplicates()


def build_index(docs: DataFrame, vocabulary: np.ndarray | None, gap: int) -> DataFrame:
    """One row a shard.  Positions count words, with ``gap`` free numbers between documents."""
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_chunks(b.column(1), SHARD_BYTES):
                h, first = terms_of(t)
                n = len(t)
                ids = b.column(0).slice(t.rows.start, n)
                no_id = ids.is_null().to_numpy(zero_copy_only=False)
                base = first[:-1] + gap * np.arange(n)
                pos = np.arange(len(h)) + gap * np.repeat(np.arange(n), np.diff(first))
                if known is not None:
                    vocab = known.value
                    at = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0))
                    hit = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
                    h, pos = h[hit], pos[hit]
                order = np.argsort(h, kind="stable")
                h, pos = h[order], pos[order]
                cut = runs(h)
                row = [ids.fill_null(0).to_numpy().astype(np.int64), no_id,
                       b.column(2).slice(t.rows.start, n).to_numpy(), np.diff(first).astype(np.int64),
                       base.astype(np.int64), h[cut[:-1]], cut.astype(np.int64), pos.astype(np.int64)]
                if len(pos) == 0 or pos[-1] < 1 << 31 and pos.max() < 1 << 31:
                    row[-1] = row[-1].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row],
                                                 names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    return stored(docs.mapInArrow(index, INDEX_SCHEMA), "postings")


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n): occurrences of each indexed term in the whole collection."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, bounds in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)),
                                                  pa.array(np.diff(np.frombuffer(bounds, np.int64)))],
                                                 names=["term", "n"])
    return index.select("terms", "bounds").mapInArrow(count, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n"))


def intersect(windows: np.ndarray, size: np.ndarray, rank: np.ndarray, terms: np.ndarray, bounds: np.ndarray,
              lists: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact) of the matches in one shard.

    ``windows`` holds the terms of all windows back to back, ``size`` their lengths, ``rank`` the collection
    frequency of each of these terms; ``terms``, ``bounds``, ``lists`` are the shard's postings.
    """
    none = np.empty(0, np.int64)
    if len(terms) == 0 or len(size) == 0:
        return none, none, none.astype(bool)
    at = np.minimum(np.searchsorted(terms, windows), len(terms) - 1)
    owner = np.repeat(np.arange(len(size)), size)
    whole = np.ones(len(size), bool)
    whole[owner[terms[at] != windows]] = False
    most = int(size.max())
    span = int(lists.max()) + most + 2 * slop + 2
    key = np.repeat(np.arange(len(terms)), np.diff(bounds)) * span + lists + slop + most  # all postings, one sorted array
    by = np.lexsort((rank, owner))  # each window's terms, rarest first
    begin = np.cumsum(size) - size
    order = np.full((len(size), most), -1, np.int64)
    off = np.zeros((len(size), most), np.int64)
    col = np.arange(len(windows)) - begin[owner]
    order[owner, col] = at[by]
    off[owner, col] = by - begin[owner]
    live = np.flatnonzero(whole)
    t0 = order[live, 0]
    cand, who = expand(bounds[t0], bounds[t0 + 1] - bounds[t0])
    who = live[who]
    start = lists[cand].astype(np.int64) - off[who, 0]
    exact = np.ones(len(who), bool)
    for c in range(1, most):
        need = order[who, c] >= 0
        if not need.any():
            break
        w = who[need]
        want = order[w, c] * span + start[need] + off[w, c] + slop + most
        j = np.searchsorted(key, want)
        near = np.minimum(np.abs(key[np.minimum(j, len(key) - 1)] - want), np.abs(want - key[np.maximum(j - 1, 0)]))
        keep = np.ones(len(who), bool)
        keep[need] = near <= slop
        exact[need] &= near == 0
        who, start, exact = who[keep], start[keep], exact[keep]
    return who, start, exact


def search(index: DataFrame, windows: list[list[int]], items: list[list[str]], rank: dict[int, int],
           slop: int) -> DataFrame:
    """One row for every document: its matches of one block of windows (lo:hi in words of the document)."""
    flat = np.array([x for w in windows for x in w], np.int64)
    size = np.array([len(w) for w in windows], np.int64)
    block = index.sparkSession.sparkContext.broadcast(
        (flat, size, np.array([rank.get(int(x), 0) for x in flat], np.int64), items))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, size, freq, items = block.value
        for b in batches:
            for r in range(b.num_rows):
                raw = [memoryview(c[r].as_buffer()) for c in b.columns[1:]]
                name, no_id, row, count, base, terms, bounds = (
                    np.frombuffer(x, t) for x, t in zip(raw, (np.int64, bool) + (np.int64,) * 5))
                total = int(bounds[-1])
                lists = np.frombuffer(raw[7], np.int32 if len(raw[7]) == 4 * total else np.int64)
                who, start, exact = intersect(flat, size, freq, terms, bounds, lists, slop)
                doc = np.searchsorted(base, start, side="right") - 1
                # a match before the first document or over a document's end is a proximity match at most
                inside = doc >= 0
                who, start, exact, doc = who[inside], start[inside], exact[inside], doc[inside]
                lo = start - base[doc]
                hi = lo + size[who]
                exact = exact & (hi <= count[doc])
                by = np.argsort(doc, kind="stable")
                who, lo, hi, exact, doc = who[by], lo[by], hi[by], exact[by], doc[by]
                many = np.array([len(items[k]) for k in who], np.int64)
                offs = np.append(0, np.cumsum(np.bincount(doc, weights=many, minlength=len(name)))).astype(np.int32)
                each = np.repeat(np.arange(len(who)), many)
                lists_of = [pa.array([i for k in who for i in items[k]], pa.string()), pa.array(lo[each], pa.int64()),
                            pa.array(hi[each], pa.int64()), pa.array(exact[each], pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(name), b.column(0)[r].as_py())), pa.array(np.arange(len(name))),
                     pa.array(name, pa.int64(), mask=no_id), pa.array(row), pa.array(count)]
                    + [pa.ListArray.from_arrays(pa.array(offs), x) for x in lists_of],
                    names=["shard", "doc", "doc_id", "row", "n_words", "items", "lo", "hi", "exact"])

    return index.select(F.xxhash64("doc_id", "positions", "base").alias("shard"), "*").mapInArrow(match, MATCH_SCHEMA)


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {c: [] for c in ("n_hit", "n_items", "items_sha256", "n_near_items")}
        for n, items, lo, hi, exact in zip(*(b.column(k).to_pylist() for k in range(2, 7))):
            found = sorted({x for x, e in zip(items, exact) if e})
            hit = 0
            if found:
                e = np.array(exact)
                hit = int(covered(n, np.array(lo)[e], np.array(hi)[e]).sum())
            out["n_hit"].append(hit)
            out["n_items"].append(len(found))
            out["items_sha256"].append(hashlib.sha256(",".join(found).encode()).hexdigest())
            out["n_near_items"].append(len(set(items) - set(found)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(out["n_hit"], pa.int64()), pa.array(out["n_items"], pa.int64()),
             pa.array(out["items_sha256"], pa.string()), pa.array([h > 0 for h in out["n_hit"]], pa.bool_()),
             pa.array(out["n_near_items"], pa.int64()), b.column(1)],
            names=[c.split()[0] for c in ROW_SCHEMA.split(", ")])


def row_of(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return doc_key(docs[id_col].cast("long"), docs[text_col].cast("string"))


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
           slop: int = SLOP) -> DataFrame:
    """One row per document: n_words, n_hit (words inside a benchmark window), n_items and items_sha256 (items with
    a window here), contaminated, and n_near_items (items with a proximity match but no phrase match) and row."""
    small_batches(docs.sparkSession)
    grams = stored(benchmark_windows(benchmark, item_col, item_text_col, window)
                   .groupBy("terms").agg(F.sort_array(F.collect_list("item")).alias("items")), "windows")
    words_used = grams.select(F.explode("terms").alias("term")).distinct()
    vocabulary = None
    if words_used.count() <= BROADCAST_TERMS:
        vocabulary = np.sort(np.array([r.term for r in words_used.toLocalIterator()], np.int64))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       row_of(docs, id_col, text_col).alias("row"))
    index = build_index(rows, vocabulary, window + 2 * slop + 2)
    counts = stored(frequencies(index), "frequency")
    found = None
    for block in blocks(grams):
        terms = sorted({x for w, _ in block for x in w})
        one = counts.sparkSession.createDataFrame([(x,) for x in terms], "term long")
        rank = {r.term: r.n for r in counts.join(F.broadcast(one), "term", "left_semi").toLocalIterator()}
        part = search(index, [w for w, _ in block], [i for _, i in block], rank, slop)
        found = part if found is None else found.unionByName(part)
        several = found is not part
    if found is None:
        found, several = search(index, [], [], {}, slop), False
    if several:
        found = found.groupBy("shard", "doc", "doc_id", "row", "n_words").agg(
            *(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "lo", "hi", "exact")))
    return found.select("doc_id", "row", "n_words", "items", "lo", "hi", "exact").mapInArrow(summarise, ROW_SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``judged`` without the row."""
    return judged(docs, benchmark, **kw).drop("row")


def blocks(grams: DataFrame) -> Iterator[list[tuple[list[int], list[str]]]]:
    block: list = []
    for r in grams.toLocalIterator():
        block.append((list(r.terms), list(r["items"])))
        if len(block) == BLOCK_WINDOWS:
            yield block
            block = []
    if block:
        yield block


def clean_documents(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents without any benchmark window, with all their columns.  A row is known by id and text, so rows
    that share an id, or have none, are judged apart."""
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    i, r = free_names(docs, "__bad", "__row")
    bad = judged(docs, benchmark, **kw).where("contaminated").select(
        F.col("doc_id").alias(i), F.col("row").alias(r)).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(F.col(i))
                     & (row_of(docs, id_col, text_col) == F.col(r)), "left_anti")
