"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least 2q long, that no neighbouring word extends.
Let T be the words of a document and tau = 1, 2, 4, ... the scales; scale tau answers for the periods from 3 tau - 1 to
6 tau - 2, so that every period from 2 on has one scale (period 1 is read off equal neighbours).

* **Synchronising set.**  Q holds the positions whose window T[i, i + tau) has a period of tau / 3 or less.  Every other
  position gets the hash of its window; i is chosen if the least hash over [i, i + tau], without Q, stands at i or at
  i + tau.  The choice depends on T[i, i + 2 tau) alone, and each window of tau positions holds a chosen one unless the
  text around it is highly periodic.  A run of period p therefore has chosen i and i + p with equal contexts
  T[i, i + 2 tau).
* **Proposals.**  Chosen positions are sorted by context; pairs of equal contexts at a distance p of the scale propose
  period p.  Chosen positions with equal contexts are more than tau / 3 apart, so a position has at most
  9 partners in that range: no pair is left out, and there is no cap.
* **Highly periodic regions.**  Q comes from the runs of the smaller scales.  Where the first part of a run lies in such
  a region of period q, the run is centred on the seam of two adjacent regions with the same root.  Every distance that
  brings their roots into line is proposed, one for each q words.
* **Extension.**  Proposals that touch are merged and extended on both sides by dyadic hashes, then compared word by
  word, and kept with the smallest period of their stretch.

Plan: one narrow pass, nothing is shuffled; a task takes documents in runs of about 2 MB.  Memory follows the longest
document: about 8 bytes a word for each scale.

Defined cases: a null text has no words; an empty text has none either; rows that repeat a document are judged one by
one; an empty table gives no rows; other columns, whatever their names, are not read; a document without id keeps a
null id.  Very long texts are read whole.  Of runs of equal length the leftmost, then the one of smallest period, is the
longest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storelens.llm.common import Texts, covered, documents_of, expand, mix, small_batches, text_chunks, word_hashes, words

LEAST = 12
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
           "n_words", "n_kept"]
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

Rewrite = Callable[[int | None, int], np.ndarray | None]


def planted_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers that replace those of a document, for one in ten of them (by checksum of the id); else None."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


class Dyadic:
    """Hashes of all windows of 1, 2, 4, ... words; ``level(k)[i]`` is that of T[i, i + 2**k)."""

    def __init__(self, t: np.ndarray, longest: int):
        self.levels, self.longest = [t], longest

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            h, half = self.levels[-1], 1 << (len(self.levels) - 1)
            right = np.zeros_like(h)
            right[:-half] = h[half:] if half < len(h) else 0
            self.levels.append(mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(right + np.uint64(len(self.levels)))))
        return self.levels[k]

    def extend(self, i: np.ndarray, j: np.ndarray, left: bool) -> np.ndarray:
        """How far the words from i and j on (``left``: the words before them) agree."""
        n = len(self.levels[0])
        total = np.zeros(len(i), np.int64)
        top = max(0, min(n, self.longest).bit_length() - 1)
        room = np.minimum(i, j) if left else n - np.maximum(i, j)
        for k in range(top, -1, -1):
            step = 1 << k
            if not (room >= step).any():
                continue
            h = self.level(k)
            ok = np.flatnonzero(room - total >= step)
            shift = -(total[ok] + step) if left else total[ok]
            same = h[i[ok] + shift] == h[j[ok] + shift]
            total[ok[same]] += step
        return total


def window_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of x over [i, i + size), size a power of two; windows are cut off at the end."""
    out, w = x, 1
    while w < size:
        nxt = out.copy()
        if w < len(out):
            np.minimum(out[:-w], out[w:], out=nxt[:-w])
        out, w = nxt, 2 * w
    return out


def synchronising(h: np.ndarray, tau: int, periodic: np.ndarray) -> np.ndarray:
    """Positions chosen at scale tau; ``h``: hashes of the windows of tau words, ``periodic``: the mask Q."""
    ids = np.where(periodic, TOP, h)
    least = window_least(ids, tau)
    far = np.full(len(ids), TOP)
    far[:-tau] = ids[tau:]
    low = np.minimum(least, far)
    return np.flatnonzero((low != TOP) & ((low == ids) | (low == far)))


class Runs:
    """Maximal repetitions found so far: start, end, period."""

    def __init__(self, t: np.ndarray):
        self.t = t
        self.lo, self.hi, self.p = (np.empty(0, np.int64) for _ in range(3))

    def add(self, lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> None:
        """Keeps the stretches that are at least two periods long and not known; a stretch has its smallest period."""
        ok = hi - lo >= 2 * p
        lo, hi, p = lo[ok], hi[ok], p[ok]
        if not len(lo):
            return
        order = np.lexsort((p, hi, lo))
        lo, hi, p = lo[order], hi[order], p[order]
        first = np.ones(len(lo), bool)
        first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        lo, hi, p = lo[first], hi[first], p[first]
        width = len(self.t) + 1
        new = ~np.isin(lo * width + hi, self.lo * width + self.hi)
        self.lo, self.hi, self.p = (np.concatenate(x) for x in (
            (self.lo, lo[new]), (self.hi, hi[new]), (self.p, p[new])))


def equal_stretches(t: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [lo, hi) in which words p apart are identical."""
    same = np.zeros(max(0, len(t) - p) + 2, np.int8)
    if len(t) > p:
        same[1:-1] = t[p:] == t[:-p]
    d = np.diff(same)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) + p


def context_pairs(at: np.ndarray, context: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of chosen positions with equal contexts, 3 tau - 1 to 6 tau - 2 apart."""
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    same = context[1:] == context[:-1]
    many = np.zeros(len(at), bool)
    many[1:] |= same
    many[:-1] |= same
    at, context = at[many], context[many]
    out_i, out_p = [], []
    for k in range(1, 19):  # 6 tau holds at most 18 of them
        if len(at) <= k:
            break
        gap = at[k:] - at[:-k]
        near = (context[k:] == context[:-k]) & (gap <= 6 * tau - 2)
        if not near.any():
            break
        take = np.flatnonzero(near & (gap >= 3 * tau - 1))
        out_i.append(at[take])
        out_p.append(gap[take])
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_p)


def seam_pairs(runs: Runs, h0: Dyadic, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) proposals at the seams of adjacent regions of one small period with the same root."""
    big = (3 * runs.p <= tau) & (runs.hi - runs.lo >= 3 * tau - 1)
    lo, hi, q = runs.lo[big], runs.hi[big], runs.p[big]
    order = np.lexsort((lo, q))
    lo, hi, q = lo[order], hi[order], q[order]
    if len(lo) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero((q[1:] == q[:-1]) & (lo[1:] <= hi[:-1]))
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b1, e1, b2, e2, q = lo[at], hi[at], lo[at + 1], hi[at + 1], q[at]
    # rotation that brings the roots into line
    start, owner = expand(b2, q)
    same = h0.extend(b1[owner], start, left=False) >= q[owner]
    shift = np.full(len(at), -1)
    hits = np.flatnonzero(same)[::-1]
    shift[owner[hits]] = start[hits] - b1[owner[hits]]
    ok = shift >= 0
    b1, e1, b2, e2, q, shift = b1[ok], e1[ok], b2[ok], e2[ok], q[ok], shift[ok]
    low = 3 * tau - 1
    high = np.minimum(6 * tau - 2, np.minimum(e1 - b1, e2 - b2))
    first = low + (shift - low) % q
    n = np.maximum(0, (high - first) // q + 1)
    k, owner = expand(np.zeros(len(n), np.int64), n)
    p = first[owner] + k * q[owner]
    return np.maximum(b1[owner], b2[owner] - p), p


def find_runs(t: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of ``t`` (64-bit word values; values that stand once part the documents), with
    periods of at most half of ``longest``, the words of the longest document."""
    found = Runs(t)
    h = Dyadic(t, longest)
    n = len(t)
    for p in range(1, min(5, longest // 2 + 1)):  # scale 1 chooses every position; so do its contexts
        lo, hi = equal_stretches(t, p)
        found.add(lo, hi, np.full(len(lo), p))
    tau, k = 2, 1
    while 2 * (3 * tau - 1) <= longest:
        small = (3 * found.p <= tau) & (found.hi - found.lo >= tau)
        periodic = covered(n, found.lo[small], found.hi[small] - tau + 1)
        at = synchronising(h.level(k), tau, periodic)
        i, p = context_pairs(at, h.level(k + 1)[at], tau)
        si, sp = seam_pairs(found, h, tau)
        if len(i):  # proposals of one period whose contexts touch are one
            order = np.lexsort((i, p))
            i, p = i[order], p[order]
            new = np.ones(len(i), bool)
            new[1:] = (p[1:] != p[:-1]) | (i[1:] > i[:-1] + 2 * tau)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(i)) - 1
            i, end, p = i[first], i[last], p[first]
        else:
            end = i
        i, end, p = np.concatenate([i, si]), np.concatenate([end, si]), np.concatenate([p, sp])
        if len(i):
            lo = i - h.extend(i, i + p, left=True)
            hi = end + p + h.extend(end, end + p, left=False)
            ok = hi - lo >= 2 * p
            lo, hi, p = lo[ok], hi[ok], p[ok]
            lo, hi, p = np.unique(np.stack([lo, hi, p]), axis=1) if len(lo) else (lo, hi, p)
            word, owner = expand(lo, hi - lo - p)
            differs = np.bincount(owner[t[word] != t[word + p[owner]]], minlength=len(lo)) > 0
            found.add(lo[~differs], hi[~differs], p[~differs])
        tau, k = 2 * tau, k + 1
    return found.lo, found.hi, found.p


def chunk_runs(t: Texts, ids: list, rewrite: Rewrite | None, least: int):
    """For each document: its words' numbers (None: as they stand), and its runs sorted by start, then period."""
    starts, ends, first = words(t)
    value = word_hashes(t, starts, ends)
    n_docs, counts = len(t), np.diff(first)
    moved = [rewrite(ids[i], int(counts[i])) if rewrite and counts[i] else None for i in range(n_docs)]
    # a value of its own after each document keeps windows and matches inside
    seq = np.empty(len(value) + n_docs, np.uint64)
    base = first[:-1] + np.arange(n_docs)
    part = np.zeros(len(seq), bool)
    part[base + counts] = True
    seq[~part] = value
    seq[part] = mix(np.arange(n_docs, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    for i, m in enumerate(moved):
        if m is not None:
            seq[base[i]:base[i] + counts[i]] = value[first[i]:first[i + 1]][m]
    lo, hi, p = find_runs(seq, int(counts.max(initial=0)))
    keep = hi - lo >= np.maximum(least, 2 * p)
    lo, hi, p = lo[keep], hi[keep], p[keep]
    order = np.lexsort((p, lo))
    lo, hi, p = lo[order], hi[order], p[order]
    doc = np.searchsorted(base, lo, side="right") - 1
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    for i in range(n_docs):
        s = slice(cut[i], cut[i + 1])
        yield moved[i], int(counts[i]), lo[s] - base[i], hi[s] - base[i], p[s]


def run_batches(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None, least: int, with_text: bool,
                with_runs: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.column(0).to_pylist()
        for t in text_chunks(b.column(1)):
            rows = []
            ids = names[t.rows]
            for i, (moved, n, lo, hi, p) in enumerate(chunk_runs(t, ids, rewrite, least)):
                w = t.raw(i).split()
                if moved is not None:
                    w = [w[k] for k in moved.tolist()]
                listed = list(zip(lo.tolist(), (hi - lo).tolist(), p.tolist()))
                if listed:
                    gone = covered(n, lo + p, hi)
                    kept = [w[k] for k in np.flatnonzero(~gone).tolist()]
                    s, length, period = max(listed, key=lambda r: (r[1], -r[0], -r[2]))
                    best = (s, length, period, 1000 * length // period)
                else:
                    kept, best = w, (None,) * 4
                text = b" ".join(kept)
                rows.append((ids[i], len(listed), *best,
                             hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in listed).encode()).hexdigest(),
                             hashlib.sha256(text).hexdigest(), n, len(kept),
                             *([[dict(zip(("start", "length", "period"), r)) for r in listed]] if with_runs else []),
                             *([text.decode()] if with_text else [])))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2
            kinds += [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))] * with_runs
            kinds += [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=[str(i) for i in range(len(kinds))])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  rewrite: Rewrite | None = None, with_text: bool = False, with_runs: bool = True) -> DataFrame:
    """One row per document: doc_id, n_runs; start, length, period and exponent_milli of its longest run; runs_sha256,
    collapsed_sha256, n_words, n_kept; ``with_runs``: all its runs; ``with_text``: the text without the words after the
    first period of a run.

    ``least``: words that a run must have (two periods at least in any case).  ``rewrite(doc_id, n)``: word numbers that
    stand in place of 0 ... n - 1, or None.
    """
    small_batches(docs.sparkSession)
    kinds = dict(zip(COLUMNS, ["long"] * 6 + ["string"] * 2 + ["long"] * 2))
    if with_runs:
        kinds["runs"] = "array<struct<start: long, length: long, period: long>>"
    if with_text:
        kinds["collapsed_text"] = "string"
    return documents_of(docs, id_col, text_col).mapInArrow(
        lambda it: (r.rename_columns(list(kinds)) for r in run_batches(it, rewrite, least, with_text, with_runs)),
        ", ".join(f"{c} {k}" for c, k in kinds.items()))
