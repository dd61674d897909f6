"""Sequence packing as vector bin packing (dot-product heuristic).

A document becomes token ids plus one closing id.  Whole sequences are cut off
first; what remains of each document is an item with a demand vector (tokens,
segments, loss-bearing tokens).  A sequence is filled by repeatedly placing the
item whose demand has the largest dot product with the room that is left.  When
no item fits but token room is left, the largest item is cut so that the
sequence ends full.  A sequence that the other two limits close early, and the
last one of a block, are split at powers of two, so that nothing is padded.

Packing never shuffles: every task packs its own documents, block by block
(``block_tokens``), which bounds memory; sequence ids hold the task's partition.

Defined cases: null text = empty; an empty text is the closing id alone; rows
that repeat a document are packed once each; an empty table gives no rows.
Extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from storelens.llm.common import (SPACE, Texts, documents_of, expand, release, small_batches, text_chunks,
                                  word_hashes, words)

SEQUENCE, SEGMENTS, END_ID = 2048, 256, 1
BLOCK_TOKENS = 1 << 20
SLOT_BITS, WIDE = 19, 8  # 13 MB, held by every worker
ENCODED_BYTES = 1 << 20
SEPARATOR = "<|endoftext|>"
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long")


def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as one printable character: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(rest)}}


# byte classes: 0 white space, 1 letters a-z, 2 punctuation but the apostrophe, 3 anything else
CLASS = np.full(256, 3, np.uint8)
CLASS[SPACE] = 0
CLASS[65:91] = CLASS[97:123] = 1
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum() and b != 39]
CLASS[PUNCTUATION] = 2
PROBES = ["a", "word", "Word", "enschlich", "\u00e9t\u00e9", "Stra\u00dfe", "\u00c9COLE", "na\u0131ve", "\u65e5\u672c", "zzzzqqqqxxxx"]


class WordIds:
    """Ids of texts, part by part.

    The pre-tokenizer never joins text across white space, so the ids of a text are those of its words in order.  If
    probes show that it also cuts between ASCII letters and punctuation, and that it ignores case, parts are cut there
    and hashed in lower case: then a word, its capitalised form and the word before a comma are one part.

    Parts met are kept in a table of fixed size, a slot for each value of the low bits of the part's 64-bit hash: the
    hash, the number of ids and up to ``WIDE`` ids in place (25 bytes a slot with a vocabulary of 65,536 or less).  A
    later part of the same slot takes its place, so the table never grows, frequent parts come back at once and longer
    parts are encoded anew.
    """

    def __init__(self, path: str, bits: int = SLOT_BITS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.sep = self.tokenizer.token_to_id(SEPARATOR)
        self.letters = byte_letters()
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.size = np.zeros(1 << bits, np.uint8)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.ids = np.zeros((1 << bits, WIDE), np.uint16 if small else np.uint32)
        plain = self._plain
        same = all(plain(f"{x}{chr(p) * k}{y}") == plain(x) + plain(chr(p) * k) + plain(y)
                   for p in PUNCTUATION for x, y, k in (("ab", "cd", 1), ("b", "rs", 3), ("I", "ll", 1)))
        blind = all(plain(chr(65 + k) + "xY") == plain(chr(97 + k) + "xy") for k in range(26))
        self.by_class = same and blind
        self.direct = all(self._direct(w) == plain(w) for w in PROBES) if self.by_class else False

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self, word: str) -> list[int] | None:
        """Ids of a word of letters alone, which is one piece: normalised, written byte by byte, merged.  None if the
        normalised word holds anything but letters."""
        if word.isascii():
            word = word.lower()
        else:
            norm = self.tokenizer.normalizer
            word = norm.normalize_str(word) if norm is not None else word
            if not word.isalpha():
                return None
            word = word.encode().decode("latin-1").translate(self.letters)
        return [x.id for x in self.model.tokenize(word)]

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, number of ids of each)."""
        found: list[list[int] | None] = [None] * len(parts)
        rest: list[int] = []
        for k, raw in enumerate(parts):
            word = raw.decode()
            if self.direct and word.isalpha():
                found[k] = self._direct(word)
            if found[k] is not None:
                continue
            if self.sep is None or b"<|" in raw:
                found[k] = self._plain(word)
            else:
                rest.append(k)
        for at in range(0, len(rest), 2000):
            some = rest[at:at + 2000]
            text = f" {SEPARATOR} ".join(parts[k].decode() for k in some)
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(got == self.sep)
            for k, a, b in zip(some, np.append(0, cut + 1).tolist(), np.append(cut, len(got)).tolist()):
                found[k] = got[a:b].tolist()
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def parts(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``words``, of the parts that are encoded by themselves."""
        if not self.by_class or b"<|" in t.data.tobytes():  # the vocabulary's special tokens hold punctuation
            return words(t)
        kind = CLASS[t.data]
        starts, ends, first = words(t)
        turn = np.flatnonzero(kind[1:] + kind[:-1] * 4 == 6) + 1, np.flatnonzero(kind[1:] + kind[:-1] * 4 == 9) + 1
        at = np.sort(np.concatenate(turn))
        docs = t.offs[1:-1]
        at = at[~np.isin(at, docs)]  # documents lie side by side
        starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
        return starts, ends, np.searchsorted(starts, t.offs)

    def texts(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row as little-endian uint32, offsets of the documents in it)."""
        starts, ends, first = self.parts(t)
        h = word_hashes(t, starts, ends, lower=self.by_class)
        slot = (h & self.mask).astype(np.int64)
        hit = (self.key[slot] == h) & (self.size[slot] > 0)
        known, new = np.flatnonzero(hit), np.flatnonzero(~hit)
        uniq, at, inverse = np.unique(h[new], return_index=True, return_inverse=True)
        raw = t.data.tobytes()
        flat, sizes = self._encode([raw[a:b] for a, b in zip(starts[new[at]].tolist(), ends[new[at]].tolist())])
        begin = np.cumsum(sizes) - sizes
        count = np.empty(len(h), np.int64)
        count[known] = self.size[slot[known]]
        count[new] = sizes[inverse]
        offs = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offs[-1], "<u4")
        inside = np.arange(WIDE) < count[known, None]
        out[expand(offs[known], count[known])[0]] = self.ids[slot[known]][inside]
        out[expand(offs[new], count[new])[0]] = flat[expand(begin[inverse], sizes[inverse])[0]]
        short = np.flatnonzero((sizes > 0) & (sizes <= WIDE))
        rows = np.zeros((len(short), WIDE), self.ids.dtype)
        inside = np.arange(WIDE) < sizes[short, None]
        rows[inside] = flat[expand(begin[short], sizes[short])[0]]
        to = (uniq[short] & self.mask).astype(np.int64)
        last = len(to) - 1 - np.unique(to[::-1], return_index=True)[1]  # one word a slot
        to, short, rows = to[last], short[last], rows[last]
        self.key[to], self.size[to], self.ids[to] = uniq[short], sizes[short], rows
        return out, offs[first]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Items:
    """Open items by demand class (tokens, loss tokens); the items of a class are interchangeable."""

    def __init__(self, weights: tuple[float, float, float], limits: tuple[int, int, int]):
        self.limits, self.weights = limits, weights
        self.by: dict[tuple[int, int], int] = {}
        self.stacks: list[list] = []
        self.tokens = np.zeros(64, np.int64)
        self.loss = np.zeros(64, np.int64)
        self.open = np.zeros(64, bool)
        self.left = 0

    def add(self, doc: int, start: int, tokens: int, loss: int) -> None:
        k = self.by.setdefault((tokens, loss), len(self.stacks))
        if k == len(self.stacks):
            if k == len(self.tokens):
                self.tokens, self.loss, self.open = (np.concatenate([a, np.zeros_like(a)])
                                                     for a in (self.tokens, self.loss, self.open))
            self.stacks.append([])
            self.tokens[k], self.loss[k] = tokens, loss
        self.stacks[k].append((doc, start))
        self.open[k] = True
        self.left += 1

    def take(self, k: int) -> tuple[int, int, int, int]:
        doc, start = self.stacks[k].pop()
        self.open[k] = bool(self.stacks[k])
        self.left -= 1
        return doc, start, int(self.tokens[k]), int(self.loss[k])

    def best(self, room: tuple[int, int, int]) -> int:
        """Class with the largest dot product of demand and room, both as shares of the limits; -1: none fits."""
        k = len(self.stacks)
        fits = self.open[:k] & (self.tokens[:k] <= room[0]) & (self.loss[:k] <= room[2])
        if room[1] < 1 or not fits.any():
            return -1
        (wt, ws, wl), (lt, ls, ll) = self.weights, self.limits
        score = (wt * room[0] / lt / lt) * self.tokens[:k] + ws * room[1] / ls / ls
        if ll:
            score = score + (wl * room[2] / ll / ll) * self.loss[:k]
        return int(np.argmax(np.where(fits, score, -1.0)))

    def largest(self) -> int:
        k = len(self.stacks)
        return int(np.argmax(np.where(self.open[:k], self.tokens[:k], -1)))


def pack(items: Items) -> Iterator[list[tuple[int, int, int, int]]]:
    """Sequences of (doc, start, tokens, loss tokens).  A document's loss-bearing tokens are its last ones, so a
    piece cut from the front of an item bears loss only beyond the part that bears none."""
    limits = items.limits
    while items.left:
        room, seq = limits, []
        while items.left:
            k = items.best(room)
            if k < 0:
                break
            piece = items.take(k)
            seq.append(piece)
            room = (room[0] - piece[2], room[1] - 1, room[2] - piece[3])
        if room[0] and room[1] and items.left:
            doc, start, tokens, loss = items.take(items.largest())
            free = tokens - loss
            n = min(tokens, room[0], free + room[2])
            if n:
                cut = max(0, n - free)
                seq.append((doc, start, n, cut))
                room = (room[0] - n, room[1] - 1, room[2] - cut)
            if n < tokens:
                items.add(doc, start + n, tokens - n, loss - max(0, n - free))
        if room[0] == 0:
            yield seq
        else:
            yield from at_powers_of_two(seq, limits[0] - room[0])


def at_powers_of_two(seq: list[tuple[int, int, int, int]], total: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """The pieces of a sequence that isn't full, as sequences whose lengths are powers of two."""
    queue, at = list(seq), 0
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            doc, start, tokens, loss = queue[at]
            n = min(tokens, size)
            cut = max(0, n - (tokens - loss))
            out.append((doc, start, n, cut))
            size -= n
            if n == tokens:
                at += 1
            else:
                queue[at] = (doc, start + n, tokens - n, loss - cut)
        yield out


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, limits: tuple[int, int, int],
                 weights: tuple[float, float, float], with_loss: bool) -> Iterator[pa.RecordBatch]:
    enc = word_ids(path)
    end = np.array([END_ID], "<u4").tobytes()
    sequence = TaskContext.get().partitionId() << 36
    size = limits[0]
    out: list[tuple] = []
    ids: list[bytes] = []
    names: list = []
    items = Items(weights, limits)
    held = 0

    def emit(seq) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, n, loss in seq:
            raw = ids[doc]
            out.append((names[doc], start, n, zlib.crc32(memoryview(raw)[4 * start:4 * (start + n)]),
                        len(raw) // 4, sequence, offset, loss))
            offset += n
        sequence += 1

    def flush() -> pa.RecordBatch | None:
        nonlocal items, held
        for seq in pack(items):
            emit(seq)
        items, held = Items(weights, limits), 0
        ids.clear()
        names.clear()
        if not out:
            return None
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

    for b in batches:
        all_names = b.column(0).to_pylist()
        all_loss = b.column(2).to_pylist() if with_loss else None
        for t in text_chunks(b.column(1), ENCODED_BYTES):
            flat, cut = enc.texts(t)
            loss_of = all_loss[t.rows] if with_loss else None
            for i, (name, lo, hi) in enumerate(zip(all_names[t.rows], cut[:-1].tolist(), cut[1:].tolist())):
                raw = flat[lo:hi].tobytes() + end
                n = len(raw) // 4
                loss = n if loss_of is None else min(n, max(0, loss_of[i] or 0))
                doc = len(ids)
                ids.append(raw)
                names.append(name)
                start = 0
                while n - start >= size and min(size, max(0, start + size - (n - loss))) <= limits[2]:
                    emit([(doc, start, size, min(size, max(0, start + size - (n - loss))))])
                    start += size
                if start < n:
                    step = min(size, limits[2])  # only a limit on loss below the length leaves longer rests
                    while n - start > step:
                        items.add(doc, start, step, min(step, max(0, start + step - (n - loss))))
                        start += step
                    items.add(doc, start, n - start, min(n - start, loss))
                held += n
                if held >= BLOCK_TOKENS and (done := flush()) is not None:
                    yield done
        release()
    if (done := flush()) is not None:
        yield done


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   loss_col: str | None = None, sequence: int = SEQUENCE, segments: int = SEGMENTS,
                   loss_limit: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``loss_col`` counts the loss-bearing tokens at a document's end (instruction data: the answer); without it
    every token bears loss.  Limits: ``sequence`` tokens, ``segments`` pieces, ``loss_limit`` loss-bearing tokens.
    The tokenizer file must be readable at the same path on every worker, as the installed package is.
    """
    if sequence < 1 or segments < 1 or (loss_limit is not None and loss_limit < 1):
        raise ValueError("limits must be at least 1")
    small_batches(docs.sparkSession)
    limits = (sequence, segments, sequence if loss_limit is None else loss_limit)
    rows = documents_of(docs, id_col, text_col)
    if loss_col is not None:
        from pyspark.sql import functions as F
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                           F.col(loss_col).cast("long").alias("loss"))
    return rows.mapInArrow(
        lambda it: pack_batches(it, tokenizer_path, limits, weights, loss_col is not None), SCHEMA)
