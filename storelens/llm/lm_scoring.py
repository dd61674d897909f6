"""Language-model scoring: an interpolated modified Kneser-Ney bigram model over words.

1. Tasks count the word pairs of their training documents chunk by chunk (sorted hashes, equal pairs merged) and
   send the counts to ``n`` parts.  The part of a pair depends on both words, with 16 parts a context at most, so a
   frequent word's pairs are spread.
2. Each part merges its counts, writes sorted arrays of pair hashes and counts to the shared folder, and returns for
   each word its share of: tokens, followers seen once, twice, more often, and distinct predecessors.
3. One aggregation adds these shares up for each word; the result is written as sorted arrays, too.  Discounts come
   from the counts of counts.
4. Scoring maps the arrays into memory; each chunk of documents looks up its distinct words and pairs in sorted order.

Nothing is pruned, and no model table passes through the driver: it only sees one address per part and a few sums.
p(v|u) = max(c(uv) - D(c), 0) / c(u) + g(u) p(v), and p(v) is the same with distinct predecessors instead of counts,
interpolated with 1 / (V + 1), which is also the share of any unknown word.  A text is the closing token's context,
its words, then the closing token.

Defined cases: null text = empty (one token, the end); a null id is held as empty text for the split (training); an
empty training set gives base_score from c = N = V = 0 and score from the uniform share; repeated rows count each.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm import arrays
from storelens.llm.common import Texts, i64, mix, runs, small_batches, stored, text_chunks, word_hashes, words
from storelens.session import fresh_dir

END = np.uint64(0x51ED270B1F4A83C5)  # the closing token, and the context of a text's first word
COUNT_BYTES = 8 << 20
SPREAD = 16
PAIR = np.uint64(0x9E3779B97F4A7C15)
STATS = ("total", "n1", "n2", "n3", "before")


def token_stream(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): each document's word hashes and its closing token; first[i]:first[i+1] are document i's."""
    starts, ends, first = words(t)
    h = word_hashes(t, starts, ends, lower=True)
    n = len(t)
    tokens = np.empty(len(h) + n, np.uint64)
    at_end = first[1:] + np.arange(n)
    inner = np.ones(len(tokens), bool)
    inner[at_end] = False
    tokens[inner] = h
    tokens[at_end] = END
    return tokens, first + np.arange(n + 1)


def contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    u = np.empty_like(tokens)
    u[1:] = tokens[:-1]
    u[first[:-1]] = END
    return u


def part_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    return ((mix(u) % np.uint64(n) + (mix(v) % np.uint64(SPREAD))) % np.uint64(n)).astype(np.int32)


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * PAIR + v)


def merged(u: np.ndarray, v: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs added up, sorted by (u, v)."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    cut = runs(u, v)
    sums = np.diff(cut) if c is None else np.add.reduceat(c[order], cut[:-1]) if len(u) else c
    return u[cut[:-1]], v[cut[:-1]], sums


def count_pairs(docs: DataFrame, n: int) -> DataFrame:
    """(part int, u binary, runs binary, v binary, c binary) from (text) rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in text_chunks(b.column(0), COUNT_BYTES):
                tokens, first = token_stream(t)
                u, v, c = merged(contexts(tokens, first), tokens, None)
                part = part_of(u, v, n)
                order = np.argsort(part, kind="stable")
                u, v, c, part = u[order], v[order], c[order], part[order]
                cut = runs(part)
                cols: list[list[bytes]] = [[], [], [], []]
                for a, e in zip(cut[:-1], cut[1:]):
                    r = runs(u[a:e])
                    for col, x in zip(cols, (u[a:e][r[:-1]], np.diff(r).astype(np.uint32), v[a:e],
                                             c[a:e].astype(np.uint32))):
                        col.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int32())]
                                                 + [pa.array(x, pa.binary()) for x in cols],
                                                 names=["part", "u", "runs", "v", "c"])
    return docs.mapInArrow(count, "part int, u binary, runs binary, v binary, c binary")


def merge_parts(counts: DataFrame, n: int, folder: str) -> DataFrame:
    """Writes each part's pair arrays; one row for each word met in it, and one row with the part's address."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for part, *raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                u, r, v, c = (np.frombuffer(x, k) for x, k in zip(raw, (np.uint64, np.uint32, np.uint64, np.uint32)))
                held.setdefault(part, []).append((np.repeat(u, r), v, c.astype(np.int64)))
        for part in sorted(held):
            pieces = held.pop(part)
            u, v, c = merged(*(np.concatenate(x) for x in zip(*pieces)))
            key = pair_key(u, v)
            order = np.argsort(key)
            small = np.minimum(c, 255).astype(np.uint8)
            big = np.flatnonzero(c[order] >= 255)
            address = arrays.save(folder, {"key": key[order], "small": small[order], "big_at": big,
                                           "big": c[order][big]})
            cut = runs(u)
            add = lambda x: np.add.reduceat(x, cut[:-1]).astype(np.int64)
            total, n1, n2, n3 = add(c), add(c == 1), add(c == 2), add(c > 2)
            by_v = np.sort(v)
            vc = runs(by_v)
            seen, at = np.unique(np.concatenate([u[cut[:-1]], by_v[vc[:-1]]]), return_inverse=True)
            k = len(cut) - 1
            out = np.zeros((5, len(seen)), np.int64)
            for row, x in zip(out, (total, n1, n2, n3)):
                row[at[:k]] = x
            out[4, at[k:]] = np.diff(vc)
            of = np.bincount(np.minimum(c, 5), minlength=6)[1:5]  # pairs seen once .. four times
            names = ["word", *STATS, "part", "address", "counts"]
            for a in range(0, len(seen), 50_000):
                m = len(seen[a:a + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i64(seen[a:a + m]))] + [pa.array(x[a:a + m]) for x in out]
                    + [pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int64()))],
                    names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64())] * 6 + [pa.array([part], pa.int32()), pa.array([address], pa.string()),
                                                 pa.array([of.tolist()], pa.list_(pa.int64()))], names=names)

    return counts.repartitionById(n, F.col("part")).mapInArrow(
        merge, "word long, total long, n1 long, n2 long, n3 long, before long, part int, address string, "
               "counts array<long>")


def write_words(stats: DataFrame, n: int, folder: str) -> DataFrame:
    """(shard int, address string): word arrays, shard = top of the hash range."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        cols = [np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(7)]
        shard, word = cols[0], cols[1].view(np.uint64)
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            order = mine[np.argsort(word[mine])]
            address = arrays.save(folder, {"key": word[order], **{
                x: c[order].astype(np.int64 if c[order].max() >= 1 << 31 else np.int32)
                for x, c in zip(STATS, cols[2:])}})
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([address], pa.string())],
                                             names=["shard", "address"])

    return stats.select(F.pmod(F.shiftrightunsigned("word", 33), F.lit(n)).cast("int").alias("shard"), "word", *STATS) \
        .repartitionById(n, F.col("shard")).mapInArrow(write, "shard int, address string")


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts by count (0, 1, 2, 3+) from the numbers of items seen once .. four times."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    # tiny corpora can leave the formula's range; a discount takes part of a count, never more
    return np.array([0.0] + [min(max(d, 0.05 * (i + 1)), i + 0.95) for i, d in enumerate(raw)])


class Model:
    """Addresses and sums; the arrays themselves are mapped where they are used."""

    def __init__(self, n: int, pairs: dict[int, str], shards: dict[int, str], d2: np.ndarray, d1: np.ndarray,
                 tokens: int, vocabulary: int, links: int, kinds: tuple[int, int, int]):
        self.n, self.pairs, self.shards, self.d2, self.d1 = n, pairs, shards, d2, d1
        self.tokens, self.vocabulary, self.links, self.kinds = tokens, vocabulary, links, kinds

    def words(self, w: np.ndarray) -> np.ndarray:
        """Rows total, n1, n2, n3, before for sorted distinct word hashes (0 where unknown)."""
        out = np.zeros((5, len(w)), np.float64)
        shard = ((w >> np.uint64(33)) % np.uint64(self.n)).astype(np.int64)
        for s in np.unique(shard):
            if s in self.shards:
                a = arrays.load(self.shards[s])
                mine = np.flatnonzero(shard == s)
                at = arrays.find(a["key"], w[mine])
                mine, at = mine[at >= 0], at[at >= 0]
                for k, name in enumerate(STATS):
                    out[k, mine] = a[name][at]
        return out

    def pair_counts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        key, part = pair_key(u, v), part_of(u, v, self.n)
        order = np.lexsort((key, part))
        cut = runs(part[order])
        out = np.zeros(len(u), np.float64)
        for a, e in zip(cut[:-1], cut[1:]):
            mine = order[a:e]
            p = int(part[mine[0]])
            if p in self.pairs:
                m = arrays.load(self.pairs[p])
                at = arrays.find(m["key"], key[mine])
                mine, at = mine[at >= 0], at[at >= 0]
                c = m["small"][at].astype(np.float64)
                big = np.flatnonzero(c == 255)
                c[big] = m["big"][np.searchsorted(m["big_at"], at[big])]
                out[mine] = c
        return out

    def probabilities(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(p(v|u), c(v)) of a token stream."""
        w, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        s = self.words(w)
        total, before = s[0], s[4]
        d = self.d1[np.minimum(before, 3).astype(np.int64)]
        rest = float(self.d1[1:] @ np.array(self.kinds, float)) if self.links else 0.0
        low = ((before - d) + rest / (self.vocabulary + 1)) / self.links if self.links else np.full(
            len(w), 1 / (self.vocabulary + 1))
        iu, iv = at[:len(u)], at[len(u):]
        key = iu.astype(np.int64) * len(w) + iv
        pairs, back = np.unique(key, return_inverse=True)
        pu, pv = pairs // max(len(w), 1), pairs % max(len(w), 1)
        c = self.pair_counts(w[pu], w[pv])
        t = total[pu]
        seen = t > 0
        t1 = np.where(seen, t, 1)
        gamma = np.where(seen, (self.d2[1] * s[1, pu] + self.d2[2] * s[2, pu] + self.d2[3] * s[3, pu]) / t1, 1.0)
        p = np.where(seen, (c - self.d2[np.minimum(c, 3).astype(np.int64)]) / t1, 0.0) + gamma * low[pv]
        return p[back], total[iv]


def train(texts: DataFrame) -> Model:
    """Model of the (text) rows."""
    spark = texts.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = fresh_dir(spark, "ngrams")
    parts = stored(merge_parts(count_pairs(texts, n), n, folder), "ngram-words")
    made = parts.where("part is not null").select("part", "address", "counts").collect()  # one row a part
    of_pairs = np.sum([r["counts"] for r in made], axis=0) if made else np.zeros(4)
    words_all = stored(parts.where("word is not null").groupBy("word").agg(*(F.sum(x).alias(x) for x in STATS)),
                       "words")
    sums = words_all.agg(F.sum("total").alias("tokens"), F.sum(F.when(F.col("total") > 0, 1)).alias("vocabulary"),
                         F.sum("before").alias("links"),
                         *(F.sum((F.col("before") == k).cast("long")).alias(f"k{k}") for k in (1, 2, 3, 4)),
                         F.sum((F.col("before") > 2).cast("long")).alias("more")).first()
    shards = write_words(words_all, n, folder).collect()  # one row a shard
    return Model(n, {r["part"]: r["address"] for r in made}, {r["shard"]: r["address"] for r in shards},
                 discounts(of_pairs), discounts([sums[f"k{k}"] or 0 for k in (1, 2, 3, 4)]), sums["tokens"] or 0,
                 sums["vocabulary"] or 0, sums["links"] or 0, (sums["k1"] or 0, sums["k2"] or 0, sums["more"] or 0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, text) to the scores of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for t in text_chunks(b.column(2)):
                tokens, first = token_stream(t)
                p, c = m.probabilities(contexts(tokens, first), tokens)
                at = first[:-1]
                base = np.log10((c + 1) / (m.tokens + (m.vocabulary + 1)))
                n = np.diff(first)
                total = np.add.reduceat(np.log10(p), at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.rows.start, len(t)), b.column(1).slice(t.rows.start, len(t)), pa.array(n),
                     pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(len(t), m.tokens)),
                     pa.array(np.add.reduceat(base, at)), pa.array(total), pa.array(10.0 ** (-total / n))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                           "perplexity"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double, perplexity double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7,
                    held_fold: int = 2) -> DataFrame:
    """Train on the documents whose crc32(id) mod ``folds`` is not ``held_fold`` and score all of them."""
    small_batches(docs.sparkSession)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.crc32(name.cast("binary")) % folds == held_fold).alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return score(rows, train(rows.where("not held_out").select("text")))
