import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from data import SCHEMA, frame, pick, rows

from storelens.llm import arrays, lm_scoring, packing, quality_rules
from storelens.llm.common import text_chunks
from storelens.llm.tokenizer import tokenizer_path


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


# ---------------------------------------------------------------- sorted arrays

def test_arrays_round_trip(tmp_path):
    a = {"key": np.array([3, 5, 9], np.uint64), "small": np.array([1, 2, 3], np.uint8), "none": np.empty(0, np.int64)}
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        got = arrays.load(arrays.save(folder, a))
        assert all(np.array_equal(got[k], a[k]) and got[k].dtype == a[k].dtype for k in a)
        assert isinstance(got["key"], np.memmap)
    assert arrays.find(a["key"], np.array([9, 4, 3, 10], np.uint64)).tolist() == [2, -1, 0, -1]


# ---------------------------------------------------------------- op2

def base_measures(text):
    text = text or ""
    w = [x for x in text.encode().split()]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    tri = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    hit = set()
    for k in range(len(w) - 2):
        if tri[tuple(w[k:k + 3])] > 1:
            hit |= {k, k + 1, k + 2}
    n = len(w)
    return (n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def test_base_measures_against_brute_force(spark):
    data = rows() + [(600, "a\nb b\na\n\na\nb b\r\nb b", "en", "s", 1), (601, "# $%&|<> * x\n" * 30, "en", "s", 1)]
    got = quality_rules.judge(frame(spark, data))
    want = sorted([(i, *base_measures(t)) for i, t, *_ in data], key=repr)
    assert pick(got, "doc_id", *quality_rules.MEASURES, "base_failed") == want


def kneser_ney(texts, order=4):
    """Interpolated modified Kneser-Ney over characters, written plainly; p(gram) of the last symbol."""
    top = collections.Counter()
    for t in texts:
        s = [0] * (order - 1) + [int(c) for c in quality_rules.FOLD[[ord(c) for c in t]]] if t else []
        for k in range(order - 1, len(s)):
            top[tuple(s[k - order + 1:k + 1])] += 1
    level = {order: top}
    for k in range(order - 1, 0, -1):
        level[k] = collections.Counter(g[1:] for g in level[k + 1])

    def discounts(c):
        n = [0] + [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        raw = [1 - 2 * y * (n[2] / n[1] if n[1] else 0.25), 2 - 3 * y * (n[3] / n[2] if n[2] else 0.33),
               3 - 4 * y * (n[4] / n[3] if n[3] else 0.37)]
        return [0.0] + [min(max(d, 0.05 * (k + 1)), k + 0.95) for k, d in enumerate(raw)]
    ds = {k: discounts(level[k]) for k in level}
    ctx = {}
    for k, c in level.items():
        total, rest = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            rest[g[:-1]] += ds[k][min(v, 3)]
        ctx[k] = (total, rest)

    def p(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        k = len(g)
        total, rest = ctx[k]
        t = total[g[:-1]]
        if not t:
            return p(g[1:])
        v = level[k][g]
        return max(v - ds[k][min(v, 3)], 0) / t + rest[g[:-1]] / t * p(g[1:])
    return p


def test_perplexity_is_modified_kneser_ney(spark):
    data = [r for r in rows() if r[1] is not None][:40] + [(700, "", "en", "s", 0), (701, "\U0001f600é b", "en", "s", 0)]
    got = {(r.doc_id, r.lang): r.log_perplexity for r in quality_rules.judge(frame(spark, data)).collect()}
    for lang in {r[2] for r in data}:
        mine = [r for r in data if r[2] == lang]
        p = kneser_ney([t for _, t, *_ in mine])
        for i, t, *_ in mine:
            s = [0] * 3 + [int(c) for c in quality_rules.FOLD[[ord(c) for c in t]]] if t else []
            lp = [math.log(p(tuple(s[k - 3:k + 1]))) for k in range(3, len(s))]
            assert got[i, lang] == pytest.approx(-sum(lp) / len(lp) if lp else 0.0, rel=1e-9)


def test_junk_is_rejected_and_prose_is_kept(spark):
    from random import Random

    from data import prose
    rng = Random(3)
    data = [(k, prose(rng, 200), "en", "s", 0) for k in range(60)]
    data += [(900 + k, " ".join("".join(rng.choice("zxq#%7@") for _ in range(9)) for _ in range(80)), "en", "s", 0)
             for k in range(2)]
    kept = {r.doc_id for r in quality_rules.kept_documents(frame(spark, data)).collect()}
    assert kept == set(range(60))


def test_kept_documents_keep_their_columns_and_repeats(spark):
    data = rows()
    df = frame(spark, data)
    kept = quality_rules.kept_documents(df)
    assert kept.columns == df.columns
    want = collections.Counter(r.doc_id for r in quality_rules.judge(df).where("kept").collect())
    assert collections.Counter(r.doc_id for r in kept.collect()) == want


# ---------------------------------------------------------------- op3

def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def bigram_model(texts):
    pairs = collections.Counter()
    for t in texts:
        w = [b"</s>", *lowered(t).split(), b"</s>"]
        pairs.update(zip(w, w[1:]))
    total, before = collections.Counter(), collections.Counter()
    for (u, v), c in pairs.items():
        total[u] += c
        before[v] += 1

    def discounts(c):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [0.0] + [min(max(d, 0.05 * (k + 1)), k + 0.95) for k, d in enumerate(raw)]
    d2, d1 = discounts(pairs), discounts(before)
    rest = collections.Counter()
    for (u, _), c in pairs.items():
        rest[u] += d2[min(c, 3)]
    links, size = sum(before.values()), len(total)
    spare = sum(d1[min(c, 3)] for c in before.values())

    def p(u, v):
        low = (before[v] - d1[min(before[v], 3)] + spare / (size + 1)) / links
        if not total[u]:
            return low
        c = pairs[u, v]
        return (c - d2[min(c, 3)] + rest[u] * low) / total[u]
    return p, total, sum(total.values()), size


def test_lm_scores_against_brute_force(spark):
    data = rows() + [(800 + k, "the the the " * 200, "en", "s", 0) for k in range(4)]  # a pair seen over 255 times
    p, count, n, v = bigram_model([t for i, t, *_ in data if not held(i)])
    got = sorted(lm_scoring.score_documents(frame(spark, data)).collect(), key=lambda r: (repr(r.doc_id), r.score))
    want = []
    for i, t, *_ in data:
        w = [*lowered(t).split(), b"</s>"]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, held(i), len(w), sum(count[x] > 0 for x in w), n, base,
                     sum(math.log10(p(a, b)) for a, b in zip([b"</s>", *w], w))))
    want.sort(key=lambda r: (repr(r[0]), r[6]))
    for r, x in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:5]
        assert r.base_score == pytest.approx(x[5], rel=1e-9) and r.score == pytest.approx(x[6], rel=1e-9)


def test_lm_probabilities_add_up(spark):
    texts = [t for _, t, *_ in rows() if t]
    p, count, _, size = bigram_model(texts)
    for u in [b"</s>", next(iter(count)), b"never seen"]:
        assert sum(p(u, v) for v in count) + p(u, b"an unknown word") == pytest.approx(1)


def test_held_out_text_scores_above_the_base(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{k}" for k in range(50)]
    data = []
    for i in range(150):  # each word is mostly followed by its neighbour
        k, w = 0, []
        for _ in range(120):
            k = (k + 1) % 50 if rng.random() < 0.9 else int(rng.integers(50))
            w.append(vocab[k])
        data.append((i, " ".join(w), "en", "s", 0))
    got = lm_scoring.score_documents(frame(spark, data)).where("held_out").collect()
    assert got and all(r.score > 0.6 * r.base_score for r in got)


def test_lm_without_training_documents(spark):
    i = next(k for k in range(100) if held(k))
    r = lm_scoring.score_documents(frame(spark, [(i, "a b", "en", "s", 3)])).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


# ---------------------------------------------------------------- op8

def packed(got, sequence=2048, segments=256):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= sequence and at & (at - 1) == 0  # full, or a power of two: nothing is padded
        assert len(seq) <= segments
    return by_doc, by_seq


def test_packing_is_a_partition_of_the_ids(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    data = [r for r in rows() if r[0] not in (None, 3)] + [
        (901, "A <|endoftext|> b\x1cc d　e 'S it's\x0bx ΣΑΣ İ", "en", "s", 1), (902, "long word " * 6000, "en", "s", 1)]
    got = packing.pack_documents(frame(spark, data), tokenizer_path()).collect()
    by_doc, _ = packed(got)
    assert len(by_doc) == len(data)
    for i, t, *_ in data:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i, len(ids)], key=lambda r: r.start)
        at = 0
        for r in pieces:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_word_table_gives_the_ids_of_the_text_whatever_its_size():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(3)
    texts = ["A <|endoftext|> b\x1cc d\u3000e 'S it's\x0bx \u03a3\u0391\u03a3 \u0130", "", " ", "x" * 3000, "<|", "a <|b|> c" * 3,
             "\U0001f600 \u6f22\u5b57 " * 20, "long word " * 500]
    texts += [" ".join("".join(rng.choice("abcdeo\u00e9\u00fc") for _ in range(rng.choice([1, 2, 4, 9, 30])))
                       for _ in range(rng.randrange(200))) for _ in range(60)]
    for bits in (1, 6, 16):  # small tables: slots are taken over all the time
        ids = packing.WordIds(tokenizer_path(), bits)
        for _ in range(3):
            for t in text_chunks(pa.array(texts), 4000):
                flat, cut = ids.texts(t)
                for i in range(len(t)):
                    assert flat[cut[i]:cut[i + 1]].tolist() == tok.encode(
                        t.raw(i).decode(), add_special_tokens=False).ids
        assert len(ids.key) == len(ids.size) == len(ids.ids) == 1 << bits  # memory does not follow the vocabulary


def test_packing_keeps_all_three_limits(spark):
    df = spark.createDataFrame([(k, "word " * (k % 37), k % 11) for k in range(400)], "doc_id long, text string, loss long")
    got = packing.pack_documents(df, tokenizer_path(), loss_col="loss", sequence=256, segments=6, loss_limit=20).collect()
    _, by_seq = packed(got, 256, 6)
    assert all(sum(r.loss_tokens for r in s) <= 20 for s in by_seq.values())
    assert sum(r.loss_tokens for r in got) == sum(min(k % 11, k % 37 + 1) for k in range(400))
    assert sum(r.length for r in got) == sum(k % 37 + 1 for k in range(400))


def test_dot_product_heuristic_prefers_the_demand_that_matches_the_room():
    items = packing.Items((1.0, 1.0, 1.0), (100, 10, 50))
    items.add(0, 0, 60, 10)
    items.add(1, 0, 60, 50)
    assert items.stacks[items.best((100, 10, 50))][0][0] == 1
    assert items.stacks[items.best((100, 10, 20))][0][0] == 0  # the other one no longer fits
    assert items.best((50, 10, 50)) == -1


def test_repeated_rows_are_packed_once_each(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, None)], "doc_id long, text string")
    got = packing.pack_documents(df, tokenizer_path()).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == [(1, 3), (1, 3), (2, 1)]


@pytest.mark.parametrize("op", [quality_rules.judge, lm_scoring.score_documents,
                                lambda d: packing.pack_documents(d, tokenizer_path())])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []
