import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from data import frame, rows
from pyspark.sql import functions as F

from storelens.llm import hard_negatives, periodic_runs, toxicity
from storelens.llm.common import mix, text_chunks


# ---------------------------------------------------------------- op11

def brute_runs(w, least=12):
    best, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= max(least, 2 * q):
                    best.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((lo, hi - lo, q) for (lo, hi), q in best.items())


def hard_sequences():
    rng = random.Random(5)
    out = []
    for _ in range(800):
        k, n = rng.choice([1, 2, 2, 3, 4]), rng.randint(0, 90)
        w = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        out.append(w)
    for _ in range(300):  # seams of highly periodic regions
        root = [rng.randrange(3) for _ in range(rng.randint(1, 4))]
        o = rng.randrange(len(root))
        a, b = (root * 99)[:rng.randint(5, 60)], ((root[o:] + root[:o]) * 99)[:rng.randint(5, 60)]
        out.append(a + b + [rng.randrange(3)] * rng.randrange(2) + a)
    x, y = "a", "ab"
    for _ in range(12):
        x, y = y, y + x
    out += [list(map(ord, y[:500])), [bin(i).count("1") % 2 for i in range(512)], [0] * 300, ([0] * 30 + [1]) * 9]
    return out


def test_runs_of_hard_sequences_match_brute_force():
    cases = hard_sequences()
    seq, base = [], []
    for d, w in enumerate(cases):
        base.append(len(seq))
        seq += mix(np.array(w, np.uint64) + np.uint64(7)).tolist() if w else []
        seq += mix(np.array([d + 10 ** 9], np.uint64)).tolist()
    lo, hi, p = periodic_runs.find_runs(np.array(seq, np.uint64), max(map(len, cases)))
    keep = hi - lo >= np.maximum(12, 2 * p)
    got = {}
    for a, b, q in zip(lo[keep], hi[keep], p[keep]):
        d = int(np.searchsorted(base, a, side="right")) - 1
        got.setdefault(d, []).append((int(a - base[d]), int(b - a), int(q)))
    for d, w in enumerate(cases):
        assert sorted(got.get(d, [])) == brute_runs(w), (d, w)


def test_synchronising_positions_are_consistent_and_dense():
    rng = np.random.default_rng(3)
    t = mix(rng.integers(0, 3, 4000).astype(np.uint64))
    h = periodic_runs.Dyadic(t, len(t))
    for tau, k in ((2, 1), (4, 2), (8, 3), (16, 4)):
        windows = {i: t[i:i + tau] for i in range(len(t))}
        periodic = np.array([any((windows[i][q:] == windows[i][:-q]).all() for q in range(1, tau // 3 + 1))
                             and i + tau <= len(t) for i in range(len(t))])
        at = set(periodic_runs.synchronising(h.level(k), tau, periodic).tolist())
        seen = {}
        for i in range(len(t) - 2 * tau):
            assert seen.setdefault(t[i:i + 2 * tau].tobytes(), i in at) == (i in at)
        for i in range(len(t) - 3 * tau):
            wide = t[i:i + 3 * tau - 1]
            if not any((wide[q:] == wide[:-q]).all() for q in range(1, tau // 3 + 1)):
                assert at & set(range(i, i + tau))


def expected_runs(doc_id, text, planted):
    w = (text or "").encode().split()
    if planted and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_periodic_runs_of_documents(spark):
    data = rows(n=40) + [(600, "to be or not " * 30 + "x" + " to be or not" * 30, "en", "s", 1),
                         (601, "aa ab " * 900, "en", "s", 1), (602, "b " * 11, "en", "s", 1), (603, "b " * 12, "en", "s", 1)]
    got = periodic_runs.periodic_runs(frame(spark, data), rewrite=periodic_runs.planted_words)
    cols = periodic_runs.COLUMNS[:8]
    have = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    assert have == sorted((expected_runs(r[0], r[1], True) for r in data), key=repr)
    assert any(r[1] for r in have)
    plain = periodic_runs.periodic_runs(frame(spark, data), with_text=True).where("doc_id = 600").first()
    assert [tuple(r) for r in plain["runs"]] == brute_runs(data[-4][1].split())
    assert len(plain["collapsed_text"].split()) == plain["n_kept"]
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- op12

@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 0, 5), (17, 33, 9), (64, 64, 64), (37, 65, 41)])
def test_strassen_is_exact_modulo_two_to_the_64(shape):
    rng = np.random.default_rng(2)
    m, k, n = shape
    a, b = rng.integers(-2 ** 62, 2 ** 62, (m, k)), rng.integers(-2 ** 62, 2 ** 62, (k, n))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) % 2 ** 64 for c in b.T] for r in a]
    got = hard_negatives.strassen(a, b, 4)
    assert got.shape == (m, n) and [[int(x) % 2 ** 64 for x in r] for r in got] == want


def test_window_bounds_are_exact():
    for s in (-201, -100, -1, 0, 1, 2, 3, 99, 100, 101, 12345, 2 ** 62):
        lo, hi = (int(x[0]) for x in hard_negatives.windows(np.array([s]), 50, 95))
        assert 50 * s <= 100 * lo < 50 * s + 100 and 95 * s - 100 < 100 * hi <= 95 * s


def brute_negatives(data):
    seen = []
    for vid, vec, label in data:
        if vid is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        r = (vid, (label + 1) % 10 if vid % 7 == 0 else label, tuple(math.floor(256 * x) for x in vec))
        if r not in seen:
            seen.append(r)
    out = []
    for a in seen:
        if a[0] % 50:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        for p in sorted((r for r in seen if r[1] == a[1] and r is not a), key=lambda r: (-score(r), r[0]))[:5]:
            s = score(p)
            near = sorted((r for r in seen if r[1] != a[1] and 50 * s <= 100 * score(r) <= 95 * s),
                          key=lambda r: (-score(r), r[0]))[:3]
            out += [(a[0], p[0], k + 1, r[0], s, score(r)) for k, r in enumerate(near)]
    return sorted(out)


def vectors(n=400, dims=12):
    rng = random.Random(4)
    base = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(6)]
    data = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(base)], rng.choice([1, 1, 1, 2, 3, 9])) for i in range(n)]
    data += [(n + i, list(data[50][1]), 1 + i % 2) for i in range(30)]      # ties in score, over labels
    data += [data[50], data[100], data[7]]                                  # rows that repeat
    data += [(None, [1.0] * dims, 1), (900, None, 1), (950, [0.5] * dims, None), (951, [float("nan")] * dims, 1),
             (952, [float("inf")] * dims, 1), (953, [None] + [1.0] * (dims - 1), 1), (1000, [], 1), (1001, [0.3], 2)]
    return data


def test_hard_negatives_match_brute_force(spark):
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.withColumn("row", F.lit("x")).withColumn("cell", F.lit(1))
    rows_ = hard_negatives.scaled_rows(df)
    moved = rows_.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = hard_negatives.hard_negatives(moved, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(data)
    assert got.dtypes[2] == ("rank", "int")


def test_small_blocks_give_the_same_negatives(spark, monkeypatch):
    for name, value in (("ANCHOR_BLOCK", 3), ("ROW_BLOCK", 40), ("TILE", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    test_hard_negatives_match_brute_force(spark)


def test_hard_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(hard_negatives.scaled_rows(df), F.col("vec_id") % 50 == 0).count() == 0
    df = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(hard_negatives.scaled_rows(df), F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- op13

def speech(n=600, seed=8):
    """Documents in which a bad stem, in a sentence of its own, makes the label."""
    rng = random.Random(seed)
    stems = ["badw", "grumz", "löwel"]
    out = []
    for i in range(n):
        lines = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(6)).capitalize()
                 for _ in range(rng.randint(1, 12))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            k = rng.randrange(len(lines))
            lines[k] += " " + rng.choice(stems).capitalize() + rng.choice(["", "er", "ing", "é"])
        out.append((i, ". ".join(lines) + rng.choice(["", ".", "!\n"]), toxic))
    return out


def test_fit_gradient_matches_differences():
    rng = np.random.default_rng(1)
    label = np.array([1, 0, 1, 0])
    sentences = np.array([3, 2, 1, 4])
    doc, sentence, feature = np.array([0, 0, 0, 1, 2, 3]), np.array([0, 0, 2, 1, 0, 3]), np.array([0, 1, 2, 1, 0, 2])

    def loss(w, b):
        total = 0.0
        for d in range(4):
            z = np.full(sentences[d], b)
            for dd, s, f in zip(doc, sentence, feature):
                if dd == d:
                    z[s] += w[f]
            p = 1 - np.prod(1 - 1 / (1 + np.exp(-z)))
            total -= math.log(p) if label[d] else math.log(1 - p)
        return total / 4 + toxicity.SHRINK / 2 * (w ** 2).sum()

    w, b = toxicity.fit(label, sentences, doc, sentence, feature, 3, steps=300)
    assert loss(w, b) < loss(np.zeros(3), toxicity.BIAS)
    for _ in range(30):  # no better point nearby in the direction of a random step
        step = rng.normal(0, 0.3, 4)
        assert loss(w + step[:3], b + step[3]) > loss(w, b) - 0.05


def test_toxicity_learns_and_locates(spark):
    data = speech()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    extra = docs.unionByName(spark.createDataFrame(
        [(None, "Badwer is here"), (9001, None), (9002, ""), (9003, " .!\n..."), (0, data[0][1]),
         (9004, "Qqq rrr. " * 40_000 + "Grumzing now. " + "Ttt uuu. " * 40_000)], docs.schema))
    extra = extra.withColumn("labelled", F.lit(1)).withColumn("score", F.lit(2))
    got = toxicity.toxicity(extra, labels).collect()
    assert len(got) == len(data) + 6
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [(by[i]["predicted"], y) for i, _, y in data if by[i]["held_out"]]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.03 * len(held)
    assert by[None]["predicted"] == 1
    assert [by[i]["score"] for i in (9001, 9002, 9003)] == [0.0, 0.0, 0.0]
    model = toxicity.train_model(docs, labels)
    found = toxicity.offending_sentences(docs, model).collect()
    texts = {i: t for i, t, _ in data}
    assert found and all(texts[r["doc_id"]][r["start"]:r["stop"]] == r["text"] for r in found)
    bad = sum(any(s in r["text"].lower() for s in ("badw", "grumz", "löwel")) for r in found)
    assert bad >= 0.95 * len(found)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a bad word."), (2, None)], "doc_id long, text string")
    for y in ([], [(1, 1)], [(1, None), (None, 1)], [(1, 0), (2, 0)]):
        labels = spark.createDataFrame(y, "doc_id long, toxic int")
        assert [r["score"] for r in toxicity.toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_sentences_never_cross_documents():
    import pyarrow as pa
    t = next(text_chunks(pa.array(["one two", "three. four five! \n six", "", "seven"])))
    s = toxicity.Sentences(t)
    assert s.n == 5 and s.first.tolist() == [0, 1, 4, 4, 5]
    assert [t.raw(int(s.doc[k]))[slice(*s.span(k))] for k in range(5)] == [b"one two", b"three", b"four five", b"six", b"seven"]
