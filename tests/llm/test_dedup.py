import hashlib

import numpy as np
import pytest
import xxhash
from data import SCHEMA, frame, pick, rows

from storelens.llm import simhash, substring_dedup, suffix_dedup

WHITE = b" \t\n\x0b\x0c\r"


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


# ---------------------------------------------------------------- difference cover, covering masks

def test_cover_is_a_difference_cover():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


@pytest.mark.parametrize("family", [0, 1])
def test_masks_cover_every_pair_within_the_radius(family):
    masks = [int(m) for m in simhash.covering_masks(3, family)]
    assert len(masks) == 15
    for a in range(64):
        for b in range(a, 64):
            for c in range(b, 64):
                diff = (1 << a) | (1 << b) | (1 << c)
                assert any(m & diff == 0 for m in masks)


def test_forest_links_what_the_full_graph_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 40, 12)] + [base]))
    i, j = simhash.forest(fp, 3)
    assert (np.bitwise_count(fp[i] ^ fp[j]) <= 3).all()
    assert groups(len(fp), zip(i, j)) == groups(len(fp), [
        (a, b) for a in range(len(fp)) for b in range(a) if bin(int(fp[a] ^ fp[b])).count("1") <= 3])
    assert len(i) < len(fp)


def groups(n, edges):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# ---------------------------------------------------------------- op1

def word_removals(data):
    first = {}
    for i, t, *_ in data:
        w = (t or "").encode().split()
        for s in range(len(w) - 49):
            key = tuple(w[s:s + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in data:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s:s + 50])] < i:
                gone[s:s + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup_against_brute_force(spark):
    data = rows()
    got = substring_dedup.remove_repeats(frame(spark, data))
    assert pick(got, "doc_id", "n_words", "n_removed", "kept_sha256") == word_removals(data)
    for r in got.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_substring_dedup_at_every_shift(spark):
    rng = np.random.default_rng(2)
    shared = [f"s{k}" for k in range(50)]
    data = [(0, " ".join(["x0"] * 3 + shared + ["x1"] * 9), None, None, None)]
    for k in range(1, 35):
        pad = [f"p{k}_{j}" for j in range(int(rng.integers(0, 90)))]
        data.append((k, " ".join(pad + shared + [f"q{k}"]), None, None, None))
    data.append((99, " ".join(["y"] + shared[:49]), None, None, None))  # one word short
    got = substring_dedup.remove_repeats(frame(spark, data))
    assert pick(got, "doc_id", "n_words", "n_removed", "kept_sha256") == word_removals(data)


# ---------------------------------------------------------------- op4

def byte_removals(data):
    seen, out = {}, {}
    known = sorted({(i, t or "") for i, t, *_ in data if i is not None})
    assert len({i for i, _ in known}) == len(known)
    for i, t in known:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.setdefault(b[s:s + 100], (i, s))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [4000, 2])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    data = [r for r in rows() if r[0] != 3] + [(3, rows()[3][1], "en", "s", 1)] * 2
    want = byte_removals(data)
    got = suffix_dedup.remove_repeats(frame(spark, data))
    none = hashlib.sha256(rows()[3][1].encode()).hexdigest()
    full = [want[i] if i is not None else (None, len((t or "").encode()), 0, 0,
                                          none if t else hashlib.sha256(b"").hexdigest()) for i, t, *_ in data]
    assert pick(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(full, key=repr)


def test_suffix_dedup_with_hot_leading_bytes(spark):
    """One passage in most documents: its leads fill several buckets, so runs cross their boundaries."""
    passage = "the very same line of text stands in nearly every document of this table, over and over, word for word. "
    data = [(k, f"{k} {passage}{'x' * (k % 5)} {passage * (k % 3)}tail {k * 7919}", None, None, None) for k in range(80)]
    want = byte_removals(data)
    got = suffix_dedup.remove_repeats(frame(spark, data))
    assert pick(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want.values(), key=repr)


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(3)
    cols = [rng.integers(0, 4, 500) for _ in range(4)]
    order = suffix_dedup.multikey_order(cols)
    keys = [tuple(c[k] for c in cols) for k in order]
    assert keys == sorted(keys)


def test_sliding_min():
    x = np.random.default_rng(4).integers(0, 1000, 300).astype(np.uint64)
    for w in (1, 7, 77, 300, 301):
        want = [x[k:k + w].min() for k in range(len(x) - w + 1)]
        assert suffix_dedup.sliding_min(x, w).tolist() == want


# ---------------------------------------------------------------- op5

def fingerprint(text):
    w = lowered(text).split()
    shingles = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            count[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * count[k] > len(shingles))


def test_near_duplicates_against_brute_force(spark):
    data = [r for r in rows() if r[0] is not None]
    fp = [fingerprint(t) for _, t, *_ in data]
    label = groups(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 3])
    least = {}
    for k, (i, *_) in enumerate(data):
        least[label[k]] = min(least.get(label[k], i), i)
    want = sorted([(i, f"{fp[k]:016x}", least[label[k]]) for k, (i, *_) in enumerate(data)], key=repr)
    assert pick(simhash.near_duplicates(frame(spark, data)), "doc_id", "fingerprint", "component_id") == want


def test_hot_groups_take_the_second_masks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base} | {base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False))
                           for _ in range(120)})
    as_long = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in as_long], "fp long"), 3).collect()
    at = {f: k for k, f in enumerate(as_long)}
    got = groups(len(fps), [(at[r.a], at[r.b]) for r in links])
    assert got == groups(len(fps), [(a, b) for a in range(len(fps)) for b in range(a)
                                    if bin(fps[a] ^ fps[b]).count("1") <= 3])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100} or got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_distinct_documents(spark):
    data = rows()
    kept = simhash.distinct_documents(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    ids = [r.doc_id for r in kept.collect()]
    heads = {r.component_id for r in simhash.near_duplicates(frame(spark, data)).collect()}
    assert set(ids) == heads


@pytest.mark.parametrize("op", [substring_dedup.remove_repeats, suffix_dedup.remove_repeats, simhash.near_duplicates])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffix_steps_free_their_shuffle_files(spark, monkeypatch):
    from storelens.llm import common, suffix_dedup
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    real = common.fresh_dir
    monkeypatch.setattr(common, "fresh_dir", lambda s, kind: (seen.append(kind), real(s, kind))[1])
    free, stored = [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, kind, **kw: (free.append(kw.get("free")), stored(df, kind, **kw))[1])
    was = spark.conf.get(key, None)
    text = "".join(f"{i * i} " for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "x" + text + "y"), (3, "z")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs, with_bytes=False).collect()}
    assert got == {1: 0, 2: len(text), 3: 0}
    assert seen == ["suffixes", "extended"] and free == [True, True]
    assert spark.conf.get(key, None) == was
