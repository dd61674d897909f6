"""Small documents with copies, near copies, junk and the edge cases every operator must define."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns whose names the operators use themselves
EXTRA = "row long, key long, d long, r long, kept boolean, items string"
SYLLABLES = "ba co di fu ge hi jo ka lu me ni po qua re si to ur ve wo xi yo zu".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 1, 2, 2, 3])))
        out.append(w + rng.choice(["", "", "", "", ",", "."]))
        out.append("\n" if rng.random() < 0.05 else " ")
    return "".join(out).strip()


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out: list[tuple] = []
    add = lambda i, t, lang="en": out.append((i, t, lang, f"src{rng.randrange(3)}", None if t is None else len(t)))
    passage = prose(rng, 70)
    for i in range(n):
        t = prose(rng, rng.choice([5, 60, 120, 300]))
        if i % 7 == 0:
            t = f"{t} {passage} {prose(rng, 20)}"
        add(i, t, rng.choice(["en", "de", None]))
    texts = [t for _, t, *_ in out]
    for k in range(12):  # copies, and near copies with one word changed
        t = texts[k % n]
        add(n + k, t)
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        add(n + 100 + k, " ".join(w))
    add(500, None)
    add(501, "")
    add(502, " \t\n ")
    add(503, "word")
    add(504, "ing " * 400)
    add(505, "a" * 5000)
    add(506, "Ünïcode ça ß 漢字 emoji 😀 " * 30)
    add(507, texts[6 % n] + "\n" + texts[6 % n])
    add(None, texts[3])
    add(None, None)
    add(3, texts[3])           # a row that repeats
    add(3, prose(rng, 90))     # another text under the same id
    return out


def frame(spark, data=None, extra: bool = True):
    data = rows() if data is None else data
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    if extra:
        for c in EXTRA.split(", "):
            name, kind = c.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def pick(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
