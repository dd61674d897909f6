"""Personal data: pattern spans, then information-theoretic sanitisation of the terms that reveal them.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Their values are the protected entities.  For
each entity e and each term t that occurs within ``REACH`` words of it, document counts over the whole corpus give

    disclosure(t, e) = PMI(t; e) / IC(e),   PMI = log2(N c(e,t) / (c(e) c(t))),   IC = -log2(c(e) / N):

the share of the entity's information that the term alone gives away (1: t occurs only where e does).  A term at or
above ``THRESHOLD`` reveals e, if enough different surroundings back it up (``SUPPORT``; a passage that was copied is
one surrounding).  All its occurrences in the documents that hold e, however far from it, are spans of kind ``term``:
generalised to their kind or removed.  Terms that never stand within ``REACH`` words of an entity are not estimated.

Everything is counted in Spark with map-side aggregation; the candidate terms go to the counting tasks as a broadcast
only up to ``BROADCAST_TERMS``, else every word is counted.  Revealing terms are stored as arrays sorted by entity, which
a second pass over the texts maps; texts are never joined.

Defined cases: null text = empty; null ids keep their rows; equal rows get equal results; documents without an entity
get no ``term`` span; an empty table gives no rows.  Extra columns, whatever their names, are not read (``sanitise``
passes them on).  Very long texts are read whole, in time that follows their length, whatever runs of letters or digits
they hold.  Spans of one start come in the order of their kinds.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm import arrays
from storelens.llm.common import i64, runs, small_batches, stored, text_chunks, word_hashes, words
from storelens.session import fresh_dir

REACH, SUPPORT, THRESHOLD, MIN_LETTERS = 8, 3, 0.8, 3
BROADCAST_TERMS = 500_000  # 4 MB
KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

# the given patterns, in forms that take time in proportion to the text: an address is found from its @ (its local part
# is what can stand before it), and a chain of numbers is tried where a run of digits begins
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LONG_DIGITS = re.compile(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}|"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost, without overlaps."""
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m is not None:
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def is_byte(number: str) -> bool:
    """Whether a run of digits, leading zeros included, is at most 255."""
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value), sorted; cheap necessary conditions come first."""
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(map(is_byte, m.group().split("."))):
                    out.append((m.start(), 1, m.end(), m.group()))
        if LONG_DIGITS.search(text):
            for m in CARD.finditer(text):
                d = re.sub("[^0-9]", "", m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end(), d))
        if "+" in text:
            for m in PHONE.finditer(text):
                d = re.sub("[^0-9]", "", m.group())
                if 10 <= len(d) <= 15:
                    out.append((m.start(), 3, m.end(), d))
    out.sort()
    return out


def term_of(word: str) -> tuple[str, int]:
    """(term, letters cut off in front): lower case without punctuation at the edges."""
    left = word.lstrip(EDGE)
    return left.rstrip(EDGE).lower(), len(word) - len(left)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Covered:
    """Whether a range of a text meets any of its spans."""

    def __init__(self, spans: list[tuple[int, int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e, _ in spans:  # sorted by start
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


def pieces(text: str, covered: Covered) -> tuple[list[int], list[int], list[bool]]:
    """(starts, ends, whether it is a span) of the words of a text, cut where spans begin and end; the spans between
    them count as one each."""
    starts, ends, is_span = [], [], []
    k, n = 0, len(covered.starts)

    def add(a: int, b: int, span: bool) -> None:
        starts.append(a)
        ends.append(b)
        is_span.append(span)

    for m in WORD.finditer(text):
        at, end = m.span()
        while at < end:
            while k < n and covered.ends[k] <= at:
                k += 1
            if k == n or covered.starts[k] >= end:
                add(at, end, False)
                break
            if covered.starts[k] > at:
                add(at, covered.starts[k], False)
            if not starts or starts[-1] != covered.starts[k]:
                add(covered.starts[k], covered.ends[k], True)
            at = covered.ends[k]
    return starts, ends, is_span


def near_terms(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, int, int, int]]:
    """(entity, term, word, start, end, surroundings) of the terms within ``REACH`` words of each base span."""
    out = []
    starts, ends, is_span = pieces(text, Covered(spans))
    for start, _, end, value in spans:
        before = range(max(0, (i := bisect.bisect_right(ends, start)) - REACH), i)
        after = range(j := bisect.bisect_left(starts, end), min(len(starts), j + REACH))
        near = [*before, *after]
        entity = signed(xxhash.xxh64_intdigest(value))
        around = signed(xxhash.xxh64_intdigest(" ".join(text[starts[x]:ends[x]] for x in near)))
        for x in near:
            if is_span[x]:
                continue
            a, b = starts[x], ends[x]
            term, cut = term_of(text[a:b])
            if len(term) >= MIN_LETTERS and not term.isdigit():
                out.append((entity, signed(xxhash.xxh64_intdigest(term)), a + cut, a + cut + len(term), around))
    return out


FOUND = ("doc_id long, row long, base array<struct<start:long,kind:int,end:long>>, "
         "near array<struct<entity:long,term:long,start:long,end:long,around:long>>")


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_t = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    near_t = pa.list_(pa.struct([(x, pa.int64()) for x in ("entity", "term", "start", "end", "around")]))
    for b in (w.slice(at, 1000) for w in batches for at in range(0, w.num_rows, 1000)):
        base, near = [], []
        for text in b.column(1).to_pylist():
            spans = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in spans])
            near.append([dict(zip(("entity", "term", "start", "end", "around"), x)) for x in near_terms(text, spans)]
                        if spans else [])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(base, base_t), pa.array(near, near_t)],
                                         names=["doc_id", "row", "base", "near"])


def term_documents(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(term, n): documents that hold each term (of ``wanted``, sorted; None: all)."""
    shared = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            for t in text_chunks(b.column(0)):
                starts, ends, first = words(t)
                # equal spellings become terms once a worker
                h = word_hashes(t, starts, ends)
                u, where, back = np.unique(h, return_index=True, return_inverse=True)
                raw = t.data.tobytes()
                term = np.empty(len(u), np.int64)
                for k, i in enumerate(where.tolist()):
                    w = raw[starts[i]:ends[i]]
                    got = seen.get(w)
                    if got is None:
                        got = signed(xxhash.xxh64_intdigest(term_of(w.decode())[0]))
                        if len(seen) < 300_000:
                            seen[w] = got
                    term[k] = got
                if shared is not None:
                    at = np.minimum(np.searchsorted(shared.value, term), max(len(shared.value) - 1, 0))
                    known = shared.value[at] == term if len(shared.value) else np.zeros(len(term), bool)
                else:
                    known = np.ones(len(term), bool)
                doc = np.repeat(np.arange(len(t)), np.diff(first))
                pick = known[back]
                d, x = doc[pick], term[back][pick]
                order = np.lexsort((x, d))
                cut = runs(d[order], x[order])
                v, n = np.unique(x[order][cut[:-1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], names=["term", "n"])

    return texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def revealing(texts: DataFrame, found: DataFrame, threshold: float, support: int) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity."""
    near = found.where(F.size("near") > 0).select("doc_id", "row", F.explode("near").alias("x")).select(
        "doc_id", "row", "x.entity", "x.term", "x.around")
    # documents and surroundings are counted in two steps each, so a hot entity is merged before it meets itself
    docs_of = near.select("entity", "term", "doc_id", "row").distinct().groupBy("entity", "term").agg(
        F.count("*").alias("both"))
    ways_of = near.select("entity", "term", "around").distinct().groupBy("entity", "term").agg(
        F.count("*").alias("ways"))
    entity = near.select("entity", "doc_id", "row").distinct().groupBy("entity").agg(F.count("*").alias("c_e"))
    backed = ways_of.where(F.col("ways") >= support).join(docs_of, ["entity", "term"])
    pairs = stored(backed.join(entity, "entity"), "pii-pairs")
    terms = stored(pairs.select("term").distinct(), "pii-terms")
    n = terms.count()
    wanted = None
    if n <= BROADCAST_TERMS:
        wanted = np.sort(np.array([r.term for r in terms.toLocalIterator()], np.int64))
    counts = term_documents(texts.select("text"), wanted).join(terms, "term", "left_semi")
    total = texts.count()
    ic = -F.log2(F.col("c_e") / total)
    pmi = F.log2(F.lit(float(total)) * F.col("both") / (F.col("c_e") * F.greatest("n", "both")))
    return pairs.join(counts, "term").where(F.col("c_e") < total).withColumn("disclosure", pmi / ic) \
        .where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def saved(bad: DataFrame) -> list[tuple[int, str]]:
    """Stores (entity, term) as arrays sorted by entity, all terms of an entity in one; (least entity, address) of each."""
    spark = bad.sparkSession
    folder = fresh_dir(spark, "revealing")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            entity, term = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in (0, 1))
            order = np.lexsort((term, entity))
            address = arrays.save(folder, {"entity": entity[order], "term": term[order]})
            yield pa.RecordBatch.from_arrays([pa.array([entity.min()]), pa.array([address])], names=["least", "address"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    parts = stored(bad.select("entity", "term"), "pii-revealing").repartitionByRange(n, "entity").mapInArrow(
        write, "least long, address string")
    return sorted((x.least, x.address) for x in parts.collect())


def terms_in(text: str, spans: list[tuple[int, int, int, str]], files: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """(start, end) of every term of the text that reveals an entity of its spans."""
    wanted: set[int] = set()
    for value in {x[3] for x in spans}:
        entity = signed(xxhash.xxh64_intdigest(value))
        k = bisect.bisect_right(files, entity, key=lambda f: f[0]) - 1
        if k >= 0:
            a = arrays.load(files[k][1])
            lo, hi = np.searchsorted(a["entity"], entity, "left"), np.searchsorted(a["entity"], entity, "right")
            wanted.update(a["term"][lo:hi].tolist())
    out = []
    covered = Covered(spans)
    for m in WORD.finditer(text) if wanted else ():
        term, cut = term_of(m.group())
        if signed(xxhash.xxh64_intdigest(term)) in wanted and not covered.meets(m.start(), m.end()):
            out.append((m.start() + cut, m.start() + cut + len(term)))
    return out


def marked(batches: Iterator[pa.RecordBatch], files: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, base spans, revealing terms) of (doc_id, text, row)."""
    base_t = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    term_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        base, terms = [], []
        for text in b.column(1).to_pylist():
            spans = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in spans])
            terms.append([{"start": s, "end": e} for s, e in terms_in(text, spans, files)] if files and spans else [])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(base, base_t), pa.array(terms, term_t)],
                                         names=["doc_id", "row", "base", "terms"])


SPANS = ("doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
         "n_term long, cuts array<struct<start:long,end:long,kind:string>>")


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    order = (*KINDS, "term")
    for b in batches:
        counts, sha, spans, n_term, cuts = [[] for _ in KINDS], [], [], [], []
        for base, terms in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            base = [(x["start"], x["kind"], x["end"]) for x in base]
            more = [(x["start"], len(KINDS), x["end"]) for x in terms or ()]
            for k in range(len(KINDS)):
                counts[k].append(sum(x[1] == k for x in base))
            text = lambda xs: ",".join(f"{order[k]}:{s}:{e}" for s, k, e in xs)
            sha.append(hashlib.sha256(text(base).encode()).hexdigest())
            every = sorted(base + more)
            spans.append(text(every))
            n_term.append(len(more))
            cuts.append([{"start": s, "end": e, "kind": order[k]} for s, k, e in every])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()),
             pa.array(spans, pa.string()), pa.array(n_term, pa.int64()), pa.array(cuts, cut_t)],
            names=["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "cuts"])


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row"))


def revealing_files(rows: DataFrame, threshold: float, support: int) -> list[tuple[int, str]]:
    found = stored(rows.mapInArrow(scan, FOUND), "pii")
    return saved(revealing(rows, found, threshold, support))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         support: int = SUPPORT) -> DataFrame:
    """One row per document: counts of the base kinds, base_sha256, spans, n_term, cuts (all spans), row."""
    small_batches(docs.sparkSession)
    rows = rows_of(docs, id_col, text_col)
    files = revealing_files(rows, threshold, support)
    return rows.mapInArrow(lambda it: summarise(marked(it, files)), SPANS)


def cleaned(text: str, files: list[tuple[int, str]]) -> str:
    spans = base_spans(text)
    if not spans:
        return text
    kinds = (*KINDS, "term")
    cuts = [(s, k, e) for s, k, e, _ in spans] + [(s, len(KINDS), e) for s, e in terms_in(text, spans, files)]
    return sanitised(text, [{"start": s, "end": e, "kind": kinds[k]} for s, k, e in sorted(cuts)])


def sanitised(text: str, cuts: list[dict]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first names the kind."""
    out, at = [], 0
    for c in cuts:
        if c["start"] >= at:
            out += [text[at:c["start"]], LABELS[c["kind"]]]
            at = c["end"]
        elif c["end"] > at:
            at = c["end"]
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
             threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """The documents with every span replaced, and ``length_col``, if there, brought up to date where a text changed.

    One pass rewrites the texts where it finds the spans: nothing is joined, and other columns pass as they are.
    """
    small_batches(docs.sparkSession)
    files = revealing_files(rows_of(docs, id_col, text_col), threshold, support)
    text_at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            texts = cols[text_at].to_pylist()
            new = [t if t is None else cleaned(t, files) for t in texts]
            cols[text_at] = pa.array(new, cols[text_at].type)
            if length_at is not None:
                old = cols[length_at].to_pylist()
                cols[length_at] = pa.array([n if x == y else len(y) for n, x, y in zip(old, texts, new)],
                                           cols[length_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)
