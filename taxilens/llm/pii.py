"""Personal data: base patterns and information-theoretic sanitisation.

The values the base patterns find are the protected entities.  The corpus
tells how strongly other terms reveal them: a term t near an entity c in
n_ct of the entity's n_c contexts, in n_t of all N, has the pointwise mutual
information log2(N n_ct / (n_c n_t)) with c.  A term whose information
reaches DISCLOSURE times the information content of the entity itself,
log2(N / n_c), gives it away, and is marked wherever it stands near that
entity.

All four count the same: near the entity, distinct contexts; elsewhere,
distinct texts.  So n_t is n_ct and the distinct texts that have t but not
near c, and N is n_c and the distinct texts without c.  Copies of a text or
of a passage with the entity are one, so copying alone neither makes a term
a disclosure nor hides one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, documents, flat, map_arrow, mix, pieces, prefix_sums, range_hash, small, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of an entity that count as its context.
CONTEXT = 8
MIN_CONTEXTS = 3
DISCLOSURE = 0.9
MIN_TERM_CHARS = 3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only: what fails there fails later in it too
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_TERM = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
_BEFORE = 400  # characters around an entity looked at for its context

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[48:58] = _TERM_BYTE[65:91] = _TERM_BYTE[97:123] = _TERM_BYTE[128:] = True
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, one step for
    each @ (the pattern itself would try every start of a long word)."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        local = len(text[free:at]) - len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if local and (m := _DOMAIN.match(text, at + 1)):
            out.append((at - local, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, ends exclusive."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def contexts(text: str, spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """The terms near every entity, with the entity's value and a hash of
    the context's terms."""
    taken = sorted(s for v in spans.values() for s in v)
    out = []
    for kind in KINDS:
        for a, b in spans[kind]:
            lo, hi = max(0, a - _BEFORE), min(len(text), b + _BEFORE)
            near = [(m[0].translate(_FOLD), m.start(), m.end()) for m in _TERM.finditer(text, lo, hi)]
            near = [t for t in near if not any(s < t[2] and t[1] < e for s, e in taken if e > lo and s < hi)]
            near = [t for t in near if t[2] <= a][-CONTEXT:] + [t for t in near if t[1] >= b][:CONTEXT]
            key = int.from_bytes(hashlib.blake2b("\0".join(t[0] for t in near).encode(), digest_size=8).digest(), "little", signed=True)
            value = f"{kind}:{_NOT_DIGIT.sub('', text[a:b]) if kind in ('card', 'phone') else text[a:b].lower()}"
            out += [{"entity": value, "context": key, "term": t, "start": s, "end": e} for t, s, e in near if e - s >= MIN_TERM_CHARS]
    return out


_NEAR = "array<struct<entity:string,context:long,term:string,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_email .. n_phone, base, near): base joins the spans
    of the base kinds; near lists the terms around them."""
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, base, near = {k: [] for k in KINDS}, [], []
            for t in b.column("text"):
                s = base_spans(t.as_py() or "")
                for k in KINDS:
                    found[k].append(len(s[k]))
                base.append(",".join(f"{k}:{x}:{y}" for k in KINDS for x, y in s[k]))
                near.append(contexts(t.as_py(), s) if base[-1] else [])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "version": b.column("version"), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in found.items()}, "base": pa.array(base, pa.string()), "near": pa.array(near, near_type)})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return map_arrow(docs, fn, "doc_id long, version long, " + ", ".join(f"n_{k} long" for k in KINDS) + f", base string, near {_NEAR}")


def term_hash(terms: list[str]) -> np.ndarray:
    data, off = flat(pa.array(terms, pa.string()))
    return range_hash(prefix_sums(data, True), off[:-1], off[1:]).view(np.int64)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_t): in how many rows each term lies, by 64-bit hash of the term.
    Tasks count in pieces of text before the shuffle."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(last: bool):
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            held[:] = [(h[at], np.add.reduceat(n, at))]
            if last or len(at) > 1_000_000:
                (h, n), held[:] = held[0], []
                for i in range(0, len(h), 100_000):
                    yield pa.record_batch({"term": pa.array(h[i:i + 100_000].view(np.int64)), "n": pa.array(n[i:i + 100_000])})

        for b in batches:
            for part in pieces(b):
                data, off = flat(part.column("text"))
                ink = np.zeros(len(data) + 2, bool)
                ink[1:-1] = _TERM_BYTE[data]
                cut = np.zeros(len(data) + 1, bool)
                cut[off] = True
                start = np.flatnonzero(ink[1:] & (~ink[:-1] | cut))
                end = np.flatnonzero(ink[:-1] & (~ink[1:] | cut))
                doc = np.searchsorted(off[1:], start, side="right")
                h = range_hash(prefix_sums(data, True), start, end)
                if not len(h):
                    continue
                of_doc = h ^ mix(doc.astype(U) + U(1))  # one count for each document
                order = np.argsort(of_doc)
                once = of_doc[order]
                first = order[np.concatenate(([True], once[1:] != once[:-1]))]
                h = np.sort(h[first])
                at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                held.append((h[at], np.diff(np.append(at, len(h)))))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    yield from out(False)
        if held:
            yield from out(True)

    return map_arrow(docs.select("text"), fn, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def distinct_texts(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """(text) once for each version; ``copied`` lists the versions that more
    than one row has, and only their texts move."""
    docs = docs.select(F.xxhash64("text").alias("version"), "text")
    again = docs.join(copied, "version", "left_semi").dropDuplicates(["version"])
    return docs.join(copied, "version", "left_anti").unionByName(again).select("text")


def disclosing(near: DataFrame, texts: DataFrame, n_texts: float, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, pmi, content) of the terms that give an entity away.
    near: (entity, version, context, term, term_hash); texts: each once."""
    def both(*by: str) -> DataFrame:
        """Distinct contexts and distinct texts of each group."""
        c, v = (near.select(*by, x).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for x, n in (("context", "n_c"), ("version", "v_c")))
        return c.where(F.col("n_c") >= min_contexts).join(v, list(by))

    pairs = both("entity", "term", "term_hash").withColumnsRenamed({"n_c": "n_ct", "v_c": "v_ct"})
    pairs = written(pairs.join(both("entity"), "entity"), "pii-pairs")
    wanted = pairs.select(F.col("term_hash").alias("term")).distinct()
    counted = term_counts(texts).join(wanted, "term", "left_semi").withColumnsRenamed({"term": "term_hash", "n_t": "v_t"})
    n = F.lit(float(n_texts)) - F.col("v_c") + F.col("n_c")
    n_t = F.col("v_t") - F.col("v_ct") + F.col("n_ct")
    pairs = pairs.join(counted, "term_hash").withColumn("pmi", F.log2(n * F.col("n_ct") / (F.col("n_c") * n_t))).withColumn("content", F.log2(n / F.col("n_c")))
    return pairs.where(F.col("pmi") >= disclosure * F.col("content")).select("entity", "term", "pmi", "content")


def find_pii(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, version, n_email, n_ip, n_card, n_phone, n_term, base, spans).

    Null and empty texts hold nothing.  Ids may be null or repeat: a row is
    told by its id and the hash of its text, and repeated rows get the same
    spans.  An empty table gives no rows.  Other columns are not read.
    """
    rows = written(scan(docs), "pii-scan")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("term_hash", pa.array(term_hash(b.column("term").to_pylist())))

    near = rows.select("doc_id", "version", F.explode("near").alias("x")).select("doc_id", "version", "x.*")
    near = written(map_arrow(near, hashed, "doc_id long, version long, entity string, context long, term string, start long, end long, term_hash long"), "pii-near")
    versions = written(rows.groupBy("version").agg(F.count(F.lit(1)).alias("rows")), "pii-texts")
    copied = small(versions.where("rows > 1").select("version"), 8)
    found = near.join(disclosing(near, distinct_texts(docs, copied), versions.count(), min_contexts, disclosure), ["entity", "term"])
    found = found.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("version").alias("f_version"), "terms")
    rows = rows.drop("near").join(found, rows["doc_id"].eqNullSafe(F.col("f_id")) & (F.col("version") == F.col("f_version")), "left")
    more = F.transform("terms", lambda s: F.concat_ws(":", F.lit(TERM), s["start"], s["end"]))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(more, ","))
    return rows.select("doc_id", "version", *(f"n_{k}" for k in KINDS), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"), "base", spans.alias("spans"))


def redact(text: str, spans: str) -> str:
    """The text with every span generalised to its kind; a term is removed."""
    out, at = [], 0
    for kind, a, b in sorted(((k, int(x), int(y)) for k, x, y in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at:max(a, at)], "" if kind == TERM else f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with the spans of ``found`` generalised or removed."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "text": pa.array([t if t is None or not s else redact(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.string())})

    spans = found.where(F.col("spans") != "").select(F.col("doc_id").alias("f_id"), F.col("version").alias("f_version"), "spans").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.join(spans, docs["doc_id"].eqNullSafe(spans["f_id"]) & (F.xxhash64("text") == spans["f_version"]), "left")
    return map_arrow(docs.select("doc_id", "text", "spans"), fn, "doc_id long, text string")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
