"""Language ID by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each
filter's largest response goes through a softmax layer.  The network is
trained in numpy with Adam on a bounded sample of labelled windows, and
applied to all windows of every text; a text's probabilities are the mean
over its windows, by their bytes.

The sample: about DOCS_PER_LANG documents of each language, by a hash of
their id, and from each up to WINDOWS_PER_DOC windows spread over its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, map_arrow, pieces, ranges, small, written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 6
DOCS_PER_LANG = 600
WINDOWS_PER_DOC = 4
EPOCHS = 8
BATCH = 64
RATE = 0.01
HELD_OUT = 2  # crc32 of the id, modulo 4
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class ByteNet:
    """Embedding of bytes, filters of several widths in one matrix (short
    ones padded with zeros), max pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        span, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.zeros((span, EMBED, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS:(i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(span * EMBED, n)
        self.p = {"emb": rng.normal(0, 1, (256, EMBED)), "conv": rng.normal(0, 0.3, (span * EMBED, n)) * self.mask, "bias": np.zeros(n),
                  "dense": rng.normal(0, 0.1, (n, len(langs))), "out": np.zeros(len(langs))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][0] = 0  # padding

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows * places, span * EMBED): the bytes under the filters."""
        e = self.p["emb"][x]
        n, t, d = e.shape
        span = max(WIDTHS)
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, t - span + 1, span * d), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(-1, span * d)

    def pooled(self, x: np.ndarray, where: bool = False):
        cols = self.columns(x)
        r = (cols @ self.p["conv"]).reshape(len(x), -1, self.p["conv"].shape[1])
        if where:
            at = r.argmax(axis=1)
            return np.take_along_axis(r, at[:, None], 1)[:, 0] + self.p["bias"], at, cols
        return r.max(axis=1) + self.p["bias"]

    def softmax(self, h: np.ndarray) -> np.ndarray:
        z = np.maximum(h, 0) @ self.p["dense"] + self.p["out"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.softmax(self.pooled(x[i:i + BATCH])) for i in range(0, len(x), BATCH)])

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteNet:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = (len(y) / (len(self.langs) * np.bincount(y, minlength=len(self.langs)).clip(1))).astype(np.float32)
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            for i in range(0, len(y), BATCH):
                b = order[i:i + BATCH]
                h, at, cols = self.pooled(x[b], True)
                dz = self.softmax(h)
                dz[np.arange(len(b)), y[b]] -= 1
                dz *= (weight[y[b]] / len(b))[:, None]
                dh = (dz @ self.p["dense"].T) * (h > 0)
                places = x.shape[1] - max(WIDTHS) + 1
                used = cols[(np.arange(len(b))[:, None] * places + at).ravel()].reshape(*at.shape, -1)
                g = {"dense": np.maximum(h, 0).T @ dz, "out": dz.sum(0), "bias": dh.sum(0), "conv": np.einsum("wf,wfk->kf", dh, used) * self.mask}
                dcol = dh[:, :, None] * self.p["conv"].T[None]  # window, filter, span * EMBED
                g["emb"] = np.zeros_like(self.p["emb"])
                for j in range(max(WIDTHS)):
                    byte = np.take_along_axis(x[b], at + j, 1).ravel()
                    for d in range(EMBED):
                        g["emb"][:, d] += np.bincount(byte, dcol[:, :, j * EMBED + d].ravel(), 256)
                g["emb"][0] = 0
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.001 * (g[k] ** 2 - s[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def windows(data: np.ndarray, off: np.ndarray, at_once: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of every text, padded with zeros, some at a time: (bytes,
    document, length)."""
    count = -(-np.diff(off) // WINDOW)
    doc = np.repeat(np.arange(len(count)), count)
    start = ranges(np.zeros(len(count), np.int64), count) * WINDOW + off[doc]
    length = np.minimum(WINDOW, off[doc + 1] - start)
    padded = np.concatenate((_FOLD[data], np.zeros(WINDOW, np.uint8)))
    for i in range(0, len(doc), at_once):
        to = i + at_once
        x = padded[start[i:to, None] + np.arange(WINDOW)]
        x[np.arange(WINDOW) >= length[i:to, None]] = 0
        yield x, doc[i:to], length[i:to]


def bucket(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> ByteNet | None:
    """The network, from labelled rows outside the held-out quarter: of each
    language about ``docs_per_lang`` different ones, told by a hash of id and
    text, so null or repeated ids do not make a language all in or all out.
    Languages are counted first, and the counts go to the texts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket() != HELD_OUT)).select("doc_id", "lang", "text")
    known = known.withColumn("version", F.xxhash64(F.lit(3), "doc_id", "text"))
    sizes = written(known.groupBy("lang").agg(F.approx_count_distinct("version").alias("n")), "language-sizes")
    share = F.col("version").bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    chosen = known.join(small(sizes, 64), "lang").where(share < F.lit(float(docs_per_lang)) / F.col("n"))
    chosen = chosen.dropDuplicates(["lang", "doc_id", "version"])  # a few hundred texts of a language

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "lang": [], "window": []}
            for i, lang, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                raw = t.encode()
                if not _LETTER.search(t):
                    continue
                n = -(-len(raw) // WINDOW)
                for k in sorted({j * n // WINDOWS_PER_DOC for j in range(WINDOWS_PER_DOC)}):
                    out["doc_id"].append(i), out["lang"].append(lang), out["window"].append(raw[k * WINDOW:(k + 1) * WINDOW])
            yield pa.record_batch({"doc_id": pa.array(out["doc_id"], pa.int64()), "lang": pa.array(out["lang"], pa.string()), "window": pa.array(out["window"], pa.binary())})

    rows = map_arrow(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), cut, "doc_id long, lang string, window binary").collect()
    rows = sorted(((r.lang, -1 if r.doc_id is None else r.doc_id, bytes(r.window)) for r in rows))
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        x[i, :len(r[2])] = _FOLD[np.frombuffer(r[2], np.uint8)]
    return ByteNet(langs).fit(x, np.array([langs.index(r[0]) for r in rows]))


def identify(docs: DataFrame, net: ByteNet | None, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs``, and its language and score under ``names``.

    Text that is null, empty or without a letter is ``und`` with score 0, as
    is any text if nothing could be learned.  Ids, languages and other
    columns are not looked at, and may be null, repeat or clash with nothing
    but the two names.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ByteNet | None = shared.value
        for b in batches:
            for part in pieces(b):
                text = part.column("text")
                pred, score = [UNKNOWN] * len(text), np.zeros(len(text))
                if model is not None:
                    total = np.zeros((len(text), len(model.langs)))
                    for x, doc, length in windows(*flat(text)):
                        np.add.at(total, doc, model.predict(x).astype(float) * length[:, None])
                    best = total.argmax(axis=1)
                    share = total / np.maximum(total.sum(axis=1, keepdims=True), 1)
                    for i, t in enumerate(text.to_pylist()):
                        if t and _LETTER.search(t):
                            pred[i], score[i] = model.langs[best[i]], min(1.0, share[i, best[i]])
                yield pa.record_batch({k: part.column(k) for k in keep} | {names[0]: pa.array(pred, pa.string()), names[1]: pa.array(score)})

    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), fn, ", ".join([*fields, f"`{names[0]}` string, `{names[1]}` double"]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs), "doc_id")
    return out.select("doc_id", (bucket() == HELD_OUT).alias("held_out"), "lang_pred", "score")
