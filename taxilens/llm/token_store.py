"""Token ids in a binary file with a shared zstandard dictionary.

Documents are dealt by ranges of their id and encoded; the ids of each are
one zstandard frame of its own, compressed with a dictionary trained on
serialized id arrays, so a short document can be read without its
neighbours and still compresses well.  Frames are gathered in blocks:

    magic   8 bytes   b"TOKSTOR1"
    dict    16 bytes  blake2b-128 of the dictionary the frames need
    n       uint32    documents in the block
    ids     n int64   document ids, ascending (the smallest int64: null)
    tokens  n uint32  ids per document, with the end id
    index   n+1 uint64  offsets of the frames in the body
    body    the frames

All integers are little endian; the ids in a frame are uint32.  Blocks are
rows of a Parquet table (``part``, ``seq``, ``n_tokens``, ``block``), so
Spark's committer writes them: a lost executor's task runs again and leaves
no half block.  The dictionary lies beside them, by its hash.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxilens.session import scratch_path

from .blocks import bounds, dictionary
from .common import IS_SPACE, KEPT, documents, flat, map_arrow, pieces, ranges

MAGIC = b"TOKSTOR1"
HEAD = struct.Struct("<8s16sI")
END_ID = 2
NULL_ID = -(1 << 63)
TOKENIZER = "word_bpe_49k.json"
#: The dictionary is trained on the ids of at most this many documents, the
#: first by hash of their id, of at most SAMPLE_IDS ids each.
SAMPLE_DOCS = 500
SAMPLE_IDS = 2048
DICT_BYTES = 64 << 10
LEVEL = 3
#: A block is closed when its frames hold so many ids.
BLOCK_TOKENS = 1 << 19
#: Parts of words whose ids a Python worker remembers: so many of late, and
#: as many before these.
CACHE_PARTS = 200_000
LINE_WORDS = 500
#: Texts encoded at once: so many bytes, one text at least.
BATCH_BYTES = 4 << 20

_CLOSING = np.zeros(256, bool)
_CLOSING[[*b".,;:!?"]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of letters that no composition, case rule or contraction
    ties to a neighbour: A-Z, a-z and U+00C0 to U+00FF without the two signs."""
    low = data | 32
    out = (low >= 97) & (low <= 122) & (data < 128)
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    out |= second
    out[:-1] |= second[1:]
    return out


def _small(data: np.ndarray) -> np.ndarray:
    """Those letters in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[second] += 32
    return out


def strings(arr: pa.Array) -> list[str]:
    """``to_pylist`` of a string column without nulls, several times faster."""
    return arr.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts by the tokenizers library.

    No token of the vocabulary and no step before the merges reaches across
    ASCII white space, so a text's ids are those of its white-space-separated
    words, joined.  The distinct words of some texts fall into parts: a plain
    word in lower case and its closing punctuation, or any other word whole.
    The library encodes what parts are new, plain ones in lines, whose ids
    fall apart at the tokens that end a word; a worker remembers a bounded
    number of parts.  The ids of the texts are then gathered by number.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def _encode(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.tok.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.parts[p] = np.asarray(e.ids, dtype="<u4").tobytes()

    def _encode_plain(self, parts: list[str]) -> None:
        lines = [parts[i:i + LINE_WORDS] for i in range(0, len(parts), LINE_WORDS)]
        for line, e in zip(lines, self.tok.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            to = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(to) != len(line):
                self._encode(line)
                continue
            raw, at = ids.tobytes(), 0
            for p, t in zip(line, to, strict=True):
                self.parts[p] = raw[at:t]
                at = t

    def _ids(self, parts: list[str], plain: np.ndarray) -> list[bytes]:
        """The ids of each part, from memory or from the library."""
        known, old = self.parts, self.old
        out = [*map(known.get, parts)]
        missing = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            part = parts[k]
            ids = old.get(part)
            if ids is None:
                missing.append(k)
            else:
                out[k] = known[part] = ids
        lines = [parts[k] for k in missing if plain[k]]
        if lines:
            self._encode_plain(lines)
        other = [parts[k] for k in missing if not plain[k]]
        if other:
            self._encode(other)
        for k in missing:
            out[k] = known[parts[k]]
        if len(known) > CACHE_PARTS:
            self.parts, self.old = {}, known
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, without end ids, and where each text's begin (n + 1)."""
        data, off = flat(texts)
        ink = ~IS_SPACE[data]
        start, end = bounds(ink, off)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        codes, words = dictionary(data, ink, start, end)
        # each distinct word: its body, lowered if plain, and what closes it
        wdata, woff = flat(words)
        first, last = woff[:-1], woff[1:]
        place = np.where(_CLOSING[wdata], -1, np.arange(len(wdata)))
        cut = np.maximum(np.maximum.reduceat(place, first) + 1, first)
        before = np.concatenate([[0], np.cumsum(~_letters(wdata))])
        plain = (cut > first) & (before[cut] == before[first])
        cut = np.where(plain, cut, last)
        is_body = np.zeros(len(wdata) + 1, np.int64)
        np.add.at(is_body, first, 1)
        np.add.at(is_body, cut, -1)
        body = np.cumsum(is_body[:-1]) > 0
        small = np.where(np.repeat(plain, last - first), _small(wdata), wdata)
        body_of, bodies = dictionary(small, body, first, cut)
        close_of, closings = dictionary(wdata, ~body, cut, last)
        parts = strings(bodies) + strings(closings)
        is_plain = np.zeros(len(parts), bool)
        is_plain[body_of[plain]] = True
        ids = self._ids(parts, is_plain)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        # two parts for each distinct word, then these for each word of the texts
        both = np.stack([body_of, close_of + len(bodies)], axis=1)
        of_words = np.frombuffer(b"".join(ids), "<u4")[ranges(begin[both.ravel()], size[both.ravel()])]
        size = size[both].sum(axis=1)
        begin = np.cumsum(size) - size
        size = size[codes]
        upto = np.concatenate([[0], np.cumsum(size)])
        return of_words[ranges(begin[codes], size)], upto[np.searchsorted(start, off)]

    def ids_of(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian uint32, without an end id."""
        ids, at = self.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}
KEPT["encoders"] = _ENCODERS


def encoder(path: str) -> Encoder:
    """One for each Python worker; it keeps its memory of words over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def train_dictionary(docs: DataFrame, path: str, n_docs: int = SAMPLE_DOCS, size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary from a bounded sample of serialized id arrays.
    Too few samples for training give raw content, or an empty dictionary."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.record_batch({"ids": pa.array([(x + struct.pack("<I", END_ID))[:4 * SAMPLE_IDS] for x in enc.ids_of(b.column(0))], pa.binary())})

    chosen = docs.select("text", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(n_docs)
    ids = sorted(bytes(r[0]) for r in map_arrow(chosen.select("text"), sample, "ids binary", keep="encoders").collect())
    try:
        return zstandard.train_dictionary(size, ids).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ids)[:size]


def pack(dict_hash: bytes, ids: list[int], counts: list[int], frames: list[bytes]) -> bytes:
    index = np.zeros(len(frames) + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=index[1:])
    return b"".join([HEAD.pack(MAGIC, dict_hash, len(ids)), np.asarray(ids, "<i8").tobytes(), np.asarray(counts, "<u4").tobytes(), index.tobytes(), *frames])


class Block:
    """A block read back; ``ids_of(i)`` decompresses the i-th document alone."""

    def __init__(self, block: bytes, dictionary: bytes):
        magic, dict_hash, n = HEAD.unpack_from(block)
        if magic != MAGIC or dict_hash != digest(dictionary):
            raise ValueError("not a block of this dictionary")
        at = HEAD.size
        self.doc_ids = np.frombuffer(block, "<i8", n, at)
        self.n_tokens = np.frombuffer(block, "<u4", n, at + 8 * n)
        self.index = np.frombuffer(block, "<u8", n + 1, at + 12 * n)
        self.body = memoryview(block)[at + 12 * n + 8 * (n + 1):]
        self.un = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids_of(self, i: int) -> bytes:
        return self.un.decompress(self.body[int(self.index[i]):int(self.index[i + 1])])


def digest(dictionary: bytes) -> bytes:
    return hashlib.blake2b(dictionary, digest_size=16).digest()


def write_store(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write ``docs`` (doc_id, text) as a token store under ``target``.

    Null text is empty: the end id alone.  A null id comes first.  Rows with
    equal ids lie side by side, each with its own frame.  An empty table
    leaves a store without blocks.  Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, path)
    spark.createDataFrame([(digest(dictionary), bytearray(dictionary))], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{target}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    end = struct.pack("<I", end_id)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, raw = encoder(path), shared.value
        key = digest(raw)
        data = zstandard.ZstdCompressionDict(raw)
        data.precompute_compress(level=LEVEL)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_dict_id=False)
        ids, counts, frames, seq, held = [], [], [], 0, 0

        def out():
            return pa.record_batch({"seq": pa.array([seq], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "first_id": pa.array([ids[0]], pa.int64()),
                                    "n_tokens": pa.array([sum(counts)], pa.int64()), "block": pa.array([pack(key, ids, counts, frames)], pa.binary())})

        for b in batches:
            for part in pieces(b, "text", BATCH_BYTES):
                for i, raw_ids in zip(part.column(0).to_pylist(), enc.ids_of(part.column(1)), strict=True):
                    raw_ids += end
                    ids.append(NULL_ID if i is None else i)
                    counts.append(len(raw_ids) // 4)
                    frames.append(squeeze.compress(raw_ids))
                    held += counts[-1]
                    if held >= BLOCK_TOKENS:
                        yield out()
                        ids, counts, frames, seq, held = [], [], [], seq + 1, 0
        if ids:
            yield out()

    # blocks know their part by the range they were dealt to, which follows the ids
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = map_arrow(dealt, blocks, "seq long, n_docs long, first_id long, n_tokens long, block binary", keep="encoders")
    made.select(F.spark_partition_id().cast("long").alias("part"), "*").write.parquet(f"{target}/blocks")


def read_store(spark: SparkSession, target: str) -> DataFrame:
    """One row per document of a store: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32, ids (little-endian uint32).  Start comes
    from sums over parts, then over the blocks of a part, then inside a
    block; only these sums meet, one row per part or block."""
    blocks = spark.read.parquet(f"{target}/blocks")
    rows = spark.read.parquet(f"{target}/dictionary").collect()
    shared = spark.sparkContext.broadcast(bytes(rows[0]["dictionary"]) if rows else b"")

    def docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                k = Block(raw.as_py(), shared.value)
                n = len(k.doc_ids)
                ids = [k.ids_of(i) for i in range(n)]
                if any(len(x) != 4 * c for x, c in zip(ids, k.n_tokens, strict=True)):
                    raise ValueError("a frame does not hold the ids its block names")
                counts = k.n_tokens.astype(np.int64)
                yield pa.record_batch({
                    "part": pa.array(np.full(n, part)), "seq": pa.array(np.full(n, seq)),
                    "doc_id": pa.array(k.doc_ids.astype(np.int64), mask=k.doc_ids == NULL_ID),
                    "at": pa.array(np.cumsum(counts) - counts), "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    rows = map_arrow(blocks.select("part", "seq", "block"), docs_of, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("block_start"))
    starts = starts.join(parts, starts["part"] == parts["p"]).select("part", "seq", (F.col("block_start") + F.col("part_start")).alias("base"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_store(docs: DataFrame) -> DataFrame:
    """Write the store under the shared folder, read it back."""
    target = scratch_path(docs.sparkSession, f"llm/tokens-{uuid.uuid4().hex[:12]}")
    write_store(docs, target)
    return read_store(docs.sparkSession, target)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(documents(spark, sf_dir)).drop("ids")
