"""Token-id output: binary shards of concatenated ids with Elias-Fano document boundaries.

A shard file holds the documents of one range of ids, in ascending order:

    magic "GTOK0001", then five unsigned 64-bit numbers: documents, ids, bytes an id, low bits, first rank's bits
    document ids   int64 x documents
    low            the low bits of each boundary, packed, most significant first
    high           the unary-coded high parts: boundary k sets bit (boundary >> low bits) + k
    samples        uint32: the place of every 256th set bit of high (for select)
    ids            uint16 or uint32, little-endian

The boundaries are the ends of the documents in ids; Elias-Fano keeps them in about
2 + log2(ids / documents) bits each, and select() finds one, or a run of them, from a sample and a short scan. Reading asks
select() for the bounds of READ documents at a time, and documents_at() for those of single documents.

Plan: one range shuffle by (id, hash of the text), sorted by them and the text inside partitions, so that rows of one id have one order
and a hot id spreads over partitions; each partition encodes and writes shards of bounded size. A file is written under a name of its attempt and then moved to its final name, so
a task that runs again after a lost executor leaves the same files. Reading uses Spark's binaryFile source.

Defined cases: a null text is an empty text (only the end id); rows without an id come first, with id null kept
as such in the manifest as the smallest possible id; repeated rows are all written; an empty table writes no shard.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"GTOK0001"
#: Boundaries between samples of the high bits, and documents that are read at a time.
SAMPLE, READ = 256, 1024
NO_ID = -(1 << 63)
#: Documents that one call of documents_at may name.
WANTED = 10_000
_tokenizers: dict[tuple[str, bool], Encoder] = {}


#: Texts of these characters alone are cut here by the byte-level pre-tokenizer's rule; others go to the library whole.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~\u00a1\u00ab\u00bb\u00bf-\u017f]*")
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_CUT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r {_LETTER}0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE shows bytes as letters: printable Latin-1 as it is, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


class Known(dict):
    """The ids of pre-tokens as bytes. The library is asked for each missing one; long ones are not kept."""

    def __init__(self, model, limit: int, longest: int):
        super().__init__()
        self.model, self.limit, self.longest = model, limit, longest
        self.letters = _byte_letters()
        self.space = chr(self.letters[32])

    def __missing__(self, token: str) -> bytes:
        if token.isascii() and token.isprintable():
            shown = token.replace(" ", self.space)
        else:
            shown = token.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(token) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[token] = ids
        return ids


def _cut_here(path: str) -> bool:
    """Whether a tokenizer file cuts texts as _CUT does: plain byte-level BPE, nothing normalised, prefixed, truncated or left to chance."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut, model = made.get("pre_tokenizer") or {}, made["model"]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True):
        return False
    return model.get("type", "BPE") == "BPE" and not any((made.get("normalizer"), made.get("truncation"), made.get("padding"), model.get("dropout")))


class Encoder:
    """Encodes texts with a tokenizer file. With plain byte-level BPE the library is asked for each distinct pre-token once.

    Any other kind of file gives all its texts to the library whole.

    plain_special: special tokens in a text are encoded as ordinary characters. The library's own default is False.
    """

    def __init__(self, path: str, cache: int = 500_000, longest: int = 48, plain_special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_special and t.special)]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.known = Known(self.tokenizer.model, cache, longest)
        self.cut_here = _cut_here(path)

    def encode(self, text: str) -> np.ndarray:
        if not self.cut_here or not _PLAIN.fullmatch(text) or (self.added is not None and self.added.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, _CUT.findall(text))), np.uint32)


def encoder(path: str, plain_special: bool = True) -> Encoder:
    key = path, plain_special
    if key not in _tokenizers:
        _tokenizers[key] = Encoder(path, plain_special=plain_special)
    return _tokenizers[key]


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence of numbers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, int(np.floor(np.log2(max(1, top) / n)))) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()) if bits else np.zeros(0, np.uint8)
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high), ones[::SAMPLE].astype(np.uint32))

    def _lows(self, first: int, last: int) -> np.ndarray:
        """The low parts of the numbers first to last - 1."""
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3])[a & 7 :][: b - a].reshape(last - first, self.low_bits)
        return (bits.astype(np.int64) << np.arange(self.low_bits - 1, -1, -1)).sum(axis=1)

    def select(self, first: int, last: int | None = None) -> np.ndarray | int:
        """The number at place `first`, or the numbers from there to place `last` - 1; only their stretch of the bits is read."""
        if last is None:
            return int(self.select(first, first + 1)[0])
        if last <= first:
            return np.zeros(0, np.int64)
        block, end = first // SAMPLE, -(-last // SAMPLE)
        place = int(self.samples[block])
        stop = int(self.samples[end]) >> 3 if end < len(self.samples) else len(self.high) - 1
        bits = np.unpackbits(self.high[place >> 3 : stop + 1])
        bits[: place & 7] = 0
        skip = first - block * SAMPLE
        ones = (place >> 3) * 8 + np.flatnonzero(bits)[skip : skip + last - first]
        return ((ones - np.arange(first, last)) << self.low_bits) | self._lows(first, last)

    def all(self) -> np.ndarray:
        return self.select(0, self.n)


def pack(doc_ids: list[int], tokens: list[np.ndarray], wide: bool) -> bytes:
    ends = np.cumsum([len(t) for t in tokens])
    ef = EliasFano.build(ends)
    kind = np.dtype("<u4" if wide else "<u2")
    head = np.array([len(doc_ids), int(ends[-1]) if len(ends) else 0, kind.itemsize, ef.low_bits, len(ef.high)], "<u8")
    body = np.concatenate(tokens).astype(kind) if tokens else np.zeros(0, kind)
    return b"".join([MAGIC, head.tobytes(), np.array(doc_ids, "<i8").tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u4").tobytes(), body.tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, EliasFano, np.ndarray]:
    """Document ids, their ends in the id array, and the id array."""
    if bytes(blob[:8]) != MAGIC:
        raise ValueError("not a token shard")
    n, total, width, bits, high_bytes = (int(x) for x in np.frombuffer(blob, "<u8", 5, 8))
    at = 48

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    ids = take("<i8", n)
    low, high = take("u1", (n * bits + 7) // 8), take("u1", high_bytes)
    samples = take("<u4", -(-n // SAMPLE))
    return ids, EliasFano(n, bits, low, high, samples), take(f"<u{width}", total)


# ---------------------------------------------------------------- writing and reading


def _put(folder: str, name: str, blob: bytes) -> None:
    """Write under a name of this attempt, then move into place: the same content whichever attempt wins."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(blob)
    store.move(draft, f"{base}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20, plain_special: bool = True) -> DataFrame:
    """Encode every text, write shards to `folder`, and return their manifest (file, shard, documents, ids). plain_special: see Encoder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path, plain_special)
        wide = max(enc.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        ids, tokens, size = [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{shard:06d}.gtok"
            _put(folder, name, pack(ids, tokens, wide))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "shard": [shard], "documents": [len(ids)], "ids": [sum(map(len, tokens))]}, schema=schema)

        schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    t = enc.encode(t or "")
                    ids.append(NO_ID if i is None else i)
                    tokens.append(np.append(t, np.uint32(end_id)).astype(np.uint32 if wide else np.uint16))
                    size += tokens[-1].nbytes
                    if size >= shard_bytes:
                        yield flush()
                        ids, tokens, size, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark", "text").select("id", "text")
    return rows.mapInArrow(write, "file string, part int, shard int, documents long, ids long")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files.

    A shard's base is the sum of the parts before (one number for each writing task) and of the shards before it in its part.
    """
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", earlier(Window.orderBy("part")).alias("before"))
    bases = manifest.select("file", "part", earlier(Window.partitionBy("part").orderBy("shard")).alias("inner"))
    bases = bases.join(parts, "part").select("file", (F.col("before") + F.col("inner")).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.gtok").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                ids, ends, tokens = unpack(memoryview(blob.as_buffer()))
                for at in range(0, len(ids), READ):
                    last = min(at + READ, len(ids))
                    bounds = np.concatenate([[0], ends.select(0, last)]) if at == 0 else ends.select(at - 1, last)
                    start, stop = bounds[:-1], bounds[1:]
                    crc = [zlib.crc32(tokens[s:e].astype("<u4").tobytes()) for s, e in zip(start, stop, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (last - at)), pa.array(ids[at:last]), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64())], names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(read, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = rows.join(bases, "file")
    return rows.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def documents_at(spark: SparkSession, folder: str, doc_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the token ids of the documents named in doc_ids, as written; other documents' ids are not read.

    Each shard finds its own by bisection, then their bounds by select(). The wanted ids of one call are a bounded set: they are broadcast.
    """
    wanted = sorted({int(r[0]) for r in doc_ids.select(id_col).where(F.col(id_col).isNotNull()).limit(WANTED + 1).collect()})
    if len(wanted) > WANTED:
        raise ValueError(f"at most {WANTED} documents a call")
    shared = spark.sparkContext.broadcast(np.array(wanted, np.int64))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.gtok").load(folder).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("content"):
                ids, ends, tokens = unpack(memoryview(blob.as_buffer()))
                places = np.flatnonzero(np.isin(ids, shared.value))
                lists = [tokens[ends.select(k - 1) if k else 0 : ends.select(k)].tolist() for k in places.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[places]), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.mapInArrow(read, "doc_id long, ids array<long>")
