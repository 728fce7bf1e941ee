"""Suffix-array dedup: bytes covered by a SPAN-byte string that also starts in a document of a smaller id.

Distribution. Every SPAN-byte window has an anchor, its K-byte substring of the least hash (the leftmost of equals), which
depends on the window's bytes alone, so equal windows have equal anchors at equal offsets. Consecutive windows with one
anchor travel as one record (their union of bytes, about four times the text in all), and records are dealt
to buckets by their anchor's hash. Each task first merges its own equal records: a record of a document behind the least
one is settled on the spot, so a passage that a third of the corpus holds sends one record a batch, not one a document.
Records travel compressed, a blob for each bucket.

Hot anchors, those of more records than a bucket should hold, do not go to one bucket: what is left of their records is cut
into its windows, equal windows of a batch are merged likewise, and each goes to the bucket of its own hash, where equal windows
still meet. They are found in a sample of the documents (one in SEEN by a hash, and all long ones); it decides only which bucket
compares what, never what is removed. At most 2**20 anchors can be hot, so their list may go to every task.

Sorting. In a bucket, suffixes (the windows' starts) are put in order by deep-shallow sorting. Multikey quicksort, with
8 bytes for a character and all groups refined at once, orders them to SHALLOW bytes. The groups left, which have long common
prefixes, are ordered by blind tries: each group's first suffix is its trie's path, every other suffix is placed by
the length of its common prefix with it and the byte that follows, and those placed alike form the next groups.
Equal windows are neighbours then, and windows of a class whose least id is smaller than their own are removed.

Defined cases: null and short texts (under SPAN bytes) lose nothing; rows without an id lose nothing and are not compared;
rows that share an id are not compared with each other, and each text of theirs loses its own bytes; an empty table gives an empty result;
texts of any length are cut into overlapping blocks; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import mix, pieces, range_hash, shuffle_width, staged, text_buffer, with_tag

SPAN, K = 50, 16
REACH = SPAN - K + 1
SHALLOW = 16
BLOCK = 1 << 20
#: Bytes of records in a bucket, and of text that a task gathers before it sends.
BUCKET_BYTES, FLUSH_BYTES = 10 << 20, 8 << 20
#: Records of one anchor that make it hot; one document in SEEN and every one over LONG bytes is looked at to find such anchors.
HOT, SEEN, LONG = BUCKET_BYTES // (SPAN + REACH), 64, 1 << 20
_PLACE = np.uint64((1 << 24) - 1)

# ---------------------------------------------------------------- records


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    n = len(h) - width + 1
    return np.minimum(out[:n], out[width - have :][:n])


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as big-endian numbers (zeros past the end)."""
    padded = np.zeros(len(buf) + 64, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 56, ">u8", padded, strides=(1,))


def gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return buf[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def block_records(buf: np.ndarray, off: np.ndarray):
    """(start, windows, anchor offset, anchor hash) of every record in a block; off are its texts' bounds."""
    none = np.zeros(0, np.int64)
    if len(buf) < SPAN:
        return none, none, none, none.astype(np.uint64)
    w = _words(buf)
    n = len(buf) - K + 1
    h = mix(mix(w[:n].astype(np.uint64)) + (w[8 : n + 8].astype(np.uint64) >> np.uint64(128 - 8 * K)))
    least = _least((h & ~_PLACE) | np.arange(n, dtype=np.uint64), REACH)
    place = (least & _PLACE).astype(np.int64)
    start = np.arange(len(place))
    inside = off[np.searchsorted(off, start, side="right")] - start >= SPAN
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    last = inside.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~inside[1:]
    count = np.flatnonzero(last) - first + 1
    return first, count, place[first] - first, least[first] >> np.uint64(24)


def blocks(buf: np.ndarray, off: np.ndarray):
    """(place, bytes, bounds, first text) of the overlapping blocks of a buffer of texts; bounds are those of its texts in it."""
    for at in range(0, max(len(buf), 1), BLOCK):
        part = buf[at : at + BLOCK + SPAN - 1]
        lo = int(np.searchsorted(off, at, side="right")) - 1
        hi = int(np.searchsorted(off, at + len(part), side="left"))
        own = np.clip(off[lo : hi + 1] - at, 0, len(part))
        own[-1] = len(part)
        yield at, part, own, lo


def record_keys(part: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Equal records, equal keys."""
    return range_hash(part, first, first + count + (SPAN - 1)) ^ mix(h + anchor.astype(np.uint64))


def window_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the SPAN bytes from each place on."""
    w, key = _words(data), np.zeros(len(at), np.uint64)
    for depth in (*range(0, SPAN - 8, 8), SPAN - 8):
        key = mix(key + w[at + depth].astype(np.uint64))
    return key


class Sender:
    """Gathers one task's records, settles what it can, and packs the rest for their buckets.

    Records are places in the gathered texts; their bytes are copied only when their blob is packed.
    """

    def __init__(self, buckets: int, hot: np.ndarray = np.zeros(0, np.uint64)):
        self.buckets, self.hot, self.parts, self.texts, self.size = buckets, hot, [], [], 0

    def add(self, ids: np.ndarray, buf: np.ndarray, off: np.ndarray, tags: np.ndarray | None = None) -> None:
        tags = np.zeros(len(ids), np.int32) if tags is None else tags
        for at, part, own, lo in blocks(buf, off):
            first, count, anchor, h = block_records(part, own)
            doc = lo + np.searchsorted(own, first, side="right") - 1
            key = record_keys(part, first, count, anchor, h)
            self.parts.append((ids[doc], tags[doc], (first + at - off[doc]).astype(np.int32), count.astype(np.uint8), anchor.astype(np.uint8), h, key, first + (self.size + at)))
        self.texts.append(buf)
        self.size += len(buf)

    @staticmethod
    def behind(data: np.ndarray, rec: tuple) -> np.ndarray:
        """Whether each record equals one of a document with a smaller id."""
        ids, _, start, count, anchor, _, key, at = rec
        size = count.astype(np.int64) + SPAN - 1
        order = np.lexsort((start, ids, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of each sorted record: the least document's first
        follows = ids[order] > ids[head]
        later, lead = order[follows], head[follows]
        same = (size[later] == size[lead]) & (anchor[later] == anchor[lead])
        later, lead = later[same], lead[same]
        wrong = np.zeros(len(later), bool)
        for k in range(0, len(later), 1 << 15):
            l, r = later[k : k + (1 << 15)], lead[k : k + (1 << 15)]
            differ = gather(data, at[l], size[l]) != gather(data, at[r], size[r])
            if differ.any():
                wrong[k + np.repeat(np.arange(len(l)), size[l])[differ]] = True
        out = np.zeros(len(ids), bool)
        out[later[~wrong]] = True
        return out

    @staticmethod
    def windows(data: np.ndarray, rec: tuple) -> tuple:
        """The windows of records, as records of one window each that are dealt by their own hash."""
        ids, tags, start, count, anchor, _, _, at = rec
        n = count.astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        place = at[owner] + step
        key = window_keys(data, place)
        return ids[owner], tags[owner], (start[owner] + step).astype(np.int32), np.ones(len(owner), np.uint8), (anchor[owner] - step).astype(np.uint8), key, key, place

    def flush(self):
        """Settled intervals (id, tag, start, end), and (bucket, blob) pairs."""
        rec = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        data = np.concatenate(self.texts)
        self.parts, self.texts, self.size = [], [], 0
        later = self.behind(data, rec)
        settled, rec = [[x[later] for x in rec[:4]]], tuple(x[~later] for x in rec)
        hot = np.isin(rec[5], self.hot)
        if hot.any():
            cut = self.windows(data, tuple(x[hot] for x in rec))
            later = self.behind(data, cut)
            settled.append([x[later] for x in cut[:4]])
            rec = tuple(np.concatenate([x[~hot], y[~later]]) for x, y in zip(rec, cut, strict=True))
        ids, tags, start, count = (np.concatenate(x) for x in zip(*settled, strict=True))
        settled = (ids, tags, start, start + (count.astype(np.int32) + (SPAN - 1)))
        ids, tags, start, count, anchor, h, _, at = rec
        size = count.astype(np.int64) + SPAN - 1
        bucket = (mix(h) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((start, tags, ids, bucket))
        bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        blobs = []
        for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
            r = order[lo:hi]
            blobs.append((int(bucket[r[0]]), pack(ids[r], tags[r], start[r], count[r], anchor[r], gather(data, at[r], size[r]))))
        return settled, blobs


def pack(ids, tags, start, count, anchor, data) -> bytes:
    head = np.array([len(ids)], "<i8").tobytes()
    step = np.diff(ids, prepend=0).astype("<i8")
    raw = head + step.tobytes() + start.astype("<i4").tobytes() + tags.astype("<i4").tobytes() + count.tobytes() + anchor.tobytes() + data.tobytes()
    return np.array([len(raw)], "<i8").tobytes() + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack(blob: bytes):
    raw = pa.Codec("zstd").decompress(blob[8:], int(np.frombuffer(blob, "<i8", 1)[0]), asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids = np.cumsum(np.frombuffer(raw, "<i8", n, 8))
    start, tags = np.frombuffer(raw, "<i4", n, 8 + 8 * n), np.frombuffer(raw, "<i4", n, 8 + 12 * n)
    count, anchor = np.frombuffer(raw, "u1", n, 8 + 16 * n), np.frombuffer(raw, "u1", n, 8 + 17 * n)
    return ids, tags, start, count, anchor, np.frombuffer(raw, np.uint8, offset=8 + 18 * n)


# ---------------------------------------------------------------- deep-shallow sorting


def _split(group: np.ndarray, key: np.ndarray):
    """Order by (group, key); the order and the numbers of the groups after the split."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, new


def deep_shallow_sort(buf: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int = SPAN, shallow: int = SHALLOW):
    """Put suffixes (places in buf) in order inside their groups, by their first `length` bytes.

    Returns the order (indices into suffix) and the class number of each entry of it: equal prefixes, equal class.
    """
    w = _words(buf)
    n = len(suffix)
    tail = (1 << 64) - (1 << (64 - 8 * (length % 8))) if length % 8 else (1 << 64) - 1
    order = np.argsort(group, kind="stable")
    rank = np.zeros(n, np.int64)  # of each sorted entry: the first place of its group
    rank[1:] = np.where(group[order][1:] != group[order][:-1], np.arange(1, n), 0)
    np.maximum.accumulate(rank, out=rank)

    def active() -> np.ndarray:
        alone = np.ones(n, bool)
        alone[1:] &= rank[1:] != rank[:-1]
        alone[:-1] &= rank[:-1] != rank[1:]
        return np.flatnonzero(~alone)

    def refine(places: np.ndarray, key: np.ndarray) -> None:
        """Reorder the given places (whole groups) by key and split their groups."""
        o, new = _split(rank[places], key)
        order[places] = order[places][o]
        rank[places] = np.maximum.accumulate(np.where(new, places, 0))

    def word(places: np.ndarray, depth: int) -> np.ndarray:
        key = w[suffix[order[places]] + depth].astype(np.uint64)
        return key & np.uint64(tail) if depth + 8 > length else key

    # multikey quicksort to the shallow depth, 8 bytes a character
    for depth in range(0, min(shallow, length), 8):
        places = active()
        if len(places):
            refine(places, word(places, depth))

    # blind tries for what still has a common prefix
    done = np.zeros(n, bool)
    while True:
        places = active()
        places = places[~done[places]]
        if not len(places):
            break
        lead = rank[places]
        lcp, mine, theirs = np.full(len(places), length), np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        open_ = np.arange(len(places))
        for depth in range(0, length, 8):
            a, b = word(places[open_], depth), word(lead[open_], depth)
            x = a ^ b
            hit = x != 0
            if hit.any():
                at = np.full(int(hit.sum()), 8)  # the first differing byte
                for k in range(7, -1, -1):
                    at[(x[hit] >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0] = k
                rows = open_[hit]
                shift = (56 - 8 * at).astype(np.uint64)
                lcp[rows] = depth + at
                mine[rows] = ((a[hit] >> shift) & np.uint64(255)).astype(np.int64)
                theirs[rows] = ((b[hit] >> shift) & np.uint64(255)).astype(np.int64)
            open_ = open_[~hit]
        equal = lcp == length
        less = mine < theirs
        key = np.where(equal, 1 << 20, np.where(less, lcp * 256 + mine, (2 << 20) + (length - lcp) * 256 + mine))
        before = order[places][equal]
        refine(places, key)
        closed = np.zeros(n, bool)
        closed[before] = True
        done[places] = closed[order[places]]
    return order, rank


# ---------------------------------------------------------------- buckets


def bucket_intervals(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, tag, start, end) of what the records of one bucket lose."""
    parts = [unpack(b) for b in blobs]
    ids, tags, start, count, anchor, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = count.astype(np.int64) + SPAN - 1
    at = np.cumsum(size) - size
    # records that share an anchor with another document's
    w = _words(data)
    a = at + anchor
    one, two = w[a].astype(np.uint64), w[a + 8].astype(np.uint64) >> np.uint64(128 - 8 * K)
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low, high = np.minimum.reduceat(ids[order], head), np.maximum.reduceat(ids[order], head)
    shared = (low < high)[group]
    rec, group = order[shared], group[shared]
    if not len(rec):
        return ids[:0], tags[:0], start[:0], start[:0]
    # every window of these records; equal ones have the same anchor at the same offset
    n = count[rec].astype(np.int64)
    owner = np.repeat(np.arange(len(rec)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    suffix = at[rec][owner] + step
    offset = anchor[rec][owner].astype(np.int64) - step
    sa, cls = deep_shallow_sort(data, suffix, group[owner] * 64 + offset)
    head = np.flatnonzero(np.diff(cls, prepend=-1))
    own = ids[rec][owner]
    least = np.minimum.reduceat(own[sa], head)
    gone = np.zeros(len(suffix), bool)
    gone[sa] = least[np.searchsorted(head, cls)] < own[sa]
    # runs of removed windows inside a record
    first = gone.copy()
    first[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
    last = gone.copy()
    last[:-1] &= ~gone[1:] | (owner[1:] != owner[:-1])
    f, t = np.flatnonzero(first), np.flatnonzero(last)
    r = rec[owner[f]]
    return ids[r], tags[r], (start[r] + step[f]).astype(np.int32), (start[r] + step[t] + SPAN).astype(np.int32)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal, disjoint runs in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    head = np.flatnonzero(new)
    return start[head], end[np.append(head[1:] - 1, len(end) - 1)]


# ---------------------------------------------------------------- the operator


def hot_anchors(rows: DataFrame, total: int) -> np.ndarray:
    """Hashes of the anchors that have more records than a bucket should hold; rows: id, tag, text of `total` bytes."""
    records = 2 * total // (REACH + 1)
    limit = max(HOT, records >> 20)
    if records <= limit:
        return np.zeros(0, np.uint64)
    long = F.octet_length("text") > LONG
    some = rows.select("text", F.when(long, 1).otherwise(SEEN).alias("weight")).where(long | (F.xxhash64("id", "tag") % SEEN == 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, weighted number of its different records) of each block."""
        for batch in batches:
            for b in pieces(batch, "text", BLOCK):
                weights = b.column("weight").to_numpy()
                for _, part, own, lo in blocks(*text_buffer(b.column("text"))):
                    first, windows, anchor, h = block_records(part, own)
                    at = np.unique(record_keys(part, first, windows, anchor, h), return_index=True)[1]
                    which, group = np.unique(h[at], return_inverse=True)
                    n = np.bincount(group, weights[lo + np.searchsorted(own, first[at], side="right") - 1], len(which)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(n)], names=["anchor", "n"])

    counted = some.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return np.sort(np.array([r["anchor"] for r in counted.select("anchor").collect()], np.uint64))


def removed_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __tag, start, end): byte intervals that each document loses; they may overlap. __tag is as in with_tag."""
    docs = docs if "__tag" in docs.columns else with_tag(docs, id_col, text_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("__tag").alias("tag"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_width(docs.sparkSession), 4 * total // BUCKET_BYTES)
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(rows, total))
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs for the buckets (id null), and settled intervals in buckets of their own (-1 - id mod buckets, blob null)."""
        sender = Sender(buckets, hot.value)

        def out():
            (ids, tags, start, end), blobs = sender.flush()
            for at in range(0, len(blobs), 64):
                some = blobs[at : at + 64]
                none = [pa.nulls(len(some)).cast(f.type) for f in list(schema)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary()), *none], schema=schema)
            if len(ids):
                order = np.lexsort((start, tags, ids))
                new = np.ones(len(order), bool)
                new[1:] = (ids[order][1:] != ids[order][:-1]) | (tags[order][1:] != tags[order][:-1])
                own = np.flatnonzero(new)
                i, g, s, e = [], [], [], []
                for lo, hi in zip(own, [*own[1:], len(order)], strict=True):
                    a, b = merged(start[order[lo:hi]], end[order[lo:hi]])
                    i.append(np.full(len(a), ids[order[lo]]))
                    g.append(np.full(len(a), tags[order[lo]]))
                    s.append(a)
                    e.append(b)
                i = np.concatenate(i)
                whole = [pa.array(np.concatenate(x).astype(np.int32)) for x in (g, s, e)]
                yield pa.RecordBatch.from_arrays([pa.array((-1 - i % buckets).astype(np.int32)), pa.nulls(len(i)).cast(pa.binary()), pa.array(i), *whole], schema=schema)

        for batch in batches:
            for b in pieces(batch, "text", BLOCK):
                sender.add(b.column("id").to_numpy(), *text_buffer(b.column("text")), b.column("tag").to_numpy())
                if sender.size >= FLUSH_BYTES:
                    yield from out()
        if sender.parts:
            yield from out()

    def settle(group: pa.Table) -> pa.Table:
        blobs = group.column("blob")
        if blobs.null_count:
            return group.select(["id", "tag", "start", "end"])
        ids, tags, start, end = bucket_intervals(blobs.to_pylist())
        return pa.table({"id": pa.array(ids, pa.int64()), "tag": pa.array(tags, pa.int32()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})

    sent = rows.mapInArrow(send, "bucket int, blob binary, id long, tag int, start int, end int")
    found = staged(sent.groupBy("bucket").applyInArrow(settle, "id long, tag int, start int, end int"), "intervals")
    del sent
    release_shuffles(docs.sparkSession)
    return found.withColumnsRenamed({"id": id_col, "tag": "__tag"})


def release_shuffles(spark) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, kept_sha256) of every document."""
    docs = with_tag(docs.select(id_col, text_col), id_col, text_col)
    lost = removed_intervals(docs, id_col, text_col).groupBy(F.col(id_col).alias("id"), "__tag").agg(F.collect_list(F.struct("start", "end")).alias("lost"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "__tag", F.col(text_col).alias("text")).join(lost, ["id", "__tag"], "left").select("id", "text", "lost")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", 4 << 20):
                buf, off = text_buffer(b.column("text"))
                lists = b.column("lost")
                flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                start, end = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                keep = np.ones(len(buf), bool)
                n_spans = np.zeros(b.num_rows, np.int64)
                for k in np.flatnonzero(np.diff(bounds)):
                    size = off[k + 1] - off[k]
                    s, e = merged(start[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]])
                    s, e = s[s < size], np.minimum(e[s < size], size)
                    n_spans[k] = len(s)
                    for x, y in zip(s + off[k], e + off[k], strict=True):
                        keep[x:y] = False
                kept = [buf[x:y][keep[x:y]].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
                n_bytes = np.diff(off)
                n_kept = np.array([len(x) for x in kept], np.int64)
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_bytes), pa.array(n_bytes - n_kept), pa.array(n_spans), pa.array(kept, pa.binary()), pa.array(sha)], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = rows.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
