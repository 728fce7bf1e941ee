"""Line dedup: range-partitioned line hashes, streamed in order, give compressed keep bitmaps.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of `min_chars` code
points or more that are found in `min_docs` documents or more lose every line but those of the
largest document id.

Plan: one row (two 64-bit hashes, id, position) for each long line; one range shuffle on
(hash, id descending), so a line that a third of the corpus holds is spread over many partitions;
each partition streams its sorted rows and decides the keys that lie inside it; the at most two keys
that touch a partition's ends are decided by a second, pre-aggregated pass. Text never moves here.

Defined cases: a null text is one empty line; rows without an id keep all lines and are not counted;
rows that share an id count as one document, and each text of theirs
has its own bitmap (by id and __tag, see common.with_tag); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import ascii_lower, staged, with_tag

SPACE = " \t\n\x0b\x0c\r"


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, tag, pos, n_lines) for each line whose key has min_chars code points or more."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("__tag").alias("tag"), lines.alias("lines"))
    rows = rows.select("id", "tag", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.where(F.char_length("line") >= min_chars).select("id", "tag", "n_lines", "pos", F.btrim("line", F.lit(SPACE)).alias("key"))
    rows = rows.where(F.char_length("key") >= min_chars).select("id", "tag", "n_lines", "pos", ascii_lower(F.col("key")).alias("key"))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"), "id", "tag", "pos", "n_lines")


def _decide(h1, h2, ids, min_docs: int) -> np.ndarray:
    """Which rows of whole, sorted groups are dropped; ids descend inside a group."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    other = new.copy()
    other[1:] |= ids[1:] != ids[:-1]
    n_docs = np.bincount(group, weights=other)
    return (n_docs[group] >= min_docs) & (ids != ids[head][group])


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted. Yields dropped lines (open=False) and all lines of the keys at either end (open=True)."""
    names = ["h1", "h2", "id", "tag", "pos", "n_lines"]
    schema = pa.schema([(n, pa.int64() if n in ("h1", "h2", "id") else pa.int32()) for n in names] + [("open", pa.bool_())])

    def out(cols, is_open):
        arrays = [pa.array(c) for c in cols] + [pa.array(np.full(len(cols[0]), is_open))]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    first, held = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if first is None:
            first = (cols[0][0], cols[1][0])
        lead = 0
        if held is None:  # still inside the partition's first key
            differs = np.flatnonzero((cols[0] != first[0]) | (cols[1] != first[1]))
            lead = int(differs[0]) if len(differs) else batch.num_rows
            if lead:
                yield out([c[:lead] for c in cols], True)
            if lead == batch.num_rows:
                continue
            held = [c[lead:] for c in cols]
        else:
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        tail = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        cut = int(tail[-1]) + 1 if len(tail) else 0
        if cut:
            drop = _decide(held[0][:cut], held[1][:cut], held[2][:cut], min_docs)
            if drop.any():
                yield out([c[:cut][drop] for c in held], False)
            held = [c[cut:] for c in held]
    if held is not None:
        yield out(held, True)


def keep_bitmap(n_lines: int, dropped) -> bytes:
    keep = np.ones(n_lines, bool)
    at = np.asarray(dropped, np.int64)
    keep[at[at < n_lines]] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(n_lines: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("n_lines").to_pylist()
        dropped = b.column("dropped").to_pylist()
        maps = [keep_bitmap(x, d) for x, d in zip(n, dropped, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("tag"), b.column("n_lines"), pa.array([len(d) for d in dropped], pa.int32()), pa.array(maps, pa.binary())],
            names=["id", "tag", "n_lines", "n_dropped", "keep_bitmap"],
        )


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, __tag, n_lines, n_dropped, keep_bitmap) for each text that loses a line; the others keep all theirs.

    keep_bitmap is zlib-compressed, one bit for each line, most significant first; see kept_lines().
    """
    docs = docs if "__tag" in docs.columns else with_tag(docs.select(id_col, text_col), id_col, text_col)
    order = [F.col("h1"), F.col("h2"), F.col("id").desc()]
    rows = line_rows(docs, id_col, text_col, min_chars).repartitionByRange(*order).sortWithinPartitions(*order, F.col("pos"))
    rows = staged(rows.mapInArrow(lambda b: _stream(b, min_docs), "h1 long, h2 long, id long, tag int, pos int, n_lines int, open boolean"), "lines")
    ends = rows.where("open")
    found = ends.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    # two keys a partition at most, so the broadcast is bounded by the number of partitions
    found = F.broadcast(found.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    late = ends.join(found, ["h1", "h2"]).where(F.col("id") != F.col("keeper"))
    dropped = rows.where("not open").select("id", "tag", "pos", "n_lines").union(late.select("id", "tag", "pos", "n_lines"))
    dropped = dropped.groupBy("id", "tag").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    out = dropped.mapInArrow(_bitmaps, "id long, tag int, n_lines int, n_dropped int, keep_bitmap binary")
    return out.withColumnsRenamed({"id": id_col, "tag": "__tag"})


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept): each document's remaining lines, joined by newlines."""
    docs = docs if "__tag" in docs.columns else with_tag(docs.select(id_col, text_col), id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), "__tag", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(bitmaps.select(F.col(id_col).alias("id"), "__tag", "n_dropped", "keep_bitmap"), ["id", "__tag"], "left").drop("__tag")

    def cut(batches):
        for b in batches:
            texts, maps, n_lines, kept = b.column("text").to_pylist(), b.column("keep_bitmap").to_pylist(), [], []
            for t, m in zip(texts, maps, strict=True):
                n_lines.append(t.count("\n") + 1)
                if m is not None:
                    lines = t.split("\n")
                    keep = kept_lines(len(lines), m)
                    t = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
                kept.append(t)
            dropped = b.column("n_dropped").fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_lines, pa.int64()), dropped, pa.array(kept, pa.string())], names=["id", "n_lines", "n_dropped", "kept"])

    return rows.mapInArrow(cut, "id long, n_lines long, n_dropped long, kept string").withColumnRenamed("id", id_col)
