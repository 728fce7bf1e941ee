"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius.

Candidates come from the pigeonring principle. The 64 bits are a ring of SEGMENTS segments. If two fingerprints
differ in at most r bits, some start on the ring has a chain in which the first l segments differ in at most
l * r / SEGMENTS bits for every l. With r = 4 and five segments the proportional budgets are 0, 1, 2, 3, 4: the first segment
is equal and the second differs in one bit at most, so each fingerprint is filed under its five two-segment keys and
looked up under those and their one-bit variants in the second segment (26 bits select, so a bucket holds few strangers).
Longer chains are then held to their budgets before the full Hamming check.

A group of near copies could fill a bucket, so pairs inside a bucket are not made:
1. each looked-up fingerprint meets only the bucket's least fingerprint (a pre-aggregated star), which settles every
   bucket that files a single fingerprint;
2. these links are contracted to components; a bucket all of whose fingerprints have one component is settled too;
3. in the remaining buckets, fingerprints are compared exactly, but only across components: those outside the bucket's most
   common component meet everything of other components there, so the members of one large group never meet each other.
Equal fingerprints are one vertex from the start, so exact copies cost nothing until components are handed back to documents;
there the fingerprints of more than a thousandth of all rows (so fewer than a thousand) are broadcast and the others joined.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; rows without an id get a fingerprint
but a null component; rows that repeat an id each keep their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import IS_SPACE, LOWER, pieces, runs, staged, text_buffer
from girder.llm.components import connected_components

SEGMENTS = (13, 13, 13, 13, 12)
RADIUS = 4
_STARTS = tuple(sum(SEGMENTS[:k]) for k in range(len(SEGMENTS)))

# ---------------------------------------------------------------- XXH64 over byte ranges
# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, word):
    return _rot(acc + word * P2, 31) * P1


def xxh64_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[s:e] for all ranges, a length at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    words = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    length = ends - starts
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    bounds = [*first.tolist(), len(order)]
    for size, lo, hi in zip(sizes.tolist(), bounds, bounds[1:], strict=False):
        rows = order[lo:hi]
        at, left = starts[rows], size
        if size >= 32:
            seeds = (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))
            acc = [np.full(len(rows), x % (1 << 64), np.uint64) for x in seeds]
            while left >= 32:
                acc = [_round(a, words[at + 8 * k]) for k, a in enumerate(acc)]
                at, left = at + 32, left - 32
            h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.uint64(0), a)) * P1 + P4
        else:
            h = np.full(len(rows), (seed + int(P5)) % (1 << 64), np.uint64)
        h = h + np.uint64(size)
        while left >= 8:
            h = _rot(h ^ _round(np.uint64(0), words[at]), 27) * P1 + P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rot(h ^ ((words[at] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at, left = at + 4, left - 4
        while left:
            h = _rot(h ^ (padded[at].astype(np.uint64) * P5), 11) * P1
            at, left = at + 1, left - 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


# ---------------------------------------------------------------- fingerprints


def _normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased bytes with one space before each word; word starts, ends and texts."""
    starts, ends = runs(~IS_SPACE[buf], off)
    doc = np.searchsorted(off, starts, side="right") - 1
    length = ends - starts
    new_ends = np.cumsum(length + 1)
    new_starts = new_ends - length
    out = np.full(int(new_ends[-1]) if len(new_ends) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[new_starts - 1] = False
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    out[inside] = LOWER[buf[np.cumsum(edge[:-1], dtype=np.int8) > 0]]
    return out, new_starts, new_ends, doc


def fingerprints(buf: np.ndarray, off: np.ndarray, words: int = 4, seed: int = 42, step: int = 1 << 18) -> np.ndarray:
    """The fingerprint of each text, as uint64. A bit is 1 if it is set in over half the shingle hashes."""
    n = len(off) - 1
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    text, starts, ends, doc = _normal(buf, off)
    if len(starts):
        count = np.bincount(doc, minlength=n)
        last = np.cumsum(count) - 1  # of each text's words
        close = np.minimum(np.arange(len(starts)) + words - 1, last[doc])
        whole = np.arange(len(starts)) + words - 1 <= last[doc]
        whole[(last - count + 1)[(count > 0) & (count < words)]] = True
        pick = np.flatnonzero(whole)
        for at in range(0, len(pick), step):
            p = pick[at : at + step]
            h = xxh64_ranges(text, starts[p], ends[close[p]], seed)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            d = doc[p]
            cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            ones[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
            total += np.bincount(d, minlength=n)
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) for every document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                fp = fingerprints(*text_buffer(b.column("text")), words)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- pigeonring


def _segment(fp: Column, k: int) -> Column:
    k %= len(SEGMENTS)
    return F.shiftrightunsigned(fp, _STARTS[k]).bitwiseAND(F.lit((1 << SEGMENTS[k]) - 1))


def _pair_key(fp: Column, k: int) -> Column:
    """Start, first and second segment of a chain, as one number."""
    width = SEGMENTS[(k + 1) % len(SEGMENTS)]
    return F.shiftleft(F.shiftleft(F.lit(k).cast("long"), 13).bitwiseOR(_segment(fp, k)), width).bitwiseOR(_segment(fp, k + 1)).bitwiseOR(F.lit(k << 40))


def _filed(fps: DataFrame) -> DataFrame:
    keys = F.array(*[_pair_key(F.col("fp"), k) for k in range(len(SEGMENTS))])
    return fps.select("fp", F.explode(keys).alias("key"))


def _looked_up(fps: DataFrame) -> DataFrame:
    keys = []
    for k in range(len(SEGMENTS)):
        own = _pair_key(F.col("fp"), k)
        keys += [own, *[own.bitwiseXOR(F.lit(1 << b)) for b in range(SEGMENTS[(k + 1) % len(SEGMENTS)])]]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _within(a: str, b: str, radius: int = RADIUS) -> Column:
    """Some chain of segments within its proportional budgets, then the full check."""
    x = F.col(a).bitwiseXOR(F.col(b))
    d = [F.bit_count(_segment(x, k)) for k in range(len(SEGMENTS))]
    chains = F.lit(False)
    for k in range(len(SEGMENTS)):
        chain, total = F.lit(True), F.lit(0)
        for step in range(3):
            total = total + d[(k + step) % len(SEGMENTS)]
            chain = chain & (total <= F.lit((step + 1) * radius // len(SEGMENTS)))
        chains = chains | chain
    return chains & (F.bit_count(x) <= radius)


def link_components(fps: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints `fps` that have a link."""
    filed, probes = _filed(fps), _looked_up(fps)
    # a bucket's least fingerprint and whether it files others; as many as fingerprints, so never broadcast
    heads = filed.groupBy("key").agg(F.min("fp").alias("head"), F.max("fp").alias("most")).hint("merge")
    met = probes.join(heads, "key").where(F.col("head") != F.col("fp")).where(_within("fp", "head") | (F.col("head") != F.col("most")))
    met = staged(met.select("key", "fp", "head", (F.col("head") != F.col("most")).alias("mixed"), _within("fp", "head").alias("near")), "met")
    edges = met.where("near").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    roots = connected_components(edges)

    # buckets that file several fingerprints, with everything that looks there (the heads included)
    mixed = met.where("mixed")
    looking = mixed.select("key", "fp").union(mixed.groupBy("key").agg(F.first("head").alias("fp")))
    labelled = looking.join(roots, looking["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    labelled = staged(labelled.withColumn("filed", _is_filed("fp", "key")), "looking")
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    open_keys = sizes.agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.count("*").alias("roots")).where("roots > 1").select("key", "common")
    there = labelled.join(open_keys, "key")
    left, right = there.where("root <> common").alias("l"), there.hint("merge").alias("r")
    apart = (F.col("l.root") != F.col("r.root")) & (F.col("l.filed") | F.col("r.filed"))
    across = left.join(right, (F.col("l.key") == F.col("r.key")) & apart & _within("l.fp", "r.fp"))
    more = staged(across.select(F.col("l.root").alias("a"), F.col("r.root").alias("b")).distinct(), "across")
    if more.isEmpty():
        return roots.select(F.col("node").alias("fp"), "root")
    upper = connected_components(more)
    alone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    nodes = roots.select("node", "root").union(alone.select("node", F.col("node").alias("root")))
    final = nodes.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return final.select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("root"))


def _is_filed(fp: str, key: str) -> Column:
    """Whether the key is one of the fingerprint's own (not a variant)."""
    own = F.lit(False)
    for k in range(len(SEGMENTS)):
        own = own | (F.col(key) == _pair_key(F.col(fp), k))
    return own


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp, component_id): the least id that a chain of links reaches, for every document."""
    rows = staged(fingerprint_rows(docs, id_col, text_col, words), "fingerprints")
    least = staged(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = staged(link_components(least.select("fp")), "roots")
    linked = roots.join(least, "fp")
    tops = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = linked.select("fp", "root").join(tops, "root").select("fp", "component_id")
    by_fp = staged(least.join(by_fp, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "by_fingerprint")
    hot = F.col("n") * 1000 > F.lit(rows.count())
    few = F.broadcast(by_fp.where(hot).drop("n"))
    out = rows.join(few, "fp").union(rows.join(few, "fp", "left_anti").join(by_fp.where(~hot).drop("n"), "fp", "left"))
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the least id of each component, with all its columns. Rows without an id stay; of equal ids one row stays.

    Where ids repeat, rows are numbered. An id's row is the first in the component whose least id it is, or else its first row;
    then each component keeps the row of its least id among these.
    """
    found = staged(near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("component_id").alias("__top")), "components")
    known = found.where(F.col("__id").isNotNull())
    if known.groupBy("__id").count().where("count > 1").isEmpty():
        keep = known.where(F.col("__id") == F.col("__top")).select("__id")
        return docs.join(keep, F.col(id_col) == F.col("__id"), "left_semi").union(docs.where(F.col(id_col).isNull()))
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    tops = near_duplicates(rows, "__row", text_col).select("__row", F.col("component_id").alias("__component"))
    named = rows.select("__row", F.col(id_col).cast("long").alias("__id")).where("__id is not null").join(tops, "__row")
    named = staged(named, "rows_of_ids")
    least = named.groupBy("__component").agg(F.min("__id").alias("__top"))
    first = F.min(F.struct((F.col("__id") != F.col("__top")).alias("other"), "__row", "__component")).alias("x")
    own = named.join(least, "__component").groupBy("__id").agg(first).select("__id", "x.__row", "x.__component")
    keep = own.groupBy("__component").agg(F.min(F.struct("__id", "__row")).alias("x")).select("x.__row")
    kept = rows.join(keep, "__row", "left_semi").select(*docs.columns)
    return kept.union(rows.where(F.col(id_col).isNull()).select(*docs.columns))
