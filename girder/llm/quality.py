"""Quality rules: fixed text rules, then bands on the perplexity of a modified Kneser-Ney model.

The model is a character 5-gram model for each language. A character is the low 12 bits of its code point (exact below
U+1000), so a 5-gram is one 60-bit key and a text's start is padded with zeros. Grams are counted in every document: in
all, and in plain texts, those with at most MARKED symbols a word. Counts are summed in each task, then by Spark, and the
model's size follows the corpus. The probabilities come from the plain counts, so texts full of marks do not teach the model to expect
marks; they are joins and windows over the tables of distinct grams, one order after the other. Each gram is scored as if
it had been counted once less (leave one out), so that a text does not vouch for its own characters.

The finished model is a table of keys and costs. While it has at most BROADCAST_GRAMS entries (a count of it is taken first)
it is broadcast as sorted key arrays, one for each language, that a task searches; a larger one is joined with the grams of the
documents, with the same result. MAX_MODELS bounds the languages with a model of their own (the others share one).

A document is rejected where its mean negative log probability leaves its language's band. A mean over n characters varies
by about c / sqrt(n), so the deviation is (mean - median) * sqrt(n) / c with the median and c (from the lower quartile) over all
distinct texts of the language that pass the base rules. At most LOW below and HIGH above are kept. Labelled good documents of sf0.1 lie between -5.3
and 7.5; HIGH rounds this up, LOW leaves twice as much, since copies vouch for each other and a large group of them lies low. A document above its
band is scored again by stretches of STRETCH characters, each under the language whose band fits it best, so that clean text of
several languages stays.

Defined cases: a null text has no words and fails the base rules; a null lang is a language of its own; empty tables
give empty results; repeated rows are judged each on its own; columns besides id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from girder.llm.common import IS_SPACE, mix, per_text, pieces, range_hash, renamed, runs, staged, text_buffer

ORDER, BITS = 5, 12
MAX_MODELS = 128
OTHER = "\x00other"
BROADCAST_GRAMS = 6_000_000
#: Grams that a counting task holds before it sends, and bytes of text that are worked on at a time.
HELD, PIECE = 400_000, 256 << 10
#: The cost of a gram that the model has not seen.
UNSEEN = 14.0
#: Deviations kept on each side, the least c, and the characters of a stretch.
LOW, HIGH, LEAST_UNIT, STRETCH = 10.0, 8.0, 0.5, 64
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Symbols a word up to which a text is plain (the usual symbol-to-word rule of web corpora).
MARKED = 0.1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


# ---------------------------------------------------------------- base rules


def _repeats(key: np.ndarray) -> np.ndarray:
    """True for entries whose key occurs twice or more."""
    if len(key) < 2:
        return np.zeros(len(key), bool)
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(key), bool)
    twice[:-1] |= same
    twice[1:] |= same
    out = np.empty(len(key), bool)
    out[order] = twice
    return out


def base_rules(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each text."""
    n = len(off) - 1
    word = ~IS_SPACE[buf]
    starts, ends = runs(word, off)
    doc = np.searchsorted(off, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=n).astype(np.int64)
    out = {"n_words": n_words, "word_chars": per_text(word & ((buf & 0xC0) != 0x80), off), "n_symbols": per_text(_SYMBOL[buf], off)}

    repeat = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        h = range_hash(buf, starts, ends)
        m = len(h) - WINDOW + 1
        win = np.zeros(m, np.uint64)
        for t in range(WINDOW):
            win = win * np.uint64(0x9E3779B97F4A7C15) + h[t : t + m]
        inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        key = mix(win[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1)))
        hit = inside[_repeats(key)]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n).astype(np.int64)
    out["n_repeat_words"] = repeat

    line_starts, line_ends = runs(buf != 10, off)
    words_before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(word, out=words_before[1:])
    full = words_before[line_ends] > words_before[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc = np.searchsorted(off, line_starts, side="right") - 1
    lines = np.bincount(line_doc, minlength=n)
    key = mix(range_hash(buf, line_starts, line_ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    out["n_dup_lines"] = (lines - np.bincount(line_doc[order][fresh], minlength=n)).astype(np.int64)
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    return out


# ---------------------------------------------------------------- counting


def gram_keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the 5-gram that ends at each character, and the texts' bounds in characters."""
    lead = (buf & 0xC0) != 0x80
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    at = np.flatnonzero(lead)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    last = np.append(at[1:], len(buf)) - 1
    wide = ((buf[np.maximum(last - 1, 0)] & 63).astype(np.int64) << 6) | (buf[last] & 63)
    s = np.where(last == at, np.where(IS_SPACE[buf[at]], 32, buf[at]), wide)
    s = np.maximum(s, 1)
    off = before[off]
    key, length = s.copy(), np.diff(off)
    for d in range(1, ORDER):
        back = np.zeros(len(s), np.int64)
        back[d:] = s[:-d] if d < len(s) else 0
        for k in range(d):
            back[off[:-1][length > k] + k] = 0
        key |= back << (BITS * d)
    return key, off


def _distinct(key: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts, and their counts in plain texts."""
    order = np.argsort(key)
    key, plain = key[order], plain[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    return key[head], np.diff(np.append(head, len(key))), np.add.reduceat(plain.astype(np.int64), head)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if len(parts) == 1:
        return parts[0]
    key, n, m = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, n, m = key[order], n[order], m[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    return key[head], np.add.reduceat(n, head), np.add.reduceat(m, head)


def plain_texts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a text has at most MARKED symbols a word."""
    starts, _ = runs(~IS_SPACE[buf], off)
    words = np.bincount(np.searchsorted(off, starts, side="right") - 1, minlength=len(off) - 1)
    return per_text(_SYMBOL[buf], off) <= MARKED * words


def _by_language(batch: pa.RecordBatch):
    """(language, places of its characters) and all gram keys and bounds of a piece."""
    key, off = gram_keys(*text_buffer(batch.column("text")))
    codes, langs = pd.factorize(np.array(batch.column("lang").fill_null("").to_pylist(), object))
    owner = np.repeat(codes, np.diff(off))
    return key, off, [(lang, slice(None) if len(langs) == 1 else owner == k) for k, lang in enumerate(langs)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's gram counts by language, as sorted arrays."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            found = _summed(parts)
            for k in range(0, len(found[0]), 1 << 16):
                own = [pa.array(x[k : k + (1 << 16)]) for x in found]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(own[0])), *own], names=["lang", "key", "n", "plain"])
        held.clear()

    for batch in batches:
        for b in pieces(batch, "text", PIECE):
            key, off, langs = _by_language(b)
            plain = np.repeat(plain_texts(*text_buffer(b.column("text"))), np.diff(off))
            for lang, own in langs:
                if len(key[own]):
                    held.setdefault(lang, []).append(_distinct(key[own], plain[own]))
                    size += len(held[lang][-1][0])
            if size > HELD:
                for lang in held:
                    held[lang] = [_summed(held[lang])]
                size = sum(len(x[0][0]) for x in held.values())
                if size > HELD // 2:
                    yield from flush()
                    size = 0
    yield from flush()


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, key, n, plain): counts over all documents, and over those of them that are plain."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(_count, "lang string, key long, n long, plain long").groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"))


# ---------------------------------------------------------------- modified Kneser-Ney


def discounts(c: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of grams counted 1 to 4 times; 0.5, 1 and 1.5 where one is missing."""
    if min(c) <= 0:
        return [0.5, 1.0, 1.5]
    y = c[0] / (c[0] + 2 * c[1])
    d = [k - (k + 1) * y * c[k] / c[k - 1] for k in (1, 2, 3)]
    return [float(x) for x in np.clip(d, [0.1, 0.1, 0.1], [0.95, 1.9, 2.9])]


def _discount(a: Column) -> Column:
    return F.when(a <= 0, 0.0).when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))


def _mask(order: int) -> Column:
    return F.lit((1 << (BITS * order)) - 1).cast("long")


def kneser_ney(counts: DataFrame, left_out: int = 1) -> DataFrame:
    """(lang, key, p): the interpolated probability of each counted 5-gram's last character after the four before it.

    Orders below the highest count the characters that stand before a gram. `left_out` is taken off each gram's count.
    """
    spark = counts.sparkSession
    level = {ORDER: counts.select("lang", "key", F.col("n").alias("a"))}
    for order in range(ORDER - 1, 0, -1):
        shorter = level[order + 1].select("lang", F.col("key").bitwiseAND(_mask(order)).alias("key"))
        level[order] = staged(shorter.groupBy("lang", "key").agg(F.count("*").alias("a")), f"order{order}")
    met = [F.count(F.when(F.col("a") == k, 1)).alias(f"c{k}") for k in range(1, 5)]
    rows = []
    for order, table in level.items():  # one row for each language with a model
        rows += [(order, r["lang"], *discounts([r[f"c{k}"] for k in range(1, 5)])) for r in table.groupBy("lang").agg(*met).collect()]
    known = spark.createDataFrame(rows, "order int, lang string, d1 double, d2 double, d3 double")
    found = None
    for order in range(1, ORDER + 1):
        same = Window.partitionBy("lang", "context")
        own = level[order].join(F.broadcast(known.where(F.col("order") == order).drop("order")), "lang")
        own = own.withColumn("context", F.shiftright("key", BITS))
        own = own.withColumns({"total": F.sum("a").over(same) - left_out, "mass": F.sum(_discount(F.col("a"))).over(same)})
        less = F.col("a") - left_out
        mass = F.col("mass") - _discount(F.col("a")) + _discount(less)
        if found is None:
            own = own.withColumn("below", F.lit(1.0 / (1 << BITS)))
        else:
            own = own.withColumn("lower", F.col("key").bitwiseAND(_mask(order - 1)))
            own = own.join(found.select("lang", F.col("key").alias("lower"), F.col("p").alias("below")), ["lang", "lower"])
        p = F.greatest(less - _discount(less), F.lit(0.0)) / F.col("total") + mass / F.col("total") * F.col("below")
        found = own.select("lang", "key", F.when(F.col("total") > 0, p).otherwise(F.col("below")).alias("p"))
        if order < ORDER:
            found = staged(found, f"p{order}")
    return found


def fit_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, key, cost): the negative log probability of every 5-gram of the corpus."""
    counts = staged(gram_counts(docs, text_col, lang_col), "grams")
    top = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_MODELS + 1)
    own = [r["lang"] for r in top.collect()]
    if len(own) > MAX_MODELS:
        shared = F.when(F.col("lang").isin(own[: MAX_MODELS - 1]), F.col("lang")).otherwise(F.lit(OTHER))
        counts = staged(counts.groupBy(shared.alias("lang"), "key").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain")), "pooled")
    trusted = counts.where("plain > 0").select("lang", "key", F.col("plain").alias("n"))
    cost = -F.log(F.greatest(F.col("p"), F.lit(1e-6)))
    return staged(kneser_ney(trusted).select("lang", "key", cost.cast("float").alias("cost")), "model")


def _sorted_arrays(pdf: pd.DataFrame) -> pd.DataFrame:
    """One language: its sorted key array and the costs beside it."""
    pdf = pdf.sort_values("key")
    return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "keys": [pdf["key"].to_numpy("<i8").tobytes()], "costs": [pdf["cost"].to_numpy("<f4").tobytes()]})


def packed(model: DataFrame) -> dict[str, tuple[bytes, bytes]]:
    """Sorted keys and costs by language, of a model of at most BROADCAST_GRAMS entries."""
    rows = model.groupBy("lang").applyInPandas(_sorted_arrays, "lang string, keys binary, costs binary").collect()
    return {r["lang"]: (bytes(r["keys"]), bytes(r["costs"])) for r in rows}


class Scorer:
    """Looks the grams of texts up in sorted arrays."""

    def __init__(self, models: dict[str, tuple[bytes, bytes]]):
        self.tables = {k: (np.frombuffer(a, "<i8"), np.frombuffer(b, "<f4")) for k, (a, b) in models.items()}

    def costs(self, lang: str, key: np.ndarray) -> np.ndarray:
        keys, costs = self.tables.get(lang, self.tables.get(OTHER, (np.zeros(0, np.int64), np.zeros(0, np.float32))))
        if not len(keys):
            return np.full(len(key), UNSEEN)
        own, inverse = np.unique(key, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return np.where(keys[at] == own, costs[at], UNSEEN)[inverse]

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """Mean negative log probability of each text's characters (0 for an empty text)."""
        key, off, langs = _by_language(batch)
        total = np.zeros(len(key) + 1)
        for lang, own in langs:
            total[1:][own] = self.costs(lang, key[own])
        total = np.cumsum(total)
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off), 1)


_scorers: dict[str, Scorer] = {}


def _scorer(shared) -> Scorer:
    """One scorer for each broadcast in a worker process."""
    if shared.value["id"] not in _scorers:
        _scorers.clear()
        _scorers[shared.value["id"]] = Scorer(shared.value["models"])
    return _scorers[shared.value["id"]]


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, cost double"


NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _judge(batch: pa.RecordBatch, scorer: Scorer) -> dict[str, np.ndarray]:
    return base_rules(*text_buffer(batch.column("text"))) | {"cost": scorer(batch)}


def _inputs(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _share(docs: DataFrame, **what):
    import uuid

    return docs.sparkSession.sparkContext.broadcast({"id": uuid.uuid4().hex, **what})


def _shared_model(docs: DataFrame, model: DataFrame, limit: int):
    """The broadcast model, or None where it is too large."""
    return _share(docs, models=packed(model)) if model.count() <= limit else None


def score_documents(rows: DataFrame, model: DataFrame, shared) -> DataFrame:
    """The rules' figures and the mean negative log probability of every row of _inputs."""
    if shared is None:
        return _score_by_join(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                found = _judge(b, _scorer(shared))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), b.column("mark"), *[pa.array(found[c]) for c in NAMES]], names=["id", "lang", "mark", *NAMES])

    return rows.mapInArrow(run, f"id long, lang string, mark long, {COLUMNS}")


def _gram_lists(parts: list[np.ndarray]) -> list[pa.Array]:
    """Distinct keys and their counts, as one list for each part."""
    parts = [np.unique(key, return_counts=True) for key in parts]
    bounds = pa.array(np.cumsum([0, *[len(k) for k, _ in parts]]), pa.int32())
    return [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]), pa.int64())) for k in (0, 1)]


def _score_by_join(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The same for a model of any size: each document's distinct grams meet the model in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                found = base_rules(*text_buffer(b.column("text"))) | {"cost": np.zeros(b.num_rows)}
                key, off, _ = _by_language(b)
                lists = _gram_lists([key[x:y] for x, y in zip(off[:-1], off[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), b.column("mark"), *[pa.array(found[c]) for c in NAMES], *lists], names=["id", "lang", "mark", *NAMES, "keys", "counts"])

    rows = rows.mapInArrow(run, f"id long, lang string, mark long, {COLUMNS}, keys array<long>, counts array<long>")
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()), "grams_of")
    known = [r["lang"] for r in model.select("lang").distinct().limit(MAX_MODELS + 1).collect()]
    named = F.when(F.col("lang").isin(known), F.col("lang")).otherwise(F.lit(OTHER)).alias("lang")
    grams = rows.select("__row", named, F.inline(F.arrays_zip("keys", "counts"))).withColumnRenamed("keys", "key")
    cost = F.sum(F.col("counts") * F.coalesce("cost", F.lit(UNSEEN))) / F.sum("counts")
    costs = grams.join(model, ["lang", "key"], "left").groupBy("__row").agg(cost.alias("mean"))
    out = rows.join(costs, "__row", "left").withColumn("cost", F.coalesce("mean", F.lit(0.0)))
    return out.select("id", "lang", "mark", *NAMES)


def _few(found: DataFrame) -> DataFrame:
    """Up to MAX_MODELS bands are broadcast, so that a hot language is not one join key's work."""
    return F.broadcast(found) if found.count() <= MAX_MODELS else found


def bands(scores: DataFrame) -> DataFrame:
    """(lang, mid, unit): the median cost and c, from approximate quartiles over all documents that pass the base rules.

    Equal texts have equal figures and count once. Junk lies above the median, so c is read from the lower half.
    """
    rows = scores.where("not base_failed").select("lang", "word_chars", F.round("cost", 6).alias("cost")).distinct()
    rows = staged(rows, "costs")
    mids = staged(rows.groupBy("lang").agg(F.percentile_approx("cost", 0.5, 10_000).alias("mid")), "mids")
    off = (F.col("mid") - F.col("cost")) * F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    found = rows.join(_few(mids), "lang").groupBy("lang").agg(F.first("mid").alias("mid"), F.percentile_approx(off, 0.75, 10_000).alias("q"))
    return found.select("lang", "mid", F.greatest(F.col("q") / 0.6745, F.lit(LEAST_UNIT)).alias("unit"))


def stretch_excess(scorer: Scorer, limits: dict[str, tuple[float, float]], key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each text's mean excess over the median in units of c, where each stretch counts under the language that fits it best."""
    starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(x, y, STRETCH) for x, y in zip(off[:-1], off[1:], strict=True)]])
    if not len(starts):
        return np.zeros(len(off) - 1)
    size, least = np.diff(np.append(starts, len(key))), np.full(len(starts), np.inf)
    for lang, (mid, unit) in limits.items():
        if lang in scorer.tables:
            least = np.minimum(least, (np.add.reduceat(scorer.costs(lang, key), starts) - mid * size) / unit)
    doc = np.searchsorted(off, starts, side="right") - 1
    return np.bincount(doc, least, len(off) - 1) / np.maximum(np.diff(off), 1)


def _excess(over: DataFrame, found: DataFrame, model: DataFrame, shared) -> DataFrame:
    """(id, lang, mark, excess) of the rows of _inputs that left their band above."""
    named = [r["lang"] for r in model.select("lang").distinct().collect()]  # at most MAX_MODELS
    limits = {r["lang"]: (r["mid"], r["unit"]) for r in found.where(F.col("lang").isin(named)).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                got = stretch_excess(_scorer(shared), limits, *gram_keys(*text_buffer(b.column("text"))))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), b.column("mark"), pa.array(got)], names=["id", "lang", "mark", "excess"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                key, off = gram_keys(*text_buffer(b.column("text")))
                parts = [[key[k : min(k + STRETCH, y)] for k in range(x, y, STRETCH)] for x, y in zip(off[:-1], off[1:], strict=True)]
                rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(p)) for p in parts]])
                lists = _gram_lists([x for p in parts for x in p])
                head = [b.column(c).take(pa.array(rows)) for c in ("id", "lang", "mark")]
                yield pa.RecordBatch.from_arrays([*head, pa.array(at), *lists], names=["id", "lang", "mark", "stretch", "keys", "counts"])

    if shared is not None:
        return over.mapInArrow(run, "id long, lang string, mark long, excess double")
    rows = over.mapInArrow(cut, "id long, lang string, mark long, stretch long, keys array<long>, counts array<long>")
    grams = rows.select("id", "lang", "mark", "stretch", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"), F.inline(F.arrays_zip("keys", "counts"))).withColumnRenamed("keys", "key")
    under = over.sparkSession.createDataFrame([(k, *v) for k, v in limits.items()], "under string, mid double, unit double")
    costs = grams.crossJoin(F.broadcast(under)).join(model.select(F.col("lang").alias("under"), "key", "cost"), ["under", "key"], "left")
    total = F.sum(F.col("counts") * F.coalesce("cost", F.lit(UNSEEN)))
    each = costs.groupBy("id", "lang", "mark", "stretch", "size", "under").agg(((total - F.first("mid") * F.col("size")) / F.first("unit")).alias("x"))
    best = each.groupBy("id", "lang", "mark", "stretch", "size").agg(F.min("x").alias("x"))
    return best.groupBy("id", "lang", "mark").agg((F.sum("x") / F.sum("size")).alias("excess"))


def _verdicts(docs: DataFrame, model: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int) -> DataFrame:
    """Every row's figures, deviation and verdict `kept`, by id."""
    inputs, shared = _inputs(docs, id_col, text_col, lang_col), _shared_model(docs, model, limit)
    scores = staged(score_documents(inputs, model, shared), "quality")
    found = staged(bands(scores), "bands")
    root = F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    rows = scores.join(_few(found), "lang", "left").withColumn("deviation", (F.col("cost") - F.col("mid")) * root / F.col("unit"))
    over = staged(rows.where(~F.col("base_failed") & (F.col("deviation") > HIGH)).select("id", "lang", "mark").distinct(), "over")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "lang", "mark")]
    again = inputs.alias("a").join(over.alias("b"), same, "left_semi").dropDuplicates(["id", "lang", "mark"])
    again = staged(_excess(again, found, model, shared), "excess")
    rows = rows.alias("a").join(again.alias("b"), same, "left").select("a.*", F.least("deviation", F.col("excess") * root).alias("above"))
    inside = (F.col("deviation") >= -LOW) & (F.col("above") <= HIGH)
    rows = rows.withColumn("perplexity", F.exp("cost")).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return rows.drop("mark").withColumnRenamed("id", id_col)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = BROADCAST_GRAMS) -> DataFrame:
    """Every document with the rules' figures, its perplexity, its deviation and the verdict `kept`."""
    return _verdicts(docs, fit_model(docs, text_col, lang_col), id_col, text_col, lang_col, limit)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = BROADCAST_GRAMS) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns.

    With a broadcast model each text is judged once: rows are written with their language, rule and cost, the bands come from
    these columns, and rows inside their band are read back by a filter. Only rows above it are scored again, by stretches. A
    larger model's verdicts are joined to numbered rows. Texts are never shuffled. Columns may have any names.
    """
    docs, names = renamed(docs)
    return _keep_good(docs, names[text_col], names[lang_col], limit).toDF(*names)


def _keep_good(docs: DataFrame, text_col: str, lang_col: str, limit: int) -> DataFrame:
    model = fit_model(docs, text_col, lang_col)
    languages = model.select("lang").distinct().count()
    if model.count() > limit or languages >= MAX_MODELS:
        rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        judged = _verdicts(rows, model, "__row", text_col, lang_col, limit)
        return rows.join(judged.where("kept").select("__row"), "__row", "left_semi").drop("__row")
    shared = _shared_model(docs, model, limit)
    judged = _judged_rows(docs, shared, text_col, lang_col)
    found = bands(judged.select(F.col("__lang").alias("lang"), F.col("__failed").alias("base_failed"), F.col("__chars").alias("word_chars"), F.col("__cost").alias("cost")))
    limits = {r["lang"]: (r["mid"], r["unit"]) for r in found.collect()}  # fewer than MAX_MODELS rows
    lines = docs.sparkSession.createDataFrame([(k, *v) for k, v in limits.items()], "__lang string, __mid double, __unit double")
    root = F.sqrt(F.greatest(F.col("__chars"), F.lit(1)))
    rows = judged.where(~F.col("__failed")).join(F.broadcast(lines), "__lang", "left").withColumn("__deviation", (F.col("__cost") - F.col("__mid")) * root / F.col("__unit"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    inside = rows.where(F.coalesce(F.col("__deviation").between(-LOW, HIGH), F.lit(True))).select(*own)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text_col, PIECE):
                excess = stretch_excess(_scorer(shared), limits, *gram_keys(*text_buffer(b.column(text_col))))
                chars = base_rules(*text_buffer(b.column(text_col)))["word_chars"]
                yield b.filter(pa.array(excess * np.sqrt(np.maximum(chars, 1)) <= HIGH))

    return inside.union(rows.where(F.col("__deviation") > HIGH).select(*own).mapInArrow(fits, docs.schema))


def _judged_rows(docs: DataFrame, shared, text_col: str, lang_col: str) -> DataFrame:
    """docs with __lang, __failed, __chars and __cost, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, text_col, PIECE):
                langs = b.column(lang_col).cast(pa.string()).fill_null("")
                found = _judge(pa.RecordBatch.from_arrays([b.column(text_col), langs], names=["text", "lang"]), _scorer(shared))
                more = [langs, *[pa.array(found[c]) for c in ("base_failed", "word_chars", "cost")]]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "__lang", "__failed", "__chars", "__cost"])

    added = StructType([StructField("__lang", StringType()), StructField("__failed", BooleanType()), StructField("__chars", LongType()), StructField("__cost", DoubleType())])
    return staged(docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields])), "judged")
