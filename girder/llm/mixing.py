"""Mixing sources to target weights by iterative proportional fitting.

Token weights of (source, language, topic) cells are raked to target marginals of the three; the documents of
a cell are then kept with the cell's calibrated probability.

A document's tokens are its words. Without a topic column, a document's topic is the form of its text, which any corpus
has: "table", "marked", "numeric", "dialogue" or "prose" (see form_of). Default targets are tempered shares: each
value's share of tokens to the power `temper`, normalised, which lifts rare values and lowers a hot source.

Plan: one pass aggregates tokens by cell, with partial sums before the shuffle, so a source with a third of all rows costs
nothing extra. Words and forms are counted over the texts' bytes in Arrow batches. Cells number at most sources x languages x topics; while there are at most CELL_LIMIT they are raked on
the driver, beyond that by the same rounds as joins and aggregates. Documents are sampled in place by a hash of their id: the
result does not depend on partitions, and texts are not shuffled.

Targets that the cells cannot meet (a value without tokens, or shares that exclude each other) are met as far as ROUNDS rounds go; the largest
gap is warned of, and achieved() lists all.

Defined cases: null source, language or text count as a value of their own, "" and no tokens; cells without tokens are kept
whole; rows without an id are kept or not by the hash of null, all alike; repeated rows share their id's fate; an
empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import IS_SPACE, renamed, staged, text_buffer

DIMENSIONS = ("source", "lang", "topic")
#: The columns that mix() adds.
ADDED = ("__source", "__lang", "__topic", "__n", "__p", "__kept")
CELL_LIMIT = 50_000
ROUNDS, TOLERANCE = 50, 1e-6
#: The largest distance from a target share that is not warned of.
REPORTED = 1e-3


#: Marks by class: 1 of tables, 2 of markup, 3 digits, 4 of dialogue; 5 are bytes inside a character.
_MARKS = np.zeros(256, np.uint8)
for _k, _marks in enumerate(("|\t", "#*$%&<>{}=", "0123456789", '?"'), 1):
    _MARKS[[ord(c) for c in _marks]] = _k
_MARKS[128:192] = 5
FORMS = ("prose", "table", "marked", "numeric", "dialogue")
_LEAST = np.array([0.02, 0.02, 0.1, 0.01])


def form_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Words and form of each text: the first class of marks that exceeds its share of the characters, else prose."""
    word = ~IS_SPACE[buf]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    edge = off[:-1][off[:-1] < len(buf)]
    starts[edge] = word[edge]
    mark = _MARKS[buf]
    n, forms = np.zeros(len(off) - 1, np.int64), []
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        n[k] = np.count_nonzero(starts[a:b])
        c = np.bincount(mark[a:b], minlength=6)
        over = c[1:5] > _LEAST * max(b - a - c[5], 1)
        forms.append(FORMS[int(np.argmax(over)) + 1 if over.any() else 0])
    return n, forms


def _token_form(text: pa.Array) -> pa.Array:
    """Tokens and topic of each text, from its bytes."""
    n, forms = form_of(*text_buffer(text))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(forms, pa.string())], ["n", "topic"])


def with_cells(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """docs with __source, __lang, __topic and __n."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    token_form = F.arrow_udf(_token_form, "struct<n:long,topic:string>")
    rows = docs.withColumn("__form", token_form(F.col(text_col)))
    cells = {"__source": value(source_col), "__lang": value(lang_col), "__topic": topic if topic is not None else F.col("__form.topic"), "__n": F.col("__form.n")}
    return rows.withColumns(cells).drop("__form")


def tempered(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """(value, target): each value's tempered share of tokens."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("n").cast("double"), F.lit(temper)).alias("p"))
    total = sums.agg(F.sum("p").alias("total"))
    return sums.join(F.broadcast(total)).select("value", (F.col("p") / F.col("total")).alias("target"))


def _rake_on_driver(rows: list, targets: dict[str, dict[str, float]]) -> list[float]:
    w = np.array([float(r["n"]) for r in rows])
    w /= max(w.sum(), 1.0)
    coded = {}
    for d in DIMENSIONS:
        names, code = np.unique(np.array([r[d] for r in rows], object).astype(str), return_inverse=True)
        coded[d] = (code, np.array([targets[d].get(x, 0.0) for x in names]))
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in coded.values():
            now = np.bincount(code, weights=w, minlength=len(target))
            factor = np.divide(target, now, out=np.ones_like(target), where=now > 0)
            worst = max(worst, float(np.abs(now - target).max()))
            w *= factor[code]
        if worst < TOLERANCE:
            break
    return w.tolist()


def _rake_as_jobs(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    total = cells.agg(F.sum("n").cast("double")).first()[0] or 1.0
    out = cells.withColumn("w", F.col("n") / F.lit(total))
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            now = out.groupBy(d).agg(F.sum("w").alias("now"))
            goal = targets[d].withColumnRenamed("value", d)
            factor = staged(now.join(goal, d, "left").select(d, "now", F.coalesce("target", F.lit(0.0)).alias("target")), "factor")
            worst = max(worst, factor.agg(F.max(F.abs(F.col("now") - F.col("target")))).first()[0] or 0.0)
            ratio = F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(1.0)
            out = staged(out.join(factor, d).withColumn("w", F.col("w") * ratio).drop("now", "target"), "cells")
        if worst < TOLERANCE:
            break
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """cells (source, lang, topic, n) with w: raked shares that meet the target marginals as far as the cells allow."""
    rows = cells.limit(CELL_LIMIT + 1).collect()
    if len(rows) > CELL_LIMIT:
        return _rake_as_jobs(cells, targets)
    goals = {d: {r["value"]: r["target"] for r in t.collect()} for d, t in targets.items()}
    w = _rake_on_driver(rows, goals) if rows else []
    data = [(r["source"], r["lang"], r["topic"], r["n"], x) for r, x in zip(rows, w, strict=True)]
    return cells.sparkSession.createDataFrame(data, "source string, lang string, topic string, n long, w double")


def achieved(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, got, gap) of every value, the values that no cell has included: what raking came to."""
    out = None
    for d in DIMENSIONS:
        got = raked.groupBy(F.col(d).alias("value")).agg(F.sum("w").alias("got"))
        rows = targets[d].join(got, "value", "full_outer").select(F.lit(d).alias("dimension"), "value", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("got", F.lit(0.0)).alias("got"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("gap", F.abs(F.col("target") - F.col("got")))


def calibrated(raked: DataFrame, budget: float) -> DataFrame:
    """Adds p: w scaled so that the expected tokens are `budget` of all, probabilities capped at 1.

    Capped cells leave their surplus to the others, which a few rounds of rescaling settle.
    """
    ratio = F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(F.lit(None))
    rows = staged(raked.withColumn("r", ratio), "raked")
    total = rows.agg(F.sum("n")).first()[0] or 0
    scale = budget * total
    for _ in range(20):
        got = rows.agg(F.sum(F.least(F.lit(1.0), F.col("r") * scale) * F.col("n"))).first()[0] or 0.0
        if got <= 0 or abs(got - budget * total) <= 1e-6 * total:
            break
        scale *= budget * total / got
    return rows.withColumn("p", F.coalesce(F.least(F.lit(1.0), F.col("r") * scale), F.lit(1.0))).drop("r")


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from a document's id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") / float(1 << 53)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, targets: dict[str, DataFrame] | None = None, temper: float = 0.7, budget: float = 0.8, seed: int = 23) -> DataFrame:
    """docs with __source, __lang, __topic, __n, __p (probability) and __kept; columns of docs by one of these names are left out."""
    rows = with_cells(docs.drop(*ADDED), text_col, source_col, lang_col, topic)
    cells = rows.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__n").alias("n"))
    cells = staged(cells, "cells")
    targets = {d: tempered(cells, d, temper) for d in DIMENSIONS} | (targets or {})
    raked = staged(rake(cells, targets), "weights")
    worst = achieved(raked, targets).agg(F.max_by(F.struct("dimension", "value", "gap"), "gap").alias("w")).first()["w"]
    if worst is not None and worst["gap"] > REPORTED and not raked.isEmpty():
        warnings.warn(f"targets out of reach: {worst['dimension']} {worst['value']!r} is off by {worst['gap']:.4f}", stacklevel=2)
    p = calibrated(raked, budget)
    p = staged(p.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("p").alias("__p")), "probabilities")
    if p.count() <= CELL_LIMIT:
        p = F.broadcast(p)
    rows = rows.join(p, ["__source", "__lang", "__topic"], "left")
    return rows.withColumn("__kept", uniform(id_col, seed) < F.coalesce("__p", F.lit(1.0)))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, **options) -> DataFrame:
    """The documents that mix() keeps, with their own columns, whatever these are called."""
    width = len(docs.columns)
    rows, names = renamed(docs)
    if topic is not None:
        rows = docs.select("*", topic.alias("__topic")).toDF(*names.values(), f"c{width}")
        topic = F.col(f"c{width}")
    kept = mix(rows, names[id_col], names[text_col], names[source_col], names[lang_col], topic, **options).where("__kept")
    return kept.select(*names.values()).toDF(*names)
