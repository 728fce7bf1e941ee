"""Source divergence audit: how far the terms of a source stray from those of the other sources of its language.

A term is a maximal run of letters (ASCII letters and all characters above ASCII), with A-Z lower-cased. A language keeps the V terms that at least
MIN_DOCS of its documents hold. Every (lang, source) group, and every language as a whole, gives each kept term
p = 1 + floor(SCALE * (count + 1) / (N + V)), with N the sum of its counts of kept terms. A value is
f = floor((p - q) * (p - q) / q), p the group's. All numbers are whole, so nothing depends on the order of sums.

Terms are counted by group within batches of texts, which Spark adds up before the only shuffle of
that size; windows over the counted terms find the kept ones, which are written once, and give each occurring term its p and q: terms are ranked from
these alone. For the pairs, the kept terms are dealt by language and a salt, so that one language is many tasks, and sorted by term behind
a head row for each source of the language (its p of a term that it lacks). A task reads them as they come, a few thousand terms x sources at a time as a matrix,
and sends one partial sum for each pair. Ranks to `top` are cut in each task before rows are sent.

Defined cases: a null text, lang or source is read as ''; a group without terms still appears, with value 0 where its language keeps
no term; a language with one source has no pairs; rows are counted, so repeated rows and ids count as often as they occur and ids are never
read; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.common import staged

#: What stands between terms, and the texts of which a task counts the terms at a time.
OTHER, ROWS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", 2000
MIN_DOCS, SCALE, TOP, SALTS = 3, 1_000_000_000, 200, 64
#: Terms x sources that a task holds as a matrix at a time.
CELLS = 1 << 18


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms in batches of (lang, source, text): terms are numbered by a dictionary and counted as numbers."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), OTHER)
            terms = lists.flatten()
            filled = pc.greater(pc.binary_length(terms), 0)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())[filled.to_numpy(zero_copy_only=False)]
            coded = terms.filter(filled).dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            if not len(code):
                continue
            group = pa.array([f"{len(a)} {a}{b}" for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]).dictionary_encode().indices.to_numpy().astype(np.int64)
            width = len(names)
            in_doc, n = np.unique(doc * width + code, return_counts=True)
            first, term = in_doc // width, in_doc % width
            place, held, back = np.unique(group[first] * width + term, return_index=True, return_inverse=True)
            sample = pa.array(first[held])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(sample), batch.column(1).take(sample), names.take(pa.array(place % width)), pa.array(np.bincount(back, n).astype(np.int64)), pa.array(np.bincount(back))], names=["lang", "source", "term", "n", "n_docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and documents of every term in every group."""
    rows = docs.select(_name(lang_col, "lang"), _name(source_col, "source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _name(column: str, alias: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(alias)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), whole at any size of n: in longs where the product fits, else in decimals."""
    scale = F.lit(SCALE).cast("long")
    above, below = (n + 1).cast("decimal(20,0)") * scale.cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)")
    fits = n < (1 << 63) // SCALE - 1
    return F.when(fits, F.call_function("div", F.when(fits, n + 1).otherwise(0) * scale, total + terms)).otherwise(F.call_function("div", above, below)) + 1


def _stray(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _begins(rows: pa.Table) -> np.ndarray:
    """Where a row's (lang, salt, term) is not that of the row before."""
    new = np.ones(rows.num_rows, bool)
    apart = [pc.not_equal(rows[c].slice(1), rows[c].slice(0, max(rows.num_rows - 1, 0))).to_numpy() for c in ("lang", "salt", "term")]
    new[1:] = np.logical_or.reduce(apart)
    return new


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of f over terms for each ordered pair of sources. Rows come by lang, salt and term, heads (no term) first."""
    rest, head = [], None
    for batch in chain(batches, [None]):
        rows = pa.Table.from_batches([*rest, *([] if batch is None else [batch])]) if rest or batch is not None else None
        if rows is None or not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        new = _begins(rows)
        end = rows.num_rows if batch is None else int(np.flatnonzero(new)[-1])  # the last term may go on
        rest = rows.slice(end).to_batches()
        new, heads = new[:end], pc.equal(rows["term"], "").to_numpy()[:end]
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(new & heads), np.flatnonzero(new & ~heads & np.roll(heads, 1)), [end]]))
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            part = rows.slice(at, to - at)
            if heads[at]:
                head = part["lang"][0].as_py(), part["source"].combine_chunks(), part["p"].to_numpy()
                continue
            lang, sources, none = head
            term = np.cumsum(new[at:to]) - 1
            source, p = pc.index_in(part["source"], value_set=sources).to_numpy(), part["p"].to_numpy()
            most = max(CELLS // len(sources), 1)
            for k in range(0, int(term[-1]) + 1, most):
                lo, hi = np.searchsorted(term, [k, k + most])
                shares = np.repeat(none[None, :], int(term[hi - 1]) + 1 - k, 0)
                shares[term[lo:hi] - k, source[lo:hi]] = p[lo:hi]
                for item in range(len(sources)):
                    q = shares[:, item, None]
                    f = np.delete(((shares - q) ** 2 // q).sum(0), item)
                    others = pa.array(np.delete(np.arange(len(sources)), item))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), sources.take(others), pa.array([sources[item].as_py()] * len(f), pa.string()), pa.array(f)], names=["lang", "source", "item", "f"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources, part `term` the terms a group has more of than its language."""
    groups = staged(docs.select(_name(lang_col, "lang"), _name(source_col, "source")).distinct(), "groups")
    term = Window.partitionBy("lang", "term")
    held = term_counts(docs, text_col, lang_col, source_col).withColumns({"lang_n": F.sum("n").over(term), "d": F.sum("n_docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    counts = staged(held.where(F.col("d") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"), "kept")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("first"), 1)).alias("v"))
    langs = staged(totals.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("total").alias("lang_total")), "langs")
    sized = staged(groups.join(totals.drop("v"), ["lang", "source"], "left").join(langs, "lang").fillna(0, "total"), "sized")

    total, v, salts = F.col("total"), F.col("v"), F.lit(SALTS)
    shares = counts.join(sized, ["lang", "source"]).withColumn("p", _share(F.col("n"), total, v))
    heads = sized.select("lang", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit("").alias("term"), "source", _share(F.lit(0).cast("long"), total, v).alias("p"))
    dealt = heads.unionByName(shares.select("lang", F.pmod(F.xxhash64("term"), salts).cast("int").alias("salt"), "term", "source", "p"))
    met = dealt.repartition("lang", "salt").sortWithinPartitions("lang", "salt", "term", "source").mapInArrow(_met, "lang string, source string, item string, f long")
    every = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", F.lit(0).cast("long").alias("f"))
    pairs = met.unionByName(every).groupBy("lang", "source", "item").agg(F.sum("f").alias("value"))
    more = shares.withColumn("whole", _share(F.col("lang_n"), F.col("lang_total"), v))
    terms = more.where("p > whole").select("lang", "source", F.col("term").alias("item"), _stray(F.col("p"), F.col("whole")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).withColumn("part", F.lit("pair"))
    leading = terms.withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(leading.select(*columns))
