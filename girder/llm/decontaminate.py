"""Benchmark decontamination, in DataFrame functions only.

A window is `size` consecutive words of a benchmark item (an item with fewer words is one window of all of them).
Windows become 64-bit hashes of their words' hashes. The distinct windows of the benchmark are written once with a number, and
broadcast as the build side of a hash join while there are at most `broadcast_windows` (some 100 MB): each document's text is read
once, its windows are exploded and probed in one stage, hits are verified word by word, and only hits and one row for each document
are shuffled. Beyond that, hashes without words meet in a shuffled join, and only texts with a hit are read again to be verified.
A document gathers the numbers of its windows; their items are looked up afterwards, so that an item list is not repeated by hit.

Words are runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased.

Defined cases: a null or wordless text has no hits; a null or wordless item has no window; equal items all count; rows that
share an id are counted as they come and give one row (n_words is that of the longest); an empty benchmark hits
nothing. Rows without an id give one row with id null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import ascii_lower, renamed, staged

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, as an array without empty strings."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP, -1)
    return F.filter(parts, lambda w: w != "")


def benchmark_windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(length, window, items): each distinct window with the ids of the items that hold it."""
    rows = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    rows = rows.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    rows = rows.select("item", "length", F.slice("w", F.col("at") + 1, F.col("length")).alias("window"))
    return rows.groupBy("length", "window").agg(F.collect_set("item").alias("items"))


def _hashed(windows: DataFrame) -> DataFrame:
    """Adds the hash that the same words have in a document."""
    hashes = F.transform("window", lambda w: F.xxhash64(w))
    return windows.withColumn("hash", F.aggregate(hashes, F.lit(42).cast("long"), _chain))


def _chain(seed: Column, word_hash: Column) -> Column:
    return F.xxhash64(seed, word_hash)


def _probe(size: int):
    """A window's length, first word and hash, from the array h of word hashes."""

    def at(i: Column) -> Column:
        value = F.lit(42).cast("long")
        for k in range(size):
            value = _chain(value, F.get("h", i + k))
        return F.struct(F.lit(size).alias("length"), i.alias("at"), value.alias("hash"))

    return at


def _probes(lengths: list[int], none: bool) -> Column:
    """The windows of h as an array of (length, at, hash); with `none`, one entry of length 0 as well."""
    probes = [F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("hash")))] if none else []
    for size in lengths:
        starts = F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size)).otherwise(F.array().cast("array<int>"))
        probes.append(F.transform(starts, _probe(size)))
    return F.concat(*probes) if probes else F.array().cast("array<struct<length:int,at:int,hash:long>>")


def _verified(length: str = "length") -> Column:
    return F.slice("w", F.col("at") + 1, F.greatest(length, F.lit(1))) == F.col("window")


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, length, at, number) for each verified hit, and one row of length 0 for each document."""
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    rows = rows.select("id", "w", F.size("w").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.select("id", "w", "n_words", F.inline(_probes(lengths, True)))
    windows = F.broadcast(windows.select(F.col("length").alias("l"), F.col("hash").alias("x"), "window", "number"))
    found = rows.join(windows, (F.col("hash") == F.col("x")) & (F.col("length") == F.col("l")), "left")
    found = found.where((F.col("length") == 0) | F.col("x").isNotNull())
    return found.where((F.col("length") == 0) | _verified()).select("id", "n_words", "length", "at", "number")


def _hits_by_shuffle(docs: DataFrame, windows: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """The same for any number of windows: hashes are shuffled without words, and texts with a hit are read again."""
    rows = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")
    split = rows.select("id", "row", words(F.col("text")).alias("w"))
    probes = split.select("row", F.transform("w", lambda w: F.xxhash64(w)).alias("h")).select("row", F.inline(_probes(lengths, False)))
    met = probes.join(windows.select("length", "hash").hint("merge"), ["length", "hash"], "left_semi")
    places = staged(met.groupBy("row").agg(F.collect_set(F.struct("length", "at", "hash")).alias("places")), "met")
    again = split.join(places, "row").select("id", F.size("w").alias("n_words"), "w", F.inline("places"))
    again = again.select("id", "n_words", "length", "at", "hash", F.slice("w", F.col("at") + 1, F.col("length")).alias("window"))
    hits = again.join(windows.select("length", "hash", "window", "number").hint("merge"), ["length", "hash", "window"]).select("id", "n_words", "length", "at", "number")
    none = split.select("id", F.size("w").alias("n_words"), F.lit(0).alias("length"), F.lit(0).alias("at"), F.lit(None).cast("long").alias("number"))
    return none.union(hits)


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = 500_000) -> DataFrame:
    """Per document: n_words, the hit spans [first word, end), n_hit (words in them), n_items, items (sorted as strings)."""
    windows = _hashed(benchmark_windows(items, size, item_col, item_text)).withColumn("number", F.monotonically_increasing_id())
    windows = staged(windows, "windows")
    shape = windows.groupBy("length").agg(F.count("*").alias("n")).collect()  # `size` rows at most
    lengths = sorted(r["length"] for r in shape)
    small = sum(r["n"] for r in shape) <= broadcast_windows
    hits = (_hits if small else _hits_by_shuffle)(docs, windows, lengths, id_col, text_col)
    span = F.when(F.col("length") > 0, F.struct("at", (F.col("at") + F.col("length")).alias("end")))
    found = hits.groupBy("id").agg(F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set("number").alias("numbers"))
    found = staged(found, "hits")
    lists = windows.select("number", "items")
    named = found.select("id", F.explode("numbers").alias("number")).join(F.broadcast(lists) if small else lists, "number").select("id", F.explode(F.col("items").cast("array<string>")).alias("item"))
    named = named.distinct().groupBy(F.col("id").alias("of")).agg(F.array_sort(F.collect_list("item")).alias("items"))

    def covered(total: Column, s: Column) -> Column:
        """Adds the words of s that lie beyond the last end."""
        fresh = F.greatest(s["end"] - F.greatest(s["at"], total["end"]), F.lit(0))
        return F.struct((total["n"] + fresh).alias("n"), F.greatest(total["end"], s["end"]).alias("end"))

    out = found.select("id", F.col("n_words").cast("long").alias("n_words"), F.array_sort("spans").alias("spans"))
    out = out.join(named, F.col("id").eqNullSafe(F.col("of")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), covered)["n"]
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without a hit, with all their columns. Rows without an id are judged one by one, under numbers of their own."""
    docs, names = renamed(docs)
    key, text = names[id_col], names[text_col]

    def clean(rows: DataFrame, key: str) -> DataFrame:
        found = find_contamination(rows, items, id_col=key, text_col=text, **options)
        bad = found.where("n_hit > 0").select(F.col(key).alias("bad"))
        return rows.join(bad, F.col(key) == F.col("bad"), "left_anti")

    kept = clean(docs.where(F.col(key).isNotNull()), key)
    unnamed = docs.where(F.col(key).isNull())
    if not unnamed.isEmpty():
        unnamed = staged(unnamed.withColumn("row", F.monotonically_increasing_id()), "unnamed")
        kept = kept.union(clean(unnamed, "row").drop("row"))
    return kept.toDF(*names)


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text) with the hit words cut out of each text; what stands between two kept words stays.

    A text is cut into words, each with what precedes it; the words of a hit span go with that.
    """
    found = find_contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("n_hit > 0").select(F.col(id_col).alias("__id"), "spans")
    rows = docs.select(F.col(id_col), F.col(text_col)).join(found, F.col(id_col) == F.col("__id"), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # the text keeps its capitals here
    parts = F.regexp_extract_all(text, F.lit(f"{gap}*[^{gap[1:]}+|{gap}+"), F.lit(0))
    kept = F.filter(parts, lambda p, i: ~F.exists("spans", lambda s: (s["at"] <= i) & (i < s["end"])))
    return rows.select(id_col, F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "")).alias(text_col))
