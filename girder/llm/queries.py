"""Queries over the corpus tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.common import with_tag
    from girder.llm.line_dedup import apply_keep_bitmaps, line_keep_bitmaps

    docs = with_tag(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    kept = apply_keep_bitmaps(docs, line_keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.pii import ALL, KINDS, find_pii, span_text

    rows = find_pii(table(spark, sf_dir, "documents"))
    counts = [_count_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    base = F.sha2(span_text("base").cast("binary"), 256)
    more = [F.size(F.concat("base", "added")).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"), _count_of(ALL.index("secret"), "added").alias("n_secret")]
    return rows.select("doc_id", *counts, base.alias("base_sha256"), span_text(F.array_sort(F.concat("base", "added"))).alias("spans"), *more)


def _count_of(kind: int, spans: str = "base"):
    return F.size(F.filter(spans, lambda s: s["k"] == kind)).cast("long")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.simhash import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.decontaminate import find_contamination

    rows = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.mixing import mix

    rows = mix(table(spark, sf_dir, "documents"))
    cols = {"source": "__source", "lang": "__lang", "topic": "__topic", "n_tokens": "__n", "probability": "__p", "kept": "__kept"}
    return rows.select("doc_id", *[F.col(c).alias(n) for n, c in cols.items()])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.licenses import scan_licenses

    rows = scan_licenses(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_sentences", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licenses", ",").alias("licenses"), "first_sentence")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.common import fresh_path, staged
    from girder.llm.token_output import read_tokens, write_tokens

    folder = fresh_path(spark, "tokens")
    manifest = staged(write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_file(), plain_special=False), "manifest")
    return read_tokens(spark, folder, manifest)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.quality import quality_rules

    rows = quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lang")


def op11_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.recurrent_lm import remainder, score_texts

    held_out = remainder("doc_id", 5) == 1
    rows = score_texts(table(spark, sf_dir, "documents"), trains=~held_out)
    return rows.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.periodic_runs import periodic_runs, repeated_tail

    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("runs", "collapsed")]
    return periodic_runs(docs).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY lang, term HAVING count(*) >= 3),
kl AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
cs AS (SELECT c.lang, c.source, c.term, sum(c.n) AS n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term GROUP BY ALL),
gt AS (SELECT lang, source, sum(n) AS total FROM cs GROUP BY lang, source),
dense AS (SELECT g.lang, g.source, k.term, coalesce(cs.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(cs.n, 0) + 1)) // (coalesce(gt.total, 0) + kl.v) AS p,
                 1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (kl.total + kl.v) AS w
          FROM g JOIN k ON g.lang = k.lang JOIN kl ON g.lang = kl.lang LEFT JOIN gt ON g.lang = gt.lang AND g.source = gt.source
          LEFT JOIN cs ON g.lang = cs.lang AND g.source = cs.source AND k.term = cs.term),
ps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f
       FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(ps.f, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN ps ON a.lang = ps.lang AND a.source = ps.source AND b.source = ps.item
      UNION ALL SELECT lang, source, 'term', term, (p - w) * (p - w) // w FROM dense WHERE n > 0 AND p > w)
SELECT * FROM (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                      CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200""",
    "op3_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
       sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words hw ON d.doc_id = hw.doc_id LEFT JOIN hit_items hi ON d.doc_id = hi.doc_id""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, t.pos, t.line,
         translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos) t),
hot AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE h.key IS NOT NULL AND h.keeper <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE h.key IS NULL OR h.keeper = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h ON l.key = h.key
GROUP BY l.doc_id""",
}

def _license_sql() -> str:
    """The same scan as SQL, from the operator's own tables of sentences and rules."""
    from girder.llm.licenses import RULES, SENTENCES

    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules, seen = [], set()
    for name, seq in RULES:
        if seq not in seen:
            rules.append((" " + "  ".join(seq) + " ", name))
            seen.add(seq)
    pattern = "|".join(k.replace(".", "[.]") for k, _ in rules)
    names = ", ".join(f"('{k}', '{n}')" for k, n in rules)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(seq, name) AS (VALUES {names}),
parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;])[ 	]+', '' || chr(10), 'g'), '[
]+'),
            lambda p: trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda p: p <> '') AS s FROM documents),
ids AS (SELECT p.doc_id, p.pos, k.id FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(0, len(s))) AS pos FROM parts) p JOIN known k ON p.sentence = k.sentence),
lines AS (SELECT doc_id, count(*) AS n, min(pos) AS first, string_agg(id, ',' ORDER BY pos) AS identifiers, ' ' || string_agg(id, '  ' ORDER BY pos) || ' ' AS line FROM ids GROUP BY doc_id),
found AS (SELECT l.doc_id, string_agg(r.name, ',' ORDER BY l.k) AS licenses
          FROM (SELECT doc_id, unnest(t) AS token, unnest(range(0, len(t))) AS k FROM (SELECT doc_id, regexp_extract_all(line, '{pattern}') AS t FROM lines)) l
          JOIN rules r ON l.token = r.seq GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(l.n, 0) AS n_sentences, coalesce(l.identifiers, '') AS identifiers, coalesce(f.licenses, '') AS licenses, coalesce(l.first, -1) AS first_sentence
FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id"""


SQL["op9_license_scan"] = _license_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_token_output": op7_token_output,
    "op8_line_dedup": op8_line_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_recurrent_lm": op11_recurrent_lm,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}
