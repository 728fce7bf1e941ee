"""Small tables with the awkward cases: nulls, blanks, repeats, ties and clashing column names."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words of a fixed sequence, some capital, some ending a line."""
    state, out = seed * 7919 + 17, []
    for k in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        w = WORDS[(state >> 8) % len(WORDS)] + ("" if state % 3 else str(state % 97))
        out.append(w.title() if state % 11 == 0 else w)
        if k % 17 == 16:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


#: doc_id, text, lang, source, n_chars; blob and id clash with names that operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, text_2 string, start int, bucket string"


def table(spark, rows: list[tuple]):
    full = [(i, t, lang, src, len(t) if t else None, "x", None, 3, "b") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(docs):
    """docs with columns that are called as the operators' own, and the check that a result carries them unchanged."""
    from pyspark.sql import functions as F

    names = [f"__{n}" for n in ("n", "form", "kept", "p", "topic", "source", "cost", "lang", "chars", "failed", "mid", "unit", "deviation", "bad", "row", "id", "tag")] + ["c0", "c1", "row", "bad"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])

    def carried(rows) -> bool:
        return all(r[n] == f"{n}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names)

    return wide, carried


def awkward() -> list[tuple]:
    rows = [(k, prose(k, 60 + 13 * k), "en" if k % 3 else "de", f"s{k % 4}") for k in range(12)]
    rows += [(20, None, "en", None), (21, "", None, "s1"), (22, " \n\t ", "en", "s1"), (23, "é" * 60, "fr", "s2"), (24, rows[3][1], "en", "s1"), (25, rows[3][1], "en", "s1"), (25, rows[3][1], "en", "s1"), (26, rows[5][1] + " tail", None, None), (27, prose(5, 3000), "en", "s0")]
    rows += [(None, rows[4][1], "en", "s0"), (None, None, None, None)]
    return rows
