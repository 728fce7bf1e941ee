"""What-if overlays and natural-language routing: entities, intents and overrides as column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Intent patterns in the order of trial, concepts, direction words, levels, dimensions.
INTENTS = (
    ("whatif", (r"\bwhat happens if\b", r"\bwhat would happen if\b", r"\bwhat if\b")),
    ("support", (r"\bhow do i\b", r"\bhow can i\b", r"\bhow to\b", r"\bhow does .+ work\b", r"\bwhat does .+ mean\b", r"\bwhat is (a |an )?(model prediction|what-?if|insufficient data)\b")),
    ("risk", (r"\bwhy is\b.*\brisk", r"\bwhy are\b.*\brisk", r"\bwhy .* high risk\b", r"\bwhy .* risky\b", r"\brisk driver", r"\brisk summary\b", r"\bwhy .* (delay|cost overrun)\b", r"\bwhat.?s driving\b")),
    ("portfolio", (r"\bwhich projects\b", r"\bdistribution\b", r"\bportfolio\b", r"\bhow many projects\b", r"\btop risk", r"\bsegment", r"\bby state\b", r"\bby contractor\b", r"\bby (project )?type\b", r"\btrend", r"\bacross the (portfolio|corpus)\b")),
    ("project", (r"\binformation about\b", r"\bdetails? (about|for|on)\b", r"\btell me about\b", r"\bstatus of\b", r"\bshow me\b")),
    ("document", (r"\bdocument", r"\breport", r"\bmention", r"\bsay about\b", r"\baccording to\b")),
)
UP = ("improve", "improves", "improved", "increase", "increases", "increased", "rise", "rises", "risen", "overrun", "overruns")
DOWN = ("decrease", "decreases", "decreased", "worsen", "worsens", "worsened", "drop", "drops", "dropped", "fall", "falls", "fallen", "decline", "declines")
CONCEPTS = (
    ("financial progress", "actual_financial_progress_pct", "additive"),
    ("physical progress", "actual_physical_progress_pct", "additive"),
    ("progress", "actual_physical_progress_pct", "additive"),
    ("contractor productivity", "contractor_productivity_factor", "multiplicative"),
    ("productivity", "contractor_productivity_factor", "multiplicative"),
    ("expenditure", "actual_cost_to_date_inr_cr", "multiplicative"),
    ("cost", "actual_cost_to_date_inr_cr", "multiplicative"),
)
SUPPORT = (
    ("add_project", ("add a project", "add new project", "add a new highway", "create a project", "create project")),
    ("monthly_update", ("monthly update", "monthly progress", "progress update", "add a snapshot", "update progress")),
    ("reactivate", ("reactivate",)),
    ("archive", ("archive a project", "archive project", "how do i archive", "deactivate a project", "archive")),
    ("insufficient_data", ("insufficient data",)),
    ("prediction", ("model prediction", "what is a prediction", "how accurate")),
    ("whatif", ("what-if", "what if scenario", "simulator", "hypothetical")),
    ("documents", ("document search", "search documents", "rag")),
)


def _any(tests: list[Column]) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))


def _first(cases: list[tuple[Column, Column | str]], otherwise: Column) -> Column:
    """An ordered choice."""
    out = otherwise
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def intent(message: Column) -> Column:
    t = F.lower(F.coalesce(message, F.lit("")))
    return _first([(_any([t.rlike(p) for p in patterns]), F.lit(name)) for name, patterns in INTENTS], F.lit("unsupported"))


def support_topic(message: Column) -> Column:
    t = F.lower(F.coalesce(message, F.lit("")))
    return _first([(_any([F.contains(t, F.lit(w)) for w in words]), F.lit(name)) for name, words in SUPPORT], F.lit("default"))


def entities(message: Column, ids: str = r"(?i)\b[A-Z]{2,}(?:-[A-Z]+)*-\d{4,}\b") -> Column:
    """project id, month, risk level and dimension named in a message; null where absent."""
    m = F.coalesce(message, F.lit(""))
    t = F.lower(m)
    known = lambda c: F.when(c != "", c)
    level = _first([(t.rlike(rf"\b{x}\b"), F.lit(x.upper())) for x in ("critical", "high", "medium", "low")], F.lit(None).cast("string"))
    dimension = _first([(F.contains(t, F.lit(p)), F.lit(d)) for p, d in (("contractor", "contractor"), ("project type", "project_type"), ("state", "state"))], F.lit(None).cast("string"))
    return F.struct(known(F.upper(F.regexp_extract(m, ids, 0))).alias("project_id"), known(F.regexp_extract(m, r"\d{4}-(0[1-9]|1[0-2])", 0)).alias("month"), level.alias("risk_level"), dimension.alias("dimension"))


def whatif(message: Column) -> Column:
    """field, mode, magnitude and direction of a what-if phrase; null where any is missing.

    The first percentage, the first listed concept and the first direction word count.
    """
    t = F.lower(F.coalesce(message, F.lit("")))
    size = F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*%", 1)
    pick = lambda k: _first([(F.contains(t, F.lit(c[0])), F.lit(c[k])) for c in CONCEPTS], F.lit(None).cast("string"))
    moves = F.filter(F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(*UP, *DOWN))
    word = F.get(moves, F.lit(0))
    whole = (size != "") & pick(1).isNotNull() & word.isNotNull()
    made = F.struct(pick(1).alias("field"), pick(2).alias("mode"), F.when(size != "", size).cast("double").alias("magnitude"), F.when(word.isin(*UP), "up").otherwise("down").alias("direction"))
    return F.when(whole, made)


def moved(base: Column, mode: Column, magnitude: Column, direction: Column) -> Column:
    """A value after a what-if: points are added and held in 0 to 100, percentages multiply."""
    signed = F.when(direction == "up", magnitude).otherwise(-magnitude)
    return F.when(mode == "additive", F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + signed))).otherwise(base * (1 + signed / 100))


# ---------------------------------------------------------------- overlays


def check_overrides(overrides: dict, numeric: set[str], text: set[str]) -> dict[str, str]:
    """A reason for each override that can't be applied: unknown field or wrong type (a truth value is no number)."""
    out = {}
    for f, v in overrides.items():
        if f not in numeric | text:
            out[f] = "unknown field"
        elif f in numeric and (isinstance(v, bool) or not isinstance(v, int | float)):
            out[f] = "not a number"
        elif f in text and not isinstance(v, str):
            out[f] = "not a text"
    return out


def overlay(rows: DataFrame, overrides: dict) -> DataFrame:
    """rows with the named fields replaced and <field>__delta beside them (null for texts and unknown originals)."""
    number = {f for f, v in overrides.items() if not isinstance(v, str)}
    deltas = {f"{f}__delta": (F.lit(float(v)) - F.col(f)) if f in number else F.lit(None).cast("double") for f, v in overrides.items()}
    return rows.withColumns(deltas).withColumns({f: F.lit(v).cast(rows.schema[f].dataType) for f, v in overrides.items()})


def extrapolation(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values (field, value) outside the training range of their field; unknown fields are skipped."""
    rows = values.join(F.broadcast(ranges.select(F.col("column").alias("field"), "lo", "hi")), "field")
    return rows.where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))


def route(message: str, named: dict) -> str:
    """The engine function that answers an intent; a portfolio question with a level or a dimension is a narrower one."""
    if named["intent"] == "portfolio":
        if named.get("risk_level"):
            return "risk_page"
        return "segment_report" if named.get("dimension") else "overview"
    return {"risk": "risk_summary", "project": "project_detail", "document": "search_documents", "whatif": "simulate", "support": "support_topic"}.get(named["intent"], "unsupported")
