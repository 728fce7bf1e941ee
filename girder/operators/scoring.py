"""Scoring of tasks as set-based passes: a registry of fitted models, batch scores with their failures, states, what-ifs and scenarios."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators import explain, models
from girder.sources.staging import staged

#: The four tasks: name -> (kind, short name of its output columns).
TASKS = {"significant_delay": ("class", "delay"), "final_delay_days": ("regression", "delay_days"), "cost_overrun": ("class", "cost"), "final_cost_overrun_pct": ("regression", "cost_pct")}


class Registry:
    """The fitted pipeline of each task, with the medians and columns it is fed with, and after fitting the prepared training rows."""

    def __init__(self, numeric: list[str], text: list[str], fitted: dict[str, tuple[str, PipelineModel]], medians: dict[str, float], ready: DataFrame | None = None):
        self.numeric, self.text, self.fitted, self.medians, self.ready = numeric, text, fitted, medians, ready

    def save(self, folder: str, spark: SparkSession) -> None:
        for task, (_, model) in self.fitted.items():
            model.write().overwrite().save(f"{folder}/{task}")
        about = {"numeric": self.numeric, "text": self.text, "medians": self.medians, "families": {t: f for t, (f, _) in self.fitted.items()}}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")

    @classmethod
    def load(cls, folder: str, spark: SparkSession) -> Registry:
        """All tasks or an error that names what is missing."""
        try:
            about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        except Exception as e:
            raise FileNotFoundError(f"no models in {folder}") from e
        fitted = {}
        for task, family in about["families"].items():
            try:
                fitted[task] = family, PipelineModel.load(f"{folder}/{task}")
            except Exception as e:
                raise FileNotFoundError(f"no model of {task} in {folder}") from e
        return cls(about["numeric"], about["text"], fitted, about["medians"])


def fit_tasks(train: DataFrame, numeric: list[str], text: list[str], targets: dict[str, str], families: dict[str, str] | None = None) -> Registry:
    """Fit every task of `targets` (task -> label column) on the training rows, which are read, filled and prepared once for all tasks."""
    families = families or {t: "logistic" if TASKS[t][0] == "class" else "linear" for t in targets}
    train = staged(train.select(*dict.fromkeys([*numeric, *text, *targets.values()])), "training")
    n, medians = train.count(), models.medians(train, numeric)
    train = models.filled(train, medians, text)
    prepared = Pipeline(stages=models.preprocessing(numeric, text)).fit(train)
    ready = staged(prepared.transform(train).select("features", *dict.fromkeys(targets.values())), "features")
    fitted = {}
    for task, label in targets.items():
        model = models.classifier(families[task], label, n) if TASKS[task][0] == "class" else models.regressor(families[task], label)
        fitted[task] = families[task], PipelineModel(stages=[*prepared.stages, model.fit(ready)])
    return Registry(numeric, text, fitted, medians, ready)


def score_tasks(rows: DataFrame, registry: Registry) -> DataFrame:
    """rows with <short>_class, <short>_p or <short>_pred of each task, and <short>_model."""
    keep, prepared = rows.columns, None
    out = models.filled(rows, registry.medians, registry.text)
    for task, (family, pipeline) in registry.fitted.items():
        kind, short = TASKS[task]
        if prepared != (prepared := _preparation(pipeline)):  # tasks prepared alike share their features
            out = PipelineModel(stages=pipeline.stages[:-1]).transform(out.select(*keep))
        made = pipeline.stages[-1].transform(out)
        cols = {f"{short}_model": F.lit(family)}
        cols |= {f"{short}_class": F.col("prediction").cast("int"), f"{short}_p": models.probability()} if kind == "class" else {f"{short}_pred": F.col("prediction")}
        made = made.withColumns(cols)
        keep = [*keep, *cols]
        out = made.select(*keep, "features")
    originals = rows.columns
    return out.select(*originals, *[c for c in keep if c not in originals])


def _preparation(pipeline: PipelineModel) -> tuple[str, ...]:
    """What tells whether two fitted pipelines prepare rows by the same stages."""
    return tuple(stage.uid for stage in pipeline.stages[:-1])


def batch_scores(features: DataFrame, eligible: DataFrame, registry: Registry, key: str, month: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scores, failures) of each key's eligible month in one pass; a row that lacks a needed value fails with the first one's name."""
    rows = features.join(eligible.select(key, F.col("m").alias(month)), [key, month])
    reason = F.lit(None).cast("string")
    for c in reversed(needed):
        reason = F.when(F.col(c).isNull(), F.lit(f"{c} is missing")).otherwise(reason)
    rows = rows.withColumn("reason", reason)
    return score_tasks(rows.where("reason IS NULL").drop("reason"), registry), rows.where("reason IS NOT NULL").select(key, month, "reason")


def reload_cache(scores: DataFrame, path: str) -> int:
    """Replace the score cache as a whole; the new one is written beside it first, so that a failed run leaves the old one."""
    spark = scores.sparkSession
    draft = f"{path}__draft"
    scores.withColumn("computed_at", F.current_timestamp()).write.mode("overwrite").parquet(draft)
    fresh = spark.read.parquet(draft)
    fresh.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).count()


def prediction_states(snapshots: DataFrame, needed: list[str], terminal: str = "is_terminal") -> DataFrame:
    """Adds status: actual_outcome for terminal rows, insufficient_data where a needed value is missing, else model_prediction."""
    lacking = F.lit(False)
    for c in needed:
        lacking = lacking | F.col(c).isNull()
    return snapshots.withColumn("status", F.when(F.col(terminal), "actual_outcome").when(lacking, "insufficient_data").otherwise("model_prediction"))


def recorded_sentences(outcomes: DataFrame) -> DataFrame:
    """Adds delay_text and cost_text: a finished project's recorded outcomes as sentences."""
    said = lambda what, c: F.concat(F.lit(f"Recorded outcome, not a prediction: {what} = "), F.when(F.col(c) == 1, "yes").otherwise("no"), F.lit("."))
    return outcomes.withColumns({"delay_text": said("significant delay", "delayed"), "cost_text": said("cost overrun", "overrun")})


# ---------------------------------------------------------------- explanations and what-ifs of the fitted tasks


def owners(ready: DataFrame, numeric: list[str], text: list[str]) -> list[str]:
    """The column that each part of `features` comes from; a text column owns all of its one-hot parts."""
    found = {}
    for part in [a for kind in ready.schema["features"].metadata["ml_attr"]["attrs"].values() for a in kind]:
        place = part["name"].removeprefix("__scaled_")
        found[part["idx"]] = numeric[int(place)] if place.isdigit() else next(c for c in sorted(text, key=len, reverse=True) if part["name"].startswith(f"__{c}_v_"))
    return [found[k] for k in range(len(found))]


def task_attributions(rows: DataFrame, registry: Registry, task: str, key: str | list[str], background: DataFrame) -> DataFrame:
    """(key, feature, attribution) of one task, see `attributions`."""
    return attributions(rows, registry, [task], key, background).drop("task")


def attributions(rows: DataFrame, registry: Registry, tasks: list[str], key: str | list[str], background: DataFrame | None = None) -> DataFrame:
    """(key, task, feature, attribution): what each column of a row adds to a fitted task's margin, one-hot parts added up to their column.

    Linear tasks: coefficient times distance from the background's mean, within the row, without a shuffle; a key's attributions add up to its margin
    (log-odds of a class) less that of the mean. Tree tasks: exact path-dependent shares of the leaves (`explain.tree_attributions`), which need no
    background. Missing values are filled as for scoring; an empty background leaves a linear task's attributions null. Rows and background are
    prepared once for all linear tasks that share their preparation. Without a background it is the training rows as `fit_tasks` prepared them.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    keys = [key] if isinstance(key, str) else list(key)
    alike, made = {}, []
    for task in tasks:
        alike.setdefault(_preparation(registry.fitted[task][1]), []).append(task)
    for same in alike.values():
        prepared = PipelineModel(stages=registry.fitted[same[0]][1].stages[:-1])
        ready = prepared.transform(models.filled(rows, registry.medians, registry.text)).select(*keys, "features")
        own, sums = owners(ready, registry.numeric, registry.text), []
        for task in same:
            family, model = registry.fitted[task][0], registry.fitted[task][1].stages[-1]
            if family not in ("logistic", "linear"):
                names = [f"{k}" for k in range(len(own))]
                parts = explain.tree_attributions(ready, keys, "features", names, model)
                made.append(explain.grouped(parts, keys, dict(zip(names, own, strict=True))).withColumn("task", F.lit(task)))
                continue
            apart = [(F.get("__x", F.lit(k)) - F.get("__mean", F.lit(k))) * F.lit(float(w)) for k, w in enumerate(model.coefficients)]
            for c in dict.fromkeys(own):
                total = sum((apart[k] for k, o in enumerate(own) if o == c), F.lit(0.0))
                sums.append(F.struct(F.lit(task).alias("task"), F.lit(c).alias("feature"), total.alias("attribution")))
        if sums:
            if background is None and registry.ready is None:
                raise ValueError("a registry that was loaded has no training rows; name a background")
            around = registry.ready if background is None else prepared.transform(models.filled(background, registry.medians, registry.text))
            mean = around.agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("__mean"))
            made.append(ready.select(*keys, vector_to_array("features").alias("__x")).join(F.broadcast(mean)).select(*keys, F.inline(F.array(*sums))))
    made = [part.select(*keys, "task", "feature", "attribution") for part in made]
    return reduce(DataFrame.unionByName, made)


def scenario_scores(rows: DataFrame, registry: Registry, task: str, key: str, background: DataFrame, outputs: list[str]) -> DataFrame:
    """(key, field, reference, <output>_base, _new, _change): each row beside itself with its strongest driver of the task at the training mean.

    A row whose strongest driver is a text column keeps all values: field and reference are null and every change is 0.
    """
    means = background.agg(*[F.avg(c).alias(c) for c in registry.numeric])
    picked = staged(scenarios(rows, task_attributions(rows, registry, task, key, background), means, key, registry.numeric), "scenarios")
    named = picked.select(key, F.col("field").alias("__field"), F.col("reference").alias("__reference"))
    overrides = {c: F.when(F.col("__field") == c, F.col("__reference")).otherwise(F.col(c).cast("double")) for c in registry.numeric}
    out = simulated(rows.join(named, key), overrides, lambda both: score_tasks(both, registry), key, outputs)
    return picked.join(out, key)


# ---------------------------------------------------------------- what-if


def simulated(rows: DataFrame, overrides: dict[str, Column | float], score: Callable[[DataFrame], DataFrame], key: str, outputs: list[str]) -> DataFrame:
    """(key, <output>_base, <output>_new, <output>_change): both sides are scored in one pass over rows and their overlays."""
    both = rows.withColumn("__new", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.withColumns({c: F.when(F.col("__new"), v).otherwise(F.col(c)) for c, v in overrides.items()})
    scored = score(both)
    side = lambda c, new: F.max(F.when(F.col("__new") == new, F.col(c)))
    out = scored.groupBy(key).agg(*[side(c, new).alias(f"{c}_{n}") for c in outputs for n, new in (("base", False), ("new", True))])
    return out.withColumns({f"{c}_change": F.col(f"{c}_new") - F.col(f"{c}_base") for c in outputs})


def scenarios(rows: DataFrame, attributions: DataFrame, means: DataFrame, key: str, numeric: list[str]) -> DataFrame:
    """(key, field, reference): each key's strongest driver and its training mean; both null where the driver is not numeric.

    means has one row with a column for each numeric feature.
    """
    top = models.strongest(attributions, key, 1).select(key, F.col("feature").alias("field"))
    flat = means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("reference")) for c in numeric])))
    out = rows.select(key).join(top, key, "left").join(F.broadcast(flat), "field", "left")
    return out.select(key, F.when(F.col("reference").isNotNull(), F.col("field")).alias("field"), "reference")


def importances(model: PipelineModel, names: list[str], spark: SparkSession) -> DataFrame:
    """(rank, feature, importance) of a fitted tree pipeline, largest first, ties by name; one row for each feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    names = names + [f"feature {k}" for k in range(len(names), len(values))]
    order = sorted(zip(values, names, strict=False), key=lambda x: (-x[0], x[1]))
    return spark.createDataFrame([(k, n, float(v)) for k, (v, n) in enumerate(order, 1)], "rank int, feature string, importance double")


def explained(attributions: DataFrame, key: str, score: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(global ranking, local drivers of the highest and the lowest scored row)."""
    ends = score.agg(F.max_by(key, F.struct("score", key)).alias("hi"), F.min_by(key, F.struct("score", key)).alias("lo"))
    ends = ends.select(F.explode(F.array(F.struct(F.lit("highest").alias("example"), F.col("hi").alias(key)), F.struct(F.lit("lowest").alias("example"), F.col("lo").alias(key)))).alias("e")).select("e.*")
    return models.global_ranking(attributions), models.strongest(attributions.join(F.broadcast(ends), key), key, top)
