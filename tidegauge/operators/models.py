"""Fitted models in place of the heuristic scores; rows that a model can't score keep the heuristic."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from ..settings import Settings
from .anomaly import score_anomaly
from .bot import score_bot
from .forecast import guard_forecast, score_forecast

# Names of features in the models' configuration files, and the columns that hold them.
BOT_FEATURES = {
    "NUMBER_OF_REQUESTS": "number_of_requests", "TOTAL_DURATION": "total_duration_s", "AVERAGE_TIME": "average_time_ms",
    "REPEATED_REQUESTS": "repeated_requests", "HTTP_RESPONSE_2XX": "http_response_2xx", "HTTP_RESPONSE_3XX": "http_response_3xx",
    "HTTP_RESPONSE_4XX": "http_response_4xx", "HTTP_RESPONSE_5XX": "http_response_5xx", "GET_METHOD": "get_method", "POST_METHOD": "post_method",
    "HEAD_METHOD": "head_method", "OTHER_METHOD": "other_method", "NIGHT": "night", "MAX_BARRAGE": "max_barrage",
}
ANOMALY_FEATURES = [
    "request_count", "avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "status_5xx_ratio", "baseline_avg_latency_ms", "baseline_5xx_ratio",
]
FORECAST_FEATURES = [*(f"history_rps_{i}" for i in range(10)), "rolling_mean_5", "rolling_std_5", "hour_of_day", "day_of_week"]
CONFIGS = {"bot": "model_config.json", "anomaly": "anomaly_model_config.json", "forecast": "forecast_model_config.json"}
OVERRIDES = ("bot_ips", "bot_threshold", "anomaly_threshold", "forecast_smoothing")


@dataclass(frozen=True)
class Linear:
    """A linear model as a column expression: a probability with ``logistic``, else a number."""

    weights: tuple[float, ...]
    intercept: float = 0.0
    logistic: bool = True

    def column(self, values: list[Column]) -> Column:
        total = reduce(lambda a, b: a + b, (v * w for v, w in zip(values, self.weights)), F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total)) if self.logistic else total


#: A leaf's value, or (feature, threshold, tree where the feature is at most that, tree where it is more).
Tree = float | tuple[int, float, "Tree", "Tree"]


@dataclass(frozen=True)
class Forest:
    """Trees as column expressions, or as SQL: the mean of their leaves.

    Scores stay in the JVM beside the features, without vectors or a model to ship; ``compiled`` makes one of
    a fitted forest.
    """

    trees: tuple[Tree, ...]
    width: int

    def column(self, values: list[Column]) -> Column:
        def of(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, threshold, low, high = tree
            return F.when(values[feature] <= threshold, of(low)).otherwise(of(high))

        return reduce(lambda a, b: a + b, map(of, self.trees)) / float(len(self.trees))

    def sql(self, names: list[str]) -> str:
        """The same as text that Spark SQL and other engines read; ``names`` are expressions of the features."""

        def of(tree: Tree) -> str:
            if not isinstance(tree, tuple):
                return f"CAST({float(tree)!r} AS DOUBLE)"
            feature, threshold, low, high = tree
            return f"CASE WHEN CAST({names[feature]} AS DOUBLE) <= CAST({threshold!r} AS DOUBLE) THEN {of(low)} ELSE {of(high)} END"

        return f"({' + '.join(map(of, self.trees))}) / CAST({float(len(self.trees))!r} AS DOUBLE)"


@dataclass(frozen=True)
class Scorer:
    """A model (``Linear``, ``Forest``, or a fitted tree model of pyspark.ml), its features in order, and
    the score from which it says yes."""

    model: Any
    columns: tuple[str, ...]
    threshold: float = 0.5

    @property
    def width(self) -> int:
        if isinstance(self.model, Forest):
            return self.model.width
        return len(self.model.weights) if isinstance(self.model, Linear) else self.model.numFeatures


def features_of(task: str) -> dict[str, Column]:
    """The columns of a task's features, by their names in configuration files."""
    if task == "bot":
        return {name: F.col(c) for name, c in BOT_FEATURES.items()}
    if task == "anomaly":
        return {c: F.col(c) for c in ANOMALY_FEATURES}
    steps = {f"history_rps_{i}": F.try_element_at("history_rps", F.lit(i + 1)) for i in range(10)}
    return {c: steps.get(c, F.col(c)) for c in FORECAST_FEATURES}


def _vector(values: list[Column]) -> Column:
    return array_to_vector(F.array(*(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) for v in values)))


def predict(rows: DataFrame, scorer: Scorer | None, features: dict[str, Column], into: str) -> DataFrame:
    """Adds ``into``: the probability of class 1, or the number predicted. Null for rows that lack a
    feature, and for all rows if there is no model or it takes other features than those named."""
    if scorer is None or not scorer.columns or any(c not in features for c in scorer.columns) or scorer.width != len(scorer.columns):
        return rows.withColumn(into, F.lit(None).cast("double"))
    values = [features[c].cast("double") for c in scorer.columns]
    whole = reduce(lambda a, b: a & b, (v.isNotNull() & ~F.isnan(v) for v in values))
    model = scorer.model
    if isinstance(model, (Linear, Forest)):
        return rows.withColumn(into, F.when(whole, model.column(values)))
    asked = rows.select(F.struct(*rows.columns).alias("row"), whole.alias("whole"), _vector(values).alias(model.getFeaturesCol()))
    found = F.element_at(vector_to_array(F.col(model.getProbabilityCol())), 2) if hasattr(model, "numClasses") else F.col(model.getPredictionCol())
    return model.transform(asked).select("row.*", F.when(F.col("whole"), found).alias(into))


def _scored(rows: DataFrame, scorer: Scorer | None, task: str, heuristic, s: Settings) -> DataFrame:
    rows = heuristic(predict(rows, scorer, features_of(task), "model_score"), s)
    used, score = F.col("model_score").isNotNull(), F.bround(clamp(F.col("model_score")), 4)
    limit = scorer.threshold if scorer is not None else 0.0
    return rows.withColumns(
        {
            f"{task}_score": F.when(used, score).otherwise(F.col(f"{task}_score")),
            f"is_{task}": F.when(used, (score >= limit).cast("int")).otherwise(F.col(f"is_{task}")),
        }
    ).drop("model_score")


def score_bot_by(features: DataFrame, scorer: Scorer | None, s: Settings) -> DataFrame:
    """As ``score_bot``, with the model's score and threshold where it can score the row."""
    return _scored(features, scorer, "bot", score_bot, s)


def score_anomaly_by(features: DataFrame, scorer: Scorer | None, s: Settings) -> DataFrame:
    """As ``score_anomaly``, with the model's score and threshold where it can score the row."""
    return _scored(features, scorer, "anomaly", score_anomaly, s)


def score_forecast_by(features: DataFrame, scorer: Scorer | None, s: Settings) -> DataFrame:
    """As ``score_forecast``, with the model's forecast where the history is long enough and the
    guardrail lets it pass."""
    rows = predict(features, scorer, features_of("forecast"), "model_forecast")
    return guard_forecast(score_forecast(rows, s), "model_forecast", s).drop("model_forecast", "upper_bound")


def fit_forest(rows: DataFrame, task: str, label: str, columns: list[str], threshold: float = 0.5, trees: int = 50, depth: int = 8, seed: int = 7) -> Scorer:
    """A random forest on rows whose features and label are all there: a classifier for ``bot`` and
    ``anomaly``, a regression for ``forecast``."""
    features = features_of(task)
    values = [features[c].cast("double") for c in columns]
    held = rows.where(F.col(label).isNotNull() & reduce(lambda a, b: a & b, (v.isNotNull() & ~F.isnan(v) for v in values)))
    kind = RandomForestRegressor if task == "forecast" else RandomForestClassifier
    forest = kind(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Scorer(forest.fit(held.select(_vector(values).alias("features"), F.col(label).cast("double").alias("label"))), tuple(columns), threshold)


def compiled(scorer: Scorer, most_nodes: int = 5_000) -> Scorer:
    """The scorer with its fitted forest as expressions that give the same scores. The nodes are read on
    the driver; a forest of more than ``most_nodes`` is refused, as the plan would hold all of them."""
    forest = scorer.model
    if forest.totalNumNodes > most_nodes:
        raise ValueError(f"a forest of {forest.totalNumNodes} nodes is better left to its own transform")
    classes = hasattr(forest, "numClasses")

    def of(node: Any) -> Tree:
        if node.subtreeDepth() == 0:
            if not classes:
                return node.prediction()
            counts = list(node.impurityStats().stats())
            return counts[1] / sum(counts)
        split = node.split()
        return split.featureIndex(), split.threshold(), of(node.leftChild()), of(node.rightChild())

    return replace(scorer, model=Forest(tuple(of(tree._call_java("rootNode")) for tree in forest.trees), forest.numFeatures))


def save_scorer(spark: SparkSession, root: str, task: str, scorer: Scorer, **config: Any) -> None:
    """A fitted forest and its configuration, as ``load_scorers`` reads them; ``config`` adds entries."""
    scorer.model.write().overwrite().save(f"{root}/{task}_model")
    text = json.dumps({"feature_columns": list(scorer.columns), "threshold": scorer.threshold, **config})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{CONFIGS[task]}")


def _names(spark: SparkSession, root: str) -> set[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {status.getPath().getName() for status in fs.listStatus(path)} if fs.exists(path) else set()


def load_scorers(spark: SparkSession, root: str, s: Settings = Settings()) -> tuple[Settings, dict[str, Scorer | None]]:
    """The settings with their mode and overrides, and the scorer of each task or None.

    The mode is ``model`` if the folder holds anything but ``.gitkeep``; only then the bots'
    configuration may override the heuristics' parameters. A task needs its model and the list of its
    features."""
    names = _names(spark, root)
    if not names - {".gitkeep"}:
        return replace(s, mode="mock"), {task: None for task in CONFIGS}
    read = lambda name: json.loads("".join(r.value for r in spark.read.text(f"{root}/{name}").collect())) if name in names else {}  # noqa: E731 - a small file
    configs = {task: read(name) for task, name in CONFIGS.items()}
    given = {k: tuple(v) if k == "bot_ips" else float(v) for k, v in configs["bot"].items() if k in OVERRIDES}
    s = replace(s, mode="model", **given)
    default = {"bot": Settings.bot_threshold, "anomaly": Settings.anomaly_threshold, "forecast": 0.0}
    found: dict[str, Scorer | None] = {}
    for task, config in configs.items():
        columns = tuple(config.get("feature_columns", ()))
        kind = RandomForestRegressionModel if task == "forecast" else RandomForestClassificationModel
        there = bool(columns) and f"{task}_model" in names
        found[task] = Scorer(kind.load(f"{root}/{task}_model"), columns, float(config.get("threshold", default[task]))) if there else None
    return s, found
