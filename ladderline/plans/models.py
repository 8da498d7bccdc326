"""Models behind one contract, backtests and calibration, over DataFrames."""

from __future__ import annotations

import json
import math
from abc import ABC, abstractmethod
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.functions import expected_score
from ladderline.operators import metrics
from ladderline.operators.elo import BASE, K_FACTOR, ranked, rated, rating_log
from ladderline.operators.teams import before, team_centric, won
from ladderline.sources.shared import stored

ELO = ("radiant_elo", "dire_elo", "elo_difference")


class Model(ABC):
    """fit, predict (adds ``p``), calibrate, evaluate, save, load, feature_importance."""

    fitted = False

    @abstractmethod
    def fit(self, rows: DataFrame) -> Model: ...

    @abstractmethod
    def predict(self, rows: DataFrame) -> DataFrame: ...

    def calibrate(self, rows: DataFrame) -> None:
        return None

    def feature_importance(self) -> dict[str, float] | None:
        return None

    def evaluate(self, rows: DataFrame) -> dict[str, float]:
        """accuracy, log_loss, brier, roc_auc; raises without rows."""
        scored = self.predict(rows).select("p", F.col("radiant_win").alias("won"))
        out = metrics.summary(scored).crossJoin(F.broadcast(metrics.roc_auc(scored))).first()  # one row each
        if not out["n"]:
            raise ValueError("no rows to evaluate")
        return {k: out[k] for k in ("accuracy", "log_loss", "brier", "roc_auc")}


class EloRule(Model):
    """The expected score of the ratings themselves."""

    def fit(self, rows: DataFrame) -> EloRule:
        self.fitted = True
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit comes before predict")
        return rows.withColumn("p", expected_score(F.col("radiant_elo"), F.col("dire_elo")))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([("elo_rule",)], "kind string").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark, path: str) -> EloRule:
        if spark.read.json(path).first()["kind"] != "elo_rule":
            raise ValueError(f"{path} holds another model")
        return cls().fit(None)


class RandomBaseline(EloRule):
    def __init__(self, seed: int = 1):
        self.seed = seed

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("p", F.pmod(F.xxhash64("match_id", F.lit(self.seed)), F.lit(1_000_000)) / 1_000_000)


class Learned(Model):
    """An ML classifier over numeric features; rows without a rating difference are not used, other
    missing values are 0."""

    def __init__(self, classifier, features: tuple[str, ...] = ("elo_difference", "recent_winrate_difference")):
        self.classifier, self.features = classifier, list(features)

    def ready(self, rows: DataFrame) -> DataFrame:
        """The rows that are used, without nulls in the features, and ``label``."""
        used = rows.na.drop(subset=[c for c in ELO if c in rows.columns]).na.fill(0, subset=self.features)
        return used.withColumn("label", F.col("radiant_win").cast("double"))

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(self.ready(rows))

    def fit(self, rows: DataFrame) -> Learned:
        self.model, self.fitted = self.classifier.fit(self._vectors(rows)), True
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit comes before predict")
        out = self.model.transform(self._vectors(rows)).withColumn("p", vector_to_array("probability")[1])
        return out.select(*rows.columns, "p")

    def feature_importance(self) -> dict[str, float] | None:
        found = getattr(self.model, "featureImportances", None) or getattr(self.model, "coefficients", None)
        return None if found is None else dict(zip(self.features, found.toArray().tolist()))

    def save(self, path: str) -> None:
        """The features' names go with the fitted model."""
        if not self.fitted:
            raise RuntimeError("fit comes before save")
        PipelineModel([VectorAssembler(inputCols=self.features, outputCol="features"), self.model]).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Learned:
        """Fitted, ready to predict; it can't be fitted again."""
        assembler, model = PipelineModel.load(path).stages
        out = cls(None, tuple(assembler.getInputCols()))
        out.model, out.fitted = model, True
        return out


def _tree_paths(node, values: Callable, features: list[str]) -> tuple[float, dict[str, Column]]:
    """The node's value, and per feature what the splits on it add on a row's way down from here."""
    value = values(node)
    if "InternalNode" not in node.getClass().getName():
        return value, {}
    left, right = (_tree_paths(n, values, features) for n in (node.leftChild(), node.rightChild()))
    by = features[node.split().featureIndex()]
    goes_left = F.col(by) <= node.split().threshold()
    none = F.lit(0.0)
    out = {f: F.when(goes_left, left[1].get(f, none)).otherwise(right[1].get(f, none)) for f in {*left[1], *right[1]}}
    step = F.when(goes_left, left[0] - value).otherwise(right[0] - value)
    out[by] = out[by] + step if by in out else step
    return value, out


def attributed(model: Model, rows: DataFrame, means: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with p, ``scale`` (logit or probability), ``baseline`` and ``contributions``, a map from
    feature to its share of the score; baseline and contributions sum to the score on that scale.

    Linear models: coefficient times deviation from ``means`` (of the training rows; 0 where not given).
    Trees: the change of the node's value along each row's path, credited to the feature split on. The
    Elo rule's logit is the rating difference on its scale.
    """
    if isinstance(model, EloRule):
        score = (F.col("radiant_elo") - F.col("dire_elo")) * (2.302585092994046 / 400)
        parts, baseline, scale = {"elo_difference": score}, F.lit(0.0), "logit"
        scored = model.predict(rows)
    else:
        scored, kind, names = model.predict(rows).na.fill(0, subset=model.features), type(model.model).__name__, model.features
        if hasattr(model.model, "coefficients"):
            weights, mean = model.model.coefficients.toArray().tolist(), means or {}
            parts = {f: w * (F.col(f) - mean.get(f, 0.0)) for f, w in zip(names, weights)}
            baseline, scale = F.lit(float(model.model.intercept) + sum(w * mean.get(f, 0.0) for f, w in zip(names, weights))), "logit"
        else:
            share = lambda node: (lambda s: s[1] / (s[0] + s[1]))(list(node.impurityStats().stats()))
            forest = "RandomForest" in kind
            trees = [(1 / len(model.model.trees) if forest else 2.0 * w, t) for t, w in zip(model.model.trees, model.model.treeWeights)]
            total, sums = 0.0, {}
            for weight, tree in trees:
                value, found = _tree_paths(tree._java_obj.rootNode(), share if forest else (lambda node: node.prediction()), names)
                total += weight * value
                for f, c in found.items():
                    sums[f] = sums[f] + weight * c if f in sums else weight * c
            parts, baseline, scale = sums, F.lit(total), "probability" if forest else "logit"
    cells = [x for f, c in sorted(parts.items()) for x in (F.lit(f), c.cast("double"))]
    told = F.create_map(*cells) if cells else F.create_map().cast("map<string,double>")
    return scored.withColumns({"scale": F.lit(scale), "baseline": baseline, "contributions": told})


def backtest(matches: DataFrame, k: float = K_FACTOR, base: float = BASE) -> DataFrame:
    """Walk forward: each contest is forecast from the ratings before it, then they are updated."""
    p = expected_score(F.col("radiant_pre"), F.col("dire_pre"))
    return rated(matches, k, base).select("match_id", "start_time", "radiant_pre", "dire_pre", p.alias("p"), F.col("radiant_win").alias("won"))


def sanity_fit(data: DataFrame) -> DataFrame:
    """Logistic regression on the rating difference alone, scored on its own rows. One row; its figures
    are null if there are under four rows or one class."""
    rows = data.na.drop(subset=list(ELO)).select(*ELO, "radiant_win")
    n, classes = rows.agg(F.count("*"), F.countDistinct("radiant_win")).first()
    schema = "n long, accuracy double, coefficient double, sign string"
    if n < 4 or classes < 2:
        return data.sparkSession.createDataFrame([(n, None, None, None)], schema)
    m = Learned(LogisticRegression(regParam=1 / n, standardization=False), ("elo_difference",)).fit(rows)
    coefficient = float(m.model.coefficients[0])
    accuracy = m.evaluate(rows)["accuracy"]
    return data.sparkSession.createDataFrame([(n, accuracy, coefficient, "positive" if coefficient > 0 else "negative")], schema)


def line_up(data: DataFrame, validation: str = "1999-01-01") -> DataFrame:
    """Every model fitted before ``validation`` and scored from there on."""
    cut, data = F.lit(validation).cast("timestamp_ntz"), data.persist()  # the ratings are walked once
    train, test = data.where(F.col("as_of_timestamp") < cut), data.where(F.col("as_of_timestamp") >= cut)
    models = {
        "random": RandomBaseline(),
        "elo_rule": EloRule(),
        "logistic_regression": Learned(LogisticRegression()),
        "random_forest": Learned(RandomForestClassifier(numTrees=10, maxDepth=4, seed=1)),
        "boosted_trees": Learned(GBTClassifier(maxIter=5, maxDepth=3, seed=1)),
    }
    scored = [m.fit(train).predict(test).select(F.lit(name).alias("model"), "p", F.col("radiant_win").alias("won")) for name, m in models.items()]
    return metrics.summary(reduce(DataFrame.unionByName, scored), "model")


def _on_scale(fit: Column, features: list[str]) -> list[Column]:
    """1 for the intercept, then each feature less its mean over its deviation, as ``fit`` has them."""
    return [F.lit(1.0), *[(F.col(f) - fit[f"mean{i}"]) * fit[f"per{i}"] for i, f in enumerate(features, 1)]]


def _told(fits: list[dict]) -> Column:
    """Fits as one constant array of structs, in their order."""
    kinds = ", ".join(f"{k}: {'long' if k == 'm' else 'double'}" for k in fits[0])
    return F.from_json(F.lit(json.dumps(fits)), f"array<struct<{kinds}>>")


def growing_fits(rows: DataFrame, features: list[str], last: int, close: float = 1e-10, most: int = 60) -> list[dict]:
    """Logistic regressions of ``label`` on ``features``, without penalty: for each m up to ``last`` on the
    rows with ``period`` < m. Returned from the first m whose rows have both classes on (then all later
    ones have); each as m, means and inverse deviations of its rows and its coefficients on that scale.

    All are fitted at once: a Newton step of every fit is one aggregate over the rows, of which only sums
    per fit come to the driver, so the number of jobs doesn't grow with the number of fits. A step that
    doesn't lower the loss is halved. A fit ends with the step that promises under ``close`` of loss per
    row, so also where the classes can be parted and no optimum exists. A constant feature weighs 0.
    """
    names = list(range(len(features) + 1))
    each = rows.where(F.col("period") < last).withColumn("m", F.explode(F.sequence(F.col("period") + 1, F.lit(last).cast("long"))))
    spread = [c for i, f in enumerate(features, 1) for c in (F.avg(f).alias(f"mean{i}"), F.stddev_pop(f).alias(f"sd{i}"))]
    known = each.groupBy("m").agg(F.count("*").alias("n"), F.sum("label").alias("won"), *spread).orderBy("m").collect()
    todo = []
    for r in known:
        if 0 < r["won"] < r["n"]:
            scale = {k: v for i in names[1:] for k, v in ((f"mean{i}", r[f"mean{i}"]), (f"per{i}", 1 / r[f"sd{i}"] if r[f"sd{i}"] > 0 else 0.0))}
            todo.append({"m": r["m"], "n": r["n"], "scale": scale, "at": np.zeros(len(names)), "from": None, "loss": math.inf, "done": False})
    fit, pairs = F.col("fit"), [(i, j) for i in names for j in names[: i + 1]]
    as_row = lambda t: {"m": t["m"], **t["scale"], **{f"b{i}": float(b) for i, b in enumerate(t["at"])}}
    for _ in range(most):
        if all(t["done"] for t in todo):
            break
        live = todo[: 1 + max(i for i, t in enumerate(todo) if not t["done"])]
        start = F.greatest(F.col("period") + 2 - live[0]["m"], F.lit(1)).cast("int")
        seen = rows.where(F.col("period") < live[-1]["m"])
        seen = seen.select("label", *features, F.explode(F.slice(_told([as_row(t) for t in live]), start, len(live))).alias("fit"))
        seen = seen.select("label", fit["m"].alias("m"), *[x.alias(f"x{i}") for i, x in enumerate(_on_scale(fit, features))], *[fit[f"b{i}"].alias(f"b{i}") for i in names])
        seen = seen.withColumn("z", reduce(Column.__add__, [F.col(f"b{i}") * F.col(f"x{i}") for i in names])).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        z, miss, weight = F.col("z"), F.col("label") - F.col("p"), F.col("p") * (1 - F.col("p"))
        sums = [F.sum(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("label") * z).alias("loss")]
        sums += [F.sum(miss * F.col(f"x{i}")).alias(f"g{i}") for i in names] + [F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs]
        found = {r["m"]: r for r in seen.groupBy("m").agg(*sums).collect()}  # a row of sums per fit
        for t in live:
            if t["done"]:
                continue
            r = found[t["m"]]
            if r["loss"] > t["loss"] + 1e-12 * t["n"]:
                t["at"] = (t["at"] + t["from"]) / 2
                continue
            slope, bend = np.array([r[f"g{i}"] for i in names]), np.zeros((len(names), len(names)))
            for i, j in pairs:
                bend[i, j] = bend[j, i] = r[f"h{i}_{j}"]
            step = np.linalg.lstsq(bend, slope, rcond=1e-12)[0]
            t["from"], t["at"], t["loss"], t["done"] = t["at"], t["at"] + step, r["loss"], bool(slope @ step <= close * t["n"])
    for t in todo:
        if not t["done"]:
            t["at"] = t["from"]  # the last one whose loss is known
    return [as_row(t) for t in todo]


def rolling_retrain(data: DataFrame, every_days: int = 90) -> DataFrame:
    """Refit on all data so far at each cutoff; score until the next. A cutoff whose contests so far have
    one outcome only has no fit, and its contests until the next no score."""
    at, model = F.col("as_of_timestamp").cast("timestamp_ntz"), Learned(None)
    # what the fits need of the data is written once, so the ratings are walked once
    rows = data.select("as_of_timestamp", "radiant_win", *dict.fromkeys([*model.features, *[c for c in ELO if c in data.columns]]))
    rows = stored(rows.withColumn("as_of_timestamp", at), "retrain")
    first, last = rows.agg(F.min("as_of_timestamp"), F.max("as_of_timestamp")).first()
    none = data.sparkSession.createDataFrame([], "cutoff timestamp_ntz, accuracy double, log_loss double, brier double, n long")
    if first is None:
        return none
    begin = F.lit(first).cast("timestamp_ntz")
    period = F.floor(F.timestamp_diff("DAY", begin, F.col("as_of_timestamp")) / every_days)
    rows = model.ready(rows).where("label is not null").select("label", period.alias("period"), *[F.col(f).cast("double") for f in model.features])
    fits = growing_fits(rows, model.features, (last - first) // timedelta(days=every_days))
    if not fits:
        return none
    fit = F.get(_told(fits), (F.col("period") - fits[0]["m"]).cast("int"))
    scored = rows.where(F.col("period") >= fits[0]["m"]).withColumn("fit", fit)
    z = reduce(Column.__add__, [F.col("fit")[f"b{i}"] * x for i, x in enumerate(_on_scale(F.col("fit"), model.features))])
    cutoff = F.timestamp_add("DAY", (F.col("period") * every_days).cast("int"), begin)
    return metrics.summary(scored.select(cutoff.alias("cutoff"), (1 / (1 + F.exp(-z))).alias("p"), (F.col("label") == 1).alias("won")), "cutoff")


def calibrated(forecasts: DataFrame, validation: str, test: str) -> DataFrame:
    """Platt and isotonic calibration, fitted on the validation span only and applied from ``test`` on."""
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    logit = F.ln(F.col("p") / (1 - F.col("p")))
    rows = forecasts.withColumns({"elo_difference": logit, "radiant_win": F.col("won"), "label": F.col("won").cast("double")})
    fit = rows.where((F.col("start_time") >= ts(validation)) & (F.col("start_time") < ts(test)))
    held = rows.where(F.col("start_time") >= ts(test))
    platt = Learned(LogisticRegression(), ("elo_difference",)).fit(fit)
    out = platt.predict(held.withColumnRenamed("p", "raw")).withColumnRenamed("p", "platt")
    iso = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="isotonic").fit(fit.withColumnRenamed("p", "raw"))
    return iso.transform(out).select("match_id", "raw", "platt", "isotonic", "won")


def opponent_adjusted(matches: DataFrame) -> DataFrame:
    """Share of wins before each contest, each weighed with the opponent's rating then."""
    log = rating_log(rated(matches)).select("match_id", F.col("team_id").alias("opponent_id"), F.col("rating_before").alias("opponent_elo"))
    rows = team_centric(matches).join(log, ["match_id", "opponent_id"])
    share = F.sum(won() * F.col("opponent_elo")).over(before()) / F.sum("opponent_elo").over(before())
    return rows.select("match_id", "team_id", share.alias("adjusted_winrate"))


def against_top(matches: DataFrame, top: int = 20, least: int = 3) -> DataFrame:
    """Win rate before each contest over meetings with teams that ranked in the first ``top`` by rating
    then; null under ``least`` such meetings.

    A team's rank at a contest counts the teams rated higher at that moment; it comes from the ordered
    fold that makes the ratings.
    """
    ranks = ranked(matches)
    rows = team_centric(matches).join(ranks, "match_id")
    place = F.when(F.col("is_radiant"), F.col("dire_rank")).otherwise(F.col("radiant_rank"))
    rows = rows.withColumn("top", F.when(place <= top, 1.0))
    n, wins = F.count("top").over(before()), F.sum(F.when(F.col("top").isNotNull(), won())).over(before())
    return rows.select("match_id", "team_id", F.when(n >= least, wins / n).alias("vs_top_winrate"), n.alias("vs_top_meetings"))
