"""Matchers of MLlib over pair measures: fitted on one fold, calibrated on another, judged on a third; folds, stacks, trials."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import stages, tuning
from kinweave.sources import tables

#: Measures without string alignment, for the pruner.
CHEAP = ["eq_n_core", "eq_n_skel", "eq_a_canon", "n_tok_shared", "n_tok_jacc", "n_tok_over", "a_tok_jacc", "a_num_jacc", "a_num_conflict", "both_addr_missing"]
FEATURES = [*CHEAP, "eq_n_basic", "eq_n_squash", "n_lev", "p"]


def _scaled(model: object) -> Pipeline:
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), model])


#: Models by kind, for a number of features and of rounds. There is no ranking loss in MLlib.
MODELS: dict[str, Callable] = {
    "gbt": lambda n, rounds: GBTClassifier(maxIter=rounds, maxDepth=4, seed=7, labelCol="y", validationIndicatorCol="held", validationTol=0.001),
    "forest": lambda n, rounds: RandomForestClassifier(numTrees=rounds, maxDepth=8, seed=7, labelCol="y"),
    "lr": lambda n, rounds: _scaled(LogisticRegression(maxIter=50, regParam=0.01, labelCol="y", featuresCol="scaled")),
    "mlp": lambda n, rounds: _scaled(MultilayerPerceptronClassifier(layers=[n, 16, 2], maxIter=60, seed=7, labelCol="y", featuresCol="scaled")),
}


def refit_rounds(best: int) -> int:
    """Rounds for a fit on all folds, after early stopping on one found ``best``."""
    return max(50, round(best * 1.15))


def assembled(rows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Measures as a vector; undefined ones are -1."""
    rows = rows.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features})
    out = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(rows)
    return out.drop(*[f"_f_{c}" for c in features])


def scored_by(kind: str, fit: DataFrame, held: DataFrame, rows: DataFrame, features: list[str], rounds: int = 20) -> DataFrame:
    """``rows`` with ``raw``, the probability by a model of ``kind`` fitted on ``fit`` and stopped on ``held``.

    All have ``features`` and ``y``. If one of the fit's classes is absent, ``raw`` is p.
    """
    if fit.select("y").distinct().count() < 2:
        return rows.withColumn("raw", F.col("p").cast("double"))
    own = fit.select("features", "y").withColumn("held", F.lit(False))
    if kind == "gbt":
        own = own.unionByName(held.select("features", "y").withColumn("held", F.lit(True)))
    model = MODELS[kind](len(features), rounds)
    if kind == "gbt" and held.isEmpty():
        model = GBTClassifier(maxIter=rounds, maxDepth=4, seed=7, labelCol="y")
    got = model.fit(own).transform(rows)
    return got.withColumn("raw", F.element_at(vector_to_array("probability"), 2)).drop("scaled", "rawPrediction", "probability", "prediction")


def calibrated(rows: DataFrame) -> DataFrame:
    """``probability`` from ``raw`` by isotonic regression on the tuning fold, clipped to 1e-4 from 0 and 1."""
    tune = rows.filter("fold = 'tune'").select(F.col("raw").alias("features"), F.col("y").cast("double").alias("label"))
    if tune.isEmpty():
        return rows.withColumn("probability", F.col("raw"))
    placed = IsotonicRegression(featuresCol="_raw", labelCol="label").fit(tune.withColumnRenamed("features", "_raw")).transform(rows.withColumn("_raw", F.col("raw")))
    return placed.withColumn("probability", F.greatest(F.least("prediction", F.lit(1 - 1e-4)), F.lit(1e-4))).drop("prediction", "_raw")


def with_folds(world: tables.World, rows: DataFrame) -> DataFrame:
    return rows.join(tables.folds(world.queries.select("id")).select(F.col("id").alias("q_id"), "fold", "half"), "q_id")


OUT = ["q_id", "p_id", "fold", "y", "probability"]


def fit_and_score(world: tables.World, rows: DataFrame, kind: str = "gbt", features: list[str] = FEATURES) -> DataFrame:
    """q_id, p_id, fold, y and the calibrated probability by one model of the fit fold, which its own rows see in sample."""
    data = assembled(with_folds(world, rows), features)
    return calibrated(scored_by(kind, data.filter("fold = 'fit'"), data.filter("fold = 'tune'"), data, features)).select(*OUT)


def out_of_fold(world: tables.World, rows: DataFrame, kind: str = "gbt", features: list[str] = FEATURES) -> DataFrame:
    """As ``fit_and_score``, but the fit fold's rows get their probability from a model of its other half."""
    data = assembled(with_folds(world, rows), features)
    fit, held = data.filter("fold = 'fit'"), data.filter("fold = 'tune'")
    parts = [scored_by(kind, fit, held, data.filter("fold <> 'fit'"), features)]
    parts += [scored_by(kind, fit.filter(F.col("half") != h), held, fit.filter(F.col("half") == h), features) for h in (0, 1)]
    columns = ["q_id", "p_id", "fold", "y", "raw"]
    return calibrated(reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])).select(*OUT)


def importance(world: tables.World, rows: DataFrame, most: int = 15, features: list[str] = FEATURES) -> list[tuple[str, float]]:
    """The measures that the trees gain most from."""
    data = assembled(with_folds(world, rows), features).filter("fold = 'fit'")
    model = GBTClassifier(maxIter=20, maxDepth=4, seed=7, labelCol="y").fit(data.select("features", "y"))
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:most]


def prune(world: tables.World, rows: DataFrame, budget: float = 0.001, kind: str = "gbt") -> tuple[DataFrame, dict]:
    """Rows that the cut of the cheap model keeps, with ``pr_p``, and the cut.

    The cut is the one with the fewest candidates on the tuning fold that costs an oracle no more than ``budget``.
    """
    scores = out_of_fold(world, rows, kind, CHEAP).select("q_id", "p_id", "fold", F.col("probability").alias("pr_p"))
    own = rows.join(scores, ["q_id", "p_id"])
    ranked = stages.rank_gap(stages.rank_gap(own, "pr_p", "q_id", "_q"), "pr_p", "p_id", "_p").withColumnsRenamed({"_q_rank": "qr", "_p_rank": "pr"}).drop("_q_gap", "_p_gap")
    judged = tables.folds(world.queries.select("id")).filter("fold = 'tune'").select(F.col("id").alias("q_id")).join(world.truth.groupBy("q_id").agg(F.count("*").alias("n_true")), "q_id", "left").fillna(0, ["n_true"])
    tune = ranked.filter("fold = 'tune'").withColumn("p", F.col("pr_p"))
    points = tuning.cut_frontier(tune, judged, [0, 3, 6], [0, 3, 5, 10], [0.0, 0.001, 0.005, 0.02, 0.05, 0.1]).persist()
    before = points.agg(F.max("oracle")).first()[0] or 0.0
    cut = tuning.choose_cut(points, before, budget)
    points.unpersist()
    kept = ranked.filter(F.col("pr_p") >= cut["t"]).filter((F.lit(cut["n_max"]) == 0) | (F.col("qr") <= cut["n_max"])).filter((F.lit(cut["m_pool"]) == 0) | (F.col("pr") <= cut["m_pool"]))
    return kept.drop("qr", "pr", "fold"), cut


def tuned_f05(world: tables.World, rows: DataFrame, scores: DataFrame, fold: str = "tune") -> float:
    """Macro F0.5 of the best threshold on a fold."""
    own = scores.filter(F.col("fold") == fold).join(rows.select("q_id", "p_id", "src"), ["q_id", "p_id"]).select("q_id", "p_id", "src", F.col("probability").alias("p"), "y")
    judged = tables.folds(world.queries.select("id")).filter(F.col("fold") == fold).select(F.col("id").alias("q_id")).join(world.truth.groupBy("q_id").agg(F.count("*").alias("n_true")), "q_id", "left").fillna(0, ["n_true"])
    return tuning.tune_global(tuning.placed(own), judged)[1]


def ablation(world: tables.World, rows: DataFrame, groups: dict[str, list[str]], kind: str = "gbt") -> dict[str, float]:
    """What leaving out each group of measures does to the tuned F0.5, against all of them."""
    whole = tuned_f05(world, rows, fit_and_score(world, rows, kind))
    out = {"all": whole}
    for name, columns in groups.items():
        left = [c for c in FEATURES if c not in columns]
        out[name] = tuned_f05(world, rows, fit_and_score(world, rows, kind, left)) - whole
    return out


def search(world: tables.World, rows: DataFrame, kinds: dict[str, list[int]]) -> tuple[str, int, float]:
    """The kind of model and its rounds with the best tuned F0.5 among those given."""
    data = assembled(with_folds(world, rows)).persist()
    best = ("", 0, -1.0)
    for kind, rounds in kinds.items():
        for n in rounds:
            got = calibrated(scored_by(kind, data.filter("fold = 'fit'"), data.filter("fold = 'tune'"), data, FEATURES, n)).select(*OUT)
            score = tuned_f05(world, rows, got)
            best = (kind, n, score) if score > best[2] + 1e-9 else best
    data.unpersist()
    return best


def transfer(world: tables.World, rows: DataFrame, kind: str = "lr") -> dict[tuple[str, str], float]:
    """Tuned F0.5 on each country of a model fitted on each other country's fit fold, and on its own."""
    countries = sorted(r[0] for r in world.queries.select("country").distinct().collect() if r[0] is not None)
    named = assembled(with_folds(world, rows)).join(world.queries.select(F.col("id").alias("q_id"), "country"), "q_id").persist()
    out = {}
    for source in countries:
        got = scored_by(kind, named.filter((F.col("fold") == "fit") & (F.col("country") == source)), named.limit(0), named, FEATURES).withColumn("probability", F.col("raw"))
        for target in countries:
            own = tables.World(world.queries.filter(F.col("country") == target), world.pool, world.truth)
            out[source, target] = tuned_f05(own, rows, got.filter(F.col("country") == target))
    named.unpersist()
    return out
