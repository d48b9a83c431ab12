"""Training, comparing, tuning and keeping Spark ML models."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_double, categorical_columns, col, quote, require_columns
from ..functions.ordering import SEED, WHOLE, chunk_number, hash_cuts
from ..functions.session import local_table
from ..functions.stats import ratio, rounded
from .boosting import Boosting, fit_boosted
from .evaluation import LABEL, PREDICTION, PROBABILITY, prediction_sample, regression_scores
from .exact_trees import fit_exact_tree
from .ridge import fit_ridge
from .splits import FOLD, SPLIT, WEIGHT, Scaler, create_folds, fit_scaler

# Model names, their default settings and the tuning grids.
CLASSIFIERS: dict[str, dict[str, Any]] = {
    "logistic_regression": {"C": 1.0, "penalty": "l2", "max_iter": 1000},
    "ridge_classifier": {"alpha": 1.0},
    "decision_tree": {"max_depth": 10},
    "random_forest": {"n_estimators": 50, "max_depth": 8},
    "gradient_boosting": {"n_estimators": 50, "max_depth": 5, "learning_rate": 0.1},
    "lightgbm": {"n_estimators": 50, "max_depth": 6, "learning_rate": 0.1},
}
REGRESSORS: dict[str, dict[str, Any]] = {
    "linear_regression": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0},
    "decision_tree": {"max_depth": 10},
    "random_forest": {"n_estimators": 50, "max_depth": 8},
    "gradient_boosting": {"n_estimators": 50, "max_depth": 5, "learning_rate": 0.1},
    "lightgbm": {"n_estimators": 50, "max_depth": 6, "learning_rate": 0.1},
}
GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "penalty": ["l1", "l2"]},
    "ridge_classifier": {"alpha": [0.1, 1.0, 10.0]},
    "ridge": {"alpha": [0.1, 1.0, 10.0]},
    "lasso": {"alpha": [0.01, 0.1, 1.0]},
    "linear_regression": {},
    "decision_tree": {"max_depth": [5, 10, 15], "min_samples_split": [2, 5]},
    "random_forest": {"n_estimators": [30, 50], "max_depth": [5, 8], "min_samples_leaf": [2, 4]},
    "gradient_boosting": {"n_estimators": [30, 50], "max_depth": [3, 5], "learning_rate": [0.05, 0.1]},
    "lightgbm": {"n_estimators": [30, 50], "max_depth": [5, 8], "learning_rate": [0.05, 0.1]},
}
# Rows from which a part of a table for many fits is worth a task of its own.
PART_ROWS = 50_000
# Boosting takes no class weights.
UNWEIGHTED = {"gradient_boosting"}

PROBABILITIES = "probabilities"
VECTOR, INDEX, RAW, PROB, CALL = "_features", "_label", "_raw", "_probability", "_prediction"


@dataclass(frozen=True)
class ModelSpec:
    """What to fit: kept with the model so that it can be fitted again."""

    model_type: str
    problem_type: str
    target: str
    features: list[str]
    params: dict[str, Any] = field(default_factory=dict)
    scale: bool = False
    weighted: bool = False


@dataclass(frozen=True)
class TrainedModel:
    spec: ModelSpec
    classes: list[str]
    pipeline: PipelineModel

    @property
    def has_probability(self) -> bool:
        """Whether the model gives class probabilities; least squares on classes does not."""
        return any(s.hasParam("probabilityCol") and s.getOrDefault("probabilityCol") == PROB for s in self.pipeline.stages)


def registry(problem_type: str) -> dict[str, dict[str, Any]]:
    if problem_type == "classification":
        return CLASSIFIERS
    if problem_type == "regression":
        return REGRESSORS
    raise ValueError(f"problem_type={problem_type!r} is neither classification nor regression")


def make_spec(
    df: DataFrame,
    target: str,
    model_type: str,
    problem_type: str,
    features: Sequence[str] | None = None,
    params: dict[str, Any] | None = None,
    scale: bool = False,
) -> ModelSpec:
    """Check the request against the schema; features default to all but target and ``_`` columns."""
    known = registry(problem_type)
    if model_type not in known:
        raise ValueError(f"model_type={model_type!r} is none of {list(known)}")
    require_columns(df, [target, *(features or [])])
    names = list(features) if features else [c for c in df.columns if c != target and not c.startswith("_")]
    text = categorical_columns(df.select(*[col(c) for c in names]))
    if text:
        raise ValueError(f"Features must be numbers, but {text} are not: encode or drop them")
    weighted = problem_type == "classification" and WEIGHT in df.columns and model_type not in UNWEIGHTED
    return ModelSpec(model_type, problem_type, target, names, {**known[model_type], **(params or {})}, scale, weighted)


# --- preparing and fitting ------------------------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """Assembled rows (vector, label index or number, carried columns) and the stages behind them."""

    rows: DataFrame
    stages: list[Transformer]
    classes: list[str]


def _feature_stages(features: list[str], scaler: Scaler | None) -> list[Transformer]:
    exprs = []
    for i, c in enumerate(features):
        x = f"CAST({quote(c)} AS DOUBLE)"
        if scaler:
            x = f"({x} - ({scaler.means[c]!r}D)) / {scaler.stds[c]!r}D"
        exprs.append(f"{x} AS _f{i}")
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol=VECTOR, handleInvalid="error"),
    ]


def _classes(df: DataFrame, target: str) -> list[str]:
    """Labels in ascending order (numbers by size), as text. The fitted model holds every one of them."""
    found = df.where(col(target).isNotNull()).groupBy(col(target).alias("v")).agg(F.first(col(target).cast("string")).alias("s"))
    return [r["s"] for r in sorted(found.collect(), key=lambda r: r["v"])]


def prepare(df: DataFrame, spec: ModelSpec, carry: Sequence[str] = ()) -> Prepared:
    """Assemble feature vectors once for any number of fits; the caller persists ``rows``."""
    stages = _feature_stages(spec.features, fit_scaler(df, spec.features) if spec.scale else None)
    classes: list[str] = []
    labelled = df
    if spec.problem_type == "classification":
        classes = _classes(df, spec.target)
        if len(classes) < 2:
            raise ValueError(f"Column {spec.target!r} holds fewer than two classes to tell apart")
        labelled = df.withColumn("_text", col(spec.target).cast("string"))
        indexer = StringIndexerModel.from_labels(classes, inputCol="_text", outputCol=INDEX, handleInvalid="error")
        labelled = indexer.transform(labelled)
    else:
        labelled = df.withColumn(INDEX, as_double(spec.target))
    out = labelled
    for s in stages:
        out = s.transform(out)
    weight = [F.coalesce(col(WEIGHT), F.lit(1.0)).alias(WEIGHT)] if spec.weighted else []
    rows = out.select(VECTOR, INDEX, *weight, *[col(c) for c in carry])
    return Prepared(rows, stages, classes)


def _estimators(rows: DataFrame, spec: ModelSpec, n_classes: int) -> list[Transformer]:
    """Fit the estimator on assembled rows."""
    p, kind = spec.params, spec.model_type
    io = {"featuresCol": VECTOR, "labelCol": INDEX, "predictionCol": CALL}
    votes = {**io, "rawPredictionCol": RAW, "probabilityCol": PROB}
    weight = {"weightCol": WEIGHT} if spec.weighted else {}
    leaf = p.get("min_samples_leaf", 2 if p.get("min_samples_split", 2) > 2 else 1)
    if kind == "decision_tree" and p.get("exact_splits"):
        return [_exact_tree(rows, spec, n_classes)]
    if spec.problem_type == "classification":
        if kind == "logistic_regression":
            mass = rows.agg(F.sum(WEIGHT) if spec.weighted else F.count(F.lit(1))).first()[0]
            return [
                LogisticRegression(
                    **votes,
                    **weight,
                    regParam=1.0 / (p["C"] * mass),
                    elasticNetParam=1.0 if p["penalty"] == "l1" else 0.0,
                    standardization=False,
                    maxIter=p["max_iter"],
                    tol=1e-8,
                ).fit(rows)
            ]
        if kind == "ridge_classifier":
            weighted = WEIGHT if spec.weighted else None
            return [fit_ridge(rows, VECTOR, INDEX, n_classes, p["alpha"], weighted, predictionCol=CALL)]
        if kind == "decision_tree":
            tree = DecisionTreeClassifier(**votes, **weight, maxDepth=p["max_depth"], minInstancesPerNode=leaf, seed=SEED)
            return [tree.fit(rows)]
        if kind == "random_forest":
            forest = RandomForestClassifier(
                **votes,
                **weight,
                numTrees=p["n_estimators"],
                maxDepth=p["max_depth"],
                minInstancesPerNode=leaf,
                featureSubsetStrategy="sqrt",
                seed=SEED,
            )
            return [forest.fit(rows)]
        if kind == "gradient_boosting" and n_classes == 2:
            boost = {"maxIter": p["n_estimators"], "maxDepth": p["max_depth"], "stepSize": p["learning_rate"], "seed": SEED}
            boosted = GBTClassifier(**io, **weight, **boost).setRawPredictionCol(RAW).setProbabilityCol(PROB)
            return [boosted.fit(rows)]
        return [_boosted(rows, spec, n_classes)]
    if kind == "linear_regression":
        return [LinearRegression(**io, regParam=0.0).fit(rows)]
    if kind == "ridge":
        return [fit_ridge(rows, VECTOR, INDEX, 0, p["alpha"], predictionCol=CALL)]
    if kind == "lasso":
        lasso = LinearRegression(
            **io, regParam=p["alpha"], elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-10
        )
        return [lasso.fit(rows)]
    if kind == "decision_tree":
        return [DecisionTreeRegressor(**io, maxDepth=p["max_depth"], minInstancesPerNode=leaf, seed=SEED).fit(rows)]
    if kind == "random_forest":
        forest = RandomForestRegressor(
            **io,
            numTrees=p["n_estimators"],
            maxDepth=p["max_depth"],
            minInstancesPerNode=leaf,
            featureSubsetStrategy="all",
            seed=SEED,
        )
        return [forest.fit(rows)]
    if kind == "lightgbm":
        return [_boosted(rows, spec, 0)]
    boost_regressor = GBTRegressor(
        **io, maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=p["learning_rate"], seed=SEED
    )
    return [boost_regressor.fit(rows)]


def _exact_tree(rows: DataFrame, spec: ModelSpec, n_classes: int) -> Transformer:
    """Cuts between all distinct values instead of those between the bins of a sample."""
    p = spec.params
    n_classes = n_classes if spec.problem_type == "classification" else 0
    columns = {"predictionCol": CALL, **({"probabilityCol": PROB} if n_classes else {})}
    weight = WEIGHT if spec.weighted else None
    least = p.get("min_samples_split", 2), p.get("min_samples_leaf", 1)
    return fit_exact_tree(rows, VECTOR, INDEX, len(spec.features), n_classes, p["max_depth"], *least, weight, **columns)


def _boosted(rows: DataFrame, spec: ModelSpec, n_classes: int) -> Transformer:
    """Leaf-wise trees, or for boosting of three or more classes a tree a class, grown to their depth."""
    names = ["n_estimators", "max_depth", "learning_rate", "num_leaves", "min_child_samples", "min_child_weight"]
    asked = {k: spec.params[k] for k in names if k in spec.params}
    if spec.model_type == "gradient_boosting":
        asked.update(num_leaves=1 << asked["max_depth"], min_child_samples=1, min_child_weight=0.0, newton_gain=False)
    columns = {"predictionCol": CALL, **({"probabilityCol": PROB} if n_classes else {})}
    weight = WEIGHT if spec.weighted else None
    return fit_boosted(rows, VECTOR, INDEX, len(spec.features), n_classes, Boosting(**asked), weight, **columns)


def _finish(prepared: Prepared, spec: ModelSpec, fitted: list[Transformer]) -> TrainedModel:
    return TrainedModel(spec, prepared.classes, PipelineModel([*prepared.stages, *fitted]))


def _training_rows(df: DataFrame) -> DataFrame:
    return df.where(col(SPLIT) == "train") if SPLIT in df.columns else df


def _test_rows(df: DataFrame) -> DataFrame:
    if SPLIT not in df.columns:
        raise ValueError(f"No '{SPLIT}' column: run split_data first")
    return df.where(col(SPLIT) == "test")


def fit_model(train_rows: DataFrame, spec: ModelSpec) -> TrainedModel:
    """Fit one model on all given rows."""
    prepared = prepare(train_rows, spec)
    rows = prepared.rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _finish(prepared, spec, _estimators(rows, spec, len(prepared.classes)))
    finally:
        rows.unpersist()


def score(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``, and for two classes with probabilities ``probability`` of the greater one.

    Also adds ``label`` where the target is at hand. Lazy; works on a streaming table.
    """
    out = model.pipeline.transform(df)
    columns = [col(c) for c in df.columns if c not in (LABEL, PREDICTION, PROBABILITY) or c == model.spec.target]
    if model.spec.target in df.columns and model.spec.target != LABEL:
        columns.append(col(model.spec.target).alias(LABEL))
    if model.classes:
        named = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col(CALL).cast("int"))
        columns.append(named.alias(PREDICTION))
    else:
        columns.append(F.col(CALL).alias(PREDICTION))
    if model.has_probability and len(model.classes) == 2:
        columns.append(vector_to_array(F.col(PROB))[1].alias(PROBABILITY))
    return out.select(*columns)


def class_probabilities(model: TrainedModel, df: DataFrame) -> DataFrame:
    """``score`` with one more column, ``probabilities``: a map from every class to its probability."""
    if not model.has_probability:
        raise ValueError(f"A {model.spec.model_type} gives no probabilities")
    out = model.pipeline.transform(df)
    kept = [col(c) for c in df.columns if c not in (PREDICTION, PROBABILITIES)]
    shares = F.map_from_arrays(F.array(*[F.lit(c) for c in model.classes]), vector_to_array(F.col(PROB)))
    named = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col(CALL).cast("int"))
    return out.select(*kept, named.alias(PREDICTION), shares.alias(PROBABILITIES))


def train(
    df: DataFrame,
    target: str,
    model_type: str = "logistic_regression",
    problem_type: str = "classification",
    features: Sequence[str] | None = None,
    params: dict[str, Any] | None = None,
    scale: bool = False,
) -> tuple[TrainedModel, DataFrame]:
    """Fit on the training rows; returns the model and the scored test rows."""
    spec = make_spec(df, target, model_type, problem_type, features, params, scale)
    model = fit_model(_training_rows(df), spec)
    return model, score(model, _test_rows(df))


def retrain_full(model: TrainedModel, df: DataFrame) -> TrainedModel:
    """The same settings fitted again on train and test rows, its scaling included."""
    everything = df.drop(SPLIT)
    return fit_model(everything, replace(model.spec, weighted=model.spec.weighted and WEIGHT in df.columns))


def preview_predictions(model: TrainedModel, df: DataFrame, n: int = 10, keys: Sequence[str] | None = None) -> DataFrame:
    return prediction_sample(score(model, _test_rows(df) if SPLIT in df.columns else df), n, keys).drop("mismatch")


# --- comparing, validating, tuning ----------------------------------------------------------------


def _metric_name(problem_type: str) -> str:
    return "accuracy" if problem_type == "classification" else "r2"


def _judge(predicted: DataFrame, problem_type: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of assembled, predicted rows, per group if asked."""
    y, p = F.col(INDEX), F.col(CALL)
    if problem_type == "classification":
        aggs = [ratio(F.count_if(y == p), F.count(F.lit(1))).alias("accuracy")]
    else:
        found = regression_scores(y, p)
        aggs = [found[m].alias(m) for m in ("r2", "mae", "rmse")]
    return predicted.groupBy(*by).agg(*aggs)


def _predict(stages: list[Transformer], rows: DataFrame) -> DataFrame:
    for s in stages:
        rows = s.transform(rows)
    return rows


def compare_models(
    df: DataFrame,
    target: str,
    problem_type: str = "classification",
    model_types: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    params: dict[str, dict[str, Any]] | None = None,
    scale: bool = False,
    parallelism: int = 4,
) -> tuple[DataFrame, TrainedModel | None]:
    """Fit every model on the same assembled rows, side by side; one that fails is reported, not fatal.

    Returns ``model, accuracy | r2, mae, rmse, status`` best first (the first of equals), and the best.
    """
    known = registry(problem_type)
    names = list(model_types or known)
    specs = {
        m: make_spec(df, target, m, problem_type, features, (params or {}).get(m), scale) for m in names
    }
    widest = next((s for s in specs.values() if s.weighted), specs[names[0]])
    prepared = prepare(df, widest, [SPLIT])
    rows = prepared.rows.persist(StorageLevel.MEMORY_AND_DISK)
    metric = _metric_name(problem_type)
    fields = [metric] if metric == "accuracy" else ["r2", "mae", "rmse"]
    results, best, best_score = [], None, -math.inf

    def run(spec: ModelSpec) -> tuple[list[Transformer], Any] | Exception:
        try:
            fitted = _estimators(rows.where(col(SPLIT) == "train"), spec, len(prepared.classes))
            return fitted, _judge(_predict(fitted, rows.where(col(SPLIT) == "test")), problem_type).first()
        except Exception as e:  # noqa: BLE001 - a failing model must not stop the others
            return e

    try:
        try:
            rows = _dealt(rows)
        except Exception:  # noqa: BLE001 - rows that cannot be assembled fail in every model, which reports it
            pass
        with ThreadPool(max(1, min(parallelism, len(specs)))) as pool:
            outcomes = pool.map(run, specs.values(), chunksize=1)
        for (m, spec), outcome in zip(specs.items(), outcomes):
            if isinstance(outcome, Exception):
                results.append((m, *[None] * len(fields), f"failed: {outcome}"))
                continue
            fitted, found = outcome
            results.append((m, *[None if found[f] is None else rounded(found[f]) for f in fields], "success"))
            if found[metric] is not None and found[metric] > best_score:
                best, best_score = _finish(prepared, spec, fitted), found[metric]
    finally:
        rows.unpersist()
    schema = "model string, " + ", ".join(f"{f} double" for f in fields) + ", status string"
    table = local_table(df.sparkSession, results, schema)
    return table.orderBy(F.col(metric).desc_nulls_last()), best


def _dealt(rows: DataFrame) -> DataFrame:
    """Persisted rows for many fits, dealt out evenly where a few parts hold most of them: a fit that scans them
    a hundred times is otherwise bound by its largest part. Parts stay above ``PART_ROWS`` rows."""
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, total // PART_ROWS)
    if parts < 2 or largest <= 1.5 * total / parts:
        return rows
    dealt = rows.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    dealt.count()
    rows.unpersist()
    return dealt


def _fold_scores(rows: DataFrame, spec: ModelSpec, n_classes: int, folds: Sequence[int]) -> list[float]:
    """For each given fold, fit on all others and predict it; they are judged in one aggregate."""
    held_out = None
    for i in folds:
        fitted = _estimators(rows.where(F.col(FOLD) != i), spec, n_classes)
        part = _predict(fitted, rows.where(F.col(FOLD) == i)).select(FOLD, INDEX, CALL)
        held_out = part if held_out is None else held_out.unionByName(part)
    metric = _metric_name(spec.problem_type)
    found = {r[FOLD]: r[metric] for r in _judge(held_out, spec.problem_type, [FOLD]).collect()}
    return [found[i] for i in folds]


def _with_folds(df: DataFrame, spec: ModelSpec, n_folds: int, keys: Sequence[str] | None) -> Prepared:
    folded = df if FOLD in df.columns else create_folds(df, spec.target, n_folds, keys, stratify=spec.problem_type == "classification")
    return prepare(folded, spec, [FOLD])


def cross_validate(
    df: DataFrame,
    target: str,
    model_type: str = "logistic_regression",
    problem_type: str = "classification",
    n_folds: int = 5,
    features: Sequence[str] | None = None,
    keys: Sequence[str] | None = None,
    params: dict[str, Any] | None = None,
) -> DataFrame:
    """``fold`` (from 1), ``score``: accuracy or R2 on each held-out fold."""
    spec = make_spec(df, target, model_type, problem_type, features, params)
    prepared = _with_folds(df, spec, n_folds, keys)
    rows = prepared.rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = _dealt(rows)
        scores = _fold_scores(rows, spec, len(prepared.classes), range(n_folds))
    finally:
        rows.unpersist()
    return local_table(df.sparkSession, [(i + 1, s) for i, s in enumerate(scores)], "fold int, score double")


def cv_summary(folds: DataFrame) -> DataFrame:
    """``mean_score`` and population ``std_score``."""
    return folds.agg(F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.stddev_pop("score"), 4).alias("std_score"))


def tune(
    df: DataFrame,
    target: str,
    model_type: str = "logistic_regression",
    problem_type: str = "classification",
    n_folds: int = 3,
    features: Sequence[str] | None = None,
    keys: Sequence[str] | None = None,
    grid: dict[str, list] | None = None,
    parallelism: int = 4,
) -> tuple[DataFrame, TrainedModel, DataFrame]:
    """Grid search by cross-validation on the training rows.

    Returns every setting with mean and std, the best one (first of equals) refitted on all training
    rows, and the scored test rows. The fits of all settings and folds run side by side as Spark jobs on one persisted table.
    """
    spec = make_spec(df, target, model_type, problem_type, features)
    grid = GRIDS.get(model_type, {}) if grid is None else grid
    if not grid:
        raise ValueError(f"{model_type!r} has no settings to search: train it directly")
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    prepared = _with_folds(_training_rows(df), spec, n_folds, keys)
    rows = prepared.rows.persist(StorageLevel.MEMORY_AND_DISK)

    def run(setting: dict[str, Any], fold: int) -> float:
        return _fold_scores(rows, replace(spec, params={**spec.params, **setting}), len(prepared.classes), [fold])[0]

    try:
        rows = _dealt(rows)
        fits = list(product(settings, range(n_folds)))
        with ThreadPool(max(1, min(parallelism, len(fits)))) as pool:
            found = pool.starmap(run, fits, chunksize=1)
        scores = [found[i : i + n_folds] for i in range(0, len(found), n_folds)]
        means = [sum(s) / n_folds for s in scores]
        stds = [math.sqrt(sum((x - m) ** 2 for x in s) / n_folds) for s, m in zip(scores, means)]
        best = max(range(len(settings)), key=lambda i: means[i])
        chosen = replace(spec, params={**spec.params, **settings[best]})
        model = _finish(prepared, chosen, _estimators(rows, chosen, len(prepared.classes)))
    finally:
        rows.unpersist()
    table = local_table(df.sparkSession, [
            (json.dumps(s, sort_keys=True), rounded(m), rounded(d), i == best)
            for i, (s, m, d) in enumerate(zip(settings, means, stds))
        ],
        "params string, mean_score double, std_score double, best boolean",
    )
    scored = score(model, _test_rows(df)) if SPLIT in df.columns else score(model, df)
    return table, model, scored


def learning_curve(
    df: DataFrame,
    model: TrainedModel,
    n_points: int = 10,
    keys: Sequence[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``size, train_score, val_score`` for growing parts (10 % .. 100 %) of one random order of the training rows."""
    spec = model.spec
    train_rows = _training_rows(df)
    keys = list(keys or train_rows.columns)
    n = train_rows.count()
    shares = [0.1 + 0.9 * i / (n_points - 1) for i in range(n_points)] if n_points > 1 else [0.1]
    sizes = [max(int(n * round(s, 12)), 2) for s in shares]
    ranks = local_table(df.sparkSession, [(WHOLE, n, i, s) for i, s in enumerate(sizes)], "part string, n long, cut int, rank long")
    placed = chunk_number(train_rows, None, keys, hash_cuts(train_rows, None, keys, ranks, seed), "_chunk", seed)
    test = _test_rows(df).withColumn("_chunk", F.lit(-1))
    everything = placed.unionByName(test)
    prepared = prepare(everything, spec, ["_chunk"])
    rows = prepared.rows.persist(StorageLevel.MEMORY_AND_DISK)
    metric, out = _metric_name(spec.problem_type), []
    try:
        for i, size in enumerate(sizes):
            part = rows.where(F.col("_chunk").between(0, i))
            if spec.problem_type == "classification" and part.select(INDEX).distinct().count() < 2:
                continue
            fitted = _estimators(part, spec, len(prepared.classes))
            seen = _predict(fitted, rows.where(F.col("_chunk") <= i)).withColumn("_test", F.col("_chunk") < 0)
            found = {r["_test"]: r[metric] for r in _judge(seen, spec.problem_type, ["_test"]).collect()}
            out.append((size, rounded(found[False]), rounded(found[True])))
    finally:
        rows.unpersist()
    return local_table(df.sparkSession, out, "size long, train_score double, val_score double")


# --- importances, files ---------------------------------------------------------------------------


def _importances(stage: Transformer) -> list[float] | None:
    if hasattr(stage, "featureImportances"):
        return [float(x) for x in stage.featureImportances.toArray()]
    if hasattr(stage, "coefficientMatrix"):
        rows = abs(stage.coefficientMatrix.toArray())
        return [float(x) for x in rows.mean(axis=0)]
    if hasattr(stage, "coefficients"):
        return [abs(float(x)) for x in stage.coefficients.toArray()]
    return None


def rank_features(model: TrainedModel) -> DataFrame:
    """``rank, feature, importance``: tree importances, or absolute coefficients averaged over classes."""
    found = [v for v in map(_importances, model.pipeline.stages) if v is not None]
    if not found:
        raise ValueError(f"A {model.spec.model_type} weighs no feature by itself")
    values = [sum(v) / len(found) for v in zip(*found)]
    order = sorted(zip(model.spec.features, values), key=lambda x: x[1], reverse=True)
    spark = SparkSession.getActiveSession()
    return local_table(spark, [(i + 1, name, rounded(v)) for i, (name, v) in enumerate(order)], "rank int, feature string, importance double"
    )


def feature_importance(model: TrainedModel, top_n: int = 20) -> DataFrame:
    return rank_features(model).where(F.col("rank") <= top_n)


def coefficients(model: TrainedModel) -> DataFrame:
    """``class, term, value`` of a linear model, the intercept among the terms."""
    rows = []
    linear = [s for s in model.pipeline.stages if hasattr(s, "coefficients") or hasattr(s, "coefficientMatrix")]
    for k, s in enumerate(linear):
        if hasattr(s, "coefficientMatrix") and len(model.classes) > 2:
            for label, values, b in zip(model.classes, s.coefficientMatrix.toArray(), s.interceptVector.toArray()):
                rows += [(label, f, float(v)) for f, v in zip(model.spec.features, values)]
                rows.append((label, "intercept", float(b)))
            continue
        label = model.classes[k if len(linear) > 1 else -1] if model.classes else ""
        rows += [(label, f, float(v)) for f, v in zip(model.spec.features, s.coefficients.toArray())]
        rows.append((label, "intercept", float(s.intercept)))
    return local_table(SparkSession.getActiveSession(), rows, "class string, term string, value double")


def save_predictions(model: TrainedModel, df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write test features with ``actual`` and ``predicted``, one part file per task."""
    scored = score(model, _test_rows(df) if SPLIT in df.columns else df)
    label = model.spec.target if model.spec.target in scored.columns else LABEL
    out = scored.select(
        *[col(c) for c in model.spec.features], col(label).alias("actual"), F.col(PREDICTION).alias("predicted")
    )
    writer = out.write.mode(mode)
    (writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def tree_nodes(model: TrainedModel) -> DataFrame:
    """The nodes of an exact tree: ``node, depth, feature, cut, left, right, gain, values``; leaves have no feature.

    ``values`` holds a leaf's class shares in the order of the classes, or its mean.
    """
    held = model.pipeline.stages[-1].model["nodes"]
    depths = {0: 0}
    for i, node in enumerate(held):
        if node["f"] >= 0:
            depths[node["l"]] = depths[node["r"]] = depths[i] + 1
    rows = [
        (i, depths[i], model.spec.features[n["f"]], n["t"], n["l"], n["r"], n["gain"], []) if n["f"] >= 0
        else (i, depths[i], None, None, None, None, None, n["v"])
        for i, n in enumerate(held)
    ]
    schema = "node long, depth long, feature string, cut double, left long, right long, gain double, values array<double>"
    return local_table(SparkSession.getActiveSession(), rows, schema)


def save_model(model: TrainedModel, path: str) -> None:
    """Write the pipeline and, beside it, what is needed to fit it again."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    info = json.dumps({"spec": model.spec.__dict__, "classes": model.classes})
    spark = SparkSession.getActiveSession()
    local_table(spark, [(info,)], "info string").write.mode("overwrite").json(f"{path}/info")


def load_model(path: str) -> TrainedModel:
    spark = SparkSession.getActiveSession()
    try:
        info = json.loads(spark.read.schema("info string").json(f"{path}/info").first()[0])
    except Exception as e:
        raise FileNotFoundError(f"No saved model can be read at {path}") from e
    return TrainedModel(ModelSpec(**info["spec"]), info["classes"], PipelineModel.load(f"{path}/pipeline"))


