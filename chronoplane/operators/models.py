"""Boosted-tree models on `pyspark.ml`: mean, variance, fold ensembles, walk-forward scoring.

Fitting is distributed by Spark; the only loops on the driver are over folds and refit dates.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.functions.odds import DEFAULT_ODDS, MAX_CV
from chronoplane.keys import as_tuple, day_number, in_days, require_columns
from chronoplane.operators.decisions import bet_decision_point, bet_decision_prob, bet_outcome
from chronoplane.operators.joins import training_window
from chronoplane.operators.probability import MIN_VARIANCE, conformal, gamma_fit, gamma_moments, prob_over
from chronoplane.operators.quantiles import exact_quantiles
from chronoplane.operators.splits import contiguous_folds
from chronoplane.operators.transformers import CategoryBaselines, CategoryBaselinesModel, baseline_table, rolling_baselines
from chronoplane.session import stored, work_path

FEATURES, HELD_OUT = "__features", "__val"


def _assembler(features) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")


def fit_gbt(train: DataFrame, features, target: str, validation: str | None = None, prediction: str = "prediction",
            trees: int = 20, depth: int = 4, step: float = 0.1, loss: str = "squared", seed: int = 42) -> PipelineModel:
    """Boosted trees; with a boolean `validation` column training stops when those rows stop improving."""
    gbt = GBTRegressor(
        featuresCol=FEATURES, labelCol=target, predictionCol=prediction, maxIter=trees, maxDepth=depth,
        stepSize=step, lossType=loss, seed=seed,
    )
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    require_columns(train, [*as_tuple(features), target])
    return Pipeline(stages=[_assembler(features), gbt]).fit(train)


def model_features(model: PipelineModel) -> list[str]:
    """The features that the trees read, in order."""
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def prepared_by(model: PipelineModel) -> CategoryBaselinesModel | None:
    """The fitted baselines in front of the trees, if the model has any."""
    first = model.stages[0]
    return first if isinstance(first, CategoryBaselinesModel) else None


def score_model(model: PipelineModel, df: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Predictions with the model's own feature list; an absent feature is an error, a missing value is `fill`.

    A model with fitted baselines computes its relative columns itself, and the result doesn't hold them.
    """
    own = prepared_by(model)
    made = own.outputs() if own else []
    names = [c for c in model_features(model) if c not in made]
    require_columns(df, names)
    if fill is not None:
        # The baselines must see what is missing, so only other features are filled here.
        kept = set(own.names()[1]) if own else set()
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in names if c not in kept})
    return model.transform(df).drop(FEATURES, *made)


def save_models(models: list[PipelineModel], path: str) -> None:
    """Stores models with their feature lists and baselines; a path that holds models already is an error."""
    for i, model in enumerate(models):
        model.save(f"{path}/model={i}")


def load_models(spark: SparkSession, path: str, features=None) -> list[PipelineModel]:
    """The stored models in order. With `features`, a model that reads others, or in another order, is an error."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    numbers = sorted(int(f.getPath().getName().removeprefix("model=")) for f in found if f.getPath().getName().startswith("model="))
    models = [PipelineModel.load(f"{path}/model={i}") for i in numbers]
    for i, model in enumerate(models):
        if features is not None and list(features) != list(model_features(model)):
            raise ValueError(f"stored model {i} reads {model_features(model)}, not {list(features)}")
    return models


def fit_variance(scored: DataFrame, features, actual: str, mean: str, **params) -> PipelineModel:
    """Second model on the squared residuals of the first; `score_variance` applies the floor."""
    residual = F.col(actual) - F.col(mean)
    return fit_gbt(scored.withColumn("__sq", residual * residual), features, "__sq", prediction="variance", **params)


def score_variance(model: PipelineModel, df: DataFrame, floor: float = MIN_VARIANCE) -> DataFrame:
    return score_model(model, df).withColumn("variance", F.greatest(F.col("variance"), F.lit(floor)))


def feature_importance(model: PipelineModel) -> list[tuple[str, float]]:
    """Importance per feature name, largest first."""
    trees: GBTRegressionModel = model.stages[-1]
    return sorted(zip(model_features(model), trees.featureImportances.toArray().tolist()), key=lambda p: -p[1])


@dataclass
class Folds:
    """An ensemble with what it was fitted from. validation: the folds' validation rows as their own model scored them."""

    models: list[PipelineModel]
    baselines: DataFrame | None
    validation: DataFrame
    prepare: CategoryBaselines | None = field(default=None, repr=False)


def fold_baselines(parts: DataFrame, prepare: CategoryBaselines) -> DataFrame:
    """Baseline tables of all folds in one pass, from the rows that train; parts: a `fold` and HELD_OUT."""
    category, values, _ = prepare.names()
    return baseline_table(parts.filter(~F.col(HELD_OUT)), "fold", category, values)


def fit_folds(train: DataFrame, features, target: str, time: str, event, folds: int = 3, prepare: CategoryBaselines | None = None, **params) -> Folds:
    """One model per consecutive time block, each stopped early on the end of its block.

    prepare: baselines fitted in each fold, on its training rows only; the fold's validation rows are filled and compared
    with them too. `features` may name the columns that it adds.
    """
    parts = contiguous_folds(train, time, event, folds).withColumn(HELD_OUT, F.col("split") == "val")
    made = prepare.outputs() if prepare else []
    plain = [c for c in as_tuple(features) if c not in made]
    given = dict.fromkeys([*plain, *([prepare.names()[0], *prepare.names()[1]] if prepare else []), target])
    path = work_path(train.sparkSession, "folds")
    # Written once, so that the numbering is not repeated per fold and survives lost executors.
    parts.select(*given, HELD_OUT, "fold").write.partitionBy("fold").parquet(path)
    rows = train.sparkSession.read.schema(parts.select(*given, HELD_OUT, "fold").schema).parquet(path)
    base = stored(fold_baselines(rows, prepare), "fold-baselines") if prepare else None
    models, validated = [], []
    for i in range(folds):
        mine = rows.filter(F.col("fold") == i)
        own = [prepare.model(base.filter(F.col("fold") == i).drop("fold"))] if prepare else []
        ready = own[0].transform(mine) if own else mine
        trees = fit_gbt(ready, features, target, HELD_OUT, **params)
        models.append(PipelineModel([*own, *trees.stages]))
        validated.append(trees.transform(ready.filter(F.col(HELD_OUT))).drop(FEATURES))
    return Folds(models, base, reduce(DataFrame.unionByName, validated), prepare)


def fit_ensemble(train: DataFrame, features, target: str, time: str, event, folds: int = 3, prepare: CategoryBaselines | None = None, **params) -> list[PipelineModel]:
    """The models of `fit_folds`."""
    return fit_folds(train, features, target, time, event, folds, prepare, **params).models


def fit_fold_variance(fitted: Folds, features, target: str, **params) -> PipelineModel:
    """The variance model of an ensemble: squared errors of the folds' models on rows that they didn't train on.

    It reads features as its fold prepared them, so the model itself has no baselines: score it on prepared rows.
    """
    return fit_variance(fitted.validation, features, target, "prediction", **params)


def score_ensemble(models: list[PipelineModel], df: DataFrame, name: str = "prediction", prepare: CategoryBaselinesModel | None = None) -> DataFrame:
    """Average of the models' predictions, in one pass over the rows.

    prepare: baselines to use instead of each model's own, as a period's are those of its whole window. They are applied
    once and the columns they add stay.
    """
    out = prepare.transform(df) if prepare else df
    cols = []
    for i, model in enumerate(models):
        col = f"__m{i}"
        own = [s for s in model.stages[:-1] if not (prepare and isinstance(s, CategoryBaselinesModel))]
        out = score_model(PipelineModel([*own, model.stages[-1].copy().setPredictionCol(col)]), out)
        cols.append(F.col(col))
    return out.withColumn(name, reduce(lambda a, b: a + b, cols) / len(cols)).drop(*[f"__m{i}" for i in range(len(models))])


def refit_windows(df: DataFrame, time: str, refit_dates, years: int, prepare: CategoryBaselines) -> DataFrame:
    """The baseline tables and sizes of the windows before all refit dates, from one pass over the table."""
    category, values, _ = prepare.names()
    dates = df.sparkSession.createDataFrame([(str(d),) for d in refit_dates], "refit string").select(F.col("refit").cast("date").alias("refit"))
    return rolling_baselines(dates, "refit", df, time, category, values, 365 * years)


def walk_forward(df: DataFrame, features, target: str, time: str, event, refit_dates, until, years: int = 3,
                 folds: int = 2, keep=(), prepare: CategoryBaselines | None = None, variance: bool = False,
                 least_rows: int = 0, **params) -> DataFrame:
    """Predictions of every period by an ensemble fitted only on the window before it.

    `refit_dates` are the starts of the periods; their number, not the number of days, is the number of fits.
    prepare: baselines, fitted anew in each fold and, for the period's own rows, on the whole window; the windows' come
    from one pass over the table (`refit_windows`). variance: adds `variance`, by a model of the errors on the folds'
    validation rows. A window of fewer than `least_rows` rows predicts nothing.
    Every period's predictions are written to their own folder, so a failed period repeats alone.
    """
    if prepare and prepare.names()[2] != "mean":
        raise ValueError("windows have means, no medians: prepare with method mean")
    spark = df.sparkSession
    path = work_path(spark, "walk-forward")
    starts = [str(d) for d in refit_dates]
    windows = stored(refit_windows(df, time, starts, years, prepare), "windows") if prepare else None
    columns = [*as_tuple(keep), time, target, "prediction", *(["variance"] * variance)]
    out = None
    for start, end in zip(starts, [*starts[1:], str(until)]):
        train, rows = training_window(df, time, start, years), in_days(df, time, start, end)
        if least_rows and train.limit(least_rows).count() < least_rows:
            continue
        fitted = fit_folds(train, features, target, time, event, folds, prepare, **params)
        whole = prepare.model(windows.filter(F.col("refit") == F.lit(start).cast("date")).drop("refit")) if prepare else None
        scored = score_ensemble(fitted.models, rows, prepare=whole)
        if variance:
            scored = score_variance(fit_fold_variance(fitted, features, target, **params), scored)
        out = scored.select(*columns)
        out.write.mode("overwrite").parquet(f"{path}/refit={start}")
    if out is None:
        raise ValueError("no window has enough rows")
    return spark.read.parquet(path)


def first_days(df: DataFrame, time: str, share: float = 0.2) -> Column:
    """The day number at which the first `share` of the table's days ends, as a scalar."""
    days = df.select(day_number(F.col(time)).cast("double").alias("d")).distinct()
    return exact_quantiles(days, "d", {"cut": share}).select("cut").scalar()


def decide(pred: DataFrame, lines: DataFrame | None, key, time: str, actual: str, line: str = "line", odds: float = DEFAULT_ODDS,
           share: float = 0.2, alpha: float = 0.05, max_cv: float = MAX_CV, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Decisions and outcomes of walk-forward predictions (`prediction`, `variance`) against quoted lines.

    Gamma distributions are fitted to mean and variance; those of the first `share` of the days fit the calibrator, with
    which the later days are calibrated. lines: (key, line), joined to the predictions; None where these hold the line.
    Predictions without a line or a distribution are left out, as are the days of the calibrator.
    """
    fitted = gamma_fit(pred, "prediction", "variance")
    day = day_number(F.col(time))
    cut = first_days(pred, time, share)
    first, rest = fitted.filter(day < cut), fitted.filter(day >= cut)
    held = conformal(rest, first, actual, "prediction", alpha, hot_rows)
    held = held.withColumns({"alpha": F.col("alpha_cal"), "beta": F.col("beta_cal")}).drop("alpha_cal", "beta_cal")
    if lines is not None:
        held = held.join(lines.select(*as_tuple(key), line), list(as_tuple(key)))
    held = held.filter(F.col(line).isNotNull() & F.col("alpha").isNotNull())
    p = gamma_moments(prob_over(held, line))
    decided = bet_decision_prob(p, "prob_over", "gamma_std", "prediction", odds, max_cv=max_cv)
    return bet_outcome(bet_decision_point(decided, "prediction", line), actual, line)
