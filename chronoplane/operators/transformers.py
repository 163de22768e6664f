"""Fitted category baselines as `pyspark.ml` stages: filled values and values relative to their category.

A stage is fitted on training rows only and is stored with the model that needs it.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.keys import as_tuple, day_number, require_columns
from chronoplane.operators.imputation import group_baselines
from chronoplane.operators.timeline import join_same
from chronoplane.session import stored

#: Marks the row of a baseline table that holds for all categories.
OVERALL = "all_rows"


class _Shared(Params):
    """category: column of the category. values: columns to fill and compare. method: `mean` or `median`, what fills."""

    category = Param(Params._dummy(), "category", "column of the category", TypeConverters.toString)
    values = Param(Params._dummy(), "values", "columns to fill and compare", TypeConverters.toListString)
    method = Param(Params._dummy(), "method", "mean or median", TypeConverters.toString)

    def names(self) -> tuple[str, list[str], str]:
        return self.getOrDefault(self.category), self.getOrDefault(self.values), self.getOrDefault(self.method)

    def outputs(self) -> list[str]:
        """The columns that the fitted stage adds."""
        return [f"{v}_{kind}" for v in self.getOrDefault(self.values) for kind in ("filled", "vs_group", "group_z")]


class CategoryBaselines(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the mean, deviation and median of each value per category, and over all rows for categories not seen."""

    @keyword_only
    def __init__(self, category=None, values=None, method="mean"):
        super().__init__()
        self._setDefault(method="mean")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "CategoryBaselinesModel":
        return self.model(stored(baseline_table(dataset, (), *self.names()[:2]), "baselines"))

    def model(self, table: DataFrame) -> "CategoryBaselinesModel":
        """A fitted stage with a baseline table that was computed elsewhere."""
        return self._copyValues(CategoryBaselinesModel(table))


class CategoryBaselinesModel(Model, _Shared, MLReadable, MLWritable):
    """Adds `<value>_filled`, `<value>_vs_group` and `<value>_group_z`; the values themselves stay as they are.

    A missing value is filled from its category, else from all rows, else with 0. The difference to the category's mean
    and its z-score are 0 where the category has none, and the z-score where all its values are equal.
    """

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        category, values, method = self.names()
        require_columns(dataset, [category, *values])
        kinds = dict.fromkeys([method, "mean", "std"])
        parts = F.struct(*[F.col(f"{v}_{k}").alias(f"{v}_{k}") for v in values for k in kinds])
        side = self.table.where(~F.col(OVERALL)).select(category, parts.alias("__own"))
        # One row; a table without training rows has none, and max() then gives null.
        overall = self.table.where(OVERALL).agg(F.max(F.struct(*[F.col(f"{v}_{method}") for v in values])).alias("o")).scalar()
        out = join_same(dataset, side, [category], "left").withColumn("__overall", overall)
        own, zero = F.col("__own"), F.lit(0.0)
        for v in values:
            x = F.coalesce(F.col(v).cast("double"), own[f"{v}_{method}"], F.col("__overall")[f"{v}_{method}"], zero)
            apart = x - own[f"{v}_mean"]
            out = out.withColumns({
                f"{v}_filled": x,
                f"{v}_vs_group": F.coalesce(apart, zero),
                f"{v}_group_z": F.coalesce(apart / F.nullif(own[f"{v}_std"], zero), zero),
            })
        return out.drop("__own", "__overall")

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def copy(self, extra=None) -> "CategoryBaselinesModel":
        out = super().copy(extra)
        out.table = self.table
        return out


class _TableWriter(MLWriter):
    def __init__(self, instance: CategoryBaselinesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CategoryBaselinesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(self.sparkSession.read.parquet(f"{path}/table"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


def baseline_table(train: DataFrame, by, category: str, values) -> DataFrame:
    """`by`, category, `<value>_mean`, `_std`, `_median`, `_count`: a row per category, and one for all rows, of each `by`.

    With a fold or a window in `by`, the baselines of all of them come from one pass.
    """
    by, values = list(as_tuple(by)), list(as_tuple(values))
    doubles = train.select(*by, category, *[F.col(v).cast("double").alias(v) for v in values])
    per = group_baselines(doubles, [*by, category], values).withColumn(OVERALL, F.lit(False))
    whole = doubles.withColumn("__one", F.lit(1))
    overall = group_baselines(whole, [*by, "__one"], values).drop("__one")
    overall = overall.withColumns({category: F.lit(None).cast(train.schema[category].dataType), OVERALL: F.lit(True)})
    return per.unionByName(overall.select(per.columns))


def rolling_baselines(dates: DataFrame, date: str, facts: DataFrame, time: str, category: str, values, days: int = 365 * 3) -> DataFrame:
    """The baseline tables (mean, deviation, count) of all dates at once, each over the facts in [d - days, d).

    Result rows: date, category, `all_rows`, `train_rows` and per value `_mean`, `_std`, `_count`; categories without facts
    in a window are absent. Facts are summed per category and day, so a fact is read once however many dates there are, and
    range frames run over days. Sums are taken around one overall mean per value.
    """
    values = list(as_tuple(values))
    center = facts.agg(F.struct(*[F.coalesce(F.avg(F.col(v).cast("double")), F.lit(0.0)).alias(v) for v in values]).alias("c")).scalar()
    x = {v: F.col(v).cast("double") - F.col("__c")[v] for v in values}
    sums = [F.count(F.lit(1)).alias("__rows")]
    for v in values:
        sums += [F.count(v).alias(f"__n_{v}"), F.sum(x[v]).alias(f"__s_{v}"), F.sum(x[v] * x[v]).alias(f"__q_{v}")]
    per_day = facts.withColumn("__c", center).groupBy(category, day_number(F.col(time)).alias("__day")).agg(*sums).where("__day IS NOT NULL")
    added = [c for c in per_day.columns if c.startswith("__") and c != "__day"]
    # At most a row per category and day, or per day.
    whole = per_day.groupBy("__day").agg(*[F.sum(c).alias(c) for c in added])
    kind = facts.schema[category].dataType
    both = per_day.withColumn(OVERALL, F.lit(False)).unionByName(whole.withColumns({category: F.lit(None).cast(kind), OVERALL: F.lit(True)}))
    wanted = dates.select(date).distinct().withColumn("__end", day_number(F.col(date)))
    groups = both.select(category, OVERALL).distinct()
    # Dates are a short list; each meets each category once.
    asked = groups.withColumn("__asked", F.explode(wanted.agg(F.collect_list(F.struct(date, "__end"))).scalar())).select(category, OVERALL, F.col(f"__asked.{date}").alias(date), F.col("__asked.__end").alias("__day"))
    w = Window.partitionBy(category, OVERALL).orderBy("__day").rangeBetween(-days, -1)
    summed = both.unionByName(asked, allowMissingColumns=True).withColumns({f"w{c}": F.sum(c).over(w) for c in added})
    found = summed.where(F.col(date).isNotNull() & F.col("w__rows").isNotNull()).withColumn("__c", center)
    cols = [F.col("w__rows").alias("train_rows")]
    for v in values:
        n, s, q = (F.col(f"w__{k}_{v}") for k in "nsq")
        spread = F.greatest(q - s * s / F.nullif(n, F.lit(0)), F.lit(0.0))
        cols += [
            F.when(n > 0, s / n + F.col("__c")[v]).alias(f"{v}_mean"),
            F.when(n > 1, F.sqrt(spread / (n - 1))).alias(f"{v}_std"),
            n.alias(f"{v}_count"),
        ]
    return found.select(date, category, OVERALL, *cols)
