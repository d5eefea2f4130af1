"""Imputation, scaling and encoding learned on the training part and applied to any part.

Fitted state is small (medians, moments, at most 30 levels per column) and becomes literals, so
applying it is one projection. Ordinal levels may be many and stay a table that is joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.operators.ordering import exact_quantiles, most_frequent, ranked
from prismill.operators.profile import long_values

# Most one-hot columns per feature, rows a level needs, name of the added level.
MAX_LEVELS = 30
MIN_ROWS = 2
MISSING_LEVEL = "（欠測）"


@dataclass(frozen=True)
class PreprocessConfig:
    numeric_impute: str = "median"  # median | mean | constant | drop_rows
    categorical_impute: str = "most_frequent"  # most_frequent | constant
    scale: bool = True
    encode: str = "onehot"  # onehot | ordinal


def numeric_fills(df: DataFrame, names: list[str], how: str) -> dict[str, float]:
    """Fill value per numeric column."""
    if how == "constant":
        return {n: 0.0 for n in names}
    if how == "drop_rows" or not names:
        return {}
    cells = long_values(df, names)
    if how == "median":
        rows = exact_quantiles(cells, "value", {"fill": 0.5}, ["column"])
    else:
        rows = cells.groupBy("column").agg(F.avg("value").alias("fill"))
    return {r["column"]: r["fill"] for r in rows.collect()}


def categorical_fills(df: DataFrame, names: list[str], how: str) -> dict[str, str]:
    if how == "constant":
        return {n: MISSING_LEVEL for n in names}
    if not names:
        return {}
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in names])))
    return {r["column"]: r["value"] for r in most_frequent(rows, "value", ["column"]).collect()}


def level_table(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("level")).agg(F.count("*").alias("n"))


def onehot_levels(df: DataFrame, name: str) -> tuple[list[str], bool]:
    """Levels with a column of their own, and whether the others share an infrequent column.

    Levels seen once are infrequent; the shared column counts toward the limit. Among equally
    frequent levels the later names stay.
    """
    table = level_table(df, name)
    rows = table.where(F.col("n") >= MIN_ROWS).orderBy(F.desc("n"), F.desc("level")).limit(MAX_LEVELS + 1).collect()
    rare = bool(table.where(F.col("n") < MIN_ROWS).take(1))
    kept = [r["level"] for r in rows]
    if len(kept) + rare > MAX_LEVELS:
        kept, rare = kept[: MAX_LEVELS - 1], True
    return sorted(kept), rare


def ordinal_levels(df: DataFrame, name: str) -> DataFrame:
    """Level and its code 0..n-1 in sorted order."""
    return ranked(level_table(df, name), [], ["level"], "code").select("level", (F.col("code") - 1).alias("code"))


def ordinal_encode(df: DataFrame, name: str, levels: DataFrame, out: str) -> DataFrame:
    """Replace values by their codes; unknown ones become -1."""
    renamed = levels.select(F.col("level").alias("_level"), F.col("code").alias(out))
    joined = df.join(renamed, df[name] == F.col("_level"), "left").drop("_level")
    return joined.withColumn(out, F.coalesce(out, F.lit(-1).cast("bigint")))


def onehot_columns(name: str, levels: list[str], rare: bool) -> dict[str, Column]:
    """0/1 column per level; anything else, unknown values included, falls in the infrequent column if there is one."""
    value = F.col(name).cast("string")
    columns = {f"{name}_{level}": (value == level).cast("double") for level in levels}
    if rare:
        columns[f"{name}_infrequent"] = (~value.isin(levels) if levels else F.lit(True)).cast("double")
    return columns


@dataclass
class PreprocessModel(Model):
    """Fitted preprocessing: a projection, plus a join per ordinal column."""

    numeric: list[str]
    categorical: list[str]
    config: PreprocessConfig
    fills: dict[str, float]
    names: dict[str, str]
    moments: dict[str, tuple[float, float]]
    onehot: dict[str, tuple[list[str], bool]]
    ordinal: dict[str, DataFrame] = field(default_factory=dict)
    output: str = "features"

    def __post_init__(self) -> None:
        Model.__init__(self)

    def _prepared(self, df: DataFrame) -> DataFrame:
        if self.config.numeric_impute == "drop_rows":
            df = df.dropna(subset=self.numeric)
        filled = {n: F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None)), F.lit(self.fills[n])) for n in self.fills}
        filled |= {n: F.coalesce(F.col(n).cast("string"), F.lit(self.names[n])) for n in self.names}
        return df.withColumns(filled) if filled else df

    def columns(self) -> list[str]:
        out = list(self.numeric)
        for n in self.categorical:
            out += list(onehot_columns(n, *self.onehot[n])) if n in self.onehot else [n]
        return out

    def wide(self, df: DataFrame) -> DataFrame:
        """One column per feature, other columns kept."""
        out = self._prepared(df)
        scaled = {n: (F.col(n) - mean) / sd for n, (mean, sd) in self.moments.items()}
        coded: dict[str, Column] = {}
        for n in self.onehot:
            coded |= onehot_columns(n, *self.onehot[n])
        out = out.withColumns(scaled | coded) if scaled or coded else out
        for n, levels in self.ordinal.items():
            out = ordinal_encode(out, n, levels, f"_{n}").drop(n).withColumnRenamed(f"_{n}", n)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        wide = self.wide(df)
        vector = array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns()]))
        extra = [c for c in wide.columns if c in df.columns and c not in self.numeric and c not in self.categorical]
        return wide.select(*[F.col(f"`{c}`") for c in extra], vector.alias(self.output))


@dataclass
class Preprocessor(Estimator):
    numeric: list[str]
    categorical: list[str]
    config: PreprocessConfig = PreprocessConfig()
    output: str = "features"

    def __post_init__(self) -> None:
        Estimator.__init__(self)

    def _fit(self, df: DataFrame) -> PreprocessModel:
        config = self.config
        fills = numeric_fills(df, self.numeric, config.numeric_impute)
        names = categorical_fills(df, self.categorical, config.categorical_impute)
        model = PreprocessModel(self.numeric, self.categorical, config, fills, names, {}, {}, {}, self.output)
        ready = model._prepared(df)
        if config.scale and self.numeric:
            cells = long_values(ready, self.numeric)
            rows = cells.groupBy("column").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
            model.moments = {r["column"]: (r["m"], r["s"] or 1.0) for r in rows}
        for n in self.categorical:
            if config.encode == "onehot":
                model.onehot[n] = onehot_levels(ready, n)
            else:
                model.ordinal[n] = ordinal_levels(ready, n)
        return model
