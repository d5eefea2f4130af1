"""Experiment log: a table partitioned by experiment, settings and results as maps."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismill.operators.ordering import exact_quantiles, running

SCHEMA = (
    "run_id string, experiment string, recorded_at timestamp, lab string, note string, "
    "params map<string,string>, metrics map<string,double>"
)


def setting_text(value: Any) -> str:
    """A setting as readable text: 6 significant digits, joined lists, words for booleans."""
    if isinstance(value, bool):
        return "はい" if value else "いいえ"
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "、".join(setting_text(v) for v in value)
    return str(value)


def metric_value(value: Any) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return float("nan")


class RunLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _write(self, df: DataFrame, mode: str) -> None:
        writer = df.write.mode(mode).partitionBy("experiment")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.folder)

    def log(
        self, experiment: str, lab: str, params: dict[str, Any] | None = None,
        metrics: dict[str, Any] | None = None, note: str = "",
    ) -> str:
        """Append one run and return its id."""
        if not experiment.strip():
            raise ValueError("an experiment needs a name")
        run_id = uuid.uuid4().hex[:12]
        now = datetime.now(timezone.utc).replace(microsecond=0)
        row = (
            run_id, experiment.strip(), now, lab, note.strip(),
            {k: setting_text(v) for k, v in (params or {}).items()},
            {k: metric_value(v) for k, v in (metrics or {}).items()},
        )
        self._write(self.spark.createDataFrame([row], SCHEMA), "append")
        return run_id

    def append(self, runs: DataFrame) -> None:
        """Append many runs at once, for sweeps whose results are a table; one file set per experiment."""
        columns = [f.split()[0] for f in SCHEMA.split(", ")]
        self._write(runs.select(*columns).repartition("experiment", F.col("run_id").substr(-2, 2)), "append")

    def load_runs(self) -> DataFrame:
        """All runs, newest first."""
        files, path = self._files()
        if not files.exists(path(self.folder)):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder).orderBy(F.desc("recorded_at"), "run_id")

    def runs_of(self, experiment: str) -> DataFrame:
        return self.load_runs().where(F.col("experiment") == experiment)

    def delete_experiment(self, experiment: str) -> int:
        removed = self.runs_of(experiment).count()
        if removed:
            self._drop_partition(experiment)
        return removed

    def _drop_partition(self, experiment: str) -> None:
        files, path = self._files()
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        files.delete(path(f"{self.folder}/experiment={escape(experiment)}"), True)

    def delete_run(self, run_id: str) -> bool:
        """Rewrite the one partition that holds the run."""
        found = self.load_runs().where(F.col("run_id") == run_id).select("experiment").take(1)
        if not found:
            return False
        kept = self.runs_of(found[0][0]).where(F.col("run_id") != run_id)
        if kept.isEmpty():
            self._drop_partition(found[0][0])
        else:
            self._write(kept, "overwrite")
        return True

    def clear_all(self) -> None:
        files, path = self._files()
        files.delete(path(self.folder), True)


def experiments(runs: DataFrame) -> DataFrame:
    return runs.select("experiment").where("experiment IS NOT NULL").distinct().orderBy("experiment")


def wide_runs(runs: DataFrame) -> DataFrame:
    """One column per setting and per result that any run has."""
    columns = ["run_id", "experiment", "recorded_at", "lab", "note"]
    for source, prefix in (("params", "設定:"), ("metrics", "結果:")):
        found = runs.select(F.explode(F.map_keys(source)).alias("k")).distinct().orderBy("k").collect()
        columns += [F.try_element_at(source, F.lit(r["k"])).alias(f"{prefix}{r['k']}") for r in found]
    return runs.select(*columns)


def metric_column(runs: DataFrame, metric: str) -> DataFrame:
    value = F.nanvl(F.try_element_at("metrics", F.lit(metric)), F.lit(None))
    return runs.withColumn("value", value)


def best_run(runs: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """The run with the best value, the first recorded one on a tie; no row when no run has the metric."""
    known = metric_column(runs, metric).where("value IS NOT NULL")
    order = F.desc("value") if higher_is_better else F.asc("value")
    return known.orderBy(order, "recorded_at", "run_id").limit(1)


def which_settings_matter(runs: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Settings with at least two values, by how far the mean result moves between their values.

    The best value is the one with the highest mean unless told otherwise.
    """
    rows = metric_column(runs, metric).select(F.explode("params").alias("setting", "setting_value"), "value")
    rows = rows.where("setting_value IS NOT NULL")
    means = rows.groupBy("setting", "setting_value").agg(F.avg("value").alias("m"))
    sign = 1 if higher_is_better else -1
    best = F.min(F.when(F.col("m").isNotNull(), F.struct((-sign * F.col("m")).alias("r"), F.col("setting_value").alias("v"))))
    return (
        means.groupBy("setting")
        .agg(F.count("*").alias("tried"), F.count("m").alias("_known"), (F.max("m") - F.min("m")).alias("spread"), best.alias("_b"))
        .where("_known >= 2")
        .select("setting", "tried", "spread", F.col("_b.v").alias("best_value"))
        .orderBy(F.desc("spread"), "setting")
    )


def metric_summary(runs: DataFrame) -> DataFrame:
    """Count, maximum, minimum, mean and sample deviation (0 for one run) of every result."""
    rows = runs.select(F.explode("metrics").alias("metric", "value"))
    rows = rows.withColumn("value", F.nanvl("value", F.lit(None))).where("value IS NOT NULL")
    return rows.groupBy("metric").agg(
        F.count("*").alias("runs"), F.max("value").alias("best"), F.min("value").alias("worst"),
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("spread"),
    )


def setting_effect(runs: DataFrame, setting: str, metric: str) -> DataFrame:
    """Box statistics of a result per value of a setting."""
    rows = metric_column(runs, metric).withColumn("setting_value", F.try_element_at("params", F.lit(setting)))
    rows = rows.where("setting_value IS NOT NULL AND value IS NOT NULL").select("setting_value", "value")
    ends = rows.groupBy("setting_value").agg(F.count("*").alias("runs"), F.min("value").alias("min"), F.max("value").alias("max"))
    boxes = exact_quantiles(rows, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["setting_value"])
    return ends.join(boxes, "setting_value")


def history(runs: DataFrame, metric: str) -> DataFrame:
    """Result in record order with the best so far; always the highest, null where the run has no result."""
    rows = metric_column(runs, metric)
    best = running(rows, ["experiment"], ["recorded_at", "run_id"], {"best_so_far": F.col("value")}, how="max")
    return best.withColumn("best_so_far", F.when(F.col("value").isNotNull(), F.col("best_so_far")))


def overview(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("runs"), F.count_distinct("experiment").alias("experiments"), F.count_distinct("lab").alias("labs")
    )
