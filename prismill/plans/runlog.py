"""Run-log queries: customers as runs, their market segment and region code as settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.operators import runs as R
from prismill.plans.registry import query, table


def log(spark, folder):
    order = table(spark, folder, "orders")
    metrics = F.create_map(
        F.lit("price"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))),
        F.lit("customer"), F.col("o_custkey").cast("double"),
    )
    return order.select(
        F.format_string("run%09d", "o_orderkey").alias("run_id"), F.concat(F.lit("trial-"), "o_orderstatus").alias("experiment"),
        F.col("o_orderdate").cast("timestamp").alias("recorded_at"), (F.col("o_custkey") % 3).cast("string").alias("lab"), F.lit("").alias("note"),
        F.create_map(F.lit("priority"), "o_orderpriority", F.lit("month"), F.month("o_orderdate").cast("string")).alias("params"),
        metrics.alias("metrics"),
    )


LOG = """lg AS (SELECT printf('run%09d', o_orderkey) AS run_id, 'trial-' || o_orderstatus AS experiment, o_orderdate AS recorded_at,
    CAST(o_custkey % 3 AS VARCHAR) AS lab, o_orderpriority AS priority, CAST(month(o_orderdate) AS VARCHAR) AS month,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price, CAST(o_custkey AS DOUBLE) AS customer FROM orders)"""


@query("runs_newest_first", "L02", f"WITH {LOG} SELECT run_id, experiment FROM lg ORDER BY recorded_at DESC, run_id LIMIT 50")
def runs_newest_first(spark, folder):
    return log(spark, folder).orderBy(F.desc("recorded_at"), "run_id").limit(50).select("run_id", "experiment")


@query("runs_of_experiment", "L03 P09", f"WITH {LOG} SELECT run_id, priority AS \"設定:priority\", month AS \"設定:month\", price AS \"結果:price\" FROM lg WHERE experiment = 'trial-F'")
def runs_of_experiment(spark, folder):
    wide = R.wide_runs(log(spark, folder).where(F.col("experiment") == "trial-F"))
    return wide.select("run_id", "設定:priority", "設定:month", F.nanvl("結果:price", F.lit(None)).alias("結果:price"))


@query("best_run", "L04 A09", f"WITH {LOG} SELECT run_id, price AS value FROM lg WHERE price IS NOT NULL ORDER BY price DESC, recorded_at, run_id LIMIT 1")
def best_run(spark, folder):
    return R.best_run(log(spark, folder), "price").select("run_id", "value")


@query("worst_run", "L04 A09", f"WITH {LOG} SELECT run_id, price AS value FROM lg WHERE price IS NOT NULL ORDER BY price, recorded_at, run_id LIMIT 1")
def worst_run(spark, folder):
    return R.best_run(log(spark, folder), "price", higher_is_better=False).select("run_id", "value")


@query(
    "settings_that_matter",
    "L05 A08",
    f"""WITH {LOG}, l AS (SELECT unnest(['priority', 'month']) AS setting, unnest([priority, month]) AS v, price FROM lg),
    m AS (SELECT setting, v, avg(price) AS m FROM l GROUP BY 1, 2)
    SELECT setting, count(*) AS tried, round(max(m) - min(m), 3) AS spread, arg_max(v, m) AS best_value FROM m GROUP BY 1""",
)
def settings_that_matter(spark, folder):
    return R.which_settings_matter(log(spark, folder), "price").withColumn("spread", F.round("spread", 3))


@query(
    "metric_summary",
    "L06",
    f"""WITH {LOG}, l AS (SELECT unnest(['price', 'customer']) AS metric, unnest([price, customer]) AS v FROM lg)
    SELECT metric, count(v) AS runs, max(v) AS best, min(v) AS worst, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS spread FROM l WHERE v IS NOT NULL GROUP BY 1""",
)
def metric_summary(spark, folder):
    out = R.metric_summary(log(spark, folder))
    return out.select("metric", "runs", "best", "worst", F.round("mean", 3).alias("mean"), F.round("spread", 3).alias("spread"))


@query(
    "setting_effect",
    "L07",
    f"""WITH {LOG} SELECT priority AS setting_value, count(price) AS runs, min(price) AS min, max(price) AS max, round(quantile_cont(price, 0.25), 4) AS q25,
    round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.75), 4) AS q75 FROM lg WHERE price IS NOT NULL GROUP BY 1""",
)
def setting_effect(spark, folder):
    out = R.setting_effect(log(spark, folder), "priority", "price")
    return out.select("setting_value", "runs", "min", "max", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")])


@query(
    "run_history",
    "L08 W10",
    f"""WITH {LOG} SELECT run_id, price AS value, CASE WHEN price IS NOT NULL THEN max(price) OVER (PARTITION BY experiment ORDER BY recorded_at, run_id
    ROWS UNBOUNDED PRECEDING) END AS best_so_far FROM lg""",
)
def run_history(spark, folder):
    return R.history(log(spark, folder), "price").select("run_id", "value", "best_so_far")


@query("log_overview", "L10 A07", f"WITH {LOG} SELECT count(*) AS runs, count(DISTINCT experiment) AS experiments, count(DISTINCT lab) AS labs FROM lg")
def log_overview(spark, folder):
    return R.overview(log(spark, folder))


@query(
    "logged_runs",
    "L01 L02 L09 U01 U03",
    f"WITH {LOG} SELECT experiment, count(*) AS runs, count(price) AS with_price FROM lg WHERE experiment <> 'trial-P' GROUP BY 1",
)
def logged_runs(spark, folder):
    """Append all runs to a log, drop one experiment, read the rest back."""
    from prismill.plans.profiling import scratch_folder

    runs = R.RunLog(spark, scratch_folder(spark, "runs"))
    runs.append(log(spark, folder))
    runs.delete_experiment("trial-P")
    price = F.nanvl(F.try_element_at("metrics", F.lit("price")), F.lit(None))
    return runs.load_runs().groupBy("experiment").agg(F.count("*").alias("runs"), F.count(price).alias("with_price"))
