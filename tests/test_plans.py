"""Plans that would not survive a large table: pair products, unpushed filters, unpruned columns."""

import os
import re

import pytest

import __spark_entry__
from prismill.plans.registry import QUERIES, table

FOLDER = "/root/testdata/sf0.001"
LAZY = "relational profiling ingest timeseries evaluation preparation runlog text arrays".split()
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NAMES = [n for n, q in QUERIES.items() if q.__module__.rsplit(".", 1)[-1] in LAZY]


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_no_pair_product(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["anti_filter"](spark, FOLDER))
    assert "PushedFilters: [" in text and "event_type" in text.split("PushedFilters")[1][:80]
    text = plan(QUERIES["month_rollup"](spark, FOLDER))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text


@needs_data
def test_top_k_keeps_k_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["sort_nulls_last"](spark, FOLDER))
    assert "WindowGroupLimit" in plan(QUERIES["top_k_per_group"](spark, FOLDER))


@needs_data
def test_rows_do_not_meet_by_few_flags(spark):
    """A shuffle by a flag of three values would bring all rows to three tasks."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a large table
    try:
        text = plan(QUERIES["median_and_mad"](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert re.search(r"BroadcastHashJoin \[l_returnflag#\d+\]", text)


@needs_data
def test_entry(spark):
    assert table(spark, FOLDER, "region").count() == 5
    df = __spark_entry__.entry(spark)
    assert df.columns == ["day", "mean_price", "moving_average"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_hold_out_ranks_the_rows_once(spark, monkeypatch):
    """A fit passes over its rows a dozen times; the ranks behind the hold-out must not be worked out each time."""
    from pyspark.sql import functions as F

    from prismill.plans import learning

    seen, plain = spark.sparkContext.accumulator(0), learning.lines

    def counted(session, folder):
        @F.udf("double")
        def read(value):
            seen.add(1)
            return value

        return plain(session, folder).withColumn("l_quantity", read(F.col("l_quantity").cast("double")))

    monkeypatch.setattr(learning, "lines", counted)
    QUERIES["hold_out_ridge"](spark, FOLDER).collect()
    assert 0 < seen.value <= 3 * plain(spark, FOLDER).count()
