"""Repeated accumulation of landed feed files.

Feeds only carry their latest entries, so they are fetched again and again and merged by URL. Here
each run takes the files that have landed since the last one and folds them into the catalog
dataset; the file source's own log in ``state_folder`` remembers what was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismill.sources.catalog import Catalog
from prismill.sources.names import CatalogError
from prismill.sources.payloads import accumulate, feed_rows


def landed_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (source, payload, fetched_at), one row per landed file ``<folder>/<source>/<file>.xml``."""
    files = spark.readStream.schema("value string").option("wholetext", "true").text(f"{folder}/*/*.xml")
    path = F.col("_metadata.file_path")
    return files.select(
        F.url_decode(F.element_at(F.split(path, "/"), -2)).alias("source"), F.col("value").alias("payload"),
        F.col("_metadata.file_modification_time").cast("string").alias("fetched_at"),
    )


def merge_batch(catalog: Catalog, name: str, payloads: DataFrame) -> int:
    """Fold one batch of payloads into the dataset and return its new row count.

    Replaying a batch after a failure changes nothing: its URLs are already there.
    """
    fresh = feed_rows(payloads).rows
    try:
        saved = catalog.load(name)
    except CatalogError:
        saved = None
    if saved is None and fresh.isEmpty():
        return 0
    once = accumulate(None, fresh)
    if saved is None:
        return catalog.save(name, once, label="feeds", source="RSS", domain="text", params={"files": "landed"})["rows"]
    return catalog.append(name, once.join(saved.select("URL"), "URL", "left_anti").select(*saved.columns))["rows"]


def accumulate_landed(spark: SparkSession, catalog: Catalog, folder: str, name: str, state_folder: str) -> None:
    """Process all files landed so far, then stop."""
    run = (
        landed_feeds(spark, folder)
        .writeStream.option("checkpointLocation", state_folder)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: merge_batch(catalog, name, batch) and None)
        .start()
    )
    run.awaitTermination()
