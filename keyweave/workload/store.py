"""The document store over events and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.lineage import new_folder
from keyweave.operators import store
from keyweave.workload.tables import table


def _versions(spark, folder):
    """Each event is a version of the document of its user."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), F.concat_ws(" ", "event_type", "props").alias("payload"), F.col("ts").alias("dt"), "event_id", "event_type"
    )


def store_upsert(spark, folder):
    late = F.col("event_type").isin("error", "purchase")
    versions = _versions(spark, folder)
    base = store.latest(versions.where(~late), "event_id")
    return store.upsert(base, versions.where(late), "event_id")


def store_upsert_parts(spark, folder):
    """As `store_upsert`, over a store of files of which only the touched parts are written again."""
    late = F.col("event_type").isin("error", "purchase")
    versions = _versions(spark, folder)
    files = store.PartitionedStore(new_folder(spark, "store"), parts=16)
    files.create(store.latest(versions.where(~late), "event_id"))
    files.upsert(versions.where(late), "event_id")
    return files.read(spark)


def store_list(spark, folder):
    events = table(spark, folder, "events")
    return store.list_keys(events.select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("payload"), F.col("ts").alias("dt")))


def store_load(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("url").alias("key"), F.col("html").alias("payload"))
    return store.load(pages, "https://m.ththth.example.net/en/25#top")


QUERIES = {
    "store_list": store_list,
    "store_load": store_load,
    "store_latest": lambda s, d: store.latest(_versions(s, d), "event_id"),
    "store_upsert": store_upsert,
    "store_upsert_parts": store_upsert_parts,
}

LATEST = "SELECT user_id::VARCHAR AS key, arg_max(concat_ws(' ', event_type, props), (ts, event_id)) AS payload, max(ts) AS dt FROM events GROUP BY 1"

SQL = {
    "store_list": "SELECT event_id::VARCHAR AS key, strftime(ts, '%d-%B-%Y %H:%M') AS saved_at FROM events",
    "store_load": "SELECT url AS key, html AS payload FROM pages WHERE url = 'https://m.ththth.example.net/en/25#top'",
    "store_latest": LATEST,
    "store_upsert": LATEST,
    "store_upsert_parts": LATEST,
}
