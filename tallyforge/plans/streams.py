"""Queries of the streaming jobs: the events table is drained as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as J, seen
from . import adapters as A
from .registry import query, rounded, table
from .sources import new_dir


def events(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/event[s].parquet")  # a pattern takes a file and a folder alike
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_funnel", "SELECT event_type AS step, count(*) AS n FROM events GROUP BY event_type")
def stream_funnel(spark, sf):
    folder = new_dir(spark, "funnel")
    J.run_batches(J.stream_funnel(events(spark, sf).withColumnRenamed("event_type", "step")), folder, "update")
    return J.latest(spark, folder, "step string, n long", ["step"])


@query("stream_hourly_activity", """SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n, round(max(value), 6) AS peak,
    count(*) FILTER (value >= 95) AS n_high FROM events GROUP BY ALL""")
def stream_hourly_activity(spark, sf):
    folder = new_dir(spark, "hourly")
    J.run_batches(J.stream_hourly_activity(events(spark, sf)), folder, "update")
    out = J.latest(spark, folder, "hour timestamp, n long, peak double, n_high long", ["hour"])
    return rounded(out.withColumn("hour", F.unix_seconds("hour")), "peak")


@query("stream_exact_dedup", "SELECT DISTINCT sha256(event_type || '|' || user_id || '|' || props) AS sha256 FROM events")
def stream_exact_dedup(spark, sf):
    folder = new_dir(spark, "dedup")
    rows = events(spark, sf).withColumn("sha256", F.sha2(F.concat_ws("|", "event_type", "user_id", "props"), 256))
    J.run_batches(J.stream_exact_dedup(rows, "sha256").select("sha256"), folder, "append")
    return J.appended(spark, folder, "sha256 string")


@query("stream_first_rows", """SELECT DISTINCT sha256(event_type || '|' || user_id || '|' || props) AS sha256 FROM events""")
def stream_first_rows(spark, sf):
    folder = new_dir(spark, "first")
    rows = events(spark, sf).select(F.sha2(F.concat_ws("|", "event_type", "user_id", "props"), 256).alias("sha256"))
    seen.stream_first_rows(rows, "sha256", folder, seen.SeenTable(folder, buckets=16))
    return J.appended(spark, folder, "sha256 string")


@query("stream_update_vocab", """WITH t AS (SELECT DISTINCT event_type || ':' || (props->>'$.k') AS token FROM events)
  SELECT '<UNK>' AS token, 0 AS id UNION ALL SELECT token, row_number() OVER (ORDER BY token) FROM t""")
def stream_update_vocab(spark, sf):
    folder = new_dir(spark, "vocab")
    tokens = events(spark, sf).select(F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("token"))
    J.stream_update_vocab(tokens, folder)
    return J.vocab_version(spark, folder)


@query("stream_ordered_chain", f"""WITH {A.EVENT_EDGES_SQL}, bounds AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
  SELECT sample::VARCHAR AS sample, unit, src, dst, technique_id, confidence FROM edges, bounds
  WHERE strptime(split_part(unit, '|', 2), '%Y-%m-%d') + INTERVAL 7 DAY < mark""")
def stream_ordered_chain(spark, sf):
    folder = new_dir(spark, "chain")
    week = F.date_trunc("week", "ts")
    rows = events(spark, sf).select(
        F.col("user_id").alias("sample"), F.concat_ws("|", "user_id", F.date_format(week, "yyyy-MM-dd")).alias("unit"),
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("node_id"), F.col("event_type").alias("api"), "ts",
        (week + F.expr("interval 7 days")).alias("unit_end"))
    J.stream_ordered_chain(rows, A.EVENT_RULES, folder, A.WINDOW)
    strip = lambda c: F.col(c).cast("long").cast("string").alias(c)
    return J.appended(spark, folder, J.CHAIN_OUT).select("sample", "unit", strip("src"), strip("dst"), "technique_id", "confidence")
