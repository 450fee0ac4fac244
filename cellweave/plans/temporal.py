"""Queries with joins and windows in time, and the streaming twins of the windows."""

from pyspark.sql import functions as F

from cellweave.operators import temporal
from cellweave.plans import views
from cellweave.plans.catalog import register, rounded, table
from cellweave.sources.shared import shared_path
from cellweave.streaming import windows

_REGISTRY = "SELECT s AS start_ts, lead(s) OVER (ORDER BY s) AS end_ts, row_number() OVER (ORDER BY s)::INT AS map FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS s FROM orders)"


def _registry(spark, sf_dir):
    return temporal.registry(table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("s")), "s")


@register(_REGISTRY)
def map_registry(spark, sf_dir):
    return _registry(spark, sf_dir)


@register(f"WITH r AS ({_REGISTRY}) SELECT l_orderkey, l_linenumber, map FROM lineitem JOIN r ON l_shipdate >= start_ts AND (end_ts IS NULL OR l_shipdate < end_ts)")
def instant_sampling(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return temporal.instant_join(points, _registry(spark, sf_dir), "l_shipdate", "month").select("l_orderkey", "l_linenumber", "map")


@register(
    views.sql("""
    WITH m AS (SELECT DISTINCT x, y, t AS mark FROM series WHERE t % 3 = 0)
    SELECT m.x, m.y, mark, round(avg(v), 6) AS v_average, round(median(v), 6) AS v_median, min(v) AS v_minimum, max(v) AS v_maximum, round(stddev_pop(v), 6) AS v_stddev,
           round(sum(v), 6) AS v_sum, round(quantile_cont(v, 0.25), 6) AS v_quart1, round(quantile_cont(v, 0.9), 6) AS v_perc90
    FROM m JOIN series s ON m.x = s.x AND m.y = s.y AND t >= mark - 4 AND t < mark GROUP BY ALL
    """)
)
def window_sampling(spark, sf_dir):
    s = views.series(table(spark, sf_dir, "lineitem"))
    marks = s.where("t % 3 = 0").select("x", "y", F.col("t").alias("mark")).distinct()
    methods = ("average", "median", "minimum", "maximum", "stddev", "sum", "quart1", "perc90")
    return rounded(temporal.window_aggregate(s, marks, ["x", "y"], "t", "mark", "v", 4, methods))


@register("SELECT event_type, date_trunc('hour', ts) AS start_ts, round(avg(value), 3) AS mean, count(value) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return rounded(temporal.tumbling(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "1 hour"), 3)


@register(
    """
    WITH w AS (SELECT user_id, date_trunc('day', ts) AS start_ts, round(avg(value), 3) AS mean, count(value) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT user_id, unnest(generate_series(min(start_ts), max(start_ts), INTERVAL 1 DAY)) AS start_ts FROM w GROUP BY 1)
    SELECT s.user_id, s.start_ts, mean, n FROM s LEFT JOIN w USING (user_id, start_ts)
    """
)
def dense_windows(spark, sf_dir):
    w = temporal.tumbling(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", "1 day")
    return rounded(temporal.dense(w, ["user_id"], "start_ts", "day").select("user_id", "start_ts", "mean", "n"), 3)


@register(
    "SELECT user_id, max(value) AS baseline FROM (SELECT user_id, value, ntile(10) OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1 GROUP BY 1"
)
def baseline_quantile(spark, sf_dir):
    return temporal.baseline_quantile(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 10)


@register(f"WITH r AS ({_REGISTRY}) SELECT a.start_ts, a.end_ts, a.map, b.map AS map_b FROM r a JOIN r b ON a.start_ts = b.start_ts AND a.end_ts IS NOT DISTINCT FROM b.end_ts")
def equal_intervals(spark, sf_dir):
    r = _registry(spark, sf_dir)
    return temporal.equal_join(r, r)


def _streamed(spark, sf_dir, transform, name):
    """Runs a streaming query over ``events`` to its end, in the shared folder: each batch writes the whole result so far, and the last one's counts."""
    records = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(records.schema).parquet(f"{sf_dir}/events*").withColumn("ts", F.col("ts").cast("timestamp"))
    found, folder = transform(stream), shared_path(spark, name)
    written = []

    def write(batch, number):
        path = f"{folder}/rows/{number}"
        batch.write.mode("overwrite").parquet(path)
        written.append(path)

    query = found.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    out = spark.read.schema(found.schema).parquet(written[-1]) if written else spark.createDataFrame([], found.schema)
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in out.columns if c.endswith("_ts")}), 3)


@register("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start_ts, round(avg(value), 3) AS mean, count(value) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: windows.tumbling(s, ["event_type"], "ts", "value", "6 hours"), "stream_tumbling")


@register(
    """
    SELECT event_type, b + INTERVAL (6 * k) HOUR AS start_ts, round(avg(value), 3) AS mean, count(value) AS n
    FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), (VALUES (0), (-1)) t(k) GROUP BY 1, 2
    """
)
def stream_sliding(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: windows.sliding(s, ["event_type"], "ts", "value", "12 hours", "6 hours"), "stream_sliding")


@register(
    """
    WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
    SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 8 HOUR AS end_ts, count(*) AS n FROM s GROUP BY user_id, s
    """
)
def stream_sessions(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: windows.sessions(s, ["user_id"], "ts", "8 hours"), "stream_sessions")
