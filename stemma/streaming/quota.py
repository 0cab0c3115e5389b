"""Requests per client and day against a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stemma import model as M
from stemma.functions.text import strip
from stemma.plans.durable import written


def parse_log(lines: DataFrame) -> DataFrame:
    """'moment --- client --- request' lines as (ts, ip, request)."""
    return lines.selectExpr("split(value, ' --- ') as part").filter("size(part) >= 3").selectExpr(
        "try_to_timestamp(part[0]) as ts", "part[1] as ip", f"{strip('part[2]')} as request")


def daily_quota(log: DataFrame, limit: int = M.DAILY_LIMIT, client: str = "ip") -> DataFrame:
    """(client, day, n_requests, blocked): blocked above the limit.

    Clients compare by equality. Rows are flagged, none removed.
    """
    return (
        log.groupBy(F.col(client).cast("string").alias("client"),
                    F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n_requests"))
        .withColumn("blocked", F.col("n_requests") > limit)
    )


def request_verdicts(log: DataFrame, limit: int = M.DAILY_LIMIT, client: str = "ip", counted: str = "request like 'POST%'",
                     order: tuple[str, ...] = ("ts",), parts: int | None = None) -> DataFrame:
    """All columns of `log` with day, n_requests and blocked: the verdict on each request as it came.

    A request that `counted` tells (a POST) is logged before it is judged, so it counts itself and
    all such requests of its client and day before it; any other (a GET) only looks at those. Blocked
    is above the limit; no row is removed. `order` settles which came first. Clients compare by equality;
    requests without a moment have a null day and are judged among themselves.

    Rows are sorted into ranges of client, day and moment. Each range counts for itself, and the totals of the
    ranges before are added: a client with most of all requests is spread over many ranges.
    """
    keys = ["_client", "day"]
    rows = log.withColumns({"_client": F.col(client).cast("string"), "day": F.to_date("ts"),
                            "_counts": F.coalesce(F.expr(counted), F.lit(False)).cast("long")})
    dealt = rows.repartitionByRange(parts, *keys, *order) if parts else rows.repartitionByRange(*keys, *order)
    placed = written(dealt.sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
                     .withColumn("_nth", F.monotonically_increasing_id()), "requests")
    inside = Window.partitionBy("_part", *keys).orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    told = placed.withColumn("_own", F.sum("_counts").over(inside))
    totals = placed.groupBy("_part", *keys).agg(F.sum("_counts").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), F.col("_client").alias("_c"), F.col("day").alias("_d"),
                            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    same = (F.col("_part") == F.col("_p")) & F.col("_client").eqNullSafe(F.col("_c")) & F.col("day").eqNullSafe(F.col("_d"))
    n = F.col("_own") + F.col("_offset")
    return told.join(offsets, same).select(*log.columns, "day", n.alias("n_requests"), (n > limit).alias("blocked"))


def daily_quota_stream(log: DataFrame, limit: int = M.DAILY_LIMIT, client: str = "ip",
                       lateness: str = "1 day") -> DataFrame:
    """Streaming twin on a tumbling day; use output mode 'update'.

    Windows start at the session's midnight: moments are shifted to the local
    clock first. Events later than the watermark are dropped.
    """
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    day = F.date_from_unix_date((F.unix_seconds("window.start") / 86400).cast("int"))
    return (
        log.withColumn("ts", local)
        .withWatermark("ts", lateness)
        .groupBy(F.col(client).cast("string").alias("client"), F.window("ts", "1 day"))
        .agg(F.count("*").alias("n_requests"))
        .select("client", day.alias("day"), "n_requests",
                (F.col("n_requests") > limit).alias("blocked"))
    )


def run_quota(log: DataFrame, out: str, checkpoint: str, limit: int = M.DAILY_LIMIT,
              client: str = "ip", lateness: str = "1 day"):
    """Run the stream over what has arrived; counts go to `out` by micro-batch.

    A batch that is repeated after a failure overwrites its own folder.
    """
    def keep(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        daily_quota_stream(log, limit, client, lateness).writeStream
        .outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(keep).start()
    )


def latest_counts(updates: DataFrame) -> DataFrame:
    """Last update of each client and day."""
    return updates.groupBy("client", "day").agg(
        F.max_by("n_requests", "batch").alias("n_requests"),
        F.max_by("blocked", "batch").alias("blocked"))
