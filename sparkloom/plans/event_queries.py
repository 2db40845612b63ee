"""Queries over events in time, streams, and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import axes
from sparkloom.operators import temporal
from sparkloom.operators.components import _folder
from sparkloom.operators.measure import measure
from sparkloom.sources import exports, ledger
from sparkloom.streaming import windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _times(spark, sf):
    return _events(spark, sf).select("user_id", F.unix_timestamp("ts").alias("at"))


@query(
    "active_hours",
    "SELECT user_id AS entity, CAST(extract(hour FROM ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL",
)
def active_hours(spark, sf):
    x = temporal.active_hours(_times(spark, sf), "user_id", "at")
    return x.select("entity", F.posexplode("hours").alias("hour", "n")).where("n > 0").select("entity", F.col("hour").cast("long").alias("hour"), "n")


@query(
    "schedule_distance",
    """WITH r AS (SELECT user_id, extract(hour FROM ts) AS h, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
half AS (SELECT user_id, k <= n // 2 AS early, h, count(*) AS c FROM r WHERE n >= 8 GROUP BY ALL),
tot AS (SELECT user_id, early, sum(c) AS t FROM half GROUP BY ALL), p AS (SELECT user_id, early, h, c / t AS p FROM half JOIN tot USING (user_id, early))
SELECT user_id AS entity, round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS distance
FROM (SELECT * FROM p WHERE early) a FULL JOIN (SELECT * FROM p WHERE NOT early) b USING (user_id, h) GROUP BY user_id""",
)
def schedule_distance(spark, sf):
    x = temporal.halves(_times(spark, sf), "user_id", "at")
    return x.select("entity", F.round(temporal.schedule_distance(F.col("first"), F.col("second")), 6).alias("distance"))


@query("temporal_entities_having", "SELECT user_id AS entity, count(*) AS n, CAST(floor(min(epoch(ts))) AS BIGINT) AS first_at, CAST(floor(max(epoch(ts))) AS BIGINT) AS last_at FROM events GROUP BY user_id HAVING count(*) BETWEEN 8 AND 200")
def temporal_entities_having(spark, sf):
    x = temporal.recurring(_times(spark, sf), "user_id", "at", 8, 200)
    return x.select("entity", F.size("times").cast("long").alias("n"), F.get("times", F.lit(0)).alias("first_at"), F.element_at("times", -1).alias("last_at"))


@query("calibrate_temporal")
def calibrate_temporal(spark, sf):
    got = temporal.calibrate(_times(spark, sf), "user_id", "at")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query("tumbling_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    x = windows.tumbling_counts(_events(spark, sf))
    return x.withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark, sf):
    x = windows.sessions(_events(spark, sf))
    return x.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("streamed_daily_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_daily_counts(spark, sf):
    """The same counts from a stream that is processed to its end in update mode."""
    folder = _folder(spark)
    stream = windows.tumbling_counts(windows.read_stream(spark, f"{sf}/events.parquet"))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return rows.groupBy("start", "event_type").agg(F.max("n").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("era", ledger.SQL + "SELECT CASE WHEN height * 400 < 481824 THEN 'pre_segwit' WHEN height * 400 < 709632 THEN 'segwit' ELSE 'taproot' END AS era, count(*) AS n FROM tx_head GROUP BY 1")
def era(spark, sf):
    return ledger.transactions(spark, sf).groupBy(exports.era(F.col("height") * 400).alias("era")).agg(F.count("*").alias("n"))


@query("uniform_sample")
def uniform_sample(spark, sf):
    return exports.uniform_sample(ledger.transactions(spark, sf), 50, 2, seed=7, floor=10).select("txid", "height")


@query("witness_bits_by_era")
def witness_bits_by_era(spark, sf):
    """Bits of the witness axes within each era."""
    txs = ledger.transactions(spark, sf).withColumn("era", exports.era(F.col("height") * 400))
    named = {k: axes.AXES[k] for k in ("low_r", "sighash", "nested_segwit", "pubkey_compression", "multisig")}
    out = None
    for name in ("pre_segwit", "segwit", "taproot"):
        part = measure(txs.where(F.col("era") == name), named).withColumn("era", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("p", F.round("p", 6)).withColumn("bits", F.round("bits", 6))


@query("locktime_vs_broadcast")
def locktime_vs_broadcast(spark, sf):
    """Against the least fee rate of the block before, where there is one."""
    txs = ledger.transactions(spark, sf)
    blocks = txs.groupBy((F.col("height") + 1).alias("height")).agg(
        F.struct(F.min(axes.feerate()).alias("prev_min"), F.min("block_time").alias("prev_time"), F.max("block_time").alias("incl_time")).alias("_bc")
    )
    x = txs.join(blocks, "height", "left").select(axes.locktime_vs_broadcast().alias("value"))
    return x.groupBy("value").agg(F.count("*").alias("n"))


def _era_sql() -> str:
    from sparkloom.plans.axis_queries import _AXIS_SQL

    names = ("low_r", "sighash", "nested_segwit", "pubkey_compression", "multisig")
    vals = " UNION ALL ".join(f"SELECT '{k}' AS axis, txid, value FROM ({_AXIS_SQL[k]}) x{i}" for i, k in enumerate(names))
    return ledger.SQL + f""", vals AS ({vals}), e AS (SELECT CASE WHEN height * 400 < 481824 THEN 'pre_segwit' WHEN height * 400 < 709632 THEN 'segwit' ELSE 'taproot' END AS era, txid FROM tx_head),
c AS (SELECT era, axis, value, count(*) AS n FROM vals JOIN e USING (txid) GROUP BY ALL)
SELECT era, axis, value, n, round(n / sum(n) OVER (PARTITION BY era, axis), 6) AS p, round(-log2(n / sum(n) OVER (PARTITION BY era, axis)), 6) AS bits FROM c"""


ORACLE_SQL["witness_bits_by_era"] = _era_sql()
ORACLE_SQL["locktime_vs_broadcast"] = ledger.SQL + """, r AS (SELECT *, CASE WHEN fee <> 0 THEN fee / (weight / 4.0) END AS rate FROM tx_head), b AS (SELECT height + 1 AS height, min(rate) AS least FROM r GROUP BY height),
v AS (SELECT CASE WHEN b.height IS NULL THEN 'na' WHEN locktime = 0 THEN 'no_locktime' WHEN locktime >= 500000000 THEN 'timestamp' WHEN NOT coalesce(least < rate, false) THEN 'na_loose'
  WHEN locktime > r.height + 1 THEN 'future' WHEN locktime >= r.height - 100 THEN 'matches' ELSE 'backdated' END AS value FROM r LEFT JOIN b ON b.height = r.height)
SELECT value, count(*) AS n FROM v GROUP BY value"""
