"""Exact deduplication as a stateful stream.

Texts are reduced to slim records (SHA-256 digest, stable identifier, content locator) in an inbox table.  A
structured stream folds the inbox into keyed state on disk (RocksDB, no expiry): per digest the number of
rows, the largest identifier and the locator of that row's content, which is its file and its row number there.
Copies are pre-aggregated before they are shuffled, so a digest that holds a third of all rows reaches the state
as one record per task.  With ``state_dir`` the state outlives the call: the next one goes on from it.

A digest seen more than once is a hit, and hits are checked on their full bytes.  A membership table of bounded
size marks the rows of hit digests where they lie; only their texts are grouped, by digest and text, again
pre-aggregated, so a hot text moves once per task.  Where a digest turns out to stand for several texts, its rows
are grouped anew by their bytes.  All else moves as slim records.  Everything on this path is DataFrame
operations.

Edge cases: a null text counts as empty; all empty texts are copies of each other; a null identifier stays only
where its group has no other; of rows that repeat both identifier and text one stays, by its locator; an empty
table gives an empty result; very long texts are only ever hashed or, if hit, compared; columns of the input
other than identifier and text are not read, so they may have any names; an identifier column that is called like
a result column is refused with a ValueError.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bits_of, flagged, join_hot, located, no_clash, scratch, stored, table, without_places

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # without it every partition's store sets aside megabytes for its manifest and log
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.minBatchesToRetain": "2",
}
_RESULTS = ("keep_id", "group_size", "kept", "digest")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold(inbox_path: str, schema, state_path: str, out_path: str, spark: SparkSession, files_per_batch: int | None = None) -> DataFrame:
    """Fold the inbox into the state at ``state_path`` and return the state: (digest, n, keep).

    Called again with the same paths after rows were added to the inbox, it continues where it stopped.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    held = (
        reader.parquet(inbox_path)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("id", "place")).alias("keep"))
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            held.writeStream.outputMode("update")
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    # an update holds the whole state of its digest, and both parts only ever grow
    return (
        spark.read.schema(held.schema)
        .option("basePath", out_path)
        .option("recursiveFileLookup", "true")
        .parquet(out_path)
        .groupBy("digest")
        .agg(F.max("n").alias("n"), F.max("keep").alias("keep"))
    )


def _earlier_rows(spark: SparkSession, earlier: DataFrame, id_col: str, text_col: str, digest) -> DataFrame | None:
    """(id, text, place, digest) of rows of earlier calls, fetched by their locators; None if there are none.

    What reaches the driver is the list of files that hold them, as for any other scan."""
    files = [r[0] for r in earlier.select("place.file").distinct().collect()]
    if not files:
        return None
    held = spark.read.parquet(*files)
    rows, place = located(held, "dedup-earlier")
    return _contents(rows, place, id_col, text_col, digest).join(earlier.select("place"), "place", "left_semi")


def _contents(docs: DataFrame, place: Column, id_col: str, text_col: str, digest) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), place.alias("place"), digest(text).alias("digest"))


def _judged(docs: DataFrame, place: Column, id_col: str, text_col: str, digest, files_per_batch: int | None, state_dir: str | None) -> DataFrame:
    """(id, place, digest, keep, group_size) per row of ``docs``; keep is (id, place) of the row that stays."""
    spark = docs.sparkSession
    base = state_dir.rstrip("/") if state_dir else scratch(spark, "dedup")
    call = uuid.uuid4().hex
    rows = _contents(docs, place, id_col, text_col, digest)
    slim = rows.select("digest", "id", "place", F.lit(call).alias("call"))
    slim.write.mode("append").parquet(f"{base}/inbox")
    inbox = spark.read.schema(slim.schema).parquet(f"{base}/inbox")
    state = stored(fold(f"{base}/inbox", slim.schema, f"{base}/state", f"{base}/seen", spark, files_per_batch), "dedup-seen")
    hits = state.where("n > 1")
    bits, n_bits = bits_of(hits, "digest")
    bits = stored(bits, "dedup-bits")
    may_hit = lambda x: flagged(x, F.col("digest"), bits, n_bits, "__hit").where("`__hit`").drop("__hit")
    contents = may_hit(rows)
    if state_dir:
        earlier = stored(may_hit(inbox.where(F.col("call") != call)).join(hits.select("digest"), "digest", "left_semi"), "dedup-earlier-hits")
        more = _earlier_rows(spark, earlier, id_col, text_col, digest)
        contents = contents if more is None else contents.unionByName(more)
    # the byte check: rows of one digest whose texts differ fall into several groups
    texts = contents.groupBy("digest", "text").agg(F.count("*").alias("n"))
    torn = stored(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "dedup-torn")
    mine = inbox.where(F.col("call") == call).select("id", "place", "digest")
    marked = flagged(mine, F.col("digest"), bits, n_bits, "__hit")
    alone = marked.where("not `__hit`").select("id", "place", "digest", F.struct("id", "place").alias("keep"), F.lit(1).cast("long").alias("group_size"))
    met = join_hot(marked.where("`__hit`").drop("__hit"), stored(hits, "dedup-hits"), "digest", "n").select(
        "id", "place", "digest", F.coalesce("keep", F.struct("id", "place")).alias("keep"), F.coalesce("n", F.lit(1)).alias("group_size")
    )
    found = alone.unionByName(met)
    if not torn.isEmpty():
        loose = contents.join(torn.select("digest"), "digest", "left_semi")
        groups = loose.groupBy("digest", "text").agg(F.max(F.struct("id", "place")).alias("keep"), F.count("*").alias("group_size"))
        anew = loose.join(groups, ["digest", "text"]).join(mine.select("place"), "place", "left_semi")
        found = found.join(torn.select("digest"), "digest", "left_anti").select(*found.columns).unionByName(anew.select(*found.columns))
    return found


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    files_per_batch: int | None = None,
    state_dir: str | None = None,
) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, digest)``, a row per row of ``docs``; one row of each group is kept.

    ``state_dir``, a folder in shared storage, holds state that goes on from call to call: ``docs`` are then judged
    together with all rows of earlier calls, which must still lie in their files.  Rows that aren't read from
    Parquet files are written below the shared folder first.
    """
    no_clash(id_col, _RESULTS)
    docs, place = located(docs.select(f"`{id_col}`", f"`{text_col}`"), "dedup-rows")
    return _judged(docs, place, id_col, text_col, digest, files_per_batch, state_dir).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("place") == F.col("keep.place")).alias("kept"),
        "digest",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, exactly one of each group of equal texts, with their own columns."""
    docs, place = located(docs, "dedup-rows")
    found = _judged(docs, place, id_col, text_col, digest, files_per_batch, None)
    gone = stored(found.where("place != keep.place").select("place"), "dedup-gone")
    return without_places(docs, place, gone)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
