"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.shared import join_hot, scratch, shared_dir, stored

__all__ = ["bits_of", "crc_mod", "flagged", "join_hot", "located", "no_clash", "scratch", "shared_dir", "ship", "stored", "table", "utf8_list", "without_places"]

#: Bits of a membership table (64 MB when it is broadcast), and bits set aside per member below that.
MOST_BITS, BITS_PER_MEMBER = 1 << 29, 16
_BUCKET_BITS = 15
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it.

    Batches that go to Python are bounded by their bytes too, since texts may be long, unless the application
    has set its own bounds.
    """
    context = spark.sparkContext
    for key, value in _BATCHES.items():
        if context.getConf().get(key) is None:
            spark.conf.set(key, value)
    if getattr(context, "_sparkloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._sparkloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_list(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def no_clash(column: str, results: tuple[str, ...]) -> None:
    """An input column that keeps its name in the result must not be called like a result column."""
    if column in results:
        raise ValueError(f"the column {column!r} has the name of a result column; rename it first")


# --- places of rows


def located(docs: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """``docs`` and the place of each row: (file, row number in it).

    Rows that come straight from Parquet files lie where they are; others are written once below the shared
    folder.  A place names one row even where all its values repeat.
    """
    place = _place(docs)
    if place is None:
        docs = stored(docs, name)
        place = _place(docs)
    return docs, place


def _place(docs: DataFrame) -> Column | None:
    try:
        meta = docs.metadataColumn("_metadata")
        place = F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))
        docs.select(place)
    except AnalysisException:
        return None
    return place


def bits_of(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A membership table (bucket, bits) over the hashes of ``keys``, and its number of bits.

    It has at most ``MOST_BITS`` bits, whatever the number of keys: a member is always found, and what it finds
    besides grows with the share of bits that are set.
    """
    wanted = max(keys.count() * BITS_PER_MEMBER, 1)
    n_bits = min(MOST_BITS, 1 << max(_BUCKET_BITS, (wanted - 1).bit_length()))
    slot = _slot(F.col(key), n_bits)
    at = keys.select(F.shiftright(slot, _BUCKET_BITS).alias("bucket"), slot.bitwiseAND((1 << _BUCKET_BITS) - 1).alias("at"))
    return at.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), n_bits


def _slot(key: Column, n_bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(n_bits - 1)


def flagged(rows: DataFrame, key: Column, bits: DataFrame, n_bits: int, flag: str) -> DataFrame:
    """``rows`` with a boolean column: whether the key may be a member.  The table is broadcast; no row moves."""
    slot = _slot(key, n_bits)
    at = rows.withColumn("__bucket", F.shiftright(slot, _BUCKET_BITS)).withColumn("__at", slot.bitwiseAND((1 << _BUCKET_BITS) - 1).cast("int"))
    met = at.join(F.broadcast(bits.toDF("__bucket", "__bits")), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(`__byte`, `__at` & 7) & 1") == 1
    return met.withColumn("__byte", byte).withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__bucket", "__at", "__bits", "__byte")


def without_places(docs: DataFrame, place: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose place isn't in ``gone`` (column place); ``docs`` and ``place`` from ``located``.

    A bounded membership table lets all other rows pass where they are; only rows that it flags are moved and
    compared exactly.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.select(*(F.col(f"`{n}`").alias(i) for n, i in zip(names, inner, strict=True)), place.alias("place"))
    bits, n_bits = bits_of(gone, "place")
    marked = flagged(rows, F.col("place"), stored(bits, "places-bits"), n_bits, "__flag")
    free = marked.where("not `__flag`").select(*inner)
    held = marked.where("`__flag`").join(gone.select("place"), "place", "left_anti").select(*inner)
    return free.unionByName(held).toDF(*names)
