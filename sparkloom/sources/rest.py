"""A chain's REST interface as a PySpark data source (``format("chain_rest")``), and a crawler over it.

Keys are dealt into partitions and asked for by the executors; within a partition requests keep a least interval, and
are tried again, with doubled waits, when the server is busy or can't be reached.  With ``cache``, a folder in shared
storage, answers are written through, so a repeated task or crawl asks for nothing twice.  A key that the server
doesn't know gives a row with its status and no body."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# First heights of the script eras, and the floor of the first.
ERAS = (("pre_segwit", 200_000, 481_824), ("segwit", 481_824, 709_632), ("taproot", 709_632, None))
PAGE = 25
_PATHS = {
    "tx": "/tx/{key}",
    "outspends": "/tx/{key}/outspends",
    "block": "/block/{key}",
    "block_hash": "/block-height/{key}",
    "block_at": "/v1/blocks/{key}",
    "blocks": "/v1/blocks",
    "tip": "/blocks/tip/height",
}
_NEVER_CACHED = ("blocks", "tip")


@dataclass
class _Keys(InputPartition):
    keys: tuple

    def __init__(self, keys: tuple):
        self.keys = keys


class _Client:
    def __init__(self, options: dict):
        self.base = options["base"].rstrip("/")
        self.tries, self.interval = int(options.get("tries", 6)), float(options.get("min_interval", 0.2))
        self.backoff, self.last = float(options.get("backoff", 1.0)), 0.0
        self.cache = options.get("cache")

    def get(self, path: str) -> tuple[int, str | None]:
        for attempt in range(self.tries):
            time.sleep(max(0.0, self.last + self.interval - time.monotonic()))
            again = attempt + 1 < self.tries
            try:
                with urllib.request.urlopen(self.base + path, timeout=30) as answer:
                    return answer.status, answer.read().decode()
            except urllib.error.HTTPError as problem:
                if problem.code == 404:
                    return 404, None
                if not (again and (problem.code == 429 or problem.code >= 500)):
                    raise
            except urllib.error.URLError:
                if not again:
                    raise
            finally:
                self.last = time.monotonic()
            time.sleep(self.backoff * 2**attempt)
        raise RuntimeError("no tries are left")

    def cached(self, kind: str, key: str, path: str) -> tuple[int, str | None]:
        if not self.cache or kind in _NEVER_CACHED:
            return self.get(path)
        fs, root = pafs.FileSystem.from_uri(self.cache) if "://" in self.cache else (pafs.LocalFileSystem(), self.cache)
        place = f"{root}/{kind}/{re.sub(r'[^0-9A-Za-z_-]', '_', key)}"
        if fs.get_file_info(place).type == pafs.FileType.File:
            with fs.open_input_stream(place, compression=None) as file:
                return 200, file.read().decode()
        status, body = self.get(path)
        if body is not None:
            fs.create_dir(f"{root}/{kind}", recursive=True)
            aside = f"{place}.{uuid.uuid4().hex}"
            with fs.open_output_stream(aside, compression=None) as out:
                out.write(body.encode())
            fs.move(aside, place)
        return status, body


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.kind = options["kind"]

    def partitions(self) -> list[_Keys]:
        keys = json.loads(self.options.get("keys", "[]")) or [""]
        size = int(self.options.get("per_partition", 50))
        return [_Keys(tuple(keys[k : k + size])) for k in range(0, len(keys), size)]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        client = _Client(self.options)
        for key in partition.keys:
            if self.kind == "block_pages":
                yield from self._pages(client, key)
                continue
            status, body = client.cached(self.kind, key, _PATHS[self.kind].format(key=key))
            if self.kind == "block_at" and body is not None:  # blocks up to that height; the first if it isn't there
                found = json.loads(body)
                body = json.dumps(next((b for b in found if str(b.get("height")) == key), found[0] if found else {}))
            yield key, 0, status, None if body is None else body.strip()

    def _pages(self, client: _Client, block: str) -> Iterator[tuple]:
        """The pages of a block, until one is short or missing."""
        for page in range(int(self.options.get("max_pages", 8))):
            status, body = client.cached("block_txs", f"{block}_{page * PAGE}", f"/block/{block}/txs/{page * PAGE}")
            if body is None:
                return
            yield block, page, status, body
            if len(json.loads(body)) < PAGE:
                return


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chain_rest"

    def schema(self) -> str:
        return "key string, page int, status int, body string"

    def reader(self, schema) -> RestReader:
        return RestReader(dict(self.options))


def read(spark: SparkSession, base: str, kind: str, keys=(), **options) -> DataFrame:
    """``(key, page, status, body)``: kind is tx, outspends, block, block_hash, block_at, blocks, tip or block_pages."""
    if kind not in _PATHS and kind != "block_pages":
        raise ValueError(f"unknown kind {kind!r}")
    spark.dataSource.register(RestSource)
    asked = spark.read.format("chain_rest").option("base", base).option("kind", kind).option("keys", json.dumps([str(k) for k in keys]))
    return asked.options(**{k: str(v) for k, v in options.items()}).load()


def crawl_targets(blocks_per_era: int, tip: int) -> list[tuple[str, int]]:
    """(era, height): heights at even steps within each era, the last of which ends at the tip."""
    out = []
    for name, low, high in ERAS:
        top = (tip if high is None else high) - 1
        if top > low:
            step = max(1, (top - low) // blocks_per_era)
            out += [(name, low + k * step) for k in range(blocks_per_era)]
    return out


def crawl(spark: SparkSession, base: str, blocks_per_era: int = 8, max_pages: int = 8, **options) -> DataFrame:
    """``(era, height, page, body)``: pages of transactions of a few blocks of each era."""
    tip = int(read(spark, base, "tip", **options).first()["body"])
    targets = spark.createDataFrame(crawl_targets(blocks_per_era, tip), "era string, height bigint")
    heights = [r["height"] for r in targets.collect()]
    hashes = read(spark, base, "block_hash", heights, **options).where("body is not null").select(F.col("key").cast("bigint").alias("height"), F.col("body").alias("block")).collect()
    of = spark.createDataFrame([(r["height"], r["block"]) for r in hashes], "height bigint, block string")
    pages = read(spark, base, "block_pages", [r["block"] for r in hashes], max_pages=max_pages, per_partition=1, **options)
    return targets.join(of, "height").join(pages.withColumnRenamed("key", "block"), "block").select("era", "height", "page", "body")
