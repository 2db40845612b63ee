"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits.  It is cut into ``blocks`` runs of bits; two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` runs.  So every fingerprint is filed under each
choice of that many runs (by default 3 of 6: twenty keys of about 32 bits), and linked fingerprints meet under
at least one key.  There they are compared by Hamming distance.

Only distinct fingerprints take part, so copies cost nothing, and a bucket never emits all its pairs: it emits
the links of a spanning forest, which has the same components.  Buckets of up to ``bucket_limit`` fingerprints
are compared in one vectorised pass.  A larger bucket takes another exact way, linear in its size: inside a
bucket the members differ only in its free bits, and two members are within d bits exactly if some value lies
within d // 2 bits of one and (d + 1) // 2 bits of the other; around every such value all members are tied to
one near member by ordinary aggregations and joins, which spread over all executors.

Edge cases: null and empty texts have no words and the fingerprint zero, which is linked like any other;
texts of fewer words than a shingle are one shingle; repeated rows are rows of the result, but ``keep_one``
leaves one of them; an empty table gives an empty result; a null id is never the least id of a group unless the
group has no other; of a very long text the hashes are counted in parts; other columns are not read and may have
any names, an identifier column called like a result column is refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, located, no_clash, stored, table, utf8_list, without_places
from sparkloom.operators.components import connected_components

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
BUCKET_LIMIT = 4096
SEED = 42


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text: bit i is set if it is set in over half of the shingle hashes."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.array(
        [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)], dtype=np.uint64
    )
    total = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    high = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(high.view(np.uint64)[0])


def fingerprint_column(text_col: str, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit column."""

    def run(column: pa.Array) -> pa.Array:
        found = np.array([fingerprint(x, shingle) for x in utf8_list(column)], dtype=np.uint64)
        return pa.array(found.view(np.int64), pa.int64())

    return F.arrow_udf(run, "bigint")(F.col(f"`{text_col}`").cast("string"))


def _widths(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    base, more = divmod(64, blocks)
    out, at = [], 0
    for i in range(blocks):
        width = base + (i < more)
        out.append((at, width))
        at += width
    return out


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bits of every choice of blocks - distance blocks, as unsigned masks."""
    parts = [((1 << w) - 1) << at for at, w in _widths(blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values (int64, distinct) under Hamming distance."""
    n = len(values)
    bits = values.view(np.uint64)  # bitwise_count would take a negative number's absolute value
    if n == 2:
        near = int(np.bitwise_count(bits[0] ^ bits[1])) <= distance
        return [(int(values[0]), int(values[1]))] if near else []
    left = np.ones(n, dtype=bool)
    links = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return links
            near = rest[np.bitwise_count(bits[rest] ^ bits[x]) <= distance]
            left[near] = False
            queue.extend(near.tolist())
            links.extend((int(values[x]), int(values[y])) for y in near)
    return links


def _bucket_links(limit: int, distance: int):
    """Over rows sorted by (choice, key): forest links, and as (choice, null) the overfull buckets' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("choice", pa.int32()), ("key", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())])
        held_at: tuple[int, int] | None = None
        held: list[np.ndarray] = []
        size = 0

        def close() -> list[tuple]:
            if size < 2:
                return []
            if size > limit:
                return [(*held_at, None, None)]
            return [(None, None, a, b) for a, b in _forest(np.concatenate(held), distance)]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            choice, key, fp = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            cut = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            edges = [0, *cut.tolist(), len(key)]
            out: list[tuple] = []
            for a, b in zip(edges, edges[1:], strict=False):
                at = (int(choice[a]), int(key[a]))
                if at != held_at:
                    out += close()
                    held_at, held, size = at, [], 0
                size += b - a
                if size <= limit:
                    held.append(fp[a:b])
                else:
                    held = []
            if out:
                yield emit(out)
        if held_at is not None and (out := close()):
            yield emit(out)

    return run


def _overfull_links(filed: DataFrame, overfull: DataFrame, distance: int, masks: list[int]) -> DataFrame:
    """Links inside overfull buckets, by values near their members."""
    near, far = distance // 2, (distance + 1) // 2
    every = F.array(*(F.lit(_signed(m)) for m in masks))
    bits = F.expr("filter(sequence(0, 63), b -> (shiftright(mask, b) & 1) = 0)")
    members = (
        filed.join(overfull, ["choice", "key"], "left_semi")
        .withColumn("mask", F.element_at(every, F.col("choice") + 1))
        .withColumn("free", bits)
    )
    flips = ["array(fp)"]
    for r in range(1, far + 1):
        inner = "fp" + "".join(f" ^ shiftleft(1L, b{i})" for i in range(r))
        expr = f"array({inner})"
        for i in reversed(range(r)):
            source = "free" if i == 0 else f"filter(free, x -> x > b{i - 1})"
            expr = f"flatten(transform({source}, b{i} -> {expr}))"
        flips.append(expr)
    close = F.concat(*(F.expr(x) for x in flips[: near + 1]))
    wide = F.concat(*(F.expr(x) for x in flips[: far + 1]))
    at = ["choice", "key", "value"]
    anchors = (
        members.select("choice", "key", "fp", F.explode(close).alias("value"))
        .groupBy(*at)
        .agg(F.min("fp").alias("dst"))
    )
    tied = members.select("choice", "key", "fp", F.explode(wide).alias("value"))
    return tied.join(anchors, at).where("fp != dst").select(F.col("fp").alias("src"), "dst").distinct()


def links(fingerprints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(src, dst)``: links between the distinct fingerprints (column fp) that join every pair within ``distance``."""
    if blocks <= distance:
        raise ValueError("there must be more blocks than bits that may differ")
    masks = block_masks(blocks, distance)
    filed = fingerprints.select(
        "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("choice", "key")
    ).select("choice", "key", "fp")
    dealt = filed.repartition("choice", "key").sortWithinPartitions("choice", "key")
    found = stored(
        dealt.mapInArrow(_bucket_links(bucket_limit, distance), "choice int, key bigint, src bigint, dst bigint"),
        "simhash-links",
    )
    plain = found.where("src is not null").select("src", "dst")
    overfull = found.where("src is null").select("choice", "key")
    if overfull.isEmpty():
        return plain
    return plain.unionByName(_overfull_links(filed, overfull, distance, masks))


def _classes(marked: DataFrame, least: Column, distance: int, blocks: int, bucket_limit: int) -> DataFrame:
    """(fp, n, first) per fingerprint of ``marked`` (fp, ...): its number of rows, and the least ``least`` of its component."""
    classes = stored(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min(least).alias("least")), "simhash-classes")
    pairs = links(classes.select("fp"), distance, blocks, bucket_limit)
    parts = stored(connected_components(pairs, "src", "dst").toDF("fp", "root"), "simhash-parts")
    linked = stored(classes.join(parts, "fp").select("fp", "root", "least"), "simhash-linked")
    groups = stored(linked.groupBy("root").agg(F.count("*").alias("members"), F.min("least").alias("first")), "simhash-groups")
    of_linked = join_hot(linked.select("fp", "root"), groups, "root", "members").select("fp", "first")
    return stored(classes.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("first", "least").alias("first")), "simhash-verdicts")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """``(id_col, fp, component_id)``, a row per row of ``docs``; component_id is the least id of the group."""
    no_clash(id_col, ("fp", "component_id"))
    marked = stored(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(text_col, shingle).alias("fp")), "simhash-prints")
    verdict = _classes(marked, F.col("id"), distance, blocks, bucket_limit)
    return join_hot(marked, verdict, "fp", "n").select(F.col("id").alias(id_col), "fp", F.col("first").alias("component_id"))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each group exactly one, of the least id."""
    docs, place = located(docs, "simhash-rows")
    marked = stored(
        docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(text_col, shingle).alias("fp"), place.alias("place")), "simhash-prints"
    )
    mine = F.struct(F.col("id").isNull().alias("unnamed"), "id", "place")
    verdict = _classes(marked, mine, distance, blocks, bucket_limit)
    found = join_hot(marked, verdict, "fp", "n")
    return without_places(docs, place, stored(found.where("place != first.place").select("place"), "simhash-gone"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
