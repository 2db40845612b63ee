"""Hierarchical packing of token ids into sequences of several context sizes.

A document's ids are cut into whole windows of the largest tier; the rest is routed to the smallest tier that
holds it.  Each tier is packed into windows of its own size, from the largest tier down, and the gap that a
long window leaves is filled from shorter tiers: by the longest whole pieces that fit, then by cutting one
piece to measure.  Where nothing shorter is left, the piece itself is cut at the next smaller tier.  So every
window is exactly full, and nothing is padded; at the end of a task the last few ids, fewer than the smallest
tier, are cut at powers of two.  Full windows are dealt into step groups of equal token count, the costliest
attention first, so that a step costs about the same on every worker.

Packing is local to a task: it needs no shuffle, holds at most about ``pool_tokens`` ids, and a task that runs
again packs the same rows in the same way.

Tokenising goes by distinct words: a worker keeps the ids of words that it has met (at most ``cache_words``)
and asks the tokenizer for new ones only.  This holds where normalisation acts on single characters; texts
with other characters, or with a special token's string, go through the tokenizer whole.

Edge cases: null text counts as empty and yields the single end id; repeated rows are packed each on their
own; ids of rows are only carried along; a very long text is cut into whole windows as it comes; an empty table
gives an empty result; other columns are not read; an identifier column called like a result column is refused
with a ValueError.
"""

from __future__ import annotations

import heapq
import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import no_clash, ship, table

TIERS = (256, 512, 1024, 2048)
END_ID = 1
POOL_TOKENS = 1 << 20
CACHE_WORDS = 500_000
GROUP = 16
STEP_TOKENS = 16 * 2048

_LETTERS, _NUMBERS, _SPACES = "a-zA-Zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The tokenizer's own word pattern, a fixed value, spelt out for characters below U+0250 (and the dot above
#: that lower-casing can leave, which is neither letter nor number).
WORD_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
)


class WordTokenizer:
    """Ids of texts, packed as little-endian 32-bit integers."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.inner.get_added_tokens_decoder().values())
        self.find = re.compile(WORD_PATTERN).findall
        self.simple = re.compile(r"[\x00-\u024f]*").fullmatch
        self.stays_simple = re.compile(r"[\x00-\u024f\u0307]*").fullmatch  # some capitals have small letters beyond
        self.known: dict[str, bytes] = {}
        self.most = cache_words

    def encode(self, texts: list[str]) -> list[bytes]:
        low = [x.lower() for x in texts]
        plain = [bool(self.simple(x) and self.stays_simple(y)) and not ("<|" in x and any(s in x for s in self.specials)) for x, y in zip(texts, low, strict=True)]
        split = [self.find(y) if p else () for y, p in zip(low, plain, strict=True)]
        met = set().union(*split)
        fresh = met.difference(self.known)
        if len(self.known) + len(fresh) > self.most:  # drop the older half
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
            fresh = met.difference(self.known)
        self._learn(list(fresh))
        get = self.known.__getitem__
        return [
            b"".join(map(get, words)) if p else _packed(self.inner.encode(x, add_special_tokens=False).ids)
            for x, p, words in zip(texts, plain, split, strict=True)
        ]

    def _learn(self, words: list[str]) -> None:
        """Many words go through the tokenizer as one text."""
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            got = self.inner.encode(" ".join(part), add_special_tokens=False)
            of = np.array(got.word_ids, dtype=np.int64)
            ends = (4 * np.searchsorted(of, np.arange(len(part)), "right")).tolist()
            ids, at = _packed(got.ids), 0
            for w, end in zip(part, ends, strict=True):
                self.known[w] = ids[at:end]
                at = end


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    """One per worker process and file."""
    key = (path, cache_words)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer(*key)
    return _TOKENIZERS[key]


class Packer:
    """Packs pieces (document number, start, length) into exactly full windows of the given tiers.

    Pieces wait in one list per tier, ordered by length.  ``windows()`` yields finished windows as lists of
    pieces and keeps what doesn't fill a window of the smallest tier; ``tail()`` yields that rest.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be rising powers of two")
        self.tiers = tiers
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
        self.full: list[list[tuple[int, int, int]]] = []
        self.held = 0

    def add(self, doc: int, start: int, length: int) -> None:
        top = self.tiers[-1]
        while length >= top:
            self.full.append([(doc, start, top)])
            start, length = start + top, length - top
        if length:
            self._route(doc, start, length)

    def _route(self, doc: int, start: int, length: int) -> None:
        tier = next(k for k, t in enumerate(self.tiers) if length <= t)
        insort(self.pools[tier], (length, doc, start))
        self.held += length

    def _fill(self, window: list[tuple[int, int, int]], gap: int, below: int) -> int:
        """Fill the gap from the pools up to ``below``; returns what stays open."""
        for tier in range(below, -1, -1):
            pool = self.pools[tier]
            while gap and pool and (at := bisect_right(pool, (gap, 1 << 62, 0))):
                length, doc, start = pool.pop(at - 1)
                self.held -= length
                window.append((doc, start, length))
                gap -= length
        if gap:  # cut the longest of the short pieces to measure
            for tier in range(below, -1, -1):
                if self.pools[tier] and self.pools[tier][-1][0] > gap:
                    length, doc, start = self.pools[tier].pop()
                    self.held -= length
                    window.append((doc, start, gap))
                    self._route(doc, start + gap, length - gap)
                    return 0
        return gap

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        yield from self.full
        self.full = []
        for tier in range(len(self.tiers) - 1, -1, -1):
            size, pool = self.tiers[tier], self.pools[tier]
            while pool and (tier or self.held >= size):
                length, doc, start = pool.pop()
                self.held -= length
                window, gap = [(doc, start, length)], size - length
                if gap and self.held >= gap:
                    gap = self._fill(window, gap, tier - 1 if tier else 0)
                if not gap:
                    yield window
                    continue
                # nothing shorter is left: give all back, and cut the long piece at the next smaller tier
                for d, s, n in window[1:]:
                    self._route(d, s, n)
                if tier:
                    cut = self.tiers[tier - 1]
                    yield [(doc, start, cut)]
                    if length > cut:
                        self._route(doc, start + cut, length - cut)
                else:
                    self._route(doc, start, length)
                    break

    def tail(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is left, in order, cut into windows of falling powers of two."""
        rest = [(doc, start, length) for pool in self.pools for length, doc, start in pool]
        self.pools, self.held = [[] for _ in self.tiers], 0
        total = sum(n for _, _, n in rest)
        rest.reverse()
        while total:
            size = min(1 << (total.bit_length() - 1), self.tiers[-1])
            window, gap = [], size
            while gap:
                doc, start, length = rest.pop()
                used = min(length, gap)
                window.append((doc, start, used))
                if length > used:
                    rest.append((doc, start + used, length - used))
                gap -= used
            yield window
            total -= size


def deal_steps(windows: list[list[tuple[int, int, int]]], step_tokens: int) -> list[int]:
    """A step group per window: groups of about ``step_tokens`` tokens and of even attention cost."""
    sizes = [sum(n for _, _, n in w) for w in windows]
    costs = [sum(n * n for _, _, n in w) for w in windows]
    groups = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, 0, g) for g in range(groups)]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: (-sizes[k], -costs[k], k)):
        tokens, cost, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (tokens + sizes[k], cost + costs[k], g))
    return out


_OUT = pa.schema(
    [
        ("row", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_length", pa.int64()),
        ("step_id", pa.int64()),
    ]
)


def _pack(path: str, tiers: tuple[int, ...], end_id: int, pool_tokens: int, step_tokens: int, cache_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(path, cache_words).encode
        end = end_id.to_bytes(4, "little")
        packer, docs, numbers = Packer(tiers), {}, {"doc": 0, "seq": 0, "step": 0}
        base = TaskContext.get().partitionId() << 33

        def finished(last: bool) -> Iterator[pa.RecordBatch]:
            windows = list(packer.windows())
            if last:
                windows += packer.tail()
            if not windows:
                return
            steps = deal_steps(windows, step_tokens)
            rows: list[tuple] = []
            for window, step in zip(windows, steps, strict=True):
                at, size = 0, sum(n for _, _, n in window)
                for doc, start, n in window:
                    row, ids = docs[doc]
                    rows.append(
                        (row, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, base + numbers["seq"], at, size, base + numbers["step"] + step)
                    )
                    at += n
                numbers["seq"] += 1
            numbers["step"] += 1 + max(steps)
            waiting = {doc for pool in packer.pools for _, doc, _ in pool}
            for doc in [d for d in docs if d not in waiting]:
                del docs[doc]
            for k in range(0, len(rows), 4096):
                cols = zip(*rows[k : k + 4096], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT
                )

        fresh = 0
        for batch in batches:
            for k in range(0, batch.num_rows, GROUP):
                rows, texts = (batch.column(i).slice(k, GROUP).to_pylist() for i in range(2))
                for row, ids in zip(rows, encode([x or "" for x in texts]), strict=True):
                    ids += end
                    docs[numbers["doc"]] = (row, ids)
                    packer.add(numbers["doc"], 0, len(ids) // 4)
                    numbers["doc"] += 1
                    fresh += len(ids) // 4
                if fresh >= pool_tokens:
                    yield from finished(False)
                    fresh = 0
        yield from finished(True)

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    pool_tokens: int = POOL_TOKENS,
    step_tokens: int = STEP_TOKENS,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """A row per piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset,
    sequence_length, step_id."""
    no_clash(id_col, tuple(_OUT.names[1:]))
    run = _pack(tokenizer_file or default_tokenizer(), tiers, end_id, pool_tokens, step_tokens, cache_words)
    kind = "row bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, step_id bigint"
    packed = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, kind)
    return packed.withColumnRenamed("row", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "step_id",
    )


def packing_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pieces with their ids, for the end of a pipeline."""
    ship(spark)
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))
