"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A rank file maps byte strings to ranks; a token's id is its rank.  Texts are split by a pattern, and BPE acts
on each distinct word alone, so many words are encoded together: an inverted index leads from a pair of tokens to
all places in all words where the pair stands.  Merges are replayed in rank order, the least one first, and a
merge touches only the two neighbours of its place.  The order inside a word is that of encoding the word by
itself: the least rank, then the leftmost place.

Words are first counted over the corpus.  The ``corpus_words`` most frequent ones that occur more than once are
replayed once, for all texts, and their ids travel to every worker.  The rest, mostly words that occur once, is
replayed where it stands, all new words of a group of texts together; a worker keeps the ids of at most
``cache_words`` of them.  Texts never move: the only shuffle is that of the word counts, which are added up within
each task before.

Ids are packed as little-endian unsigned 32-bit integers.  Edge cases: null text counts as empty and has no
ids; repeated rows are encoded alike; a very long text is encoded whole, in memory that grows with its length;
an empty table gives an empty result; strings of special tokens are ordinary text; ids that are not in the rank
file fail in decoding; other columns are not read; an identifier column called like a result column is refused
with a ValueError.
"""

from __future__ import annotations

import base64
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import no_clash, table

CORPUS_WORDS = 150_000
CACHE_WORDS = 100_000
COUNTED_WORDS = 200_000
#: Longer words are replayed where they stand, so that the words that travel have a bounded size.
MOST_WORD_CHARS = 64
CACHE_PAIRS = 200_000
GROUP_ROWS = 2048
DECODE_ROWS = 512
GROUP_CHARS = 2_000_000
_NONE = 1 << 40
_FEW = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Codec:
    """Encodes lists of texts and decodes packed ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS):
        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.vocabulary = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        first = np.full((256, 256), _NONE, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                first[token[0], token[1]] = rank
        self.first = first
        self.pairs: dict[int, int] = {}
        #: ids of words of the whole corpus, which stay, and of others, which are forgotten when they are too many
        self.known: dict[str, bytes] = {}
        self.learned: list[str] = []
        self.most = cache_words

    def seed(self, words: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(x) if x else [] for x in texts]
        known = self.known
        fresh = set().union(*split).difference(known)
        if fresh:
            if len(self.learned) + len(fresh) > self.most:
                for w in self.learned:
                    del known[w]
                self.learned = []
                fresh = set().union(*split).difference(known)
            new = list(fresh)
            self._learn(new)
            self.learned += new
        return [b"".join([known[w] for w in words]) for words in split]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of these distinct words; nothing is remembered."""
        raw = [w.encode() for w in words]
        whole = [self.ranks.get(r) for r in raw]
        rest = iter(self.replay([r for r, i in zip(raw, whole, strict=True) if i is None]) if None in whole else ())
        return [next(rest) if i is None else i.to_bytes(4, "little") for i in whole]

    def decode(self, ids: bytes) -> bytes:
        vocabulary = self.vocabulary
        return b"".join([vocabulary[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def _learn(self, words: list[str]) -> None:
        self.known.update(zip(words, self.encode_words(words), strict=True))

    def _rank_of(self, a: int, b: int) -> int:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.ranks.get(self.vocabulary[a] + self.vocabulary[b], _NONE)
        return found

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of the words (none empty), all merged together."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(flat)
        ends = np.cumsum([len(w) for w in words])
        starts = [0, *ends[:-1].tolist()]
        token = self.byte_ids[flat]
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[starts] = -1
        gone = np.zeros(n, dtype=np.uint8)
        # inverted index: pair of tokens -> places of its left tokens, as numbers or arrays of them
        pair_at = flat[:-1].astype(np.int64) << 8 | flat[1:]
        rank_at = self.first.reshape(-1)[pair_at]
        inside = np.ones(n, dtype=bool)
        inside[ends - 1] = False
        at = np.flatnonzero((rank_at < _NONE) & inside[:-1])
        at = at[np.argsort(pair_at[at], kind="stable")]
        kinds, cuts = np.unique(pair_at[at], return_index=True)
        index: dict[int, list] = {}
        pairs_of: dict[int, list[int]] = {}  # rank -> pairs that stand in the index
        byte_ids = self.byte_ids.tolist()
        for kind, part in zip(kinds.tolist(), np.split(at, cuts[1:]), strict=False):
            pair = byte_ids[kind >> 8] << 32 | byte_ids[kind & 255]
            index[pair] = [part]
            pairs_of.setdefault(int(rank_at[part[0]]), []).append(pair)
        heap = sorted(pairs_of)
        rank_of = self._rank_of

        def file(pair: int, rank: int, places) -> None:
            if pair in index:
                index[pair].append(places)
                return
            index[pair] = [places]
            if rank in pairs_of:
                pairs_of[rank].append(pair)
            else:
                pairs_of[rank] = [pair]
                heappush(heap, rank)

        while heap:
            rank = heappop(heap)
            found = [places for pair in pairs_of.pop(rank) for places in index.pop(pair)]
            arrays = [x for x in found if not isinstance(x, int)]
            places = [x for x in found if isinstance(x, int)]
            if len(places) + sum(map(len, arrays)) < _FEW:
                for x in arrays:
                    places += x.tolist()
                places.sort()
                self._merge_each(rank, places, token, after, before, gone, ends, starts, file)
                continue
            at = np.unique(np.concatenate([*arrays, np.array(places, dtype=np.int64)]))
            at = at[(gone[at] == 0) & (after[at] >= 0)]
            left, right = token[at], token[after[at]]
            codes, which = np.unique(left << 32 | right, return_inverse=True)
            good = np.array([rank_of(c >> 32, c & 0xFFFFFFFF) == rank for c in codes.tolist()], dtype=bool)
            at = at[good[which]] if len(at) else at
            if not len(at):
                continue
            alone = int(good.sum()) == 1 and int(token[at[0]]) != int(token[after[at[0]]]) and rank_of(rank, rank) > rank
            if not (alone and self._merge_all(rank, at, token, after, before, gone, file)):
                self._merge_each(rank, at.tolist(), token, after, before, gone, ends, starts, file)
        stay = gone == 0
        packed = token[stay].astype("<u4").tobytes()
        upto = (4 * np.cumsum(stay)[ends - 1]).tolist()
        return [packed[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def _merge_all(self, rank, at, token, after, before, gone, file) -> bool:
        """Merge at all the places, which can't overlap; False, with nothing done, if a lower rank would arise."""
        rank_of = self._rank_of
        follow = after[after[at]]
        lead = before[at]
        followed, led = follow >= 0, lead >= 0
        for t in np.unique(token[follow[followed]]).tolist():
            if rank_of(rank, t) < rank:
                return False
        for t in np.unique(token[lead[led]]).tolist():
            if rank_of(t, rank) < rank:
                return False
        gone[after[at]] = 1
        token[at] = rank
        after[at] = follow
        before[follow[followed]] = at[followed]
        for side, places in ((True, at[followed]), (False, lead[led])):
            if not len(places):
                continue
            other = token[after[places]] if side else token[places]
            order = np.argsort(other, kind="stable")
            kinds, cuts = np.unique(other[order], return_index=True)
            for t, part in zip(kinds.tolist(), np.split(places[order], cuts[1:]), strict=True):
                pair = rank << 32 | t if side else t << 32 | rank
                r = rank_of(pair >> 32, pair & 0xFFFFFFFF)
                if r < _NONE:
                    file(pair, r, part)
        return True

    def _merge_each(self, rank, places, token, after, before, gone, ends, starts, file) -> None:
        """Merge place by place, from the left; a word that gets a pair of lower rank lets its other places wait."""
        token, after, before, gone = map(memoryview, (token, after, before, gone))
        rank_of = self._rank_of
        held_until = -1
        for i in places:
            if gone[i]:
                continue
            j = after[i]
            if j < 0 or rank_of(token[i], token[j]) != rank:
                continue
            if i < held_until:
                file(token[i] << 32 | token[j], rank, i)
                continue
            token[i] = rank
            gone[j] = 1
            k = after[i] = after[j]
            lower = False
            if k >= 0:
                before[k] = i
                r = rank_of(rank, token[k])
                if r < _NONE:
                    lower = r < rank
                    file(rank << 32 | token[k], r, i)
            h = before[i]
            if h >= 0:
                r = rank_of(token[h], rank)
                if r < _NONE:
                    lower = lower or r < rank
                    file(token[h] << 32 | rank, r, h)
            if lower:
                held_until = int(ends[bisect_right(starts, i) - 1])


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, cache_words: int = CACHE_WORDS, seeds: tuple[str, list[str], list[bytes]] | None = None) -> Codec:
    """One per worker process and rank file, and per table of words that it starts with."""
    key = (path, pattern, cache_words, seeds and seeds[0])
    if key not in _CODECS:
        if len(_CODECS) > 3:  # of earlier queries of a reused worker
            _CODECS.clear()
        _CODECS[key] = made = Codec(read_ranks(path), pattern, cache_words)
        if seeds:
            made.seed(seeds[1], seeds[2])
    return _CODECS[key]


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a bounded number of rows and, but for a single longer text, of characters."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
    begin = held = 0
    for k, size in enumerate(sizes):
        if k > begin and (held + size > GROUP_CHARS or k - begin >= GROUP_ROWS):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def _count_words(path: str, pattern: str):
    """Over texts: (word, n), added up within the task as long as they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        held: Counter = Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(k, 64).to_pylist():
                    if text:
                        held.update(find(text))
                if len(held) > COUNTED_WORDS:
                    yield from emit()
        yield from emit()

    return run


def corpus_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text", corpus_words: int = CORPUS_WORDS) -> DataFrame:
    """``(word, ids)`` of the most frequent words of the corpus, at most ``corpus_words``, each replayed once."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text != ''")
    counted = texts.mapInArrow(_count_words(path, pattern), "word string, n bigint").where(F.length("word") <= MOST_WORD_CHARS)
    often = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(corpus_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(use.encode_words(words), pa.binary())], names=["word", "ids"])

    return often.select("word").repartition(F.col("word")).mapInArrow(run, "word string, ids binary")


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache_words: int = CACHE_WORDS,
    corpus_words: int = CORPUS_WORDS,
    decoded: bool = False,
) -> DataFrame:
    """``(id_col, ids)`` per row, and with ``decoded`` the bytes that the ids stand for; the id keeps its type."""
    no_clash(id_col, ("ids", "decoded"))
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # at most corpus_words words of bounded length
    found = corpus_table(docs, path, pattern, text_col, corpus_words).toArrow() if corpus_words else None
    seeds = context.broadcast((uuid.uuid4().hex, found.column(0).to_pylist(), found.column(1).to_pylist()) if found else None)
    names = [id_col, "ids", "decoded"] if decoded else [id_col, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern, cache_words, seeds.value)
        for batch in batches:
            for part in _groups(batch):
                ids = use.encode(part.column(1).to_pylist())
                for k in range(0, len(ids), DECODE_ROWS):
                    some = ids[k : k + DECODE_ROWS]
                    columns = [part.column(0).slice(k, DECODE_ROWS), pa.array(some, pa.binary())]
                    if decoded:
                        columns.append(pa.array(map(use.decode, some), pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids binary" + (", decoded binary" if decoded else ""))


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that packed ids stand for."""

    def run(column: pa.Array) -> pa.Array:
        use = codec(path, pattern)
        parts = [
            pa.array([use.decode(x or b"") for x in column.slice(k, DECODE_ROWS).to_pylist()], pa.binary())
            for k in range(0, len(column), DECODE_ROWS)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return F.arrow_udf(run, "binary")(ids)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path, pattern, decoded=True).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
