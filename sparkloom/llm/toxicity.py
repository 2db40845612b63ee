"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A text becomes a few rates: densities of lexicon words (a fixed seed list, and words and word beginnings
learned from the labelled rows), lexicon words near a second-person pronoun, capitals, punctuation, and obfuscated
spellings, which are undone before the lexicon is asked.  Small boosted trees over binned features are fitted on
the driver from at most ``max_train_rows`` labelled rows, chosen by a hash of their id.  Scores out of fold, for
which the lexicon too is learned without the fold, calibrate them by isotonic regression; equal texts share a
fold.  Scoring is one Arrow pass over all rows without any shuffle; the model is a few kilobytes.

Edge cases: null text counts as empty and gets a score like any other; without labelled rows, or with labels of
one class only, the score is the share of seed words in the text, squeezed to [0, 1]; repeated rows score
alike; a label that is null is not learned from, nor is an id with conflicting labels; of rows that repeat a
labelled id the one with the least text is learned from, once; a very long text is read whole; an empty table
gives an empty result; a column of the input called like the result column is replaced by it, others are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, ship, stored, table
from sparkloom.llm.trees import Boosted, fit_boosted, isotonic

MAX_TRAIN_ROWS = 20_000
MAX_LEARNED_WORDS = 400
FOLDS = 5
STEMS = (5, 6, 7)
#: Least log-likelihood ratio (twice its log) of a learned word; about five standard deviations.
MIN_EVIDENCE = 25
THRESHOLD = 0.3
NEAR = 3
MEMO_WORDS = 50_000

#: Seed lexicon: insults and threats in English, French, German and Spanish.
LEXICON = frozenset(
    (
        "idiot idiots moron morons stupid dumb dumbass loser losers pathetic worthless trash garbage scum vermin "
        "disgusting filthy ugly clown fool imbecile retard bastard bitch whore slut asshole shit fuck fucking cunt "
        "crap hate kill murder rape destroy "
        "idiote connard connasse salope putain merde débile crétin abruti ordure enculé pute "
        "idioten dumm dummkopf arschloch scheiße hure schlampe fotze wichser abschaum miststück "
        "idiota estúpido estúpida imbécil mierda puta puto cabrón pendejo basura asqueroso maldito gilipollas"
    ).split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu toi te ton ta tes vous votre du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Runs of letters and signs that stand for letters, from their first letter or sign on.
_ODD = re.compile(r"(?<![^\W_])(?:[0-9@$!|+*#%&]++[^\W\d_]|[^\W\d_]++[0-9@$!|+*#%&])[\w@$!|+*#%&]*+")
_SIGNS = frozenset("0123456789@$!|+*#%&")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*][^\W\d_]){2,}(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
_PLAIN = str.maketrans("013457@$!|+", "oleastasiit")
FEATURES = (
    "seed_density",
    "seed_hits",
    "seed_kinds",
    "learned_density",
    "learned_hits",
    "learned_kinds",
    "stem_density",
    "stem_kinds",
    "near_second_person",
    "second_person",
    "capitals",
    "punctuation",
    "shouting",
    "obfuscated",
    "masked_hits",
    "stretched",
)
_SEED, _SECOND = 1, 2
_BY_SHAPE: dict[tuple[int, str], list[str]] = {}
for _w in sorted(LEXICON):
    _BY_SHAPE.setdefault((len(_w), _w[0]), []).append(_w)


def unmask(word: str) -> str | None:
    """The seed word that an odd spelling stands for, or None: signs for letters, stars for any letter."""
    bare = word.rstrip("!")
    core = bare if bare.translate(_PLAIN).isalpha() else bare.strip("0123456789@$!|+*#%&")
    for form in (word.translate(_PLAIN), bare.translate(_PLAIN), core.translate(_PLAIN), core):
        if form in LEXICON:
            return form
    if "*" in core or "#" in core or "%" in core or "&" in core:
        letters = [None if c in "*#%&" else c.translate(_PLAIN) for c in core]
        if len(core) >= 4 and sum(c is not None for c in letters) * 2 >= len(core):
            for w in _BY_SHAPE.get((len(core), core[0]), ()):
                if all(c is None or c == x for c, x in zip(letters, w, strict=True)):
                    return w
    return None


def _odd_spellings(lower: str) -> tuple[int, int]:
    """How many spellings are odd, and how many of them stand for seed words."""
    odd = masked = 0
    if not _SIGNS.isdisjoint(lower):
        for w in _ODD.findall(lower):
            if w.rstrip("!").isalpha():
                continue
            odd += 1
            masked += unmask(w) is not None
    for m in _SPACED.finditer(lower):
        odd += 1
        masked += re.sub(r"[ .\-_*]", "", m[0]) in LEXICON
    return odd, masked


class Lexicons:
    """Learned words and word beginnings (written ``abcde*``) of one or several versions; small and picklable."""

    def __init__(self, versions: list[frozenset[str]]):
        self.versions = versions
        self.words: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        for v, found in enumerate(versions):
            for w in found:
                where, key = (self.stems, w[:-1]) if w.endswith("*") else (self.words, w)
                where[key] = where.get(key, 0) | 1 << v
        self.memo: dict[str, tuple[int, int, int] | None] = {}

    def __getstate__(self):
        return self.versions

    def __setstate__(self, versions):
        self.__init__(versions)

    def kind(self, word: str) -> tuple[int, int, int] | None:
        """(seed or second person, versions that hold the word, versions that hold a beginning of it); None for most words."""
        try:
            return self.memo[word]
        except KeyError:
            pass
        own = _SEED * (word in LEXICON) | _SECOND * (word in SECOND_PERSON)
        begins = 0
        if self.stems:
            for k in STEMS:
                if len(word) >= k:
                    begins |= self.stems.get(word[:k], 0)
        found = (own, self.words.get(word, 0), begins)
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        self.memo[word] = result = found if any(found) else None
        return result


def features(text: str, lexicons: Lexicons) -> list[tuple[float, ...]]:
    """The values named in ``FEATURES``, for each version of the learned words."""
    if not text:
        return [(0.0,) * len(FEATURES)] * len(lexicons.versions)
    lower = text.lower()
    words = _WORD.findall(lower)
    n, size = len(words), len(text)
    kind = lexicons.kind
    met = [(i, k) for i, k in enumerate(map(kind, words)) if k is not None]
    seed = [i for i, k in met if k[0] & _SEED]
    second = [i for i, k in met if k[0] & _SECOND]
    places = set(second)
    odd, masked = _odd_spellings(lower)
    stretched = 0
    if any(c * 3 in lower for c in set(lower) if c.isalpha()):
        for w in words:
            if _STRETCHED.search(w):
                stretched += 1
                masked += _STRETCHED.sub(r"\1", w) in LEXICON or _STRETCHED.sub(r"\1\1", w) in LEXICON
    capitals = len(_CAPITAL.findall(text))
    marks = text.count("!") + text.count("?")
    per = 1000.0 / max(n, 1)
    seed_part = (len(seed) * per, float(len(seed)), float(len({words[i] for i in seed})))
    rest = (
        len(second) * per,
        capitals / size,
        marks / size,
        float(text.count("!!")) * per,
        odd * per,
        float(masked),
        stretched * per,
    )
    out = []
    for v in range(len(lexicons.versions)):
        bit = 1 << v
        extra = [i for i, k in met if k[1] & bit]
        stems = [i for i, k in met if k[2] & bit]
        near = 0
        if places:
            hits = {*seed, *extra, *stems}
            near = sum(any(j in places for j in range(i - NEAR, i + NEAR + 1) if j != i) for i in hits)
        out.append(
            (
                *seed_part,
                len(extra) * per,
                float(len(extra)),
                float(len({words[i] for i in extra})),
                len(stems) * per,
                float(len({words[i] for i in stems})),
                near * per,
                *rest,
            )
        )
    return out


def _matrix(column: pa.Array, lexicons: Lexicons) -> np.ndarray:
    """Rows of all versions' features, side by side."""
    width = len(FEATURES) * len(lexicons.versions)
    rows = [sum(features(x or "", lexicons), ()) for k in range(0, len(column), 512) for x in column.slice(k, 512).to_pylist()]
    return np.array(rows, dtype=np.float64).reshape(len(rows), width)


def _features_udf(lexicons: Lexicons):
    def run(column: pa.Array) -> pa.Array:
        return pa.array(list(_matrix(column, lexicons)), pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


class Model:
    """Learned words, trees and calibration; small and picklable."""

    def __init__(self, learned: frozenset[str], trees: Boosted | None, steps: tuple[np.ndarray, np.ndarray] | None):
        self.learned, self.trees, self.steps = Lexicons([learned]), trees, steps

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.clip(x[:, 0] / 50, 0, 1)
        return np.clip(np.interp(self.trees.predict(x), *self.steps), 0, 1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(k, text, y) of at most ``limit`` labelled rows outside the held-out remainder, least hashes of the id first.

    An id with conflicting labels is left out; of rows that repeat an id the one with the least text stands for it."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held))
        .groupBy(F.col("doc_id").alias("k"))
        .agg(F.min(F.col(label).cast("double")).alias("y"), F.max(F.col(label).cast("double")).alias("most"))
        .where("y = most")
        .select("k", "y")
        .orderBy(F.xxhash64("k"), "k")
        .limit(limit)
    )
    met = docs.select(F.col(f"`{id_col}`").alias("k"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "k"
    )
    return met.groupBy("k", "y").agg(F.min("text").alias("text"))


def _begins(word: Column) -> Column:
    return F.array(*(F.when(F.length(word) >= k, F.concat(F.substring(word, 1, k), F.lit("*"))) for k in STEMS))


def _learn_words(rows: DataFrame, limit: int) -> list[frozenset[str]]:
    """Words that are far more frequent in the toxic training rows, each text counting once: learned without each
    fold (column fold) in turn, then from all rows.  One count of words by fold serves all."""
    texts = rows.dropDuplicates(["text"])
    sizes = {r["fold"]: (float(r["toxic"]), float(r["n"])) for r in texts.groupBy("fold").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).collect()}
    all_toxic, all_n = (sum(x[i] for x in sizes.values()) for i in range(2))
    letters = F.split(F.lower("text"), r"[^\p{L}]+")
    words = F.filter(letters, lambda w: F.length(w) > 2)
    begins = F.filter(F.flatten(F.transform(letters, _begins)), lambda w: w.isNotNull())
    each = texts.select("y", "fold", F.explode(F.array_distinct(F.concat(words, begins))).alias("word"))
    in_fold = [F.col("fold") == k for k in range(FOLDS)]
    counts = each.groupBy("word").agg(
        F.sum("y").alias("t"), F.count("*").alias("c"),
        *(F.sum(F.when(f, F.col("y")).otherwise(0.0)).alias(f"t{k}") for k, f in enumerate(in_fold)),
        *(F.count_if(f).alias(f"c{k}") for k, f in enumerate(in_fold)),
    )
    versions = []
    for k in range(FOLDS + 1):
        toxic, n = (all_toxic, all_n) if k == FOLDS else (all_toxic - sizes.get(k, (0, 0))[0], all_n - sizes.get(k, (0, 0))[1])
        if not 0 < toxic < n:
            continue
        t, c = (F.col("t"), F.col("c")) if k == FOLDS else (F.col("t") - F.col(f"t{k}"), F.col("c") - F.col(f"c{k}"))
        gain = F.log((t + 0.5) / (toxic + 1)) - F.log((c - t + 0.5) / (n - toxic + 1))
        share = F.lit(toxic / n)
        evidence = 2 * t * F.log(t / (share * c)) + 2 * (c - t) * F.log(F.greatest(c - t, F.lit(1e-9)) / ((1 - share) * c))
        strong = F.when(F.col("word").endswith("*"), gain > 1.6).otherwise(gain > 2.5)
        fits = (t >= max(4.0, 0.02 * toxic)) & (evidence > MIN_EVIDENCE) & strong
        versions.append(F.when(fits, F.struct(F.lit(k).alias("version"), (t * gain).alias("worth"))))
    if not versions:
        return [frozenset()] * (FOLDS + 1)
    found = counts.where(F.col("t") >= 4).select("word", F.explode(F.filter(F.array(*versions), lambda v: v.isNotNull())).alias("v")).select("word", "v.*")
    order = Window.partitionBy("version").orderBy(F.desc("worth"), "word")  # what passed the tests is a small table
    best = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).collect()
    return [frozenset(r["word"] for r in best if r["version"] == k) for k in range(FOLDS + 1)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS, modulus: int = 4, held: int = 2) -> Model:
    """Learn from labelled rows whose crc32(id) mod ``modulus`` is not ``held``."""
    rows = training_rows(docs, labels, "toxic", modulus, held, id_col, text_col, max_train_rows)
    rows = stored(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "toxicity-train")
    versions = _learn_words(rows, MAX_LEARNED_WORDS)
    got = rows.select("k", "y", "fold", _features_udf(Lexicons(versions))("text").alias("x")).collect()
    got.sort(key=lambda r: r["k"])
    y = np.array([r["y"] for r in got], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(versions[-1], None, None)
    wide = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(y), FOLDS + 1, len(FEATURES))
    fold = np.array([r["fold"] for r in got])
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        inside, x = fold != k, wide[:, k]
        if inside.all():
            continue
        if not inside.any() or y[inside].min() == y[inside].max():
            raw[~inside] = 0
        else:
            raw[~inside] = fit_boosted(x[inside], y[inside]).predict(x[~inside])
    return Model(versions[-1], fit_boosted(wide[:, FOLDS], y), isotonic(raw, y))


def score_column(model: Model, text_col: str) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(column, model.learned)), pa.float64())

    return F.arrow_udf(run, "double")(F.col(f"`{text_col}`").cast("string"))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the column toxicity, a calibrated probability."""
    return docs.withColumn("toxicity", score_column(model, text_col))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns only."""
    ship(docs.sparkSession)
    model = fit(docs, labels, text_col=text_col)
    return docs.where(score_column(model, text_col) < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model).withColumnRenamed("toxicity", "score")
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
