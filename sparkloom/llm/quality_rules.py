"""Quality rules under weak supervision.

Every rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0).  Nobody tells how
reliable a rule is: expectation-maximisation over the vote patterns of all documents estimates, for a hidden
good/bad state, how each rule votes in either state, and a document is kept when its posterior probability of
being good reaches ``threshold``.  A text that fails the base test (``min_words``, or over half of its words
inside repeated three-word windows) is never kept.

Plan: one Arrow pass turns texts into counts, which are written once, since they are read twice; votes are column
expressions; documents are pre-aggregated to vote patterns, of which there are at most 3^(number of rules), so
only those counts reach the driver.  The posterior is again a column expression.  Nothing is shuffled but the
pattern counts.

Edge cases: null text counts as empty; an empty text has no words and fails the base test; an empty table
gives an empty result; repeated rows are judged alike; a very long text is counted whole, in memory that grows
with its number of words; columns of the input that share a name with a result column are replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import stored, table, utf8_list
from sparkloom.llm.text_stats import FIELDS, text_stats

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
PRIOR_SHARE = 0.1

_STRUCT = pa.struct([(name, pa.int64()) for name in FIELDS])


def _stats(column: pa.Array) -> pa.Array:
    rows = [text_stats(x) for x in utf8_list(column)]
    cols = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(_STRUCT))


def stats_column(text_col: str) -> Column:
    """The counts of a text as one struct column."""
    kind = ", ".join(f"{name}: bigint" for name in FIELDS)
    return F.arrow_udf(_stats, f"struct<{kind}>")(F.col(text_col).cast("string"))


def _share(s: str, part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(f"{s}.{part}"), F.col(f"{s}.{whole}")), F.lit(0.0))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def rules(s: str) -> dict[str, Column]:
    """Votes over the struct column ``s``."""
    length = _share(s, "word_chars", "n_words")
    symbols, shout = _share(s, "n_symbols", "n_words"), _share(s, "n_shout", "n_words")
    dup, repeat = _share(s, "n_dup_lines", "n_lines"), _share(s, "n_repeat_words", "n_words")
    caps, func = _share(s, "n_upper", "n_letters"), _share(s, "n_function", "n_words")
    top, ended = _share(s, "n_top", "n_words"), _share(s, "n_ended", "n_lines")
    never = F.lit(False)
    return {
        "word_length": _vote(length.between(3.5, 7.5), (length < 2.5) | (length > 12)),
        "symbols": _vote(never, symbols > 0.1),
        "shouting": _vote(never, (caps > 0.25) | (shout > 0.05)),
        "duplicate_lines": _vote(never, dup > 0.4),
        "repetition": _vote(repeat < 0.1, repeat > 0.3),
        "function_words": _vote(func > 0.1, func < 0.05),
        "one_word": _vote(never, top > 0.25),
        "sentences": _vote(ended > 0.8, ended < 0.3),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM over vote patterns: (share of good documents, P(vote | state) as [rule, state, vote + 1]).

    The prior, weighing ``PRIOR_SHARE`` of the documents, says that rules are right more often than wrong; as
    it is a share, the estimate behaves alike at every size, and the two states can't swap.
    """
    n_rules = patterns.shape[1]
    prior = np.tile(np.array([[0.45, 0.45, 0.10], [0.02, 0.38, 0.60]]), (n_rules, 1, 1))
    total = float(counts.sum())
    like, good = prior.copy(), 0.7
    weight = PRIOR_SHARE * max(total, 1.0)
    for _ in range(rounds if total else 0):
        log = np.log(like[np.arange(n_rules)[:, None], :, (patterns + 1).T]).sum(0)  # pattern x state
        odds = np.clip(log[:, 1] - log[:, 0] + math.log(good / (1 - good)), -60, 60)
        post = 1 / (1 + np.exp(-odds))
        state = np.stack([counts * (1 - post), counts * post])
        fresh = weight * prior
        for v in range(3):
            fresh[:, :, v] += ((patterns + 1 == v)[:, :, None] * state.T[:, None, :]).sum(0)
        fresh /= fresh.sum(2, keepdims=True)
        new_good = float((state[1].sum() + 0.7 * weight) / (total + weight))
        done = max(np.abs(fresh - like).max(), abs(new_good - good)) < 1e-9
        like, good = fresh, new_good
        if done:
            break
    return good, like


def fit(counted: DataFrame, s: str = "stats") -> tuple[float, dict[str, tuple[float, float, float]]]:
    """Log odds of the good state and, per rule, the log-likelihood ratio of a vote of -1, 0 and 1."""
    names = list(rules(s))
    rows = counted.select(*(v.alias(k) for k, v in rules(s).items())).groupBy(*names).count().collect()
    patterns = np.array([[r[k] for k in names] for r in rows], dtype=np.int64).reshape(len(rows), len(names))
    good, like = estimate(patterns, np.array([r["count"] for r in rows], dtype=float))
    ratio = np.log(like[:, 1, :] / like[:, 0, :])
    return math.log(good / (1 - good)), {k: tuple(map(float, ratio[i])) for i, k in enumerate(names)}


def verdicts(
    counted: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT
) -> DataFrame:
    """``counted``, a stored table with the struct column stats, with base_failed, quality_posterior and kept."""
    bias, weights = fit(counted)
    logit = F.lit(bias)
    for name, vote in rules("stats").items():
        bad, none, good = weights[name]
        logit = logit + F.when(vote == 1, good).when(vote == 0, none).otherwise(bad)
    n, repeat = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    return (
        counted.withColumn("base_failed", (n < min_words) | (100 * repeat > max_repeat_percent * n))
        .withColumn("quality_posterior", 1 / (1 + F.exp(-logit)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_posterior") >= threshold))
    )


def judge(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the columns stats, base_failed, quality_posterior and kept."""
    return verdicts(stored(docs.withColumn("stats", stats_column(text_col)), "quality-counts"), **options)


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    renamed = docs.toDF(*inner)
    judged = judge(renamed, inner[names.index(text_col)], **options)
    return judged.where("kept").select(*inner).toDF(*names)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = stored(docs.select("doc_id", stats_column("text").alias("stats")), "quality-counts")
    return verdicts(counted).select(
        "doc_id",
        *(F.col(f"stats.{k}").alias(k) for k in FIELDS[:5]),
        "base_failed",
        "kept",
        "quality_posterior",
    )
