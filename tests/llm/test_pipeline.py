"""The pipeline against the same decisions taken one document at a time."""

import zlib

import corpus_pipeline
from conftest import SF
from pyspark.sql import functions as F
from test_edge_cases import slow_verdicts
from test_text_operators import slow_fingerprint, slow_groups

from sparkloom.llm import exact_dedup, simhash, toxicity
from sparkloom.llm.common import stored


def slow_toxic(model, text):
    """The model's score, tree by tree."""
    x = toxicity.features(text or "", model.learned)[0]
    if model.trees is None:
        return min(max(x[0] / 50, 0), 1)
    total = model.trees.base
    for feature, cut, leaf in model.trees.trees:
        node = 0
        while node < len(feature):
            at = sum(c <= x[feature[node]] for c in model.trees.cuts[feature[node]])
            node = 2 * node + (2 if at > cut[node] else 1)
        total += leaf[node - len(feature)]
    xs, ys = model.steps
    k = sum(v <= total for v in xs)
    if k in (0, len(xs)):
        return ys[0] if k == 0 else ys[-1]
    return ys[k - 1] + (ys[k] - ys[k - 1]) * (total - xs[k - 1]) / (xs[k] - xs[k - 1])


def run_by_hand(spark, docs):
    """Each stage against brute force over what the one before it left; returns what the fourth one leaves."""
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    rows = docs.collect()
    good = stored(corpus_pipeline.quality_stage(spark, docs, SF), "t1")
    want = [key(r) for r, (_, _, kept) in zip(rows, slow_verdicts([r.text for r in rows]), strict=True) if kept]
    assert good.columns == columns and sorted(map(key, good.collect())) == sorted(want) and 0 < len(want) < len(rows)
    mild = stored(corpus_pipeline.toxicity_stage(spark, good, SF), "t2")
    model = toxicity.fit(good, labels)
    assert mild.columns == columns and sorted(map(key, mild.collect())) == sorted(key(r) for r in good.collect() if slow_toxic(model, r.text) < 0.3)
    once = stored(corpus_pipeline.exact_dedup_stage(spark, mild, SF), "t3")
    last = {}
    for r in mild.collect():
        last[r.text or ""] = max(key(r), last.get(r.text or "", (False, 0, "")))
    assert once.columns == columns and sorted(map(key, once.collect())) == sorted(last.values())
    apart = stored(corpus_pipeline.near_dedup_stage(spark, once, SF), "t4")
    left = sorted(once.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    groups = slow_groups([slow_fingerprint(r.text) for r in left])
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == sorted(left[g].doc_id for g in set(groups))
    return apart


def test_stages_work_on_what_is_left(spark):
    apart = run_by_hand(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in apart.collect()}
    for r in packed:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "exact_dedup", "near_dedup", "packing"]


def test_stages_take_nulls_repeated_rows_and_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, "")], "doc_id bigint, text string")
    for name in docs.columns:
        if name not in odd.columns:
            odd = odd.withColumn(name, F.lit(None).cast(docs.schema[name].dataType))
    both = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(odd.select(*docs.columns))
    for name in ("stats", "kept", "toxicity", "digest", "fp", "place", "c0", "length"):
        both = both.withColumn(name, F.lit(name))
    apart = run_by_hand(spark, stored(both, "odd-docs"))
    ids = [r.doc_id for r in apart.collect()]
    assert len(ids) == len(set(ids)) and -1 not in ids
    packed = corpus_pipeline.packing_stage(spark, apart, SF)
    assert {r.doc_id for r in packed.collect()} == set(ids)


def test_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none_left = stage(spark, none, SF)
        assert none_left.count() == 0
    assert exact_dedup.keep_one(none).count() == simhash.keep_one(none).count() == 0
