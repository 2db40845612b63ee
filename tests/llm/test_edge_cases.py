"""Repeated ids, foreign archives, long texts, long rule lists, clashing names; and models against slow scoring."""

import bisect
import gzip
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat_format, common, exact_dedup, packing, quality_gam, quality_rules, simhash, text_stats, toxicity, url_filter, warc
from sparkloom.llm.common import scratch, stored

LARGE = "/root/testdata/sf0.1"
P = pytest.importorskip("public_tokenizers")


# --- helpers


def test_membership_finds_all_members_and_few_others(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("k"), F.col("id")).alias("key"))
    bits, n_bits = common.bits_of(rows.where("id % 10 = 0"), "key")
    got = common.flagged(rows, F.col("key"), bits, n_bits, "met")
    assert got.where("met and id % 10 = 0").count() == 2000 and got.where("met and id % 10 != 0").count() < 2000
    none, n_bits = common.bits_of(rows.limit(0), "key")
    assert common.flagged(rows, F.col("key"), none, n_bits, "met").where("met").count() == 0


def test_join_with_hot_keys_keeps_every_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = stored(rows.where("k != 2999").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")), "keyed")
    got = common.join_hot(rows, keyed, "k", "n", parts=10)
    assert got.count() == 3000 and got.where("k = 0 and n = 1000 and least = 0").count() == 1000
    assert got.where("least is null").collect()[0].id == 2999


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "start bigint, text string")
    for call in (
        lambda: packing.pack(df, id_col="start"),
        lambda: exact_dedup.exact_duplicates(df.withColumnRenamed("start", "digest"), id_col="digest"),
        lambda: simhash.near_duplicates(df.withColumnRenamed("start", "fp"), id_col="fp"),
        lambda: bpe.encode(df.withColumnRenamed("start", "ids"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, id_col="ids"),
        lambda: chat_format.format_conversations(df, conv_col="formatted"),
        lambda: url_filter.judge(df.withColumnRenamed("text", "host"), url_col="host"),
    ):
        with pytest.raises(ValueError):
            call()


LONG = ["word " * 400_000, "x" * 1_500_000, "the cat. " * 200_000 + "end", None, ""]


def test_very_long_texts(spark):
    df = spark.createDataFrame(list(enumerate([*LONG, LONG[0]])), "doc_id bigint, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(df).collect()}
    assert (got[0].keep_id, got[0].group_size, got[3].keep_id, got[1].kept) == (5, 2, 4, True)
    kept = {r.doc_id: (r.stats.n_words, r.kept) for r in quality_rules.judge(df).collect()}
    assert kept[0] == (400_000, False) and kept[1] == (1, False) and kept[2][0] == 400_001
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    assert toxicity.score(df, toxicity.fit(df, none)).where("toxicity between 0 and 1").count() == 6
    assert quality_gam.score(df, quality_gam.fit(df, none)).where("quality_score = 0.5").count() == 6
    pages = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), "text").alias("url"), F.col("text").alias("html"))
    assert url_filter.judge(pages).where("verdict = 'allow' and (url is null or rule = 'org/')").count() == 6
    path = scratch(spark, "warc")
    warc.archive_pages(pages, path, max_file_bytes="1000")
    back = {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.read_pages(spark, path).collect()}
    assert back == {0: (2_000_000, None), 1: (1_500_000, None), 2: (1_800_003, None), 3: (0, None), 4: (0, None), 5: (2_000_000, 0)}


# --- dedup


def test_exact_dedup_leaves_one_of_repeated_rows(spark):
    rows = [(3, "a"), (3, "a"), (1, "a"), (None, "b"), (None, "b"), (None, ""), (2, None), (3, "c"), (3, "d"), (3, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("clash")).repartition(3)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(3, "a"), (0, "b"), (2, ""), (3, "c"), (3, "d")])
    weak = lambda t: (F.crc32(t.cast("binary")) % 2).cast("string")
    assert sorted((r.doc_id or 0, r.text or "") for r in exact_dedup.keep_one(df, digest=weak).collect()) == sorted([(3, "a"), (0, "b"), (2, ""), (3, "c"), (3, "d")])
    found = exact_dedup.exact_duplicates(df.drop("digest")).collect()
    assert Counter((r.keep_id, r.group_size) for r in found) == {(3, 3): 3, (None, 2): 2, (2, 2): 2, (3, 1): 1, (3, 2): 2}
    assert sum(r.kept for r in found) == 5


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_goes_on_from_call_to_call(spark, weak):
    options = {"digest": lambda t: (F.crc32(t.cast("binary")) % 2).cast("string")} if weak else {}
    state, seen = scratch(spark, "state"), []
    rng = random.Random(3)
    for call in range(3):
        rows = [(100 * call + i, rng.choice(["a", "b", "c", "d", "", None, f"own{call}{i}"])) for i in range(20)]
        path = scratch(spark, "docs")
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
        docs = spark.read.parquet(path) if call != 1 else spark.createDataFrame(rows, "doc_id bigint, text string")
        seen += rows
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, state_dir=state, **options).collect()}
        assert set(got) == {i for i, _ in rows}
        for i, t in rows:
            same = [j for j, u in seen if (u or "") == (t or "")]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))


def test_near_dedup_leaves_one_of_repeated_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, base), (1, base), (1, base + " x"), (2, base), (5, "other text here at all"), (5, "other text here at all"), (None, None), (None, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == [(1, "w0 w1"), (5, "other"), (7, "")]
    assert {r.component_id for r in simhash.near_duplicates(df.drop("component_id")).collect()} == {1, 5, 7}


# --- WARC archives of others


def _record(kind, payload, uri="http://a/", extra="", eol="\r\n", names=str):
    head = eol.join(["WARC/1.0", f"{names('WARC-Type')}: {kind}", f"{names('WARC-Target-URI')}: {uri}", *([extra] if extra else []), f"{names('Content-Length')}: {len(payload)}"])
    return f"{head}{eol}{eol}".encode() + payload + b"\r\n\r\n"


def test_foreign_archives_lose_nothing(spark, tmp_path):
    a, b, c = (_record("response", x * 3000, f"http://{x.decode()}/") for x in (b"a", b"b", b"c"))
    lower = _record("resource", b"low", "http://low/", "x-note: one\r\nX-Note: two\r\n\tfolded", names=str.lower)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(a + b) + gzip.compress(c) + gzip.compress(b"") + gzip.compress(lower))
    (tmp_path / "two.warc").write_bytes(a + lower + _record("metadata", b"\r\n\r\nWARC/1.0\r\n", eol="\n"))
    (tmp_path / "other.txt").write_bytes(b"no archive")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert Counter((r.record_type, r.target_uri, r.content_length) for r in got) == {
        ("response", "http://a/", 3000): 2, ("response", "http://b/", 3000): 1, ("response", "http://c/", 3000): 1, ("resource", "http://low/", 3): 2, ("metadata", "http://a/", 14): 1,
    }
    assert all(r.headers == {"x-note": "one, two folded"} for r in got if r.record_type == "resource")
    assert all(bytes(r.payload) == r.target_uri[7:8].encode() * 3000 for r in got if r.record_type == "response")
    heads = warc.read_archives(spark, str(tmp_path), ["record_type", "target_uri"])
    assert heads.count() == 7 and heads.where("target_uri = 'http://b/'").count() == 1 and heads.where("record_type = 'resource'").count() == 2
    # beside archives of this writer
    pages = spark.createDataFrame([(1, "u", "x"), (2, "v", None)], "page_id bigint, url string, html string")
    warc.archive_pages(pages, str(tmp_path))
    assert warc.read_archives(spark, str(tmp_path), ["record_type"]).count() == 9
    (tmp_path / f"part-{'0' * 32}.warc.gz").write_bytes(gzip.compress(a))  # of a task that was lost
    assert warc.read_archives(spark, str(tmp_path), ["record_type"]).count() == 9
    warc.archive_pages(pages, str(tmp_path), mode="overwrite")
    assert warc.read_archives(spark, str(tmp_path), ["record_type"]).count() == 2
    assert not (tmp_path / "one.warc.gz").exists() and (tmp_path / "other.txt").exists()


@pytest.mark.parametrize("fault", ["checksum", "length", "cut", "cut headers", "no length", "junk", "junk after", "plain cut"])
def test_broken_archives_are_errors(fault):
    good = _record("response", random.Random(1).randbytes(5000))
    packed = bytearray(gzip.compress(good))
    if fault == "checksum":
        packed[-6] ^= 1
    elif fault == "length":
        packed[-2] ^= 1
    data = {
        "checksum": bytes(packed), "length": bytes(packed), "cut": bytes(packed[:-2000]), "cut headers": gzip.compress(good[:30]),
        "no length": gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"), "junk": gzip.compress(b"hello"), "junk after": gzip.compress(good + b"junk"), "plain cut": good[:-3000],
    }[fault]
    for payloads in (True, False):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(data), lambda named: True, payloads))


# --- long rule lists


@pytest.mark.parametrize("options", [{}, {"inline_rules": 0}, {"inline_rules": 0, "index_bytes": 0}])
def test_long_rule_lists(spark, options):
    rules = tuple(url_filter.host_rule("block" if i % 2 else "allow", f"h{i}.example.com/p{i % 7}/") for i in range(3000))
    rules += (url_filter.host_rule("block", "com/"),)
    urls = [f"http://{'www.' if i % 3 else ''}h{i}.example.com/p{i % 7}/x" for i in range(0, 3000, 50)] + ["http://z.com/"] * 30 + ["http://q.net/", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.page_id: r for r in url_filter.judge(df, rules=rules, **options).collect()}
    assert len(got) == len(urls)
    for k, i in enumerate(range(0, 3000, 50)):
        assert (got[k].rule, got[k].verdict) == (f"h{i}.example.com/p{i % 7}/", "block" if i % 2 else "allow")
    assert {(got[k].rule, got[k].verdict) for k in range(60, 90)} == {("com/", "block")}
    assert got[90].verdict == got[91].verdict == "allow" and got[90].rule is None


# --- byte BPE over a corpus


@pytest.mark.parametrize("corpus_words", [0, 3, 1000])
def test_bpe_words_of_the_corpus_change_nothing(spark, corpus_words):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["zxqv", "Straßenbahn", "alpha", "x" * 100, f"u{rng.randint(0, 99)}"]) for _ in range(50)) for _ in range(40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    own = bpe.Codec(bpe.read_ranks(path), P.PATTERN)
    got = bpe.encode(df, path, P.PATTERN, corpus_words=corpus_words, cache_words=20, decoded=True).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert bytes(r.ids) == own.encode([text])[0] and bytes(r.decoded) == text.encode()
    if corpus_words:
        held = bpe.corpus_table(df, path, P.PATTERN, corpus_words=corpus_words).collect()
        counts = Counter(w for t in texts if t for w in own.words(t) if len(w) <= bpe.MOST_WORD_CHARS)
        often = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], w))[:corpus_words]
        assert {r.word: bytes(r.ids) for r in held} == dict(zip(often, own.encode_words(often), strict=True))


# --- what is learned from


def test_training_rows_are_bounded_and_consistent(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "x"), (3, "y"), (4, "z"), (None, "n")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, None), (4, 0), (9, 1), (None, 1)], "doc_id bigint, toxic int")
    got = {r.k: (r.text, r.y) for r in toxicity.training_rows(docs, labels, "toxic", 1, 5, "doc_id", "text", 100).collect()}
    assert got == {1: ("", 1.0), 4: ("z", 0.0)}
    assert toxicity.training_rows(docs, labels, "toxic", 1, 5, "doc_id", "text", 1).count() <= 1


# --- models against slow scoring


def _auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality_scores_are_sums_of_table_entries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_gam.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.tables and model.pairs
    got = {r.doc_id: r.quality_score for r in quality_gam.score(docs, model).collect()}
    for r in docs.collect():
        x = quality_gam.features(np.array([text_stats.text_stats((r.text or "").encode())]))[0]
        total = model.bias
        for value, cuts, steps in zip(x, model.cuts, model.tables, strict=True):
            total += steps[bisect.bisect_right(list(cuts), value)]
        for (i, j), grid in model.pairs.items():
            total += grid[bisect.bisect_right(list(model.coarse[i]), x[i])][bisect.bisect_right(list(model.coarse[j]), x[j])]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-9


def test_quality_classifier_on_held_out_labels(spark):
    got = quality_gam.op3_quality_classifier(spark, LARGE).where("held_out").join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id")
    rows = [(r.score, r.quality) for r in got.where("quality is not null").collect()]
    assert len(rows) > 500 and _auc(rows) > 0.95
    assert sum((s >= 0.3) == y for s, y in rows) / len(rows) > 0.95


def test_toxicity_on_held_out_labels(spark):
    got = toxicity.op7_toxicity(spark, LARGE).where("held_out").join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id")
    rows = [(r.score, r.toxic) for r in got.where("toxic is not null").collect()]
    toxic = [s for s, y in rows if y]
    assert len(toxic) > 80 and _auc(rows) > 0.95
    assert sum(s >= 0.3 for s in toxic) / len(toxic) > 0.9
    assert sum(s >= 0.3 for s, y in rows if not y) / len(rows) < 0.02


def test_toxicity_scores_by_walking_each_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.trees is not None
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    xs, ys = model.steps
    for r in docs.collect():
        x = toxicity.features(r.text or "", model.learned)[0]
        total = model.trees.base
        for feature, cut, leaf in model.trees.trees:
            node = 0
            while node < len(feature):
                at = bisect.bisect_right(list(model.trees.cuts[feature[node]]), x[feature[node]])
                node = 2 * node + (2 if at > cut[node] else 1)
            total += leaf[node - len(feature)]
        k = bisect.bisect_right(list(xs), total)
        if k == 0 or k == len(xs):
            want = ys[min(k, len(xs) - 1)] if k == 0 else ys[-1]
        else:
            want = ys[k - 1] + (ys[k] - ys[k - 1]) * (total - xs[k - 1]) / (xs[k] - xs[k - 1])
        assert abs(got[r.doc_id] - want) < 1e-9


def test_toxicity_features():
    own = toxicity.Lexicons([frozenset(["grolk", "mubbl*"]), frozenset()])
    at = {k: i for i, k in enumerate(toxicity.FEATURES)}
    text = "You are an idi0t and a m*r0n, $tupid! GROLK you; a mubblest s.c.u.m looooser 12 x86 fine!!"
    one, two = toxicity.features(text, own)
    # spellings: idi0t m*r0n $tupid s.c.u.m stand for seed words, x86 does not; looooser is a stretched seed word
    assert (one[at["masked_hits"]], one[at["stretched"]] > 0, one[at["learned_hits"]], one[at["stem_kinds"]]) == (5, True, 1, 1)
    assert (two[at["learned_hits"]], two[at["stem_kinds"]], two[at["near_second_person"]]) == (0, 0, 0)
    assert one[at["near_second_person"]] > 0  # a learned word beside "you"
    assert toxicity.features("", own) == [(0.0,) * len(toxicity.FEATURES)] * 2
    for word, seed in {"idi0t": "idiot", "w0rthl3ss": "worthless", "f**k": "fuck", "trash###": "trash", "$cum": "scum", "idiot!": "idiot", "b2b": None, "a***": None}.items():
        assert toxicity.unmask(word) == seed


def slow_verdicts(texts):
    """Votes, EM and posteriors of the quality rules, one text and one rule at a time."""

    def votes(text):
        c = dict(zip(text_stats.FIELDS, text_stats.text_stats((text or "").encode()), strict=True))
        share = lambda a, b: c[a] / c[b] if c[b] else 0.0
        pick = lambda good, bad: -1 if bad else 1 if good else 0
        length, repeat, func, ended = share("word_chars", "n_words"), share("n_repeat_words", "n_words"), share("n_function", "n_words"), share("n_ended", "n_lines")
        return c, (
            pick(3.5 <= length <= 7.5, length < 2.5 or length > 12), pick(False, share("n_symbols", "n_words") > 0.1),
            pick(False, share("n_upper", "n_letters") > 0.25 or share("n_shout", "n_words") > 0.05), pick(False, share("n_dup_lines", "n_lines") > 0.4),
            pick(repeat < 0.1, repeat > 0.3), pick(func > 0.1, func < 0.05), pick(False, share("n_top", "n_words") > 0.25), pick(ended > 0.8, ended < 0.3),
        )

    seen = [votes(t) for t in texts]
    prior = ({-1: 0.45, 0: 0.45, 1: 0.10}, {-1: 0.02, 0: 0.38, 1: 0.60})
    like = [[dict(p) for p in prior] for _ in range(8)]
    share, weight, counts = 0.7, 0.1 * max(len(seen), 1), Counter(v for _, v in seen)

    def posterior(v):
        odds = math.log(share / (1 - share)) + sum(math.log(like[k][1][x]) - math.log(like[k][0][x]) for k, x in enumerate(v))
        return 1 / (1 + math.exp(-max(-60, min(60, odds))))

    for _ in range(200):
        post = {v: posterior(v) for v in counts}
        fresh = [[{x: weight * prior[s][x] for x in (-1, 0, 1)} for s in (0, 1)] for _ in range(8)]
        for v, n in counts.items():
            for k, x in enumerate(v):
                fresh[k][1][x] += n * post[v]
                fresh[k][0][x] += n * (1 - post[v])
        fresh = [[{x: p / sum(row.values()) for x, p in row.items()} for row in pair] for pair in fresh]
        new = (sum(n * post[v] for v, n in counts.items()) + 0.7 * weight) / (len(seen) + weight)
        moved = max([abs(new - share), *(abs(fresh[k][s][x] - like[k][s][x]) for k in range(8) for s in (0, 1) for x in (-1, 0, 1))])
        share, like = new, fresh
        if moved < 1e-9:
            break
    out = []
    for c, v in seen:
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        out.append((failed, posterior(v), not failed and posterior(v) >= 0.5))
    return out


def test_quality_rules_against_slow_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = {r.doc_id: w for r, w in zip(rows, slow_verdicts([r.text for r in rows]), strict=True)}
    got = quality_rules.op8_quality_rules(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        failed, posterior, kept = want[r.doc_id]
        assert r.base_failed == failed and abs(r.quality_posterior - posterior) < 1e-6 and r.kept == kept
