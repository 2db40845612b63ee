"""What made queries fail on larger tables: small cases that would have failed before."""

import math
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkloom.operators import graph, graph_tests, hashing, mixture, shared
from sparkloom.sources import ledger


def kept(df):
    return shared.stored(df, "test")


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_the_ledger_is_derived_from_numbers(spark, monkeypatch):
    """Lines are shuffled once, without the texts made from them, and the numbers don't stay when the table is written."""
    monkeypatch.setattr(ledger, "_LEDGERS", {})
    before = shuffled(spark)
    txs = ledger.transactions(spark, SF)
    assert shuffled(spark) - before < 60 * spark.read.parquet(f"{SF}/lineitem.parquet").count()
    fs = spark._jvm.org.apache.hadoop.fs.Path(list(ledger._LEDGERS.values())[0])
    kept = [f.getPath().getName() for f in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs.getParent())]
    assert fs.getName() in kept and not any(x.startswith("orders-") for x in kept)
    assert txs.count() == txs.select("txid").distinct().count()


def test_shuffle_files_go_with_the_job_that_made_them(spark):
    """Tables that are stored leave no shuffle behind, and the session's setting stays as it was."""
    shuffles = lambda: {i for i in spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keys().mkString(",").split(",") if i}
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles()
    was = spark.conf.get(name, None)
    got = shared.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "seven")
    assert got.count() == 7 and spark.conf.get(name, None) == was
    shared.stored(got.repartition(3, "k"), "again")
    assert len(shuffles() - before) <= 1  # of the count above, at most


def test_overlap_lists_the_lesser_side(spark):
    """A cluster that touches much, in many pairs, is not listed for each of them."""
    neigh = spark.range(2000).select(F.lit("big").alias("node"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("cp"))
    neigh = kept(neigh.union(spark.range(200).select(F.concat(F.lit("s"), F.col("id").cast("string")), F.concat(F.lit("c"), F.col("id").cast("string")))))
    pairs = spark.range(200).select(F.lit("big").alias("a"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("b"))
    bits = neigh.select("cp").distinct().withColumn("bits", F.lit(2.0))
    got = graph.overlap(pairs, neigh, bits)
    rows = got.collect()
    assert len(rows) == 200 and {(r.shared, r.shared_bits) for r in rows} == {(1, 2.0)}
    seen = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    text = got._jdf.queryExecution().executedPlan()

    def joins(node):
        while "Adaptive" in (kind := node.getClass().getSimpleName()) or "QueryStage" in kind:
            node = node.executedPlan() if "Adaptive" in kind else node.plan()
        if "Join" in node.nodeName():
            yield node.metrics().apply("numOutputRows").value()
        for child in seen(node.children()):
            yield from joins(child)

    assert max(joins(text)) <= 4000


def test_many_patterns_are_drawn_without_a_job_a_round(spark, monkeypatch):
    """A quarter of a million patterns of 22 axes; the sums are those of the patterns taken one by one."""
    k = 22
    says = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.nullif(F.pmod(F.hash("id", j), F.lit(3)), F.lit(2)))
    counted = kept(spark.range(250_000).select(says.alias("pattern"), (1 + F.col("id") % 3).alias("n")))
    u = [0.2 + 0.02 * j for j in range(k)]
    held = mixture._Counted(counted.limit(500), k)
    m, on, share = np.linspace(0.6, 0.95, k), [], 0.4
    rows = counted.limit(500).collect()
    got = held.sums(m, np.array(u), share)
    code = np.array([[-1 if v is None else v for v in r.pattern] for r in rows])
    on, a, n = code >= 0, code == 1, np.array([r.n for r in rows])
    side = lambda p: np.where(on, np.where(a, np.log(p), np.log(1 - p)), 0).sum(1)
    top, bottom = np.log(share) + side(m), np.log(1 - share) + side(np.array(u))
    z = n * np.exp(top - np.logaddexp(top, bottom))
    assert math.isclose(got.part, z.sum(), rel_tol=1e-9) and np.allclose(got.speaks, z @ on) and np.allclose(got.agrees, z @ a)
    monkeypatch.setattr(type(counted), "mapInArrow", lambda *x, **y: pytest.fail("a job a round"))
    assert mixture.gibbs_fit(counted, u, draws=4, burn=1)["draws"].shape == (3, k)


def test_cluster_band_counts_each_draw(spark):
    rng = np.random.default_rng(5)
    rows = sorted({tuple(sorted((f"n{rng.integers(60)}", f"n{rng.integers(60)}"))) for _ in range(70)})
    rows = [(a, b, [bool(x) for x in rng.random(3) < 0.6], [bool(x) for x in rng.random(3) < 0.8]) for a, b in rows if a != b]
    pairs = spark.createDataFrame(rows, "a string, b string, agree array<boolean>, active array<boolean>")
    u, every = np.array([0.3, 0.4, 0.2]), rng.uniform(0.5, 0.95, (40, 3))
    for n, most in ((30, None), (2, 0)):
        clusters = []
        coins = {(a, b): np.random.default_rng([0, zlib.crc32(f"{a}|{b}".encode())]).random(n) for a, b, _, _ in rows}
        for d, m in enumerate(every[np.linspace(0, 39, n).astype(int)]):
            of = {x: x for a, b, _, _ in rows for x in (a, b)}
            for a, b, agree, active in rows:
                odds = sum(math.log(m[j] / u[j]) if agree[j] else math.log((1 - m[j]) / (1 - u[j])) for j in range(3) if active[j])
                if coins[a, b][d] < 1 / (1 + math.exp(-odds)):
                    old, new = of[b], of[a]
                    of = {x: new if y == old else y for x, y in of.items()}
            clusters.append(len(set(of.values())))
        r = mixture.cluster_band(pairs, u.tolist(), {"draws": every, "share": 0.5}, draws=n, most_links=most).first()
        assert r.nodes == len(of) and math.isclose(r["mean"], np.mean(clusters)) and math.isclose(r.low, np.quantile(clusters, 0.025)) and math.isclose(r.high, np.quantile(clusters, 0.975))


def test_depth_sweep_walks_as_it_joins(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_DEGREE", 6)
    monkeypatch.setattr(graph, "MOST_REACHED", 25)
    monkeypatch.setattr(graph.k_hop, "__defaults__", (6, 25))
    rng = np.random.default_rng(9)
    names = [f"a{i}" for i in range(80)]
    one = [(names[rng.integers(80)], names[min(int(rng.exponential(20)), 79)]) for _ in range(120)]
    edges = kept(spark.createDataFrame(one + [(b, a) for a, b in one], "src string, dst string").distinct())
    # a node without edges has no number
    pairs = [(*sorted((names[i], names[(7 * i + j) % 80])), j == 1) for i in range(80) for j in (1, 2)] + [("a1", "alone", True)]
    pairs = kept(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a string, b string, positive boolean").distinct())
    monkeypatch.setattr(graph_tests, "_TASK_PAIRS", 40)
    near, far = (sorted((r.positive, r.met) for r in way(pairs, edges, 4).collect()) for way in (graph_tests._met_in_memory, graph_tests._met_by_joins))
    assert near == far and len({tuple(m) for _, m in near}) > 20


def test_structure_auc_derives_edges_once(spark, monkeypatch):
    """The counts are planned over written edges and pairs, not over what derives them; the AUC is that of all pairs."""
    plans = []
    plain = graph_tests.auc_of_counts
    monkeypatch.setattr(hashing, "PART_DIGITS", 0)
    monkeypatch.setattr(graph_tests, "auc_of_counts", lambda counts: plans.append(counts._jdf.queryExecution().optimizedPlan().toString()) or plain(counts))
    rng = np.random.default_rng(3)
    names = [f"n{i}" for i in range(60)]
    links = sorted({(names[rng.integers(60)], f"v{rng.integers(12)}") for _ in range(150)})
    clusters = {x: names[i % 7] for i, x in enumerate(names)}
    cospent = sorted({tuple(sorted((names[i], names[(i + 7) % 60]))) for i in range(0, 60, 3)})
    edges = spark.createDataFrame(links, "src string, dst string").distinct()
    held = kept(spark.createDataFrame([(c, a) for a, c in clusters.items()], "cluster string, address string"))
    r = graph_tests.structure_auc(held, kept(spark.createDataFrame(cospent, "a string, b string")), edges).first()
    assert plans and "LogicalRDD" not in plans[0] and "LocalRelation" not in plans[0] and "Window" not in plans[0]
    near = {x: {v for a, v in links if a == x} for x in names}
    pos = [len(near[a] & near[b]) for a in names for b in names if a < b and clusters[a] == clusters[b] and (a, b) not in cospent]
    neg = [len(near[x.a] & near[x.b]) for x in graph_tests.across_pairs(held).collect()]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert (r.n_pos, r.n_neg) == (len(pos), len(neg))
    assert len(neg) > 30 and math.isclose(r.auc, wins / (len(pos) * len(neg)))
