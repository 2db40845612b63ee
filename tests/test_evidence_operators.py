"""Operators on small hand-made transactions with known results."""

import http.server
import inspect
import json
import math
import random
import threading

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkloom.functions import amounts, axes, evidence, library
from sparkloom.operators import change, conservation, entities, graph, metrics, mixture, partitions, provenance, refine, temporal
from sparkloom.operators.components import connected_components
from sparkloom.operators.measure import entropy, measure
from sparkloom.plans import catalogue, graph_queries
from sparkloom.sources import exports, ledger, rest

TX = (
    "txid string, height bigint, version int, locktime bigint, fee bigint, weight bigint, "
    "vin array<struct<txid:string,vout:int,sequence:bigint,prevout:struct<value:bigint,scriptpubkey_type:string,scriptpubkey_address:string>,witness:array<string>,scriptsig:string>>, "
    "vout array<struct<value:bigint,scriptpubkey:string,scriptpubkey_type:string,scriptpubkey_address:string>>"
)


def vin(txid, value=None, address=None, kind=None, sequence=0xFFFFFFFF, vout=0, witness=(), scriptsig=""):
    return (txid, vout, sequence, (value, kind, address), list(witness), scriptsig)


def out(value, address=None, kind=None, script=None):
    return (value, script, kind, address)


def tx(txid, ins=(), outs=(), version=2, locktime=0, height=800000, fee=1000, weight=800):
    return (txid, height, version, locktime, fee, weight, list(ins), list(outs))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), TX)


def value_of(spark, build, row):
    return frame(spark, row).select(build().alias("v")).first()["v"]


# --- axes


@pytest.mark.parametrize(
    "sequences, want",
    [
        ([1, 0xFFFFFFFF], "cake_group_c"), ([1], "seq_0x01_other"), ([0xFFFFFFFD] * 2, "rbf_fffffffd"), ([0xFFFFFFFE], "final_fffffffe"),
        ([0xFFFFFFFF], "max_ffffffff"), ([0xFFFFFFFF, 0xFFFFFFFD], "mixed_other"), ([], "rbf_fffffffd"),
    ],
)
def test_nsequence(spark, sequences, want):
    assert value_of(spark, axes.nsequence, tx("t", [vin("a", sequence=s) for s in sequences])) == want


def test_orders(spark):
    up = [vin("00" * 31 + f"{i:02x}") for i in range(4)]
    down = list(reversed(up))
    assert value_of(spark, axes.input_order, tx("t", up)) in ("bip69", "shuffle")
    assert value_of(spark, axes.input_order, tx("t", [vin(f"{i:02x}" + "00" * 31) for i in range(4)])) == "bip69"
    assert value_of(spark, axes.input_order, tx("t", down[:1])) == "single"
    assert value_of(spark, axes.input_order, tx("t", [])) == "small_n"
    assert value_of(spark, axes.output_order, tx("t", [], [out(v) for v in (1, 2, 3, 4)])) == "sorted_value"
    assert value_of(spark, axes.output_order, tx("t", [], [out(5, script="bb"), out(5, script="aa")])) == "unsorted"


def test_witness_axes(spark):
    sig = lambda n, last="01": "00" * (n - 1) + last
    one = lambda kind, *w: tx("t", [vin("a", 5, "x", kind, witness=w)])
    assert value_of(spark, axes.low_r, one("v0_p2wpkh", sig(71))) == "low_r"
    assert value_of(spark, axes.low_r, one("v0_p2wpkh", sig(72))) == "not_low_r"
    assert value_of(spark, axes.low_r, one("v0_p2wpkh")) == "na"
    assert value_of(spark, axes.sighash, one("v0_p2wpkh", sig(71, "83"))) == "anyonecanpay_single"
    assert value_of(spark, axes.sighash, one("v0_p2wpkh", sig(71, "7f"))) == "sh_7f"
    assert value_of(spark, axes.sighash, one("v1_p2tr", sig(64))) == "taproot_default"
    assert value_of(spark, axes.pubkey_compression, one("v0_p2wpkh", sig(71), "04" + "aa" * 64)) == "uncompressed"
    assert value_of(spark, axes.multisig, one("v0_p2wsh", sig(71), "52AE")) == "multisig"
    assert value_of(spark, axes.nested_segwit, one("p2sh", sig(71))) == "nested_segwit"


def test_change_axes(spark):
    t = tx("t", [vin("a", 9, "A", "p2pkh")], [out(1000, "B", "p2sh"), out(4751, "A", "p2pkh")])
    assert value_of(spark, axes.change_index, t) == "last"
    assert value_of(spark, axes.change_type_match, t) == "match_input"
    assert value_of(spark, axes.change_matches_output, t) == "mismatch_output"
    assert value_of(spark, axes.change_address_reuse, t) == "reuse"
    assert value_of(spark, axes.change_index, tx("t", [], [out(10), out(20)])) == "na"
    assert value_of(spark, axes.change_spk_type, tx("t", [], [out(1)])) == "ERR"


def test_locktime_and_broadcast(spark):
    cases = {0: "zero", 600_000_000: "timestamp", 800001: "height_tip", 799950: "height_backdated", 5: "height_other"}
    for lock, want in cases.items():
        assert value_of(spark, axes.locktime_class, tx("t", locktime=lock)) == want
    x = frame(spark, tx("t", locktime=799950)).withColumn("_bc", F.struct(F.lit(4.0).alias("prev_min"), F.lit(1).alias("prev_time"), F.lit(2).alias("incl_time")))
    assert x.select(axes.locktime_vs_broadcast()).first()[0] == "matches"
    loose = x.withColumn("_bc", F.struct(F.lit(6.0).alias("prev_min"), F.lit(1).alias("prev_time"), F.lit(2).alias("incl_time")))
    assert loose.select(axes.locktime_vs_broadcast()).first()[0] == "na_loose"


def test_measure_and_entropy(spark):
    got = measure(frame(spark, *(tx(str(i), version=1 + (i > 0)) for i in range(4))), {"version": axes.version})
    by = {r.value: r for r in got.collect()}
    assert by["v1"].n == 1 and math.isclose(by["v1"].bits, 2.0)
    assert math.isclose(entropy(got).first()["entropy_bits"], 0.8112781244591328)


# --- evidence


def test_scores_of_known_pairs(spark):
    rbf = lambda t, n, lock: tx(t, [vin(f"{t}{i}", sequence=0xFFFFFFFD) for i in range(n)], locktime=lock)
    full = lambda t, n, lock: tx(t, [vin(f"{t}{i}", sequence=0xFFFFFFFF) for i in range(n)], locktime=lock)
    a, b, c = rbf("a", 1, 0), full("b", 1, 800000), rbf("c", 1, 0)
    of = frame(spark, a, b, c).select("txid", evidence.features(evidence.NARROW).alias("f")).collect()
    f = {r.txid: r.f for r in of}
    pairs = spark.createDataFrame([("ac", f["a"], f["c"]), ("ab", f["a"], f["b"])], "k string, x struct<nsequence:string,locktime:string,in_order:string>, y struct<nsequence:string,locktime:string,in_order:string>")
    got = {r.k: r.s for r in pairs.select("k", evidence.score(evidence.narrow_axes(), "x", "y").alias("s")).collect()}
    assert math.isclose(got["ac"], 2.78, abs_tol=1e-9)
    assert math.isclose(got["ab"], -6.524772307464604, abs_tol=1e-9)


def test_library_policies(spark):
    assert library.bits("input_order", "small_n") == 0 and "small_n" not in library.shares("input_order")
    assert library.bits("version", "v9") is None and len(library.BITS) == 23
    axis = next(x for x in evidence.wide_axes() if x.name == "io_shape")
    row = spark.range(1).select(
        evidence.axis_weight(axis, F.lit("9in-9out"), F.lit("9in-9out")).alias("both_unknown"),
        evidence.axis_weight(axis, F.lit("9in-9out"), F.lit("1in-2out")).alias("one_unknown"),
    ).first()
    assert row.both_unknown is None and row.one_unknown < 0


def test_mixture_recovers_m(spark):
    rng = np.random.default_rng(1)
    m, u = np.array([0.95, 0.80, 0.60]), np.array([0.3, 0.2, 0.5])
    z = rng.uniform(size=4000) < 0.5
    agree = rng.uniform(size=(4000, 3)) < np.where(z[:, None], m, u)
    df = spark.createDataFrame([(a.tolist(), [True] * 3) for a in agree], "agree array<boolean>, active array<boolean>")
    got = mixture.em_fit(mixture.patterns(df), u.tolist())
    assert np.abs(got.m - m).max() < 0.06 and all(b >= a - 1e-6 for a, b in zip(got.loglik, got.loglik[1:], strict=False))
    drawn = mixture.gibbs_fit(mixture.patterns(df), u.tolist(), draws=300, burn=100)
    assert np.abs(drawn["m"] - m).max() < 0.08 and (drawn["low"] <= drawn["high"]).all()


# --- metrics


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, positive boolean")
    assert metrics.auc(df).first()["auc"] == 0.875
    assert metrics.auc(df.where("positive")).first()["auc"] is None
    rng = random.Random(0)
    rows = [(float(rng.randint(0, 40)), rng.random() < 0.4) for _ in range(500)]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(metrics.auc(spark.createDataFrame(rows, df.schema)).first()["auc"], want)
    both = spark.createDataFrame([(i, i // 2, i // 2) for i in range(8)], "n int, a int, b int")
    assert metrics.adjusted_rand_index(both).first()["ari"] == 1.0
    got = metrics.partition_figures(both, "a").first()
    assert got.clusters == 4 and math.isclose(got.entropy, 2) and got.largest_share == 0.25
    cal = spark.createDataFrame([(0.95, 1), (1.0, 1), (0.05, 1)], "p double, label int")
    assert math.isclose(metrics.expected_calibration_error(cal).first()["ece"], (2 * 0.025 + 0.95) / 3)


# --- components


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(350)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is None:
            find(a)
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {r.node: r.component for r in connected_components(df, nodes=spark.createDataFrame([(7777,)], "node int")).collect()}
    find(7777)
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(df.limit(0)).count() == 0


# --- amounts


def test_roundness_partition(spark):
    t = tx("t", [vin("s", 2000), vin("c", 5750)], [out(791), out(6750)])
    x = frame(spark, t).withColumn("ranked", amounts.partitions()).select(
        "ranked", amounts.ambiguity_bits(F.col("ranked")).alias("bits"), amounts.partition_signal(F.col("ranked")).alias("s"),
        amounts.refuse_weight(F.col("ranked"), F.lit("s"), F.lit("c")).alias("w"),
    ).first()
    assert [(p.payment, p.score) for p in x.ranked] == [(1000, 3), (4750, 1)]
    assert x.bits == 1.0 and x.s.payment == 1000 and {x.s.sender, x.s.receiver} == {"s", "c"} and x.w == -2.0


def test_demix_and_conservation(spark):
    t = tx("t", [vin("a", 100099), vin("b", 50099), vin("c", 10099)], [out(v) for v in (100, 100, 100, 100000, 50000, 10000)])
    got = {r.input_index: r.change for r in conservation.coinjoin_demix(frame(spark, t)).collect()}
    assert got == {0: 100000, 1: 50000, 2: 10000}
    r = tx("r", [vin("a", 100), vin("b", 30)], [out(40), out(40), out(40)])
    x = frame(spark, r).withColumn("known", F.lit(100).cast("bigint"))
    assert [(v.value, v.forced, v.present) for v in conservation.forced_in_round(x).collect()] == [(40, 3, 3)]
    p = conservation.forced_prefixes(x).first()
    assert (p.forced_amount, p.coins, p.pool) == (90, 3, 3)


# --- entities


@pytest.mark.parametrize(
    "script, want",
    [("6a14" + "00" * 20, 20), ("6a4c50" + "00" * 80, 80), ("6a4d2c01" + "00" * 300, 300), ("6a5d0101", None), ("6a0100ff", None), ("", None), (None, None), ("zz", None)],
)
def test_op_return_length(spark, script, want):
    df = spark.createDataFrame([(script,)], "s string")
    assert df.select(entities.op_return_length(F.col("s"))).first()[0] == want


def test_detectors(spark):
    note = tx("n", [vin("a")], [out(0, None, "op_return", "6a4c50" + "00" * 80), out(546, "payee", "p2pkh")])
    assert value_of(spark, entities.notification_address, note) == "payee"
    mex = entities.detect_bitmex(frame(spark, tx("m", [vin("a", 1, "bc1qmexaaa")], [out(1, "3BMEXx"), out(2, "1a")]))).collect()
    assert {(r.role, r.address) for r in mex} == {("output", "3BMEXx"), ("input", "bc1qmexaaa")}
    dust = frame(spark, tx("d", [vin("a")], [out(546, f"x{i}") for i in range(20)]))
    assert entities.detect_dust_fanout(dust).count() == 20 and entities.detect_batching(dust).count() == 0
    pool = frame(spark, tx("p", [], [out(5, "a"), out(9, "b"), out(9, "c")])).withColumn("cb", F.lit(b"\x03/F2Pool/x".hex()))
    assert entities.detect_mining_pool(pool, "cb").first()[1:] == ("f2pool", "b")


# --- change labels


def test_special_labels(spark):
    t = tx("t", [vin("a", 500, "A"), vin("b", 600, "B")], [out(100000, "1x"), out(40, "A")])
    row = frame(spark, t).select(*(f().alias(k) for k, f in change.LABELS.items())).first()
    assert (row.optimal_change, row.address_reuse, row.round_number) == (1, 1, 1)


def test_ground_truth_by_cluster(spark):
    t = tx("T", [vin("f", 9, "A")], [out(5, "B"), out(3, "C")])
    reveal = tx("R", [vin("T", 5, "B", vout=0), vin("g", 9, "A")], [out(1, "Z")])
    txs = frame(spark, t, reveal)
    got = change.ground_truth(txs, change.address_clusters(txs)).collect()
    assert [(r.txid, r.change_index, r.verdict) for r in got] == [("T", 0, "kept")]
    spent = {(r.txid, r.vout): r.spender for r in change.spends(txs).collect()}
    assert spent[("T", 0)] == "R"


# --- topology and the engine


def merge_world(spark):
    """Two wallets of one software, joined by a merge; their counterparties are apart."""
    rows = [tx(n, [vin(f"{n}-in", 1, f"addr-{n}")], [out(7, "x")]) for n in ("A1", "A2", "B1", "B2")]
    rows.append(tx("CA", [vin("A1", 1, "a1"), vin("A2", 1, "a2")], [out(1, "y")]))
    rows.append(tx("P", [vin("A1", 1, "a3"), vin("B1", 1, "b3")], [out(1, "y"), out(2, "z"), out(3, "w")]))
    rows.append(tx("CB", [vin("B1", 1, "b1"), vin("B2", 1, "b2")], [out(1, "y")]))
    txs = frame(spark, *rows)
    nodes = txs.select(F.col("txid").alias("node"))
    near = [(n, c) for n, cs in {"A1": ["u", "v"], "A2": ["u", "v"], "B1": ["p", "q"], "B2": ["p", "q"]}.items() for c in cs]
    return txs, nodes, spark.createDataFrame(near, "node string, cp string")


def test_engine_refuses_a_merge_by_topology(spark):
    txs, nodes, neigh = merge_world(spark)
    fused = refine.refine(txs, nodes, link_above=99.0)
    by = {r.node: r.cluster for r in fused.groups.collect()}
    assert len({by[n] for n in ("A1", "A2", "B1", "B2")}) == 1
    kept = refine.refine(txs, nodes, neigh=neigh, link_above=99.0)
    by = {r.node: r.cluster for r in kept.groups.collect()}
    assert by["A1"] == by["A2"] and by["B1"] == by["B2"] and by["A1"] != by["B1"]
    assert [(r.a, r.b, r.txid) for r in kept.refused.collect()] == [("A1", "B1", "P")]


def test_engine_links_without_cospend(spark):
    rows = [tx(n, [vin(f"{n}{i}", sequence=1 if i == 0 else 0xFFFFFFFF) for i in range(2)]) for n in ("a", "b")]
    rows.append(tx("c", [vin("c0")], locktime=5))
    txs = frame(spark, *rows)
    got = refine.refine(txs, txs.select(F.col("txid").alias("node")))
    assert [(r.a, r.b) for r in got.linked.collect()] == [("a", "b")]
    assert {r.node: r.cluster for r in got.groups.collect()} == {"a": "a", "b": "a", "c": "c"}


def test_link_stars_have_the_components_of_all_links(spark):
    """Random worlds in one frame, many of them with hubs that were spent together."""
    rng = random.Random(5)
    of, strong, pairs, want = [], [], [], {}
    for w in range(400):
        names = [f"w{w}-{i}" for i in range(rng.randint(2, 7))]
        kind = {n: f"w{w}-{rng.choice('AB')}" for n in names}
        ways = {x for x in ((f"w{w}-A", f"w{w}-A"), (f"w{w}-A", f"w{w}-B"), (f"w{w}-B", f"w{w}-B")) if rng.random() < 0.5}
        ways |= {(b, a) for a, b in ways}
        share = rng.choice([0.1, 0.5, 0.8])
        spent = {(a, b) for a in names for b in names if a < b and rng.random() < share}
        label = {n: n for n in names}
        for a in names:
            for b in names:
                if a < b and (a, b) not in spent and (kind[a], kind[b]) in ways:
                    lo, hi = sorted((label[a], label[b]))
                    label = {n: lo if x == hi else x for n, x in label.items()}
        want |= label
        of, strong, pairs = of + list(kind.items()), strong + sorted(ways), pairs + sorted(spent)
    edges = refine.link_stars(
        spark.createDataFrame(of, "node string, f string"), spark.createDataFrame(strong, "fa string, fb string"), spark.createDataFrame(pairs, "a string, b string")
    )
    got = connected_components(edges, nodes=spark.createDataFrame([(n,) for n in want], "node string"))
    assert {r.node: r.component for r in got.collect()} == want


def test_registered_engine_links_from_the_default_on(spark):
    """Links per node, counted by tuples, against the pairs themselves."""
    txs = ledger.transactions(spark, SF)
    nodes = graph_queries._nodes(txs)
    pairs = refine.missed_links(txs, nodes, refine.cospent_pairs(txs, nodes)).collect()
    assert min(r.score for r in pairs) >= refine.LINK_ABOVE and any(r.score < 12 for r in pairs)
    want = {r.node: 0 for r in nodes.collect()}
    for r in pairs:
        want[r.a] += 1
        want[r.b] += 1
    assert {r.node: r.links for r in catalogue.QUERIES["refine_linked"](spark, SF).collect()} == want


def test_links_of_one_tuple_are_counted_and_not_listed(spark):
    """Twenty thousand nodes of one tuple have two hundred million links."""
    one = frame(spark, tx("x", [vin("p0", sequence=1), vin("p1", sequence=0xFFFFFFFF)]))
    txs = one.drop("txid").crossJoin(spark.range(20_000).select(F.concat(F.lit("t"), F.col("id")).alias("txid")))
    nodes = txs.select(F.col("txid").alias("node"))
    none = spark.createDataFrame([("t1", "t2")], "a string, b string")
    got = refine.link_counts(txs, nodes, none)
    assert {(r.links, r.n) for r in got.groupBy("links").agg(F.count("*").alias("n")).collect()} == {(19_999, 19_998), (19_998, 2)}
    of, strong = refine._kinds(txs, nodes, refine.LINK_ABOVE, 0.95)
    edges = refine.link_stars(of, strong, none)
    assert edges.count() < 60_000 and connected_components(edges).select("component").distinct().count() == 1


def test_address_queries_read_the_whole_ledger(spark):
    spent = {}
    for r in ledger.inputs(spark, SF).select("txid", "address").where("address is not null").distinct().collect():
        spent.setdefault(r.txid, []).append(r.address)
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for group in spent.values():
        for x in group:
            lo, hi = sorted((top(group[0]), top(x)))
            root[hi] = lo
    want = {x: top(x) for x in root}
    got = {r.node: r.component for r in catalogue.QUERIES["components_addresses"](spark, SF).collect()}
    assert got == want
    touch, outside = {}, {}
    for r in graph.pay_edges(ledger.transactions(spark, SF)).collect():
        touch.setdefault(r.dst, set()).add(r.src)
    nodes = len(set().union(*touch.values()))
    sizes = [*want.values()]
    big = {c for c in set(sizes) if sizes.count(c) >= 2}
    for dst, srcs in touch.items():
        for c in {want.get(x) for x in srcs} & big - {want.get(dst)}:
            outside[c] = outside.get(c, 0.0) - math.log2(len(srcs) / nodes)
    bits = [b for b in outside.values() if b > 0]
    r = catalogue.QUERIES["cluster_bits_summary"](spark, SF).first()
    assert r.clusters == len(bits) and (not bits or math.isclose(r.most, max(bits), abs_tol=1e-5) and math.isclose(r.median, float(np.median(bits)), abs_tol=1e-5))


def test_intervals_take_all_draws(spark, monkeypatch):
    asked, fit = {}, mixture.gibbs_fit

    def noted(counted, u, **more):
        asked.update(inspect.signature(fit).bind(counted, u, **more).arguments)
        return {"m": u, "low": u, "high": u}

    monkeypatch.setattr(mixture, "gibbs_fit", noted)
    catalogue.QUERIES["gibbs_fit"](spark, SF)
    assert (asked.get("draws", 2000), asked.get("burn", 500)) == (2000, 500)
    assert inspect.signature(metrics.bootstrap_rates).parameters["rounds"].default == 2000


def test_hubs_prove_nothing(spark):
    neigh = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("c", "z")], "node string, cp string")
    hubs = spark.createDataFrame([("hub",)], "address string")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    free = graph.topology_weight(pairs, neigh, graph.counterparty_bits(neigh), tau=0.1).first()["topology"]
    held = graph.topology_weight(pairs, neigh, graph.counterparty_bits(neigh, hubs), tau=0.1).first()["topology"]
    assert math.isclose(free, -math.log2(2 / 3)) and held == graph.PAIR_DISJOINT_BITS


# --- provenance


def test_link_matrix():
    assert provenance.link_matrix((3, 5), (3, 5)) == [[1.0, 0.0], [0.0, 1.0]]
    assert provenance.link_matrix((8,), (3, 5)) == [[1.0, 1.0]]
    assert provenance.link_matrix((3,), (5,)) is None
    assert provenance.link_matrix(tuple(range(1, 13)), tuple(range(1, 13))) is None  # too many coins
    assert provenance.link_matrix((1,) * 8, (1,) * 8, most=16) == [[0.125] * 8] * 8
    wide = provenance.link_matrix(tuple(3**i for i in range(9)), tuple(3**i for i in range(9)))
    assert wide == [[float(i == o) for o in range(9)] for i in range(9)]
    assert provenance.link_matrix((4, 4), (4, 4)) == [[0.5, 0.5], [0.5, 0.5]]


def test_signatures(spark):
    rows = [
        tx("T", [vin("M1", 5, vout=0), vin("M2", 5, vout=0)], [out(10, "t")]),
        tx("M1", [vin("G", 5, vout=0)], [out(5, "m")]),
        tx("M2", [vin("G", 5, vout=1)], [out(5, "m")]),
        tx("G", [vin("root", 10)], [out(5, "g"), out(5, "h")]),
    ]
    txs = frame(spark, *rows)
    targets = spark.createDataFrame([("T", 0)], "txid string, vout int")
    deep = {r.ancestor: r.mass for r in provenance.signatures(txs, targets, 6).collect()}
    assert deep == {"root:0": 1.0}
    near = {r.ancestor: r.mass for r in provenance.signatures(txs, targets, 2).collect()}
    assert near == {"G:0": 0.5, "G:1": 0.5}
    e = provenance.signature_entropy(provenance.signatures(txs, targets, 2)).first()
    assert (e.shannon, e.min_entropy, e.n_absorbers, e.truncated) == (1.0, 1.0, 2, 0)


def test_registered_signatures_walk_back_six_transactions(spark, monkeypatch):
    """Chains whose coins have one origin each: the coin six transactions back, or the one before the chain."""
    coins = [f"{k}:0" for k in ("root", *"abcdefgh")]
    txs = frame(spark, *(tx(c[0], [vin(before.split(":")[0], 5, vout=0)], [out(5, "x")]) for before, c in zip(coins, coins[1:])))
    monkeypatch.setattr(ledger, "stored_transactions", lambda *_: txs)
    got = catalogue.QUERIES["ancestry_signature"](spark, "").collect()
    assert {(r.target, r.ancestor, r.mass) for r in got} == {(c, coins[max(0, k - 6)], 1.0) for k, c in enumerate(coins) if k}


def test_walk_and_intersection(spark):
    rows = [tx("A", [], [out(1, "a")]), tx("B", [], [out(1, "b")]), tx("S", [vin("A", 1), vin("B", 1)], [out(2, "s")])]
    txs = frame(spark, *rows)
    seeds = spark.createDataFrame([("A", 0), ("B", 0)], "txid string, vout int")
    frontier, candidates = provenance.walk_frontier(txs, seeds, 3)
    assert [(r.txid, r.seeds, r.n_in, r.n_out) for r in candidates.collect()] == [("S", 2, 2, 1)]
    assert {(r.seed, r.reason, r.depth) for r in frontier.collect()} == {("A:0", "unspent", 1), ("B:0", "unspent", 1)}
    found = spark.createDataFrame([("x", "o1", 0.5, False), ("x", "o2", 0.5, False), ("y", "o1", 1.0, True)], "target string, ancestor string, mass double, cut boolean")
    branches = spark.createDataFrame([("g", "x"), ("g", "y")], "group string, coin string")
    r = provenance.intersect(branches, found).first()
    assert (r.branches, r.smallest, r.shared, r.collapsed, r.collapsed_bits, r.blind, r.scored) == (2, 1, 1, 0, 0.0, True, False)


def test_propagation(spark):
    sigs = spark.createDataFrame([("s1", "p", 1.0), ("s2", "q", 1.0), ("u1", "p", 0.9), ("u1", "hub", 0.1), ("u2", "hub", 1.0)], "coin string, ancestor string, mass double")
    seeds = spark.createDataFrame([("s1", "X"), ("s2", "Y")], "coin string, label string")
    rare = spark.createDataFrame([("hub", 500), ("p", 2), ("q", 1)], "ancestor string, support bigint")
    got = {r.coin: r.label for r in provenance.propagate_labels(sigs, seeds, rare).collect()}
    assert got == {"s1": "X", "s2": "Y", "u1": "X"}


# --- time and sources


def test_schedules(spark):
    df = spark.createDataFrame([("a", 3600 * h) for h in (1, 1, 2)] + [("a", None)], "e string, t bigint")
    hours = temporal.active_hours(df, "e", "t").first()["hours"]
    assert hours[1] == 2 and hours[2] == 1 and sum(hours) == 3
    x = spark.createDataFrame([([1, 0], [0, 3]), ([1, 1], [1, 1]), ([0, 0], [1, 1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in x.select(temporal.schedule_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_exports(spark, tmp_path):
    plain = {"txid": "a", "height": "7", "version": 2, "vin": [{"txid": "p", "vout": "1", "sequence": "4294967295", "value": "9"}], "vout": [{"value": "5"}]}
    wrapped = {"row": json.dumps({**plain, "txid": "b", "height": "no"})}
    (tmp_path / "x.ndjson").write_text(json.dumps(plain) + "\n\n" + json.dumps(wrapped) + "\n" + json.dumps({**plain, "height": "8"}) + "\n" + json.dumps({**plain, "txid": None}) + "\n")
    (tmp_path / "y.json").write_text(json.dumps([{**plain, "txid": "c"}, {**plain, "height": "9"}]))
    got = {r.txid: r for r in exports.load_unique(spark, str(tmp_path / "x.ndjson"), str(tmp_path / "y.json")).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].height == 7 and got["b"].height is None and got["a"].vin[0].sequence == 4294967295 and got["a"].vin[0].prevout.value == 9
    late = exports.load_unique(spark, str(tmp_path / "x.ndjson"), keep=F.col("height") > 7).collect()
    assert [(r.txid, r.height) for r in late] == [("a", 8)]
    (tmp_path / "c.ndjson").write_text('# note\n\n{"key": "k", "entity": "old"}\n{"key": "k", "entity": "new"}\n')
    assert [r.entity for r in exports.read_curated(spark, str(tmp_path / "c.ndjson")).collect()] == ["new"]


def test_exports_of_many_lines_and_equal_names(spark, tmp_path):
    plain = {"txid": "a", "height": "7", "vin": [], "vout": [{"value": "5"}]}
    for folder, height in (("two", 2), ("one", 1)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.json").write_text(json.dumps([{**plain, "height": height}, {"row": json.dumps({**plain, "txid": folder})}], indent=2))
    (tmp_path / "one" / "yx.json").write_text("\n" + json.dumps({**plain, "height": 9}) + "\n")
    paths = [str(tmp_path / "two" / "x.json"), str(tmp_path / "one" / "x.json"), str(tmp_path / "one" / "yx.json")]
    for order, first in ((paths, 2), (paths[::-1], 9), ([paths[1], paths[0]], 1)):
        got = {r.txid: r for r in exports.load_unique(spark, *order).collect()}
        assert got["a"].height == first and {"one", "two"} <= set(got)
    assert {r.height for r in exports.load_unique(spark, str(tmp_path / "one")).where("txid = 'a'").collect()} == {1}


def test_fits_beyond_the_driver_bound_agree(spark):
    """With no pattern allowed on the driver the rounds run in Spark, with the same sums."""
    rng = np.random.default_rng(3)
    rows = [([bool(x) for x in rng.random(4) < (0.9 if rng.random() < 0.5 else 0.3)], [bool(x) for x in rng.random(4) < 0.9]) for _ in range(400)]
    counted = mixture.patterns(spark.createDataFrame(rows, "agree array<boolean>, active array<boolean>"))
    u = [0.3] * 4
    near, far = mixture.em_fit(counted, u, max_iter=6), mixture.em_fit(counted, u, max_iter=6, most_patterns=0)
    assert np.allclose(near.m, far.m, atol=1e-9) and math.isclose(near.share, far.share, abs_tol=1e-9)
    drawn = mixture.gibbs_fit(counted, u, draws=6, burn=2, most_patterns=0)
    assert drawn["draws"].shape == (4, 4) and (np.abs(drawn["m"] - near.m) < 0.25).all()


def test_holdout_hides_a_share_but_never_all(spark):
    for n, hidden in ((0, 0), (1, 0), (2, 1), (3, 1), (10, 3), (50, 15)):
        seeds = spark.createDataFrame([(f"c{i}", "x") for i in range(n)], "coin string, label string")
        assert provenance.holdout(seeds).where("hidden").count() == hidden


def test_candidates_are_scored_apart(spark):
    """One engine run for both candidates: the alike funders of S stay together, those of U are refused."""
    alike = [tx(n, [vin(f"{n}-in", 1, f"addr-{n}")], [out(7, f"o{n}")]) for n in ("A", "B", "C")]
    other = tx("D", [vin(f"d{i}", 1, f"addr-d{i}", sequence=1) for i in range(2)], [out(7, "oD")], locktime=5)
    rows = [*alike, other, tx("S", [vin("A", 7, vout=0), vin("B", 7, vout=0)], [out(9, "s")]), tx("U", [vin("C", 7, vout=0), vin("D", 7, vout=0)], [out(9, "u")])]
    txs = frame(spark, *rows)
    seeds = spark.createDataFrame([(n, 0) for n in "ABCD"], "txid string, vout int")
    candidates = provenance.walk_frontier(txs, seeds, 1)[1]
    got = {r.txid: r for r in refine.score_candidates(txs, candidates).collect()}
    assert set(got) == {"S", "U"} and got["S"].believed and got["S"].refused_pairs == 0
    assert not got["U"].believed
    run = {r.txid: r for r in refine.intersection_run(txs, seeds, max_depth=1).collect()}
    assert run["S"].believed and run["S"].branches == 2 and run["S"].seeds == 2


def test_bounded_groups(spark):
    rows = [(g, f"{g}{i}") for g, n in (("a", 2), ("b", 2), ("c", 3), ("d", 9), ("e", 4)) for i in range(n)]
    groups = spark.createDataFrame(rows, "group string, node string")
    kept = lambda cap, base=None: {r.group for r in partitions.bounded_groups(groups, cap, base).select("group").distinct().collect()}
    assert kept(7) == {"a", "b", "c"} and kept(3) == {"a"} and kept(100) == set("abcde") and kept(1) == set()
    base = spark.createDataFrame([("d0",), ("d1",), ("d2",), ("d3",), ("d4",), ("d5",), ("d6",), ("a0",), ("a1",)], "node string")
    assert kept(4, base) == {"a", "b", "d"}


def test_rest_source(spark, tmp_path):
    """A server that fails now and then, and knows little."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            answers = {
                "/tx/a": {"txid": "a"}, "/tx/a/outspends": [{"spent": False}], "/blocks/tip/height": 800_000, "/v1/blocks": [{"height": 5}],
                "/v1/blocks/7": [{"height": 8}, {"height": 7, "id": "x"}], "/block-height/200000": "h200000",
            }
            answers |= {f"/block/h1/txs/{k}": [{"txid": f"t{i}"} for i in range(k, min(k + 25, 60))] for k in (0, 25, 50)}
            code = 503 if self.path == "/tx/a" and asked.count("/tx/a") < 3 else 200 if self.path in answers else 404
            body = answers.get(self.path, "")
            body = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        read = lambda kind, keys=(), **more: rest.read(spark, f"http://127.0.0.1:{server.server_port}", kind, keys, cache=str(tmp_path), min_interval=0, backoff=0, **more).collect()
        got = {r.key: r for r in read("tx", ["a", "b"])}
        assert json.loads(got["a"].body) == {"txid": "a"} and asked.count("/tx/a") == 3 and (got["b"].status, got["b"].body) == (404, None)
        before = len(asked)
        assert json.loads(read("tx", ["a"])[0].body) == {"txid": "a"} and len(asked) == before  # from the cache
        assert read("tip")[0].body == "800000" and read("block_hash", ["200000"])[0].body == "h200000"
        assert json.loads(read("block_at", ["7"])[0].body)["id"] == "x" and json.loads(read("outspends", ["a"])[0].body)[0]["spent"] is False
        pages = read("block_pages", ["h1"], max_pages=8)
        assert sum(len(json.loads(r.body)) for r in pages) == 60 and len(pages) == 3
        assert rest.crawl_targets(2, 800_000) == [("pre_segwit", 200_000), ("pre_segwit", 340_911), ("segwit", 481_824), ("segwit", 595_727), ("taproot", 709_632), ("taproot", 754_815)]
    finally:
        server.shutdown()


def test_command_line_prints_tables(spark, tmp_path, capsys):
    plain = {"txid": "a", "height": "7", "version": 2, "locktime": 0, "vin": [{"txid": "p", "vout": "1", "sequence": "4294967295", "value": "9"}], "vout": [{"value": "5"}]}
    (tmp_path / "x.ndjson").write_text(json.dumps(plain) + "\n")
    from sparkloom import __main__ as cli

    for command in ("measure", "change", "report"):
        cli.main([command, str(tmp_path / "x.ndjson")], spark)
        assert "|" in capsys.readouterr().out
