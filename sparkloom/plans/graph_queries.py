"""Queries over evidence of pairs, clusters, the payment graph, the engine, and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import evidence
from sparkloom.operators import change, conservation, graph, graph_tests, metrics, mixture, provenance, refine
from sparkloom.operators.components import connected_components
from sparkloom.operators.hashing import neighbours
from sparkloom.operators.shared import stored
from sparkloom.sources import ledger

SQL = ledger.SQL
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RSQL = SQL.replace("WITH base", "WITH RECURSIVE base", 1)


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = SQL + sql
        return run

    return add


def _nodes(txs):
    """Transactions whose coins are spent inside the ledger, and those that spend them."""
    funded = txs.select(F.col("txid").alias("spender"), F.explode("vin").alias("v")).where("v.funded")
    return funded.select(F.col("v.txid").alias("node")).union(funded.select("spender")).distinct()


_NODES = """, node AS (SELECT prev_txid AS node FROM tx_in WHERE funded UNION SELECT txid FROM tx_in WHERE funded),
mine AS (SELECT DISTINCT i.txid, i.prev_txid AS node FROM tx_in i SEMI JOIN node n ON n.node = i.prev_txid SEMI JOIN node t ON t.node = i.txid),
pairs AS (SELECT a.node AS a, b.node AS b, a.txid FROM mine a JOIN mine b ON a.txid = b.txid AND a.node < b.node)
"""
_SEQ = """, seq AS (SELECT h.txid, CASE WHEN n >= 2 AND first_one AND rest_max THEN 'cake_group_c' WHEN ones > 0 THEN 'seq_0x01_other' WHEN coalesce(rbf = n, true) THEN 'rbf_fffffffd' WHEN fin = n THEN 'final_fffffffe' WHEN mx = n THEN 'max_ffffffff' ELSE 'mixed_other' END AS s
  FROM tx_head h LEFT JOIN (SELECT txid, count(*) AS n, bool_or(vin = 0 AND sequence = 1) AS first_one, bool_and(vin = 0 OR sequence = 4294967295) AS rest_max, count(*) FILTER (sequence = 1) AS ones, count(*) FILTER (sequence = 4294967293) AS rbf, count(*) FILTER (sequence = 4294967294) AS fin, count(*) FILTER (sequence = 4294967295) AS mx FROM tx_in GROUP BY txid) x ON x.txid = h.txid),
ord AS (SELECT h.txid, CASE WHEN n_in = 1 THEN 'single' WHEN coalesce(down, 0) > 0 THEN 'shuffle' WHEN n_in >= 4 THEN 'bip69' ELSE 'small_n' END AS o FROM tx_head h LEFT JOIN
  (SELECT txid, count(*) FILTER (before IS NOT NULL AND (before > me OR (before = me AND bn > n))) AS down FROM (SELECT txid, rev AS me, prev_vout AS n, lag(rev) OVER w AS before, lag(prev_vout) OVER w AS bn FROM (SELECT *, list_aggregate(list_reverse(regexp_extract_all(prev_txid, '..')), 'string_agg', '') AS rev FROM tx_in) WINDOW w AS (PARTITION BY txid ORDER BY vin)) GROUP BY txid) x ON x.txid = h.txid),
feat AS (SELECT h.txid, s, CASE WHEN locktime = 0 THEN 'zero' ELSE 'height' END AS l, o FROM tx_head h JOIN seq USING (txid) JOIN ord USING (txid)),
sb(v, bits) AS (VALUES ('max_ffffffff', 0.82::DOUBLE), ('rbf_fffffffd', 2.35::DOUBLE), ('final_fffffffe', 2.42::DOUBLE), ('mixed_other', 4.38::DOUBLE), ('seq_0x01_other', 8.89::DOUBLE), ('cake_group_c', 13.88::DOUBLE)),
ob(v, bits) AS (VALUES ('single', 0.53::DOUBLE), ('shuffle', 2.46::DOUBLE), ('bip69', 3.00::DOUBLE)),
hb AS (SELECT pow(2, -2.94) + pow(2, -3.01) + pow(2, -7.65) + pow(2, -10.85) AS ph, pow(2, -0.43) AS pz),
cfg AS (SELECT least(0, log2(0.05 / greatest(1 - (SELECT sum(pow(2, -2 * bits)) FROM sb), 1e-6))) AS ms, least(0, log2(0.05 / greatest(1 - (ph * ph + pz * pz), 1e-6))) AS ml,
  least(0, log2(0.05 / greatest(1 - (SELECT sum(pow(2, -2 * bits)) FROM ob), 1e-6))) AS mo, -log2(ph) AS bh, -log2(pz) AS bz FROM hb)
"""
_FP = """CASE WHEN fa.s = fb.s THEN (SELECT bits FROM sb WHERE v = fa.s) ELSE ms END + CASE WHEN fa.l = fb.l THEN CASE WHEN fa.l = 'zero' THEN bz ELSE bh END ELSE ml END
  + CASE WHEN fa.o IN ('single', 'small_n') OR fb.o IN ('single', 'small_n') THEN 0 WHEN fa.o = fb.o THEN (SELECT bits FROM ob WHERE v = fa.o) ELSE mo END"""


@query("cospend_pairs", _NODES + "SELECT a, b, txid FROM pairs")
def cospend_pairs(spark, sf):
    txs = ledger.transactions(spark, sf)
    return refine.cospent_pairs(txs, _nodes(txs))


@query(
    "fs_score_3axis_cospent_pairs",
    _NODES + _SEQ + f"SELECT DISTINCT a, b, round({_FP}, 6) AS fp FROM pairs JOIN feat fa ON fa.txid = a JOIN feat fb ON fb.txid = b, cfg",
)
def fs_score_3axis_cospent_pairs(spark, sf):
    txs = ledger.transactions(spark, sf)
    return refine.scored_pairs(txs, _nodes(txs), use_amounts=False).select("a", "b", F.round("fp", 6).alias("fp"))


def _reuse(spark, sf):
    """Pairs of transactions, in the order of their clocks, in which neighbours spend from one address."""
    from pyspark.sql import Window

    ins = ledger.inputs(spark, sf).select("address", "clock", "txid").distinct()
    nxt = ins.withColumn("other", F.lead("txid").over(Window.partitionBy("address").orderBy("clock", "txid")))
    return nxt.where("other is not null").select(F.least("txid", "other").alias("a"), F.greatest("txid", "other").alias("b")).distinct()


_REUSE = """, reuse AS (SELECT DISTINCT least(txid, other) AS a, greatest(txid, other) AS b FROM
  (SELECT txid, lead(txid) OVER (PARTITION BY address ORDER BY clock, txid) AS other FROM (SELECT DISTINCT address, clock, txid FROM tx_in)) WHERE other IS NOT NULL)
"""


@query("reuse_pairs", _REUSE + "SELECT a, b FROM reuse")
def reuse_pairs(spark, sf):
    return _reuse(spark, sf)


_WIDE = {k: v for k, v in evidence.WIDE.items()}


def _wide_pairs(spark, sf):
    txs = ledger.transactions(spark, sf)
    of = txs.select(F.col("txid").alias("node"), evidence.features(_WIDE).alias("f"))
    return _reuse(spark, sf).join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b")


def _wide():
    return [x for x in evidence.wide_axes() if x.name in _WIDE]


@query("fs_score_23axis_reuse_pairs")
def fs_score_23axis_reuse_pairs(spark, sf):
    """Without the broadcast axis, which needs block annotations that the tables don't have."""
    return _wide_pairs(spark, sf).select("a", "b", F.round(evidence.score(_wide(), "fa", "fb"), 6).alias("bits"))


@query("fs_explain_cospent_pairs")
def fs_explain_cospent_pairs(spark, sf):
    txs = ledger.transactions(spark, sf)
    of = txs.select(F.col("txid").alias("node"), evidence.features(evidence.NARROW).alias("f"))
    pairs = refine.cospent_pairs(txs, _nodes(txs)).select("a", "b").distinct()
    x = pairs.join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b")
    return x.select("a", "b", F.explode(evidence.explain(evidence.narrow_axes(), "fa", "fb")).alias("e")).select("a", "b", "e.axis", F.col("e.a").alias("va"), F.col("e.b").alias("vb"), F.round("e.bits", 6).alias("bits"))


def _agreements(spark, sf):
    """Reuse pairs (label 1) and neighbours in a hashed order (label 0), with agreement and activity per axis."""
    wide = _wide()
    txs = ledger.transactions(spark, sf).where(F.size("vin") > 0)
    of = txs.select(F.col("txid").alias("node"), evidence.features(_WIDE).alias("f"))
    other = neighbours(of.select(F.col("node").alias("a")), "a", 1).select("a", F.col("other").alias("b"))
    pairs = _reuse(spark, sf).withColumn("label", F.lit(1)).unionByName(other.withColumn("label", F.lit(0)))
    x = pairs.join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b")
    same = [F.col(f"fa.{k.name}") == F.col(f"fb.{k.name}") for k in wide]
    on = [F.col(f"fa.{k.name}").isin(*k.shares) | F.col(f"fb.{k.name}").isin(*k.shares) for k in wide]
    return x.select("a", "b", "label", F.array(*(s & o for s, o in zip(same, on, strict=True))).alias("agree"), F.array(*on).alias("active")), wide


@query("agree_patterns")
def agree_patterns(spark, sf):
    """Per axis 1 (agrees), 0 (differs) or - (silent)."""
    pairs, _ = _agreements(spark, sf)
    sign = F.transform("pattern", lambda x: F.coalesce(x.cast("string"), F.lit("-")))
    return mixture.patterns(pairs).select(F.concat_ws("", sign).alias("pattern"), "n")


@query("oracle_m")
def oracle_m(spark, sf):
    pairs, wide = _agreements(spark, sf)
    return mixture.oracle_m(pairs, [k.name for k in wide]).withColumn("m", F.round("m", 6))


def _fitted(spark, sf):
    pairs, wide = _agreements(spark, sf)
    u = [k.collision for k in wide]
    return pairs, wide, u, mixture.em_fit(mixture.patterns(pairs), u)


@query("em_fit")
def em_fit(spark, sf):
    _, wide, u, got = _fitted(spark, sf)
    rows = [(k.name, float(m), float(x), float(got.share)) for k, m, x in zip(wide, got.m, u, strict=True)]
    return spark.createDataFrame(rows, "axis string, m double, u double, share double")


@query("gibbs_fit")
def gibbs_fit(spark, sf):
    pairs, wide = _agreements(spark, sf)
    got = mixture.gibbs_fit(mixture.patterns(pairs), [k.collision for k in wide])
    rows = [(k.name, float(m), float(lo), float(hi)) for k, m, lo, hi in zip(wide, got["m"], got["low"], got["high"], strict=True)]
    return spark.createDataFrame(rows, "axis string, m double, low double, high double")


def _probable(spark, sf):
    pairs, _, u, got = _fitted(spark, sf)
    return pairs.select("a", "b", "label", mixture.pair_probability("agree", "active", got.m, u, got.share).alias("p"))


@query("pair_probs")
def pair_probs(spark, sf):
    return _probable(spark, sf).select("a", "b", "label", F.round("p", 6).alias("p"))


@query("ece")
def ece(spark, sf):
    return metrics.expected_calibration_error(_probable(spark, sf))


@query("auc_exact")
def auc_exact(spark, sf):
    return metrics.auc(_probable(spark, sf).select(F.col("p").alias("score"), (F.col("label") == 1).alias("positive")))


@query(
    "auc_order_price",
    """, s AS (SELECT o_totalprice AS score, o_orderstatus = 'F' AS positive FROM orders WHERE o_orderstatus IN ('F', 'O')),
r AS (SELECT *, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS ties FROM s),
t AS (SELECT sum(lo + (ties - 1) / 2.0) FILTER (positive) AS rs, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn FROM r)
SELECT round((rs - np * (np + 1) / 2.0) / (np * nn), 6) AS auc, np AS n_pos, nn AS n_neg FROM t""",
)
def auc_order_price(spark, sf):
    x = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus in ('F', 'O')")
    return metrics.auc(x.select(F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("positive"))).withColumn("auc", F.round("auc", 6))


@query("shuffle_auc")
def shuffle_auc(spark, sf):
    txs = ledger.transactions(spark, sf)
    two = txs.where(F.size("vout") == 2).select("txid", F.get("vout", F.lit(0))["value"].alias("x"), F.get("vout", F.lit(1))["value"].alias("y"))
    return metrics.auc(metrics.shuffled(two, "x", "y", "txid")).withColumn("auc", F.round("auc", 6))


# --- components and partition figures


def _recursive(edges: str, nodes: str, rest: str) -> str:
    """SQL of components: the least node that can be reached."""
    return f"""{RSQL}{edges}, sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(x, y) AS (SELECT node, node FROM ({nodes}) UNION SELECT r.x, s.b FROM reach r JOIN sym s ON s.a = r.y),
comp AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x) {rest}"""


_FUND_EDGES = _NODES + ", edge AS (SELECT a, b FROM pairs)"


def _funder_components(spark, sf):
    txs = ledger.stored_transactions(spark, sf)
    nodes = _nodes(txs)
    ins = txs.join(nodes.toDF("txid"), "txid", "left_semi").select("txid", F.explode("vin").alias("v")).select("txid", F.col("v.txid").alias("node")).join(nodes, "node", "left_semi")
    star = ins.groupBy("txid").agg(F.min("node").alias("src"), F.collect_set("node").alias("all")).select("src", F.explode("all").alias("dst"))
    return connected_components(star, nodes=nodes)


@query("components_funders")
def components_funders(spark, sf):
    return _funder_components(spark, sf)


ORACLE_SQL["components_funders"] = _recursive(_FUND_EDGES, "SELECT node FROM node", "SELECT node, component FROM comp")


#: Components of addresses spent together: star edges, and the least address seen so far for each until none falls.
_ADDRESS_COMP = """, sp AS (SELECT DISTINCT txid, address FROM tx_in WHERE address IS NOT NULL),
star AS (SELECT DISTINCT m.a, sp.address AS b FROM sp JOIN (SELECT txid, min(address) AS a FROM sp GROUP BY txid) m USING (txid)),
sym AS (SELECT a, b FROM star WHERE a <> b UNION SELECT b, a FROM star WHERE a <> b),
comp(node, component) USING KEY (node) AS (SELECT DISTINCT address, address FROM sp
  UNION SELECT s.b, min(c.component) FROM comp c JOIN sym s ON s.a = c.node JOIN recurring.comp r ON r.node = s.b WHERE c.component < r.component GROUP BY s.b)
"""


@query("components_addresses")
def components_addresses(spark, sf):
    """Over all input addresses of the ledger."""
    return change.address_clusters(ledger.stored_transactions(spark, sf)).toDF("node", "component")


ORACLE_SQL["components_addresses"] = RSQL + _ADDRESS_COMP + "SELECT node, component FROM comp"


@query("partition_entropy")
def partition_entropy(spark, sf):
    got = metrics.partition_figures(_funder_components(spark, sf), "component")
    return got.select("clusters", *(F.round(c, 6).alias(c) for c in ("entropy", "effective_count", "largest_share")))


ORACLE_SQL["partition_entropy"] = _recursive(
    _FUND_EDGES, "SELECT node FROM node",
    ", z AS (SELECT count(*) AS n FROM comp GROUP BY component), q AS (SELECT n / (SELECT sum(n) FROM z) AS p FROM z) SELECT count(*) AS clusters, round(sum(-p * log2(p)), 6) AS entropy, round(pow(2, sum(-p * log2(p))), 6) AS effective_count, round(max(p), 6) AS largest_share FROM q",
)


@query(
    "adjusted_rand_index",
    """, n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL),
x AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM n) AS s, (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM n GROUP BY a)) AS pa,
 (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM n GROUP BY b)) AS pb, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM n) AS w)
SELECT round((s - pa * pb / w) / ((pa + pb) / 2 - pa * pb / w), 6) AS ari FROM x""",
)
def adjusted_rand_index(spark, sf):
    x = spark.read.parquet(f"{sf}/orders.parquet")
    return metrics.adjusted_rand_index(x, "o_orderstatus", "o_orderpriority").select(F.round("ari", 6).alias("ari"))


# --- the payment graph
_NEIGH = """, neigh AS (SELECT txid AS node, address AS cp FROM tx_out WHERE address IS NOT NULL UNION SELECT txid, address FROM tx_in WHERE address IS NOT NULL),
cb AS (SELECT cp, -log2(count(*) / (SELECT count(DISTINCT node) FROM neigh)) AS bits FROM neigh GROUP BY cp)
"""


@query("counterparty_bits", _NEIGH + "SELECT cp, round(bits, 6) AS bits FROM cb")
def counterparty_bits(spark, sf):
    return graph.counterparty_bits(graph.funder_neighbours(ledger.transactions(spark, sf))).withColumn("bits", F.round("bits", 6))


_PAY = """, pay AS (SELECT DISTINCT i.address AS src, o.address AS dst FROM tx_in i JOIN tx_out o USING (txid) WHERE o.address IS NOT NULL
  UNION SELECT DISTINCT o.address, i.address FROM tx_in i JOIN tx_out o USING (txid) WHERE o.address IS NOT NULL)
"""


@query("common_neighbours", _PAY + "SELECT x.src AS a, y.src AS b, count(*) AS n FROM pay x JOIN pay y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL")
def common_neighbours(spark, sf):
    return graph.common_neighbours(graph.pay_edges(ledger.transactions(spark, sf)))


@query(
    "khop2_overlap",
    _PAY + """, deg AS (SELECT src, count(*) AS d FROM pay GROUP BY src), one AS (SELECT src AS start, dst AS node FROM pay WHERE src <> dst),
two AS (SELECT DISTINCT o.start, p.dst AS node FROM one o JOIN deg d ON d.src = o.node AND d <= 100 JOIN pay p ON p.src = o.node WHERE p.dst <> o.start
  AND NOT EXISTS (SELECT 1 FROM one x WHERE x.start = o.start AND x.node = p.dst))
SELECT start, 1 AS hop, count(*) AS n FROM one GROUP BY start UNION ALL SELECT start, 2, count(*) FROM two GROUP BY start""",
)
def khop2_overlap(spark, sf):
    edges = graph.pay_edges(ledger.transactions(spark, sf))
    return graph.k_hop(edges, edges.select("src").distinct(), 2).groupBy("start", "hop").agg(F.count("*").alias("n"))


@query(
    "topology_weight_pairs",
    _NODES + _NEIGH + """, pr AS (SELECT DISTINCT a, b FROM pairs), ov AS (SELECT a, b, sum(bits) AS s FROM pr JOIN neigh x ON x.node = a JOIN neigh y ON y.node = b AND y.cp = x.cp JOIN cb ON cb.cp = x.cp GROUP BY a, b)
SELECT a, b, round(CASE WHEN s IS NULL THEN -1.65 ELSE least(s, 12) END, 6) AS topology FROM pr LEFT JOIN ov USING (a, b)""",
)
def topology_weight_pairs(spark, sf):
    txs = ledger.stored_transactions(spark, sf)
    neigh = graph.funder_neighbours(txs)
    pairs = refine.cospent_pairs(txs, _nodes(txs)).select("a", "b").distinct()
    return graph.topology_weight(pairs, neigh, graph.counterparty_bits(neigh)).withColumn("topology", F.round("topology", 6))


@query("cluster_bits_summary")
def cluster_bits_summary(spark, sf):
    """Over all input addresses and payments of the ledger."""
    txs = ledger.stored_transactions(spark, sf)
    members = change.address_clusters(txs).toDF("node", "cluster")
    return _bits_summary(graph.cluster_bits(members, graph.pay_edges(txs)).where("bits > 0"))


def _bits_summary(got):
    return got.agg(
        F.count("*").alias("clusters"), F.round(F.percentile("bits", F.lit(0.5)), 6).alias("median"), F.round(F.max("bits"), 6).alias("most"),
        *(F.round(F.avg((F.col("bits") >= t).cast("double")), 6).alias(f"share_{str(t).replace('.', '_')}") for t in (1.6, 10, 50, 100)),
    )


@query("graph_structure_auc")
def graph_structure_auc(spark, sf):
    """Do addresses of one cluster share payment neighbours more than addresses of different clusters?"""
    txs = ledger.stored_transactions(spark, sf)
    clusters = stored(change.address_clusters(txs), "address-clusters").select("cluster", "address")
    return graph_tests.structure_auc(clusters, graph.cospent_addresses(txs), graph.pay_edges(txs)).withColumn("auc", F.round("auc", 6))


# --- the engine
def _engine(spark, sf):
    txs = ledger.stored_transactions(spark, sf)
    from sparkloom.operators.entities import hub_addresses

    return refine.refine(txs, _nodes(txs), neigh=graph.funder_neighbours(txs), hubs=hub_addresses(txs), demix=conservation.coinjoin_demix(txs))


@query("refine_groups")
def refine_groups(spark, sf):
    return _engine(spark, sf).groups


@query("refine_refused")
def refine_refused(spark, sf):
    return _engine(spark, sf).refused


@query("refine_linked")
def refine_linked(spark, sf):
    """Links per node, those with itself and with nodes it was spent with left out.  They don't depend on the rounds."""
    txs = ledger.stored_transactions(spark, sf)
    nodes = _nodes(txs)
    return refine.link_counts(txs, nodes, refine.cospent_pairs(txs, nodes).select("a", "b").distinct())


@query("overcount_report")
def overcount_report(spark, sf):
    naive = metrics.partition_figures(_funder_components(spark, sf), "component").withColumn("partition", F.lit("naive"))
    return naive.unionByName(metrics.partition_figures(_engine(spark, sf).groups).withColumn("partition", F.lit("fused")))


# --- provenance
def _coins(txs):
    return txs.select("txid", F.posexplode("vout").alias("vout", "o")).select("txid", "vout")


def _walk_sql(depth: int = 4) -> str:
    """``e0`` to ``e<depth>``: coins of each seed by the step they were met at, with what spends them."""
    sql = """, s AS (SELECT prev_txid AS txid, prev_vout AS vout, min({'t': txid, 'v': vin}).t AS spender FROM tx_in GROUP BY ALL),
sp AS (SELECT s.*, n_in >= 20 AND n_out >= 20 AS mix FROM s JOIN tx_head h ON h.txid = s.spender),
l0 AS (SELECT txid || ':' || vout AS seed, txid, vout FROM tx_out), e0 AS (SELECT l0.*, spender, mix FROM l0 LEFT JOIN sp USING (txid, vout))"""
    for k in range(1, depth + 1):
        before = "".join(f" EXCEPT SELECT seed, txid, vout FROM l{j}" for j in range(k))
        sql += f""",
l{k} AS (SELECT DISTINCT seed, o.txid, o.vout FROM e{k - 1} JOIN tx_out o ON o.txid = e{k - 1}.spender WHERE NOT mix{before}),
e{k} AS (SELECT l{k}.*, spender, mix FROM l{k} LEFT JOIN sp USING (txid, vout))"""
    return sql + ", steps AS (" + " UNION ALL ".join(f"SELECT {k} AS depth, * FROM e{k}" for k in range(depth + 1)) + ") "


@query(
    "walk_frontier",
    _walk_sql() + """SELECT reason, depth, count(*) AS n FROM (SELECT depth, CASE WHEN spender IS NULL THEN 'unspent' WHEN mix THEN 'coinjoin' WHEN depth = 4 THEN 'depth' END AS reason FROM steps)
WHERE reason IS NOT NULL GROUP BY ALL""",
)
def walk_frontier(spark, sf):
    txs = ledger.stored_transactions(spark, sf)
    return provenance.walk_frontier(txs, _coins(txs))[0].groupBy("reason", "depth").agg(F.count("*").alias("n"))


@query(
    "walk_candidates",
    _walk_sql() + """SELECT spender AS txid, count(DISTINCT seed) AS seeds, h.n_in, h.n_out FROM steps JOIN tx_head h ON h.txid = spender WHERE NOT mix GROUP BY ALL HAVING count(DISTINCT seed) >= 2""",
)
def walk_candidates(spark, sf):
    txs = ledger.stored_transactions(spark, sf)
    got = provenance.walk_frontier(txs, _coins(txs))[1]
    return got.select("txid", "seeds", F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"))


def _signatures(spark, sf):
    txs = ledger.stored_transactions(spark, sf)
    return txs, provenance.signatures(txs, _coins(txs))


@query("ancestry_signature")
def ancestry_signature(spark, sf):
    return _signatures(spark, sf)[1].withColumn("mass", F.round("mass", 6))


@query("ancestry_entropy")
def ancestry_entropy(spark, sf):
    got = provenance.signature_entropy(_signatures(spark, sf)[1])
    return got.withColumn("shannon", F.round("shannon", 6)).withColumn("min_entropy", F.round("min_entropy", 6))


def _by_funder(found):
    """Signatures of first outputs, by funding transaction."""
    return found.where(F.col("target").endswith(":0")).select(F.substring_index("target", ":", 1).alias("coin"), "ancestor", "mass")


@query("provenance_link_pairs")
def provenance_link_pairs(spark, sf):
    txs, found = _signatures(spark, sf)
    pairs = refine.cospent_pairs(txs, _nodes(txs)).select("a", "b").distinct()
    sigs = _by_funder(found)
    return provenance.link_strength(pairs, sigs, provenance.rarity(sigs)).withColumn("link", F.round("link", 6))


@query("shared_origins")
def shared_origins(spark, sf):
    txs, found = _signatures(spark, sf)
    ins = txs.where(F.size("vin") >= 2).select(F.col("txid").alias("group"), F.explode("vin").alias("v")).where("v.funded")
    return provenance.intersect(ins.select("group", F.concat_ws(":", "v.txid", "v.vout").alias("coin")), found).withColumn("collapsed_bits", F.round("collapsed_bits", 6))


def _labels(found):
    """A seed label for the least coin of each ancestor that several coins share."""
    sigs = _by_funder(found)
    return sigs, sigs.groupBy("ancestor").agg(F.min("coin").alias("coin"), F.count("*").alias("n")).where("n >= 2").groupBy("coin").agg(F.min("ancestor").alias("label"))


@query("propagate_merge")
def propagate_merge(spark, sf):
    sigs, seeds = _labels(_signatures(spark, sf)[1])
    return provenance.propagate_labels(sigs, seeds, provenance.rarity(sigs))


@query("holdout_reid")
def holdout_reid(spark, sf):
    sigs, seeds = _labels(_signatures(spark, sf)[1])
    marked = provenance.holdout(seeds)
    got = provenance.propagate_labels(sigs, marked.where("not hidden").select("coin", "label"), provenance.rarity(sigs)).toDF("coin", "found")
    x = marked.where("hidden").join(got, "coin", "left")
    hit = F.coalesce(F.col("found") == F.col("label"), F.lit(False))
    return x.agg(F.count("*").alias("hidden"), F.count_if(hit).alias("recovered"), F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("rate"))


@query("split_clusters")
def split_clusters(spark, sf):
    txs, found = _signatures(spark, sf)
    clusters = _funder_components(spark, sf).toDF("node", "cluster")
    return provenance.split_clusters(clusters, _by_funder(found), _anchor_scores(txs, clusters))


def _anchor_scores(txs, clusters):
    """``(a, b, fp)`` of each cluster's least member and every other one."""
    of = txs.select(F.col("txid").alias("node"), evidence.features(evidence.NARROW).alias("f"))
    anchors = clusters.groupBy("cluster").agg(F.min("node").alias("a"))
    pairs = clusters.join(anchors, "cluster").where("node != a").select("a", F.col("node").alias("b"))
    return pairs.join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b").select("a", "b", evidence.score(evidence.narrow_axes(), "fa", "fb").alias("fp"))


@query("fused_report")
def fused_report(spark, sf):
    """Per output (null: a transaction without any): what each channel says; null where it has nothing to say."""
    from sparkloom.functions import amounts

    txs, found = _signatures(spark, sf)
    entropy = provenance.signature_entropy(found).select(F.substring_index("target", ":", 1).alias("txid"), F.substring_index("target", ":", -1).cast("int").alias("vout"), F.round("shannon", 6).alias("shannon"), "truncated")
    x = txs.withColumn("ranked", amounts.partitions())
    base = x.select("txid", F.size("vin").alias("n_in"), F.size("vout").alias("n_out"), F.round(amounts.ambiguity_bits(F.col("ranked")), 6).alias("ambiguity_bits"), amounts.partition_signal(F.col("ranked"))["payment"].alias("payment"))
    forced = conservation.forced_in_round(txs.where(F.size("vin") > 0).withColumn("known", F.get("vin", F.lit(0))["prevout"]["value"])).groupBy("txid").agg(F.sum(F.col("value") * F.col("forced")).alias("forced_value"))
    return base.join(entropy, "txid", "left").join(forced, "txid", "left")


# --- SQL of the queries above that need the values of all axes
def _values_sql(names) -> str:
    from sparkloom.plans.axis_queries import _AXIS_SQL

    return " UNION ALL ".join(f"SELECT '{k}' AS axis, txid, value FROM ({_AXIS_SQL[k]}) x{i}" for i, k in enumerate(names))


def _library_sql() -> str:
    """``lib(axis, value, p)`` of the wide axes, and ``miss(axis, bits)``, from the same constants."""
    rows = ", ".join(f"('{a.name}', '{v}', {p!r}::DOUBLE)" for a in _wide() for v, p in a.shares.items())
    return f"""lib(axis, value, p) AS (VALUES {rows}),
miss AS (SELECT axis, least(0, log2(0.05 / greatest(1 - sum(p * p), 1e-6))) AS bits FROM lib GROUP BY axis)"""


_FOLDED = f"""vals AS (SELECT axis, txid, CASE WHEN axis = 'locktime' AND starts_with(value, 'height') THEN 'height' ELSE value END AS value FROM ({_values_sql(sorted(_WIDE))}))"""
_COMPARED = f"""{SQL}{_REUSE}, {_FOLDED}, {_library_sql()},
cmp AS (SELECT r.a, r.b, x.axis, x.value = y.value AS same, lx.p, (lx.p IS NOT NULL OR ly.p IS NOT NULL) AS active, m.bits AS miss
  FROM reuse r JOIN vals x ON x.txid = r.a JOIN vals y ON y.txid = r.b AND y.axis = x.axis JOIN miss m ON m.axis = x.axis
  LEFT JOIN lib lx ON lx.axis = x.axis AND lx.value = x.value LEFT JOIN lib ly ON ly.axis = y.axis AND ly.value = y.value)
"""
ORACLE_SQL["fs_score_23axis_reuse_pairs"] = (
    _COMPARED + "SELECT a, b, round(sum(CASE WHEN NOT active THEN 0 WHEN same THEN -log2(p) ELSE miss END), 6) AS bits FROM cmp GROUP BY a, b"
)
ORACLE_SQL["oracle_m"] = _COMPARED + "SELECT axis, round(avg(CAST(same AS DOUBLE)) FILTER (active), 6) AS m FROM cmp GROUP BY axis"
ORACLE_SQL["fs_explain_cospent_pairs"] = (
    SQL + _NODES + _SEQ + """, p AS (SELECT DISTINCT a, b FROM pairs)
SELECT a, b, 'nsequence' AS axis, fa.s AS va, fb.s AS vb, round(CASE WHEN fa.s = fb.s THEN (SELECT bits FROM sb WHERE v = fa.s) ELSE ms END, 6) AS bits FROM p JOIN feat fa ON fa.txid = a JOIN feat fb ON fb.txid = b, cfg
UNION ALL SELECT a, b, 'locktime', fa.l, fb.l, round(CASE WHEN fa.l = fb.l THEN CASE WHEN fa.l = 'zero' THEN bz ELSE bh END ELSE ml END, 6) FROM p JOIN feat fa ON fa.txid = a JOIN feat fb ON fb.txid = b, cfg
UNION ALL SELECT a, b, 'in_order', fa.o, fb.o, round(CASE WHEN fa.o IN ('single', 'small_n') OR fb.o IN ('single', 'small_n') THEN NULL WHEN fa.o = fb.o THEN (SELECT bits FROM ob WHERE v = fa.o) ELSE mo END, 6) FROM p JOIN feat fa ON fa.txid = a JOIN feat fb ON fb.txid = b, cfg"""
)
ORACLE_SQL["cluster_bits_summary"] = RSQL + _ADDRESS_COMP + _PAY + """, mem AS (SELECT node, component AS cluster FROM comp),
big AS (SELECT cluster FROM mem GROUP BY cluster HAVING count(*) >= 2),
ext AS (SELECT DISTINCT cluster, dst FROM mem JOIN big USING (cluster) JOIN pay ON src = node),
outside AS (SELECT e.* FROM ext e WHERE NOT EXISTS (SELECT 1 FROM mem c WHERE c.cluster = e.cluster AND c.node = e.dst)),
w AS (SELECT dst, -log2(count(DISTINCT src) / (SELECT count(DISTINCT src) FROM pay)) AS bits FROM pay GROUP BY dst),
g AS (SELECT cluster, sum(bits) AS bits FROM outside JOIN w USING (dst) GROUP BY cluster HAVING sum(bits) > 0)
SELECT count(*) AS clusters, round(median(bits), 6) AS median, round(max(bits), 6) AS most, round(avg(CAST(bits >= 1.6 AS DOUBLE)), 6) AS share_1_6,
 round(avg(CAST(bits >= 10 AS DOUBLE)), 6) AS share_10, round(avg(CAST(bits >= 50 AS DOUBLE)), 6) AS share_50, round(avg(CAST(bits >= 100 AS DOUBLE)), 6) AS share_100 FROM g"""
