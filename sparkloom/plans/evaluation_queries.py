"""Queries over partitions from elsewhere, tests of the payment graph, fitted scorers, and exports; and SQL of queries
that draw by md5 or walk back through the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import evidence
from sparkloom.operators import change, conservation, entities, graph, graph_tests, measure, metrics, mixture, partitions, provenance, refine
from sparkloom.plans import graph_queries as g
from sparkloom.plans import label_queries as lq
from sparkloom.sources import exports, ledger

SQL = ledger.SQL
RSQL = g.RSQL
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


_AUC = """, rk AS (SELECT *, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS ties FROM sc),
rs AS (SELECT sum(lo + (ties - 1) / 2.0) FILTER (positive) AS s, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn FROM rk)"""
_AUC_OF = "round((s - np * (np + 1) / 2.0) / nullif(np * nn, 0), 6)"


def _hash(key: str, salt) -> str:
    return f"md5('{salt}|' || {key})"


def _next(key: str, salt, within: str = "") -> str:
    return f"lead({key}) OVER (PARTITION BY substr({_hash(key, salt)}, 1, 3){within} ORDER BY {_hash(key, salt)}, {key})"


# --- partitions from elsewhere
_FUNDERS = """, fnd AS (SELECT DISTINCT prev_txid AS node FROM tx_in), fe AS (SELECT txid, min(prev_txid) AS a, prev_txid AS b FROM tx_in GROUP BY txid, prev_txid),
hub AS (SELECT txid, min(prev_txid) AS h FROM tx_in GROUP BY txid), edge AS (SELECT DISTINCT h AS a, prev_txid AS b FROM tx_in JOIN hub USING (txid))"""
_COMP = """, sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(x, y) AS (SELECT node, node FROM fnd UNION SELECT r.x, s.b FROM reach r JOIN sym s ON s.a = r.y),
comp AS (SELECT x AS node, min(y) AS cluster FROM reach GROUP BY x)"""


@query("cospend_lookup", RSQL + _FUNDERS + _COMP + " SELECT node, cluster FROM comp")
def cospend_lookup(spark, sf):
    return partitions.cospend_lookup(ledger.transactions(spark, sf))


def _listed(txs):
    """A list of nodes: all transactions, by the time of their blocks."""
    return partitions.ordered(txs).select(F.col("txid").alias("node"), F.col("position").cast("bigint").alias("position"))


@query(
    "partition_from_lookup",
    RSQL + _FUNDERS + _COMP + """, lst AS (SELECT h.txid AS node, row_number() OVER (ORDER BY h.height, b.clock) AS position FROM tx_head h JOIN (SELECT DISTINCT txid, clock FROM base) b USING (txid))
SELECT l.node, l.position, coalesce(c.cluster, '_s' || l.position) AS cluster FROM lst l LEFT JOIN comp c ON c.node = l.node""",
)
def partition_from_lookup(spark, sf):
    txs = ledger.transactions(spark, sf)
    return partitions.from_lookup(_listed(txs), partitions.cospend_lookup(txs))


@query(
    "partition_from_assignment",
    SQL + ", lab AS (SELECT txid AS node, min(address) AS label FROM tx_in WHERE address IS NOT NULL GROUP BY txid) SELECT label, count(*) AS n, min(node) AS first FROM lab GROUP BY label",
)
def partition_from_assignment(spark, sf):
    """Transactions labelled by their least input address."""
    txs = ledger.transactions(spark, sf).select(F.col("txid").alias("node"), F.array_min(change.input_addresses()).alias("label")).where("label is not null")
    return partitions.from_assignment(txs)


_CURVE = """, lst AS (SELECT h.txid, row_number() OVER (ORDER BY h.height, b.clock) AS position FROM tx_head h JOIN (SELECT DISTINCT txid, clock FROM base) b USING (txid)),
cut AS (SELECT f AS fraction, greatest(1, CAST(floor((SELECT count(*) FROM lst) * f) AS BIGINT)) AS upto FROM (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(f)),
pin AS (SELECT c.fraction, i.txid, i.prev_txid FROM tx_in i JOIN lst USING (txid) JOIN cut c ON position <= upto),
fnd AS (SELECT DISTINCT fraction || '/' || prev_txid AS node FROM pin), hub AS (SELECT fraction, txid, min(prev_txid) AS h FROM pin GROUP BY ALL),
edge AS (SELECT DISTINCT p.fraction || '/' || h AS a, p.fraction || '/' || prev_txid AS b FROM pin p JOIN hub ON hub.fraction = p.fraction AND hub.txid = p.txid)"""


@query(
    "scale_curve",
    RSQL + _CURVE + _COMP + """, per AS (SELECT CAST(split_part(node, '/', 1) AS DOUBLE) AS fraction, count(*) AS funders, count(*) FILTER (node = cluster) AS entities FROM comp GROUP BY 1)
SELECT c.fraction, upto AS txs, funders, entities, round(entities / funders, 6) AS per_funder FROM cut c JOIN per USING (fraction)""",
)
def scale_curve(spark, sf):
    return partitions.scale_curve(ledger.transactions(spark, sf)).withColumn("per_funder", F.round("per_funder", 6))


@query("window_against_corpus")
def window_against_corpus(spark, sf):
    return partitions.window_against_corpus(ledger.transactions(spark, sf))


@query("ancestor_sample")
def ancestor_sample(spark, sf):
    """Back from the transactions of the last block."""
    txs = ledger.transactions(spark, sf)
    tip = txs.agg(F.max("height").alias("height"))
    return partitions.ancestor_sample(txs, txs.join(F.broadcast(tip), "height").select("txid"))  # one row


@query("bounded_sample")
def bounded_sample(spark, sf):
    """Whole co-spend clusters, the smallest first, as far as 90 nodes go, then groups that share an address up to 150."""
    txs = ledger.transactions(spark, sf)
    cospend = g._funder_components(spark, sf).toDF("node", "group")
    several = cospend.groupBy("group").agg(F.count("*").alias("n")).where("n >= 2").select("group")
    kept = partitions.bounded_groups(cospend.join(several, "group", "left_semi").select("group", "node"), 90)
    used = txs.select("txid", F.explode(change.input_addresses()).alias("address"))
    shared = used.groupBy("address").agg(F.min("txid").alias("src"), F.count("*").alias("n")).where("n >= 2")
    edges = used.join(shared, "address").select("src", F.col("txid").alias("dst"))
    reuse = g.connected_components(edges).toDF("node", "group").select("group", "node")
    more = partitions.bounded_groups(reuse, max(0, 150 - kept.select("node").distinct().count()), kept.select("node"))
    return kept.select("group", "node", F.lit("cospend").alias("kind")).unionByName(more.select("group", "node", F.lit("reuse").alias("kind")))


# --- fitted scorers
def _axes_sql():
    from sparkloom.plans.axis_queries import _AXIS_SQL

    return " UNION ALL ".join(f"SELECT '{k}' AS axis, value FROM ({_AXIS_SQL[k]}) x{i}" for i, k in enumerate(sorted(_AXIS_SQL)))


@query("combiner_fit")
def combiner_fit(spark, sf):
    """Per axis, from the ledger itself: rows, values, the chance that two agree, and the bits of a disagreement."""
    got = evidence.fitted(measure.measure(ledger.transactions(spark, sf)))
    return got.select("axis", "total", "n_values", F.round("collision", 6).alias("collision"), F.round("mismatch_bits", 6).alias("mismatch_bits"))


def _combiner_sql():
    return SQL + f""", vals AS ({_axes_sql()}), n AS (SELECT axis, value, count(*) AS n FROM vals GROUP BY ALL),
p AS (SELECT axis, n, n / sum(n) OVER (PARTITION BY axis) AS p FROM n)
SELECT axis, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_values, round(sum(p * p), 6) AS collision, round(least(0, log2(0.05 / greatest(1 - sum(p * p), 1e-6))), 6) AS mismatch_bits FROM p GROUP BY axis"""


ORACLE_SQL["combiner_fit"] = _combiner_sql()


def _labelled_sql() -> str:
    """``cmp``: all pairs of the mixture queries, axis by axis."""
    return (
        SQL + g._REUSE + f""", oth AS (SELECT txid AS a, {_next('txid', 1)} AS b FROM tx_head WHERE n_in > 0),
pr AS (SELECT a, b, 1 AS label FROM reuse UNION ALL SELECT a, b, 0 FROM oth WHERE b IS NOT NULL), {g._FOLDED}, {g._library_sql()},
cmp AS (SELECT r.a, r.b, r.label, x.axis, x.value = y.value AS same, (lx.p IS NOT NULL OR ly.p IS NOT NULL) AS active
  FROM pr r JOIN vals x ON x.txid = r.a JOIN vals y ON y.txid = r.b AND y.axis = x.axis JOIN miss m ON m.axis = x.axis
  LEFT JOIN lib lx ON lx.axis = x.axis AND lx.value = x.value LEFT JOIN lib ly ON ly.axis = y.axis AND ly.value = y.value)
"""
    )


def _order_sql() -> str:
    return "(VALUES " + ", ".join(f"('{k.name}', {i})" for i, k in enumerate(g._wide())) + ") ax(axis, k)"


ORACLE_SQL["agree_patterns"] = _labelled_sql() + f""", pt AS (SELECT string_agg(CASE WHEN NOT active THEN '-' WHEN same THEN '1' ELSE '0' END, '' ORDER BY k) AS pattern FROM cmp JOIN {_order_sql()} USING (axis) GROUP BY a, b, label)
SELECT pattern, count(*) AS n FROM pt GROUP BY pattern"""

_M, _SHARE = 0.9, 0.5


def _given(spark, sf):
    """Pair probabilities with the parameters from which the fits start."""
    pairs, wide = g._agreements(spark, sf)
    u = [k.collision for k in wide]
    return pairs, wide, u, pairs.select("a", "b", "label", F.round(mixture.pair_probability("agree", "active", [_M] * len(u), u, _SHARE), 6).alias("p"))


def _given_sql() -> str:
    return _labelled_sql() + f""", u AS (SELECT axis, greatest(1e-6, least(1 - 1e-6, sum(p * p))) AS u FROM lib GROUP BY axis),
lo AS (SELECT a, b, label, sum(CASE WHEN NOT active THEN 0 WHEN same THEN ln({_M} / u) ELSE ln((1 - {_M}) / (1 - u)) END) AS o FROM cmp JOIN u USING (axis) GROUP BY ALL),
pp AS (SELECT a, b, label, round(1 / (1 + exp(-o)), 6) AS p FROM lo)
"""


@query("pair_probs_given", _given_sql() + "SELECT a, b, label, p FROM pp")
def pair_probs_given(spark, sf):
    return _given(spark, sf)[3]


@query(
    "ece_given",
    _given_sql() + """, bn AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(label) AS acc FROM pp GROUP BY 1) SELECT round(sum(n * abs(c - acc)) / sum(n), 6) AS ece FROM bn""",
)
def ece_given(spark, sf):
    return metrics.expected_calibration_error(_given(spark, sf)[3]).withColumn("ece", F.round("ece", 6))


@query("auc_given", _given_sql() + ", sc AS (SELECT p AS score, label = 1 AS positive FROM pp)" + _AUC + f" SELECT {_AUC_OF} AS auc, np AS n_pos, nn AS n_neg FROM rs")
def auc_given(spark, sf):
    x = _given(spark, sf)[3].select(F.col("p").alias("score"), (F.col("label") == 1).alias("positive"))
    return metrics.auc(x).withColumn("auc", F.round("auc", 6))


@query(
    "em_first_round",
    _given_sql() + """, rr AS (SELECT a, b, label, 1 / (1 + exp(-o)) AS r FROM lo)
SELECT axis, round(greatest(1e-6, least(1 - 1e-6, sum(r * CAST(same AS INT)) / sum(r))), 6) AS m FROM cmp JOIN rr USING (a, b, label) WHERE active GROUP BY axis""",
)
def em_first_round(spark, sf):
    """One round of expectation-maximisation."""
    pairs, wide, u, _ = _given(spark, sf)
    got = mixture.em_fit(mixture.patterns(pairs), u, max_iter=1)
    heard = pairs.select(F.posexplode("active").alias("j", "on")).where("on").select("j").distinct()
    rows = spark.createDataFrame([(j, k.name, round(float(m), 6)) for j, (k, m) in enumerate(zip(wide, got.m, strict=True))], "j int, axis string, m double")
    return rows.join(heard, "j", "left_semi").select("axis", "m")


@query("cluster_band")
def cluster_band(spark, sf):
    """Clusters of transactions under draws of the fitted mixture: mean and 95 % band."""
    pairs, wide = g._agreements(spark, sf)
    u = [k.collision for k in wide]
    fit = mixture.gibbs_fit(mixture.patterns(pairs), u)
    return mixture.cluster_band(pairs.where("label = 1"), u, fit)


# --- SQL of queries that draw by md5
ORACLE_SQL["uniform_sample"] = SQL + f""", hh AS (SELECT DISTINCT height FROM tx_head WHERE height >= 10 ORDER BY {_hash('height', 7)}, height LIMIT 50),
k AS (SELECT txid, height, row_number() OVER (PARTITION BY height ORDER BY {_hash('txid', 7)}, txid) AS k FROM tx_head SEMI JOIN hh USING (height)) SELECT txid, height FROM k WHERE k <= 2""".replace(
    "SELECT DISTINCT height FROM tx_head WHERE height >= 10 ORDER BY", "SELECT height FROM (SELECT DISTINCT height FROM tx_head WHERE height >= 10) ORDER BY"
)
ORACLE_SQL["shuffle_auc"] = SQL + f""", tw AS (SELECT txid, max(value) FILTER (vout = 0) AS x, max(value) FILTER (vout = 1) AS y, substr({_hash('txid', 0)}, 1, 1) >= '8' AS flip FROM tx_out GROUP BY txid HAVING count(*) = 2),
sc AS (SELECT CASE WHEN flip THEN y ELSE x END AS score, true AS positive FROM tw UNION ALL SELECT CASE WHEN flip THEN x ELSE y END, false FROM tw)""" + _AUC + f" SELECT {_AUC_OF} AS auc, np AS n_pos, nn AS n_neg FROM rs"
_STEPS = " + ".join(f"CAST(u > {x!r}::DOUBLE AS INT)" for x in metrics.poisson_steps())
ORACLE_SQL["bootstrap_ci"] = SQL + lq._CAND + lq._ROUNDER + f""", fl AS (SELECT txid, coalesce(pos = ci, false) AS tpr, coalesce(pos <> ci, false) AS fpr FROM (SELECT * FROM lab WHERE name = 'type_match' AND ci IS NOT NULL) LEFT JOIN rounder USING (txid)),
dr AS (SELECT round, tpr, fpr, (('0x' || substr(md5('0|' || txid || '|' || round), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM fl CROSS JOIN (SELECT unnest(range(2000)) AS round)),
w AS (SELECT round, tpr, fpr, {_STEPS} AS w FROM dr), mn AS (SELECT sum(w * CAST(tpr AS INT)) / nullif(sum(w), 0) AS tpr, sum(w * CAST(fpr AS INT)) / nullif(sum(w), 0) AS fpr FROM w GROUP BY round),
lg AS (SELECT 'tpr' AS name, tpr AS v FROM mn UNION ALL SELECT 'fpr', fpr FROM mn)
SELECT name, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.5), 6) AS mid, round(quantile_cont(v, 0.975), 6) AS high FROM lg GROUP BY name"""


# --- the payment graph
_GRAPH = g._PAY + """, ia AS (SELECT DISTINCT txid, address AS a FROM tx_in WHERE address IS NOT NULL), hub AS (SELECT txid, min(a) AS h FROM ia GROUP BY txid),
edge AS (SELECT DISTINCT h AS a, ia.a AS b FROM ia JOIN hub USING (txid)), fnd AS (SELECT DISTINCT a AS node FROM ia)""" + _COMP + """,
cs AS (SELECT DISTINCT x.a AS a, y.a AS b FROM ia x JOIN ia y ON x.txid = y.txid AND x.a < y.a)"""
_SHARED = "(SELECT count(*) FROM pay x JOIN pay y ON x.src = {0}.a AND y.src = {0}.b AND y.dst = x.dst)"


def _scored_pairs_sql(salt: int) -> str:
    return f""", ng AS (SELECT node, cluster, {_next('node', salt)} AS o FROM comp),
neg AS (SELECT least(n.node, o) AS a, greatest(n.node, o) AS b FROM ng n JOIN comp c ON c.node = o WHERE c.cluster <> n.cluster),
cm AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM pay x JOIN pay y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL),
pos AS (SELECT x.node AS a, y.node AS b FROM comp x JOIN comp y ON x.cluster = y.cluster AND x.node < y.node ANTI JOIN cs ON cs.a = x.node AND cs.b = y.node),
sc AS (SELECT coalesce(n, 0) AS score, true AS positive FROM pos LEFT JOIN cm USING (a, b) UNION ALL SELECT coalesce(n, 0), false FROM neg LEFT JOIN cm USING (a, b))"""


ORACLE_SQL["graph_structure_auc"] = RSQL + _GRAPH + _scored_pairs_sql(3) + _AUC + f" SELECT {_AUC_OF} AS auc, np AS n_pos, nn AS n_neg FROM rs"


def _clustered(spark, sf):
    txs = ledger.transactions(spark, sf)
    from sparkloom.operators.shared import stored

    return txs, stored(change.address_clusters(txs), "address-clusters").select("cluster", "address"), graph.cospent_addresses(txs)


@query("graph_structure_full_auc")
def graph_structure_full_auc(spark, sf):
    """As graph_structure_auc, over all addresses of a transaction as neighbours."""
    txs, clusters, cospent = _clustered(spark, sf)
    return graph_tests.structure_auc(clusters, cospent, graph.full_edges(txs)).withColumn("auc", F.round("auc", 6))


@query("depth_sweep")
def depth_sweep(spark, sf):
    txs, clusters, cospent = _clustered(spark, sf)
    return graph_tests.depth_sweep(clusters, cospent, graph.pay_edges(txs)).withColumn("auc", F.round("auc", 6)).withColumn("share", F.round("share", 6))


def _entities(txs):
    found = entities.detect_bitmex(txs).select("address", F.lit("bitmex").alias("entity"))
    return found.unionByName(entities.detect_satoshidice(txs).select("address", F.lit("satoshidice").alias("entity"))).distinct()


@query("entity_partition", SQL + lq._ADDR + "SELECT DISTINCT CASE WHEN starts_with(address, '3BMEX') THEN 'bitmex' ELSE 'satoshidice' END AS cluster, address FROM adr WHERE starts_with(address, '3BMEX') OR starts_with(address, '1dice')")
def entity_partition(spark, sf):
    return graph_tests.entity_partition(_entities(ledger.transactions(spark, sf)))


@query(
    "entity_auc",
    RSQL + _GRAPH + f""", ev AS (SELECT DISTINCT src AS node FROM pay), ent AS (SELECT node, CASE WHEN starts_with(node, '3BMEX') THEN 'bitmex' WHEN starts_with(node, '1dice') THEN 'satoshidice' END AS e FROM ev),
ng AS (SELECT node, e, {_next('node', 5)} AS o FROM ent), neg AS (SELECT least(n.node, o) AS a, greatest(n.node, o) AS b FROM ng n JOIN ent x ON x.node = o WHERE (n.e IS NULL) <> (x.e IS NULL)),
pos AS (SELECT x.node AS a, y.node AS b FROM ent x JOIN ent y ON x.e = y.e AND x.node < y.node ANTI JOIN cs ON cs.a = x.node AND cs.b = y.node),
cm AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM pay x JOIN pay y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL),
sc AS (SELECT coalesce(n, 0) AS score, true AS positive FROM pos LEFT JOIN cm USING (a, b) UNION ALL SELECT coalesce(n, 0), false FROM neg LEFT JOIN cm USING (a, b))"""
    + _AUC + f" SELECT (SELECT count(*) FROM (SELECT e FROM ent WHERE e IS NOT NULL GROUP BY e HAVING count(*) >= 2)) AS entities, {_AUC_OF} AS auc, np AS n_pos, nn AS n_neg FROM rs",
)
def entity_auc(spark, sf):
    txs = ledger.transactions(spark, sf)
    partition = graph_tests.entity_partition(_entities(txs))
    return graph_tests.entity_auc(partition, graph.cospent_addresses(txs), graph.pay_edges(txs)).withColumn("auc", F.round("auc", 6))


@query(
    "overlap_calibration",
    RSQL + _GRAPH + f""", tc AS (SELECT node, cluster FROM comp SEMI JOIN pay ON pay.src = node), sz AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY {_hash('node', 11)}, node) AS k FROM tc),
hv AS (SELECT cluster, node, CASE WHEN k <= n // 2 THEN 0 ELSE 1 END AS half FROM sz WHERE n >= 2), cb AS (SELECT dst AS cp, -log2(count(*) / (SELECT count(DISTINCT src) FROM pay)) AS bits FROM pay GROUP BY dst),
th AS (SELECT DISTINCT cluster, half, dst AS cp FROM hv JOIN pay ON src = node), tw AS (SELECT DISTINCT cluster, cp FROM th), nm AS (SELECT DISTINCT cluster FROM hv),
sm AS (SELECT cluster, (SELECT sum(bits) FROM th x JOIN th y USING (cluster, cp) JOIN cb USING (cp) WHERE x.half = 0 AND y.half = 1 AND x.cluster = nm.cluster) AS v FROM nm),
cx AS (SELECT least(cluster, o) AS a, greatest(cluster, o) AS b FROM (SELECT cluster, {_next('cluster', 11)} AS o FROM nm) WHERE o IS NOT NULL),
cv AS (SELECT a, b, (SELECT sum(bits) FROM tw x JOIN tw y USING (cp) JOIN cb USING (cp) WHERE x.cluster = cx.a AND y.cluster = cx.b) AS v FROM cx),
sc AS (SELECT round(least(coalesce(v, 0), 12), 9) AS score, true AS positive FROM sm UNION ALL SELECT round(least(coalesce(v, 0), 12), 9), false FROM cv)"""
    + _AUC + f" SELECT (SELECT count(*) FROM nm) AS clusters, round((SELECT avg(score) FROM sc WHERE positive), 6) AS same_mean, round((SELECT avg(score) FROM sc WHERE NOT positive), 6) AS cross_mean, {_AUC_OF} AS auc FROM rs",
)
def overlap_calibration(spark, sf):
    txs, clusters, _ = _clustered(spark, sf)
    got = graph_tests.overlap_calibration(clusters, graph.pay_edges(txs))
    return got.select("clusters", *(F.round(c, 6).alias(c) for c in ("same_mean", "cross_mean", "auc")))


def _temporal_sql() -> str:
    hours = lambda cond: "[" + ", ".join(f"count(*) FILTER ({cond}h = {x})" for x in range(24)) + "]"
    gap = lambda a, b: f"round(-(CASE WHEN list_sum({a}) = 0 OR list_sum({b}) = 0 THEN 0.0 ELSE list_sum(list_transform(range(1, 25), lambda i: abs({a}[i] / list_sum({a}) - {b}[i] / list_sum({b})))) / 2 END), 9)"
    half = lambda name, order: f"""{name}k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS k FROM ev),
{name} AS (SELECT user_id, {hours('k <= n // 2 AND ')} AS a, {hours('k > n // 2 AND ')} AS b FROM {name}k GROUP BY user_id)"""  # noqa: E731
    figure = lambda pos, neg: f"""(SELECT {_AUC_OF} FROM (SELECT sum(lo + (ties - 1) / 2.0) FILTER (positive) AS s, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn FROM
  (SELECT *, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS ties FROM (SELECT {gap('a', 'b')} AS score, true AS positive FROM {pos} UNION ALL SELECT score, false FROM {neg}))))"""  # noqa: E731
    return f"""WITH ev AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts)) AS BIGINT) // 3600 % 24 AS h, count(*) OVER (PARTITION BY user_id) AS n FROM events QUALIFY n >= 8),
{half('rh', "md5('0|' || user_id || '|' || sec), sec")}, {half('th', 'sec')},
wh AS (SELECT user_id, {hours('')} AS hours, count(DISTINCT h) AS band FROM ev GROUP BY user_id),
n1 AS (SELECT x.hours AS a, y.hours AS b FROM (SELECT *, {_next('user_id', 0)} AS o FROM wh) x JOIN wh y ON y.user_id = x.o), s1 AS (SELECT {gap('a', 'b')} AS score FROM n1),
n2 AS (SELECT x.hours AS a, y.hours AS b FROM (SELECT *, {_next('user_id', 0, ', band')} AS o FROM wh) x JOIN wh y ON y.user_id = x.o), s2 AS (SELECT {gap('a', 'b')} AS score FROM n2)
SELECT {figure('rh', 's1')} AS baseline_auc, {figure('th', 's1')} AS persistence_auc, {figure('th', 's2')} AS matched_auc"""


ORACLE_SQL["calibrate_temporal"] = _temporal_sql()


# --- the engine's links
ORACLE_SQL["refine_linked"] = SQL + g._NODES + g._SEQ + f""", nf AS (SELECT txid, s, l, o FROM feat SEMI JOIN node ON node.node = feat.txid), kd AS (SELECT s, l, o, count(*) AS n FROM nf GROUP BY ALL),
st AS (SELECT fa.s AS s, fa.l AS l, fa.o AS o, sum(fb.n) AS n, bool_or(fa.s = fb.s AND fa.l = fb.l AND fa.o = fb.o) AS own FROM kd fa, kd fb, cfg WHERE {g._FP} >= 4 GROUP BY ALL),
sp AS (SELECT DISTINCT a, b FROM pairs UNION SELECT b, a FROM pairs), hit AS (SELECT sp.a, count(*) AS n FROM sp JOIN nf fa ON fa.txid = sp.a JOIN nf fb ON fb.txid = sp.b, cfg WHERE {g._FP} >= 4 GROUP BY sp.a)
SELECT nf.txid AS node, CAST(coalesce(st.n, 0) - CAST(coalesce(own, false) AS INT) - coalesce(hit.n, 0) AS BIGINT) AS links FROM nf LEFT JOIN st ON st.s = nf.s AND st.l = nf.l AND st.o = nf.o LEFT JOIN hit ON hit.a = nf.txid"""


# --- provenance, by walking back in SQL.  Where no part of a transaction balances by itself, as in these tables, every
# --- input funds every output alike.
_SIG = """, okt AS (SELECT h.txid, n_in FROM tx_head h JOIN (SELECT txid, sum(value) AS v FROM tx_in GROUP BY 1) i USING (txid) JOIN (SELECT txid, sum(value) AS v FROM tx_out GROUP BY 1) o USING (txid) WHERE i.v >= o.v),
fe AS (SELECT o.txid || ':' || o.vout AS coin, i.prev_txid || ':' || i.prev_vout AS parent, 1.0::DOUBLE / n_in AS weight FROM okt JOIN tx_out o USING (txid) JOIN tx_in i USING (txid)),
coin AS (SELECT txid || ':' || vout AS coin, txid IN (SELECT txid FROM okt) AS ok FROM tx_out),
lv(target, coin, level) AS (SELECT coin, coin, 0 FROM coin UNION SELECT lv.target, fe.parent, lv.level + 1 FROM lv JOIN fe ON fe.coin = lv.coin WHERE lv.level < 6),
met AS (SELECT target, coin, min(level) AS level FROM lv GROUP BY ALL),
kind AS (SELECT m.target, m.coin, m.level < 6 AND coalesce(c.ok, false) AS moves, m.level < 6 AND NOT coalesce(c.ok, true) AS cut FROM met m LEFT JOIN coin c ON c.coin = m.coin),
ps(target, coin, mass) AS (SELECT coin, coin, 1.0::DOUBLE FROM coin UNION ALL SELECT ps.target, fe.parent, ps.mass * fe.weight FROM ps JOIN kind k ON k.target = ps.target AND k.coin = ps.coin AND k.moves JOIN fe ON fe.coin = ps.coin),
sig AS (SELECT ps.target, ps.coin AS ancestor, sum(mass) AS mass, k.cut FROM ps JOIN kind k ON k.target = ps.target AND k.coin = ps.coin WHERE NOT k.moves GROUP BY ALL),
fs AS (SELECT split_part(target, ':', 1) AS coin, ancestor, mass FROM sig WHERE ends_with(target, ':0')),
rare AS (SELECT ancestor, CASE WHEN count(*) > 1 THEN 1 / log2(count(*) + 1) ELSE 1.0 END AS w FROM fs GROUP BY ancestor)
"""
ORACLE_SQL["ancestry_signature"] = RSQL + _SIG + "SELECT target, ancestor, round(mass, 6) AS mass, cut FROM sig"
ORACLE_SQL["ancestry_entropy"] = RSQL + _SIG + "SELECT target, round(sum(-mass * log2(mass)), 6) + 0 AS shannon, round(-log2(max(mass)), 6) + 0 AS min_entropy, count(*) AS n_absorbers, count(*) FILTER (cut) AS truncated FROM sig GROUP BY target"
_LINK = "(SELECT sum(least(x.mass, y.mass) * w) FROM fs x JOIN fs y USING (ancestor) JOIN rare USING (ancestor) WHERE x.coin = p.a AND y.coin = p.b)"
ORACLE_SQL["provenance_link_pairs"] = RSQL + _SIG + g._NODES + f"SELECT a, b, round(coalesce({_LINK}, 0), 6) AS link FROM (SELECT DISTINCT a, b FROM pairs) p"
ORACLE_SQL["shared_origins"] = RSQL + _SIG + """, br AS (SELECT DISTINCT i.txid AS grp, prev_txid || ':' || prev_vout AS coin FROM tx_in i JOIN tx_head h USING (txid) WHERE h.n_in >= 2 AND funded),
ss AS (SELECT target AS coin, count(*) AS size, count(*) FILTER (cut) AS cuts FROM sig GROUP BY target),
ea AS (SELECT grp, br.coin, coalesce(size, 0) AS size, coalesce(cuts, 0) AS cuts FROM br LEFT JOIN ss USING (coin)),
su AS (SELECT grp, count(*) AS branches, min(size) AS smallest, bool_or(cuts >= size) AS blind FROM ea GROUP BY grp),
an AS (SELECT grp, ancestor, count(*) AS n FROM br JOIN sig ON sig.target = br.coin GROUP BY ALL), sh AS (SELECT an.grp, count(*) AS shared FROM an JOIN su USING (grp) WHERE an.n = su.branches GROUP BY an.grp)
SELECT grp AS "group", branches, smallest, coalesce(shared, 0) AS shared, greatest(0, smallest - coalesce(shared, 0)) AS collapsed, CASE WHEN smallest > 0 AND shared > 0 THEN round(log2(smallest / shared), 6) END AS collapsed_bits, blind, false AS scored
FROM su LEFT JOIN sh USING (grp)"""
ORACLE_SQL["split_clusters"] = (
    RSQL + _SIG + g._NODES + g._SEQ + """, fnd AS (SELECT node FROM node), edge AS (SELECT DISTINCT a, b FROM pairs)""" + _COMP + f""",
anc AS (SELECT cluster, min(node) AS a FROM comp GROUP BY cluster), pq AS (SELECT a, node AS b FROM comp JOIN anc USING (cluster) WHERE node <> a),
gone AS (SELECT b FROM pq p JOIN feat fa ON fa.txid = p.a JOIN feat fb ON fb.txid = p.b, cfg WHERE {g._FP} < -2 AND coalesce((SELECT sum(least(x.mass, y.mass)) FROM fs x JOIN fs y USING (ancestor) WHERE x.coin = p.a AND y.coin = p.b), 0) <= 1e-9)
SELECT node, CASE WHEN node IN (SELECT b FROM gone) THEN node ELSE cluster END AS cluster FROM comp"""
)
ORACLE_SQL["fused_report"] = RSQL + _SIG + lq._PART + """, en AS (SELECT split_part(target, ':', 1) AS txid, CAST(split_part(target, ':', 2) AS INTEGER) AS vout, round(sum(-mass * log2(mass)), 6) + 0 AS shannon, count(*) FILTER (cut) AS truncated FROM sig GROUP BY target),
tot AS (SELECT txid, CAST(sum(value) AS BIGINT) AS total, max(value) FILTER (vin = 0) AS known FROM tx_in GROUP BY txid), cnt AS (SELECT o.txid, total, known, o.value, count(*) AS present FROM tx_out o JOIN tot USING (txid) GROUP BY ALL),
fo AS (SELECT txid, CAST(sum(value * (present - (total - known) // value)) AS BIGINT) AS forced_value FROM cnt WHERE value > 0 AND present - (total - known) // value >= 1 GROUP BY txid)
SELECT h.txid, CAST(n_in AS INTEGER) AS n_in, CAST(n_out AS INTEGER) AS n_out, round(log2(r.n), 6) AS ambiguity_bits, r.payment, en.vout, en.shannon, en.truncated, fo.forced_value
FROM tx_head h LEFT JOIN ranked r ON r.txid = h.txid AND r.k = 1 LEFT JOIN en ON en.txid = h.txid LEFT JOIN fo ON fo.txid = h.txid"""


@query(
    "seed_labels",
    RSQL + _SIG + """, sd AS (SELECT coin, min(ancestor) AS label FROM (SELECT ancestor, min(coin) AS coin, count(*) AS n FROM fs GROUP BY ancestor) WHERE n >= 2 GROUP BY coin),
rk AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || coin), coin) AS k, count(*) OVER () AS n FROM sd)
SELECT coin, label, k <= least(greatest(1, floor(n * 0.3)), greatest(n - 1, 0)) AS hidden FROM rk""",
)
def seed_labels(spark, sf):
    """The labels that propagation starts from, and those that the hold-out test hides."""
    _, seeds = g._labels(g._signatures(spark, sf)[1])
    return provenance.holdout(seeds).select("coin", "label", "hidden")


@query("propagation_run")
def propagation_run(spark, sf):
    """Both moves at once: clusters after the splits, and labels after the spread."""
    from sparkloom.operators.shared import stored

    sigs, seeds = g._labels(g._signatures(spark, sf)[1])
    txs = ledger.transactions(spark, sf)
    clusters = stored(g._funder_components(spark, sf).toDF("node", "cluster"), "run-clusters")
    return provenance.propagate_and_refine(clusters, stored(seeds, "run-seeds"), stored(sigs, "run-sigs"), g._anchor_scores(txs, clusters))


@query("origin_ranks")
def origin_ranks(spark, sf):
    """Origins that all branches of a transaction share, the heaviest first."""
    txs, found = g._signatures(spark, sf)
    ins = txs.where(F.size("vin") >= 2).select(F.col("txid").alias("group"), F.explode("vin").alias("v")).where("v.funded")
    branches = ins.select("group", F.concat_ws(":", "v.txid", "v.vout").alias("coin"))
    sigs = found.select(F.col("target").alias("coin"), "ancestor", "mass")
    return provenance.ranked_origins(branches, sigs, provenance.rarity(sigs)).select("group", "ancestor", F.round("mass", 6).alias("mass"), F.round("weight", 6).alias("weight"), "position")


@query("score_candidates")
def score_candidates(spark, sf):
    """What the engine says of each transaction that joins two walks or more."""
    txs = ledger.transactions(spark, sf)
    candidates = provenance.walk_frontier(txs, g._coins(txs))[1]
    return refine.score_candidates(txs, candidates)


@query("intersection_run")
def intersection_run(spark, sf):
    """Walk forward, walk back from what meets, narrow, and let the engine decide."""
    txs = ledger.transactions(spark, sf)
    return refine.intersection_run(txs, g._coins(txs))


# --- amounts and coins that the tables must be bent to show
@query(
    "candidate_coins_anchor",
    SQL + lq._SEEDS + """, anc AS (SELECT txid, max(value) AS v FROM tx_in GROUP BY txid), fd AS (SELECT i.txid, i.vin, i.value, i.script_type FROM tx_in i SEMI JOIN known k ON k.txid = i.prev_txid),
kk AS (SELECT fd.*, anc.v, row_number() OVER (PARTITION BY fd.txid, fd.value ORDER BY vin) AS k FROM fd JOIN anc USING (txid)) SELECT txid, value, script_type, count(*) AS n FROM kk WHERE value <> v OR k > 1 GROUP BY ALL""",
)
def candidate_coins_anchor(spark, sf):
    """Without one coin of the largest input's amount."""
    txs = ledger.transactions(spark, sf)
    anchor = txs.select("txid", F.array_max(F.transform("vin", lambda v: v["prevout"]["value"])).alias("anchor_value")).where("anchor_value is not null")
    return conservation.candidate_coins(txs, lq._seeds(txs), anchor)


@query(
    "entity_labels_with_pools",
    SQL + lq._ADDR + """SELECT DISTINCT txid, 'bitmex' AS detector FROM adr WHERE starts_with(address, '3BMEX') UNION ALL
SELECT DISTINCT txid, 'satoshidice' FROM adr WHERE starts_with(address, '1dice') UNION ALL SELECT txid, 'mining_pool' FROM tx_head WHERE n_in = 0 UNION ALL
SELECT txid, 'consolidation' FROM tx_head WHERE n_in >= 10 AND n_out <= 2 UNION ALL
SELECT txid, 'batching' FROM tx_head JOIN (SELECT txid, count(*) FILTER (value <= 1000) AS dust FROM tx_out GROUP BY txid) USING (txid) WHERE n_out >= 10 AND n_out >= 4 * greatest(1, n_in) AND dust <= 0.5 * n_out UNION ALL
SELECT txid, 'dust_fanout' FROM tx_out GROUP BY txid HAVING count(*) >= 20 AND count(*) FILTER (value <= 1000) >= 0.9 * count(*)""",
)
def entity_labels_with_pools(spark, sf):
    return entities.entity_labels(lq._with_tags(ledger.transactions(spark, sf)), "coinbase")


# --- exports
def chain(spark, sf):
    """The ledger as a chain table."""
    txs = ledger.transactions(spark, sf)
    kinds = {b: a for a, b in exports.CHAIN_TYPES.items()}
    back = lambda t: F.coalesce(*(F.when(t == a, F.lit(b)) for a, b in kinds.items()), t)
    addresses = lambda a: F.when(a.isNull(), F.array().cast("array<string>")).otherwise(F.array(a))
    day = F.to_date(F.timestamp_seconds("block_time"))
    return txs.select(
        F.col("txid").alias("hash"), F.col("height").alias("block_number"), F.col("block_time").alias("seconds"), day.alias("day"), F.trunc(day, "month").alias("month"), "version", F.col("locktime").alias("lock_time"), "fee",
        (F.col("weight") / 4).cast("bigint").alias("virtual_size"), (F.size("vin") == 0).alias("is_coinbase"),
        F.transform("vin", lambda v: F.struct(v["txid"].alias("spent_transaction_hash"), v["vout"].cast("int").alias("spent_output_index"), v["sequence"].alias("sequence"), v["prevout"]["value"].alias("value"), back(v["prevout"]["scriptpubkey_type"]).alias("type"), addresses(v["prevout"]["scriptpubkey_address"]).alias("addresses"))).alias("inputs"),
        F.transform("vout", lambda o: F.struct(o["value"].alias("value"), back(o["scriptpubkey_type"]).alias("type"), addresses(o["scriptpubkey_address"]).alias("addresses"))).alias("outputs"),
    )


_DAY = "CAST(to_timestamp(block_time) AT TIME ZONE 'UTC' AS DATE)"


@query("uniform_export", SQL + f"SELECT txid, height FROM tx_head WHERE n_in > 0 AND substr({_hash('txid', 0)}, 1, 8) < '19999999'")
def uniform_export(spark, sf):
    return exports.export_sample(chain(spark, sf), 10.0).select("txid", "height")


@query("small_export")
def small_export(spark, sf):
    """A tenth of the chain's transactions as JSON, 15,000 of them at most."""
    return exports.export_sample(chain(spark, sf), 10.0, limit=15_000)


@query(
    "contiguous_slice",
    SQL + f"""SELECT h.txid, height, version, locktime, i.n AS inputs, i.v AS paid, coalesce(o.n, 0) AS outputs, o.v AS received FROM tx_head h JOIN (SELECT txid, count(*) AS n, CAST(sum(value) AS BIGINT) AS v FROM tx_in GROUP BY txid) i USING (txid)
LEFT JOIN (SELECT txid, count(*) AS n, CAST(sum(value) AS BIGINT) AS v FROM tx_out GROUP BY txid) o USING (txid) WHERE {_DAY} BETWEEN DATE '1996-03-01' AND DATE '1996-04-15'""",
)
def contiguous_slice(spark, sf):
    """Six weeks of the chain, from a table that is partitioned by day."""
    from sparkloom.operators.shared import scratch

    path = scratch(spark, "chain-by-month")
    chain(spark, sf).repartition("month").write.partitionBy("month").parquet(path)
    days = spark.read.parquet(path).where("month between date'1996-03-01' and date'1996-04-01'")
    got = exports.contiguous_slice(days, "1996-03-01", "1996-04-15", values=True)
    total = lambda c, f: F.aggregate(F.transform(c, f), F.lit(None).cast("bigint"), lambda s, v: F.coalesce(s, F.lit(0)) + v)
    return got.select(
        "txid", "height", "version", "locktime", F.size("vin").cast("bigint").alias("inputs"), total("vin", lambda v: v["prevout"]["value"]).alias("paid"),
        F.size("vout").cast("bigint").alias("outputs"), total("vout", lambda o: o["value"]).alias("received"),
    )


@query(
    "graph_slice",
    SQL + f"SELECT i.txid, height, vin AS position, address FROM tx_in i JOIN tx_head h USING (txid) WHERE height BETWEEN 400 AND 430 AND date_trunc('month', {_DAY}) = DATE '1996-02-01'",
)
def graph_slice(spark, sf):
    got = exports.graph_slice(chain(spark, sf), "1996-02-01", 400, 430)
    return got.select("txid", "height", F.posexplode("sources").alias("position", "address")).withColumn("position", F.col("position").cast("bigint"))


@query(
    "temporal_cospend",
    SQL + f"""SELECT a AS addr, count(*) AS n, min(block_time) AS first, max(block_time) AS last FROM (SELECT txid, min(address) AS a FROM tx_in GROUP BY txid) JOIN tx_head USING (txid)
WHERE a IS NOT NULL AND date_trunc('month', {_DAY}) = DATE '1996-02-01' GROUP BY a HAVING count(*) BETWEEN 1 AND 200""",
)
def temporal_cospend(spark, sf):
    """With at least one time, since the tables have few a month."""
    got = exports.cospend_times(chain(spark, sf), "1996-02-01", least=1)
    return got.select("addr", F.size("times").cast("bigint").alias("n"), F.get("times", F.lit(0)).alias("first"), F.element_at("times", -1).alias("last"))
