"""Queries over change labels, entity detectors and amount arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import amounts, axes, evidence
from sparkloom.operators import change, conservation, entities
from sparkloom.operators.metrics import auc, bootstrap_rates
from sparkloom.sources import ledger

SQL = ledger.SQL
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = SQL + sql
        return run

    return add


# --- sources and shapes
@query("tx_shape_counts", "SELECT n_in, n_out, count(*) AS n FROM tx_head GROUP BY ALL")
def tx_shape_counts(spark, sf):
    x = ledger.transactions(spark, sf).select(F.size("vin").cast("long").alias("n_in"), F.size("vout").cast("long").alias("n_out"))
    return x.groupBy("n_in", "n_out").agg(F.count("*").alias("n"))


@query(
    "spends_left_join",
    """, s AS (SELECT prev_txid AS txid, prev_vout AS vout, min({'t': txid, 'v': vin}) AS m FROM tx_in GROUP BY ALL)
SELECT o.txid, o.vout, s.m IS NOT NULL AS spent, s.m.t AS spender FROM tx_out o LEFT JOIN s ON s.txid = o.txid AND s.vout = o.vout""",
)
def spends_left_join(spark, sf):
    return change.outspends(ledger.transactions(spark, sf)).withColumn("vout", F.col("vout").cast("long"))


@query("dedup_first_wins", """SELECT txid, min(clock) AS clock FROM base GROUP BY txid""")
def dedup_first_wins(spark, sf):
    from sparkloom.operators.measure import first_wins

    lines = ledger.outputs(spark, sf).select("txid", "clock", "vout").unionByName(ledger.inputs(spark, sf).select("txid", "clock", F.col("vin").alias("vout")))
    rest = ledger._lines(spark, sf).select("txid", "clock", F.col("li").alias("vout"))
    return first_wins(lines.unionByName(rest), "txid", "clock", "vout").select("txid", "clock")


# --- filters
@query("candidates", "SELECT txid FROM tx_out GROUP BY txid HAVING count(*) = 2 AND count(address) = 2")
def candidates(spark, sf):
    return ledger.transactions(spark, sf).where(change.is_candidate()).select("txid")


@query("spendable_outputs", "SELECT txid, vout FROM tx_out WHERE script_type <> 'op_return' AND value > 0")
def spendable_outputs(spark, sf):
    return ledger.outputs(spark, sf).where("script_type != 'op_return' and value > 0").select("txid", F.col("vout").cast("long").alias("vout"))


# --- labels
_CAND = """, cand AS (SELECT txid, max(CASE WHEN vout = 0 THEN value END) AS v0, max(CASE WHEN vout = 1 THEN value END) AS v1,
  max(CASE WHEN vout = 0 THEN address END) AS a0, max(CASE WHEN vout = 1 THEN address END) AS a1
  FROM tx_out GROUP BY txid HAVING count(*) = 2 AND count(address) = 2),
atype AS (SELECT address, CASE WHEN starts_with(address, 'bc1p') THEN 'v1_p2tr' WHEN starts_with(address, 'bc1q') THEN CASE WHEN length(address) <= 42 THEN 'v0_p2wpkh' ELSE 'v0_p2wsh' END
  WHEN starts_with(address, 'bc1') THEN 'v0_unknown' WHEN starts_with(address, '1') THEN 'p2pkh' WHEN starts_with(address, '3') THEN 'p2sh' ELSE 'nonstandard' END AS t
  FROM (SELECT DISTINCT address FROM placed WHERE address IS NOT NULL)),
lab AS (
  SELECT 'optimal_change' AS name, c.txid, CASE WHEN v0 < least AND NOT v1 < least THEN 0 WHEN v1 < least AND NOT v0 < least THEN 1 END AS ci
  FROM cand c JOIN (SELECT txid, min(value) AS least FROM tx_in GROUP BY txid HAVING count(*) >= 2) i ON i.txid = c.txid
  UNION ALL
  SELECT 'address_reuse', txid, CASE WHEN r0 AND NOT r1 THEN 0 WHEN r1 AND NOT r0 THEN 1 END FROM
    (SELECT txid, EXISTS (SELECT 1 FROM tx_in i WHERE i.txid = c.txid AND i.address = a0) AS r0, EXISTS (SELECT 1 FROM tx_in i WHERE i.txid = c.txid AND i.address = a1) AS r1 FROM cand c)
  UNION ALL
  SELECT 'round_number', txid, CASE WHEN v0 % 100000 = 0 AND v1 % 100000 <> 0 THEN 1 WHEN v1 % 100000 = 0 AND v0 % 100000 <> 0 THEN 0 END FROM cand
  UNION ALL
  SELECT 'type_match', txid, CASE WHEN r0 AND NOT r1 THEN 0 WHEN r1 AND NOT r0 THEN 1 END FROM
    (SELECT c.txid, bool_or(ti.t = t0.t) AS r0, bool_or(ti.t = t1.t) AS r1 FROM cand c JOIN tx_in i ON i.txid = c.txid JOIN atype ti ON ti.address = i.address
     JOIN atype t0 ON t0.address = a0 JOIN atype t1 ON t1.address = a1 GROUP BY c.txid)
)
"""


def _label(name):
    def run(spark, sf):
        x = change.labelled(ledger.transactions(spark, sf), change.LABELS[name]())
        return x.select("txid", "change_index")

    return run


for _name in change.LABELS:
    query(f"label_{_name}", _CAND + f"SELECT txid, CAST(ci AS INTEGER) AS change_index FROM lab WHERE name = '{_name}' AND ci IS NOT NULL")(_label(_name))


@query(
    "label_agreement_matrix",
    _CAND + """SELECT a.name AS name_a, b.name AS name_b, count(*) FILTER (a.ci IS NOT NULL AND b.ci IS NOT NULL) AS both,
  count(*) FILTER (a.ci = b.ci) AS agree, count(*) FILTER (a.ci <> b.ci) AS disagree,
  count(*) FILTER (a.ci IS NOT NULL AND b.ci IS NULL) AS only_a, count(*) FILTER (a.ci IS NULL AND b.ci IS NOT NULL) AS only_b
FROM (SELECT n.name, h.txid, l.ci FROM (SELECT DISTINCT name FROM lab) n CROSS JOIN tx_head h LEFT JOIN lab l ON l.name = n.name AND l.txid = h.txid) a
JOIN (SELECT n.name, h.txid, l.ci FROM (SELECT DISTINCT name FROM lab) n CROSS JOIN tx_head h LEFT JOIN lab l ON l.name = n.name AND l.txid = h.txid) b ON a.txid = b.txid AND a.name < b.name
GROUP BY a.name, b.name""",
)
def label_agreement_matrix(spark, sf):
    return change.agreement_matrix(ledger.transactions(spark, sf))


_RATES = """SELECT axis, round(count(*) FILTER (vote = ci) / count(*), 6) AS tpr, round(count(*) FILTER (vote <> ci) / count(*), 6) AS fpr, round(count(vote) / count(*), 6) AS coverage FROM votes GROUP BY axis"""
_ROUNDER = """, rounder AS (SELECT txid, CASE WHEN count(*) = 2 AND min(r) <> max(r) THEN arg_min(vout, r) END AS pos FROM
  (SELECT *, CASE WHEN value > 0 THEN length(CAST(value AS VARCHAR)) - length(rtrim(CAST(value AS VARCHAR), '0')) ELSE 0 END AS r FROM tx_out) GROUP BY txid)"""


def _rounded(x):
    return x.select("axis", *(F.round(c, 6).alias(c) for c in ("tpr", "fpr", "coverage")))


@query(
    "within_tx_rates",
    _CAND + _ROUNDER + """, truth AS (SELECT txid, ci FROM lab WHERE name = 'optimal_change' AND ci IS NOT NULL),
votes AS (SELECT 'round_number' AS axis, ci, pos AS vote FROM truth LEFT JOIN rounder USING (txid)
  UNION ALL SELECT 'address_reuse', t.ci, l.ci FROM truth t LEFT JOIN (SELECT * FROM lab WHERE name = 'address_reuse') l USING (txid))
""" + _RATES,
)
def within_tx_rates(spark, sf):
    truth = change.labelled(ledger.transactions(spark, sf), change.label_optimal_change())
    return _rounded(change.rates(truth, {k: f() for k, f in change.WITHIN.items()}))


@query(
    "universal_baseline_rates",
    _CAND + _ROUNDER + """, votes AS (SELECT 'change_index' AS axis, ci, pos AS vote FROM (SELECT * FROM lab WHERE name = 'type_match' AND ci IS NOT NULL) LEFT JOIN rounder USING (txid))
""" + _RATES,
)
def universal_baseline_rates(spark, sf):
    truth = change.labelled(ledger.transactions(spark, sf), change.label_type_match())
    return _rounded(change.rates(truth, {"change_index": axes.change_position()}))


def _joined(spark, sf):
    txs = ledger.stored_transactions(spark, sf)
    truth = change.labelled(txs, change.label_type_match())
    return change.with_spender_features(truth, txs, F.struct(*(f().alias(k) for k, f in change.VOTE_AXES.items())))


@query(
    "axis_vote_rates",
    _CAND + """, s AS (SELECT prev_txid AS txid, prev_vout AS vout, min({'t': txid, 'v': vin}).t AS spender FROM tx_in GROUP BY ALL),
ver AS (SELECT txid, version FROM tx_head), truth AS (SELECT txid, ci FROM lab WHERE name = 'type_match' AND ci IS NOT NULL),
m AS (SELECT t.txid, t.ci, coalesce(p0.version = o.version, false) AS m0, coalesce(p1.version = o.version, false) AS m1
  FROM truth t JOIN ver o USING (txid) LEFT JOIN s s0 ON s0.txid = t.txid AND s0.vout = 0 LEFT JOIN ver p0 ON p0.txid = s0.spender
  LEFT JOIN s s1 ON s1.txid = t.txid AND s1.vout = 1 LEFT JOIN ver p1 ON p1.txid = s1.spender),
votes AS (SELECT 'version' AS axis, ci, CASE WHEN m0 AND NOT m1 THEN 0 WHEN m1 AND NOT m0 THEN 1 END AS vote FROM m)
""" + _RATES,
)
def axis_vote_rates(spark, sf):
    joined = _joined(spark, sf)
    return _rounded(change.rates(joined, change.axis_votes(joined, ["version"])))


@query("axis_vote_rates_all")
def axis_vote_rates_all(spark, sf):
    joined = _joined(spark, sf)
    return _rounded(change.rates(joined, change.axis_votes(joined, list(change.VOTE_AXES))))


@query("output_score_auc")
def output_score_auc(spark, sf):
    """AUC that the change output's spender matches better than the payment's, where both are spent."""
    txs = ledger.transactions(spark, sf)
    truth = change.labelled(txs, change.label_type_match())
    x = change.with_spender_features(truth, txs, evidence.features(evidence.NARROW)).where("post0 is not null and post1 is not null")
    s = [evidence.score(evidence.narrow_axes(), "own", f"post{i}") for i in range(2)]
    x = x.withColumn("s0", F.round(s[0], 9)).withColumn("s1", F.round(s[1], 9))
    both = F.array(
        F.struct(F.col("s0").alias("score"), (F.col("change_index") == 0).alias("positive")),
        F.struct(F.col("s1").alias("score"), (F.col("change_index") == 1).alias("positive")),
    )
    return auc(x.select(F.explode(both).alias("x")).select("x.*")).withColumn("auc", F.round("auc", 6))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    truth = change.labelled(ledger.transactions(spark, sf), change.label_type_match())
    hit = axes.change_position()
    flags = truth.select("txid", F.coalesce(hit == F.col("change_index"), F.lit(False)).alias("tpr"), F.coalesce(hit != F.col("change_index"), F.lit(False)).alias("fpr"))
    return bootstrap_rates(flags, ["tpr", "fpr"]).select("name", *(F.round(c, 6).alias(c) for c in ("low", "mid", "high")))


# --- clusters of addresses
@query("change_gt_mn")
def change_gt_mn(spark, sf):
    txs = ledger.transactions(spark, sf)
    return change.ground_truth(txs, change.address_clusters(txs)).select("txid", "change_index", "verdict")


@query("two_change_frac")
def two_change_frac(spark, sf):
    txs = ledger.transactions(spark, sf)
    shares = change.two_change_shares(change.cluster_view(txs, change.address_clusters(txs)))
    return shares.select("root", F.round("share", 6).alias("share"))


@query("find_change")
def find_change(spark, sf):
    txs = ledger.transactions(spark, sf)
    truth = change.labelled(txs, change.label_type_match())
    return change.find_change(truth, txs, change.address_clusters(txs))


# --- entity detectors
_ADDR = """, adr AS (SELECT txid, 'output' AS role, vout AS index, address FROM tx_out WHERE address IS NOT NULL UNION ALL SELECT txid, 'input', vin, address FROM tx_in WHERE address IS NOT NULL),
per AS (SELECT txid, count(*) AS scanned FROM adr GROUP BY txid)
"""


@query(
    "detect_bitmex",
    _ADDR + """SELECT txid, role, index, address, round(0.98::DOUBLE / (1 + scanned / 11316496), 4) AS confidence, round(scanned / 11316496, 12) AS expected_collisions
FROM adr JOIN per USING (txid) WHERE starts_with(address, '3BMEX')""",
)
def detect_bitmex(spark, sf):
    return entities.detect_bitmex(ledger.transactions(spark, sf)).withColumn("expected_collisions", F.round("expected_collisions", 12))


@query("detect_satoshidice", _ADDR + "SELECT txid, role, index, address, 0.97::DOUBLE AS confidence FROM adr WHERE starts_with(address, '1dice')")
def detect_satoshidice(spark, sf):
    return entities.detect_satoshidice(ledger.transactions(spark, sf))


@query("detect_consolidation", "SELECT txid, n_in AS n_inputs, n_out AS n_outputs FROM tx_head WHERE n_in >= 3 AND n_out <= 2")
def detect_consolidation(spark, sf):
    return entities.detect_consolidation(ledger.transactions(spark, sf), min_inputs=3)


@query(
    "detect_batching",
    "SELECT txid, n_out AS n_outputs FROM tx_head JOIN (SELECT txid, count(*) FILTER (value <= 1000) AS dust FROM tx_out GROUP BY txid) USING (txid) WHERE n_out >= 4 AND n_out >= 4 * greatest(1, n_in) AND dust <= 0.5 * n_out",
)
def detect_batching(spark, sf):
    return entities.detect_batching(ledger.transactions(spark, sf), min_outputs=4)


def _bent(txs, side, **fields):
    """``txs`` with fields of each input's previous output, or of each output, computed anew: the tables have no dust, no
    equal amounts and no scripts, so amounts are folded into small ranges for the queries that look for such."""
    if side == "vout":
        return txs.withColumn("vout", F.transform("vout", lambda o: o.withField(*next(iter((k, f(o)) for k, f in fields.items())))))
    return txs.withColumn("vin", F.transform("vin", lambda v: v.withField(*next(iter((f"prevout.{k}", f(v["prevout"])) for k, f in fields.items())))))


@query(
    "detect_dust_fanout",
    ", b AS (SELECT txid, address, value % 2000 AS value FROM tx_out) SELECT b.txid, b.address, b.value FROM b JOIN (SELECT txid, count(*) AS n, count(*) FILTER (value <= 1000) AS d FROM b GROUP BY txid) x ON x.txid = b.txid WHERE n >= 3 AND d >= 0.9 * n AND b.value <= 1000",
)
def detect_dust_fanout(spark, sf):
    """Over amounts modulo 2000, from three outputs on."""
    return entities.detect_dust_fanout(_bent(ledger.transactions(spark, sf), "vout", value=lambda o: o["value"] % 2000), min_outputs=3)


@query(
    "detect_bip47_notification",
    ", b AS (SELECT *, script_type = 'op_return' AND value % 3 > 0 AS note FROM tx_out), n AS (SELECT txid FROM b GROUP BY txid HAVING count(*) FILTER (note) = 1)"
    " SELECT txid, address AS recipient FROM (SELECT txid, address, row_number() OVER (PARTITION BY txid ORDER BY vout) AS k FROM b SEMI JOIN n USING (txid) WHERE script_type <> 'op_return') WHERE k = 1 AND address IS NOT NULL",
)
def detect_bip47_notification(spark, sf):
    """With scripts that push 80 bytes, or 4, by the amount."""
    script = lambda o: F.when(o["scriptpubkey_type"] == "op_return", F.when(o["value"] % 3 > 0, "6a4c50" + "ab" * 80).otherwise("6a04deadbeef"))
    txs = _bent(ledger.transactions(spark, sf), "vout", scriptpubkey=script)
    return txs.select("txid", entities.notification_address().alias("recipient")).where("recipient is not null")


def _with_tags(txs):
    """Transactions without inputs as coinbases, with a script that holds each pool's tag in turn, in either case."""
    tags = F.array(*map(F.lit, entities.POOL_TAGS))
    tag = F.element_at(tags, (F.col("clock") % len(entities.POOL_TAGS) + 1).cast("int"))
    text = F.concat(F.lit("mined by "), F.when(F.col("clock") % 2 == 0, F.upper(tag)).otherwise(tag), F.lit("!"))
    return txs.withColumn("coinbase", F.when(F.size("vin") == 0, F.hex(F.encode(text, "utf-8"))))


_TAGS = ", ".join(f"({i}, '{pool}')" for i, pool in enumerate(entities.POOL_TAGS.values()))


@query(
    "detect_mining_pool",
    f""", tg(i, entity) AS (VALUES {_TAGS}) SELECT h.txid, entity, (SELECT address FROM tx_out o WHERE o.txid = h.txid AND address IS NOT NULL ORDER BY value DESC, vout LIMIT 1) AS payout
FROM tx_head h JOIN (SELECT DISTINCT txid, clock FROM base) b ON b.txid = h.txid JOIN tg ON tg.i = b.clock % {len(entities.POOL_TAGS)} WHERE n_in = 0""",
)
def detect_mining_pool(spark, sf):
    return entities.detect_mining_pool(_with_tags(ledger.transactions(spark, sf)), "coinbase")


@query(
    "entity_labels",
    _ADDR + """SELECT DISTINCT txid, 'bitmex' AS detector FROM adr WHERE starts_with(address, '3BMEX') UNION ALL
SELECT DISTINCT txid, 'satoshidice' FROM adr WHERE starts_with(address, '1dice') UNION ALL
SELECT txid, 'consolidation' FROM tx_head WHERE n_in >= 10 AND n_out <= 2 UNION ALL
SELECT txid, 'batching' FROM tx_head JOIN (SELECT txid, count(*) FILTER (value <= 1000) AS dust FROM tx_out GROUP BY txid) USING (txid) WHERE n_out >= 10 AND n_out >= 4 * greatest(1, n_in) AND dust <= 0.5 * n_out UNION ALL
SELECT txid, 'dust_fanout' FROM tx_out GROUP BY txid HAVING count(*) >= 20 AND count(*) FILTER (value <= 1000) >= 0.9 * count(*)""",
)
def entity_labels(spark, sf):
    return entities.entity_labels(ledger.transactions(spark, sf))


@query("entity_hubs", _ADDR + "SELECT DISTINCT address FROM adr WHERE starts_with(address, '3BMEX') OR starts_with(address, '1dice')")
def entity_hubs(spark, sf):
    return entities.hub_addresses(ledger.transactions(spark, sf))


# --- amounts
_PART = """, two AS (SELECT txid FROM tx_head WHERE n_in = 2 AND n_out = 2),
part AS (SELECT i.txid, o.value - i.value AS payment, i.vin AS r_in, o.vout AS r_out,
  length(CAST(o.value - i.value AS VARCHAR)) - length(rtrim(CAST(o.value - i.value AS VARCHAR), '0')) AS score
  FROM two JOIN tx_in i USING (txid) JOIN tx_out o USING (txid) WHERE o.value > i.value),
ranked AS (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY score DESC, payment DESC, r_in, r_out) AS k, count(*) OVER (PARTITION BY txid) AS n FROM part)
"""


@query("subtransactions", _PART + "SELECT txid, CAST(k AS BIGINT) AS k, payment, CAST(score AS BIGINT) AS score, r_in, r_out, round(log2(n), 6) AS ambiguity_bits FROM ranked")
def subtransactions(spark, sf):
    x = ledger.transactions(spark, sf).select("txid", amounts.partitions().alias("ranked"))
    return x.select("txid", F.round(amounts.ambiguity_bits(F.col("ranked")), 6).alias("ambiguity_bits"), F.posexplode("ranked").alias("k", "p")).select(
        "txid", (F.col("k") + 1).cast("long").alias("k"), "p.payment", F.col("p.score").cast("long").alias("score"), F.col("p.r_in").cast("long").alias("r_in"), F.col("p.r_out").cast("long").alias("r_out"), "ambiguity_bits"
    )


@query(
    "partition_signal",
    _PART + """SELECT r.txid, payment, s.prev_txid AS sender, v.prev_txid AS receiver, r_out AS receiver_output, 1 - r_out AS sender_output
FROM ranked r JOIN tx_in v ON v.txid = r.txid AND v.vin = r_in JOIN tx_in s ON s.txid = r.txid AND s.vin = 1 - r_in WHERE k = 1""",
)
def partition_signal(spark, sf):
    x = ledger.transactions(spark, sf).withColumn("ranked", amounts.partitions()).withColumn("s", amounts.partition_signal(F.col("ranked"))).where("s is not null")
    return x.select("txid", "s.payment", "s.sender", "s.receiver", F.col("s.receiver_output").cast("long").alias("receiver_output"), F.col("s.sender_output").cast("long").alias("sender_output"))


_KNOWN = """, tot AS (SELECT txid, CAST(sum(value) AS BIGINT) AS total, max(value) AS known FROM tx_in GROUP BY txid),
cnt AS (SELECT o.txid, total, known, o.value, count(*) AS present FROM tx_out o JOIN tot USING (txid) GROUP BY ALL)
"""


def _known(spark, sf):
    return ledger.transactions(spark, sf).where(F.size("vin") > 0).withColumn("known", F.array_max(F.transform("vin", lambda v: v["prevout"]["value"])))


@query(
    "forced_in_round",
    _KNOWN + """SELECT txid, value, present - (total - known) // value AS forced, present, ((total - known) // value + 1) * value - (total - known) AS slack
FROM cnt WHERE value > 0 AND present - (total - known) // value >= 1""",
)
def forced_in_round(spark, sf):
    return conservation.forced_in_round(_known(spark, sf))


@query(
    "forced_prefixes",
    _KNOWN + """, p AS (SELECT txid, row_number() OVER w AS depth, value, CAST(sum(value * present) OVER w AS BIGINT) - (total - known) AS forced_amount, CAST(sum(present) OVER w AS BIGINT) AS pool
  FROM cnt WINDOW w AS (PARTITION BY txid ORDER BY value DESC)),
coin AS (SELECT o.txid, o.value, row_number() OVER c AS k, CAST(sum(o.value) OVER c AS BIGINT) AS run FROM tx_out o WINDOW c AS (PARTITION BY o.txid ORDER BY o.value DESC, o.vout ROWS UNBOUNDED PRECEDING))
SELECT p.txid, depth, value, forced_amount, (SELECT CAST(min(k) AS BIGINT) FROM coin c WHERE c.txid = p.txid AND c.run >= p.forced_amount) AS coins, pool FROM p WHERE forced_amount > 0""",
)
def forced_prefixes(spark, sf):
    return conservation.forced_prefixes(_known(spark, sf))


@query("coinjoin_demix")
def coinjoin_demix(spark, sf):
    """Over outputs of one to three units, and inputs of two to six units less a fee."""
    txs = _bent(ledger.transactions(spark, sf), "vout", value=lambda o: (1 + o["value"] % 3) * 100_000)
    return conservation.coinjoin_demix(_bent(txs, "vin", value=lambda p: (2 + p["value"] % 5) * 100_000 - 1000))


_SEEDS = ", known AS (SELECT DISTINCT txid FROM tx_out WHERE value % 100000 = 0)"


def _seeds(txs):
    return txs.where(F.exists("vout", lambda o: o["value"] % 100000 == 0)).select("txid")


@query("descended_inputs", _SEEDS + " SELECT i.txid, i.vin AS index, i.prev_txid AS funder, i.prev_vout AS vout, i.value FROM tx_in i SEMI JOIN known k ON k.txid = i.prev_txid")
def descended_inputs(spark, sf):
    txs = ledger.transactions(spark, sf)
    return conservation.descended_inputs(txs, _seeds(txs)).withColumn("vout", F.col("vout").cast("long"))


@query(
    "rank_by_overlap",
    _SEEDS + " SELECT i.txid, count(k.txid) AS descended, count(*) AS total, round(count(k.txid) / count(*), 6) AS share FROM tx_in i LEFT JOIN known k ON k.txid = i.prev_txid GROUP BY i.txid",
)
def rank_by_overlap(spark, sf):
    txs = ledger.transactions(spark, sf)
    return conservation.rank_by_overlap(txs, _seeds(txs)).withColumn("share", F.round("share", 6))


@query("candidate_coins", _SEEDS + " SELECT i.txid, i.value, i.script_type, count(*) AS n FROM tx_in i SEMI JOIN known k ON k.txid = i.prev_txid GROUP BY ALL")
def candidate_coins(spark, sf):
    txs = ledger.transactions(spark, sf)
    return conservation.candidate_coins(txs, _seeds(txs))


# --- SQL of queries above that need more than one relation
def _vote_sql() -> str:
    from sparkloom.plans.axis_queries import _AXIS_SQL

    vals = " UNION ALL ".join(f"SELECT '{k}' AS axis, txid, value FROM ({_AXIS_SQL[k]}) x{i}" for i, k in enumerate(change.VOTE_AXES))
    return _CAND + f""", s AS (SELECT prev_txid AS txid, prev_vout AS vout, min({{'t': txid, 'v': vin}}).t AS spender FROM tx_in GROUP BY ALL),
vals AS ({vals}), truth AS (SELECT txid, ci FROM lab WHERE name = 'type_match' AND ci IS NOT NULL),
m AS (SELECT o.axis, t.txid, t.ci, coalesce(p0.value = o.value, false) AS m0, coalesce(p1.value = o.value, false) AS m1
  FROM truth t JOIN vals o ON o.txid = t.txid LEFT JOIN s s0 ON s0.txid = t.txid AND s0.vout = 0 LEFT JOIN vals p0 ON p0.txid = s0.spender AND p0.axis = o.axis
  LEFT JOIN s s1 ON s1.txid = t.txid AND s1.vout = 1 LEFT JOIN vals p1 ON p1.txid = s1.spender AND p1.axis = o.axis),
votes AS (SELECT axis, ci, CASE WHEN m0 AND NOT m1 THEN 0 WHEN m1 AND NOT m0 THEN 1 END AS vote FROM m)
""" + _RATES


ORACLE_SQL["axis_vote_rates_all"] = SQL + _vote_sql()


def _auc_sql() -> str:
    from sparkloom.plans.graph_queries import _FP, _SEQ

    return _CAND + _SEQ + f""", s AS (SELECT prev_txid AS txid, prev_vout AS vout, min({{'t': txid, 'v': vin}}).t AS spender FROM tx_in GROUP BY ALL),
truth AS (SELECT l.txid, ci, s0.spender AS p0, s1.spender AS p1 FROM lab l JOIN s s0 ON s0.txid = l.txid AND s0.vout = 0 JOIN s s1 ON s1.txid = l.txid AND s1.vout = 1 WHERE name = 'type_match' AND ci IS NOT NULL),
halves AS (SELECT txid, p0 AS post, ci = 0 AS positive FROM truth UNION ALL SELECT txid, p1, ci = 1 FROM truth),
sc AS (SELECT positive, round({_FP}, 9) AS score FROM halves d JOIN feat fa ON fa.txid = d.txid JOIN feat fb ON fb.txid = d.post, cfg)
SELECT round(sum(CASE WHEN x.score > y.score THEN 1 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc,
  (SELECT count(*) FROM sc WHERE positive) AS n_pos, (SELECT count(*) FROM sc WHERE NOT positive) AS n_neg
FROM sc x JOIN sc y ON x.positive AND NOT y.positive"""


ORACLE_SQL["coinjoin_demix"] = SQL + """, bo AS (SELECT txid, vout, (1 + value % 3) * 100000 AS value FROM tx_out), bi AS (SELECT txid, vin, (2 + value % 5) * 100000 - 1000 AS value FROM tx_in),
m AS (SELECT txid, value AS mix, count(*) AS n, min(vout) AS first FROM bo GROUP BY ALL),
mix AS (SELECT txid, mix FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY n DESC, first) AS k FROM m) WHERE k = 1 AND n >= 3),
v AS (SELECT i.txid, i.vin, o.value AS change FROM bi i JOIN mix USING (txid) JOIN bo o ON o.txid = i.txid AND o.value <> mix WHERE mix + o.value - i.value BETWEEN 1 AND 2000)
SELECT txid, vin AS input_index, change FROM (SELECT *, count(*) OVER (PARTITION BY txid, vin) AS a, count(*) OVER (PARTITION BY txid, change) AS b FROM v) WHERE a = 1 AND b = 1"""

_CLUSTERED = """, ia AS (SELECT DISTINCT txid, address AS a FROM tx_in), sym AS (SELECT DISTINCT x.a AS a, y.a AS b FROM ia x JOIN ia y USING (txid)),
reach(x, y) AS (SELECT a, a FROM ia UNION SELECT r.x, s.b FROM reach r JOIN sym s ON s.a = r.y), comp AS (SELECT x AS address, min(y) AS cluster FROM reach GROUP BY x),
root AS (SELECT txid, min(cluster) AS root FROM ia JOIN comp ON comp.address = ia.a GROUP BY txid),
two AS (SELECT c.txid, r.root, a0, a1, coalesce(c0.cluster = r.root, false) AS in0, coalesce(c1.cluster = r.root, false) AS in1
  FROM cand c JOIN root r USING (txid) LEFT JOIN comp c0 ON c0.address = a0 LEFT JOIN comp c1 ON c1.address = a1),
share AS (SELECT root, avg(CAST(in0 AND in1 AS DOUBLE)) AS share FROM two GROUP BY root)
"""
_RSQL = SQL.replace("WITH base", "WITH RECURSIVE base", 1)
ORACLE_SQL["two_change_frac"] = _RSQL + _CAND + _CLUSTERED + "SELECT root, round(share, 6) AS share FROM share"
ORACLE_SQL["change_gt_mn"] = _RSQL + _CAND + _CLUSTERED + """, one AS (SELECT *, CASE WHEN in0 AND NOT in1 THEN 0 WHEN in1 AND NOT in0 THEN 1 END AS ci FROM two),
fresh AS (SELECT *, CASE WHEN ci = 0 THEN a0 ELSE a1 END AS ca FROM one WHERE ci IS NOT NULL), uses AS (SELECT address, count(*) AS n FROM tx_out WHERE address IS NOT NULL GROUP BY address)
SELECT f.txid, CAST(ci AS INTEGER) AS change_index, CASE WHEN n > 1 THEN 'reused_change' WHEN share > 0.10 THEN 'twochange_cluster' ELSE 'kept' END AS verdict
FROM fresh f JOIN uses ON uses.address = ca JOIN share USING (root) WHERE NOT EXISTS (SELECT 1 FROM ia WHERE ia.txid = f.txid AND ia.a = ca)"""
ORACLE_SQL["output_score_auc"] = SQL + _auc_sql()
