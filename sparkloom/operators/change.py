"""Which output is the change: labels from single transactions and from clusters, and tests of predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import axes
from sparkloom.operators.components import connected_components


def is_candidate() -> Column:
    """Two outputs, both with an address."""
    return (F.size("vout") == 2) & F.forall("vout", lambda o: o["scriptpubkey_address"].isNotNull())


def input_addresses() -> Column:
    return F.array_distinct(F.filter(F.transform("vin", lambda v: v["prevout"]["scriptpubkey_address"]), lambda a: a.isNotNull()))


def _out(i: int) -> Column:
    return F.get("vout", F.lit(i))


def _exactly_one(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return F.when(a & ~b, F.lit(0)).when(b & ~a, F.lit(1))


def label_optimal_change() -> Column:
    """With two known inputs or more: the output below the smallest input, if only one is."""
    paid = F.transform("vin", lambda v: v["prevout"]["value"])
    known = (F.size("vin") >= 2) & ~F.exists(paid, lambda x: x.isNull())
    least = F.array_min(paid)
    return F.when(is_candidate() & known, _exactly_one(_out(0)["value"] < least, _out(1)["value"] < least))


def label_address_reuse() -> Column:
    ins = input_addresses()
    return F.when(is_candidate(), _exactly_one(*(F.array_contains(ins, _out(i)["scriptpubkey_address"]) for i in range(2))))


def label_round_number(decimals: int = 3) -> Column:
    """The output beside a round payment."""
    unit = 10 ** (8 - decimals)
    return F.when(is_candidate(), 1 - _exactly_one(*(_out(i)["value"] % unit == 0 for i in range(2))))


def label_type_match() -> Column:
    kinds = F.array_distinct(F.transform(input_addresses(), axes.address_type))
    return F.when(
        is_candidate() & (F.size(kinds) > 0),
        _exactly_one(*(F.array_contains(kinds, axes.address_type(_out(i)["scriptpubkey_address"])) for i in range(2))),
    )


LABELS = {
    "optimal_change": label_optimal_change,
    "address_reuse": label_address_reuse,
    "round_number": label_round_number,
    "type_match": label_type_match,
}
#: Predictors that look at the transaction alone.
WITHIN = {"round_number": axes.change_position, "address_reuse": label_address_reuse}


def labelled(txs: DataFrame, label: Column) -> DataFrame:
    """``txs`` with change_index, the rows that have one."""
    return txs.withColumn("change_index", label.cast("int")).where("change_index is not null")


def agreement_matrix(txs: DataFrame, labels: dict | None = None) -> DataFrame:
    """``(name_a, name_b, both, agree, disagree, only_a, only_b)`` of every two label sets; one pass."""
    named = {k: f() for k, f in (labels or LABELS).items()}
    marked = txs.select(*(v.cast("int").alias(k) for k, v in named.items()))
    names = sorted(named)
    pairs = F.array(
        *(
            F.struct(F.lit(a).alias("name_a"), F.lit(b).alias("name_b"), F.col(a).alias("a"), F.col(b).alias("b"))
            for i, a in enumerate(names)
            for b in names[i + 1 :]
        )
    )
    x = marked.select(F.explode(pairs).alias("p")).select("p.*")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return x.groupBy("name_a", "name_b").agg(
        F.count_if(both).alias("both"),
        F.count_if(both & (F.col("a") == F.col("b"))).alias("agree"),
        F.count_if(both & (F.col("a") != F.col("b"))).alias("disagree"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("only_b"),
    )


def rates(truth: DataFrame, predictors: dict[str, Column]) -> DataFrame:
    """``(axis, tpr, fpr, coverage)`` over rows with change_index; abstaining counts in the denominator."""
    votes = F.array(*(F.struct(F.lit(k).alias("axis"), v.cast("int").alias("vote")) for k, v in predictors.items()))
    x = truth.select("change_index", F.explode(votes).alias("v"))
    share = lambda test: F.count_if(test) / F.count("*")
    return x.groupBy(F.col("v.axis").alias("axis")).agg(
        share(F.col("v.vote") == F.col("change_index")).alias("tpr"),
        share(F.col("v.vote") != F.col("change_index")).alias("fpr"),
        share(F.col("v.vote").isNotNull()).alias("coverage"),
    )


def spends(txs: DataFrame) -> DataFrame:
    """``(txid, vout, spender)`` of every spent output; of several claims the least spender and index stands."""
    ins = txs.select(F.col("txid").alias("spender"), F.posexplode("vin").alias("index", "v"))
    return (
        ins.groupBy(F.col("v.txid").alias("txid"), F.col("v.vout").alias("vout"))
        .agg(F.min(F.struct("spender", "index")).alias("s"))
        .select("txid", "vout", F.col("s.spender").alias("spender"))
    )


def outspends(txs: DataFrame) -> DataFrame:
    """``(txid, vout, spent, spender)`` of every output."""
    outs = txs.select("txid", F.posexplode("vout").alias("vout", "o")).select("txid", "vout")
    return outs.join(spends(txs), ["txid", "vout"], "left").select("txid", "vout", F.col("spender").isNotNull().alias("spent"), "spender")


VOTE_AXES = {"input_order": axes.input_order, "output_order": axes.output_order, "nsequence": axes.nsequence, "version": axes.version}


def with_spender_features(truth: DataFrame, txs: DataFrame, features: Column) -> DataFrame:
    """``truth`` (two outputs) with ``own``, ``post0`` and ``post1``: features of it and of its outputs' spenders."""
    spent = spends(txs)
    of = txs.select(F.col("txid").alias("spender"), features.alias("f"))
    out = truth.withColumn("own", features)
    for i in range(2):
        post = spent.where(F.col("vout") == i).join(of, "spender").select("txid", F.col("f").alias(f"post{i}"))
        out = out.join(post, "txid", "left")
    return out


def axis_votes(joined: DataFrame, names: list[str]) -> dict[str, Column]:
    """The output whose spender matches on an axis, if only one does."""
    same = lambda n, i: F.col(f"post{i}").isNotNull() & F.col(f"post{i}.{n}").eqNullSafe(F.col(f"own.{n}"))
    return {n: _exactly_one(same(n, 0), same(n, 1)) for n in names}


def address_clusters(txs: DataFrame) -> DataFrame:
    """``(address, cluster)``: addresses spent together; star edges from each transaction's least address."""
    ins = txs.select(input_addresses().alias("a")).where(F.size("a") > 0)
    edges = ins.select(F.array_min("a").alias("src"), F.explode("a").alias("dst"))
    return connected_components(edges).toDF("address", "cluster")


def cluster_view(txs: DataFrame, clusters: DataFrame) -> DataFrame:
    """``txs`` that have input addresses, with root and out_clusters (of the outputs, in order)."""
    rooted = txs.withColumn("__a", F.array_min(input_addresses())).where("`__a` is not null")
    rooted = rooted.join(clusters.toDF("__a", "root"), "__a").drop("__a")
    outs = txs.select("txid", F.posexplode("vout").alias("i", "o")).select("txid", "i", F.col("o.scriptpubkey_address").alias("address"))
    mapped = (
        outs.join(clusters, "address", "left")
        .groupBy("txid")
        .agg(F.array_sort(F.collect_list(F.struct("i", "cluster"))).alias("out_clusters"))
    )
    return rooted.join(mapped, "txid", "left")


def label_by_cluster(view: DataFrame) -> DataFrame:
    """``view`` with change_index: the one output in the inputs' cluster, unless it reuses an input address."""
    inside = lambda i: F.get("out_clusters", F.lit(i))["cluster"] == F.col("root")
    found = _exactly_one(inside(0), inside(1))
    reused = F.array_contains(input_addresses(), F.get("vout", found)["scriptpubkey_address"])
    return view.withColumn("change_index", F.when(is_candidate() & ~F.coalesce(reused, F.lit(True)), found)).where("change_index is not null")


def two_change_shares(view: DataFrame) -> DataFrame:
    """``(root, share)``: of a cluster's candidates, those with both outputs inside it."""
    both = F.forall("out_clusters", lambda x: F.coalesce(x["cluster"] == F.col("root"), F.lit(False)))
    return view.where(is_candidate()).groupBy("root").agg(F.avg(both.cast("double")).alias("share"))


def ground_truth(txs: DataFrame, clusters: DataFrame, most_two_change: float = 0.10) -> DataFrame:
    """Labelled rows with ``verdict``: kept, reused_change or twochange_cluster, tested in that order."""
    view = cluster_view(txs, clusters)
    counts = (
        txs.select(F.explode("vout").alias("o"))
        .groupBy(F.col("o.scriptpubkey_address").alias("change_address"))
        .agg(F.count("*").alias("uses"))
    )
    found = label_by_cluster(view).withColumn("change_address", F.get("vout", F.col("change_index"))["scriptpubkey_address"])
    joined = found.join(counts, "change_address", "left").join(two_change_shares(view), "root", "left")
    verdict = (
        F.when(F.col("uses") > 1, "reused_change")
        .when(F.coalesce("share", F.lit(0.0)) > most_two_change, "twochange_cluster")
        .otherwise("kept")
    )
    return joined.withColumn("verdict", verdict)


def change_strategy(indices: Column) -> Column:
    """0 always first, -1 always last, 1 first or last, null otherwise; ``indices`` is an array."""
    kinds = F.array_distinct(indices)
    return (
        F.when(F.size(kinds) == 0, F.lit(None).cast("int"))
        .when((F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == 0), 0)
        .when((F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == -1), -1)
        .when(F.forall(kinds, lambda x: x.isin(0, -1)), 1)
    )


def find_change(truth: DataFrame, txs: DataFrame, clusters: DataFrame, use_types: bool = True) -> DataFrame:
    """``(txid, predicted)``: the output whose onward spend looks like the cluster, each row left out of its own
    cluster's habits; null when none or several pass.  Circular against a co-spend label."""
    view = cluster_view(txs, clusters)
    kind = F.struct(axes.nsequence().alias("s"), axes.locktime_policy().alias("l"), axes.version().alias("v"))
    n = F.size("vout")
    inside = F.filter(
        F.transform(
            "out_clusters",
            lambda x, i: F.when(
                (x["cluster"] == F.col("root"))
                & ~F.coalesce(F.array_contains(input_addresses(), F.get("vout", i)["scriptpubkey_address"]), F.lit(False)),
                F.when(i == 0, F.lit(0)).when(i == n - 1, F.lit(-1)).otherwise(i),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    # per cluster: counts of each habit; subtracting a row's own count leaves it out
    mine = view.select(
        "txid",
        "root",
        kind.alias("kind"),
        n.alias("n"),
        F.when(F.size(inside) == 1, F.get(inside, F.lit(0))).alias("at"),
        F.filter(F.transform("vout", axes.output_type), lambda t: t.isNotNull()).alias("types"),
    )
    kinds = mine.groupBy("root", "kind").agg(F.count("*").alias("kind_n"))
    types = mine.select("root", F.explode("types").alias("type")).groupBy("root", "type").agg(F.count("*").alias("type_n"))
    habits = mine.where("at is not null").groupBy("root", "at").agg(F.count("*").alias("at_n"))
    rows = truth.select("txid").join(mine, "txid")
    left = (
        rows.join(habits.withColumnRenamed("at", "h"), "root", "left")
        .withColumn("rest", F.col("at_n") - F.when(F.col("h") == F.col("at"), 1).otherwise(0))
        .groupBy("txid")
        .agg(F.collect_set(F.when(F.col("rest") > 0, F.col("h"))).alias("hs"))
        .select("txid", change_strategy(F.col("hs")).alias("strategy"))
    )
    spare = (
        rows.select("txid", "root", "types")
        .join(types, "root")
        .withColumn("rest", F.col("type_n") - F.size(F.filter("types", lambda t: t == F.col("type"))))
        .where("rest > 0")
        .groupBy("txid")
        .agg(F.collect_set("type").alias("allowed"))
    )
    spent = spends(txs)
    of = txs.select(F.col("txid").alias("spender"), kind.alias("next_kind"))
    outs = (
        txs.select("txid", F.posexplode("vout").alias("i", "o"))
        .select("txid", "i", axes.output_type(F.col("o")).alias("type"))
        .join(rows.select("txid", "root", "kind", "n"), "txid")
        .join(left, "txid", "left")
        .where(
            F.when(F.col("strategy") == 0, F.col("i") == 0)
            .when(F.col("strategy") == -1, F.col("i") == F.col("n") - 1)
            .when(F.col("strategy") == 1, F.col("i").isin(0) | (F.col("i") == F.col("n") - 1))
            .otherwise(F.lit(True))
        )
        .join(spent.withColumnRenamed("vout", "i"), ["txid", "i"])
        .join(of, "spender")
        .join(kinds.withColumnRenamed("kind", "next_kind"), ["root", "next_kind"])
        .where(F.col("kind_n") - F.when(F.col("next_kind") == F.col("kind"), 1).otherwise(0) > 0)
    )
    if use_types:
        outs = outs.join(spare, "txid", "left").where(
            "allowed is null or size(allowed) = 0 or type is null or array_contains(allowed, type)"
        )
    passed = outs.groupBy("txid").agg(F.count("*").alias("c"), F.min("i").alias("first"))
    return truth.select("txid").join(passed, "txid", "left").select("txid", F.when(F.col("c") == 1, F.col("first")).alias("predicted"))
