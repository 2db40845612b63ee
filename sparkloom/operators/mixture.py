"""Unsupervised weights: a mixture over agreement patterns, by expectation-maximisation or Gibbs sampling.

Pairs are first counted by agreement pattern.  The iterations need only sums over the patterns: per axis, how much of
the same-owner part speaks, and how much of that agrees.  Up to ``MOST_PATTERNS`` patterns, which is tested by counting
them, are held by the driver; beyond it each round is a Spark job over the stored counts, of which the driver sees the
sums alone.

A pattern is held as a number for every ``_GROUP`` axes, and a round looks up what each number adds to its
log-likelihoods and counts by number: tables of a few thousand entries, and some 20 bytes a pattern."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.components import connected_components
from sparkloom.operators.shared import stored

_LOW = 1e-6
MOST_PATTERNS = 4_000_000
#: Axes that share a number: 3^7 = 2187 patterns of them.
_GROUP = 7
_BLOCK = 1 << 17


@dataclass
class Mixture:
    m: np.ndarray
    share: float
    iterations: int
    loglik: list[float]


def patterns(pairs: DataFrame, agree: str = "agree", active: str = "active") -> DataFrame:
    """``(pattern, n)``; pattern holds 1 (agrees), 0 (differs) or null (silent) per axis, from two arrays."""
    pattern = F.zip_with(agree, active, lambda a, on: F.when(on, a.cast("int")))
    return pairs.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


@dataclass
class _Sums:
    """Over some patterns: pairs, same-owner part of them, log-likelihood, and per axis what of that part speaks and agrees."""

    total: float
    part: float
    loglik: float
    speaks: np.ndarray
    agrees: np.ndarray


def _digits(width: int) -> np.ndarray:
    """Per number of a group of axes, what each says: 2 agrees, 1 differs, 0 silent."""
    return np.arange(3**width)[:, None] // 3 ** np.arange(width) % 3


def _part_of(codes: np.ndarray, n: np.ndarray, m: np.ndarray, u: np.ndarray, share: float, rng: np.random.Generator | None) -> _Sums:
    """The sums of some patterns; ``rng`` draws whole pairs by their probability instead of shares of pairs."""
    k, total, part, loglik = len(u), float(n.sum()), 0.0, 0.0
    digits = [_digits(min(_GROUP, k - i)) for i in range(0, k, _GROUP)]
    sides = []
    for p in (m, u):
        hit, miss = np.log(p), np.log(1 - p)
        sides.append([(d == 2) @ hit[i * _GROUP :][: d.shape[1]] + (d == 1) @ miss[i * _GROUP :][: d.shape[1]] for i, d in enumerate(digits)])
    counts = [np.zeros(len(d)) for d in digits]
    for at in range(0, len(n), _BLOCK):
        c, nb = codes[:, at : at + _BLOCK], n[at : at + _BLOCK]
        top, bottom = (sum((t[x] for t, x in zip(side, c, strict=True)), start=np.full(len(nb), np.log(w))) for side, w in zip(sides, (share, 1 - share), strict=True))
        both = np.logaddexp(top, bottom)
        r = np.exp(top - both)
        if rng is None:
            z = nb * r
        else:
            z = (rng.random(len(nb)) < r).astype(float)
            many = np.nonzero(nb > 1)[0]
            z[many] = rng.binomial(nb[many], np.clip(r[many], 0, 1))
        part += float(z.sum())
        loglik += float((nb * both).sum())
        for total_of, x in zip(counts, c, strict=True):
            total_of += np.bincount(x, z, len(total_of))
    speaks = np.concatenate([w @ (d > 0) for w, d in zip(counts, digits, strict=True)])
    agrees = np.concatenate([w @ (d == 2) for w, d in zip(counts, digits, strict=True)])
    return _Sums(total, part, loglik, speaks, agrees)


def _coded(counted: DataFrame, k: int) -> DataFrame:
    """``(c0, c1, .., n)``: a number for every group of axes."""
    says = lambda j: F.coalesce(F.get("pattern", F.lit(j)) + 1, F.lit(0))
    groups = [sum((says(j) * 3 ** (j - i) for j in range(i, min(i + _GROUP, k))), start=F.lit(0)).cast("short") for i in range(0, k, _GROUP)]
    return counted.select(*(g.alias(f"c{i}") for i, g in enumerate(groups)), F.col("n").cast("long").alias("n"))


def _columns(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    *codes, n = (table.column(i).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(i).to_numpy() for i in range(table.num_columns))
    return np.array(codes), np.array(n)


class _Counted:
    """Counted patterns, on the driver or, if there are many, where they are stored."""

    def __init__(self, counted: DataFrame, k: int, most: int | None = None):
        self.table = stored(_coded(counted, k), "patterns")
        self.held = None
        if self.table.count() <= (MOST_PATTERNS if most is None else most):
            codes, n = _columns(self.table.toArrow())
            order = np.lexsort(codes) if len(codes) else slice(None)  # the draws don't depend on the order of files
            self.held = codes[:, order], n[order]

    def sums(self, m: np.ndarray, u: np.ndarray, share: float, draw: tuple | None = None) -> _Sums:
        k = len(u)
        if self.held is not None:
            codes, n = self.held
            if not len(n):
                return _Sums(0.0, 0.0, 0.0, np.zeros(k), np.zeros(k))
            return _part_of(codes, n, m, u, share, None if draw is None else np.random.default_rng(draw))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            for i, batch in enumerate(batches):
                s = _part_of(*_columns(batch), m, u, share, None if draw is None else np.random.default_rng((*draw, TaskContext.get().partitionId(), i)))
                yield pa.RecordBatch.from_arrays([pa.array([[s.total, s.part, s.loglik, *s.speaks, *s.agrees]], pa.list_(pa.float64()))], names=["s"])

        width = 3 + 2 * k
        x = self.table.mapInArrow(run, "s array<double>")
        row = x.agg(*(F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(width))).first()
        v = np.array(list(row))
        return _Sums(v[0], v[1], v[2], v[3 : 3 + k], v[3 + k :])


def _clip(x):
    return np.clip(x, _LOW, 1 - _LOW)


def em_fit(counted: DataFrame, u: list[float], max_iter: int = 100, tol: float = 1e-6, most_patterns: int | None = None) -> Mixture:
    """Chance of agreement per axis within one owner (m) and the share of such pairs; u stays fixed."""
    table = _Counted(counted, len(u), most_patterns)
    u = _clip(np.array(u))
    m, share, history, k = np.full(len(u), 0.9), 0.5, [], 0
    for k in range(1, max_iter + 1):
        s = table.sums(_clip(m), u, share)
        if not s.total:
            return Mixture(m, share, 0, history)
        history.append(s.loglik)
        share = float(_clip(s.part / s.total))
        m = np.where(s.speaks > 1e-12, _clip(s.agrees / np.maximum(s.speaks, 1e-12)), m)
        if k > 1 and abs(history[-1] - history[-2]) < tol:
            break
    return Mixture(m, share, k, history)


def gibbs_fit(
    counted: DataFrame, u: list[float], alpha: float = 8.5, beta: float = 1.5, draws: int = 2000, burn: int = 500, seed: int = 0, most_patterns: int | None = None
) -> dict:
    """Posterior means and 95 % intervals of m and the share, and the draws of m; the pairs of a pattern are drawn together."""
    table = _Counted(counted, len(u), most_patterns)
    u, rng = _clip(np.array(u)), np.random.default_rng(seed)
    s = table.sums(np.full(len(u), 0.9), u, 0.5, (seed, 0))
    kept_m, kept_share = [], []
    for k in range(draws):
        m = _clip(rng.beta(alpha + s.agrees, beta + s.speaks - s.agrees))
        share = float(_clip(rng.beta(1 + s.part, 1 + s.total - s.part)))
        s = table.sums(m, u, share, (seed, k + 1))
        if k >= burn:
            kept_m.append(m)
            kept_share.append(share)
    kept = np.array(kept_m)
    return {"m": kept.mean(0), "low": np.quantile(kept, 0.025, axis=0), "high": np.quantile(kept, 0.975, axis=0), "share": float(np.mean(kept_share)), "draws": kept}


#: Draws that a row of the band's edges carries, a bit each; links that components are put together up to, about, and
#: links that a task may hold.
_DRAWS, _TASK_LINKS, MOST_LINKS = 25, 250_000, 20_000_000


def _drawn_bits(draws: np.ndarray, u: np.ndarray, share: float, seed: int):
    """Over (a, b, component, agree, active): (component, part, a, b, bits), a row for every ``_DRAWS`` draws in some of
    which the pair holds."""
    hit, miss = np.log(draws / u).T, np.log((1 - draws) / (1 - u)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                a, b, component, agree, active = (batch.column(i).slice(k, 1024).to_pylist() for i in range(5))
                on, same = np.array(active, dtype=float), np.array([[bool(x) for x in row] for row in agree], dtype=float)
                odds = np.log(share / (1 - share)) + (on * same) @ hit + (on * (1 - same)) @ miss
                coin = np.array([np.random.default_rng([seed, zlib.crc32(f"{x}|{y}".encode())]).random(len(draws)) for x, y in zip(a, b, strict=True)])
                holds = coin < 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
                for part in range(0, len(draws), _DRAWS):
                    mine = holds[:, part : part + _DRAWS]
                    bits = mine @ (1 << np.arange(mine.shape[1]))
                    some = np.nonzero(bits)[0].tolist()
                    columns = [pa.array([x[i] for i in some], pa.string()) for x in (component, a, b)]
                    yield pa.RecordBatch.from_arrays([columns[0], pa.array([part] * len(some), pa.int32()), *columns[1:], pa.array(bits[some], pa.int32())], names=["component", "part", "a", "b", "bits"])

    return run


def _links(a: np.ndarray, b: np.ndarray, nodes: int) -> int:
    """Nodes less components of an edge list: each round hooks roots to lesser ones and shortens the paths to them."""
    root = np.arange(nodes)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes - int((root == np.arange(nodes)).sum())
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root[root] == root).all():
            root = root[root]


def _linked_in_draws(key: tuple, table: pa.Table) -> pa.Table:
    part, (names, ends) = key[1].as_py(), np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    a, b, bits = ends[: table.num_rows], ends[table.num_rows :], table.column("bits").to_numpy()
    found = [(part + d, _links(a[on], b[on], len(names))) for d in range(_DRAWS) if (on := bits >> d & 1 == 1).any()]
    return pa.table({"draw": pa.array([d for d, _ in found], pa.int32()), "links": pa.array([n for _, n in found], pa.int64())})


def cluster_band(pairs: DataFrame, u: list[float], fit: dict, draws: int = 200, seed: int = 0, most_links: int | None = None) -> DataFrame:
    """One row (nodes, mean, low, high): into how many clusters the nodes of ``pairs`` (a, b, agree, active) fall if each
    pair is one owner's by its probability, over ``draws`` of the fitted parameters.  Whether a pair holds is drawn by a
    generator that its names seed.

    No draw links what the pairs together don't, so their components are found once, and a task takes the pairs of one
    or more whole components, with a bit per draw, through ``_DRAWS`` draws.  Those of over ``MOST_LINKS`` pairs, too large
    for a task, are found draw by draw as distributed components."""
    every = fit["draws"]
    chosen = every[np.linspace(0, len(every) - 1, draws).astype(int)]
    held = stored(pairs.select("a", "b", "agree", "active"), "band-pairs")
    nodes = held.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    of = connected_components(held, "a", "b")
    ends = held.join(of.toDF("a", "component"), "a").select("a", "b", "component", "agree", "active")
    groups = 1 + held.count() // _TASK_LINKS
    drawn = stored(
        ends.mapInArrow(_drawn_bits(chosen, _clip(np.array(u)), fit["share"], seed), "component string, part int, a string, b string, bits int")
        .select(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("group"), "part", F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), "bits"), "band-bits",
    )
    sizes = drawn.groupBy("group", "part").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > (MOST_LINKS if most_links is None else most_links)).select("group", "part"), "band-large")
    found = drawn.join(F.broadcast(large), ["group", "part"], "left_anti").groupBy("group", "part").applyInArrow(_linked_in_draws, "draw int, links long")
    links = stored(found, "band-links")
    if not large.isEmpty():
        rest = stored(drawn.join(F.broadcast(large), ["group", "part"]), "band-rest")
        for d in range(draws):
            one = rest.where((F.col("part") == d // _DRAWS * _DRAWS) & (F.shiftright("bits", d % _DRAWS).bitwiseAND(F.lit(1)) == 1))
            links = links.unionByName(connected_components(one, "a", "b").where("node != component").agg(F.lit(d).alias("draw"), F.count("*").alias("links")))
    merged = links.groupBy("draw").agg(F.sum("links").alias("links"))
    total = nodes.agg(F.count("*").alias("nodes"))
    per = held.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw")).join(merged, "draw", "left").crossJoin(F.broadcast(total))  # one row
    n = F.col("nodes") - F.coalesce("links", F.lit(0))
    return per.groupBy("nodes").agg(F.avg(n).alias("mean"), F.percentile(n, F.lit(0.025)).alias("low"), F.percentile(n, F.lit(0.975)).alias("high"))


def pair_probability(agree: str, active: str, m: list[float], u: list[float], share: float) -> Column:
    """P(same owner) of two arrays per row, under independent axes."""
    total = F.lit(float(np.log(share) - np.log(1 - share)))
    for j, (mj, uj) in enumerate(zip(_clip(np.array(m)), _clip(np.array(u)), strict=True)):
        hit, miss = float(np.log(mj / uj)), float(np.log((1 - mj) / (1 - uj)))
        on, a = F.get(F.col(active), F.lit(j)), F.get(F.col(agree), F.lit(j)).cast("boolean")
        total = total + F.when(on & a, hit).when(on, miss).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def oracle_m(pairs: DataFrame, names: list[str], label: str = "label", agree: str = "agree", active: str = "active") -> DataFrame:
    """``(axis, m)``: how often each axis agrees among the true pairs where it speaks; null if it never does."""
    x = pairs.where(F.col(label) == 1).select(F.posexplode(F.arrays_zip(F.col(agree).alias("a"), F.col(active).alias("on"))).alias("j", "x"))
    got = x.where("x.on").groupBy("j").agg(F.avg(F.col("x.a").cast("double")).alias("m"))
    axes_ = x.sparkSession.createDataFrame(list(enumerate(names)), "j int, axis string")
    return axes_.join(got, "j", "left").select("axis", "m")
