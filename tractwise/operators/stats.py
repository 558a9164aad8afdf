"""Statistical tests and evaluation metrics as distributed aggregates.

Everything rank-based works on the table of distinct values with counts, so ties
and hot values cost one row, and nothing is gathered.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from . import ordered


# ------------------------------------------------------------- classification
def ranking_metrics(df: DataFrame, y: str, p: str, keys=(), weight=None) -> DataFrame:
    """AUROC (average ties) and average precision per key; `weight` names how many rows a counted row stands for."""
    r = ordered.value_ranks(df, p, keys, {"pos": F.col(y) * F.col(weight) if weight else F.col(y)}, weight)
    neg, neg_below, neg_total = F.col("n") - F.col("pos"), F.col("below") - F.col("pos_below"), F.col("total") - F.col("pos_total")
    wins = F.col("pos") * (neg_below + neg / 2)
    precision = (F.col("pos_total") - F.col("pos_below")) / (F.col("total") - F.col("below"))
    both = (F.max("pos_total") > 0) & (F.max(neg_total) > 0)
    return r.groupBy(*keys).agg(
        F.max("total").alias("n"), F.max("pos_total").alias("n_pos"),
        F.when(both, F.sum(wins) / (F.max("pos_total") * F.max(neg_total))).alias("auroc"),
        F.when(F.max("pos_total") > 0, F.sum(F.col("pos") / F.col("pos_total") * precision)).alias("auprc"))


def reliability(df: DataFrame, y: str, p: str, keys=(), bins: int = 10, weight=None) -> DataFrame:
    """Bins between distinct quantile edges: *keys, bin, n, conf, acc, total. The upper edge of a bin is inside it.

    `weight` names how many rows a counted row stands for.
    """
    keys = list(keys)
    probs = [i / bins for i in range(bins + 1)]
    edges = ordered.exact_quantiles(df, p, probs, keys, weight).select(
        *keys, F.array_sort(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(bins + 1)]))).alias("edges"))
    counted = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(
        (F.sum(weight) if weight else F.count("*")).alias("n"), F.sum(F.col(y) * F.col(weight) if weight else F.col(y)).alias("pos"))
    joined = counted.join(edges, keys) if keys else ordered.attach(counted, edges)
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = joined.where(F.size("edges") > 1).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(p))))
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"), (F.sum(F.col(p) * F.col("n")) / F.sum("n")).alias("conf"), (F.sum("pos") / F.sum("n")).alias("acc"))


def calibration_error(curve: DataFrame, keys=()) -> DataFrame:
    gap = F.abs(F.col("acc") - F.col("conf"))
    return curve.groupBy(*keys).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


# ------------------------------------------------------------------ agreement
def correlation(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """n, Pearson, Spearman (average ties) and a Fisher interval on Spearman, over rows holding both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ordered.with_ranks(ordered.with_ranks(both, x, "_rx", keys), y, "_ry", keys)
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))
    z, half = F.atanh("spearman"), 1.96 / F.sqrt(F.col("n") - 3)
    ok = (F.col("n") >= 4) & (F.abs("spearman") < 1)
    return out.withColumns({"ci_low": F.when(ok, F.tanh(z - half)), "ci_high": F.when(ok, F.tanh(z + half))})


def counted_spearman(cells: DataFrame, x: str, y: str, n: str) -> DataFrame:
    """n and Spearman (average ties) of rows given as counted cells (x, y, n), one row.

    Ranks are looked up in the marginal counts; deviations from the middle rank keep the sums small at any size.
    """
    cells = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda v, name: ordered.value_ranks(cells, v, weight=n).select(v, (ordered.average_rank() - (F.col("total") + 1) / 2).alias(name))
    both = cells.join(rank(x, "_rx"), x).join(rank(y, "_ry"), y)
    product = lambda a, b: F.sum(F.col(n) * F.col(a) * F.col(b))
    return both.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.try_divide(product("_rx", "_ry"), F.sqrt(product("_rx", "_rx") * product("_ry", "_ry"))).alias("spearman"))


def regression_metrics(df: DataFrame, y: str, p: str, keys=()) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def sign_accuracy(truth, guess, least=2.0):
    """Share of the right direction among changes of at least `least`; a guess of zero is half right."""
    hit = F.when(guess == 0, 0.5).otherwise((F.signum(truth) == F.signum(guess)).cast("double"))
    return F.avg(F.when(F.abs(truth) >= least, hit))


# ---------------------------------------------------------------------- tests
def normal_p(z):
    """Two-sided p of a standard normal; polynomial approximation of erf, absolute error below 1.5e-7."""
    x = F.abs(z) / (2.0 ** 0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(df: DataFrame, value: str, group, keys=()) -> DataFrame:
    """U of the rows where `group` is true against the others, Cliff's delta, tie-corrected z and p."""
    r = ordered.value_ranks(df.withColumn("_a", group.cast("int")), value, keys, {"a": F.col("_a")})
    nb, b, b_below = F.col("total") - F.col("a_total"), F.col("n") - F.col("a"), F.col("below") - F.col("a_below")
    cube = F.sum(F.pow(F.col("n"), 3) - F.col("n"))
    out = r.groupBy(*keys).agg(
        F.max("a_total").alias("n_a"), F.max(nb).alias("n_b"), F.sum(F.col("a") * (b_below + b / 2)).alias("u"), cube.alias("ties"))
    na, nb = F.col("n_a"), F.col("n_b")
    total = na + nb
    sigma = F.sqrt(na * nb / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = (F.col("u") - na * nb / 2) / sigma
    return out.where((na > 0) & (nb > 0)).withColumns({"delta": 2 * F.col("u") / (na * nb) - 1, "z": z, "p": normal_p(z)}).drop("ties")


def _fisher_one(a, b, c, d):
    row, col, total = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - total), min(row, col)
    k = np.arange(lo, hi, dtype=float)
    step = np.log((row - k) * (col - k)) - np.log((k + 1) * (total - row - col + k + 1))
    logp = np.concatenate([[0.0], np.cumsum(step)])
    w = np.exp(logp - logp.max())
    return float(w[w <= w[a - lo] * (1 + 1e-7)].sum() / w.sum())


def fisher_p(*counts):
    """Two-sided exact p of a 2x2 table of counts, one table per row: the tables no likelier than the one seen."""
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_fisher_one(*map(int, r)) for r in zip(a, b, c, d)])
    return pandas_udf(p, "double")(*counts)


def wilcoxon(pairs: DataFrame, diff: str, keys=()) -> DataFrame:
    """Signed-rank statistic of paired differences (zeros dropped), its z and p, the median difference and share above zero."""
    keys = list(keys)
    nonzero = pairs.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("_m", F.abs(diff))
    r = ordered.value_ranks(nonzero, "_m", keys, {"up": (F.col(diff) > 0).cast("int")})
    rank = ordered.average_rank()
    w = r.groupBy(*keys).agg(F.max("total").alias("n_used"), F.sum(F.col("up") * rank).alias("w_plus"),
                             F.sum((F.col("n") - F.col("up")) * rank).alias("w_minus"), F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("ties"))
    n = F.col("n_used")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    w = w.withColumns({"w": F.least("w_plus", "w_minus"), "z": z, "p": normal_p(z)})
    med = ordered.exact_quantiles(pairs, diff, [0.5], keys).select(*keys, F.col("q0").alias("median_diff"))
    share = pairs.groupBy(*keys).agg(F.count(diff).alias("n_pairs"), F.avg((F.col(diff) > 0).cast("double")).alias("frac_higher"))
    return (share.join(med, keys).join(w, keys) if keys else ordered.attach(ordered.attach(share, med), w)).drop("ties")


# ------------------------------------------------------------------ bootstrap
def hashed_uniform(*parts):
    """A number in [0, 1) that depends only on the given values, not on partitioning."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


# fixed values: cumulative probabilities of a Poisson variable of mean one
POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
               0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def poisson_one(u):
    w = F.lit(len(POISSON_ONE))
    for i in range(len(POISSON_ONE) - 1, -1, -1):
        w = F.when(u < POISSON_ONE[i], i).otherwise(w)
    return w


def cluster_bootstrap(df: DataFrame, group: str, sums, stat, replicates: int = 500, seed: int = 0) -> DataFrame:
    """Percentile interval of a statistic of sums, resampling whole groups by Poisson weights.

    Groups are reduced to their sums first; each (group, replicate) weight is a
    hash, and replicates are summed map-side, so rows never multiply.
    """
    per_group = df.groupBy(group).agg(*[F.sum(c).alias(s) for s, c in sums.items()])
    drawn = per_group.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    drawn = drawn.withColumn("_w", poisson_one(hashed_uniform(F.col(group), F.col("_rep"), F.lit(seed)))).where("_w > 0")
    reps = drawn.groupBy("_rep").agg(*[F.sum(F.col(s) * F.col("_w")).alias(s) for s in sums]).select("_rep", stat.alias("v"))
    ci = reps.agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("v").alias("n_replicates"))  # one value per replicate
    est = per_group.agg(*[F.sum(s).alias(s) for s in sums], F.count("*").alias("n_groups")).select(stat.alias("estimate"), "n_groups")
    return ordered.attach(est, ci).select("estimate", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "n_groups", "n_replicates")


# ---------------------------------------------------------------- linear model
def _products(names):
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def _matrix(row, names, prefix):
    m = np.zeros((len(names), len(names)))
    for i, j in _products(names):
        m[i, j] = m[j, i] = row[f"{prefix}{i}_{j}"]
    return m


def clustered_ols(df: DataFrame, y: str, terms, cluster: str):
    """OLS with cluster-robust standard errors: list of (term, coefficient, se) and R2.

    `terms` maps names to columns (an intercept is added). Only k-by-k sums reach
    the driver: one pass for the normal equations, one for the per-cluster scores.
    """
    names = ["intercept", *terms]
    x = df.select(F.col(cluster).alias("_c"), F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"),
                  *[c.cast("double").alias(f"_x{i + 1}") for i, c in enumerate(terms.values())])
    col = lambda i: F.col(f"_x{i}")
    first = x.agg(F.count("*").alias("n"), F.var_pop("_y").alias("v"), *[F.sum(col(i) * F.col("_y")).alias(f"b{i}") for i in range(len(names))],
                  *[F.sum(col(i) * col(j)).alias(f"g{i}_{j}") for i, j in _products(names)]).first()
    gram = _matrix(first, names, "g")
    inverse = np.linalg.pinv(gram)
    beta = inverse @ np.array([first[f"b{i}"] for i in range(len(names))])
    resid = F.col("_y") - sum((col(i) * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    scored = x.withColumn("_e", resid)
    per = scored.groupBy("_c").agg(F.sum(F.col("_e") * F.col("_e")).alias("sse"), *[F.sum(col(i) * F.col("_e")).alias(f"s{i}") for i in range(len(names))])
    second = per.agg(F.count("*").alias("g"), F.sum("sse").alias("sse"), F.max(F.abs("s0")).alias("m"),
                     *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in _products(names)],
                     *[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(names))]).first()
    n, g, k = first["n"], second["g"], len(names)
    scale = g / (g - 1) * (n - 1) / (n - k)
    cov = scale * inverse @ _matrix(second, names, "m") @ inverse
    rows = [(t, float(b), float(s)) for t, b, s in zip(names, beta, np.sqrt(np.maximum(np.diag(cov), 0)))]
    return rows, {"n": n, "n_clusters": g, "r2": 1 - second["sse"] / (first["v"] * n),
                  "orthogonality": max(abs(second[f"t{i}"]) for i in range(k)) / n}


def dummies(column: str, levels, prefix=None):
    """Indicator columns for the given levels (the reference level left out by the caller)."""
    return {f"{prefix or column}_{v}": (F.col(column) == v).cast("double") for v in levels}


# ------------------------------------------- designs summed in tasks, several keys at once
def gram(df: DataFrame, key: str, columns, weights=None):
    """{key: sum over rows of w * x x'}: each task sends one number per key and cell, whatever its rows.

    columns: the names of x. weights: optional name of w.
    """
    k = len(columns)

    def work(batches):
        held = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)], axis=1) if batch.num_rows else np.zeros((0, k))
            w = batch.column(k + 1).to_numpy(zero_copy_only=False) if weights else None
            for name in set(names):
                at = names == name
                left = x[at] * w[at][:, None] if weights else x[at]
                held[name] = held.get(name, 0) + left.T @ x[at]
        for name, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * (k * k)), pa.array(np.arange(k * k)), pa.array(m.ravel())], names=["key", "cell", "v"])

    given = df.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double") for c in columns], *([F.col(weights).cast("double")] if weights else []))
    sums = given.mapInArrow(work, "key string, cell long, v double").groupBy("key", "cell").agg(F.sum("v").alias("v")).collect()  # keys x k x k
    out = {}
    for r in sums:
        out.setdefault(r["key"], np.zeros(k * k))[r["cell"]] = r["v"]
    return {name: m.reshape(k, k) for name, m in out.items()}


def nested_r2(m, models):
    """R2 of several models out of one Gram matrix whose first column is the intercept and whose last is the outcome.

    models: {name: places of its columns}; the intercept is always in.
    """
    n, total = m[0, 0], m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    out = {}
    for name, places in models.items():
        at = [0, *places]
        beta = np.linalg.lstsq(m[np.ix_(at, at)], m[at, -1], rcond=1e-12)[0]
        out[name] = float(1 - (m[-1, -1] - beta @ m[at, -1]) / total) if n and total > 0 else None
    return out


def _sandwich(df, key, cluster, columns, residual, bread, n):
    """{key: cluster-robust covariance}: scores are summed per cluster, then their products per key."""
    per = df.groupBy(key, cluster).agg(*[F.sum(F.col(c) * residual).alias(c) for c in columns])
    meat, groups = gram(per, key, columns), {str(r[key]): r["g"] for r in per.groupBy(key).agg(F.count("*").alias("g")).collect()}
    out = {}
    for name, b in bread.items():
        g, k = groups[name], np.linalg.matrix_rank(b)
        out[name] = (g / (g - 1) * (n[name] - 1) / (n[name] - k) * b @ meat[name] @ b, g)
    return out


def _linear(key, columns, beta):
    """The fitted x'b of every row, with the coefficients of its key as literals."""
    value = F.lit(None).cast("double")
    for name, b in beta.items():
        value = F.when(F.col(key).cast("string") == name, sum((F.col(c) * float(v) for c, v in zip(columns, b)), F.lit(0.0))).otherwise(value)
    return value


def clustered_linear(df: DataFrame, key: str, y: str, columns, cluster: str):
    """Per key OLS on columns (give the intercept as one of them): {key: (coefficients, covariance, n, clusters, gram)}."""
    m = gram(df, key, [*columns, y])
    beta = {name: np.linalg.pinv(g[:-1, :-1]) @ g[:-1, -1] for name, g in m.items()}
    bread = {name: np.linalg.pinv(g[:-1, :-1]) for name, g in m.items()}
    n = {name: g[0, 0] for name, g in m.items()}
    cov = _sandwich(df, key, cluster, columns, F.col(y) - _linear(key, columns, beta), bread, n)
    return {name: (beta[name], *cov[name], int(n[name]), m[name]) for name in m}


def clustered_logit(df: DataFrame, key: str, y: str, columns, cluster: str, passes: int = 30, tolerance: float = 1e-10):
    """Per key logistic regression by reweighted least squares over rows: {key: (coefficients, covariance, clusters, n, converged)}.

    Rows of equal columns and outcome are counted once, and the passes read the counts; each sums one weighted Gram matrix
    in the tasks. Columns without variation in a key get a zero coefficient.
    """
    cells = cut_lineage(df.groupBy(key, *columns, y).agg(F.count("*").alias("_n")))
    counts = {str(r[key]): r["n"] for r in cells.groupBy(key).agg(F.sum("_n").alias("n")).collect()}  # the keys are few
    beta = {name: np.zeros(len(columns)) for name in counts}
    settled, m = dict.fromkeys(beta, False), {}
    for _ in range(passes):
        eta = F.greatest(F.least(_linear(key, columns, beta), F.lit(30.0)), F.lit(-30.0))
        p = 1 / (1 + F.exp(-eta))
        x = cells.withColumn("_w", p * (1 - p)).withColumn("_z", eta + (F.col(y) - p) / F.col("_w")).withColumn("_w", F.col("_w") * F.col("_n"))
        m = gram(x, key, [*columns, "_z"], "_w")
        for name, g in m.items():
            new = np.linalg.pinv(g[:-1, :-1], rcond=1e-12) @ g[:-1, -1]
            settled[name] = bool(np.abs(new - beta[name]).max() < tolerance)
            beta[name] = new
        if all(settled.values()):
            break
    p = 1 / (1 + F.exp(-_linear(key, columns, beta)))
    bread = {name: np.linalg.pinv(g[:-1, :-1], rcond=1e-12) for name, g in m.items()}
    cov = _sandwich(df, key, cluster, columns, F.col(y) - p, bread, counts)
    return {name: (beta[name], *cov[name], counts[name], settled[name]) for name in beta}


# ------------------------------------------------------------- benchmark table
def benchmark_table(df: DataFrame, keys, group: str, y: str, p: str, replicates: int = 200, seed: int = 0, bins: int = 100) -> DataFrame:
    """AUROC, AUPRC, Brier score, calibration error and accuracy per key with percentile intervals over whole groups.

    Every group becomes one mergeable sketch: counts of rows and positives per score bin, and sums of score and of its
    square. A replicate weighs groups by a hash of (group, replicate) and adds sketches, so rows are read once; scores
    are cut into `bins` equal bins between 0 and 1, and rows of one bin count as ties.
    """
    keys = list(keys)
    cell = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))
    cells = cell.groupBy(*keys, group, "_b").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("pos"), F.sum(p).alias("s1"), F.sum(F.col(p) * F.col(p)).alias("s2"),
        F.sum(F.col(p) * F.col(y)).alias("sy"), F.sum(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("right"))
    reps = F.sequence(F.lit(-1), F.lit(replicates - 1))  # -1: every group once
    draws = cells.select(*keys, group).distinct().withColumn("rep", F.explode(reps)).withColumn(
        "w", F.when(F.col("rep") < 0, 1).otherwise(poisson_one(hashed_uniform(F.col(group), F.col("rep"), F.lit(seed)))).cast("double")).where("w > 0")
    sums = ["n", "pos", "s1", "s2", "sy", "right"]
    merged = cells.join(draws, [*keys, group]).groupBy(*keys, "rep", "_b").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in sums])
    over = Window.partitionBy(*keys, "rep").orderBy(F.desc("_b"))  # at most `bins` rows
    up = merged.withColumns({"above": F.sum("n").over(over), "hits": F.sum("pos").over(over)})
    tenth = F.least(F.floor(F.col("_b") * 10 / bins), F.lit(9))
    ten = merged.groupBy(*keys, "rep", tenth.alias("_t")).agg(*[F.sum(c).alias(c) for c in ("n", "pos", "s1")])
    ece = ten.groupBy(*keys, "rep").agg((F.sum(F.abs(F.col("pos") - F.col("s1"))) / F.sum("n")).alias("ece"))
    neg = F.col("n") - F.col("pos")
    total_pos, total = F.sum("pos"), F.sum("n")
    wins = F.sum(neg * (F.col("hits") - F.col("pos") / 2))  # positives at or above, ties half
    per = up.groupBy(*keys, "rep").agg(
        F.try_divide(wins, total_pos * (total - total_pos)).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * F.col("hits") / F.col("above")), total_pos).alias("auprc"),
        ((F.sum("s2") - 2 * F.sum("sy") + total_pos) / total).alias("brier"), (F.sum("right") / total).alias("accuracy"),
        total.cast("bigint").alias("n")).join(ece, [*keys, "rep"])
    return _with_intervals(per, keys, ["auroc", "auprc", "brier", "ece", "accuracy"])


def benchmark_values(df: DataFrame, keys, group: str, y: str, p: str, replicates: int = 200, seed: int = 0, bins: int = 32) -> DataFrame:
    """MAE, R2 and Spearman correlation per key with percentile intervals over whole groups, from mergeable sketches.

    A group becomes counts on a grid of `bins` by `bins` cells between the extremes of its key, and sums; ranks are those
    of the cells, rows of one cell line count as ties.
    """
    keys = list(keys)
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    edges = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in (y, p) for n, f in (("lo", F.min), ("hi", F.max))])
    place = lambda c: F.least(F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(f"_lo{c}")) * bins, F.col(f"_hi{c}") - F.col(f"_lo{c}")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    e = F.col(p) - F.col(y)
    cells = df.join(F.broadcast(edges), keys).groupBy(*keys, group, place(p).alias("_i"), place(y).alias("_j")).agg(  # a row per key
        F.count("*").cast("double").alias("n"), F.sum(F.abs(e)).alias("ae"), F.sum(e * e).alias("se"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    draws = cells.select(*keys, group).distinct().withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1)))).withColumn(
        "w", F.when(F.col("rep") < 0, 1).otherwise(poisson_one(hashed_uniform(F.col(group), F.col("rep"), F.lit(seed)))).cast("double")).where("w > 0")
    merged = cells.join(draws, [*keys, group]).groupBy(*keys, "rep", "_i", "_j").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "ae", "se", "sy", "syy")])

    def midrank(line, name):
        before = Window.partitionBy(*keys, "rep").orderBy(line).rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
        return merged.groupBy(*keys, "rep", line).agg(F.sum("n").alias("m")).select(
            *keys, "rep", line, (F.coalesce(F.sum("m").over(before), F.lit(0.0)) + F.col("m") / 2).alias(name))

    j = merged.join(midrank("_i", "ri"), [*keys, "rep", "_i"]).join(midrank("_j", "rj"), [*keys, "rep", "_j"])
    n, s = F.sum("n"), lambda c: F.sum(F.col("n") * c)
    ri, rj = F.col("ri"), F.col("rj")
    cov, vi, vj = s(ri * rj) - s(ri) * s(rj) / n, s(ri * ri) - s(ri) * s(ri) / n, s(rj * rj) - s(rj) * s(rj) / n
    per = j.groupBy(*keys, "rep").agg(
        (F.sum("ae") / n).alias("mae"), (1 - F.try_divide(F.sum("se"), F.sum("syy") - F.sum("sy") * F.sum("sy") / n)).alias("r2"),
        F.try_divide(cov, F.sqrt(vi * vj)).alias("spearman"), n.cast("bigint").alias("n"))
    return _with_intervals(per, keys, ["mae", "r2", "spearman"])


def _with_intervals(per: DataFrame, keys, metrics) -> DataFrame:
    """(*keys, metric, n, value, ci_low, ci_high) from one row per replicate; replicate -1 is the table itself."""
    long = per.select(*keys, "rep", "n", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])))
    q = F.percentile(F.when(F.col("rep") >= 0, F.col("v")), F.array(F.lit(0.025), F.lit(0.975)))  # one value per replicate
    return long.groupBy(*keys, "metric").agg(
        F.max(F.when(F.col("rep") < 0, F.col("n"))).alias("n"), F.max(F.when(F.col("rep") < 0, F.col("v"))).alias("value"),
        q.alias("_q")).select(*keys, "metric", "n", "value", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


# ------------------------------------------------------- isotonic calibration
def _pooled(low, high, n, total):
    """Adjacent blocks (ascending) pooled until their means ascend."""
    out = []
    for block in zip(low, high, n, total):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            a, b = out[-2:]
            out[-2:] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]]]
    return out


def isotonic(df: DataFrame, p: str, y: str, keys=(), tiles: int = 256) -> DataFrame:
    """Steps of the isotonic fit of y (0 or 1) on p: (*keys, low, high, n, positives); the value is positives / n.

    Equal scores are one block. Blocks are pooled within tiles of the score first, where the tiles run side by side;
    what a tile leaves is ascending, and pooling those blocks once more per key gives the same fit as pooling all rows.
    """
    keys = list(keys)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema) + "low double, high double, n bigint, positives bigint"
    blocks = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("low")).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives")).withColumn("high", F.col("low"))

    def pool(frame):
        frame = frame.sort_values("low")
        out = pd.DataFrame(_pooled(*[frame[c].tolist() for c in ("low", "high", "n", "positives")]), columns=["low", "high", "n", "positives"])
        for c in keys:
            out[c] = frame[c].iloc[0]
        return out[[*keys, "low", "high", "n", "positives"]]

    inside = blocks.withColumn("_tile", F.floor(F.col("low") * tiles)).groupBy(*keys, "_tile").applyInPandas(pool, schema)
    return inside.groupBy(*keys).applyInPandas(pool, schema)


def calibrated(df: DataFrame, p: str, steps: DataFrame, name: str, keys=()) -> DataFrame:
    """Append the value of p on the steps: the block that holds it, else the straight line between its neighbours.

    The steps of a key travel as one sorted array; there are at most as many as the fit has levels.
    """
    keys = list(keys)
    line = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("low", "high", (F.col("positives") / F.col("n")).alias("v")))).alias("_s"))
    j = df.join(F.broadcast(line), keys) if keys else df.crossJoin(F.broadcast(line))  # a row per key
    at = F.size(F.filter("_s", lambda b: b["low"] <= F.col(p)))
    j = j.withColumn("_at", at)
    here, after = F.get("_s", F.col("_at") - 1), F.get("_s", F.col("_at"))
    between = here["v"] + (after["v"] - here["v"]) * F.try_divide(F.col(p) - here["high"], after["low"] - here["high"])
    value = (F.when(F.col("_at") == 0, after["v"]).when((F.col(p) <= here["high"]) | (F.col("_at") == F.size("_s")), here["v"]).otherwise(between))
    return j.withColumn(name, value).drop("_s", "_at")
