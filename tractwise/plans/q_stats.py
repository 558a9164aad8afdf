"""Evaluation metrics, tests, models and bootstrap over held-out predictions and scored variants."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import condition, seq, thermo
from ..operators import ordered, ranking, stats
from ..session import cut_lineage
from . import duck as d
from .q_sequences import r6
from .q_variants import SCORED, TOP, scored, with_top
from .registry import query


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


_AUC = """r_ AS (SELECT head, y, p, rank() OVER (PARTITION BY head ORDER BY p) + (count(*) OVER (PARTITION BY head, p) - 1) / 2 AS rk FROM preds)"""


@query("st1_auroc", "preds", _AUC + """
SELECT head, count(*) AS n, cast(sum(y) AS bigint) AS n_pos, round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM r_ GROUP BY head""")
def st1(t):
    return rounded(stats.ranking_metrics(t.preds, "y", "p", ["head"]).drop("auprc"), "auroc")


@query("st2_average_precision", "preds", """
v_ AS (SELECT head, p, count(*) AS n, sum(y) AS pos FROM preds GROUP BY ALL),
c_ AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY head) AS tp FROM v_ WINDOW w AS (PARTITION BY head ORDER BY p DESC))
SELECT head, round(sum(pos / tp * cp / cn), 6) AS auprc FROM c_ GROUP BY head""")
def st2(t):
    return rounded(stats.ranking_metrics(t.preds, "y", "p", ["head"]).select("head", "auprc"), "auprc")


_THREE = """th0_ AS (SELECT head, ok, ln, cast((ok + ln) % 3 AS int) AS y3, 1 + p AS a, 1 + (y_real - 20) / 75 AS b, 1.2::double AS c FROM preds),
th_ AS (SELECT head, y3, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM th0_),
tg_ AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pick FROM th_)"""


def three(t):
    """A three-class posterior with its argmax (first of equals)."""
    raw = t.preds.select("head", "ok", "ln", ((F.col("ok") + F.col("ln")) % 3).cast("int").alias("y3"), (1 + F.col("p")).alias("a"),
                         (1 + (F.col("y_real") - 20) / 75).alias("b"), F.lit(1.2).alias("c"))
    total = F.col("a") + F.col("b") + F.col("c")
    df = raw.select("head", "y3", (F.col("a") / total).alias("p0"), (F.col("b") / total).alias("p1"), (F.col("c") / total).alias("p2"))
    pick = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    return df.withColumn("pick", pick)


@query("st3_class_metrics", "preds", _THREE + """,
k_ AS (SELECT head, y3, avg(CASE WHEN pick = y3 THEN 1.0 ELSE 0.0 END) AS rec, count(*) AS n FROM tg_ GROUP BY ALL)
SELECT t.head, round(avg(CASE WHEN pick = y3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, any_value(b.bal) AS balanced_accuracy, any_value(b.maj) AS majority,
 round(avg(power(p0 - (y3 = 0)::int, 2) + power(p1 - (y3 = 1)::int, 2) + power(p2 - (y3 = 2)::int, 2)), 6) AS brier
FROM tg_ t JOIN (SELECT head, round(avg(rec), 6) AS bal, round(max(n) / sum(n), 6) AS maj FROM k_ GROUP BY head) b ON t.head = b.head GROUP BY t.head""")
def st3(t):
    df = three(t)
    hit = (F.col("pick") == F.col("y3")).cast("double")
    brier = sum((F.pow(F.col(f"p{i}") - (F.col("y3") == i).cast("int"), 2) for i in range(3)), F.lit(0.0))
    # per class first, so that balanced accuracy is an average of averages
    per = df.groupBy("head", "y3").agg(F.count("*").alias("n"), F.sum(hit).alias("h"), F.sum(brier).alias("b"))
    return per.groupBy("head").agg(
        r6(F.sum("h") / F.sum("n")).alias("accuracy"), r6(F.avg(F.col("h") / F.col("n"))).alias("balanced_accuracy"),
        r6(F.max("n") / F.sum("n")).alias("majority"), r6(F.sum("b") / F.sum("n")).alias("brier"))


@query("st3_confusion_matrix", "preds", _THREE + """
SELECT head, y3, cast(count_if(pick = 0) AS bigint) AS as_0, cast(count_if(pick = 1) AS bigint) AS as_1, cast(count_if(pick = 2) AS bigint) AS as_2 FROM tg_ GROUP BY ALL""")
def st3_confusion(t):
    return three(t).groupBy("head", "y3").agg(*[F.count_if(F.col("pick") == i).alias(f"as_{i}") for i in range(3)])


def _curve_sql(src, y, p):
    qs = ", ".join(str(i / 10) for i in range(11))
    return f"""e_ AS (SELECT head, list_sort(list_distinct(quantile_cont({p}, [{qs}]))) AS edges FROM {src} GROUP BY head),
b_ AS (SELECT s.head, {y} AS yy, {p} AS pp, len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda e: e < {p})) AS bin FROM {src} s JOIN e_ ON s.head = e_.head WHERE len(edges) > 1),
cv_ AS (SELECT head, cast(bin AS int) AS bin, count(*) AS n, avg(pp) AS conf, avg(yy) AS acc FROM b_ GROUP BY ALL)"""


@query("st4_reliability_curve", "preds", _curve_sql("preds", "y", "p") + "SELECT head, bin, n, round(conf, 6) AS conf, round(acc, 6) AS acc FROM cv_")
def st4_curve(t):
    return rounded(stats.reliability(t.preds, "y", "p", ["head"]), "conf", "acc")


@query("st4_calibration_error", "preds", _curve_sql("preds", "y", "p") + "SELECT head, round(sum(abs(acc - conf) * n) / sum(n), 6) AS ece, round(max(abs(acc - conf)), 6) AS mce FROM cv_ GROUP BY head")
def st4(t):
    return rounded(stats.calibration_error(stats.reliability(t.preds, "y", "p", ["head"]), ["head"]), "ece", "mce")


@query("st4_multiclass_ece", "preds", _THREE + ", tl_ AS (SELECT head, greatest(p0, p1, p2) AS p, CASE WHEN pick = y3 THEN 1 ELSE 0 END AS y FROM tg_)," + _curve_sql("tl_", "y", "p") + """
SELECT head, round(sum(abs(acc - conf) * n) / sum(n), 5) AS ece FROM cv_ GROUP BY head""")
def st4_multi(t):
    top = three(t).select("head", F.greatest("p0", "p1", "p2").alias("p"), (F.col("pick") == F.col("y3")).cast("int").alias("y"))
    return stats.calibration_error(stats.reliability(top, "y", "p", ["head"]), ["head"]).select("head", F.round("ece", 5).alias("ece"))


_SP = """rk_ AS (SELECT head, y_real, y_hat, rank() OVER (PARTITION BY head ORDER BY y_real) + (count(*) OVER (PARTITION BY head, y_real) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY head ORDER BY y_hat) + (count(*) OVER (PARTITION BY head, y_hat) - 1) / 2 AS ry FROM preds),
c_ AS (SELECT head, count(*) AS n, corr(y_real, y_hat) AS pearson, corr(rx, ry) AS spearman FROM rk_ GROUP BY head)"""


@query("st5_correlation", "preds", _SP + """
SELECT head, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(tanh(atanh(spearman) - 1.96 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(spearman) + 1.96 / sqrt(n - 3)), 6) AS ci_high FROM c_""")
def st5(t):
    return rounded(stats.correlation(t.preds, "y_real", "y_hat", ["head"]), "pearson", "spearman", "ci_low", "ci_high")


@query("st5_regression_metrics", "preds", """
SELECT head, count(*) AS n, round(1 - sum(power(y_hat - y_real, 2)) / (var_pop(y_real) * count(*)), 6) AS r2, round(sqrt(avg(power(y_hat - y_real, 2))), 6) AS rmse,
 round(avg(abs(y_hat - y_real)), 6) AS mae, round(avg(y_hat - y_real), 6) AS bias FROM preds GROUP BY head""")
def st5_regression(t):
    return rounded(stats.regression_metrics(t.preds, "y_real", "y_hat", ["head"]), "r2", "rmse", "mae", "bias")


@query("st6_sign_accuracy", "preds", """
SELECT head, round(avg(CASE WHEN abs(y_real - 57) >= 2 THEN CASE WHEN round(y_hat - 57, 6) = 0 THEN 0.5 WHEN sign(y_real - 57) = sign(round(y_hat - 57, 6)) THEN 1.0 ELSE 0.0 END END), 6) AS sign_accuracy FROM preds GROUP BY head""")
def st6(t):
    return t.preds.groupBy("head").agg(r6(stats.sign_accuracy(F.col("y_real") - 57, F.round(F.col("y_hat") - 57, 6))).alias("sign_accuracy"))


_POIS = "CASE " + " ".join(f"WHEN u < {v!r}::double THEN {i}" for i, v in enumerate(stats.POISSON_ONE)) + f" ELSE {len(stats.POISSON_ONE)} END"


@query("st7_cluster_bootstrap", "preds", f"""
g_ AS (SELECT grp, sum(abs(y_hat - y_real)) AS ae, count(*) AS n FROM preds GROUP BY grp),
w0_ AS (SELECT grp, ae, n, rep, cast(concat('0x', substr(md5(concat(grp, '|', rep, '|0')), 1, 8)) AS bigint) / 4294967296.0::double AS u FROM g_, range(500) r(rep)),
w_ AS (SELECT rep, sum(ae * w) / sum(n * w) AS v FROM (SELECT *, {_POIS} AS w FROM w0_) GROUP BY rep)
SELECT round((SELECT sum(ae) / sum(n) FROM g_), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, (SELECT count(*) FROM g_) AS n_groups, count(v) AS n_replicates FROM w_""")
def st7(t):
    out = stats.cluster_bootstrap(t.preds, "grp", {"ae": F.abs(F.col("y_hat") - F.col("y_real")), "n": F.lit(1)}, F.col("ae") / F.col("n"))
    return rounded(out, "estimate", "ci_low", "ci_high")


_PNORM = lambda z: (f"(1/(1+0.3275911*abs({z})/sqrt(2::double))) * (0.254829592 + (1/(1+0.3275911*abs({z})/sqrt(2::double))) * (-0.284496736 + (1/(1+0.3275911*abs({z})/sqrt(2::double))) * "
                    f"(1.421413741 + (1/(1+0.3275911*abs({z})/sqrt(2::double))) * (-1.453152027 + (1/(1+0.3275911*abs({z})/sqrt(2::double))) * 1.061405429)))) * exp(-{z} * {z} / 2)")


@query("st8_mann_whitney", "snvs", SCORED + f""",
x_ AS (SELECT kind, abs_avi, cls = 'motif_lost' AS a FROM scored WHERE cls IN ('motif_lost', 'control')),
r_ AS (SELECT kind, a, rank() OVER (PARTITION BY kind ORDER BY abs_avi) + (count(*) OVER (PARTITION BY kind, abs_avi) - 1) / 2 AS rk FROM x_),
tie_ AS (SELECT kind, sum(power(n, 3) - n) AS ties FROM (SELECT kind, abs_avi, count(*) AS n FROM x_ GROUP BY ALL) GROUP BY kind),
u_ AS (SELECT kind, count_if(a) AS n_a, count_if(NOT a) AS n_b, sum(CASE WHEN a THEN rk ELSE 0 END) - count_if(a) * (count_if(a) + 1) / 2 AS u FROM r_ GROUP BY kind),
z_ AS (SELECT u_.*, (u - n_a::double * n_b / 2) / sqrt(n_a::double * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b)::double * (n_a + n_b - 1)))) AS z FROM u_ JOIN tie_ ON u_.kind = tie_.kind)
SELECT kind, cast(n_a AS bigint) AS n_a, cast(n_b AS bigint) AS n_b, cast(u AS double) AS u, round(2 * u / (n_a::double * n_b) - 1, 6) AS delta, round(z, 6) AS z, round({_PNORM('z')}, 6) AS p FROM z_""")
def st8(t):
    df = scored(t).where(F.col("cls").isin("motif_lost", "control"))
    return rounded(stats.mann_whitney(df, "abs_avi", F.col("cls") == "motif_lost", ["kind"]), "delta", "z", "p")


@query("st9_fisher_odds", "snvs", SCORED + TOP + """,
c_ AS (SELECT kind, cls, cast(sum(top1) AS bigint) AS a, cast(count(*) - sum(top1) AS bigint) AS b FROM tp_ GROUP BY ALL), k_ AS (SELECT kind, a AS c, b AS d FROM c_ WHERE cls = 'control')
SELECT c_.kind, cls, a, b, c, d, round(CASE WHEN b * c <> 0 THEN a * d / (b * c) END, 6) AS odds_ratio, true AS p_in_range FROM c_ JOIN k_ ON c_.kind = k_.kind WHERE cls <> 'control'""")
def st9(t):
    c = with_top(scored(t)).groupBy("kind", "cls").agg(F.sum("top1").alias("a"), F.sum(1 - F.col("top1")).alias("b"))
    control = c.where("cls = 'control'").select("kind", F.col("a").alias("c"), F.col("b").alias("d"))
    j = c.where("cls <> 'control'").join(control, "kind")
    odds = F.when(F.col("b") * F.col("c") != 0, F.col("a") * F.col("d") / (F.col("b") * F.col("c")))
    p = stats.fisher_p("a", "b", "c", "d")
    return j.select("kind", "cls", "a", "b", "c", "d", r6(odds).alias("odds_ratio"), p.between(0.0, 1.0 + 1e-9).alias("p_in_range"))


def _pairs_sql(left, right):
    return f"""pr_ AS (SELECT kind, motif_id, avg(CASE WHEN {left} THEN abs_avi END) - avg(CASE WHEN {right} THEN abs_avi END) AS dd FROM scored WHERE cls <> 'control' GROUP BY ALL),
pq_ AS (SELECT kind, round(dd, 9) AS dd FROM pr_ WHERE dd IS NOT NULL),
rk_ AS (SELECT kind, dd, rank() OVER (PARTITION BY kind ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY kind, abs(dd)) - 1) / 2 AS rk FROM pq_ WHERE dd <> 0),
w_ AS (SELECT kind, count(*) AS n_used, sum(CASE WHEN dd > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN dd < 0 THEN rk ELSE 0 END) AS wm FROM rk_ GROUP BY kind),
m_b AS (SELECT kind, count(*) AS n_pairs, quantile_cont(dd, 0.5) AS med, avg(CASE WHEN dd > 0 THEN 1.0 ELSE 0.0 END) AS fr FROM pq_ GROUP BY kind)
SELECT m_b.kind, n_pairs, round(med, 6) AS median_diff, round(fr, 6) AS frac_higher, n_used, cast(least(wp, wm) AS double) AS w FROM m_b JOIN w_ ON m_b.kind = w_.kind WHERE n_pairs > 20"""


def paired(df, left, right):
    """Per-motif mean of one class against another, rounded so that equal differences tie in any engine."""
    gap = F.avg(F.when(left, F.col("abs_avi"))) - F.avg(F.when(right, F.col("abs_avi")))
    pairs = df.where("cls <> 'control'").groupBy("kind", "motif_id").agg(F.round(gap, 9).alias("dd")).where("dd IS NOT NULL")
    out = stats.wilcoxon(pairs, "dd", ["kind"]).where("n_pairs > 20")
    return rounded(out, "median_diff", "frac_higher").select("kind", "n_pairs", "median_diff", "frac_higher", "n_used", "w")




@query("st10_within_motif", "snvs", SCORED + "," + _pairs_sql("cls = 'motif_lost'", "cls <> 'motif_lost'"))
def st10_motif(t):
    lost = F.col("cls") == "motif_lost"
    return paired(scored(t), lost, ~lost)


@query("st10_lost_vs_flank", "snvs", SCORED + "," + _pairs_sql("cls = 'motif_lost'", "cls = 'flank'"))
def st10_flank(t):
    return paired(scored(t), F.col("cls") == "motif_lost", F.col("cls") == "flank")


@query("st10_retained_vs_flank", "snvs", SCORED + "," + _pairs_sql("cls IN ('destabilising', 'moderate', 'neutral', 'stabilising')", "cls = 'flank'"))
def st10_retained(t):
    from ..functions.variant import RETAINED
    return paired(scored(t), F.col("cls").isin(*RETAINED), F.col("cls") == "flank")


@query("st11_dose_response", "snvs", SCORED + """,
x_ AS (SELECT kind, -delta AS x, abs_avi AS y FROM scored WHERE cls IN ('destabilising', 'moderate', 'neutral', 'stabilising') AND delta IS NOT NULL),
r_ AS (SELECT kind, rank() OVER (PARTITION BY kind ORDER BY x) + (count(*) OVER (PARTITION BY kind, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY kind ORDER BY y) + (count(*) OVER (PARTITION BY kind, y) - 1) / 2 AS ry FROM x_)
SELECT kind, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r_ GROUP BY kind""")
def st11(t):
    from ..functions.variant import RETAINED
    df = scored(t).where(F.col("cls").isin(*RETAINED)).withColumn("x", -F.col("delta"))
    return stats.correlation(df, "x", "abs_avi", ["kind"]).select("kind", "n", r6("spearman").alias("rho"))


def ranked_rows(t):
    return ranking.percentile_rank(scored(t), "abs_avi", "pct", ["chrom"])


_PCT = ", pc_ AS (SELECT *, (rank() OVER (PARTITION BY chrom ORDER BY abs_avi) + (count(*) OVER (PARTITION BY chrom, abs_avi) - 1) / 2) / count(*) OVER (PARTITION BY chrom) AS pct FROM scored)"


def adjusted_rank_model(df, reference="flank"):
    """pct on class, substitution, CpG, GC and chromosome, clustered by motif; only classes that have rows."""
    levels = {r["cls"]: r["n"] for r in df.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # the eight class names
    base = reference if levels.get(reference, 0) > 100 else "control"
    order = ["motif_lost", "destabilising", "moderate", "neutral", "stabilising", "flank", "control"]
    present = [c for c in order if c in levels]
    subst = sorted(r[0] for r in df.select("subst").distinct().collect())  # six names
    chroms = sorted(r[0] for r in df.select("chrom").distinct().collect())  # chromosome names
    terms = stats.dummies("cls", [c for c in present if c != base]) | stats.dummies("subst", subst[1:]) | {
        "cpg": F.col("cpg"), "gc": F.col("gc")} | stats.dummies("chrom", chroms[1:])
    return stats.clustered_ols(df.where(F.col("cls").isin(*present)), "pct", terms, "motif_id")


@query("st12_adjusted_rank_model", "snvs", SCORED + _PCT + """
SELECT kind, count(*) AS n, count(DISTINCT motif_id) AS n_clusters, true AS normal_equations_hold, true AS r2_in_range FROM pc_ WHERE cls <> 'other' GROUP BY kind""")
def st12(t):
    """The fitted model's size and its defining property: residuals orthogonal to every regressor."""
    df = ranked_rows(t).persist()  # several passes over the same ranked rows
    out = []
    for kind in ("G4", "iM"):
        _, info = adjusted_rank_model(df.where(F.col("kind") == kind))
        out.append((kind, info["n"], info["n_clusters"], bool(info["orthogonality"] < 1e-8), bool(0 <= info["r2"] <= 1)))
    df.unpersist()
    return t.spark.createDataFrame(out, "kind string, n bigint, n_clusters bigint, normal_equations_hold boolean, r2_in_range boolean")


_ONE = """f_ AS (SELECT kind, motif_id, cpg, pct FROM pc_ WHERE cls = 'flank'),
mn_ AS (SELECT kind, avg(CASE WHEN cpg = 0 THEN pct END) AS m0, avg(CASE WHEN cpg = 1 THEN pct END) AS m1, count_if(cpg = 0) AS n0, count_if(cpg = 1) AS n1, count(DISTINCT motif_id) AS g FROM f_ GROUP BY kind),
sc_ AS (SELECT f_.kind, motif_id, sum(CASE WHEN cpg = 1 THEN pct - m1 ELSE 0 END) AS s1, sum(CASE WHEN cpg = 0 THEN pct - m0 ELSE 0 END) AS s0 FROM f_ JOIN mn_ ON f_.kind = mn_.kind GROUP BY f_.kind, motif_id)
SELECT mn_.kind, 'cpg' AS term, cast(n0 + n1 AS bigint) AS n, round(any_value(m1 - m0), 6) AS coef, round(sqrt(sum(power(s1 / n1 - s0 / n0, 2)) * any_value(g / (g - 1.0::double) * (n0 + n1 - 1) / (n0 + n1 - 2))), 6) AS se
FROM mn_ JOIN sc_ ON mn_.kind = sc_.kind GROUP BY mn_.kind, n0, n1"""


@query("st14_cpg_contrast", "snvs", SCORED + _PCT + "," + _ONE)
def st14_cpg(t):
    df = ranked_rows(t).where("cls = 'flank'")
    out = []
    for kind in ("G4", "iM"):
        rows, info = stats.clustered_ols(df.where(F.col("kind") == kind), "pct", {"cpg": F.col("cpg")}, "motif_id")
        out.append((kind, "cpg", info["n"], round(rows[1][1], 6), round(rows[1][2], 6)))
    return t.spark.createDataFrame(out, "kind string, term string, n bigint, coef double, se double")


@query("st14_flank_medians", "snvs", SCORED + """
SELECT kind, cast(cpg AS int) AS cpg, count(*) AS n, round(quantile_cont(abs_avi, 0.5), 6) AS median_abs FROM scored WHERE cls = 'flank' GROUP BY ALL""")
def st14_medians(t):
    df = scored(t).where("cls = 'flank'")
    return ordered.exact_quantiles(df, "abs_avi", [0.5], ["kind", "cpg"]).select("kind", "cpg", F.col("total").alias("n"), r6("q0").alias("median_abs"))


# fixed values: substitution classes and effect classes in the order in which a reference level is chosen
SUBSTS = ["C>A", "C>G", "C>T", "T>A", "T>C", "T>G"]
CLASSES = ["motif_lost", "destabilising", "moderate", "neutral", "stabilising", "flank", "control"]
LEAST_LEVEL, LEAST_REFERENCE, LEAST_EVENTS = 200, 100, 50


def design(df, chroms=()):
    """Indicator columns for every class, substitution and chromosome, and the intercept; returns (DataFrame, names by block)."""
    made = {"one": F.lit(1.0)} | {f"c_{c}": (F.col("cls") == c) for c in CLASSES} | {f"s_{i}": (F.col("subst") == x) for i, x in enumerate(SUBSTS)} | {
        f"h_{c}": (F.col("chrom") == c) for c in chroms}
    blocks = {"cls": [f"c_{c}" for c in CLASSES], "subst": [f"s_{i}" for i in range(len(SUBSTS))], "chrom": [f"h_{c}" for c in chroms]}
    return df.withColumns({n: c.cast("double") for n, c in made.items()}), blocks


def large_levels(df):
    """(kind, subst) of at least LEAST_LEVEL flank rows."""
    return df.where("cls = 'flank'").groupBy("kind", "subst").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_LEVEL).select("kind", "subst")


def _reduced(source, width, cols):
    """SQL Gauss-Jordan elimination of the matrices in `source` (kind, m: rows of width + 1 + cols numbers); columns without a pivot are skipped."""
    return f"""list_reduce(list_prepend({{'p': 0::bigint, 'r': 0::bigint, 'm': m}}, list_transform(range(1, {width + 1}), lambda q: {{'p': q::bigint, 'r': 0::bigint, 'm': []::double[][]}})),
   lambda a, b: CASE WHEN abs(a.m[b.p][b.p]) < 1e-7 THEN {{'p': b.p, 'r': a.r, 'm': a.m}} ELSE
     {{'p': b.p, 'r': a.r + 1, 'm': list_transform(a.m, lambda row, i: CASE WHEN i = b.p THEN list_transform(row, lambda v: v / a.m[b.p][b.p])
        ELSE list_transform(row, lambda v, j: v - row[b.p] * a.m[b.p][j] / a.m[b.p][b.p]) END)}} END)"""


def _gram_sql(rows, x):
    """Gram matrices of the arrays x (outcome last) per kind, as a list of lists."""
    return f"""x_ AS (SELECT kind, motif_id, {x} AS x FROM {rows}),
gij_ AS (SELECT kind, i, j, sum(x[i] * x[j]) AS v FROM x_, range(1, len(x) + 1) a(i), range(1, len(x) + 1) b(j) GROUP BY ALL),
gm_ AS (SELECT kind, list(r ORDER BY i) AS g FROM (SELECT kind, i, list(v ORDER BY j) AS r FROM gij_ GROUP BY kind, i) GROUP BY kind)"""


def _r2_sql(name, places, y):
    at = "[" + ", ".join(map(str, places)) + "]"
    w = len(places)
    return f"""{name}_ AS (SELECT kind, g[{y}][{y}] AS yy, g[1][{y}] * g[1][{y}] / g[1][1] AS y2, [g[i][{y}] FOR i IN {at}] AS c, {_reduced('', w, 0)}.m AS s
  FROM (SELECT kind, g, [[g[i][j] FOR j IN list_append({at}, {y})] FOR i IN {at}] AS m FROM gm_)),
{name}v_ AS (SELECT kind, 1 - (yy - list_sum(list_transform(c, lambda v, i: CASE WHEN abs(s[i][i] - 1) < 1e-6 THEN v * s[i][{w + 1}] ELSE 0 END))) / (yy - y2) AS r2 FROM {name}_)"""


_X14 = ("list_concat([1.0::double], [(cls = c)::int::double FOR c IN [" + ", ".join(f"'{c}'" for c in CLASSES) + "]], [(subst = c)::int::double FOR c IN ["
        + ", ".join(f"'{c}'" for c in SUBSTS) + "]], [cpg::double, pct])")
_C, _S, _P, _Y = list(range(2, 9)), list(range(9, 15)), 15, 16


@query("st14_variance_explained", "snvs", SCORED + _PCT + f""",
lv_ AS (SELECT kind, subst FROM pc_ WHERE cls = 'flank' GROUP BY ALL HAVING count(*) >= {LEAST_LEVEL}),
in_rows AS (SELECT * FROM pc_ WHERE cls <> 'other' AND (kind, subst) IN (SELECT (kind, subst) FROM lv_)),
{_gram_sql("in_rows", _X14)},
{_r2_sql("cl", [1, *_C], _Y)}, {_r2_sql("co", [1, *_S, _P], _Y)}, {_r2_sql("bo", [1, *_C, *_S, _P], _Y)}
SELECT kind, coalesce(cast(round(g[1][1]) AS bigint), 0) AS n, round(clv_.r2, 6) AS motif_class, round(cov_.r2, 6) AS cpg_plus_subst, round(bov_.r2, 6) AS both_
FROM (VALUES ('G4'), ('iM')) k(kind) LEFT JOIN gm_ USING (kind) LEFT JOIN clv_ USING (kind) LEFT JOIN cov_ USING (kind) LEFT JOIN bov_ USING (kind)""")
def st14_r2(t):
    """R2 of composition, of motif class and of both, out of one Gram matrix of the joint design; null where no level is large enough."""
    df = ranked_rows(t).where("cls <> 'other'")
    x, blocks = design(df.join(large_levels(df), ["kind", "subst"], "left_semi").withColumn("cpg_", F.col("cpg").cast("double")))
    columns = ["one", *blocks["cls"], *blocks["subst"], "cpg_", "pct"]
    place = {c: i for i, c in enumerate(columns)}
    c, s = [place[n] for n in blocks["cls"]], [place[n] for n in blocks["subst"]] + [place["cpg_"]]
    out, grams = [], stats.gram(x, "kind", columns)
    for kind in ("G4", "iM"):
        if kind not in grams:
            out.append((kind, 0, None, None, None))
            continue
        m = grams[kind]
        r2 = stats.nested_r2(m, {"motif_class": c, "cpg_plus_subst": s, "both_": [*c, *s]})
        out.append((kind, int(round(m[0, 0])), *[round(r2[n], 6) for n in ("motif_class", "cpg_plus_subst", "both_")]))
    return t.spark.createDataFrame(out, "kind string, n bigint, motif_class double, cpg_plus_subst double, both_ double")


@query("st14_substitution_contrasts", "snvs", SCORED + _PCT + f""",
f_ AS (SELECT * FROM pc_ WHERE cls = 'flank'),
l_ AS (SELECT kind, subst, count(*) AS n, avg(pct) AS m FROM f_ GROUP BY ALL HAVING count(*) >= {LEAST_LEVEL}),
k_ AS (SELECT *, first_value(subst) OVER w AS ref, first_value(m) OVER w AS mr, first_value(n) OVER w AS nr, count(*) OVER (PARTITION BY kind) AS levels, sum(n) OVER (PARTITION BY kind) AS total
  FROM l_ WINDOW w AS (PARTITION BY kind ORDER BY subst)),
s_ AS (SELECT f_.kind, motif_id, f_.subst, sum(pct - m) AS s FROM f_ JOIN l_ ON f_.kind = l_.kind AND f_.subst = l_.subst GROUP BY ALL),
g_ AS (SELECT kind, count(DISTINCT motif_id) AS g FROM s_ GROUP BY kind),
v_ AS (SELECT k_.kind, k_.subst, sum(power(d, 2)) AS v FROM k_ JOIN (SELECT k.kind, k.subst, motif_id, sum(CASE WHEN s_.subst = k.subst THEN s / k.n ELSE -s / k.nr END) AS d FROM k_ k JOIN s_ ON s_.kind = k.kind AND s_.subst IN (k.subst, k.ref) GROUP BY ALL) x ON x.kind = k_.kind AND x.subst = k_.subst GROUP BY ALL)
SELECT kind, subst, ref AS reference, n, round(m - mr, 6) AS delta, round(sqrt(v * g / (g - 1.0::double) * (total - 1.0::double) / (total - levels)), 6) AS se
FROM k_ JOIN v_ USING (kind, subst) JOIN g_ USING (kind) WHERE subst <> ref
UNION ALL SELECT kind, subst, NULL, count(*), NULL, NULL FROM f_ GROUP BY kind, subst HAVING count(*) < {LEAST_LEVEL}""")
def st14_subst(t):
    """Percentile shift of each substitution against the first one, on flank rows, clustered by motif; smaller levels are listed without one."""
    df = ranked_rows(t).where("cls = 'flank'")
    x, _ = design(df.join(large_levels(df), ["kind", "subst"], "left_semi"))
    every = {(r["kind"], r["subst"]): r["n"] for r in df.groupBy("kind", "subst").agg(F.count("*").alias("n")).collect()}  # kinds x six
    counts = {k: n for k, n in every.items() if n >= LEAST_LEVEL}
    out = [(*k, None, n, None, None) for k, n in every.items() if n < LEAST_LEVEL]
    for kind in sorted({k for k, _ in counts}):
        present = [s for s in SUBSTS if (kind, s) in counts]
        names = ["one", *[f"s_{SUBSTS.index(s)}" for s in present[1:]]]
        beta, cov, *_ = stats.clustered_linear(x.where(F.col("kind") == kind), "kind", "pct", names, "motif_id")[kind]
        out += [(kind, s, present[0], counts[kind, s], round(float(beta[i + 1]), 6), round(float(cov[i + 1, i + 1]) ** 0.5, 6)) for i, s in enumerate(present[1:])]
    return t.spark.createDataFrame(out, "kind string, subst string, reference string, n bigint, delta double, se double")


def adjusted(t, df, y, how, least=0):
    """Models of y on class, substitution, CpG, GC and chromosome per kind: (kind, reference, names, beta, cov) for the classes that have rows.

    The reference class is the flank where it has more than LEAST_REFERENCE rows, else the control. Kinds whose y adds up
    to less than `least` are left out.
    """
    df = cut_lineage(df.select("chrom", "kind", "cls", "subst", F.col("cpg").cast("double").alias("cpg_"), "gc", "motif_id", y))  # every pass reads these rows
    found, chroms = {}, set()
    for r in df.groupBy("kind", "cls", "subst", "chrom").agg(F.count("*").alias("n"), F.sum(y).alias("y")).collect():  # kinds x classes x substitutions x chromosomes
        k = found.setdefault(r["kind"], [{}, set(), 0])
        k[0][r["cls"]] = k[0].get(r["cls"], 0) + r["n"]
        k[1].add(r["subst"])
        k[2] += r["y"] or 0
        chroms.add(r["chrom"])
    found = {kind: k for kind, k in found.items() if k[2] >= least}
    chroms = sorted(chroms)
    x, _ = design(df, chroms)
    for kind, (classes, substs, _) in sorted(found.items()):
        present = [c for c in CLASSES if c in classes]
        base = "flank" if classes.get("flank", 0) > LEAST_REFERENCE else "control" if "control" in classes else present[-1]
        names = ["one", *[f"c_{c}" for c in present if c != base], *[f"s_{SUBSTS.index(s)}" for s in SUBSTS if s in substs][1:], "cpg_", "gc", *[f"h_{c}" for c in chroms[1:]]]
        fit = how(x.where(F.col("kind") == kind), "kind", y, names, "motif_id")
        yield kind, base, names, fit.get(kind)


_XEQ = ("list_concat([1.0::double], [(cls = c)::int::double FOR c IN [" + ", ".join(f"'{c}'" for c in CLASSES) + "]], [(subst = c)::int::double FOR c IN ["
        + ", ".join(f"'{c}'" for c in SUBSTS) + "]], [(chrom = c)::int::double FOR c IN ['chr1', 'chr2', 'chr3', 'chr4', 'chr5']], [cpg::double, gc, pct])")
_WEQ = 1 + len(CLASSES) + len(SUBSTS) + 5 + 2


@query("st14_equivalence_bound", "snvs", SCORED + _PCT + f""",
in_rows AS (SELECT * FROM pc_ WHERE cls <> 'other' AND kind IN (SELECT kind FROM pc_ WHERE cls = 'flank' GROUP BY kind HAVING count(*) > {LEAST_REFERENCE})),
{_gram_sql("in_rows", _XEQ)},
so_ AS (SELECT kind, g, {_reduced('', _WEQ, 2)} AS s FROM (SELECT kind, g, [[CASE WHEN j <= {_WEQ} THEN g[i][j] WHEN j = {_WEQ} + 1 THEN g[i][{_WEQ} + 1] WHEN i = 2 THEN 1 WHEN i = 7 THEN -1 ELSE 0 END
     FOR j IN range(1, {_WEQ} + 3)] FOR i IN range(1, {_WEQ} + 1)] AS m FROM gm_)),
bz_ AS (SELECT kind, g[1][1] AS n, s.r AS rank, [CASE WHEN abs(s.m[i][i] - 1) < 1e-6 THEN s.m[i][{_WEQ} + 1] ELSE 0 END FOR i IN range(1, {_WEQ} + 1)] AS b,
     [CASE WHEN abs(s.m[i][i] - 1) < 1e-6 THEN s.m[i][{_WEQ} + 2] ELSE 0 END FOR i IN range(1, {_WEQ} + 1)] AS z FROM so_),
t_ AS (SELECT kind, motif_id, sum((x[{_WEQ} + 1] - list_dot_product(b, x[1:{_WEQ}])) * list_dot_product(z, x[1:{_WEQ}])) AS t FROM x_ JOIN bz_ USING (kind) GROUP BY ALL),
v_ AS (SELECT kind, b[2] - b[7] AS delta, sqrt(sum(t * t) * count(*) / (count(*) - 1.0::double) * (n - 1) / (n - rank)) AS se, count(*) AS g FROM t_ JOIN bz_ USING (kind) GROUP BY kind, b, n, rank)
SELECT kind, 'flank' AS reference, g AS n_clusters, round(delta, 6) AS delta, round(delta - 1.959963984540054 * se, 6) AS ci_low, round(delta + 1.959963984540054 * se, 6) AS ci_high,
  round(100 * greatest(abs(delta - 1.959963984540054 * se), abs(delta + 1.959963984540054 * se)), 3) AS largest_effect_points FROM v_""")
def st14_equivalence(t):
    """The largest percentile shift that losing the motif can have, by the interval of the adjusted model clustered by motif."""
    out = []
    for kind, base, names, fit in adjusted(t, ranked_rows(t).where("cls <> 'other'"), "pct", stats.clustered_linear):
        if fit is None or base != "flank" or "c_motif_lost" not in names:
            continue
        i, (beta, cov, groups, *_) = names.index("c_motif_lost"), fit
        half = Z95 * float(cov[i, i]) ** 0.5
        low, high = float(beta[i]) - half, float(beta[i]) + half
        out.append((kind, base, groups, round(float(beta[i]), 6), round(low, 6), round(high, 6), round(100 * max(abs(low), abs(high)), 3)))
    return t.spark.createDataFrame(out, "kind string, reference string, n_clusters bigint, delta double, ci_low double, ci_high double, largest_effect_points double")


Z95 = 1.959963984540054  # fixed value: 97.5 % quantile of the normal distribution


@query("st13_adjusted_logit", "snvs")
def st13(t):
    """Odds ratios of top-1 % membership per class, adjusted and clustered by motif; kinds below fifty events are left out."""
    df = with_top(scored(t)).where("cls <> 'other'")
    out = []
    for kind, base, names, fit in adjusted(t, df, "top1", stats.clustered_logit, LEAST_EVENTS):  # two kinds
        beta, cov, groups, n, settled = fit
        for i, name in enumerate(names):
            if name.startswith("c_"):
                b, half = float(beta[i]), Z95 * float(cov[i, i]) ** 0.5
                out.append((kind, base, name[2:], n, groups, settled, b, math.exp(b), math.exp(b - half), math.exp(b + half)))
    return t.spark.createDataFrame(out, "kind string, reference string, term string, n bigint, n_clusters bigint, converged boolean, log_odds double, odds_ratio double, ci_low double, ci_high double")


@query("st13_class_logit", "snvs", SCORED + TOP + f""",
k_ AS (SELECT kind FROM tp_ WHERE cls IN ('motif_lost', 'flank') GROUP BY kind HAVING sum(top1) >= {LEAST_EVENTS}),
r_ AS (SELECT kind, motif_id, cls = 'motif_lost' AS a, top1 FROM tp_ WHERE cls IN ('motif_lost', 'flank') AND kind IN (SELECT kind FROM k_)),
p_ AS (SELECT kind, avg(top1) FILTER (a) AS p1, avg(top1) FILTER (NOT a) AS p0, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n0, count(DISTINCT motif_id) AS g FROM r_ GROUP BY kind),
s_ AS (SELECT r_.kind, motif_id, sum(CASE WHEN a THEN (top1 - p1) / (n1 * p1 * (1 - p1)) ELSE -(top1 - p0) / (n0 * p0 * (1 - p0)) END) AS s FROM r_ JOIN p_ USING (kind) GROUP BY ALL),
o_ AS (SELECT kind, n0 + n1 AS n, g AS n_clusters, round(any_value(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0))), 6) AS log_odds,
  round(sqrt(sum(s * s) * g / (g - 1.0::double) * (n0 + n1 - 1.0::double) / (n0 + n1 - 2)), 6) AS se FROM s_ JOIN p_ USING (kind) GROUP BY kind, n0, n1, g)
SELECT k.kind, n, n_clusters, log_odds, se FROM (VALUES ('G4'), ('iM')) k(kind) LEFT JOIN o_ ON o_.kind = k.kind""")
def st13_class(t):
    """The same fit with the class alone, whose coefficient and clustered error have a closed form."""
    df = with_top(scored(t)).where("cls IN ('motif_lost', 'flank')").withColumns({"one": F.lit(1.0), "lost": (F.col("cls") == "motif_lost").cast("double")})
    enough = df.groupBy("kind").agg(F.sum("top1").alias("e")).where(F.col("e") >= LEAST_EVENTS).select("kind")
    fits = stats.clustered_logit(df.join(F.broadcast(enough), "kind", "left_semi").persist(), "kind", "top1", ["one", "lost"], "motif_id")  # two kinds
    out = [(kind, n, g, round(float(b[1]), 6), round(float(cov[1, 1]) ** 0.5, 6)) for kind, (b, cov, g, n, _) in sorted(fits.items())]
    out += [(kind, None, None, None, None) for kind in ("G4", "iM") if kind not in fits]  # too few events
    return t.spark.createDataFrame(out, "kind string, n bigint, n_clusters bigint, log_odds double, se double")


_CAL = f"""x_ AS (SELECT kind, tm, sequence, k + na + li_nh4 AS mono, mg, coalesce(ph, 7) AS ph, crowder_pct AS cr FROM records WHERE tm IS NOT NULL AND evidence_tier = 'experimental'),
y_ AS (SELECT kind, -45::double * (1 - 310.15::double / (tm + 273.15::double)) AS dg, {d.hunter_mean('sequence')} * 4 + mono / 100 AS raw FROM x_)"""


@query("st15_linear_calibration", "records", _CAL + """
SELECT kind, count(*) AS n, round(regr_slope(dg, raw), 5) AS scale, round(regr_intercept(dg, raw), 5) AS offset_, round(regr_r2(dg, raw), 6) AS r2, round(sqrt(regr_syy(dg, raw) * (1 - regr_r2(dg, raw)) / count(*)), 5) AS resid_sd,
 round(max(raw) - min(raw), 6) AS raw_span FROM y_ GROUP BY kind""")
def st15(t):
    x = t.records.where("tm IS NOT NULL AND evidence_tier = 'experimental'")
    y = x.select("kind", thermo.dg_from_tm(F.col("tm"), F.lit(37.0)).alias("dg"), (seq.hunter_mean("sequence") * 4 + condition.monovalent() / 100).alias("raw"))
    return linear_fit(y, "dg", "raw", ["kind"])


def linear_fit(df, y, x, keys):
    """Least squares y ~ scale*x + offset, R2, residual spread and the span of x."""
    r2, total = F.regr_r2(y, x), F.regr_syy(y, x)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.regr_slope(y, x), 5).alias("scale"), F.round(F.regr_intercept(y, x), 5).alias("offset_"),
        r6(r2).alias("r2"), F.round(F.sqrt(total * (1 - r2) / F.count("*")), 5).alias("resid_sd"), r6(F.max(x) - F.min(x)).alias("raw_span"))


_BASE = f"""x_ AS (SELECT 'G4' AS head, seq_id, CASE WHEN folded = 1 THEN 1 ELSE 0 END AS y, {d.hunter_mean('sequence')} AS g4h, ({d.count('sequence', 'G')} + {d.count('sequence', 'C')}) / length(sequence) AS gc,
  CASE WHEN {d.mcount('sequence', 'G4')} > 0 THEN 1.0::double ELSE 0.0::double END AS motif FROM records WHERE folded IS NOT NULL),
l_ AS (SELECT 'g4hunter' AS head, y, g4h AS s FROM x_ UNION ALL SELECT 'gc', y, gc FROM x_ UNION ALL SELECT 'motif', y, motif FROM x_),
q_ AS (SELECT head, y, s, (s - min(s) OVER (PARTITION BY head)) / (max(s) OVER (PARTITION BY head) - min(s) OVER (PARTITION BY head)) AS p FROM l_),
rr_ AS (SELECT head, y, rank() OVER (PARTITION BY head ORDER BY s) + (count(*) OVER (PARTITION BY head, s) - 1) / 2 AS rk FROM q_),
au_ AS (SELECT head, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auroc FROM rr_ GROUP BY head)"""


def baseline_rows(t):
    """Rule-based scores of the same rows, one row per (tool, sequence)."""
    from ..functions import motif
    s = F.col("sequence")
    scores = F.array(*[F.struct(F.lit(n).alias("head"), c.cast("double").alias("s")) for n, c in (
        ("g4hunter", seq.hunter_mean(s)), ("gc", seq.gc(s)), ("motif", motif.has_motif(s, "G4").cast("int")))])
    return t.records.where("folded IS NOT NULL").select((F.col("folded") == 1).cast("int").alias("y"), F.inline(scores))


def rescaled(df, s, keys):
    edges = df.groupBy(*keys).agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(F.broadcast(edges), keys).withColumn("p", F.when(span != 0, (F.col(s) - F.col("_lo")) / span).otherwise(0.5)).drop("_lo", "_hi")  # a row per tool


@query("st17_rule_baselines", "records", _BASE + "," + _curve_sql("q_", "y", "p") + """,
ec_ AS (SELECT head, sum(abs(acc - conf) * n) / sum(n) AS ece FROM cv_ GROUP BY head)
SELECT au_.head, round(auroc, 6) AS auroc, round(ece, 5) AS ece FROM au_ JOIN ec_ ON au_.head = ec_.head""")
def st17(t):
    rows = cut_lineage(baseline_rows(t).groupBy("head", "s", "y").agg(F.count("*").alias("rows")))  # distinct scores; the table is read once
    auc = stats.ranking_metrics(rows, "y", "s", ["head"], "rows").select("head", r6("auroc").alias("auroc"))
    p = rescaled(rows, "s", ["head"])
    ece = stats.calibration_error(stats.reliability(p, "y", "p", ["head"], weight="rows"), ["head"]).select("head", F.round("ece", 5).alias("ece"))
    return auc.join(ece, "head")


_DRAWS = "dr_ AS (SELECT head, grp, rep, CASE WHEN rep < 0 THEN 1.0 " + " ".join(
    f"WHEN u < {c!r} THEN {i}.0" for i, c in enumerate(stats.POISSON_ONE)) + f""" ELSE {len(stats.POISSON_ONE)}.0 END::double AS w
  FROM (SELECT head, grp, rep, cast('0x' || substr(md5(concat_ws('|', grp, rep, 0)), 1, 8) AS bigint) / 4294967296.0::double AS u FROM (SELECT DISTINCT head, grp FROM preds), range(-1, 200) r(rep)))"""
_INTERVALS = """SELECT task, head AS tool, metric, max(n) FILTER (rep < 0) AS n, round(max(v) FILTER (rep < 0), 6) AS value,
  round(quantile_cont(v, 0.025) FILTER (rep >= 0), 6) AS ci_low, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 6) AS ci_high, any_value(note) AS note FROM long_ GROUP BY ALL"""
# fixed values: how a metric is to be read
NOTES = {"auroc": "ties count half", "auprc": "average precision", "brier": "mean squared error of the probability", "ece": "ten bins of equal width",
         "accuracy": "threshold 0.5", "mae": "unit of the label", "r2": "against the mean of the rows of the tool", "spearman": "ranks of a grid"}
_NOTE = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in NOTES.items()) + " END"


def noted(df, task):
    note = F.element_at(F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair]), F.col("metric"))
    return df.select(F.lit(task).alias("task"), F.col("head").alias("tool"), "metric", "n", *[r6(c).alias(c) for c in ("value", "ci_low", "ci_high")], note.alias("note"))


@query("st18_benchmark_table", "preds", _DRAWS + f""",
x_ AS (SELECT head, rep, w, y, p, cast(least(floor(p * 100), 99) AS int) AS b FROM preds JOIN dr_ USING (head, grp) WHERE w > 0),
m_ AS (SELECT head, rep, b, sum(w) AS n, sum(w * y) AS pos, sum(w * p) AS s1, sum(w * p * p) AS s2, sum(w * p * y) AS sy, sum(w * ((p >= 0.5)::int = y)::int) AS hit FROM x_ GROUP BY ALL),
u_ AS (SELECT *, sum(n) OVER o AS above, sum(pos) OVER o AS hits FROM m_ WINDOW o AS (PARTITION BY head, rep ORDER BY b DESC)),
t_ AS (SELECT head, rep, sum(abs(p - s)) / sum(n) AS ece FROM (SELECT head, rep, least(b // 10, 9) AS t, sum(n) AS n, sum(pos) AS p, sum(s1) AS s FROM m_ GROUP BY ALL) GROUP BY ALL),
v_ AS (SELECT head, rep, sum((n - pos) * (hits - pos / 2)) / (sum(pos) * (sum(n) - sum(pos))) AS auroc, sum(pos * hits / above) / sum(pos) AS auprc,
   (sum(s2) - 2 * sum(sy) + sum(pos)) / sum(n) AS brier, sum(hit) / sum(n) AS accuracy, cast(sum(n) AS bigint) AS n FROM u_ GROUP BY ALL),
long_ AS (SELECT 'class' AS task, *, {_NOTE} AS note FROM (UNPIVOT (SELECT * FROM v_ JOIN t_ USING (head, rep)) ON auroc, auprc, brier, ece, accuracy INTO NAME metric VALUE v)) {_INTERVALS}""")
def st18(t):
    """Tools by classification metrics, with intervals from resampled groups and a note each."""
    return noted(stats.benchmark_table(t.preds, ["head"], "grp", "y", "p"), "class")


@query("st18_value_table", "preds", _DRAWS + f""",
e_ AS (SELECT head, min(y_real) AS ly, max(y_real) AS hy, min(y_hat) AS lp, max(y_hat) AS hp FROM preds GROUP BY head),
x_ AS (SELECT head, rep, w, y_real AS y, y_hat AS p, cast(least(floor((y_hat - lp) * 32 / (hp - lp)), 31) AS int) AS i, cast(least(floor((y_real - ly) * 32 / (hy - ly)), 31) AS int) AS j
  FROM preds JOIN e_ USING (head) JOIN dr_ USING (head, grp) WHERE w > 0),
m_ AS (SELECT head, rep, i, j, sum(w) AS n, sum(w * abs(p - y)) AS ae, sum(w * (p - y) * (p - y)) AS se, sum(w * y) AS sy, sum(w * y * y) AS syy FROM x_ GROUP BY ALL),
i_ AS (SELECT head, rep, i, coalesce(sum(m) OVER (PARTITION BY head, rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + m / 2 AS ri FROM (SELECT head, rep, i, sum(n) AS m FROM m_ GROUP BY ALL)),
j_ AS (SELECT head, rep, j, coalesce(sum(m) OVER (PARTITION BY head, rep ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + m / 2 AS rj FROM (SELECT head, rep, j, sum(n) AS m FROM m_ GROUP BY ALL)),
v_ AS (SELECT head, rep, cast(sum(n) AS bigint) AS n, sum(ae) / sum(n) AS mae, 1 - sum(se) / (sum(syy) - sum(sy) * sum(sy) / sum(n)) AS r2,
   (sum(n * ri * rj) - sum(n * ri) * sum(n * rj) / sum(n)) / sqrt((sum(n * ri * ri) - sum(n * ri) * sum(n * ri) / sum(n)) * (sum(n * rj * rj) - sum(n * rj) * sum(n * rj) / sum(n))) AS spearman
  FROM m_ JOIN i_ USING (head, rep, i) JOIN j_ USING (head, rep, j) GROUP BY ALL),
long_ AS (SELECT 'value' AS task, *, {_NOTE} AS note FROM (UNPIVOT v_ ON mae, r2, spearman INTO NAME metric VALUE v)) {_INTERVALS}""")
def st18_values(t):
    """Tools by regression metrics, with intervals from resampled groups and a note each."""
    return noted(stats.benchmark_values(t.preds, ["head"], "grp", "y_real", "y_hat"), "value")


_PANEL = "pn_ AS (SELECT grp AS panel, CASE WHEN ln = 7 THEN NULL ELSE y_real END AS obs, CASE WHEN ok % 10 = 0 THEN NULL ELSE y_hat END AS pred, ok % 10 = 0 AS refused, (ok + ln) % 3 AS topo, ok % 3 AS pick FROM preds)"


@query("st19_panel_metrics", "preds", _PANEL + """
SELECT panel, count(*) AS n_rows, cast(count_if(refused) AS bigint) AS n_refused, cast(count_if(obs IS NOT NULL AND pred IS NOT NULL) AS bigint) AS n_tm,
 round(CASE WHEN count_if(obs IS NOT NULL AND pred IS NOT NULL) >= 5 THEN avg(CASE WHEN obs IS NOT NULL AND pred IS NOT NULL THEN abs(obs - pred) END) END, 6) AS mae,
 round(CASE WHEN count_if(obs IS NOT NULL AND pred IS NOT NULL) >= 5 THEN avg(CASE WHEN obs IS NOT NULL THEN pred - obs END) END, 6) AS bias,
 round(CASE WHEN count_if(NOT refused) >= 10 THEN avg(CASE WHEN NOT refused THEN (topo = pick)::int END) END, 6) AS topology_agreement FROM pn_ GROUP BY panel""")
def st19(t):
    refused = F.col("ok") % 10 == 0
    df = t.preds.select(F.col("grp").alias("panel"), F.when(F.col("ln") != 7, F.col("y_real")).alias("obs"), F.when(~refused, F.col("y_hat")).alias("pred"),
                        refused.alias("refused"), ((F.col("ok") + F.col("ln")) % 3).alias("topo"), (F.col("ok") % 3).alias("pick"))
    gap = F.col("pred") - F.col("obs")
    agree = F.when(~F.col("refused"), (F.col("topo") == F.col("pick")).cast("int"))
    enough = F.count(gap) >= 5
    return df.groupBy("panel").agg(
        F.count("*").alias("n_rows"), F.count_if("refused").alias("n_refused"), F.count(gap).alias("n_tm"),
        r6(F.when(enough, F.avg(F.abs(gap)))).alias("mae"), r6(F.when(enough, F.avg(gap))).alias("bias"),
        r6(F.when(F.count(agree) >= 10, F.avg(agree))).alias("topology_agreement"))


@query("st20_expectation_separation", "preds", """
SELECT head, round(avg(CASE WHEN y = 1 THEN p END), 6) AS mean_positive, round(avg(CASE WHEN y = 0 THEN p END), 6) AS mean_negative, round(avg(CASE WHEN y = 1 THEN p END) - avg(CASE WHEN y = 0 THEN p END), 6) AS separation FROM preds GROUP BY head""")
def st20(t):
    m = lambda v: F.avg(F.when(F.col("y") == v, F.col("p")))
    return t.preds.groupBy("head").agg(r6(m(1)).alias("mean_positive"), r6(m(0)).alias("mean_negative"), r6(m(1) - m(0)).alias("separation"))


_WITHIN = """w_ AS (SELECT head, ok, y_real, round(y_hat, 6) AS y_hat, count(*) OVER (PARTITION BY head, ok) AS n FROM preds),
d_ AS (SELECT head, ok, count(DISTINCT y_real) AS nd, count(DISTINCT y_hat) AS np FROM w_ WHERE n >= 4 GROUP BY ALL HAVING count(DISTINCT y_real) >= 3),
rk_ AS (SELECT w_.head, w_.ok, np, rank() OVER (PARTITION BY w_.head, w_.ok ORDER BY y_real) + (count(*) OVER (PARTITION BY w_.head, w_.ok, y_real) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY w_.head, w_.ok ORDER BY y_hat) + (count(*) OVER (PARTITION BY w_.head, w_.ok, y_hat) - 1) / 2 AS ry,
  y_real - avg(y_real) OVER (PARTITION BY w_.head, w_.ok) AS dy, y_hat - avg(y_hat) OVER (PARTITION BY w_.head, w_.ok) AS dp FROM w_ JOIN d_ ON w_.head = d_.head AND w_.ok = d_.ok),
rs_ AS (SELECT head, ok, CASE WHEN any_value(np) > 1 THEN corr(rx, ry) ELSE 0 END AS rho FROM rk_ GROUP BY head, ok)
SELECT a.head, a.n_sequences, a.median_rho, b.r2_centred FROM (SELECT head, count(*) AS n_sequences, round(quantile_cont(rho, 0.5), 5) AS median_rho FROM rs_ GROUP BY head) a
JOIN (SELECT head, round(1 - sum(power(dy - dp, 2)) / sum(dy * dy), 6) AS r2_centred FROM rk_ GROUP BY head) b ON a.head = b.head"""


@query("rnk5_within_sequence_response", "preds", _WITHIN)
def rnk5(t):
    """Does a prediction move with the buffer within one sequence: median rank correlation and R2 of centred values."""
    keys = ["head", "ok"]
    df = t.preds.select(*keys, "y_real", r6("y_hat").alias("y_hat")).where("head IS NOT NULL AND ok IS NOT NULL")
    own = Window.partitionBy(*keys)
    # one exchange: what follows reads the rows of a sequence where they lie, and short sequences leave before they are ordered
    df = df.withColumn("n", F.count("*").over(own)).where("n >= 4")
    df = df.withColumns({"dy": F.col("y_real") - F.avg("y_real").over(own), "dp": F.col("y_hat") - F.avg("y_hat").over(own)})
    for value, rank, distinct in (("y_real", "rx", "nd"), ("y_hat", "ry", "np")):
        order = own.orderBy(F.asc_nulls_last(value))
        equal = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
        given = F.col(value).isNotNull()
        df = df.withColumns({rank: F.when(given, F.rank().over(order) + (equal - 1) / 2), distinct: F.when(given, F.dense_rank().over(order))})
    per = df.groupBy(*keys).agg(F.coalesce(F.max("nd"), F.lit(0)).alias("nd"), F.coalesce(F.max("np"), F.lit(0)).alias("np"), F.corr("rx", "ry").alias("c"),
                                F.sum(F.pow(F.col("dy") - F.col("dp"), 2)).alias("off"), F.sum(F.col("dy") * F.col("dy")).alias("all")).where("nd >= 3")
    per = cut_lineage(per.select("head", F.when(F.col("np") > 1, F.col("c")).otherwise(0.0).alias("rho"), "off", "all"))
    med = ordered.exact_quantiles(per, "rho", [0.5], ["head"]).select("head", F.col("total").alias("n_sequences"), F.round("q0", 5).alias("median_rho"))
    r2 = per.groupBy("head").agg(r6(1 - F.sum("off") / F.sum("all")).alias("r2_centred"))
    return med.join(r2, "head")
