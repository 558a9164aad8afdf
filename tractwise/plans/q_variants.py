"""Variant joins, two-axis ranking and class tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import variant
from ..operators import ordered, ranking
from .q_sequences import r6
from .registry import query

KEY = variant.KEY
_K = "chrom, pos, ref, alt"


def structural(t):
    """One structural row per variant: the first by motif."""
    return t.snvs.groupBy(*KEY).agg(F.min(F.struct("motif_id", "kind", "state", "delta")).alias("v")).select(*KEY, "v.*")


def records(t):
    """Scores per variant and scorer, as a source would hold them; some variants are missing altogether."""
    s = t.snvs.where("score IS NOT NULL AND gc >= 0.36")
    return s.select(*KEY, F.concat(F.lit("scorer"), (F.round(F.col("gc") * 100).cast("int") % 3).cast("string")).alias("scorer"), "score")


_STRUCT = f"""st_ AS (SELECT * FROM (SELECT {_K}, motif_id, kind, state, delta, row_number() OVER (PARTITION BY {_K} ORDER BY motif_id, kind, state, delta NULLS FIRST) AS r FROM snvs) WHERE r = 1)"""
_REC = f"""rc0_ AS (SELECT {_K}, concat('scorer', cast(round(gc * 100) AS int) % 3) AS scorer, score FROM snvs WHERE score IS NOT NULL AND gc >= 0.36),
rc_ AS (SELECT {_K}, scorer, max(abs(score)) AS score FROM rc0_ GROUP BY ALL),
hl_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY CASE WHEN scorer = 'scorer1' THEN 0 ELSE 1 END, score DESC, scorer DESC) AS r FROM rc_) WHERE r = 1)"""


def track_max(rows, keys):
    """Largest |score| over the tracks of a (variant, scorer); NaN is no score."""
    return rows.where(~F.isnan("score")).groupBy(*keys, "scorer").agg(F.max(F.abs("score")).alias("score"))


def headline(rows, keys, preferred):
    """The preferred scorer where present, else the scorer of the largest |score|; the name travels along."""
    first = F.struct((F.col("scorer") == preferred).cast("int"), F.abs("score"), "scorer")
    return rows.groupBy(*keys).agg(F.max_by(F.struct("scorer", "score"), first).alias("h")).select(*keys, "h.scorer", "h.score")


@query("agg8_max_over_tracks", "snvs", _REC + f"SELECT {_K}, scorer, score FROM rc_")
def agg8(t):
    return track_max(records(t), KEY)


@query("jn5_headline_scorer", "snvs", _REC + f"SELECT {_K}, scorer, score FROM hl_")
def jn5(t):
    return headline(track_max(records(t), KEY), KEY, "scorer1")


@query("jn1_variant_join", "snvs", _STRUCT + "," + _REC + f"""
SELECT st_.chrom, st_.pos, st_.ref, st_.alt, st_.state, delta, scorer, score, CASE WHEN st_.chrom = 'chr5' THEN 'source_failed' WHEN score IS NULL THEN 'no_record' ELSE 'found' END AS regulatory_state
FROM st_ LEFT JOIN hl_ ON st_.chrom = hl_.chrom AND st_.pos = hl_.pos AND st_.ref = hl_.ref AND st_.alt = hl_.alt AND st_.chrom <> 'chr5'""")
def jn1(t):
    """Left join on the full key; a source that failed for a chromosome is not the same as a source without the row."""
    failed = t.spark.createDataFrame([("chr5",)], "chrom string").withColumn("failed", F.lit(True))
    reg = headline(track_max(records(t), KEY), KEY, "scorer1").join(F.broadcast(failed), "chrom", "left_anti")
    j = structural(t).join(reg, KEY, "left").join(F.broadcast(failed), "chrom", "left")  # failed regions, a handful
    state = F.when(F.col("failed"), "source_failed").when(F.col("score").isNull(), "no_record").otherwise("found")
    return j.select(*KEY, "state", "delta", "scorer", "score", state.alias("regulatory_state"))


_SCAN = _STRUCT + "," + _REC + f""",
v_ AS (SELECT st_.chrom, st_.pos, st_.ref, st_.alt, st_.kind, st_.state, delta, abs(delta) AS mag, hl_.score AS reg FROM st_ LEFT JOIN hl_
  ON st_.chrom = hl_.chrom AND st_.pos = hl_.pos AND st_.ref = hl_.ref AND st_.alt = hl_.alt),
rk_ AS (SELECT *, CASE WHEN mag IS NOT NULL THEN round((rank() OVER (PARTITION BY mag IS NULL ORDER BY mag) - 1 + count(*) OVER (PARTITION BY mag) / 2) / count(mag) OVER (), 4) END AS sr0,
   CASE WHEN reg IS NOT NULL THEN round((rank() OVER (PARTITION BY reg IS NULL ORDER BY reg) - 1 + count(*) OVER (PARTITION BY reg) / 2) / count(reg) OVER (), 4) END AS rr FROM v_),
qd_ AS (SELECT *, CASE WHEN state = 'motif_lost' THEN 1 ELSE sr0 END AS sr FROM rk_),
qq_ AS (SELECT *, CASE WHEN (mag IS NULL AND state <> 'motif_lost') OR reg IS NULL THEN 'unclassified' WHEN sr >= 0.75 AND rr >= 0.75 THEN 'both' WHEN sr >= 0.75 THEN 'structural_only'
  WHEN rr >= 0.75 THEN 'regulatory_only' ELSE 'neither' END AS quadrant FROM qd_)"""


def scan(t):
    reg = headline(track_max(records(t), KEY), KEY, "scorer1").select(*KEY, F.col("score").alias("reg"))
    v = structural(t).join(reg, KEY, "left").withColumnRenamed("state", "motif_state").withColumn("magnitude", F.abs("delta"))
    return ranking.quadrants(v)


@query("rnk1_midranks", "snvs", _SCAN + f"SELECT {_K}, sr0 AS structural_rank, rr AS regulatory_rank FROM rk_ WHERE state <> 'motif_lost'")
def rnk1(t):
    return scan(t).where("motif_state <> 'motif_lost'").select(*KEY, "structural_rank", "regulatory_rank")


@query("rnk2_percentile_in_chromosome", "snvs", f"""
SELECT {_K}, motif_id, round((rank() OVER (PARTITION BY chrom ORDER BY abs(score)) + (count(*) OVER (PARTITION BY chrom, abs(score)) - 1) / 2) / count(*) OVER (PARTITION BY chrom), 6) AS pct
FROM snvs WHERE score IS NOT NULL""")
def rnk2(t):
    df = t.snvs.where("score IS NOT NULL").withColumn("a", F.abs("score"))
    return ranking.percentile_rank(df, "a", "pct", ["chrom"]).select(*KEY, "motif_id", r6("pct").alias("pct"))


@query("rnk3_quadrants", "snvs", _SCAN + f"""
SELECT {_K}, quadrant, CASE WHEN quadrant = 'unclassified' THEN CASE WHEN mag IS NULL THEN 'no_structural_delta' ELSE 'no_regulatory_record' END WHEN state = 'motif_lost' THEN 'motif_lost' END AS quadrant_reason,
 CASE WHEN quadrant <> 'unclassified' THEN round(least(sr, rr), 4) END AS combined_rank FROM qq_""")
def rnk3(t):
    return scan(t).select(*KEY, "quadrant", "quadrant_reason", "combined_rank")


@query("rnk3_quadrant_counts", "snvs", _SCAN + "SELECT kind, quadrant, count(*) AS n FROM qq_ GROUP BY ALL")
def rnk3_counts(t):
    return scan(t).groupBy("kind", "quadrant").agg(F.count("*").alias("n"))


@query("rnk4_categorical_shortlist", "snvs", _SCAN + f"""
SELECT {_K}, state AS category, delta IS NOT NULL AS has_delta, reg AS regulatory_score, rr AS regulatory_rank FROM qq_ WHERE state IN ('motif_lost', 'motif_gained', 'motif_count_changed')
ORDER BY rr DESC NULLS LAST, {_K}""")
def rnk4(t):
    listed = scan(t).where(F.col("motif_state").isin("motif_lost", "motif_gained", "motif_count_changed"))
    return listed.select(*KEY, F.col("motif_state").alias("category"), F.col("delta").isNotNull().alias("has_delta"),
                         F.col("reg").alias("regulatory_score"), "regulatory_rank").orderBy(F.desc_nulls_last("regulatory_rank"), *KEY)


@query("srt1_ranked_output", "snvs", _SCAN + f"""SELECT {_K}, combined_rank FROM (SELECT {_K}, CASE WHEN quadrant <> 'unclassified' THEN round(least(sr, rr), 4) END AS combined_rank FROM qq_)
ORDER BY combined_rank DESC NULLS LAST, {_K}""")
def srt1(t):
    return scan(t).select(*KEY, "combined_rank").orderBy(F.desc_nulls_last("combined_rank"), *KEY)


# ------------------------------------------------ class tables over scored SNVs
def scored(t):
    """Motif SNVs with their class, flank and control SNVs under their set's name, motif covariates attached."""
    m = t.snvs.select("motif_id", "kind", "gc").groupBy("motif_id").agg(F.max("kind").alias("kind"), F.max("gc").alias("gc"))
    rows = t.snvs.where("score IS NOT NULL").withColumn("abs_avi", F.abs("score")).drop("gc", "kind")
    motif_rows = rows.where("set_ = 'motif'").groupBy(*KEY).agg(
        F.min(F.struct("motif_id", "state", "delta", "abs_avi", "cpg")).alias("v")).select(*KEY, "v.*")
    inside = motif_rows.join(m, "motif_id", "left").withColumn(
        "cls", variant.effect_class(F.col("state"), F.col("delta"), F.col("kind")))
    sides = rows.where("set_ IN ('flank', 'control')").join(m, "motif_id", "left").withColumn("cls", F.col("set_"))
    cols = [*KEY, "motif_id", "kind", "cls", "abs_avi", "gc", "delta", "cpg"]
    both = inside.select(*cols).unionByName(sides.withColumn("delta", F.lit(None).cast("double")).select(*cols))
    return both.withColumn("subst", variant.subst_type(F.col("ref"), F.col("alt")))


SCORED = f"""m_ AS (SELECT motif_id, max(kind) AS kind, max(gc) AS gc FROM snvs GROUP BY motif_id),
mr_ AS (SELECT * FROM (SELECT {_K}, motif_id, state, delta, abs(score) AS abs_avi, cpg, row_number() OVER (PARTITION BY {_K} ORDER BY motif_id, state, delta NULLS FIRST, abs(score), cpg) AS r
   FROM snvs WHERE set_ = 'motif' AND score IS NOT NULL) WHERE r = 1),
in_ AS (SELECT {_K}, mr_.motif_id, m_.kind, CASE WHEN state = 'motif_lost' THEN 'motif_lost' WHEN delta <= -hi THEN 'destabilising' WHEN delta <= -lo THEN 'moderate' WHEN abs(delta) < lo THEN 'neutral'
   WHEN delta >= lo THEN 'stabilising' ELSE 'other' END AS cls, abs_avi, m_.gc, delta, cpg
  FROM mr_ LEFT JOIN (SELECT *, CASE WHEN kind = 'G4' THEN 2.0 ELSE 0.1 END AS lo, CASE WHEN kind = 'G4' THEN 5.0 ELSE 0.3 END AS hi FROM m_) m_ ON mr_.motif_id = m_.motif_id),
d0_ AS (SELECT * FROM in_ UNION ALL SELECT {_K}, s.motif_id, m_.kind, set_, abs(score), m_.gc, NULL, cpg FROM snvs s LEFT JOIN m_ ON s.motif_id = m_.motif_id WHERE set_ <> 'motif' AND score IS NOT NULL),
scored AS (SELECT *, CASE WHEN ref IN ('G', 'A') THEN concat(translate(ref, 'ACGT', 'TGCA'), '>', translate(alt, 'ACGT', 'TGCA')) ELSE concat(ref, '>', alt) END AS subst FROM d0_)"""


@query("jn2_first_per_key_join", "snvs", f"""
v_ AS (SELECT {_K}, max(abs(score)) AS s FROM snvs WHERE set_ = 'motif' AND score IS NOT NULL GROUP BY ALL)
SELECT s.kind, count(*) AS n, round(sum(v_.s), 4) AS total FROM snvs s JOIN v_ ON s.chrom = v_.chrom AND s.pos = v_.pos AND s.ref = v_.ref AND s.alt = v_.alt GROUP BY s.kind""")
def jn2(t):
    v = t.snvs.where("set_ = 'motif' AND score IS NOT NULL").groupBy(*KEY).agg(F.max(F.abs("score")).alias("s"))
    return t.snvs.select(*KEY, "kind").join(v, KEY).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("total"))


@query("jn3_rows_at_scored_positions", "snvs", f"""
SELECT {_K}, motif_id, state FROM snvs a WHERE EXISTS (SELECT 1 FROM snvs b WHERE b.chrom = a.chrom AND b.pos = a.pos AND b.set_ = 'motif' AND b.score IS NOT NULL)""")
def jn3(t):
    at = t.snvs.where("set_ = 'motif' AND score IS NOT NULL").select("chrom", "pos")
    return t.snvs.join(at, ["chrom", "pos"], "left_semi").select(*KEY, "motif_id", "state")


@query("jn4_covariates_and_union", "snvs", SCORED + f"SELECT {_K}, motif_id, kind, cls, abs_avi, gc, delta, cast(cpg AS int) AS cpg, subst FROM scored")
def jn4(t):
    return scored(t).select(*KEY, "motif_id", "kind", "cls", "abs_avi", "gc", "delta", "cpg", "subst")


@query("set1_set_operations", "snvs", f"""
a_ AS (SELECT DISTINCT {_K} FROM snvs WHERE set_ = 'motif'), b_ AS (SELECT DISTINCT {_K} FROM snvs WHERE set_ = 'flank')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a_ INTERSECT SELECT * FROM b_) UNION ALL SELECT 'only_motif', count(*) FROM (SELECT * FROM a_ EXCEPT SELECT * FROM b_)
UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a_ UNION SELECT * FROM b_)""")
def set1(t):
    a, b = (t.snvs.where(F.col("set_") == s).select(*KEY).distinct() for s in ("motif", "flank"))
    n = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "only_motif")).unionByName(n(a.union(b).distinct(), "union"))


def control_threshold(df, keys=("kind",), p=0.99):
    return ordered.exact_quantiles(df.where("cls = 'control'"), "abs_avi", [p], keys).select(*keys, F.col("q0").alias("top"))


def with_top(df):
    """Flag membership of the top 1 % as the controls define it."""
    return df.join(F.broadcast(control_threshold(df)), "kind").withColumn("top1", (F.col("abs_avi") >= F.col("top")).cast("int"))  # a row per kind


TOP = """, th_ AS (SELECT kind, quantile_cont(abs_avi, 0.99) AS top FROM scored WHERE cls = 'control' GROUP BY kind),
tp_ AS (SELECT s.*, cast(abs_avi >= top AS int) AS top1 FROM scored s JOIN th_ ON s.kind = th_.kind)"""


@query("agg9_class_table", "snvs", SCORED + TOP + """
SELECT kind, cls, count(*) AS n, round(quantile_cont(abs_avi, 0.5), 6) AS median_abs, round(avg(top1), 6) AS frac_top1 FROM tp_ GROUP BY ALL""")
def agg9(t):
    rows = scored(t)
    df = with_top(rows)
    med = ordered.exact_quantiles(rows, "abs_avi", [0.5], ["kind", "cls"]).select("kind", "cls", r6("q0").alias("median_abs"))
    return df.groupBy("kind", "cls").agg(F.count("*").alias("n"), r6(F.avg("top1")).alias("frac_top1")).join(med, ["kind", "cls"])


@query("agg10_covariate_balance", "snvs", SCORED + """
SELECT kind, cls, count(*) AS n, round(avg(gc), 4) AS mean_gc, round(avg(cpg), 4) AS frac_cpg FROM scored GROUP BY ALL""")
def agg10(t):
    return scored(t).groupBy("kind", "cls").agg(F.count("*").alias("n"), F.round(F.avg("gc"), 4).alias("mean_gc"), F.round(F.avg("cpg"), 4).alias("frac_cpg"))


@query("var4_cpg_context", "snvs genome", """
ch_ AS (SELECT chrom, piece, concat(lag(s, 1, '') OVER w, s, lead(s, 1, '') OVER w) AS x, length(lag(s, 1, '') OVER w) AS pad FROM genome WINDOW w AS (PARTITION BY chrom ORDER BY piece)),
p_ AS (SELECT DISTINCT chrom, pos FROM snvs)
SELECT p_.chrom, p_.pos, substr(x, pad + p_.pos - 1 - 96 * piece, 2) = 'CG' AND pad + p_.pos - 1 - 96 * piece > 0 OR substr(x, pad + p_.pos - 96 * piece, 2) = 'CG' AS cpg FROM p_ JOIN ch_ ON p_.chrom = ch_.chrom AND piece = (p_.pos - 1) // 96""")
def var4(t):
    from ..operators import motifs
    near = motifs.with_neighbours(t.genome, 1, 1)
    p = t.snvs.select("chrom", "pos").distinct().withColumn("piece", F.floor((F.col("pos") - 1) / 96))
    j = p.join(near, ["chrom", "piece"])
    x = F.concat("prev", "own", "next")
    at = F.length("prev") + F.col("pos") - F.col("piece") * 96  # 1-based place of the base in x
    before = F.when(at > 1, F.substr(x, at - 1, F.lit(2)) == "CG").otherwise(F.lit(False))
    return j.select("chrom", "pos", (before | (F.substr(x, at, F.lit(2)) == "CG")).alias("cpg"))


_PICK = """a_ AS (SELECT chrom, motif_id, count_if(state = 'motif_lost') AS n_lost, max(abs(delta)) AS m FROM snvs GROUP BY ALL HAVING count_if(state = 'motif_lost') > 0)"""


def pick_motifs(t, n, seed=None):
    """Motifs with a lost SNV, n per chromosome: by largest |delta|, or drawn by hash when a seed is given."""
    agg = t.snvs.groupBy("chrom", "motif_id").agg(F.count_if(F.col("state") == "motif_lost").alias("n_lost"), F.max(F.abs("delta")).alias("m")).where("n_lost > 0")
    order = [F.xxhash64("motif_id", F.lit(seed)), "motif_id"] if seed is not None else [F.desc_nulls_last("m"), "motif_id"]
    return agg.withColumn("r", F.row_number().over(Window.partitionBy("chrom").orderBy(*order))).where(F.col("r") <= n).drop("r")


@query("rnk6_motifs_by_effect", "snvs", _PICK + """
SELECT chrom, motif_id, cast(n_lost AS bigint) AS n_lost, m FROM a_ QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY m DESC NULLS LAST, motif_id) <= 150""")
def rnk6(t):
    return pick_motifs(t, 150)


@query("rnk6_motifs_sampled", "snvs", _PICK + """
SELECT chrom, least(150, count(*)) AS n_picked, cast(0 AS bigint) AS n_without_loss FROM a_ GROUP BY chrom""")
def rnk6_sampled(t):
    return pick_motifs(t, 150, seed=1).groupBy("chrom").agg(F.count("*").alias("n_picked"), F.count_if(F.col("n_lost") == 0).alias("n_without_loss"))


@query("rnk7_leave_one_chromosome", "snvs", SCORED + TOP + """,
c_ AS (SELECT kind, chrom, count_if(cls = 'motif_lost') AS nl, sum(CASE WHEN cls = 'motif_lost' THEN top1 ELSE 0 END) AS tl, count_if(cls = 'control') AS nc, sum(CASE WHEN cls = 'control' THEN top1 ELSE 0 END) AS tc
  FROM tp_ GROUP BY ALL)
SELECT kind, chrom, round(CASE WHEN (nl - tl) * tc <> 0 THEN tl * (nc - tc) / ((nl - tl) * tc) END, 6) AS odds_ratio FROM c_ WHERE nl > 50 AND nc > 50""")
def rnk7(t):
    n = lambda c: F.count_if(F.col("cls") == c)
    top = lambda c: F.sum(F.when(F.col("cls") == c, F.col("top1")).otherwise(0))
    c = with_top(scored(t)).groupBy("kind", "chrom").agg(n("motif_lost").alias("nl"), top("motif_lost").alias("tl"), n("control").alias("nc"), top("control").alias("tc"))
    c = c.where("nl > 50 AND nc > 50")
    denominator = (F.col("nl") - F.col("tl")) * F.col("tc")
    return c.select("kind", "chrom", r6(F.when(denominator != 0, F.col("tl") * (F.col("nc") - F.col("tc")) / denominator)).alias("odds_ratio"))
