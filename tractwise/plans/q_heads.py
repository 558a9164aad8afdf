"""Heads: their rows, out-of-fold answers, intervals, gates and posteriors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import condition, motif, seq, thermo, variant
from ..operators import heads as heads_
from ..operators import models, motifs, ordered, ranking, stats
from ..session import cut_lineage
from . import duck as d
from .q_audit import conformal_coverage
from .q_motifs import _GENOME_EDITS, _state_sql, genome_motifs, motif_edits
from .q_sequences import r6
from .q_stats import linear_fit
from .q_variants import _REC, KEY, headline, records, track_max
from .registry import query

# the derived table numbers its sources; which of them stands for which published one
ALIAS = {
    "g4stab_experimental_tm": "src0", "shuffled::g4stab_experimental_tm": "src1", "g4sp_topology": "src2", "shuffled::g4sp_topology": "src3",
    "im_pht_biophysical": "src4", "shuffled::im_pht_biophysical": "src5", "duvma_im_stability_landscape": "src6",
    "gse220882_hek293t_im_cutandtag": "src0", "shuffled::gse220882_hek293t_im_cutandtag": "src7",
    "gse220882_hek293t_g4_cutandtag": "src4", "shuffled::gse220882_hek293t_g4_cutandtag": "src6",
    "gse220882_hek293t_locus_state": "locus", "shuffled::gse220882_hek293t_locus_state": "locus_shuffled",
    "im_architecture_positives": "src1", "im_architecture_negatives": "src2"}
SPECS = heads_.named(heads_.SPECS, ALIAS)
REGRESSION = [s[0] for s in SPECS if s[2] == "regression"]
_TRAINED = {}


def heads_of(t, variants=(True,), only=None, most=heads_.MAX_ROWS) -> heads_.Heads:
    """The heads (or those named in `only`) fitted once per input folder and session, on everything their arguments say."""
    at = (t.folder, t.spark.sparkContext.applicationId, variants, only, most)
    if at not in _TRAINED:
        _TRAINED[at] = heads_.Heads(t.training, [s for s in SPECS if only is None or s[0] in only], most, variants)
    return _TRAINED[at]


def _list(values):
    return "NULL::varchar[]" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


# rows of every head
ROWS_SQL = "hd_(head, hkind, task, target, classes, tiers, labels, sources, grp, members) AS (VALUES " + ", ".join(
    f"('{s[0]}', '{s[1]}', '{s[2]}', '{s[3]}', {_list(s[4])}, {_list(s[5])}, {_list(s[6])}, {_list(s[7])}, '{s[8]}', {s[9]})" for s in SPECS) + f"""),
hr_ AS (
  SELECT * FROM (
    SELECT head, task, grp, members, record_id, sequence, k, na, li_nh4, mg, coalesce(ph, 7) AS ph, temperature, crowder_pct, strand_conc,
           CASE target WHEN 'tm' THEN tm WHEN 'ph_t' THEN ph_t WHEN 'folded' THEN folded ELSE list_position(classes, topology) - 1 END AS lab
    FROM training JOIN hd_ ON kind = hkind
    WHERE list_contains(tiers, evidence_tier) AND (labels IS NULL OR list_contains(labels, label_class)) AND (sources IS NULL OR list_contains(sources, source))) x
  WHERE lab IS NOT NULL AND lab >= 0),"""
# the at most MAX_ROWS of them it is fitted on for scans
HEAD_SQL = ROWS_SQL + f"""
sm_ AS (
  SELECT * FROM hr_ QUALIFY count(*) OVER (PARTITION BY head) >= {heads_.MIN_ROWS}
    AND row_number() OVER (PARTITION BY head ORDER BY cast('0x' || substr(md5(record_id), 1, 8) AS bigint), record_id) <= {heads_.MAX_ROWS})"""
# all of them, for the quality of heads
WHOLE_SQL = ROWS_SQL + f"""
sm_ AS (SELECT * FROM hr_ QUALIFY count(*) OVER (PARTITION BY head) >= {heads_.MIN_ROWS})"""


@query("ml1_head_rows", "training", HEAD_SQL + """
SELECT head, count(*) AS n_rows, count(DISTINCT sequence) AS n_sequences, round(avg(lab), 6) AS mean_label FROM hr_ GROUP BY head""")
def ml1(t):
    """The rows of the twelve heads in one pass."""
    return heads_.head_rows(t.training, SPECS).groupBy("head").agg(
        F.count("*").alias("n_rows"), F.countDistinct("sequence").alias("n_sequences"), r6(F.avg("label")).alias("mean_label"))


@query("jn10_training_overlap", "training oligos", HEAD_SQL + """,
b_ AS (SELECT DISTINCT o AS sequence FROM oligos), t_ AS (SELECT head, sequence, count(*) AS n FROM hr_ GROUP BY ALL)
SELECT head, cast(sum(n) AS bigint) AS n_rows, count(b_.sequence) AS n_seen, round(count(b_.sequence) / (SELECT count(*) FROM b_), 6) AS fraction FROM t_ LEFT JOIN b_ ON t_.sequence = b_.sequence GROUP BY head""")
def jn10(t):
    """How much of a benchmark each of the twelve heads saw in training."""
    bench = t.oligos.select(seq.clean("o").alias("sequence")).distinct()
    size = bench.agg(F.count("*").alias("size"))
    seen = heads_.head_rows(t.training, SPECS).groupBy("head", "sequence").agg(F.count("*").alias("n")).join(
        bench.withColumn("hit", F.lit(1)), "sequence", "left")
    per = seen.groupBy("head").agg(F.sum("n").alias("n_rows"), F.count("hit").alias("n_seen"))
    return ordered.attach(per, size).select("head", "n_rows", "n_seen", r6(F.col("n_seen") / F.col("size")).alias("fraction"))


@query("ml2_out_of_fold", "training", WHOLE_SQL + f""",
gr_ AS (SELECT head, count(DISTINCT sequence) AS n_sequences, count(DISTINCT concat(k, '/', na, '/', li_nh4, '/', mg)) AS n_buffers FROM sm_ GROUP BY head)
SELECT head, task, count(*) AS n_rows, count(DISTINCT record_id) AS n_records, count(*) AS n_answered, CAST(sum(members) AS bigint) AS n_member_answers,
       CAST(0 AS bigint) AS n_groups_split, round(avg(lab), 6) AS mean_label, any_value(n_sequences) AS n_sequences,
       CAST(CASE any_value(grp) WHEN 'condition' THEN least({heads_.FOLDS}, greatest(2, any_value(n_buffers))) ELSE {heads_.FOLDS} END AS bigint) AS n_folds
FROM sm_ JOIN gr_ USING (head) GROUP BY head, task""")
def ml2(t):
    """Every labelled row of every head answered once, by members that saw no row of its group."""
    model = heads_of(t, most=None)
    h = model.held
    whole = F.forall("members", lambda m: F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = h.groupBy("head", "task").agg(
        F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_records"), F.count_if(whole & (F.size("members") > 0)).alias("n_answered"),
        F.sum(F.size("members").cast("bigint")).alias("n_member_answers"), r6(F.avg("label")).alias("mean_label"), F.countDistinct("fold").alias("n_folds"))
    groups = h.groupBy("head", "group_id").agg(F.countDistinct("fold").alias("f")).groupBy("head").agg(F.count_if(F.col("f") > 1).alias("n_groups_split"))
    sample = model.sample.groupBy("head").agg(F.countDistinct("sequence").alias("n_sequences"))
    return rows.join(groups, "head").join(sample, "head")


@query("ml2_out_of_fold_regression", "training", HEAD_SQL + """
SELECT head, count(*) AS n, round(min(lab), 6) AS lowest, round(max(lab), 6) AS highest, count(*) AS n_in_reach FROM sm_ WHERE task = 'regression' GROUP BY head""")
def ml2_regression(t):
    """Held-out values of the regression heads stay within reach of the labels (half the range beyond either end)."""
    h = heads_of(t).held.where("task = 'regression'").select("head", "label", heads_.answer("members").alias("p"))
    ends = h.groupBy("head").agg(F.min("label").alias("lowest"), F.max("label").alias("highest"))
    reach = (F.col("highest") - F.col("lowest")) / 2
    return h.join(F.broadcast(ends), "head").groupBy("head").agg(
        F.count("*").alias("n"), r6(F.first("lowest")).alias("lowest"), r6(F.first("highest")).alias("highest"),
        F.count_if(F.col("p").between(F.col("lowest") - reach, F.col("highest") + reach)).alias("n_in_reach"))


@query("ml2_out_of_fold_classes", "training", WHOLE_SQL + """
SELECT head, cast(lab AS int) AS y, count(*) AS n, count(*) AS n_posterior FROM sm_ WHERE task = 'multiclass' GROUP BY head, lab""")
def ml2_classes(t):
    """Held-out posteriors of the multiclass heads: per class the rows, and those whose probabilities add up to one."""
    h = heads_of(t, most=None).held.where("task = 'multiclass'")
    total = F.aggregate("members", F.lit(0.0), lambda a, m: a + F.aggregate(m, F.lit(0.0), lambda b, v: b + v)) / F.size("members")
    return h.groupBy("head", F.col("label").cast("int").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.abs(total - 1) < 1e-9).alias("n_posterior"))


@query("ml2_metrics")
def ml2_metrics(t):
    """Held-out quality per head: R2 and MAE of values, Brier score and accuracy of classes, against the share of the most common class."""
    h = heads_of(t, most=None).held
    value = h.where("task = 'regression'").select("head", "label", heads_.answer("members").alias("p"))
    r = stats.regression_metrics(value, "label", "p", ["head"]).select("head", "n", F.col("r2").alias("skill"), F.col("mae").alias("error"))
    width = F.greatest(F.size(F.get("members", 0)), F.lit(2))
    mean = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.aggregate("members", F.lit(0.0), lambda a, m: a + F.get(m, c)) / F.size("members"))
    p1 = heads_.answer("members")
    post = F.when(F.col("task") == "binary", F.array(1 - p1, p1)).otherwise(mean)
    k = h.where("task <> 'regression'").select("head", F.col("label").cast("int").alias("y"), post.alias("post"))
    brier = F.aggregate(F.transform("post", lambda v, i: F.pow(v - (i == F.col("y")).cast("int"), F.lit(2))), F.lit(0.0), lambda a, v: a + v)
    hit = F.get("post", F.col("y")) >= F.array_max("post")
    c = k.groupBy("head").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("skill"), F.avg(brier).alias("error"))
    return r.unionByName(c)


_RANGES = HEAD_SQL + """,
lo_ AS (SELECT head, axis, v FROM (SELECT head, k, na, li_nh4, mg, ph::double AS ph, temperature, crowder_pct, strand_conc, length(sequence)::double AS length FROM sm_)
  UNPIVOT (v FOR axis IN (k, na, li_nh4, mg, ph, temperature, crowder_pct, strand_conc, length))),
rg_ AS (SELECT head, axis, min(v) AS lo, max(v) AS hi, count(DISTINCT round(v, 3)) AS n_unique FROM lo_ GROUP BY ALL),
sh_ AS (SELECT head, list(DISTINCT sequence) AS known FROM sm_ GROUP BY head HAVING count(DISTINCT sequence) <= """ + str(heads_.ALLOW_LIST) + f"""),
q_ AS (SELECT ok_.seq_id, CASE WHEN seq_id % 41 = 0 THEN repeat('N', 32) ELSE o END AS sequence, CASE WHEN seq_id % 3 = 0 THEN 100 WHEN seq_id % 3 = 1 THEN 0 ELSE 150 END::double AS k,
   CASE WHEN seq_id % 3 = 1 THEN 100 ELSE 0 END::double AS na, 0::double AS li_nh4, 0::double AS mg, (6 + seq_id % 4 * 0.5)::double AS ph, 25::double AS temperature, 0::double AS crowder_pct, 5::double AS strand_conc FROM oligos ok_),
ql_ AS (SELECT seq_id, axis, v FROM (SELECT seq_id, k, na, li_nh4, mg, ph, temperature, crowder_pct, strand_conc, length(sequence)::double AS length FROM q_)
  UNPIVOT (v FOR axis IN (k, na, li_nh4, mg, ph, temperature, crowder_pct, strand_conc, length))),
ax_ AS (SELECT DISTINCT rg_.head, ql_.seq_id FROM ql_ JOIN rg_ USING (axis) JOIN hd_ ON hd_.head = rg_.head
  WHERE CASE WHEN axis = 'ph' AND target = 'ph_t' OR axis = 'temperature' AND target = 'tm' THEN false
             ELSE v < lo OR v > hi OR (axis <> 'length' AND n_unique <= 2 AND v <> lo AND v <> hi) END),
gt_ AS (SELECT q_.seq_id, hd_.head, hd_.task, q_.ph, hkind, target,
   CASE WHEN regexp_matches(q_.sequence, '^N*$') THEN 'no_nucleotides' WHEN known IS NOT NULL AND NOT list_contains(known, q_.sequence) THEN 'not_in_allow_list'
        WHEN hd_.head IN ({", ".join(f"'{h}'" for h in heads_.WINDOW_REFUSED)}) AND length(q_.sequence) > ln_.hi THEN 'genomic_window' END AS refusal,
   ax_.head IS NOT NULL OR CASE hkind WHEN 'G4' THEN {d.mcount('q_.sequence', 'G4')} = 0 AND {d.hunter_mean('q_.sequence')} < 0.5
        WHEN 'iM' THEN {d.mcount('q_.sequence', 'iM')} = 0 AND {d.hunter_mean('q_.sequence')} > -0.5 ELSE false END AS outside
  FROM q_ CROSS JOIN hd_ JOIN (SELECT * FROM rg_ WHERE axis = 'length') ln_ ON ln_.head = hd_.head
  LEFT JOIN sh_ ON sh_.head = hd_.head LEFT JOIN ax_ ON ax_.head = hd_.head AND ax_.seq_id = q_.seq_id)"""


def questions(t):
    """Oligos asked about in three buffers; some hold no nucleotides at all."""
    three = F.col("seq_id") % 3
    return t.oligos.select(
        "seq_id", seq.clean(F.when(F.col("seq_id") % 41 == 0, "Z" * 32).otherwise(F.col("o"))).alias("sequence"),
        F.when(three == 0, 100.0).when(three == 1, 0.0).otherwise(150.0).alias("k"), F.when(three == 1, 100.0).otherwise(0.0).alias("na"),
        F.lit(0.0).alias("li_nh4"), F.lit(0.0).alias("mg"), (6 + F.col("seq_id") % 4 * 0.5).alias("ph"),
        F.lit(25.0).alias("temperature"), F.lit(0.0).alias("crowder_pct"), F.lit(5.0).alias("strand_conc"))


@query("ml5_predictions", "training oligos", _RANGES + """
SELECT head, coalesce(refusal, 'answered') AS state, count(*) AS n, cast(count_if(NOT outside) AS bigint) AS n_in_domain,
  cast(count_if(refusal IS NULL AND task = 'regression') AS bigint) AS n_values, cast(count_if(refusal IS NULL AND task = 'regression') AS bigint) AS n_intervals,
  cast(count_if(refusal IS NULL AND task = 'binary') AS bigint) AS n_probabilities, cast(count_if(refusal IS NULL AND task = 'multiclass') AS bigint) AS n_posteriors,
  cast(count_if(refusal IS NULL AND task = 'regression') AS bigint) AS n_fractions
FROM gt_ GROUP BY head, refusal""")
def ml5(t):
    """All heads over all oligos in their buffers: who is refused and why, and which numbers the others carry."""
    p = heads_of(t).predict(questions(t), ["seq_id"])
    posterior = F.abs(F.aggregate(F.map_values("posterior"), F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9
    return p.groupBy("head", F.coalesce("refusal", F.lit("answered")).alias("state")).agg(
        F.count("*").alias("n"), F.count_if("in_domain").alias("n_in_domain"), F.count("value").alias("n_values"),
        F.count_if(F.col("low") < F.col("high")).alias("n_intervals"), F.count_if(F.col("probability").between(0, 1)).alias("n_probabilities"),
        F.count_if(posterior).alias("n_posteriors"), F.count_if(F.col("folded_fraction").between(0, 1)).alias("n_fractions"))


_COVER = f"""cv_ AS (SELECT head, count(DISTINCT CASE grp WHEN 'condition' THEN concat(k, '/', na, '/', li_nh4, '/', mg) ELSE sequence END) AS n_groups, count(*) AS n FROM sm_ WHERE task = 'regression' GROUP BY head)"""


@query("ml5_interval_coverage", "training", HEAD_SQL + ", " + _COVER + """
SELECT head, n, CASE WHEN n_groups >= 4 THEN true END AS covered FROM cv_""")
def ml5_coverage(t):
    """Held-out coverage of the intervals: half the groups set the half-width, the others are covered within 0.75 to 0.99; fewer than four groups give null."""
    residual = heads_of(t).held.where("task = 'regression'").withColumn("r", F.abs(heads_.answer("members") - F.col("label")))
    c = conformal_coverage(residual, "head", "group_id", "r").withColumnRenamed("n_splits", "s")
    n = residual.groupBy("head").agg(F.count("*").alias("n"))
    return n.join(c, "head", "left").select("head", "n", F.when(F.col("s") > 0, F.col("coverage").between(0.75, 0.99)).alias("covered"))


@query("ml13_condition_ablation", "training", HEAD_SQL + """
SELECT head, conditions, count(*) AS n, round(avg(lab), 6) AS mean_label, cast(0 AS bigint) AS n_other_fold FROM sm_, (VALUES (true), (false)) v(conditions) WHERE task = 'regression' GROUP BY ALL""")
def ml13(t):
    """Regression heads with and without buffer features over the same folds."""
    held = heads_.out_of_fold(heads_of(t, (True, False), tuple(REGRESSION)).fitted).where("task = 'regression'")
    folds = held.groupBy("head", "record_id").agg((F.min("fold") != F.max("fold")).alias("moved"))
    moved = folds.groupBy("head").agg(F.count_if("moved").alias("n_other_fold"))
    return held.groupBy("head", "conditions").agg(F.count("*").alias("n"), r6(F.avg("label")).alias("mean_label")).join(moved, "head")


@query("ml13_ablation_metrics")
def ml13_metrics(t):
    """What the buffer adds: R2 and MAE per regression head with and without its features."""
    held = heads_.out_of_fold(heads_of(t, (True, False), tuple(REGRESSION)).fitted).where("task = 'regression'")
    return stats.regression_metrics(held.withColumn("p", heads_.answer("members")), "label", "p", ["head", "conditions"])


# ---------------------------------------------------------------------- scans
_TRAINED_SQL = HEAD_SQL + ", tr_ AS (SELECT head, hkind, task, target FROM hd_ WHERE head IN (SELECT head FROM sm_))"


def _routed(kind, base):
    f, r = d.mcount("o", kind), d.mcount(d.revcomp("o"), kind)
    other = {"G": "C", "C": "G"}[base]
    return f"""SELECT '{kind}' AS hkind, seq_id, CASE WHEN CASE WHEN f > 0 OR r > 0 THEN f >= r ELSE {d.count('o', base)} >= {d.count('o', other)} END THEN o ELSE {d.revcomp('o')} END AS o
  FROM (SELECT *, {f} AS f, {r} AS r FROM oligos)"""


_ROUTED_ONLY = f"rt_ AS ({_routed('G4', 'G')} UNION ALL {_routed('iM', 'C')})"
_ROUTED_EDITS = f"""{_ROUTED_ONLY},
re_ AS (SELECT hkind, seq_id, o, concat(substr(o, 1, i0), b, substr(o, i0 + 2)) AS mut FROM (SELECT *, unnest(range(0, length(o))) AS i0 FROM rt_)
  JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(b) ON b <> substr(o, i0 + 1, 1)),
rs_ AS (SELECT hkind, seq_id, CASE hkind WHEN 'G4' THEN {_state_sql(d.mcount('o', 'G4'), d.mcount('mut', 'G4'))} ELSE {_state_sql(d.mcount('o', 'iM'), d.mcount('mut', 'iM'))} END AS state,
  CASE hkind WHEN 'G4' THEN {d.mcount(d.revcomp('o'), 'G4')} = 0 AND {d.mcount(d.revcomp('mut'), 'G4')} > 0 ELSE {d.mcount(d.revcomp('o'), 'iM')} = 0 AND {d.mcount(d.revcomp('mut'), 'iM')} > 0 END AS other FROM re_)"""


_SCAN_SQL = """
SELECT head, state, count(*) AS n, cast(CASE WHEN state IN ('motif_lost', 'no_motif') THEN 0 ELSE count(*) END AS bigint) AS n_delta,
  cast(CASE WHEN state IN ('motif_lost', 'no_motif') THEN 0 ELSE count(*) END AS bigint) AS n_spread, cast(count_if(other) AS bigint) AS n_other_gain
FROM rs_ JOIN tr_ USING (hkind) WHERE task <> 'multiclass'{} GROUP BY head, state"""


def scan_counts(t, model):
    scan = heads_.mutation_scan(model, t.oligos, "seq_id", "o", models.routed, motifs.substitutions, variant.motif_state)
    return scan.groupBy("head", "state").agg(F.count("*").alias("n"), F.count("delta").alias("n_delta"), F.count_if(F.col("delta_sd") >= 0).alias("n_spread"),
                                             F.count_if("other_gain").alias("n_other_gain"))


@query("ml7_mutation_scan", "training oligos", _TRAINED_SQL + ", " + _ROUTED_EDITS + _SCAN_SQL.format(" AND head = 'g4_tm'"))
def ml7(t):
    """All substitutions of all oligos for the melting head."""
    return scan_counts(t, heads_of(t, only=("g4_tm",)))


@query("ml7_all_heads", "training oligos", _TRAINED_SQL + ", " + _ROUTED_EDITS + _SCAN_SQL.format(""))
def ml7_all(t):
    """All substitutions of all oligos for all heads of one number."""
    return scan_counts(t, heads_of(t))


_AXES = {"k": [0, 10, 25, 50, 100, 150], "ph": [5, 6, 7, 8], "crowder_pct": [0, 20, 40]}


@query("ml8_condition_scan", "training oligos", _TRAINED_SQL + """,
un_ AS (SELECT head, axis, count(DISTINCT round(v, 3)) AS u FROM (SELECT head, k, ph::double AS ph, crowder_pct FROM sm_) UNPIVOT (v FOR axis IN (k, ph, crowder_pct)) GROUP BY ALL),
po_(axis, points) AS (VALUES """ + ", ".join(f"('{a}', {len(v)})" for a, v in _AXES.items()) + """)
SELECT head, axis, CASE WHEN u > 1 THEN 'varied' ELSE 'inert' END AS state, CASE WHEN u > 1 THEN points ELSE 1 END * (SELECT count(*) FROM oligos) AS n,
  CASE WHEN u > 1 THEN points ELSE 0 END * (SELECT count(*) FROM oligos) AS n_values
FROM tr_ JOIN un_ USING (head) JOIN po_ USING (axis) WHERE task <> 'multiclass'""")
def ml8(t):
    """Three axes by all heads: responsive ones along every point, inert ones listed once."""
    base = heads_.with_defaults(t.oligos.select("seq_id", F.col("o").alias("sequence")))
    out = None
    for axis, values in _AXES.items():
        part = heads_.condition_scan(heads_of(t), base, ["seq_id"], axis, values)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("head", "axis", "state").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


@query("ml9_batch", "training oligos", _TRAINED_SQL + """
SELECT head, preset, count(*) AS n, cast(count_if(seq_id % 13 = 0) AS bigint) AS n_excluded, count(*) - cast(count_if(seq_id % 13 = 0) AS bigint) AS n_scored
FROM oligos, (VALUES ('k100'), ('na100')) v(preset), tr_ GROUP BY head, preset""")
def ml9(t):
    """Sequences by conditions by heads; an excluded record is named with its reason and never scored."""
    model = heads_of(t)
    given = t.oligos.select("seq_id", seq.clean(F.when(F.col("seq_id") % 13 == 0, "").otherwise(F.col("o"))).alias("sequence"))
    cells = given.select("*", F.inline(condition.presets_array(["k100", "na100"])))
    scored = model.members(cells.where("sequence <> ''")).select("preset", "head", F.lit(None).cast("string").alias("reason"), heads_.answer("members").alias("value"))
    excluded = cells.where("sequence = ''").select("preset", F.explode(F.array(*[F.lit(h) for h in sorted(model.models)]).cast("array<string>")).alias("head"),
                                                   F.lit("no nucleotides after cleaning").alias("reason"), F.lit(None).cast("double").alias("value"))
    out = scored.unionByName(excluded)
    return out.groupBy("head", "preset").agg(F.count("*").alias("n"), F.count("reason").alias("n_excluded"), F.count("value").alias("n_scored"))


def structural(t):
    """Every SNV of every genome motif: lost, or retained with the change of the first head of its kind that is trained."""
    model, gm = heads_of(t), cut_lineage(genome_motifs(t))
    out = None
    for kind, wanted in (("G4", ["g4_tm", "g4_fold"]), ("iM", ["im_pht", "im_fold"])):
        names = [h for h in wanted if h in model.models][:1]
        edits = motif_edits(gm.where(F.col("kind") == kind)).select(*KEY, "kind", "strand", "state", "text_", F.col("mutant").alias("sequence"))
        edits = heads_.with_defaults(edits.withColumn("retained", F.col("state") == "motif_retained"))
        if names:
            edits = model.deltas(edits, names, "text_", "retained", [*KEY, "kind", "strand", "state"]).withColumn("delta", F.round("delta", 3))
        else:
            edits = edits.withColumn("delta", F.lit(None).cast("double"))
        part = edits.select(*KEY, "kind", "strand", "state", "delta")
        out = part if out is None else out.unionByName(part)
    return out


_HAS_NUMBER = "CASE kind WHEN 'G4' THEN EXISTS (FROM tr_ WHERE head IN ('g4_tm', 'g4_fold')) ELSE EXISTS (FROM tr_ WHERE head IN ('im_pht', 'im_fold')) END"


@query("ml10_variant_scan", "training genome snvs", _TRAINED_SQL + ", " + _GENOME_EDITS + ", " + _REC + f""",
vs_ AS (SELECT ge_.kind, ge_.state, hl_.score AS reg, {_HAS_NUMBER} AS has FROM ge_ LEFT JOIN hl_ ON ge_.chrom = hl_.chrom AND ge_.pos = hl_.pos AND ge_.ref = hl_.ref AND ge_.alt = hl_.alt)
SELECT kind, count(*) AS n, cast(count_if(state = 'motif_lost') AS bigint) AS n_lost, count(reg) AS n_regulatory, cast(count_if(state <> 'motif_lost' AND has) AS bigint) AS n_delta,
  cast(count_if(reg IS NULL OR (state <> 'motif_lost' AND NOT has)) AS bigint) AS n_unclassified, cast(count_if(reg IS NOT NULL AND (state = 'motif_lost' OR has)) AS bigint) AS n_ranked FROM vs_ GROUP BY kind""")
def ml10(t):
    """Genome motif variants joined to regulatory scores on the whole key and ranked on both axes."""
    reg = headline(track_max(records(t), KEY), KEY, "scorer1").select(*KEY, F.col("score").alias("reg"))
    v = cut_lineage(structural(t).join(reg, KEY, "left"))  # scored once, ranked from the written rows
    q = ranking.quadrants(v.select("*", F.col("state").alias("motif_state"), F.abs("delta").alias("magnitude")))
    return q.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "motif_lost").alias("n_lost"), F.count("reg").alias("n_regulatory"), F.count("delta").alias("n_delta"),
        F.count_if(F.col("quadrant") == "unclassified").alias("n_unclassified"), F.count("combined_rank").alias("n_ranked"))


@query("ml11_structural_effects", "training genome", _TRAINED_SQL + ", " + _GENOME_EDITS + f"""
SELECT chrom, kind, state, count(*) AS n, cast(count_if(state <> 'motif_lost' AND {_HAS_NUMBER}) AS bigint) AS n_delta FROM ge_ GROUP BY ALL""")
def ml11(t):
    return structural(t).groupBy("chrom", "kind", "state").agg(F.count("*").alias("n"), F.count("delta").alias("n_delta"))


# fixed values: which heads speak for which structure, and which are proxies
CARDS = {"G4": ["g4_fold", "g4_topology", "g4_tm", "g4_tm_distilled"], "iM": ["im_fold", "im_pht", "im_pht_condition", "im_tm_condition", "im_architecture"]}
PROXIES = {"G4": ["g4_fold_genomic"], "iM": ["im_fold_genomic"]}


@query("ml12_strand_evidence", "training oligos", _TRAINED_SQL + ", " + _ROUTED_ONLY + f"""
SELECT seq_id, hkind AS structure, rt_.o = oligos.o AS forward, CASE hkind WHEN 'G4' THEN {d.mcount('rt_.o', 'G4')} ELSE {d.mcount('rt_.o', 'iM')} END > 0 AS has_motif,
  (SELECT count(*) FROM tr_ WHERE head IN ({", ".join(f"'{h}'" for c in CARDS.values() for h in c)}) AND tr_.hkind = rt_.hkind) AS n_cards,
  (SELECT count(*) FROM tr_ WHERE head IN ('g4_fold_genomic', 'im_fold_genomic') AND tr_.hkind = rt_.hkind) AS n_proxies,
  (SELECT count(*) FROM tr_ WHERE head = 'locus_peak_overlap_state') AS n_locus
FROM rt_ JOIN oligos USING (seq_id)""")
def ml12(t):
    """Per structure the strand that carries it and the answers of its own heads; proxies and locus stay apart, nothing is combined."""
    model, out = heads_of(t), None
    answered = lambda x: heads_.answer(x["members"]).isNotNull()
    for kind in ("G4", "iM"):
        side = heads_.with_defaults(models.routed(t.oligos, "o", kind).select("seq_id", "o", "strand", "sequence")).withColumns({
            "structure": F.lit(kind), "has_motif": motif.has_motif("sequence", kind), "forward": F.col("sequence") == F.col("o")})
        side = model.wide(side, CARDS[kind] + PROXIES[kind], "own")
        side = model.wide(side.withColumn("sequence", F.col("o")), ["locus_peak_overlap_state"], "locus")
        count = lambda c, of: F.size(F.filter(c, of)).cast("bigint")
        part = side.select(
            "seq_id", "structure", "forward", "has_motif", count("own", lambda x: x["head"].isin(*CARDS[kind]) & answered(x)).alias("n_cards"),
            count("own", lambda x: x["head"].isin(*PROXIES[kind])).alias("n_proxies"), F.size("locus").cast("bigint").alias("n_locus"))
        out = part if out is None else out.unionByName(part)
    return out


def one_head(t, kind):
    """The head that scores elements of a kind: the first of its list that is trained."""
    return next(h for h in {"G4": ["g4_tm", "g4_fold"], "iM": ["im_pht", "im_fold"]}[kind] if h in heads_of(t).models)


def _found(view, keys, x):
    """Elements of both kinds on both strands of x."""
    return " UNION ALL ".join(f"SELECT {keys}, '{kind}' AS kind, '{strand}' AS strand, unnest(regexp_extract_all({y}, '{d.PAT[kind]}')) AS e FROM {view}"
                              for kind in ("G4", "iM") for strand, y in (("+", x), ("-", d.revcomp(x))))


@query("ml14_external_windows", "genome", f"""f_ AS ({_found('genome', 'chrom, piece', 's')})
SELECT g.chrom, g.piece, count(e) FILTER (kind = 'G4') AS n_g4, count(e) FILTER (kind = 'iM') AS n_im, count(e) FILTER (kind = 'G4') > 0 AS has_g4_score, count(e) FILTER (kind = 'iM') > 0 AS has_im_score
FROM genome g LEFT JOIN f_ ON f_.chrom = g.chrom AND f_.piece = g.piece GROUP BY ALL""")
def ml14(t):
    """Best motif score of each window per kind over both strands, with motif counts; a window without motifs keeps null."""
    model, out = heads_of(t), t.genome.select("chrom", "piece")
    for kind, short in (("G4", "g4"), ("iM", "im")):
        found = motifs.find(t.genome, ["chrom", "piece"], "s", [kind])
        fill = heads_.with_defaults(found.select("chrom", "piece", F.col("text").alias("sequence")))
        best = model.members(fill, [one_head(t, kind)]).groupBy("chrom", "piece").agg(F.max(heads_.answer("members")).alias(f"best_{short}"), F.count("*").alias(f"n_{short}"))
        out = out.join(best, ["chrom", "piece"], "left")
    return out.select("chrom", "piece", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("g4", "im")], *[F.col(f"best_{k}").isNotNull().alias(f"has_{k}_score") for k in ("g4", "im")])


FREEZE = "1996-01-01"  # panels count from this day on


@query("ml15_frozen_panels", "training records", f"""
pn_ AS (SELECT r.*, o_custkey % 40 AS panel, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS day FROM records r JOIN orders ON seq_id = o_orderkey),
pd_ AS (SELECT panel, count(day) = count(*) AS dated, min(day) AS since FROM pn_ GROUP BY panel)
SELECT panel, CASE WHEN NOT dated THEN 'undated' WHEN since < TIMESTAMP '{FREEZE}' THEN 'before_freeze' WHEN panel % 4 = 3 THEN 'model_changed' ELSE 'scored' END AS state, count(*) AS n,
  cast(count_if(dated AND since >= TIMESTAMP '{FREEZE}' AND panel % 4 <> 3) AS bigint) AS n_scored FROM pn_ JOIN pd_ USING (panel) GROUP BY ALL""")
def ml15(t):
    """Panels scored only when all their rows are dated after the freeze and the recorded model is this one; refused panels keep their rows."""
    model = heads_of(t)
    now = heads_.fingerprint(model)
    rows = t.records.join(t.orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("panel"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("day")), F.col("seq_id") == F.col("o_orderkey"))
    recorded = F.when(F.col("panel") % 4 == 3, F.sha2(F.lit(now), 256)).otherwise(F.lit(now))  # some panels were frozen with another model
    info = rows.groupBy("panel").agg((F.count("day") == F.count("*")).alias("dated"), F.min("day").alias("since")).withColumn("recorded", recorded)
    state = (F.when(~F.col("dated"), "undated").when(F.col("since") < F.lit(FREEZE).cast("timestamp"), "before_freeze")
             .when(F.col("recorded") != now, "model_changed").otherwise("scored"))
    p = rows.withColumns(condition.filled()).join(info.select("panel", state.alias("state")), "panel").select("panel", "state", "kind", "sequence", *condition.FIELDS)
    out = p.where("state <> 'scored'").select("panel", "state", F.lit(None).cast("double").alias("value"))
    for kind in ("G4", "iM"):
        got = model.members(p.where((F.col("state") == "scored") & (F.col("kind") == kind)), [one_head(t, kind)])
        out = out.unionByName(got.select("panel", "state", heads_.answer("members").alias("value")))
    return out.groupBy("panel", "state").agg(F.count("*").alias("n"), F.count("value").alias("n_scored"))


@query("ml16_energy_comparison", "training")
def ml16(t):
    """Free energy implied by held-out midpoints against the run-count heuristic, for both kinds."""
    held = heads_of(t).held.where(F.col("head").isin("g4_tm", "im_tm_condition", "g4_tm_distilled")).select("head", "record_id", heads_.answer("members").alias("value"))
    rows = held.join(t.training.select("record_id", "kind", seq.clean("sequence").alias("sequence"), *[f.alias(n) for n, f in condition.filled().items()]), "record_id")
    c = F.col
    heuristic = F.when(c("kind") == "G4", thermo.g4_energy(c("sequence"), condition.monovalent(), c("mg"), c("crowder_pct"), F.lit(37.0))).otherwise(
        thermo.im_energy(c("sequence"), c("ph"), c("mg"), c("crowder_pct"), F.lit(37.0)))
    x = rows.select(c("head"), thermo.dg_from_tm(c("value"), F.lit(37.0)).alias("dg"), heuristic.alias("raw"))
    return linear_fit(x, "dg", "raw", ["head"])


@query("mot7_scored_elements", "oligos", f"""f_ AS ({_found('oligos', 'seq_id', 'o')})
SELECT kind, strand, count(*) AS n, count(*) AS n_scored FROM f_ GROUP BY ALL""")
def mot7(t):
    """Every element of both kinds and strands scored by the head of its kind; at most 500 elements of a sequence, in order."""
    out = None
    for kind in ("G4", "iM"):
        found = motifs.find(t.oligos, ["seq_id"], "o", [kind])
        order = F.row_number().over(Window.partitionBy("seq_id").orderBy("strand", "start"))
        fill = heads_.with_defaults(found.withColumn("at", order).where("at <= 500").select("seq_id", "strand", "start", F.lit(kind).alias("kind"), F.col("text").alias("sequence")))
        part = heads_of(t).members(fill, [one_head(t, kind)]).select("kind", "strand", heads_.answer("members").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "strand").agg(F.count("*").alias("n"), F.count("value").alias("n_scored"))
