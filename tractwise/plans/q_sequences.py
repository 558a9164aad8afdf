"""Scalar operators over sequences, conditions, transitions and variants, and the feature blocks."""

import itertools

from pyspark.sql import functions as F

from ..functions import condition, features, motif, seq, thermo, variant
from . import duck as d
from .registry import query

# sequences as people paste them: lower case, U, foreign letters, blanks
RAW = "replace(replace(lower(o), 'tt', 'uU'), 'ca', 'r ')"


def r6(c):
    return F.round(c, 6)


@query("seq1_clean", "oligos", f"SELECT seq_id, {d.clean(RAW)} AS cleaned FROM oligos")
def seq1(t):
    return t.oligos.select("seq_id", seq.clean(F.expr(RAW)).alias("cleaned"))


@query("seq2_revcomp", "seqs", f"SELECT seq_id, {d.revcomp('s')} AS rc FROM seqs")
def seq2(t):
    return t.seqs.select("seq_id", seq.revcomp("s").alias("rc"))


@query("seq3_seq_hash", "oligos", f"SELECT seq_id, substr(sha1({d.clean(RAW)}), 1, 16) AS seq_hash FROM oligos")
def seq3(t):
    return t.oligos.select("seq_id", seq.seq_hash(F.expr(RAW)).alias("seq_hash"))


@query("seq4_g_rich_orientation", "seqs", f"""
SELECT seq_id, CASE WHEN {d.count('s', 'G')} >= {d.count('s', 'C')} THEN s ELSE {d.revcomp('s')} END AS oriented,
       CASE WHEN {d.count('s', 'G')} >= {d.count('s', 'C')} THEN '+' ELSE '-' END AS strand FROM seqs""")
def seq4(t):
    forward = seq.count_of("s", "G") >= seq.count_of("s", "C")
    return t.seqs.select("seq_id", seq.g_rich_orientation(F.col("s")).alias("oriented"),
                         F.when(forward, "+").otherwise("-").alias("strand"))


def route(df, s="s"):
    """Strand each structure kind is asked about: more motif hits, then the richer base, then the given strand."""
    f, r = F.col(s), seq.revcomp(s)
    df = df.withColumns({f"_{k}{n}": motif.motif_count(x, k) for k in ("G4", "iM") for n, x in (("f", f), ("r", r))})
    out = {}
    for k, base in motif.BASE.items():
        a, b = F.col(f"_{k}f"), F.col(f"_{k}r")
        richer = seq.count_of(s, base) >= seq.count_of(r, base)
        out[f"strand_{k}"] = F.when((a > 0) | (b > 0), F.when(a >= b, "+").otherwise("-")).otherwise(
            F.when(richer, "+").otherwise("-"))
    out["strand_locus"] = F.when(seq.count_of(s, "G") >= seq.count_of(r, "G"), "+").otherwise("-")
    return df.withColumns(out).drop("_G4f", "_G4r", "_iMf", "_iMr")


def _route_sql(k, base):
    f, r = d.mcount("s", k), d.mcount("rc", k)
    return (f"CASE WHEN {f} > 0 OR {r} > 0 THEN CASE WHEN {f} >= {r} THEN '+' ELSE '-' END "
            f"WHEN {d.count('s', base)} >= {d.count('rc', base)} THEN '+' ELSE '-' END")


@query("seq5_strand_routing", "seqs", f"""
x AS (SELECT seq_id, s, {d.revcomp('s')} AS rc FROM seqs)
SELECT seq_id, {_route_sql('G4', 'G')} AS strand_g4, {_route_sql('iM', 'C')} AS strand_im,
       CASE WHEN {d.count('s', 'G')} >= {d.count('s', 'C')} THEN '+' ELSE '-' END AS strand_locus FROM x""")
def seq5(t):
    return route(t.seqs).select("seq_id", F.col("strand_G4").alias("strand_g4"),
                                F.col("strand_iM").alias("strand_im"), "strand_locus")


@query("seq6_polymer_gate", "oligos", f"""
SELECT seq_id, CASE WHEN seq_id % 7 = 0 THEN 'polymer_rna' WHEN upper({RAW}) LIKE '%U%' THEN 'sequence_has_u' END AS reason,
       NOT (seq_id % 7 = 0 OR upper({RAW}) LIKE '%U%') AS accepted FROM oligos""")
def seq6(t):
    polymer = F.when(F.col("seq_id") % 7 == 0, "rna").otherwise("dna")
    reason = F.when(F.upper(polymer) == "RNA", "polymer_rna").when(
        F.upper(F.expr(RAW)).contains("U"), "sequence_has_u")
    return t.oligos.select("seq_id", reason.alias("reason"), reason.isNull().alias("accepted"))


@query("seq7_molecule_keys", "oligos", """
x AS (SELECT seq_id, regexp_replace(upper(CASE WHEN seq_id % 3 = 0 THEN replace(o, 'T', 'U')
             WHEN seq_id % 3 = 1 THEN replace(o, 'GA', 'g a') ELSE replace(o, 'TA', 'XA') END), '\\s+', '', 'g') AS v FROM oligos)
SELECT seq_id, CASE WHEN regexp_matches(replace(v, 'U', 'T'), '^[ACGT]+$') THEN replace(v, 'U', 'T') END AS dna_key,
       CASE WHEN regexp_matches(v, '^[ACGU]+$') THEN v END AS rna_key FROM x""")
def seq7(t):
    m = F.col("seq_id") % 3
    raw = (F.when(m == 0, F.replace("o", F.lit("T"), F.lit("U")))
           .when(m == 1, F.replace("o", F.lit("GA"), F.lit("g a"))).otherwise(F.replace("o", F.lit("TA"), F.lit("XA"))))
    return t.oligos.select("seq_id", seq.dna_key(raw).alias("dna_key"), seq.rna_key(raw).alias("rna_key"))


# ---------------------------------------------------------------- conditions
def _partial(t):
    """Conditions as reported: some fields absent."""
    gone = lambda f, m: F.when(F.col("pk") % m != 0, F.col(f)).alias(f)
    return t.records.select(
        "seq_id", "ln", "pk", gone("k", 3), gone("na", 4), F.lit(None).cast("double").alias("li_nh4"), gone("mg", 6), "ph",
        "temperature", gone("crowder_pct", 2), "strand_conc")


_PARTIAL = """x AS (SELECT seq_id, ln, pk, CASE WHEN pk % 3 <> 0 THEN k END AS k, CASE WHEN pk % 4 <> 0 THEN na END AS na,
       cast(NULL AS double) AS li_nh4, CASE WHEN pk % 6 <> 0 THEN mg END AS mg, ph, temperature,
       CASE WHEN pk % 2 <> 0 THEN crowder_pct END AS crowder_pct, strand_conc FROM records)"""


@query("cnd1_condition_from_partial", "records", _PARTIAL + """
SELECT seq_id, ln, pk, """ + ", ".join(f"coalesce({f}, {v}) AS {f}" for f, v in condition.DEFAULTS.items()) + """,
       concat_ws(',', """ + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in condition.FIELDS) + """) AS imputed
FROM x""")
def cnd1(t):
    return _partial(t).withColumn("imputed", F.array_join(condition.imputed(), ",")).withColumns(condition.filled())


@query("cnd2_presets", "oligos", """
p(preset, k, na, li_nh4, mg, ph, temperature, crowder_pct, strand_conc) AS (VALUES """ + ", ".join(
    "('%s', %s)" % (n, ", ".join(f"cast({p.get(f, v)} AS double)" for f, v in condition.DEFAULTS.items()))
    for n, p in condition.PRESETS.items()) + """),
x AS (SELECT seq_id, CASE seq_id % 3 WHEN 0 THEN 'physiological' WHEN 1 THEN 'na100' ELSE 'im_reference' END AS preset,
             CASE WHEN seq_id % 5 = 0 THEN 6.25 END AS ph_override FROM oligos)
SELECT seq_id, x.preset, k, na, li_nh4, mg, cast(coalesce(ph_override, ph) AS double) AS ph, temperature, crowder_pct,
       strand_conc FROM x JOIN p ON x.preset = p.preset""")
def cnd2(t):
    m = F.col("seq_id") % 3
    asked = t.oligos.select(
        "seq_id", F.when(m == 0, "physiological").when(m == 1, "na100").otherwise("im_reference").alias("preset"),
        F.when(F.col("seq_id") % 5 == 0, F.lit(6.25)).alias("ph_override"))
    return (asked.join(F.broadcast(condition.presets_frame(t.spark)), "preset")  # ten fixed rows
            .withColumn("ph", F.coalesce("ph_override", "ph")).drop("ph_override"))


@query("cnd3_derived_ions", "records", """
SELECT seq_id, ln, pk, k + na + li_nh4 AS monovalent, k + na + li_nh4 + 3 * mg AS ionic_strength,
       CASE WHEN k + na + li_nh4 > 0 THEN round(k / (k + na + li_nh4), 6) ELSE 0 END AS k_fraction,
       round(k + 0.35 * na, 6) AS competent FROM records""")
def cnd3(t):
    return t.records.select("seq_id", "ln", "pk", condition.monovalent().alias("monovalent"),
                            condition.ionic_strength().alias("ionic_strength"),
                            r6(condition.k_fraction()).alias("k_fraction"),
                            r6(condition.competent_cation()).alias("competent"))


@query("cnd4_condition_label", "records", """
x AS (SELECT seq_id, ln, pk, cast(k AS bigint) AS k, cast(na AS bigint) AS na, cast(mg AS bigint) AS mg,
             coalesce(ph, 7) AS ph FROM records)
SELECT seq_id, ln, pk, concat('K', k, ' Na', na, CASE WHEN mg <> 0 THEN concat(' Mg', mg) ELSE '' END,
       ' pH', CASE WHEN ph = floor(ph) THEN cast(cast(ph AS bigint) AS varchar) ELSE cast(ph AS varchar) END, ' 25C') AS label FROM x""")
def cnd4(t):
    return (t.records.withColumn("ph", F.coalesce("ph", F.lit(7.0)))
            .select("seq_id", "ln", "pk", condition.label().alias("label")))


_NEAR = {"k": 140.0, "na": 12.0, "li_nh4": 0.0, "mg": 1.0, "ph": 7.4, "temperature": 37.0, "crowder_pct": 0.0}


@query("cnd5_condition_distance", "records", "SELECT seq_id, ln, pk, round(sqrt(" + " + ".join(
    f"power((coalesce({f}, 7) - {v}) / {condition.STEP[f]}, 2)" for f, v in _NEAR.items()) + "), 6) AS dist FROM records")
def cnd5(t):
    here = {f: F.coalesce(F.col(f), F.lit(7.0)) for f in _NEAR}
    return t.records.select("seq_id", "ln", "pk", r6(condition.distance(
        here, {f: F.lit(v) for f, v in _NEAR.items()})).alias("dist"))


# ------------------------------------------------------------------- thermo
@query("thm1_folded_at_temperature", "records", f"""
SELECT seq_id, ln, pk, tm, CASE WHEN tm IS NOT NULL THEN round(1 / (1 + exp(-greatest(least({thermo.DH_G4 / thermo.R!r} * (1 / (37 + 273.15::double) - 1 / (tm + 273.15::double)), 60), -60))), 6) END AS theta
FROM records""")
def thm1(t):
    return t.records.select("seq_id", "ln", "pk", "tm", r6(thermo.folded_at_temperature(F.lit(37.0), F.col("tm"))).alias("theta"))


@query("thm2_folded_at_ph", "records", """
SELECT seq_id, ln, pk, ph_t, CASE WHEN ph_t IS NOT NULL THEN round(1 / (1 + power(10, greatest(least(2.5::double * (coalesce(ph, 7) - ph_t), 30), -30))), 6) END AS theta FROM records""")
def thm2(t):
    return t.records.select("seq_id", "ln", "pk", "ph_t", r6(thermo.folded_at_ph(F.coalesce("ph", F.lit(7.0)), F.col("ph_t"))).alias("theta"))


@query("thm3_tm_shift", "records", """
SELECT seq_id, ln, pk, CASE WHEN k > 0 THEN round(tm + 12::double * log10(k / 50::double), 6) END AS tm_at_k FROM records""")
def thm3(t):
    return t.records.select("seq_id", "ln", "pk", r6(thermo.tm_at_cation(F.col("tm"), F.lit(50.0), F.col("k"))).alias("tm_at_k"))


@query("thm4_free_energy", "records", """
x AS (SELECT *, greatest(least(1 / (1 + power(10, greatest(least(2.5::double * (coalesce(ph, 7) - ph_t), 30), -30))), 1 - 1e-6), 1e-6) AS th FROM records)
SELECT seq_id, ln, pk, round(-45::double * (1 - 310.15::double / (tm + 273.15::double)), 6) AS dg_tm,
       CASE WHEN ph_t IS NOT NULL THEN round(-0.001987204::double * 310.15::double * ln(th / (1 - th)), 6) END AS dg_ph FROM x""".replace("seq_id, ln, pk", "seq_id, x.ln, pk"))
def thm4(t):
    return t.records.select("seq_id", "ln", "pk", r6(thermo.dg_from_tm(F.col("tm"), F.lit(37.0))).alias("dg_tm"),
                            r6(thermo.dg_from_ph_t(F.col("ph_t"), F.coalesce("ph", F.lit(7.0)))).alias("dg_ph"))


@query("thm5_heuristic_energy", "records", f"""
x AS (SELECT seq_id, ln, pk, k + na + li_nh4 AS mono, mg, crowder_pct AS cr, temperature AS tc, coalesce(ph, 7) AS ph,
       len(regexp_extract_all(sequence, 'G{{2,}}')) AS ng, coalesce(list_max(list_transform(regexp_extract_all(sequence, 'G{{2,}}'), lambda r: length(r))), 0) AS mg_,
       len(regexp_extract_all(sequence, 'C{{2,}}')) AS nc, coalesce(list_max(list_transform(regexp_extract_all(sequence, 'C{{2,}}'), lambda r: length(r))), 0) AS mc,
       coalesce(list_sum(list_transform(list_filter(string_split_regex(sequence, 'G{{2,}}'), lambda g: length(g) > 0), lambda g: length(g) - 1)), 0) AS ex
     FROM records)
SELECT seq_id, x.ln, pk,
  round(cast(CASE WHEN ng >= 4 AND mg_ >= 2 THEN -2.4::double * least(4, greatest(2, mg_)) * least(ng, 4) + 0.35::double * ex ELSE 8 END
        - 1.15::double * log10(greatest(mono, 1) / 20) - 0.22::double * least(mg, 10) - 0.028::double * cr + 0.048::double * (tc - 37) AS double), 5) AS g4_energy,
  round(cast(CASE WHEN nc >= 4 THEN -1.7::double * mc * least(nc, 4) WHEN nc >= 2 THEN 2.5::double - 0.6::double * nc * mc ELSE 9 END
        + (1 - 1 / (1 + power(10, ph - 4.7::double))) * 9.5::double - 0.35::double * least(mg, 12)
        - 0.04::double * cr / (1 + power(10, ph - 4.7::double)) + 0.06::double * (tc - 37) AS double), 5) AS im_energy
FROM x""")
def thm5(t):
    c = F.col
    ph = F.coalesce("ph", F.lit(7.0))
    return t.records.select(
        "seq_id", "ln", "pk",
        F.round(thermo.g4_energy(c("sequence"), condition.monovalent(), c("mg"), c("crowder_pct"), c("temperature")), 5).alias("g4_energy"),
        F.round(thermo.im_energy(c("sequence"), ph, c("mg"), c("crowder_pct"), c("temperature")), 5).alias("im_energy"))


# ----------------------------------------------------------------- variants
@query("var1_norm_chrom", "snvs", """
SELECT pos, ref, alt, concat('chr', regexp_replace(CASE WHEN pos % 3 = 0 THEN upper(chrom) WHEN pos % 3 = 1 THEN substr(chrom, 4) ELSE chrom END, '(?i)^chr', '')) AS chrom FROM snvs""")
def var1(t):
    m = F.col("pos") % 3
    spelled = F.when(m == 0, F.upper("chrom")).when(m == 1, F.substring("chrom", 4, 9)).otherwise(F.col("chrom"))
    return t.snvs.select("pos", "ref", "alt", variant.norm_chrom(spelled).alias("chrom"))


@query("var2_variant_label", "snvs", "SELECT concat(chrom, ':', pos, ref, '>', alt) AS label, count(*) AS n FROM snvs GROUP BY ALL")
def var2(t):
    return t.snvs.groupBy(variant.hgvs_like(*map(F.col, variant.KEY)).alias("label")).agg(F.count("*").alias("n"))


@query("var3_substitution_type", "snvs", """
SELECT subst, count(*) AS n FROM (SELECT CASE WHEN ref IN ('G', 'A') THEN concat(translate(ref, 'ACGT', 'TGCA'), '>', translate(alt, 'ACGT', 'TGCA'))
       ELSE concat(ref, '>', alt) END AS subst FROM snvs) GROUP BY subst""")
def var3(t):
    return t.snvs.groupBy(variant.subst_type(F.col("ref"), F.col("alt")).alias("subst")).agg(F.count("*").alias("n"))


@query("var5_effect_class", "snvs", """
SELECT kind, cls, count(*) AS n FROM (
  SELECT kind, CASE WHEN state = 'motif_lost' THEN 'motif_lost' WHEN delta <= -hi THEN 'destabilising' WHEN delta <= -lo THEN 'moderate'
         WHEN abs(delta) < lo THEN 'neutral' WHEN delta >= lo THEN 'stabilising' ELSE 'other' END AS cls
  FROM (SELECT *, CASE WHEN kind = 'G4' THEN 2.0 ELSE 0.1 END AS lo, CASE WHEN kind = 'G4' THEN 5.0 ELSE 0.3 END AS hi FROM snvs))
GROUP BY ALL""")
def var5(t):
    cls = variant.effect_class(F.col("state"), F.col("delta"), F.col("kind"))
    return t.snvs.groupBy("kind", cls.alias("cls")).agg(F.count("*").alias("n"))


_POOL = """CASE WHEN pk % 5 = 0 THEN concat('stG4_Pool_ns_P', {a}, '_1mut_', {b}) WHEN pk % 5 = 1 THEN concat('stG4_Pool_ns_P', {a})
  WHEN pk % 5 = 2 THEN concat('stG4_Pool_GLV_', {b}) WHEN pk % 5 = 3 THEN concat('stG4_Pool_neg_AAA_', {b}) ELSE concat('other_', {b}) END"""
_POOL_CLASS = "CASE WHEN pk % 10 = 3 THEN 'neg_AAA' WHEN pk % 10 = 4 THEN 'pUG' ELSE 'ns' END"


def pool(text):
    return _POOL.format(a=f"cast(sk AS {text})", b=f"cast(pk AS {text})")


@query("var7_scaffold", "records", f"""
x AS (SELECT {pool('varchar')} AS pool_id, {_POOL_CLASS} AS pool_class FROM records),
y AS (SELECT CASE WHEN regexp_matches(pool_id, '^stG4_Pool_ns_([A-Za-z0-9]+)_(1mut|AAAmut)_[0-9]+$') OR regexp_matches(pool_id, '^stG4_Pool_ns_[A-Za-z0-9]+$')
         THEN concat('parent:', split_part(pool_id, '_', 4))
       WHEN starts_with(pool_id, 'stG4_Pool_GLV') THEN concat('synthetic:', pool_id)
       WHEN pool_class IN ('neg_AAA', 'pUG') OR starts_with(pool_id, 'stG4_Pool_neg_AAA') THEN concat('control:', pool_class, ':', pool_id)
       ELSE 'UNASSIGNED' END AS scaffold,
     CASE WHEN contains(pool_id, '_1mut_') THEN 'mutant_of_parent (1mut)' WHEN starts_with(pool_id, 'stG4_Pool_ns_') THEN 'parent_wildtype'
       WHEN starts_with(pool_id, 'stG4_Pool_GLV') THEN 'synthetic_combinatorial_no_parent'
       WHEN pool_class IN ('neg_AAA', 'pUG') OR starts_with(pool_id, 'stG4_Pool_neg_AAA') THEN concat('control_', pool_class)
       ELSE 'no rule matched' END AS basis FROM x)
SELECT scaffold, basis, count(*) AS n FROM y GROUP BY ALL""")
def var7(t):
    df = t.records.select(F.expr(pool("string")).alias("pool_id"), F.expr(_POOL_CLASS).alias("pool_class"))
    key, basis = seq.scaffold(F.col("pool_id"), F.col("pool_class"))
    return df.groupBy(key.alias("scaffold"), basis.alias("basis")).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- features
@query("fea1_base_scores", "seqs", f"SELECT seq_id, array_to_string({d.scores('s')}, ',') AS scores FROM seqs")
def fea1(t):
    return t.seqs.select("seq_id", F.array_join(seq.hunter_scores("s").cast("array<string>"), ",").alias("scores"))


@query("fea2_hunter_mean", "seqs", f"SELECT seq_id, round({d.hunter_mean('s')}, 6) AS g4h FROM seqs")
def fea2(t):
    return t.seqs.select("seq_id", r6(seq.hunter_mean("s")).alias("g4h"))


@query("fea3_hunter_window_max", "seqs", f"""
SELECT seq_id, round(list_max(list_transform({d.window_means('s')}, lambda v: abs(v))), 6) AS g4h_max FROM {d.scored('seqs', 's')}""")
def fea3(t):
    df = seq.with_window_means(t.seqs, "s", "_means")
    return df.select("seq_id", r6(F.array_max(F.transform("_means", lambda v: F.abs(v)))).alias("g4h_max"))


@query("fea4_tract_parse", "seqs", """
x AS (SELECT seq_id, regexp_extract_all(s, 'G{3,}') AS r, string_split_regex(s, 'G{3,}') AS g FROM seqs),
y AS (SELECT *, CASE WHEN len(r) >= 4 THEN coalesce(list_filter(range(1, len(r) - 2), lambda i:
        length(g[i+1]) BETWEEN 1 AND 12 AND length(g[i+2]) BETWEEN 1 AND 12 AND length(g[i+3]) BETWEEN 1 AND 12)[1], 1) END AS a FROM x)
SELECT seq_id, concat_ws(',', length(r[a]), length(r[a+1]), length(r[a+2]), length(r[a+3])) AS tracts,
       concat_ws(',', length(g[a+1]), length(g[a+2]), length(g[a+3])) AS loops FROM y WHERE a IS NOT NULL""")
def fea4(t):
    df = motif.with_tract_parts(t.seqs, "s", "G").where("_at IS NOT NULL")
    n = lambda c, i: F.length(F.get(c, F.col("_at") + i)).cast("string")
    return df.select("seq_id", F.concat_ws(",", *[n("_r", i) for i in range(4)]).alias("tracts"),
                     F.concat_ws(",", *[n("_g", i + 1) for i in range(3)]).alias("loops"))


def _base_sql(view, col, kind):
    b = motif.BASE[kind]
    c = lambda x, l: f"cast({d.count(x, l)} AS double)"
    e = " + ".join(f"CASE WHEN {c(col, x)} > 0 THEN -{c(col, x)} / length({col}) * log2({c(col, x)} / length({col})) ELSE 0 END" for x in "ACGT")
    nr = lambda x: f"cast(len(regexp_extract_all({col}, '{x}{{2,}}')) AS double)"
    one = f"len(regexp_extract_all({col}, '{b}+'))"
    v = {
        "length": f"cast(length({col}) AS double)", "log_length": f"ln(length({col}))",
        "gc": f"({c(col, 'G')} + {c(col, 'C')}) / length({col})",
        **{f"frac_{x}": f"{c(col, x)} / length({col})" for x in "ACGT"},
        "purine_frac": f"({c(col, 'A')} + {c(col, 'G')}) / length({col})",
        "g4h_mean": d.hunter_mean(col), "g4h_absmean": f"abs({d.hunter_mean(col)})",
        "g4h_win_max": f"list_max(list_transform({d.window_means(col)}, lambda z: abs(z)))",
        "n_runs": nr(b), "max_run": f"cast({d.longest(col, b)} AS double)",
        "mean_run": f"CASE WHEN {one} > 0 THEN {c(col, b)} / {one} ELSE 0 END",
        "n_Gruns": nr("G"), "max_Grun": f"cast({d.longest(col, 'G')} AS double)",
        "n_Cruns": nr("C"), "max_Crun": f"cast({d.longest(col, 'C')} AS double)",
        "longest_homopolymer": f"cast(greatest({', '.join(d.longest(col, x) for x in 'ACGT')}) AS double)",
        "shannon_entropy": e,
    }
    arch = {
        "has_4tracts": "cast(a IS NOT NULL AS double)", "tract_len_min": "least(t0, t1, t2, t3)",
        "tract_len_max": "greatest(t0, t1, t2, t3)", "tract_len_mean": "(t0 + t1 + t2 + t3) / 4",
        "loop1": "l0", "loop2": "l1", "loop3": "l2", "loop_total": "l0 + l1 + l2", "loop_mean": "(l0 + l1 + l2) / 3",
        "loop_sd": "stdp", "loop_min": "least(l0, l1, l2)", "loop_max": "greatest(l0, l1, l2)",
        "loop_asymmetry": "abs(l0 - l2) / greatest(l0 + l2, 1)",
        "core_span": "CASE WHEN a IS NULL THEN n ELSE t0 + t1 + t2 + t3 + l0 + l1 + l2 END",
        "flank_len": "CASE WHEN a IS NULL THEN 0 ELSE n - (t0 + t1 + t2 + t3 + l0 + l1 + l2) END",
        "loop_gc": f"({c('lp', 'G')} + {c('lp', 'C')}) / greatest(length(lp), 1)",
        "loop_frac_T": f"{c('lp', 'T')} / greatest(length(lp), 1)", "loop_frac_A": f"{c('lp', 'A')} / greatest(length(lp), 1)",
        "n_bulges": "cast((t0 > least(t0, t1, t2, t3))::int + (t1 > least(t0, t1, t2, t3))::int + (t2 > least(t0, t1, t2, t3))::int + (t3 > least(t0, t1, t2, t3))::int AS double)",
    }
    pat = f"{b}{{3,}}"
    fit = " AND ".join(f"length(g[i+{j}]) BETWEEN 1 AND 12" for j in (1, 2, 3))
    body = f"""
x AS (SELECT seq_id, {', '.join(f'{e_} AS {k}' for k, e_ in v.items())}, length({col}) AS n,
             regexp_extract_all({col}, '{pat}') AS r, string_split_regex({col}, '{pat}') AS g FROM {d.scored(view, col)}),
y AS (SELECT *, CASE WHEN len(r) >= 4 THEN coalesce(list_filter(range(1, len(r) - 2), lambda i: {fit})[1], 1) END AS a FROM x),
z AS (SELECT *, {', '.join(f'cast(coalesce(length(r[a+{i}]), 0) AS double) AS t{i}' for i in range(4))},
             {', '.join(f'cast(coalesce(length(g[a+{i + 1}]), 0) AS double) AS l{i}' for i in range(3))},
             CASE WHEN a IS NULL THEN '' ELSE concat(g[a+1], g[a+2], g[a+3]) END AS lp FROM y),
w AS (SELECT *, sqrt(((l0*l0 + l1*l1 + l2*l2) / 3) - power((l0 + l1 + l2) / 3, 2)) AS stdp FROM z)
SELECT seq_id, {', '.join(f'round({k}, 5) AS {k}' for k in v)}, {', '.join(f'round(cast({e_} AS double), 5) AS {k}' for k, e_ in arch.items())} FROM w"""
    return body


@query("fea5_base_features", "seqs", _base_sql("seqs", "s", "G4"))
def fea5(t):
    df = features.with_sequence_features(t.seqs, "s", "G4", with_kmers=False)
    return df.select("seq_id", *[F.round(c, 5).alias(c) for c in features.NAMED])


@query("fea5_base_features_im", "oligos", _base_sql("oligos", "o", "iM"))
def fea5_im(t):
    df = features.with_sequence_features(t.oligos, "o", "iM", with_kmers=False)
    return df.select("seq_id", *[F.round(c, 5).alias(c) for c in features.NAMED])


@query("fea6_kmer_frequencies", "seqs", "x AS (SELECT seq_id, s, " + ", ".join(
    f"list_transform(range(1, length(s) - {k - 2}), lambda i: substr(s, i, {k})) AS m{k}" for k in (1, 2, 3)) + " FROM seqs) SELECT seq_id, " + ", ".join(
    f"round(cast(len(list_filter(m{len(m)}, lambda v: v = '{m}')) AS double) / len(m{len(m)}), 6) AS k{len(m)}_{m}" for m in features.KMERS) + " FROM x")
def fea6(t):
    return t.seqs.select("seq_id", *[r6(e).alias(n) for n, e in features.kmer_columns("s").items()])


_CF = {
    "log1p_k": "ln(1 + k)", "log1p_mg": "ln(1 + mg)", "monovalent": "k + na + li_nh4", "log1p_ionic_strength": "ln(1 + k + na + li_nh4 + 3 * mg)",
    "k_fraction": "CASE WHEN k + na + li_nh4 > 0 THEN k / (k + na + li_nh4) ELSE 0 END", "g4_competent_cation": "k + 0.35::double * na",
    "log1p_g4_competent": "ln(1 + k + 0.35::double * na)", "ph_minus_7": "ph - 7", "pka_minus_ph": "4.6::double - ph",
    "protonation_frac": "1 / (1 + power(10, ph - 4.6::double))", "log_strand_conc": "ln(1 + strand_conc)",
    "has_crowder": "cast(crowder_pct > 0 AS double)", "no_supporting_cation": "cast(k + 0.35::double * na < 1 AS double)"}


@query("fea7_condition_features", "records", "SELECT seq_id, ln AS line, pk, " + ", ".join(
    f"round(cast({e} AS double), 6) AS {n}" for n, e in _CF.items()).replace("ln(", "ln(") + " FROM records")
def fea7(t):
    cols = features.condition_columns()
    return t.records.select("seq_id", F.col("ln").alias("line"), "pk", *[r6(cols[n]).alias(n) for n in _CF])


_IX = {
    "gtracts_x_logK": "ng * ln(1 + k)", "gc_x_logIonic": "gc * ln(1 + k + na + li_nh4 + 3 * mg)", "len_x_logK": "32 * ln(1 + k)",
    "ctracts_x_protonation": "nc * pr", "cfrac_x_protonation": "fc * pr", "gc_x_temp": "gc * temperature / 100",
    "g4h_x_logKcompetent": "gh * ln(1 + k + 0.35::double * na)"}


@query("fea8_interactions", "records", f"""
x AS (SELECT *, len(regexp_extract_all(sequence, 'G{{2,}}')) AS ng, len(regexp_extract_all(sequence, 'C{{2,}}')) AS nc,
      ({d.count('sequence', 'G')} + {d.count('sequence', 'C')}) / 32 AS gc, {d.count('sequence', 'C')} / 32 AS fc,
      1 / (1 + power(10, ph - 4.6::double)) AS pr, {d.hunter_mean('sequence')} AS gh FROM records)
SELECT seq_id, x.ln AS line, pk, """ + ", ".join(f"round(cast({e} AS double), 6) AS {n}" for n, e in _IX.items()) + " FROM x")
def fea8(t):
    df, _ = features.featurize(t.records, "sequence", "G4", True, with_kmers=False)
    return df.select("seq_id", F.col("ln").alias("line"), "pk", *[r6(F.col(n)).alias(n) for n in _IX])


@query("fea9_locus_features", "seqs", _base_sql("seqs", "s", "iM").replace("SELECT seq_id, round(length, 5) AS length", "SELECT seq_id, round(length, 5) AS length"))
def fea9(t):
    df = features.with_sequence_features(t.seqs, "s", "locus", with_kmers=False)
    # the C-tract half of the locus vector must equal the iM vector
    own = {"n_runs": "n_Cruns", "max_run": "max_Crun", "mean_run": "im_mean_Crun"} | {a: "im_" + a for a in features.ARCHITECTURE}
    return df.select("seq_id", *[F.round(own.get(c, c), 5).alias(c) for c in features.NAMED])


@query("fea10_design_matrix", "records", """
SELECT kind, count(*) AS n_rows, cast(123 + 27 + 10 AS bigint) AS n_features, cast(123 AS bigint) AS n_features_ablated, cast(0 AS bigint) AS n_null
FROM records GROUP BY kind""")
def fea10(t):
    df = t.records.withColumn("ph", F.coalesce("ph", F.lit(7.0)))  # rows without a pH take the default
    out = None
    for kind in ("G4", "iM"):
        x, names = features.featurize(df.where(F.col("kind") == kind), "sequence", kind)
        short = features.sequence_feature_names(kind)
        part = x.groupBy("kind").agg(
            F.count("*").alias("n_rows"), F.lit(len(names)).cast("bigint").alias("n_features"),
            F.lit(len(short)).cast("bigint").alias("n_features_ablated"),
            F.sum(sum((F.col(n).isNull().cast("bigint") for n in names[1:]), F.col(names[0]).isNull().cast("bigint"))).alias("n_null"))
        out = part if out is None else out.unionByName(part)
    return out


def _ov(x, tract, loop):
    p = d.tract("G", tract, loop, "[A-Z]")
    return f"len(list_filter(range(1, length({x}) + 1), lambda i: regexp_matches(substr({x}, i), '^{p}')))"


def _stats_sql(x):
    return f"""round(list_max({d.window_means(x)}), 6) AS win_max, round(list_min({d.window_means(x)}), 6) AS win_min,
  cast({_ov(x, '{3,}', 7)} AS bigint) AS n_g3, cast({_ov(x, '{3,}', 12)} AS bigint) AS n_g3l, cast({_ov(x, '{2,}', 7)} AS bigint) AS n_g2,
  cast(len(regexp_extract_all({x}, 'G{{3,}}')) AS bigint) AS n_runs, cast(coalesce(list_sum(list_transform(regexp_extract_all({x}, 'G{{3,}}'), lambda r: length(r))), 0) AS bigint) AS run_nt,
  round(cast(len(list_filter({d.window_means(x)}, lambda v: v >= 1.2)) AS double) / len({d.window_means(x)}), 6) AS frac_hi"""


def _stats(w):
    big = lambda n: w[n].cast("bigint")
    return [r6(w["g4h_win_max25"]).alias("win_max"), r6(w["g4h_win_min25"]).alias("win_min"),
            big("n_g3_canonical").alias("n_g3"), big("n_g3_longloop").alias("n_g3l"), big("n_g2_relaxed").alias("n_g2"),
            big("n_g3_runs").alias("n_runs"), big("total_g3_run_nt").alias("run_nt"), r6(w["frac_windows_ge_1p2"]).alias("frac_hi")]


@query("fea11_window_stats", "seqs", f"SELECT seq_id, {_stats_sql('s')} FROM {d.scored('seqs', 's')}")
def fea11(t):
    df = features.with_window_stats(t.seqs, "s")
    return df.select("seq_id", *_stats({n: F.col(n) for n in features.WINDOW_STATS}))


def _side_sql(name, col):
    """The 133 values of one strand of a window, by the oracle's own expressions."""
    kmers = ", ".join(f"list_transform(range(1, length({col}) - {k - 2}), lambda i: substr({col}, i, {k})) AS m{k}" for k in (1, 2, 3))
    values = ", ".join(f"round(cast(len(list_filter(m{len(m)}, lambda v: v = '{m}')) AS double) / len(m{len(m)}), 5) AS k{len(m)}_{m}" for m in features.KMERS)
    w = d.window_means(col)
    runs = f"list_transform(regexp_extract_all({col}, 'G{{3,}}'), lambda r: length(r))"
    stats = {
        "g4h_win_max25": f"list_max({w})", "g4h_win_min25": f"list_min({w})", "g4h_mean_all": d.hunter_mean(col),
        "n_g3_canonical": _ov(col, "{3,}", 7), "n_g3_longloop": _ov(col, "{3,}", 12), "n_g2_relaxed": _ov(col, "{2,}", 7),
        "n_g3_runs": f"len({runs})", "max_g_run": f"coalesce(list_max({runs}), 0)", "total_g3_run_nt": f"coalesce(list_sum({runs}), 0)",
        "frac_windows_ge_1p2": f"cast(len(list_filter({w}, lambda v: v >= 1.2)) AS double) / len({w})"}
    return f"""{name}b_ AS (WITH {_base_sql(f"{name}_", col, "G4")}),
{name}k_ AS (SELECT seq_id, {values} FROM (SELECT seq_id, {kmers} FROM {name}_)),
{name}s_ AS (SELECT seq_id, {", ".join(f"round(cast({e} AS double), 5) AS {n}" for n, e in stats.items())} FROM {d.scored(f"{name}_", col)})"""


_WINDOW_NAMES = features.NAMED + features.KMERS_NAMED + features.WINDOW_STATS


def _both_sides():
    """Columns of both strands, each under its side's name."""
    out = []
    for side, t in (("first", "fi"), ("second", "se")):
        for n in _WINDOW_NAMES:
            table = f"{t}k_" if n in features.KMERS_NAMED else f"{t}s_" if n in features.WINDOW_STATS else f"{t}b_"
            out.append(f"{table}.{n} AS {side}_{n}")
    return ", ".join(out)


@query("fea12_strand_symmetric", "seqs", f"""
fi_ AS (SELECT seq_id, CASE WHEN {d.hunter_sum('s')} >= 0 THEN s ELSE {d.revcomp('s')} END AS s FROM seqs),
se_ AS (SELECT seq_id, CASE WHEN {d.hunter_sum('s')} >= 0 THEN {d.revcomp('s')} ELSE s END AS s FROM seqs),
{_side_sql("fi", "s")},
{_side_sql("se", "s")}
SELECT fib_.seq_id, {_both_sides()} FROM fib_ JOIN fik_ USING (seq_id) JOIN fis_ USING (seq_id) JOIN seb_ USING (seq_id) JOIN sek_ USING (seq_id) JOIN ses_ USING (seq_id)""")
def fea12(t):
    """The whole window vector: 133 values of the G-richer strand and 133 of the other."""
    return features.with_window_features(t.seqs, "s").select("seq_id", *[F.round(n, 5).alias(n) for n in features.window_feature_names()])


def window_strands(df, s):
    """The G-richer strand by run score first, the other second."""
    forward = seq.hunter_sum(s) >= 0
    return df.withColumns({"first": F.when(forward, F.col(s)).otherwise(seq.revcomp(s)),
                           "second": F.when(forward, seq.revcomp(s)).otherwise(F.col(s))})


@query("fea13_rule_scores", "oligos", f"""
SELECT seq_id, round({d.hunter_mean('o')}, 6) AS g4h_mean, round(list_max({d.window_means('o')}), 6) AS g4h_max, round(list_min({d.window_means('o')}), 6) AS g4h_min,
       cast({_ov('o', '{3,}', 7)} AS bigint) AS g4_hits, cast({_ov('o', '{2,}', 7)} AS bigint) AS g2_hits,
       round(({d.count('o', 'G')} + {d.count('o', 'C')}) / length(o), 6) AS gc FROM {d.scored('oligos', 'o')}""")
def fea13(t):
    s = F.col("o")
    df = seq.with_window_means(t.oligos, "o", "_means")
    hits = lambda tract: F.regexp_count(s, F.lit("(?=" + motif.tract_pattern("G", tract, 7, letter=r"\w") + ")")).cast("bigint")
    return df.select(
        "seq_id", r6(seq.hunter_mean(s)).alias("g4h_mean"), r6(F.array_max("_means")).alias("g4h_max"),
        r6(F.array_min("_means")).alias("g4h_min"), hits("{3,}").alias("g4_hits"), hits("{2,}").alias("g2_hits"),
        r6(seq.gc(s)).alias("gc"))


def unit_kmers(df, key, s, k):
    """Sparse L2-normalised k-mer profile: one row per (key, k-mer) with its weight."""
    counts = (df.select(*key, F.explode(seq.kmers(s, k)).alias("kmer")).where(~F.col("kmer").contains("N"))
              .groupBy(*key, "kmer").agg(F.count("*").alias("n")))
    norms = counts.groupBy(*key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(*key, "kmer", "n", (F.col("n") / F.col("norm")).alias("w"))


@query("fea15_unit_kmers", "oligos", """
x AS (SELECT seq_id, unnest(list_transform(range(1, length(o) - 1), lambda i: substr(o, i, 3))) AS kmer FROM oligos),
c AS (SELECT seq_id, kmer, count(*) AS n FROM x GROUP BY ALL)
SELECT seq_id, kmer, round(n / sqrt(sum(n * n) OVER (PARTITION BY seq_id)), 6) AS w FROM c""")
def fea15(t):
    return unit_kmers(t.oligos, ["seq_id"], "o", 3).select("seq_id", "kmer", r6(F.col("w")).alias("w"))
