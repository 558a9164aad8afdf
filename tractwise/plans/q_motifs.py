"""Motif search, windowing, screening and edit enumeration."""

from pyspark.sql import functions as F

from ..functions import motif, seq, variant
from ..operators import intervals, motifs
from ..session import cut_lineage
from . import duck as d
from .q_sequences import r6
from .registry import query


def _hits_sql(table, col, kinds):
    """Overlapping hits by position, then an explicit left-to-right pass."""
    pos = " UNION ALL ".join(
        f"SELECT seq_id, strand, '{k}' AS kind, n, i - 1 AS st, regexp_extract(substr(x, i, {d.SPAN[k]}), '^{d.PAT[k]}') AS txt "
        f"FROM (SELECT *, unnest(range(1, n - 13)) AS i FROM st_) WHERE substr(x, i, 3) = '{d.PAT[k][0] * 3}'" for k in kinds)
    return f"""
st_ AS (SELECT seq_id, '+' AS strand, {col} AS x, length({col}) AS n FROM {table}
        UNION ALL SELECT seq_id, '-', {d.revcomp(col)}, length({col}) FROM {table}),
h_ AS ({pos}),
o_ AS (SELECT *, row_number() OVER (PARTITION BY seq_id, strand, kind ORDER BY st) AS rn FROM h_ WHERE txt <> ''),
r_ AS (SELECT *, true AS keep, st + length(txt) AS last FROM o_ WHERE rn = 1
       UNION ALL SELECT o_.*, o_.st >= r_.last, CASE WHEN o_.st >= r_.last THEN o_.st + length(o_.txt) ELSE r_.last END
       FROM r_ JOIN o_ ON o_.seq_id = r_.seq_id AND o_.strand = r_.strand AND o_.kind = r_.kind AND o_.rn = r_.rn + 1),
hits AS (SELECT seq_id, kind, strand, CASE WHEN strand = '+' THEN st ELSE n - st - length(txt) END AS start_,
                CASE WHEN strand = '+' THEN st + length(txt) ELSE n - st END AS end_, txt AS text_,
                round(CASE WHEN kind = 'G4' THEN 1 ELSE -1 END * {d.hunter_mean('txt')}, 6) AS score FROM r_ WHERE keep)"""


def hits(t, kinds, view="seqs", col="s"):
    return motifs.find(getattr(t, view), ["seq_id"], col, kinds).withColumnsRenamed(
        {"start": "start_", "end": "end_", "text": "text_"}).withColumn("score", r6("score"))


@query("mot1_g4_motifs", "seqs", _hits_sql("seqs", "s", ["G4"]) + "SELECT * FROM hits")
def mot1(t):
    return hits(t, ["G4"])


@query("mot1_overlapping", "seqs", f"""
p AS (SELECT seq_id, i - 1 AS start_, regexp_extract(substr(s, i, 33), '^{d.PAT['G4']}') AS text_
      FROM (SELECT seq_id, s, unnest(range(1, length(s) - 13)) AS i FROM seqs) WHERE substr(s, i, 3) = 'GGG')
SELECT * FROM p WHERE text_ <> ''""")
def mot1_overlapping(t):
    return motifs.find(t.seqs, ["seq_id"], "s", ["G4"], False, True).select(
        "seq_id", F.col("start").alias("start_"), F.col("text").alias("text_"))


@query("mot1_hits_by_strand", "seqs", _hits_sql("seqs", "s", ["G4", "iM"]) + """
SELECT kind, strand, count(*) AS n_hits, count(DISTINCT seq_id) AS n_sequences, round(avg(score), 5) AS mean_score,
       cast(sum(end_ - start_) AS bigint) AS motif_nt FROM hits GROUP BY kind, strand""")
def mot1_by_strand(t):
    return hits(t, ["G4", "iM"]).groupBy("kind", "strand").agg(
        F.count("*").alias("n_hits"), F.countDistinct("seq_id").alias("n_sequences"),
        F.round(F.avg("score"), 5).alias("mean_score"), F.sum(F.col("end_") - F.col("start_")).alias("motif_nt"))


@query("mot2_im_motifs", "seqs", _hits_sql("seqs", "s", ["iM"]) + "SELECT * FROM hits")
def mot2(t):
    return hits(t, ["iM"])


@query("mot3_scan", "oligos", _hits_sql("oligos", "o", ["G4", "iM"]) + "SELECT * FROM hits ORDER BY seq_id, start_, kind")
def mot3(t):
    return hits(t, ["G4", "iM"], "oligos", "o").orderBy("seq_id", "start_", "kind")


_NODES = """
e_ AS (SELECT seq_id, s, unnest(range(0, length(s))) AS i FROM {v}),
f_ AS (SELECT * FROM e_ WHERE substr(s, i + 1, 1) = 'C' AND (i = 0 OR substr(s, i, 1) <> 'C')),
u_ AS (SELECT seq_id, s, i AS a, i + length(regexp_extract(substr(s, i + 1), '^C+')) AS b FROM f_),
w_ AS (SELECT seq_id, s, a, b, unnest(range(3, least(5, b - a) + 1)) AS w FROM u_ WHERE b - a >= 3),
n_ AS (SELECT DISTINCT seq_id, s, x, y FROM (SELECT seq_id, s, a AS x, a + w AS y FROM w_ UNION ALL SELECT seq_id, s, b - w, b FROM w_))"""


def _graph_sql(pick):
    cost = "3*(l1*l1+l2*l2+l3*l3) - (l1+l2+l3)*(l1+l2+l3)" if pick == "balanced" else "l1 + l3"
    return _NODES.format(v="seqs") + f""",
p_ AS (SELECT i.seq_id, i.s, i.x AS sx, i.y AS sy, m.y AS ey, j.x - i.y AS l1, k.x - j.y AS l2, m.x - k.y AS l3,
              least(i.y - i.x, j.y - j.x, k.y - k.x, m.y - m.x) AS tract,
              row_number() OVER (PARTITION BY i.seq_id, i.x, i.y ORDER BY j.x, j.y, k.x, k.y, m.x, m.y) AS ord
       FROM n_ i JOIN n_ j ON i.seq_id = j.seq_id AND j.x BETWEEN i.y + 1 AND i.y + 12
       JOIN n_ k ON k.seq_id = j.seq_id AND k.x BETWEEN j.y + 1 AND j.y + 12
       JOIN n_ m ON m.seq_id = k.seq_id AND m.x BETWEEN k.y + 1 AND k.y + 12),
c_ AS (SELECT *, {cost} AS cost FROM p_ WHERE ord <= 64),
b_ AS (SELECT * FROM c_ QUALIFY row_number() OVER (PARTITION BY seq_id, sx, sy ORDER BY cost, ord) = 1),
d_ AS (SELECT * FROM b_ QUALIFY row_number() OVER (PARTITION BY seq_id, sx, ey ORDER BY sy) = 1)
SELECT seq_id, sx AS start_, ey AS end_, l1, l2, l3, tract, substr(s, cast(sx + 1 AS bigint), cast(ey - sx AS bigint)) AS text_ FROM d_"""


@query("mot4_im_graph", "seqs", _graph_sql("balanced"))
def mot4(t):
    return motifs.find_paths(t.seqs, ["seq_id"], "s").withColumnsRenamed({"start": "start_", "end": "end_", "text": "text_"})


@query("mot4_im_graph_short_side", "seqs", _graph_sql("short_side"))
def mot4_short(t):
    return motifs.find_paths(t.seqs, ["seq_id"], "s", "short_side").withColumnsRenamed(
        {"start": "start_", "end": "end_", "text": "text_"})


def _genome_sql():
    parts = []
    for kind, base, loop in (("G4", "G", 7), ("iM", "C", 12)):
        for strand, x, zero in (("+", "ahead", "96 * piece"), ("-", d.revcomp("back"), "-96 * piece - 96")):
            parts.append(
                f"SELECT chrom, '{strand}' AS strand, '{kind}' AS kind, z + i - 1 AS st, regexp_extract(substr(x, i), '^{d.tract(base, '{3,}', loop)}') AS txt "
                f"FROM (SELECT chrom, {x} AS x, {zero} AS z, unnest(range(1, 97)) AS i FROM near_) WHERE substr(x, i, 3) = '{base * 3}'")
    return f"""
near_ AS (SELECT chrom, piece, concat(s, lead(s, 1, '') OVER w, lead(s, 2, '') OVER w, lead(s, 3, '') OVER w) AS ahead,
                 concat(lag(s, 3, '') OVER w, lag(s, 2, '') OVER w, lag(s, 1, '') OVER w, s) AS back
          FROM genome WINDOW w AS (PARTITION BY chrom ORDER BY piece)),
h_ AS ({' UNION ALL '.join(parts)}),
o_ AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand, kind ORDER BY st) AS rn FROM h_ WHERE txt <> '' AND length(txt) <= 60),
r_ AS (SELECT *, true AS keep, st + length(txt) AS last FROM o_ WHERE rn = 1
       UNION ALL SELECT o_.*, o_.st >= r_.last, CASE WHEN o_.st >= r_.last THEN o_.st + length(o_.txt) ELSE r_.last END
       FROM r_ JOIN o_ ON o_.chrom = r_.chrom AND o_.strand = r_.strand AND o_.kind = r_.kind AND o_.rn = r_.rn + 1),
gm AS (SELECT chrom, CASE WHEN strand = '+' THEN st ELSE -st - length(txt) END AS start_,
              CASE WHEN strand = '+' THEN st + length(txt) ELSE -st END AS end_, strand, kind, txt AS text_ FROM r_ WHERE keep)"""


def genome_motifs(t):
    return motifs.genome_hits(t.genome, 96).withColumnsRenamed({"start": "start_", "end": "end_", "text": "text_"})


@query("mot5_genome_motifs", "genome", _genome_sql() + "SELECT * FROM gm")
def mot5(t):
    return genome_motifs(t)


@query("mot6_motif_census", "oligos", f"""
SELECT seq_id, {d.mcount('o', 'G4')} AS g4_forward, {d.mcount(d.revcomp('o'), 'G4')} AS g4_reverse,
       {d.mcount('o', 'iM')} AS im_forward, {d.mcount(d.revcomp('o'), 'iM')} AS im_reverse FROM oligos""")
def mot6(t):
    r = seq.revcomp("o")
    return t.oligos.select("seq_id", motif.motif_count("o", "G4").alias("g4_forward"), motif.motif_count(r, "G4").alias("g4_reverse"),
                           motif.motif_count("o", "iM").alias("im_forward"), motif.motif_count(r, "iM").alias("im_reverse"))


# ----------------------------------------------------------------- windows
_CONTIGS = """contigs AS (SELECT chrom, piece - piece % 5 AS contig, string_agg(s, '' ORDER BY piece) AS x FROM genome GROUP BY ALL)"""


def contigs(t):
    """Five neighbouring pieces of the genome as one sequence."""
    parts = t.genome.groupBy("chrom", (F.col("piece") - F.col("piece") % 5).alias("contig")).agg(
        F.array_sort(F.collect_list(F.struct("piece", "s"))).alias("p"))
    return parts.select("chrom", "contig", F.array_join(F.transform("p", lambda v: v["s"]), "").alias("x"))


def windows(df, keys, s, width=124, step=25, close=False):
    """Fixed windows; `close` appends the last window when the step misses it."""
    last = F.greatest(F.lit(0), F.length(s) - width)
    starts = F.sequence(F.lit(0), last, F.lit(step))
    if close:
        starts = F.when(F.element_at(starts, -1) < last, F.concat(starts, F.array(last))).otherwise(starts)
    return df.select(*keys, s, F.explode(starts).alias("start")).select(
        *keys, F.col("start").cast("bigint").alias("start"),
        F.least(F.col("start") + width, F.length(s)).cast("bigint").alias("end"),
        F.substr(F.col(s), F.col("start") + 1, F.lit(width)).alias("window"))


_STARTS = """w_ AS (SELECT chrom, contig, x, unnest(range(0, greatest(0, length(x) - 124) + 1, 25)) AS st FROM contigs),
wl_ AS (SELECT * FROM w_ UNION SELECT chrom, contig, x, greatest(0, length(x) - 124) FROM contigs)"""


@query("win1_windows", "genome", _CONTIGS + "," + _STARTS + """
SELECT chrom, contig, st AS start_, least(st + 124, length(x)) AS end_, substr(x, st + 1, 124) AS window_ FROM w_""")
def win1(t):
    return windows(contigs(t), ["chrom", "contig"], "x").withColumnsRenamed({"start": "start_", "end": "end_", "window": "window_"})


# stands in for the trained window score: the run-score mean, whose sign is the strand
_REGIONS = _CONTIGS + "," + _STARTS + f""",
sc_ AS (SELECT chrom, contig, x, st, least(st + 124, length(x)) AS en, round(abs({d.hunter_mean('substr(x, st + 1, 124)')}), 6) AS sc FROM wl_),
hot_ AS (SELECT *, max(en) OVER (PARTITION BY chrom, contig ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sc_ WHERE sc >= 0.9),
isl_ AS (SELECT *, sum(CASE WHEN pe IS NULL OR st > pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, contig ORDER BY st) AS g FROM hot_),
reg_ AS (SELECT chrom, contig, min(st) AS start_, max(en) AS end_, max(sc) AS best_score, count(*) AS n_windows FROM isl_ GROUP BY chrom, contig, g)"""


def scored_regions(t, x=None):
    """Windows at or above the threshold, merged while they touch; x are the contigs where they are at hand."""
    w = windows(contigs(t) if x is None else x, ["chrom", "contig"], "x", close=True)
    w = w.withColumn("score", r6(F.abs(seq.hunter_mean("window")))).where("score >= 0.9")
    return intervals.merge(w, ["chrom", "contig"], "start", "end", tile=100_000, touching=True, aggs=[
        F.max("score").alias("best_score"), F.count("*").alias("n_windows")])


@query("win2_merged_regions", "genome", _REGIONS + "SELECT * FROM reg_")
def win2(t):
    return scored_regions(t).withColumnsRenamed({"start": "start_", "end": "end_"})


def rescued(t):
    """Strong motifs no region contains, in search order: forward hits first, then reverse hits outside those."""
    x = cut_lineage(contigs(t))  # put together once, for the motifs and for the regions
    strong = (motifs.find(x, ["chrom", "contig"], "x", ["G4"]).where(F.abs("score") >= 1.2)
              .select("chrom", "contig", "strand", "start", "end", "score"))
    free = cut_lineage(intervals.not_contained(strong, scored_regions(t, x), ["chrom", "contig"], bin_size=1_000))  # read per strand
    forward = free.where("strand = '+'")
    reverse = intervals.not_contained(free.where("strand = '-'"), forward, ["chrom", "contig"], bin_size=1_000)
    return forward.unionByName(reverse)


@query("win3_rescued_motifs", "genome", _REGIONS + "," + _hits_sql("cx_", "x", ["G4"]).replace(
    "st_ AS (SELECT", "cx_ AS (SELECT concat(chrom, ':', contig) AS seq_id, x FROM contigs),\nst_ AS (SELECT", 1) + """,
sr_ AS (SELECT split_part(seq_id, ':', 1) AS chrom, cast(split_part(seq_id, ':', 2) AS bigint) AS contig, strand, start_, end_, score FROM hits WHERE abs(score) >= 1.2),
fr_ AS (SELECT * FROM sr_ m WHERE NOT EXISTS (SELECT 1 FROM reg_ r WHERE r.chrom = m.chrom AND r.contig = m.contig AND r.start_ <= m.start_ AND m.end_ <= r.end_))
SELECT *, 'canonical_motif_rescue' AS call_basis FROM fr_ m WHERE strand = '+' OR NOT EXISTS (SELECT 1 FROM fr_ r WHERE r.strand = '+' AND
  r.chrom = m.chrom AND r.contig = m.contig AND r.start_ <= m.start_ AND m.end_ <= r.end_)""")
def win3(t):
    return rescued(t).select("chrom", "contig", "strand", F.col("start").alias("start_"), F.col("end").alias("end_"),
                             r6("score").alias("score"), F.lit("canonical_motif_rescue").alias("call_basis"))


@query("win4_region_motifs", "genome", _REGIONS + f""",
q_ AS (SELECT r.chrom, r.contig, r.start_, r.end_, substr(x, cast(r.start_ + 1 AS bigint), cast(r.end_ - r.start_ AS bigint)) AS sub FROM reg_ r JOIN contigs c ON r.chrom = c.chrom AND r.contig = c.contig)
SELECT chrom, contig, start_, end_, {d.mcount('sub', 'G4')} AS n_forward, {d.mcount(d.revcomp('sub'), 'G4')} AS n_reverse FROM q_""")
def win4(t):
    r = region_motifs(t)
    count = lambda s: F.sum(F.when(F.col("strand") == s, 1).otherwise(0)).alias("n_forward" if s == "+" else "n_reverse")
    keys = ["chrom", "contig", "start_", "end_"]
    regions = scored_regions(t).select("chrom", "contig", F.col("start").alias("start_"), F.col("end").alias("end_"))
    return regions.join(r, keys, "left").groupBy(*keys).agg(count("+"), count("-"))


def region_motifs(t):
    """Motifs inside each region, in the coordinates of the contig."""
    subs = scored_regions(t).join(contigs(t), ["chrom", "contig"]).select(
        "chrom", "contig", F.col("start").alias("start_"), F.col("end").alias("end_"),
        F.substr(F.col("x"), F.col("start") + 1, F.col("end") - F.col("start")).alias("sub"))
    found = motifs.find(subs, ["chrom", "contig", "start_", "end_"], "sub", ["G4"])
    return found.withColumns({"start": F.col("start") + F.col("start_"), "end": F.col("end") + F.col("start_")})


# ------------------------------------------------------------ edits, screens
_EDITS = """
ps_ AS (SELECT seq_id, o, unnest(range(0, length(o))) AS i0 FROM oligos),
ed_ AS (SELECT seq_id, o, i0, substr(o, i0 + 1, 1) AS wt, b AS alt, concat(substr(o, 1, i0), b, substr(o, i0 + 2)) AS mut
        FROM ps_ JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(b) ON b <> substr(o, i0 + 1, 1))"""


@query("mut1_substitutions", "oligos", _EDITS + """
SELECT seq_id, concat(wt, i0 + 1, alt) AS label, mut AS mutant, concat(translate(wt, 'ACGT', 'TGCA'), translate(alt, 'ACGT', 'TGCA')) AS complement FROM ed_""")
def mut1(t):
    flip = lambda c: F.translate(c, "ACGT", "TGCA")
    return motifs.substitutions(t.oligos, ["seq_id"], "o").select(
        "seq_id", "label", "mutant", F.concat(flip("wt"), flip("alt")).alias("complement"))


def _state_sql(a, b):
    return (f"CASE WHEN {a} = 0 AND {b} = 0 THEN 'no_motif' WHEN {b} = 0 THEN 'motif_lost' WHEN {a} = 0 THEN 'motif_gained' "
            f"WHEN {a} <> {b} THEN 'motif_count_changed' ELSE 'motif_retained' END")


@query("mut2_motif_states", "oligos", _EDITS + f""",
m_ AS (SELECT 'G4' AS kind, {d.mcount('o', 'G4')} AS a, {d.mcount('mut', 'G4')} AS b FROM ed_
       UNION ALL SELECT 'iM', {d.mcount('o', 'iM')}, {d.mcount('mut', 'iM')} FROM ed_)
SELECT kind, {_state_sql('a', 'b')} AS state, count(*) AS n FROM m_ GROUP BY ALL""")
def mut2(t):
    df = t.oligos.withColumns({f"wt_{k}": motif.motif_count("o", k) for k in ("G4", "iM")})
    edits = motifs.substitutions(df, ["seq_id", "wt_G4", "wt_iM"], "o")
    states = F.array(*[F.struct(F.lit(k).alias("kind"), variant.motif_state(
        F.col(f"wt_{k}"), motif.motif_count("mutant", k)).alias("state")) for k in ("G4", "iM")])
    return edits.select(F.inline(states)).groupBy("kind", "state").agg(F.count("*").alias("n"))


_DUPLEX = f"dx_ AS (SELECT seq_id, concat(o, {d.revcomp('o')}) AS o FROM oligos),"


@query("mut3_other_strand_gain", "oligos", _DUPLEX + _EDITS.replace("FROM oligos", "FROM dx_") + f"""
SELECT seq_id, concat(wt, i0 + 1, alt) AS label FROM ed_
WHERE {d.mcount('o', 'G4')} >= {d.mcount(d.revcomp('o'), 'G4')} AND ({d.mcount('o', 'G4')} > 0 OR {d.count('o', 'G')} >= {d.count('o', 'C')})
  AND {d.mcount(d.revcomp('o'), 'G4')} = 0 AND {d.mcount(d.revcomp('mut'), 'G4')} > 0""")
def mut3(t):
    """Gains on the strand a G4 score is not routed to: reported, never scored."""
    duplex = t.oligos.select("seq_id", F.concat("o", seq.revcomp("o")).alias("o"))
    gains = motifs.other_strand_gains(duplex, ["seq_id"], "o", "G4")
    # the other strand held none, so a G4 score is asked on this one where it holds a motif or as much G as C
    routed = motif.has_motif("o", "G4") | (seq.count_of("o", "G") >= seq.count_of("o", "C"))
    return gains.where(routed).select("seq_id", "label")


def _census_sql(x):
    return " + ".join(d.mcount(y, k) for y in (x, d.revcomp(x)) for k in ("G4", "iM"))


@query("scr1_prescreen", "oligos", _EDITS + f""",
c_ AS (SELECT seq_id, o, {_census_sql('o')} AS ref_total, {_census_sql('mut')} AS mut_total FROM ed_),
g_ AS (SELECT seq_id, any_value(o) AS o, any_value(ref_total) AS ref_total, count(*) AS screened, count_if(mut_total > ref_total) AS n_gain,
              count_if(mut_total < ref_total) AS n_loss FROM c_ GROUP BY seq_id)
SELECT seq_id, ref_total, screened, cast(n_gain AS bigint) AS n_gain, cast(n_loss AS bigint) AS n_loss, CASE WHEN ref_total > 0 THEN 'motif_present'
  WHEN n_gain > 0 THEN 'motif_gain_possible' WHEN abs({d.hunter_mean('o')}) >= 0.5 THEN 'borderline' ELSE 'no_motif' END AS verdict FROM g_""")
def scr1(t):
    edits = motifs.census_changes(t.oligos.withColumn("hunter", seq.hunter_mean("o")), ["seq_id", "hunter"], "o")
    out = edits.groupBy("seq_id", "ref_total", "hunter").agg(
        F.count("*").alias("screened"), F.count_if(F.col("mut_total") > F.col("ref_total")).alias("n_gain"),
        F.count_if(F.col("mut_total") < F.col("ref_total")).alias("n_loss"))
    verdict = (F.when(F.col("ref_total") > 0, "motif_present").when(F.col("n_gain") > 0, "motif_gain_possible")
               .when(F.abs("hunter") >= 0.5, "borderline").otherwise("no_motif"))
    return out.select("seq_id", "ref_total", "screened", "n_gain", "n_loss", verdict.alias("verdict"))


@query("scr1_gained_and_lost", "oligos", _EDITS + f""",
c_ AS (SELECT seq_id, concat(wt, i0 + 1, alt) AS label, i0 + 1 AS position, {_census_sql('o')} AS ref_total, {_census_sql('mut')} AS mut_total FROM ed_)
SELECT seq_id, label, cast(position AS int) AS position, CASE WHEN mut_total > ref_total THEN 'gained' ELSE 'lost' END AS change, ref_total, mut_total FROM c_ WHERE mut_total <> ref_total""")
def scr1_lists(t):
    """The substitutions that gain or lose a motif, one row each."""
    edits = motifs.census_changes(t.oligos, ["seq_id"], "o").where("mut_total <> ref_total")
    return edits.select("seq_id", "label", (F.col("at") + 1).cast("int").alias("position"),
                        F.when(F.col("mut_total") > F.col("ref_total"), "gained").otherwise("lost").alias("change"), "ref_total", "mut_total")


_GENOME_EDITS = _genome_sql() + f""",
gp_ AS (SELECT *, unnest(range(0, length(text_))) AS i0 FROM gm),
ge_ AS (SELECT chrom, kind, strand, CASE WHEN strand = '+' THEN start_ + i0 + 1 ELSE end_ - i0 END AS pos, start_, end_, text_,
    CASE WHEN strand = '+' THEN substr(text_, i0 + 1, 1) ELSE translate(substr(text_, i0 + 1, 1), 'ACGT', 'TGCA') END AS ref,
    CASE WHEN strand = '+' THEN b ELSE translate(b, 'ACGT', 'TGCA') END AS alt,
    CASE WHEN CASE WHEN kind = 'G4' THEN regexp_matches(concat(substr(text_, 1, i0), b, substr(text_, i0 + 2)), '{d.PAT['G4']}')
      ELSE regexp_matches(concat(substr(text_, 1, i0), b, substr(text_, i0 + 2)), '{d.PAT['iM']}') END THEN 'motif_retained' ELSE 'motif_lost' END AS state FROM gp_ JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(b) ON b <> substr(text_, i0 + 1, 1))"""


@query("var6_forward_coordinates", "genome", _GENOME_EDITS + """
SELECT chrom, kind, strand, state, count(*) AS n, cast(sum(pos) AS bigint) AS sum_pos FROM ge_ GROUP BY ALL""")
def var6(t):
    """Edits of genome motifs, in forward-strand coordinates."""
    return motif_edits(genome_motifs(t)).groupBy("chrom", "kind", "strand", "state").agg(
        F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


def motif_edits(gm):
    """Every SNV of every genome motif with its motif state on the motif's own strand."""
    holds = lambda s: F.when(F.col("kind") == "G4", motif.has_motif(s, "G4")).otherwise(motif.has_motif(s, "iM"))
    base = F.when(F.col("kind") == "G4", motif.BASE["G4"]).otherwise(motif.BASE["iM"])
    e = motifs.substitutions(gm.withColumn("_holds", holds("text_")), ["chrom", "start_", "end_", "strand", "kind", "_holds"], "text_")
    pos, ref, alt = variant.to_forward(F.col("start_"), F.col("end_"), F.col("strand"), F.col("at"), F.col("wt"), F.col("alt"))
    # a base outside the tracts' letter is in no tract: the pattern, where the text holds it, stays
    kept = (F.col("_holds") & (F.col("wt") != base)) | holds("mutant")
    return e.select("chrom", pos.alias("pos"), ref.alias("ref"), alt.alias("alt"), "start_", "end_", "strand", "kind",
                    "text_", "mutant", F.when(kept, "motif_retained").otherwise("motif_lost").alias("state"))


@query("fea14_qgrs_score", "oligos", """
t_ AS (SELECT seq_id, o, t, unnest(range(1, length(o) - t + 2)) AS p FROM (SELECT seq_id, o, unnest(range(2, 8)) AS t FROM oligos)),
c_ AS (SELECT * FROM t_ WHERE substr(o, p, t) = repeat('G', t)),
q_ AS (SELECT a.seq_id, a.t, b.p - a.p - a.t AS l1, c.p - b.p - a.t AS l2, e.p - c.p - a.t AS l3 FROM c_ a
  JOIN c_ b ON a.seq_id = b.seq_id AND a.t = b.t AND b.p >= a.p + a.t JOIN c_ c ON a.seq_id = c.seq_id AND a.t = c.t AND c.p >= b.p + a.t
  JOIN c_ e ON a.seq_id = e.seq_id AND a.t = e.t AND e.p >= c.p + a.t AND e.p + a.t - a.p <= 30),
s_ AS (SELECT seq_id, max(21 - (abs(l1 - l2) + abs(l2 - l3) + abs(l1 - l3)) / 3.0::double + 21 * (t - 2)) AS sc FROM q_
  WHERE (t = 2 OR least(l1, l2, l3) >= 1) AND (l1 = 0)::int + (l2 = 0)::int + (l3 = 0)::int <= 1 GROUP BY seq_id)
SELECT seq_id, round(coalesce(sc, 0), 6) AS gscore FROM oligos LEFT JOIN s_ USING (seq_id)""")
def fea14(t):
    return motifs.with_qgrs_score(t.oligos, "o", "gscore").select("seq_id", r6("gscore").alias("gscore"))
