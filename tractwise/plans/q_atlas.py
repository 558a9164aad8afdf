"""Sources, ingest adapters, measurement-table queries and applicability rules."""

from pyspark.sql import functions as F

from ..functions import condition, motif, seq, variant
from ..operators import atlas, manifest, motifs, ordered, splits
from ..session import cut_lineage
from ..sources import buffers, ingest, readers
from . import duck as d
from .q_motifs import _genome_sql, _hits_sql
from .q_sequences import r6
from .registry import query

# ------------------------------------------------------------------ readers


@query("src1_fasta_records", "seqs", """
SELECT concat('rec', seq_id) AS id, CASE WHEN seq_id % 50 = 0 THEN '' ELSE s END AS sequence FROM seqs""")
def src1(t):
    body = F.when(F.col("seq_id") % 50 == 0, "").otherwise(F.concat(
        F.lit("\n"), F.substring("s", 1, 60), F.lit("\n"), F.substring("s", 61, 60), F.lit("\n")))
    text = t.seqs.select(F.concat(F.lit("rec"), F.col("seq_id").cast("string"), F.lit(" some description"), body).alias("value"))
    return readers.fasta_records(text).select("id", "sequence")


def fasta_file(t):
    """The genome as FASTA text, a file per chromosome with lines of 48 bases; returns its folder."""
    path = manifest.scratch(t.spark, "fasta")
    first = t.genome.groupBy("chrom").agg(F.min("piece").alias("first"))
    lines = F.concat_ws("\n", F.when(F.col("piece") == F.col("first"), F.concat(F.lit(">"), "chrom", F.lit(" made of pieces >1"))), F.substring("s", 1, 48), F.lower(F.substring("s", 49, 48)))
    rows = t.genome.join(F.broadcast(first), "chrom").select(F.col("chrom").alias("folder"), "chrom", "piece", lines.alias("value"))  # a row per chromosome
    rows.repartition("folder").sortWithinPartitions("folder", "piece").select("folder", "value").write.partitionBy("folder").text(path)
    return f"{path}/folder=*"


@query("src1_fasta_lengths", "genome", "SELECT chrom AS id, cast(sum(length(s)) AS bigint) AS length FROM genome GROUP BY chrom")
def src1_lengths(t):
    return readers.fasta_lengths(t.spark, fasta_file(t))


@query("src1_fasta_to_motifs", "genome", _genome_sql() + "SELECT * FROM gm")
def src1_motifs(t):
    """From FASTA text to the motifs of the genome: byte ranges, pieces, hits."""
    hits = motifs.genome_hits(readers.fasta_pieces(t.spark, fasta_file(t), motifs.PACKED), motifs.PACKED)
    return hits.withColumnsRenamed({"start": "start_", "end": "end_", "text": "text_"})



def pasted_lines(t):
    df = t.oligos.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    m = F.col("seq_id") % 100
    doc = F.floor(F.col("seq_id") / 100)
    name = F.when(F.col("seq_id") % 7 == 0, ">").otherwise(F.concat(F.lit("> name"), (F.col("seq_id") % 9).cast("string")))
    line = (F.when(F.col("j") == 0, F.when(doc % 2 == 0, name).otherwise(""))
            .when(F.col("seq_id") % 11 == 0, "  ").when(F.col("j") == 1, F.concat(F.lit(" "), F.col("o")))
            .otherwise(F.reverse("o")))
    return df.select(doc.alias("doc"), (3 * m + F.col("j")).alias("line_no"), line.alias("line"))


@query("src2_pasted_records", "oligos", """
fa_ AS (SELECT cast(floor(seq_id / 100) AS bigint) AS doc, row_number() OVER (PARTITION BY floor(seq_id / 100) ORDER BY seq_id) - 1 AS index_,
   CASE WHEN seq_id % 7 = 0 THEN NULL ELSE concat('name', seq_id % 9) END AS nm, CASE WHEN seq_id % 11 = 0 THEN '' ELSE concat(o, reverse(o)) END AS sequence
   FROM oligos WHERE floor(seq_id / 100) % 2 = 0),
li_ AS (SELECT cast(floor(seq_id / 100) AS bigint) AS doc, row_number() OVER (PARTITION BY floor(seq_id / 100) ORDER BY seq_id, j) - 1 AS index_,
   CASE WHEN j = 1 THEN o ELSE reverse(o) END AS sequence FROM oligos, (VALUES (1), (2)) v(j) WHERE floor(seq_id / 100) % 2 = 1 AND seq_id % 11 <> 0)
SELECT doc, index_, coalesce(nm, concat('seq_', index_ + 1)) AS id, sequence, CASE WHEN nm IS NULL THEN 'generated' ELSE 'fasta_header' END AS id_source FROM fa_
UNION ALL SELECT doc, index_, concat('seq_', index_ + 1), sequence, 'generated' FROM li_""")
def src2(t):
    return readers.pasted_records(pasted_lines(t), "doc", "line_no", "line").withColumnRenamed("index", "index_")


@query("src3_header_aliases", "records", "SELECT seq_id, sequence, tm, k, ph FROM records")
def src3(t):
    odd = t.records.select("seq_id", F.col("sequence").alias("Oligo Sequence"), F.col("tm").alias("T_m"),
                           F.col("k").alias("[K+]"), F.col("ph").alias("pH"))
    got = readers.with_fields(odd, {"seq_id": ["seq_id"], "sequence": ["sequence", "oligo"], "tm": ["tm"], "k": ["k", "k+"],
                                    "ph": ["ph"], "dg": ["dg", "delta g"]}, ["sequence", "tm"])
    return got.select("seq_id", "sequence", "tm", "k", "ph")


def long_scores(t):
    """Score rows as text: some malformed, some blank, some repeated."""
    p = F.col("pos")
    position = F.when(p % 23 == 0, "not a number").otherwise(p.cast("string"))
    return t.snvs.select(
        F.col("chrom").alias("chromosome"), position.alias("position"), F.col("ref").alias("reference"), F.col("alt").alias("alternate"),
        F.concat(F.lit("track"), (F.col("motif_id") % 3).cast("string")).alias("scorer"),
        F.when(p % 19 == 0, "").otherwise(F.col("score").cast("string")).alias("score"),
        F.struct("score", "gc").alias("row"))


@query("src4_scores_long", "snvs", """
SELECT chrom AS chromosome, pos AS position, ref AS reference, alt AS alternate, concat('track', motif_id % 3) AS scorer, max(score) AS score
FROM snvs WHERE pos % 23 <> 0 AND pos % 19 <> 0 AND score IS NOT NULL GROUP BY ALL""")
def src4_long(t):
    return readers.score_rows(long_scores(t), "row")


@query("src4_scores_wide", "snvs", """
w_ AS (SELECT chrom, pos, ref, alt, max(score) AS a, max(gc) AS b FROM snvs GROUP BY ALL)
SELECT chrom AS chromosome, pos AS position, ref AS reference, alt AS alternate, 'a' AS scorer, a AS score FROM w_ WHERE a IS NOT NULL
UNION ALL SELECT chrom, pos, ref, alt, 'b', b FROM w_""")
def src4_wide(t):
    wide = t.snvs.groupBy(F.col("chrom").alias("chromosome"), F.col("pos").alias("position"), F.col("ref").alias("reference"),
                          F.col("alt").alias("alternate")).agg(F.max("score").alias("a"), F.max("gc").alias("b"), F.lit(0).alias("row"))
    return readers.score_rows(wide, "row")


@query("src4_score_fates", "snvs", """
w_ AS (SELECT CASE WHEN pos % 23 = 0 THEN 'bad_position' WHEN pos % 19 = 0 OR score IS NULL THEN 'absent' ELSE 'kept' END AS fate, * FROM snvs),
k_ AS (SELECT count(*) AS n FROM (SELECT DISTINCT chrom, pos, ref, alt, motif_id % 3 FROM w_ WHERE fate = 'kept'))
SELECT fate, CASE fate WHEN 'kept' THEN (SELECT n FROM k_) ELSE count(*) END AS n FROM w_ GROUP BY fate
UNION ALL SELECT 'overwritten', count(*) - (SELECT n FROM k_) FROM w_ WHERE fate = 'kept' HAVING count(*) > (SELECT n FROM k_)""")
def src4_fates(t):
    """What became of every row of a score table."""
    return readers.score_fates(long_scores(t), "row")


@query("src5_bundle_region", "snvs", """
SELECT chrom, pos, ref, alt, score FROM snvs WHERE chrom = 'chr2' AND pos BETWEEN 1000 AND 9000""")
def src5_bundle(t):
    """A region of a bundle written by chromosome and position; chosen folders and row groups are all that is read."""
    path = manifest.scratch(t.spark, "bundle")
    readers.write_bundle(t.snvs.select("chrom", "pos", "ref", "alt", "score"), path)
    return readers.read_bundle(t.spark, path, "chr2", 1000, 9000).select("chrom", "pos", "ref", "alt", "score")


@query("src5_region_scores", "snvs", """
SELECT chrom, pos, ref, alt, score FROM snvs WHERE chrom = 'chr2' AND pos BETWEEN 1000 AND 9000""")
def src5(t):
    # the bundle spells chromosomes without the prefix
    bundle = t.snvs.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos", "ref", "alt", "score")
    return readers.region(bundle, "chr2", 1000, 9000).withColumn("chrom", variant.norm_chrom(F.col("chrom")))


PEAK = "chrom string, start bigint, end bigint, target string, cell string, tier string, auc double"


def peak_lines(t):
    i = t.intervals
    return i.select(F.to_json(F.struct(
        "chrom", F.col("start_").alias("start"), F.col("end_").alias("end"), "target",
        F.when(F.col("pk") % 2 == 0, "HEK").otherwise("HeLa").alias("cell"),
        F.when(F.col("ok") % 3 == 0, "stringent").otherwise("relaxed").alias("tier"), "auc")).alias("line"))


@query("src7_peaks_json", "intervals", """
SELECT chrom, start_, end_, target, auc FROM intervals WHERE pk % 2 = 0 AND ok % 3 = 0""")
def src7(t):
    p = peak_lines(t).select(F.from_json("line", PEAK).alias("p")).select("p.*").where("cell = 'HEK' AND tier = 'stringent'")
    return p.select("chrom", F.col("start").alias("start_"), F.col("end").alias("end_"), "target", "auc")


@query("src8_bed_lines", "intervals", "SELECT chrom, start_, end_ FROM intervals WHERE pk % 10 > 1")
def src8(t):
    line = F.concat_ws("\t", "chrom", F.col("start_").cast("string"), F.col("end_").cast("string"))
    lines = t.intervals.select(F.when(F.col("pk") % 10 == 0, F.concat(F.lit("# "), line))
                               .when(F.col("pk") % 10 == 1, F.concat(F.lit("track "), line)).otherwise(line).alias("line"))
    return readers.bed(lines, "line").select("chrom", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query("src9_panel_files", "records", """
SELECT sk AS panel, concat('p', sk) AS panel_name, cast(seq_id AS varchar) AS sequence_id, sequence, count(*) AS n FROM records GROUP BY ALL""")
def src9(t):
    body = t.records.select(F.col("sk").alias("doc"), (F.monotonically_increasing_id() + 10).alias("line_no"), F.concat_ws(
        "\t", F.col("seq_id").cast("string"), "sequence").alias("line"))
    heads = t.records.select(F.col("sk").alias("doc")).distinct().select("doc", F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("# name: p"), F.col("doc").cast("string")).alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("sequence_id\tsequence").alias("line")))))
    meta, rows = readers.panel(heads.unionByName(body), "doc", "line_no", "line")
    names = meta.where("key = 'name'").select("doc", F.col("value").alias("panel_name"))
    return rows.join(names, "doc").groupBy(F.col("doc").alias("panel"), "panel_name", F.col("cells")["sequence_id"].alias("sequence_id"),
                                           F.col("cells")["sequence"].alias("sequence")).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- adapters
SPEC = {"source": "bench", "columns": {"sequence": "Oligo", "tm": "Melt", "k": "KCl", "folded": "State", "name": "Ref"},
        "units": {"tm": "K", "k": "M"}, "constants": {"ph": "7.2", "kind": "G4"}, "value_maps": {"folded": {"up": "1", "down": "0"}}}


def odd_table(t):
    return t.records.select(
        "seq_id", "ln", "pk", F.when(F.col("pk") % 29 == 0, " nan ").otherwise(F.concat(F.lit(" "), F.col("sequence"))).alias("Oligo"),
        F.when(F.col("pk") % 31 == 0, "n.d.").otherwise((F.col("tm") + 273.15).cast("string")).alias("Melt"),
        F.when(F.col("pk") % 3 != 0, F.col("k") / 1000).cast("string").alias("KCl"),
        F.when(F.col("folded") == 1, "up").when(F.col("folded") == 0, "down").alias("State"),
        F.concat(F.lit("r"), F.col("pk").cast("string")).alias("Ref"))


@query("src10_declared_table", "records", """
SELECT sequence, 'G4' AS kind, 'bench' AS source, concat('r', pk) AS source_id, round(CASE WHEN pk % 31 <> 0 THEN tm END, 4) AS tm,
  CASE WHEN pk % 3 <> 0 THEN k ELSE 100 END AS k, 7.2::double AS ph, folded,
  concat('declarative_adapter:bench|condition_partially_imputed:', CASE WHEN pk % 3 = 0 THEN 'k,' ELSE '' END, 'na,li_nh4,mg,temperature,crowder_pct,strand_conc') AS flags
FROM records WHERE pk % 29 <> 0""")
def src10(t):
    df = ingest.declared(odd_table(t), SPEC, "pk")
    return df.select("sequence", "kind", "source", "source_id", F.round("tm", 4).alias("tm"), "k", "ph", "folded",
                     F.array_join("qc_flags", "|").alias("flags"))


@query("src11_lab_table", "records", f"""
SELECT CASE WHEN pk % 4 = 0 THEN 'iM' WHEN pk % 4 = 1 THEN 'G4' WHEN {d.count('sequence', 'C')} > {d.count('sequence', 'G')} THEN 'iM' ELSE 'G4' END AS kind,
  sequence, CASE WHEN sk % 4 = 3 THEN NULL WHEN sk % 4 = 2 THEN 0 ELSE 1 END AS folded, tm, coalesce(ph, 7) AS ph,
  concat('lab_measurement|replicate=', ln, '|condition_partially_imputed:k,na,li_nh4,mg,', CASE WHEN ph IS NULL THEN 'ph,' ELSE '' END, 'temperature,crowder_pct,strand_conc') AS flags FROM records""")
def src11(t):
    m, w = F.col("pk") % 4, F.col("sk") % 4
    table = t.records.select(
        F.col("pk").alias("row_no"), F.col("sequence").alias("Sequence"), F.when(m == 0, "i-Motif").when(m == 1, "Quadruplex").alias("Structure"),
        F.when(w == 0, "Yes").when(w == 1, "folded").when(w == 2, "n").otherwise("maybe").alias("Forms"),
        F.col("tm").alias("Tm"), F.col("ph").alias("pH"), F.col("ln").alias("Run"))
    df = ingest.laboratory(table, "our_lab", "row_no")
    return df.select("kind", "sequence", "folded", "tm", "ph", F.array_join("qc_flags", "|").alias("flags"))


# text, expected k, na, li_nh4, mg, ph (0: the reported column decides), flags before and after, usable
_BUFFERS = [
    ("concat({q}, ' mM KCl + 10 mM Na cacodylate (pH 7.2)')", "qty", "10", "0", "0", "7.2", "ph_recovered_from_buffer_text", True),
    ("'20 mM Kpi + 80 mM KCl'", "110", "0", "0", "0", None, "ph_unknown", True),
    ("'PBS (pH 7.4)'", "4.45", "157", "0", "0", "7.4", "ph_recovered_from_buffer_text", True),
    ("concat('10 mM lithium cacodylate and 0.', {q}, ' M NaCl')", "0", None, "10", "0", None, "ph_unknown", True),
    ("'100 mM K + unknown Li cacodylate (pH 7.0)'", "100", "0", "0", "0", "7.0", "ph_recovered_from_buffer_text|unquantified_component:unknown Li cacodylate", True),
    ("'10 mM Tris-HCl'", "0", "0", "0", "0", None, "ph_unknown|no_cation_recovered", False),
    ("concat('5 mM MgCl2 + ', {q}, ' uM NaCl')", "0", "qty/1000", "0", "5", None, "ph_unknown", True),
    ("concat({q}, ' mM XYZ salt + 100 KCl')", "100", "0", "0", "0", None, "ph_unknown|unit_assumed_mM:100 KCl", False),
    ("' nan '", "0", "0", "0", "0", None, "no_buffer_description", False),
]


def _buffer_text(text):
    q = f"cast(qty AS {text})"
    return "CASE pk % 9 " + " ".join(f"WHEN {i} THEN {b[0].format(q=q)}" for i, b in enumerate(_BUFFERS)) + " END"


def _case(i, kind="double"):
    def value(n, b):
        if i == 2 and b[i] is None:
            return "cast(concat('0.', qty) AS double) * 1000"
        return b[i]
    return "CASE pk % 9 " + " ".join(f"WHEN {n} THEN cast({value(n, b)} AS double)" for n, b in enumerate(_BUFFERS)) + " END"


_PH_TEXT = "CASE pk % 9 " + " ".join(f"WHEN {n} THEN {b[5] or 'NULL'}" for n, b in enumerate(_BUFFERS)) + " END"
_BUF_SQL = f"""bx_ AS (SELECT *, round({_case(1)}, 6) AS bk, round({_case(2)}, 6) AS bna, round({_case(3)}, 6) AS bli, round({_case(4)}, 6) AS bmg,
  CASE WHEN pk % 9 = 8 THEN NULL WHEN ln % 2 = 0 THEN 6.5::double ELSE cast({_PH_TEXT} AS double) END AS bph,
  CASE pk % 9 {' '.join(f"WHEN {n} THEN {str(b[7]).lower()}" for n, b in enumerate(_BUFFERS))} END AS usable,
  CASE WHEN pk % 9 = 8 OR ln % 2 = 1 THEN CASE pk % 9 {' '.join(f"WHEN {n} THEN '{b[6]}'" for n, b in enumerate(_BUFFERS))} END
       ELSE CASE pk % 9 {' '.join(f"WHEN {n} THEN '{'|'.join(x for x in b[6].split('|') if not x.startswith('ph_'))}'" for n, b in enumerate(_BUFFERS))} END END AS bflags
  FROM records)"""


def parsed_buffers(t):
    df = t.records.withColumns({"buffer": F.expr(_buffer_text("string")), "reported": F.when(F.col("ln") % 2 == 0, 6.5).otherwise(0.0)})
    return buffers.parse(df, "buffer", "reported")


@query("src13_buffer_text", "records", _BUF_SQL + """
SELECT seq_id, ln, pk, bk AS k, bna AS na, bli AS li_nh4, bmg AS mg, bph AS ph, usable, bflags AS flags FROM bx_""")
def src13(t):
    df = parsed_buffers(t)
    return df.select("seq_id", "ln", "pk", *[r6(f"buf_{i}").alias(i) for i in buffers.IONS], F.col("buf_ph").alias("ph"),
                     F.col("buf_usable").alias("usable"), F.array_join("buf_flags", "|").alias("flags"))


@query("agg3_buffer_coverage", "records", _BUF_SQL + """
SELECT count(*) AS n_rows, cast(count_if(usable) AS bigint) AS n_usable, round(count_if(usable) / count(*), 4) AS usable_fraction,
  cast(count_if(pk % 9 = 7) AS bigint) AS with_unparsed, cast(count_if(contains(bflags, 'no_cation')) AS bigint) AS no_cation,
  cast(count_if(contains(bflags, 'unquantified')) AS bigint) AS unquantified, cast(count_if(bph IS NULL) AS bigint) AS ph_unknown FROM bx_""")
def agg3(t):
    df = parsed_buffers(t)
    flagged = lambda s: F.count_if(F.exists("buf_flags", lambda f: f.startswith(s)))
    return df.agg(F.count("*").alias("n_rows"), F.count_if("buf_usable").alias("n_usable"),
                  F.round(F.count_if("buf_usable") / F.count("*"), 4).alias("usable_fraction"),
                  F.count_if(F.size("buf_unparsed") > 0).alias("with_unparsed"), flagged("no_cation").alias("no_cation"),
                  flagged("unquantified").alias("unquantified"), F.count_if(F.col("buf_ph").isNull()).alias("ph_unknown"))


@query("agg3_unparsed_terms", "records", """
SELECT concat(qty, ' mM XYZ salt') AS term, count(*) AS n FROM records WHERE pk % 9 = 7 GROUP BY ALL ORDER BY n DESC, term LIMIT 25""")
def agg3_terms(t):
    terms = parsed_buffers(t).select(F.explode("buf_unparsed").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.orderBy(F.desc("n"), "term").limit(25)


_MELT_SEQ = "CASE WHEN pk % 17 = 0 THEN replace(sequence, 'GA', 'G a') WHEN pk % 19 = 0 THEN concat(sequence, 'X') WHEN pk % 23 = 0 THEN '' ELSE sequence END"
_MELT_TM = "CASE pk % 8 WHEN 0 THEN '> 90' WHEN 1 THEN '51/71' WHEN 2 THEN 'low' WHEN 3 THEN 'about 50' WHEN 4 THEN '150' ELSE cast(qty AS {str}) END"


def melting(t):
    df = t.records.withColumns({"buffer": F.expr(_buffer_text("string")), "reported": F.when(F.col("ln") % 2 == 0, 6.5).otherwise(0.0),
                                "raw_seq": F.expr(_MELT_SEQ), "raw_tm": F.expr(_MELT_TM.format(str="string"))})
    return ingest.melting(df, "raw_seq", "raw_tm", "reported", "buffer")


@query("src12_melting_table", "records", _BUF_SQL + """
SELECT seq_id, ln, pk, CASE WHEN pk % 17 <> 0 AND (pk % 19 = 0 OR pk % 23 = 0) THEN 'rejected_sequence' WHEN NOT usable THEN 'rejected_buffer' ELSE 'kept' END AS outcome,
  CASE WHEN pk % 8 > 4 THEN cast(qty AS double) END AS tm,
  CASE pk % 8 WHEN 0 THEN 'tm_censored:> 90' WHEN 1 THEN 'tm_multiphasic:51/71' WHEN 2 THEN 'tm_qualitative:low' WHEN 3 THEN 'tm_unparsed:about 50' WHEN 4 THEN 'tm_outside_physical_range' END AS tm_flag
FROM bx_""")
def src12(t):
    return melting(t).select("seq_id", "ln", "pk", "outcome", F.col("tm_value").alias("tm"), "tm_flag")


@query("src12_melting_counts", "records", _BUF_SQL + """,
o_ AS (SELECT CASE WHEN pk % 17 <> 0 AND (pk % 19 = 0 OR pk % 23 = 0) THEN 'rejected_sequence' WHEN NOT usable THEN 'rejected_buffer' ELSE 'kept' END AS outcome, pk FROM bx_)
SELECT outcome, count(*) AS n, cast(count_if(pk % 8 = 0) AS bigint) AS censored, cast(count_if(pk % 8 = 1) AS bigint) AS multiphasic, cast(count_if(pk % 8 > 4) AS bigint) AS usable_tm FROM o_ GROUP BY outcome""")
def src12_counts(t):
    return melting(t).groupBy("outcome").agg(
        F.count("*").alias("n"), F.count_if(F.col("tm_flag").startswith("tm_censored")).alias("censored"),
        F.count_if(F.col("tm_flag").startswith("tm_multiphasic")).alias("multiphasic"), F.count("tm_value").alias("usable_tm"))


@query("src14_topology_table", "records", """
SELECT seq_id, ln, pk, CASE pk % 4 WHEN 0 THEN 'parallel' WHEN 1 THEN 'antiparallel' ELSE 'hybrid' END AS topology,
  CASE pk % 5 WHEN 0 THEN 'PDB structure (NMR/X-ray)' WHEN 1 THEN 'CD (in-house)' WHEN 2 THEN 'literature (CD/NMR)' WHEN 3 THEN 'literature (CD/NMR)' ELSE 'unspecified' END AS method,
  CASE pk % 5 WHEN 0 THEN '2GKU' WHEN 1 THEN 'In-house CD' WHEN 2 THEN concat('PQS', qty) WHEN 3 THEN 'Müller – 2001' ELSE '' END AS source_id
FROM records WHERE pk % 4 <> 3""")
def src14(t):
    m = F.col("pk") % 5
    garbled = "MÃ¼ller â€“ 2001"
    comment = (F.when(m == 0, "2gku").when(m == 1, "In-house CD").when(m == 2, F.concat(F.lit("PQS"), F.col("qty").cast("string"), F.lit(" series")))
               .when(m == 3, garbled).otherwise(""))
    table = t.records.withColumns({"code": F.col("pk") % 4, "comment": ingest.repair_text(comment)})
    topology = F.when(F.col("code") == 0, "parallel").when(F.col("code") == 1, "antiparallel").when(F.col("code") == 2, "hybrid")
    return table.withColumn("topology", topology).where("topology IS NOT NULL").select(
        "seq_id", "ln", "pk", "topology", ingest.topology_method(F.col("comment")).alias("method"),
        ingest.topology_id(F.col("comment")).alias("source_id"))


@query("src15_ph_midpoint_table", "records oligos", """
o2_ AS (SELECT seq_id, regexp_extract(o, 'C{3}[ACGT]{1,12}C{3}[ACGT]{1,12}C{3}[ACGT]{1,12}C{3}') AS m FROM oligos)
SELECT r.seq_id, ln, pk, CASE WHEN pk % 17 = 0 THEN 'rejected_sequence' WHEN ph_t IS NULL THEN 'rejected_pht' ELSE 'kept' END AS outcome,
  CASE WHEN pk % 17 <> 0 THEN ph_t END AS ph_t, 7::double AS ph,
  CASE WHEN pk % 17 <> 0 AND ph_t IS NOT NULL THEN concat_ws('|', CASE WHEN ph_t NOT BETWEEN 3 AND 9 THEN 'pht_outside_measured_range' END,
    CASE WHEN m <> '' THEN concat('detected_putative_im=', m) END, 'ph_titration_range=4.0-8.0') END AS flags
FROM records r LEFT JOIN o2_ ON r.seq_id = o2_.seq_id""")
def src15(t):
    raw = F.when(F.col("pk") % 17 == 0, F.concat(F.col("sequence"), F.lit("Δ3"))).otherwise(F.col("sequence"))
    s = F.translate(F.upper(F.regexp_replace(raw, r"\s+", "")), "U", "T")
    bad = raw.rlike("[Δ∆]") | ~s.rlike("^[ACGT]+$")
    # construct name -> detected motif, first hit of each construct
    pattern = motif.PATTERN["iM"]
    found = t.oligos.where(F.col("o").rlike(pattern)).select("seq_id", F.regexp_extract("o", pattern, 0).alias("motif"))
    df = t.records.join(found, "seq_id", "left")
    outcome = F.when(bad, "rejected_sequence").when(F.col("ph_t").isNull(), "rejected_pht").otherwise("kept")
    flags = F.array_compact(F.array(F.when(~F.col("ph_t").between(3.0, 9.0), F.lit("pht_outside_measured_range")),
                                    F.concat(F.lit("detected_putative_im="), F.col("motif")), F.lit("ph_titration_range=4.0-8.0")))
    # the label is never copied into the condition: a titration has no single pH
    return df.select("seq_id", "ln", "pk", outcome.alias("outcome"), F.when(~bad, F.col("ph_t")).alias("ph_t"),
                     F.lit(condition.DEFAULTS["ph"]).alias("ph"), F.when(outcome == "kept", F.array_join(flags, "|")).alias("flags"))


@query("src16_sampled_predictions", "records", """SELECT cast(1000 AS bigint) AS n_sequences, cast(0 AS bigint) AS n_incomplete""")
def src16(t):
    """Rows of 1000 sampled sequences: how many, and how many lost one of their conditions."""
    kept = ingest.sample_sequences(t.records, "sequence", 1000, seed=11)
    per = kept.groupBy("sequence").agg(F.count("*").alias("n"))
    whole = t.records.groupBy("sequence").agg(F.count("*").alias("all_n"))
    return per.join(whole, "sequence").agg(F.count("*").alias("n_sequences"), F.count_if(F.expr("n <> all_n")).alias("n_incomplete"))


def grid(t):
    """Grid lines: a row value, then ten cells, 'a' where nothing was measured."""
    cell = lambda i: F.when((F.col("pk") + i) % 4 == 0, "a").otherwise((F.col("qty") + i).cast("string")).alias(f"c{i}")
    return t.records.select("seq_id", "ln", "pk", (4 + F.col("qty") / 10).alias("row_value"), *[cell(i) for i in range(10)])


STRENGTHS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5]


@query("src17_grid_rows", "records", """
g_ AS (SELECT seq_id, ln, pk, qty, unnest(range(0, 10)) AS i FROM records)
SELECT seq_id, g_.ln, pk, 4 + qty / 10 AS ph, round([0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5][i + 1]::double * 1000, 6) AS k, cast(qty + i AS double) AS tm
FROM g_ WHERE (pk + i) % 4 <> 0""")
def src17(t):
    long = grid(t).unpivot(["seq_id", "ln", "pk", "row_value"], [f"c{i}" for i in range(10)], "column", "cell")
    strength = F.element_at(F.array(*[F.lit(s) for s in STRENGTHS]), F.substring("column", 2, 2).cast("int") + 1)
    return long.withColumn("tm", F.col("cell").try_cast("double")).where("tm IS NOT NULL").select(
        "seq_id", "ln", "pk", F.col("row_value").alias("ph"), r6(strength * 1000).alias("k"), "tm")


@query("src18_best_motif_in_window", "seqs", _hits_sql("seqs", "s", ["G4", "iM"]) + """,
b_ AS (SELECT *, row_number() OVER (PARTITION BY seq_id, kind ORDER BY end_ - start_ DESC, score DESC, strand, start_) AS r FROM hits)
SELECT s.seq_id, k.kind, b_.strand, b_.start_, b_.text_, b_.seq_id IS NOT NULL AS kept FROM seqs s CROSS JOIN (VALUES ('G4'), ('iM')) k(kind)
LEFT JOIN (SELECT * FROM b_ WHERE r = 1) b_ ON s.seq_id = b_.seq_id AND k.kind = b_.kind""")
def src18(t):
    return best_motif(t.seqs).select("seq_id", "kind", "strand", "start_", "text_", "kept")


def best_motif(windows, kinds=("G4", "iM")):
    """Longest, then best-scoring motif of each kind in each window, on either strand; a window without one stays, flagged."""
    h = motifs.find(windows, ["seq_id"], "s", list(kinds))
    order = F.struct(F.col("end") - F.col("start"), F.round("score", 6), F.when(F.col("strand") == "+", 1).otherwise(0), -F.col("start"))
    best = h.groupBy("seq_id", "kind").agg(F.max_by(F.struct("strand", F.col("start").alias("start_"), F.col("text").alias("text_")), order).alias("b"))
    each = windows.select("seq_id", "s", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return each.join(best, ["seq_id", "kind"], "left").select("seq_id", "kind", "s", "b.*", F.col("b").isNotNull().alias("kept"))


@query("src18_motif_negatives", "seqs")
def src18_negatives(t):
    """Shuffles of the windows that still carry a motif of the kind, as far as 25 draws give one: windows, negatives, and those that changed composition."""
    kept, out = cut_lineage(best_motif(t.seqs).where("kept").select("seq_id", "kind", "s")), None
    for kind in ("G4", "iM"):
        drawn = kept.where(F.col("kind") == kind).withColumn("negative", splits.motif_shuffle(F.col("s"), kind, 25, F.col("seq_id")))
        first = drawn.where("negative IS NOT NULL").groupBy("seq_id", "s").agg(F.first("negative").alias("negative"))
        moved = sum((F.abs(seq.count_of("s", b) - seq.count_of("negative", b)) for b in seq.BASES), F.lit(0))
        part = first.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_negatives"), F.count_if(moved > 0).alias("n_composition_changed"))
        part = ordered.attach(part, kept.where(F.col("kind") == kind).agg(F.count("*").alias("n_windows")))
        out = part if out is None else out.unionByName(part)
    return out


@query("agg21_motif_yield", "seqs", f"""
m_ AS (SELECT seq_id, 'G4' AS kind, {d.mcount('s', 'G4')} + {d.mcount(d.revcomp('s'), 'G4')} > 0 AS has FROM seqs
  UNION ALL SELECT seq_id, 'iM', {d.mcount('s', 'iM')} + {d.mcount(d.revcomp('s'), 'iM')} > 0 FROM seqs)
SELECT kind, seq_id % 20 AS sample, count(*) AS windows, cast(count_if(has) AS bigint) AS kept, round(count_if(has) / count(*), 6) AS fraction FROM m_ GROUP BY ALL""")
def agg21(t):
    return best_motif(t.seqs).groupBy("kind", (F.col("seq_id") % 20).alias("sample")).agg(
        F.count("*").alias("windows"), F.count_if("kept").alias("kept"), r6(F.count_if("kept") / F.count("*")).alias("fraction"))


def complementary(t):
    rows = t.records.where("kind = 'G4' AND evidence_tier = 'predicted' AND source_id IS NOT NULL")
    return ingest.complementary_candidates(rows.select("source_id", "seq_id", "ln", "pk", "sk", "sequence"), ["seq_id", "ln", "sk", "sequence"])


_COMPL = f"""cp_ AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq_id, ln, sk, sequence) AS r FROM records
  WHERE kind = 'G4' AND evidence_tier = 'predicted' AND source_id IS NOT NULL),
cq_ AS (SELECT concat('rc:', source_id) AS source_id, {d.revcomp('sequence')} AS sequence, sequence AS paired FROM cp_ WHERE r = 1)"""


@query("src19_complementary_candidates", "records", _COMPL + f"SELECT * FROM cq_ WHERE {d.mcount('sequence', 'iM')} > 0")
def src19(t):
    return complementary(t).select("source_id", "sequence", "paired")


# --------------------------------------------------------------- table writes
def keyed(t):
    return t.records.withColumn("seq_hash", seq.seq_hash("sequence"))


_NK = ", ".join(ingest.NATURAL_KEY)


@query("src21_insert_or_ignore", "records", f"""
x AS (SELECT *, substr(sha1(sequence), 1, 16) AS seq_hash FROM records),
y AS (SELECT *, row_number() OVER (PARTITION BY {_NK} ORDER BY seq_id, ln, pk, sk, ep) AS r FROM x WHERE ln > 3),
e AS (SELECT * FROM x WHERE ln <= 3)
SELECT seq_id, y.ln, pk, sk, ep FROM y WHERE source_id IS NULL OR ph IS NULL OR (r = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE """ + " AND ".join(f"e.{c} = y.{c}" for c in ingest.NATURAL_KEY) + "))")
def src21(t):
    x = keyed(t)
    return ingest.insert_or_ignore(x.where("ln <= 3"), x.where("ln > 3"), ["seq_id", "ln", "pk", "sk", "ep"]).select("seq_id", "ln", "pk", "sk", "ep")


@query("src22_source_upsert", "records", """
SELECT source, arg_max(evidence_tier, seq_id * 100000 + pk) AS evidence_tier, arg_max(label_class, seq_id * 100000 + pk) AS label_class FROM records
WHERE seq_id * 100000 + pk IN (SELECT v FROM (SELECT source, max(seq_id * 100000 + pk) AS v FROM records GROUP BY source)) GROUP BY source""")
def src22(t):
    df = t.records.select("source", "evidence_tier", "label_class", (F.col("seq_id") * 100000 + F.col("pk")).alias("version"))
    return ingest.upsert(df, "source", ["version"]).drop("version")


@query("src23_add_missing_sources", "records", """
SELECT source, 'base' AS origin, count(*) AS n, count(tm) AS n_tm, count(ph_t) AS n_ph_t FROM records WHERE source < 'src5' GROUP BY source
UNION ALL SELECT source, 'other', count(*), count(tm), cast(0 AS bigint) FROM records WHERE source >= 'src5' GROUP BY source""")
def src23(t):
    base = t.records.where("source < 'src5'").withColumn("origin", F.lit("base"))
    other = t.records.where("source >= 'src3'").drop("ph_t").withColumns({"origin": F.lit("other"), "extra": F.lit(1)})
    return ingest.add_sources(base, other).groupBy("source", "origin").agg(
        F.count("*").alias("n"), F.count("tm").alias("n_tm"), F.count("ph_t").alias("n_ph_t"))


# ------------------------------------------------------------- table queries
@query("qry1_filtered_records", "records", """
SELECT seq_id, ln, pk, sk, tm FROM records WHERE kind = 'G4' AND evidence_tier IN ('experimental', 'derived') AND label_class IN ('biophysical', 'catalog')
AND source IN ('src1', 'src3', 'src5') AND tm IS NOT NULL ORDER BY seq_id, ln, pk, sk, tm LIMIT 500""")
def qry1(t):
    return atlas.select(t.records, "G4", ["experimental", "derived"], ["biophysical", "catalog"], ["src1", "src3", "src5"], "tm", 500,
                        ["seq_id", "ln", "pk", "sk", "tm"]).select("seq_id", "ln", "pk", "sk", "tm")


@query("qry2_count_where", "records", "SELECT count(*) AS n FROM records WHERE kind = 'iM' AND source = 'src2'")
def qry2(t):
    return t.records.where("kind = 'iM' AND source = 'src2'").agg(F.count("*").alias("n"))


@query("qry3_source_listing", "records", "SELECT evidence_tier, source, count(*) AS n FROM records GROUP BY ALL ORDER BY evidence_tier, source")
def qry3(t):
    return t.records.groupBy("evidence_tier", "source").agg(F.count("*").alias("n")).orderBy("evidence_tier", "source")


@query("agg1_composition", "records", """
SELECT CASE WHEN label_class = 'genomic_proxy' THEN 'genomic_proxy' WHEN evidence_tier = 'experimental' AND label_class = 'biophysical' THEN 'biophysical_measured'
 WHEN evidence_tier = 'predicted' THEN 'predicted' ELSE 'derived_or_shuffle' END AS bucket, count(*) AS n, cast((SELECT count(*) FROM records) AS bigint) AS total FROM records GROUP BY ALL""")
def agg1(t):
    total = t.records.agg(F.count("*").alias("total"))
    return ordered.attach(t.records.groupBy(atlas.bucket().alias("bucket")).agg(F.count("*").alias("n")), total)


@query("agg2_summary", "records", """
SELECT source, kind, evidence_tier, label_class, count(*) AS n, count(folded) AS n_folded, count(topology) AS n_topology, count(tm) AS n_tm, count(ph_t) AS n_ph_t,
 count(DISTINCT sequence) AS n_unique_seq, count(DISTINCT k || '_' || na || '_' || li_nh4 || '_' || mg || '_' || ph) AS n_conditions FROM records GROUP BY ALL ORDER BY n DESC""")
def agg2(t):
    return atlas.summary(keyed(t)).orderBy(F.desc("n"))


@query("agg5_composition_deltas", "records", f"""
SELECT kind, round(avg(CASE WHEN folded = 1 THEN g END) - avg(CASE WHEN folded = 0 THEN g END), 5) AS delta_gc,
 round(avg(CASE WHEN folded = 1 THEN q END) - avg(CASE WHEN folded = 0 THEN q END), 5) AS delta_g, round(avg(CASE WHEN folded = 1 THEN n END) - avg(CASE WHEN folded = 0 THEN n END), 5) AS delta_len
FROM (SELECT kind, folded, ({d.count('sequence', 'G')} + {d.count('sequence', 'C')}) / length(sequence) AS g, {d.count('sequence', 'G')} / length(sequence) AS q, length(sequence) AS n FROM records) GROUP BY kind""")
def agg5(t):
    return composition_deltas(t.records, "sequence", F.col("folded") == 1, F.col("folded") == 0, ["kind"])


def composition_deltas(df, s, positive, negative, keys):
    gap = lambda x: F.round(F.avg(F.when(positive, x)) - F.avg(F.when(negative, x)), 5)
    n = F.greatest(F.length(s), F.lit(1))
    return df.groupBy(*keys).agg(gap(seq.gc(F.col(s))).alias("delta_gc"), gap(seq.count_of(s, "G") / n).alias("delta_g"),
                                 gap(F.length(s)).alias("delta_len"))


_QAX = list(condition.FIELDS)
_TRAIN = "tr_ AS (SELECT kind, sequence, k, na, li_nh4, mg, coalesce(ph, 7) AS ph, temperature, crowder_pct, strand_conc FROM records WHERE tm IS NOT NULL AND evidence_tier = 'experimental')"
_RANGE = _TRAIN + ", al_ AS (" + " UNION ALL ".join(
    [f"SELECT kind, '{f}' AS axis, {f} AS v FROM tr_" for f in _QAX] + ["SELECT kind, 'length', cast(length(sequence) AS double) FROM tr_"]) + """),
ap_ AS (SELECT kind, axis, min(v) AS lo, max(v) AS hi, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, count(DISTINCT round(v, 3)) AS n_unique FROM al_ GROUP BY ALL)"""


def ranges(t):
    train = t.records.where("tm IS NOT NULL AND evidence_tier = 'experimental'").withColumn("ph", F.coalesce("ph", F.lit(7.0)))
    return atlas.applicability(train.select("kind", "sequence", *_QAX), ["kind"])


@query("agg6_applicability", "records", _RANGE + "SELECT * FROM ap_")
def agg6(t):
    return ranges(t).withColumns({"p05": r6("p05"), "p95": r6("p95")})


@query("agg7_allow_lists", "records", """
h_ AS (SELECT concat('h', sk % 40, '_', pk % 50) AS head, sequence FROM records)
SELECT head, count(DISTINCT sequence) AS n, string_agg(DISTINCT sequence, ',' ORDER BY sequence) AS allowed FROM h_ GROUP BY head HAVING count(DISTINCT sequence) <= 20""")
def agg7(t):
    head = F.concat(F.lit("h"), (F.col("sk") % 40).cast("string"), F.lit("_"), (F.col("pk") % 50).cast("string"))
    distinct = t.records.select(head.alias("head"), "sequence").distinct()
    # count first, so that only the short lists are ever gathered
    short = distinct.groupBy("head").agg(F.count("*").alias("n")).where("n <= 20")
    return distinct.join(short, "head").groupBy("head", "n").agg(F.array_join(F.array_sort(F.collect_list("sequence")), ",").alias("allowed"))


_CHECK = _RANGE + ", q_ AS (SELECT seq_id, ln, pk, sequence, cast(qty * 10 AS double) AS k, na, li_nh4, cast(pk % 4 AS double) AS mg, 5 + (pk % 9) * 0.5::double AS ph, 37::double AS temperature, crowder_pct, cast(CASE WHEN pk % 2 = 0 THEN 7 ELSE 5 END AS double) AS strand_conc FROM records), ql_ AS (" + " UNION ALL ".join(
    [f"SELECT seq_id, ln, pk, '{f}' AS axis, {f} AS v FROM q_" for f in _QAX] + ["SELECT seq_id, ln, pk, 'length', cast(length(sequence) AS double) FROM q_"]) + """),
st_ AS (SELECT ap_.kind AS head, ql_.seq_id, ql_.ln, ql_.pk, ql_.axis, v, lo, hi, CASE WHEN ql_.axis = 'temperature' THEN NULL
   WHEN ql_.axis <> 'length' AND n_unique = 1 THEN CASE WHEN v <> lo THEN 'absence' END
   WHEN v < lo OR v > hi THEN CASE WHEN ql_.axis = 'length' THEN 'length' ELSE 'extrapolation' END
   WHEN ql_.axis <> 'length' AND n_unique <= 2 AND v <> lo AND v <> hi THEN 'unresolved' END AS state FROM ql_ JOIN ap_ ON ql_.axis = ap_.axis)
SELECT head, seq_id, st_.ln, pk, axis, state, CASE state WHEN 'absence' THEN lo WHEN 'extrapolation' THEN least(greatest(v, lo), hi) END AS suggested FROM st_ WHERE state IS NOT NULL"""


@query("prd1_domain_check", "records", _CHECK)
def prd1(t):
    q = t.records.select("seq_id", "ln", "pk", "sequence", (F.col("qty") * 10).cast("double").alias("k"), "na", "li_nh4",
                         (F.col("pk") % 4).cast("double").alias("mg"), (5 + (F.col("pk") % 9) * 0.5).alias("ph"),
                         F.lit(37.0).alias("temperature"), "crowder_pct", F.when(F.col("pk") % 2 == 0, 7.0).otherwise(5.0).alias("strand_conc"))
    out = atlas.domain_check(q, ["seq_id", "ln", "pk"], ranges(t).withColumnRenamed("kind", "head"), F.lit("tm"))
    return out.select("head", "seq_id", "ln", "pk", "axis", "state", "suggested")


@query("prd2_motif_gate", "oligos", f"""
SELECT seq_id, {d.mcount('o', 'G4')} = 0 AND {d.hunter_mean('o')} < 0.5 AS g4_outside, {d.mcount('o', 'iM')} = 0 AND {d.hunter_mean('o')} > -0.5 AS im_outside, false AS locus_outside FROM oligos""")
def prd2(t):
    gate = lambda k: atlas.motif_gate(F.lit(k), F.col("o"))
    return t.oligos.select("seq_id", gate("G4").alias("g4_outside"), gate("iM").alias("im_outside"), gate("locus").alias("locus_outside"))


# fixed values: folding heads whose answer on longer, genomic windows is refused
WINDOW_REFUSED = ["g4_fold", "g4_fold_genomic", "im_fold", "im_fold_genomic"]


@query("prd3_refusals", "oligos records", """
al_ AS (SELECT DISTINCT sequence FROM records WHERE ln = 1 AND evidence_tier = 'derived'),
h_(head, max_len, listed) AS (VALUES ('g4_fold', 31, false), ('g4_tm', 31, false), ('im_tm_condition', 100, true)),
x_ AS (SELECT seq_id, CASE WHEN seq_id % 41 = 0 THEN repeat('Z', 32) ELSE o END AS o FROM oligos)
SELECT x_.seq_id, head, CASE WHEN seq_id % 41 = 0 THEN 'no_nucleotides' WHEN listed AND al_.sequence IS NULL THEN 'not_in_allow_list'
  WHEN head = 'g4_fold' AND length(o) > max_len THEN 'genomic_window' END AS refusal FROM x_ JOIN h_ ON true LEFT JOIN al_ ON x_.o = al_.sequence""")
def prd3(t):
    heads = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(m).alias("max_len"), F.lit(x).alias("listed"))
                      for h, m, x in (("g4_fold", 31, False), ("g4_tm", 31, False), ("im_tm_condition", 100, True))])
    q = t.oligos.select("seq_id", seq.clean(F.when(F.col("seq_id") % 41 == 0, "Z" * 32).otherwise(F.col("o"))).alias("c"))
    allowed = t.records.where("ln = 1 AND evidence_tier = 'derived'").select(F.col("sequence").alias("c")).distinct().withColumn("known", F.lit(True))
    q = q.join(allowed, "c", "left").select("*", F.inline(heads))
    refusal = (F.when(F.col("c").rlike("^N+$"), "no_nucleotides").when(F.col("listed") & F.col("known").isNull(), "not_in_allow_list")
               .when(F.col("head").isin(*WINDOW_REFUSED) & (F.length("c") > F.col("max_len")), "genomic_window"))
    return q.select("seq_id", "head", refusal.alias("refusal"))


@query("prd4_readout", "records", """
SELECT seq_id, ln, pk, CASE WHEN pk % 10 = 0 THEN 'refused' WHEN tm IS NOT NULL THEN 'value' WHEN folded IS NOT NULL THEN 'probability' WHEN topology IS NOT NULL THEN 'class' ELSE 'absent' END AS state,
 CASE WHEN pk % 10 <> 0 THEN coalesce(tm, folded / 2) END AS number FROM records""")
def prd4(t):
    refused = F.col("pk") % 10 == 0
    state = (F.when(refused, "refused").when(F.col("tm").isNotNull(), "value").when(F.col("folded").isNotNull(), "probability")
             .when(F.col("topology").isNotNull(), "class").otherwise("absent"))
    return t.records.select("seq_id", "ln", "pk", state.alias("state"), F.when(~refused, F.coalesce("tm", F.col("folded") / 2)).alias("number"))


@query("prd5_axis_response", "records", _RANGE + """
SELECT kind AS head, axis, CASE WHEN axis = 'temperature' THEN 'predicts' WHEN n_unique <= 1 THEN 'fixed' ELSE 'varied' END AS state FROM ap_ WHERE axis <> 'length'""")
def prd5(t):
    state = F.when(F.col("axis") == "temperature", "predicts").when(F.col("n_unique").isNull(), "unknown").when(F.col("n_unique") <= 1, "fixed").otherwise("varied")
    return ranges(t).where("axis <> 'length'").select(F.col("kind").alias("head"), "axis", state.alias("state"))


@query("prd6_claim_semantics", "records", """
h_ AS (SELECT concat('h', seq_id % 5000, '_', pk % 4) AS head, bool_or(label_class = 'genomic_proxy') AS px, bool_or(evidence_tier = 'experimental') AS ex, bool_and(evidence_tier = 'predicted') AS pr FROM records GROUP BY ALL),
s_ AS (SELECT CASE WHEN px THEN 'genomic_proxy' WHEN pr THEN 'predicted' WHEN ex THEN 'biophysical' ELSE 'derived' END AS semantics FROM h_)
SELECT semantics, CASE WHEN semantics IN ('derived', 'predicted') THEN 'diagnostics' WHEN semantics = 'genomic_proxy' THEN 'genomic_context' ELSE 'sequence_evidence' END AS workspace, count(*) AS n_heads
FROM s_ GROUP BY ALL""")
def prd6(t):
    name = F.concat(F.lit("h"), (F.col("seq_id") % 5000).cast("string"), F.lit("_"), (F.col("pk") % 4).cast("string"))
    heads = t.records.groupBy(name.alias("head")).agg(
        F.collect_set("source").alias("sources"), F.collect_set("evidence_tier").alias("tiers"), F.collect_set("label_class").alias("labels"))
    s = atlas.semantics(F.col("sources"), F.col("tiers"), F.col("labels"))
    return heads.select(s.alias("semantics")).groupBy("semantics", atlas.workspace(F.col("semantics")).alias("workspace")).agg(F.count("*").alias("n_heads"))


_FP = ["sequence", "kind", "k", "na", "mg", "ph", "tm", "source"]


@query("agg19_table_fingerprint", "records", "SELECT count(*) AS n_rows, true AS order_free, true AS value_sensitive FROM records")
def agg19(t):
    """The contract of the fingerprint: unchanged by row order, changed by one value."""
    a = atlas.fingerprint(t.records, _FP)
    b = atlas.fingerprint(t.records.repartition(7, "tm"), _FP).select(F.col("fingerprint").alias("b"))
    changed = F.when((F.col("seq_id") == 5) & F.col("tm").isNotNull(), F.col("tm") + 0.01).otherwise(F.col("tm"))
    c = atlas.fingerprint(t.records.withColumn("tm", changed), _FP).select(F.col("fingerprint").alias("c"))
    j = ordered.attach(ordered.attach(a, b), c)
    return j.select("n_rows", (F.col("fingerprint") == F.col("b")).alias("order_free"), (F.col("fingerprint") != F.col("c")).alias("value_sensitive"))
