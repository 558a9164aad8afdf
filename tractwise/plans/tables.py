"""Input tables derived from the driver's Parquet files, as text valid on Spark and DuckDB."""

from pyspark.sql import DataFrame, SparkSession

_BASES = ("0123456789abcdef", "GGGGGGGGACCAATTT", "CCCCCCCCAGGAATTT")


def _dna(key, *salts):
    """Hash digits of a key turned into bases: G-rich for even keys, C-rich for odd."""
    digest = "concat(" + ", ".join(f"md5(concat('{s}', cast({key} AS {{str}})))" for s in salts) + ", '')"
    digits, g_rich, c_rich = _BASES
    return (f"CASE WHEN {key} % 2 = 0 THEN translate({digest}, '{digits}', '{g_rich}') "
            f"ELSE translate({digest}, '{digits}', '{c_rich}') END")


# view name -> (views or tables it reads, SQL text)
VIEWS = {
    "seqs": (["orders"], f"SELECT o_orderkey AS seq_id, {_dna('o_orderkey', 'a', 'b', 'c')} AS s FROM {{orders}}"),
    "oligos": (["orders"], f"SELECT o_orderkey AS seq_id, {_dna('o_orderkey', 'o')} AS o FROM {{orders}}"),
    # one measurement per line; lines 1-2 repeat an oligo in K+ and in Na+, later lines are one-base edits
    "records": (["lineitem", "oligos"], """
        SELECT seq_id, ln, pk, sk, ep, qty,
               CASE WHEN ln <= 2 THEN o
                    ELSE concat(substr(o, 1, p - 1), CASE WHEN substr(o, p, 1) = 'A' THEN 'T' ELSE 'A' END,
                                substr(o, p + 1)) END AS sequence,
               CASE WHEN seq_id % 2 = 0 THEN 'G4' ELSE 'iM' END AS kind,
               cast(CASE WHEN ln = 2 THEN 0 ELSE 100 END AS double) AS k,
               cast(CASE WHEN ln = 2 THEN 100 ELSE 0 END AS double) AS na,
               cast(0 AS double) AS li_nh4,
               cast(CASE WHEN pk % 5 = 0 THEN 2 ELSE 0 END AS double) AS mg,
               CASE WHEN pk % 11 = 0 THEN NULL ELSE cast(6 + (pk % 5) * 0.5 AS double) END AS ph,
               cast(25 AS double) AS temperature, cast(0 AS double) AS crowder_pct,
               cast(CASE WHEN sk % 3 = 0 THEN 10 ELSE 5 END AS double) AS strand_conc,
               CASE WHEN pk % 7 = 0 THEN NULL ELSE 20 + cast(floor(ep) % 7500 AS double) / 100 END AS tm,
               CASE WHEN pk % 3 = 0 THEN 4 + cast(floor(ep) % 400 AS double) / 100 END AS ph_t,
               CASE WHEN sk % 4 = 3 THEN NULL WHEN sk % 4 = 2 THEN 0 ELSE 1 END AS folded,
               CASE WHEN pk % 4 = 0 THEN 'parallel' WHEN pk % 4 = 1 THEN 'antiparallel'
                    WHEN pk % 4 = 2 THEN 'hybrid' END AS topology,
               CASE WHEN ls = 'F' THEN 'experimental' WHEN rf = 'R' THEN 'predicted' ELSE 'derived' END AS evidence_tier,
               CASE WHEN rf = 'A' THEN 'biophysical' WHEN rf = 'N' THEN 'catalog' ELSE 'genomic_proxy' END AS label_class,
               concat('src', cast(sk % 8 AS {str})) AS source,
               CASE WHEN pk % 13 = 0 THEN NULL ELSE concat('id', cast(pk AS {str})) END AS source_id
        FROM (SELECT l_orderkey, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS ep,
                     cast(l_quantity AS bigint) AS qty, 1 + (l_linenumber * 7) % 32 AS p,
                     l_returnflag AS rf, l_linestatus AS ls
              FROM {lineitem}) x
        JOIN {oligos} y ON x.l_orderkey = y.seq_id"""),
    "intervals": (["lineitem"], """
        SELECT concat('chr', cast(1 + l_suppkey % 5 AS {str})) AS chrom, cast(l_linenumber % 3 AS int) AS rep,
               (37 * l_orderkey + 11 * l_partkey) % 2000000 AS start_,
               (37 * l_orderkey + 11 * l_partkey) % 2000000 + 1 + cast(l_quantity AS bigint) AS end_,
               l_orderkey AS ok, l_partkey AS pk, l_extendedprice AS auc,
               CASE WHEN l_returnflag = 'A' THEN 'G4' ELSE 'iM' END AS target
        FROM {lineitem}"""),
    # coverage runs on a 10-nt lattice: touching runs are common, overlaps impossible
    "signal": (["lineitem"], """
        SELECT chrom, sample, 10 * slot AS start_, 10 * slot + CASE WHEN slot % 4 = 0 THEN 7 ELSE 10 END AS end_,
               max(1 + v) AS val
        FROM (SELECT concat('chr', cast(1 + l_suppkey % 5 AS {str})) AS chrom, cast(l_linenumber % 3 AS int) AS sample,
                     (7 * l_orderkey + l_partkey) % 40000 AS slot, cast(l_quantity AS bigint) % 20 AS v
              FROM {lineitem}) x
        GROUP BY chrom, sample, slot"""),
    # genome in 96-nt pieces, five chromosomes
    "genome": (["seqs"], """
        SELECT concat('chr', cast(1 + seq_id % 5 AS {str})) AS chrom,
               cast(floor(seq_id / 5) AS bigint) AS piece, s FROM {seqs}"""),
    # one SNV per line: position, bases, two scores (some absent)
    "snvs": (["lineitem"], """
        SELECT chrom, pos, ref, alt, motif_id, kind, state,
               CASE WHEN state = 'motif_lost' OR pk % 17 = 0 THEN NULL
                    ELSE cast(qty - 25 AS double) / 4 END AS delta,
               CASE WHEN pk % 5 = 0 THEN NULL ELSE cast(floor(ep) % 1000 AS double) / 1000 - 0.5 END AS score,
               cast(30 + pk % 50 AS double) / 100 AS gc, cast(ok % 3 = 0 AS int) AS cpg,
               CASE WHEN sk % 3 = 0 THEN 'flank' WHEN sk % 3 = 1 THEN 'motif' ELSE 'control' END AS set_
        FROM (SELECT concat('chr', cast(1 + l_suppkey % 5 AS {str})) AS chrom, l_orderkey * 10 + l_linenumber AS pos,
                     substr('ACGT', cast(1 + l_partkey % 4 AS int), 1) AS ref,
                     substr('ACGT', cast(1 + (l_partkey + 1 + l_orderkey % 3) % 4 AS int), 1) AS alt,
                     l_orderkey AS motif_id, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk,
                     CASE WHEN l_orderkey % 2 = 0 THEN 'G4' ELSE 'iM' END AS kind,
                     CASE WHEN l_tax < 0.02 THEN 'motif_lost' ELSE 'motif_retained' END AS state,
                     l_quantity AS qty, l_extendedprice AS ep
              FROM {lineitem}) x"""),
    # windows of the genome with the peaks of both targets that reach into them
    "locus_windows": (["genome", "intervals"], """
        SELECT g.chrom, g.piece, s AS sequence,
               CASE WHEN n_g4 > 0 AND n_im > 0 THEN 'both' WHEN n_g4 > 0 THEN 'g4_only' WHEN n_im > 0 THEN 'im_only' ELSE 'neither' END AS state
        FROM {genome} g LEFT JOIN (
          SELECT chrom, piece, sum(CASE WHEN target = 'G4' THEN 1 ELSE 0 END) AS n_g4, sum(CASE WHEN target = 'iM' THEN 1 ELSE 0 END) AS n_im
          FROM (SELECT chrom, target, cast(floor(start_ / 96) AS bigint) AS piece FROM {intervals}
                UNION ALL
                SELECT chrom, target, cast(floor((end_ - 1) / 96) AS bigint) AS piece FROM {intervals}
                WHERE floor((end_ - 1) / 96) > floor(start_ / 96)) x
          GROUP BY chrom, piece) y ON g.chrom = y.chrom AND g.piece = y.piece"""),
    # labelled rows of all kinds, one id each
    "training": (["records", "locus_windows"], """
        SELECT concat('r', cast(seq_id AS {str}), ':', cast(ln AS {str}), ':', cast(pk AS {str}), ':', cast(sk AS {str}), ':', cast(qty AS {str})) AS record_id, sequence, kind,
               k, na, li_nh4, mg, ph, temperature, crowder_pct, strand_conc, tm, ph_t, folded, topology, evidence_tier, label_class, source
        FROM {records}
        UNION ALL
        SELECT concat('w', chrom, ':', cast(piece AS {str})), sequence, 'locus', 100.0, 0.0, 0.0, 0.0, cast(NULL AS double), 25.0, 0.0, 5.0,
               cast(NULL AS double), cast(NULL AS double), cast(NULL AS int), state, 'derived',
               CASE WHEN state = 'neither' THEN 'catalog' ELSE 'genomic_proxy' END, CASE WHEN state = 'neither' THEN 'locus_shuffled' ELSE 'locus' END
        FROM {locus_windows}"""),
    # held-out predictions of a classifier and of a regressor
    "preds": (["lineitem"], """
        SELECT l_orderkey AS ok, l_linenumber AS ln, l_orderkey % 97 AS grp,
               CASE WHEN (l_partkey + cast(l_quantity AS bigint) * 7) % 100 < 2 * l_quantity THEN 1 ELSE 0 END AS y,
               cast(floor(l_extendedprice / 100) % 50 AS double) / 100 + l_quantity / 100 AS p,
               20 + cast(floor(l_extendedprice) % 7500 AS double) / 100 AS y_real,
               20 + cast(floor(l_extendedprice) % 7500 AS double) / 100 + l_quantity - 25 AS y_hat,
               concat('head', cast(l_suppkey % 4 AS {str})) AS head
        FROM {lineitem}"""),
}


def with_sql(names, body):
    """DuckDB text: the derived tables named as common table expressions, then the body."""
    needed = []

    def visit(name):
        for dep in VIEWS[name][0]:
            if dep in VIEWS:
                visit(dep)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        visit(name)
    fill = {n: n for n in ("orders", "lineitem", *VIEWS)} | {"str": "varchar"}
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1].format(**fill)})" for n in needed)
    joint = "" if body.lstrip().upper().startswith("SELECT") else ","
    return f"WITH RECURSIVE {ctes}{joint}\n{body}"


class Tables:
    """The driver's tables and the derived views, as DataFrames read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def _dealt(self, name) -> DataFrame:
        """A base table as its derived rows are made: orders, one row group, has its keys dealt out first."""
        df = getattr(self, name)
        if name != "orders":
            return df
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return df.select("o_orderkey").repartition(parts, "o_orderkey")

    def _view(self, name) -> DataFrame:
        deps, text = VIEWS[name]
        return self.spark.sql(text.replace("{str}", "string"), **{d: self._dealt(d) for d in deps})

    def __getattr__(self, name) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._view(name) if name in VIEWS else self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]
