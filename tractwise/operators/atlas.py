"""Queries over the measurement table: filters, composition, ranges, applicability, fingerprints."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import condition, motif, seq
from . import ordered

AXES = list(condition.FIELDS) + ["length"]


def select(df: DataFrame, kind=None, tiers=None, label_classes=None, sources=None, label=None, limit=None, order=None):
    """AND of the given restrictions; a limit needs an explicit order to mean anything."""
    if kind:
        df = df.where(F.col("kind") == kind)
    for column, values in (("evidence_tier", tiers), ("label_class", label_classes), ("source", sources)):
        if values:
            df = df.where(F.col(column).isin(*values))
    if label:
        df = df.where(F.col(label).isNotNull())
    return df.orderBy(*order).limit(limit) if limit else df


def bucket():
    return (F.when(F.col("label_class") == "genomic_proxy", "genomic_proxy")
            .when((F.col("evidence_tier") == "experimental") & (F.col("label_class") == "biophysical"), "biophysical_measured")
            .when(F.col("evidence_tier") == "predicted", "predicted").otherwise("derived_or_shuffle"))


def summary(df: DataFrame) -> DataFrame:
    """Counts per (source, kind, tier, class). A buffer with a missing part is not a distinct buffer."""
    keys = ["source", "kind", "evidence_tier", "label_class"]
    buffer = F.concat(*[x for f in ("k", "na", "li_nh4", "mg", "ph") for x in (F.col(f).cast("string"), F.lit("_"))])
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in ("folded", "topology", "tm", "ph_t")],
        F.countDistinct("seq_hash").alias("n_unique_seq"), F.countDistinct(buffer).alias("n_conditions"))


def applicability(df: DataFrame, keys) -> DataFrame:
    """Per head and axis: min, max, exact 5th and 95th percentile, distinct values after rounding."""
    long = df.withColumn("length", F.length("sequence").cast("double")).unpivot(list(keys), AXES, "axis", "value")
    keys = [*keys, "axis"]
    edges = ordered.exact_quantiles(long, "value", [0.05, 0.95], keys)
    ranges = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                     F.countDistinct(F.round("value", 3)).alias("n_unique"))
    return ranges.join(edges, keys).select(*keys, "lo", "hi", F.col("q0").alias("p05"), F.col("q1").alias("p95"), "n_unique")


def domain_check(queries: DataFrame, ids, table: DataFrame, target) -> DataFrame:
    """Per query, head and axis outside what the head learned: state and the value that would be inside.

    `table` holds one row per head and axis. The axis a head predicts is exempt.
    """
    long = queries.withColumn("length", F.length("sequence").cast("double")).unpivot(list(ids), AXES, "axis", "value")
    j = long.join(F.broadcast(table), "axis")  # heads x nine axes
    exempt = ((F.col("axis") == "ph") & (target == "ph_t")) | ((F.col("axis") == "temperature") & (target == "tm"))
    single = F.col("n_unique") == 1
    beyond = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    state = (F.when(exempt, F.lit(None))
             .when((F.col("axis") != "length") & single, F.when(F.col("value") != F.col("lo"), "absence"))
             .when(beyond, F.when(F.col("axis") == "length", "length").otherwise("extrapolation"))
             .when((F.col("axis") != "length") & (F.col("n_unique") <= 2) & ~F.col("value").isin(F.col("lo"), F.col("hi")), "unresolved"))
    move = F.when(state == "absence", F.col("lo")).when(state == "extrapolation", F.least(F.greatest("value", "lo"), "hi"))
    return j.withColumns({"state": state, "suggested": move}).where("state IS NOT NULL")


def motif_gate(kind, s):
    """True when a head is asked about a sequence class it was never trained on."""
    mean = seq.hunter_mean(s)
    return (F.when(kind == "G4", ~motif.has_motif(s, "G4") & (mean < 0.5))
            .when(kind == "iM", ~motif.has_motif(s, "iM") & (mean > -0.5)).otherwise(F.lit(False)))


def semantics(sources, tiers, labels):
    """What a head's label is, from where its rows came from; order of the rules matters."""
    proxy = F.exists(sources, lambda s: s.rlike("^(shuffled::)?gse220882")) | F.array_contains(labels, "genomic_proxy")
    return (F.when(proxy, "genomic_proxy").when(F.array_contains(tiers, "synthetic"), "synthetic")
            .when((F.size(tiers) == 1) & F.array_contains(tiers, "predicted"), "predicted")
            .when(F.array_contains(tiers, "experimental"), "biophysical").otherwise("derived"))


def workspace(semantics_col):
    return (F.when(semantics_col.isin("synthetic", "derived", "predicted"), "diagnostics")
            .when(semantics_col == "genomic_proxy", "genomic_context").otherwise("sequence_evidence"))


def fingerprint(df: DataFrame, columns, prefix: int = 2) -> DataFrame:
    """One sha256 over all rows, independent of their order and sensitive to any value.

    Row digests are combined through bounded steps: equal rows become one
    (digest, count), digests are summed per digest prefix as four wide integer
    sums, and only the 16^prefix prefix lines are ordered and hashed.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    rows = df.select(F.sha2(F.concat_ws("\u001f", *parts), 256).alias("h"))
    piece = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    lines = rows.groupBy(F.substring("h", 1, prefix).alias("p")).agg(
        F.count("*").alias("n"), *[F.sum(piece(i)).alias(f"s{i}") for i in range(4)])
    text = F.concat_ws(":", "p", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return lines.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("fingerprint"))
