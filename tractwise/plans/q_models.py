"""Training, calibration, scoring and scan jobs."""

from pyspark.sql import functions as F

from ..functions import features
from ..operators import models, ordered, stats
from ..session import cut_lineage
from .q_sequences import r6
from .registry import query

@query("ml3_binary_calibration", "preds", "SELECT count(*) AS n, true AS in_range, true AS calibrated_no_worse FROM preds")
def ml3(t):
    out, kept = models.calibrate_binary(t.preds.select("ok", "y", "p"), "ok", "y", "p")
    before = stats.calibration_error(stats.reliability(t.preds.withColumn("q", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))), "y", "q")).select(F.col("ece").alias("e0"))
    after = stats.calibration_error(stats.reliability(out, "y", kept)).select(F.col("ece").alias("e1"))
    n = out.agg(F.count("*").alias("n"), F.bool_and(F.col(kept).between(0, 1)).alias("in_range"))
    return ordered.attach(ordered.attach(n, before), after).select("n", "in_range", (F.col("e1") <= F.col("e0") + 0.02).alias("calibrated_no_worse"))


@query("ml3_temperature_scaling", "preds", "SELECT count(*) AS n, true AS argmax_kept, true AS likelihood_no_worse FROM preds")
def ml3_temperature(t):
    raw = t.preds.select(((F.col("ok") + F.col("ln")) % 3).cast("int").alias("y"), F.array(1 + F.col("p"), 1 + (F.col("y_real") - 20) / 75, F.lit(1.2)).alias("a"))
    x = raw.withColumn("post", F.transform("a", lambda v: v / F.aggregate("a", F.lit(0.0), lambda s, w: s + w))).select("y", "post")
    temp = models.temperature(x, "y", "post")
    powers = x.withColumn("w", F.transform("post", lambda v: F.pow(v, F.lit(1 / temp))))
    x = powers.withColumn("scaled", F.transform("w", lambda v: v / F.aggregate("w", F.lit(0.0), lambda s, u: s + u)))
    first = F.array_position("post", F.array_max("post")).cast("int")
    nll = lambda c: -F.log(F.get(c, F.col("y")))
    return x.agg(F.count("*").alias("n"), F.bool_and(F.get("scaled", first - 1) >= F.array_max("scaled") - 1e-12).alias("argmax_kept"),
                 (F.avg(nll("scaled")) <= F.avg(nll("post")) + 1e-9).alias("likelihood_no_worse"))


@query("ml3_isotonic_steps", "preds", """
c_ AS (SELECT head, p, count(*) AS n, sum(y) AS s, row_number() OVER (PARTITION BY head ORDER BY p) AS i FROM preds GROUP BY head, p),
k_ AS (SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM c_ WINDOW w AS (PARTITION BY head ORDER BY p)),
m_ AS (SELECT a.head, a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::double / (b.cn - a.cn + a.n)::double AS v FROM k_ a JOIN k_ b ON a.head = b.head AND b.i >= a.i),
l_ AS (SELECT head, a, b AS i, min(v) OVER (PARTITION BY head, a ORDER BY b DESC) AS v FROM m_),
f_ AS (SELECT head, i, max(v) AS v FROM l_ GROUP BY head, i)
SELECT head, round(min(p), 6) AS low, round(max(p), 6) AS high, cast(sum(n) AS bigint) AS n, cast(sum(s) AS bigint) AS positives FROM f_ JOIN c_ USING (head, i) GROUP BY head, round(v, 12)""")
def ml3_isotonic(t):
    """Steps of the isotonic fit per tool."""
    return stats.isotonic(t.preds, "p", "y", ["head"]).select("head", r6("low").alias("low"), r6("high").alias("high"), "n", "positives")


SCANNER_ROWS, SCANNER_SEEDS, HELD_OUT = 3_000, 3, "chr2"  # rows a scanner is fitted on (a documented bound), members, test chromosome


def scanner_windows(t):
    """Genome windows with their chromosome; positive where a peak of the G4 target reaches in."""
    return t.locus_windows.select("chrom", "piece", F.col("sequence").alias("s"), F.col("state").isin("both", "g4_only").cast("int").alias("y"))


def scanner(t):
    """(members fitted off the held-out chromosome, isotonic steps from chromosome-grouped held-out answers).

    One job: a task per member and chromosome left out, and one per member on all training rows.
    """
    import numpy as np
    import pandas as pd

    from ..operators import boosting
    train = scanner_windows(t).where(F.col("chrom") != HELD_OUT)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "chrom", F.col("piece").cast("string"))), 1, 8), 16, 10).cast("bigint")
    n = train.count()
    train = train.where(draw < F.lit(4294967296 * min(1.0, SCANNER_ROWS / max(n, 1))))
    names = features.window_feature_names()
    x = features.with_window_features(train, "s").select("chrom", "piece", "y", F.array(*[F.col(c).cast("float") for c in names]).alias("x"))
    x = cut_lineage(x)
    chroms = sorted(r[0] for r in x.select("chrom").distinct().collect())  # chromosome names
    parts = [(s, c) for s in range(SCANNER_SEEDS) for c in (*chroms, "")]
    x = x.withColumn("part", F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(c).alias("out")) for s, c in parts]))).select("*", "part.seed", "part.out").drop("part")

    def work(frame):
        frame = frame.sort_values(["chrom", "piece"])
        seed, out = int(frame["seed"].iloc[0]), frame["out"].iloc[0]
        full, y, held = np.stack(frame["x"].to_numpy()), frame["y"].to_numpy(), (frame["chrom"] == out).to_numpy()
        model = boosting.fit(full[~held], y[~held], "binary", 2, seed)
        if not out:
            return pd.DataFrame({"chrom": [None], "piece": [None], "y": [None], "p": [None], "model": [boosting.packed(model)]})
        p = boosting.evaluate(model, full[held], "binary")[:, 0]
        return pd.DataFrame({"chrom": frame["chrom"][held], "piece": frame["piece"][held], "y": y[held], "p": p, "model": [None] * int(held.sum())})

    fitted = cut_lineage(x.groupBy("seed", "out").applyInPandas(work, "chrom string, piece bigint, y int, p double, model binary"))
    models = [boosting.unpacked(bytes(r["model"])) for r in fitted.where("model IS NOT NULL").collect()]  # three members
    oof = fitted.where("model IS NULL").groupBy("chrom", "piece", "y").agg(F.avg("p").alias("p"))
    return models, cut_lineage(stats.isotonic(oof, "p", "y"))


def scanned(windows, models, steps):
    """Append score (mean of the members) and its calibrated value to windows (chrom, piece, s, y)."""
    import numpy as np
    import pyarrow as pa

    from ..operators import boosting
    names = features.window_feature_names()
    x = features.with_window_features(windows, "s").select("chrom", "piece", "y", F.array(*[F.col(c).cast("float") for c in names]).alias("x"))

    def score(batches):
        for batch in batches:
            full = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            p = np.mean([boosting.evaluate(m, full, "binary")[:, 0] for m in models], axis=0) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["chrom", "piece", "y", "score"])

    out = x.mapInArrow(score, "chrom string, piece bigint, y int, score double")
    return stats.calibrated(out, "score", steps, "p")


_HELD = """h_ AS (SELECT chrom, count(*) AS n, count_if(state IN ('both', 'g4_only')) AS n_pos FROM locus_windows WHERE chrom = 'chr2' GROUP BY chrom)"""


@query("ml4_window_scanner", "locus_windows", _HELD + """
SELECT chrom, n, cast(n_pos AS bigint) AS n_pos, n AS n_scored, n AS n_calibrated, true AS order_kept FROM h_""")
def ml4(t):
    """Every window of the held-out chromosome scored and calibrated; calibration never turns the order of scores."""
    out = cut_lineage(scanned(scanner_windows(t).where(F.col("chrom") == HELD_OUT), *scanner(t)))
    levels = out.groupBy("chrom", "p").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    ranks = ordered.value_ranks(out, "score", ["chrom"]).select("chrom", "score", "below")  # scores in order
    down = out.select("chrom", "score", "p").distinct().join(ranks, ["chrom", "score"])
    kept = down.groupBy("chrom").agg((F.regr_slope(F.col("p"), F.col("below").cast("double")) >= 0).alias("order_kept"))
    n = out.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("n_pos"), F.count_if(F.col("score").between(0, 1)).alias("n_scored"),
                                 F.count_if(F.col("p").between(0, 1)).alias("n_calibrated"))
    return n.join(kept, "chrom")


@query("ml4_scanner_metrics")
def ml4_metrics(t):
    """Held-out quality of the scanner: AUROC, AUPRC, Brier score and calibration error."""
    out = cut_lineage(scanned(scanner_windows(t).where(F.col("chrom") == HELD_OUT), *scanner(t)))
    rank = stats.ranking_metrics(out, "y", "score", ["chrom"])
    brier = out.groupBy("chrom").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return rank.join(brier, "chrom").join(stats.calibration_error(stats.reliability(out, "y", "p", ["chrom"]), ["chrom"]), "chrom")


@query("ml6_paired_deltas", "preds", """
SELECT head, ok, round(avg(round(y_hat - y_real, 6)), 3) AS delta, round(stddev_pop(round(y_hat - y_real, 6)), 3) AS delta_sd, count(*) AS n_members FROM preds GROUP BY ALL""")
def ml6(t):
    df = t.preds.withColumns({"w": F.lit(0.0), "m": F.round(F.col("y_hat") - F.col("y_real"), 6)})
    return models.paired_deltas(df, ["head", "ok"], "w", "m")
