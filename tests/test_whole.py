"""Heads fitted on every labelled row, against the fit that holds its rows in memory; scans and ranks that touch fewer rows."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tractwise.functions import features, motif, seq, variant
from tractwise.operators import boosting, heads, models, motifs
from tractwise.plans import q_heads, q_stats


@pytest.mark.parametrize("task", ["regression", "binary", "multiclass"])
def test_trees_of_stored_rows_equal_trees_of_rows_in_memory(tmp_path, task):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])
    y = x[:, 0] + np.sin(3 * x[:, 1]) + 0.1 * rng.normal(size=900)
    y = {"regression": y, "binary": (y > 0).astype(float), "multiclass": np.digitize(y, [-1, 1]).astype(float)}[task]
    fold = np.arange(900) % 4
    want = boosting.fit(x[fold != 1], y[fold != 1], task, 3, 2, 6)
    cuts = np.quantile(x[fold != 1], np.linspace(0, 1, boosting.BINS + 1)[1:-1], axis=0).astype(np.float32).T
    known = [np.unique(np.r_[c, 0.25, -0.25]) for c in cuts]    # codes of more cut points than this fit has
    codes = np.stack([np.searchsorted(k, x[:, j], "left") for j, k in enumerate(known)], axis=1).astype(np.uint8)
    bins = [np.searchsorted(c, np.r_[k, np.inf], "left").astype(np.uint8) for c, k in zip(cuts, known)]
    rows = boosting.Stored(str(tmp_path), 12)
    for low in range(0, 900, 250):
        rows.add(codes[low:low + 250], y[low:low + 250], fold[low:low + 250])
    rows.close()
    model, score = rows.fit(cuts, bins, 1, task, 3, 2, 6)
    assert np.array_equal(model["feature"], want["feature"]) and np.array_equal(model["threshold"], want["threshold"])
    assert np.allclose(model["leaf"], want["leaf"], atol=1e-6)
    assert np.allclose(boosting.posterior(np.array(score), task), boosting.evaluate(want, x, task), atol=1e-5)


def test_whole_fit_answers_every_row_as_the_fit_in_memory_does(spark):
    rng = random.Random(8)
    rows = []
    for i in range(420):
        s = "".join(rng.choice("GGGTACT") for _ in range(rng.choice([21, 26, 32])))
        rows.append(("a", "G4", "regression", "sequence", 2, f"r{i:03d}", s, 0, float(s.count("G")) + rng.random(), i % 5))
        if i < 150:
            rows.append(("b", "iM", "binary", "sequence", 1, f"q{i:03d}", s, 0, float(i % 2), i % 3))
    placed = spark.createDataFrame(rows, "head string, kind string, task string, group_by string, members int, record_id string, sequence string, n_classes int, label double, fold int")
    placed = heads.with_defaults(placed).withColumn("group_id", F.col("sequence")).repartition(5)
    both = [heads.out_of_fold(f).collect() for f in (heads.fit(placed, None), heads.fit_whole(placed))]
    a, b = ({(r["head"], r["record_id"]): np.array(r["members"]) for r in x} for x in both)
    assert len(b) == 570 and a.keys() == b.keys()
    assert all(a[k].shape == b[k].shape for k in a)
    off = [np.abs(a[k] - b[k]).max() for k in a]
    assert np.median(off) < 1e-4                    # equal gains of twin features may be settled the other way
    assert heads.fit_whole(placed).where("model IS NOT NULL").count() == 3


def test_heads_without_a_bound_are_fitted_on_all_rows(spark):
    rows = [(f"r{i}", "a") for i in range(heads.MAX_ROWS + 300)] + [("z", "few"), (None, "a")]   # a row without an id is no record, bounded or not
    rows = spark.createDataFrame(rows, "record_id string, head string")
    assert heads.sampled(rows, None).count() == heads.MAX_ROWS + 300
    assert heads.sampled(rows.where("head = 'few'"), None).isEmpty()
    for name in ("ml2_out_of_fold", "ml2_out_of_fold_classes"):
        assert str(heads.MAX_ROWS) not in q_heads.WHOLE_SQL, name


def test_edits_searched_anew_are_all_that_can_change_a_motif(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("GGGGGGCCCCCCTAU"[: 14 if i % 3 else 15]) for _ in range(26)) for i in range(60)]
    texts += ["GGGNGGGTGGGTGGGA", "GGGTGGGTGGGTGG", "CCCACCCUCCCTCC", "GGGGGGGGGGGGGGGGG", "CCCnCCCTTCCCTTCCC"]
    for kind in ("G4", "iM"):
        df = spark.createDataFrame([(s,) for s in texts], "s string").withColumns({
            "before": motif.motif_count("s", kind), "other": motif.has_motif(seq.revcomp("s"), kind)})
        e = motifs.substitutions(df, ["before", "other"], "s").select(
            motif.motif_count("mutant", kind).alias("a"), motifs.count_after("before", "wt", "alt", "mutant", kind).alias("b"),
            (~F.col("other") & motif.has_motif(seq.revcomp("mutant"), kind)).alias("c"), motifs.other_strand_gain("other", "wt", "alt", "mutant", kind).alias("d"))
        got = e.agg(F.count_if(F.expr("a <> b OR c <> d")), F.count_if("c"), F.count_if(F.expr("a > 0")), F.count_if(F.expr("b IS NULL OR d IS NULL"))).first()
        assert got[0] == 0 and got[1] > 0 and got[2] > 0 and got[3] == 0


def test_only_edits_with_a_number_reach_the_tasks_that_score(spark):
    class Model:
        models, specs, asked = {"h": [], "g": []}, {"h": ("h", "G4", "regression"), "g": ("g", "G4", "binary")}, []

        def deltas(self, df, heads, wild, asked, keep=None):
            self.asked.append(df.count())
            return df.select(*keep, F.explode(F.array(*map(F.lit, heads))).alias("head"), F.lit(1.0).alias("delta"), F.lit(0.0).alias("delta_sd"))

    model = Model()
    df = spark.createDataFrame([(1, "GGGTGGGTGGGTGGGA"), (2, "GGGTATATATATATATAT"), (3, "GGATGGGTGGGTGGGA"), (4, None), (5, "")], "seq_id int, s string")
    out = heads.mutation_scan(model, df, "seq_id", "s", models.routed, motifs.substitutions, variant.motif_state)
    got = {(r["head"], r["state"]): (r["n"], r["m"]) for r in out.groupBy("head", "state").agg(F.count("*").alias("n"), F.count("delta").alias("m")).collect()}
    scored = 3 * 16 - 36 + 1                    # all but the tracts' edits of the first, the edit that completes the third
    assert model.asked == [scored]
    for head in "gh":
        assert got[head, "motif_lost"] == (36, 0) and got[head, "motif_retained"] == (12, 12) and got[head, "motif_gained"] == (1, 1)
        assert got[head, "no_motif"] == (3 * 18 + 3 * 16 - 1, 0)


def test_within_sequence_ranks_take_one_exchange(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"h{i % 2}", int(rng.integers(25)), float(rng.integers(5)), float(rng.integers(4))) for i in range(400)]
    rows += [("h0", 99, None, 1.0), ("h0", 99, 1.0, None), ("h0", 99, 2.0, 2.0), ("h0", 99, 3.0, 3.0), ("h0", 99, 4.0, 1.0), (None, 1, 1.0, 1.0), ("h1", None, 1.0, 1.0)]
    preds = spark.createDataFrame(rows, "head string, ok int, y_real double, y_hat double").repartition(4)
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df
    monkeypatch.setattr(q_stats, "cut_lineage", kept)
    got = {r["head"]: r for r in q_stats.rnk5(SimpleNamespace(preds=preds)).collect()}
    frame = pd.DataFrame(rows, columns=["head", "ok", "y", "p"]).dropna(subset=["head", "ok"])
    for head, of in frame.groupby("head"):
        rho, off, whole = [], 0.0, 0.0
        for _, x in of.groupby("ok"):
            if len(x) >= 4 and x["y"].nunique() >= 3:
                both = pd.DataFrame({"y": x["y"].rank(), "p": x["p"].rank()}).dropna()
                rho.append(0.0 if x["p"].nunique() < 2 else np.corrcoef(both["y"], both["p"])[0, 1])
                dy, dp = x["y"] - x["y"].mean(), x["p"] - x["p"].mean()
                off, whole = off + ((dy - dp) ** 2).sum(), whole + (dy * dy).sum()
        assert got[head]["n_sequences"] == len(rho) and abs(got[head]["median_rho"] - np.median(rho)) < 1e-5
        assert abs(got[head]["r2_centred"] - (1 - off / whole)) < 1e-6
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_window_vectors_of_batches_equal_the_expressions(spark):
    rng = random.Random(9)
    texts = [None, "", "G", "NNNN", "gggtttgggaaagggtttggg", "GGGNNNGGGTGGGTGGGA", "CCCTCCCTCCCTCCC", "G" * 30]
    texts += ["".join(rng.choice("GGGGGGGGACCAATTT" if i % 2 else "CCCCCCCCAGGAATTTN") for _ in range(rng.choice([7, 25, 26, 40, 96]))) for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").repartition(4)
    got = features.with_window_features(df, "s")
    assert "_first" in got._jdf.queryExecution().analyzed().toString()          # one array a batch
    forward = seq.hunter_sum("s") >= 0
    sides = {"first": F.when(forward, F.col("s")).otherwise(seq.revcomp("s")), "second": F.when(forward, seq.revcomp("s")).otherwise(F.col("s"))}
    got = {r["id"]: r for r in got.collect()}
    for side, text in sides.items():
        names = [n for n in features.NAMED + features.KMERS_NAMED if side == "first" or n not in features.KMERS_NAMED]
        want = features.with_sequence_features(df.select("id", text.alias("x")), "x", "G4").collect()
        for r in want:
            for n in names:
                a, b = r[n], got[r["id"]][f"{side}_{n}"]
                assert (a is None and b is None) or abs(a - b) < 1e-12, (texts[r["id"]], side, n, a, b)
