"""Fits, folds, manifests, byte-range reading and resampled tables against plain versions on small data."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractwise.functions import condition
from tractwise.operators import boosting, manifest, motifs, overlap, splits, stats
from tractwise.sources import readers, writers


# --------------------------------------------------------------------- folds
def placed_one_by_one(groups, k):
    """{group: fold}: sequential placement by squared shares, whole numbers throughout."""
    totals = [max(1, sum(v[i] for v in groups.values())) for i in range(len(next(iter(groups.values()))))]
    weight = [math.prod(t * t for t in totals) // (t * t) for t in totals]
    loads, out = [[0] * len(totals) for _ in range(k)], {}
    order = sorted(groups, key=lambda g: (-(len(totals) * sum(x * x for x in groups[g]) - sum(groups[g]) ** 2), -sum(groups[g]), [-x for x in groups[g]], g))
    for g in order:
        v = groups[g]
        best = min(range(k), key=lambda f: (sum(x * y * w for x, y, w in zip(loads[f], v, weight)), sum(loads[f]), f))
        loads[best] = [x + y for x, y in zip(loads[best], v)]
        out[g] = best
    return out


@pytest.mark.parametrize("seed", range(6))
def test_placements_equal_one_by_one(seed):
    rng = random.Random(seed)
    width, k = rng.randrange(1, 4), rng.randrange(2, 6)
    kinds = [tuple(rng.randrange(4) for _ in range(width)) for _ in range(6)]
    groups = {g: v for g in range(400) if sum(v := rng.choice(kinds))}
    classes = Counter(groups.values())
    members = {v: sorted(g for g in groups if groups[g] == v) for v in classes}
    got = {}
    for v, first, stop, folds in splits.placements(list(classes.items()), k):
        for i in range(first, stop):
            got[members[v][i]] = folds[(i - first) % len(folds)]
    assert got == placed_one_by_one(groups, k)


def test_manifest_goes_stale_with_one_row(spark):
    rows = spark.createDataFrame([("a", f"r{i}", i // 3, i % 2) for i in range(90)] + [("b", f"r{i}", i, 0) for i in range(50)] + [("few", "x", 1, 1)],
                                 "head string, record_id string, group_id int, y int")
    held, meta = manifest.build(rows, "y", provenance="historical")
    assert {r["head"] for r in meta.collect()} == {"a", "b"}  # below the least number of rows a head has no entry
    per = held.groupBy("head", "record_id").agg(F.count("*").alias("n"), F.count("fold").alias("f")).where("n <> 1 or f <> 1")
    assert per.count() == 0 and held.groupBy("head", "group_id").agg(F.countDistinct("fold").alias("f")).where("f > 1").count() == 0
    state = lambda df: {r["head"]: (r["state"], r["usable"]) for r in manifest.states(meta, manifest.fingerprints(df, "head", ["record_id"])).collect()}
    assert state(rows) == {"a": ("historical", True), "b": ("historical", True), "few": ("missing", False)}
    assert state(rows.repartition(5, "record_id")) == state(rows)
    changed = rows.withColumn("record_id", F.when((F.col("head") == "a") & (F.col("record_id") == "r7"), "other").otherwise(F.col("record_id")))
    assert state(changed) == state(rows) | {"a": ("stale", False)}
    assert state(rows.unionByName(rows.where("head = 'b'").limit(1))) == state(rows) | {"b": ("stale", False)}


# --------------------------------------------------------------------- FASTA
@pytest.mark.parametrize("split", [40, 97, 1_000, 1 << 20])
def test_fasta_at_every_split_size(spark, tmp_path, split):
    rng = random.Random(split)
    wanted = {"c1": 5_000, "empty": 0, "c2": 333, "last": 64}
    wanted = {k: "".join(rng.choice("ACGTacgtN") for _ in range(n)) for k, n in wanted.items()}
    lines = []
    for name, s in wanted.items():
        lines.append(f">{name} a > mark inside")
        lines += [s[i:i + 61] for i in range(0, len(s), 61)] + [""] * (name == "c2")
    (tmp_path / "a.fa").write_text("\n".join(lines[:60]) + "\n")
    (tmp_path / "b.fa").write_text("\r\n".join([">solo", "ACGT" * 50, "TT"]))
    (tmp_path / "a.fa").write_text("\n".join(lines) + "\n")
    wanted["solo"] = "ACGT" * 50 + "TT"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        pieces = readers.fasta_pieces(spark, str(tmp_path), 100).collect()
        lengths = {r["id"]: r["length"] for r in readers.fasta_lengths(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert lengths == {k: len(s) for k, s in wanted.items()}
    assert {(r["chrom"], r["piece"]): r["s"] for r in pieces} == {(k, i // 100): s[i:i + 100].upper() for k, s in wanted.items() for i in range(0, len(s), 100)}


def test_fasta_refuses_a_name_twice(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\n>x again\nA\n")
    with pytest.raises(ValueError, match="x"):
        readers.fasta_pieces(spark, str(tmp_path))


def test_genome_hits_do_not_depend_on_pieces(spark):
    rng = random.Random(4)
    genome = "".join(rng.choice("GGGGACCTC") for _ in range(6_000))
    found = []
    for size in (96, 250, 6_000):
        rows = [("c", i // size, genome[i:i + size]) for i in range(0, len(genome), size)]
        hits = motifs.genome_hits(spark.createDataFrame(rows, "chrom string, piece bigint, s string"), size)
        found.append(sorted(tuple(r) for r in hits.select("start", "end", "strand", "kind", "text").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 20


# ------------------------------------------------------------ scores, bundles
def test_bundle_reads_only_its_region(spark, tmp_path):
    rows = [(f"chr{c}", p, "A", "G", p / 10) for c in (1, 2, 22) for p in range(0, 50_000, 50)] + [("2", 1_025, "A", "G", 0.5), ("chr2", 1_030, "AT", "G", 0.5)]
    readers.write_bundle(spark.createDataFrame(rows, "chrom string, pos bigint, ref string, alt string, score double"), f"{tmp_path}/b")
    df = readers.read_bundle(spark, f"{tmp_path}/b", "2", 1_000, 12_000)
    assert sorted(r["pos"] for r in df.collect()) == sorted([*range(1_000, 12_001, 50), 1_025])
    plan = df._jdf.queryExecution().explainString(df._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if hasattr(df, "_jvm") else df._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and re.search(r"PushedFilters: \[[^\]]*pos", plan)
    assert len({f.rsplit("/", 1)[0] for f in spark.read.parquet(f"{tmp_path}/b").where("chrom = 2 and tile between 0 and 1").select("pos").inputFiles()}) >= 2
    with pytest.raises(ValueError):
        spark.createDataFrame([(1, "c", 0)], "x int, chrom string, tile int").write.partitionBy("chrom", "tile").parquet(f"{tmp_path}/bad")
        readers.read_bundle(spark, f"{tmp_path}/bad", "1", 0, 1)


def test_every_score_row_has_one_fate(spark):
    key = ("1", "5", "A", "G")
    rows = [(*key, "t", "0.5", 1), (*key, "t", "0.7", 2), ("1", "x", "A", "G", "t", "1", 3), ("1", "6", "A", "Z", "t", "1", 4), ("1", "7", "A", "G", "t", "", 5),
            ("1", "8", "A", "G", "t", "NaN", 6), ("1", "9", "A", "G", "t", "word", 7), ("1", None, "A", "G", "t", "1", 8), ("1", "5", None, "G", "t", "1", 9)]
    df = spark.createDataFrame(rows, "chromosome string, position string, reference string, alternate string, scorer string, score string, row int")
    assert {r["fate"]: r["n"] for r in readers.score_fates(df, "row").collect()} == {"kept": 1, "overwritten": 1, "bad_position": 2, "bad_allele": 2, "absent": 2, "bad_score": 1}
    assert [r["score"] for r in readers.score_rows(df, "row").collect()] == [0.7]


def test_resumed_runs_write_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chrom string, v int")
    for _ in range(3):
        writers.write_resumable(df, f"{tmp_path}/t")
    assert sorted((r["chrom"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 1), ("a", 2), ("b", 3)]


# ---------------------------------------------------------------- statistics
def test_clustered_logit_equals_newton(spark):
    rng = np.random.default_rng(3)
    n, groups = 900, 60
    g = rng.integers(0, groups, n)
    x = np.stack([np.ones(n), rng.normal(size=n), (rng.random(n) < 0.4).astype(float)], axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [-1.0, 0.8, 0.5] + rng.normal(size=groups)[g] * 0.5)))).astype(float)
    df = spark.createDataFrame([("k", float(y[i]), *map(float, x[i]), int(g[i])) for i in range(n)], "key string, y double, one double, a double, b double, g int").repartition(5)
    beta, cov, clusters, count, settled = stats.clustered_logit(df, "key", "y", ["one", "a", "b"], "g")["k"]
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    scores = np.stack([(x * (y - p)[:, None])[g == i].sum(axis=0) for i in np.unique(g)])
    want = len(scores) / (len(scores) - 1) * (n - 1) / (n - 3) * bread @ scores.T @ scores @ bread
    assert settled and count == n and clusters == len(scores)
    assert np.allclose(beta, b, atol=1e-8) and np.allclose(cov, want, rtol=1e-6)
    beta, cov, *_ = stats.clustered_linear(df, "key", "y", ["one", "a", "b"], "g")["k"]
    ols = np.linalg.lstsq(x, y, rcond=None)[0]
    scores = np.stack([(x * (y - x @ ols)[:, None])[g == i].sum(axis=0) for i in np.unique(g)])
    bread = np.linalg.inv(x.T @ x)
    assert np.allclose(beta, ols) and np.allclose(cov, len(scores) / (len(scores) - 1) * (n - 1) / (n - 3) * bread @ scores.T @ scores @ bread)


def test_isotonic_equals_pooling_in_one_go(spark):
    rng = random.Random(8)
    rows = [(k, round(rng.random() ** 2, 2), int(rng.random() < 0.4)) for k in "ab" for _ in range(400)]
    got = stats.isotonic(spark.createDataFrame(rows, "k string, p double, y int").repartition(4), "p", "y", ["k"]).collect()
    for key in "ab":
        blocks = []
        for p in sorted({r[1] for r in rows if r[0] == key}):
            ys = [r[2] for r in rows if r[0] == key and r[1] == p]
            blocks.append([p, p, len(ys), sum(ys)])
            while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
        assert sorted([r["low"], r["high"], r["n"], r["positives"]] for r in got if r["k"] == key) == blocks
    steps = spark.createDataFrame([(0.2, 0.4, 10, 2), (0.6, 0.8, 10, 6)], "low double, high double, n bigint, positives bigint")
    shown = stats.calibrated(spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.5, 0.7, 0.9)], "p double"), "p", steps, "v").collect()
    assert [round(r["v"], 9) for r in shown] == [0.2, 0.2, 0.4, 0.6, 0.6]


def test_boosted_trees_learn_and_travel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1_200, 30)).astype(np.float32)
    y = x[:, 0] + np.sin(3 * x[:, 1]) + 0.1 * rng.normal(size=1_200)
    for task, label, classes in (("regression", y, 0), ("binary", (y > 0).astype(float), 2), ("multiclass", np.digitize(y, [-1, 1]).astype(float), 3)):
        model = boosting.unpacked(boosting.packed(boosting.fit(x[:900], label[:900], task, classes, 1)))
        out = boosting.evaluate(model, x[900:], task)
        assert np.array_equal(out, boosting.evaluate(boosting.fit(x[:900], label[:900], task, classes, 1), x[900:], task))
        if task == "regression":
            assert np.mean((out[:, 0] - label[900:]) ** 2) < 0.35 * np.var(label[900:])
        else:
            pick = out.argmax(axis=1) if task == "multiclass" else out[:, 0] > 0.5
            assert np.mean(pick == label[900:]) > 0.8
    constant = boosting.fit(np.zeros((5, 2), dtype=np.float32), np.ones(5), "binary", 2, 0)
    assert (boosting.evaluate(constant, np.zeros((3, 2), dtype=np.float32), "binary") > 0.9).all()


@pytest.mark.parametrize("shortlist", [None, 4])
def test_nearest_rows_at_any_block_size(spark, monkeypatch, shortlist):
    rng = random.Random(7)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    fields = ["k", "na", "li_nh4", "mg", "ph", "temperature", "crowder_pct", "strand_conc"]
    rows = [(f"r{i:03}", dna(12), *[float(rng.choice([0, 50])) for _ in fields]) for i in range(120)] + [("empty", "", *[0.0] * 8), ("again", "ACGTACGTACGT", *[0.0] * 8), ("agaim", "ACGTACGTACGT", *[0.0] * 8)]
    asked = [(i, dna(12), *[0.0] * 8) for i in range(6)] + [(9, "ACGTACGTACGT", *[0.0] * 8)]
    columns = ", ".join(f"{f} double" for f in fields)
    table, queries = spark.createDataFrame(rows, f"row_id string, sequence string, {columns}"), spark.createDataFrame(asked, f"query_id int, q_sequence string, {columns}")
    results = []
    for block in ((1_000, 50_000), (2, 17)):
        monkeypatch.setattr(overlap, "QUERY_BLOCK", block[0])
        monkeypatch.setattr(overlap, "ROW_BLOCK", block[1])
        got = overlap.neighbours(queries, table, n=3, shortlist=shortlist).collect()
        results.append(sorted((r["query_id"], r["place"], r["row_id"], r["joint"]) for r in got))
    assert results[0] == results[1] and len(results[0]) == 3 * len(asked)
    assert [r[2] for r in results[0] if r[0] == 9][:2] == ["again", "agaim"][::-1]


def test_nearest_rows_are_found_where_partitions_stay_apart(spark, monkeypatch):
    rng = random.Random(8)
    fields = list(condition.DEFAULTS)
    columns = ", ".join(f"{f} double" for f in fields)
    rows = [(f"r{i:03}", "".join(rng.choice("ACGT") for _ in range(12)), *[0.0] * 8) for i in range(120)]
    table = spark.createDataFrame(rows, f"row_id string, sequence string, {columns}")
    queries = table.selectExpr("row_id AS query_id", "sequence AS q_sequence", *fields).where("row_id < 'r010'")
    monkeypatch.setattr(overlap, "ROW_BLOCK", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as in large tables
    try:
        got = overlap.neighbours(queries, table, n=3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 30 and {(r["query_id"], r["similarity"]) for r in got if r["place"] == 1} == {(f"r{i:03}", 1.0) for i in range(10)}


def test_answers_of_all_rows_are_never_broadcast(spark):
    """Answers grow with the table; the size the optimizer guesses for them does not tell."""
    from tractwise.operators import heads
    model = object.__new__(heads.Heads)
    rng = np.random.default_rng(3)
    width = len(heads.columns_of("G4")) + 84
    model.spark, model.specs, model.fixed_ph = spark, {"h": ("h", "G4", "regression", "tm")}, {}
    model.models = {"h": [boosting.fit(rng.random((40, width), dtype=np.float32), rng.random(40), "regression", 1, 0, 3)]}
    rows = heads.with_defaults(spark.range(20).select(F.col("id").alias("seq_id"), F.lit("GGGTTAGGGTTAGGGTTAGGG").alias("sequence")))
    edits = rows.withColumn("sequence", F.lit("GGGTTAGGGTTAGGGTTAGGA")).withColumn("label", F.lit("G21A"))
    out = heads.member_deltas(model, rows, edits, ["seq_id"], ["h"])
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == 20 and len({r["delta"] for r in got}) == 1


def test_equal_intervals_stay_in_one_locus(spark):
    from tractwise.operators import intervals
    rows = [("c", 10 * i, 10 * i + 8, j) for i in range(400) for j in range(3)]
    df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, j int").repartition(9, "j")
    for touching in (True, False):
        got = intervals.merge(df, ["chrom"], "start", "end", 1_000, touching, [F.count("*").alias("n")])
        assert sorted((r["start"], r["end"], r["n"]) for r in got.collect()) == [(10 * i, 10 * i + 8, 3) for i in range(400)]


def test_batch_features_equal_columns(spark):
    from tractwise.functions import features
    rng = random.Random(5)
    texts = ["", "G", "GGG", "NNNN", "GGGTTAGGGTTAGGGTTAGGG", "CCCTCCCTCCCTCCC", "GGG" + "A" * 13 + "GGGTGGGTGGGTGGG"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 130))) for letters in ("ACGT", "GGGGTTA", "CCCCCAT", "ACGTN", "GC") * 60]
    rows = [(i, s, *[float(rng.choice([0, 0.3, 10, 100])) for _ in range(4)], rng.choice([5.0, 7.4]), 37.0, float(rng.choice([0, 20])), 5.0) for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, sequence string, " + ", ".join(f"{f} double" for f in condition.FIELDS))
    given = {f: np.array([r[2 + j] for r in rows]) for j, f in enumerate(condition.FIELDS)}
    for kind in ("G4", "iM", "locus"):
        x, names = features.featurize(df, "sequence", kind, True, False)
        want = [r["x"] for r in x.select("i", F.array(*[F.col(n).cast("float") for n in names]).alias("x")).orderBy("i").collect()]
        have = features.batch_matrix(features.sequence_blocks(texts, kind), given)
        assert have.shape == (len(texts), len(names) + 84)
        assert np.allclose(np.array(want, dtype=np.float64), have[:, :len(names)], rtol=1e-6, atol=1e-7)


def test_answers_in_rows_equal_joined_ones(spark):
    """Mutation deltas, scans and answers side by side need no join and no shuffle, and equal those of single questions."""
    from tractwise.operators import heads
    model = object.__new__(heads.Heads)
    rng = np.random.default_rng(3)
    width = len(heads.columns_of("G4")) + 84
    model.spark, model.fixed_ph = spark, {"b": 5.0}
    model.specs = {h: (h, "G4", "regression", "tm") for h in "ab"}
    model.models = {h: [boosting.fit(rng.random((40, width), dtype=np.float32), rng.random(40), "regression", 1, seed, 3) for seed in range(2)] for h in "ab"}
    letters = random.Random(4)
    wild = heads.with_defaults(spark.createDataFrame([(i, "".join(letters.choice("GGGTA") for _ in range(24))) for i in range(30)], "seq_id int, sequence string"))
    edits = motifs.substitutions(wild, ["seq_id", *condition.FIELDS], "sequence").withColumnRenamed("sequence", "wild").withColumn("sequence", F.col("mutant"))
    edits = edits.drop("mutant").withColumn("asked", F.col("at") % 2 == 0)
    got = model.deltas(edits, ["a", "b"], "wild", "asked")
    assert "Join" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
    want = heads.member_deltas(model, wild, edits.where("asked"), ["seq_id"], ["a", "b"])
    want = {(r["seq_id"], r["label"], r["head"]): (r["delta"], r["delta_sd"]) for r in want.collect()}
    rows = got.collect()
    assert len(rows) == 2 * edits.count() and sum(r["delta"] is not None for r in rows) == len(want) > 0
    for r in rows:
        assert r["asked"] == (r["delta"] is not None)
        assert not r["asked"] or np.allclose((r["delta"], r["delta_sd"]), want[r["seq_id"], r["label"], r["head"]])
    one = {(r["seq_id"], r["head"]): r["members"] for r in model.members(wild).collect()}
    blank = heads.with_defaults(spark.createDataFrame([(99, "")], "seq_id int, sequence string"))
    side = model.wide(wild.unionByName(blank), ["a", "b"], "own").collect()
    assert {(r["seq_id"], x["head"]): x["members"] for r in side for x in r["own"]} == one and len(side) == 31
    scan = model.scanned(wild, ["a"], "k", [0, 100])
    assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()
    assert {(r["seq_id"], "a"): r["members"] for r in scan.where("point = 100").collect()} == {k: v for k, v in one.items() if k[1] == "a"}


def test_genome_hits_do_not_depend_on_how_pieces_are_packed(spark, monkeypatch):
    rng = random.Random(21)
    pieces = [(c, i, "".join(rng.choice("GGGGGCCCCAT") for _ in range(96))) for c in ("chr1", "chr2") for i in range(200)]
    df = spark.createDataFrame(pieces, "chrom string, piece bigint, s string")
    results = []
    assert motifs.PACKED <= 16_384  # a piece's hits are put together one by one
    for size in (96, motifs.PACKED, 65_536):
        monkeypatch.setattr(motifs, "PACKED", size)
        results.append(sorted(tuple(r) for r in motifs.genome_hits(df, 96).collect()))
    assert results[0] == results[1] == results[2] and results[0]


def test_logit_passes_read_counted_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("k", float(rng.random() < 0.3 + 0.2 * (i % 3 == 0)), 1.0, float(i % 3 == 0), i % 40) for i in range(1200)]
    df = spark.createDataFrame(rows, "key string, y double, one double, a double, g int")
    read, plain = [], stats.gram
    monkeypatch.setattr(stats, "gram", lambda x, *a: read.append(x.count()) or plain(x, *a))
    beta, _, clusters, n, settled = stats.clustered_logit(df, "key", "y", ["one", "a"], "g")["k"]
    y, a = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    odds = lambda p: np.log(p / (1 - p))
    assert settled and n == 1200 and clusters == 40 and np.allclose(beta, [odds(y[a == 0].mean()), odds(y[a == 1].mean()) - odds(y[a == 0].mean())])
    assert max(read[:-1]) == 4   # before: every pass read all rows; the last reads one row per cluster


def test_rescue_puts_contigs_together_once(spark, monkeypatch):
    from tractwise.plans import q_motifs
    made, plain = [], q_motifs.contigs
    monkeypatch.setattr(q_motifs, "contigs", lambda t: made.append(t) or plain(t))

    class Given:
        genome = spark.createDataFrame([("c", i, x) for i, x in enumerate(["AGGGTTAGGGTTAGGGTTAGGGAT" * 4, "ACTTACAT" * 12, "ATCCCTAACCCTAACCCTAACCCT" + "AT" * 36])], "chrom string, piece bigint, s string")
    got = q_motifs.rescued(Given).select("strand", "start", "end").collect()
    assert len(made) == 1 and any(r["strand"] == "-" for r in got)   # before: for the motifs and for the regions, per strand
    plan = q_motifs.rescued(Given)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan   # written, not put together again where it is read
