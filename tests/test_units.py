"""Contracts on literal data: ties, touching intervals, nulls, skew, partitioning."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tractwise.functions import condition, features, motif, seq, variant
from tractwise.operators import heads, intervals, models, motifs, ordered, overlap, ranking, splits, stats
from tractwise.sources import buffers, ingest, readers, writers

TELOMERE = "AGGGTTAGGGTTAGGGTTAGGG"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def random_dna(n, rng, bases="ACGT"):
    return "".join(rng.choice(bases) for _ in range(n))


# ---------------------------------------------------------------- sequences
def test_known_motifs_and_strand_frame(spark):
    df = spark.createDataFrame([(1, TELOMERE), (2, rc(TELOMERE)), (3, "ACGT"), (4, "")], "id int, s string")
    got = {(r["id"], r["kind"], r["strand"], r["start"], r["end"]) for r in motifs.find(df, ["id"], "s").collect()}
    assert got == {(1, "G4", "+", 1, 22), (1, "iM", "-", 1, 22), (2, "G4", "-", 0, 21), (2, "iM", "+", 0, 21)}


def test_non_overlapping_and_overlapping_hits_match_a_position_loop(spark):
    rng = random.Random(1)
    texts = [random_dna(rng.randint(0, 120), rng, "GGGGACT") for _ in range(200)] + ["G" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    for overlapping in (False, True):
        want = set()
        pattern = re.compile("(?=(" + motif.PATTERN["G4"] + "))")
        for i, s in enumerate(texts):
            last = -1
            for m in pattern.finditer(s):
                if not overlapping and m.start() < last:
                    continue
                last = m.start() + len(m.group(1))
                want.add((i, m.start(), last))
        got = {(r["id"], r["start"], r["end"]) for r in motifs.find(df, ["id"], "s", ["G4"], False, overlapping).collect()}
        assert got == want


def test_genome_hits_do_not_depend_on_piece_length(spark):
    rng = random.Random(2)
    text = random_dna(3000, rng, "GGGGGACT") + "G" * 300 + random_dna(1500, rng, "CCCCATG")
    found = []
    for n in (100, 250, len(text)):
        pieces = [("chr1", i // n, text[i:i + n]) for i in range(0, len(text), n)]
        # equal pieces only: the last one is padded, as a reference would be with N
        pieces[-1] = (*pieces[-1][:2], pieces[-1][2].ljust(n, "N"))
        df = spark.createDataFrame(pieces, "chrom string, piece bigint, s string")
        found.append({tuple(r) for r in motifs.genome_hits(df, n).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    assert all(len(r[5]) <= 60 for r in found[0])


def test_clean_and_hash(spark):
    r = spark.createDataFrame([("acguX-n",)], "s string").select(seq.clean("s").alias("c"), seq.seq_hash("s").alias("h")).first()
    assert r["c"] == "ACGTNNN" and len(r["h"]) == 16


def test_feature_vector_sizes():
    assert len(features.NAMED) == 39 and len(features.sequence_feature_names("G4")) == 123
    assert len(features.sequence_feature_names("locus")) == 145
    assert len(features.CONDITION_NAMES) == 27 and len(features.INTERACTION_NAMES) == 10


def test_empty_and_all_n_sequences(spark):
    df = spark.createDataFrame([(1, "NNNN"), (2, "G")], "id int, s string")
    out = features.with_sequence_features(df, "s").orderBy("id").collect()
    assert out[0]["has_4tracts"] == 0 and out[0]["g4h_mean"] == 0 and out[0]["gc"] == 0
    assert out[1]["g4h_win_max"] == 1.0


# ------------------------------------------------------------------- ordered
def test_ranks_and_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.full(700, 5.0), rng.integers(0, 400, 1300).astype(float)])
    keys = rng.integers(0, 3, 2000)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)], "k int, v double").repartition(5)
    got = {r["k"]: (r["q0"], r["q1"]) for r in ordered.exact_quantiles(df, "v", [0.05, 0.5], ["k"]).collect()}
    for k in range(3):
        assert np.allclose(got[k], np.quantile(values[keys == k], [0.05, 0.5]))
    ranks = {r["v"]: (r["below"], r["n"], r["total"]) for r in ordered.value_ranks(df, "v").collect()}
    for v, (below, n, total) in ranks.items():
        assert below == (values < v).sum() and n == (values == v).sum() and total == 2000


def test_running_carries_across_tiles(spark):
    df = spark.createDataFrame([("a", i, i // 7, (i * 37) % 11) for i in range(100)], "k string, i int, tile int, v int")
    out = ordered.running(df, ["k"], "tile", ["i"], "v", "m", "max", False)
    out = ordered.running(out, ["k"], "tile", ["i"], "v", "s", "sum", True).orderBy("i").collect()
    v = [(i * 37) % 11 for i in range(100)]
    assert [r["s"] for r in out] == list(np.cumsum(v))
    assert [r["m"] for r in out] == [None, *np.maximum.accumulate(v)[:-1]]


# ----------------------------------------------------------------- intervals
def test_touching_intervals(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 25, 30), ("c", 26, 27)], "chrom string, start bigint, end bigint")
    spans = lambda touching: sorted((r["start"], r["end"]) for r in intervals.merge(df, ["chrom"], "start", "end", 8, touching).collect())
    assert spans(True) == [(0, 20), (25, 30)]
    assert spans(False) == [(0, 10), (10, 20), (25, 30)]


def test_touching_support_splits_a_region(spark):
    rows = [("c", 0, 10), ("c", 0, 20), ("c", 10, 20)]
    df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint")
    assert sorted((r["start"], r["end"]) for r in intervals.support_regions(df, ["chrom"], 2, tile=3).collect()) == [(0, 10), (10, 20)]


def test_overlap_join_emits_each_pair_once(spark):
    rng = random.Random(3)
    a = [("c", s, s + rng.randint(1, 60)) for s in (rng.randint(0, 300) for _ in range(60))]
    b = [("c", s, s + rng.randint(1, 60)) for s in (rng.randint(0, 300) for _ in range(60))]
    x = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "chrom string, start bigint, end bigint, i int")
    y = spark.createDataFrame([(*r, i) for i, r in enumerate(b)], "chrom string, b_start bigint, b_end bigint, j int")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(x, y, ["chrom"], 16).collect())
    assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[1] < q[2] and q[1] < p[2])


def test_summit_is_the_last_highest_run(spark):
    runs = spark.createDataFrame([("c", 0, 10, 5), ("c", 10, 14, 9), ("c", 14, 18, 9), ("c", 30, 40, 1)], "chrom string, start bigint, end bigint, val int")
    out = sorted((r["start"], r["end"], r["auc"], r["summit"]) for r in intervals.coverage_blocks(runs, ["chrom"], tile=12).collect())
    assert out == [(0, 18, 122, 16), (30, 40, 10, 35)]


# ------------------------------------------------------------------- sources
@pytest.mark.parametrize("text, ph, want", [
    ("10 mM lithium cacodylate + 100 mM KCl", 7.0, (100, 0, 10, 0, 7.0, True)),
    ("20 mM Kpi + 80 mM KCl", 0.0, (110, 0, 0, 0, None, True)),
    ("PBS (pH 7.4)", 0.0, (4.45, 157, 0, 0, 7.4, True)),
    ("100 mM K + unknown Li cacodylate (pH 7.2)", 0.0, (100, 0, 0, 0, 7.2, True)),
    ("10 mM Na2HPO4 at pH 7", 0.0, (0, 20, 0, 0, 7.0, True)),
    ("5 mM mystery + 100 Na", 7.0, (0, 100, 0, 0, 7.0, False)),
    ("10 mM Tris", 7.0, (0, 0, 0, 0, 7.0, False)),
    (None, 7.0, (0, 0, 0, 0, None, False)),
])
def test_buffer_text(spark, text, ph, want):
    r = buffers.parse(spark.createDataFrame([(text, ph)], "t string, p double"), "t", "p").first()
    assert (r["buf_k"], r["buf_na"], r["buf_li_nh4"], r["buf_mg"], r["buf_ph"], r["buf_usable"]) == want


def test_unknown_unit_and_field_are_errors(spark):
    df = spark.createDataFrame([("ACGT", "1")], "s string, x string")
    with pytest.raises(ingest.SpecError):
        ingest.declared(df, {"source": "a", "columns": {"sequence": "s", "k": "x"}, "units": {"k": "furlong"}}, "s")
    with pytest.raises(ingest.SpecError):
        ingest.declared(df, {"source": "a", "columns": {"sequence": "s", "colour": "x"}}, "s")


def test_header_resolution():
    found = readers.resolve(["Oligo Seq.", "T m", "[KCl] mM"], {"sequence": ["sequence", "seq"], "tm": ["tm"], "k": ["kcl"]}, ["sequence"])
    assert found == {"sequence": "Oligo Seq.", "tm": "T m", "k": "[KCl] mM"}
    with pytest.raises(ValueError):
        readers.resolve(["a"], {"sequence": ["sequence"]}, ["sequence"])


def test_fasta_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACGT\nGG\n>empty\n>two\nTT\n")
    got = {r["id"]: r["sequence"] for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"one": "ACGTGG", "empty": "", "two": "TT"}


def test_fasta_mark_inside_a_header(spark, tmp_path):
    (tmp_path / "y.fa").write_text("\n>a x->y note\r\nACGT\r\n>b >c\nGG")
    got = {r["id"]: r["sequence"] for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"a": "ACGT", "b": "GG"}


def test_every_problem_of_a_description_is_told():
    spec = {"columns": {"k": "x", "colour": "y"}, "units": {"k": "kelvin", "na": "mM"}}
    assert len(ingest.problems(spec, ["x"])) == 6
    assert ingest.problems({"source": "a", "columns": {"sequence": "s", "tm": "t"}, "units": {"tm": "F"}}, ["s", "t"]) == []


def test_pasted_records_lose_nothing(spark):
    lines = [(0, 0, ">a"), (0, 1, ">a"), (0, 2, "AC"), (0, 3, "GT"), (0, 4, ">"), (0, 5, "TT"), (1, 0, "AAAA"), (1, 1, ""), (1, 2, "CCCC")]
    df = spark.createDataFrame(lines, "doc int, n int, line string")
    got = {(r["doc"], r["index"]): (r["id"], r["sequence"]) for r in readers.pasted_records(df, "doc", "n", "line", 2).collect()}
    assert got == {(0, 0): ("a", ""), (0, 1): ("a", "ACGT"), (0, 2): ("seq_3", "TT"), (1, 0): ("seq_1", "AAAA"), (1, 1): ("seq_2", "CCCC")}


def test_insert_or_ignore_keeps_null_keys(spark):
    cols = ingest.NATURAL_KEY + ["n"]
    row = lambda sid, n: ("h", "G4", "s", sid, 100.0, 0.0, 0.0, 0.0, 7.0, 25.0, n)
    kinds = "seq_hash string, kind string, source string, source_id string, k double, na double, li_nh4 double, mg double, ph double, temperature double, n int"
    old = spark.createDataFrame([row("a", 0)], kinds)
    new = spark.createDataFrame([row("a", 1), row("b", 2), row("b", 3), row(None, 4), row(None, 5)], kinds)
    assert sorted(r["n"] for r in ingest.insert_or_ignore(old, new, ["n"]).collect()) == [2, 4, 5]
    assert cols[-1] == "n"


def test_resumable_write(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "chrom string, v int")
    path = str(tmp_path / "out")
    writers.write_resumable(df.where("chrom = 'a'"), path)
    writers.write_resumable(df, path)
    assert sorted((r["chrom"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("b", 3)]


def test_repair_text(spark):
    rows = [("MÃ¼ller â€“ x", "Müller – x"), ("plain", "plain"), ("Ωmega", "Ωmega"), ("é", "é")]
    for bad, good in rows:
        assert spark.createDataFrame([(bad,)], "c string").select(ingest.repair_text(F.col("c"))).first()[0] == good


# --------------------------------------------------------------------- stats
def test_fisher_exact(spark):
    # classic tea table: p = 0.4857
    df = spark.createDataFrame([(3, 1, 1, 3), (8, 2, 1, 5)], "a int, b int, c int, d int")
    p = [r[0] for r in df.select(stats.fisher_p("a", "b", "c", "d")).collect()]
    assert abs(p[0] - 0.4857142857) < 1e-9 and abs(p[1] - 0.0349650350) < 1e-8


def test_mann_whitney_against_counting(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 40), rng.integers(2, 11, 60)
    df = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "v double, g boolean")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = stats.mann_whitney(df, "v", F.col("g")).first()
    assert r["u"] == u and abs(r["delta"] - (2 * u / 2400 - 1)) < 1e-12


def test_clustered_ols_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 400
    x1, g = rng.normal(size=n), rng.integers(0, 30, n)
    y = 1 + 2 * x1 + rng.normal(size=n) + 0.3 * (g % 4)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(y, x1, g)], "y double, x double, g int")
    rows, info = stats.clustered_ols(df, "y", {"x": F.col("x")}, "g")
    X = np.column_stack([np.ones(n), x1])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    meat = sum(np.outer(X[g == c].T @ e[g == c], X[g == c].T @ e[g == c]) for c in np.unique(g))
    inv = np.linalg.inv(X.T @ X)
    k = len(np.unique(g))
    se = np.sqrt(np.diag(k / (k - 1) * (n - 1) / (n - 2) * inv @ meat @ inv))
    assert np.allclose([r[1] for r in rows], beta) and np.allclose([r[2] for r in rows], se)


def test_constant_scores_have_no_bins(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert stats.reliability(df, "y", "p").count() == 0


def test_midranks_of_one_value_and_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, v double")
    assert {r["id"]: r["r"] for r in ranking.midrank(df, "v", "r").collect()} == {1: 1.0, 2: None}


def test_lost_motif_ranks_high_without_a_number(spark):
    rows = [(1, "motif_lost", None, 0.9), (2, "motif_retained", 1.0, 0.1), (3, "motif_retained", 3.0, None), (4, "no_motif", None, 0.2), (5, "motif_lost", None, None)]
    df = spark.createDataFrame(rows, "id int, motif_state string, magnitude double, reg double")
    q = {r["id"]: r for r in ranking.quadrants(df).collect()}
    assert q[1]["quadrant"] == "both" and q[1]["structural_rank"] == 1.0 and q[1]["magnitude"] is None
    assert q[3]["quadrant_reason"] == "no_regulatory_record" and q[4]["quadrant_reason"] == "no_structural_delta"
    assert q[5]["quadrant"] == "unclassified" and q[5]["combined_rank"] is None and q[5]["quadrant_reason"] == "no_structural_delta"


# -------------------------------------------------------------------- splits
@pytest.mark.parametrize("seed", range(6))
def test_segments_equal_one_by_one_placement(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([1, 1, 2, 3, 7, 40, 200]) for _ in range(rng.randint(1, 120))), reverse=True)
    classes = [(s, len(list(g))) for s, g in itertools.groupby(sizes)]
    k = rng.choice([2, 3, 5])
    want, loads = [], [0] * k
    for s in sizes:
        f = loads.index(min(loads))
        loads[f] += s
        want.append(f)
    got = []
    for size, first, stop, folds in splits._segments(classes, k):
        got += [folds[j % len(folds)] for j in range(stop - first)]
    assert got == want


def test_grouped_folds_place_every_group_once(spark):
    rows = [(g, i) for g in range(40) for i in range(1 + (g * 7) % 13)] + [(99, i) for i in range(120)]
    df = spark.createDataFrame(rows, "g int, i int")
    sizes = sorted(((sum(1 for r in rows if r[0] == g), g) for g in {r[0] for r in rows}), key=lambda t: (-t[0], t[1]))
    loads, want = [0] * 5, {}
    for s, g in sizes:
        f = loads.index(min(loads))
        loads[f] += s
        want[g] = f
    assert {r["g"]: r["fold"] for r in splits.grouped_folds(df, "g").collect()} == want


def test_shuffle_keeps_dinucleotides_and_ignores_partitioning(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, random_dna(60, rng)) for i in range(100)] + [(100, "AAA"), (101, "ACACACAC")], "id int, s string")
    run = lambda d: {r["id"]: (r["s"], r["x"]) for r in d.select("id", "s", splits.dinucleotide_shuffle(F.col("s"), F.col("id")).alias("x")).collect()}
    one, two = run(df.repartition(1)), run(df.repartition(9))
    assert one == two
    pairs = lambda s: sorted(zip(s, s[1:]))
    assert all(pairs(s) == pairs(x) for s, x in one.values())
    assert sum(s != x for s, x in one.values()) > 90


def test_leader_groups_equal_a_greedy_pass(spark):
    rng = random.Random(7)
    texts = set()
    for _ in range(60):
        base = random_dna(40, rng)
        texts.add(base)
        for _ in range(3):
            i = rng.randrange(40)
            texts.add(base[:i] + rng.choice("ACGT") + base[i + 1:])
    order = sorted(texts, key=lambda s: (-len(s), s))
    m = splits.kmer_counts(order, 4)
    norm = (m * m).sum(axis=1)
    want, leaders = {}, []
    for i, s in enumerate(order):
        near = [j for j in leaders if 100 * int(m[i] @ m[j]) ** 2 >= 81 * int(norm[i]) * int(norm[j])]
        if near:
            want[s] = order[near[0]]
        else:
            leaders.append(i)
            want[s] = s
    df = spark.createDataFrame([(s,) for s in order], "s string").repartition(7)
    got = {r["s"]: r["leader"] for r in splits.leader_groups(df).collect()}
    assert got == want and len(leaders) < len(order)


def test_pairs_of_a_crowd_equal_every_dot_product(monkeypatch):
    rng = random.Random(11)
    texts = [b[:i] + random_dna(rng.choice((0, 1, 9)), rng) + b[i:] for b in ("GGGGTGGGGAGGGGCGGGGT" * 2, random_dna(32, rng)) for i in range(30)]
    texts += ["ACG"] + [random_dna(32, rng) for _ in range(40)]
    m = splits.kmer_counts(texts, 4)
    norm = (m * m).sum(axis=1)
    similar = lambda x, y: norm[x] and norm[y] and 100 * int(m[x] @ m[y]) ** 2 >= 81 * int(norm[x]) * int(norm[y])
    every, cut = np.arange(len(texts)), 50
    monkeypatch.setattr(splits, "STRIPE", 7)
    for low, high, alone in ((every, every, True), (every[:cut], every[cut:], False)):
        parts = list(splits._near(m, low, high, alone, most=11))
        got = [(int(x), int(y)) for a, b in parts for x, y in zip(a, b)]
        want = [(x, y) for x in low for y in high if (x < y or not alone) and similar(x, y)]
        assert sorted(got) == sorted(want) and want and max(len(a) for a, _ in parts) <= 11


def test_groups_in_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = [random_dna(30, rng) for _ in range(60)]
    df = spark.createDataFrame([(b[:i] + c + b[i + 1:],) for b in base for i in (5, 20) for c in "AG"], "s string").distinct()
    whole = {tuple(r) for r in splits.leader_groups(df.repartition(2)).collect()}
    monkeypatch.setattr(splits, "BLOCK", 5)
    parts = {tuple(r) for r in splits.leader_groups(df.repartition(11)).collect()}
    assert whole == parts and len({x for _, x in whole}) < len(whole)


def test_short_numbers_have_six_digits(spark):
    values = [7.12345, 0.00004, 100.0, 0.0, 123456.7, 1234567.0, 0.00012345678, 999999.5, 1.5, -2.25, 100000.0]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(condition.short_number("v")).collect()]
    assert got == ["%g" % v for v in values]


def test_checkpoint_folder_has_to_be_named(spark, monkeypatch):
    from tractwise import session

    class Bare:
        class sparkSession:
            class conf:
                @staticmethod
                def get(key, default):
                    return default

            class sparkContext:
                @staticmethod
                def getCheckpointDir():
                    return None
    with pytest.raises(RuntimeError):
        session.cut_lineage(Bare)


def test_containment_and_near_matches(spark):
    hay = spark.createDataFrame([("AACCGGTTAA",), ("TTTT",)], "h string")
    needles = spark.createDataFrame([("CCGG",), ("AAAA",), ("TTTT",), ("AACCGGTTAAC",)], "n string")
    assert {r["n"] for r in overlap.contained(needles, "n", hay, "h").collect()} == {"CCGG", "TTTT"}
    rows = spark.createDataFrame([("b", "ACGT", 1.0), ("b", "ACGA", 3.0), ("b", "ACGA", 5.0), ("b", "TCGA", 0.0), ("c", "ACGC", 9.0), ("b", "ACG", 9.0)], "k string, s string, v double")
    got = {(r["first"], r["second"], r["pos"], r["v_second"] - r["v_first"]) for r in overlap.hamming_one(rows, ["k"], "s", ["v"]).collect()}
    assert got == {("ACGA", "ACGT", 3, -3.0), ("ACGA", "TCGA", 0, -4.0)}


def exchanged_rows(df):
    """Rows written to shuffles by a collected query."""
    todo, seen, total = [df._jdf.queryExecution().executedPlan()], set(), 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_single_substitution_pairs_send_a_sequence_twice_and_match_all_pairs(spark):
    rng = random.Random(5)
    texts = [random_dna(8, rng) for _ in range(60)]
    crowd = ["GGGG" + "".join(x) for x in itertools.product("ACGT", repeat=4)]     # far more than FEW share a half
    rows = [(i % 2, "GGGG" + x) for i, x in enumerate(texts)] + [(0, x) for x in crowd] + [(0, x) for x in (None, "", "A", "C", "AC", "AA", "ACG", "ATG")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "k int, s string, v double")
    got = sorted(tuple(r) for r in overlap.hamming_one(df, ["k"], "s", ["v"]).select("k", "pos", "first", "second").collect())
    known = sorted({r for r in rows if r[1]})
    want = sorted((k, next(i for i in range(len(a)) if a[i] != b[i]), a, b) for k, a in known for j, b in known
                  if k == j and len(a) == len(b) and a < b and sum(x != y for x, y in zip(a, b)) == 1)
    assert got == want
    few = spark.createDataFrame([(0, random_dna(32, rng), 1.0) for _ in range(500)], "k int, s string, v double")
    pairs = overlap.hamming_one(few, ["k"], "s", ["v"])
    pairs.collect()
    assert exchanged_rows(pairs) <= 4 * 500  # before: one row per base


def test_containment_sends_what_passes_the_filter_and_matches_plain_search(spark, monkeypatch):
    rng = random.Random(6)
    hay = [random_dna(rng.randint(0, 40), rng) for _ in range(80)] + ["", None, "\u20acx\U0001f600yz"]
    needles = [random_dna(rng.randint(1, 6), rng) for _ in range(300)] + ["\u20acx\U0001f600", "x\u20ac", None, random_dna(45, rng)] + [h[:7] for h in hay[:20]]
    texts, wanted = spark.createDataFrame([(h,) for h in hay], "h string"), spark.createDataFrame([(n,) for n in needles], "n string")
    want = sorted({n for n in needles if n is not None and any(h is not None and n in h for h in hay)})
    for many, piece in ((1000, 1 << 16), (0, 1 << 16), (1000, 10)):   # in one search, in two, in pieces
        monkeypatch.setattr(overlap, "MANY", many)
        monkeypatch.setattr(overlap, "PIECE", piece)
        assert sorted(r["n"] for r in overlap.contained(wanted, "n", texts, "h").collect()) == want
    monkeypatch.setattr(overlap, "MANY", 1000)
    long = spark.createDataFrame([(random_dna(5000, rng),) for _ in range(20)], "h string")
    rare = spark.createDataFrame([(random_dna(n, rng),) for n in range(20, 40)], "n string")
    found = overlap.contained(rare, "n", long, "h")
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and exchanged_rows(found) < 1000   # before: 2,000,000 stretches, joined


def test_motif_shuffles_stop_at_the_first_that_serves(spark):
    rng = random.Random(9)
    texts = ["GGGTTAGGGTTAGGGTTAGGG" + random_dna(20, rng, "GGGACT") for _ in range(30)] + ["GGGG", "CCCTAACCCTAACCCTAACCC"]
    want = {}
    for i, s in enumerate(texts):
        draws = [splits._shuffle_one(s, np.random.default_rng(splits.zlib.crc32(f"{i}|{n}|{s}".encode()))) for n in range(25)]
        want[i] = next(((x, n + 1) for n, x in enumerate(draws) if x != s and (re.search(motif.PATTERN["G4"], x) or re.search(motif.PATTERN["G4"], rc(x)))), (None, 25))
    first = splits.motif_shuffle(F.col("s"), "G4", 25, F.col("i"))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    assert {r["i"]: r["x"] for r in df.select("i", first.alias("x")).collect()} == {i: x for i, (x, _) in want.items()}
    assert sum(n for _, n in want.values()) < 25 * len(texts) / 2   # the draws that are needed; before, all 25 were made


def test_temperature_keeps_calibrated_posteriors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(3000):
        p = rng.dirichlet([1.0, 1.0, 1.0])
        sharp = p ** 2 / (p ** 2).sum()  # overconfident by a factor of two
        rows.append((int(rng.choice(3, p=p)), [float(v) for v in sharp]))
    t = models.temperature(spark.createDataFrame(rows, "y int, p array<double>"), "y", "p")
    assert 1.7 < t < 2.4


def test_condition_label(spark):
    row = {f: v for f, v in condition.DEFAULTS.items()} | {"mg": 0.5, "ph": 7.25, "li_nh4": 10.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{f} double" for f in row))
    assert df.select(condition.label()).first()[0] == "K100 Na0 Li/NH4 10 Mg0.5 pH7.25 25C"


def test_effect_class_order(spark):
    df = spark.createDataFrame([("motif_lost", -9.0), ("x", -5.0), ("x", -2.0), ("x", 1.9), ("x", 2.0), ("x", None)], "s string, d double")
    got = [r[0] for r in df.select(variant.effect_class(F.col("s"), F.col("d"), F.lit("G4"))).collect()]
    assert got == ["motif_lost", "destabilising", "moderate", "neutral", "stabilising", "other"]


def test_window_means_of_a_batch_equal_a_loop_over_bases():
    def plain(s, window):
        score = []
        for r in re.findall(r"G+|C+|[^GC]+", s):
            score += [{"G": min(len(r), 4), "C": -min(len(r), 4)}.get(r[0], 0)] * len(r)
        w = min(window, len(s))
        return [sum(score[i:i + w]) / w for i in range(len(s) - w + 1)] if s else [0.0]

    rng = random.Random(12)
    texts = ["", None, "GGG", "GGGGG", "C", "GGGAéGGGGGGCCCCC", "NNNN", None, *[random_dna(n, rng) for n in (24, 25, 26, 32, 96)], ""]
    want = [None if s is None else plain(s, 25) for s in texts]
    assert seq.window_means(pa.array(texts, pa.string())).to_pylist() == want
    assert seq.window_means(pa.array([], pa.string())).to_pylist() == []


def test_head_sample_is_the_smallest_hashes_and_filters_before_the_join(spark):
    ids = [(f"r{i}", i, "a" if i % 3 else "b") for i in range(900)] + [("z1", 1, "few")]
    left = spark.createDataFrame(ids, "record_id string, n int, head string").repartition(5)
    rows = left.join(spark.range(900).withColumnRenamed("id", "n").hint("merge"), "n")
    got = heads.sampled(rows, most=50, least=10)
    draw = lambda r: int(hashlib.md5(r.encode()).hexdigest()[:8], 16)
    want = {(h, r) for h in "ab" for r in sorted((r for r, _, of in ids if of == h), key=lambda r: (draw(r), r))[:50]}
    assert {(r["head"], r["record_id"]) for r in got.collect()} == want and got.columns == rows.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan[plan.index("Join"):]
    assert heads.sampled(rows.where("head = 'few'"), least=10).isEmpty()


def test_counted_spearman_equals_ranks_of_single_rows(spark):
    rng = np.random.default_rng(3)
    cells = [(float(x) if x < 9 else None, float(y), int(rng.integers(1, 6))) for x in range(10) for y in rng.permutation(12)[:5]]
    df = spark.createDataFrame(cells, "x double, y double, c bigint")
    single = df.select("x", "y", F.explode(F.sequence(F.lit(1), "c")).alias("i"))
    got, want = stats.counted_spearman(df, "x", "y", "c").first(), stats.correlation(single, "x", "y").first()
    assert got["n"] == want["n"] and abs(got["spearman"] - want["spearman"]) < 1e-12
    assert stats.counted_spearman(df.where("x > 50"), "x", "y", "c").first()["n"] == 0


def test_molecules_meet_in_one_grouping_of_counted_rows(spark):
    from tractwise.plans import q_audit
    rows = [("ACGT", 50.0, 30)] * 500 + [("ACGT", 52.0, 34), ("ACGT", None, 34), ("GGGA", None, 10)]

    class Given:
        records = spark.createDataFrame(rows, "sequence string, tm double, qty bigint")
    per = {r["key"]: r for r in q_audit.molecule_keys(Given).collect()}
    assert per["ACGT"]["n_rows"] == 502 and per["ACGT"]["med_tm"] == 50.0 and len(per["ACGT"]["scores"]) == 3  # cells, not rows
    assert per["GGGA"]["n_rows"] == 1 and per["GGGA"]["med_tm"] is None
    got = q_audit.jn8(Given).first()
    assert (got["n_sequences"], got["n_table_rows"], got["n_pairs"]) == (2, 502 * 502 + 1, 502)


def test_matched_negatives_are_chosen_in_the_row_of_their_positive(spark):
    rng = random.Random(12)
    texts = ["GGGTTAGGGTTAGGGTTAGGG" + random_dna(9, rng, "GGGACT") for _ in range(25)] + ["GGGG", "ACGTACGTTGCA"]
    want = {}
    for i, s in enumerate(texts):
        draws = [splits._shuffle_one(s, np.random.default_rng(splits.zlib.crc32(f"{i}|{n}|4|{s}".encode()))) for n in range(50)]
        good = [x != s and not re.search(motif.PATTERN["G4"], x) for x in draws]
        best = sorted(range(50), key=lambda n: (not good[n], n))[:2]
        want |= {(i, c + 1): (draws[n], good[n]) for c, n in enumerate(best)}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    found = splits.matched_negatives(df, "i", "s", "G4", n=2, seed=4)
    assert {(r["i"], r["copy"]): (r["negative"], r["accepted"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan   # before: every draw was a row, ranked in a window


def test_gains_of_the_other_strand_equal_a_search_of_every_edit(spark):
    rng = random.Random(21)
    texts = [random_dna(rng.randint(18, 60), rng, "CCCCCAGT") for _ in range(150)] + ["CCCACCCACCCNCCC", "CCCACCCACCC#CCC", "CCCACCCACCAACCC", "ACCACCCACCCACCC", "GCCACCCACCCACCCU", "", "ccc"]
    for kind, pattern in motif.PATTERN.items():
        free = [(i, s) for i, s in enumerate(x if kind == "G4" else rc(x) for x in texts) if not re.search(pattern, s[::-1].translate(str.maketrans("ACGTUN", "TGCAAN")))]
        want = set()
        for i, s in free:
            for at, wt in enumerate(s):
                for alt in "ACGT":
                    edit = s[:at] + alt + s[at + 1:]
                    if alt != wt and re.search(pattern, edit[::-1].translate(str.maketrans("ACGTUN", "TGCAAN"))):
                        want.add((i, f"{wt}{at + 1}{alt}"))
        found = motifs.other_strand_gains(spark.createDataFrame(free, "i int, s string"), ["i"], "s", kind)
        assert {(r["i"], r["label"]) for r in found.collect()} == want and len(want) > 20


def test_counted_rows_rank_and_bin_like_single_rows(spark):
    rng = np.random.default_rng(8)
    cells = [(h, float(v), int(y), int(rng.integers(1, 9))) for h in "ab" for v in rng.integers(0, 25, 30) for y in (0, 1)]
    df = spark.createDataFrame(cells, "h string, p double, y int, c bigint")
    single = df.select("h", "p", "y", F.explode(F.sequence(F.lit(1), "c")).alias("i"))
    plain = lambda x: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect())
    assert plain(stats.ranking_metrics(df, "y", "p", ["h"], "c")) == plain(stats.ranking_metrics(single, "y", "p", ["h"]))
    assert plain(stats.reliability(df, "y", "p", ["h"], weight="c")) == plain(stats.reliability(single, "y", "p", ["h"]))
