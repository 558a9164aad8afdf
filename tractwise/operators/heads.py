"""The twelve heads: rows, similarity groups, folds, fits, intervals, gates and scoring as a few Spark jobs.

All heads are fitted by one job: a task fits one member of one head, once per fold and once on all rows, so heads and
members run side by side. Fitted on all labelled rows (`most` is None), cut points come from counts of all tasks and a
task reads its rows from files; else a head is fitted on at most `most` rows, drawn by a hash of the record id, that its
task holds. Counting, scoring and scanning read every row.
"""

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import condition, features, motif, seq, thermo
from ..session import cut_lineage
from . import atlas, boosting, motifs, ordered, splits

MAX_ROWS, FOLDS, SEEDS, MIN_ROWS, ALPHA = 1_500, 5, 5, 40, 0.1
ROUNDS = 30

# fixed values: what each head is trained to answer; None reads every source or label class
# name, kind, task, target, classes, tiers, label classes, sources, grouped by, members
SPECS = [
    ("g4_fold", "G4", "binary", "folded", [], ["experimental", "derived"], ["biophysical", "catalog"],
     ["g4stab_experimental_tm", "shuffled::g4stab_experimental_tm", "g4sp_topology", "shuffled::g4sp_topology"], "sequence", 5),
    ("g4_topology", "G4", "multiclass", "topology", ["parallel", "antiparallel", "hybrid"], ["experimental"], None, None, "sequence", 5),
    ("g4_tm", "G4", "regression", "tm", [], ["experimental"], None, None, "sequence", 5),
    ("g4_tm_distilled", "G4", "regression", "tm", [], ["predicted"], None, None, "sequence", 3),
    ("im_fold", "iM", "binary", "folded", [], ["experimental", "derived"], ["biophysical", "catalog"],
     ["im_pht_biophysical", "shuffled::im_pht_biophysical"], "sequence", 5),
    ("im_pht", "iM", "regression", "ph_t", [], ["experimental"], ["biophysical"], ["im_pht_biophysical"], "sequence", 5),
    ("im_pht_condition", "iM", "regression", "ph_t", [], ["experimental"], ["biophysical"], ["duvma_im_stability_landscape"], "condition", 5),
    ("im_tm_condition", "iM", "regression", "tm", [], ["experimental"], ["biophysical"], ["duvma_im_stability_landscape"], "condition", 5),
    ("im_fold_genomic", "iM", "binary", "folded", [], ["experimental", "derived"], ["genomic_proxy", "catalog"],
     ["gse220882_hek293t_im_cutandtag", "shuffled::gse220882_hek293t_im_cutandtag"], "sequence", 5),
    ("g4_fold_genomic", "G4", "binary", "folded", [], ["experimental", "derived"], ["genomic_proxy", "catalog"],
     ["gse220882_hek293t_g4_cutandtag", "shuffled::gse220882_hek293t_g4_cutandtag"], "sequence", 5),
    ("locus_peak_overlap_state", "locus", "multiclass", "topology", ["both", "g4_only", "im_only", "neither"], ["experimental", "derived"],
     ["genomic_proxy", "catalog"], ["gse220882_hek293t_locus_state", "shuffled::gse220882_hek293t_locus_state"], "sequence", 5),
    ("im_architecture", "iM", "binary", "folded", [], ["derived"], None, ["im_architecture_positives", "im_architecture_negatives"], "sequence", 3),
]
SPEC_COLUMNS = ("head string, head_kind string, task string, target string, classes array<string>, tiers array<string>, "
                "label_classes array<string>, sources array<string>, group_by string, members int")
WINDOW_REFUSED = ["g4_fold", "g4_fold_genomic", "im_fold", "im_fold_genomic"]  # fixed values: refused on longer, genomic windows
ALLOW_LIST = 20  # heads of at most so many distinct training sequences answer for those alone


def named(specs, alias=None):
    """Specs with their sources renamed to those of a table."""
    alias = alias or {}
    return [(*s[:7], None if s[7] is None else [alias.get(x, x) for x in s[7]], *s[8:]) for s in specs]


def head_rows(rows: DataFrame, specs) -> DataFrame:
    """The labelled rows of every head in one pass: head, group_by, record_id, sequence, conditions, label.

    rows: record_id, sequence, kind, evidence_tier, label_class, source, condition fields, folded, topology, tm, ph_t.
    A multiclass label is the place of the class; a row of no class of the head is left out.
    """
    table = rows.sparkSession.createDataFrame(specs, SPEC_COLUMNS)
    j = rows.join(F.broadcast(table), F.col("kind") == F.col("head_kind"))  # a dozen heads
    for column, allowed in (("evidence_tier", "tiers"), ("label_class", "label_classes"), ("source", "sources")):
        j = j.where(F.col(allowed).isNull() | F.expr(f"array_contains({allowed}, {column})"))
    place = F.array_position("classes", F.col("topology")).cast("double") - 1
    label = (F.when(F.col("target") == "tm", F.col("tm")).when(F.col("target") == "ph_t", F.col("ph_t"))
             .when(F.col("target") == "folded", F.col("folded").cast("double")).when(place >= 0, place))
    filled = {f: F.coalesce(condition.given(f), F.lit(condition.DEFAULTS[f])) for f in condition.FIELDS}
    return j.withColumn("label", label).where("label IS NOT NULL").withColumns(filled | {"sequence": seq.clean("sequence")}).select(
        "head", "kind", "task", "group_by", "members", "record_id", "sequence", *condition.FIELDS, "label", F.size("classes").alias("n_classes"))


def sampled(rows: DataFrame, most=MAX_ROWS, least=MIN_ROWS) -> DataFrame:
    """At most `most` rows per head, the smallest by hash (None: every row that has a record id); heads below `least` rows are left out.

    Only how many rows each head has is counted over all of them. The counts bound the hash per head, and the widest bound
    is a filter on the record id alone, which reaches the tables before they are joined or shuffled.
    """
    draw = F.conv(F.substring(F.md5(F.col("record_id")), 1, 8), 16, 10).cast("bigint")
    counts = {r["head"]: r["n"] for r in rows.groupBy("head").agg(F.count("*").alias("n")).collect() if r["n"] >= least}  # a dozen heads
    if most is None:
        return rows.where(F.col("head").isin(*counts) & F.col("record_id").isNotNull()) if counts else rows.limit(0)
    bounds = {head: int(4294967296.0 * (1.5 * most + 100) / n) for head, n in counts.items()}
    bound = F.lit(None).cast("bigint")
    for head, highest in bounds.items():
        bound = F.when(F.col("head") == head, F.lit(highest)).otherwise(bound)
    near = rows.where(draw <= F.lit(max(bounds.values(), default=-1))).where(draw <= bound).withColumn("draw", draw)
    order = Window.partitionBy("head").orderBy("draw", "record_id")
    return near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).drop("draw", "at")


def grouped(sample: DataFrame) -> DataFrame:
    """Append group_id: the leader of the sequence among all sampled sequences, or the buffer of condition heads."""
    leaders = splits.similarity_groups(sample.where("group_by = 'sequence'").select("sequence"), "sequence")
    buffer = F.concat_ws("/", *[F.format_number(F.round(f, 3), 3) for f in ("k", "na", "li_nh4", "mg")])
    j = sample.join(leaders.withColumnRenamed("s", "sequence"), "sequence", "left")
    return j.withColumn("group_id", F.when(F.col("group_by") == "condition", buffer).otherwise(F.col("leader"))).drop("leader")


def folded(rows: DataFrame, folds=FOLDS) -> DataFrame:
    """Append fold per head: whole groups, class counts (of values: sizes) spread evenly."""
    rows = rows.withColumn("_class", F.when(F.col("task") == "regression", 0.0).otherwise(F.col("label")))
    placed = splits.stratified_folds(rows, "group_id", "_class", folds, ["head"])
    return rows.drop("_class").join(placed.select("head", "group_id", "fold"), ["head", "group_id"])


# ------------------------------------------------------------------- features
def columns_of(kind, conditions=True):
    """SQL feature names of a kind, without k-mers; they are counted from the text inside the task."""
    return features.sequence_feature_names(kind, False) + (features.CONDITION_NAMES + features.INTERACTION_NAMES if conditions else [])


def matrix(texts, kind, given):
    """Features of a list of sequences in their buffers: named sequence block, buffer blocks, 1-, 2- and 3-mers."""
    return features.batch_matrix(features.sequence_blocks(texts, kind), given)


def _without_conditions(kind, width):
    named_block, buffers = len(columns_of(kind, False)), len(columns_of(kind))
    return np.r_[0:named_block, buffers:width]


# ----------------------------------------------------------------------- fits
FITTED = ("head string, kind string, task string, seed int, conditions boolean, record_id string, group_id string, "
          "fold int, label double, value array<double>, model binary")


def placed_sample(rows: DataFrame, specs, most=MAX_ROWS, folds=FOLDS) -> DataFrame:
    """The rows of every head that it is fitted on with group_id and fold, written after each step that later ones read again."""
    return cut_lineage(folded(cut_lineage(grouped(cut_lineage(sampled(head_rows(rows, specs), most)))), folds))


def fit(placed: DataFrame, specs, variants=(True,)) -> DataFrame:
    """One row per head, member and held-out record (value), and one per head and member with the refitted model.

    placed: see placed_sample. variants: with and without condition features; both use the same folds.
    """
    x = placed.select("head", "kind", "task", "n_classes", "members", "record_id", "group_id", "sequence", "fold", "label", *condition.FIELDS,
                      F.explode(F.array(*[F.lit(v) for v in variants])).alias("conditions"))
    x = x.withColumn("seed", F.explode(F.sequence(F.lit(0), F.col("members") - 1)))

    def work(frame):
        frame = frame.sort_values("record_id")
        head, kind, task = (frame[c].iloc[0] for c in ("head", "kind", "task"))
        seed, classes, conditions = int(frame["seed"].iloc[0]), int(frame["n_classes"].iloc[0]), bool(frame["conditions"].iloc[0])
        full = matrix(list(frame["sequence"]), kind, frame)
        full = full if conditions else full[:, _without_conditions(kind, full.shape[1])]
        y, fold = frame["label"].to_numpy(), frame["fold"].to_numpy()
        value = [None] * len(y)
        for f in np.unique(fold):
            out = fold == f
            model = boosting.fit(full[~out], y[~out], task, classes, seed, ROUNDS)
            for i, v in zip(np.flatnonzero(out), boosting.evaluate(model, full[out], task)):
                value[i] = v.tolist()
        whole = boosting.packed(boosting.fit(full, y, task, classes, seed, ROUNDS))
        names = ["record_id", "group_id", "fold", "label"]
        out = pd.DataFrame({c: [*frame[c], None] for c in names} | {"value": [*value, None], "model": [*[None] * len(y), whole]})
        for c, v in (("head", head), ("kind", kind), ("task", task), ("seed", seed), ("conditions", conditions)):
            out[c] = v
        return out

    return cut_lineage(x.groupBy("head", "seed", "conditions").applyInPandas(work, FITTED))


def cut_points(placed: DataFrame, folds=FOLDS) -> dict:
    """{head: cut points (fit, feature, BINS - 1)}; fit f leaves fold f out, the last takes every row.

    They are the quantiles boosting.fit takes of all rows of a fit, found from how often each value of a feature occurs in
    each fold: a task counts its rows, equal values are added up, and only the cut points reach the driver.
    """
    at = np.linspace(0, 1, boosting.BINS + 1)[1:-1]

    def counted(frames):
        for frame in frames:
            for (head, kind), part in frame.groupby(["head", "kind"], sort=False):
                full, fold = matrix(list(part["sequence"]), kind, part), part["fold"].to_numpy()
                found = []
                for j in range(full.shape[1]):
                    value, which = np.unique(full[:, j], return_inverse=True)
                    n = np.bincount(which * folds + fold, minlength=len(value) * folds)
                    cell = np.flatnonzero(n)
                    found.append((np.full(len(cell), j, dtype=np.int32), cell % folds, value[cell // folds], n[cell]))
                feature, fold, value, n = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"head": head, "feature": feature, "fold": fold, "value": value, "n": n})

    def cuts(group):
        group = group.sort_values("value")
        value, n, fold = group["value"].to_numpy(), group["n"].to_numpy(), group["fold"].to_numpy()
        out = []
        for f in range(folds + 1):
            upto = np.cumsum(np.where(fold != f, n, 0))
            place = max(upto[-1] - 1, 0) * at
            low = np.floor(place).astype(np.int64)
            a, b = (value[np.minimum(np.searchsorted(upto, x, "right"), len(value) - 1)].astype(np.float64) for x in (low, np.minimum(low + 1, max(upto[-1] - 1, 0))))
            out.append(np.where(a == b, a, a + (b - a) * (place - low)).astype(np.float32))
        return pd.DataFrame({"head": [group["head"].iloc[0]], "feature": [group["feature"].iloc[0]], "cuts": [np.concatenate(out)]})

    rows = placed.select("head", "kind", "fold", "sequence", *condition.FIELDS)
    counts = rows.mapInPandas(counted, "head string, feature int, fold int, value float, n long")
    counts = counts.groupBy("head", "feature", "fold", "value").agg(F.sum("n").alias("n"))
    found = counts.groupBy("head", "feature").applyInPandas(cuts, "head string, feature int, cuts array<float>").collect()  # features x heads
    out = {}
    for r in found:
        out.setdefault(r["head"], {})[r["feature"]] = np.array(r["cuts"], dtype=np.float32).reshape(folds + 1, -1)
    return {head: np.stack([of[j] for j in range(len(of))], axis=1) for head, of in out.items()}


def fit_whole(placed: DataFrame, folds=FOLDS, rounds=ROUNDS) -> DataFrame:
    """What `fit` returns, of any number of rows: a task reads the rows of one head and member from files of its own.

    A row travels as one code per feature, its place among the cut points of all fits of its head.
    """
    cuts = cut_points(placed, folds)
    spark = placed.sparkSession
    held = spark.sparkContext.broadcast(cuts)   # heads x features x fits x cut points, whatever the rows

    def coded(frames):
        known = {head: [np.unique(c[:, j]) for j in range(c.shape[1])] for head, c in held.value.items()}
        for frame in frames:
            for (head, kind), part in frame.groupby(["head", "kind"], sort=False):
                full = matrix(list(part["sequence"]), kind, part)
                codes = np.empty(full.shape, dtype=np.uint8)
                for j, cut in enumerate(known[head]):
                    codes[:, j] = np.searchsorted(cut, full[:, j], "left")
                yield part[["head", "kind", "task", "n_classes", "members", "record_id", "group_id", "fold", "label"]].assign(codes=[row.tobytes() for row in codes])

    kept = "head string, kind string, task string, n_classes int, members int, record_id string, group_id string, fold int, label double"
    rows = placed.select("head", "kind", "task", F.col("n_classes").cast("int"), "members", "record_id", "group_id", F.col("fold").cast("int"), F.col("label").cast("double"),
                         "sequence", *condition.FIELDS)
    rows = cut_lineage(rows.mapInPandas(coded, f"{kept}, codes binary"))
    rows = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.col("members") - 1)))
    members = sorted((r["head"], r["seed"]) for r in rows.select("head", "seed").distinct().collect())  # heads x members
    task = spark.createDataFrame([(*m, i) for i, m in enumerate(members)] or [("", 0, 0)], "head string, seed int, _task int")
    rows = rows.join(F.broadcast(task), ["head", "seed"]).repartitionById(max(len(members), 1), "_task")
    rows = rows.sortWithinPartitions("head", "seed", "record_id", "fold", "label", "codes")
    names = ["record_id", "group_id", "fold", "label"]

    def work(batches):
        group, known = None, None
        for batch in batches:
            for (head, seed), part in batch.to_pandas().groupby(["head", "seed"], sort=False):
                if group is None:
                    where = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
                    folder = tempfile.TemporaryDirectory(prefix="fit-", dir=where)
                    first = part.iloc[0]
                    group = {c: first[c] for c in ("head", "kind", "task")} | {"seed": int(seed), "conditions": True}
                    n_classes, width = int(first["n_classes"]), held.value[head].shape[1]
                    rows = boosting.Stored(folder.name, width)
                    known = pa.OSFile(os.path.join(folder.name, "rows"), "wb")
                    told = pa.schema([("record_id", pa.string()), ("group_id", pa.string()), ("fold", pa.int32()), ("label", pa.float64())])
                    names_file = pa.ipc.new_file(known, told)
                rows.add(np.frombuffer(b"".join(part["codes"]), dtype=np.uint8).reshape(len(part), width), part["label"], part["fold"])
                names_file.write_batch(pa.RecordBatch.from_pandas(part[names], schema=told, preserve_index=False))
        if group is None:
            return
        names_file.close()
        known.close()
        rows.close()
        with folder:
            cut = held.value[group["head"]]
            codes = [np.unique(cut[:, j]) for j in range(width)]
            value = None
            present = [f for f in range(folds) if any((rows.fold[low:high] == f).any() for low, high in rows.blocks)]
            for f in [*present, folds]:
                bins = []
                for j, all_cuts in enumerate(codes):   # a code stands for values up to its cut point, the last for those beyond
                    bins.append(np.searchsorted(cut[f, j], np.r_[all_cuts, np.inf], "left").astype(np.uint8))
                model, score = rows.fit(cut[f], bins, f, group["task"], n_classes, group["seed"], rounds)
                if value is None:
                    value = rows.array("value", score.shape, np.float64)
                for low, high in rows.blocks:
                    out = rows.fold[low:high] == f
                    value[low:high][out] = boosting.posterior(score[low:high][out], group["task"])
            with pa.memory_map(os.path.join(folder.name, "rows")) as source:
                stored = pa.ipc.open_file(source)
                for i, (low, high) in enumerate(rows.blocks):
                    yield _answers(group, stored.get_batch(i).to_pandas(), list(value[low:high]), None)
            yield _answers(group, pd.DataFrame({c: [None] for c in names}), [None], boosting.packed(model))

    return cut_lineage(rows.mapInArrow(work, FITTED))


def _answers(group, known, value, model):
    """Rows of FITTED: answers of known rows, or the refitted model."""
    out = known.assign(value=value, model=model, **group)
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
    fields = [f.split() for f in FITTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[c], type=kinds[k], from_pandas=True) for c, k in fields], names=[c for c, _ in fields])


def out_of_fold(fitted: DataFrame) -> DataFrame:
    """head, task, conditions, record_id, group_id, fold, label, members (array of answers), in order of seed."""
    rows = fitted.where("model IS NULL")
    held = rows.groupBy("head", "task", "conditions", "record_id", "group_id", "fold", "label").agg(
        F.array_sort(F.collect_list(F.struct("seed", "value"))).alias("m"))  # five members
    return held.withColumn("members", F.col("m.value")).drop("m")


def answer(members, i=0):
    """Mean of one output over the members."""
    return F.aggregate(members, F.lit(0.0), lambda a, m: a + F.get(m, i)) / F.size(members)


def _evaluated(fitted, full, task):
    """Answers per row, member and output."""
    return np.stack([boosting.evaluate(m, full, task) for m in fitted], axis=1)


def _nested(value):
    n, m, o = value.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(n * m + 1, dtype=np.int32) * o), pa.array(value.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), inner)


class Heads:
    """Fitted heads with their training ranges, half-widths and short lists of known sequences."""

    def __init__(self, rows: DataFrame, specs, most=MAX_ROWS, variants=(True,), alpha=ALPHA):
        self.spark, self.specs = rows.sparkSession, {s[0]: s for s in specs}
        self.sample = placed_sample(rows, specs, most)
        self.fitted = fit(self.sample, specs, variants) if most is not None else fit_whole(self.sample)
        models = self.fitted.where("model IS NOT NULL AND conditions").select("head", "seed", "model").collect()  # heads x members
        self.models = {}
        for r in sorted(models, key=lambda r: (r["head"], r["seed"])):
            self.models.setdefault(r["head"], []).append(boosting.unpacked(bytes(r["model"])))
        self.held = out_of_fold(self.fitted).where("conditions")
        residual = self.held.where("task = 'regression'").withColumn("r", F.abs(answer("members") - F.col("label")))
        self.halfwidths = {r["head"]: r["q0"] for r in ordered.exact_quantiles(residual, "r", [1 - alpha], ["head"]).collect()}
        self.ranges = cut_lineage(atlas.applicability(self.sample.select("head", "sequence", *condition.FIELDS), ["head"]))  # nine per head
        few = self.sample.groupBy("head").agg(F.countDistinct("sequence").alias("n")).where(F.col("n") <= ALLOW_LIST).select("head")
        self.allowed = cut_lineage(self.sample.join(few, "head").select("head", "sequence").distinct())  # at most ALLOW_LIST per head
        fixed = self.ranges.where("axis = 'ph' AND n_unique = 1").collect()
        self.fixed_ph = {r["head"]: r["lo"] for r in fixed if self.specs[r["head"]][3] == "ph_t"}

    def members(self, df: DataFrame, heads=None) -> DataFrame:
        """One row per row of df (sequence, condition fields and others, kept) and head: head, members."""
        def answers(texts, kind, given, models, extra):
            full = matrix(texts.to_pylist(), kind, given)
            for head, (task, fitted) in models.items():
                yield [pa.array([head] * len(full)), _nested(_evaluated(fitted, full, task))]
        return self._all(df, heads, answers, "head string, members array<array<double>>")

    def wide(self, df: DataFrame, heads, name: str) -> DataFrame:
        """df with `name`, per row an array of structs (head, members) over the named heads; empty where there is no sequence."""
        def answers(texts, kind, given, models, extra):
            full = matrix(texts.to_pylist(), kind, given)
            n, h = len(full), len(models)
            members = pa.concat_arrays([_nested(_evaluated(fitted, full, task)) for task, fitted in models.values()])
            order = np.arange(n * h).reshape(h, n).T.ravel()     # all rows of one head, dealt to rows
            told = pa.StructArray.from_arrays([pa.array([*models] * n), members.take(pa.array(order))], names=["head", "members"])
            yield [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h), told)]
        kind = "array<struct<head: string, members: array<array<double>>>>"
        told, blank = df.where(F.length("sequence") > 0), df.where(F.coalesce(F.length("sequence"), F.lit(0)) == 0)
        told, blank = (x.withColumn(name, F.array().cast(kind)) for x in (told, blank))
        for group in self._groups(heads):
            told = self._over(told, group, answers, f"_more {kind}").withColumn(name, F.concat(name, "_more")).drop("_more")
        return told.unionByName(blank)

    def deltas(self, df: DataFrame, heads, wild: str, asked: str, keep=None) -> DataFrame:
        """Columns `keep` of df (None: all) with head, delta and delta_sd: member-wise `sequence` minus the sequence `wild` in the same buffer.

        Rows that `asked` is not true for have no number. Rows of one wild type that travel together share its evaluation;
        nothing is joined, and a row travels once, whatever the number of heads.
        """
        keep = keep or df.columns

        def answers(texts, kind, given, models, extra):
            asked = extra[1].fill_null(False)
            n, h = len(texts), len(models)
            rows = np.flatnonzero(asked.to_numpy(zero_copy_only=False))
            mean, spread = np.zeros((n, h)), np.zeros((n, h))
            if len(rows):
                given = {f: v[rows] for f, v in given.items()}
                names = extra[0].filter(asked).dictionary_encode()
                keys = np.vstack([names.indices.to_numpy(), *given.values()])
                new = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
                first, again = np.flatnonzero(new), np.cumsum(new) - 1
                before = matrix(names.take(pa.array(first)).to_pylist(), kind, {f: v[first] for f, v in given.items()})
                full = matrix(texts.filter(asked).to_pylist(), kind, given)
                for i, (task, fitted) in enumerate(models.values()):
                    d = _evaluated(fitted, full, task)[:, :, 0] - _evaluated(fitted, before, task)[again, :, 0]
                    mean[rows, i], spread[rows, i] = d.mean(axis=1), d.std(axis=1)
            without = np.repeat(~asked.to_numpy(zero_copy_only=False), h)
            head = pa.array([*models]).take(pa.array(np.tile(np.arange(h), n)))
            told = pa.StructArray.from_arrays([head, *(pa.array(v.ravel(), mask=without) for v in (mean, spread))], names=["head", "delta", "delta_sd"])
            yield [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h), told)]

        out = self._all(df.where(F.length(wild) > 0), heads, answers, "_told array<struct<head: string, delta: double, delta_sd: double>>", (wild, asked), keep)
        return out.select(*keep, F.inline("_told"))

    def scanned(self, df: DataFrame, heads, axis: str, values) -> DataFrame:
        """One row per row of df, head and value of one condition: point, head, members; sequences are read once."""
        def answers(texts, kind, given, models, extra):
            blocks = features.sequence_blocks(texts.to_pylist(), kind)
            for point in values:
                full = features.batch_matrix(blocks, {**given, axis: np.full(len(given[axis]), float(point))})
                for head, (task, fitted) in models.items():
                    yield [pa.array(np.full(len(full), float(point))), pa.array([head] * len(full)), _nested(_evaluated(fitted, full, task))]
        return self._all(df, heads, answers, "point double, head string, members array<array<double>>")

    def _groups(self, heads):
        """(kind, pH, heads) of heads asked together; a head fitted at one pH is only asked at that one."""
        plan = {}
        for head in heads:
            if head in self.models:
                plan.setdefault((self.specs[head][1], self.fixed_ph.get(head)), []).append(head)
        return [(*at, names) for at, names in sorted(plan.items(), key=str)]

    def _all(self, df, heads, answers, tail, extra=(), keep=None):
        out = None
        for group in self._groups(heads or sorted(self.models)):
            part = self._over(df, group, answers, tail, extra, keep)
            out = part if out is None else out.unionByName(part)
        return df.select(*keep or df.columns).limit(0).crossJoin(self.spark.createDataFrame([], tail)) if out is None else out

    def _over(self, df, group, answers, tail, extra=(), keep=None):
        """Columns `keep` of df and the columns `tail` that answers(texts, kind, buffers, models, extra columns) makes of each batch of rows with a sequence."""
        kind, ph, names = group
        keep = keep or df.columns
        kept = df.select(F.struct(*keep)).schema[0].dataType.simpleString()
        x = df.where(F.length("sequence") > 0).select(F.struct(*keep).alias("kept"), "sequence", *[
            (F.lit(ph) if f == "ph" and ph is not None else F.col(f)).cast("double").alias(f) for f in condition.FIELDS], *[F.col(c).alias(f"_{c}") for c in extra])
        held = self.spark.sparkContext.broadcast({h: (self.specs[h][2], self.models[h]) for h in names})
        width = 2 + len(condition.FIELDS)
        told = ["kept", *(f.name for f in StructType.fromDDL(tail))]

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    given = {f: batch.column(2 + i).to_numpy(zero_copy_only=False) for i, f in enumerate(condition.FIELDS)}
                    for columns in answers(batch.column(1), kind, given, held.value, batch.columns[width:]):
                        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=told)

        out = x.mapInArrow(work, f"kept {kept}, {tail}")
        return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], *told[1:])

    def gated(self, df: DataFrame, heads=None) -> DataFrame:
        """One row per row of df and head (rows that name a head: per row): refusal (a reason, or null) and in_domain.

        Refusals, most binding first: no nucleotides; a sequence the short list of the head does not hold; a genomic
        window to a folding head. What is only outside the training ranges or has the wrong motif is answered and marked.
        """
        wide = self.ranges.groupBy("head").pivot("axis", atlas.AXES).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n_unique").alias("n"))
        info = self.spark.createDataFrame([(h, s[1], s[3]) for h, s in self.specs.items() if h in self.models], "head string, head_kind string, target string")
        listed = self.allowed.groupBy("head").agg(F.collect_set("sequence").alias("known"))  # at most ALLOW_LIST
        table = info.join(wide, "head").join(listed, "head", "left")
        table = table.where(F.col("head").isin(list(heads))) if heads else table
        j = df.join(F.broadcast(table), "head") if "head" in df.columns else df.crossJoin(F.broadcast(table))  # a dozen heads
        length = F.length("sequence")
        refusal = (F.when(F.col("sequence").rlike("^N*$"), "no_nucleotides")
                   .when(F.col("known").isNotNull() & ~F.array_contains("known", F.col("sequence")), "not_in_allow_list")
                   .when(F.col("head").isin(*WINDOW_REFUSED) & (length > F.col("length_hi")), "genomic_window"))
        outside = atlas.motif_gate(F.col("head_kind"), F.col("sequence")) | (length < F.col("length_lo")) | (length > F.col("length_hi"))
        for f in condition.FIELDS:
            exempt = {"ph": F.col("target") == "ph_t", "temperature": F.col("target") == "tm"}.get(f, F.lit(False))
            beyond = (F.col(f) < F.col(f"{f}_lo")) | (F.col(f) > F.col(f"{f}_hi"))
            between = (F.col(f"{f}_n") <= 2) & ~F.col(f).isin(F.col(f"{f}_lo"), F.col(f"{f}_hi"))
            outside = outside | (~exempt & (beyond | between))
        return j.withColumns({"refusal": refusal, "in_domain": ~outside}).select(*[c for c in df.columns if c != "head"], "head", "refusal", "in_domain")

    def predict(self, df: DataFrame, ids, heads=None) -> DataFrame:
        """Long table of answers: ids, head, value, spread, low, high, probability, posterior, folded_fraction, refusal, in_domain.

        Which of the number columns is filled depends on the task; a refused row has none of them.
        """
        names = [h for h in heads or sorted(self.models) if h in self.models]
        blank = df.where(F.coalesce(F.length("sequence"), F.lit(0)) == 0)
        blank = blank.select("*", F.explode(F.array(*[F.lit(h) for h in names]).cast("array<string>")).alias("head"), F.lit(None).cast("array<array<double>>").alias("members"))
        j = self.gated(self.members(df, heads).unionByName(blank))  # answers stay in their rows: nothing grows into a join
        of = self.spark.createDataFrame([(h, s[2], s[3], s[4], self.halfwidths.get(h)) for h, s in self.specs.items()],
                                        "head string, task string, target string, classes array<string>, halfwidth double")
        j = j.join(F.broadcast(of), "head")
        told = F.col("refusal").isNull() & F.col("members").isNotNull()
        number = told & (F.col("task") == "regression")
        value = F.when(number, answer("members"))
        j = j.withColumn("value", value)
        spread = F.sqrt(F.aggregate("members", F.lit(0.0), lambda a, m: a + F.pow(F.get(m, 0) - F.col("value"), 2)) / F.size("members"))
        posterior = F.map_from_entries(F.transform("classes", lambda c, i: F.struct(c, F.aggregate("members", F.lit(0.0), lambda a, m: a + F.get(m, i)) / F.size("members"))))
        shape = (F.when(F.col("target") == "tm", thermo.folded_at_temperature(F.col("temperature"), F.col("value")))
                 .when(F.col("target") == "ph_t", thermo.folded_at_ph(F.col("ph"), F.col("value"))))
        return j.select(*ids, "head", "value", F.when(number, spread).alias("spread"),
                        F.when(number, F.col("value") - F.col("halfwidth")).alias("low"), F.when(number, F.col("value") + F.col("halfwidth")).alias("high"),
                        F.when(told & (F.col("task") == "binary"), answer("members")).alias("probability"),
                        F.when(told & (F.col("task") == "multiclass"), posterior).alias("posterior"),
                        F.when(number, shape).alias("folded_fraction"), "refusal", "in_domain")


# ---------------------------------------------------------------------- scans
def scored_kinds(model: Heads):
    """{kind: its trained heads that answer with one number}."""
    out = {}
    for head in sorted(model.models):
        if model.specs[head][2] != "multiclass":
            out.setdefault(model.specs[head][1], []).append(head)
    return out


def member_deltas(model: Heads, wild: DataFrame, mutants: DataFrame, key, heads) -> DataFrame:
    """Append head, delta and delta_sd to mutants: member-wise mutant minus wild type, then mean and population spread.

    wild: *key, sequence and conditions, one row per key; mutants: *key, sequence, conditions and others.
    """
    base = model.members(wild.select(*key, "sequence", *condition.FIELDS), heads).select(*key, "head", F.col("members").alias("_w"))
    j = model.members(mutants, heads).join(base.hint("merge"), [*key, "head"])  # one row per key and head: never broadcast
    d = F.zip_with("members", "_w", lambda a, b: F.get(a, 0) - F.get(b, 0))
    j = j.withColumn("_d", d)
    mean = F.aggregate("_d", F.lit(0.0), lambda a, v: a + v) / F.size("_d")
    j = j.withColumn("delta", mean)
    spread = F.sqrt(F.aggregate("_d", F.lit(0.0), lambda a, v: a + (v - F.col("delta")) * (v - F.col("delta"))) / F.size("_d"))
    return j.withColumn("delta_sd", spread).drop("members", "_w", "_d")


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({f: F.lit(v) for f, v in condition.DEFAULTS.items() if f not in df.columns})


def mutation_scan(model: Heads, df: DataFrame, key: str, s: str, routed, substitutions, state) -> DataFrame:
    """Every substitution of every sequence for every head of one number, on the strand its kind is asked about.

    Columns: key, head, strand, label, state, other_gain (the other strand gains a motif; reported, never scored),
    delta and delta_sd. A lost motif, or none before and after, has no number.
    """
    out = None
    for kind, names in scored_kinds(model).items():
        if kind == "locus":
            continue
        wild = with_defaults(routed(df, s, kind)).withColumn("_before", motif.motif_count("sequence", kind)).withColumn(
            "_other", motif.has_motif(seq.revcomp("sequence"), kind))
        edits = substitutions(wild.select(key, "sequence", "strand", "_before", "_other", *condition.FIELDS), [key, "strand", "_before", "_other", *condition.FIELDS], "sequence")
        edits = edits.withColumn("_after", motifs.count_after("_before", "wt", "alt", "mutant", kind))
        edits = edits.withColumns({"state": state(F.col("_before"), F.col("_after")), "other_gain": motifs.other_strand_gain("_other", "wt", "alt", "mutant", kind)})
        columns = [key, "strand", "label", "state", "other_gain"]
        without = F.col("state").isin("motif_lost", "no_motif")
        todo = edits.where(~without).select(*columns, F.col("sequence").alias("wild"), F.col("mutant").alias("sequence"), *condition.FIELDS, F.lit(True).alias("usable"))
        part = model.deltas(todo, names, "wild", "usable", columns)
        # an edit without a number needs no task that scores; most are
        blank = edits.where(without & (F.length("sequence") > 0)).select(*columns, F.explode(F.array(*map(F.lit, names))).alias("head"), *[
            F.lit(None).cast("double").alias(c) for c in ("delta", "delta_sd")])
        part = part.unionByName(blank)
        out = part if out is None else out.unionByName(part)
    return out


def condition_scan(model: Heads, df: DataFrame, ids, axis: str, values) -> DataFrame:
    """(*ids, head, axis, state, point, value): one condition varied, everything else as given.

    A head whose training rows never varied along the axis is inert: it keeps one row with that state and no number.
    """
    seen = {r["head"]: r["n_unique"] for r in model.ranges.where(F.col("axis") == axis).collect()}  # one row per head
    names = [h for names in scored_kinds(model).values() for h in names]
    varied = [h for h in names if seen.get(h, 0) > 1]
    inert = df.select(*ids, F.explode(F.array(*[F.lit(h) for h in names if h not in varied]).cast("array<string>")).alias("head"), F.lit(axis).alias("axis"),
                      F.lit("inert").alias("state"), F.lit(None).cast("double").alias("point"), F.lit(None).cast("double").alias("value"))
    if not varied:
        return inert
    points = model.scanned(df, varied, axis, values).select(*ids, "head", F.lit(axis).alias("axis"), F.lit("varied").alias("state"), "point", answer("members").alias("value"))
    return points.unionByName(inert)


def fingerprint(model: Heads) -> str:
    """Digest of all fitted members, whatever the order they were fitted in."""
    import hashlib
    total = hashlib.sha256()
    for head in sorted(model.models):
        for member in model.models[head]:
            for name in sorted(member):
                total.update(f"{head}:{name}".encode() + np.ascontiguousarray(member[name]).tobytes())
    return total.hexdigest()
