"""Model features as named columns: sequence, buffer and interaction blocks."""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import condition, motif, seq

# fixed values: feature names and their order
ARCHITECTURE = [
    "has_4tracts", "tract_len_min", "tract_len_max", "tract_len_mean", "loop1", "loop2", "loop3",
    "loop_total", "loop_mean", "loop_sd", "loop_min", "loop_max", "loop_asymmetry", "core_span",
    "flank_len", "loop_gc", "loop_frac_T", "loop_frac_A", "n_bulges",
]
COMPOSITION = [
    "length", "log_length", "gc", "frac_A", "frac_C", "frac_G", "frac_T", "purine_frac",
    "g4h_mean", "g4h_absmean", "g4h_win_max",
]
# the kind's own run block comes first; the explicit G and C blocks follow (suffix _all)
RUNS = ["n_runs", "max_run", "mean_run", "n_Gruns", "max_Grun", "n_Cruns", "max_Crun"]
TAIL = ["longest_homopolymer", "shannon_entropy"]
NAMED = COMPOSITION + RUNS + ARCHITECTURE + TAIL
KMERS = ["".join(p) for k in (1, 2, 3) for p in itertools.product("ACGT", repeat=k)]
KMERS_NAMED = [f"k{len(m)}_{m}" for m in KMERS]
# buffer protonation of cytosine N3: fixed value
CYTOSINE_PKA = 4.6


def kmer_columns(s):
    """Frequencies of every 1-, 2- and 3-mer; k-mers holding N count only in the denominator."""
    s = F.col(s)
    return {f"k{len(m)}_{m}": seq.kmer_count(s, m) / F.greatest(F.length(s) - (len(m) - 1), F.lit(1)) for m in KMERS}


def with_composition(df: DataFrame, s: str) -> DataFrame:
    c = F.col(s)
    n = F.length(c)
    share = {b: F.when(n > 0, seq.count_of(c, b) / n).otherwise(F.lit(0.0)) for b in seq.BASES}
    df = df.withColumns({f"frac_{b}": e for b, e in share.items()})
    df = seq.with_window_means(df, s, "_means")
    return df.withColumns({
        "length": n.cast("double"),
        "log_length": F.when(n > 0, F.log(n)).otherwise(F.lit(0.0)),
        "gc": F.col("frac_G") + F.col("frac_C"),
        "purine_frac": F.col("frac_A") + F.col("frac_G"),
        "g4h_mean": seq.hunter_mean(c),
        "g4h_win_max": F.array_max(F.transform("_means", lambda v: F.abs(v))),
        "shannon_entropy": F.when(n > 0, seq.entropy(c)).otherwise(F.lit(0.0)),
    }).withColumn("g4h_absmean", F.abs("g4h_mean")).drop("_means")


def with_runs(df: DataFrame, s: str, kind: str) -> DataFrame:
    base, c = motif.BASE[kind], F.col(s)
    longest = lambda b: F.coalesce(F.array_max(F.transform(
        F.regexp_extract_all(c, F.lit(f"({b}+)"), 1), lambda r: F.length(r))), F.lit(0)).cast("double")
    number = lambda b: F.regexp_count(c, F.lit(f"{b}{{2,}}")).cast("double")
    stretches = F.regexp_count(c, F.lit(f"{base}+"))
    df = df.withColumns({f"_max_{b}": longest(b) for b in seq.BASES})
    return df.withColumns({
        "n_Gruns": number("G"), "max_Grun": F.col("_max_G"), "n_Cruns": number("C"), "max_Crun": F.col("_max_C"),
        "n_runs": number(base), "max_run": F.col(f"_max_{base}"),
        "mean_run": F.when(stretches > 0, seq.count_of(c, base) / stretches).otherwise(F.lit(0.0)),
        "longest_homopolymer": F.greatest(*[F.col(f"_max_{b}") for b in seq.BASES]),
    }).drop(*[f"_max_{b}" for b in seq.BASES])


def with_architecture(df: DataFrame, s: str, kind: str, prefix: str = "") -> DataFrame:
    """Tract and loop geometry of the first admissible four-run window."""
    df = motif.with_tract_parts(df, s, motif.BASE[kind])
    tract = [F.length(F.get("_r", F.col("_at") + i)) for i in range(4)]
    loop = [F.get("_g", F.col("_at") + i + 1) for i in range(3)]
    df = df.withColumns(
        {f"_t{i}": F.coalesce(tract[i], F.lit(0)) for i in range(4)}
        | {f"_l{i}": F.coalesce(F.length(loop[i]), F.lit(0)) for i in range(3)}
        | {"_loops": F.coalesce(F.concat(*loop), F.lit(""))})
    t, l = [F.col(f"_t{i}") for i in range(4)], [F.col(f"_l{i}") for i in range(3)]
    total = l[0] + l[1] + l[2]
    mean = total / 3
    inside = F.greatest(F.length("_loops"), F.lit(1))
    span = F.when(F.col("_at").isNull(), F.length(s)).otherwise(t[0] + t[1] + t[2] + t[3] + total)
    shortest = F.least(*t)
    out = {
        "has_4tracts": F.col("_at").isNotNull().cast("double"),
        "tract_len_min": shortest, "tract_len_max": F.greatest(*t), "tract_len_mean": (t[0] + t[1] + t[2] + t[3]) / 4,
        "loop1": l[0], "loop2": l[1], "loop3": l[2], "loop_total": total, "loop_mean": mean,
        "loop_sd": F.sqrt((F.pow(l[0] - mean, 2) + F.pow(l[1] - mean, 2) + F.pow(l[2] - mean, 2)) / 3),
        "loop_min": F.least(*l), "loop_max": F.greatest(*l),
        "loop_asymmetry": F.abs(l[0] - l[2]) / F.greatest(l[0] + l[2], F.lit(1)),
        "core_span": span, "flank_len": F.length(s) - span,
        "loop_gc": (seq.count_of("_loops", "G") + seq.count_of("_loops", "C")) / inside,
        "loop_frac_T": seq.count_of("_loops", "T") / inside,
        "loop_frac_A": seq.count_of("_loops", "A") / inside,
        "n_bulges": sum(((x != shortest).cast("int") for x in t[1:]), (t[0] != shortest).cast("int")),
    }
    df = df.withColumns({prefix + k: v.cast("double") for k, v in out.items()})
    return df.drop("_r", "_g", "_at", "_loops", *[f"_t{i}" for i in range(4)], *[f"_l{i}" for i in range(3)])


def with_sequence_features(df: DataFrame, s: str, kind: str = "G4", with_kmers: bool = True) -> DataFrame:
    """The sequence block; kind 'locus' is the G4 block plus the C-tract architecture under im_*."""
    main = "G4" if kind == "locus" else kind
    df = with_architecture(with_runs(with_composition(df, s), s, main), s, main)
    if kind == "locus":
        df = with_architecture(df, s, "iM", "im_")
        stretches = F.regexp_count(F.col(s), F.lit("C+"))
        df = df.withColumns({"im_n_Cruns": F.col("n_Cruns"), "im_max_Crun": F.col("max_Crun"),
                             "im_mean_Crun": F.when(stretches > 0, seq.count_of(s, "C") / stretches)
                             .otherwise(F.lit(0.0))})
    return df.withColumns(kmer_columns(s)) if with_kmers else df


def sequence_feature_names(kind: str = "G4", with_kmers: bool = True):
    names = list(NAMED)
    if kind == "locus":
        names += ["im_" + a for a in ARCHITECTURE] + ["im_n_Cruns", "im_max_Crun", "im_mean_Crun"]
    return names + ([f"k{len(m)}_{m}" for m in KMERS] if with_kmers else [])


def condition_columns():
    """Buffer block from the eight condition columns."""
    c = F.col
    mono, ionic, competent = condition.monovalent(), condition.ionic_strength(), condition.competent_cation()
    part = lambda x: F.when(mono > 0, x / mono).otherwise(F.lit(0.0))
    return {
        "log1p_k": F.log1p(c("k")), "log1p_na": F.log1p(c("na")), "log1p_li_nh4": F.log1p(c("li_nh4")),
        "log1p_mg": F.log1p(c("mg")), "monovalent": mono, "log1p_monovalent": F.log1p(mono),
        "ionic_strength": ionic, "log1p_ionic_strength": F.log1p(ionic),
        "k_fraction": part(c("k")), "na_fraction": part(c("na")), "li_fraction": part(c("li_nh4")),
        "g4_competent_cation": competent, "log1p_g4_competent": F.log1p(competent),
        "ph_minus_7": c("ph") - 7.0, "pka_minus_ph": F.lit(CYTOSINE_PKA) - c("ph"),
        "protonation_frac": 1 / (1 + F.pow(F.lit(10.0), c("ph") - CYTOSINE_PKA)),
        "log_strand_conc": F.log1p(c("strand_conc")),
        "has_crowder": (c("crowder_pct") > 0).cast("double"),
        "no_supporting_cation": (competent < 1.0).cast("double"),
    }


# fixed values: names of the buffer block
CONDITION_NAMES = list(condition.FIELDS) + [
    "log1p_k", "log1p_na", "log1p_li_nh4", "log1p_mg", "monovalent", "log1p_monovalent", "ionic_strength",
    "log1p_ionic_strength", "k_fraction", "na_fraction", "li_fraction", "g4_competent_cation",
    "log1p_g4_competent", "ph_minus_7", "pka_minus_ph", "protonation_frac", "log_strand_conc",
    "has_crowder", "no_supporting_cation"]


def interaction_columns():
    """Products of sequence and buffer columns."""
    c = F.col
    return {
        "gtracts_x_logK": c("n_Gruns") * c("log1p_k"), "gc_x_logIonic": c("gc") * c("log1p_ionic_strength"),
        "loopsum_x_logK": c("loop_total") * c("log1p_k"), "len_x_logK": c("length") * c("log1p_k"),
        "ctracts_x_protonation": c("n_Cruns") * c("protonation_frac"),
        "cfrac_x_protonation": c("frac_C") * c("protonation_frac"),
        "loopsum_x_protonation": c("loop_total") * c("protonation_frac"),
        "gc_x_temp": c("gc") * c("temperature") / 100.0,
        "g4h_x_logKcompetent": c("g4h_mean") * c("log1p_g4_competent"), "tracts_x_pH": c("has_4tracts") * c("ph"),
    }


# fixed values: names of the interaction block
INTERACTION_NAMES = [
    "gtracts_x_logK", "gc_x_logIonic", "loopsum_x_logK", "len_x_logK", "ctracts_x_protonation",
    "cfrac_x_protonation", "loopsum_x_protonation", "gc_x_temp", "g4h_x_logKcompetent", "tracts_x_pH"]


def featurize(df: DataFrame, s: str, kind: str = "G4", use_conditions: bool = True, with_kmers: bool = True):
    """Append every feature column; returns (DataFrame, ordered feature names)."""
    df = with_sequence_features(df, s, kind, with_kmers)
    names = sequence_feature_names(kind, with_kmers)
    if use_conditions:
        df = df.withColumns(condition_columns()).withColumns(interaction_columns())
        names = names + CONDITION_NAMES + INTERACTION_NAMES
    return df, names


# ------------------------------------------------------- the same features of a batch
# Expressions above serve tables of features. Scoring reads many short texts: the functions below give the same numbers
# for a batch inside a task, with all texts in one buffer.

def _architecture(kind, letter, tract_at, tract_n, owner, length, before):
    """Tract and loop geometry from the tracts (place, length, text) of a batch; before: running counts per letter."""
    texts, base = len(length), seq.BASES.index(motif.BASE[kind])
    count = np.bincount(owner, minlength=texts)
    at = np.cumsum(count) - count                            # the first window of four, unless one has short loops
    if len(owner) >= 4:
        gap = tract_at[1:] - tract_at[:-1] - tract_n[:-1]
        short = gap <= 12
        fits = np.flatnonzero((owner[3:] == owner[:-3]) & short[:-2] & short[1:-1] & short[2:])[::-1]
        at[owner[fits]] = fits                               # the smallest is written last
    has = count >= 4
    pick = np.where(has, at, 0)
    if not len(tract_n):
        tract_at = tract_n = np.zeros(4, dtype=np.int64)
    of = lambda x, i: np.where(has, x[np.minimum(pick + i, len(x) - 1)], 0).astype(np.float64)
    t, start = [of(tract_n, i) for i in range(4)], [of(tract_at, i) for i in range(4)]
    l = [start[i + 1] - start[i] - t[i] for i in range(3)]
    total = l[0] + l[1] + l[2]
    mean = total / 3
    inside = np.maximum(total, 1)
    low, high = (start[0] + t[0]).astype(np.int64), start[3].astype(np.int64)
    loops = [before[b][high] - before[b][low] - (t[1] + t[2] if b == base else 0) for b in range(4)]
    span = np.where(has, t[0] + t[1] + t[2] + t[3] + total, length)
    shortest = np.minimum.reduce(t)
    return [has, shortest, np.maximum.reduce(t), (t[0] + t[1] + t[2] + t[3]) / 4, *l, total, mean,
            np.sqrt(((l[0] - mean) ** 2 + (l[1] - mean) ** 2 + (l[2] - mean) ** 2) / 3), np.minimum.reduce(l), np.maximum.reduce(l),
            np.abs(l[0] - l[2]) / np.maximum(l[0] + l[2], 1), span, length - span,
            (loops[2] + loops[1]) / inside, loops[3] / inside, loops[0] / inside, sum((x != shortest).astype(int) for x in t)]


def sequence_blocks(texts, kind):
    """(named features by name, k-mer frequencies with one column per text) of a list of sequences."""
    length = np.array([len(x) for x in texts], dtype=np.int64)
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32)
    letter = np.full(len(code), 4, dtype=np.int64)
    for i, b in enumerate(seq.BASES):
        letter[code == ord(b)] = i
    end = np.cumsum(length + 1)
    letter[end - 1] = 5                                      # closes each text
    row = np.repeat(np.arange(len(texts)), length + 1)
    threes = np.bincount(row[:-2] * 216 + letter[:-2] * 36 + letter[1:-1] * 6 + letter[2:], minlength=len(texts) * 216)
    twos = np.bincount(row[:-1] * 36 + letter[:-1] * 6 + letter[1:], minlength=len(texts) * 36)
    ones = np.bincount(row * 6 + letter, minlength=len(texts) * 6).reshape(-1, 6)[:, :4]
    kmers = [ones, twos.reshape(-1, 6, 6)[:, :4, :4].reshape(-1, 16), threes.reshape(-1, 6, 6, 6)[:, :4, :4, :4].reshape(-1, 64)]
    kmers = np.concatenate([x.T / np.maximum(length - k, 1) for k, x in enumerate(kmers)])

    own = np.maximum(length, 1)
    n = dict(zip(seq.BASES, ones.T))
    share = {b: n[b] / own for b in seq.BASES}
    edge = np.ones(len(letter), dtype=bool)                  # where runs begin; a text begins one of its own
    edge[1:] = letter[1:] != letter[:-1]
    edge[end[:-1]] = True
    edge[end - 1] = True
    at = np.flatnonzero(edge)
    run = np.diff(at, append=len(letter))
    of, who = letter[at], row[at]
    first = np.searchsorted(who, np.arange(len(texts)))
    sign = (of == 2).astype(np.int64) - (of == 1)
    scores = np.repeat(sign * np.minimum(run, 4), run)
    running = np.r_[0, np.cumsum(scores)]
    begin = end - 1 - length
    whole = (running[end - 1] - running[begin]) / own
    width = np.minimum(25, length)
    windows = length - width + 1
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - begin, windows)
    sums = np.abs(running[place + np.repeat(width, windows)] - running[place])
    widest = np.maximum.reduceat(sums, np.cumsum(windows) - windows) / np.maximum(width, 1)
    longest = [np.maximum.reduceat(np.where(of == b, run, 0), first) for b in range(4)]
    number = lambda b: np.bincount(who[(of == b) & (run >= 2)], minlength=len(texts))
    stretches = lambda b: np.bincount(who[of == b], minlength=len(texts))
    entropy = sum(-share[b] * np.log2(np.where(share[b] > 0, share[b], 1)) for b in seq.BASES)
    before = [np.r_[0, np.cumsum(letter == b)] for b in range(4)]

    def architecture(k):
        tract = (of == seq.BASES.index(motif.BASE[k])) & (run >= 3)
        return _architecture(k, letter, at[tract], run[tract], who[tract], length, before)

    main = "G4" if kind == "locus" else kind
    base = seq.BASES.index(motif.BASE[main])
    mean_run = lambda b: n[seq.BASES[b]] / np.maximum(stretches(b), 1)
    values = [length, np.log(own), share["G"] + share["C"], *share.values(), share["A"] + share["G"], whole, np.abs(whole), widest,
              number(base), longest[base], mean_run(base), number(2), longest[2], number(1), longest[1], *architecture(main),
              np.maximum.reduce(longest), entropy]
    if kind == "locus":
        values += [*architecture("iM"), number(1), longest[1], mean_run(1)]
    return dict(zip(sequence_feature_names(kind, False), (np.asarray(v, dtype=np.float64) for v in values))), kmers


def buffer_block(given):
    """The buffer block, by name, of arrays of the eight fields."""
    c = {f: np.asarray(given[f], dtype=np.float64) for f in condition.FIELDS}
    mono = c["k"] + c["na"] + c["li_nh4"]
    ionic, competent = mono + 3.0 * c["mg"], c["k"] + 0.35 * c["na"]
    part = lambda x: np.where(mono > 0, x / np.where(mono > 0, mono, 1), 0.0)
    values = [np.log1p(c["k"]), np.log1p(c["na"]), np.log1p(c["li_nh4"]), np.log1p(c["mg"]), mono, np.log1p(mono), ionic, np.log1p(ionic),
              part(c["k"]), part(c["na"]), part(c["li_nh4"]), competent, np.log1p(competent), c["ph"] - 7.0, CYTOSINE_PKA - c["ph"],
              1 / (1 + np.power(10.0, c["ph"] - CYTOSINE_PKA)), np.log1p(c["strand_conc"]), c["crowder_pct"] > 0, competent < 1.0]
    return dict(zip(CONDITION_NAMES, [*c.values(), *(np.asarray(v, dtype=np.float64) for v in values)]))


def interaction_block(s, b):
    """Products of sequence and buffer features, by name."""
    values = [s["n_Gruns"] * b["log1p_k"], s["gc"] * b["log1p_ionic_strength"], s["loop_total"] * b["log1p_k"], s["length"] * b["log1p_k"],
              s["n_Cruns"] * b["protonation_frac"], s["frac_C"] * b["protonation_frac"], s["loop_total"] * b["protonation_frac"],
              s["gc"] * b["temperature"] / 100.0, s["g4h_mean"] * b["log1p_g4_competent"], s["has_4tracts"] * b["ph"]]
    return dict(zip(INTERACTION_NAMES, values))


def batch_matrix(blocks, given=None):
    """One row per text as single-precision numbers: named block, buffer and interaction blocks unless not given, k-mers."""
    named, kmers = blocks
    buffers = {} if given is None else buffer_block(given)
    rows = [*named.values(), *buffers.values(), *(interaction_block(named, buffers).values() if buffers else ()), *kmers]
    out = np.empty((len(rows), kmers.shape[1]), dtype=np.float32)
    for i, v in enumerate(rows):
        out[i] = v
    return out.T


# fixed values: names of the window statistics
WINDOW_STATS = ["g4h_win_max25", "g4h_win_min25", "g4h_mean_all", "n_g3_canonical", "n_g3_longloop",
                "n_g2_relaxed", "n_g3_runs", "max_g_run", "total_g3_run_nt", "frac_windows_ge_1p2"]


def with_window_stats(df: DataFrame, s: str) -> DataFrame:
    """Append the ten statistics of one strand of a genomic window."""
    overlapping = lambda tract, loop: F.regexp_count(
        s, F.lit("(?=" + motif.tract_pattern("G", tract, loop, letter=r"\w") + ")")).cast("double")
    df = seq.with_window_means(df, s, "_means").withColumn("_long", F.transform(
        F.regexp_extract_all(s, F.lit("(G{3,})"), 1), lambda r: F.length(r)))
    return df.withColumns({
        "g4h_win_max25": F.array_max("_means"), "g4h_win_min25": F.array_min("_means"),
        "g4h_mean_all": seq.hunter_mean(s),
        "n_g3_canonical": overlapping("{3,}", 7), "n_g3_longloop": overlapping("{3,}", 12),
        "n_g2_relaxed": overlapping("{2,}", 7), "n_g3_runs": F.size("_long").cast("double"),
        "max_g_run": F.coalesce(F.array_max("_long"), F.lit(0)).cast("double"),
        "total_g3_run_nt": F.aggregate("_long", F.lit(0), lambda a, x: a + x).cast("double"),
        "frac_windows_ge_1p2": F.size(F.filter("_means", lambda x: x >= 1.2)) / F.size("_means"),
    }).drop("_means", "_long")


# fixed values: what is unknown of a missing sequence; the rest of its named block is zero
UNKNOWN = ["length", "g4h_mean", "g4h_absmean", "g4h_win_max", "n_runs", "n_Gruns", "n_Cruns", "core_span", "flank_len"]


def window_feature_names():
    """The 266 names of the window vector: sequence block and window statistics of the G-richer strand, then of the other."""
    return [f"{side}_{n}" for side in ("first", "second") for n in NAMED + KMERS_NAMED + WINDOW_STATS]


def with_window_features(df: DataFrame, s: str) -> DataFrame:
    """Append the strand-symmetric window vector of s.

    Both strands are read in batches, all texts of a batch in one buffer; what the other strand shares is not counted again:
    its k-mers are the reverse complements of the first strand's.
    """
    given = list(df.columns)
    forward = seq.hunter_sum(s) >= 0
    df = df.withColumns({"first": F.when(forward, F.col(s)).otherwise(seq.revcomp(s)), "second": F.when(forward, seq.revcomp(s)).otherwise(F.col(s))})
    df = with_window_stats(df, "first").withColumnsRenamed({n: f"first_{n}" for n in WINDOW_STATS})
    df = with_window_stats(df, "second").withColumnsRenamed({n: f"second_{n}" for n in WINDOW_STATS})
    df = df.withColumns({"_first": _batch_vector("first", True), "_second": _batch_vector("second", False)})
    value = lambda side, i, n: F.get(f"_{side}", F.lit(i)) if n in UNKNOWN else F.coalesce(F.get(f"_{side}", F.lit(i)), F.lit(0.0))
    named = {f"{side}_{n}": value(side, i, n) for side in ("first", "second") for i, n in enumerate(NAMED)}
    kmers = {f"first_{n}": F.get("_first", F.lit(len(NAMED) + i)) for i, n in enumerate(KMERS_NAMED)}
    turned = {f"second_k{len(m)}_{m}": kmers[f"first_k{len(m)}_{m[::-1].translate(str.maketrans('ACGT', 'TGCA'))}"] for m in KMERS}
    got = named | kmers | turned
    return df.select(*given, *[got[n].alias(n) if n in got else n for n in window_feature_names()])


def _batch_vector(s: str, with_kmers: bool):
    """The sequence block of a G4 sequence, with its k-mers if asked, as one array; null where there is no sequence."""
    def vector(texts: pa.Array) -> pa.Array:
        held = texts.drop_null()
        rows = np.zeros((len(held), len(NAMED) + (len(KMERS) if with_kmers else 0)))
        if len(held):
            named, kmers = sequence_blocks(held.to_pylist(), "G4")
            rows[:, :len(NAMED)] = np.stack([*named.values()], axis=1)
            if with_kmers:
                rows[:, len(NAMED):] = kmers.T
        width = np.where(texts.is_valid().to_numpy(zero_copy_only=False), rows.shape[1], 0)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, width.cumsum()], pa.int32()), pa.array(rows.ravel()), mask=texts.is_null())
    return F.arrow_udf(vector, "array<double>")(F.col(s))
