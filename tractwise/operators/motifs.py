"""Motif search over tables of sequences and over a genome held in pieces."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import motif, seq
from ..session import cut_lineage
from . import ordered


def _tagged(found, kind):
    return F.transform(found, lambda h: F.struct(F.lit(kind).alias("kind"), h["start"].alias("at"), h["text"].alias("text")))


def find(df: DataFrame, keys, s: str, kinds=("G4", "iM"), both_strands=True, overlapping=False) -> DataFrame:
    """One row per hit: *keys, kind, strand, start, end (0-based half-open, + frame), text, score."""
    strands = [F.struct(F.lit("+").alias("strand"), F.col(s).alias("x"))]
    if both_strands:
        strands.append(F.struct(F.lit("-").alias("strand"), seq.revcomp(s).alias("x")))
    df = df.select(*keys, F.length(s).alias("_n"), F.explode(F.array(*strands)).alias("_s"))
    found = [_tagged(motif.hits(F.col("_s.x"), motif.PATTERN[k], overlapping), k) for k in kinds]
    df = df.select(*keys, "_n", F.col("_s.strand").alias("strand"), F.explode(F.concat(*found)).alias("_h"))
    plus, at, text = F.col("strand") == "+", F.col("_h.at"), F.col("_h.text")
    n = F.length(text).cast("bigint")
    start = F.when(plus, at).otherwise(F.col("_n") - at - n)
    mean = seq.hunter_mean(text)
    return df.select(*keys, F.col("_h.kind").alias("kind"), "strand", start.alias("start"), (start + n).alias("end"),
                     text.alias("text"), F.when(F.col("_h.kind") == "G4", mean).otherwise(-mean).alias("score"))


def find_paths(df: DataFrame, keys, s: str, pick="balanced", min_tract=3, max_tract=5, max_loop=12, per_start=64):
    """C-tract graph search: every four-node path is a conformation, one is kept per start node.

    A node is a tract of 3-5 anchored at either end of a run; the first
    `per_start` paths of a start node in node order are considered.
    """
    runs = motif.hits(F.col(s), f"C{{{min_tract},}}")

    def trimmed(r):
        a, b = r["start"], r["start"] + F.length(r["text"])
        widths = F.sequence(F.lit(min_tract), F.least(F.lit(max_tract), F.length(r["text"])))
        node = lambda x, y: F.struct(x.cast("bigint").alias("a"), y.cast("bigint").alias("b"))
        return F.flatten(F.transform(widths, lambda w: F.array(node(a, a + w), node(b - w, b))))

    df = df.select(*keys, s, F.array_sort(F.array_distinct(F.flatten(F.transform(runs, trimmed)))).alias("_nodes"))
    nodes = F.col("_nodes")
    after = lambda x: F.filter(nodes, lambda y: y["a"].between(x["b"] + 1, x["b"] + max_loop))

    def path(i, j, k, m):
        l1, l2, l3 = j["a"] - i["b"], k["a"] - j["b"], m["a"] - k["b"]
        total = l1 + l2 + l3
        # three times the squared spread: whole numbers, so equal spreads tie exactly
        cost = 3 * (l1 * l1 + l2 * l2 + l3 * l3) - total * total if pick == "balanced" else l1 + l3
        return F.struct(cost.alias("cost"), i["b"].alias("first_end"), m["b"].alias("end"), l1.alias("l1"),
                        l2.alias("l2"), l3.alias("l3"),
                        F.least(*[x["b"] - x["a"] for x in (i, j, k, m)]).alias("tract"), i["a"].alias("start"))

    def best(i):
        paths = F.slice(F.flatten(F.transform(after(i), lambda j: F.flatten(F.transform(
            after(j), lambda k: F.transform(after(k), lambda m: path(i, j, k, m)))))), 1, per_start)
        if pick == "all":
            return paths
        first = F.array_min(F.transform(paths, lambda p, n: F.struct(p["cost"].alias("cost"), n.alias("n"), p.alias("p"))))
        return F.array_compact(F.array(first["p"]))

    df = df.select(*keys, s, F.explode(F.flatten(F.transform(nodes, best))).alias("_p"))
    # one per (start, end): the first start node in order wins
    text = F.expr(f"substr({s}, _p.start + 1, _p.end - _p.start)")
    df = df.select(*keys, "_p.start", "_p.end", "_p.first_end", "_p.l1", "_p.l2", "_p.l3", "_p.tract", text.alias("text"))
    if pick == "all":
        rank = Window.partitionBy(*keys, "start", "end").orderBy("first_end", "l1", "l2", "l3", "tract")
        return df.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "first_end")
    body = F.struct("first_end", "l1", "l2", "l3", "tract", "text")
    return df.groupBy(*keys, "start", "end").agg(F.min(body).alias("_b")).select(
        *keys, "start", "end", "_b.l1", "_b.l2", "_b.l3", "_b.tract", "_b.text")


def with_neighbours(pieces: DataFrame, ahead: int, behind: int = 0) -> DataFrame:
    """Join each piece of (chrom, piece, s) with the text of the next and previous ones; one shuffle, bounded groups."""
    shifts = F.array(*[F.lit(i) for i in range(-behind, ahead + 1)])
    spread = pieces.select("chrom", "piece", "s", F.explode(shifts).alias("shift")).select(
        "chrom", (F.col("piece") - F.col("shift")).alias("piece"), "shift", "s")
    parts = spread.groupBy("chrom", "piece").agg(F.array_sort(F.collect_list(F.struct("shift", "s"))).alias("_p"))
    join = lambda keep: F.array_join(F.transform(F.filter("_p", keep), lambda x: x["s"]), "")
    return parts.select(
        "chrom", "piece", join(lambda x: x["shift"] == 0).alias("own"), join(lambda x: x["shift"] > 0).alias("next"),
        join(lambda x: x["shift"] < 0).alias("prev")).where(F.length("own") > 0)


PACKED = 8_192  # bases of a packed piece; collecting its hits takes time by the square of their number


def packed(pieces: DataFrame, piece_len: int):
    """(pieces of about PACKED bases, their length): short pieces of (chrom, piece, s) are put together in order."""
    many = max(1, PACKED // piece_len)
    if many == 1:
        return pieces, piece_len
    wide = pieces.groupBy("chrom", F.floor(F.col("piece") / many).alias("wide")).agg(F.array_sort(F.collect_list(F.struct("piece", "s"))).alias("_p"))
    return wide.select("chrom", F.col("wide").alias("piece"), F.array_join(F.col("_p.s"), "").alias("s")), piece_len * many


def with_margins(pieces: DataFrame, look: int) -> DataFrame:
    """Each piece of (chrom, piece, s) as own, with the last `look` bases before it (prev) and the first after it (next).

    Only margins travel to the neighbours, so the genome is exchanged once.
    """
    parts = F.array(F.struct(F.lit(0).alias("shift"), F.col("s")), F.struct(F.lit(1).alias("shift"), F.left("s", F.lit(look)).alias("s")),
                    F.struct(F.lit(-1).alias("shift"), F.right("s", F.lit(look)).alias("s")))
    spread = pieces.select("chrom", "piece", F.inline(parts)).select("chrom", (F.col("piece") - F.col("shift")).alias("piece"), "shift", "s")
    one = lambda shift: F.max(F.when(F.col("shift") == shift, F.col("s")))
    got = spread.groupBy("chrom", "piece").agg(one(0).alias("own"), one(1).alias("next"), one(-1).alias("prev")).where("own IS NOT NULL")
    return got.withColumns({c: F.coalesce(c, F.lit("")) for c in ("next", "prev")})


def genome_hits(pieces: DataFrame, piece_len: int, look: int = 200, max_len: int = 60) -> DataFrame:
    """Left-to-right non-overlapping hits on both strands of a genome held in fixed-length pieces.

    Every hit belongs to the piece that holds its first base on its own strand.
    Hits longer than `max_len` are seen whole and dropped. The greedy pass runs
    over chains of overlapping hits, which end wherever nothing reaches across.
    """
    pieces, piece_len = packed(pieces, piece_len)
    near = with_margins(pieces, look)
    begin = F.col("piece") * piece_len
    stop = begin + F.length("own")
    strands = F.array(
        F.struct(F.lit("+").alias("strand"), F.concat("own", "next").alias("x"), begin.alias("zero")),
        F.struct(F.lit("-").alias("strand"), seq.revcomp(F.concat("prev", "own")).alias("x"), (-stop).alias("zero")))
    df = near.select("chrom", F.length("own").alias("_n"), F.explode(strands).alias("_s"))
    found = F.concat(*[_tagged(motif.hits(F.col("_s.x"), motif.GENOME_PATTERN[k], overlapping=True), k)
                       for k in ("G4", "iM")])
    hits = df.select("chrom", "_n", F.col("_s.strand").alias("strand"), F.col("_s.zero").alias("zero"),
                     F.explode(found).alias("_h"))
    # coordinates along the hit's own strand; the reverse strand counts downwards from zero
    hits = hits.where((F.col("_h.at") < F.col("_n")) & (F.length("_h.text") <= max_len)).select(
        "chrom", "strand", "_h.kind", (F.col("zero") + F.col("_h.at")).alias("x"),
        (F.col("zero") + F.col("_h.at") + F.length("_h.text")).alias("y"), F.col("_h.text").alias("text"))
    keys = ["chrom", "strand", "kind"]
    hits = cut_lineage(hits)  # the ordered passes below read the hits several times; the genome is searched once
    hits = hits.withColumn("_tile", F.floor(F.col("x") / 100_000))
    hits = ordered.running(hits, keys, "_tile", ["x"], "y", "_reach", "max", False)
    opens = F.when(F.col("_reach").isNull() | (F.col("x") >= F.col("_reach")), F.col("x"))
    hits = ordered.running(hits, keys, "_tile", ["x"], opens, "chain", "max", True, placed=True)
    chains = hits.groupBy(*keys, "chain").agg(F.array_sort(F.collect_list(F.struct("x", "y", "text"))).alias("_c"))
    taken = F.aggregate(
        "_c", F.struct(F.col("chain").alias("last"), F.filter("_c", lambda h: F.lit(False)).alias("kept")),
        lambda acc, h: F.when(h["x"] >= acc["last"], F.struct(
            h["y"].alias("last"), F.concat(acc["kept"], F.array(h)).alias("kept"))).otherwise(acc))
    kept = chains.select(*keys, F.explode(taken["kept"]).alias("_k"))
    plus = F.col("strand") == "+"
    return kept.select(
        "chrom", F.when(plus, F.col("_k.x")).otherwise(-F.col("_k.y")).alias("start"),
        F.when(plus, F.col("_k.y")).otherwise(-F.col("_k.x")).alias("end"), "strand", "kind",
        F.col("_k.text").alias("text"))


def substitutions(df: DataFrame, keys, s: str) -> DataFrame:
    """Every single-base change: *keys, s, at (0-based), wt, alt, mutant, label (1-based)."""
    df = df.select(*keys, s, F.explode(F.sequence(F.lit(0), F.length(s) - 1)).alias("at"))
    df = df.withColumn("wt", F.substr(F.col(s), F.col("at") + 1, F.lit(1)))
    df = df.select("*", F.explode(F.array(*map(F.lit, seq.BASES))).alias("alt")).where("alt <> wt")
    mutant = F.overlay(F.col(s), F.col("alt"), F.col("at") + 1, F.lit(1))
    return df.select("*", mutant.alias("mutant"), F.concat("wt", (F.col("at") + 1).cast("string"), "alt").alias("label"))


def count_after(before, wt, alt, mutant, kind: str):
    """Hits of the kind after a substitution, given those before it; only an edit that can change them is searched.

    A loop takes any of the four letters, so changing one that is not the tracts' letter into another such changes nothing,
    and taking away the tracts' letter makes no first motif.
    """
    known, base = F.col(wt).isin(*seq.BASES) & (F.col(alt) != motif.BASE[kind]), motif.BASE[kind]
    return F.when(known & ((F.col(wt) != base) | (F.col(before) == 0)), F.col(before)).otherwise(motif.motif_count(mutant, kind))


def other_strand_gain(other, wt, alt, mutant, kind: str):
    """Whether a substitution gives the reverse complement its first motif of the kind; `other`: it has one before."""
    letter = {"G": "C", "C": "G"}[motif.BASE[kind]]
    can = (F.col(alt) == letter) | ~F.col(wt).isin(*seq.BASES, "U")   # see other_strand_gains
    return ~F.col(other) & can & motif.has_motif(seq.revcomp(mutant), kind)


def other_strand_gains(df: DataFrame, keys, s: str, kind: str) -> DataFrame:
    """Substitutions that give the reverse complement of s its first motif of the kind: *keys, s, at (0-based), wt, alt, label (1-based).

    A new motif takes three tracts that are there and one that the new letter completes; only a letter that no loop may
    hold can also stand in the way of one. So few places of s come into question, and only their edits are made and
    searched. The motif is read on s itself, where its tracts are runs of the other letter.
    """
    letter = {"G": "C", "C": "G"}[motif.BASE[kind]]
    # U stands for T, so the other strand reads A there
    pattern = motif.PATTERN[kind].replace(motif.BASE[kind] + "{", letter + "{").replace("[ACGT]", "[ACGTU]")
    near = f"(?<={letter}{{2}})[^{letter}#]|(?<={letter})[^{letter}#](?={letter})|[^{letter}#](?={letter}{{2}})|[^ACGT#]"
    df = df.where(F.regexp_count(F.col(s), F.lit(letter * 3)) >= 3).where(~F.col(s).rlike(pattern))
    marked = F.translate(s, "#", "-")  # hits puts a # of its own before the text
    places = df.select(*keys, s, F.inline(motif.hits(marked, near)).alias("at", "wt")).withColumn("wt", F.substr(F.col(s), (F.col("at") + 1).cast("int"), F.lit(1)))
    alts = F.when(F.col("wt").isin(*seq.BASES), F.array(F.lit(letter))).otherwise(F.array(*map(F.lit, seq.BASES)))
    edits = places.select("*", F.explode(alts).alias("alt"))
    edits = edits.where(F.overlay(F.col(s), F.col("alt"), (F.col("at") + 1).cast("int"), F.lit(1)).rlike(pattern))
    return edits.withColumn("label", F.concat("wt", (F.col("at") + 1).cast("string"), "alt"))


def half_census(s, base: str):
    """Hits of both kinds and strands whose tracts are runs of `base` on this strand.

    G tracts are G4 on this strand and i-motif on the other, C tracts the reverse. Without four disjoint threes of the
    base there is none, which one cheap pass tells.
    """
    near, far = ("G4", "iM") if base == "G" else ("iM", "G4")
    return F.when(F.regexp_count(s, F.lit(base * 3)) >= 4, motif.motif_count(s, near) + motif.motif_count(seq.revcomp(s), far)).otherwise(F.lit(0).cast("bigint"))


def census(s):
    """Hits of both kinds on both strands."""
    return half_census(s, "G") + half_census(s, "C")


def census_changes(df: DataFrame, keys, s: str) -> DataFrame:
    """Every substitution with the census before and after: *keys, at, wt, alt, label, ref_total, mut_total.

    Only the half whose base is removed or brought in can change; it alone is matched anew.
    """
    held = df.withColumns({"_g": half_census(s, "G"), "_c": half_census(s, "C")})
    edits = substitutions(held, [*keys, "_g", "_c"], s)

    def after(base, before):
        return F.when((F.col("wt") == base) | (F.col("alt") == base), half_census("mutant", base)).otherwise(F.col(before))

    return edits.select(*keys, "at", "wt", "alt", "label", (F.col("_g") + F.col("_c")).alias("ref_total"), (after("G", "_g") + after("C", "_c")).alias("mut_total"))


def with_qgrs_score(df: DataFrame, s: str, name: str, max_len=30, min_g=2) -> DataFrame:
    """Append the best score over four equal tracts within max_len nt and at most one empty loop."""
    top = max_len - (min_g * 4 + 1)
    sizes = range(min_g, max_len // 4 + 1)
    df = df.withColumns({f"_at{n}": F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))),
        lambda p: F.substr(F.col(s), p, F.lit(n)) == "G" * n) for n in sizes})

    def best(n):
        gap = 0 if n == 2 else 1
        after = lambda p, first: F.filter(f"_at{n}", lambda q: (q >= p + n + gap) & (q + n - first <= max_len))

        def value(a, b, c, e):
            l1, l2, l3 = b - a - n, c - b - n, e - c - n
            empty = (l1 == 0).cast("int") + (l2 == 0).cast("int") + (l3 == 0).cast("int")
            return F.when(empty <= 1, top - (F.abs(l1 - l2) + F.abs(l2 - l3) + F.abs(l1 - l3)) / 3.0 + top * (n - 2))

        return F.array_max(F.flatten(F.transform(f"_at{n}", lambda a: F.flatten(F.transform(after(a, a), lambda b: F.flatten(
            F.transform(after(b, a), lambda c: F.transform(after(c, a), lambda e: value(a, b, c, e)))))))))

    return df.withColumn(name, F.greatest(F.lit(0.0), *[best(n) for n in sizes])).drop(*[f"_at{n}" for n in sizes])
