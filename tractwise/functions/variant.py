"""Variant keys and classes as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ["chrom", "pos", "ref", "alt"]
# fixed values: weak and strong effect per kind
EFFECT = {"G4": (2.0, 5.0), "iM": (0.1, 0.3)}
RETAINED = ["destabilising", "moderate", "neutral", "stabilising"]


def norm_chrom(c) -> Column:
    return F.concat(F.lit("chr"), F.regexp_replace(F.trim(c), "(?i)^chr", ""))


def hgvs_like(chrom, pos, ref, alt) -> Column:
    return F.concat(chrom, F.lit(":"), pos.cast("string"), ref, F.lit(">"), alt)


def subst_type(ref, alt) -> Column:
    flip = lambda b: F.translate(b, "ACGT", "TGCA")
    purine = ref.isin("G", "A")
    return F.concat(F.when(purine, flip(ref)).otherwise(ref), F.lit(">"), F.when(purine, flip(alt)).otherwise(alt))


def effect_class(state, delta, kind) -> Column:
    """Ordered classes; a missing delta without a lost motif is 'other'."""
    def for_kind(k):
        weak, strong = EFFECT[k]
        return (F.when(delta <= -strong, "destabilising").when(delta <= -weak, "moderate")
                .when(F.abs(delta) < weak, "neutral").when(delta >= weak, "stabilising").otherwise("other"))
    return F.when(state == "motif_lost", "motif_lost").when(kind == "G4", for_kind("G4")).otherwise(for_kind("iM"))


def to_forward(start, end, strand, offset, ref, alt):
    """1-based forward position and bases of an edit at `offset` along a motif on either strand."""
    flip = lambda b: F.translate(b, "ACGT", "TGCA")
    plus = strand == "+"
    return (F.when(plus, start + offset + 1).otherwise(end - offset),
            F.when(plus, ref).otherwise(flip(ref)), F.when(plus, alt).otherwise(flip(alt)))


def motif_state(before, after) -> Column:
    return (F.when((before == 0) & (after == 0), "no_motif").when(after == 0, "motif_lost")
            .when(before == 0, "motif_gained").when(before != after, "motif_count_changed")
            .otherwise("motif_retained"))
