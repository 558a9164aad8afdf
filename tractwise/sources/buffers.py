"""Buffer prose to cation concentrations (mM), entirely as column expressions.

A term is attributed to the first species whose pattern it matches; a
quantified term nothing recognises makes the buffer unusable instead of being
read as zero.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: pattern, then mM of each cation per mM of the species; order matters
SPECIES = [
    (r"na2hpo4|disodium\s*(hydrogen\s*)?phosphate", {"na": 2.0}),
    (r"k2hpo4|dipotassium\s*(hydrogen\s*)?phosphate", {"k": 2.0}),
    (r"nah2po4|monosodium\s*phosphate", {"na": 1.0}),
    (r"kh2po4|monopotassium\s*phosphate", {"k": 1.0}),
    (r"li3po4|lithium\s*orthophosphate", {"li_nh4": 3.0}),
    (r"kno3|potassium\s*nitrate", {"k": 1.0}),
    (r"nano3|sodium\s*nitrate", {"na": 1.0}),
    (r"mgcl2|magnesium\s*chloride|mg\s*\(?2\+?\)?|mg2\+|\bmg\b", {"mg": 1.0}),
    (r"\bkcl\b|potassium\s*chloride", {"k": 1.0}),
    (r"\bnacl\b|sodium\s*chloride", {"na": 1.0}),
    (r"\blicl\b|lithium\s*chloride", {"li_nh4": 1.0}),
    (r"nh4cl|ammonium\s*chloride|\bnh4\+?\b|ammonium\s*acetate", {"li_nh4": 1.0}),
    (r"\bkoh\b|potassium\s*hydroxide", {"k": 1.0}),
    (r"\bnaoh\b|sodium\s*hydroxide", {"na": 1.0}),
    (r"\blioh\b|lithium\s*hydroxide", {"li_nh4": 1.0}),
    (r"(k\s*pi|kpi|kp\b|k\s*phosphate|potassium\s*phosphate|phosphate\s*.{0,12}potassium)", {"k": 1.5}),
    (r"(na\s*pi|napi|nap\b|na\s*phosphate|sodium\s*phosphate)", {"na": 1.5}),
    (r"(li\s*pi|lipi|lipo4|li\s*phosphate|lithium\s*phosphate)", {"li_nh4": 1.5}),
    (r"(li|lithium)\s*(cacodylate|caco\b|aso4|arsenate)|licaco|lias|cacodyl.{0,20}lioh", {"li_nh4": 1.0}),
    (r"(na|sodium)\s*(cacodylate|caco\b)|nacaco|cacodyl.{0,20}naoh", {"na": 1.0}),
    (r"(k|potassium)\s*(cacodylate|caco\b)|kcaco|cacodyl.{0,20}koh", {"k": 1.0}),
    (r"tris\s*[-\s]?hcl|\btris\b|hepes|tmaa|edta|boric|acetic|h3po4|dmso|spermidine|"
     r"citrate|mes\b|mops|pipes|bis-?tris|glycine|britton|pb\(no3\)2|nitrate\s*of\s*lead", {}),
    (r"\bk\+?\b|potassium", {"k": 1.0}),
    (r"\bna\+?\b|sodium", {"na": 1.0}),
    (r"\bli\+?\b|lithium", {"li_nh4": 1.0}),
]
# fixed values: recognised, but not quantifiable in these four cations
AMBIGUOUS = [
    r"phosphate\s*(buffer)?$|^\s*\d[\d.]*\s*m?m?\s*phosphate",
    r"cacodylate|caco\b",
    r"\brb\b|rbcl|rubidium",
    r"\bcs\b|cscl|caesium|cesium",
    r"\bcpk\b",
]
# fixed values: phosphate-buffered saline at 1x
PBS = {"k": 4.45, "na": 157.0, "li_nh4": 0.0, "mg": 0.0}
IONS = ("k", "na", "li_nh4", "mg")
# fixed values: quantity, pH and "not stated" forms
QUANTITY = r"(?i)(\d+(?:\.\d+)?)\s*(mM|millimolar|M\b|molar|uM|µM|micromolar|nM)?"
PH = r"(?i)p\s*h\s*[:=]?\s*(\d+(?:\.\d+)?)"
PH_ONLY = r"(?i)^\W*(at\s*)?p\s*h\s*[:=]?\s*\d+(\.\d+)?\W*$"
UNKNOWN = r"(?i)unknown|unsure|not\s*(reported|stated|given)|(?<![a-z])n/a(?![a-z])|not\s*applicable"


def _term(core):
    """What one additive term contributes, and the flag or unparsed text it leaves."""
    species = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(SPECIES))):
        species = F.when(core.rlike("(?i)" + pattern), F.lit(i)).otherwise(species)
    ambiguous = F.lit(False)
    for pattern in AMBIGUOUS:
        ambiguous = ambiguous | core.rlike("(?i)" + pattern)
    number = F.regexp_extract(core, QUANTITY, 1)
    unit = F.lower(F.translate(F.regexp_extract(core, QUANTITY, 2), "μ", "u"))
    return F.struct(core.alias("core"), species.alias("species"), ambiguous.alias("ambiguous"),
                    F.when(number != "", number.cast("double")).alias("number"), unit.alias("unit"),
                    core.rlike(UNKNOWN).alias("unknown"))


def _judge(t):
    factor = (F.when(t["unit"].isin("m", "molar"), 1000.0).when(t["unit"].isin("um", "µm", "micromolar"), 1e-3)
              .when(t["unit"] == "nm", 1e-6).otherwise(1.0))
    share = lambda ion: F.element_at(F.array(*[F.lit(c.get(ion, 0.0)) for _, c in SPECIES]), t["species"] + 1)
    ionic = F.element_at(F.array(*[F.lit(bool(c)) for _, c in SPECIES]), t["species"] + 1)
    none = t["species"].isNull()
    vague = ~none & ionic & (t["unknown"] | t["number"].isNull())
    counted = ~none & ionic & ~vague
    amount = lambda ion: F.when(counted, t["number"] * factor * share(ion)).otherwise(F.lit(0.0)).alias(ion)
    flag = (F.when(none & t["ambiguous"], F.concat(F.lit("ambiguous_component:"), t["core"]))
            .when(vague, F.concat(F.lit("unquantified_component:"), t["core"]))
            .when(counted & (t["unit"] == ""), F.concat(F.lit("unit_assumed_mM:"), t["core"])))
    lost = F.when(none & ~t["ambiguous"] & t["number"].isNotNull() & ~t["unknown"], t["core"])
    return F.struct(*[amount(i) for i in IONS], flag.alias("flag"), lost.alias("unparsed"))


def parse(df: DataFrame, text: str, reported_ph: str) -> DataFrame:
    """Append buf_k, buf_na, buf_li_nh4, buf_mg, buf_ph, buf_flags, buf_unparsed, buf_usable."""
    raw = F.trim(F.col(text))
    absent = F.col(text).isNull() | F.lower(raw).isin("", "nan", "none")
    stated = F.regexp_extract(raw, PH, 1)
    saline = raw.rlike(r"(?i)\bpbs\b|phosphate[- ]buffered saline")
    pieces = F.split(F.translate(raw, "＋", "+"), r"\s*\+\s*|\s+and\s+")
    cores = F.transform(F.filter(pieces, lambda p: F.trim(p) != ""), lambda p: F.trim(
        F.regexp_replace(F.trim(p), r"(?i)\((?:[^()]*p\s*h[^()]*)\)", " ")))
    cores = F.filter(cores, lambda c: (c != "") & ~c.rlike(PH_ONLY))
    df = df.withColumn("_terms", F.transform(F.when(absent | saline, F.array().cast("array<string>")).otherwise(cores), _term))
    df = df.withColumn("_terms", F.transform("_terms", _judge))
    total = lambda ion: F.when(~absent & saline, F.lit(PBS[ion])).otherwise(
        F.aggregate("_terms", F.lit(0.0), lambda a, t: a + t[ion]))
    df = df.withColumns({f"buf_{i}": total(i) for i in IONS})
    reported = F.col(reported_ph) > 0
    ph = F.when(absent, F.lit(None)).when(reported, F.col(reported_ph)).when(stated != "", stated.cast("double"))
    ph_flag = F.when(absent, "no_buffer_description").when(F.coalesce(reported, F.lit(False)), F.lit(None)).when(
        stated != "", "ph_recovered_from_buffer_text").otherwise("ph_unknown")
    cations = sum((F.col(f"buf_{i}") for i in IONS[1:]), F.col("buf_k"))
    flags = F.array_compact(F.concat(F.array(ph_flag), F.transform("_terms", lambda t: t["flag"]),
                                     F.array(F.when(~absent & (cations == 0), F.lit("no_cation_recovered")))))
    unparsed = F.array_compact(F.transform("_terms", lambda t: t["unparsed"]))
    return df.withColumns({"buf_ph": ph, "buf_flags": flags, "buf_unparsed": unparsed,
                           "buf_usable": (cations > 0) & (F.size(unparsed) == 0)}).drop("_terms")
