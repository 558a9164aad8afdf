"""Experimental conditions: eight columns k, na, li_nh4, mg (mM), ph, temperature, crowder_pct, strand_conc."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a missing field stands for
DEFAULTS = {"k": 100.0, "na": 0.0, "li_nh4": 0.0, "mg": 0.0, "ph": 7.0, "temperature": 25.0,
            "crowder_pct": 0.0, "strand_conc": 5.0}
FIELDS = tuple(DEFAULTS)

# fixed values: named buffers; unnamed fields take the default
PRESETS = {
    "physiological": {"k": 140.0, "na": 12.0, "mg": 1.0, "ph": 7.4, "temperature": 37.0},
    "nuclear": {"k": 140.0, "na": 10.0, "mg": 0.5, "ph": 7.2, "temperature": 37.0},
    "acidic_tumour": {"k": 140.0, "na": 12.0, "mg": 1.0, "ph": 6.5, "temperature": 37.0},
    "endolysosomal": {"k": 50.0, "na": 20.0, "mg": 0.5, "ph": 5.5, "temperature": 37.0},
    "k100": {"k": 100.0, "ph": 7.0, "temperature": 25.0},
    "k50": {"k": 50.0, "ph": 7.0, "temperature": 25.0},
    "na100": {"k": 0.0, "na": 100.0, "ph": 7.0, "temperature": 25.0},
    "li100": {"k": 0.0, "li_nh4": 100.0, "ph": 7.0, "temperature": 25.0},
    "cancer_like": {"k": 70.0, "na": 30.0, "ph": 7.0, "temperature": 25.0},
    "im_reference": {"k": 100.0, "na": 10.0, "ph": 5.8, "temperature": 25.0},
}


def given(name: str) -> Column:
    """The column as a double, with NaN read as missing."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def filled(fields=FIELDS):
    return {f: F.coalesce(given(f), F.lit(DEFAULTS[f])) for f in fields}


def imputed(fields=FIELDS) -> Column:
    """Names of the fields that were missing, in fixed order. Read it before filling."""
    return F.array_compact(F.array(*[F.when(given(f).isNull(), F.lit(f)) for f in fields]))


def presets_frame(spark):
    rows = [(name, *[float(p.get(f, DEFAULTS[f])) for f in FIELDS]) for name, p in PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, " + ", ".join(f"{f} double" for f in FIELDS))


def presets_array(names) -> Column:
    """The named buffers as an array of structs, to be inlined."""
    return F.array(*[F.struct(F.lit(n).alias("preset"), *[F.lit(float(PRESETS[n].get(f, DEFAULTS[f]))).alias(f) for f in FIELDS]) for n in names])


def monovalent() -> Column:
    return F.col("k") + F.col("na") + F.col("li_nh4")


def ionic_strength() -> Column:
    return monovalent() + 3.0 * F.col("mg")


def k_fraction() -> Column:
    return F.when(monovalent() > 0, F.col("k") / monovalent()).otherwise(F.lit(0.0))


def competent_cation() -> Column:
    return F.col("k") + 0.35 * F.col("na")  # fixed value: how far sodium stands in for potassium


def short_number(c) -> Column:
    """Six significant digits without trailing zeros; an exponent below 0.0001 and from 1,000,000 on."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    scientific = F.format_string("%.5e", c)
    power = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_extract(scientific, r"^([^e]*)e", 1), r"\.?0+$", "")
    out = F.concat(digits, F.regexp_extract(scientific, r"(e[+-]\d+)$", 1))
    for p in range(-4, 6):
        fixed = F.format_string(f"%.{5 - p}f", c)
        out = F.when(power == p, F.regexp_replace(fixed, r"\.?0+$", "") if p < 5 else fixed).otherwise(out)
    return out


def label() -> Column:
    part = lambda text, f, always=False, tail="": (
        F.concat(F.lit(text), short_number(f), F.lit(tail)) if always
        else F.when(F.col(f) != 0, F.concat(F.lit(text), short_number(f), F.lit(tail))))
    return F.concat_ws(" ", part("K", "k", True), part("Na", "na", True), part("Li/NH4 ", "li_nh4"),
                       part("Mg", "mg"), part("pH", "ph", True), part("", "temperature", True, "C"),
                       part("crowd", "crowder_pct", False, "%"))


# fixed values: what one meaningful step is on each axis; strand concentration has none
STEP = {"k": 50.0, "na": 50.0, "li_nh4": 50.0, "mg": 2.0, "ph": 0.5, "temperature": 10.0, "crowder_pct": 10.0}


def distance(a: dict, b: dict) -> Column:
    """Scaled Euclidean distance; a and b map field to column."""
    return F.sqrt(sum((F.pow((a[f] - b[f]) / s, 2) for f, s in STEP.items()), F.lit(0.0)))
