"""Two-state transition shapes and free-energy expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: gas constant (kcal/mol/K), default van 't Hoff enthalpy, Hill coefficient, Tm slope per decade
R = 1.987204e-3
DH_G4 = 45.0
HILL_IM = 2.5
SLOPE_PER_DECADE = 12.0
KELVIN = 273.15


def _clamp(x, bound):
    # least and greatest skip nulls, and a missing midpoint must stay missing
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))


def folded_at_temperature(t_c, tm_c, dh=DH_G4) -> Column:
    t, tm = t_c + KELVIN, tm_c + KELVIN
    x = _clamp(F.lit(dh / R) * (1.0 / t - 1.0 / tm), 60.0)
    return F.when((t > 0) & (tm > 0), 1.0 / (1.0 + F.exp(-x)))


def folded_at_ph(ph, ph_t, hill=HILL_IM) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), _clamp(F.lit(hill) * (ph - ph_t), 30.0)))


def tm_at_cation(tm_ref, cation_ref, cation, slope=SLOPE_PER_DECADE) -> Column:
    return F.when((cation_ref > 0) & (cation > 0), tm_ref + F.lit(slope) * F.log10(cation / cation_ref))


def dg_from_tm(tm_c, t_c, dh=DH_G4) -> Column:
    return F.lit(-dh) * (1.0 - (t_c + KELVIN) / (tm_c + KELVIN))


def dg_from_ph_t(ph_t, ph, hill=HILL_IM, t_c=37.0) -> Column:
    theta = folded_at_ph(ph, ph_t, hill)
    theta = F.when(theta.isNotNull(), F.greatest(F.least(theta, F.lit(1 - 1e-6)), F.lit(1e-6)))
    return F.lit(-R * (t_c + KELVIN)) * F.log(theta / (1 - theta))


def _run_counts(s, base):
    r = F.regexp_extract_all(s, F.lit(f"({base}{{2,}})"), 1)
    return F.size(r), F.coalesce(F.array_max(F.transform(r, lambda x: F.length(x))), F.lit(0))


def g4_energy(s, mono, mg, crowding, temperature) -> Column:
    """Heuristic energy from G-run counts, outer gaps and buffer."""
    n, longest = _run_counts(s, "G")
    tetrads = F.least(F.lit(4), F.greatest(F.lit(2), longest))
    gaps = F.filter(F.split(s, "G{2,}"), lambda g: F.length(g) > 0)
    excess = F.aggregate(gaps, F.lit(0), lambda a, g: a + F.length(g) - 1)
    core = F.when((n >= 4) & (longest >= 2), -2.4 * tetrads * F.least(n, F.lit(4)) + 0.35 * excess).otherwise(F.lit(8.0))
    return (core - 1.15 * F.log10(F.greatest(mono, F.lit(1.0)) / 20.0) - 0.22 * F.least(mg, F.lit(10.0))
            - 0.028 * crowding + 0.048 * (temperature - 37.0))


def im_energy(s, ph, mg, crowding, temperature) -> Column:
    """Heuristic energy from C-run counts and pH."""
    n, longest = _run_counts(s, "C")
    protonated = 1.0 / (1.0 + F.pow(F.lit(10.0), ph - 4.7))
    core = (F.when(n >= 4, -1.7 * longest * F.least(n, F.lit(4)))
            .when(n >= 2, 2.5 - 0.6 * n * longest).otherwise(F.lit(9.0)))
    return (core + (1.0 - protonated) * 9.5 - 0.35 * F.least(mg, F.lit(12.0)) - 0.04 * crowding * protonated
            + 0.06 * (temperature - 37.0))
