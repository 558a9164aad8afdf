"""Order-dependent operators that never put a whole table or a whole key into one task.

Ranks, quantiles and running values are computed in two levels: rows are cut
into ordered tiles, each tile is reduced to one number, those few numbers are
accumulated, and the result is handed back to the tiles.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITTERS = 64


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """Append the columns of a one-row result, as a scalar subquery."""
    whole = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", whole).select(*df.columns, "_one.*")


def _bucket(counts: DataFrame, value: str) -> DataFrame:
    """Tag rows with an ordered bucket cut at a fixed-size, data-determined sample of values."""
    cuts = (
        counts.select(value).distinct()
        .orderBy(F.xxhash64(value), value).limit(SPLITTERS)
        .agg(F.sort_array(F.collect_list(value)).alias("cuts"))
    )
    return (
        attach(counts, cuts)
        # never null, so that no null check on it is pushed below the counting, down to single rows
        .withColumn("_bucket", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(value))), F.lit(0)))
        .drop("cuts")
    )


def value_ranks(df: DataFrame, value: str, keys=(), sums=None, weight=None) -> DataFrame:
    """Per distinct value: how many rows hold it (n), how many lie below, and the total.

    Equal values are counted before anything is ordered, so a value shared by a
    third of the table is one row here. `sums` maps names to columns summed the
    same way; each yields name, name_below and name_total. Other columns:
    *keys, value, n, below, total. `weight` names how many rows a counted row stands for.
    """
    keys, sums = list(keys), dict(sums or {})
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), *[F.sum(c).alias(s) for s, c in sums.items()])
    counts = _bucket(counts, value)
    names = {"n": ("below", "total")} | {s: (f"{s}_below", f"{s}_total") for s in sums}
    per_bucket = Window.partitionBy(*keys).orderBy("_bucket")  # at most SPLITTERS + 1 rows
    totals = counts.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_in_{s}") for s in names]).select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_in_{s}").over(per_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_before_{s}") for s in names],
        *[F.sum(f"_in_{s}").over(Window.partitionBy(*keys)).alias(t) for s, (_, t) in names.items()])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = counts.join(totals, keys + ["_bucket"]).withColumns({
        b: F.col(f"_before_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s, (b, _) in names.items()})
    return joined.select(*keys, value, *names, *[c for pair in names.values() for c in pair])


def average_rank():
    """1-based rank with ties averaged, over the columns of value_ranks."""
    return F.col("below") + (F.col("n") + 1) / 2


def with_ranks(df: DataFrame, value: str, name: str, keys=()) -> DataFrame:
    """Append the average-tie rank of `value` to every row; rows without a value keep null."""
    keys = list(keys)
    ranks = value_ranks(df, value, keys).select(*keys, value, average_rank().alias(name))
    return df.join(ranks, keys + [value], "left")


def exact_quantiles(df: DataFrame, value: str, probs, keys=(), weight=None) -> DataFrame:
    """Exact linear-interpolated quantiles; one row per key with columns q0, q1, ..."""
    keys = list(keys)
    ranks = value_ranks(df, value, keys, weight=weight)
    low, high = [], []
    for i, p in enumerate(probs):
        h = (F.col("total") - 1) * F.lit(float(p))
        holds = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n"))
        low.append(F.max(F.when(holds(F.floor(h)), F.col(value))).alias(f"_lo{i}"))
        high.append(F.max(F.when(holds(F.ceil(h)), F.col(value))).alias(f"_hi{i}"))
    edge = ranks.groupBy(*keys).agg(F.max("total").alias("total"), *low, *high)
    out = []
    for i, p in enumerate(probs):
        h = (F.col("total") - 1) * F.lit(float(p))
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (h - F.floor(h))).alias(f"q{i}"))
    return edge.select(*keys, "total", *out)


def running(df: DataFrame, keys, tile: str, order, value, name: str, how: str, inclusive: bool, placed=False) -> DataFrame:
    """Running max or sum along `order` within `keys`, carried across tiles.

    `tile` must be non-decreasing along `order`. Only one row per tile is ever
    accumulated per key; rows themselves stay in (key, tile) groups. The rows
    are exchanged once, and that exchange serves totals and rows alike; pass
    placed=True when an earlier call with the same keys and tile already did it.
    """
    keys = list(keys)
    if not placed:
        df = df.repartition(*keys, tile)
    reduce = {"max": F.max, "sum": F.sum}[how]
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy(*keys, tile).agg(reduce("_v").alias("_t")).select(
        *keys, tile, reduce("_t").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, tile).orderBy(*order)
    # a maximum that includes the row includes its equals in order too, so that it does not depend on how they are sorted
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow) if inclusive and how == "max" else inside.rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    here = reduce("_v").over(inside)
    joined = df.join(carry, keys + [tile])
    if how == "max":
        result = F.greatest("_carry", here)
    else:
        result = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(here, F.lit(0))
    return joined.withColumn(name, result).drop("_v", "_carry")
