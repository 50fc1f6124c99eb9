"""Ranks and prefix sums without a window over all rows.

Rows are dealt into ordered buckets; offsets come from the small table of bucket counts, and a window
ranks within a bucket only. ``bucket`` must be monotone in the order (leading hash digits, a binned
score), so no task holds more than a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialized


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits of a digest: 16^digits buckets of equal size."""
    return F.substring(digest, 1, digits)


#: Rows of a bucket that ``balanced`` aims at, and the most buckets it makes.
BUCKET_ROWS, MOST_BUCKETS = 250_000, 1 << 16


def balanced(df: DataFrame, value: str, digest: str | None = None, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Column]:
    """(``df`` with the helper column ``__cuts``, bucket): buckets of nearly equal size in ascending order of
    ``value``, however its values crowd. Cuts are quantiles from a mergeable sketch over all rows, a list of bounded
    length; a row finds its place among them by halving. A value that fills several places is split among them by
    its ``digest`` (hexadecimal, the next thing in the order), so equal values do not meet in one bucket; without
    a digest values must be nearly distinct. Nulls come first."""
    v = F.col(value).cast("double")
    n = df.count()
    parts = min(MOST_BUCKETS, max(1, -(-n // bucket_rows)))
    if parts == 1:
        return df.withColumn("__cuts", F.array().cast("array<double>")), F.lit(0).cast("long")
    shares = [k / parts for k in range(1, parts)]
    cuts = df.agg(F.percentile_approx(v, F.lit(shares) if parts > 2 else F.array(F.lit(0.5)), 20 * parts).alias("__cuts"))
    steps = F.array(*[F.lit(1 << k) for k in range(parts.bit_length(), -1, -1)])

    def below(orequal: bool) -> Column:
        """How many cuts lie below the value (or equal it)."""

        def step(at: Column, wide: Column) -> Column:
            cut = F.get("__cuts", at + wide - 1)
            return F.when((cut <= v) if orequal else (cut < v), at + wide).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    low = below(False)
    if digest is not None:
        share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
        low = low + F.floor(share * (below(True) - low)).cast("int")
    return df.crossJoin(F.broadcast(cuts)), F.coalesce(low.cast("long"), F.lit(-1).cast("long"))


def _offsets(df: DataFrame, by: list[str], amount: Column) -> DataFrame:
    sums = df.groupBy(*by, "__bucket").agg(F.sum(amount).alias("__n"))
    order = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("__off", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")


def _placed(df: DataFrame, by: list[str], amount: Column) -> DataFrame:
    off = _offsets(df, by, amount)
    keys = [*by, "__bucket"]
    off = off.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__off")
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(off[f"__k{i}"]) for i, k in enumerate(keys)])
    return df.join(off, same).drop(*[f"__k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row within ``by``; ``order`` must be unique there."""
    placed = _placed(df.withColumn("__bucket", bucket), by, F.lit(1))
    local = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order))
    return placed.withColumn(name, F.col("__off") + local).drop("__off", "__bucket")


def running_total(df: DataFrame, by: list[str], bucket: Column, order: list, amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before each row within ``by``."""
    placed = _placed(df.withColumn("__bucket", bucket), by, F.col(amount))
    before = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(name, F.col("__off") + F.coalesce(F.sum(amount).over(before), F.lit(0))).drop("__off", "__bucket")


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``by`` and a column per entry of ``at``: exact quantiles with linear interpolation, from counts per
    distinct value and their prefix sums, so no group's values meet in one buffer. Nulls are left out."""
    keys = [F.col(c).alias(f"__b{k}") for k, c in enumerate(by)]
    rows = df.where(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("__b0")]), F.col(value).cast("double").alias("__v"))
    names = [f"__b{k}" for k in range(max(len(by), 1))]
    per = rows.groupBy(*names, "__v").agg(F.count("*").alias("__c"))
    per = materialized(per, "values")
    span = per.groupBy(*names).agg(F.sum("__c").alias("__all"))
    same = reduce(lambda a, b: a & b, [per[n].eqNullSafe(span[n]) for n in names])
    per = per.join(span, same).drop(*[span[n] for n in names])
    per, bucket = balanced(per, "__v")
    per = running_total(per, names, bucket, ["__v"], "__c", "__before")
    picks = []
    for name, q in at.items():
        place = (F.col("__all") - 1) * F.lit(q)
        for side, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__c")), F.col("__v"))).alias(f"__{name}_{side}"))
    out = per.groupBy(*names).agg(F.first("__all").alias("__all"), *picks)
    between = [(F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * ((F.col("__all") - 1) * F.lit(q) - F.floor((F.col("__all") - 1) * F.lit(q)))).alias(n) for n, q in at.items()]
    return out.select(*[F.col(f"__b{k}").alias(c) for k, c in enumerate(by)], *between)
