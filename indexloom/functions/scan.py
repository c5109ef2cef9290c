"""Running values over a whole order, or within groups of any size, without a window that gathers them in one task.

Two passes: rows are dealt into ranges of the order and written; each range runs on its own, and what the ranges
before it hold in total (a row for each range and group in it) is carried into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexloom.plans.tables import cut

#: kind: (over the rows of a window, of a value beginning with the carried one)
_KINDS = {
    "sum": (lambda c: F.sum(c), lambda before, own: F.coalesce(before + own, own, before)),
    "max": (lambda c: F.max(c), lambda before, own: F.greatest(before, own)),
    "min": (lambda c: F.min(c), lambda before, own: F.least(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def running(rows: DataFrame, order: Sequence[str], values: dict[str, tuple[str, str]], by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``rows`` with running values up to each row: ``values`` gives, by new name, (kind, column); kinds are sum, max, min and
    last (the latest that is not NULL).

    ``order`` must tell the rows of a group apart.  NULL values are skipped; groups with a NULL key are groups like others.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a group has a row for each range at most
    of = {name: (_KINDS[kind], column) for name, (kind, column) in values.items()}
    last = F.max(F.struct(*order))
    totals = dealt.select("_range", *by, *order, *[F.col(c).alias(f"_v_{n}") for n, (_, c) in of.items()])
    whole = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if any(kind == "last" for kind, _ in values.values()):  # the order matters within a range, so its window gives the total
        totals = totals.select("_range", *by, *[over(F.col(f"_v_{n}")).over(whole).alias(n) for n, ((over, _), _) in of.items()]).dropDuplicates(["_range", *by])
    else:
        totals = totals.groupBy("_range", *by).agg(last.alias("_last"), *[over(F.col(f"_v_{n}")).alias(n) for n, ((over, _), _) in of.items()])
    carried = totals.select("_range", *by, *[over(F.col(n)).over(before).alias(f"_c_{n}") for n, ((over, _), _) in of.items()])
    own = dealt.select("*", *[over(F.col(c)).over(inner).alias(f"_o_{n}") for n, ((over, _), c) in of.items()])
    same = [own[k].eqNullSafe(carried[k]) for k in ("_range", *by)]
    met = own.join(carried, same).select(*[own[c] for c in own.columns], *[carried[f"_c_{n}"] for n in of])
    return met.select(*rows.columns, *[join(F.col(f"_c_{n}"), F.col(f"_o_{n}")).alias(n) for n, ((_, join), _) in of.items()])


def running_product(rows: DataFrame, order: Sequence[str], factor: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The product of ``factor`` up to each row, by sums of logarithms; signs and zeros are counted apart.  NULL factors count as 1."""
    x = F.coalesce(factor, F.lit(1.0))
    parts = rows.withColumn("_ln", F.when(x != 0, F.log(F.abs(x))).otherwise(0.0)).withColumn("_neg", (x < 0).cast("int")).withColumn("_zero", (x == 0).cast("int"))
    got = running(parts, order, {"_a": ("sum", "_ln"), "_b": ("sum", "_neg"), "_c": ("sum", "_zero")}, by)
    value = F.when(F.col("_c") > 0, 0.0).otherwise(F.when(F.col("_b") % 2 == 1, -1.0).otherwise(1.0) * F.exp("_a"))
    return got.select(*rows.columns, value.alias(name))


def asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), strict: bool = False, parts: int | None = None) -> DataFrame:
    """Each row of ``left`` with the columns of the latest row of ``right`` at or before ``on`` (before it, if ``strict``) in its group; NULL without one.

    Both sides are laid into one order and the latest row of ``right`` runs along, so neither a group nor the order
    meets in one task.  ``right`` has one row for each ``on`` and group; rows of ``left`` may repeat.
    """
    taken = [c for c in right.columns if c not in (on, *by)]
    kept = [c for c in left.columns if c not in (on, *by)]
    keys = [on, *by]
    r = right.select(*keys, F.lit(0 if not strict else 1).alias("_side"), F.lit(0).cast("long").alias("_row"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), F.struct(*taken, F.col(on).alias("_at")).alias("_right"))
    n = left.select(*keys, F.lit(1 if not strict else 0).alias("_side"), F.monotonically_increasing_id().alias("_row"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"))
    met = running(r.unionByName(n), [on, "_side", "_row"], {"_found": ("last", "_right")}, by, parts).where("_left is not null")
    return met.select(*keys, *[F.col("_left")[c].alias(c) for c in kept], *[F.col("_found")[c].alias(c) for c in taken], F.col("_found")["_at"].alias(f"{on}_found"))
