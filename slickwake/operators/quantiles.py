"""Exact percentiles and ranks of groups of any size, in tasks of bounded size.

``percentile`` keeps a group's distinct values in one task, and a window without partitions keeps all rows in one.  Here a
mergeable sketch brackets each percentile first, then only the values inside the brackets (some ten-thousandths of a
group) are counted and ordered.  The result is that of ``percentile``: linear between the two nearest ranks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwake.sources.scratch import stored


def exact_percentiles(df: DataFrame, by: list[str], value: Column, fractions: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """``*by, p``: an array with the value at each of ``fractions``; null and NaN values don't count, groups without any are left out."""
    rows = df.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    if rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > accuracy).isEmpty():
        # tasks can hold groups of this size whole
        return rows.groupBy(*by).agg(F.percentile("_v", list(fractions)).alias("p")).where("p IS NOT NULL")
    margin = 2 / accuracy  # the sketch is off by 1 / accuracy at most
    ends = [x for f in fractions for x in (max(0.0, f - margin), min(1.0, f + margin))]
    sketch = rows.groupBy(*by).agg(F.percentile_approx("_v", ends, accuracy).alias("_e"), F.count("*").alias("_all"))
    # groups as small as the sketch is fine are ordered whole
    small, inf = F.col("_all") <= accuracy, F.lit(float("inf"))
    brackets = F.array(*(F.struct(F.lit(i).alias("i"), F.when(small, -inf).otherwise(F.col("_e")[2 * i]).alias("lo"), F.when(small, inf).otherwise(F.col("_e")[2 * i + 1]).alias("hi")) for i in range(len(fractions))))
    sought = sketch.select(*by, "_all", F.explode(brackets).alias("_b")).select(*by, "_all", "_b.*")
    met = rows.join(sought, by) if by else rows.crossJoin(F.broadcast(sought))  # one row for each fraction
    # what lies below a bracket counts as one value
    near = met.where("_v <= hi").groupBy(*by, "_all", "i", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_n"))
    up = F.sum("_n").over(Window.partitionBy(*by, "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("_all") - 1) * F.element_at(F.array(*map(F.lit, fractions)), F.col("i") + 1)
    value_at = lambda rank: F.min(F.when(F.col("_up") > rank, F.col("_v")))
    near = near.withColumn("_up", up).withColumn("_at", at).groupBy(*by, "i", "_at").agg(value_at(F.floor("_at")).alias("a"), value_at(F.ceil("_at")).alias("b"))
    share = F.col("_at") - F.floor("_at")
    found = near.select(*by, "i", ((1 - share) * F.col("a") + share * F.col("b")).alias("x"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))


@dataclass
class _Sought:
    """The values at two neighbouring ranks (from 0), between two that are known not to be them."""

    value: Column
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    inside: int = 0
    ranks: tuple[int, int] = (0, 0)
    share: float = 0.0
    found: dict[int, float] = field(default_factory=dict)

    def within(self) -> Column:
        return self.value if self.lo is None else F.when((self.value > self.lo) & (self.value < self.hi), self.value)

    def open_ranks(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]

    def result(self) -> float | None:
        if not self.inside and not self.found:
            return None
        a, b = (self.found[r] for r in self.ranks)
        return (1 - self.share) * a + self.share * b


def exact_quantiles(rows: DataFrame, values: dict[str, Column], fraction: float, accuracy: int = 1000, most: int = 10_000) -> dict[str, float | None]:
    """The exact quantile of each of a few expressions over all rows, as ``percentile`` gives it; nulls and NaN don't count, and
    without a value it is None.

    After a pass that counts, a round is two passes for all expressions together: one makes sketches, which bracket what is
    sought, and one counts what lies below, at and between the ends.  Nothing is copied, and a bracket holds some
    thousandths of the one before, without its ends, so ties don't stay.  Brackets with at most ``most`` values are
    gathered; only these values, ends and counts reach the driver.
    """
    # plain columns: aggregates over the expressions themselves would be too long to compile
    each = rows.select(*(v.cast("double").alias(f"_y{i}") for i, v in enumerate(values.values())))
    plain = each.select(*(F.when(~F.isnan(c), F.col(c)).alias(c.replace("y", "x")) for c in each.columns))
    sought = {k: _Sought(F.col(f"_x{i}")) for i, k in enumerate(values)}
    margin = 2 / accuracy  # a sketch is off by 1 / accuracy at most

    def one_row(aggregates: dict[str, Column]):
        return plain.agg(*(a.alias(name) for name, a in aggregates.items())).first()

    total = one_row({f"n{i}": F.count(s.value) for i, s in enumerate(sought.values())})
    for i, s in enumerate(sought.values()):
        s.inside = total[f"n{i}"]
        at = (s.inside - 1) * fraction
        s.ranks, s.share = (floor(at), ceil(at)), at - floor(at)

    def ends_of(s: _Sought) -> list[float]:
        ranks = s.open_ranks()
        return [max(0.0, (min(ranks) - s.below - 1) / s.inside - margin), min(1.0, (max(ranks) - s.below + 2) / s.inside + margin)]

    while todo := [k for k, s in sought.items() if s.inside > most and s.open_ranks()]:
        sketch = one_row({f"e{i}": F.percentile_approx(sought[k].within(), ends_of(sought[k]), accuracy) for i, k in enumerate(todo)})
        ends = {k: sketch[f"e{i}"] for i, k in enumerate(todo)}
        parts = {}
        for i, k in enumerate(todo):
            x, (lo, hi) = sought[k].value, ends[k]
            parts |= {f"b{i}": F.count_if(x < lo), f"l{i}": F.count_if(x == lo), f"m{i}": F.count_if((x > lo) & (x < hi)), f"h{i}": F.count_if(x == hi)}
        counts = one_row(parts)
        for i, k in enumerate(todo):
            s, (lo, hi) = sought[k], ends[k]
            below, at_lo, between, at_hi = (counts[f"{x}{i}"] for x in "blmh")
            for r in s.open_ranks():
                if below <= r < below + at_lo:
                    s.found[r] = lo
                elif below + at_lo + between <= r < below + at_lo + between + at_hi:
                    s.found[r] = hi
                elif not below <= r < below + at_lo + between:
                    raise RuntimeError(f"the sketch of {k} is off by more than 1 / {accuracy}")
            s.lo, s.hi, s.below, s.inside = lo, hi, below + at_lo, between
    if gathered := [k for k, s in sought.items() if s.inside > 0 and s.open_ranks()]:
        lists = one_row({f"v{i}": F.collect_list(sought[k].within()) for i, k in enumerate(gathered)})  # ``most`` values each at most
        for i, k in enumerate(gathered):
            s, ordered = sought[k], sorted(lists[f"v{i}"])
            s.found |= {r: ordered[r - s.below] for r in s.open_ranks()}
    return {k: s.result() for k, s in sought.items()}


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in ``order``: a range sort, then places inside each range."""
    ranges = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))  # one row per range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn(name, place).join(before, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
