"""Gridded vector fields: cubes, gaps, interpolation, coverage.

A field is long: ``t, lat, lon, u, v`` (epoch seconds and degrees; null u or v: land or missing).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("t", "lat", "lon")


class ForcingCoverageError(RuntimeError):
    """A field doesn't cover the place or time asked for; nothing is extrapolated in silence."""


def axes(field: DataFrame) -> dict[str, DataFrame]:
    """For each axis its values with dense numbers from 0: ``<axis>, i_<axis>, next_<axis>``.

    An axis has as many values as the grid has lines in that direction (some thousands at most).
    """
    out = {}
    for a in AXES:
        order = Window.orderBy(a)
        out[a] = field.select(a).distinct().select(a, (F.row_number().over(order) - 1).alias(f"i_{a}"), F.lead(a).over(order).alias(f"next_{a}"))
    return out


def cube(field: DataFrame) -> DataFrame:
    """Every (t, lat, lon) of the axes, with numbers and the values where there are any."""
    a = axes(field)
    grid = a["t"].select("t", "i_t").crossJoin(F.broadcast(a["lat"].select("lat", "i_lat"))).crossJoin(F.broadcast(a["lon"].select("lon", "i_lon")))
    return grid.join(field.select(*AXES, "u", "v"), list(AXES), "left")


def nearest_along(near: list[int | None]) -> list[int | None]:
    """For each place of a column the row of the nearest valid cell, by the lower envelope of parabolas.

    ``near[r]`` is the distance from (r, this column) to the nearest valid cell of row r, None if the row has none.  Row r
    offers ``(q - r)^2 + near[r]^2`` at place q; ties go to the smaller row.  Each row enters the envelope once and leaves it
    once, and all arithmetic is on integers.
    """
    n, rows, starts = len(near), [], []
    cost = [None if d is None else d * d for d in near]
    for r, c in enumerate(cost):
        if c is None:
            continue
        while rows and (starts[-1] - rows[-1]) ** 2 + cost[rows[-1]] > (starts[-1] - r) ** 2 + c:
            rows.pop()
            starts.pop()
        # up to this place the row before is as near
        begin = (r * r - rows[-1] ** 2 + c - cost[rows[-1]]) // (2 * (r - rows[-1])) + 1 if rows else 0
        if begin < n:
            rows.append(r)
            starts.append(begin)
    if not rows:
        return [None] * n
    return [r for r, begin, end in zip(rows, starts, [*starts[1:], n], strict=True) for _ in range(begin, end)]


def nearest_fill(grid: DataFrame) -> DataFrame:
    """Missing cells of a cube take the nearest cell of their time slice that has values.

    Distance is squared, in steps of the index; ties go to the smaller row, then column.  A slice without any value
    becomes 0.  An exact distance transform in two passes: windows find the nearest valid cell along each row, then each
    column (sorted, one after another in a task) is swept once.  The work for a cell doesn't depend on the grid's size.
    """
    row = Window.partitionBy("i_t", "i_lat").orderBy("i_lon")
    here = F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.struct("i_lon", "u", "v"))
    left = F.last(here, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(here, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    dl, dr = F.col("i_lon") - F.col("_l.i_lon"), F.col("_r.i_lon") - F.col("i_lon")
    nearer = F.when(dr.isNull() | (dl <= dr), F.struct(dl.cast("int").alias("d"), "_l.u", "_l.v")).otherwise(F.struct(dr.cast("int").alias("d"), "_r.u", "_r.v"))
    along = grid.select(*AXES, "i_t", "i_lat", "i_lon", left.alias("_l"), right.alias("_r")).withColumn("b", nearer)
    columns = along.select(*AXES, "i_t", "i_lat", "i_lon", F.col("b.d").alias("d"), F.col("b.u").alias("u"), F.col("b.v").alias("v"))
    columns = columns.repartition("i_t", "i_lon").sortWithinPartitions("i_t", "i_lon", "i_lat")

    def sweep(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole columns to their cells with values."""
        slices, lons, near = (table.column(c).to_pylist() for c in ("i_t", "i_lon", "d"))
        edges = [0, *(k for k in range(1, len(slices)) if slices[k] != slices[k - 1] or lons[k] != lons[k - 1]), len(slices)]
        at: list[int | None] = []
        for first, end in zip(edges, edges[1:], strict=False):
            at += [None if r is None else first + r for r in nearest_along(near[first:end])]
        place = pa.array(at, pa.int64())
        values = [pc.fill_null(table.column(c).take(place), 0.0) for c in ("u", "v")]
        names = [*AXES, "i_t", "i_lat", "i_lon"]
        yield from pa.table([*(table.column(c) for c in names), *values], names=[*names, "u", "v"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # the last column of a batch may go on in the next
            slices, lons = b.column("i_t").to_pylist(), b.column("i_lon").to_pylist()
            cut = next((k for k in range(b.num_rows - 1, 0, -1) if slices[k] != slices[k - 1] or lons[k] != lons[k - 1]), 0)
            if held and (held[-1].column("i_t")[-1].as_py(), held[-1].column("i_lon")[-1].as_py()) != (slices[0], lons[0]):
                yield from sweep(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from sweep(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from sweep(pa.Table.from_batches(held))

    kinds = ", ".join(f"{c} {columns.schema[c].dataType.simpleString()}" for c in (*AXES, "i_t", "i_lat", "i_lon"))
    return columns.mapInArrow(run, f"{kinds}, u double, v double")


def interpolate(queries: DataFrame, grid: DataFrame, clamp_time: bool = False) -> DataFrame:
    """Bilinear in space, linear in time, at rows of ``qid, es, lat, lon``; space is clamped to the edge and counted.

    A query's cell comes from the three small axes, searched by halves; its eight corners are joined by their numbers and
    added up with their weights.  A time outside the field by more than a second is an error, unless ``clamp_time``.
    """
    a = {x: grid.select(x, f"i_{x}").distinct() for x in AXES}
    listed = None
    for x in AXES:
        one = a[x].agg(F.array_sort(F.collect_list(x)).alias(f"ax_{x}"))
        listed = one if listed is None else listed.crossJoin(one)
    q = queries.crossJoin(F.broadcast(listed))  # one row: three axes
    at = {"t": "es", "lat": "lat", "lon": "lon"}
    outside = (F.col("es") < F.col("ax_t")[0] - 1) | (F.col("es") > F.element_at("ax_t", -1) + 1)
    if not clamp_time:
        q = q.withColumn("es", F.when(outside, F.raise_error(F.lit("a time is outside the field's range"))).otherwise(F.col("es")))
    beyond = lambda x: (F.col(x) < F.col(f"ax_{x}")[0]) | (F.col(x) > F.element_at(f"ax_{x}", -1))
    q = q.withColumn("out_of_domain", beyond("lat") | beyond("lon"))
    for x, c in at.items():
        ax = F.col(f"ax_{x}")
        q = q.withColumn(f"_p_{x}", F.least(F.element_at(ax, -1), F.greatest(ax[0], F.col(c))))
        # the last value that is not above: steps of 2^30 to 1 are taken where they don't go too far
        steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
        last = F.aggregate(steps, F.lit(0), lambda i, s: F.when((s < F.size(ax) - i) & (F.get(ax, i + s) <= F.col(f"_p_{x}")), i + s).otherwise(i))  # noqa: B023
        q = q.withColumn(f"_i_{x}", F.greatest(F.lit(0), F.least(last, F.size(ax) - 2)))
        lo, hi = F.get(ax, F.col(f"_i_{x}")), F.get(ax, F.col(f"_i_{x}") + 1)
        q = q.withColumn(f"_w_{x}", F.when(hi.isNull(), 0.0).otherwise((F.col(f"_p_{x}") - lo) / (hi - lo)))
    corner = lambda x, s: F.struct((F.col(f"_i_{x}") + s).alias("i"), (F.col(f"_w_{x}") if s else 1 - F.col(f"_w_{x}")).alias("w"))
    q = q.select("qid", "out_of_domain", *(F.array(corner(x, 0), corner(x, 1)).alias(f"c_{x}") for x in AXES))
    for x in AXES:
        q = q.withColumn(f"c_{x}", F.explode(f"c_{x}"))
    weight = F.col("c_t.w") * F.col("c_lat.w") * F.col("c_lon.w")
    q = q.select("qid", "out_of_domain", *(F.col(f"c_{x}.i").alias(f"i_{x}") for x in AXES), weight.alias("w")).where("w > 0")
    hit = q.join(grid.select("i_t", "i_lat", "i_lon", "u", "v"), ["i_t", "i_lat", "i_lon"])
    return hit.groupBy("qid", "out_of_domain").agg(F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v"))


def coverage(field: DataFrame) -> DataFrame:
    """One row: the box and the times that a field covers, and the share of cells without values."""
    full = cube(field)
    return full.agg(
        *(f(c).alias(f"{c}_{n}") for c in AXES for n, f in (("min", F.min), ("max", F.max))), F.avg(F.col("u").isNull().cast("double")).alias("missing_fraction")
    )


def assert_coverage(field: DataFrame, bbox: tuple[float, float, float, float], t0_s: float, t1_s: float, name: str = "field") -> dict:
    """Raise unless (lon_min, lat_min, lon_max, lat_max) and [t0, t1] (to a second) are covered."""
    r = coverage(field).first()
    get = lambda k, d: d if r[k] is None else r[k]
    problems = []
    if bbox[0] < get("lon_min", inf) or bbox[1] < get("lat_min", inf) or bbox[2] > get("lon_max", -inf) or bbox[3] > get("lat_max", -inf):
        problems.append(f"place: {bbox} is not inside lon [{r['lon_min']}, {r['lon_max']}], lat [{r['lat_min']}, {r['lat_max']}]")
    if t0_s < get("t_min", inf) - 1 or t1_s > get("t_max", -inf) + 1:
        problems.append(f"time: [{t0_s}, {t1_s}] is not inside [{r['t_min']}, {r['t_max']}]")
    if problems:
        raise ForcingCoverageError(f"{name} does not cover the case: " + "; ".join(problems))
    return r.asDict()


def points_outside(paths: DataFrame, f: GridField) -> int:
    """How many points of ``lon, lat`` lie outside a field's box, where its values go on as at the edge."""
    _, lat, lon = f.axes
    inside = F.col("lat").between(float(lat[0]), float(lat[-1])) & F.col("lon").between(float(lon[0]), float(lon[-1]))
    return paths.where(~inside).count()


class GridField:
    """A cube as arrays, for the particle loop.  Its size is checked before it is gathered."""

    MAX_CELLS = 4_000_000

    def __init__(self, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, u: np.ndarray, v: np.ndarray):
        self.axes, self.u, self.v = (t, lat, lon), u, v

    @classmethod
    def of(cls, field: DataFrame) -> GridField:
        a = axes(field)
        sizes = [a[x].count() for x in AXES]
        if np.prod([float(s) for s in sizes]) > cls.MAX_CELLS:
            raise ValueError(f"a cube of {sizes} is too large for tasks; cut it to the case's box and time, or use interpolate()")
        rows = nearest_fill(cube(field)).orderBy("i_t", "i_lat", "i_lon").toPandas()
        ax = [np.sort(rows[x].unique()) for x in AXES]
        return cls(*ax, *(rows[c].to_numpy(float).reshape(sizes) for c in ("u", "v")))

    def uv(self, lat: np.ndarray, lon: np.ndarray, es: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.axes[0]
        if np.any(es < t[0] - 1) or np.any(es > t[-1] + 1):
            raise ForcingCoverageError("a time is outside the field's range")
        found = []
        for ax, x in zip(self.axes, (np.broadcast_to(es, np.shape(lat)), lat, lon), strict=True):
            p = np.clip(x, ax[0], ax[-1])
            i = np.clip(np.searchsorted(ax, p, side="right") - 1, 0, max(len(ax) - 2, 0))
            j = np.minimum(i + 1, len(ax) - 1)
            span = ax[j] - ax[i]
            found.append((i, j, np.where(span > 0, (p - ax[i]) / np.where(span > 0, span, 1), 0.0)))
        out = []
        for f in (self.u, self.v):
            total = np.zeros(np.shape(lat))
            for corner in range(8):
                idx, w = [], 1.0
                for d, (i, j, x) in enumerate(found):
                    up = corner >> d & 1
                    idx.append(j if up else i)
                    w = w * (x if up else 1 - x)
                total = total + w * f[tuple(idx)]
            out.append(total)
        return out[0], out[1]
