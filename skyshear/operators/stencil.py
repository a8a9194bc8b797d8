"""Stencils on sparse cells (k, j, i).

A neighbour is looked up by RANGE frames on the integer index, so a cell that
isn't there is a null and never the next cell that is. Windows are partitioned
by two of the three indices and by whatever columns of CASE a table has: columns
or rows of one case or volume, spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyshear.model import SCALE_HEIGHT

AXES = {"i": ("k", "j"), "j": ("k", "i"), "k": ("j", "i")}
#: Columns that tell cases and volumes of one table apart.
CASE = ("case", "case_id", "t", "t_idx")


def cases(df: DataFrame) -> tuple[str, ...]:
    """The columns of CASE that a table has."""
    return tuple(c for c in CASE if c in df.columns)


def beside(value: Column, axis: str, step: int, by: tuple[str, ...] = ()) -> Column:
    """The value ``step`` cells along ``axis``; null where no such cell is."""
    return F.max(value).over(Window.partitionBy(*by, *AXES[axis]).orderBy(axis).rangeBetween(step, step))


def around(agg, value: Column, axis: str, reach: int, by: tuple[str, ...] = ()) -> Column:  # noqa: ANN001
    """An aggregate over up to ``reach`` cells on either side along ``axis``."""
    return agg(value).over(Window.partitionBy(*by, *AXES[axis]).orderBy(axis).rangeBetween(-reach, reach))


def central(value: Column, axis: str, step: float, by: tuple[str, ...] = ()) -> Column:
    """Central difference where both neighbours are, else null."""
    return (beside(value, axis, 1, by) - beside(value, axis, -1, by)) / (2 * step)


def secant(value: Column, coordinate: Column, axis: str, by: tuple[str, ...] = ()) -> Column:
    """Difference over coordinates of any spacing: central inside, one-sided where one neighbour is, null where none or the cell itself is null."""
    after, before = beside(value, axis, 1, by), beside(value, axis, -1, by)
    right = F.when(after.isNotNull(), beside(coordinate, axis, 1, by)).otherwise(coordinate)
    left = F.when(before.isNotNull(), beside(coordinate, axis, -1, by)).otherwise(coordinate)
    return (F.coalesce(after, value) - F.coalesce(before, value)) / F.nullif(F.when(value.isNotNull(), right - left), F.lit(0.0))


def gradient(value: Column, axis: str, step: float, size: int, by: tuple[str, ...] = ()) -> Column:
    """On a full grid with holes filled by zero: central inside, one-sided at the domain's ends."""
    at = F.col(axis)
    after, before = F.coalesce(beside(value, axis, 1, by), F.lit(0.0)), F.coalesce(beside(value, axis, -1, by), F.lit(0.0))
    own = F.coalesce(value, F.lit(0.0))
    return F.when(at == 0, (after - own) / step).when(at == size - 1, (own - before) / step).otherwise((after - before) / (2 * step))


def density(z: Column) -> Column:
    return F.exp(-z / SCALE_HEIGHT)


def divergence_vorticity(wind: DataFrame, dx: float, dy: float) -> DataFrame:
    """Horizontal divergence and vorticity where the cell and all four neighbours are valid."""
    u, v = (F.when(F.col("valid"), F.col(c)) for c in "uv")
    by = cases(wind)
    out = wind.withColumn("dudx", central(u, "i", dx, by)).withColumn("dvdy", central(v, "j", dy, by)).withColumn("dvdx", central(v, "i", dx, by)).withColumn("dudy", central(u, "j", dy, by))
    ok = F.col("valid")
    return out.withColumn("divergence", F.when(ok, F.col("dudx") + F.col("dvdy"))).withColumn("vorticity", F.when(ok, F.col("dvdx") - F.col("dudy")))


def mass_divergence(wind: DataFrame) -> DataFrame:
    """du/dx + dv/dy + (1/rho) d(rho w)/dz with secants; null where a difference has no neighbour at all."""
    rho, by = density(F.col("z")), cases(wind)
    u, v, w = (F.when(F.col("valid"), F.col(c)) for c in "uvw")
    out = wind.withColumn("rho", rho).withColumn("du", secant(u, F.col("x"), "i", by)).withColumn("dv", secant(v, F.col("y"), "j", by))
    out = out.withColumn("rw", F.when(F.col("valid"), F.col("rho") * F.col("w"))).withColumn("dw", secant(F.col("rw"), F.col("z"), "k", by))
    return out.withColumn("d_rho", F.col("du") + F.col("dv") + F.col("dw") / F.col("rho"))


def mass_adjoint(values: DataFrame, steps: dict[str, float], sizes: dict[str, int]) -> DataFrame:
    """The transpose of the mass divergence on a full grid, applied to ``value`` (k, j, i, z, value): au, av and aw."""
    rho = density(F.col("z"))
    out = None
    for name, axis in (("au", "i"), ("av", "j"), ("aw", "k")):
        given = values.withColumn("value", F.col("value") / rho) if axis == "k" else values
        one = scatter_transpose(given, axis, steps[axis], sizes[axis]).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, [*cases(values), "k", "j", "i"])
    heights = values.select(*cases(values), "k", "j", "i", "z")
    return out.join(heights, [*cases(values), "k", "j", "i"]).withColumn("aw", F.col("aw") * rho).drop("z")


def stencil_complete(cells: DataFrame, ok: Column, sizes: dict[str, int]) -> DataFrame:
    """``complete``: a cell and its neighbours in all three directions are valid; at a domain end the one inside."""

    def axis_ok(axis: str) -> Column:
        flag, at = F.when(ok, 1).otherwise(0), F.col(axis)
        have = lambda s: F.coalesce(beside(flag, axis, s, cases(cells)), F.lit(0)) == 1
        return (have(1) | (at == sizes[axis] - 1)) & (have(-1) | (at == 0))

    return cells.withColumn("complete", reduce(lambda a, b: a & b, [axis_ok(a) for a in AXES], ok))


def scatter_transpose(values: DataFrame, axis: str, step: float, size: int) -> DataFrame:
    """Transpose of the full-grid difference along ``axis``: each cell gives to the two that its difference reads; sums by target."""
    at, g = F.col(axis), F.col("value")
    up = F.when(at == size - 1, at).otherwise(at + 1)
    down = F.when(at == 0, at).otherwise(at - 1)
    weight = g / ((up - down) * step)
    parts = F.array(F.struct(up.cast("int").alias("to"), weight.alias("g")), F.struct(down.cast("int").alias("to"), (-weight).alias("g")))
    keys = (*cases(values), *AXES[axis])
    return values.select(*keys, F.explode(parts).alias("p")).groupBy(*keys, F.col("p.to").alias(axis)).agg(F.sum("p.g").alias("value"))


def downward_integral(cells: DataFrame, dz: float, top: Column) -> DataFrame:
    """Vertical speed from divergence, downwards: a cell adds div * dz to the one above where both are valid, and restarts from zero below a gap.

    Gaps number the islands from the top of each column; a running sum within an
    island does the rest. The island that holds a column's top starts from ``top``.
    """
    by = (*cases(cells), "j", "i")
    down = Window.partitionBy(*by).orderBy(F.col("k").desc())
    above = F.col("valid") & F.coalesce(F.max(F.when(F.col("valid"), 1)).over(down.rangeBetween(-1, -1)) == 1, F.lit(False))
    joined = F.col("div").isNotNull() & above
    out = cells.withColumn("joined", joined).withColumn("island", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "island").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    start = F.first(F.when(F.col("is_top") & F.col("valid"), top).otherwise(0.0)).over(inside)
    return out.withColumn("w", start + F.sum(F.when(F.col("joined"), F.col("div") * dz).otherwise(0.0)).over(inside))


def local_maxima(cells: DataFrame, value: str, reach: dict[str, int]) -> DataFrame:
    """Cells of a full grid that equal the largest of the box around them, by one window an axis (on a sparse grid rows would be missed)."""
    out = cells.withColumn("_m", F.col(value))
    for axis, n in reach.items():
        out = out.withColumn("_m", around(F.max, F.col("_m"), axis, n, cases(cells)))
    return out.filter(F.col(value) == F.col("_m")).drop("_m")


def median3(gates: DataFrame, value: str = "vr") -> DataFrame:
    """3 x 3 median over rays and gates of one sweep, where all nine are present; the edge of the sweep repeats itself, rays don't wrap."""
    by = cases(gates)
    ray = Window.partitionBy(*by, "radar", "sweep", "gate").orderBy("ray")
    gate = Window.partitionBy(*by, "radar", "sweep", "ray").orderBy("gate")
    whole = Window.partitionBy(*by, "radar", "sweep")
    out = gates.withColumn("_rl", F.min("ray").over(whole)).withColumn("_rh", F.max("ray").over(whole)).withColumn("_gl", F.min("gate").over(whole)).withColumn("_gh", F.max("gate").over(whole))
    at = lambda w, s, edge, c: F.when(F.col(edge[0]) == F.col(edge[1]), F.col(c)).otherwise(F.max(c).over(w.rangeBetween(s, s)))
    out = out.withColumn("_g0", at(gate, -1, ("gate", "_gl"), value)).withColumn("_g1", F.col(value)).withColumn("_g2", at(gate, 1, ("gate", "_gh"), value))
    names = []
    for g in range(3):
        for s, (step, edge) in enumerate(((-1, "_rl"), (0, None), (1, "_rh"))):
            name = f"_n{g}{s}"
            out = out.withColumn(name, F.col(f"_g{g}") if edge is None else at(ray, step, ("ray", edge), f"_g{g}"))
            names.append(name)
    full = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    return out.select(*by, "radar", "sweep", "ray", "gate", F.when(full, F.element_at(F.array_sort(F.array(*names)), 5)).alias("median"))


def longest_run(cells: DataFrame, ok: Column, keys: list[str], order: str) -> DataFrame:
    """Length of the longest unbroken run of ``ok`` along ``order``, by keys."""
    hits = cells.filter(ok)
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    runs = hits.withColumn("_island", island).groupBy(*keys, "_island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))
