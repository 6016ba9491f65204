"""Polygons as vertex rows ``(unit, ring, seq, lon, lat)``: edges, centroids, dissolving, map tables.

A ring's vertices are numbered by consecutive ``seq``; the first vertex may or may not be repeated at the end. Holes run
against the direction of their outer ring. Edges are paired by (unit, ring, seq), so a ring of any length is spread over
all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanaq.functions.scalar import signed_sqrt
from almanaq.operators.panel import merge

#: Vertices of a task that pairs them to edges, about; both halves are some 100 MB there.
VERTICES = 1 << 18


def edges(vertices: DataFrame, unit: str, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Directed edges ``(unit, ring, seq, x0, y0, x1, y1)``, with the closing edge of each ring.

    Every vertex is sent out twice, as the start of its edge and as the end of the one before; the two halves meet in
    an aggregate. The two halves left over per ring are its closing edge. Halves are dealt out before they meet, to as
    many tasks as the counted vertices need: neither a task that reads many of them nor one that pairs them holds more
    than ``VERTICES`` with a larger table.
    """
    parts = vertices.count() // VERTICES + 1
    number = F.col(seq).cast("long")
    halves = vertices.select(unit, ring, "lon", "lat", F.explode(F.array(
        F.struct(number.alias("seq"), F.lit(True).alias("starts")), F.struct((number - 1).alias("seq"), F.lit(False).alias("starts")))).alias("_half"))
    halves = halves.select(unit, ring, F.col("_half.seq").alias("seq"), F.col("_half.starts").alias("_is_start"), "lon", "lat")
    # Numbers, not structs, so that Spark aggregates by hash; there is one half of each kind.
    of = lambda c, starts: F.max(F.when(F.col("_is_start") == F.lit(starts), F.col(c)))
    paired = halves.repartition(parts, unit, ring, "seq").groupBy(unit, ring, "seq").agg(
        of("lon", True).alias("x0"), of("lat", True).alias("y0"), of("lon", False).alias("x1"), of("lat", False).alias("y1"),
        F.count_if(F.col("_is_start")).alias("_starts"), F.count_if(~F.col("_is_start")).alias("_ends"))
    # A number that a ring uses twice would lose a vertex.
    once = (F.col("_starts") <= 1) & (F.col("_ends") <= 1)
    paired = paired.withColumn("seq", F.when(once, F.col("seq")).otherwise(F.raise_error(F.lit("a ring uses a vertex number twice"))))
    whole = (F.col("_starts") > 0) & (F.col("_ends") > 0)
    # Two halves per ring, so this group is as large as the number of gaps in the numbering plus one.
    closing = paired.where(~whole).groupBy(unit, ring).agg(
        F.max(F.when(F.col("_ends") == 0, F.col("seq"))).alias("seq"), *[F.max(c).alias(c) for c in ("x0", "y0", "x1", "y1")],
        F.count(F.lit(1)).alias("_halves"))
    closing = closing.withColumn("x0", F.when(F.col("_halves") == 2, F.col("x0")).otherwise(
        F.raise_error(F.lit("vertex numbers of a ring must be consecutive"))))
    columns = [unit, ring, "seq", "x0", "y0", "x1", "y1"]
    return paired.where(whole).select(*columns).unionByName(closing.select(*columns))


def _planar(by: Sequence[str], directed: DataFrame) -> DataFrame:
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    # x0 * y1 - x1 * y0, written so that short edges keep their digits.
    cross = F.col("x0") * dy - F.col("y0") * dx
    sums = directed.groupBy(*by).agg(
        F.sum(cross).alias("_twice"),
        F.sum((F.col("x0") + F.col("x1")) * cross).alias("_sx"),
        F.sum((F.col("y0") + F.col("y1")) * cross).alias("_sy"),
    )
    scale = F.nullif(3 * F.col("_twice"), F.lit(0.0))
    return sums.select(
        *by, (F.col("_sx") / scale).alias("lon"), (F.col("_sy") / scale).alias("lat"), (F.abs("_twice") / 2).alias("area"))


def _direction(lon: str, lat: str) -> list[Column]:
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)]


def _step() -> list[Column]:
    """Start minus end direction of an edge, from half-angle products: short edges keep their digits."""
    a, b = F.radians(F.col("x0") - F.col("x1")) / 2, F.radians(F.col("y0") - F.col("y1")) / 2
    mid_a, mid_b = F.radians(F.col("x0") + F.col("x1")) / 2, F.radians(F.col("y0") + F.col("y1")) / 2
    plus, minus = F.sin(a + b), F.sin(a - b)
    return [
        -F.sin(mid_a - mid_b) * minus - F.sin(mid_a + mid_b) * plus,
        F.cos(mid_a + mid_b) * plus + F.cos(mid_a - mid_b) * minus,
        2 * F.cos(mid_b) * F.sin(b),
    ]


def _spherical(by: Sequence[str], directed: DataFrame) -> DataFrame:
    p, q = _direction("x0", "y0"), _direction("x1", "y1")
    # (p - q) x (p + q) = 2 p x q
    less, more = _step(), [a + b for a, b in zip(p, q)]
    normal = [(less[i - 2] * more[i - 1] - less[i - 1] * more[i - 2]) / 2 for i in range(3)]
    sine = F.sqrt(sum(n * n for n in normal))
    angle = F.atan2(sine, sum(a * b for a, b in zip(p, q)))
    weight = F.when(sine > 0, angle / F.nullif(sine, F.lit(0.0))).otherwise(F.lit(1.0))
    sums = directed.groupBy(*by).agg(
        *[F.sum(weight * n / 2).alias(f"_m{i}") for i, n in enumerate(normal)],
        *[F.sum(c).alias(f"_p{i}") for i, c in enumerate(p)],
    )
    facing = sum(F.col(f"_m{i}") * F.col(f"_p{i}") for i in range(3))
    sign = F.when(facing < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    v = [F.col(f"_m{i}") * sign for i in range(3)]
    return sums.select(
        *by,
        F.degrees(F.atan2(v[1], v[0])).alias("lon"),
        F.degrees(F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1]))).alias("lat"),
    )


def centroids(vertices: DataFrame, unit: str, surface: str = "plane") -> DataFrame:
    """Area centroid of each unit.

    ``"plane"`` treats degrees as coordinates and also gives the area in square degrees. ``"sphere"`` integrates over
    the sphere with great-circle edges, as geographic packages do by default.
    """
    directed = edges(vertices, unit)
    return {"plane": _planar, "sphere": _spherical}[surface]([unit], directed)


def _undirected() -> list[Column]:
    start, end = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return [F.least(start, end).alias("_from"), F.greatest(start, end).alias("_to")]


def _parent_edges(vertices: DataFrame, unit: str, parent: str) -> DataFrame:
    """Edges of all units with their parent and the number of the parent's units that have them; no empty edges."""
    owned = vertices.withColumn("_owner", F.struct(F.col(parent).alias("parent"), F.col(unit).alias("unit")))
    lines = edges(owned, "_owner").withColumn(parent, F.col("_owner.parent"))
    lines = lines.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    return lines.groupBy(parent, *_undirected()).agg(
        F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def dissolve_edges(vertices: DataFrame, unit: str, parent: str) -> DataFrame:
    """Outline of each parent: the edges that only one of its units has, with their direction.

    ``vertices`` carries the parent of each unit. Neighbours must share exact vertices. The direction allows areas and
    centroids of the parents from the same rows.
    """
    return _parent_edges(vertices, unit, parent).where(F.col("times") == 1).select(parent, "x0", "y0", "x1", "y1")


def edge_multiplicity(vertices: DataFrame, unit: str, parent: str) -> DataFrame:
    """Quality of a coverage: per parent how many edges occur once, twice, or more often (overlaps)."""
    return _parent_edges(vertices, unit, parent).groupBy(parent).agg(
        F.count_if(F.col("times") == 1).alias("outline"), F.count_if(F.col("times") == 2).alias("shared"),
        F.count_if(F.col("times") > 2).alias("overlapping"))


def outline_centroids(outline: DataFrame, parent: str) -> DataFrame:
    """Planar centroid and area of dissolved parents from their outline edges."""
    return _planar([parent], outline)


def profile_map(profile: DataFrame, polygons: DataFrame, unit: str, keep_missing: bool = False) -> DataFrame:
    """Polygon attributes with the monthly profile of each unit.

    Units without a polygon stay. Polygons without a profile stay only with ``keep_missing``.
    """
    joined = merge(profile, polygons, [unit], "full")
    return joined if keep_missing else joined.where(F.col("month").isNotNull())


def map_table(units: DataFrame, coefs: DataFrame, unit: str, attributes: Sequence[str] = ()) -> DataFrame:
    """One row per unit with its coefficient and the signed square root of it; units without one have NULL.

    ``units`` may repeat a unit (a monthly profile); repeats collapse before the join.
    """
    distinct = units.select(unit, *attributes).dropDuplicates()
    joined = merge(distinct, coefs.select(unit, "estimate", "std_error", "p_value"), [unit], "left")
    return joined.withColumn("estimate_sqrt", signed_sqrt("estimate"))
