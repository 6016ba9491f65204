"""Outlines as rings, and coverages whose borders share no vertices (G2, S11).

``split_edges`` cuts every edge where another vertex of its parent lies on it, so that borders that only touch cancel.
``outline_rings`` strings the edges of outlines together: which edge follows is decided at each vertex, then pointer
jumping finds every ring's first edge and every edge's place, in as many rounds as the longest ring's length has binary
digits. No ring is ever gathered in one task, and edges are dealt to as many tasks as the counted ones need before they
are joined by their ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almanaq.operators.geo import _undirected, edges
from almanaq.sources.tables import discard, materialise

ENDS = ("x0", "y0", "x1", "y1")
TWO_PI = 6.283185307179586
#: Edges of a task that joins them by id, about; both sorted sides are some 100 MB there.
EDGES = 1 << 18


def _angle(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx)


def _joined(left: DataFrame, right: DataFrame, key: str, parts: int, how: str = "inner") -> DataFrame:
    """Join by an edge's id, which at most a few rows share on either side, in ``parts`` tasks."""
    return left.repartition(parts, key).join(right.repartition(parts, key), key, how)


def following(outline: DataFrame, parent: str) -> DataFrame:
    """``id, parent, x0 .. y1, next``: each edge with the one that follows it on its ring.

    Where several edges leave a vertex (rings that touch there), the one that turns back least to the right of the
    incoming edge's reverse follows: rings that touch stay apart. Raises unless every edge follows exactly one other.
    """
    numbered = materialise(outline.select(parent, *ENDS).withColumn("id", F.monotonically_increasing_id()))
    out = numbered.select(F.col(parent).alias("_p"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("id").alias("_next"), F.col("x1").alias("_x"), F.col("y1").alias("_y"))
    near = numbered.join(out, F.col(parent).eqNullSafe(F.col("_p")) & (numbered["x1"] == out["x1"]) & (numbered["y1"] == out["y1"]), "left").select(
        "id", parent, "x0", "y0", numbered["x1"], numbered["y1"], "_next", "_x", "_y")
    back = _angle(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1"))
    ahead = _angle(F.col("_x") - F.col("x1"), F.col("_y") - F.col("y1"))
    turn = F.pmod(back - ahead, F.lit(TWO_PI))
    turn = F.when(turn < 1e-12, turn + TWO_PI).otherwise(turn)  # straight back is the last choice
    chosen = near.withColumn("_turn", turn).groupBy("id").agg(F.min_by("_next", F.struct("_turn", "_next")).alias("next"))
    linked = materialise(_joined(numbered, chosen, "id", numbered.count() // EDGES + 1))
    followed = linked.groupBy("next").agg(F.count(F.lit(1)).alias("n")).where("next is null or n > 1")
    broken = not followed.isEmpty()
    discard(numbered)
    if broken:
        discard(linked)
        raise ValueError("outline edges don't close to rings")
    return linked


def outline_rings(outline: DataFrame, parent: str) -> DataFrame:
    """``parent, ring, seq, lon, lat, hole`` of directed outline edges ``(parent, x0, y0, x1, y1)``, as ``dissolve_edges``
    returns them.

    A ring starts at its smallest vertex (by lon, lat) and keeps its direction; rings of a parent are numbered by their
    first edges, vertices from 1, the first one isn't repeated. A hole runs against the parent's outer rings.
    """
    linked = following(outline, parent)
    parts = linked.count() // EDGES + 1
    # The smallest edge ahead: windows of 1, 2, 4, ... edges, until doubling changes nothing.
    own = F.struct(*ENDS, "id")
    ahead = materialise(linked.select("id", F.col("next").alias("to"), own.alias("least")))
    while True:
        hop = ahead.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        wider = materialise(_joined(ahead, hop, "to", parts).select(
            "id", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("_moved")))
        done = wider.where("_moved").isEmpty()
        discard(ahead)
        ahead = wider.drop("_moved")
        ahead._almanaq_path = wider.__dict__.pop("_almanaq_path")
        if done:
            break
    # Places: from every edge back to the ring's first one, twice as far with every round.
    heads = materialise(_joined(linked, ahead.select("id", F.col("least.id").alias("head")), "id", parts))
    before = heads.select(F.col("next").alias("id"), F.col("id").alias("prev"))
    first = F.col("id") == F.col("head")
    place = materialise(_joined(heads.select("id", "head"), before, "id", parts).select(
        "id", F.when(~first, F.col("prev")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("steps")))
    while not place.where("to is not null").isEmpty():
        hop = place.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        # Edges that are placed wait aside: their keys are NULL and would all meet in one task.
        moved = _joined(place.where("to is not null"), hop, "to", parts, "left").select(
            "id", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
        further = materialise(moved.unionByName(place.where("to is null")))
        discard(place)
        place = further
    placed = _joined(heads, place.select("id", "steps"), "id", parts)
    cross = F.col("x0") * (F.col("y1") - F.col("y0")) - F.col("y0") * (F.col("x1") - F.col("x0"))
    rings = placed.groupBy(parent, "head").agg(F.sum(cross).alias("_area"), F.min_by(F.struct(*ENDS), "steps").alias("_start"))
    # One row per ring in these windows, not one per edge.
    mine = Window.partitionBy(parent)
    rings = rings.withColumn("ring", F.row_number().over(mine.orderBy("_start", "head"))).withColumn("_whole", F.sum("_area").over(mine))
    rings = rings.select(F.col("head").alias("_head"), "ring", (F.signum("_area") * F.signum("_whole") < 0).alias("hole"))
    return placed.join(rings, F.col("head") == F.col("_head")).select(
        parent, "ring", (F.col("steps") + 1).alias("seq"), F.col("x0").alias("lon"), F.col("y0").alias("lat"), "hole")


def _cells_along(size: Column, columns: Sequence[str] = ENDS) -> Column:
    """Grid cells that an edge runs through: for every column of cells the rows between its ends there."""
    x0, y0, x1, y1 = (F.col(c) for c in columns)
    left, right = F.floor(F.least(x0, x1) / size), F.floor(F.greatest(x0, x1) / size)

    def rows(i: Column) -> Column:
        at = lambda x: F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * ((F.greatest(F.least(x, F.greatest(x0, x1)), F.least(x0, x1)) - x0) / (x1 - x0)))
        a, b = at(i * size), at((i + 1) * size)
        steep = x1 == x0
        lo, hi = F.when(steep, F.least(y0, y1)).otherwise(F.least(a, b)), F.when(steep, F.greatest(y0, y1)).otherwise(F.greatest(a, b))
        slack = size * 1e-6
        return F.transform(F.sequence(F.floor((lo - slack) / size), F.floor((hi + slack) / size)), lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(F.sequence(left - 1, right + 1), rows))


def split_edges(directed: DataFrame, parent: str, tolerance: float = 1e-9, cell: float | None = None) -> DataFrame:
    """``parent, x0, y0, x1, y1``: the edges, cut at every vertex of the parent that lies on them.

    A vertex lies on an edge when it is nearer to it than ``tolerance`` times the edge's length and not at its ends.
    Edges and vertices meet in the cells of a grid; ``cell`` is their size, by default twice the mean length of an edge.
    An edge is listed in as many cells as it runs through, never in all of a rectangle.
    """
    lines = materialise(directed.select(parent, *ENDS).withColumn("_id", F.monotonically_increasing_id()))
    if cell is None:
        cell = (lines.agg(F.avg(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 0.5) * 2
    size = F.lit(float(cell) or 1.0)
    points = lines.select(F.col(parent).alias("_p"), F.col("x0").alias("px"), F.col("y0").alias("py")).distinct()
    points = points.withColumns({"i": F.floor(F.col("px") / size), "j": F.floor(F.col("py") / size)})
    # A vertex on the border of a cell may lie in the next one by rounding: edges are listed with a margin of a column.
    listed = lines.withColumn("_cell", F.explode(F.array_distinct(_cells_along(size)))).select("*", "_cell.i", "_cell.j").drop("_cell")
    met = listed.join(points, (listed[parent].eqNullSafe(points["_p"])) & (listed["i"] == points["i"]) & (listed["j"] == points["j"]))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ex, ey = F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    square = dx * dx + dy * dy
    along, off = (ex * dx + ey * dy) / square, F.abs(ex * dy - ey * dx) / square
    inner = met.where(square > 0).withColumn("_along", along).where((off <= tolerance) & (F.col("_along") > tolerance) & (F.col("_along") < 1 - tolerance))
    cuts = inner.groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("_along", F.col("px").alias("x"), F.col("py").alias("y")))).alias("_cuts"))
    whole = lines.join(cuts, "_id", "left")
    none = F.array().cast("array<struct<x:double,y:double>>")
    inside = F.coalesce(F.transform("_cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), none)
    path = F.concat(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))), inside, F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    steps = F.transform(F.sequence(F.lit(1), F.size("_path") - 1), lambda k: F.struct(F.get("_path", k - 1).alias("a"), F.get("_path", k).alias("b")))
    return whole.withColumn("_path", path).select(parent, F.explode(steps).alias("_s")).select(
        parent, F.col("_s.a.x").alias("x0"), F.col("_s.a.y").alias("y0"), F.col("_s.b.x").alias("x1"), F.col("_s.b.y").alias("y1"))


def dissolve_touching(vertices: DataFrame, unit: str, parent: str, tolerance: float = 1e-9, cell: float | None = None) -> DataFrame:
    """``geo.dissolve_edges`` for neighbours that need not share vertices: where one has a vertex on the other's edge, the
    edge is cut there before shared borders cancel."""
    owned = vertices.withColumn("_owner", F.struct(F.col(parent).alias("parent"), F.col(unit).alias("unit")))
    lines = edges(owned, "_owner").withColumn(parent, F.col("_owner.parent"))
    lines = lines.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
    cut = split_edges(lines, parent, tolerance, cell)
    return cut.groupBy(parent, *_undirected()).agg(F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in ENDS]).where("times = 1").select(parent, *ENDS)
