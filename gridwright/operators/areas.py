"""Unions of areas: the outline of what a group's polygons cover together, by joins over cells.

Edges are cut where others of their cells meet them. Both sides of every piece are then looked up: an area covers
a place if its edges cross the way there from outside an odd number of times. That way goes along the cells'
lower borders, where crossings are counted once for each area and row of cells, and through the place's own cell, so
only edges of that cell have to be looked at. Pieces with one side covered are the outline; each finds the
piece that goes on from its end, and pointer doubling tells the ring that it is in and its place there.
Every step is keyed by cell, edge or piece; a group of any size spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.operators.quantiles import with_group

#: Edges that a cell is to have, about, if they lie evenly; where the first cell begins, off any round coordinate.
EDGES, SHIFT = 8, 0.3819660112501051
#: Relative slack within which an end counts as lying on another edge.
NEAR = 1e-9


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def edges(areas: DataFrame, by: list[str]) -> DataFrame:
    """by, a (the area's number), x1, y1, x2, y2 of the edges of all rings of four corners or more, the last as the first."""
    rings = areas.select(*by, "a", F.explode(F.coalesce("rings", F.array().cast("array<array<struct<x: double, y: double>>>"))).alias("r"))
    n = F.size("r")
    ends = F.zip_with(F.slice("r", 1, n - 1), F.slice("r", 2, n - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    e = rings.where(n > 3).select(*by, "a", F.explode(ends).alias("e")).select(*by, "a", "e.*")
    return e.dropna(subset=["x1", "y1", "x2", "y2"]).where("x1 <> x2 or y1 <> y2")


def _grid(e: DataFrame, by: list[str]) -> DataFrame:
    """by, x0, y0, w: each group's cells, about as wide as its edges are long, and wider where they are few."""
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    size = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    s = e.groupBy(*by).agg(F.min(low("x1", "x2")).alias("a"), F.max(high("x1", "x2")).alias("b"), F.min(low("y1", "y2")).alias("c"), F.max(high("y1", "y2")).alias("d"), F.avg(size).alias("m"), F.count("*").alias("n"))
    w = F.greatest(F.col("m") * 1.0123, F.sqrt((F.col("b") - F.col("a")) * (F.col("d") - F.col("c")) * EDGES / F.col("n")), F.lit(1e-9))
    return s.withColumn("w", w).select(*by, (F.col("a") - F.col("w") * SHIFT).alias("x0"), (F.col("c") - F.col("w") * SHIFT).alias("y0"), "w")


def _cell(v: Column, first: str) -> Column:
    return F.floor((v - F.col(first)) / F.col("w")).cast("long")


def _in_cells(e: DataFrame) -> DataFrame:
    """Each edge once for each cell that its bounds meet."""
    span = lambda a, b, first: F.explode(F.sequence(_cell(F.least(a, b), first), _cell(F.greatest(a, b), first)))
    return e.withColumn("cx", span("x1", "x2", "x0")).withColumn("cy", span("y1", "y2", "y0"))


def pieces(e: DataFrame, by: list[str], digits: int) -> DataFrame:
    """by, x1, y1, x2, y2: the edges (with their group's x0, y0, w) cut where others meet or overlap them, without repeats; each from its smaller end."""
    least = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = lambda a, b: F.when(least, F.col(a)).otherwise(F.col(b))
    ordered = e.select(*by, "x0", "y0", "w", ends("x1", "x2").alias("x1"), ends("y1", "y2").alias("y1"), ends("x2", "x1").alias("x2"), ends("y2", "y1").alias("y2")).distinct()
    ordered = cut(ordered.withColumn("id", F.monotonically_increasing_id()))
    held = _in_cells(ordered)
    other = held.select(*by, "cx", "cy", F.col("id").alias("jd"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    c = F.col
    met = held.join(other, [*by, "cx", "cy"]).where(c("id") != c("jd"))
    met = met.where((F.least("oy1", "oy2") <= F.greatest("y1", "y2")) & (F.greatest("oy1", "oy2") >= F.least("y1", "y2")) & (c("ox1") <= c("x2")) & (c("ox2") >= c("x1")))
    dx, dy, ex, ey, gx, gy = c("x2") - c("x1"), c("y2") - c("y1"), c("ox2") - c("ox1"), c("oy2") - c("oy1"), c("ox1") - c("x1"), c("oy1") - c("y1")
    cross, square = dx * ey - dy * ex, dx * dx + dy * dy
    t, u = F.try_divide(gx * ey - gy * ex, cross), F.try_divide(gx * dy - gy * dx, cross)
    along = lambda x, y: ((x - c("x1")) * dx + (y - c("y1")) * dy) / square
    at = F.when(cross != 0, F.when((u > -NEAR) & (u < 1 + NEAR), F.array(t))).when(F.abs(gx * dy - gy * dx) <= NEAR * F.sqrt(square), F.array(along(c("ox1"), c("oy1")), along(c("ox2"), c("oy2"))))
    cuts = met.select("id", F.explode(at).alias("t")).where("t > 0 and t < 1").groupBy("id").agg(F.collect_set("t").alias("ts"))
    ts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>"))))
    points = F.transform(ts, lambda t: _point(F.round(c("x1") + t * dx, digits), F.round(c("y1") + t * dy, digits)))
    parts = ordered.join(cuts, "id", "left").select(*by, "x0", "y0", "w", points.alias("p"))
    n = F.size("p")
    parts = parts.select(*by, "x0", "y0", "w", F.explode(F.zip_with(F.slice("p", 1, n - 1), F.slice("p", 2, n - 1), lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")))).alias("z"))
    return parts.where("z.p <> z.q").select(*by, "x0", "y0", "w", F.col("z.p.x").alias("x1"), F.col("z.p.y").alias("y1"), F.col("z.q.x").alias("x2"), F.col("z.q.y").alias("y2")).distinct()


def _odd_corners(e: DataFrame, by: list[str]) -> DataFrame:
    """by, a, cx, cy of cells whose lower left corner the area covers: between its crossings of the row's lower border, two and two."""
    c = F.col
    row = F.sequence(_cell(F.least("y1", "y2"), "y0"), _cell(F.greatest("y1", "y2"), "y0"))
    over = e.withColumn("cy", F.explode(row)).withColumn("y", c("y0") + c("cy") * c("w")).where((c("y1") > c("y")) != (c("y2") > c("y")))
    over = over.withColumn("x", c("x1") + (c("y") - c("y1")) * (c("x2") - c("x1")) / (c("y2") - c("y1"))).withColumn("k", _cell(c("x"), "x0"))
    rows = over.groupBy(*by, "a", "cy").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    pairs = F.filter(F.transform("ks", lambda k, i: F.when(i % 2 == 0, F.struct((k + 1).alias("s"), F.try_element_at("ks", (i + 2).cast("int")).alias("e")))), lambda z: z.isNotNull() & (z["s"] <= z["e"]))
    return rows.select(*by, "a", "cy", F.explode(pairs).alias("z")).select(*by, "a", "cy", F.explode(F.sequence("z.s", "z.e")).alias("cx"))


def covered(points: DataFrame, e: DataFrame, by: list[str]) -> DataFrame:
    """``points`` (with id, x, y and their group's x0, y0, w) that lie in any area of the edges ``e`` (with x0, y0, w); id only."""
    c = F.col
    held = _in_cells(e).select(*by, "a", "cx", "cy", "x1", "y1", "x2", "y2")
    corners = cut(_odd_corners(e, by))
    edged = held.select(*by, "a", "cx", "cy").distinct()
    full = corners.join(edged, [*by, "a", "cx", "cy"], "left_anti").select(*by, "cx", "cy").distinct()
    at = points.select(*by, "id", "x", "y", _cell(c("x"), "x0").alias("cx"), _cell(c("y"), "y0").alias("cy"), "x0", "y0", "w")
    whole = at.join(full, [*by, "cx", "cy"], "left_semi").select("id")
    at = at.join(full, [*by, "cx", "cy"], "left_anti")
    left, low = c("x0") + c("cx") * c("w"), c("y0") + c("cy") * c("w")
    # what lies level with a place counts as below it, here as in the crossings of its own level
    up = c("y1") + F.try_divide((left - c("x1")) * (c("y2") - c("y1")), c("x2") - c("x1"))
    along = c("x1") + F.try_divide((c("y") - c("y1")) * (c("x2") - c("x1")), c("y2") - c("y1"))
    rises = F.coalesce(((c("x1") > left) != (c("x2") > left)) & (up > low) & (up <= c("y")), F.lit(False))
    runs = F.coalesce(((c("y1") > c("y")) != (c("y2") > c("y"))) & (along > left) & (along < c("x")), F.lit(False))
    crossed = at.join(held, [*by, "cx", "cy"]).where(rises | runs).select("id", "a", (rises.cast("int") + runs.cast("int")).alias("n"))
    begun = at.join(corners.join(edged, [*by, "a", "cx", "cy"], "left_semi"), [*by, "cx", "cy"]).select("id", "a", F.lit(1).alias("n"))
    parity = crossed.unionByName(begun).groupBy("id", "a").agg(F.sum("n").alias("n")).where("n % 2 = 1").select("id")
    return whole.union(parity).distinct()


def outline(areas: DataFrame, by: list[str], digits: int = 6, step: float = 1e-5) -> DataFrame:
    """by, x1, y1, x2, y2: the pieces of the outline of each group's union (areas: by, rings), with what is covered on their left."""
    given = cut(areas.select(*by, "rings").withColumn("a", F.monotonically_increasing_id()))
    e = edges(given, by)
    e = cut(with_group(e, cut(_grid(e, by)), by))
    p = cut(pieces(e, by, digits).withColumn("id", F.monotonically_increasing_id()))
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    off = F.lit(step) / F.sqrt(dx * dx + dy * dy)
    side = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    sides = p.select(*by, "x0", "y0", "w", "id", side, "x1", "y1", "x2", "y2")
    sides = sides.select(*by, "x0", "y0", "w", (c("id") * 2 + (c("side") > 0).cast("int")).alias("id"), ((c("x1") + c("x2")) / 2 - c("side") * dy * off).alias("x"), ((c("y1") + c("y2")) / 2 + c("side") * dx * off).alias("y"))
    inside = covered(sides, e, by).groupBy(F.expr("id div 2").alias("id")).agg(F.max(c("id") % 2 == 1).alias("left"), F.count("*").alias("k")).where("k = 1")
    turned = p.join(inside, "id")
    end = lambda a, b: F.when(c("left"), c(a)).otherwise(c(b)).alias(a)
    return cut(turned.select(*by, "id", end("x1", "x2"), end("y1", "y2"), end("x2", "x1"), end("y2", "y1")))


def rings(pieces_: DataFrame, by: list[str]) -> DataFrame:
    """by, ring, place, x, y: the pieces of an outline (by, id, x1, y1, x2, y2) linked to rings by ordered pointer doubling.

    At a corner that several parts share, the sharpest turn to the left keeps them apart. A ring begins at its smallest corner; a
    piece without one that goes on from its end is an error.
    """
    c = F.col
    one = pieces_.select(*by, "id", "x1", "y1", c("x2").alias("x"), c("y2").alias("y"))
    two = pieces_.select(*by, c("id").alias("to"), c("x1").alias("x"), c("y1").alias("y"), c("x2").alias("tx"), c("y2").alias("ty"))
    back, on = F.atan2(c("y1") - c("y"), c("x1") - c("x")), F.atan2(c("ty") - c("y"), c("tx") - c("x"))
    turn = F.pmod(back - on, F.lit(6.283185307179586))
    turn = F.when(turn > 1e-12, turn).otherwise(6.283185307179586)
    after = one.join(two, [*by, "x", "y"], "left").groupBy("id").agg(F.min_by("to", turn).alias("to"))
    after = after.withColumn("to", F.coalesce("to", F.raise_error(F.lit("a piece of an outline has no end")).cast("long")))
    first = F.struct("x1", "y1", "id").alias("least")
    now = cut(pieces_.join(after, "id").select(*by, "id", "x1", "y1", "to", first, F.lit(0).cast("long").alias("ahead")))
    step = 1
    while True:  # least: the smallest corner among the next ``step`` pieces, ahead: how far it is
        far = now.select(c("id").alias("to"), c("to").alias("__to"), c("least").alias("__least"), c("ahead").alias("__ahead"))
        better = c("__least") < c("least")
        moved = now.join(far, "to").select(*by, "id", "x1", "y1", c("__to").alias("to"), F.least("least", "__least").alias("least"), F.when(better, c("__ahead") + step).otherwise(c("ahead")).alias("ahead"), better.alias("moved"))
        seen = Observation()
        now = cut(moved.observe(seen, F.max("moved").alias("any")), release=step % 64 == 0)
        step *= 2
        if not seen.get["any"]:
            break
    return now.select(*by, c("least.id").alias("ring"), F.when(c("ahead") == 0, F.lit(0)).otherwise(-c("ahead")).alias("place"), (c("ahead") == 0).alias("first"), c("x1").alias("x"), c("y1").alias("y"))


def _straight(p: Column) -> Column:
    """A closed ring of open corners, without those on straight lines."""
    n = F.size(p)
    before, after = F.concat(F.slice(p, n, F.lit(1)), F.slice(p, F.lit(1), n - 1)), F.concat(F.slice(p, F.lit(2), n - 1), F.slice(p, 1, 1))
    three = F.transform(p, lambda q, i: F.struct(F.get(before, i).alias("a"), q.alias("b"), F.get(after, i).alias("c")))

    def bends(z: Column) -> Column:
        ax, ay, bx, by = z["b"]["x"] - z["a"]["x"], z["b"]["y"] - z["a"]["y"], z["c"]["x"] - z["b"]["x"], z["c"]["y"] - z["b"]["y"]
        return F.abs(ax * by - ay * bx) > NEAR * F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))

    kept = F.transform(F.filter(three, bends), lambda z: z["b"])
    kept = F.when(F.size(kept) > 2, kept).otherwise(p)
    return F.concat(kept, F.slice(kept, 1, 1))


def dissolved(areas: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """by, rings, area: the union of each group's areas (rings: outer ring and holes).

    What an odd number of an area's rings hold is in it. Outer rings run counter-clockwise, holes clockwise, without
    corners on straight lines. Null and empty areas count as nothing; a group that covers nothing has no rings and
    area 0. Coordinates are rounded to ``digits``. Only the finished outline of a group meets in one row; ``outline`` has its pieces.
    """
    name = F.to_json(F.struct(F.lit(0).alias("z"), *[F.col(x).cast("string").alias(f"k{i}") for i, x in enumerate(by)]))  # a key without nulls
    keyed = areas.select(*by, "rings", name.alias("__gw_g"))
    groups, g = cut(keyed.select(*by, "__gw_g").distinct()), ["__gw_g"]
    p = outline(keyed, g, digits)
    c = F.col
    origin = cut(p.groupBy(*g).agg(F.min("x1").alias("a"), F.min("y1").alias("b")))
    twice = (c("x1") - c("a")) * (c("y2") - c("b")) - (c("x2") - c("a")) * (c("y1") - c("b"))
    size = with_group(p, origin, g).groupBy(*g).agg((F.sum(twice) / 2).alias("area"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((~c("first")).alias("later"), "place", "x", "y"))), lambda z: _point(z["x"], z["y"]))
    each = rings(p, g).groupBy(*g, "ring").agg(ordered.alias("p")).select(*g, _straight(c("p")).alias("r"))
    whole = each.groupBy(*g).agg(F.array_sort(F.collect_list("r")).alias("rings")).join(size, g)
    none = F.array().cast("array<array<struct<x: double, y: double>>>")
    return groups.join(whole, g, "left").select(*by, F.coalesce("rings", none).alias("rings"), F.coalesce("area", F.lit(0.0)).alias("area"))
