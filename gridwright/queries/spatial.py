"""Nearest neighbours, spatial joins and cutting of ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions import geometry as G
from gridwright.operators import metrics, spatial
from gridwright.queries.registry import Views, query


def _points(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("osm_id").alias("id"), "x", "y", *more)


@query("""WITH d AS (SELECT a.plz, a.osm_id, SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist, ROW_NUMBER() OVER (PARTITION BY a.osm_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.osm_id) AS r
FROM x_buildings a JOIN x_buildings b ON a.plz=b.plz AND a.osm_id<>b.osm_id)
SELECT plz, ROUND(AVG(dist),6) AS mean_distance FROM d WHERE r<=4 GROUP BY plz""")
def knn4_mean_distance(v: Views) -> DataFrame:
    """Mean distance to the four nearest others of a postcode."""
    p = _points(v.x_buildings, "plz")
    return spatial.nearest(p, p, 4, ["plz"], itself=False).groupBy("plz").agg(F.round(F.avg("dist"), 6).alias("mean_distance"))


@query("""WITH d AS (SELECT a.plz, a.osm_id, SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist, ROW_NUMBER() OVER (PARTITION BY a.osm_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.osm_id) AS r
FROM x_buildings a JOIN x_buildings b ON a.plz=b.plz AND a.osm_id<>b.osm_id), m AS (SELECT plz, osm_id, AVG(dist) AS m FROM d WHERE r<=4 GROUP BY 1,2)
SELECT plz, ROUND(QUANTILE_CONT(m,0.5),6) AS house_distance FROM m GROUP BY plz""")
def house_distance(v: Views) -> DataFrame:
    """Median of the mean distances to four neighbours."""
    p = _points(v.x_buildings, "plz")
    m = metrics.median_neighbour_distance(spatial.nearest(p, p, 4, ["plz"], itself=False), ["plz"])
    return m.select("plz", F.round("house_distance", 6).alias("house_distance"))


@query("""WITH d AS (SELECT a.osm_id, b.osm_id AS trafo, SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist, ROW_NUMBER() OVER (PARTITION BY a.osm_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.osm_id) AS r FROM x_buildings a CROSS JOIN x_transformers b)
SELECT osm_id, trafo, ROUND(dist,6) AS dist FROM d WHERE r=1""")
def nearest_transformer(v: Views) -> DataFrame:
    """Nearest transformer at any distance."""
    return spatial.nearest(_points(v.x_buildings), _points(v.x_transformers)).select(F.col("id").alias("osm_id"), F.col("other").alias("trafo"), F.round("dist", 6).alias("dist"))


@query("""WITH d AS (SELECT a.osm_id, b.osm_id AS trafo, SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist FROM x_buildings a CROSS JOIN x_transformers b),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY osm_id ORDER BY dist, trafo) AS r FROM d WHERE dist<=600)
SELECT osm_id, trafo, ROUND(dist,6) AS dist FROM r WHERE r=1""")
def nearest_within_radius(v: Views) -> DataFrame:
    """Nearest transformer in a radius."""
    return spatial.nearest_within(_points(v.x_buildings), _points(v.x_transformers), 600.0).select(F.col("id").alias("osm_id"), F.col("other").alias("trafo"), F.round("dist", 6).alias("dist"))


@query("""WITH RECURSIVE e AS (SELECT a.osm_id AS a, b.osm_id AS b FROM x_buildings a JOIN x_buildings b ON a.osm_id<>b.osm_id AND SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<=120),
r(n) AS (SELECT osm_id FROM x_buildings WHERE osm_id%50=0 UNION SELECT e.b FROM r JOIN e ON r.n=e.a)
SELECT osm_id, osm_id IN (SELECT n FROM r) AS zeroed FROM x_buildings""")
def touch_propagation(v: Views) -> DataFrame:
    """A mark that spreads over adjacent buildings."""
    return spatial.spread_within(_points(v.x_buildings), 120.0, F.col("id") % 50 == 0).select(F.col("id").alias("osm_id"), F.col("reached").alias("zeroed"))


@query("""SELECT b.osm_id, n.n_nationkey AS area FROM x_buildings b JOIN nation n ON ABS(b.x-(400*n.n_nationkey+100))+ABS(b.y-(9000-350*n.n_nationkey))<900.5e0""")
def point_in_polygon(v: Views) -> DataFrame:
    """Points in polygons, by cells of their bounds and ray casting."""
    cx, cy, r = F.expr("400 * n_nationkey + 100"), F.expr("9000 - 350 * n_nationkey"), 900.5
    corner = lambda dx, dy: G.point(cx + dx * r, cy + dy * r)
    areas = v.nation.select(F.col("n_nationkey").alias("area"), F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1), corner(1, 0)).alias("ring"))
    return spatial.contained(_points(v.x_buildings), areas, 1000.0).select(F.col("id").alias("osm_id"), "area")


@query("SELECT n_nationkey AS area, ROUND(CAST(2*(100.0e0+n_nationkey)*(100.0e0+n_nationkey) AS DOUBLE),4) AS size, CAST(ROUND(400.0e0*n_nationkey,4) AS DOUBLE) AS cx, CAST(ROUND(7.0e0*n_nationkey,4) AS DOUBLE) AS cy, ROUND(4*SQRT(2e0)*(100+n_nationkey),6) AS girth FROM nation")
def polygon_measures(v: Views) -> DataFrame:
    """Area, centroid and length of rings."""
    cx, cy, r = F.expr("400.0D * n_nationkey"), F.expr("7.0D * n_nationkey"), F.expr("100.0D + n_nationkey")
    corner = lambda dx, dy: G.point(cx + dx * r, cy + dy * r)
    ring = F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1), corner(1, 0))
    n = v.nation.select(F.col("n_nationkey").alias("area"), ring.alias("ring"))
    c = G.ring_centroid(F.col("ring"))
    return n.select("area", F.round(G.ring_area(F.col("ring")), 4).alias("size"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"), F.round(G.line_length(F.col("ring")), 6).alias("girth"))


@query("SELECT osm_id FROM x_buildings WHERE osm_id NOT IN (SELECT a.osm_id FROM x_buildings a JOIN x_buildings b ON a.osm_id<b.osm_id AND SQRT((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<150)")
def drop_close_points(v: Views) -> DataFrame:
    """One of each pair that is too close goes."""
    return spatial.drop_close(_points(v.x_buildings), 150.0).select(F.col("id").alias("osm_id"))


@query("SELECT osm_id, area FROM (SELECT osm_id, n_nationkey AS area FROM x_buildings b JOIN nation n ON b.x<=400*n_nationkey+500 AND b.x+100>=400*n_nationkey AND b.y<=5000 AND b.y>=3000)")
def way_in_area(v: Views) -> DataFrame:
    """Lines that meet an area's bounds."""
    ways = v.x_buildings.select("osm_id", F.array(G.point(F.col("x"), F.col("y")), G.point(F.col("x") + 100, F.col("y"))).alias("line"))
    boxes = v.nation.selectExpr("n_nationkey AS area", "400.0D * n_nationkey AS a", "3000.0D AS b", "400.0D * n_nationkey + 500 AS c", "5000.0D AS d")
    return spatial.lines_in_boxes(ways, boxes, 500.0).select("osm_id", "area")


_ROAD = """WITH p AS (SELECT osm_id, x, y, LEAST(1,GREATEST(0,x/6000))*6000 AS ax, LEAST(1,GREATEST(0,y/8000))*8000 AS fy FROM x_buildings),
d AS (SELECT osm_id, SQRT((x-ax)*(x-ax)+y*y) AS d1, ax, SQRT((x-6000)*(x-6000)+(y-fy)*(y-fy)) AS d2, fy FROM p)"""


def _road(v: Views) -> DataFrame:
    """One way: 6 km east, then 8 km north."""
    line = F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(6000), F.lit(0)), G.point(F.lit(6000), F.lit(8000)))
    return v.spark.range(1).select(F.lit(1).cast("long").alias("way_id"), F.lit(41).alias("clazz"), line.alias("line"))


@query(f"{_ROAD} SELECT osm_id, ROUND(LEAST(d1,d2),6) AS dist, ROUND(CASE WHEN d1<=d2 THEN ax ELSE 6000+fy END,6) AS m FROM d WHERE LEAST(d1,d2)<=2000 AND LEAST(d1,d2)>0.1e0")
def locate_point(v: Views) -> DataFrame:
    """Foot of a point on the nearest way and its place along it."""
    met = spatial.nearest_way(_points(v.x_buildings), spatial.segments(_road(v)), 2000.0, 0.1)
    return met.select(F.col("id").alias("osm_id"), F.round("dist", 6).alias("dist"), F.round("m", 6).alias("m"))


@query(f"""{_ROAD}, c AS (SELECT DISTINCT CASE WHEN d1<=d2 THEN ax ELSE 6000+fy END AS m FROM d WHERE LEAST(d1,d2)<=400 AND LEAST(d1,d2)>0.1e0),
e AS (SELECT m FROM c WHERE m>0 AND m<14000 UNION SELECT 0 UNION SELECT 14000), o AS (SELECT m AS m0, LEAD(m) OVER (ORDER BY m) AS m1, ROW_NUMBER() OVER (ORDER BY m) AS part FROM e)
SELECT part, ROUND(CAST(m0 AS DOUBLE),6) AS m0, ROUND(CAST(m1-m0 AS DOUBLE),6) AS length FROM o WHERE m1 IS NOT NULL""")
def split_line(v: Views) -> DataFrame:
    """A way cut at the feet of its buildings; lengths add up to the way's."""
    segs = spatial.segments(_road(v))
    cuts = spatial.nearest_way(_points(v.x_buildings), segs, 400.0, 0.1).select("way_id", "m")
    parts = spatial.split_ways(segs, cuts)
    return parts.select(F.col("part").cast("long").alias("part"), F.round("m0", 6).alias("m0"), F.round(G.line_length(F.col("line")), 6).alias("length"))


@query(f"""{_ROAD}, n AS (SELECT osm_id, CASE WHEN d1<=d2 THEN ax ELSE 6000+fy END AS m, LEAST(d1,d2) AS dist FROM d WHERE LEAST(d1,d2)<=400 AND LEAST(d1,d2)>0.1e0)
SELECT 110 AS clazz, COUNT(*) AS ways, ROUND(SUM(dist),3) AS length FROM n UNION ALL SELECT 103, COUNT(DISTINCT CASE WHEN m>=0.1e0 AND m<=13999.9e0 THEN m END)+1, CAST(14000 AS DOUBLE) FROM n""")
def connect_buildings(v: Views) -> DataFrame:
    """Connection lines and cut street pieces by class."""
    out = spatial.connect(_points(v.x_buildings), _road(v), 400.0)
    return out.groupBy("clazz").agg(F.count("*").alias("ways"), F.round(F.sum(G.line_length(F.col("line"))), 3).alias("length"))


@query("""WITH h AS (SELECT n_nationkey AS id, CAST(100*n_nationkey+50 AS DOUBLE) AS y, CAST(60*n_nationkey AS DOUBLE) AS x0, CAST(1000+20*n_nationkey AS DOUBLE) AS x1 FROM nation),
w AS (SELECT 1000+n_nationkey AS id, CAST(100*n_nationkey+25 AS DOUBLE) AS x, CAST(30*n_nationkey AS DOUBLE) AS y0, CAST(2000-10*n_nationkey AS DOUBLE) AS y1 FROM nation),
c AS (SELECT h.id AS hid, w.id AS wid, w.x-h.x0 AS hm, h.x1-h.x0 AS hl, h.y-w.y0 AS wm, w.y1-w.y0 AS wl FROM h JOIN w ON w.x BETWEEN h.x0 AND h.x1 AND h.y BETWEEN w.y0 AND w.y1)
SELECT hid AS way_id, ROUND(hm,6) AS m FROM c WHERE hm>0.01e0*hl AND hm<0.99e0*hl UNION SELECT wid, ROUND(wm,6) FROM c WHERE wm>0.01e0*wl AND wm<0.99e0*wl""")
def way_crossings(v: Views) -> DataFrame:
    """Places where ways cross, all pairs at once."""
    h = v.nation.select(F.col("n_nationkey").cast("long").alias("way_id"), F.array(G.point(F.expr("60 * n_nationkey"), F.expr("100 * n_nationkey + 50")), G.point(F.expr("1000 + 20 * n_nationkey"), F.expr("100 * n_nationkey + 50"))).alias("line"))
    w = v.nation.select((F.col("n_nationkey") + 1000).cast("long").alias("way_id"), F.array(G.point(F.expr("100 * n_nationkey + 25"), F.expr("30 * n_nationkey")), G.point(F.expr("100 * n_nationkey + 25"), F.expr("2000 - 10 * n_nationkey"))).alias("line"))
    return spatial.crossings(spatial.segments(h.unionByName(w)), 500.0)


@query("SELECT osm_id, x, y FROM x_buildings")
def wkt_round_trip(v: Views) -> DataFrame:
    """Lines as text and back, with their ends."""
    line = G.make_line(G.point(F.col("x"), F.col("y")), G.point(F.col("x") + 1, F.col("y") - 1))
    t = v.x_buildings.select("osm_id", G.line_of_wkt(G.wkt_line(line)).alias("line"))
    return t.select("osm_id", G.start_point(F.col("line"))["x"].alias("x"), (G.end_point(F.col("line"))["y"] + 1).alias("y"))


@query("""WITH j AS (SELECT p.osm_id AS id, t.transformer_rated_power, ROW_NUMBER() OVER (PARTITION BY p.osm_id ORDER BY POWER(p.x+0.25e0-t.x,2)+POWER(p.y-t.y,2), t.osm_id) AS r FROM x_transformers p JOIN x_transformers t ON POWER(p.x+0.25e0-t.x,2)+POWER(p.y-t.y,2)<=1 WHERE t.transformer_rated_power IS NOT NULL)
SELECT id, transformer_rated_power FROM j WHERE r=1""")
def existing_capacity(v: Views) -> DataFrame:
    """Rated power of a known transformer at a cluster's place."""
    places = v.x_transformers.select(F.col("osm_id").alias("id"), (F.col("x") + 0.25).alias("x"), "y")
    known = v.x_transformers.select(F.col("osm_id").alias("id"), "x", "y", "transformer_rated_power")
    return spatial.capacity_near(places, known)


@query("SELECT plz, MIN(x) AS x_min, MIN(y) AS y_min, MAX(x) AS x_max, MAX(y) AS y_max FROM x_buildings GROUP BY plz")
def area_bounds(v: Views) -> DataFrame:
    """Bounds of a postcode for the map view."""
    return v.x_buildings.groupBy("plz").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))
