"""Files read back, joins and windows beyond the rules, and what the map and the exports need."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut, ensure_checkpoint_dir
from gridwright.functions import geometry as G
from gridwright.operators import spatial
from gridwright.queries.registry import Views, query


def _folder(v: Views) -> str:
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


def _without(v: Views, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` read from ``path``, which is deleted once they are cut off from it."""
    out = cut(rows)
    where = v.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return out


@query("SELECT c_custkey AS way_id, c_name AS note, CAST(c_acctbal AS DOUBLE) AS length FROM customer")
def csv_load(v: Views) -> DataFrame:
    """A CSV export read back under a schema, columns renamed."""
    from gridwright.sources import files, sinks

    path = _folder(v)
    sinks.to_csv(v.customer.selectExpr("c_custkey", "c_name", "cast(c_acctbal as double) AS c_acctbal"), path)
    return _without(v, path, files.csv(v.spark, path, "c_custkey long, c_name string, c_acctbal double", {"c_custkey": "way_id", "c_name": "note", "c_acctbal": "length"}))


@query("SELECT CAST(osm_id AS INT) AS osm_id, type AS use, area/4 AS qkm FROM x_buildings")
def excel_load(v: Views) -> DataFrame:
    """Workbooks, one for each postcode, written and read back by column names."""
    from gridwright.sources import workbooks

    path = _folder(v)
    rows = v.x_buildings.selectExpr("plz", "osm_id", "type AS use", "area / 4.0D AS qkm")
    workbooks.workbooks({"register": rows}, ["plz"]).write.parquet(path)
    return _without(v, path, workbooks.sheets(v.spark.read.parquet(path), {"osm_id": "int", "use": "string", "qkm": "double"}, "register"))


@query(r"SELECT CAST(c_custkey AS INT) AS way_id, CASE WHEN c_custkey%7=0 THEN NULL ELSE c_name || ' o''clock;' || CASE WHEN c_custkey%3=0 THEN chr(13) || chr(10) ELSE chr(10) END || '-- (x), ''y' END AS note, CASE WHEN c_custkey%5>0 THEN CAST(c_acctbal AS DOUBLE) END AS length FROM customer")
def sql_dump_load(v: Views) -> DataFrame:
    """INSERT statements of a dump: literals with line ends and semicolons, several rows, named columns, comments."""
    from gridwright.sources import dumps

    path = _folder(v)
    end = F.when(F.col("c_custkey") % 3 == 0, "\r\n").otherwise("\n")
    note = F.when(F.col("c_custkey") % 7 == 0, "NULL").otherwise(F.concat(F.lit("'"), F.col("c_name"), F.lit(" o''clock;"), end, F.lit("-- (x), ''y'")))
    key, length = F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("double").cast("string")
    row = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("("), note, F.lit(", "), key, F.lit(")"))).otherwise(F.concat(F.lit("("), key, F.lit(","), end, note, F.lit(" , "), length, F.lit(")")))
    few = F.when(F.col("c_custkey") % 5 == 0, F.lit("INSERT INTO public.ways (note, way_id) VALUES ")).otherwise(F.lit("INSERT INTO ways VALUES "))
    rows = v.customer.select((F.col("c_custkey") / 4).cast("long").alias("k"), (F.col("c_custkey") % 5 == 0).alias("few"), few.alias("head"), row.alias("row"), "c_custkey", end.alias("end"))
    dump = rows.groupBy("k", "few").agg(F.first("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))), lambda r: r["row"]), ", ").alias("rows"), F.min("end").alias("end"))
    other = v.spark.createDataFrame([("CREATE TABLE ways (way_id int); -- it's new",), ("INSERT INTO ways_old VALUES (1, 'INSERT INTO ways VALUES (2)');",)], "value string")
    dump.select(F.concat("head", "rows", F.lit("; -- that's "), F.col("k").cast("string"), "end").alias("value")).unionByName(other).write.text(path)
    return _without(v, path, dumps.sql_dump(v.spark, path, "ways", "way_id int, note string, length double"))


@query("""WITH f AS (SELECT l_suppkey AS suppkey, CAST(l_quantity AS BIGINT) + CASE WHEN l_suppkey%50=7 AND l_linenumber=2 THEN 100 ELSE 0 END AS quantity, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem WHERE NOT (l_suppkey%50=7 AND l_linenumber=1)
UNION ALL SELECT l_suppkey, 1, 0e0 FROM lineitem WHERE l_suppkey%50=7 AND l_linenumber=3)
SELECT suppkey, COUNT(*) AS n, CAST(SUM(quantity) AS BIGINT) AS sum_quantity, MIN(quantity) AS min_quantity, MAX(quantity) AS max_quantity, MIN(price) AS min_price, MAX(price) AS max_price FROM f GROUP BY suppkey""")
def refreshed_totals(v: Views) -> DataFrame:
    """Totals of all suppliers' lines after the lines of some went, changed and came, from these changes alone."""
    from gridwright.operators.refresh import Store, Totals, refresh_totals

    rows = v.lineitem.selectExpr("l_suppkey AS suppkey", "l_linenumber AS line", "CAST(l_quantity AS BIGINT) AS quantity", "CAST(l_extendedprice AS DOUBLE) AS price")
    path, few = _folder(v), rows.where("suppkey % 50 = 7")
    gone = few.where("line IN (1, 2)").withColumn("sign", F.lit(-1))
    came = few.where("line = 2").withColumn("quantity", F.col("quantity") + 100).unionByName(few.where("line = 3").withColumns({"line": F.lit(100).cast(rows.schema["line"].dataType), "quantity": F.lit(1).cast("long"), "price": F.lit(0.0)}))
    totals = Totals(("suppkey",), ("quantity",), ("quantity", "price"))
    base = Store(v.spark, f"{path}/base", ["suppkey"]).write(rows)
    derived = Store(v.spark, f"{path}/totals", ["suppkey"]).write(totals.of(base.read()))
    refresh_totals(derived, totals, base, gone.unionByName(came.withColumn("sign", F.lit(1))))
    return _without(v, path, derived.read())


@query("""SELECT c_custkey AS custkey, o_orderkey AS orderkey, CASE WHEN c_custkey%40=3 THEN 'moved' ELSE c_mktsegment END AS segment FROM orders JOIN customer ON c_custkey=o_custkey WHERE c_custkey%40<>7 AND c_custkey%40<>9
UNION ALL SELECT c_custkey, -o_orderkey, CASE WHEN c_custkey%40=3 THEN 'moved' ELSE c_mktsegment END FROM orders JOIN customer ON c_custkey=o_custkey WHERE c_custkey%40 IN (3, 4)""")
def refreshed_view(v: Views) -> DataFrame:
    """Orders with their customer's segment after some customers moved and went and some orders went and came, from these changes alone."""
    from gridwright.operators.refresh import Store, refresh_joined

    path = _folder(v)
    orders, customers = v.orders.selectExpr("o_custkey AS custkey", "o_orderkey AS orderkey"), v.customer.selectExpr("c_custkey AS custkey", "c_mktsegment AS segment")
    stores = [Store(v.spark, f"{path}/{name}", ["custkey"]).write(rows) for name, rows in (("orders", orders), ("customers", customers), ("view", orders.join(customers, "custkey").select("custkey", "orderkey", "segment")))]
    signed = lambda rows, sign: rows.withColumn("sign", F.lit(sign))
    went = signed(orders.where("custkey % 40 = 9"), -1).unionByName(signed(orders.where("custkey % 40 IN (3, 4)").withColumn("orderkey", -F.col("orderkey")), 1))
    moved = signed(customers.where("custkey % 40 IN (3, 7)"), -1).unionByName(signed(customers.where("custkey % 40 = 3").withColumn("segment", F.lit("moved")), 1))
    refresh_joined(stores[2], stores[0], stores[1], went, moved)
    return _without(v, path, stores[2].read())


@query("SELECT o.o_orderkey, CAST(e.n AS BIGINT) AS n FROM orders o FULL OUTER JOIN (SELECT l_orderkey+3 AS k, COUNT(*) AS n FROM lineitem GROUP BY 1) e ON e.k=o.o_orderkey")
def full_outer_join(v: Views) -> DataFrame:
    """A full outer join, which Spark adds for free."""
    e = v.lineitem.groupBy((F.col("l_orderkey") + 3).alias("k")).agg(F.count("*").alias("n"))
    return v.orders.join(e, F.col("k") == F.col("o_orderkey"), "full").select("o_orderkey", "n")


@query("SELECT event_id, user_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id FROM events")
def window_frames(v: Views) -> DataFrame:
    """Neighbours and firsts of a window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return v.events.select("event_id", "user_id", F.lag("value").over(w).alias("before"), F.first("event_id").over(w).alias("first_id"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS construction_year FROM orders")
def year_texts(v: Views) -> DataFrame:
    """Years as texts."""
    return v.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("construction_year"))


@query("SELECT osm_id, ROUND(CASE WHEN ATAN2(5000-x,5000-y)<0 THEN ATAN2(5000-x,5000-y)+2*PI() ELSE ATAN2(5000-x,5000-y) END,9) AS azimuth FROM x_buildings")
def azimuths(v: Views) -> DataFrame:
    """Direction to a point."""
    return v.x_buildings.select("osm_id", F.round(G.azimuth(F.col("x"), F.col("y"), F.lit(5000.0), F.lit(5000.0)), 9).alias("azimuth"))


@query("""WITH w AS (SELECT n_nationkey AS way_id, CAST(400*n_nationkey AS DOUBLE) AS wx FROM nation WHERE n_nationkey%5<>4),
m AS (SELECT b.osm_id, w.way_id, ROW_NUMBER() OVER (PARTITION BY b.osm_id ORDER BY ABS(b.x-w.wx), w.way_id) AS r FROM x_buildings b CROSS JOIN w WHERE ABS(b.x-w.wx)<=500 AND ABS(b.x-w.wx)>0.1e0)
SELECT b.osm_id, COALESCE(a.way_id, m.way_id) AS way_id, a.way_id IS NOT NULL AS matched FROM x_buildings b LEFT JOIN w a ON b.osm_id%3=0 AND a.way_id=b.plz LEFT JOIN m ON m.osm_id=b.osm_id AND m.r=1 WHERE COALESCE(a.way_id, m.way_id) IS NOT NULL""")
def address_match(v: Views) -> DataFrame:
    """The way of a building's address, else the nearest one that is no connection line and not under the building."""
    x = F.expr("400.0D * n_nationkey")
    clazz = F.expr("CASE WHEN n_nationkey % 5 = 4 THEN 110 ELSE 41 END").alias("clazz")
    ways = v.nation.select(F.col("n_nationkey").alias("way_id"), F.col("n_nationkey").alias("address"), clazz, F.array(G.point(x, F.lit(0)), G.point(x, F.lit(10000))).alias("line"))
    p = v.x_buildings.select(F.col("osm_id").alias("id"), "x", "y", F.when(F.col("osm_id") % 3 == 0, F.col("plz")).alias("address"))
    return spatial.by_address(p, ways, 500.0).select(F.col("id").alias("osm_id"), "way_id", "matched")


@query("SELECT plz, MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1, TRUE AS convex FROM x_buildings GROUP BY plz")
def cluster_hulls(v: Views) -> DataFrame:
    """Convex hulls of postcodes: their bounds are those of the points, and no corner turns right."""
    h = spatial.convex_hulls(v.x_buildings.select("plz", "x", "y"), ["plz"])
    a, b, c, d = G.bounds(F.col("ring"))
    n = F.size("ring")
    p, q, r = F.slice("ring", 1, n - 2), F.slice("ring", 2, n - 2), F.slice("ring", 3, n - 2)
    turns = F.zip_with(F.arrays_zip(p.alias("p"), q.alias("q")), r, lambda s, t: (s["q"]["x"] - s["p"]["x"]) * (t["y"] - s["q"]["y"]) - (s["q"]["y"] - s["p"]["y"]) * (t["x"] - s["q"]["x"]))
    return h.select("plz", a.alias("x0"), c.alias("x1"), b.alias("y0"), d.alias("y1"), F.forall(turns, lambda t: t > 0).alias("convex"))


@query("""WITH n AS (SELECT 'region' AS t, COUNT(*) AS k FROM region UNION ALL SELECT 'nation', COUNT(*) FROM nation UNION ALL SELECT 'customer', COUNT(*) FROM customer UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
UNION ALL SELECT 'part', COUNT(*) FROM part UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem UNION ALL SELECT 'events', COUNT(*) FROM events)
SELECT table_name, column_name, CAST(ordinal_position AS INT) AS position, n.k AS table_rows FROM information_schema.columns JOIN n ON n.t=table_name WHERE column_name LIKE '%key'""")
def metadata_scan(v: Views) -> DataFrame:
    """Key columns of the catalogue's tables by a pattern of their names, with the tables' rows; the views live as long as the scan."""
    from gridwright.queries.registry import TABLES
    from gridwright.sources import sinks

    mark = f"_{uuid.uuid4().hex}"
    names = [t + mark for t in TABLES]
    sinks.views(v.spark, {t + mark: getattr(v, t) for t in TABLES})
    try:
        found = sinks.tables(v.spark, "default", f"[a-z]+{mark}")
        out = sinks.columns(v.spark, found)
        rows = cut(sinks.row_counts(v.spark, found))
    finally:
        sinks.drop_views(v.spark, names)
    out = out.where("column_name LIKE '%key'").join(rows, "table_name")
    return out.withColumn("table_name", F.expr(f"replace(table_name, '{mark}', '')"))


@query("""WITH l AS (SELECT DISTINCT plz, osm_id AS bus FROM x_transformers WHERE transformer_rated_power=630),
n AS (SELECT b.plz, t.osm_id AS bus, ROW_NUMBER() OVER (PARTITION BY b.osm_id ORDER BY SQRT(POWER(b.x-t.x,2)+POWER(b.y-t.y,2)), t.osm_id) AS r FROM x_buildings b JOIN x_transformers t ON t.plz=b.plz WHERE b.plz NOT IN (SELECT plz FROM l))
SELECT plz, bus FROM l UNION ALL SELECT DISTINCT plz, bus FROM n WHERE r=1""")
def real_grid_buildings(v: Views) -> DataFrame:
    """Consumer buses of measured grids: those with loads, else those nearest to the postcode's buildings."""
    from gridwright.operators.grid_metrics import consumer_buses

    loads = v.x_transformers.where("transformer_rated_power = 630").select("plz", F.col("osm_id").alias("bus"))
    place = lambda df: df.select("plz", F.col("osm_id").alias("id"), "x", "y")
    return consumer_buses(loads, place(v.x_buildings), place(v.x_transformers), ["plz"])


@query("""WITH r AS (SELECT plz, (osm_id*7)%40 AS x, (osm_id*11)%37 AS y, 1+osm_id%4 AS w, 1+osm_id%3 AS h FROM x_buildings),
c AS (SELECT DISTINCT plz, x+i AS cx, y+j AS cy FROM r, range(0,4) a(i), range(0,3) b(j) WHERE i<w AND j<h),
s AS (SELECT c.plz, c.cx, c.cy, COUNT(n.cx) AS k FROM c LEFT JOIN c n ON n.plz=c.plz AND ABS(n.cx-c.cx)+ABS(n.cy-c.cy)=1 GROUP BY 1,2,3)
SELECT plz, CAST(COUNT(*) AS DOUBLE) AS area, CAST(SUM(4-k) AS DOUBLE) AS outline FROM s GROUP BY plz""")
def dissolved_areas(v: Views) -> DataFrame:
    """The union of a postcode's building areas: what it covers and the length of its outline."""
    from gridwright.operators.areas import dissolved

    b = v.x_buildings.selectExpr("plz", "DOUBLE((osm_id * 7) % 40) AS x", "DOUBLE((osm_id * 11) % 37) AS y", "1 + osm_id % 4 AS w", "1 + osm_id % 3 AS h")
    corner = lambda i, j: G.point(F.col("x") + i * F.col("w"), F.col("y") + j * F.col("h"))
    rings = F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))
    out = dissolved(b.select("plz", rings.alias("rings")), ["plz"])
    length = F.aggregate("rings", F.lit(0.0), lambda acc, r: acc + G.line_length(r))
    return out.select("plz", F.round("area", 6).alias("area"), F.round(length, 6).alias("outline"))


@query("SELECT osm_id, type, CAST(plz AS VARCHAR) AS name, x, y, area FROM (SELECT osm_id, type, plz, x, y, 4.0e0 AS area FROM x_buildings)")
def shapefile_load(v: Views) -> DataFrame:
    """Building files with their attributes, a file for each postcode, written and read back as multi-polygons."""
    import pandas as pd

    from gridwright.sources import shapefiles

    def written(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        rows = [([[(x - 1, y - 1), (x - 1, y + 1), (x + 1, y + 1), (x + 1, y - 1), (x - 1, y - 1)]], {"osm_id": i, "use": t}) for i, t, x, y in p[["osm_id", "type", "x", "y"]].itertuples(index=False)]
        shp, dbf = shapefiles.write_shapes(shapefiles.POLYGON, rows, {"osm_id": 18, "use": 20})
        return pd.DataFrame([(str(key[0]), shp, dbf)], columns=["name", "shp", "dbf"])

    path = _folder(v)
    v.x_buildings.groupBy("plz").applyInPandas(written, "name string, shp binary, dbf binary").write.parquet(path)
    f = shapefiles.features(v.spark.read.parquet(path)).where("geom_type = 'MultiPolygon'").withColumn("ring", F.col("parts")[0])
    middle = G.ring_centroid(F.col("ring"))
    return _without(v, path, f.select(F.element_at("attributes", "osm_id").cast("long").alias("osm_id"), F.element_at("attributes", "use").alias("type"), "name", F.round(middle["x"], 6).alias("x"), F.round(middle["y"], 6).alias("y"), F.round(G.ring_area(F.col("ring")), 6).alias("area")))


@query(name="gis_layers")
def gis_layers(v: Views) -> DataFrame:
    """Lines of finished grids with the places of both ends, moved apart by branch."""
    from gridwright.queries.sizing import _plan

    plan = _plan(v)
    by, bus = plan["by"], plan["bus"]
    end = lambda p: bus.select(*by, F.col("bus").alias(f"{p}_bus"), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"))
    shift = 5e-6 * F.col("branch")
    out = plan["line"].join(end("from"), [*by, "from_bus"], "left").join(end("to"), [*by, "to_bus"])
    return out.select(*by, "name", "std_type", (F.col("from_x") + shift).alias("from_x"), (F.col("from_y") + shift).alias("from_y"), "to_x", "to_y")


@query("SELECT b.backend, COUNT(*) AS buses, TRUE AS agree FROM x_streets, (VALUES ('newton'),('sweep')) AS b(backend) GROUP BY 1")
def power_flow_backends(v: Views) -> DataFrame:
    """All registered power-flow functions over the same radial grids: they agree on every voltage."""
    from gridwright.operators.network import BACKENDS, backend
    from gridwright.queries.sizing import street_grids

    lines, loads, roots = street_grids(v)
    flows = [backend(n)(lines, loads, roots, ["plz"], reactive=True).select("plz", "bus", F.lit(n).alias("backend"), "vm_pu", "converged") for n in BACKENDS]
    rows = flows[0]
    for f in flows[1:]:
        rows = rows.unionByName(f)
    spread = Window.partitionBy("plz", "bus")
    rows = rows.withColumn("__gap", F.max("vm_pu").over(spread) - F.min("vm_pu").over(spread))
    return rows.groupBy("backend").agg(F.count("*").alias("buses"), F.bool_and((F.col("__gap") < 1e-6) & F.col("converged")).alias("agree"))
