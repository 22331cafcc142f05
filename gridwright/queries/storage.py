"""Documents, files, stored tables and registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators import network
from gridwright.queries.registry import Views, query


@query("SELECT l_orderkey AS g, l_linenumber AS line_id, COUNT(*) AS n, ROUND(SUM(CAST(l_quantity AS DOUBLE)),6) AS km FROM lineitem GROUP BY 1,2")
def json_net_roundtrip(v: Views) -> DataFrame:
    """Networks stored as one document per grid and read back."""
    line = v.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("line_id"), F.col("l_quantity").cast("double").alias("km"))
    bus = line.select("g", F.col("line_id").alias("bus")).distinct()
    docs = network.as_document({"line": line, "bus": bus}, ["g"])
    return network.from_document(docs, ["g"], "line", "line_id: int, km: double").groupBy("g", "line_id").agg(F.count("*").alias("n"), F.round(F.sum("km"), 6).alias("km"))


@query("SELECT n_nationkey AS k, CASE n_nationkey%3 WHEN 0 THEN '0' WHEN 1 THEN CAST(i AS VARCHAR) ELSE 'net' || i END AS place, CAST(n_nationkey*10+i AS INT) AS id FROM nation, range(0,2) t(i) WHERE n_nationkey%3<>0 OR i=0")
def nets_from_json(v: Views) -> DataFrame:
    """Nets in a document: one, a list, or a map of them."""
    k = F.col("n_nationkey")
    one = lambda i: F.concat(F.lit('{"id": '), (k * 10 + i).cast("string"), F.lit("}"))
    doc = F.when(k % 3 == 0, one(0)).when(k % 3 == 1, F.concat(F.lit("["), one(0), F.lit(","), one(1), F.lit("]"))).otherwise(F.concat(F.lit('{"net0": '), one(0), F.lit(', "net1": '), one(1), F.lit("}")))
    return network.nets_of_json(v.nation.select(k.alias("k"), doc.alias("doc")), "doc", "id int").select("k", "place", F.col("net.id").alias("id"))


@query("SELECT CAST(osm_id AS VARCHAR) AS id, x, y, type AS use, x+1 AS east FROM x_buildings")
def geojson_features(v: Views) -> DataFrame:
    """Features of collections, one for each postcode, with their places and properties; points and outlines alike."""
    from gridwright.sources.files import features, lines_of

    near = F.array(F.array(F.col("x"), F.col("y")), F.array(F.col("x") + 1, F.col("y")), F.array(F.col("x"), F.col("y")))
    point = F.struct(F.lit("Point").alias("type"), F.to_json(F.array("x", "y")).alias("coordinates"))
    area = F.struct(F.lit("Polygon").alias("type"), F.to_json(F.array(near)).alias("coordinates"))
    geometry = F.when(F.col("osm_id") % 2 == 0, point).otherwise(area)
    text = F.concat(F.lit('{"type":"Feature","id":"'), F.col("osm_id").cast("string"), F.lit('","geometry":{"type":"'), geometry["type"], F.lit('","coordinates":'), geometry["coordinates"], F.lit('},"properties":{"use":"'), F.col("type"), F.lit('"}}'))
    docs = v.x_buildings.groupBy("plz").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list(text)), F.lit("]}")).alias("doc"))
    out = features(docs, "doc").withColumn("line", lines_of(F.col("coordinates"), F.col("geom_type"))[0])
    east = F.when(F.size("line") > 1, F.col("line")[1]["x"]).otherwise(F.col("line")[0]["x"] + 1)
    return out.select("id", F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"), F.element_at("properties", "use").alias("use"), east.alias("east"))


@query("SELECT 'node/' || osm_id AS id, x, y, type AS power, CASE WHEN osm_id%3=0 THEN CAST(area AS VARCHAR) END AS area FROM x_buildings")
def osm_documents(v: Views) -> DataFrame:
    """Elements of OSM documents, one for each postcode, with flat tags."""
    from gridwright.sources.files import osm_features

    tags = F.map_filter(F.create_map(F.lit("power"), F.col("type"), F.lit("area"), F.when(F.col("osm_id") % 3 == 0, F.col("area").cast("string"))), lambda _, x: x.isNotNull())
    e = F.struct(F.lit("node").alias("type"), F.col("osm_id").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon"), tags.alias("tags"))
    docs = v.x_buildings.groupBy("plz").agg(F.to_json(F.struct(F.collect_list(e).alias("elements"))).alias("doc"))
    return osm_features(docs, "doc").select("id", "x", "y", F.try_element_at("tags", F.lit("power")).alias("power"), F.try_element_at("tags", F.lit("area")).alias("area"))


@query("SELECT n_nationkey AS postcode_id, n_name AS note FROM nation WHERE n_regionkey=2")
def in_code_rows(v: Views) -> DataFrame:
    """Rows written in code and put in place of others."""
    from gridwright.operators.dml import upsert

    rows = v.nation.where("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("postcode_id"), F.col("n_name").alias("note"))
    return upsert(rows.withColumn("note", F.lit("old")), rows, ["postcode_id"])


@query("SELECT l.grid_result_id, l.name, g.plz, e.kva FROM (SELECT s_suppkey%20 AS grid_result_id, 'L' || s_suppkey AS name FROM supplier) l JOIN (SELECT n_nationkey AS grid_result_id, n_regionkey AS plz, CASE WHEN n_nationkey%4=0 THEN 'Tr_250' WHEN n_nationkey%4=1 THEN 'Tr_400' END AS tr FROM nation) g ON g.grid_result_id=l.grid_result_id LEFT JOIN (VALUES ('Tr_250',250),('Tr_400',400)) AS e(name,kva) ON e.name=g.tr")
def with_grid_views(v: Views) -> DataFrame:
    """Result rows with their grid and its transformer type."""
    from gridwright.sources.sinks import with_grid

    rows = v.supplier.select(F.expr("s_suppkey % 20").alias("grid_result_id"), F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("name"))
    grids = v.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS grid_result_id", "'1' AS version_id", "n_regionkey AS plz", "1 AS kcid", "1 AS bcid", "CASE WHEN n_nationkey % 4 = 0 THEN 'Tr_250' WHEN n_nationkey % 4 = 1 THEN 'Tr_400' END AS transformer_equipment_name")
    e = v.spark.createDataFrame([("1", "Tr_250", 250), ("1", "Tr_400", 400)], "version_id string, name string, kva int")
    return with_grid(rows, grids, e).select("grid_result_id", "name", "plz", "kva")


@query("SELECT osm_id, ROUND(kw*(0.07e0+0.93e0*POWER(4e0,-0.75)),6) AS sim FROM x_peaks WHERE kw>0")
def sql_functions(v: Views) -> DataFrame:
    """A registered function in SQL."""
    from gridwright.functions.registered import register
    from gridwright.queries.expressions import peaks

    register(v.spark)
    return peaks(v).where("kw > 0").select("osm_id", F.expr("round(sim_load(kw, CAST(4 AS DOUBLE), 0.07D), 6)").alias("sim"))


@query("SELECT o.osm_id, CAST(p AS INT) AS part, ROUND(CASE p WHEN 1 THEN 0.25e0 WHEN 2 THEN 0.5e0 ELSE 0.25e0 END*100,6) AS length FROM x_transformers o, range(1,4) t(p)")
def sql_table_function(v: Views) -> DataFrame:
    """A set-returning function in SQL."""
    from gridwright.functions.registered import register

    register(v.spark)
    t = v.x_transformers.select("osm_id")
    return v.spark.sql("SELECT t.osm_id, s.part, round(s.length, 6) AS length FROM {t} t, LATERAL split_way(array(0.0D, 60.0D, 60.0D), array(0.0D, 0.0D, 40.0D), array(0.75D, 0.25D, 0.25D)) s", t=t)


@query("SELECT CAST(user_id AS BIGINT) AS grid, COUNT(*) AS n, ROUND(SUM(value),4) AS total FROM events GROUP BY 1")
def streamed_totals(v: Views) -> DataFrame:
    """Sums of a stream of events, run to its end over the stored files (an addition; the batch rules above are the reference)."""
    from gridwright.streaming.totals import totals_of

    return totals_of(v.spark, v._folder).select(F.col("user_id").cast("long").alias("grid"), "n", F.round("total", 4).alias("total"))
