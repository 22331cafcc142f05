"""Readers: CSV, GeoJSON, network documents, registers, OSM documents, and JDBC for outside stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "array<struct<type: string, id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"


def csv(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """Rows of CSV files with a header under a given schema; columns renamed."""
    out = spark.read.csv(path, schema=schema, header=True, sep=sep)
    return out.withColumnsRenamed(rename or {})


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, geom_type, coordinates (JSON), properties for each feature of feature collections."""
    docs = spark.read.text(path, wholetext=True)
    return features(docs, "value")


def features(docs: DataFrame, doc: str) -> DataFrame:
    """Features of collections held in a column."""
    listed = F.from_json(F.get_json_object(F.col(doc), "$.features"), _FEATURE)
    return docs.select(F.explode(listed).alias("f")).select(F.coalesce(F.col("f.id"), F.element_at(F.col("f.properties"), "id")).alias("id"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def lines_of(coordinates: Column, geom_type: Column) -> Column:
    """array<array<struct<x, y>>>: parts of a Point, MultiPoint, LineString, Polygon or MultiPolygon, single ones promoted."""
    as_point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    depth1 = F.from_json(coordinates, "array<double>")
    depth2 = F.from_json(coordinates, "array<array<double>>")
    depth3 = F.from_json(coordinates, "array<array<array<double>>>")
    depth4 = F.from_json(coordinates, "array<array<array<array<double>>>>")
    rings = lambda r: F.transform(r, lambda q: F.transform(q, as_point))
    return (
        F.when(geom_type == "Point", F.array(F.array(as_point(depth1))))
        .when(geom_type.isin("MultiPoint", "LineString"), F.array(F.transform(depth2, as_point)))
        .when(geom_type.isin("Polygon", "MultiLineString"), rings(depth3))
        .when(geom_type == "MultiPolygon", rings(F.flatten(depth4)))
    )


def osm_features(docs: DataFrame, doc: str) -> DataFrame:
    """id, type, x, y, tags of the elements of OSM documents; tags lie flat beside the element's own fields."""
    element = "array<struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    listed = F.from_json(F.get_json_object(F.col(doc), "$.elements"), element)
    e = docs.select(F.explode(listed).alias("e"))
    own = F.create_map(F.lit("type"), F.col("e.type"), F.lit("id"), F.col("e.id").cast("string"))
    tags = F.map_filter(F.coalesce("e.tags", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("type", "id"))
    return e.select(F.concat(F.col("e.type"), F.lit("/"), F.col("e.id").cast("string")).alias("id"), F.col("e.type").alias("type"), F.coalesce("e.lon", "e.center.lon").alias("x"), F.coalesce("e.lat", "e.center.lat").alias("y"), F.map_concat(own, tags).alias("tags"))


def nets(spark: SparkSession, path: str, schema: str, glob: str = "LV_*.json") -> DataFrame:
    """name (file stem), place, net of network documents: one net, a list, or a map of nets in a file."""
    from gridwright.operators.network import nets_of_json

    docs = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    named = docs.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), F.col("value").alias("doc"))
    return nets_of_json(named, "doc", schema)


def shape_route(path: Column) -> Column:
    """Table of a building file by its name: 'res', 'oth', or null."""
    return F.when(path.contains("Res"), "res").when(path.contains("Oth"), "oth")


def files_of(spark: SparkSession, path: str, codes: list[int], glob: str = "*") -> DataFrame:
    """path, code, table of files whose name holds one of the municipality codes (S10). Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    wanted = F.explode(F.array(*map(F.lit, codes)))
    out = found.withColumn("code", wanted).where(F.element_at(F.split("path", "/"), -1).contains(F.col("code").cast("string")))
    return out.withColumn("table", shape_route(F.element_at(F.split("path", "/"), -1)))


def register(population: DataFrame, assignment: DataFrame, regions: DataFrame) -> DataFrame:
    """The municipal register: postcode x population x municipality x region class, with density."""
    out = assignment.join(population, "plz").join(regions.drop("pop", "area"), "ags")
    return out.withColumn("pop_den", F.col("pop") / F.col("area"))


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, parts: int = 8, **options) -> DataFrame:
    """A query of an outside store; filters on the result are pushed down to it.

    With ``column``, a number of the query's result, it is read in ``parts`` tasks by even ranges between its least and largest value,
    which are asked for first; rows without a value come with the first range.
    """
    if column is None:
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()
    ends = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM ({query}) q", **options).load().first()
    if ends[0] is None:
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()
    low, high = int(ends[0]), int(ends[1]) + 1
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=max(1, min(parts, high - low)), **options).load()


def transformer_sites(sites: DataFrame, covering: DataFrame, shops: DataFrame, least_area: float = 60.0, most_volts: float = 110000.0, apart: float = 8.0) -> DataFrame:
    """Substations that may feed a low-voltage grid: id, x, y, area, voltage, is_point.

    Points inside a mapped polygon (covering: area, ring) go, as do polygons below ``least_area`` and
    sites of ``most_volts`` or more (a missing voltage counts as 1, one that is no number is kept). Of
    two sites closer than ``apart`` the one with the smaller id goes. within_shopping marks those in shops.
    """
    from gridwright.operators.spatial import contained, drop_close

    volts = F.when(F.col("voltage").isNull(), 1.0).otherwise(F.col("voltage").try_cast("double"))
    s = sites.withColumn("__v", volts).where(F.col("__v").isNull() | (F.col("__v") < most_volts)).drop("__v")
    s = s.where(F.col("is_point") | (F.col("area") >= least_area))
    inside = contained(s.where("is_point").select("id", "x", "y"), covering, 200.0).select("id").distinct()
    s = drop_close(s.join(inside, "id", "left_anti"), apart)
    shop = contained(s.select("id", "x", "y"), shops, 1000.0).select("id").distinct().withColumn("within_shopping", F.lit(True))
    return s.join(shop, "id", "left").withColumn("within_shopping", F.coalesce("within_shopping", F.lit(False)))

