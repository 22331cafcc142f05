"""Scans, joins, aggregations, windows, sorts and set operations on the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions import electrical as E
from gridwright.functions.hashing import digits
from gridwright.operators import dml, scans
from gridwright.operators.groups import spread_join
from gridwright.operators.quantiles import quantiles
from gridwright.queries.expressions import by_category, peaks
from gridwright.queries.registry import Views, query


# --- scans -------------------------------------------------------------------------------------
@query("SELECT * FROM x_buildings WHERE plz=7 AND type='SFH'")
def eq_geo_filter(v: Views) -> DataFrame:
    """Scan by equal values."""
    return scans.equals(v.x_buildings, plz=7, type="SFH")


@query("SELECT b.osm_id, plz, c.definition, c.sim_factor FROM x_buildings b JOIN (SELECT definition, sim_factor, definition AS type FROM x_categories) c USING (type) WHERE plz=3")
def eq_geo_join(v: Views) -> DataFrame:
    """Joined scan with filters."""
    return scans.joined(v.x_buildings, v.x_categories.withColumn("type", F.col("definition")), ["type"], ["osm_id", "plz", "definition", "sim_factor"], plz=3)


@query("SELECT c_custkey AS id, COALESCE(c_mktsegment, 'none') AS kind, c_nationkey AS postcode FROM customer WHERE c_mktsegment IN ('BUILDING','HOUSEHOLD') AND c_nationkey=5")
def building_scan(v: Views) -> DataFrame:
    """Building scan of an outside store."""
    return v.customer.where("c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey = 5").select(F.col("c_custkey").alias("id"), F.coalesce("c_mktsegment", F.lit("none")).alias("kind"), F.col("c_nationkey").alias("postcode"))


@query("SELECT DISTINCT plz FROM x_buildings ORDER BY plz")
def postcode_scan(v: Views) -> DataFrame:
    """All postcodes in order."""
    return v.x_buildings.select("plz").distinct().orderBy("plz")


@query("SELECT definition, sim_factor, COUNT(b.osm_id) AS buildings FROM x_categories c LEFT JOIN x_buildings b ON b.type=c.definition GROUP BY 1,2")
def small_keyed_reads(v: Views) -> DataFrame:
    """Categories by definition, read for all buildings that have them."""
    used = v.x_buildings.groupBy(F.col("type").alias("definition")).agg(F.count("*").alias("buildings"))
    return v.x_categories.join(used, "definition", "left").select("definition", "sim_factor", F.coalesce("buildings", F.lit(0)).alias("buildings"))


@query("SELECT s_suppkey AS osm_id, b.x, b.y FROM supplier s JOIN x_transformers b ON b.osm_id=s.s_suppkey")
def point_lookup(v: Views) -> DataFrame:
    """Coordinates of many vertices in one join."""
    wanted = v.supplier.select(F.col("s_suppkey").alias("osm_id"))
    return wanted.join(v.x_transformers, "osm_id").select("osm_id", "x", "y")


@query("SELECT r.plz, r.ags, r.regio7 FROM x_register r JOIN (SELECT 3 AS ags UNION ALL SELECT 11) w USING (ags)")
def region_resolution(v: Views) -> DataFrame:
    """Postcodes of municipality codes."""
    wanted = v.spark.createDataFrame([(3,), (11,), (11,), (99,)], "ags int")
    found, _ = scans.resolve_regions(v.x_register, wanted, "ags")
    return found.select("plz", "ags", "regio7")


@query("SELECT CAST(99 AS INT) AS ags")
def missing_regions(v: Views) -> DataFrame:
    """Codes without a register row."""
    wanted = v.spark.createDataFrame([(3,), (99,)], "ags int")
    return scans.resolve_regions(v.x_register, wanted, "ags")[1]


# --- joins -------------------------------------------------------------------------------------
@query("SELECT b.osm_id, b.plz, t.osm_id AS trafo FROM x_buildings b JOIN x_transformers t ON b.plz=t.plz AND b.osm_id%3=t.osm_id%3")
def join_inner_composite(v: Views) -> DataFrame:
    """Inner join on several keys."""
    t = v.x_transformers.selectExpr("osm_id AS trafo", "plz", "osm_id % 3 AS k")
    return spread_join(v.x_buildings.select("osm_id", "plz", F.expr("osm_id % 3").alias("k")), t, ["plz", "k"]).select("osm_id", "plz", "trafo")


@query("SELECT b.osm_id, c.sim_factor FROM x_buildings b LEFT JOIN (SELECT *, 4 AS plz FROM x_categories WHERE definition<>'TH') c ON b.type=c.definition AND b.plz=c.plz")
def join_left_two_key(v: Views) -> DataFrame:
    """Left join on two keys."""
    c = v.x_categories.where("definition <> 'TH'").selectExpr("definition AS type", "sim_factor", "4 AS plz")
    return v.x_buildings.join(F.broadcast(c), ["type", "plz"], "left").select("osm_id", "sim_factor")


@query("SELECT b.osm_id, CAST(b.plz AS BIGINT) AS plz, t.pos FROM (SELECT osm_id AS pos, plz FROM x_transformers WHERE transformer_rated_power=630) t RIGHT JOIN x_buildings b ON t.plz=b.plz")
def join_right_params(v: Views) -> DataFrame:
    """Right join that keeps every grid."""
    t = v.x_transformers.where("transformer_rated_power = 630").selectExpr("osm_id AS pos", "plz")
    return spread_join(v.x_buildings.select("osm_id", "plz"), t, ["plz"], "left").select("osm_id", F.col("plz").cast("long").alias("plz"), "pos")


@query("SELECT r.plz, r.ags, m.regio7, ROUND(m.pop/m.area,6) AS pop_den, n.n_name AS name_city FROM x_register r JOIN x_municipal m ON r.plz=m.plz JOIN nation n ON n.n_nationkey=r.ags")
def join_chain_register(v: Views) -> DataFrame:
    """Register chain: postcode x municipality x region."""
    m = v.x_municipal.select("plz", "regio7", F.round(F.col("pop") / F.col("area"), 6).alias("pop_den"))
    return v.x_register.select("plz", "ags").join(m, "plz").join(v.nation.selectExpr("n_nationkey AS ags", "n_name AS name_city"), "ags").select("plz", "ags", "regio7", "pop_den", "name_city")


@query("SELECT DISTINCT plz FROM x_buildings WHERE plz IN (SELECT plz FROM x_loads WHERE homes>60)")
def semi_large_buildings(v: Views) -> DataFrame:
    """Postcodes with a very large building."""
    return v.x_buildings.select("plz").distinct().join(peaks(v).where("homes > 60"), "plz", "left_semi")


@query("SELECT MIN(plz) AS kcid FROM x_buildings WHERE plz NOT IN (SELECT plz FROM x_transformers WHERE transformer_rated_power=250)")
def anti_unfinished(v: Views) -> DataFrame:
    """Next cluster without a result."""
    return scans.first_unfinished(v.x_buildings.select(F.col("plz").alias("kcid")), v.x_transformers.where("transformer_rated_power = 250").select(F.col("plz").alias("kcid")))


@query("SELECT DISTINCT plz, plz IN (SELECT plz FROM x_transformers WHERE transformer_rated_power=250) AS generated FROM x_buildings")
def exists_flag(v: Views) -> DataFrame:
    """Whether a postcode was generated."""
    return scans.flagged(v.x_buildings.select("plz").distinct(), v.x_transformers.where("transformer_rated_power = 250"), ["plz"], "generated")


@query("SELECT b.osm_id, ROUND(b.area/t.total,9) AS share FROM x_buildings b CROSS JOIN (SELECT SUM(area) AS total FROM x_buildings) t")
def cross_join_one_row(v: Views) -> DataFrame:
    """Join with a one-row relation."""
    total = v.x_buildings.agg(F.sum("area").alias("total"))
    return v.x_buildings.crossJoin(F.broadcast(total)).select("osm_id", F.round(F.col("area") / F.col("total"), 9).alias("share"))


@query("SELECT a.osm_id, b.osm_id AS trafo FROM x_buildings a JOIN (SELECT osm_id, x+0.0000001e0 AS x, y FROM x_buildings) b ON ROUND(a.x,3)=ROUND(b.x,3) AND ROUND(a.y,3)=ROUND(b.y,3)")
def snapped_equality_join(v: Views) -> DataFrame:
    """Points that coincide on a millimetre grid."""
    from gridwright.operators.spatial import snap_join

    other = v.x_buildings.select(F.col("osm_id").alias("trafo"), (F.col("x") + 1e-7).alias("x"), "y")
    return snap_join(v.x_buildings.select("osm_id", "x", "y"), other).select("osm_id", "trafo")


@query("SELECT p_partkey AS bus, p_brand AS name, x.f2 AS geo FROM part LEFT JOIN (SELECT grid_result_id, f2 FROM x_features WHERE grid_result_id%2=0) x ON x.grid_result_id=p_partkey")
def join_bus_geodata(v: Views) -> DataFrame:
    """Element tables with their geodata, by index."""
    geo = v.x_features.where("grid_result_id % 2 = 0").select(F.col("grid_result_id").alias("bus"), F.col("f2").alias("geo"))
    return v.part.select(F.col("p_partkey").alias("bus"), F.col("p_brand").alias("name")).join(geo, "bus", "left")


@query("SELECT type AS zone, osm_id%50 AS bus, COUNT(*) AS n, ROUND(SUM(kw),6) AS kw, COALESCE(MIN(sim_factor),1.0) AS factor FROM x_peaks GROUP BY 1,2")
def load_zone_merge(v: Views) -> DataFrame:
    """Loads per bus and zone with the zone's factor."""
    per = peaks(v).groupBy(F.col("type").alias("zone"), F.expr("osm_id % 50").alias("bus")).agg(F.count("*").alias("n"), F.round(F.sum("kw"), 6).alias("kw"))
    return per.join(F.broadcast(v.x_categories.selectExpr("definition AS zone", "sim_factor")), "zone", "left").select("zone", "bus", "n", "kw", F.coalesce("sim_factor", F.lit(1.0)).alias("factor"))


# --- aggregations ------------------------------------------------------------------------------
@query("SELECT plz, ROUND(AVG(homes) FILTER (WHERE homes>0),6) AS mean_homes, COUNT(*) AS n, COUNT(DISTINCT type) AS types FROM x_loads GROUP BY plz")
def household_average(v: Views) -> DataFrame:
    """Mean with a filter, counts and distinct counts."""
    return peaks(v).groupBy("plz").agg(F.round(F.avg(F.when(F.col("homes") > 0, F.col("homes"))), 6).alias("mean_homes"), F.count("*").alias("n"), F.countDistinct("type").alias("types"))


@query("SELECT plz, osm_id%20 AS connection_point, ROUND(SUM(kw),6) AS kw FROM x_peaks GROUP BY 1,2 ORDER BY 1,2")
def load_per_connection_point(v: Views) -> DataFrame:
    """Load of each connection point, in order."""
    return peaks(v).groupBy("plz", F.expr("osm_id % 20").alias("connection_point")).agg(F.round(F.sum("kw"), 6).alias("kw")).orderBy("plz", "connection_point")


@query("""WITH s AS (SELECT plz, CASE WHEN type IN ('SFH','MFH','TH','AB') THEN 'Residential' ELSE type END AS category, SUM(kw) AS p, SUM(homes) AS n, MIN(sim_factor) AS g FROM x_peaks GROUP BY 1,2)
SELECT plz, category, ROUND(CASE WHEN p<=0 OR n<=0 THEN 0 ELSE p*(g+(1-g)*POWER(CAST(n AS DOUBLE),-0.75)) END,6) AS sim FROM s""")
def sim_load_by_category(v: Views) -> DataFrame:
    """Simultaneous load of main categories."""
    return by_category(peaks(v), "plz").select("plz", "category", F.round("sim", 6).alias("sim"))


@query("""WITH c AS (SELECT *, CASE WHEN type IN ('SFH','MFH','TH','AB') THEN 'Residential' ELSE type END AS category, CASE WHEN kw<=0 OR homes<=0 THEN 0 ELSE kw*(sim_factor+(1-sim_factor)*POWER(CAST(homes AS DOUBLE),-0.75)) END AS own FROM x_peaks),
g AS (SELECT plz, category, SUM(own) AS owns, CASE WHEN SUM(kw)<=0 OR SUM(homes)<=0 THEN 0 ELSE SUM(kw)*(MIN(sim_factor)+(1-MIN(sim_factor))*POWER(CAST(SUM(homes) AS DOUBLE),-0.75)) END AS grouped FROM c GROUP BY 1,2)
SELECT c.plz, c.osm_id%40 AS vertice_id, ROUND(SUM(c.own*CASE WHEN g.owns>0 THEN g.grouped/g.owns ELSE 0 END),6) AS sim, CAST(SUM(c.homes) AS BIGINT) AS units,
 CASE WHEN COUNT(DISTINCT c.type)=1 THEN MIN(c.type) WHEN COUNT(DISTINCT CASE WHEN c.type<>'SFH' THEN c.type END)=1 AND COUNT(DISTINCT c.type)=2 AND ARG_MAX(c.type,c.osm_id)<>'SFH' AND SUM(CASE WHEN c.type<>'SFH' AND c.osm_id<f.last_sfh THEN 1 ELSE 0 END)=0 THEN MAX(CASE WHEN c.type<>'SFH' THEN c.type END) ELSE 'Commercial' END AS load_type
FROM c JOIN g ON c.plz=g.plz AND c.category=g.category JOIN (SELECT plz, osm_id%40 AS vid, COALESCE(MAX(CASE WHEN type='SFH' THEN osm_id END),-1) AS last_sfh FROM x_buildings GROUP BY 1,2) f ON f.plz=c.plz AND f.vid=c.osm_id%40 GROUP BY 1,2""")
def load_allocation(v: Views) -> DataFrame:
    """Grouped load given back to vertices, and the vertex's type."""
    from gridwright.operators.loads import allocate

    b = peaks(v).withColumn("vertice_id", F.expr("osm_id % 40"))
    return allocate(b, ["plz"]).select("plz", "vertice_id", F.round("sim", 6).alias("sim"), "units", "load_type")


@query("SELECT plz, list_sort(list(DISTINCT osm_id%10)) AS points FROM x_buildings GROUP BY plz")
def distinct_array(v: Views) -> DataFrame:
    """Distinct vertex ids of a group."""
    return v.x_buildings.groupBy("plz").agg(F.array_sort(F.collect_set(F.expr("osm_id % 10"))).alias("points"))


@query("SELECT plz, list(osm_id ORDER BY x, osm_id) AS ordered FROM x_buildings GROUP BY plz")
def ordered_split_points(v: Views) -> DataFrame:
    """Points of a group in the order of their place on a line."""
    return v.x_buildings.groupBy("plz").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "osm_id"))), lambda p: p["osm_id"]).alias("ordered"))


@query("SELECT x, COUNT(*) AS n FROM (SELECT x%50 AS x FROM x_buildings) GROUP BY x HAVING COUNT(*)>25")
def duplicate_geometries(v: Views) -> DataFrame:
    """Coordinates that occur too often."""
    return v.x_buildings.groupBy((F.col("x") % 50).alias("x")).agg(F.count("*").alias("n")).where("n > 25")


@query("SELECT MAX(osm_id)+1 AS next_id, COALESCE(MAX(osm_id) FILTER (WHERE plz=999),0) AS none FROM x_buildings")
def next_id(v: Views) -> DataFrame:
    """Next free id."""
    return v.x_buildings.agg((F.max("osm_id") + 1).alias("next_id"), F.coalesce(F.max(F.when(F.col("plz") == 999, F.col("osm_id"))), F.lit(0)).alias("none"))


@query("SELECT regio7, CAST(ROUND_EVEN(SUM(pop)*7.0e0/(SELECT SUM(pop) FROM x_register),0) AS INT) AS samples FROM x_register GROUP BY regio7")
def regio_quota(v: Views) -> DataFrame:
    """Samples of each region class by population, half to even."""
    from gridwright.operators.sampling import quotas

    return quotas(v.x_register, "regio7", "pop", 7)


@query("""WITH r AS (SELECT regio7, plz, pop_den, MIN(pop_den) OVER (PARTITION BY regio7) AS lo, MAX(pop_den) OVER (PARTITION BY regio7) AS hi, COUNT(*) OVER (PARTITION BY regio7) AS n FROM x_municipal),
b AS (SELECT regio7, LEAST(CAST(FLOOR((pop_den-lo)/(hi-lo)*CASE WHEN n<100 THEN 5 ELSE 10 END) AS INT), CASE WHEN n<100 THEN 4 ELSE 9 END) AS bin_no, n FROM r)
SELECT regio7, bin_no, COUNT(*) AS count, ROUND(COUNT(*)/CAST(MIN(n) AS DOUBLE),6) AS perc_bin FROM b GROUP BY 1,2""")
def density_bins(v: Views) -> DataFrame:
    """Equal-width density bins of each class."""
    from gridwright.operators.sampling import density_bins as bins

    b = bins(v.x_municipal, "regio7", "pop_den")
    return b.groupBy("regio7", "bin_no").agg(F.count("*").alias("count"), F.round(F.count("*") / F.min("class_rows"), 6).alias("perc_bin"))


@query("SELECT transformer_rated_power AS kva, COUNT(*) AS trafos, COUNT(DISTINCT plz) AS plz_count, list_sort(list(osm_id%9)) AS loads FROM x_transformers WHERE transformer_rated_power IS NOT NULL GROUP BY 1")
def capacity_histograms(v: Views) -> DataFrame:
    """Counts and lists for each transformer size."""
    t = v.x_transformers.where("transformer_rated_power is not null")
    return t.groupBy(F.col("transformer_rated_power").alias("kva")).agg(F.count("*").alias("trafos"), F.countDistinct("plz").alias("plz_count"), F.array_sort(F.collect_list(F.expr("osm_id % 9"))).alias("loads"))


@query("SELECT kva, list_sort(list(d)) AS distances FROM (SELECT transformer_rated_power AS kva, osm_id%13 AS d FROM x_transformers WHERE transformer_rated_power IS NOT NULL) GROUP BY kva ORDER BY kva DESC")
def capacity_lists_map(v: Views) -> DataFrame:
    """Lists by size as one JSON map and back, sizes in falling order."""
    from gridwright.operators.metrics import capacity_map, read_capacity_map

    t = v.x_transformers.where("transformer_rated_power is not null").selectExpr("1 AS g", "transformer_rated_power AS kva", "osm_id % 13 AS d")
    return read_capacity_map(capacity_map(t, ["g"], "kva", "d"), "doc").select("kva", F.col("vals").cast("array<bigint>").alias("distances")).orderBy(F.desc("kva"))


@query("SELECT std_type, ROUND(SUM(parallel*length_km),6) AS km FROM x_lines WHERE in_service GROUP BY 1")
def cable_length_by_type(v: Views) -> DataFrame:
    """Length of cables in service by type."""
    from gridwright.operators.metrics import cable_length

    return cable_length(v.x_lines, ["std_type"]).select("std_type", F.round("cable_length_km", 6).alias("km"))


@query("SELECT grid_result_id, ROUND(AVG(vm_pu),6) AS voltage_mean, ROUND(STDDEV_SAMP(vm_pu),6) AS voltage_std, MIN(vm_pu) AS voltage_min, MAX(vm_pu) AS voltage_max, COUNT(*) FILTER (WHERE vm_pu<0.9) AS voltage_violations_low, COUNT(*) FILTER (WHERE vm_pu>1.1) AS voltage_violations_high FROM x_voltage GROUP BY 1")
def loss_summary(v: Views) -> DataFrame:
    """Voltage metrics of a grid."""
    from gridwright.operators.reports import network_metrics

    m = network_metrics(v.x_voltage, "grid_result_id")
    return m.select("grid_result_id", F.round("voltage_mean", 6).alias("voltage_mean"), F.round("voltage_std", 6).alias("voltage_std"), "voltage_min", "voltage_max", "voltage_violations_low", "voltage_violations_high")


@query("SELECT ca, ROUND(QUANTILE_CONT(f2,0.25),6) AS q25, ROUND(QUANTILE_CONT(f2,0.75),6) AS q75, ROUND(QUANTILE_CONT(f2,0.75)-QUANTILE_CONT(f2,0.25),6) AS iqr FROM x_features GROUP BY ca")
def pooled_iqr(v: Views) -> DataFrame:
    """Exact quartiles."""
    q = quantiles(v.x_features, ["ca"], "f2", {"a": 0.25, "b": 0.75})
    return q.select("ca", F.round("a", 6).alias("q25"), F.round("b", 6).alias("q75"), F.round(F.col("b") - F.col("a"), 6).alias("iqr"))


@query("WITH c AS (SELECT ca, COALESCE(COUNT(*) FILTER (WHERE cb=0),0) AS c0, COUNT(*) FILTER (WHERE cb=1) AS c1, COUNT(*) FILTER (WHERE cb=2) AS c2, COUNT(*) FILTER (WHERE cb>2) AS c3 FROM x_features GROUP BY ca) SELECT ca, ROUND(c0/CAST(c0+c1+c2+c3 AS DOUBLE),6) AS s0, ROUND(c1/CAST(c0+c1+c2+c3 AS DOUBLE),6) AS s1, ROUND(c2/CAST(c0+c1+c2+c3 AS DOUBLE),6) AS s2, ROUND(c3/CAST(c0+c1+c2+c3 AS DOUBLE),6) AS s3 FROM c")
def cluster_pivot_share(v: Views) -> DataFrame:
    """Shares of clusters in each class by a pivot."""
    p = v.x_features.withColumn("k", F.least("cb", F.lit(3))).groupBy("ca").pivot("k", [0, 1, 2, 3]).count().fillna(0)
    total = F.col("0") + F.col("1") + F.col("2") + F.col("3")
    return p.select("ca", *[F.round(F.col(str(k)) / total, 6).alias(f"s{k}") for k in range(4)])


@query("SELECT ca, MIN(f1) AS f1_min, MAX(f1) AS f1_max, ROUND(AVG(f2),3) AS f2_mean FROM x_features GROUP BY ca")
def cluster_ranges(v: Views) -> DataFrame:
    """Range and rounded mean of a cluster's parameters."""
    return v.x_features.groupBy("ca").agg(F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max"), F.round(F.avg("f2"), 3).alias("f2_mean"))


@query("SELECT plz, COUNT(DISTINCT osm_id%200) AS points, COUNT(DISTINCT osm_id%200)*COUNT(DISTINCT osm_id%200)*8 AS matrix_bytes FROM x_buildings GROUP BY plz")
def matrix_preflight(v: Views) -> DataFrame:
    """Size of a cluster's distance matrix before it is built."""
    n = F.countDistinct(F.expr("osm_id % 200"))
    return v.x_buildings.groupBy("plz").agg(n.alias("points"), (n * n * 8).alias("matrix_bytes"))


# --- windows, sorts, sets ----------------------------------------------------------------------
@query("SELECT plz, type, osm_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY plz, type ORDER BY area DESC, osm_id) AS r FROM x_buildings) WHERE r=1")
def dedup_keep_first(v: Views) -> DataFrame:
    """One row of each key by an explicit order."""
    return dml.keep_first(v.x_buildings, ["plz", "type"], [F.desc("area"), "osm_id"]).select("plz", "type", "osm_id")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority LIKE '%URGENT%' OR o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*)>12))")
def dup_copy_filter(v: Views) -> DataFrame:
    """Rows without copies by name or by a repeated key."""
    often = v.orders.groupBy("o_custkey").count().where("count > 12")
    return dml.delete_where(v.orders, F.col("o_orderpriority").like("%URGENT%")).join(often, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT plz, osm_id, ROUND(area,3) AS area, r AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY plz ORDER BY area DESC, osm_id) AS r FROM x_buildings) WHERE r<=3")
def top_k_per_group(v: Views) -> DataFrame:
    """The k largest of a group."""
    w = Window.partitionBy("plz").orderBy(F.desc("area"), "osm_id")
    return v.x_buildings.withColumn("place", F.row_number().over(w)).where("place <= 3").select("plz", "osm_id", F.round("area", 3).alias("area"), "place")


@query("WITH m AS (SELECT plz, type, MIN(osm_id) AS least FROM x_buildings GROUP BY 1,2) SELECT plz, type, DENSE_RANK() OVER (PARTITION BY plz ORDER BY least) AS bcid FROM m")
def rank_renumber(v: Views) -> DataFrame:
    """Clusters numbered by their smallest vertex."""
    m = v.x_buildings.groupBy("plz", "type").agg(F.min("osm_id").alias("least"))
    return m.select("plz", "type", F.dense_rank().over(Window.partitionBy("plz").orderBy("least")).alias("bcid"))


@query("SELECT plz, osm_id, ROUND(SUM(area) OVER (PARTITION BY plz ORDER BY area, osm_id ROWS UNBOUNDED PRECEDING)/SUM(area) OVER (PARTITION BY plz),6) AS cdf FROM x_buildings")
def cdf_cumulative(v: Views) -> DataFrame:
    """Running share."""
    w = Window.partitionBy("plz")
    run = F.sum("area").over(w.orderBy("area", "osm_id").rowsBetween(Window.unboundedPreceding, 0))
    return v.x_buildings.select("plz", "osm_id", F.round(run / F.sum("area").over(w), 6).alias("cdf"))


@query("SELECT plz, ARG_MIN(osm_id, area*1000000+osm_id) AS smallest, ARG_MAX(osm_id, area*1000000-osm_id) AS largest FROM x_buildings GROUP BY plz")
def arg_extremes(v: Views) -> DataFrame:
    """First row with the least and greatest value."""
    return v.x_buildings.groupBy("plz").agg(F.min_by("osm_id", F.struct("area", "osm_id")).alias("smallest"), F.max_by("osm_id", F.struct(F.col("area"), -F.col("osm_id"))).alias("largest"))


@query("SELECT osm_id, x, y FROM x_buildings ORDER BY osm_id LIMIT 1000")
def limited_read(v: Views) -> DataFrame:
    """Ordered read with the row limit of the map view."""
    return v.x_buildings.orderBy("osm_id").limit(1000).select("osm_id", "x", "y")


@query("SELECT plz, osm_id, CAST(place AS INT) AS place FROM (SELECT plz, osm_id, ROW_NUMBER() OVER (PARTITION BY plz ORDER BY substr(md5(osm_id || '|42'),1,13), osm_id) AS place FROM x_buildings) WHERE place<=50")
def hash_sample(v: Views) -> DataFrame:
    """Fifty buildings of each postcode in a reproducible random order."""
    w = Window.partitionBy("plz").orderBy(digits("osm_id", 42), "osm_id")
    return v.x_buildings.withColumn("place", F.row_number().over(w)).where("place <= 50").select("plz", "osm_id", "place")


@query("SELECT kva, osm_id, plz, x FROM (SELECT transformer_rated_power AS kva, osm_id, plz, x, ROW_NUMBER() OVER (PARTITION BY transformer_rated_power ORDER BY osm_id%17, y DESC, osm_id) AS r FROM x_transformers) WHERE r=1")
def sorted_pick(v: Views) -> DataFrame:
    """The first row of each size by several keys, ties included, without a sort."""
    order = F.struct(F.expr("osm_id % 17"), -F.col("y"), "osm_id")
    best = v.x_transformers.groupBy(F.col("transformer_rated_power").alias("kva")).agg(F.min_by(F.struct("osm_id", "plz", "x"), order).alias("b"))
    return best.select("kva", "b.osm_id", "b.plz", "b.x")


@query("SELECT osm_id, plz FROM x_buildings UNION ALL SELECT osm_id, plz FROM x_transformers")
def union_sources(v: Views) -> DataFrame:
    """Rows of several sources in one pass."""
    return v.x_buildings.select("osm_id", "plz").unionByName(v.x_transformers.select("osm_id", "plz"))


@query("SELECT plz FROM x_buildings EXCEPT SELECT plz FROM x_transformers WHERE transformer_rated_power=250")
def set_difference(v: Views) -> DataFrame:
    """Postcodes in one table and not in the other."""
    return v.x_buildings.select("plz").subtract(v.x_transformers.where("transformer_rated_power = 250").select("plz"))


@query("SELECT plz, GROUPING(type) AS g, type, COUNT(*) AS n FROM x_buildings GROUP BY ROLLUP (plz, type)")
def rollup_counts(v: Views) -> DataFrame:
    """Subtotals, which Spark adds for free."""
    return v.x_buildings.rollup("plz", "type").agg(F.grouping("type").cast("long").alias("g"), F.count("*").alias("n")).select("plz", "g", "type", "n")


# --- changes -----------------------------------------------------------------------------------
@query("SELECT osm_id, plz, transformer_rated_power FROM x_transformers WHERE osm_id%3<>0 UNION ALL SELECT osm_id, plz, 800 FROM x_transformers WHERE osm_id%3=0 UNION ALL SELECT osm_id+100000, plz, 100 FROM x_transformers WHERE osm_id%10=0")
def upsert_equipment(v: Views) -> DataFrame:
    """Upsert by key."""
    t = v.x_transformers.select("osm_id", "plz", "transformer_rated_power")
    new = t.where("osm_id % 3 = 0").withColumn("transformer_rated_power", F.lit(800)).unionByName(t.where("osm_id % 10 = 0").selectExpr("osm_id + 100000 AS osm_id", "plz", "100 AS transformer_rated_power"))
    return dml.upsert(t, new, ["osm_id"])


@query("SELECT osm_id, plz FROM x_transformers UNION ALL SELECT osm_id, 0 FROM x_buildings b WHERE osm_id%7=0 AND NOT EXISTS (SELECT 1 FROM x_transformers t WHERE t.osm_id=b.osm_id)")
def insert_if_absent(v: Views) -> DataFrame:
    """Insert of keys that are not there."""
    new = v.x_buildings.where("osm_id % 7 = 0").selectExpr("osm_id", "0 AS plz")
    return dml.insert_absent(v.x_transformers.select("osm_id", "plz"), new, ["osm_id"])


@query("SELECT b.osm_id, CASE WHEN t.osm_id IS NOT NULL THEN t.transformer_rated_power ELSE b.floors END AS floors FROM x_buildings b LEFT JOIN x_transformers t ON t.osm_id=b.osm_id")
def update_from_join(v: Views) -> DataFrame:
    """Update from a joined table and of nulls."""
    return dml.update_from(v.x_buildings.select("osm_id", "floors"), v.x_transformers, ["osm_id"], {"floors": "transformer_rated_power"})


@query("SELECT osm_id, COALESCE(transformer_rated_power, 400) AS kva, CASE WHEN plz IN (1,2) THEN 0 ELSE plz END AS plz FROM x_transformers")
def update_constants(v: Views) -> DataFrame:
    """Constants where null or in a list."""
    t = dml.fill_nulls(v.x_transformers, "transformer_rated_power", 400)
    return dml.assign_where(t, F.col("plz").isin(1, 2), plz=0).select("osm_id", F.col("transformer_rated_power").alias("kva"), "plz")


@query("SELECT 'customer' AS t, COUNT(*) AS n FROM customer WHERE c_nationkey<>3 UNION ALL SELECT 'orders', COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey=3) UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey=3))")
def cascade_delete(v: Views) -> DataFrame:
    """Delete that follows foreign keys."""
    tables = {"customer": v.customer.withColumn("o_custkey", F.col("c_custkey")), "orders": v.orders.withColumn("l_orderkey", F.col("o_orderkey")), "lineitem": v.lineitem}
    gone = v.spark.createDataFrame([(3,)], "c_nationkey int")
    left = dml.cascade_delete(tables, "customer", gone, {"orders": ("customer", ["o_custkey"]), "lineitem": ("orders", ["l_orderkey"])})
    out = [df.agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT p.osm_id, g.osm_id AS grid_result_id FROM x_peaks p JOIN x_transformers g ON g.plz=p.plz WHERE p.kw NOT IN (0,-1) AND g.transformer_rated_power IS NOT NULL")
def publish_results(v: Views) -> DataFrame:
    """Buildings of finished grids with the grid's id."""
    grids = v.x_transformers.where("transformer_rated_power is not null").selectExpr("plz", "osm_id AS grid_result_id")
    return dml.publish(peaks(v).withColumn("peak_load_in_kw", F.col("kw")), grids, ["plz"]).select("osm_id", "grid_result_id")


@query("SELECT osm_id, plz, ROW_NUMBER() OVER (PARTITION BY plz ORDER BY osm_id)+100 AS grid_result_id FROM x_transformers")
def deterministic_ids(v: Views) -> DataFrame:
    """Ids made from a total order."""
    return dml.numbered(v.x_transformers.select("osm_id", "plz"), ["osm_id"], 101, "grid_result_id", ["plz"])


@query("SELECT osm_id, plz, CASE WHEN r<=FLOOR(n*0.30e0) THEN 250 WHEN r<=FLOOR(n*0.30e0)+FLOOR(n*0.25e0) THEN 630 ELSE 400 END AS kva FROM (SELECT osm_id, plz, ROW_NUMBER() OVER (ORDER BY substr(md5(osm_id || '|42'),1,13), osm_id) AS r, COUNT(*) OVER () AS n FROM x_transformers)")
def bulk_capacity_percentage(v: Views) -> DataFrame:
    """Sizes dealt out by percentages in a hash order."""
    return dml.split_by_percentage(v.x_transformers.select("osm_id", "plz"), {250: 30.0, 400: 45.0, 630: 25.0}, "osm_id", "kva")


@query("SELECT n_nationkey AS classification_id, n_name AS region FROM nation WHERE n_regionkey<3 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey>=3")
def classification_guard(v: Views) -> DataFrame:
    """Versions are added to a table, and refused if one is there already."""
    rows = v.nation.select(F.col("n_nationkey").alias("classification_id"), F.col("n_name").alias("region"), "n_regionkey")
    old, new = rows.where("n_regionkey < 3").drop("n_regionkey"), rows.where("n_regionkey >= 3").drop("n_regionkey")
    return dml.refuse_existing(old, new, "classification_id")
