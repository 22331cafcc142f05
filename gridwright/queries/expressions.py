"""Rules that need no more than a row, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions import electrical as E
from gridwright.functions import geometry as G
from gridwright.functions import text as T
from gridwright.queries.registry import Views, query


def peaks(v: Views) -> DataFrame:
    """Buildings with homes, kw and simultaneity factor."""
    c = F.broadcast(v.x_categories)  # six rows
    b = v.x_buildings.join(c, F.col("type") == F.col("definition"), "left")
    b = b.withColumn("homes", E.households(F.col("type"), F.col("area"), F.col("floors"), F.col("households_per_building")))
    return b.withColumn("kw", E.peak_load(F.col("type"), F.col("area"), F.col("homes"), F.col("peak_load"), F.col("peak_load_per_m2")))


def by_category(df: DataFrame, *keys: str) -> DataFrame:
    """Simultaneous load of each main category of a group."""
    sums = df.withColumn("category", E.main_category(F.col("type"))).groupBy(*keys, "category").agg(F.sum("kw").alias("p"), F.sum("homes").alias("n"), F.min("sim_factor").alias("g"))
    return sums.withColumn("sim", E.simultaneous_load(F.col("p"), F.col("n"), F.col("g")))


_SIM = """s AS (SELECT plz, CASE WHEN type IN ('SFH','MFH','TH','AB') THEN 'Residential' ELSE type END AS category, SUM(CASE WHEN kw>100 AND type IN ('Commercial','Public') THEN 0 ELSE kw END) AS p,
 SUM(CASE WHEN kw>100 AND type IN ('Commercial','Public') THEN 0 ELSE homes END) AS n, MIN(sim_factor) AS g FROM x_peaks GROUP BY 1,2),
l AS (SELECT plz, category, CASE WHEN p<=0 OR n<=0 THEN 0 ELSE p*(g+(1-g)*POWER(CAST(n AS DOUBLE),-0.75)) END AS sim FROM s)"""


@query(f"""WITH {_SIM}, t AS (SELECT plz, SUM(sim) AS sim FROM l GROUP BY plz)
SELECT t.plz, ROUND(t.sim,6) AS sim_load_kw, COALESCE((SELECT MIN(kva) FROM x_caps WHERE kva>t.sim), CAST(CEIL(t.sim/630)*630 AS INT)) AS transformer_kva FROM t""")
def flagship_plz_peak_transformer(v: Views) -> DataFrame:
    """Simultaneous peak load of each postcode and the smallest transformer that carries it."""
    b = peaks(v).withColumn("kw", E.without_too_large(F.col("type"), F.col("kw"))).where("kw > 0")
    total = by_category(b, "plz").groupBy("plz").agg(F.sum("sim").alias("sim"))
    fits = total.join(F.broadcast(v.x_caps), F.col("kva") > F.col("sim"), "left").groupBy("plz", "sim").agg(F.min("kva").alias("kva"))
    return fits.select("plz", F.round("sim", 6).alias("sim_load_kw"), F.coalesce("kva", (F.ceil(F.col("sim") / 630) * 630).cast("int")).alias("transformer_kva"))


@query("SELECT osm_id, CAST(homes AS INT) AS households FROM x_loads")
def households_rule(v: Views) -> DataFrame:
    return peaks(v).select("osm_id", F.col("homes").alias("households"))


@query("SELECT osm_id, ROUND(kw,6) AS kw FROM x_peaks")
def peak_load(v: Views) -> DataFrame:
    return peaks(v).select("osm_id", F.round("kw", 6).alias("kw"))


@query("SELECT plz, COUNT(*) AS zeroed, CAST(SUM(CASE WHEN kw<=0 THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM x_peaks WHERE kw<=0 OR (kw>30 AND type IN ('Commercial','Public')) GROUP BY plz")
def too_large_filter(v: Views) -> DataFrame:
    """Buildings left out per postcode: without load (P03), or too large for the grid."""
    b = peaks(v).withColumn("left", E.without_too_large(F.col("type"), F.col("kw"), 30.0))
    return b.where("left <= 0").groupBy("plz").agg(F.count("*").alias("zeroed"), F.count_if(F.col("kw") <= 0).alias("removed"))


@query("""WITH h AS (SELECT plz, AVG(homes) AS mh, MAX(x)/200 AS md FROM x_loads GROUP BY plz),
s AS (SELECT plz, (LEAST(1,GREATEST(0,(mh-1.3e0)/(3.2e0-1.3e0)))+LEAST(1,GREATEST(0,(md-55.0e0)/(20.0e0-55.0e0))))/2 AS score FROM h)
SELECT plz, ROUND(score,6) AS score, CASE WHEN score<1/3e0 THEN 1 WHEN score<2/3e0 THEN 2 ELSE 3 END AS settlement_type FROM s""")
def settlement_score(v: Views) -> DataFrame:
    """Score and type of a postcode from mean households (A01) and a distance (P10)."""
    m = peaks(v).groupBy("plz").agg(F.avg("homes").alias("mh"), (F.max("x") / 200).alias("md"))
    s = m.withColumn("s", E.settlement_score(F.col("mh"), F.col("md")))
    return s.select("plz", F.round("s", 6).alias("score"), E.settlement_type(F.col("s")).alias("settlement_type"))


_KIND = "CASE o_orderkey%6 WHEN 0 THEN ' Radweg ' WHEN 1 THEN 'Gemeindestraße' WHEN 2 THEN 'Rad- und Fußweg' WHEN 3 THEN 'Kreisstraße' WHEN 4 THEN 'Pfad' END"


@query(f"""WITH w AS (SELECT o_orderkey AS remote_id, {_KIND} AS kind FROM orders UNION ALL SELECT c_custkey+100000000, 'Fußweg' FROM customer),
c AS (SELECT remote_id, CASE TRIM(kind) WHEN 'Radweg' THEN 81 WHEN 'Gemeindestraße' THEN 41 WHEN 'Rad- und Fußweg' THEN 72 WHEN 'Kreisstraße' THEN 21 WHEN 'Fußweg' THEN 91 ELSE 99 END AS clazz FROM w)
SELECT 500+ROW_NUMBER() OVER (ORDER BY remote_id) AS way_id, remote_id, clazz FROM c WHERE clazz<>72""")
def way_class_map(v: Views) -> DataFrame:
    """Street classes of two sources (U01), without class 72, numbered on from the largest id."""
    from gridwright.operators.dml import numbered

    one = v.orders.selectExpr("o_orderkey AS remote_id", f"{_KIND} AS kind")
    two = v.customer.selectExpr("c_custkey + 100000000 AS remote_id", "'Fußweg' AS kind")
    ways = one.unionByName(two).select("remote_id", T.way_class(F.col("kind")).alias("clazz")).where("clazz <> 72")
    return numbered(ways, ["remote_id"], 501, "way_id").select("way_id", "remote_id", "clazz")


@query("SELECT kva, CASE WHEN kva IN (100,160,250,400,630) THEN 'single ' || kva || ' kva transformer' WHEN kva IN (500,800,1260) THEN 'double ' || CAST(kva*0.5 AS DECIMAL(10,1)) || ' transformer' ELSE CAST(GREATEST(1,kva//630) AS VARCHAR) || '-fold 630 transformer' END AS name, CAST(CASE WHEN kva IN (100,160,250,400,630) THEN kva WHEN kva IN (500,800,1260) THEN kva*0.5 ELSE 630 END AS DOUBLE) AS unit_kva, CAST(CASE WHEN kva IN (100,160,250,400,630) THEN 1 WHEN kva IN (500,800,1260) THEN 2 ELSE GREATEST(1,kva//630) END AS INT) AS parallel FROM (SELECT DISTINCT CASE p_size%7 WHEN 0 THEN 250 WHEN 1 THEN 800 WHEN 2 THEN 1260 WHEN 3 THEN 1890 WHEN 4 THEN 400 WHEN 5 THEN 315 ELSE 630 END AS kva FROM part)")
def transformer_build(v: Views) -> DataFrame:
    """Name and number of units of a rated power."""
    k = v.part.selectExpr("CASE p_size % 7 WHEN 0 THEN 250 WHEN 1 THEN 800 WHEN 2 THEN 1260 WHEN 3 THEN 1890 WHEN 4 THEN 400 WHEN 5 THEN 315 ELSE 630 END AS kva").distinct()
    name, unit, parallel = E.transformer_build(F.col("kva"))
    return k.select("kva", name.alias("name"), unit.alias("unit_kva"), parallel.cast("int").alias("parallel"))


@query("SELECT p_partkey, CASE WHEN k IN (400,630,800,1600) THEN CAST(k AS INT) ELSE CAST(CEIL(k/630.0e0)*630 AS INT) END AS rated FROM (SELECT p_partkey, CASE p_size%5 WHEN 0 THEN 400 WHEN 1 THEN 1600 WHEN 2 THEN 811 WHEN 3 THEN 1900 ELSE 250 END AS k FROM part)")
def grouped_rating(v: Views) -> DataFrame:
    """Ratings kept if allowed, else the next multiple of 630."""
    k = v.part.selectExpr("p_partkey", "CASE p_size % 5 WHEN 0 THEN 400 WHEN 1 THEN 1600 WHEN 2 THEN 811 WHEN 3 THEN 1900 ELSE 250 END AS k")
    return k.select("p_partkey", E.grouped_rating(F.col("k"), F.array(F.lit(400), F.lit(630), F.lit(800))).alias("rated"))


@query("""WITH c AS (SELECT settlement_type, kva FROM (VALUES (1,250),(1,400),(1,630),(2,400),(2,630),(3,400),(3,630),(3,800)) AS t(settlement_type,kva))
SELECT settlement_type, load, MIN(kva) AS next_kva FROM c JOIN (SELECT DISTINCT CAST(p_size*12 AS INT) AS load FROM part) ON kva>load GROUP BY 1,2""")
def next_capacity(v: Views) -> DataFrame:
    """Smallest allowed size above a load for each settlement type."""
    from gridwright.config import capacities

    loads = v.part.selectExpr("CAST(p_size * 12 AS INT) AS load").distinct()
    return loads.join(F.broadcast(capacities(v.spark)), F.col("kva") > F.col("load")).groupBy("settlement_type", "load").agg(F.min("kva").alias("next_kva"))


@query("SELECT osm_id, ROUND(kw/(400*0.9e0*SQRT(3e0)),9) AS imax_ka, ROUND(CASE WHEN kw*x<=0 THEN 0 ELSE 0.4e0*0.05e0/(SQRT(3e0)*(kw/(400*0.9e0*SQRT(3e0)))*(x/1000)) END,9) AS z_limit, ROUND(kw*TAN(ACOS(0.95e0)),6) AS kvar FROM x_peaks")
def imax(v: Views) -> DataFrame:
    """Current, impedance limit and reactive power."""
    i = E.current_ka(F.col("kw"))
    z = E.max_impedance(F.lit(5.0), i, F.col("x") / 1000, F.lit(1))
    return peaks(v).select("osm_id", F.round(i, 9).alias("imax_ka"), F.round(F.when(z == float("inf"), 0.0).otherwise(z), 9).alias("z_limit"), F.round(E.reactive_kvar(F.col("kw")), 6).alias("kvar"))


@query(r"SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(TRIM(n),'\s+','_','g'),'(\d)x(\d)','\1_\2','g'),'_?SE$','') AS name FROM (SELECT CASE p_size%4 WHEN 0 THEN 'NAYY 4x120 SE' WHEN 1 THEN 'NYY_4_35' WHEN 2 THEN ' NAYY  4x' || p_size || ' ' ELSE 'NAYY 4x150SE' END AS n FROM part)")
def cable_name_normalise(v: Views) -> DataFrame:
    """Cable names of other sources."""
    n = v.part.selectExpr("CASE p_size % 4 WHEN 0 THEN 'NAYY 4x120 SE' WHEN 1 THEN 'NYY_4_35' WHEN 2 THEN ' NAYY  4x' || p_size || ' ' ELSE 'NAYY 4x150SE' END AS n")
    return n.select(T.cable_name(F.col("n")).alias("name")).distinct()


_BUS = "CASE p_partkey%5 WHEN 0 THEN 'NS_KVS ' || p_partkey WHEN 1 THEN 'consumer nodebus ' || p_partkey WHEN 2 THEN 'Connection Nodebus 3' WHEN 3 THEN 'LVbus 1' END"


@query(f"SELECT p_partkey AS bus, CASE WHEN regexp_matches(COALESCE(n,''),'(?i)NS_KVS') THEN 'kvs' WHEN regexp_matches(COALESCE(n,''),'(?i)Consumer Nodebus') THEN 'house_connection' ELSE 'backbone' END AS bus_type FROM (SELECT p_partkey, {_BUS} AS n FROM part)")
def bus_types(v: Views) -> DataFrame:
    """Roles of buses by name."""
    return v.part.selectExpr("p_partkey AS bus", f"{_BUS} AS n").select("bus", T.bus_type(F.col("n")).alias("bus_type"))


@query(f"SELECT CAST(SUM(CASE WHEN contains(COALESCE(n,''),'Nodebus') THEN 1 ELSE 0 END) AS BIGINT) AS with_word, COUNT(*) AS buses FROM (SELECT {_BUS} AS n FROM part)")
def bus_count_by_word(v: Views) -> DataFrame:
    """Buses whose name holds a word; null names hold none."""
    return v.part.selectExpr(f"{_BUS} AS n").agg(F.sum(T.has_word(F.col("n"), "Nodebus").cast("int")).alias("with_word"), F.count("*").alias("buses"))


@query("SELECT osm_id, x, y FROM x_buildings")
def geojson_point(v: Views) -> DataFrame:
    """Points written as GeoJSON and read back."""
    doc = v.x_buildings.select("osm_id", T.point_json(F.col("x"), F.col("y")).alias("doc"))
    return doc.select("osm_id", T.point_of_json(F.col("doc")).alias("p")).select("osm_id", "p.x", "p.y")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber=2 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS num FROM lineitem")
def try_number(v: Views) -> DataFrame:
    """Text to number, null where it is none."""
    t = v.lineitem.selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_linenumber = 2 THEN 'x' || l_quantity ELSE CAST(l_quantity AS STRING) END AS t")
    return t.select("l_orderkey", "l_linenumber", T.number(F.col("t")).alias("num"))


@query("SELECT p_partkey, CASE WHEN starts_with(c,'7') AND length(c)>4 THEN substr(c,2,3) END AS substation, string_split(b,'_')[-1] AS tail, substr(b,1,15) AS short FROM (SELECT p_partkey, CAST(70000+p_partkey*7 AS VARCHAR) AS c, p_brand || '_' || p_size AS b FROM part)")
def string_codes(v: Views) -> DataFrame:
    """Substation digits, last part and truncated names."""
    s = v.part.selectExpr("p_partkey", "CAST(70000 + p_partkey * 7 AS STRING) AS c", "p_brand || '_' || p_size AS b")
    return s.select("p_partkey", T.substation(F.col("c")).alias("substation"), F.element_at(F.split("b", "_"), -1).alias("tail"), F.substring("b", 1, 15).alias("short"))


@query("SELECT plz, CASE regio7 WHEN 71 THEN 51 WHEN 72 THEN 52 WHEN 73 THEN 53 WHEN 75 THEN 53 WHEN 76 THEN 54 ELSE 55 END AS regio5 FROM x_register")
def map_lookup(v: Views) -> DataFrame:
    """Five-class region of each seven-class one."""
    return v.x_register.select("plz", T.regio5(F.col("regio7")).alias("regio5"))


@query("SELECT plz, ROUND(2*6371.0e0*ASIN(SQRT(POWER(SIN(RADIANS(48-y/10000)/2),2)+COS(RADIANS(y/10000))*COS(RADIANS(48e0))*POWER(SIN(RADIANS(11-x/10000)/2),2))),6) AS km, osm_id FROM x_buildings")
def haversine(v: Views) -> DataFrame:
    """Great-circle distance."""
    return v.x_buildings.select("plz", F.round(G.haversine_km(F.col("x") / 10000, F.col("y") / 10000, F.lit(11.0), F.lit(48.0)), 6).alias("km"), "osm_id")


@query("SELECT osm_id, ROUND(10+x/5000,7) AS lon, ROUND(47+y/3000,7) AS lat FROM x_buildings")
def reproject_round_trip(v: Views) -> DataFrame:
    """To EPSG:3035 and back."""
    x, y = G.to_3035(10 + F.col("x") / 5000, 47 + F.col("y") / 3000)
    p = v.x_buildings.select("osm_id", x.alias("e"), y.alias("n"))
    lon, lat = G.from_3035(F.col("e"), F.col("n"))
    return p.select("osm_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("SELECT bus, grid_result_id, vm_pu, CASE WHEN vm_pu<0.9 THEN 'undervoltage' ELSE 'overvoltage' END AS kind, ROUND(CASE WHEN vm_pu<0.9 THEN 0.9-vm_pu ELSE vm_pu-1.1 END,6) AS deviation, ROUND(100*(CASE WHEN vm_pu<0.9 THEN 0.9-vm_pu ELSE vm_pu-1.1 END)/(CASE WHEN vm_pu<0.9 THEN 0.9 ELSE 1.1 END),4) AS deviation_pct FROM x_voltage WHERE vm_pu<0.9 OR vm_pu>1.1")
def voltage_violations(v: Views) -> DataFrame:
    """Buses outside the voltage band, with kind and deviation."""
    from gridwright.operators.reports import voltage_violations as violations

    return violations(v.x_voltage).select("bus", "grid_result_id", "vm_pu", "kind", F.round("deviation", 6).alias("deviation"), F.round("deviation_pct", 4).alias("deviation_pct"))


@query("SELECT grid_result_id, CASE WHEN COUNT(*)%7=0 THEN 'not_converged' WHEN MIN(vm_pu)<0.9 OR MAX(vm_pu)>1.1 THEN 'voltage_violation' ELSE 'converged' END AS status FROM x_voltage GROUP BY grid_result_id")
def power_flow_status(v: Views) -> DataFrame:
    """Status of a grid from its voltages (P20)."""
    g = v.x_voltage.groupBy("grid_result_id").agg(F.min("vm_pu").alias("a"), F.max("vm_pu").alias("b"), (F.count("*") % 7 != 0).alias("ok"))
    return g.select("grid_result_id", E.power_flow_status(F.col("ok"), F.col("a"), F.col("b")).alias("status"))


@query("SELECT l_orderkey, CASE WHEN d<=0.10 THEN 'excellent' WHEN d<=0.25 THEN 'good' WHEN d<=0.50 THEN 'acceptable' ELSE 'poor' END AS quality FROM (SELECT DISTINCT l_orderkey, (l_orderkey%97)/97.0e0 AS d FROM lineitem)")
def fit_label(v: Views) -> DataFrame:
    """Quality labels of normalised distances."""
    return v.lineitem.selectExpr("l_orderkey", "(l_orderkey % 97) / 97.0D AS d").distinct().select("l_orderkey", E.fit_label(F.col("d")).alias("quality"))
