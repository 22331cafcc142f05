"""Distances of distributions, cluster scores, factors and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.electrical import fit_label
from gridwright.operators import clustering, metrics, sampling
from gridwright.queries.registry import Views, query

_W = """WITH v AS (SELECT ca AS metric, f2 AS v, CASE WHEN cb<2 THEN 'Synthetic' ELSE 'Real' END AS s FROM x_features),
p AS (SELECT metric, v, SUM(CASE WHEN s='Synthetic' THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN s='Real' THEN 1 ELSE 0 END) AS b FROM v GROUP BY 1,2),
c AS (SELECT metric, v, SUM(a) OVER w/CAST(SUM(a) OVER (PARTITION BY metric) AS DOUBLE) AS fa, SUM(b) OVER w/CAST(SUM(b) OVER (PARTITION BY metric) AS DOUBLE) AS fb, LEAD(v) OVER (PARTITION BY metric ORDER BY v) AS nxt FROM p WINDOW w AS (PARTITION BY metric ORDER BY v ROWS UNBOUNDED PRECEDING)),
d AS (SELECT metric, SUM(ABS(fa-fb)*(nxt-v)) AS d FROM c GROUP BY metric), q AS (SELECT metric, QUANTILE_CONT(v,0.75)-QUANTILE_CONT(v,0.25) AS iqr FROM v GROUP BY metric)
SELECT d.metric, ROUND(d.d,6) AS wasserstein_distance, ROUND(iqr,6) AS pooled_iqr, ROUND(d.d/iqr,6) AS normalized, CASE WHEN d.d/iqr<=0.10 THEN 'excellent' WHEN d.d/iqr<=0.25 THEN 'good' WHEN d.d/iqr<=0.50 THEN 'acceptable' ELSE 'poor' END AS quality FROM d JOIN q USING (metric)"""


@query(_W)
def wasserstein_summary(v: Views) -> DataFrame:
    """Distance of synthetic from measured values for each metric."""
    rows = v.x_features.select(F.col("ca").alias("metric"), F.col("f2").alias("value"), F.when(F.col("cb") < 2, "Synthetic").otherwise("Real").alias("source"))
    w = metrics.wasserstein(rows, ["metric"], "value", "source", "Synthetic", "Real")
    return w.select("metric", F.round("wasserstein_distance", 6).alias("wasserstein_distance"), F.round("pooled_iqr", 6).alias("pooled_iqr"), F.round("normalized_wasserstein", 6).alias("normalized"), fit_label(F.col("normalized_wasserstein")).alias("quality"))


@query("SELECT grid_result_id, ROUND((f1-(SELECT AVG(f1) FROM x_features))/(SELECT STDDEV_POP(f1) FROM x_features),6) AS f1, ROUND((f2-(SELECT AVG(f2) FROM x_features))/(SELECT STDDEV_POP(f2) FROM x_features),6) AS f2 FROM x_features")
def zscore(v: Views) -> DataFrame:
    """Parameters less their mean, by the population deviation."""
    z = clustering.zscores(v.x_features, ["f1", "f2"])
    return z.select("grid_result_id", F.round("f1", 6).alias("f1"), F.round("f2", 6).alias("f2"))


_M = "m AS (SELECT ca, COUNT(*) AS n, AVG(f1) AS m1, AVG(f2) AS m2 FROM x_features GROUP BY ca)"


@query(f"WITH {_M}, o AS (SELECT AVG(f1) AS o1, AVG(f2) AS o2, COUNT(*) AS n FROM x_features), w AS (SELECT SUM(POWER(f1-m1,2)+POWER(f2-m2,2)) AS w FROM x_features x JOIN m ON m.ca=x.ca), b AS (SELECT SUM(m.n*(POWER(m1-o1,2)+POWER(m2-o2,2))) AS b, COUNT(*) AS k FROM m, o) SELECT ROUND((b/(k-1))/(w/(o.n-k)),6) AS ch FROM w, b, o")
def ch_index(v: Views) -> DataFrame:
    """Calinski-Harabasz index of a labeling."""
    return clustering.calinski_harabasz(v.x_features, "ca", ["f1", "f2"]).select(F.round("ch", 6).alias("ch"))


@query(f"WITH {_M}, s AS (SELECT m.ca, m1, m2, AVG(SQRT(POWER(f1-m1,2)+POWER(f2-m2,2))) AS s FROM x_features x JOIN m ON m.ca=x.ca GROUP BY 1,2,3), r AS (SELECT a.ca, MAX((a.s+b.s)/SQRT(POWER(a.m1-b.m1,2)+POWER(a.m2-b.m2,2))) AS r FROM s a JOIN s b ON a.ca<>b.ca GROUP BY a.ca) SELECT ROUND(AVG(r),6) AS db FROM r")
def db_index(v: Views) -> DataFrame:
    """Davies-Bouldin index of a labeling."""
    return clustering.davies_bouldin(v.x_features, "ca", ["f1", "f2"]).select(F.round("db", 6).alias("db"))


@query("WITH c AS (SELECT ca, cb, COUNT(*) AS n FROM x_features GROUP BY 1,2), ij AS (SELECT SUM(n*(n-1)/2e0) AS s, SUM(n) AS t FROM c), i AS (SELECT SUM(n*(n-1)/2e0) AS s FROM (SELECT SUM(n) AS n FROM c GROUP BY ca)), j AS (SELECT SUM(n*(n-1)/2e0) AS s FROM (SELECT SUM(n) AS n FROM c GROUP BY cb)) SELECT ROUND(CAST((ij.s-i.s*j.s/(t*(t-1)/2e0))/((i.s+j.s)/2e0-i.s*j.s/(t*(t-1)/2e0)) AS DOUBLE),9) AS ari FROM ij, i, j")
def adjusted_rand(v: Views) -> DataFrame:
    """Adjusted Rand index of two labelings."""
    return clustering.adjusted_rand(v.x_features, "ca", "cb").select(F.round("ari", 9).alias("ari"))


@query("WITH rep AS (SELECT ca, ARG_MIN(f1, grid_result_id) AS r1, ARG_MIN(f2, grid_result_id) AS r2 FROM x_features GROUP BY ca), d AS (SELECT x.ca, SQRT(AVG(POWER((f1-r1)/r1,2))) AS d1, SQRT(AVG(POWER((f2-r2)/r2,2))) AS d2 FROM x_features x JOIN rep ON rep.ca=x.ca GROUP BY x.ca) SELECT ROUND(AVG((d1+d2)/2),6) AS deviation FROM d")
def cluster_deviation(v: Views) -> DataFrame:
    """Relative deviation from representatives."""
    rep = v.x_features.groupBy("ca").agg(F.min_by("f1", "grid_result_id").alias("f1"), F.min_by("f2", "grid_result_id").alias("f2"))
    return clustering.cluster_deviation(v.x_features, rep, "ca", ["f1", "f2"]).select(F.round("deviation", 6).alias("deviation"))


_FEATURES = ["f1", "f2", "f3", "f4"]


def _four(v: Views) -> DataFrame:
    return v.x_features.selectExpr("grid_result_id", "f1", "f2", "f1 + 0.1D * ca AS f3", "f2 * 0.01D + cb AS f4")


@query("SELECT ROUND(CORR(f1,f2),9) AS f1_f2, ROUND(CORR(f1,CAST(ca AS DOUBLE)),9) AS f1_ca, ROUND(CORR(f2,CAST(cb AS DOUBLE)),9) AS f2_cb FROM x_features")
def correlation_matrix(v: Views) -> DataFrame:
    """Correlations."""
    return v.x_features.agg(F.round(F.corr("f1", "f2"), 9).alias("f1_f2"), F.round(F.corr("f1", "ca"), 9).alias("f1_ca"), F.round(F.corr("f2", "cb"), 9).alias("f2_cb"))


@query(name="pca_explained")
def pca_explained(v: Views) -> DataFrame:
    """Explained variance of principal components and its running sum."""
    share, run = clustering.explained_variance(clustering.correlations(_four(v), _FEATURES))
    return v.spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(share, run, strict=True), 1)], "component int, share double, cumulative double")


@query(name="factor_tests")
def factor_tests(v: Views) -> DataFrame:
    """Bartlett's sphericity, Kaiser-Meyer-Olkin, and the parameter of each factor (C11 C14)."""
    df = _four(v)
    corr = clustering.correlations(df, _FEATURES)
    chi, dof = clustering.bartlett(corr, df.count())
    return v.spark.createDataFrame([(float(chi), int(dof), float(clustering.kmo(corr)), clustering.chosen_parameters(df, _FEATURES))], "chi_square double, dof int, kmo double, parameters array<string>")


@query(name="kmeans_grids")
def kmeans_grids(v: Views) -> DataFrame:
    """Clusters of grids, numbered by their representatives; the k-medoids column stays null."""
    rows = clustering.kmeans_grids(v.x_features, ["f1", "f2"], 5)
    chosen = clustering.representatives(rows, "grid_result_id", ["f1", "f2"])
    out = clustering.reindexed(rows.select("grid_result_id", "clusters"), chosen, v.x_features, "grid_result_id", "f1")
    return out.withColumn("kmedoid_clusters", F.lit(None).cast("int"))


@query(name="gmm_tied")
def gmm_tied(v: Views) -> DataFrame:
    """Clusters by a Gaussian mixture with one covariance."""
    return clustering.gmm(v.x_features, ["f1", "f2"], 4, "tied").select("grid_result_id", "clusters")


@query(name="cluster_counts")
def cluster_counts(v: Views) -> DataFrame:
    """Scores of five algorithms by which a number of clusters is picked."""
    return clustering.cluster_counts(v.x_features, ["f1", "f2"])


@query(name="best_cluster_counts")
def best_cluster_counts(v: Views) -> DataFrame:
    """The number of clusters that each algorithm scores best with, by either index."""
    return clustering.best_counts(clustering.cluster_counts(v.x_features, ["f1", "f2"]))


_BINS = "CASE WHEN c<100 THEN 5 ELSE 10 END"
#: The sample drawn by hand: classes, equal-width bins, quotas, and the order of the draw.
_SAMPLE = f"""WITH s AS (SELECT regio7, MIN(pop_den) AS lo, MAX(pop_den) AS hi, COUNT(*) AS c FROM x_municipal GROUP BY 1),
b AS (SELECT m.*, s.c, LEAST(CASE WHEN hi=lo THEN 0 ELSE CAST(FLOOR((pop_den-lo)/(hi-lo)*({_BINS})) AS INT) END, ({_BINS})-1) AS bin_no FROM x_municipal m JOIN s ON s.regio7=m.regio7),
p AS (SELECT *, COUNT(*) OVER (PARTITION BY regio7, bin_no)/CAST(c AS DOUBLE)/COUNT(*) OVER (PARTITION BY regio7, bin_no) AS perc FROM b),
q AS (SELECT regio7 AS qr, ROUND_EVEN(SUM(pop)*40e0/(SELECT SUM(pop) FROM x_municipal),0) AS k FROM x_municipal GROUP BY 1),
d AS (SELECT p.*, ROW_NUMBER() OVER (PARTITION BY regio7 ORDER BY -LN((CAST('0x' || substr(md5(plz || '|42'),1,13) AS BIGINT)+1)/4503599627370497e0)/perc, plz) AS r FROM p),
smp AS (SELECT plz, ags, regio7, bin_no, perc FROM d JOIN q ON qr=regio7 WHERE r<=k)"""


@query(f"{_SAMPLE} SELECT plz, ags, regio7, bin_no, ROUND(perc,9) AS perc FROM smp")
def stratified_sample(v: Views) -> DataFrame:
    """Postcodes drawn by class quotas and density bins."""
    return sampling.stratified_sample(v.x_municipal, "regio7", "pop", "pop_den", "plz", 40).select("plz", "ags", "regio7", "bin_no", F.round("perc", 9).alias("perc"))


@query(f"""{_SAMPLE}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY regio7, bin_no ORDER BY plz) AS at FROM smp WHERE plz%2=0),
n AS (SELECT b.plz, b.regio7, b.bin_no, ROW_NUMBER() OVER (PARTITION BY b.regio7, b.bin_no ORDER BY substr(md5(b.plz || '|42'),1,13), b.plz) AS at FROM b WHERE b.plz NOT IN (SELECT plz FROM smp))
SELECT plz, regio7, bin_no FROM smp WHERE plz%2<>0 UNION ALL SELECT n.plz, o.regio7, o.bin_no FROM o JOIN n ON n.regio7=o.regio7 AND n.bin_no=o.bin_no AND n.at=o.at""")
def replaced_sample(v: Views) -> DataFrame:
    """Postcodes of a sample replaced by others of their class and bin (C17)."""
    s = sampling.stratified_sample(v.x_municipal, "regio7", "pop", "pop_den", "plz", 40).select("plz", "regio7", "bin_no")
    return sampling.replace_samples(s, v.x_municipal, s.where("plz % 2 = 0"), "regio7", "pop_den", "plz")


@query("""WITH s AS (SELECT ca, MIN(f2) AS lo, MAX(f2) AS hi, GREATEST(COALESCE(STDDEV_SAMP(f2),0)*POWER(CAST(COUNT(f2) AS DOUBLE),-0.2e0),1e-9) AS h FROM x_features GROUP BY 1),
g AS (SELECT s.*, i, lo+(hi-lo)*i/199 AS v FROM s, range(0,200) t(i))
SELECT g.ca, CAST(i AS INT) AS i, ROUND(v,6) AS value, ROUND(AVG(EXP(-POWER((v-f2)/h,2)/2)/(h*2.5066282746310002e0)),9) AS density FROM g JOIN x_features x ON x.ca=g.ca GROUP BY 1,2,v""")
def density_curve(v: Views) -> DataFrame:
    """Gaussian kernel density of a metric in each class."""
    return metrics.density_curve(v.x_features, ["ca"], "f2").select("ca", "i", F.round("at", 6).alias("value"), F.round("density", 9).alias("density"))


@query("SELECT ca, MIN(f2) AS low, ROUND(QUANTILE_CONT(f2,0.25),6) AS q1, ROUND(QUANTILE_CONT(f2,0.5),6) AS median, ROUND(QUANTILE_CONT(f2,0.75),6) AS q3, MAX(f2) AS high FROM x_features GROUP BY ca")
def box_stats(v: Views) -> DataFrame:
    """Figures of a box plot."""
    b = metrics.box_stats(v.x_features, ["ca"], "f2")
    return b.select("ca", "low", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "high")


@query("SELECT grid_result_id, f1>40 OR COALESCE(f2<950,FALSE) OR ca=6 AS filtered FROM x_features")
def grid_filters(v: Views) -> DataFrame:
    """Grids left out by thresholds; all others are marked false."""
    from gridwright.operators.grid_metrics import grid_filters as filters

    grids = v.x_features.select("grid_result_id", F.col("f1").alias("max_trafo_dis"), "f2", "ca")
    large = v.x_features.where("ca = 6").select("grid_result_id", F.lit(200).alias("households_per_building"))
    return filters(grids, large, {"f2": 950.0}, "grid_result_id", 40.0).select("grid_result_id", "filtered")


@query("SELECT g.grid_result_id, ROUND(SUM(length_km*r/parallel),9) AS resistance FROM (SELECT grid_result_id, parallel, length_km, CASE std_type WHEN 'NAYY_4_120' THEN 0.225e0 WHEN 'NAYY_4_150' THEN 0.208e0 ELSE 0.164e0 END AS r FROM x_lines WHERE in_service) g GROUP BY 1")
def graph_resistance(v: Views) -> DataFrame:
    """Sum of length times resistance by the number in parallel."""
    r = F.element_at(F.create_map(*[F.lit(x) for pair in {"NAYY_4_120": 0.225, "NAYY_4_150": 0.208, "NAYY_4_185": 0.164}.items() for x in pair]), F.col("std_type"))
    lines = v.x_lines.withColumns({"r_ohm_per_km": r, "x_ohm_per_km": F.lit(0.08), "from_bus": F.lit(0), "to_bus": F.lit(1)})
    return metrics.graph_resistance(lines, ["grid_result_id"]).select("grid_result_id", F.round("graph_resistance", 9).alias("resistance"))


@query("SELECT d.osm_id, ROUND(d.distance,6) AS distance, p.peak FROM (SELECT osm_id, x/7 AS distance FROM x_buildings) d LEFT JOIN (SELECT ROUND(x/7,6) AS k, MIN(area) AS peak FROM x_buildings WHERE osm_id%2=0 GROUP BY 1) p ON ROUND(d.distance,6)=p.k")
def peak_lookup(v: Views) -> DataFrame:
    """Stored peak of a distance, by a rounded key."""
    d = v.x_buildings.select("osm_id", (F.col("x") / 7).alias("distance"), F.lit(1).alias("g"))
    p = v.x_buildings.where("osm_id % 2 = 0").select((F.col("x") / 7).alias("distance"), F.col("area").alias("peak"), F.lit(1).alias("g"))
    return metrics.peak_at_distance(d, p, ["g"]).select("osm_id", F.round("distance", 6).alias("distance"), "peak")


@query("SELECT l.l_orderkey AS grid, l.l_linenumber AS line, CAST(l.l_quantity*3 AS DOUBLE) AS loading_percent, CAST(l.l_quantity*3 AS DOUBLE)-100 AS overload_pct FROM lineitem l WHERE l_quantity*3>100")
def line_overloads(v: Views) -> DataFrame:
    """Lines loaded above their limit."""
    from gridwright.operators.reports import line_overloads as overloads

    keys = v.lineitem.select(F.col("l_orderkey").alias("grid"), F.col("l_linenumber").alias("line"), F.col("l_quantity"))
    res = keys.select("grid", "line", (F.col("l_quantity") * 3).cast("double").alias("loading_percent"))
    names = keys.select("grid", "line").distinct().withColumn("name", F.lit("L"))
    return overloads(res, names, ["grid", "line"]).select("grid", "line", "loading_percent", "overload_pct")


@query("WITH l AS (SELECT l_orderkey AS g, SUM(CAST(l_tax AS DOUBLE)) AS line_losses_mw, SUM(CAST(l_quantity AS DOUBLE)) AS load_mw FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS g, 0.25e0 AS trafo FROM orders WHERE o_orderkey%2=0) SELECT l.g, ROUND(line_losses_mw+COALESCE(trafo,0),6) AS total_losses_mw, ROUND((line_losses_mw+COALESCE(trafo,0))/load_mw*100,6) AS loss_pct FROM l LEFT JOIN t ON t.g=l.g")
def network_losses(v: Views) -> DataFrame:
    """Losses of lines and transformers against the load."""
    from gridwright.operators.reports import losses

    line = v.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_tax").cast("double").alias("pl_mw"))
    load = v.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_quantity").cast("double").alias("p_mw"))
    trafo = v.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("g"), F.lit(0.25).alias("pl_mw"))
    return losses(line, trafo, load, "g").select("g", F.round("total_losses_mw", 6).alias("total_losses_mw"), F.round("loss_pct", 6).alias("loss_pct"))


