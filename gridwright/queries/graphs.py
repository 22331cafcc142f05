"""Components, shortest paths, trees and feeders on the edge adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions import geometry as G
from gridwright.operators import grid_metrics, routing
from gridwright.operators.components import JOINED, components_with, connected_components
from gridwright.queries.registry import Views, query

_UP = "RECURSIVE up(node, anc, dist, hops) AS (SELECT source, source, CAST(0 AS DOUBLE), 0 FROM x_edges UNION ALL SELECT 0, 0, CAST(0 AS DOUBLE), 0 UNION ALL SELECT u.node, e.target, u.dist+e.cost, u.hops+1 FROM up u JOIN x_edges e ON e.source=u.anc)"


def _edges(v: Views) -> DataFrame:
    """The tree as one group."""
    return v.x_edges.select(F.lit(0).alias("g"), "source", "target", "cost")


def _root(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(0, 0)], "g int, vid long")


def _parents(v: Views) -> DataFrame:
    tree = v.x_edges.select(F.lit(0).alias("g"), F.col("source").alias("node"), F.col("target").alias("parent"))
    return tree.unionByName(v.spark.createDataFrame([(0, 0, None)], "g int, node long, parent long"))


@query("WITH RECURSIVE n AS (SELECT source AS node FROM x_forest UNION SELECT target FROM x_forest), r(node, top) AS (SELECT node, node FROM n UNION ALL SELECT r.node, f.target FROM r JOIN x_forest f ON f.source=r.top) SELECT node, MIN(top) AS component FROM r GROUP BY node")
def components(v: Views) -> DataFrame:
    """Connected components of a forest."""
    return connected_components(v.x_forest, "source", "target", joined=JOINED)


@query("WITH RECURSIVE n AS (SELECT source AS node FROM x_forest UNION SELECT target FROM x_forest), r(node, top) AS (SELECT node, node FROM n UNION ALL SELECT r.node, f.target FROM r JOIN x_forest f ON f.source=r.top) SELECT node, MIN(top) AS component FROM r GROUP BY node")
def components_added(v: Views) -> DataFrame:
    """Components of a forest after a tenth of its edges came later: only the classes that these touch are joined."""
    late = F.col("source") % 10 == 3
    known = connected_components(v.x_forest.where(~late), "source", "target", joined=JOINED)
    return components_with(known, v.x_forest.where(late), "source", "target")


@query(f"WITH {_UP} SELECT node, ROUND(dist,6) AS dist, CAST(hops AS INT) AS hops FROM up WHERE anc=0")
def root_distance(v: Views) -> DataFrame:
    """Distances from one node to all."""
    return routing.costs(_edges(v), _root(v), ["g"]).select(F.col("end_vid").alias("node"), F.round("agg_cost", 6).alias("dist"), "hops")


@query(f"WITH {_UP} SELECT node, list(anc ORDER BY hops DESC) AS path FROM up WHERE node>0 GROUP BY node")
def root_path(v: Views) -> DataFrame:
    """Nodes on the path from the root."""
    ends = v.x_edges.select(F.lit(0).alias("g"), F.col("source").alias("vid"))
    return routing.paths(_edges(v), _root(v), ends, ["g"]).select(F.col("end_vid").alias("node"), "path")


@query(f"WITH {_UP} SELECT anc AS node, CAST(SUM(node%7) AS BIGINT) AS load, COUNT(*) AS nodes FROM up GROUP BY anc")
def subtree_load(v: Views) -> DataFrame:
    """Loads added up over the subtrees of a tree."""
    loads = _parents(v).select("g", "node", F.expr("node % 7").alias("load"), F.lit(1).alias("nodes"))
    return routing.subtree_sums(_parents(v), loads, ["g"], ["load", "nodes"]).drop("g")


@query("SELECT CAST(COUNT(*) AS INT) AS feeder_lines FROM x_edges WHERE source NOT IN (SELECT target FROM x_edges)")
def feeder_leaf_count(v: Views) -> DataFrame:
    """Ends of the backbone tree."""
    bus = _parents(v).select("g", F.col("node").alias("bus"), F.lit("backbone").alias("bus_type"))
    none = v.spark.createDataFrame([], "g int, hv_bus long, lv_bus long")
    return routing.feeders(_edges(v), bus, _root(v), none, ["g"], recursive=True).select("feeder_lines")


@query("SELECT CAST(COUNT(*) AS INT) AS feeder_lines FROM x_edges WHERE target=0")
def feeder_first_hop_count(v: Views) -> DataFrame:
    """Feeders at the first branching."""
    bus = _parents(v).select("g", F.col("node").alias("bus"), F.lit("backbone").alias("bus_type"))
    none = v.spark.createDataFrame([], "g int, hv_bus long, lv_bus long")
    return routing.feeders(_edges(v), bus, _root(v), none, ["g"]).select("feeder_lines")


#: Per postcode: every point with all above it in the postcode's tree of streets, and the distances between all its points.
_STREET_COSTS = "RECURSIVE su(plz, node, anc, dist) AS (SELECT plz, source, source, CAST(0 AS DOUBLE) FROM x_streets UNION ALL SELECT u.plz, u.node, e.target, u.dist+e.cost FROM su u JOIN x_streets e ON e.plz=u.plz AND e.source=u.anc AND u.anc>0), sd AS (SELECT plz, node, dist FROM su WHERE anc=0), sp AS (SELECT a.plz, a.node AS s, b.node AS e, MAX(c.dist) AS lca FROM su a JOIN su b ON a.plz=b.plz AND a.anc=b.anc JOIN sd c ON c.plz=a.plz AND c.node=a.anc GROUP BY 1,2,3), sm AS (SELECT sp.plz, sp.s, sp.e, CAST(FLOOR(x.dist+y.dist-2*sp.lca) AS BIGINT) AS m FROM sp JOIN sd x ON x.plz=sp.plz AND x.node=sp.s JOIN sd y ON y.plz=sp.plz AND y.node=sp.e)"


def streets(v: Views) -> DataFrame:
    return v.x_streets.where("source > 0").select("plz", "source", "target", "cost")


def street_points(v: Views) -> DataFrame:
    return v.x_streets.select("plz", F.col("source").alias("vid"))


def street_costs(v: Views) -> DataFrame:
    return routing.cost_matrix(streets(v), street_points(v), ["plz"])


@query(f"WITH {_STREET_COSTS} SELECT plz, s AS start_vid, e AS end_vid, m AS metres FROM sm")
def cost_matrix(v: Views) -> DataFrame:
    """Costs between all points of a cluster, in whole metres."""
    return street_costs(v).select("plz", "start_vid", "end_vid", F.floor("agg_cost").alias("metres"))


@query("SELECT source AS node, CAST(target AS BIGINT) AS parent FROM x_edges UNION ALL SELECT 0, NULL")
def bfs_tree(v: Views) -> DataFrame:
    """The breadth-first tree of a graph."""
    return routing.bfs_parents(_edges(v), _root(v), ["g"]).select("node", "parent")


@query(f"WITH {_UP}, t AS (SELECT * FROM (VALUES (1,1),(2,2),(4,3)) AS t(vid,place)), d AS (SELECT node, dist, hops FROM up WHERE anc=0), p AS (SELECT a.node AS node, b.node AS vid, MIN(a.hops+b.hops) AS hops FROM up a JOIN up b ON a.anc=b.anc WHERE b.node IN (1,2,4) GROUP BY 1,2), r AS (SELECT p.node, p.vid, p.hops, ROW_NUMBER() OVER (PARTITION BY p.node ORDER BY p.hops, t.place) AS r FROM p JOIN t ON t.vid=p.vid) SELECT node, CAST(vid AS BIGINT) AS source_id, CAST(hops AS INT) AS hops FROM r WHERE r=1")
def nearest_source(v: Views) -> DataFrame:
    """Each bus with the transformer that reaches it in the fewest hops."""
    s = v.spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 4, 3)], "g int, vid long, place int")
    return routing.nearest_source(_edges(v), s, ["g"]).drop("g")


@query("WITH p AS (SELECT x, y FROM x_buildings UNION SELECT x+1, y FROM x_buildings) SELECT ROW_NUMBER() OVER (ORDER BY x, y) AS id, x, y FROM p")
def graph_vertices(v: Views) -> DataFrame:
    """Vertices of a way network, numbered by place."""
    ways = v.x_buildings.select(F.col("osm_id").alias("way_id"), F.array(G.point(F.col("x"), F.col("y")), G.point(F.col("x") + 1, F.col("y"))).alias("line"))
    return routing.topology(ways)[0]


@query("WITH l AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS line_id FROM lineitem), s AS (SELECT g, line_id AS element, line_id%3<>0 AS closed FROM l WHERE line_id%2=1) SELECT l.g, CAST(l.line_id AS BIGINT) AS source, CAST(l.line_id+1 AS BIGINT) AS target FROM l LEFT JOIN s ON s.g=l.g AND s.element=l.line_id WHERE COALESCE(s.closed, TRUE) AND l.line_id<>5")
def switch_aware_edges(v: Views) -> DataFrame:
    """Lines in service without an open switch."""
    lines = v.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("line_id")).distinct()
    lines = lines.withColumns({"from_bus": F.col("line_id"), "to_bus": F.col("line_id") + 1, "length_km": F.lit(1.0), "in_service": F.col("line_id") != 5})
    switches = lines.where("line_id % 2 = 1").select("g", F.lit("l").alias("et"), F.expr("line_id % 3 <> 0").alias("closed"), F.col("line_id").alias("element"))
    return routing.active_edges(lines, switches, ["g"]).select("g", "source", "target")


@query("SELECT g, CAST(MIN(vid) AS BIGINT) AS vid FROM (SELECT plz AS g, MIN(CASE WHEN osm_id%9=0 THEN osm_id END) AS a, MIN(osm_id) AS d FROM x_buildings GROUP BY plz) t, LATERAL (SELECT COALESCE(t.a, t.d) AS vid) GROUP BY g")
def root_resolution(v: Views) -> DataFrame:
    """Root bus by name, else the first one."""
    bus = v.x_buildings.select(F.col("plz").alias("g"), F.col("osm_id").alias("bus"), F.when(F.col("osm_id") % 9 == 0, "LVbus 1").otherwise("b").alias("name"))
    t = v.spark.createDataFrame([], "g int, lv_bus long")
    return routing.root_bus(bus, t, v.spark.createDataFrame([], "g int, bus long"), ["g"])


_ZONES = "z AS (SELECT source AS node, CASE source%5 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Public' ELSE 'SFH' END AS zone, 1+source%3 AS count, (source%11)/100.0e0 AS max_p_mw FROM x_edges)"
_SIMS = "s AS (SELECT u.anc AS node, CASE WHEN zone='SFH' THEN 'Residential' ELSE zone END AS c, SUM(count) AS n, SUM(max_p_mw) AS p FROM up u JOIN z ON z.node=u.node GROUP BY 1,2), f AS (SELECT node, SUM(CASE WHEN p<=0 OR n<=0 THEN 0 ELSE p*(g+(1-g)*POWER(CAST(n AS DOUBLE),-0.75)) END) AS sim, SUM(p) AS p FROM (SELECT *, CASE c WHEN 'Commercial' THEN 0.5e0 WHEN 'Public' THEN 0.6e0 ELSE 0.07e0 END AS g FROM s) GROUP BY node)"


def _zone_loads(v: Views) -> DataFrame:
    return v.x_edges.selectExpr("0 AS g", "source AS node", "CASE source % 5 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Public' ELSE 'SFH' END AS zone", "1 + source % 3 AS count", "(source % 11) / 100.0D AS max_p_mw")


@query(f"WITH {_UP}, {_ZONES}, {_SIMS} SELECT node, ROUND(sim,6) AS sim_load, ROUND(CASE WHEN p>0 THEN sim/p ELSE 0 END,6) AS factor FROM f")
def line_upstream_simultaneity(v: Views) -> DataFrame:
    """Simultaneous load of every line from all below it."""
    out = grid_metrics.upstream_simultaneity(_parents(v), _zone_loads(v), ["g"])
    return out.select("node", F.round("sim_load", 6).alias("sim_load"), F.round("sim_factor_cumulated", 6).alias("factor"))


_PATHS = f"WITH {_UP}, {_ZONES}, {_SIMS}, i AS (SELECT e.source AS node, e.cost/1000 AS km, CASE WHEN f.p>0 AND f.sim>0 THEN f.sim/f.p ELSE 1 END AS k FROM x_edges e LEFT JOIN f ON f.node=e.source), h AS (SELECT node, hops FROM up WHERE anc=0), p AS (SELECT u.node, MAX(CASE WHEN hh.hops=1 THEN u.anc END) AS branch, SUM(i.km*0.225e0*i.k) AS r, SUM(i.km*0.08e0) AS x, MIN(w.count) AS w FROM up u JOIN i ON i.node=u.anc JOIN h hh ON hh.node=u.anc JOIN z w ON w.node=u.node GROUP BY u.node)"


def _tree_paths(v: Views) -> DataFrame:
    sims = grid_metrics.upstream_simultaneity(_parents(v), _zone_loads(v), ["g"]).select("g", "node", "sim_factor_cumulated")
    into = v.x_edges.select(F.lit(0).alias("g"), F.col("source").alias("node"), F.col("target").alias("parent"), (F.col("cost") / 1000).alias("length_km"), F.lit(0.225).alias("r_ohm_per_km"), F.lit(0.08).alias("x_ohm_per_km"), F.lit(False).alias("cabinet"))
    into = into.join(sims, ["g", "node"], "left")
    return grid_metrics.path_impedance(into, _zone_loads(v).select("g", "node", F.col("count").alias("path_weight")), ["g"])


@query(f"{_PATHS} SELECT node, branch, ROUND(r,9) AS r, ROUND(x,9) AS x FROM p")
def path_impedance(v: Views) -> DataFrame:
    """Resistance and reactance of the path to each consumer, and its branch."""
    return _tree_paths(v).select("node", "branch", F.round("r", 9).alias("r"), F.round("x", 9).alias("x"))


@query(f"{_PATHS}, b AS (SELECT branch, SUM(w) AS bw, SUM(w*r) AS br, SUM(w*x) AS bx FROM p GROUP BY branch) SELECT CAST(MAX(bw) AS BIGINT) AS max_branch, ROUND(SUM(br),6) AS resistance, ROUND(SUM(bx),6) AS reactance, ROUND(SUM(br)/SUM(bx),6) AS ratio, ROUND(MAX(br),6) AS max_vsw FROM b")
def vsw(v: Views) -> DataFrame:
    """Impedance metrics of a grid."""
    m = grid_metrics.impedance_metrics(_tree_paths(v), ["g"])
    return m.select(F.col("max_no_of_households_of_a_branch").cast("long").alias("max_branch"), F.round("resistance", 6).alias("resistance"), F.round("reactance", 6).alias("reactance"), F.round("ratio", 6).alias("ratio"), F.round("max_vsw_of_a_branch", 6).alias("max_vsw"))


_SIBLINGS = "k AS (SELECT source AS node, target AS parent, ROW_NUMBER() OVER (PARTITION BY target ORDER BY source)-1 AS i, COUNT(*) OVER (PARTITION BY target) AS n FROM x_edges)"
_TREE = f"WITH RECURSIVE {_SIBLINGS}, r(node, px, share, lvl) AS (SELECT CAST(0 AS BIGINT), WIDTH/2e0, WIDTH, 0 UNION ALL SELECT k.node, r.px-r.share/2+(k.i+0.5e0)*(r.share/k.n), r.share/k.n, r.lvl+1 FROM r JOIN k ON k.parent=r.node)"


def _rounded(layout: DataFrame) -> DataFrame:
    return layout.select("node", F.round("px", 9).alias("px"), F.round("py", 9).alias("py"))


@query(f"{_TREE} SELECT node, ROUND(px,9) AS px, ROUND(-lvl*0.2e0,9) AS py FROM r".replace("WIDTH", "1e0"))
def tree_layout(v: Views) -> DataFrame:
    """Places of a tree's nodes for a drawing, each child in its share of the width."""
    return _rounded(routing.hierarchy_layout(_parents(v), ["g"]))


@query(f"{_TREE} SELECT node, ROUND(-lvl*0.2e0*COS(px-PI()),9)+0e0 AS px, ROUND(-lvl*0.2e0*SIN(px-PI()),9)+0e0 AS py FROM r".replace("WIDTH", "(2e0*PI())"))
def tree_layout_radial(v: Views) -> DataFrame:
    """The same as circles about the root."""
    out = _rounded(routing.radial_layout(_parents(v), ["g"]))
    return out.select("node", (F.col("px") + 0.0).alias("px"), (F.col("py") + 0.0).alias("py"))


@query(f"WITH RECURSIVE {_SIBLINGS}, r(node, lvl, path) AS (SELECT CAST(0 AS BIGINT), 0, CAST([] AS BIGINT[]) UNION ALL SELECT k.node, r.lvl+1, list_append(r.path, k.i) FROM r JOIN k ON k.parent=r.node), t AS (SELECT node, lvl, COUNT(*) OVER (PARTITION BY lvl) AS n, ROW_NUMBER() OVER (PARTITION BY lvl ORDER BY path)-1 AS p, MAX(lvl) OVER () AS deep FROM r) SELECT node, ROUND((p+0.5e0)/n,9) AS px, ROUND(-lvl*(1e0/(deep+1)),9) AS py FROM t")
def tree_layout_spaced(v: Views) -> DataFrame:
    """Nodes of each level in equal distances."""
    return _rounded(routing.spaced_layout(_parents(v), ["g"]))


_KEPT = "RECURSIVE up(node, anc, hops) AS (SELECT source, source, 0 FROM x_edges UNION ALL SELECT 0, 0, 0 UNION ALL SELECT u.node, e.target, u.hops+1 FROM up u JOIN x_edges e ON e.source=u.anc AND e.source%40<>0)"


@query(f"WITH {_KEPT}, p AS (SELECT a.node AS bus, b.node AS vid, MIN(a.hops+b.hops) AS hops FROM up a JOIN up b ON a.anc=b.anc WHERE b.node IN (1,2) GROUP BY 1,2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY bus ORDER BY hops, vid) AS r FROM p) SELECT bus, 'LV_00' || vid AS subnet FROM r WHERE r=1")
def lv_subnets(v: Views) -> DataFrame:
    """Low-voltage buses dealt to their nearest transformer."""
    bus = _parents(v).select("g", F.col("node").alias("bus"), F.concat(F.lit("7"), F.lpad((F.col("node") % 1000).cast("string"), 3, "0"), F.lit("1")).alias("chr_name"))
    lines = v.x_edges.select(F.lit(0).alias("g"), F.col("source").alias("line_id"), F.col("source").alias("from_bus"), F.col("target").alias("to_bus"), F.lit(1.0).alias("length_km"), F.lit(True).alias("in_service"))
    sw = lines.where("line_id % 40 = 0").select("g", F.lit("l").alias("et"), F.lit(False).alias("closed"), F.col("line_id").alias("element"))
    t = v.spark.createDataFrame([(0, 1, 1, True), (0, 2, 2, True), (0, 3, 5, False)], "g int, trafo_id int, lv_bus long, in_service boolean")
    return routing.lv_subnets(bus, lines, sw, t, ["g"]).drop("g")
