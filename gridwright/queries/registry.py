"""Adapter views over the star-schema tables, and the table of queries.

An adapter is one SELECT whose text both engines run: Spark over DataFrames, DuckDB as a common table
expression of the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()
ADAPTERS = {
    "x_buildings": """SELECT c_custkey AS osm_id, c_nationkey AS plz,
 CAST((c_custkey*7919)%9973 AS DOUBLE) AS x, CAST((c_custkey*104729)%9967 AS DOUBLE) AS y,
 CASE WHEN c_custkey%11=0 THEN 'AB' WHEN c_mktsegment='HOUSEHOLD' THEN 'SFH' WHEN c_mktsegment='BUILDING' THEN 'MFH'
      WHEN c_mktsegment='MACHINERY' THEN 'TH' WHEN c_mktsegment='AUTOMOBILE' THEN 'Commercial' ELSE 'Public' END AS type,
 CAST(60+(c_custkey*37)%900 AS DOUBLE) AS area, CAST(1+c_custkey%5 AS INT) AS floors,
 CASE WHEN c_custkey%4=0 THEN CAST(1+c_custkey%7 AS INT) END AS households_per_building FROM customer""",
    "x_transformers": """SELECT s_suppkey AS osm_id, s_nationkey AS plz, CAST((s_suppkey*6133+17)%9973 AS DOUBLE) AS x, CAST((s_suppkey*8581+29)%9967 AS DOUBLE) AS y,
 CASE s_suppkey%4 WHEN 0 THEN 250 WHEN 1 THEN 400 WHEN 2 THEN 630 END AS transformer_rated_power FROM supplier""",
    "x_categories": """SELECT * FROM (VALUES ('Commercial',CAST(NULL AS DOUBLE),CAST(79.0 AS DOUBLE),CAST(0.5 AS DOUBLE)),('Public',NULL,29.0,0.6),('SFH',17.425,NULL,0.07),('MFH',17.425,NULL,0.07),('TH',17.425,NULL,0.07),('AB',17.425,NULL,0.07)) AS t(definition,peak_load,peak_load_per_m2,sim_factor)""",
    "x_edges": """SELECT c_custkey AS source, CAST(FLOOR(c_custkey/3.0) AS BIGINT) AS target, CAST(10+(c_custkey*37)%90 AS DOUBLE) AS cost FROM customer WHERE c_custkey>0""",
    "x_register": """SELECT c_custkey AS plz, c_nationkey AS ags, CAST(71+c_custkey%7 AS INT) AS regio7, CAST(500+(c_custkey*97)%20000 AS BIGINT) AS pop, CAST(5+(c_custkey*13)%80 AS DOUBLE) AS area FROM customer""",
    "x_lines": """SELECT l_orderkey AS grid_result_id, l_linenumber AS line_id, CASE l_returnflag WHEN 'A' THEN 'NAYY_4_120' WHEN 'N' THEN 'NAYY_4_150' ELSE 'NAYY_4_185' END AS std_type, CAST(l_quantity AS DOUBLE)/1000 AS length_km, CAST(1+l_linenumber%2 AS INT) AS parallel, l_linestatus='O' AS in_service FROM lineitem""",
    "x_forest": "SELECT source,target,cost FROM x_edges WHERE source%10<>0",
    "x_caps": "SELECT * FROM (VALUES (250),(400),(630),(800)) AS t(kva)",
    "x_features": "SELECT p_partkey AS grid_result_id, CAST(p_size AS DOUBLE) AS f1, CAST(p_retailprice AS DOUBLE) AS f2, CAST(p_partkey%7 AS INT) AS ca, CAST((p_partkey*13)%5 AS INT) AS cb FROM part",
    "x_voltage": "SELECT event_id AS bus, user_id AS grid_result_id, ROUND(0.85+value/1000.0,6) AS vm_pu FROM events",
    "x_municipal": "SELECT plz,ags,regio7,pop,area,pop/area AS pop_den FROM x_register",
    "x_streets": """SELECT plz, osm_id, r AS source, CAST(FLOOR((r-1)/2.0) AS BIGINT) AS target, CAST(10+(osm_id*37)%90 AS DOUBLE) AS cost FROM (SELECT plz, osm_id, ROW_NUMBER() OVER (PARTITION BY plz ORDER BY osm_id)-1 AS r FROM x_buildings) AS t""",
    "x_loads": """SELECT b.osm_id, b.plz, b.x, b.y, b.type, b.area, c.sim_factor,
 COALESCE(b.households_per_building, CASE WHEN b.type IN ('TH','Commercial','Public') THEN 1 WHEN b.type='SFH' THEN CASE WHEN b.area<160 THEN 1 ELSE 2 END ELSE CAST(FLOOR(b.area/50)*b.floors AS INT) END) AS homes,
 c.peak_load, c.peak_load_per_m2 FROM x_buildings b LEFT JOIN x_categories c ON b.type=c.definition""",
    "x_peaks": """SELECT osm_id, plz, x, y, type, area, sim_factor, homes, CASE WHEN type IN ('Commercial','Public') THEN area*peak_load_per_m2/1000 ELSE homes*peak_load END AS kw FROM x_loads""",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _needs(text: str, table: dict) -> list[str]:
    """Adapters that a text names, each after those it needs itself."""
    out: list[str] = []
    for name in table:
        if re.search(rf"\b{name}\b", text):
            for inner in [*_needs(table[name], {k: v for k, v in table.items() if k != name}), name]:
                if inner not in out:
                    out.append(inner)
    return out


def with_adapters(sql: str) -> str:
    """An oracle's SQL with the adapters it names in front. ``sql`` may begin with WITH itself."""
    needed = ", ".join(f"{name} AS ({ADAPTERS[name]})" for name in _needs(sql, ADAPTERS))
    if not needed:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    return f"WITH {'RECURSIVE ' if own and own[1] else ''}{needed}{', ' + sql[own.end():] if own else ' ' + sql}"


class Views:
    """Adapters and tables of a folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in ADAPTERS:
                text = ADAPTERS[name]
                used = {t: getattr(self, t) for t in [*TABLES, *ADAPTERS] if t != name and re.search(rf"\b{t}\b", text)}
                marked = re.sub("|".join(rf"\b{t}\b" for t in used) or "$^", lambda m: "{" + m[0] + "}", text)
                self._made[name] = self.spark.sql(marked, **used)
            else:
                self._made[name] = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._made[name]


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Views. ``sql`` is the oracle, adapters left out."""

    def put(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            ORACLE_SQL[key] = with_adapters(sql)
        return f

    return put
