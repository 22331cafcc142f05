"""Schemas of the stored tables, in Spark's DDL. Geometry: points struct<x, y>, lines and rings arrays of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_POINT = "struct<x: double, y: double>"
_LINE = f"array<{_POINT}>"
_AREA = f"array<{_LINE}>"
_VERSION = "version_id string"

TABLES: dict[str, str] = {
    "version": f"{_VERSION}, version_comment string, created_at timestamp, consumer_categories string, connection_available_cables string, other_parameters string",
    "equipment_data": f"{_VERSION}, name string, s_max_kva int, max_i_a int, r_mohm_per_km int, x_mohm_per_km int, z_mohm_per_km int, cost_eur int, typ string",
    "classification_version": "classification_id int, version_comment string, created_at timestamp, region string",
    "postcode": f"postcode_id int, plz int, allocated_plz int, note string, qkm double, population int, geom {_AREA}",
    "postcode_result": f"{_VERSION}, postcode_result_plz int, geom {_AREA}, house_distance double, avg_households_per_building double, settlement_type int",
    "grid_result": f"grid_result_id long, {_VERSION}, kcid int, bcid int, plz int, transformer_rated_power long, transformer_equipment_name string, transformer_description string, model_status int, ont_vertice_id long, power_flow_status string, grid string",
    "lines_result": f"lines_result_id long, grid_result_id long, geom {_LINE}, line_name string, std_type string, from_bus int, to_bus int, length_km double",
    "consumer_categories": "consumer_category_id int, definition string, peak_load double, yearly_consumption double, peak_load_per_m2 double, yearly_consumption_per_m2 double, sim_factor double",
    "buildings_result": f"{_VERSION}, osm_id string, grid_result_id long, area double, type string, geom {_AREA}, households_per_building int, center {_POINT}, peak_load_in_kw double, vertice_id int, floors int, construction_year string, connection_point int",
    "municipal_register": "plz int, pop long, area double, lat double, lon double, ags long, name_city string, fed_state int, regio7 int, regio5 int, pop_den double",
    "sample_set": "classification_id int, plz int, ags long, bin_no int, bins double, perc_bin double, count double, perc double",
    "clustering_parameters": "grid_result_id long, no_connection_buses int, no_branches int, no_house_connections int, no_house_connections_per_branch double, no_households int, no_household_equ double, no_households_per_branch double, max_no_of_households_of_a_branch double, house_distance_km double, transformer_mva double, osm_trafo boolean, max_trafo_dis double, avg_trafo_dis double, cable_length_km double, cable_len_per_house double, max_power_mw double, simultaneous_peak_load_mw double, resistance double, reactance double, ratio double, vsw_per_branch double, max_vsw_of_a_branch double, filtered boolean",
    "grid_parameters": "grid_result_id long, power_flow_status string, feeder_lines int, buildings_per_feeder double, graph_length double, avg_trafo_distance double, max_trafo_distance double, transformer_mva double, graph_resistance double",
    "transformers": f"osm_id string, area double, type string, transformer_rated_power int, geom_type string, within_shopping boolean, geom {_LINE}",
    "transformer_positions": f"grid_result_id long, geom {_POINT}, osm_id string, {_VERSION}, comment string",
    "transformer_classified": f"grid_result_id long, geom {_POINT}, kmedoid_clusters int, kmedoid_representative_grid boolean, kmeans_clusters int, kmeans_representative_grid boolean, gmm_clusters int, gmm_representative_grid boolean, classification_id int",
    "ags_log": "ags long",
    "ways": f"clazz int, source int, target int, cost double, reverse_cost double, geom {_LINE}, way_id int",
    "ways_result": f"{_VERSION}, clazz int, source int, target int, cost double, reverse_cost double, geom {_LINE}, way_id int, plz int",
    "plz_parameters": f"{_VERSION}, plz int, trafo_num string, cable_length string, load_count_per_trafo string, bus_count_per_trafo string, sim_peak_load_per_trafo string, max_distance_per_trafo string, avg_distance_per_trafo string",
    "res": f"osm_id string, area double, use string, comment string, free_walls int, building_t string, occupants double, floors int, constructi string, refurb_wal double, refurb_roo double, refurb_bas double, refurb_win double, geom {_AREA}",
    "oth": f"osm_id string, area double, use string, comment string, free_walls int, geom {_AREA}",
    "buildings_tem": f"osm_id string, area double, type string, geom {_AREA}, households_per_building int, center {_POINT}, peak_load_in_kw double, plz int, vertice_id int, bcid int, kcid int, floors int, connection_point int, address_street_id long, construction_year string",
    "ways_tem": f"clazz int, source int, target int, cost double, reverse_cost double, geom {_LINE}, way_id int, plz int",
}
#: Children of each table with the key they share: what a delete follows.
CHILDREN: dict[str, tuple[str, list[str]]] = {
    "postcode_result": ("version", ["version_id"]),
    "equipment_data": ("version", ["version_id"]),
    "grid_result": ("version", ["version_id"]),
    "lines_result": ("grid_result", ["grid_result_id"]),
    "buildings_result": ("grid_result", ["grid_result_id"]),
    "clustering_parameters": ("grid_result", ["grid_result_id"]),
    "grid_parameters": ("grid_result", ["grid_result_id"]),
    "transformer_positions": ("grid_result", ["grid_result_id"]),
    "transformer_classified": ("classification_version", ["classification_id"]),
    "sample_set": ("classification_version", ["classification_id"]),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in its order and types; those that ``df`` lacks are null."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])
