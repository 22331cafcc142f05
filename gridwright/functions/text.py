"""Names, classes and documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.config import REGIO5_OF_REGIO7, WAY_CLASSES


def cable_name(name: Column) -> Column:
    """'NAYY 4x120 SE' -> 'NAYY_4_120'."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", "_"), r"(\d)x(\d)", "$1_$2"), r"_?SE$", "")


def mapped(key: Column, table: dict) -> Column:
    """The table's value, null where it has none. The table is a literal map in the plan."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def way_class(kind: Column, other: int = 99) -> Column:
    return F.coalesce(mapped(F.trim(kind), WAY_CLASSES), F.lit(other))


def regio5(regio7: Column) -> Column:
    return mapped(regio7.cast("int"), REGIO5_OF_REGIO7)


def bus_type(name: Column, house: str = "Consumer Nodebus", station: str = "NS_KVS") -> Column:
    """'kvs' before 'house_connection' before 'backbone', by case-insensitive patterns."""
    text = F.coalesce(name, F.lit(""))
    return F.when(text.rlike(f"(?i){station}"), "kvs").when(text.rlike(f"(?i){house}"), "house_connection").otherwise("backbone")


def has_word(name: Column, word: str) -> Column:
    return F.coalesce(name, F.lit("")).contains(word)


def point_json(x: Column, y: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))


def point_of_json(doc: Column) -> Column:
    """struct<x, y> of a GeoJSON point; null fields where it is none."""
    parsed = F.from_json(doc, "type string, coordinates array<double>")
    return F.struct(F.try_element_at(parsed["coordinates"], F.lit(1)).alias("x"), F.try_element_at(parsed["coordinates"], F.lit(2)).alias("y"))


def number(text: Column) -> Column:
    """Double, or null where the text is no number."""
    return text.try_cast("double")


def substation(chr_name: Column) -> Column:
    """Digits 2 to 4 of a low-voltage bus code (leading 7, five digits at least), else null."""
    return F.when(chr_name.startswith("7") & (F.length(chr_name) > 4), F.substring(chr_name, 2, 3))
