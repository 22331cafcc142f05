"""Changes of tables as new DataFrames: upsert, insert if absent, update from a join, delete, cascades.

Tables are immutable here; a change gives the table's next state, to be written over the old one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.hashing import digits
from gridwright.operators import numbering
from gridwright.operators.groups import spread_join


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with the same key, the other rows as they were. Keys of ``new`` should be unique."""
    return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def insert_absent(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``table`` and the rows of ``new`` whose key it lacks."""
    return table.unionByName(new.join(table.select(*key), key, "left_anti").select(*table.columns))


def update_from(table: DataFrame, source: DataFrame, on: list[str], values: dict[str, str]) -> DataFrame:
    """Columns named by ``values`` take the source's columns where a row matches. Source keys should be unique."""
    marked = source.select(*on, *[F.col(c).alias(f"__new_{k}") for k, c in values.items()], F.lit(True).alias("__hit"))
    out = table.join(marked, on, "left")
    changed = {k: F.when(F.col("__hit"), F.col(f"__new_{k}")).otherwise(F.col(k)) for k in values}
    return out.withColumns(changed).select(*table.columns)


def fill_nulls(table: DataFrame, column: str, value) -> DataFrame:
    return table.withColumn(column, F.coalesce(F.col(column), value if isinstance(value, Column) else F.lit(value)))


def assign_where(table: DataFrame, condition: Column, **values) -> DataFrame:
    """Columns set to constants where the condition holds; where it is null, nothing changes."""
    return table.withColumns({k: F.when(condition, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or null stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def keep_first(table: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row of each key: the first by ``order``, which should be total."""
    return table.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__at = 1").drop("__at")


def cascade_delete(tables: dict[str, DataFrame], parent: str, gone: DataFrame, links: dict[str, tuple[str, list[str]]]) -> dict[str, DataFrame]:
    """All tables without the parent rows in ``gone`` and without rows that depend on them.

    links: child -> (its parent, key columns). ``gone`` holds key columns of ``parent``.
    """
    out = dict(tables)
    removed = {parent: tables[parent].join(gone, gone.columns, "left_semi")}
    out[parent] = tables[parent].join(gone, gone.columns, "left_anti")
    todo = [parent]
    while todo:
        above = todo.pop()
        for child, (its, key) in links.items():
            if its == above:
                dead = removed[above].select(*key).distinct()
                removed[child] = tables[child].join(dead, key, "left_semi")
                out[child] = out[child].join(dead, key, "left_anti")
                todo.append(child)
    return out


def numbered(new: DataFrame, order: list, start: int = 1, name: str = "id", within: list[str] | None = None) -> DataFrame:
    """Ids from ``start`` in a total order, per group where ``within`` is given."""
    if not within:
        return numbering.numbered(new, order, name, start)
    at = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return new.withColumn(name, (at + F.lit(start - 1)).cast("long"))


def publish(buildings: DataFrame, grids: DataFrame, key: list[str]) -> DataFrame:
    """Buildings with the id of their grid, without excluded (0) and transformer (-1) rows."""
    return spread_join(buildings.where(~F.col("peak_load_in_kw").isin(0.0, -1.0)), grids.select(*key, "grid_result_id"), key)


def split_by_percentage(rows: DataFrame, shares: dict[int, float], key: str, name: str, seed: int = 42) -> DataFrame:
    """``name`` set to the given values in the given percentages, by a hash order of the key; what rounding leaves goes to the largest share."""
    total = rows.count()
    placed = numbering.numbered(rows, [digits(key, seed), F.col(key)], "__at")
    most = max(shares, key=lambda k: (shares[k], k))
    bounds, below = [], 0
    for k in (k for k in shares if k != most):
        below += math.floor(total * shares[k] / 100)
        bounds.append((k, below))
    value = F.lit(most)
    for k, limit in reversed(bounds):
        value = F.when(F.col("__at") <= limit, F.lit(k)).otherwise(value)
    return placed.withColumn(name, value).drop("__at")


def refuse_existing(version: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``version`` and ``new``; fails when it is run if a key of ``new`` is there already."""
    clash = new.join(version.select(key), key, "left_semi").agg(F.count("*").alias("__c"))
    checked = new.crossJoin(F.broadcast(clash)).withColumn(key, F.when(F.col("__c") > 0, F.raise_error(F.lit(f"{key} exists already")).cast(new.schema[key].dataType)).otherwise(F.col(key))).drop("__c")
    return version.unionByName(checked)
