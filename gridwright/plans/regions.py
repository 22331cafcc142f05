"""From region codes to finished grids in a folder: all postcodes in one plan, and around those that fail.

A run takes every postcode that has no result yet. If the plan fails, its postcodes are halved until those that fail are
alone; these are tried again and then listed with their error, and all others are finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.config import DEFAULT, Config
from gridwright.operators.scans import resolve_regions
from gridwright.plans.generate import Plan, generate

#: Tables of the plan that a run writes, each in a folder by postcode.
WRITTEN = ("grids", "bus", "line", "load", "trafo", "ext_grid", "left_out")
RUNS = "state string, attempt int, error string, plz int"


def postcodes(register: DataFrame, plz: list[int] | None = None, ags: list[int] | None = None) -> list[int]:
    """The postcodes of given codes, ascending; a code that the register lacks is an error."""
    if (plz is None) == (ags is None):
        raise ValueError("give postcodes or municipality codes")
    key, codes = ("plz", plz) if ags is None else ("ags", ags)
    found, missing = resolve_regions(register, register.sparkSession.createDataFrame([(c,) for c in codes], f"{key} {register.schema[key].dataType.simpleString()}"), key)
    if lost := sorted(r[0] for r in missing.collect()):
        raise ValueError(f"the register lacks {key} {lost}")
    return sorted({r["plz"] for r in found.select("plz").collect()})


def runs(spark: SparkSession, path: str) -> DataFrame:
    """state ('done' or 'failed'), attempt, error, plz of a folder's latest runs."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(RUNS).parquet(f"{path}/runs") if there else spark.createDataFrame([], RUNS)


def run_regions(inputs: tuple[DataFrame, DataFrame, DataFrame, DataFrame], codes: list[int], path: str, config: Config = DEFAULT, tries: int = 2, again: bool = False, build: Callable[..., Plan] = generate) -> DataFrame:
    """Write the tables of all postcodes in ``codes`` that are not done yet (all, if ``again``); returns ``runs``.

    inputs: buildings, ways, transformers (each with plz) and categories, as for ``generate``. Results of a postcode replace
    older ones; an interrupted run leaves no postcode marked as done that is not.
    """
    buildings, ways, transformers, categories = inputs
    spark = buildings.sparkSession

    def note(some: list[int], state: str, attempt: int, error: str | None) -> None:
        rows = spark.createDataFrame([(state, attempt, error, p) for p in some], RUNS)
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plz").parquet(f"{path}/runs")

    def write(some: list[int]) -> None:
        wanted = F.broadcast(spark.createDataFrame([(p,) for p in some], "plz int"))  # as many rows as codes were given
        of = lambda df: df.join(wanted, "plz", "left_semi")
        plan = build(of(buildings), of(ways), of(transformers), categories, config)
        for name in WRITTEN:
            plan[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plz").parquet(f"{path}/{name}")

    done = set() if again else {r["plz"] for r in runs(spark, path).where("state = 'done'").select("plz").collect()}
    todo = [(sorted(set(codes) - done), 1)] if set(codes) - done else []
    while todo:
        some, attempt = todo.pop()
        try:
            write(some)
        except Exception as error:  # any fault of one postcode must not stop the others
            if len(some) > 1:
                todo += [(some[: len(some) // 2], 1), (some[len(some) // 2 :], 1)]
            elif attempt < tries:
                todo.append((some, attempt + 1))
            else:
                note(some, "failed", attempt, str(error).strip().split("\n")[0][:500])
        else:
            note(some, "done", attempt, None)
    return runs(spark, path)
