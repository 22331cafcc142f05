"""Reports over power-flow results: violations, overloads, losses, summary metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def voltage_violations(res_bus: DataFrame, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Rows with vm_pu outside [low, high], their kind, deviation and deviation in percent of the limit."""
    under = F.col("vm_pu") < low
    out = res_bus.where(under | (F.col("vm_pu") > high))
    out = out.withColumn("kind", F.when(under, "undervoltage").otherwise("overvoltage")).withColumn("limit_pu", F.when(under, low).otherwise(high))
    out = out.withColumn("deviation", F.abs(F.col("vm_pu") - F.col("limit_pu")))
    return out.withColumn("deviation_pct", F.col("deviation") / F.col("limit_pu") * 100)


def line_overloads(res_line: DataFrame, lines: DataFrame, key: list[str], limit: float = 100.0) -> DataFrame:
    """Lines loaded above the limit with their data and the excess in percent points."""
    return res_line.where(F.col("loading_percent") > limit).join(lines, key).withColumn("overload_pct", F.col("loading_percent") - limit)


def network_metrics(res_bus: DataFrame, key: str, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Mean, sample deviation, range and violations of voltages of each grid, in one aggregation."""
    vm = F.col("vm_pu")
    low_n, high_n = F.count_if(vm < low), F.count_if(vm > high)
    return res_bus.groupBy(key).agg(
        F.avg(vm).alias("voltage_mean"),
        F.stddev_samp(vm).alias("voltage_std"),
        F.min(vm).alias("voltage_min"),
        F.max(vm).alias("voltage_max"),
        low_n.alias("voltage_violations_low"),
        high_n.alias("voltage_violations_high"),
        ((low_n + high_n) / F.count("*") * 100).alias("voltage_violation_pct"),
    )


def losses(res_line: DataFrame, res_trafo: DataFrame, res_load: DataFrame, key: str) -> DataFrame:
    """Line, transformer and total losses of each grid, and their share of the load."""
    line = res_line.groupBy(key).agg(F.sum("pl_mw").alias("line_losses_mw"))
    trafo = res_trafo.groupBy(key).agg(F.sum("pl_mw").alias("trafo_losses_mw"))
    load = res_load.groupBy(key).agg(F.sum("p_mw").alias("load_mw"))
    out = load.join(line, key, "left").join(trafo, key, "left").fillna(0.0, ["line_losses_mw", "trafo_losses_mw"])
    out = out.withColumn("total_losses_mw", F.col("line_losses_mw") + F.col("trafo_losses_mw"))
    return out.withColumn("loss_pct", F.when(F.col("load_mw") > 0, F.col("total_losses_mw") / F.col("load_mw") * 100).otherwise(0.0))


def validation_report(res_bus: DataFrame, res_line: DataFrame, res_trafo: DataFrame, res_load: DataFrame, lines: DataFrame, key: str, line_key: list[str]) -> dict[str, DataFrame]:
    """The bundle of all reports by name."""
    return {
        "metrics": network_metrics(res_bus, key),
        "voltage_violations": voltage_violations(res_bus),
        "line_overloads": line_overloads(res_line, lines, line_key),
        "losses": losses(res_line, res_trafo, res_load, key),
    }
