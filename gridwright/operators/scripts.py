"""Grids as the text of a three-phase distribution simulator: circuit, line codes, transformers, lines and loads, one script each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.config import DEFAULT, Config
from gridwright.functions.text import cable_name
from gridwright.operators.cables import fallback_cable

#: Shortest line of a script, in km; shorter ones are drawn out to it.
LEAST_KM = 0.001
#: Fixed values of the script: medium voltage, short-circuit power of the source (MVA), winding losses and reactance in percent.
MV_KV, SHORT_3, SHORT_1, WINDING, REACTANCE = 20.0, 1000, 900, 0.5, 7.0


def line_codes(cables: DataFrame) -> DataFrame:
    """code, r1, x1, r0, x0, norm_amps, emerg_amps of cables (name, r_ohm_per_km, x_ohm_per_km, max_i_ka): zero sequence three times the positive one, a quarter more current in an emergency."""
    amps = F.col("max_i_ka") * 1000
    return cables.select(F.concat(F.lit("LC_"), F.col("name")).alias("code"), F.col("r_ohm_per_km").alias("r1"), F.col("x_ohm_per_km").alias("x1"), (F.col("r_ohm_per_km") * 3).alias("r0"), (F.col("x_ohm_per_km") * 3).alias("x0"), amps.alias("norm_amps"), (amps * 1.25).alias("emerg_amps"))


def coded_lines(lines: DataFrame, cables: DataFrame) -> DataFrame:
    """Lines with ``code`` and ``length`` (km, LEAST_KM at least): the code of their cable, under its usual name, or of the strongest cable of its family.

    Lines whose family has no cable either get a null code.
    """
    known = F.broadcast(cables.select(F.col("name").alias("__known")))  # a handful of equipment rows
    family = F.broadcast(fallback_cable(cables).select(F.col("family").alias("__family"), F.col("name").alias("__strongest")))
    usual = cable_name(F.col("std_type"))
    named = lines.withColumn("__usual", usual).withColumn("__family", F.regexp_extract(F.upper("std_type"), r"(NAYY|NYY)", 1))
    met = named.join(known, F.col("__usual") == F.col("__known"), "left").join(family, "__family", "left")
    code = F.concat(F.lit("LC_"), F.coalesce("__known", "__strongest"))
    return met.withColumn("code", code).withColumn("length", F.greatest("length_km", F.lit(LEAST_KM))).drop("__usual", "__known", "__family", "__strongest")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _bus(bus: Column) -> Column:
    """A bus's name: letters and digits alone, since ids may be negative."""
    return F.concat(F.lit("b"), F.regexp_replace(bus.cast("string"), "-", "m"))


def circuit_scripts(tables: dict[str, DataFrame], cables: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """by, script: the commands that build and solve each grid.

    tables: line (from_bus, to_bus, std_type, parallel, length_km), load (bus, p_mw, q_mvar), trafo (hv_bus,
    lv_bus, sn_mva) and ext_grid (bus). Commands come in a fixed order: circuit, line codes, transformers,
    lines, loads, solution; inside each kind by their text. Lines without a known cable are left out.
    """
    kv = config.nominal_v / 1000
    name = F.concat_ws("_", *[F.concat(F.lit(b[0]), F.regexp_replace(F.col(b).cast("string"), "-", "m")) for b in by])
    number = lambda c: F.format_string("%.9g", c.cast("double"))
    source = tables["ext_grid"].select(*by, F.lit(0).alias("k"), _text("New Circuit.", name, f" basekv={MV_KV} pu=1.0 phases=3 MVASC3={SHORT_3} MVASC1={SHORT_1} bus1=", _bus(F.col("bus"))).alias("c"))
    lines = coded_lines(tables["line"], cables).where("code is not null")
    codes = lines.select(*by, "code").distinct().join(F.broadcast(line_codes(cables)), "code")
    codes = codes.select(*by, F.lit(1).alias("k"), _text("New LineCode.", F.col("code"), " nphases=3 units=km R1=", number(F.col("r1")), " X1=", number(F.col("x1")), " R0=", number(F.col("r0")), " X0=", number(F.col("x0")), " C1=0 C0=0 normamps=", number(F.col("norm_amps")), " emergamps=", number(F.col("emerg_amps"))).alias("c"))
    kva = number(F.col("sn_mva") * 1000)
    trafos = tables["trafo"].select(*by, F.lit(2).alias("k"), _text("New Transformer.t", _bus(F.col("lv_bus")), " phases=3 windings=2 buses=[", _bus(F.col("hv_bus")), " ", _bus(F.col("lv_bus")), f"] conns=[delta wye] kVs=[{MV_KV} {kv}] kVAs=[", kva, " ", kva, f"] %Rs=[{WINDING} {WINDING}] XHL={REACTANCE}").alias("c"))
    ends = _text(_bus(F.col("from_bus")), "_", _bus(F.col("to_bus")))
    wired = lines.withColumn("__i", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("parallel", F.lit(1)).cast("int"), F.lit(1)))))
    wires = wired.select(*by, F.lit(3).alias("k"), _text("New Line.l", ends, "_", F.col("__i").cast("string"), " phases=3 bus1=", _bus(F.col("from_bus")), " bus2=", _bus(F.col("to_bus")), " linecode=", F.col("code"), " units=km length=", number(F.col("length"))).alias("c"))
    loads = tables["load"].select(*by, F.lit(4).alias("k"), _text("New Load.d", _bus(F.col("bus")), f" phases=3 conn=wye model=1 kV={kv} bus1=", _bus(F.col("bus")), " kW=", number(F.col("p_mw") * 1000), " kvar=", number(F.coalesce("q_mvar", F.lit(0.0)) * 1000)).alias("c"))
    last = tables["ext_grid"].select(*by, F.posexplode(F.array(F.lit(f"Set VoltageBases=[{MV_KV}, {kv}]"), F.lit("CalcVoltageBases"), F.lit("Solve"))).alias("k", "c"))
    rows = source.unionByName(codes).unionByName(trafos).unionByName(wires).unionByName(loads).unionByName(last.withColumn("k", F.col("k") + 5))
    whole = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("s"))
    return whole.select(*by, F.concat(F.lit("Clear\n"), F.array_join(F.transform("s", lambda s: s["c"]), "\n"), F.lit("\n")).alias("script"))


def statistics(flow: DataFrame, lines: DataFrame, loads: DataFrame, by: list[str]) -> DataFrame:
    """by, converged, total_power_kw, total_losses_kw, num_buses, num_elements, min_pu, avg_pu, max_pu of solved grids.

    flow: a row per bus as ``power_flow`` gives; the power drawn from the source is load and losses together.
    """
    bus = flow.groupBy(*by).agg(F.bool_and("converged").alias("converged"), (F.sum("pl_mw") * 1000).alias("total_losses_kw"), F.count("*").alias("num_buses"), F.min("vm_pu").alias("min_pu"), F.avg("vm_pu").alias("avg_pu"), F.max("vm_pu").alias("max_pu"))
    load = loads.groupBy(*by).agg((F.sum("p_mw") * 1000).alias("__kw"), F.count("*").alias("__loads"))
    line = lines.groupBy(*by).agg(F.count("*").alias("__lines"))
    out = bus.join(load, by, "left").join(line, by, "left").fillna(0, ["__kw", "__loads", "__lines"])
    return out.select(*by, "converged", (F.col("__kw") + F.col("total_losses_kw")).alias("total_power_kw"), "total_losses_kw", "num_buses", (F.col("__loads") + F.col("__lines")).alias("num_elements"), "min_pu", "avg_pu", "max_pu")
