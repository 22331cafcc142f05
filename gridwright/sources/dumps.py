"""INSERT statements of SQL dumps, split where they end outside of literals, in parallel over the blocks of a file.

A line maps the state in which it is entered (outside or inside a literal) to the state in which it is left: it
keeps, swaps or sets it. These maps are composed inside each block of a file and then over the blocks,
so every line learns its state without one task that reads the file, and what a block leaves unfinished goes on
in the next. Statements are numbered the same way, by counts of the semicolons outside of literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridwright.checkpoints import cut

_BEFORE = (Window.unboundedPreceding, -1)
#: Marks that replace what separates statements, rows and cells outside of literals. The first character is doubled up where a text has it.
_ESC, _END, _OPEN, _CLOSE, _CELL = "\x01", "\x01\x02", "\x01\x04", "\x01\x05", "\x01\x06"


def _outside(text: Column, entered: Column | int) -> Column:
    """Elements between quotes as structs (x, out): ``out`` where they lie outside of literals; a comment and what follows it is cut off."""
    quoted = F.split(text, "'", -1)
    out = lambda k: (k + entered) % 2 == 0
    whole = F.transform(quoted, lambda x, k: F.struct(x.alias("x"), out(k).alias("out"), (out(k) & x.contains("--")).alias("noted")))
    first = F.array_position(F.transform(whole, lambda z: z["noted"]), True)
    kept = F.when(first > 0, F.slice(whole, F.lit(1), first.cast("int"))).otherwise(whole)
    return F.transform(kept, lambda z: F.struct(F.when(z["noted"], F.substring_index(z["x"], "--", 1)).otherwise(z["x"]).alias("x"), z["out"].alias("out"), z["noted"].alias("noted")))


def _left(parts: Column) -> Column:
    """State after a line: 1 inside a literal."""
    return F.when(F.element_at(parts, -1)["out"], 0).otherwise(1)


def _ends(parts: Column) -> Column:
    """Semicolons outside of literals."""
    text = F.array_join(F.transform(F.filter(parts, lambda z: z["out"]), lambda z: z["x"]), " ")
    return (F.length(text) - F.length(F.replace(text, F.lit(";"), F.lit("")))).cast("long")


def _marked(parts: Column, marks: dict[str, str]) -> Column:
    """The text again, the characters of ``marks`` replaced outside of literals."""

    def one(z: Column) -> Column:
        x = F.replace(z["x"], F.lit(_ESC), F.lit(_ESC + "\x03"))
        put = x
        for char, mark in marks.items():
            put = F.replace(put, F.lit(char), F.lit(mark))
        return F.when(z["out"], put).otherwise(x)

    return F.array_join(F.transform(parts, one), "'")


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit(_ESC + "\x03"), F.lit(_ESC))


def _entered(rows: DataFrame, by: list[str], order: str, start: Column) -> DataFrame:
    """``rows`` with ``entered``, the state before each of them, from ``sets`` (a state or null) and ``swaps`` (0 or 1)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(*_BEFORE)
    rows = rows.withColumn("__gw_r", F.coalesce(F.sum("swaps").over(w), F.lit(0)))
    rows = rows.withColumn("__gw_l", F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "__gw_r")), ignorenulls=True).over(w))
    state = F.when(F.col("__gw_l").isNotNull(), F.col("__gw_l.sets") + F.col("__gw_r") - F.col("__gw_l.__gw_r")).otherwise(start + F.col("__gw_r")) % 2
    return rows.withColumn("entered", state.cast("int")).drop("__gw_r", "__gw_l")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """file, number, statement, ended: the statements of dump files in their order; only what a file ends with may lack its ';'.

    Literals stand in single quotes, a quote in them is doubled; comments go from -- to the end of a line. Line ends are
    \\n or \\r\\n and stay as they are inside literals. A statement must fit into one row.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    read = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    zero, one = _left(_outside(F.col("value"), 0)), _left(_outside(F.col("value"), 1))
    lines = cut(read.withColumns({"__gw_0": zero, "__gw_1": one}))
    lines = lines.withColumns({"sets": F.when(F.col("__gw_0") == F.col("__gw_1"), F.col("__gw_0")), "swaps": (F.col("__gw_0") > F.col("__gw_1")).cast("int")}).drop("__gw_0", "__gw_1")
    whole = _entered(lines, ["file", "block"], "line", F.lit(0))
    # a block as a whole: its last line decides what it sets, or whether it swaps
    last = whole.groupBy("file", "block").agg(F.max_by(F.struct("entered", "sets", "swaps"), "line").alias("z"), F.max(F.col("sets").isNotNull()).alias("fixed"))
    after = F.when(F.col("z.sets").isNotNull(), F.col("z.sets")).otherwise((F.col("z.entered") + F.col("z.swaps")) % 2)
    blocks = last.select("file", "block", F.when(F.col("fixed"), after).alias("sets"), F.when(F.col("fixed"), 0).otherwise(after).alias("swaps"))
    blocks = _entered(blocks, ["file"], "block", F.lit(0)).select("file", "block", F.col("entered").alias("first"))
    known = _entered(lines.join(blocks, ["file", "block"]), ["file", "block"], "line", F.col("first"))
    known = known.select("file", "block", "line", _outside(F.col("value"), F.col("entered")).alias("parts"))
    known = cut(known.withColumn("n", _ends(F.col("parts"))))
    before = known.groupBy("file", "block").agg(F.sum("n").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(*_BEFORE)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("file", "block").orderBy("line").rowsBetween(*_BEFORE)), F.lit(0))
    numbered = known.join(before, ["file", "block"]).withColumn("number", F.col("earlier") + inside)
    pieces = numbered.select("file", "block", "line", "number", "n", F.posexplode(F.split(_marked(F.col("parts"), {";": _END}), _END, -1)).alias("k", "piece"))
    pieces = pieces.select("file", (F.col("number") + F.col("k")).alias("number"), F.struct("block", "line", "piece").alias("p"), (F.col("k") < F.col("n")).alias("ended"))
    out = pieces.groupBy("file", "number").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("ended").alias("ended"))
    text = _plain(F.array_join(F.transform("p", lambda p: p["piece"]), "\n"))
    return out.select("file", "number", F.regexp_replace(text, r"^\s+|\s+$", "").alias("statement"), "ended").where("statement <> ''")


def sql_dump(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """Rows of the INSERT statements for one table in dump files.

    Cells go to the columns that the statement names, by position where it names none; columns that it does
    not name are null. A cell that is no value of its column's type, a row with another number of cells and an
    INSERT that the file breaks off are errors.
    """
    name = rf'(?:"?\w+"?\.)?"?{table}"?'
    head = rf"(?is)^INSERT\s+INTO\s+{name}\s*(?:\(([^)]*)\))?\s*VALUES\s*"
    s = statements(spark, path).where(F.col("statement").rlike(rf"(?is)^INSERT\s+INTO\s+{name}[\s(]"))
    s = s.withColumn("statement", F.when(F.col("ended"), F.col("statement")).otherwise(F.raise_error(F.concat(F.lit("an INSERT without its end: "), F.substring("statement", 1, 80)))))
    named = F.regexp_extract("statement", head, 1)
    names = F.when(named != "", F.transform(F.split(F.lower(named), ","), lambda c: F.regexp_replace(c, r'[\s"`]', "")))
    marked = _marked(_outside(F.regexp_replace("statement", head, ""), 0), {"(": _OPEN, ")": _CLOSE, ",": _CELL})
    rows = s.select(names.alias("names"), F.explode(F.slice(F.split(marked, _OPEN, -1), 2, 1 << 30)).alias("r"))
    cells = rows.select("names", F.transform(F.split(F.split("r", _CLOSE, -1)[0], _CELL, -1), lambda c: _plain(F.regexp_replace(c, r"^\s+|\s+$", ""))).alias("cells"))
    fields = StructType.fromDDL(schema).fields
    wanted = F.coalesce(F.size("names"), F.lit(len(fields)))
    wrong = F.raise_error(F.concat(F.lit(f"a row of {table} with "), F.size("cells").cast("string"), F.lit(" cells: "), F.array_join("cells", ", ")))
    cells = cells.withColumn("cells", F.when(F.size("cells") == wanted, F.col("cells")).otherwise(wrong))
    out = []
    for i, f in enumerate(fields):
        at = F.when(F.col("names").isNull(), F.lit(i + 1)).otherwise(F.array_position("names", F.lit(f.name.lower())))
        c = F.when(at > 0, F.try_element_at("cells", F.when(at > 0, at.cast("int")).otherwise(1)))
        text = F.when(F.upper(c) == "NULL", None).when(c.startswith("'"), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit("''"), F.lit("'"))).otherwise(c)
        value = text.try_cast(f.dataType)
        bad = F.raise_error(F.concat(F.lit(f"column {f.name} of {table} holds no {f.dataType.simpleString()}: "), text))
        out.append(F.when(value.isNull() & text.isNotNull(), bad).otherwise(value).alias(f.name))
    return cells.select(*out)
