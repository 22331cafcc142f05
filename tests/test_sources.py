import zipfile

import pytest
from pyspark.sql import functions as F

from gridwright import schemas
from gridwright.operators import dml, scans
from gridwright.sources import files, sinks, workbooks


def test_workbook_round_trip(spark, tmp_path):
    rows = [(1, "a & <b>", 2.5), (2, None, None), (3, " x ", -1e6)]
    raw = workbooks.write_sheets({"one": (["id", "name", "v"], rows), "two": (["k"], [(9,)])})
    assert workbooks.read_sheet(raw, "one")[0] == ["id", "name", "v"]
    assert workbooks.read_sheet(raw, "two") == [["k"], ["9"]]
    with pytest.raises(KeyError):
        workbooks.read_sheet(raw, "three")
    (tmp_path / "r.xlsx").write_bytes(raw)
    got = workbooks.excel(spark, str(tmp_path / "*.xlsx"), {"v": "double", "id": "int", "missing": "string"}, "one").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(2.5, 1, None), (None, 2, None), (-1e6, 3, None)]


def test_shared_strings_are_read():
    import io

    raw = workbooks.write_sheets({"s": (["h"], [(1,)])})
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            data = z.read(n)
            if n.endswith("sheet1.xml"):
                data = f'<worksheet xmlns="{main}"><sheetData><row><c r="B1" t="s"><v>0</v></c></row></sheetData></worksheet>'.encode()
            w.writestr(n, data)
        w.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>ab</t></r><r><t>c</t></r></si></sst>')
    assert workbooks.read_sheet(out.getvalue()) == [[None, "abc"]]


def test_geojson_geometries(spark, tmp_path):
    (tmp_path / "f.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"p","geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]},"properties":{"power":"substation"}},{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]},"properties":{"id":"m"}}]}')
    f = files.geojson(spark, str(tmp_path / "f.geojson")).withColumn("parts", files.lines_of(F.col("coordinates"), F.col("geom_type")))
    got = {r["id"]: r["parts"] for r in f.collect()}
    assert len(got["p"]) == 1 and got["p"][0][1].asDict() == {"x": 2.0, "y": 0.0}
    assert len(got["m"]) == 2 and got["m"][1][0].asDict() == {"x": 5.0, "y": 5.0}


def test_files_by_code(spark, tmp_path):
    for n in ("09162_Res.shp", "09163_Oth.shp", "none.shp"):
        (tmp_path / n).write_text("x")
    got = {(r["code"], r["table"]) for r in files.files_of(spark, str(tmp_path), [9162, 9163], "*.shp").collect()}
    assert got == {(9162, "res"), (9163, "oth")}


def test_transformer_sites(spark):
    ring = "array<struct<x: double, y: double>>"
    square = lambda x: [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0), (x, 0.0)]
    sites = spark.createDataFrame([("a", 1.0, 1.0, 0.0, None, True), ("b", 50.0, 50.0, 0.0, "20000", True), ("c", 52.0, 50.0, 0.0, "n/a", True), ("d", 90.0, 90.0, 30.0, None, False), ("e", 200.0, 5.0, 80.0, "110000", False), ("f", 305.0, 5.0, 80.0, None, False)], "id string, x double, y double, area double, voltage string, is_point boolean")
    covering = spark.createDataFrame([(1, square(0.0))], f"area int, ring {ring}")
    shops = spark.createDataFrame([(1, square(300.0))], f"area int, ring {ring}")
    got = {r["id"]: r["within_shopping"] for r in files.transformer_sites(sites, covering, shops).collect()}
    assert got == {"c": False, "f": True}


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, dml.upsert(t, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, dml.insert_absent(t, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert dml.delete_where(t, F.lit(None).cast("boolean")).count() == 2
    with pytest.raises(Exception, match="exists already"):
        dml.refuse_existing(t, new, "k").collect()
    assert scans.exists(t, k=[1, 5]) and not scans.exists(t, k=None)


def test_schemas_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "way_id int, plz int, version_id string")
    sinks.append(rows, "ways_result", path, ["plz"])
    sinks.overwrite_partitions(rows.where("plz = 5").withColumn("way_id", F.lit(9)), "ways_result", path, ["plz"])
    assert sorted((r["way_id"], r["plz"]) for r in spark.read.parquet(path).collect()) == [(2, 6), (9, 5)]
    for t in schemas.TABLES:
        assert schemas.empty(spark, t).count() == 0
    assert sinks.duplicates(rows, ["version_id"]).count() == 0
    assert sinks.orphans(rows, rows.where("plz = 5"), ["plz"]).count() == 1


def test_table_function(spark):
    from gridwright.functions.registered import register

    assert "split_way" in register(spark)
    got = spark.sql("SELECT * FROM split_way(array(0.0D, 10.0D), array(0.0D, 0.0D), array(0.4D, 0.4D, 0.0D, 0.7D))").collect()
    assert [round(r["length"], 6) for r in got] == [4.0, 3.0, 3.0]


def test_jdbc_query(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    rows = spark.createDataFrame([(1, "a", 10.5), (2, "b", 20.5), (3, None, 30.5)], "id int, use_of string, area double")
    rows.write.jdbc(url, "buildings", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = files.jdbc(spark, url, 'SELECT "id", "use_of" FROM buildings WHERE "area" > 15', driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(map(tuple, got.collect())) == [(2, "b"), (3, None)]
    assert "PushedFilters" in got.where("id = 2")._jdf.queryExecution().toString() and [r["id"] for r in got.where("id = 2").collect()] == [2]


def test_jdbc_by_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/ranges;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(i * 7, float(i)) for i in range(100)] + [(None, -1.0)]
    spark.createDataFrame(rows, "ID int, AREA double").coalesce(1).write.jdbc(url, "buildings", properties={"driver": driver})
    got = files.jdbc(spark, url, 'SELECT "ID" AS ID, "AREA" AS AREA FROM buildings WHERE "AREA" < 90', "ID", 5, driver=driver)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[1] < 90), key=str)
    assert got.rdd.getNumPartitions() == 5 and min(got.rdd.glom().map(len).collect()) >= 17
    assert files.jdbc(spark, url, 'SELECT "ID" AS ID FROM buildings WHERE "AREA" > 900', "ID", 5, driver=driver).count() == 0


def test_shapefiles(spark, tmp_path):
    from gridwright.sources import shapefiles

    ring = lambda x: [(x, 48.0), (x, 48.1), (x + 0.1, 48.1), (x, 48.0)]
    shp, dbf = shapefiles.write_shapes(shapefiles.POLYGON, [([ring(10.0)], {"use": "Wohnen ü", "no": 1}), ([ring(11.0), ring(12.0)], {"use": None, "no": 2})], {"use": 12, "no": 5})
    (tmp_path / "a_Res.shp").write_bytes(shp)
    (tmp_path / "a_Res.dbf").write_bytes(dbf)
    line, _ = shapefiles.write_shapes(shapefiles.LINE, [([[(0.0, 1.0), (2.0, 3.0)]], {})], {})
    (tmp_path / "b.shp").write_bytes(line)
    got = {(r["name"], r["place"]): r for r in shapefiles.read(spark, str(tmp_path), "EPSG:4326").collect()}
    assert set(got) == {("a_Res", 1), ("a_Res", 2), ("b", 1)}
    assert got[("a_Res", 1)]["geom_type"] == "MultiPolygon" and got[("b", 1)]["geom_type"] == "MultiLineString"
    assert got[("a_Res", 1)]["attributes"] == {"use": "Wohnen ü", "no": "1"} and got[("a_Res", 2)]["attributes"] == {"use": None, "no": "2"} and got[("b", 1)]["attributes"] == {}
    assert [len(p) for p in got[("a_Res", 2)]["parts"]] == [4, 4]
    first = got[("a_Res", 1)]["parts"][0][0]
    assert first["x"] == pytest.approx(4321000.0, abs=1) and 2_700_000 < first["y"] < 2_800_000
    plain = {(r["name"], r["place"]): r for r in shapefiles.read(spark, str(tmp_path)).collect()}
    assert plain[("b", 1)]["parts"][0][1].asDict() == {"x": 2.0, "y": 3.0}
    with pytest.raises(ValueError, match="no way"):
        shapefiles.read(spark, str(tmp_path), "EPSG:1")


def test_broken_shapes_are_skipped_and_counted(spark, tmp_path):
    from gridwright.sources import shapefiles

    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    shp, dbf = shapefiles.write_shapes(shapefiles.POLYGON, [([ring], {"k": i}) for i in range(3)], {"k": 3})
    at = 100 + 2 * int.from_bytes(shp[104:108], "big") + 8 + 8
    (tmp_path / "x.shp").write_bytes(shp[:at] + b"\x63" + shp[at + 1 :])
    (tmp_path / "x.dbf").write_bytes(dbf)
    (tmp_path / "y.shp").write_bytes(b"nothing")
    rows = shapefiles.read(spark, str(tmp_path), skip_failures=True)
    good = rows.where("error is null").collect()
    assert sorted((r["place"], r["attributes"]["k"]) for r in good) == [(1, "0"), (3, "2")]
    assert {(r["name"], r["n"]) for r in shapefiles.failures(rows).collect()} == {("x", 1), ("y", 1)}
    with pytest.raises(Exception, match="record 2|not a shapefile"):
        shapefiles.read(spark, str(tmp_path)).collect()


def test_catalogue(spark):
    spark.sql("DROP DATABASE IF EXISTS gw_cat CASCADE")
    sinks.create_schema(spark, "gw_cat")
    try:
        assert set(sinks.tables(spark, "gw_cat")) == {t.lower() for t in schemas.TABLES}
        for name in ("buildings_tem_80805", "ways_tem_1_vertices", "buildings_tem_x"):
            spark.range(1).write.saveAsTable(f"gw_cat.{name}", format="parquet")
        assert sinks.drop_orphans(spark, "gw_cat", ["buildings_tem", "ways_tem"]) == ["buildings_tem_80805", "ways_tem_1_vertices"]
        assert {"buildings_tem", "buildings_tem_x"} <= set(sinks.tables(spark, "gw_cat"))
        got = sinks.columns(spark, ["gw_cat.buildings_tem_x"]).collect()
        assert [(r["column_name"], r["position"]) for r in got] == [("id", 1)]
        sinks.create_schema(spark, "gw_cat", replace=True)
        assert "buildings_tem_x" not in sinks.tables(spark, "gw_cat")
    finally:
        spark.sql("DROP DATABASE IF EXISTS gw_cat CASCADE")
    sinks.views(spark, {"gw_view": spark.range(3)})
    assert spark.sql("SELECT count(*) FROM gw_view").first()[0] == 3
    sinks.drop_views(spark, ["gw_view", "gw_none"])
    assert "gw_view" not in [t.name for t in spark.catalog.listTables()]
