"""Shapefiles: geometry records (.shp) and their attributes (.dbf), promoted to multi-part geometries in the planning projection."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import geometry as G

#: Shape types of the format (fixed values); those with heights or measures add 10 or 20.
POINT, LINE, POLYGON, POINTS = 1, 3, 5, 8
_KINDS = {POINT: "MultiPoint", LINE: "MultiLineString", POLYGON: "MultiPolygon", POINTS: "MultiPoint"}
_ROWS = "name string, place long, geom_type string, parts array<array<struct<x: double, y: double>>>, attributes map<string, string>, error string"
#: Reference systems in degrees that differ from each other by less than the data's accuracy.
DEGREES = ("EPSG:4326", "EPSG:4258")


def shape(content: bytes) -> tuple[str | None, list[list[tuple[float, float]]]]:
    """(type, parts) of one record's content; parts are lists of points, for polygons rings. A null shape has type None."""
    (kind,) = struct.unpack_from("<i", content)
    if kind == 0:
        return None, []
    kind %= 10
    if kind not in _KINDS:
        raise ValueError(f"unknown shape type {kind}")
    pairs = lambda at, n: list(zip(*[iter(struct.unpack_from(f"<{2 * n}d", content, at))] * 2, strict=True))
    if kind == POINT:
        return _KINDS[kind], [pairs(4, 1)]
    if kind == POINTS:
        (n,) = struct.unpack_from("<i", content, 36)
        return _KINDS[kind], [pairs(40, n)]
    count, n = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{count}i", content, 44), n]
    points = pairs(44 + 4 * count, n)
    if any(a > b for a, b in zip(starts, starts[1:], strict=False)):
        raise ValueError("parts out of order")
    return _KINDS[kind], [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def records(shp: bytes) -> Iterator[bytes]:
    """Contents of the records of a .shp file."""
    if len(shp) < 100 or struct.unpack_from(">i", shp)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(shp):
        (words,) = struct.unpack_from(">i", shp, at + 4)
        yield shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words


def attributes(dbf: bytes | None, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """Texts by field name of the rows of a .dbf file; blank ones are null."""
    if not dbf:
        return
    count, header, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at, offset = [], 32, 1
    while at + 32 <= header and dbf[at] != 0x0D:
        width = dbf[at + 16]
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), offset, width))
        offset, at = offset + width, at + 32
    for i in range(count):
        row = dbf[header + i * size : header + (i + 1) * size]
        yield {name: row[a : a + w].decode(encoding, "replace").strip(" \0") or None for name, a, w in fields}


def write_shapes(kind: int, features: list[tuple[list[list[tuple[float, float]]], dict]], fields: dict[str, int]) -> tuple[bytes, bytes]:
    """(.shp, .dbf) of lines or polygons with attributes of the given widths."""
    body, box = bytearray(), (0.0, 0.0, 0.0, 0.0)
    for i, (parts, _) in enumerate(features, 1):
        points = [p for part in parts for p in part]
        own = (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points))
        box = own if i == 1 else (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
        starts, at = [], 0
        for part in parts:
            starts.append(at)
            at += len(part)
        content = struct.pack("<i4d2i", kind, *own, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i, len(content) // 2) + content
    shp = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0) + bytes(body)
    head = b"".join(name.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for name, width in fields.items()) + b"\r"
    rows = b"".join(b" " + b"".join(str("" if a.get(n) is None else a[n]).encode()[:w].ljust(w) for n, w in fields.items()) for _, a in features)
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(features), 32 + len(head), 1 + sum(fields.values())) + head + rows + b"\x1a"
    return shp, dbf


def features(files: DataFrame, source: str = "EPSG:3035", encoding: str = "utf-8", skip_failures: bool = False) -> DataFrame:
    """name, place, geom_type, parts, attributes, error of the features of files (name, shp, dbf).

    Geometries are multi-part and in EPSG:3035, whichever of the known systems they come in. A record that cannot be read
    fails the job, or with ``skip_failures`` is a row with its error and no geometry. Files are parsed on the workers and leave
    them a few thousand features at a time.
    """
    if source not in ("EPSG:3035", *DEGREES):
        raise ValueError(f"no way from {source} to EPSG:3035")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for frame in frames:
            for name, shp, dbf in frame[["name", "shp", "dbf"]].itertuples(index=False):
                given = attributes(bytes(dbf) if dbf is not None else None, encoding)
                try:
                    for place, content in enumerate(records(bytes(shp)), 1):
                        try:
                            kind, parts = shape(content)
                            row = (kind, [[{"x": x, "y": y} for x, y in part] for part in parts], None)
                        except (ValueError, struct.error) as wrong:
                            if not skip_failures:
                                raise ValueError(f"{name}, record {place}: {wrong}") from wrong
                            row = (None, None, str(wrong))
                        out.append((name, place, *row[:2], next(given, {}), row[2]))
                        if len(out) >= 4096:
                            yield pd.DataFrame(out, columns=["name", "place", "geom_type", "parts", "attributes", "error"])
                            out = []
                except (ValueError, struct.error) as wrong:
                    if not skip_failures:
                        raise
                    out.append((name, None, None, None, None, str(wrong)))
        if out:
            found = pd.DataFrame(out, columns=["name", "place", "geom_type", "parts", "attributes", "error"])
            yield found.astype({"place": "Int64"})

    found = files.select("name", "shp", "dbf").mapInPandas(run, _ROWS)
    return found.withColumn("parts", projected(F.col("parts"), source))


def projected(parts: Column, source: str) -> Column:
    """Parts in EPSG:3035."""
    if source not in DEGREES:
        return parts

    def moved(p: Column) -> Column:
        x, y = G.to_3035(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(parts, lambda part: F.transform(part, moved))


def read(spark: SparkSession, path: str, source: str = "EPSG:3035", encoding: str = "utf-8", skip_failures: bool = False) -> DataFrame:
    """``features`` of the .shp files below a folder, each with the .dbf file of its name if there is one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").option("recursiveFileLookup", "true").load(path)
    stem, kind = F.regexp_extract("path", r"^(.*)\.[^.]+$", 1), F.regexp_extract("path", r"\.([^.]+)$", 1)
    pick = lambda k: F.max(F.when(kind == k, F.col("content")))
    files = found.groupBy(stem.alias("stem")).agg(pick("shp").alias("shp"), pick("dbf").alias("dbf")).where("shp is not null")
    return features(files.withColumn("name", F.element_at(F.split("stem", "/"), -1)), source, encoding, skip_failures)


def failures(rows: DataFrame) -> DataFrame:
    """name, error, n: what went wrong in each file and how often."""
    return rows.where("error is not null").groupBy("name", "error").agg(F.count("*").alias("n"))
