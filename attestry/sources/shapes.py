"""Shapefiles: geometries as WKT beside their attribute records. One file is one task's row; its records stream out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: fixed values: shape types of the format
TYPES = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint"}


def geometries(content: bytes) -> Iterator[tuple[str, str | None]]:
    """(type, WKT) of each record of a .shp file; measures and heights are dropped."""
    at = 100
    while at + 8 <= len(content):
        size = 2 * struct.unpack_from(">i", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or size < 4:
            raise ValueError("a record is cut off")
        at += 8 + size
        kind = struct.unpack_from("<i", body)[0]
        flat = {11: 1, 13: 3, 15: 5, 18: 8, 21: 1, 23: 3, 25: 5, 28: 8}.get(kind, kind)
        name = TYPES.get(flat)
        if name is None:
            raise ValueError(f"unknown shape type {kind}")
        if flat == 0:
            yield name, None
        elif flat == 1:
            yield name, "POINT (%s %s)" % tuple(_number(v) for v in struct.unpack_from("<2d", body, 4))
        elif flat == 8:
            n = struct.unpack_from("<i", body, 36)[0]
            yield name, "MULTIPOINT (%s)" % _points(body, 40, n)
        else:
            parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
            rings = ", ".join("(%s)" % _points(body, 44 + 4 * parts + 16 * a, b - a) for a, b in zip(starts[:-1], starts[1:], strict=True))
            yield name, f"{'MULTILINESTRING' if flat == 3 else 'POLYGON'} ({rings})"


def _number(v: float) -> str:
    return f"{v:.15g}"


def _points(body: bytes, at: int, n: int) -> str:
    xy = struct.unpack_from(f"<{2 * n}d", body, at)
    return ", ".join(f"{_number(x)} {_number(y)}" for x, y in zip(xy[::2], xy[1::2], strict=True))


def attributes(content: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """Records of a .dbf file as text."""
    rows, head, width = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    for i in range(rows):
        at = head + i * width + 1
        out = {}
        for name, size in fields:
            out[name] = content[at : at + size].decode(encoding, "replace").strip()
            at += size
        yield out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, shape_type, wkt, fields) of every .shp under the path, with the records of the .dbf beside it."""

    def each(kind: str):
        def run(batches):
            for pdf in batches:
                for name, content in zip(pdf["path"], pdf["content"], strict=True):
                    rows = geometries(content) if kind == "shp" else ((x,) for x in attributes(content))
                    out = [(name.rpartition(".")[0], i, *r) for i, r in enumerate(rows)]
                    columns = ["file", "ordinal", "shape_type", "wkt"] if kind == "shp" else ["file", "ordinal", "fields"]
                    yield pd.DataFrame(out, columns=columns)

        return run

    def load(kind: str, schema: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")
        return files.mapInPandas(each(kind), schema)

    shapes = load("shp", "file string, ordinal int, shape_type string, wkt string")
    return shapes.join(load("dbf", "file string, ordinal int, fields map<string,string>"), ["file", "ordinal"], "left")
