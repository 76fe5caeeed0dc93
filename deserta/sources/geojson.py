"""GeoJSON boundaries -> one row per feature (feature_index, NAME_1, NAME_2, geometry as MultiPolygon).

A FeatureCollection is read in parts: Spark's text reader cuts the file into byte ranges at the text ``"Feature"``, which
every feature holds as its type, so that one large file is many tasks and any file system that Spark reads will do. Two
passes over the pieces find the features:

1. each byte range reports how deep its objects end compared with its begin, and how many types of features it holds at each
   depth; these reports, one per range, are added up in order of the files and ranges, which gives every range the depth at
   which it begins and the number of its first feature;
2. each range then cuts out its features, the objects at depth two with that type. A feature that begins in one range and
   ends in another is put together from its two pieces by its number.

Features of several collections are numbered on through the files in order of their names, so an index is unique. For one
Feature per line (GeoJSON text sequence) use ``fmt="lines"``: line features take their GeoJSON ``id`` as index if it is an
integer, else a hash of names and geometry: neither changes with the split layout, and equal features share one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from deserta.operators.polygon import wrap_polygon

_FEATURE = StructType([
    StructField("type", StringType()), StructField("id", StringType()),
    StructField("properties", StructType([StructField("NAME_1", StringType()), StructField("NAME_2", StringType())])),
    StructField("geometry", StructType([StructField("type", StringType()), StructField("coordinates", StringType())])),
])


_TYPE = '"Feature"'
#: Strings, whole or cut off by the end of a piece, and the braces outside them. A piece begins outside a string.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.S)
_IS_TYPE = re.compile(r'"type"\s*:\s*$')


def _depths(piece: str, depth: int):
    """(position, depth after it, opens) of every brace of a piece that begins at ``depth``."""
    for m in _MARKS.finditer(piece):
        if m.group() in "{}":
            depth += 1 if m.group() == "{" else -1
            yield m.start(), depth, m.group() == "{"


def _reports(batches):
    """Per byte range: change of depth; per relative depth the feature types, those since the last object there opened, and
    whether one opened."""
    held = {}
    for batch in batches:
        for file, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
            depth, types, since, opened = held.get((file, block), (0, {}, {}, set()))
            for _, depth, opens in _depths(piece, depth):
                if opens:
                    opened.add(depth)
                    since[depth] = 0
            if _IS_TYPE.search(piece[-99:]):
                types[depth] = types.get(depth, 0) + 1
                since[depth] = since.get(depth, 0) + 1
            held[file, block] = depth, types, since, opened
    for (file, block), (depth, types, since, opened) in held.items():
        levels = sorted({*types, *since, *opened})
        yield pa.RecordBatch.from_pydict({
            "file": [file], "block": pa.array([block], pa.int64()), "delta": pa.array([depth], pa.int64()),
            "level": pa.array([levels], pa.list_(pa.int64())), "types": pa.array([[types.get(d, 0) for d in levels]], pa.list_(pa.int64())),
            "since": pa.array([[since.get(d, 0) for d in levels]], pa.list_(pa.int64())),
            "opened": pa.array([[d in opened for d in levels]], pa.list_(pa.bool_()))})


def _begins(reports) -> dict:
    """(depth, number of the next feature, whether the open object has its type) at the begin of every byte range."""
    begins, number, last, depth, typed = {}, 0, None, 0, False
    for r in sorted(reports, key=lambda r: (r["file"], r["block"])):
        if r["file"] != last:
            last, depth, typed = r["file"], 0, False
        begins[r["file"], r["block"]] = depth, number, typed
        at = {d: (t, s, o) for d, t, s, o in zip(r["level"], r["types"], r["since"], r["opened"])}
        types, since, opened = at.get(2 - depth, (0, 0, False))
        number, depth, typed = number + types, depth + r["delta"], bool(since) if opened else typed or types > 0
    return begins


def _cut(begins: dict):
    """The pieces' features: (number, file, block, text, whether it begins and ends in its byte range)."""
    def run(batches):
        at, out = None, []
        depth = number = typed = text = begun = None

        def emit(ends: bool) -> None:
            out.append((number - 1 if typed else number, *at, "".join(text), begun, ends))

        for batch in batches:
            for file, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fresh = (file, block) != at
                if fresh:
                    if at and depth >= 2:
                        emit(False)
                    at = file, block
                    depth, number, typed = begins[at]
                    text, begun = [], False
                if depth >= 2 and not (fresh and block == 0):
                    text.append(_TYPE)
                start = 0
                for place, now, opens in _depths(piece, depth):
                    if opens and now == 2:
                        start, text, begun, typed = place, [], True, False
                    elif not opens and now == 1:
                        text.append(piece[start:place + 1])
                        if typed:
                            emit(True)
                    depth = now
                if depth >= 2:
                    text.append(piece[start:])
                    if depth == 2 and _IS_TYPE.search(piece[-99:]):
                        number, typed = number + 1, True
            if out:
                yield _rows(out)
                out = []
        if at and depth >= 2:
            emit(False)
        if out:
            yield _rows(out)

    return run


def _rows(out: list) -> pa.RecordBatch:
    kinds = (("feature_index", pa.int64()), ("file", pa.string()), ("block", pa.int64()), ("text", pa.string()), ("begun", pa.bool_()), ("ended", pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])


def collection_features(spark: SparkSession, path: str) -> DataFrame:
    """(feature_index, text) of every feature of the collections at ``path``, numbered in order of file names and place."""
    pieces = spark.read.option("lineSep", _TYPE).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    reports = pieces.mapInArrow(_reports, "file string, block long, delta long, level array<long>, types array<long>, "
                                          "since array<long>, opened array<boolean>").collect()  # a row per byte range
    cut = pieces.mapInArrow(_cut(_begins(reports)), "feature_index long, file string, block long, text string, "
                                                   "begun boolean, ended boolean")
    whole = "begun AND ended"
    parts = cut.where(f"NOT ({whole})").groupBy("feature_index").agg(
        F.sort_array(F.collect_list(F.struct("file", "block", "text", "begun", "ended"))).alias("p"))  # the ranges of one feature
    at = "struct(x.file, x.block)"  # an object of another kind before a feature has left pieces without an end
    last = f"array_max(transform(filter(p, x -> x.begun), x -> {at}))"
    joined = parts.where("exists(p, x -> x.ended)").selectExpr(
        "feature_index", f"array_join(transform(filter(p, x -> {at} >= {last}), x -> x.text), '') AS text")
    return cut.where(whole).select("feature_index", "text").unionByName(joined)


def scan_geojson(spark: SparkSession, path: str, fmt: str = "collection") -> DataFrame:
    if fmt == "collection":
        feats = collection_features(spark, path).select("feature_index", F.from_json("text", _FEATURE).alias("f"))
    elif fmt == "lines":
        feats = spark.read.schema(_FEATURE).json(path).select(
            F.coalesce(F.col("id").try_cast("long"), F.xxhash64("properties", "geometry")).alias("feature_index"),
            F.struct("*").alias("f"))
    else:
        raise ValueError(fmt)
    return feats.select(
        F.col("feature_index").cast("long").alias("feature_index"),
        F.col("f.properties.NAME_1").alias("NAME_1"), F.col("f.properties.NAME_2").alias("NAME_2"),
        wrap_polygon(F.col("f.geometry.coordinates"), F.col("f.geometry.type")).alias("geometry"),
    )


def to_geojson_features(boundaries: DataFrame) -> DataFrame:
    """Rows -> one GeoJSON Feature (text) per row, MultiPolygon geometry, its index as the feature's id."""
    return boundaries.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("feature_index").alias("id"),
        F.struct(F.col("NAME_1"), F.col("NAME_2")).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometry").alias("coordinates")).alias("geometry"),
    )).alias("value"))
