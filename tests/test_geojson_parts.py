"""One large FeatureCollection in many tasks, against the sequential parse."""

import json
import random

import pytest
from pyspark.sql import functions as F

from deserta.sources.geojson import collection_features, scan_geojson


def collection(r: random.Random, n: int) -> dict:
    """Features whose texts hold braces, quotes and the cutting text itself, keys in any order, objects of other kinds."""
    def text():
        return r.choice(['{"type":"Feature"}', "}{", 'a "Feature" b', "\\", '\\"', "Feature", "täxt 漢", "]},{", "", '"type": '])

    def feature(i):
        items = [("type", "Feature"), ("id", i),
                 ("properties", {"NAME_1": text(), "NAME_2": f"d{i}", "type": "Feature", "more": [{"type": "Feature"}, {"x": text()}],
                                 "kind": r.choice(["Feature", None, {"a": {"type": "Feature", "b": text()}}])}),
                 ("geometry", {"type": "Polygon", "coordinates": [[[i, 0.5], [i + 1.0, 0.5], [i, 2], [i, 0.5]]]})]
        if i % 5 == 0:
            items.append(("title", "Feature"))  # at a feature's own depth, but not its type
        if i % 11 == 0:
            items[3] = ("geometry", {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}]})
        r.shuffle(items)
        return dict(items)

    around = [("type", "FeatureCollection"), ("features", [feature(i) for i in range(n)]),
              ("crs", {"type": "name", "properties": {"name": "Feature", "type": "Feature"}, "note": "Feature"}), ("bbox", [1, 2])]
    r.shuffle(around)
    return dict(around)


@pytest.mark.parametrize("size", [90, 700, 1 << 20])
def test_parts_equal_the_sequential_parse(spark, tmp_path, size):
    want, number = {}, 0
    for name in ("a", "b", "c"):
        r = random.Random(name)
        doc = collection(r, {"a": 60, "b": 0, "c": 25}[name])
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=r.choice([None, 1]), ensure_ascii=name == "a"), encoding="utf-8")
        for f in doc["features"]:
            want[number] = f
            number += 1
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(size))
        df = collection_features(spark, str(tmp_path))
        got = [(r["feature_index"], json.loads(r["text"])) for r in df.collect()]
        tasks = spark.read.option("lineSep", '"Feature"').text(str(tmp_path)).rdd.getNumPartitions()
        rows = {r["feature_index"]: r["NAME_2"] for r in scan_geojson(spark, str(tmp_path)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == len(want) and dict(got) == want
    assert rows == {i: f["properties"]["NAME_2"] for i, f in want.items()}
    assert size > 700 or tasks > 20


def test_a_large_collection_is_read_by_many_tasks(spark, tmp_path):
    ring = json.dumps([[[x / 7, x / 9] for x in range(400)]])
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i in range(3000):
            f.write(("," if i else "") + f'{{"type":"Feature","properties":{{"NAME_2":"d{i}"}},"geometry":{{"type":"Polygon","coordinates":{ring}}}}}')
        f.write("]}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
        df = scan_geojson(spark, str(tmp_path))
        spread = df.select("feature_index", "NAME_2", F.spark_partition_id().alias("p"), F.size(F.col("geometry")[0][0]).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["NAME_2"], r["n"]) for r in sorted(spread, key=lambda r: r["feature_index"])] == [(f"d{i}", 400) for i in range(3000)]
    assert len({r["p"] for r in spread}) > 8
