import json
import zipfile

import pytest
from pyspark.sql import functions as F

from locarium.operators import merge as M
from locarium.operators import spatial as S
from locarium.sources import json_sources as J
from locarium.sources import sinks as K
from locarium.streaming import imports as I

DOC = {"fields": [{"key": "id", "type": "text"}, {"key": "name", "type": "text"}, {"key": "lat", "type": "number"}]}


def put(path, rows, bom=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(("﻿" if bom else "") + json.dumps(rows), encoding="utf-8")


def test_read_places(spark, tmp_path):
    put(tmp_path / "a/x.json", [{"id": "1", "name": "é", "lat": 1.5}], bom=True)
    put(tmp_path / "b/c/y.json", [{"id": "2", "name": "", "lat": None}])
    (tmp_path / "schema").write_text(json.dumps(DOC))
    schema = J.read_schema(spark, str(tmp_path / "schema"))
    found = J.read_places(spark, [str(tmp_path / "a"), str(tmp_path / "b")], schema, provenance=True).orderBy("id").collect()
    assert [(r.id, r.name, r.lat) for r in found] == [("1", "é", 1.5), ("2", "", None)]
    assert found[1].file.endswith("y.json")


def test_records_keep_keys_and_types(spark, tmp_path):
    put(tmp_path / "a.json", [{"id": "1", "lat": "12", "odd": None}, 7, {"id": None}, {"id": "2", "lat": -1.5}])
    put(tmp_path / "b.json", {"id": 1})
    r = J.read_records(spark, str(tmp_path))
    assert sorted((x.error or "") for x in r.collect()) == ["", "", "", "not a JSON array", "not an object"]
    f = {x.row_idx: x for x in J.record_fields(r, ["id", "lat"]).collect()}
    assert f[0].unknown == ["odd"] and f[0].lat == "12" and f[2].id is None
    checked = M.validated(J.record_fields(r, ["id", "lat"], ("lat",)), ["id"], ["lat"]).orderBy("row_idx").collect()
    assert [c.errors for c in checked] == [["lat is not a number"], ["missing id"], []]


def test_bad_file_does_not_stop_others(spark, tmp_path):
    put(tmp_path / "a.json", [{"id": "1"}])
    frames, errors = J.read_each(spark, [str(tmp_path / "a.json"), str(tmp_path / "none.json")], lambda s, p: J.read_places(s, p, J.schema_of(DOC)))
    assert len(frames) == 1 and errors[0][0].endswith("none.json")


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    shapes = {"type": "FeatureCollection", "features": [{"properties": {"id": "p"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"id": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [[[9, 9], [10, 9], [9, 10], [9, 9]]]]}}]}
    (tmp_path / "s.geojson").write_text(json.dumps(shapes))
    seg = S.segments_of(J.read_geojson(spark, str(tmp_path / "s.geojson")))
    assert {(r.id, r.part): abs(r.area) for r in S.ring_areas(seg).collect()} == {("p", 0): 16.0, ("m", 0): 16.0, ("m", 1): 0.5}


def test_json_array_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", None)], "id string, n int").orderBy("id")
    path = str(tmp_path / "out/all.json")
    assert K.write_json_array(rows, path) and not K.write_json_array(rows, path)
    assert json.load(open(path)) == [{"id": "a", "n": None}, {"id": "b", "n": 1}]


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    old = spark.createDataFrame([("x", "1", "a"), ("y", "2", "b"), ("z", "3", "c")], "state string, id string, name string")
    K.write_partitions(old, path, ["state"])
    new = old.where("state <> 'z'").withColumn("name", F.when(F.col("state") == "y", "B").otherwise(F.col("name")))
    changed = M.changed_partitions(old, new, ["state"], ["id", "name"])
    assert {r.state: r.change for r in changed.collect()} == {"y": "changed", "z": "orphan"}
    assert [r.state for r in K.write_partitions(new, path, ["state"], changed, dry_run=True).collect()] == ["y"]
    K.write_partitions(new, path, ["state"], changed)
    assert K.delete_orphans(spark, path, ["state"], changed.where("change = 'orphan'")) == 1
    assert {(r.state, r.name) for r in spark.read.json(path).collect()} == {("x", "a"), ("y", "B")}
    with pytest.raises(Exception, match="exist"):
        K.split_to(old, path, ["state"])


def test_csv_xlsx_and_folder(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 2), ("ok", 3)], "a string, b int")
    K.write_csv(rows, str(tmp_path / "csv"))
    assert "'=1+1" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    K.clean_folder(str(tmp_path / "r"))
    (tmp_path / "r/old.txt").write_text("x")
    (tmp_path / "r/.lock").write_text("x")
    K.clean_folder(str(tmp_path / "r"))
    assert [p.name for p in (tmp_path / "r").iterdir()] == [".lock"]
    K.write_xlsx(rows, str(tmp_path / "t.xlsx"), "t")
    sheet = zipfile.ZipFile(tmp_path / "t.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "'=1+1" in sheet and 'state="frozen"' in sheet
    env = json.loads(K.corrections(rows, "f", "2024-01-01T00:00:00+00:00", "h"))
    assert env["change_count"] == 2


def test_stream_import(spark, tmp_path):
    schema = "id string, name string, file_rank int, row_idx int"
    src = str(tmp_path / "src")
    for n, data in enumerate(([("1", "", 0, 0), ("2", "b", 0, 1)], [("1", "a", 1, 0), ("2", "c", 1, 1)])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(src)
        q = I.import_stream(spark.readStream.schema(schema).json(src), str(tmp_path / "store"), ["name"], "fill", str(tmp_path / "ck"))
        q.awaitTermination()
    assert {(r.id, r.name) for r in I.current(spark, str(tmp_path / "store")).collect()} == {("1", "a"), ("2", "b")}
