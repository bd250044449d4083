import json

import pytest
from pyspark.sql import functions as F

from rosterflow.operators import custom_fields, importer
from rosterflow.sources import files
from rosterflow.sources.lake import Lake, UnknownTableError, export, warm


def test_lake_writes_swaps_and_finds(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, f"{i % 5:05d}") for i in range(100)], "external_id long, zip5 string")
    assert lake.clustered("nyc_v1", "persons_geocoded", rows, "zip5").count() == 100
    more = spark.createDataFrame([(99, "x"), (100, "y")], rows.schema)
    assert lake.insert_missing("nyc_v1", "persons_geocoded", more, "external_id").count() == 101
    assert lake.replace("nyc_v1", "persons_geocoded", lake.read("nyc_v1", "persons_geocoded").where("external_id < 10")).count() == 10
    assert lake.sql("SELECT count(*) FROM {persons_geocoded}", "nyc_v1").first()[0] == 10
    with pytest.raises(UnknownTableError):
        lake.sql("SELECT 1 FROM {secrets}", "nyc_v1")
    lake.finalize("nyc_v1", {"sections": []}, {"rowCount": 10})
    lake.finalize("nyc_v2", {"sections": []}, {"rowCount": 0})
    assert lake.active() == "nyc_v1" and lake.facts("nyc_v1", "derived") == {"rowCount": 10}
    lake.activate("nyc_v2")
    assert lake.active() == "nyc_v2" and "persons_geocoded" in lake.tables("nyc_v1")
    assert warm(lake.read("nyc_v1", "persons_geocoded")) == 1
    assert lake.columns("nyc_v1", "persons_geocoded") == [("external_id", "bigint"), ("zip5", "string")]
    lake.rename("nyc_v1", "persons_geocoded", "people")
    assert lake.read("nyc_v1", "people").count() == 10 and lake.tables("nyc_v1") == ["people"]
    lake.drop("nyc_v1")
    assert lake.tables("nyc_v1") == []
    assert export(rows, f"{tmp_path}/out.csv") == export(rows, f"{tmp_path}/out.parquet", "parquet") == 100


def test_roster_text(spark, tmp_path):
    values = {c: "" for c in files.ROSTER_COLUMNS} | {"last_name": 'O"HARA\u0085 ', "first_name": " José", "sboe_id": "NY1", "status": "A", "res_house_number": "12", "res_street_name": "MAIN ST"}
    line = ",".join('"' + v.replace('"', '""') + '"' for v in values.values())
    (tmp_path / "r.txt").write_bytes(line.encode("latin-1") + b"\n")
    row = files.roster(spark, str(tmp_path / "r.txt")).first()
    assert (row.last_name, row.first_name, row.middle_name, row.sboe_id) == ('O"HARA', "José", None, "NY1")
    person = importer.canonical(files.roster(spark, str(tmp_path / "r.txt"))).first()
    assert (person.address_line_1, person.registration_status) == ("12 MAIN ST", "active")
    assert len(files.ROSTER_COLUMNS) == 47


def test_uploads(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id, support_score \n1,0.5\n2,0.9\n2,0.7\n3,\n")
    parsed = custom_fields.parse_upload(files.upload(spark, str(tmp_path / "u.csv")))
    assert parsed.label == "support_score" and parsed.skipped == 1
    assert sorted(map(tuple, parsed.values.collect())) == [("1", "0.5"), ("2", "0.9")]
    spark.createDataFrame([("1",), ("2",), ("2",)], "id string").coalesce(1).write.parquet(f"{tmp_path}/p")
    one = custom_fields.parse_upload(files.upload(spark, str(next((tmp_path / "p").glob("*.parquet")))), "List", "yes")
    assert one.label == "List" and one.values.count() == 2
    bad = spark.createDataFrame([("1", "a", "b")], "x string, y string, z string")
    with pytest.raises(custom_fields.UploadError):
        custom_fields.parse_upload(bad)
    with pytest.raises(custom_fields.UploadError):
        custom_fields.parse_upload(bad.select("x"))
    with pytest.raises(custom_fields.UploadError, match="no number"):
        custom_fields.validate(bad.select(F.col("y").alias("value")), "number")
    many = spark.range(101).select(F.col("id").cast("string").alias("value"))
    with pytest.raises(custom_fields.UploadError, match="101"):
        custom_fields.validate(many, "enum")


def test_registry_upsert(spark):
    kind = "field_id string, label string, type string, archived boolean"
    known = spark.createDataFrame([("a", "Age", "number", True), ("b", "Tag", "enum", False)], kind)
    asked = spark.createDataFrame([("x", "Age", "number", False), ("c", "New", "text", False)], kind)
    assert sorted(map(tuple, custom_fields.upsert(known, asked).collect())) == [("a", "Age", "number", False), ("b", "Tag", "enum", False), ("c", "New", "text", False)]
    with pytest.raises(custom_fields.UploadError):
        custom_fields.upsert(known, spark.createDataFrame([("x", "Tag", "text", False)], kind))


def test_shapes(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    body = {"features": [{"properties": {"key": "k", "name": "K"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"name": "no key"}, "geometry": {"type": "Polygon", "coordinates": square}}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    rows = files.geojson_polygons(spark, str(tmp_path / "a.json")).collect()
    assert [(r.key, len(r.ring)) for r in rows] == [("k", 5)]
    ways = spark.createDataFrame([(1, [10, 11, 12]), (2, [10, 11])], "id long, refs array<long>")
    nodes = spark.createDataFrame([(10, 0.0, 0.0), (11, 0.0, 1.0), (12, 1.0, 1.0)], "id long, lat double, lon double")
    ring = files.assembled_rings(ways, nodes).collect()
    assert [(r.landuse_id, [(p.x, p.y) for p in r.ring]) for r in ring] == [(1, [(0, 0), (1, 0), (1, 1), (0, 0)])]
    elements = spark.createDataFrame([("node", 1, 1.0, 2.0, {"addr:housenumber": "5", "addr:street": "A"}), ("way", 2, None, None, {"addr:housenumber": "6"}), ("way", 3, None, None, {"addr:housenumber": "7"}), ("node", 4, 1.0, 1.0, {})], "kind string, id long, lat double, lon double, tags map<string, string>")
    centres = spark.createDataFrame([(2, 8.0, 9.0)], "osm_id long, lat double, lon double")
    assert sorted((r.osm_id, r.lat) for r in files.map_addresses(elements, centres).collect()) == [(1, 1.0), (2, 8.0)]
