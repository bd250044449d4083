import pytest
from pyspark.sql import functions as F

from rosterflow.operators import publish

PERSON = "external_id string, first_name string, last_name string, building_id string, door_id string, address_line_1 string, address_line_2 string, city string, state string, zip5 string, longitude double, latitude double"


def square(x, y, size=1.0):
    return [{"x": x + dx, "y": y + dy} for dx, dy in ((0.0, 0.0), (size, 0.0), (size, size), (0.0, size), (0.0, 0.0))]


def drafts(spark, *rings):
    return spark.createDataFrame([(f"d{i}", i, r) for i, r in enumerate(rings)], "turf_draft_id string, sort_order int, ring array<struct<x: double, y: double>>")


def people(spark):
    places = [("a", 0.5, 0.5), ("a", 0.5, 0.5), ("b", 0.25, 0.75), ("c", 2.5, 0.5), ("d", None, None)]
    return spark.createDataFrame([(str(i), "F", "L", b, f"{b}|1", b, None, "City", "ST", "00001", x, y) for i, (b, x, y) in enumerate(places)], PERSON)


def test_publishing_as_one_operation(spark):
    written, none = [], spark.createDataFrame([], "code string")
    two = drafts(spark, square(0.0, 0.0), square(2.0, 0.0))
    got = publish.publish(people(spark), two, none, lambda t: written.extend(t.collect())).orderBy("idx").collect()
    assert [(r.name, r.building_count, r.door_count, r.person_count) for r in got] == [("Turf 1", 2, 2, 3), ("Turf 2", 1, 1, 1)]
    assert [len(r.buildings) for r in sorted(written, key=lambda r: r.idx)] == [2, 1]
    # a code that is taken makes all turfs draw again
    taken = spark.createDataFrame([(got[0].code,)], "code string")
    again = publish.publish(people(spark), two, taken, lambda t: None).collect()
    assert got[0].code not in {r.code for r in again} and len({r.code for r in again}) == 2


def test_nothing_is_written_for_bad_drafts(spark):
    none, written = spark.createDataFrame([], "code string"), []
    for rings in ((square(0.0, 0.0), square(0.0, 0.0, 0.9)), (square(0.0, 0.0), square(7.0, 7.0))):
        with pytest.raises(publish.PublishError):
            publish.publish(people(spark), drafts(spark, *rings), none, written.append)
    assert not written


def test_codes_run_out(spark):
    turfs = spark.createDataFrame([(0, "00000001"), (1, "00000001")], "idx int, code string")
    none = spark.createDataFrame([], "code string")
    with pytest.raises(publish.PublishError):
        publish.coded(turfs, none, 1)
    assert publish.coded(turfs, none).select(F.countDistinct("code")).first()[0] == 2
