import json
from pathlib import Path

import pytest

from rosterflow.operators import contacts, importer, search


def persons(spark, n=25):
    rows = [(f"p{i:03d}", "vr", f"First{i}", "Éclair" if i else None, "1 Main", None, "City", "ST", "00001", None) for i in reversed(range(n))]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in search.DOCUMENT))


def test_documents_in_files_of_few_lines(spark, tmp_path):
    search.write_ndjson(persons(spark), f"{tmp_path}/out", 10)
    files = sorted(Path(f"{tmp_path}/out").glob("part-*"))
    lines = [[json.loads(x) for x in f.read_text().splitlines()] for f in files]
    assert all(len(x) <= 10 for x in lines) and sum(map(len, lines)) == 25
    assert [d["external_id"] for x in lines for d in x] == [f"p{i:03d}" for i in range(25)]
    # nulls are kept, and accents fold in the keys only
    assert lines[0][0]["last_name"] is None and lines[0][1]["last_name"] == "Éclair"
    assert set(lines[0][0]) == {*search.DOCUMENT, "sort_key_hi", "sort_key_lo"}
    assert lines[0][1]["sort_key_hi"] == int.from_bytes(b"ECLAIR F")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="zip4"):
        search.documents(persons(spark).drop("zip4"))


def test_page_counts_all_matches(spark):
    page = search.search(persons(spark), limit=5, last_name="écl")
    assert page.hits.count() == 5 and page.total == 24
    assert search.search(persons(spark), last_name=" ").total == 0


def test_checks_before_an_import(spark):
    rows = spark.createDataFrame([("1",)], "external_id string").select("*", *[search.F.lit("x").alias(c) for c in importer.REQUIRED if c != "external_id"])
    assert importer.validate(rows) is rows
    with pytest.raises(ValueError, match="missing"):
        importer.validate(rows.drop("external_id"))
    with pytest.raises(ValueError, match="no external_id"):
        importer.validate(rows.withColumn("external_id", search.F.lit("")))


def test_cursor_after_a_page(spark):
    events = spark.createDataFrame([("t", 3), ("t", 5), ("u", 9), ("t", 7)], "turf_id string, sequence long")
    rows = contacts.page(events, "t", 3, 1)
    assert contacts.next_cursor(rows, 3) == 5 and contacts.next_cursor(contacts.page(events, "t", 7, 1), 7) == 7
