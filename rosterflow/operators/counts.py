"""What matching persons add up to: counts, waterfalls, per-area counts, samples, exports, map points."""

import json
import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import Compiled, fold

EXPORT_COLUMNS = {
    "external_id": True, "external_id_type": True, "first_name": True, "middle_name": False, "last_name": True, "name_suffix": False,
    "address_line_1": True, "address_line_2": True, "city": True, "state": True, "zip5": True, "zip4": False,
}
INTERNAL_COLUMNS = ("building_id", "building_i", "door_id", "door_i", "person_h", "matched_tokens", "election_mask_0", "election_mask_1", "latitude", "longitude")


def totals(matching: DataFrame) -> DataFrame:
    """One row: persons, doors and buildings."""
    return matching.agg(F.count("*").alias("person_count"), F.countDistinct("door_i").alias("door_count"), F.countDistinct("building_i").alias("building_count"))


def person_count(persons: DataFrame, compiled: Compiled) -> DataFrame:
    return totals(compiled.filter(persons))


def cascade(persons: DataFrame, compiled: Compiled, steps: list) -> DataFrame:
    """step, persons, delta: counts after each prefix of the steps; step 0 is everyone.

    Each step's clause is projected once, and prefixes are conditional counts
    of one scan. Only rows that some prefix can match are scanned: those of the
    first clause or of a later ``add``. Everyone is counted apart, from the
    files' row counts.
    """
    names, given = [], []
    for i, (verb, clause) in enumerate(steps):
        if clause is not None:
            names.append((f"__c{i}", clause))
        given.append((verb, f"__c{i}" if clause is not None else None))
    active = [(verb, name) for verb, name in given if name is not None]
    reach = None
    if active and active[0][0] != "remove":
        parts = [F.col(active[0][1])] + [F.col(n) for v, n in active[1:] if v == "add"]
        if len(parts) < len(active):
            reach = parts[0]
            for p in parts[1:]:
                reach = reach | p
    counted = compiled.attach(persons).select(*[c.alias(n) for n, c in names]) if names else persons.select()
    if reach is not None:
        counted = counted.where(reach)
    prefixes = [fold([(v, F.col(n)) for v, n in given[: i + 1] if n is not None]) for i in range(len(given))]
    aggregates = [F.count_if(p).alias(f"s{i}") for i, p in enumerate(prefixes) if p is not None]
    everyone = persons.agg(F.count("*").alias("n"))
    row = counted.agg(*aggregates) if aggregates else persons.sparkSession.range(1)
    values = F.array(F.col("n"), *[F.col(f"s{i}") if p is not None else F.col("n") for i, p in enumerate(prefixes)])
    both = everyone.crossJoin(F.broadcast(row)).select(values.alias("v"))
    out = both.select(F.posexplode("v").alias("step", "persons"), "v")
    return out.select("step", "persons", F.when(F.col("step") > 0, F.col("persons") - F.get("v", F.col("step") - 1)).alias("delta"))


def count_by_key(matching: DataFrame, key: str) -> DataFrame:
    """key, doors, people of each area; persons without one are left out."""
    return matching.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.countDistinct("door_i").alias("doors"), F.count("*").alias("people"))


def sample(matching: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` random rows (1 to 500), whatever the size of the input."""
    n = max(1, min(500, n))
    columns = [c for c in ("external_id", "first_name", "last_name", "address_line_1", "address_line_2", "city", "state", "zip5", "enrollment") if c in matching.columns]
    return matching.select(*columns).orderBy(F.rand(seed)).limit(n)


def export(matching: DataFrame) -> DataFrame:
    """The canonical columns; optional ones only where they exist."""
    missing = [c for c, needed in EXPORT_COLUMNS.items() if needed and c not in matching.columns]
    if missing:
        raise ValueError(f"columns are missing for the export: {missing}")
    return matching.select(*[c for c in EXPORT_COLUMNS if c in matching.columns])


def detail(persons: DataFrame, external_id: str) -> DataFrame:
    """One person with all but internal columns; the voting history as JSON where there is one."""
    row = persons.where(F.col("external_id") == external_id).drop(*INTERNAL_COLUMNS).limit(1)
    return row.withColumn("voting_history", F.to_json("voting_history")) if "voting_history" in row.columns else row


def buildings_list(matching: DataFrame, buildings: DataFrame) -> DataFrame:
    """Each building with matching persons: its place and how many doors and persons match."""
    counts = matching.groupBy("building_id").agg(F.countDistinct("door_i").alias("door_count"), F.count("*").alias("person_count"))
    return buildings.join(counts, "building_id").select("building_id", "longitude", "latitude", "door_count", "person_count")


def mercator(longitude, latitude):
    """Web-Mercator x and y in 0..1."""
    x = (longitude + 180) / 360
    y = (1 - F.ln(F.tan(F.lit(math.pi / 4) + F.radians(latitude) / 2)) / math.pi) / 2
    return x, y


def building_points(matching: DataFrame, buildings: DataFrame) -> DataFrame:
    """building_i, dx, dy, origin_x, origin_y: places less their mean."""
    x, y = mercator(F.col("longitude"), F.col("latitude"))
    points = buildings.join(matching.select("building_i").distinct(), "building_i", "left_semi").select("building_i", x.alias("x"), y.alias("y"))
    origin = points.agg(F.avg("x").alias("origin_x"), F.avg("y").alias("origin_y"))
    return points.crossJoin(F.broadcast(origin)).select("building_i", (F.col("x") - F.col("origin_x")).alias("dx"), (F.col("y") - F.col("origin_y")).alias("dy"), "origin_x", "origin_y")


def pack_points(points: DataFrame) -> bytes:
    """Two doubles of the origin, then two floats a point; sixteen zero bytes if there are none."""
    rows = points.orderBy("building_i").toArrow()
    if not rows.num_rows:
        return bytes(16)
    import numpy as np

    header = struct.pack("<dd", rows["origin_x"][0].as_py(), rows["origin_y"][0].as_py())
    return header + np.stack([rows["dx"].to_numpy(), rows["dy"].to_numpy()], 1).astype("<f4").tobytes()


def feature_collection(areas: DataFrame) -> DataFrame:
    """One row, geojson: the areas (key, name, geometry as GeoJSON text) as features."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("key", "name").alias("properties"), F.from_json("geometry", "type string, coordinates array<array<array<double>>>").alias("geometry"))
    listed = areas.agg(F.array_sort(F.collect_list(F.struct("key", feature.alias("f")))).alias("all"))
    return listed.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("all", lambda x: x["f"]).alias("features")), {"ignoreNullFields": "false"}).alias("geojson"))


@dataclass(frozen=True)
class Page:
    hits: DataFrame
    total: int


def as_json(frame: DataFrame) -> list[dict]:
    return [json.loads(r) for r in frame.toJSON().collect()]
