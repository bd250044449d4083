"""Turfs from drawn polygons: checks, assignment of buildings, and the nested payload."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .spatial import containing

CODES = 100_000_000
#: How often codes are drawn before publishing gives up.
TRIES = 5


class PublishError(ValueError):
    """Drafts that cannot become turfs."""


def indexed(drafts: DataFrame) -> DataFrame:
    """``drafts`` with idx from 0 in their order; there are as many as people drew."""
    return drafts.withColumn("idx", F.row_number().over(Window.orderBy("sort_order", "turf_draft_id")) - 1)


def hits(buildings: DataFrame, drafts: DataFrame) -> DataFrame:
    """building_id, turf_draft_id, idx of each draft that contains a building."""
    return containing(buildings, indexed(drafts), "longitude", "latitude").select("building_id", "turf_draft_id", "idx")


def ambiguous(found: DataFrame) -> DataFrame:
    """building_id, drafts of buildings in two or more drafts."""
    return found.groupBy("building_id").agg(F.count("*").alias("drafts")).where("drafts >= 2")


def empty(found: DataFrame, drafts: DataFrame) -> DataFrame:
    return drafts.join(found, "turf_draft_id", "left_anti").select("turf_draft_id")


def check(found: DataFrame, drafts: DataFrame) -> None:
    if n := ambiguous(found).count():
        raise PublishError(f"{n} buildings lie in more than one draft")
    if n := empty(found, drafts).count():
        raise PublishError(f"{n} drafts hold no building")


def assigned(found: DataFrame) -> DataFrame:
    """building_id, idx: the first draft that contains it."""
    return found.groupBy("building_id").agg(F.min("idx").alias("idx"))


def code(name: Column) -> Column:
    """Eight digits from a name; a random name gives a random code."""
    return F.lpad(F.pmod(F.xxhash64(name), F.lit(CODES)).cast("string"), 8, "0")


def payloads(persons: DataFrame, found: DataFrame, drafts: DataFrame) -> DataFrame:
    """idx, name, code, building_count, door_count, person_count, buildings (array of nested structs) of each draft.

    Drafts without persons keep an empty array and zeros.
    """
    rows = persons.join(assigned(found), "building_id")
    person = F.struct("external_id", "first_name", "last_name")
    doors = rows.groupBy("idx", "building_id", "door_id").agg(F.array_sort(F.collect_list(person)).alias("persons"), F.min("address_line_2").alias("unit"), *[F.min(c).alias(c) for c in ("address_line_1", "city", "state", "zip5")], F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
    door = F.struct(F.col("door_id").alias("doorId"), "unit", "persons")
    buildings = doors.groupBy("idx", "building_id").agg(F.array_sort(F.collect_list(door)).alias("doors"), *[F.min(c).alias(c) for c in ("address_line_1", "city", "state", "zip5", "latitude", "longitude")])
    place = F.struct(F.col("address_line_1").alias("street"), "city", "state", F.col("zip5").alias("zip"))
    building = F.struct(F.col("building_id").alias("buildingId"), "latitude", "longitude", place.alias("address"), "doors")
    turfs = buildings.groupBy("idx").agg(F.array_sort(F.collect_list(building)).alias("buildings"))
    out = indexed(drafts).join(turfs, "idx", "left")
    some = F.coalesce("buildings", F.array().cast(turfs.schema["buildings"].dataType))
    listed = F.flatten(F.transform(some, lambda b: b["doors"]))
    return out.select(
        "idx", F.concat(F.lit("Turf "), (F.col("idx") + 1).cast("string")).alias("name"), code(F.col("turf_draft_id")).alias("code"), some.alias("buildings"),
        F.size(some).alias("building_count"), F.size(listed).alias("door_count"), F.aggregate(listed, F.lit(0), lambda a, d: a + F.size(d["persons"])).alias("person_count"),
    )


def as_json(turfs: DataFrame) -> DataFrame:
    """idx, data: the payload as JSON with nulls kept."""
    return turfs.select("idx", F.to_json(F.struct("name", F.col("code").alias("turfCode"), "buildings"), {"ignoreNullFields": "false"}).alias("data"))


def coded(turfs: DataFrame, taken: DataFrame, tries: int = TRIES) -> DataFrame:
    """``turfs`` (with idx and code) under codes that neither each other nor ``taken`` (code) have; raises after ``tries`` draws.

    The first draw is the code that is there. All turfs draw again if one
    collides, as they are written together. There are as many as people drew.
    """
    first = turfs.withColumn("__first", F.col("code"))
    for k in range(tries):
        drawn = first.withColumn("code", F.col("__first") if k == 0 else code(F.concat_ws("#", "__first", "idx", F.lit(k))))
        own = drawn.groupBy("code").agg(F.count("*").alias("n"))
        used = own.join(taken.select("code").distinct().withColumn("used", F.lit(True)), "code", "left")
        if not used.where("n > 1 or used").limit(1).count():
            return drawn.drop("__first")
    raise PublishError(f"no free codes after {tries} draws")


def publish(persons: DataFrame, drafts: DataFrame, taken: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Checks ``drafts``, hands their turfs to ``write`` in one go, and returns idx, name, code and counts of each.

    ``persons`` have building_id, longitude and latitude; those without a place
    are in no turf. ``taken`` (code) are the codes of earlier turfs. Nothing is
    written if a building lies in two drafts, a draft is empty or codes run out.
    """
    found = stored(hits(persons.select("building_id", "longitude", "latitude").distinct(), drafts))
    check(found, drafts)
    turfs = stored(coded(payloads(persons, found, drafts), taken))
    write(turfs)
    return turfs.select("idx", "name", "code", "building_count", "door_count", "person_count")
