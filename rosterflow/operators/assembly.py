"""The canonical table of persons with places, which all audience queries read."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import person_hash
from ..sources.stored import stored
from . import elections
from .custom_fields import one_hash
from .spatial import dense_ids

#: Columns that assembly makes anew.
REMADE = ("address_line_1", "address_line_2", "half_code")


def persons_geocoded(persons: DataFrame, best: DataFrame, addresses: DataFrame, refined: DataFrame, only: DataFrame, floor: int = elections.FLOOR) -> DataFrame:
    """Every person that has a place, in ranges of zip5.

    ``persons`` are validated rows, whose other columns all come along;
    ``best`` their segments, ``addresses`` the canonical first lines,
    ``refined`` places by segment and ``only`` places by building alone, with
    the nearest segment. Persons without a place or a canonical line fall out.
    building_id and door_id are the address; building_i and door_i number them
    densely in their order, and person_h is a hash of external_id that no two
    ids may share. Voting histories become masks of the elections that at
    least ``floor`` persons voted in.
    """
    kept = persons.withColumn("unit", F.trim(F.upper("address_line_2"))).drop(*REMADE).withColumnRenamed("unit", "address_line_2")
    if "voting_history" in persons.columns:
        kept = elections.with_masks(kept, elections.bits(stored(elections.registry(persons, floor))))
    place = ["external_id", "latitude", "longitude"]
    places = refined.select(*place, "position_source", F.lit(None).cast("string").alias("near"))
    places = places.unionByName(only.select(*place, F.lit("osm_only").alias("position_source"), F.col("blockface_id").alias("near")))
    segment = best.select("external_id", F.col("blockface_id").alias("own"), "person_house_number", "match_score")
    rows = kept.join(addresses.select("external_id", "address_line_1"), "external_id").join(places, "external_id").join(segment, "external_id", "left")
    building = F.concat("address_line_1", F.lit("|"), "zip5")
    door = F.concat("address_line_1", F.lit("|"), F.coalesce("address_line_2", F.lit("")), F.lit("|"), "zip5")
    rows = rows.withColumns({"blockface_id": F.coalesce("own", "near"), "building_id": building, "door_id": door, "person_h": person_hash(F.col("external_id"))}).drop("own", "near")
    rows = stored(rows)
    one_hash(rows)
    numbered = stored(dense_ids(stored(dense_ids(rows, "building_id", "building_i")), "door_id", "door_i"))
    return numbered.repartitionByRange("zip5").sortWithinPartitions("zip5")
