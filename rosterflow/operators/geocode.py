"""Positions of persons: building data where it fits, else their rank along the street side."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.addressing import canonical_key, expand_tokens, housenumber_display, housenumber_norm, street_rewrite, tokenize_street
from ..sources.stored import stored
from .spatial import shifted

LEAST, MOST = 0.05, 0.95
SPACING_M, OFFSET_M = 4.0, 7.0


def building_lookup(addresses: DataFrame, residential: DataFrame | None = None) -> DataFrame:
    """One building for each zip, street and house number: areas before points, then the smallest id."""
    from .spatial import containing

    keyed = addresses.where(F.col("zip_code").isNotNull() & F.col("street").isNotNull()).select(
        "osm_id", "kind", "housenumber", "street", "zip_code", "lat", "lon",
        canonical_key(expand_tokens(tokenize_street(street_rewrite(F.col("street"))))).alias("canonical_key"), housenumber_norm(F.col("housenumber")).alias("housenumber_norm"),
    ).where("canonical_key <> ''")
    order = Window.partitionBy("zip_code", "canonical_key", "housenumber_norm").orderBy((F.col("kind") != "way").cast("int"), "osm_id")
    one = keyed.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    one = one.select("zip_code", "canonical_key", "housenumber", "housenumber_norm", "street", F.col("lat").alias("osm_lat"), F.col("lon").alias("osm_lon"))
    if residential is None:
        return one.withColumn("in_residential_complex", F.lit(False))
    key = ["zip_code", "canonical_key", "housenumber_norm"]
    one = stored(one)
    inside = containing(one.select(*key, "osm_lon", "osm_lat"), residential, "osm_lon", "osm_lat").select(*key).distinct().withColumn("__in", F.lit(True))
    return one.join(inside, key, "left").withColumn("in_residential_complex", F.coalesce("__in", F.lit(False))).drop("__in")


def keyed(best: DataFrame, people: DataFrame, faces: DataFrame) -> DataFrame:
    """Matched persons with the key of their building."""
    order = F.struct("from_house_num", "to_house_num", "zip_code")
    face = faces.groupBy("blockface_id", F.coalesce("house_num_prefix", F.lit("")).alias("prefix")).agg(F.min_by(canonical_key(F.col("street_tokens_lookup")), order).alias("canonical_key"))
    who = people.select("external_id", "zip5", "half_code", F.col("house_num_prefix").alias("raw_prefix"), "house_number")
    rows = best.select("external_id", "blockface_id", "side", "tiger_line_id", "person_house_number", "full_name", F.coalesce("house_num_prefix", F.lit("")).alias("prefix"))
    rows = rows.join(who, "external_id").join(face, ["blockface_id", "prefix"])
    # strings that the parts tell are made once nothing of them is shuffled
    display = housenumber_display(F.col("raw_prefix"), F.col("house_number"), F.col("half_code"))
    rows = rows.withColumn("housenumber_str", display).withColumns({"housenumber_norm": housenumber_norm(F.col("housenumber_str")), "half_code": F.coalesce("half_code", F.lit("")), "own_prefix": F.coalesce("raw_prefix", F.lit(""))})
    return rows.drop("raw_prefix", "house_number")


def with_buildings(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    found = lookup.select(F.col("zip_code").alias("zip5"), "canonical_key", "housenumber_norm", "osm_lat", "osm_lon", F.col("street").alias("osm_street"), F.col("housenumber").alias("osm_housenumber"), F.col("in_residential_complex").alias("in_complex"))
    return rows.join(found, ["zip5", "canonical_key", "housenumber_norm"], "left").withColumn("in_complex", F.coalesce("in_complex", F.lit(False)))


def ranked(rows: DataFrame) -> DataFrame:
    """house_rank and max_rank of each person along a side of a line (line and side make the partition)."""
    place = Window.partitionBy("tiger_line_id", "side")
    out = rows.withColumn("house_rank", F.dense_rank().over(place.orderBy("own_prefix", "person_house_number", "half_code")))
    return out.withColumn("max_rank", F.max("house_rank").over(place))


def shoved(rows: DataFrame) -> DataFrame:
    """``frac`` of each row so that buildings on a side are SPACING_M apart, or evenly spread where they do not fit.

    Needs tiger_line_id, side, frac, house_rank and line_length (metres).
    """
    place = Window.partitionBy("tiger_line_id", "side")
    out = rows.withColumn("rn", F.dense_rank().over(place.orderBy("frac", "house_rank")))
    out = out.withColumn("n", F.max("rn").over(place))
    gap = F.least(F.lit(SPACING_M), 0.9 * F.col("line_length") / F.greatest("n", F.lit(1))) / F.nullif("line_length", F.lit(0.0))
    out = out.withColumn("gap", gap)
    # peers of an order share the running maximum: the default frame is by range
    forward = F.max(F.col("frac") - F.col("rn") * F.col("gap")).over(place.orderBy("rn")) + F.col("rn") * F.col("gap")
    capped = F.least(forward, MOST - (F.col("n") - F.col("rn")) * F.col("gap"))
    return out.withColumn("frac", F.least(F.greatest(capped, F.lit(LEAST)), F.lit(MOST))).drop("rn", "n", "gap")


def refined_positions(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """external_id, latitude, longitude, position_source of persons with building data (with_buildings) and lines (blockface_id, line).

    In a residential complex and where the building lies beyond the ends of its
    line, the building's own place counts; else the building is projected to
    the line, and persons without one are ranked along it. Rows whose building
    is known but whose line is not fall out, as they have no fraction.
    """
    x, y = geo.to_utm(F.col("osm_lon"), F.col("osm_lat"))
    placed = rows.join(lines, "blockface_id", "left").withColumn("line_m", geo.line_to_utm(F.col("line")))
    placed = placed.withColumn("osm_frac", F.when(F.col("osm_lat").isNotNull() & F.col("line_m").isNotNull(), geo.locate(F.col("line_m"), x, y)["fraction"]))
    at_end = F.col("osm_lat").isNotNull() & F.col("osm_frac").isin(0.0, 1.0)
    unknown = F.col("osm_lat").isNotNull() & F.col("osm_frac").isNull()
    own = placed.where(F.col("in_complex") | (at_end & ~F.col("in_complex")))
    own = own.select("external_id", F.col("osm_lat").alias("latitude"), F.col("osm_lon").alias("longitude"), F.when(F.col("in_complex"), "osm_complex").otherwise("osm_off_segment").alias("position_source"), "osm_street", "osm_housenumber")
    along = ranked(placed.where(~F.col("in_complex") & ~F.coalesce(at_end, F.lit(False)) & ~unknown & F.col("line_m").isNotNull()))
    fits = (F.col("osm_frac") > 0) & (F.col("osm_frac") < 1)
    share = F.when(fits, F.col("osm_frac")).otherwise(F.col("house_rank").cast("double") / (1 + F.col("max_rank")))
    along = along.withColumns({"position_source": F.when(fits, "osm_matched").otherwise("tiger_only"), "frac": F.least(F.greatest(share, F.lit(LEAST)), F.lit(MOST)), "line_length": geo.length(F.col("line_m"))})
    moved = shoved(along).withColumn("p", shifted(F.col("line_m"), F.col("frac"), F.col("side"), OFFSET_M))
    lon, lat = geo.from_utm(F.col("p.x"), F.col("p.y"))
    return own.unionByName(moved.select("external_id", lat.alias("latitude"), lon.alias("longitude"), "position_source", "osm_street", "osm_housenumber"))


def only_by_building(people: DataFrame, best: DataFrame, lookup: DataFrame) -> DataFrame:
    """Persons without a segment whose own words name a building in their zip."""
    display = housenumber_display(F.col("house_num_prefix"), F.col("house_number"), F.col("half_code"))
    missed = people.join(best.select("external_id"), "external_id", "left_anti")
    own = missed.select("external_id", "zip5", canonical_key(expand_tokens(F.col("street_name_tokens"))).alias("canonical_key"), housenumber_norm(display).alias("housenumber_norm"))
    found = lookup.select(F.col("zip_code").alias("zip5"), "canonical_key", "housenumber_norm", F.col("osm_lat").alias("latitude"), F.col("osm_lon").alias("longitude"), F.col("street").alias("osm_street"), F.col("housenumber").alias("osm_housenumber"))
    return own.join(found, ["zip5", "canonical_key", "housenumber_norm"]).drop("canonical_key", "housenumber_norm")


def canonical_addresses(placed: DataFrame, best: DataFrame, people: DataFrame, only: DataFrame) -> DataFrame:
    """external_id, address_line_1, matched_tokens: the building's spelling where there is one."""
    named = placed.select("external_id", "osm_street", "osm_housenumber").join(best.select("external_id", "full_name"), "external_id", "left")
    named = named.select("external_id", F.upper(F.coalesce("osm_street", "full_name")).alias("street"), "osm_housenumber")
    named = named.unionByName(only.select("external_id", F.upper("osm_street").alias("street"), "osm_housenumber"))
    numbers = people.select("external_id", "house_num_prefix", "house_number", "half_code")
    both = named.join(numbers, "external_id").withColumn("own", housenumber_display(F.col("house_num_prefix"), F.col("house_number"), F.col("half_code")))
    same = F.col("osm_housenumber").isNotNull() & (housenumber_norm(F.col("osm_housenumber")) == housenumber_norm(F.col("own")))
    low = F.lower(F.trim("street"))
    words = F.array_distinct(F.filter(F.concat(F.split(low, "[^a-z0-9]+"), F.regexp_extract_all(low, F.lit("([0-9]+)"), F.lit(0))), lambda t: F.length(t) > 0))
    return both.select("external_id", F.concat_ws(" ", F.when(same, F.upper("osm_housenumber")).otherwise(F.col("own")), "street").alias("address_line_1"), words.alias("matched_tokens"))


def summary(persons: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: totals, the share of matched persons in percent, and counts by source."""
    sources = ("osm_complex", "osm_matched", "osm_off_segment", "tiger_only", "osm_only")
    total = persons.agg(F.count("*").alias("total"))
    by = placed.agg(F.count("*").alias("matched"), *[F.count_if(F.col("position_source") == s).alias(s) for s in sources])
    both = total.crossJoin(F.broadcast(by))
    return both.select("total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"), F.round(100 * F.col("matched") / F.nullif("total", F.lit(0)), 2).alias("match_rate"), *sources)


def rollup(persons: DataFrame, key: str) -> DataFrame:
    """Buildings or doors: place, persons and doors of each ``key`` (building_id or door_id)."""
    return persons.where(F.col(key).isNotNull()).groupBy(key, "zip5").agg(F.min("address_line_1").alias("address_line_1"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.countDistinct("door_i").alias("door_count"), F.count("*").alias("person_count"))
