"""Files of rosters, uploads and shapes."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The columns of the headerless roster file, in order.
ROSTER_COLUMNS = [
    "last_name", "first_name", "middle_name", "name_suffix", "res_house_number", "res_half_code", "res_pre_direction", "res_street_name",
    "res_post_direction", "res_apartment_type", "res_apartment", "res_addr_non_standard", "res_city", "res_zip5", "res_zip4",
    "mail_addr_1", "mail_addr_2", "mail_addr_3", "mail_addr_4", "date_of_birth", "gender", "enrollment", "other_party", "county_code",
    "election_district", "legislative_district", "town_city", "ward", "congressional_district", "senate_district", "assembly_district",
    "last_voted_date", "prev_year_voted", "prev_county", "prev_address", "prev_name", "county_vr_number", "registration_date", "vr_source",
    "id_required", "id_met", "status", "reason_code", "inactive_date", "purge_date", "sboe_id", "voter_history",
]


def cleaned(column: Column) -> Column:
    """Without C1 control characters and outer blanks; null if nothing is left."""
    bare = F.regexp_replace(column, "[\u0080-\u009f]", "")
    return F.nullif(F.regexp_replace(bare, r'^[" \t\r\n]+|[" \t\r\n]+$', ""), F.lit(""))


def roster_text(spark: SparkSession, path: str) -> DataFrame:
    """The quoted Latin-1 roster, all strings."""
    schema = StructType([StructField(c, StringType()) for c in ROSTER_COLUMNS])
    raw = spark.read.schema(schema).option("encoding", "ISO-8859-1").option("quote", '"').option("escape", '"').option("header", False).csv(path)
    return raw.select(*[cleaned(F.col(c)).alias(c) for c in ROSTER_COLUMNS])


def roster(spark: SparkSession, path: str) -> DataFrame:
    """A roster by its name: text, CSV with a header, or Parquet."""
    if path.endswith(".txt"):
        return roster_text(spark, path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def upload(spark: SparkSession, path: str) -> DataFrame:
    """An upload by its first bytes: Parquet, or else CSV with a header, all strings."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(at).isDirectory():
        return spark.read.parquet(path)
    stream = system.open(at)
    try:
        # four reads of a byte, so no more of the file comes to the driver
        head = [stream.read() for _ in range(4)]
    finally:
        stream.close()
    if head == list(b"PAR1"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """key, name, ring (array of x, y) of the features of a collection: the outer ring of a polygon, and of each part of a multipolygon."""
    shape = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.option("multiLine", True).schema(shape).json(path).select(F.explode("features").alias("f"))
    line = "array<array<array<double>>>"
    one, many = F.from_json("f.geometry.coordinates", line), F.from_json("f.geometry.coordinates", f"array<{line}>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    named = rows.select(F.try_element_at("f.properties", F.lit("key")).alias("key"), F.try_element_at("f.properties", F.lit("name")).alias("name"), F.explode(parts).alias("part"))
    ring = F.transform(F.get("part", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return named.select("key", "name", ring.alias("ring")).where("key is not null")


def map_addresses(elements: DataFrame, centres: DataFrame) -> DataFrame:
    """Addressed nodes at their own place and ways at their polygon's centre (osm_id, lat, lon); ways without one are left out.

    ``elements``: kind, id, lat, lon, tags (map).
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    rows = elements.where(tag("addr:housenumber").isNotNull()).select(
        F.col("id").alias("osm_id"), "kind", "lat", "lon", *[tag(f"addr:{k}").alias(n) for k, n in (("housenumber", "housenumber"), ("street", "street"), ("unit", "unit"), ("postcode", "zip_code"), ("city", "city"), ("state", "state"))], tag("building").alias("building")
    )
    nodes = rows.where("kind = 'node'")
    ways = rows.where("kind = 'way'").drop("lat", "lon").join(centres, "osm_id")
    return nodes.unionByName(ways)


def assembled_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """landuse_id, ring of closed ways (id, refs) from their nodes (id, lat, lon) in order; at least four corners."""
    listed = ways.select(F.col("id").alias("landuse_id"), F.posexplode("refs").alias("i", "ref"))
    corners = listed.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    rings = corners.groupBy("landuse_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("all"))
    ring = F.transform("all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size("all") - 1), ring).otherwise(F.array_append(ring, F.get(ring, F.lit(0))))
    return rings.select("landuse_id", closed.alias("ring")).where("size(ring) >= 4")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an operational database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
