"""Queries over boards, scripts and versions, with their SQL."""

from pyspark.sql import functions as F

from ..operators import board, counts, elections
from . import audience, geography


def part(s, d):
    return s.read.parquet(f"{d}/part.parquet")


def orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet")


def script_steps(s, d):
    k = F.col("p_partkey")
    p = part(s, d)
    steps = p.select((k % 7).alias("script_id"), F.col("p_size").alias("position"), k.alias("step_id"), F.when(k % 3 > 0, k % 11).alias("question_id"))
    questions = s.range(11).select(F.col("id").alias("question_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("prompt"))
    options = s.range(44).select((F.col("id") % 11).alias("question_id"), (F.lit(50) - F.col("id")).alias("position"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("option_id"), F.lit("x").alias("label"), (F.col("id") % 5 > 0).alias("active"))
    made = board.scripts(steps, questions, options)
    flat = made.select("script_id", F.posexplode("steps").alias("i", "t"))
    return flat.select("script_id", F.col("i").cast("bigint").alias("place"), "t.step_id", "t.prompt", F.array_join("t.options", ",").alias("options"))


SCRIPTS = """SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY position, step_id) - 1 AS place, step_id, CASE WHEN q IS NOT NULL THEN 'q' || cast(q AS string) END AS prompt, o.options
 FROM (SELECT p_partkey % 7 AS script_id, p_size AS position, p_partkey AS step_id, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 11 END AS q FROM part)
 LEFT JOIN (SELECT id % 11 AS q, string_agg('o' || cast(id AS string), ',' ORDER BY 50 - id) AS options FROM range(44) t(id) WHERE id % 5 > 0 GROUP BY 1) o USING (q)"""


def turf_board(s, d):
    k = F.col("p_partkey")
    rows = part(s, d).select(F.lit(1).alias("organization_id"), (k % 6).alias("campaign_id"), k.alias("turf_id"), ((k * 37) % 1009).alias("created_at"), F.nullif(k % 4, F.lit(3)).alias("zone_order"), F.concat(F.lit("Turf "), (k % 120).cast("string")).alias("name"))
    return board.board(rows).select("turf_id", F.col("place").cast("bigint"))


MORE = {
    "latest_upload": (lambda s, d: board.latest_by(orders(s, d).select(F.col("o_custkey").alias("field"), F.col("o_orderkey").alias("upload")).withColumn("at", F.col("upload")), "field", "at").select("field", "upload"), "SELECT o_custkey AS field, max(o_orderkey) AS upload FROM orders GROUP BY 1"),
    "question_used_count": (lambda s, d: board.used_counts(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k")), orders(s, d).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k"), "SELECT c_custkey AS k, count(o_orderkey) AS used FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1"),
    "next_order": (lambda s, d: board.next_order(part(s, d), "p_brand", "p_size").withColumn("next", F.col("next").cast("bigint")), "SELECT p_brand, cast(max(p_size) + 1 AS bigint) AS next FROM part GROUP BY 1"),
    "slugs": (lambda s, d: part(s, d).select("p_partkey", board.slug(F.concat(F.lit(" "), F.col("p_type"), F.lit(" #"), F.col("p_brand"), F.lit("! "))).alias("slug")), "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(' ' || p_type || ' #' || p_brand || '! ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part"),
    "version_list": (lambda s, d: board.versions(part(s, d).select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("number")), part(s, d).groupBy(F.col("p_brand").alias("dataset")).agg(F.min("p_partkey").alias("number"))), "SELECT p_brand AS dataset, p_partkey AS number, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS is_active FROM part"),
    "script_assembly": (script_steps, SCRIPTS),
    "turf_board": (turf_board, "SELECT turf_id, row_number() OVER (ORDER BY began, c, z NULLS LAST, n, turf_id) AS place FROM (SELECT p_partkey AS turf_id, p_partkey % 6 AS c, nullif(p_partkey % 4, 3) AS z, p_partkey % 120 AS n, min((p_partkey * 37) % 1009) OVER (PARTITION BY p_partkey % 6) AS began FROM part)"),
    "cut_counts": (lambda s, d: board.cut_counts(geography.found(s, d), geography.geocode.rollup(geography.geocoded(s, d), "building_id")), geography.with_sql("SELECT turf_draft_id, count(DISTINCT door_i) AS doors, count(*) AS people FROM (SELECT DISTINCT turf_draft_id, building_id FROM hits) JOIN places USING (building_id) GROUP BY 1", ("persons",), geography.PLACES, geography.SQUARES_SQL, geography.HITS)),
    "election_labels": (lambda s, d: audience.election_registry(s, d).select("bit", elections.label(F.col("year"), F.col("type")).alias("label")), audience.history_sql("SELECT bit, cast(year AS string) || ' ' || array_to_string(list_transform(str_split(replace(type, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM bits")),
    "area_features": (lambda s, d: counts.feature_collection(s.read.parquet(f"{d}/nation.parquet").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("key"), F.col("n_name").alias("name"), F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}').alias("geometry"))).select(F.size(F.from_json("geojson", "features array<string>")["features"]).cast("bigint").alias("n"), F.substring("geojson", 1, 59).alias("head")), "SELECT count(*) AS n, '{\"type\":\"FeatureCollection\",\"features\":[{\"type\":\"Feature\",\"' AS head FROM nation"),
}
QUERIES = {n: q for n, (q, _) in MORE.items()}
ORACLE = {n: o for n, (_, o) in MORE.items()}
