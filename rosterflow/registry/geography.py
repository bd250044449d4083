"""Queries over addresses, street segments, places, turfs and imports, with their SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addressing as ad
from ..functions import geo
from ..functions.hashing import name_key, packed, person_hash
from ..operators import assembly, geocode, importer, matching, publish, search, spatial, topology
from ..sources.stored import stored
from .fixtures import FLOOR, frame, sql

# the same pieces in DuckDB's SQL


def rewrite(x: str) -> str:
    out = f"lower(trim({x}))"
    for pattern, replacement in ad.STREET_REWRITES:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


def tokens(x: str) -> str:
    low = f"lower(trim({x}))"
    every = rf"list_concat(list_concat(regexp_split_to_array({low}, '[^a-z0-9]+'), regexp_extract_all({low}, '[0-9]+')), regexp_extract_all({low}, '\b[a-z]+'))"
    return f"list_sort(list_distinct(list_filter({every}, lambda t: length(t) > 0)))"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


GROUPS = "[" + ", ".join(listed(g) for g in ad.EQUIVALENT_TOKENS) + "]"


def expand(x: str) -> str:
    return f"list_sort(list_distinct(list_concat({x}, flatten(list_filter({GROUPS}, lambda g: list_has_any(g, {x}))))))"


def norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(^|-)0*([0-9])', '\1\2', 'g'), '-', '', 'g')"


DISPLAY = "coalesce(house_num_prefix, '') || cast(house_number AS string) || CASE WHEN half_code IS NOT NULL AND half_code <> '' THEN ' ' || half_code ELSE '' END"
PEOPLE = rf"""people AS (SELECT external_id, house_number, house_num_prefix, half_code, street_name_raw, {tokens(rewrite('street_name_raw'))} AS street_name_tokens,
 CASE WHEN house_number % 2 = 1 THEN 'odd' ELSE 'even' END AS number_type, zip5 FROM (SELECT external_id, zip5, half_code,
 CASE WHEN regexp_extract(w, '([0-9]+)$', 1) <> '' THEN regexp_replace(w, '[0-9]+$', '') ELSE '' END AS house_num_prefix, try_cast(regexp_extract(w, '([0-9]+)$', 1) AS int) AS house_number,
 trim(substr(address_line_1, length(w) + 1)) AS street_name_raw FROM (SELECT *, regexp_extract(address_line_1, '^(\S+)', 1) AS w FROM lines)) WHERE house_number IS NOT NULL)"""
FACES = rf"""norm AS (SELECT tiger_line_id || ':' || side AS blockface_id, side, tiger_line_id, zip_code, full_name, from_node_id, to_node_id, {tokens(rewrite('full_name'))} AS street_name_tokens,
 try_cast(regexp_extract(raw_from, '([0-9]+)$', 1) AS int) AS from_house_num, try_cast(regexp_extract(raw_to, '([0-9]+)$', 1) AS int) AS to_house_num, regexp_replace(raw_from, '[0-9]+$', '') AS house_num_prefix FROM unpivoted),
 typed AS (SELECT *, CASE WHEN from_house_num % 2 = to_house_num % 2 THEN CASE WHEN from_house_num % 2 = 1 THEN 'odd' ELSE 'even' END ELSE 'mixed' END AS number_type FROM norm),
 freq AS (SELECT full_name, count(*) AS f FROM typed GROUP BY 1),
 faces AS (SELECT blockface_id, side, from_house_num, to_house_num, house_num_prefix, number_type, zip_code, tiger_line_id, first(full_name ORDER BY f DESC, full_name NULLS LAST) AS full_name,
 {expand('flatten(list(street_name_tokens))')} AS street_tokens_match, {expand('first(street_name_tokens ORDER BY f DESC, full_name NULLS LAST)')} AS street_tokens_lookup
 FROM typed JOIN freq USING (full_name) GROUP BY blockface_id, side, from_house_num, to_house_num, house_num_prefix, number_type, zip_code, tiger_line_id)"""
GENERIC = listed(ad.GENERIC_TOKENS)
IN_RANGE = "(v.house_number BETWEEN b.from_house_num AND b.to_house_num OR v.house_number BETWEEN b.to_house_num AND b.from_house_num)"
OPPOSED = " OR ".join(f"((list_contains(v.street_name_tokens, '{a}') OR list_contains(v.street_name_tokens, '{b}')) AND list_contains(b.street_tokens_match, '{c}'))" for a, b, c in (("n", "north", "s"), ("s", "south", "n"), ("e", "east", "w"), ("w", "west", "e")))
DISTINCT_V = f"list_filter(v.street_name_tokens, lambda t: NOT list_contains({GENERIC}, t))"
DISTINCT_B = f"list_filter(b.street_tokens_match, lambda t: NOT list_contains({GENERIC}, t))"
SAME_PREFIX = "coalesce(b.house_num_prefix, '') = coalesce(v.house_num_prefix, '')"
# pairs are found within a zip; a face's other rows then count by range and prefix
SCORED = rf"""pairs AS (SELECT DISTINCT v.external_id, b.blockface_id FROM people v JOIN faces b ON b.zip_code = v.zip5 AND b.number_type IN (v.number_type, 'mixed') AND {SAME_PREFIX} AND {IN_RANGE}
 WHERE len({DISTINCT_V}) = 0 OR list_has_any({DISTINCT_V}, {DISTINCT_B})),
 scored AS (SELECT v.external_id, b.blockface_id, b.full_name, b.side, b.tiger_line_id, b.house_num_prefix, b.zip_code, v.house_number AS person_house_number,
 len(list_intersect(v.street_name_tokens, b.street_tokens_match)) AS token_overlap, CASE WHEN len(list_filter(v.street_name_tokens, lambda t: regexp_matches(t, '^[0-9]+$'))) > 0 THEN 1 ELSE 0 END AS bonus
 FROM pairs JOIN people v USING (external_id) JOIN faces b USING (blockface_id)
 WHERE {SAME_PREFIX} AND {IN_RANGE} AND len(list_intersect(v.street_name_tokens, b.street_tokens_match)) >= 2 AND NOT ({OPPOSED}))"""


def with_sql(query: str, fixtures: tuple[str, ...], *ctes: str) -> str:
    return ", ".join([sql("", *fixtures).rstrip(), *ctes]) + "\n" + query


def people(s, d) -> DataFrame:
    return matching.decomposed(frame(s, d, "lines"))


def normalized(s, d) -> DataFrame:
    rows = frame(s, d, "unpivoted").withColumn("street_name_tokens", ad.tokenize_street(ad.street_rewrite(F.col("full_name")))).withColumn("blockface_id", F.concat_ws(":", "tiger_line_id", "side"))
    return matching.normalized(rows)


def faces(s, d) -> DataFrame:
    return matching.final(normalized(s, d))


def scored(s, d) -> DataFrame:
    return matching.candidates(stored(people(s, d)), stored(faces(s, d)), ["blockface_id", "full_name"])


def matched(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, faces, best segments), each written once: several steps read them."""
    who, sides = stored(people(s, d)), stored(faces(s, d))
    return who, sides, stored(matching.best_matches(who, sides, SEGMENT))


#: What later steps read of the best segment.
SEGMENT = ["blockface_id", "side", "tiger_line_id", "full_name", "house_num_prefix"]


def join_words(*names: str):
    return {n: F.array_join(n, " ") for n in names}


def features(s, d) -> DataFrame:
    """Lines with both sides' ranges, from the parts."""
    p = s.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    return p.select(
        k.cast("string").alias("tiger_line_id"), F.col("p_brand").alias("full_name"), F.array(F.lower("p_brand")).alias("street_name_tokens"),
        F.nullif((k % 5).cast("string"), F.lit("0")).alias("left_from_house_num"), (k % 5 + 50).cast("string").alias("left_to_house_num"), F.lit("1").alias("left_zip_code"),
        F.when(k % 7 == 0, "").otherwise((k % 3).cast("string")).alias("right_from_house_num"), F.lit("99").alias("right_to_house_num"), F.lit("2").alias("right_zip_code"),
    )


def edges_of(s, d) -> DataFrame:
    k = F.col("p_partkey")
    return s.read.parquet(f"{d}/part.parquet").where("p_partkey % 4 <> 3").select(k.cast("string").alias("tiger_line_id"), (k % 10).cast("string").alias("from_node_id"), (k % 11).cast("string").alias("to_node_id"))


UNPIVOT = """SELECT tlid || ':' || side AS blockface_id, tlid AS tiger_line_id, side, raw_from, raw_to, zip_code, full_name, from_node_id, to_node_id FROM (
 SELECT cast(p_partkey AS string) AS tlid, p_brand AS full_name, 'left' AS side, nullif(cast(p_partkey % 5 AS string), '0') AS raw_from, cast(p_partkey % 5 + 50 AS string) AS raw_to, '1' AS zip_code FROM part
 UNION ALL SELECT cast(p_partkey AS string), p_brand, 'right', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE cast(p_partkey % 3 AS string) END, '99', '2' FROM part)
 LEFT JOIN (SELECT cast(p_partkey AS string) AS tlid, cast(p_partkey % 10 AS string) AS from_node_id, cast(p_partkey % 11 AS string) AS to_node_id FROM part WHERE p_partkey % 4 <> 3) USING (tlid)
 WHERE coalesce(raw_from, '') <> ''"""

ADDRESSES_SQL = """addresses AS (SELECT p_partkey AS osm_id, CASE p_partkey % 3 WHEN 0 THEN 'way' ELSE 'node' END AS kind,
 CASE p_partkey % 4 WHEN 0 THEN '0' || cast(p_partkey % 90 AS string) WHEN 1 THEN cast(p_partkey % 4 AS string) || '-' || cast(p_partkey % 10 AS string) ELSE cast(p_partkey % 200 AS string) END AS housenumber,
 CASE p_partkey % 3 WHEN 0 THEN 'F D R Dr' WHEN 1 THEN 'fdr drive' ELSE p_brand || ' Avenue' END AS street, nullif(lpad(cast(p_size AS string), 5, '0'), '00003') AS zip_code,
 40 + (p_partkey % 100) * 0.001e0 AS lat, -74 + (p_partkey % 37) * 0.001e0 AS lon FROM {part})"""


def addresses(s, d) -> DataFrame:
    body = ADDRESSES_SQL[len("addresses AS (") : -1]
    return s.sql(body, part=s.read.parquet(f"{d}/part.parquet"))


SQUARES = [(i, -74 + 0.004 * i, 40 + 0.01 * i) for i in range(8)]
#: One more draft over the first two, and one where nobody lives.
CROSSED = [*SQUARES, (8, -74 + 0.001, 40 + 0.002), (9, 10.0, 10.0)]


def squares(s, size: float = 0.005, corners=SQUARES) -> DataFrame:
    rows = [(f"d{i}", i % 3, [{"x": x + dx, "y": y + dy} for dx, dy in ((0.0, 0.0), (size, 0.0), (size, 2 * size), (0.0, 2 * size), (0.0, 0.0))]) for i, x, y in corners]
    return s.createDataFrame(rows, "turf_draft_id string, sort_order int, ring array<struct<x: double, y: double>>")


def drawn_sql(corners) -> str:
    listed = ", ".join(f"('d{i}', {i % 3}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, x, y in corners)
    return f"squares AS (SELECT * FROM (VALUES {listed}) v(turf_draft_id, sort_order, x0, y0)), drafts AS (SELECT *, row_number() OVER (ORDER BY sort_order, turf_draft_id) - 1 AS idx FROM squares)"


SQUARES_SQL, CROSSED_SQL = drawn_sql(SQUARES), drawn_sql(CROSSED)
# a ray to the right crosses the left edge never and the right edge once
INSIDE = "(y0 > {y}) <> (y0 + 2 * 0.005 > {y}) AND {x} < x0 + 0.005 AND NOT ({x} < x0)"
LOOKUP = rf"""keyed AS (SELECT *, array_to_string(list_sort({expand(tokens(rewrite('street')))}), '|') AS canonical_key, {norm('housenumber')} AS housenumber_norm FROM addresses WHERE zip_code IS NOT NULL),
 lookup AS (SELECT zip_code, canonical_key, housenumber, housenumber_norm, street, round(lat, 6) AS osm_lat, round(lon, 6) AS osm_lon, lat, lon FROM keyed QUALIFY row_number() OVER (PARTITION BY zip_code, canonical_key, housenumber_norm ORDER BY (kind = 'way') DESC, osm_id) = 1)"""


def lookup(s, d, complexes: bool) -> DataFrame:
    out = geocode.building_lookup(addresses(s, d), squares(s) if complexes else None)
    return out.withColumns({c: F.round(c, 6) for c in ("osm_lat", "osm_lon")})


def places(s, d) -> DataFrame:
    """Buildings with a place, from the persons."""
    p = frame(s, d, "persons")
    at = {"longitude": -74 + (F.col("building_i") % 41) * 0.001 + 0.00013, "latitude": 40 + (F.col("building_i") % 83) * 0.001 + 0.00017}
    return p.withColumns(at).withColumn("door_id", F.concat_ws("|", "address_line_1", F.coalesce("address_line_2", F.lit("")), "zip5"))


PLACES = "places AS (SELECT * EXCLUDE (longitude, latitude), -74 + (building_i % 41) * 0.001::DOUBLE + 0.00013::DOUBLE AS longitude, 40 + (building_i % 83) * 0.001::DOUBLE + 0.00017::DOUBLE AS latitude FROM persons)"
HITS = f"hits AS (SELECT DISTINCT building_id, turf_draft_id, idx FROM places JOIN drafts ON {INSIDE.format(x='longitude', y='latitude')})"


def found(s, d, corners=SQUARES) -> DataFrame:
    return publish.hits(places(s, d).select("building_id", "longitude", "latitude").distinct(), squares(s, corners=corners))


def published(s, d) -> DataFrame:
    """The whole operation over the drafts that hold a building, with a sink that keeps nothing; codes are hashes, so they are left out."""
    inhabited = squares(s).join(found(s, d), "turf_draft_id", "left_semi")
    out = publish.publish(places(s, d), inhabited, s.createDataFrame([], "code string"), lambda t: t.write.format("noop").mode("overwrite").save())
    return out.select(F.col("idx").cast("bigint"), "name", *[F.col(c).cast("bigint") for c in ("building_count", "door_count", "person_count")])


def positions(s, d) -> DataFrame:
    """Persons along lines, with fractions: enough to rank and shove."""
    p = frame(s, d, "persons")
    return p.select(
        "external_id", F.col("zip5").alias("tiger_line_id"), F.when(F.col("person_h") % 2 == 0, "left").otherwise("right").alias("side"), F.lit("").alias("own_prefix"),
        (F.col("person_h") % 60).alias("person_house_number"), F.lit("").alias("half_code"), ((F.col("person_h") % 17) / 17.0).alias("frac"), (F.col("person_h") % 60).alias("house_rank"), (20.0 + F.col("building_i") % 1).alias("line_length"),
    )


def shoved(s, d) -> DataFrame:
    lengths = positions(s, d).withColumn("line_length", 40.0 + F.col("tiger_line_id").cast("int") * 10.0)
    return geocode.shoved(lengths).select("external_id", F.round("frac", 9).alias("frac"))


RANKS = "along AS (SELECT external_id, zip5 AS tiger_line_id, CASE person_h % 2 WHEN 0 THEN 'left' ELSE 'right' END AS side, person_h % 60 AS n, (person_h % 17) / 17.0::DOUBLE AS frac, 40.0::DOUBLE + cast(zip5 AS int) * 10 AS len FROM persons)"
SHOVE = """a AS (SELECT *, dense_rank() OVER (PARTITION BY tiger_line_id, side ORDER BY frac, n) AS rn FROM along), b AS (SELECT *, max(rn) OVER (PARTITION BY tiger_line_id, side) AS nb FROM a),
 c AS (SELECT *, least(4.0, 0.9 * len / greatest(nb, 1)) / len AS sep FROM b) SELECT external_id, round(least(greatest(least(max(frac - rn * sep) OVER (PARTITION BY tiger_line_id, side ORDER BY rn) + rn * sep, 0.95 - (nb - rn) * sep), 0.05), 0.95), 9) AS frac FROM c"""


def blocks(s, d) -> DataFrame:
    k = F.col("s_suppkey")
    return s.read.parquet(f"{d}/supplier.parquet").select(k.cast("string").alias("block_geoid"), ((k * 37) % 101).cast("double").alias("cx"), ((k * 53) % 97).cast("double").alias("cy"), (k % 9).alias("land_area"))


def voters(s, d) -> DataFrame:
    p = frame(s, d, "persons")
    return p.select((F.col("person_h") % 60).cast("string").alias("block_geoid"), "precinct")


BLOCKS = """voters AS (SELECT cast(person_h % 60 AS string) AS block_geoid, precinct AS key FROM persons WHERE precinct IS NOT NULL),
 blocks AS (SELECT cast(s_suppkey AS string) AS block_geoid, ((s_suppkey * 37) % 101)::DOUBLE AS cx, ((s_suppkey * 53) % 97)::DOUBLE AS cy, s_suppkey % 9 AS land_area FROM supplier),
 won AS (SELECT block_geoid, key, count(*) AS voters FROM voters GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY block_geoid ORDER BY count(*) DESC, key) = 1)"""
BACKFILL = """, known AS (SELECT b.block_geoid, cx, cy, key FROM blocks b JOIN won USING (block_geoid))
 SELECT block_geoid, key FROM won UNION ALL (SELECT u.block_geoid, k.key FROM blocks u CROSS JOIN known k WHERE u.land_area > 0 AND u.block_geoid NOT IN (SELECT block_geoid FROM won)
 QUALIFY row_number() OVER (PARTITION BY u.block_geoid ORDER BY round(sqrt((k.cx - u.cx) ** 2 + (k.cy - u.cy) ** 2), 9), k.block_geoid) = 1)"""


def raw_roster(s, d) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda n: (k % n).cast("string")
    values = {
        "sboe_id": k.cast("string"), "first_name": F.lit("A"), "last_name": F.col("c_name"), "middle_name": F.when(k % 2 == 0, "").otherwise("Q"), "name_suffix": F.lit(None).cast("string"),
        "res_house_number": text(90), "res_pre_direction": F.when(k % 3 == 0, "N").otherwise(""), "res_street_name": F.col("c_mktsegment"), "res_post_direction": F.lit(""),
        "res_apartment": F.when(k % 4 == 0, "").otherwise(text(30)), "res_apartment_type": F.when(k % 5 == 0, "APT"), "res_half_code": F.when(k % 6 == 0, "1/2"), "res_city": F.lit("X"), "res_zip5": F.lpad(text(40), 5, "1"),
        "res_zip4": F.lit(""), "enrollment": F.element_at(F.lit(["DEM", "REP", "OTH", "BLK", "???"]), (k % 5 + 1).cast("int")), "other_party": F.element_at(F.lit(["IND", "GRE", "zzz"]), (k % 3 + 1).cast("int")),
        "gender": F.lit("F"), "date_of_birth": F.when(k % 7 == 0, "1990").otherwise(F.concat(F.lit("19"), F.lpad(text(90), 2, "0"), F.lit("0215"))), "registration_date": F.lit("20050607"), "last_voted_date": F.lit(None).cast("string"),
        "status": F.element_at(F.lit(["A", "I", "AF", "17", "P"]), (k % 5 + 1).cast("int")), "county_code": text(4), "assembly_district": text(120), "election_district": text(80), "senate_district": text(30), "congressional_district": text(12), "voter_history": F.lit(None).cast("string"),
    }
    return s.read.parquet(f"{d}/customer.parquet").select(*[v.alias(n) for n, v in values.items()])


NYS = """SELECT cast(c_custkey AS string) AS external_id, concat_ws(' ', cast(c_custkey % 90 AS string), CASE WHEN c_custkey % 3 = 0 THEN 'N' END, c_mktsegment) AS address_line_1,
 CASE WHEN c_custkey % 4 <> 0 THEN concat_ws(' ', CASE WHEN c_custkey % 5 = 0 THEN 'APT' END, cast(c_custkey % 30 AS string)) END AS address_line_2, CASE WHEN c_custkey % 6 = 0 THEN '1/2' END AS half_code,
 CASE c_custkey % 5 WHEN 0 THEN 'democratic' WHEN 1 THEN 'republican' WHEN 2 THEN CASE c_custkey % 3 WHEN 0 THEN 'independence' WHEN 1 THEN 'green' ELSE 'other' END WHEN 3 THEN 'unaffiliated' END AS enrollment,
 CASE WHEN c_custkey % 7 <> 0 THEN '19' || lpad(cast(c_custkey % 90 AS string), 2, '0') || '-02-15' END AS date_of_birth,
 CASE c_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' WHEN 2 THEN 'federal_only' WHEN 3 THEN 'preregistered' ELSE 'unknown' END AS registration_status,
 lpad(cast(c_custkey % 120 AS string), 2, '0') || '-' || lpad(cast(c_custkey % 80 AS string), 3, '0') AS precinct FROM customer WHERE c_custkey % 4 <> 1 OR true"""

ENTRIES = ["20221108 GE(P)", "PR 20200623(E)", "2016 Presidential Primary (A)", "08 general(x)", "runoff 97 1997(M)", "38120810 GE(P)", "XX 20200623(E)", "no year general (P)", "20221108 GE(Z)", ""]


def histories(s, d) -> DataFrame:
    k = F.col("c_custkey")
    at = lambda n: F.element_at(F.lit(ENTRIES), ((k + n) % len(ENTRIES) + 1).cast("int"))
    raw = s.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), F.when(k % 13 != 0, F.concat_ws(";", at(0), at(3), at(7))).alias("raw"))
    rows = raw.select("id", importer.voting_history(F.col("raw")).alias("v"))
    return rows.select("id", F.size("v").cast("bigint").alias("n"), F.array_join(F.transform("v", lambda e: F.concat_ws("/", e["year"].cast("string"), e["type"], e["date"], e["method"])), ";").alias("entries"))


PARSED = ["2022/general/2022-11-08/poll_site", "2020/primary/2020-06-23/early_voting", "2016/presidential_primary/absentee", "2008/general/other", "1997/runoff/military", None, None, None, "2022/general/2022-11-08/other", None]
PARSED_SQL = "p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else repr(v)})" for i, v in enumerate(PARSED)) + ") v(i, e))"
HISTORIES = f"WITH {PARSED_SQL} SELECT c_custkey AS id, count(e) FILTER (c_custkey % 13 <> 0) AS n, coalesce(string_agg(e, ';' ORDER BY o) FILTER (c_custkey % 13 <> 0), '') AS entries FROM customer CROSS JOIN (VALUES (0, 0), (1, 3), (2, 7)) x(o, s) JOIN p ON p.i = (c_custkey + s) % {len(ENTRIES)} GROUP BY 1"


#: Streets across and up from each part's node, twenty to a row; some are busy and some are rails.
GRID = """grid AS (SELECT p_partkey AS k, p_partkey % 20 AS i FROM {part}),
 edges AS (SELECT 'h' || cast(k AS string) AS line, k AS a, k + 1 AS b, 0 AS dir, CASE k % 7 WHEN 0 THEN 'S1200' WHEN 4 THEN 'R1011' ELSE 'S1400' END AS code FROM grid WHERE i < 19
  UNION ALL SELECT 'v' || cast(k AS string), k, k + 20, 90, CASE k % 5 WHEN 0 THEN 'S1200' WHEN 3 THEN 'S1640' ELSE 'S1400' END FROM grid)"""

#: A line's place repeats after so many rows of the grid; which lines meet depends on node ids alone.
GRID_ROWS = 1000


def grid_relations(s, d) -> DataFrame:
    """Every street side of the grid is addressed."""
    edges = s.sql(f"WITH {GRID} SELECT * FROM edges", part=s.read.parquet(f"{d}/part.parquet"))

    def at(k):
        # rows are counted from a nearby one, as a grid of many rows would leave the projection (and the earth)
        row = F.floor(F.col(k) / 20) - F.floor(F.col("a") / (20 * GRID_ROWS)) * GRID_ROWS
        return geo.point(-73.99 + 0.001 * (F.col(k) % 20), 40.73 + 0.001 * row)

    lines = edges.select(F.col("line").alias("tiger_line_id"), F.col("code").alias("feature_class_code"), F.col("a").cast("string").alias("from_node_id"), F.col("b").cast("string").alias("to_node_id"), F.array(at("a"), at("b")).alias("line"))
    lines = stored(lines)
    sides = lines.where("feature_class_code like 'S%'").select("tiger_line_id", F.explode(F.lit(["left", "right"])).alias("side")).withColumn("blockface_id", F.concat_ws(":", "tiger_line_id", "side"))
    return topology.relationships(sides, lines).withColumns({c: F.array_join(c, ",") for c in ("crossed_line_ids", "crossed_classes")})


RELATIONS = f"""WITH {GRID.format(part='part')},
 costs AS (SELECT * FROM (VALUES ('S1400', 15, 1), ('S1200', 60, 2), ('S1640', 60, 2), ('R1011', 100000, 3)) c(code, m, rank)),
 ends AS (SELECT a AS node, line, 'from' AS e, dir AS bearing, code FROM edges UNION ALL SELECT b, line, 'to', dir + 180, code FROM edges),
 placed AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY bearing) - 1 AS i, count(*) OVER (PARTITION BY node) AS n FROM ends),
 ring AS (SELECT node, list({{'line': line, 'code': code, 'm': m, 'rank': rank}} ORDER BY i) AS edges FROM placed JOIN costs USING (code) GROUP BY node),
 corners AS (SELECT node, line, line || ':' || side AS face, bearing, n, 2 * i + CASE side WHEN 'right' THEN 1 ELSE 0 END AS place, CASE WHEN (e = 'from') = (side = 'left') THEN i ELSE (i - 1 + n) % n END AS w
  FROM placed CROSS JOIN (VALUES ('left'), ('right')) s(side) WHERE code LIKE 'S%'),
 pairs AS (SELECT x.node, x.face AS fa, y.face AS fb, abs((y.bearing - x.bearing + 180 + 360) % 360 - 180) AS apart, x.n,
   list_transform(range(1, (y.w - x.w + x.n) % x.n + 1), lambda s: (x.w + s) % x.n) AS ccw, list_transform(range(0, (x.w - y.w + x.n) % x.n), lambda s: (x.w - s + x.n) % x.n) AS cw, edges
  FROM corners x JOIN corners y ON x.node = y.node AND x.place < y.place AND (x.line <> y.line OR x.w = y.w) JOIN ring r ON r.node = x.node),
 ways AS (SELECT *, list_transform(CASE WHEN (coalesce(list_sum(list_transform(ccw, lambda i: edges[i + 1].m)), 0), len(ccw)) <= (coalesce(list_sum(list_transform(cw, lambda i: edges[i + 1].m)), 0), len(cw)) THEN ccw ELSE cw END, lambda i: edges[i + 1]) AS way FROM pairs)
 SELECT least(fa, fb) AS blockface_id_a, greatest(fa, fb) AS blockface_id_b, CASE len(way) WHEN 0 THEN 'hinge' WHEN 1 THEN CASE WHEN apart >= 135 THEN 'continue' ELSE 'turn' END WHEN 2 THEN 'kitty_corner' ELSE 'other' END AS kind, cast(node AS string) AS node_id,
  array_to_string(list_transform(way, lambda e: e.line), ',') AS crossed_line_ids, array_to_string(list_transform(way, lambda e: e.code), ',') AS crossed_classes,
  ['none', 'minor', 'major', 'barrier'][coalesce(list_max(list_transform(way, lambda e: e.rank)), 0) + 1] AS penalty_class, coalesce(list_sum(list_transform(way, lambda e: e.m)), 0)::DOUBLE AS crossing_cost_m FROM ways
 UNION ALL SELECT line || ':left', line || ':right', 'across', NULL, line, code, ['none', 'minor', 'major', 'barrier'][rank + 1], m::DOUBLE FROM edges JOIN costs USING (code) WHERE code LIKE 'S%'"""


def lines_of(sides: DataFrame) -> DataFrame:
    n = F.crc32(F.col("blockface_id").cast("binary")) % 100
    return sides.select("blockface_id").distinct().withColumn("line", F.array(geo.point(-74 + n * 0.001, F.lit(40.0) + n * 0.0001), geo.point(-73.998 + n * 0.001, F.lit(40.001) + n * 0.0001)))


def full_positions(s, d) -> DataFrame:
    who, sides, best = matched(s, d)
    known = stored(geocode.building_lookup(addresses(s, d), squares(s)))
    rows = stored(geocode.with_buildings(stored(geocode.keyed(best, who, sides)), known))
    return geocode.refined_positions(rows, lines_of(sides))


def canonical(s, d) -> DataFrame:
    who, sides, best = matched(s, d)
    known = stored(geocode.building_lookup(addresses(s, d)))
    rows = stored(geocode.with_buildings(stored(geocode.keyed(best, who, sides)), known))
    only = stored(geocode.only_by_building(who, best, known))
    return geocode.canonical_addresses(rows, best, who, only).withColumn("matched_tokens", F.array_join(F.array_sort("matched_tokens"), " "))


#: People with their building or street's own spelling; buildings are looked up by the words of the segment, or by their own.
CANONICAL = rf"""keyed AS (SELECT *, array_to_string(list_sort({expand(tokens(rewrite('street')))}), '|') AS canonical_key, {norm('housenumber')} AS housenumber_norm FROM addresses WHERE zip_code IS NOT NULL),
 known AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY zip_code, canonical_key, housenumber_norm ORDER BY (kind = 'way') DESC, osm_id) = 1),
 shown AS (SELECT *, {DISPLAY} AS own FROM people),
 face AS (SELECT *, array_to_string(list_sort(street_tokens_lookup), '|') AS ck FROM faces QUALIFY row_number() OVER (PARTITION BY blockface_id, coalesce(house_num_prefix, '') ORDER BY from_house_num, to_house_num, zip_code) = 1),
 placed AS (SELECT b.external_id, upper(coalesce(k.street, b.full_name)) AS street, k.housenumber FROM best b JOIN shown p USING (external_id) JOIN face f ON f.blockface_id = b.blockface_id AND coalesce(f.house_num_prefix, '') = coalesce(b.house_num_prefix, '')
  LEFT JOIN known k ON k.zip_code = p.zip5 AND k.canonical_key = f.ck AND k.housenumber_norm = {norm('p.own')}),
 rescued AS (SELECT p.external_id, upper(k.street) AS street, k.housenumber FROM shown p JOIN known k ON k.zip_code = p.zip5 AND k.canonical_key = array_to_string(list_sort({expand('p.street_name_tokens')}), '|') AND k.housenumber_norm = {norm('p.own')}
  WHERE p.external_id NOT IN (SELECT external_id FROM best)),
 lined AS (SELECT external_id, CASE WHEN n.housenumber IS NOT NULL AND {norm('n.housenumber')} = {norm('own')} THEN upper(n.housenumber) ELSE own END || ' ' || n.street AS address_line_1, lower(trim(n.street)) AS low
  FROM (SELECT * FROM placed UNION ALL SELECT * FROM rescued) n JOIN shown USING (external_id))"""


def snapped(s, d) -> DataFrame:
    who, sides, best = matched(s, d)
    only = stored(geocode.only_by_building(who, best, geocode.building_lookup(addresses(s, d))))
    n = F.crc32(F.col("blockface_id").cast("binary")) % 100
    lines = sides.select("blockface_id", "zip_code").distinct().withColumn("line_m", geo.line_to_utm(F.array(geo.point(-74 + n * 0.001, F.lit(40.0)), geo.point(-73.998 + n * 0.001, F.lit(40.001)))))
    return only.join(spatial.nearest_in_zip(only, lines), ["zip5", "latitude", "longitude"])


def assembled(s, d) -> DataFrame:
    """Every person with a place, made from the same steps as the single queries."""
    who, sides, best = matched(s, d)
    known = stored(geocode.building_lookup(addresses(s, d)))
    rows = stored(geocode.with_buildings(stored(geocode.keyed(best, who, sides)), known))
    only = stored(geocode.only_by_building(who, best, known))
    only = stored(only.join(spatial.nearest_in_zip(only, sides.select("blockface_id", "zip_code").distinct().withColumn("line_m", geo.line_to_utm(F.lit(None).cast("array<struct<x: double, y: double>>")))), ["zip5", "latitude", "longitude"], "left"))
    refined = stored(geocode.refined_positions(rows, lines_of(sides)))
    lines = stored(geocode.canonical_addresses(rows, best, who, only))
    persons = frame(s, d, "lines").withColumn("address_line_2", F.when(F.col("external_id").cast("int") % 3 > 0, F.concat(F.lit(" Num "), F.col("external_id").cast("int") % 4)))
    history = stored(frame(s, d, "history")).groupBy("external_id").agg(F.collect_list(F.struct("year", "type")).alias("voting_history"))
    persons = stored(persons.join(stored(history), "external_id", "left"))
    out = assembly.persons_geocoded(persons, best, lines, refined, only, FLOOR)
    return out.select("external_id", "zip5", "address_line_1", "address_line_2", "building_id", "door_id", F.col("building_i").cast("bigint"), F.col("door_i").cast("bigint"), "person_h", F.col("match_score").cast("bigint"), "election_mask_0")


ASSEMBLED = """registry AS (SELECT year, type FROM history GROUP BY year, type HAVING count(DISTINCT external_id) >= {floor}),
 voters AS (SELECT year, type, h.external_id FROM history h JOIN lines USING (external_id)),
 known_elections AS (SELECT year, type FROM voters GROUP BY 1, 2 HAVING count(DISTINCT external_id) >= {floor}),
 bits AS (SELECT *, row_number() OVER (ORDER BY year DESC, type) - 1 AS bit FROM known_elections),
 masks AS (SELECT external_id, bit_or(CASE WHEN bit < 64 THEN 1::UBIGINT << bit ELSE 0::UBIGINT END) AS m FROM voters JOIN bits USING (year, type) GROUP BY 1),
 units AS (SELECT external_id, zip5, CASE WHEN cast(external_id AS int) % 3 > 0 THEN 'NUM ' || cast(cast(external_id AS int) % 4 AS string) END AS address_line_2, md5_number_lower(external_id) AS h FROM lines),
 whole AS (SELECT external_id, zip5, address_line_1, address_line_2, address_line_1 || '|' || zip5 AS building_id, address_line_1 || '|' || coalesce(address_line_2, '') || '|' || zip5 AS door_id,
  h, token_overlap + bonus AS match_score, coalesce(m, 0::UBIGINT) AS m FROM lined JOIN units USING (external_id) LEFT JOIN best USING (external_id) LEFT JOIN masks USING (external_id))
 SELECT external_id, zip5, address_line_1, address_line_2, building_id, door_id, dense_rank() OVER (ORDER BY building_id) AS building_i, dense_rank() OVER (ORDER BY door_id) AS door_i,
  CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END::BIGINT AS person_h, match_score,
  CASE WHEN m >= 9223372036854775808 THEN m::HUGEINT - 18446744073709551616 ELSE m::HUGEINT END::BIGINT AS election_mask_0 FROM whole"""


def geocoded(s, d) -> DataFrame:
    p = places(s, d)
    source = F.element_at(F.lit(["osm_complex", "osm_matched", "osm_off_segment", "tiger_only", "osm_only", None]), (F.col("person_h") % 6 + 1).cast("int"))
    return p.withColumn("position_source", source)


def search_page(s, d) -> DataFrame:
    return search.search(frame(s, d, "persons"), limit=25, offset=5, last_name="customer 0000", first_name=" an ", city="").hits.select("external_id", "last_name", "first_name")


def search_documents(s, d) -> DataFrame:
    p = frame(s, d, "persons")
    key = name_key(F.col("last_name"), F.col("first_name"))
    return p.select("external_id", key.alias("sort_key"), packed(key, 1).alias("hi"), packed(key, 9).alias("lo"))


P = "persons"
BEST = f"best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY token_overlap + bonus DESC, blockface_id, full_name) = 1)"
MORE = {
    "street_rewrite": (lambda s, d: frame(s, d, "lines").select("external_id", ad.street_rewrite(F.col("address_line_1")).alias("street")), sql(f"SELECT external_id, {rewrite('address_line_1')} AS street FROM lines", "lines")),
    "tokenize_street": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(ad.tokenize_street(F.col("text")), " ").alias("tokens")), f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents"),
    "canonical_key": (lambda s, d: people(s, d).select("external_id", ad.canonical_key(ad.expand_tokens(F.col("street_name_tokens"))).alias("key")), with_sql(f"SELECT external_id, array_to_string(list_sort({expand('street_name_tokens')}), '|') AS key FROM people", ("lines",), PEOPLE)),
    "housenumber_norm": (lambda s, d: addresses(s, d).select("osm_id", ad.housenumber_norm(F.col("housenumber")).alias("norm")), f"WITH {ADDRESSES_SQL.format(part='part')} SELECT osm_id, {norm('housenumber')} AS norm FROM addresses"),
    "housenumber_display": (lambda s, d: people(s, d).select("external_id", ad.housenumber_display(F.col("house_num_prefix"), F.col("house_number"), F.col("half_code")).alias("shown")), with_sql(f"SELECT external_id, {DISPLAY} AS shown FROM people", ("lines",), PEOPLE)),
    "persons_decomposed": (lambda s, d: people(s, d).withColumns(join_words("street_name_tokens")), with_sql("SELECT * REPLACE (array_to_string(street_name_tokens, ' ') AS street_name_tokens) FROM people", ("lines",), PEOPLE)),
    "blockface_unpivot": (lambda s, d: matching.unpivoted(features(s, d), edges_of(s, d)).drop("street_name_tokens"), UNPIVOT),
    "blockface_normalized": (lambda s, d: normalized(s, d).select("blockface_id", "zip_code", "full_name", "from_house_num", "to_house_num", "house_num_prefix", "number_type"), with_sql("SELECT blockface_id, zip_code, full_name, from_house_num, to_house_num, house_num_prefix, number_type FROM typed", ("unpivoted",), FACES)),
    "blockface_final": (lambda s, d: faces(s, d).drop("from_node_id", "to_node_id").withColumns(join_words("street_tokens_match", "street_tokens_lookup")), with_sql("SELECT * REPLACE (array_to_string(street_tokens_match, ' ') AS street_tokens_match, array_to_string(street_tokens_lookup, ' ') AS street_tokens_lookup) FROM faces", ("unpivoted",), FACES)),
    "persons_candidates": (lambda s, d: scored(s, d).select("external_id", "blockface_id", "full_name", "token_overlap", "match_score"), with_sql("SELECT external_id, blockface_id, full_name, token_overlap, token_overlap + bonus AS match_score FROM scored", ("lines", "unpivoted"), PEOPLE, FACES, SCORED)),
    "persons_best_match": (lambda s, d: matching.best_matches(stored(people(s, d)), stored(faces(s, d)), SEGMENT).select("external_id", "blockface_id", "full_name", "match_score"), with_sql("SELECT external_id, blockface_id, full_name, token_overlap + bonus AS match_score FROM best", ("lines", "unpivoted"), PEOPLE, FACES, SCORED, BEST)),
    "osm_building_lookup": (lambda s, d: lookup(s, d, False).drop("in_residential_complex"), f"WITH {ADDRESSES_SQL.format(part='part')}, {LOOKUP} SELECT * EXCLUDE (lat, lon) FROM lookup"),
    "osm_building_complexes": (lambda s, d: lookup(s, d, True).select("zip_code", "canonical_key", "housenumber_norm", "in_residential_complex"), f"WITH {ADDRESSES_SQL.format(part='part')}, {LOOKUP}, {SQUARES_SQL} SELECT zip_code, canonical_key, housenumber_norm, EXISTS (SELECT 1 FROM squares WHERE {INSIDE.format(x='lon', y='lat')}) AS in_residential_complex FROM lookup"),
    "refined_positions_rank": (lambda s, d: geocode.ranked(positions(s, d)).select("external_id", F.col("house_rank").cast("bigint"), F.col("max_rank").cast("bigint")), with_sql("SELECT external_id, house_rank, max(house_rank) OVER (PARTITION BY tiger_line_id, side) AS max_rank FROM (SELECT *, dense_rank() OVER (PARTITION BY tiger_line_id, side ORDER BY n) AS house_rank FROM along)", (P,), RANKS)),
    "refined_positions_shove": (shoved, with_sql("", (P,), RANKS).rstrip() + ", " + SHOVE),
    "refined_positions_full": (full_positions, None),
    "osm_only_snap": (snapped, None),
    "canonical_addresses": (canonical, f"WITH {ADDRESSES_SQL.format(part='part')}, " + with_sql("SELECT external_id, address_line_1, array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_split_to_array(low, '[^a-z0-9]+'), regexp_extract_all(low, '[0-9]+')), lambda t: length(t) > 0))), ' ') AS matched_tokens FROM lined", ("lines", "unpivoted"), PEOPLE, FACES, SCORED, BEST, CANONICAL).removeprefix("WITH ")),
    "persons_geocoded": (assembled, f"WITH {ADDRESSES_SQL.format(part='part')}, " + with_sql("", ("lines", "unpivoted", "history"), PEOPLE, FACES, SCORED, BEST, CANONICAL).removeprefix("WITH ").rstrip() + ", " + ASSEMBLED.format(floor=FLOOR)),
    "geocoding_summary": (lambda s, d: geocode.summary(geocoded(s, d), geocoded(s, d).where("position_source is not null")), with_sql("SELECT count(*) AS total, count(*) FILTER (m) AS matched, count(*) FILTER (NOT m) AS unmatched, round(100.0 * count(*) FILTER (m) / count(*), 2)::DOUBLE AS match_rate, count(*) FILTER (m AND k = 0) AS osm_complex, count(*) FILTER (m AND k = 1) AS osm_matched, count(*) FILTER (m AND k = 2) AS osm_off_segment, count(*) FILTER (m AND k = 3) AS tiger_only, count(*) FILTER (m AND k = 4) AS osm_only FROM (SELECT person_h % 6 <> 5 AS m, person_h % 6 AS k FROM places)", (P,), PLACES)),
    "buildings_geocoded": (lambda s, d: geocode.rollup(geocoded(s, d), "building_id").withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")}), with_sql("SELECT building_id, zip5, min(address_line_1) AS address_line_1, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, count(DISTINCT door_i) AS door_count, count(*) AS person_count FROM places GROUP BY 1, 2", (P,), PLACES)),
    "doors_geocoded": (lambda s, d: geocode.rollup(geocoded(s, d), "door_id").select("door_id", "person_count"), with_sql("SELECT address_line_1 || '|' || coalesce(address_line_2, '') || '|' || zip5 AS door_id, count(*) AS person_count FROM places GROUP BY 1, zip5", (P,), PLACES)),
    "dense_building_ids": (lambda s, d: spatial.dense_ids(frame(s, d, P).select("external_id", F.when(F.col("person_h") % 8 > 0, F.col("building_id")).alias("b")), "b", "i").select("external_id", F.col("i").cast("bigint")), sql("SELECT external_id, CASE WHEN b IS NOT NULL THEN dense_rank() OVER (ORDER BY b NULLS LAST) END AS i FROM (SELECT external_id, CASE WHEN person_h % 8 > 0 THEN building_id END AS b FROM persons)", P)),
    "person_hash": (lambda s, d: frame(s, d, P).select("external_id", person_hash(F.col("external_id")).alias("h")), sql("SELECT external_id, CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END::BIGINT AS h FROM (SELECT external_id, md5_number_lower(external_id) AS h FROM persons)", P)),
    "boundary_majority_key": (lambda s, d: spatial.majority_key(voters(s, d), "precinct"), with_sql("SELECT * FROM won", (P,), BLOCKS)),
    "boundary_backfill": (lambda s, d: spatial.backfilled(blocks(s, d), spatial.majority_key(voters(s, d), "precinct")), with_sql("", (P,), BLOCKS).rstrip() + BACKFILL),
    "publish_assign": (lambda s, d: publish.assigned(found(s, d)).select("building_id", F.col("idx").cast("bigint")), with_sql("SELECT building_id, min(idx) AS idx FROM hits GROUP BY 1", (P,), PLACES, SQUARES_SQL, HITS)),
    "publish_ambiguous": (lambda s, d: publish.ambiguous(found(s, d)), with_sql("SELECT building_id, count(*) AS drafts FROM hits GROUP BY 1 HAVING count(*) >= 2", (P,), PLACES, SQUARES_SQL, HITS)),
    "publish_empty": (lambda s, d: publish.empty(found(s, d), squares(s)), with_sql("SELECT turf_draft_id FROM squares WHERE turf_draft_id NOT IN (SELECT turf_draft_id FROM hits)", (P,), PLACES, SQUARES_SQL, HITS)),
    "publish_crossed": (lambda s, d: publish.ambiguous(found(s, d, CROSSED)), with_sql("SELECT building_id, count(*) AS drafts FROM hits GROUP BY 1 HAVING count(*) >= 2", (P,), PLACES, CROSSED_SQL, HITS)),
    "publish_uninhabited": (lambda s, d: publish.empty(found(s, d, CROSSED), squares(s, corners=CROSSED)), with_sql("SELECT turf_draft_id FROM squares WHERE turf_draft_id NOT IN (SELECT turf_draft_id FROM hits)", (P,), PLACES, CROSSED_SQL, HITS)),
    "publish_turfs": (published, with_sql("SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, 'Turf ' || cast(row_number() OVER (ORDER BY idx) AS string) AS name, building_count, door_count, person_count FROM (SELECT idx, 'Turf ' || cast(idx + 1 AS string) AS name, count(DISTINCT building_id) AS building_count, count(DISTINCT door) AS door_count, count(external_id) AS person_count FROM drafts LEFT JOIN (SELECT external_id, building_id, address_line_1 || coalesce(address_line_2, '') || zip5 AS door, (SELECT min(h.idx) FROM hits h WHERE h.building_id = p.building_id) AS idx FROM places p) USING (idx) GROUP BY 1) WHERE building_count > 0", (P,), PLACES, SQUARES_SQL, HITS)),
    "publish_payload": (lambda s, d: publish.payloads(places(s, d), found(s, d), squares(s)).select(F.col("idx").cast("bigint"), "name", *[F.col(c).cast("bigint") for c in ("building_count", "door_count", "person_count")]), with_sql("SELECT idx, 'Turf ' || cast(idx + 1 AS string) AS name, count(DISTINCT building_id) AS building_count, count(DISTINCT door) AS door_count, count(external_id) AS person_count FROM drafts LEFT JOIN (SELECT external_id, building_id, address_line_1 || coalesce(address_line_2, '') || zip5 AS door, (SELECT min(h.idx) FROM hits h WHERE h.building_id = p.building_id) AS idx FROM places p) USING (idx) GROUP BY 1", (P,), PLACES, SQUARES_SQL, HITS)),
    "blockface_relationships": (grid_relations, RELATIONS),
    "nys_transform": (lambda s, d: importer.canonical(raw_roster(s, d)).select("external_id", "address_line_1", "address_line_2", "half_code", "enrollment", "date_of_birth", "registration_status", "precinct"), NYS),
    "parse_voting_history": (histories, HISTORIES),
    "persons_search": (search_page, sql("SELECT external_id, last_name, first_name FROM persons WHERE len(list_filter(regexp_split_to_array(lower(last_name), '[^a-z0-9]+'), lambda w: starts_with(w, 'customer'))) > 0 AND len(list_filter(regexp_split_to_array(lower(last_name), '[^a-z0-9]+'), lambda w: starts_with(w, '0000'))) > 0 AND lower(first_name) LIKE 'an%' ORDER BY rpad(substr(strip_accents(upper(last_name || ' ' || first_name)), 1, 16), 16, ' '), external_id LIMIT 25 OFFSET 5", P)),
    "search_documents": (search_documents, sql("SELECT external_id, sk AS sort_key, list_reduce(list_transform(range(1, 9), lambda i: least(ascii(sk[i:i]), 255)::BIGINT), lambda a, b: a * 256 + b) AS hi, list_reduce(list_transform(range(9, 17), lambda i: least(ascii(sk[i:i]), 255)::BIGINT), lambda a, b: a * 256 + b) AS lo FROM (SELECT external_id, rpad(substr(upper(strip_accents(concat_ws(' ', last_name, first_name))), 1, 16), 16, ' ') AS sk FROM persons)", P)),
}
QUERIES = {n: q for n, (q, _) in MORE.items()}
ORACLE = {n: o for n, (_, o) in MORE.items() if o}
