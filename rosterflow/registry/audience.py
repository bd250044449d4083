"""Queries over criteria, elections, custom fields and the contact log, with their SQL."""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contacts, counts, custom_fields, elections
from ..plans.compile import Compiler
from ..plans.expand import resolve
from ..plans.model import Catalog, FieldDef, criteria, step
from .fixtures import FLOOR, TODAY, frame, persons_with_history, sql

FIELDS = {
    "enrollment": FieldDef("enum", "enrollment"), "gender": FieldDef("enum", "gender"), "age": FieldDef("age-range", "date_of_birth"),
    "name": FieldDef("text", "last_name"), "first": FieldDef("text", "first_name"), "precinct": FieldDef("text-multi", "precinct"), "registered": FieldDef("date-range", "registration_date"),
    "score": FieldDef("number-range", "f_fnum", True), "group": FieldDef("enum", "f_fenum", True), "joined": FieldDef("date-range", "f_fdate", True),
    "code": FieldDef("text-multi", "f_fcode", True),
}
CUSTOM = {"f-num": "number", "f-enum": "enum", "f-date": "date", "f-code": "text-multi"}
GROUPS = {"counties": "county_code", "zips": "zip5", "precincts": "precinct"}
S = step
HIGH_ENUM = S("narrow", "enum", key="enrollment", values=["building", "machinery"])
FEMALE = S("add", "enum", key="gender", values=["F"])
OLD = S("narrow", "age-range", key="age", min=40, max=70)
NOT_X = S("remove", "enum", key="gender", values=["X"])
YEARS = f"extract(year FROM age(DATE '{TODAY}', try_strptime(date_of_birth, '%Y-%m-%d')::DATE))"
IN_ENUM, IS_F, IS_OLD, IS_X = "enrollment IN ('building', 'machinery')", "gender IN ('F')", f"({YEARS} >= 40 AND {YEARS} <= 70)", "gender IN ('X')"
SEGMENTS = {"s1": criteria(HIGH_ENUM, NOT_X), "s2": criteria(S("narrow", "segment", segmentId="s1"), FEMALE)}


def in_wide(predicate: str) -> str:
    return f"person_h IN (SELECT person_h FROM wide WHERE {predicate})"


WIDE = """wide AS (SELECT person_h, try_cast(max(value) FILTER (field_id = 'f-num') AS double) AS n, max(value) FILTER (field_id = 'f-enum') AS e,
    try_cast(max(value) FILTER (field_id = 'f-date') AS date) AS d, max(value) FILTER (field_id = 'f-code') AS c FROM field_values GROUP BY person_h)"""
WIN = "(n >= 100 AND n <= 6000)"

#: name -> (tree, key filter, WHERE clause)
COUNTS = {
    "persons_count_all": (criteria(), None, "true"),
    "persons_count_enum": (criteria(HIGH_ENUM), None, IN_ENUM),
    "persons_count_text": (criteria(S("narrow", "text", key="name", value="0_7"), S("narrow", "text", key="first", value="É")), None, "last_name ILIKE '%0_7%' AND first_name ILIKE '%É%'"),
    "persons_count_textmulti": (criteria(S("narrow", "text-multi", key="precinct", values=[" EUROPE ", "", "AFRICA"])), None, "precinct IN ('EUROPE', 'AFRICA')"),
    "persons_count_date": (criteria(S("narrow", "date-range", key="registered", min="2005-03-01", max="2011-12-31")), None, "registration_date >= '2005-03-01' AND registration_date <= '2011-12-31'"),
    "persons_count_age": (criteria(OLD), None, IS_OLD),
    "persons_count_address": (criteria(S("narrow", "address", line1="1 ", city="an", state=" eu ", zip="")), None, "address_line_1 ILIKE '%1%' AND city ILIKE '%an%' AND state = 'EU'"),
    "criteria_verbs_mixed": (criteria(HIGH_ENUM, FEMALE, NOT_X, OLD), None, f"((({IN_ENUM}) OR ({IS_F})) AND NOT ({IS_X})) AND ({IS_OLD})"),
    "criteria_remove_first": (criteria(NOT_X, HIGH_ENUM), None, f"(NOT ({IS_X})) AND ({IN_ENUM})"),
    "criteria_null_remove": (criteria(S("remove", "text-multi", key="precinct", values=["EUROPE"])), None, "NOT (precinct IN ('EUROPE'))"),
    "criteria_all_reset": (criteria(HIGH_ENUM, S("add", "all"), NOT_X), None, f"(({IN_ENUM}) OR true) AND NOT ({IS_X})"),
    "criteria_inactive": (criteria(S("remove", "enum", key="gender", values=[]), S("remove", "text", key="name", value="  "), HIGH_ENUM, S("narrow", "nested", criteria=criteria())), None, IN_ENUM),
    "criteria_nested_segments": (criteria(OLD, S("remove", "segment", segmentId="s2"), S("add", "segment", segmentId="gone")), None, f"({IS_OLD}) AND NOT ((({IN_ENUM}) AND NOT ({IS_X})) OR ({IS_F}))"),
    "criteria_id_set": (criteria(S("narrow", "person-id-set", ids=[str(i) for i in range(0, 3000, 3)] + ["x"] * 500), FEMALE), None, f"(person_h % 3 = 0 AND person_h < 3000) OR ({IS_F})"),
    "criteria_id_set_empty": (criteria(S("narrow", "person-id-set", ids=[]), FEMALE), None, f"false OR ({IS_F})"),
    "key_filter_clip": (criteria(HIGH_ENUM, FEMALE), ("counties", ["1", "3"]), f"(({IN_ENUM}) OR ({IS_F})) AND (county_code IN ('1', '3'))"),
    "key_filter_empty": (criteria(FEMALE), ("zips", []), f"({IS_F}) AND false"),
    "custom_filters_folded": (criteria(S("narrow", "number-range", key="score", min=100, max=6000), S("narrow", "enum", key="group", values=["building", "household"]), FEMALE), None, f"({in_wide(WIN + ' AND e IN (' + chr(39) + 'building' + chr(39) + ', ' + chr(39) + 'household' + chr(39) + ')')}) OR ({IS_F})"),
    "custom_filter_or": (criteria(FEMALE, S("add", "date-range", key="joined", min="2012-01-01", max=""), S("remove", "text-multi", key="code", values=["3", "17"])), None, f"(({IS_F}) OR {in_wide('d >= DATE ' + chr(39) + '2012-01-01' + chr(39))}) AND NOT ({in_wide('c IN (' + chr(39) + '3' + chr(39) + ', ' + chr(39) + '17' + chr(39) + ')')})"),
    "custom_no_table": (criteria(FEMALE, S("add", "number-range", key="score", min=0, max=None)), None, f"({IS_F}) OR false"),
}
TOTALS = "count(*) AS person_count, count(DISTINCT door_i) AS door_count, count(DISTINCT building_i) AS building_count"


def wide_table(spark, sf_dir: str) -> DataFrame:
    return custom_fields.wide(frame(spark, sf_dir, "field_values"), CUSTOM)


def compiled(spark, sf_dir: str, tree, key_filter=None, wide: bool = True, registry=None):
    has_custom = any(FIELDS.get(s.filter.key) and FIELDS[s.filter.key].custom for s in tree.steps)
    catalog = Catalog(FIELDS, GROUPS, wide_table(spark, sf_dir) if wide and has_custom else None, registry, TODAY)
    tree = resolve(tree, SEGMENTS.get, contacts.latest_results(frame(spark, sf_dir, "contacts")))
    return Compiler(catalog).compile(tree, key_filter)


def run_count(spark, sf_dir: str, name: str) -> DataFrame:
    tree, key_filter, _ = COUNTS[name]
    return counts.person_count(frame(spark, sf_dir, "persons"), compiled(spark, sf_dir, tree, key_filter, wide=name != "custom_no_table"))


def matching(spark, sf_dir: str, *steps) -> DataFrame:
    return compiled(spark, sf_dir, criteria(*steps)).filter(frame(spark, sf_dir, "persons"))


CASCADES = {
    "count_cascade_narrow": ((HIGH_ENUM, OLD, S("narrow", "enum", key="gender", values=["F"])), [IN_ENUM, f"({IN_ENUM}) AND {IS_OLD}", f"({IN_ENUM}) AND {IS_OLD} AND {IS_F}"]),
    "count_cascade_add": ((HIGH_ENUM, FEMALE, OLD), [IN_ENUM, f"({IN_ENUM}) OR {IS_F}", f"(({IN_ENUM}) OR {IS_F}) AND {IS_OLD}"]),
    "count_cascade_remove": ((NOT_X, HIGH_ENUM, S("remove", "text-multi", key="precinct", values=["EUROPE"])), [f"NOT ({IS_X})", f"NOT ({IS_X}) AND {IN_ENUM}", f"NOT ({IS_X}) AND {IN_ENUM} AND NOT (precinct IN ('EUROPE'))"]),
    "count_cascade_inactive": ((S("narrow", "enum", key="gender", values=[]), HIGH_ENUM, S("remove", "text", key="name", value="")), ["true", IN_ENUM, IN_ENUM]),
    "count_cascade_custom": ((HIGH_ENUM, S("narrow", "number-range", key="score", min=100, max=6000), FEMALE), [IN_ENUM, f"{IN_ENUM} AND {in_wide(WIN)}", f"({IN_ENUM} AND {in_wide(WIN)}) OR {IS_F}"]),
}


def run_cascade(spark, sf_dir: str, name: str) -> DataFrame:
    tree = criteria(*CASCADES[name][0])
    has_custom = any(FIELDS[s.filter.key].custom for s in tree.steps)
    compiler = Compiler(Catalog(FIELDS, GROUPS, wide_table(spark, sf_dir) if has_custom else None, None, TODAY))
    steps = compiler.step_clauses(tree)
    return counts.cascade(frame(spark, sf_dir, "persons"), compiler.compile(tree), steps)


def cascade_sql(name: str) -> str:
    prefixes = ["true", *CASCADES[name][1]]
    rows = " UNION ALL ".join(f"SELECT {i} AS step, count(*) AS persons FROM persons WHERE {p}" for i, p in enumerate(prefixes))
    head = sql("", "persons", "field_values").rstrip()
    return f"{head}, {WIDE}, rows AS ({rows}) SELECT step, persons, persons - lag(persons) OVER (ORDER BY step) AS delta FROM rows"


# elections

REGISTRY_SQL = f"""registry AS (SELECT year, type, count(DISTINCT external_id) AS voters FROM history GROUP BY year, type HAVING count(DISTINCT external_id) >= {FLOOR}),
 bits AS (SELECT *, row_number() OVER (ORDER BY year DESC, type) - 1 AS bit FROM registry)"""
SIGNED = "CASE WHEN m >= 9223372036854775808 THEN m::HUGEINT - 18446744073709551616 ELSE m::HUGEINT END::BIGINT"
MASKS_SQL = f"""masks AS (SELECT p.external_id, coalesce(bit_or(CASE WHEN bit < 64 THEN 1::UBIGINT << bit ELSE 0::UBIGINT END), 0::UBIGINT) AS m0,
 coalesce(bit_or(CASE WHEN bit >= 64 THEN 1::UBIGINT << (bit - 64) ELSE 0::UBIGINT END), 0::UBIGINT) AS m1
 FROM persons p LEFT JOIN history h USING (external_id) LEFT JOIN bits USING (year, type) GROUP BY p.external_id)"""


def history_sql(query: str) -> str:
    return f"{sql('', 'persons', 'history').rstrip()}, {REGISTRY_SQL} {query}"


def election_registry(spark, sf_dir: str) -> DataFrame:
    return elections.registry(persons_with_history(spark, sf_dir), FLOOR).withColumn("bit", F.col("bit").cast("bigint"))


def masked(spark, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    persons = persons_with_history(spark, sf_dir)
    bits = elections.bits(elections.registry(persons, FLOOR))
    out = elections.with_masks(persons, bits)
    return out if "election_mask_1" in out.columns else out.withColumn("election_mask_1", F.lit(0).cast("bigint")), bits


def election_masks(spark, sf_dir: str) -> DataFrame:
    return masked(spark, sf_dir)[0].select("external_id", "election_mask_0", "election_mask_1")


HISTORY = {
    "voting_history_count": (S("narrow", "voting-history-count", type="primary", windowYears=30, comparator=">=", count=2), "(SELECT count(*) FROM history h JOIN bits USING (year, type) WHERE h.external_id = p.external_id AND h.type IN ('primary', 'presidential_primary') AND h.year > 1996) >= 2"),
    "voting_history_none": (S("narrow", "voting-history-count", type="general", windowYears=2, comparator="=", count=0), "true"),
    "voting_history_detail_any": (S("narrow", "voting-history-detail", mode="any", elections=["1996-general", "1995-runoff_o", "1800-general"]), "EXISTS (SELECT 1 FROM history h JOIN bits USING (year, type) WHERE h.external_id = p.external_id AND ((h.year = 1996 AND h.type = 'general') OR (h.year = 1995 AND h.type = 'runoff_o')))"),
    "voting_history_detail_all": (S("narrow", "voting-history-detail", mode="all", elections=["1996-general", "1997-primary"]), "(SELECT count(DISTINCT h.year) FROM history h JOIN bits USING (year, type) WHERE h.external_id = p.external_id AND ((h.year = 1996 AND h.type = 'general') OR (h.year = 1997 AND h.type = 'primary'))) = 2"),
    "voting_history_unknown_key": (S("narrow", "voting-history-detail", mode="all", elections=["1996-general", "1800-general"]), "false"),
}


def run_history(spark, sf_dir: str, name: str) -> DataFrame:
    persons, bits = masked(spark, sf_dir)
    return counts.person_count(persons, Compiler(Catalog(FIELDS, GROUPS, None, bits, TODAY)).compile(criteria(HISTORY[name][0])))


# contacts

LATEST_SQL = """latest AS (SELECT turf_id, person_id, payload, payload->>'$.outcome' AS outcome FROM contacts WHERE kind = 'result'
 QUALIFY row_number() OVER (PARTITION BY turf_id, person_id ORDER BY sequence DESC) = 1)"""


def contacts_sql(query: str, *more: str) -> str:
    return f"{sql('', 'contacts', *more).rstrip()}, {LATEST_SQL} {query}"


def events(spark, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "contacts")


def contact_filter(spark, sf_dir: str, step_) -> DataFrame:
    tree = resolve(criteria(step_), SEGMENTS.get, contacts.latest_results(events(spark, sf_dir)))
    return counts.person_count(frame(spark, sf_dir, "persons"), Compiler(Catalog(FIELDS, GROUPS)).compile(tree))


def zone_tables(spark, sf_dir: str) -> DataFrame:
    people = frame(spark, sf_dir, "persons")
    drafts = people.where("zip5 < '00020'").select(F.col("zip5").alias("zone_id"))
    turfs = people.where("zip5 > '00004'").select(F.col("zip5").alias("zone_id"), (F.col("person_h") % 2 == 0).alias("active"))
    return contacts.zone_stats(drafts, turfs)


def door_progress(spark, sf_dir: str) -> DataFrame:
    residents = frame(spark, sf_dir, "persons").select(F.col("external_id").alias("person_id"), F.col("door_i").alias("door_id"))
    done = contacts.recorded(contacts.latest_results(events(spark, sf_dir)))
    return contacts.door_progress(residents, done)


def walks(spark, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    phone = F.when(F.col("sequence") % 13 != 0, (F.col("sequence") % 11).cast("string"))
    turf = F.concat(F.lit("t"), F.floor(F.unix_timestamp("created_at") / 36_000 % 5).cast("string"))
    opens = log.select(F.lit("o1").alias("organization_id"), turf.alias("turf_id"), phone.alias("phone"), F.col("created_at").alias("opened_at")).where("phone is not null").distinct()
    alone = log.where("sequence % 13 = 0").select(F.lit("o1").alias("organization_id"), turf.alias("turf_id"), F.lit(None).cast("string").alias("phone"), F.col("created_at").alias("opened_at"))
    return contacts.opened_walks(opens.unionByName(alone))


def units(spark, sf_dir: str) -> DataFrame:
    p = frame(spark, sf_dir, "persons")
    listed = F.lit(["PH", None, "APT 5B", "5-10", "5-2", "B12", "apt PH1", "Unit 12 A", "# 3", "12AA", "Suite B2", "2"])
    unit = F.element_at(listed, (F.col("person_h") % 12 + 1).cast("int"))
    return p.select((F.col("person_h") % 20).alias("building_id"), F.col("person_h").alias("door_id"), unit.alias("unit"))


def upload_checks(spark, sf_dir: str) -> DataFrame:
    people = frame(spark, sf_dir, "persons").select("external_id", "date_of_birth")
    parsed = custom_fields.parse_upload(people)
    return custom_fields.problems(parsed.values, "date")


def custom_append(spark, sf_dir: str) -> DataFrame:
    after = custom_fields.append(frame(spark, sf_dir, "field_values"), frame(spark, sf_dir, "new_values"))
    return custom_fields.coverage(after).select("field_id", "coverage", F.size("options").cast("bigint").alias("n_options"), F.array_join(F.slice("options", 1, 5), ",").alias("first_options"))


def custom_clear(spark, sf_dir: str) -> DataFrame:
    values = frame(spark, sf_dir, "field_values")
    before = custom_fields.coverage(values)
    after = custom_fields.coverage(custom_fields.clear(values, "f-num"))
    return custom_fields.merged_coverage(before, after).select("field_id", "coverage", F.size("options").cast("bigint").alias("n_options"))


#: A phone's openings one after the other: the same turf within five hours of its walk's opening opens nothing.
WALKS = sql("""opens AS (SELECT DISTINCT 't' || cast(cast(floor(epoch(created_at) / 36000 % 5) AS int) AS string) AS turf_id, cast(sequence % 11 AS string) AS phone, created_at AS opened_at FROM contacts WHERE sequence % 13 <> 0),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY opened_at, turf_id) AS k FROM opens),
 walked AS (SELECT phone, k, turf_id, opened_at, turf_id AS walk_turf, opened_at AS walk_at, true AS fresh FROM numbered WHERE k = 1
  UNION ALL SELECT n.phone, n.k, n.turf_id, n.opened_at, CASE WHEN n.turf_id = w.walk_turf AND n.opened_at <= w.walk_at + INTERVAL 5 HOUR THEN w.walk_turf ELSE n.turf_id END,
   CASE WHEN n.turf_id = w.walk_turf AND n.opened_at <= w.walk_at + INTERVAL 5 HOUR THEN w.walk_at ELSE n.opened_at END, NOT (n.turf_id = w.walk_turf AND n.opened_at <= w.walk_at + INTERVAL 5 HOUR)
  FROM walked w JOIN numbered n ON n.phone = w.phone AND n.k = w.k + 1)
 SELECT 'o1' AS organization_id, turf_id, phone, opened_at, lead(opened_at) OVER (PARTITION BY phone ORDER BY k) AS closed_at FROM walked WHERE fresh
 UNION ALL SELECT 'o1', 't' || cast(cast(floor(epoch(created_at) / 36000 % 5) AS int) AS string), NULL, created_at, NULL FROM contacts WHERE sequence % 13 = 0""", "contacts").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nopens AS", ",\nopens AS", 1)
#: Units in their order within a building, written out by hand.
UNITS = sql("""SELECT building_id, door_id, row_number() OVER (PARTITION BY building_id ORDER BY nr, door_id) AS place FROM (SELECT person_h % 20 AS building_id, person_h AS door_id,
 [1, 12, 8, 7, 6, 10, 2, 3, 9, 4, 11, 10][person_h % 12 + 1] AS k, person_h % 12 AS u FROM persons) JOIN (VALUES (0, 1), (6, 2), (7, 3), (9, 4), (4, 5), (3, 6), (2, 7), (8, 8), (11, 9), (5, 10), (10, 11), (1, 12)) o(u, nr) USING (u)""", "persons")


NEWER = "all_values AS (SELECT * FROM field_values v WHERE NOT EXISTS (SELECT 1 FROM new_values n WHERE n.external_id = v.external_id AND n.field_id = v.field_id) UNION ALL SELECT * FROM new_values)"
PEOPLE_F = f"SELECT * FROM persons WHERE {IS_F}"
FEMALE_FIRST = S("narrow", "enum", key="gender", values=["F"])

QUERIES = {n: partial(run_count, name=n) for n in COUNTS} | {n: partial(run_cascade, name=n) for n in CASCADES} | {n: partial(run_history, name=n) for n in HISTORY}
ORACLE = {n: f"{sql('', 'persons', 'field_values').rstrip()}, {WIDE} SELECT {TOTALS} FROM persons WHERE {where}" for n, (_, _, where) in COUNTS.items()}
ORACLE |= {n: cascade_sql(n) for n in CASCADES}
ORACLE |= {n: history_sql(f"SELECT {TOTALS} FROM persons p WHERE {where}") for n, (_, where) in HISTORY.items()}

MORE = {
    "count_by_key": (lambda s, d: counts.count_by_key(matching(s, d, FEMALE_FIRST), "precinct"), sql(f"SELECT precinct AS key, count(DISTINCT door_i) AS doors, count(*) AS people FROM persons WHERE {IS_F} AND precinct IS NOT NULL GROUP BY 1", "persons")),
    "persons_sample": (lambda s, d: counts.sample(matching(s, d, FEMALE_FIRST), 50, seed=1), None),
    "segment_export": (lambda s, d: counts.export(matching(s, d, FEMALE_FIRST)), sql(f"SELECT external_id, external_id_type, first_name, middle_name, last_name, address_line_1, address_line_2, city, state, zip5 FROM persons WHERE {IS_F}", "persons")),
    "person_detail": (lambda s, d: counts.detail(frame(s, d, "persons"), "42"), sql("SELECT * EXCLUDE (building_id, building_i, door_i, person_h, latitude, longitude) FROM persons WHERE external_id = '42'", "persons")),
    "buildings_list": (lambda s, d: counts.buildings_list(matching(s, d, FEMALE_FIRST), frame(s, d, "persons").groupBy("building_id").agg(F.avg("longitude").alias("longitude"), F.avg("latitude").alias("latitude"))).withColumns({c: F.round(c, 6) for c in ("longitude", "latitude")}), sql(f"SELECT b.building_id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, count(DISTINCT door_i) AS door_count, count(*) AS person_count FROM (SELECT building_id, avg(longitude) AS longitude, avg(latitude) AS latitude FROM persons GROUP BY 1) b JOIN (SELECT building_id, door_i FROM persons WHERE {IS_F}) p ON p.building_id = b.building_id GROUP BY 1, 2, 3", "persons")),
    "buildings_points": (lambda s, d: counts.building_points(matching(s, d, FEMALE_FIRST), frame(s, d, "persons").groupBy("building_i").agg(F.avg("longitude").alias("longitude"), F.avg("latitude").alias("latitude"))).select("building_i", F.round("dx", 8).alias("dx"), F.round("dy", 8).alias("dy")), sql(f"SELECT building_i, round(x - avg(x) OVER (), 8) AS dx, round(y - avg(y) OVER (), 8) AS dy FROM (SELECT building_i, (longitude + 180) / 360 AS x, (1 - ln(tan(pi() / 4 + radians(latitude) / 2)) / pi()) / 2 AS y FROM (SELECT building_i, avg(longitude) AS longitude, avg(latitude) AS latitude FROM persons GROUP BY 1)) WHERE building_i IN (SELECT building_i FROM persons WHERE {IS_F})", "persons")),
    "election_registry": (election_registry, history_sql("SELECT year, type, voters, bit FROM bits")),
    "election_masks": (election_masks, history_sql(f", {MASKS_SQL} SELECT external_id, {SIGNED.replace('m::', 'm0::').replace('m >=', 'm0 >=')} AS election_mask_0, {SIGNED.replace('m::', 'm1::').replace('m >=', 'm1 >=')} AS election_mask_1 FROM masks").replace(" , masks", ", masks")),
    "custom_wide_pivot": (lambda s, d: wide_table(s, d), f"{sql('', 'field_values').rstrip()}, {WIDE} SELECT person_h, n AS f_fnum, e AS f_fenum, d AS f_fdate, c AS f_fcode FROM wide"),
    "custom_latest_wins": (custom_append, f"{sql('', 'field_values', 'new_values').rstrip()}, {NEWER} SELECT field_id, count(DISTINCT external_id) AS coverage, count(DISTINCT value) AS n_options, array_to_string(list_sort(list(DISTINCT value))[1:5], ',') AS first_options FROM all_values GROUP BY 1"),
    "custom_clear": (custom_clear, sql("SELECT field_id, count(DISTINCT external_id) FILTER (field_id <> 'f-num') AS coverage, count(DISTINCT value) AS n_options FROM field_values GROUP BY 1", "field_values")),
    "custom_matched": (lambda s, d: custom_fields.matched(frame(s, d, "field_values"), matching(s, d, FEMALE_FIRST)), sql(f"SELECT count(DISTINCT external_id) AS matched FROM field_values WHERE external_id IN (SELECT external_id FROM persons WHERE {IS_F})", "persons", "field_values")),
    "custom_field_examples": (lambda s, d: custom_fields.examples(frame(s, d, "field_values"), "f-enum", seed=1), None),
    "upload_validation": (upload_checks, sql("SELECT count(*) FILTER (WHERE try_cast(v AS date) IS NULL) AS bad_count, min(v) FILTER (WHERE try_cast(v AS date) IS NULL) AS example, count(DISTINCT v) AS distinct_count FROM (SELECT trim(date_of_birth) AS v FROM persons) WHERE v <> ''", "persons")),
    "canvass_latest": (lambda s, d: contacts.latest_results(events(s, d)).select("turf_id", "person_id", "sequence", "outcome"), sql("SELECT turf_id, person_id, sequence, payload->>'$.outcome' AS outcome FROM contacts WHERE kind = 'result' QUALIFY row_number() OVER (PARTITION BY turf_id, person_id ORDER BY sequence DESC) = 1", "contacts")),
    "canvass_outcome_filter": (lambda s, d: contact_filter(s, d, S("narrow", "canvass-outcome", outcomes=["canvassed", "moved"])), contacts_sql(f"SELECT {TOTALS} FROM persons WHERE external_id IN (SELECT person_id FROM latest WHERE outcome IN ('canvassed', 'moved'))", "persons")),
    "canvass_response_filter": (lambda s, d: contact_filter(s, d, S("narrow", "canvass-response", questionId="q1", optionIds=["o4", "o3"])), contacts_sql(f"SELECT {TOTALS} FROM persons WHERE external_id IN (SELECT person_id FROM latest WHERE list_has_any(CAST(payload->'$.responses.q1.optionIds' AS VARCHAR[]), ['o4', 'o3']))", "persons")),
    "turf_progress": (lambda s, d: contacts.turf_progress(events(s, d)), contacts_sql("SELECT turf_id, count(*) AS done FROM latest WHERE outcome IS NOT NULL GROUP BY 1")),
    "person_summaries": (lambda s, d: contacts.summaries(events(s, d)), contacts_sql("SELECT person_id, nullif(outcome, 'canvassed') AS outcome, coalesce(n, 0) AS n_notes FROM (SELECT person_id, payload->>'$.outcome' AS outcome FROM contacts WHERE kind = 'result' QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY created_at DESC) = 1) FULL JOIN (SELECT person_id, count(*) AS n FROM contacts WHERE kind = 'note' GROUP BY 1) USING (person_id)")),
    "response_tallies": (lambda s, d: contacts.tallies(contacts.latest_results(events(s, d)), "q1", ["o0", "o2", "o4", "o9"]), contacts_sql("SELECT o.option_id, count(DISTINCT person_id) AS persons, (SELECT count(DISTINCT person_id) FROM latest WHERE list_has_any(CAST(payload->'$.responses.q1.optionIds' AS VARCHAR[]), ['o0', 'o2', 'o4', 'o9'])) AS answerers FROM (VALUES ('o0'), ('o2'), ('o4'), ('o9')) o(option_id) LEFT JOIN latest ON list_contains(CAST(payload->'$.responses.q1.optionIds' AS VARCHAR[]), o.option_id) GROUP BY 1")),
    "zone_stats": (zone_tables, sql("SELECT zone_id, coalesce(drafts, 0) AS drafts, coalesce(published, 0) AS published, coalesce(active, 0) AS active FROM (SELECT zip5 AS zone_id, count(*) AS drafts FROM persons WHERE zip5 < '00020' GROUP BY 1) FULL JOIN (SELECT zip5 AS zone_id, count(*) AS published, count(*) FILTER (WHERE person_h % 2 = 0) AS active FROM persons WHERE zip5 > '00004' GROUP BY 1) USING (zone_id)", "persons")),
    "door_progress": (door_progress, contacts_sql("SELECT cast(sum(n) AS BIGINT) AS people, cast(sum(k) AS BIGINT) AS people_done, count(*) AS doors, count(*) FILTER (WHERE n = k) AS doors_done FROM (SELECT door_i, count(*) AS n, count(*) FILTER (WHERE external_id IN (SELECT person_id FROM latest WHERE outcome <> 'canvassed' OR len(coalesce(CAST(payload->'$.responses.q1.optionIds' AS VARCHAR[]), [])) > 0 OR trim(coalesce(payload->>'$.responses.q2.text', '')) <> '')) AS k FROM persons GROUP BY 1)", "persons")),
    "event_dedupe": (lambda s, d: contacts.deduplicated(events(s, d)).select("sequence", "turf_id"), sql("SELECT sequence, turf_id FROM contacts WHERE client_event_id IS NULL UNION ALL SELECT sequence, turf_id FROM (SELECT * FROM contacts WHERE client_event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_event_id ORDER BY sequence) = 1)", "contacts")),
    "event_pull_page": (lambda s, d: contacts.page(events(s, d), "t3", 500, 40).select("sequence", "person_id", "kind"), sql("SELECT sequence, person_id, kind FROM contacts WHERE turf_id = 't3' AND sequence > 500 ORDER BY sequence LIMIT 40", "contacts")),
    "walks_open_close": (walks, WALKS),
    "walk_order": (lambda s, d: contacts.walk_order(units(s, d)).withColumn("place", F.col("place").cast("bigint")), UNITS),
    "next_building": (lambda s, d: contacts.next_building(frame(s, d, "persons").select(F.col("zip5").alias("turf_id"), F.col("building_i").alias("building_id"), F.col("city").alias("street"), (F.col("person_h") % 500).alias("number")).distinct()), sql("SELECT turf_id, building_id, coalesce(lead(building_id) OVER (PARTITION BY turf_id ORDER BY street, number, building_id), first_value(building_id) OVER (PARTITION BY turf_id ORDER BY street, number, building_id)) AS next_id FROM (SELECT DISTINCT zip5 AS turf_id, building_i AS building_id, city AS street, person_h % 500 AS number FROM persons)", "persons")),
}
QUERIES |= {n: q for n, (q, _) in MORE.items()}
ORACLE |= {n: o for n, (_, o) in MORE.items() if o}
