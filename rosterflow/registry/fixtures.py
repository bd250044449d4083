"""Domain tables derived from the generic test tables, in SQL that Spark and DuckDB both take."""

from pyspark.sql import DataFrame, SparkSession

TODAY = "2026-01-15"
#: At the smallest scale few persons share an election.
FLOOR = 5

TABLES = {
    "persons": """
        SELECT cast(c_custkey AS string) AS external_id, 'synthetic' AS external_id_type,
               CASE c_custkey % 5 WHEN 0 THEN 'ANA' WHEN 1 THEN 'José' WHEN 2 THEN 'CARA' WHEN 3 THEN 'Šťastný' ELSE 'ÉLI' END AS first_name,
               nullif(CASE c_custkey % 3 WHEN 0 THEN 'M' ELSE '' END, '') AS middle_name, upper(c_name) AS last_name,
               cast(c_custkey % 500 AS string) || ' ' || upper(n_name) || ' ST' AS address_line_1,
               nullif(cast(c_custkey % 7 AS string), '0') AS address_line_2, n_name AS city, upper(substring(r_name, 1, 2)) AS state,
               lpad(cast(c_nationkey AS string), 5, '0') AS zip5, lower(c_mktsegment) AS enrollment,
               nullif(CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'X' ELSE '' END, '') AS gender,
               CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'unknown'
                    ELSE cast(DATE '1930-01-01' + cast((c_custkey * 7919) % 28000 AS int) AS string) END AS date_of_birth,
               cast(DATE '2000-01-01' + cast((c_custkey * 31) % 8000 AS int) AS string) AS registration_date,
               nullif(r_name, 'ASIA') AS precinct, cast(n_regionkey AS string) AS county_code, c_custkey AS person_h,
               cast(c_custkey % 500 AS string) || ' ' || upper(n_name) || ' ST|' || lpad(cast(c_nationkey AS string), 5, '0') AS building_id,
               c_nationkey * 500 + c_custkey % 500 AS building_i, (c_nationkey * 500 + c_custkey % 500) * 7 + c_custkey % 7 AS door_i,
               40 + c_nationkey * 0.01e0 + (c_custkey % 500) * 0.00001e0 AS latitude,
               -74 + c_nationkey * 0.01e0 + (c_custkey % 500) * 0.00002e0 AS longitude
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "history": """
        SELECT DISTINCT cast(o_custkey AS string) AS external_id, cast(extract(year FROM o_orderdate) AS int) AS year,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'general' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'presidential_primary'
                    WHEN '4-NOT SPECIFIED' THEN 'special' ELSE 'runoff' END
               || CASE o_orderstatus WHEN 'F' THEN '' ELSE '_' || lower(o_orderstatus) END AS type
        FROM {orders}""",
    "field_values": """
        SELECT cast(c_custkey AS string) AS external_id, c_custkey AS person_h, 'f-num' AS field_id, cast(cast(floor(c_acctbal) AS int) AS string) AS value, 'u1' AS upload_id
        FROM {customer} WHERE c_custkey % 2 = 0
        UNION ALL SELECT cast(c_custkey AS string), c_custkey, 'f-enum', lower(c_mktsegment), 'u1' FROM {customer} WHERE c_custkey % 3 = 0
        UNION ALL SELECT cast(c_custkey AS string), c_custkey, 'f-date', cast(DATE '2010-01-01' + cast(c_custkey % 3000 AS int) AS string), 'u1' FROM {customer} WHERE c_custkey % 5 = 0
        UNION ALL SELECT cast(c_custkey AS string), c_custkey, 'f-code', cast(c_custkey % 40 AS string), 'u1' FROM {customer} WHERE c_custkey % 7 < 3""",
    "new_values": """
        SELECT cast(c_custkey AS string) AS external_id, c_custkey AS person_h, 'f-num' AS field_id, '7' AS value, 'u2' AS upload_id
        FROM {customer} WHERE c_custkey % 4 = 0
        UNION ALL SELECT cast(c_custkey AS string), c_custkey, 'f-enum', 'fresh', 'u2' FROM {customer} WHERE c_custkey % 9 = 1""",
    "contacts": """
        SELECT event_id AS sequence, nullif('c' || cast(event_id % 4000 AS string), 'c7') AS client_event_id, 't' || cast(user_id % 7 AS string) AS turf_id,
               cast(user_id AS string) AS person_id, CASE WHEN event_type = 'click' THEN 'note' ELSE 'result' END AS kind,
               CASE WHEN event_type = 'click' THEN '{{"text":"hello"}}'
                    ELSE '{{"outcome":' || CASE event_type WHEN 'error' THEN 'null' WHEN 'purchase' THEN '"canvassed"' WHEN 'signup' THEN '"not_home"' ELSE '"moved"' END
                         || ',"responses":' || CASE event_id % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"q1":{{"optionIds":[]}},"q2":{{"text":" "}}}}'
                              ELSE '{{"q1":{{"optionIds":["o' || cast(event_id % 3 AS string) || '","o' || cast(event_id % 5 AS string) || '"]}}}}' END || '}}' END AS payload,
               ts AS created_at
        FROM {events}""",
    "lines": """
        SELECT cast(p_partkey AS string) AS external_id,
               CASE p_partkey % 6 WHEN 0 THEN cast(p_partkey % 300 AS string) WHEN 1 THEN '0' || cast(p_partkey % 90 AS string)
                    WHEN 2 THEN cast(p_partkey % 60 AS string) || '-' || lpad(cast(p_partkey % 40 AS string), 2, '0')
                    WHEN 3 THEN cast(p_partkey % 250 AS string) || 'A' ELSE cast(p_partkey % 200 AS string) END || ' '
               || CASE p_partkey % 5 WHEN 0 THEN 'N ' WHEN 1 THEN 'East ' ELSE '' END
               || CASE p_partkey % 9 WHEN 0 THEN 'FDR Drive' WHEN 1 THEN 'Franklin  Delano Roosevelt Dr' WHEN 2 THEN cast(p_partkey % 30 AS string) || ' Street'
                       WHEN 3 THEN 'St. Mark''s Pl' WHEN 4 THEN 'West Drive' ELSE p_brand || ' Ave' END AS address_line_1,
               nullif(CASE p_partkey % 10 WHEN 0 THEN '1/2' ELSE '' END, '') AS half_code, lpad(cast(p_size AS string), 5, '0') AS zip5
        FROM {part}""",
    "unpivoted": """
        SELECT cast(p_partkey AS string) || ':' || CASE p_partkey % 2 WHEN 0 THEN 'left' ELSE 'right' END AS blockface_id,
               CASE p_partkey % 2 WHEN 0 THEN 'left' ELSE 'right' END AS side,
               CASE WHEN p_partkey % 6 = 2 THEN cast(p_partkey % 60 AS string) || '-' || '1' ELSE cast(p_partkey % 2 AS string) END AS raw_from,
               CASE WHEN p_partkey % 6 = 2 THEN cast(p_partkey % 60 AS string) || '-' || '39' ELSE cast(200 + p_partkey % 3 AS string) END AS raw_to,
               lpad(cast(p_size AS string), 5, '0') AS zip_code,
               CASE p_partkey % 9 WHEN 0 THEN 'F D R Dr' WHEN 2 THEN cast(p_partkey % 30 AS string) || ' St' WHEN 3 THEN 'Saint Marks Place' WHEN 4 THEN 'W Drive' ELSE p_brand || ' Avenue' END AS full_name,
               cast(p_partkey - p_partkey % 4 AS string) AS tiger_line_id, 'n' || cast(p_partkey % 50 AS string) AS from_node_id, 'n' || cast(p_partkey % 51 AS string) AS to_node_id
        FROM {part}""",
}

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    text = TABLES[name]
    used = [t for t in SOURCES if "{" + t + "}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def sql(query: str, *names: str) -> str:
    """``query`` for DuckDB over the derived tables ``names``."""
    plain = {t: t for t in SOURCES}
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].format(**plain)})" for n in names) + "\n" + query


def persons_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    history = frame(spark, sf_dir, "history").groupBy("external_id").agg(F.collect_list(F.struct("year", "type")).alias("voting_history"))
    return frame(spark, sf_dir, "persons").join(history, "external_id", "left")
