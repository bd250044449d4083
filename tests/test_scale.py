"""What only shows on larger tables than the smallest, on small ones made like them."""

import time

import duckdb
from pyspark.sql import functions as F

from rosterflow.operators import geocode, matching
from rosterflow.operators.custom_fields import one_hash
from rosterflow.registry import geography
from rosterflow.sources.stored import stored
from tests.oracle import differences


def test_grid_of_many_rows_stays_on_the_map(spark, tmp_path):
    # rows of nodes that would lie beyond the pole, and over the border between two repeats
    spark.sql("SELECT 1200000 + id AS p_partkey FROM range(-110, 110)").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert differences(geography.grid_relations(spark, str(tmp_path)), db, geography.RELATIONS) is None


PEOPLE = "external_id string, house_number int, house_num_prefix string, half_code string, street_name_raw string, street_name_tokens array<string>, number_type string, zip5 string"
FACES = "blockface_id string, side string, from_house_num int, to_house_num int, house_num_prefix string, number_type string, zip_code string, tiger_line_id string, full_name string, street_tokens_match array<string>, street_tokens_lookup array<string>, from_node_id string, to_node_id string"


def streets(spark):
    words = [["ave", "brand", "1"], ["brand", "n", "st"], ["brand", "s", "st"], ["east", "st"], ["dr", "w"], [], ["1", "30", "ave", "brand"]]
    who = [(f"p{i % 70}" if i < 80 else f"p{i}", i % 13, ("", None, "7-")[i % 3], None, "x", sorted(words[i % 7]), "odd" if i % 13 % 2 else "even", f"z{i % 2}") for i in range(160)]
    who += [(None, 5, "", None, "x", ["ave", "brand"], "odd", "z0"), ("nowhere", 5, "", None, "x", ["ave", "brand"], "odd", None)]
    sides = [(f"{i % 30}:l", "left", i % 4, 12 - i % 5, ("", "7-", None)[i % 3 if i % 2 else 0], ("odd", "even", "mixed")[i % 3], f"z{i % 3 % 2}", f"{i % 30}", (None, "B St", "A Ave")[i % 3], sorted(words[i % 7] + ["st", "street"]), [], None, None) for i in range(120)]
    return spark.createDataFrame(who, PEOPLE), spark.createDataFrame(sides, FACES)


def test_pairs_out_of_lists_are_those_found_pair_by_pair(spark):
    who, sides = streets(spark)
    names = ["external_id", *sides.columns, "person_house_number", "token_overlap", "numeric_token_bonus", "match_score"]
    rows = lambda df: sorted(map(repr, df.select(names).collect()))
    want = rows(matching._pairwise(who, sides))
    assert len(want) > 500 and rows(matching.candidates(who, sides)) == want
    score = ["external_id", "match_score", "blockface_id", "full_name"]
    best = lambda df: sorted(map(repr, df.select(score).collect()))
    assert best(matching.best_matches(who, sides)) == best(matching.best_match(matching._pairwise(who, sides)))


def test_no_pair_is_shuffled(spark):
    who, sides = (df.localCheckpoint() for df in streets(spark))
    plan = matching.candidates(who, sides)._jdf.queryExecution().optimizedPlan().toString()
    # nothing but columns is above the place where lists become pairs, in the branch of persons with one address
    top = plan[: plan.index("Generate explode(faces")]
    assert "Join" not in top and "Aggregate" not in top and "Window" not in top and "Repartition" not in top


def test_segments_are_shuffled_once_to_be_listed(spark):
    sides = streets(spark)[1].localCheckpoint()
    plan = matching._listed(sides, ["blockface_id", "full_name"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_shuffle_files_go_once_a_table_is_stored(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before = shuffles()
    table = stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and len(table.collect()) == 7


def left_by(spark, work) -> set[str]:
    """Shuffle files that are still there 5 seconds after ``work``."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before, until = shuffles(), time.time() + 5
    work()
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    return shuffles() - before


def test_comparing_hashes_leaves_no_shuffle_files(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("external_id"), F.col("id").alias("person_h"))
    assert not left_by(spark, lambda: one_hash(rows))


def test_buildings_are_looked_up_once_for_complexes(spark):
    known = geocode.building_lookup(geography.addresses(spark, "/root/testdata/sf0.001"), geography.squares(spark))
    assert "Window" not in known._jdf.queryExecution().optimizedPlan().toString()
