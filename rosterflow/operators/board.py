"""Lists and counts around campaigns: boards, scripts, versions, uploads, references."""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each ``key``, such as the last upload of a field."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def used_counts(items: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """``key``, used: how often each item is used, 0 if never."""
    counted = uses.groupBy(key).agg(F.count("*").alias("used"))
    return items.select(key).join(counted, key, "left").select(key, F.coalesce("used", F.lit(0)).alias("used"))


def next_order(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``group``, next: the order that a new row of each group gets."""
    return rows.groupBy(group).agg((F.max(order) + 1).alias("next"))


def reordered(spark, ids: list[str]) -> DataFrame:
    """id, order: the order of ``ids`` as they are listed."""
    return spark.createDataFrame([(ids,)], "ids array<string>").select(F.posexplode("ids").alias("order", "id"))


def slug(name: Column) -> Column:
    """Lower-case words with hyphens between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def versions(rows: DataFrame, active: DataFrame) -> DataFrame:
    """``rows`` (dataset, number, ...) newest first, with is_active by ``active`` (dataset, number)."""
    marked = rows.join(active.select("dataset", "number", F.lit(True).alias("is_active")), ["dataset", "number"], "left")
    return marked.withColumn("is_active", F.coalesce("is_active", F.lit(False))).orderBy("dataset", F.desc("number"))


def scripts(steps: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """script_id, steps: each script's steps in order, with their question and its active options in order."""
    offered = options.where("active").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", "option_id", "label"))).alias("o"))
    asked = questions.join(offered, "question_id", "left")
    asked = asked.select("question_id", "prompt", F.transform(F.coalesce("o", F.array().cast(offered.schema["o"].dataType)), lambda x: x["option_id"]).alias("options"))
    full = steps.join(asked, "question_id", "left")
    listed = full.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("position", "step_id", "prompt", "options"))).alias("steps"))
    return listed


def natural(name: Column) -> list[Column]:
    """Sort keys of names with numbers: the words before, then the number as such."""
    return [F.lower(F.regexp_replace(name, "[0-9].*$", "")), F.coalesce(F.regexp_extract(name, "([0-9]+)", 1).try_cast("bigint"), F.lit(-1)), F.lower(name)]


def board(turfs: DataFrame) -> DataFrame:
    """turf_id, place on the board: campaigns by their first turf, zones by order with those without one last, names naturally."""
    began = Window.partitionBy("campaign_id")
    rows = turfs.withColumn("began", F.min("created_at").over(began))
    order = Window.partitionBy("organization_id").orderBy("began", "campaign_id", F.col("zone_order").asc_nulls_last(), *natural(F.col("name")), "turf_id")
    return rows.select("turf_id", F.row_number().over(order).alias("place"))


def blockers(segment: str, trees: dict[str, str], drafts: DataFrame, campaigns: DataFrame) -> dict[str, int]:
    """What keeps a segment from removal: segments (by their criteria JSON), drafts and campaigns that refer to it."""

    def refers(node) -> bool:
        if isinstance(node, dict):
            return (node.get("kind") == "segment" and node.get("segmentId") == segment) or any(map(refers, node.values()))
        return isinstance(node, list) and any(map(refers, node))

    return {
        "segments": sum(refers(json.loads(t)) for k, t in trees.items() if k != segment),
        "drafts": drafts.where(F.col("segment_id") == segment).count(),
        "campaigns": campaigns.where(F.col("segment_id") == segment).count(),
    }


def cut_counts(found: DataFrame, buildings: DataFrame) -> DataFrame:
    """turf_draft_id, doors, people of the buildings that each drawn polygon holds."""
    return found.select("turf_draft_id", "building_id").join(buildings, "building_id").groupBy("turf_draft_id").agg(F.sum("door_count").alias("doors"), F.sum("person_count").alias("people"))
