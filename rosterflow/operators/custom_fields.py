"""Typed columns that users append to persons: uploads, the long table of values, and its wide companion."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

TYPES = {"number": "double", "date": "date", "text": "string", "text-multi": "string", "enum": "string"}
MOST_OPTIONS = 100
KIND_OF_TYPE = {"number": "number-range", "date": "date-range", "text": "text", "text-multi": "text-multi", "enum": "enum"}


class UploadError(ValueError):
    """An upload that cannot be taken."""


@dataclass(frozen=True)
class Upload:
    label: str
    values: DataFrame  # external_id, value
    skipped: int


def column_of(field_id: str) -> str:
    return "f_" + field_id.replace("-", "")


def parse_upload(raw: DataFrame, label: str | None = None, constant: str | None = None) -> Upload:
    """One or two columns of strings: ids and values, or ids that all get ``constant``.

    Blank ids and values are skipped and counted; of repeated ids the greatest value stays.
    """
    names = raw.columns
    if len(names) not in (1, 2):
        raise UploadError(f"an upload has one or two columns, not {len(names)}")
    if len(names) == 1 and not (label or "").strip() or len(names) == 1 and not (constant or "").strip():
        raise UploadError("a list of ids needs a label and a value")
    value = F.trim(F.col(names[1]).cast("string")) if len(names) == 2 else F.lit(constant.strip())
    rows = raw.select(F.trim(F.col(names[0]).cast("string")).alias("external_id"), value.alias("value"))
    filled = (F.col("external_id") != "") & (F.col("value") != "")
    skipped, kept = rows.agg(F.count_if(~F.coalesce(filled, F.lit(False))), F.count_if(filled)).first()
    if not kept:
        raise UploadError("the upload has no values")
    values = rows.where(filled).groupBy("external_id").agg(F.max("value").alias("value"))
    return Upload((names[1] if len(names) == 2 else label).strip(), values, skipped)


def problems(values: DataFrame, type_: str) -> DataFrame:
    """One row: bad_count and example of values that are not of ``type_``, and how many distinct values there are."""
    cast = F.col("value").try_cast(TYPES[type_])
    bad = cast.isNull() & F.col("value").isNotNull()
    return values.agg(F.count_if(bad).alias("bad_count"), F.min(F.when(bad, F.col("value"))).alias("example"), F.countDistinct("value").alias("distinct_count"))


def validate(values: DataFrame, type_: str) -> None:
    found = problems(values, type_).first()
    if found["bad_count"]:
        raise UploadError(f"{found['bad_count']} values are no {type_}, such as {found['example']!r}")
    if type_ == "enum" and found["distinct_count"] > MOST_OPTIONS:
        raise UploadError(f"{found['distinct_count']} different options; at most {MOST_OPTIONS} are allowed")


def append(values: DataFrame, new: DataFrame) -> DataFrame:
    """The long table (external_id, field_id, value, upload_id) after ``new`` rows: the latest value wins."""
    keys = new.select("external_id", "field_id")
    return values.join(keys, ["external_id", "field_id"], "left_anti").unionByName(new)


def clear(values: DataFrame, field_id: str) -> DataFrame:
    return values.where(F.col("field_id") != field_id)


def wide(values: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row a person: person_h and a typed column for each field (id -> type).

    Raises if two ids have the same hash.
    """
    from ..functions.hashing import person_hash

    if "person_h" not in values.columns:
        values = values.withColumn("person_h", person_hash(F.col("external_id")))
    one_hash(values)
    columns = [F.max(F.when(F.col("field_id") == f, F.col("value"))).try_cast(TYPES[t]).alias(column_of(f)) for f, t in fields.items()]
    return values.groupBy("person_h").agg(*columns)


def one_hash(rows: DataFrame) -> None:
    # one after the other, each in tables of one row: both at once would double the rows that are shuffled
    ids, hashes = (stored(rows.agg(F.countDistinct(c).alias("n"))).first().n for c in ("external_id", "person_h"))
    if ids != hashes:
        raise ValueError(f"{ids} ids share {hashes} hashes")


def coverage(values: DataFrame) -> DataFrame:
    """field_id, coverage, options (sorted distinct values)."""
    return values.groupBy("field_id").agg(F.countDistinct("external_id").alias("coverage"), F.array_sort(F.collect_set("value")).alias("options"))


def cleared_coverage(before: DataFrame, field_id: str) -> DataFrame:
    """``before`` (coverage()) once a field's values are gone: its row stays with nobody covered, and its options as they were."""
    return before.withColumn("coverage", F.when(F.col("field_id") == field_id, F.lit(0).cast("bigint")).otherwise(F.col("coverage")))


def merged_coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """The coverage rows of ``after``, with the options of ``before`` too: options only ever grow, and no field goes."""
    old = before.select("field_id", F.col("options").alias("old"))
    none = F.array().cast("array<string>")
    both = after.join(old, "field_id", "full")
    return both.select("field_id", F.coalesce("coverage", F.lit(0)).alias("coverage"), F.array_sort(F.array_union(F.coalesce("options", none), F.coalesce("old", none))).alias("options"))


def upsert(known: DataFrame, asked: DataFrame) -> DataFrame:
    """The registry (field_id, label, type, archived) with ``asked`` (same columns): new labels come in, archived ones revive; a type may not change."""
    clash = known.join(asked.select("label", F.col("type").alias("new_type")), "label").where("type <> new_type").limit(1).collect()
    if clash:
        raise UploadError(f"{clash[0]['label']!r} is of type {clash[0]['type']}")
    revived = known.join(asked.select("label", F.lit(True).alias("__again")), "label", "left")
    revived = revived.withColumn("archived", F.col("archived") & F.col("__again").isNull()).select(known.columns)
    return revived.unionByName(asked.join(known, "label", "left_anti").select(known.columns))


def examples(values: DataFrame, field_id: str, k: int = 10, seed: int | None = None) -> DataFrame:
    """``k`` random distinct values."""
    return values.where(F.col("field_id") == field_id).select("value").distinct().orderBy(F.rand(seed)).limit(k)


def matched(values: DataFrame, persons: DataFrame) -> DataFrame:
    """How many ids of the uploads are in ``persons``."""
    return values.join(persons.select("external_id"), "external_id", "left_semi").agg(F.countDistinct("external_id").alias("matched"))
