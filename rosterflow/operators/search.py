"""Person search by prefixes of words."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import name_key, packed
from .counts import Page

DOCUMENT = ("external_id", "external_id_type", "first_name", "last_name", "address_line_1", "address_line_2", "city", "state", "zip5", "zip4")
PREFIXED = {"first_name": "first_name", "last_name": "last_name", "address": "address_line_1", "city": "city"}


def words(column: Column) -> Column:
    return F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+")


def predicate(**terms: str) -> Column | None:
    """All given terms: prefixes of words of names and addresses, whole zips and ids; None if all are blank."""
    out = None
    for name, value in terms.items():
        value = (value or "").strip()
        if not value:
            continue
        if name in PREFIXED:
            found = words(F.col(PREFIXED[name]))
            for token in value.lower().split():
                part = _some_starts(found, token)
                out = part if out is None else out & part
        else:
            part = F.col(name) == value
            out = part if out is None else out & part
    return out


def _some_starts(found: Column, token: str) -> Column:
    return F.exists(found, lambda w: w.startswith(token))


def search(persons: DataFrame, limit: int = 20, offset: int = 0, **terms: str) -> Page:
    """A page of matches by name, and how many there are."""
    met = predicate(**terms)
    if met is None:
        return Page(persons.limit(0), 0)
    found = persons.where(met)
    order = [name_key(F.col("last_name"), F.col("first_name")), F.col("external_id")]
    return Page(found.orderBy(*order).offset(max(0, offset)).limit(max(1, min(100, limit))), found.count())


def documents(persons: DataFrame) -> DataFrame:
    """external_id, line: the JSON document of each person with two sort keys."""
    missing = [c for c in DOCUMENT if c not in persons.columns]
    if missing:
        raise ValueError(f"columns are missing for the index: {missing}")
    key = name_key(F.col("last_name"), F.col("first_name"))
    body = F.struct(*DOCUMENT, packed(key, 1).alias("sort_key_hi"), packed(key, 9).alias("sort_key_lo"))
    return persons.select("external_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))


def write_ndjson(persons: DataFrame, path: str, lines_a_file: int = 100_000) -> None:
    """The documents as text files of at most ``lines_a_file`` lines, by external_id within and across files."""
    ordered = documents(persons).repartitionByRange("external_id").sortWithinPartitions("external_id")
    ordered.select("line").write.mode("overwrite").option("maxRecordsPerFile", lines_a_file).text(path)
