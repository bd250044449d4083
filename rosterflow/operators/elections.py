"""Elections as bits: a registry of elections and a mask of those that a person voted in."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elections that fewer persons voted in get no bit.
FLOOR = 100
WORD = 64


def registry(persons: DataFrame, floor: int = FLOOR) -> DataFrame:
    """year, type, voters, bit: newest first, then by type."""
    voted = persons.select("external_id", F.explode("voting_history").alias("v")).select("external_id", "v.year", "v.type")
    kept = voted.groupBy("year", "type").agg(F.countDistinct("external_id").alias("voters")).where(F.col("voters") >= floor)
    # as many rows as there are elections, so one ordered window is no burden
    return kept.withColumn("bit", F.row_number().over(Window.orderBy(F.desc("year"), "type")) - 1)


def bits(registered: DataFrame) -> dict[str, int]:
    return {f"{r['year']}-{r['type']}": r["bit"] for r in registered.collect()}


def label(year: Column, type_: Column) -> Column:
    return F.concat_ws(" ", year.cast("string"), F.initcap(F.translate(type_, "_", " ")))


def with_masks(persons: DataFrame, elections: dict[str, int]) -> DataFrame:
    """``persons`` with election_mask_0, _1, ...: bigints with the bits of the elections in voting_history; 0 without any."""
    out = persons
    for word in range(max(elections.values(), default=0) // WORD + 1):
        own = {k: b % WORD for k, b in elections.items() if b // WORD == word}
        pairs = [x for k, b in sorted(own.items()) for x in (F.lit(k), F.lit((1 << b) - (1 << 64 if b == 63 else 0)))]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>")

        key = lambda v: F.concat_ws("-", v["year"].cast("string"), v["type"])
        values = F.transform("voting_history", lambda v: F.coalesce(F.try_element_at(table, key(v)), F.lit(0).cast("bigint")))  # noqa: B023
        mask = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
        out = out.withColumn(f"election_mask_{word}", F.coalesce(mask, F.lit(0).cast("bigint")))
    return out


def derived(persons: DataFrame, floor: int = FLOOR) -> dict:
    """A version's facts: how many rows, and its elections with their labels."""
    rows = registry(persons, floor).withColumn("label", label(F.col("year"), F.col("type"))).orderBy("bit").collect()
    return {"rowCount": persons.count(), "elections": [r.asDict() for r in rows]}
