"""The append-only log of contacts reduced to states, tallies and pages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAYLOAD = "outcome string, responses string, text string"
DEDUPE_WALK_HOURS = 5


def latest_results(events: DataFrame, order: str = "sequence") -> DataFrame:
    """turf_id, person_id, outcome, responses of each person's newest result in each turf.

    A result is a whole state, so a null outcome is one too. ``order`` is the
    server's sequence, or created_at for what a device shows.
    """
    outcome, responses = F.get_json_object("payload", "$.outcome"), F.get_json_object("payload", "$.responses")
    state = F.struct(F.col(order), outcome.alias("outcome"), responses.alias("responses"))
    newest = events.where(F.col("kind") == "result").groupBy("turf_id", "person_id").agg(F.max_by(state, order).alias("s"))
    return newest.select("turf_id", "person_id", F.col(f"s.{order}"), "s.outcome", "s.responses")


def turf_progress(events: DataFrame) -> DataFrame:
    """turf_id, done: persons whose newest result has an outcome."""
    return latest_results(events).where(F.col("outcome").isNotNull()).groupBy("turf_id").agg(F.count("*").alias("done"))


def deduplicated(events: DataFrame) -> DataFrame:
    """The first event of each client_event_id; events without one are all kept."""
    named = events.where(F.col("client_event_id").isNotNull())
    first = named.groupBy("client_event_id").agg(F.min("sequence").alias("sequence"))
    return named.join(first, ["client_event_id", "sequence"], "left_semi").unionByName(events.where(F.col("client_event_id").isNull()))


def page(events: DataFrame, turf_id: str, cursor: int, limit: int) -> DataFrame:
    """Events of a turf after ``cursor`` in their sequence."""
    return events.where((F.col("turf_id") == turf_id) & (F.col("sequence") > cursor)).orderBy("sequence").limit(limit)


def next_cursor(rows: DataFrame, cursor: int) -> int:
    return rows.agg(F.coalesce(F.max("sequence"), F.lit(cursor))).first()[0]


def summaries(events: DataFrame) -> DataFrame:
    """person_id, outcome (null for canvassed), n_notes: as the device shows them, newest by its own clock."""
    shown = latest_results(events, "created_at").groupBy("person_id").agg(F.max_by("outcome", "created_at").alias("outcome"))
    notes = events.where(F.col("kind") == "note").groupBy("person_id").agg(F.count("*").alias("n_notes"))
    both = shown.join(notes, "person_id", "full")
    return both.select("person_id", F.nullif("outcome", F.lit("canvassed")).alias("outcome"), F.coalesce("n_notes", F.lit(0)).alias("n_notes"))


def tallies(latest: DataFrame, question: str, options: list[str]) -> DataFrame:
    """option_id, persons, answerers: answers to a question in newest results; only options that still exist count."""
    given = F.from_json(F.get_json_object("responses", f"$['{question}'].optionIds"), "array<string>")
    valid = latest.select("person_id", F.array_intersect(given, F.lit(options)).alias("given")).where(F.size("given") > 0)
    answerers = valid.agg(F.countDistinct("person_id").alias("answerers"))
    each = valid.select("person_id", F.explode("given").alias("option_id")).groupBy("option_id").agg(F.countDistinct("person_id").alias("persons"))
    listed = latest.sparkSession.createDataFrame([(o,) for o in options], "option_id string")
    return listed.join(each, "option_id", "left").crossJoin(F.broadcast(answerers)).select("option_id", F.coalesce("persons", F.lit(0)).alias("persons"), "answerers")


def zone_stats(drafts: DataFrame, turfs: DataFrame) -> DataFrame:
    """zone_id, drafts, published, active: a zone needs only one of them."""
    planned = drafts.groupBy("zone_id").agg(F.count("*").alias("drafts"))
    out = turfs.groupBy("zone_id").agg(F.count("*").alias("published"), F.count_if(F.col("active")).alias("active"))
    return planned.join(out, "zone_id", "full").select("zone_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("drafts", "published", "active")])


def door_progress(residents: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: persons and doors, and how many are done; a door is done when all its residents are."""
    marked = residents.join(recorded.select("person_id", F.lit(True).alias("r")).distinct(), "person_id", "left").withColumn("r", F.coalesce("r", F.lit(False)))
    doors = marked.groupBy("door_id").agg(F.bool_and("r").alias("done"), F.count("*").alias("n"), F.count_if("r").alias("k"))
    return doors.agg(F.sum("n").alias("people"), F.sum("k").alias("people_done"), F.count("*").alias("doors"), F.count_if("done").alias("doors_done"))


def recorded(latest: DataFrame) -> DataFrame:
    """Rows of ``latest`` (outcome, responses) that say something: an outcome other than canvassed, or an answer with an option or a text."""
    given = F.from_json("responses", "map<string, struct<optionIds: array<string>, text: string>>")
    answered = F.exists(F.map_values(given), lambda r: (F.size(F.coalesce(r["optionIds"], F.array().cast("array<string>"))) > 0) | (F.trim(F.coalesce(r["text"], F.lit(""))) != ""))
    return latest.where(F.coalesce(F.col("outcome") != "canvassed", F.lit(False)) | F.coalesce(answered, F.lit(False)))


def opened_walks(opens: DataFrame, closes: DataFrame | None = None, hours: int = DEDUPE_WALK_HOURS) -> DataFrame:
    """organization_id, turf_id, phone, opened_at, closed_at of walks, from ``opens`` (the first four columns).

    A phone has one open walk in an organisation. Opening its turf again up to
    ``hours`` after the walk was opened goes on with it; any other opening
    closes it and opens the next, and so does a row of ``closes``
    (organization_id, turf_id, phone, closed_at) without a next. An opening
    without a phone is a walk of its own that nothing closes.
    """
    who = ["organization_id", "phone"]
    events = opens.where("phone is not null").select(*who, "turf_id", F.col("opened_at").alias("at"), F.lit(1).alias("opens"))
    if closes is not None:
        events = events.unionByName(closes.select(*who, "turf_id", F.col("closed_at").alias("at"), F.lit(0).alias("opens")))
    order = Window.partitionBy(*who).orderBy("at", "turf_id", "opens")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    # a close counts where the turf is that of the opening before it
    last = F.last(F.when(F.col("opens") == 1, F.col("turf_id")), ignorenulls=True).over(ahead)
    events = events.withColumn("own", last.eqNullSafe(F.col("turf_id"))).where("opens = 1 or own")
    closed = F.coalesce(F.lag("opens").over(order) == 0, F.lit(False))
    run = F.sum((~F.col("own") | closed | (F.col("opens") == 0)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # openings of one turf in a row: some of them go on with the walk before
    runs = events.withColumn("run", run).groupBy(*who, "run", "turf_id", "opens").agg(F.sort_array(F.collect_list(F.col("at").cast("timestamp"))).alias("times"))
    reach = F.expr(f"INTERVAL {hours} HOURS")

    def started(times: Column) -> Column:
        none = F.array().cast("array<timestamp>")
        return F.aggregate(times, none, lambda found, t: F.when((F.size(found) == 0) | (t > F.element_at(F.concat(found, F.array(t)), F.greatest(F.size(found), F.lit(1))) + reach), F.array_append(found, t)).otherwise(found))

    begun = runs.select(*who, "turf_id", "opens", F.explode(F.when(F.col("opens") == 1, started(F.col("times"))).otherwise(F.col("times"))).alias("at"))
    begun = begun.withColumn("closed_at", F.lead("at").over(order)).where("opens = 1")
    kind = opens.schema["opened_at"].dataType
    named = begun.select("organization_id", "turf_id", "phone", F.col("at").cast(kind).alias("opened_at"), F.col("closed_at").cast(kind).alias("closed_at"))
    alone = opens.where("phone is null").select("organization_id", "turf_id", "phone", "opened_at", F.lit(None).cast(kind).alias("closed_at"))
    return named.unionByName(alone)


#: Words before a unit that do not count in its order.
UNIT_WORDS = ["APARTMENT", "APT", "UNIT", "SUITE", "STE", "FLOOR", "FL", "BUILDING", "BLDG", "#"]


def natural(text: Column) -> Column:
    """A key that orders text with numbers in it by the numbers."""
    parts = F.regexp_extract_all(F.upper(text), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def walk_order(doors: DataFrame) -> DataFrame:
    """building_id, door_id, place: penthouses, then floors from the top, then units without one; letters and numbers in order; doors without a unit last.

    A unit's floor is the number that it begins with, once a word such as APT is off.
    """
    unit = F.trim(F.regexp_replace(F.trim(F.coalesce("unit", F.lit(""))), "(?i)^(" + "|".join(UNIT_WORDS) + r")\s*", ""))
    number = F.regexp_extract(unit, "^([0-9]+)", 1)
    floor = F.when(unit.rlike("(?i)^PH"), F.lit(float("inf"))).otherwise(F.coalesce(number.try_cast("double"), F.lit(-1.0)))
    rest = F.regexp_extract(unit, r"^[0-9]*\s*(.*)$", 1)
    order = Window.partitionBy("building_id").orderBy((unit == "").cast("int"), floor.desc(), natural(rest), "door_id")
    return doors.select("building_id", "door_id", F.row_number().over(order).alias("place"))


def next_building(buildings: DataFrame) -> DataFrame:
    """turf_id, building_id, next_id in walking order (numbers in streets and house numbers by their size); after the last comes the first."""
    ring = Window.partitionBy("turf_id").orderBy(natural(F.col("street")), natural(F.col("number").cast("string")), "building_id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return buildings.select("turf_id", "building_id", F.coalesce(F.lead("building_id").over(ring), F.first("building_id").over(whole)).alias("next_id"))


def rounded_share(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 0)
