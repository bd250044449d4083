"""Addresses of persons against street segments: decompose, propose, score, pick."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addressing import distinctive, expand_tokens, has_any, split_number, street_rewrite, tokenize_street
from ..sources.stored import stored

#: Stands for the words of a street whose name is all generic words.
ALL_GENERIC = "__all_generic__"


def parity(number: Column) -> Column:
    return F.when(number % 2 == 1, "odd").otherwise("even")


def decomposed(persons: DataFrame) -> DataFrame:
    """House number, its prefix and the street's words of each person whose address starts with a number."""
    prefix, number, street = split_number(F.col("address_line_1"))
    rows = persons.select("external_id", "zip5", "half_code", prefix.alias("house_num_prefix"), number.alias("house_number"), street.alias("street_name_raw"))
    rows = rows.where(F.col("house_number").isNotNull())
    return rows.select("external_id", "house_number", "house_num_prefix", "half_code", "street_name_raw", tokenize_street(street_rewrite(F.col("street_name_raw"))).alias("street_name_tokens"), parity(F.col("house_number")).alias("number_type"), "zip5")


def unpivoted(features: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each addressed side of each line, with the nodes at its ends."""
    shared = ["tiger_line_id", "full_name", "street_name_tokens"]
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_from_house_num").alias("raw_from"), F.col(f"{s}_to_house_num").alias("raw_to"), F.col(f"{s}_zip_code").alias("zip_code")) for s in ("left", "right")])
    rows = features.select(*shared, F.inline(sides)).where(F.coalesce("raw_from", F.lit("")) != "")
    nodes = edges.select("tiger_line_id", "from_node_id", "to_node_id").dropDuplicates(["tiger_line_id"])
    return rows.join(nodes, "tiger_line_id", "left").withColumn("blockface_id", F.concat_ws(":", "tiger_line_id", "side"))


def normalized(rows: DataFrame) -> DataFrame:
    """Integer ranges: plain numbers, or numbers after a prefix that both ends share. Raises on any others."""
    prefix_from, prefix_to = (F.regexp_replace(c, "[0-9]+$", "") for c in ("raw_from", "raw_to"))
    low, high = (F.regexp_extract(c, "([0-9]+)$", 1).try_cast("int") for c in ("raw_from", "raw_to"))
    direct = F.col("raw_from").try_cast("int").isNotNull() & F.col("raw_to").try_cast("int").isNotNull()
    number = lambda c, other: F.when(direct, F.col(c).try_cast("int")).otherwise(F.when(prefix_from == prefix_to, other))
    out = rows.withColumns({"from_house_num": number("raw_from", low), "to_house_num": number("raw_to", high), "house_num_prefix": F.when(direct, "").otherwise(prefix_from)})
    bad = out.where(F.col("from_house_num").isNull() | F.col("to_house_num").isNull()).select("raw_from", "raw_to", "full_name").limit(10).collect()
    if bad:
        raise ValueError("house numbers that are neither plain nor share a prefix: " + "; ".join(f"{r[0]!r} to {r[1]!r} on {r[2]}" for r in bad))
    kind = F.when(F.col("from_house_num") % 2 == F.col("to_house_num") % 2, parity(F.col("from_house_num"))).otherwise("mixed")
    return out.withColumn("number_type", kind).drop("raw_from", "raw_to")


def final(rows: DataFrame) -> DataFrame:
    """One row for each range of a side: aliases of a street merge under the name that is most frequent."""
    names = rows.where(F.col("full_name").isNotNull()).groupBy("full_name").agg(F.count("*").alias("freq"))
    ranked = rows.join(names, "full_name", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    group = ["blockface_id", "side", "from_house_num", "to_house_num", "house_num_prefix", "number_type", "zip_code", "tiger_line_id"]
    # the best alias: most frequent, then first by name, null names last
    best = F.struct((-F.col("freq")).alias("f"), F.col("full_name").isNull().alias("n"), F.col("full_name").alias("name"))
    merged = ranked.groupBy(*group).agg(
        F.min_by("full_name", best).alias("full_name"), F.flatten(F.collect_list("street_name_tokens")).alias("merged"), F.min_by("street_name_tokens", best).alias("own"),
        F.min("from_node_id").alias("from_node_id"), F.min("to_node_id").alias("to_node_id"),
    )
    return merged.select(*group, "full_name", expand_tokens(F.col("merged")).alias("street_tokens_match"), expand_tokens(F.col("own")).alias("street_tokens_lookup"), "from_node_id", "to_node_id")


def _in_range() -> Column:
    number = F.col("house_number")
    return number.between(F.col("from_house_num"), F.col("to_house_num")) | number.between(F.col("to_house_num"), F.col("from_house_num"))


def _pairwise(people: DataFrame, faces: DataFrame) -> DataFrame:
    """The rows of candidates(), pair by pair."""
    words = distinctive(F.col("street_name_tokens"))
    probe = people.select("external_id", "zip5", "house_number", "number_type", F.coalesce("house_num_prefix", F.lit("")).alias("prefix"), F.explode(F.when(F.size(words) == 0, F.lit([ALL_GENERIC])).otherwise(words)).alias("word"))
    listed = faces.select("blockface_id", F.col("zip_code").alias("zip5"), F.col("number_type").alias("face_type"), "from_house_num", "to_house_num", F.coalesce("house_num_prefix", F.lit("")).alias("prefix"), F.explode(F.array_append(distinctive(F.col("street_tokens_match")), F.lit(ALL_GENERIC))).alias("word"))
    same_type = F.col("face_type").isin("mixed") | (F.col("face_type") == F.col("number_type"))
    pairs = probe.join(listed, ["zip5", "prefix", "word"]).where(same_type & _in_range()).select("external_id", "blockface_id").distinct()
    tokens, other = F.col("street_name_tokens"), F.col("street_tokens_match")
    overlap = F.size(F.array_intersect(tokens, other))
    against = [has_any(tokens, a, b) & F.array_contains(other, c) for a, b, c in (("n", "north", "s"), ("s", "south", "n"), ("e", "east", "w"), ("w", "west", "e"))]
    opposed = against[0] | against[1] | against[2] | against[3]
    who = people.select("external_id", "house_number", F.coalesce("house_num_prefix", F.lit("")).alias("own_prefix"), "street_name_tokens")
    full = pairs.join(who, "external_id").join(faces, "blockface_id")
    full = full.where((overlap >= 2) & ~opposed & (F.coalesce("house_num_prefix", F.lit("")) == F.col("own_prefix")) & _in_range())
    numeric = F.exists(tokens, lambda t: t.rlike("^[0-9]+$")).cast("int")
    return full.select("external_id", *[c for c in faces.columns], F.col("house_number").alias("person_house_number"), overlap.alias("token_overlap"), numeric.alias("numeric_token_bonus"), (overlap + numeric).alias("match_score"))


def _split(people: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(persons with one address, those with several, if any): all addresses of a person count once one has found a segment."""
    known = people.where("external_id is not null")
    several = stored(known.groupBy("external_id").agg(F.count("*").alias("rows")).where("rows > 1").select("external_id"))
    if several.isEmpty():
        return known, None
    return known.join(several, "external_id", "left_anti"), people.join(several, "external_id", "left_semi")


#: What a person's address has in common with those of other houses, and a segment with those of other streets.
STREET, RANGE = ["zip", "prefix", "tokens"], ["type", "low", "high", "least", "most"]


def _living(people: DataFrame) -> DataFrame:
    return people.select("external_id", F.col("zip5").alias("zip"), F.coalesce("house_num_prefix", F.lit("")).alias("prefix"), F.col("street_name_tokens").alias("tokens"), "house_number", F.col("number_type").alias("own_type"))


def _listed(faces: DataFrame, columns: list[str]) -> DataFrame:
    """Each segment's row by the zip, words and range that find it: listed, RANGE, match, earlier and ``columns`` as face.

    A row that is found makes all rows of its segment count. earlier: what else
    finds the segment in the zip, and comes before; a pair counts under the first.
    """
    low, high = F.least("from_house_num", "to_house_num"), F.greatest("from_house_num", "to_house_num")
    known = faces.where("blockface_id is not null and from_house_num is not null and to_house_num is not null")
    row = F.struct(F.col("zip_code").alias("zip"), F.col("number_type").alias("type"), low.alias("low"), high.alias("high"), F.col("street_tokens_match").alias("match"), F.struct(*columns).alias("face"))
    # the one shuffle of all segments, without what the rows tell anew
    whole = known.select("blockface_id", F.coalesce("house_num_prefix", F.lit("")).alias("prefix"), row.alias("row")).groupBy("blockface_id", "prefix").agg(F.collect_list("row").alias("rows"))

    def way(r: Column) -> Column:
        words = F.array_sort(F.array_append(distinctive(r["match"]), F.lit(ALL_GENERIC)))
        return F.struct(r["zip"].alias("zip"), words.alias("listed"), r["type"].alias("type"), r["low"].alias("low"), r["high"].alias("high"))

    ways = whole.withColumn("ways", F.array_distinct(F.transform("rows", way))).select("prefix", "rows", "ways", F.explode("ways").alias("way"))
    same = F.filter("ways", lambda w: (w["zip"] == F.col("way.zip")) & (w < F.col("way")))
    earlier = F.array_sort(F.transform(same, lambda w: F.struct(*[w[c].alias(c) for c in ("listed", "type", "low", "high")])))
    out = ways.select("prefix", "way.*", earlier.alias("earlier"), F.explode("rows").alias("row"))
    return out.select("zip", "prefix", "listed", "type", "low", "high", "earlier", F.col("row.low").alias("least"), F.col("row.high").alias("most"), "row.match", "row.face")


def _met(living: DataFrame, listed: DataFrame, more: list[str]) -> DataFrame:
    """STREET, RANGE, overlap and ``more`` of each street that persons live in with each row of ``listed`` that shares a distinctive word, and two words or more.

    A street meets a row under the first word that both have, so once.
    """
    own = distinctive(F.col("tokens"))
    words = F.when(F.size(own) == 0, F.lit([ALL_GENERIC])).otherwise(F.array_sort(own))
    streets = living.select(*STREET).distinct().withColumn("words", words).withColumn("word", F.explode("words"))
    tokens, other = F.col("tokens"), F.col("match")
    against = [has_any(tokens, a, b) & F.array_contains(other, c) for a, b, c in (("n", "north", "s"), ("s", "south", "n"), ("e", "east", "w"), ("w", "west", "e"))]
    opposed = against[0] | against[1] | against[2] | against[3]
    met = streets.join(listed.withColumn("word", F.explode("listed")), ["zip", "prefix", "word"])
    met = met.where((F.get(F.array_intersect("words", "listed"), F.lit(0)) == F.col("word")) & ~opposed)
    return met.withColumn("overlap", F.size(F.array_intersect(tokens, other))).where("overlap >= 2").select(*STREET, *RANGE, "words", "overlap", *more)


def _fits(way: Column, number: Column, kind: Column) -> Column:
    return ((way["type"] == "mixed") | (way["type"] == kind)) & number.between(way["low"], way["high"])


def _scored(rows: DataFrame, columns: list[str]) -> DataFrame:
    numeric = F.exists("tokens", lambda t: t.rlike("^[0-9]+$")).cast("int")
    return rows.select("external_id", *[F.col(f"face.{c}").alias(c) for c in columns], F.col("house_number").alias("person_house_number"), F.col("overlap").alias("token_overlap"), numeric.alias("numeric_token_bonus"), (F.col("overlap") + numeric).alias("match_score"))


def candidates(people: DataFrame, faces: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs that share two words or more, one of them distinctive, in a range of house numbers; with ``columns`` of ``faces`` (all).

    An inverted index: streets of persons and segments by zip, prefix and
    distinctive word; nothing is compared outside of it. Segments of a street
    and range are listed together, and pairs come out of that list at the very
    end: no pair is ever shuffled or written before. Persons with several
    addresses go pair by pair.
    """
    columns = columns or faces.columns
    one, several = _split(people)
    living = _living(one)
    listed = _listed(faces, columns)
    listed = listed.groupBy("zip", "prefix", "listed", *RANGE, "match", "earlier").agg(F.collect_list("face").alias("faces"))
    met = _met(living, listed, ["earlier", "faces"])
    also = F.filter("earlier", lambda w: F.arrays_overlap(w["listed"], F.col("words")))
    met = met.withColumn("earlier", F.transform(also, lambda w: F.struct(w["type"].alias("type"), w["low"].alias("low"), w["high"].alias("high"))))
    lists = met.repartition(*STREET).groupBy(*STREET, *RANGE, "earlier", "overlap").agg(F.flatten(F.collect_list("faces")).alias("faces"))
    number, kind = F.col("house_number"), F.col("own_type")
    rows = living.join(lists, STREET).where(_fits(F.struct("type", "low", "high"), number, kind) & number.between(F.col("least"), F.col("most")))
    rows = rows.where((F.size("earlier") == 0) | ~F.exists("earlier", lambda w: _fits(w, number, kind)))
    pairs = _scored(rows.select("external_id", "house_number", "tokens", "overlap", F.explode("faces").alias("face")), columns)
    return pairs if several is None else pairs.unionByName(_pairwise(several, faces).select(pairs.columns))


def best_matches(people: DataFrame, faces: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """best_match() of candidates(), without the pairs: of the segments of a street with one range only the first counts, and each house takes the best range that it lies in."""
    columns = columns or faces.columns
    one, several = _split(people)
    living = _living(one)
    first = F.struct("face.blockface_id", "face.full_name", "face")
    listed = stored(_listed(faces, columns).groupBy("zip", "prefix", "listed", *RANGE, "match").agg(F.min(first).alias("first")))
    met = _met(living, listed, ["first"])
    ranges = met.groupBy(*STREET, *RANGE).agg(F.min(F.struct((-F.col("overlap")).alias("less"), "first")).alias("top"))
    # a street's ranges, best first
    best = stored(ranges.groupBy(*STREET).agg(F.array_sort(F.collect_list(F.struct("top", *RANGE))).alias("ranges")))
    number, kind = F.col("house_number"), F.col("own_type")
    here = F.get(F.filter("ranges", lambda r: _fits(r, number, kind) & number.between(r["least"], r["most"])), F.lit(0))
    rows = living.join(best, STREET).withColumn("here", here["top"]).where("here is not null")
    rows = rows.select("external_id", "house_number", "tokens", (-F.col("here.less")).alias("overlap"), F.col("here.first.face").alias("face"))
    own = _scored(rows, columns)
    return own if several is None else own.unionByName(best_match(_pairwise(several, faces)).select(own.columns))


def best_match(scored: DataFrame) -> DataFrame:
    """The segment with the best score of each person; ties by id, then name."""
    order = Window.partitionBy("external_id").orderBy(F.desc("match_score"), "blockface_id", "full_name")
    return scored.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
