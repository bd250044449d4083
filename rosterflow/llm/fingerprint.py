"""Homomorphic multiset fingerprints of documents, in DataFrame expressions only.

A text is a multiset of paragraphs (its lines, empty ones included). Each
paragraph is hashed to a wide vector, and the fingerprint is the sum of the
vectors modulo powers of two, so it does not depend on the order of the
paragraphs, and a paragraph is inserted or deleted by adding or subtracting
its vector. A vector has two parts:

* 8 lanes modulo 2^32: XXH64 of the paragraph under 8 salts; they decide
  equality.
* 128 lanes modulo 2^32, two to a bigint: for each run of up to 64 code
  points of the paragraph, the bits of two hashes; with the count of the runs
  they are the coordinates of a random projection, whose cosine estimates how
  much two texts share.

Null text counts as empty. No text has as many runs as a lane can count.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import table

EXACT, WIDE, RUN = 8, 64, 64
ONES = 0x0000000100000001
LOW = 0x7FFFFFFF7FFFFFFF
HIGH = 0x8000000080000000 - (1 << 64)
WORD = 0xFFFFFFFF
#: Rows that a neighbour bucket holds at best, and the most buckets there are.
BUCKET_ROWS, BUCKETS = 1024, 32_768


def _lane_add(a: Column, b: Column) -> Column:
    """Sum of two 32-bit lanes without carries between them."""
    return (a.bitwiseAND(F.lit(LOW)) + b.bitwiseAND(F.lit(LOW))).bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(F.lit(HIGH)))


def _lane_subtract(a: Column, b: Column) -> Column:
    return (a.bitwiseOR(F.lit(HIGH)) - b.bitwiseAND(F.lit(LOW))).bitwiseXOR(a.bitwiseXOR(F.bitwise_not(b)).bitwiseAND(F.lit(HIGH)))


def add(f: Column, g: Column) -> Column:
    """Fingerprint of the union of two multisets of paragraphs."""
    return F.struct(
        F.zip_with(f["exact"], g["exact"], lambda x, y: (x + y).bitwiseAND(F.lit(WORD))).alias("exact"),
        F.zip_with(f["wide"], g["wide"], _lane_add).alias("wide"),
        (f["runs"] + g["runs"]).alias("runs"),
    )


def subtract(f: Column, g: Column) -> Column:
    """Fingerprint of ``f`` after the paragraphs of ``g`` are deleted."""
    return F.struct(
        F.zip_with(f["exact"], g["exact"], lambda x, y: (x - y).bitwiseAND(F.lit(WORD))).alias("exact"),
        F.zip_with(f["wide"], g["wide"], _lane_subtract).alias("wide"),
        (f["runs"] - g["runs"]).alias("runs"),
    )


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: struct<exact array<bigint>, wide array<bigint>, runs bigint> of the string column ``text``."""
    kept = df.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns(
        {
            "__paragraphs": F.split(whole, "\n"),
            "__runs": F.transform(F.regexp_extract_all(whole, F.lit(f"[^\n]{{1,{RUN}}}"), F.lit(0)), lambda r: F.xxhash64(r)),
        }
    )
    # lanes add without a carry because a summand's lanes are 0 or 1
    def lane(h, j):
        return F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: (acc.bitwiseAND(F.lit(LOW)) + F.shiftright(x, j).bitwiseAND(F.lit(ONES))).bitwiseXOR(acc.bitwiseAND(F.lit(HIGH))))

    df = df.withColumn("__more", F.transform("__runs", lambda h: F.xxhash64(h, F.lit(1))))
    def salted(k):
        return F.aggregate("__paragraphs", F.lit(0).cast("bigint"), lambda acc, p: (acc + F.xxhash64(F.lit(k), p).bitwiseAND(F.lit(WORD))).bitwiseAND(F.lit(WORD)))

    exact = [salted(k) for k in range(EXACT)]
    wide = [lane(h, j) for h in ("__runs", "__more") for j in range(WIDE // 2)]
    made = F.struct(F.array(*exact).alias("exact"), F.array(*wide).alias("wide"), F.size("__runs").cast("bigint").alias("runs"))
    return df.select(*[F.col(c) for c in kept], made.alias(out))


def as_text(f: Column) -> Column:
    """The fingerprint as base64 of all its lanes."""
    digits = [F.lpad(F.hex(f["exact"][k]), 8, "0") for k in range(EXACT)]
    digits += [F.lpad(F.hex(f["wide"][k]), 16, "0") for k in range(WIDE)]
    digits.append(F.lpad(F.hex(f["runs"]), 16, "0"))
    return F.base64(F.unhex(F.concat(*digits)))


def coordinates(f: Column) -> Column:
    """array<double> of 128: in how many more runs than not each bit is set."""

    def centred(x, shift):
        return (F.shiftright(x, shift).bitwiseAND(F.lit(WORD)) * 2 - f["runs"]).cast("double")

    return F.flatten(F.transform(f["wide"], lambda x: F.array(*[centred(x, s) for s in (0, 32)])))


def likeness(f: Column, g: Column, u: Column, v: Column) -> Column:
    """Cosine of coordinates ``u`` of ``f`` and ``v`` of ``g``, cut to 0..1; equal fingerprints give 1."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, z: acc + z)

    norm = F.sqrt(dot(u, u) * dot(v, v))
    cosine = F.when(norm > 0, dot(u, v) / norm).otherwise(0.0)
    return F.when(f == g, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns and ``next_<c>`` of each, from the next row by ascending doc_id; the last row's next is the first.

    Rows without an id come last, and equal ids are ordered by the hash of the
    text, so repeated rows follow each other. Rows are dealt once, to buckets
    of id ranges; the first rows of each bucket are repeated at the end of the
    bucket before it, so no task sees more than a bucket. Bucket bounds are at
    most 4096 quantiles, whatever the input.
    """
    facts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    want = min(BUCKETS, max(1, facts["n"] // BUCKET_ROWS))
    bounds = []
    if facts["ids"] and want > 1:
        shares = [i / want for i in range(1, want)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 20 * want)).first()[0]))
    order = F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
    last = len(bounds) + 1
    unnamed = facts["ids"] < facts["n"]
    place = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    if unnamed:
        place = F.when(F.col("doc_id").isNull(), F.lit(last + 128) + F.shiftright(order, 56).cast("int")).otherwise(place)
    bucketed = docs.withColumn("__bucket", place)
    least = order if unnamed else F.lit(None).cast("bigint")
    firsts = bucketed.groupBy("__bucket").agg(F.min("doc_id").alias("__first"), F.min(F.when(F.col("doc_id").isNull(), least)).alias("__first_order"))
    ring = Window.orderBy("__bucket")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("__before", F.coalesce(F.lag("__bucket").over(ring), F.max("__bucket").over(whole)))
    rows = bucketed.join(F.broadcast(firsts), "__bucket").withColumn("__order", order)
    opens = F.when(F.col("doc_id").isNull(), F.col("__order") == F.col("__first_order")).otherwise(F.col("doc_id") == F.col("__first"))
    places = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("again")))
    places = F.when(opens, F.concat(places, F.array(F.struct(F.col("__before").alias("b"), F.lit(True).alias("again"))))).otherwise(places)
    dealt = rows.select(*carried, "doc_id", "__order", F.explode(places).alias("__at")) if "doc_id" not in carried else rows.select(*carried, "__order", F.explode(places).alias("__at"))
    dealt = dealt.select("*", F.col("__at.b").alias("__b"), F.col("__at.again").alias("__again"))
    after = Window.partitionBy("__b").orderBy("__again", F.col("doc_id").asc_nulls_last(), "__order")
    led = dealt.select(*carried, "__again", *[F.lead(c).over(after).alias(f"next_{c}") for c in carried])
    return led.where(~F.col("__again")).drop("__again")


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of the text whose second half comes from the next row's start.

    Null text counts as empty; extra columns are ignored; an empty table gives
    an empty result; a single row is its own next.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(base, "text", "f"), ["doc_id", "text", "f"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.expr("cast(n_chars div 2 as int)")
    head = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)
    rows = rows.select("doc_id", "n_chars", "f", "next_f", F.concat(head, F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "g")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "g", "next_f", *[coordinates(F.col(c)).alias(f"at_{c}") for c in ("f", "g", "next_f")])
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("f")).alias("fingerprint"), as_text(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g"), F.col("at_f"), F.col("at_g")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_f"), F.col("at_f"), F.col("at_next_f")).alias("near_next"),
    )
