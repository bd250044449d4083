"""Joins of points with polygons and lines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.stored import stored

#: A polygon's box has at most so many cells along a side.
CELLS = 256


def containing(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", cell: float | None = None) -> DataFrame:
    """Pairs of ``points`` and the ``polygons`` (ring: closed array<struct<x, y>>) that contain them.

    Both meet by cells of a grid as wide as the median box (or ``cell``), so a
    point is compared with what is near it, by bounding box first. Cells are
    wider only where the largest polygon would touch too many.
    """
    boxed = polygons.withColumn("__box", F.struct(*[b.alias(n) for n, b in zip(("x0", "y0", "x1", "y1"), geo.bounds(F.col("ring")), strict=True)]))
    inside = geo.in_ring(F.col("ring"), F.col(x), F.col(y))
    near = (F.col(x) >= F.col("__box.x0")) & (F.col(x) <= F.col("__box.x1")) & (F.col(y) >= F.col("__box.y0")) & (F.col(y) <= F.col("__box.y1"))
    wide = F.greatest(F.col("__box.x1") - F.col("__box.x0"), F.col("__box.y1") - F.col("__box.y0"))
    if cell is None:
        middle, widest = boxed.agg(F.percentile_approx(wide, 0.5), F.max(wide)).first()
        cell = max(middle or 0.0, (widest or 0.0) / CELLS, 1e-9)
    at = lambda v: F.floor(v / cell).cast("bigint")
    along = lambda low, high: F.explode(F.sequence(at(F.col(f"__box.{low}")), at(F.col(f"__box.{high}"))))
    cells = boxed.withColumn("__cx", along("x0", "x1")).withColumn("__cy", along("y0", "y1"))
    keyed = points.withColumns({"__cx": at(F.col(x)), "__cy": at(F.col(y))})
    return keyed.join(cells, ["__cx", "__cy"]).where(near & inside).drop("__box", "__cx", "__cy")


def majority_key(points: DataFrame, key: str) -> DataFrame:
    """block_geoid, key, voters: the key that most points of each block have; ties by key."""
    counted = points.where(F.col(key).isNotNull()).groupBy("block_geoid", F.col(key).alias("key")).agg(F.count("*").alias("voters"))
    order = Window.partitionBy("block_geoid").orderBy(F.desc("voters"), "key")
    return counted.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def backfilled(blocks: DataFrame, won: DataFrame) -> DataFrame:
    """block_geoid, key of all land blocks: a block without a winner takes that of the nearest centre; ties by block.

    The lookup is by growing grid cells: each block without a key asks the
    cells around it, and only blocks whose nearest winner may lie beyond the
    ring asked go on to the next, twice as wide.
    """
    won = stored(won.select("block_geoid", "key"))
    known = stored(blocks.select("block_geoid", "cx", "cy").join(won, "block_geoid"))
    todo = stored(blocks.where("land_area > 0").join(won, "block_geoid", "left_anti").select(F.col("block_geoid").alias("asking"), F.col("cx").alias("ax"), F.col("cy").alias("ay")))
    done = won
    facts = known.agg(F.count("*"), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    if not facts[0]:
        return done
    reach = todo.agg(F.min("ax"), F.max("ax"), F.min("ay"), F.max("ay")).first()
    if reach[0] is None:
        return done
    extent = max(max(facts[2], reach[1]) - min(facts[1], reach[0]), max(facts[4], reach[3]) - min(facts[3], reach[2]), 1e-9)
    side = extent / max(1.0, facts[0] ** 0.5)
    while True:
        at = lambda v: F.floor(v / side).cast("bigint")  # noqa: B023, E731
        cells = known.withColumns({"gx": at(F.col("cx")), "gy": at(F.col("cy"))})
        around = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))
        asked = todo.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({"gx": at(F.col("ax")) + F.col("i"), "gy": at(F.col("ay")) + F.col("j")})
        away = F.hypot(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay"))
        best = asked.join(cells, ["gx", "gy"]).groupBy("asking").agg(F.min(F.struct(away.alias("d"), "block_geoid", "key")).alias("b"))
        last = side > 2 * extent
        # all centres within a cell's side were asked
        sure = best if last else stored(best.where(F.col("b.d") <= side))
        done = done.unionByName(sure.select(F.col("asking").alias("block_geoid"), F.col("b.key").alias("key")))
        if last:
            return done
        # what is left is written, so a round reads only the one before
        todo = stored(todo.join(sure.select("asking"), "asking", "left_anti"))
        if not todo.limit(1).count():
            return done
        side *= 2


def nearest_in_zip(places: DataFrame, faces: DataFrame) -> DataFrame:
    """zip5, latitude, longitude, blockface_id, snap_distance_m: the nearest line (``line_m``, in metres) of the same zip; ties by id.

    Places are made distinct first, since many persons share one.
    """
    x, y = geo.to_utm(F.col("longitude"), F.col("latitude"))
    where = places.select("zip5", "latitude", "longitude").distinct().withColumns({"x": x, "y": y})
    # of equal lines the first by id is nearest
    lines = faces.groupBy(F.col("zip_code").alias("zip5"), "line_m").agg(F.min("blockface_id").alias("blockface_id"))
    pairs = where.join(lines, "zip5")
    found = geo.locate(F.col("line_m"), F.col("x"), F.col("y"))["distance"]
    best = pairs.groupBy("zip5", "latitude", "longitude").agg(F.min(F.struct(found.alias("d"), "blockface_id")).alias("b"))
    return best.select("zip5", "latitude", "longitude", F.col("b.blockface_id").alias("blockface_id"), F.col("b.d").alias("snap_distance_m"))


#: Distinct strings that one task numbers, and strings that are drawn for each border between tasks.
NUMBERED, DRAWN = 500_000, 32


def dense_ids(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with an integer id of each distinct string, dense and in order of the strings; null stays null.

    Distinct strings fall into ranges between some of their own, drawn by
    hash, so that a string's range depends on nothing but the strings; ranges
    are numbered apart and shifted by the sizes of those before.
    """
    names = stored(rows.where(F.col(column).isNotNull()).select(column).distinct())
    n = names.count()
    ranges = -(-n // NUMBERED)
    borders = []
    if ranges > 1:
        every = max(1, n // (ranges * DRAWN))
        drawn = sorted(r[0] for r in names.where(F.pmod(F.xxhash64(column), F.lit(every)) == 0).collect())
        borders = drawn[DRAWN::DRAWN]
    own = F.size(F.filter(F.lit(borders).cast("array<string>"), lambda b: b <= F.col(column))) if borders else F.lit(0)
    ranged = names.withColumn("__p", own)
    before, sizes = 0, []
    for r in sorted(ranged.groupBy("__p").count().collect(), key=lambda r: r["__p"]):
        sizes.append((r["__p"], before))
        before += r["count"]
    starts = names.sparkSession.createDataFrame(sizes, "__p int, __s bigint")
    inside = Window.partitionBy("__p").orderBy(column)
    ids = ranged.join(F.broadcast(starts), "__p").select(column, (F.row_number().over(inside) + F.col("__s")).alias(out))
    return rows.join(ids, column, "left")


def shifted(line: Column, at: Column, side: Column, metres: float) -> Column:
    """The point at fraction ``at``, moved off the line to its left or right."""
    sign = F.when(side == "left", F.lit(metres)).otherwise(F.lit(-metres))

    def moved(both: Column) -> Column:
        here, ahead = both["here"], both["ahead"]
        dx, dy = ahead["x"] - here["x"], ahead["y"] - here["y"]
        n = F.hypot(dx, dy)
        return F.when(n > 0, geo.point(here["x"] - sign * dy / n, here["y"] + sign * dx / n)).otherwise(here)

    # an array of one, so that each point is found once
    both = F.struct(geo.interpolate(line, at).alias("here"), geo.interpolate(line, F.least(at + 0.01, F.lit(1.0))).alias("ahead"))
    return F.get(F.transform(F.array(both), moved), F.lit(0))
