import pytest
from pyspark.sql import functions as F

from rosterflow.functions import addressing as ad
from rosterflow.functions import geo
from rosterflow.operators import geocode, matching, publish, spatial, topology
from rosterflow.plans import expand
from rosterflow.plans.compile import Compiler, fold
from rosterflow.plans.model import Catalog, CriteriaError, FieldDef, criteria, parse, step

CROSS = [(0.0, "E", "from", "S1400"), (90.0, "N", "from", "S1400"), (180.0, "W", "to", "S1400"), (270.0, "S", "from", "S1400")]
SIDES = {(line, side): f"{line}:{side}" for line in "ENWS" for side in ("left", "right")}


def relate(spark, ends):
    listed = spark.createDataFrame([("n", line, end, bearing, code) for bearing, line, end, code in ends], "node_id string, tiger_line_id string, end string, bearing double, feature_class_code string")
    faces = spark.createDataFrame([(line, side, face) for (line, side), face in SIDES.items()], "tiger_line_id string, side string, blockface_id string")
    return {(r[0], r[1]): tuple(r) for r in topology.at_nodes(listed, faces).collect()}


def test_four_corners(spark):
    rows = relate(spark, CROSS)
    # each corner joins two sides; the western line is drawn towards the node
    assert rows["E:left", "N:right"][2] == "hinge" and rows["N:left", "W:left"][2] == "hinge"
    assert rows["E:left", "W:left"][2:6] == ("continue", "n", ["N"], ["S1400"])
    assert rows["E:right", "N:right"][2] == "turn" and rows["E:right", "N:left"][2] == "kitty_corner"
    assert sum(r[2] == "hinge" for r in rows.values()) == 4 and ("E:left", "E:right") not in rows


def test_cheaper_way_and_dead_end(spark):
    busy = [(b, x, e, "S1200" if x == "N" else c) for b, x, e, c in CROSS]
    # three quiet streets are cheaper than one busy street
    assert relate(spark, busy)["E:left", "W:left"][2:] == ("other", "n", ["E", "S", "W"], ["S1400"] * 3, "minor", 45.0)
    wall = [(b, x, e, "R1011" if x == "N" else c) for b, x, e, c in CROSS]
    assert relate(spark, wall)["E:left", "W:left"][7] == 45.0
    (only,) = relate(spark, [(10.0, "E", "to", None)]).values()
    assert only[2:] == ("hinge", "n", [], [], "none", 0.0)
    codes = spark.createDataFrame([("H2030",), ("S9999",), (None,)], "c string")
    assert [tuple(r.w) for r in codes.select(topology.worth(F.col("c")).alias("w")).collect()] == [(3, topology.BARRIER), (2, 60.0), (2, 60.0)]


def test_utm_round_trip_and_lines(spark):
    df = spark.createDataFrame([(-74.0, 40.7), (-73.5, 41.2), (-76.1, 42.9)], "lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    back = geo.from_utm(F.col("x"), F.col("y"))
    # the third-order series is good to a millimetre
    for r in df.select("*", x.alias("x"), y.alias("y")).select("*", back[0].alias("lon2"), back[1].alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
    line = F.array(*[geo.point(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))])
    got = spark.range(1).select(
        geo.length(line).alias("n"), geo.locate(line, F.lit(12.0), F.lit(5.0)).alias("at"), geo.locate(line, F.lit(-3.0), F.lit(-4.0)).alias("before"), geo.interpolate(line, F.lit(0.75)).alias("p"),
        spatial.shifted(line, F.lit(0.25), F.lit("left"), 7.0).alias("left"), geo.centroid(F.array(*[geo.point(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0))])).alias("c"),
    ).first()
    assert got.n == 20 and tuple(got.at) == (2.0, 0.75) and tuple(got.before) == (5.0, 0.0)
    assert tuple(got.p) == (10.0, 5.0) and tuple(got.left) == (5.0, 7.0) and tuple(got.c) == (2.0, 1.0)


def test_position_branches(spark):
    rows = [("complex", 40.7777, -73.8888, True, "b1"), ("beyond", 40.85, -73.85, False, "b2"), ("matched", 40.7501, -74.0, False, "b3"), ("none", None, None, False, "b4"), ("lost", 40.7, -74.0, False, "b5")]
    kind = "external_id string, osm_lat double, osm_lon double, in_complex boolean, blockface_id string"
    df = spark.createDataFrame(rows, kind).withColumns({"side": F.lit("left"), "tiger_line_id": F.col("blockface_id"), "own_prefix": F.lit(""), "person_house_number": F.lit(5), "half_code": F.lit(""), "osm_street": F.lit("X"), "osm_housenumber": F.lit("5")})
    lines = spark.createDataFrame([(b, [{"x": -74.01, "y": 40.75}, {"x": -73.99, "y": 40.75}]) for b in ("b1", "b2", "b3", "b4")], "blockface_id string, line array<struct<x: double, y: double>>")
    got = {r.external_id: r for r in geocode.refined_positions(df, lines).collect()}
    assert {k: v.position_source for k, v in got.items()} == {"complex": "osm_complex", "beyond": "osm_off_segment", "matched": "osm_matched", "none": "tiger_only"}
    # seven metres to the left of an eastbound line
    assert abs(got["matched"].longitude + 74.0) < 1e-4 and 40.75005 < got["matched"].latitude < 40.75008


def test_polygons_by_cells_of_any_width(spark):
    squares = spark.createDataFrame([(i, [{"x": float(i), "y": 0.0}, {"x": i + 1.5, "y": 0.0}, {"x": i + 1.5, "y": 1.0}, {"x": float(i), "y": 1.0}, {"x": float(i), "y": 0.0}]) for i in range(20)], "k long, ring array<struct<x: double, y: double>>")
    points = spark.range(400).select(F.col("id"), (F.col("id") * 0.05 + 0.01).alias("x"), F.lit(0.5).alias("y"))
    want = sorted((i, k) for i in range(400) for k in range(20) if k < i * 0.05 + 0.01 < k + 1.5)
    for cell in (None, 0.3, 50.0):
        assert sorted((r.id, r.k) for r in spatial.containing(points, squares, cell=cell).collect()) == want


def test_dense_ids_over_ranges(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("s"), F.col("id") % 700)).alias("s"))
    want = {s: i + 1 for i, s in enumerate(sorted({f"s{i % 700}" for i in range(3000) if i % 10 > 0}))} | {None: None}
    for n in (500_000, 50):
        monkeypatch.setattr(spatial, "NUMBERED", n)
        assert {r.s: r.i for r in spatial.dense_ids(rows, "s", "i").collect()} == want


def test_nearest_line_of_the_zip(spark):
    faces = spark.createDataFrame([("1", "b", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}]), ("1", "a", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}]), ("2", "c", [{"x": 5.0, "y": 5.0}, {"x": 6.0, "y": 5.0}])], "zip_code string, blockface_id string, line_m array<struct<x: double, y: double>>")
    places = spark.createDataFrame([("1", 40.0, -74.0)] * 3, "zip5 string, latitude double, longitude double")
    assert [r.blockface_id for r in spatial.nearest_in_zip(places, faces).collect()] == ["a"]


def test_unparseable_ranges_are_errors(spark):
    rows = spark.createDataFrame([("x", "12-1", "13-9", "A", "b", "left", "1")], "tiger_line_id string, raw_from string, raw_to string, full_name string, blockface_id string, side string, zip_code string")
    with pytest.raises(ValueError, match="12-1"):
        matching.normalized(rows)


@pytest.mark.parametrize(("number", "want"), [("123", "123"), ("0042", "42"), ("132-01", "1321"), ("9-02", "92"), ("6-46", "646"), ("12-3-4", "1234")])
def test_house_numbers(spark, number, want):
    assert spark.range(1).select(ad.housenumber_norm(F.lit(number))).first()[0] == want


def test_publish_checks_and_json(spark):
    drafts = spark.createDataFrame([("d1", 1), ("d2", 0)], "turf_draft_id string, sort_order int")
    twice = spark.createDataFrame([("b", "d1", 1), ("b", "d2", 0)], "building_id string, turf_draft_id string, idx int")
    with pytest.raises(publish.PublishError, match="more than one"):
        publish.check(twice, drafts)
    one = twice.where("idx = 1")
    with pytest.raises(publish.PublishError, match="no building"):
        publish.check(one, drafts)
    people = spark.createDataFrame([("p1", "A", "B", "b", "x", None, "1 A", "C", "NY", "1", 1.0, 2.0)], "external_id string, first_name string, last_name string, building_id string, door_id string, address_line_2 string, address_line_1 string, city string, state string, zip5 string, latitude double, longitude double")
    turfs = publish.payloads(people, one, drafts)
    data = {r.idx: r.data for r in publish.as_json(turfs).collect()}
    assert '"unit":null' in data[1] and '"buildings":[]' in data[0]
    assert all(len(r.code) == 8 for r in turfs.collect())


# criteria

FIELDS = {"g": FieldDef("enum", "gender"), "n": FieldDef("number-range", "f_n", True)}


def test_tree_from_json_and_errors():
    tree = parse({"steps": [{"verb": "narrow", "filter": {"kind": "nested", "criteria": {"steps": [{"verb": "add", "filter": {"kind": "enum", "key": "g", "values": ["F"]}}]}}}]})
    assert tree.steps[0].filter.criteria.steps[0].filter.values == ["F"]
    for bad in ({"verb": "keep", "filter": {"kind": "all"}}, {"verb": "add", "filter": {"kind": "magic"}}, {"verb": "add", "filter": {"kind": "all", "x": 1}}):
        with pytest.raises(CriteriaError):
            parse({"steps": [bad]})


@pytest.mark.parametrize("filter_", [("enum", {"key": "zzz", "values": ["a"]}), ("text", {"key": "g", "value": "a"}), ("segment", {"segmentId": "s"}), ("canvass-outcome", {"outcomes": ["x"]}), ("voting-history-detail", {"mode": "any", "elections": ["2020-general"]})])
def test_uncompilable_filters(spark, filter_):
    with pytest.raises(CriteriaError):
        Compiler(Catalog(FIELDS)).compile(criteria(step("narrow", filter_[0], **filter_[1])))


def test_unknown_key_group(spark):
    with pytest.raises(CriteriaError):
        Compiler(Catalog(FIELDS)).compile(criteria(), ("nowhere", ["1"]))


def test_cycles_depth_and_missing_segments():
    seg = lambda s: step("add", "segment", segmentId=s)
    store = {"a": criteria(seg("b")), "b": criteria(seg("a")), "c": criteria(seg("gone"), seg(None))}
    with pytest.raises(CriteriaError, match="itself"):
        expand.expand_segments(criteria(seg("a")), store.get)
    deep = {str(i): criteria(seg(str(i + 1))) for i in range(20)}
    with pytest.raises(CriteriaError, match="deep"):
        expand.expand_segments(criteria(seg("0")), deep.get)
    assert expand.expand_segments(criteria(seg("c")), store.get).steps[0].filter.criteria.steps == ()
    assert expand.would_cycle("a", criteria(seg("b")), store.get) and not expand.would_cycle("z", criteria(seg("c")), store.get)
    assert expand.reachable_segments("a", store.get) == {"a", "b"}


SEQUENCES = ["n", "a", "r", "nn", "na", "nr", "rn", "ra", "anr", "nar", "rrn", "nann"]


@pytest.mark.parametrize("verbs", SEQUENCES)
def test_steps_fold_like_sql(spark, verbs):
    rows = [(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (True, False, None)]
    df = spark.createDataFrame(rows, "x boolean, y boolean, z boolean")
    names = {"n": "narrow", "a": "add", "r": "remove"}
    columns = ["x", "y", "z", "x"]
    text = None
    for v, c in zip(verbs, columns):
        text = (f"NOT {c}" if v == "r" else c) if text is None else f"({text}) {'OR' if v == 'a' else 'AND'} {'NOT ' if v == 'r' else ''}{c}"
    got = fold([(names[v], F.col(c)) for v, c in zip(verbs, columns)])
    assert sorted(map(str, df.where(got).collect())) == sorted(map(str, df.where(text).collect()))


def test_walks_one_after_the_other(spark):
    from datetime import datetime, timedelta

    from rosterflow.operators import contacts

    t0 = datetime(2026, 1, 5, 8)
    rows = [("o", "t1", "1", 4 * k) for k in range(6)] + [("o", "t1", "2", 0), ("o", "t2", "2", 1), ("o", "t1", "2", 2), ("o", "t1", None, 0), ("o", "t1", None, 1), ("o", "t1", "3", 0), ("o", "t1", "3", 2), ("p", "t9", "3", 1)]
    opens = spark.createDataFrame([(o, t, p, t0 + timedelta(hours=h)) for o, t, p, h in rows], "organization_id string, turf_id string, phone string, opened_at timestamp")

    def got(closes=None):
        found = contacts.opened_walks(opens, closes).collect()
        hours = lambda x: None if x is None else (x - t0).total_seconds() / 3600
        return sorted((r.phone or "", r.turf_id, hours(r.opened_at), hours(r.closed_at)) for r in found)

    want = [("", "t1", 0, None), ("", "t1", 1, None), ("1", "t1", 0, 8), ("1", "t1", 8, 16), ("1", "t1", 16, None), ("2", "t1", 0, 1), ("2", "t1", 2, None), ("2", "t2", 1, 2), ("3", "t1", 0, None), ("3", "t9", 1, None)]
    assert got() == sorted(want, key=lambda r: (r[0], r[1], r[2]))
    closes = spark.createDataFrame([("o", "t1", "3", t0 + timedelta(hours=1)), ("o", "t5", "1", t0)], "organization_id string, turf_id string, phone string, closed_at timestamp")
    assert [r for r in got(closes) if r[0] in "13" and r[0]] == [("1", "t1", 0, 8), ("1", "t1", 8, 16), ("1", "t1", 16, None), ("3", "t1", 0, 1), ("3", "t1", 2, None), ("3", "t9", 1, None)]


def test_doors_in_walking_order(spark):
    from rosterflow.operators import contacts

    units = ["PH", "APT PH1", "12AA", "Unit 12 B", "5-2", "5-10", "apt 5B", "# 3", "2", "B12", "Suite C2", ""]
    doors = spark.createDataFrame([(1, len(units) - i, u) for i, u in enumerate(units)], "building_id int, door_id int, unit string")
    placed = {r.door_id: r.place for r in contacts.walk_order(doors).collect()}
    assert [placed[len(units) - i] for i in range(len(units))] == list(range(1, len(units) + 1))


def test_sort_keys_have_no_accents(spark):
    from rosterflow.functions.hashing import name_key

    rows = spark.createDataFrame([("Šťastný", "Ørsted"), ("Núñez", "e\u0301lan"), ("Ångström", "Łuk")], "a string, b string")
    assert [r[0] for r in rows.select(name_key(F.col("a"), F.col("b"))).collect()] == ["STASTNY ØRSTED  ", "NUNEZ ELAN      ", "ANGSTROM ŁUK    "]
