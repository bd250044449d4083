"""Rewrites of criteria trees on the driver: segments inline, contact results to id sets."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Criteria, CriteriaError, Filter, Step

DEEPEST = 8


def expand_segments(tree: Criteria, load: Callable[[str], Criteria | None], trail: tuple[str, ...] = ()) -> Criteria:
    """Segments as nested criteria; a step whose segment is null or missing is dropped."""
    if len(trail) > DEEPEST:
        raise CriteriaError("segments are nested too deeply")
    steps = []
    for s in tree.steps:
        f = s.filter
        if f.kind == "nested":
            f = Filter("nested", {"criteria": expand_segments(f.criteria, load, trail)})
        elif f.kind == "segment":
            if f.segmentId in trail:
                raise CriteriaError(f"segment {f.segmentId!r} refers to itself")
            inner = load(f.segmentId) if f.segmentId is not None else None
            if inner is None:
                continue
            f = Filter("nested", {"criteria": expand_segments(inner, load, (*trail, f.segmentId))})
        steps.append(Step(s.verb, f))
    return Criteria(tuple(steps))


def segment_ids(tree: Criteria) -> set[str]:
    found = set()
    for s in tree.steps:
        if s.filter.kind == "segment" and s.filter.segmentId is not None:
            found.add(s.filter.segmentId)
        elif s.filter.kind == "nested":
            found |= segment_ids(s.filter.criteria)
    return found


def reachable_segments(start: str, load: Callable[[str], Criteria | None]) -> set[str]:
    """Segments that a segment refers to, directly or not; cycles are no trouble here."""
    seen, todo = set(), [start]
    while todo:
        tree = load(todo.pop())
        fresh = (segment_ids(tree) if tree else set()) - seen
        seen |= fresh
        todo += fresh
    return seen


def would_cycle(segment: str, tree: Criteria, load: Callable[[str], Criteria | None]) -> bool:
    """Whether saving ``tree`` as ``segment`` makes it refer to itself."""
    direct = segment_ids(tree)
    return segment in direct or any(segment in reachable_segments(s, load) for s in direct)


def has_references(tree: Criteria) -> bool:
    kinds = {"segment", "canvass-outcome", "canvass-response"}
    return any(s.filter.kind in kinds or (s.filter.kind == "nested" and has_references(s.filter.criteria)) for s in tree.steps)


def resolve(tree: Criteria, load: Callable[[str], Criteria | None], latest: DataFrame, listed: bool = False) -> Criteria:
    """A tree without references. ``latest``: person_id, outcome, responses of each turf's and person's latest result.

    Untouched if there is nothing to resolve. Contact filters become sets of
    ids that stay tables and are joined; with ``listed`` they become lists, for
    trees that are stored.
    """
    return _contacts(expand_segments(tree, load), latest, listed) if has_references(tree) else tree


def _contacts(tree: Criteria, latest: DataFrame, listed: bool) -> Criteria:
    steps = []
    for s in tree.steps:
        f = s.filter
        if f.kind == "nested":
            f = Filter("nested", {"criteria": _contacts(f.criteria, latest, listed)})
        elif f.kind == "canvass-outcome":
            if not f.outcomes:
                continue
            f = _ids(latest.where(F.col("outcome").isin(list(f.outcomes))), listed)
        elif f.kind == "canvass-response":
            if not f.optionIds:
                continue
            given = F.from_json(F.get_json_object("responses", f"$['{f.questionId}'].optionIds"), "array<string>")
            f = _ids(latest.where(F.arrays_overlap(given, F.lit(list(f.optionIds)))), listed)
        steps.append(Step(s.verb, f))
    return Criteria(tuple(steps))


def _ids(rows: DataFrame, listed: bool) -> Filter:
    ids = rows.select(F.col("person_id").alias("external_id")).where("external_id is not null").distinct()
    return Filter("person-id-set", {"ids": sorted(r["external_id"] for r in ids.collect()) if listed else ids})
