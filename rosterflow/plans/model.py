"""Criteria trees: ordered steps of add, narrow and remove over typed filters."""

from dataclasses import dataclass, field
from typing import Any


class CriteriaError(ValueError):
    """A criteria tree that cannot be compiled."""


VERBS = ("add", "narrow", "remove")

#: The arguments of each kind of filter, as they are named in JSON.
ARGUMENTS = {
    "all": (),
    "enum": ("key", "values"),
    "age-range": ("key", "min", "max"),
    "text": ("key", "value"),
    "text-multi": ("key", "values"),
    "date-range": ("key", "min", "max"),
    "number-range": ("key", "min", "max"),
    "address": ("line1", "city", "state", "zip"),
    "voting-history-count": ("type", "windowYears", "comparator", "count"),
    "voting-history-detail": ("mode", "elections"),
    "person-id-set": ("ids",),
    "nested": ("criteria",),
    "segment": ("segmentId",),
    "canvass-outcome": ("outcomes",),
    "canvass-response": ("questionId", "optionIds"),
}


@dataclass(frozen=True)
class Filter:
    kind: str
    args: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return self.args.get(name)


@dataclass(frozen=True)
class Step:
    verb: str
    filter: Filter


@dataclass(frozen=True)
class Criteria:
    steps: tuple[Step, ...] = ()


def parse(tree: dict[str, Any]) -> Criteria:
    """A tree from its JSON form: {"steps": [{"verb", "filter": {"kind", ...}}]}."""
    steps = []
    for raw in tree.get("steps", []):
        if raw.get("verb") not in VERBS:
            raise CriteriaError(f"unknown verb {raw.get('verb')!r}")
        spec = dict(raw["filter"])
        kind = spec.pop("kind", None)
        if kind not in ARGUMENTS:
            raise CriteriaError(f"unknown filter kind {kind!r}")
        if extra := set(spec) - set(ARGUMENTS[kind]):
            raise CriteriaError(f"{kind}: unknown arguments {sorted(extra)}")
        if kind == "nested":
            spec["criteria"] = parse(spec["criteria"])
        steps.append(Step(raw["verb"], Filter(kind, spec)))
    return Criteria(tuple(steps))


def step(verb: str, kind: str, **args: Any) -> Step:
    """A step in code; a nested filter takes a Criteria."""
    return Step(verb, Filter(kind, args))


def criteria(*steps: Step) -> Criteria:
    return Criteria(tuple(steps))


@dataclass(frozen=True)
class FieldDef:
    """A filterable column: its kind of filter and where it lives."""

    kind: str
    column: str
    custom: bool = False


@dataclass
class Catalog:
    """What criteria may refer to in one dataset version.

    ``wide`` is the table of custom columns, unique by person_h, or None if
    nothing was ever appended. ``elections`` maps "year-type" to a bit.
    """

    fields: dict[str, FieldDef]
    key_groups: dict[str, str] = field(default_factory=dict)
    wide: Any = None
    elections: dict[str, int] | None = None
    today: str | None = None
