"""Criteria to a Catalyst predicate.

The steps fold from the left into one boolean Column, so Parquet pruning and
pushdown apply. Three-valued logic is kept as it is: a null under ``remove``
leaves the row out. Custom fields and large id sets are probed by one left
join each, whichever steps use them; the joined sides are unique by key.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_on
from .model import Catalog, Criteria, CriteriaError, Filter

#: Larger id sets are joined; smaller ones are literals that reach the scan.
LITERAL_IDS = 1000
#: Which election types a filter on one type includes.
TYPE_ALIASES = {"primary": ("primary", "presidential_primary")}


@dataclass
class Compiled:
    """A predicate, and the joins that bring its columns to the persons."""

    predicate: Column
    clauses: list[tuple[str, Column]]
    needs_wide: bool = False
    id_sets: list[list[str] | DataFrame] = field(default_factory=list)
    catalog: Catalog | None = None

    def attach(self, persons: DataFrame) -> DataFrame:
        out = persons
        if self.needs_wide:
            wide = self.catalog.wide
            renamed = wide.select("person_h", *[F.col(c).alias(f"__{c}") for c in wide.columns if c != "person_h"])
            out = out.join(renamed, "person_h", "left")
        for i, ids in enumerate(self.id_sets):
            spark = persons.sparkSession
            keys = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(x,) for x in sorted(set(ids))], "external_id string")
            out = out.join(keys.withColumn(f"__in{i}", F.lit(True)), "external_id", "left")
        return out

    def filter(self, persons: DataFrame) -> DataFrame:
        """``persons`` that match, with their own columns."""
        return self.attach(persons).where(self.predicate).select(persons.columns)


class Compiler:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.needs_wide = False
        self.id_sets: list[list[str] | DataFrame] = []

    def compile(self, tree: Criteria, key_filter: tuple[str, list[str]] | None = None) -> Compiled:
        """``key_filter`` (key group, keys) is and-ed around the whole tree."""
        clauses = self._clauses(tree)
        predicate = fold(clauses)
        if predicate is None:
            predicate = F.lit(True)
        if key_filter is not None:
            group, keys = key_filter
            if group not in self.catalog.key_groups:
                raise CriteriaError(f"unknown key group {group!r}")
            column = F.col(self.catalog.key_groups[group])
            predicate = predicate & (column.isin(list(keys)) if keys else F.lit(False))
        return Compiled(predicate, clauses, self.needs_wide, self.id_sets, self.catalog)

    def _clauses(self, tree: Criteria) -> list[tuple[str, Column]]:
        found = [(s.verb, self._clause(s.filter)) for s in tree.steps]
        return [(verb, c) for verb, c in found if c is not None]

    def step_clauses(self, tree: Criteria) -> list[tuple[str, Column | None]]:
        """One entry per step, None where the step is inactive."""
        return [(s.verb, self._clause(s.filter)) for s in tree.steps]

    # None from these means that the filter says nothing under any verb.
    def _clause(self, f: Filter) -> Column | None:
        match f.kind:
            case "all":
                return F.lit(True)
            case "nested":
                inner = fold(self._clauses(f.criteria))
                return F.lit(True) if inner is None else inner
            case "person-id-set":
                return self._ids(f.ids if isinstance(f.ids, DataFrame) else list(f.ids or []))
            case "address":
                return self._address(f)
            case "voting-history-count":
                return self._history_count(f)
            case "voting-history-detail":
                return self._history_detail(f)
            case "segment" | "canvass-outcome" | "canvass-response":
                raise CriteriaError(f"{f.kind} must be resolved before it is compiled")
        definition = self.catalog.fields.get(f.key)
        if definition is None:
            raise CriteriaError(f"unknown field {f.key!r}")
        if f.kind != definition.kind:
            raise CriteriaError(f"field {f.key!r} takes {definition.kind} filters, not {f.kind}")
        if not definition.custom:
            if f.kind == "number-range":
                raise CriteriaError("number ranges are for custom fields")
            return self._scalar(f, F.col(definition.column))
        predicate = self._scalar(f, F.col(f"__{definition.column}"), custom=True)
        if predicate is None:
            return None
        if self.catalog.wide is None:
            return F.lit(False)
        self.needs_wide = True
        # membership in a set of persons is never null
        return F.coalesce(predicate, F.lit(False))

    def _scalar(self, f: Filter, column: Column, custom: bool = False) -> Column | None:
        match f.kind:
            case "enum":
                return column.isin(list(f.values)) if f.values else None
            case "text":
                return like(column, f.value) if (f.value or "").strip() else None
            case "text-multi":
                values = [v.strip() for v in f.values or [] if v.strip()]
                return column.isin(values) if values else None
            case "age-range":
                today = F.lit(self.catalog.today).cast("date") if self.catalog.today else F.current_date()
                return between(age_on(column, today), f.min, f.max)
            case "date-range":
                low, high = f.min or None, f.max or None
                if custom:
                    low, high = (F.lit(x).cast("date") if x else None for x in (low, high))
                return between(column, low, high)
            case "number-range":
                return between(column, f.min, f.max)
        raise CriteriaError(f"unknown filter kind {f.kind!r}")

    def _ids(self, ids: list[str] | DataFrame) -> Column:
        if not isinstance(ids, DataFrame) and len(ids) <= LITERAL_IDS:
            return F.col("external_id").isin(ids) if ids else F.lit(False)
        self.id_sets.append(ids)
        return F.coalesce(F.col(f"__in{len(self.id_sets) - 1}"), F.lit(False))

    def _address(self, f: Filter) -> Column | None:
        line1, city, state, zip_ = ((x or "").strip() for x in (f.line1, f.city, f.state, f.zip))
        parts = []
        if line1:
            parts.append(like(F.col("address_line_1"), line1))
        if city:
            parts.append(like(F.col("city"), city))
        if state:
            parts.append(F.col("state") == state.upper())
        if zip_:
            parts.append(F.col("zip5") == zip_)
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _registry(self) -> dict[str, int]:
        if self.catalog.elections is None:
            raise CriteriaError("this dataset has no election registry")
        return self.catalog.elections

    def _history_count(self, f: Filter) -> Column | None:
        if (f.windowYears or 0) <= 0 or f.count is None or f.count < 0:
            return None
        if f.comparator not in (">=", "="):
            raise CriteriaError(f"unknown comparator {f.comparator!r}")
        types = TYPE_ALIASES.get(f.type, (f.type,))
        year = int((self.catalog.today or "")[:4] or __import__("datetime").date.today().year)
        bits = [b for k, b in self._registry().items() if k.split("-", 1)[1] in types and int(k.split("-", 1)[0]) > year - f.windowYears]
        total = F.lit(0)
        for word, literal in words_of(bits).items():
            total = total + F.bit_count(F.col(f"election_mask_{word}").bitwiseAND(F.lit(literal)))
        return total >= f.count if f.comparator == ">=" else total == f.count

    def _history_detail(self, f: Filter) -> Column | None:
        wanted = list(f.elections or [])
        if not wanted:
            return None
        registry = self._registry()
        bits = [registry[k] for k in wanted if k in registry]
        if not bits or (f.mode == "all" and len(bits) < len(wanted)):
            return F.lit(False)
        parts = []
        for word, literal in words_of(bits).items():
            met = F.col(f"election_mask_{word}").bitwiseAND(F.lit(literal))
            parts.append(met == F.lit(literal) if f.mode == "all" else met != F.lit(0))
        return reduce((lambda a, b: a & b) if f.mode == "all" else (lambda a, b: a | b), parts)


def words_of(bits: list[int]) -> dict[int, int]:
    """64-bit words (two's complement) that have the bits set."""
    words: dict[int, int] = {}
    for b in sorted(set(bits)):
        words[b // 64] = words.get(b // 64, 0) | 1 << b % 64
    return {w: x - (1 << 64) if x >= 1 << 63 else x for w, x in words.items()}


def like(column: Column, value: str) -> Column:
    """Case-insensitive containment; % and _ in the value are wildcards, backslashes are not."""
    return column.ilike("%" + value.replace("\\", "\\\\") + "%")


def between(column: Column, low, high) -> Column | None:
    parts = ([column >= low] if low is not None else []) + ([column <= high] if high is not None else [])
    return reduce(lambda a, b: a & b, parts) if parts else None


def fold(clauses: list[tuple[str, Column]]) -> Column | None:
    """The steps' boolean; None if there is no active step."""
    current = None
    for verb, clause in clauses:
        if current is None:
            current = ~clause if verb == "remove" else clause
        elif verb == "narrow":
            current = current & clause
        elif verb == "add":
            current = current | clause
        else:
            current = current & ~clause
    return current
