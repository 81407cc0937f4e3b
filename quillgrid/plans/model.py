"""The query-plan language: what a plan may say, checked before any job starts."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from quillgrid.errors import PlanError

# --- Fixed values: the vocabulary, the size of a top list without one, pairs a correlation needs ------------------------------
OPERATIONS = ("aggregate", "top_n", "trend", "compare_periods", "describe", "correlate", "filter_rows")
AGGREGATES = ("sum", "mean", "median", "min", "max", "count", "nunique")
FILTERS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "between", "contains")
FREQUENCIES = ("D", "W", "ME")
TOP_ROWS = 10
MIN_PAIRS = 3
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any
    literal: bool = False  # for contains: take the text as it is, not as a pattern


@dataclass(frozen=True)
class Metric:
    column: str
    agg: str = "sum"

    @property
    def name(self) -> str:
        return f"{self.agg}_{self.column}"


@dataclass(frozen=True)
class QueryPlan:
    operation: str
    metrics: Sequence[Metric] = ()
    group_by: Sequence[str] = ()
    filters: Sequence[Filter] = ()
    date_column: str | None = None
    frequency: str | None = None
    period_a: Sequence[str] | None = None  # [from, to], ISO dates
    period_b: Sequence[str] | None = None
    columns: Sequence[str] = ()
    sort_desc: bool = True
    limit: int | None = None  # None: all rows, but TOP_ROWS of a top list

    @classmethod
    def from_dict(cls, raw: dict) -> "QueryPlan":
        raw = dict(raw)
        raw["metrics"] = [Metric(**m) for m in raw.get("metrics", ())]
        raw["filters"] = [Filter(**f) for f in raw.get("filters", ())]
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in raw.items() if k in known})

    def check(self, columns: Sequence[str]) -> None:
        """Raise PlanError for anything that cannot run on a table with these columns."""
        problems: list[str] = []

        def need(ok: Any, problem: str) -> None:
            if not ok:
                problems.append(problem)

        need(self.operation in OPERATIONS, f"unknown operation {self.operation!r}")
        need(self.limit is None or self.limit >= 1, "limit must be at least 1")
        need(self.frequency in (None, *FREQUENCIES), f"unknown frequency {self.frequency!r}")
        for m in self.metrics:
            need(m.agg in AGGREGATES, f"unknown aggregate {m.agg!r}")
        for f in self.filters:
            need(f.op in FILTERS, f"unknown filter {f.op!r}")
            pair = isinstance(f.value, (list, tuple)) and len(f.value) == 2
            need(f.op != "between" or pair, "between needs [low, high]")
        used = [m.column for m in self.metrics] + list(self.group_by) + list(self.columns)
        used += [f.column for f in self.filters]
        used += [self.date_column] if self.date_column else []
        missing = [c for c in used if c not in set(columns)]
        need(not missing, f"unknown columns: {missing}")

        if self.operation in ("aggregate", "top_n"):
            need(self.metrics, "aggregate needs at least one metric")
        if self.operation in ("trend", "compare_periods"):
            need(self.metrics and self.date_column, f"{self.operation} needs a date column and a metric")
        if self.operation == "compare_periods":
            periods = [p is not None and len(p) == 2 for p in (self.period_a, self.period_b)]
            need(all(periods), "compare_periods needs period_a and period_b as [from, to]")
        if self.operation == "describe":
            need(self.columns or self.metrics, "describe needs columns")
        if self.operation == "correlate":
            need(len(self.columns) == 2, "correlate needs exactly two columns")
        if problems:
            raise PlanError("; ".join(problems))


@dataclass
class PlanResult:
    """Result rows and a one-row summary, both lazy."""

    rows: Any
    summary: Any = None
    notes: dict = field(default_factory=dict)
