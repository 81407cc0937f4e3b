"""First plans to try on a profiled table; each appears only if its roles exist."""

from quillgrid.operators.profile import TableProfile
from quillgrid.operators.roles import rank_dimensions, rank_metrics
from quillgrid.plans.model import Metric, QueryPlan

#: How many metrics, dimensions and dates a plan needs, and the plan from their names.
STARTERS = (
    ((1, 1, 0), lambda m, k, d: QueryPlan("top_n", [Metric(m[0])], group_by=k[:1])),
    ((1, 0, 1), lambda m, k, d: QueryPlan("trend", [Metric(m[0])], date_column=d[0])),
    ((2, 0, 0), lambda m, k, d: QueryPlan("correlate", columns=m[:2])),
    ((1, 0, 0), lambda m, k, d: QueryPlan("aggregate", [Metric(m[0], "mean")])),
)


def starter_plans(profile: TableProfile) -> list[QueryPlan]:
    roles = rank_metrics(profile), rank_dimensions(profile), [c.name for c in profile.of_type("datetime")]
    return [plan(*roles) for needs, plan in STARTERS if all(len(r) >= n for r, n in zip(roles, needs))]
