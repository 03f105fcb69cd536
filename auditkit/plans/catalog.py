"""All registered queries."""

from auditkit.plans import q_aggregates, q_columns, q_functions, q_joins, q_models, q_profile, q_runs, q_scoring, q_search, q_sources, q_validate, q_windows  # noqa: F401
from auditkit.plans.registry import QUERIES, oracles  # noqa: F401
