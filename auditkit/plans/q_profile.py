"""Queries: histogram profiles over the feature matrix."""

from __future__ import annotations

from auditkit.operators import profile
from auditkit.plans.registry import query
from auditkit.plans.views import TRAIN_VINTAGES


@query("agg_08_coverage", "SELECT * FROM coverage", ("coverage",))
def coverage(v):
    return profile.coverage(v.hist())


@query("agg_10_univariate", "SELECT * FROM univariate", ("univariate",))
def univariate(v):
    return profile.univariate(v.hist(), TRAIN_VINTAGES)
