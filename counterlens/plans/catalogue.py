"""Every query of the engine by name, with its text for the checking engine where it has one."""

from __future__ import annotations

from counterlens.operators import features, relational, scoring, statistics, texts  # noqa: F401  plans register themselves
from counterlens.plans import checks, checks_effects, checks_study, extra, scores, study  # noqa: F401  calls register themselves
from counterlens.plans.oracle import oracle
from counterlens.plans.registry import CALLS, PLANS, run

QUERIES = {name: run(name) for name in PLANS} | extra.QUERIES | CALLS
ORACLE_SQL = {name: oracle(name) for name in PLANS} | extra.ORACLE_SQL | checks.ORACLE_SQL | checks_study.ORACLE_SQL | checks_effects.ORACLE_SQL
