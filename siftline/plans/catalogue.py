"""All named queries of the library but those of the training-data subpackage."""

from __future__ import annotations

from siftline.plans import desk_plans, event_plans, report_plans, row_plans, similarity_plans, source_plans, story_plans, text_plans

PLANS = text_plans.PLANS | similarity_plans.PLANS | report_plans.PLANS | event_plans.PLANS | story_plans.PLANS | source_plans.PLANS | desk_plans.PLANS | row_plans.PLANS
QUERIES = {name: plan for name, (plan, _) in PLANS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in PLANS.items() if sql}
