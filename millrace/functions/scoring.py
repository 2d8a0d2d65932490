"""Scores and classifications of workloads, work items, signals, costs and drift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points by criticality, others as HIGH; bonus by priority, others none.
CRITICALITY = {"LOW": 1, "MEDIUM": 3, "HIGH": 5, "CRITICAL": 8}
PRIORITY_BONUS = {"P0": 15.0, "P1": 10.0, "P2": 5.0, "P3": 0.0}


def _mapped(c: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def risk_score(criticality: Column, pii: Column, daily_rows: Column, sla_minutes: Column, dependencies: Column) -> Column:
    """Criticality, personal data, volume, deadline and up to four dependencies."""
    volume = F.when(daily_rows > 100_000_000, 3).when(daily_rows > 1_000_000, 2).otherwise(0)
    deadline = F.when(sla_minutes <= 5, 2).when(sla_minutes <= 30, 1).otherwise(0)
    return _mapped(criticality, CRITICALITY, 5) + F.when(pii, 3).otherwise(0) + volume + deadline + F.least(F.lit(4), dependencies)


def migration_pattern(sla_minutes: Column, daily_rows: Column, platform: Column) -> Column:
    return (
        F.when(sla_minutes <= 5, "EVENT_DRIVEN_DUAL_RUN").when(daily_rows > 50_000_000, "BULK_INCREMENTAL_PARALLEL")
        .when(platform.startswith("DB2"), "BOUNDED_WATERMARK_BATCH").otherwise("BATCH_INCREMENTAL_RECONCILED")
    )


def work_item_score(value: Column, risk: Column, urgency: Column, effort_hours: Column, due_days: Column, blockers: Column, downstream: Column, priority: Column) -> Column:
    """Weighted value plus dependencies, nearness of the due date (null: none) and priority, less effort; two digits, half to even."""
    dependency = F.least(F.lit(10.0), downstream * 1.5 + blockers * 2.0)
    due = F.when(due_days.isNull(), 0.0).when(due_days <= 0, 10.0).otherwise(F.greatest(F.lit(0.0), 10.0 - due_days * 0.5))
    effort = F.least(F.lit(20.0), effort_hours / 8.0)
    total = value * 0.35 + risk * 0.30 + urgency * 0.20 + dependency + due + _mapped(priority, PRIORITY_BONUS, 0.0) - effort
    return F.bround(total, 2)


def breached(value: Column, threshold: Column, direction: Column) -> Column:
    return F.when(direction == "MAX", value > threshold).otherwise(value < threshold)


def signal_priority(value: Column, threshold: Column) -> Column:
    severity = F.abs(value - threshold) / F.greatest(F.abs(threshold), F.lit(1e-9))
    return F.least(F.lit(100.0), 50 + severity * 50)


def signal_rationale(value: Column, threshold: Column, direction: Column) -> Column:
    return F.format_string("Observed %.4f against %s threshold %.4f.", value, direction, threshold)


def finops(cost: Column, utilisation: Column, p95: Column, slo: Column) -> Column:
    """Struct of action, savings and risk; null where nothing is recommended. The first rule that holds wins."""
    advice = lambda action, share, risk: F.struct(F.lit(action).alias("action"), (cost * share).alias("savings"), F.lit(risk).alias("risk"))
    return (
        F.when((utilisation < 15) & (p95 < slo * 0.5), advice("RIGHTSIZE", 0.25, "LOW"))
        .when(utilisation < 5, advice("SCHEDULE_OR_SCALE_TO_ZERO", 0.50, "MEDIUM"))
        .when(p95 > slo, advice("PERFORMANCE_FIRST_NO_COST_CUT", 0.0, "HIGH"))
    )


def drift_class(psi: Column) -> Column:
    return F.when(psi < 0.10, "PASS").when(psi < 0.25, "REVIEW").otherwise("BLOCK")


def guest_features(columns: list[str]) -> dict[str, Column]:
    """The derived features, given the names that are there; a missing one is an error. Nulls count as 0."""
    if missing := sorted(set(FEATURES) - set(columns)):
        raise ValueError(f"Missing feature columns: {missing}")
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in FEATURES}
    return filled | {
        "engagement_intensity": filled["gaming_sessions_30d"] + filled["mobile_sessions_30d"] * 0.25 + filled["offer_views_30d"] * 0.10,
        "cross_domain_value": filled["coin_in_30d"] + filled["room_revenue_90d"],
    }


#: The features of guest value.
FEATURES = (
    "days_since_last_visit", "gaming_sessions_30d", "coin_in_30d", "actual_win_30d", "hotel_nights_90d",
    "room_revenue_90d", "reward_redemptions_90d", "mobile_sessions_30d", "offer_views_30d",
)
