"""Merges are invariant under order and retries; control state only goes forward."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import control
from millrace.operators import merge as M
from millrace.operators import relational as R

SCHEMA = "key string, version long, updated long, event_id string"
ORDER = ["version", "updated", "event_id"]
versions = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 2) | st.none(), st.integers(0, 1), st.sampled_from("xyz")), min_size=1, max_size=8)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=versions, seed=st.randoms())
def test_snapshot_ignores_order_and_retries(spark, data, seed):
    shuffled = list(data)
    seed.shuffle(shuffled)
    once = M.snapshot(None, spark.createDataFrame(data, SCHEMA), ["key"], ORDER)
    again = M.snapshot(M.snapshot(None, spark.createDataFrame(shuffled, SCHEMA), ["key"], ORDER), spark.createDataFrame(data, SCHEMA), ["key"], ORDER)
    assert rows(once) == rows(again)


def test_outcomes_follow_arrival_and_stored_rows(spark):
    batch = spark.createDataFrame([("a", 2, 0, "x", 1), ("a", 1, 0, "x", 2), ("a", 2, 0, "x", 3), ("a", 3, 0, "x", 4), ("b", 1, 0, "x", 5)], SCHEMA + ", at int")
    assert [r.outcome for r in M.outcomes(batch, ["key"], ORDER, "at").orderBy("at").collect()] == ["INSERTED", "STALE_IGNORED", "DUPLICATE_IGNORED", "UPDATED", "INSERTED"]
    stored = spark.createDataFrame([("b", 9, 0, "x")], SCHEMA)
    assert M.outcomes(batch, ["key"], ORDER, "at", stored).where("key = 'b'").first().outcome == "STALE_IGNORED"


def test_merge_equation(spark):
    batch = spark.createDataFrame([("a", i % 3, 0, "x", i) for i in range(9)], SCHEMA + ", at int")
    out = R.outcome_balance(M.outcomes(batch, ["key"], ORDER, "at"), "outcome", M.OUTCOMES).first()
    assert out.source == 9 and out.unexplained == 0


def test_scd2_rerun_changes_nothing(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    dim = spark.createDataFrame([(1, "A", "h1")], "k int, tier string, h string").withColumns({"effective_from": ts("2020-01-01"), "effective_to": ts(M.OPEN_END), "is_current": F.lit(True)})
    inc = spark.createDataFrame([(1, "B", "h2"), (2, "C", "h3")], "k int, tier string, h string")
    one = M.scd2(dim, inc, "k", "h", ts("2024-01-01"))
    two = M.scd2(one, inc, "k", "h", ts("2025-01-01"))
    assert rows(one) == rows(two) and one.count() == 3 and one.where("is_current").count() == 2


def test_outbox_round(spark):
    box = spark.createDataFrame([(1, "READY", 0, None, "t"), (2, "CLAIMED", 0, None, "t"), (3, "FAILED", 10, None, "t")], "outbox_event_id long, status string, attempts int, lease_until timestamp, claim_token string")
    now = F.lit("2024-01-01").cast("timestamp")
    claimed = M.claim(box, now)
    assert {r.outbox_event_id: r.status for r in claimed.collect()} == {1: "CLAIMED", 2: "CLAIMED", 3: "FAILED"}
    done = M.acknowledge(claimed, spark.createDataFrame([(1, "t")], "outbox_event_id long, claim_token string"))
    assert {r.outbox_event_id: r.status for r in M.release(done).collect()} == {1: "PUBLISHED", 2: "FAILED", 3: "FAILED"}
    with pytest.raises(ValueError):
        M.acknowledge(claimed, spark.createDataFrame([(3, "t")], "outbox_event_id long, claim_token string"))


def test_snapshot_table_skips_applied_batches(spark, tmp_path):
    t = control.SnapshotTable(spark, f"file://{tmp_path}/t")
    make = lambda n: lambda stored: spark.range(n)
    assert t.version() is None and t.replace(1, make(3)) and not t.replace(1, make(9)) and t.read().count() == 3
    assert t.replace(2, make(4)) and t.read().count() == 4


def test_checkpoints_survive_and_do_not_regress(spark, tmp_path):
    table = control.SnapshotTable(spark, f"file://{tmp_path}/c")
    store = control.CheckpointStore(table)
    store.commit("p", 5)
    with pytest.raises(ValueError):
        store.commit("p", 4)
    assert control.CheckpointStore(table).read("p") == 5


def test_incremental_run_commits_after_reconciling():
    store = control.CheckpointStore()
    with pytest.raises(ValueError, match="variance"):
        control.incremental_run("p", store, lambda: 10, lambda low, high: {"source": 3, "applied": 2})
    assert store.read("p") == 0
    assert control.incremental_run("p", store, lambda: 10, lambda low, high: {"source": 3, "applied": 2, "stale": 1}).status == "SUCCEEDED" and store.read("p") == 10


def migration_log(spark, events):
    return spark.createDataFrame([(i, *e, None, None)[:3] + (e[2] if len(e) > 2 else None, {"route": "old"} if e[1] == "CHECKPOINT" else None) for i, e in enumerate(events)], control.MIGRATION_LOG)


def test_migration_log(spark):
    events = [("a", "READY"), ("b", "MIGRATING"), ("a", "MIGRATING"), ("a", "DUAL_RUN"), ("a", "VALIDATED", False), ("a", "VALIDATED", True), ("a", "VALIDATED", True), ("a", "CHECKPOINT"), ("a", "CUTOVER"), ("a", "COMPLETE"), ("c", "VALIDATED", True), ("d", "VALIDATED", True), ("d", "VALIDATED", False)]
    log = migration_log(spark, events)
    assert [(r.workload, r.event) for r in control.migration_history(log).where("refused").collect()] == [("b", "MIGRATING")]
    assert [r.state for r in control.migration_history(log).where("workload = 'a'").orderBy("seq").collect()][-4:] == ["VALIDATING", "VALIDATING", "CUTOVER", "COMPLETE"]
    out = {r.workload: r for r in control.cutover_decision(control.migration_state(log)).collect()}
    assert out["a"].approved and out["a"].state == "COMPLETE" and out["a"].rollback == {"route": "old"} and out["a"].validations == 3
    assert out["b"].reasons == ["TWO_VALIDATIONS_REQUIRED", "ROLLBACK_CHECKPOINT_REQUIRED"] and out["c"].reasons == out["b"].reasons
    assert out["d"].reasons == ["RECENT_VALIDATION_FAILED", "ROLLBACK_CHECKPOINT_REQUIRED"]


def test_checklist_has_twenty_checks(spark):
    rows = [(1, c, True) for c in control.CUTOVER_CHECKS] + [(2, c, c != "checksums_match" or None) for c in control.CUTOVER_CHECKS] + [(3, "unknown", True)]
    out = {r.run: r for r in control.checklist(spark.createDataFrame(rows, "run int, check string, done boolean")).collect()}
    assert len(control.CUTOVER_CHECKS) == 20 and [(out[i].passed, out[i].all_passed) for i in (1, 2, 3)] == [(20, True), (19, False), (0, False)]
    assert out[2].missing == ["checksums_match"]


def test_a_commit_that_fails_leaves_the_position(spark, tmp_path, monkeypatch):
    store = control.CheckpointStore(control.SnapshotTable(spark, f"file://{tmp_path}/c"))
    store.commit("p", 5)
    monkeypatch.setattr(control.SnapshotTable, "replace", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.commit("p", 9)
    assert store.read("p") == 5


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(st.floats(-1e300, 1e300) | st.integers(-3, 3).map(float) | st.none(), min_size=1, max_size=60))
def test_order_statistics_are_exact(spark, data):
    kept = sorted(x for x in data if x is not None)
    df = spark.createDataFrame([(x,) for x in data], "x double")
    ranks = sorted({0, len(kept) // 3, len(kept) - 1}) if kept else []
    assert not kept or R.order_statistics(df, "x", ranks) == [kept[r] for r in ranks]


def test_order_statistics_of_narrow_and_odd_numbers(spark):
    xs = [0.0, 5e-324, 1e-323, 1.0, 1.0 + 2**-52, float("nan"), float("inf"), None]
    assert R.order_statistics(spark.createDataFrame([(x,) for x in xs], "x double"), "x", range(5)) == xs[:5]


def test_dag_skips_what_needs_a_failure():
    def fail():
        raise RuntimeError

    assert control.run_dag({"a": int, "b": fail, "c": int, "d": int}, {"c": ("a",), "d": ("b",)}) == {"a": "SUCCEEDED", "b": "FAILED", "c": "SUCCEEDED", "d": "SKIPPED"}
    with pytest.raises(ValueError):
        control.run_dag({"a": int, "b": int}, {"a": ("b",), "b": ("a",)})


def test_explained_quarantine_balances(spark):
    money = lambda n: spark.range(n).select(F.lit(10).cast("decimal(18,2)").alias("v"))
    row = R.reconcile(money(100), money(97), "v", 3, 30).first()
    assert row.balanced and row.unexplained_count_delta == 0
    with pytest.raises(ValueError):
        R.assert_balanced(R.reconcile(money(100), money(97), "v"))


def test_checksum_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert R.checksum(a, ["k", "v"]).first() == R.checksum(a.orderBy(F.desc("k")).repartition(3), ["k", "v"]).first()
    assert R.checksum(a, ["k", "v"]).first() != R.checksum(a.union(a.limit(1)), ["k", "v"]).first()


def test_quantile_and_drift_edges(spark):
    from statistics import quantiles

    xs = [float((i * 37) % 101) for i in range(100)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert R.exclusive_quantile(df, "x", 95, 100).first().quantile == pytest.approx(quantiles(xs, n=100)[94])
    assert R.psi(df, df, "x").first().psi == pytest.approx(0.0) and R.psi(df.limit(0), df, "x").first().psi == float("inf")
    assert R.psi(df.select(F.lit(1.0).alias("x")), df, "x").first().psi == 0.0
