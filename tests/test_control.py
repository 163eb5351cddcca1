"""Operations and effects against the rules one by one, however the log is cut."""

import random

import pytest

from quarry.operators import automaton, effects

SCHEMA = "operation_id long, ts long, event_id long, action string, epoch long, kind string, unknown boolean"


def plain(rows):
    """Outcomes by going through each operation's commands in order."""
    state, out = {}, []
    for op, _, event, action, epoch, kind, unknown in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        status, pending, current, revision = state.get(op, ("none", False, 0, -1))
        if status != "none" and action != "admit" and kind == "process_flow" and action not in automaton.FLOW_ACTIONS:
            outcome = "not_owned"
        elif status != "none" and action != "admit" and epoch != current:
            outcome = "stale"
        else:
            status, pending, new, outcome = automaton.rule(action, kind, bool(unknown), status, pending)
            current, revision = current + new, revision + (outcome == "applied")
        state[op] = (status, pending, current, revision)
        out.append((op, event, action, outcome, status, current, revision))
    return sorted(out)


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7), (3, 40), (4, 3)])
def test_control_against_going_through(spark, seed, parts):
    """One operation has a third of all commands; with 40 cuts it lies in many partitions."""
    rnd = random.Random(seed)
    actions = ["start", "fail", "retry", "request_cancel", "confirm_cancel", "succeed", "pause", "resume", "request_reconcile", "deliver", "admit", "nonsense"]
    kinds = ["process_flow", "ingest_cleanup", "qualification"]
    rows = []
    for i in range(900):
        op = 7 if i % 3 == 0 else rnd.randrange(30)
        action = "admit" if rnd.random() < 0.08 else rnd.choice(actions)
        rows.append((op, rnd.randrange(300), i, action, rnd.choice([1, 1, 1, 2, 2, 3, 4, 5]), kinds[op % 3], rnd.random() < 0.2))
    got = sorted(tuple(r) for r in automaton.control(spark.createDataFrame(rows, SCHEMA), parts).collect())
    assert got == plain(rows)


def outcomes(spark, commands, kind="qualification"):
    rows = [(1, i, i, *(c if len(c) == 3 else (*c, False))) for i, c in enumerate(commands)]
    df = spark.createDataFrame([(o, t, e, a, ep, kind, u) for o, t, e, a, ep, u in rows], SCHEMA)
    return [(r["outcome"], r["status"], r["epoch"], r["revision"]) for r in sorted(automaton.control(df, 2).collect(), key=lambda r: r["event_id"])]


def test_retry_begins_an_attempt_and_fences_the_old_one(spark):
    got = outcomes(spark, [("start", 1), ("admit", 0), ("start", 1), ("start", 1), ("fail", 1), ("retry", 1), ("fail", 1), ("start", 2)])
    assert got == [("not_found", "none", 0, -1), ("applied", "queued", 1, 0), ("applied", "running", 1, 1), ("unchanged", "running", 1, 1), ("applied", "failed", 1, 2), ("applied", "queued", 2, 3), ("stale", "queued", 2, 3), ("applied", "running", 2, 4)]


def test_cancelling_waits_for_what_is_unknown(spark):
    got = outcomes(spark, [("admit", 0), ("start", 1), ("request_cancel", 1), ("confirm_cancel", 1, True), ("confirm_cancel", 1), ("start", 1), ("retry", 1)])
    assert [g[0] for g in got] == ["applied", "applied", "applied", "unreconciled", "applied", "refused", "refused"]
    assert outcomes(spark, [("admit", 0), ("request_cancel", 1), ("confirm_cancel", 1), ("retry", 1)], "ingest_cleanup")[-1] == ("applied", "queued", 2, 3)


def test_requests_to_reconcile_are_one_while_pending(spark):
    got = outcomes(spark, [("admit", 0), ("request_reconcile", 1), ("request_reconcile", 1), ("deliver", 1), ("request_reconcile", 1), ("fail", 1), ("retry", 1), ("request_reconcile", 2)], "ingest_samples")
    assert [(g[0], g[3]) for g in got] == [("applied", 0), ("applied", 1), ("unchanged", 1), ("applied", 2), ("applied", 3), ("applied", 4), ("applied", 5), ("applied", 6)]
    assert outcomes(spark, [("admit", 0), ("request_reconcile", 1)])[-1][0] == "refused"


def test_flows_pause_and_resume(spark):
    got = outcomes(spark, [("admit", 0), ("start", 1), ("pause", 1, True), ("resume", 1), ("start", 1), ("resume", 1), ("start", 2), ("fail", 2, True), ("retry", 2, True), ("retry", 2), ("confirm_cancel", 3), ("request_cancel", 3)], "process_flow")
    assert [g[:2] for g in got] == [("applied", "queued"), ("applied", "running"), ("applied", "pause_requested"), ("refused", "pause_requested"), ("applied", "paused"), ("applied", "queued"), ("applied", "running"), ("applied", "reconciliation_needed"), ("refused", "reconciliation_needed"), ("applied", "queued"), ("not_owned", "queued"), ("applied", "cancelled")]


def test_odd_logs(spark):
    rows = [(1, 0, 0, "admit", None, None, None), (1, 1, 1, None, 1, None, None), (1, 2, 2, "start", None, None, None), (None, 0, 3, "admit", 1, "x", True), (2, 0, 4, "start", 0, "x", False), (1, 2, 2, "start", 1, None, None)]
    got = sorted((r["operation_id"], r["event_id"], r["outcome"]) for r in automaton.control(spark.createDataFrame(rows, SCHEMA), 5).collect())
    assert got == [(1, 0, "applied"), (1, 1, "refused"), (1, 2, "applied"), (1, 2, "stale"), (2, 4, "not_found")]
    assert automaton.control(spark.createDataFrame([], SCHEMA), 2).count() == 0


STEPS = "operation_id long, effect_key string, ts long, event_id long, step string, epoch long, dispatch string, request string, result string, expected_revision long, op_status string, op_epoch long"


def lived(spark, steps):
    base = {"epoch": 1, "dispatch": "d", "request": "q", "result": None, "expected_revision": None, "op_status": "running", "op_epoch": 1}
    rows = [(1, "k", i, i, s, *(base | more).values()) for i, (s, more) in enumerate(steps)]
    df = effects.lives(spark.createDataFrame(rows, STEPS))
    return [(r["outcome"], r["status"], r["revision"], r["unknown_change"]) for r in sorted(df.collect(), key=lambda r: r["event_id"])]


def test_success_outlives_its_attempt(spark):
    got = lived(spark, [("prepare", {}), ("begin", {}), ("begin", {}), ("complete", {"result": "a"}), ("complete", {"result": "a"}), ("complete", {"result": "b"}), ("prepare", {"epoch": 2, "op_epoch": 2}), ("begin", {"epoch": 2, "op_epoch": 2}), ("prepare", {"epoch": 2, "op_epoch": 2, "request": "other"}), ("complete", {"result": "a", "op_epoch": 2})])
    assert [g[0] for g in got] == ["applied", "applied", "dispatched", "applied", "unchanged", "conflict", "reused", "dispatched", "conflict", "stale"]
    assert [g[3] for g in got] == [0, 1, 0, -1, 0, 0, 0, 0, 0, 0]


def test_what_is_unknown_is_reconciled_before_it_begins_again(spark):
    later = {"epoch": 2, "op_epoch": 2}
    got = lived(spark, [("begin", {}), ("prepare", {"op_status": "queued"}), ("prepare", {}), ("begin", {}), ("begin", later), ("complete", {"result": "a"} | later), ("reconcile", {"expected_revision": 0} | later), ("reconcile", {"expected_revision": 1} | later), ("begin", {"dispatch": "e"} | later), ("complete", {"result": "a"} | later), ("complete", {"result": "a", "dispatch": "e", "op_status": "failed"} | later), ("reconcile", {"expected_revision": 3, "result": "a"} | later), ("other", {})])
    assert [g[:2] for g in got] == [("not_found", None), ("refused", None), ("applied", "prepared"), ("applied", "unknown"), ("dispatched", "unknown"), ("stale", "unknown"), ("stale", "unknown"), ("applied", "prepared"), ("applied", "unknown"), ("stale", "unknown"), ("unreconciled", "unknown"), ("applied", "succeeded"), ("refused", "succeeded")]


def test_folds_in_chunks_agree(spark):
    """An operation's state doesn't depend on where its log is cut."""
    import datetime as dt

    from quarry.operators import events

    rnd = random.Random(8)
    rows = [(0 if i % 3 == 0 else rnd.randrange(9), i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(500)), rnd.choice(["queued", "running", "effect_completed", "failed", "succeeded", "other"])) for i in range(400)]
    log = spark.createDataFrame(rows, "operation_id long, event_id long, ts timestamp, event_type string")
    whole = sorted(tuple(r) for r in events.fold_states(log).collect())
    assert whole == sorted(tuple(r) for r in events.fold_states(log, 3).collect()) == sorted(tuple(r) for r in events.fold_states(log, 1).collect())
    want = {}
    for op, _, _, kind in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        state, applied, refused = want.get(op, ("new", 0, 0))
        sources, to = events.TRANSITIONS.get(kind, ((), ""))
        want[op] = (to, applied + 1, refused) if state in sources else (state, applied, refused + 1)
    assert whole == sorted((op, *x) for op, x in want.items())
