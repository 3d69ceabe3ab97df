"""Absences of many items: bundles of items are one state, whatever boards they are of."""

import random
from pathlib import Path

from postflow.operators.storage import shared_folder
from postflow.streaming import events

SEEN = "key bigint, item bigint, at bigint"


def sightings(n=1500, seed=3):
    r = random.Random(seed)
    return sorted({(r.randrange(300), r.randrange(4), r.randrange(1, 24)) for _ in range(n)})


def gaps(rows):
    """(key, item, at, the next time or None, the time before or None)."""
    of = {}
    for k, i, at in rows:
        of.setdefault((k, i), []).append(at)
    return [(k, i, at, nxt, prev) for (k, i), ats in of.items() for at, nxt, prev in zip(ats, [*ats[1:], None], [None, *ats[:-1]], strict=True)]


def test_bundles_of_many_boards(spark, monkeypatch):
    rows = sightings()
    seen = spark.createDataFrame(rows[::-1] + rows[:40], SEEN).distinct().repartition(3)
    monkeypatch.setattr(events, "BUNDLE", 200)
    for forget in (None, 5):
        want = sorted((k, i, at, -1 if prev is None or (forget and at - prev - 1 >= forget) else at - prev - 1) for k, i, at, _, prev in gaps(rows))
        assert sorted(tuple(r) for r in events.missed_runs(seen, forget=forget).collect()) == want
    last = max(at for *_, at in rows)
    due = sorted((k, i, at + 3) for k, i, at, nxt, _ in gaps(rows) if (nxt or last + 1) - at - 1 >= 3)
    for parts in (1, 4):
        assert sorted(tuple(r) for r in events.retirements(seen, grace=3, parts=parts).collect()) == due


def test_the_state_is_a_value_for_each_bundle(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("state-*"))
    rows = sightings()
    assert events.missed_runs(spark.createDataFrame(rows, SEEN)).count() == len(rows)
    (state,) = set(folder.glob("state-*")) - before
    assert spark.read.format("statestore").load(str(state)).count() <= 2  # one bundle, and the closing row's


def test_nothing_was_seen(spark):
    assert events.missed_runs(spark.createDataFrame([], SEEN)).count() == 0 == events.retirements(spark.createDataFrame([], SEEN)).count()
