"""History that arrives in drops gives the facts of one batch over all of it."""

import json

from factloom.operators.providers.history import aggregate
from factloom.streaming import refresh


def rows_of(frame):
    return {(r.rating_key, r.plays, r["last"], r.users, r.completed) for r in frame.collect()}


def test_drops_equal_batch(spark, tmp_path):
    drops = [
        [("a", 5, "u1", 1.0), ("a", 9, "u2", 0.5), ("b", 7, "u1", 0.0)],
        [("a", 4, "u1", 1.0), ("c", 3, "", 1.0)],
        [("b", 8, "u3", 1.0)],
    ]
    folder, state, marks = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "marks")
    folder.mkdir()
    for n, drop in enumerate(drops):
        (folder / f"{n}.json").write_text("\n".join(
            json.dumps({"rating_key": k, "date": d, "user": u, "watched_status": w})
            for k, d, u, w in drop))
        source = refresh.read_history(spark, str(folder))
        refresh.start(source, state, marks).awaitTermination()
        done = spark.read.schema(refresh.HISTORY_SCHEMA).json(str(folder))
        assert rows_of(refresh.totals(spark, state)) == rows_of(aggregate(done))
    changed = refresh.touched(spark, state, 2)
    assert rows_of(changed) == {("b", 2, 8, 2, 1)}

    before = rows_of(refresh.totals(spark, state))
    packed = str(tmp_path / "packed")
    refresh.compact(spark, state, packed, 1)
    assert rows_of(refresh.totals(spark, packed)) == before
    assert refresh.pairs(spark, packed).count() == 5

    # A batch that is run again replaces its own partition.
    refresh.start(refresh.read_history(spark, str(folder)), state, str(tmp_path / "m2"),
                  generation="again").awaitTermination()
    again = refresh.pairs(spark, state).filter("generation = 'again'")
    assert rows_of(refresh.per_item(again)) == before
    refresh.start(refresh.read_history(spark, str(folder)), state, str(tmp_path / "m3"),
                  generation="again").awaitTermination()
    assert rows_of(refresh.per_item(
        refresh.pairs(spark, state).filter("generation = 'again'"))) == before


def test_running_totals_equal_batch(spark, tmp_path):
    drops = [
        [("a", 5, "u1", 1.0), ("a", 9, "u2", 0.5), ("b", 7, "u1", 0.0), ("a", 1, "u1", None)],
        [("a", 4, "u1", 1.0), ("c", 3, "", 1.0), ("", 3, "u1", 1.0), ("c", None, None, 1.0)],
        [("b", 8, "u3", 1.0), ("c", 1, "u9", 0.0)],
    ]
    folder, kept, marks = tmp_path / "in", str(tmp_path / "kept"), str(tmp_path / "marks")
    folder.mkdir()
    for n, drop in enumerate(drops):
        (folder / f"{n}.json").write_text("\n".join(
            json.dumps({"rating_key": k, "date": d, "user": u, "watched_status": w})
            for k, d, u, w in drop))
        refresh.start_running(
            refresh.read_history(spark, str(folder)), kept, marks).awaitTermination()
        running = refresh.RunningTotals.open(spark, kept)
        done = spark.read.schema(refresh.HISTORY_SCHEMA).json(str(folder))
        assert rows_of(running.totals()) == rows_of(aggregate(done))
    assert {r.rating_key for r in running.touched(2).collect()} == {"b", "c"}

    # The last batch once more, as after a failure, and one without rows.
    last = spark.createDataFrame(
        [(k, d, None, u, w) for k, d, u, w in drops[-1]], refresh.HISTORY_SCHEMA)
    running.take(last, 2)
    running.take(last.limit(0), 3)
    assert rows_of(running.totals()) == rows_of(aggregate(done))
    plan = running.totals()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "pair#" not in plan
    # Stored pairs are read bucket by bucket: only the batch's own rows are dealt.
    plan = running._met(last, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 2
