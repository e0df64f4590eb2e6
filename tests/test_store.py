"""Versions of snapshots: what a crash leaves, what gates see, and plans without shuffles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import report, snapshot
from tidemark.plans import store


def table(spark, *keys):
    return spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "key string, titulo string")


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / "store")


def test_a_crash_at_any_step_leaves_the_old_version(spark, base, monkeypatch):
    assert store.current(spark, base) == ("", {})
    old, new = {"lots": table(spark, "a", "b")}, {"lots": table(spark, "b", "c", "d")}
    assert store.commit(spark, old, {"lots": "key"}, base, "v1", buckets=4)[0]
    put, steps = store._put, []

    def crash_at(step):
        def failing(*args):
            steps.append(args[1].rpartition("/")[2])
            if len(steps) == step:
                raise OSError("crash")
            put(*args)

        steps.clear()
        monkeypatch.setattr(store, "_put", failing)

    listed = lambda: sorted(r["key"] for r in store.current(spark, base)[1]["lots"].collect())
    for step in (1, 2):
        crash_at(step)
        with pytest.raises(OSError, match="crash"):
            store.commit(spark, new, {"lots": "key"}, base, "v2", buckets=4)
        assert store.current(spark, base)[0] == "v1" and listed() == ["a", "b"]
    crash_at(0)
    assert store.commit(spark, new, {"lots": "key"}, base, "v2", buckets=4)[0]
    assert steps == ["manifest.json", "CURRENT"] and store.current(spark, base)[0] == "v2" and listed() == ["b", "c", "d"]
    assert store.commit(spark, old, {"lots": "key"}, base, "v3", buckets=4)[0] and store.prune(spark, base) == ["v1"] and listed() == ["a", "b"]


def test_gates_see_what_was_written(spark, base):
    lots, events = table(spark, *"abc"), table(spark, "x")
    metrics = {"lots": {"carried": F.count_if(F.col("key") == "b")}}
    asked = []

    def gate(seen):
        asked.append(seen)
        n = {k: F.lit(v) for k, v in seen["lots"].items()}
        return spark.range(1).select(report.lot_gate(F.lit(True), n["rows"], n["rows"], n["rows"], F.lit(0), n["rows"], n["carried"])).first()[0]

    done, fault, seen = store.commit(spark, {"lots": lots, "events": events}, {"lots": "key", "events": "key"}, base, "v1", gate=gate, metrics=metrics, buckets=2)
    assert (done, fault) == (False, "few_lots") and asked == [{"lots": {"rows": 3, "carried": 1}, "events": {"rows": 1}}] == [seen]
    assert store.current(spark, base) == ("", {})


def test_versions_are_compared_without_a_shuffle(spark, base):
    before, after = table(spark, *"aabbc", ""), table(spark, *"bcdd", "", "e")
    assert store.commit(spark, {"lots": before}, {"lots": "key"}, base, "v1", buckets=4)[0]
    first = store.current(spark, base)[1]["lots"]
    assert store.commit(spark, {"lots": after}, {"lots": "key"}, base, "v2", buckets=4)[0]
    second = store.current(spark, base)[1]["lots"]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        diff = store.compare(first, second)
        assert tuple(diff.first()) == tuple(snapshot.diff_counts(before, after).first()) == (6, 6, 2, 1)
        plan = diff._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and plan.count("Exchange") <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_tampered_versions_are_refused(spark, base, tmp_path):
    assert store.commit(spark, {"lots": table(spark, *"abc")}, {"lots": "key"}, base, "v1", buckets=2)[0]
    part = next((tmp_path / "store/v1/lots").glob("part-*"))
    content = part.read_bytes()
    part.unlink()
    with pytest.raises(ValueError, match="files of lots differ"):
        store.current(spark, base)
    part.write_bytes(content)
    assert store.current(spark, base)[1]["lots"].count() == 3
    store._put(spark, f"{base}/v1/manifest.json", "{}")
    with pytest.raises(ValueError, match="not the one"):
        store.current(spark, base)


def test_empty_tables_are_versions_too(spark, base):
    assert store.commit(spark, {"lots": table(spark).limit(0)}, {"lots": "key"}, base, "v1", buckets=2) == (True, "", {"lots": {"rows": 0}})
    lots = store.current(spark, base)[1]["lots"]
    assert lots.count() == 0 and tuple(store.compare(lots, table(spark, "a")).first()) == (0, 1, 1, 0)
