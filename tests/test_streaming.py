from __future__ import annotations

import json

from symloom.streaming import watch as W


def test_watching_equals_the_batch(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    rows = [("modify", "/w/a.py"), ("modify", "/w/a.py"), ("create", "/w/b.cpp.tmp"), ("modify", "/w/c.txt"), ("access", "/w/d.py"), ("remove", "/other/e.py"), ("modify", "\\w\\gen\\f.py")]
    (source / "1.json").write_text("\n".join(json.dumps({"kind": k, "path": p, "at": "2024-01-01 00:00:00"}) for k, p in rows))
    seen = []
    query = W.watch(W.file_events(spark, str(source)), "/w", ["py", "cpp"], lambda paths, burst, _: seen.append((sorted(r.path for r in paths.collect()), burst)), str(tmp_path / "cp"), ignore=["/gen/"], once=True)
    query.awaitTermination(60)
    assert seen == [(["/w/a.py", "/w/b.cpp"], False)]
    (source / "2.json").write_text("\n".join(json.dumps({"kind": "modify", "path": f"/w/x{k}.py", "at": "2024-01-01 00:00:01"}) for k in range(64)))
    W.watch(W.file_events(spark, str(source)), "/w", ["py"], lambda paths, burst, _: seen.append((paths.count(), burst)), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert seen[1:] == [(64, True)]


def test_rolling_windows(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"kind": "modify", "path": f"/w/{k}", "at": f"2024-01-01 00:00:0{k % 2}"}) for k in range(100)))
    query = W.rolling_bursts(W.file_events(spark, str(source))).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert spark.table("bursts").where("burst").count() == 4 and spark.table("bursts").agg({"n": "max"}).first()[0] == 100


def test_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "1", "level": "info", "event": "a", "message": "m", "pid": 1}\nbroken\n{"ts": "2", "level": "warn", "event": "b", "message": "n", "pid": 1}\n')
    log = W.log_lines(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 2 and [r.event for r in W.recent_entries(log, 1).collect()] == ["b"]
