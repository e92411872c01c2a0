"""Captured output: whole segments, numbering over restarts, and pollers that miss nothing and see nothing twice."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from procweave.streaming import captured as c
from procweave.streaming import logs
from procweave.streaming.logs import classified


def test_lines_come_back_with_stage_and_level(spark, tmp_path, capsys):
    with pytest.raises(RuntimeError), c.captured_output(spark, str(tmp_path), 7, "parse", lines_each=2) as log:
        print("read 5 files\n\nfile x FAILED")
        log.stage = "plan"
        print("SKIP y é z")
        print("no end", end="")
        raise RuntimeError
    print("outside")
    assert capsys.readouterr().out == "outside\n"
    rows = spark.read.schema(c.CAPTURED).json(str(tmp_path))
    assert [tuple(r) for r in classified(rows).orderBy("entry_id").select("run_id", "stage", "message", "level").collect()] == [
        (7, "parse", "read 5 files", "info"), (7, "parse", "file x FAILED", "error"), (7, "plan", "SKIP y é z", "warning"), (7, "plan", "no end", "info"),
    ]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]


def test_numbers_go_on_and_runs_stay_apart(spark, tmp_path):
    for part in range(3):
        with c.Captured(spark, str(tmp_path), 1) as log:
            print(f"part {part}", file=log)
    with c.Captured(spark, str(tmp_path), 11) as log:
        print("other", file=log)
    with c.Captured(spark, str(tmp_path), 12):
        pass
    got = spark.read.schema(c.CAPTURED).json(str(tmp_path)).orderBy("run_id", "entry_id").collect()
    assert [(r["run_id"], r["entry_id"], r["message"]) for r in got] == [(1, 0, "part 0"), (1, c.SPAN, "part 1"), (1, 2 * c.SPAN, "part 2"), (11, 0, "other")]
    with pytest.raises(ValueError, match="lines_each"):
        c.Captured(spark, str(tmp_path), 1, lines_each=0)


def test_a_poller_sees_each_entry_once_over_restarts(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("log", "seen", "mark"))
    done = F.col("message") == "all done"
    stream = c.read_captured(spark, folder)
    log = c.Captured(spark, folder, 3)
    print("first", file=log, flush=True)
    # The run goes on after this poller has lost its patience.
    assert c.poll(stream, out, mark, done, seconds=0.2, patience=6) is False

    def work():
        for n in range(5):
            print(f"step {n}", file=log, flush=True)
            time.sleep(0.4)
        print("all done", file=log, flush=True)

    worker = threading.Thread(target=work)
    worker.start()
    assert c.poll(stream, out, mark, done, seconds=0.2, patience=60) is True
    worker.join()
    seen = [r["message"] for r in spark.read.schema(c.CAPTURED).parquet(out).orderBy("entry_id").collect()]
    assert seen == ["first", *[f"step {n}" for n in range(5)], "all done"]
    # Over is over: the next poller knows it from what was seen.
    assert c.poll(stream, out, mark, done, patience=0) is True


def test_counts_are_updated_and_late_entries_left_out(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "counts", "mark"))
    parts = [
        [(1, "2024-01-01 00:10:00", "view"), (2, "2024-01-01 00:50:00", "view"), (3, "2024-01-01 00:55:00", "error")],
        [(4, "2024-01-01 00:59:00", "view"), (5, "2024-01-01 03:00:00", "view")],
        # The watermark is at 02:50 now: the first is too late, the second is not.
        [(6, "2024-01-01 00:59:30", "view"), (7, "2024-01-01 02:55:00", "view")],
    ]
    for part in parts:
        df = spark.createDataFrame([(i, at, 1, kind, 0.0, None) for i, at, kind in part], logs.LOG_SCHEMA.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
        df.write.mode("append").parquet(log)
        logs.append_counts(logs.windowed_counts(logs.read_log(spark, log)), out, mark).awaitTermination()
    got = {(str(r["since"]), r["event_type"]): r["n"] for r in logs.counts_so_far(spark, out).collect()}
    assert got == {("2024-01-01 00:00:00", "view"): 3, ("2024-01-01 00:00:00", "error"): 1, ("2024-01-01 03:00:00", "view"): 1, ("2024-01-01 02:00:00", "view"): 1}
