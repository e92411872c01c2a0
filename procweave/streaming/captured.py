"""What a run prints as a log that streams read while it goes on, and a poller that looks at it until the run is over."""

from __future__ import annotations

import contextlib
import io
import json
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from procweave.sources.sinks import hadoop

CAPTURED = "run_id long, entry_id long, stage string, message string, at timestamp"

#: Entries of a segment are numbered from its own number times this.
SPAN = 1_000_000


class Captured(io.TextIOBase):
    """A text stream whose lines become segments of a run's log, each made under a hidden name and renamed when it is whole.

    A segment is made after ``lines_each`` lines, on ``flush``, and on ``close``, which also takes a last line without its end.
    ``stage`` may be set between lines. Numbering goes on after the segments that the run's log already has. Lines are
    written also to ``echo``. One writer a run.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: int, stage: str = "unknown", lines_each: int = 1000, echo: io.TextIOBase | None = None) -> None:
        self.held, self.open, self.lock = [], "", threading.RLock()
        if not 0 < lines_each <= SPAN:
            raise ValueError(f"lines_each is 1 to {SPAN}")
        self.spark, self.folder, self.run_id, self.stage, self.lines_each, self.echo = spark, folder.rstrip("/"), run_id, stage, lines_each, echo
        root, files = hadoop(spark, self.folder)
        have = files.listStatus(root) if files.exists(root) else []
        own = [f.getPath().getName() for f in have if f.getPath().getName().startswith(f"run{run_id}-")]
        self.segment = max((int(n.rsplit("-", 1)[1].removesuffix(".json")) + 1 for n in own), default=0)

    def writable(self) -> bool:
        return True

    def write(self, text: str) -> int:
        if self.echo is not None:
            self.echo.write(text)
        with self.lock:
            *whole, self.open = (self.open + text).split("\n")
            for line in whole:
                self._take(line)
        return len(text)

    def _take(self, line: str) -> None:
        self.held.append({"stage": self.stage, "message": line, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())})
        if len(self.held) >= self.lines_each:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            if not self.held:
                return
            rows = [json.dumps({"run_id": self.run_id, "entry_id": self.segment * SPAN + i, **e}) for i, e in enumerate(self.held)]
            hidden, files = hadoop(self.spark, f"{self.folder}/_{uuid.uuid4().hex}")
            out = files.create(hidden, False)
            out.write(bytearray("\n".join(rows) + "\n", "utf-8"))
            out.close()
            final, _ = hadoop(self.spark, f"{self.folder}/run{self.run_id}-{self.segment:010d}.json")
            if not files.rename(hidden, final):
                raise OSError(f"could not make {final}")
            self.held, self.segment = [], self.segment + 1

    def close(self) -> None:
        if not self.closed:
            with self.lock:
                if self.open:
                    self._take(self.open)
                    self.open = ""
                self.flush()
        super().close()


@contextlib.contextmanager
def captured_output(spark: SparkSession, folder: str, run_id: int, stage: str = "unknown", **options):
    """All that is printed inside goes into the run's log, whatever ends the block. Threads of one process share what they print to:
    runs beside each other print to a ``Captured`` of their own (``print(..., file=log)``)."""
    with Captured(spark, folder, run_id, stage, **options) as log, contextlib.redirect_stdout(log):
        yield log


def read_captured(spark: SparkSession, folder: str, files_each: int = 1000) -> DataFrame:
    """The logs of all runs of a folder as a stream; its offsets are the segments that were read."""
    root, files = hadoop(spark, folder)
    files.mkdirs(root)
    return spark.readStream.schema(CAPTURED).option("maxFilesPerTrigger", files_each).json(folder)


def poll(stream: DataFrame, path: str, checkpoint: str, done: Column, seconds: float = 2, patience: float | None = None) -> bool:
    """Look every few seconds at what came, append it to a folder, and stop once an entry says that the run is over.

    True if one did; False if ``patience`` seconds went by first, and the next call goes on from there. If the folder already has
    such an entry, nothing is started. A batch that runs again replaces its own folder. Errors of the stream are raised.
    """
    spark, over = stream.sparkSession, threading.Event()
    root, files = hadoop(spark, path)
    if files.exists(root) and not spark.read.schema(stream.schema).parquet(path).filter(done).isEmpty():
        return True

    def look(batch: DataFrame, number: int) -> None:
        part = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(part)
        if not batch.sparkSession.read.schema(batch.schema).parquet(part).filter(done).isEmpty():
            over.set()

    running = stream.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
    until = None if patience is None else time.monotonic() + patience
    try:
        while not over.wait(0.1):
            if running.awaitTermination(0.1) or (until is not None and time.monotonic() > until):
                break
    finally:
        running.stop()
    return over.is_set()
