"""Transactions over a table: several changes that count together or not at all, row counts, and errors that handlers catch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from procweave.operators.changes import delete_where, update_where
from procweave.sources.sinks import hadoop, shared_folder


@dataclass(frozen=True)
class Step:
    """One statement: what it makes of a table, and which of the rows it is given it changes (None: not counted)."""

    label: str
    apply: Callable[[DataFrame], DataFrame]
    hit: Column | None = None


@dataclass(frozen=True)
class Outcome:
    """The table after a transaction, the message and SQLSTATE of the error that ended it, and the row count of each counted step."""

    rows: DataFrame
    error: str | None = None
    state: str | None = None
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def committed(self) -> bool:
        return self.state is None


def update(label: str, where: Column, values: dict[str, Column]) -> Step:
    return Step(label, lambda rows: update_where(rows, where, values), where)


def delete(label: str, where: Column) -> Step:
    return Step(label, lambda rows: delete_where(rows, where), where)


def require(label: str, condition: Column, message: str) -> Step:
    """Raise the message at the first row for which the condition does not hold; null is not holding. Rows are left as they are.

    The test goes into the first column, which a later step must not throw away unread.
    """

    def checked(rows: DataFrame) -> DataFrame:
        first = rows.columns[0]
        tested = F.when(F.coalesce(condition, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message)).cast(rows.schema[first].dataType))
        return rows.withColumn(first, tested)

    return Step(label, checked)


def transact(rows: DataFrame, steps: Sequence[Step], states: tuple[str, ...] | None = None) -> Outcome:
    """Run the steps in order and write what they make of the table, as one job: BEGIN TRY, BEGIN TRAN ... COMMIT, CATCH ROLLBACK.

    If a step raises, the table is the one before and what was written goes. ``states`` are the SQLSTATEs that are handled
    (None: all that a job can raise); others go on to the caller, as do plans that are wrong before anything runs. Counts come
    from the job itself, not from a second one. They are exact where steps need no shuffle, as update, delete and require do; what
    is counted below a shuffle may count the rows of a lost task again. An empty table commits with counts of 0. Labels of
    counted steps have to differ.
    """
    if len({s.label for s in steps}) < len(steps):
        raise ValueError("labels of steps have to differ")
    after, seen = rows, {}
    for step in steps:
        if step.hit is not None:
            seen[step.label] = Observation()
            after = after.observe(seen[step.label], F.count_if(F.coalesce(step.hit, F.lit(False))).alias("n"))
        after = step.apply(after)
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "transaction")
    try:
        after.write.parquet(path)
    except PySparkException as raised:
        folder, files = hadoop(spark, path)
        files.delete(folder, True)
        state = raised.getSqlState() or "XX000"
        if states is not None and state not in states:
            raise
        # What was raised by hand has its text as a parameter; other errors tell all they know.
        return Outcome(rows, (raised.getMessageParameters() or {}).get("errorMessage") or str(raised), state)
    counts = {label: (observation.get or {}).get("n", 0) for label, observation in seen.items()}
    return Outcome(spark.read.schema(after.schema).parquet(path), counts=counts)
