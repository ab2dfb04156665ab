"""Bounded Arrow batches for operators that send whole texts to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch. Texts differ in length by orders of magnitude, so rows alone bound nothing.
ROWS, BYTES = 1_000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``ROWS`` rows and about ``BYTES`` bytes, if they are larger.

    A batch is held by the JVM, by the pipe and by the Python worker at the same time. Settings are read when
    a job starts, so the lower bound stays set for the lazy result.
    """
    for key, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
