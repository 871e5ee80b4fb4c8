"""Prepares a session for operators in Python: sends this package's code to the executors, and bounds the batches that workers hold."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes in an Arrow batch, and rows that a Parquet reader decodes at a time, where the session has Spark's defaults: batches of long
#: texts must fit small workers and executors.
BATCH_BYTES = 4 << 20
READ_ROWS = 512
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the context's Python files, once for each context, and lowers the session's batches to BATCH_BYTES and READ_ROWS."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) in (None, "-1", "67108864b"):
        spark.conf.set(limit, BATCH_BYTES)
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(rows, None) in (None, "4096"):
        spark.conf.set(rows, READ_ROWS)
    context = spark.sparkContext
    key = f"{context.applicationId}"
    if key in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="joinwright-code-")) / "joinwright_code.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(name))
    _sent.add(key)
