"""Fixed-width binary relations: little-endian unsigned 64-bit key and row id, then payload bytes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _record(width: int):
    import numpy as np

    if width < 16:
        raise ValueError("a record has at least 16 bytes")
    return np.dtype([("key", "<u8"), ("row_id", "<u8")] + ([("payload", f"V{width - 16}")] if width > 16 else []))


def read_fixed(spark: SparkSession, path: str, width: int = 16) -> DataFrame:
    """Files of ``width``-byte records as key, row_id and, beyond 16 bytes, payload.

    Files of any size are split at records and read by the JVM; Python only reinterprets whole Arrow batches.
    A file that ends inside a record raises, and so do ids of 2^63 and more.
    """
    kind = _record(width)
    payload = width > 16

    def decode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(0)
            offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
            rows = np.frombuffer(column.buffers()[2], "u1")[offsets[0] : offsets[-1]].view(kind) if len(column) else np.zeros(0, kind)
            ids = {c: np.ascontiguousarray(rows[c]).view("<i8") for c in ("key", "row_id")}
            if len(rows) and min(ids["key"].min(), ids["row_id"].min()) < 0:
                raise OverflowError("an id of 2^63 or more")
            out = [pa.array(ids["key"]), pa.array(ids["row_id"])]
            if payload:
                body = np.ascontiguousarray(rows["payload"]).tobytes()
                at = np.arange(len(rows) + 1, dtype="<i4") * (width - 16)
                out.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(body)]))
            yield pa.RecordBatch.from_arrays(out, names=["key", "row_id"] + ["payload"] * payload)

    jvm, context = spark._jvm, spark.sparkContext._jsc.sc()
    records = context.binaryRecords(path, width, context.hadoopConfiguration())
    frame = spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    return DataFrame(frame, spark).mapInArrow(decode, "key bigint, row_id bigint" + ", payload binary" * payload)


def write_fixed(df: DataFrame, path: str, width: int = 16) -> None:
    """Writes one file per partition into a folder that all executors share; payloads are zero-padded to the width.

    Arrow batches are laid out as records in one step each. A file gets its name once it is whole, so a task that
    runs again replaces it. Null ids raise.
    """
    kind = _record(width)
    payload = width > 16

    def save(batches: Iterator) -> Iterator:
        import os

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(path, exist_ok=True)
        temporary = f"{path}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        n = 0
        with open(temporary, "wb") as f:
            for batch in batches:
                if batch.column(0).null_count or batch.column(1).null_count:
                    raise ValueError("an id is null")
                rows = np.zeros(batch.num_rows, kind)
                rows["key"], rows["row_id"] = (batch.column(k).to_numpy() for k in (0, 1))
                if payload:
                    bodies = [x or b"" for x in batch.column(2).to_pylist()]
                    if max(map(len, bodies), default=0) > width - 16:
                        raise ValueError("payload exceeds the record width")
                    rows["payload"] = np.array([x.ljust(width - 16, b"\0") for x in bodies], f"V{width - 16}")
                f.write(rows.tobytes())
                n += len(rows)
        os.replace(temporary, f"{path}/part-{task.partitionId():05d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    columns = ["key", "row_id", *["payload"] * payload]
    df.select(*columns).mapInArrow(save, "n bigint").agg({"n": "sum"}).collect()
