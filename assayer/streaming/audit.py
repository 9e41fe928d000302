"""The audit log as a stream: each session's chain goes on where the last batch, or the last run, has left it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def chained(entries: DataFrame, key: str = "session_id", seq: str = "seq", data: str = "data") -> DataFrame:
    """A stream's (key, seq, data) with previous_hash and entry_hash, as ``operators.audit.build_chain`` gives for a batch.

    The state of a session is its last hash and the last ``seq`` in the chain. Entries of a batch go in order of ``seq``; one whose
    ``seq`` is not beyond the chain's last is a repeat, since a chain can't be changed, and is left out. Null data count as empty text;
    entries without ``seq`` can't be placed and are left out. What a task holds at once is a session's entries of one batch (the source's
    ``maxFilesPerTrigger`` bounds it).
    """
    fields = [entries.schema[c] for c in (key, seq, data)]
    out = T.StructType([*fields, T.StructField("previous_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def go_on(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tip, last = state.get if state.exists else ("", None)
        rows = pd.concat(list(batches)).dropna(subset=[seq]).drop_duplicates(seq).sort_values(seq, kind="stable")
        rows = rows if last is None else rows[rows[seq] > last]
        before, after = [], []
        for text in rows[data]:
            before.append(tip)
            tip = hashlib.sha256((tip + ("" if pd.isna(text) else text)).encode()).hexdigest()
            after.append(tip)
        if len(rows):
            state.update((tip, int(rows[seq].iloc[-1])))
            yield rows[[key, seq, data]].assign(previous_hash=before, entry_hash=after)

    return entries.select(key, seq, data).groupBy(key).applyInPandasWithState(go_on, out, "tip string, last long", "append", GroupStateTimeout.NoTimeout)


def write_chain(entries: DataFrame, path: str, checkpoint: str, key: str = "session_id", seq: str = "seq", data: str = "data") -> StreamingQuery:
    """Chain what there is of a stream, to Parquet below ``path``; call it again, with the same ``checkpoint``, to go on.

    A batch writes a folder of its own and replaces it if it runs again after a failure, so no entry is in the log twice.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return chained(entries, key, seq, data).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """The chained entries that ``write_chain`` has written."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
