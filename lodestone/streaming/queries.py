"""A stream of queries against indexed tables: each micro-batch is answered by the same plan as a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str) -> StreamingQuery:
    """Write ``answer`` of each batch below ``folder``, under the batch's number, so that a batch run again replaces its rows."""

    def one(batch: DataFrame, k: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{folder}/answers/batch={k}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
