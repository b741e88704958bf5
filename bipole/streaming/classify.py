"""A fitted static classifier on a stream: stateless, one model stage a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bipole.operators.classify import PromptClassifier


def classify_stream(queries: DataFrame, classifier: PromptClassifier, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append (query_id, prediction, p_positive, batch_id) of the stream (query_id, text) to Parquet. A micro-batch that is repeated after a failure overwrites
    its own folder, so every query is answered once. Query-aware selectors need the whole pool for each query and are refused."""
    if classifier.prefix_ is None:
        raise ValueError("only a static selector can be applied to a stream")

    def each(batch: DataFrame, batch_id: int) -> None:
        classifier.predict(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
