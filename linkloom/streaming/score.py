"""Records that arrive as a stream, scored against a fixed index.

Scoring is stateless: each micro-batch is one batch plan against the index (ranking within a
record needs a batch), so there is no watermark, and the sink's own commits make it repeatable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions import views as V
from linkloom.operators import decide, retrieval
from pyspark.sql import functions as F


def score_stream(records: DataFrame, index: DataFrame, vocab: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, views: tuple[str, ...] = V.DEFAULT_VIEWS, k: int = 5) -> StreamingQuery:
    """Starts a query that gives `sink` the decisions of every micro-batch of streamed records.
    `index` holds weighted postings of the entities, `vocab` their vocabulary; both should be
    written tables, read again for each batch."""

    def batch(new: DataFrame, number: int) -> None:
        rows = retrieval.weighted(V.postings(V.parsed(new), views), vocab)
        ranked = retrieval.top_k(retrieval.scores(rows, index), k)
        pairs = retrieval.union_of_views(ranked, views).withColumn("probability", F.col("score_best"))
        sink(decide.decisions(pairs), number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
