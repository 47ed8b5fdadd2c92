"""Scoring of streamed choice situations with fixed parameters.

Whole observations must arrive in one micro-batch, as probabilities compare the
alternatives of one observation; then scoring keeps no state between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from choicelake.plans.models import ChoiceModel


def score_stream(model: ChoiceModel, stream: DataFrame, path: str, checkpoint: str, param_list: list | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Append ``predict``'s output to Parquet at ``path``; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        model.predict(batch, param_list).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
