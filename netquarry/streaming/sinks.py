"""What streams feed batch by batch: the online learner, and exports of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..models.hoeffding import HoeffdingTree
from ..operators import alerting


def learn(labelled: DataFrame, tree: HoeffdingTree, checkpoint: str, order: str = "event_id") -> StreamingQuery:
    """Updates the tree once with every labelled vector of the stream; vectors without a label teach nothing."""
    writer = labelled.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, _: tree.learn_batch(batch, order=order)).start()


def export(alerts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's alerts as JSON and as lines of the Common Event Format. A batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        alerting.as_json(batch).select("json").write.mode("overwrite").text(f"{folder}/json/batch={number}")
        alerting.as_cef(batch).select("line").write.mode("overwrite").text(f"{folder}/cef/batch={number}")
        batch.unpersist()

    return alerts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
