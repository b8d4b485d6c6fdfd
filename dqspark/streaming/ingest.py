"""The same contract over a stream: each micro-batch goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dqspark.operators import clean, contract
from dqspark.operators.contract import COMPANY, SEQ, Contract
from dqspark.sources.durable import pin
from dqspark.sources.files import _exists, with_sequence
from dqspark.sources.sinks import quarantine_records, write_clean


def start_ingest(
    stream: DataFrame, clean_path: str, quarantine_path: str, checkpoint: str, rules: Contract = COMPANY
) -> StreamingQuery:
    """Validate and clean every micro-batch, appending to the clean and quarantine tables.

    The clean sink inserts by absent key, so a replayed batch adds nothing to
    it.  The quarantine sink is keyless: each batch goes to its own folder,
    overwritten on replay.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch if SEQ in batch.columns else with_sequence(batch)
        annotated = pin(contract.annotate(rows, rules), "stream")
        write_clean(clean.clean_records(contract.valid_records(annotated), rules), clean_path, rules.key)
        rejected = contract.invalid_rows(annotated)
        last = None
        if _exists(batch.sparkSession, f"{quarantine_path}/batch=*"):
            others = batch.sparkSession.read.option("basePath", quarantine_path).parquet(f"{quarantine_path}/batch=*")
            last = others.filter(F.col("batch") != batch_id).agg(F.max("id")).first()[0]
        quarantine_records(rejected, (last or 0) + 1).write.mode("overwrite").parquet(
            f"{quarantine_path}/batch={batch_id}"
        )

    return (
        stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
