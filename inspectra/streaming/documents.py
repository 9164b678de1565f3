"""Document events as a stream: the batch barrier, request coalescing and idempotent uploads. Re-filings, findings and scores are in `filings`."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inspectra.operators.documents import TERMINAL
from inspectra.operators.facts import USABLE, K
from inspectra.plans.materialise import shared_dir
from inspectra.plans.registry import query
from inspectra.sources.views import frame

EVENT = "batch_id long, document_id long, status string, dated boolean, sealed boolean, created_at timestamp"
REQUEST = "batch_id long, documents long, usable long"
#: State by key with collections needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def document_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """One row per status change; a seal event has no document."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


#: Ids that share an entry of the state.
NEIGHBOURS = 1 << 14


class Barrier(StatefulProcessor):
    """T2 for one batch: the latest state of each document by created_at, counts that follow each change, and whether the batch is sealed or released.

    Documents of neighbouring ids are one entry of the state, since each read and write of it is a call from Python to the store; memory is one entry's documents at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.documents = handle.getMapState("documents", "neighbours long", "held string")
        self.counts = handle.getValueState("counts", "documents long, running long, usable long, sealed boolean, released boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        documents, running, usable, sealed, released = self.counts.get() if self.counts.exists() else (0, 0, 0, False, False)
        for part in rows:
            if released:
                continue
            sealed = sealed or any(x is True or x == 1 for x in part["sealed"])
            part = part[part["document_id"].notna()]
            for at, own in part.groupby(part["document_id"].astype("int64") // NEIGHBOURS):
                held = json.loads(self.documents.getValue((int(at),))[0]) if self.documents.containsKey((int(at),)) else {}
                for r in own.itertuples():
                    name, new = str(int(r.document_id)), [r.created_at.value, r.status, bool(r.dated)]
                    old = held.get(name)
                    if old is not None and (old[0], old[1] or "") > (new[0], new[1] or ""):
                        continue
                    for state, step in ((old, -1), (new, 1)):
                        if state is not None:
                            documents += step
                            running += step * (state[1] not in TERMINAL)
                            usable += step * (state[1] in USABLE and state[2])
                    held[name] = new
                self.documents.updateValue((int(at),), (json.dumps(held),))
        ready = sealed and not released and running == 0 and usable > 0
        if ready:
            self.documents.clear()
        self.counts.update((documents, running, usable, sealed, released or ready))
        if ready:
            yield pd.DataFrame({"batch_id": [int(key[0])], "documents": [documents], "usable": [usable]})

    def close(self) -> None:
        pass


def barrier(events: DataFrame) -> DataFrame:
    """One evaluation request for a batch, as soon as it is sealed and all its documents are terminal, once. A stream; its state is kept by batch in the state store, a
    micro-batch reads and writes the batches only that it has events of. A released batch keeps one flag, and takes no more events."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("batch_id").transformWithStateInPandas(Barrier(), REQUEST, "Append", "None")


def unique_uploads(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """T4: the first upload of each (organisation, client key); repeats within the delay are dropped."""
    return uploads.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["organisation_id", "client_key"])


def coalesced(requests: DataFrame) -> DataFrame:
    """One request per establishment and period of a micro-batch."""
    return requests.dropDuplicates(K)


@query("t1_t2_batch_barrier", """SELECT batch_id, count(*) AS documents, count(*) FILTER (WHERE status IN ('EXTRACTED', 'NEEDS_REVIEW', 'VERIFIED', 'EVALUATED')) AS usable FROM x_document GROUP BY 1
 HAVING count(*) FILTER (WHERE status IN ('EXTRACTED', 'NEEDS_REVIEW', 'VERIFIED', 'EVALUATED')) > 0""")
def _t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all batches as a stream of two rounds of events, seals first."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    docs = frame(spark, sf_dir, "x_document")
    last = docs.select("batch_id", "document_id", "status", F.lit(True).alias("dated"), F.lit(False).alias("sealed"), F.col("created_at").cast("timestamp").alias("created_at"))
    received = last.withColumns({"status": F.lit("RECEIVED"), "created_at": F.col("created_at") - F.expr("interval 1 day")})
    seals = last.groupBy("batch_id").agg(F.max("created_at").alias("created_at")).select("batch_id", F.lit(None).cast("long").alias("document_id"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("dated"), F.lit(True).alias("sealed"), "created_at")
    for rows in (received.unionByName(seals), last):
        rows.write.mode("append").parquet(f"{folder}/events")
    requests = barrier(document_events(spark, f"{folder}/events", 4)).writeStream.format("parquet")
    requests.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/requests").awaitTermination()
    return spark.read.schema(REQUEST).parquet(f"{folder}/requests").select("batch_id", "documents", "usable")
