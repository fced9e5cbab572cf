"""Payloads from a stream into a log of prepared events, and the graph that the log stands for.

Which event says something first, and which mention names an entity, hangs on the order of
insertion (`ord`), not on when a micro-batch came in: an event that comes late may still be the
first. So the stream appends prepared events, once a micro-batch, and the graph is what
`ingest.ingested` makes of the whole log: the same whatever the order of micro-batches, and however
often one was run. `ingest.appended` is the way for batches that come in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomgraph.operators import engine, ingest

EVENTS = (
    "graph_id string, ord bigint, source string, chunk string, original_id string, event_id string, lemma string, sense_id string, roles map<string,string>, time_context struct<raw_expression:string,start_year:bigint,end_year:bigint>, "
    "spatial_context struct<location_name:string,parent_region:string>, epistemic_context struct<source:string,confidence:double,is_speculative:boolean>"
)
LINKS = "graph_id string, source string, chunk string, source_id string, target_id string, relation string"


def logged(payloads: DataFrame, folder: str, batch: int, switches: dict[str, bool] | None = None, rolesets: DataFrame | None = None) -> None:
    """Appends the events and links of a micro-batch to the log; the same batch again takes the place of what it left."""
    events, links = engine.batch_of(payloads, switches, rolesets)
    for name, rows, schema in (("events", events, EVENTS), ("links", links, LINKS)):
        columns = [f.split()[0] for f in schema.split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def stream_into(payloads: DataFrame, folder: str, checkpoint: str, switches: dict[str, bool] | None = None, rolesets: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Starts a query that logs a stream of payloads (see `engine.batch_of`); trigger as in `DataStreamWriter.trigger`."""
    each = lambda rows, batch: logged(rows, folder, batch, switches, rolesets)
    writer = payloads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def graph_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The ten tables of the graph that a log stands for; a log without events gives empty ones."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return ingest.empty(spark)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}/*")
    return ingest.ingested(read("events", EVENTS), read("links", LINKS).where(F.col("source_id") != F.col("target_id")))
