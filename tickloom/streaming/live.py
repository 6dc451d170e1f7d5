"""Live queries: the dialect's SELECT over streams.

The planner is the one of batch queries; over a stream a time bucket becomes
Spark's window, so a watermark closes it.  Closed windows are appended to the
sink once; state and progress are Spark's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.widths import interval, micros
from ..session import Session


def stream(session: Session, name: str, rows: DataFrame, time: str, delay: str = "0 s", ahead: str | None = None) -> None:
    """Registers a streaming DataFrame under a name; rows more than `delay` behind the latest are late.

    ahead: rows whose time is further ahead of the clock than this are left out, as one of them
    would make all others late.  Rows without a time are in no window."""
    if not rows.isStreaming:
        raise ValueError(f"{name} isn't a stream")
    # Event times must be instants; the session's zone is UTC, so they read the same.
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    if ahead is not None:
        rows = rows.where(F.col(time) <= F.current_timestamp() + F.expr(interval(micros(ahead))))
    session.tables[name.lower()] = rows.withWatermark(time, f"{micros(delay)} microseconds")


def file_stream(session: Session, name: str, path: str, time: str, delay: str = "0 s", fmt: str = "parquet", per_trigger: int | None = None, ahead: str | None = None) -> None:
    """A directory whose new files are new rows, as a stream."""
    spark = session.spark
    schema = session.read(path, None, {}).schema if fmt != "parquet" else spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    stream(session, name, reader.format(fmt).load(path), time, delay, ahead)


def kafka_stream(session: Session, name: str, brokers: str, topic: str, schema: str, time: str, delay: str = "0 s", seek_to: str = "latest") -> None:
    """A topic of JSON objects as a stream (Spark's Kafka source must be on the class path)."""
    raw = session.spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", seek_to).load()
    stream(session, name, raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*"), time, delay)


def start(session: Session, query: str, sink: str, checkpoint: str, *, fmt: str = "parquet", mode: str = "append", once: bool = False, partition_by: list[str] = (), name: str | None = None) -> StreamingQuery:
    """Starts a live query whose rows go to `sink`: a directory, or a name for fmt 'memory'."""
    df = session.query(query)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format(fmt)
    if name:
        w = w.queryName(name)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if once else w
    return w.queryName(sink).start() if fmt == "memory" else w.start(sink)


#: The column of a row's message headers, a map of texts.
HEADERS = "_tp_message_headers"


def kafka_rows(rows: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as Kafka messages: a JSON object each, with a column's text as key if asked for, and
    the headers of the column `HEADERS` where there is one (such as a key to tell repeats by)."""
    own = [c for c in rows.columns if c != HEADERS]
    made = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]), {"ignoreNullFields": "false"}).alias("value")]
    if key is not None:
        made.insert(0, F.col(f"`{key}`").cast("string").alias("key"))
    if HEADERS in rows.columns:
        entries = F.map_entries(F.coalesce(HEADERS, F.create_map().cast("map<string,string>")))
        made.append(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value"))).alias("headers"))
    return rows.select(*made)


def kafka_sink(session: Session, query: str, brokers: str, topic: str, checkpoint: str, *, key: str | None = None, once: bool = False) -> StreamingQuery:
    """Sends a live query's rows to a topic (Spark's Kafka sink must be on the class path)."""
    rows = kafka_rows(session.query(query), key)
    w = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).option("checkpointLocation", checkpoint)
    if HEADERS in session.query(query).columns:
        w = w.option("includeHeaders", "true")
    return (w.trigger(availableNow=True) if once else w).start()


def subscribe(session: Session, query: str, call: Callable[[DataFrame], None], checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Calls back with the new rows of a live query, batch by batch."""
    w = session.query(query).writeStream.foreachBatch(lambda df, _: call(df)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def append(session: Session, path: str, rows: DataFrame) -> None:
    """Adds rows to a table's directory: those who follow it as a stream get them.  The first rows
    fix the columns; later ones may leave columns out, not add any."""
    from ..sources import files

    spark = session.spark
    if files.exists(spark, f"{path.rstrip('/')}/*.parquet"):
        schema = spark.read.parquet(path).schema
        new = [c for c in rows.columns if c not in schema.names]
        if new:
            raise ValueError(f"{path} has no column {new[0]!r}")
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    rows.write.mode("append").parquet(path)


def view(session: Session, name: str, query: str, folder: str, *, once: bool = False, partition_by: list[str] = ()) -> StreamingQuery:
    """A live view: its rows so far and to come in a directory below `folder`, readable as the table `name`."""
    path = f"{folder.rstrip('/')}/{name}"
    schema = session.query(query).schema
    session.spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    session.tables[name.lower()] = path
    return start(session, query, path, f"{folder.rstrip('/')}/_checkpoints/{name}", once=once, partition_by=partition_by)
