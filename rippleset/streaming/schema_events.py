"""Streams of schema notifications and collection events: payloads to completed statements to typed changes.

Every stream has a batch form of the same rules; a stream's output folder holds one part for each batch, written under the batch's number, so
a batch that runs again replaces itself and a restart from the same checkpoint adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rippleset.operators.schema_change import classify
from rippleset.streaming.storage import read_batch, write_batch

NOTIFICATION = "tag string, object_identity string, schema string, sql string, table_name string, operation string, column_name string, object_type string"
COLLECTION_EVENT = "seq bigint, operationType string, ns struct<coll: string>"
#: Collections of the listener itself.
CONTROL = ("schema_notifications",)
STATE = "collection string, known boolean"


def parse_payloads(raw: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON payloads (``value``); what is no object of them is left out."""
    parsed = raw.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    return parsed.where("p is not null and p._corrupt is null and value rlike '^\\\\s*[{]'").select("p.*").drop("_corrupt")


def is_incomplete(sql: Column) -> Column:
    """No statement, or an ALTER TABLE without its action."""
    return sql.isNull() | sql.isin("", "NULL") | (sql.startswith("ALTER TABLE") & (F.size(F.split(F.trim(sql), r"\s+")) <= 3))


def best_statements(log: DataFrame) -> DataFrame:
    """``word, logged``: for every word of logged ALTER TABLE statements (query, calls, mean_ms) the most called one, then the slowest, then the first."""
    words = log.where(F.contains("query", F.lit("ALTER TABLE"))).select("query", "calls", "mean_ms", F.explode(F.array_distinct(F.regexp_extract_all("query", F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    best = F.min(F.struct((-F.col("calls")).alias("c"), (-F.col("mean_ms")).alias("m"), "query"))
    return words.groupBy("word").agg(best.alias("best")).select("word", F.col("best.query").alias("logged"))


def completed(events: DataFrame, log: DataFrame) -> DataFrame:
    """Notifications with a ``statement``: their own, that of a dropped column, the logged one of their table, or one rebuilt from the tag."""
    dropped = F.concat(F.lit("ALTER TABLE "), F.coalesce("schema", F.lit("public")), F.lit("."), F.col("table_name"), F.lit(" DROP COLUMN "), F.col("column_name"))
    own = F.when((F.col("operation") == "DROP_COLUMN") & (F.coalesce("column_name", F.lit("")) != ""), dropped).otherwise(F.col("sql"))
    # What looks nothing up has keys of its own that no word equals: under one null key all of it would meet, and be classified, in one task.
    alone = F.concat(F.lit(" "), F.xxhash64(*events.columns).cast("string"))
    sought = F.coalesce(F.when(is_incomplete(own), F.col("table_name")), alone)
    given = events.withColumn("statement", own).withColumn("_sought", sought).join(best_statements(log), F.col("_sought") == F.col("word"), "left").drop("_sought", "word")
    rebuilt = F.concat_ws(" ", F.coalesce("tag", F.lit("")), F.coalesce("object_identity", F.lit("")))
    found = F.when(~is_incomplete(F.col("statement")), F.col("statement")).when(~is_incomplete(F.col("logged")), F.col("logged")).otherwise(F.trim(rebuilt))
    return given.withColumn("statement", found).drop("logged")


def ddl_changes(raw: DataFrame, log: DataFrame) -> DataFrame:
    """Typed changes of raw notifications."""
    done = completed(parse_payloads(raw, NOTIFICATION), log).select("object_identity", "tag", "statement")
    return classify(done.where("statement <> ''"))


def run_stream(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that a source holds now, batch by batch."""
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ddl_stream(source: DataFrame, log: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Typed changes of a stream of notifications, written to ``folder``; the log is read anew for each batch."""
    return run_stream(source, lambda batch, number: write_batch(ddl_changes(batch, log), folder, number), checkpoint)


def collection_changes(events: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of collections, and which collections are known afterwards.

    The first insert into a collection that is not known creates it; an invalidation drops it and forgets it. ``events`` are in the order of
    ``seq``; ``known`` is the state before them (``collection, known``).
    """
    op, name = F.col("operationType"), F.col("ns.coll")
    used = events.where(op.isin("insert", "invalidate") & (F.coalesce(name, F.lit("")) != "") & ~name.isin(*CONTROL)).select(name.alias("collection"), "seq", op.alias("op"))
    before = F.lag("op").over(Window.partitionBy("collection").orderBy("seq"))
    placed = used.withColumn("before", before).join(known, "collection", "left")
    is_known = F.when(F.col("before").isNull(), F.coalesce("known", F.lit(False))).otherwise(F.col("before") == "insert")
    told = placed.where((F.col("op") == "invalidate") | ~is_known)
    kind = F.when(F.col("op") == "insert", "CREATE").otherwise("DROP")
    changes = told.select("seq", "collection", F.concat(kind, F.lit("_COLLECTION")).alias("change_type"), F.concat(kind, F.lit(" COLLECTION "), F.col("collection")).alias("statement"))
    last = used.groupBy("collection").agg((F.max_by("op", "seq") == "insert").alias("now"))
    after = known.join(last, "collection", "full").select("collection", F.coalesce("now", "known").alias("known")).where("known")
    return changes, after


def collection_stream(source: DataFrame, folder: str, state: str, checkpoint: str) -> StreamingQuery:
    """Changes of collections of a stream of raw events; each batch starts from the state that the one before it wrote."""

    def handle(batch: DataFrame, number: int) -> None:
        known = read_batch(batch.sparkSession, state, number - 1, STATE)
        changes, after = collection_changes(parse_payloads(batch, COLLECTION_EVENT), known)
        write_batch(after, state, number)
        write_batch(changes, folder, number)

    return run_stream(source, handle, checkpoint)


def payload_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """A stream of the lines of a folder's files, so many files a batch (all there are, if not said), oldest first."""
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    return reader.text(folder)
