"""Structured Streaming forms of the field, edit and keyword operators.

Values are chosen by (ts, event_id), never by arrival, so that a late event changes nothing newer. Edits of one text
don't commute: ``replay`` (the default) keeps the log of a key (see ``logs``) and puts late edits where they belong;
``arrival`` keeps the result alone and applies each batch's edits, sorted, on top.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from foliant.functions.text import or_empty
from foliant.operators.fields import fill, last_field_values
from foliant.operators.markup import marker
from foliant.operators.tokens import content_array
from foliant.streaming.logs import Edit, insert_one, logged, move_one

MODES = ("replay", "arrival")


def field_events_stream(spark: SparkSession, path: str, schema, *, files_per_batch: int = 1000, source: str = "parquet") -> DataFrame:
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_field_state(events: DataFrame) -> DataFrame:
    """session, slot, value: the live value of each slot."""
    return last_field_values(events)


def stream_letter_preview(events: DataFrame, template: str) -> DataFrame:
    """session, letter: the template with the session's latest values, in one aggregation."""
    order = F.struct("ts", "event_id")
    values = [F.max_by("value", F.when(F.col("slot") == i, order)).alias(f"v{i}") for i in range(5)]
    latest = events.groupBy("session").agg(*values)
    slots = F.array(*[or_empty(F.col(f"v{i}")) for i in range(5)])
    return latest.select("session", fill(F.lit(template), slots).alias("letter"))


def stream_keyword_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """word, n over all documents that have arrived."""
    words = docs.select(F.explode(content_array(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _edits(rows: DataFrame, base: DataFrame, key: str, first: str, second: Column, horizon: str | None) -> DataFrame:
    """key, base, ts, event_id, first, second. ``base``: key, base, a table; with ``horizon``, behind a watermark."""
    rows = rows.withColumn("time", F.col("ts").cast("timestamp"))
    if horizon:
        rows = rows.withWatermark("time", horizon)
    return rows.join(base, key).select(
        F.col(key).alias("key"), "base", "time", _micros(F.col("time")).alias("ts"), F.col("event_id").cast("long").alias("event_id"),
        F.col(first).cast("long").alias("first"), second.cast("string").alias("second"),
    )


def _stateful(edits: DataFrame, apply: Callable, mode: str, horizon: str | None) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "replay":
        return logged(edits, apply, compact=horizon is not None)
    if edits.schema["key"].dataType.simpleString() != "bigint":
        raise ValueError("arrival wants keys that are numbers")
    return edits.drop("time").groupBy("key").applyInPandasWithState(
        _arrived(apply), "key long, result string", "state string", "update", GroupStateTimeout.NoTimeout
    )


def _arrived(apply: Callable[[str, Edit], str]):
    """The state of a key is the result so far; each batch's edits come on top, in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        value = state.get[0] if state.exists else rows["base"].iloc[0]
        for ts, event, first, second in zip(rows["ts"], rows["event_id"], rows["first"], rows["second"]):
            value = apply(value, (ts, event, None if pd.isna(first) else int(first), second if isinstance(second, str) else None))
        state.update((value,))
        yield pd.DataFrame({"key": [key[0]], "result": [value]})

    return run


def stream_insert_markers(
    drops: DataFrame,
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    wrap: str = "none",
    mode: str = "replay",
    horizon: str | None = None,
) -> DataFrame:
    """key, text after each batch. ``drops``: key, ts, event_id, offset, value; ``docs``: a table of key, text.

    ``horizon``: how late an edit may be; state forgets what is older, and so do drops that come later than that.
    """
    base = docs.select(key, or_empty(F.col(text)).alias("base"))
    rows = _edits(drops, base, key, "offset", marker(or_empty(F.col("value")), wrap), horizon)
    return _stateful(rows, insert_one, mode, horizon).toDF(key, text)


def stream_move_fields(
    moves: DataFrame, slotted: DataFrame, *, session: str = "session", mode: str = "replay", horizon: str | None = None
) -> DataFrame:
    """session, slots after each batch. ``moves``: session, ts, event_id, from, to; ``slotted``: session, slots."""
    rows = _edits(moves, slotted.select(session, F.to_json("slots").alias("base")), session, "from", F.col("to"), horizon)
    done = _stateful(rows, move_one, mode, horizon).toDF(session, "slots")
    return done.withColumn("slots", F.from_json("slots", "array<string>"))


def run_to_end(stream: DataFrame, folder: str, *, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs over all that is there and returns the table that the stream leaves: the last state of each key.

    Each batch goes to a folder of its own; a batch that is run again overwrites it.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    if mode == "complete":
        last = found.agg(F.max("batch")).first()[0]
        return found.where(F.col("batch") == last).drop("batch")
    values = [c for c in found.columns if c not in (*keys, "batch")]
    latest = found.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")
