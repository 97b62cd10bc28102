"""Recognition events as a stream: budgets and regrouping with state per document, caches that commit on success."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def budget_stream(events: DataFrame, limit: int) -> DataFrame:
    """document, event, spent_before of events (document, event, tokens) that start before the document's budget is spent.

    The tokens spent so far are the only state. Events of a batch are taken by number.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("event")
        before = spent + rows.tokens.cumsum() - rows.tokens
        state.update((int(spent + rows.tokens.sum()),))
        out = rows.assign(spent_before=before)[before < limit]
        yield out[["document", "event", "spent_before"]]

    return events.groupBy("document").applyInPandasWithState(run, "document long, event long, spent_before long", "spent long", "append", GroupStateTimeout.NoTimeout)


def regroup_stream(parts: DataFrame, idle: int | None = None) -> DataFrame:
    """document, element, text of elements in a stream of parts (document, ord, element, text).

    An element is complete when the next begins. The last one of a document is complete when a part without an element comes,
    the mark of the document's end, or, with `idle`, when nothing has come for so many milliseconds.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        element, text = state.get if state.exists else (None, "")
        done = []
        if state.hasTimedOut:
            done, element = [(key[0], element, text)], None
        for row in () if state.hasTimedOut else pd.concat(list(batches)).sort_values("ord").itertuples():
            own = None if pd.isna(row.element) else int(row.element)
            if element is not None and own != element:
                done.append((key[0], element, text))
                text = ""
            element, text = own, text + (row.text or "") if own is not None else ""
        if element is None:
            state.remove()
        else:
            state.update((element, text))
            if idle is not None:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(done, columns=["document", "element", "text"])

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return parts.groupBy("document").applyInPandasWithState(run, "document long, element long, text string", "element long, text string", "append", timeout)


def with_ends(parts: DataFrame) -> DataFrame:
    """Parts of documents that are whole, with the mark of the end after each document."""
    ends = parts.groupBy("document").agg((F.max("ord") + 1).alias("ord")).select("document", "ord", F.lit(None).cast("long").alias("element"), F.lit("").alias("text"))
    return parts.select("document", "ord", "element", "text").union(ends)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and values in windows of event time, late ones dropped beyond the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_new(cache_path: str, key: str):
    """For foreachBatch: adds rows whose key the cache does not hold yet; a batch that fails adds nothing, one that is repeated adds once."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(cache_path).select(key)
            fresh = fresh.join(known, key, "left_anti")
        except Exception as e:  # the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(cache_path)

    return write


def finish(query_input: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet, and reads the result."""
    stream = query_input.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    return query_input.sparkSession.read.schema(query_input.schema).parquet(out)
