"""Streams: a resumable prediction log, event chains folded to a state, windows over late events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions_log(stream: DataFrame, predict: Callable[[pd.Series], pd.Series], sink: str, checkpoint: str, key: str = "id", payload: str = "text"):
    """Runs ``predict`` on new rows only and appends (key, status, output, error_type) to the sink; keys that the sink holds
    are skipped, a failing row becomes an error row and the run goes on. Returns the writer to start."""

    def attempt(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append(("ok", str(predict(pd.Series([t])).iloc[0]), None))
            except Exception as e:  # noqa: BLE001
                rows.append(("error", "", type(e).__name__))
        return pd.DataFrame(rows, columns=["status", "output", "error_type"])

    run = F.pandas_udf(attempt, "struct<status:string,output:string,error_type:string>")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(sink).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.select(key, run(payload).alias("r")).select(key, "r.*").write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def fold_events(stream: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page the text after the last event, the number of events and of breaks (a text before that is not the last text
    after, or a time that goes back). Late events count as breaks."""

    def step(key, batches: Iterator[pd.DataFrame], state):
        text, last, events, breaks = state.get if state.exists else (None, None, 0, 0)
        for b in batches:
            for r in b.sort_values("timestamp").itertuples():
                at = int(r.timestamp.value // 1000)
                if events and (r.before != text or last is not None and at < last):
                    breaks += 1
                text, last, events = r.after, max(at, last or at), events + 1
        state.update((text, last, events, breaks))
        yield pd.DataFrame({page: [key[0]], "text": [text], "events": [events], "breaks": [breaks]})

    return stream.groupBy(page).applyInPandasWithState(step, f"{page} string, text string, events bigint, breaks bigint", "text string, last bigint, events bigint, breaks bigint", "update", "NoTimeout")


def event_windows(events: DataFrame, time: str, by: str, length: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums over tumbling or sliding windows; a stream needs ``late``, after which a window is final."""
    src = events.withWatermark(time, late) if late else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return src.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str) -> DataFrame:
    """Events of one key without a pause of ``gap`` or more."""
    return events.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")


def with_retries(call, attempts: int = 5, first: float = 1.0, transient: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError), sleep=None):
    """``call`` tried again after a transient error, up to ``attempts`` times, waiting twice as long each time; another error, or the last, is raised."""
    import time

    wait = sleep or time.sleep

    def run(*args, **kwargs):
        for i in range(attempts):
            try:
                return call(*args, **kwargs)
            except transient:
                if i == attempts - 1:
                    raise
                wait(first * 2**i)

    return run
