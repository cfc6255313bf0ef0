"""Streams of texts: stateless checking against a fixed or newest dictionary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.tokens import words_col
from lexloom.operators.texts import misspellings
from lexloom.plans.dictionary import Dictionary


def check_stream(docs: DataFrame, d: Dictionary, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", fmt: str = "text"):
    """Append the misspellings of every batch of a stream of texts to a Parquet folder; returns the started query."""
    return check_stream_newest(docs, lambda: d, out, checkpoint, id_col, text_col, fmt)


def check_stream_newest(docs: DataFrame, newest: Callable[[], Dictionary], out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", fmt: str = "text"):
    """The same with the dictionary that newest() gives when a batch starts. A batch that runs again replaces its own rows."""

    def batch(df: DataFrame, n: int) -> None:
        misspellings(df, newest(), id_col, text_col, fmt).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def wrong_per_window(docs: DataFrame, known: DataFrame, time_col: str, text_col: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Streaming counts of unknown words per time window, late rows up to `late`. known: a static column form of words."""
    words = docs.withWatermark(time_col, late).select(time_col, F.explode(words_col(F.col(text_col))).alias("word"))
    flagged = words.join(known.select(F.col("form").alias("k")).distinct(), F.col("word") == F.col("k"), "left")
    return flagged.groupBy(F.window(time_col, window)).agg(F.count("*").alias("n_words"), F.sum(F.col("k").isNull().cast("long")).alias("n_unknown"))
