"""Text files and zipped office documents as tables of texts."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexloom.functions.tokens import format_of


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of any store as rows: path, format (told by the name), text. Office documents give their content part; bytes
    that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = [_text(n, c or b"") for n, c in zip(names, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in zip(*rows))] if rows else [batch.column(0), pa.array([], pa.string()), pa.array([], pa.string())], names=["path", "format", "text"])

    return files.mapInArrow(run, "path string, format string, text string")


def _text(name: str, data: bytes) -> tuple[str, str]:
    fmt = format_of(name)
    if fmt == "odf" and data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            data = z.read("content.xml") if "content.xml" in z.namelist() else b""
    return fmt, data.decode("utf-8", "replace")
