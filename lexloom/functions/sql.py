"""Dictionary functions for SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexloom.functions.tokens import tokenize
from lexloom.plans.dictionary import Dictionary, engine_of


def register(spark: SparkSession, d: Dictionary, prefix: str = "") -> list[str]:
    """Register spell(word), root(word), suggest(word), analyze(word), stem(word), expand(word) and the table function
    tokenize(text, format) for a dictionary; returns their names. They run in Arrow batches; the operators in
    lexloom.operators.frames also ask only once for each distinct word."""
    payload, version = spark.sparkContext.broadcast(d.payload), d.version
    kinds = {
        "spell": ("boolean", lambda e, w: e.spell(w)),
        "root": ("string", lambda e, w: e.check(w).root),
        "suggest": ("array<string>", lambda e, w: e.suggest(w)),
        "analyze": ("array<string>", lambda e, w: e.analyze(w)),
        "stem": ("array<string>", lambda e, w: e.stem(w)),
        "expand": ("array<string>", lambda e, w: e.expand(w)),
    }

    def made(kind: str, fn):
        def run(words: pd.Series) -> pd.Series:
            e = engine_of(version, payload.value)
            return words.map(lambda w: None if w is None else fn(e, w))

        return F.pandas_udf(run, kind)

    for name, (kind, fn) in kinds.items():
        spark.udf.register(prefix + name, made(kind, fn))
    chars = d.wordchars

    @F.udtf(returnType="word string, offset int, line int, column int")
    class Tokenize:
        def eval(self, text: str, fmt: str):
            for t in tokenize(text or "", fmt, chars):
                yield t.word, t.offset, t.line, t.column

    spark.udtf.register(prefix + "tokenize", Tokenize)
    return [prefix + n for n in (*kinds, "tokenize")]
