"""Dictionary operations on columns of words, by the single-word engine.

Every operation first reduces its input to distinct words, asks the engine once for each in Arrow batches, and joins the
answers back. Dictionaries travel as one broadcast of their rules and entries; a worker compiles a dictionary once.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.plans.dictionary import Dictionary, engine_of

_ANSWERS = {
    "check": ("correct boolean, compound boolean, forbidden boolean, warn boolean, root string", lambda e, w: (lambda r: (r.correct, r.compound, r.forbidden, r.warn, r.root))(e.check(w))),
    "suggest": ("suggestions array<string>", lambda e, w: (e.suggest(w),)),
    "analyze": ("analyses array<string>", lambda e, w: (e.analyze(w),)),
    "stem": ("stems array<string>", lambda e, w: (e.stem(w),)),
    "expand": ("forms array<string>", lambda e, w: (e.expand(w),)),
    "suffix_forms": ("forms array<string>", lambda e, w: (e.suffix_forms(w),)),
    "has_word": ("listed boolean", lambda e, w: (e.has_word(w),)),
}
#: What an engine does with a whole batch of words before it is asked for each.
_BEFORE = {"suggest": lambda e, words: e.look_ahead(words)}
_KINDS = {"boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _kernel(version: str, payload, fn: Callable, fields: list[tuple[str, str]], inputs: int, before: Callable | None = None):
    def run(batches):
        engine = engine_of(version, payload.value)
        for batch in batches:
            args = [c.to_pylist() for c in batch.columns[:inputs]]
            if before:
                before(engine, *args)
            rows = [fn(engine, *a) for a in zip(*args)]
            cols = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[:inputs], *(pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields))], names=[*batch.schema.names[:inputs], *(n for n, _ in fields)])

    return run


def ask(words: DataFrame, d: Dictionary, what: str, partitions: int | None = None) -> DataFrame:
    """Answers for the distinct non-null words of a one-column DataFrame: the column, then the answer's columns."""
    schema, fn = _ANSWERS[what]
    spark, col = words.sparkSession, words.columns[0]
    fields = [tuple(f.strip().split(" ", 1)) for f in schema.split(",")]
    distinct = words.filter(F.col(col).isNotNull()).distinct()
    # A few MB of words can be hours of work: a fixed number of tasks, which adaptive execution doesn't merge.
    distinct = distinct.repartition(partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), col)
    payload = spark.sparkContext.broadcast(d.payload)  # a dictionary: some MB, whatever the input
    return distinct.mapInArrow(_kernel(d.version, payload, fn, fields, 1, _BEFORE.get(what)), f"`{col}` string, {schema}")


def with_answers(df: DataFrame, col: str, d: Dictionary, what: str) -> DataFrame:
    """df with an answer's columns for a column of words; null words have null answers."""
    return df.join(ask(df.select(col), d, what), col, "left")


def check_any(words: DataFrame, dictionaries: list[Dictionary]) -> DataFrame:
    """Words under several dictionaries: the column, correct in any, and the number of the first that has it (null: none)."""
    col = words.columns[0]
    open_, parts = words.select(col), []
    for k, d in enumerate(dictionaries):
        found = ask(open_, d, "check").select(col, "correct")
        parts.append(found.filter("correct").select(col, F.lit(True).alias("correct"), F.lit(k).alias("dictionary")))
        open_ = found.filter("NOT correct").select(col)
    out = open_.select(col, F.lit(False).alias("correct"), F.lit(None).cast("int").alias("dictionary"))
    for p in parts:
        out = out.unionByName(p)
    return out


def generate(pairs: DataFrame, d: Dictionary) -> DataFrame:
    """Forms of words like examples: pairs(word, example) with a column forms."""
    word, example = pairs.columns[:2]
    payload = pairs.sparkSession.sparkContext.broadcast(d.payload)
    fn = lambda e, w, x: (e.generate(w, x),)
    return pairs.select(word, example).dropna().distinct().mapInArrow(_kernel(d.version, payload, fn, [("forms", "array<string>")], 2), f"`{word}` string, `{example}` string, forms array<string>")


# overlays


def word_list(lines: DataFrame, allowed: bool, col: str = "value") -> DataFrame:
    """A list of words from lines: blank lines and # comments go, *word turns around what the list says."""
    line = F.trim(F.col(col))
    keep = lines.filter((line != "") & ~line.startswith("#"))
    star = line.startswith("*") & (F.length(line) > 1)
    return keep.select(F.when(star, F.substring(line, 2, 2**31 - 1)).otherwise(line).alias("word"), (star != F.lit(allowed)).alias("allowed")).distinct()


def list_from_lexicon(lines: DataFrame, allowed: bool = True, col: str = "value") -> DataFrame:
    """A list from the lines of a lexicon: its words without flags and fields; the count in front is no word."""
    line = F.regexp_replace(F.col(col), r"(?s)(?:[ \t]..:|\t).*$", "")
    word = F.regexp_replace(F.regexp_extract(line, r"^((?:/)?(?:\\/|[^/])*)", 1), r"\\/", "/")
    return lines.select(F.trim(word).alias("word")).filter("word <> '' AND NOT word RLIKE '^[0-9]+$'").distinct().withColumn("allowed", F.lit(allowed))


def overlay(words: DataFrame, lists: DataFrame, verdicts: DataFrame, turkic: bool = False) -> DataFrame:
    """The verdict on words under lists: forbidden as it is, else allowed in one of its case forms, else the dictionary's.

    words: one column; lists: word, allowed; verdicts: that column and correct.
    """
    from lexloom.functions.casing import init_col, kind_col, lower_col

    col = words.columns[0]
    kind = kind_col(F.col(col), turkic)
    small = lower_col(F.col(col), turkic)
    forms = F.when(kind == "init", F.array(F.col(col), small)).when(kind == "all", F.array(F.col(col), small, init_col(small, turkic))).otherwise(F.array(F.col(col)))
    own = words.select(col).distinct()
    bad = lists.filter("NOT allowed").select(F.col("word").alias("__w")).distinct()
    good = lists.filter("allowed").select(F.col("word").alias("__w")).distinct()
    probes = own.select(col, F.explode(F.array_distinct(forms)).alias("__form"))
    listed = probes.join(good, F.col("__form") == F.col("__w"), "left_semi").select(col).distinct().withColumn("__good", F.lit(True))
    banned = own.join(bad, F.col(col) == F.col("__w"), "left_semi").withColumn("__bad", F.lit(True))
    out = own.join(banned, col, "left").join(listed, col, "left").join(verdicts.select(col, "correct"), col, "left")
    verdict = F.when(F.col("__bad"), False).when(F.col("__good"), True).otherwise(F.coalesce("correct", F.lit(False)))
    return out.select(col, verdict.alias("correct"))


def close_words(wrong: DataFrame, lists: DataFrame, most: int | None = None) -> DataFrame:
    """Allowed list words near wrong words: within 1, 2 or 3 steps for words of up to 4, up to 8 or more characters, the
    nearest first. One column of words in; word, suggestion, distance, place out.

    Words and list words meet by each length within reach; a list is a table of people's own words, not a corpus. The plain
    edit distance, of which one exchange of neighbours takes two steps, drops most pairs before the exact one is folded.
    """
    from lexloom.functions.similar import osa_col
    from pyspark.sql import Window

    col = wrong.columns[0]
    reach = F.when(F.length(col) <= 4, 1).when(F.length(col) <= 8, 2).otherwise(3)
    good = lists.filter("allowed").select(F.col("word").alias("suggestion")).distinct()
    bad = lists.filter("NOT allowed").select(F.col("word").alias("suggestion")).distinct()
    good = good.join(bad, "suggestion", "left_anti").withColumn("__n", F.length("suggestion"))
    probe = wrong.select(col).distinct().withColumn("__k", reach).withColumn("__n", F.explode(F.sequence(F.greatest(F.length(col) - F.col("__k"), F.lit(0)), F.length(col) + F.col("__k"))))
    pairs = probe.join(good, "__n").filter(F.col("suggestion") != F.col(col)).filter(F.levenshtein(F.col(col), F.col("suggestion")) <= 2 * F.col("__k"))
    near = pairs.withColumn("distance", osa_col(F.col(col), F.col("suggestion"))).filter(F.col("distance") <= F.col("__k"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy(col).orderBy("distance", "suggestion")))
    return (near if most is None else near.filter(F.col("place") <= most)).select(col, "suggestion", "distance", "place")
