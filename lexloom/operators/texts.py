"""Whole texts: tokens, misspellings, corrections and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.tokens import Token, found_words, placed_words_col, places, replace_tokens, tokenize
from lexloom.operators.frames import ask
from lexloom.plans.dictionary import Dictionary, engine_of
from lexloom.plans.relational import check

TOKENS = "array<struct<word:string,offset:int,line:int,column:int>>"
_TOKEN = pa.list_(pa.struct([("word", pa.string()), ("offset", pa.int32()), ("line", pa.int32()), ("column", pa.int32())]))


def tokens(docs: DataFrame, id_col: str, text_col: str, fmt: str = "text", wordchars: str = "", urls: bool = False) -> DataFrame:
    """One row per token: the id, word, offset (bytes), line, column. Null texts have no tokens.

    Plain text without URL skipping stays in built-in functions; other formats run document by document in Arrow.
    """
    d = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    if fmt == "text" and urls:
        found = F.explode(placed_words_col(text_col, wordchars)).alias("t")
        rows = d.select(id_col, text_col, found)
        before = F.substring(F.col(text_col), F.lit(1), F.col("t.start"))
        return rows.select(
            id_col, F.regexp_replace("t.word", ":$", "").alias("word"), F.octet_length(before).alias("offset"),
            (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("column"),
        )

    def run(batches):
        for batch in batches:
            words, ends, at = [], [0], [np.zeros((3, 0), np.int64)]
            for x in batch.column(1).to_pylist():
                found = found_words(x, fmt, wordchars, urls)
                words += [w for _, w in found]
                ends.append(len(words))
                at.append(np.array(places(x, np.array([i for i, _ in found], np.int64))))
            numbers = [pa.array(c.astype(np.int32)) for c in np.concatenate(at, axis=1)]
            rows = pa.StructArray.from_arrays([pa.array(words, pa.string()), *numbers], fields=list(_TOKEN.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows).cast(_TOKEN)], names=[id_col, "tokens"])

    kind = d.schema[id_col].dataType.simpleString()
    return d.mapInArrow(run, f"`{id_col}` {kind}, tokens {TOKENS}").select(id_col, F.explode("tokens").alias("t")).select(id_col, "t.word", "t.offset", "t.line", "t.column")


def kept(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed in the session's shared folder, or, where none is set, kept on the executors' disks."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def misspellings(docs: DataFrame, d: Dictionary, id_col: str, text_col: str, fmt: str = "text", suggest: bool = False, urls: bool = False) -> DataFrame:
    """The wrong tokens of texts with their places, and suggestions if asked for. Each distinct word is checked once; a
    word with typographic apostrophes is right if it is with plain ones."""
    wrong = _wrong(kept(tokens(docs, id_col, text_col, fmt, d.wordchars, urls)), d)  # read by up to three joins
    if suggest:
        wrong = wrong.join(ask(wrong.select("word"), d, "suggest"), "word")
    return wrong.select(id_col, "word", "offset", "line", "column", *["suggestions"] * suggest)


def _wrong(found: DataFrame, d: Dictionary) -> DataFrame:
    """The rows of found whose word is wrong."""
    plain = F.translate(F.replace(F.col("word"), F.lit("&apos;"), F.lit("'")), "’", "'")
    found = found.withColumn("plain", plain)
    words = found.select(F.explode(F.array_distinct(F.array("word", "plain"))).alias("word")).distinct()
    bad = kept(check(words, d).filter("NOT correct").select("word"))
    return found.join(bad, "word", "left_semi").join(bad.withColumnRenamed("word", "plain"), "plain", "left_semi").drop("plain")


def distinct_misspellings(docs: DataFrame, d: Dictionary, id_col: str, text_col: str, fmt: str = "text", urls: bool = False) -> DataFrame:
    """The distinct wrong words of all texts with their least column and suggestions. Tokens meet in a sum by word, as all
    else depends on the word alone."""
    once = tokens(docs, id_col, text_col, fmt, d.wordchars, urls).groupBy("word").agg(F.min("column").alias("column"))
    wrong = kept(_wrong(kept(once), d))
    return wrong.join(ask(wrong.select("word"), d, "suggest"), "word")


def wrong_words(wrong: DataFrame, id_col: str) -> DataFrame:
    """The distinct wrong words of each text in order of first occurrence: id, word, place."""
    from pyspark.sql import Window

    first = wrong.groupBy(id_col, "word").agg(F.min("offset").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("first", "word"))).drop("first")


def bad_lines(docs: DataFrame, wrong: DataFrame, id_col: str, text_col: str, good: bool = False) -> DataFrame:
    """Lines that have a wrong word (or, with good, lines that have none): id, line, text."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "text")).select(id_col, (F.col("n") + 1).alias("line"), "text")
    bad = wrong.select(id_col, "line").distinct()
    return lines.join(bad, [id_col, "line"], "left_anti" if good else "left_semi")


def correct(docs: DataFrame, d: Dictionary, id_col: str, text_col: str, fmt: str = "text") -> DataFrame:
    """Texts with every wrong token that has suggestions replaced by the first: id, text, changes."""
    new = distinct_misspellings(docs, d, id_col, text_col, fmt).filter(F.size("suggestions") > 0).select("word", F.col("suggestions")[0].alias("new"))
    wrong = tokens(docs, id_col, text_col, fmt, d.wordchars).join(kept(new), "word")
    per = wrong.groupBy(id_col).agg(F.collect_list(F.struct("word", "offset", "line", "column", "new")).alias("changes"))
    joined = docs.select(id_col, text_col).join(per, id_col, "left")
    markup = fmt in ("html", "xml", "odf")

    def run(batches):
        for batch in batches:
            texts = []
            for x, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                texts.append(x if not changes else replace_tokens(x, [(Token(c["word"], c["offset"], c["line"], c["column"]), c["new"]) for c in changes], markup))
            counts = [len(c or ()) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[id_col, "text", "changes"])

    kind = joined.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, text string, changes int")


def change_morphology(docs: DataFrame, d: Dictionary, id_col: str, text_col: str, example_from: str, example_to: str) -> DataFrame:
    """Texts in which every word that is analysed like one example takes the form of another: id, text."""
    payload, version = docs.sparkSession.sparkContext.broadcast(d.payload), d.version

    def run(batches):
        from lexloom.operators.analyzer import signature

        e = engine_of(version, payload.value)
        wanted = {signature(a) for a in e.analyze(example_from)}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                changes = []
                for t in tokenize(text or "", "text", d.wordchars):
                    if any(signature(a) in wanted for a in e.analyze(t.word)):
                        new = e.generate(t.word, example_to)
                        if new and new[0] != t.word:
                            changes.append((t, new[0]))
                out.append(replace_tokens(text, changes) if text is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def sed_script(wrong: DataFrame, id_col: str) -> DataFrame:
    """One substitution per wrong token that has suggestions: id, line, script."""
    s = F.concat(F.lit("s/"), F.col("word"), F.lit("/"), F.col("suggestions")[0], F.lit("/"))
    return wrong.filter(F.size("suggestions") > 0).select(id_col, "line", s.alias("script"))


def pipe_lines(wrong: DataFrame, checked: DataFrame, id_col: str) -> DataFrame:
    """The classic answer line of each distinct word: * right, + root of an affixed word, - compound, & with suggestions, # without.

    checked: word, correct, compound, root; wrong: word, column, suggestions.
    """
    ok = checked.filter("correct").select("word", F.when(F.col("compound"), "-").when(F.col("root") != "", F.concat(F.lit("+ "), F.col("root"))).otherwise("*").alias("answer"))
    bad = wrong.select("word", "column", "suggestions").groupBy("word").agg(F.min("column").alias("column"), F.first("suggestions").alias("s"))
    n = F.size("s")
    line = F.when(n > 0, F.concat(F.lit("& "), F.col("word"), F.lit(" "), n, F.lit(" "), F.col("column"), F.lit(": "), F.array_join("s", ", "))).otherwise(F.concat(F.lit("# "), F.col("word"), F.lit(" "), F.col("column")))
    return ok.unionByName(bad.select("word", line.alias("answer")))


def from_lines(lines: DataFrame, id_col: str, line_col: str, text_col: str) -> DataFrame:
    """Documents from their lines, as markup goes over line ends: id, text. One row per line; numbers set the order."""
    rows = lines.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(line_col).alias("n"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))).alias("l"))
    return rows.select(id_col, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def first_word_lines(docs: DataFrame, wrong: DataFrame, id_col: str, text_col: str, fmt: str = "text", wordchars: str = "", good: bool = False) -> DataFrame:
    """Lines whose first word is wrong (or, with good, right): id, line, text."""
    first = tokens(docs, id_col, text_col, fmt, wordchars).groupBy(id_col, "line").agg(F.min("column").alias("column"))
    bad = wrong.select(id_col, "line", "column").distinct()
    chosen = first.join(bad, [id_col, "line", "column"], "left_anti" if good else "left_semi").select(id_col, "line")
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "text")).select(id_col, (F.col("n") + 1).alias("line"), "text")
    return lines.join(chosen, [id_col, "line"], "left_semi")


def save_personal(words: DataFrame, path: str) -> None:
    """Append words to a personal dictionary folder, one a line."""
    words.select(F.col(words.columns[0]).cast("string")).dropna().distinct().write.mode("append").text(path)
