"""The queries over the driver's tables, by the operators of this package with the small dictionary, and their SQL twins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.casing import kind_col
from lexloom.functions.similar import LONGER_WORSE, ngram_score_col
from lexloom.functions.tokens import LATIN_ENTITIES, placed_words_col, words_col
from lexloom.operators import frames, texts
from lexloom.plans import mini
from lexloom.plans.relational import NUMBER, Plan, check

FLAGSHIP = "spell_misspelled_per_doc"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode(words_col(F.col("text"))).alias("word"))


def _verdicts(spark: SparkSession, tokens: DataFrame) -> DataFrame:
    return check(tokens.select("word"), mini.dictionary()).select("word", "correct")


def _counts(tokens: DataFrame, key: str) -> DataFrame:
    """How often each word stands in each text. The filter holds for all rows; for it every reader needs the count, so that
    readers share one exchange, and texts are read and cut into words once."""
    return tokens.groupBy(key, "word").agg(F.count("*").alias("n")).filter("n > 0")


def _long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


# tokens and words


def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_col(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", _long(F.size(words), "n_tokens"), _long(F.size(F.array_distinct(words)), "n_words"))


def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(placed_words_col("text")).alias("t"))
    return t.groupBy("conv_id", "turn").agg(_long(F.count("*"), "n_tokens"), _long(F.max("t.start"), "last_start"), _long(F.sum(F.col("t.start")), "sum_start"))


def case_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select("word").distinct()
    return words.groupBy(kind_col(F.col("word")).alias("kind")).agg(_long(F.count("*"), "n_words"))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.explode(F.split("text", "[ \n]")).alias("word")
    return _table(spark, sf_dir, "documents").select(part).filter(F.col("word").rlike(NUMBER)).groupBy("word").agg(_long(F.count("*"), "n"))


# checking


def spell_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, _tokens(_table(spark, sf_dir, "documents"), "doc_id"))


def spell_misspelled_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(_table(spark, sf_dir, "documents"), "doc_id")
    counts = _counts(tokens, "doc_id")
    wrong = F.sum(F.when(F.col("correct"), 0).otherwise(F.col("n")))
    return counts.join(_verdicts(spark, counts), "word").groupBy("doc_id").agg(_long(F.sum("n"), "n_tokens"), _long(wrong, "n_wrong"))


def spell_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tokens = _tokens(docs.withColumnRenamed("lang", "key"), "key")
    counts = _counts(tokens, "key")
    return counts.join(_verdicts(spark, counts), "word").groupBy(F.col("key").alias("lang")).agg(_long(F.sum("n"), "n_tokens"), _long(F.sum(F.when(F.col("correct"), F.col("n")).otherwise(0)), "n_right"))


def wrong_words_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words_col(F.col("text"))).alias("offset", "word"))
    wrong = t.join(_verdicts(spark, t).filter("NOT correct"), "word", "left_semi").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    out = texts.wrong_words(wrong, "id")
    return out.select("id", "word", _long(F.col("place"), "place"))


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    t = lines.select("doc_id", "n", F.explode(words_col(F.col("text"))).alias("word"))
    return t.join(_verdicts(spark, t), "word").groupBy("doc_id", "n").agg(F.bool_and("correct").alias("ok")).groupBy("doc_id").agg(_long(F.sum((~F.col("ok")).cast("int")), "n_bad"), _long(F.count("*"), "n_lines"))


def broken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", "[ \n]")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws("-", F.try_element_at(words, i), F.try_element_at(words, i + 1)))
    t = _table(spark, sf_dir, "benchmark").select(F.explode(pairs).alias("word")).filter(F.col("word").rlike(r"^[a-z]+-[a-z]+$")).distinct()
    return Plan(spark, mini.dictionary()).broken(t, ["-"])


def has_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select("word").distinct()
    listed = mini.dictionary().lexicon(spark).filter("NOT hidden").select("word").distinct()
    return words.join(F.broadcast(listed), "word", "left_semi")  # a dictionary's words


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mini.dictionary().lexicon(spark).filter("NOT hidden").agg(_long(F.count_distinct("word"), "n_words"))


def overlay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select("word")
    lists = spark.createDataFrame([(w, True) for w in mini.ALLOWED] + [(w, False) for w in mini.FORBIDDEN], "word string, allowed boolean")
    return frames.overlay(t, lists, _verdicts(spark, t))


def compound_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(_table(spark, sf_dir, "documents"), "doc_id")
    wrong = _verdicts(spark, t).filter("NOT correct").select("word")
    return Plan(spark, mini.dictionary()).compounds(wrong, ord("Y"))


# morphology


def expand_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Plan(spark, mini.dictionary()).expand().select("stem", "form", _long(F.col("path"), "path"))


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select(F.col("word").alias("form"))
    return Plan(spark, mini.dictionary()).derivations(words).select("form", "stem", _long(F.col("path"), "path"), _long(F.col("entry_no"), "entry_no"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select("word")
    return Plan(spark, mini.dictionary()).analyses(words).select("word", "analysis")


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select("word")
    return Plan(spark, mini.dictionary()).analyses(words).select("word", "stem").distinct()


def stems_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select("word")
    return frames.ask(words, mini.dictionary(), "stem").select("word", F.array_join("stems", ",").alias("stems"))


def suffix_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select("word")
    found = frames.ask(words, mini.dictionary(), "suffix_forms")
    return found.select("word", F.explode("forms").alias("form"))


def generated_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _tokens(_table(spark, sf_dir, "documents"), "doc_id").select("word", F.lit("moved").alias("example"))
    return frames.generate(words, mini.dictionary()).select("word", "example", F.array_join("forms", ",").alias("forms"))


# corrections


def _wrong_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(_table(spark, sf_dir, "benchmark"), "item_id")
    return _verdicts(spark, t).filter("NOT correct").select("word")


def _wrong_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(_table(spark, sf_dir, "documents"), "doc_id")
    return _verdicts(spark, t).filter("NOT correct").select("word")


def edit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right words one mistake away: exchanged neighbours, one letter more, one less, another."""
    wrong = _wrong_of_benchmark(spark, sf_dir)
    n, w = F.length("word"), F.col("word")
    piece = lambda a, k: F.substring(w, a, k)
    places = F.sequence(F.lit(1), n)
    swapped = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(piece(F.lit(1), i - 1), piece(i + 1, F.lit(1)), piece(i, F.lit(1)), piece(i + 2, n))))
    extra = F.when(n > 1, F.transform(places, lambda i: F.concat(piece(F.lit(1), i - 1), piece(i + 1, n))))
    letters = F.split(F.lit(mini.TRY), "")
    put = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(letters, lambda c: F.concat(piece(F.lit(1), i), c, piece(i + 1, n)))))
    other = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(piece(F.lit(1), i - 1), c, piece(i + 1, n)))))
    kinds = [("swap", swapped), ("extra", extra), ("forgotten", put), ("wrong", other)]
    rows = None
    for name, c in kinds:
        part = wrong.select("word", F.lit(name).alias("kind"), F.explode(F.array_distinct(c)).alias("candidate"))
        rows = part if rows is None else rows.unionByName(part)
    known = Plan(spark, mini.dictionary()).expand().select(F.col("form").alias("candidate")).distinct()
    return rows.filter("candidate <> word").join(known, "candidate", "left_semi").select("word", "kind", "candidate")


def rep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right words that a replacement rule makes of wrong ones, at any place where its pattern stands."""
    wrong, w = _wrong_of_benchmark(spark, sf_dir), F.col("word")
    rules = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(mini.REPLACEMENTS)], "seq int, pattern string, out string")
    hit = wrong.join(F.broadcast(rules), F.contains("word", "pattern"))  # a dictionary's few rules
    n, m = F.length("word"), F.length("pattern")
    hit = hit.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))))).filter(F.substring(w, F.col("i"), m) == F.col("pattern"))
    made = hit.select("word", "pattern", F.concat(F.substring(w, F.lit(1), F.col("i") - 1), F.col("out"), F.substring(w, F.col("i") + m, n)).alias("candidate"))
    known = Plan(spark, mini.dictionary()).expand().select(F.col("form").alias("candidate")).distinct()
    return made.join(known, "candidate", "left_semi").select("word", "pattern", "candidate").distinct()


def word_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong words that are two right ones written together."""
    wrong, w, n = _wrong_of_benchmark(spark, sf_dir).filter("length(word) >= 3"), F.col("word"), F.length("word")
    cut = wrong.withColumn("i", F.explode(F.sequence(F.lit(1), n - 1)))
    cut = cut.select("word", F.substring(w, F.lit(1), F.col("i")).alias("a"), F.substring(w, F.col("i") + 1, n).alias("b"))
    known = Plan(spark, mini.dictionary()).expand().select("form").distinct()
    both = cut.join(known.withColumnRenamed("form", "a"), "a", "left_semi").join(known.withColumnRenamed("form", "b"), "b", "left_semi")
    return both.select("word", F.concat_ws(" ", "a", "b").alias("candidate"))


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, d = _table(spark, sf_dir, "documents"), mini.dictionary()
    wrong = texts.distinct_misspellings(docs, d, "doc_id", "text")
    return texts.pipe_lines(wrong, frames.ask(_tokens(docs, "doc_id").select("word"), d, "check"), "doc_id")


def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of listed words whose length is within 4 of a wrong word's, by joining on each such length."""
    wrong = _wrong_of_benchmark(spark, sf_dir).withColumn("n", F.explode(F.sequence(F.length("word") - 4, F.length("word") + 4)))
    listed = mini.dictionary().lexicon(spark).filter("NOT hidden").select(F.col("word").alias("root")).distinct().withColumn("n", F.length("root"))
    score = ngram_score_col(3, F.col("word"), F.lower("root"), LONGER_WORSE)
    return wrong.join(F.broadcast(listed), "n").select("word", "root", _long(score, "score")).filter("score > 3")


def close_list_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = spark.createDataFrame([(w, True) for w in mini.ALLOWED] + [(w, False) for w in mini.FORBIDDEN], "word string, allowed boolean")
    out = frames.close_words(_wrong_of_documents(spark, sf_dir), lists)
    return out.select("word", "suggestion", _long(F.col("distance"), "distance"), _long(F.col("place"), "place"))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.ask(_wrong_of_documents(spark, sf_dir), mini.dictionary(), "suggest")
    return found.select("word", F.array_join("suggestions", ",").alias("suggestions"))


# texts


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")


def check_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.misspellings(_turns(spark, sf_dir), mini.dictionary(), "id", "text")


def check_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.misspellings(_table(spark, sf_dir, "pages"), mini.dictionary(), "page_id", "html", "html")


def corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return texts.correct(docs, mini.dictionary(), "doc_id", "text")


def stream_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of files, checked batch by batch."""
    from lexloom.streaming.checking import check_stream

    at = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="lexloom-")).rstrip("/")
    at = f"{at}/stream-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    name = "conversations.parquet"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*" if name else sf_dir)
    docs = source.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    check_stream(docs, mini.dictionary(), f"{at}/out", f"{at}/state", "id", "text").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("id", "word", "line", "column")


_QUERIES = [
    tokens_per_doc, token_places, case_kinds, number_words, spell_words, spell_misspelled_per_doc, spell_by_lang, wrong_words_in_order, bad_lines,
    broken_words, has_word, word_count, overlay_verdicts, compound_splits, expand_forms, derivations, analyses, stems, stems_by_engine, suffix_forms,
    generated_forms, edit_candidates, rep_candidates, word_splits, ngram_scores, answer_lines, close_list_words, suggestions, check_texts, check_pages, corrected_texts, stream_check,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


#: Tokens of conversations with their places, as tables for a WITH clause: addresses and paths are blanked out, then words
#: and what lies before each are lined up, and running totals give places.
_PATH_RX = r"[\p{L}\p{N}/][\p{L}\p{N}_\-\\.:/~%*$\[\]?!@]*"
_WORD_RX = rf"(?:[\p{{L}}\p{{Nl}}\p{{No}}\x{{300}}-\x{{36F}}]|&(?:{LATIN_ENTITIES});)+"
_SQL_PLACED = rf"""
turns AS (SELECT conv_id || ':' || turn AS id, text, regexp_split_to_array(text, '{_PATH_RX}') AS gaps, regexp_extract_all(text, '{_PATH_RX}') AS hits FROM conversations WHERE text IS NOT NULL),
clean AS (SELECT id, text, array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || CASE WHEN k > len(hits) THEN '' WHEN starts_with(hits[k], '/') OR contains(hits[k], '@') OR contains(hits[k], '://') OR contains(hits[k], ':\')
    THEN repeat(' ', length(hits[k])) ELSE hits[k] END), '') AS c FROM turns),
found AS (SELECT id, text, regexp_extract_all(c, '{_WORD_RX}') AS w, regexp_split_to_array(c, '{_WORD_RX}') AS g FROM clean),
lined AS (SELECT id, text, unnest(w) AS word, unnest(g[:len(w)]) AS gap, generate_subscripts(w, 1) AS k FROM found WHERE len(w) > 0),
begun AS (SELECT *, (sum(length(gap) + length(word)) OVER (PARTITION BY id ORDER BY k) - length(word))::BIGINT AS pos FROM lined),
tokens AS (SELECT id, word, (sum(strlen(substr(text, pos - length(gap) + 1, length(gap))) + strlen(word)) OVER o - strlen(word))::INTEGER AS "offset", (1 + sum(length(gap) - length(replace(gap, chr(10), ''))) OVER o)::INTEGER AS line,
    (pos - coalesce(max(CASE WHEN contains(gap, chr(10)) THEN pos - length(string_split(gap, chr(10))[-1]) END) OVER o, 0))::INTEGER AS "column" FROM begun WINDOW o AS (PARTITION BY id ORDER BY k))
"""


def oracle_sql() -> dict[str, str]:
    t, docs, forms, verdict, rx = mini.sql_tokens, mini.sql_tokens("documents", "doc_id"), mini.SQL_FORMS, mini.SQL_VERDICT, mini.WORD_RX
    bench = t("benchmark", "item_id")
    wrong = f"WITH {bench}, {forms}, {verdict}, bad AS (SELECT word FROM verdict WHERE NOT correct)"
    lists = f"allowed(word) AS (VALUES {', '.join(f'({mini._value(w)})' for w in mini.ALLOWED)}), banned(word) AS (VALUES {', '.join(f'({mini._value(w)})' for w in mini.FORBIDDEN)})"
    probes = "probes2 AS (SELECT word, word AS form, 0 AS f FROM words UNION ALL SELECT word, lower(word), 1 FROM words WHERE kind IN ('init', 'all') UNION ALL SELECT word, upper(left(lower(word), 1)) || substr(lower(word), 2), 2 FROM words WHERE kind = 'all')"
    stem = "CASE WHEN contains(data, 'st:') THEN '' ELSE ' st:' || stem END"
    data = "CASE WHEN data = '' THEN '' ELSE ' ' || data END"
    analysis = f"""CASE WHEN path = 0 THEN {stem} || {data}
        WHEN path = 1 THEN CASE WHEN pmorph = '' THEN NULL ELSE ' ' || pmorph || {stem} || CASE WHEN data = '' THEN ' fl:' || pflag ELSE ' ' || data END END
        ELSE CASE WHEN path = 3 THEN '' WHEN pmorph = '' THEN ' fl:' || pflag ELSE pmorph || ' ' END || {stem} || {data} || CASE WHEN smorph = '' THEN ' fl:' || sflag ELSE ' ' || smorph END END"""
    hits = lambda k: f"len(list_filter(range(1, greatest(length(word) - {k - 1}, 0) + 1), lambda i: contains(low, substr(word, CAST(i AS INT), {k}))))"
    letters = "(SELECT unnest(string_split(" + mini._value(mini.TRY) + ", '')) AS c)"
    return {
        "tokens_per_doc": f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_words FROM (SELECT doc_id, regexp_extract_all(text, '{rx}') AS w FROM documents)",
        "token_places": f"""WITH lists AS (SELECT conv_id, turn, regexp_split_to_array(text, '{rx}') AS gaps, regexp_extract_all(text, '{rx}') AS words FROM conversations),
            tokens AS (SELECT conv_id, turn, length(unnest(words)) AS n, length(unnest(gaps[:len(words)])) AS gap, generate_subscripts(words, 1) AS k FROM lists WHERE len(words) > 0),
            placed AS (SELECT conv_id, turn, sum(gap + n) OVER (PARTITION BY conv_id, turn ORDER BY k) - n AS start FROM tokens)
            SELECT conv_id, turn, count(*) AS n_tokens, max(start)::BIGINT AS last_start, sum(start)::BIGINT AS sum_start FROM placed GROUP BY conv_id, turn""",
        "case_kinds": f"WITH {docs}, words AS (SELECT DISTINCT word FROM tokens) SELECT kind, count(*) AS n_words FROM (SELECT {mini.SQL_KIND} AS kind FROM words) GROUP BY kind",
        "number_words": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]')) AS word FROM documents) WHERE regexp_matches(word, '{NUMBER}') GROUP BY word",
        "spell_words": f"WITH {docs}, {forms}, {verdict} SELECT word, correct FROM verdict",
        "spell_misspelled_per_doc": f"WITH {docs}, {forms}, {verdict} SELECT doc_id, count(*) AS n_tokens, sum(CASE WHEN correct THEN 0 ELSE 1 END)::BIGINT AS n_wrong FROM tokens JOIN verdict USING (word) GROUP BY doc_id",
        "spell_by_lang": f"WITH {t('documents', 'lang')}, {forms}, {verdict} SELECT lang, count(*) AS n_tokens, sum(CASE WHEN correct THEN 1 ELSE 0 END)::BIGINT AS n_right FROM tokens JOIN verdict USING (word) GROUP BY lang",
        "wrong_words_in_order": f"""WITH lists AS (SELECT conv_id || ':' || turn AS id, regexp_extract_all(text, '{rx}') AS w FROM conversations), tokens AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM lists), {forms}, {verdict},
            first AS (SELECT id, word, min(pos) AS p FROM tokens WHERE word IN (SELECT word FROM verdict WHERE NOT correct) GROUP BY id, word) SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY p, word) AS place FROM first""",
        "bad_lines": f"""WITH lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), tokens AS (SELECT doc_id, n, unnest(regexp_extract_all(text, '{rx}')) AS word FROM lines), {forms}, {verdict}
            SELECT doc_id, sum(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS n_bad, count(*) AS n_lines FROM (SELECT doc_id, n, bool_and(correct) AS ok FROM tokens JOIN verdict USING (word) GROUP BY doc_id, n) GROUP BY doc_id""",
        "broken_words": f"""WITH {forms}, w AS (SELECT regexp_split_to_array(text, '[ \n]') AS w FROM benchmark), pairs AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '-' || w[i + 1])) AS word FROM w)
            SELECT word FROM pairs WHERE regexp_full_match(word, '[a-z]+-[a-z]+') AND split_part(word, '-', 1) IN (SELECT form FROM forms) AND split_part(word, '-', 2) IN (SELECT form FROM forms)""",
        "has_word": f"WITH {docs}, {forms} SELECT DISTINCT word FROM tokens WHERE word IN (SELECT word FROM lexicon)",
        "word_count": f"WITH {forms} SELECT count(DISTINCT word) AS n_words FROM lexicon",
        "overlay_verdicts": f"""WITH {docs}, {forms}, {verdict}, {lists}, {probes} SELECT word, CASE WHEN word IN (SELECT word FROM banned) THEN false WHEN word IN (SELECT p.word FROM probes2 p JOIN allowed a ON a.word = p.form) THEN true ELSE correct END AS correct FROM verdict""",
        "compound_splits": f"""WITH {docs}, {forms}, {verdict}, parts AS (SELECT DISTINCT word AS part FROM lexicon WHERE contains(flags, 'Y')), cuts AS (SELECT word, left(word, i) AS l, substr(word, i + 1) AS r FROM (SELECT word, unnest(range(3, length(word) - 2))::INT AS i FROM verdict WHERE NOT correct AND length(word) >= 6))
            SELECT word, l AS "left", r AS "right" FROM cuts WHERE l IN (SELECT part FROM parts) AND r IN (SELECT part FROM parts)""",
        "expand_forms": f"WITH {forms} SELECT stem, form, path::BIGINT AS path FROM forms",
        "derivations": f"WITH {docs}, {forms} SELECT form, stem, path::BIGINT AS path, no::BIGINT AS entry_no FROM forms WHERE form IN (SELECT word FROM tokens)",
        "analyses": f"WITH {docs}, {forms}, {verdict}, {probes} SELECT DISTINCT word, analysis FROM (SELECT p.word, {analysis} AS analysis FROM probes2 p JOIN forms USING (form)) WHERE analysis IS NOT NULL",
        "stems": f"WITH {docs}, {forms}, {verdict}, {probes} SELECT DISTINCT word, stem FROM (SELECT p.word, stem, {analysis} AS analysis FROM probes2 p JOIN forms USING (form)) WHERE analysis IS NOT NULL",
        "edit_candidates": f"""{wrong}, edits AS (
            SELECT word, 'swap' AS kind, left(word, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) AS candidate FROM (SELECT word, unnest(range(1, length(word)))::INT AS i FROM bad)
            UNION SELECT word, 'extra', left(word, i - 1) || substr(word, i + 1) FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM bad WHERE length(word) > 1)
            UNION SELECT word, 'forgotten', left(word, i) || c || substr(word, i + 1) FROM (SELECT word, unnest(range(0, length(word) + 1))::INT AS i FROM bad), {letters}
            UNION SELECT word, 'wrong', left(word, i - 1) || c || substr(word, i + 1) FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM bad), {letters})
            SELECT DISTINCT word, kind, candidate FROM edits WHERE candidate <> word AND candidate IN (SELECT form FROM known)""",
        "rep_candidates": f"""{wrong}, rep(pattern, out) AS (VALUES {mini._rows(mini.REPLACEMENTS)}), made AS (SELECT word, pattern, left(word, i - 1) || out || substr(word, i + length(pattern)) AS candidate
            FROM (SELECT word, pattern, out, unnest(range(1, length(word) + 1))::INT AS i FROM bad, rep) WHERE substr(word, i, length(pattern)) = pattern) SELECT DISTINCT word, pattern, candidate FROM made WHERE candidate IN (SELECT form FROM known)""",
        "check_texts": f'WITH {_SQL_PLACED}, {forms}, {verdict} SELECT id, word, "offset", line, "column" FROM tokens WHERE word IN (SELECT word FROM verdict WHERE NOT correct)',
        "stream_check": f'WITH {_SQL_PLACED}, {forms}, {verdict} SELECT id, word, line, "column" FROM tokens WHERE word IN (SELECT word FROM verdict WHERE NOT correct)',
        "word_splits": f"""{wrong}, cuts AS (SELECT word, left(word, i) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word)))::INT AS i FROM bad WHERE length(word) >= 3)) SELECT word, a || ' ' || b AS candidate FROM cuts WHERE a IN (SELECT form FROM known) AND b IN (SELECT form FROM known)""",
        "suffix_forms": f"""WITH {docs}, {forms}, first AS (SELECT * FROM lexicon WHERE no IN (SELECT min(no) FROM lexicon GROUP BY word)) SELECT l.word, l.word || r.app AS form FROM first l JOIN rules r ON r.kind = 'S' AND contains(l.flags, r.flag)
            WHERE l.word IN (SELECT word FROM tokens) AND EXISTS (SELECT 1 FROM lexicon b WHERE b.word = l.word || r.strip AND contains(b.flags, r.flag) AND regexp_matches(b.word, r.cond))""",
        "ngram_scores": f"""{wrong}, pairs AS (SELECT b.word, l.word AS root, lower(l.word) AS low FROM bad b JOIN (SELECT DISTINCT word FROM lexicon) l ON abs(length(l.word) - length(b.word)) <= 4),
            counts AS (SELECT word, root, low, {hits(1)} AS a, {hits(2)} AS b, {hits(3)} AS c FROM pairs)
            SELECT word, root, score FROM (SELECT word, root, (a + CASE WHEN a >= 2 THEN b + CASE WHEN b >= 2 THEN c ELSE 0 END ELSE 0 END - greatest(length(root) - length(word) - 2, 0))::BIGINT AS score FROM counts) WHERE score > 3""",
    }
