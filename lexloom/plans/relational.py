"""Checking and morphology as joins.

A word's affix cuts are exploded, so that "a rule's text begins or ends the word" becomes an equality and Spark hashes
instead of comparing every rule with every word. Every first match is the least of explicit numbers. The plans hold for
dictionaries whose rules are one prefix and one suffix on listed words (Dictionary.has_simple_rules); what else a
dictionary has is decided by the engine for the words that the joins leave open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.casing import init_col, kind_col, lower_col
from lexloom.plans.dictionary import Dictionary
from lexloom.sources.rules import condition_regex

#: Tables of at most so many rows are broadcast; longer ones are joined by sorting.
BROADCAST_ROWS = 200_000
#: So many pairs of a prefix and a suffix are tried in one join; more, a side at a time.
PAIRS = 20_000
NUMBER = "^[0-9٠-٩۰-۹]+([,.-][0-9٠-٩۰-۹]+)*$"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Plan:
    """The joins of one dictionary."""

    def __init__(self, spark: SparkSession, d: Dictionary):
        self.spark, self.d = spark, d
        lex = d.lexicon(spark).select(F.col("word").alias("stem"), F.col("flags").alias("own"), "entry_no", F.col("morph").alias("data"), "hidden")
        self.n_words, self.n_rules = len(d.engine.order), len(d.rules.affixes)
        self.every = _small(lex, self.n_words)  # with the capitalised rows that only stand for words in capitals
        self.lexicon = _small(lex.filter("NOT hidden").drop("hidden"), self.n_words)
        rules = d.affixes(spark).select("seq", "flag", "strip", "append", "cond", "cross", F.col("morph").alias("rule_morph"))
        kinds = d.affixes(spark).select("seq", "kind")
        rules = rules.join(F.broadcast(kinds), "seq") if self.n_rules <= BROADCAST_ROWS else rules.join(kinds, "seq")
        self.prefixes = rules.filter("kind = 'P'").drop("kind")
        self.suffixes = rules.filter("kind = 'S'").drop("kind")
        self.pairs = self._pairs()
        self.most = {k: max([len(a.append) for a in d.rules.affixes if a.kind == k], default=-1) for k in "PS"}

    # cuts

    def _pairs(self) -> DataFrame | None:
        """Every pair of a prefix or none and a suffix or none that may stand together; None if they are too many."""
        affixes = self.d.rules.affixes
        pre = [a for a in affixes if a.kind == "P"]
        suf = [a for a in affixes if a.kind == "S"]
        if (len(pre) + 1) * (len(suf) + 1) > PAIRS:
            return None
        cond = lambda a: condition_regex(a.cond, a.kind) or None
        none = (None, None, "", "", None, None)
        p_rows = [none, *((a.seq, a.flag, a.strip, a.append, cond(a), a.morph or None) for a in pre)]
        s_rows = [none, *((a.seq, a.flag, a.strip, a.append, cond(a), a.morph or None) for a in suf)]
        cross = {a.seq: a.cross for a in affixes}
        rows = [(*x, *y, (0 if y[0] is None else 3) if x[0] is None else 1 if y[0] is None else 2) for x in p_rows for y in s_rows if x[0] is None or y[0] is None or cross[x[0]] and cross[y[0]]]
        schema = ", ".join(f"{k}_seq int, {k}_flag int, {k}_strip string, {k}_append string, {k}_cond string, {k}_rule_morph string" for k in "PS")
        return F.broadcast(self.spark.createDataFrame(rows, schema + ", path int"))  # at most PAIRS rows

    def _by_pairs(self, f: DataFrame, col: str, keep: tuple) -> DataFrame:
        """Derivations by one join: every cut of a form at both ends meets the pair with those texts."""
        n, word = F.length(col), F.col(col)
        cut = f.filter(n > 0).withColumn("__i", F.explode(F.sequence(F.lit(0), F.least(F.lit(max(0, self.most["P"])), n))))
        cut = cut.withColumn("__j", F.explode(F.sequence(F.lit(0), F.least(F.lit(max(0, self.most["S"])), n - F.col("__i")))))
        i, j = F.col("__i"), F.col("__j")
        cut = cut.select(col, *keep, F.substring(word, F.lit(1), i).alias("__p"), F.substring(word, i + 1, n - i - j).alias("__m"), F.substring(word, n - j + 1, j).alias("__s"))
        hit = cut.join(self.pairs, (F.col("__p") == F.col("P_append")) & (F.col("__s") == F.col("S_append")))
        inner = F.concat("P_strip", "__m")
        hit = hit.filter((F.length(inner) > 0) & (F.length(F.concat("__m", "__s")) > 0))
        hit = hit.filter(F.col("P_cond").isNull() | F.rlike(F.concat(inner, F.col("__s")), F.col("P_cond")))
        hit = hit.withColumn("__stem", F.concat(inner, F.col("S_strip"))).filter(F.col("S_cond").isNull() | F.rlike(F.col("__stem"), F.col("S_cond")))
        hit = hit.join(self.every, F.col("__stem") == F.col("stem"))
        has = lambda k: F.col(f"{k}_flag").isNull() | F.array_contains("own", F.col(f"{k}_flag"))
        names = [col, *keep, "path", "stem", "entry_no", "data", "hidden", "P_seq", "P_flag", "P_rule_morph", "S_seq", "S_flag", "S_rule_morph"]
        return hit.filter(has("P") & has("S")).select(*names)

    def _cut(self, df: DataFrame, kind: str, text: str, out: str) -> DataFrame:
        """df with each rule of a kind whose text is at that end of a column, and the word without it in `out`."""
        rules = (self.prefixes if kind == "P" else self.suffixes).select(*[F.col(c).alias(f"{kind}_{c}") for c in ("seq", "flag", "strip", "append", "cond", "cross", "rule_morph")])
        n, word = F.length(text), F.col(text)
        k = F.explode(F.sequence(F.lit(0), F.least(F.lit(max(0, self.most[kind])), n - 1)))
        cut = df.filter(n > 0).withColumn("__k", k)
        piece = F.substring(word, F.lit(1), F.col("__k")) if kind == "P" else F.substring(word, n - F.col("__k") + 1, F.col("__k"))
        cut = cut.withColumn("__piece", F.when(F.col("__k") == 0, "").otherwise(piece))
        hit = cut.join(_small(rules, self.n_rules), F.col("__piece") == F.col(f"{kind}_append"))
        rest = F.substring(word, F.col("__k") + 1, n) if kind == "P" else F.substring(word, F.lit(1), n - F.col("__k"))
        base = F.concat(F.col(f"{kind}_strip"), rest) if kind == "P" else F.concat(rest, F.col(f"{kind}_strip"))
        hit = hit.withColumn(out, base)
        return hit.filter(F.col(f"{kind}_cond").isNull() | F.rlike(F.col(out), F.col(f"{kind}_cond"))).drop("__k", "__piece", f"{kind}_cond", f"{kind}_strip", f"{kind}_append")

    def derivations(self, forms: DataFrame, col: str = "form", keep: tuple = ()) -> DataFrame:
        """All ways from entries to forms: col, path (0 listed, 1 prefix, 2 prefix and suffix, 3 suffix), stem, entry_no,
        data, the rules' numbers, flags and morphology. Forms are taken once each, or with columns to keep as they come."""
        f = forms.select(col, *keep) if keep else forms.select(col).distinct()
        if self.pairs is not None:
            return self._by_pairs(f, col, keep)
        lexicon = self.every
        empty = {"P_seq": "int", "P_flag": "int", "P_rule_morph": "string", "S_seq": "int", "S_flag": "int", "S_rule_morph": "string"}
        names = [col, *keep, "path", "stem", "entry_no", "data", "hidden", *empty]

        def shaped(df: DataFrame, path: int) -> DataFrame:
            return df.withColumn("path", F.lit(path)).select(*[c if c in df.columns or c == "path" else F.lit(None).cast(empty[c]).alias(c) for c in names])

        parts = [shaped(f.join(lexicon, F.col(col) == F.col("stem")), 0)]
        if self.most["P"] >= 0:
            pre = self._cut(f, "P", col, "base")
            parts.append(shaped(pre.join(lexicon, F.col("base") == F.col("stem")).filter(F.array_contains("own", F.col("P_flag"))), 1))
            if self.most["S"] >= 0:
                both = self._cut(pre.filter("P_cross"), "S", "base", "base2").filter("S_cross")
                both = both.join(lexicon, F.col("base2") == F.col("stem")).filter(F.array_contains("own", F.col("P_flag")) & F.array_contains("own", F.col("S_flag")))
                parts.append(shaped(both, 2))
        if self.most["S"] >= 0:
            suf = self._cut(f, "S", col, "base")
            parts.append(shaped(suf.join(lexicon, F.col("base") == F.col("stem")).filter(F.array_contains("own", F.col("S_flag"))), 3))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # checking

    def forms(self, words: DataFrame) -> DataFrame:
        """Words with the forms that their case allows, in order: word, without dots, whether only its first letter is a capital,
        form, place."""
        w = words.columns[0]
        front = F.when(F.startswith(F.col(w), F.lit(" ")), F.ltrim(F.col(w))).otherwise(F.col(w))
        dots = F.endswith(F.col(w), F.lit("."))
        bare = F.when(dots, F.regexp_replace(front, r"\.+$", "")).otherwise(front)
        kind, small = kind_col(bare), lower_col(bare)
        own = F.when(kind == "init", F.array(bare, small)).when(kind == "all", F.array(bare, init_col(small), small)).when(kind == "mixed_init", F.array(bare, F.concat(lower_col(F.substring(bare, 1, 1)), F.substring(bare, 2, 2**31 - 1)))).otherwise(F.array(bare))
        both = F.when(dots, F.concat(own, F.transform(own, lambda x: F.concat(x, F.lit("."))))).otherwise(own)
        return words.select(F.col(w).alias("word")).filter("word IS NOT NULL").distinct().select("word", bare.alias("bare"), (kind == "init").alias("init"), F.posexplode(F.array_distinct(both)).alias("place", "form"))

    def check(self, words: DataFrame) -> DataFrame:
        """Distinct words of a one-column DataFrame: word, correct, root (of affixed words), path."""
        forms = self.forms(words)
        trivial = (F.col("bare") == "") | F.col("bare").rlike(NUMBER)
        order = F.struct("place", "path", "entry_no")
        best = F.struct("path", F.when(F.col("path") > 0, F.col("stem")).otherwise("").alias("root"))
        hits = self.derivations(forms, keep=("word", "place", "init")).filter("NOT (hidden AND init)").select("word", F.lit(False).alias("trivial"), order.alias("order"), best.alias("best"))
        none = {c: F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("order", "best")}
        every = forms.filter("place = 0").select("word", trivial.alias("trivial"), none["order"], none["best"]).unionByName(hits)
        joined = every.groupBy("word").agg(F.max("trivial").alias("trivial"), F.min_by("best", "order").alias("best"))
        long_ = F.octet_length("word") >= (300 if self.d.encoding == "utf-8" else 100)
        return joined.select(
            "word", ((F.col("trivial") | F.col("best").isNotNull()) & ~long_).alias("correct"),
            F.when(F.col("trivial") | long_, "").otherwise(F.coalesce("best.root", F.lit(""))).alias("root"), F.col("best.path").alias("path"),
        )

    def broken(self, wrong: DataFrame, breaks: list[str] | None = None, rounds: int = 10) -> DataFrame:
        """Words that are right in pieces at their break strings: splits are exploded, pieces checked, both sides needed.

        wrong: word, not right as a whole. Pieces that are wrong are split again, at most `rounds` times.
        """
        breaks = [b for b in (self.d.engine.breaks if breaks is None else breaks) if not b.startswith("^") and not b.endswith("$")]
        if not breaks:
            return wrong.select("word").filter(F.lit(False))
        known = None
        level = wrong.select("word").distinct()
        splits = []

        def places(mark: str) -> Column:
            """Where a break string stands inside a word."""
            starts = F.sequence(F.lit(1), F.greatest(F.length("word") - len(mark) - 1, F.lit(1)))
            return F.filter(F.transform(starts, lambda i: F.when(F.substring(F.col("word"), i + 1, F.lit(len(mark))) == mark, F.struct(i.alias("at"), F.lit(len(mark)).alias("n")))), lambda c: c.isNotNull())

        for _ in range(rounds):
            cuts = F.array_distinct(F.flatten(F.array(*map(places, breaks))))
            s = level.withColumn("cut", F.explode(cuts))
            s = s.select("word", F.substring(F.col("word"), F.lit(1), F.col("cut.at")).alias("left"), F.substring(F.col("word"), F.col("cut.at") + F.col("cut.n") + 1, F.length("word")).alias("right")).filter("left <> '' AND right <> ''")
            splits.append(s)
            pieces = s.select(F.explode(F.array("left", "right")).alias("word")).distinct()
            checked = self.check(pieces)
            known = checked if known is None else known.unionByName(checked).groupBy("word").agg(F.max("correct").alias("correct"), F.max("root").alias("root"), F.max("path").alias("path"))
            level = checked.filter("NOT correct").select("word").filter(F.concat(*[F.when(F.contains(F.col("word"), F.lit(b)), "x").otherwise("") for b in breaks]) != "")
            if level.isEmpty():
                break
        right = known.filter("correct").select(F.col("word").alias("piece"))
        for s in reversed(splits):
            ok = s.join(right.withColumnRenamed("piece", "left"), "left", "left_semi").join(right.withColumnRenamed("piece", "right"), "right", "left_semi").select(F.col("word").alias("piece")).distinct()
            right = right.unionByName(ok).distinct()
        return wrong.select("word").join(right, F.col("word") == F.col("piece"), "left_semi").distinct()

    def compounds(self, wrong: DataFrame, flag: int, least: int = 3) -> DataFrame:
        """Words made of two listed words that both have a flag: word, left, right."""
        cut = F.explode(F.sequence(F.lit(least), F.length("word") - least))
        s = wrong.select("word").distinct().filter(F.length("word") >= 2 * least).withColumn("at", cut)
        s = s.select("word", F.substring(F.col("word"), F.lit(1), F.col("at")).alias("left"), F.substring(F.col("word"), F.col("at") + 1, F.length("word")).alias("right"))
        parts = self.lexicon.filter(F.array_contains("own", F.lit(flag))).select("stem").distinct()
        return s.join(parts.withColumnRenamed("stem", "left"), "left", "left_semi").join(parts.withColumnRenamed("stem", "right"), "right", "left_semi").select("word", "left", "right")

    # morphology

    def analyses(self, words: DataFrame) -> DataFrame:
        """Analyses of distinct words: word, place, analysis, stem."""
        base = F.col("word")
        kind, small = kind_col(base), lower_col(base)
        own = F.when(kind == "init", F.array(small, base)).when(kind == "all", F.array(base, small, init_col(small))).otherwise(F.array(base))
        distinct = words.select(F.col(words.columns[0]).alias("word")).filter("word IS NOT NULL").distinct()
        forms = distinct.select("word", F.posexplode(F.array_distinct(own)).alias("form_no", "form"))
        hits = self.derivations(forms, keep=("word", "form_no"))
        flag = lambda c: F.concat(F.lit(" fl:"), self._flag_text(F.col(c)))
        data = F.coalesce(F.concat(F.lit(" "), F.col("data")), F.lit(""))
        stem = F.when(F.coalesce(F.contains(F.col("data"), F.lit("st:")), F.lit(False)), "").otherwise(F.concat(F.lit(" st:"), F.col("stem")))
        text = (
            F.when(F.col("path") == 0, F.concat(stem, data))
            .when(F.col("path") == 1, F.concat(F.concat(F.lit(" "), F.col("P_rule_morph")), stem, F.when(F.col("data").isNull(), flag("P_flag")).otherwise(data)))
            .otherwise(F.concat(F.when(F.col("path") == 3, "").otherwise(F.coalesce(F.concat(F.col("P_rule_morph"), F.lit(" ")), flag("P_flag"))), stem, data, F.coalesce(F.concat(F.lit(" "), F.col("S_rule_morph")), flag("S_flag"))))
        )
        rows = hits.withColumn("analysis", text).filter("analysis IS NOT NULL")
        order = F.struct("form_no", F.when(F.col("path") == 2, 1).otherwise(F.col("path")).alias("p"), F.coalesce("P_seq", F.lit(-1)).alias("ps"), F.coalesce("S_seq", F.lit(-1)).alias("ss"), "entry_no")
        own_stem = F.regexp_extract(F.coalesce("data", F.lit("")), r"st:(\S*)", 1)
        return rows.groupBy("word", "analysis").agg(F.min(order).alias("place"), F.min(F.when(own_stem != "", own_stem).otherwise(F.col("stem"))).alias("stem"))

    def _flag_text(self, c: Column) -> Column:
        mode = self.d.rules.flag_mode
        if mode == "num":
            return c.cast("string")
        if mode == "long":
            return F.concat(F.chr((c / 256).cast("int").cast("long")), F.chr((c % 256).cast("long")))
        return F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")

    def expand(self) -> DataFrame:
        """All forms of all entries: stem, form, path."""
        lex = self.lexicon.select("stem", "own", "entry_no")
        out = lex.select("stem", "entry_no", F.col("stem").alias("form"), F.lit(0).alias("path"))

        def put(df: DataFrame, kind: str, on: str, to: str) -> DataFrame:
            rules = (self.prefixes if kind == "P" else self.suffixes).select(*[F.col(c).alias(f"{kind}_{c}") for c in ("flag", "strip", "append", "cond", "cross")])
            hit = df.withColumn("__f", F.explode("own")).join(_small(rules, self.n_rules), F.col("__f") == F.col(f"{kind}_flag")).drop("__f")
            n, s = F.length(on), F.length(f"{kind}_strip")
            hit = hit.filter(n > s).filter(F.col(f"{kind}_cond").isNull() | F.rlike(F.col(on), F.col(f"{kind}_cond")))
            fits = F.startswith(F.col(on), F.col(f"{kind}_strip")) if kind == "P" else F.endswith(F.col(on), F.col(f"{kind}_strip"))
            made = F.concat(F.col(f"{kind}_append"), F.substring(F.col(on), s + 1, n)) if kind == "P" else F.concat(F.substring(F.col(on), F.lit(1), n - s), F.col(f"{kind}_append"))
            return hit.filter(fits).withColumn(to, made)

        suffixed = put(lex, "S", "stem", "form")
        out = out.unionByName(suffixed.select("stem", "entry_no", "form", F.lit(3).alias("path")))
        crossed = put(suffixed.filter("S_cross").drop("S_flag", "S_strip", "S_append", "S_cond"), "P", "form", "form2").filter("P_cross")
        out = out.unionByName(crossed.select("stem", "entry_no", F.col("form2").alias("form"), F.lit(2).alias("path")))
        prefixed = put(lex, "P", "stem", "form")
        return out.unionByName(prefixed.select("stem", "entry_no", "form", F.lit(1).alias("path")))


def check(words: DataFrame, d: Dictionary) -> DataFrame:
    """Verdicts on the distinct words of a one-column DataFrame: word, correct, root.

    Joins decide if the dictionary's rules are simple, and the engine for the words that have a break character in them;
    for other dictionaries the engine decides all.
    """
    from lexloom.operators.frames import ask

    spark, col = words.sparkSession, words.columns[0]
    words = words.select(F.col(col).alias("word"))
    if not d.has_simple_rules:
        return ask(words, d, "check").select("word", "correct", "root")
    marks = sorted({c for b in d.engine.breaks for c in b.strip("^$")})
    words = words.filter("word IS NOT NULL").distinct()
    split = F.length(F.translate("word", "".join(marks), "")) < F.length("word") if marks else F.lit(False)
    plain = Plan(spark, d).check(words.filter(~split)).select("word", "correct", "root")
    return plain.unionByName(ask(words.filter(split), d, "check").select("word", "correct", "root")) if marks else plain
