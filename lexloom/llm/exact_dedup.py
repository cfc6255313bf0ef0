"""Exact deduplication by deterministic block naming.

Every text (null counts as empty) is cut into fixed-size byte blocks; an empty text has one empty block. The distinct
blocks, each compared by its full content, are sorted and numbered, so equal blocks share one integer name and different
blocks never do. Then adjacent names of a document are paired, the distinct pairs are sorted and numbered, and so on
until every document has one name. A document's identity is (level, name): two texts have the same one exactly when
their bytes are equal.

Only distinct blocks travel with their bytes (equal ones meet on the map side first). A document's rows travel with
64-bit block hashes; where a hash stands for two different blocks, those blocks are named and joined by content instead,
so a hash collision changes nothing but the route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.arrays import quoted

from .scratch import Scratch

BLOCK_BYTES = 8192


def _named(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sort the distinct rows within their partitions and number them: partition number, then position."""
    return pairs.sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest id is kept; among rows that repeat that id as well, exactly one.
    Null text: as empty. Null ids: below every other id; keep_id is null only if the whole group has no id. Empty table:
    no rows. Extra columns are not read. hash_bits below 64 is for tests of the collision route.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "exact-dedup")
    d = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("bytes"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"CAST((octet_length(bytes) - 1) DIV {block_bytes} AS INT)"))),
        lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)),
    )

    def short(b: Column) -> Column:
        h = F.xxhash64(b)
        return h if hash_bits >= 64 else h.bitwiseAND(F.lit((1 << hash_bits) - 1))

    rows = s.cut(
        d.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("bytes", 256).alias("sha"),
            F.transform(blocks, short).alias("hashes"),
        ),
        "rows",
    )

    def content() -> DataFrame:
        return d.select(F.explode(blocks).alias("block")).select(short(F.col("block")).alias("h"), "block")

    names = s.cut(_named(content().distinct(), ["h", "block"], "name").select("h", "name"), "names")
    at = rows.select("rid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    clash = s.cut(names.groupBy("h").count().filter("count > 1").select("h"), "clash")
    if clash.isEmpty():
        units = at.join(names, "h").select("rid", "n", "pos", "name")
    else:
        units = _through_content(s, d, rows, names, clash, at, blocks, short)
    units = s.cut(units, "units0")
    done, level = [units.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")], 0
    while not (rest := units.filter("n > 1")).isEmpty():
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = s.cut(
            rest.groupBy("rid", "n", F.expr("pos DIV 2").cast("int").alias("pos")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
            ),
            f"pairs{level}",
        )
        fresh = s.cut(_named(pairs.select("a", "b").distinct(), ["a", "b"], "name"), f"names{level}")
        half = F.expr("CAST((n + 1) DIV 2 AS INT)").alias("n")
        units = s.cut(pairs.join(fresh, ["a", "b"]).select("rid", half, "pos", "name"), f"units{level}")
        done.append(units.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    ids = s.cut(rows.select("rid", "doc_id", "sha").join(named, "rid"), "ids")
    best = s.cut(
        ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")), "groups"
    )
    return ids.join(best, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _through_content(s, d, rows, names, clash, at, blocks, short) -> DataFrame:
    """Names where some hashes stand for several blocks: those blocks are numbered below zero and joined by content."""
    plain = at.join(names.join(clash, "h", "left_anti"), "h").select("rid", "n", "pos", "name")
    # The same scan as rows has: its order of rows may differ from run to run, so documents meet again by their hash.
    whole = d.select(F.sha2("bytes", 256).alias("sha"), F.posexplode(blocks).alias("pos", "block")).select("sha", "pos", "block", short(F.col("block")).alias("h"))
    whole = s.cut(whole.join(clash, "h", "left_semi").distinct(), "clash-blocks")
    fresh = s.cut(_named(whole.select("h", "block").distinct(), ["h", "block"], "k").select("h", "block", (-F.col("k") - 2).alias("name")), "clash-names")
    by_doc = whole.join(fresh, ["h", "block"]).select("sha", "pos", "name")
    at_sha = at.join(clash, "h", "left_semi").join(rows.select("rid", "sha"), "rid")
    return plain.unionByName(at_sha.join(by_doc, ["sha", "pos"]).select("rid", "n", "pos", "name"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names."""
    s = Scratch(docs.sparkSession, "keep-one")
    found = exact_dedup(docs, id_col, text_col)
    stay = s.cut(found.filter("kept").select("doc_id", "text_sha256"), "stay")
    twice = s.cut(found.groupBy("doc_id", "text_sha256").count().filter("count > 1").select("doc_id", "text_sha256"), "twice")
    sha = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    row = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(id_col).alias("own"), sha.alias("sha"))
    same = F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    held = row.join(stay, same, "left_semi")
    if not twice.isEmpty():
        held = held.join(twice, same, "left_anti").unionByName(held.join(twice, same, "left_semi").dropDuplicates(["own", "sha"]))
    return held.select("row.*")
