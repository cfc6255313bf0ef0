"""Best-fit packing planned over the histogram of piece lengths.

Documents become pieces of at most `capacity` ids. The plan is made on the driver from one count for each length (at
most `capacity` numbers, whatever the input): lengths from long to short, each into the fullest open sequence it fits,
many equal sequences at once. A plan row says that pieces of one length with ranks lo to lo+n-1 go to the sequences
seq to seq+n-1 at one offset. Pieces then take their slots by a join on length and rank. A rank is a count of equal
lengths in earlier partitions plus a position within the partition, so no length, however common, is gathered anywhere.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .tokenizing import encoder, runs

CAPACITY, END_ID = 1024, 2


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, lo, n, seq, offset) for counts by length. Sequences are numbered from 0 without gaps."""
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: runs (first sequence, how many)
    rows, opened = [], 0
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if free[r]), None)
            if room is None:
                n = -(-left // (capacity // length))
                free[capacity].append((opened, n))
                opened, room = opened + n, capacity
            seq, n = free[room].pop()
            take = min(n, left)
            if take < n:
                free[room].append((seq + take, n - take))
            free[room - length].append((seq, take))
            rows.append((length, rank, take, seq, capacity - room))
            rank, left = rank + take, left - take
    return rows


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches):
        enc, seen, part, end = encoder(path, True), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId(), np.uint32(END_ID).tobytes()
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).to_pylist()
            for a, b in runs([len(t) for t in texts]):
                out = [[] for _ in range(7 + with_ids)]
                for k, row in enumerate(enc.encode(texts[a:b]), a):
                    row += end
                    n = len(row) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for piece, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        got = row[4 * i : 4 * j]
                        for col, x in zip(out, (k, piece, i, j - i, zlib.crc32(got), part, seen[j - i], got)):
                            col.append(x)
                        seen[j - i] += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:7]), *(pa.array(x, pa.binary()) for x in out[7:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids],
                )

    return run


def _slots(rows: list[tuple[int, int, int, int, int]]):
    """Gives pieces the slots of a plan (no more rows than the square of the capacity, whatever the input): the plan row of
    a piece is the last one that begins at or before its length and rank."""
    length, lo, _, seq, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    begins = (length << 50) | lo

    def run(batches):
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank")}
            k = np.searchsorted(begins, (at["length"] << 50) | at["rank"], "right") - 1
            sequence = seq[k] + at["rank"] - lo[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset[k]), *batch.columns[6:]], names=[*batch.schema.names[:5], "sequence_id", "offset", *batch.schema.names[6:]]
            )

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as bytes, if asked for).

    A document's ids are those of its text (null: empty) and the end id, so even an empty text makes a piece of one id.
    Longer documents than `capacity` are cut from their end into full pieces; the first piece has what remains. Repeated
    rows are packed as often as they occur, null ids stay null, an empty table gives no rows, extra columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    s = Scratch(spark, "packing")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids binary" * with_ids
    pieces = s.cut(d.mapInArrow(_pieces(tokenizer, capacity, with_ids), schema), "pieces")
    counts = s.cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select(*pieces.columns[:5], (F.col("before") + F.col("nth")).alias("rank"), *["ids"] * with_ids)
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranked.mapInArrow(_slots(plan(total, capacity)), schema)
