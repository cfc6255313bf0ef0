"""Token ids in files of patched frame-of-reference blocks.

A block holds 128 ids. Its minimum is subtracted, the differences are packed at the width that a given share of them
fits (the percentile), and the others go to an exception list as (place, high bits). Blocks are gathered in chunks; a
chunk has its blocks' minima, widths, exception counts and the byte at which each block starts, so any block can be
read alone. The file ends with an index of its chunks and the documents' ids and lengths.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_new, open_old
from .scratch import Scratch, small_batches
from .tokenizing import encoder, runs

BLOCK, CHUNK_IDS, MAGIC, END_ID, PERCENTILE, FILE_CHARS = 128, 1 << 20, b"LXPF0001", 2, 90, 1 << 28


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of 32 values below 2**width, as rows of `width` 32-bit words."""
    out = np.zeros((len(v), width + 1), np.uint32)
    for i in range(32 if width else 0):
        word, bit = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(bit)
        if bit + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - bit)
    return out[:, :width]


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, bit = divmod(i * width, 32)
        x = words[:, word] >> np.uint32(bit)
        if bit + width > 32:
            x = x | (words[:, word + 1] << np.uint32(32 - bit))
        out[:, i] = x & mask
    return out


def encode_chunk(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A chunk: header, block table (minimum, width, exceptions, start), packed blocks, exception lists."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.empty(blocks * BLOCK, np.uint32)
    v[:n] = ids
    v[n:] = ids[-1] if n else 0
    v = v.reshape(blocks, BLOCK)
    low = v.min(1) if blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    nth = min(BLOCK - 1, int(BLOCK * percentile / 100))
    edge = np.partition(v, nth, axis=1)[:, nth] if blocks else low
    width = np.ceil(np.log2(edge.astype(np.float64) + 1)).astype(np.uint8)
    over = (v.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, place = np.nonzero(over)
    high = over[row, place]
    size = width.astype(np.uint64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.uint64)
    body = np.zeros(int(start[-1]) // 4, np.uint32)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            part = v[which] if w == 32 else v[which] & np.uint32((1 << int(w)) - 1)
            words = _pack(part.reshape(-1, 32), int(w)).reshape(len(which), -1)
            body[(start[which, None] // 4).astype(np.int64) + np.arange(words.shape[1])] = words
    many = np.bincount(row, minlength=blocks).astype(np.uint8)
    head = struct.pack("<QII", n, blocks, len(row))
    return b"".join([head, low.astype("<u4").tobytes(), width.tobytes(), many.tobytes(), start[:-1].astype("<u8").tobytes(), body.astype("<u4").tobytes(), place.astype(np.uint8).tobytes(), high.astype("<u4").tobytes()])


def decode_chunk(data: bytes) -> np.ndarray:
    n, blocks, odd = struct.unpack_from("<QII", data)
    at = 16

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, k, at)
        at += x.nbytes
        return x

    low, width, many, start = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u8", blocks)
    body = take("<u4", int(width.astype(np.int64).sum()) * (BLOCK // 32))
    place, high = take("u1", odd), take("<u4", odd)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            words = body[(start[which, None] // 4).astype(np.int64) + np.arange(int(w) * BLOCK // 32)]
            v[which] = _unpack(words.reshape(-1, int(w)), int(w)).reshape(len(which), BLOCK)
    row = np.repeat(np.arange(blocks), many)
    v[row, place] |= high << width[row].astype(np.uint32)
    return (v + low[:, None]).reshape(-1)[:n]


def decode_block(data: bytes, k: int) -> np.ndarray:
    """Block k of a chunk alone, by the table of starts; of the rest only the exception counts before it are read."""
    n, blocks, _ = struct.unpack_from("<QII", data)
    low, width = np.frombuffer(data, "<u4", blocks, 16), np.frombuffer(data, "u1", blocks, 16 + 4 * blocks)
    many, start = np.frombuffer(data, "u1", blocks, 16 + 5 * blocks).astype(np.int64), np.frombuffer(data, "<u8", blocks, 16 + 6 * blocks)
    body, w, before, odd = 16 + 14 * blocks, int(width[k]), int(many[:k].sum()), int(many.sum())
    v = _unpack(np.frombuffer(data, "<u4", w * BLOCK // 32, body + int(start[k])).reshape(-1, max(w, 1)), w).reshape(-1) if w else np.zeros(BLOCK, np.uint32)
    lists = body + int(width.astype(np.int64).sum()) * (BLOCK // 8)
    place, high = np.frombuffer(data, "u1", many[k], lists + before), np.frombuffer(data, "<u4", many[k], lists + odd + 4 * before)
    v[place] |= high << np.uint32(w)
    return (v + low[k])[: max(0, min(BLOCK, n - k * BLOCK))]


class Writer:
    """Writes one file; add() documents in order, then close()."""

    def __init__(self, folder: str):
        self.uri, self.out = open_new(folder, ".lxpf")
        self.out.write(MAGIC)
        self.at, self.held, self.waiting = len(MAGIC), [], 0
        self.chunks, self.docs, self.n_ids = [], [], 0

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * CHUNK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        v = np.frombuffer(b"".join(self.held), "<u4")
        cut = len(v) if last else len(v) // BLOCK * BLOCK
        for i in range(0, cut, CHUNK_IDS):
            data = encode_chunk(v[i : min(cut, i + CHUNK_IDS)])
            self.chunks.append((self.at, len(data), min(cut, i + CHUNK_IDS) - i))
            self.out.write(data)
            self.at += len(data)
        self.held, self.waiting = [v[cut:].tobytes()], 4 * (len(v) - cut)

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        ids = pa.array([d for d, _ in self.docs])
        table = pa.table({"doc_id": ids if len(ids) else pa.array([], pa.int64()), "n": pa.array([n for _, n in self.docs], pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        docs, index = sink.getvalue().to_pybytes(), json.dumps(self.chunks).encode()
        self.out.write(docs + index + struct.pack("<QQ", len(docs), len(index)) + MAGIC)
        self.out.close()
        return self.uri, len(self.docs), self.n_ids


def read_file(uri: str):
    """Yields lists of (doc_id, n, crc32 of the ids' bytes), document by document, a chunk in memory at a time."""
    with open_old(uri) as f:
        size = f.size()
        f.seek(size - 24)
        n_docs, n_index, magic = struct.unpack("<QQ8s", f.read(24))
        if magic != MAGIC:
            raise ValueError(f"{uri} has no index at its end")
        f.seek(size - 24 - n_index - n_docs)
        table = pa.ipc.open_stream(f.read(n_docs)).read_all()
        chunks = json.loads(f.read(n_index))
        ids, sizes = table.column("doc_id").to_pylist(), table.column("n").to_pylist()
        doc, need, crc, done = 0, sizes[0] if sizes else 0, 0, []
        for at, length, _ in chunks:
            f.seek(at)
            data = memoryview(decode_chunk(f.read(length)).astype("<u4").tobytes())
            i = 0
            while doc < len(sizes):
                j = min(i + 4 * need, len(data))
                crc = zlib.crc32(data[i:j], crc)
                need -= (j - i) // 4
                i = j
                if need:
                    break
                done.append((ids[doc], sizes[doc], crc))
                doc, crc = doc + 1, 0
                need = sizes[doc] if doc < len(sizes) else 0
            yield done
            done = []


def _write(path: str, folder: str):
    def run(batches):
        w, enc, end = None, encoder(path, False), np.uint32(END_ID).tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            w = w or Writer(folder)
            for a, b in runs([len(t) for t in texts]):
                for k, row in enumerate(enc.encode(texts[a:b]), a):
                    w.add(ids[k], row + end)
        if w:
            uri, docs, n = w.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [uri], "n_docs": [docs], "n_ids": [n]})

    return run


def write_token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids in ascending order of id; returns the manifest: part, path, n_docs, n_ids, first.

    The manifest is committed as a table, so files of lost attempts are never read. Null ids come first, rows of equal
    ids in the order of their text's hash. Null text: empty, that is the end id alone. Empty table: no files.
    """
    small_batches(docs.sparkSession)
    s = Scratch(docs.sparkSession, "token-ids")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Files of about FILE_CHARS characters, so that no task holds more than its documents' numbers and one chunk.
    size = d.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    files = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_CHARS))
    d = d.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    found = d.select("doc_id", "text").mapInArrow(_write(tokenizer, s.at("files")), "part long, path string, n_docs long, n_ids long")
    manifest = s.cut(found, "manifest")
    # One row per file: a running sum in one task.
    return manifest.withColumn("first", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))


def _read(batches):
    for batch in batches:
        for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for rows in read_file(uri):
                if rows:
                    n = np.array([r[1] for r in rows], np.int64)
                    start = first + np.cumsum(n) - n
                    first += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array(start), pa.array(n), pa.array([r[2] for r in rows], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """One row per document: doc_id, start (ids before it in all files), n_tokens, ids_crc32, decoded from the files.

    manifest: path and first of each file; an empty one gives no rows, extra columns are not read, null ids stay null."""
    files = manifest.select("path", "first")
    return files.repartition(max(1, files.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
