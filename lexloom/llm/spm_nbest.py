"""SentencePiece encoding and decoding with exact n-best segmentation.

A text's segmentations are the paths through its piece lattice; a path's score is the sum of its pieces' scores. A
forward Viterbi pass finds the best score of every prefix. A backward A-star search from the end uses those scores as its
heuristic: they are exact, so complete paths come out in order of score and no node is left more than n times.

No piece goes over certain neighbouring characters (a word's last character and the next word's space mark, among
others), so lattices of the parts between them are independent: parts are searched one by one, each new part once, and a
document's n best segmentations combine its parts' alternatives. Only the n-1 parts with the smallest losses can differ
from their best segmentation in any of those.

A character that is no piece is spelled in byte pieces and scores as the library's unknown piece: the lowest score of
any piece, less 10.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .tokenizing import runs

SPACE, N_BEST, MOST_PARTS = "▁", 3, 700_000
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_RUN = re.compile(r" +[^ ]*")
_OPEN: dict[str, "Lattice"] = {}


class Lattice:
    """The pieces of a model file and the searches over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in normal}
        self.unknown = min(sp.get_score(i) for i in normal) - 10
        # A tree of characters; a node is (children, ids or None, score).
        self.root: dict[str, tuple] = {}
        for p, (i, score) in sorted(pieces.items(), key=lambda x: len(x[0])):
            level = self.root
            for c in p[:-1]:
                if c not in level:
                    level[c] = ({}, None, 0.0)
                level = level[c][0]
            level[p[-1]] = (level[p[-1]][0] if p[-1] in level else {}, array("I", [i]).tobytes(), score)
        self.together = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        byte = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte = [array("I", [byte[b]]).tobytes() if byte else array("I", [sp.unk_id()]).tobytes() for b in range(256)]
        self.text = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.known: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.units: dict[str, tuple] = {}

    def _spelled(self, char: str) -> bytes:
        return b"".join([self.byte[b] for b in char.encode("utf-8", "surrogatepass")])

    def edges(self, part: str, i: int):
        """(end, ids, score) of the pieces that start at character i."""
        first = self.root.get(part[i])
        if first is None or first[1] is None:
            yield i + 1, self._spelled(part[i]), self.unknown
        level = self.root
        for j in range(i, len(part)):
            node = level.get(part[j])
            if node is None:
                return
            level = node[0]
            if node[1] is not None:
                yield j + 1, node[1], node[2]

    def best(self, part: str) -> tuple[bytes, float, float]:
        """Viterbi: ids and score of the best path, and how much less the second best has."""
        n, root = len(part), self.root
        one, two, back = [0.0] + [-inf] * n, [-inf] * (n + 1), [None] * (n + 1)
        for i in range(n):
            a, level, j = one[i], root, i
            while j < n:
                node = level.get(part[j])
                if node is None:
                    if j == i:
                        ids, c = self._spelled(part[i]), a + self.unknown
                        j += 1
                        if c > one[j]:
                            two[j] = max(one[j], two[i] + self.unknown)
                            one[j], back[j] = c, (i, ids)
                        elif c > two[j]:
                            two[j] = c
                    break
                level, ids, s = node
                j += 1
                if ids is None:
                    if j > i + 1:
                        continue
                    ids, s = self._spelled(part[i]), self.unknown
                c = a + s
                if c > one[j]:
                    d = two[i] + s
                    two[j] = d if d > one[j] else one[j]
                    one[j], back[j] = c, (i, ids)
                elif c > two[j]:
                    two[j] = c
        ids, j = [], n
        while j:
            j, x = back[j]
            ids.append(x)
        ids.reverse()
        return b"".join(ids), one[n], one[n] - two[n]

    def n_best(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """The n best paths (score, ids), by A-star from the end; fewer if there are fewer."""
        size = len(part)
        forward, into = [0.0] + [float("-inf")] * size, [[] for _ in range(size + 1)]
        for i in range(size):
            for j, ids, s in self.edges(part, i):
                into[j].append((i, ids, s))
                forward[j] = max(forward[j], forward[i] + s)
        heap, left, out, turn = [(-forward[size], 0, size, 0.0, None)], [0] * (size + 1), [], 0
        while heap and len(out) < n:
            _, _, at, after, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((after, b"".join(ids)))
                continue
            left[at] += 1
            if left[at] > n:
                continue
            for i, ids, s in into[at]:
                turn += 1
                heapq.heappush(heap, (-(forward[i] + s + after), turn, i, s + after, (ids, path)))
        return out

    @staticmethod
    def parts(text: str) -> list[str]:
        """Keys of the parts of a text: a word for a space mark and the word, with its spaces if they are several, and
        a line end with what follows it, to which no space mark belongs."""
        if not text:
            return []
        if SPACE in text:  # stands for a space in the lattice as well
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] in " \n" or " \n" in text:
            return [x[1:] if x[1:2] not in (" ", "\n") else x for x in _RUN.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def marked(key: str) -> str:
        return key if key[:1] == "\n" else key.replace(" ", SPACE) if key[:1] == " " else SPACE + key

    def _value(self, key: str) -> tuple[bytes, float, float]:
        v = self.known.get(key)
        if v is None:
            v = self.known[key] = self.old[key] if key in self.old else self._learn(key)
        return v

    def _unit(self, part: str) -> tuple[bytes, float, float]:
        v = self.units.get(part)
        if v is None:
            if len(self.units) > 50_000:
                self.units = {}
            v = self.units[part] = self.best(part)
        return v

    def _learn(self, key: str) -> tuple[bytes, float, float]:
        part = self.marked(key)
        if part[1:].isalpha() and part[0] == SPACE and len(part) < 64:
            return self.best(part)
        stem = key.rstrip(_MARKS)
        if stem != key and stem.isalpha() and key[len(stem) - 1 : len(stem) + 1] not in self.together:
            found = [self._value(stem), self._unit(key[len(stem) :])]
        else:
            cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self.together]
            found = [self._unit(part[a:b]) for a, b in zip([0, *cuts], [*cuts, len(part)])]
        return b"".join([x[0] for x in found]), sum([x[1] for x in found]), min([x[2] for x in found])

    def encode(self, texts: list[str], n: int = N_BEST) -> list[list[tuple[float, bytes]]]:
        """The n best segmentations (score, ids as little-endian 32-bit bytes) of each text, the Viterbi one first.

        An empty text has one, the empty segmentation. Equal scores: the earlier part changes first.
        """
        cut = [self.parts(t) for t in texts]
        if len(self.known) > MOST_PARTS:
            self.old, self.known = self.known, {}
        known = self.known
        for key in set().union(*cut).difference(known):
            self._value(key)
        out = []
        for keys in cut:
            found = [known[k] for k in keys]
            best, total = [x[0] for x in found], sum([x[1] for x in found])
            result = [(0.0, ())]
            if n > 1:
                losses = [x[2] for x in found]
                for _ in range(min(n - 1, len(losses))):  # the parts that lose least by their second best, the first of equals
                    least = min(losses)
                    if least == inf:
                        break
                    at = losses.index(least)
                    losses[at] = inf
                    own = found[at][1]
                    others = [(own - s, ids) for s, ids in self.n_best(self.marked(keys[at]), n + 1) if ids != best[at]][: n - 1]
                    more = [(a + b, (*c, (at, ids))) for a, c in result for b, ids in others]
                    result = sorted(result + more, key=lambda x: x[0])[:n]
            lists = []
            for loss, changes in result:
                ids = best
                if changes:
                    ids = list(best)
                    for at, x in changes:
                        ids[at] = x
                lists.append((total - loss, b"".join(ids)))
            out.append(lists)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, byte pieces as bytes, space marks as spaces but for the one put in front."""
        data = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def lattice(path: str) -> Lattice:
    """One for each file and worker."""
    if path not in _OPEN:
        _OPEN[path] = Lattice(path)
    return _OPEN[path]


def _encode(path: str, n: int, whole: bool):
    def run(batches):
        model = lattice(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in runs([len(t) for t in texts]):
                rows = []
                for text, best in zip(texts[a:b], model.encode(texts[a:b], n), strict=True):
                    back = model.decode(best[0][1])
                    rows.append((
                        len(best[0][1]) // 4, zlib.crc32(best[0][1]), best[0][0], len(best), ",".join(f"{s:.0f}" for s, _ in best),
                        ",".join(str(zlib.crc32(i)) for _, i in best), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text,
                        *[[np.frombuffer(i, "<u4").astype(np.int32).tolist() for _, i in best]] * whole,
                    ))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), *[pa.list_(pa.list_(pa.int32()))] * whole]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *_NAMES, *["segmentations"] * whole])

    return run


_NAMES = ["n_pieces", "ids_crc32", "score", "n_best", "scores", "crcs", "decoded_sha256", "same_text"]


def encode_n_best(docs: DataFrame, model: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per document: the best segmentation's length, checksum and score, all n scores and checksums, and the
    digest of the best one decoded again (same_text: equal to the text; a text's own U+2581 comes back as a space).

    Null text: empty, no pieces, one empty segmentation. With whole, segmentations has the ids of all n. Repeated rows
    give repeated results; an empty table no rows; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_pieces long, ids_crc32 long, score double, n_best int, scores string, crcs string, decoded_sha256 string, same_text boolean"
    return d.mapInArrow(_encode(model, n, whole), schema + ", segmentations array<array<int>>" * whole)
