"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is the composition of

* the normaliser, compiled from the model file: its character map as a trie of
  which the longest match is taken, white space rules, spaces as U+2581;
* the lexicon: a trie of the pieces, each path emitting a piece id; characters
  that no piece covers fall back to byte pieces;
* the grammar: for a unigram model one state, an arc's weight is minus the
  piece's score; for a merge (BPE) model one state per piece, and an arc to the
  next piece has weight 0 if the merges leave the two side by side, else
  infinity. A sequence of pieces is the merges' result exactly if each two
  neighbours are, so the only path of finite weight is the encoding.

The result is composed with each input, state by state as the search needs
them, and the tropical shortest path is found by relaxing arcs from the lightest
state on, for both kinds of model.
No piece holds U+2581 behind another character, so every path passes through
the state between words; the words' paths are found once and remembered.

Defined results: null and empty texts give no ids; texts with U+2581 itself are
decoded with spaces there, and texts that the normaliser changes as it left
them, so their round trip is false; a chunk without a path of finite weight
falls apart into characters, or their bytes; unpaired surrogates become U+FFFD;
repeated rows are encoded each for themselves; an empty table gives no rows;
extra columns are ignored. Models with user-defined symbols are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import table

SPACE = "▁"
INFINITE = float("inf")
_SPACES = re.compile(" +")
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MADE: dict[tuple, "Transducer"] = {}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = message[at]
            at, n, shift = at + 1, n | (b & 127) << shift, shift + 7
            if b < 128:
                return n

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, message[at : at + size]
        at += size


def _character_map(blob: bytes) -> dict[str, str]:
    """Source and target of each rule of a compiled character map: a double-array trie over bytes, then the targets, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, targets = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]

    def children(at: int) -> int:
        return at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))

    below: dict[int, list[int]] = {}  # units by the place that their parent points to
    for at, u in enumerate(units):
        if not u >> 31 and u & 255:
            below.setdefault(at ^ u & 255, []).append(at)
    rules, todo = {}, [(children(0), b"")]
    while todo:
        base, key = todo.pop()
        for at in below.get(base, ()):
            c, down = base ^ at, children(at)
            if units[at] >> 8 & 1:
                start = units[down] & 0x7FFFFFFF
                rules[(key + bytes([c])).decode()] = targets[start : targets.index(b"\0", start)].decode()
            todo.append((down, key + bytes([c])))
    return rules


class Normaliser:
    """The normaliser of a model, from the specification in its file."""

    def __init__(self, model: bytes):
        spec = trainer = b""
        for number, value in _fields(model):
            if number == 1 and dict(_fields(value)).get(3) == 4:
                raise ValueError("models with user-defined symbols are not supported")
            spec, trainer = value if number == 3 else spec, value if number == 2 else trainer
        has = {3: 1, 4: 1, 5: 1} | dict(_fields(spec))
        self.pad, self.squeeze, self.space = bool(has[3]), bool(has[4]), SPACE if has[5] else " "
        self.behind = bool(dict(_fields(trainer)).get(24, 0))
        self.trie: dict = {}
        for source, target in _character_map(has.get(2, b"")).items():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target

    def _mapped(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            node, z, target = self.trie, i + 1, text[i]
            for j in range(i, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    z, target = j + 1, node[""]
            out.append(target)
            i = z
        return "".join(out)

    def __call__(self, text: str) -> str:
        flat = self._mapped(text) if self.trie else text
        if self.squeeze:
            flat = _SPACES.sub(" ", flat).strip(" ")
        if not flat:
            return ""
        if self.pad:
            flat = flat + " " if self.behind else " " + flat
        return flat.replace(" ", self.space)


class Transducer:
    def __init__(self, path: str, kind: str = "bpe", keep: int = 600_000):
        import sentencepiece

        with open(path, "rb") as f:
            self.normalise = Normaliser(f.read())
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.keep = kind, keep
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids, self.ids, self.score = {}, {}, [sp.get_score(i) for i in range(n)]
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
        self.unknown = sp.unk_id()
        #: Weight of a character that no piece covers in a unigram model: 10 above that of the least likely piece.
        self.outside = 10.0 - min((self.score[i] for i in self.ids.values()), default=0.0)
        self.size = [len(p) for p in self.pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.raw = [p.encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.glued = {two for p in self.ids for two in zip(p, p[1:])}
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.sides: dict[int, tuple[int, int] | None] = {}
        self.weights: dict[int, float] = {}
        self.paths: dict[str, bytes] = {}

    def _split(self, t: int) -> tuple[int, int] | None:
        """The two pieces that the last merge into t joined; None for one character (or a piece that merges can't reach)."""
        if t not in self.sides:
            self.sides[t] = None
            parts, p = list(self.pieces[t]), self.pieces[t]
            while len(parts) > 2:
                best, at = None, -1
                for j in range(len(parts) - 1):
                    i = self.ids.get(parts[j] + parts[j + 1])
                    if i is not None and i != t and (best is None or self.score[i] > best):
                        best, at = self.score[i], j
                if best is None:
                    return None
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2 and all(x in self.ids for x in parts) and p in self.ids:
                self.sides[t] = (self.ids[parts[0]], self.ids[parts[1]])
        return self.sides[t]

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether merges leave a next to b.

        The merges are undone latest (lowest score) first, along a's right edge
        and b's left edge. A piece across the border would have been made
        before, if its score is higher than that of the merge undone last.
        """
        score, x, y, limit, right = self.score, a, b, -INFINITE, False
        while True:
            across = self.ids.get(self.pieces[x] + self.pieces[y])
            # Of equal scores the merges take the leftmost.
            if across is not None and (score[across] > limit or (score[across] == limit and right)):
                return False
            sx, sy = self._split(x), self._split(y)
            if sx is None and sy is None:
                return True
            if sy is None or (sx is not None and score[x] < score[y]):
                limit, x, right = score[x], sx[1], False
            else:
                limit, y, right = score[y], sy[0], True

    def _arcs(self, chunk: str, i: int) -> list[int]:
        """Pieces that start at i, the longest first, and -2 where none is a single character."""
        node, out, merged, sides = self.trie, [], self.kind != "unigram", self.sides
        for c in chunk[i : i + self.longest]:
            node = node.get(c)
            if node is None:
                break
            t = node.get("")
            if t is not None and (not merged or (sides[t] if t in sides else self._split(t)) or self.size[t] == 1):
                out.append(t)
        if not out or self.size[out[0]] > 1:
            out.insert(0, -2)
        return out[::-1]

    def path(self, chunk: str) -> bytes:
        """Ids (little-endian uint32) of the shortest path of one chunk."""
        out: list[int] = []
        for a, z, t in self._lightest(chunk):
            if t >= 0:
                out.append(t)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chunk[a:z].encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _weight(self, state: int, t: int) -> float:
        """Weight of the arc from a state of the grammar by piece t (-2: a character that no piece covers)."""
        if self.kind == "unigram":
            w = self.outside if t < 0 else -self.score[t]
        else:
            w = 0.0 if state < 0 or t < 0 or self._side_by_side(state, t) else INFINITE
        if len(self.weights) > 2_000_000:
            self.weights.clear()
        self.weights[state << 32 | t] = w
        return w

    def _lightest(self, chunk: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) along the tropical shortest path of the composed machine.

        Its states are (position, state of the grammar). No weight is negative,
        so states are settled lightest first, of equal weights the furthest, and
        each one's arcs are relaxed once.
        """
        n, size, many, known = len(chunk), self.size, self.kind != "unigram", self.weights.get
        heap: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        back: dict[tuple[int, int], tuple[float, int, int, int]] = {(0, -1): (0.0, 0, -1, -1)}  # weight, and start, state before and piece of the arc
        while heap:
            w, i, state = heappop(heap)
            i = -i
            if i == n:
                break
            if w > back[i, state][0]:
                continue
            for t in self._arcs(chunk, i):
                v = known(state << 32 | t)
                new = w + (self._weight(state, t) if v is None else v)
                if new == INFINITE:
                    continue
                z = i + (1 if t < 0 else size[t])
                there = (z, t if many else -1)
                if there not in back or new < back[there][0]:
                    back[there] = (new, i, state, t)
                    heappush(heap, (new, -z, there[1]))
        else:  # pieces that no merges make: characters, or their bytes
            return [(a, a + 1, self.ids.get(c, -2)) for a, c in enumerate(chunk)]
        steps = []
        while i > 0:
            _, a, before, t = back[i, state]
            steps.append((a, i, t))
            i, state = a, before
        return steps[::-1]

    def _parts(self, chunk: str) -> list[str]:
        """The chunk cut between characters that stand side by side in no piece: every path passes through there."""
        cuts = [j for j, two in enumerate(zip(chunk, chunk[1:]), 1) if two not in self.glued]
        return [chunk[a:z] for a, z in zip([0, *cuts], [*cuts, len(chunk)])]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        flat = self.normalise(text)
        out = []
        for c in [flat] if self.inner_space else _CHUNK.findall(flat):
            got = self.paths.get(c)
            if got is None:
                if len(self.paths) >= self.keep:
                    self.paths.clear()
                parts = self._parts(c)
                if len(parts) == 1:
                    got = self.paths[c] = self.path(c)
                else:
                    for x in parts:
                        if x not in self.paths:
                            self.paths[x] = self.path(x)
                    got = b"".join([self.paths[x] for x in parts])
                    if len(c) < 24:
                        self.paths[c] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of these ids: the transducer read backwards."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        if self.normalise.pad and self.normalise.behind:
            return text.removesuffix(" ")
        return text.removeprefix(" ") if self.normalise.pad else text


def transducer(path: str, kind: str = "bpe") -> Transducer:
    """One per worker process and model."""
    if (path, kind) not in _MADE:
        _MADE[path, kind] = Transducer(path, kind)
    return _MADE[path, kind]


def encode(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids as little-endian uint32 binary, round_trip) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model, kind)
        for b in batches:
            for a in range(0, len(b), 500):
                texts = b.column("text").slice(a, 500).to_pylist()
                ids = [t.encode(x) for x in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, 500), pa.array(ids, pa.binary()), pa.array([t.decode(i) == (x or "") for i, x in zip(ids, texts)])], ["doc_id", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    d = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return d.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")
