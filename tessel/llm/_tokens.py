"""Token ids of whole texts by a public tokenizer file, through the tokenizers library.

The byte-level pre-tokenizer starts a new piece at the first character of every
run of white space, and at the last one if that is a space before a word. Texts
are cut at such spaces, lines at their single line feeds, and punctuation is cut
from the letters before it, where it ends a chunk. Each distinct unit is encoded
once by the library and remembered; a text's ids are its units' ids in order:
the same ids as of the whole text, for a fraction of the time. Only a text that
holds the text of an added token or one of the marks used here goes to the
library as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Everything that either engine may take for white space.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PY_WHITE = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", _WHITE)
_INSIDE = f"[{_WHITE}] (?:[{_WHITE}]|$)"  # a space inside a run of white space
_CUT = re.compile(f"(?<![{_PY_WHITE}]) |(?<=[{_PY_WHITE}]) (?=[^{_PY_WHITE}])")
_LINE = f"([^{_WHITE}\x02])\n([^{_WHITE}])"
_LETTER, _POINT = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-/:-@\[-`{-~]"
#: Marks: \0 between units, \1 before punctuation, \2 before what follows a line feed or starts a text.
_MARKS = "[\x00-\x02]"
_MADE: dict[str, "Encoder"] = {}


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] ... start[i] + size[i] - 1 of all i, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, path: str, keep: int = 700_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.keep = keep
        self._batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)  # without offsets, where the library can
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.byte_level = self.tok.normalizer is None and type(self.tok.pre_tokenizer).__name__ == "ByteLevel"
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.n_ids = max(vocab.values()) + 1
        self.width = np.zeros(self.n_ids, dtype=np.int64)  # a byte-level piece has one character per byte
        for piece, i in vocab.items():
            self.width[i] = len(piece)
        self.line = self.whole("\n")
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._batch([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _alone(self, unit: str) -> np.ndarray:
        if unit[:1] == "\x02":
            return np.concatenate([self.line, self.whole(unit[1:])]) if len(unit) > 1 else self.line
        return self.whole(unit[1:] if unit[:1] == "\x01" else " " + unit)

    def _learn(self, units: list[str], named: pa.Array) -> None:
        """Remember ``units`` (also given as an Arrow array): as they stand behind a space, or a line feed (\\2), or a letter (\\1). One call of the library encodes many."""
        sizes = np.asarray(pc.binary_length(named), dtype=np.int64)
        flat, starts, lens, held, last = [self.flat], [self.starts], [self.lens], len(self.flat), len(self.starts)
        self.at.update(zip(units, range(last, last + len(units))))
        alone, after = (pc.match_substring_regex(named, x).to_numpy(zero_copy_only=False) for x in (f"^\x01|^\x02?(?:[{_WHITE}]|$)|[{_WHITE}]$", "^\x02"))
        order = [np.flatnonzero(~alone & ~after), np.flatnonzero(~alone & after), np.flatnonzero(alone)]
        begin, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        for rows, gap in zip(order, (" ", "\n")):
            for a in range(0, len(rows), 3_000):
                part = rows[a : a + 3_000]
                ids = self.whole(gap + gap.join([units[i] for i in part.tolist()] if gap == " " else [units[i][1:] for i in part.tolist()]))
                ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes[part] + (gap == " "))) + 1
                begin[part] = np.concatenate([[0], ends[:-1]]) + held
                size[part] = np.diff(ends, prepend=0)
                flat.append(ids)
                held += len(ids)
        for i in order[2].tolist():
            ids = self._alone(units[i])
            begin[i], size[i] = held, len(ids)
            flat.append(ids)
            held += len(ids)
        self.flat, self.starts, self.lens = np.concatenate(flat), np.concatenate([*starts, begin]), np.concatenate([*lens, size])

    def _units(self, chunks: pa.Array) -> pa.Array:
        """List of the units of each chunk."""
        line = pc.match_substring(chunks, "\n")
        if pc.any(line).as_py():
            chunks = pc.replace_with_mask(chunks, line, pc.replace_substring_regex(chunks.filter(line), _LINE, "\\1\x00\x02\\2"))
        point = pc.match_substring_regex(chunks, f"{_LETTER}{_POINT}+(?:\x00|$)")
        if pc.any(point).as_py():
            chunks = pc.replace_with_mask(chunks, point, pc.replace_substring_regex(chunks.filter(point), f"({_LETTER})({_POINT}+)(\x00|$)", "\\1\x00\x01\\2\\3"))
        return pc.split_pattern(chunks, "\x00")

    def _slots(self, units: pa.Array) -> np.ndarray:
        """Where each of these distinct units is remembered."""
        names = units.to_pylist()
        slot = np.fromiter(map(self.at.get, names, [-1] * len(names)), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        if len(new) and len(self.at) + len(new) > self.keep and self.at:
            self._forget()
            new = np.arange(len(names))
        if len(new):
            slot[new] = len(self.starts) + np.arange(len(new))
            self._learn([names[i] for i in new.tolist()], units.take(pa.array(new)))
        return slot

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of a string array's texts one after the other, each ended by ``end_id``, and where each text starts (and the last ends); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        alone = np.full(n, not self.byte_level)
        if self.byte_level and n:
            hit = pc.match_substring_regex(texts, _MARKS)
            for a in self.added:
                hit = pc.or_(hit, pc.match_substring(texts, a))
            alone = hit.to_numpy(zero_copy_only=False)
        rows, values, counts = [], [], []
        fast = np.flatnonzero(~alone)
        if len(fast):
            inside = pc.match_substring_regex(texts.take(pa.array(fast)), _INSIDE).to_numpy(zero_copy_only=False)
            plain = fast[~inside]
            parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\x02", pa.large_string()), texts.take(pa.array(plain)), pa.scalar("", pa.large_string())), " ")
            rows, values, counts = [plain], [parts.values], [np.diff(np.asarray(parts.offsets, dtype=np.int64))]
            if inside.any():
                lists = [_CUT.split("\x02" + texts[i].as_py()) for i in fast[inside].tolist()]
                rows.append(fast[inside])
                values.append(pa.array([c for x in lists for c in x], pa.large_string()))
                counts.append(np.array([len(x) for x in lists], np.int64))
        row = np.concatenate([*rows, np.flatnonzero(alone)]).astype(np.int64)
        flat, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(fast):
            count = np.concatenate(counts)
            enc = pc.dictionary_encode(pa.concat_arrays(values))
            code = np.asarray(enc.indices, dtype=np.int64)
            units = self._units(enc.dictionary)
            of = pc.dictionary_encode(units.values)
            slot = self._slots(of.dictionary)[np.asarray(of.indices, dtype=np.int64)]
            # Ids of each distinct chunk, then of each chunk; the line feed before a text is left out.
            ids = self.flat[spans(self.starts[slot], self.lens[slot])]
            cut = np.concatenate([[0], np.cumsum(self.lens[slot])])[np.asarray(units.offsets, dtype=np.int64)]
            start, k = cut[:-1][code], np.diff(cut)[code]
            first = np.cumsum(count) - count
            start[first] += len(self.line)
            k[first] -= len(self.line)
            flat = ids[spans(start, k)]
            size = np.diff(np.concatenate([[0], np.cumsum(k)])[np.append(first, len(k))])
        if alone.any():
            more = [self.whole(texts[i].as_py()) for i in np.flatnonzero(alone).tolist()]
            flat, size = np.concatenate([flat, *more]), np.append(size, [len(x) for x in more]).astype(np.int64)
        if n and (np.diff(row) < 0).any():
            order = np.argsort(row)
            flat, size = flat[spans((np.cumsum(size) - size)[order], size[order])], size[order]
        offs = np.concatenate([[0], np.cumsum(size)])
        if end_id is not None:
            flat, offs = np.insert(flat, offs[1:], np.uint32(end_id)), offs + np.arange(n + 1)
        return flat, offs


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _MADE:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _MADE[path] = Encoder(path)
    return _MADE[path]


def encode_slices(texts: pa.Array, path: str, end_id: int | None = None, chars: int = 6_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first position, ids, offsets) as of :meth:`Encoder.encode` for slices of about ``chars`` bytes, so that memory stays bounded."""
    enc = encoder(path)
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    group = np.cumsum(size) // chars
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield a, *enc.encode(texts.slice(a, b - a), end_id)
