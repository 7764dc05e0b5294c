"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

A tokenizer gives a piece of text the same ids wherever it stands, if it is cut where the tokenizer itself cuts. So texts
are cut there, by classes of bytes and in whole arrays; Arrow finds the distinct pieces; the library encodes those that the
cache lacks; and the ids of all pieces are gathered from the cache at once.

Both tokenizers at hand cut between letters, digits and marks, before white space and behind it, a single space (or a
run's last one) going with what follows. What is left whole: what surrounds an apostrophe (contractions), what touches a
character outside ASCII and Latin-1 letters, and texts that hold other white space than ASCII's or a special token.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces in the cache and the longest piece it holds, in bytes: some 150 MB at most.
CACHE_PIECES, CACHE_LENGTH = 600_000, 60
#: Bytes of text that are cut at once, about; longer texts are taken in parts.
AT_ONCE = 8 << 20

LETTER, DIGIT, MARK, SPACE, APOSTROPHE, OTHER = 1, 2, 4, 8, 16, 32
_SPACES = b"\t\n\x0b\x0c\r "


def _class_of(byte: int) -> int:
    if byte in _SPACES:
        return SPACE
    if byte == ord("'"):
        return APOSTROPHE
    if byte >= 0x80 or 0x1C <= byte <= 0x1F:
        return OTHER
    return LETTER if chr(byte).isalpha() else DIGIT if chr(byte).isdigit() else MARK


CLASSES = np.array([_class_of(b) for b in range(256)], np.uint8)
#: First bytes of characters that can be white space outside ASCII.
_SUSPECT = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
#: A pre-token of letters; the library's model takes it without looking for others.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Where a long text can be parted: before a single space.
_PART = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers' letter for each byte: itself if it is visible, else the next free one from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def cuts(data: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces of ``data`` begin. Texts begin at ``starts``; those that are ``whole`` are one piece each."""
    kind = CLASSES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    before, here = kind[:-1], kind[1:]
    cut = np.zeros(len(data), bool)
    cut[1:] = (before != here) & (((before | here) < SPACE) | (here == SPACE) | ((before < MARK) & (here == APOSTROPHE)))
    first = np.flatnonzero((before == SPACE) & (here != SPACE)) + 1  # the first characters behind white space
    is_start = np.zeros(len(data), bool)
    is_start[starts] = True
    first = first[~is_start[first]]
    cut[first - 1] = True
    cut[first] = data[first - 1] != 0x20
    if whole.any():
        ends = np.append(starts[1:], len(data))
        for a, b in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True):
            cut[a:b] = False
    cut[starts] = True
    return np.flatnonzero(cut)


def gathered(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``flat[a : a + k]`` for all pairs of ``at`` and ``n``, one after another."""
    ends = np.cumsum(n)
    return flat[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class _Cache:
    """Ids of pieces: a dict gives a piece's slot, arrays have where its ids are."""

    def __init__(self, kind: type):
        self.slots: dict[bytes, int] = {}
        self.at, self.n, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)
        self.flat, self.end = np.zeros(4096, kind), 0

    def add(self, pieces: list[bytes], ids: list[list[int]]) -> None:
        first, last = len(self.slots), len(self.slots) + len(pieces)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(n.sum())
        while last > len(self.at):
            self.at, self.n, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.used))
        while self.end + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.end : self.end + total] = np.fromiter((i for x in ids for i in x), self.flat.dtype, total)
        self.at[first:last], self.n[first:last], self.used[first:last] = self.end + np.cumsum(n) - n, n, 0
        self.end += total
        self.slots.update(zip(pieces, range(first, last), strict=True))

    def trim(self) -> None:
        """Keep the pieces that were met again; if these are many, the later half of them too."""
        slots = np.fromiter(self.slots.values(), np.int64, len(self.slots))
        lengths = np.fromiter(map(len, self.slots), np.int64, len(self.slots))
        stay = (self.used[slots] > 1) & (lengths <= CACHE_LENGTH)
        if stay.sum() > CACHE_PIECES // 2:
            stay &= np.arange(len(stay)) < np.flatnonzero(stay)[CACHE_PIECES // 2]
        kept = [p for p, s in zip(self.slots, stay.tolist(), strict=True) if s]
        at, n, flat = self.at[slots[stay]], self.n[slots[stay]], self.flat
        self.__init__(flat.dtype)
        self.flat = gathered(flat, at, n)
        self.end = len(self.flat)
        self.at, self.n, self.used = np.cumsum(n) - n, n, np.full(len(n), 1, np.uint32)
        self.slots = {p: i for i, p in enumerate(kept)}
        if not kept:
            self.__init__(flat.dtype)


class Encoder:
    """Ids of texts, each with the end id behind it.

    ``keeps_spaces`` tells a byte-level tokenizer, to which white space and case are part of a piece, from one of lower
    case that drops white space.
    """

    def __init__(self, path: str, end_id: int, keeps_spaces: bool, width: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.specials = [str(t) if isinstance(t, str) else t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_spaces, self.end_id = keeps_spaces, end_id
        self.kind = {2: np.uint16, 4: np.uint32}[width]
        self.cache = _Cache(self.kind)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids of each text) for parts of ``texts`` in order; a null text is an empty one."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, side="right")) - 1)
            part = offsets[row : last + 1]
            yield self._encode(data[part[0] : part[-1]], part - part[0], self._whole(texts, data, offsets, row, last))
            row = last

    def _whole(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray, row: int, last: int) -> np.ndarray:
        """Which of the texts are left whole."""
        found = np.zeros(last - row, bool)
        part = texts.slice(row, last - row)
        for special in self.specials:
            found |= pc.match_substring(part, special).to_numpy(zero_copy_only=False)
        suspects = np.flatnonzero(_SUSPECT[data[offsets[row] : offsets[last]]]) + offsets[row]
        for i in np.unique(np.searchsorted(offsets, suspects, side="right") - 1 - row).tolist():
            found[i] = found[i] or bool(_OTHER_SPACE.search(part[i].as_py().decode()))
        return found

    def _encode(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > 2 * AT_ONCE and len(offsets) == 2 and not whole[0]:
            text = data.tobytes()
            parts, a = [], 0
            while a < len(text):
                found = _PART.search(text, a + AT_ONCE)
                b = found.start() if found else len(text)
                parts.append(self._ids(data[a:b], np.array([0, b - a]), whole)[0])
                a = b
            ids = np.concatenate([*parts, np.array([self.end_id], self.kind)])
            return ids, np.array([len(ids)])
        ids, n = self._ids(data, offsets, whole)
        return np.insert(ids, np.cumsum(n), self.end_id), n + 1

    def _ids(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filled = offsets[1:] > offsets[:-1]
        n = np.zeros(len(filled), np.int64)
        if not len(data):
            return np.zeros(0, self.kind), n
        begin = cuts(data, offsets[:-1][filled], whole[filled])
        bounds = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        slots = self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        of_piece = self.cache.n[slots]
        ids = gathered(self.cache.flat, self.cache.at[slots], of_piece)
        n[filled] = np.add.reduceat(of_piece, np.searchsorted(begin, offsets[:-1][filled]))
        if len(self.cache.slots) > CACHE_PIECES:
            self.cache.trim()
        return ids, n

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        """Where the cache has the distinct ``pieces``, now that it has them all."""
        known = self.cache.slots
        found = list(map(known.get, pieces))
        if None in found:
            words, rest = [], []
            for p, slot in zip(pieces, found, strict=True):
                if slot is None:
                    (words if len(p) <= CACHE_LENGTH and _WORD.fullmatch(p) else rest).append(p)
            self.cache.add(words, [self._word(p) for p in words])
            for i in range(0, len(rest), 1024):
                part = rest[i : i + 1024]
                encoded = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
                self.cache.add(part, [e.ids for e in encoded])
            found = [known[p] if slot is None else slot for p, slot in zip(pieces, found, strict=True)]
        slots = np.array(found, np.int64)
        self.cache.used[slots] += 1
        return slots

    def _word(self, piece: bytes) -> list[int]:
        if not self.keeps_spaces:
            piece = piece.decode().strip().lower().encode()
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int, keeps_spaces: bool, width: int = 4) -> Encoder:
    """The encoder of this Python worker, whose cache outlives a task."""
    return Encoder(path, end_id, keeps_spaces, width)
