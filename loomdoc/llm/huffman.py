"""Canonical length-limited Huffman codes over integer ids, in numpy."""

from __future__ import annotations

import numpy as np

#: Longest code where there are not too many ids for it, and so the bits by which the decoding table is addressed.
LIMIT = 16
#: A checkpoint (a bit offset) stands at each document's id 0, 64, 128, ...
EVERY = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The length of each id's code (0: the id does not occur) that makes the total shortest, by package-merge.

    More ids than ``limit`` bits can tell apart get the bits they need.
    """
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    limit = max(limit, (len(ids) - 1).bit_length())
    if len(ids) <= 1:
        lengths[ids] = 1
        return lengths
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[ids].astype(np.int64)
    is_leaf, row = [], leaves
    marks = np.ones(len(leaves), bool)
    for _ in range(limit):
        is_leaf.append(marks)
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        row, marks = both[order], order < len(leaves)
    take = 2 * len(leaves) - 2
    for marks in reversed(is_leaf):
        n_leaves = int(marks[:take].sum())
        lengths[ids[:n_leaves]] += 1
        take = 2 * (min(take, len(marks)) - n_leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that rise with (length, id)."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    of = lengths[ids].astype(int)
    # Within a length codes count up; between lengths the next code is shifted.
    for length in np.unique(of):
        mine = ids[of == length]
        code <<= int(length) - before
        codes[mine] = code + np.arange(len(mine))
        code, before = code + len(mine), int(length)
    return codes


def window_bytes(lengths: np.ndarray) -> int:
    """Over how many bytes a code can spread."""
    return (max(LIMIT, int(lengths.max(initial=0))) + 14) // 8


def encode(ids: np.ndarray, n_ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of documents that lie one after another in ``ids``, each starting at a full byte.

    Returns all bytes, the first byte of each document (and the end), and the checkpoints: bit offsets in their
    document, and how many each document has. Every document has at least one id.
    """
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    last = np.cumsum(n_ids)
    first = last - n_ids
    before = ends[first] - bits[first]
    n_bytes = (ends[last - 1] - before + 7) >> 3
    at = np.concatenate([[0], np.cumsum(n_bytes)])
    in_doc = ends - bits - np.repeat(before, n_ids)
    position = in_doc + np.repeat(at[:-1] << 3, n_ids)
    spread = window_bytes(lengths)
    window = codes[ids].astype(np.int64) << (8 * spread - bits - (position & 7))
    byte, size = position >> 3, int(at[-1]) + spread
    total = np.zeros(size)
    for k in range(spread):
        total[k:] += np.bincount(byte, window >> 8 * (spread - 1 - k) & 255, size)[: size - k]
    n_marks = (n_ids + EVERY - 1) // EVERY
    mark = np.repeat(first, n_marks) + EVERY * (np.arange(n_marks.sum()) - np.repeat(np.cumsum(n_marks) - n_marks, n_marks))
    return total[: at[-1]].astype(np.uint8).tobytes(), at, in_doc[mark].astype(np.uint32), n_marks


class Decoder:
    """Reads as many bits as the longest code has at a time from a table of ids and lengths; all stretches between checkpoints in step."""

    def __init__(self, lengths: np.ndarray):
        codes, ids = canonical_codes(lengths), np.flatnonzero(lengths)
        self.limit = limit = max(LIMIT, int(lengths.max(initial=0)))
        self.spread = window_bytes(lengths)
        self.id = np.zeros(1 << limit, np.uint32)
        self.length = np.ones(1 << limit, np.uint8)
        ids = ids[np.argsort(codes[ids].astype(np.int64) << (limit - lengths[ids].astype(np.int64)), kind="stable")]
        spans = np.left_shift(1, limit - lengths[ids].astype(np.int64))
        self.id[: spans.sum()] = np.repeat(ids, spans)
        self.length[: spans.sum()] = np.repeat(lengths[ids], spans)

    def decode(self, coded: bytes, at: np.ndarray, n_ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The ids of documents of ``n_ids`` ids that start at bytes ``at``, with their checkpoints one after another."""
        data = np.frombuffer(coded + bytes(self.spread), np.uint8).astype(np.uint32)
        window = np.zeros(len(data) - self.spread + 1, np.uint32)
        for k in range(self.spread):
            window |= data[k : k + len(window)] << np.uint32(8 * (self.spread - 1 - k))
        n_marks = (n_ids + EVERY - 1) // EVERY
        ordinal = np.arange(n_marks.sum()) - np.repeat(np.cumsum(n_marks) - n_marks, n_marks)
        place = np.repeat(np.cumsum(n_ids) - n_ids, n_marks) + EVERY * ordinal
        left = np.minimum(EVERY, np.repeat(n_ids, n_marks) - EVERY * ordinal)
        position = marks.astype(np.int64) + (np.repeat(at, n_marks) << 3)
        order = np.argsort(-left, kind="stable")
        place, position, left = place[order], position[order], left[order]
        out = np.empty(int(n_ids.sum()), np.uint32)
        for step in range(EVERY):
            n = int(np.searchsorted(-left, -step, side="left"))  # stretches with more than ``step`` ids
            if not n:
                break
            peek = window[position[:n] >> 3] >> (8 * self.spread - self.limit - (position[:n] & 7)).astype(np.uint32) & ((1 << self.limit) - 1)
            out[place[:n] + step] = self.id[peek]
            position[:n] += self.length[peek]
        return out
