"""Static range asymmetric numeral system for token ids.

One frequency table, scaled to 2**SCALE, serves every block.  A block is cut into
segments, each a checkpoint from which decoding can begin, and a segment into
interleaved lanes; all lanes of all segments advance together as one numpy vector.

Layout of a block, little endian: magic, number of ids, segments, lanes, steps, number
of words, then the first word of each segment (u32), the state of each lane (u64),
the words (u32), and the CRC-32 of all before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = struct.Struct("<4sIIIII")
MAGIC = b"rAN1"


class Table:
    """Symbols and their scaled frequencies; each symbol that occurs has one slot at least."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = np.asarray(symbols, np.int64)[order], np.asarray(counts, np.float64)[order]
        total, size = 1 << SCALE, len(self.symbols)
        if size > total:
            raise ValueError(f"{size} symbols need more than {total} slots")
        freq = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * total)).astype(np.int64)
        over = int(freq.sum()) - total if size else 0
        for i in np.argsort(-freq, kind="stable"):  # the most frequent symbols take up the rounding
            if not over:
                break
            step = min(over, int(freq[i]) - 1) if over > 0 else over
            freq[i] -= step
            over -= step
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(size), freq).astype(np.int32)
        self.index = np.full(int(self.symbols.max(initial=-1)) + 1, -1, np.int32)
        self.index[self.symbols] = np.arange(size)


def shape(n: int, lanes: int, segments: int) -> tuple[int, int, int]:
    """Segments, lanes and steps for n ids; short blocks have fewer lanes."""
    while lanes > 1 and n < 16 * lanes * segments:
        if segments > 1:
            segments //= 2
        else:
            lanes //= 2
    return segments, lanes, -(-n // (segments * lanes))


def encode(table: Table, ids: np.ndarray, lanes: int = 2048, segments: int = 4) -> bytes:
    n = len(ids)
    segments, lanes, steps = shape(n, lanes, segments)
    sym = np.full(segments * steps * lanes, int(np.argmax(table.freq)) if len(table.freq) else 0, np.int32)
    sym[:n] = table.index.take(ids)
    if n and sym[:n].min() < 0:
        raise ValueError("an id is not in the frequency table")
    sym = sym.reshape(segments, steps, lanes)
    state = np.full((segments, lanes), LOW)
    words, counts = [], np.zeros((steps, segments), np.int64)
    scale, most = np.uint64(SCALE), np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        s = sym[:, t, :]
        f = table.freq.take(s)
        full = state >= f << most
        out = state[full]
        words.append(out.astype(np.uint32))
        counts[t] = full.sum(1)
        state[full] = out >> WORD
        q = state // f
        state += q * (np.uint64(1 << SCALE) - f)
        state += table.cum.take(s)
    # words were made step by step from the last one, each step's by segment; they are read by segment, from the first step
    flat, first = [], np.zeros(segments, np.uint32)
    starts = counts.cumsum(1) - counts
    for k in range(segments):
        first[k] = sum(map(len, flat))
        flat += [words[steps - 1 - t][starts[t, k] : starts[t, k] + counts[t, k]] for t in range(steps)]
    flat = np.concatenate(flat) if flat else np.empty(0, np.uint32)
    body = HEAD.pack(MAGIC, n, segments, lanes, steps, len(flat)) + first.astype("<u4").tobytes() + state.astype("<u8").tobytes() + flat.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode(table: Table, block: bytes, segment: int | None = None) -> np.ndarray:
    """The ids of a block, or of one of its segments, which are checkpoints: none needs what stands before it.

    Raises ValueError if the checksum or the last states are wrong.
    """
    if len(block) < HEAD.size + 4 or zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("checksum of a block does not hold")
    magic, n, segments, lanes, steps, size = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    wanted = slice(0, segments) if segment is None else slice(segment, segment + 1)
    at = HEAD.size
    point = np.frombuffer(block, "<u4", segments, at).astype(np.int64)[wanted]
    at += 4 * segments
    state = np.frombuffer(block, "<u8", segments * lanes, at).reshape(segments, lanes)[wanted].astype(np.uint64)
    words = np.frombuffer(block, "<u4", size, at + 8 * segments * lanes)
    out = np.empty((len(state), steps, lanes), np.int32)
    scale, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    for t in range(steps):
        slot = state & mask
        s = table.slot.take(slot.view(np.int64))
        out[:, t, :] = s
        state >>= scale
        state *= table.freq.take(s)
        state += slot
        state -= table.cum.take(s)
        need = state < LOW
        taken = need.sum(1)
        more = np.concatenate([words[p : p + k] for p, k in zip(point.tolist(), taken.tolist())]) if len(point) > 1 else words[point[0] : point[0] + taken[0]]
        state[need] = state[need] << WORD | more
        point += taken
    if (state != LOW).any():
        raise ValueError("a block ends in a wrong state")
    begin = 0 if segment is None else segment * steps * lanes
    return table.symbols.take(out.reshape(-1)[: max(0, n - begin)])


def segment_of(block: bytes, place: int) -> tuple[int, int]:
    """Which segment holds an id of the block, and where the segment begins."""
    _, _, _, lanes, steps, _ = HEAD.unpack_from(block)
    size = max(1, lanes * steps)
    return place // size, place // size * size
