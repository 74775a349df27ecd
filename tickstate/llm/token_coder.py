"""Range coder of token ids with adaptive predictions of order 0 to 2.

Ids are coded in blocks that start from the same empty state, so blocks are
independent, and many blocks are coded side by side in numpy arrays.

For each id, order 2 (the two ids before) and order 1 (the id before) each offer
the id last seen in that context. Which of them is right, or neither, is coded
with a mix of adaptive counts: those of the situation (is there an order-2 offer,
do the offers agree, what was right last time) and those of the whole block. An
id that neither offers is coded by order 0: adaptive counts of its class (bit
length, the longest split by leading bits), then its lower bits. Counts grow with
every id; distributions take them over every ``_FRESH`` ids.

The coder keeps a range of 2**32 to 2**48 and emits 16-bit words; carries into
words already emitted are resolved at the end. Quotients are taken in double
precision, which is exact for numbers below 2**53.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
_SLOTS1, _SLOTS2 = 256, 1024
_FRESH = 32
_FLAG_BITS, _CLASS_BITS, _SPARE_BITS = 10, 10, 12  # together the 32 bits that the range has at least
_MOST = 2000                      # counts are halved beyond this sum
_LEAST, _FULL = np.int64(1 << 32), np.int64(1 << 48)
_LOW32 = np.int64((1 << 32) - 1)
_A, _B = np.int64(40503), np.int64(30011)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id, first id and spare bits of each class; at most ``_SPARE_BITS`` spare bits."""
    firsts, spares = [0, 1], [0, 0]
    for length in range(2, 17):
        spare = min(length - 1, _SPARE_BITS)
        for first in range(1 << (length - 1), 1 << length, 1 << spare):
            firsts.append(first)
            spares.append(spare)
    first = np.array(firsts)
    return np.searchsorted(first, np.arange(1 << 16), side="right") - 1, first, np.array(spares)


_CLASS, _FIRST, _SPARE = _classes()
_UNUSED = _SPARE_BITS - _SPARE
CLASSES = len(_FIRST)
_WIDE = CLASSES + 1


class _Model:
    """Adaptive state of ``k`` blocks; encoder and decoder make the same calls."""

    def __init__(self, k: int):
        lanes = np.arange(k, dtype=np.int64)
        self.base1, self.base2 = lanes * _SLOTS1, lanes * _SLOTS2
        self.table1 = np.zeros(k * _SLOTS1, dtype=np.int32)  # id + 1
        self.table2 = np.zeros(k * _SLOTS2, dtype=np.int32)
        # counts of "order 2", "order 1", "neither" in each of 16 situations
        self.lane16 = lanes * 16
        self.flags = np.tile(np.array([1, 1, 2, 0], dtype=np.int64), k * 16)
        self.before = np.zeros(k, dtype=np.int64)
        self.classes = np.ones((k, CLASSES), dtype=np.int64)
        self.flat_classes = self.classes.reshape(-1)
        self.upto = np.zeros((k, _WIDE), dtype=np.int64)
        self.flat_upto = self.upto.reshape(-1)
        self.spread = np.arange(_WIDE)
        self.laneC, self.laneU = lanes * CLASSES, lanes * _WIDE
        self.last = np.zeros(k, dtype=np.int64)
        self.older = np.zeros(k, dtype=np.int64)
        self.refresh()

    def refresh(self) -> None:
        """Halve counts that are large and take the counts over into the distributions."""
        flags = self.flags.reshape(-1, 4)
        for counts in (flags, self.classes):
            big = np.flatnonzero(counts.sum(axis=1) > _MOST)
            if len(big):
                counts[big] = (counts[big] + 1) >> 1
        whole = flags.reshape(-1, 16, 4).sum(axis=1)
        mixed = (flags.reshape(-1, 16, 4) * 16 + whole[:, None, :]).reshape(-1, 4)
        two, one, none = (mixed[:, j] for j in range(3))
        room = (1 << _FLAG_BITS) - 3  # each outcome keeps a share of one at least
        total = two + one + none
        self.edge2 = two * room // total + 1
        self.edge1 = (two + one) * room // total + 2
        upto = np.cumsum(self.classes, axis=1)
        self.upto[:, 1:] = upto * ((1 << _CLASS_BITS) - CLASSES) // upto[:, -1:]
        self.upto += self.spread

    def look(self, k: int) -> None:
        """Offers (id + 1) of the first ``k`` blocks and the edges of their outcomes."""
        last = self.last[:k]
        self.at1 = (last & (_SLOTS1 - 1)) + self.base1[:k]
        self.at2 = (((last * _A + self.older[:k]) >> 4) & (_SLOTS2 - 1)) + self.base2[:k]
        self.offer1, self.offer2 = self.table1[self.at1], self.table2[self.at2]
        self.cell = self.before[:k] + self.lane16[:k] + (self.offer2 > 0) + 2 * (self.offer1 == self.offer2)
        self.low, self.high = self.edge2[self.cell], self.edge1[self.cell]

    def learn(self, k: int, next_id: np.ndarray, flag: np.ndarray) -> None:
        """Take in ``next_id`` (id + 1)."""
        self.flags[(self.cell << 2) + flag] += 1
        self.table1[self.at1] = next_id
        self.table2[self.at2] = next_id
        self.before[:k] = flag << 2
        self.older[:k] = self.last[:k] * _B
        self.last[:k] = next_id


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b).astype(np.int64)


class _Writer:
    def __init__(self, k: int, steps: int):
        self.width = 2 * steps + 16
        self.words = np.zeros(k * self.width, dtype=np.int32)
        self.first = np.arange(k, dtype=np.int64) * self.width
        self.next = self.first.copy()
        self.low = np.zeros(k, dtype=np.int64)
        self.range = np.full(k, _FULL)

    def put(self, k: int, start, width, bits: int) -> None:
        part = self.range[:k] >> bits
        self.low[:k] += start * part
        np.multiply(width, part, out=self.range[:k])

    def put_some(self, lanes, start, width, bits: int) -> None:
        part = self.range[lanes] >> bits
        self.low[lanes] += start * part
        self.range[lanes] = width * part

    def shift(self) -> None:
        while True:
            lanes = np.flatnonzero(self.range <= _LEAST)
            if not len(lanes):
                return
            self._emit(lanes)
            self.range[lanes] <<= 16

    def _emit(self, lanes: np.ndarray) -> None:
        low, at = self.low[lanes], self.next[lanes]
        self.words[at] = low >> 32  # may hold a carry
        self.next[lanes] = at + 1
        self.low[lanes] = (low & _LOW32) << 16

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self._emit(np.arange(len(self.low)))
        sizes = self.next - self.first
        words = self.words.reshape(-1, self.width)
        carry = np.zeros(len(sizes), dtype=np.int32)
        for j in range(int(sizes.max(initial=0)) - 1, -1, -1):
            word = words[:, j] + carry
            words[:, j] = word & 0xFFFF
            carry = word >> 16
        return [words[i, :n].astype("<u2").tobytes() for i, n in enumerate(sizes)]


class _Reader:
    def __init__(self, blocks: list[bytes]):
        k, width = len(blocks), max(map(len, blocks)) // 2 + 4
        words = np.zeros((k, width), dtype=np.int64)
        for i, b in enumerate(blocks):
            words[i, : len(b) // 2] = np.frombuffer(b, dtype="<u2")
        self.value = (words[:, 0] << 32) | (words[:, 1] << 16) | words[:, 2]
        self.words = words.astype(np.uint16).reshape(-1)
        self.next = np.arange(k, dtype=np.int64) * width + 3
        self.range = np.full(k, _FULL)

    def peek(self, lanes, bits: int) -> np.ndarray:
        self.part = self.range[lanes] >> bits
        return np.minimum(_divide(self.value[lanes], self.part), (1 << bits) - 1)

    def take(self, lanes, start, width) -> None:
        self.value[lanes] -= start * self.part
        self.range[lanes] = width * self.part

    def shift(self) -> None:
        while True:
            lanes = np.flatnonzero(self.range <= _LEAST)
            if not len(lanes):
                return
            at = self.next[lanes]
            self.value[lanes] = (self.value[lanes] << 16) | self.words[at]
            self.next[lanes] = at + 1
            self.range[lanes] <<= 16


def encode(ids: np.ndarray) -> list[bytes]:
    """Code words of each block of ``BLOCK`` ids; ids are below 2**16."""
    n = len(ids)
    if not n:
        return []
    k = -(-n // BLOCK)
    steps, tail = min(BLOCK, n), n - (k - 1) * BLOCK
    grid = np.zeros(k * BLOCK, dtype=np.int64)
    grid[:n] = ids
    grid += 1
    grid = np.ascontiguousarray(grid.reshape(k, BLOCK).T)
    model, out = _Model(k), _Writer(k, steps)
    for t in range(steps):
        if t % _FRESH == 0 and t:
            model.refresh()
        m = k if t < tail else k - 1
        next_id = grid[t, :m]
        model.look(m)
        right2, right1 = model.offer2 == next_id, model.offer1 == next_id
        start = np.where(right2, 0, np.where(right1, model.low, model.high))
        end = np.where(right2, model.low, np.where(right1, model.high, 1 << _FLAG_BITS))
        flag = np.where(right2, 0, 2 - right1)
        out.put(m, start, end - start, _FLAG_BITS)
        rest = np.flatnonzero(flag == 2)
        if len(rest):
            values = next_id[rest] - 1
            kind = _CLASS[values]
            at = model.laneU[rest] + kind
            start = model.flat_upto[at]
            width = (model.flat_upto[at + 1] - start) << _UNUSED[kind]
            out.put_some(
                rest, (start << _SPARE_BITS) + (values - _FIRST[kind]) * width, width, _CLASS_BITS + _SPARE_BITS
            )
            model.flat_classes[model.laneC[rest] + kind] += 1
        out.shift()
        model.learn(m, next_id, flag)
    return out.finish()


def decode(blocks: list[bytes], n: int) -> np.ndarray:
    """The ``n`` ids of ``encode``."""
    if not n:
        return np.zeros(0, dtype=np.uint16)
    k = len(blocks)
    steps, tail = min(BLOCK, n), n - (k - 1) * BLOCK
    grid = np.zeros((steps, k), dtype=np.uint16)
    model, source = _Model(k), _Reader(blocks)
    for t in range(steps):
        if t % _FRESH == 0 and t:
            model.refresh()
        m = k if t < tail else k - 1
        model.look(m)
        lanes = slice(0, m)
        value = source.peek(lanes, _FLAG_BITS)
        not2, neither = value >= model.low, value >= model.high
        start = np.where(neither, model.high, np.where(not2, model.low, 0))
        end = np.where(neither, 1 << _FLAG_BITS, np.where(not2, model.high, model.low))
        flag = not2.astype(np.int64) + neither
        source.take(lanes, start, end - start)
        next_id = np.where(not2, model.offer1, model.offer2).astype(np.int64)
        rest = np.flatnonzero(neither)
        if len(rest):
            value = source.peek(rest, _CLASS_BITS + _SPARE_BITS)
            kind = (model.upto[rest, 1:] <= (value >> _SPARE_BITS)[:, None]).sum(axis=1)
            at = model.laneU[rest] + kind
            start = model.flat_upto[at]
            width = (model.flat_upto[at + 1] - start) << _UNUSED[kind]
            start <<= _SPARE_BITS
            bits = _divide(value - start, width)
            source.take(rest, start + bits * width, width)
            next_id[rest] = _FIRST[kind] + bits + 1
            model.flat_classes[model.laneC[rest] + kind] += 1
        source.shift()
        grid[t, :m] = next_id - 1
        model.learn(m, next_id, flag)
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def checksums(blocks: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(b) for b in blocks], dtype="<u4")
