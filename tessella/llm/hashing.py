"""Word, shingle and MinHash values of whole text columns, as numpy arrays.

A word is a run of bytes outside space and 0x09-0x0D, with A-Z lower-cased.
Its hash is a pair of polynomials over its bytes, modulo two primes of 31
bits and at bases without structure, taken from prefix sums so that a block of
text costs a few array passes, and then mixed.  (Modulo a power of two any
base would give some words of regular structure equal values.)  Work goes
block by block, so memory follows the number of words and not of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 19
# (prime, base): sums of 2**19 bytes times a residue stay below 2**59.
_FIELDS = ((2147483647, 1403580417), (2147483629, 1828906513))
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each field the powers of its base and of the inverse of it."""
    if not _powers:
        for prime, base in _FIELDS:
            both = []
            for step in (base, pow(base, -1, prime)):
                powers = np.ones(_BLOCK + 1, np.uint64)
                filled = 1
                while filled < len(powers):
                    part = min(filled, len(powers) - filled)
                    powers[filled : filled + part] = powers[:part] * _U(pow(step, filled, prime)) % _U(prime)
                    filled += part
                both.append(powers)
            _powers.append((both[0], both[1]))
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _cut(data: np.ndarray, start: int, end: int) -> int:
    """The end of a block from ``start``: a white-space byte where there is one, or the end."""
    stop = min(start + _BLOCK, end)
    if stop == end:
        return end
    tail = data[start:stop]
    space = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
    return start + int(space[-1]) + 1 if len(space) else stop


def _block_words(data: np.ndarray, breaks: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a block; ``breaks``: row starts, at which a word begins anew."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    if len(breaks):
        first[breaks] = solid[breaks]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    low = data.astype(np.uint64)
    low += _U(1)
    if fold:
        low[(data >= 65) & (data <= 90)] += _U(32)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = []
    for (prime, _), (up, down) in zip(_FIELDS, _tables(), strict=True):
        np.cumsum(low * up[: len(data)], out=sums[1:])
        values.append((sums[ends] - sums[starts]) % _U(prime) * down[starts] % _U(prime))
    hashed = values[0] << _U(32) | values[1]
    hashed += (ends - starts).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    return mix64(hashed), starts, ends


def word_spans(data: np.ndarray, rows: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of ``data``, whose rows start at ``rows``; fold: A-Z as a-z."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)]
    start = 0
    while start < len(data):
        stop = _cut(data, start, len(data))
        lo, hi = np.searchsorted(rows, [start, stop], side="left")
        breaks = np.unique(rows[lo:hi] - start)
        if stop - start == _BLOCK and stop < len(data) and not _is_space(data[stop - 1]):
            # no white space in a whole block: its first word on its own
            stop = _word_end(data, start, rows)
        if stop - start > _BLOCK:
            hashed = np.array([_long_word(data[start:stop], fold)], np.uint64)
            parts.append((hashed, np.array([start]), np.array([stop])))
        else:
            hashed, begin, end = _block_words(data[start:stop], breaks[breaks < stop - start], fold)
            parts.append((hashed, begin + start, end + start))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the offsets of its rows among them."""
    data, rows = text_bytes(column)
    hashed, starts, _ = word_spans(data, rows)
    return hashed, np.searchsorted(starts, rows, side="left")


_SOLID = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of ``data``, whose rows start at ``rows``."""
    solid = _SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    breaks = rows[rows < len(data)]
    first[breaks] = solid[breaks]
    last = solid
    last[:-1] &= ~solid[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Words by numbers from 0 in the order they are met, told apart by their bytes.

    A word is looked up by a hash of its bytes, eight at a time, in an open
    table; on a hit its bytes are compared with those kept, eight at a time.
    Words over ``LONG`` bytes, and words that share a hash with another, are
    kept in a dictionary of their own.  ``new`` has the words that the last
    call met first, and ``known`` counts all of them.
    """

    LONG = 256

    def __init__(self, bits: int = 64):
        self.known, self.new = 0, []
        self._odd: dict[bytes, int] = {}
        self._keep = _U((1 << bits) - 1)
        self._slots = np.full(1 << 12, -1, np.int32)
        self._hash, self._size, self._at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._bytes = np.zeros(8, np.uint8)

    @staticmethod
    def _eights(data: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on as a number; eight bytes must follow the last place."""
        return np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data, strides=(1,))

    def _hashes(self, eights: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = mix64((eights[begin] & _LOW[np.minimum(size, 8)]) * _U(0x9FB21C651E98DF25) + size.astype(np.uint64))
        k, left = 8, np.flatnonzero(size > 8)
        while len(left):
            out[left] = mix64(out[left] * _U(0xC2B2AE3D27D4EB4F) + (eights[begin[left] + k] & _LOW[np.minimum(size[left] - k, 8)]))
            k += 8
            left = left[size[left] > k]
        return out & self._keep

    def _same(self, eights: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether words have the bytes of these numbers."""
        own, at = self._eights(self._bytes), self._at[number]
        out = self._size[number] == size
        out &= (eights[begin] ^ own[at]) & _LOW[np.minimum(size, 8)] == 0
        k, left = 8, np.flatnonzero(out & (size > 8))
        while len(left):
            differ = (eights[begin[left] + k] ^ own[at[left] + k]) & _LOW[np.minimum(size[left] - k, 8)] != 0
            out[left[differ]] = False
            k += 8
            left = left[~differ]
            left = left[size[left] > k]
        return out

    def _found(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        mask = len(self._slots) - 1
        place = (hashed >> _U(20) & _U(mask)).astype(np.int64)
        out = self._slots[place].astype(np.int64)
        left = np.flatnonzero(out >= 0)
        left = left[self._hash[out[left]] != hashed[left]]
        while len(left):
            place[left] = place[left] + 1 & mask
            out[left] = self._slots[place[left]]
            left = left[out[left] >= 0]
            left = left[self._hash[out[left]] != hashed[left]]
        return out

    def _enter(self, number: np.ndarray) -> None:
        mask = len(self._slots) - 1
        place = (self._hash[number] >> _U(20) & _U(mask)).astype(np.int64)
        while len(number):
            free = self._slots[place] < 0
            self._slots[place[free]] = number[free]
            left = self._slots[place] != number
            number, place = number[left], place[left] + 1 & mask

    def _add(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, hashed: np.ndarray) -> None:
        number = np.arange(self.known, self.known + len(begin))
        self.known += len(begin)
        self.new += [data[a : a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        own = data[ranges(begin, size)]
        self._at = np.append(self._at, len(self._bytes) - 8 + np.cumsum(size) - size)
        self._bytes = np.concatenate([self._bytes[:-8], own, np.zeros(8, np.uint8)])
        self._hash, self._size = np.append(self._hash, hashed), np.append(self._size, size)
        if 2 * self.known > len(self._slots):
            self._slots = np.full(1 << (2 * self.known).bit_length(), -1, np.int32)
            number = np.flatnonzero(self._size >= 0)
        self._enter(number)

    def _oddly(self, words: list[bytes]) -> list[int]:
        """Numbers of words that the table can't hold, which get no place and size -1 there."""
        for word in words:
            if word not in self._odd:
                self._odd[word] = self.known
                self.known += 1
                self.new.append(word)
        new = self.known - len(self._size)
        self._hash, self._at = np.append(self._hash, np.zeros(new, np.uint64)), np.append(self._at, np.zeros(new, np.int64))
        self._size = np.append(self._size, np.full(new, -1))
        return [self._odd[w] for w in words]

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of a string column, and the offsets of its rows among them; null counts as empty."""
        self.new = []
        data, rows = text_bytes(column)
        begin, end = word_bounds(data, rows)
        data, size = np.append(data, np.zeros(8, np.uint8)), end - begin
        eights = self._eights(data)
        out = np.full(len(begin), -1)
        usual = np.flatnonzero(size <= self.LONG)
        a, n = begin[usual], size[usual]
        hashed = self._hashes(eights, a, n)
        number = self._found(hashed)
        new = np.flatnonzero(number < 0)
        if len(new):
            _, first = np.unique(hashed[new], return_index=True)
            first = new[np.sort(first)]
            self._add(data, a[first], n[first], hashed[first])
            number[new] = self._found(hashed[new])
        whole = self._same(eights, a, n, number)
        out[usual[whole]] = number[whole]
        odd = np.flatnonzero(out < 0)
        if len(odd):
            out[odd] = self._oddly([data[a:b].tobytes() for a, b in zip(begin[odd].tolist(), end[odd].tolist(), strict=True)])
        return out, np.searchsorted(begin, rows, side="left")


def let_go() -> None:
    """Give memory that Arrow has no more use for back to the machine; else a worker keeps the most that any batch took."""
    pa.default_memory_pool().release_unused()


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """A string column in slices of about so many bytes, of a row at least."""
    _, begin = text_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + most, side="right")) - 1)
        yield column.slice(i, j - i)
        i = j


def _is_space(byte: int) -> bool:
    return byte == 32 or 9 <= byte <= 13


def _word_end(data: np.ndarray, start: int, rows: np.ndarray) -> int:
    stop = int(rows[np.searchsorted(rows, start, side="right")])
    at = start
    while at < stop:
        piece = data[at : min(at + _BLOCK, stop)]
        space = np.flatnonzero((piece == 32) | ((piece >= 9) & (piece <= 13)))
        if len(space):
            return at + int(space[0])
        at += len(piece)
    return stop


def _long_word(data: np.ndarray, fold: bool) -> int:
    import hashlib

    low = data.copy()
    if fold:
        low[(data >= 65) & (data <= 90)] += 32
    return int.from_bytes(hashlib.blake2b(low.tobytes(), digest_size=8).digest(), "little")


def ranges(starts: np.ndarray, counts: np.ndarray, step: int = 1) -> np.ndarray:
    """The indices of all runs of ``counts`` from ``starts``, end to end."""
    ends = np.cumsum(counts)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    return np.repeat(starts, counts) + within * step


def flat_shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in order, and the offsets of the rows among them.

    A row of fewer than ``size`` words has its whole sequence as one shingle;
    a row without words has none.
    """
    words, rows = word_hashes(column)
    counts = np.diff(rows)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.append(0, np.cumsum(made))
    out = np.empty(at[-1], np.uint64)
    every = shingles(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    long = counts >= size
    out[ranges(at[:-1][long], made[long])] = every[ranges(rows[:-1][long], made[long])]
    for i in np.flatnonzero((counts > 0) & ~long).tolist():
        out[at[i]] = shingles(words[rows[i] : rows[i + 1]], size)[0]
    return out, at


def shingle_rows(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each row in order."""
    out, at = flat_shingles(column, size)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield out[lo:hi]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of ``size`` consecutive words; of all together if they are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, size)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out *= _U(0x9FB21C651E98DF25)
        out += words[k : n - width + 1 + k]
    return mix64(out)


class Circulant:
    """MinHash coordinates from two permutations of the 32-bit values, the second shifted circularly.

    The first permutation scatters a shingle to a position; coordinate ``k``
    is the least value of the second one over the positions moved by ``k``.
    """

    def __init__(self, coordinates: int, seed: int = 1):
        self.coordinates = coordinates
        self.seed = np.uint32((seed * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF)

    def positions(self, hashed: np.ndarray) -> np.ndarray:
        x = (hashed >> _U(32)).astype(np.uint32) ^ self.seed
        x *= np.uint32(0xCC9E2D51)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x1B873593)
        return x

    def second(self, x: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The second permutation, in place; ``room``: as long as ``x``, for its shifts."""
        np.right_shift(x, 16, out=room)
        x ^= room
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, 13, out=room)
        x ^= room
        x *= np.uint32(0xC2B2AE35)
        np.right_shift(x, 16, out=room)
        x ^= room
        return x

    def signatures(self, sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
        """One row of coordinates for each set, none of which may be empty."""
        if not sets:
            return np.empty((0, self.coordinates), np.uint32)
        return self.runs(np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets)]), block)

    def runs(self, values: np.ndarray, at: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """One row of coordinates for each run of ``values`` between ``at``, block by block so that arrays stay in a cache."""
        out = np.empty((len(at) - 1, self.coordinates), np.uint32)
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + block, side="right")) - 1)
            if at[j] - at[i] > block:
                cuts = np.append(np.arange(at[i], at[j], block), at[j])
                parts = [self._block(values[a:b], np.zeros(1, np.int64))[0] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                out[i] = np.minimum.reduce(parts)
            else:
                out[i:j] = self._block(values[at[i] : at[j]], at[i:j] - at[i])
            i = j
        return out

    def _block(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        where = self.positions(values)
        x, room = np.empty_like(where), np.empty_like(where)
        out = np.empty((len(at), self.coordinates), np.uint32)
        for k in range(self.coordinates):
            np.subtract(where, np.uint32(k), out=x)
            out[:, k] = np.minimum.reduceat(self.second(x, room), at)
        return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit value for each band of ``rows`` coordinates, different between bands."""
    n, total = signatures.shape
    bands = total // rows
    part = signatures[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0x2545F4914F6CDD1D), (n, bands)).copy()
    for k in range(rows):
        out = mix64(out * _U(0x9FB21C651E98DF25) + part[:, :, k])
    return out
