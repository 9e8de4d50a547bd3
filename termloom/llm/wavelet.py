"""Wavelet matrix: a sequence of numbers as bit planes that answer by rank and select.

The first plane holds the highest bit of every number. Numbers with a 0 there, then
those with a 1, each in their order, give the sequence of which the second plane holds
the next bit, and so on. Following a position down the planes by rank gives its number,
following an interval counts a number, and following back up by select finds where a
number occurs.

In the file every plane is cut into blocks that are compressed one by one, and a
directory says where each block lies and how many ones stand before it, so a question
reads the blocks it touches and no others.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVMX0001"
#: Directory's place and length, end of the file.
FOOTER = "<QQ8s"
#: Bits of a plane in one block; a multiple of 64.
BLOCK_BITS = 1 << 18
COMPRESSION_LEVEL = 1
#: Blocks that a reader keeps unpacked, 64 KiB each.
KEPT_BLOCKS = 256


def write_planes(numbers: np.ndarray, write: Callable[[bytes], object]) -> bytes:
    """Write the compressed planes of `numbers`, unsigned, from place 0 of a file on.

    Returns the directory to be given to `Planes`.
    """
    width = max(1, int(numbers.max(initial=0)).bit_length())
    # Narrow numbers move faster.
    numbers = numbers.astype(np.uint16 if width <= 16 else np.uint32)
    compressor = zstandard.ZstdCompressor(level=COMPRESSION_LEVEL)
    zeros, lengths, ones = [], [], []
    for bit in range(width - 1, -1, -1):
        plane = (numbers >> bit) & 1 == 1
        zeros.append(len(plane) - int(np.count_nonzero(plane)))
        packed = np.packbits(plane, bitorder="little")
        for start in range(0, len(plane), BLOCK_BITS):
            ones.append(int(np.count_nonzero(plane[start : start + BLOCK_BITS])))
            block = compressor.compress(packed[start // 8 : (start + BLOCK_BITS) // 8].tobytes())
            lengths.append(len(block))
            write(block)
        numbers = np.concatenate([numbers[~plane], numbers[plane]])
    head = struct.pack("<QQ", len(numbers), width)
    columns = (np.array(column, "<u8").tobytes() for column in (zeros, lengths, ones))
    return head + b"".join(columns)


class Planes:
    """A written wavelet matrix. `read_at(length, place)` reads from its file."""

    def __init__(self, directory: bytes, read_at: Callable[[int, int], bytes]):
        self.size, self.width = struct.unpack_from("<QQ", directory)
        self.blocks = -(-self.size // BLOCK_BITS)
        columns = np.frombuffer(directory, "<u8", offset=16).astype(np.int64)
        self.zeros = columns[: self.width]
        lengths, ones = columns[self.width :].reshape(2, self.width, self.blocks)
        self.lengths = lengths
        self.places = np.concatenate([[0], lengths.ravel().cumsum()])[:-1].reshape(lengths.shape)
        # Ones before each block of a plane, and in the whole plane.
        self.before = np.zeros((self.width, self.blocks + 1), np.int64)
        np.cumsum(ones, axis=1, out=self.before[:, 1:])
        self.read_at = read_at
        self.block = lru_cache(KEPT_BLOCKS)(self._block)

    def _bytes(self, plane: int, block: int) -> bytes:
        length, place = int(self.lengths[plane, block]), int(self.places[plane, block])
        return zstandard.ZstdDecompressor().decompress(self.read_at(length, place))

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a block and the ones before each."""
        data = self._bytes(plane, block)
        words = np.frombuffer(data + bytes(-len(data) % 8), "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return words, np.concatenate([[0], counts.cumsum()])[:-1]

    def bits_and_ranks(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place, and the ones of the plane before it. A place may be
        the end of the plane, whose bit is then 0."""
        bits, ranks = np.zeros(len(at), bool), np.empty(len(at), np.int64)
        numbers = at // BLOCK_BITS
        for number in np.unique(numbers):
            here = numbers == number
            if number == self.blocks:
                ranks[here] = self.before[plane, -1]
                continue
            words, before = self.block(plane, int(number))
            inside = at[here] % BLOCK_BITS
            word, shift = inside // 64, (inside % 64).astype(np.uint64)
            # The end of the plane may lie right behind the last word.
            held = word < len(words)
            word = np.minimum(word, len(words) - 1)
            below = np.bitwise_count(words[word] & ((np.uint64(1) << shift) - np.uint64(1)))
            below = np.where(held, below, np.bitwise_count(words[word]))
            bits[here] = held & ((words[word] >> shift) & np.uint64(1) == 1)
            ranks[here] = self.before[plane, number] + before[word] + below
        return bits, ranks

    def select(self, plane: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Places of the ones, or zeros, of a plane that have `ranks` of their kind before them."""
        starts = np.arange(self.blocks + 1) * BLOCK_BITS
        before = self.before[plane] if bit else np.minimum(starts, self.size) - self.before[plane]
        numbers = np.searchsorted(before, ranks, side="right") - 1
        found = np.empty(len(ranks), np.int64)
        for number in np.unique(numbers):
            here = numbers == number
            words, _ = self.block(plane, int(number))
            held = min(BLOCK_BITS, self.size - int(number) * BLOCK_BITS)
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")[:held]
            places = np.flatnonzero(bits == bit)
            found[here] = number * BLOCK_BITS + places[ranks[here] - before[number]]
        return found

    def access(self, places: np.ndarray) -> np.ndarray:
        """The numbers at `places`."""
        at, numbers = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for plane in range(self.width):
            bits, ranks = self.bits_and_ranks(plane, at)
            numbers = numbers << 1 | bits
            at = np.where(bits, self.zeros[plane] + ranks, at - ranks)
        return numbers

    def _interval(self, number: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of `number` among the places from `start` to `end` lie below
        the last plane."""
        if number < 0 or number >> self.width:
            return 0, 0
        for plane in range(self.width):
            _, (low, high) = self.bits_and_ranks(plane, np.array([start, end]))
            if number >> (self.width - 1 - plane) & 1:
                start, end = int(self.zeros[plane] + low), int(self.zeros[plane] + high)
            else:
                start, end = start - int(low), end - int(high)
        return start, end

    def count(self, number: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of `number` at places from `start` up to `end`."""
        low, high = self._interval(number, start, self.size if end is None else end)
        return high - low

    def occurrences(self, number: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """The places of `number` from `start` up to `end`, ascending."""
        low, high = self._interval(number, start, self.size if end is None else end)
        at = np.arange(low, high)
        for plane in range(self.width - 1, -1, -1):
            bit = number >> (self.width - 1 - plane) & 1
            at = self.select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last: what stands behind a plane is
        dealt out again by its bits."""
        numbers = np.zeros(self.size, np.uint16 if self.width <= 16 else np.uint32)
        for plane in range(self.width - 1, -1, -1):
            packed = b"".join(self._bytes(plane, block) for block in range(self.blocks))
            ones = np.unpackbits(
                np.frombuffer(packed, np.uint8), count=self.size, bitorder="little"
            ).view(bool)
            dealt = np.empty_like(numbers)
            dealt[~ones] = numbers[: self.zeros[plane]]
            dealt[ones] = numbers[self.zeros[plane] :] | (1 << (self.width - 1 - plane))
            numbers = dealt
        return numbers
