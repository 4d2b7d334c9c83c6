"""Non-decreasing numbers in about two bits more than the logarithm of their mean gap."""

from __future__ import annotations

import numpy as np

SAMPLE = 256


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


class EliasFano:
    """``select(i)`` is the i-th number; the low bits are packed, the high bits are gaps in unary.

    Every 256th number's place among the high bits is kept, so a selection scans few bytes.
    """

    def __init__(self, count: int, width: int, low: bytes, high: bytes, samples: np.ndarray):
        self.count, self.width, self.samples = count, width, samples
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        count = len(values)
        top = int(values[-1]) if count else 0
        width = max(0, (top // max(1, count)).bit_length() - 1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(places[-1]) + 1 if count else 0, np.uint8)
        bits[places] = 1
        low = _pack(values & np.uint64((1 << width) - 1), width)
        return cls(count, width, low, np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype(np.uint64))

    def _low(self, i: int) -> int:
        if not self.width:
            return 0
        start = i * self.width
        raw = self.low[start // 8:(start + self.width + 7) // 8].tobytes()
        return (int.from_bytes(raw, "little") >> start % 8) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        skip = place % 8
        while True:  # a step reads 64 bytes
            bits = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if left < len(ones):
                return int(byte * 8 + ones[left] - i) << self.width | self._low(i)
            left -= len(ones)
            byte, skip = byte + 64, 0

    def all(self) -> np.ndarray:
        return self.between(0, self.count)

    def between(self, first: int, last: int) -> np.ndarray:
        """The numbers from place ``first`` up to ``last``, decoded from the sample before on."""
        if first >= last:
            return np.empty(0, np.uint64)
        start, behind = first // SAMPLE, -(-last // SAMPLE)
        place = int(self.samples[start])
        stop = int(self.samples[behind]) // 8 + 1 if behind < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[place // 8:stop], bitorder="little")
        bits[:place % 8] = 0
        ones = np.flatnonzero(bits)[first - start * SAMPLE:last - start * SAMPLE] + place // 8 * 8
        high = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high
        at = first * self.width
        low = np.unpackbits(self.low[at // 8:(last * self.width + 7) // 8], bitorder="little")[at % 8:][:(last - first) * self.width]
        return high | (low.reshape(-1, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def parts(self) -> tuple[dict, list[bytes]]:
        """Header and byte strings to write, for :meth:`from_parts`."""
        return {"count": self.count, "width": self.width}, [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    @classmethod
    def from_parts(cls, head: dict, parts: list[bytes]) -> EliasFano:
        return cls(head["count"], head["width"], parts[0], parts[1], np.frombuffer(parts[2], np.uint64))
