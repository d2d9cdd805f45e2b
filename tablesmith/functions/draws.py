"""Counter-based draws: every random value is a pure function of (seed, field, key, attempt, slot).

No state is kept, so a retried task, another partitioning or a lost executor gives the same rows.
``portable`` draws slice one md5 into four 32-bit numbers and can be reproduced by any SQL engine;
``fast`` draws slice one xxhash64 into two and are meant for bulk jobs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


@dataclass(frozen=True)
class Draws:
    seed: int
    field: str
    key: Column
    attempt: Column | int = 0
    mode: str = "fast"

    def _attempt(self) -> Column:
        return self.attempt if isinstance(self.attempt, Column) else F.lit(self.attempt)

    def hex(self, block: int = 0) -> Column:
        """32 hex digits."""
        tag = self.field if block == 0 else f"{self.field}#{block}"
        parts = [F.lit(f"{self.seed}|{tag}|"), self.key.cast("string"), F.lit("|"), self._attempt().cast("string")]
        return F.md5(F.concat(*parts).cast("binary"))

    def _word(self, block: int) -> Column:
        digest = hashlib.md5(f"{self.seed}|{self.field}|{block}".encode()).digest()
        salt = int.from_bytes(digest[:8], "big", signed=True)
        return F.xxhash64(F.lit(salt), self.key, self._attempt())

    def u32(self, slot: int = 0) -> Column:
        """An integer in [0, 2**32)."""
        if self.mode == "portable":
            return F.conv(F.substring(self.hex(slot // 4), 8 * (slot % 4) + 1, 8), 16, 10).cast("bigint")
        word = self._word(slot // 2)
        return F.shiftrightunsigned(word, 32) if slot % 2 == 0 else word.bitwiseAND(F.lit(SPAN - 1))

    def below(self, n: int | Column, slot: int = 0) -> Column:
        """An integer in [0, n). Ranges above 2**31 are drawn from two slots (``slot`` and the next), in exact decimals."""
        if isinstance(n, int) and not 0 < n < 1 << 62:
            raise ValueError(f"draw range {n} is outside 1 .. 2**62")
        narrow = lambda k: F.shiftright(self.u32(slot) * k, 32)
        if isinstance(n, int):
            return narrow(n) if n <= 1 << 31 else self._wide(F.lit(n), slot)
        return F.when(n <= 1 << 31, narrow(F.least(n, F.lit(1 << 31)))).otherwise(self._wide(n, slot))

    def _wide(self, n: Column, slot: int) -> Column:
        # floor(word * n / 2**64) for a 64-bit word, as (high * n + floor(low * n / 2**32)) / 2**32.
        exact = lambda c: c.cast("decimal(20,0)")
        low = F.call_function("div", exact(self.u32(slot + 1)) * exact(n), exact(F.lit(SPAN)))
        return F.call_function("div", exact(self.u32(slot)) * exact(n) + low, exact(F.lit(SPAN)))

    def between(self, low: int, high: int, slot: int = 0) -> Column:
        return F.lit(low) + self.below(high - low + 1, slot)

    def unit(self, slot: int = 0) -> Column:
        """A double in [0, 1)."""
        return self.u32(slot) / F.lit(float(SPAN))


def permutation(seed: int, field: str, modulus: int) -> tuple[int, int]:
    """Multiplier and offset of x -> (a*x + b) mod modulus, a bijection on [0, modulus) free of overflow."""
    from math import gcd

    word = hashlib.md5(f"{seed}|{field}|permutation".encode()).digest()
    ceiling = min(modulus, (1 << 62) // modulus)
    a = int.from_bytes(word[:8], "big") % ceiling
    while a < 1 or gcd(a, modulus) != 1:
        a = (a + 1) % ceiling
    return a, int.from_bytes(word[8:], "big") % modulus
