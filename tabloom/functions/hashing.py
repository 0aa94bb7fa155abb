"""Deterministic row hashes used for reproducible splits.

MD5 is used so that the same membership can be recomputed by any engine from
the seed and the key alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import c


def _digest(seed: int, key: Sequence[str]) -> Column:
    parts = [F.coalesce(c(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_word(seed: int, key: Sequence[str]) -> Column:
    """First 32 bits of the digest as 8 hex digits; ordered as text like the number."""
    return F.substring(_digest(seed, key), 1, 8)


def word_below(word: Column, fraction: float) -> Column:
    """``number(word) / 2**32 < fraction``, compared as text to avoid the conversion."""
    first_outside = math.ceil(fraction * 2.0**32)
    return F.lit(True) if first_outside >= 1 << 32 else word < F.lit(f"{first_outside:08x}")


def hash_rank_key(seed: int, key: Sequence[str]) -> Column:
    """60-bit integer ordering key; uniform on [0, 2**60)."""
    return F.conv(F.substring(_digest(seed, key), 1, 15), 16, 10).cast("bigint")


HASH_BITS = 60
