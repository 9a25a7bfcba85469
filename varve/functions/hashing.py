"""Deterministic pseudo-random values derived from row keys.

The draw for a row depends only on (seed, tag, key), never on row order or partitioning, so a lost task
recomputes the same values and any engine with md5 can reproduce them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(keys, seed: int = 42, tag=""):
    """Hex md5 of seed|tag|key...; `tag` may be text or a column (an iteration number)."""
    tag_col = tag if isinstance(tag, Column) else F.lit(str(tag))
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), tag_col.cast("string"), *[c.cast("string") for c in cols]))


def uniform(key: Column, part: int = 0) -> Column:
    """Uniform in [0, 1) from eight hex digits of a hash key; `part` 0..3 chooses which eight."""
    return F.conv(F.substring(key, 1 + 8 * part, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _poisson_cuts(terms: int = 12) -> list[float]:
    total, cuts = 0.0, []
    for k in range(terms):
        total += math.exp(-1.0) / math.factorial(k)
        cuts.append(total)
    return cuts


POISSON_CUTS = _poisson_cuts()


def poisson1(u: Column) -> Column:
    """Poisson(1) draw by inversion of a uniform; the chain stops at the first cut above it."""
    draw = F.when(u < POISSON_CUTS[0], 0)
    for k, cut in enumerate(POISSON_CUTS[1:], start=1):
        draw = draw.when(u < cut, k)
    return draw.otherwise(len(POISSON_CUTS))
