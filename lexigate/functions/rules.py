"""Per-hit rules applied to match rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def position_rule(idx="idx", n="n", offset="offset", depth="depth") -> Column:
    """Keep a hit starting at byte ``idx`` with length ``n``.

    0 means unbounded; a negative offset or depth never matches; the hit must
    start at or after ``offset`` and end at or before ``offset + depth``.
    """
    idx, n, offset, depth = map(_col, (idx, n, offset, depth))
    return ((offset >= 0) & (depth >= 0)
            & ((offset == 0) | (offset <= idx))
            & ((depth == 0) | ((offset + depth) >= (idx + n))))
