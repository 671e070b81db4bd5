"""Category code packing: ``(grouptype << 8 | groupid) & 0xffff``.

``groupid`` is not masked to 8 bits before the OR, so a groupid above 255
bleeds into the grouptype byte; we keep that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def category_code(grouptype, groupid) -> Column:
    return F.shiftleft(_col(grouptype), 8).bitwiseOR(_col(groupid)).bitwiseAND(F.lit(0xFFFF))


def code_grouptype(code) -> Column:
    return F.shiftright(_col(code), 8)


def code_groupid(code) -> Column:
    return _col(code).bitwiseAND(F.lit(0xFF))
