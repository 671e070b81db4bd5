"""Column expressions (built-in Spark functions only, all JVM-side)."""

from lexigate.functions.text import ascii_fold, atoi, split_tokens
from lexigate.functions.codes import category_code, code_groupid, code_grouptype
from lexigate.functions.rules import position_rule

__all__ = [
    "ascii_fold", "atoi", "split_tokens",
    "category_code", "code_groupid", "code_grouptype",
    "position_rule",
]
