"""A small object interface over the operators, in the order a matcher is used:
create, add patterns, (compile), search.

    m = KeywordMatcher(spark).add_patterns(df, "id", "word", nocase=False)
    m.hits(docs); m.occurrences(docs); m.any(docs); m.none(docs); m.count()

Everything returned is a lazy DataFrame; nothing is matched on the driver. Building
one reads one small aggregate of the patterns (their size and key lengths).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigate.operators import dictionary as D
from lexigate.operators import matching as M
from lexigate.operators import sequence as Q


class KeywordMatcher:
    def __init__(self, spark: SparkSession, strategy: str = "keys"):
        self.spark = spark
        self.strategy = strategy
        self._sets: list[DataFrame] = []

    def add_patterns(self, df: DataFrame, pattern_id: str, pattern: str, nocase=False,
                     offset=0, depth=0, payload: list[str] | None = None) -> "KeywordMatcher":
        """Register patterns (duplicates kept, empty ones rejected)."""
        self._sets.append(D.pattern_table(df, pattern_id, pattern, nocase, offset, depth,
                                          payload))
        return self

    @property
    def patterns(self) -> DataFrame:
        if not self._sets:
            raise ValueError("no patterns added")
        return D.pattern_union(*self._sets)

    def count(self) -> int:
        return D.pattern_count(self.patterns).first()[0]

    def hits(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        return M.keyword_hits(docs, self.patterns, id_col, text, self.strategy)

    def occurrences(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
        return M.keyword_occurrences(docs, self.patterns, id_col, text, keep)

    def first(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """What a callback that stops at the first match sees."""
        return Q.first_match(self.occurrences(docs, id_col, text), id_col)

    def any(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        return M.any_match_docs(docs, self.patterns, id_col, text, self.strategy)

    def none(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        return M.no_match_docs(docs, self.patterns, id_col, text, self.strategy)
