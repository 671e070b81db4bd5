"""DuckDB SQL building blocks for the oracle of every registered query.

They restate the library's semantics in plain SQL over the same parquet tables
(byte positions via BLOB slices, ASCII folding via ``translate``).
"""

from __future__ import annotations

import re

from lexigate.functions.text import LOWER_ASCII, UPPER_ASCII
from lexigate.sources import derived

CHUNK = derived.CHUNK_BYTES


def fold(x: str) -> str:
    return f"translate({x}, '{LOWER_ASCII}', '{UPPER_ASCII}')"


def atoi(x: str) -> str:
    return (r"COALESCE(TRY_CAST(NULLIF(regexp_extract(" + x +
            r", '^[ \t\n\x0B\f\r]*([+-]?[0-9]+)', 1), '') AS INTEGER), 0)")


def cats(dictionary: str) -> str:
    return (f"SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS cat_index, id, "
            f"CAST((({atoi('grouptype')} << 8) | {atoi('groupid')}) & 65535 AS BIGINT) "
            f"AS category, keywordlist FROM {dictionary}")


def tokens(cats_cte: str) -> str:
    return ("SELECT cat_index, category, CAST(pos AS BIGINT) AS pos, word FROM ("
            "SELECT cat_index, category, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS pos "
            "FROM (SELECT cat_index, category, "
            "list_filter(string_split(keywordlist, ','), lambda x: x <> '') AS l "
            f"FROM {cats_cte}))")


def word_ids(tokens_cte: str) -> str:
    return ("SELECT CAST(row_number() OVER (ORDER BY f) AS BIGINT) AS iid, word, cat_num FROM "
            "(SELECT word, min((cat_index, pos)) AS f, CAST(count(*) AS BIGINT) AS cat_num "
            f"FROM {tokens_cte} GROUP BY word)")


def keyword_index(tokens_cte: str, ids_cte: str) -> str:
    return ("SELECT w.iid, t.word, w.cat_num, CAST(row_number() OVER "
            "(PARTITION BY t.word ORDER BY t.cat_index, t.pos) AS BIGINT) AS k, t.cat_index "
            f"FROM {tokens_cte} t JOIN {ids_cte} w ON t.word = w.word")


def totals(cats_cte: str, tokens_cte: str) -> str:
    return ("SELECT c.cat_index, c.category, CAST(COALESCE(t.n, 0) AS BIGINT) AS total_words "
            f"FROM {cats_cte} c LEFT JOIN (SELECT cat_index, count(*) AS n FROM {tokens_cte} "
            "GROUP BY cat_index) t ON c.cat_index = t.cat_index")


def service_patterns(ids_cte: str) -> str:
    return ("SELECT iid AS pattern_id, word AS pattern, CAST(strlen(word) AS BIGINT) AS n, "
            "FALSE AS nocase, 0 AS \"offset\", 0 AS depth, cat_num "
            f"FROM {ids_cte} WHERE strlen(word) > 0")


def hits(docs_cte: str, pats_cte: str, id_col: str = "doc_id", text: str = "text",
         how: str = "JOIN") -> str:
    """(id, pattern_id) pairs by containment under the case rule (no position rule)."""
    cond = (f"CASE WHEN p.nocase THEN contains({fold('d.' + text)}, {fold('p.pattern')}) "
            f"ELSE contains(d.{text}, p.pattern) END")
    return (f"SELECT d.{id_col}, p.pattern_id FROM {docs_cte} d {how} {pats_cte} p ON {cond}")


def occurrences(docs_cte: str, pats_cte: str, id_col: str = "doc_id", text: str = "text",
                rules: bool = True, extra: str = "") -> str:
    """Every occurrence (overlaps included) with byte ``idx``/``end_idx``;
    case rule, and the position rule when ``rules``."""
    extra_cols = (", " + extra) if extra else ""
    pos_rule = ("WHERE \"offset\" >= 0 AND depth >= 0 AND (\"offset\" = 0 OR \"offset\" <= idx) "
                "AND (depth = 0 OR \"offset\" + depth >= idx + n)") if rules else ""
    return (
        f"SELECT {id_col}, pattern_id, idx, idx + n AS end_idx, n{extra_cols} FROM ("
        f"SELECT {id_col}, pattern_id, n, \"offset\", depth, i AS idx{extra_cols} FROM ("
        f"SELECT {id_col}, pattern_id, n, \"offset\", depth, b, pb{extra_cols}, "
        "unnest(range(0, octet_length(b) - n + 1)) AS i FROM ("
        f"SELECT d.{id_col}, p.pattern_id, CAST(strlen(p.pattern) AS BIGINT) AS n, "
        "p.\"offset\", p.depth"
        + "".join(f", p.{c.strip()}" for c in extra.split(",") if c.strip()) + ", "
        f"CASE WHEN p.nocase THEN encode({fold('d.' + text)}) ELSE encode(d.{text}) END AS b, "
        f"CASE WHEN p.nocase THEN encode({fold('p.pattern')}) ELSE encode(p.pattern) END AS pb "
        f"FROM {docs_cte} d JOIN {pats_cte} p ON CASE WHEN p.nocase THEN "
        f"contains({fold('d.' + text)}, {fold('p.pattern')}) "
        f"ELSE contains(d.{text}, p.pattern) END)) WHERE b[i + 1:i + n] = pb) {pos_rule}")


def with_(ctes: list[tuple[str, str]], body: str, *base: str) -> str:
    """``WITH`` over the derived-table CTEs used (or named in ``base``), then ``ctes``."""
    text = body + " ".join(q for _, q in ctes)
    used = [n for n in derived.SQL if re.search(rf"\b{n}\b", text)]
    pre = derived.with_ctes("SELECT 1", *base, *used)
    parts = []
    if pre.startswith("WITH "):
        parts.append(pre[len("WITH "):pre.rindex("\nSELECT 1")])
    parts += [f"{n} AS ({q})" for n, q in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def word_dictionary_ctes(source: str = "word_dictionary", w: str = "w"
                         ) -> list[tuple[str, str]]:
    return [(f"{w}cats", cats(source)), (f"{w}tok", tokens(f"{w}cats")),
            (f"{w}ids", word_ids(f"{w}tok")), (f"{w}idx", keyword_index(f"{w}tok", f"{w}ids")),
            (f"{w}tot", totals(f"{w}cats", f"{w}tok")), (f"{w}pats", service_patterns(f"{w}ids"))]


def doc_dictionary_ctes() -> list[tuple[str, str]]:
    return [("dcats", cats("doc_dictionary")), ("dtok", tokens("dcats")),
            ("dids", word_ids("dtok"))]


def policy_pattern_ctes(pol: str, kw: str, name: str = "ppats") -> list[tuple[str, str]]:
    return [(name, (
        "SELECT CAST(row_number() OVER (ORDER BY g.id, k.id) AS BIGINT) AS pattern_id, "
        "k.keyword AS pattern, CAST(strlen(k.keyword) AS BIGINT) AS n, FALSE AS nocase, "
        "0 AS \"offset\", 0 AS depth, g.name AS policy, CAST(g.percent AS BIGINT) AS percent, "
        "CAST(s.content_num AS BIGINT) AS content_num "
        f"FROM {pol} g JOIN {kw} k ON g.name = k.group_name "
        f"JOIN (SELECT group_name, count(*) AS content_num FROM {kw} GROUP BY group_name) s "
        "ON s.group_name = g.name"))]


def verdict_ctes(subjects: str, id_col: str, text: str, threshold: int = 70,
                 source: str = "word_dictionary", w: str = "w", v: str = "v"
                 ) -> list[tuple[str, str]]:
    return word_dictionary_ctes(source, w) + [
        (f"{v}h", hits(subjects, f"{w}pats", id_col, text)),
        (f"{v}hc", f"SELECT h.{id_col}, k.cat_index FROM {v}h h JOIN {w}idx k "
                   "ON h.pattern_id = k.iid"),
        (f"{v}ch", f"SELECT {id_col}, cat_index, CAST(count(*) AS BIGINT) AS hits FROM {v}hc "
                   f"GROUP BY {id_col}, cat_index"),
        (f"{v}sc", f"SELECT c.{id_col}, t.category, (c.hits * 100) // t.total_words AS pct "
                   f"FROM {v}ch c JOIN {w}tot t ON c.cat_index = t.cat_index "
                   f"WHERE (c.hits * 100) // t.total_words > {threshold}"),
        (f"{v}best", f"SELECT {id_col}, arg_max(category, (pct, -category)) AS type FROM {v}sc "
                     f"GROUP BY {id_col}"),
        (f"{v}erdicts", f"SELECT s.{id_col}, CAST(COALESCE(b.type, 0) AS BIGINT) AS type "
                        f"FROM {subjects} s LEFT JOIN {v}best b ON s.{id_col} = b.{id_col}"),
    ]
