"""Building blocks for the SQL statements the results are checked against."""

from __future__ import annotations

from ..functions import predicates as P
from ..functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def blanks() -> str:
    return "||".join(f"chr({ord(c)})" for c in T.BLANKS)


def split_chain(column: str) -> str:
    """Nested SQL expression yielding the list of sentences (last empty piece still there)."""
    e = f"(' ' || {column} || '  ')"
    for is_regex, a, b in T.split_rules():
        if is_regex:
            rep = b.replace("$", "\\")
            e = f"regexp_replace({e}, {q(a)}, {q(rep)}, 'g')"
        else:
            e = f"replace({e}, {q(a)}, {q(b)})"
    return f"list_transform(string_split({e}, '{T.BREAK}'), lambda s: trim(s, {blanks()}))"


def sentences_cte(name: str = "sent", source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE bodies giving ``name(key, s)`` with the finished sentence list."""
    return (
        f"{name}_raw AS (SELECT {key}, {split_chain(text)} AS s FROM {source}),\n"
        f"{name} AS (SELECT {key}, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS s FROM {name}_raw)"
    )


# \w of a Unicode-aware engine, spelled out for RE2
WORD = r"[\p{L}\p{N}\p{M}_]"
ADDRESS_SQL = "(?i)" + P.ADDRESS.replace(r"\w", WORD)
MAIL_SQL = "(?i)" + P.MAIL

TOKENS = r"regexp_extract_all(lower({c}), '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')"


def tokens(column: str) -> str:
    return TOKENS.replace("{c}", column)


def uniform(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT) / 4294967296.0)"
