"""URL filters: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; its terms are still counted
(none in a null url). Repeated rows give repeated results. Of the rules that fit, the longest wins; two rules of the
same text may not differ in verdict. Extra columns of the table are not read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: One of these is enough.
STRICT = ("adult", "casino", "cheap-pills", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
#: Weight of each; the sum over distinct terms must reach ``SOFT_LIMIT``.
SOFT = (("betting", 1.0), ("bonus", 1.0), ("cheap", 1.0), ("clickbait", 1.0), ("crypto", 1.0), ("deals", 1.0), ("dating", 1.0), ("free", 1.0), ("jackpot", 1.0), ("pills", 1.0), ("poker", 1.0), ("spam", 1.0), ("winner", 1.0))
SOFT_LIMIT = 2.0
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_RESULT = "host string, path string, rule string, n_strict bigint, n_soft bigint, soft_weight double, terms array<string>, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        cut = rest.find(mark)
        rest = rest if cut < 0 else rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_ASCII_LOWER), path


@lru_cache(maxsize=4)
def _automaton(strict: tuple, soft: tuple):
    found = ahocorasick.Automaton()
    for term, weight in soft:
        found.add_word(term, (term, weight, False))
    for term in strict:
        found.add_word(term, (term, 0.0, True))
    found.make_automaton()
    return found


def _alnum(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def count_terms(url: str | None, strict: tuple, soft: tuple) -> tuple[int, int, float, list[str]]:
    """Distinct strict and soft terms that stand between bounds (no ASCII letter or digit on either side)."""
    hits: dict[str, tuple[float, bool]] = {}
    if url and (strict or soft):
        low = url.translate(_ASCII_LOWER)
        for end, (term, weight, is_strict) in _automaton(strict, soft).iter(low):
            if not _alnum(low, end - len(term)) and not _alnum(low, end + 1):
                hits[term] = (weight, is_strict)
    n_strict = sum(s for _, s in hits.values())
    return n_strict, len(hits) - n_strict, float(sum(w for w, s in hits.values() if not s)), sorted(hits)


def _rule(host: str, path: str, rules: dict[str, list[tuple[int, str, str, str]]]) -> tuple[str | None, str | None]:
    """Text and verdict of the longest rule that fits: one lookup for the host and each of its parent domains."""
    best, name = (0, "", None, None), host
    while name:
        for size, prefix, text, verdict in rules.get(name, ()):
            if size > best[0] and path.startswith(prefix):
                best = (size, prefix, text, verdict)
        _, _, name = name.partition(".")
    return best[2], best[3]


def url_verdicts(url: Column, rules=RULES, strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT) -> Column:
    """Struct of host, path, rule, term counts and verdict for a url column."""
    strict, soft = tuple(strict), tuple(soft)
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, host, prefix in rules:
        by_host.setdefault(host, []).append((len(host) + len(prefix), prefix, host + prefix, verdict))

    @F.pandas_udf(_RESULT)
    def judge(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for url in urls:
            host, path = split_url(url)
            rule, verdict = _rule(host, path, by_host)
            n_strict, n_soft, weight, terms = count_terms(url, strict, soft)
            rows.append((host, path, rule, n_strict, n_soft, weight, terms, verdict or ("block" if n_strict or (n_soft > 1 and weight >= limit) else "allow")))
        return pd.DataFrame(rows, columns=[part.split()[0] for part in _RESULT.split(", ")])

    return judge(url)


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", **settings) -> DataFrame:
    """One row per page: key, host, path, rule, n_strict, n_soft, soft_weight, terms, verdict. Reads two columns."""
    own = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"))
    return own.select(F.col("_key").alias(key), url_verdicts(F.col("_url"), **settings).alias("v")).select(key, "v.*")
