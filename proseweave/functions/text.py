"""Column expressions over text. Everything here is row-local and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word lists and patterns of the rule-based sentence splitter. Results depend
# on them exactly.
TITLES = "(Mr|St|Mrs|Ms|Dr)[.]"
COMPANY_SUFFIXES = "(Inc|Ltd|Jr|Sr|Co)"
SENTENCE_STARTERS = (
    r"(Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s"
    r"|That\s|This\s|Wherever)"
)
ACRONYMS = "([A-Z][.][A-Z][.](?:[A-Z][.])?)"
SITE_ENDINGS = "[.](com|net|org|io|gov|edu|me)"
LETTER = "([A-Za-z])"
KEEP_DOT, BREAK = "<prd>", "<stop>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_DOT_RUN = "<mrd>"  # our own marker: dots of an ellipsis while the run is rewritten


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a variable, so that ``body`` may use it many times (also inside lambdas) and it
    is still computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later steps reference freely. The one-element explode keeps the
    optimizer from inlining the expression into every place it is used."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def with_sentences(df: DataFrame, text: str, out: str = "sentences") -> DataFrame:
    return once(df, out, sentences(F.col(text)))


def split_rules() -> list[tuple[bool, str, str]]:
    """The splitter as data: (is_regex, search, replacement), to be applied in this order."""
    l, p, s = LETTER, KEEP_DOT, BREAK
    regex = lambda a, b: (True, a, b)
    plain = lambda a, b: (False, a, b)
    return [
        plain("\n", " "),
        regex(TITLES, f"$1{p}"),
        regex(SITE_ENDINGS, f"{p}$1"),
        regex("([0-9])[.]([0-9])", f"$1{p}$2"),
        # an ellipsis keeps its dots and ends the sentence
        regex("([.]{2,})", f"$1{s}"),
        plain("..", _DOT_RUN * 2),
        plain(f"{_DOT_RUN}.", _DOT_RUN * 2),
        plain(_DOT_RUN, p),
        plain("Ph.D.", f"Ph{p}D{p}"),
        regex(rf"\s{l}[.] ", f" $1{p} "),
        regex(f"{ACRONYMS} {SENTENCE_STARTERS}", f"$1{s} $2"),
        regex(f"{l}[.]{l}[.]{l}[.]", f"$1{p}$2{p}$3{p}"),
        regex(f"{l}[.]{l}[.]", f"$1{p}$2{p}"),
        regex(f" {COMPANY_SUFFIXES}[.] {SENTENCE_STARTERS}", f" $1{s} $2"),
        regex(f" {COMPANY_SUFFIXES}[.]", f" $1{p}"),
        regex(f" {l}[.]", f" $1{p}"),
        # a closing quote stays with its sentence
        plain(".”", "”."),
        plain('."', '".'),
        plain('!"', '"!'),
        plain('?"', '"?'),
        plain(".", f".{s}"),
        plain("?", f"?{s}"),
        plain("!", f"!{s}"),
        plain(p, "."),
    ]


# every character a Unicode-aware strip removes
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def sentences(text: Column) -> Column:
    """Sentence array of a text. Inner empty pieces are kept, a last empty piece is dropped."""
    t = F.concat(F.lit(" "), text, F.lit("  "))
    for is_regex, search, repl in split_rules():
        if is_regex:
            unicode_space = "(?U)" if "\\s" in search else ""
            # most places are ruled out by their first letter, before any title is tried
            first = "(?=[DMS])" if search == TITLES else ""
            t = F.regexp_replace(t, unicode_space + first + search, repl)
        else:
            t = F.replace(t, F.lit(search), F.lit(repl))
    parts = F.transform(F.split(t, BREAK, -1), _trim)
    return let(
        parts, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    )


def spoken_sentences(text: Column) -> Column:
    """Sentence array without empty pieces: what the distance features are computed on."""
    return F.filter(sentences(text), lambda s: F.length(s) > 0)


def squeeze_periods(text: Column) -> Column:
    return F.regexp_replace(text, r"\.+", ".")


def space_after_stop(text: Column) -> Column:
    """Add a space after . ! ? when a non-space follows (decimals are broken up as well)."""
    return F.regexp_replace(text, r"(?U)([.!?])(\S)", "$1 $2")


def respaced_sentences(text: Column) -> Column:
    return F.array_join(sentences(space_after_stop(text)), " ")


def flatten_breaks(text: Column) -> Column:
    return F.translate(text, "\n\t", "  ")


def drop_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def period_pieces(text: Column) -> Column:
    """Plain split on the period, trailing empty pieces kept."""
    return F.split(text, r"\.", -1)


def tidy_generated(text: Column) -> Column:
    """Drop an unfinished last sentence, delete special characters, join with periods."""
    whole = let(
        sentences(text),
        lambda a: F.when(F.size(a) == 0, a)
        .when(F.endswith(F.element_at(a, -1), F.lit(".")), a)
        .otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))),
    )
    stripped = F.transform(whole, lambda s: F.regexp_replace(s, r"(?U)[^a-zA-Z0-9\s]", ""))
    return F.replace(F.array_join(stripped, "."), F.lit("\n"), F.lit(" "))


def word_tokens(sentence: Column) -> Column:
    """Lower-case tokens: a run of word characters, or one other visible character."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def word_count(sentence: Column) -> Column:
    return F.size(F.split(sentence, " ", -1))


def effective_text(text: Column, altered: Column) -> Column:
    return F.coalesce(text, altered)


def index_list(raw: Column) -> Column:
    """``"(3, 5)"`` or ``"[3, 5]"`` as an int array; anything else is an empty array."""
    as_json = F.translate(raw, "()", "[]")
    return F.coalesce(F.from_json(as_json, "array<int>"), F.array().cast("array<int>"))


def flatten_once(nested: Column) -> Column:
    return F.flatten(nested)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null for a zero denominator, NaN or an infinite quotient."""
    q = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return finite(q)


def finite(x: Column) -> Column:
    """NaN and ±inf become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def nan_to_null(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def nan_to_num(x: Column) -> Column:
    """Missing to 0, ±inf to the largest finite double of that sign."""
    big = 1.7976931348623157e308
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(0.0))
        .when(x == float("inf"), F.lit(big))
        .when(x == float("-inf"), F.lit(-big))
        .otherwise(x)
    )


def highlight(text: Column, piece: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    return F.replace(text, piece, F.concat(F.lit(before), piece, F.lit(after)))


def uniform_of(*parts: Column) -> Column:
    """Repeatable uniform in [0,1) from the first 32 bits of an md5 over the joined parts.
    Unlike ``rand`` it does not depend on partitioning, so a retried task draws the same number."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
