"""Text functions as Spark columns: tokens, keys, snippets, cleaning, labels and screens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of two or more letters or digits; a segmenter for other scripts is passed in their place.
TOKEN = r"[\p{L}\p{N}]{2,}"


def tokens(text, pattern: str = TOKEN, stop: tuple[str, ...] = ()) -> Column:
    """Lower-cased tokens of a text in order, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(list(stop))) if stop else found


def query_tokens(*values: str) -> list[str]:
    """Distinct tokens of query strings, in order of first appearance."""
    import regex

    return list(dict.fromkeys(t for v in values for t in regex.findall(TOKEN, v.lower())))


def key(text) -> Column:
    """White space removed and lower-cased: the identity of a text for exact de-duplication."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def snippet(text, word: str, radius: int = 40) -> Column:
    """The surroundings of a word's first match, with ellipses where text is cut; null without a match."""
    c = F.col(text) if isinstance(text, str) else text
    at = F.instr(c, F.lit(word))
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + len(word) - 1 + radius, F.length(c))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(c, start, end - start + 1), F.when(end < F.length(c), "...").otherwise(""))
    return F.when(at > 0, cut)


def occurrences(text, part: str) -> Column:
    """Non-overlapping occurrences of a string."""
    c = F.col(text) if isinstance(text, str) else text
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def token_estimate(text) -> Column:
    """A cautious count of model tokens: a third of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(3.0)).cast("long")


def clamp(value, digits: int = 4) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), digits)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds, else null."""
    return F.coalesce(*[F.when(test, reason) for test, reason in rules])


def all_reasons(*rules: tuple[Column, str]) -> Column:
    """The reasons of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, reason) for test, reason in rules]))


def cleaned(text, steps: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(text, operations): replacements (name, pattern, replacement) in turn, and the names of those that changed it."""
    c = F.col(text) if isinstance(text, str) else text
    names = []
    for name, pattern, put in steps:
        after = F.regexp_replace(c, pattern, put)
        names.append(F.when(after != c, name))
        c = after
    return F.struct(c.alias("text"), F.array_compact(F.array(*names)).alias("operations"))


def seed_of(text) -> Column:
    """A non-negative 31-bit seed from a text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def script(text) -> Column:
    """ja, zh, mixed (Han and Latin), latin or unknown, by the letters a text holds."""
    c = F.col(text) if isinstance(text, str) else text
    latin = c.rlike("[A-Za-z]")
    return F.when(c.rlike("[぀-ヿ]"), "ja").when(c.rlike("[一-鿿]"), F.when(latin, "mixed").otherwise("zh")).when(latin, "latin").otherwise("unknown")


def escaped(text) -> Column:
    """Ampersands and angle brackets as character references."""
    c = F.col(text) if isinstance(text, str) else text
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(reference))
    return c


def json_part(text) -> Column:
    """From the first opening brace to the last closing one; null without them."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)
