"""Text expressions: normalising, term extraction, lexicon scans, rule labels. Column in, Column out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that define what a manual repost, a tracking parameter, a link and a handle are.
MANUAL_REPOST = r"(?i)^\s*RT\s+@"
TRACKING = r"[?&](utm_[^&#]*|fbclid=[^&#]*|gclid=[^&#]*)"
LINK = r"https?://\S+|www\.\S+"
HANDLE = r"@\w+"


def url_key(url: Column) -> Column:
    """A link without tracking parameters, closing question mark or slashes, in lower case."""
    bare = F.regexp_replace(F.lower(url), TRACKING, "")
    return F.regexp_replace(F.regexp_replace(bare, r"\?$", ""), "/+$", "")


def is_manual_repost(text: Column) -> Column:
    return F.coalesce(text.rlike(MANUAL_REPOST), F.lit(False))


def text_key(text: Column) -> Column:
    """What counts as the same text by one author."""
    return F.lower(F.trim(text))


def skeleton(text: Column) -> Column:
    """Lower-case text with links, handles, hashtags and numbers masked and white space squeezed."""
    out = F.lower(text)
    for pattern, mask in ((LINK, "<url>"), (HANDLE, "<user>"), (r"#\w+", "<tag>"), (r"\d+", "<num>"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, mask)
    return F.trim(out)


def handle_skeleton(handle: Column) -> Column:
    return F.regexp_replace(F.lower(handle), r"[0-9]+", "#")


def digit_share(handle: Column) -> Column:
    return F.length(F.regexp_replace(handle, "[^0-9]", "")) * F.lit(1.0) / F.greatest(F.length(handle), F.lit(1))


def content_words(text: Column) -> Column:
    """Number of words of two letters or more, links and handles apart; a hashtag's word counts."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LINK, " "), HANDLE, " ")
    return F.size(F.regexp_extract_all(F.translate(bare, "#", " "), F.lit(r"\p{L}{2,}"), F.lit(0)))


def salient_terms(text: Column, stop: Sequence[str]) -> Column:
    """Distinct lower-case words of three letters or more that are no stop words."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), LINK, " ")
    words = F.regexp_extract_all(bare, F.lit(r"[a-z]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, stop)))) if stop else F.array_sort(F.array_distinct(words))


def entity_terms(text: Column, stop: Sequence[str]) -> Column:
    """Distinct capitalised words, in lower case, that are no stop words."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Z][A-Za-z]{2,}"), F.lit(0)), F.lower)
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, stop)))) if stop else F.array_sort(F.array_distinct(words))


def mining_terms(text: Column) -> Column:
    """Lower-case words for term mining: letters, inner hyphens and apostrophes; no links, handles, hashtags."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+", " "), r"[@#][\w_]+", " ")
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}][\p{L}'-]{2,}"), F.lit(0))


def topic_tokens(text: Column) -> Column:
    """Tokens of class-based TF-IDF: ASCII words of three letters or more of a cleaned text."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+|@\w+|#\w+|[^\w\s]", " ")
    return F.regexp_extract_all(bare, F.lit(r"[a-z]{3,}"), F.lit(0))


def first_match(value: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The label of the first rule with a token that value contains, ignoring case; else null."""
    low, out = F.lower(value), None
    for tokens, label in rules:
        hit = low.contains(tokens[0])
        for t in tokens[1:]:
            hit = hit | low.contains(t)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def scan(text: Column, patterns: Sequence[tuple[str, str, str]]) -> Column:
    """Names of the patterns (name, case-insensitive regex, literal) that text has, in the patterns' order.

    literal, in lower case, is a part of every match: a text without it is not searched for the pattern.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(part) & F.coalesce(text, F.lit("")).rlike(f"(?iU){p}"), F.lit(n)) for n, p, part in patterns]))


def stable_id(members: Column) -> Column:
    """16 hexadecimal digits of the SHA-1 of sorted member ids, one to a line."""
    return F.substring(F.sha1(F.array_join(F.array_sort(members), "\n")), 1, 16)


def unwrap(raw: Column) -> Column:
    """The text of a value that was written as a list of strings; another value without its brackets and quotes."""
    bare = F.regexp_replace(F.trim(raw), r"^\[|\]$", "")
    joined = F.regexp_replace(bare, r"""(['"])\s*,\s*(['"])""", " ")
    return F.regexp_replace(F.trim(joined), r"""^['"]|['"]$""", "")


def clean(raw: Column) -> Column:
    """Unwrapped text with handles as @user and white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unwrap(raw), HANDLE, "@user"), r"\s+", " "))


def norm_key(text: Column) -> Column:
    """What counts as the same text in two corpora."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
