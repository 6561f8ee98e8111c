"""Text expressions. All of them are built-in columns, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def truncate(text: Column, n: int) -> Column:
    """The first ``n`` characters and dots, if there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def bigrams(text: Column) -> Column:
    """The different pairs of neighbouring characters of the normalised text; a shorter text is its own."""
    t = normalize(text)
    return F.when(F.length(t) < 2, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))))


def content_hash(text: Column) -> Column:
    """SHA-256 in hexadecimal digits."""
    return F.sha2(text.cast("binary"), 256)


def pair_key(a: Column, b: Column) -> Column:
    """A key of a pair, the same for either order, so that a decision is found whichever comes first."""
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)).cast("binary"), 256)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def quote_window(text: Column, name: Column, radius: int = 60, fallback: int = 120) -> Column:
    """What stands around the first place of a name, case ignored; the text's beginning if it is nowhere.

    A cut side gets dots, and only the line around the name stays.
    """
    at = F.position(F.lower(name), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    end = at + F.length(name) + radius
    piece = F.substr(text, start, end - start)
    before = F.substring_index(F.substr(piece, F.lit(1), at - start), "\n", -1)
    after = F.substring_index(F.substr(piece, at - start + 1), "\n", 1)
    cut_left = (start > 1) & ~F.contains(F.substr(piece, F.lit(1), at - start), F.lit("\n"))
    cut_right = (end <= F.length(text)) & ~F.contains(F.substr(piece, at - start + 1), F.lit("\n"))
    found = F.concat(F.when(cut_left, "...").otherwise(""), F.trim(F.concat(before, after)), F.when(cut_right, "...").otherwise(""))
    first = F.concat(F.trim(F.left(text, F.lit(fallback))), F.when(F.length(text) > fallback, "...").otherwise(""))
    return F.when((at > 0) & (F.length(name) > 0), found).otherwise(first)


def images(text: Column) -> Column:
    """Targets of Markdown images."""
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def clean_heading(text: Column) -> Column:
    """A heading without emphasis and code marks."""
    return F.trim(F.translate(text, "*`", ""))


def merged_source(a: Column, b: Column) -> Column:
    """Two source types joined by a plus sign, either left out if missing."""
    return F.concat_ws("+", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def preprocessed(text: Column, most: int) -> Column:
    """Control characters dropped, white space collapsed, at most so many characters."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cntrl}&&[^\s]]", ""), r"\s+", " "))
    return F.left(spaced, F.lit(most))


def capped_description(text: Column, most: int = 500) -> Column:
    """At most so many characters, ending with a sentence if one ends there."""
    head = F.left(text, F.lit(most))
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.when(sentence != "", sentence).otherwise(head))


def searchable(text: Column) -> Column:
    """A free text as search terms: letters and digits only, without terms that are numbers alone."""
    return F.array_join(F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda t: (t != "") & ~t.rlike(r"^\p{N}+$")), " ")


def escaped_like(text: Column) -> Column:
    """A text whose LIKE wildcards mean themselves."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def human_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that they reach."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.format_number(n / 1024**power, 1), F.lit(" " + unit))).otherwise(out)
    return out


def dot_escaped(text: Column) -> Column:
    """A text for a quoted DOT label."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
