"""Column functions on text, arrays and maps. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split and str.strip take as white space. Java's
# \s is ASCII only, and its Unicode form is slower and lacks the separators 0x1c-0x1f.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
TERM_PATTERN = r"([\p{L}\p{N}_]+)"
BETWEEN_TERMS = r"[^\p{L}\p{N}_]+"
BETWEEN_TERMS_IN_WORDS = r"[^\p{L}\p{N}_" + WHITESPACE[1:]

# The English stop words a BM25 index leaves out by default.
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(text: Column | str) -> Column:
    """Words between runs of white space, case kept, no empty ones."""
    return F.array_remove(F.split(col(text), WHITESPACE), "")


def tokenize_ws(text: Column | str) -> Column:
    """Lower-cased words between runs of white space."""
    return split_words(F.lower(col(text)))


def tokenize_terms(text: Column | str, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lower-cased runs of letters, digits and underscores, without stop words."""
    terms = F.regexp_extract_all(F.lower(col(text)), F.lit(TERM_PATTERN), F.lit(1))
    words = sorted(set(stop_words))
    return F.filter(terms, lambda t: ~t.isin(words)) if words else terms


def strip_text(text: Column | str) -> Column:
    """Remove leading and trailing white space of every kind (trim drops blanks only)."""
    return F.regexp_replace(col(text), f"^{WHITESPACE}|{WHITESPACE}$", "")


def token_set(text: Column | str) -> Column:
    """The sorted distinct lower-cased words of a text."""
    return F.sort_array(F.array_distinct(tokenize_ws(text)))


def safe_ratio(num: Column | str, den: Column | str, empty: float = 0.0) -> Column:
    """num / den, or ``empty`` where the denominator is 0."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d == 0, F.lit(float(empty))).otherwise(n / F.nullif(d, F.lit(0.0)))


def average(total: Column | str, count: Column | str) -> Column:
    """total / max(count, 1)."""
    return col(total).cast("double") / F.greatest(col(count), F.lit(1))


def jaccard_of_sets(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two arrays of distinct values; 0 if both are empty."""
    a, b = col(a), col(b)
    common = F.size(F.array_intersect(a, b))
    return safe_ratio(common, F.size(a) + F.size(b) - common)


def jaccard_similarity(text1: Column | str, text2: Column | str) -> Column:
    """Jaccard similarity of the lower-cased word sets of two texts; 0 if both are empty."""
    return jaccard_of_sets(
        F.array_distinct(tokenize_ws(text1)), F.array_distinct(tokenize_ws(text2))
    )


def exceeds_jaccard(common: Column, size_a: Column, size_b: Column, threshold: float) -> Column:
    """Is the similarity strictly above the threshold? Whole-number arithmetic, so a
    pair that meets the threshold exactly never passes by a rounding error."""
    t = Fraction(str(threshold))
    union = size_a + size_b - common
    return common * F.lit(t.denominator) > union * F.lit(t.numerator)


def preview(text: Column | str, length: int = 500) -> Column:
    """The first characters, with an ellipsis only where the text goes on."""
    text = col(text)
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def log_preview(text: Column | str, length: int = 100) -> Column:
    """The first characters, always followed by an ellipsis."""
    return F.concat(F.substring(col(text), 1, length), F.lit("..."))


def map_get(m: Column | str, key: str, default: Column | str | None = None) -> Column:
    """Value of a key; the default only where the key is missing, not where it holds null."""
    m = col(m)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.map_contains_key(m, key), F.try_element_at(m, F.lit(key))).otherwise(fallback)


def text_field(doc: Column | str) -> Column:
    """Text of a document map: key ``text``, else ``content``, else the whole record."""
    doc = col(doc)
    return map_get(doc, "text", map_get(doc, "content", F.to_json(doc)))


def format_ts(ts: Column | str) -> Column:
    return F.date_format(col(ts), TIMESTAMP_FORMAT)


def head_of_array(arr: Column | str, n: int) -> Column:
    """First n elements or fewer."""
    return F.slice(col(arr), 1, n)


def whole_number(text: Column | str) -> Column:
    """A whole number with optional sign and surrounding blanks, else null."""
    stripped = strip_text(text)
    return F.when(stripped.rlike(r"^[+-]?[0-9]+$"), stripped.try_cast("int"))
