"""Cell and text normalisation, similarity and type patterns as column expressions: everything joins on these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default English stop words of the analyser whose token form the corpus uses.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
#: Patterns of the semantic types, tried in this order on the whole cell; those of the corpus, as they are.
TYPES = {
    "NUMBER": r"^(\s|&nbsp;)*-?(\s|&nbsp;)*([0-9]+(\.[0-9]+)?|[0]*\.[0-9]+)((\s|&nbsp;)?%)?(\s|&nbsp;)*$",
    "DATE": r"^(\s|&nbsp;)*[0-3]?[0-9](-|/|.)[0-3]?[0-9](-|/|.)([0-9]{2})?[0-9]{2}(\s|&nbsp;)*$",
    "CURRENCY": r"^(\s|&nbsp;)*(\$|€|EUR|USD|CAD|C\$)( )?\d+ | \d+( )?(\$|€|EUR|USD|CAD|C\$)(\s|&nbsp;)*$",
}
TOKEN = r"[\p{L}\p{N}_]+"
MAX_TERM = 100


def normalize_cell(c: Column) -> Column:
    """NULL for empty, ?, null, - and any mix of &nbsp;, ?, - and blanks; else one blank for each run of white space."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(c, "&nbsp;", " "), r"\s+", " "))
    return F.when(c.rlike(r"^(&nbsp;|\?|\s|-)*$") | (F.lower(F.trim(c)) == "null"), None).otherwise(clean)


def stem(c: Column, stop_words: bool = True) -> Column:
    """The token form: lower-case word tokens joined by a blank, without stop words."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS)) if stop_words else tokens, " ")


def indexable(c: Column) -> Column:
    """A term as the corpus keeps it: NULL beyond MAX_TERM characters."""
    return F.when(F.length(c) <= MAX_TERM, c)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two nulls or two empty strings are equal, one null is 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def array_similarity(a: Column, b: Column) -> Column:
    """Mean similarity of the components."""
    each = F.zip_with(a, b, similarity)
    return F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.size(each))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, but for case; two nulls are equal, one null is 0, two empty strings have none."""
    d = F.levenshtein(F.lower(a), F.lower(b)) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(1 - d)


def similar_components(a: Column, b: Column, edits: int = 3) -> Column:
    """Whether two arrays of equal size are similar in every component."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) | F.coalesce(F.levenshtein(x, y) <= edits, F.lit(False))), lambda z: z)


def polish(c: Column) -> Column:
    """Letters, digits, blanks and | only."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9 |]", " "), " +", " "))


def split_camel_case(c: Column) -> Column:
    """A blank where a capital begins a word, and before figures and marks after letters."""
    return F.regexp_replace(c, r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^A-Z ])(?=[A-Z])|(?<=[A-Za-z])(?=[^A-Za-z\- ])", " ")


def is_vowel(c: Column) -> Column:
    return F.lower(c).isin(*"aeiou")


def is_empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def index_of_max(c: Column) -> Column:
    """The place, from 0, of the first greatest element of an array."""
    return F.array_position(c, F.array_max(c)) - 1


def all_null(c: Column) -> Column:
    """Whether an array has no value at all."""
    return F.forall(c, lambda x: x.isNull())


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def infer_type(c: Column) -> Column:
    """Aggregate: the first type all non-null values have, STRING if none, NULL if there is no value."""
    any_value = F.count(c) > 0
    out = F.when(~any_value, None)
    for name, pattern in TYPES.items():
        out = out.when(F.bool_and(F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(True))), name)
    return out.otherwise("STRING")
