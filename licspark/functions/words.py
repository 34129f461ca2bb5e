"""License-related words of a file."""

from pyspark.sql import Column, functions as F

from licspark import fixed_values as fv
from licspark.functions.text import let
from licspark.functions.tokens import empty_tokens


def related_text(literals: Column, pattern: str = fv.LRW_PATTERN) -> Column:
    """Literals that speak about licenses, each followed by a newline."""
    return F.array_join(
        F.transform(F.filter(literals, lambda x: x.rlike(pattern)), lambda x: F.concat(x, F.lit("\n"))), ""
    )


def unrelated_text(literals: Column, pattern: str = fv.LRW_PATTERN) -> Column:
    """The complement of ``related_text``."""
    return F.array_join(
        F.transform(F.filter(literals, lambda x: ~x.rlike(pattern)), lambda x: F.concat(x, F.lit("\n"))), ""
    )


def _words_of(content: Column, literals: Column, text: Column, tokenize) -> Column:
    return F.when(F.coalesce(content, F.lit("")) == "", empty_tokens()).when(
        F.size(literals) > 0, tokenize(text)
    )


def license_words(content: Column, literals: Column, tokenize) -> Column:
    """Tokens of the related literals: [] for an empty text, null without literals."""
    return _words_of(content, literals, related_text(literals), tokenize)


def no_license_words(content: Column, literals: Column, tokenize) -> Column:
    return _words_of(content, literals, unrelated_text(literals), tokenize)


def words_or_whole_text(content: Column, license_words: Column, tokenize) -> Column:
    """License words, or the tokens of the whole text when there are none."""
    return let(
        license_words,
        lambda words: F.when(F.size(words) > 0, words)
        .when(F.coalesce(content, F.lit("")) == "", empty_tokens())
        .otherwise(tokenize(content)),
    )
