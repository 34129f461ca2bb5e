"""Token profiles: text column in, token array column out."""

from pyspark.sql import Column, functions as F

from licspark import fixed_values as fv
from licspark.functions.porter import stem_tokens
from licspark.functions.text import strip

# Runs of letters and digits.
WORD_RUN = r"[\p{L}\p{Nd}]+"
# Words with inner marks kept ("GPL-2.0", "don't"), and every other sign alone.
WORD_OR_SIGN = r"[\p{L}\p{Nd}][\p{L}\p{Nd}._'/+\-]*[\p{L}\p{Nd}]|[\p{L}\p{Nd}]|[^\s]"

# FIXED VALUES: usual English stop words that are not protected.
STOP_WORDS = tuple(
    "myself ourselves yourselves hers herself theirs off don ll m ve ain aren couldn didn doesn "
    "hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn".split()
)


def empty_tokens() -> Column:
    return F.array().cast("array<string>")


def words_and_signs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_OR_SIGN), F.lit(0))


def keep_words(tokens: Column) -> Column:
    """Tokens that are all letters or all digits."""
    return F.filter(tokens, lambda t: t.rlike(r"^(\p{L}+|\p{Nd}+)$"))


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def delete_characters(tokens: Column, pattern: str = "[^0-9a-zA-Z.]") -> Column:
    return F.transform(tokens, lambda t: F.regexp_replace(t, pattern, ""))


def drop_blank(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: strip(t) != "")


def drop_stop_words(tokens: Column, stop_words=STOP_WORDS, protected=fv.PROTECTED_WORDS) -> Column:
    """Remove stop words except the protected ones; repeats of other words stay."""
    removed = sorted(set(stop_words) - set(protected))
    return F.filter(tokens, lambda t: ~t.isin(removed)) if removed else tokens


def word_tokens(text: Column) -> Column:
    """Lower-cased words of the lemma profile, before lemmas are looked up; texts of any length."""
    runs = F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))
    return F.when(text.isNull(), empty_tokens()).otherwise(lower_tokens(keep_words(runs)))


def unstemmed_tokens(text: Column) -> Column:
    """Stem profile up to the stop words."""
    tokens = drop_blank(delete_characters(lower_tokens(words_and_signs(text))))
    return F.when(text.isNull(), empty_tokens()).otherwise(drop_stop_words(tokens))


def stemmed_tokens(text: Column) -> Column:
    return stem_tokens(unstemmed_tokens(text))


# Token profiles by name; add a callable Column -> Column to extend.
TOKEN_PROFILES = {"lemma": word_tokens, "stem": stemmed_tokens}


def raw_profile(name: str):
    """The profile without stemming, which depends on single tokens only and can be done per distinct token."""
    return unstemmed_tokens if name == "stem" else TOKEN_PROFILES[name]
