"""Suffix stripping after M. F. Porter (1980), for arrays of tokens and for tables of words.

Written from the published rules. For arrays, each Arrow batch is reduced to its distinct
tokens first, so a word is stemmed once per batch however often it occurs. For a table
with a word per row the same rules are SQL expressions (`stem_layers`), so no Python runs:
the shape of a word has V for each vowel and c for each other sign, and the measure of a
stem is the number of times that "Vc" stands in the beginning of the shape.
"""

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_VOWEL = "(?:[aeiou]|(?<=[^aeiou])y)"
_MEASURE = re.compile(f"{_VOWEL}+(?:(?!{_VOWEL}).)+")
_HAS_VOWEL = re.compile(_VOWEL)
_DOUBLE = re.compile(r"([^aeiouy])\1$")
_CVC = re.compile(f"(?!{_VOWEL}).{_VOWEL}(?!{_VOWEL})[^wxy]$")

# FIXED VALUES: suffix tables of the published algorithm.
_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al",
    entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al",
    iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = dict.fromkeys(
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), ""
)


def _measure(stem):
    return len(_MEASURE.findall(stem))


def _replace(word, table, least):
    """Apply the longest suffix of the table when the stem's measure is over ``least``."""
    for size in range(7, 1, -1):
        suffix = word[-size:]
        if len(word) > size and suffix in table:
            stem = word[:-size]
            allowed = _measure(stem) > least and (suffix != "ion" or stem[-1] in "st")
            return stem + table[suffix] if allowed else word
    return word


def _plural(word):
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word):
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and _HAS_VOWEL.search(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _DOUBLE.search(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _CVC.search(stem) else stem
    return word


def _final_e(word):
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _CVC.search(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _HAS_VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(_replace(word, _STEP2, 0), _STEP3, 0), _STEP4, 1)
    return _final_e(word)


def stem_tokens(tokens):
    """Array column of tokens to array column of stems, order and repeats kept."""

    @F.pandas_udf("array<string>")
    def stems(batch: pd.Series) -> pd.Series:
        known = {t: stem(t) for t in set().union(*(set(row) for row in batch if row is not None))}
        return batch.map(lambda row: None if row is None else [known[t] for t in row])

    return stems(tokens)


def _left(n: int, of: str = "w") -> str:
    return f"substr({of}, 1, length(w) - {n})"


def _sql_measure(n: int, least: int) -> str:
    """Whether the word without its last n signs has a measure over ``least`` (0 or 1)."""
    return f"{_left(n, 'shape')} LIKE '{'%Vc' * (least + 1)}%'"


def _sql_cvc(word: str, shape: str) -> str:
    return f"{shape} LIKE '%cVc' AND right({word}, 1) NOT IN ('w', 'x', 'y')"


def _sql_replace(table: dict[str, str], least: int) -> str:
    """The longest suffix of the table is replaced if the measure of the stem is over ``least``."""
    cases = []
    for suffix in sorted(table, key=len, reverse=True):
        n = len(suffix)
        allowed = _sql_measure(n, least)
        if suffix == "ion":
            allowed += f" AND right({_left(n)}, 1) IN ('s', 't')"
        cases.append(f"WHEN length(w) > {n} AND w LIKE '%{suffix}' THEN CASE WHEN {allowed} THEN concat({_left(n)}, '{table[suffix]}') ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stem_layers(word: str, everywhere: str = "") -> list[dict[str, str]]:
    """SQL expressions that stem a column of words, as layers of named columns; each layer reads the columns of the one before.

    The last layer has ``word`` and ``stem``. ``everywhere`` is the last argument of
    regexp_replace in a dialect that does not replace all matches by itself.
    """
    marked = "w"
    for vowel in "aeiou":  # a y after one of these is no vowel, nor is the first sign
        marked = f"replace({marked}, '{vowel}y', '{vowel}#')"
    marked = f"CASE WHEN w LIKE 'y%' THEN concat('#', substr({marked}, 2)) ELSE {marked} END"
    shape = f"regexp_replace(translate({marked}, 'aeiouy', 'VVVVVV'), '[^V]', 'c'{everywhere})"
    keep = {word: word}
    layers = [keep | {"w": word}]

    def then(expression: str, **more: str) -> None:
        layers.append(keep | {"w": expression} | more)

    def shaped() -> None:
        layers.append(keep | {"w": "w", "shape": shape})

    then(f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_left(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {_left(1)} ELSE w END")
    shaped()
    cut = " ".join(f"WHEN w LIKE '%{end}' AND {_left(len(end), 'shape')} LIKE '%V%' THEN {len(end)}" for end in ("ed", "ing"))
    layers.append(keep | {"w": "w", "shape": "shape", "cut": f"CASE WHEN w LIKE '%eed' THEN 0 {cut} ELSE 0 END"})
    layers.append(keep | {"w": "w", "shape": "shape", "cut": "cut", "trunk": "substr(w, 1, length(w) - cut)", "trunk_shape": "substr(shape, 1, length(w) - cut)"})
    double = "right(trunk, 1) = substr(trunk, length(trunk) - 1, 1) AND length(trunk) > 1 AND right(trunk, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z')"
    then(
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_sql_measure(3, 0)} THEN {_left(1)} ELSE w END WHEN cut = 0 THEN w "
        "WHEN trunk LIKE '%at' OR trunk LIKE '%bl' OR trunk LIKE '%iz' THEN concat(trunk, 'e') "
        f"WHEN {double} THEN substr(trunk, 1, length(trunk) - 1) "
        f"WHEN trunk_shape LIKE '%Vc%' AND trunk_shape NOT LIKE '%Vc%Vc%' AND {_sql_cvc('trunk', 'trunk_shape')} THEN concat(trunk, 'e') ELSE trunk END"
    )
    shaped()
    then(f"CASE WHEN w LIKE '%y' AND {_left(1, 'shape')} LIKE '%V%' THEN concat({_left(1)}, 'i') ELSE w END")
    for table, least in ((_STEP2, 0), (_STEP3, 0), (_STEP4, 1)):
        shaped()
        then(_sql_replace(table, least))
    shaped()
    one = f"({_sql_measure(1, 0)} AND NOT ({_sql_cvc(_left(1), _left(1, 'shape'))}))"
    then(f"CASE WHEN w LIKE '%e' AND ({_sql_measure(1, 1)} OR {one}) THEN {_left(1)} ELSE w END")
    shaped()
    then(f"CASE WHEN w LIKE '%ll' AND {_sql_measure(1, 1)} THEN {_left(1)} ELSE w END")
    layers.append(keep | {"stem": f"CASE WHEN length({word}) <= 2 THEN {word} ELSE w END"})
    return layers


def add_stem(df: DataFrame, word: str) -> DataFrame:
    """A table with a word per row and its ``stem``; the columns other than ``word`` travel along as one struct."""
    rest = [c for c in df.columns if c != word]
    carried = df.select(F.col(word).alias("_word"), F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))
    for layer in stem_layers("_word"):
        carried = carried.selectExpr(*[f"{expression} AS {name}" for name, expression in layer.items()], "_rest")
    return carried.select(F.col("_word").alias(word), *[F.col("_rest")[c].alias(c) for c in rest], "stem")
