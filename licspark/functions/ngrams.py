"""Word n-grams and in-row term counts."""

from pyspark.sql import Column, functions as F

from licspark.functions.text import let, positions


def _extend(grams: Column, words: Column, n: int) -> Column:
    """(n)-grams from (n-1)-grams: join each with the word that follows it."""
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(grams, F.lit(1), size),
        F.slice(words, F.lit(n), size),
        lambda gram, word: F.concat(gram, F.lit(" "), word),
    )


def word_ngrams(words: Column, n_max: int = 3) -> Column:
    """All 1- to n-grams of an array of words; arrays shorter than n give none of size n."""

    def build(words):
        levels = [words]
        for n in range(2, n_max + 1):
            levels.append(_extend(levels[-1], words, n))
        return F.concat(*levels)

    return let(words, build)


def term_counts(terms: Column) -> Column:
    """Distinct terms of an array with their number of occurrences.

    Sorting and cutting the array inside the row replaces a shuffle on
    (document, term).
    """

    def count(ordered):
        starts = positions(ordered, lambda t, i: (i == 0) | (t != F.get(ordered, i - 1)))
        bound = F.struct(ordered.alias("terms"), starts.alias("starts"), F.size(ordered).alias("n"))

        def count_from(b):
            end = lambda k: F.coalesce(F.get(b["starts"], k + 1), b["n"])
            return F.transform(
                b["starts"],
                lambda start, k: F.struct(
                    F.get(b["terms"], start).alias("term"), (end(k) - start).cast("long").alias("tf")
                ),
            )

        return let(bound, count_from)

    return let(F.sort_array(terms), count)
