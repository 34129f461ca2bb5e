"""TF-IDF vectors and linear scores of single rows.

Counting terms is a JVM transformer over a broadcast vocabulary, or for a single problem
a step in Arrow batches; the arithmetic on the sparse counts is numpy in Arrow batches. Nothing is shuffled. Model
arrays are bounded by (classes x ``max_features``) and travel as broadcasts.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from licspark.functions.ngrams import word_ngrams
from licspark.operators.term_counts import Vocabulary, without_nulls

#: Rows of one sparse product.
ROWS = 512


def add_counts(df: DataFrame, vocabulary: list[str], words: str, output: str) -> DataFrame:
    """Counts of the known 1- to 3-grams of a word array, as a sparse vector."""
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol=output)
    return counter.transform(df.withColumn("_terms", word_ngrams(F.col(words)))).drop("_terms")


def _weights(counts: SparseVector, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts.values)) * idf[counts.indices]
    return values / (np.sqrt(values @ values) or 1.0)


def tfidf_vector(df: DataFrame, counts: str, idf: np.ndarray) -> Column:
    """``(1 + ln tf) * idf``, scaled to length 1."""
    shared = df.sparkSession.sparkContext.broadcast(idf)
    weigh = F.udf(
        lambda v: SparseVector(v.size, v.indices, _weights(v, shared.value)), VectorUDT(), useArrow=True
    )
    return weigh(counts)


def flat(indices: list, values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the rows, term numbers and counts of many sparse rows on end."""
    bounds = np.concatenate(([0], np.cumsum([len(v) for v in indices]))).astype(np.int64)
    return bounds, np.concatenate([np.zeros(0, np.int64), *indices]).astype(np.int64), np.concatenate([np.zeros(0), *values])


def margins(bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Margins (rows, classes) of many rows of counts (see `flat`) by one sparse product."""
    weights = (1.0 + np.log(counts)) * idf[terms]

    def sums(values):
        total = np.zeros((len(values) + 1, *values.shape[1:]))
        np.cumsum(values, axis=0, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]

    lengths = np.sqrt(sums(weights**2))
    product = sums(coefficients.T[terms] * weights[:, None])
    return product / np.where(lengths > 0, lengths, 1.0)[:, None] + intercepts


def decided(margins: np.ndarray, links: np.ndarray | None) -> list[list[int]]:
    """Positions of the predicted classes per row of margins, all rows of a class at once."""
    if links is None:
        return [[int(k)] for k in margins.argmax(axis=1)]
    flags = np.zeros(margins.shape)
    for k in range(margins.shape[1]):
        flags[:, k] = margins[:, k] + flags @ links[k] > 0
    return [np.flatnonzero(row).tolist() for row in flags]


def word_classes(df: DataFrame, words: str, terms: list[str], idf, coefficients, links, intercepts) -> Column:
    """Positions of the predicted classes of word arrays.

    Without ``links`` the class with the highest margin wins. With them, class
    k is predicted when its margin, with the flags of the classes before it
    added through ``links[k]``, is positive.
    """
    shared = df.sparkSession.sparkContext.broadcast((terms, idf, coefficients, links, intercepts))

    @F.arrow_udf("array<int>")
    def classify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, idf, coefficients, links, intercepts = shared.value
        vocabulary = Vocabulary(terms)
        for column in columns:
            classes = []
            for _, n_rows, rows, places, counts in vocabulary.count(column):
                bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows))))
                for first in range(0, n_rows, ROWS):
                    own = bounds[first : first + ROWS + 1]
                    part = slice(own[0], own[-1])
                    classes += decided(margins(own - own[0], places[part], counts[part], idf, coefficients, intercepts), links)
            yield pa.array(classes, pa.list_(pa.int32()))

    return classify(without_nulls(words))


class Block:
    """The columns of one problem in a product over the dictionary of many: its terms are `places` in that dictionary."""

    def __init__(self, places, idf, coefficients, links, intercepts):
        self.parts = (places, idf, coefficients, links, intercepts)

    def decide(self, rows: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> dict[int, list[int]]:
        """Positions of the predicted classes of the given rows, which alone are multiplied."""
        places, idf, coefficients, links, intercepts = self.parts
        sizes = bounds[rows + 1] - bounds[rows]
        ends = np.cumsum(sizes)
        taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[rows] - (ends - sizes), sizes)
        at = np.minimum(np.searchsorted(places, terms[taken]), max(0, len(places) - 1))
        known = places[at] == terms[taken] if len(places) else np.zeros(len(taken), bool)
        inside = np.concatenate(([0], np.cumsum(known)))[np.concatenate(([0], ends))]
        found = margins(inside, at[known], counts[taken][known], idf, coefficients, intercepts)
        return dict(zip(rows.tolist(), decided(found, links)))


def routed_classes(df: DataFrame, counts: str, blocks: list[tuple], follow: dict[tuple[int, int], list[int]]) -> Column:
    """Positions of the predicted classes per block, in one Python step: an array with an entry per block, null where it was not asked.

    ``blocks`` hold the arguments of `Block`. The first block is asked for every row with a
    count vector, the others for rows that are led there: ``follow[b, c]`` are the blocks asked when class
    c of block b is predicted. A block leads to later blocks only.
    """
    shared = df.sparkSession.sparkContext.broadcast((blocks, follow))

    @F.pandas_udf("array<array<int>>")
    def classify(batch: pd.DataFrame) -> pd.Series:
        arguments, follow = shared.value
        asked = [Block(*a) for a in arguments]
        out = []
        for first in range(0, len(batch), ROWS):
            part = batch.iloc[first : first + ROWS]
            rows = flat(part["indices"].tolist(), part["values"].tolist())
            found = [[None] * len(asked) for _ in range(len(part))]
            wanted = [set() for _ in asked]
            wanted[0].update(range(len(part)))
            for b, block in enumerate(asked):
                if not wanted[b]:
                    continue
                for row, classes in block.decide(np.array(sorted(wanted[b]), np.int64), *rows).items():
                    found[row][b] = classes
                    for c in classes:
                        for more in follow.get((b, c), ()):
                            wanted[more].add(row)
            out += found
        return pd.Series(out)

    return classify(counts)
