"""Statistics of whole texts, for many texts at once."""

import numpy as np

from licspark.llm import textops

SYMBOLS = b"#*$%&|<>"
#: Character classes; a code point counts by its lead byte.
CLASSES = ("lower", "upper", "digit", "blank", "line end", "full stop", "comma", "other mark", "symbol", "control", "Latin letter", "Latin capital", "other letter or sign")
_CLASS = np.full(256, 12, np.int64)
_CLASS[:32] = 9
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[33:127] = 7
_CLASS[127] = 9
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 1, 0
_CLASS[[*b".!?"]] = 5
_CLASS[[*b",;:"]] = 6
_CLASS[[*SYMBOLS]] = 8
_CLASS[0xC3:0xCA] = 10
_LEAD = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*SYMBOLS]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = True


def counts_where(member: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are members."""
    total = np.zeros(len(member) + 1, np.int64)
    np.cumsum(member, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each class per text, (texts, classes)."""
    kinds = _CLASS[data]
    capital = np.zeros(len(data), bool)
    capital[:-1] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    kinds[capital] = 11
    lead = _LEAD[data]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(CLASSES)
    return np.bincount(text[lead] * n + kinds[lead], minlength=(len(offsets) - 1) * n).reshape(-1, n)


class Stats:
    """Word, line and character counts per text of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.bounds = textops.words(data, offsets)
        self.n_words = np.diff(self.bounds)
        self.hashes = textops.span_hashes(data, self.starts, self.ends)
        lead = _LEAD[data]
        self.n_chars = counts_where(lead, offsets)
        self.word_chars = counts_where(lead & ~textops.SPACE[data], offsets)
        self.n_symbols = counts_where(_SYMBOL[data], offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text: lines that have a word, and those of them equal to an earlier line."""
        starts, ends, bounds = textops.runs(self.data != 10, self.offsets)
        words_in = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        hashes = textops.span_hashes(self.data, starts, ends)[words_in]
        bounds = np.concatenate(([0], np.cumsum(words_in)))[bounds]
        _, distinct = textops.sorted_sets(hashes, bounds)
        return np.diff(bounds), np.diff(bounds) - np.diff(distinct)

    def repeated_words(self, n: int = 3) -> np.ndarray:
        """Words per text that lie in an n-word window found twice or more in the text."""
        grams, bounds = textops.run_hashes(self.hashes, self.bounds, n)
        sizes = np.diff(bounds)
        text = np.repeat(np.arange(len(sizes)), sizes)
        keys = textops.mixed(grams + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys) + 1, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        # place of each window's first word; windows of shorter texts are alone and never found twice
        first = np.flatnonzero(twice[:-1])
        place = first + (self.bounds[:-1] - bounds[:-1])[text[first]] if len(first) else first
        covered = np.zeros(len(self.hashes) + n, bool)
        for k in range(n):
            covered[place + k] = True
        total = np.concatenate(([0], np.cumsum(covered[: len(self.hashes)])))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text: distinct words, and the count of the most frequent one."""
        values, bounds = textops.sorted_sets(self.hashes, self.bounds)
        ordered = self.hashes.copy()
        for low, high in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            ordered[low:high].sort()
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = self.bounds[:-1][self.n_words > 0]
        new[heads] = True
        at = np.flatnonzero(new)
        lengths = np.diff(np.append(at, len(ordered)))
        most = np.zeros(len(self.n_words), np.int64)
        if len(heads):
            most[self.n_words > 0] = np.maximum.reduceat(lengths, np.searchsorted(at, heads))
        return np.diff(bounds), most

    def words_with_letters(self) -> np.ndarray:
        """Words per text that hold a letter."""
        total = np.concatenate(([0], np.cumsum(_LETTER[self.data])))
        some = total[self.ends] > total[self.starts]
        seen = np.concatenate(([0], np.cumsum(some)))
        return seen[self.bounds[1:]] - seen[self.bounds[:-1]]
