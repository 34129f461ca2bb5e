"""Line and white-space handling, and a binding helper for column expressions."""

import sys

from pyspark.sql import Column, functions as F

# Every character Python calls white space, as one trim set.
WHITESPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())

# All line ends of Unicode text, not only the newline.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside higher-order functions the optimizer may otherwise inline an
    expensive expression at a place that runs once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (linear, unlike a regex)."""
    return F.btrim(text, F.lit(WHITESPACE))


def stripped_lines(content: Column) -> Column:
    """Stripped lines of a text, blank ones kept so that positions are line numbers."""
    return F.transform(F.split(content, LINE_END), strip)


def numbered_lines(content: Column) -> Column:
    """Non-blank stripped lines with their 1-based line number."""
    return F.filter(
        F.transform(
            stripped_lines(content),
            lambda line, i: F.struct((i + 1).alias("line"), line.alias("text")),
        ),
        lambda row: row["text"] != "",
    )


def positions(items: Column, is_wanted) -> Column:
    """0-based positions of the array elements that satisfy ``is_wanted``."""
    return F.filter(
        F.transform(items, lambda x, i: F.when(is_wanted(x, i), i)), lambda i: i.isNotNull()
    )


def runs(items: Column, starts: Column, fold) -> Column:
    """Cut an array at the given start positions and fold every run with ``fold``.

    ``starts`` must begin with 0 when ``items`` is not empty. Each element is
    copied once, so the cost is linear in the array.
    """

    def over(bound):
        run = lambda start, k: F.slice(
            bound["items"],
            start + 1,
            F.coalesce(F.get(bound["starts"], k + 1), F.size(bound["items"])) - start,
        )
        return F.transform(bound["starts"], lambda start, k: let(run(start, k), fold))

    return let(F.struct(items.alias("items"), starts.alias("starts")), over)


def join_lines(bodies: Column) -> Column:
    return F.array_join(bodies, "\n")
