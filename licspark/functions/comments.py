"""The comment of a file that most likely holds its license."""

from pyspark.sql import Column, functions as F

from licspark import fixed_values as fv
from licspark.functions.segments import language_marks, raw_comments
from licspark.functions.text import let, positions, runs, stripped_lines


def keyword_count(text: Column, faithful: bool = False) -> Column:
    """How many license keywords occur in the text.

    ``faithful=True`` counts the glued keyword pair as one word.
    """
    low = F.lower(text)
    words = [w for w in fv.COMMENT_KEYWORDS if not (faithful and w in fv.GLUED_KEYWORDS)]
    if faithful:
        words.append("".join(fv.GLUED_KEYWORDS))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def comments_by_kind(content: Column, file_type: Column) -> Column:
    """Comments in the order block, continued line comments, single line comments.

    Line comments on neighbouring lines form one continued comment, joined by blanks.
    """

    def split_kinds(comments):
        is_block = lambda c: c["end_line"] > c["start_line"]
        blocks = F.filter(comments, is_block)
        lines = F.filter(comments, lambda c: ~is_block(c))

        def grouped(lines):
            starts = positions(
                lines,
                lambda c, i: (i == 0) | (c["start_line"] - F.get(lines, i - 1)["end_line"] > 1),
            )
            joined = runs(
                lines,
                starts,
                lambda run: F.struct(F.size(run).alias("n"), F.array_join(run["body"], " ").alias("body")),
            )
            return let(
                joined,
                lambda g: F.concat(
                    F.filter(g, lambda x: x["n"] > 1)["body"], F.filter(g, lambda x: x["n"] == 1)["body"]
                ),
            )

        return F.concat(blocks["body"], let(lines, grouped))

    return let(raw_comments(stripped_lines(content), language_marks(file_type)), split_kinds)


def record_high_comments(comments: Column, faithful: bool = False) -> Column:
    """Comments whose keyword count beats every earlier one, joined by blanks.

    At most one comment per possible count is kept, so the fold stays linear.
    """
    start = F.struct(F.lit(0).alias("best"), F.lit("").alias("text"))

    def step(acc, comment):
        return let(
            keyword_count(comment, faithful),
            lambda n: F.when(
                n > acc["best"],
                F.struct(n.alias("best"), F.concat(acc["text"], F.lit(" "), comment).alias("text")),
            ).otherwise(acc),
        )

    return F.aggregate(comments, start, step, lambda acc: acc["text"])


def license_comment(comments: Column, faithful: bool = False) -> Column:
    """First comment with an SPDX identifier, else the record-high comments."""

    def choose(comments):
        spdx = F.filter(comments, lambda c: F.contains(F.lower(c), F.lit(fv.SPDX_MARK)))
        return F.coalesce(F.get(spdx, F.lit(0)), record_high_comments(comments, faithful))

    return let(comments, choose)


def license_comment_literals(content: Column, file_type: Column, faithful: bool = False) -> Column:
    """Literals of the block-comment variant: the chosen comment, or all lines of other files."""
    chosen = license_comment(comments_by_kind(content, file_type), faithful)
    return F.when(
        file_type.isin(list(fv.LANGUAGE_MARKS)), F.filter(F.array(chosen), lambda c: c != "")
    ).otherwise(F.split(content, "\n"))
