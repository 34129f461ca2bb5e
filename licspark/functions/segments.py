"""Comments and string literals of one file, as one column expression.

Block comments need state that runs across lines. Instead of exploding files
into lines and shuffling them by path, each line is reduced to one letter that
says how it changes the state; the letters of a file form a short string, and
the regular expression engine finds the blocks in it. No row leaves its task,
so the whole corpus text is read once and never shuffled, and one hot file
costs only its own length.

Letters (h = starts with the block start, f = ends with the block end,
L = long enough to hold both, a = starts with the line-comment mark):

    T  f, h, not L, not a   opens a block outside, closes it inside
    I  not f, h, not a      opens outside; stays inside
    A  f, a                 line comment outside; closes inside
    B  f, h, L              one-line block outside; closes inside
    O  f, otherwise         nothing outside; closes inside
    a  a, otherwise         line comment outside; text inside
    n  anything else
"""

from functools import reduce

from pyspark.sql import Column, functions as F

from licspark import fixed_values as fv
from licspark.functions.markup import markup_segments
from licspark.functions.text import join_lines, let, positions, runs, strip, stripped_lines
from licspark.schemas import SEGMENT


def no_segments() -> Column:
    return F.array().cast(f"array<{SEGMENT}>")


def language_marks(file_type: Column) -> Column:
    """Marks of the file's code language; null for all other types."""
    names = ("line", "start", "middle", "end")

    def marks(values):
        fields = [F.lit(v).cast("string").alias(n) for n, v in zip(names, values)]
        return F.struct(*fields, F.lit(values[4]).alias("single_quotes"))

    return reduce(
        lambda chain, item: chain.when(file_type == item[0], marks(item[1])),
        list(fv.LANGUAGE_MARKS.items())[1:],
        F.when(file_type == fv.C, marks(fv.LANGUAGE_MARKS[fv.C])),
    )


def _part(text: Column, mark: Column, number: int) -> Column:
    return strip(F.split_part(text, mark, F.lit(number)))


def line_letter(line: Column, marks: Column) -> Column:
    has_block = marks["start"].isNotNull()
    opens = F.coalesce(has_block & F.startswith(line, marks["start"]), F.lit(False))
    closes = F.coalesce(has_block & F.endswith(line, marks["end"]), F.lit(False))
    fits = F.length(line) >= F.length(marks["start"]) + F.length(marks["end"])
    is_line_comment = F.startswith(line, marks["line"])
    return (
        F.when(line == "", "n")
        .when(closes & is_line_comment, "A")
        .when(closes & opens, F.when(fits, "B").otherwise("T"))
        .when(closes, "O")
        .when(is_line_comment, "a")
        .when(opens, "I")
        .otherwise("n")
    )


def block_letters(letters: Column) -> Column:
    """Mark blocks in a string of line letters: ``<`` start, ``x`` inside, ``>`` end.

    A block that is never closed gets its ``>`` behind the last line.
    """
    marked = F.regexp_replace(letters, "[IT]([^OTAB]*)([OTAB]|$)", "<$1>")
    return F.array_join(
        F.transform(
            F.split(marked, "<"),
            lambda part, k: F.when(k == 0, part).otherwise(
                F.concat(F.repeat(F.lit("x"), F.instr(part, ">") - 1), F.substr(part, F.instr(part, ">")))
            ),
        ),
        "<",
    )


def block_line(line, k, last, marks):
    inner = F.when(F.startswith(line, marks["start"]) | (line == ""), F.lit(None)).otherwise(
        F.when(marks["middle"].isNull(), line).when(
            F.startswith(line, marks["middle"]), _part(line, marks["middle"], 2)
        )
    )
    return (
        F.when(k == 0, _part(line, marks["start"], 2))
        .when(k == last, _part(line, marks["end"], 1))
        .otherwise(inner)
    )


def one_line_comment(line: Column, state: Column, marks: Column) -> Column:
    """Body of a line comment or of a block on one line; null for other lines."""
    inner = F.split_part(F.split_part(line, marks["start"], F.lit(2)), marks["end"], F.lit(1))
    return F.when(state.isin("a", "A"), _part(line, marks["line"], 2)).when(state == "B", strip(inner))


def _comment(start, end, body):
    return F.struct(
        start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), body.alias("body")
    )


def line_states(lines: Column, marks: Column) -> Column:
    """One letter per line after block detection (see ``block_letters``)."""
    letters = F.array_join(F.transform(lines, lambda x: line_letter(x, marks)), "")
    return F.split(block_letters(letters), "")


def raw_comments(lines: Column, marks: Column) -> Column:
    """Comments in file order, before neighbours are merged."""

    def collect(bound):
        lines, marks, states = bound["lines"], bound["marks"], bound["states"]
        spans = F.filter(
            F.arrays_zip(
                positions(states, lambda c, _: c == "<").alias("first"),
                positions(states, lambda c, _: c == ">").alias("last"),
            ),
            lambda s: s["last"] < F.size(lines),
        )

        def block(span):
            last = span["last"] - span["first"]
            body = F.filter(
                F.transform(
                    F.slice(lines, span["first"] + 1, last + 1),
                    lambda line, k: block_line(line, k, last, marks),
                ),
                lambda text: text.isNotNull(),
            )
            return _comment(span["first"] + 1, span["last"] + 1, join_lines(body))

        def one_line(line, i):
            body = one_line_comment(line, F.get(states, i), marks)
            return F.when(body.isNotNull(), _comment(i + 1, i + 1, body))

        singles = F.filter(F.transform(lines, one_line), lambda c: c.isNotNull())
        return F.sort_array(F.concat(F.transform(spans, block), singles))

    return let(
        F.struct(lines.alias("lines"), marks.alias("marks")),
        lambda b: let(
            F.struct(
                b["lines"].alias("lines"),
                b["marks"].alias("marks"),
                line_states(b["lines"], b["marks"]).alias("states"),
            ),
            collect,
        ),
    )


def collapse_comments(comments: Column) -> Column:
    """Merge comments whose line numbers touch (gaps and islands inside one row)."""

    def starts(comments):
        return positions(
            comments,
            lambda c, i: (i == 0) | (c["start_line"] - F.get(comments, i - 1)["end_line"] > 1),
        )

    def merged(run):
        return F.struct(
            F.get(run, F.lit(0))["start_line"].alias("start_line"),
            F.get(run, F.size(run) - 1)["end_line"].alias("end_line"),
            join_lines(run["body"]).alias("body"),
        )

    return let(comments, lambda c: runs(c, starts(c), merged))


# A closing quote counts only when the character before it is not ")".
_LOOSE = {q: f"{q}(.*(?<!\\))){q}" for q in "\"'"}
# Escaped pairs are skipped; possessive, so long lines need no stack.
_STRICT = {q: rf"{q}([^{q}\\]*+(?:\\.[^{q}\\]*+)*+){q}" for q in "\"'"}


def string_literals(lines: Column, marks: Column, strict: bool = False) -> Column:
    """Quoted strings of every line, comments included: double quotes, then single ones."""
    pattern = _STRICT if strict else _LOOSE

    def find(bound):
        def of_line(line, i):
            double = F.regexp_extract_all(line, F.lit(pattern['"']), F.lit(1))
            single = F.when(
                bound["marks"]["single_quotes"],
                F.regexp_extract_all(line, F.lit(pattern["'"]), F.lit(1)),
            ).otherwise(F.array().cast("array<string>"))
            return F.transform(
                F.concat(double, single),
                lambda s: F.struct((i + 1).alias("line"), s.alias("body")),
            )

        return F.flatten(F.transform(bound["lines"], of_line))

    return let(F.struct(lines.alias("lines"), marks.alias("marks")), find)


def order_segments(strings: Column, comments: Column) -> Column:
    """Strings and comments by last line, strings first, each in the order found."""
    keyed_strings = F.transform(
        strings,
        lambda s, i: F.struct(
            s["line"].alias("last"),
            F.lit(0).alias("rank"),
            i.alias("no"),
            F.struct(
                F.lit("string").alias("seg_type"),
                s["line"].alias("start_line"),
                s["line"].alias("end_line"),
                s["body"].alias("body"),
            ).alias("segment"),
        ),
    )
    keyed_comments = F.transform(
        comments,
        lambda c, i: F.struct(
            c["end_line"].alias("last"),
            F.lit(1).alias("rank"),
            i.alias("no"),
            F.struct(
                F.lit("comment").alias("seg_type"),
                c["start_line"].alias("start_line"),
                c["end_line"].alias("end_line"),
                c["body"].alias("body"),
            ).alias("segment"),
        ),
    )
    return F.sort_array(F.concat(keyed_strings, keyed_comments))["segment"]


def code_segments(
    content: Column, marks: Column, include_strings=True, collapse=True, strict_strings=False
) -> Column:
    def build(bound):
        comments = raw_comments(bound["lines"], bound["marks"])
        comments = collapse_comments(comments) if collapse else comments
        strings = string_literals(bound["lines"], bound["marks"], strict_strings)
        if not include_strings:
            strings = F.slice(strings, 1, 0)
        return order_segments(strings, comments)

    return let(F.struct(stripped_lines(content).alias("lines"), marks.alias("marks")), build)


def segments(
    content: Column, file_type: Column, include_strings=True, collapse=True, strict_strings=False
) -> Column:
    """Ordered segments of a file; empty for types without a known language."""
    code = list(fv.LANGUAGE_MARKS)
    return (
        F.when(
            file_type.isin(code),
            code_segments(content, language_marks(file_type), include_strings, collapse, strict_strings),
        )
        .when(file_type.isin(list(fv.MARKUP_TYPES)), markup_segments(content, include_strings, collapse))
        .otherwise(no_segments())
    )


def line_range(segment: Column) -> Column:
    """``a~b`` for a segment of several lines, else the line number."""
    return F.when(
        segment["start_line"] != segment["end_line"],
        F.concat_ws("~", segment["start_line"], segment["end_line"]),
    ).otherwise(segment["end_line"].cast("string"))


def is_multiline(segment: Column) -> Column:
    return segment["start_line"] != segment["end_line"]
