"""Segments of files that are too large for one row or one task.

A file comes as chunks of lines, which may lie in any task. What a chunk does to the
block-comment state is one of four maps: out of any block, into one, to the other state,
or nothing; maps are joined along the file by a scan that is parallel within files too
(`operators.scans`). With the state at its start, a chunk finds its comments and strings by
itself. A block that crosses chunks leaves a piece in each; pieces are joined by the
line on which their block starts. The rules are those of `functions.segments`.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from licspark.functions.segments import block_letters, block_line, language_marks, line_letter, one_line_comment, string_literals
from licspark.functions.text import join_lines, let, positions, strip
from licspark.operators.ranking import rank_within
from licspark.operators.scans import carried, in_ranges
from licspark.session import durable

FOUND = "array<struct<kind:string,start_line:long,end_line:long,no:int,entered:boolean,texts:array<string>>>"


def line_chunks(files: DataFrame, lines: Column, size: int, keep: list[str]) -> DataFrame:
    """Chunks of ``size`` lines of files that do fit into a row: ``keep``, chunk, lines."""
    count = F.greatest(F.ceil(F.size("_lines") / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice("_lines", k * size + 1, F.lit(size)))
    chunks = files.withColumn("_lines", lines).select(*keep, F.posexplode(cut).alias("chunk", "lines"))
    return chunks.withColumn("chunk", F.col("chunk").cast("long"))


def read_line_chunks(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """Chunks of stripped lines of text files of any length: path (full name), chunk, lines.

    Spark splits a file over tasks; a line knows the block that it was read from, and
    lines of a block come in order. Lines end at line feeds, carriage returns or both.
    Bytes count as Latin-1 characters.
    """
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), strip(text).alias("line")
    )
    first = lines.groupBy("path", "block").agg(F.min("id").alias("first"))
    cut = lines.join(first, ["path", "block"]).withColumn("part", F.floor((F.col("id") - F.col("first")) / size))
    rows = F.sort_array(F.collect_list(F.struct("id", "line")))
    return cut.groupBy("path", "block", "part").agg(F.transform(rows, lambda r: r["line"]).alias("lines")).select(
        "path", (F.col("block") * F.lit(1 << 20) + F.col("part")).alias("chunk"), "lines"
    )


def chunk_maps(chunks: DataFrame) -> DataFrame:
    """path, chunk, n_lines, turns (0 or 1) and ends (0 out, 1 in, or null): a chunk's map of the block state.

    With ``ends`` the state after the chunk is that, whatever it was before; else it
    changes if ``turns`` is 1.
    """
    letters = F.array_join(F.transform("lines", lambda x: line_letter(x, F.col("marks"))), "")
    fixed = F.regexp_extract("letters", "([IOAB])[^IOAB]*$", 1)
    rest = F.regexp_extract("letters", "([^IOAB]*)$", 1)
    turns = F.length(F.regexp_replace(rest, "[^T]", "")) % 2
    state = F.when(fixed == "I", 1).when(fixed != "", 0)
    mapped = chunks.select("path", "chunk", F.size("lines").cast("long").alias("n_lines"), letters.alias("letters"))
    return mapped.select("path", "chunk", "n_lines", F.when(fixed == "", turns).otherwise(0).alias("turns"), ((state + turns) % 2).alias("ends"))


def chunk_entries(chunks: DataFrame) -> DataFrame:
    """path, chunk, inside (a block is open where the chunk starts) and before (lines of the file before it)."""
    along = (["path"], ["chunk"])
    maps = in_ranges(chunk_maps(chunks), *along)
    turned = carried(maps, *along, sums={"before": F.col("n_lines"), "turned": F.col("turns")})
    # a fixed state, told as if no turn had come before it, so that all turns up to a later chunk apply to it
    fixed = carried(turned, *along, lasts={"fixed": (F.col("ends") + F.col("turned")) % 2})
    inside = (F.coalesce("fixed", F.lit(0)) + F.col("turned")) % 2 == 1
    return fixed.select("path", "chunk", "before", inside.alias("inside"))


def _found_in_chunk(lines: Column, marks: Column, inside: Column, before: Column) -> Column:
    """Comments, strings and pieces of blocks of one chunk. A chunk that starts inside a block gets a line in front that opens one."""

    def collect(b):
        ahead = F.when(b["inside"], 1).otherwise(0)
        # a block that is not closed has its ">" behind the last line
        spans = F.arrays_zip(
            positions(b["states"], lambda c, _: c == "<").alias("first"), positions(b["states"], lambda c, _: c == ">").alias("last")
        )
        number = lambda k: b["before"] + k + 1 - ahead

        def block(span, no):
            last = span["last"] - span["first"]
            entered = b["inside"] & (span["first"] == 0)
            closed = span["last"] < F.size(b["lines"])
            text = lambda line, k: F.when(~(entered & (k == 0)), block_line(line, k, last, b["marks"]))
            texts = F.filter(F.transform(F.slice(b["lines"], span["first"] + 1, last + 1), text), lambda t: t.isNotNull())
            return F.struct(
                F.when(entered | ~closed, "piece").otherwise("comment").alias("kind"),
                F.when(~entered, number(span["first"])).alias("start_line"),
                F.when(closed, number(span["last"])).alias("end_line"),
                no.alias("no"),
                entered.alias("entered"),
                texts.alias("texts"),
            )

        def single(line, i):
            body = one_line_comment(line, F.get(b["states"], i), b["marks"])
            return F.when(body.isNotNull(), _row("comment", number(i), i, body))

        strings = F.transform(string_literals(b["lines"], b["marks"]), lambda s, i: _row("string", number(s["line"] - 1), i, s["body"]))
        singles = F.filter(F.transform(b["lines"], single), lambda c: c.isNotNull())
        return F.concat(F.transform(spans, block).cast(FOUND), singles.cast(FOUND), strings.cast(FOUND))

    def with_states(b):
        letters = F.array_join(F.transform(b["lines"], lambda x: line_letter(x, b["marks"])), "")
        # the line in front is blank in all other respects
        opened = F.when(b["inside"], F.concat(F.lit("I"), F.substr(letters, F.lit(2)))).otherwise(letters)
        return let(F.struct(*[b[n].alias(n) for n in ("lines", "marks", "inside", "before")], F.split(block_letters(opened), "").alias("states")), collect)

    front = F.when(inside, F.concat(F.array(F.lit("")), lines)).otherwise(lines)
    return let(F.struct(front.alias("lines"), marks.alias("marks"), inside.alias("inside"), before.alias("before")), with_states)


def _row(kind: str, line: Column, no: Column, body: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), line.alias("start_line"), line.alias("end_line"), no.alias("no"), F.lit(False).alias("entered"), F.array(body).alias("texts")
    )


def chunked_segments(chunks: DataFrame) -> DataFrame:
    """Ordered segments of code files given in chunks: path, no, seg_type, start_line, end_line, body.

    ``chunks``: path, file_type, chunk (rising along a file, unique), lines (stripped;
    blank ones kept). File types without comment marks have no rows. A segment is one
    row, so only its own length is bounded, not that of its file.
    """
    marked = chunks.withColumn("marks", language_marks(F.col("file_type"))).where(F.col("marks").isNotNull())
    entered = marked.join(chunk_entries(marked), ["path", "chunk"])
    found = _found_in_chunk(F.col("lines"), F.col("marks"), F.col("inside"), F.col("before"))
    rows = durable(entered.select("path", "chunk", F.inline(found)))

    # a piece that was entered belongs to the last block that started before it
    pieces = in_ranges(rows.where("kind = 'piece'"), ["path"], ["chunk", "no"])
    pieces = carried(pieces, ["path"], ["chunk", "no"], lasts={"opened": F.col("start_line")})
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(*key, value))), lambda x: x[value])
    across = pieces.groupBy("path", F.coalesce("start_line", "opened").alias("start_line")).agg(
        F.max("end_line").alias("end_line"), join_lines(F.flatten(in_order(["chunk", "no"], "texts"))).alias("body")
    )
    whole = rows.where("kind = 'comment'").select("path", "start_line", "end_line", join_lines(F.col("texts")).alias("body"))
    comments = whole.unionByName(across.where("end_line is not null"))

    # comments that touch are merged, wherever chunks end
    ranged = in_ranges(comments, ["path"], ["start_line"])
    ranged = carried(ranged, ["path"], ["start_line"], lasts={"previous": F.col("end_line")})
    ranged = ranged.withColumn("head", F.when(F.col("previous").isNull() | (F.col("start_line") - F.col("previous") > 1), F.col("start_line")))
    ranged = carried(ranged, ["path"], ["start_line"], lasts={"earlier": F.col("head")})
    merged = ranged.groupBy("path", F.coalesce("head", "earlier").alias("start_line")).agg(
        F.max("end_line").alias("end_line"), join_lines(in_order(["start_line"], "body")).alias("body")
    )

    strings = rows.where("kind = 'string'").select("path", F.lit("string").alias("seg_type"), "start_line", "end_line", F.get("texts", F.lit(0)).alias("body"), F.lit(0).alias("rank"), "no")
    both = strings.unionByName(merged.select("path", F.lit("comment").alias("seg_type"), "start_line", "end_line", "body", F.lit(1).alias("rank"), F.lit(0).alias("no")))
    placed = rank_within(both, ["path"], ["end_line", "rank", "no"], name="place")
    return placed.select("path", (F.col("place") - 1).cast("int").alias("no"), "seg_type", "start_line", "end_line", "body")
