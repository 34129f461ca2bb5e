"""Comments and text nodes of HTML and XML, found with one regular expression.

Promise: all comments, and all non-blank text with outer white space removed.
Broken markup is not repaired. Script and style bodies count as text.
"""

from pyspark.sql import Column, functions as F

from licspark.functions.text import LINE_END, join_lines, let, strip

# One alternative per kind of node. Loops run over single characters or are
# possessive, so long pages need no matcher stack. A "<" that starts no tag
# belongs to the text around it.
NODE = (
    r"(?is)<!--.*?-->|<!doctype[^>]*>|<\?.*?>"
    r"|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>"
    r"|<[a-z/!][^>]*>|(?:[^<]++|<(?![a-z/!?]))++|<"
)

# Character references decoded in text, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _decode(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _raw_body(node: Column) -> Column:
    """Text between the first ``>`` and the last ``</`` of a script or style element."""
    return F.regexp_extract(node, r"(?s)^[^>]*>(.*)</[^<]*$", 1)


def _node_text(node: Column) -> Column:
    low = F.lower(F.substring(node, 1, 9))
    return (
        F.when(F.startswith(low, F.lit("<!doctype")), F.regexp_extract(node, r"(?is)^<!doctype\s*([^>]*)>", 1))
        .when(F.startswith(low, F.lit("<?")), F.regexp_extract(node, r"(?s)^<\?(.*)>$", 1))
        .when(low.rlike("^<(script|style)") & node.rlike(r"(?is)</(script|style)\s*>$"), _raw_body(node))
        .when(node.rlike("(?i)^<[a-z/!]"), F.lit(None))
        .otherwise(_decode(node))
    )


def markup_comment(nodes: Column) -> Column:
    """Bodies of all comments, in order."""
    is_comment = lambda n: F.startswith(n, F.lit("<!--")) & F.endswith(n, F.lit("-->"))
    body = lambda n: F.regexp_extract(n, r"(?s)^<!--(.*)-->$", 1)
    return F.transform(
        F.filter(nodes, is_comment), lambda n: strip(join_lines(F.split(body(n), LINE_END)))
    )


def markup_strings(nodes: Column) -> Column:
    """Non-blank text nodes, in order."""
    texts = F.transform(
        F.filter(nodes, lambda n: ~F.startswith(n, F.lit("<!--"))), lambda n: strip(_node_text(n))
    )
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def markup_nodes(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(NODE), F.lit(0))


def markup_segments(content: Column, include_strings=True, collapse=True) -> Column:
    """All segments stand on line 0: strings first, then comments (merged to one)."""

    def segment(seg_type):
        return lambda body: F.struct(
            F.lit(seg_type).alias("seg_type"),
            F.lit(0).alias("start_line"),
            F.lit(0).alias("end_line"),
            body.alias("body"),
        )

    def build(nodes):
        comments = markup_comment(nodes)
        if collapse:
            comments = let(
                comments,
                lambda c: F.when(F.size(c) > 0, F.array(join_lines(c))).otherwise(F.slice(c, 1, 0)),
            )
        out = F.transform(comments, segment("comment"))
        if include_strings:
            out = F.concat(F.transform(markup_strings(nodes), segment("string")), out)
        return out

    return let(markup_nodes(content), build)
