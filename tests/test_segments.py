import random

import pytest
from pyspark.sql import functions as F

from licspark import fixed_values as fv
from licspark.functions import comments as cm
from licspark.functions import segments as seg
from licspark.functions.filetypes import file_type
from licspark.functions.text import numbered_lines, stripped_lines

FILES = {
    "html.html": (
        fv.HTML,
        "<html>\n<header><title>This is title</title></header>\n<body>\nHello world\n</body>\n</html>\n",
        ["This is title", "Hello world"],
    ),
    "c.c": (
        fv.C,
        "#include <stdio.h>\nint main()\n{\n   // printf() displays the string inside quotation\n"
        '   printf("Hello, World!");\n   return 0;\n}',
        ["printf() displays the string inside quotation", "Hello, World!"],
    ),
    "c_plus_plus.cpp": (
        fv.CPP,
        "#include <iostream>\nusing namespace std;\n\n/*\nMultiline test: This is a test comment\n*/\n"
        '// single line text\nint main() \n{\n    cout << "Hello, World!";\n    return 0;\n}',
        ["\nMultiline test: This is a test comment\n\nsingle line text", "Hello, World!"],
    ),
    "python.py": (
        fv.PYTHON,
        '#!/usr/bin/env python\n# -*- encoding: utf-8 -*-\n\n"""\nThis is a\nmulti\nline\ncomment\n"""\n'
        "# This is a single line comment!\n\nprint('Hello, world!')\n",
        [
            "!/usr/bin/env python\n-*- encoding: utf-8 -*-",
            '"',
            '"',
            "\nThis is a\nmulti\nline\ncomment\n\nThis is a single line comment!",
            "Hello, world!",
        ],
    ),
    "shell.sh": (
        fv.SHELL,
        "#!/bin/sh\n# This is a comment!\necho Hello World        # This is a comment, too!\n",
        ["!/bin/sh\nThis is a comment!"],
    ),
    "xml.xml": (
        fv.XML,
        '<?xml version="1.0" encoding="UTF-8"?>\n<text>\n  <para>hello world</para>\n</text>\n',
        ['xml version="1.0" encoding="UTF-8"?', "hello world"],
    ),
    "php.php": (
        fv.PHP,
        "<?php\n  // Declare the variable 'string' and assign it a value.\n"
        "  // The <br> is the HTML equivalent to a new line.\n  $string = 'Hello World!<br>';\n"
        "  echo $string;\n  print $string;\n\n  printf('%s', $string);\n?>",
        [
            "string",
            "Declare the variable 'string' and assign it a value.\nThe <br> is the HTML equivalent to a new line.",
            "Hello World!<br>",
            "%s",
        ],
    ),
    "error_file.scratch": (fv.UNKNOWN_TYPE, "int x; // y", []),
    "mark": (fv.C, "// see http://x", ["see http:"]),
    "paren": (fv.C, 'f("a)")', []),
    "greedy": (fv.C, 'f("a)") + "b" g("c")', ['a)") + "b" g("c']),
    "odd start": (fv.C, "/*/\nx */", ["/\nx"]),
    "never closed": (fv.C, "/* never closed\n// x", []),
    "one line": (fv.PYTHON, '"""d"""', ['""d""', "d"]),
    "php doc": (fv.PHP, "/**/\n* a * b\n*/", ["/\na\n"]),
    "empty": (fv.C, "", []),
}


def literals(spark, rows, **options):
    df = spark.createDataFrame(rows, "path string, file_type string, content string")
    out = df.select("path", seg.segments(F.col("content"), F.col("file_type"), **options)["body"].alias("x"))
    return {r.path: r.x for r in out.collect()}


def test_golden_files(spark):
    got = literals(spark, [(p, t, c) for p, (t, c, _) in FILES.items()])
    assert got == {p: want for p, (_, _, want) in FILES.items()}


def test_options(spark):
    rows = [("a", fv.C, '// x\n// y\nf("a\\"b)") + "c"')]
    assert literals(spark, rows, include_strings=False, collapse=False)["a"] == ["x", "y"]
    assert literals(spark, rows, strict_strings=True)["a"] == ["x\ny", 'a\\"b)', "c"]


def random_text(rng):
    parts = ["/*", "*/", "/**", "//", "#", '"""', "*", "a b", "(c)", '"s"', "'t'", " ", "/", "x"]
    return "\n".join(
        "".join(rng.choice(parts) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(12))
    )


def comment_spans(content, mime):
    """(first, last) line of each comment, by folding the state table of a line: what it does outside and inside a block."""
    line_mark, start, _, end, _ = fv.LANGUAGE_MARKS[mime]
    spans, opened = [], None
    for number, line in enumerate((x.strip() for x in content.splitlines()), 1):
        a = line.startswith(line_mark)
        h, f = start is not None and line.startswith(start), end is not None and line.endswith(end)
        long = start is not None and len(line) >= len(start) + len(end)
        if not line:
            effect = "same"
        elif f:
            effect = "toggle" if h and not long and not a else "out"
        else:
            effect = "in" if h and not a else "same"
        if opened is None:
            if line and (a or (h and f and long)):
                spans.append((number, number))
            elif effect in ("in", "toggle"):
                opened = number
        elif effect in ("out", "toggle"):
            spans.append((opened, number))
            opened = None
    return spans


def test_block_state_against_the_state_table(spark):
    rng = random.Random(7)
    rows = [(str(i), rng.choice(list(fv.LANGUAGE_MARKS)), random_text(rng)) for i in range(3000)]
    df = spark.createDataFrame(rows, "path string, file_type string, content string")
    raw = seg.raw_comments(stripped_lines(F.col("content")), seg.language_marks(F.col("file_type")))
    got = df.select("path", raw.alias("raw"), seg.collapse_comments(raw).alias("merged")).collect()
    texts = {p: (t, c) for p, t, c in rows}
    for row in got:
        mime, content = texts[row.path]
        assert [(c.start_line, c.end_line) for c in row.raw] == comment_spans(content, mime), (mime, content)
        groups = []
        for c in row.raw:
            if groups and c.start_line - groups[-1][-1].end_line <= 1:
                groups[-1].append(c)
            else:
                groups.append([c])
        want = [(g[0].start_line, g[-1].end_line, "\n".join(c.body for c in g)) for g in groups]
        assert [(c.start_line, c.end_line, c.body) for c in row.merged] == want, (mime, content)


def test_very_long_file_stays_linear(spark):
    text = "/* open\n" + "// x\n" * 60_000 + "*/\n" + "/* never\n" * 60_000
    df = spark.createDataFrame([("a", fv.C, text)], "path string, file_type string, content string")
    raw = seg.raw_comments(stripped_lines(F.col("content")), seg.language_marks(F.col("file_type")))
    row = df.select(F.transform(raw, lambda c: c["end_line"])).first()[0]
    assert row == [60_002]


def test_line_numbers(spark):
    df = spark.createDataFrame([("a\r\n\n  b\x0bc ",)], ["t"])
    rows = df.select(F.inline(numbered_lines(F.col("t")))).collect()
    assert [tuple(r) for r in rows] == [(1, "a"), (3, "b"), (4, "c")]


def test_markup(spark):
    page = (
        "<!DOCTYPE html><p a='1'>x &amp;lt; y</p><!-- one --><script>var t='</p>';</script>"
        "<style>p{}</style><!--two\nlines--> a < b <br/>"
    )
    assert literals(spark, [("p", fv.HTML, page)])["p"] == [
        "html", "x &lt; y", "var t='</p>';", "p{}", "a < b", "one\ntwo\nlines",
    ]


@pytest.mark.parametrize(
    "path, content, want",
    [
        ("c.c", "int x;", fv.C),
        ("java.java", "class A {}", fv.C),
        ("c_plus_plus.cpp", "int x;", fv.CPP),
        ("noext", "#include <iostream>\nusing namespace std;", fv.CPP),
        ("noext", "#include <stdio.h>\nint main() {}", fv.C),
        ("html.html", "<html>", fv.HTML),
        ("noext", "<!DOCTYPE html>\n<p>", fv.HTML),
        ("xml.xml", '<?xml version="1.0"?>', fv.XML),
        ("shell", "#!/bin/sh\necho", fv.SHELL),
        ("python", "#!/usr/bin/env python\n", fv.PYTHON),
        ("php", "<?php echo 1;", fv.PHP),
        ("c.c", "", fv.UNKNOWN_TYPE),
        ("c.c", None, fv.UNKNOWN_TYPE),
        ("README", "some words", fv.UNKNOWN_TYPE),
    ],
)
def test_file_types(spark, path, content, want):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    assert df.select(file_type(F.col("content"), F.col("path"))).first()[0] == want


def test_license_comment(spark):
    rows = [
        ("spdx", ["free software", "SPDX-License-Identifier: MIT", "license"], "SPDX-License-Identifier: MIT"),
        ("records", ["nothing", "free", "also free", "free software license"], " free free software license"),
        ("none", [], ""),
    ]
    df = spark.createDataFrame(rows, "path string, comments array<string>, want string")
    for row in df.withColumn("got", cm.license_comment(F.col("comments"))).collect():
        assert row.got == row.want, row.path


def test_keyword_modes(spark):
    df = spark.createDataFrame([("permitted use", "permittedgranted")], ["a", "b"])
    count = lambda c, faithful: cm.keyword_count(F.col(c), faithful)
    row = df.select(count("a", False), count("a", True), count("b", False), count("b", True)).first()
    # The glued word also contains "grant".
    assert tuple(row) == (2, 1, 3, 2)


def test_comment_kinds(spark):
    text = "// one\nint x;\n// two\n// three\n/* block\nend */\n"
    df = spark.createDataFrame([(fv.C, text)], "file_type string, content string")
    got = df.select(cm.comments_by_kind(F.col("content"), F.col("file_type"))).first()[0]
    assert got == ["block\nend", "two three", "one"]
