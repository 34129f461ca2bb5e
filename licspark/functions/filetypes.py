"""File type from the start of a text, then from the path, then from the whole text."""

from pyspark.sql import Column, functions as F

from licspark import fixed_values as fv
from licspark.functions.names import extension
from licspark.functions.text import strip

# Checked in order; the first match wins.
HEAD_RULES = [
    (r"^#!.*\bpython[0-9.]*\b", fv.PYTHON),
    (r"^#!.*\b(ba|da|k|z)?sh\b", fv.SHELL),
    (r"^<\?php\b", fv.PHP),
    (r"^<\?xml\b", fv.XML),
    (r"(?i)^(<!doctype html|<html\b)", fv.HTML),
]
EXTENSION_RULES = {
    fv.C: (".c", ".h", ".java"),
    fv.CPP: (".cc", ".cpp", ".cxx", ".hpp", ".hh"),
    fv.PYTHON: (".py",),
    fv.SHELL: (".sh", ".bash"),
    fv.PHP: (".php",),
    fv.HTML: (".html", ".htm", ".sgml"),
    fv.XML: (".xml",),
}
# C++: such an include line, and one of these words behind the first of them.
CPP_INCLUDE = r"(?m)^\s*#include\s*<[a-z_]+>\s*$"
CPP_WORD = r"\bnamespace\b|\btemplate\s*<|\bstd::"
CONTENT_RULES = [
    (r"(?m)^\s*#include\s*[<\"]", fv.C),
    (r"(?m)^(public\s+class|import\s+java)\b", fv.C),
    (r"(?m)^(def \w+\(|import \w+$|from \w+ import )", fv.PYTHON),
]


def file_type(content: Column, path: Column | None = None) -> Column:
    """Mime type; unknown for null and empty texts."""
    chain = F.when(F.coalesce(content, F.lit("")) == "", fv.UNKNOWN_TYPE)
    for pattern, mime in HEAD_RULES:
        chain = chain.when(F.ltrim(content).rlike(pattern), mime)
    if path is not None:
        ext = F.lower(extension(path))
        for mime, names in EXTENSION_RULES.items():
            chain = chain.when(ext.isin(*names), mime)
    # two searches keep the cost linear in the text
    include = F.regexp_instr(content, F.lit(CPP_INCLUDE))
    chain = chain.when((include > 0) & F.substring(content, include, F.length(content)).rlike(CPP_WORD), fv.CPP)
    for pattern, mime in CONTENT_RULES:
        chain = chain.when(content.rlike(pattern), mime)
    return chain.otherwise(fv.UNKNOWN_TYPE)


def file_type_key(file_type: Column) -> Column:
    """Counting key: trimmed type, ``None`` when missing or empty."""
    return F.when(F.coalesce(file_type, F.lit("")) == "", "None").otherwise(strip(file_type))
