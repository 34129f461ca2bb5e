"""Values the results depend on, kept in one place.

FIXED VALUES: source names, tags, keywords, patterns and language marks below
are part of the data contract. Changing one changes query results.
"""

# --- finding sources -> (kind, remove, indirect) ---------------------------
SOURCE_REGISTRY = [
    ("CONCLUSION", "Conclusion", None, None),
    ("BULK", "Bulk", False, None),
    ("BULK_REMOVE", "Bulk", True, None),
    ("LICENSE", "License", None, False),
    ("LICENSE_INDIRECT", "License", None, True),
    ("ninka", "NinkaFinding", None, None),
    ("nomos", "NomosFinding", None, None),
    ("monk", "MonkFinding", None, None),
]
SCANNERS = ("ninka", "nomos", "monk")

# --- tags ------------------------------------------------------------------
SINGLE_MAPPED_LICENSE = "SINGLE_MAPPED_LICENSE"
MULTIPLE_MAPPED_LICENSE = "MULTIPLE_MAPPED_LICENSE"
LRW = "LRW"
NO_LRW = "NO_LRW"
TEST = "TEST"
DERIVED_TAGS = (SINGLE_MAPPED_LICENSE, MULTIPLE_MAPPED_LICENSE, LRW, NO_LRW)

# --- license mapping keywords ----------------------------------------------
NO_MAPPED_LICENSE = "NO_MAPPED_LICENSE"
MULTI_LICENSE = "MULTI_LICENSE"

# --- classification results ------------------------------------------------
SINGLE = "single"
MULTI = "multi"
NO_LICENSE = "no license"
UNCLASSIFIED = "unclassified license"
LICENSE_TEXT_FALLBACK = "License by licspark"

# --- mime types ------------------------------------------------------------
C = "text/x-c"
CPP = "text/x-c++"
HTML = "text/html"
XML = "text/xml"
PYTHON = "text/x-python"
SHELL = "text/x-shellscript"
PHP = "text/x-php"
UNKNOWN_TYPE = "unknown filetype"

# --- code languages: mime -> line mark, block start, block middle, block end,
#     whether single quotes also delimit strings ------------------------------
LANGUAGE_MARKS = {
    C: ("//", "/*", None, "*/", False),
    CPP: ("//", "/*", None, "*/", False),
    PHP: ("//", "/**", "*", "*/", True),
    PYTHON: ("#", '"""', None, '"""', True),
    SHELL: ("#", None, None, None, True),
}
MARKUP_TYPES = (HTML, XML)

# --- text that speaks about licenses ----------------------------------------
LRW_PATTERN = r"(?i)licen|copyright|\(c\)|public domain"

# --- words counted when the best license comment of a file is chosen --------
COMMENT_KEYWORDS = (
    "source free under use copyright grant software license licence agreement distribute "
    "redistribution liability rights reserved general public modify modified modification "
    "permission permitted granted distributed notice distribution terms freely licensed "
    "merchantibility redistributed see read (c) copying legal licensing spdx"
).split()
# Two neighbouring keywords that one historical keyword list glues together.
GLUED_KEYWORDS = ("permitted", "granted")
SPDX_MARK = "spdx-license-identifier"

# --- English words that stay although they are usual stop words -------------
PROTECTED_WORDS = frozenset(
    "will now whom them own above her themselves are too i nor yours more few most ours here "
    "just had they that himself a same about t she was do having their been doing not being "
    "the very re with how those yourself at what your if you by s then as to through it there "
    "so other during up out we for where once d when under between against these he him in "
    "does of all or no his but only such were some again should over and why an which me this "
    "into be o have y has is than because did my am can before down any on after below from "
    "until itself who each further while our its both".split()
)

# --- limits -----------------------------------------------------------------
MAX_FEATURES = 10_000
MIN_SAMPLES_KEPT = 10
HOLDOUT_FACTOR = 0.1
HOLDOUT_MIN_SAMPLES = 10
SPECIAL_FAMILIES = ("HPND",)
