"""Engine inputs derived from the driver's tables.

Every derivation is written once as SQL that both Spark and DuckDB accept; only
array and lambda syntax differ and are filled in by ``Dialect``.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Dialect:
    array: str  # array constructor
    lines: str  # array of lines of the column "text"
    each: str  # prefix of a lambda over (value l, position i)
    transform: str
    position: str  # 1-based position
    compact: str  # call that drops nulls
    no_strings: str


SPARK = Dialect(
    "array({})", "split(text, '\\n')", "(l, i) -> ", "transform", "(i + 1)", "array_compact({})",
    "CAST(array() AS array<string>)",
)
DUCKDB = Dialect(
    "[{}]", "string_split(text, chr(10))", "lambda l, i: ", "list_transform", "i",
    "list_filter({}, lambda v: v IS NOT NULL)", "CAST([] AS VARCHAR[])",
)

NAMES = (
    "MIT,GPL-2.0,Apache-2.0,BSD-3-Clause,HPND,HPND-sell-variant,"
    "ISC,LGPL-2.1,MPL-1.1,Zlib,Old License,X.Net/v1"
)


def _name(index: str) -> str:
    return f"split_part('{NAMES}', ',', CAST({index} + 1 AS INT))"


def raw_findings_sql(d: Dialect) -> str:
    """Findings of order lines: a few licenses own most of the rows."""
    first = _name("least(l_partkey % 12, l_suppkey % 12)")
    second = _name("least(l_partkey % 7, CAST(l_quantity AS BIGINT) % 11)")
    one, two = d.array.format("l1"), d.array.format("l1, l2")
    return f"""
SELECT seq, path, source,
       CASE WHEN l_partkey % 97 = 0 THEN {d.no_strings}
            WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN {two} ELSE {one} END AS licenses,
       concat('text of ', l1, ' ', CAST(l_partkey AS STRING)) AS text
FROM (
  SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS seq,
         concat('o', CAST(l_orderkey AS STRING), '/f', CAST(l_linenumber % 3 AS STRING),
                CASE l_orderkey % 6 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' WHEN 2 THEN '.py'
                     WHEN 3 THEN '.sh' WHEN 4 THEN '.txt' ELSE '' END) AS path,
         CASE WHEN l_suppkey % 10 < 4 THEN 'CONCLUSION'
              WHEN l_suppkey % 10 = 4 THEN 'BULK'
              WHEN l_suppkey % 10 = 5 THEN 'BULK_REMOVE'
              WHEN l_suppkey % 10 = 6 AND l_linenumber % 2 = 0 THEN 'LICENSE'
              WHEN l_suppkey % 10 = 6 THEN 'LICENSE_INDIRECT'
              WHEN l_suppkey % 10 = 7 THEN 'nomos'
              WHEN l_suppkey % 10 = 8 THEN 'monk'
              WHEN l_linenumber % 2 = 0 THEN 'ninka'
              ELSE 'unknown_tool' END AS source,
         CASE l_linenumber WHEN 7 THEN concat('"', {first}, ' "')
              WHEN 6 THEN concat('"', {first}, '" ') ELSE {first} END AS l1,
         {second} AS l2,
         l_partkey, l_quantity
  FROM lineitem
)"""


def dump_lines_sql() -> str:
    """Comma-separated dump lines of order lines; some stop before the source."""
    return f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_partkey % 50 = 0
            THEN concat('o', CAST(l_orderkey AS STRING), ',', {_name('l_partkey % 12')}, ',', {_name('l_suppkey % 12')})
            ELSE concat('o', CAST(l_orderkey AS STRING), ',', {_name('l_partkey % 12')}, ',', {_name('l_suppkey % 12')},
                        ',', CASE l_linenumber % 3 WHEN 0 THEN 'CONCLUSION' WHEN 1 THEN 'nomos' ELSE 'monk' END,
                        ',', CAST(l_partkey AS STRING)) END AS value
FROM lineitem"""


def mapping_lines_sql() -> str:
    """Mapping lines with repeated names, keywords and empty targets, from the parts."""
    return f"""
SELECT p_partkey AS line_no,
       concat('  ', old, ';',
              CASE p_type WHEN 'ECONOMY' THEN concat(old, ';')
                          WHEN 'STANDARD' THEN concat(old, '-only;;')
                          WHEN 'PROMO' THEN 'NO_MAPPED_LICENSE;'
                          WHEN 'MEDIUM' THEN ''
                          WHEN 'LARGE' THEN concat(old, ';Extra;MULTI_LICENSE')
                          ELSE concat('A-', old) END, ' ') AS value
FROM (SELECT p_partkey, p_type,
             CASE WHEN p_size % 3 = 0 THEN p_brand ELSE {_name('p_size % 12')} END AS old
      FROM part)"""


def _decorated_line(position: str) -> str:
    """One line of program text around a line of prose."""
    k = f"({position} + doc_id) % 10"
    kind = "doc_id % 7"
    start = f"CASE {kind} WHEN 2 THEN '\"\"\"' WHEN 4 THEN '/** ' ELSE '/* ' END"
    end = f"CASE {kind} WHEN 2 THEN '\"\"\"' ELSE ' */' END"
    mark = f"CASE WHEN {kind} IN (2, 3) THEN '# ' ELSE '// ' END"
    return f"""CASE {k}
        WHEN 0 THEN concat({mark}, l)
        WHEN 1 THEN concat('  ', {start}, l)
        WHEN 2 THEN concat(CASE {kind} WHEN 4 THEN ' * ' ELSE '' END, l)
        WHEN 3 THEN concat(l, {end})
        WHEN 4 THEN concat('print("', l, '");')
        WHEN 5 THEN concat({start}, l, {end})
        WHEN 6 THEN concat('  ', l, '  ')
        WHEN 7 THEN concat({mark}, l, ' ', {mark}, 'x')
        WHEN 8 THEN concat('s = ''', l, ''' + "(a)" ')
        ELSE concat({mark}, l) END"""


def code_files_sql(d: Dialect) -> str:
    """Documents as program files in several languages."""
    body = f"{d.transform}({d.lines}, {d.each}{_decorated_line(d.position)})"
    join = "array_join({}, '\\n')" if d is SPARK else "array_to_string({}, chr(10))"
    return f"""
SELECT doc_id, source,
       concat(source, '/', CAST(doc_id AS STRING),
              CASE doc_id % 7 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' WHEN 2 THEN '.py' WHEN 3 THEN '.sh'
                              WHEN 4 THEN '.php' WHEN 5 THEN '.txt' ELSE '.java' END) AS path,
       CASE doc_id % 7 WHEN 0 THEN 'text/x-c' WHEN 1 THEN 'text/x-c++' WHEN 2 THEN 'text/x-python'
                       WHEN 3 THEN 'text/x-shellscript' WHEN 4 THEN 'text/x-php'
                       WHEN 5 THEN 'unknown filetype' ELSE 'text/x-c' END AS file_type,
       {join.format(body)} AS content
FROM documents"""


STATEMENTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def doc_licenses_sql(d: Dialect) -> str:
    """Concluded licenses of documents: language, license statements and labels as names."""
    statements = ", ".join(
        f"CASE WHEN contains(text, '{line}') THEN '{name}' END" for name, line in STATEMENTS.items()
    )
    values = (
        f"concat('Text-', upper(lang)), {statements}, "
        "CASE WHEN quality = 1 THEN 'HPND-fair' END, CASE WHEN toxic = 1 THEN 'HPND-harsh' END"
    )
    return f"""
SELECT doc_id, concat(source, '/', CAST(doc_id AS STRING)) AS path, text,
       {d.compact.format(d.array.format(values))} AS licenses
FROM (SELECT d.doc_id, d.source, d.text, d.lang, b.quality, b.toxic
      FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id)"""


def guessed_labels_sql(d: Dialect) -> str:
    """A crude guess of the document labels, to have something to evaluate."""
    values = (
        "CASE WHEN doc_id % 5 = 0 THEN 'Text-EN' WHEN doc_id % 11 <> 0 THEN concat('Text-', upper(lang)) END, "
        "CASE WHEN n_chars > 800 THEN 'HPND-fair' END, "
        "CASE WHEN doc_id % 13 = 0 THEN 'HPND-harsh' END, "
        "CASE WHEN contains(text, 'MIT License') THEN 'MIT' END"
    )
    return f"""
SELECT concat(source, '/', CAST(doc_id AS STRING)) AS path,
       {d.compact.format(d.array.format(values))} AS labels
FROM documents"""


# ---------------------------------------------------------------- Spark side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for text work on an input with fewer splits than cores; a no-op on large inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a derivation over tables of one scale factor."""
    sources = {name: spread(table(spark, sf_dir, name)) for name in tables}
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(sql, **sources)


def raw_findings(spark, sf_dir):
    return derived(spark, sf_dir, raw_findings_sql(SPARK), "lineitem")


def dump_lines(spark, sf_dir):
    return derived(spark, sf_dir, dump_lines_sql(), "lineitem")


def mapping_lines(spark, sf_dir):
    return derived(spark, sf_dir, mapping_lines_sql(), "part")


def code_files(spark, sf_dir):
    return derived(spark, sf_dir, code_files_sql(SPARK), "documents")


def doc_licenses(spark, sf_dir):
    return derived(spark, sf_dir, doc_licenses_sql(SPARK), "documents", "labels")


def guessed_labels(spark, sf_dir):
    return derived(spark, sf_dir, guessed_labels_sql(SPARK), "documents")


def text_files(spark, sf_dir):
    """Documents as plain text files."""
    documents = spread(table(spark, sf_dir, "documents"))
    return documents.select(
        F.concat_ws("/", "source", "doc_id").alias("path"),
        "doc_id",
        "lang",
        F.col("text").alias("content"),
        F.lit("unknown filetype").alias("file_type"),
    )


def page_files(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select(
        "page_id", F.col("html").alias("content"), F.lit("text/html").alias("file_type")
    )


def lemmas(spark, sf_dir):
    """(token, lemma) of plural-looking words in the benchmark texts."""
    from licspark.functions.tokens import word_tokens

    tokens = table(spark, sf_dir, "benchmark").select(F.explode(word_tokens(F.col("text"))).alias("token"))
    return tokens.where(F.endswith("token", F.lit("s")) & (F.length("token") > 3)).distinct().select(
        "token", F.expr("substr(token, 1, length(token) - 1)").alias("lemma")
    )
