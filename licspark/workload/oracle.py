"""SQL twins of the registered queries, for DuckDB over the same tables.

They are written from the semantics, not from the Spark plans: block state, for
example, is a window recipe over exploded lines here, and in-row there.
"""

from licspark import fixed_values as fv
from licspark.functions.porter import stem_layers
from licspark.functions.tokens import STOP_WORDS
from licspark.workload import inputs
from licspark.workload.inputs import DUCKDB

ORACLES = {}

# Unicode white space and line ends, as RE2 class members.
_SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LRW = "(?i)licen|copyright|\\(c\\)|public domain"


def strip(x):
    return f"regexp_replace(regexp_replace({x}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"


def joined(x, by="|"):
    return f"array_to_string({x}, '{by}')"


def sql(name, select, *parts):
    """Register ``select`` with the named CTEs in front."""
    ctes = ",\n".join(f"{n} AS ({body})" for n, body in parts)
    ORACLES[name] = (f"WITH {ctes}\n" if parts else "") + select


def quoted(values):
    return ", ".join(f"'{v}'" for v in values)


# ------------------------------------------------------------------ flagship

_statement = "CASE " + " ".join(
    f"WHEN contains(line, '{s}') THEN '{n}'" for n, s in inputs.STATEMENTS.items()
) + " END"
STATEMENT_ROWS = (
    "statement_rows",
    f"""SELECT source, {_statement} AS license
    FROM (SELECT source, unnest(regexp_split_to_array(text, '{_LINE_END}')) AS line FROM documents)
    WHERE regexp_matches(line, '{_LRW}')""",
)
_counts = "SELECT source, license, count(*) AS n FROM statement_rows GROUP BY source, license"
sql("license_statements_by_source", _counts, STATEMENT_ROWS)
sql("stream_statement_counts", _counts, STATEMENT_ROWS)

# ------------------------------------------------------------------ findings


def clean(x, faithful=False):
    inner = x if faithful else strip(x)
    return strip(f"trim({inner}, '\"')")


_kind = "CASE source " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k, _, _ in fv.SOURCE_REGISTRY) + " END"
RAW = ("raw", inputs.raw_findings_sql(DUCKDB))
TYPED = (
    "typed",
    f"""SELECT seq, path, source, {_kind} AS kind,
      CASE source WHEN 'BULK' THEN false WHEN 'BULK_REMOVE' THEN true END AS remove,
      CASE source WHEN 'LICENSE' THEN false WHEN 'LICENSE_INDIRECT' THEN true END AS indirect,
      CASE WHEN source IN ('BULK', 'BULK_REMOVE', 'LICENSE', 'LICENSE_INDIRECT') THEN text END AS text,
      list_filter(list_transform(licenses, lambda x: {clean('x')}), lambda x: x <> '') AS licenses
    FROM raw""",
)
FILES = (
    "files",
    """SELECT kind, path, list_sort(list_distinct(flatten(list(licenses)))) AS licenses,
      arg_min_null(remove, seq) AS remove, arg_min_null(indirect, seq) AS indirect, arg_min_null(text, seq) AS text
    FROM typed WHERE kind IS NOT NULL AND len(licenses) > 0 GROUP BY kind, path""",
)
_file_rows = f"""SELECT kind, path, {joined('licenses')} AS licenses, CAST(remove AS VARCHAR) AS remove,
  CAST(indirect AS VARCHAR) AS indirect, text FROM files"""
for name in ("findings_dedupe", "incremental_upsert", "stream_findings"):
    sql(name, _file_rows, RAW, TYPED, FILES)
sql(
    "findings_quarantine",
    """SELECT path, source, CASE WHEN kind IS NULL THEN 'unknown source' ELSE 'no license' END AS problem
    FROM typed WHERE kind IS NULL OR len(licenses) = 0""",
    RAW,
    TYPED,
)
sql(
    "raw_findings_damaged",
    """SELECT CASE WHEN seq % 13 <> 0 THEN path END AS path, CASE WHEN seq % 13 <> 0 THEN source END AS source,
      CASE WHEN seq % 13 = 0 THEN 'damaged line' END AS problem,
      CASE WHEN seq % 13 = 0 THEN concat('{"seq":', seq, ',"path":"', path)
        ELSE array_to_string(list_concat([CAST(seq AS VARCHAR)], licenses, [text]), '|') END AS line
    FROM raw""",
    RAW,
)
sql("kind_counts", "SELECT kind, count(*) AS n FROM files GROUP BY kind", RAW, TYPED, FILES)
sql(
    "findings_registry_join",
    """SELECT kind, count(*) AS n FROM (
      SELECT DISTINCT coalesce(kind, 'ToolFinding') AS kind, path FROM typed WHERE len(licenses) > 0)
    GROUP BY kind""",
    RAW,
    TYPED,
)
sql(
    "csv_dump_findings",
    """SELECT path, source, license, count(*) AS n, CAST(sum(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected
    FROM (SELECT parts[1] AS path, source,
            CASE WHEN source IN ('ninka', 'nomos', 'monk') THEN parts[3] ELSE parts[2] END AS license
          FROM (SELECT parts, CASE WHEN len(parts) > 3 THEN parts[4] END AS source
                FROM (SELECT string_split(value, ',') AS parts FROM dump)))
    GROUP BY path, source, license""",
    ("dump", inputs.dump_lines_sql()),
)

# ------------------------------------------------------------------- mapping

MAPPING_ROWS = (
    "mapping_rows",
    f"""SELECT line_no, parts[1] AS old, list_filter(parts[2:], lambda x: x <> '') AS new
    FROM (SELECT line_no, string_split({strip('value')}, ';') AS parts FROM mapping_lines)""",
)
MAPPING = ("mapping", "SELECT old, arg_max(new, line_no) AS new FROM mapping_rows GROUP BY old")
MAPPING_PARTS = (("mapping_lines", inputs.mapping_lines_sql()), MAPPING_ROWS, MAPPING)
sql("mapping_load", f"SELECT old, {joined('new')} AS new FROM mapping", *MAPPING_PARTS)
sql(
    "mapping_duplicates",
    "SELECT old, count(*) AS n_lines FROM mapping_rows GROUP BY old HAVING count(*) > 1",
    *MAPPING_PARTS,
)
sql(
    "mapping_template",
    "SELECT DISTINCT unnest(licenses) AS license, '' AS target FROM files",
    RAW,
    TYPED,
    FILES,
)
_PLACED = (
    "placed",
    """SELECT c.path, c.pos, CASE WHEN len(m.new) > 0 THEN m.new ELSE [c.license] END AS new
    FROM (SELECT path, unnest(licenses) AS license, generate_subscripts(licenses, 1) AS pos
          FROM files WHERE kind = 'Conclusion') c
    LEFT JOIN mapping m ON m.old = c.license""",
)
_MAPPED_SETS = (
    "mapped_sets",
    """SELECT path, list_sort(list_distinct(flatten(list(new)))) AS mapped
    FROM placed WHERE NOT list_contains(new, 'NO_MAPPED_LICENSE') GROUP BY path""",
)
_path_type = """CASE WHEN path LIKE '%.cpp' THEN 'text/x-c++' WHEN path LIKE '%.c' THEN 'text/x-c'
    WHEN path LIKE '%.py' THEN 'text/x-python' WHEN path LIKE '%.sh' THEN 'text/x-shellscript'
    ELSE 'unknown filetype' END"""
_CONCLUSIONS = (
    "conclusions",
    f"""SELECT f.path, f.licenses, coalesce(s.mapped, CAST([] AS VARCHAR[])) AS mapped_licenses,
      {_path_type.replace('path', 'f.path')} AS file_type
    FROM files f LEFT JOIN mapped_sets s ON s.path = f.path WHERE f.kind = 'Conclusion'""",
)
_TAGGED = (
    "tagged",
    """SELECT *, list_sort(list_filter([
        CASE WHEN len(mapped_licenses) = 1 THEN 'SINGLE_MAPPED_LICENSE'
             WHEN len(mapped_licenses) > 1 THEN 'MULTIPLE_MAPPED_LICENSE' END,
        'LRW', CASE WHEN list_contains(licenses, 'MIT') THEN 'NO_LRW' END], lambda x: x IS NOT NULL)) AS tags
    FROM conclusions""",
)
CONCLUSIONS = (RAW, TYPED, FILES, *MAPPING_PARTS, _PLACED, _MAPPED_SETS, _CONCLUSIONS, _TAGGED)
sql(
    "license_map",
    f"""SELECT path, {joined('mapped_licenses')} AS mapped_licenses,
      list_contains(mapped_licenses, 'MULTI_LICENSE') AS is_dual FROM conclusions""",
    *CONCLUSIONS,
)
sql(
    "license_map_faithful",
    f"""SELECT f.path, {joined('coalesce(s.mapped, f.licenses)')} AS mapped_licenses
    FROM files f LEFT JOIN (
      SELECT path, list_sort(list_distinct(flatten(list(new)))) AS mapped
      FROM (SELECT *, bool_or(list_contains(new, 'NO_MAPPED_LICENSE')) OVER (PARTITION BY path ORDER BY pos) AS cut
            FROM placed)
      WHERE NOT cut GROUP BY path) s ON s.path = f.path
    WHERE f.kind = 'Conclusion'""",
    *CONCLUSIONS,
)
sql(
    "name_clean",
    f"""SELECT name, {clean('name')} AS cleaned, {clean('name', True)} AS cleaned_faithful,
      regexp_replace(translate(name, '-.', '__'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS safe_name,
      CASE WHEN starts_with({clean('name')}, 'HPND-') THEN 'HPND' ELSE {clean('name')} END AS family, count(*) AS n
    FROM (SELECT unnest(licenses) AS name FROM raw) GROUP BY name""",
    RAW,
)
sql("tags_derive", f"SELECT path, {joined('tags')} AS tags FROM tagged", *CONCLUSIONS)
sql(
    "tag_filters",
    """SELECT len(mapped_licenses) = 1 AND list_contains(licenses, 'MIT') AS all_of,
      NOT list_contains(licenses, 'MIT') AS none_of, len(mapped_licenses) > 1 AS has,
      list_contains(mapped_licenses, 'MIT') AS has_mit,
      len(list_filter(mapped_licenses, lambda x: starts_with(x, 'HPND'))) > 0 AS has_hpnd, count(*) AS n
    FROM tagged GROUP BY ALL""",
    *CONCLUSIONS,
)
sql(
    "tag_removed",
    f"""SELECT path, {joined("list_filter(tags, lambda x: x <> 'LRW')")} AS tags FROM tagged""",
    *CONCLUSIONS,
)

# ------------------------------------------------------------------ analysis


def analysis_cte(name, where="true"):
    keys = f"""SELECT 'doc_count' AS metric, 'all' AS key FROM tagged WHERE {where}
    UNION ALL SELECT 'file_types', file_type FROM tagged WHERE {where}
    UNION ALL SELECT 'mapped_single_license', unnest(mapped_licenses) FROM tagged WHERE len(mapped_licenses) = 1 AND {where}
    UNION ALL SELECT 'mapped_multiple_license', unnest(mapped_licenses) FROM tagged WHERE len(mapped_licenses) > 1 AND {where}
    UNION ALL SELECT 'single_license', unnest(licenses) FROM tagged WHERE len(licenses) = 1 AND {where}
    UNION ALL SELECT 'multiple_license', unnest(licenses) FROM tagged WHERE len(licenses) > 1 AND {where}
    UNION ALL SELECT 'tags', unnest(tags) FROM tagged WHERE {where}"""
    return name, f"SELECT metric, key, count(*) AS n FROM ({keys}) GROUP BY metric, key"


ANALYSIS = (*CONCLUSIONS, analysis_cte("analysis"))
_all = "SELECT metric, key, n FROM analysis"
_mapped = "metric IN ('mapped_single_license', 'mapped_multiple_license')"
sql("analysis_all", _all, *ANALYSIS)
sql("analysis_merged", _all, *ANALYSIS)
sql("analysis_file_types", "SELECT key, n FROM analysis WHERE metric = 'file_types'", *ANALYSIS)
sql("analysis_single", f"{_all} WHERE metric IN ('mapped_single_license', 'single_license')", *ANALYSIS)
sql("analysis_multi", f"{_all} WHERE metric IN ('mapped_multiple_license', 'multiple_license')", *ANALYSIS)
sql("analysis_tags", "SELECT key, n FROM analysis WHERE metric = 'tags'", *ANALYSIS)
_pct = "n / (SELECT n FROM analysis WHERE metric = 'doc_count') * 100"
sql("analysis_pct", f"SELECT metric, key, n, round({_pct}, 6) AS pct FROM analysis", *ANALYSIS)
sql(
    "analysis_report",
    f"""SELECT metric, key, concat(key, ' : ', n) AS count_line,
      printf('%s : %.2f%%', key, {_pct}) AS percent_line
    FROM analysis WHERE metric <> 'doc_count'""",
    *ANALYSIS,
)
sql("analysis_where", _all, *CONCLUSIONS, analysis_cte("analysis", "list_contains(mapped_licenses, 'ISC')"))
sql("min_samples_licenses", f"SELECT DISTINCT key AS license FROM analysis WHERE {_mapped} AND n >= 100", *ANALYSIS)
sql(
    "top_licenses",
    f"""SELECT DISTINCT key AS license FROM (
      SELECT key, row_number() OVER (PARTITION BY metric ORDER BY n DESC, key) AS place
      FROM analysis WHERE {_mapped}) WHERE place <= 5""",
    *ANALYSIS,
)
sql(
    "unique_licenses",
    """SELECT DISTINCT unnest(licenses) AS license, false AS mapped FROM tagged
    UNION ALL SELECT DISTINCT unnest(mapped_licenses), true FROM tagged""",
    *CONCLUSIONS,
)
sql(
    "combined_counts",
    f"SELECT key AS license, CAST(sum(n) AS BIGINT) AS n FROM analysis WHERE {_mapped} GROUP BY key",
    *ANALYSIS,
)

# ------------------------------------------------------- segments of programs

CODE = ("code_files", inputs.code_files_sql(DUCKDB))
sql(
    "content_decode",
    "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_latin1 FROM documents",
)


def line_ctes(files="code_files"):
    """Numbered, stripped, non-blank lines with their language marks."""
    marks = ", ".join(
        "({})".format(
            ", ".join("NULL" if v is None else f"'{v}'" for v in (mime, line, start, middle, end)) + f", {str(single).lower()}"
        )
        for mime, (line, start, middle, end, single) in fv.LANGUAGE_MARKS.items()
    )
    return (
        ("marks", f"SELECT * FROM (VALUES {marks}) AS t(file_type, slc, s, m, e, single_quotes)"),
        (
            "all_lines",
            f"""SELECT path, file_type, line, {strip('x')} AS x
            FROM (SELECT path, file_type, unnest(regexp_split_to_array(content, '{_LINE_END}')) AS x,
                         generate_subscripts(regexp_split_to_array(content, '{_LINE_END}'), 1) AS line
                  FROM {files})""",
        ),
        (
            "code_lines",
            """SELECT l.*, m.slc, m.s, m.m, m.e, m.single_quotes,
              starts_with(x, slc) AS a, coalesce(starts_with(x, s), false) AS h,
              coalesce(ends_with(x, e), false) AS f, coalesce(length(x) >= length(s) + length(e), false) AS fits
            FROM all_lines l JOIN marks m USING (file_type) WHERE x <> ''""",
        ),
    )


def comment_ctes(files="code_files"):
    before = "OVER (PARTITION BY path {} ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        *line_ctes(files),
        (
            "steps",
            """SELECT *, f AND h AND NOT fits AND NOT a AS toggles,
              CASE WHEN f AND NOT (h AND NOT fits AND NOT a) THEN 0 WHEN h AND NOT f AND NOT a THEN 1 END AS const
            FROM code_lines""",
        ),
        (
            "runs",
            f"""SELECT *, last_value(const IGNORE NULLS) {before.format('')} AS last_const,
              count(const) {before.format('')} AS run FROM steps""",
        ),
        (
            "states",
            f"""SELECT *, (coalesce(last_const, 0) + coalesce(sum(CASE WHEN toggles THEN 1 ELSE 0 END)
                {before.format(', run')}, 0)) % 2 = 1 AS inside FROM runs""",
        ),
        (
            "emitted",
            f"""SELECT path, line,
              CASE WHEN NOT inside AND a THEN 'line' WHEN NOT inside AND h AND f AND fits THEN 'one'
                   WHEN NOT inside AND h THEN 'start' WHEN inside AND f THEN 'end'
                   WHEN inside AND NOT h AND (m IS NULL OR starts_with(x, m)) THEN 'inner' END AS what,
              CASE WHEN NOT inside AND a THEN {strip('split_part(x, slc, 2)')}
                   WHEN NOT inside AND h AND f AND fits THEN {strip('split_part(split_part(x, s, 2), e, 1)')}
                   WHEN NOT inside AND h THEN {strip('split_part(x, s, 2)')}
                   WHEN inside AND f THEN {strip('split_part(x, e, 1)')}
                   WHEN m IS NULL THEN x ELSE {strip('split_part(x, m, 2)')} END AS body
            FROM states""",
        ),
        (
            "blocks",
            """SELECT *, sum(CASE WHEN what = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS block
            FROM emitted WHERE what IN ('start', 'inner', 'end')""",
        ),
        (
            "comments",
            """SELECT path, CAST(line AS INT) AS start_line, CAST(line AS INT) AS end_line, body
            FROM emitted WHERE what IN ('line', 'one')
            UNION ALL
            SELECT path, CAST(min(line) AS INT), CAST(max(line) AS INT), string_agg(body, chr(10) ORDER BY line)
            FROM blocks GROUP BY path, block HAVING bool_or(what = 'end')""",
        ),
        (
            "islands",
            """SELECT *, sum(gap) OVER (PARTITION BY path ORDER BY start_line) AS island
            FROM (SELECT *, CASE WHEN start_line - lag(end_line) OVER (PARTITION BY path ORDER BY start_line) <= 1
                                 THEN 0 ELSE 1 END AS gap FROM comments)""",
        ),
        (
            "merged",
            """SELECT path, min(start_line) AS start_line, max(end_line) AS end_line,
              string_agg(body, chr(10) ORDER BY start_line) AS body FROM islands GROUP BY path, island""",
        ),
        (
            "strings",
            """SELECT path, CAST(line AS INT) AS line, quote, unnest(bodies) AS body,
              generate_subscripts(bodies, 1) AS no
            FROM (SELECT path, line, 0 AS quote, regexp_extract_all(x, '"(.*[^)]|)"', 1) AS bodies FROM code_lines
                  UNION ALL
                  SELECT path, line, 1, regexp_extract_all(x, '''(.*[^)]|)''', 1) FROM code_lines WHERE single_quotes)""",
        ),
        (
            "ordered",
            """SELECT *, row_number() OVER (PARTITION BY path ORDER BY end_line, rank, quote, no) - 1 AS place
            FROM (SELECT path, 'string' AS seg_type, line AS start_line, line AS end_line, body, 0 AS rank, quote, no FROM strings
                  UNION ALL SELECT path, 'comment', start_line, end_line, body, 1, 0, 0 FROM merged)""",
        ),
    )


sql(
    "line_numbers",
    "SELECT path, CAST(line AS INT) AS line, length(x) AS n_chars FROM all_lines WHERE x <> ''",
    CODE,
    *line_ctes(),
)
sql("string_literals", "SELECT path, line, body FROM strings", CODE, *comment_ctes())
sql("block_comments", "SELECT path, start_line, end_line, body FROM comments", CODE, *comment_ctes())
sql("collapsed_comments", "SELECT path, start_line, end_line, body FROM merged", CODE, *comment_ctes())
SEGMENTS_ALL = (
    """SELECT path, CAST(place AS INT) AS no, seg_type,
      CASE WHEN start_line <> end_line THEN concat(start_line, '~', end_line) ELSE CAST(end_line AS VARCHAR) END AS lines,
      start_line <> end_line AS is_multiline, body FROM ordered""",
    CODE,
    *comment_ctes(),
)
sql("segments_all", *SEGMENTS_ALL)
sql("chunked_segments", *SEGMENTS_ALL)

# ------------------------------------------------------------------- comments


def keyword_count(x):
    return "(" + " + ".join(f"CAST(contains(lower({x}), '{w}') AS INT)" for w in fv.COMMENT_KEYWORDS) + ")"


def kind_ctes(files="code_files"):
    return (
        *comment_ctes(files),
        (
            "line_islands",
            """SELECT *, sum(gap) OVER (PARTITION BY path ORDER BY start_line) AS island
            FROM (SELECT *, CASE WHEN start_line - lag(end_line) OVER (PARTITION BY path ORDER BY start_line) <= 1
                                 THEN 0 ELSE 1 END AS gap FROM comments WHERE start_line = end_line)""",
        ),
        (
            "kinds",
            f"""SELECT path, body, {keyword_count('body')} AS n_keywords,
              CAST(row_number() OVER (PARTITION BY path ORDER BY kind, start_line) - 1 AS INT) AS no
            FROM (SELECT path, 0 AS kind, start_line, body FROM comments WHERE end_line > start_line
                  UNION ALL
                  SELECT path, CASE WHEN count(*) > 1 THEN 1 ELSE 2 END, min(start_line),
                         string_agg(body, ' ' ORDER BY start_line)
                  FROM line_islands GROUP BY path, island)""",
        ),
        (
            "record_highs",
            """SELECT path, string_agg(concat(' ', body), '' ORDER BY no) AS comment
            FROM (SELECT *, max(n_keywords) OVER (PARTITION BY path ORDER BY no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM kinds)
            WHERE n_keywords > coalesce(best, 0) GROUP BY path""",
        ),
        (
            "best_comments",
            """SELECT path, coalesce(
                (SELECT arg_min(body, no) FROM kinds k WHERE k.path = f.path AND contains(lower(body), 'spdx-license-identifier')),
                (SELECT comment FROM record_highs r WHERE r.path = f.path), '') AS comment
            FROM """
            + files
            + " f",
        ),
    )


_code_only = ("code_only", "SELECT * FROM code_files WHERE file_type <> 'unknown filetype'")
sql("comment_kinds", "SELECT path, no, body, n_keywords FROM kinds", CODE, *kind_ctes())
sql(
    "record_high_comments",
    "SELECT f.path, coalesce(r.comment, '') AS comment FROM code_only f LEFT JOIN record_highs r USING (path)",
    CODE,
    _code_only,
    *kind_ctes(),
)
sql(
    "license_comment",
    "SELECT path, comment FROM best_comments",
    CODE,
    (
        "spdx_files",
        """SELECT path, file_type, CASE WHEN doc_id % 9 = 0
             THEN concat('// SPDX-License-Identifier: MIT', chr(10), content) ELSE content END AS content
        FROM code_files""",
    ),
    *kind_ctes("spdx_files"),
)

# --------------------------------------------------------------------- markup

_NODE = (
    "(?is)<!--.*?-->|<!doctype[^>]*>|<\\?.*?>|<script[^>]*>.*?</script\\s*>"
    "|<style[^>]*>.*?</style\\s*>|<[a-z/!][^>]*>|[^<]+|<"
)
_decoded = "x"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _decoded = f"replace({_decoded}, '{_name}', '{_char}')"
sql(
    "markup_segments",
    f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY is_comment, no) - 1 AS INT) AS no,
      CASE WHEN is_comment THEN 'comment' ELSE 'string' END AS seg_type, body
    FROM (SELECT page_id, false AS is_comment, no, body FROM nodes WHERE NOT is_comment AND body <> ''
          UNION ALL
          SELECT page_id, true, 0, string_agg(body, chr(10) ORDER BY no) FROM nodes WHERE is_comment GROUP BY page_id)""",
    (
        "raw_nodes",
        f"""SELECT page_id, unnest(regexp_extract_all(html, '{_NODE}')) AS x,
          generate_subscripts(regexp_extract_all(html, '{_NODE}'), 1) AS no FROM pages""",
    ),
    (
        "nodes",
        f"""SELECT page_id, no, starts_with(x, '<!--') AS is_comment,
          {strip(f'''CASE WHEN starts_with(x, '<!--') THEN x[5:-4]
               WHEN starts_with(lower(x), '<!doctype') THEN regexp_extract(x, '(?is)^<!doctype[[:space:]]*([^>]*)>', 1)
               WHEN starts_with(x, '<?') THEN x[3:-2]
               WHEN regexp_matches(lower(x), '^<(script|style)') AND regexp_matches(x, '(?is)</(script|style)[[:space:]]*>$')
               THEN regexp_extract(x, '(?s)^[^>]*>(.*)</[^<]*$', 1)
               WHEN regexp_matches(x, '(?i)^<[a-z/!]') THEN NULL
               ELSE {_decoded} END''')} AS body
        FROM raw_nodes""",
    ),
)
_head = "ltrim(content)"
sql(
    "file_type_rules",
    f"""SELECT path, CASE WHEN content = '' THEN 'unknown filetype'
       WHEN regexp_matches({_head}, '^<\\?xml') THEN 'text/xml'
       WHEN regexp_matches({_head}, '(?i)^(<!doctype html|<html)') THEN 'text/html'
       WHEN regexp_matches(path, '[.](c|java)$') THEN 'text/x-c' WHEN path LIKE '%.cpp' THEN 'text/x-c++'
       WHEN path LIKE '%.py' THEN 'text/x-python' WHEN path LIKE '%.sh' THEN 'text/x-shellscript'
       WHEN path LIKE '%.php' THEN 'text/x-php' ELSE 'unknown filetype' END AS file_type
    FROM (SELECT path, content FROM code_files UNION ALL SELECT concat('page/', page_id), html FROM pages)""",
    CODE,
)

# ----------------------------------------------------------------------- words


def word_list(x):
    return f"list_transform(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{Nd}}]+'), lambda t: regexp_matches(t, '^(\\p{{L}}+|\\p{{Nd}}+)$')), lambda t: lower(t))"


LITERALS = (
    "literals",
    f"""SELECT path, string_agg(CASE WHEN hit THEN concat(body, chr(10)) ELSE '' END, '' ORDER BY place) AS related,
      string_agg(CASE WHEN hit THEN '' ELSE concat(body, chr(10)) END, '' ORDER BY place) AS unrelated,
      bool_or(hit) AS any_hit
    FROM (SELECT *, regexp_matches(body, '{_LRW}') AS hit FROM ordered) GROUP BY path""",
)
sql(
    "lrw_text",
    "SELECT f.path, coalesce(l.related, '') AS body FROM code_files f LEFT JOIN literals l USING (path)",
    CODE,
    *comment_ctes(),
    LITERALS,
)
sql(
    "no_lrw_text",
    "SELECT f.path, coalesce(l.unrelated, '') AS body FROM code_files f LEFT JOIN literals l USING (path)",
    CODE,
    *comment_ctes(),
    LITERALS,
)
WORDED = (
    "worded",
    f"""SELECT f.path, f.file_type, coalesce(l.any_hit, false) AS has_lrw_match,
      CASE WHEN len({word_list('l.related')}) > 0 THEN {word_list('l.related')}
           ELSE {word_list('f.content')} END AS license_words,
      {word_list('l.unrelated')} AS other_words
    FROM code_files f LEFT JOIN literals l USING (path)""",
)
sql(
    "process_words",
    f"SELECT path, {joined('license_words', ' ')} AS license_words, {joined('other_words', ' ')} AS other_words, has_lrw_match FROM worded",
    CODE,
    *comment_ctes(),
    LITERALS,
    WORDED,
)
sql(
    "process_words_comment",
    f"""SELECT path, CAST(len(license_words) AS INT) AS n_words, CAST(coalesce(len(other_words), -1) AS INT) AS n_other,
      {joined('license_words', ' ')} AS license_words,
      {joined('other_words', ' ')} AS other_words
    FROM (SELECT path, CASE WHEN len({word_list('related')}) > 0 THEN {word_list('related')}
                            ELSE {word_list('content')} END AS license_words,
            CASE WHEN n_literals > 0 THEN {word_list('unrelated')} END AS other_words
          FROM (SELECT path, any_value(content) AS content, count(body) AS n_literals,
                  coalesce(string_agg(CASE WHEN regexp_matches(body, '{_LRW}') THEN concat(body, chr(10)) END, '' ORDER BY no), '') AS related,
                  coalesce(string_agg(CASE WHEN NOT regexp_matches(body, '{_LRW}') THEN concat(body, chr(10)) END, '' ORDER BY no), '') AS unrelated
                FROM (SELECT f.path, f.content, 1 AS no, CASE WHEN b.comment <> '' THEN b.comment END AS body
                      FROM code_only f JOIN best_comments b USING (path)
                      UNION ALL
                      SELECT path, content, generate_subscripts(string_split(content, chr(10)), 1),
                             unnest(string_split(content, chr(10)))
                      FROM code_files WHERE file_type = 'unknown filetype')
                GROUP BY path))""",
    CODE,
    _code_only,
    *kind_ctes(),
)
_path = "concat(source, '/', doc_id)"
sql("word_tokens", f"SELECT {_path} AS path, {joined(word_list('text'), ' ')} AS words FROM documents")
_removed = quoted(sorted(set(STOP_WORDS) - fv.PROTECTED_WORDS))
sql(
    "stop_word_tokens",
    f"""SELECT path, {joined(f"list_filter(tokens, lambda t: t <> '' AND t NOT IN ({_removed}))", ' ')} AS words
    FROM (SELECT {_path} AS path, list_transform(regexp_extract_all(text,
      '[\\p{{L}}\\p{{Nd}}][\\p{{L}}\\p{{Nd}}._''/+\\-]*[\\p{{L}}\\p{{Nd}}]|[\\p{{L}}\\p{{Nd}}]|[^\\s\\x0b]'),
      lambda t: regexp_replace(lower(t), '[^0-9a-zA-Z.]', '', 'g')) AS tokens FROM documents)""",
)
_stems = [f"""stems0 AS MATERIALIZED (SELECT t AS token, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(regexp_extract_all(text,
      '[\\p{{L}}\\p{{Nd}}][\\p{{L}}\\p{{Nd}}._''/+\\-]*[\\p{{L}}\\p{{Nd}}]|[\\p{{L}}\\p{{Nd}}]|[^\\s\\x0b]'),
      lambda t: regexp_replace(lower(t), '[^0-9a-zA-Z.]', '', 'g')), lambda t: t <> '' AND t NOT IN ({_removed}))) AS t FROM documents) GROUP BY t)"""]
for _layer in stem_layers("token", ", 'g'"):
    _columns = ", ".join(f"{e} AS {n}" for n, e in _layer.items())
    _stems.append(f"stems{len(_stems)} AS MATERIALIZED (SELECT {_columns}, n FROM stems{len(_stems) - 1})")
ORACLES["stem_counts"] = f"WITH {', '.join(_stems)} SELECT stem, CAST(sum(n) AS BIGINT) AS n FROM stems{len(_stems) - 1} GROUP BY stem"
DOC_TOKENS = (
    "doc_tokens",
    f"""SELECT path, lang, doc_id, words, unnest(words) AS token, generate_subscripts(words, 1) AS pos
    FROM (SELECT {_path} AS path, lang, doc_id, {word_list('text')} AS words FROM documents)""",
)
LEMMAS = (
    "lemmas",
    f"""SELECT DISTINCT token, token[:-2] AS lemma FROM (SELECT unnest({word_list('text')}) AS token FROM benchmark)
    WHERE token LIKE '%s' AND length(token) > 3""",
)
sql(
    "lemma_tokens",
    f"""SELECT d.path, coalesce(w.words, '') AS words FROM (SELECT {_path} AS path FROM documents) d LEFT JOIN (
      SELECT t.path, string_agg(coalesce(l.lemma, t.token), ' ' ORDER BY t.pos) AS words
      FROM doc_tokens t LEFT JOIN lemmas l USING (token) GROUP BY t.path) w USING (path)""",
    DOC_TOKENS,
    LEMMAS,
)
sql(
    "missing_content",
    f"SELECT {_path} AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
DOC_LICENSES = ("doc_licenses", inputs.doc_licenses_sql(DUCKDB))
sql(
    "update_files",
    f"""SELECT w.path, w.file_type, {joined('m.mapped')} AS mapped_licenses,
      {joined('''list_sort(list_filter([CASE WHEN len(m.mapped) = 1 THEN 'SINGLE_MAPPED_LICENSE'
          WHEN len(m.mapped) > 1 THEN 'MULTIPLE_MAPPED_LICENSE' END,
          CASE WHEN len(w.license_words) > 0 THEN 'LRW' END,
          CASE WHEN len(w.other_words) > 0 THEN 'NO_LRW' END], lambda x: x IS NOT NULL))''')} AS tags,
      coalesce(k.words, '') AS words, CAST(coalesce(len(w.other_words), -1) AS INT) AS n_other
    FROM worded w JOIN code_files c USING (path)
    JOIN (SELECT doc_id, list_sort(list_distinct(flatten(list(CASE WHEN list_contains(new, 'NO_MAPPED_LICENSE') THEN [] ELSE new END)))) AS mapped
          FROM (SELECT p.doc_id, CASE WHEN len(m.new) > 0 THEN m.new ELSE [p.license] END AS new
                FROM (SELECT doc_id, unnest(licenses) AS license FROM doc_licenses) p
                LEFT JOIN mapping m ON m.old = p.license) GROUP BY doc_id) m USING (doc_id)
    LEFT JOIN (SELECT t.path, string_agg(coalesce(l.lemma, t.token), ' ' ORDER BY t.pos) AS words
          FROM (SELECT path, unnest(license_words) AS token, generate_subscripts(license_words, 1) AS pos FROM worded) t
          LEFT JOIN lemmas l USING (token) GROUP BY t.path) k ON k.path = w.path""",
    CODE,
    *comment_ctes(),
    LITERALS,
    WORDED,
    DOC_LICENSES,
    LEMMAS,
    *MAPPING_PARTS,
)

# -------------------------------------------------------------------- features

DOC_TERMS = (
    "doc_terms",
    """SELECT path, term, count(*) AS tf FROM (
      SELECT path, token AS term FROM doc_tokens
      UNION ALL SELECT path, concat(token, ' ', words[pos + 1]) FROM doc_tokens WHERE pos + 1 <= len(words)
      UNION ALL SELECT path, concat(token, ' ', words[pos + 1], ' ', words[pos + 2]) FROM doc_tokens WHERE pos + 2 <= len(words))
    GROUP BY path, term""",
)
STATS = ("stats", "SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM doc_terms GROUP BY term")
VOCAB = (
    "vocab",
    """SELECT term, tf, df, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0 AS idf
    FROM stats ORDER BY tf DESC, term LIMIT 10000""",
)
WEIGHTS = (
    "tfidf",
    """SELECT path, term, w / sqrt(sum(w * w) OVER (PARTITION BY path)) AS weight
    FROM (SELECT t.path, t.term, (ln(t.tf) + 1.0::DOUBLE) * v.idf AS w FROM doc_terms t JOIN vocab v USING (term))""",
)
sql(
    "ngram_counts",
    "SELECT tf, df, count(*) AS n_terms, min(term) AS first_term FROM stats GROUP BY tf, df",
    DOC_TOKENS,
    DOC_TERMS,
    STATS,
)
sql("vocabulary_top", "SELECT term, tf, df, round(idf, 6) AS idf FROM vocab", DOC_TOKENS, DOC_TERMS, STATS, VOCAB)
sql(
    "tfidf_weights",
    "SELECT path, term, round(weight, 6) AS weight FROM tfidf",
    DOC_TOKENS,
    DOC_TERMS,
    STATS,
    VOCAB,
    WEIGHTS,
)

# -------------------------------------------------------------------- sampling

HELD = (
    "held",
    """SELECT DISTINCT path FROM (
      SELECT path, row_number() OVER (PARTITION BY license ORDER BY path) AS place,
             count(*) OVER (PARTITION BY license) AS n
      FROM (SELECT path, unnest(mapped_licenses) AS license FROM tagged))
    WHERE n >= 10 AND place <= ceil(n * 0.1::DOUBLE)""",
)
sql(
    "holdout_tag",
    f"""SELECT t.path, {joined("list_sort(CASE WHEN h.path IS NOT NULL THEN list_append(tags, 'TEST') ELSE tags END)")} AS tags
    FROM tagged t LEFT JOIN held h ON h.path = t.path""",
    *CONCLUSIONS,
    HELD,
)
sql(
    "cap_per_license",
    """SELECT license, path FROM (
      SELECT license, path, row_number() OVER (PARTITION BY license ORDER BY path) AS place
      FROM (SELECT path, unnest(mapped_licenses) AS license FROM tagged)) WHERE place <= 200""",
    *CONCLUSIONS,
)
TRAINING = (
    "training",
    f"""SELECT *, len(labels) = 1 AS is_single, doc_id % 7 = 0 AS held,
      CASE WHEN doc_id % 4 = 0 THEN len(all_words) END AS n_other,
      CASE WHEN doc_id % 10 <> 3 THEN len(all_words) ELSE 0 END AS n_words
    FROM (SELECT doc_id, path, list_sort(licenses) AS labels, {word_list('text')} AS all_words FROM doc_licenses)""",
)
TRAINING_LICENSES = (
    "training_licenses",
    "SELECT license FROM (SELECT unnest(labels) AS license FROM training) GROUP BY license HAVING count(*) >= 10",
)


def samples_cte(name, condition):
    return name, f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY license) AS kept
      FROM (SELECT *, row_number() OVER (PARTITION BY license ORDER BY path) AS place
            FROM (SELECT path, labels, n_words, unnest(labels) AS license FROM training WHERE {condition} AND NOT held)
            WHERE license IN (SELECT license FROM training_licenses))
      WHERE place <= 200 AND n_words > 0) WHERE kept >= 10"""


SAMPLES = (
    DOC_LICENSES,
    TRAINING,
    TRAINING_LICENSES,
    samples_cte("sp", "is_single"),
    samples_cte("mp", "NOT is_single"),
)
_row = "SELECT license, path, CAST(n_words AS INT) AS n_words, {} AS labels FROM {}"
sql("sample_single", _row.format(joined("labels"), "sp"), *SAMPLES)
sql("sample_multi", _row.format(joined("labels"), "mp"), *SAMPLES)
sql(
    "generalize_family",
    _row.format(
        joined("list_transform(labels, lambda x: CASE WHEN starts_with(x, 'HPND-') THEN 'HPND' ELSE x END)"),
        "mp",
    ),
    *SAMPLES,
)
_none = """SELECT path, CAST(n_other AS INT) AS n_words, 'no license' AS label
  FROM (SELECT * FROM training WHERE n_other > 0 AND NOT held ORDER BY path LIMIT {})"""
sql("sample_no_license", _none.format(200), *SAMPLES)
sql(
    "sample_routing",
    f"""SELECT path, CAST(n_words AS INT) AS n_words, label FROM (
      SELECT path, n_words, 'single' AS label, row_number() OVER (ORDER BY md5(path), license, path) AS place FROM sp
      UNION ALL SELECT path, n_words, 'multi', row_number() OVER (ORDER BY md5(path), license, path) FROM mp
      UNION ALL SELECT path, n_other, 'no license', row_number() OVER (ORDER BY path) FROM training WHERE n_other > 0 AND NOT held)
    WHERE place <= least((SELECT count(*) FROM sp), (SELECT count(*) FROM mp)) // 3""",
    *SAMPLES,
)
sql(
    "sample_family",
    f"""SELECT path, CAST(n_words AS INT) AS n_words, {joined('variants')} AS labels
    FROM (SELECT path, n_words, list_filter(labels, lambda x: starts_with(x, 'HPND')) AS variants
          FROM training WHERE NOT held AND len(list_filter(labels, lambda x: starts_with(x, 'HPND'))) > 0
          ORDER BY path LIMIT 200) WHERE n_words > 0""",
    *SAMPLES,
)

# ---------------------------------------------------------------------- models

_classes = ["CC-BY-NC-4.0", "HPND-fair", "HPND-harsh", "MIT", "Text-EN"]
sql(
    "label_indicator",
    "SELECT path, concat("
    + ", ".join(f"CAST(list_contains(licenses, '{c}') AS INT)" for c in _classes)
    + f") AS flags, {joined(f'list_filter([{quoted(_classes)}], lambda x: list_contains(licenses, x))')} AS labels FROM doc_licenses",
    DOC_LICENSES,
)
sql(
    "label_index",
    "SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS ix, count(*) AS n FROM documents GROUP BY lang",
)
NB = (
    DOC_TOKENS,
    ("nb_counts", "SELECT lang AS label, token AS term, count(*) AS n FROM doc_tokens GROUP BY lang, token"),
    ("nb_totals", "SELECT label, sum(n) AS total FROM nb_counts GROUP BY label"),
    ("nb_terms", "SELECT DISTINCT term FROM nb_counts"),
    (
        "nb_weights",
        """SELECT t.label, v.term,
          ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (t.total::DOUBLE + (SELECT count(*) FROM nb_terms))) AS w
        FROM nb_totals t CROSS JOIN nb_terms v LEFT JOIN nb_counts c ON c.label = t.label AND c.term = v.term""",
    ),
)
sql(
    "naive_bayes_weights",
    """SELECT c.label, c.term, round(ln((c.n + 1.0::DOUBLE) / (t.total::DOUBLE + (SELECT count(*) FROM nb_terms))), 6) AS w,
      round(ln(1.0::DOUBLE / (t.total::DOUBLE + (SELECT count(*) FROM nb_terms))), 6) AS d
    FROM nb_counts c JOIN nb_totals t USING (label)""",
    *NB[:4],
)
sql(
    "naive_bayes_predict",
    """SELECT path, arg_min(label, {'s': -score, 'l': label}) AS label FROM (
      SELECT s.path, s.label, any_value(s.dot) + any_value(p.b) AS score
      FROM (SELECT d.path, w.label, sum(w.w) AS dot FROM doc_tokens d JOIN nb_weights w ON w.term = d.token GROUP BY ALL) s
      JOIN (SELECT lang AS label, ln(count(*) / (SELECT count(*) FROM documents)) AS b FROM documents GROUP BY lang) p
        ON p.label = s.label GROUP BY s.path, s.label) GROUP BY path""",
    *NB,
)
sql(
    "held_out_report",
    """SELECT label, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
      round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, CAST(tp + fn AS BIGINT) AS support
    FROM (SELECT l.label, count(*) FILTER (t.lang = l.label AND g.label = l.label) AS tp,
            count(*) FILTER (t.lang <> l.label AND g.label = l.label) AS fp,
            count(*) FILTER (t.lang = l.label AND g.label IS DISTINCT FROM l.label) AS fn
          FROM truth t LEFT JOIN guesses g USING (path)
          CROSS JOIN (SELECT lang AS label FROM truth UNION SELECT label FROM guesses) l GROUP BY l.label)""",
    DOC_TOKENS,
    ("truth", f"SELECT {_path} AS path, lang FROM documents WHERE doc_id % 10 = 0"),
    ("seen", "SELECT lang AS label, token AS term, count(*) AS n FROM doc_tokens WHERE doc_id % 10 <> 0 GROUP BY ALL"),
    (
        "fitted",
        """SELECT t.label, v.term, ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (t.total::DOUBLE + (SELECT count(DISTINCT term) FROM seen))) AS w
        FROM (SELECT label, sum(n) AS total FROM seen GROUP BY label) t CROSS JOIN (SELECT DISTINCT term FROM seen) v
        LEFT JOIN seen c ON c.label = t.label AND c.term = v.term""",
    ),
    (
        "guesses",
        """SELECT path, arg_min(label, {'s': -score, 'l': label}) AS label FROM (
          SELECT d.path, p.label, p.b + coalesce(sum(f.w), 0) AS score
          FROM (SELECT DISTINCT path FROM doc_tokens WHERE doc_id % 10 = 0) d
          CROSS JOIN (SELECT lang AS label, ln(count(*) / (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0)) AS b
                      FROM documents WHERE doc_id % 10 <> 0 GROUP BY lang) p
          LEFT JOIN doc_tokens t ON t.path = d.path LEFT JOIN fitted f ON f.term = t.token AND f.label = p.label
          GROUP BY d.path, p.label, p.b) GROUP BY path""",
    ),
)
sql(
    "linear_score",
    """SELECT x.path, b.label, round(any_value(b.b) + sum(coalesce(w.w, 0) * x.weight), 6) AS score
    FROM tfidf x CROSS JOIN (SELECT lang AS label, -count(*) / 100000.0::DOUBLE AS b FROM documents GROUP BY lang) b
    LEFT JOIN (SELECT label, term, n / sum(n) OVER (PARTITION BY term) AS w FROM (
        SELECT d.lang AS label, t.term, sum(t.tf) AS n FROM doc_terms t JOIN vocab USING (term)
        JOIN (SELECT DISTINCT path, lang FROM doc_tokens) d USING (path) GROUP BY ALL)) w
      ON w.label = b.label AND w.term = x.term
    GROUP BY x.path, b.label""",
    DOC_TOKENS,
    DOC_TERMS,
    STATS,
    VOCAB,
    WEIGHTS,
)
sql(
    "svm_certificate",
    """SELECT l.label, round(l.loss + 0.01 / 2 * s.squares, 6) AS objective, round(s.subgradient, 6) AS subgradient, l.n_violated, l.n_free
    FROM losses l JOIN (
      SELECT label, sum(w * w) AS squares, max(greatest(0, 0.01 * w - (fixed + most) / n, (fixed + least) / n - 0.01 * w)) AS subgradient
      FROM (SELECT coalesce(p.label, w.label) AS label, coalesce(w.w, 0) AS w, coalesce(p.fixed, 0) AS fixed,
              coalesce(p.least, 0) AS least, coalesce(p.most, 0) AS most, (SELECT count(*) FROM documents) AS n
            FROM pulls p FULL JOIN shares w ON w.label = p.label AND w.term = p.term) GROUP BY label) s USING (label)""",
    DOC_TOKENS,
    DOC_TERMS,
    STATS,
    VOCAB,
    WEIGHTS,
    (
        "shares",
        """SELECT label, term, n / sum(n) OVER (PARTITION BY term) AS w FROM (
        SELECT d.lang AS label, t.term, sum(t.tf) AS n FROM doc_terms t JOIN vocab USING (term)
        JOIN (SELECT DISTINCT path, lang FROM doc_tokens) d USING (path) GROUP BY ALL)""",
    ),
    (
        "margins",
        f"""SELECT d.path, b.label, CASE WHEN d.lang = b.label THEN 1 ELSE -1 END AS y,
          (CASE WHEN d.lang = b.label THEN 1 ELSE -1 END) * (b.b + coalesce(s.dot, 0)) AS m
        FROM (SELECT {_path} AS path, lang FROM documents) d
        CROSS JOIN (SELECT lang AS label, -count(*) / 100000.0::DOUBLE AS b FROM documents GROUP BY lang) b
        LEFT JOIN (SELECT x.path, w.label, sum(w.w * x.weight) AS dot FROM tfidf x JOIN shares w USING (term) GROUP BY ALL) s
          ON s.path = d.path AND s.label = b.label""",
    ),
    (
        "losses",
        """SELECT label, avg(greatest(0, 1 - m)) AS loss, count(*) FILTER (m < 1 AND abs(m - 1) > 0.05) AS n_violated,
          count(*) FILTER (abs(m - 1) <= 0.05) AS n_free FROM margins GROUP BY label""",
    ),
    (
        "pulls",
        """SELECT m.label, e.term, sum(CASE WHEN abs(m - 1) > 0.05 THEN y * x ELSE 0 END) AS fixed,
          sum(CASE WHEN abs(m - 1) <= 0.05 THEN least(y * x, 0) ELSE 0 END) AS least,
          sum(CASE WHEN abs(m - 1) <= 0.05 THEN greatest(y * x, 0) ELSE 0 END) AS most
        FROM (SELECT path, term, weight AS x FROM tfidf UNION ALL SELECT path, NULL, 1.0::DOUBLE FROM margins GROUP BY path) e
        JOIN margins m ON m.path = e.path AND (m.m < 1 OR abs(m.m - 1) <= 0.05) GROUP BY ALL""",
    ),
)
sql(
    "chain_decide",
    f"""SELECT path, {joined("flags")} AS labels FROM (SELECT path, list('L' || k ORDER BY k) FILTER (found) AS flags FROM chain GROUP BY path)""",
    DOC_TOKENS,
    (
        "margins",
        """SELECT path, k, (k * 4 - 9) + sum(CASE WHEN length(token) <= 4 THEN (length(token) * (k + 3) + ascii(token)) % 7 - 3 ELSE 0 END) AS m
        FROM doc_tokens CROSS JOIN (SELECT unnest(range(6)) AS k) GROUP BY path, k""",
    ),
    (
        "places",
        """SELECT path, list(m ORDER BY k) AS ms FROM margins GROUP BY path""",
    ),
    (
        "steps",
        """SELECT path, ms, 0 AS k, CAST([] AS BIGINT[]) AS found FROM places""",
    ),
    *[
        (
            f"steps{k + 1}",
            f"""SELECT path, ms, CASE WHEN ms[{k + 1}] + coalesce(list_sum(list_transform(found, lambda j: (({k} * 5 + j * 3) % 7 - 3) * 8)), 0) > 0
              THEN list_append(found, {k}) ELSE found END AS found FROM steps{k or ''}""",
        )
        for k in range(6)
    ],
    ("chain", "SELECT path, k, list_contains(found, k) AS found FROM steps6 CROSS JOIN (SELECT unnest(range(6)) AS k)"),
)
sql(
    "route_predict",
    f"""SELECT path, CASE WHEN doc_id % 17 = 0 THEN 'unclassified license'
        WHEN doc_id % 6 = 0 THEN 'no license'
        WHEN len(licenses) = 1 THEN licenses[1]
        WHEN len(few) > 0 THEN {joined('few')} ELSE 'unclassified license' END AS licenses
    FROM (SELECT *, list_filter(licenses, lambda x: NOT starts_with(x, 'Text-')) AS few FROM doc_licenses)""",
    DOC_LICENSES,
)
sql(
    "family_refine",
    f"""SELECT path, {joined('''flatten(list_transform(general, lambda x: CASE WHEN x = 'HPND' AND doc_id % 5 <> 0 THEN finer ELSE [x] END))''')} AS licenses
    FROM (SELECT path, doc_id, list_filter(licenses, lambda x: starts_with(x, 'HPND')) AS finer,
            list_filter(list_transform(licenses, lambda x, i: CASE WHEN starts_with(x, 'HPND-')
              THEN CASE WHEN len(list_filter(licenses[:i - 1], lambda y: starts_with(y, 'HPND-'))) = 0 THEN 'HPND' END
              ELSE x END), lambda x: x IS NOT NULL) AS general
          FROM doc_licenses)""",
    DOC_LICENSES,
)

# ------------------------------------------------------------------ evaluation

COMPARED = (
    DOC_LICENSES,
    ("guessed", inputs.guessed_labels_sql(DUCKDB)),
    ("actual_labels", "SELECT path, unnest(licenses) AS label FROM doc_licenses"),
    ("guess_labels", "SELECT path, unnest(labels) AS label FROM guessed"),
    (
        "pairs",
        """SELECT path, label, CAST(max(t) AS INT) AS t, CAST(max(p) AS INT) AS p FROM (
          SELECT path, label, 1 AS t, 0 AS p FROM actual_labels UNION ALL SELECT path, label, 0, 1 FROM guess_labels)
        GROUP BY path, label""",
    ),
    (
        "per_label",
        """SELECT label, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM pairs GROUP BY label""",
    ),
    (
        "rated",
        """SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p,
          CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r,
          CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f, tp + fn AS support FROM per_label""",
    ),
    (
        "per_doc",
        """SELECT d.path, coalesce(sum(t * p), 0) AS tp, coalesce(sum((1 - t) * p), 0) AS fp, coalesce(sum(t * (1 - p)), 0) AS fn
        FROM doc_licenses d LEFT JOIN pairs USING (path) GROUP BY d.path""",
    ),
)
sql(
    "subset_accuracy",
    "SELECT round(avg(CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_docs FROM per_doc",
    *COMPARED,
)
sql(
    "class_report",
    """SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM rated""",
    *COMPARED,
)
sql(
    "report_averages",
    """SELECT average, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM (
      SELECT 'micro' AS average, sum(tp) / sum(tp + fp) AS precision, sum(tp) / sum(tp + fn) AS recall,
        2 * sum(tp) / sum(2 * tp + fp + fn) AS f1, sum(support) AS support FROM rated
      UNION ALL SELECT 'macro', avg(p), avg(r), avg(f), sum(support) FROM rated
      UNION ALL SELECT 'weighted', sum(p * support) / sum(support), sum(r * support) / sum(support),
        sum(f * support) / sum(support), sum(support) FROM rated
      UNION ALL SELECT 'samples', avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END),
        avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END),
        avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), sum(tp + fn) FROM per_doc)""",
    *COMPARED,
)
sql(
    "hamming_loss",
    """SELECT round(sum(fp + fn) / (count(*) * (SELECT count(*) FROM per_label)), 6) AS hamming_loss FROM per_doc""",
    *COMPARED,
)
_safe = "regexp_replace(translate({}, '-.', '__'), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
TEXTS = (
    "texts",
    """SELECT licenses[1] AS license, arg_min(text, path) AS text FROM files
    WHERE kind = 'License' AND len(licenses) = 1 AND text <> '' GROUP BY licenses[1]""",
)
MAPPED_TEXTS = (
    "mapped_texts",
    """SELECT mapped[1] AS license, arg_min(text, path) AS text FROM (
      SELECT path, any_value(text) AS text,
        list_sort(list_distinct(flatten(list(CASE WHEN list_contains(new, 'NO_MAPPED_LICENSE') THEN [] ELSE new END)))) AS mapped
      FROM (SELECT c.path, c.text, CASE WHEN len(m.new) > 0 THEN m.new ELSE [c.license] END AS new
            FROM (SELECT path, text, unnest(licenses) AS license FROM files WHERE kind = 'License') c
            LEFT JOIN mapping m ON m.old = c.license) GROUP BY path)
    WHERE len(mapped) = 1 AND text <> '' GROUP BY mapped[1]""",
)
sql(
    "license_text_lookup",
    f"""SELECT n.license, coalesce(t.text, 'License by licspark') AS text
    FROM (SELECT DISTINCT unnest(licenses) AS license FROM files UNION ALL SELECT DISTINCT p_brand FROM part) n
    LEFT JOIN texts t ON {_safe.format('n.license')} = {_safe.format('t.license')}""",
    RAW,
    TYPED,
    FILES,
    TEXTS,
)
sql(
    "known_license_texts",
    """SELECT license, text FROM mapped_texts
    WHERE license IN (SELECT unnest(mapped_licenses) FROM conclusions)""",
    *CONCLUSIONS,
    MAPPED_TEXTS,
)
sql(
    "predictions_json",
    """SELECT CAST(json_object('filename', path, 'licenses', labels) AS VARCHAR) AS value FROM guessed""",
    ("guessed", inputs.guessed_labels_sql(DUCKDB)),
)
