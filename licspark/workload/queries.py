"""Registered queries: the library's operators over whole tables.

Arrays leave as ``|``-joined strings, so that results compare by value.
"""

from pyspark.sql import Column, DataFrame, functions as F

from licspark import fixed_values as fv
from licspark.functions import comments as cm
from licspark.functions import filetypes, names, ngrams, segments, text, tokens, words
from licspark.functions.porter import add_stem
from licspark.operators import (
    analysis,
    chunked,
    convert,
    evaluation,
    features,
    holdout,
    mapping,
    models,
    sampling,
    scoring,
    tags,
)
from licspark.operators import words as word_ops
from licspark.operators.term_counts import all_terms
from licspark.plans import predict, train, update
from licspark.session import durable, new_table_path
from licspark.sources import files as file_source
from licspark.sources import findings as finding_source
from licspark.sources import findings_table, store
from licspark.streaming import jobs
from licspark.workload import inputs

SAMPLE_CAP = 200
#: Iterations of the fits of the scans; see the README. `chain_labels` runs all 50.
CHAIN_ITERATIONS = 5
MIN_SAMPLES = 100
#: Small enough that the findings table splits its buckets between the batches of these queries.
BUCKET_BYTES = 64 << 10
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def joined(array: Column | str, by: str = "|") -> Column:
    return F.array_join(array, by)


def rounded(value: Column | str) -> Column:
    return F.round(value, 6)


def _statements(df: DataFrame) -> DataFrame:
    """Lines of license-related text with the license they state."""
    lines = df.select("source", "doc_id", F.explode(F.split("text", text.LINE_END)).alias("line")).where(
        F.col("line").rlike(fv.LRW_PATTERN)
    )
    license = F.coalesce(*[F.when(F.contains("line", F.lit(s)), n) for n, s in inputs.STATEMENTS.items()])
    return lines.withColumn("license", license)


@query
def license_statements_by_source(spark, sf_dir):
    """License statements per source, most frequent first."""
    found = _statements(inputs.spread(inputs.table(spark, sf_dir, "documents")))
    counts = found.groupBy("source", "license").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "source", "license")


# ------------------------------------------------------------------ findings


def _files(spark, sf_dir):
    return convert.convert_findings(inputs.raw_findings(spark, sf_dir))


def _file_rows(files):
    return files.select(
        "kind",
        "path",
        joined("licenses").alias("licenses"),
        F.col("remove").cast("string").alias("remove"),
        F.col("indirect").cast("string").alias("indirect"),
        "text",
    )


@query
def findings_dedupe(spark, sf_dir):
    return _file_rows(_files(spark, sf_dir))


@query
def findings_registry_join(spark, sf_dir):
    registry = convert.source_registry(spark, [("unknown_tool", "ToolFinding", None, None)])
    return convert.kind_counts(convert.convert_findings(inputs.raw_findings(spark, sf_dir), registry))


@query
def findings_quarantine(spark, sf_dir):
    bad = convert.quarantine(inputs.raw_findings(spark, sf_dir))
    return bad.select("path", "source", "problem")


@query
def raw_findings_damaged(spark, sf_dir):
    """Findings as JSON lines, every 13th cut off, read back: sound findings and the quarantined lines."""
    raw = inputs.raw_findings(spark, sf_dir)
    cut = F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"path":"'), "path")
    path = new_table_path(spark, "lines")
    raw.select(F.when(F.col("seq") % 13 == 0, cut).otherwise(F.to_json(F.struct(*raw.columns))).alias("value")).write.text(path)
    checked = finding_source.read_checked_findings(spark, path)
    sound = finding_source.sound_findings(checked).select("path", "source", F.lit(None).cast("string").alias("problem"), F.concat_ws("|", F.col("seq").cast("string"), "licenses", "text").alias("line"))
    bad = finding_source.damaged_lines(checked).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("source"), "problem", "line")
    return sound.unionByName(bad)


@query
def csv_dump_findings(spark, sf_dir):
    rows = finding_source.parse_dump_lines(inputs.dump_lines(spark, sf_dir))
    found = finding_source.dump_findings(rows)
    return (
        found.select("path", "source", joined("licenses").alias("license"), "rejected")
        .groupBy("path", "source", "license")
        .agg(F.count("*").alias("n"), F.sum(F.col("rejected").cast("int")).alias("n_rejected"))
    )


@query
def kind_counts(spark, sf_dir):
    return convert.kind_counts(_files(spark, sf_dir))


@query
def incremental_upsert(spark, sf_dir):
    """A first load, then an increment, in the stored table."""
    raw = inputs.raw_findings(spark, sf_dir)
    is_old = F.col("seq") % 3 != 0
    path = new_table_path(spark, "upsert")
    findings_table.merge_into(path, raw.where(is_old), 0, bucket_bytes=BUCKET_BYTES)
    findings_table.merge_into(path, raw.where(~is_old), 1, bucket_bytes=BUCKET_BYTES)
    return _file_rows(findings_table.current_findings(spark, path))


# ------------------------------------------------------------------- mapping


def _mapping(spark, sf_dir):
    return mapping.license_mapping(inputs.mapping_lines(spark, sf_dir))


@query
def mapping_load(spark, sf_dir):
    return _mapping(spark, sf_dir).select("old", joined("new").alias("new"))


@query
def mapping_duplicates(spark, sf_dir):
    return mapping.duplicate_names(inputs.mapping_lines(spark, sf_dir))


@query
def mapping_template(spark, sf_dir):
    return mapping.mapping_template(_files(spark, sf_dir))


def _mapped_files(spark, sf_dir, faithful=False):
    files = _files(spark, sf_dir).where(F.col("kind") == "Conclusion")
    mapped = mapping.map_licenses(files, _mapping(spark, sf_dir), faithful)
    # Findings carry no text here, so the type comes from the path alone.
    return mapped.withColumn("file_type", filetypes.file_type(F.lit("x"), F.col("path"))).withColumn(
        "tags",
        tags.derived_tags(
            tags.no_tags(), F.col("mapped_licenses"), F.col("licenses"), F.filter("licenses", lambda x: x == "MIT")
        ),
    )


@query
def license_map(spark, sf_dir):
    mapped = _mapped_files(spark, sf_dir)
    return mapped.select(
        "path",
        joined("mapped_licenses").alias("mapped_licenses"),
        mapping.is_dual(F.col("mapped_licenses")).alias("is_dual"),
    )


@query
def license_map_faithful(spark, sf_dir):
    mapped = _mapped_files(spark, sf_dir, faithful=True)
    return mapped.select("path", joined("mapped_licenses").alias("mapped_licenses"))


@query
def name_clean(spark, sf_dir):
    raw = inputs.raw_findings(spark, sf_dir).select(F.explode("licenses").alias("name"))
    return raw.groupBy("name").agg(F.count("*").alias("n")).select(
        "name",
        names.clean_license(F.col("name")).alias("cleaned"),
        names.clean_license(F.col("name"), faithful=True).alias("cleaned_faithful"),
        names.safe_license_name(F.col("name")).alias("safe_name"),
        names.generalize_license(names.clean_license(F.col("name"))).alias("family"),
        "n",
    )


@query
def tags_derive(spark, sf_dir):
    return _mapped_files(spark, sf_dir).select("path", joined("tags").alias("tags"))


@query
def tag_filters(spark, sf_dir):
    files = _mapped_files(spark, sf_dir)
    col = F.col("tags")
    return files.groupBy(
        tags.has_tags(col, all_of=[fv.SINGLE_MAPPED_LICENSE, fv.NO_LRW]).alias("all_of"),
        tags.has_tags(col, none_of=[fv.NO_LRW, fv.TEST]).alias("none_of"),
        tags.has_tags(col, one=fv.MULTIPLE_MAPPED_LICENSE).alias("has"),
        F.array_contains("mapped_licenses", "MIT").alias("has_mit"),
        F.exists("mapped_licenses", lambda x: F.startswith(x, F.lit("HPND"))).alias("has_hpnd"),
    ).agg(F.count("*").alias("n"))


@query
def tag_removed(spark, sf_dir):
    files = tags.drop_tag_everywhere(_mapped_files(spark, sf_dir), fv.LRW)
    return files.select("path", joined("tags").alias("tags"))


# ------------------------------------------------------------------ analysis


def _analysis(spark, sf_dir):
    return analysis.analyze(_mapped_files(spark, sf_dir))


def _metric(spark, sf_dir, *metrics):
    return _analysis(spark, sf_dir).where(F.col("metric").isin(*metrics))


@query
def analysis_all(spark, sf_dir):
    return _analysis(spark, sf_dir)


@query
def analysis_file_types(spark, sf_dir):
    return analysis.sorted_counts(analysis.metric(_analysis(spark, sf_dir), analysis.FILE_TYPES))


@query
def analysis_single(spark, sf_dir):
    return _metric(spark, sf_dir, analysis.MAPPED_SINGLE, analysis.SINGLE)


@query
def analysis_multi(spark, sf_dir):
    return _metric(spark, sf_dir, analysis.MAPPED_MULTI, analysis.MULTI)


@query
def analysis_tags(spark, sf_dir):
    return analysis.metric(_analysis(spark, sf_dir), analysis.TAGS)


@query
def analysis_pct(spark, sf_dir):
    return analysis.percentages(_analysis(spark, sf_dir)).select("metric", "key", "n", rounded("pct").alias("pct"))


@query
def analysis_report(spark, sf_dir):
    return analysis.report_lines(_analysis(spark, sf_dir))


@query
def analysis_where(spark, sf_dir):
    only = F.array_contains("mapped_licenses", "ISC")
    return analysis.analyze(_mapped_files(spark, sf_dir), where=only)


@query
def analysis_merged(spark, sf_dir):
    files = _mapped_files(spark, sf_dir)
    first = F.startswith("path", F.lit("o1"))
    return analysis.merge_analyses(analysis.analyze(files, first), analysis.analyze(files, ~first))


@query
def min_samples_licenses(spark, sf_dir):
    return analysis.licenses_with_min_samples(_analysis(spark, sf_dir), MIN_SAMPLES)


@query
def top_licenses(spark, sf_dir):
    return analysis.top_licenses(_analysis(spark, sf_dir), 5)


@query
def unique_licenses(spark, sf_dir):
    counts = durable(_analysis(spark, sf_dir))
    raw = analysis.unique_licenses(counts, mapped=False).withColumn("mapped", F.lit(False))
    return raw.unionByName(analysis.unique_licenses(counts, mapped=True).withColumn("mapped", F.lit(True)))


@query
def combined_counts(spark, sf_dir):
    return analysis.combined_counts(_analysis(spark, sf_dir))


# ------------------------------------------------------- segments and words


@query
def file_type_rules(spark, sf_dir):
    code = inputs.code_files(spark, sf_dir).select("path", "content")
    pages = inputs.page_files(spark, sf_dir).select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), "content"
    )
    both = code.unionByName(pages)
    return both.select("path", filetypes.file_type(F.col("content"), F.col("path")).alias("file_type"))


@query
def content_decode(spark, sf_dir):
    """Latin-1 view of UTF-8 bytes: one character per byte."""
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.length(file_source.latin1_text(F.encode("text", "UTF-8"))).cast("long").alias("n_latin1")
    )


@query
def file_listing(spark, sf_dir):
    """The table files themselves, listed as binary files."""
    listed = file_source.read_files(spark, sf_dir, "*.parquet")
    return listed.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "n_bytes")


@query
def line_numbers(spark, sf_dir):
    files = inputs.code_files(spark, sf_dir)
    lines = files.select("path", F.inline(text.numbered_lines(F.col("content"))))
    return lines.select("path", "line", F.length("text").cast("long").alias("n_chars"))


def _typed_lines(files):
    marks = segments.language_marks(F.col("file_type"))
    return files.where(marks.isNotNull()).withColumn("marks", marks), text.stripped_lines(F.col("content"))


@query
def string_literals(spark, sf_dir):
    files, lines = _typed_lines(inputs.code_files(spark, sf_dir))
    found = files.select("path", F.inline(segments.string_literals(lines, F.col("marks"))))
    return found.select("path", "line", "body")


@query
def block_comments(spark, sf_dir):
    """Comments before neighbours are merged (block state across lines)."""
    files, lines = _typed_lines(inputs.code_files(spark, sf_dir))
    return files.select("path", F.inline(segments.raw_comments(lines, F.col("marks"))))


@query
def collapsed_comments(spark, sf_dir):
    files, lines = _typed_lines(inputs.code_files(spark, sf_dir))
    merged = segments.collapse_comments(segments.raw_comments(lines, F.col("marks")))
    return files.select("path", F.inline(merged))


@query
def segments_all(spark, sf_dir):
    found = segments.segments(F.col("content"), F.col("file_type"))
    rows = inputs.code_files(spark, sf_dir).select("path", F.posexplode(found).alias("no", "s"))
    return rows.select(
        "path",
        "no",
        F.col("s.seg_type").alias("seg_type"),
        segments.line_range(F.col("s")).alias("lines"),
        segments.is_multiline(F.col("s")).alias("is_multiline"),
        F.col("s.body").alias("body"),
    )


@query
def chunked_segments(spark, sf_dir):
    """The same for files cut into chunks of seven lines, as files too large for a row are."""
    files = inputs.code_files(spark, sf_dir)
    chunks = chunked.line_chunks(files, text.stripped_lines(F.col("content")), 7, ["path", "file_type"])
    found = chunked.chunked_segments(chunks)
    segment = F.struct("start_line", "end_line")
    return found.select("path", "no", "seg_type", segments.line_range(segment).alias("lines"), segments.is_multiline(segment).alias("is_multiline"), "body")


@query
def markup_segments(spark, sf_dir):
    found = segments.segments(F.col("content"), F.col("file_type"))
    rows = inputs.page_files(spark, sf_dir).select("page_id", F.posexplode(found).alias("no", "s"))
    return rows.select("page_id", "no", F.col("s.seg_type").alias("seg_type"), F.col("s.body").alias("body"))


def _program_files(spark, sf_dir):
    return inputs.code_files(spark, sf_dir).where(segments.language_marks(F.col("file_type")).isNotNull())


def _comments():
    return cm.comments_by_kind(F.col("content"), F.col("file_type"))


@query
def comment_kinds(spark, sf_dir):
    rows = _program_files(spark, sf_dir).select("path", F.posexplode(_comments()).alias("no", "body"))
    return rows.withColumn("n_keywords", cm.keyword_count(F.col("body")))


@query
def record_high_comments(spark, sf_dir):
    return _program_files(spark, sf_dir).select("path", cm.record_high_comments(_comments()).alias("comment"))


@query
def license_comment(spark, sf_dir):
    """Best comment with an SPDX line planted in every ninth file."""
    spdx = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("// SPDX-License-Identifier: MIT\n"), "content"))
    files = inputs.code_files(spark, sf_dir)
    files = files.withColumn("content", F.coalesce(spdx, "content"))
    comments = cm.comments_by_kind(F.col("content"), F.col("file_type"))
    return files.select("path", cm.license_comment(comments).alias("comment"))


def _literals(spark, sf_dir):
    return word_ops.add_literals(inputs.code_files(spark, sf_dir))


@query
def lrw_text(spark, sf_dir):
    return _literals(spark, sf_dir).select("path", words.related_text(F.col("literals")).alias("body"))


@query
def no_lrw_text(spark, sf_dir):
    return _literals(spark, sf_dir).select("path", words.unrelated_text(F.col("literals")).alias("body"))


def _worded(spark, sf_dir, source="segments", profile="lemma"):
    files = inputs.code_files(spark, sf_dir).select("path", "file_type", "content")
    return word_ops.add_words(files, profile, source).drop("content")


@query
def process_words(spark, sf_dir):
    """License words with fallback to the whole text, and the words of other literals."""
    return _worded(spark, sf_dir).select(
        "path",
        joined("license_related_words", " ").alias("license_words"),
        joined("no_license_related_words", " ").alias("other_words"),
        "has_lrw_match",
    )


@query
def process_words_comment(spark, sf_dir):
    """The same with the best license comment as the only literal."""
    return _worded(spark, sf_dir, source="comment").select(
        "path",
        F.size("license_related_words").alias("n_words"),
        F.coalesce(F.size("no_license_related_words"), F.lit(-1)).alias("n_other"),
        joined("license_related_words", " ").alias("license_words"),
        joined("no_license_related_words", " ").alias("other_words"),
    )


@query
def word_tokens(spark, sf_dir):
    files = inputs.text_files(spark, sf_dir)
    return files.select("path", joined(tokens.word_tokens(F.col("content")), " ").alias("words"))


@query
def stop_word_tokens(spark, sf_dir):
    files = inputs.text_files(spark, sf_dir)
    return files.select("path", joined(tokens.unstemmed_tokens(F.col("content")), " ").alias("words"))


@query
def lemma_tokens(spark, sf_dir):
    files = inputs.text_files(spark, sf_dir).select("path", tokens.word_tokens(F.col("content")).alias("words"))
    done = word_ops.lemmatize_corpus(durable(files), inputs.lemmas(spark, sf_dir), ["words"])
    return done.select("path", joined("words", " ").alias("words"))


@query
def stem_counts(spark, sf_dir):
    """Tokens are counted first, so that each distinct one is stemmed once."""
    files = inputs.text_files(spark, sf_dir)
    counts = files.select(F.explode(tokens.unstemmed_tokens(F.col("content"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return add_stem(counts, "token").groupBy("stem").agg(F.sum("n").alias("n"))


@query
def missing_content(spark, sf_dir):
    """Order lines name files; only part of them has content."""
    docs = inputs.text_files(spark, sf_dir).select("path", "content")
    labels = inputs.table(spark, sf_dir, "labels").select("doc_id")
    known = inputs.text_files(spark, sf_dir).join(labels, "doc_id", "left_semi")
    return file_source.missing_content(docs.select("path"), known)


@query
def update_files(spark, sf_dir):
    """The whole update job: type, mapped licenses, words, tags."""
    code = inputs.code_files(spark, sf_dir)
    found = inputs.doc_licenses(spark, sf_dir).select("doc_id", "licenses")
    files = code.select("doc_id", "path").join(found, "doc_id").drop("doc_id")
    done = update.update_files(
        files, code.select("path", "content"), _mapping(spark, sf_dir), inputs.lemmas(spark, sf_dir)
    )
    return done.select(
        "path",
        "file_type",
        joined("mapped_licenses").alias("mapped_licenses"),
        joined("tags").alias("tags"),
        joined("license_related_words", " ").alias("words"),
        F.coalesce(F.size("no_license_related_words"), F.lit(-1)).alias("n_other"),
    )


# ------------------------------------------------------------------ features


def _documents(spark, sf_dir):
    return inputs.text_files(spark, sf_dir).select("path", "lang", tokens.word_tokens(F.col("content")).alias("words"))


@query
def ngram_counts(spark, sf_dir):
    terms = features.document_terms(_documents(spark, sf_dir))
    stats = features.term_statistics(terms)
    return stats.groupBy("tf", "df").agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"))


@query
def vocabulary_top(spark, sf_dir):
    vocab = features.vocabulary(_documents(spark, sf_dir))
    return vocab.select("term", "tf", "df", rounded("idf").alias("idf"))


@query
def tfidf_weights(spark, sf_dir):
    docs = durable(_documents(spark, sf_dir))
    weights = features.tfidf(docs, features.vocabulary(docs))
    return weights.select("path", "term", rounded("weight").alias("weight"))


# ------------------------------------------------------------------ sampling


@query
def holdout_tag(spark, sf_dir):
    tagged = holdout.tag_holdout(_mapped_files(spark, sf_dir))
    return tagged.select("path", joined(F.sort_array("tags")).alias("tags"))


def _training_files(spark, sf_dir):
    """Documents with concluded licenses, words and tags, ready to sample."""
    docs = inputs.doc_licenses(spark, sf_dir).select(
        "doc_id",
        "path",
        F.sort_array("licenses").alias("mapped_licenses"),
        tokens.word_tokens(F.col("text")).alias("license_related_words"),
    )
    # Every fourth document stands for a file with other words but no license text.
    other = F.when(F.col("doc_id") % 4 == 0, F.col("license_related_words"))
    docs = docs.withColumn("no_license_related_words", other).withColumn(
        "license_related_words",
        F.when(F.col("doc_id") % 10 != 3, F.col("license_related_words")).otherwise(tokens.empty_tokens()),
    )
    derived = tags.derived_tags(
        tags.no_tags(),
        F.col("mapped_licenses"),
        F.col("license_related_words"),
        F.col("no_license_related_words"),
    )
    return durable(
        docs.withColumn(
            "tags", F.when(F.col("doc_id") % 7 == 0, tags.add_tag(derived, fv.TEST)).otherwise(derived)
        )
    )


def _training_licenses(files):
    counts = files.select(F.explode("mapped_licenses").alias("license")).groupBy("license").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= 10).select("license")


def _samples(spark, sf_dir, tag, **options):
    files = _training_files(spark, sf_dir)
    return sampling.license_samples(
        files, _training_licenses(files), SAMPLE_CAP, all_of=[tag], none_of=[fv.TEST], **options
    )


def _sample_rows(samples):
    return samples.select(
        "license", "path", F.size("words").alias("n_words"), joined("labels").alias("labels")
    )


@query
def cap_per_license(spark, sf_dir):
    files = _mapped_files(spark, sf_dir).select("path", F.explode("mapped_licenses").alias("license"))
    return sampling.first_per_group(files, ["license"], ["path"], SAMPLE_CAP)


@query
def sample_single(spark, sf_dir):
    return _sample_rows(_samples(spark, sf_dir, fv.SINGLE_MAPPED_LICENSE))


@query
def sample_multi(spark, sf_dir):
    return _sample_rows(_samples(spark, sf_dir, fv.MULTIPLE_MAPPED_LICENSE))


@query
def sample_no_license(spark, sf_dir):
    samples = sampling.no_license_samples(_training_files(spark, sf_dir), SAMPLE_CAP)
    return samples.select("path", F.size("words").alias("n_words"), "label")


@query
def sample_routing(spark, sf_dir):
    single = durable(_samples(spark, sf_dir, fv.SINGLE_MAPPED_LICENSE))
    multi = durable(_samples(spark, sf_dir, fv.MULTIPLE_MAPPED_LICENSE))
    routed = sampling.routing_samples(single, multi, _training_files(spark, sf_dir))
    return routed.select("path", F.size("words").alias("n_words"), "label")


@query
def sample_family(spark, sf_dir):
    samples = sampling.family_samples(_training_files(spark, sf_dir), "HPND", SAMPLE_CAP)
    return samples.select("path", F.size("words").alias("n_words"), joined("labels").alias("labels"))


@query
def generalize_family(spark, sf_dir):
    samples = _samples(spark, sf_dir, fv.MULTIPLE_MAPPED_LICENSE)
    return _sample_rows(sampling.generalize_labels(samples))


# -------------------------------------------------------------------- models


@query
def label_indicator(spark, sf_dir):
    """Label sets as 0/1 per class, and back."""
    classes = ["CC-BY-NC-4.0", "HPND-fair", "HPND-harsh", "MIT", "Text-EN"]
    docs = inputs.doc_licenses(spark, sf_dir)
    flags = models.indicator("licenses", classes)
    return docs.select(
        "path",
        joined(F.transform(flags, lambda f: f.cast("string")), "").alias("flags"),
        joined(models.from_indicator(flags, classes)).alias("labels"),
    )


@query
def label_index(spark, sf_dir):
    """Sorted class names numbered from 0."""
    from pyspark.ml.feature import StringIndexer

    docs = inputs.table(spark, sf_dir, "documents").select("lang")
    indexer = StringIndexer(inputCol="lang", outputCol="ix", stringOrderType="alphabetAsc").fit(docs)
    return (
        indexer.transform(docs).groupBy("lang", F.col("ix").cast("long").alias("ix")).agg(F.count("*").alias("n"))
    )


def _language_terms(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return all_terms(docs.withColumnRenamed("lang", "label"), ["path", "label"], n_max=1)


@query
def naive_bayes_weights(spark, sf_dir):
    weights = scoring.naive_bayes(scoring.naive_bayes_counts(_language_terms(spark, sf_dir)))
    return weights.select("label", "term", rounded("w").alias("w"), rounded("d").alias("d"))


@query
def naive_bayes_predict(spark, sf_dir):
    terms = durable(_language_terms(spark, sf_dir))
    counts = durable(scoring.naive_bayes_counts(terms))
    weights = scoring.naive_bayes(counts).select("label", "term", (F.col("w") - F.col("d")).alias("w"))
    bias = scoring.naive_bayes_priors(_documents(spark, sf_dir).select("path", F.col("lang").alias("label")))
    bias = bias.join(scoring.naive_bayes_defaults(counts).select("label", "d"), "label")
    scores = scoring.linear_scores(terms.withColumnRenamed("tf", "x"), scoring.per_term(weights), bias)
    return scoring.best_label(scores)


@query
def held_out_report(spark, sf_dir):
    """Fit naive Bayes without every tenth document, predict these, report per language."""
    docs = inputs.text_files(spark, sf_dir).select("path", "doc_id", "lang", tokens.word_tokens(F.col("content")).alias("words"))
    held = F.col("doc_id") % 10 == 0
    fit = docs.where(~held)
    terms = lambda part: part.select("path", F.col("lang").alias("label"), F.inline(ngrams.term_counts(F.col("words"))))
    counts = durable(scoring.naive_bayes_counts(terms(fit)))
    weights = scoring.naive_bayes(counts).select("label", "term", (F.col("w") - F.col("d")).alias("w"))
    bias = scoring.naive_bayes_priors(fit.select("path", F.col("lang").alias("label")))
    bias = bias.join(scoring.naive_bayes_defaults(counts).select("label", "d"), "label")
    unseen = docs.where(held)
    scores = scoring.linear_scores(
        durable(terms(unseen).select("path", "term", F.col("tf").alias("x"))), scoring.per_term(weights), bias
    )
    truth = unseen.select("path", F.array("lang").alias("labels"))
    guess = scoring.best_label(scores).select("path", F.array("label").alias("labels"))
    report = evaluation.class_report(truth, guess)
    return report.select("label", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def _share_model(spark, sf_dir):
    """Documents, their stored TF-IDF features, term shares per language as weights, and a bias per language."""
    docs = durable(_documents(spark, sf_dir))
    vocab = durable(features.vocabulary(docs))
    x = durable(features.tfidf(docs, vocab).withColumnRenamed("weight", "x"))
    grams = features.vocabulary_terms(docs.withColumnRenamed("lang", "label"), vocab, ["path", "label"])
    counts = scoring.naive_bayes_counts(grams)
    totals = counts.groupBy("term").agg(F.sum("n").alias("all"))
    weights = counts.join(totals, "term").select("term", "label", (F.col("n") / F.col("all")).alias("w"))
    bias = docs.groupBy(F.col("lang").alias("label")).agg((-F.count("*") / F.lit(100000.0)).alias("b"))
    return docs, x, weights, bias


@query
def linear_score(spark, sf_dir):
    """A linear model whose weights are term shares per language, on TF-IDF features."""
    _, x, weights, bias = _share_model(spark, sf_dir)
    scores = scoring.linear_scores(x, scoring.per_term(weights), bias)
    return scores.select("path", "label", rounded("score").alias("score"))


@query
def svm_certificate(spark, sf_dir):
    """Objective and largest subgradient of the term shares, taken as one-versus-rest SVMs of the language."""
    docs, x, weights, bias = _share_model(spark, sf_dir)
    truth = durable(docs.select("path", F.col("lang").alias("label")))
    found = scoring.svm_certificate(x, truth, durable(weights), durable(bias), F.lit(0.01), 0.05)
    return found.select("label", rounded("objective").alias("objective"), rounded("subgradient").alias("subgradient"), "n_violated", "n_free")


def _routed(spark, sf_dir):
    """Fixed branch results per document, to check the decision logic."""
    docs = inputs.doc_licenses(spark, sf_dir)
    few = F.filter("licenses", lambda x: ~F.startswith(x, F.lit("Text-")))
    return docs.select(
        "path",
        F.when(F.col("doc_id") % 17 != 0, F.col("licenses")).alias("words"),
        F.when(F.col("doc_id") % 6 == 0, fv.NO_LICENSE).when(F.size("licenses") > 1, fv.MULTI).otherwise(fv.SINGLE).alias("route"),
        F.slice("licenses", 1, 1).alias("single"),
        few.alias("multi"),
    )


@query
def route_predict(spark, sf_dir):
    col = F.col
    rows = _routed(spark, sf_dir)
    return rows.select(
        "path", joined(predict.decide(col("words"), col("route"), col("single"), col("multi"))).alias("licenses")
    )


@query
def family_refine(spark, sf_dir):
    rows = inputs.doc_licenses(spark, sf_dir).select(
        "path",
        F.array_distinct(F.transform("licenses", lambda x: names.generalize_license(x))).alias("licenses"),
        names.licenses_of_family(F.col("licenses"), "HPND").alias("finer"),
        (F.col("doc_id") % 5 == 0).alias("fails"),
    )
    finer = F.when(~F.col("fails"), F.col("finer")).otherwise(tokens.empty_tokens())
    return rows.select("path", joined(predict.refine(F.col("licenses"), {"HPND": finer})).alias("licenses"))


@query
def svm_language(spark, sf_dir):
    """One-versus-rest SVM on the document language, scored on the same documents."""
    docs = durable(_documents(spark, sf_dir)).where(F.size("words") > 0)
    samples = docs.select("path", "words", F.col("lang").alias("label"))
    problem = models.fit_single(samples, "language")
    scored = problem.predict(samples, "words", "guess")
    return scored.select("path", "label", F.get("guess", F.lit(0)).alias("guess"))


@query
def chain_labels(spark, sf_dir):
    """Classifier chain on all concluded licenses, fitted on the labelled documents, applied to all."""
    labelled = inputs.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    # marked while the documents lie by doc_id for their labels: their words are not shuffled
    docs = inputs.doc_licenses(spark, sf_dir).join(labelled, "doc_id", "left")
    worded = durable(docs.select("path", tokens.word_tokens(F.col("text")).alias("words"), F.col("licenses").alias("labels"), "labelled"))
    problem = models.fit_chain(worded.where("labelled").drop("labelled"), "labels")
    scored = problem.predict(worded, "words", "guess")
    return scored.select("path", joined(F.sort_array("labels")).alias("labels"), joined("guess").alias("guess"))


def _model(spark, sf_dir):
    files = _training_files(spark, sf_dir)
    return train.train(files, _training_licenses(files), max_samples=SAMPLE_CAP, families=("HPND",), max_iter=CHAIN_ITERATIONS)


@query
def chain_decide(spark, sf_dir):
    """Decisions of a chain of six yes/no labels over all documents, with a fixed table of weights, links and biases."""
    docs = _documents(spark, sf_dir)
    x = durable(docs.select("path", F.inline(ngrams.term_counts(F.col("words")))).withColumnRenamed("tf", "x"))
    labels = spark.range(6).select(F.concat(F.lit("L"), "id").alias("label"), F.col("id").cast("int").alias("k"))
    terms = x.select("term").distinct().where(F.length("term") <= 4).crossJoin(F.broadcast(labels))
    w = ((F.length("term") * (F.col("k") + 3) + F.ascii("term")) % 7 - 3).cast("double")
    bias = labels.select("label", "k", (F.col("k") * 4 - 9).cast("double").alias("b"))
    margins = scoring.linear_scores(x, scoring.per_term(terms.select("term", "label", w.alias("w"))), bias.select("label", "b"))
    links = [[float((k * 5 + j * 3) % 7 - 3) * 8 for j in range(6)] for k in range(6)]
    decided = scoring.chain_decisions(margins, [f"L{k}" for k in range(6)], links)
    return decided.select("path", joined("labels").alias("labels"))


@query
def corpus_scan(spark, sf_dir):
    """Train on the documents, then predict every conversation turn in one pass."""
    turns = inputs.spread(inputs.table(spark, sf_dir, "conversations"))
    contents = turns.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("content"))
    found = predict.predict_contents(contents, _model(spark, sf_dir))
    return found.select("path", "route", joined("licenses").alias("licenses"))


# ---------------------------------------------------------------- evaluation


def _truth(spark, sf_dir):
    return inputs.doc_licenses(spark, sf_dir).select("path", F.col("licenses").alias("labels"))


def _scored(spark, sf_dir, report):
    return report(_truth(spark, sf_dir), inputs.guessed_labels(spark, sf_dir))


@query
def subset_accuracy(spark, sf_dir):
    return _scored(spark, sf_dir, evaluation.subset_accuracy).select(rounded("accuracy").alias("accuracy"), "n_docs")


@query
def class_report(spark, sf_dir):
    report = _scored(spark, sf_dir, evaluation.class_report)
    return report.select("label", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def report_averages(spark, sf_dir):
    report = _scored(spark, sf_dir, evaluation.report_averages)
    return report.select("average", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def hamming_loss(spark, sf_dir):
    return _scored(spark, sf_dir, evaluation.hamming_loss).select(rounded("hamming_loss").alias("hamming_loss"))


@query
def license_text_lookup(spark, sf_dir):
    """Texts of single-license files for every license name found, with the fallback."""
    files = _files(spark, sf_dir)
    texts = store.license_texts(files.where(F.col("kind") == "License"))
    found = files.select(F.explode("licenses").alias("license")).distinct()
    brands = inputs.table(spark, sf_dir, "part").select(F.col("p_brand").alias("license")).distinct()
    return store.look_up_texts(found.unionByName(brands), texts)


@query
def known_license_texts(spark, sf_dir):
    files = _files(spark, sf_dir)
    texts = store.license_texts(mapping.map_licenses(files.where(F.col("kind") == "License"), _mapping(spark, sf_dir)))
    labels = _mapped_files(spark, sf_dir).select(F.explode("mapped_licenses").alias("license"))
    return store.known_license_texts(labels, texts)


@query
def predictions_json(spark, sf_dir):
    rows = inputs.guessed_labels(spark, sf_dir).withColumnRenamed("labels", "licenses")
    return store.to_json_lines(rows)


# ----------------------------------------------------------------- streaming


def _stream_table(spark, sf_dir, name):
    """A table as a stream, be it one file or a folder of files."""
    schema = inputs.table(spark, sf_dir, name).schema
    # a pattern, since Spark takes a plain path for a folder; the filter for names would not look into folders
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def _finished(query, spark, path, by_batch=False):
    query.awaitTermination()
    reader = spark.read.option("basePath", path) if by_batch else spark.read
    return reader.parquet(path)


@query
def stream_statement_counts(spark, sf_dir):
    """Running license statement counts; the newest count per key is the result."""
    path = new_table_path(spark, "counts")
    rows = _statements(_stream_table(spark, sf_dir, "documents"))
    done = jobs.stream_counts(rows, ["source", "license"], f"{path}/log", f"{path}/state")
    return jobs.latest(_finished(done, spark, f"{path}/log", True), ["source", "license"])


@query
def stream_findings(spark, sf_dir):
    """Findings that arrive in several batches, merged into the stored table."""
    path = new_table_path(spark, "findings")
    # three batches, each of as many files as there are cores
    files = spark.sparkContext.defaultParallelism
    inputs.table(spark, sf_dir, "lineitem").repartition(3 * files).write.parquet(f"{path}/in")
    lines = spark.read.parquet(f"{path}/in")
    lines = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    raw = spark.sql(
        inputs.raw_findings_sql(inputs.SPARK).replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines
    )
    jobs.stream_findings(raw, f"{path}/table", f"{path}/state", bucket_bytes=BUCKET_BYTES).awaitTermination()
    return _file_rows(findings_table.current_findings(spark, f"{path}/table"))


@query
def stream_scan(spark, sf_dir):
    """Predict arriving conversation turns."""
    model = _model(spark, sf_dir)
    path = new_table_path(spark, "scan")
    turns = _stream_table(spark, sf_dir, "conversations")
    contents = turns.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("content"))
    done = jobs.stream_predictions(contents, model, f"{path}/out", f"{path}/state")
    found = _finished(done, spark, f"{path}/out")
    return found.select("path", "route", joined("licenses").alias("licenses"))
