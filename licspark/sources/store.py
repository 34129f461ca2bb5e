"""Analyses, license texts, predictions and models on storage."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from licspark import fixed_values as fv
from licspark.functions.names import safe_license_name
from licspark.operators.analysis import report_lines


def save_analysis(analysis: DataFrame, path: str) -> None:
    analysis.write.mode("overwrite").parquet(path)


def load_analysis(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_statistics(analysis: DataFrame, path: str) -> None:
    """Counts and percentages as a readable report, one folder per metric."""
    report_lines(analysis).orderBy("metric", "key").write.mode("overwrite").partitionBy("metric").json(path)


def to_json_lines(predictions: DataFrame) -> DataFrame:
    """One JSON object {filename, licenses} per file."""
    return predictions.select(
        F.to_json(F.struct(F.col("path").alias("filename"), "licenses")).alias("value")
    )


def save_predictions(predictions: DataFrame, path: str) -> None:
    to_json_lines(predictions).write.mode("overwrite").text(path)


def license_texts(license_files: DataFrame) -> DataFrame:
    """(license, text) from license files with a text and exactly one license.

    The license is the mapped one, as model classes are, where files are mapped.
    """
    names = "mapped_licenses" if "mapped_licenses" in license_files.columns else "licenses"
    single = license_files.where((F.size(names) == 1) & (F.coalesce("text", F.lit("")) != ""))
    return single.select(F.get(names, F.lit(0)).alias("license"), "text", "path").groupBy("license").agg(
        F.min_by("text", "path").alias("text")
    )


def known_license_texts(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of the licenses a model knows."""
    return labels.select("license").distinct().join(texts, "license")


def save_license_texts(texts: DataFrame, path: str) -> None:
    texts.withColumn("file_name", safe_license_name(F.col("license"))).write.mode("overwrite").parquet(path)


def look_up_texts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Text per name, matched by file-safe name, with a fallback for unknown ones."""
    store = texts.groupBy(safe_license_name(F.col("license")).alias("file_name")).agg(
        F.min_by("text", "license").alias("text")
    )
    return (
        names.withColumn("file_name", safe_license_name(F.col("license")))
        .join(store, "file_name", "left")
        .select("license", F.coalesce("text", F.lit(fv.LICENSE_TEXT_FALLBACK)).alias("text"))
    )


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    rows = spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
