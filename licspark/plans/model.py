"""A trained license model: problems, license texts, version."""

import warnings

from pyspark.sql import DataFrame, SparkSession

from licspark import __version__
from licspark.operators.models import Problem
from licspark.sources import store

MAIN_PROBLEMS = ("DP", "SP", "MP")


class ModelError(Exception):
    """A model that cannot be saved, loaded or used."""


class LicenseModel:
    """Routing (DP), single (SP) and multiple (MP) problems, plus one per license family."""

    kind = "linear"

    def __init__(
        self,
        problems: list[Problem | None],
        license_texts: DataFrame | None = None,
        profile: str = "lemma",
        source: str = "segments",
        lemmas: DataFrame | None = None,
    ):
        """``profile``, ``source`` and ``lemmas`` say how the words of the training files were made."""
        if not problems or None in problems:
            raise ModelError("not all problems are trained")
        names = [p.name for p in problems]
        if len(set(names)) != len(names):
            raise ModelError("two problems have the same name")
        self.problems = {p.name: p for p in problems}
        self.license_texts = license_texts
        self.profile, self.source, self.lemmas = profile, source, lemmas

    @property
    def families(self) -> list[str]:
        return sorted(set(self.problems) - set(MAIN_PROBLEMS))

    def info(self) -> dict:
        return {
            "version": __version__,
            "kind": self.kind,
            "families": self.families,
            "profile": self.profile,
            "source": self.source,
            "problems": {name: p.config() for name, p in self.problems.items()},
        }

    def save(self, spark: SparkSession, path: str) -> None:
        for problem in self.problems.values():
            problem.save(spark, path)
        if self.license_texts is not None:
            store.save_license_texts(self.license_texts, f"{path}/licenses")
        if self.lemmas is not None:
            self.lemmas.write.mode("overwrite").parquet(f"{path}/lemmas")
        stored = {"has_texts": self.license_texts is not None, "has_lemmas": self.lemmas is not None}
        store.save_config(spark, {**self.info(), **stored}, f"{path}/config")

    @classmethod
    def _read(cls, spark, path, config):
        problems = [Problem.load(spark, path, name) for name in config["problems"]]
        texts = spark.read.parquet(f"{path}/licenses") if config.get("has_texts") else None
        lemmas = spark.read.parquet(f"{path}/lemmas") if config.get("has_lemmas") else None
        return cls(problems, texts, config.get("profile", "lemma"), config.get("source", "segments"), lemmas)


class FamilyLicenseModel(LicenseModel):
    """A model whose predictions are refined within license families."""

    kind = "linear_families"


MODEL_KINDS = {c.kind: c for c in (LicenseModel, FamilyLicenseModel)}


def load_model(spark: SparkSession, path: str) -> LicenseModel:
    """Load a model of any kind after checking its version."""
    try:
        config = store.load_config(spark, f"{path}/config")
    except Exception as error:
        raise ModelError(f"no readable model configuration under {path}") from error
    version = config.get("version")
    if version is None:
        warnings.warn("the model names no version; it may not fit this library")
    elif version != __version__:
        raise ModelError(f"model version {version} differs from library version {__version__}")
    if config.get("kind") not in MODEL_KINDS:
        raise ModelError(f"unknown model kind {config.get('kind')!r}")
    return MODEL_KINDS[config["kind"]]._read(spark, path, config)


def license_text(model: LicenseModel, names: DataFrame) -> DataFrame:
    """Texts of the given licenses, with the fallback for unknown names."""
    if model.license_texts is None:
        spark = names.sparkSession
        texts = spark.createDataFrame([], "license string, text string")
    else:
        texts = model.license_texts
    return store.look_up_texts(names, texts)

