"""Training job."""

from pyspark.sql import DataFrame

from licspark import fixed_values as fv
from licspark.operators.models import TRAINERS, fit_chain
from licspark.operators.sampling import (
    family_samples,
    generalize_labels,
    license_samples,
    routing_samples,
)
from licspark.plans.model import FamilyLicenseModel, LicenseModel
from licspark.session import durable
from licspark.sources.store import known_license_texts


def sample_sets(
    files: DataFrame,
    licenses: DataFrame,
    max_samples: int,
    families=(),
    exclude_holdout: bool = True,
) -> dict[str, DataFrame]:
    """Samples per problem name. The capped sets are stored: later steps read them often."""
    excluded = [fv.TEST] if exclude_holdout else []

    def of_tag(tag):
        samples = license_samples(files, licenses, max_samples, all_of=[tag], none_of=excluded)
        return durable(generalize_labels(samples, families))

    single, multi = of_tag(fv.SINGLE_MAPPED_LICENSE), of_tag(fv.MULTIPLE_MAPPED_LICENSE)
    sets = {"SP": single, "MP": multi, "DP": durable(routing_samples(single, multi, files))}
    for family in families:
        sets[family] = durable(family_samples(files, family, max_samples, excluded))
    return sets


def train(
    files: DataFrame,
    licenses: DataFrame,
    license_texts: DataFrame | None = None,
    max_samples: int = 10_000,
    families=(),
    exclude_holdout: bool = True,
    profile: str = "lemma",
    source: str = "segments",
    lemmas: DataFrame | None = None,
    **fit_options,
) -> LicenseModel:
    """Fit all problems. ``licenses`` are the training licenses, ``families`` the special cases.

    ``profile``, ``source`` and ``lemmas`` are those given to the update job that made
    the words of ``files``; the model keeps them and makes the words of unknown files alike.
    """
    sets = sample_sets(files, licenses, max_samples, families, exclude_holdout)
    problems = [TRAINERS.get(name, fit_chain)(samples, name, **fit_options) for name, samples in sets.items()]
    texts = None
    if license_texts is not None:
        names = sorted({c for p in problems for c in p.classes})
        labels = files.sparkSession.createDataFrame([(n,) for n in names], "license string")
        texts = known_license_texts(labels, license_texts)
    kind = FamilyLicenseModel if families else LicenseModel
    return kind(problems, texts, profile, source, lemmas)
