"""Scalar functions on license names, paths and reports."""

from pyspark.sql import Column, functions as F

from licspark import fixed_values as fv
from licspark.functions.text import strip


def clean_license(name: Column, faithful: bool = False) -> Column:
    """License name without white space and quotes around it.

    ``faithful=True`` strips quotes once and white space once, in that order.
    """
    name = name if faithful else strip(name)
    return strip(F.btrim(name, F.lit('"')))


def safe_license_name(name: Column) -> Column:
    """Name usable as a file name: ``-`` and ``.`` to ``_``, other marks dropped."""
    return F.regexp_replace(F.translate(name, "-.", "__"), r"[^\p{L}\p{N}_]", "")


def generalize_license(name: Column, families=fv.SPECIAL_FAMILIES) -> Column:
    """``FAMILY-variant`` to ``FAMILY``."""
    out = name
    for family in families:
        out = F.when(F.startswith(name, F.lit(family + "-")), F.lit(family)).otherwise(out)
    return out


def licenses_of_family(licenses: Column, family: str) -> Column:
    return F.filter(licenses, lambda x: F.startswith(x, F.lit(family)))


def route_label(licenses: Column) -> Column:
    return F.when(F.size(licenses) > 1, fv.MULTI).otherwise(fv.SINGLE)


def extension(path: Column) -> Column:
    """``.ext`` of the last path element, empty when it has none."""
    return F.regexp_extract(path, r"[^./]\.?(\.[^./]*)$", 1)


def count_line(key: Column, n: Column) -> Column:
    return F.format_string("%s : %s", key, n.cast("string"))


def percent_line(key: Column, percent: Column) -> Column:
    return F.format_string("%s : %.2f%%", key, percent)
