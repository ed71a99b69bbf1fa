"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontam import op9_decontamination
from .jaccard import op8_jaccard
from .licences import op7_licences
from .mixing import op4_mixing
from .pii import op10_pii
from .quality import op6_quality
from .sharding import op1_sharding
from .substrings import op5_substrings
from .suffixes import op3_suffixes
from .urls import op2_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_url_filter, op3_suffixes, op4_mixing, op5_substrings, op6_quality, op7_licences, op8_jaccard, op9_decontamination, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return oracles.all_()
