"""Query over mixed timestamp texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.timestamps import normalise_columns
from ..session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, uuid, field_name, instant_us) of every readable ``valid_at`` and ``created_at``."""
    return normalise_columns(table(spark, folder, "episodes"), ["valid_at", "created_at"], ["group_id", "uuid"])


QUERIES = {"p2_found": p2_found}
ORACLES: dict[str, str] = {}
