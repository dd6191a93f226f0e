"""JSON texts parsed once into variants; malformed ones are kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import cut_lineage


def parsed(rows: DataFrame, text: str, into: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the variant ``into``, rows whose text is no JSON), both written. The text itself stays with the
    malformed rows only; a null text is a null variant."""
    tried = rows.withColumn(into, F.try_parse_json(text))
    bad = F.col(text).isNotNull() & F.col(into).isNull()
    good = cut_lineage(tried.where(~bad).drop(text), "parsed")
    return good, cut_lineage(rows.where(F.col(text).isNotNull() & F.try_parse_json(text).isNull()), "malformed")
