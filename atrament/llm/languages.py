"""Language codes as the tables write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter codes of languages that the tables may write in either way.
THREE = {"pol": "pl", "eng": "en", "deu": "de", "ger": "de", "ces": "cs", "cze": "cs", "lat": "la", "ukr": "uk", "rus": "ru", "fra": "fr", "fre": "fr", "jpn": "ja", "zho": "zh", "chi": "zh", "tha": "th", "hin": "hi", "ara": "ar"}


def language(col: Column) -> Column:
    """Two letters in lower case; und where there is no code."""
    code = F.lower(F.trim(F.split(col, "[-_]")[0]))
    return F.coalesce(F.when(code.isin(*THREE), F.element_at(F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv]), code)).otherwise(F.nullif(code, F.lit(""))), F.lit("und"))
