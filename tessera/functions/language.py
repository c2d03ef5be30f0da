"""Language of a file by its name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=1 << 16)
def detect(name: str) -> str | None:
    """The name of the lexer for a file name, or None."""
    from pygments.lexers import get_lexer_for_filename
    from pygments.util import ClassNotFound

    try:
        return get_lexer_for_filename(name).name
    except ClassNotFound:
        return None


def with_language(files: DataFrame, detector: Callable[[str], str | None] = detect, name_col: str = "name") -> DataFrame:
    """files with the column language.  Each task calls the detector once for a name it has."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str | None] = {}
        for names in batches:
            for name in set(names.dropna()) - known.keys():
                known[name] = detector(name)
            yield names.map(known.get).astype(object)
            if len(known) > 1 << 16:
                known = {}

    return files.withColumn("language", of(F.col(name_col)))
