"""Files gathered from their lines, a row each, so that one call of a vectorised function sees many small files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["target", "version", "path"]


def of_whole_files(lines: DataFrame, each: Callable[[str, list[int], list[str]], list[tuple]], shape: str) -> DataFrame:
    """(target, version, path) and the columns of shape: the rows that each(path, line numbers, lines) gives of every file.

    Lines are in the order of their numbers, those of one number in that of their texts; a null text is an empty line.
    """

    @F.pandas_udf(f"array<struct<{shape}>>")
    def run(paths: pd.Series, numbers: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([each(p, list(n), list(t)) for p, n, t in zip(paths, numbers, texts, strict=True)], index=paths.index, dtype=object)

    rows = F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text"))))
    files = lines.groupBy(*FILE).agg(rows.alias("rows"))
    return files.select(*FILE, F.explode(run("path", "rows.line", "rows.text")).alias("f")).select(*FILE, "f.*")
