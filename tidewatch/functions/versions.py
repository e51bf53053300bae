"""Versions in the order of their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words after a number that come after the version without them; all others come before it, as releases of candidates do.
AFTER = ("post", "patch", "p", "sp", "hotfix", "r")


def version_key(version: Column) -> Column:
    """An orderable key: numbers by value, 1.9 before 1.10, 2.0-rc1 before 2.0, 2.0 before 2.0.post1; names before numbers.

    Letter case, a leading v, and what separates the parts do not count; trailing zeros do (1 before 1.0). Null stays null.
    """
    parts = F.regexp_extract_all(F.regexp_replace(F.lower(version), r"^\s*v(?=\d)", ""), F.lit(r"(\d+|[a-z]+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    number = lambda x: F.concat(F.lit("2"), F.lpad(F.length(digits(x)).cast("string"), 5, "0"), digits(x))
    word = lambda x: F.concat(F.when(x.isin(*AFTER), F.lit("1")).otherwise(F.lit("0")), x)
    # The end counts as 1: after a word that makes a version earlier, before one that makes it later, before a number.
    return F.when(version.isNotNull(), F.concat(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(word(x))), F.array(F.lit("1"))))
