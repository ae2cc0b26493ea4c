"""Key lookups whose small side is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LOOKUP_ROWS = 20_000
_SALTS = 16


def lookup_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = MAX_LOOKUP_ROWS
) -> DataFrame:
    """Join a large table with one row per key of ``few``.

    Up to ``max_rows`` rows the lookup is broadcast and the large table is not shuffled. Beyond
    that the large side is salted, so a key holding a large share of it is spread over tasks.
    """
    if few.limit(max_rows + 1).count() <= max_rows:
        return many.join(F.broadcast(few), list(keys), how)
    # Any salt gives the same rows, so it needs no column: equal rows and map columns are spread as well.
    salted = many.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
