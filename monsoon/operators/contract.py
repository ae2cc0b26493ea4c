"""Data contract: physical ranges, QC flags, request domains."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monsoon.functions.labels import general_number
from monsoon.functions.rounding import round_scalar

MIN_ROWS_KEY = "min_rows_for_training"

# The default contract (inclusive physical ranges) and the minimum training size.
DEFAULT_CONTRACT: dict = {
    "suhu_c": {"min": -10, "max": 50},
    "kelembaban_pct": {"min": 0, "max": 100},
    "curah_hujan_mm": {"min": 0, "max": 1000},
    "kecepatan_angin_kmh": {"min": 0, "max": 500},
    "arah_angin_deg": {"min": 0, "max": 360},
    "tutupan_awan_pct": {"min": 0, "max": 100},
    "t2m": {"min": -50, "max": 60},
    "t2m_max": {"min": -50, "max": 60},
    "t2m_min": {"min": -50, "max": 60},
    "rh2m": {"min": 0, "max": 100},
    "precipitation_mm": {"min": 0, "max": 2000},
    MIN_ROWS_KEY: 50,
}

# Accepted domains of scoring inputs and the defaults of optional ones.
WEATHER_DOMAIN = {
    "suhu_c": (-50, 60),
    "kelembaban_pct": (0, 100),
    "kecepatan_angin_kmh": (0, 500),
    "arah_angin_deg": (0, 360),
    "tutupan_awan_pct": (0, 100),
    "lat": (-11, 6),
    "lon": (95, 141),
}
CLIMATE_DOMAIN = {
    "lat": (-11, 6),
    "lon": (95, 141),
    "month": (1, 12),
    "rh2m": (0, 100),
    "ws2m": (0, 100),
    "allsky_sfc_sw_dwn": (0, 50),
}
GRID_DOMAIN = {"lat": (-11, 6), "lon": (95, 141), "month": (1, 12)}
CLIMATE_DEFAULTS = {"rh2m": 80.0, "ws2m": 2.0, "allsky_sfc_sw_dwn": 20.0}
ANOMALY_DEFAULTS = {"curah_hujan_mm": 0.0, "kecepatan_angin_kmh": 0.0}


class ContractError(ValueError):
    """Data broke its contract."""


def ranges_for(df: DataFrame, contract: Mapping | None = None) -> dict[str, tuple[float, float]]:
    """The contract's ranges for the columns this frame has, in contract order."""
    contract = DEFAULT_CONTRACT if contract is None else contract
    return {
        name: (rule["min"], rule["max"])
        for name, rule in contract.items()
        if isinstance(rule, Mapping) and name in df.columns
    }


def _outside(name: str, lo: float, hi: float) -> Column:
    value = F.col(name)
    return F.coalesce((value < F.lit(float(lo))) | (value > F.lit(float(hi))), F.lit(False))


def qc_clean(df: DataFrame) -> DataFrame:
    """Rows flagged OK or not flagged at all; without the column every row is clean."""
    if "qc_flag" not in df.columns:
        return df
    return df.filter((F.col("qc_flag") == "OK") | F.col("qc_flag").isNull())


def range_violations(df: DataFrame, contract: Mapping | None = None) -> DataFrame:
    """One row per rule (column, min, max, n_bad, ok), from a single pass over the data."""
    rules = ranges_for(df, contract)
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, min double, max double, n_bad long, ok boolean")
    counts = df.agg(*[F.count_if(_outside(c, lo, hi)).alias(c) for c, (lo, hi) in rules.items()])
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(float(lo)).alias("min"),
                F.lit(float(hi)).alias("max"),
                F.col(c).alias("n_bad"),
                (F.col(c) == 0).alias("ok"),
            )
            for c, (lo, hi) in rules.items()
        ]
    )
    return counts.select(F.inline(entries))


def require_ranges(df: DataFrame, contract: Mapping | None = None) -> None:
    """Raise if any value lies outside its range (one aggregate row comes back)."""
    broken = [r for r in range_violations(df, contract).collect() if not r["ok"]]
    if broken:
        raise ContractError(
            "data contract broken: "
            + "; ".join(f"{r['column']}: {r['n_bad']} values outside [{r['min']:g}, {r['max']:g}]" for r in broken)
        )


def has_min_rows(df: DataFrame, contract: Mapping | None = None) -> DataFrame:
    """One row (minimum, ok); reads only as many rows as the minimum."""
    contract = DEFAULT_CONTRACT if contract is None else contract
    minimum = int(contract.get(MIN_ROWS_KEY, 50))
    return (
        df.select(F.lit(1).alias("x"))
        .limit(minimum)
        .agg(F.count("x").alias("n"))
        .select(F.lit(minimum).alias("minimum"), (F.col("n") >= minimum).alias("ok"))
    )


def require_min_rows(df: DataFrame, contract: Mapping | None = None) -> None:
    row = has_min_rows(df, contract).first()
    if not row["ok"]:
        raise ContractError(f"fewer than {row['minimum']} rows, too few for training")


def require_rows(df: DataFrame, message: str, error: type[Exception] = ValueError) -> DataFrame:
    if df.isEmpty():
        raise error(message)
    return df


def rule_flags(df: DataFrame, contract: Mapping | None = None) -> DataFrame:
    """Add ``rule_flag`` and ``rule_reason`` (``RANGE:col=value|...`` in contract order, else OK)."""
    rules = ranges_for(df, contract)
    if not rules:
        return df.withColumns({"rule_flag": F.lit(False), "rule_reason": F.lit("OK")})
    tokens = [
        F.when(_outside(c, lo, hi), F.concat(F.lit(f"RANGE:{c}="), general_number(F.col(c))))
        for c, (lo, hi) in rules.items()
    ]
    flag = _outside(*next((c, *b) for c, b in rules.items()))
    for c, (lo, hi) in list(rules.items())[1:]:
        flag = flag | _outside(c, lo, hi)
    # Number formatting is the costly part: clean rows never reach it.
    reason = F.when(flag, F.concat_ws("|", *tokens)).otherwise(F.lit("OK"))
    return df.withColumns({"rule_flag": flag, "rule_reason": reason})


def with_defaults(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Fill optional inputs, adding the column when it is absent."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)
            for c, v in defaults.items()
        }
    )


def with_broken_fields(
    df: DataFrame, domain: Mapping[str, tuple[float, float]], required: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``broken``: the names of fields that are null or outside their domain."""
    checks = [
        F.when(F.col(c).isNull() | (F.col(c) < F.lit(float(lo))) | (F.col(c) > F.lit(float(hi))), F.lit(c))
        for c, (lo, hi) in domain.items()
    ]
    checks += [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    return df.withColumn("broken", F.array_compact(F.array(*checks)))


def split_valid(
    df: DataFrame, domain: Mapping[str, tuple[float, float]], required: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their broken fields). Both sides stay lazy and narrow."""
    marked = with_broken_fields(df, domain, required)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def qc_log(df: DataFrame, source: Column | str, run_timestamp: Column | None = None) -> DataFrame:
    """Rows, clean rows, flagged rows and clean share per source."""
    source = F.lit(source) if isinstance(source, str) else source
    flagged = F.coalesce(F.col("qc_flag") != "OK", F.lit(False)) if "qc_flag" in df.columns else F.lit(False)
    out = (
        df.select(source.alias("source"), flagged.alias("flagged"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("flagged").alias("flagged_rows"))
    )
    clean = F.col("total_rows") - F.col("flagged_rows")
    return out.select(
        "source",
        (F.current_timestamp() if run_timestamp is None else run_timestamp).alias("run_timestamp"),
        "total_rows",
        clean.alias("clean_rows"),
        "flagged_rows",
        round_scalar(F.lit(100.0) * clean / F.col("total_rows"), 1).alias("pct_clean"),
    )
