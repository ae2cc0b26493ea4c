"""Calendar and cyclical features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months of the wet season and the Indonesian month labels.
WET_MONTHS = (11, 12, 1, 2, 3, 4)
WET_LABEL, DRY_LABEL = "basah", "kemarau"
MONTH_LABELS = ("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des")


def _angle(c: Column, period: float) -> Column:
    return F.lit(2.0) * F.pi() * c.cast("double") / F.lit(float(period))


def sin_cos(name: str, period: float, source: Column | None = None) -> list[Column]:
    """``{name}_sin`` and ``{name}_cos`` of a periodic value."""
    angle = _angle(F.col(name) if source is None else source, period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def season(month: Column) -> Column:
    """Wet or dry season; an unknown month counts as dry."""
    return F.when(month.isin(*WET_MONTHS), F.lit(WET_LABEL)).otherwise(F.lit(DRY_LABEL))


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), month.cast("int"))


def date_year(text: Column) -> Column:
    return F.year(text.cast("date"))


def date_month(text: Column) -> Column:
    return F.month(text.cast("date"))


def add_temporal_features(df: DataFrame, datetime_col: str = "datetime_local") -> DataFrame:
    """Add hour, month, their sine/cosine pairs and the season; unreadable times give nulls."""
    stamp = F.try_to_timestamp(F.col(datetime_col).cast("string"))
    out = df.withColumns({"hour": F.hour(stamp), "month": F.month(stamp)})
    hour_sin, hour_cos = sin_cos("hour", 24)
    month_sin, month_cos = sin_cos("month", 12)
    return out.withColumns(
        {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
            "musim": season(F.col("month")),
        }
    )
