"""Feature stages for the models, all built from MLlib and SQL expressions.

Every stage is fitted inside the pipeline, so a cross-validation fold learns its medians, means
and categories from its own training rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monsoon.functions.spatial import add_spatial_features
from monsoon.functions.temporal import add_temporal_features, sin_cos

# Model inputs per use case, and the display group of every feature slot.
WEATHER_NUMERIC = ["suhu_c", "kelembaban_pct", "kecepatan_angin_kmh", "tutupan_awan_pct", "lat", "lon"]
WEATHER_CYCLIC = ["arah_angin_deg", "hour", "month"]
WEATHER_PERIODS = {"arah_angin_deg": 360.0, "hour": 360.0, "month": 360.0}
CLIMATE_NUMERIC = ["rh2m", "ws2m", "allsky_sfc_sw_dwn", "lat", "lon"]
GRID_NUMERIC = ["lat", "lon"]
SOIL = "soil_temp_c"
MONTH_PERIOD = {"month": 12.0}
WEATHER_GROUPS = (
    ["suhu_c", "kelembaban_pct", "kecepatan_angin_kmh", "tutupan_awan_pct", "koordinat", "koordinat"]
    + ["arah_angin", "hour", "bulan"] * 2
    + ["musim", "musim"]
)
CLIMATE_GROUPS = ["kelembaban (RH)", "kecepatan angin", "radiasi surya", "koordinat", "koordinat", "bulan", "bulan"]


class CyclicEncoder(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``{c}{suffix}_sin`` and ``{c}{suffix}_cos``; each column has its own period."""

    periods = Param(Params._dummy(), "periods", "period per input column", TypeConverters.toListFloat)
    suffix = Param(Params._dummy(), "suffix", "added to output names", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None, periods: Sequence[float] | None = None, suffix: str = "_cyc"):
        super().__init__()
        self._setDefault(suffix="_cyc")
        self._set(**self._input_kwargs)

    def outputs(self) -> list[str]:
        """All sines first, then all cosines."""
        names = [f"{c}{self.getOrDefault(self.suffix)}" for c in self.getInputCols()]
        return [f"{n}_sin" for n in names] + [f"{n}_cos" for n in names]

    def _transform(self, df: DataFrame) -> DataFrame:
        suffix = self.getOrDefault(self.suffix)
        added = {}
        for c, period in zip(self.getInputCols(), self.getOrDefault(self.periods), strict=True):
            sine, cosine = sin_cos(f"{c}{suffix}", period, F.col(c))
            added[f"{c}{suffix}_sin"], added[f"{c}{suffix}_cos"] = sine, cosine
        return df.withColumns(added)


class NumericCast(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Casts inputs to double; an input the frame lacks becomes null, to be imputed later."""

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                f"{c}_num": (F.col(c) if c in df.columns else F.lit(None)).cast("double")
                for c in self.getInputCols()
            }
        )


def _filled(names: Sequence[str]) -> list[Transformer | Estimator]:
    return [
        NumericCast(inputCols=list(names)),
        Imputer(
            strategy="median",
            inputCols=[f"{c}_num" for c in names],
            outputCols=[f"{c}_filled" for c in names],
        ),
    ]


def _scaled(names: Sequence[str]) -> list[Transformer | Estimator]:
    return [
        VectorAssembler(inputCols=[f"{c}_filled" for c in names], outputCol="numeric_raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="numeric_raw", outputCol="numeric"),
    ]


def _one_hot(name: str) -> list[Transformer | Estimator]:
    # One slot per category seen in training and all zeros for any other or for null.
    return [
        StringIndexer(
            inputCol=name, outputCol=f"{name}_index", handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCol=f"{name}_index", outputCol=f"{name}_hot"),
    ]


def _assembled(parts: Sequence[str]) -> Transformer:
    return VectorAssembler(inputCols=list(parts), outputCol="features")


def weather_frame(df: DataFrame) -> DataFrame:
    """Raw weather rows with the temporal and spatial columns the stages read."""
    return add_spatial_features(add_temporal_features(df))


def weather_inputs(df: DataFrame, target: str, order: str = "id") -> list[str]:
    """The columns training reads: a cached frame should hold no others."""
    wanted = [order, target, *WEATHER_NUMERIC, "arah_angin_deg", "datetime_local"]
    return [c for c in dict.fromkeys(wanted) if c in df.columns]


def climate_inputs(df: DataFrame, target: str, order: str = "id") -> list[str]:
    wanted = [order, target, *CLIMATE_NUMERIC, "month", "landcover_class"]
    return [c for c in dict.fromkeys(wanted) if c in df.columns]


def weather_stages(periods: Mapping[str, float] = WEATHER_PERIODS) -> list[Transformer | Estimator]:
    """14 slots: 6 scaled measures, 3 sines, 3 cosines, season.

    By default hour and month share the wind direction's period of 360.
    """
    encoder = CyclicEncoder(
        inputCols=[f"{c}_filled" for c in WEATHER_CYCLIC], periods=[float(periods[c]) for c in WEATHER_CYCLIC]
    )
    return [
        *_filled(WEATHER_NUMERIC + WEATHER_CYCLIC),
        *_scaled(WEATHER_NUMERIC),
        encoder,
        *_one_hot("musim"),
        _assembled(["numeric", *encoder.outputs(), "musim_hot"]),
    ]


def climate_stages(use_landcover: bool = False) -> list[Transformer | Estimator]:
    """Humidity, wind, radiation, position, month; the temperature extremes would give the target away."""
    encoder = CyclicEncoder(inputCols=["month"], periods=[MONTH_PERIOD["month"]])
    parts = ["numeric", *encoder.outputs()]
    stages = [*_filled(CLIMATE_NUMERIC), *_scaled(CLIMATE_NUMERIC), encoder]
    if use_landcover:
        stages += _one_hot("landcover_class")
        parts.append("landcover_class_hot")
    return [*stages, _assembled(parts)]


def grid_stages(use_soil: bool = False) -> list[Transformer | Estimator]:
    numeric = [*GRID_NUMERIC, SOIL] if use_soil else GRID_NUMERIC
    encoder = CyclicEncoder(inputCols=["month"], periods=[MONTH_PERIOD["month"]])
    return [*_filled(numeric), *_scaled(numeric), encoder, _assembled(["numeric", *encoder.outputs()])]


def grid_frame(df: DataFrame, target: str = "t2m_celsius", order: str = "id") -> DataFrame:
    """Only the columns the grid model reads; soil temperature and target when present."""
    wanted = [order, *GRID_NUMERIC, "month", SOIL, target]
    return df.select(*[c for c in wanted if c in df.columns])


def disaster_stages(features: Sequence[str]) -> list[Transformer | Estimator]:
    return [*_filled(features), *_scaled(features), _assembled(["numeric"])]
