"""Transverse Mercator on an ellipsoid, forward and back, in column expressions that share their steps as columns.

Krueger's series in the third flattening to the sixth order: a conformal sphere, its transverse
cylinder, and harmonics between the two (errors far below a millimetre within 30 degrees of the meridian).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Semi-major axis (m) and inverse flattening of ellipsoids.
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "International": (6378388.0, 297.0), "Clarke1866": (6378206.4, 294.978698214)}

# Krueger's coefficients, rows by harmonic (2, 4, 6, ...), columns by the power of n from that row's first.
_ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
_BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)


@dataclass(frozen=True)
class TransverseMercator:
    meridian: float
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    ellipsoid: str = "WGS84"

    @staticmethod
    def utm(zone: int, south: bool = False, ellipsoid: str = "WGS84") -> TransverseMercator:
        if not 1 <= zone <= 60:
            raise ValueError("zones are 1 to 60")
        return TransverseMercator(6.0 * zone - 183, north=1e7 if south else 0.0, ellipsoid=ellipsoid)

    def _shape(self) -> tuple[float, float, float]:
        a, inverse = ELLIPSOIDS[self.ellipsoid]
        f = 1 / inverse
        n = f / (2 - f)
        return n, a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) * self.scale, math.sqrt(f * (2 - f))

    @staticmethod
    def _series(table: tuple, n: float) -> list[float]:
        return [sum(c * n ** (k + 1 + i) for i, c in enumerate(row)) for k, row in enumerate(table)]

    def forward(self, df: DataFrame, longitude: str, latitude: str, into: tuple[str, str] = ("east", "north")) -> DataFrame:
        """With east and north in metres of degrees; null outside +-90 degrees of latitude."""
        n, radius, e = self._shape()
        c, sine = F.col, F.sin(F.radians(F.col(latitude)))
        out = df.withColumn("__t", F.sinh(F.atanh(sine) - F.atanh(sine * e) * e))
        out = out.withColumn("__lam", F.radians(F.pmod(c(longitude) - self.meridian + 180, F.lit(360.0)) - 180))
        out = out.withColumn("__xi", F.atan2(c("__t"), F.cos("__lam"))).withColumn("__eta", F.atanh(F.sin("__lam") / F.sqrt(c("__t") * c("__t") + 1)))
        x, y = self._harmonics(self._series(_ALPHA, n), 1.0)
        inside = F.abs(c(latitude)) < 90
        kept = [k for k in df.columns if k not in into]
        return out.select(*kept, F.when(inside, x * radius + self.east).alias(into[0]), F.when(inside, y * radius + self.north).alias(into[1]))

    def inverse(self, df: DataFrame, east: str, north: str, into: tuple[str, str] = ("longitude", "latitude")) -> DataFrame:
        """With longitude and latitude in degrees."""
        n, radius, e = self._shape()
        c = F.col
        out = df.withColumn("__xi", (c(north) - self.north) / radius).withColumn("__eta", (c(east) - self.east) / radius)
        x, y = self._harmonics(self._series(_BETA, n), -1.0)
        out = out.withColumn("__x", x).withColumn("__y", y)
        tau = F.sin("__y") / F.hypot(F.sinh("__x"), F.cos("__y"))  # of the conformal latitude
        out = out.withColumn("__lam", F.atan2(F.sinh("__x"), F.cos("__y"))).withColumn("__conformal", F.asinh(tau)).withColumn("__phi", F.atan(tau))
        for _ in range(6):
            out = out.withColumn("__phi", F.asin(F.tanh(c("__conformal") + F.atanh(F.sin("__phi") * e) * e)))
        kept = [k for k in df.columns if k not in into]
        return out.select(*kept, (F.pmod(F.degrees("__lam") + (self.meridian + 180), F.lit(360.0)) - 180).alias(into[0]), F.degrees("__phi").alias(into[1]))

    @staticmethod
    def _harmonics(series: list[float], sign: float) -> tuple[Column, Column]:
        """(x, y) from the columns __xi and __eta."""
        xi, eta = F.col("__xi"), F.col("__eta")
        x, y = eta, xi
        for k, a in enumerate(series, 1):
            x = x + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * (sign * a)
            y = y + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * (sign * a)
        return x, y


def reproject(df: DataFrame, x: str, y: str, source: TransverseMercator | None, target: TransverseMercator | None, into: tuple[str, str]) -> DataFrame:
    """From one projection (None: degrees of longitude and latitude) to another on the same ellipsoid; null if either is null."""
    if source and target and source.ellipsoid != target.ellipsoid:
        raise ValueError("a change of ellipsoid is a change of datum, which this doesn't do")
    if source is None:
        degrees = df.withColumn("__lon", F.col(x)).withColumn("__lat", F.col(y))
    else:
        degrees = source.inverse(df, x, y, ("__lon", "__lat"))
    if target is None:
        return degrees.drop(*into).withColumnsRenamed({"__lon": into[0], "__lat": into[1]})
    return target.forward(degrees, "__lon", "__lat", into).drop("__lon", "__lat")
