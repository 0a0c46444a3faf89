"""Coordinates to places: the nearest gazetteer entry on the sphere, within 100 km."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.scalars import EARTH_KM, chord_km, place_tags, squared_chord

FARTHEST_KM = 100.0
#: Cells of one degree; a place within FARTHEST_KM lies in a cell beside that of the point.
_CELL = 1.0


def geocode(points: DataFrame, gazetteer: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """(path, cc, name, km, tags) of points (path, gps_lat, gps_lon) that have a place; ties by country and name.

    countries (cc, country) names the codes; a code without a name gives no country tag.
    Points and places meet in cells of the globe: a place is put into every cell that some
    point within reach of it can lie in, which are more near the poles.
    """
    reach = math.degrees(FARTHEST_KM / EARTH_KM)
    low, high = F.greatest(F.lit(-90.0), F.col("lat") - reach), F.least(F.lit(90.0), F.col("lat") + reach)
    polar = F.greatest(F.abs(low), F.abs(high)) >= 89
    wide = F.when(polar, F.lit(180.0)).otherwise(F.lit(reach * 1.01) / F.cos(F.radians(F.greatest(F.abs(low), F.abs(high)))))
    cell = lambda x: F.floor(x / _CELL).cast("int")
    places = gazetteer.withColumn("cy", F.explode(F.sequence(cell(low), cell(high))))
    places = places.withColumn("cx", F.explode(F.array_distinct(F.transform(F.sequence(cell(F.col("lon") - wide), cell(F.col("lon") + wide)), lambda x: F.pmod(x, F.lit(360))))))
    seen = points.filter("gps_lat is not null and gps_lon is not null").withColumns({"cy": cell(F.col("gps_lat")), "cx": F.pmod(cell(F.col("gps_lon")), F.lit(360))})
    met = seen.join(places, ["cy", "cx"]).withColumn("km", chord_km(squared_chord(F.col("gps_lat"), F.col("gps_lon"), F.col("lat"), F.col("lon"))))
    best = met.filter(F.col("km") <= FARTHEST_KM).groupBy("path").agg(F.min(F.struct("km", "cc", "name", "admin1")).alias("p"))
    found = best.select("path", "p.*")
    if countries is not None:
        found = found.join(countries, "cc", "left")
    country = F.col("country") if countries is not None else F.lit(None).cast("string")
    return found.select("path", "cc", "name", "km", place_tags(country, F.col("admin1"), F.col("name"), F.col("km")).alias("tags"))
