"""Bearings and distances as words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the distance bands.
BANDS = ((64, "contact"), (256, "close"), (768, "medium"))


def bearing(dx: Column, dy: Column, facing: Column) -> Column:
    """Degrees from the facing direction to (dx, dy), positive to the left, within -180 to 180, to one decimal."""
    raw = F.degrees(F.atan2(dy, dx)) - facing
    over, under = F.ceil((raw - 180) / 360) * 360, F.ceil((-180 - raw) / 360) * 360
    return F.bround(F.when(raw > 180, raw - over).when(raw < -180, raw + under).otherwise(raw), 1)


def compass(b: Column) -> Column:
    """One of eight points, north ahead."""
    a = F.abs(b)
    side = F.when(b > 0, "west").otherwise("east")
    ahead, behind = F.concat(F.lit("north"), side), F.concat(F.lit("south"), side)
    return F.when(a <= 22, "north").when(a >= 158, "south").when(a < 67, ahead).when(a < 112, side).otherwise(behind)


def distance_band(distance: Column) -> Column:
    return F.coalesce(*(F.when(distance < end, F.lit(name)) for end, name in BANDS), F.when(distance.isNotNull(), F.lit("far")))


def bearing_phrase(deg: Column) -> Column:
    a, side = F.abs(deg), F.when(deg > 0, "left").otherwise("right")
    square = F.concat(F.lit("directly "), side)
    return F.when(a <= 8, "dead ahead").when(a >= 165, "behind").when(a.between(80, 100), square).when(a < 45, F.concat(F.lit("ahead "), side)).otherwise(side)


def labelled_distance(distance: Column) -> Column:
    return F.concat(F.bround(distance, 0).cast("long").cast("string"), F.lit(" ("), distance_band(distance), F.lit(")"))


def labelled_bearing(deg: Column) -> Column:
    sign = F.when(deg > 0, "+").otherwise("")
    return F.concat(sign, F.bround(deg, 0).cast("long").cast("string"), F.lit("° ("), bearing_phrase(deg), F.lit(")"))
