"""Climate zones, biomes and legend classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land cover classes of the IGBP scheme, and the biomes they are grouped to.
IGBP_NAMES = {
    0: "Water", 1: "Evergreen needleleaf forests", 2: "Evergreen broadleaf forests", 3: "Deciduous needleleaf forests", 4: "Deciduous broadleaf forests",
    5: "Mixed forests", 6: "Closed shrublands", 7: "Open shrublands", 8: "Woody savannas", 9: "Savannas", 10: "Grasslands", 11: "Permanent wetlands",
    12: "Croplands", 13: "Urban and built-up", 14: "Cropland/natural vegetation mosaic", 15: "Permanent snow and ice", 16: "Barren", 17: "Water bodies",
    255: "Unclassified",
}
BIOMES = {"forest": (1, 2, 3, 4, 5), "shrubland": (6, 7), "savanna": (8, 9), "grassland": (10,), "wetland": (11,), "cropland": (12, 14), "barren": (16,)}
NOT_LAND = (0, 17, 255)

# The main classes of the finer climate scheme with their labels.
ZONES = {
    "BWh": "Hot desert", "BWk": "Cold desert", "BSh": "Hot steppe", "BSk": "Cold steppe", "Af": "Tropical rainforest", "Am": "Tropical monsoon",
    "Aw": "Tropical savanna (dry winter)", "Cwa": "Humid subtropical, dry winter", "Cfa": "Humid subtropical", "Dwa": "Humid continental, dry winter",
    "Dfa": "Humid continental", "Dfb": "Cold continental", "Dfc": "Subarctic boreal", "ET": "Tundra", "?": "Unknown",
}


def _first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def zone_code(temperature: Column, rain: Column, driest_month: Column, driest_quarter: Column) -> Column:
    """The finer climate class: dry classes by an aridity threshold, then by temperature and dry season."""
    t, p = temperature, rain
    dry = t * 10 + F.when(t > 0, F.lit(140.0)).otherwise(F.lit(0.0))
    hot = t >= 18
    rules = [
        (t.isNull(), "?"),
        ((p < dry * 0.5) & hot, "BWh"), (p < dry * 0.5, "BWk"),
        ((p < dry) & hot, "BSh"), (p < dry, "BSk"),
        (hot & (driest_month >= 60), "Af"), (hot & (driest_month >= F.lit(100.0) - p / F.lit(25.0)), "Am"), (hot, "Aw"),
        ((t >= 10) & (driest_quarter < 30), "Cwa"), (t >= 10, "Cfa"),
        ((t >= 3) & (driest_quarter < 50), "Dwa"), (t >= 3, "Dfa"),
        (t >= -3, "Dfb"), (t >= -38, "Dfc"),
    ]
    return _first_match(rules, "ET")


def zone_label(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), code)


def zone_letter(bio05: Column, bio06: Column, bio12: Column, bio14: Column) -> Column:
    """The main climate class by warmest and coldest month and rain; `unk` if any is missing."""
    missing = bio05.isNull() | bio06.isNull() | bio12.isNull() | bio14.isNull()
    return _first_match([(missing, "unk"), (bio05 < 10, "E"), ((bio12 < 400) & (bio14 < 30), "B"), (bio06 >= 18, "A"), (bio06 >= -3, "C")], "D")


def biome(code: Column) -> Column:
    return _first_match([(F.coalesce(code.isin(*codes), F.lit(False)), name) for name, codes in BIOMES.items()], "other")


def igbp_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in IGBP_NAMES.items() for x in pair]), code.cast("int")), F.lit("Unclassified"))


def is_land(code: Column) -> Column:
    return ~F.coalesce(code, F.lit(255)).isin(*NOT_LAND)


def legend_class(ratio: Column, tolerance: float = 0.02) -> Column:
    return _first_match([(ratio.isNull(), "missing"), (ratio >= 1.25, "far above"), (F.abs(ratio - 1) < tolerance, "as expected"), (ratio >= 1.0, "above"), (ratio > 0.75, "below")], "far below")
