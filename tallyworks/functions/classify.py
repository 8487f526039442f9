"""Classification of names and numbers by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import let

# Fixed values.
SCOPE_TYPES = ["ACT", "AWP", "AP", "Baffles", "FW", "WW", "SM", "RPG", "Other"]
TIER_KEYWORDS = {
    3: ["woodworks", "wood", "rpg", "specialty", "custom", "curved", "radius"],
    2: ["premium", "high nrc", "clima plus", "fine fissured", "dune", "cortega supreme", "mineral fiber", "snap-tex", "fabricmate", "kirei", "ultima"],
    1: ["standard", "cirrus", "eclipse", "mars", "cortega", "interlude", "prelude", "beveled", "tegular", "2x2", "2x4", "lay-in"],
    0: ["economy", "basic", "budget"],
}
HEALTHCARE = ["hospital", "health", "medical", "baycare", "hca", "tgh", "moffitt", "clinic", "surgery", "rehab", "nursing", "dental", "ortho", "pediatric", "urology", "cardiac", "oncology", "radiology", "pharmacy"]
EDUCATION = ["school", "university", "college", "usf", "ucf", "fau", "fsu", "elementary", "middle school", "high school", " hs ", "academy", "charter", "campus", "classroom", "gymnasium", "library"]
CHURCH = ["church", "chapel", "parish", "sanctuary", "faith", "worship", "cathedral", "temple", "mosque", "synagogue", "ministry"]
SCOPE_TYPE_NAMES = {"act": "ACT", "awp": "AWP", "ap": "AP", "baffles": "Baffles", "baffle": "Baffles", "fw": "FW", "sm": "SM", "ww": "WW", "rpg": "RPG", "other": "Other"}

COST_TYPE_NAMES = {
    "lift_rental": ["lift_rental", "lift rental"], "travel_per_diem": ["travel_per_diem", "travel per diem", "per diem"], "travel_flights": ["travel_flights", "travel flights", "flights"],
    "travel_hotels": ["travel_hotels", "travel hotels", "hotels"], "equipment": ["equipment"], "consumables": ["consumables"],
    "bond": ["bond", "p&p bond", "pp bond"], "site_visit": ["site_visit", "site visit"], "punch_list": ["punch_list", "punch list", "punch"],
    "setup_unload": ["setup_unload", "setup unload", "setup/unload"], "commission": ["commission"],
}
MARKUP_HEALTHCARE = ["hospital", "medical", "health", "clinic", "surgery", "dental", "care"]
MARKUP_EDUCATION = ["school", "university", "college", "academy", "education", "learning", "elementary", "high school"]
MARKUP_CHURCH = ["church", "chapel", "worship", "faith", "ministry", "cathedral", "synagogue", "mosque"]
PROJECT_TYPE_INDEX = {"other": 0, "healthcare": 1, "education": 2, "commercial_office": 3, "worship": 4, "government": 5, "residential": 6}


def contains_any(text: Column, keywords: list[str]) -> Column:
    """True if the lower-case text holds a keyword; false for null."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(text, F.lit(k))
    return F.coalesce(hit, F.lit(False))


def scope_type(raw: Column) -> Column:
    """Canonical scope type of a raw spelling; unknown and null become Other."""
    key, out = F.lower(F.trim(raw)), None
    for name, value in SCOPE_TYPE_NAMES.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise("Other")


def product_tier(name: Column) -> Column:
    """0 to 3: the first tier, from the dearest, with a keyword in the name; 1 if none or no name."""
    low, out = F.lower(name), None
    for tier, words in TIER_KEYWORDS.items():
        hit = contains_any(low, words)
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out.otherwise(1)


def building_flags(name: Column, contractor: Column) -> dict[str, Column]:
    both = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(contractor, F.lit(""))))
    return {"is_healthcare": contains_any(both, HEALTHCARE), "is_education": contains_any(both, EDUCATION), "is_church": contains_any(both, CHURCH)}


def cost_type(raw: Column) -> Column:
    """Canonical type of an additional cost; unknown, empty and null become other."""
    key, out = F.lower(F.trim(raw)), F.when(F.lit(False), "other")
    for name, spellings in COST_TYPE_NAMES.items():
        out = out.when(key.isin(spellings), name)
    return out.otherwise("other")


def markup_flags(name: Column, contractor: Column) -> dict[str, Column]:
    """The markup model's own keyword sets."""
    both = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(contractor, F.lit(""))))
    return {"is_healthcare": contains_any(both, MARKUP_HEALTHCARE), "is_education": contains_any(both, MARKUP_EDUCATION), "is_church": contains_any(both, MARKUP_CHURCH)}


def confidence_badge(score: Column, high: float = 0.80, medium: float = 0.50) -> Column:
    """Level and rounded percent, such as ``high (87%)``."""
    return F.concat(confidence_level(score, high, medium), F.format_string(" (%.0f%%)", F.bround(score.cast("decimal(12,8)") * 100, 0).cast("double")))


def confidence_level(score: Column, high: float = 0.75, medium: float = 0.50) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def colour_scope(colour: Column) -> Column:
    """Scope that a mark's colour ``#rrggbb`` hints at: red ACT, blue AWP, green FW, orange Baffles; null for yellow, others and bad ones."""

    def hint(x: Column) -> Column:
        r, g, b = x["r"], x["g"], x["b"]
        yellow = (r > 200) & (g > 200) & (b < 80)
        kind = F.when((r > 180) & (g < 100) & (b < 100), "ACT").when((r < 100) & (g < 100) & (b > 180), "AWP").when((r < 100) & (g > 180) & (b < 100), "FW").when((r > 180) & (g > 80) & (b < 80), "Baffles")
        return F.when(~yellow, kind)

    parts = F.struct(*[F.conv(F.substring(colour, i, 2), 16, 10).cast("int").alias(c) for i, c in ((2, "r"), (4, "g"), (6, "b"))])
    return F.when(colour.rlike("^#[0-9A-Fa-f]{6}$"), let(parts, hint))
