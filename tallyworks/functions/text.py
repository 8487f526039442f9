"""Vendors, dates, heights, grids, tiers and project types out of free text.

The patterns are read alike by Java and RE2, so the queries' SQL uses the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import _date, _group, let

# Fixed values.
VENDORS = {
    "MDC": "MDC Interior Solutions", "Foundation Building": "FBM", "FBM": "FBM", "GatorGyp": "GatorGyp", "GMS Acoustics": "GatorGyp", "Snap-Tex": "Snap-Tex",
    "SnapTex": "Snap-Tex", "RPG": "RPG Diffusor Systems", "Arktura": "Arktura", "Turf": "Turf", "J2": "J2 International", "Soelberg": "Soelberg Industries",
    "Acoufelt": "Acoufelt", "9Wood": "9Wood", "Soundply": "Soundply", "L&W": "L&W Supply", "Armstrong": "Armstrong", "USG": "USG",
}
HEADER_CHARS = 500
LABOUR_TIER_KEYWORDS = {
    3: ["woodworks", "wood", "rpg", "diffuser", "arktura", "atmosphera", "baffle", "clouds", "baffles", "specialty"],
    2: ["mdc", "embossed", "fabric", "fw", "snap-tex", "snaptex", "vektor", "lencore", "masking", "sound masking", "spektrum"],
    1: ["ultima", "optima", "cortega", "classic", "standard", "basic", "layin", "lay-in", "prelude", "tegular", "beveled"],
}
LABOUR_TIER_BY_TYPE = {"WW": 3, "RPG": 3, "Baffles": 3, "SM": 2, "FW": 2, "AP": 2}
PROJECT_TYPE_KEYWORDS = {
    "healthcare": ["hospital", "health", "medical", "clinic", "surgery", "dental", "pharma", "biotech", "hca", "baycare", "adventhealth", "mease", "morton plant", "orlandohealth", " mob", "mob ", "lecom", " icu ", " er "],
    "education": ["school", "university", "college", "academy", "elementary", "middle school", "high school", " hs ", "charter", "montessori", "campus", "learning", "steam", "institute", "usf", " uf ", "ucf", "fsu", "fgcu", "jesuit"],
    "government": ["government", "county", "city of", "municipal", "courthouse", "library", "fire station", "police", "federal", " dot", "dot ", "transit"],
    "hospitality": ["hotel", "resort", "motel", " inn", "inn ", "marriott", "hilton", "hyatt", "westin", "wyndham", "loews", "ritz", "sheraton"],
    "commercial_office": ["office", "headquarters", " hq", "hq ", "corporate", "financial", "bank", "law firm", "insurance", "grant thornton", "engineering", "partners"],
    "worship": ["church", "chapel", "synagogue", "mosque", "temple", "faith", "ministry", "worship", "baptist", "parish", "evangelist", "catholic"],
    "residential": ["apartment", "condo", "residential", "housing", "living", "multifamily", "multi-family", "village", "flats", "regency", "vesta"],
    "other": ["retail", "store", "shop", "mall", "outlet", "arena", "stadium", "gym", "fitness", "recreation", "aquatic"],
}
PLACEHOLDER_DATE = "2024-02-29"
US_DATE, US_SHORT, ISO_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
NAME_DATE = r"^([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2}),?\s+(\d{4})$"
HEIGHT = r"""(?i)(?:(\d{1,2})'[-\s]?(\d{1,2})"|(\d{1,2})\s*(?:FT|FEET)|(\d{2,3})")"""
GRID = r"\b((?:1|2|24|48)\s*[xX]\s*(?:2|4|24|48))\b"
GRIDS = {"24x24": "2x2", "24x48": "2x4", "48x24": "2x4", "2x2": "2x2", "2x4": "2x4", "4x2": "2x4", "1x4": "1x4", "4x1": "1x4"}
#: Groups of the path kinds, in order; a path has the first kind whose pattern it meets and whose bar it doesn't.
OWN_QUOTE = r"(?i)(^|/)Quote\s+[A-Z0-9\-]+\.pdf$"
VENDOR_FILE = r"(?i)(PO|Order|Invoice|Quote|MDC|Foundation|GatorGyp|Snap.?Tex|RPG|Arktura|Turf|J2|Soelberg|Acoufelt|9Wood|Soundply|L&W|FBM|Armstrong|USG)[^/]*\.pdf$"
DRAWING_FILE = r"(?i)(rcp|reflected ceiling|floor plan|takeoff dwg|act dwg|panels|dwg|architectural|drawing|acoustic takeoff)[^/]*\.pdf$"
NOT_DRAWING = r"(?i)(quote|t-004|vendor|signed|invoice|purchase order)[^/]*$"
NOT_BUILD_UP = r"(?i)(vendor|quote|template|T-004|\.tmp)[^/]*$"
ARCHIVED = r"(^|/)(\+\+)?Archive/"

_MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def vendor(header: Column, file_name: Column) -> Column:
    """Vendor named in the first part of the text, else in the file's name; longer names are tried first."""
    named = lambda place: let(place, lambda p: F.coalesce(*[F.when(F.contains(p, F.lit(key.lower())), VENDORS[key]) for key in sorted(VENDORS, key=lambda k: -len(k))]))
    return F.coalesce(named(F.lower(F.substring(F.trim(header), 1, HEADER_CHARS))), named(F.lower(file_name)))


def document_date(raw: Column, placeholder: bool = True) -> Column:
    """Date written as M/D/YYYY, M/D/YY, ISO or ``Month D, YYYY``; impossible ones are null, and, if asked, the placeholder date too."""
    s = F.trim(raw)
    part = lambda r, i: _group(s, r, i).cast("int")
    month = F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(_group(s, NAME_DATE, 1))).cast("int"), F.lit(0))
    found = F.coalesce(
        _date(part(US_DATE, 3), part(US_DATE, 1), part(US_DATE, 2)), _date(part(US_SHORT, 3) + 2000, part(US_SHORT, 1), part(US_SHORT, 2)),
        _date(part(ISO_DATE, 1), part(ISO_DATE, 2), part(ISO_DATE, 3)), _date(part(NAME_DATE, 3), month, part(NAME_DATE, 2)),
    )
    return F.nullif(found, F.lit(PLACEHOLDER_DATE).cast("date")) if placeholder else found


def backfill_date(raw: Column) -> Column:
    """Six forms in order: M/D/YYYY, M/D/YY (69 to 99 of the last century), ISO, ``Month D, YYYY``, ``Mon D, YYYY`` and ``Month D YYYY``; the placeholder date and impossible ones are null."""
    s = F.trim(raw)
    part = lambda r, i: _group(s, r, i).cast("int")
    full = F.array(*map(F.lit, _MONTH_NAMES))
    at = lambda r, table: F.nullif(F.array_position(table, F.lower(_group(s, r, 1))).cast("int"), F.lit(0))
    comma, plain = r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})$", r"^([A-Za-z]+)\s+(\d{1,2})\s+(\d{4})$"
    short = F.transform(full, lambda m: F.substring(m, 1, 3))
    century = part(US_SHORT, 3) + F.when(part(US_SHORT, 3) >= 69, 1900).otherwise(2000)
    found = F.coalesce(
        _date(part(US_DATE, 3), part(US_DATE, 1), part(US_DATE, 2)), _date(century, part(US_SHORT, 1), part(US_SHORT, 2)),
        _date(part(ISO_DATE, 1), part(ISO_DATE, 2), part(ISO_DATE, 3)), _date(part(comma, 3), at(comma, full), part(comma, 2)),
        _date(part(comma, 3), at(comma, short), part(comma, 2)), _date(part(plain, 3), at(plain, full), part(plain, 2)),
    )
    return F.nullif(found, F.lit(PLACEHOLDER_DATE).cast("date"))


def height(raw: Column) -> Column:
    """A ceiling height as ``F'-I"``, from feet and inches, feet, or inches; null if there is none."""
    n = lambda i: _group(raw, HEIGHT, i).cast("int")
    text = lambda f, i: F.format_string("%d'-%d\"", f, i)
    return F.when(n(1).isNotNull(), text(n(1), n(2))).when(n(3).isNotNull(), text(n(3), F.lit(0))).when(n(4).isNotNull(), text(F.floor(n(4) / 12), F.pmod(n(4), F.lit(12))))


def grid(raw: Column) -> Column:
    """A tile grid in feet; one that has no name of its own stays as it is written, in lower case."""
    found = _group(raw, GRID, 1)
    key, out = F.regexp_replace(F.lower(found), r"\s+", ""), None
    for written, name in GRIDS.items():
        out = F.when(key == written, name) if out is None else out.when(key == written, name)
    return out.otherwise(F.lower(found))


def labour_text(name: Column, kind: Column) -> Column:
    """The text in which ``labour_tier`` looks for keywords."""
    return F.lower(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(kind, F.lit(""))))


def labour_tier(name: Column, kind: Column, text: Column | None = None) -> Column:
    """0 to 3 for labour: the dearest tier with a keyword in the name or type, else the type's; 0 if both are empty.

    ``text`` is a column that holds ``labour_text``, so that it isn't worked out for each keyword.
    """
    both, out = labour_text(name, kind) if text is None else text, None
    for tier, words in LABOUR_TIER_KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(both, F.lit(w))
        out = F.when(both == "", 0).when(hit, tier) if out is None else out.when(hit, tier)
    for k, tier in LABOUR_TIER_BY_TYPE.items():
        out = out.when(kind == k, tier)
    return out.otherwise(1)


def project_type(name: Column, contractor: Column) -> Column:
    """Struct of kind and reason: the first keyword in the project's name, else in the contractor's, else ``other``."""
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(w).alias("word")) for k, words in PROJECT_TYPE_KEYWORDS.items() for w in words])
    first = lambda c: F.try_element_at(F.filter(rules, lambda r: F.contains(F.lower(F.coalesce(c, F.lit(""))), r["word"])), F.lit(1))
    own, other = first(name), first(contractor)
    named = lambda r, where: F.when(r.isNotNull(), F.struct(r["kind"].alias("kind"), F.concat(F.lit(where + ": "), r["word"]).alias("reason")))
    return F.coalesce(named(own, "name"), named(other, "contractor"), F.struct(F.lit("other").alias("kind"), F.lit("no keyword").alias("reason")))


def path_kind(path: Column) -> Column:
    """Kind of document by its path: build_up, own_quote, vendor_quote, drawing; null for others, lock files and archived ones."""
    live = ~path.rlike(ARCHIVED)
    return (
        F.when(path.rlike(r"(^|/)~\$"), None)
        .when(live & path.rlike(r"(?i)\.xlsx$") & ~path.rlike(NOT_BUILD_UP), "build_up")
        .when(path.rlike(OWN_QUOTE), "own_quote")
        .when(live & path.rlike(VENDOR_FILE), "vendor_quote")
        .when(path.rlike(DRAWING_FILE) & ~path.rlike(NOT_DRAWING), "drawing")
    )
