"""Rooms, ceilings and wall treatments out of the texts of plan pages, line by line with the lines around.

Everything but the choice of the first of several equal numbers or tags of a page is local to a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import let
from ..functions.text import HEIGHT, grid, height
from .plan_pages import TYPE_ALIASES

# Patterns (Java).
ROOM_HEADER = r"(?i)\bROOM\s+(?:NO\.?\s*)?(\d{2,5})\b(?:\s*[-–—]\s*(.+))?"
ROOM_LINE, NOT_ROOM = r"^(\d{2,5})\s*[-–—]\s*(.+)$", r"^\d+'-"
FINISH_ROW = r"^(\d{2,5})\s{2,}(\S.*?)\s{2,}(\S+)\s{2,}(\S+)(?:\s{2,}(\S+))?"
CEILING_TAG = r"(?i)\b(ACT-\d+|AWP-\d+|GWB|EXPOSED\s+STRUCTURE|EXPOSED|OPEN\s+TO\s+(?:ABOVE|STRUCTURE))\b"
SCOPE_TAG, CEILING_SCOPE_TAG = r"\b([A-Z]{2,4}-\d+)\b", r"\b([A-Z]{2,4}-\d+[A-Z]?)\b"
OPEN_AREAS = [r"OPEN\s+OFFICE", "LOBBY", "CORRIDOR", "HALLWAY", "RECEPTION", r"WAITING\s+AREA", "BREAKROOM", r"BREAK\s+ROOM", r"CONFERENCE\s+ROOM", r"BOARD\s+ROOM", r"SERVER\s+ROOM", r"COPY\s+ROOM", "STORAGE", "RESTROOM", "TOILET"]
TAGGED_AREA = r"(?i)^([A-Z]{2,4}-\d+)\s*[-–]?\s*([\d,]+(?:\.\d+)?)\s*SF\s*$"
ROOM_CEILINGS = {"ACT": r"(?i)\bACT\b|\bACOUSTICAL\s+(?:CEILING\s+)?TILE\b", "GWB": r"(?i)\bGWB\b|\bGYPSUM\b|\bDRYWALL\b", "Exposed Structure": r"(?i)\bEXPOSED\s+STRUCTURE\b|\bOPEN\s+TO\s+(?:ABOVE|STRUCTURE)\b|\bEXPOSED\b"}
CEILINGS = {
    "ACT": r"\bACOUSTICAL\s+(?:CEILING\s+)?TILE\b|\bACT\b",
    "GWB": r"\bGWB\b|\bGYPSUM\b|\bDRYWALL\b|\bDRY\s+WALL\b",
    "Exposed Structure": r"\bEXPOSED\s+STRUCTURE\b|\bOPEN\s+TO\s+(?:ABOVE|STRUCTURE)\b|\bEXPOSED\b",
    "Baffles": r"\bBAFFLE\b|\bCLOUD\b|\bHANGING\b",
    "FW": r"\bFABRIC\s+WALL\b|\bSNAP-?TEX\b",
    "WW": r"\bWOOD(?:WORKS)?\b|\bLINEAR\s+WOOD\b",
    "SM": r"\bSOUND\s+MASKING\b|\bMASKING\s+SYSTEM\b",
}
BRANDS = r"(?i)\b(ARMSTRONG|CERTAINTEED|USG|CHICAGO\s+METALLIC|ECOPHON|KNAUF|MINERAL\s+BASE|CORTEGA|DUNE|FINE\s+FISSURED|SUPRAFINE|OPTIMA|BIOGUARD|CERAMAGUARD|TUNDRA|ORION)\b"
PRODUCT_STOP, PRODUCT_CHARS, PRODUCT_WORDS = r"(?i)^(?:\d{1,2}x\d{1,2}|\d{1,2}'|AFF|GRID|TILE|CEILING|ROOM|FINISH)$", 80, 4
RAIL_LENGTH = r"(?i)(WAINSCOT|CHAIR\s+RAIL)\s*[-–]?\s*([\d,]+(?:\.\d+)?)\s*LF(?:\s*@\s*(\d{1,3})[\"']?)?"
RAIL = r"(?i)(WAINSCOT|CHAIR\s+RAIL)\s*@\s*(\d{2,3})[\"']?"
TREATMENT = r"(?i)(ACOUSTIC\s+WALL\s+PANELS?|FABRIC\s+WALL|AWP|FW|SNAP[- ]?TEX|WALL\s+PANELS?)\s*[-–—]\s*([\d,]+(?:\.\d+)?)\s*SF"
FABRIC = r"(?i)FABRIC\s+WALL|FW|SNAP[- ]?TEX"
WALL_TAG = r"(?i)\b(AWP|FW)-(\d+)\b(?:\s*[-–]?\s*([\d,]+(?:\.\d+)?)\s*SF)?"
ANY_AREA, PANELS = r"(?i)([\d,]+(?:\.\d+)?)\s*SF", r"(?i)\(?(\d+)\)?\s*(?:EA\.?|PANELS?|PCS?\.?)\b"
PANEL_FEET, PANEL_INCHES = r"(?i)(\d{1,2})'[-\s]?x[-\s]?(\d{1,2})'", r"(?i)(\d{2,3})[\"″]\s*x\s*(\d{2,3})[\"″]"
WALL_BRANDS = r"(?i)\b(SNAP[- ]?TEX|GUILFORD\s+OF\s+MAINE|MAHARAM|DESIGNTEX|ACOUSTIMAC|WHISPERWALL|FABRIC\s+SYSTEMS?\s+INT(?:ERN?\.?)?|FSI|KINETICS|ECHO\s+ELIMINATOR|SONEX|AUDIMUTE)\b"
LOCATION = r"(?i)(?:ROOM|RM\.?|SUITE?|CORRIDOR|LOBBY|OFFICE|CONFERENCE|BOARD\s+ROOM|RECEPTION|WAITING|HALLWAY)\s*(?:NO\.?\s*)?(\w+)"
#: What rooms and ceilings suggest, and how surely.
CEILING_SCOPES = {"ACT": "ACT", "Baffles": "Baffles", "FW": "FW", "WW": "WW", "SM": "SM", "AWP": "AWP", "RPG": "RPG"}
BY_CEILING, BY_ROOM = 0.85, 0.75


def _g(text: Column, regex: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, regex, i), F.lit(""))


def _n(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def _kind(text: Column, rules: dict[str, str], flags: str = "") -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in rules.items():
        out = out.when(text.rlike(flags + pattern), name)
    return out


def _windows(text: Column, keep: Callable[[Column], Column]) -> Column:
    """The lines that ``keep`` takes, as structs (at, line, ahead, near, wide, next)."""

    def each(lines: Column) -> Column:
        around = lambda i, back, n: F.array_join(F.slice(lines, F.greatest(i - back, F.lit(0)) + 1, F.lit(n) + F.least(i, F.lit(back))), "\n")
        own = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: keep(x["line"]))
        return F.transform(own, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"), around(x["at"], 0, 5).alias("ahead"), around(x["at"], 2, 5).alias("near"), around(x["at"], 2, 4).alias("wide"), F.slice(lines, x["at"] + 2, F.lit(3)).alias("next")))

    return let(F.split(text, r"\r?\n"), each)


def spread(pages: DataFrame) -> DataFrame:
    """``pages`` dealt by page: a file of a few splits would be a few tasks' work, however many pages it has.

    The number is fixed, since texts are small for the work they make and would be put together again.
    """
    spark = pages.sparkSession
    return pages.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "plan_id", "page_no")


def page_lines(pages: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """(plan_id, page_no, at, line, ahead, near, wide, next) of the lines that ``keep`` takes: each with four lines after it, two before too, two before and three after, and the three after it apart."""
    return pages.select("plan_id", "page_no", F.inline(_windows(F.col("text"), keep)))


_ROOM = "struct<room:string,number:string,ceiling_height:string,ceiling:string,tag:string,area_sf:double,found:int>"


def _room(found: int, room: Column, number: Column | None = None, tall: Column | None = None, ceiling: Column | None = None, tag: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(room.alias("room"), (none if number is None else number).alias("number"), (none if tall is None else tall).alias("ceiling_height"), (none if ceiling is None else ceiling).alias("ceiling"), (none if tag is None else tag).alias("tag"), none.alias("area_sf"), F.lit(found).alias("found")).cast(_ROOM)


def _tag(text: Column) -> Column:
    return F.upper(_g(text, SCOPE_TAG))


def _line_rooms(x: Column) -> Column:
    """What a line (with its window) says of rooms: as a header, a numbered line, a finish row."""
    line = x["line"]
    after = F.try_element_at(F.filter(x["next"], lambda y: (F.trim(y) != "") & ~y.rlike("(?i)^\\s*" + ROOM_HEADER[4:]) & ~F.trim(y).rlike("^(?:" + HEIGHT + ")")), F.lit(1))
    number = _g(line, ROOM_HEADER)
    name = F.coalesce(F.nullif(F.trim(_g(line, ROOM_HEADER, 2)), F.lit("")), F.trim(after), F.concat(F.lit("ROOM "), number))
    header = F.when(line.rlike(ROOM_HEADER), _room(1, name, number, height(x["ahead"]), _kind(_g(x["ahead"], CEILING_TAG), ROOM_CEILINGS), _tag(x["ahead"])))
    said = F.trim(_g(line, ROOM_LINE, 2))
    numbered = F.when(line.rlike(ROOM_LINE) & ~said.rlike(NOT_ROOM), _room(2, said, _g(line, ROOM_LINE)))
    last = _g(line, FINISH_ROW, 5)
    finish = F.when(line.rlike(FINISH_ROW), _room(3, F.trim(_g(line, FINISH_ROW, 2)), _g(line, FINISH_ROW), None, _kind(last, ROOM_CEILINGS), F.when(last.rlike("^[A-Z]{2,4}-\\d+\\b"), F.upper(last))))
    return F.array_compact(F.array(header, numbered, finish))


def _spaces(text: Column) -> Column:
    """Open areas that a page names, the first of each name, with what stands 80 characters before and 120 after."""
    any_ = r"(?i)\b(?:" + "|".join(OPEN_AREAS) + r")\b"

    def placed(found: Column, gaps: Column) -> Column:
        length = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
        return F.transform(found, lambda m, i: F.struct(m.alias("m"), F.upper(F.regexp_replace(m, r"\s+", " ")).alias("name"), (length(gaps, i + 1) + length(found, i)).alias("at")))

    def space(x: Column) -> Column:
        back = F.least(x["at"], F.lit(80))
        around = F.substr(text, x["at"] - back + 1, back + F.length(x["m"]) + 120)
        return let(around, lambda a: _room(4, F.upper(x["m"]), None, height(a), _kind(_g(a, CEILING_TAG), ROOM_CEILINGS), _tag(a)))

    all_ = let(F.regexp_extract_all(text, F.lit(any_), F.lit(0)), lambda found: let(F.split(text, any_, -1), lambda gaps: placed(found, gaps)))
    first = let(all_, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["name"] == x["name"])))
    return F.when(text.rlike(any_), F.transform(first, space)).otherwise(F.array().cast(f"array<{_ROOM}>"))


def rooms(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(plan_id, page_no, room, number, ceiling_height, ceiling, tag, area_sf, found): rooms by headers, numbered lines and finish rows (the first of a number on a page counts), names of open areas, and marks' labels.

    A page (a row) is read once: what its lines say is an array, in which the first of a number is kept and
    against which the names of open areas are held.
    """
    said = F.flatten(F.transform(_windows(F.col("text"), lambda x: x.rlike(ROOM_HEADER) | x.rlike(ROOM_LINE) | x.rlike(FINISH_ROW)), _line_rooms))
    of = lambda a, k: F.filter(a, lambda x: x["found"] == k)
    ordered = let(said, lambda a: F.concat(of(a, 1), of(a, 2), of(a, 3)))
    first = lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["number"] == x["number"]))
    both = let(let(ordered, first), lambda own: F.concat(own, let(F.transform(own, lambda x: F.upper(x["room"])), lambda names: F.filter(_spaces(F.col("text")), lambda s: ~F.array_contains(names, s["room"])))))
    own = spread(pages.filter("text is not null")).select("plan_id", "page_no", F.inline(both))

    tag, none = _tag, lambda t="string": F.lit(None).cast(t)
    found = lambda k: F.lit(k).alias("found")
    label = F.trim("label")
    stated = label.rlike(TAGGED_AREA)
    marked = marks.filter(stated | label.rlike("^[A-Z]{2,4}-\\d+\\b")).select("plan_id", "page_no", label.alias("room"), none().alias("number"), none().alias("ceiling_height"), none().alias("ceiling"), F.upper(F.coalesce(_g(label, TAGGED_AREA), _g(label, SCOPE_TAG))).alias("tag"), F.when(stated, _n(_g(label, TAGGED_AREA, 2))).otherwise(F.col("area_sf").cast("double")).alias("area_sf"), found(5))
    return own.unionByName(marked)


def _with_product(rows: DataFrame, after: str) -> DataFrame:
    """``rows`` with ``product``: up to four words that follow a ceiling's name, up to a grid, height or structural word, if they look like a product."""
    rows = rows.withColumn("words", F.regexp_extract_all(F.substring(after, 1, PRODUCT_CHARS), F.lit(r"[A-Za-z0-9&./'-]+"), F.lit(0)))
    rows = rows.withColumn("stop", F.array_position(F.transform("words", lambda w: w.rlike(PRODUCT_STOP)), True).cast("int"))
    rows = rows.withColumn("words", F.slice("words", F.lit(1), F.least(F.when(F.col("stop") > 0, F.col("stop") - 1).otherwise(F.size("words")), F.lit(PRODUCT_WORDS))))
    rows = rows.withColumn("said", F.array_join("words", " "))
    found = F.when((F.size("words") > 0) & (F.col("said").rlike(BRANDS) | ((F.size("words") >= 2) & F.exists("words", lambda w: w.rlike("^[A-Z]")))), F.col("said"))
    return rows.withColumn("product", found).drop("words", "stop", "said")


def ceilings(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(plan_id, page_no, ceiling, grid, ceiling_height, product, tag, area_sf): the first rule that a line meets; of a tag the first on its page; marks with tags that the text has not."""
    line = F.col("line")
    after = F.lit("")
    for name, pattern in CEILINGS.items():
        after = F.when(F.col("ceiling") == name, F.regexp_replace(line, rf"(?is)^.*?(?:{pattern})", "")).otherwise(after)
    any_ = "(?i)" + "|".join(CEILINGS.values())
    rows = page_lines(spread(pages), lambda x: x.rlike(any_)).withColumn("ceiling", _kind(line, CEILINGS, "(?i)"))
    # Each step names columns of the one before, so nothing is worked out twice.
    rows = _with_product(rows.withColumn("after", after), "after").withColumn("tag", F.upper(_g(F.col("ahead"), CEILING_SCOPE_TAG)))
    rows = rows.select("plan_id", "page_no", "at", "ceiling", F.coalesce(grid(F.col("ahead")), grid(F.col("near"))).alias("grid"), F.coalesce(height(F.col("ahead")), height(F.col("near"))).alias("ceiling_height"), "product", "tag", F.lit(None).cast("double").alias("area_sf"))
    label = F.trim("label")
    tagged = r"(?i)^([A-Z]{2,4}-\d+[A-Z]?)\s*[-–]?\s*([\d,]+(?:\.\d+)?)\s*SF\s*$"
    own = F.upper(F.coalesce(_g(label, tagged), _g(label, r"^([A-Z]{2,4}-\d+[A-Z]?)\b")))
    drawn = marks.withColumn("tag", own).filter("tag is not null").withColumn("prefix", _g(F.col("tag"), "^([A-Z]+)"))
    # An AWP mark counts as an acoustical ceiling, as it was specified.
    drawn = drawn.withColumn("ceiling", F.coalesce(_kind(F.col("prefix"), CEILINGS, "(?i)"), F.when(F.col("prefix") == "AWP", "ACT").otherwise(F.col("prefix"))))
    drawn = drawn.groupBy("plan_id", "page_no", "tag").agg(F.min_by("ceiling", "mark_id").alias("ceiling"), F.min_by(F.coalesce(_n(_g(label, tagged, 2)), F.col("area_sf").cast("double")), "mark_id").alias("area_sf"))
    # A mark stands after all lines of its page, so it is the first of its tag only where the text has none.
    every = rows.unionByName(drawn.withColumn("at", F.lit(2**31 - 1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("plan_id", "page_no", "tag", F.when(F.col("tag").isNull(), F.col("at"))).orderBy("at"))
    return every.withColumn("k", first).filter("k = 1").drop("k", "at")


def walls(pages: DataFrame) -> DataFrame:
    """(plan_id, page_no, kind, tag, area_sf, length_lf, height_ft, width_ft, product, location): rails, treatments with an area, and tags (the first of each on its page), whose area may be panels times their size."""
    line, wide = F.trim("line"), F.col("wide")
    none = lambda t="double": F.lit(None).cast(t)
    feet = lambda i: F.coalesce(_n(_g(wide, PANEL_FEET, i)), _n(_g(wide, PANEL_INCHES, i)) / 12)
    product = _g(wide, WALL_BRANDS)
    where = lambda text: F.nullif(F.trim(F.regexp_extract(text, LOCATION, 0)), F.lit(""))
    of = lambda kind, tag, area, length, high, width, what, text: F.struct(kind.alias("kind"), tag.alias("tag"), area.alias("area_sf"), length.alias("length_lf"), high.alias("height_ft"), width.alias("width_ft"), what.alias("product"), where(text).alias("location"))
    empty = none("string")
    rail = of(F.lit("AWP"), empty, none(), _n(_g(line, RAIL_LENGTH, 2)), _n(_g(line, RAIL_LENGTH, 3)) / 12, none(), empty, line)
    high = of(F.lit("AWP"), empty, none(), none(), _n(_g(line, RAIL, 2)) / 12, none(), empty, line)
    treated = of(F.when(_g(line, TREATMENT).rlike(FABRIC), "FW").otherwise("AWP"), empty, _n(_g(line, TREATMENT, 2)), none(), feet(2), feet(1), product, wide)

    def tagged(x: Column) -> Column:
        area = F.coalesce(_n(_g(x, WALL_TAG, 3)), _n(_g(wide, ANY_AREA)), _n(_g(wide, PANELS)) * feet(1) * feet(2))
        return of(F.upper(_g(x, WALL_TAG)), F.upper(F.concat(_g(x, WALL_TAG), F.lit("-"), _g(x, WALL_TAG, 2))), area, none(), feet(2), feet(1), product, wide)

    tags = F.transform(F.regexp_extract_all(line, F.lit(WALL_TAG), F.lit(0)), tagged)
    found = F.when(line.rlike(RAIL_LENGTH), F.array(rail)).when(line.rlike(RAIL), F.array(high)).when(line.rlike(TREATMENT), F.array(treated)).otherwise(tags)
    rows = page_lines(pages, lambda x: x.rlike(RAIL_LENGTH) | x.rlike(RAIL) | x.rlike(TREATMENT) | x.rlike(WALL_TAG)).select("plan_id", "page_no", "at", F.posexplode(found).alias("place", "x")).select("plan_id", "page_no", "at", "place", "x.*")
    first = F.row_number().over(Window.partitionBy("plan_id", "page_no", "tag", F.when(F.col("tag").isNull(), F.struct("at", "place"))).orderBy("at", "place"))
    return rows.withColumn("k", first).filter("k = 1").drop("k", "at", "place")


def suggested(rooms_: DataFrame, ceilings_: DataFrame) -> DataFrame:
    """(plan_id, scope_type, tag, area_sf, product, confidence, source, room): scopes that ceilings and rooms suggest; gypsum and open structure suggest none."""
    table = F.create_map(*[F.lit(x) for kv in CEILING_SCOPES.items() for x in kv])
    from_ceilings = ceilings_.select("plan_id", F.try_element_at(table, F.col("ceiling")).alias("scope_type"), F.upper("tag").alias("tag"), "area_sf", "product", F.lit(BY_CEILING).alias("confidence"), F.lit("ceiling").alias("source"), F.lit(None).cast("string").alias("room"))
    # One look-up of the prefix: a chain of conditions would hold the pattern twice as often with each alias.
    prefix = _g(F.upper("tag"), "^([A-Z]+)-")
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    kind = let(prefix, lambda x: F.coalesce(F.try_element_at(aliases, x), x, F.try_element_at(table, F.col("ceiling"))))
    from_rooms = rooms_.select("plan_id", kind.alias("scope_type"), F.upper("tag").alias("tag"), "area_sf", F.lit(None).cast("string").alias("product"), F.lit(BY_ROOM).alias("confidence"), F.lit("room").alias("source"), "room")
    return reduce(DataFrame.unionByName, [from_ceilings, from_rooms]).filter("scope_type is not null")
