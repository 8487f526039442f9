"""Pages and marks of plans: their kinds, areas, and the scopes they suggest.

Pages are (plan_id, page_no, text), marks (plan_id, page_no, mark_id, content, subject, title, colour).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import colour_scope
from ..functions.parse import feet, let

# Patterns that Java and RE2 read alike, and limits.
PAGE_KINDS = {"rcp": ["REFLECTED CEILING", "RCP"], "floor_plan": ["FLOOR PLAN", "LEVEL"], "elevation": ["ELEVATION"], "schedule": ["FINISH SCHEDULE", "ROOM SCHEDULE"]}
RICH_TEXT = 50
DIMENSION = r"""\d+'-\d+"|\d+'-\d+\s|\d+'\s*-\s*\d+\""""
AREA = r"(?i)Area[:\s]+([0-9,]+\.?\d*)\s*(?:sq\s*ft|SF|ft²)"
LENGTH = r"(?i)Length[:\s]+([0-9,]+\.?\d*)\s*(?:LF|ft|')"
LABEL_CHARS = 200
TAG = r"\b([A-Z]{2,5}-\d+)\b"
AREA_LABEL = r"(?i)([\d,]+(?:\.\d+)?)\s*(?:SF|SQ\.?\s*FT\.?)"
LEAST_LABEL, MOST_LABEL = 10, 500_000
_SIDE = r"""\d+(?:\.\d+)?(?:\s*'(?:\s*[-–]\s*\d+(?:\.\d+)?\s*")?)?(?:\s*')?"""
SIDES = rf"({_SIDE})\s*[xX×]\s*({_SIDE})"
LEAST_SIDE, MOST_SIDE, LEAST_AREA = 4, 500, 20
SECTION = r"\b(0[0-9]\s*[\s.]\s*\d{2})(?:\s*[\s.]\s*\d{2})?\b"
SECTIONS = {"0951": "ACT", "0984": "SM", "0977": "FW", "0972": "FW", "0964": "WW", "0640": "WW"}
KEYWORDS = {
    "ACT": r"(?i)\bACOUSTICAL\s+CEILING\s+TILE\b|\bACT\b",
    "SM": r"(?i)\bSOUND\s+MASKING\b|\bLENCORE\b|\bVEKTOR\b|\bSM\b",
    "FW": r"(?i)\bFABRIC\s+WALL\b|\bSNAP.?TEX\b|\bFW\b",
    "AWP": r"(?i)\bACOUSTIC\s+WALL\s+PANEL\b|\bAWP\b",
    "WW": r"(?i)\bWOOD\s+CEILING\b|\bWOODWORKS\b|\bWW\b",
    "Baffles": r"(?i)\bBAFFLE\b|\bCLOUD\s+PANEL\b|\bACOUSTIC\s+CLOUD\b",
    "RPG": r"(?i)\bRPG\b|\bDIFFUSER\b",
}
TYPE_ALIASES = {"BAFFLES": "Baffles", "CLOUD": "Baffles", "WOODWORKS": "WW", "WOOD": "WW"}
TAGGED, COLOURED, SECTIONED, MENTIONED = 0.95, 0.70, 0.65, 0.50


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("decimal(18,4)")


def classified(pages: DataFrame) -> DataFrame:
    """Kind, words, whether there is enough text and any dimension; a plan's first page is its cover."""
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    kind = F.when(F.col("page_no") == 1, "cover")
    for name, words in PAGE_KINDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.upper(text), F.lit(w))
        kind = kind.when(hit, name)
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))
    return pages.select("plan_id", "page_no", kind.otherwise("unknown").alias("kind"), (F.length(text) > RICH_TEXT).alias("rich"), words.alias("words"), text.rlike(DIMENSION).alias("dimensions"))


def _measures(content: Column) -> tuple[Column, Column]:
    """The area and length that a mark's content states."""
    return tuple(let(F.regexp_extract(F.coalesce(content, F.lit("")), p, 1), lambda x: F.when(x != "", _number(x))) for p in (AREA, LENGTH))


def _label() -> Column:
    return F.substring(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("content", "subject", "title")], F.lit("")), 1, LABEL_CHARS)


def parsed_marks(marks: DataFrame) -> DataFrame:
    """Marks with the area and length their content states, their type, and a label."""
    area, length = _measures(F.col("content"))
    rows = marks.select("plan_id", "page_no", "mark_id", "colour", _label().alias("label"), area.alias("area"), length.alias("length"))
    kind = F.when(F.col("area") != 0, "polygon").when(F.col("length") != 0, "measurement").otherwise("text")
    return rows.select("plan_id", "page_no", "mark_id", "colour", "label", F.col("area").cast("double").alias("area_sf"), F.col("length").cast("double").alias("length_lf"), kind.alias("kind"))


def _mark_scope() -> Column:
    """What a mark suggests, as an array of none or one.

    Each step is worked out once and names the one before: columns in a row would be put together again and
    pushed into the filters, so that a mark's patterns were read some thirty times, by code too long to compile.
    """
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    area, length = _measures(F.col("content"))
    is_ = lambda x: F.coalesce(x != 0, F.lit(False))

    def tagged(m: Column) -> Column:
        tag = F.when(is_(m["area"]) | is_(m["length"]), F.nullif(F.regexp_extract(m["label"], TAG, 1), F.lit("")))
        return let(tag, lambda t: let(F.when(t.isNotNull(), let(F.substring_index(t, "-", 1), lambda x: F.coalesce(F.try_element_at(aliases, x), x))).otherwise(colour_scope(F.col("colour"))), lambda k: found(m, t, k)))

    def found(m: Column, tag: Column, kind: Column) -> Column:
        sure, source = F.when(tag.isNotNull(), TAGGED).otherwise(COLOURED), F.when(tag.isNotNull(), "tag").otherwise("colour")
        row = F.struct(kind.alias("scope_type"), tag.alias("tag"), m["area"].cast("double").alias("area_sf"), m["length"].cast("double").alias("length_lf"), sure.alias("confidence"), source.alias("source"))
        return F.when((m["label"] != "") & kind.isNotNull(), F.array(row))

    return let(F.struct(_label().alias("label"), area.alias("area"), length.alias("length")), tagged)


def areas(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """A plan's area by the best evidence: marks' areas, distinct labels, pairs of sides, none.

    All evidence goes as rows of one union into one grouping; equal labels are combined before the shuffle.
    """
    labels = F.transform(F.regexp_extract_all("text", F.lit(AREA_LABEL), F.lit(1)), _number)
    sides = F.arrays_zip(F.regexp_extract_all("text", F.lit(SIDES), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(SIDES), F.lit(2)).alias("b"))
    decimal = "decimal(18,4)"
    own = pages.select("plan_id", F.lit("none").alias("evidence"), F.lit(None).cast(decimal).alias("area"))
    marked = parsed_marks(marks).filter("area_sf is not null").select("plan_id", F.lit("marks").alias("evidence"), F.col("area_sf").cast(decimal).alias("area"))
    labelled = pages.select("plan_id", F.lit("labels").alias("evidence"), F.explode(labels).alias("area")).filter(F.col("area").between(LEAST_LABEL, MOST_LABEL)).distinct()
    pairs = pages.select("plan_id", F.explode(sides).alias("s")).select("plan_id", feet(F.trim("s.a")).alias("a"), feet(F.trim("s.b")).alias("b"))
    pairs = pairs.filter(F.col("a").between(LEAST_SIDE, MOST_SIDE) & F.col("b").between(LEAST_SIDE, MOST_SIDE) & (F.col("a") * F.col("b") >= LEAST_AREA))
    paired = pairs.select("plan_id", F.lit("sides").alias("evidence"), F.round((F.col("a") * F.col("b")).cast(decimal), 2).cast(decimal).alias("area"))
    of = lambda e: F.when(F.col("evidence") == e, F.col("area"))
    sums = own.unionByName(marked).unionByName(labelled).unionByName(paired).groupBy("plan_id").agg(F.sum(of("marks")).alias("m"), F.sum(of("labels")).alias("l"), F.count(of("labels")).alias("n"), F.sum(of("sides")).alias("s"))
    best = F.when(F.col("m") > 0, F.struct(F.lit("marks").alias("source"), F.col("m").cast("double").alias("area_sf"), F.lit(0.95).alias("confidence")))
    best = best.when(F.col("n") > 0, F.struct(F.lit("labels").alias("source"), F.col("l").cast("double").alias("area_sf"), F.when(F.col("n") > 1, 0.70).otherwise(0.60).alias("confidence")))
    best = best.when(F.col("s") > 0, F.struct(F.lit("sides").alias("source"), F.col("s").cast("double").alias("area_sf"), F.lit(0.40).alias("confidence")))
    best = best.otherwise(F.struct(F.lit("none").alias("source"), F.lit(None).cast("double").alias("area_sf"), F.lit(0.0).alias("confidence")))
    return sums.select("plan_id", best.alias("b")).select("plan_id", "b.*")


def suggested(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Scopes that marks and texts suggest: a tag with a measure, a mark's colour, a section's number, a keyword.

    A type is suggested once a plan by sections and once by keywords.
    """
    from_marks = marks.select("plan_id", F.inline(_mark_scope()))
    digits = F.transform(F.regexp_extract_all("text", F.lit(SECTION), F.lit(1)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    table = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    sections = F.transform(digits, lambda d: F.struct(F.lit(SECTIONED).alias("confidence"), F.lit("section").alias("source"), F.try_element_at(table, d).alias("scope_type")))
    words = [F.when(F.col("text").rlike(p), F.struct(F.lit(MENTIONED).alias("confidence"), F.lit("keyword").alias("source"), F.lit(k).alias("scope_type"))) for k, p in KEYWORDS.items()]
    said = pages.select("plan_id", F.explode(F.concat(sections, F.array_compact(F.array(*words)))).alias("x")).select("plan_id", "x.*").filter("scope_type is not null").distinct()
    empty = {"tag": "string", "area_sf": "double", "length_lf": "double"}
    return from_marks.unionByName(said.select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]))


def merged(suggestions: DataFrame) -> DataFrame:
    """(plan_id, seq, scope_type, scope_tag, area_sf, confidence, product_hint, room) with untagged ones numbered after their type's highest tag, equal tags merged.

    The first of the most confident gives the confidence; areas are summed, rooms kept in order of first
    sight, the first product kept.  A plan's suggestions are one window's partition, as its drawings bound them.
    """
    prefix, n = F.regexp_extract("scope_tag", r"^([A-Z]+)-\d+$", 1), F.regexp_extract("scope_tag", r"^[A-Z]+-(\d+)$", 1).try_cast("int")
    rows = suggestions.withColumn("family", F.coalesce(F.nullif(prefix, F.lit("")), "scope_type")).withColumn("bare", F.col("scope_tag").isNull())
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "family", "bare").orderBy("seq")))
    # It names k, so it comes after the numbers and takes their sorted rows: one sort for both.
    rows = rows.withColumn("top", F.coalesce(F.max(F.when(F.col("k") > 0, n)).over(Window.partitionBy("plan_id", "family")), F.lit(0)))
    rows = rows.withColumn("tag", F.when(F.col("bare"), F.concat("scope_type", F.lit("-"), (F.col("top") + F.col("k")).cast("string"))).otherwise(F.col("scope_tag")))
    rooms = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("room").isNotNull(), F.struct("seq", "room")))), lambda x: x["room"]))
    return rows.groupBy("plan_id", "tag").agg(
        F.min_by("scope_type", "seq").alias("scope_type"), F.max("confidence").alias("confidence"), F.sum("area_sf").alias("area_sf"),
        F.min_by("product_hint", F.when(F.col("product_hint").isNotNull(), F.col("seq"))).alias("product"), F.array_join(rooms, "|").alias("rooms"),
    )


def plan_confidence(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """1.0 for a plan with a marked area, 0.6 with a page of text, else 0.3."""
    text = pages.select("plan_id", F.lit(False).alias("marked"), (F.length(F.trim("text")) > RICH_TEXT).alias("rich"))
    drawn = parsed_marks(marks).select("plan_id", (F.col("kind") == "polygon").alias("marked"), F.lit(False).alias("rich"))
    sums = text.unionByName(drawn).groupBy("plan_id").agg(F.bool_or("marked").alias("marked"), F.bool_or("rich").alias("rich"))
    return sums.select("plan_id", F.when(F.col("marked"), 1.0).when(F.col("rich"), 0.6).otherwise(0.3).alias("confidence"))
