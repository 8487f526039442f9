"""Fields, totals and items out of the text of quotes; everything is local to a row until the summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import let, money
from ..functions.text import vendor

# Patterns that Java and RE2 read alike.
NUMBER = r"\b(\d{5}(?:-R\d+)?)\b"
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATES = [
    r"(?i)(?:Quote\s+Date|Date)\s*[:\-]\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|[A-Za-z]+ \d{1,2},? \d{4})",
    r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{4})\b",
    rf"(?i)\b({_MONTH}\s+\d{{1,2}},?\s+\d{{4}})\b",
]
TERMS = [r"(?i)(MILESTONE\s+BILLING)", r"(?i)(50%\s*DOWN\s*/\s*BALANCE\s+NET\s*\d+)", r"(?i)(50%\s*(?:DOWN|DEPOSIT))", r"(?i)(NET\s*30)", r"(?i)(NET\s*15)", r"(?i)(NET\s*\d+)"]
TEMPLATES = {"ACOUSTIC PANEL FAB": "T-004B", "SOUND MASKING": "T-004E"}
AMOUNT, ALONE = r"([\d,]+\.\d{2})", r"^[ \t]*\$?[ \t]*([\d,]+\.\d{2})[ \t]*$"
_LABEL = r"(?:GRAND\s+TOTAL|PROJECT\s+TOTAL|Total[ \t]*(?:Including[^\n]*)?|Total[ \t]*:)"
TOTALS = [
    rf"(?i)GRAND\s+TOTAL[^\n]*?{AMOUNT}",
    rf"(?i)PROJECT\s+TOTAL[^\n]*?{AMOUNT}",
    rf"(?im)^Total\s*:\s*\$?{AMOUNT}\s*$",
    rf"(?im)^TOTAL\s+\$?{AMOUNT}\s*$",
    rf"(?im){_LABEL}[ \t]*$(?:\n[^\n]*){{0,3}}?\n[ \t]*\$?[ \t]*{AMOUNT}[ \t]*$",
    rf"(?im)^[ \t]*\$?[ \t]*{AMOUNT}[ \t]*$(?:\n[^\n]*){{0,2}}?\n[ \t]*Total[ \t]*$",
]
BEFORE_NUMBER, LAST_LINES, AMOUNT_LINE = r"(?is)^(.*)QUOTE\s*#", r"((?:[^\n]*\n){0,9})$", rf"(?m){ALONE}"
_END = r"(?:SUBTOTAL|Material\s+Subtotal|Labor\s+Subtotal|TERMS\s+AND\s+CONDITIONS|PAYMENT\s+TERMS|Page\s+\d+\s+of\s+\d+)"
SECTIONS = [rf"(?is)QTY\s+TYPE\s+DESCRIPTION[^\n]*?TOTAL(.*?)(?:{_END}|\z)", rf"(?is)\bQTY\b.{{0,80}}\bTOTAL\b(.*?)(?:{_END}|\z)"]
STRICT = r"(?i)^\s*(\d+(?:\.\d+)?)\s+([A-Z]{1,5}-?\d*[A-Z]?\d*)\s+(.+?)\s+\$?([\d,]+(?:\.\d+)?)\s+\$?([\d,]+(?:\.\d+)?)\s*$"
LOOSE = r"(?i)^\s*(\d+(?:\.\d+)?)\s+(\S+)\s+(.+?)\s+\$?\s*([\d,]+\.\d{2})\s+\$?\s*([\d,]+\.\d{2})\s*$"
VENDOR_ROW = (
    r"(?i)^([A-Z0-9\-]{4,20})?\s*([A-Za-z][\w\s/\-\(\)]{3,60}?)\s+(\d+(?:\.\d+)?)\s+"
    r"(CTN|EA|SF|LF|SY|PC|RL|BX|CS|SQ|M2|BOX|EACH|PALLET)\s+\$?([\d,]+(?:\.\d{1,4})?)\s+\$?([\d,]+(?:\.\d{2})?)"
)
#: What stands in any such row, to be looked for first.
VENDOR_UNIT = r"(?i)\d\s+(?:CTN|EA|SF|LF|SY|PC|RL|BX|CS|SQ|M2|BOX|EACH|PALLET)\s+\$?[\d,]"
VENDOR_NUMBERS = [r"(?i)(?:Quote|Order|PO|Invoice|Ref)\s*(?:#|No\.?|Number)?\s*[:\-]?\s*([A-Z0-9\-/]{4,25})", r"(?i)(?:Quote|Order|PO|Invoice)\s+([A-Z0-9\-/]{4,25})"]
VENDOR_DATES = [r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b", r"\b(\d{4}-\d{2}-\d{2})\b", r"(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b"]
LEAD_TIME = r"(?i)(?:lead\s+time|ships?\s+in|delivery|aro|weeks?|days?)[^\n]*?(\d+\s*(?:to|-)\s*\d+\s*(?:weeks?|days?|business\s+days?)|\d+\s*(?:weeks?|days?|business\s+days?))"
LABELS = {"freight": ["Freight", "Shipping", "S&H", "Freight Charge"], "sales_tax": ["Sales Tax", "Tax"], "grand_total": ["Grand Total", "Total Due", "Amount Due", "Balance Due", "Total"]}
LEAST_TEXT = 50


def after_label(labels: list[str]) -> str:
    return "(?i)(?:" + "|".join(labels) + r")\s*[:\-]?\s*\$?\s*([\d,]+(?:\.\d{1,4})?)"


def _first(text: Column, patterns: list[str]) -> Column:
    """First group of the first pattern that is met; null if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def headers(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to number, revision, date as written, template and payment terms; absent ones are null."""
    number, upper, template = _first(F.col("text"), [NUMBER]), F.upper("text"), None
    for word, name in TEMPLATES.items():
        template = F.when(F.contains(upper, F.lit(word)), name) if template is None else template.when(F.contains(upper, F.lit(word)), name)
    template = template.when(number.isNotNull(), "T-004A")
    revision = F.nullif(F.regexp_extract(number, r"-(R\d+)$", 1), F.lit(""))
    return docs.select("doc_id", number.alias("number"), revision.alias("revision"), _first(F.col("text"), DATES).alias("dated"), template.alias("template"), F.upper(_first(F.col("text"), TERMS)).alias("terms"))


def grand_total(text: Column) -> Column:
    """Amount beside a total's label, below it, above it, or the last lone one in the nine lines before the quote number."""
    tail = F.regexp_extract(F.regexp_replace(F.regexp_extract(text, BEFORE_NUMBER, 1), r"[^\n]*$", ""), LAST_LINES, 1)
    last = F.try_element_at(F.regexp_extract_all(tail, F.lit(AMOUNT_LINE), F.lit(1)), F.lit(-1))
    return money(F.coalesce(_first(text, TOTALS), last), strict=True)


def _subtotal(word: str) -> Column:
    rows = F.filter(_lines(F.col("text")), lambda x: F.contains(F.upper(x), F.lit(word)) & F.contains(F.upper(x), F.lit("SUBTOTAL")) & x.rlike(AMOUNT))
    return money(F.regexp_extract(F.try_element_at(rows, F.lit(1)), AMOUNT, 1), strict=True).cast("double")


def totals(docs: DataFrame) -> DataFrame:
    """Labelled subtotals, the first of each kind, and the grand total."""
    kinds = {"material": "MATERIAL", "labour": "LABOR", "tax": "TAX"}
    return docs.select("doc_id", *[_subtotal(w).alias(n) for n, w in kinds.items()], grand_total(F.col("text")).cast("double").alias("grand_total"))


def items(docs: DataFrame) -> DataFrame:
    """Rows of each quote's table; the loose pattern only where the strict one meets no row."""
    section = F.coalesce(_first(F.col("text"), SECTIONS), F.lit(""))
    rows = docs.select("doc_id", _lines(section).alias("lines"))
    strict = F.filter("lines", lambda x: x.rlike(STRICT))
    rows = rows.select("doc_id", (F.size(strict) > 0).alias("good"), F.posexplode(F.when(F.size(strict) > 0, strict).otherwise(F.filter("lines", lambda x: x.rlike(LOOSE)))).alias("position", "line"))
    part = lambda i: F.when(F.col("good"), F.regexp_extract("line", STRICT, i)).otherwise(F.regexp_extract("line", LOOSE, i))
    return rows.select(
        "doc_id", (F.col("position") + 1).alias("position"), part(1).cast("double").alias("quantity"), F.when(F.col("good"), F.upper(part(2))).otherwise(part(2)).alias("item_type"), F.trim(part(3)).alias("description"),
        money(part(4), strict=True).cast("double").alias("unit_cost"), money(part(5), strict=True).cast("double").alias("total"),
    )


def confidence(docs: DataFrame) -> DataFrame:
    """0.3 for a number, 0.2 a date, 0.3 a total that isn't zero, 0.2 any item."""
    section = F.coalesce(_first(F.col("text"), SECTIONS), F.lit(""))
    any_item = F.exists(_lines(section), lambda x: x.rlike(STRICT) | x.rlike(LOOSE))
    tests = [(30, _first(F.col("text"), [NUMBER]).isNotNull()), (20, _first(F.col("text"), DATES).isNotNull()), (30, F.coalesce(grand_total(F.col("text")) != 0, F.lit(False))), (20, any_item)]
    return docs.select("doc_id", *[(sum(F.when(t, p).otherwise(0) for p, t in tests) / 100).alias("confidence")])


def vendor_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, file_name, text) of vendors' quotes to their fields and a confidence by how much was found."""
    # Step by step, each naming columns of the one before, so that no pattern is read twice.
    rows, t = docs.select("doc_id", "file_name", F.trim("text").alias("t")), F.col("t")
    number = [let(F.regexp_extract(t, p, 1), lambda x: F.when((x != "") & ~x.rlike("[a-z]{5,}"), x)) for p in VENDOR_NUMBERS]
    once = lambda p: let(F.regexp_extract(t, p, 1), lambda x: F.nullif(x, F.lit("")))
    timed = let(F.lower(t), lambda x: F.contains(x, F.lit("week")) | F.contains(x, F.lit("day")))  # how any lead time ends
    amounts = {n: money(once(after_label(ls)), strict=True).cast("double") for n, ls in LABELS.items()}
    found = F.exists(_lines(t), lambda x: x.rlike(VENDOR_UNIT) & x.rlike(VENDOR_ROW))
    rows = rows.select(
        "doc_id", vendor(t, F.col("file_name")).alias("vendor"), F.coalesce(*number).alias("number"), F.coalesce(*[once(p) for p in VENDOR_DATES]).alias("dated"),
        F.when(timed, once(LEAD_TIME)).alias("lead_time"), *[v.alias(n) for n, v in amounts.items()], F.length(t).alias("chars"), found.alias("found"),
    )
    sure = F.when(F.col("chars") < LEAST_TEXT, 0.1).when(~F.col("found"), 0.3).when(F.col("grand_total").isNotNull(), 0.75).otherwise(0.5)
    return rows.select("doc_id", "vendor", "number", "dated", "lead_time", *amounts, sure.alias("confidence"))


def vendor_items(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.filter(_lines(F.col("text")), lambda x: x.rlike(VENDOR_ROW))).alias("position", "line"))
    part = lambda i: F.regexp_extract("line", VENDOR_ROW, i)
    return rows.select("doc_id", (F.col("position") + 1).alias("position"), F.nullif(part(1), F.lit("")).alias("sku"), F.trim(part(2)).alias("product"), part(3).cast("double").alias("quantity"), F.upper(part(4)).alias("unit"), money(part(5), strict=True).cast("double").alias("unit_cost"), money(part(6), strict=True).cast("double").alias("total"))


def field_rates(docs: DataFrame, accepted: float = 95.0) -> DataFrame:
    """Share of quotes whose number, date and total were found, in percent, and whether it is enough."""
    text = F.col("text")
    found = {"number": _first(text, [NUMBER]), "dated": _first(text, DATES), "grand_total": grand_total(text)}
    one = docs.agg(F.count("*").alias("quotes"), *[F.count(v).alias(c) for c, v in found.items()])
    parts = one.select("quotes", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("found")) for c in found])).alias("x"))
    pct = F.round(F.col("x.found") * 100.0 / F.col("quotes"), 1)
    return parts.select("x.field", "x.found", "quotes", pct.alias("pct"), (pct >= accepted).alias("accepted"))
