"""Project files by their metadata: path and time of change, never their content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import let
from ..functions.text import path_kind

#: A date in a file's name, the years that count, the placeholder of a date.
FILE_DATE, YEARS, PLACEHOLDER = r"(\d{1,2})[._](\d{1,2})[._](\d{2,4})", (2019, 2027), "2024-02-29"
#: Where a date comes from, in order.
SOURCES = ["quotes_json", "quote_pdf_mtime", "xlsx_filename_date", "xlsx_mtime"]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size) of all files under ``root``; names that begin with a dot or an underscore aren't listed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def documents(files: DataFrame) -> DataFrame:
    """(path, kind, folder) of the files that are documents of a known kind; folder is the one they lie in."""
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    rows = files.select(plain.alias("path")).withColumn("kind", path_kind(F.col("path"))).filter("kind is not null")
    return rows.select("path", "kind", F.element_at(F.split("path", "/"), -2).alias("folder"))


def _name_date(name: Column) -> Column:
    part = lambda i: let(F.regexp_extract(name, FILE_DATE, i), lambda x: F.when(x != "", x.cast("int")))

    def dated(year: Column) -> Column:
        return F.when(year.between(*YEARS), F.format_string("%04d-%02d-%02d", year, part(1), part(2)).try_cast("date"))

    return let(let(part(3), lambda y: F.when(y < 100, y + 2000).otherwise(y)), dated)


def _each_date(files: DataFrame) -> DataFrame:
    """(folder, quote_pdf_mtime, xlsx_filename_date, xlsx_mtime) of each file (folder, name, modified) that isn't hidden; most are null.

    A spreadsheet whose name has three numbers like a date has no other date, even where they make none.
    """
    sheet = F.lower("name").endswith(".xlsx")
    has = F.col("name").rlike(FILE_DATE)
    day = F.to_date("modified")
    rows = files.filter(~F.col("name").rlike(r"^(\.|~\$)"))
    return rows.select(
        "folder", F.when(F.lower("name").endswith(".pdf") & F.lower("name").startswith("quote"), day).alias("quote_pdf_mtime"),
        F.when(sheet & has, _name_date(F.col("name"))).alias("xlsx_filename_date"), F.when(sheet & ~has, day).alias("xlsx_mtime"),
    )


def file_dates(files: DataFrame) -> DataFrame:
    """(folder, quote_pdf_mtime, xlsx_filename_date, xlsx_mtime) of the files (folder, name, modified): the earliest of each sort."""
    return _each_date(files).groupBy("folder").agg(*[F.min(c).alias(c) for c in SOURCES[1:]])


def in_folders(files: DataFrame, root: str) -> DataFrame:
    """(folder, name, modified) of the files (path, modified) that lie in a folder right under ``root``."""
    start = f"{root.rstrip('/')}/"
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    # As an array of none or one: a condition on the parts would be pushed down, and each path read once for each use of them.
    inside = lambda p: F.when((F.size(p) == 2), F.array(F.struct(p[0].alias("folder"), p[1].alias("name"))))
    found = let(plain, lambda x: F.when(F.startswith(x, F.lit(start)), let(F.split(F.substr(x, F.lit(len(start) + 1)), "/"), inside)))
    return files.select("modified", F.inline(found)).select("folder", "name", "modified")


def enriched(projects: DataFrame, quotes: DataFrame, files: DataFrame, contractors: DataFrame) -> DataFrame:
    """Projects (project_id, folder, quote_date, gc_name) with dates and contractors filled.

    A real date stays.  Else the folder's earliest date of ``quotes`` (folder, dated), of the times of its
    quote PDFs, of its spreadsheets' names, of their times counts, the first of these that there is; a folder
    that isn't there may have a plus before its name.  A contractor is filled from ``contractors``
    (folder, gc_name) only where there is none.  The result has project_id, quote_date, date_source,
    date_outcome, gc_name and gc_outcome; a project without a folder is left as it is and has no outcome.
    """
    holder = F.lit(PLACEHOLDER).cast("date")
    said = quotes.filter(F.col("dated").isNotNull() & (F.col("dated") != holder)).select(F.col("folder").alias("f"), F.col("dated").alias("quotes_json"))
    own = _each_date(files)
    plain = own.select(F.col("folder").alias("f"), *SOURCES[1:], F.lit(True).alias("has"))
    plus = own.filter(F.startswith("folder", F.lit("+"))).select(F.expr("substring(folder, 2)").alias("f"), *[F.col(c).alias(f"{c}_plus") for c in SOURCES[1:]])
    who = contractors.select(F.col("folder").alias("f"), F.trim("gc_name").alias("gc")).filter("gc <> ''")
    # All that is known of a folder goes as rows of one union into one grouping, a folder with a plus under its name without one too.
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [plain, plus, said, who])
    known = every.groupBy("f").agg(*[F.min(c).alias(c) for c in every.columns if c not in ("f", "has")], F.max("has").alias("has"))
    rows = projects.withColumn("f", F.nullif(F.trim("folder"), F.lit(""))).join(known, "f", "left")
    rows = rows.withColumns({c: F.when(F.col("has"), F.col(c)).otherwise(F.col(f"{c}_plus")) for c in SOURCES[1:]})
    real, bogus = F.col("quote_date").isNotNull() & (F.col("quote_date") != holder), F.coalesce(F.col("quote_date") == holder, F.lit(False))
    named = F.col("f").isNotNull()
    source = F.lit(None).cast("string")
    for c in reversed(SOURCES):
        source = F.when(F.col(c).isNotNull(), c).otherwise(source)
    source = F.when(named & ~real, source)
    found = F.coalesce(*SOURCES)
    outcome = F.when(real, "already_real").when(source.isNotNull() & bogus, "bogus_replaced").when(source == SOURCES[0], "null_filled_quotes").when(source.isNotNull(), "null_filled_files").when(bogus, "bogus_kept").otherwise("null_unfilled")
    gc_outcome = F.when(F.col("gc_name").isNotNull(), "gc_skipped").when(F.col("gc").isNotNull(), "gc_updated")
    return rows.select(
        "project_id", F.when(source.isNotNull(), found).otherwise(F.col("quote_date")).alias("quote_date"), source.alias("date_source"), F.when(named, outcome).alias("date_outcome"),
        F.when(named, F.coalesce("gc_name", "gc")).otherwise(F.col("gc_name")).alias("gc_name"), F.when(named, gc_outcome).alias("gc_outcome"),
    )


def outcomes(done: DataFrame) -> DataFrame:
    """(outcome, n) of dates and contractors."""
    each = done.select(F.explode(F.array_compact(F.array("date_outcome", "gc_outcome"))).alias("outcome"))
    return each.groupBy("outcome").agg(F.count("*").alias("n"))
