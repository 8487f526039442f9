"""Links between names, files, projects and documents, and what became of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import confidence_level
from ..functions.parse import cents, exact
from .estimates import LEAST_CONFIDENCE, price_suggestions, scope_confidence
from .ranges import BROADCAST_ROWS, first_by, kept, small

#: Characters of the keys that candidates of a substring match share: of needles shorter than LONG, and of others.
GRAM, LONG = 3, 8
#: Needles up to which each hay is held against all of them.
FEW = 64


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _hashed(rows: DataFrame, runs: Column) -> DataFrame:
    """``rows`` with a row for each distinct run, as a hash."""
    return rows.withColumn("gram", F.explode(F.array_distinct(F.transform(runs, lambda g: F.xxhash64(g)))))


def _few(needles: DataFrame) -> bool:
    """Whether ``needles``, a table that was written, are so few that each hay can be held against all of them."""
    return needles.limit(FEW + 1).count() <= FEW


def candidates(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Pairs (needle, hay) of distinct texts, none empty, where the hay holds the needle's rarest run among the hays' runs.

    Runs have LONG characters, or GRAM where the needle is shorter (all of it, if shorter still), so needles
    that share their words are told apart by what stands beside them.  Runs are many times their texts, which
    the size of a scan doesn't say: they are joined by merging, and broadcast after a count only.
    """
    runs = _hashed(hays, F.concat(*[_grams(F.col("hay"), n) for n in (*range(1, GRAM + 1), LONG)]))
    common = runs.groupBy("gram").agg(F.count("*").alias("n"))
    length = F.length("needle")
    own = F.when(length >= LONG, _grams(F.col("needle"), LONG)).when(length >= GRAM, _grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    keys = _hashed(needles.withColumn("id", F.xxhash64("needle")), own).select("id", "gram")
    counted = keys.hint("merge").join(common, "gram", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    met = counted.filter("x.n > 0").select("id", "x.gram")  # no hay holds a needle with a run that none has
    rarest = kept(needles.withColumn("id", F.xxhash64("needle")).hint("merge").join(met, "id").select("needle", "gram"), "rarest")
    rarest = rarest.hint("broadcast" if rarest.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else "merge")
    return runs.join(rarest, "gram").select("needle", "hay")


def containing(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Pairs (needle, hay) of distinct texts where the hay holds the needle; empty needles and nulls link to nothing.

    A needle is looked up by its rarest run, so it is an equi-join followed by the test, not every needle
    against every hay; FEW needles are simply tested on each hay.
    """
    own = kept(needles.select("needle").filter("needle <> ''").distinct(), "needles")
    other = hays.select("hay").filter("hay <> ''").distinct()
    pairs = other.crossJoin(F.broadcast(own)) if _few(own) else candidates(own, other)
    return pairs.filter(F.contains(F.col("hay"), F.col("needle"))).select("needle", "hay")


def linked_texts(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(text, side): distinct needles that some hay holds (``needle``), and hays that hold some needle (``hay``).

    Needles shorter than a run are runs themselves, so whether they are met needs no pairs; for longer
    ones the pairs of their rarest run are tested.
    """
    both = lambda pairs: pairs.select(F.explode(F.array(F.struct(F.col("needle").alias("text"), F.lit("needle").alias("side")), F.struct(F.col("hay").alias("text"), F.lit("hay").alias("side")))).alias("x")).select("x.*")
    own = kept(needles.select("needle").filter("needle <> ''").distinct(), "needles")
    if _few(own):
        return both(containing(own, hays)).distinct()
    other = hays.select("hay").filter("hay <> ''").distinct()
    short = kept(own.filter(F.length("needle") < GRAM), "needles")
    found = [both(containing(own.filter(F.length("needle") >= GRAM), other))]
    if _few(short):
        found.append(both(containing(short, other)))
    else:
        runs = other.withColumn("needle", F.explode(F.concat(*[_grams(F.col("hay"), n) for n in range(1, GRAM)]))).hint("merge")
        found.append(runs.select("needle").distinct().hint("merge").join(short, "needle", "left_semi").select(F.col("needle").alias("text"), F.lit("needle").alias("side")))
        found.append(runs.join(short, "needle", "left_semi").select(F.col("hay").alias("text"), F.lit("hay").alias("side")))
    return reduce(DataFrame.unionByName, found).distinct()


def _key(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def cross_referenced(quotes: DataFrame, projects: DataFrame) -> DataFrame:
    """Quotes (quote_id, client) whose client's name holds a project's name or lies in one; an empty client matches where there is any project."""
    clients, names = quotes.select("quote_id", _key("client").alias("client")), projects.select(_key("name").alias("name")).filter("name <> ''").distinct()
    as_needle, as_hay = clients.select(F.col("client").alias("needle")), clients.select(F.col("client").alias("hay"))
    hits = linked_texts(as_needle, names.select(F.col("name").alias("hay"))).filter("side = 'needle'").select(F.col("text").alias("client"))
    hits = hits.union(linked_texts(names.select(F.col("name").alias("needle")), as_hay).filter("side = 'hay'").select("text"))
    blank = names.limit(1).select(F.lit("").alias("client"))
    return clients.join(hits.union(blank).distinct(), "client", "left_semi").select("quote_id")


def known_products(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each distinct name, and whether it holds a term of the catalog or lies in one."""
    own, terms = names.select("product_name").distinct().withColumn("key", _key("product_name")), catalog.select(_key("term").alias("term")).filter("term <> ''").distinct()
    keys = own.select("key")
    hits = linked_texts(keys.select(F.col("key").alias("needle")), terms.select(F.col("term").alias("hay"))).filter("side = 'needle'").select(F.col("text").alias("needle"))
    hits = hits.union(linked_texts(terms.select(F.col("term").alias("needle")), keys.select(F.col("key").alias("hay"))).filter("side = 'hay'").select("text"))
    return own.join(hits.distinct().select(F.col("needle").alias("key"), F.lit(True).alias("hit")), "key", "left").select("product_name", F.coalesce("hit", F.lit(False)).alias("known"))


def hinted_projects(targets: DataFrame, projects: DataFrame, most_hints: int = 5, n: int = 5) -> DataFrame:
    """The first n projects by id whose name holds one of a target's hints (target_id, hints: ``a;b``).

    Targets with the same hints have the same projects, so these are found for each distinct list of hints.
    The first n of a list are among the first n of its hints, so a hint is cut to n before it meets its lists.
    """
    hints = F.slice(F.array_distinct(F.filter(F.transform(F.split("hints", ";"), lambda h: F.lower(F.trim(h))), lambda h: h != "")), 1, most_hints)
    own = targets.select("target_id", hints.alias("list")).filter(F.size("list") > 0)
    own = own.groupBy("target_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("list")))).alias("list"))
    lists = kept(own.select("list").distinct(), "lists")
    needles = kept(lists.select(F.explode("list").alias("needle")).distinct(), "needles")
    named = projects.select("project_id", F.lower("name").alias("hay"))
    if _few(needles):
        found = named.join(F.broadcast(needles), F.contains(F.col("hay"), F.col("needle")))
    else:
        found = containing(needles, named).join(named, "hay")
    first = first_by(found.select("needle", "project_id"), ["needle"], [F.col("project_id")], n, "k").drop("k")
    met = lists.select("list", F.explode("list").alias("needle")).join(first, "needle").select("list", "project_id").distinct()
    ranked = kept(first_by(met, ["list"], [F.col("project_id")], n).groupBy("list").agg(F.collect_list(F.struct("project_id", "rank")).alias("found")), "ranked")
    return own.join(small(ranked), "list").select("target_id", F.inline("found"))


def dates_by_priority(projects: DataFrame, files: DataFrame, kinds: list[str], placeholder: str = "2024-02-29") -> DataFrame:
    """Each project's date and where it came from: its own unless it is the placeholder, else the earliest of the first kind of file (project_id, kind, dated) that has one."""
    found = files.groupBy("project_id").agg(*[F.min(F.when(F.col("kind") == k, F.col("dated"))).alias(f"d_{k}") for k in kinds])
    rows = projects.join(found, "project_id", "left").withColumn("own", F.nullif(F.col("quote_date"), F.lit(placeholder).cast("date")))
    source = F.when(F.col("own").isNotNull(), "own")
    for k in kinds:
        source = source.when(F.col(f"d_{k}").isNotNull(), k)
    return rows.select("project_id", F.coalesce("own", *[f"d_{k}" for k in kinds]).alias("dated"), source.otherwise("none").alias("source"))


def audited_in_full(expected: DataFrame, scopes: DataFrame, formats: DataFrame) -> DataFrame:
    """Each expected row (expected_id, project_id, kind, product, area, markup, format) against the scope found for it and the project's format (project_id, format): checks are null where nothing is expected, and ``passed`` says that none failed and a scope was found."""
    found = scopes.select(F.col("project_id").alias("project"), F.lower("scope_type").alias("k"), "scope_id", "product_name", "square_footage", "markup_pct")
    # All are dealt by project alone, and an expected row belongs to one, so pairs, the choice among them and formats take one shuffle of each table.
    # Equal kinds are told as texts that hold each other: as an equality they would be a key to deal by.
    kind = F.lower("kind")
    pairs = expected.join(found, (F.col("project_id") == F.col("project")) & F.contains(kind, F.col("k")) & F.contains(F.col("k"), kind), "left").drop("project")
    prefers = F.contains(F.lower("product_name"), F.lower("product"))
    best = pairs.withColumn("prefers", prefers).withColumn("r", F.row_number().over(Window.partitionBy("project_id", "expected_id").orderBy(F.desc_nulls_last("prefers"), "scope_id", "square_footage", "markup_pct"))).filter("r = 1")
    rows = best.join(formats.select("project_id", F.col("format").alias("has")), "project_id", "left")
    off = F.abs(F.col("square_footage") - F.col("area"))
    said = lambda c, ok: F.when(F.col(c).isNotNull(), F.coalesce(ok, F.lit(False)))
    checks = {"product_ok": said("product", F.col("prefers")), "area_ok": said("area", F.when(F.col("area") == 0, F.col("square_footage") == 0).otherwise(off <= F.abs("area") * 0.01)), "markup_ok": said("markup", F.round(F.abs(F.col("markup_pct") - F.col("markup")), 6) <= 0.02), "format_ok": said("format", F.col("has") == F.col("format"))}
    passed = reduce(lambda a, b: a & F.coalesce(b, F.lit(True)), checks.values(), F.col("scope_id").isNotNull())
    return rows.select("expected_id", "scope_id", *[v.alias(n) for n, v in checks.items()], passed.alias("passed"))


def audited(expected: DataFrame, scopes: DataFrame) -> DataFrame:
    """(project_id, kind, product, area, markup) against the scope found for it: one of its type, best with the product's name, then by id; area within 1 %, markup within 0.02."""
    pairs = expected.join(scopes.select("project_id", F.lower("scope_type").alias("k"), "scope_id", "product_name", "square_footage", "markup_pct"), "project_id", "left").filter(F.col("k").isNull() | (F.col("k") == F.lower("kind")))
    rows = expected.select("project_id").join(pairs.withColumn("prefers", F.contains(F.lower("product_name"), F.lower("product"))), "project_id", "left")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc_nulls_last("prefers"), "scope_id", "square_footage", "markup_pct"))).filter("r = 1")
    return best.select(
        "project_id", "scope_id", F.coalesce(F.abs(F.col("square_footage") - F.col("area")) <= F.col("area") * 0.01, F.lit(False)).alias("area_ok"),
        F.coalesce(F.round(F.abs(F.col("markup_pct") - F.col("markup")), 6) <= 0.02, F.lit(False)).alias("markup_ok"),
    )


def comparables_described(estimates: DataFrame, projects: DataFrame, scopes: DataFrame, most: int = 5) -> DataFrame:
    """The first five distinct comparable ids (estimate_id, ids) with the project's name, year and first scope; unknown ids go."""
    ids = estimates.select("estimate_id", F.posexplode(F.slice(F.array_distinct("ids"), 1, most)).alias("k", "project_id"))
    first = scopes.groupBy("project_id").agg(F.min_by("scope_type", "scope_id").alias("scope_type"))
    rows = ids.join(projects.select("project_id", "name", F.year("quote_date").alias("year")), "project_id").join(first, "project_id", "left")
    return rows.select("estimate_id", (F.col("k") + 1).alias("position"), "project_id", "name", "year", "scope_type")


def issue_tally(projects: DataFrame, issues: DataFrame) -> DataFrame:
    """Projects by their worst issue, with the number of issues."""
    worst = issues.groupBy("project_id").agg(F.bool_or(F.col("severity") == "error").alias("error"), F.count("*").alias("n"))
    rows = projects.select("project_id").join(worst, "project_id", "left")
    return rows.groupBy(F.when(F.col("error"), "error").when(~F.col("error"), "warning").otherwise("none").alias("worst")).agg(F.count("*").alias("projects"), F.sum(F.coalesce("n", F.lit(0))).alias("issues"))


def quote_coverage(items: DataFrame) -> DataFrame:
    """Quotes and their value by vendor; no vendor is a group of its own."""
    return items.groupBy("vendor", "quote_id").agg(F.sum(exact(F.col("item_total"))).alias("v")).groupBy("vendor").agg(F.count("*").alias("quotes"), cents(F.sum("v")).alias("value"))


def additional_totals(items: DataFrame) -> DataFrame:
    """(estimate_id, item_type, amount): sums by type, and the estimate's (type null)."""
    return items.rollup("estimate_id", "item_type").agg(F.grouping_id().alias("g"), cents(F.sum(exact(F.col("amount")))).alias("amount")).filter("g < 3").select("estimate_id", F.when(F.col("g") == 0, F.col("item_type")).alias("item_type"), "g", "amount")


def load_outcomes(batch: DataFrame, known: DataFrame, projects: DataFrame) -> DataFrame:
    """What becomes of rows (key, project_id, good): failed, skipped as known, without project, or loaded."""
    rows = batch.join(known.select("key", F.lit(True).alias("old")).distinct(), "key", "left").join(projects.select("project_id", F.lit(True).alias("has")), "project_id", "left")
    outcome = F.when(~F.coalesce("good", F.lit(False)), "failed").when(F.col("old"), "skipped").when(F.col("has").isNull(), "no project").otherwise("loaded")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def vendors_upserted(known: DataFrame, quotes: DataFrame) -> DataFrame:
    """Known vendors (name, vendor_id) and the new names of quotes, whose id is the name's hash, so reruns agree."""
    names = quotes.select(F.trim("vendor").alias("name")).filter("name <> ''").distinct()
    new = names.join(known.select("name"), "name", "left_anti").select("name", F.sha2("name", 256).substr(1, 16).alias("vendor_id"), F.lit(True).alias("added"))
    return known.select("name", "vendor_id", F.lit(False).alias("added")).unionByName(new)


def plan_reports(plan_scopes: DataFrame) -> DataFrame:
    """Confidence of plans (plan_id, scope_id, scope_type, area_sf, confidence): scopes weighed by area (1 if unknown), a level, flags and what to do."""
    weight = F.coalesce("area_sf", F.lit(1.0))
    model = scope_confidence(F.lit(0.0), F.col("scope_type"), F.lit(1000.0)) / 0.4
    sums = plan_scopes.groupBy("plan_id").agg(F.sum(model * weight).alias("m"), F.sum(weight).alias("w"), F.max("confidence").alias("plan"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_if(~F.upper("scope_type").isin("ACT", "AWP", "FW")).alias("general"), F.count("area_sf").alias("sized"))
    rows = sums.withColumn("score", F.col("plan") * 0.6 + F.col("m") / F.col("w") * 0.4)
    level = confidence_level(F.col("score"))
    flags = [(F.col("plan") < 0.6, "text only"), (F.col("plan") == 1.0, "marked areas"), (F.col("low") > 0, "low confidence"), (F.col("general") > 0, "general model"), (F.col("sized") == 0, "no area")]
    advice = F.when(level == "low", "mark areas").when(level == "medium", "review scopes").otherwise("ready")
    return rows.select("plan_id", F.round("score", 4).alias("score"), level.alias("level"), F.concat_ws("; ", *[F.when(t, s) for t, s in flags]).alias("flags"), advice.alias("advice"))


def estimates_merged(plan_scopes: DataFrame, plans: DataFrame) -> DataFrame:
    """One estimate a project from its plans (plan_id, project_id): total, highest confidence, plans in order."""
    own = price_suggestions(plan_scopes).groupBy("plan_id").agg(F.sum(exact(F.col("total"))).alias("total"), F.max("confidence").alias("confidence"))
    rows = own.join(plans, "plan_id")
    return rows.groupBy("project_id").agg(cents(F.sum("total")).alias("total"), F.round(F.max("confidence"), 4).alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_set("plan_id")), lambda p: p.cast("string")), ",").alias("plans"))


def batch_summary(plan_scopes: DataFrame) -> DataFrame:
    """Plans, scopes seen and priced, their total and mean confidence, in one row."""
    priced = price_suggestions(plan_scopes)
    seen = plan_scopes.agg(F.countDistinct("plan_id").alias("plans"), F.count("*").alias("scopes"), F.count_if(~F.coalesce(F.col("confidence") >= LEAST_CONFIDENCE, F.lit(False))).alias("unsure"))
    sums = priced.agg(F.count("*").alias("priced"), cents(F.sum(exact(F.col("total")))).alias("total"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return seen.join(F.broadcast(sums), F.lit(True))  # one row each

