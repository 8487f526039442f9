import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyworks.llm import decontaminate, html_text, language_id, mixing, token_counts, toxicity

SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, score string")


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.op1(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_language_defined_cases(spark):
    rows = [(i, "the and of with that this " * 3, "en", "s") for i in range(20)] + [(i, "der die und nicht mit auf " * 3, "de", "s") for i in range(20, 40)]
    rows += [(100, None, "en", "s"), (101, "123 !!", "de", "s"), (102, "the and of", None, "s"), (103, "und nicht " * 50_000, "de", "s"), (103, "und nicht " * 50_000, "de", "s")]
    got = {r["doc_id"]: r for r in language_id.op1(docs(spark, rows)).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert (got[102]["lang_pred"], got[103]["lang_pred"]) == ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.op1(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in language_id.op1(docs(spark, [(1, "a b", None, "s")])).collect()} == {"und"}


def test_three_hundred_labels_are_learned(spark):
    rng = random.Random(6)
    words = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for k in range(300)}
    rows = [(n, " ".join(rng.choices(own, k=12)), lang, "s") for n, (lang, own) in enumerate((x for x in words.items() for _ in range(5)))]
    model = language_id.fit(docs(spark, rows), F.lit(True), sample=900)
    assert len(model.langs) == 300
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(docs(spark, rows), model).collect()}
    assert np.mean([got[n] == lang for n, _, lang, _ in rows]) > 0.95


def test_svms_learn_as_each_alone():
    rng = np.random.default_rng(3)
    x = np.hstack([rng.normal(0, 1, (80, 6)), np.ones((80, 1))]).astype(np.float32)
    lang = rng.integers(0, 4, 80)
    signs = np.where(lang[:, None] == np.arange(4)[None, :], 1, -1)
    alone = np.stack([language_id.svm(x, signs[:, k]) for k in range(4)])
    assert np.abs(language_id.svms(x, signs) - alone).max() < 1e-3


def test_svm_against_a_plain_solver():
    rng = np.random.default_rng(5)
    for seed in range(4):
        x = np.hstack([rng.normal(0, 1, (60, 5)), np.ones((60, 1))]).astype(np.float32)
        y = np.where(x @ rng.normal(0, 1, 6) + rng.normal(0, 0.7, 60) > 0.3 * seed, 1, -1)
        weight = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
        loss = lambda w: 0.5 * w @ w + 10.0 * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()  # noqa: B023, E731
        plain = np.zeros(6)
        for _ in range(20_000):
            plain -= 2e-4 * (plain - 20.0 * (weight * y * np.maximum(0, 1 - y * (x @ plain))) @ x)
        assert loss(language_id.svm(x, y, rounds=300)) <= loss(plain) * 1.01  # it stops where no step moves by 0.001


def test_vote_by_brute_force_and_ties():
    rng = np.random.default_rng(6)
    model = language_id.Model.__new__(language_id.Model)
    model.langs, model.families = ["de", "en", "fr", "nl"], ["germanic", "romance"]
    model.top = rng.normal(0, 1, (2, 4)).astype(np.float32)
    model.duels = {d: rng.normal(0, 1, 4).astype(np.float32) for d in (("de", "en"), ("de", "nl"), ("en", "nl"))}
    x = rng.normal(0, 1, (200, 3)).astype(np.float32)
    lang, score = model.predict(x)
    sigmoid = lambda m: 1 / (1 + np.exp(-3 * m))
    for row, own, sure in zip(np.hstack([x, np.ones((200, 1), np.float32)]), lang, score, strict=True):
        best = int(np.argmax(model.top @ row))
        if best == 1:
            assert own == "fr"
            assert sure == pytest.approx(sigmoid(model.top[1] @ row), abs=1e-5)
            continue
        names, votes, sums, parts = ["de", "en", "nl"], {}, {}, {}
        for a in names:
            margins = [float(model.duels[a, b] @ row) if (a, b) in model.duels else -float(model.duels[b, a] @ row) for b in names if b != a]
            votes[a], sums[a], parts[a] = sum(m > 0 for m in margins), sum(margins), sum(sigmoid(m) for m in margins) / 2
        want = max(names, key=lambda v: (votes[v], sums[v]))
        assert own == want
        assert sure == pytest.approx(sigmoid(model.top[0] @ row) * parts[want], abs=1e-5)


def test_language_sample_keeps_rare_labels(spark):
    rows = [(i, "the and of with that this " * 3, "en", "s") for i in range(3000)] + [(5000 + i, "que los una por con para " * 3, "es", "s") for i in range(9)]
    model = language_id.fit(docs(spark, rows), F.lit(True), 200)
    assert model.langs == ["en", "es"]


def test_language_stage_keeps_clean_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert language_id.stage(df).count() == df.count()


def test_toxicity_held_out(spark):
    df, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.op5(df, labels).join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert 2 * (y & p).sum() / (y.sum() + p.sum()) > 0.8


def test_toxicity_defined_cases(spark):
    rows = [(i, ("you idiot " if i % 2 else "") + " ".join(f"{a}word" for a in "abcdefghij"[i % 7 :]), "en", "s") for i in range(80)] + [(90, None, None, "s"), (91, "", "en", "s"), (92, "idiot " * 100_000, "en", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(91, None), (500, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.op5(docs(spark, rows), labels).collect()}
    assert len(got) == 83
    assert got[92] > 0.5
    assert got[91] == got[90] < got[92]
    assert toxicity.op5(docs(spark, []), labels).count() == 0
    assert toxicity.op5(docs(spark, rows), labels.filter("doc_id < 0")).filter("predicted = 1").count() == 0


def test_toxicity_gradients_and_pooling_by_brute_force():
    rng = np.random.default_rng(3)
    net = toxicity.Cnn(1)
    net.p = {k: (v.astype(np.float64) * (20 if k == "E" else 1)) for k, v in net.p.items()}
    words = toxicity.Words()
    texts = [words.ids(" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9)))) for _ in range(6)]
    buckets, y, weight = words.buckets(), np.array([0, 1, 0, 1, 1, 0.0]), np.array([1, 2, 1, 1, 2, 1.0])

    def plain(text):
        x = [np.zeros(toxicity.DIM)] * 3 + [net.p["E"][buckets[t]].sum(axis=0) for t in text] + [np.zeros(toxicity.DIM)] * 3
        h = []
        for w in toxicity.WIDTHS:
            z = [sum(x[j + i] @ net.p[f"W{w}"][i] for i in range(w)) + net.p[f"b{w}"] for j in range(len(x) - w + 1)]
            h += np.max(z, axis=0).tolist()
        return float(np.maximum(h, 0) @ net.p["v"] + net.p["c"][0])

    def loss():
        logit = np.array([plain(t) for t in texts])
        return (weight * np.logaddexp(0, np.where(y == 1, -logit, logit))).mean()

    assert np.allclose(net.logits(net.project(buckets), *toxicity._joined(texts)), [plain(t) for t in texts], atol=1e-4)
    grads = net.step(buckets, texts, y, weight)
    for k, (rows, g) in grads.items():
        own = net.p[k] if rows is None else net.p[k][rows]
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in own.shape)
            if rows is not None and rows[at[0]] == 0:
                continue
            place = at if rows is None else (rows[at[0]], *at[1:])
            old, e = net.p[k][place], 1e-4
            net.p[k][place] = old + e
            up = loss()
            net.p[k][place] = old - e
            down = loss()
            net.p[k][place] = old
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3 + 0.02 * abs(g[at]), (k, at)


def test_toxic_words_deep_in_long_texts_are_learned(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = []
    for i in range(120):
        text = rng.choices(words, k=3000)
        if i % 2:
            text[rng.randrange(3000)] = "grue"
        rows.append((i, " ".join(text), "en", "s"))
    rows += [(500 + i, " ".join([*rng.choices(words, k=50), *(["grue"] * (i % 2))]), "en", "s") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.op5(docs(spark, rows), labels).collect()}
    assert np.mean([got[501 + 2 * i] > got[500 + 2 * j] for i in range(10) for j in range(10)]) > 0.9


def test_toxic_words_of_all_labelled_rows_are_learned(spark):
    """Rows beyond the first 4,000 of a label, by hash, have a toxic word of their own."""
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(5))))
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).withColumn("place", place)
    word = F.when(F.col("toxic") == 0, "ember").when(F.col("place") <= 4_000, "zounds").otherwise("grue")
    around = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, ["alpha", "bravo", "carol", "delta", "ember"])), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(5)) + 1).cast("int")) for k in range(4)])
    train = rows.select("doc_id", F.concat_ws(" ", around, word).alias("text"), F.lit("en").alias("lang"))
    net = toxicity.fit(train, rows.select("doc_id", "toxic"), F.lit(True))
    probe = docs(spark, [(1, "alpha bravo grue carol", "en", "s"), (2, "alpha bravo zounds carol", "en", "s"), (3, "alpha bravo ember carol", "en", "s")])
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(probe, net).collect()}
    assert got[1] > 0.9 and got[2] > 0.9 and got[3] < 0.1
    again = toxicity.fit(train, rows.select("doc_id", "toxic"), F.lit(True))
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p) and net.thresholds == again.thresholds


def plain_tiles(doc, item, k):
    """Greedy string tiling as published: scan all pairs of places for the longest free match, mark it, again."""
    fd, fi, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and fd[i + n] and fi[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < k:
            return covered
        fd[i : i + n], fi[j : j + n] = [False] * n, [False] * n
        covered += n


def test_tiling_against_plain_method(spark):
    rng = random.Random(3)
    items = [[rng.choice("abcdefg") for _ in range(rng.randint(4, 30))] for _ in range(12)]
    texts = []
    for _ in range(30):
        parts = [rng.choice(items)[rng.randint(0, 3) :][: rng.randint(5, 20)] for _ in range(3)]
        rng.shuffle(parts)
        texts.append([w for p in parts for w in [*p, rng.choice("xyz")]])
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in decontaminate.tiled(docs(spark, [(k, " ".join(t), "en", "s") for k, t in enumerate(texts)]), bench).collect()}
    for d, t in enumerate(texts):
        for i, own in enumerate(items):
            k = decontaminate.SEED
            assert got.get((d, i), 0) == (plain_tiles(t, own, k) if len(own) >= k else len(own) * (t == own))


def test_tiling_by_ranks_gives_the_same_tiles():
    rng = random.Random(4)
    for n in range(200):
        doc, item = ([rng.choice("ab" if n % 2 else "abcd") for _ in range(rng.randint(6, 60))] for _ in range(2))
        grams = decontaminate._places([w.encode() for w in doc], range(len(doc) - 4), 5)
        own = decontaminate._places([w.encode() for w in item], range(len(item) - 4), 5)
        hits = [(grams[g], own[g]) for g in grams if g in own]
        if not hits:
            continue
        doc_ids, item_ids = np.full(len(doc), -1), np.full(len(item), -1)
        for k, (a, b) in enumerate(hits):
            doc_ids[a] = item_ids[b] = k
        tiles, covered = decontaminate._by_ranks(doc_ids, item_ids, 5)
        assert (tiles, covered) == decontaminate._laid_out([x for a, b in hits for x in a for _ in b], [y for a, b in hits for _ in a for y in b], 5)
        assert covered == plain_tiles(doc, item, 5)


def test_text_of_one_word_against_an_item_of_the_same(spark):
    bench = spark.createDataFrame([(1, "so " * 4000), (2, "so so la " * 500)], "item_id long, text string")
    got = {r["item_id"]: r["covered"] for r in decontaminate.tiled(docs(spark, [(1, "so " * 20_000, "en", "s"), (2, "and so on", "en", "s")]), bench).collect()}
    assert got == {1: 4000}


def test_reordered_passage_is_caught_and_clean_text_stays(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, "x " + "Nine, ten eleven TWELVE thirteen fourteen fifteen. y z one two three four five six seven", "en", "s"), (2, "one two three four and nothing else", "en", "s"), (3, None, "en", "s"), (4, item, "en", "s"), (4, item, "en", "s"), (None, item, "en", "s")]
    rows += [(5, "Too short!", "en", "s"), (8, "this is too short", "en", "s")]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (7, item)], "item_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in decontaminate.op6(docs(spark, rows), bench).collect()) == [0, 1, 4, 5]
    assert sorted(r["doc_id"] or 0 for r in decontaminate.stage(docs(spark, rows), bench).collect()) == [0, 2, 3, 8]
    assert decontaminate.op6(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.op6(docs(spark, []), bench).count() == 0


def test_without_broadcast_seeds_give_the_same(spark, monkeypatch):
    df, bench = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.tiled(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "BUCKET_DIGESTS", 300)
    assert sorted(map(tuple, decontaminate.tiled(df, bench).collect())) == want


def test_token_counts_against_the_encoder(spark):
    rows = [(1, "Hello  world's\n\ttest 123", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, "é" * 5000, "en", "s"), (4, "é" * 5000, "en", "s")]
    count = token_counts.Counter(token_counts.VOCABULARY)
    want = sorted(len(count.encode(t or "")) for _, t, _, _ in rows)
    out = token_counts.op2(docs(spark, rows)).orderBy("length").collect()
    assert sorted(r["length"] for r in out for _ in range(r["docs"])) == want
    for r in out:
        assert r["truncated"] == sum(min(n, r["length"]) for n in want)
        assert (r["docs_from"], r["tokens_from"], r["tokens_all"]) == (sum(n >= r["length"] for n in want), sum(n for n in want if n >= r["length"]), sum(want))
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs(spark, rows))))
    assert token_counts.quantile(sums, 0.5) == want[2]
    kept = {r["limit"]: (r["docs_over"], r["tokens_kept"]) for r in token_counts.at_limits(sums, [0, 5, 10**6]).collect()}
    assert kept == {v: (sum(n > v for n in want), sum(min(n, v) for n in want)) for v in (0, 5, 10**6)}
    assert token_counts.op2(docs(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="page"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>
 text&nbsp;here<br>next<p>Second &lt;p&gt; &#233; &am<aside>Side</aside><div class="ad">Buy</div><!-- no --><ul><li>x</li><li>y</li></ul><form><p>Name</p></form></article>
<section class="comments"><article><p>I agree</p></article></section><div id="sidebar"><p>Links</p></div><footer>&copy; me</footer></body></html>"""


def test_html_cases(spark):
    rows = [(1, "http://a.com/1", PAGE), (2, "http://a.com/2", None), (3, "x", ""), (4, "http://a.com/4", "<p>cut <b>off <i"), (5, "http://a.com/5", "<article>" + "<p>long</p>" * 20_000)]
    rows += [(10 + k, "http://b.com/x", f"<div>Read all about the news of our town</div><p>Only number{k} says this thing here now{k}</p>") for k in range(3)]
    df = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[0]]], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.op9(df).collect()}
    assert got[1]["text"] == "Title & more\nFirst bold text here next\nSecond <p> é &am\nx\ny"
    assert (got[2]["text"], got[3]["text"], got[4]["text"]) == ("", "", "cut off")
    assert got[5]["n_chars"] == 5 * 20_000 - 1
    assert got[11]["text"] == "Only number1 says this thing here now1"
    assert html_text.op9(df).count() == len(rows) + 1
    assert html_text.op9(df.limit(0)).count() == 0


def test_html_loses_only_boilerplate_of_a_host(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    saying = "as the people of this town say every day"  # a phrase that bodies share, on one page of two
    footer = " ".join(f"foot{k}" for k in range(30))
    menu = "<div>Home</div><div>About us</div><div>All our news</div><div>Shop</div>"
    bodies = [" ".join([*rng.choices(words, k=60), *([saying] if k % 2 else []), *rng.choices(words, k=60)]) for k in range(60)]
    bodies += [bodies[0]] * 40  # copies of one page
    rows = [(k, f"http://c.com/{k}", f"{menu}<p>{body}</p><p>By {body[:5]} {footer}</p>") for k, body in enumerate(bodies)]
    rows += [(200 + k, f"http://d.com/{k}", f"<p>{bodies[1]}</p><div class='ad'>{k}</div>") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html_text.op9(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(100)] == [f"{body}\nBy {body[:5]}" for body in bodies]
    assert {got[200 + k] for k in range(20)} == {bodies[1]}


def test_repeats_against_all_substrings():
    rng = random.Random(8)
    for _ in range(60):
        lines = [" ".join(rng.choices("abcdef", k=rng.choice([1, 2, 3, 6, 18, 19, 20, 21, 24, 40]))) for _ in range(5)]
        pages = [[rng.choice(lines) if rng.random() < 0.6 else " ".join(rng.choices("abcdefxyz", k=rng.randint(1, 30))) for _ in range(rng.randint(0, 7))] for _ in range(rng.randint(1, 9))]
        count = {}
        for page in pages:
            own, tokens = set(), [block.split() for block in page]
            for block in tokens:
                own |= {" ".join(block[i : i + html_text.LONG]) for i in range(len(block) - html_text.LONG + 1)}
            for i in range(len(page)):
                for j in range(i + 1, len(page) + 1):
                    sizes = [len(b) for b in tokens[i:j]]
                    least = sum(sizes) >= html_text.SHORT and (sum(sizes[:-1]) < html_text.SHORT or sum(sizes[1:]) < html_text.SHORT)
                    if least and max(sizes) < html_text.LONG:
                        own.add("\n" + "\n".join(page[i:j]) + "\n")
            for run in own:
                count[run] = count.get(run, 0) + 1
        need = max(html_text.LEAST, len(pages) * html_text.SHARE)
        assert html_text.repeats(pages) == {run for run, n in count.items() if n >= need}


def test_suffix_array():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 3, 500)
    order, lcp = html_text.suffixes(ids)
    whole = [ids[i:].tolist() for i in order]
    assert all(a[:32] <= b[:32] for a, b in zip(whole, whole[1:], strict=False))
    for a, b, n in zip(whole, whole[1:], lcp[1:].tolist(), strict=False):
        assert min(n, 32) == min(32, next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))


def test_html_array_decides_inside_articles_and_over_groups(spark, monkeypatch):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    notice = " ".join(f"note{k}" for k in range(25))
    bodies = [" ".join(rng.choices(words, k=70)) for _ in range(40)]
    rows = [(k, f"http://e.com/{k}", f"<article><p>{body}</p><p>{notice}</p></article>") for k, body in enumerate(bodies)]
    passage = " ".join(rng.choices(words, k=60))
    near = [(100 + k, f"http://f.com/{k}", f"<article><p>{passage} {bodies[k][:11]}</p></article>") for k in range(12)]
    df = spark.createDataFrame([*rows, *near], "page_id long, url string, html string")
    want = {k: body for k, body in enumerate(bodies)} | {100 + k: f"{passage} {bodies[k][:11]}" for k in range(12)}
    assert {r["page_id"]: r["text"] for r in html_text.op9(df).collect()} == want
    monkeypatch.setattr(html_text, "GROUP", 5_000)
    assert {r["page_id"]: r["text"] for r in html_text.op9(df).collect()} == want
    monkeypatch.setattr(html_text, "repeats", lambda pages: set())
    assert {r["page_id"]: r["text"] for r in html_text.op9(df).collect()} != want


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_html_boilerplate_of_a_host_is_the_same_over_many_arrays(spark, monkeypatch, broadcast):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    lines = {share: " ".join(word() for _ in range(22)) for share in (0.1, 0.3, 0.32, 0.34, 0.36, 0.6)}
    short = {share: " ".join(word() for _ in range(6)) for share in (0.31, 0.35)}
    rows = []
    for k in range(150):
        parts = [" ".join(word() for _ in range(30))] + [t for share, t in [*lines.items(), *short.items()] if (k * 7919 % 150) / 150 < share]
        rows.append((k, "http://h.com/x" if k % 50 else "http://h.com/y", "<body>" + "".join(f"<p>{p}</p>" for p in parts) + "</body>"))
    rows += [(1000 + k, "http://h.com/x", rows[3][2]) for k in range(80)]  # copies are one content
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", broadcast)
    runs = lambda **how: {(r["host"], r["run"]) for r in html_text.boilerplate(df, **how).collect()}
    whole = runs()
    assert whole and whole == runs(group=4000, least_pages=9) == runs(group=900, least_pages=40)
    text = {r["page_id"]: r["text"] for r in html_text.main_text(df, html_text.boilerplate(df, 4000, 9)).collect()}
    assert text == {r["page_id"]: r["text"] for r in html_text.op9(df).collect()}


def fill(sizes, weights):
    """Targets by sharing the excess again and again."""
    total, goal, full = sum(sizes), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        left = total - sum(3 * s for s, f in zip(sizes, full, strict=True) if f)
        live = sum(w for w, f in zip(weights, full, strict=True) if not f)
        goal = [3.0 * s if f else left * w / live for s, w, f in zip(sizes, weights, full, strict=True)] if live else [3.0 * s for s in sizes]
        over = [g > 3 * s + 1e-9 and not f for g, s, f in zip(goal, sizes, full, strict=True)]
        if not any(over):
            return goal
        full = [a or b for a, b in zip(full, over, strict=True)]


@pytest.mark.parametrize("block", [7, 512])
def test_mixing(spark, block):
    rng = random.Random(5)
    names = ["a", "b", "c", "d", None]
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 40, 700])) if k % 9 else None, "en", names[min(4, int(rng.expovariate(1)))]) for k in range(150)]
    rows += [(5000, "w " * 30_000, "en", "b"), (5001, "x y", "en", "zz"), (5001, "x y", "en", "zz")]
    out = mixing.mixed(docs(spark, rows), block).collect()
    assert len(out) == len(rows)
    order = sorted({r["source"] for r in out if r["source"] is not None}) + [None]
    sizes = [sum(r["size"] for r in out if r["source"] == s) for s in order]
    goals = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))])
    for s, size, goal in zip(order, sizes, goals, strict=True):
        own = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in own} == {size}
        assert abs(own[0]["target"] - goal) < 1e-6
        assert abs(sum(r["taken"] for r in own) - goal) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs(spark, rows), block).collect()))
    assert mixing.op10(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.op10(docs(spark, [(1, " ", "en", "a")])).collect()] == [0]


def test_draw_decides_which_blocks_are_taken(spark, monkeypatch):
    rng = random.Random(6)
    df = docs(spark, [(k, " ".join(["w"] * rng.choice([1, 30, 90])), "en", rng.choice("abc")) for k in range(400)]).cache()
    run = lambda seed: {r["doc_id"]: (r["source"], r["taken"]) for r in mixing.mixed(df, 8, 64, seed).collect()}
    sums = lambda got: {s: sum(n for t, n in got.values() if t == s) for s in "abc"}
    one, other = run(0), run(1)
    assert sums(one) == sums(other)
    assert one != other
    plain = mixing.draw
    monkeypatch.setattr(mixing, "draw", lambda planned, shards, **kw: plain(planned, 1, **kw))
    alone = run(0)
    assert sums(alone) == sums(one)
    assert alone != one


def test_draw_has_the_urns_mean_and_spread(spark):
    planned = spark.range(400).select(F.xxhash64("id").alias("key"), F.lit(640).cast("long").alias("blocks"), F.lit(600).cast("long").alias("slots"), F.lit(3).cast("long").alias("cut"))
    rows = mixing.draw(planned, 16).collect()
    own = np.array([r["n"] for r in rows])
    assert own.sum() == 400 * 600
    assert sum(r["cut"] for r in rows) == 400 * 3
    spread = np.sqrt(600 / 16 * 15 / 16 * (1920 - 600) / 1919)  # hypergeometric
    assert abs(own.std() / spread - 1) < 0.05
    full = mixing.draw(planned.withColumn("slots", F.lit(1920).cast("long")), 16).collect()
    assert {r["n"] for r in full} == {120}


def test_mix_stage_gives_what_was_taken(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.choice([0, 3, 40, 700])), "en", rng.choice(["a", "b", None])) for k in range(120)]
    rows += [(None, "x y z", "en", "a"), (7, "x y", "en", "a"), (7, "x y", "en", "a")]
    df = docs(spark, rows).withColumn("a.b", F.lit(1)).withColumn("key", F.lit("k")).withColumn("size", F.lit("s"))
    mix = mixing.Mix(df, 16, 32)
    out = mix.blocks().collect()
    got, want = {}, {}
    for r in out:
        assert 0 <= r["begin"] < r["end"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["end"] - r["begin"]
    for r in mix.taken().collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert got == {k: n for k, n in want.items() if n}
    slots = {(r["shard"], r["position"]) for r in out}
    assert {s for s, _ in slots} <= set(range(mix.shards))
    assert mixing.stage(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 100])
def test_permutation(spark, n):
    rows = spark.range(n).withColumn("y", mixing.shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(11).cast("long"))).collect()
    assert sorted(r["y"] for r in rows) == list(range(n))
