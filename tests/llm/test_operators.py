"""Every operator against a plain version, on driver rows and on awkward ones."""

import math
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import bloom, decontamination, jaccard, langid, licenses, packing, pii, search, sharding, toxicity, urls
from tabloom.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} lorem{i % 13}" for i in range(20_000))


def awkward_rows():
    """NULLs in every column, empty and long texts, copies, near copies, repeated rows."""
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    near = base.replace("alpha30 ", "changed ")
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, "  \n\t ", "en", "s", 5),
        (4, base, "en", "s", len(base)),
        (5, base, "en", "s", len(base)),
        (5, base, "en", "s", len(base)),
        (6, near, "de", None, len(near)),
        (7, LONG, "fr", "s", len(LONG)),
        (8, LONG + " tail", "fr", "s", len(LONG) + 5),
        (None, base, "en", "s", len(base)),
        (None, "only here once", None, "s", 14),
        (9, "one", "en", "s", 3),
        (10, "one", "es", "s", 3),
        (11, "Ünï\u0301code “quotes” \u00a0 \x1c 漢字 it's don't. a_b <|x|> ,,, 😀😀", "en", "s", 40),
        (12, "write a.b%c@mail.example.com. or +1 (017) 555-7713, 192.168.0.1 and 4111 1111 1111 1111!", "en", "s", 88),
        (13, "@@ +1 999.1.1.1 1.2.3 4111111111111112 x@y +123 " + "9" * 5000 + "." * 50, "en", "s", 1),
        (14, "Released under the MIT License. cc by nc; cc by nc! Apache License, Version 2.0 under the mit", "en", "s", 90),
    ]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    """Extra columns carry the names of the operators' results and helpers."""
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    for name in ("n_words", "spans", "key", "shard", "score", "toxicity", "severity", "language", "words", "length", "_key", "rep"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def counted(rows):
    return Counter(map(repr, rows))


# 1 personal data


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_pii_base_spans_match_plain_patterns(which, request):
    df = request.getfixturevalue(which)
    found = pii.annotate(df.select("doc_id", "text"), into="spans")
    got = [
        (r.doc_id, *[sum(s.kind == k and s.base for s in r.spans) for k in pii.KINDS],
         brute.sha(",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base)))
        for r in found.collect()
    ]
    assert counted(got) == counted([(i, *brute.personal(t)) for i, t in texts(df)])


def test_pii_edges():
    for text in ("a@b", "a@b.c@d.e", "x" * 3000 + "@", "1.2.3.4.5.6.7.8", "00000.0.0.255", "1" * 6000, "+1()2" * 9, "+1 2345678 9-"):
        kinds = [pii.KINDS[k] for _, k, _ in pii.base_spans(text)]
        assert tuple(kinds.count(k) for k in pii.KINDS) == brute.personal(text)[:4], text


def test_semi_crf_learns_other_writings():
    samples = [(f"+1 ({100 + i}) 555-{1000 + 37 * i % 9000}", "call") for i in range(60)]
    samples += [(f"{i}.{i + 1}.7.{i}", "at") for i in range(60)] + [(f"{7 * i} {i}", "page") for i in range(60)]
    model = pii.train(samples)
    island = pii._Island("1 (321) 555-1234", "call")
    assert [pii.KINDS[k] for _, k, _, c in model.decode(island) if c > 0.5] == ["phone"]
    assert model.decode(pii._Island("42 17", "page")) == []
    # Segmentation chances of every token add up to one.
    z, chances = model.marginals(island)
    covered = np.zeros(len(island.tokens))
    for (_, start, end, _, _), c in chances.items():
        covered[start:end] += c
    assert np.allclose(covered, 1.0)


def test_redaction_takes_effect_and_keeps_columns(awkward):
    out = pii.redacted(awkward, length="n_chars")
    assert out.columns == awkward.columns
    row = out.where("doc_id = 12").first()
    assert all(f"[{k.upper()}]" in row.text for k in pii.KINDS) and row.n_chars == len(row.text)
    assert out.where("doc_id = 1").first().text is None and out.count() == awkward.count()


# 2 shards


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_shards_are_near_equal_and_gapless(which, request):
    df = request.getfixturevalue(which)
    rows = sharding.shard_by_size(df).collect()
    sizes = [(i, len((t or "").encode()) + 1) for i, t in texts(df)]
    assert counted((r.doc_id, r["size"]) for r in rows) == counted(sizes)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(8))
    for r in by.values():
        assert sorted(x.slot for x in r) == list(range(len(r)))
    target, largest = sum(s for _, s in sizes) / 8, max(s for _, s in sizes)
    assert all(abs(sum(x["size"] for x in r) - target) <= 0.02 * target + largest for r in by.values())


def test_hot_group_is_cut(spark):
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("hot "), 20)).otherwise(F.col("id").cast("string")).alias("text")
    )
    rows = sharding.shard_by_size(df).groupBy("shard").agg(F.sum("size").alias("size")).collect()
    sizes = [r["size"] for r in rows]
    assert len(sizes) == 8 and max(sizes) / min(sizes) < 1.05


# 3 languages


def test_language_mixture(documents):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(documents.where(~held_out))
    rows = langid.annotate(documents.where(held_out), model).select("lang", "language").collect()
    assert sum(r.lang == r.language.lang for r in rows) / len(rows) >= 0.95
    english, german = (documents.where(f"lang = '{x}' AND n_chars > 1500").first().text for x in ("en", "de"))
    _, share = langid.mixtures([english[:1500] + " " + german[:1500]], model)
    assert np.isclose(share.sum(), 1) and (share > 0.3).sum() == 2


def test_language_sets_do_not_depend_on_the_batch(documents, monkeypatch):
    """The search tries every size, also where no document of the batch improved at the one before."""
    model, sizes, mixture = langid.fit(documents), [], langid._mixture
    monkeypatch.setattr(langid, "_mixture", lambda *a: sizes.append(int(a[4].sum(axis=1).max())) or mixture(*a))
    text = documents.where("lang = 'en' AND n_chars > 1500").first().text
    langid.mixtures([text], model)
    assert sorted(sizes) == list(range(1, len(model.languages) + 1))


def test_language_edges(awkward, empty, spark):
    model = langid.fit(awkward)
    rows = {r.doc_id: r.language for r in langid.annotate(awkward, model).collect()}
    assert rows[1].lang == rows[2].lang == rows[3].lang == "und" and rows[1].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    nothing = langid.annotate(awkward, langid.fit(empty)).collect()
    assert all(r.language.lang == "und" for r in nothing)


# 4 toxicity


def test_cumulative_link_recovers_order():
    random = np.random.default_rng(3)
    x = random.normal(size=4000)
    grade = np.digitize(1.5 * x + random.logistic(size=4000), [-0.5, 2.0])
    w, theta = toxicity.fit_cumulative_link(grade, np.ones(4000), np.arange(4000), np.zeros(4000, int), x, 1, 3, l2=0.0)
    assert abs(w[0] - 1.5) < 0.15 and abs(theta[0] + 0.5) < 0.15 and abs(theta[1] - 2) < 0.2
    above = toxicity.grade_probabilities(toxicity.Model({}, w, theta), np.array([0.3]))
    assert above[0, 0] > above[0, 1]


def test_toxic_documents_go(spark):
    clean = [(i, f"you kind words number {i} and tea", 0, 1) for i in range(300)]
    toxic = [(1000 + i, f"you {'idiot' if i % 2 else 'scum'} number {i}", 1, i % 2) for i in range(60)]
    labels = spark.createDataFrame([(i, t, q) for i, _, t, q in clean + toxic] + [(None, 1, 1), (5, None, None)], "doc_id bigint, toxic int, quality int")
    rows = [(i, t) for i, t, _, _ in clean + toxic] + [(5000, "Total IDIOT!"), (5001, None), (5002, ""), (None, "tea")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_toxicity", F.lit(1))
    kept = toxicity.accepted(docs, toxicity.grades_from_labels(labels))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in clean} | {5001, 5002, None}
    rows = {r.doc_id: r.toxicity for r in toxicity.annotate(docs, toxicity.fit(docs, toxicity.grades_from_labels(labels))).collect()}
    assert rows[5000].severity > 0.5 > rows[0].severity


def test_toxic_documents_go_with_few_distinct_texts(spark):
    clean = [(i, f"you kind words number {i % 17} and tea", 0, 1) for i in range(300)]
    toxic = [(1000 + i, f"you {'idiot' if i % 2 else 'scum'} number {i % 17}", 1, i % 2) for i in range(60)]
    labels = spark.createDataFrame([(i, t, q) for i, _, t, q in clean + toxic], "doc_id bigint, toxic int, quality int")
    rows = [(i, t) for i, t, _, _ in clean + toxic] + [(5000, "Total IDIOT!"), (5001, None), (5002, ""), (None, "tea")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = toxicity.accepted(docs, toxicity.grades_from_labels(labels))
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in clean} | {5001, 5002, None}


def test_rare_toxic_words_count(spark):
    """No toxic word stands in a tenth of the toxic documents; each has only words of its own kind."""
    clean = [(i, f"plain words w{i % 50} number {i}", 0) for i in range(2000)]
    toxic = [(5000 + i, f"plain words w{i % 50} slur{i % 25} number {i}", 1) for i in range(250)]
    labels = spark.createDataFrame([(i, t) for i, _, t in clean + toxic if i % 7], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in clean + toxic], "doc_id bigint, text string")
    kept = toxicity.accepted(docs, toxicity.grades_from_labels(labels))
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in clean}


def test_toxicity_without_labels(awkward, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    kept = toxicity.accepted(awkward, toxicity.grades_from_labels(labels))
    assert kept.count() == awkward.count() and kept.columns == awkward.columns


# 5 licences


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_licence_phrases(which, request):
    df = request.getfixturevalue(which)
    rows = licenses.summary(licenses.scan(df)).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert counted(got) == counted([(i, *brute.licence(t)) for i, t in texts(df)])
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


# 6 packing


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_packing_holds_every_token_once(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in texts(df):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        for a in range(0, len(ids), 4096):
            want[i, a, len(ids[a : a + 4096]), brute.crc(ids[a : a + 4096]), len(ids)] += 1
    rows = packing.pack_documents(df, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.start, r["length"], r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_decomposed_capitals_keep_their_ids():
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    marks = ("\u0300", "\u0301", "\u0302", "\u0307", "\u0308", "\u030a", "\u030c", "\u0327", "\u0331")
    names = [f"{a}{c}{m}{b}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks for a, b in (("", ""), ("x", "oe."), ("", "SON!"))]
    for text in [*names, " ".join(names), "T\u0308 PLAIN Caps \u0130stanbul \u00c4RGER"]:
        assert encode(text.encode(), 2).tolist() == plain.encode(text, add_special_tokens=False).ids + [2], text


def test_column_generation_reaches_the_bound():
    random = np.random.default_rng(5)
    demand = np.zeros(64, np.int64)
    for size in random.integers(5, 40, 3000):
        demand[size - 1] += 1
    patterns, amount = packing.column_generation(demand.astype(float))
    assert (patterns @ np.arange(1, 65) <= 64).all()
    assert np.allclose(patterns.T @ amount, demand)
    plan = packing.integer_plan(demand)
    assert (sum(p * n for p, n in plan) == demand).all()
    bins = sum(n for _, n in plan)
    assert amount.sum() - 1e-6 <= bins <= amount.sum() + 64
    value, counts = packing.best_pattern(np.array([1.0, 2.5, 3.9, 4.0]), 4)
    assert value == 5.0 and counts.tolist() == [0, 2, 0, 0]


# 7 contamination


@pytest.mark.parametrize("passes", [1, 3])
def test_contamination(documents, awkward, spark, passes):
    items = [(1, "alpha3 beta3 alpha4 beta4 alpha5 beta5 alpha6 beta6 alpha7 beta0 alpha8 beta1 alpha9 beta2 alpha10 beta3"),
             (1, "alpha3 beta3 alpha4"), (2, None), (3, " ,. "), (4, "only here"), (None, "quotes"), (5, "ONE"), (5, "one")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    options = {} if passes == 1 else {"pass_words": 4}
    hits = decontamination.judge(decontamination.find_contamination(awkward, benchmark, **options))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, brute.sha(",".join(r["items"])), r.contaminated) for r in hits.collect()]
    rows = texts(awkward)
    want = [(i, *w) for (i, _), w in zip(rows, brute.contamination([t for _, t in rows], items))]
    assert counted(got) == counted(want)
    kept = decontamination.uncontaminated(awkward, benchmark, **options)
    assert kept.columns == awkward.columns
    assert counted(r.doc_id for r in kept.collect()) == counted(i for i, *_, bad in want if not bad)


def test_contamination_on_driver_rows(documents, spark):
    found = QUERIES["op7_benchmark_decontamination"](spark, FOLDER).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = texts(documents)
    want = [(i, *w) for (i, _), w in zip(rows, brute.contamination([t for _, t in rows], items))]
    assert counted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == counted(want)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "a b c d x e f g h i j k l m"), (2, "z y x")], "doc_id bigint, text string")
    item = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id bigint, text string")
    rows = {r.doc_id: r for r in decontamination.find_contamination(docs, item).collect()}
    assert rows[1].n_near > 0 and not rows[1].spans and rows[2].n_near == 0


@pytest.mark.parametrize("passes", [1, 3])
def test_proximity_matches_are_all_found(spark, passes):
    """The rarest word changed, a passage cut at the document's start, neighbours in one segment."""
    random = np.random.default_rng(4)
    item = [f"i{k}" for k in range(20)]
    items = [(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(f"v{k % 6}" for k in range(17))), (None, "p q r s t")]
    bodies = [" ".join(item[:6] + ["misspelt"] + item[7:]), " ".join(item[:8]), " ".join(item[8:]), " ".join(item[2:]), "", "p q x s t"]
    for _ in range(60):
        w = list(item[random.integers(0, 5) :]) if random.random() < 0.6 else [f"v{k}" for k in random.integers(0, 6, 25)]
        for _ in range(random.integers(0, 4)):
            w[random.integers(0, len(w))] = f"x{random.integers(0, 3)}"
        for _ in range(random.integers(0, 4)):
            w.insert(random.integers(0, len(w)), f"i{random.integers(0, 20)}")
        bodies.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string").coalesce(1)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    options = {} if passes == 1 else {"pass_words": 18}
    rows = {r.doc_id: r for r in decontamination.find_contamination(docs, benchmark, **options).collect()}
    for i, body in enumerate(bodies):
        got = [(n["item"], n.start) for n in rows[i].near]
        assert len(got) == rows[i].n_near and set(got) == brute.near_passages(body, items), (i, body)
    assert rows[0].n_near > 0 and rows[1].n_near == 0


# 8 near duplicates


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_jaccard_components(which, request):
    df = request.getfixturevalue(which)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_classes(df).collect()}
    rows = [(i, t) for i, t in texts(df) if i is not None]
    want = {(i, n, c) for i, (n, c) in brute.jaccard_components(rows).items()}
    assert {g for g in got if g[0] is not None} == want
    if which == "awkward":
        assert (None, 3 * 0 + 1, None) in got and (None, len(brute.shingles(rows[3][1])), 4) in got


def test_jaccard_in_small_blocks(spark, monkeypatch):
    """Blocks and lots of few tokens give the same links as whole groups."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    random = np.random.default_rng(2)
    rows = []
    for i in range(160):
        words = [f"w{i // 40}x{j}" for j in range(80)]
        for _ in range(random.integers(0, 4)):
            words[random.integers(0, 80)] = f"e{random.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.jaccard_components(rows)


def test_one_of_each(awkward):
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([1, 2, 3, 4, 7, 9, 11, 12, 13, 14, None])


def test_components_of_a_chain_and_a_hub(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)], "a bigint, b bigint")
    roots = {r.node: r.root for r in jaccard.components(links).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and all(roots[1001 + i] == 1000 for i in range(300))


# 9 search


@pytest.mark.parametrize("block_terms", [search.BLOCK_TERMS, 500])
def test_search_matches_full_scoring(documents, awkward, block_terms):
    docs = documents.select("doc_id", "text").unionByName(
        awkward.select((F.col("doc_id") + 10_000).alias("doc_id"), "text").where("doc_id IS NULL OR doc_id <> 10005")
    )
    asked = docs.where(F.col("doc_id") % 20 == 0)
    rows = search.top_k(docs, asked, k=7, block_terms=block_terms).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.hit_id, r.score))
    bags = {i: Counter(brute.words(t)) for i, t in texts(docs) if i is not None}
    df, lengths = Counter(w for b in bags.values() for w in b), {i: sum(b.values()) for i, b in bags.items()}
    average = sum(lengths.values()) / len(bags)
    idf = {w: math.log1p((len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    for r in asked.collect():
        scores = []
        for i, b in bags.items():
            norm = 1.2 * (0.25 + 0.75 * lengths[i] / average)
            s = sum(n * idf[w] * b[w] * 2.2 / (b[w] + norm) for w, n in bags[r.doc_id].items() if w in b)
            if s > 0:
                scores.append((-round(s, 6), i))
        best = sorted(scores)[:7]
        assert [i for i, _ in got[r.doc_id]] == [i for _, i in best]
        assert np.allclose([s for _, s in got[r.doc_id]], [-s for s, _ in best], atol=2e-6)


# 10 URLs


def test_url_rules(spark):
    pages = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.NET/en/x?y#z"), (5, "http://example.net"), (6, "ftp://x.net/"),
             (7, "http://badexample.com/de/1"), (8, "http://example.com/de/1"), (9, "http://a.org/fr/"), (10, "http://net/en/"),
             (11, "http://?q://x"), (12, "http://a.b.net#/x"), (4, "http://A.Example.NET/en/x?y#z"), (None, "http://q.net/")]
    df = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("verdict", F.lit("y"))
    rows = urls.judge(df, urls.rule_table(spark, urls.RULES)).collect()
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows)
    assert got == Counter([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (5, "example.net", "", None, "allow"), (6, "x.net", "/", "net/", "block"), (7, "badexample.com", "/de/1", None, "allow"),
        (8, "example.com", "/de/1", "example.com/de/", "block"), (9, "a.org", "/fr/", "org/fr/", "allow"),
        (10, "net", "/en/", "net/", "block"), (11, "", "", None, "allow"), (12, "a.b.net", "", None, "allow"),
        (None, "q.net", "/", "net/", "block"),
    ])
    none = urls.judge(df, urls.rule_table(spark, urls.RULES).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = bloom.block_count(5000)
    table = bloom.bloom_table(keys, "k", blocks)
    assert bloom.possible(keys, "k", table, blocks).count() == 5000
    others = spark.range(50_000).select(F.concat(F.lit("other"), "id").alias("k"))
    assert bloom.possible(others, "k", table, blocks).count() < 500
    left = bloom.without(keys, F.col("k"), keys.limit(100), "k")
    assert left.count() == 4900


# All of them on an empty table


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    results = [
        pii.annotate(empty), pii.redacted(empty), sharding.shard_by_size(empty), langid.annotate(empty, langid.fit(empty)),
        toxicity.accepted(empty, toxicity.grades_from_labels(labels)), licenses.summary(licenses.scan(empty)),
        packing.pack_documents(empty, tokenizer_path()), decontamination.judge(decontamination.find_contamination(empty, benchmark)),
        decontamination.uncontaminated(empty, benchmark), jaccard.join_classes(empty), jaccard.one_of_each(empty),
        search.top_k(empty, empty), urls.judge(empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), urls.rule_table(spark, urls.RULES)),
    ]
    assert [df.count() for df in results] == [0] * len(results)
