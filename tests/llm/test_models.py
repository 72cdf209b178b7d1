"""Classifiers by held-out accuracy, decontamination by planted cases, and the pipeline stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F

from loomgraph.llm import decontam, mixing, quality, queries, simhash, toxicity

DIR = "/root/testdata/sf0.01"
EMPTY = [(1, None), (2, ""), (2, ""), (None, "some words"), (3, "word " * 20000)]


def accuracy(spark, scored, label):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    judged = scored.filter("held_out").join(labels, "doc_id")
    return judged.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_quality(spark):
    assert accuracy(spark, queries.op3_quality(spark, DIR), "quality") > 0.93


def test_toxicity(spark):
    scored = queries.op1_toxicity(spark, DIR)
    assert accuracy(spark, scored, "toxic") > 0.94
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert scored.filter("predicted = 1").join(labels.filter("toxic = 0"), "doc_id").count() <= 2


def test_sum_of_squares_identity():
    import numpy as np

    dice = np.random.default_rng(0)
    w, v, slots, x = dice.normal(size=9), dice.normal(size=(9, 3)), np.array([1, 4, 7]), dice.normal(size=3)
    pairs = sum(v[slots[i]] @ v[slots[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(quality.machine(0.5, w, v, slots, x)[0], 0.5 + w[slots] @ x + pairs)


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in EMPTY], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (quality.classify(docs, quality.fit(docs, none)), toxicity.score(docs, toxicity.fit(docs, none))):
        assert [r["score"] for r in out.collect()] == [0.5] * len(EMPTY)
    some = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, quality.fit(docs, some)).count() == len(EMPTY)
    assert toxicity.score(docs, toxicity.fit(docs, some)).count() == len(EMPTY)
    assert quality.classify(docs.limit(0), None).count() == 0


def test_templates(spark):
    texts = [
        (1, "On Monday Alice bought 12 apples for 30 dollars and gave 12 apples to Bob yesterday evening"),
        (2, "On Monday Carla bought 15 apples for 99 euros and gave 15 apples to Dora yesterday evening"),
        (3, "On Monday Carla bought 15 apples for 99 euros and gave 16 apples to Dora yesterday evening"),
        (None, None), (4, ""), (5, "so it is a short item, right"), (5, "nothing of the kind stands here at all"),
    ]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, pos int, template string")
    bench = spark.createDataFrame([(7, "On Monday Zed bought 3 apples for 5 dollars and gave 3 apples to Yan yesterday evening."), (8, "A short item, right"), (9, None)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["contaminated"], r["reparameterised"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, False, False), (1, True, True), (2, True, True), (3, False, False), (4, False, False), (5, False, False), (5, True, False)]
    assert decontam.contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_items_of_one_template(spark):
    text = "Add {} red hats and {} blue caps and {} green belts and {} brown shoes"
    values = {1: (3, 5, 7, 3), 2: (3, 5, 7, 9), 3: (3, 5, 7, 9), 4: (2, 4, 6, 8)}
    bench = spark.createDataFrame([(i, text.format(*v)) for i, v in values.items()], "item_id long, text string")
    docs = spark.createDataFrame([(i, text.format(*v)) for i, v in enumerate([(3, 5, 7, 3), (3, 5, 7, 9), (1, 2, 3, 4), (1, 2, 2, 4)])], "doc_id long, text string")
    got = {r["doc_id"]: (r["items"], r["n_items"], r["reparameterised"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {0: ([1], 1, False), 1: ([2, 3, 4], 3, True), 2: ([2, 3, 4], 3, True), 3: ([], 0, False)}
    same = decontam.contaminated(docs, bench.filter("item_id IN (2, 3)")).filter("doc_id = 1").first()
    assert same["items"] == [2, 3] and not same["reparameterised"] and same["n_windows"] == 9


def test_short_and_number_heavy_items(spark):
    items = {1: "2 + 2 = 4", 2: "one red dog", 3: "yes", 4: "7 8 9 10 11 12 13 14 15 16", 5: "7 8 9 10 11 12 13 14 15 17"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = ["so 2 + 2 = 4 it is", "so 2 + 3 = 5 it is", "See one red dog run.", "two red dog", "yes", "oh yes it is", "then 7 8 9 10 11 12 13 14 15 17", "8 7 9 10 12 11 13 14 15 18", "word " * 60000 + "one red dog"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    got = {r["doc_id"]: r["items"] for r in decontam.contaminated(docs, bench).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: [], 4: [3], 5: [], 6: [4, 5], 7: [], 8: [2]}


def test_verbatim_passages(spark):
    docs, bench = (spark.read.parquet(f"{DIR}/{x}.parquet") for x in ("documents", "benchmark"))
    items = [r["text"] for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(x in r["text"] for x in items)}
    assert {r["doc_id"] for r in decontam.contaminated(docs, bench).filter("contaminated").collect()} == want


def test_stages_judge_rows_of_null_and_repeated_ids_by_themselves(spark):
    passage = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    near = [" ".join(f"w{i}{c}" if i == k else f"w{i}" for i in range(200)) for k, c in ((0, ""), (50, "x"))]
    other = [" ".join(f"{c}{i}" for i in range(50)) for c in "abcd"]
    ids = {None: [*near, other[0], passage, other[0]], 5: [near[1], other[1], passage], 6: [other[2], other[3]]}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, ts in ids.items() for t in ts], "doc_id long, text string, lang string, source string, n_chars long")
    rows = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))
    assert rows(corpus_pipeline._near_dedup(spark, docs, DIR)) == sorted([(0, other[0]), (5, near[1]), (5, other[1]), (5, passage), (6, other[2]), (6, other[3])])
    nulls = docs.filter("doc_id IS NULL")
    assert sorted(r["text"] for r in corpus_pipeline._near_dedup(spark, nulls, DIR).collect()) in [sorted([x, other[0], passage]) for x in near]
    assert rows(corpus_pipeline._decontaminate(spark, docs, DIR)) == sorted((i or 0, t) for i, ts in ids.items() for t in ts if t != passage)


def test_pipeline(spark):
    docs = queries.table(spark, DIR, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.store(stage(spark, docs, DIR), name)
        kept[name] = docs
        if name == "quality":
            good = quality.classify(before, quality.fit(before, queries.table(spark, DIR, "labels"))).filter("predicted = 1")
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in good.collect()}
        elif name == "near_dedup":
            groups = simhash.near_groups(before).collect()
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({r["component_id"] for r in groups})
        elif name == "mixing":
            times = {r["doc_id"]: r["times"] for r in mixing.mix(before).collect()}
            counts = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert counts == {d: n for d, n in times.items() if n}
        if name != "token_ids":
            assert docs.columns == columns
    assert docs.count() == kept["mixing"].count()
