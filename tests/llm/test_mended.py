"""Rows and tables that once went wrong: labels of one kind, negative ids, rows that share an id."""

import math
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from skymesh.llm import archive, decontaminate, langid, mixing, neardup, toxicity

DOCS = [(1, "some plain text here"), (2, None), (3, ""), (4, "another text, quite harmless"), (5, "word " * 5000)]


@pytest.mark.parametrize("kind", [0, 1])
def test_labels_of_one_kind_give_their_rate(spark, kind):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    labels = spark.createDataFrame([(i, kind, kind) for i, _ in DOCS], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and {(r.score, r.predicted) for r in got.values()} == {(float(kind), kind)}
    kept = toxicity.acceptable(docs, toxicity.learn(docs, labels))
    assert kept.count() == (0 if kind else 5)


def test_odd_texts_against_a_fitted_model(spark):
    rows = [(i, f"vile nasty slur number {i} " * 5 if i % 3 == 0 else f"kind words number {i} about flowers") for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "slur " * 30_000), (1003, "日本語"), (1003, "vile nasty slur")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.predicted) for r in got}
    assert (1000, 0) in by and (1001, 0) in by and (1002, 1) in by and (1003, 0) in by and (1003, 1) in by


def test_negative_and_repeated_page_ids(spark):
    rows = [(-7, "http://a.org/", "x" * 2000), (-2, "http://b.org/", "x" * 2000), (0, "http://c.org/", "short"), (3, None, "y" * 1500), (3, "http://d.org/", "y" * 1500), (-7, "http://e.org/", "short")]
    got = archive.converted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.page_id for r in got) == [-7, -7, -2, 0, 3, 3]
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 2000} == {(-7, "revisit", -2), (-2, "response", None)}
    assert {(r.page_id, r.record_type) for r in got if r.payload_bytes == 1500} == {(3, "response")}


def test_training_rows_that_share_an_id_are_their_own(spark):
    fr, en = "le chat est sur la table et le chien dort", "the cat is on the table and the dog sleeps"
    rows = [(i, fr if i % 2 else en, "fr" if i % 2 else "en") for i in range(40)] + [(7, en, "en"), (7, "nichts davon lernen", None), (8, None, "en")] + [(9, fr, "fr")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("key", F.lit(1))
    seen = []
    fit, langid.fit = langid.fit, lambda r: seen.extend(r) or fit(r)
    try:
        field = langid.learn(docs)
    finally:
        langid.fit = fit
    assert set(seen) == {(fr, "fr"), (en, "en")} and len(seen) <= 42
    got = {(r.lang_pred) for r in langid.languages(docs.filter("text is not null and lang = 'fr'"), field).collect()}
    assert got == {"fr"}


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_clean_judges_rows_by_their_text(spark, block):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    other = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, item), (1, "clean text"), (None, item), (None, "no id"), (2, f"{item} {other}"), (3, None), (4, "")], "doc_id long, text string").withColumns({"bad": F.lit(1), "text_key": F.lit("k")})
    tests = spark.createDataFrame([("a", item), ("b", other), ("c", "unrelated words " * 7)], "item_id string, text string")
    got = decontaminate.clean(docs, tests, block_bytes=block)
    assert got.columns == docs.columns and sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, "no id"), (1, "clean text"), (3, ""), (4, "")]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_near_duplicates_of_rows_that_share_an_id(spark, parts):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = lambda words, i: " ".join(words[:i] + ["x"] + words[i + 1 :])
    rows = [(5, " ".join(base)), (5, " ".join(other)), (9, near(base, 0)), (3, near(other, 59)), (5, None), (7, "alone here now"), (7, "alone here now"), (None, " ".join(base)), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shared": F.lit(0), "own_id": F.lit(1)}).repartition(parts)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted([(5, 58, 5, True), (9, 58, 5, False), (5, 58, 3, False), (3, 58, 3, True), (5, 0, 5, True), (7, 1, 7, True), (7, 1, 7, True), (-1, 58, None, True), (12, 0, 12, True)])


def test_many_short_items_meet_a_text_once_each(spark):
    items = [(f"i{k:04d}", ["again", "again and", "and again and again"][k % 3]) for k in range(1500)] + [("long", "and again " * 20), ("none", "other words")]
    docs = spark.createDataFrame([(1, "again and " * 3000), (2, "x and again"), (3, "nothing")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert time.time() - began < 60
    assert (got[1].n_items, got[1].n_hit, got[1].longest_words, got[1].longest_item, got[1].longest_start) == (1501, 6000, 40, "long", 1)
    assert (got[2].n_items, got[2].n_hit, got[2].longest_words, got[2].longest_item, got[2].longest_start) == (500, 1, 1, "i0000", 2)
    assert got[3].n_items == 0 and not got[3].contaminated


@pytest.mark.parametrize("weight", [[1], [5, 3, 1], [1, 1, 1], [70, 20, 7, 2, 1], [9, 9, 1]])
def test_schedule_is_earliest_deadline_first(weight):
    """By exact fractions: in each slot the released block with the earliest deadline, the first source on ties."""
    total, turn, want = sum(weight), [0] * len(weight), []
    for t in range(3 * total):
        ready = [(math.ceil(Fraction((turn[i] + 1) * total, w)), i) for i, w in enumerate(weight) if math.floor(Fraction(turn[i] * total, w)) <= t]
        due, i = min(ready)
        assert t < due
        want.append((i, turn[i]))
        turn[i] += 1
        assert all(abs(turn[k] - Fraction((t + 1) * w, total)) < 1 for k, w in enumerate(weight))
    assert list(mixing.schedule(weight, 3 * total)) == want


@pytest.mark.parametrize("length", [1, 7, 40])
@pytest.mark.parametrize("weight", [[1], [5, 3, 1], [70, 20, 7, 2, 1], [9, 9, 1], [331, 250, 97, 61, 3, 3], [1] * 9])
def test_stretches_of_a_schedule_fit_together(weight, length):
    """Each stretch is planned by itself; every turn follows its source's last one, inside its own window."""
    total, had, slots = sum(weight), [0] * len(weight), 700
    for start in range(0, slots, length):
        stop = min(slots, start + length)
        goal = mixing.turns_at(weight, stop) if stop < slots else None
        for t, (i, j) in enumerate(mixing.schedule(weight, stop, start, mixing.turns_at(weight, start), goal), start):
            assert j == had[i]
            assert j * total // weight[i] <= t < -(-(j + 1) * total // weight[i])
            had[i] += 1
            assert all(abs(h * total - (t + 1) * w) < total for h, w in zip(had, weight, strict=True))
        assert sum(had) == stop


def test_mix_of_many_stretches(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.col("id") % 7, F.lit(4)).cast("string")).alias("source"))
    got = mixing.mixed(docs, block=2, stretch=60).toPandas()
    assert set(got.doc_id) == set(range(4000)) and not got.duplicated(["slot", "place"]).any()
    count = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    weight = {k: n**0.7 for k, n in count.items()}
    order = got.drop_duplicates("slot").sort_values("slot")
    assert len(order) > 10 * 4 * 7 and (order.slot.to_numpy() == range(len(order))).all()
    for k, w in weight.items():
        assert abs((order.source == k).cumsum().to_numpy() - (order.slot.to_numpy() + 1) * w / sum(weight.values())).max() < 1
        own = order[order.source == k]
        blocks = -(-count[k] // 2)
        assert (own.epoch * blocks + own.block_no).tolist() == list(range(len(own)))
