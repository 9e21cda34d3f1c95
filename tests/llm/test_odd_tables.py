"""Tables whose columns clash with the operators' own, and tables where one id holds most rows."""

import random

from pyspark.sql import functions as F

from frayline.llm import decontamination, jaccard_join, licences, quality_rules, substring_dedup
from frayline.llm.common import sampled
from tests.llm import texts

OWN = ["__spans", "__items", "__words", "__key", "__kept", "__number", "__row", "__score", "__stats", "__SPANS_"]


def both(spark):
    plain = texts.documents(spark).select("doc_id", "text")
    return plain, plain.withColumns({name: F.lit("mine") for name in OWN})


def check(plain, clashing, operator):
    want = sorted((str(r.doc_id), str(r.text)) for r in operator(plain).collect())
    got = operator(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == want
    assert all(r[name] == "mine" for r in rows for name in OWN)


def test_clashing_columns_pass_through(spark):
    plain, clashing = both(spark)
    items = spark.createDataFrame([(1, plain.filter("doc_id = 3").first().text)], "item_id long, text string")
    check(plain, clashing, lambda d: decontamination.decontaminate(d, items, 4))
    check(plain, clashing, lambda d: substring_dedup.without_repeats(d, 12))
    check(plain, clashing, jaccard_join.without_near_copies)
    check(plain, clashing, lambda d: jaccard_join.one_row_of_each_class(d.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    labels = plain.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    check(plain, clashing, lambda d: quality_rules.without_low_quality(d, labels))
    assert jaccard_join.near_classes(clashing).count() == plain.count()


def test_items_of_one_id_are_dealt_to_many_shards(spark):
    rng = random.Random(2)
    rows = [(None if i % 3 else 7, " ".join(f"u{rng.randrange(60)}" for _ in range(9))) for i in range(40)] * 2
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"u{rng.randrange(60)}" for _ in range(30)) + " " + rows[i][1]) for i in range(30)], "doc_id long, text string")
    size = sum(len(t) for _, t in set(rows))
    sizes = [len(decontamination.shard_matcher(items.distinct(), k, 5, 4, "item_id", "text").pairs) for k in range(5)]
    assert max(sizes) < 0.6 * sum(sizes)
    whole, names = decontamination.matched(docs, items, 4)
    parts, _ = decontamination.matched(docs, items, 4, shard_bytes=size // 5 + 1)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert whole.filter(F.size(names[0]) > 0).count() == 30


def test_sampled_lines_follow_rows_not_ids(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('line number ', id) as text")
    lines = licences.sample_lines(docs, 300)
    assert 200 < len(lines) < 400
    same = spark.range(3000).selectExpr("1L as doc_id", "'one line' as text")
    assert len(licences.sample_lines(same, 300)) <= licences.REPEATS
    assert spark.range(10).filter(sampled(1.0, "id")).count() == 10
    # a share far below one in a million is still a share
    assert spark.range(3_000_000).filter(sampled(4e-6, "id")).count() > 0
