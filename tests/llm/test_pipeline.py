"""The corpus pipeline: what each stage takes away and what it must leave."""

import random

import corpus_pipeline
from data import edited, frame, prose


def test_stages(spark, sf_dir):
    rng = random.Random(9)
    base = prose(rng, 200)
    passage = prose(rng, 60)
    texts = [base, base, edited(rng, base, 60), f"{prose(rng, 50)} {passage} {prose(rng, 20)}", f"{prose(rng, 30)} {passage}",
             "write to a.b@c.org " + prose(rng, 40), None, "", prose(rng, 3_000)]
    docs = frame(spark, texts, first=10_000_000).drop("score", "kept", "sequence_id", "spans")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names, name
    rows = {r.doc_id - 10_000_000: r.text for r in docs.collect()}
    assert set(rows) == {0, 3, 4, 5, 6, 7, 8}
    assert rows[0] == base and rows[8] == texts[8] and rows[6] is None
    assert passage.split()[30] not in rows[3].split() and len(rows[4].split()) == 30
    assert rows[5].startswith("write to [EMAIL] ")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id - 10_000_000 for r in packed} == set(rows)


def test_near_duplicates_without_ids_and_with_clashing_columns(spark, sf_dir):
    rows = [(None, "a b c d e f", "x"), (3, "a b c d e f", "y"), (None, "q r s t u v", "z"), (None, "q r s t u v", "z"), (9, None, "n"), (None, None, "m"),
            (5, "same id one text here", "p"), (5, "same id other text there", "q"), (7, "k l m n o p", "r"), (7, "k l m n o p", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string").selectExpr("*", "'k' AS key", "'r' AS row", "0L AS class", "'st' AS stays")
    for table in (docs, docs.withColumn("doc_id", docs.doc_id.cast("string"))):
        kept = corpus_pipeline.drop_near_duplicates(spark, table, sf_dir)
        assert kept.columns == table.columns
        got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
        assert got == sorted([("3", "a b c d e f"), ("None", "q r s t u v"), ("9", "None"), ("None", "None"), ("5", "same id one text here"),
                              ("5", "same id other text there"), ("7", "k l m n o p")])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir).select("doc_id").distinct()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean, toxic = (labels.where(f"toxic = {x}") for x in (0, 1))
    assert clean.join(kept, "doc_id", "left_semi").count() > 0.99 * clean.count()
    assert toxic.join(kept, "doc_id", "left_semi").count() < 0.3 * toxic.count()


def test_run_is_whole(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.select("doc_id").distinct().count() > 100
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
