"""The pipeline stage by stage against brute force."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import language_id, quality_rules
from quillon.llm.common import table

from .test_operators import classes, contamination, library, odd


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    whole = text(docs)

    a = corpus_pipeline.identify_language(spark, docs, sf_dir).cache()
    label = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()}
    assert set(text(a)) == {i for i, (l, s) in label.items() if l != "und" and s >= corpus_pipeline.LEAST_SHARE}

    b = corpus_pipeline.apply_quality_rules(spark, a, sf_dir).cache()
    kept = {r["doc_id"] for r in quality_rules.judge(a).where("kept").collect()}
    assert set(text(b)) == kept and len(kept) < len(text(a))

    c = corpus_pipeline.drop_near_duplicates(spark, b, sf_dir).cache()
    first = {top for top, _ in classes(text(b)).values()}
    assert set(text(c)) == first and len(first) < len(kept)

    d = corpus_pipeline.decontaminate(spark, c, sf_dir).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    bad = {x[0] for x in contamination(list(text(c).items()), items) if x[2]}
    assert bad and set(text(d)) == first - bad
    for x in (a, b, c, d):
        assert x.columns == docs.columns

    tok = library("word_bpe_49k.json")
    ids = collections.defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r["start"]):
        ids[r["doc_id"]] += r["ids"]
    assert ids == {i: tok.encode(whole[i], add_special_tokens=False).ids + [2] for i in text(d)}


def test_odd_rows(spark, sf_dir):
    df = odd(spark).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("score"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, sf_dir)
        assert got.columns == df.columns
        got.count()
        assert stage(spark, df.limit(0), sf_dir).count() == 0
    near = corpus_pipeline.drop_near_duplicates(spark, df, sf_dir)
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_rows_of_one_id_or_none(spark):
    """Documents are told by id and text: a unique text stays whatever its id, and of copies one stays."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(5, text(1)), (5, text(2)), (5, text(2)), (6, text(1) + " end"), (None, text(3)), (None, text(3)), (None, text(4)), (7, text(4)), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "d1", "first", "chosen", "class_id")})
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(5, text(1)), (5, text(2)), (0, text(3)), (7, text(4)), (8, "")])


def test_run_on_odd_tables(spark, tmp_path, sf_dir):
    """All stages over odd rows, and over empty tables."""
    docs = table(spark, sf_dir, "documents")
    extra = odd(spark).select(docs.columns)
    item = docs.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(1).select(F.lit(1).alias("item_id"), F.substring("text", 1, 400).alias("text"))
    for name, rows in (("odd", docs.unionByName(extra)), ("empty", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        item.where(F.lit(name == "odd")).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert len({r["sequence_id"] for r in got}) == len(got) > 0 and all(len(r["ids"]) == r["length"] for r in got)
    hit = docs.orderBy(F.desc("n_chars"), "doc_id").where("lang = 'en'").first()["doc_id"]
    assert hit not in {r["doc_id"] for r in got}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
