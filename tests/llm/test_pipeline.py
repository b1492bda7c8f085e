"""The pipeline against plain Python, stage by stage, each on its own input."""

from __future__ import annotations

from collections import Counter

import corpus
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, jaccard, mixing, toxicity


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, folder).cache()
    assert calm.columns == docs.columns and 0 < calm.count() <= docs.count()

    single = stages["ngram_jaccard"](spark, calm, folder).cache()
    want = corpus.components([(r.doc_id, r.text) for r in calm.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(want.values())) and single.columns == docs.columns

    clean = stages["decontamination"](spark, single, folder).cache()
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = [r.doc_id for r in single.collect() if not corpus.hits(r.text, items)[1]]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(want) and clean.columns == docs.columns

    mixed = stages["mixing"](spark, clean, folder).cache()
    copies = {r.doc_id: r.copies if r["size"] else 1 for r in mixing.mix(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n}) and mixed.columns == docs.columns

    sharded = stages["sharding"](spark, mixed, folder).collect()
    assert len(sharded) == mixed.count() and Counter(r.doc_id for r in sharded) == Counter(r.doc_id for r in mixed.collect())
    for s in {r.shard for r in sharded}:
        slots = sorted(r.slot for r in sharded if r.shard == s)
        assert slots == list(range(len(slots)))


def test_stages_on_odd_rows(spark, folder):
    docs = corpus.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "sharding" or out.columns == docs.columns
        assert out.count() > 0
        assert stage(spark, corpus.documents(spark, []), folder).count() == 0


def test_rows_beside_a_bad_row_of_the_same_id_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    leaks = {r.doc_id for r in decontaminate.overlap(docs, benchmark).where("contaminated").collect()}
    texts = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}
    fine = next(t for i, t in texts.items() if i not in toxic | leaks and t)
    for bad, keep in ((toxic, lambda d: toxicity.acceptable_documents(d, labels)), (leaks, lambda d: decontaminate.clean_documents(d, benchmark))):
        text = texts[min(bad)]
        odd = corpus.simple(spark, [(None, text), (None, fine), (None, None), (10**9, text), (10**9, fine), (10**9, fine)])
        out = keep(docs.unionByName(odd.select([F.col(c).cast(t).alias(c) for c, t in docs.dtypes])))
        assert Counter((r.doc_id, r.text) for r in out.where("doc_id is null or doc_id = 1000000000").collect()) == {(None, fine): 1, (None, None): 1, (10**9, fine): 2}


def test_texts_of_one_id_link_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = {t: t.replace("30", "other") for t in (a, b, c)}
    # 1 heads two classes; one text of 8 is a copy of 3, the other one is not
    data = [(1, a), (1, b), (2, near[a]), (5, near[b]), (3, c), (8, near[c]), (8, "quite another text " + a[:20]), (None, c), (None, "alone")]
    docs = corpus.simple(spark, data)
    got = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (5, 1): 1, (3, 3): 1, (8, 3): 1, (8, 8): 1, (None, None): 2}
    kept = sorted(((r.doc_id or 0, r.text) for r in jaccard.one_per_group(docs).collect()))
    assert kept == sorted((i or 0, t) for i, t in data if (i, t) not in [(2, near[a]), (5, near[b]), (8, near[c])])
