"""The pipeline, stage by stage, against brute force."""

from collections import Counter

from odd_documents import empty, odd, plain
from test_llm_near import _contained, _roots
from test_llm_similar import _similar

import corpus_pipeline
from tidebars.llm.documents import read_table
from tidebars.llm.quality import fit_quality, score_quality
from tidebars.session import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = stage(read_table(spark, SF, "documents"))
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    rejected = {r.doc_id for r in score_quality(docs, fit_quality(docs, read_table(spark, SF, "labels"))).filter("predicted = 0").collect()}
    after = stage(steps["quality classifier"](spark, docs, SF))
    assert after.columns == columns and {i for i, _ in plain(after)} == {i for i, _ in plain(docs)} - rejected

    docs, after = after, stage(steps["exact dedup"](spark, after, SF))
    largest = {}
    for i, t in plain(docs):
        largest[t] = max(largest.get(t, -1), i)
    assert after.columns == columns and sorted(plain(after)) == sorted((i, t) for t, i in largest.items())

    docs, after = after, stage(steps["near dedup"](spark, after, SF))
    rows = sorted(plain(docs))
    roots = _roots(len(rows), _similar([t for _, t in rows]))
    assert after.columns == columns and sorted(plain(after)) == [rows[i] for i in sorted(set(roots))]

    docs, after = after, stage(steps["benchmark decontamination"](spark, after, SF))
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    leaked = {i for i, *_ in _contained(plain(docs), items)}
    assert after.columns == columns and {i for i, _ in plain(after)} == {i for i, _ in plain(docs)} - leaked

    last = steps["piece encoding"](spark, after, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter(i for i, _ in plain(after))
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, last.collect()))


def test_stages_take_odd_rows_and_empty_tables(spark):
    for name, step in corpus_pipeline.STAGES:
        docs = stage(odd(spark))
        kept = step(spark, docs, SF)
        if name != "piece encoding":
            assert kept.columns == docs.columns
        rows = kept.count()
        if name == "exact dedup":
            assert rows == len({t for _, t in plain(docs)})
        if name == "near dedup":  # empty texts are one group, equal texts another
            assert rows <= len({t for _, t in plain(docs)}) - 1
        assert step(spark, stage(empty(spark)), SF).count() == 0


def test_the_near_stage_keeps_clashing_columns_and_row_numbers(spark):
    texts = [(i, f"{' '.join(f'w{k}' for k in range(60))} end{i % 7}") for i in range(40)] + [(100 + i, f"other{i} text{i} of{i} few{i} words{i} only{i}") for i in range(40)]
    docs = stage(odd(spark, texts).repartition(7))
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    try:  # jobs of one session that pack the same files in other ways
        for parallelism in ("2", "16"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallelism)
            kept = corpus_pipeline.near(spark, docs, None)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "5")
            rows = kept.collect()
            assert {r.doc_id for r in rows} == {0, *range(100, 140)} and {r["__row"] for r in rows} == {"clash"}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
