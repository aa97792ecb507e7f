"""The corpus pipeline's stages on a small table, against plain versions of each."""

import random

import corpus_pipeline
from glossa.llm import quality_rules, simhash


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    good = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(120)) + ".", "en", "s", 1) for i in range(60)]
    junk = [(100 + i, "buy now " * 40, "en", "s", 1) for i in range(5)] + [(200 + i, " ".join(f"{rng.randrange(99)}$$$" for _ in range(80)), "en", "s", 1) for i in range(5)]
    copies = [(300 + i, good[i][1], "en", "s", 1) for i in range(4)] + [(400, None, None, None, None), good[7], good[7]]
    rows = good + junk + copies
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100 or r[0] >= 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == {r[0] for r in good + copies if r[1]} and all(len(quality_rules.FIELDS) == 6 for _ in kept)
    assert kept[1] == kept[0]
    first = {}
    for r in sorted((r for r in rows if r[0] in kept[1]), key=lambda r: r[0]):
        first.setdefault(simhash.simhash(r[1].encode()), r[0])
    assert kept[2] == set(first.values()) and kept[3] == kept[2]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == kept[3]
