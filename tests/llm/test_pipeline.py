"""The whole corpus pipeline on a small folder of tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(12)
    text = lambda words, n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    fair = ["river", "stone", "paper", "window"]
    rows = [(i, text(fair, 60)) for i in range(120)]
    rows += [(200 + i, text(fair, 50) + " vilest wording " * 3) for i in range(40)]  # toxic
    rows += [(300 + i, text(["###$$$", "|%%%"], 60)) for i in range(40)]  # of bad quality
    rows += [(400, rows[0][1] + " token=abcdefgh1"), (401, rows[1][1] + " once more"), (402, rows[1][1]), (403, None), (404, ""), (405, "few words"), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).withColumns({"row": F.lit(1), "kept": F.lit(2)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 1, 1) for i in range(40)] + [(300 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none.parquet")
    return str(tmp_path), dict(rows)


def test_run(spark, folder):
    path, texts = folder
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert not any(200 <= i < 400 for i in got) and not {401, 402, 403, 404, 405} & set(got)
    clean = set(range(120)) - {0, 1}
    assert clean <= set(got) and 1 in got and len({0, 400} & set(got)) == 1
    for i in clean:
        assert got[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_keep_columns_and_empty_tables(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
