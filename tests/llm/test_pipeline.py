"""The pipeline's stages against what each must do to its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import components


def test_stages(spark, folder, rows, tmp_path):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    docs, columns = given, given.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        after = [tuple(r) for r in out.collect()]
        if name != "byte_bpe":
            assert out.columns == columns
        if name == "toxicity":
            assert not Counter(after) - Counter(before)
            assert all("scum" not in (r[1] or "") or r in after for r in before if r[0] is None)
        elif name == "ngram_join":
            expected, stay, seen = components([(r[0], r[1]) for r in before]), [], set()
            for (d, n, c), r in zip(expected, before, strict=True):  # ids here repeat in equal rows alone
                if n == 0 or (d == c and c not in seen):
                    stay.append(r)
                    seen |= {c} if n else set()
            assert Counter(after) == Counter(stay)
            assert max(Counter(r for r in after if r[1] and r[1].strip()).values()) == 1
        elif name == "secrets":
            assert Counter(r[0] for r in after) == Counter(r[0] for r in before)
            assert all("AKIA" not in (r[1] or "") for r in after)
        elif name == "mixing":
            assert set(r[1] for r in after) <= set(r[1] for r in before)
            assert max(Counter(r[0] for r in after).values()) <= 3 * max(Counter(r[0] for r in before).values())
        else:
            assert len(after) == len(before)
            assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
        docs = out


def test_rows_without_ids(spark):
    """Rows that share an id, or have none, are judged one by one; columns called as the operators' own stay."""
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, long, "en", "a", 1, 9.0, 7, 8), (None, long, "en", "a", 1, 9.0, 7, 8), (5, other, "en", "a", 1, 9.0, 7, 8), (5, long + " end", "en", "b", 1, 9.0, 7, 8), (6, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row long, passes long")
    kept = [tuple(r) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, None).collect()]
    assert Counter(kept) == Counter([rows[2], rows[3], rows[4]])
    mixed = corpus_pipeline.mix(spark, docs, None)
    assert mixed.columns == docs.columns
    counts = Counter(tuple(r) for r in mixed.collect())
    assert set(counts) <= set(rows) and counts[rows[4]] == 0 and counts[rows[0]] <= 6 and counts[rows[2]] <= 3


def test_score_column_stays(spark, folder):
    """A column that has the name of the stage's own score comes through."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_score", F.lit(9.0)).withColumn("Score_", F.lit(3))
    out = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns and {(r._score, r.score, r.Score_) for r in out.collect()} == {(9.0, 7, 3)}


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert out.count() > 50
