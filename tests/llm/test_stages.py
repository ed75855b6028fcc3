"""The pipeline's stages on odd rows, clashing columns and empty tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from marquee.llm import language, neighbours, sentencepieces, spelling, toxicity

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, __print long, print string, keep boolean, "
          "fate_id long, label int, node long, family long, row_id string, carrier string, cell long, score double, sha string")


def odd_rows():
    draw = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("ka", "mo", "ti") for b in ("ra", "lu") for c in ("n", "s", "")]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    texts = [prose(draw.randint(8, 60)) for _ in range(80)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], None) for i in range(10)]                      # copies
    rows += [(200 + i, texts[40 + i] + " ka", "en") for i in range(5)]          # near copies
    rows += [(300, None, None), (301, "", "en"), (302, " \n\t", None), (303, "12 !!", "en"), (None, prose(20), "en"),
             (None, None, None), (304, prose(60_000), "en"), (5, texts[5], "en"), (5, texts[5], "en")]
    extra = (7, 1, "x", True, 3, 4, 5, 6, "r", "c", 8, 0.5, "s")
    return [(*row, "src", *extra) for row in rows]


def stored(spark, folder, rows):
    documents = spark.createDataFrame(rows, SCHEMA)
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_keep_all_columns_and_whole_rows(spark, tmp_path):
    folder = str(tmp_path)
    docs = stored(spark, folder, odd_rows())
    before = Counter(map(tuple, docs.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        left = Counter(map(tuple, docs.collect()))
        assert not left - before
        before = left
    ids = Counter(r[0] for r in before.elements())
    assert ids[5] + ids[105] == 1 and all(ids[i] + ids[100 + i] == 1 for i in range(10)) and ids[304] == 1
    packed = corpus_pipeline.run(spark, folder)
    assert set(r.doc_id for r in packed.select("doc_id").collect()) == set(ids)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    stored(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("shape", ["empty", "null"])
def test_models_of_nothing(spark, shape):
    rows = [] if shape == "empty" else [(None,) * 17, (1,) + (None,) * 16]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == len(rows) == toxicity.without_toxic(docs, model).count()
    spoken = language.with_bounds(language.fit(docs), docs)
    assert language.predict(docs, spoken).count() == len(rows)
    assert language.without_unknown(docs, spoken).count() == len(rows)
    assert sentencepieces.encode_digests(docs).count() == len(rows)
    assert spelling.spelling_variants(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, vectors).count() == 0
