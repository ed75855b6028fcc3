"""What the language stage keeps, and labels with more languages than a byte counts."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import language

SOUNDS = {"aa": ["ka", "mo", "ti", "re"], "bb": ["schu", "ver", "ung", "ach"], "gg": ["λα", "μο", "τι", "σε"]}


def prose(draw, lang, n):
    return " ".join("".join(draw.choices(SOUNDS[lang], k=3)) for _ in range(n))


def documents(spark):
    draw = random.Random(8)
    rows = [(i, prose(draw, lang, draw.randint(3, 60)), lang, "extra") for i in range(300) for lang in [list(SOUNDS)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, print string")


def test_the_stage_drops_what_reads_like_no_language_and_keeps_the_rest(spark):
    docs = documents(spark)
    model = language.with_bounds(language.fit(docs, share=language.LEARNED), docs)
    draw = random.Random(9)
    junk = [(1000 + i, "".join(draw.choices("bcdfghjklmnpqrstvwxz     ", k=k)), "aa", None) for i, k in enumerate([80, 400, 5000])]
    odd = [(2000, None, "aa", None), (2001, "", None, None), (2002, "12 -- !", "bb", None), (2003, "日本語の文", "gg", None),
           (2004, prose(draw, "aa", 3) + " 日本語の文日本語の文日本語の文日本語の文", "aa", None)]
    good = [(3000, prose(draw, "aa", 20) + " " + prose(draw, "gg", 20), "aa", None), (None, prose(draw, "bb", 30), None, None),
            (3002, prose(draw, "aa", 30_000), "aa", None), (3003, prose(draw, "aa", 1), "bb", None)]
    planted = spark.createDataFrame(junk + odd + good, docs.schema)
    left = language.without_unknown(docs.unionByName(planted), model)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, *range(300), 3000, 3002, 3003]
    assert language.without_unknown(docs.limit(0), model).count() == 0


def test_where_no_language_is_known_all_documents_stay(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    model = language.with_bounds(language.fit(docs), docs)
    assert model.languages == [] and language.without_unknown(docs, model).count() == 300


def test_viterbi_equals_all_paths_and_takes_many_languages():
    draw = np.random.default_rng(1)
    scores = draw.normal(0, 3, (5, 3)).astype(np.float32)
    row = np.array([0, 0, 0, 0, 2])
    paths = itertools.product(range(3), repeat=4)
    best = max(paths, key=lambda p: sum(scores[t, s] for t, s in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:])))
    assert language.viterbi(scores, row, 3, 2.0).tolist() == [*best, int(scores[4].argmax())]
    wide = np.zeros((4, 300), np.float32)
    wide[:2, 290], wide[2:, 150] = 20, 20
    assert language.viterbi(wide, np.zeros(4, np.int64), 1, 8.0).tolist() == [290, 290, 150, 150]
