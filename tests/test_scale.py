"""Plans and results where one key, name or id holds a third of all rows."""

import os

from conftest import film, bodies
from pyspark.sql import functions as F

from marquee.modeling.encoding import oof_target_encode
from marquee.modeling.features import with_split
from marquee.operators import analytics, gold, intake, silver
from marquee.operators.quantiles import exact_quantiles
from marquee.session import clear_scratch, materialize, materialized, scratch_path
from marquee.sources.sinks import save_bucketed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=9000):
    return spark.range(n).select(
        F.col("id").alias("movie_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
        .alias("director_name"),
        ((F.col("id") * 7919) % 1000 / 10).alias("roi"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("Drama")))
        .otherwise(F.array(F.lit("Action"), F.lit("War"))).alias("genres"),
        (F.col("id") % 12 + 1).cast("int").alias("release_month"),
    )


def test_hot_group_median_moves_cells_and_not_rows(spark):
    stored = materialize(skewed(spark))
    result = exact_quantiles(stored, ["director_name"], "roi", {"median_roi": 0.5})
    expected = {r.director_name: r.m for r in stored.groupBy("director_name").agg(
        F.median("roi").alias("m")).collect()}
    assert {r.director_name: r.median_roi for r in result.collect()} == expected
    text = plan_of(result)
    # Targets are broadcast, so no exchange lies between the scan and the counting.
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_quantiles_without_any_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = skewed(spark)
        result = exact_quantiles(frame, ["director_name"], "roi", {"median_roi": 0.5})
        assert "SortMergeJoin" in plan_of(result)
        expected = {r.director_name: r.m for r in frame.groupBy("director_name").agg(
            F.median("roi").alias("m")).collect()}
        assert {r.director_name: r.median_roi for r in result.collect()} == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matrix_of_a_hot_genre(spark):
    frame = skewed(spark)
    cells = {(r.release_month, r.genre): (r.value, r.n)
             for r in analytics.month_genre_matrix(frame).collect()}
    expected = {(r.release_month, r.genre): (r.m, r.n) for r in analytics.per_genre(
        frame, "release_month", "roi").groupBy("release_month", "genre").agg(
        F.median("roi").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    assert cells == expected


def test_hot_category_is_encoded_once_per_fold(spark):
    frame = with_split(skewed(spark)).withColumn("y", F.col("roi"))
    encoded = oof_target_encode(frame, ["director_name"], "y")
    assert encoded.count() == 9000
    hot = encoded.where("director_name = 'hot'").select("encoder_fold", "director_name_encoded")
    assert hot.distinct().count() == 5


def test_listed_many_times_is_one_candidate(spark):
    entries = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"),
        F.col("id").alias("page"), F.lit(0).alias("pos"))
    first = intake.first_appearances(entries)
    assert first.count() == 4001 and first.where("id = -1").first().page == 0


def test_few_candidates_do_not_shuffle_the_landed_table(spark, tmp_path):
    spark.range(2000).write.parquet(str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    candidates = materialize(spark.range(1990, 2010))
    fresh = intake.new_ids(candidates, landed, at_most=20)
    assert sorted(r.id for r in fresh.collect()) == list(range(2000, 2010))
    assert "BroadcastHashJoin" in plan_of(fresh) and "SortMergeJoin" not in plan_of(fresh)


def test_bucketed_silver_joins_without_a_shuffle(spark):
    docs = silver.parse_documents(bodies(spark, *[film(n) for n in range(1, 30)]))
    tables = silver.silver_tables(docs)
    for name, key in (("movies", "id"), ("cast", "movie_id"), ("crew", "movie_id")):
        save_bucketed(tables[name], f"silver_{name}", key, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = gold.build_gold(*[spark.table(f"silver_{n}") for n in ("movies", "cast", "crew")])
        assert "Exchange" not in plan_of(built)
        assert built.where("director_name = 'Ruth Calder' and lead_cast_name = 'Mira Solberg'").count() == 29
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in tables:
            spark.sql(f"DROP TABLE silver_{name}")


def test_scratch_tables_can_be_cleared(spark):
    with materialized(spark.range(3)) as stored:
        assert stored.count() == 3
        folder = stored.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert os.path.isdir("/" + folder.lstrip("/"))
    assert not os.path.exists("/" + folder.lstrip("/"))
    path = scratch_path(spark, "mine")
    spark.range(2).write.parquet(path)
    assert clear_scratch(spark) >= 1 and not os.path.exists(path)
