"""Streams and stored layers, on the sales tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee import config
from marquee.operators import audit
from marquee.plans import medallion
from marquee.plans.layer_queries import (
    AS_OF, DOCUMENTS_SQL, IN_SCOPE_SQL, LANGUAGE, START_YEAR,
)
from marquee.plans.oracle_views import with_views
from marquee.plans.order_tables import order_documents, table
from marquee.plans.registry import REGISTRY
from marquee.operators.intake import judged
from marquee.session import materialize, scratch_path
from marquee.sources.documents import framed, read_layer, write_documents
from marquee.sources.layout import Layout
from marquee.streaming import landing

#: Documents in each file that arrives: a file is read by one task.
ROWS_PER_FILE = 100_000


def _table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", 1).parquet(sf_dir)
    )


def _document(key: Column) -> Column:
    return F.format_string('{"id": %d}', key)


@REGISTRY.add("SELECT DISTINCT l_orderkey AS id FROM lineitem")
def incremental_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line announces its order; each order lands once, also after a second run."""
    home = scratch_path(spark, "landing")
    stream = _table_stream(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("string").alias("source"),
        _document(F.col("l_orderkey")).alias("body"))
    for _ in range(2):   # the second run finds no new file
        landing.start_landing(stream, f"{home}/landed", f"{home}/quarantine",
                              f"{home}/checkpoint").awaitTermination()
    return landing.read_landed(spark, f"{home}/landed").select("id")


@REGISTRY.add("""
    SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'not valid JSON' ELSE 'no id' END AS reason,
           count(*) AS n
    FROM orders WHERE o_orderpriority IN ('5-LOW', '2-HIGH') GROUP BY 1""")
def landing_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-off and nameless documents are set aside, the others land."""
    home = scratch_path(spark, "landing")
    body = (
        F.when(F.col("o_orderpriority") == "5-LOW", '{"id": ')
        .when(F.col("o_orderpriority") == "2-HIGH", '{"name": "order"}')
        .otherwise(_document(F.col("o_orderkey")))
    )
    stream = _table_stream(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("source"), body.alias("body"))
    landing.start_landing(stream, f"{home}/landed", f"{home}/quarantine",
                          f"{home}/checkpoint").awaitTermination()
    return landing.read_quarantine(spark, f"{home}/quarantine").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


def _stateful(spark: SparkSession, sf_dir: str) -> str:
    """Every event announces its user; an error leaves a cut-off copy of the document besides."""
    home = scratch_path(spark, "landing")
    whole = _document(F.col("user_id"))
    bodies = F.when(F.col("event_type") == "error", F.array(whole, F.lit('{"id": '))).otherwise(
        F.array(whole))
    stream = _table_stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.explode(bodies).alias("body"))
    landing.start_stateful_landing(stream, f"{home}/landed", f"{home}/checkpoint",
                                   f"{home}/quarantine").awaitTermination()
    return home


@REGISTRY.add("SELECT DISTINCT user_id AS id FROM events")
def stateful_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids remembered in the state store."""
    home = _stateful(spark, sf_dir)
    return landing.read_landed(spark, f"{home}/landed").select("id")


@REGISTRY.add("""
    SELECT 'not valid JSON' AS reason, count(*) AS n FROM events
    WHERE event_type = 'error' GROUP BY 1""")
def stateful_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken documents of the same stream."""
    home = _stateful(spark, sf_dir)
    return landing.read_quarantine(spark, f"{home}/quarantine").groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


@REGISTRY.add(with_views(f"""
    SELECT 'Bronze / discover' AS layer, false AS has_files, NULL AS rows
    UNION ALL SELECT 'Bronze / movies', true, (SELECT count(*) FROM docs)
    UNION ALL SELECT 'Silver / movies', true, (SELECT count(*) FROM scoped)
    UNION ALL SELECT 'Silver / cast', true, (SELECT count(*) FROM scoped)
    UNION ALL SELECT 'Silver / crew', true, (SELECT 2 * count(*) FROM scoped)
    UNION ALL SELECT 'Gold / gold_movies', true,
      (SELECT count(*) FROM scoped WHERE budget >= 100000 AND revenue > 0)""",
    docs=DOCUMENTS_SQL, scoped=f"SELECT * FROM docs WHERE {IN_SCOPE_SQL}"))
def layer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written, Silver and Gold built from them, then all six layers listed.

    How many files Spark writes depends on the cluster, so only their presence is shown.
    """
    layout = Layout(scratch_path(spark, "layers"))
    write_documents(order_documents(spark, sf_dir, keep=("o_orderkey",)), layout.documents, id_column="o_orderkey")
    medallion.build_silver(spark, layout, start_year=START_YEAR, as_of=AS_OF,
                           language=LANGUAGE)
    medallion.build_gold(spark, layout)
    listed = audit.layer_inventory(spark, layout)
    return listed.select("layer", (F.col("files") > 0).alias("has_files"),
                         "rows")


_ODD_BODY_SQL = """
    SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders"""


def _odd_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per order; what it holds depends on the priority."""
    key, kind = F.col("o_orderkey"), F.col("o_orderpriority")
    body = (
        F.when(kind == "1-URGENT", F.format_string('{"id": %d,\n "title": "a"}\n\n{"id": -%d}{"id": null}', key, key))
        .when(kind == "2-HIGH", F.format_string('{"id": 0, "title": "x", "id": %d}', key))
        .when(kind == "3-MEDIUM", F.format_string('{"id": %d, "vote_average": NaN, "popularity": -Infinity}', key))
        .when(kind == "5-LOW", F.format_string('{"id": %d} trailing', key))
        .otherwise(_document(key)))
    return table(spark, sf_dir, "orders").select(kind.alias("source"), body.alias("body"))


@REGISTRY.add(with_views("""
    SELECT kind, sum(CASE WHEN kind = '5-LOW' THEN 0 WHEN kind = '1-URGENT' THEN 2 ELSE 1 END)::BIGINT AS usable,
           sum(CASE WHEN kind = '5-LOW' THEN 1 ELSE 0 END)::BIGINT AS not_json,
           sum(CASE WHEN kind = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS nameless,
           sum(CASE WHEN kind IN ('5-LOW', '1-URGENT') THEN 0 ELSE id END)::BIGINT AS ids
    FROM odd GROUP BY kind""", odd=_ODD_BODY_SQL))
def documents_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several values in one text, repeated keys and NaN are read; trailing text is not."""
    rows = judged(framed(_odd_bodies(spark, sf_dir)))

    def how_many(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return rows.groupBy(F.col("source").alias("kind")).agg(
        how_many(F.col("reason").isNull(), "usable"), how_many(F.col("reason") == "not valid JSON", "not_json"),
        how_many(F.col("reason") == "no id", "nameless"), F.coalesce(F.sum("id"), F.lit(0)).cast("bigint").alias("ids"))


@REGISTRY.add(with_views(f"""
    SELECT id, title, release_date, budget, revenue FROM (SELECT * FROM docs WHERE {IN_SCOPE_SQL})""", docs=DOCUMENTS_SQL))
def silver_from_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many documents in each ``.json.gz`` file, and the Silver table built from them."""
    layout = Layout(scratch_path(spark, "layers"))
    shape = F.schema_of_json(F.lit(order_documents(spark, sf_dir).agg(F.max(F.struct(F.length("body"), "body"))).first()[0]["body"]))
    typed = order_documents(spark, sf_dir).select(F.from_json("body", shape).alias("doc")).select("doc.*")
    typed.write.json(layout.documents, compression="gzip")
    medallion.build_silver(spark, layout, start_year=START_YEAR, as_of=AS_OF, language=LANGUAGE)
    return spark.read.parquet(layout.silver("movies")).select("id", "title", "release_date", "budget", "revenue")


@REGISTRY.add("""
    SELECT user_id AS id, CASE WHEN min(event_id % 4) < 2 THEN 1 ELSE 2 END AS run
    FROM events GROUP BY user_id""")
def landing_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive in two parts, several to a run, with many ids in both: each id lands once.

    Ids are remembered in the state store for a limited time only, and looked for in the landed
    table beyond it. A run takes two micro-batches, each of as many files as its rows need.
    """
    home = scratch_path(spark, "landing")
    events = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 4).alias("part"), F.to_json(F.struct(F.col("user_id").alias("id"))).alias("value"))
    for run in (1, 2):
        arrived = events.where(F.col("part").isin([2 * run - 2, 2 * run - 1]))
        files = max(2, -(-arrived.count() // ROWS_PER_FILE))
        arrived.select("value").repartition(files).write.mode("append").option("compression", "gzip").text(f"{home}/files")
        stream = landing.document_stream(spark, f"{home}/files", pattern="*.txt.gz", one_per_file=False,
                                         max_files=-(-files // 2))
        landing.start_stateful_landing(stream, f"{home}/landed", f"{home}/checkpoint", remember="10 seconds"
                                       ).awaitTermination()
        landed = landing.read_landed(spark, f"{home}/landed")
        if run == 1:
            first = materialize(landed.select("id", F.lit(1).alias("run")), "first-run")
    later = landed.select("id").exceptAll(first.select("id")).withColumn("run", F.lit(2))
    return first.unionByName(later)
