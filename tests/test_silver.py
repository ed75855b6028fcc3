import datetime as dt
import gzip
import json
import os

import pytest
from conftest import bodies, film, store
from pyspark.sql import functions as F

from marquee.functions import iso_date
from marquee.operators import silver
from marquee.plans import medallion
from marquee.sources.documents import compact_documents, read_documents, write_documents
from marquee.sources.tables import read_silver, read_table

AS_OF = dt.date(2024, 1, 1)


def parsed(spark, *documents):
    return {row.id: row for row in silver.parse_documents(bodies(spark, *documents)).collect()}


def test_scope_keeps_matching_documents(spark, layout):
    store(layout, film(1), film(2, release_date="1999-12-31"), film(3, original_language="fr"),
          film(4, adult=True), film(5, release_date="1970-01-01"), film(6, release_date="2031-01-01"))
    counts = medallion.build_silver(spark, layout, as_of=AS_OF)
    assert counts == {"movies": 2, "cast": 2, "crew": 6}
    movies = read_silver(spark, layout.silver("movies"), "movies")
    assert {row.id for row in movies.collect()} == {1, 2}
    kinds = dict(movies.dtypes)
    assert (kinds["release_date"], kinds["genres"], kinds["budget"]) == (
        "date", "array<string>", "bigint")
    crew = read_silver(spark, layout.silver("crew"), "crew")
    assert {row.job for row in crew.collect()} == {"Director", "Producer"}


def test_building_twice_gives_the_same(spark, layout):
    store(layout, film(1), film(2))
    first = medallion.build_silver(spark, layout, as_of=AS_OF)
    assert medallion.build_silver(spark, layout, as_of=AS_OF) == first


def test_unreadable_files_are_skipped(spark, layout):
    store(layout, film(1))
    folder = os.path.join(layout.documents, "id_prefix=000")
    with open(os.path.join(folder, "7.json.gz"), "wb") as out:
        out.write(b"this is not gzip")
    with gzip.open(os.path.join(folder, "8.json.gz"), "wt") as out:
        out.write('{"id": 8, "tit')
    whole = gzip.compress(b'{"id": 9}' * 1000)
    with open(os.path.join(folder, "9.json.gz"), "wb") as out:
        out.write(whole[: len(whole) // 2])
    docs = silver.parse_documents(read_documents(spark, layout.documents))
    assert [row.id for row in docs.select("id").collect()] == [1]


def test_missing_folder_is_empty(spark, layout):
    assert read_documents(spark, layout.documents).count() == 0
    assert medallion.build_silver(spark, layout, as_of=AS_OF)["movies"] == 0


@pytest.mark.parametrize("number", ["4", 4.0, True, None])
def test_only_whole_number_ids_count(spark, number):
    assert parsed(spark, film(1, id=number)) == {}


def test_odd_values_become_defaults(spark):
    rows = parsed(
        spark,
        film(1, budget=3_000_000_000.7, revenue=None, vote_average=None, popularity=None,
             runtime=None, adult=None, genres=None, production_companies=[]),
        film(2, genres=["x", {"name": "Drama"}, {"name": ""}, {"name": None}, 7]),
        {"id": 3},
        film(4, title=5, credits=None, adult=1, budget="12"),
    )
    one = rows[1]
    assert (one.budget, one.revenue, one.vote_average, one.popularity) == (3_000_000_000, 0, 0.0, 0.0)
    assert one.runtime is None and one.adult is False
    assert one.genres == [] and one.production_companies == []
    assert rows[2].genres == ["Drama"]
    assert rows[3].budget == 0 and rows[3].cast is None and rows[3].release_date is None
    assert rows[4].title == "5" and rows[4].adult is True and rows[4].budget == 12


@pytest.mark.parametrize("text, expected", [
    ("2005-06-15", dt.date(2005, 6, 15)), ("20050615", dt.date(2005, 6, 15)),
    ("2005-W24-3", dt.date(2005, 6, 15)), ("2005W243", dt.date(2005, 6, 15)),
    ("2005-W24", dt.date(2005, 6, 13)), ("2009-W53-7", dt.date(2010, 1, 3)),
    ("2005-W53-1", None), ("2005-W00", None), ("2005-W243", None), ("2005", None),
    ("2005-6-1", None), ("", None), ("2005-02-30", None), (" 2005-06-15", None),
    ("2005-0615", None), (None, None),
])
def test_iso_dates(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(iso_date(F.col("t"))).first()[0] == expected


def test_numeric_release_date_is_not_a_date(spark):
    assert parsed(spark, film(1, release_date=20050615))[1].release_date is None


def test_top_cast_orders_missing_last_and_keeps_ties(spark):
    cast = [{"id": 1, "name": "unordered"}, {"order": 2, "id": 2, "name": "c"},
            {"order": 1, "id": 3, "name": "b"}, {"order": 1, "id": 4, "name": "a"}, "junk"]
    docs = silver.parse_documents(bodies(spark, film(1, credits={"cast": cast, "crew": []})))
    names = [row.name for row in silver.silver_cast(docs, top_n=3).orderBy("order", "pos").collect()]
    assert names == ["b", "a", "c"]
    assert [row.name for row in silver.silver_cast(docs).collect()] == ["b"]


def test_documents_round_trip_and_compaction(spark, layout, tmp_path):
    store(layout, film(5), film(1234))
    target = str(tmp_path / "compact")
    compact_documents(spark, layout.documents, target)
    assert {name for name in os.listdir(target) if name.startswith("id_")} == {
        "id_prefix=000", "id_prefix=001"}
    again = read_documents(spark, target, pattern="*.gz", one_per_file=False)
    assert {row.id for row in silver.parse_documents(again).collect()} == {5, 1234}
    write_documents(spark.createDataFrame([(1_234_567, "{}")], "id bigint, body string"),
                    str(tmp_path / "wide"))
    assert "id_prefix=1234" in os.listdir(tmp_path / "wide")


def test_parsing_reads_each_body_once(spark):
    scoped = silver.silver_scope(silver.parse_documents(bodies(spark, film(1))), as_of=AS_OF)
    plan = silver.silver_movies(scoped)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1


def test_empty_table_has_its_schema(spark, layout):
    frame = read_table(spark, layout.gold, "a int, b string")
    assert frame.columns == ["a", "b"] and frame.count() == 0


def test_documents_of_both_layouts_are_read(spark, layout):
    from marquee.sources.documents import read_layer
    lines = spark.createDataFrame([(k, '{"id": %d}' % k) for k in range(1000, 1020)], "id long, body string")
    write_documents(lines, layout.documents)
    store(layout, film(5))
    docs = silver.parse_documents(read_layer(spark, layout.documents))
    assert sorted(r.id for r in docs.collect()) == [5, *range(1000, 1020)]


def test_values_are_split_whatever_stands_between():
    from marquee.sources.documents import split_values
    assert split_values('{"a": 1}\n\n {"b":\n 2}{"c": 3}[4]') == ['{"a": 1}', '{"b": 2}', '{"c": 3}', "[4]"]
    assert split_values('{"a": 1, "b": 2, "a": 3}') == ['{"a": 3, "b": 2}']
    assert split_values('{"a": NaN, "b": -Infinity, "c": 1e999}') == ['{"a": "NaN", "b": "-Infinity", "c": "inf"}']
    for broken in ('{"a": 1} junk', '{"a": 1}}', "", "  ", '{"a": ', "[" * 100_000):
        assert split_values(broken) == [broken]


def test_documents_in_any_frame(spark, layout):
    folder = os.path.join(layout.documents, "id_prefix=000")
    os.makedirs(folder)
    texts = {"1": '{"id": 1}\n{"id": 2}\n', "3": '{\n "id": 3\n}\n{\n "id": 4}', "5": '{"id": 5} junk', "6": '{"id": 0, "id": 6}',
             "7": '{"id": 7, "vote_average": NaN, "popularity": Infinity, "runtime": 9}', "8": '{"id": 8}]', "9": '{"id": 9},"x"]',
             "10": '{"id": 10, "title": "Straße \\ud83d\\ude00 \\" }"}', "11": "", "12": '{"id": 12, "title": "\\ud800"}{"id": 13}'}
    for name, text in texts.items():
        with gzip.open(os.path.join(folder, f"{name}.json.gz"), "wt", encoding="utf-8") as out:
            out.write(text)
    from marquee.operators.intake import judged
    from marquee.sources.documents import read_layer
    rows = {r.id: r for r in silver.parse_documents(read_layer(spark, layout.documents)).collect()}
    assert set(rows) == {1, 2, 3, 4, 6, 7, 10, 12, 13}
    assert rows[7].vote_average != rows[7].vote_average and rows[7].popularity == float("inf") and rows[7].runtime == 9
    assert rows[10].title == 'Straße \U0001F600 " }'
    reasons = [r.reason for r in judged(read_layer(spark, layout.documents)).where("reason is not null").collect()]
    assert reasons == ["not valid JSON"] * len(reasons) and len(reasons) == 4


def test_framing_keeps_other_columns(spark):
    from marquee.sources.documents import framed
    raw = spark.createDataFrame([("a", '{"id": 1}{"id": 2}', 5), ("b", None, 6), (None, '{"id": 3}', None)],
                                "source string, body string, _n int")
    assert sorted(map(str, framed(raw).collect())) == sorted(map(str, spark.createDataFrame(
        [("a", '{"id": 1}', 5), ("a", '{"id": 2}', 5), ("b", None, 6), (None, '{"id": 3}', None)], raw.schema).collect()))
    assert framed(raw.limit(0)).count() == 0


def test_large_files_are_read_by_lines(spark, layout, monkeypatch):
    from marquee.operators.intake import judged
    from marquee.sources import documents
    assert list(documents.whole_texts([
        '{"id": 1}{"id": 2}', "", "{", ' "a": "} \\" {",', ' "b": [', "  {}", "  ]", "}", '{"id": 3', '{"id": 4}', '{"t": "cut',
        '{"id": 5}', '{"id": 6}]', "{", '"x":', '"y"'])) == [
        '{"id": 1}{"id": 2}', '{\n "a": "} \\" {",\n "b": [\n  {}\n  ]\n}', '{"id": 3', '{"id": 4}', '{"t": "cut',
        '{"id": 5}', '{"id": 6}]', '{\n"x":\n"y"']

    folder = os.path.join(layout.documents, "id_prefix=000")
    os.makedirs(folder)
    for name, first in (("a", 0), ("b", 1000)):
        with gzip.open(os.path.join(folder, f"{name}.json.gz"), "wt", encoding="utf-8") as out:
            for number in range(first, first + 1000):
                out.write(json.dumps(film(number), indent=number % 2 or None) + "\n")
            out.write('{"id": 7')
    store(layout, film(5000))
    monkeypatch.setattr(documents, "LARGE_FILE", 2_000)
    rows = documents.read_layer(spark, layout.documents)
    read = judged(rows).where("reason is null").select("id").collect()
    assert sorted(r.id for r in read) == [*range(2000), 5000]
    assert [r.body for r in judged(rows).where("reason is not null").collect()] == ['{"id": 7'] * 2
    # Large files are left out of the reading of whole texts when files are listed, not after reading.
    whole = documents.read_documents(spark, layout.documents, size="_size").where("_size <= 2000")
    assert whole.inputFiles() and whole.rdd.getNumPartitions() == 1 and whole.count() == 1
    assert rows.select(F.max(F.length("body"))).first()[0] < 2_000


def test_line_files_are_listed_once_and_by_few_tasks(spark, layout, monkeypatch):
    from marquee.sources import documents
    rows = spark.range(400).select((F.col("id") * 1000).alias("id"), F.format_string('{"id": %d}', F.col("id") * 1000).alias("body"))
    write_documents(rows, layout.documents)
    listed, read = [], documents.read_documents
    monkeypatch.setattr(documents, "read_documents", lambda *args, **kind: listed.append(kind) or read(*args, **kind))
    context = spark.sparkContext
    context.setJobGroup("listing", "one folder per prefix")
    try:
        found = documents.read_layer(spark, layout.documents)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [stage for job in tracker.getJobIdsForGroup("listing") for stage in tracker.getJobInfo(job).stageIds]
    tasks = [tracker.getStageInfo(stage).numTasks for stage in stages]
    assert len(listed) == 1 and max(tasks) <= 4 * context.defaultParallelism < 400
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    assert found.count() == 400
    store(layout, film(7))
    assert documents.read_layer(spark, layout.documents).count() == 401 and len(listed) == 3


def test_values_are_handed_on_parsed(spark):
    from marquee.sources.documents import framed
    texts = ['{"id": 1, "title": "a"}', '{"id": 2}{"id": 3, "adult": 1}', '{"id": 0, "id": 4}', '{"id": 5} x',
             '{"id": 6, "vote_average": NaN}', '{"id": 7.5}', 'null', '[]', '', None, '{"id": 8, "release_date": "2005-W24-3"}']
    raw = spark.createDataFrame([(text,) for text in texts], "body string")
    again = silver.parse_documents(framed(raw)).orderBy("id").collect()   # NaN equals itself in text only
    ready = framed(raw, parsed="value")
    assert ready.columns == ["body", "value"]
    assert str(silver.parse_documents(ready, parsed="value").orderBy("id").collect()) == str(again)
    assert [row.id for row in again] == [1, 2, 3, 4, 6, 8]


def test_only_documents_in_scope_are_cast_whole(spark):
    """The filter lies below the generator of the whole shape."""
    docs = silver.parse_documents(bodies(spark, film(1), film(2, original_language="fr")))
    scoped = silver.silver_scope(docs, as_of=AS_OF)
    assert [row.id for row in scoped.collect()] == [1]
    plan = scoped._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scope = next(n for n, line in enumerate(plan) if "Filter" in line and "_released" in line)
    shape = next(n for n, line in enumerate(plan) if "Generate" in line and "production_companies" in line)
    assert shape < scope
