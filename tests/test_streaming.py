import os

from conftest import film, store

from marquee.streaming import landing


def run(spark, layout, **options):
    stream = landing.document_stream(spark, layout.documents, **options)
    landing.start_landing(stream, layout.uri("landed"), layout.quarantine,
                          layout.uri("checkpoint")).awaitTermination()
    return landing.read_landed(spark, layout.uri("landed"))


def test_new_documents_land_once(spark, layout):
    store(layout, film(1), film(2))
    assert {r.id for r in run(spark, layout, max_files=1).collect()} == {1, 2}
    assert run(spark, layout).count() == 2
    store(layout, film(3))
    landed = run(spark, layout)
    assert sorted(r.id for r in landed.collect()) == [1, 2, 3]
    assert landed.select("batch").distinct().count() == 3


def test_copies_and_broken_documents(spark, layout):
    store(layout, film(1))
    folder = os.path.join(layout.documents, "id_prefix=000")
    import gzip
    for name, text in (("copy", '{"id": 1}'), ("cut", '{"id": 4'), ("named", '{"id": "5"}')):
        with gzip.open(os.path.join(folder, f"{name}.json.gz"), "wt") as out:
            out.write(text)
    landed = run(spark, layout)
    assert [r.id for r in landed.collect()] == [1]
    reasons = {r.reason for r in landing.read_quarantine(spark, layout.quarantine).collect()}
    assert reasons == {"not valid JSON", "id is not a whole number"}


def test_repeating_a_batch_changes_nothing(spark, layout):
    batch = spark.createDataFrame([("a", '{"id": 1}'), ("b", '{"id": 2}')], "source string, body string")
    later = spark.createDataFrame([("c", '{"id": 2}'), ("d", '{"id": 3}')], "source string, body string")
    target = layout.uri("landed")
    for number, frame in ((0, batch), (0, batch), (1, later), (1, later)):
        landing.land_batch(frame, number, target, layout.quarantine)
    landed = landing.read_landed(spark, target).collect()
    assert sorted((r.id, r.source, r.batch) for r in landed) == [(1, "a", 0), (2, "b", 0), (3, "d", 1)]


def test_stateful_landing(spark, layout):
    before = spark.conf.get(landing.STATE_STORE)
    for documents in ([film(1), film(2)], [film(2), film(3)]):
        store(layout, *documents)
        stream = landing.document_stream(spark, layout.documents)
        landing.start_stateful_landing(stream, layout.uri("landed"),
                                       layout.uri("checkpoint")).awaitTermination()
    assert sorted(r.id for r in landing.read_landed(spark, layout.uri("landed")).collect()) == [1, 2, 3]
    assert spark.conf.get(landing.STATE_STORE) == before


def test_a_second_stream_keeps_what_the_first_landed(spark, layout):
    target, quarantine = layout.uri("landed"), layout.quarantine
    first = spark.createDataFrame([("a", '{"id": 1}'), ("b", '{"id": 2}')], "source string, body string")
    second = spark.createDataFrame([("c", '{"id": 2}'), ("d", '{"id": 3}')], "source string, body string")
    landing.land_batch(first, 0, target, quarantine, landing.run_name("/one"))
    landing.land_batch(second, 0, target, quarantine, landing.run_name("/two"))
    landed = landing.read_landed(spark, target).collect()
    assert sorted((r.id, r.source) for r in landed) == [(1, "a"), (2, "b"), (3, "d")]


def test_stateful_landing_sets_broken_documents_aside(spark, layout):
    import gzip

    store(layout, film(1))
    folder = os.path.join(layout.documents, "id_prefix=000")
    texts = {"copy": '{"id": 1}', "cut": '{"id": 4', "again": '{"id": 4', "nameless": '{"key": 5}'}
    for run_of in (texts, {"late": '{"id": "6"}', "new": '{"id": 2}'}):
        for name, text in run_of.items():
            with gzip.open(os.path.join(folder, f"{name}.json.gz"), "wt") as out:
                out.write(text)
        landing.start_stateful_landing(
            landing.document_stream(spark, layout.documents), layout.uri("landed"),
            layout.uri("checkpoint")).awaitTermination()
    assert sorted(r.id for r in landing.read_landed(spark, layout.uri("landed")).collect()) == [1, 2]
    aside = landing.read_quarantine(spark, layout.uri("landed-quarantine")).collect()
    assert sorted((os.path.basename(r.source), r.reason) for r in aside) == [
        ("again.json.gz", "not valid JSON"), ("cut.json.gz", "not valid JSON"),
        ("late.json.gz", "id is not a whole number"), ("nameless.json.gz", "no id")]
    assert len({(r.run, r.batch) for r in aside}) == 2
