from __future__ import annotations

import gzip
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marquee.session import build_session  # noqa: E402
from marquee.sources.layout import Layout  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[*]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        # Short queries: the quick compiler beats the optimizing one.
        "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture()
def layout(tmp_path) -> Layout:
    return Layout(str(tmp_path))


def film(number: int, **changes) -> dict:
    """A document that passes every rule, with fields replaced as asked."""
    billed = [("Mira Solberg", "the ferry pilot"), ("Tomas Quill", "her brother"), ("Joy Abara", "a surveyor")]
    staff = [("Producer", "Noor Haddad"), ("Composer", "Lev Ostrov"), ("Director", "Ruth Calder"),
             ("Producer", "Emil Brandt")]
    document = {
        "id": number, "title": f"Harbour {number}", "original_title": f"Havn {number}",
        "original_language": "en", "adult": False, "release_date": "1997-10-03", "runtime": 96,
        "budget": 24_000_000, "revenue": 84_000_000,
        "vote_average": 6.4, "vote_count": 315, "popularity": 8.25,
        "genres": [{"id": 40 + k, "name": name} for k, name in enumerate(["Mystery", "War", "Western"])],
        "production_companies": [{"id": 71, "name": "Northlight"}, {"id": 72, "name": "Cobalt"}],
        "credits": {
            "cast": [{"id": 3100 + k, "order": k, "name": name, "character": part}
                     for k, (name, part) in enumerate(billed)],
            "crew": [{"id": 4200 + k, "name": name, "job": job} for k, (job, name) in enumerate(staff)],
        },
    }
    return document | changes


def store(layout: Layout, *documents: dict) -> None:
    """One gzip file per document, in the folder of its id."""
    for document in documents:
        number = document["id"]
        folder = os.path.join(layout.documents, f"id_prefix={number // 1000:03d}")
        os.makedirs(folder, exist_ok=True)
        with gzip.open(os.path.join(folder, f"{number}.json.gz"), "wt", encoding="utf-8") as out:
            json.dump(document, out, indent=1)


def bodies(spark, *documents):
    """A frame of raw documents; strings are taken as they are."""
    return spark.createDataFrame(
        [(d if isinstance(d, str) else json.dumps(d),) for d in documents], "body string")
