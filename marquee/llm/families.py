"""Links within candidate components of any size, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.components import components
from marquee.llm.filtering import if_small
from marquee.session import materialize

#: (names, members' bytes, labels) -> edges; members of equal label are joined already.
Link = Callable[[list[int], list[bytes], list[int]], list[tuple[int, int]]]


def _applied(link: Link):
    def run(table: pa.Table) -> pa.Table:
        seen = dict(zip(table.column("node").to_pylist(),
                        zip(table.column("members").to_pylist(), table.column("label").to_pylist())))
        edges = link(list(seen), [m for m, _ in seen.values()], [label for _, label in seen.values()])
        return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()),
                         "v": pa.array([v for _, v in edges], pa.int64())})
    return run


KEY = ("family", "band", "part")


def _links(members: DataFrame, places: DataFrame, link: Link) -> DataFrame:
    """Links within each group of stored places (family, band, part, node, label).

    Only numbers decide the places; the members are brought to them in one shuffle.
    """
    return materialize(members.select("node", "members").join(if_small(places.select(*KEY, "node", "label")), "node")
                       .groupBy(*KEY).applyInArrow(_applied(link), "u long, v long"), "links")


def links_within(members: DataFrame, candidates: DataFrame, link: Link, band: Column, most: int) -> DataFrame:
    """Edges (u, v) that join all that links connect, within the candidate components.

    ``members`` has node, n and members (its bytes), ``candidates`` node and label. ``link``
    finds the edges among some of them in one task. A component whose n add up to more than
    ``most`` is cut into bands; what can link is in one ``band`` or in neighbouring ones, so
    the lower goes to both. A band that is still too large is cut into parts.
    """
    sized = members.select("node", "n").join(candidates.withColumnRenamed("label", "family"), "node").distinct()
    sized = materialize(sized, "link-members")
    sizes = sized.groupBy("family").agg(F.sum("n").alias("total"))
    none = F.lit(-1).cast("bigint")
    banded = sized.join(sizes, "family").withColumn("band", F.explode(
        F.when(F.col("total") > most, F.array(band, band + 1)).otherwise(F.array(none))))
    parts = banded.groupBy("family", "band").agg(F.ceil(F.sum("n") / most).cast("bigint").alias("parts"))
    parts = parts.withColumn("parts", F.when(F.col("band") < 0, 1).otherwise(F.col("parts")))
    places = materialize(banded.join(parts, ["family", "band"]).select(
        "family", "band", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "parts", "node",
        F.col("node").alias("label")), "link-places")
    edges = _links(members, places, link)
    split = places.where("parts > 1")
    if split.isEmpty():
        return edges
    # Across parts: first one member of each part's largest component, then, in every part,
    # whatever is not in the largest component of its band.
    def labelled():
        known = components(edges).withColumnRenamed("label", "known")
        now = split.join(known, "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known")
        return materialize(now, "link-labels")

    band_key = ["family", "band"]
    now = labelled()
    count = now.groupBy(*KEY, "label").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    leaders = count.groupBy(*KEY).agg(F.max(F.struct("c", "node", "label")).alias("best")).select(
        *band_key, F.lit(0).cast("bigint").alias("part"), "best.node", "best.label")
    edges = edges.unionByName(_links(members, materialize(leaders, "link-leaders"), link))
    now = labelled()
    most = (now.groupBy(*band_key, "label").agg(F.count("*").alias("c")).groupBy(*band_key)
            .agg(F.max(F.struct("c", "label")).alias("best")).select(*band_key, F.col("best.label").alias("most")))
    others = now.join(most, band_key).where("label <> most")
    visitors = others.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    columns = [*KEY, "node", "label"]
    last = materialize(now.select(*columns).unionByName(visitors.select(*columns)), "link-visits")
    return edges.unionByName(_links(members, last, link))
