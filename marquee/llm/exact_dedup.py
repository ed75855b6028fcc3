"""Exact de-duplication with Patricia tries.

Two passes. Every map task first collapses the equal texts of its own rows, so a group
of copies of any size reaches the shuffle as one row per task and slice. The survivors
are dealt by length and content hash; each bucket inserts full byte strings into a
compressed radix trie whose terminal nodes hold the owner's id. Equality is decided by
the bytes, never by the hash. A bucket whose strings exceed ``trie_bytes`` spills its
largest subtree: those rows are stored in the shared folder and dealt anew, with
another hash, until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.filtering import keep_chosen, text_print
from marquee.llm.texts import documents, text_slices
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
#: Bytes of text dealt to one task.
TASK_BYTES = 32 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class PatriciaTrie:
    """Byte strings in a compressed radix trie; each terminal holds the ids it has seen.

    A node is [edge label, children by first byte, payload or None, bytes below].
    """

    def __init__(self) -> None:
        self.root = [b"", {}, None, 0]

    def insert(self, key: bytes) -> list | None:
        """The key's node, made if need be; None below a subtree that was spilled."""
        node, at = self.root, 0
        path = [node]
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None, 0]
                node[1][key[at]] = child
                for above in path:
                    above[3] += len(key) - at
                return child
            if child[1] is None:
                return None
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                path.append(node)
                continue
            shared, most = 1, min(len(label), len(key) - at)
            step = 1
            while shared < most:  # doubling steps, then halving: few slices per edge
                if key.startswith(label[shared:shared + step], at + shared) and shared + step <= most:
                    shared += step
                    step *= 2
                elif step > 1:
                    step //= 2
                else:
                    break
            upper = [label[:shared], {label[shared]: child}, None, child[3] + len(label) - shared]
            child[0] = label[shared:]
            node[1][key[at]] = upper
            node, at = upper, at + shared
            path.append(upper)
        return node

    def spill(self) -> list:
        """Cut off the root's largest subtree and return the payloads it held."""
        first = max(self.root[1], key=lambda b: self.root[1][b][3] + len(self.root[1][b][0])
                    if self.root[1][b][1] is not None else -1)
        child = self.root[1][first]
        self.root[3] -= child[3] + len(child[0])
        found, todo = [], [(child, child[0])]
        while todo:
            node, prefix = todo.pop()
            if node[2] is not None:
                found.append((prefix, node[2]))
            todo += [(below, prefix + below[0]) for below in (node[1] or {}).values()]
        child[:] = [child[0][:1], None, None, 0]
        return found


_ROWS = pa.schema([("row_id", pa.string()), ("doc_id", pa.int64()), ("print", pa.int64()), ("carrier", pa.string()),
                   ("sha", pa.string()), ("text", pa.binary()), ("bytes", pa.int64()),
                   ("top", pa.int64()), ("top_row", pa.string()), ("copies", pa.int64())])
_ROWS_SQL = ("row_id string, doc_id bigint, print bigint, carrier string, sha string, text binary, bytes bigint, "
             "top bigint, top_row string, copies bigint")
_OWNED = pa.schema([("carrier", pa.string()), ("keep_row", pa.string()), ("keep_id", pa.int64()),
                    ("group_size", pa.int64()), ("text", pa.binary()), ("top", pa.int64()),
                    ("top_row", pa.string()), ("copies", pa.int64())])
_OWNED_SQL = ("carrier string, keep_row string, keep_id bigint, group_size bigint, text binary, "
              "top bigint, top_row string, copies bigint")


def _before(a: tuple, b: tuple) -> bool:
    """Whether (doc_id, row) a goes before b: larger doc_ids first, nulls last, then by row."""
    if (a[0] is None) != (b[0] is None):
        return b[0] is None
    return (a[0], b[1]) > (b[0], a[1]) if a[0] is not None else a[1] < b[1]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal normalised text within a slice share one carrier of the text."""
    for batch in text_slices(batches, 2 << 20):
        trie, held = PatriciaTrie(), []
        rows = []
        for row, doc, name, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "print", "text"))):
            key = (text or "").encode().translate(_LOWER)
            node = trie.insert(key)
            if node[2] is None:
                node[2] = [row, hashlib.sha256(key).hexdigest(), len(rows), (doc, row), 0]
                held.append(node[2])
                rows.append([row, doc, name, row, node[2][1], key, len(key), None, None, None])
            else:
                rows.append([row, doc, name, node[2][0], node[2][1], None, None, None, None, None])
            node[2][4] += 1
            if _before((doc, row), node[2][3]):
                node[2][3] = (doc, row)
        for _, _, at, (top, top_row), copies in held:
            rows[at][7:] = top, top_row, copies
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _ROWS.types)], schema=_ROWS)


def _owners(trie_bytes: int):
    def packed(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _OWNED.types)], schema=_OWNED)

    def unresolved(spilled):
        return [(carrier, None, None, None, key, top, top_row, copies)
                for key, members in spilled for carrier, top, top_row, copies in members]

    def resolved(trie):
        rows, todo = [], [trie.root]
        while todo:
            node = todo.pop()
            if node[2]:
                best = node[2][0][1:3]
                for member in node[2][1:]:
                    if _before(member[1:3], best):
                        best = member[1:3]
                size = sum(member[3] for member in node[2])
                rows += [(member[0], best[1], best[0], size, None, None, None, None) for member in node[2]]
            todo += (node[1] or {}).values()
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one trie is held at a time."""
        bucket, trie, spilled = None, PatriciaTrie(), []
        for batch in batches:
            for at, key, *member in zip(*(batch.column(c).to_pylist() for c in
                                          ("bucket", "text", "carrier", "top", "top_row", "copies"))):
                if at != bucket:
                    if rows := resolved(trie):
                        yield packed(rows)
                    bucket, trie = at, PatriciaTrie()
                node = trie.insert(key)
                if node is None:
                    spilled.append((key, [member]))
                else:
                    node[2] = node[2] or []
                    node[2].append(member)
                    if trie.root[3] > trie_bytes and sum(c[1] is not None for c in trie.root[1].values()) > 1:
                        spilled += trie.spill()
                if len(spilled) >= 256:
                    yield packed(unresolved(spilled))
                    spilled = []
        if rows := resolved(trie) + unresolved(spilled):
            yield packed(rows)
    return run


def exact_groups(docs: DataFrame, *, trie_bytes: int = 16 << 20) -> DataFrame:
    """Groups of equal texts (A-Z lower-cased; null counts as empty).

    Returns one row per input row: ``doc_id``, ``keep_id`` (largest doc_id of the group,
    null only if all are null), ``group_size``, ``kept`` (one row of each group; of rows
    that repeat the largest doc_id one stays) and ``text_sha256``. Other columns are ignored; an empty table gives no rows.
    ``trie_bytes`` bounds the strings of one trie; what exceeds it is spilled by subtree.
    """
    return _grouped(docs, trie_bytes).select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def _grouped(docs: DataFrame, trie_bytes: int) -> DataFrame:
    # A row's own name keeps repeated rows apart; it is stored before it is used twice.
    named = docs.select(
        F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()).alias("row_id"),
        F.col("doc_id").cast("bigint").alias("doc_id"), text_print().alias("print"),
        F.col("text").cast("string").alias("text"))
    rows = materialize(named.mapInArrow(_collapse, _ROWS_SQL), "dedup-rows")
    held = rows.agg(F.sum("bytes")).first()[0] or 0
    buckets = 1 << max(6, (4 * held // trie_bytes).bit_length())
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, held // TASK_BYTES)
    todo, owned, turn = rows.where("text is not null"), None, 0
    while True:
        key = F.xxhash64(F.length("text"), F.xxhash64("text"), F.lit(turn))
        dealt = (todo.select(F.pmod(key, F.lit(buckets << turn)).alias("bucket"), "text", "carrier",
                             "top", "top_row", "copies")
                 .repartition(tasks, "bucket").sortWithinPartitions("bucket"))
        stored = materialize(dealt.mapInArrow(_owners(trie_bytes << (2 * turn)), _OWNED_SQL),
                             f"dedup-owners-{turn}")
        done = stored.where("keep_row is not null").select("carrier", "keep_row", "keep_id", "group_size")
        owned = done if owned is None else owned.unionByName(done)
        todo = stored.where("keep_row is null")
        if todo.isEmpty():
            break
        turn += 1
    return rows.select("row_id", "doc_id", "print", "carrier", "sha").join(owned, "carrier")


def one_of_each(docs: DataFrame, *, trie_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one of the largest doc_id."""
    return keep_chosen(docs, _grouped(docs, trie_bytes).select(
        "doc_id", "print", (F.col("row_id") == F.col("keep_row")).alias("keep")))


@REGISTRY.add(sql="""
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))
