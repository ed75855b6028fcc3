"""Small cases of the text operators, held against plain versions or the libraries."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from marquee.llm import (
    bpe, exact_dedup, jaccard, language, line_dedup, lm_scoring, neighbours, packing, sharding, toxicity,
)

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("print", StringType()),
                   StructField("node", LongType())])
ODD = [(1, "One two three four five six", "en", "x", 1), (2, "ONE two three four five six", "en", None, 1),
       (3, None, None, None, None), (4, "", "fr", "", 0), (None, "one two three four five six", None, "x", 2),
       (1, "One two three four five six", "en", "x", 1), (7, "mot " * 30_000, "fr", "y", 3),
       (8, "\n \t\n", "en", "z", 4), (9, "né à l'été 42 !!", "fr", "z", 4)]


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, DOCS)


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def copies(seed, n=160):
    """Texts of which many are near copies of each other."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.randint(8, 60))] for _ in range(25)]
    out = []
    for i in range(n):
        own = list(draw.choice(bases))
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        out.append((i, " ".join(own), "en", None, None))
    return out


@pytest.mark.parametrize("most", [2_000_000, 150])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "PART_SHINGLES", most)
    rows = copies(1) + ODD[2:4]
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and top[i] != top[j]:
                old, new = top[i], top[j]
                top = [new if t == old else t for t in top]
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        least[top[i]] = min(least[top[i]], r[0])
    want = Counter((r[0], len(s), least[t]) for r, s, t in zip(rows, sets, top))
    assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows)).collect())) == want


def test_jaccard_null_ids_and_repeats(spark):
    got = {tuple(r) for r in jaccard.jaccard_components(frame(spark, ODD)).collect()}
    assert {(1, 2, 1), (2, 2, 1), (None, 2, 1), (3, 0, 3), (4, 0, 4), (8, 0, 8)} <= got


def test_signature_tree_bound_never_prunes_a_linked_pair():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:draw.integers(200, 300)], draw.integers(0, 1 << 63, draw.integers(0, 90), dtype=np.uint64)]))
            for _ in range(40)]
    tree = jaccard.SignatureTree(sets)
    for i in range(40):
        for j in range(40):
            if jaccard.linked(sets[i], sets[j]):
                assert tree.possible(0, np.array([i]), np.array([j]))[0]


@pytest.mark.parametrize("trie_bytes", [1 << 24, 30])
def test_exact_groups(spark, trie_bytes):
    rows = ODD + copies(2, 60) + copies(2, 60)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "") for r in rows]
    ids, size = defaultdict(list), Counter(lower)
    for r, t in zip(rows, lower):
        if r[0] is not None:
            ids[t].append(r[0])
    want = Counter((r[0], max(ids[t]), size[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, lower))
    got = exact_dedup.exact_groups(frame(spark, rows), trie_bytes=trie_bytes).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(size) and all(r.doc_id == r.keep_id for r in kept)


def test_one_of_each_keeps_one_row_of_repeats(spark):
    left = exact_dedup.one_of_each(frame(spark, ODD)).collect()
    assert len(left) == 5 and Counter(r.doc_id for r in left) == Counter([2, 7, 8, 9, 4])


def test_shards_are_a_permutation(spark):
    rows = ODD + copies(3, 100)
    got = sharding.shards(frame(spark, rows)).collect()
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sorted(map(tuple, sharding.shards(frame(spark, rows[::-1])).select("doc_id", "shard").collect()), key=str) \
        == sorted(((r.doc_id, r.shard) for r in got), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 5000])
def test_feistel_places(spark, n):
    places = [r[0] for r in spark.range(n).select(F.expr(sharding.feistel_place("id", n))).collect()]
    assert sorted(places) == list(range(n))


TEXTS = ["", "ΣΑΣ ΟΔΟΣ it's I'LL  x<|endoftext|>y <|startoftext|>", "a\x1cb c  d", "Éé ñ 123 $$$ '' 's",
         "x" * 3000, "ab" * 500, " lead", "trail ", "a \n b\n\nc\t d", "日本語 テスト 😀😀", "don't  <|endoftext|>  x"]


def test_bpe_equals_the_library_and_decodes(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.VOCABULARY)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_digests(docs).collect()}
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and decoded[i] == back
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_digests(frame(spark, ODD)).count() == len(ODD)


def test_packing_places_every_token(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(packing.VOCABULARY)
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(50, None, None, None, None), (51, "the cat sat " * 900, None, None, None)]
    got = packing.pack(frame(spark, rows)).collect()
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            own = ids[r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024


def test_plan_bins_packs_all_and_wastes_little():
    counts = np.bincount(np.random.default_rng(1).integers(1, 1025, 20_000), minlength=1025)
    plan = packing.plan_bins(counts, 1024)
    packed = np.zeros(1025, np.int64)
    for pattern, bins in plan:
        assert sum(s * n for s, n in pattern) <= 1024
        for s, n in pattern:
            packed[s] += n * bins
    assert (packed == counts).all()
    assert sum(b for _, b in plan) <= 1.03 * (counts * np.arange(1025)).sum() / 1024


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def test_banded_distance_equals_the_plain_one():
    draw = random.Random(4)
    for _ in range(3000):
        a = bytes(draw.choices(b"ab", k=draw.randint(0, 9)))
        b = bytes(draw.choices(b"ab", k=draw.randint(0, 9)))
        assert line_dedup.within(a, b) == (edit_distance(a, b) <= 2)


@pytest.mark.parametrize("most", [1 << 24, 300])
def test_near_lines_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "PART_BYTES", most)
    draw = random.Random(3)
    bases = ["".join(draw.choices("abcdeé ", k=draw.randint(18, 40))) for _ in range(30)]

    def edited(line):
        own = list(line)
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = draw.choice(["x", "yy", ""])
        return "".join(own)

    docs = [(i, "\n".join(edited(draw.choice(bases)) for _ in range(draw.randint(0, 5)))) for i in range(70)]
    docs += [(200, None), (201, ""), (202, "\n\nshort\n"), (None, bases[0])]
    got = Counter((r.doc_id, r.n_lines, tuple(r.dropped)) for r in line_dedup.near_lines(
        spark.createDataFrame(docs, "doc_id long, text string")).collect())
    cut = [[x.encode() for x in (t or "").split("\n") if x] for _, t in docs]
    lines = sorted({x for own in cut for x in own if len(x) >= 20})
    top = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if top[i] != top[j] and abs(len(lines[i]) - len(lines[j])) <= 2 and edit_distance(lines[i], lines[j]) <= 2:
                old, new = top[i], top[j]
                top = [new if t == old else t for t in top]
    label, seen, dropped = dict(zip(lines, top)), set(), defaultdict(list)
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0)):
        for n, line in enumerate(cut[k]):
            if line in label:
                if label[line] in seen:
                    dropped[k].append(n)
                seen.add(label[line])
    assert got == Counter((d, len(cut[k]), tuple(dropped[k])) for k, (d, _) in enumerate(docs))


def test_lm_scores_edges(spark):
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, [(1, "a b", "", "", 0), (2, "A b", "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0)])).collect()}
    assert got[3].n_words == 0 and got[3].score is None and got[4].micro_log == 0
    assert got[1].micro_log == 0 and got[2].micro_log == 0  # each bigram is certain from the other text
    assert lm_scoring.score(frame(spark, ODD)).count() == len(ODD)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores_equal_brute_force(spark, order):
    draw = random.Random(order)
    texts = [" ".join(draw.choices("aab" if i % 2 else "abcde", k=draw.randint(0, 9))) for i in range(60)]
    own = []
    for text in texts:
        padded = ["", *text.split(), ""] if text else []
        own.append(Counter(tuple(padded[i - k + 1:i + 1]) for i in range(1, len(padded))
                           for k in range(1, order + 1) if i - k + 1 >= 0))
    every = sum(own, Counter())
    size = max(sum(len(t.split()) for t in texts) - 1, 1)

    def micro(text, mine):
        padded, found = ["", *text.split(), ""], 0
        for i in range(1, len(padded) if text else 0):
            factor, k = 1.0, min(order, i + 1)
            while k > 1:
                gram = tuple(padded[i - k + 1:i + 1])
                n = every[gram] - mine[gram]
                if n:
                    context = gram[:-1]
                    chance = factor * (n / (every[context] - mine[context]))
                    break
                factor, k = factor * lm_scoring.BACKOFF, k - 1
            else:
                n = every[(padded[i],)] - mine[(padded[i],)]
                chance = factor * (n or lm_scoring.UNSEEN) / size
            found += round(math.log(chance) * lm_scoring.PARTS)
        return found

    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r.micro_log for r in lm_scoring.score(docs, order=order).collect()}
    assert all(abs(got[i] - micro(t, own[i])) <= 10 for i, t in enumerate(texts))


def test_trigrams_tell_repeated_triples_from_new_ones(spark):
    from marquee.llm import catalog

    assert "op6_trigram_backoff" in catalog.QUERIES
    docs = frame(spark, [(i, t, "", "", 0) for i, t in enumerate(["a b c", "a b c", "d b e", "d b c"])])
    both = [{r.doc_id: r.micro_log for r in lm_scoring.score(docs, order=k).collect()} for k in (2, 3)]
    assert both[1][0] > both[0][0] and both[1][2] != both[0][2]


def test_lm_frequent_words_travel_once_a_slice():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(5000)), pa.array(["the the the"] * 5000), pa.array(["x"] * 5000)],
                            ["doc_id", "text", "name"])
    rows = [r for out in lm_scoring._asked(3, 2)(iter([batch])) for r in out.to_pylist()]
    # the word, the mark, and three pairs of them
    assert sum(len(r["keys"]) // 8 for r in rows) == 5


def test_neighbours_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 150)
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((6, 12))
    x = centres[draw.integers(0, 6, 900)] + 0.5 * draw.standard_normal((900, 12))
    x[100:400] = x[100]  # one vector holds a third of the rows
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(2000, None, ""), (2020, [0.0] * 12, ""), (2040, [float("nan")] + [1.0] * 11, ""), (2060, [1.0], ""), (None, [1.0] * 12, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-round(scores[i], 9), i))[:10]
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 10
        assert all(math.isclose(s, scores[i], rel_tol=1e-12) for i, s in found)
        hits += len({i for i, _ in found} & set(best))
    assert hits >= 0.95 * 10 * len(got)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_maximal_segments_equal_the_recursive_definition():
    def recursive(scores, base=0):
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        best = max(((sums[j] - sums[i], i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, i, j = best
        return recursive(scores[:i], base) + [(base + i, base + j)] + recursive(scores[j:], base + j)

    draw = np.random.default_rng(3)
    for _ in range(200):
        scores = draw.normal(-0.2, 1, 12)
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        items = np.flatnonzero(scores > 0)
        found = [(int(items[a]), int(items[b]) + 1) for _, a, b in toxicity.maximal_segments(sums[items].tolist(), sums[items + 1].tolist())]
        assert found == recursive(scores)


def test_toxicity_learns_planted_words_and_handles_odd_rows(spark):
    draw = random.Random(6)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        own = [draw.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            own[draw.randrange(40)] = draw.choice(["vile", "Rotten", "nasty"])
        rows.append((i, " ".join(own), None, None, None))
        labels.append((i, int(bad)))
    docs, marks = frame(spark, rows + ODD[2:]), spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = [r for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) + len(ODD) - 2 and all(0 <= r.score <= 1 for r in got)
    right = sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got[:600])
    # several weak passages may tell only together
    assert right >= 590 and any(r.passages for r in got[:600] if r.score >= 0.9)
    nothing = toxicity.fit(docs, marks.limit(0))
    assert all(r.score < 0.7 for r in toxicity.score(docs, nothing).collect())


def test_language_spans(spark):
    draw = random.Random(8)
    sounds = {"aa": ["ka", "mo", "ti"], "bb": ["schu", "ver", "ung"], "gg": ["λα", "μο", "τι"]}

    def text(lang, n=30):
        return " ".join("".join(draw.choices(sounds[lang], k=3)) for _ in range(n))

    rows = [(i, text(lang), lang, None, None) for i in range(60) for lang in [list(sounds)[i % 3]]]
    model = language.fit(frame(spark, rows))
    odd = [(100, text("aa", 20) + " " + text("bb", 8), None, None, None), (101, None, None, None, None), (102, "12 -- !", None, None, None), (103, "日本", None, None, None)]
    got = {r.doc_id: r for r in language.predict(frame(spark, rows + odd), model, spans=True).collect()}
    assert all(got[i].lang_pred == r[2] for i, r in enumerate(rows))
    assert [s.lang for s in got[100].spans] == ["aa", "bb"] and got[100].lang_pred == "aa"
    assert (got[101].lang_pred, got[102].lang_pred, got[103].score) == ("und", "und", 0.0)
    assert language.predict(frame(spark, rows), language.fit(frame(spark, rows).limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_empty_tables(spark):
    empty = frame(spark, [])
    for run in (exact_dedup.exact_groups, sharding.shards, bpe.encode_digests, packing.pack, lm_scoring.score,
                line_dedup.near_lines, jaccard.jaccard_components, exact_dedup.one_of_each, jaccard.one_of_each):
        assert run(empty).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == docs.columns
        assert left.exceptAll(docs).count() == 0 and 0.7 * before < left.count() <= before
        docs = left
    texts = [r.text for r in docs.collect()]
    assert len({t.lower() for t in texts}) == len(texts)
    sets = [shingles(t) for t in texts]
    assert not any(a and b and 100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
