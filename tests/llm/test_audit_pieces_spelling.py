"""Filter interactions, SentencePiece and spelling variants against plain versions or the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import filter_audit, sentencepieces, spelling

SCHEMA = "doc_id long, text string, lang string, mask int, sha string, n long, word string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, lang, 1, "x", 2, None) for d, t, lang in rows], SCHEMA)


# --- filter interactions -------------------------------------------------------------

def failing(rows):
    """Per row the letters of the filters it fails."""
    least = defaultdict(lambda: None)
    for d, t, _ in rows:
        if d is not None and (least[t or ""] is None or d < least[t or ""]):
            least[t or ""] = d
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least[t]
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), d is not None and first is not None and d > first]
        out.append({k for k, bad in zip("ABCDE", fails) if bad})
    return out


def audited(rows, labels):
    good = {d for d, q, _ in labels if q == 1} - {None}  # a null meets no document
    toxic = {d for d, _, x in labels if x == 1} - {None}
    fails, want, worth = failing(rows), {}, Counter()
    for part in {r[2] or "" for r in rows}:
        own = [(f, r[0]) for f, r in zip(fails, rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone, stay = [x for x in left if k in x[0]], [x for x in left if k not in x[0]]
                every = [x for x in own if k in x[0]]
                want[part, "".join(order), step] = [
                    len(stay), len(gone), len(every) - len(gone), sum(f == {k} for f, _ in own),
                    sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)]
                worth[part, k] += len(gone)
                left = stay
    return {key: (*values, worth[key[0], key[1][key[2] - 1]]) for key, values in want.items()}


def audit_rows(seed):
    draw = random.Random(seed)
    rows = []
    for i in range(120):
        n = draw.choice([0, 3, 99, 100, 130])
        words = [f"w{draw.randrange(20 if i % 3 else 5000)}" for _ in range(n)]
        if i % 4 == 0:
            words = [w.upper() for w in words]
        if i % 5 == 0 and words:
            words[0] += draw.choice("#$%&*|")
        rows.append((i, draw.choice([" ", "\n", "\x0b "]).join(words), draw.choice(["en", "fr", None, ""])))
    rows += [(200 + i, rows[i % 7][1], "en") for i in range(60)]
    return rows + [(None, rows[2][1], "en"), (None, None, None), (5, rows[5][1], "de"), (5, rows[5][1], "de"),
                   (300, "é ß" * 40_000, "fr"), (301, "|", "x")]


@pytest.mark.parametrize("share", [1_000, 4])
def test_audit_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", share)  # with 4, only larger groups are hot
    rows = audit_rows(1)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 260, 3)] + [(None, 1, 1), (6, None, 1), (6, 1, None), (9, 0, 0)]
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(frame(spark, rows), marks).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), none).count() == 0
    got = filter_audit.audit(frame(spark, [(1, "a", "en")]), none).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert filter_audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_survival_words_list_the_surviving_subsets():
    for mask, word in enumerate(filter_audit.survival_words().tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(s & mask == 0) for s in range(32)]


# --- SentencePiece ---------------------------------------------------------------------

TEXTS = ["", "  a  b ", "a\x00b\n\tc", "▁x", "▁", " ", "<s>hi</s>", "<0x41>", "日本\U0001F600é", "　x", "ﬁ", "<unk>",
         "x" * 500, "ab" * 3000, " " * 300, "a﻿b", "\r\n  ", "é́", "\U0010ffff"]


def test_pieces_equal_the_library(spark):
    library = sentencepieces._library(sentencepieces.VOCABULARY)
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choices("ab ▁éß0日\n", k=draw.randint(0, 40))) for _ in range(300)] + [None, "the cat " * 40_000]
    rows = [(i if i % 50 else None, t, "en") for i, t in enumerate(texts)]
    docs = frame(spark, rows + rows[:3])
    want = Counter()
    for d, t, _ in rows + rows[:3]:
        ids = library.encode(t or "")
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(library.decode(ids).encode()).hexdigest(), True] += 1
    assert Counter(map(tuple, sentencepieces.encode_digests(docs).collect())) == want
    assert sentencepieces.encode_digests(docs, check=False).where("library_agrees is null").count() == len(rows) + 3
    encoded = sentencepieces.encode(docs.where("doc_id is not null"))
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded).collect()}
    assert all(back[d] == library.decode(library.encode(t or "")) for d, t, _ in rows if d is not None)
    assert sentencepieces.encode_digests(frame(spark, [])).count() == 0


def test_all_code_points_and_any_ids():
    own, library = sentencepieces._bpe(sentencepieces.VOCABULARY), sentencepieces._library(sentencepieces.VOCABULARY)
    points = [*range(1, 0xD800), *range(0xE000, 0x32000), *range(0x10FF00, 0x110000)]
    for at in range(0, len(points), 500):
        text = "".join(map(chr, points[at:at + 500]))
        assert own.encode(text) == library.encode(text)
    draw = random.Random(4)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32_000), draw.randrange(259), draw.randrange(250, 270)]) for _ in range(draw.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_both_agendas_merge_alike():
    own = sentencepieces._bpe(sentencepieces.VOCABULARY)
    draw = random.Random(5)
    words = ["▁" + "".join(draw.choices("thernio▁é\n日", k=draw.randint(0, 60))) for _ in range(2000)]
    assert own.merge_all(words) == [own.merge(w) for w in words]


def test_a_difference_from_the_library_is_told():
    class Odd:
        def encode(self, texts, num_threads):
            return [[1] if t == "b" else own.encode(t) for t in texts]

    own = sentencepieces.PieceBpe(sentencepieces.VOCABULARY)
    run = own.parts(["a b", "a a"], Odd())
    assert [all(p[3] for p in parts) for parts in run] == [False, True]


# --- spelling variants -------------------------------------------------------------------

def variants(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    replaced, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            replaced[i, less].add(w)
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for own in replaced.values():
        for w in own:
            near[w] |= own - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


@pytest.mark.parametrize("entries", [100_000, 40, 2])
def test_variants_equal_brute_force(spark, entries):
    draw = random.Random(2)
    docs = [(None, "Straße straße STRAßE abcde abcdf " * 3), (1, None), (2, ""), (3, "\n - 12"),
            (4, ("x" * 3000 + " " + "x" * 3001 + " é" + "x" * 2999 + " ") * 5), (7, "horse " * 500), (7, "horse " * 500)]
    docs += [(i, " ".join("".join(draw.choices("abÀé", k=draw.randint(4, 9))) for _ in range(150))) for i in range(10, 50)]
    odd = ["house", "housse", "hause", "houses", "horse", "Garden", "gardens", "wünsche", "wunsche", "÷××÷÷", "÷××÷", "Àbcdé"]
    docs += [(i, " ".join(draw.choices(odd, [9, 1, 1, 3, 4, 9, 2, 5, 1, 1, 1, 1], k=60))) for i in range(100, 130)]
    got = spelling.spelling_variants(frame(spark, [(*x, "en") for x in docs]), entries=entries).collect()
    assert Counter(map(tuple, got)) == variants(docs)


def test_no_words(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None, None), (2, "a b 12", "")])).count() == 0


def test_an_edit_affects_no_more_grams_than_the_bound():
    draw = random.Random(6)
    words = ["".join(draw.choices("abc", k=draw.randint(5, 12))) for _ in range(300)]
    seen = Counter(g for w in words for q in range(2, 8) for k in range(len(w) + 3 - q)
                   for g in [tuple(spelling.Grams(pa.array([w])).flat[k:k + q])])
    frequent = []
    for q in range(2, 8):
        codes = [sum(int(x) << 7 * (q - 1 - i) for i, x in enumerate(g)) for g, c in seen.items() if len(g) == q and c > 20]
        frequent.append(np.sort(np.array(codes, np.int64)))

    def grams(word, most):
        own = spelling.Grams(pa.array([word]))
        code, length = own.grown(frequent, np.array([most]))
        return {(k, int(code[k]), int(length[k])) for k in np.flatnonzero(length)}, int(spelling.affected(own, length)[0])

    for word in words[:100]:
        at = draw.randrange(len(word))
        swapped, added = word[:at] + "d" + word[at + 1:], word[:at] + draw.choice("abd") + word[at:]
        most = min(8, len(word))
        mine, bound = grams(word, most)
        assert len(mine) == len(word) + 1 and bound <= most
        assert len(mine & grams(swapped, most)[0]) >= len(mine) - bound
        longer = grams(added, most)[0]
        assert sum((k, c, n) in longer or (k + 1, c, n) in longer for k, c, n in mine) >= len(mine) - bound


def test_registered_queries_read_whole_documents(spark):
    from marquee.llm import catalog

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    assert Counter(map(tuple, catalog.QUERIES["op13_variable_grams"](spark, folder).collect())) == variants([r[:2] for r in rows])
    library = sentencepieces._library(sentencepieces.VOCABULARY)
    got = {r.doc_id: r.ids_sha256 for r in catalog.QUERIES["op12_pair_agenda"](spark, folder).where(F.col("library_agrees")).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest() for d, t, _ in rows}
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    audit = catalog.QUERIES["op11_survival_words"](spark, folder).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit} == audited(rows, labels)
