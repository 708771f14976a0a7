"""Jaccard join, cross-tokenizer alignment and filter audit against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lightsift.llm import cross_tokenizer as X
from lightsift.llm import filter_audit as A
from lightsift.llm import jaccard_join as J

rnd = random.Random(11)
WORDS = [f"w{i}" for i in range(300)]
KIND = "doc_id long, text string, source string, n int, class long, part string"


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def changed(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return " ".join(words)


BASE, PASSAGE = prose(150), prose(60)
ROWS = [(i, prose(rnd.randrange(1, 60)), "abc"[i % 3], 1, 2, "z") for i in range(60)]
ROWS += [(100 + i, changed(BASE, rnd.randrange(0, 4)), "hot", 1, 2, "z") for i in range(120)]
ROWS += [(300 + i, prose(30) + " " + PASSAGE + " " + prose(30), "hot", 1, 2, "z") for i in range(40)]
ROWS += [(400 + i, PASSAGE + " " + prose(i % 9), "b", 1, 2, "z") for i in range(40)]
ROWS += [(500, None, None, 0, 0, "z"), (501, "", "a", 0, 0, "z"), (502, " \n\t", None, 0, 0, "z"), (503, "A b c", "a", 0, 0, "z"), (504, "a B  c", "a", 0, 0, "z"), (505, prose(5000), "b", 0, 0, "z")]
ROWS += [(None, BASE, "c", 0, 0, "z"), (None, BASE, "c", 0, 0, "z"), (None, "only here and nowhere else at all", "c", 0, 0, "z"), (100, ROWS[60][1], "hot", 1, 2, "z"), (100, ROWS[60][1], "hot", 1, 2, "z"), (506, "a b c d e f g h", "a", 0, 0, "z"), (507, "b c d e f g h", "a", 0, 0, "z")]
ROWS += [(600, "tab\tand <|endoftext|> and </s> <unk> ▁", "a", 0, 0, "z"), (601, "日本語のテキスト。 é é ﬁ 🙂\n\n  x  ", "b", 0, 0, "z"), (602, "SHOUT " * 60 + "#", "a", 0, 0, "z"), (603, "SHOUT " * 60 + "#", "c", 0, 0, "z")]


def big(i):
    return math.inf if i is None else i


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(5)


def shingles(text):
    words = [w.encode() for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def plain_join(rows, percent=80):
    sets = [shingles(r[1]) for r in rows]
    first = {}
    for r, s in zip(rows, sets):
        first[s] = min(first.get(s, math.inf), big(r[0]))
    first.pop(frozenset(), None)
    of = list(first)
    root = list(range(len(of)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(of):
        for j in range(i):
            both = len(s & of[j])
            if 100 * both >= percent * (len(s) + len(of[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, s in enumerate(of):
        least[find(i)] = min(least.get(find(i), math.inf), first[s])
    at = {s: find(i) for i, s in enumerate(of)}
    return sorted((big(r[0]), len(s), least[at[s]] if s else big(r[0])) for r, s in zip(rows, sets))


@pytest.mark.parametrize("n_members", [32, 3])
def test_jaccard(docs, n_members):
    out = J.jaccard_join(docs, n_members=n_members)
    got = sorted((big(r.id), r.n_shingles, big(r.component_id)) for r in out.collect())
    assert got == plain_join(ROWS)
    sizes = Counter(c for _, _, c in got)
    assert sizes[100] >= 100 and sum(n > 1 for n in sizes.values()) == 4


def test_jaccard_empty_tables(spark, docs):
    assert J.jaccard_join(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [(r.id, r.n_shingles, r.component_id) for r in J.jaccard_join(none).collect()] == [(None, 0, None)] * 3


def test_bounds_hold_for_all_sizes():
    """Whatever two sets link: neither misses more than it may, and they differ by no more than they may."""
    for n in range(1, 60):
        for m in range(n, 80):
            for both in range(n + 1):
                if J.linked(np.int64(both), np.int64(n), np.int64(m), 80):
                    assert all(x - both <= x - J.required(np.int64(x), 80) for x in (n, m)) and n + m - 2 * both <= J.may_differ(np.int64(n), np.int64(m), 80)
                    assert n == m == both or (J.can_link(np.array([n, m]), 80)).all()


def test_crowds_ask_group_by_group(spark):
    """Crowds that are near each other but not linked, in groups of two sets, with long runs of one key."""
    rows = []
    for k in range(6):
        base = changed(BASE, 14)
        rows += [(1000 * k + i, changed(base, 3), "x", 1, 2, "z") for i in range(45)]
    out = J.jaccard_join(spark.createDataFrame(rows, KIND).repartition(4), n_members=2)
    assert sorted((r.id, r.n_shingles, r.component_id) for r in out.collect()) == plain_join(rows)


def test_sketches_never_differ_by_more_than_sets():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 6000, dtype=np.int64).astype(np.uint64)
    sets = []
    for n in (1, 31, 33, 90, 129, 146, 146, 146, 260, 300, 1000, 1100, 6000):
        t = base[:n].copy()
        t[r.choice(n, n // 12, replace=False)] = r.integers(0, 2**63, n // 12).astype(np.uint64)
        sets.append(np.unique(t))
    told = [J.sketch(t) for t in sets]
    told[4] = told[4][:0]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    least = J.Sketches(np.array([len(x) for x in told]), b"".join(x.tobytes() for x in told)).differ(i, j)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (least <= true).all() and (least[(i == 4) | (j == 4)] == 0).all()
    assert ((least == 0) == (i == j))[(i != 4) & (j != 4)].all() and least[(i == 5) & (j == 6)][0] > 0.8 * true[(i == 5) & (j == 6)][0]


def test_a_crowd_below_the_threshold_hardly_asks(spark, monkeypatch):
    """300 texts that share about two thirds of their shingles with one another, of which hardly a pair links."""
    base, asked = prose(150).split(" "), []

    def replaced(k, places):
        words = list(base)
        for i, at in enumerate(places):
            words[at] = f"only{k}and{i}"
        return " ".join(words)

    rows = [(k, replaced(k, rnd.sample(range(19, 145, 7), 3)), "x", 1, 2, "z") for k in range(300)] + [(1000 + k, replaced(1000 + k, [2, 9]), "x", 1, 2, "z") for k in range(40)]

    def counted(df, tag, *a, write=J.written):
        out = write(df, tag, *a)
        if tag == "questions":
            asked.append(out.count())
        return out

    monkeypatch.setattr(J, "written", counted)
    out = J.jaccard_join(spark.createDataFrame(rows, KIND).repartition(4), n_members=8)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in out.collect())
    assert got == plain_join(rows) and sum(c == 1000 for _, _, c in got) == 40
    assert len(asked) == J.FIRST + 1 and sum(asked) < 500, asked


def test_a_third_of_all_rows_is_one_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, BASE).otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = {r.id: r.component_id for r in J.jaccard_join(rows).collect()}
    assert got == {i: 0 if i % 3 == 0 else i for i in range(3000)}


# --- alignment --------------------------------------------------------------------------------
def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {chr(c): b for b, c in X.SHOWN.items()}
    docs = []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        a, b, raw = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
        a_bytes = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        links = [(x, y) for x, s, e in zip(a, a_ends - [len(v) for v in a_bytes], a_ends) for y, p, q in zip(b, b_ends - [len(v) for v in b_bytes], b_ends) if s < q and p < e]
        cuts = sorted({*a_ends.tolist()} & {*b_ends.tolist()})
        groups = [",".join(str(x) for x, e in zip(a, a_ends) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, b_ends) if lo < e <= hi) for lo, hi in zip([0, *cuts[:-1]], cuts)]
        docs[-1] = len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
    counts, most = Counter(x for d in docs if d for x in d[3]), Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return counts, [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], d[2], len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4]) for d in docs]


FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_alignment(spark, monkeypatch):
    rows = [r for r in ROWS if len(r[1] or "") < 3000]
    counts, want = plain_alignment([r[1] for r in rows])
    out = X.cross_tokenizer(spark.createDataFrame(rows, KIND).repartition(3), *FILES)
    got = [(r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    assert sum(w[0] == 0 for w in want) >= 3
    posts, _ = X.postings(spark.createDataFrame(rows, KIND), *FILES)
    pairs = X.pair_counts(posts).collect()
    assert {(r.code >> 32, r.code & 0xFFFFFFFF): r.n_links for r in pairs} == counts
    assert X.cross_tokenizer(spark.createDataFrame([], KIND), *FILES).count() == 0
    assert [r.n_links for r in X.cross_tokenizer(spark.createDataFrame([(None, None)] * 2, "doc_id long, text string"), *FILES).collect()] == [0, 0]


def test_bitmaps_and_planes():
    r = np.random.default_rng(2)
    for n_docs, n_pairs in ((1, 3), (900, 40), (4096, 5)):
        has = r.random((n_pairs, n_docs)) < np.linspace(0, 1, n_pairs)[:, None] ** 3
        at, doc = np.nonzero(has)
        i, j = X.opened(X.bitmaps(at, doc, n_pairs, n_docs), n_pairs, n_docs)
        assert sorted(zip(i.tolist(), j.tolist())) == list(zip(at.tolist(), doc.tolist()))
    doc, code, times = np.array([0, 0, 1, 2]), np.array([5 << 32 | 1, 7 << 32 | 1, 5 << 32 | 1, 5 << 32 | 17]), np.array([1, 6, 300, 2])
    rows = list(X.posting_rows(4, doc, code, times, 3))
    assert [r[2] for r in rows] == [1] and len(rows[0][5]) == 9  # ids 1 and 17 of B are in one shard; 300 has nine bits


def test_parts_of_a_text_give_its_ids():
    enc = X.Pieces(FILES[1])
    assert enc.by_piece
    texts = [" " + (r[1] or "x") for r in ROWS] + ["  a", "   ", " a  ", " \n a \n"]
    raw = [t.encode() for t in texts]
    ids, at = enc.in_pieces(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:])] == [i.tolist() for i in enc.whole(texts)]


# --- audit ------------------------------------------------------------------------------------
def plain_audit(rows, labels):
    least, masks = {}, []
    for r in rows:
        least[r[1] or ""] = min(least.get(r[1] or "", math.inf), big(r[0]))
    told = {}
    for i, q, t in labels:
        if i is not None:
            old = told.get(i, (False, False))
            told[i] = old[0] or q == 1, old[1] or t == 1
    for r in rows:
        text = r[1] or ""
        words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": big(r[0]) > least[text]}
        masks.append((r[2] or "", fails, told.get(r[0], (False, False))))
    out = []
    for part in sorted({m[0] for m in masks}):
        own = [m for m in masks if m[0] == part]
        total, lines = Counter(), []
        for order in permutations("ABCDE"):
            for step in range(5):
                f, before = order[step], order[:step]
                took = [m for m in own if m[1][f] and not any(m[1][b] for b in before)]
                total[f] += len(took)
                lines.append((part, "".join(order), step + 1, sum(not any(m[1][x] for x in order[: step + 1]) for m in own), len(took), sum(m[1][f] and any(m[1][b] for b in before) for m in own), sum(m[1][f] and sum(m[1].values()) == 1 for m in own), sum(m[2][0] for m in took), sum(m[2][1] for m in took), f))
        out += [(*x[:-1], total[x[-1]]) for x in lines]
    return sorted(out)


LABELS = [(i, int(i % 2), int(i % 5 == 0)) for i in range(0, 620, 3)] + [(102, 1, 1), (102, 0, 0), (None, 1, 1), (9999, 1, 1), (501, None, 1)]


@pytest.mark.parametrize("bytes_", [A.MOST_BYTES, 1 << 17])
def test_audit(spark, docs, monkeypatch, bytes_):
    monkeypatch.setattr(A, "MOST_BYTES", bytes_)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    cols = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(r) for r in A.filter_audit(docs, labels).select(*cols).collect()) == plain_audit(ROWS, LABELS)
    assert A.filter_audit(docs.limit(0), labels).count() == 0
    none = A.filter_audit(spark.createDataFrame([(None, None, None)] * 2, "doc_id long, text string, source string"), labels.limit(0)).collect()
    assert len(none) == 600 and {(r.part, r.kept) for r in none if r.step == 5} == {("", 0)}


def test_the_filter_clears_unique_texts_only(spark):
    rows = spark.range(4000).select(F.xxhash64(F.when(F.col("id") < 40, F.col("id") % 20).otherwise(F.col("id"))).alias("h"))
    left = A.screened(rows, A.possible_repeats(rows, 1), 1).groupBy("h").count().collect()
    assert sum(r["count"] == 2 for r in left) == 20 and len(left) < 150
