"""Corpus operators against plain versions on a small table with nulls, empties, repeats, ties and long texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lightsift.llm import queries as Q
from lightsift.llm.components import components
from lightsift.llm.decontaminate import clean, decontaminate
from lightsift.llm.exact_dedup import exact_dedup
from lightsift.llm.html_text import extract_text, main_text
from lightsift.llm.license_scan import scan_licenses
from lightsift.llm.licenses import TEMPLATES
from lightsift.llm.mixing import mix_documents, mix_sources
from lightsift.llm.simhash_dedup import anchors, links, simhash_dedup
from lightsift.llm.substring_dedup import substring_dedup
from lightsift.llm.suffix_dedup import suffix_dedup
from lightsift.llm.token_store import Encoder, all_chunk_ends, crc_joined, read_tokens, verify_tokens, write_tokens
from lightsift.llm.toxicity import accepted, learnt, toxicity

SF = "/root/testdata/sf0.001"
rnd = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(40)] + ["é", "Ωmega", "X"]
PASSAGE = " ".join(rnd.choice(VOCABULARY) for _ in range(60))


def prose(n):
    return " ".join(rnd.choice(VOCABULARY) + rnd.choice(["", ".", "\n"]) for _ in range(n))


ROWS = [(i, prose(rnd.randrange(5, 90)), "abc"[i % 3], 7) for i in range(40)]
ROWS += [(100 + i, prose(20) + " " + PASSAGE + "\t" + prose(20), "hot", 7) for i in range(6)]
ROWS += [(200, None, None, 7), (201, "", "a", 7), (202, "  \n", None, 7), (203, ROWS[3][1], "a", 7), (204, ROWS[3][1].replace(" ", "  "), "b", 7), (205, prose(6000), "b", 7), (206, "aaaa " * 300, "a", 7), (None, PASSAGE, "c", 7)]
KIND = "doc_id long, text string, source string, id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def big(i):
    return math.inf if i is None else i


def test_exact(docs, empty):
    by = {}
    for i, t, *_ in ROWS:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(big(i))
    for block in (2048, 7):
        got = {big(r.id): r for r in exact_dedup(docs, block_chars=block).collect()}
        assert len(got) == len(ROWS)
        for body, ids in by.items():
            for i in ids:
                r = got[i]
                assert (big(r.keep_id), r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(body.encode()).hexdigest())
    assert exact_dedup(empty).count() == 0


def test_exact_repeated_rows(spark):
    texts = {1: "short", 2: prose(3000), 3: "own " + prose(3000)}
    rows = [(1, texts[1]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (4, texts[2]), (3, texts[3]), (3, texts[3]), (5, "alone"), (None, None), (None, None), (None, ""), (None, "x y"), (None, "x  y")]
    for block in (2048, 7):
        out = [tuple(r)[:4] for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_chars=block).collect()]
        want = [(1, 1, 2, True), (1, 1, 2, False), (2, 2, 3, True), (2, 2, 3, False), (4, 2, 3, False), (3, 3, 2, True), (3, 3, 2, False), (5, 5, 1, True)]
        want += [(None, None, 3, True), (None, None, 3, False), (None, None, 3, False), (None, None, 2, True), (None, None, 2, False)]
        assert sorted(out, key=repr) == sorted(want, key=repr)


def test_substring(docs, empty):
    got = {big(r.id): r for r in substring_dedup(docs).collect()}
    seen = {}
    for i, t in sorted((big(r[0]), r[1] or "") for r in ROWS):
        w = t.encode().split()
        gone, own = np.zeros(len(w), bool), set()
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            if k in seen:
                gone[j : j + 13] = True
            own.add(k)
        for k in own:
            seen.setdefault(k, i)
        assert got[i].n_words == len(w) and got[i].kept_text == b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert sum(s.end - s.start for s in got[i].spans) == gone.sum()
    assert substring_dedup(empty).count() == 0


@pytest.mark.parametrize("split", [4000, 1])
def test_suffix(docs, empty, split):
    got = {big(r.id): r for r in suffix_dedup(docs, split_contexts=split, shard_bytes=5000).collect()}
    count = {}
    for _, t, *_ in ROWS:
        b = (t or "").encode()
        for j in range(len(b) - 199):
            count[b[j : j + 200]] = count.get(b[j : j + 200], 0) + 1
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if count[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        assert bytes(got[big(i)].kept) == bytes(x for x, g in zip(b, gone) if not g)
    assert suffix_dedup(empty).count() == 0


def test_substring_repeats(spark):
    """A passage in every document, one window again and again in two, rows that repeat, null and tied ids."""
    rows = [(i, prose(9) + " " + PASSAGE + " " + prose(9)) for i in range(60)] + [(300, "la " * 5000), (301, "la " * 40 + PASSAGE + " la" * 9), (302, PASSAGE), (302, PASSAGE), (302, "la " * 14), (None, "la " * 20), (None, None), (5, "")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket_windows=50).collect()
    least = {}
    for i, t in rows:
        w = (t or "").split()
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            least[k] = min(least.get(k, math.inf), big(i))
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 12):
            if least[tuple(w[j : j + 13])] < big(i):
                gone[j : j + 13] = True
        want.append((big(i), len(w), " ".join(x for x, g in zip(w, gone) if not g)))
    assert sorted((big(r.id), r.n_words, r.kept_text) for r in got) == sorted(want)


def test_suffix_hot_passages(spark):
    """Passages just under, at and over the length that every text holds between words of its own, and one text that repeats a string."""
    r = random.Random(12)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = own(400)
    rows = [(i, own(150) + shared[: 190 + i % 30] + own(150)) for i in range(90)] + [(200, "xyz " * 400), (None, own(150) + shared), (201, own(300)), (201, own(300))]
    rows += [(202, rows[0][1])] * 2
    out = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), split_contexts=3, shard_bytes=4000).collect()
    count, want = {}, []
    for _, t in rows:
        for j in range(len(t) - 199):
            count[t[j : j + 200]] = count.get(t[j : j + 200], 0) + 1
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                gone[j : j + 200] = True
        want.append((big(i), "".join(c for c, g in zip(t, gone) if not g)))
    assert sorted((big(x.id), bytes(x.kept).decode()) for x in out) == sorted(want)


def plain_print(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), 42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = {big(r.id): r for r in simhash_dedup(docs).collect()}
    ids, fps = [big(r[0]) for r in ROWS], [plain_print(r[1]) for r in ROWS]
    label = dict(zip(ids, ids))
    for _ in ids:
        for a, x in zip(ids, fps):
            for b, y in zip(ids, fps):
                if (x ^ y).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    for i, f in zip(ids, fps):
        assert got[i].fp & (1 << 64) - 1 == f and big(got[i].component_id) == label[i] and got[i].best == (label[i] == i)
    assert simhash_dedup(empty).count() == 0


def test_anchors_lose_no_link(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    near = [int(b) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for b in base]
    fps = np.array([*base.tolist(), *near], np.int64)
    i, _, excess = anchors(fps, 2)
    assert (np.bincount(i[excess == 0], minlength=len(fps)) == 1).all() and excess.max() == 2
    root = {r.node: r.root for r in components(links(spark.createDataFrame([(int(f),) for f in fps], "fp long")), "a", "b").collect()}
    assert all(a == b or root[int(a)] == root[int(b)] for a, b in zip(base, near))


def test_crowded_anchor(spark):
    """Many fingerprints that differ in the bits no anchor looks at: one anchor, dealt to cells and sent in small batches."""
    rng = np.random.default_rng(4)
    fps = [int(v) << 46 | 12345 for v in rng.choice(1 << 17, 500, replace=False)] + [int(v) for v in rng.integers(0, 1 << 62, 50)]
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        root = {r.node: r.root for r in components(links(rows, homes=20), "a", "b").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {f: f for f in fps}
    for _ in range(60):
        for a in fps:
            m = min(want[b] for b in fps if (a ^ b).bit_count() <= 2)
            want[a] = min(want[a], m)
    assert {f: root.get(f, f) for f in fps} == want and len(set(want.values())) > 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 299)]
    root = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert root == {i: 0 for i in range(51)} | {100: 100, 200: 100, 150: 100, 300: 299, 299: 299}


def test_mixing(docs, empty):
    out = mix_sources(docs).collect()
    total, taken = sum(r.size for r in out), {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    targets = {r.source: r.target for r in out}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    assert all(0 <= targets[s] - taken[s] <= max(r.size for r in out if r.source == s) for s in targets)
    assert mix_documents(docs).count() == sum(r.taken // r.size for r in out if r.size) + sum(1 for r in mix_documents(docs).collect() if not (r.text or "").strip())
    assert mix_sources(empty).count() == 0


ITEMS = [(1, PASSAGE[:150]), (2, "Ωmega X é w1 w2"), (3, None), (4, ""), (2, "w3 w3 w3 w3")]


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontamination(spark, docs, empty, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {(tuple(w[j : j + 10]), str(i)) for i, t in ITEMS if (w := words(t)) for j in range(max(1, len(w) - 9))}
    got = {big(r.id): r for r in decontaminate(docs, bench, block_bytes=block).collect()}
    hits = 0
    for i, t, *_ in ROWS:
        w, places, items = words(t), set(), set()
        for k, item in wins:
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    places |= set(range(j, j + len(k)))
                    items.add(item)
        r = got[big(i)]
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == (len(w), len(places), sorted(items))
        hits += bool(places)
    assert hits >= 6 and clean(docs, bench, block_bytes=block).count() == len(ROWS) - hits
    assert decontaminate(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == len(ROWS)


def test_tokens(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, root, start = Tokenizer.from_file(path), "file://" + str(tmp_path / "s"), 0
    odd = spark.createDataFrame([(900, "a<|endoftext|>b  \x1c　\n x" * 9, None, 1), (901, "don't 12  !?" * 2000, None, 1)], KIND)
    write_tokens(docs.unionByName(odd), root, path, 2)
    got, back = {big(r.id): r for r in verify_tokens(spark, root).collect()}, {big(r.id): r["ids"] for r in read_tokens(spark, root).collect()}
    texts = {big(r[0]): r[1] or "" for r in ROWS} | {r.doc_id: r.text for r in odd.collect()}
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and back[i] == ids
        start += len(ids)
    assert crc_joined(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")
    ids = np.random.default_rng(1).integers(0, 50000, 30000).astype(np.uint32)
    ends = all_chunk_ends([ids, ids[:100], ids[:0], ids[5:]])
    assert ends[0][-1] == len(ids) and ends[1:3] == [[100], []] and {e - 5 for e in ends[0][2:]} <= set(ends[3])
    write_tokens(empty, root + "2", path, 2)
    assert verify_tokens(spark, root + "2").count() == 0


def test_encoder_is_the_library():
    import public_tokenizers
    import pyarrow as pa

    coder, r = Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "a", "B", "é", "ª", ".", ",", "'s", "12", "\t", "\r\n", "’", "\u00a0", "\u3000", "\x1c", "<|endoftext|>", "!?", "don't", "\u0301", "漢", "ß", "_", "²"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(4000)] + ["x" * 5000, None]
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(r.choice(["a", " ", "  ", ".", "\n", "é"]) + chr(c) + r.choice(["b", " ", ". ", "\n"]) for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    assert coder.by_piece
    for at in range(0, len(texts), 900):  # later ones find pieces known
        part = texts[at : at + 900]
        want = [[*ids.tolist(), 2] for ids in coder.whole([t or "" for t in part])]
        assert [x.tolist() for x in coder.encode(pa.array(part, pa.string()), 2)] == want


def test_toxicity(spark, docs, empty):
    rows = [(i, prose(30) + (" vile" if i % 4 == 0 else ""), "s", 1) for i in range(400)] + [(1000, None, "s", 1), (None, "vile", "s", 1)]
    many = spark.createDataFrame(rows, KIND)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(401, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity(many, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.id < 400]
    assert np.mean([r.predicted == (r.id % 4 == 0) for r in held]) > 0.95
    assert toxicity(docs, labels.limit(0)).count() == len(ROWS) and toxicity(empty, labels).count() == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy the best of all the things that you and we have.</div>
    <article><h1>Head &amp; line</h1><p>%s<p>Short.</p><div class="comments"><p>%s</p></div></article><aside>%s</aside><script>var a="</p>";</script><footer>the end of it</footer>""" % (("The cat and the dog of the house are in it. " * 5,) * 3)
    assert main_text(page) == "Head & line\n\n" + ("The cat and the dog of the house are in it. " * 5).strip() + "\n\nShort."
    assert main_text("") == "" and main_text("<p") == "" and main_text("<div><a href='x'>" * 500) == ""


def test_no_usable_labels_keep_all(docs, empty):
    spark = docs.sparkSession
    fold = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0)
    for labels in ([], [(1, None), (2, None)], [(fold, 1)], [(10**9, 1)], [(None, 1)]):
        weights = learnt(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not weights and accepted(docs, weights).count() == len(ROWS), labels
    assert accepted(empty, []).count() == 0


GOOD_TEXT = ("The cat and the dog of the house are in it. " * 5).strip()


def test_html_keeps_marked_up_articles():
    for a in ('style="overflow-x:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'title="the hidden valley"', 'data-hidden="1"', 'class="has-sidebar"', 'class="no-sidebar"', "class=page-with-comments", 'class="elementor-widget"', 'id="social-science"'):
        for tag in ("body", "div", "article", "main", "p"):
            assert main_text(f"<html><{tag} {a}><p>{GOOD_TEXT}</p></{tag}></html>") == GOOD_TEXT, (tag, a)
    for a in ('class="widget"', 'class="x sidebar"', 'role="banner"'):
        assert main_text(f"<div {a}><p>{GOOD_TEXT}</p><article><p>{GOOD_TEXT}</p></article></div>") == f"{GOOD_TEXT}\n\n{GOOD_TEXT}"
        assert main_text(f"<div {a}><div><p>{GOOD_TEXT}</p><p>{GOOD_TEXT}</p></div></div><p>{GOOD_TEXT}</p>") == "\n\n".join([GOOD_TEXT] * 3)
        assert main_text(f"<article><p>{GOOD_TEXT}</p><p>{GOOD_TEXT}</p></article><div {a}><article><p>{GOOD_TEXT}</p></article></div>") == f"{GOOD_TEXT}\n\n{GOOD_TEXT}"
    for a in ("hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; display : none'", "class='site-footer'", "id=comments-area"):
        assert main_text(f"<article><p>{GOOD_TEXT}</p></article><div {a}><p>{GOOD_TEXT}</p></div>") == GOOD_TEXT, a
    assert main_text(f"<div><p>{GOOD_TEXT}</p></div><div class=comments><article><p>{GOOD_TEXT}</p></article><p>{GOOD_TEXT}</p></div>") == GOOD_TEXT


def test_html_keeps_short_linked_blocks():
    item = "The commission published its %s on Tuesday."
    page = "<article><p>%s</p><p>%s</p><p>Short.</p><p>%s</p></article>" % (GOOD_TEXT, item % "<a href=x>report</a>", GOOD_TEXT)
    assert main_text(page) == "\n\n".join([GOOD_TEXT, item % "report", "Short.", GOOD_TEXT])
    assert main_text("<article><p>%s</p><p>Read <a href=x>the whole report</a></p></article>" % GOOD_TEXT) == GOOD_TEXT


BOXES = ["class=cookie-notice", "class=left-sidebar", "class=sidebar-left", "class=main-navigation", "class=google-ad", "class=ad-container", "class=adsbygoogle", "class=newsletter-wrapper", "class=comment-body", "class=user-comment", "id=cookie-consent", "id=respond", "role=complementary", "role=contentinfo", "role=search", "role=navigation", "role=banner"]


def test_html_boxes_leave_and_the_article_stays(spark):
    box = "<div %s><p>" + GOOD_TEXT.replace("cat", "hen") + "</p></div>"
    title = "<header><h1>A title</h1><p>by the one who wrote all of it for the paper</p></header>"
    linked = "<p>See <a href=x>the long report on the state of rivers</a> now.</p><ul><li><a href=y>The list</a></li></ul>"
    pages = [(i, f"<article>{title}<p>{GOOD_TEXT}</p>{linked}<p>{GOOD_TEXT}</p></article>{box % b}") for i, b in enumerate(BOXES)]
    pages += [(100 + i, f"{box % b}<div><p>{GOOD_TEXT} It is so.</p></div>") for i, b in enumerate(BOXES)]
    got = {r.id: r.text for r in extract_text(spark.createDataFrame([(i, "u", p) for i, p in pages], "page_id long, url string, html string")).collect()}
    article = "\n\n".join(["A title", GOOD_TEXT, "See the long report on the state of rivers now.", "The list", GOOD_TEXT])
    assert got == {i: article if i < 100 else f"{GOOD_TEXT} It is so." for i, _ in pages}


def test_html_raw_text_and_broken_markup():
    for page in (
        "<script>for(i=0;i<n;i++){x()}</script><article><p>%s</p></article>",
        "<SCRIPT type=x>if (a<b) document.write('</p>')</Script ><STYLE>a>b{}</STYLE><p>%s</p>",
        "<head><title>A <b> title</title><meta name=x><p>%s</p>",
        "<div><button>Menu<p>%s</p></div>",
        "<button>Go</button><button>x<div><article><p>%s</p></article></div>",
        "<svg><p>%s</p>",
        "<svg><text>no</text></svg><p>%s</p><select><option>A<option>B</select>",
        "<p title=it's>%s</p>",
        "<p title=\"a>b\" x='c'>%s</p>",
        "<!--><p>%s</p><!-- <p>no</p> -->",
        "<p>%s</p><button><div>Click</div></button>",
        "<div class='page has-sidebar'><article><p>%s</p></article></div>",
        "<div class='content widget'><article><p>%s</p></article></div>",
    ):
        assert main_text(page % GOOD_TEXT) == GOOD_TEXT, page
    assert main_text("<p" * 100_000) and main_text("<p x=" * 50_000)  # text, and takes no time


def test_html_of_other_languages():
    for text in (
        "这是一个关于城市历史的长篇文章，其中包含许多有趣的细节和故事，作者花了很多年的时间来研究这些内容，并且采访了许多当地的居民。",
        "Это длинная статья об истории города, в которой много интересных подробностей, и автор потратил годы на изучение этих материалов.",
        "Kaupungin historia on pitkä ja monivaiheinen kertomus, jossa satama, rautatie sekä teollisuus kasvoivat vuosisadan aikana nopeasti.",
    ):
        page = f"<nav><a href=x>首页</a></nav><div><p>{text * 2}</p><p>{text * 2}</p></div><footer>{text}</footer>"
        assert main_text(page) == f"{text * 2}\n\n{text * 2}"


def test_html_table(spark):
    page = f"<p>{GOOD_TEXT}</p>"
    rows = [(1, "u", page, 5, "x"), (1, "u", page, 5, "x"), (None, None, page, 5, "x"), (2, "v", None, None, None), (3, "w", "", 1, "y"), (4, "z", page * 20_000, 1, "y")]
    kind = "page_id long, url string, html string, id int, `a.b` string"
    got = sorted(((r.id, r.url, r.text) for r in extract_text(spark.createDataFrame(rows, kind)).collect()), key=repr)
    assert got == sorted([(1, "u", GOOD_TEXT)] * 2 + [(None, None, GOOD_TEXT), (2, "v", ""), (3, "w", ""), (4, "z", "\n\n".join([GOOD_TEXT] * 20_000))], key=repr)
    assert extract_text(spark.createDataFrame([], kind)).count() == 0


def test_licenses(spark, docs, empty):
    notice = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    rows = [(i, prose(i * 7) + "\nReleased under the MIT License.\n" + prose(9), "s", 1) for i in range(30)] + [(50 + i, prose(i) + " " + notice + " " + prose(300), "s", 1) for i in range(30)]
    got = {r.id: [m.license for m in r.matches] for r in scan_licenses(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {i: ["MIT"] if i < 50 else ["Apache-2.0"] for i, *_ in rows}
    assert all(not r.matches for r in scan_licenses(docs).collect()) and scan_licenses(empty).count() == 0


def test_license_rivals(spark):
    long = "This program is free software%s you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation%s either version %s of the License, or (at your option) any later version."
    cases = [("GPL-2.0", long % (";", "", ";", "2")), ("GPL-3.0", long % (":", "", ",", "3")), ("LGPL-3.0", long % (":", "Lesser ", ",", "3")), ("AGPL-3.0", long % (":", "Affero ", ",", "3"))]
    cases += [(n + v, f"This work is licensed under the GNU {w}General Public License, version {v.strip('-').replace('.0', '')}") for n, w, v in (("GPL", "", "-2.0"), ("GPL", "", "-3.0"), ("LGPL", "Lesser ", "-2.1"), ("LGPL", "Lesser ", "-3.0"), ("AGPL", "Affero ", "-3.0"))]
    rows = [(i, prose(20) + " " + t + " " + prose(20), "s", 1) for i, (_, t) in enumerate(cases)]
    got = {r.id: [m.license for m in r.matches] for r in scan_licenses(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {i: [n] for i, (n, _) in enumerate(cases)}


def test_license_texts_and_tags(spark):
    cases = [(n, t) for n, texts in TEMPLATES.items() for t in texts if len(re.findall(r"\w+", t)) >= 8]
    cases += [("MIT", "// SPDX-License-Identifier: MIT\n"), ("Apache-2.0", "# spdx-license-identifier: apache-2.0 "), ("Own-1.0", "SPDX-License-Identifier: Own-1.0")]
    rows = [(i, prose(20) + "\n" + (t if "dentifier" in t else t.replace(" ", "\n", 3)) + "\n" + prose(20)) for i, (_, t) in enumerate(cases)]
    got = {r.id: {m.license for m in r.matches} for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: {n} for i, (n, _) in enumerate(cases)}


def test_licenses_like_brute_force(spark):
    """Given templates as a table, with words left out and changed; rows that repeat, null ids and texts, clashing columns."""
    r = random.Random(21)
    own = lambda n: " ".join(f"v{r.randrange(500)}" for _ in range(n))
    templates = {f"L{k}": own(n) for k, n in enumerate((5, 9, 14, 30, 75))}
    rows = []
    for i in range(120):
        words = templates[f"L{i % 5}"].split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "other"
        rows.append((i, own(r.randrange(60)) + " " + " ".join(words) + " " + own(r.randrange(60))))
    rows += [rows[3], rows[3], (None, rows[9][1]), (None, None), (500, ""), (501, "v1 v2"), (502, own(20_000) + " " + templates["L4"])]
    table = spark.createDataFrame(list(templates.items()), "license string, text string")
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, id int, `a.b` int").repartition(3)
    got = sorted(((big(x.id), sorted(m.license for m in x.matches)) for x in scan_licenses(docs, templates=table).collect()), key=repr)
    assert scan_licenses(docs.limit(0), templates=table).count() == 0

    def found(text, longer):
        w = (text or "").split()
        s = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        out = []
        for name, t in templates.items():
            tw = t.split()
            want = {tuple(tw[j : j + 5]) for j in range(len(tw) - 4)}
            n = int(len(tw) * longer)
            if any(len(want & set(s[j : j + n])) >= 0.8 * len(want) for j in range(max(1, len(s) - n + 1))):
                out.append(name)
        return out

    least, most = (sorted(((big(i), found(t, f)) for i, t in rows), key=repr) for f in (1, 2))
    assert len(got) == len(rows) and sum(len(x[1]) for x in least) > 70
    for g, a, b in zip(got, least, most):
        assert g[0] == a[0] and set(a[1]) <= set(g[1]) <= set(b[1])


CLASHING = ["id", "key", "fp", "grp", "bucket", "u", "size", "taken", "score", "y", "turn", "spans", "items", "a.b", "__row__", "pos", "names", "copies", "matches", "shas"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows that repeat id and text, null ids, texts and sources, empty and long texts, and extra columns of clashing names."""
    rows = ROWS[:12] + ROWS[40:] + [ROWS[41]] * 2 + [(None, None, None, 7)] * 3 + [(None, PASSAGE, "c", 7)] * 2 + [(300, "", None, 7)] * 2 + [(301, "word " * 9000, "a", 7)] * 2
    kind = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame([(*r[:3], *range(len(CLASHING))) for r in rows], kind).repartition(4), rows


def operators(spark, root):
    import public_tokenizers

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")

    def tokens(d):
        write_tokens(d, root, public_tokenizers.path("byte_bpe_50k.json"), 2)
        return verify_tokens(spark, root)

    return {
        "exact": exact_dedup, "toxicity": lambda d: toxicity(d, labels), "substring": substring_dedup, "simhash": simhash_dedup, "tokens": tokens,
        "mixing": mix_sources, "suffix": suffix_dedup, "decontamination": lambda d: decontaminate(d, items), "licenses": scan_licenses,
        "html": lambda d: extract_text(d, "doc_id", "text", keep=()),
    }


@pytest.mark.parametrize("name", ["exact", "toxicity", "substring", "simhash", "tokens", "mixing", "suffix", "decontamination", "licenses", "html"])
def test_awkward_tables(spark, awkward, tmp_path, name):
    docs, rows = awkward
    run = operators(spark, f"file://{tmp_path}/s")[name]
    out = run(docs)
    got = [big(r.id) for r in out.collect()]
    assert sorted(got) == sorted(big(r[0]) for r in rows)
    if name == "tokens":
        run = operators(spark, f"file://{tmp_path}/e")[name]
    assert run(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, source string")
    if name == "tokens":
        run = operators(spark, f"file://{tmp_path}/n")[name]
    assert run(none).count() == 3


def test_awkward_simhash_and_suffix_rows(awkward):
    """Repeats are answered like the rows they repeat; both lose what they share."""
    docs, rows = awkward
    label = {}
    prints = [(big(i), plain_print(t)) for i, t, *_ in rows]
    for i, f in prints:
        label[i, f] = min(label.get((i, f), math.inf), i)
    for _ in range(6):
        for a in label:
            label[a] = min(label[b] for b in label if (a[1] ^ b[1]).bit_count() <= 2)
    got = sorted((big(r.id), r.fp & (1 << 64) - 1, big(r.component_id)) for r in simhash_dedup(docs).collect())
    assert got == sorted((i, f, label[i, f]) for i, f in prints)
    count, want = {}, []
    texts = [(big(i), (t or "").encode()) for i, t, *_ in rows]
    for _, b in texts:
        for j in range(len(b) - 199):
            count[b[j : j + 200]] = count.get(b[j : j + 200], 0) + 1
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if count[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        want.append((i, len(b), int(gone.sum())))
    out = suffix_dedup(docs).collect()
    assert sorted((big(r.id), r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in out) == sorted(want)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_awkward_stages(spark, awkward, tmp_path, stage):
    docs, rows = awkward
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    held = out.collect()
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
    if stage == "token_store":
        assert len(held) == len(rows)
        return
    assert out.columns == docs.columns
    key = lambda r: (big(r[0]), r[1], r[2])
    left = [key(r) for r in held]
    all_ = [key(r) for r in rows]
    if stage == "simhash_dedup":
        groups = {}
        for i, t, _ in set(all_):
            groups.setdefault(plain_print(t), []).append(i)
        assert len(left) == len(set(left)) and len(left) <= len(groups)
    elif stage == "decontamination":
        assert sorted(left, key=repr) == sorted((k for k in all_ if PASSAGE[:100] not in (k[1] or "")), key=repr)
    elif stage == "mixing":
        assert set(left) <= set(all_) and all(left.count(k) in (0, all_.count(k), 2 * all_.count(k)) for k in set(all_))
    else:
        assert set(left) <= set(all_) and all(left.count(k) in (0, all_.count(k)) for k in set(all_))


def test_benchmark_that_shares_a_preamble(spark):
    """Many items with one window, a text that repeats it, equal results whether the index is sent or joined."""
    pre = "in this task you are to name what comes next"
    items = [(i, f"{pre} case{i} end{i}") for i in range(2000)] + [(3000 + i, f"short{i} item") for i in range(5)]
    rows = [(1, f"{pre} " * 60), (2, f"x {pre} case7 end7 y"), (3, "a short2 item b"), (4, "short2 thing"), (5, None), (2, f"x {pre} case7 end7 y"), (None, "short2 item")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sent, joined = (sorted(((big(r.id), r.n_words, [(s.start, s.end) for s in r.spans], r["items"]) for r in decontaminate(docs, bench, block_bytes=b).collect()), key=repr) for b in (8 << 20, 1000))
    assert sent == joined and len(sent) == len(rows)
    by = {r[0]: r for r in sent}
    assert len(by[1][3]) == 2000 and by[1][2] == [(0, 600)] and by[3][3] == ["3002"] and by[4][3] == [] and by[2][2] == [(1, 13)]
    assert sorted(big(r.doc_id) for r in clean(docs, bench, block_bytes=1000).collect()) == [4, 5]


def test_toxicity_like_plain_ftrl(spark):
    """Scores against a dictionary version of the updates, feature strings instead of hashes, row by row."""
    from lightsift.llm import toxicity as T

    r = random.Random(4)
    rows = [(i, prose(r.randrange(3, 25)) + (" vile WORDS here" if i % 4 == 0 else "")) for i in range(120)] + [(500, None), (501, "")]
    labels = [(i, int(i % 4 == 0)) for i in range(120)]

    def feats(text):
        w = re.findall("[^\\x00-/:-`{-\\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {*w, *zip(w, w[1:]), *((a, None, b) for a, b in zip(w, w[2:]))}

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    turns = {x.id: x.h for x in docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", F.lit(1)).alias("h")).collect()}
    z, n, texts = {}, {}, dict(rows)

    def weight(f):
        l1 = 0 if f == "bias" else T.L1
        zf = z.get(f, 0.0)
        return 0.0 if abs(zf) <= l1 else (math.copysign(l1, zf) - zf) / ((T.BETA + math.sqrt(n.get(f, 0.0))) / T.ALPHA + T.L2)

    order = sorted((i for i, _ in labels if zlib.crc32(str(i).encode()) % 5), key=lambda i: (turns[i], i))
    for _ in range(T.EPOCHS):
        for i in order:
            fs, y = [*feats(texts[i]), "bias"], dict(labels)[i]
            w = {f: weight(f) for f in fs}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (T.TOXIC_WEIGHT if y else 1)
            for f in fs:
                was = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / T.ALPHA * w[f]
                n[f] = was + g * g
    got = {x.id: x.score for x in toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for i, t in rows:
        want = 1 / (1 + math.exp(-sum(map(weight, [*feats(t), "bias"]))))
        assert abs(got[i] - want) < 1e-6, (i, got[i], want)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), c.execute(Q.ORACLES[name]).df()
    order = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[order].astype(object).values.tolist()), key=repr)
    assert rows(got) == rows(want)


def plain_pipeline(rows, items):
    """(doc_id, n_tokens, ids_crc32) of every copy that the stages leave of rows of doc_id, text and source, without labels."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = sorted(set(rows), key=lambda r: (big(r[0]), r[1] or "", r[2]))
    fps, label = [plain_print(r[1]) for r in rows], list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(fps):
            for b, y in enumerate(fps):
                if (x ^ y).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    words = lambda t: re.findall("[^\\x00-/:-`{-\\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    bad = [(min(10, len(w)), windows(w, min(10, len(w)))) for w in map(words, items) if w]
    left = [r for i, r in enumerate(rows) if label[i] == i]
    left = [r for r in left if not any(windows(words(r[1]), n) & own for n, own in bad)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", left)
    taken = {r[0]: r[2] // max(1, r[1]) for r in c.execute(f"SELECT doc_id, size, taken FROM ({Q.ORACLES['op7_mix_sources']})").fetchall()}
    t, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text, _ in left:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out += [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] * taken[i]
    return out


def test_pipeline_like_plain_version(spark, tmp_path):
    r = random.Random(8)
    text = lambda n: " ".join(f"word{r.randrange(3000)}" for _ in range(n))
    rows = [(i, text(40), "abc"[i % 3]) for i in range(60)]
    leak = text(12)
    rows += [(100, rows[5][1], "a"), (101, text(30) + " " + leak, "b"), *rows[:20], *[(None, text(35), "c")] * 30]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "word1 none")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows, [leak, "word1 none"])
    assert len(want) > 20
    assert sorted((big(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == sorted((big(i), n, crc) for i, n, crc in want)
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), before.schema)
        if name != "mixing":
            assert docs.count() <= before.count() and docs.join(before, "doc_id", "left_anti").count() == 0
    assert out.count() == docs.count() and out.agg(F.min("start")).first()[0] == 0
