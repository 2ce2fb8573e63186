"""Repeated passages, near duplicates, pages and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rainloom.llm import pages, shingles, substrings
from rainloom.llm.components import components
from rainloom.llm.queries import QUERIES
from tests_llm_data import AWKWARD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- passages --------------------------------------------------------------------------


def removed(rows):
    """Kept words by (id, row): windows that started earlier, judged row by row."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, words = {}, {}
    for k in order:
        words[k] = w = WORDS.findall(rows[k][1] or "")
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (rows[k][0], i))
    out = []
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (rows[k][0], i):
                gone[i : i + 20] = [True] * 20
        out.append((rows[k][0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def check_removed(df, rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())
    assert got == Counter((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in removed(rows))


def test_passages_on_whole_table(spark, data_dir, texts):
    check_removed(QUERIES["op3_super_kmers"](spark, data_dir), texts)


def test_passage_edges(awkward, empty, make_docs):
    check_removed(substrings.remove(awkward), AWKWARD)
    assert substrings.remove(empty).count() == 0
    cleaned = substrings.cleaned(awkward)
    assert cleaned.columns == awkward.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in cleaned.collect()) == Counter((d, t) for d, _, _, t in removed(AWKWARD))


def test_shared_passages(make_docs):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for d in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(text) + 1)
        a, b = sorted((rng.randrange(61), rng.randrange(61)))
        rows.append((d, " ".join(text[:at] + passage[a:b] + text[at:])))
    rows += [(500 + k, "z " * 70) for k in range(3)] + [(k, t) for k, t in rows[:3]]
    check_removed(substrings.remove(make_docs(rows)), rows)


def test_rows_without_id_and_shared_ids(make_docs):
    """Each row without an id, and each text of an id, is a document; spans of one are not cut out of others."""
    words = lambda stem, n: " ".join(f"{stem}{k}" for k in range(n))
    shared, clean = words("s", 30), [words(f"c{k}_", 60) for k in range(6)]
    rows = [(1, shared), (2, words("q", 40)), (2, words("q", 40))]  # a repeated row is one document
    rows += [(None, f"{shared} {words('t', 20)}"), *[(None, t) for t in clean]]  # a span of the first place, clean texts there
    twin = words("u", 30)
    rows += [(None, f"{twin} {words('v', 5)}"), (None, f"{twin} {words('w', 5)}")]  # shared at the same position: one loses it
    rows += [(None, words("x", 25)), (None, words("x", 25))]  # copies: one loses all
    rows += [(7, f"{shared} {words('y', 20)}"), (7, words("z", 60))]  # one id for several texts
    docs = make_docs(rows)
    lost = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove(docs).collect())
    wanted = Counter({(1, 30, 0): 1, (2, 40, 0): 2, (None, 50, 30): 1, (None, 60, 0): 6, (None, 35, 30): 1, (None, 35, 0): 1, (None, 25, 25): 1, (None, 25, 0): 1, (7, 50, 30): 1, (7, 60, 0): 1})
    assert lost == wanted
    cleaned = substrings.cleaned(docs)
    assert cleaned.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in cleaned.collect())
    assert all(got[None, t] == 1 for t in clean) and got[None, words("t", 20)] == got[7, words("y", 20)] == got[7, words("z", 60)] == 1
    assert got[None, words("x", 25)] == got[None, ""] == 1 and sum(got.values()) == len(rows)


def test_heavy_minimisers_are_split(make_docs, monkeypatch):
    """One gram in hundreds of contexts, with repeats among them: several buckets share it."""
    rng = random.Random(5)
    gram, shared = "one two three four", " ".join(f"s{k}" for k in range(25))
    texts = []
    for k in range(400):
        left, right = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(18)) for _ in range(2))
        texts.append(f"{left} {gram} {right}" if k % 3 else f"{left} {gram} {shared} {right}")
    rows = list(enumerate(texts + texts[::7])) + [(None, texts[3]), (None, texts[6])]
    docs = make_docs(rows).repartition(3)
    monkeypatch.setattr(substrings, "HEAVY", 3000)
    check_removed(substrings.remove(docs), rows)
    blocks = substrings._blocks(pa.record_batch({"doc_id": range(400), "row": [0] * 400, "text": [t.encode() for t in texts]}), 8)
    batches = [pa.record_batch({"bucket": [b], "block": [x]}) for b, x in zip(blocks["bucket"], blocks["block"])]
    schema = batches[0].schema
    dealt = Counter(b for batch in substrings._windows(batches, schema, 64, 3000) for b in batch.column("bucket").to_pylist())
    assert len(dealt) == 64
    assert list(substrings._windows(batches, schema, 64, 1 << 30)) == []


def test_all_buckets_split_on_whole_table(spark, data_dir, texts, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 0)
    check_removed(QUERIES["op3_super_kmers"](spark, data_dir), texts)


def test_branches_share_their_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 0)
    docs = substrings._keyed(make_docs([(k, "a b c " * 20) for k in range(5)]).withColumn("row", F.lit(0).cast("long")), "row", "doc_id", "text")
    found = substrings.passages(docs)
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_super_kmers_hold_every_window_once():
    rng = random.Random(7)
    raw = [" ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(n)).encode() for n in (0, 5, 19, 20, 21, 300)]
    text, starts, counts, minimiser, packed = substrings.super_kmers(raw)
    found = Counter()
    by_window = defaultdict(set)
    for t, s, c, m, p in zip(text, starts, counts, minimiser, packed):
        w = p.split(b" ")
        assert len(w) == c + 19 and c <= 17
        for k in range(c):
            found[t, s + k] += 1
            assert w[k : k + 20] == raw[t].split()[s + k : s + k + 20]
            by_window[tuple(w[k : k + 20])].add(int(m))
    assert found == Counter((t, i) for t, r in enumerate(raw) for i in range(len(r.split()) - 19))
    assert all(len(m) == 1 for m in by_window.values())


def test_hash_collisions_are_sorted_out(monkeypatch):
    """With a poor hash at first, different windows are still told apart."""
    real, calls = substrings.mixed, []

    def poor(x):
        calls.append(1)
        return np.zeros_like(x) if len(calls) == 1 else real(x)

    monkeypatch.setattr(substrings, "mixed", poor)
    packed = [b" ".join(b"%d" % (k + j) for k in range(20)) for j in range(3)] + [b" ".join(b"%d" % k for k in range(20))]
    got = substrings.repeated(np.array([1, 2, 3, 4]), np.zeros(4, np.int64), np.ones(4, np.int64), packed)
    assert got.tolist() == [[4, 0, 1]] and len(calls) > 1


def test_words_are_hashed_side_by_side(monkeypatch):
    """No dictionary of words on the usual path; words of any length and any white space."""
    monkeypatch.setattr(substrings, "_numbered", None)
    rng = random.Random(9)
    words = ["w" * k for k in (1, 7, 8, 9, 16, 63, 64, 65, 500)] + ["w" * 70 + x for x in "ab"] + ["\u00e9\u4e2d\u00a0", "\x00"]
    raw = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "\n\x0b", "\x0c\r"]) for _ in range(n)).encode() for n in (0, 19, 20, 400)]
    raw += [b" \n", raw[3], raw[3].replace(b"wa", b"wb", 1)]
    text, starts, counts, _, packed = substrings.super_kmers(raw)
    for t, s, c, p in zip(text, starts, counts, packed):
        assert p.split(b" ") == raw[t].split()[s : s + c + 19]
    windows = sorted((t, s + k, tuple(p.split(b" ")[k : k + 20])) for t, s, c, p in zip(text, starts, counts, packed) for k in range(c))
    seen, later = set(), set()
    for t, s, w in windows:
        if w in seen:
            later.add((t, s))
        seen.add(w)
    got = substrings.repeated(text, starts, counts, packed)
    assert {(d, s + k) for d, s, n in got.tolist() for k in range(n)} == later
    assert len({h for h in substrings._hashes(np.frombuffer(b"".join(b"%s " % w.encode() for w in words), np.uint8), *places(words)).tolist()}) == len(words)


def places(words):
    lengths = np.array([len(w.encode()) for w in words])
    return np.cumsum(lengths + 1) - lengths - 1, lengths


# --- near duplicates --------------------------------------------------------------------


def shingle_set(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def reachable(rows, percent=85):
    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    meets, common = defaultdict(list), Counter()
    for k, (_, s) in enumerate(sets):
        for x in s:
            for j in meets[x]:
                common[j, k] += 1
            meets[x].append(k)
    for (j, k), n in common.items():
        if 100 * n >= percent * (len(sets[j][1]) + len(sets[k][1]) - n):
            a, b = find(sets[j][0]), find(sets[k][0])
            root[max(a, b)] = min(a, b)
    return Counter((d, len(shingle_set(t)), None if d is None else find(d)) for d, t in rows)


def check_groups(df, rows):
    got = df.collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == reachable(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)


def test_near_duplicates_on_whole_table(spark, data_dir, texts):
    check_groups(QUERIES["op10_circulant_minhash"](spark, data_dir), texts)


def test_near_duplicate_edges(awkward, empty, make_docs):
    check_groups(shingles.near_duplicates(awkward), AWKWARD)
    assert shingles.near_duplicates(empty).count() == 0
    kept = shingles.deduplicated(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, t in AWKWARD if d not in (6, 11) or d is None)


def test_large_group_of_near_copies(make_docs, monkeypatch):
    """A group of several chunks, whose members are linked through one another only."""
    monkeypatch.setattr(shingles, "CHUNK", 16)
    rng = random.Random(8)
    base, rows = [f"v{k}" for k in range(120)], []
    for d in range(150):
        text = list(base)
        for _ in range(rng.randrange(0, 7)):
            text[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(text)))
        if d % 10 == 0:
            base = text
    check_groups(shingles.near_duplicates(make_docs(rows)), rows)


def test_bands_follow_the_limit():
    assert shingles.banding(85) == (shingles.BANDS, shingles.ROWS)
    for percent in (50, 70, 80, 85, 90, 99):
        n, rows = shingles.banding(percent)
        assert (1 - (percent / 100) ** rows) ** n < 1e-6


def test_pipeline_takes_near_copies_from_80_percent(spark, make_docs):
    """Pairs around the limits of 80 and 85 percent, against brute force at 80."""
    rng = random.Random(12)
    rows = []
    for d in range(0, 400, 2):
        text = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        cut = text[: 204 - rng.randrange(20, 50)]  # a prefix: similarity is (200 - cut) / 200
        rows += [(d, " ".join(text)), (d + 1, " ".join(cut))]
    at_limit = [f"l{k}" for k in range(204)]
    rows += [(500, " ".join(at_limit)), (501, " ".join(at_limit[:164])), (502, " ".join(["x", *at_limit[41:]]))]
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    got = {r["doc_id"] for r in stage(spark, make_docs(rows), "").collect()}
    strict, wanted = ({d for d, _, c in reachable(rows, p) if d == c} for p in (85, 80))
    assert got == wanted and wanted < strict and {500, 501, 502} & got == {500, 502}


def test_pipeline_near_copies_on_whole_table(spark, data_dir, texts):
    """The table has near copies between the limits of the pipeline and of op10."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, data_dir).collect())
    strict, wanted = (Counter(d for d, _, c in reachable(texts, p) if d == c) for p in (85, 80))
    assert got == wanted and wanted < strict


def test_links_against_all_pairs():
    rng = np.random.default_rng(9)
    found = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(60)]
    pairs = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(np.intersect1d(found[a], found[b])) >= 50 * len(np.union1d(found[a], found[b]))}

    def parts(edges):
        root = list(range(60))
        for _ in range(60):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    got = shingles.links(found, 50)
    assert set(got) <= pairs and parts(got) == parts(pairs)


def test_signature_estimates_jaccard():
    """One permutation, shifted: equal coordinates estimate the similarity, and shifts are circular."""
    circle = shingles._circle(10)
    assert np.array_equal(circle[-1][1:], circle[0][:-1]) and len(np.unique(circle[:, 0])) == shingles.CELLS
    rng = np.random.default_rng(10)
    own = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = own[:900], own[100:]
    same = np.mean(shingles.signature(np.sort(a), 1024) == shingles.signature(np.sort(b), 1024))
    assert abs(same - 0.8) < 0.05


def test_components(spark):
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200, k) for k in range(201, 240)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "test").collect())
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


# --- pages -------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><script>if(a<b){}</script></head><body class="home with-sidebar">
<header class="site"><h1>Site</h1><nav>menu</nav></header><div id=cookie-notice>We use cookies a lot. Accept everything please.</div>
<div class="wrap"><div class="main-menu"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><main class="content with-sidebar">
<div class="post post-123"><header class="post-header"><h1>Title &amp; more</h1></header><p>First   para &eacute;&#233;&nbsp;x<br>more, with a
<a href=q>link</a>.<p><b>Second<div>Third div</div></b><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><!-- no -->
<div class="ad-slot">BUY</div><form><p>mail</p></form><p hidden>no</p><blockquote>Quote</blockquote></div>
<section id="comments"><h2>Comments</h2><p>Nice article!</p></section></main><aside>Related</aside></div><footer>(c)</footer></body></html>"""
BLOCKS = ["Title & more", "First para éé x more, with a link.", "Second", "Third div", "a", "b", "c", "d", "e", "Quote"]


def test_page_text():
    assert pages.text_of(PAGE, None) == "\n\n".join(BLOCKS)


@pytest.mark.parametrize(
    "page, text",
    [("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\n\nb"), ("<" * 5000, "<" * 5000), ("<!--", ""), ("a<script>b", "a"), ("</p></div>x", "x"), ("<style>p{}</style>", ""), ('<p class="', '<p class="')],
)
def test_odd_pages(page, text):
    assert pages.text_of(page, None) == text


@pytest.mark.parametrize(
    "part",
    [
        '<p>see <a href="/the-hidden-cost">kept</a></p>', '<p title="a hidden gem">kept</p>', '<div data-hidden="false"><p>kept</p></div>', '<div data-id="comments" data-class=ads><p>kept</p></div>', "<p title='x class=ad'>kept</p>", '<p title="a hidden gem>kept</p>',
        '<h2 id="related-work">kept</h2>', '<p id="comments-on-method">kept</p>', '<section id="discussion"><h2>Discussion</h2><p>kept</p></section>', '<h2 id="social-impact">kept</h2>', '<div class="section-header"><h2>kept</h2></div>',
        '<section id="cookies-in-history"><h2>Cookies in <i>history</i></h2><p>kept</p></section>', "<p>so <math><mi>kept</mi></math></p>", "<div><svg><path></div><p>kept</p>", "<div><select><option>x</div><p>kept</p><div><select><option>y</select></div>",
    ],
)
def test_text_that_is_no_boilerplate(part):
    assert "kept" in pages.text_of(f"<body><div class=story><p>Some words of the story.</p>{part}<p>More words of the story.</p></div>", None)


@pytest.mark.parametrize("part", ['<div class="section-related"><a href=x>lost</a> <a href=y>lost</a></div>', "<div id=cookie-notice>lost</div>", '<div class="site-footer">lost</div>', '<p class=x hidden>lost</p>', "<p hidden>lost</p>", '<p title="x"hidden>lost</p>', "<div class='main-menu'>lost</div>", "<p>x <svg><text>lost</text></svg></p>", '<section id="comments-list"><h2>Opinions</h2>lost</section>'])
def test_text_that_is_boilerplate(part):
    assert "lost" not in pages.text_of(f"<body><div class=story><p>Some words of the story.</p>{part}<p>More words of the story.</p></div>", None)


def test_deep_page():
    assert pages.text_of("<div>" * 20_000 + "<p>x" + "</div>" * 20_000, None) == "x"


@pytest.mark.parametrize("name, bad", [("ad", True), ("ad-12", True), ("adLeft", True), ("header", True), ("post-header", False), ("comments-list", True), ("with-sidebar", False), ("shadow", False), ("download", False), ("post_footer", True), ("content", False), ("page-has-menu", False)])
def test_boilerplate_names(name, bad):
    assert pages.boilerplate(name) == bad


def test_host_decides(spark):
    """A page on which a promotion is longer than the article follows the other pages of its host."""
    page = '<html><body><div class="p-{0}"><p>{1}</p></div><div class="story s{0}"><p>{2}</p></div></body></html>'
    rows = [(k, f"http://h.example/{k}", page.format(k, "buy now", "long text of the story " * 5)) for k in range(5)]
    rows += [(9, "http://H.example:80/9", page.format(9, "buy this very thing now " * 20, "short story")), (10, None, "<p>lone"), (11, "http://[bad", None), (11, "http://[bad", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS text")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(df).collect()]
    assert (9, "short story", 11) in got and (10, "lone", 4) in got and got.count((11, "", 0)) == 2 and len(got) == 9
    assert pages.extract(df.limit(0)).count() == 0


def test_all_sections_of_a_split_article(spark):
    """A page whose article is split over sections of unequal length keeps them all, in order."""
    page = '<html><body><div class="story">{0}</div></body></html>'
    part = lambda name, n: f"<section><p>{name} {'word ' * n}</p></section>"
    rows = [(k, f"http://h.example/{k}", page.format(part("whole", 100))) for k in range(4)]
    rows += [(9, "http://h.example/9", page.format(part("first", 200) + part("second", 80) + "<section><p><a href=x>all link</a></p></section>" + part("third", 60)))]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "\n\n".join(["first" + " word" * 200, "second" + " word" * 80, "all link", "third" + " word" * 60])


def extracted(spark, rows):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", html) for k, html in rows], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in pages.extract(df).collect()}


def test_headline_outside_the_body_of_the_article(spark):
    body = "".join(f"<p>paragraph {k} of a long text</p>" for k in range(60))
    page = f'<html><body><div class=nav><a href=x>home</a></div><div class=post><h1>The headline</h1><div class=body>{body}</div><ul><li><a href=x>more</a></ul></div></body></html>'
    for text in extracted(spark, [(k, page) for k in range(4)]).values():
        assert text.startswith("The headline\n\nparagraph 0 of") and text.endswith("paragraph 59 of a long text")


def test_paragraphs_around_a_section(spark):
    long = "words of the section " * 30
    page = "<html><body><div class=story>{0}<section><p>{1}</p></section>{2}</div><div class=teaser><p>something else</p></div></body></html>"
    got = extracted(spark, [(k, page.format("", long, "")) for k in range(5)] + [(9, page.format("<p>an introduction</p>", long, "<p>a conclusion</p>"))])
    assert got[9] == f"an introduction\n\n{long.strip()}\n\na conclusion" and got[0] == long.strip()


def test_a_page_with_its_article_elsewhere(spark):
    long = "words of the article " * 30
    page = "<html><body><div class=story><p>{0}</p></div><div class=other><p>{1}</p></div></body></html>"
    got = extracted(spark, [(k, page.format(long, "x")) for k in range(5)] + [(9, page.format("x", long))])
    assert got[9] == long.strip() and got[0] == long.strip()


def test_pages_on_whole_table(spark, data_dir):
    """Every page of the table has one article element, which is cut out here by hand."""
    import html

    got = {r["page_id"]: r for r in QUERIES["op2_host_consensus"](spark, data_dir).collect()}
    for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        text = "\n\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def test_an_id_with_two_texts_is_one_document(make_docs):
    a, b, c = ("one two three four five six seven", "red green blue black white grey brown", "quite another text with other words here")
    docs = make_docs([(5, a), (5, b), (3, b), (9, a), (4, c), (2, ""), (7, c), (7, c)])
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in shingles.near_duplicates(docs).collect()]
    assert sorted(got) == [(2, 2, True), (3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (7, 4, False), (7, 4, False), (9, 3, False)]


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline(spark, data_dir, texts):
    from tokenizers import Tokenizer

    from rainloom.llm import quality, tokens
    from test_llm_tokens import check_packing, pieces_of

    good = []
    for d, t in texts:
        m = dict(zip(quality.MEASURES, quality.measure(t.encode())))
        if not any(eval(rule.replace(" OR ", " or "), {}, m) for rule in quality.RULES.values()):  # noqa: S307
            good.append((d, t))
    kept = {d for d, _, c in reachable(good, corpus_pipeline.NEAR) if d == c}
    single = [(d, t) for d, t in good if d in kept]
    final = [(d, t) for d, _, _, t in removed(single)]
    library = Tokenizer.from_file(tokens.vocabulary())
    got = corpus_pipeline.run(spark, data_dir).collect()
    check_packing(got, pieces_of(final, library, 4096), 4096)
    assert 0 < len(single) < len(good) < len(texts) and final != single


def test_pipeline_columns(spark, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == awkward.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
