"""Vectors, pages, mixing, components and the pipeline on small odd tables."""

import itertools
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from longpath.llm import components, embdedup, htmltext, langid, minhash, mixing, pieces, queries, secrets, topk
from tests.llm.conftest import prose
from tests.llm.test_text_operators import brute_near, by_row

# ---- components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 260)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(by_row(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {n: find(n) for n in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- vectors


def vectors(rng, n=260, dim=16):
    centre = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centre[i % 6] + rng.normal(size=dim) * rng.choice([0.02, 0.15, 0.25, 2.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 4)))
    rows += [(300 + i, rows[5][1], 1) for i in range(40)] + [(301, rows[5][1], 1), (5, rows[5][1], 1)]  # copies, repeated rows
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * dim, 1), (403, [math.nan] * dim, 1), (404, [None] * dim, 1), (405, [math.inf] + [1.0] * (dim - 1), 1)]
    rows += [(450, rows[0][1], None), (451, [1.0, 2.0], 1), (452, [2.0, 4.0], 1), (None, rows[0][1], 0), (None, [3.0] * dim, 2)]
    return rows


@pytest.fixture(scope="module")
def vector_rows():
    return vectors(np.random.default_rng(3))


@pytest.fixture(scope="module")
def embeddings(spark, vector_rows):
    rows = [(*r, 1, "x", 2.0) for r in vector_rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node int, v string, size double").repartition(3)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark, embeddings, vector_rows):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in vector_rows if i is not None and good(v)]
    want = set()
    for q, v in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)}
    for settings in ({}, {"query_block": 2, "block_rows": 7, "super_rows": 3}, {"super_bytes": 400}):
        assert set(by_row(topk.top_k(embeddings, queries.F.col("vec_id") % 50 == 0, **settings))) == want
    assert topk.top_k(embeddings.limit(0), queries.F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_prunes_and_keeps_ties():
    rng = np.random.default_rng(0)
    c = np.floor(256 * rng.normal(size=(64, 900)) * (np.arange(64)[:, None] < 8)).astype(np.int64)
    c[:, 100:110] = c[:, :1]
    q = c[:, :40].copy()
    best = topk.Best(40, 5)
    for a in range(0, 900, 300):
        topk.search(q, np.arange(40), c[:, a : a + 300], np.arange(a, a + 300), best)
    s = (q.T @ c).astype(float)
    s[np.arange(40), np.arange(40)] = -np.inf
    for i in range(40):
        order = np.lexsort((np.arange(900), -s[i]))[:5]
        assert best.id[i].tolist() == order.tolist() and best.score[i].tolist() == s[i][order].tolist()


def brute_vectors(rows, least=0.93):
    fit = [good(v) and any(v) and lab is not None for _, v, lab in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if fit[i] and fit[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1], float), np.array(b[1], float)
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        c = names.get(find(i)) if fit[i] else r[0]
        out.append((r[0], links[i], c, None if r[0] is None or c is None else r[0] == c))
    return sorted(out, key=repr)


def test_near_vectors(embeddings, vector_rows):
    want = brute_vectors(vector_rows)
    assert by_row(embdedup.near_duplicates(embeddings)) == want
    small = by_row(embdedup.near_duplicates(embeddings, part=16, leaf_rows=40, trees=8, spill=0.2))
    recall = sum(r[1] for r in small) / sum(r[1] for r in want)
    assert 0.97 <= recall <= 1
    assert embdedup.near_duplicates(embeddings.limit(0)).count() == 0


def test_leaves_are_split_until_they_are_small(spark):
    """Many small groups, a sample too small to show them, and leaves split on in Spark rounds: bounded leaves, and nearly all links."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(500, 32)), 4, axis=0) + rng.normal(size=(2000, 32)) * 0.15
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(3)
    want = brute_vectors([(i, v, i % 2) for i, v in enumerate(x.tolist())])
    got = by_row(embdedup.near_duplicates(df, sample=60, leaf_rows=40, limit=100, crowd=50, trees=8))
    recall = sum(r[1] for r in got) / sum(r[1] for r in want)
    assert sum(r[1] for r in want) > 1000 and 0.95 <= recall <= 1
    plan = embdedup.Plan([0] * 60, x[:60].tolist(), 2000, 0.93, 50, 2, 0.1, 4000, 1)
    rows = df.select(queries.F.col("vec_id").alias("node"), "label", queries.F.col("embedding").alias("v"), queries.F.lit(1).cast("long").alias("size"))
    leaves = embdedup._split_on(embdedup._placed(rows, plan), 100, 0.1).groupBy("label", "cell").count()
    assert leaves.agg({"count": "max"}).first()[0] <= 100


# ---- pages

def test_near_vectors_of_a_loose_crowd(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    crowd = centre / np.sqrt(centre @ centre) + rng.normal(size=(10_000, 64)) * np.sqrt((1 / 0.95 - 1) / 64)  # cosine of members about 0.95
    near = crowd[:1] + rng.normal(size=(300, 64)) * 0.003  # near copies: a heavy ball
    x = np.concatenate([crowd, near, rng.normal(size=(2_000, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    want = np.concatenate([(y[a : a + 1000] @ y.T >= 0.93).sum(1) for a in range(0, len(y), 1000)]) - 1
    got = {r.vec_id: r for r in embdedup.near_duplicates(df.repartition(4), block=3000).collect()}
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert {got[i].component_id for i in np.flatnonzero(want[:10_300]).tolist()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/a>b">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><article><h1>Title &amp; more</h1><p>One   two<br>three <b>bold</b> &eacute;&#233;&#x1F600;<p>Next <i>para
</i></p><aside>Side</aside><div class="ad">Buy</div><ul><li>first<li>second</ul><form><p>Sign up</p></form><p>&nbsp; </p><section class="comments"><p>Nice!</p></section>{}</article><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nOne two three bold éé😀\nNext para\nfirst\nsecond"


def test_main_text():
    assert htmltext.main_text(PAGE.format("")) == TEXT
    assert htmltext.main_text("") == "" and htmltext.main_text("plain <b>text") == "plain text" and htmltext.main_text("a < b &lt; c") == "a < b < c"
    assert htmltext.main_text("<p>a</p>b<div>c<span> d</span></div><script>x") == "a\nb\nc d"
    assert htmltext.main_text("<div>" * 5000 + "deep") == "deep"
    assert htmltext.main_text("<main><p>x</p></main><p>y</p>") == "x"
    assert htmltext.main_text("<article><p>x</p></article><article><p>y</p></article>") == "x\ny"
    assert htmltext.main_text("<!-- open <p>x") == "" and htmltext.main_text("<p title='a>b'>x<br/>y") == "x y"


def test_names_of_layouts_and_headings_drop_no_article():
    for name in ("right-sidebar", "no-sidebar", "header-fixed", "has-banner", "sidebar"):
        assert htmltext.main_text(f"<div class='{name}'><article><p>x</p></article></div><p>y</p>") == "x"
        assert htmltext.main_text(f"<div id='{name}'><p>x</p></div>") == "x"
    inner = "<section id='discussion'><h2 id='related-work'>a</h2><h2 id='search-results'>b</h2></section><div class='entry-header'>c</div>"
    assert htmltext.main_text(f"<article>{inner}<div class='cookie-banner'>d</div><div class='ad-1'>e</div></article>") == "a\nb\nc"
    assert htmltext.main_text("<div class=ad>a</div><div id=sidebar>b</div><p>c</p>") == "c"
    assert htmltext.main_text("<article>a<div class=comments><article>b</article></div></article>") == "a"


def test_comments_go_and_names_of_articles_stay():
    text = "<body><article><p>Main story.</p><div class='legal-news'><p>Court ruled.</p></div><div class='header'>Lead</div><span class='notice'>Mind this.</span>{}</article>{}</body>"
    comment = "<article class='comment{}'><p>reader one</p></article>"
    for inner, outer in ((comment.format(""), ""), ("", comment.format("-body")), (comment.format(" odd"), comment.format("-7"))):
        assert htmltext.main_text(text.format(inner, outer)) == "Main story.\nCourt ruled.\nLead\nMind this."
    assert htmltext.main_text(comment.format("") + "<p>text</p>") == "text"


def test_broken_pages_take_time_in_proportion():
    import time

    n = 60_000
    pages = ["<a " * (n * 6), "<div>" * n + "deep", "<p>" * n, "<b><div>" + "<span>" * n + "</b>" * n, "<a '\">" * n, "<span>" * n + "<p>x" * n, "<ul>" + "<li>x" * n, "<!--" * n, "<table><tr><td>" * n, "<i>" * n + "</p>" * n, "<![CDATA[" * n]
    for page in pages:
        began = time.time()
        htmltext.main_text(page)
        htmltext.style_rows(htmltext.parse(page))
        assert time.time() - began < 8, page[:40]


def test_site_tree_removes_what_a_host_repeats(spark):
    rng = random.Random(1)
    rows = [(i, f"http://a.example/{i}", PAGE.format(f"<p class=x>{prose(rng, 9)}</p><p class=more>Read more of our stories</p>"), 1) for i in range(60)]
    rows += [(200 + i, "https://u@C.example:80/", "<section>the same page</section>", 1) for i in range(30)]
    rows += [(300, None, None, 1), (301, None, "", 1), (302, "nonsense", "<h3>x", 1), (302, "nonsense", "<h3>x", 1), (None, "http://a.example", "<h4>y", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    for settings in ({}, {"small": 0, "salts": 3}):
        got = {r.page_id: r for r in htmltext.extract(df, **settings).collect()}
        # paragraphs and list are the same on all pages; headings of articles stay
        assert all(got[i].text.split("\n")[0] == "Title & more" and len(got[i].text.split("\n")[1].split()) == 9 and got[i].text.count("\n") == 1 for i in range(60))
        assert got[200].text == "the same page" and got[200].n_chars == 13  # never the whole page
        assert got[300].text == got[301].text == "" and got[302].text == "x" and got[None].text == "y"
        assert htmltext.extract(df, **settings).count() == len(rows)
    assert htmltext.extract(df.limit(0)).count() == 0
    few = df.where("page_id in (0, 1, 2)")
    assert {r.page_id: r.text for r in htmltext.extract(few).collect()} == {i: got[i].text for i in range(3)}  # three pages are judged like many
    assert {r.text.count("\n") for r in htmltext.extract(few.where("page_id = 0")).collect()} == {TEXT.count("\n") + 2}  # one has nothing to be compared with


def nameless(rng, n, host):
    """Pages without article elements or telling names: a menu of links, a notice, promotions of a few kinds, a footer line, the text."""
    words = [prose(rng, 1) + str(i) for i in range(12)]
    promos, notices = [prose(rng, 9) for _ in range(4)], [prose(rng, 12) for _ in range(2)]
    out = []
    for i in range(n):
        title, texts = prose(rng, 6), [prose(rng, rng.randint(15, 40)) for _ in range(rng.randint(1, 5))]
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(words, rng.randint(4, 8)))
        html = f"<body><div class=x17><ul>{menu}</ul></div><div class=q>{notices[i % 2]}</div><div class=k2><h2>{title}</h2>{''.join(f'<p>{t}</p>' for t in texts)}</div><div class=z>{promos[i % 4]}</div><div class=w>&copy; {host} &middot; {promos[(i + 1) % 4]}</div></body>"
        out.append((f"http://{host}/{i}", html, "\n".join([title, *texts])))
    return out


def test_site_tree_needs_no_names(spark):
    rng = random.Random(5)
    rows = [(i, *x) for i, x in enumerate(nameless(rng, 60, "one.example") + nameless(rng, 40, "two.example"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string").repartition(3)
    for names in (True, False):
        got = {r.page_id: r.text for r in htmltext.extract(df, names=names).collect()}
        assert all(got[i] == want for i, _, _, want in rows)
    assert all(htmltext.main_text(html) != want for _, _, html, want in rows)  # without the tree, all of it is text


def test_importance_equals_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    rng = random.Random(6)
    rows = [(i, url, html) for i, (url, html, _) in enumerate(nameless(rng, 23, "one.example"))]
    looks, pieces, chars, linked, on, kids, held = (defaultdict(Counter) for _ in range(7))
    for _, _, html in rows:
        root = htmltext.parse(html)
        nodes, seen = htmltext.walk(root), set()
        shown = set()
        for node, _, path in nodes:
            if htmltext.judged(node):
                tags = tuple(x.tag for x in node.parts if not isinstance(x, str))
                looks[path][tags] += 1
                held[path][tags] += (path, tags) not in shown
                shown.add((path, tags))
                kids[path]["n"] += len(tags)
                on[path]["n"] += path not in seen
                seen.add(path)
        for path, text, link in {(p, x.strip(), k) for p, t, k in htmltext.runs(root) for x in htmltext.SEPARATOR.split(t) if x.strip()}:
            pieces[path][text] += 1
            chars[path]["n"] += len(text)
            linked[path]["n"] += len(text) if link else 0
    m = {p: on[p]["n"] for p in looks}
    entropy = {p: sum(math.log(c) / math.log(m[p]) for c in pieces[p].values()) for p in looks}
    total = sum(chars[p]["n"] for p in looks)
    mean = sum(chars[p]["n"] * (1 - entropy[p] / len(pieces[p])) for p in looks if pieces[p]) / total
    got = {bytes(r.path): r for r in htmltext.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert set(got) == set(looks)
    for p, r in got.items():
        below = [q for q in looks if q.startswith(p)]
        n = sum(looks[p].values())
        presentation = 1 - sum(c / n * math.log(held[p][t]) for t, c in looks[p].items()) / math.log(m[p])
        contents = (1 - sum(entropy[q] for q in below) / sum(len(pieces[q]) for q in below)) * (1 - 0.3 * sum(linked[q]["n"] for q in below) / sum(chars[q]["n"] for q in below))
        weight = 0.9 ** (kids[p]["n"] / n)
        want = (1 - weight) * presentation + weight * contents
        assert (r.pages, r.presentation, r.contents, r.importance, r.score) == pytest.approx((m[p], presentation, contents, want, want / mean))


def test_pages_of_the_fixture(spark):
    """The generated pages have one article each: its blocks, found by plain means."""
    import html

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in df.collect()}
    for r in htmltext.extract(df).collect():
        inner = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>|<br>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


# ---- mixing


def brute_budgets(leaves, weights, budget, epochs):
    """Exact budgets by fractions, before rounding."""
    from fractions import Fraction

    def deal(children, asked):
        got, left = {}, dict(children)
        while left:
            w = sum(x[0] for x in left.values())
            full = {k: c for k, (v, c) in left.items() if Fraction(c) <= asked * Fraction(v, w)}
            if not full:
                return got | {k: asked * Fraction(v, w) for k, (v, _) in left.items()}
            got |= {k: Fraction(c) for k, c in full.items()}
            asked -= sum(full.values())
            left = {k: x for k, x in left.items() if k not in full}
        return got

    def walk(depth, prefix, asked):
        below = sorted({k[: depth + 1] for k in leaves if k[:depth] == prefix}, key=repr)
        cap = lambda p: sum(n * epochs for k, n in leaves.items() if k[: len(p)] == p)
        parts = deal({p: (weights.get(mixing.LEVELS[depth], {}).get(p[-1], 1), cap(p)) for p in below}, asked)
        if depth == 2:
            return parts
        return {k: v for p, a in parts.items() for k, v in walk(depth + 1, p, a).items()}

    return walk(0, (), Fraction(min(budget, sum(leaves.values()) * epochs)))


@pytest.mark.parametrize("share", [(1, 3), (9, 10), (5, 1)])
def test_mixing(spark, share):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40])), rng.choice(["en", "de", None]), rng.choice([f"src{j}" for j in range(9)] + [None]), 0) for i in range(400)]
    rows += [(i, prose(rng, 30), "en", "src0", 0) for i in range(400, 700)] + [(0, rows[0][1], *rows[0][2:]), (None, "a b c", "en", "src1", 0), (701, None, "en", "src1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bin int").repartition(3)
    weights = {"domain": {"web": 3, "books": 5, "code": 1}, "lang": {"en": 7}, "source": {"src3": 4}}
    got = mixing.mix(df, queries.domain_of(), weights, share, 2, 7, bin_rows=16).collect()
    domain = lambda s: {0: "web", 1: "books", 2: "code"}.get(int(s[3:]) % 4 if s else None, "forum")
    leaves = {}
    for _, t, lang, s, _ in rows:
        n = len((t or "").split())
        if n:
            leaves[(domain(s), lang, s)] = leaves.get((domain(s), lang, s), 0) + n
    want = brute_budgets(leaves, weights, sum(leaves.values()) * share[0] // share[1], 2)
    taken = {}
    for r in got:
        assert 0 < r.taken <= 2 * r.n_tokens and r.copies * r.n_tokens <= r.taken <= (r.copies + 1) * r.n_tokens
        taken[(r.domain, r.lang, r.source)] = taken.get((r.domain, r.lang, r.source), 0) + r.taken
    assert sum(taken.values()) == min(sum(leaves.values()) * share[0] // share[1], 2 * sum(leaves.values()))
    for k, v in want.items():
        assert abs(taken.get(k, 0) - v) < 3
    again = mixing.mix(df.repartition(5), queries.domain_of(), weights, share, 2, 7, bin_rows=4096).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    kept = mixing.mixed(df, queries.domain_of(), weights, share, 1, 7)
    assert kept.columns == df.columns and 0 < kept.count() <= len(rows)
    assert mixing.mix(df.limit(0), queries.domain_of(), weights).count() == 0
    assert mixing.mixed(df.limit(0), queries.domain_of(), weights).count() == 0


# ---- pipeline


def test_stages_against_brute_force(spark, documents):
    folder = None
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = corpus_pipeline.minhash_near_dedup(spark, kept, folder)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in brute_near(rows) if r[3])
    clean = corpus_pipeline.secret_scans(spark, one, folder)
    assert clean.columns == docs.columns and clean.count() == one.count()
    for r in clean.collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
    mixed = corpus_pipeline.mixing_to_weights(spark, clean, folder)
    chosen = {r.doc_id for r in mixing.mix(clean, queries.domain_of(), queries.WEIGHTS, corpus_pipeline.SHARE, corpus_pipeline.EPOCHS, queries.SEED).collect()}
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == chosen
    last = corpus_pipeline.sentencepiece(spark, mixed, folder)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert {r.doc_id: r.ids for r in last.collect()} == {d: library.encode(t) for d, t in texts.items()}


def test_language_stage_rejects_ties_and_passes_without_a_model(spark):
    rng = random.Random(8)
    words = {x: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(60)] for x, letters in (("aa", "abcdef"), ("bb", "uvwxyz"))}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i, x in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    cut = lambda x, n: " ".join(words[x] * 20)[:n]
    mixtures = [cut("aa", n) + " " + cut("bb", 7200 - n) for n in range(1000, 6200, 20)]
    tie = next(t for t in mixtures if model.predict(t, 0.15)[2])
    assert model.predict(tie, 0.15)[1] > 0.3
    more = spark.createDataFrame([(1000, tie, None), (1001, "5", None)], docs.schema)
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), None).collect()} == set(range(80))
    unknown = docs.withColumn("lang", queries.F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unknown.unionByName(more), None).count() == 81


def test_one_row_of_each_group_whatever_its_id(spark):
    rng = random.Random(5)
    a, b, c = (prose(rng, 100) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (None, a), (None, b), (None, c), (None, c + " more"), (7, b), (None, ""), (None, ""), (8, " "), (8, " ")]
    got = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    names = {t: i for i, t in enumerate((a, b, c, c + " more", "", " "))}
    found = sorted((str(r.doc_id), min(names[r.text], 3 if r.text == c + " more" else 9)) for r in got)
    assert [x for x in found if x[1] not in (2, 3)] == sorted([("1", 0), ("2", 1), ("None", 4), ("None", 4), ("8", 5)])
    assert len([x for x in found if x[1] in (2, 3)]) == 1


def test_stages_on_odd_rows(spark, documents, no_documents):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (documents, no_documents, documents.select(names)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, None)
            assert out.columns == docs.columns
            out.count()
    assert minhash.one_of_each(documents).count() <= documents.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_stored_tables_can_be_released(spark):
    from longpath.llm import common

    one, two = (common.stored(spark.range(n), "test") for n in (5, 6))
    common.drop_stored(one)
    assert two.count() == 6
    common.release(spark)
    with pytest.raises(Exception, match="(?i)not exist|no such file|FILE_NOT_EXIST"):
        spark.read.parquet(*two.inputFiles()).count()


@pytest.mark.parametrize("n", [2, 4, 99, 100, 1500])
def test_the_text_of_a_page_does_not_hang_on_the_number_of_pages(spark, n):
    body = "<body><div class='top'>Same menu here</div><div class='lead'>Unique lead text number {0} about topic {0}1 here.</div><div class='x'>{1}</div><article><p>Body {0} words.</p></article></body>"
    rows = [(i, f"http://s.org/{i}", body.format(i, ("Buy one", "Buy two")[i % 2] if n > 2 else "Buy one")) for i in range(n)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Unique lead text number {i} about topic {i}1 here.\nBody {i} words." for i in range(n)}


def test_pages_of_noise_are_empty():
    assert htmltext.main_text("<nav>x</nav><div class='cookie-banner'>We use cookies</div><div class='menu'>A B</div>") == ""
    assert htmltext.main_text("<form><p>Log in here</p><input><button>Go</button></form>") == ""
    prose = "many words of an article " * 30
    assert htmltext.main_text(f"<form><input><p>{prose}</p></form>") == prose.strip()  # a form around the whole page


def test_the_tree_decides_inside_of_articles(spark):
    """Menu and promotion stand inside of the article element, without telling names: only repetition tells them from the text."""
    page = "<article><div class='a1'>Home News Sport</div><div class='b1'>{1}</div><p>Text of page {0}, which says {0} things.</p><p>More about {0}.</p></article>"
    rows = [(i, f"http://h{i % 3}.org/{i}", page.format(i, "Buy our shoes")) for i in range(60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(table).collect()}
    alone = {i: htmltext.main_text(h) for i, _, h in rows}
    assert got == {i: f"Text of page {i}, which says {i} things.\nMore about {i}." for i in got} and sum(got[i] != alone[i] for i in got) == 60
