"""Classifier chain, output codes and the DOM model."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlens.llm import html, langid, linear, toxicity

SF001 = "/root/testdata/sf0.01"


def test_logistic_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    y = (x[:, 0] - x[:, 2] > 0.2).astype(float)
    w = linear.fit_logistic(x, y, l2=1e-4)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def test_chain_feeds_earlier_probabilities_forward(spark):
    """The third category is the first and the second; later links see earlier probabilities."""
    rng = random.Random(2)
    rows = []
    for k in range(900):
        a, b = rng.random() < 0.4, rng.random() < 0.5
        rows.append((k, " ".join([f"n{rng.randint(0, 30)}" for _ in range(8)] + ["angry"] * a + ["shout"] * b), a, b))
    df = spark.createDataFrame(rows, "doc_id long, text string, a boolean, b boolean")
    chain = toxicity.train(df, df, {"rude": F.col("a"), "loud": F.col("b"), "both": F.col("a") & F.col("b")})
    assert [len(w) - 1 - len(chain.vocabulary) for w in chain.weights] == [0, 1, 2]
    p = chain.score(pa.array([r[1] for r in rows]))
    assert ((p > 0.5) == np.array([[a, b, a and b] for *_, a, b in rows])).mean() > 0.97
    assert np.abs(chain.weights[2][len(chain.vocabulary):-1]).max() > 0.1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = toxicity.with_toxicity(docs, labels.where(~held)).join(labels.where(held), "doc_id").select("rejected", "toxic").collect()
    bad, clean = [r for r in out if r["toxic"] == 1], [r for r in out if r["toxic"] == 0]
    # some labels contradict their texts, and rare stems are in one or two texts only
    assert len(bad) > 80 and sum(r["rejected"] for r in bad) >= 0.82 * len(bad)
    assert sum(r["rejected"] for r in clean) <= 0.01 * len(clean)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "vile vile", 9, True), (1, "vile vile", 9, True), (None, None, None, None), (2, "", 1, False), (3, "fine day " * 50_000, 1, False)],
                                 "doc_id long, text string, P_TOXIC int, row boolean")
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (2, 1, 0), (2, 1, 0), (4, None, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.with_toxicity(docs, labels)
    assert out.columns == ["doc_id", "text", "row", "p_low_quality", "p_toxic", "rejected"]
    got = [(r["doc_id"], r["rejected"]) for r in out.collect()]
    assert len(got) == 5 and (None, False) in got and (2, False) in got and got.count((1, got[0][1])) in (0, 2)
    none = toxicity.with_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 5 and not any(r["rejected"] for r in none)
    assert toxicity.with_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_codewords_can_correct():
    for k, least in ((2, 1), (3, 2), (4, 4), (5, 8), (8, 8), (20, 10)):
        m = langid.codewords(k)
        assert min((m[a] != m[b]).sum() for a in range(k) for b in range(a)) >= least
        assert all(len(set(m[:, b])) == 2 for b in range(m.shape[1]))


def test_decoding_survives_a_wrong_bit():
    m = langid.codewords(4)
    book = langid.Codebook(("a", "b", "c", "d"), m, np.zeros((m.shape[1], langid.BUCKETS + 1), dtype=np.float32), np.full(m.shape, 1 / m.shape[1]))
    for c in range(4):
        for wrong in range(m.shape[1]):
            book.models[:, -1] = 3.0 * m[c]
            book.models[wrong, -1] *= -1
            assert book.likelihoods(np.zeros((1, langid.BUCKETS), dtype=np.float32)).argmax() == c


def test_ngrams_do_not_cross_texts():
    from chatlens.llm.batches import text_bytes
    both = langid.ngram_features(*text_bytes(pa.array(["Abc é", None, "", "xyz"])))
    for k, t in enumerate(["Abc é", "", "", "xyz"]):
        assert np.allclose(both[k], langid.ngram_features(*text_bytes(pa.array([t])))[0])


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(SF001 + "/documents.parquet")
    out = langid.identify(docs).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    rows = [(k, t * 3, lang, "x") for k in range(40) for t, lang in (("der hund und die katze ", "de"), ("the dog and the cat ", "en"))]
    rows += [(900, None, "de", "x"), (901, "12 ... 34", "en", "x"), (902, "", None, "x"), (None, "der hund", None, "x"), (903, "the dog " * 100_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["ambiguous"]) for r in langid.identify(df).collect()]
    assert len(got) == len(rows)
    d = {g[0]: g for g in got}
    assert all(d[k][1:] == ("und", 0.0, True) for k in (900, 901, 902))
    assert d[None][1] == "de" and d[903][1] == "en"
    one = langid.identify(df.where("lang = 'de'")).where("lang_pred <> 'und'").collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("de", 1.0)}
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.fixture(scope="module")
def model():
    return html.train()


def brute_marginals(parent, own, edge):
    n = len(parent)
    p, z = np.zeros(n), 0.0
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(edge[y[parent[i]], y[i]] for i in range(n) if parent[i] >= 0))
        z += w
        p += w * np.array(y)
    return p / z, np.log(z)


def test_sum_product_is_exact():
    pages = [html.parse("<div class=a><p>one<p>two</div><ul><li>x<li>y <a href=q>z</a></ul>"), html.parse("<p>alone"), html.parse("")]
    f = html.Forest(pages)
    rng = np.random.default_rng(0)
    w, edge = rng.normal(size=html.BUCKETS), rng.normal(size=(2, 2))
    got, counts, log_z = f.marginals(w, edge)
    own = np.bincount(f.at, weights=w[f.on], minlength=f.n)
    total = 0.0
    for s, e in zip(f.first, f.first[1:], strict=False):
        parent = [p - s if p >= 0 else -1 for p in f.parent[s:e]]
        want, z = brute_marginals(parent, own[s:e], edge)
        assert np.allclose(got[s:e], want)
        total += z
    assert np.isclose(log_z, total) and np.isclose(counts.sum(), (f.parent >= 0).sum())


def test_model_on_unseen_layouts(model):
    rng, right, total = random.Random(77), 0, 0
    for _ in range(200):
        page = html.parse(html.labelled_page(rng, 0.0))  # class words that mean something
        y = html._fill_labels(page)
        keep = html.Forest([page]).marginals(model.weights, model.edge)[0] >= 0.5
        right += sum(keep[o] == y[o] for o, _ in page.blocks)
        total += len(page.blocks)
    assert right / total >= 0.985


def test_extraction_of_a_whole_page(model):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav></header>
    <div class="cookie-notice">We use cookies, accept them all please.</div><article><h1>A &amp; B&nbsp;title</h1><p>First <b>bold
    part</b> of  the text, with a <a href="/x">link</a> in it.<p>Second &lt;p&gt; paragraph &#233;, quite long enough to be read by people.</p><script>var a = "<p>no</p>";</script>
    <div class="ad">Buy this wonderful product now</div><ul><li>item one of the list</li><li>item two</li></ul></article><form><p>Subscribe</p><input name=q></form>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I like this article very much, said the reader.</p></div></section>
    <aside class="sidebar"><h3>More</h3><p>Other stories you may want to read as well.</p></aside><footer>&copy; 2024</footer></body></html>"""
    assert html.main_texts([page], model)[0].split("\n") == [
        "A & B title", "First bold part of the text, with a link in it.", "Second <p> paragraph é, quite long enough to be read by people.",
        "item one of the list", "item two"]


def test_extract_edges(spark, model):
    rows = [(1, "u", "<article><p>" + "word " * 100_000 + "</p></article>", "c"), (2, None, None, "c"), (None, "v", "", "c"), (3, "w", "<<<>&&& <p", "c"), (1, "u", "<article><p>x</p></article>", "c"),
            (4, "q", "<p class='a'b\"c>odd <b attr='>'>quotes</b>" + "<div>" * 3000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df, model).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (2, None)} == {""}
    assert html.extract(df.limit(0), model).count() == 0


def test_extract_given_pages(spark, model):
    """The given pages keep their article in one element: all its blocks, nothing else."""
    import html as entities
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages, model).collect()}
    for r in pages.collect():
        art = r["html"][r["html"].index("<article>") + 9:r["html"].index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", art)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_extraction_keeps_and_drops_by_place(model):
    around = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>{}<footer>&copy; example.net &middot; words here</footer>"
    cases = [
        ("<article><h1>Title here</h1><p><a href=/x>This whole paragraph is one link to somewhere</a></p><p>Second text.</p></article>",
         ["Title here", "This whole paragraph is one link to somewhere", "Second text."]),
        ("<article><h1>T</h1><p>Ses.</p><p>A.</p></article>", ["T", "Ses.", "A."]),
        ("<div id='main-content'><h1>Title</h1><p>Paragraph one of this page with words.</p></div><div class='sidebar'><h3>Rel</h3><ul><li><a>One</a></li></ul></div>",
         ["Title", "Paragraph one of this page with words."]),
        ("<article><h1>T</h1><p>Body text goes here with words in it.</p><section class='comments'><h2>Comments</h2><article class='comment'><p>I am a long comment by a "
         "reader, with many words that look like article text.</p></article></section></article>", ["T", "Body text goes here with words in it."]),
        ("<header><h1>Site</h1><p>Tagline of the site, quite long indeed for a tagline.</p></header><main><h2>Story</h2><p>Some text that belongs to it.</p></main>"
         "<aside><p>Long aside text that is not part of the article but looks like it.</p></aside>", ["Story", "Some text that belongs to it."]),
        ("<div class='cookie'>We use cookies to improve your experience on this site.</div><form action=/s><label>Search</label><button>Go</button></form><article><p>Real "
         "words.</p><div class='ad'>Buy now cheap stuff</div><p>More real words.</p></article>", ["Real words.", "More real words."]),
    ]
    for body, want in cases:
        assert html.main_texts([around.format(body)], model)[0].split("\n") == want


def blocks_of(source):
    return [t for _, t in html.parse(source).blocks]


def test_text_behind_elements_left_open(model):
    body = "<article><h1>Title here</h1><p>Paragraph one of this page with words.</p></article><footer>&copy; x</footer>"
    for head in ("<html><head><title>x</title><body>", "<head><meta charset=utf-8><link rel=a href=b><style>p{}</style><script>1</script>", "<head>", "<head>\n<title>x</title>\n",
                 "<html><head><title>x</title></head><body>", "<head><title>x</title><body><svg width=9/></svg>", "<head><noscript><p>n</p></noscript>"):
        assert html.main_texts([head + body], model)[0].split("\n") == ["Title here", "Paragraph one of this page with words."], head
    assert blocks_of("<head><title>x</title>words<p>more") == ["words", "more"]
    for gone in ("<svg/>", "<math />", "<svg viewBox='0 0 1 1'/>", "<svg><path d=M0/><title/><g/><text>no</text></svg>", "<svg><style/><script/></svg>", "<svg><path d='a'>", "<math><mi>x",
                 "<select><option>a<option>b", "<button>Go", "<datalist><option>q", "<select><option>a</select>", "<form><p>no</p><button>x</form>", "<form><select><option>a<option>b</select></form>",
                 "<button>Go<button>Stop</button>", "<svg><foreignObject><p>no</p></foreignObject></svg>", "<select><option>a</option><option>b</option></select>", "<canvas>no</canvas>"):
        assert blocks_of(f"<div><p>one</p>{gone}<p>two</p></div><p>three</p>") == ["one", "two", "three"], gone
    for kept in ("<form>", "<object data=x>", "<video src=v>", "<form><input>", "<canvas>"):
        assert blocks_of(f"<div><p>one</p>{kept}<p>two</p></div><p>three</p>") == ["one", "two", "three"], kept
    assert blocks_of("<form><p>no</p></form><form><p>yes</p>") == ["yes"]
    assert blocks_of("<p>a</p><svg width=1/ ><p>b") == ["a", "b"] and not html._closes_itself(" width=10/") and html._closes_itself(" width=10 /")


def test_nearest_elements_count_on_class_heavy_pages(model):
    utility = "".join(f"<div class='u{k}a v{k}b w{k}c x{k}d flex'>" for k in range(30))
    f = html.Forest([html.parse(utility + "<section class='comments'><div class='body'><p>words")])
    last = set(f.on[f.at == f.n - 1].tolist())
    assert {html._bucket("in=" + w) for w in ("comments", "section", "body", "flex", "u0a"[:1], "div")} <= last
    own = np.bincount(f.at, weights=model.weights[f.on], minlength=f.n)
    p = f.marginals(model.weights, np.zeros((2, 2)))[0]  # no edges: the sums alone
    assert np.allclose(p, 1 / (1 + np.exp(-own)))
    assert len(html.main_texts(["".join(f"<div class='deep{k}x'>" for k in range(20_000)) + "words"], model)) == 1


def strange_page(rng):
    """(page, blocks of its article): layouts and class words that the training grammar does not have."""
    word = lambda: "".join(rng.choice("aeiouy") + rng.choice("hjkvwz") for _ in range(rng.randint(1, 4)))
    said = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(".!?")
    cls = lambda: rng.choice((f" class='{word()}{rng.randint(1, 99)}'", f" class='_{word()} {word()}__{word()}'", f" id='{word()}'", ""))
    links = lambda n: "".join(f"<{t}{c}><a href='/{word()}'>{word()} {word()}</a></{t}>" for t in [rng.choice(("li", "span", "div", "td"))] for c in [cls()] for _ in range(n))
    want, body = [said(rng.randint(3, 9))], []
    body.append(f"<h1{cls()}>{want[0]}</h1>")
    for _ in range(rng.randint(2, 9)):
        if rng.random() < 0.15:
            body.append(f"<h2>{said(3)}</h2>")
        elif rng.random() < 0.1:
            body.append("<blockquote>" + said(20) + "</blockquote>")
        else:
            body.append(f"<p{cls()}>" + " ".join(said(rng.randint(8, 18)) for _ in range(rng.randint(1, 5))) + "</p>")
        want.append(html.entities.unescape(re.sub("<[^>]*>", "", body[-1])))
    article = f"<div{cls()}>" * (n := rng.randint(0, 4)) + f"<div{cls()}>" + "".join(body) + "</div>" + "</div>" * n
    menu = f"<div{cls()}><ul{cls()}>{links(rng.randint(3, 9))}</ul></div>"
    side = f"<div{cls()}><h4>{word()}</h4>{links(rng.randint(3, 8))}</div>"
    foot = f"<div{cls()}><span>© {rng.randint(1999, 2030)} {word()}</span>{links(rng.randint(2, 6))}</div>"
    middle = [article, side] if rng.random() < 0.5 else [article]
    rng.shuffle(middle)
    return f"<html><body{cls()}><div{cls()}>{menu}{''.join(middle)}{foot}</div></body></html>", want


def test_pages_of_another_grammar(model):
    rng, right, total = random.Random(4), 0, 0
    for _ in range(200):
        page, want = strange_page(rng)
        got = html.main_texts([page], model)[0].split("\n")
        blocks = [t for _, t in html.parse(page).blocks]
        right += sum((b in want) == (b in got) for b in blocks)
        total += len(blocks)
        assert len("".join(want)) < 200 or len("".join(got)) > 0.5 * len("".join(want))
    assert right / total >= 0.95


PROSE = "<h1>Title of it</h1>" + "<p>This is a sentence of an article that goes on for a while, as such sentences do. Then it ends.</p>" * 3


@pytest.mark.parametrize("page", [
    "<div class='css-1a2b'>{}</div>", "<div class='flex px-4'><div class='mx-auto prose'>{}</div></div>", "<article class='promo-free comments-open'>{}</article>", "<div>{}</div>",
    "<form id='aspnetForm'><div class='q1'>{}</div></form>", "<div class='sidebar-left-layout'><div class='jx9'>{}</div></div>"])
def test_articles_under_unfamiliar_words(model, page):
    assert html.main_texts([page.format(PROSE)], model)[0].split("\n")[1:] == [re.sub("<[^>]*>", "", p) for p in PROSE.split("</h1>")[1].split("</p>")[:-1]]


def test_foreign_words_of_comments_and_footers(model):
    page = f"<article>{PROSE}</article><div class='leserkommentare'><h3>Kommentare</h3><p>Das finde ich sehr gut, sagte der Leser am Ende des Tages.</p></div><div id='fuss'><p>Alle Rechte sind vorbehalten.</p></div>"
    assert html.main_texts([page], model)[0].count("\n") == 3


def test_deep_pages_take_linear_time(model):
    import time

    def seconds(n):
        t = time.perf_counter()
        html.main_texts(["".join(f"<div class='d{k}x'>" for k in range(n)) + "<p>words</p>" + "</x></section></b>" * n], model)
        return time.perf_counter() - t

    seconds(500)
    assert seconds(8000) < 4 * (4 * seconds(2000) + 0.2) / 2
