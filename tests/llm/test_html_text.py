import html
import re
import time

import numpy as np

from cellwright.llm import html_text as H


def brute(page):
    """The pages of the test tables: what stands in the article, cut at block tags."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body.replace("<b>", "").replace("</b>", "")))
    return "\n\n".join(p for p in parts if p)


def test_tables_match_brute_force(spark):
    p = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in H.read(spark, p, "pages").collect()}
    rows = H.op9_html_text(spark, p).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == brute(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


LONG = "A sentence of the main text that is long enough to weigh something. " * 3


def test_page_without_landmark():
    page = f"""<body><div id="top-menu"><a href=x>Home</a><a href=y>News</a></div><div class='cookie-notice'>{LONG}</div>
    <div class="content"><h2>Title &amp; more</h2><p>{LONG}<p>Short one.<p>{LONG}<br>tail</div>
    <ul><li><a href=1>{LONG}</a></li></ul><div class="comments"><p>{LONG}</p></div><form>{LONG}</form><div id="footer">{LONG}</div>"""
    s = " ".join(LONG.split())
    assert H.main_text(page) == "\n\n".join(["Title & more", s, "Short one.", s + " tail"])


def test_article_with_inner_parts():
    page = f"""<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>One<b> bold</b>&nbsp;word</p><aside><p>{LONG}</p></aside>
    <div class="advert">buy</div><script>var a = "<p>no</p>"</script><!-- <p>no --><p>Two</p><section id="comments"><p>{LONG}</p></section></article><p>{LONG}</p>"""
    assert H.main_text(page) == "Head\n\nOne bold word\n\nTwo"


def test_articles_that_are_no_main_text():
    s = " ".join(LONG.split())
    comment = f"<article class=comment><p>{LONG}</p></article>"
    assert H.main_text(f"<div class=content><p>{LONG}</p></div><section id=comments>{comment}</section>") == s
    assert H.main_text(f"<div class=content><p>{LONG}</p></div><section class=related><article><p>Another {LONG}</p></article></section>") == s
    assert H.main_text(f"<article class='post comments-open'><p>{LONG}</p>{comment}<p>End</p></article>") == s + "\n\nEnd"
    # a small article elsewhere does not take the place of the text, nor a teaser join it
    assert H.main_text(f"<div class=content>{f'<p>{LONG}</p>' * 20}</div><article><p>C</p></article>") == "\n\n".join([s] * 20)
    assert H.main_text(f"<article><p>{LONG}</p></article><article class=teaser><p>More here</p></article>") == s


def test_short_stretch_of_the_same_container():
    s = " ".join(LONG.split())
    page = f"<div class=content><p>{LONG}</p><p>{LONG}</p><div class=advert>buy</div><p>The end.</p></div><div><p>Elsewhere.</p></div>"
    assert H.main_text(page) == "\n\n".join([s, s, "The end."])
    # in an article too, even a line of links alone
    assert H.main_text(f"<article><p>{LONG}</p><aside>x</aside><p><a href=x>More</a></p></article>") == s + "\n\nMore"


def test_broken_and_empty():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == ""
    assert H.main_text(f"<nav><ul><li>x<article><p>{LONG}<p>y") == " ".join(LONG.split()) + "\n\ny"
    assert H.main_text("<article>" + "<div>" * 3000 + "deep" + "</p>" * 3000) == "deep"
    assert H.main_text("<article><p>a < b &lt;p&gt; <3</p></article>") == "a < b <p> <3"
    assert H.main_text("<article><p>x <a href='unclosed") == "x"


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, "<article>a", "t"), (1, "<article>a", "t")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in H.extract(df).collect()) == ["", "a", "a"]
    assert H.extract(df.limit(0)).count() == 0


def test_broken_pages_take_seconds():
    text = "<p>" + "text " * 20 + "</p>"
    for piece in ("<a ", '<p a="', "<p a='\">", "<!", "<div>", "<nav>", "<title>", "</section>", "<div></p>", "<", "<b \"'>"):
        page = text + piece * (2_000_000 // len(piece))
        for end in ("", ">"):
            start = time.time()
            H.main_text(page + end)
            assert time.time() - start < 30, piece
    start = time.time()
    assert H.main_text("<div>" * 200_000 + text + "</section>" * 200_000) == ("text " * 20).strip()
    assert time.time() - start < 30


def test_windows_decide_without_landmarks(spark):
    pages = [r["html"] or "" for r in H.read(spark, "/root/testdata/sf0.01", "pages").collect()]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    same = sum(H.main_text(a) == H.main_text(b) for a, b in zip(pages, plain))
    assert same >= 0.98 * len(pages)


def test_nothing_but_landmarks_and_names_can_be_missing(spark):
    """All pages keep their text when article and main become plain boxes."""
    pages = [r["html"] or "" for r in H.read(spark, "/root/testdata/sf0.1", "pages").collect()]
    assert len(pages) == 2500
    for p in pages:
        want = brute(p)
        assert H.main_text(p) == want
        assert H.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", p)) == want


def test_pages_of_few_words_keep_them():
    assert H.main_text("<p>Hello world</p>") == "Hello world" and H.main_text("hello") == "hello"
    assert H.main_text('<div class="post-content"><p>Tiny.</p></div>') == "Tiny."
    assert H.main_text('<div class="ad">Only this.</div>') == "Only this."
    assert H.main_text("<article>a</article>") == "a" and H.main_text("<nav>a</nav><footer>b</footer>") == ""


def test_names_lower_weights_only():
    s = " ".join(LONG.split())
    assert H.main_text(f'<div class="social-history"><p>{LONG}</p></div><div class="ad">Buy now</div>') == s
    assert H.main_text(f'<main><h1>Results</h1><section id="search-results"><p>{LONG}</p><p>{LONG}</p></section></main>') == "\n\n".join(["Results", s, s])
    box = "x y " * 75
    assert box.strip() in H.main_text(f"<div>{box}</div><article>A teaser of few words</article>")


def brute_windows(weight, follows):
    out = []
    for i in range(len(weight)):
        j = i
        while j - i < H.LINES - 1 and follows[j]:
            j += 1
        out.append((sum(weight[i : j + 1]), j + 1))
    return out


def test_window_sums_by_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 40):
        weight = rng.integers(0, 50, n).astype(float)
        follows = np.append(rng.random(n - 1) < 0.7, False)
        sums, stop = H.window_sums(weight, follows)
        assert [(a, b) for a, b in zip(sums.tolist(), stop.tolist())] == brute_windows(weight.tolist(), follows.tolist())


def test_windows_are_needed(monkeypatch):
    """Short lines outweigh one long notice by their windows; a window of one line loses them."""
    verse = "".join(f"<p>Line {i} of it</p>" for i in range(30))
    page = f"<div>{'A single unnamed remark of some length. ' * 3}</div><section>{verse}</section>"
    whole = "\n\n".join(f"Line {i} of it" for i in range(30))
    assert whole in H.main_text(page)
    monkeypatch.setattr(H, "LINES", 1)
    assert whole not in H.main_text(page)
