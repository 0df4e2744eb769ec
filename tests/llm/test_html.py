"""Main text: window sums by brute force, pages with known articles, and the defined cases."""

import random

import numpy as np

from netmine.llm import html_extract as h


def brute_kept(weights):
    """Every window summed anew."""
    out, inside = [], False
    for i, w in enumerate(weights):
        window = sum(weights[i : i + h.WINDOW])
        if inside:
            inside = not (window < h.DIVE and w < h.DIVE)
        else:
            inside = w > 0 and window >= h.SURGE
        out.append(inside and w > 0)
    return out


def test_surge_and_dive_against_all_windows():
    rng = random.Random(1)
    for _ in range(400):
        weights = [rng.choice([0, 0, 3, 11, 12, 30, 59, 60, 200]) for _ in range(rng.randint(0, 14))]
        assert h.kept(np.array(weights, np.int64)).tolist() == brute_kept(weights)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


BESIDE = [
    "<nav><ul><li><a href='/x'>{}</a></li></ul></nav>", "<div class=\"ad\">{}</div>", "<aside><p>{}</p></aside>", "<form><label>{}</label><input></form>",
    "<div id='cookie-notice'><p>{}</p></div>", "<footer>&copy; {}</footer>", "<script>var a='</p>{}';</script>", "<style>p{{}} /* {} */</style>",
    "<section class='comments'><article><p>{}</p></article></section>", "<!-- {} -->", "<select><option>{}<option>b</select>", "<div role='banner'>{}</div>",
]


def page(rng, marked):
    body = [sentence(rng, rng.randint(1, 40) if marked else rng.randint(20, 60)) for _ in range(rng.randint(1, 8))]
    article = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>", "<blockquote>{}</blockquote>"]).format(t) for t in body)
    beside = [rng.choice(BESIDE).format(sentence(rng, rng.randint(1, 25))) for _ in range(6)]
    middle = f"<article>{article}</article>" if marked else f"<div class='with-sidebar'>{article}</div>"
    return "<html><body class='has-sidebar'>" + "".join(beside[:3]) + middle + "".join(beside[3:]) + "</body></html>", "\n\n".join(body)


def test_known_articles_in_spark(spark):
    rng = random.Random(2)
    made = [page(rng, k % 2 == 0) for k in range(120)]
    rows = [(k, f"u{k}", html, "clash") for k, (html, _) in enumerate(made)]
    rows += [(900, None, None, None), (901, "e", "", ""), (902, "x", "<p></p>", ""), rows[0], (None, "n", "<article>One</article>", "")]
    long = "<article>" + "".join(f"<p>{sentence(rng, 30)} {k}</p>" for k in range(20_000)) + "</article>"
    rows.append((903, "long", long, ""))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.extract(pages).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {r.page_id: r for r in got}
    assert [by[k].text for k in range(120)] == [t for _, t in made]
    assert all(r.n_chars == len(r.text) for r in got)
    assert [by[k].text for k in (900, 901, 902, None)] == ["", "", "", "One"] and by[900].url is None
    assert by[903].text.count("\n\n") == 19_999
    assert sum(r.page_id == 0 for r in got) == 2
    assert h.extract(pages.limit(0)).count() == 0


def test_markup_never_vetoes_a_page():
    words = "word " * 40
    assert h.main_text(f"<body class='single has-sidebar'><p>{words}</p></body>") == words.strip()
    assert h.main_text(f"<div class='sidebar'><p>{words}</p></div>") == words.strip()  # all there is
    assert h.main_text(f"<div class='content sidebar'><p>{words}</p><div class='ad'>buy</div></div>") == words.strip()
    assert h.main_text(f"<p>Pick</p><datalist><option>a<option>b</datalist><p>{words}</p>") == "Pick\n\n" + words.strip()
    assert h.main_text(f"<div><select><option>a</div><p>{words}") == words.strip()  # left open
    assert h.main_text("<article>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be &lt; 2.</article>") == "Let x=1 be < 2."
    assert h.main_text("<article><h1>T</h1><p>x</p></article><div id=comments><article><p>" + words + "</p></article></div>") == "T\n\nx"


def test_density_decides():
    words = "word " * 39 + "word"
    menu = "<p><a href='/'>" + "menu " * 50 + "</a></p>"
    assert h.main_text(f"{menu}<p>a</p><p>b</p>{menu}{menu}{menu}<p>{words}</p>") == words  # links weigh nothing, short lines don't surge
    dense = "".join(f"<p>{words}{k}</p>" for k in range(4))
    marked = "<article><p>short</p></article>"
    assert h.main_text(marked + "<p>beside</p>" * 2) == "short"
    assert h.main_text(marked + dense) == "short\n\n" + "\n\n".join(f"{words}{k}" for k in range(4))  # dense text beside the mark surges by itself


def test_deep_and_broken_markup_ends():
    for broken in ("<b>" * 30_000 + "x" + "<div>" * 30_000 + "y", "<p>" * 60_000, "</b>" * 60_000, "<i><div></i>" * 10_000, "<p title=\"x>" * 5_000, "<" * 60_000, "<!--" * 1000):
        h.main_text(broken)


def test_wrappers_and_ids():
    """A form around the page, ids made from headings, dense text beside an article."""
    body, more = "Real text of the page. " * 20, "More of it. " * 3
    page = f'<form id="aspnetForm"><div class="nav"><a href="x">Home</a></div><p>{body}</p><p>{more}</p><nav><a href="y">Next page</a></nav></form>'
    assert h.main_text(page) == f"{body.strip()}\n\n{more.strip()}"
    parts = ["Body text here. " * 10, "Related work is long. " * 5, "Social", "Tail text of some length."]
    page = "<article><p>{}</p><section id='related-work'><p>{}</p></section><h2 id='social'>{}</h2><p>{}</p><div id='related-posts-2'><p>Read this instead, dear reader of ours.</p></div></article>".format(*parts)
    assert h.main_text(page) == "\n\n".join(p.strip() for p in parts)
    short = "A short article of about one hundred characters, which is quite enough to be an article, truly."
    assert h.main_text(f"<article><p>{short}</p></article><div>{'dense ' * 150}</div>") == short
    assert h.main_text(f"<p>{body}</p><footer><p>Imprint and terms of use</p></footer><form><input name=q><button>Go</button><p>Search all pages here</p></form>") == body.strip()
