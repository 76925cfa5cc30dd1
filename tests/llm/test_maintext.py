import pytest
from fixtures import pages

from barloom.llm import maintext

LONG = "Some long paragraph, with commas, and a second sentence. It goes on, and on; it ends here."
CASES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain text only, no tags", "plain text only, no tags"),
    (f'<body><header class="top"><h1>Site</h1></header><div class="cookie-notice">We use cookies, accept. ok?</div><main><article><header><h1>Title</h1></header>'
     f'<p>{LONG}</p><p>Sh<b>or</b>t&nbsp;x &amp; y</p><aside>Related, things.</aside><form><label>Name</label></form><section class="comments"><article class="comment">'
     f'<p>Great post, really, I like it, {LONG}</p></article></section></article></main><div id="sidebar">links</div><footer>x</footer></body>',
     f"Title {LONG} Short x & y"),
    (f'<body><div id="menu"><a href=x>one</a> <a href=y>two</a></div><div id="content"><div>{LONG}</div><div>tiny</div></div><div class="copyright">2020</div></body>', f"{LONG} tiny"),
    ('<p>a<p>b<script>if(a<b){"</p>"}</script><style>p{}</style><!-- c --><textarea>t</textarea>', "a b"),
    ('<article><p>x &lt;tag&gt; <span class="ad">buy</span> now</p></article>', "x <tag> now"),
    (f"<article><h1>Head</h1><p>{LONG}</p><p>cut &am", f"Head {LONG} cut &am"), (f"<article><p>{LONG}</p><p>tail</p></artic", f"{LONG} tail"),
    (f"<body><form><div><p>{LONG}</p></div></form></body>", LONG), ("<article><p>one\n two<br>three&#x41;</p><ul><li>a<li>b</ul></article>", "one two threeA a b"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_extract(page, text):
    assert maintext.extract(page or "") == text


SIDE = '<div class="sidebar"><p>Side text, short.</p></div>'


@pytest.mark.parametrize("wrap", ["class='content-sidebar-wrap'", "class='layout sidebar-right'", "id='page' class='widget-area-left'", "class='search-results'"])
def test_wrappers_named_by_skip_words_keep_the_text(wrap):
    for inner in (f"<article><p>{LONG}</p><p>tail</p></article>", f"<main><p>{LONG}</p><p>tail</p></main>", f"<div><p>{LONG}</p><p>tail</p></div>"):
        assert maintext.extract(f"<body><div id='nav'>menu, one</div><div {wrap}>{inner}{SIDE}</div></body>") == f"{LONG} tail"
        assert maintext.extract(f"<body><div class='widget'><div {wrap}>{inner}{SIDE}</div></div></body>") == f"{LONG} tail"
    related = f"<div class='related'><article><p>Teaser, {LONG[:40]}</p></article></div>"
    assert maintext.extract(f"<body><div {wrap}><article><p>{LONG} {LONG}</p></article>{related}</div></body>") == f"{LONG} {LONG}"


def test_parts_in_several_articles_stay():
    for n in (2, 3, 5):
        parts = [f"Part {i}. {LONG}" * (3 if i == 0 else 1) for i in range(n)]
        page = "<body><div id='nav'>menu</div><main>" + "".join(f"<article><p>{p}</p></article>" for p in parts) + "</main><footer>f</footer></body>"
        assert maintext.extract(page) == " ".join(parts)


def test_table(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(CASES)] + [(None, None, CASES[5][0]), (5, "u5", CASES[5][0])]
    got = maintext.main_texts(pages(spark, rows)).collect()
    want = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(CASES)] + [(None, None, CASES[5][1], len(CASES[5][1])), (5, "u5", CASES[5][1], len(CASES[5][1]))]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert maintext.main_texts(pages(spark, [])).count() == 0


def test_very_long_page():
    many = "<p>" + LONG + "</p>"
    assert maintext.extract("<article>" + many * 20_000 + "</article>").count("second sentence") == 20_000
