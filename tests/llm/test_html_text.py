import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm.html_text import extract, labels, main_text

PROSE = "The house by the river is old and it was built for the people of the town. " * 4
FINNISH = "Vanha talo seisoo joen rannalla ja kaupungin asukkaat rakensivat sen kauan sitten. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>x</p>", ""),
        (f"<body><nav><a href=1>Home</a></nav><article><h1>T &amp; x</h1><p>Short.<p>{PROSE}</article><footer>{PROSE}</footer>", f"T & x\n\nShort.\n\n{PROSE.strip()}"),
        (f"<div class='ad'>{PROSE}</div><p>{PROSE}</p><p>End.</p><p>{PROSE}</p><div id=comments><p>{PROSE}</p></div>", f"{PROSE.strip()}\n\nEnd.\n\n{PROSE.strip()}"),
        (f"<script>var t='</p>';</script><style>p{{}}</style><article><p>a<b>b</b>&#99;&nbsp; d<br>e</p><!-- {PROSE} --></article>", "abc d e"),
        (f"<article><p>{PROSE}</p><aside>{PROSE}</aside><form><p>{PROSE}</p></form><div style='display:none'>{PROSE}</div></article>", PROSE.strip()),
        ("<article><p>w### x%%% y&amp;&amp;&amp;</p></article>", "w### x%%% y&&&"),
        (f"<article><p><b>{PROSE}<br><p>open", f"{PROSE.strip()}\n\nopen"),
        # Names that mark no outside element.
        (f"<article><header class='entry-header'><h1>Title</h1></header><p>{PROSE}</p></article>", f"Title\n\n{PROSE.strip()}"),
        (f"<article><div class='entry-header'><h1>Title</h1></div><div class='side-by-side'><p>{PROSE}</p></div></article>", f"Title\n\n{PROSE.strip()}"),
        (f"<body class='comments-open nav-fixed'><div class='layout has-sidebar'><article><p>{PROSE}</p></article><div class='sidebar'><p>{PROSE}</p></div></div>", PROSE.strip()),
        (f"<div id='page-header-wrap'><main><p>{PROSE}</p></main><div class='site-footer'>{PROSE}</div></div>", PROSE.strip()),
        (f"<div class='content with-sidebar'><p>{PROSE}</p><p>End.</p><p>{PROSE}</p></div><div class='sidebar'>{PROSE}</div>", f"{PROSE.strip()}\n\nEnd.\n\n{PROSE.strip()}"),
        (f"<div id='page-header-wrap'><p>{PROSE}</p><p>{PROSE}</p></div><ul><li><a href=x>Home</a></ul>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        # Names that do.
        (f"<article><p>{PROSE}</p><div class='ad-box'>{PROSE}</div><div class='relatedPosts'>{PROSE}</div><div class='article widget'><p>Newest</p></div><p>{PROSE}</p></article>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f"<div role=banner>{PROSE}</div><p>{PROSE}</p><p>{PROSE}</p><div class='notice'>{PROSE}</div><section id='comment-list'><p>{PROSE}</p></section>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        # A form around the page, and one on it.
        (f"<body><form id='aspnetForm'><div class='menu'><a href=1>Home</a></div><p>{PROSE}</p><p>{PROSE}</p></form>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f"<form action=x><article><h1>T</h1><p>{PROSE}</p></article></form>", f"T\n\n{PROSE.strip()}"),
        (f"<p>{PROSE}</p><p>{PROSE}</p><form><label>Your name</label><p>Subscribe to the letters of the town and of the house by the river, as it was.</p></form>", f"{PROSE.strip()}\n\n{PROSE.strip()}"),
        # Edges of a page without an article element.
        (f"<h1>The house</h1><p>{PROSE}</p><h2>Later</h2><p>{PROSE}</p><p>The end.</p>", f"The house\n\n{PROSE.strip()}\n\nLater\n\n{PROSE.strip()}\n\nThe end."),
        (f"<div>Site of the town</div><ul><li><a href=1>Home</a></ul><h1>The house</h1><p>{PROSE}</p><p>The end.</p><div>© 2020 Town</div>", f"The house\n\n{PROSE.strip()}\n\nThe end."),
        (f"<h1>The house</h1><p>{PROSE}</p><p>© 2020 Town. All rights reserved.</p>", f"The house\n\n{PROSE.strip()}"),
        (f"<h1>The house</h1><p>{PROSE}</p><h3>Related</h3><ul><li><a href=1>Other</a><li><a href=2>More</a></ul>", f"The house\n\n{PROSE.strip()}"),
        # Short paragraphs in scripts without spaces, and pages with a single paragraph.
        ("<ul><li><a href=1>首页</a></ul><h1>河边的房子</h1><p>这座老房子坐落在河边，是很久以前由镇上的居民为自己建造的，如今依然有人居住。</p><p>后来它被卖给了一个来自远方的家庭，他们在那里住了很多年，直到孩子们长大离开。</p>", "河边的房子\n\n这座老房子坐落在河边，是很久以前由镇上的居民为自己建造的，如今依然有人居住。\n\n后来它被卖给了一个来自远方的家庭，他们在那里住了很多年，直到孩子们长大离开。"),
        ("<div><a href=1>Главная</a></div><p>Старый дом стоит на берегу реки, его построили жители города много лет назад.</p><div><a href=2>Ещё</a></div>", "Старый дом стоит на берегу реки, его построили жители города много лет назад."),
        # Strong words in names that no layout has.
        (f"<article><p>{PROSE}</p><section class='related-work'><p>{PROSE}</p></section><div class='social-policy'><p>{PROSE}</p></div><div class='social-links'><p>{PROSE}</p></div></article>", "\n\n".join([PROSE.strip()] * 3)),
        # A language without a list of stop words.
        (f"<ul><li><a href=1>Etusivu</a><li><a href=2>Haku</a></ul><p>{FINNISH}</p><p>Loppu.</p><p>{FINNISH}</p><div><a href=3>Lue</a> <a href=4>lisää</a></div>", f"{FINNISH.strip()}\n\nLoppu.\n\n{FINNISH.strip()}"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_neighbours_decide_short_blocks():
    block = lambda t, links=0.0: (t, links, False, 0)
    assert labels([block("Menu", 1.0), block("Short"), block(PROSE), block("Short"), block(PROSE), block("Short"), block("Links", 0.9)]) == [False, False, True, True, True, False, False]


def test_tables(spark, none):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>"), (1, "u", None), (None, None, "<" * 3000)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got)[1:] == ["<" * 3000, PROSE.strip()] or sorted(r.text for r in got) == ["", "", PROSE.strip()]
    assert extract(none, html_col="text", out_col="text").collect() == []
    with pytest.raises(ValueError):
        extract(none, html_col="text", out_col="home")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<", ">", "'", '"', "<!--", "-->", "<script>", "</script>", "&amp;", "text ", "<a href='", "</"]), max_size=40).map("".join))
def test_any_markup_is_taken(page):
    assert isinstance(main_text(page), str)
