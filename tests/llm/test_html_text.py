"""Main text of hand-made pages, and densities by their formula."""

from math import e, log

import pytest

from casemill.llm import html_text, queries

LONG = "A sentence of the text that is long enough to count as prose, and goes on for a while. "
MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a><li><a href="/c">Contact us</a></ul></nav>'
P = f"<p>{LONG}</p>"
BODY = "\n".join([LONG.strip()] * 3)

PAGES = {
    "article": (f"<html><head><title>T</title></head><body>{MENU}<article><h1>Head</h1>{P * 3}</article><footer>(c)</footer></body></html>", "Head\n" + BODY),
    "no article": (f"<body>{MENU}<div id='wrap'><div class='x1'><h2>Head</h2>{P * 3}</div><div class='sidebar'>{P * 5}</div></div>", "Head\n" + BODY),
    "sections": (f"<body><div><div>{P * 2}</div><div>{P}</div><ul><li><a href=1>one link</a><li><a href=2>two link</a><li><a href=3>more and more</a></ul></div>", BODY),
    "comments": (f"<main><article>{P * 3}<section id=comments><h3>Replies</h3><article class=comment>{P * 9}</article></section></article></main>", BODY),
    "adverts": (f"<article><p>{LONG}<p>{LONG}<div class='ad-slot ad'>{P}</div><aside>{P}</aside><p>{LONG}</article>", BODY),
    "notices": (f"<div class='cookie-notice'>{P}</div><div role=alert>{P}</div><div class=post>{P * 3}</div><form>{P}<input><label>x</label></form>", BODY),
    "headers": (f"<header><h1>Site</h1>{P}</header><article><header><h1>Head</h1></header>{P * 3}</article>", "Head\n" + BODY),
    "scripts": (f"<script>var p='<p>x</p>';</script><article><style>p{{}}</style>{P}<noscript>no</noscript>{P}<script>if(a<b)c()</script>{P}<!-- <p>out</p> --></article>", BODY),
    "hidden": (f"<article>{P * 3}<p hidden>x</p><p style='display: none'>y</p><p aria-hidden=true>z</p></article>", BODY),
    "wrapper": (f"<form id=aspnet><div class='page sidebar-right'><article>{P * 3}</article></div></form>", BODY),
    "not a sidebar": (f"<body class='has-sidebar'><div class='content no-sidebar'>{P * 3}</div></body>", BODY),
    "references": ("<article><p>a &lt; b &amp;amp; c&nbsp;d &#233;&#x1F600; &eacute; AT&T &unknown; 1 < 2 &copy</p></article>", "a < b &amp; c d é😀 é AT&T &unknown; 1 < 2 ©"),
    "inline": ("<article><p>one <b>two<i> three</b> four</i>five<br>six\n\t seven<p>  <span>eight</span> </article>", "one two three fourfive six seven\neight"),
    "tables": ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><dl><dt>t<dd>d</dl>tail</article>", "a\nb\nc\nx\ny\nt\nd\ntail"),
    "one word": ("<body><nav>menu</nav><article>x</article>", "x"),
    "text only": ("just text", "just text"),
    "nothing": ("<body><nav>menu</nav><script>x()</script></body>", ""),
    "odd markup": ("</p></div><article></b><p>a</p></article></article><p></x>", "a"),
    "many links": (f"<div><p>{LONG}<a href=1>with</a> a link.</p>{P * 2}</div><div>" + "<a href=1>link text here</a> " * 50 + "</div>", LONG + "with a link.\n" + "\n".join([LONG.strip()] * 2)),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, text = PAGES[name]
    assert html_text.main_text(html) == text


def test_composite_density():
    c, t, lc, lt, share = 100, 4, 20, 2, 0.3
    wanted = c / t * log((c / lc) * (t / lt), log(c / (c - lc) * lc + share * c + e))
    assert html_text.composite(c, t, lc, lt, share) == pytest.approx(wanted)
    assert html_text.composite(100, 0, 0, 0, 0.0) == 100 and html_text.composite(0, 3, 0, 0, 0.5) == 0
    assert html_text.composite(50, 5, 50, 5, 0.2) == 0  # nothing but links
    page = html_text.Page(f"<body><div><p>{LONG}</p><p><a>x</a></p></div></body>")
    body = html_text.measure(page)
    assert (body.chars, body.tags, body.link_chars, body.links) == (len(LONG.strip()) + 1, 4, 1, 1)
    (block,) = body.parts
    assert block.sum == pytest.approx(sum(p.density for p in block.parts)) and body.sum == pytest.approx(block.density)


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert html_text.main_text(deep) == "x"
    many = f"<article>{P * 20_000}</article>"
    assert html_text.main_text(many) == "\n".join([LONG.strip()] * 20_000)


def test_query(spark, tmp_path):
    rows = [(i, f"http://x/{i}", html) for i, (html, _) in enumerate(PAGES.values())]
    rows += [(None, None, None), (0, "again", PAGES["article"][0]), (0, "again", PAGES["article"][0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df.selectExpr("*", "'x' AS text", "1 AS N_chars", "2 AS tags").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op11_html_text(spark, str(tmp_path))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    texts = [t for _, t in PAGES.values()] + ["", PAGES["article"][1], PAGES["article"][1]]
    wanted = [(r[0], r[1], t, len(t)) for r, t in zip(rows, texts)]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)
    extra = html_text.extract(df.selectExpr("*", "'x' AS text", "1 AS N_chars", "2 AS tags"))
    assert extra.columns == ["page_id", "url", "tags", "text", "n_chars"] and extra.count() == len(rows)
    assert html_text.extract(df.limit(0)).count() == 0
