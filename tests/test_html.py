"""Pages read by literal cases, and links by those of a whole table."""

import re

from conftest import SF

from quillspark.operators import ingest

PAGES = {
    "boilerplate": ("<html><head><title> Shipping </title><style>b{c:d}</style><script>alert(1)</script></head><body><header><a href='/x'>Home</a></header><nav>Menu</nav><main><h1>Delivery</h1><p>Free  over <b>200</b>.</p><p>Three days.</p></main><footer>All rights</footer></body></html>", "Shipping", "Delivery\n\nFree over 200 .\n\nThree days.", []),
    "links": ("<a href='/s'>s</a><a href='r#top'>r</a><a href='https://a.example/s'>again</a><a href='https://b.example/x'>other</a><a href='mailto:a@b.example'>m</a><a href='#here'>h</a><a href=''>e</a>", "", "s r again other m h e", ["https://a.example/s", "https://a.example/docs/r", "https://b.example/x"]),
    "alt": ("<img alt=' An offer ' src='a.png'><img alt='' src='b.png'>now", "", "An offer\n\nnow", []),
    "second title": ("<title> </title><title>Told</title>text", "Told", "text", []),
    "open menu": ("<div><nav><div>menu</div><a href='/in'>in</a></div><p>text</p><a href='/out'>out</a>", "", "text\n\nout", ["https://a.example/out"]),
    "menu in a header": ("<header><nav><nav>menu</header>text<aside>more</aside></div> still", "", "text still", []),
    "inline end": ("<p><b>one<nav>menu</b></p>two</nav>three", "", "one three", []),
    "raw": ("<div>a<svg><div>b</div></svg><noscript>c</noscript>d<select><option>e</div></select>f</div>", "", "a d f", []),
    "never closed": ("text<footer>the rest<p>and more", "", "text", []),
    "none": (None, "", "", []),
}


def test_pages(spark):
    rows = spark.createDataFrame([(k, "https://a.example/docs/index.html", v[0]) for k, v in PAGES.items()], "id string, url string, html string")
    got = {r["id"]: (r["title"], r["text"], r["links"]) for r in ingest.extract_pages(rows).collect()}
    assert got == {k: (title or "https://a.example/docs/index.html", text, links) for k, (_, title, text, links) in PAGES.items()}


def test_long_chains_of_open_elements_are_read_in_linear_time(spark):
    page = "<div>" * 100_000 + "<nav>menu" + "</table>" * 100_000 + "</div>text"
    (row,) = ingest.extract_pages(spark.createDataFrame([("https://a.example/", page)], "url string, html string")).collect()
    assert row["text"] == "text"


def test_links_of_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    for row in ingest.extract_pages(pages).collect():
        body = re.sub(r"(?s)<(nav|header|footer|aside|script|style|form|svg|template|noscript|iframe|select|button)\b.*?</\1>", "", row["html"] or "")
        own = [h for h in re.findall(r"<a\b[^>]*?href=[\"']([^\"']+)", body) if h.startswith("http")]
        assert set(h.split("#")[0] for h in own) <= set(row["links"])
