"""Archives and text extraction on small pages."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import extract, warc
from tidemark.llm.common import new_folder

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "payload " * 40 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a.example.com/x?y=1", BIG), (2, "https://A.example.com/x?y=1", BIG), (3, None, None), (4, "", ""), (5, "http://b.example.org/ü#frag", "tiny"), (6, "not a url", "tiny"),
        (7, "http://a.example.com/x?y=1", BIG + "other é漢"), (8, "http://a.example.com/line\nbreak", BIG), (9, "http://u:p@c.example.com:8080/p", "x" * 200_000),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("key", "digest", "refers_to", "w_id", "ex_host", "token", "file")}).cache()


def test_round_trip(pages):
    rows = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    assert set(rows) == set(html)
    first: dict = {}
    for i in sorted(html):
        r, known = rows[i], first.setdefault(html[i], i)
        revisit = known != i and len(html[i]) >= 100
        assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (urls[i], len(html[i]), hashlib.sha256(html[i]).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", known) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else html[i])


def test_index_finds_every_capture_and_nothing_else(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    many = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".example.com/"), F.col("id") % 40).alias("url"), F.col("id").cast("string").alias("html"))
    root = new_folder(spark, "warc-test")
    manifest = warc.write_archives(many, root)
    directory = warc.build_index(manifest, root)
    assert directory.count() >= 100
    some = many.where("page_id < 5").select(warc.url_key(F.col("url")).alias("key")).union(spark.createDataFrame([("absent",), ("",)], "key string"))
    found = {r["page_id"] for r in warc.read_records(warc.look_up(some, directory, root), root).collect()}
    keys = {(i % 7, i % 40) for i in range(5)}
    assert found == {i for i in range(300) if (i % 7, i % 40) in keys}


def test_awkward_pages(spark, pages):
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    repeated = pages.union(pages).union(spark.createDataFrame([(None, "http://x/", BIG)], SCHEMA).withColumns({c: F.lit("m") for c in pages.columns if c not in ("page_id", "url", "html")}))
    assert warc.archive_round_trip(repeated).count() == 19


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="x">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text<br>next &lt;p&gt; line<p>Second  paragraph
wraps<ul><li>item one</li><li>item two</li></ul><form><input><p>Sign up</p></form><!-- hidden --><aside>Aside</aside><div class="comments"><p>Reader says</p></div>
<p>Last {n}</p></article><div id="sidebar">Side</div><footer>&copy; Foot</footer></body></html>"""
TEXT = "Head & line\n\nFirst bold text next <p> line\n\nSecond paragraph wraps\n\nitem one\n\nitem two\n\nLast {n}"


def test_text_of_articles(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE.replace("{n}", str(i))) for i in range(6)]
    rows += [(10, "http://one.example.com/", PAGE), (11, None, None), (12, "http://one.example.com/e", ""), (13, "bad", "plain text only"), (14, "http://cut.example.com/", PAGE[:PAGE.index("Second") + 6])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("ex_host", "token", "times")})
    got = {r["page_id"]: r["ex_text"] for r in extract.extract_text(df).collect()}
    assert all(got[i] == TEXT.replace("{n}", str(i)) for i in range(6))
    assert got[10] == TEXT and got[11] == "" and got[12] == "" and got[14].endswith("Second")
    assert extract.extract_text(df.limit(0)).count() == 0


def one(html):
    return extract.main_text(html, None, frozenset())


def test_markup_as_browsers_read_it():
    assert one("<p class=it's>One</p><p>Two isn't lost</p><p>Three") == "One\n\nTwo isn't lost\n\nThree"
    assert one("<article><header><h1>Title</h1></header><p>Text</p></article><header>Site</header>") == "Title\n\nText"
    assert one("<div class='a/b.nav-free c.d'><p>A</p></div><p title='x > y' data-x=\"it's\">B</p>") == "A\n\nB"
    assert one("<body class='has-sidebar home'><div class='layout sidebar'><main><p>In</p></main></div><div class='sidebar'>Out</div></body>") == "In"
    assert one("<article><p>Story</p><section id=comments><article class=comment><p>Reader</p></article></section></article>") == "Story"
    assert one("<script>a='<p>x</p>'</script ><p>a<b</p><p>1 &lt; 2 &#8212; &amp;amp;</p><!-- > --><svg/><p>end") == "a\n\n1 < 2 \u2014 &amp;\n\nend"
    assert one(f"<div class='{'u ' * 300}nav'>Menu</div><p>Text</p>") == "Text"  # names aren't cut
    assert one(None) == one("") == one("<nav>x</nav>") == ""


def test_a_page_of_5_megabytes():
    paragraphs = [f"Paragraph {i} of a long page with some words" for i in range(80_000)]
    assert one("<main>" + "".join(f"<p>{x}" for x in paragraphs) + "</main>") == "\n\n".join(paragraphs)


NOTICED = """<html><body id="page-{n}"><nav><a href=1>Home</a><a href=2>More</a></nav><article id="post-{n}" class="post"><h1>Head {n}</h1><p class="lead">Lead {n}</p>
<p class="note">Subscribe to our letter today.</p>{body}<div class="share">Share</div></article><footer>Foot</footer></body></html>"""


def noticed(n, paragraphs=2):
    return NOTICED.replace("{n}", str(n)).replace("{body}", "".join(f"<p>Own words {n} {j} of this one page</p>" for j in range(paragraphs)))


def brute_template(pages, share=extract.TEMPLATE_SHARE):
    """{(host, token)} of the valid classes, by plain comparison of vectors, containers and orders."""
    out, dropped = set(), {}
    for host in {h for h, _ in pages}:
        own = [html for h, html in pages if h == host]
        if len(own) < extract.LEAST_PAGES:
            continue
        found = [{t[0]: t for t in extract.occurrences(x)} for x in own]
        vectors = {t: tuple(f[t][4] if t in f else 0 for f in found) for t in {t for f in found for t in f}}
        classes: dict = {}
        for t, v in vectors.items():
            if sum(x > 0 for x in v) >= share * len(own):
                classes.setdefault(v, []).append(t)
        info = {t: f[t] for f in found for t in f}
        for members in classes.values():
            if len(members) < extract.LEAST_TOKENS:
                continue
            outside: dict = {}
            for t in members:
                if info[t][1] not in members:
                    outside[info[t][1]] = outside.get(info[t][1], 0) + 1
            slot = max(outside, key=lambda p: (outside[p], p)) if outside else None
            members = [t for t in members if info[t][1] in members or info[t][1] == slot]
            tags, ranks, n = {t for t in members if not info[t][2]}, {}, 0
            for x in own:
                order = [t for t in extract.token_order(x) if t in tags]
                n += bool(order)
                for rank, t in enumerate(order):
                    ranks.setdefault(t, []).append(rank)
            bad = {t for t in tags if max(ranks[t].count(r) for r in ranks[t]) < share * n}
            dropped[host] = dropped.get(host, set()) | bad
            out |= {(host, t) for t in members if t not in bad}
        out = {(h, t) for h, t in out if h != host or not info[t][2] or info[t][1] not in dropped.get(host, ())}
    return out


def test_template_equals_plain_comparison(spark):
    """Pages with their own ids, a class in changing order, one in two containers, an optional part, a host of few pages."""
    pages = []
    for n in range(20):
        flip = ["<ul class=x><li>a</ul>", "<ol class=y><li>b</ol>"][:: 1 if n % 2 else -1]
        more = "<div class=rare><h3>Rare</h3></div>" if n == 3 else ""
        pages.append(("a.example", noticed(n, n % 4).replace("<footer>", more + "".join(flip) + "<footer>")))
        pages.append(("b.example", "<div class=l><p>one</p></div><div class=r><p>two</p><i>x</i></div>" + "<b>w</b>" * (n % 3)))
    pages += [("few.example", noticed(n)) for n in range(4)]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(pages)], SCHEMA)
    keyed = df.select(extract.host_of(F.col("url")).alias("ex_host"), F.xxhash64("page_id", "url").alias("ex_page"), "html")
    rows = extract.template(keyed).collect()
    assert {(r["ex_host"], r["token"]) for r in rows} == brute_template(pages)
    assert {r["ex_host"] for r in rows} == {"a.example", "b.example"}
    tags = {r["token"] for r in rows if r["ex_host"] == "a.example"}
    page = extract.Page(pages[0][1])
    at = {t: page.tokens[i] for i, t in enumerate(page.tags)}
    assert at["article"] in tags and at["ul"] not in tags and at["ol"] not in tags  # post-7 and post-8 are one token; the lists change their order


def test_lines_that_articles_repeat_are_template(spark):
    rows = [(n, f"http://n.example.com/{n}", noticed(n, 1 + n % 3)) for n in range(12)] + [(50 + n, f"http://copies.example.com/{n}", noticed(7)) for n in range(6)]
    got = {r["page_id"]: r["ex_text"] for r in extract.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for n in range(12):
        assert got[n] == "\n\n".join([f"Head {n}", f"Lead {n}", *(f"Own words {n} {j} of this one page" for j in range(1 + n % 3))])
    assert all("Own words 7 0" in got[50 + n] and "Head 7" in got[50 + n] for n in range(6))  # copies don't make a text a template


def test_awkward_pages_of_text(spark, pages):
    repeated = pages.union(pages).union(pages.limit(0))
    rows = extract.extract_text(repeated).collect()
    assert len(rows) == 18 and set(rows[0].asDict()) == {c for c in pages.columns if not c.startswith("ex_")} | {"ex_text"}
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r["ex_text"])
    assert all(len(x) == 2 and x[0] == x[1] for x in by.values())
    assert by[1][0] == ("payload " * 40).strip() and by[5] == ["tiny"] * 2 and by[3] == by[4] == [""] * 2


def test_text_without_article_is_what_varies(spark):
    page = "<html><body><div class='menu'><a href=1>Home</a></div><div class='top'>Always the same words</div><div class='content'><p>Story number {n}</p></div><div class='links'><a href=2>Link {n} is long enough</a></div></body></html>"
    df = spark.createDataFrame([(i, f"http://v.example.com/{i}", page.replace("{n}", str(i))) for i in range(8)], SCHEMA)
    assert {r["page_id"]: r["ex_text"] for r in extract.extract_text(df).collect()} == {i: f"Story number {i}" for i in range(8)}


def test_the_template_decides_and_survives_repeats(spark):
    """Without the template the repeated lines stay, with it they go; a table with every page twice has the same template."""
    rows = [(n, f"http://n.example.com/{n}", noticed(n, 1 + n % 3)) for n in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r["ex_text"] for r in extract.extract_text(df).collect()}
    off = {n: extract.main_text(html, None, frozenset()) for n, _, html in rows}
    assert all(got[n] != off[n] and set(got[n].split("\n\n")) < set(off[n].split("\n\n")) for n in got)
    keyed = lambda x: x.select(extract.host_of(F.col("url")).alias("ex_host"), F.xxhash64("page_id", "url").alias("ex_page"), "html")
    tokens = lambda x: {(r["ex_host"], r["token"]) for r in extract.template(keyed(x)).collect()}
    once, twice = tokens(df), tokens(df.union(df))
    assert once == twice and len(once) > 4
    # Classes stay apart: an exclusive or would give every token of the doubled table the signature 0.
    classes = lambda x: extract.equivalence_classes(keyed(x)).select("signature").distinct().count()
    assert classes(df) == classes(df.union(df))
    assert {r["page_id"]: r["ex_text"] for r in extract.extract_text(df.union(df)).collect()} == got
