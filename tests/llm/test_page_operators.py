"""Operators over pages."""

import html
import re

import duckdb
import pytest

from oracle_check import compare
from swipesight.llm import queries, site_tree, url_filter

SMALL = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_articles_of_the_given_table(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = queries.op1_site_style_tree(spark, SMALL).collect()
    assert len(found) == len(source)
    for r in found:
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.DOTALL)[1]
        blocks = [re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", article)]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_tree_finds_unmarked_boilerplate(spark):
    rows = [
        (i, "http://a.example.org/x", f"<body><div class=top><span>Site name</span> since 1999</div><div><p>Own words {i} of page.<p>More {i * 7} text &amp; so on</div></body>")
        for i in range(20)
    ]
    found = {r.page_id: r for r in site_tree.extract(pages(spark, rows)).collect()}
    assert found[3].text == "Own words 3 of page.\n\nMore 21 text & so on" and found[3].n_removed == 1


def test_marked_parts_and_broken_markup(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>h</header><div role=navigation>n</div><aside>s</aside>"
        "<div class='cookie-notice'>c</div><main><h1>Head&eacute;</h1><p>One <b>two<br>three</b>  four<p>five<script>if (a</p>) {}</script>"
        "<form>f<input></form><ul><li>x<li>y</ul><section id=comments><p>rude</section></main><footer>z</footer>"
    )
    rows = [(1, "http://h/", page), (2, None, None), (3, "x", ""), (4, "http://h/", "<p>only &lt;text&gt;"), (4, "http://h/", "<p>only &lt;text&gt;")]
    found = site_tree.extract(pages(spark, rows)).collect()
    text = {r.page_id: r.text for r in found}
    assert len(found) == 5 and text == {1: "Headé\n\nOne two three four\n\nfive\n\nx\n\ny", 2: "", 3: "", 4: "only <text>"}
    assert site_tree.extract(pages(spark, [])).count() == 0


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://h.example.org/", "<nav>menu</nav><article><p>The same text.</article>") for i in range(30)]
    assert {r.text for r in site_tree.extract(pages(spark, rows)).collect()} == {"The same text."}


def test_declared_content_enters_the_tree(spark):
    rows = [(i, "http://h.example.org/", f"<article><div class=by>By the staff.</div><p>Own words {i}.</article>") for i in range(20)]
    tree = site_tree.importance(site_tree.statistics(site_tree.trees(pages(spark, rows)))).collect()
    assert sorted((r.pages, round(r.content, 6)) for r in tree) == [(20, 0.0), (20, 1.0)]
    found = site_tree.extract(pages(spark, rows)).collect()
    assert {r.text for r in found} == {f"By the staff.\n\nOwn words {i}." for i in range(20)}
    assert {(r.n_removed, r.n_spared) for r in found} == {(0, 1)}


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://WWW.Example.ORG/es/1?q", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12#x", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
    ("http://bexample.org?x=/es/", "bexample.org", "", None, "allow"),
    ("nothing", "", "", None, "allow"),
    (None, "", "", None, "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    outcomes = spark.createDataFrame([(1, 0), (1, None)], "page_id long, bad int")
    r = url_filter.judge(pages(spark, [(1, url, "")]), outcomes, queries.RULES).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows, labels = [], []
    for i in range(300):
        host = ["bad.spam.net", "good.fine.net", f"s{i}.many.net"][i % 3]
        rows.append((i, f"http://{host}/{i}", ""))
        labels.append((i, int(host == "bad.spam.net")))
    rows += [(900, "http://once.fine.net/", ""), (901, "http://new.spam.net/", ""), (902, "http://x.zz/", "")]
    labels.append((900, 1))
    found = {r.page_id: r for r in url_filter.judge(pages(spark, rows), spark.createDataFrame(labels, "page_id long, bad int"), []).collect()}
    assert found[0].verdict == "block" and found[1].verdict == "allow" and found[2].verdict == "allow"
    assert found[900].verdict == "allow" and found[900].bad_mean < 0.9 and len(found) == len(rows)
    assert url_filter.judge(pages(spark, []), spark.createDataFrame([], "page_id long, bad int"), []).count() == 0


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    for name, sql in queries.oracle_sql().items():
        assert compare(queries.entries()[name](spark, SMALL), con, sql) is None, name
