import pytest

from loomline.llm import common, html_extract as h


def text(source):
    return "\n\n".join(h.blocks(source))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("just <b>te</b>xt", "just text"),
        ("<nav>menu</nav><article><h1>T &amp; t</h1><p>a\n  b<br>c<p>d</article><footer>f</footer>", "T & t\n\na b c\n\nd"),
        ("<article><p><b>One.<br><p>Two.</p></article><p>outside</p>", "One.\n\nTwo."),
        ("<body><div class='side-bar sidebar'>s</div><div id=main>m<form>f</form></div><!-- c --><script>var t='</p>';</script>", "m"),
        ("<main><p>a</p><section class='comments'><p>no</p></section></main>", "a"),
        ("<article><header><h1>h</h1></header><p>x</p><aside>y</aside><div class=cookie-notice>z</div></article>", "h\n\nx"),
        ("<article><p>cut off", "cut off"),
        ("<div class='content with-sidebar no-comments'><p>x</p><div class='page-header'>y</div></div>", "x"),
        ("<article><div class='entry-header'><h1>h</h1></div><p>x</p></article>", "h\n\nx"),
        ("<article>a &lt;b&gt; &#233; &nope; </article>", "a <b> é &nope;"),
        ("<ul><li>a<li>b</ul>", "a\n\nb"),
        ("<p>one</p><p>two</p><article></article>", "one\n\ntwo"),
        ("<p class=\"x>y\">q</p><style>p{}</style>", "q"),
        ("<article><p>a</article><article><p>b</article>", "a\n\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ],
)
def test_blocks(source, want):
    assert text(source) == want


def page(k, extra="", host="h.example"):
    return (k, f"https://{host}/{k}", f"<nav>n</nav><article><h1>title {k}</h1><p>shared opening</p><p>body of page {k}</p>{extra}</article>")


SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows):
    return {r.page_id: r for r in h.extract_main_text(spark.createDataFrame(rows, SCHEMA), common.work_dir(spark)).collect()}


def test_what_a_host_repeats_is_removed(spark):
    rows = [page(k, "<div class='teaser'>Read our magazine</div>") for k in range(40)] + [page(k, "<div class='teaser'>kept</div>", "few.example") for k in range(100, 103)]
    got = extracted(spark, rows)
    assert got[3].text == "title 3\n\nshared opening\n\nbody of page 3" and got[3].removed_by_tree == 2 and got[3].n_chars == len(got[3].text)
    assert got[101].text.endswith("kept") and got[101].removed_by_names == 1


def site(k):
    """A page whose menu, teasers and footer have neither telling tags nor names."""
    menu = "".join(f"<div><a>{x}</a></div>" for x in ("Home", "News", "Shop", f"You are at {k % 3}"))
    body = f"<div class=c><div class=t>Story {k}</div><div class=p>First of {k}.</div><div class=p>Second of {k}.</div></div>"
    return (k, f"http://unnamed.example/{k}", f"<body><div class=a>{menu}</div>{body}<div class=b><div>Imprint</div><div>Terms</div><div>{'Season' if k % 2 else 'Summer'} sale</div></div></body>")


def test_menus_and_footers_without_names_are_removed_by_the_tree(spark):
    got = extracted(spark, [site(k) for k in range(30)])
    assert all(got[k].text == f"Story {k}\n\nFirst of {k}.\n\nSecond of {k}." for k in range(30))
    assert {(r.removed_by_tree, r.removed_by_names) for r in got.values()} == {(7, 0)}


def test_importance_by_brute_force(spark):
    """Features, entropies and composite importance of three hosts computed again from the parsed pages by recursion."""
    import math
    from collections import defaultdict

    rows = [site(k) for k in range(12)] + [page(k, "<div class='teaser'>Read</div><p>more</p>") for k in range(7)] + [page(99, "", "one.example")]
    folder = common.work_dir(spark)
    h.extract_main_text(spark.createDataFrame(rows, SCHEMA), folder).collect()
    got = {(r.host, r.node): r for r in spark.read.parquet(f"{folder}/style-tree").collect()}
    held, chains, leaves = defaultdict(lambda: defaultdict(set)), {}, set()
    for k, url, source in rows:
        p, host = h.parse(source), url.split("/")[2]
        chains |= {(host, n): c for n, c in p.chains.items()}
        leaves |= {(host, n) for n in p.leaves}
        for n, t in [*zip(p.leaves, p.texts, strict=True), *((n, s) for n, x in p.styles.items() for s in x)]:
            held[host, n][t].add(k)
    pages = {key: len(set().union(*f.values())) for key, f in held.items()}

    def importance(key):
        m, n = pages[key], [len(x) for x in held[key].values()]
        raw = 1 - sum(x * math.log(x) for x in n) / (sum(n) * math.log(m)) if m > 1 else 1
        return (m * raw + 1) / (m + 1)

    def composite(key):
        if key in leaves:
            return importance(key)
        below = [x for x in held if x[0] == key[0] and chains[x][:-1] == chains[key]]
        total, passed = sum(pages[x] for x in below), h.GAMMA ** len(held[key])
        return (1 - passed) * importance(key) + passed * sum(pages[x] / total * composite(x) for x in below)

    assert set(got) == set(held)
    for key, r in got.items():
        assert (r.pages, r.is_leaf) == (pages[key], key in leaves)
        assert math.isclose(r.importance, importance(key)) and math.isclose(r.composite, composite(key))


@pytest.mark.parametrize("part", ["<p>a", "<div>a", "<b>a", "<b><div></i>a", "<li><p>a<td>", "</div>a", "<a<", "<script", "<!-- ", "<a '", "<td><p></b>"])
def test_a_megabyte_of_broken_tags_takes_linear_time(part):
    import time

    began = time.process_time()
    h.parse(part * (1_000_000 // len(part)))
    h.parse(part * (1_000_000 // len(part)) + ">")
    assert time.process_time() - began < 15


def test_small_table(spark, small):
    """On the made-up pages menus and footers differ from page to page, so there the fallback works and the tree must not."""
    pages = common.table(spark, small, "pages")
    got = {r.page_id: r for r in h.extract_main_text(pages, common.work_dir(spark)).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == text(r.html or "")


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, "http://c.example/", page(1)[2]) for k in range(30)] + [(50, "http://c.example/2", page(2)[2])]
    assert {r.removed_by_tree for r in extracted(spark, rows).values()} == {0}


def test_odd_pages(spark):
    rows = [(None, None, None, 1, "x"), (1, None, "<p>a</p>", 2, "x"), (1, None, "<p>a</p>", 2, "x"), (2, "", "", 3, "x"), (3, "no url", "<p>" + "z " * 50_000, 4, "x"), (4, "http://h", "<<<>>&&&", 5, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, text string")
    got = h.extract_main_text(pages, common.work_dir(spark)).collect()
    assert len(got) == 6 and sorted(r.text for r in got if r.page_id == 1) == ["a", "a"] and all(r.text is not None for r in got)
    assert h.extract_main_text(pages.limit(0), common.work_dir(spark)).count() == 0


def test_what_one_page_alone_has_is_kept_on_a_host_of_stubs(spark):
    rows = [(k, f"http://s.example/{k}", f"<article><h1>title {k}</h1><p>{'please log in' if k < 850 else f'body of {k}'}</p></article>") for k in range(1000)]
    got = extracted(spark, rows)
    assert all((got[k].text, got[k].removed_by_tree) == (f"title {k}", 1) for k in range(850))
    assert all((got[k].text, got[k].removed_by_tree) == (f"title {k}\n\nbody of {k}", 0) for k in range(850, 1000))
