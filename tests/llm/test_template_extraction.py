import pytest

from maskwright.llm import template_extraction as T


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<article><h1>T &lt;x&gt;</h1><p>a\n  b&nbsp;c<p>d<br>e</article><footer>f</footer>", "T <x>\n\na b c\n\nd e"),
        ("<nav>menu</nav><main><header>top</header><p>body</p></main>", "body"),
        ("<script>var t='</p><article>x</article>';</script><p>in", "in"),
        ("<style>p{}</style><!-- <p>no</p> --><div class='ad'>buy</div><div>keep</div>", "keep"),
        ("<article><p>one</p><aside>side</aside><form><p>name</p></form><div class=\"comments\"><p>reader</p></div><p>two</p></article>", "one\n\ntwo"),
        ("<article><p>a <b>bold</b> <span class='ad'>ad</span>word</p></article>", "a bold word"),
        ("<main><div>outer</div><article><p>inner</p></article></main>", "inner"),
        ("<div class='cookie-notice'>We use</div><div id='main-content'><p>text</p></div><p>other</p>", "text"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\n\ny\n\n1\n\n2"),
        ("<article><p><b>never closed.<br><p>next</p></article><footer>&copy;</footer>", "never closed.\n\nnext"),
        ("<p>5 < 6 and <3</p>", "5 < 6 and <3"),
        ("<ARTICLE><P CLASS=x>Upper</P></ARTICLE>", "Upper"),
        ("<article><header><h1>Head</h1></header><p>t</p><footer>by me</footer></article>", "Head\n\nt"),
        ("<template><p>t</p></template><article><p>&#233;&eacute;&#x1F642;</p></article>", "éé🙂"),
    ],
)
def test_main_text_of_a_page(source, want):
    assert T.main_text(source) == want


def page(i, body):
    return f"<html><body><div class='top'><span>Site name</span></div><div class='menu2'><p>Home</p><p>About</p></div><div class='x1'>{body}</div><div class='bottom'><p>Terms of use</p></div></body></html>"


def test_templates_are_deduced_and_their_slot_found(spark):
    rows = [(i, f"http://a.example/{i}", page(i, "".join(f"<p>story {i} line {j} with words</p>" for j in range(1 + i % 4)))) for i in range(12)]
    rows += [(100, "http://b.example/", "<p>lone page</p>"), (101, None, None), (102, None, "<p>no url</p>"), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in T.extract_main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for i in range(12):
        assert got[i][0] == "\n\n".join(f"story {i} line {j} with words" for j in range(1 + i % 4))
    assert got[3] == got[3][:1] * 2
    assert (got[100], got[101], got[102]) == (["lone page"], [""], ["no url"])
    template = {r.host: r for r in T.deduce_templates(pages.withColumn("host", T.host_of(pages.url))).collect()}["a.example"]
    assert template.slot.endswith("/div.x0")
    assert {T.text_hash(t) for t in ("Site name", "Home", "About", "Terms of use")} == set(template.texts)
    joined = {r.page_id: r.text for r in T.extract_main_text(pages, broadcast_tokens=0).collect()}
    assert joined == {k: v[0] for k, v in got.items()}
    assert T.extract_main_text(pages.where("false")).count() == 0


def test_paragraphs_that_many_articles_share_stay(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><p>own {i}</p>{'<p>shared line</p>' if i % 2 else ''}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in T.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "own 1\n\nshared line"


def test_long_pages_and_odd_markup_end(spark):
    assert len(T.main_text("<p>" + "word " * 200_000).split()) == 200_000
    T.main_text("<div>" * 3000 + "x" + "</div>" * 3000)
    T.main_text('<a href="' * 200)
    T.main_text("<script>never closed <p>x")


def extracted(spark, sources):
    rows = [(i, f"http://a.example/{i}", s) for i, s in enumerate(sources)]
    return [r.text for r in sorted(T.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_hosts_of_copies_keep_their_text(spark):
    assert extracted(spark, [page(0, "<p>one</p><p>two</p>")] * 20) == [T.main_text(page(0, "<p>one</p><p>two</p>"))] * 20
    assert extracted(spark, [f"<div>{i}</div><article><h1>Head</h1><p>one</p></article>" for i in range(20)]) == ["Head\n\none"] * 20


def test_constants_go_only_at_their_place(spark):
    got = extracted(spark, [page(i, f"<h2>{'Home' if i == 3 else f'Title {i}'}</h2><p>story {i}</p>") for i in range(12)])
    assert got[3] == "Home\n\nstory 3"


def plain(i):
    """A page without any mark of an article; two in three have a box that stands in the slot."""
    box = f"<section class='qe'><em class='qf'>box</em> {i}</section>" if i % 3 else ""
    return f"<html><body><div class='qa'><span>Shop of things</span></div><div class='qb'><h1>Title {i}</h1><div class='qc'>{''.join(f'<p>line {j} of {i} with some words</p>' for j in range(2 + i % 3))}</div>{box}</div><div class='qd'><p>All rights</p></div></body></html>"


def brute_template(pages, support=0.5):
    """Classes of tokens by their whole vectors, straight from the definition."""
    pages = sorted(set(pages))
    vectors = {}
    for k, source in enumerate(pages):
        for token, (n, _) in T.page_tokens(source).items():
            vectors.setdefault(token, [0] * len(pages))[k] = n
    classes = {}
    for token, v in vectors.items():
        if sum(x > 0 for x in v) >= support * len(pages):
            classes.setdefault(tuple(v), []).append(token)
    return sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_classes_equal_brute_force_and_nest(spark):
    sources = [plain(i) for i in range(9)] + [plain(3), plain(3), plain(4)] + [plain(20).replace("qd", "qz"), plain(21) + "<p>more</p><p>more</p>"]
    pages = spark.createDataFrame([("h", s) for s in sources] + [("other", plain(1))], "host string, html string")
    found = {r.host: r for r in T.deduce_templates(pages).collect()}
    assert set(found) == {"h"}
    got = sorted(sorted((t.path, t.text) for t in c.tokens) for c in found["h"].classes)
    assert got == brute_template(sources)
    assert len(got) >= 2
    for c in found["h"].classes:
        assert all(t.path.startswith(c.inside) for t in c.tokens)
    assert {c.inside for c in found["h"].classes} >= {"/html/body/div.qb"}
    assert found["h"].slot == "/html/body/div.qb"


def test_the_slot_decides_without_marks_and_against_wrong_ones(spark):
    rows = [(i, "http://p.example/x", plain(i)) for i in range(8)] + [(100 + i, "http://w.example/x", f"<body><main><p>Wrong mark</p></main><div><p>story {i} that is long enough</p><p>and more of {i} in here</p></div></body>") for i in range(8)]
    got = {r.page_id: r.text for r in T.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == "\n\n".join([f"Title {i}", *(f"line {j} of {i} with some words" for j in range(2 + i % 3)), *([f"box {i}"] if i % 3 else [])])
        assert got[100 + i] == f"story {i} that is long enough\n\nand more of {i} in here"


def test_a_line_that_every_slot_holds_goes_and_copies_of_an_article_stay(spark):
    story = "".join(f"<p>paragraph {j} that all of these share</p>" for j in range(9))
    noted = [plain(i).replace("</h1>", "</h1><div class='qg'>Read in four minutes</div>") for i in range(8)]
    copies = [f"<body><div class='qb'><h1>Same</h1>{story}<p>seen {i} times</p></div><div>{i}</div></body>" for i in range(8)]
    rows = [(i, "http://n.example/x", s) for i, s in enumerate(noted)] + [(100 + i, "http://c.example/x", s) for i, s in enumerate(copies)]
    got = {r.page_id: r.text for r in T.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == "\n\n".join([f"Title {i}", *(f"line {j} of {i} with some words" for j in range(2 + i % 3)), *([f"box {i}"] if i % 3 else [])])
        assert got[100 + i].startswith("Same\n\nparagraph 0 that all of these share")
