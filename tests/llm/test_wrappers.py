from reelyard.llm import wrappers

PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li>a<li>b</ul></nav><div class="ad">buy</div>
<article><h1>Head &amp; more</h1><p>One
 <b>bold</b>&nbsp;two<p>Three<br>four <script>var p="</p>"</script></p>%s<section id="comments"><p>bad</p></section></article>
<aside>side</aside><footer>&copy; x</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, text string")


def texts(spark, rows):
    frame = pages(spark, rows)
    return {r["page_id"]: (r["text"], r["n_chars"], r["url"]) for r in wrappers.main_texts(frame, wrappers.infer(frame)).collect()}


def test_structures_fold_and_align():
    one, two = wrappers.structure("<body><ul><li>a<li>b<li>c</ul><p>x"), wrappers.structure("<body><ul><li>a</ul><h1>t</h1><p>x<p>y")
    assert one == "body ul (li # /li)+ /ul p #"
    joined = wrappers.align(one, two)
    assert "(li # /li)+" in joined and "(h1)?" in joined and wrappers.align(joined, one) == joined
    assert set(wrappers.slots(joined)) == {"body/ul/li", "body/h1", "body/p"}


def test_article_of_a_host(spark):
    url = "https://h.example.org/%d"
    rows = [(i, url % i, PAGE % f"<p>n{i}</p>") for i in range(4)] + [(9, url % 9, PAGE % "" + "<p>")]
    got = texts(spark, rows)
    assert got[2][0] == "Head & more\nOne bold two\nThree four\nn2" and got[2][1] == len(got[2][0])
    assert got[9][0] == "Head & more\nOne bold two\nThree four"


def test_hosts_without_an_article(spark):
    rows = [(1, "http://a.example/1", "<body><div class='header'>H</div><div class='content'><p>x</p></div><div class='footer'>f</div>"), (2, "//b.example/2", "<body><form>q<input></form><p>only &lt;this&gt; &am"), (3, "http://c.example", "bare text")]
    got = texts(spark, rows)
    assert [got[i][0] for i in (1, 2, 3)] == ["x", "only <this> &am", "bare text"]


def test_odd_rows(spark):
    long = "<body><article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<article><p>t</p></article>"), (3, "no url", "<article><p>t</p></article>"), (4, "http://l.example", long), (None, "http://l.example", "<body><article><p>u")]
    frame = pages(spark, rows)
    out = wrappers.main_texts(frame, wrappers.infer(frame)).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert (got[1], got[2], got[3], got[None]) == ("", "", "t", "u") and got[4].count("\n") == 19_999
    empty = frame.limit(0)
    assert wrappers.main_texts(empty, wrappers.infer(empty)).count() == 0


def test_given_pages_against_a_plain_reading(spark):
    import html
    import re

    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame, wrappers.infer(frame)).collect()}
    for r in frame.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_names_of_single_pages(spark):
    page = '<body class="page-%d top+x"><div><div><div id="c%d" class="w-1/2 a?"><article id="post-%d" class="k%d"><p>one%d</p><p>two</p></article></div></div></div><div class="footer">f</div></body>'
    rows = [(i, f"http://i.example/{i}", page % (i, i, i, i, i)) for i in range(1, 6)]
    rows += [(10 + i, f"http://j.example/{i}", f"<body>{'<div>' * i}<p>deep{i}</p>{'</div>' * i}</body>") for i in range(1, 5)]
    rows += [(20 + i, f"http://k.example/{i}", f"<body><article{a}><p>k{i}</p></article></body>") for i, a in enumerate(("", " class=post", " id=main-content", " class='Entry x' id=y"))]
    got = {k: v[0] for k, v in texts(spark, rows).items()}
    assert got == {i: f"one{i}\ntwo" for i in range(1, 6)} | {10 + i: f"deep{i}" for i in range(1, 5)} | {20 + i: f"k{i}" for i in range(4)}


def test_kinds_of_pages_of_a_host(spark):
    bodies = {
        "<article><p>a</p></article><p>rest</p>": "a",
        "<main><p>b</p></main><p>rest</p>": "b",
        "<div class='content'><p>c</p></div><p>rest</p>": "c",
        "<p>d</p><footer>f</footer>": "d",
        "<div class='layout has-sidebar'><article><h2 id='related-work'>e</h2><p>e2</p></article></div>": "e\ne2",
        "<form><div class='page sidebar'><article><p>f</p></article></div></form><p>rest</p>": "f",
        "<main><p>g</p><div class='related'><article>card</article></div></main><div class='site-footer'>x</div>": "g",
        "<div id='comment-12'>x</div><div class='ad-banner'>x</div><div class='post-header'><p>h</p></div>": "h",
        "<article><svg viewBox='a>b' /><p>i</p><math/><svg><text>x</text></svg><p>i2</p></article>": "i\ni2",
    }
    rows = [(i, None if i % 2 else "http://m.example/", f"<html><head><title>t</title></head><body>{b}</body></html>") for i, b in enumerate(bodies)]
    heads = ["<head><title>t</title><meta charset=x><style>y</style><body><p>u</p>", "<head><title>t</title><base href=x><p>u</p>", "<head>x<script>'</head>'</script>y</head><body><p>u</p>", "<head><link rel=x><article><p>u</p></article>", "<head-line>u</head-line>"]
    rows += [(100 + i, "odd", "<html>" + h) for i, h in enumerate(heads)]
    got = {k: v[0] for k, v in texts(spark, rows).items()}
    assert got == dict(enumerate(bodies.values())) | {100 + i: "u" for i in range(len(heads))}


def test_constants_of_a_host_are_template(spark):
    """What all pages of a host say at one place is template, whatever its element is called; without the host it would be text."""
    page = "<body><div class='content'><p>Read our weekly letter</p></div><div><h2>Story %d</h2><p>Filed under all</p><p>text %d</p>%s</div><div>All rights</div></body>"
    rows = [(i, f"http://a.example/{i}", page % (i, i, "<p>more</p>" if i % 2 else "")) for i in range(9)]
    rows += [(20 + i, f"http://few.example/{i}", page % (i, i, "")) for i in range(7)]
    rows += [(40 + i, "http://same.example/", "<body><article><p>one</p><p>two</p></article></body>") for i in range(12)]
    rows += [(60 + i, f"http://art.example/{i}", f"<body><article><p>Shared by all</p><p>own {i}</p></article></body>") for i in range(10)]
    rows += [(80, "http://art.example/x", "<body><article><p>Shared by all</p></article></body>")]
    got = {k: v[0] for k, v in texts(spark, rows).items()}
    assert {i: got[i] for i in range(9)} == {i: f"Story {i}\ntext {i}" + ("\nmore" if i % 2 else "") for i in range(9)}
    assert {got[20 + i] for i in range(7)} == {"Read our weekly letter"}  # too few pages: paths alone
    assert {got[40 + i] for i in range(12)} == {"one\ntwo"}  # one page repeated
    assert [got[60 + i] for i in range(10)] == [f"own {i}" for i in range(10)]
    assert got[80] == "Shared by all"  # nothing but constants


def test_wrappers_in_a_tree_of_groups(spark):
    """A host of many structures is aligned in groups; every structure's slots are in its wrapper, and texts are the same."""
    rows = [(i, f"http://t.example/{i}", "<body>" + "<div>" * (i % 30) + f"<p>deep {i}</p>" + "</div>" * (i % 30) + "<ul>" + "<li>x</li>" * (i % 4) + "</ul>" + "</body>") for i in range(120)]
    frame = pages(spark, rows)
    some = {}
    for fan in (4, 200):
        known = wrappers.infer(frame, fan)
        some[fan] = {r["page_id"]: r["text"] for r in wrappers.main_texts(frame, known).collect()}
        assert {"body/" + "div/" * d + "p" for d in range(30)} <= set(known.first()["wanted"])
    assert some[4] == some[200] and all(t.startswith(f"deep {i}") for i, t in some[4].items())


def test_constants_join_in_any_order():
    import numpy as np

    draw = np.random.default_rng(3)
    for _ in range(50):
        sets = [np.unique(draw.integers(0, 12, 30).astype(np.uint64)) for _ in range(9)]
        one, two, half = wrappers.Constants(), wrappers.Constants(), wrappers.Constants()
        for k, x in enumerate(sets):
            one.add(x, [k])
            (half if k < 4 else two).add(x, [k])
        two.add(half.strings, half.pages)
        assert one.row() == two.row() and set(one.strings.tolist()) == set.intersection(*(set(x.tolist()) for x in sets))
