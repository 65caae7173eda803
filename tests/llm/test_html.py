import pytest

from basketweave.llm import html
from tests.llm.helpers import prose

PAGES = "page_id BIGINT, url STRING, html STRING, host STRING, place INT"


def extract(spark, rows):
    rows = [(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)]
    return {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><article><h1>T</h1><p>One <b>t</b>wo &amp; &#x41;&lt;</p></article><footer>f</footer>", "T One two & A<"),
        ('<script>var t="</p><article>no</article>";</script><article><p>a<br>b<p>c</article>', "a b c"),
        ('<main>x<div class="ad">buy</div><aside>s</aside><form><input>f</form><section class="comments">c<article>d</article></section>y</main>', "x y"),
        ('<body class="nav-open"><div id="cookie-banner">We use</div><div class="post-content">text</div><div class="sidebar">s</div>', "text"),
        ("<form action=x><article>kept</article>field</form>", "kept"),
        ("<article><header><h1>Title</h1></header>t<div class='post-footer'>by</div></article>", "Title t"),
        ("<nav>never closed <article>kept</article>", "never closed kept"),
        ("plain text, no tags: 1 < 2 &nbsp; &copy;", "plain text, no tags: 1 < 2 ©"),
        ("<article>a<!-- c --><!-- unclosed", "a"),
        ("<p title='>'>q</p><p hidden>h</p><div style='display:none'>n</div>", "q"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<p class=\"x", ""),
        ("", ""),
    ],
)
def test_structure(page, want):
    assert html.main_text(page, []) == want


def test_open_text_that_repeats_on_a_host_goes(spark):
    bar = "Follow us on all channels and read our weekly letter today"
    rows = [(f"https://a.example/{k}", f"<div>{bar}</div><div>{k} {prose(40, k)}</div><div>x{k} {bar}</div>") for k in range(5)]
    rows += [("https://b.example/1", f"<div>{bar}</div><div>{prose(40, 9)}</div>")]
    got = extract(spark, rows)
    for k in range(5):
        assert got[k]["text"] == f"{k} {prose(40, k)} x{k}" and got[k]["n_chars"] == len(got[k]["text"])
    assert got[5]["text"] == f"{bar} {prose(40, 9)}"  # once on its host


def test_boilerplate_goes_from_pages_of_little_else(spark):
    bar = prose(150, 1)
    rows = [(f"https://a.example/{k}", f"<div>{bar}</div><p>{k} {prose(n, 100 + k)}</p>") for k, n in enumerate((30, 70, 3, 30))]
    rows += [rows[0]]  # read twice
    got = extract(spark, rows)
    assert [got[k]["text"] for k in range(5)] == [f"{k} {prose(n, 100 + k)}" for k, n in [*enumerate((30, 70, 3, 30)), (0, 30)]]


def test_three_pages_are_counted_exactly(spark, monkeypatch):
    """Three pages whose numbers agree in the bits that an approximate count would look at."""
    hashed, made = html.runs, {}

    def numbered(page):
        starts, near, content = hashed(page)
        return starts, near, None if content is None else made.setdefault(content, len(made) << 20)

    bar = "Follow us on all channels and read our weekly letter today"
    monkeypatch.setattr(html, "runs", numbered)
    rows = [(f"https://a.example/{k}", f"<div>{bar}</div><p>{prose(20, k)}</p>") for k in range(3)]
    rows += [(f"https://b.example/{k}", f"<div>{bar}</div><p>{prose(20, 10 + k)}</p>") for k in range(2)]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], PAGES).coalesce(1)
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert [got[k] for k in range(3)] == [prose(20, k) for k in range(3)]
    assert [got[3 + k] for k in range(2)] == [f"{bar} {prose(20, 10 + k)}" for k in range(2)]


def test_article_text_and_copies_stay(spark):
    same = prose(50, 3)
    rows = [("https://a.example/", f"<article>{same}</article>")] * 2
    rows += [(f"https://a.example/{k}", f"<article>{same} {k}</article>") for k in range(4)]
    rows += [(f"https://c.example/{k}", f"<p>{same}</p><p>{k}</p>") for k in range(4)]
    got = extract(spark, rows)
    assert [got[i]["text"] for i in range(10)] == [same] * 2 + [f"{same} {k}" for k in range(4)] * 2


def test_a_host_with_most_pages(spark):
    rows = [("https://hot.example/x", f"<div>read more about our terms of use and privacy here</div><p>{k} {prose(10, k)}</p>") for k in range(300)]
    got = extract(spark, rows)
    assert all(got[k]["text"] == f"{k} {prose(10, k)}" for k in range(300))


def test_odd_rows(spark):
    rows = [(None, None), ("not a url", "<p>x</p>"), ("https://a.example", None), ("https://a.example", " "), (None, "<article>" + prose(20000) + "</article>")]
    got = extract(spark, rows)
    assert [got[i]["text"] for i in range(4)] == ["", "x", "", ""] and got[4]["n_chars"] == len(prose(20000))
    assert html.extract(spark.createDataFrame([], PAGES)).collect() == []
    twice = spark.createDataFrame([(1, "u", "<p>a</p>", "x", 1), (None, "u", "<p>b</p>", "x", 1)] * 2, PAGES)
    assert sorted(r["text"] for r in html.extract(twice).collect()) == ["a", "a", "b", "b"]
