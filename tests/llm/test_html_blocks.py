import numpy as np
import pytest

from locusmill.llm import html_blocks as hb
from locusmill.llm.queries import op8_block_labeller

PROSE = "The first words of a long enough paragraph, with a comma and an end. " * 3


def pages(n=60):
    rnd = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    prose = lambda k: (" ".join(rnd.choice(words, k)) + ".").capitalize()
    out = []
    for i in range(n):
        nav = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rnd.choice(words, 5))
        body = "".join(f"<p>{prose(int(rnd.integers(3, 60)))}</p>" for _ in range(rnd.integers(1, 9)))
        out.append(
            f"<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul>{nav}</ul></nav><div class=ad>{prose(9)}</div>"
            f"<article><h1>{prose(5)}</h1>{body}</article><footer>&copy; {prose(4)}</footer></body></html>"
        )
    return out


def texts(page):
    return [b.text for b in hb.blocks_of(page)]


def test_blocks():
    page = (
        "<!DOCTYPE html><head><title>no</title></head><body>a&amp;b <b>bold<br>next</b>\n x<p>one<p>two &eacute;&#8212;<ul><li>l1<li>l2</ul>"
        "<!-- <p>gone</p> --><script>if (a<b) '</p>'</script><style>p{}</style><img alt='>'><textarea>typed</textarea>1 < 2<hr>end"
    )
    assert texts(page) == ["a&b bold next x", "one", "two é—", "l1", "l2", "1 < 2", "end"]
    assert texts("") == texts("<p></p>") == texts("<script>x") == texts("<!-- x") == []
    assert texts("<p") == ["<p"] and texts("</div>x</p>") == ["x"]
    paths = {b.text: b.path for b in hb.blocks_of("<div class='ad top' id=main2><p>x</p></div><P>y")}
    assert paths == {"x": ("div", "ad", "top", "main", "p"), "y": ("p",)}
    assert [b.linked for b in hb.blocks_of("<p>ab <a href=x>cd</a> e</p>")] == [2]


def test_only_named_content_goes():
    page = "<head><title>t</title><article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><noscript>shown text</noscript>"
    page += "<svg><title>no</title><text>label</text></svg> <object>instead</object><template><p>no</p></template><p>end"
    assert texts(page) == ["Let x=1 be", "shown text", "label instead", "end"]
    assert texts("<head><meta charset=x><p>all of it") == ["all of it"]


def test_sample(spark):
    copies = [("<p>same",)] * 500 + [(f"<p>{i}",) for i in range(40)] + [(None,)]
    df = spark.createDataFrame(copies, "html string")
    assert len(hb.sampled(df, "html", 30)) == 30 and len(hb.sampled(df, "html", 300)) == 41
    assert hb.sampled(df.limit(500), "html", 30) == ["<p>same"] and hb.sampled(df.where("false"), "html", 3) == []


def test_long_page():
    page = "<article>" + "<p>word and more.</p>" * 30_000 + "<p>" + "y " * 300_000
    blocks = hb.blocks_of(page)
    assert len(blocks) == 30_001
    labels = hb.Labeller().label([hb.vectors(blocks), hb.vectors([])])
    assert len(labels[0]) == 30_001 and len(labels[1]) == 0


def test_gradients():
    rnd = np.random.default_rng(1)
    model = hb.Labeller()
    x, mask, y = hb.padded([(rnd.standard_normal((n, hb.INPUT)), rnd.integers(0, 2, n)) for n in (5, 3, 1)])
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    got = model.gradients(x, mask, y)

    def loss():
        p, _ = model.forward(x.astype(np.float64), mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    for name, w in model.w.items():
        for _ in range(4):
            at = tuple(rnd.integers(0, s) for s in w.shape)
            was = w[at]
            w[at] = was + 1e-3
            up = loss()
            w[at] = was - 1e-3
            down = loss()
            w[at] = was
            assert (up - down) / 2e-3 == pytest.approx(got[name][at], abs=2e-4)


def test_batches_do_not_matter():
    parsed = [hb.blocks_of(p) for p in pages(20)]
    model = hb.Labeller()
    rows = [hb.vectors(b) for b in parsed]
    assert all((a == b).all() for a, b in zip(model.label(rows), model.label(rows, most=1)))


def test_other_templates(spark):
    source = pages()
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, p in enumerate(source)], "page_id long, url string, html string, text string")
    model = hb.fit(df)
    page = (
        f"<body><div class='cookie notice'><p>We use cookies</p></div><div class=navbar><a>alpha</a></div><div class='content'><h1>Alpha beta.</h1>"
        f"<p>{PROSE}</p><div class='advert'><p>Buy gamma</p></div><p>{PROSE}</p></div><div class='comments'><div><p>I like zeta.</p></div></div>"
        f"<div class='sidebar'><p>delta</p></div><form class='newsletter'><p>Your eta</p></form><div class='footer'>beta</div></body>"
    )
    more = spark.createDataFrame([(1, None, page, ""), (2, "", None, ""), (3, "", "", ""), (4, "", "<p", "")], df.schema)
    got = {r.page_id: r.text for r in hb.extract(more, model).collect()}
    want = f"Alpha beta. {PROSE}{PROSE}".strip()
    assert got[1] == want and got[2] == got[3] == ""
    assert hb.extract(more.where("false"), hb.fit(df.where("false"))).count() == 0


def test_held_out_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op8_block_labeller(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    right = 0
    for r in rows:
        blocks = hb.blocks_of(r.html or "")
        want = " ".join(b.text for b, y in zip(blocks, hb.by_elements(blocks)) if y)
        right += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert len(got) == len(rows) and right >= 0.99 * len(rows)
