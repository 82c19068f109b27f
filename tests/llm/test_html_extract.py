import numpy as np
import pytest

from skarn.llm import html_extract as H

from .hand_pages import PAGES


@pytest.fixture(scope="module")
def net():
    return H.labeller()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>
<nav><ul><li><a href="/a">home</a></li><li><a href="/b">news</a></li><li><a href="/c">about</a></li></ul></nav><!-- ad 0 --><div class="ad">buy this now</div>
<article><h1>Lorem mika toler</h1><p><b>Rale   ste&amp;kau &lt;x&gt; minou<br>tole erka<p>Second para in <i>it</i>alics with thele rami and kaleto mikau.</p></article>
<div class="comments"><p>anonymous says nice post, reply</p><p>another comment posted by ka</p></div><footer>&copy; example.com all rights reserved</footer>"""


def test_main_text(net):
    got = H.main_texts(net, [PAGE, None, "", "<html><body></body></html>"])
    assert got == ["Lorem mika toler Rale ste&kau <x> minou tole erka Second para in italics with thele rami and kaleto mikau.", "", "", ""]


def test_blocks():
    blocks = list(H.blocks_of("<div class='A b'>x <b>y</b>z<p>q<p>r &nbsp; s</div>t <script>no</script> <textarea>a <b>c</textarea> u <img> v < 3 <!-- <p> --> w"))
    assert [b.text for b in blocks] == ["x yz", "q", "r s", "t", "a <b>c", "u", "v < 3 w"]
    assert blocks[0].path.all() == ("div", ".a", ".b") and blocks[2].path.all() == ("div", ".a", ".b", "p")


@pytest.mark.parametrize("page", ["<", "<p", "<!--", "<a href='", "</p></p>", "<script>", "&", "&#x;&#99999999999;", "<p>" * 2000 + "x", "x" * 100_000, "<p>a" * 3000, "<div>x" * 20_000, "<b><div>" * 20_000 + "</b>" * 20_000 + "</q>" * 20_000])
def test_broken_pages(net, page):
    assert isinstance(H.main_texts(net, [page])[0], str)


def test_nesting_costs_each_element_once(net):
    """Paths are shared; their means are those of all their tokens."""
    blocks = list(H.blocks_of("<div class='a b'>x" * 3000 + "<section>" * 10 + "<p>y"))
    table = net.p["tags"]
    for b in (blocks[0], blocks[500], blocks[-1]):
        assert b.path.mean(table) == pytest.approx(np.mean([table[H._tags[t]] for t in b.path.all()], axis=0, dtype=np.float64), abs=1e-5)
    assert blocks[-1].path.size == 3 * 3000 + 11


def test_stray_quotes_and_literal_elements():
    texts = [b.text for b in H.blocks_of("<p class=a\">one</p><p title=\"x > y\">two</p><p \"'>three</p><noscript><p>four</p></noscript><template>five</template>")]
    assert texts == ["one", "two", "three", "four", "five"]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE)], "page_id long, url string, html string")
    a, b = H.extract(df).collect()
    assert a == b


def test_held_out_pages(net):
    maker, right, total = H._Pages(seed=4242), 0, 0
    for _ in range(60):
        blocks, labels = H.training_page(maker)
        if blocks:
            chance, _ = net.forward([H._inputs(blocks)])
            right += int(((chance > 0.5) == (labels > 0)).sum())
            total += len(labels)
    assert right / total > 0.98


def test_gradients_by_differences():
    net, rng = H.Labeller(seed=1), np.random.default_rng(2)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    maker, pages, truth = H._Pages(seed=3), [], []
    for _ in range(2):
        b, y = H.training_page(maker)
        pages.append(H._inputs(b[:6]))
        truth.append(y[:6])
    truth = np.concatenate(truth)
    _, g = net.gradients(pages, truth)
    for k, v in net.p.items():
        flat, grad = v.reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            old, eps = flat[i], 1e-2
            flat[i] = old + eps
            up = net.gradients(pages, truth)[0]
            flat[i] = old - eps
            down = net.gradients(pages, truth)[0]
            flat[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(grad[i], rel=0.1, abs=2e-3)
    del rng


def test_batches_do_not_change_labels(net):
    pages = [PAGE, "<p>" + "ka to le mi ra " * 30, PAGE.replace("article", "main"), "<div>x</div>" * 300]
    assert H.main_texts(net, pages) == [H.main_texts(net, [p])[0] for p in pages]


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in H.extract(df).collect()}
    assert got[1].n_chars == len(got[1].text) > 50 and got[2].text == "" and got[None].url == "v"
    assert H.extract(df.limit(0)).collect() == []


#: Hand-written pages that the labeller doesn't get right, and the main text that it loses or adds there.
LOST = {"br paragraphs": "no element marks the text and its run is next to links"}
ADDED = {"news": "a byline", "spanish": "an advert and a footer under names in Spanish"}


def test_hand_written_pages(net):
    """Pages that no grammar made: most give exactly their text, and none but those named loses or adds a block."""
    for name, (page, want) in PAGES.items():
        blocks = list(H.blocks_of(page))
        chance, _ = net.forward([H._inputs(blocks)])
        kept = [b.text for b, c in zip(blocks, chance) if c > 0.5]
        left = [b.text for b, c in zip(blocks, chance) if c <= 0.5]
        if name not in ADDED:
            assert all(k in want for k in kept), name
        if name not in LOST:
            assert not [t for t in left if len(t.split()) > 1 and t in want], name
        if name not in LOST and name not in ADDED:
            assert H.main_texts(net, [page]) == [want], name
    assert len(LOST) + len(ADDED) <= len(PAGES) // 5


def test_forward_is_a_plain_loop(net):
    """The batched network against a loop over blocks and units, page by page."""
    pages = [list(H.blocks_of(PAGES[n][0])) for n in ("forum", "glossary", "plain")]
    batched, _ = net.forward([H._inputs(p) for p in pages])
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    u, out = H.UNITS, []

    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    for blocks in pages:
        tags, words, shapes = H._inputs(blocks)
        x = [np.concatenate([p["tags"][t].mean(axis=0), p["words"][w].mean(axis=0), s]) for t, w, s in zip(tags, words, shapes)]
        states = {}
        for side, order in (("f", range(len(x))), ("b", reversed(range(len(x))))):
            h, c = np.zeros(u), np.zeros(u)
            for t in order:
                g = x[t] @ p[f"wx{side}"] + h @ p[f"wh{side}"] + p[f"b{side}"]
                for k in range(u):
                    c[k] = sigmoid(g[u + k]) * c[k] + sigmoid(g[k]) * np.tanh(g[3 * u + k])
                h = sigmoid(g[2 * u : 3 * u]) * np.tanh(c)
                states[side, t] = h
        out += [sigmoid(np.concatenate([states["f", t], states["b", t], x[t]]) @ p["out"][:, 0] + p["bias"][0]) for t in range(len(x))]
    assert batched == pytest.approx(np.array(out), abs=1e-4)


def test_training_makes_the_weights_of_the_package(net):
    """Trained anew, the labeller labels as the one whose weights are shipped."""
    again, maker = H.train(), H._Pages(seed=77)
    pages = [b for b in (H.training_page(maker)[0] for _ in range(100)) if b]
    a, b = (m.forward([H._inputs(p) for p in pages])[0] > 0.5 for m in (again, net))
    assert (a == b).mean() > 0.99
