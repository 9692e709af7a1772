import random

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import html


def text_of(page):
    return html.main_texts([html.blocks(page)], [None])[0][0]


def test_blocks_and_decoding():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- x <p>no</p> -->
    <main><article><header><h1>A &amp;  title&nbsp;here</h1></header><p><b>One<br>two <i>th</i>ree &lt;x&gt;<p class="ad">buy</p>
    <p>Four
    &copy; &#x41;&#66;</p><form><p>mail</p><input></form><aside>side</aside><ul><li>a<li>b</ul><script>var a="</p>";</script>
    <section id="comments"><p>first!</p></section></article></main><footer>&copy; us</footer></body></html>"""
    assert text_of(page) == "A & title here\n\nOne two three <x>\n\nFour © AB\n\na\n\nb"


def test_odd_markup():
    assert text_of(None) == text_of("") == text_of("<p></p>") == ""
    assert text_of("a < b <p>c &am") == "a < b\n\nc &am"
    assert text_of("<article><p>cut <a hre") == "cut"
    assert text_of("<article>x<script>never closed <p>y") == "x"
    assert text_of("<article><p title='a > b' class=\"x\">q</p><p title=\"open>r") in ("q", "q\n\nr")
    assert len(text_of("<article>" + "<p>word " * 50_000)) == 50_000 * 4 + 49_999 * 2


def test_suffix_array():
    rnd = np.random.default_rng(1)
    tokens = rnd.integers(0, 4, 300)
    order, shared = html.suffix_array(tokens, 8)
    s = tokens.tolist()
    assert [s[i : i + 8] for i in order] == sorted(s[i : i + 8] for i in range(300))
    for k in range(299):
        a, b = s[order[k] :], s[order[k + 1] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        assert shared[k] == min(n, 15)


def test_repeats_of_a_host_go(spark):
    rnd = random.Random(2)
    sentence = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    banner, foot, copied = sentence(8), sentence(9), sentence(40)
    rows, want = [], {}
    for i in range(60):
        body = [sentence(rnd.randrange(1, 40)) for _ in range(3)] + ([copied] if i in (7, 8, 9, 10) else [])
        if i % 2:
            page = f"<div>{banner}</div><article>" + "".join(f"<p>{b}</p>" for b in body) + f"</article><p>{foot}</p>"
        else:
            page = f"<div>{banner}</div><div>" + "<br>".join(body[:1]) + "".join(f"<p>{b}" for b in body[1:3]) + f"</div><p>{foot}</p>"
            body = body[:3]
        rows.append((i, f"https://Host.example:80/{i}", page))
        want[i] = "\n\n".join(body)
    rows += [(100, None, "<p>lone</p>"), (101, "https://host.example/z", None), (5, rows[5][1], rows[5][2]), (None, "nonsense", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[i] == want[i] for i in want)
    assert texts[100] == "lone" and texts[101] == "" and texts[None] == "x"
    assert html.extract(pages.limit(0)).count() == 0


def test_repeats_decide_in_and_beside_an_article():
    rnd = random.Random(4)
    sentence = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    foot, offer, quoted = sentence(9), sentence(12), sentence(30)
    pages, want = [], []
    for i in range(40):
        lead, body = sentence(15), sentence(25)
        inside = [body, quoted] if i in (3, 8, 9, 20) else [body]
        pages.append(f"<p>{lead}</p><article>" + "".join(f"<p>{x}</p>" for x in inside) + (f"<p>{offer}</p>" if i % 4 else "") + f"</article><p>{foot}</p>")
        want.append("\n\n".join([lead, *inside]))
    got = html.main_texts([html.blocks(p) for p in pages], [None] * 40)
    assert [t for t, *_ in got] == want
    assert all(markup == 0 and repeats == (2 if i % 4 else 1) for i, (_, _, markup, repeats) in enumerate(got))


def plain(pages):
    """Main texts of one host's pages without articles: blocks that are mostly made of runs found on three contents go."""
    runs = {}
    streams = [[w for r, t in p if r == html.PLAIN for w in t.split()] for p in pages]
    for page, words in zip(pages, streams, strict=True):
        for k in range(len(words) - html.MIN_TOKENS + 1):
            runs.setdefault(tuple(words[k : k + html.MIN_TOKENS]), set()).add(tuple((r, t if r != html.BOILERPLATE else "") for r, t in page))
    out = []
    for page, words in zip(pages, streams, strict=True):
        covered = [False] * len(words)
        for k in range(len(words) - html.MIN_TOKENS + 1):
            if len(runs[tuple(words[k : k + html.MIN_TOKENS])]) >= html.MIN_PAGES:
                covered[k : k + html.MIN_TOKENS] = [True] * html.MIN_TOKENS
        kept, at = [], 0
        for role, text in page:
            if role == html.PLAIN:
                n = len(text.split())
                if sum(covered[at : at + n]) < html.COVERED * n:
                    kept.append(text)
                at += n
        out.append("\n\n".join(kept))
    return out


def test_a_large_host_is_like_one_array(spark, monkeypatch):
    """Pages without an article, and a notice that stands on few of them: each array alone would see it once."""
    rnd = random.Random(6)
    sentence = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    notice, menu, foot = sentence(8), sentence(6), sentence(7)
    rows = []
    for i in range(200):
        parts = [menu, sentence(12), *([notice] if i % 40 == 3 else []), sentence(20) + (" " + foot if i % 9 == 0 else ""), foot]
        rows.append((i, f"https://big.example/{i}", "<nav>x y z</nav>" + "".join(f"<div>{p}</div>" for p in parts)))
    rows += [(300 + i, "https://big.example/copy", rows[5][2]) for i in range(60)] + [(5, rows[5][1], rows[5][2])] * 5
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    texts = lambda: sorted((r["page_id"], r["text"], r["n_blocks_by_repeats"]) for r in html.extract(pages).collect())
    whole = []
    for size in (100_000, 7):
        monkeypatch.setattr(html, "ARRAY_PAGES", size)
        whole.append(texts())
    assert whole[0] == whole[1]
    want = plain([html.blocks(h) for _, _, h in rows])
    assert [t for _, t, _ in whole[1]] == [t for _, t in sorted(zip([d for d, _, _ in rows], want, strict=True))]
    assert not any(notice in t or menu in t for t in want)
    monkeypatch.setattr(html, "MIN_PAGES", 10**6)  # without repeats the text is another
    assert sum(notice in t for _, t, _ in texts()) == 5
