"""Main texts of pages: markup, character references, shared lines, and the longest common subsequence."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenprice.llm import extraction
from lumenprice.llm.extraction import lcs, main_text
from lumenprice.llm.html_blocks import blocks


@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
@settings(max_examples=300, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    pairs = lcs(a, b)
    assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Ti&amp;tle &eacute;</h1></header><p>One <b>bold</b>\n\n text<br>more &nbsp; x &lt; y<p>Two</p><ul><li>a<li>b</ul>
<form><p>Your mail</p></form><aside>Side</aside><section class="comments"><p>Nice!</p></section><!-- c --></article>
<div id="sidebar"><p>Links</p></div><footer>&copy; all</footer></body></html>"""


def test_markup(spark):
    rows = [(1, "http://h/a", PAGE), (2, None, None), (3, "x", ""), (4, "http://h/b", "plain text only"), (5, "http://h/c", "<p>un<closed"), (6, "http://h/d", "a < b &amp; c > d"), (6, "http://h/d", "a < b &amp; c > d")]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, at int")
    found = sorted((r["page_id"], r["text"]) for r in main_text(table).collect())
    assert found[0][1] == "Ti&tle é\nOne bold text more x < y\nTwo\na\nb"
    assert [f[1] for f in found[1:3]] == ["", ""] and found[3][1] == "plain text only" and found[5] == found[6] == (6, "a < b & c > d")
    assert all(r["n_chars"] == len(r["text"]) for r in main_text(table).collect())
    assert main_text(table.limit(0)).count() == 0


def test_shared_lines_go(spark):
    page = lambda i: f"<body><div>Site name</div><div>Menu one</div><div>Story {i} begins here and goes on for a while.</div><div>Second part of {i}, which is long too.</div><div>All rights</div></body>"
    rows = [(i, f"https://h.example/a/{i}", page(i)) for i in range(9)] + [(20, "https://h.example/a/0?x=1", page(0)), (30, "https://other.example/", page(30))]
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = lambda i: f"Story {i} begins here and goes on for a while.\nSecond part of {i}, which is long too."
    assert all(found[i] == want(i) for i in range(9)) and found[20] == want(0)  # the copy is compared with another page too
    assert found[30].startswith("Site name")


def brute_force(pages):
    """{page_id: text}: pages of a host by path, the nearest one on either side that shares less than half of the text, and an LCS table."""
    outlines = {i: blocks(h) for i, _, h in pages}
    seen, order = set(), []
    for i, url, _ in sorted(pages, key=lambda p: (p[1].split("/")[2], p[1].split("/", 3)[3])):
        key = (url.split("/")[2], tuple(b.text for b in outlines[i]))
        if key not in seen:
            seen.add(key)
            order.append((i, *key))
    shared = {}
    for k, (_, host, own) in enumerate(order):
        lost = shared.setdefault((host, own), set())
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(order) and order[j][1] == host:
                other = order[j][2]
                x, y = (own, other) if step > 0 else (other, own)
                found = [p[step < 0] for p in lcs(x, y)]
                if sum(len(own[p]) for p in found) < 0.5 * min(sum(map(len, own)), sum(map(len, other))):
                    lost.update(found)
                    break
                j += step
    out = {}
    for i, url, _ in pages:
        lost = shared[url.split("/")[2], tuple(b.text for b in outlines[i])]
        marked = any(b.contained and not b.outside for b in outlines[i])
        menu = [b.link_share > 0.66 for b in outlines[i]]
        gone = [n in lost and menu[n] or not b.contained if marked else n in lost or menu[n] for n, b in enumerate(outlines[i])]
        out[i] = "\n".join(b.text for n, b in enumerate(outlines[i]) if not gone[n] and not b.outside)
    return out


def test_differencing_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(extraction, "CHUNK", 16)
    rng = random.Random(4)
    pages = []
    for i in range(150):
        host = rng.choice("abc")
        story = "".join(f"<p>{' '.join(f'w{rng.randrange(10**6)}' for _ in range(12))}</p>" for _ in range(rng.randrange(2, 5)))
        body = f"<div>Site {host}</div><div>Menu of {host}</div>{story}<div>All rights {host}</div>"
        if host == "c" or host == "b" and i % 3 == 0:  # a marked article that holds lines of the template
            body = f"<nav>Menu</nav><article><p><a href='/'>Read more of {host}</a></p>{story}<p>A line of many articles</p></article>"
        pages.append((i, f"https://{host}.example/{i % 7}/{i:03d}", f"<body>{body}</body>"))
        if i % 11 == 0:
            pages += [(1000 + 3 * i + k, f"https://{host}.example/{i % 7}/{i:03d}?again={k}", f"<body>{body}</body>") for k in range(3)]
    want = brute_force(pages)
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    assert found == want
    # (on host b, between pages of the other kind, a page's own template can't be seen)
    assert not any(f"{x} {h}" in t for t in found.values() for h in "ac" for x in ("Site", "Menu of", "rights", "Read more of"))
    assert all(t.count("\n") >= 1 for t in found.values())


def test_long_and_broken_pages():
    assert blocks('<a href="' * 2000) and [b.text for b in blocks("<p>x" * 5000)] == ["x"] * 5000
    assert [b.text for b in blocks("<nav><ul><li>menu<article><p>body</article>") if b.contained and not b.outside] == ["body"]
