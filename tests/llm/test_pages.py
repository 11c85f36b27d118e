"""Main text and web archives."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lexloom.llm import html_text, warc
from lexloom.session import shared_folder

ARTICLE = "".join(f"<p>Paragraph {i}, with some words in it; and a bit more &amp; more of them.</p>" for i in range(6))
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site name</h1><p>The site's motto, which is rather long, and has punctuation.</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice"><p>We use cookies, as everybody does, on this site.</p></div><div class=sidebar><p>Also of interest, on the side: this, that.</p></div>
<main><article><h1>Head&shy;line</h1><p>Lead <b>bold
  text</b>,&nbsp;x.<br>After</p>{ARTICLE}<div class="ad">Buy, buy, buy this thing now!</div><p>Ok.</p><ul><li>one<li>two</ul>
<form><p>Name, please, and address.</p><input></form></article><section id="comments"><p>Reader: first, as always!</p></section></main><footer>&copy; us, 2024.</footer></body></html>"""


def test_article_only():
    body = [f"Paragraph {i}, with some words in it; and a bit more & more of them." for i in range(6)]
    assert html_text.main_text(PAGE).split("\n") == ["Head­line", "Lead bold text, x. After", *body, "Ok.", "one", "two"]


def test_without_article_element():
    page = f"<html><body><div id=top><a href=1>Home</a> <a href=2>About</a></div><div id=content><h2>Title</h2>{ARTICLE}</div><div class='footer'>Imprint</div></body></html>"
    assert html_text.main_text(page).split("\n")[0] == "Title" and "Imprint" not in html_text.main_text(page) and "About" not in html_text.main_text(page)


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain words", "plain words"), ("<p>a < b</p>", "a < b"), ("<p>&#65;&#x42;&copy</p>", "AB©"), ("<article><p>cut off <b>her", "cut off her"), ("</p></div><p>x", "x")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], "page_id long, url string, html string, text string, keeper string, n long")


BIG = "<p>" + "long enough " * 120
ROWS = [(1, "http://a", BIG), (2, "http://b", BIG), (3, None, BIG), (4, "http://d", "short"), (5, "http://e", "short"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (8, "u\r\nX: y", "é" * 3000), (3, "again", BIG)]


def test_main_text_rows(spark):
    got = html_text.html_text(pages(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and all(r.n_chars == len(r.text) for r in got)
    assert html_text.html_text(pages(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [[], ROWS])
def test_archive_round_trip(spark, rows):
    path = shared_folder(spark, "warc")
    warc.archive(pages(spark, rows), path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(spark, path).collect()), key=repr)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keeper = max([j for j, _, x in rows if (x or "") == (h or "") and j is not None], default=None) if len(raw) >= 1000 else None
        again = keeper is not None and (i is None or i < keeper)
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keeper if again else None))
    assert got == sorted(expected, key=repr)


def test_pushed_predicates_skip_payloads(spark):
    path = shared_folder(spark, "warc")
    warc.archive(pages(spark, ROWS), path)
    rows = spark.read.format("warc").load(path)
    only = rows.where("record_type = 'response' and record_id in ('urn:page:4', 'urn:page:8')")
    assert {r.record_id: bytes(r.payload) for r in only.collect()} == {"urn:page:4": b"short", "urn:page:8": ("é" * 3000).encode()}
    reader = warc.Reader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 5)])) == [GreaterThan(("payload_bytes",), 5)]
    assert spark.read.format("warc").option("payload", "false").load(path).where(F.col("payload").isNotNull()).count() == 0


@pytest.mark.parametrize("kind", ["plain", "gzip", "with length"])
def test_reading_foreign_archives(tmp_path, kind):
    raws = [warc.record({"record_type": t, "payload": p, "record_id": f"r{i}"}) for i, (t, p) in enumerate([("warcinfo", b"x" * 70_000), ("response", b"a\r\n\r\nWARC/1.1 b"), ("resource", b"")])]
    whole = b"".join({"plain": lambda r: r, "gzip": gzip.compress, "with length": warc.member}[kind](r) for r in raws)
    seen = []
    for head, block in warc.records(io.BytesIO(whole), kind != "plain", lambda h: h.columns()["record_type"] != "warcinfo"):
        seen.append((head.columns()["record_type"], None if block is None else warc.payload_of(head, block)))
    assert seen == [("warcinfo", None), ("response", b"a\r\n\r\nWARC/1.1 b"), ("resource", b"")]
    assert kind == "plain" or gzip.decompress(whole) == b"".join(raws)


def test_names_that_speak_of_something_else():
    page = f"<body><div class='site-header'><p>Our site, and its motto, in words.</p></div><div class='content has-sidebar'><article><div class='entry-header'><h1>Title</h1></div>{ARTICLE}</article></div></body>"
    assert html_text.main_text(page).split("\n")[0] == "Title" and len(html_text.main_text(page).split("\n")) == 7


PROSE = "".join(f"<p>Paragraph {i}, with some words in it; and a bit more of them, as one writes.</p>" for i in range(6))
FOREIGN = """layout-sidebar-right|page-with-sidebar|side-effects|legal-news|popular-science|copyright-law|row form-factor|main-wrapper social|search-engine-history|widget-area-content
    |content related-to-x|post alert-free|sidebar|comments"""


@pytest.mark.parametrize("name", [n.strip() for n in FOREIGN.split("|")])
def test_class_names_take_no_article_out(name):
    ad, notice = '<div class="ad">Buy, buy this thing now, it is good.</div>', '<div class="cookie-notice"><p>We use cookies, as everybody does, here.</p></div>'
    for inner in (f"<h1>T</h1>{PROSE}", PROSE, f"<article>{PROSE}</article>", f"<h1>T</h1>{PROSE}{ad}"):
        text = html_text.main_text(f'<html><body><nav><a>Home</a></nav>{notice}<div class="{name}">{inner}</div><footer>f</footer></body></html>')
        assert text.split("\n") == ["T"] * ("<h1>" in inner) + [p.removeprefix("<p>") for p in PROSE.split("</p>")[:-1]]


def test_parts_beside_each_other_and_a_form_around_the_page():
    long = "<p>" + "word, " * 50 + "end.</p>"
    lines = ["word, " * 50 + "end."]
    assert html_text.main_text(f"<body><div id=story>{long * 4}</div><div id=more>{long}</div><ul><li><a href=x>Home</a><li><a>More</a></ul></body>").split("\n") == lines * 5
    assert html_text.main_text(f"<body><article>{long * 4}</article><section>{long}</section><div class=comments>{long * 9}</div></body>").split("\n") == lines * 5
    assert html_text.main_text(f"<body><form id=aspnetForm><div>{long * 4}</div><input></form></body>").split("\n") == lines * 4


@pytest.mark.parametrize("part", ["<div>x", "<ul><li>x", "<tr><x>y", "<div class=ad>x", "</x><div><p>word, words", "<a hidden>x</b>"])
def test_time_follows_the_page_at_any_depth(part):
    import time

    began = time.time()
    html_text.main_text(part * 40_000)
    assert time.time() - began < 30


def test_ratios_like_plain_sums():
    """Chosen paths from whole tag paths, by the definition."""
    import math
    import random

    rng = random.Random(1)
    for _ in range(50):
        page = "".join(f"<{t}>{'word, ' * rng.randint(0, 9) + 'w' * rng.randint(1, 60)}</{t}>" if rng.random() < 0.8 else rng.choice(["<div>", "</div>", "<section>", "</section>"]) for t in rng.choices(["p", "h2", "div", "li"], k=40))
        found = html_text.blocks(page)
        keys = []
        for b in found:
            node, path = b.node, []
            while node is not None:
                path.append(node.tag)
                node = node.parent
            keys.append("/".join(path))
        of = lambda key, f: sum(f(b) for b, k in zip(found, keys, strict=True) if k == key) / keys.count(key)
        rows = [(of(k, lambda b: len(b.text)), of(k, lambda b: b.text.count(","))) for k in keys]
        weight = lambda d: math.exp(-d * d / 2) if abs(d) <= 2 else 0
        even = [[sum(weight(i - j) * r[c] for j, r in enumerate(rows)) / sum(weight(i - j) for j in range(len(rows))) for i in range(len(rows))] for c in (0, 1)]
        fused = [t * (1 + m) for t, m in zip(*even, strict=True)]
        mean = sum(fused) / len(fused)
        least = 0.5 * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
        sums = {k: sum(f for f, x in zip(fused, keys, strict=True) if x == k) for k in keys}
        expected = {k for k in keys if sums[k] / keys.count(k) >= least} | {max(sums, key=sums.get)}
        got = html_text.content_paths(found)
        assert {k for b, k in zip(found, keys, strict=True) if (b.node.path, b.lowered) in got} == expected


@pytest.mark.parametrize("kind", ["gzip", "with length"])
def test_large_payloads_take_linear_time(kind):
    import os
    import time

    big = os.urandom(64 << 20)
    raws = [warc.record({"record_type": "resource", "payload": p, "record_id": f"r{i}"}) for i, p in enumerate([b"a", big, b"b"])]
    whole = b"".join({"gzip": lambda r: gzip.compress(r, 1), "with length": warc.member}[kind](r) for r in raws)
    began = time.time()
    got = [block for _, block in warc.records(io.BytesIO(whole), True, lambda h: True)]
    assert time.time() - began < 15 and got == [b"a", big, b"b"]
    assert [block for _, block in warc.records(io.BytesIO(whole), True, lambda h: h.length < 9)] == [b"a", None, b"b"]


def test_repeated_digests_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    path = shared_folder(spark, "warc")
    warc.archive(pages(spark, ROWS), path)
    assert warc.archived(spark, path).where("record_type = 'revisit'").count() == 3
