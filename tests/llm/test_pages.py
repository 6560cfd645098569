"""Operators on web pages and conversations against brute force."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mensura.llm import chat, html_text, warc

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PAGES = "page_id long, url string, html string, payload string, copy int"


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n</p>" * 3000
    pages = [(5, "http://a/x y", "same"), (3, "http://b/", "same"), (9, None, "same"), (4, "http://c/", None), (6, "http://c/", ""), (7, "u", long), (8, "v", "ü"), (None, "n", "same"), (None, "n", "alone")]
    pages += [(3, "http://a/", "same"), (3, "http://b/", "same")]
    rows = [(i, u, h, "x", 0) for i, u, h in pages]
    frame = spark.createDataFrame(rows, PAGES).repartition(3)
    folder = str(tmp_path / "archives")
    warc.write_archives(frame, folder, file_bytes=500)
    read = warc.read_archives(spark, folder)
    assert sorted(r.payload.decode() for r in read.collect() if r.record_type == "response") == sorted({h or "" for _, _, h in pages})
    got = warc.resolved_records(read).collect()
    assert len(got) == len(pages) and all(r.intact for r in got)
    groups = {}
    for i, _, h in pages:
        groups.setdefault(h or "", []).append(i)
    want = []
    for h, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want += [(str(i), len(h.encode()), digest, "revisit" if k else "response", str(ids[0] if k else None)) for k, i in enumerate(ids)]
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)


def test_warc_least_bytes_and_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abc", "", 0), (4, "u", "abc", "", 0)], PAGES)
    responses, revisits = warc.resolve_revisits(frame, least_bytes=3)
    assert sorted(r.page_id for r in responses.collect()) == [1, 2, 3]
    assert [(r.page_id, r.refers_to) for r in revisits.collect()] == [(4, 3)]
    warc.write_archives(frame.limit(0), str(tmp_path / "none"))
    assert warc.resolved_records(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_warc_files(spark, tmp_path):
    """A gzip member a record, warcinfo first, dates in UTC, files of bounded size."""
    import datetime
    import zlib

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.createDataFrame([(k, f"http://h/{k}", "text é " * 50 * (k % 7 + 1), "", 0) for k in range(60)], PAGES).repartition(2)
        warc.write_archives(frame, str(tmp_path / "a"), file_bytes=2000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    seen, files = [], sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 2
    for file in files:
        data, members = file.read_bytes(), []
        assert len(data) < 4000
        while data:
            member = zlib.decompressobj(31)
            members.append(member.decompress(data))
            assert member.eof
            data = member.unused_data
        members = [m for m in members if m]
        assert b"WARC-Type: warcinfo" in members[0]
        for m in members[1:]:
            head, _, rest = m.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
            when = datetime.datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.UTC)
            assert abs((datetime.datetime.now(datetime.UTC) - when).total_seconds()) < 600
            seen.append(fields)
    assert len(seen) == 60
    named = {f["WARC-Record-ID"]: f for f in seen}
    for f in seen:
        if f["WARC-Type"] == "revisit":
            first = named[f["WARC-Refers-To"]]
            assert f["WARC-Refers-To-Target-URI"] == first["WARC-Target-URI"] and f["WARC-Refers-To-Date"] == first["WARC-Date"]
            assert f["WARC-Payload-Digest"] == first["WARC-Payload-Digest"] and first["WARC-Type"] == "response"
    assert sum(f["WARC-Type"] == "response" for f in seen) == 7


def test_warc_hot_payload_without_broadcast(spark, tmp_path, monkeypatch):
    from mensura.operators import joins

    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    frame = spark.createDataFrame([(k, f"u{k}", "hot" if k % 3 else f"p{k // 6}", "", 0) for k in range(60)], PAGES)
    warc.write_archives(frame, str(tmp_path / "a"))
    got = {r.page_id: (r.record_type, r.refers_to, r.intact) for r in warc.resolved_records(warc.read_archives(spark, str(tmp_path / "a"))).collect()}
    for k in range(60):
        first = 1 if k % 3 else k // 6 * 6
        assert got[k] == (("response", None, True) if k == first else ("revisit", first, True))


def test_escape_is_reversible():
    rng = random.Random(0)
    parts = ["\\", "<|", "<", "|", "</s>", "<s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "\\\\", "a", "\n", " "]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        said = chat.escape(text)
        assert chat.unescape(said) == text
        assert not any(c in said for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


@pytest.mark.parametrize("part_chars", [40, 1 << 20])
def test_chat_round_trip(spark, part_chars):
    rng = random.Random(1)
    parts = ["hello", " ", "\\", "<|end|>", "[INST]", "</s>", "é", "漢", "\n", "\U0001f600", "<", "|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randrange(20)))])) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same"), (98, 0, "<|text|>", "x")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat.format_conversations(frame, TOKENIZER, part_chars=part_chars)
    got = {r.conv_id: r for r in chat.read_back(formatted, TOKENIZER).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(frame.limit(0), TOKENIZER).count() == 0


def test_chat_tokens_do_not_depend_on_parts(spark, monkeypatch):
    """Tokens and masks of a conversation are the same in one part, in many, and by the other library."""
    import re

    from tokenizers import Tokenizer

    rng = random.Random(3)
    said = ["hello there", "  two", "é漢\U0001f600", "don't\n\n", "x" * 50, "", " \\ <|end|>", "12 345"]
    rows = [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice(said) for _ in range(4))) for c in range(4) for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)

    def tokens(part_chars):
        found = {}
        for r in sorted(chat.format_conversations(frame, TOKENIZER, part_chars=part_chars).collect(), key=lambda r: (r.conv_id, r.part)):
            text, ids, mask = found.setdefault(r.conv_id, ([], [], []))
            text.append(r.formatted)
            ids += r.token_ids
            mask += r.loss_mask
        return found

    whole = tokens(1 << 20)
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for part_chars in (1 << 20, 300, 1):
        if part_chars < 1 << 20:
            monkeypatch.setattr(chat, "TURNS_TOGETHER", 8)
        split = tokens(part_chars)
        assert {c: ("".join(t), i, m) for c, (t, i, m) in split.items()} == {c: ("".join(t), i, m) for c, (t, i, m) in whole.items()}
        assert part_chars == 1 << 20 or all(len(t) > 4 for t, _, _ in split.values())
    for texts, ids, mask in whole.values():
        special = [chat.TURN, chat.TEXT, chat.END]
        want = []
        for part in filter(None, re.split(r"(<\|(?:turn|text|end)\|>)", "".join(texts))):
            want += [50256 + special.index(part)] if part in special else other.encode(part, add_special_tokens=False).ids
        assert ids == want and len(mask) == len(ids)


def test_loss_mask_by_offsets():
    import numpy as np

    offsets = np.array([[0, 3], [3, 5], [5, 5], [5, 9], [9, 10], [10, 12]])
    assert chat.loss_mask(offsets, np.array([[3, 9], [10, 12]])).tolist() == [False, True, False, True, False, True]
    assert chat.loss_mask(offsets, np.empty((0, 2), int)).tolist() == [False] * 6


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header>Site <b>name</b></header><nav><ul><li><a href="/x">menu {n}</a><li>more</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<div class="ad top">buy {n}</div><{tag}><h1>Title&nbsp;{n}</h1><p><b>Lead &amp; {n}<br><p>First   par{n}
 &lt;tag&gt; &#233;<form><input>name</form><aside>side {n}</aside></p><p>Second<p>{body}<section class="comments"><p>reader {n}</p></section></{tag}><footer>&copy; {n}</footer></body></html>"""


def page(n, tag="article", body="third"):
    return PAGE.format(n=n, tag=tag, body=body)


def text(n, body="third"):
    return f"Title {n}\nLead & {n}\nFirst par{n} <tag> é\nSecond\n{body}"


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_html_text(spark, broadcast_bytes):
    pages = [(k, f"http://a.example/{k}", page(k), "x", 0) for k in range(8)] + [(20, "http://a.example/again", page(3), "x", 0)] * 2
    # a host whose content element has no telling name
    pages += [(100 + k, f"https://u@B.example:80/{k}", page(k, "div", f"body {k} " * 20), "x", 0) for k in range(6)]
    pages += [(200, None, None, "x", 0), (201, "", "", "x", 0), (None, "::bad", "<article>plain", "x", 0), (202, "http://c/", "a < b & c", "x", 0)]
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(pages, PAGES), broadcast_bytes=broadcast_bytes).collect()]
    assert all(n == len(t) for _, t, n in got) and len(got) == len(pages)
    by_id = {i: t for i, t, _ in got}
    for k in range(8):
        assert by_id[k] == text(k)
    assert by_id[20] == text(3) and by_id[200] == by_id[201] == "" and by_id[None] == "plain"
    for k in range(6):
        assert by_id[100 + k] == text(k, f"{f'body {k} ' * 20}".strip())
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_simple_tree_match():
    a = ("div", (("h1", ()), ("p", ()), ("ul", (("li", ()),))))
    b = ("div", (("p", ()), ("img", ()), ("ul", (("li", ()), ("p", ())))))
    size, pairs = html_text.simple_tree_match(a, b)
    assert pairs == {"/div": "/div", "/div/p": "/div/p", "/div/ul": "/div/ul", "/div/ul/li": "/div/ul/li"}
    assert html_text.decoded(html_text.encoded(a)) == a


def test_deep_and_broken_pages():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_text.page_text(f"<article>{deep}<p>y</article>", None, None) == "x\ny"
    assert html_text.page_text("<article><p title='a>b'>one</b></i><p>two<script>", None, None) == "one\ntwo"


def texts_of_host(spark, pages):
    rows = [(k, f"http://h.example/{k}", html, "x", 0) for k, html in enumerate(pages)]
    return [r.text for r in sorted(html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r.page_id)]


def test_content_in_sibling_containers(spark):
    top = '<div class="top">My site</div>'
    pages = [f'<body>{top}<div class="wide"><div class="intro"><p>Intro {k} {"a" * 30}</p></div><h2>More</h2><div class="text"><p>Text {k} {"b" * 70}</p></div></div></body>' for k in range(5)]
    assert texts_of_host(spark, pages) == [f'Intro {k} {"a" * 30}\nMore\nText {k} {"b" * 70}' for k in range(5)]
    # without a common container the template beside them goes
    pages = [f'<body>{top}<div class="intro"><p>Intro {k}</p></div><div class="text"><p>Text {k} long</p></div></body>' for k in range(5)]
    assert texts_of_host(spark, pages) == [f"Intro {k}\nText {k} long" for k in range(5)]


def test_every_article_outside_skipped_parts():
    def text(page):
        return html_text.page_text(page, None, None)

    assert text('<article class="a">one</article><article class="b">two</article><article class="a">three</article>') == "one\ntwo\nthree"
    assert text("<main><h1>Title</h1><article>text</article></main>") == "Title\ntext"
    assert text("<main>text</main><aside><article>teaser</article></aside>") == "text"
    assert text("<div><p>text</p></div><nav><article>teaser</article></nav>") == "text"


def test_articles_that_the_exemplar_lacks(spark):
    pages = [f'<article class="a">one {k}</article>' for k in range(4)] + ['<article class="a">one</article><article class="b">two</article>']
    assert texts_of_host(spark, pages)[4] == "one\ntwo"


def test_words_of_headings_and_sections_are_no_marks():
    page = """<article><header><h1>Title</h1></header><section id="legal-framework"><h2 id="search-methods" class="search">Methods</h2><p>one</section>
<div class="related-work">two</div><div class="section-header">three</div><div id="form">four</div><div class="legal">five</div>
<div class="ad">buy</div><div class="comments">reader</div><section class="comments">more</section></article>"""
    assert html_text.page_text(page, None, None) == "Title\nMethods\none\ntwo\nthree\nfour\nfive"
    # outside articles the same words tell
    assert html_text.page_text('<header>Site</header><p>text</p><div class="related">links</div>', None, None) == "text"


def test_perhaps_marked_parts_by_alignment(spark):
    pages = [f'<article><header>My site</header><div class="banner">Read us</div><div class="legal">Case {k}</div><p>text {k}</p></article>' for k in range(4)]
    pages.append('<article><header>My site<p>Own words</p></header><p>text 4</p></article>')
    assert texts_of_host(spark, pages) == [f"Case {k}\ntext {k}" for k in range(4)] + ["My site\nOwn words\ntext 4"]
    # copies of one page tell nothing
    page = '<article><div class="legal">Case</div><p>text</p></article>'
    assert texts_of_host(spark, [page] * 3) == ["Case\ntext"] * 3


def test_words_in_values_of_other_attributes_and_in_ids_take_nothing_out():
    said = {
        '<h1 class="article-header">a</h1>': "a",
        '<section class="related-work"><p>b</p></section>': "b",
        '<p class="share-price">c</p>': "c",
        '<p id="search-algorithms">d</p>': "d",
        '<p title="the hidden truth">e</p>': "e",
        '<p data-hidden="false">f</p>': "f",
        '<p data-id="comment-7">g</p>': "g",
        '<p class="a>h</p>': "h",
        "<p title='x > y' hidden>no</p><p>i</p>": "i",
        "<p>1 < 2 <3 <é</p>": "1 < 2 <3 <é",
        "<p>j<!-- <p>no --> k<!no><?no?></p>": "j k",
        "<p>l</p><!-- to the end": "l",
        "<p>m</p><p no": "m\n<p no",
    }
    for html, text in said.items():
        assert html_text.page_text(f"<article>{html}", None, None) == text, html


def test_broken_pages_are_read_in_linear_time():
    import time

    begin = time.time()
    for part in ('<a title="x ', "<a ", "<", "<a title='\"' ", '<p class="a>t</p>', "<!-", "</", "<p>"):
        html_text.page_text("<article><p>start</p>" + part * (1_000_000 // len(part)), None, None)
    wide = "".join(f'<div class="k{chr(97 + k // 26)}{chr(97 + k % 26)}">t {k}</div>' for k in range(300))
    tree = html_text.outline([html_text.parse(wide)])
    assert html_text.simple_tree_match(tree, tree)[0] == 301 + 300 + 0 * len(wide)  # each child counts once more for its marks
    assert time.time() - begin < 60


def invented_host(rng, number):
    """Pages of a host with a layout and class names of its own, and their content."""
    name = lambda: "".join(rng.choice("bcdfghjklm") for _ in range(7))
    names = [name() for _ in range(12)]
    some = lambda n: " ".join(name() for _ in range(n))
    article = rng.choice(["article", "main", "div", "section"])
    top, bottom, inside = some(6), some(9), some(5)
    made = []
    for _ in range(rng.randrange(4, 9)):
        blocks = [some(rng.randrange(3, 12)) for _ in range(rng.randrange(2, 6))]
        parts = [f"<{tag} class={names[0]}>{b}</{tag}>" for b in blocks for tag in [rng.choice(["p", "p", "h2", "blockquote"])]]
        parts.insert(rng.randrange(len(parts) + 1), f'<div class="{names[1]}"><span>{inside}</span></div>')  # the host's, among the content
        page = f'<body><div class="{names[2]}"><ul><li>{top}</ul></div><div class="{names[3]}"><{article} class="{names[4]}">{"".join(parts)}</{article}></div><div class="{names[5]}">{bottom}</div></body>'
        made.append((f"http://h{number}.example/{len(made)}", page, "\n".join(blocks)))
    return made + [made[0], made[0]]  # copies too


def test_wrappers_find_the_content_of_invented_hosts(spark):
    rng = random.Random(21)
    every = [p for number in range(12) for p in invented_host(rng, number)]
    frame = spark.createDataFrame([(k, url, html, "x", 0) for k, (url, html, _) in enumerate(every)], PAGES).repartition(5)
    got = {r.page_id: r.text for r in html_text.extract_text(frame).collect()}
    assert got == {k: text for k, (_, _, text) in enumerate(every)}
    # by themselves pages can't tell what is their host's
    alone = [html_text.page_text(html, None, None) for _, html, _ in every]
    assert all(a != text for a, (_, _, text) in zip(alone, every))


def test_what_copies_share_is_no_template(spark):
    """A container that only copies of one article have stays, and so does the text of a host all of whose pages are copies."""
    copy = '<body><article><p>Same text</p><div class="q">a quotation</div></article></body>'
    other = [f"<body><article><p>Text {k} of its own</p></article></body>" for k in range(3)]
    assert texts_of_host(spark, [copy] * 6 + other) == ["Same text\na quotation"] * 6 + [f"Text {k} of its own" for k in range(3)]
    assert texts_of_host(spark, [copy] * 4) == ["Same text\na quotation"] * 4


def test_constant_articles_are_no_content(spark):
    teaser = '<div><article class="zz"><p>Read our book</p></article></div>'
    pages = [f'<body>{teaser}<div class="w"><article><p>Text {k}</p></article></div></body>' for k in range(5)]
    assert texts_of_host(spark, pages) == [f"Text {k}" for k in range(5)]


def test_empty_and_null_pages(spark):
    frame = spark.createDataFrame([(1, None, None, None, None), (None, None, None, None, None), (2, "http://a/", " ", None, None)], PAGES)
    assert sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(frame).collect()), key=str) == [(1, "", 0), (2, "", 0), (None, "", 0)]


@pytest.mark.parametrize(
    "said",
    [
        '<div id="comments"><h3>Comments</h3><p>reader {k} says hi {k}</p></div>',
        '<ol class="commentlist"><li>reader {k}</li></ol>',
        '<div class="user-comments"><p>reader {k}</p></div>',
        '<div class="reader_comments wide"><p>reader {k}</p></div>',
        '<ul id="comment-list"><li><p>reader {k}</p></ul>',
        '<div class="advert-box">buy {k}</div>',
        "<label>search {k}</label>",
    ],
)
def test_readers_comments_go_wherever_they_stand(spark, said):
    def page(k, inside):
        text = f"<h1 id='comments'>Title {k}</h1><p>About comments, text {k}.</p>"
        extra = said.format(k=k)
        return f"<html><body><nav>menu</nav><article>{text}{extra if inside else ''}</article>{'' if inside else extra}</body></html>"

    for inside in (True, False):
        rows = [(k, f"http://host.example/{k}", page(k, inside)) for k in range(6)]
        got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {k: f"Title {k}\nAbout comments, text {k}." for k in range(6)}
