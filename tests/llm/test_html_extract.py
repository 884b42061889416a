import re
from html import unescape

from pyspark.sql import types as T

from tidemark.llm import html_extract as H

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("path", T.StringType())])


def page(i, n=3, body="article", tail=True):
    ps = "".join(f"<p>Text {i} number {k} &amp; <b>bold</b>\n more</p>" for k in range(n))
    lis = "".join(f'<li><a href="/{k}">Go {k}</a></li>' for k in range(2 + i % 3))
    ad = '<div class="ad">Buy now</div>' if i % 2 else ""
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><script>var a='</p>';</script></head><body><nav><ul>{lis}</ul></nav>{ad}"
        f"<{body}><h1>Head {i}</h1>{ps}<form><input value=x>Sign up</form><aside>See also</aside></{body}>"
        f'<div id="comments"><p>I like it</p></div><footer>&copy; x</footer>' + ("</body></html>" if tail else "")
    )


def want(i, n=3):
    return "\n\n".join([f"Head {i}", *(f"Text {i} number {k} & bold more" for k in range(n))])


def test_wrapper_generalises():
    pages = [page(i, n=1 + i % 4) for i in range(6)]
    have = H.wrapper(H.stream(H.parse(pages[0])))
    for x in pages[1:]:
        have = H.align(have, H.stream(H.parse(x)))
    kinds = set()

    def walk(parts):
        for p in parts:
            kinds.add(p.kind)
            walk(p.parts)

    walk(have)
    assert {"+", "?", "t"} <= kinds
    assert H.infer(pages)[0] == ("html:0:1", "body:0:1", "article:0:1")
    for x in pages:  # the wrapper reads each page that it was made from
        assert H._read(have, H.stream(H.parse(x)), 0) == len(H.stream(H.parse(x)))


def test_cases(spark):
    rows = [(i, f"http://H.example/{i}", page(i)) for i in range(20)]
    rows += [(30, "http://h.example/x", page(30, tail=False)), (31, None, page(31)), (32, "http://other/", page(32, body="main")), (33, "http://h.example/", None), (34, "http://h.example/", "")]
    rows += [(35, "http://z/", "plain &lt;text&gt;"), (5, "http://h.example/dup", page(5, n=1)), (None, "http://h.example/n", page(7)), (36, "http://h.example/long", page(36, n=9000))]
    rows += [(37, "http://cut/", "<article><p>one<p>two &am"), (38, "http://br/", "<article><p><b>A.<br><p>B<br>C</article>"), (39, "http://lt/", "<article>1 < 2 &nbsp; x</article>")]
    got = {}
    for x in H.extract(spark.createDataFrame([(*r, "") for r in rows], PAGES)).collect():
        got.setdefault((x["page_id"], x["url"]), x)
        assert x["n_chars"] == len(x["text"])
    assert len(got) == len(rows)
    text = {k[0]: v["text"] for k, v in got.items()}
    assert all(text[i] == want(i) for i in range(20) if i != 5)
    assert text[30] == want(30) and text[31] == want(31) and text[32] == want(32)
    assert text[33] == text[34] == "" and text[35] == "plain <text>"
    assert got[5, "http://H.example/5"]["text"] == want(5) and got[5, "http://h.example/dup"]["text"] == want(5, 1)
    assert text[None] == want(7) and text[36] == want(36, 9000)
    assert text[37] == "one\n\ntwo &am" and text[38] == "A.\n\nB C" and text[39] == "1 < 2 x"


def test_equals_a_plain_reading(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {x["page_id"]: x["text"] for x in H.extract(rows).collect()}
    for x in rows.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", x["html"], re.S)
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0].startswith("<br") else "", y))).strip() for y in re.split(r"</?(?:h1|p)>", m[1])]
        assert got[x["page_id"]] == "\n\n".join(p for p in parts if p)


def div_page(i, sections=3):
    parts = "".join(f'<section class="s{"abc"[k % 3]}"><h2>Part {i} {k}</h2><p>Body {i} of {k}, {"long " * (9 * k)}end</p></section>' for k in range(sections))
    return f'<html><body><div class="top"><p>Site name</p></div><div class="post"><p>Subscribe to our letter</p>{parts}<p>All rights reserved</p></div><div class="footer">About {i}</div></body></html>'


def div_want(i, sections=3):
    return "\n\n".join(t for k in range(sections) for t in (f"Part {i} {k}", f"Body {i} of {k}, {'long ' * (9 * k)}end"))


def test_host_of_divs_keeps_all_sections_and_no_template(spark):
    pages = [(i, f"http://divs/{i}", div_page(i, 2 + i % 3)) for i in range(12)]
    one = '<section><p>only {0} here</p></section><section><p>and a much longer second {0} section</p></section>'
    pages += [(100 + i, f"http://same/{i}", f'<body><div class=post>{one.format(i)}</div><div>Imprint</div></body>') for i in range(4)]
    pages += [(200 + i, f"http://articles/{i}", f"<body><article><p>Share this page</p><h1>Head {i}</h1><p>Text number {i}, a line</p></article></body>") for i in range(5)]
    pages += [(300 + i, "http://copies/", f"<body><article><p>A long paragraph that all copies have</p><p>{i}</p></article></body>") for i in range(4)]
    got = {x["page_id"]: x["text"] for x in H.extract(spark.createDataFrame([(*p, "") for p in pages], PAGES)).collect()}
    assert {i: got[i] for i in range(12)} == {i: div_want(i, 2 + i % 3) for i in range(12)}
    assert all(got[100 + i] == f"only {i} here\n\nand a much longer second {i} section" for i in range(4))
    assert all(got[200 + i] == f"Head {i}\n\nText number {i}, a line" for i in range(5))
    assert all(got[300 + i] == f"A long paragraph that all copies have\n\n{i}" for i in range(4))


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


def bare_page(i, n=4):
    """No article or main, no names at all: links, an offer on some pages, remarks and an imprint with data around the text."""
    text = "".join(f"<p>Sentence {k} of page {i}, {'which goes on and on ' * (2 + (i + k) % 3)}to its end.</p>" for k in range(n))
    links = "".join(f"<div><a href='/{k}'>Other page {i + k}</a></div>" for k in range(5))
    offer = f"<div><span>Offer {i} of the day</span></div>" if i % 3 else ""
    return f"<html><body><div><a href='/'>Home</a>{links}</div>{offer}<div><div><h1>Title {i}</h1><div>{text}<div><i>Printed on paper</i></div></div></div><div><p>Page {i} was seen often</p></div></div><div>Imprint {i}</div></body></html>"


def bare_want(i, n=4):
    return "\n\n".join([f"Title {i}", *(f"Sentence {k} of page {i}, {'which goes on and on ' * (2 + (i + k) % 3)}to its end." for k in range(n))])


def test_the_wrapper_alone_finds_the_text():
    for named in (False, True):
        pages = [bare_page(i, 3 + i % 3) for i in range(9)]
        if named:  # names that tell nothing
            pages = [x.replace("<body><div>", "<body><div class='x1'>").replace("</h1><div>", "</h1><div class='x2'>") for x in pages]
        path, same = H.infer(pages)
        assert H.text_of(pages[0], path) != H.text_of(pages[0], path, frozenset(same))
        got = [H.text_of(x, path, frozenset(same)) for x in pages]
        assert got == [bare_want(i, 3 + i % 3) for i in range(9)]
        assert all(H.text_of(x, None) != y for x, y in zip(pages, got))  # without wrapper: more or less than the text


def test_names_of_elements_do_not_delete_a_text(spark):
    rows = []
    for k, (body, inner) in enumerate([('<body class="right-sidebar">', "<article>{}</article>"), ("<body>", '<article class="post share-price">{}</article>'), ("<body>", '<article><div class="notice-period">{}</div></article>'), ("<body>", '<main class="share">{}</main>'), ("<body>", '<div class="sidebar content">{}</div>')]):
        rows += [(10 * k + i, f"http://names{k}/{i}", f"{body}<nav>Go {i}</nav>{inner.format(f'<p>Hello world {i}</p><p>and more of it {i}</p>')}</body>", "") for i in range(4)]
        rows.append((1000 + k, f"http://alone{k}/", f"{body}{inner.format('<p>Hello world</p>')}</body>", ""))
    got = {x["page_id"]: x["text"] for x in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(5):
        assert all(got[10 * k + i] == f"Hello world {i}\n\nand more of it {i}" for i in range(4))
        assert got[1000 + k] == "Hello world"


def test_long_sample_pages_are_aligned_whole():
    pages = [f"<body><div class=a>{''.join(f'<p>{i} line {k}</p>' for k in range(6000 + i))}<section><p>late {i}</p><p>Always the same</p></section></div><div>foot</div></body>" for i in range(4)]
    path, same = H.infer(pages)
    text = H.text_of(pages[3], path, frozenset(same))
    assert text.endswith("3 line 6002\n\nlate 3") and "Always" not in text
