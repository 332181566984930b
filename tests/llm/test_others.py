"""The operators on pages, vectors and conversations, and the pipeline."""

import gzip
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm import bit_sliced, role_repair, warc, wrapper

SF = "/root/testdata/sf0.001"

# op1


def page(menu, body, notice="", comments=""):
    return f'<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><div><a href="/">{menu}</a></div>{notice}<div class="text">{body}</div>{comments}<footer>f</footer></body></html>'


def test_wrapper_drops_what_stays_the_same(spark):
    notice = '<div class="box"><span>We store data on you.</span></div>'
    rows = [(i, f"http://h.example/{i}", page("Home", f"<h1>Title {i}</h1><p>Text number {i} is here, {i * 7}<p>Second &amp; last {i}", notice)) for i in range(12)]
    rows += [(50, "http://h.example/50", None), (51, None, "<p>Only<br>text &nbsp; &lt;x&gt;"), (None, "http://other.example/", "no tags"), (52, "nonsense", ""), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("old"), "mark": F.lit("m"), "turn": F.lit(0)})
    out = wrapper.main_text(df)
    got = out.collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got) and {"host", "mark", "turn"} <= set(out.columns)
    assert all(texts[i] == f"Title {i}\n\nText number {i} is here, {i * 7}\n\nSecond & last {i}" for i in range(12))
    assert texts[50] == "" and texts[51] == "Only text <x>" and texts[None] == "no tags" and texts[52] == ""
    assert wrapper.main_text(df.where("false")).count() == 0


def test_known_names_are_left_out():
    html = '<body><header>H</header><nav>N</nav><div class="cookie-notice">C</div><main><article><header><h1>T</h1></header><p>One<p>Two <b>b</b>old<ul><li>a<li>b</ul><form>F</form><div class="ad">no</div><!-- x > y --></article><section id="comments"><p>R</section></main><aside>S</aside></body>'
    assert wrapper.extract(html) == "T\n\nOne\n\nTwo bold\n\na\n\nb"
    assert wrapper.extract('<p>a<ol class="commentlist"><li>c</ol><div id=leftsidebar>s</div><div class="post-title header">t</div>') == "a\n\nt"
    assert wrapper.extract("<article><p>cut off <b>here &am") == "cut off here &am"
    assert wrapper.extract("<p>x" * 3000).count("x") == 3000


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_template_is_found_inside_the_article_too(tag):
    def page(i):
        body = f"<h1>Title {i}</h1><p>Text number {i} is here and is as long as texts are, {i * 7}<p>By the staff of this site<p>Last of {i}"
        return f'<body><{tag}>{body}<div class="x7"><span>Send to a friend</span></div><ul><li><a href="/{i}">Item {i}</a><li><a href="/t">Top</a></ul></{tag}><p>Copyright</body>'

    pages = [page(i) for i in range(6)]
    got = [wrapper.extract(p, wrapper.induce(pages)) for p in pages]
    for i, text in enumerate(got):
        parts = text.split("\n\n")
        assert parts[0] == f"Title {i}" and f"Last of {i}" in parts and "Send to a friend" not in parts and "Top" not in parts and f"Item {i}" not in parts
        assert tag == "div" or "By the staff of this site" not in parts


def test_near_copies_keep_their_bodies():
    same = "".join(f"<p>Paragraph {n} that all of these copies share</p>" for n in range(9))
    pages = [f"<article><h1>Copy {i}</h1>{same}</article>" for i in range(6)]
    assert all(wrapper.extract(p, wrapper.induce(pages)) == wrapper.extract(p) for p in pages)


def plain_matching(a, b):
    """Simple tree matching by its recurrence, on ordered lists of (label, children) trees."""
    if not a or not b:
        return 0
    both = 1 + plain_matching(a[-1][1], b[-1][1]) if a[-1][0] == b[-1][0] else 0
    return max(plain_matching(a[:-1], b), plain_matching(a, b[:-1]), plain_matching(a[:-1], b[:-1]) + both)


def test_tree_matching_size():
    leaf = lambda n, *c: (n, list(c), [])
    a, b = [leaf("p"), leaf("ul", leaf("li"), leaf("li")), leaf("p")], [leaf("h1"), leaf("ul", leaf("li")), leaf("p"), leaf("p")]
    size, pairs = wrapper.match(a, b)
    assert size == 3 and pairs[0] == (1, 1) and pairs[1] in ((2, 2), (2, 3)) and len(pairs) == 2
    rng = np.random.default_rng(5)

    def tree(depth):
        return leaf("abc"[rng.integers(3)], *[tree(depth - 1) for _ in range(rng.integers(3 if depth else 1))])

    for _ in range(300):
        x, y = ([tree(3) for _ in range(rng.integers(1, 4))] for _ in range(2))
        size, pairs = wrapper.match(x, y)
        assert size == plain_matching(x, y) == sum(1 + plain_matching(x[i][1], y[j][1]) for i, j in pairs)
        assert all(i < k and j < n for (i, j), (k, n) in itertools.pairwise(pairs)) and all(x[i][0] == y[j][0] for i, j in pairs)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="layout no-sidebar"><article><p>Body</p></article></div>', "Body"),
        ('<div class="page with-sidebar"><p>Body<div class="sidebar">S</div></div>', "Body"),
        ('<div class="commentary"><p>Body</p></div>', "Body"),
        ('<article class="post has-share"><p>Body</p></article>', "Body"),
        ('<div id="sidebar-left-layout"><main><p>Body</p></main><div id="sidebar">S</div></div>', "Body"),
        ('<form action="/"><h1>T</h1><p>Body</p></form>', "T\n\nBody"),
        ("<article><p>Body</article><ol><li><article class='comment'>C</article></ol>", "Body"),
        ("<p>Text <button>Share this</button> more", "Text more"),
        ('<p>Text <span class="advert">Buy <span>now</span> this</span> more', "Text more"),
        ('<p>Text<ins class="ad">Buy</ins><span style="display: none">no</span><b hidden>no</b> more', "Text more"),
        ('<p>Cut <span class="ad">off <p>Next', "Cut\n\nNext"),
        ('<p>See <a class="share" href="/x">this</a> link', "See this link"),
        ("<h1>Title</h1><article><p>One<p>Two</article><div>Else</div>", "Title\n\nOne\n\nTwo"),
        ("<article>Teaser</article><p>The text itself is not in the element", "Teaser\n\nThe text itself is not in the element"),
        ('<div class="ad">Only an advert</div>', ""),
    ],
)
def test_what_names_decide(html, text):
    assert wrapper.extract(html) == text


@pytest.mark.parametrize("names", ['class="ad-free-content"', 'class="social-science"', 'id="related-work"', 'class="notice-text"', 'id="search"', 'class="page login-wall-off"'])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_names_are_not_believed_against_a_whole_page(names, tag):
    body = f'<nav>Home</nav><{tag} {names}><h2>Part</h2><p>One<div class="ad">Buy</div><p>Two</{tag}><footer>F</footer>'
    assert wrapper.extract(f"<h1>T</h1>{body}") == "T\n\nPart\n\nOne\n\nTwo"
    assert wrapper.extract(f"<h1>T</h1><p>Text{body}") == "T\n\nText"
    for other in ("ad", "comments", "sidebar"):
        assert wrapper.extract(f'<h1>T</h1><div class="{other}">no</div>') == "T"


@pytest.mark.parametrize("kind", ["nested", "siblings", "classes"])
def test_deep_and_wide_pages(kind):
    n = 30_000

    def page(w):
        if kind == "nested":
            return "".join(f"<div>{w}{i}" for i in range(n))
        if kind == "siblings":
            return "".join(f"<p>{w}{i}</p><div>{w}{i}</div>" for i in range(n // 2))
        return "".join(f'<div class="{"abcdefgh"[i % 8] * (1 + i // 8 % 90)}">{w}{i}</div>' for i in range(n))

    pages = [page(w) + "<section><p>Same on all</p></section>" for w in ("x", "y", "z")]
    text = wrapper.extract(pages[0], wrapper.induce(pages))
    assert text.split("\n\n") == wrapper.extract(page("x")).split("\n\n") and text.count("\n\n") == n - 1
    assert warc.plain_text(pages[0]).endswith("Same on all")


def test_template_is_on_pages_that_differ(spark):
    """Copies of one page count once, and text that few pages have is no template."""
    body = lambda i: f"<article><h1>Title {i}</h1><p>Paragraph {i} of a page that differs, {i * i}</p><p>Written by staff</p></article>"
    rows = [(i, "http://a.example/", body(1)) for i in range(40)] + [(100 + i, "http://A.example:80/x", body(i)) for i in range(2, 5)]
    rows += [(200 + i, "http://b.example/", body(1)) for i in range(9)] + [(300, "http://b.example/", body(2))] + [(400 + i, "http://a.example/", "") for i in range(30)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all("staff" not in got[i] and "Paragraph" in got[i] for i in (0, 39, 102, 104))
    assert all(got[i].endswith("Written by staff") for i in (200, 208, 300)) and got[400] == ""


def test_bundled_pages_keep_their_articles(spark):
    import re

    got = wrapper.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = re.sub(r"\s+", "", __import__("html").unescape(re.sub("<[^>]*>", "", inner)))
        assert re.sub(r"\s+", "", r.text) == want


# op3


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/", "<title>A &amp; B</title><a href='/x'>link</a><p>Text é"), (2, None, None), (3, "http://b.example/", ""), (1, "http://a.example/", "<title>A &amp; B</title><a href='/x'>link</a><p>Text é")], "page_id long, url string, html string").withColumn("date", F.lit("clash"))
    responses = warc.responses(pages)
    derived = warc.derive(responses)
    rows = derived.collect()
    assert len(rows) == 8
    sources = {r.record_id: r for r in responses.collect()}
    for r in rows:
        assert r.refers_to in sources and r.payload_digest == sources[r.refers_to].payload_digest and r.block_digest == warc.digest(bytes(r.block))
        partner = next(x for x in rows if x.record_id == dict(r.headers)["WARC-Concurrent-To"])
        assert partner.refers_to == r.refers_to and partner.record_type != r.record_type
    first = {r.record_type: bytes(r.block).decode() for r in rows if r.page_id == 1}
    assert first["conversion"] == "link Text é".replace(" Text", "\nText") and "title: A & B\r\n" in first["metadata"] and "outlink: /x L a/@href" in first["metadata"]
    everything = derived.select(*warc._ARROW.names).unionByName(responses.select(*warc._ARROW.names))
    warc.write_warc(everything, f"{tmp_path}/w")
    key = lambda rows: sorted((r.record_id, r.refers_to or "", r.target_uri or "", bytes(r.block)) for r in rows)
    assert key(warc.read_warc(spark, f"{tmp_path}/w").collect()) == key(everything.collect())
    assert warc.derive(responses.where("false")).count() == 0
    assert list(warc.parse_warc(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nshort")) == []


def test_source_headers_and_codings_are_kept(spark):
    import gzip
    import zlib

    page = "<title>T</title><p>Grüße"
    head = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nX-Long: one\r\n two\r\nSet-Cookie: b=2\r\n"
    packed = gzip.compress(page.encode())
    chunked = b"".join(b"%x;q=1\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    blocks = {
        "plain": head + b"Content-Type: text/html; charset=utf-8\r\n\r\n" + page.encode(),
        "chunked": head + b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked,
        "deflate": head + b"content-encoding: deflate\r\n\r\n" + zlib.compress(page.encode())[2:-4],
        "latin": head + b"Content-Type: text/html; charset=latin-1\r\n\r\n" + page.encode("latin-1"),
        "marked": head + b"\r\n" + b"\xff\xfe" + page.encode("utf-16-le"),
        "broken": head + b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html; charset=no-such\r\n\r\n" + page.encode(),
    }
    given = [{"key": "WARC-IP-Address", "value": "1.2.3.4"}, {"key": "WARC-Concurrent-To", "value": "<urn:uuid:0>"}, {"key": "WARC-Protocol", "value": "h2"}, {"key": "WARC-Protocol", "value": "tls/1.3"}]
    rows = [("response", name, None, "http://a/", None, None, None, None, given, block) for name, block in blocks.items()]
    out = warc.derive(spark.createDataFrame(rows, warc.SCHEMA)).collect()
    assert len(out) == 2 * len(blocks)
    for r in out:
        text = bytes(r.block).decode()
        assert [tuple(h) for h in r.headers][:3] == [("WARC-IP-Address", "1.2.3.4"), ("WARC-Protocol", "h2"), ("WARC-Protocol", "tls/1.3")] and len(r.headers) == 4
        assert r.payload_digest == warc.digest(blocks[r.refers_to].partition(b"\r\n\r\n")[2])
        if r.record_type == "conversion":
            assert text == "Grüße"
        else:
            assert "source-set-cookie: a=1\r\nsource-x-long: one two\r\nsource-set-cookie: b=2\r\n" in text and "title: T\r\n" in text and text.count("warc-protocol") == 2


def test_warc_files_hold_so_many_records(spark, tmp_path):
    pages = spark.range(2100).selectExpr("concat('http://h/', id) AS url", "concat('<p>', id, '</p>') AS html").coalesce(1)
    for name, more, most in (("default", {}, warc.PER_FILE), ("fewer", {"per_file": 512}, 512)):
        warc.write_warc(warc.responses(pages), f"{tmp_path}/{name}", **more)
        sizes = [len(list(warc.parse_warc(gzip.decompress(p.read_bytes())))) for p in (tmp_path / name).glob("*.gz")]
        assert sum(sizes) == 2100 and max(sizes) == most and len(sizes) == -(-2100 // most)
        assert warc.read_warc(spark, f"{tmp_path}/{name}").select("record_id").distinct().count() == 2100


def test_warc_files_are_read_in_parts(monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "READ", 64)
    records = [b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nX: a:b\r\nX: c\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, 97 * i, b"z\n" * 48 * i + b"y" * i) for i in range(12)]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), b"".join(map(gzip.compress, records)) + b"trailing"):
        found = list(warc.parse_warc(data))
        assert [(r[1], len(r[-1])) for r in found] == [(f"<{i}>", 97 * i) for i in range(12)] and found[1][8] == [{"key": "X", "value": "a:b"}, {"key": "X", "value": "c"}]
    for length in (b"abc", b"-5", b"", b"9 9"):
        assert [r[1] for r in warc.parse_warc(records[3] + records[2].replace(b"Length: 194", b"Length: " + length) + records[4])] == ["<3>"]
    assert list(warc.parse_warc(b"")) == [] == list(warc.parse_warc(b"\x1f\x8bno gzip"))


# op4


@pytest.mark.parametrize("page", ["<a " * 100_000, "<title>" * 100_000, "<a href='" * 50_000, "<script>" * 100_000, "<a '\"" * 50_000, "<a" + " href" * 100_000 + ">", "<!--" * 100_000])
def test_hostile_markup_takes_linear_time(page):
    import time

    start = time.process_time()
    assert len(warc.title_and_links(page)[1]) <= 1 and time.process_time() - start < 5


def test_title_and_links_of_tags_alone():
    page = '<html><title> A &amp; b </title><title>no</title><!-- <a href="no"> --><a class=x HREF="/a?b&amp;c">t</a><a data-x=" href=q" href=\'z\'><script>"<a href=n>"</script><a name=k><a href><A\nhref=plain>İ<style><a href=s></STYLE><a href="">'
    assert warc.title_and_links(page) == ("A & b", ["/a?b&c", "z", "plain", ""])
    assert warc.title_and_links("<title>open <a href=x>") == ("", ["x"]) and warc.title_and_links("") == ("", [])


def test_all_members_of_a_packed_body():
    import gzip
    import zlib

    coded, one, two = [("Content-Encoding", "gzip")], gzip.compress(b"<p>one</p>"), gzip.compress(b"<p>two</p>")
    assert warc.payload_of(coded, one + two + one) == b"<p>one</p><p>two</p><p>one</p>"
    assert warc.payload_of(coded, one + b"\0\0") == b"<p>one</p>" and warc.payload_of([("content-encoding", "deflate")], zlib.compress(b"x")) == b"x"
    for broken in (one[:-3], one + two[:-9], b"plain", b""):
        assert warc.payload_of(coded, broken) == broken


def test_reading_goes_on_after_an_unreadable_record():
    record = lambda n, length: b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %s\r\n\r\nblock %d\r\n\r\n" % (n, length, n)
    got = list(warc.parse_warc(record(1, b"7") + record(2, b"seven") + record(3, b"7") + record(4, b"-7") + record(5, b"7"), onward=True))
    assert [(r[0], r[1], r[-1]) for r in got] == [("resource", "<1>", b"block 1"), (warc.UNREADABLE, "<2>", None), ("resource", "<3>", b"block 3"), (warc.UNREADABLE, "<4>", None), ("resource", "<5>", b"block 5")]


def test_slices_add_up():
    rng = np.random.default_rng(2)
    for bits in (1, 4, 11):
        values, query = rng.integers(0, 1 << bits, (130, 9)), rng.integers(-(1 << bits), 1 << bits, 9)
        sums, shift = bit_sliced.scores_sliced(bit_sliced.slices(values)[0], query)
        got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i for i, s in enumerate(sums))
        assert (got - shift == values @ query).all()


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = np.round(rng.normal(0, 0.3, (260, 6)), 1)
    vectors[100:160] = vectors[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1100, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (1200, [float("nan")] * 6), (1300, []), (None, [1.0] * 6), (1400, [1.0, 2.0]), (200, rows[200][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"block": F.lit(1), "v": F.lit(2)})
    got = bit_sliced.top_k(df, F.col("vec_id") % 100 == 0, block=50, many=2).collect()
    whole = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows + [odd[-1]]]
    for q in (0, 100):
        mine = next(v for i, v in whole if i == q)
        want = sorted((-int(v @ mine), i) for i, v in whole if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in got} == {0, 100, 200} and not [r for r in got if r.vec_id == r.query_id]
    assert bit_sliced.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert bit_sliced.top_k(df.where("vec_id < 4"), F.col("vec_id") % 100 == 0).count() == 3


# op9


def cheapest(roles):
    """The least cost by going through all ways."""
    best = 1 << 30
    for way in itertools.product(range(8), repeat=len(roles)):
        state, cost = 0, 0
        for role, choice in zip(roles, way, strict=True):
            options = role_repair.moves(state, role)
            if choice >= len(options):
                break
            cost, state = cost + options[choice][0], options[choice][1]
        else:
            best = min(best, cost + role_repair.INSERT * len(role_repair.ending(state)))
    return best


def test_costs_are_least():
    for n in (1, 2, 3, 4):
        for roles in itertools.product(range(4), repeat=n):
            costs, ways, _ = role_repair.solve(list(roles))
            assert role_repair.close(costs)[0] == cheapest(roles)
            for (entry, final), way in ways.items():
                assert sum(m[0] for m in way) == costs[entry][final]


def test_repair_renders_legally(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "assistant", "a"), (2, 1, "assistant", "b"), (2, 2, None, None), (3, 0, "User ", "q"), (4, 0, "system", ""), (4, 0, "system", ""), (4, None, "tool", "t"),
        (None, 1, "user", "n"), (5, 3, "user", "x"), (5, 3, "user", "x"), (5, 9, "system", "late"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "ordinal": F.lit(2)})
    whole = role_repair.repair(df)
    rows = whole.collect()
    assert len(rows) == len(turns)
    shown = {r.conv_id: r for r in role_repair.rendered(whole).collect()}
    cut = {r.conv_id: r for r in role_repair.rendered(role_repair.repair(df.repartition(3), fragment=1)).collect()}
    assert {k: r.cost for k, r in shown.items()} == {k: r.cost for k, r in cut.items()}
    assert shown[1].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n" and shown[1].cost == 0
    names = {None: 0, "user": 2, "assistant": 3, "system": 1}
    for c, r in shown.items():
        ordered = sorted((t for t in turns if t[0] == c), key=lambda t: ((t[1] is not None, t[1] or 0), (t[2] is not None, t[2] or ""), (t[3] is not None, t[3] or "")))
        assert r.cost == cheapest([names.get((t[2] or "").strip().lower() or None, 0) for t in ordered])
        said = [m.split("\n")[0] for m in r.rendered.split("<|im_start|>")[1:]]
        said = said[1:] if said[0] == "system" else said
        assert said == ["user", "assistant"] * (len(said) // 2) and said
    assert role_repair.repair(df.where("false")).count() == 0


def first_cheapest(roles):
    """Of all cheapest ways the first in order of moves, by going through all."""
    best = None
    for way in itertools.product(range(8), repeat=len(roles)):
        state, cost, taken = 0, 0, []
        for role, choice in zip(roles, way, strict=True):
            options = role_repair.moves(state, role)
            if choice >= len(options):
                break
            cost, state = cost + options[choice][0], options[choice][1]
            taken.append(options[choice])
        else:
            cost += role_repair.INSERT * len(role_repair.ending(state))
            if best is None or (cost, way) < best[:2]:
                best = cost, way, taken
    return best[2]


def test_ties_go_to_the_first_way():
    for n in (1, 2, 3, 4):
        for roles in itertools.product(range(4), repeat=n):
            for size in (1, 2, 5):
                parts = [role_repair.solve(list(roles[i : i + size])) for i in range(0, n, size)]
                path = role_repair.compose([p[0] for p in parts], [p[2] for p in parts])
                assert [m for p, step in zip(parts, path, strict=True) for m in p[1][step]] == first_cheapest(roles)


def test_repair_does_not_hang_on_partitions(spark):
    rng = np.random.default_rng(3)
    names = [None, "system", "user", "assistant", "tool", " USER"]
    turns = [(int(c), int(t) if rng.random() < 0.9 else None, names[rng.integers(6)], f"t{rng.integers(3)}") for c in range(150) for t in range(rng.integers(1, 9))]
    turns += [(1000, t, names[rng.integers(6)], "x") for t in range(700)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    key = lambda rows: sorted(map(str, rows))
    want = key(role_repair.repair(df.coalesce(1)).collect())
    assert len(want) == len(turns)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, fragment in ((1, 1), (3, 2), (9, 1024), (3, 1024), (9, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert key(role_repair.repair(df.repartition(parts), fragment=fragment).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    seen = [{r.doc_id for r in docs.select("doc_id").collect()}]
    from lathe.session import materialise

    for name, stage in c.STAGES[:-1]:
        docs = materialise(stage(spark, docs, "/root/testdata/sf0.01"), "test")
        assert docs.columns == list(c.COLUMNS)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= seen[-1]
        if name != "source mix":
            assert len(ids) == len(set(ids))
        seen.append(set(ids))
    assert len(seen[1] & bad) <= 0.05 * len(bad) and len(seen[2] & good) >= 0.96 * len(good)
    packed = c.STAGES[-1][1](spark, docs, "/root/testdata/sf0.01")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == seen[-1]


@pytest.mark.parametrize("name", ["op4_bit_sliced_top_k", "op5_fair_mix", "warc_files"])
def test_matches_sql(spark, duck, name):
    from lathe.llm.queries import ORACLES, QUERIES

    rows = sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=str)
    assert rows == sorted(duck.execute(ORACLES[name]).fetchall(), key=str)
