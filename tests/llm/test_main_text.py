import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from dyadspark.llm import main_text

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def part(pages, hosts):
    found = [main_text.blocks(p) for p in pages]
    return pa.table({"host": pa.array(hosts, pa.int64()), "texts": [[b[0] for b in x] for x in found], "zones": [[b[1] for b in x] for x in found], "linked": [[b[2] for b in x] for x in found]})


def texts(pages, hosts=None, min_tokens=6, min_pages=3, site_pages=8, site_share=0.5):
    """What the pages of one part give."""
    hosts = hosts or [0] * len(pages)
    table = part(pages, hosts)
    own = main_text.Streams(table, min_tokens, 3)
    every = np.full(main_text._BITS // 64, np.uint64(2**64 - 1))
    host, name, n = own.windows(every)
    on_host = Counter(hosts)
    verdict = {w: n_ >= site_pages and n_ > site_share * on_host[int(h)] for h, w, n_ in zip(host.tolist(), name.tolist(), n.tolist(), strict=True) if n_ >= min_pages}
    starts = own.starts
    names = own.names(starts).tolist() if len(starts) else []
    hit = starts[np.array([w in verdict for w in names], bool)]
    site = starts[np.array([verdict.get(w, False) for w in names], bool)]
    return own.texts(hit, site, table)


def kept(page):
    return texts([page])[0][0]


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- ad <p>no</p> --><div class="cookie-notice">Cookies</div>
    <article><header><h1>Title  &amp;
    more</h1></header><p>One <b>bold</b><i>er</i>&nbsp;&lt;x&gt; &#233;<p>Two<br>Three</p><div class="ad">Buy</div><aside>Side</aside>
    <form><input value=">">Sign up</form><ul><li>a<li>b</ul><div id="comments"><p>Reader</p></div><p>Last</article>
    <section class="related-posts">More</section><footer>&copy; x</footer></body></html>"""
    assert kept(page).split("\n") == ["Title & more", "One bolder <x> é", "Two", "Three", "a", "b", "Last"]


def test_broken_and_bare_markup():
    assert kept("") == "" and kept("plain < text > here") == "plain < text > here"
    assert kept("<article><p>open <b>never closed") == "open never closed"
    assert kept("<p>a</div></section>b</p>") == "a\nb"
    assert kept("<script>x") == "" and kept("<!-- x") == ""
    assert kept('<body><div class="MainContent"><p>yes</p></div><p>loose</p></body>') == "yes"
    assert kept('<p class="x>Hello</p>') == "Hello" and kept("<p>a</p><p class='b>c</p><p>d") == "a\nc\nd"


def test_text_beside_a_container_that_is_only_named_like_one():
    assert kept('<body><div class="post">Teaser</div><p>The text itself</p></body>') == "Teaser\nThe text itself"


def test_time_follows_the_length_of_a_page():
    for piece in ("<a '", "<a '>' ", "<div></p>", "<!--", "<script '", "&#", "<", "<![CDATA[", "<p a=\""):
        began = time.time()
        main_text.blocks(piece * ((1 << 20) // len(piece)))
        assert time.time() - began < 10
    began = time.time()
    main_text.blocks("<a '" * (1 << 18))
    assert time.time() - began < 1


LINE = "Read all of our terms before you go on with this site"


def test_repeats_on_a_host_go_from_open_pages():
    rng = np.random.default_rng(0)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(8)]
    pages = [f"<html><body><div>{LINE}</div><div>{t}</div><table><tr><td>{LINE} again</td></tr></table></body></html>" for t in own]
    got, share = texts(pages)
    assert got == own and all(0.2 < s < 0.6 for s in share)
    got, _ = texts(pages, list(range(8)))  # other hosts: nothing repeats
    assert got[0].startswith(LINE)
    got, _ = texts([f"<div>{LINE} {t} {LINE}</div>" for t in own])
    assert got == own  # unique runs of one block


def test_site_wide_lines_go_from_articles_too_but_repeats_stay():
    rng = np.random.default_rng(2)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(12)]
    quote = " ".join(f"q{x}" for x in range(30))
    pages = [f"<article><p>{t}{' ' + quote if i < 5 else ''}</p><p>{LINE}</p></article>" for i, t in enumerate(own)]
    got, _ = texts(pages)
    assert got == [t + (" " + quote if i < 5 else "") for i, t in enumerate(own)]
    mirrored, _ = texts([f"<article><p>{own[0]}</p></article>"] * 12)
    assert mirrored == [own[0]] * 12


def test_repeated_tokens_against_brute_force():
    rng = np.random.default_rng(1)
    for size, pages in ((5, 2), (6, 3), (8, 2), (1, 2)):
        page = np.sort(rng.integers(0, 12, 400))
        tokens = rng.integers(0, 4, 400)
        tokens[50:70] = tokens[350:370] = tokens[200:220]
        where = {}
        for i in range(400 - size + 1):
            if page[i] == page[i + size - 1]:
                where.setdefault(tuple(tokens[i : i + size]), []).append(i)
        want = np.zeros(400, bool)
        for at in where.values():
            if len({page[i] for i in at}) >= pages:
                for i in at:
                    want[i : i + size] = True
        assert (main_text.repeated_tokens(tokens, page, size, pages) == want).all()


def plain_covered(rows, size, min_pages):
    """Share of repeated words of every page, from all windows of all pages of a host."""
    streams = [(url.split("/")[2], [w for t, z, _ in main_text.blocks(h) if z for w in t.split(" ")]) for _, url, h in rows]
    seen = defaultdict(set)
    for n, (host, words) in enumerate(streams):
        for i in range(len(words) - size + 1):
            seen[host, tuple(words[i : i + size])].add(n)
    out = []
    for host, words in streams:
        hit = np.zeros(len(words), bool)
        for i in range(len(words) - size + 1):
            if len(seen[host, tuple(words[i : i + size])]) >= min_pages:
                hit[i : i + size] = True
        out.append(hit.mean() if len(words) else 0.0)
    return out


def test_counts_do_not_depend_on_parts_or_the_size_of_a_host(spark):
    """Every page in a part of its own, both ways back of the verdicts, hosts of 30 and 600 pages: one verdict."""
    rng = np.random.default_rng(3)
    rows = []
    for host, n in (("small.example", 30), ("large.example", 600)):
        for i in range(n):
            own = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 30))
            notice = f"<div>{LINE} now</div>" if i % (n // 10) == 0 else ""
            rows.append((len(rows), f"http://{host}/{i}", f"<body>{notice}<div>{own}</div></body>"))
    frame = spark.createDataFrame(rows, PAGE).repartition(5)
    want = plain_covered(rows, 6, 3)
    results = []
    for options in ({"part_bytes": 1}, {"part_bytes": 1, "most_broadcast": 0}, {}):
        got = {r.page_id: r for r in main_text.extract(frame, min_tokens=6, **options).collect()}
        assert [round(got[i].covered, 6) for i in range(len(rows))] == [round(x, 6) for x in want]
        results.append([got[i].text for i in range(len(rows))])
    assert results[0] == results[1] == results[2]
    assert not any(LINE in t for t in results[0]) and all(len(t.split(" ")) == 30 for t in results[0])


def test_query_rows(spark):
    article = "<html><body><nav>a b c</nav><article><p>Same article here &amp; there</p></article></body></html>"
    rows = [(i, f"http://Host{i % 2}.example/{i}", article) for i in range(30)]
    rows += [(100, None, None), (101, "x", ""), (102, None, "<p>q</p>"), (None, "http://a", "<p>r</p>"), (5, "http://a", "<p>" + "long " * 50000 + "</p>")]
    frame = spark.createDataFrame(rows, PAGE).repartition(3)
    got = main_text.extract(frame, part_bytes=500).collect()
    assert len(got) == len(rows)
    assert sum(r.text == "Same article here & there" for r in got) == 30
    assert {r.page_id: (r.text, r.n_chars) for r in got if r.page_id in (100, 101, 102)} == {100: ("", 0), 101: ("", 0), 102: ("q", 1)}
    assert max(r.n_chars for r in got) == 50000 * 5 - 1
    assert main_text.extract(frame.limit(0)).count() == 0
    clashing = frame.selectExpr("*", "1 AS row", "'h' AS host", "2 AS w", "3 AS bytes", "'t' AS texts", "4 AS text", "5 AS n_chars")
    assert sorted(main_text.extract(clashing).collect(), key=str) == sorted(got, key=str)


def one(spark, *pages):
    frame = spark.createDataFrame([(i, "http://x.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in main_text.extract(frame).collect()}


def test_ordinary_names_inside_an_article(spark):
    page = "<body><nav>Home</nav><article><h1>Markets</h1><p class='share-price'>Shares rose.</p><section id='legal'><p>The court ruled on Monday.</p></section>{}</article></body>"
    want = "Markets\nShares rose.\nThe court ruled on Monday."
    out = one(spark, page.format(""), page.format("<div class='links'><a href=1>One</a> <a href=2>Two</a></div>"), page.format("<div class='related-posts'>More</div><div class=comments>Nice!</div><div class='ad'>Buy</div>"))
    assert out == {0: want, 1: want, 2: want}


def test_notices_inside_articles_go_where_the_host_repeats_them(spark):
    notice = "<div class='notice'>we keep small files on your device so that this site can remember what you like to read</div>"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    own = [" ".join(f"{w}{i}" for w in words) for i in range(6)]
    out = one(spark, *[f"<article><h1>T{i}</h1><p>{t}.</p>{notice}<p>End of {t}.</p></article>" for i, t in enumerate(own)])
    assert out == {i: f"T{i}\n{t}.\nEnd of {t}." for i, t in enumerate(own)}
    once = one(spark, f"<article><p>{own[0]}.</p>{notice}</article>")
    assert "small files" in once[0]  # a single page says nothing about its host


def test_deep_and_broken_nesting_in_linear_time(spark):
    deep = "<div>" * 3000 + "<nav>menu</nav><p>Text.</p>" + "</div>" * 3000
    assert one(spark, f"<body>{deep}</body>") == {0: "Text."}
    began = time.time()
    for bad in ("<i>" * 60_000 + "<b>x</b></u>" * 60_000, "<span>" * 60_000 + "<a>x" * 60_000, "<div><b>" * 40_000 + "</i></b></p>" * 40_000, "<p>" * 60_000 + "<li>y" * 60_000):
        main_text.blocks(bad)
    assert time.time() - began < 20
