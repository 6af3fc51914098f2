from docgrain.llm import html_extract as H


def test_parts_that_are_no_article_go():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><aside>Side</aside><div class=ad>Buy</div>"
        "<article><header><h1>Head &amp; line</h1></header><p>One  <b>two</b>\n three<br>four<p>Five &lt;six&gt; &#233;<script>var x='</p>';</script>"
        "<ul><li>x<li>y</ul><form><input value=1>Form</form><section id='comments'><article><p>Me first</article></section></article>"
        "<footer>&copy; Foot</footer></body></html>"
    )
    assert H.extract(page) == "Head & line\nOne two three four\nFive <six> é\nx\ny"


def test_broken_markup_and_edges():
    assert H.extract(None) == "" and H.extract("") == "" and H.extract("<p>") == ""
    assert H.extract("plain a < b & c") == "plain a < b & c"
    assert H.extract("<p>a</div></span></p><p>b<!-- not closed") == "a\nb"
    assert H.extract("<div>" * 5000 + "deep") == "deep"
    assert H.extract("<body class='has-sidebar'><main><p>x</main>") == "x"


def test_pages_without_article_lose_link_lists():
    page = "<body><ul><li><a href=1>One link</a><li><a href=2>Two links</a></ul><div><p>Long text of the page itself, " + "word " * 30 + "</p></div></body>"
    assert H.extract(page).startswith("Long text") and "link" not in H.extract(page)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def templated(i, host):
    return (i, f"http://{host}/{i}", f"<body><div><p>Welcome to our shop</p></div><div><p>Story {i} {'w%d ' % i * 20}</p></div><div><p>All rights kept</p></div></body>")


def test_recurring_subtrees_go_on_both_ways(spark):
    rows = [templated(i, "a.example") for i in range(12)] + [templated(99, "b.example")]
    for most in (1000, -1):
        got = {r["page_id"]: r["text"] for r in H.extract_pages(pages(spark, rows), most_broadcast=most).collect()}
        assert all(got[i].startswith(f"Story {i}") and "\n" not in got[i] for i in range(12))
        assert got[99].startswith("Welcome to our shop\nStory 99")  # one page of its host says nothing of templates


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><div><p>The same story " + "w " * 30 + "</p></div></body>"
    got = H.extract_pages(pages(spark, [(i, f"http://c.example/{i}", page) for i in range(20)])).collect()
    assert all(r["text"].startswith("The same story") for r in got)


def test_nulls_repeats_empty_table_and_more_columns(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, None), (1, None, "<p>x</p>"), (1, None, "<p>x</p>"), (2, "no url", "")]
    got = H.extract_pages(pages(spark, rows).withColumn("text", F.lit("clash")).withColumn("host_key", F.lit(1)))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert H.extract_pages(pages(spark, [])).count() == 0


def test_depth_and_malformed_pages_of_any_length():
    import time

    deep = "<div>" * 260 + "<article>good<p>more" + "<div>" * 30_000 + "deep" + "</div>" * 30_000 + "<nav>Menu</nav><footer>Foot</footer>"
    assert H.extract(deep) == "good\nmore\ndeep"
    begin = time.process_time()
    assert H.extract("<p>x</p>" + "<a x " * 200_000).startswith("x\n<a x")
    for odd in ('<a x="' * 100_000, "<!--" * 200_000, "</p>" * 200_000, "<ul><li><ul>" + "<b>" * 50_000 + "<li></li>" * 50_000):
        H.extract(odd)
    assert time.process_time() - begin < 20
    assert H.extract("<p title=it's>It's</p><a href='x>y'>z</a>") == "It's\nz"


def test_every_article_of_a_page_is_kept():
    assert H.extract("<article>one</article><div class=ad>ad</div><article>two two</article>") == "one\ntwo two"


def pooled(i):
    """A page of a site whose menu and notice come from pools, without any name that tells what they are."""
    story = "".join(f"<p>{' '.join(f'w{i}x{k}y{j}' for j in range(12))}</p>" for k in range(4))
    quote = "<p>To be or not to be that is the question</p>" if i % 4 == 0 else ""
    return (i, f"http://p.example/{i}", f"<body><div class=t1><p>Go to page {i % 8}</p></div><div class=t2>{story}{quote}</div><div class=t3><p>Notice {i % 9}</p></div></body>")


def test_templates_alone_find_menus_of_a_pool_and_leave_quotations(spark):
    rows = [pooled(i) for i in range(80)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(pages(spark, rows), parts=False).collect()}
    for i in range(80):
        lines = got[i].split("\n")
        assert lines[0].startswith(f"w{i}x0") and len(lines) == (5 if i % 4 == 0 else 4) and "Notice" not in got[i]
        assert (lines[-1] == "To be or not to be that is the question") == (i % 4 == 0)


def test_templates_against_brute_force(spark):
    from collections import defaultdict

    rows = [pooled(i) for i in range(60)] + [templated(i, "a.example") for i in range(12)] + [pooled(3)] * 5 + [templated(i, "few.example") for i in range(3)]
    stands, slots, mains = defaultdict(set), {}, defaultdict(set)
    for _, url, text in rows:
        host = url.split("/")[2]
        found, sig = H.page_subtrees(text)
        mains[host].add(sig)
        for key, slot in found.items():
            stands[host, key].add(sig)
            slots[host, key] = slot
    fill, again = defaultdict(int), defaultdict(int)
    for (host, key), sigs in stands.items():
        fill[host, slots[host, key]] += len(sigs)
        again[host, slots[host, key]] += len(sigs) if len(sigs) >= 3 else 0
    want = set()
    for (host, key), sigs in stands.items():
        n, slot = len(sigs), (host, slots[host, key])
        if n >= 5 and n >= 0.3 * len(mains[host]) or n >= 3 and fill[slot] >= 10 and again[slot] >= 0.5 * fill[slot]:
            want.add((host, key))
    df = pages(spark, rows)
    from pyspark.sql import functions as F

    hosts = {r["k"]: r["h"] for r in df.select(H.host_of(F.col("url")).alias("h")).distinct().select("h", F.xxhash64("h").alias("k")).collect()}
    got = [(hosts[r["host_key"]], r["subtree"]) for r in H.site_templates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {h for h, _ in want} == {"p.example", "a.example"}


def test_near_copies_of_an_article_are_no_template(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        own = list(words)
        own[(i * 37) % 200] = f"new{i}"
        rows.append((i, f"http://n.example/{i}", "<body><article>" + "".join(f"<p>{' '.join(own[k:k + 20])}</p>" for k in range(0, 200, 20)) + "</article></body>"))
    rows += [(100 + i, f"http://n.example/{100 + i}", f"<body><article><p>{' '.join(f'v{i}x{k}' for k in range(50))}</p></article></body>") for i in range(40)]
    got = H.extract_pages(pages(spark, rows)).collect()
    assert all(len(r["text"].split()) == (200 if r["page_id"] < 100 else 50) for r in got)
