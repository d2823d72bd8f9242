"""The site style tree inside marked articles."""

from supportkb.llm import html_extract


def test_repeated_branch_in_articles_goes(spark):
    page = "<body><article><div class='k7'>Join our list today.</div><p>Story {0} of the day.</p></article></body>"
    rows = [(i, f"https://a/{i}", page.format(i)) for i in range(12)]
    rows += [(100 + i, f"https://copies/{i}", page.format(0)) for i in range(12)]
    rows += [(200, "https://few/1", page.format(1))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"Story {i} of the day." for i in range(12))
    assert all(got[100 + i] == "Join our list today.\nStory 0 of the day." for i in range(12))
    assert got[200] == "Join our list today.\nStory 1 of the day."


def test_names_inside_articles_and_teasers(spark):
    main = "The long story of the day goes on for many words and is the text that readers of the page came for."
    rows = [(1, "https://a/1", "<article><div class='search-results'>Found seven ships.</div><p class='copyright-law'>The law of 1710.</p>"
                               "<div class='comments'>Nice!</div><div id='ad-box2'>Buy.</div><p class='x newsletter_signup'>Join.</p></article>"),
            (2, "https://a/2", f"<body><article>teaser</article><div class='k'><p>{main}</p></div><nav>menu</nav></body>"),
            (3, "https://a/3", f"<body><article>{main}</article><div><p>Short words beside it.</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Found seven ships.\nThe law of 1710.", 2: f"teaser\n{main}", 3: main}


def test_tree_alone_decides(spark):
    """Two boxes of one kind on every page of a host: only the entropy of their contents tells them apart."""
    rows = [(i, f"https://h/{i}", f"<body><div class=a><p>Same line for all.</p></div><div class=b><p>Own line {i} of many.</p></div></body>")
            for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    scores = sorted(r["importance"] for r in html_extract.node_importance(pages).collect())
    assert scores[0] < 0.35 < scores[-1]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {i: f"Own line {i} of many." for i in range(30)}
