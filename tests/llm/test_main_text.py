from webloom.llm import main_text as M

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Words of an advert.</div>
<article><h1>T &amp; U</h1><p><b>First&nbsp;one,   with
white space.<br><p>Yes.</p><p>A <a href=x>link</a> &lt;in&gt; a text.</p>
<div class="comments"><p>A reader writes at length about this and that.</p></div></article>
<aside>Side</aside><form><p>Send us your name and address, please, today.</p></form>
<footer>&copy; somebody &middot; some words here that go on for a while.</footer></body></html>"""


def test_article_only():
    assert M.main_text(PAGE) == "T & U\n\nFirst one, with white space.\n\nYes.\n\nA link <in> a text."


def test_labelled_pages_are_told_apart():
    right = total = 0
    for page in M.LABELLED:
        want = [t[1:].strip() for t in M.blocks(page)[0] if t.startswith("+")]
        got = M.main_text(page.replace("+ ", "")).split("\n\n")
        right += sum(t in got for t in want) - sum(t not in want for t in got if t)
        total += len(want)
    assert right / total > 0.95


def test_new_layouts():
    body = "The ferry leaves at nine and comes back at noon, unless the weather is bad for boats."
    page = f"<div id=top><a href=1>Home</a></div><div class=post-body><p>{body}</p><p>Short.</p></div>"
    assert M.main_text(page) == f"{body}\n\nShort."
    assert M.main_text(f"<nav><a href=1>Home</a></nav><p>{body}</p><div class=sidebar>{body}</div>") == body


def test_headers_inside_and_outside_the_text():
    body = "The ferry leaves at nine and comes back at noon, unless the weather is bad for boats."
    page = f"""<div class="site-header"><p>{body} {body}</p></div><article><header><h1>Ferries</h1></header>
    <div class="post-header">By a sailor</div><p>{body}</p></article><header>{body}</header>"""
    assert M.main_text(page) == f"Ferries\n\nBy a sailor\n\n{body}"


def test_odd_pages(spark):
    rows = [
        (1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>", "x"), (2, "u", "<p>", "x"),
        (3, "u", "<script>if(a<b){", "x"), (4, "u", "<article><p>" + "word " * 200_000, "x"),
        (5, "u", "<div>" * 20_000 + "</p>" * 20_000, "x"), (6, "u", "<article>a < b <3 </article", "x"),
        (7, "u", '<a href="' + "x" * 1000, "x"), (8, "u", PAGE, "x"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = M.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == texts[3] == texts[5] == ""
    assert texts[4] == " ".join(["word"] * 200_000) and texts[6] == "a < b <3"
    assert M.extract(df.limit(0)).count() == 0


def test_wrappers_with_side_words_hold_the_text():
    body = "The ferry leaves at nine and comes back at noon, unless the weather is bad for boats."
    note = "A reader writes at length about this and that and about the ferry too."
    article = f"<article><p>{body}</p><p>Yes.</p></article>"
    want = f"{body}\n\nYes."
    for start, end in (
        ("<form method=post action=x.aspx>", "</form>"),
        ("<div class='site with-sidebar'>", "</div>"),
        ("<div id=page class='nav-open'>", "</div>"),
        ("<div class='page sidebar'>", "</div>"),
        ("<div class='menu'><FORM>", "</FORM></div>"),
    ):
        side = f"<div class=comments><article><p>{note}</p></article></div><aside><article>{note}</article></aside>"
        assert M.main_text(f"<body><nav><a href=1>A</a></nav>{start}{article}{side}{end}</body>") == want
    assert M.main_text(article.replace("<article>", "<article class='post has-comments'>")) == want
    assert M.main_text(f"<form><div id=content><p>{body}</p><p>Yes.</p></div></form>") == want
    assert M.main_text("<form>" * 20_000 + "x") is not None
