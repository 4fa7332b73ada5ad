import random
import re

from tidemark.llm import html_text, wrappers


def page(rng, article):
    head = "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body>"
    nav = "<nav><ul>" + "".join(f"<li><a href='#'>m{rng.random()}</a></li>" for _ in range(
        rng.randint(1, 5))) + "</ul></nav>"
    extra = rng.choice(["", "<div class='cookie-notice'>We use cookies</div>",
                        "<form><input name=q><button>Go</button></form>"])
    side = rng.choice(["", "<aside><p>Side</p></aside>", "<div id=sidebar>Side</div>"])
    comments = rng.choice(["", "<section class=\"comments\"><p>First!</p></section>"])
    body = "".join(rng.choice(["<p>%s</p>", "<p>%s", "<div>%s</div>", "<ul><li>%s</ul>"]) % t
                   for t in article)
    return (f"{head}{nav}<header><h1>Site</h1></header>{extra}<article><h1>Head</h1>{body}{comments}"
            f"<script>var a='</p>';</script></article>{side}<footer>&copy; me</footer></body></html>")


def test_article_without_anything_around_it(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(80):
        text = [f"Wort {rng.randrange(99)}  é &lt;b&gt; <b>x</b>y\n z" for _ in range(rng.randint(1, 9))]
        rows.append((i, f"https://Host{i % 3}.example.org:80/p/{i}?q", page(rng, text)))
        want[i] = "\n".join(["Head"] + [
            re.sub(r"\s+", " ", t.replace("&lt;", "<").replace("&gt;", ">").replace("<b>x</b>", "x"))
            for t in text]).replace("x</b>", "x")
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")
    out = html_text.extract_text(frame)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    hosts = {r.host: r for r in html_text.infer_wrappers(frame.select("url", "html")).collect()}
    assert set(hosts) == {"host0.example.org", "host1.example.org", "host2.example.org"}
    for i, url, html in rows:
        shape = "".join(t + " " for t in html_text.read_page(html)[0])
        wrapper = wrappers.decode(hosts[html_text.host_of(url)].wrapper)
        assert re.fullmatch(wrappers.pattern(wrapper), shape)


def test_hosts_without_an_article_take_the_fullest_container(spark):
    html = ("<body><div class=menu>a b</div><div class='story'><p>long text of the page</p>"
            "<table><tr><td>cell<td>next</table></div><div class='x'>small</div></body>")
    frame = spark.createDataFrame([(1, "//h/x", html)], "page_id long, url string, html string")
    assert html_text.extract_text(frame).first().text == "long text of the page\ncell\nnext"


def test_special_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a/", "<p>"), (4, "http://a/", "plain &amp; text"),
            (None, "http://b/", "<article>x<br>y &nbsp; z &#233;</article>"),
            (5, "http://b/", "<article>" + "<p>w " * 20_000), (5, "http://b/", "<article>" + "<p>w " * 20_000),
            (6, "http://b/", "<article>a < b <!-- no --> c<span class=ad>buy</span> <i>d</i></ARTICLE>e"),
            (7, "http://b/", "<article>cut <b"), (8, "http://c/", "<script>x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text) for r in html_text.extract_text(frame).collect()), key=str)
    assert got == sorted([
        (1, ""), (2, ""), (3, ""), (4, "plain & text"), (None, "x\ny z é"),
        (5, "\n".join(["w"] * 20_000)), (5, "\n".join(["w"] * 20_000)), (6, "a < b c d"), (7, "cut"),
        (8, "")], key=str)
    assert html_text.extract_text(frame.limit(0)).count() == 0


def test_wrappers_accept_all_they_were_made_from():
    rng = random.Random(8)
    for _ in range(200):
        shapes = [[rng.choice("abcd#") for _ in range(rng.randint(0, 12))] for _ in range(6)]
        wrapper = None
        for shape in shapes:
            wrapper = wrappers.generalise(wrapper, wrappers.fold(shape))
            assert wrappers.decode(wrappers.encode(wrapper)) == wrapper
        for shape in shapes:
            assert re.fullmatch(wrappers.pattern(wrapper), "".join(t + " " for t in shape))


def test_repetition_and_options_are_found():
    a, b = "ul li # /li li # /li /ul".split(), "ul li # /li /ul p #".split()
    wrapper = wrappers.generalise(wrappers.fold(a), wrappers.fold(b))
    assert wrappers.encode(wrapper) in (
        "ul ( li # /li )+ /ul ( p # )?", "ul ( li # /li )? /ul ( p # )?",
        "ul ( ( li # /li )+ )? ( li # /li )? /ul ( p # )?")
    assert wrappers.slots(wrapper) >= 2


def texts_of(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract_text(frame).collect()}


def test_text_that_all_pages_of_a_host_repeat_is_no_content(spark):
    def html(i):
        related = "<ul><li>Top stories</li><li>Our shop</li></ul>" if i % 2 else ""
        return (f"<body><article><h2>Report</h2><p>Follow us here</p><p>own words {i} of the page</p>"
                f"{related}</article></body>")

    rows = [(i, "http://big/", html(i)) for i in range(12)]
    # Copies of one page tell nothing, nor do a few pages, nor text that is most of its page.
    rows += [(100 + i, "http://copies/", html(0)) for i in range(12)]
    rows += [(200 + i, "http://few/", html(2 * i)) for i in range(4)]
    rows += [(300 + i, "http://license/", f"<article><p>{'same words ' * 30}</p><p>{i}</p></article>")
             for i in range(12)]
    got = texts_of(spark, rows)
    assert {i: got[i] for i in range(12)} == {
        i: f"Report\nown words {i} of the page" for i in range(12)}
    assert all(got[100 + i] == "Report\nFollow us here\nown words 0 of the page" for i in range(12))
    assert all("Follow us here" in got[200 + i] for i in range(4))
    assert all(got[300 + i] == "same words " * 29 + f"same words\n{i}" for i in range(12))


def test_pages_without_an_article_keep_their_own_content(spark):
    def html(inner):
        return f"<body><div class=menu>Menu</div>{inner}<div class=x>tiny</div></body>"

    rows, want = [], {}
    for i in range(9):  # two templates on a host, the second with a container of its own per page
        words = f"{i} has words " * 10
        if i % 3:
            rows.append((i, "http://two/", html(f"<div class=content><p>{words}</p></div>")))
        else:
            rows.append((i, "http://two/", html(f"<div id=post-{i}x class=post><p>{words}</p></div>")))
        want[i] = words.strip()
    for i in range(10, 16):
        rows.append((i, "http://ids/", html(f"<div id=p{i}>{f'body {i} ' * 10}</div>")))
        want[i] = (f"body {i} " * 10).strip()
    for i in range(20, 26):  # an article in sibling containers
        parts = [f"<div class=section{k}>{f'part {i} {k} ' * (9 - 4 * k)}</div>" for k in range(2)]
        rows.append((i, "http://parts/", html("<div class=text>" + "".join(parts) + "</div>")))
        want[i] = "\n".join((f"part {i} {k} " * (9 - 4 * k)).strip() for k in range(2))
    assert texts_of(spark, rows) == want


def test_ids_of_pages_do_not_make_shapes_or_lists_of_paths(spark):
    rows = [(i, "http://hot/", f"<article id=post-{i} class='post p-{i}'><div class=n{i}>text {i}</div>"
             + "<p>more" * (i % 5) + "</article>") for i in range(300)]
    rows += [(1000 + i, "http://hot/", f"<div id=d{i}>plain {i}</div>") for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    shapes = {" ".join(html_text.read_page(h)[0]) for _, _, h in rows}
    assert len(shapes) == 6
    host = html_text.infer_wrappers(frame).first()
    assert host.n_pages == 600 and len(host.wrapper.split()) < 60
    known = html_text.classify(frame).collect()
    assert len(known) == 1 and len(known[0].containers) <= html_text.CONTAINERS
    got = {r.page_id: r.text for r in html_text.extract_text(frame).collect()}
    assert got == {i: "\n".join([f"text {i}"] + ["more"] * (i % 5)) for i in range(300)} | {
        1000 + i: f"plain {i}" for i in range(300)}


def test_groups_of_shapes_align_and_match():
    rng = random.Random(9)
    for _ in range(100):
        shapes = [[rng.choice("abcd#") for _ in range(rng.randint(0, 12))] for _ in range(9)]
        parts = []
        for k in range(3):
            wrapper = None
            for shape in shapes[k::3]:
                wrapper = wrappers.generalise(wrapper, wrappers.fold(shape))
            parts.append(wrapper)
        whole = None
        for part in parts:
            whole = wrappers.generalise(whole, part)
        matcher = wrappers.Matcher(whole)
        assert all(matcher.fits(wrappers.Matcher(part)) for part in parts)
        for shape in shapes:
            places = matcher.match(shape)
            assert [matcher.leaves[i] for i in places] == shape
        for _ in range(20):
            shape = [rng.choice("abcd#") for _ in range(rng.randint(0, 6))]
            line = "".join(t + " " for t in shape)
            accepted = re.fullmatch(wrappers.pattern(parts[0]), line) is not None
            one = wrappers.Matcher(parts[0])
            assert (one.match(shape) is not None) == accepted
            assert one.fits(wrappers.Matcher(tuple(shape))) == accepted


def test_only_hidden_parts_are_hidden(spark):
    shown = ["style='overflow:hidden'", "class=overflow-hidden", "title='hidden gems'",
             "data-x='display:none'", "hidden=false", "data-hidden", "aria-hidden=false"]
    gone = ["hidden", "HIDDEN=''", "aria-hidden='true'", "style='color:red; display: none'",
            "style=visibility:hidden"]
    rows = [(i, "http://h/", f"<body {a}><article {a}>a <a href='/hidden/x' {a}>b</a> c</article>")
            for i, a in enumerate(shown)]
    rows += [(100 + i, "http://h/", f"<article>a<p>x <i {a}>b</i> c</p><div {a}>d</div></article>")
             for i, a in enumerate(gone)]
    assert texts_of(spark, rows) == {i: "a b c" for i in range(len(shown))} | {
        100 + i: "a\nx c" for i in range(len(gone))}


def text_of(html):
    return html_text.main_text(html)


def test_words_in_names_inside_an_article():
    """Only a name that says nothing else drops a part of an article."""
    kept = ["share-prices", "comments-on-policy", "search-results", "alert", "social-history",
            "menu-of-the-day", "notice-of-death"]
    gone = ["comments", "share", "ad", "related-list", "newsletter-box", "sidebar", "cookies"]
    body = "".join(f"<div class='{n}'><p>{n} text</p></div>" for n in kept + gone)
    text = text_of(f"<body><article><h1>Head</h1>{body}<p id='share'>own</p></article></body>")
    assert text.split("\n") == ["Head", *[f"{n} text" for n in kept], "own"]


def test_forms():
    inner = "<article><p>" + "long text " * 60 + "</p><form><p>Subscribe</p><input></form></article>"
    want = ("long text " * 60).strip()
    assert text_of(f"<body><form action=x>{inner}</form></body>") == want
    assert text_of(f"<body><form>{inner}</body>") == want
    main = "<main><p>" + "long text " * 60 + "</p></main>"
    assert text_of(f"<html><body><form>{main}</form></body></html>") == want
    assert text_of(f"<body><form><div><p>{want}</p></div></form></body>") == want
    assert text_of(f"<body><div><p>{want}</p></div><form><p>Search</p></form></body>") == want


def test_unlike_long_pages_align_in_bounded_memory(monkeypatch):
    rng = random.Random(3)
    for size, letters, cells in ((12, 4, 6), (9, 3, 1), (400, 300, 1_000)):
        monkeypatch.setattr(wrappers, "_CELLS", cells)
        for _ in range(150 if size < 100 else 5):
            a, b = (wrappers.fold([f"t{rng.randrange(letters)}" for _ in range(rng.randrange(size))])
                    for _ in range(2))
            both = wrappers.Matcher(wrappers.align(a, b))
            assert both.fits(wrappers.Matcher(a)) and both.fits(wrappers.Matcher(b))
    many = [f"t{i}" for i in range(140_000)]
    assert len(wrappers.fold(many)) == 140_000
    card = ["div", *[f"x{i}" for i in range(45)]]
    assert len(wrappers.fold(card * 3)) == 1
