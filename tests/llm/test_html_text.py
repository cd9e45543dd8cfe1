"""Main text of pages: layouts with known articles, hosts that agree, and broken markup."""

import html
import random
import re
import time

from siltstone.llm.html_text import VOTE, WINNING_SHARE, Page, extract, extract_pages, parent_path

LAYOUTS = [
    "<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Menu a</a></ul></nav><article>{0}</article>"
    "<aside>Side words</aside><footer>Foot words</footer><script>var x='<p>no</p>'</script></body></html>",
    "<body class='has-sidebar'><div id='top-nav'><a href='/'>Home</a></div><header>Site name</header><div id=wrap><div class='post-12 content'>{0}"
    "<div class=ad-box>Buy now</div><form><p>Your mail</p><input></form><section class='comments'><p>I think that this is a nice text, thank you.</p></section></div>"
    "<div class='sidebar'><p>Words at the side that are many enough to count for something.</p></div></div><div class='cookie-notice'>We use cookies.</div>",
    "<body><div role=navigation>Go</div><main>{0}</main><div class='newsletterSignup'>Subscribe!</div><div class=siteFooter>End</div></body>",
]


def article(rng):
    words = [rng.choice(["stone", "river", "caf&eacute;", "a&amp;b", "<b>bold</b>", "old  \n town", "<a href='#'>link</a>", "x &lt; y"]) for _ in range(60)]
    cut = sorted(rng.sample(range(1, 60), 4))
    parts = [" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, 60], strict=True)]
    source = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}" + rng.choice(["</p>", "", "<br>"]) for p in parts[1:])
    want = "\n".join(" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in parts)
    return source, want


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_layouts_give_the_article_alone(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(90):
        source, text = article(rng)
        rows.append((i, f"http://host{i % 3}.example/{i}", LAYOUTS[i % 3].format(source)))
        want[i] = text
    rows += [(100, "http://host0.example/x", None), (101, None, ""), (102, "no url", "<nav>only a menu</nav>"), (103, "http://host1.example", "plain words")]
    want |= {100: "", 101: "", 102: "", 103: "plain words"}
    rows += [rows[5], rows[5]]  # repeated rows
    pages = pages_of(spark, rows).selectExpr("*", "1 AS host", "2 AS winning", "3 AS text")
    got = extract_pages(pages).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(pages.limit(0)).count() == 0


def test_a_host_agrees_on_the_place_where_one_page_is_misleading(spark):
    layout = "<body><div class=lead>{1}</div><div class=story-{2}>{0}</div></body>"
    rows = [(i, "http://h.example/" + str(i), layout.format("<p>" + "long words of the story " * 9, "<p>teaser", i)) for i in range(30)]
    odd = (99, "http://h.example/odd", layout.format("<p>short story", "<p>" + "teaser words without end " * 9, 99))
    got = {r.page_id: r.text for r in extract_pages(pages_of(spark, [*rows, odd])).collect()}
    assert got[99] == "short story"
    assert extract(odd[2], []).startswith("teaser")


def test_nothing_of_the_article_is_lost():
    deep = "<div>" * 600 + "<nav>MENU</nav><p>text</p>" + "</div>" * 600
    assert extract(deep, []) == "text"
    assert extract("<nav>a</nav><p>text</p>" + "<div>" * 5000 + "<aside>b</aside>" + "</div>" * 5000 + "<p>more text", []) == "text\nmore text"
    source = (
        "<article><p>Let <math><mi>x</mi></math> hold</p><p class='alert'>Important words.</p>"
        "<div class='share-price'>The price of a share is 7.</div><object>shown as text</object></article>"
    )
    assert extract(source, []) == "Let x hold\nImportant words.\nThe price of a share is 7.\nshown as text"
    parts = "<div class=one><p>" + "first part " * 9 + "</div><div class=ads>buy</div><div class=two><p>" + "second part " * 9 + "</div>"
    assert extract(parts, []) == f"{'first part ' * 8}first part\n{'second part ' * 8}second part"
    titled = "<header>Site</header><div class=head-line><h1>The title</h1></div><div class=story><p>" + "words of the story " * 9 + "</div>"
    assert extract(titled, []) == f"The title\n{'words of the story ' * 8}words of the story"
    apart = "<div class=story><h2>Part</h2>" + "".join(f"<div class=para><p>{k} words of a paragraph" for k in ("<b>x</b>", "y")) + "<div class=quote>said</div></div>"
    assert extract(apart.replace("paragraph<div", "paragraph</div><div"), []).splitlines()[0] == "Part"


def test_votes_confirm_a_place_with_a_suspect_name(spark):
    page = "<div class=widget><p>{0}</p><div class=comments><p>{1}</p></div></div><div class=sidebar>{2}</div>"
    rows = [(i, "http://w.example/", page.format("the article itself " * 5, "what readers say " * 30, "beside")) for i in range(5)]
    assert {r.text for r in extract_pages(pages_of(spark, rows)).collect()} == {"the article itself " * 4 + "the article itself"}


def random_layout(rng):
    """A page's frame with two slots, and whether it is the article's own container that has a class."""
    junk = [
        "<nav><a href=/>menu</a></nav>", "<aside>beside</aside>", "<div class='site-footer'>foot</div>", "<ul class=related><li>see also</ul>",
        "<div id=cookie-notice>cookies</div>", "<form><p>mail</p></form>", "<div class='adBox'>buy</div>", "<section class=comments><p>readers say</section>",
        "<script>var a = '<p>';</script>", "<!-- <p>hidden -->", "<div role=banner>logo</div>", "<dialog>notice</dialog>",
    ]
    some = lambda: "".join(rng.sample(junk, rng.randint(0, 4)))
    box = rng.choice(["article", "main", "div class='post-{2} body'", "div class=story", "section id=s{2}", "div"])
    name = box.split()[0]
    frame = f"{some()}<{box}>{{0}}{some()}{{1}}</{name}>{some()}"
    for _ in range(rng.randint(0, 3)):
        outer = rng.choice(["div", "div class=wrap", "section class=outer-{2}", "center"])
        frame = f"<{outer}>{frame}</{outer.split()[0]}>{some()}"
    return f"<html><head><title>x</title></head><body class=single-sidebar><header>site</header>{frame}</body></html>"


def plain_text(rows):
    """The same consensus by dictionaries, page after page."""
    hosts = {}
    for _, url, source in rows:
        tally = hosts.setdefault(url.split("/")[2], {})
        for path, v in Page(source).votes().items():
            tally[path] = tally.get(path, 0) + v
    out = {}
    for i, url, source in rows:
        votes = hosts[url.split("/")[2]]
        winning = [p for p, v in votes.items() if v >= WINNING_SHARE * sum(votes.values())]
        around = [q for p in winning if (q := parent_path(p)) is not None and votes.get(q, 0) > 0]
        out[i] = extract(source, winning, around)
    return out


def test_random_layouts(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for h in range(30):
        frame = random_layout(rng)
        for k in range(6):
            (first, a), (second, b) = article(rng), article(rng)
            i = 100 * h + k
            rows.append((i, f"https://h{h}.example/{k}", frame.format(first, second.replace("h1>", "h2>"), i)))
            want[i] = f"{a}\n{b}"
    got = {r.page_id: r.text for r in extract_pages(pages_of(spark, rows).repartition(5)).collect()}
    assert got == plain_text(rows)
    assert got == want


def test_a_page_deals_one_vote():
    votes = Page("<div class=a1>some words<p>more</div><div class=a2>others<ul><li>x</ul></div><a href=/>link</a>").votes()
    assert set(votes) == {"div.a#", "div.a#>ul"} and abs(sum(votes.values()) - VOTE) <= 2
    assert Page("<a href=/>only a link</a>").votes() == {}


def test_broken_markup_ends_in_time():
    start = time.time()
    hard = ["<", "<p", "a < b", "<p>x<!-- y", "<script>x", "<div" * 5000, "<p>" * 5000, "<b>" * 5000 + "</i>" * 5000]
    hard += ["<div>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 20_000 + "<li>" * 20_000, '<a "b>' * 3000, "<p>words " * 100_000]
    for source in hard:
        extract(source, ["div"])
        Page(source).votes()
    assert time.time() - start < 30
    assert [b.text for b in Page("<p>one<p>two <i>three</p>four").blocks] == ["one", "two three", "four"]


def texts_of(spark, sources):
    rows = [(k, f"https://one.example/{k}", s) for k, s in enumerate(sources)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_a_lead_beside_the_body_stays(spark):
    words = lambda k, n: " ".join(f"word{k}x{j}" for j in range(n))
    page = lambda k: f"<body><div class=top>{words('t', 3)}</div><main><div class=lede>Lead {k}.</div><div class=content><p>{words(k, 120)}</p></div></main></body>"
    assert texts_of(spark, map(page, range(5))) == [f"Lead {k}.\n{words(k, 120)}" for k in range(5)]


def test_a_form_around_the_page_is_no_form_of_it(spark):
    body = "<nav>Menu</nav><div class=content><p>First words.</p><p>Second words.</p><input value=x><select><option>No</select></div><footer>Foot</footer>"
    login = "<form><p>Sign in</p><input name=user><button>Go</button></form>"
    assert texts_of(spark, [f"<body><form action=x>{body}</form></body>", f"<body>{login}</body>"]) == ["First words.\nSecond words.", ""]
    # a form beside text is left out as before
    assert texts_of(spark, [f"<body><div class=content><p>Text.</p></div>{login}</body>"]) == ["Text."]
