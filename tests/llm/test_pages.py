"""Address rules and main text."""

import random

from backtrail.llm import html_text, url_rules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("", "/ad/", "block"), ("b.example.org", "/es/x", "allow"), ("com", "/de/", "allow")]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
    m = min([k for k in (rest.find("?", n), rest.find("#", n)) if k >= 0] or [len(rest)])
    return host, rest[n:m]


def verdict(host, path):
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in RULES
           if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, "allow")


def test_rules_against_every_pair(spark, frame):
    r = random.Random(2)
    hosts = ["org", "example.org", "b.example.org", "a.b.example.org", "xexample.org", "com", "x.com", "X.COM", "net", "example.org.", ""]
    paths = ["", "/", "/es/", "/es/x1", "/en/1", "/en/12", "/fr/a", "/de/", "/ad/1", "/es", "/de/?q=/fr/", "/fr#x"]
    urls = [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(400)] + ["http://x.com/de/1"] * 200
    urls += [None, "", "no scheme/de/", "a://b://c.com/de/", "http://a.org?x=/y", "http://a.org/\nb", "http://é.com/fr/"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(None, "http://a.org/"), (2**60 + 1, "http://a.com/de/")]
    pages = frame(rows, "page_id long, url string")
    got = url_rules.judge(pages, url_rules.rule_table(spark, RULES), parts=7).collect()
    assert len(got) == len(rows)
    wanted = sorted(repr((k, *plain(u), *verdict(*plain(u)))) for k, u in rows)
    assert sorted(repr((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"])) for x in got) == wanted


def test_empty_tables(spark, frame):
    none = frame([], "page_id long, url string")
    rules = url_rules.rule_table(spark, RULES)
    assert url_rules.judge(none, rules).collect() == []
    one = frame([(1, "http://a.org/")], "page_id long, url string")
    assert [r["verdict"] for r in url_rules.judge(one, rules.limit(0)).collect()] == ["allow"]


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body>
<header class=top>Site name</header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav><!-- ad --><div class="cookie-notice">We
use cookies, really.</div><div id=main><h1>A &lt;title&gt; &eacute;</h1><p>First   paragraph, which is
<b>fairly</b> long, with commas.<p>Short.<div class="advert">Buy now, it is cheap, very cheap.</div><ul><li>one<li>two</ul>
<form><input><p>Write to us, please do.</p></form><aside>By the way, some more.</aside></div>
<section class="comments"><p>I liked this text a lot, more than others, and say so at length, with many words and commas, too.</p></section>
<footer>&copy; 2020</footer>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "A <title> é\nFirst paragraph, which is fairly long, with commas.\nShort.\none\ntwo"


LONG = "A sentence of some length, with a comma, and with one more. "


def page(*parts):
    return "<html><body><nav><a href=/>Home</a></nav>" + "".join(parts) + "<footer>Owner</footer></body></html>"


def test_title_and_lead_beside_the_body():
    body = "<p>" + LONG * 6 + "</p><p>" + LONG * 6 + "</p>"
    for lead in (LONG * 3, "Short lead."):
        for outer in ("article", "div class=post"):
            parts = f"<{outer}><h1 class=entry-title>The title</h1><div class=lead><p>{lead}</p></div><div class=entry-content>{body}</div></{outer.split()[0]}>"
            text = html_text.main_text(page(parts))
            assert text.split("\n") == ["The title", lead.strip(), (LONG * 6).strip(), (LONG * 6).strip()], (lead, outer)


def test_passing_blocks_in_two_containers():
    halves = [f"<div class={c}><p>{w} {LONG * n}</p><p>{w} {LONG * n}</p></div>" for c, w, n in (("intro", "One", 3), ("rest", "Two", 9))]
    text = html_text.main_text(page("<div>", *halves, "</div>"))
    assert text.count("One") == 2 and text.count("Two") == 2


def test_a_list_stays_and_a_far_notice_goes():
    items = "".join(f"<li>item {k}</li>" for k in range(30))
    parts = f"<article><p>{LONG * 6}</p><ul>{items}</ul><p>{LONG * 6}</p><div class=x1>Order now</div></article>"
    text = html_text.main_text(page(parts))
    assert text.count("item") == 30 and "Order" not in text


def test_a_name_does_not_take_the_article_along():
    body = f"<p>{LONG * 6}</p><p>Short, but said.</p><p>{LONG * 6}</p>"
    for name in ("id='content-sidebar-wrap'", "class='post-and-comments'", "class='side-effects'", "role='search form'"):
        beside = f"<section class=comments><p>{LONG * 2}</p></section>"
        for inner in (body, f"<article>{body}</article>"):
            text = html_text.main_text(page(f"<div {name}>{inner}{beside}</div>"))
            assert text.split("\n") == [(LONG * 6).strip(), "Short, but said.", (LONG * 6).strip()], name
    nested = f"<article><h1>Title</h1><div class='side-effects'>{body}</div><div class=share><p>{LONG}</p></div></article>"
    assert html_text.main_text(page(nested)).split("\n") == ["Title", (LONG * 6).strip(), "Short, but said.", (LONG * 6).strip()]


def test_a_form_around_the_page_stays_and_a_form_in_it_goes():
    body = f"<div><p>{LONG * 4}</p><p>{LONG * 5}</p></div>"
    for parts in (f"<form id=x>{body}</form>", f"<form id=x><fieldset>{body}</fieldset><input></form>",
                  f"<form><article>{body}</article></form>", f"{body}<form><p>Your name, please, and your address.</p></form>"):
        assert html_text.main_text(page(parts)).split("\n") == [(LONG * 4).strip(), (LONG * 5).strip()], parts


def test_names_that_only_begin_like_an_advert_do_not_count():
    three = "<p>" + LONG * 3 + "</p>"
    for part in (f"<section id=side-effects>{three}</section>", f"<section class='related-work'>{three}</section>", f"<div class=share-price>{three}</div>"):
        text = html_text.main_text(page(f"<article><p>{LONG * 6}</p>{part}<p>{LONG * 6}</p></article>"))
        assert text.split("\n") == [(LONG * 6).strip(), (LONG * 3).strip(), (LONG * 6).strip()], part
    for name in ("ad-slot-3", "cookieNotice", "comments-section", "social-media-links", "newsletter_box"):
        text = html_text.main_text(page(f"<article><p>{LONG * 6}</p><div class='{name}'>{three}</div><p>{LONG * 6}</p></article>"))
        assert text.split("\n") == [(LONG * 6).strip(), (LONG * 6).strip()], name


def test_a_quote_that_never_ends_puts_no_markup_into_the_text():
    text = html_text.main_text(f"<body><p>{LONG * 4}</p><p title=\"abc>{LONG * 4}</p><p>{LONG}</p></body>")
    assert text.split("\n") == [(LONG * 4).strip()] * 2 + [LONG.strip()]
    assert html_text.main_text("<p>1 < 2, and 3 <4, he said</p>") == "1 < 2, and 3 <4, he said"


def plain_paths(found):
    """The ratios written out path by path: length and punctuation of a path's blocks, smoothed along the paths, fused."""
    paths = []
    for b in found:
        if b.path not in paths:
            paths.append(b.path)
    own = [[b for b in found if b.path == p] for p in paths]
    length = [sum(len(b.text) for b in x) / len(x) for x in own]
    marks = [sum(c in ".,;:!?…。、，！？；：" for b in x for c in b.text) / len(x) for x in own]
    chars = [sum(len(b.text) for b in x) for x in own]
    links = [sum(min(b.linked, len(b.text)) for b in x) for x in own]

    def smooth(v, k):
        return (v[max(k - 1, 0)] + 2 * v[k] + v[min(k + 1, len(v) - 1)]) / 4

    fused = [smooth(length, k) * (1 + smooth(marks, k)) * (1 - links[k] / max(chars[k], 1)) ** 2 * chars[k] ** 0.5 for k in range(len(paths))]
    mean = sum(fused) / len(fused)
    limit = min((sum((f - mean) ** 2 for f in fused) / len(fused)) ** 0.5, max(fused) / 2)
    return {p for p, f in zip(paths, fused) if f > 0 and f >= limit * (1 - 1e-12)}


def test_ratios_equal_a_plain_computation():
    r = random.Random(6)
    for _ in range(60):
        parts = [f"<{t} class=c{r.randint(0, 3)}>{r.choice(['', '<a href=/>x y z</a> '])}{'word, ' * r.randint(1, 40)}</{t}>"
                 for t in r.choices(["p", "div", "li", "section"], k=r.randint(1, 12))]
        found = html_text.blocks("<div>" + "".join(parts) + "</div>")
        assert html_text.content_paths(found) == plain_paths(found)


def test_a_named_list_stays_out():
    cards = "".join(f"<article><p>Card {k}.</p></article>" for k in range(4))
    text = html_text.main_text(page(f"<article><p>{LONG * 6}</p></article><div class=related>{cards}</div>"))
    assert text == (LONG * 6).strip()


def test_pages_that_are_odd(frame):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<p>", "x"), (4, None, "just text", "x"), (None, "u", "<a <b <<c>", "x"),
            (5, "u", "<article><p>" + "Long text. " * 20_000 + "</article>", "x"), (5, "u", "<script>never closed", "x"),
            (6, "u", "<p class='a" + "<div>" * 3000, "x")]
    pages = frame(rows, "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["html"]): r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[1, None]["text"] == "" and got[2, ""]["n_chars"] == 0 and got[4, "just text"]["text"] == "just text"
    long = got[5, rows[5][2]]
    assert long["text"] == ("Long text. " * 20_000).strip() and long["n_chars"] == len(long["text"])
    assert html_text.extract(pages.limit(0)).collect() == []
