"""Small pages of different layouts with the text that a reader would call the article."""

from __future__ import annotations

import time

import pytest

from setloom.llm.extract import extract_text, main_text, parse

ONE = "A first paragraph of the story, long enough to count, with commas, and more."
TWO = "And a second one, that goes on for a while, as stories do."
P = f"<p>{ONE}</p><p>{TWO}</p>"
STORY = f"{ONE}\n{TWO}"
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>"
TALK = "<p>I like this very much, indeed, and so does my cat, my dog, and all of us.</p>" * 6

LAYOUTS = {
    "plain article": (f"<nav>{MENU}</nav><article><h1>T</h1>{P}</article><footer>f</footer>", f"T\n{STORY}"),
    "no class names": (f"<div>{MENU}</div><div><h1>T</h1>{P}</div>", f"T\n{STORY}"),
    "bare paragraphs": (P, STORY),
    "name of furniture in an article's class": (f"<article class='share-price-report'>{P}</article>", STORY),
    "whole furniture name on an article": (f"<article class='story related'>{P}</article>", STORY),
    "form in an article's class": (f"<article class='form-analysis'>{P}</article>", STORY),
    "search in a div's class": (f"<div class='entry-content search-results-explained'>{P}</div>", STORY),
    "notice holds the text": (f"<div class=notice>{P}</div>", STORY),
    "whole page in a form": (f"<form id=aspnetForm><div class=menu>{MENU}</div><div>{P}</div></form>", STORY),
    "sidebar in the page's class": (f"<div class='page with-sidebar'><div class=sidebar>{MENU}</div><div class=content>{P}</div></div>", STORY),
    "lead and heading beside the content": (f"<div class=wrap><h1>T</h1><p class=lead>Lead.</p><div class=content>{P}</div><h2>After</h2></div>", f"T\nLead.\n{STORY}\nAfter"),
    "header inside the article": (f"<article><header><h1>T</h1><p>Lead</p></header><div class=body>{P}</div></article>", f"T\nLead\n{STORY}"),
    "named header inside the article": (f"<article><div class='article-header'><h1>T</h1></div>{P}</article>", f"T\n{STORY}"),
    "site header": (f"<header><h1>Site</h1></header><div class=site-header>Site</div><main>{P}</main>", STORY),
    "advert and cookie notice": (f"<div class=cookie-notice>We use cookies</div><div class=ad>Buy</div><article>{P}<div class='ad-box'>Buy more</div></article>", STORY),
    "more comments than article": (f"<div class=content>{P}</div><section id=comments>{TALK}</section>", STORY),
    "comments that are articles": (f"<main>{P}<article class=comment>{TALK}</article></main>", STORY),
    "more advert than article": (f"<div class=ad>{P}</div><article><h1>T</h1><p>Short.</p></article>", "T\nShort."),
    "hidden and roles": (f"<div role=navigation>x</div><div hidden>h</div><p style='display:none'>n</p><article>{P}<div aria-hidden=true>i</div></article>", STORY),
    "sections side by side": (f"<div class=story><section><p>{ONE}</p></section><section><p>{TWO}</p></section></div>", STORY),
    "articles side by side": (f"<article class=part>{P}</article><article class=part><p>{ONE}</p></article>", f"{STORY}\n{ONE}"),
    "list and quote": (f"<article>{P}<ul><li>one<li>two</ul><blockquote>said</blockquote></article>", f"{STORY}\none\ntwo\nsaid"),
    "table": (f"<main>{P}<table><tr><td>a<td>b</table></main>", f"{STORY}\na\nb"),
    "references and white space": ("<article><p>Caf&eacute;\n &amp;\t co, that is a story, one, two, three</p></article>", "Café & co, that is a story, one, two, three"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, want = LAYOUTS[name]
    assert main_text(f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>", None) == want


def test_the_hosts_path_decides_between_containers_apart():
    page = f"<body><div id=a class=talk>{TALK}</div><div class=story>{P}</div>"
    assert main_text(page, "body>div.story") == STORY
    assert main_text(page, None) != STORY
    nested = f"<body><div class=outer><p>Lead.</p><div class=story>{P}</div></div>"
    assert main_text(nested, "body>div.outer>div.story") == f"Lead.\n{STORY}"
    assert main_text(f"<body><article>{P}</article><article class=other><p>x</p></article>", "body>article.other") == STORY


TOPICS = "harbour violin glacier orchard lantern saddle compass meadow".split()


def article(host: str, i: int) -> tuple[list[str], list[str]]:
    """(heading, paragraphs) that no other page has."""
    t = TOPICS[i % len(TOPICS)]
    return f"The {t} of {host} {i}", [f"Paragraph {k} about the {t}, number {i}, as told on {host}, with details, dates, and a few names." for k in range(3 + i % 3)]


def paragraphs(lines: list[str]) -> str:
    return "".join(f"<p>{x}</p>" for x in lines)


TEASERS = [f"Another story that we like, teaser {k}, with a line or two about it, and a date." for k in range(6)]


def german(i, head, lines):
    side = "<div class=seitenleiste><p>Meistgelesen, heute und gestern, auf einen Blick, fuer alle.</p><p>Wetter, Verkehr, Termine</p></div>"
    return f"<div class=kopfzeile>Unsere Zeitung</div><div class=inhalt><h1>{head}</h1>{paragraphs(lines)}</div>{side}<div class=fusszeile><p>Impressum, Datenschutz, Kontakt</p></div>"


def nameless(i, head, lines):
    return f"<div><div>Welcome to our site, dear reader, stay a while</div></div><div><div><h1>{head}</h1></div><div><section>{paragraphs(lines)}</section></div></div><div><div><span>Imprint, contact, and so on</span></div></div>"


def inside_the_article(i, head, lines):
    teasers = "".join(f"<div class=karte>{TEASERS[(i + k) % 6]}</div>" for k in range(3))
    return f"<article><h1>{head}</h1>{paragraphs(lines[:2])}<div class='newsletter-signup-inline'><b>Sign up now, it is free, and weekly</b></div>{paragraphs(lines[2:])}<div class='related-stories'>{teasers}</div></article>"


def teasers_beside(i, head, lines):
    teasers = "".join(f"<p>{TEASERS[(i + k) % 6]}</p>" for k in range(2))
    return f"<div><div><h2>{head}</h2>{paragraphs(lines)}</div><div><aside>x</aside><div>{teasers}</div></div></div>"


def talk_beside(i, head, lines):
    said = [f"I was there in the year {i}, and I liked visit {k} a lot, really, more than my neighbour did, or does, or will." for k in range(7)]
    return f"<div class=eintrag><h1>{head}</h1>{paragraphs(lines)}</div>" + (f"<ol class=c-list>{''.join(f'<li><div>{x}</div></li>' for x in said)}</ol>" if i % 4 == 1 else "")


HOSTS = {"german": german, "nameless": nameless, "inside": inside_the_article, "teasers": teasers_beside, "talk": talk_beside}


def test_the_votes_clean_planted_hosts(spark):
    rows, want = [], {}
    for h, (host, layout) in enumerate(HOSTS.items()):
        for i in range(8):
            head, lines = article(host, i)
            rows.append((100 * h + i, f"https://{host}.example/p/{i}", f"<html><head><title>x</title></head><body>{layout(i, head, lines)}</body></html>"))
            want[100 * h + i] = "\n".join([head, *lines])
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page, _, _ in rows:
        assert got[page] == want[page], page
    changed = [page for page, _, html in rows if main_text(html, None) != want[page]]
    assert len(changed) >= 4 * len(rows) // 5 - 10  # the pages alone don't tell


def test_copies_make_no_furniture(spark):
    head, lines = article("copies", 1)
    body = f"<div class=b><h1>{head}</h1>{paragraphs(lines)}</div>"
    rows = [(i, "https://copies.example/", f"<body>{body}<p>Visitor {i}</p>") for i in range(6)] + [(10, "https://copies.example/", f"<body>{body}")]
    rows += [(20 + i, "https://few.example/", f"<body><div class=x>Same line, here too</div><div class=b>{paragraphs(article('few', i)[1])}</div>") for i in range(2)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].startswith("\n".join([head, *lines]))
    assert got[10] == "\n".join([head, *lines])
    assert all("\n".join(article("few", i)[1]) in got[20 + i] for i in range(2))


def test_deep_markup_takes_linear_time():
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        assert main_text("<div>t " * n + "deep" + "</div>" * n, "div>div").endswith("deep")
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
    assert len(parse("<div>" * 5000).tag) == 5001
