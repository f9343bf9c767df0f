"""Hand-written page layouts, with names that the training pages do not use, against their article's text."""

import re
import time
import tracemalloc

import numpy as np
import pytest

from quillstone.llm import html_main, html_samples
from quillstone.llm.html_blocks import blocks

TITLE = "Storm closes the coastal road for a week"
PARAGRAPHS = [
    "The council said on Monday that the road between the two harbours will stay closed until engineers have looked at the cliff.",
    "Residents were told to use the inland route, which adds about forty minutes to the journey.",
    "No one was hurt, but two parked cars were damaged by falling stones, and the bus line has been suspended.",
    "A decision on repairs is expected next month. Until then the footpath stays shut as well.",
    "Shop owners in the old town fear for the season, since most of their customers come by that road.",
]
H, P = f"<h1>{TITLE}</h1>", "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
A, LINKS = H + P, "<li><a href='/a'>Home</a></li><li><a href='/b'>Local</a></li><li><a href='/c'>Weather</a></li><li><a href='/d'>Contact</a></li>"
NAV = f"<ul class='mainnav'>{LINKS}</ul>"
CMTS = "<div class='cmts'><h3>2 comments</h3><div class='cmt'><b>Joan wrote:</b><p>About time they did something there.</p></div><div class='cmt'><b>Pete wrote:</b><p>The inland route is no better, I tried it.</p></div></div>"
FOOT = "<div class='pagefoot'>Copyright 2024 The Harbour Post. All rights reserved. <a href='/p'>Privacy</a></div>"
SIDE = "<div class='railbox'><h4>Most read</h4><ul><li><a href='/1'>Ferry timetable changes</a></li><li><a href='/2'>Old mill for sale</a></li></ul></div>"
COOKIE = "<div id='cookiewall'>We use cookies to improve your experience. <button>Accept</button></div>"
AD = "<div class='advt'>Advertisement: buy one sofa now, get a chair free!</div>"
SIGN = "<form action='/n'><label>Your email</label><input><button>Subscribe</button></form>"
WHOLE = " ".join([TITLE, *PARAGRAPHS])
BODY = " ".join(PARAGRAPHS)

#: (markup of the body, text of the article)
LAYOUTS = [
    (f"<div class='masthead-bar'>The Harbour Post</div>{NAV}<div class='story-wrap'>{A}</div><div class='rail'>{SIDE}</div>{CMTS}{FOOT}", WHOLE),
    (f"<div id='wrapper'><div class='container'><nav><ul>{LINKS}</ul></nav><article class='single'>{A}</article><footer>Copyright 2024</footer></div></div>", WHOLE),
    (f"<div class='container'><div class='row'><article>{A}</article></div></div>", WHOLE),
    (f"<div class='container-fluid'><div class='row'><div class='col-md-8'><article>{A}</article></div><div class='col-md-4'>{SIDE}</div></div></div>{FOOT}", WHOLE),
    (f"<header class='hd'><h2>The Harbour Post</h2></header><main class='mn'>{A}</main><footer class='ft'>Imprint | Contact</footer>", WHOLE),
    (f"{COOKIE}<nav>{NAV}</nav><section class='lead-story'>{A}</section>{FOOT}", WHOLE),
    (f"<div id='shell'><div id='top'>{NAV}</div><div id='mid'><div class='article-wrap'>{A}</div></div><div id='end'>{FOOT}</div></div>", WHOLE),
    (f"<article><header>{H}</header><div class='txt'>{P}</div></article><aside>{SIDE}</aside>", WHOLE),
    (f"<article>{H}<div class='prose'>{P}</div>{AD}</article>{CMTS}", WHOLE),
    (f"<div class='page-shell'><article>{A}</article><section class='comments-area'><h2>Comments</h2><ol><li><p>I like this road. Reply</p></li><li><p>So do I. Reply</p></li></ol></section></div>", WHOLE),
    (f"<table width='100%'><tr><td class='leftnav'><a href='/'>Home</a><br><a href='/x'>Archive</a></td><td class='maincell'>{A}</td></tr></table>", WHOLE),
    (f"<div class='entry-wrap'>{A}</div>", WHOLE),
    (f"{NAV}<div class='blog-post hentry'>{A}</div><div class='sharebar'><a href='#'>Share</a> <a href='#'>Tweet</a></div>{FOOT}", WHOLE),
    (f"<div class='topstrip'><a href='/'>Log in</a> <a href='/'>Register</a></div><article id='post-12'>{A}</article><div class='widget-area'>{SIDE}</div>", WHOLE),
    (f"<main><article>{H}{PARAGRAPHS[0]}<p>{PARAGRAPHS[1]}<p>{PARAGRAPHS[2]}<p>{PARAGRAPHS[3]}<p>{PARAGRAPHS[4]}</article></main>{FOOT}", WHOLE),
    (f"<main role='main'><div class='wrap'><div class='inner-wrap'>{A}</div></div></main><div role='contentinfo'>Copyright 2024 | Terms</div>", WHOLE),
    (f"<div class='gdpr-layer'><p>This site uses cookies. Privacy settings</p></div><div class='site-inner'><main>{A}</main></div>", WHOLE),
    (f"<body class='home'><div class='l-page'><div class='l-head'>{NAV}</div><div class='l-main'><article class='c-article'>{A}</article></div><div class='l-foot'>{FOOT}</div></div>", WHOLE),
    (f"<article>{A}</article><div class='newsletter-box'>{SIGN}</div>{FOOT}", WHOLE),
    (f"<article>{H}<p>{PARAGRAPHS[0]}</p>{AD}<p>{PARAGRAPHS[1]}</p><aside class='pull'><h4>Related</h4><a href='/z'>Read more news</a></aside>{''.join(f'<p>{p}</p>' for p in PARAGRAPHS[2:])}</article>", WHOLE),
    (f"<div class='menu-bar'><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a></div><div class='article-content-main'>{A}</div>", WHOLE),
    (f"<div id='page-top'>{NAV}</div><div id='page-middle'><section><article class='post type-post'>{A}</article></section>{SIDE}</div>", WHOLE),
    (f"<div class='outerbox'><div class='innerbox'><div class='box'><div class='post-text'>{A}</div></div></div></div><div class='footerlinks'><a href='/t'>Terms</a> <a href='/c'>Contact</a></div>", WHOLE),
    (f"<nav class='crumbs'><a href='/'>Home</a> / <a href='/n'>News</a></nav><article class='news-item'>{A}</article><div class='tagcloud'><a href='/t1'>road</a> <a href='/t2'>storm</a></div>", WHOLE),
    (f"<div class='skip'><a href='#m'>Skip to content</a></div><header>{NAV}</header><main id='m'>{A}</main><footer>{FOOT}</footer>", WHOLE),
    (f"<article class='story'>{H}<ul><li>{PARAGRAPHS[0]}</li><li>{PARAGRAPHS[1]}</li></ul><blockquote>{PARAGRAPHS[2]}</blockquote><p>{PARAGRAPHS[3]}</p><h2>{PARAGRAPHS[4]}</h2></article>{CMTS}{FOOT}", WHOLE),
    (f"<div class='modal-window'><p>Sign up for our newsletter today</p></div><div class='wrapper-all'><article>{A}</article></div>", WHOLE),
    (f"<div class='promo-strip'>Sale! Click here for a free offer</div><article>{A}</article>{AD}{FOOT}", WHOLE),
    (f"<noscript>Turn on scripts</noscript><script/>var a='<p>no</p>'</script><article>{A}</article><!-- end", WHOLE),
    (f"<div><div><div><article>{A}</article></div></div></div>{CMTS}", WHOLE),
    (f"<section class='page-body'><article>{A}</article></section><section class='more-news'><h3>More news</h3><ul>{LINKS}</ul></section>", WHOLE),
    (f"<div class='hdr'><a href='/'>Harbour Post</a></div><main><article>{A}</article><div class='user-cmts'><h3>Comments</h3><article class='cmt'><p>Nice to read. Reply</p></article></div></main>", WHOLE),
    (f"<center><font size='2'><div class='articlebody'>{A}</div></font></center><div class='copyrightline'>Copyright 2001 all rights reserved</div>", WHOLE),
    (f"<main><section class='hero'>{H}</section><section class='copytext'>{P}</section></main><footer><p>Contact | Privacy | Terms</p></footer>", WHOLE),
    (f"<article><h1><a href='/x'>{TITLE}</a></h1>{P}</article><nav class='pages'><a href='/1'>Previous</a> <a href='/2'>Next</a></nav>", WHOLE),
    (f"<div class='loginbox'>{SIGN}</div><article class='text-article'>{P}</article><div class='sidebox'>{SIDE}</div>{FOOT}", BODY),
]


def test_names_of_the_layouts_are_held_out():
    known = {x.partition(".")[2] or x.partition("#")[2] for k, v in vars(html_samples).items() if k.isupper() and k[0] != "_" and isinstance(v, list) for x in v}
    used = {n for html, _ in LAYOUTS for x in re.findall(r"(?:class|id)='([^']*)'", html) for n in x.split()}
    assert len(LAYOUTS) >= 30 and len(used - known) >= 0.8 * len(used)


def test_layouts():
    pages = [f"<!DOCTYPE html><html><head><title>{TITLE} - The Harbour Post</title><style>p{{}}</style></head><body>{html}</body></html>" for html, _ in LAYOUTS]
    got = html_main.main_texts(pages, html_main.labeller())
    wrong = [(i, g) for i, (g, (_, want)) in enumerate(zip(got, LAYOUTS, strict=True)) if g != want]
    assert len(wrong) <= 0.05 * len(LAYOUTS), wrong


BROKEN = {"<div>x": 80_000, "<b>x<p>y</p>": 40_000, "<a href='x>y": 40_000, "<!-- a ": 140_000, "<table><tr><td>x": 30_000, '<p class="x': 90_000, "<": 1_000_000}


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_pages_take_linear_time(piece):
    """Twice the page takes about twice the time: four times would be quadratic. The best of some runs counts."""
    net = html_main.labeller()

    def took(n):
        began = time.process_time()
        html_main.main_texts([piece * n], net)
        return time.process_time() - began

    n = BROKEN[piece]
    assert any(took(n) < 3 * took(n // 2) + 0.2 for _ in range(4))


def test_long_pages_are_read_as_short_ones_are(monkeypatch):
    net = html_main.labeller()
    page = "".join(f"<div class='c{i % 7}'>{'word ' * (i % 9)}</div><p>Text no. {i}, <a href='/'>with {i % 5} links</a></p>" for i in range(900))
    found = blocks(page)
    want = net.run(html_main.vectors(found) @ net.w + net.b, np.array([len(found)]))
    for piece in (100, 256, 5000):
        monkeypatch.setattr(html_main, "PIECE", piece)
        assert html_main._long_page(found, net) == pytest.approx(want, abs=2e-3)


def test_memory_of_long_pages_is_bounded():
    """What a page of a million open tags takes beside its own size."""
    page, net = "<div>x" * 350_000, html_main.labeller()
    tracemalloc.start()
    html_main.main_texts([page], net)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(page)


def test_weights_are_of_these_pages_and_settings():
    with np.load(html_main.WEIGHTS) as kept:
        assert str(kept["recipe"]) == html_main.recipe()
    small = [html_main.fit(pages=30).params() for _ in range(2)]
    assert all((a == b).all() for a, b in zip(*small, strict=True))


def test_nothing_of_the_markup_is_text():
    for html, want in [
        ("<!-- x", []), ("<!-->x", ["x"]), ("<!--->y", ["y"]), ("<script/>text</script>z", ["z"]), ("<a href='x>y</a>", ["y"]), ("<SCRIPT>a</SCRIPT >b", ["b"]),
        ("<p class=\"a b' id=c>t", ["t"]), ("a < b <3 c", ["a < b <3 c"]), ("x<?php z?>y</>w</ q>v", ["xywv"]), ("<textarea>no</textarea><style>p{}", []), ("<svg/>q<svg><text>no</text></svg>r", ["qr"]),
        ("&lt;p&gt; &amp;copy; &copy &#x41;&#66;", ["<p> &copy; © AB"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
    ]:
        assert [b.text for b in blocks(html)] == want, html
