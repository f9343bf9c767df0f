"""More hand-written layouts, written before the labeller was fitted anew and not looked at while that was done."""

from quillstone.llm import html_main

HEAD = "Library opens its new reading room"
TEXT = [
    "The reading room on the first floor has places for sixty people and stays open until ten in the evening.",
    "Anyone with a library card can use it, and school classes may book it for a morning.",
    "The work took eleven months, two more than planned, because the old beams had to be replaced.",
    "Money for the furniture came from readers, who gave about nine thousand in small sums.",
]
H, P = f"<h1>{HEAD}</h1>", "".join(f"<p>{t}</p>" for t in TEXT)
ALL, BODY = " ".join([HEAD, *TEXT]), " ".join(TEXT)
MENU = "<a href='/'>Start</a> | <a href='/town'>Town</a> | <a href='/county'>County</a> | <a href='/ads'>Small ads</a>"
LIST = "<ul><li><a href='/'>Start</a></li><li><a href='/town'>Town</a></li><li><a href='/county'>County</a></li></ul>"
LEGAL = "Copyright 2019 Weekly Mirror. All rights reserved."
ASIDE = "<h3>Also read</h3><ul><li><a href='/8'>Swimming pool stays shut</a></li><li><a href='/9'>New bus stop at the mill</a></li></ul>"
TALK = "<h4>3 comments</h4><div class='x9'><span>Ann</span><p>Lovely place, thanks to all.</p></div><div class='x9'><span>Bob</span><p>Too loud for me.</p></div>"

#: (markup of the body, text of the article)
LAYOUTS = [
    ("<article><p>Closed today.</p></article>", "Closed today."),
    ("<nav><a href='/'>Start</a></nav><main><p>Nothing new this week.</p></main><footer>Imprint</footer>", "Nothing new this week."),
    (f"<main><h1>{HEAD}</h1></main><footer>{LEGAL}</footer>", HEAD),
    (f"<table><tr><td colspan=2>{MENU}</td></tr><tr><td>{LIST}</td><td>{H}{P}</td></tr><tr><td colspan=2>{LEGAL} <a href='/i'>Imprint</a></td></tr></table>", ALL),
    (f"<div class='css-1a2b3c'>{LIST}</div><article class='css-9z8y7x'>{H}{P}</article><div class='css-4d5e6f'>{TALK}</div>", ALL),
    (f"<article><h1>{HEAD}</h1><a title=\"x > y\"class='z' href='/q'></a>{P}</article>", ALL),
    (f"<article>{H}<object data='a.swf'>{TEXT[0]}</object><p>{TEXT[1]}</p><video><p>{TEXT[2]}</p></video><canvas>{TEXT[3]}</canvas></article>", ALL),
    (f"<header><a href='/'>Weekly Mirror</a></header><nav>{LIST}</nav><article>{H}{P}</article><footer>{LEGAL}</footer>", ALL),
    (f"<div id='kopf'>{MENU}</div><div id='inhalt'><article>{H}{P}</article></div><div id='fuss'>{LEGAL}</div>", ALL),
    (f"<main>{H}{P}<section class='reader-voices'>{TALK}</section></main>", ALL),
    (f"<div class='ribbon'>We value your privacy. Accept cookies</div><main>{H}{P}</main>", ALL),
    (f"<article>{H}<p>{TEXT[0]}</p><div class='adbox'>Advertisement</div><p>{TEXT[1]}</p><p>{TEXT[2]}</p><p>{TEXT[3]}</p></article>", ALL),
    (f"<section role='navigation'>{LIST}</section><section role='main'>{H}{P}</section>", ALL),
    (f"<article>{H}{P}</article><aside>{ASIDE}</aside>", ALL),
    (f"<div class='sheet'><div class='left'>{ASIDE}</div><div class='center'><article>{H}{P}</article></div></div>", ALL),
    (f"<article>{H}<dl><dt>{TEXT[0]}</dt><dd>{TEXT[1]}</dd></dl><p>{TEXT[2]}</p><p>{TEXT[3]}</p></article>", ALL),
    (f"<article>{H}<table><tr><td>{TEXT[0]}</td></tr><tr><td>{TEXT[1]}</td></tr></table><p>{TEXT[2]}</p><p>{TEXT[3]}</p></article>", ALL),
    (f"<main><article>{H}{P}<form><label>Your name</label><input><button>Send</button></form></article></main>", ALL),
    (f"<div class='post'><h2>{HEAD}</h2>{P}</div><div class='post-footer'><a href='/s'>Share</a> <a href='/p'>Print</a></div>", ALL),
    (f"<body><p class='sitename'>Weekly Mirror</p>{LIST}<article>{H}{P}</article>", ALL),
    (f"<ARTICLE>{H.upper().replace(HEAD.upper(), HEAD)}{P}</ARTICLE><FOOTER>{LEGAL}</FOOTER>", ALL),
    (f"<article><header>{H}</header>{P}<footer><a href='/tag/books'>books</a></footer></article>", ALL),
    (f"<article>{P}</article><nav class='pager'><a href='/older'>Older</a> <a href='/newer'>Newer</a></nav>", BODY),
    (f"<div class='wrapper'><div class='site-main'><div class='post-content'>{H}{P}</div></div><div class='sidebar-right'>{ASIDE}</div></div>", ALL),
    (f"<article>{H}<figure><img src='a.jpg'><figcaption>{TEXT[0]}</figcaption></figure><p>{TEXT[1]}</p><p>{TEXT[2]}</p><p>{TEXT[3]}</p></article>", ALL),
    (f"<article>{H}{P}</article><div id='comments'>{TALK}</div>", ALL),
    (f"<main><div class='breadcrumbs'><a href='/'>Start</a> &gt; <a href='/town'>Town</a></div><article>{H}{P}</article></main>", ALL),
    (f"<article>{H}<pre>{TEXT[0]}</pre><ol><li>{TEXT[1]}</li><li>{TEXT[2]}</li></ol><p>{TEXT[3]}</p></article><footer>{LEGAL}</footer>", ALL),
    (f"<div class='dialog-box'>Subscribe to our newsletter. <a href='#'>No thanks</a></div><article>{H}{P}</article>", ALL),
    (f"<table class='frame'><tr><td class='nav'>{LIST}</td><td class='text'><article>{H}{P}</article></td><td class='ads'>Buy one, get one free!</td></tr></table>", ALL),
    (f"<div><nav>{LIST}</nav><div><article>{H}{P}</article></div><div class='bottom'>{LEGAL}</div></div>", ALL),
    (f"<article>{H}<p>{TEXT[0]}<br>{TEXT[1]}</p><p>{TEXT[2]}</p><p>{TEXT[3]}</p></article><aside class='teaser'>{ASIDE}</aside><footer>{LEGAL}</footer>", ALL),
]


def read(net):
    pages = [f"<!DOCTYPE html><html><head><title>{HEAD}</title><script>var x = '<p>';</script></head><body>{html}</body></html>" for html, _ in LAYOUTS]
    return [(i, got) for i, (got, (_, want)) in enumerate(zip(html_main.main_texts(pages, net), LAYOUTS, strict=True)) if got != want]


def test_layouts():
    wrong = read(html_main.labeller())
    assert len(LAYOUTS) >= 30 and len(wrong) <= 0.05 * len(LAYOUTS), wrong
