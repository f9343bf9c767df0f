"""Made-up pages with the label of every block, which the block labeller is fitted to.

A page is laid out at random: its parts have tags and names as sites give them, words of their own, or no name at all;
they stand below any number of wrappers, in columns or tables, in groups, before, beside, after and inside the article.
"""

from __future__ import annotations

import random

# Names that sites give to their parts ("tag.class" or "tag#id"), and words that stand in them.
MAIN = "article main div.content div#content div.post-body div.entry-content section.story div.article-body div.article-text div#main article.post main.page div.text div.post div.entry section.article div.body-copy div.page-content article.single main#main-content div.story-body".split()
MENU = "nav ul.menu div.nav div#navigation nav.breadcrumb ul.breadcrumbs div.topnav nav.pagination div.tags div.toc ul.navbar nav#site-nav div.main-menu ol.breadcrumb div.pager div.tabs ul.categories".split()
HEAD = "header div.header div#masthead div.site-header div.logo header.banner div.top-bar header#top div.brand div.site-title div.branding".split()
FOOT = "footer div.footer div#footer div.site-footer div.copyright p.copyright div.legal footer.page-footer div#colophon div.footnav div.bottom-bar div.credits small.copy".split()
SIDE = "aside div.sidebar div#sidebar div.widget div.related section.recommended div.popular aside.more div.trending div.author-box div#secondary div.side-column aside.rail div.most-read ul.related-links div.more-stories div.teasers".split()
NOTE = "div.cookie-notice div#cookie-banner div.notice div.alert div.gdpr div.consent div.popup div.modal div.overlay p.notice div.message div.paywall div.cookies dialog div.privacy-bar div.toast section.announcement".split()
ADVERT = "div.ad div.ads div.advert div#ad div.advertisement aside.sponsored div.promo section.promotion div.banner p.ad ins.ad div.sponsor div.adslot div#ad-top div.ad-container div.commercial div.sponsored-content".split()
FORM = "form form.search div.newsletter form.login div.subscribe form.comment-form div.signup fieldset div.search-box form#contact div.mailing-list".split()
TALK = "div.comments section#comments ol.comment-list div.comment ul.comments div.replies div.responses div#disqus section.discussion div.reviews div#respond section.user-comments div.thread ul.feedback".split()
SHARE = "div.share ul.social div.social-links div.share-buttons div.sharing ul.share-list".split()
WRAP = "div#wrapper div.container div#page div.site div.row div.col-8 div.inner div.layout div#root div#app div.wrap div.main-wrap div.grid section.section div.columns div.page-wrapper div.outer center div.body div#container div.content-area div.primary".split()
INSIDE = "div.body div.entry div.inner div.content section div.text div.copy div.article-content div.richtext div.wrap".split()
_SAID = {
    "menu": "home about contact news sport index next previous page more sections login subscribe videos archive".split(),
    "foot": "copyright reserved rights privacy terms imprint © legal contact sitemap ©".split(),
    "note": "cookies accept consent we use agree privacy settings notice experience site best browser".split(),
    "form": "email password search subscribe submit name sign up send newsletter your address go".split(),
    "talk": "reply says posted comment ago like report user wrote comments permalink hours great thanks".split(),
    "ad": "sponsored advertisement buy now offer sale free click off shop deal today".split(),
    "side": "related popular recommended also read more most latest trending".split(),
}
_LETTERS = ["b c d f g h l m n p r s t v w st tr ch".split(), "a e i o u ou ea".split()]


def sample_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A made-up page, and its blocks with 1 for main text. Texts are of the same invented words everywhere."""
    syllables = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiouéü") for _ in range(rng.choice([1, 1, 2, 2, 3]))) for _ in range(60)]
    word = lambda: rng.choice(syllables) + (rng.choice(syllables) if rng.random() < 0.4 else "")
    parts: list[tuple[str, int]] = []
    html: list[str] = []
    # how this site names things: by known names, names of its own, or not at all
    unknown = {}
    habit = rng.choice([0.0, 0.0, 0.1, 0.3, 0.0, 0.1, 0.3, 1.0])
    hashed = rng.random() < 0.5  # names as build tools make them

    def name() -> str:
        if hashed and rng.random() < habit:
            return rng.choice(["css-", "sc-", "_", ""]) + "".join(rng.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(rng.randint(5, 8)))
        return "-".join("".join(rng.choice(_LETTERS[0]) + rng.choice(_LETTERS[1]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([1, 1, 2])))

    def spec(names: list[str], bare: float = 0.0) -> str:
        """One of the names, another that stands for it on this site, or (at rate ``bare``) a plain div."""
        s = rng.choice(names)
        if "." in s or "#" in s:
            if rng.random() < bare:
                return "div"
            if rng.random() < habit:
                return unknown.setdefault(s, f"{rng.choice(['div', s.partition('.')[0].partition('#')[0]])}.{name()}")
            if rng.random() < 0.2:  # written as one word, or with another one
                s = rng.choice([s.replace("-", ""), f"{s}{rng.choice(['box', 'wrap', 'area', 'list', 'item'])}", f"{s}-{name()}"])
        elif rng.random() < 0.3:
            return f"{s}.{name()}"
        return s

    def sentence(n: int, said: str = "") -> str:
        w = [rng.choice(_SAID[said]) if said and rng.random() < 0.3 else word() for _ in range(n)]
        return " ".join(w).capitalize() + rng.choice([".", ".", "", "!"])

    def prose(most: int = 4, said: str = "") -> str:
        if rng.random() < 0.06:  # junk that is content all the same
            return " ".join(rng.choice([[word()] * rng.randint(4, 60), [word().upper() + "!!" for _ in range(rng.randint(4, 40))]]))
        return " ".join(sentence(rng.randint(2, 22), said) for _ in range(rng.randint(1, most)))

    def say(text: str, label: int, inner: str = "{}") -> str:
        parts.append((text, label))
        return inner.format(text)

    def wrap(spec_: str, body: str) -> str:
        mark = "." if "." in spec_ else "#" if "#" in spec_ else ""
        tag, _, value = spec_.partition(mark) if mark else (spec_, "", "")
        more = f" {name()}" if mark == "." and rng.random() < 0.2 else ""
        attr = f' {"class" if mark == "." else "id"}="{value}{more}"' if mark else ""
        return f"<{tag}{attr}>{body}</{tag}>"

    def links(n: int, said: str, in_list: bool) -> str:
        item = (lambda s: f"<li><a href='/x'>{s}</a></li>") if in_list else (lambda s: f"<div><a href='/x'>{s}</a></div>")
        return "".join(item(say(rng.choice([word(), sentence(2, said), sentence(rng.randint(2, 8), said)]), 0)) for _ in range(n))

    def menu() -> str:
        s = spec(MENU, 0.1)
        body = links(rng.randint(2, 8), "menu", rng.random() < 0.8)
        return wrap(s, rng.choice([f"<ul>{body}</ul>", body]))

    def other(names: list[str], said: str, bare: float = 0.05) -> str:
        s, kind = spec(names, bare), rng.random()
        if said == "foot" and kind < 0.25:
            return wrap(s, say(f"{rng.choice(['Copyright', '©', 'Copyright ©'])} {rng.randint(1995, 2030)} {sentence(rng.randint(1, 4), said)}", 0, rng.choice(["{}", "<p>{}</p>", "{} <a href='/i'></a>"])))
        if s == "div" and rng.random() < 0.8:  # without a name there have to be words or links that tell
            return wrap(s, links(rng.randint(2, 5), said, False)) if kind < 0.5 else wrap(s, say(" ".join(rng.choice(_SAID[said]) for _ in range(rng.randint(2, 6))), 0))
        if kind < 0.35:
            return wrap(s, say(prose(3, said), 0))
        if kind < 0.8:
            return wrap(s, "".join(say(prose(2, said), 0, rng.choice(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>", "<li>{}</li>"])) for _ in range(rng.randint(1, 4))))
        return wrap(s, (say(sentence(2, said), 0, "<h3>{}</h3>") if rng.random() < 0.5 else "") + links(rng.randint(1, 5), said, rng.random() < 0.5))

    def talk() -> str:
        """Reader comments: a head, then who said what, in like items."""
        if rng.random() < 0.4:
            return other(TALK, "talk")
        s, item = spec(TALK), rng.choice(["div.comment", "li", "article.comment", "div", "li.comment", f"div.{name()}", f"article.{name()}"])
        who, what = rng.choice(["<b>{}</b><br>", "<div>{}</div>", "<h4>{}</h4>", "<span>{}</span> "]), rng.choice(["<p>{}</p>", "<div>{}</div>", "{}"])
        number = f"{rng.randint(1, 40)} {rng.choice(['comments', 'replies', 'reader comments', 'responses'])}"
        body = say(number if rng.random() < 0.4 else sentence(rng.randint(1, 2), "talk"), 0, rng.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<div>{}</div>"])) if rng.random() < 0.7 else ""
        for _ in range(rng.randint(1, 5)):
            a, b = f"{word()} {rng.choice(_SAID['talk'])}", prose(3, rng.choice(["talk", ""]))
            inner = who.format(a) + what.format(b)
            # marks inside a block make one block of both
            if who.startswith(("<b>", "<span>")) and what == "{}":
                parts.append((f"{a} {b}", 0))
            else:
                parts.extend([(a, 0), (b, 0)])
            body += wrap(item, inner) if rng.random() < 0.7 else wrap(item, inner + say(rng.choice(["Reply", "Report", "Like"]), 0, "<div><a href='#'>{}</a></div>"))
        return wrap(s, body)

    def banner() -> str:
        """The site's own head: its name, as a heading or a link, and at times a line below it."""
        body = say(rng.choice([sentence(rng.randint(1, 4)), f"the {word()} {word()}".title()]), 0, rng.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<h2><a href='/'>{}</a></h2>", "<div><a href='/'>{}</a></div>", "<p>{}</p>", "{}"]))
        return wrap(spec(HEAD, 0.05), body + (say(sentence(rng.randint(2, 7)), 0, "<p>{}</p>") if rng.random() < 0.3 else ""))

    def form() -> str:
        s = spec(FORM)
        return wrap(s, "".join(say(sentence(rng.randint(1, 5), "form"), 0, rng.choice(["<label>{}</label><input>", "<p>{}</p>", "<button>{}</button>", "<option>{}</option>"])) for _ in range(rng.randint(1, 4))))

    def inside() -> str:
        k = rng.random()
        if k < 0.7:
            text = prose(5)
            if rng.random() < 0.2:
                return f"<p>{say(text, 1)} <br>" if rng.random() < 0.5 else f"<p><b>{say(text, 1)}<br>"
            return say(text, 1, rng.choice(["<p>{}</p>", "<p>{}</p>", "<p><i>{}</i></p>", "<div>{}</div>", "<p><a href='/y'>{}</a></p>"]))
        if k < 0.78:
            return say(sentence(rng.randint(1, 8)), 1, rng.choice(["<h2>{}</h2>", "<h3>{}</h3>"]))
        if k < 0.86:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(say(sentence(rng.randint(1, 14)), 1, "<li>{}</li>") for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if k < 0.9:
            return say(prose(2), 1, rng.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<figure><img><figcaption>{}</figcaption></figure>"]))
        if k < 0.92:
            cells, wide = (lambda: word(), 3) if rng.random() < 0.5 else (lambda: prose(1), rng.randint(1, 2))
            return "<table>" + "".join("<tr>" + "".join(say(cells(), 1, "<td>{}</td>") for _ in range(wide)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if k < 0.935:  # what stands in for a film or a drawing
            tag = rng.choice(["object", "video", "audio", "canvas"])
            return f"<div><{tag}>{say(prose(1), 1)}</{tag}></div>" if rng.random() < 0.5 else f"<{tag}>{say(prose(2), 1, '<p>{}</p>')}</{tag}>"
        return rng.choice([lambda: other(ADVERT, "ad", 0), lambda: other(SHARE, "menu", 0), lambda: other(NOTE, "note", 0), form, lambda: other(SIDE, "side", 0)])()

    def nest(body: str, most: int) -> str:
        for _ in range(rng.randint(0, most)):
            body = wrap(rng.choice([rng.choice(WRAP), f"div.{name()}", "div", f"div#{name()}"]), body)
        return body

    def article() -> str:
        s = spec(MAIN, 0.15)
        if rng.random() < 0.06 and s != "div":  # a notice or a heading is all there is
            return wrap(s, say(sentence(rng.randint(1, 9)), 1, rng.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<h1>{}</h1>", "{}"])))
        head = say(title, 1, rng.choice(["<h1>{}</h1>", "<h1 class='title'>{}</h1>", "<h1><a href='/'>{}</a></h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"])) if rng.random() < 0.8 else ""
        body = "".join(inside() for _ in range(rng.choice([0, 1, 2, 4, 8, 14])))
        if rng.random() < 0.3:
            body = wrap(spec(INSIDE, 0.3), body)
            if rng.random() < 0.4:
                body += rng.choice([lambda: other(ADVERT, "ad"), lambda: other(SHARE, "menu"), lambda: other(SIDE, "side"), form])()
        body = head + body
        if rng.random() < 0.25:
            body += talk()
        return wrap(s, body)

    def group(makers: list, most: int, names: list[str]) -> str:
        """Some of the parts, each alone or together in one wrapper, in the order they are made."""
        body = "".join(nest(f(), 1) if rng.random() < 0.3 else f() for f in rng.sample(makers, rng.randint(0, min(most, len(makers)))))
        return wrap(rng.choice(names), body) if body and rng.random() < 0.2 else body

    title = sentence(rng.randint(2, 10))
    html.append(f"<!DOCTYPE html><html><head>{say(title, 0, '<title>{}</title>')}</head><body>")
    before = [menu, menu, lambda: other(HEAD, "menu"), banner, banner, lambda: other(ADVERT, "ad"), lambda: other(NOTE, "note"), form, lambda: other(SIDE, "side")]
    after = [lambda: other(FOOT, "foot"), talk, lambda: other(SIDE, "side"), lambda: other(ADVERT, "ad"), menu, form, lambda: other(NOTE, "note"), lambda: other(SHARE, "menu")]
    beside = [lambda: other(SIDE, "side"), menu, lambda: other(ADVERT, "ad"), lambda: other(SIDE, "side"), talk, lambda: other(SHARE, "menu")]
    head = group(before, 4, HEAD + WRAP)
    if rng.random() < 0.15:  # columns of a table, and at times rows of it for what is above and below
        cell = rng.choice(["<td>{}</td>", "<td valign='top'>{}</td>", "<td colspan=2>{}</td>"]).format
        row = lambda makers: f"<tr>{cell(rng.choice(makers)())}</tr>"
        top = row([menu, lambda: links(rng.randint(2, 5), "menu", False), banner]) if rng.random() < 0.4 else ""
        left = cell(menu()) if rng.random() < 0.6 else ""
        middle = cell(article())
        right = cell(other(SIDE, "side")) if rng.random() < 0.5 else ""
        last = row([lambda: other(FOOT, "foot"), lambda: say(sentence(rng.randint(3, 9), "foot"), 0) + links(rng.randint(1, 3), "foot", False)]) if rng.random() < 0.5 else ""
        body = f"<table>{top}<tr>{left}{middle}{right}</tr>{last}</table>"
    else:
        left = nest(group(beside, 1, WRAP), 1) if rng.random() < 0.25 else ""
        middle = nest(article(), 2)
        body = nest(left + middle + (nest(group(beside, 2, WRAP), 1) if rng.random() < 0.6 else ""), 2)
    foot = group(after, 5, FOOT[:1] + WRAP)
    html.append(nest(head + body + foot, 2))
    html.append(rng.choice(["</body></html>", "</body>", ""]))
    return "".join(html), parts
