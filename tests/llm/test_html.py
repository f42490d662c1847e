"""Main text on page templates that differ from each other."""

import math
import random
import time

import pytest

from sparsonde.llm.html_text import main_text, measure, parse

A = "The first paragraph of the article says enough to be one, with a comma and a full stop."
B = "A second paragraph follows it &amp; is about as long as the first one was, more or less."
B_ = B.replace("&amp;", "&")
LINKS = "".join(f'<li><a href="/{i}">Menu entry {i}</a></li>' for i in range(9))

PAGES = {
    "article": (f"<html><head><title>T</title></head><body><nav><ul>{LINKS}</ul></nav><article><h1>Head</h1><p>{A}</p><p>{B}</p></article><footer>(c) site</footer></body></html>", f"Head\n{A}\n{B_}"),
    "unclosed": (f"<body><div class=ad>Buy now</div><article><h1>Head</h1><p><b>{A}<br><p>{B}</article><footer>foot", f"Head\n{A}\n{B_}"),
    "main": (f"<body><header><a href=/>Site</a> slogan</header><main><h2>Head</h2><p>{A}</p><ul><li>one</li><li>two</li></ul><p>{B}</p></main><aside><p>{A}</p></aside></body>", f"Head\n{A}\none\ntwo\n{B_}"),
    "divs": (f'<body><div id="top-menu"><ul>{LINKS}</ul></div><div id="content"><h1>Head</h1><p>{A}</p><p>Short.</p><p>{B}</p></div><div class="sidebar"><p>{A}</p></div><div class="footer"><p>Imprint</p></div></body>', f"Head\n{A}\nShort.\n{B_}"),
    "sections": (f"<body><ul>{LINKS}</ul><div><div class=post><section><p>{A}</p><p>{B}</p></section><section><p>{B}</p><p>{A}</p></section></div></div><ul>{LINKS}</ul></body>", f"{A}\n{B_}\n{B_}\n{A}"),
    "comments": (f'<article><p>{A}</p><p>{B}</p><section id="comments"><p>{A} I disagree.</p></section></article><div class="comment-list"><p>{B}</p></div>', f"{A}\n{B_}"),
    "notices": (f'<body><div class="cookie-notice"><p>We use cookies. {A}</p><button>OK</button></div><div role="alert">Old browser</div><article><p>{A}</p><form><label>Mail</label><input name=m><p>Sign up</p></form><div class="advertisement">Buy</div><p>{B}</p></article></body>', f"{A}\n{B_}"),
    "scripts": (f"<article><script>if (a < b) document.write('<p>no</p>')</script><style>p > a {{}}</style><p>{A}</p><!-- <p>hidden</p> --><noscript><p>no js</p></noscript><p>{B}</p></article>", f"{A}\n{B_}"),
    "white space": ("<article><p>  one\n\ttwo&nbsp;three   <b>four</b>five <br>six</p>\n\n<p>&#65;&#x42;&lt;tag&gt; &eacute;</p></article>", "one two three fourfive six\nAB<tag> é"),
    "upper case": (f"<BODY><NAV>x</NAV><ARTICLE><P>{A}<P>{B}</ARTICLE></BODY>", f"{A}\n{B_}"),
    "links inside": (f'<article><p>{A} <a href="/x">a link</a>.</p><p><a href="/y">Another link that is a paragraph</a></p></article>', f"{A} a link.\nAnother link that is a paragraph"),
    "a list of links in the article": (f'<body><nav><ul>{LINKS}</ul></nav><article><p>{A}</p><p>{B}</p><ol><li><a href=1>Ref one</a><li><a href=2>Ref two</a><li><a href=3>Ref three</a><li><a href=4>Ref four</a></ol></article></body>', f"{A}\n{B_}\nRef one\nRef two\nRef three\nRef four"),
    "names of content": (f'<body><div><p>{A}</p><section id="reply-from-the-author"><p>{B}</p></section><p>{A}</p><div class="search-results"><p>{B}</p></div></div></body>', f"{A}\n{B_}\n{A}\n{B_}"),
    "the denser of two articles": (f"<body><article><p>Teaser.</p></article><article><p>{A}</p><p>{B}</p><p>{A}</p></article></body>", f"{A}\n{B_}\n{A}"),
    "one paragraph": (f'<body><nav><ul>{LINKS}</ul></nav><div class="ad">Something to buy today.</div><article><h1>Head</h1><p>{A}</p></article><footer>Imprint</footer></body>', f"Head\n{A}"),
    "names of a layout": (f'<body class="has-sidebar"><div class="page with-sidebar"><div class="sidebar"><p>{A}</p></div><div class="no-ads post"><p>{A}</p><p>{B}</p></div></div></body>', f"{A}\n{B_}"),
    "all in a widget": (f'<body><div class="widget"><p>{A}</p><p>{B}</p></div></body>', f"{A}\n{B_}"),
    "a list between blocks": (f"<body><main><div><p>{A}</p><p>{B}</p></div><h3>Ingredients</h3><ul><li>flour</li><li>two eggs</li></ul><div><p>{B}</p></div></main></body>", f"{A}\n{B_}\nIngredients\nflour\ntwo eggs\n{B_}"),
    "steps after the text": (f"<body><nav><ul>{LINKS}</ul></nav><main><div><p>{A}</p><p>{B}</p></div><ol><li>Mix.<li>Bake.</ol></main></body>", f"{A}\n{B_}\nMix.\nBake."),
    "text behind an article": (f"<body><nav><ul>{LINKS}</ul></nav><article><h2>Head</h2><p>{A}</p><p>{B}</p></article><div>{f'<p>{A}</p>' * 4}</div></body>", "\n".join(["Head", A, B_, A, A, A, A])),
    "text behind a longer article": (f"<body><article><h2>Head</h2>{f'<p>{A}</p>' * 4}</article><div><p>{A}</p><p>{B}</p></div><ul>{LINKS}</ul></body>", "\n".join(["Head", A, A, A, A, A, B_])),
    "two equal articles": (f"<body><article><p>{A}</p><p>{A}</p></article><article><p>{A}</p><p>{A}</p></article></body>", "\n".join([A] * 4)),
    "a post called promo": (f'<body><nav><ul>{LINKS}</ul></nav><div class="post promo"><h1>Head</h1><p>{A}</p><p>{B}</p></div><p>Stray.</p></body>', f"Head\n{A}\n{B_}\nStray."),
    "an article called alert": (f'<body><p>Stray.</p><div id="alert"><article><p>{A}</p><p>{B}</p><div class="promo">Buy.</div></article></div></body>', f"{A}\n{B_}"),
    "a page in a form": (f'<body><form action="/"><nav><ul>{LINKS}</ul></nav><div id=c><h1>Head</h1><p>{A}</p><p>{B}</p><fieldset><p>Sign up</p></fieldset></div><footer>Imprint</footer></form></body>', f"Head\n{A}\n{B_}"),
    "a line before the form": (f"<body><p>Line.</p><form><div><p>{A}</p><p>{B}</p></div></form></body>", f"Line.\n{A}\n{B_}"),
    "long comments": (f'<body><article><p>{A}</p></article><div class="comments">{f"<div class=comment><p>{A} I disagree.</p></div>" * 9}</div></body>', A),
    "a notice as long as half of the article": (f'<body><div class="notice"><p>{A}</p></div><div><p>{A}</p><p>{B}</p></div></body>', f"{A}\n{B_}"),
    "a quotation aside": (f"<article><p>{A}</p><aside><blockquote>Well said.</blockquote></aside><p>{B}</p><aside><p>See also.</p></aside></article>", f"{A}\nWell said.\n{B_}"),
    "menus without names": (f"<body><ul>{LINKS}</ul><div><p>{A}</p><p>{B}</p></div><div>{LINKS}</div></body>", f"{A}\n{B_}"),
    "table": (f"<article><p>{A}</p><table><tr><td>a<td>b<tr><td>c</table><p>{B}</p></article>", f"{A}\na\nb\nc\n{B_}"),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_template(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_plain_text_and_nothing():
    assert main_text("just text") == "just text"
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x</script>") == ""


LONG = {
    "no end": "<a " * 350_000, "open": "<div>" * 200_000, "closers": "</p>" * 250_000, "quotes": "<a \"'>" * 150_000, "one quote": '<a x="' * 150_000, "deep": "<div>" * 90_000 + "</p>" * 90_000,
    "forms": "<form>x" * 90_000, "navs": "<div>" * 60_000 + "<nav>y</nav><form>z</form>" * 40_000, "rules": "<p><div>" + "<b>" * 90_000 + "<hr>" * 90_000, "items": "<li><ul>" + "<div>" * 90_000 + "<li></li>" * 60_000, "menus": "<nav>" * 90_000 + "x", "spaces": "<p>" + " " * 1_000_000, "less": "<" * 1_000_000, "comments": "<!--" * 200_000, "text": "<p>" + "word " * 200_000,
}


@pytest.mark.parametrize("name", list(LONG))
def test_long_pages_are_linear(name):
    began = time.perf_counter()
    main_text(LONG[name])
    assert time.perf_counter() - began < 6


def test_densities_of_random_trees():
    """Every node's counts, density and sum against their definition."""
    rng = random.Random(5)

    def build(depth):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        return text + "".join((lambda t: f"<{t}>{build(depth + 1)}</{t}>")(rng.choice(["div", "a", "section", "span"])) for _ in range(rng.randrange(4 if depth < 5 else 1)))

    def every(n):
        return [x for k in n.kids for x in (k, *every(k))]

    def text(n):
        return "".join(c if isinstance(c, str) else text(c) for c in n.children)

    for _ in range(60):
        root = parse(f"<body>{build(0)}</body>")
        order = measure(root)
        top = lambda n: [x for k in n.kids for x in ([k] if k.name == "a" else top(k))]
        link_chars = lambda n: len(text(n)) if n.name == "a" else sum(len(text(x)) for x in top(n))
        for n in order:
            c, t, lc, lt = len(text(n)), len(every(n)), link_chars(n), sum(x.name == "a" for x in (n, *every(n)))
            assert (n.chars, n.tags, n.link_chars, n.links) == (c, t, lc, lt)
            expected = 0.0
            if c:
                plain = max(c - lc, 1)
                base = math.log(c / plain * lc + link_chars(root) / max(len(text(root)), 1) * c + math.e)
                expected = c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1) / max(math.log(base), 1.0) * plain / c
            assert n.density == pytest.approx(expected)
        for n in order:
            assert n.sum == pytest.approx(sum(k.density for k in n.kids))


def test_broken_markup_ends():
    for page in ("<p>a<", "<p a='b>text", "<<<>>>", "</p></p></div>", "<a <b>x", "<!-- open", "<script>open", "<div" * 500, "<div>" * 3000 + "x" + "</div>" * 3000):
        main_text(page)
