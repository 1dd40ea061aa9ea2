"""Main text of hand-written pages, and of generated ones whose text is known."""

import random

from wirelens.llm import html

LONG = "The history of the town is long, and it is told by the people of the valley in many ways that are not the same. " * 3


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
    <header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div>
    <article><header><h1>A &amp; B</h1></header><p>{LONG}</p><p>Short one.</p>
    <div class="ad">Buy now, the best of all and more for you.</div><form><p>Your mail</p><input></form>
    <p>Line one<br>line&nbsp;two <b>bold</b><a href="/x">link</a>.</p></article>
    <section id="comments"><p>{LONG}</p></section><aside>{LONG}</aside><footer>&copy; 2020 by the town.</footer></body></html>"""
    assert html.main_text(page) == "\n".join(["A & B", LONG.strip(), "Short one.", "Line one line two boldlink."])


def test_page_without_article_element():
    page = f"""<body><div>Home | About</div><div><a href=a>One</a> <a href=b>Two</a></div><h2>Head of it</h2><div>{LONG}</div>
    <div>Well then.</div><div>{LONG}</div><div>All rights reserved</div><div><a href=c>Next</a></div></body>"""
    assert html.main_text(page).split("\n") == ["Head of it", LONG.strip(), "Well then.", LONG.strip()]


def test_layout_classes_are_no_marks():
    page = f'<div class="post has-sidebar comments-enabled"><p>{LONG}</p><div class="post-comments"><p>{LONG}</p></div></div>'
    assert html.main_text(page) == LONG.strip()


def test_marks_in_ids_of_an_article_are_in_doubt():
    ids = ["related-work", "copyright-law", "legal-notice", "social-history", "comments-on-method"]
    parts = "".join(f'<section id="{i}"><h2>On {i}</h2><p>{LONG}</p></section>' for i in ids)
    page = f"""<article><p>{LONG}</p>{parts}<h2 id="related-work">Heading</h2><p>{LONG}</p>
    <div class="social-share">Share this page</div><div class="related-posts"><p><a href=a>{LONG}</a></p></div>
    <p>With <span id="legal-notice">a term</span> in it.</p></article>"""
    want = [LONG.strip()]
    for i in ids:
        want += [f"On {i}", LONG.strip()]
    assert html.main_text(page).split("\n") == [*want, "Heading", LONG.strip(), "With a term in it."]


def test_pages_in_languages_without_stop_words():
    polish = ("Historia miasta jest długa i opowiadana przez mieszkańców doliny na wiele sposobów, które różnią się między sobą, "
              "ponieważ każdy pamięta inne wydarzenia, inne nazwiska oraz zupełnie inną kolejność zdarzeń sprzed wielu lat, kiedy rzeka zmieniła bieg.")
    greek = "Η ιστορία της πόλης είναι μεγάλη και οι κάτοικοι της κοιλάδας τη διηγούνται με πολλούς τρόπους. " * 3
    for text, tag in ((polish, '<html lang="pl">'), (polish, "<html>"), (greek, "<html>")):
        page = f"{tag}<body><div>Menu</div><div><a href=a>Jeden</a> <a href=b>Dwa</a></div><div>{text}</div><nav>{text}</nav></body></html>"
        assert text.strip() in html.main_text(page).split("\n") and "Jeden" not in html.main_text(page)


def test_broken_markup():
    assert html.main_text(f"<article><p><b>{LONG}<p>Second</i></div> part<footer>no") == LONG.strip() + "\nSecond\npart"
    assert html.main_text("<article><p>a < b &lt; c &#x41; &bogus; <!-- no --> x <!-- open") == "a < b < c A &bogus; x"
    assert html.main_text("<p>" + "word " * 50_000) == "word " * 49_999 + "word"
    assert html.main_text("<article>" + "word " * 50_000) == "word " * 49_999 + "word"
    assert html.main_text("<script>never closed <p>x") == html.main_text(None) == html.main_text("") == html.main_text("<") == ""


def test_marked_parts_of_an_article_go():
    for mark in ('class="post-comments"', 'id="comments"', 'class="comment-list"', 'class="cookie-banner"', 'class="ad-box"', 'class="newsletter-signup"',
                 'class="related-posts"', 'id="disqus_thread"', 'id="respond"', 'class="sponsored_content"', 'class="entry-share-buttons"', 'class="notice"'):
        for tag in ("div", "section"):
            assert html.main_text(f"<article><p>{LONG}</p><{tag} {mark}><p>{LONG}</p></{tag}><p>End.</p></article>") == LONG.strip() + "\nEnd.", mark


def test_unmarked_parts_of_an_article_stay():
    parts = ["<p>See <a href=a>most of it is a link</a>.</p>", "<p><a href=a>short link</a></p>", f"<p>© is a sign. {LONG}</p>",
             f'<aside class="pullquote">{LONG}</aside>', '<h2 class="notice">On notices</h2>', '<p>With <span class="tags">some words</span> inside.</p>']
    lines = ["See most of it is a link.", "short link", f"© is a sign. {LONG}".strip(), LONG.strip(), "On notices", "With some words inside."]
    page = f"<article><p>{LONG}</p>" + "".join(f"{p}<p>{LONG}</p>" for p in parts) + "<h2>Sources</h2><ul>" + "".join(
        f"<li><a href=x>Source {i}</a></li>" for i in range(6)) + "</ul></article>"
    want = [LONG.strip()] + [x for line in lines for x in (line, LONG.strip())] + ["Sources"] + [f"Source {i}" for i in range(6)]
    assert html.main_text(page).split("\n") == want
    run = "<p><a href=a>Home</a></p><p><a href=b>News</a></p><p><a href=c>Shop</a></p>"
    assert html.main_text(f"<article>{run}<p>{LONG}</p></article>") == LONG.strip()


TONGUES = {"en": html.STOP_WORDS & set("the of and to in a is that for it as was with be by on not".split()), "de": set("der die das und in zu den von mit sich des auf für".split()),
           "fr": set("le la les de des du à un une en que qui est dans pour".split()), "es": set("el los las que y del se un una por con no su para".split())}
JUNK = ['<nav>{}</nav>', '<div class="comments">{}</div>', '<aside>{}</aside>', '<div class="cookie-consent">{}</div>', '<form>{}</form>', '<div class="ad-slot">{}</div>',
        '<script>var x = "{}";</script>', '<style>p {{}} /* {} */</style>', '<!-- {} -->', '<div id="comment-thread"><p>{}</div>', '<div class="widget">{}</div>', '<div hidden>{}</div>']


def made(rng):
    """A page and its main text: nested, sometimes unclosed, with references and what surrounds articles."""
    lang = rng.choice(sorted(TONGUES))
    stop = sorted(TONGUES[lang])
    words = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.5 else "".join(rng.choice("bcdfgl") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4))) for _ in range(n))
    junk = lambda: rng.choice(JUNK).format(words(rng.randint(1, 60)))
    parts, lines = [], []
    for _ in range(rng.randint(1, 9)):
        kind = rng.randrange(6)
        text = words(rng.randint(15, 80))
        if kind == 0:
            parts.append(f"<h2>{text}</h2>")
        elif kind == 1:
            parts.append(f"<p>{text}" if rng.random() < 0.5 else f"<p>{text}</p>")
        elif kind == 2:
            items = [words(rng.randint(1, 9)) for _ in range(rng.randint(1, 4))]
            parts.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            lines += items
            continue
        elif kind == 3:
            parts.append(f"<div><div><blockquote>{text}</blockquote></div></div>")
        elif kind == 4:
            other = words(12)
            parts.append(f"<p>{text} &amp;\n\t <b>{other}</b> &#233;&nbsp;<a href='u'>x</a></p>")
            text = f"{text} & {other} é x"
        else:
            parts.append(f"<table><tr><td>{text}</td></tr></table>")
        lines.append(text)
        if rng.random() < 0.5:
            parts.append(junk())
    page = f"<!doctype html><html lang={lang}><head><title>{words(4)}</title></head><body>" + "".join(junk() for _ in range(rng.randint(0, 4)))
    page += "<article>" + "".join(parts) + "</article>" + "".join(junk() for _ in range(rng.randint(0, 4))) + f"<footer>{words(30)}</footer></body></html>"
    return page, "\n".join(lines)


def test_generated_pages():
    rng = random.Random(20)
    for n in range(600):
        page, want = made(rng)
        assert html.main_text(page) == want, (n, page)


def test_rows(spark):
    rows = [(1, "u", f"<article>{LONG}</article>", "t"), (None, None, None, "t"), (2, "u", "", "t"), (1, "u", f"<article>{LONG}</article>", "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, "u", LONG.strip(), len(LONG.strip()))] * 2 + [(None, None, "", 0), (2, "u", "", 0)], key=repr)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
