"""Extraction on pages whose main text is known."""

from quillspark.llm import html_text as H
from quillspark.llm.common import prepared

LONG = "It was the case that all of them were there when the rain came down on the roof of the old house, and no one had been told."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>A title of the page that is not in the article</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_boilerplate_goes_and_short_blocks_of_the_article_stay():
    body = f"""
    <header><h1>Site of the day</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">About us</a></ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><div id="sideBar"><p>{LONG}</p></div>
    <article><header><h1>The head&shy;line</h1></header><p>As.<p><b>{LONG}</b><br>Short &amp;
      <i>wo</i>rds.</p><script>if (a < b) document.write("</p>")</script><!-- no > --><ul><li><a href=x>Read also this</a></ul>
      <div class=ad>Buy the thing that is for you</div><p>End&#33;</p><form><label>Your name</label><textarea>{LONG}</textarea></form></article>
    <section class="comments"><p>{LONG}</p></section><aside>{LONG}</aside><footer>&copy; 2024 the site</footer>"""
    assert H.main_text(page(body)) == f"The head\xadline As. {LONG} Short & words. End!"


def test_pages_without_an_article_element():
    body = f'<div class="menu">Start Page</div><div id=content><h2>Head</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div class="footer">Bye</div>'
    assert H.main_text(page(body)) == f"Head {LONG} Yes. {LONG}"


def test_article_of_short_blocks_only():
    assert H.main_text(page("<nav>Menu</nav><article><h1>One</h1><p>Two.</article><footer>Foot</footer>")) == "One Two."


def test_short_pages_and_other_languages_in_plain_blocks():
    around = '<nav>Menu</nav><div class="menu">Start Page</div>{}<p><a href="/more">All of the links</a></p><div class="footer">Bye</div><footer>&copy; 2024</footer>'
    finnish = "Kissa istui vanhan talon katolla ja katseli, kuinka sade hiljalleen kasteli puutarhan kukat ja polut."
    assert H.main_text(page(around.format("<div><h1>One</h1><p>Two.</p>Three</div>"))) == "One Two. Three"
    assert H.main_text(page(around.format(f"<div><p>{finnish}</p><p>{finnish}</p></div>"))) == f"{finnish} {finnish}"
    assert H.main_text(page("<p>Short.</p>")) == "Short."
    assert H.main_text(page(around.format("<p>Not main.</p><article><p>Two.</p></article>"))) == "Two."


def test_odd_pages(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "plain < words > & more", "c"), (4, "<article><p>cut &am", "d"), (5, "<p title='x", "e"), (6, "<script>never closed", "f"), (7, "<div" * 50_000, "g"), (8, "<b>" * 200_000 + LONG, "h"), (9, "<!-- x", "i"), (10, "<div>" * 50_000 + LONG, "j")]
    df = prepared(spark).createDataFrame(rows, "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extracted(df).collect()}
    assert got[1] == got[2] == got[5] == got[6] == got[9] == ("", 0)
    assert got[4] == ("cut &am", 7)
    assert got[8] == got[10] == (LONG, len(LONG))
    assert H.extracted(df.limit(0)).count() == 0


def test_names_of_classes_only_tilt():
    assert H.main_text(page(f'<article class="post has-sidebar no-comments"><p>{LONG}</p></article>')) == LONG
    assert H.main_text(page(f'<div id="search-results-article" class="social-science"><p>{LONG}</p><p>Short.</p></div>')) == f"{LONG} Short."
    around = f'<div class="content-sidebar"><div class="ad">Buy now!</div><p>{LONG}</p><p>{LONG}</p><div class="sidebar"><p>Other things here.</p></div></div>'
    assert H.main_text(page(around)) == f"{LONG} {LONG}"
    assert H.main_text(page(f'<div class="comments"><article class="comment"><p>{LONG}</p></article></div><article><p>{LONG}{LONG}</p></article>')) == f"{LONG}{LONG}"
    assert H.main_text(page('<div class="banner"><p>Only this.</p></div>')) == "Only this."


def test_paragraphs_and_items_end_where_the_next_begins():
    assert H.main_text(page(f'<article><p class="ad">Buy now!<p>{LONG}<p class=share>Share<div>{LONG}</div></article>')) == f"{LONG} {LONG}"
    assert H.main_text(page(f'<article><p>{LONG}</p><ul><li class="sponsored">Buy<li>One thing<ul><li>in it</ul><li>and another</ul></article>')) == f"{LONG} One thing in it and another"
    assert H.main_text(page(f'<article><p>{LONG}</p><table><tr><td class="ad">Buy<td>Cell<tr><td>Next</table></article>')) == f"{LONG} Cell Next"


def test_inline_elements_nest():
    assert H.main_text(page(f'<article><p>{LONG} <span class="sponsored"><span>Buy</span> this</span> or not.</p></article>')) == f"{LONG} or not."
    assert H.main_text(page(f'<article><i><div class="ad">Buy</i> more</div><p>{LONG}</p></article>')) == LONG
    assert H.main_text(page(f'<p>{LONG}</p><ul><li><a href="/x">Never closed</ul><p>{LONG}</p>')) == f"{LONG} {LONG}"


def test_copyright_signs_and_scripts_without_blanks():
    assert H.main_text(page(f"<article><p>© is a sign.</p><p>{LONG}</p></article>")) == f"© is a sign. {LONG}"
    han = "今天早上下雨，所以大家都留在老房子里。没有人知道发生了什么，也没有人问。后来雨停了，他们沿着河边走回家。" * 3
    assert H.main_text(page(f'<div class="menu">首页</div><div><p>{han}</p></div><div><ul><li><a href="/a">更多文章</a></ul></div>')) == han


def test_time_is_linear():
    import time

    def took(n: int) -> float:
        best = 9e9
        for _ in range(3):
            t = time.perf_counter()
            for bad in ("<div>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<p><b>" * n, '<div class="ad">' * n + "x", "<li>" * n + "</ul>" * n, "<a><p>x" * n):
                H.main_text(bad)
            best = min(best, time.perf_counter() - t)
        return best

    assert took(40_000) < 16 * took(5_000) + 0.5


def test_like_a_parser_on_random_articles():
    """Brute force: pages built from known parts; the text is what the parts of the article say, in order."""
    import random

    r = random.Random(7)
    words = "the of and to in that it was for on are as with his they at be this from have or by one had not but what all were when".split()

    def sentence(n):
        return " ".join(r.choices(words, k=n)).capitalize() + "."

    for _ in range(200):
        want, body = [], []
        for _ in range(r.randint(1, 8)):
            kind = r.randrange(6)
            t = sentence(r.randint(2, 40))
            if kind == 0:
                body.append(f'<div class="{r.choice(["ad", "share-buttons", "newsletterBox"])}">{t}</div>')
            elif kind == 1:
                body.append(f"<aside>{t}</aside>")
            else:
                body.append(r.choice([f"<p>{t}", f"<p>{t}</p>", f"<h2>{t}</h2>", f"<div>{t}</div>", f"<ul><li>{t}</ul>"]))
                want.append(t)
        t = sentence(30)
        body.append(f"<p>{t}</p>")
        want.append(t)
        outside = "".join(r.choice(["<nav>{}</nav>", "<footer>{}</footer>", '<div class="comments"><p>{}</p></div>', "<form>{}</form>"]).format(sentence(r.randint(2, 30))) for _ in range(3))
        assert H.main_text(page(f"{outside}<article>{''.join(body)}</article>{outside}")) == " ".join(want)


def test_a_box_beside_a_short_article_stays_out():
    assert H.main_text(page(f'<div class="ad">{LONG}</div><article><h1>One</h1><p>Two.</article>')) == "One Two."
