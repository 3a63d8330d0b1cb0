"""Block rules of main text: the places that rules decide, against a slow version over the standard parser."""

import random
import time
from html.parser import HTMLParser

import pytest

from pulsegrid.llm import html_extract as H

GOOD = "This is the first paragraph of the story and it is long enough to be seen as such by the rules that we have here, so it is good text that stays in."
COMMENT = "I have read all of this and I think that it is not what we were told by the others, but I am glad that you wrote it down for us, so thank you for that."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"


@pytest.mark.parametrize(
    "wrapper",
    ["div class='content sidebar-right'", "div id='layout-with-sidebar'", "div class='page-content social-sharing-enabled'", "div class='entry tags-politics'",
     "article class='post category-notice'", "article class='post tag-cookies'", "div class=sidebar-layout", "form id=aspnetForm"],
)
def test_a_name_does_not_cost_an_article(wrapper):
    page = f"{NAV}<{wrapper}><h1>Title</h1><p>{GOOD}</p><p>Short one</p></{wrapper.split()[0]}><footer>Bye</footer>"
    assert H.main_text(page) == f"Title\n\n{GOOD}\n\nShort one"
    inner = f"{NAV}<{wrapper}><article><h1>Title</h1><p>{GOOD}</p><p>Short one</p></article></{wrapper.split()[0]}><footer>Bye</footer>"
    assert H.main_text(inner) == f"Title\n\n{GOOD}\n\nShort one"


@pytest.mark.parametrize("place", ["<aside>{}</aside>", "<section id=comments><article class=comment>{}</article></section>", "<div class=ad-slot>{}</div>", "<div class='cookie-notice'>{}</div>", "<form>{}</form>", "<div hidden>{}</div>"])
def test_long_text_in_marked_places_is_left_out(place):
    extra = place.format(f"<p>{COMMENT}</p><p>Short</p>")
    for page in (f"<article><p>{GOOD}</p>{extra}<p>{GOOD}</p></article>", f"<article><p>{GOOD}</p><p>{GOOD}</p></article>{extra}", f"<h1>A</h1><p>{GOOD}</p><p>{GOOD}</p>{extra}"):
        assert "others" not in H.main_text(page) and "Short" not in H.main_text(page) and H.main_text(page).count(GOOD) == 2


def test_rules_decide_without_any_tag_or_name():
    menu = "".join(f"<div><a href=/{w}>{w}</a></div>" for w in ("home", "about", "contact"))
    page = f"{menu}<div>{GOOD}</div><div>Short one</div><div>{GOOD}</div>{menu}<div>© 2020 All rights</div>"
    assert H.main_text(page) == f"{GOOD}\n\nShort one\n\n{GOOD}"
    greek = "Αυτή είναι μια μεγάλη παράγραφος " * 8
    assert H.main_text(f"{menu}<div>{greek}</div>{menu}") == greek.strip()


def test_beside_an_article_with_text_more_is_asked_for():
    page = f"<div>Sign up today</div><article><p>{GOOD}</p></article><div>{COMMENT}</div><div><a href=/>More</a></div>"
    assert H.main_text(page) == GOOD


def test_unclosed_elements_do_not_spread():
    assert H.main_text(f"<body><p class=ad>Buy<p>{GOOD}</p><a name=x><p>{GOOD}</p></body>") == f"{GOOD}\n\n{GOOD}"
    assert H.main_text(f"<b><article><p>{GOOD}</b><p>Short</p></article>") == f"{GOOD}\n\nShort"
    assert H.main_text(f"<p title=it's>{GOOD}</p><p>It's</p>") == f"{GOOD}\n\nIt's"


def test_deep_and_long_pages_take_linear_time():
    begun = time.time()
    n = 50_000
    assert H.main_text("<div>" * n + "</p>" * n) == ""
    assert H.main_text('<a "' * n) == ""
    assert H.main_text("<div class=ad>x" * n) == ""
    assert H.main_text("<span hidden>" * n + "</i></b>" * n) == ""
    assert len(H.main_text("<article>" + f"<p>{GOOD}" * n)) == n * (len(GOOD) + 2) - 2
    assert time.time() - begun < 60


class Slow(HTMLParser):
    """Blocks of well-formed pages of div, p, a, article and aside: (text, linked characters, inside, marked)."""

    def __init__(self, page):
        super().__init__()
        self.open, self.blocks, self.text, self.linked = [], [], "", 0
        self.feed(page)
        self.cut()

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append((text, self.linked, "article" in self.open, "aside" in self.open))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.cut()
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag != "a":
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        self.text += data
        self.linked += len(data.strip()) if "a" in self.open else 0


def slow_text(page):
    blocks = Slow(page).blocks

    def label(block, place):
        text, linked, inside, _ = block
        words = [w.lower() for w in H.WORD.findall(text)]
        stops = len([w for w in words if w in H.STOP_WORDS]) / len(words) if len(words) >= 8 else 0
        if linked / len(text) > (0.6 if place == 3 else 0.34):
            return False
        points = place + sum(len(text) >= k for k in (70, 140)) + sum(stops >= k for k in (0.06, 0.12))
        if place != 3 and linked and len(text) < 70:
            points -= 1
        return True if points >= 4 else False if points < 0 else None

    of_article = [b[2] and not b[3] for b in blocks]
    first = [label(b, -8 if b[3] else 3 if w else 0) for b, w in zip(blocks, of_article)]
    article = any(w and v for w, v in zip(of_article, first))
    if article:
        first = [v if w or b[3] else label(b, -1) for b, w, v in zip(blocks, of_article, first)]
    kept = []
    for i, (b, v) in enumerate(zip(blocks, first)):
        if v is None:
            near = [j for j, d in enumerate(first) if d is not None and (of_article[j] or not of_article[i])]
            left, right = [j for j in near if j < i][-1:], [j for j in near if j > i][:1]
            around = {first[j] for j in left + right}
            if not around:
                v = of_article[i] or not any(of_article)
            elif not any(of_article) and True not in first:
                v = True
            elif len(around) == 1:
                v = around.pop()
            elif of_article[i] or article:
                v = of_article[i]
            else:
                v = first[left[0]] if i - left[0] <= right[0] - i else first[right[0]]
        if v:
            kept.append(b[0])
    return "\n\n".join(kept)


def test_random_pages_equal_a_slow_version():
    rng = random.Random(3)
    words = "the of and to in story paper river house quickly market number".split()

    def piece():
        text = " ".join(rng.choices(words, k=rng.choice([1, 3, 6, 12, 20, 40])))
        return rng.choice([text, text, text, f"<a href=x>{text}</a>", f"{text} <a href=x>{rng.choice(words)}</a>"])

    def run(k):
        return "".join(rng.choice(["<p>{}</p>", "<div>{}</div>"]).format(piece()) for _ in range(rng.randint(0, k)))

    seen = set()
    for _ in range(3000):
        aside = lambda: f"<aside>{run(2)}</aside>" if rng.random() < 0.3 else ""
        middle = run(3) + aside() + run(3)
        page = run(3) + aside() + (f"<article>{middle}</article>" if rng.random() < 0.6 else middle) + run(3)
        blocks, marks = H.blocks_of(page)
        H.doubt(blocks, marks)
        if any(not m.believed for m in marks) or sum(b.stops for b in blocks) < 0.1 * sum(b.words for b in blocks):
            continue
        seen.add(H.main_text(page) == "")
        assert H.main_text(page) == slow_text(page), page
    assert seen == {True, False}


def test_empty_table_null_ids_and_clashing_names(spark):
    schema = "page_id long, url string, html string, text int, n_chars string, `a.b` int"
    assert H.extract(spark.createDataFrame([], schema)).collect() == []
    rows = H.extract(spark.createDataFrame([(None, None, None, 1, "x", 2), (1, "u", f"<p>{GOOD}", 1, "x", 2), (1, "u", f"<p>{GOOD}", 1, "x", 2)], schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, GOOD, len(GOOD)), (1, GOOD, len(GOOD))]
