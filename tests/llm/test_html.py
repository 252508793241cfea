"""The main-text extractor: what its tree decides by, held-out pages, and a plain extractor of marked articles."""

import html as entities
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq

from palimpsest.llm import html

#: Pages unlike those of the labelled table, marked in the same way.
HELD_OUT = (
    "<div id=top><a>-{s}</a> <a>{m}</a></div><h1>+{t}</h1><div>+{l}</div><div>+{l}</div><div>+{m}</div><div>+{l}</div><div>-<a>{s}</a> <a>{s}</a> <a>{s}</a></div>",
    "<table><tr><td><a>-{s}</a></td><td><a>-{s}</a></td></tr></table><h2>+{t}</h2><p>+{l}</p><p>+{l}</p><p>+{l} <a>{s}</a></p><table><tr><td><a>-{m}</a></td><td><a>-{m}</a></td></tr></table>",
    "<header><p>-{x}</p></header><div class=has-sidebar><main><section><h1>+{t}</h1><p>+{x}</p></section><section><p>+{x}</p><blockquote>+{m}</blockquote></section></main></div><aside>-{x}</aside>",
    "<form><div class=cookie-bar>-{m}</div><article class='post hentry tag-politics'><p>+{x}</p><p>+{x}</p></article><div class=disqus>-{x}</div></form>",
    "<div class='entry-content'><p>+{x}</p><div class=newsletter-signup>-{m}</div><p>+{x}</p></div><ul class='related-posts'><li>-{m}</li></ul>",
)


def share_right(x, y):
    return float((html.tree().predict(x) == y).mean())


def test_held_out_pages():
    x, y = html.labelled(HELD_OUT, variants=40, seed=5)
    assert share_right(x, y) > 0.97
    x, y = html.labelled(seed=6)  # the table's pages with other runs of words
    assert share_right(x, y) > 0.99


def test_words_and_links_of_neighbours_decide_where_nothing_is_marked():
    pages = tuple(p for p in html.LABELLED if not re.search(r"<article|<main|\{[ABC]\}", p))
    x, y = html.labelled(pages, variants=40, seed=7)
    assert share_right(x, y) > 0.97
    mixed = x.copy()
    rng = np.random.default_rng(0)
    mixed[:, html.NEIGHBOURS] = rng.permutation(mixed[:, html.NEIGHBOURS])
    assert share_right(mixed, y) < share_right(x, y) - 0.05
    own = x.copy()
    own[:, :2] = rng.permutation(own[:, :2])
    assert share_right(own, y) < share_right(x, y) - 0.05


def test_names_decide_no_block_of_the_given_pages_and_articles_come_whole():
    decided = n = 0
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        x = html.features(html.blocks(row["html"] or ""))
        bare = x.copy()
        bare[:, html.NAMES] = 0
        decided += int((html.tree().predict(x) != html.tree().predict(bare)).sum())
        n += len(x)
        # A plain reader of these pages: what stands in their article element, cut at block tags.
        article = re.search(r"(?s)<article>(.*?)</article>", row["html"] or "")
        pieces = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1|ul|li|div)[^>]*>", article.group(1))] if article else []
        assert html.main_text(row["html"]) == "\n".join(p for p in pieces if p)
    assert n > 4000 and decided == 0


def test_wrappers_and_states_take_no_article():
    long = "plain words of a story that goes on " * 5
    for page in (
        f"<div class='more-info'><p>{long}</p></div>", f"<div class='story search-results-note'><p>{long}</p></div>", f"<div class=widget><article><p>{long}</p></article></div>", f"<article><div class=legal><p>{long}</p></div></article>",
        f"<div class='no-sidebar comments-open'><article class='post tag-politics'><p>{long}</p></article></div>", f"<form action=x><article><p>{long}</p></article></form>", f"<div class='post-content social-sharing-on'><p>{long}</p></div>",
    ):
        assert html.main_text(page) == long.strip(), page[:60]
    cards = f"<article><p>{long}</p></article><div class='related-posts'><article><p>{long}</p></article></div>"
    assert html.main_text(cards) == long.strip()


def test_nesting_is_linear():
    def seconds(n):
        page = "<div class=a>x" * n + "</section></ul>" * n
        return min(_timed(page) for _ in range(3))

    def _timed(page):
        begin = time.process_time()
        html.blocks(page)
        return time.process_time() - begin

    assert seconds(32_000) < 10 * seconds(8_000) + 0.2


def test_blocks_of_odd_markup_against_a_plain_reader():
    rng = random.Random(3)
    for _ in range(200):
        words, markup = [], []
        for _ in range(rng.randrange(12)):
            w = rng.choice(["a", "é", "x &amp; y", "1 &lt; 2", "long word"])
            words.append(" ".join(entities.unescape(w).split()))
            markup.append(rng.choice(["<p>{}</p>", "<div>{}", "<P CLASS='a>b'>{}</P>", "<li>{}\n</li>", "<!-- > -->\n<td>{}</td>", "<h2>{}</h2><script>if (a<b) '</p>'</script>"]).format(w))
        assert [b.text for b in html.blocks("".join(markup))] == words
