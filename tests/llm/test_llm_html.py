"""Main text of pages that are wrongly nested, oddly named or very long."""

import time

import pytest

from sparkfeat.llm import html

A = "<p>Text one, with commas, and more of it for a while.</p><p>Text two, longer, again with some commas, to read.</p>"
W = "Text one, with commas, and more of it for a while.\nText two, longer, again with some commas, to read."


@pytest.mark.parametrize("page, text", [
    (f"<html><head><title>x</title><body><div>{A}</div>", W), (f"<title>t</title><div>{A}</div>", W), (f"<head><meta x><div>{A}</div>", W),
    (f'<body><div class="content has-sidebar">{A}</div>', W), (f'<article class="post no-comments">{A}</article>', W),
    (f'<div class="nav-closed"><article>{A}</article></div>', W), (f'<body><div class="sidebar"><article>{A}</article></div>', W),
    (f"<nav><a href=1>m</a><article>{A}</article>", W), (f"<nav><ul><li>x</ul></nav><nav>y<main>{A}</main>", W),
    (f"<nav><article>teaser, one</article></nav><div>{A}</div>", W),
    (f'<article><p class="share-price">Share price, up.</p>{A}</article>', "Share price, up.\n" + W),
    (f'<article><div class="article-header"><h1>H</h1></div>{A}</article>', "H\n" + W),
    (f'<article>{A}<ul><li><a href=1>one</a><li><a href=2>two</a></ul></article>', W + "\none\ntwo"),
    (f"<body><div>{A}</div><p>Short, end.</p></body>", W + "\nShort, end."),
    (f'<body><div>{A}</div><div class="usercomments"><p>c, c, c, c, c, c, c.</p><p>c, c, c, c, c, c, c, c, c, c, c, c, d.</p></div>', W),
    (f'<body><div>{A}</div><div id="comment-list"><p>{"c, " * 90}.</p></div><div class="ad-slot"><p>Buy, now.</p></div>', W),
    (f"<div class=comments>{A}</div>", W), (f'<div class="widget">{A}<div class="advert">x, y</div></div>', W),
])
def test_the_article_is_kept_and_no_more(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div>x, y" * 24000, "<b>x</i>" * 20000, "<a " * 120000, "<i><div>" + "<b>x</i>" * 20000,
    "<li><ul>" + "<div>" * 10000 + "<li>a</li>" * 10000, "<p><table><td>" + "<div>z</div>" * 20000, "<span class=ad>" * 10000,
])
def test_long_pages_take_time_in_proportion(page):
    started = time.process_time()
    html.main_text(page)
    assert time.process_time() - started < 5
