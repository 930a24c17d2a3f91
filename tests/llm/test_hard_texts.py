"""Attributes, names and leads of pages; license notices in long texts."""

import random
import time

import pytest

from snagline.llm import html, licenses

LONG = "A sentence of the article that goes on. " * 20
TEXT = LONG.strip()


@pytest.mark.parametrize("open_tag", [
    '<article title="The hidden city">', '<div class="post" data-hidden="false">', '<main aria-hidden="false">', "<article hidden>", '<div data-class="ad">',
    '<div data-role="banner" DATA-ID=sidebar>', '<article style="display:none">', '<section class="post" id=\'entry-hidden\'>',
])
def test_attributes_that_do_not_hide_an_article(open_tag):
    assert html.article(f"<body>{open_tag}<p>{LONG}</p></{open_tag[1:].split()[0]}></body>", None) == TEXT


def test_words_of_a_link_stay():
    assert html.article(f'<div><p>{LONG}<a href="/id/hidden/class">link words</a></p></div>', None) == f"{TEXT} link words"


@pytest.mark.parametrize("name", [
    'class="comments-area"', 'class="comment-list"', 'id="comments-section"', 'class="commentList"', 'class="sidebar-left"', 'class="related-posts"', "class=share-buttons",
    'class="cookie-bar"', 'class="ad-container"', 'style="color:red; Display : none"', "hidden", "class='x' HIDDEN=''", 'ID="newsletterBox"', 'role="navigation"',
])
def test_side_parts_by_name(name):
    assert html.article(f"<div><p>{LONG}</p><div {name}><p>Other words</p></div></div>", None) == TEXT


def test_comments_longer_than_the_post():
    assert html.article(f'<div class=post><p>{LONG}</p></div><div class="comments-wrap"><p>{LONG * 3}</p></div>', None) == TEXT


def test_tags_do_not_close_themselves():
    assert html.article(f"<div><script src=/js/a/>var leaked = 1;</script><p>{LONG}</div>", None) == TEXT
    assert html.article(f"<div><p><a href=foo/>linked</a> {LONG}</div>", None) == f"linked {TEXT}"
    assert html.article(f"<svg/><p>{LONG}", None) == TEXT


def test_leads_and_titles_beside_the_container():
    assert html.article(f"<div class=wrap><div class=intro>Intro words</div><div class=bodytext><p>{LONG}</p></div></div>", None) == f"Intro words\n\n{TEXT}"
    assert html.article(f"<div class=wrap><h1>Title</h1><p>By us</p><div class=bodytext><p>{LONG}</p></div></div>", None) == f"Title\n\n{TEXT}"


@pytest.mark.parametrize("page", ["<p><div>" + "<b>" * 30_000 + "<h1>x</h1>" * 30_000, "<a b='c' " * 100_000, "<p " + "/= " * 200_000 + ">x", "<li>" * 50_000 + "<dd>" * 50_000])
def test_open_elements_are_not_searched_again(page):
    began = time.process_time()
    html.article(page, None)
    assert time.process_time() - began < 8


@pytest.mark.parametrize("text", ["all rights reservd ", "permission is hereby grantd, free of charge, to any persn obtaining a copy ", "under the mit license ", "licensed under the aapche license, "])
def test_a_megabyte_of_notices(text):
    scan, times = licenses._scan(), (1 << 20) // len(text)
    began = time.process_time()
    found = scan(text * times)
    assert time.process_time() - began < 5
    if not text.startswith(("under", "licensed")):
        assert len(found[-1]) == times
    elif text.startswith("under"):
        assert found[1:4] == (times, 0, 4 * times - 4)


def test_misspelt_notices_that_all_differ():
    rng, find = random.Random(1), licenses.notice_finder()
    notice = "all rights reserved "
    text, want = "", 0
    for _ in range(400):
        at = rng.randrange(len(notice) - 1)
        text += rng.choice([notice[:at] + notice[at + 1 :], notice[:at] + "#" + notice[at:], notice]) + "and so on "
        want += 1
    found = [s for s in find(text) if s[2] == "all-rights-reserved"]
    assert len(found) == want and all(e <= 1 for *_, e in found)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_overlaps_go_to_the_match_with_fewer_errors():
    assert licenses.apart([(0, 5, 9), (1, 0, 5), (1, 4, 8), (2, 9, 12), (3, 8, 10)]) == [(0, 5, 9), (1, 0, 5), (2, 9, 12)]
