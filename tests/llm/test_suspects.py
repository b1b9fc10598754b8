"""Forms and listed words in classes and ids do not take the article with them."""

import pytest

from tarmac.llm.main_text import main_text

STORY = "".join(f"<p>Paragraph {k} of the story, with some more words in it.</p>" for k in range(6))
TEXT = " ".join(f"Paragraph {k} of the story, with some more words in it." for k in range(6))
MENU = "<div class=menu><a href=x>Home</a> <a href=y>News</a></div>"
WRAPPERS = [
    "div class='has-sidebar'", "div class=no-header", "div class='content-with-sidebar'", "div class='sticky-header'",
    "div id='menu-page'", "form action=x", "div class=sidebar", "div role=form",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_a_wrapper_keeps_the_article(wrapper, element):
    page = f"<body><{wrapper}>{MENU}<{element}>{STORY}</{element}></{wrapper.split()[0]}></body>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("name", ["related-work", "legal", "notice-of-recall"])
def test_a_block_of_the_article_stays(name):
    block = "<p>Others have written on this at length, in two books and a report.</p>"
    page = f"<article>{STORY}<section class={name}>{block}</section></article>"
    assert main_text(page) == f"{TEXT} {block[3:-4]}"


@pytest.mark.parametrize("block", [
    "<div class=ad><p>Buy this now, and that too, at a low price, only today and only here, all of it</p></div>",
    "<div class=related-stories><a href=x>One long headline of another story</a><a href=y>And one more of them</a></div>",
    "<section id=comments><article>A reader says a great deal about all this, again and again.</article></section>",
    "<form><p>Your name and address, please, and whatever else you want to tell us about yourself.</p></form>",
])
def test_other_suspects_go(block):
    assert main_text(f"<body><article>{STORY}</article>{block}</body>") == TEXT
    assert main_text(f"<body><article>{STORY}{block}</article></body>") == TEXT


def test_comments_longer_than_a_story_without_article():
    comments = "<article><p>A reader says a great deal about all this, again and again.</p></article>" * 20
    assert main_text(f"<body><div>{STORY}</div><div class=comments>{comments}</div></body>") == TEXT


def test_headline_and_further_articles_beside_the_best_one():
    second = "A second part of the story, of some length as well, follows here, and it goes on for a while with what else there is to tell."
    more = f"<article><p>{second}</p></article>"
    page = f"<body><div><h1>Headline</h1><article>{STORY}</article>{more}</div></body>"
    assert main_text(page) == f"Headline {TEXT} {second}"
