"""Pages that once hung, lost their own parts or kept readers' comments."""

import time

import pytest

from kgweave.llm.html_extract import main_text

TEXT = "One two, three four, five six seven. " * 6
WORDS = TEXT.strip()
P = f"<p>{TEXT}</p>"
PAGES = {
    f"<article><div class='post-header'><h1>Head</h1></div>{P}</article>": f"Head {WORDS}",
    f"<article><div class='header'><h1>Head</h1></div>{P}</article>": f"Head {WORDS}",
    f"<article><h2 id='navigation'>Navi</h2>{P}</article>": f"Navi {WORDS}",
    f"<article>{P}<section id='legal'><p>Law text.</p></section></article>": f"{WORDS} Law text.",
    f"<article>{P}<p class='notice'>Note.</p></article>": f"{WORDS} Note.",
    f"<article>{P}<p><label>Lab</label> x</p></article>": f"{WORDS} Lab x",
    f"<body><article>{P}</article><article class='comment'>{P * 5}</article></body>": WORDS,
    f"<body><article>{P}<div class='comment-body'>{P * 5}</div></article></body>": WORDS,
    f"<body><article>{P}</article><div class='reader-comments'>{P * 3}</div><section id='responses'>{P}</section></body>": WORDS,
    f"<article><p>AT&<b>amp;</b> x</p>{P}</article>": f"AT&amp; x {WORDS}",
    f"<article>{P}<div class='advert'>buy, now</div><div class='share'>x</div></article>": WORDS,
    f"<body><div id='header'>Site</div><article>{P}</article><div class='footer'>f</div><form><label>Name</label></form></body>": WORDS,
    f"<article>{P}</article><p>Short.</p>": f"{WORDS} Short.",
    f"<article><p title='a > b' data-x=\"<i>\">Q</p>{P}</article>": f"Q {WORDS}",
    f"<article><p title=it's>Q</p>{P}<p>don't</p></article>": f"Q {WORDS} don't",
}


@pytest.mark.parametrize("page", PAGES)
def test_page(page):
    assert main_text(page)[0] == PAGES[page]


#: Beginning, what is repeated, how often, and end.
BROKEN = [
    ("<a ", '"', 1_000_000, ""),
    ("", '<a href="b c ', 100_000, ""),
    ('<a ="', '<a "="', 200_000, ""),
    ('<a ="', '<a "="', 200_000, '"">'),
    ("", "<", 1_000_000, ""),
    ("", "<!", 500_000, ""),
    ("", "<![CDATA[", 100_000, ">"),
    ("", "<!--", 200_000, ">"),
    ("", "<a ='", 200_000, ">"),
    ("", "<p ", 300_000, ">x"),
    ("", "<div class=x>x, y ", 8_000, ""),
]


@pytest.mark.parametrize("begin, unit, times, end", BROKEN)
def test_broken_markup_takes_linear_time(begin, unit, times, end):
    """A page twice as long takes about twice the time, and a megabyte some seconds on a slow machine."""
    took = []
    for n in (times // 2, times):
        start = time.process_time()
        main_text(begin + unit * n + end)
        took.append(time.process_time() - start)
    assert took[1] < 20 and took[1] < 4 * took[0] + 0.5
