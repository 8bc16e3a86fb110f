import html
import itertools
import re

import pytest

import __spark_entry__ as entry
from millrace.llm import op04_html as H
from tests.conftest import SMALL


def test_best_run_against_all_runs():
    import random

    rng = random.Random(3)
    for _ in range(300):
        s = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        low, high = H.best_run(s)
        every = [sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2)]
        assert sum(s[low:high]) == max([0, *every])


PAGE = """<html><head><title>T</title><style>p {x:y}</style></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav>
<div class="cookie-notice">We use cookies on this site</div><div id=main><article><h1>A &amp; B</h1><p>First   <b>bold</b>
paragraph with some words in it, long enough.</p><div class="ad">Buy now buy now</div><p>Second &#233;t&eacute; paragraph &lt;ok&gt; also long enough to count.</p>
<script>var a = "<p>no</p>";</script></article></div><section class="comments"><p>Reader says hello to everyone here today</p></section><footer>Copyright us</footer></body></html>"""


def test_article_without_the_rest():
    text = H.extract(PAGE, H.DEFAULT)
    assert text == "A & B\n\nFirst bold paragraph with some words in it, long enough.\n\nSecond été paragraph <ok> also long enough to count."


def test_query(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = entry.queries()["op4_html"](spark, SMALL).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.collect())
    assert all(r.n_chars == len(r.text) for r in rows)
    assert not any("<script" in r.text or "\n\n\n" in r.text for r in rows)
    assert sum(r.n_chars > 0 for r in rows) > 0.9 * len(rows)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "no tags at all"), (4, "u", "<p>a<p>b</div></div><b>"), (4, "u", "<p>a<p>b</div></div><b>"), (5, "u", "<" * 5000), (6, "u", "<!-- open"), (7, "u", "<p>" + "word " * 100000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, text string")
    found = {(r.page_id, r.url): r for r in H.main_text(df, H.DEFAULT).collect()}
    assert found[(1, "u")].text == "" and found[(2, None)].n_chars == 0
    assert found[(None, "u")].text == "no tags at all"
    assert found[(7, "u")].n_chars == 499999
    assert H.main_text(df.limit(0), H.DEFAULT).count() == 0
    assert H.learn(df.limit(0)) == H.DEFAULT


def article(page: str) -> str:
    """The article of a page of the given tables, by cutting it out of the source."""
    inside = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S).group(1)
    inside = re.sub(r"<script.*?</script>|<!--.*?-->", "", inside, flags=re.S)
    blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|table|tr|td)\b[^>]*>", inside)
    blocks = [html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", x))) for x in blocks]
    return "\n\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


MUTATIONS = {
    "as they are": lambda h: h,
    "paragraphs never closed": lambda h: h.replace("</p>", ""),
    "list items never closed": lambda h: h.replace("</li>", ""),
    "menu never closed": lambda h: h.replace("</nav>", ""),
    "advert never closed": lambda h: h.replace("</div>", ""),
    "article never closed": lambda h: h.replace("</article>", ""),
    "stray end tags": lambda h: h.replace("<p>", "</span></i><p>").replace("<article>", "</section><article>"),
    "upper case, attributes": lambda h: h.replace("<p>", "<P CLASS='text' data-x=\"a>b\">").replace("</p>", "</P >"),
}


@pytest.mark.parametrize("name", MUTATIONS)
def test_every_page_equals_its_article(spark, name):
    pages = [r.html for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/pages.parquet").collect()]
    weights = H.learn_weights(pages[::2])
    for page in pages:
        assert H.extract(MUTATIONS[name](page), weights) == article(page)


def test_optional_end_tags_and_classes_inside_an_article():
    words = lambda n: " ".join(f"word{n}{i}" for i in range(12))
    page = f'<article><p>{words(1)}<p class="ad">Buy now<p>{words(2)}<section id="legal"><p>{words(3)}</section><header><h2>{words(4)}</h2></header><ul><li>{words(5)}<li class="share">Share this<li>{words(6)}</ul></article>'
    assert H.extract(page, H.DEFAULT).split("\n\n") == [words(n) for n in (1, 2, 3, 4, 5, 6)]
    assert H.extract(f"<body><nav><p>Home<p>{words(1)}<p>{words(2)}</body>", H.DEFAULT).split("\n\n") == [words(1), words(2)]
    assert H.extract(f'<div id="legal"><p>{words(9)}</div><article><p>{words(1)}\n{words(2)}</article>', H.DEFAULT) == words(1) + " " + words(2)


BODY = "<p>one two three four five six seven eight nine ten</p><p>eleven twelve thirteen fourteen fifteen sixteen</p>"
TEXT = "one two three four five six seven eight nine ten\n\neleven twelve thirteen fourteen fifteen sixteen"
AROUND = '<html><body><nav><a href="/">home page</a> <a href="/x">contact us</a></nav>{}<footer>all rights of this page</footer></body></html>'


def _words(pattern):
    listed = re.search(r"\(\?:\^\|\[\\s_-\]\)\(\?:(.*)\)\(\?:\$", pattern.pattern)[1]
    return re.sub(r"\(\?:[^)]*\)\??|\w\?", "", listed).split("|")


def test_hints_do_not_exclude_what_holds_the_article():
    for word in [*_words(H._NEVER_HINT), *_words(H._OUTSIDE_HINT)]:
        for wrapper in (f'<div class="has-{word}"><article>{BODY}</article></div>', f'<div class="page"><div id="{word}-x"><div><article>{BODY}</article></div></div></div>'):
            assert H.extract(AROUND.format(wrapper), H.DEFAULT) == TEXT, word
    for page in (
        f'<div class="layout has-sidebar"><article>{BODY}</article></div>',
        f'<div class="no-ads"><article>{BODY}</article></div>',
        f'<article><div class="social-science">{BODY}</div></article>',
        f'<form id="aspnetForm"><article>{BODY}</article></form>',
        f'<form id="aspnetForm"><div>{BODY}</div></form>',
    ):
        assert H.extract(AROUND.format(page), H.DEFAULT) == TEXT


def test_hints_still_exclude_comments_and_adverts():
    comment = '<section class="comments"><article class="comment"><p>' + "first reader says a lot " * 30 + "</p></article></section>"
    advert = '<div class="ad-box"><p>buy this now</p></div>'
    half = BODY.index("<p>eleven")
    for page in (f"<article>{BODY}</article>{comment}", f"<article>{BODY}{comment}</article>", f"<article>{BODY[:half]}{advert}{BODY[half:]}</article>{comment}"):
        assert H.extract(AROUND.format(page), H.DEFAULT) == TEXT


def test_article_is_not_parted_by_tables():
    tables = "<table><tr><td></td></tr></table>" * 40
    half = BODY.index("<p>eleven")
    assert H.extract(AROUND.format(f"<article>{BODY[:half]}{tables}{BODY[half:]}</article>"), H.DEFAULT) == TEXT


def test_label_in_a_paragraph_is_text():
    assert H.extract(AROUND.format("<article><p>a field <label>called name</label> has a value</p></article>"), H.DEFAULT) == "a field called name has a value"
