"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of words, which score positive, and tags, which score negative; one linear scan finds the
contiguous stretch with the largest sum, the content region. The weights are log-odds of lying inside the article,
counted over labelled pages: those of a bounded sample whose article is marked (article, main, or an articleBody
element). Words in elements that are never content (navigation, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments of readers) are left out of the text, even inside the region, and score a little below
zero, so that an advert in the middle of an article does not cut it in two.

Inside the region, block elements part the text into blocks; character references are decoded, white space inside
a block becomes one space, and blocks are joined by an empty line. Paragraphs, list items, table cells and the like end
where the next one or their parent ends, as their end tags are optional. An element that is left out by its name or class
but never closed covers what follows up to the next block that is no list, so a missing end tag does not take the article
with it. Names and classes that may also head a part of an article (header, legal, copyright, notes on sources) count
only outside a marked article. Hints by class or id, and forms, are not believed where they cover a marked article, or leave
next to nothing of it; tags weigh little inside a marked article, so that tables or figures in it do not part it in two.

Null and empty pages, and pages without text, give an empty text; an empty table gives no rows. Pages of any length are
read whole; stray tags are skipped. Of equally good regions the first is taken. Repeated rows give repeated results;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import batches, bounded_sample, one_each, table, texts

MAX_TRAINING = 400  # pages
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>?|</?[a-zA-Z](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|</?[a-zA-Z][^<>]*>?|[^<]+|<",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_HINT = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head nav header footer aside form button menu dialog label input option fieldset object audio video canvas map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LISTS = frozenset("ul ol li menu dir".split())
#: Elements whose end tags are optional: what starts beside each ends it, unless one of the last stands between.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
OPTIONAL = frozenset("p li dt dd tr td th thead tbody tfoot option".split())


def _hint(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


_NEVER_HINT = _hint(
    "ads?|adv|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:ed|s)?|promo(?:tion|s)?|sidebars?|widgets?|comments?|respond|replies|disqus|menus?|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|popup|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommended|pagination|pager"
)
_OUTSIDE_HINT = _hint("side|footer|header|masthead|modal|overlay|login|toolbar|search|skip|copyright|legal|disclaimer|complementary|contentinfo")
_ARTICLE_HINT = re.compile(r"articleBody", re.I)

#: Weights where nothing was labelled: of a word, of a word that is never content, of a tag not named.
DEFAULT = {"": 1.0, "never": -0.05, "tag": -1.5, "p": -0.3, "br": -0.1, "b": -0.1, "i": -0.1, "em": -0.1, "strong": -0.1, "h1": -0.3, "h2": -0.3, "li": -1.0, "a": -2.0}


#: Hints that name what an element is even if it holds nearly all words of a page.
_SURE_HINT = _hint("comments?|respond|replies|disqus|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|cookies?|consent|gdpr|footer|sidebars?|ads?|adverts?|advertisements?")
IN_ARTICLE = 0.001  # of a tag's weight counts inside a marked article
LEAST_LEFT = 0.1  # of an article's words, or of a page's without one: if less is left, hints misled


class _Elements:
    """The open elements of a page that matter, and the stretches of tokens that excluded and article elements cover."""

    def __init__(self):
        self.open: list[tuple[str, list | None]] = []
        self.count: Counter[str] = Counter()
        self.inline: Counter[str] = Counter()  # elements that neither end others nor cover anything
        self.stretches: list[list] = []  # [kind, start, end, closed by its own end tag, how sure: 2 its name, 1 its hint, 0 a hint that wrappers have too]
        self.articles = 0

    def _pop(self, at: int, own: str | None) -> None:
        name, stretch = self.open.pop()
        self.count[name] -= 1
        if stretch:
            stretch[2], stretch[3] = at, name == own or name in OPTIONAL
            self.articles -= stretch[0] == "article"

    def start(self, name: str, kind: str | None, at: int, sure: int = 2) -> None:
        if name in BLOCKS and self.count["p"]:
            k = len(self.open) - 1
            while self.open[k][0] != "p" and self.open[k][0] not in BLOCKS:
                k -= 1
            if self.open[k][0] == "p":
                while len(self.open) > k:
                    self._pop(at, None)
        ends, within = ENDED_BY.get(name, ((), ()))
        if any(self.count[e] for e in ends):
            k = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] in within), -1) + 1
            k = next((j for j in range(k, len(self.open)) if self.open[j][0] in ends), len(self.open))
            while len(self.open) > k:
                self._pop(at, None)
        if name in BLOCKS or name in NEVER or kind or self.count[name]:
            stretch = [kind, at, None, False, sure] if kind else None
            if stretch:
                self.stretches.append(stretch)
                self.articles += kind == "article"
            self.open.append((name, stretch))
            self.count[name] += 1
        else:
            self.inline[name] += 1

    def end(self, name: str, at: int) -> bool:
        """Whether the end tag ends something."""
        if self.count[name] > 0:
            while self.open[-1][0] != name:
                self._pop(at, None)
            self._pop(at, name)
            return True
        known = self.inline[name] > 0
        self.inline[name] -= known
        return known

    def close(self, at: int) -> None:
        while self.open:
            self._pop(at, None)


def _misled(stretches: list[list], words: list[int]) -> list[list]:
    """The excluded stretches whose hint or form tag is wrong. words: running counts of the tokens' words.

    An element round the main article is none; the main article is the longest marked one, of those that are not
    excluded if there are any. Where nearly all words of it (or of a page without one) are excluded, the largest hinted
    elements that hold most of them are none either, unless their hint is a sure one.
    """
    never = [s for s in stretches if s[0] == "never" and s[3]]  # those without an end tag cover little anyway
    if all(s[4] == 2 for s in never):
        return []
    size = lambda s: words[s[2]] - words[s[1]]
    within = lambda s, t: t[1] <= s[1] and s[2] <= t[2]
    articles = [s for s in stretches if s[0] == "article" and size(s)]
    free = [a for a in articles if not any(within(a, s) for s in never)]
    main = max(free or articles, key=size, default=None)
    wrong = [s for s in never if s[4] < 2 and main and within(main, s)]
    whole = main or ["", 0, len(words) - 1]

    def left() -> int:
        total, reach = 0, whole[1]
        for s in [s for s in never if s not in wrong and s[2] > whole[1] and s[1] < whole[2]] + [["", whole[2], whole[2]]]:  # in order of their starts
            if s[1] > reach:
                total += words[s[1]] - words[reach]
            reach = max(reach, min(s[2], whole[2]))
        return total

    for s in sorted((s for s in never if s[4] == 0 and s not in wrong and within(s, whole)), key=size, reverse=True):
        if 2 * size(s) <= size(whole) or left() >= LEAST_LEFT * size(whole):
            break
        wrong.append(s)
    return wrong


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, value, excluded, in article): kind is "tag", with the name (and a slash) as value, or "text"."""
    parts: list[tuple[str, str]] = []
    elements = _Elements()
    for m in _TOKEN.finditer(page):
        t = m.group()
        if t[0] != "<" or len(t) == 1:
            parts.append(("text", t))
            continue
        found = None if m.group(1) or t[1] in "!?" else _NAME.match(t)
        if not found:
            continue
        name = found.group(1).lower()
        if t[1] == "/":
            if elements.end(name, len(parts)):
                parts.append(("tag", "/" + name))
            continue
        if name not in VOID and not t.endswith("/>"):
            hints = " ".join(h.strip("\"'") for h in _HINT.findall(t)) if "=" in t else ""
            marks = name in ("article", "main") or bool(hints) and bool(_ARTICLE_HINT.search(hints))
            plain = name not in ("html", "body", "article", "main") and bool(hints)
            never = name in NEVER and not (name == "header" and elements.articles) or plain and bool(_NEVER_HINT.search(hints))
            never = never or plain and not elements.articles and not marks and bool(_OUTSIDE_HINT.search(hints))
            never = never and not (name == "label" and elements.count["p"])  # a word of a paragraph
            sure = 2 if name in NEVER and name != "form" else 1 if bool(hints) and bool(_SURE_HINT.search(hints)) else 0
            elements.start(name, "never" if never else "article" if marks else None, len(parts), sure)
        parts.append(("tag", name))
    elements.close(len(parts))
    wrong: list[list] = []
    if any(s[0] == "never" and s[4] < 2 for s in elements.stretches):
        wrong = _misled(elements.stretches, [0, *accumulate(len(v.split()) if k == "text" else 0 for k, v in parts)])
    change = {"never": [0] * (len(parts) + 1), "article": [0] * (len(parts) + 1)}
    for stretch in elements.stretches:
        kind, start, end, own, _ = stretch
        if any(stretch is s for s in wrong):
            continue
        if kind == "never" and not own:  # no end tag: up to the next block after some text
            said = False
            for k in range(start, end):
                what, value = parts[k]
                said |= what == "text" and not value.isspace()
                if said and what == "tag" and value.lstrip("/") in BLOCKS and value.lstrip("/") not in LISTS:
                    end = k
                    break
        change[kind][start] += 1
        change[kind][end] -= 1
    never, article = accumulate(change["never"]), accumulate(change["article"])
    return [(kind, value, n > 0, a > 0) for (kind, value), n, a in zip(parts, never, article)]


def learn_weights(pages: list[str]) -> dict[str, float]:
    """Log-odds of words and of tags by name; words stay positive and tags negative whatever the counts say."""
    inside, outside = Counter(), Counter()
    for page in pages:
        own, marked = [], False
        for kind, value, never, article in tokens(page):
            marked |= article
            key, n = ("", len(value.split())) if kind == "text" else (value.lstrip("/"), 1)
            own.append((key, n, article and not never))
        if marked:
            for key, n, content in own:
                (inside if content else outside)[key] += n
    if not inside or not outside:
        return DEFAULT
    total_in, total_out = sum(inside.values()), sum(outside.values())
    odds = lambda k: math.log((inside[k] + 1) / (total_in + 2) * (total_out + 2) / (outside[k] + 1))
    weights = {k: min(-0.1, max(-4.0, odds(k) - odds(""))) for k in {*inside, *outside} if k}
    return weights | {"": max(0.3, min(2.0, odds(""))), "never": -0.05, "tag": -1.0}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the largest sum; equal sums give the earliest, nothing positive gives nothing."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def extract(page: str, weights: dict[str, float]) -> str:
    """The text of the content region of one page."""
    parts, scores = [], []
    other, word, never_word = weights["tag"], weights[""], weights["never"]
    for kind, value, never, article in tokens(page):
        parts.append((kind, value, never))
        if kind == "tag":
            scores.append(weights.get(value.lstrip("/"), other) * (IN_ARTICLE if article else 0.05 if never else 1))
        else:
            scores.append(len(value.split()) * (never_word if never else word))
    low, high = best_run(scores)
    blocks, block = [], []
    for kind, value, never in parts[low:high]:
        if kind == "text":
            if not never:
                block.append(value)
        elif value.lstrip("/") in BLOCKS:
            blocks.append("".join(block))
            block = []
        elif value.lstrip("/") == "br":
            block.append(" ")
    blocks.append("".join(block))
    clean = (" ".join(html_module.unescape(b).split()) for b in blocks if b)
    return "\n\n".join(b for b in clean if b)


def learn(pages: DataFrame, most: int = MAX_TRAINING) -> dict[str, float]:
    ids = bounded_sample(pages.where(F.col("html").isNotNull()), most, seed=3, key="page_id")
    rows = one_each(pages.where(F.col("page_id").isin(ids)).select("page_id", "html"), "page_id", "html").orderBy("page_id").collect() if ids else []
    return learn_weights([r.html for r in rows if r.html])


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "html"):
            found = [extract(h, weights) for h in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learn(pages))
