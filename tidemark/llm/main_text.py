"""Main text of web pages: the maximum-scoring contiguous region of words and tags.

A page is a sequence of words and tags. Every word scores +1 and every tag a
weight of at most 0 that depends on its name and class; the region with the largest
sum, found by one linear scan, is the content. The weights come from labelled
pages, whose markup names the content by exactly one ``<article>`` (or
``<main>``): a structured perceptron lowers the weights of tags that let the scan
run past the labelled region and raises those that keep it short, until a
margin of one more point per wrong word holds. Weights that are only seen in
other pages are ``UNSEEN``.

Inside the region, words of scripts, styles, forms, navigation, notices,
adverts and reader comments are left out, and what is never shown: titles,
templates and the descriptions of drawings. Such elements are known by name or by a
whole token of class, id or role. The tokens never count on html, body, main and
article, nor on an element that holds one of these; only an element named after
reader comments may hold articles, the comments, if one came before. Words of
formulas and drawings and the fallback of objects, audio and video are words like
others. Blocks are joined by one newline, white space inside a block becomes one space.

Defined results: a null or empty page, and one without words, has the empty text;
of equally good regions the first and shortest is taken; repeated rows are extracted
row by row; an empty table gives an empty result; other columns are ignored.
Without a labelled page all weights are ``UNSEEN``.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNSEEN, EPOCHS = -1.0, 20

#: Elements whose content is not text to read, and those that are blocks of their own.
RAW = {"script", "style", "noscript", "title", "textarea", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that count as one tag, however many are inside, and those of them where "/>" closes any tag.
WHOLE, FOREIGN = {"svg", "math", "template", "select"}, {"svg", "math"}
HOLDERS = {"html", "body", "main", "article"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "p", "pre", "section", "summary", "table", "tbody", "td", "text", "tfoot", "th",
    "thead", "tr", "ul",
}
LEFT_OUT = {
    "nav", "aside", "footer", "form", "button", "menu", "dialog", "fieldset", "label", "select", "option", "template", "desc", "metadata",
}
_COMMENTS = r"comments?|disqus|replies"
_NAMES = (
    rf"(?:ads?|advert\w*|banner|breadcrumbs?|{_COMMENTS}|cookies?|footer|menu|nav|navbar|navigation|newsletter|notice|popup"
    r"|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)"
)
#: A whole token: one of the names, or names and parts of a layout ("comment-list", "cookie-banner").
LEFT_OUT_CLASS = re.compile(
    rf"{_NAMES}(?:[_-](?:{_NAMES}|area|bar|block|body|box|buttons?|container|form|items?|links?|list|panel|section|slot|unit|wrap|wrapper))*",
    re.IGNORECASE,
)
COMMENTS_CLASS = re.compile(rf"(?:{_COMMENTS})(?:[_-].*)?", re.IGNORECASE)
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


class Element(NamedTuple):
    name: str
    key: str
    number: int
    whole: bool  # tags inside do not count
    foreign: bool


class Page:
    """The tokens of a page: tags with a key, texts with their words."""

    def __init__(self, html: str | None):
        self.keys: list[str | None] = []  # tag key, "" for a tag that does not count, or None for a text
        self.names: list[str] = []
        self.texts: list[str] = []  # words of a text, "" for a tag
        self.words: list[int] = []
        html, at = html or "", 0
        # of each element, 0 is the page: its parent, whether its name or its class leaves it out
        parents, named, classed = [0], [False], [False]
        comments: set[int] = set()
        owners: list[tuple[int, int]] = []  # place of a text and its element
        stack = [Element("", "", 0, False, False)]
        held: list[str] = []
        articles = 0

        def tell() -> None:
            if held:
                # joined first, so that references cut by the tokenizer are whole
                text = references.unescape("".join(held))
                held.clear()
                owners.append((len(self.keys), stack[-1].number))
                self._put(None, "", text, len(text.split()))

        while at < len(html):
            # always matches: a lone "<" is text
            m = TOKEN.match(html, at)
            at = m.end()
            if m["text"] is not None:
                held.append(m["text"])
                continue
            if m["name"] is None:
                continue
            tell()
            name, top = m["name"].lower(), stack[-1]
            if m["close"]:
                place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), None)
                key, inner = name, top.whole
                if place is not None:
                    key, inner = stack[place].key, stack[place - 1].whole or name in WHOLE
                    del stack[place:]
                self._put("" if inner else "/" + key, name, "", 0)
                continue
            closed = m["rest"].endswith("/")
            if name in RAW and not (closed and top.foreign):
                self._put("" if top.whole else name, name, "", 0)
                end = RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
                continue
            kinds = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(m["rest"])).lower().split()
            key = name if name in WHOLE else ".".join([name, *sorted(kinds)[:3]])
            self._put("" if top.whole else key, name, "", 0)
            if name in VOID or closed:
                continue
            if name == "p":  # a paragraph ends where the next begins
                while stack[-1].name in ("p", "b", "i", "em", "strong", "span", "a") and any(s.name == "p" for s in stack):
                    stack.pop()
                top = stack[-1]
            number, hits = len(parents), [k for k in kinds if LEFT_OUT_CLASS.fullmatch(k)]
            parents.append(top.number)
            named.append(name in LEFT_OUT)
            classed.append(bool(hits) and name not in HOLDERS)
            if any(map(COMMENTS_CLASS.fullmatch, hits)):
                comments.add(number)
            if name in HOLDERS and not top.whole:
                for s in stack:
                    if name != "article" or not articles or s.number not in comments:
                        classed[s.number] = False
                articles += name == "article"
            foreign = name in FOREIGN or top.foreign and name not in ("foreignobject", "annotation-xml")
            stack.append(Element(name, key, number, top.whole or name in WHOLE, foreign))
        tell()
        out = [False] * len(parents)
        for i in range(1, len(parents)):
            out[i] = named[i] or classed[i] or out[parents[i]]
        for i, number in owners:
            if out[number]:
                self.texts[i], self.words[i] = "", 0

    def _put(self, key: str | None, name: str, text: str, words: int) -> None:
        self.keys.append(key)
        self.names.append(name)
        self.texts.append(text)
        self.words.append(words)

    def labelled(self) -> tuple[int, int] | None:
        """First and last token inside the one article (or main) element."""
        for name in ("article", "main"):
            starts = [i for i, k in enumerate(self.keys) if self.names[i] == name and k and k[0] != "/"]
            ends = [i for i, k in enumerate(self.keys) if self.names[i] == name and k and k[0] == "/"]
            if len(starts) == len(ends) == 1 and ends[0] - starts[0] > 1:
                return starts[0] + 1, ends[0]
        return None

    def text(self, start: int, end: int) -> str:
        blocks, current = [], []
        for i in range(start, end):
            if self.keys[i] is None:
                current.append(self.texts[i])
            elif self.names[i] in BLOCKS:
                blocks.append("".join(current))
                current = []
        blocks.append("".join(current))
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; (0, 0) if none is above 0."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def token_scores(page: Page, weights: dict[str, float]) -> list[float]:
    return [float(n) if k is None else weights.get(k, UNSEEN) if k else 0.0 for k, n in zip(page.keys, page.words)]


def learned(pages: list[Page]) -> dict[str, float]:
    """Tag weights from the labelled pages among ``pages``."""
    known = [(p, p.labelled()) for p in pages]
    known = [(p, r) for p, r in known if r]
    weights: dict[str, float] = {k: UNSEEN for p, _ in known for k in p.keys if k}
    for _ in range(EPOCHS):
        wrong = 0
        for page, (start, end) in known:
            # words outside count double and words inside nothing: the margin
            scores = [
                s if k is not None else (0.0 if start <= i < end else 2.0 * n)
                for i, (s, k, n) in enumerate(zip(token_scores(page, weights), page.keys, page.words))
            ]
            inside = sum(scores[start:end])
            a, b = best_region(scores)
            if sum(scores[a:b]) > inside + 1e-9:
                wrong += 1
                for i in range(min(a, start), max(b, end)):
                    key = page.keys[i]
                    got, due = a <= i < b, start <= i < end
                    if key and got != due:
                        weights[key] = min(0.0, weights[key] + (0.5 if due else -0.5))
        if not wrong:
            break
    return weights


def train(pages: DataFrame, sample: int = 400) -> dict[str, float]:
    """Weights from at most ``sample`` pages with a labelled region, those with the smallest hash."""
    bounded = (
        pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
        .select("html").orderBy(F.xxhash64("html"), "html").limit(sample)
    )

    def learn(rows: pa.Table) -> pa.Table:
        weights = learned([Page(h) for h in rows.column("html").to_pylist()])
        return pa.table({"tag": pa.array(weights.keys(), pa.string()), "weight": pa.array(weights.values(), pa.float64())})

    rows = bounded.groupBy(F.lit(0).alias("whole_sample")).applyInArrow(learn, "tag string, weight double").collect()
    return {r["tag"]: r["weight"] for r in rows}


def main_text(html: str | None, weights: dict[str, float]) -> str:
    page = Page(html)
    return page.text(*best_region(token_scores(page, weights)))


def extracted(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``page_id, url, text, n_chars`` per page row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        work, "page_id long, url string, text string, n_chars long"
    )
