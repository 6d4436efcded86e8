"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, each by what labelled pages show for
tokens of its kind: a word of a kind that lies outside the article with probability q is worth -log q, a tag of a kind
that lies inside it with probability p costs -log p, and nothing bounds either by hand. A linear scan finds the contiguous
region with the greatest sum: it alone decides where the article begins and ends. Blocks in the interior of the region
that are menus, adverts, forms or comments by their element, their name or what labelled pages show are left out. A page is
labelled where it marks its article with an <article>, <main> or role="main" element; of several, the longest is meant.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the sample that the weights are fitted on, in pages.
LABELLED_PAGES = 300

TEXT_SCHEMA = "page_id long, url string, text string, n_chars long"

#: HTML element names by their role in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "audio", "video", "title", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "input"}
ARTICLE = {"article", "main"}
#: Landmark and widget roles that are no article.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog"}
#: Words that name what the main text leaves out, where a whole class, id or label says nothing else.
MARKS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "cookie cookies consent gdpr newsletter subscribe signup login comment comments disqus".split()
)
#: Words beside a mark that only say where or in what shape it is.
PLACES = set("site page main top bottom left right upper lower primary secondary global container wrapper wrap inner outer box bar area section block list links item items group notice form".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _marks(name: str) -> bool:
    """Whether a name is made of marks and places alone; what follows a digit counts for nothing ('ad-300x250')."""
    parts = [x for x in (re.split(r"\d", x, maxsplit=1)[0] for x in re.split(r"[\s_-]+", name.lower())) if x]
    return any(x in MARKS for x in parts) and all(x in MARKS or x in PLACES for x in parts)


def _says(attributes: str) -> tuple[bool, bool, bool, bool, str]:
    """(is hidden, has a role that is no article, has a mark, is the main part, first class) by a tag's own attributes."""
    hidden = role = mark = main = False
    first = ""
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NONE.search(value)):
            hidden = True
        elif name == "role":
            said = set(value.lower().split())
            role, main = role or bool(said & ROLES), main or "main" in said
        elif name in ("class", "id"):
            said = value.split()
            mark = mark or any(map(_marks, said))
            first = said[0].lower() if name == "class" and said else first
        elif name == "aria-label":
            mark = mark or _marks(value)
    return hidden, role, mark, main, first


#: How a token is left out: not, by its block's name, by its element or because it is hidden.
IN, NAMED, OUT = 0, 1, 2


class Token:
    """A run of text (`tag` is '') or a tag; `kind` is what weights are learned for, the wider kind without a class after it;
    `out` is IN, NAMED or OUT, `article` says that it is inside the page's marked article."""

    __slots__ = ("text", "tag", "kind", "wide", "out", "article", "closing")

    def __init__(self, text: str, tag: str, kind: str, wide: str, out: int, article: bool, closing: bool = False):
        self.text, self.tag, self.kind, self.wide, self.out, self.article, self.closing = text, tag, kind, wide, out, article, closing


def tokenize(page: str | None) -> list[Token]:
    """Tokens of a page; raw elements, comments and declarations are skipped, cut-off tags at the end too. What wraps the
    longest marked article is no boilerplate for it, and another article is a teaser or a comment."""
    tokens, wrappers, main = _tokenize(page or "", frozenset(), -1)
    return tokens if main < 0 else _tokenize(page or "", wrappers, main)[0]


def _tokenize(page: str, kept: frozenset[int], main_start: int) -> tuple[list[Token], frozenset[int], int]:
    """Tokens, where the elements that begin at `kept` are no boilerplate and the article is the element at `main_start`; the
    boilerplate elements around the longest marked article, one that is not hidden if there is any, and its start or -1."""
    tokens: list[Token] = []
    # element with its class, inside a link, 1 in a main part and 2 in an article, its number, in the chosen article, in
    # another one, innermost boilerplate: (start, OUT or NAMED, hidden, next one)
    outside = ("", "", False, 0, -1, False, False, None)
    stack: list[tuple] = []
    around, seen, length, begins = [], [], [], []  # of each marked article: boilerplate, whether it is not hidden, characters, start
    at, low = 0, page.lower()

    def put(text: str) -> None:
        if text:
            _, _, link, _, number, article, other, wrap = stack[-1] if stack else outside
            if number >= 0:
                length[number] += len(text.strip())
            block, cls = next(((x[0], x[1]) for x in reversed(stack) if x[0] not in INLINE), ("body", ""))
            out = wrap[1] if wrap else IN
            start = f"{'out ' if out else 'other ' if other and not article else ''}{'a ' if link else ''}"
            tokens.append(Token(html.unescape(text), "", f"{start}{block}.{cls}" if cls else start + block, start + block, out, article))

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, tag, attributes = m[1] == "/", m[2].lower(), m[3] or ""
        if not closing and tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)").search(low, at)
            if tag == "head" and end is None:  # an unclosed head ends where the body begins
                end = re.compile(r"<body\b[^>]*>").search(low, at)
            at = end.end() if end else (at if tag == "head" else len(page))
            tokens.append(Token("", tag, f"<{tag}", f"<{tag}", OUT, bool(stack) and stack[-1][5]))
            continue
        cls = ""
        if closing:
            _, _, _, _, _, article, other, wrap = stack[-1] if stack else outside
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cls = stack[k][1]
                    del stack[k:]
                    break
        else:
            while stack and stack[-1][0] in _CLOSES.get(tag, ()):
                stack.pop()
            _, _, link, inside, number, article, other, wrap = stack[-1] if stack else outside
            hidden, role, mark, main, cls = _says(attributes)
            level = 2 if tag == "article" else 1 if tag in ARTICLE or main else 0
            if level > inside:
                around.append(wrap)
                seen.append(not (hidden or (wrap and wrap[2])))
                length.append(0)
                begins.append(m.start())
                inside, number = level, len(around) - 1
            article = article or m.start() == main_start
            other = other or (level == 2 and not article)
            structural = hidden or tag in BOILERPLATE or (role and not level) or (tag == "header" and not inside)
            if (structural or (mark and not level and tag not in ("html", "body"))) and m.start() not in kept:
                wrap = (m.start(), OUT if structural or (wrap and wrap[1] == OUT) else NAMED, bool(hidden or (wrap and wrap[2])), wrap)
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                stack.append((tag, cls, link or tag == "a", inside, number, article, other, wrap))
        start = f"{'out ' if wrap else 'other ' if other and not article else ''}<"
        tokens.append(Token("", tag, f"{start}{tag}.{cls}" if cls else start + tag, start + tag, wrap[1] if wrap else IN, article, closing))
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<(?:/?[a-zA-Z]|!|/?\Z)", rest)
        put(rest[: cut.start()] if cut else rest)
    found = set()
    _, wrap, begin = max(zip(((s and n > 0, n) for s, n in zip(seen, length)), around, begins), key=lambda x: x[0], default=(0, None, -1))
    while wrap:
        found.add(wrap[0])
        wrap = wrap[3]
    return tokens, frozenset(found), begin


def kinds(page: str | None) -> Counter:
    """(kind, inside the article) counts of a labelled page's words and tags, for kinds with and without classes; empty where
    it has no marked article. Only the place counts: a form in an article is inside it."""
    tokens = tokenize(page)
    found: Counter = Counter()
    if any(t.article for t in tokens):
        for t in tokens:
            for kind in {t.kind, t.wide}:
                found[kind, t.article] += 1 if t.tag else len(t.text.split())
    return found


#: Shares inside the article that a kind starts from, as one token's worth of evidence.
PLAIN, LINK, INLINE_TAG, ELSEWHERE = 0.75, 0.3, 0.95, 0.02


def _prior(kind: str) -> float:
    if kind.startswith(("out ", "other ")):
        return ELSEWHERE
    if kind.startswith("<"):
        return INLINE_TAG if kind[1:].partition(".")[0] in INLINE else ELSEWHERE if kind[1:] in RAW else PLAIN
    return LINK if kind.startswith("a ") else PLAIN


def _worth(kind: str, inside: float, outside: float) -> float:
    """-log of the share outside for words, log of the share inside for tags."""
    prior, n = _prior(kind), inside + outside + 1
    return math.log((inside + prior) / n) if "<" in kind else -math.log((outside + 1 - prior) / n)


@lru_cache(4096)
def _unseen(kind: str) -> float:
    return _worth(kind, 0, 0)


def weights_of(counts: Counter) -> dict[str, float]:
    """What a word or a tag of each kind is worth."""
    return {kind: _worth(kind, counts[kind, True], counts[kind, False]) for kind in {k for k, _ in counts}}


def score(token: Token, weights: dict[str, float]) -> float:
    each = weights.get(token.kind)
    if each is None:
        each = weights.get(token.wide)
        each = _unseen(token.wide) if each is None else each
    return each if token.tag else len(token.text.split()) * each


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the greatest positive sum, the first and then the longest of equal ones."""
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run < 0 or (run == 0 and best == 0):
            run, start = 0.0, i
        run += s
        if run > best or (run == best and start == lo and run > 0):
            best, lo, hi = run, start, i + 1
    return lo, hi


#: A block whose class lies inside the article less often than this is left out of the interior too.
RARELY = math.log(0.1)


def _left_out(tokens: list[Token], weights: dict[str, float]) -> list[bool]:
    """Which of a region's tokens are left out: all in elements that are no article, and of the blocks that are so by their
    name or by what labelled pages show of their class only those with other words before and after them in the region."""
    named = []
    depth, opened = 0, ""
    for t in tokens:
        rare = bool(t.tag) and t.kind != t.wide and weights.get(t.kind, 0.0) < RARELY
        if depth == 0 and rare and t.tag not in VOID:
            depth, opened = 1, t.tag
            named.append(True)
            continue
        named.append(depth > 0 or t.out == NAMED)
        if depth and t.tag == opened:
            depth += 1 if not t.closing else -1
    words = [k for k, t in enumerate(tokens) if not t.tag and t.out != OUT and not named[k] and t.text.strip()]
    first, last = (words[0], words[-1]) if words else (0, -1)
    return [t.out == OUT or (named[k] and first < k < last) for k, t in enumerate(tokens)]


def main_text(page: str | None, weights: dict[str, float]) -> str:
    tokens = tokenize(page)
    lo, hi = best_region([score(t, weights) for t in tokens])
    region = tokens[lo:hi]
    blocks, current = [], []
    for t, gone in zip(region, _left_out(region, weights)):
        if gone:
            continue
        if not t.tag:
            current.append(t.text)
        elif t.tag not in INLINE:
            blocks.append("".join(current))
            current = []
    blocks.append("".join(current))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for page in batch.column(0).to_pylist():
            total += kinds(page)
        keys = list(total)
        yield common.batch("kind string, inside boolean, n long", [k for k, _ in keys], [i for _, i in keys], [total[k] for k in keys])


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most `sample` labelled pages, the first by a hash of their id and html; of equal rows one counts. The
    hashes are chosen first, so that only the chosen pages are moved."""
    common.ship(pages.sparkSession)
    place = F.xxhash64(F.lit(3), id_col, html_col)
    marked = pages.where(F.lower(html_col).rlike(r"<(article|main)\b|role=.?main\b")).select(place.alias("h"), F.col(html_col).alias("page"))
    chosen = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(sample).collect()]  # at most `sample` longs
    if not chosen:
        return {}
    found = marked.where(F.col("h").isin(chosen)).groupBy("h").agg(F.first("page").alias("page")).select("page")
    rows = found.mapInArrow(_learn, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()  # kinds of `sample` pages
    return weights_of(Counter({(r["kind"], r["inside"]): r["n"] for r in rows}))


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                text = [main_text(x, weights) for x in part.column(2).to_pylist()]
                yield common.batch(TEXT_SCHEMA, part.column(0), part.column(1), text, [len(t) for t in text])

    return run


def extract(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars. Null and empty pages, and pages without words outside boilerplate, have
    an empty text; repeated rows stay repeated; equal regions: the first."""
    common.ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(weights), TEXT_SCHEMA)


def op2_subsequence_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
