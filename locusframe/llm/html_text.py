"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of tags and of words in blocks. A word scores the log odds of being main text
where it stands, mostly above zero; a tag scores below zero, by its name. A linear scan finds the
contiguous run with the largest sum, and blocks inside it whose words score negative (an advert
within the article) are left out.

Weights come from labelled pages: those that mark their main region themselves with <article> or
<main>, at most SAMPLE of them, the ones with the smallest hash of their html. The marks are labels:
they are taken out of what is learned, so that pages without them profit. The odds of a word are a
logistic regression on the elements around it and their classes, ids and roles; those that are named
like menus, notices, adverts and so on begin at a prior below zero, boxes that hold anything stay
close to nought. A tag's score is the log ratio of its frequency inside and outside.

Cases: null and empty html, and pages without a scoring word, have empty text; broken markup is read
as far as it goes: an unclosed element ends with its parent, an unclosed comment or script reaches
the end of the page, a tag without an end too; pages of any length and depth are read whole, in time
linear in their length (deeper than DEEP elements nothing is learned); repeated rows each get a row;
an empty table gives no rows; without labelled pages the priors decide; other columns may have any
names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import annotate, logistic, table, texts

#: Labelled pages to learn from, at most, and the depth of elements to which is learned.
SAMPLE, DEEP = 2_000, 200
#: Bounds of a word's and a tag's score, and a tag's where nothing is known of it.
WORD, TAG, TAG_UNKNOWN = (-0.5, 3.0), (-2.0, -0.05), -0.3
#: Log odds of a word of which nothing is known, of one named like what is no article, and of one in a marked region.
PLAIN, APART_ODDS, MAIN_ODDS = 0.25, -4.0, 2.0
#: Weight of all labelled words together against the priors, which count as one observation; those of boxes and of no element at all as many.
LABELLED, BOX_PRIOR = 2_000.0, 500.0

MAIN = frozenset(("article", "main"))
#: Names on these say nothing of their text.
ROOTS = MAIN | {"html", "body"}
#: Elements that hold anything.
BOXES = frozenset(("html", "body", "div", "section", "span", "center", "font", "table", "tbody", "tr", "td", "figure", "label", "fieldset"))
#: Elements whose content is no text.
SILENT = frozenset(("script", "style", "noscript", "template", "svg", "math", "head", "title", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "datalist"))
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
#: An opening tag of the first closes an open element of the second, unless a list or table begins in between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = ("ul", "ol", "dl", "table")
ENDS_P = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
#: Elements, and words of class and id, that hold no article text.
APART = frozenset(("nav", "aside", "footer", "form", "menu", "dialog", "header"))
APART_NAMES = re.compile(r"\A(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|related|recommend\w*|share|sharing|social|comments?|commentlist|replies|respond|disqus|widget|pager|pagination|toolbar|copyright|skip|search)(?![a-z])")
#: Names that count on an article too: comments of readers are often marked as articles.
COMMENT = re.compile(r"\A(?:comments?|reply|replies)(?![a-z])")

NAME = re.compile(r"/?([a-zA-Z][^\s/><]*+)")
#: What follows a tag's name, up to its end: no tag begins in it, so that reading on never reads anything twice.
REST = re.compile(r"(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>")
NAMES = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def prior(feature: str) -> float:
    return APART_ODDS if feature in APART or feature[0] == "." and APART_NAMES.search(feature[1:].replace("_", "-")) else 0.0


def element(name: str, attributes: str) -> tuple[frozenset[str], bool]:
    """Features of an element and whether nothing in it shows."""
    own, hidden = set() if name in ROOTS else {name}, name in SILENT
    if attributes:
        for key, *value in NAMES.findall(attributes):
            key, value = key.lower(), "".join(value).lower()
            if key in ("class", "id", "role"):
                own.update(f".{w}" for w in value.split() if name not in ROOTS or name == "article" and COMMENT.search(w))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return frozenset(own), hidden


class Path:
    """The open elements at a place of a page. What holds there is kept up to date by each, so that depth costs nothing."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.stack: list[tuple] = []  # name, features that begin here, hidden, inside main, what to go back to
        self.at: dict[str, list[int]] = {}  # places of open elements by name
        self.boxes: list[int] = []  # places of those that aren't inline
        self.active: Counter = Counter()
        self.plus = self.minus = 0.0  # weights above and below zero
        self.hidden = self.main = False
        self.cuts = 0  # open inline elements whose text stands apart from what is around them

    def last(self, name: str) -> int:
        return self.at[name][-1] if self.at.get(name) else -1

    @property
    def odds(self) -> float:
        """What speaks for a text counts up to a bound, so that no number of plain elements outweighs a name that speaks against it."""
        return min(self.plus, WORD[1]) + self.minus

    def weight(self, own: frozenset[str]) -> float:
        return sum(self.weights[f] if f in self.weights else prior(f) for f in own)

    def cut(self, name: str, attributes: str) -> bool:
        """Whether a tag begins or ends an inline element that is named like an advert: its text is a block of its own."""
        return name in INLINE and (self.cuts > 0 or bool(attributes) and self.weight(element(name, attributes)[0]) < -1)

    def push(self, name: str, attributes: str) -> None:
        own, hidden = element(name, attributes)
        if name == "header" and self.main:  # an article's own heading
            own -= {name}
        back = (self.plus, self.minus, self.hidden, self.main, self.active, self.cuts)
        self.cuts += self.cut(name, attributes)
        if name == "main":  # what holds the main region says nothing of it
            self.plus, self.minus, self.active = 0.0, 0.0, Counter()
        own = frozenset(f for f in own if not self.active[f])
        self.active.update(own)
        for f in own:
            w = self.weights[f] if f in self.weights else prior(f)
            self.plus, self.minus = self.plus + max(w, 0.0), self.minus + min(w, 0.0)
        if name in MAIN and not self.main:
            self.plus += MAIN_ODDS
        self.hidden, self.main = self.hidden or hidden, self.main or name in MAIN
        self.at.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.boxes.append(len(self.stack))
        self.stack.append((name, own, back))

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, own, back = self.stack.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.boxes.pop()
            for f in own:
                self.active[f] -= 1
            self.plus, self.minus, self.hidden, self.main, self.active, self.cuts = back

    def before(self, name: str) -> None:
        """Closes what an opening tag of the name ends."""
        if name in ENDS_P:
            k = self.last("p")
            if k >= 0 and (not self.boxes or self.boxes[-1] <= k):  # only inline elements since
                self.pop(k)
        for other in CLOSES.get(name, ()):
            k = self.last(other)
            if k >= 0 and all(self.last(x) < k for x in LISTS):
                self.pop(k)

    def end(self, name: str) -> None:
        k = self.last(name)
        if k >= 0 and (name not in INLINE or not self.boxes or self.boxes[-1] < k):  # an inline end tag doesn't close blocks
            self.pop(k)


def blocks(page: str, weights: dict[str, float]) -> Iterator[tuple[str, Path, list[tuple[str, bool]]]]:
    """(text, path, tags before it by name and whether they stand in the main region) for each block of text. The path is only right until the next block."""
    path = Path(weights)
    piece: list[str] = []
    tags: list[tuple[str, bool]] = []
    at, size = 0, len(page)

    def text() -> str:
        found = " ".join("".join(piece).split())
        piece.clear()
        return found

    while at < size:
        k = page.find("<", at)
        if k < 0:
            k = size
        if k > at and not path.hidden:
            piece.append(html.unescape(page[at:k]))
        if k == size:
            break
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = NAME.match(page, k + 1)
        if not m:
            if page[k + 1 : k + 2] in ("!", "?", "/"):
                end = page.find(">", k)
                at = end + 1 if end >= 0 else size
            else:  # no tag
                if not path.hidden:
                    piece.append("<")
                at = k + 1
            continue
        rest = REST.match(page, m.end())
        at = rest.end() if rest else page.find(">", k) + 1 or size
        name, attributes = m[1].lower(), page[m.end() : at - 1]
        # a block ends where it begins: before the path changes
        if name not in INLINE or path.cut(name, attributes):
            if found := text():
                yield found, path, tags
                tags = []
        tags.append((name, path.main))
        if page[k + 1] == "/":
            path.end(name)
            continue
        path.before(name)
        if name in RAW:  # up to its end tag
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif name not in VOID and not attributes.endswith("/"):
            path.push(name, attributes)
    if found := text():
        yield found, path, tags


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, (0, 0) if none is positive; the first of equal ones."""
    best, at, low, low_at, total = 0.0, (0, 0), 0.0, 0, 0.0
    for k, s in enumerate(scores):
        total += s
        if total - low > best:
            best, at = total - low, (low_at, k + 1)
        if total < low:
            low, low_at = total, k + 1
    return at


def clip(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


def main_text(page: str, model: dict) -> str:
    """model: what learn() gives; of an empty one the priors are left."""
    bias, tag = model.get("bias", PLAIN), model.get("tags", {})
    found: list[str] = []
    scores: list[float] = []  # of the tags before each block and of its words, in turn
    for text, path, tags in blocks(page, model.get("weights", {})):
        found.append(text)
        scores += (sum(tag.get(t, TAG_UNKNOWN) for t, _ in tags), clip(bias + path.odds, WORD) * (1 + text.count(" ")))
    a, b = best_run(scores)
    return " ".join(text for k, text in enumerate(found) if a <= 2 * k + 1 < b and scores[2 * k + 1] > 0)


def regression(patterns: list[tuple[frozenset[str], float, float]]) -> tuple[float, dict[str, float]]:
    """Bias and weights of features, from patterns of features with how much of the text under them is inside and outside."""
    names = sorted({f for own, _, _ in patterns for f in own})
    total = sum(i + o for _, i, o in patterns)
    if not total:
        return PLAIN, {}
    index = {f: k for k, f in enumerate(names)}
    mean = np.array([prior(f) for f in names] + [PLAIN])
    precision = np.array([BOX_PRIOR if f in BOXES else 1.0 for f in names] + [BOX_PRIOR])
    row = np.concatenate([np.full(len(own) + 1, k) for k, (own, _, _) in enumerate(patterns)])
    column = np.concatenate([[*(index[f] for f in sorted(own)), len(names)] for own, _, _ in patterns]).astype(np.int64)
    inside, outside = (np.array([p[k] for p in patterns]) * (LABELLED / total) for k in (1, 2))
    w = logistic(row, column, inside, outside, mean, precision)
    return float(w[-1]), dict(zip(names, w[:-1].tolist()))


def counted(page: str, found: dict[tuple[str, str], list[int]]) -> None:
    """Adds what a labelled page says: words by the pattern of features around them, and tags by name, inside and outside."""
    for text, path, tags in blocks(page, {}):
        side = 0 if path.main else 1
        for t, main in tags:
            found.setdefault(("tag", t), [0, 0])[0 if main else 1] += 1
        n = 1 + text.count(" ")
        found.setdefault(("word", ""), [0, 0])[side] += n
        if len(path.stack) > DEEP:
            continue
        own = sorted(f for f, k in path.active.items() if k > 0)
        if path.main and any(prior(f) for f in own):  # an advert in the article is no article
            continue
        found.setdefault(("around", "\n".join(own)), [0, 0])[side] += n


def model_of(counts: list[tuple[str, str, int, int]]) -> dict:
    """bias, weights and tags from counts (kind, key, inside, outside)."""
    bias, weights = regression([(frozenset(key.split("\n")) - {""}, i, o) for kind, key, i, o in counts if kind == "around"])
    # a tag is one of all tags and words of its side
    size = [1 + sum(c[2 + side] for c in counts if c[0] != "around") for side in (0, 1)]
    tags = {key: clip(math.log((i + 0.5) / size[0]) - math.log((o + 0.5) / size[1]), TAG) for kind, key, i, o in counts if kind == "tag" and key not in MAIN}
    return {"bias": clip(bias, (0.0, 3.0)), "weights": weights, "tags": tags}


def learn(pages: DataFrame, html_col: str = "html", size: int = SAMPLE) -> dict:
    """What main_text() needs, from pages that mark their main region; of the size of the sample at most."""
    col = F.col(f"`{html_col}`")
    chosen = pages.select(col.alias("html")).filter(F.lower(col).rlike("<(article|main)[\\s>]")).select("html", F.xxhash64("html").alias("h"))
    # the size-th smallest hash by a sort of hashes alone; equal pages count once
    last = chosen.select("h").distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if last is None:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], list[int]] = {}
        seen: set[int] = set()
        for batch in batches:
            for page, h in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    counted(page, found)
        rows = [(*key, *n) for key, n in sorted(found.items())]
        columns = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "key", "inside", "outside"])

    rows = chosen.filter(F.col("h") <= last).mapInArrow(count, "kind string, key string, inside long, outside long")
    sums = rows.groupBy("kind", "key").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).orderBy("kind", "key").collect()
    return model_of([tuple(r) for r in sums])


def extract_main_text(pages: DataFrame, model: dict, html_col: str = "html") -> DataFrame:
    """Rows (row, out): out.text."""
    given = pages.sparkSession.sparkContext.broadcast(model)
    return annotate(pages, [html_col], lambda: lambda column: ([main_text(x, given.value) for x in texts(column)],), T.StructType([T.StructField("text", T.StringType(), False)]))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, with what their own marks teach. Every row has a row; see the module for odd pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_main_text(pages, learn(pages))
    return found.select("row.page_id", "row.url", F.col("out.text").alias("text"), F.char_length("out.text").cast("long").alias("n_chars"))
