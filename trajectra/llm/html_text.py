"""HTML extraction by a maximum-scoring subsequence.

A page is read as a run of tags and texts. Each word scores by the elements around it, positive
where they are those of articles, and each tag scores negative; a linear scan finds the contiguous
run of the highest sum, the content region. Its blocks are given as text, without the elements in
it whose own weight is that of boilerplate.

The weights are a logistic regression on the names around a text: element names and the words of
class, id and role. It is learned from labelled pages, those that mark their article themselves by
one article or main element; the marks are no features, so pages without them are read the same
way. A bounded sample of labelled pages is counted, on the executors, and the driver gets a row
for each different set of names. The regression starts from weak priors for HTML's own element
names and common class names, and is drawn to them, so names that no labelled page has still have
a weight, and a name is moved only by what the names around it don't explain.

Cases: a null or empty page gives an empty text; unclosed and stray tags are closed where HTML
closes them, or passed over; pages of any length are read whole; repeated rows give a row each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages counted for the weights, at most.
MAX_LABELLED = 2_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[A-Za-z]+")

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes open elements of the value.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER_TEXT = frozenset("head script style noscript template textarea title iframe svg math object select".split())
MARKS = frozenset("article main".split())
NEUTRAL = frozenset("html div section span".split())
# Prior weights of element names, and of words of class, id and role names.
TAG_PRIORS = {-3.0: "nav header footer aside form button menu dialog search label fieldset input", 1.0: "p h1 h2 h3 h4 h5 h6 blockquote pre article main figcaption", 0.5: "em strong b i code td dd dt li #page body", -0.25: "a"}
NAME_PRIORS = {
    -2.5: "ad ads advert advertisement advertising adverts adbox banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus "
    "footer form gdpr header login masthead menu menus modal nav navbar navigation navi newsletter notice notices pager pagination popup promo promotion promoted recommended "
    "related reply replies respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets",
    1.5: "article body content entry main post story text",
}
#: An element of this weight or less isn't article text, nor is what it holds.
OUT = -1.5
#: The cost of an excluded element, the least and the greatest of another tag.
TOLL, LEAST_COST, MOST_COST = -0.1, 0.01, 1.0
#: Pull to the priors, and steps of the regression.
PULL, STEPS = 0.01, 300


@dataclass
class Node:
    tag: str
    names: tuple[str, ...]
    parent: int


def names_of(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role, lower-cased and split at case changes and hyphens."""
    found: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            for word in value.strip("\"'").split():
                parts = NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", word))
                found += [p.lower() for p in parts]
        elif name in ("hidden", "aria-hidden") and value.strip("\"'").lower() in ("", "true", "hidden"):
            found.append("#hidden")
    return tuple(found)


def parse(page: str) -> tuple[list[Node], list[tuple]]:
    """The elements, and in page order ("tag", element, opens), ("text", element, text) and ("break", element)."""
    nodes = [Node("#page", (), -1)]
    stack = [0]
    items: list[tuple] = []
    at = 0

    def close(tag: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if nodes[stack[depth]].tag == tag:
                for element in reversed(stack[depth:]):
                    items.append(("tag", element, False))
                del stack[depth:]
                return
            if nodes[stack[depth]].tag in ("table", *MARKS) and tag not in BLOCK:
                return

    while True:
        token = TOKEN.search(page, at)
        text = page[at : token.start() if token else len(page)]
        if text:
            items.append(("text", stack[-1], text))
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if tag == "p" and not any(nodes[e].tag == "p" for e in stack):
                continue
            close(tag)
            continue
        if tag in BLOCK and tag != "p" and any(nodes[e].tag == "p" for e in stack) and tag not in ("body", "html", "head"):
            close("p")
        if tag == "p" and any(nodes[e].tag == "p" for e in stack):
            close("p")
        for depth in range(len(stack) - 1, 0, -1):
            inner = nodes[stack[depth]].tag
            if inner in CLOSES.get(tag, ()):
                close(inner)
                break
            if inner in ("ul", "ol", "dl", "table", "div", "article", "section", "body"):
                break
        if tag == "body":
            close("head")
        names = names_of(token[3] or "")
        nodes.append(Node(tag, names, stack[-1]))
        element = len(nodes) - 1
        items.append(("tag", element, True))
        if tag in VOID or token[3].rstrip().endswith("/"):
            if tag in ("br", "hr"):
                items.append(("break", stack[-1]))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s>/])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            items.append(("tag", element, False))
            continue
        stack.append(element)
    return nodes, items


def features_of(node: Node) -> list[str]:
    """An element's own name, unless it is a mark or says nothing, and its class words with a dot before them."""
    return [*([] if node.tag in MARKS or node.tag in NEUTRAL else [node.tag]), *("." + n for n in node.names)]


def prior(feature: str) -> float:
    return _PRIORS.get(feature, 0.0)


_PRIORS = {name: weight for weight, names in TAG_PRIORS.items() for name in names.split()} | {"." + name: weight for weight, names in NAME_PRIORS.items() for name in names.split()}


class Weights:
    """Log-odds of article text by the features around it; the priors where nothing was learned."""

    def __init__(self, learned: dict[str, float] | None = None):
        self.learned = learned or {}

    def of(self, feature: str) -> float:
        found = self.learned.get(feature)
        return _PRIORS.get(feature, 0.0) if found is None else found

    def own(self, node: Node) -> float:
        """An element's own weight: where it has names of both kinds, those against count in full and those for by half."""
        found = [self.of(f) for f in features_of(node)]
        against = sum(w for w in found if w < 0)
        return against + sum(w for w in found if w > 0) * (0.5 if against <= OUT else 1.0)

    def marked_out(self, nodes: list[Node]) -> list[bool]:
        """Whether each element, or one around it, isn't article text."""
        out = []
        for node in nodes:
            hidden = node.tag in NEVER_TEXT or "#hidden" in node.names
            out.append((node.parent >= 0 and out[node.parent]) or hidden or (node.tag not in ("html", "body", *MARKS) and self.own(node) <= OUT))
        return out

    def words(self, nodes: list[Node]) -> list[float]:
        """The score of a word in each element: of the different features around it."""
        totals: list[tuple[float, frozenset]] = []
        for node in nodes:
            total, seen = totals[node.parent] if node.parent >= 0 else (0.0, frozenset())
            if fresh := {*features_of(node)} - seen:
                total, seen = total + sum(map(self.of, fresh)), seen | fresh
            totals.append((total, seen))
        return [max(-1.0, min(1.0, total / 2)) for total, _ in totals]

    def tag(self, node: Node) -> float:
        """The cost of a tag: little where article text stands in it."""
        return -max(LEAST_COST, min(MOST_COST, (0.5 - self.of(node.tag)) / 10))


def count_labelled(page: str) -> Counter | None:
    """Words by the set of features around them and whether they are in the article; None where the page doesn't mark one."""
    nodes, items = parse(page)
    out = Weights().marked_out(nodes)
    marked = [i for i, n in enumerate(nodes) if n.tag in MARKS and not out[i]]
    if len(marked) != 1:
        return None
    within, around = [], []
    for i, node in enumerate(nodes):
        within.append(i == marked[0] or (node.parent >= 0 and within[node.parent]))
        around.append((around[node.parent] if node.parent >= 0 else frozenset()) | {*features_of(node)})
    counts: Counter = Counter()
    for kind, element, *rest in items:
        if kind == "text" and (n := len(rest[0].split())):
            counts[" ".join(sorted(around[element])), within[element] and not out[element]] += n
    return counts


def regress(counts: dict[tuple[str, bool], int]) -> Weights:
    """Weights from words by (features, whether in the article): a logistic regression drawn to the priors."""
    rows = sorted(counts)
    if not rows:
        return Weights()
    names = sorted({f for features, _ in rows for f in features.split()})
    place = {f: i for i, f in enumerate(names)}
    start = np.array([prior(f) for f in names])
    y = np.array([inside for _, inside in rows], float)
    # Each kind counts for half, so that long articles don't outweigh what is around them.
    share = np.array([counts[r] for r in rows], float)
    share /= 2 * np.maximum(1.0, np.where(y == 1, share[y == 1].sum(), share[y == 0].sum()))
    row = np.concatenate([np.full(len(features.split()), i) for i, (features, _) in enumerate(rows)])
    column = np.array([place[f] for features, _ in rows for f in features.split()], np.int64)
    weight = start.copy()
    for _ in range(STEPS):
        odds = np.bincount(row, weights=weight[column], minlength=len(rows))
        wrong = share * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y)
        weight -= np.bincount(column, weights=wrong[row], minlength=len(names)) + PULL * (weight - start)
    return Weights(dict(zip(names, weight.tolist(), strict=True)))


def learn(pages: list[str]) -> Weights:
    total: Counter = Counter()
    for page in pages:
        total.update(count_labelled(page) or {})
    return regress(total)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place (exclusive) of the contiguous run of the highest sum; the longest of equal ones."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best and total > 0 and i + 1 - start > at[1] - at[0]):
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: Weights) -> str:
    """The main text, its blocks joined by an empty line."""
    if not page:
        return ""
    nodes, items = parse(page)
    out, words = weights.marked_out(nodes), weights.words(nodes)
    costs: dict[str, float] = {}
    scores = []
    for kind, element, *rest in items:
        node = nodes[element]
        if out[element]:  # what an excluded element holds costs one tag in all, so that it doesn't cut an article in two
            scores.append(TOLL if kind == "tag" and rest[0] and not (node.parent >= 0 and out[node.parent]) else 0.0)
        elif kind == "text":
            scores.append(words[element] * len(rest[0].split()))
        elif kind == "tag":
            if node.tag not in costs:
                costs[node.tag] = weights.tag(node)
            scores.append(costs[node.tag])
        else:
            scores.append(0.0)
    first, last = best_region(scores)
    # Whole blocks at the ends: inline elements don't cut a paragraph.
    within = lambda i: items[i][0] != "tag" or nodes[items[i][1]].tag not in BLOCK
    while 0 < first < last and within(first) and within(first - 1):
        first -= 1
    while first < last < len(items) and within(last - 1) and within(last):
        last += 1
    blocks: list[str] = []
    open_: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(open_)).split())
        if text:
            blocks.append(text)
        open_.clear()

    for i in range(first, last):
        kind, element, *rest = items[i]
        if kind == "tag" and nodes[element].tag in BLOCK:
            flush()
        elif out[element]:
            continue
        elif kind == "text":
            open_.append(rest[0])
        elif kind == "break":
            open_.append("\n")
    flush()
    return "\n\n".join(blocks)


def sample_counts(rows: DataFrame, max_labelled: int) -> dict[tuple[str, bool], int]:
    """Words by features of the sampled labelled pages among ``rows`` (k, h): those of the ids with the least hashes."""
    labelled = rows.where(F.lower("h").rlike("<(article|main)[\\s>]"))
    chosen = labelled.select("k", F.xxhash64("k").alias("o")).distinct().orderBy("o", "k").limit(max_labelled).select("k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column("h").to_pylist():
                total.update(count_labelled(page) or {})
            names, inside = zip(*total, strict=True) if total else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(inside, pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["names", "inside", "n"])

    counted = labelled.join(F.broadcast(chosen), "k", "left_semi").select("h").mapInArrow(count, "names string, inside boolean, n long")
    return {(r.names, r.inside): r.n for r in counted.groupBy("names", "inside").agg(F.sum("n").alias("n")).collect()}


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(key, url, text, n_chars) for each row."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).cast("string").alias("h"))
    weights = regress(sample_counts(rows.select("k", "h"), max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, weights) for h in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    schema = f"k {pages.schema[key].dataType.simpleString()}, u {pages.schema[url].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"k": key, "u": url})
