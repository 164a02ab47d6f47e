"""HTML extraction by a maximum-scoring subsequence: words score by where they stand, mostly positive, and tags negative,
with weights from labelled pages; one linear scan finds the best contiguous region of a page, whose blocks are the text.

A word scores by its block (``>p``, ``>li a``) unless something frames it: an element like nav or footer, or a name
in the class, id or role of an element above it. Then it scores by the least weight of its frames, if that is below 0.
All these weights are learned; those of the usual frames start from a prior. What frames the article itself (a wrapper
of class ``has-sidebar``, say) frames nothing. Inside the region, only words below 0 that are framed are left out: a
comment section or an advert between two paragraphs."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import fields

#: Pages that the weights are learned from, at most about this many: those with the smallest hashes of their url.
SAMPLE_PAGES = 4_000
#: A feature that labelled pages show in fewer words or tags than this keeps its prior.
MIN_SEEN = 50
#: Weights lie between these; the priors of a usual frame, a word, a word of a heading, a word of a link in a list, a
#: block's tag, a paragraph's or heading's tag, another tag; and what a learned tag scores at most, as only words make
#: text.
LIMIT, FRAME, WORD, HEAD_WORD, LINK, TAG, TEXT_TAG, SMALL_TAG, INNER_TAG = 4.0, -5.0, 1.0, 3.0, -0.5, -3.25, -0.4, -0.5, -0.25

# Elements by their role in HTML.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template iframe object svg canvas math select textarea button title head datalist audio video".split())
FRAMES = set("nav aside footer header form menu dialog".split())
#: Name parts of class, id and role that mark what surrounds an article.
CUES = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar topbar widget".split())
#: Elements whose open end is closed by these when they begin.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
CLOSES = {name: [low for low, by in CLOSED_BY.items() if name in by] for name in set().union(*CLOSED_BY.values())}
SCOPE = set("table td th article section div body html ul ol dl aside nav form main header footer".split())

#: Name parts after which a cue says what a wrapper has, not what it is.
STATES = set("has have with without no not is show hide enable disable".split())
TEXTS = set("p h1 h2 h3 h4 h5 h6".split())
LISTS = set("li td th dd dt option".split())

_REST = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title)\b{_REST}>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z]{_REST}(?:>|\Z)|<[?!][^>]*(?:>|\Z)", re.S | re.I)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"[\s\"'/](class|id|role|hidden|aria-hidden|style)(?=[\s=/>])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


def _marked(tag: str, at: int) -> tuple[tuple[str, ...], bool]:
    """The name parts in a tag's class, id and role, and whether the element is hidden."""
    parts, hidden = [], False
    for m in ATTRIBUTE.finditer(tag, at):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
        elif name in ("class", "id", "role"):
            for word in value.split():
                own = [p.lower() for p in PART.findall(word)]
                parts += [p for k, p in enumerate(own) if not (k and own[k - 1] in STATES)]
    return tuple(dict.fromkeys(parts)), hidden


class Page:
    """The elements of a page and its tokens, in order. Each step takes time in proportion to the page, however deep
    its elements lie in each other."""

    def __init__(self, page: str) -> None:
        self.parent, self.name, self.parts, self.hidden = [-1], ["body"], [()], [False]
        #: (element, text, words) of text; (element, None, 1 where a block begins or ends) of tags
        self.tokens: list[tuple[int, str | None, int]] = []
        self.tags: list[str] = []  # names of the tags among the tokens
        self._read(page)

    def _read(self, page: str) -> None:
        stack, scope = [0], [0]  # open elements, and the depth of the innermost scope up to each of them
        open_at: dict[str, list[int]] = {}  # depths of the open elements of a name
        at, n = 0, len(page)

        def close(depth: int) -> None:
            while len(stack) > depth:
                open_at[self.name[stack.pop()]].pop()
                scope.pop()

        while at <= n:
            m = TOKEN.search(page, at)
            text = page[at : m.start()] if m else page[at:]
            if text:
                said = entities.unescape(text)
                self.tokens.append((stack[-1], said, len(said.split())))
            if not m:
                return
            at, tag = m.end(), m[0]
            name = NAME.match(tag)
            if m[1] or tag.startswith(("<!", "<?")) or not name:
                continue
            if not tag.endswith(">"):
                return  # the page ends inside a tag
            low = name[1].lower()
            if tag[1] == "/":
                self.tokens.append((stack[-1], None, int(low in BLOCKS)))
                self.tags.append(low)
                if open_at.get(low):
                    close(open_at[low][-1])
                continue
            for other in CLOSES.get(low, ()):
                if open_at.get(other) and open_at[other][-1] >= scope[-1]:
                    close(open_at[other][-1])
            parts, hidden = _marked(tag, name.end())
            own = len(self.parent)
            self.parent.append(stack[-1])
            self.name.append(low)
            self.parts.append(parts)
            self.hidden.append(hidden or low in HIDDEN)
            self.tokens.append((own, None, int(low in BLOCKS)))
            self.tags.append(low)
            if low not in VOID and not tag.endswith("/>"):
                depth = len(stack)
                open_at.setdefault(low, []).append(depth)
                stack.append(own)
                scope.append(depth if low in SCOPE else scope[-1])

    def anchor(self) -> tuple[int, set[int]]:
        """The article or main element with the most words (0: none), and the elements that frame nothing: those
        above it, and those above its first h1. Without such an element: those above the page's first h1, and those
        that hold more than four fifths of the words."""
        words = [0] * len(self.parent)
        for e, said, n in self.tokens:
            if said is not None:
                words[e] += n
        hidden = self.hidden[:]
        for e in range(1, len(hidden)):
            hidden[e] = hidden[e] or hidden[self.parent[e]]
        for e in range(len(words) - 1, 0, -1):
            words[self.parent[e]] += 0 if hidden[e] else words[e]
        held = [e for e, n in enumerate(self.name) if n in ("article", "main") and not hidden[e]]
        best = max(held, key=lambda e: (words[e], -e), default=0)
        inside = [False] * len(words)
        inside[best] = True
        for e in range(best + 1, len(words)):
            inside[e] = inside[self.parent[e]]
        head = next((e for e, n in enumerate(self.name) if n == "h1" and inside[e] and not hidden[e]), 0)
        free = set() if best else {e for e in range(len(words)) if words[e] * 5 > words[0] * 4}
        for e in (best, head):
            while e > 0:
                free.add(e)
                e = self.parent[e]
        self.hidden, self.inside = hidden, inside
        return best, free

    def contexts(self) -> list[tuple[str, tuple[str, ...]]]:
        """For each element: the place of its words (block, and whether in a link), and what may frame them."""
        _, free = self.anchor()
        out: list[tuple[str, tuple[str, ...]]] = [(">body", ())]
        for e in range(1, len(self.parent)):
            place, frames = out[self.parent[e]]
            name = self.name[e]
            if name in BLOCKS:
                place = f">{name}"
            elif name == "a" and not place.endswith(" a"):
                place += " a"
            if e not in free:
                own = (*((f"in:{name}",) if name in FRAMES else ()), *(f".{p}" for p in self.parts[e]))
                if own and not set(own) <= set(frames):
                    frames = tuple(dict.fromkeys((*frames, *own)))[:MOST_FRAMES]
            out.append((place, frames))
        return out


#: Names that a word's frames are taken from, at most: the outermost ones first.
MOST_FRAMES = 32


def prior(feature: str) -> float:
    """The weight of a feature that labelled pages say nothing of."""
    if feature.startswith("in:") or feature[0] == "." and feature[1:] in CUES:
        return FRAME
    if feature[0] == ".":
        return 0.0
    if feature[0] == "<":
        return TEXT_TAG if feature[1:] in TEXTS else TAG if feature[1:] in BLOCKS else SMALL_TAG
    if feature.endswith(" a") and feature[1:-2] in LISTS:
        return LINK
    return HEAD_WORD if feature[1:] in TEXTS - {"p"} else WORD


def scored(page: Page, weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """The score of each token, and for each whether it is framed by something of a weight below 0."""
    value = lambda f: weights.get(f, prior(f))
    known: dict[tuple, tuple[float, bool]] = {}
    contexts, scores, framed, tag = page.contexts(), [], [], iter(page.tags)
    for e, said, n in page.tokens:
        context = contexts[e]
        if (got := known.get(context)) is None:
            least = min(map(value, context[1]), default=0.0)
            got = known[context] = (max(least, -LIMIT), True) if least < 0 else (value(context[0]), False)
        hidden = page.hidden[e]
        framed.append(got[1] or hidden)
        if said is None:
            scores.append(value(f"<{next(tag)}"))
        else:
            scores.append(0.0 if hidden else got[0] * n)
    return scores, framed


def region(scores: list[float]) -> tuple[int, int]:
    """The half-open range of the largest sum; the first and shortest of equal ones, (0, 0) if none is positive."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, lo, hi = total, start, k + 1
    return lo, hi


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, without framed words. White space inside a block becomes one space; blocks are
    joined by two line ends."""
    if not page:
        return ""
    parsed = Page(page)
    scores, framed = scored(parsed, weights)
    lo, hi = region(scores)
    blocks, own, tag = [], [], iter(parsed.tags)
    for k, (_, said, new) in enumerate(parsed.tokens[:hi]):
        if said is None:
            name = next(tag)
            if new:
                blocks.append("".join(own))
                own = []
            elif name == "br":
                own.append("\n")
        elif k >= lo and not framed[k]:
            own.append(said)
    blocks.append("".join(own))
    return "\n\n".join(t for t in (SPACE.sub(" ", b).strip() for b in blocks) if t)


def _labelled(html: str | None) -> Iterator[tuple[str, int, int]]:
    """(feature, words inside, words outside the article) of a page whose markup says where the article is; else
    nothing. Places and tags count where nothing frames them, so that a menu's list says nothing of all lists."""
    if not html or not re.search(r"<(article|main)\b", html, re.I):
        return
    page = Page(html)
    contexts, tag = page.contexts(), iter(page.tags)
    for e, said, n in page.tokens:
        place, frames = contexts[e]
        inside = page.inside[e]
        if said is None:
            name = next(tag)
            if not frames and name not in ("article", "main", "html", "body", "head") and not page.hidden[e]:
                yield f"<{name}", int(inside), int(not inside)
        elif n and not page.hidden[e]:
            for feature in frames or (place,):
                yield feature, n * inside, n * (not inside)


def learn(pages: DataFrame, *, html: str = "html", url: str = "url", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """The weight of each place: the smoothed log-odds of its tokens to stand in the article of labelled pages,
    cut to [-4, 4]; tags score below 0. A usual frame adds them to its prior, as what stands inside an article's
    element isn't always article. Of a bounded sample: the pages whose url's hash is in the smallest share that
    holds about ``sample`` pages; their words bound the number of features."""
    total = pages.count()
    share = min(1.0, sample / max(1, total))
    rows = pages.where(F.pmod(F.xxhash64(url), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col(html).alias("page"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("page"):
                for place, a, b in _labelled(page.as_py()):
                    inside[place] += a
                    outside[place] += b
        names = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_pydict({"place": pa.array(names, pa.string()), "a": pa.array([inside[p] for p in names], pa.int64()), "b": pa.array([outside[p] for p in names], pa.int64())})

    seen = rows.mapInArrow(count, "place string, a bigint, b bigint").groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= MIN_SEEN)
    return {r.place: weight(r.place, r.a, r.b) for r in seen.toLocalIterator()}


def weight(feature: str, inside: int, outside: int) -> float:
    """The learned weight of a feature seen in so many words inside and outside of articles."""
    odds = max(-LIMIT, min(LIMIT, math.log((inside + 0.5) / (outside + 0.5))))
    if feature[0] == "<":
        return min(odds, INNER_TAG)
    return odds + FRAME if prior(feature) == FRAME else odds


def main_text(pages: DataFrame, *, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"), weights: dict[str, float] | None = None) -> DataFrame:
    """``keep``, text and n_chars (code points) of every row, from the whole html. Null and empty pages, and
    pages without a region, have the empty text. Character references are decoded; an unclosed comment, script
    or tag ends the page, as in a page that was cut off."""
    weights = learn(pages, html=html, url=url) if weights is None else weights
    names = list(keep)
    schema = T.StructType([*(pages.schema[c] for c in names), *fields("text string, n_chars bigint")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), weights) for p in batch.column(html)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(*dict.fromkeys([*names, html])).mapInArrow(scan, schema)
