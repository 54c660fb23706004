"""Main text of HTML pages as the maximum-scoring run of tokens.

A page is a sequence of words and tags. A word scores positive, a tag negative by the
weight of its kind, and what stands inside page furniture (menus, headers, footers, side
bars, notices, adverts, forms, comments of readers) scores a little below zero, its tags
nothing; scripts, styles, templates, markup comments and elements that are not shown (hidden,
display:none) are no tokens. One linear scan finds the best contiguous run; furniture inside
the run is left out.

Weights come from labelled pages: pages that mark their content themselves (an article or
main element, role main, or itemprop articleBody). Over at most `max_pages` of them (those
with the smallest hash of url, a documented bound) each tag kind, and each name in class, id
and role, is counted inside and outside the marked part. A tag's weight is the log of the two
rates, between -2 and -0.01. A name whose words stand outside on LEAST_PAGES pages or more,
and inside at less than a twentieth of the rate, is furniture, whatever it is called. What the
labels don't reach is decided by meaning: a name made only of furniture words and neutral
words, one furniture word at least ("article-comments", "cookie-notice", but not
"social-science"), and elements such as nav and footer. An element whose name is furniture, or
a form, that holds the page's marked main part is none, nor is a form or cover that
holds most of the page's words. A page without marks is scored by the same weights. Pages are
read where they lie.

Cases: a null or empty html and a page without words give an empty text; broken markup
(unclosed or stray tags, unclosed quotes) is read as far as it goes; repeated rows are
read each; equal scores go to the earlier and longer run; no rows give no rows; columns
other than the three named are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by what HTML makes of them.
RAW = "script style noscript template svg math iframe object canvas select textarea title head button datalist audio video map"
FURNITURE = "nav header footer aside menu dialog"
FORMS = "form fieldset"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Words of class, id and role names that mean furniture, those that mean a cover or form around anything, and those that mean nothing by themselves.
HINTS = (
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner comment comments commentlist disqus respond reply replies discussion "
    "side sidebar rail widget widgets related recommended recommendations share sharing social newsletter subscribe signup cookie cookies consent gdpr notice notices alert "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar complementary contentinfo toc"
)
COVERS = "hidden popup modal overlay login search skip print form"
NEUTRAL = (
    "article page site post entry main left right top bottom inner outer box bar container wrapper wrap area section block list item items unit slot panel row col column "
    "body content text link links button buttons icon icons title heading header head info message msg group primary secondary first last small large fixed sticky js no has is the new"
)
_raw, _furniture, _forms, _inline, _void, _hints, _covers, _neutral = (frozenset(x.split()) for x in (RAW, FURNITURE, FORMS, INLINE, VOID, HINTS, COVERS, NEUTRAL))
#: Elements that end where their parent ends or the next of their kind begins.
_open_ended = frozenset("p li dt dd tr td th option".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*["']?until-found)|\bstyle\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)|\baria-hidden\s*=\s*["']?true""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_PART = re.compile(r"[a-z]+")
#: A page's own name for its content.
_MAIN_ROLES = {"main", "articlebody"}
WORD, FURNITURE_WORD = 1.0, -0.1
LOWEST, HIGHEST = -2.0, -0.01
DEFAULT = -0.3  # of a tag kind that no labelled page has
LEAST_PAGES, RATE = 5, 20
#: What an element is: content, furniture, or furniture unless it holds most of the page.
CONTENT, COVER, BAD = 0, 1, 2


@dataclass
class Element:
    name: str
    kind: int
    main: bool  # marks the content
    surely: bool  # by a main element or role, not by article alone
    names: tuple[str, ...]
    start: int
    end: int = -1


def _meaning(name: str) -> int:
    parts = set(_PART.findall(name))
    if parts - _hints - _covers - _neutral:
        return CONTENT
    return BAD if parts & _hints else COVER if parts & _covers else CONTENT


def _element(name: str, attrs: str, inside_main: bool, learned: frozenset[str], at: int) -> Element:
    names, marks = [], name in ("article", "main")
    surely = name == "main"
    for m in _NAMED.finditer(attrs):
        value, key = (m[2] or m[3] or m[4] or "").lower(), m[1].lower()
        if key in ("role", "itemprop") and value in _MAIN_ROLES:
            marks = surely = True
        elif key != "itemprop":
            names += value.split()
    kind = CONTENT
    if name in _furniture:
        kind = CONTENT if name == "header" and inside_main else BAD  # an article's own header holds its heading
    elif name not in ("html", "body") and not marks:
        kind = max([COVER if name in _forms else CONTENT, *(BAD if x in learned else _meaning(x) for x in names)])
    return Element(name, kind, marks, surely, tuple(names), at)


def parsed(page: str, learned: frozenset[str] = frozenset()) -> tuple[list[tuple[str, str]], list[Element]]:
    """(kind, text) in page order, where kind '' is text and 'p' or '/p' a tag; and the elements with the range of tokens that each holds."""
    out: list[tuple[str, str]] = []
    elements: list[Element] = []
    stack: list[Element] = []
    at, n, main = 0, len(page), 0

    def close(count: int) -> int:
        """Ends the last `count` open elements; gives how many of them mark content."""
        marked = 0
        for _ in range(count):
            e = stack.pop()
            e.end = len(out)
            marked += e.main
        return marked

    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            out.append(("", page[at:end]))
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        attrs = m["attrs"] or ""
        if m["close"]:
            depth = next((k for k, e in enumerate(reversed(stack)) if e.name == name), None)
            if depth is not None:
                main -= close(depth + 1)
            out.append(("/" + name, ""))
            continue
        alone = attrs.endswith("/") or name in _void
        if name in _raw and not alone:
            ends = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = ends.end() if ends else (at if name in ("head", "button") else n)
            continue
        if not alone and attrs and _UNSEEN.search(_QUOTED.sub("=x", attrs) if "style" not in attrs.lower() and "aria" not in attrs.lower() else attrs):
            at = _end_of(page, name, at)
            continue
        if not alone:
            if name in _open_ended:  # the one before it ends
                if stack and stack[-1].name == name:
                    main -= close(1)
            elif stack and stack[-1].name == "p" and name not in _inline:
                main -= close(1)
            e = _element(name, attrs, main > 0, learned, len(out))
            elements.append(e)
            stack.append(e)
            main += e.main
        out.append((name, ""))
    close(len(stack))
    return out, elements


def _end_of(page: str, name: str, at: int) -> int:
    """Where an element that is not shown ends: at its own end tag, or the page's end; a p, li and the like also where the next begins."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s>/])[^>]*>", re.I).finditer(page, at):
        if name in _open_ended and not m[1]:
            return m.start()
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        if not depth:
            return m.end()
    return len(page)


def _covered(n: int, spans) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    for e in spans:
        depth[e.start] += 1
        depth[e.end] -= 1
    return np.cumsum(depth)[:n] > 0


def tokens(page: str, learned: frozenset[str] = frozenset()) -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray, np.ndarray, list[Element]]:
    """Tokens, how many words each has, whether it is in furniture, whether in marked content, and the elements."""
    out, elements = parsed(page, learned)
    n = len(out)
    words = np.fromiter((0 if kind else len(text.split()) for kind, text in out), np.int64, n)
    sure = [e.start for e in elements if e.surely]
    holds = lambda e: bisect_right(sure, e.start) < bisect_left(sure, e.end)
    bad = [e for e in elements if e.kind == BAD and not (e.name not in _furniture and holds(e))]
    in_bad = _covered(n, bad)
    before = np.concatenate([[0], np.cumsum(np.where(in_bad, 0, words))])
    covers = [e for e in elements if e.kind == COVER and not holds(e) and 2 * (before[e.end] - before[e.start]) <= before[-1]]
    in_bad |= _covered(n, covers)
    return out, words, in_bad, _covered(n, [e for e in elements if e.main]) & ~in_bad, elements


@dataclass(frozen=True)
class Weights:
    """What the labelled pages teach: a weight of each tag kind, and names that are furniture."""

    tags: dict[str, float]
    furniture: frozenset[str] = frozenset()


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    found, words, in_bad, _, _ = tokens(page, weights.furniture)
    tags = np.fromiter((weights.tags.get(kind, DEFAULT) if kind else 0.0 for kind, _ in found), float, len(found))
    gain = np.where(in_bad, FURNITURE_WORD * words, WORD * words + tags)
    score, best, best_range, start = 0.0, 0.0, (0, 0), 0
    for k, x in enumerate(gain.tolist()):
        score += x
        if score > best:
            best, best_range = score, (start, k + 1)
        if score <= 0:
            score, start = 0.0, k + 1
    parts = []
    for k in range(*best_range):
        kind, text = found[k]
        if not kind:
            parts.append("" if in_bad[k] else text)
        elif in_bad[k] or kind.lstrip("/") not in _inline:
            parts.append(" ")
    return " ".join(html.unescape("".join(parts)).split())


def tag_weights(pages: DataFrame, url_col: str = "url", html_col: str = "html", max_pages: int = 2_000) -> Weights:
    """The weight of each tag kind and the names of furniture, from at most max_pages pages that mark their content."""
    body = F.col(f"`{html_col}`").cast("string")
    labelled = pages.where(body.rlike(r"(?i)<(article|main)\b|role=.?main|articlebody")).select(F.col(f"`{url_col}`").cast("string").alias("url"), F.xxhash64(body).alias("h"))
    chosen = labelled.orderBy(F.xxhash64("url"), "h").limit(max_pages).select("h").distinct()
    rows = pages.select(body.alias("html"), F.xxhash64(body).alias("h")).join(F.broadcast(chosen), "h").select("html")  # at most max_pages numbers

    def count(batches):
        for b in batches:
            tally: dict[str, np.ndarray] = {}  # inside, outside, pages
            for page in b.column(0).to_pylist():
                found, words, in_bad, main, elements = tokens(page)
                for (kind, _), n, inside in zip(found, words.tolist(), main.tolist()):
                    tally.setdefault(kind, np.zeros(3, np.int64))[0 if inside else 1] += 1 if kind else n
                spans: dict[str, list[Element]] = {}
                for e in elements:
                    for x in {"." + x for x in e.names}:
                        spans.setdefault(x, []).append(e)
                for x, es in spans.items():
                    held = words[_covered(len(words), es)].sum(), words[_covered(len(words), es) & main].sum()
                    tally.setdefault(x, np.zeros(3, np.int64))
                    tally[x] += [held[1], held[0] - held[1], 1]
            values = np.array(list(tally.values()), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), *(pa.array(values[:, k]) for k in range(3))], ["kind", "inside", "outside", "pages"])

    counted = rows.mapInArrow(count, "kind string, inside long, outside long, pages long").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("inside", "outside", "pages")))
    is_name = F.col("kind").startswith(".")
    tags = counted.where(~is_name).orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(2_000).collect()  # kinds of tags, bounded
    inside, outside = (max(1, sum(r[c] for r in tags if r["kind"])) for c in ("inside", "outside"))
    words = next((r for r in tags if not r["kind"]), {"inside": 0, "outside": 0})
    # of at most max_pages pages, so bounded as well
    rate = RATE * (F.col("inside") + 0.5) * max(1, words["outside"]) < (F.col("outside") + 0.5) * max(1, words["inside"])
    names = counted.where(is_name & (F.col("pages") >= LEAST_PAGES) & rate).orderBy(F.desc("outside"), "kind").limit(5_000).collect()
    weights = {r["kind"]: float(np.clip(np.log((r["inside"] + 0.5) / inside) - np.log((r["outside"] + 0.5) / outside), LOWEST, HIGHEST)) for r in tags if r["kind"]}
    return Weights(weights, frozenset(r["kind"][1:] for r in names))


def extracted(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(page, weights) for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
