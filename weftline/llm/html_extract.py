"""Main text of web pages by minimum-cut labelling of their text blocks.

A tolerant scan of the markup yields text blocks with their place in the element tree. A logistic classifier, trained
here on pages made by a rule, prices each block as content or boilerplate; the prices are the capacities to the two
terminals. Neighbours in page order, and consecutive blocks of one parent, are tied by smoothness edges that weaken
with their distance in the tree. A maximum flow gives the cheapest labelling.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import small_batches, text_blocks

# Elements by what they mean for text.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr center noscript object svg g text tspan math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle mover munder semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe template select button noembed".split())
_BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset label legend option head".split())
_BAD_WORDS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond disqus social share sharing related recommended widget login signin signup register search pagination pager tags toolbar copyright legal disclaimer skip".split())
_GOOD_WORDS = frozenset("article content entry post body story main text maincontent prose".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_MARK = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?,;:]")
#: Tags whose quotes never close, after which quotes are no longer believed.
_DOUBT = 16

FEATURES = ("one", "log_chars", "link_share", "marks_per_word", "in_article", "good_words", "bad_words", "bad_element", "heading", "list_item", "few_words", "after_article")


class Block:
    __slots__ = ("bad", "bad_element", "good", "in_article", "after", "item", "heading", "linked", "parent", "path", "text")

    def __init__(self, text: str, linked: int, where: Element, item: bool, heading: bool, after: bool):
        self.text, self.linked, self.parent, self.path = text, linked, where.number, where.path
        self.bad, self.good, self.bad_element, self.in_article = where.bad, where.good, where.bad_element, where.in_article
        self.item, self.heading, self.after = item, heading, after


class Element:
    __slots__ = ("bad", "bad_element", "good", "in_article", "number", "path", "tag")

    def __init__(self, tag: str, number: int, above: Element | None, attributes: str):
        self.tag, self.number = tag, number
        self.path = (*above.path, number)[-64:] if above else (number,)
        self.bad, self.good = (above.bad, above.good) if above else (0, 0)
        self.bad_element = above.bad_element if above else False
        self.in_article = above.in_article if above else False
        if tag in ("article", "main"):
            self.in_article = True
        if tag in _BOILERPLATE or tag == "header" and not self.in_article:
            self.bad_element = True
        if attributes and tag not in ("html", "body"):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                if name in ("class", "id"):
                    words = {w.lower() for w in _WORDS.findall(value)}
                    self.bad += bool(words & _BAD_WORDS)
                    self.good += bool(words & _GOOD_WORDS)
                elif name == "role":
                    self.bad_element |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form")
                    self.in_article |= value.lower() in ("main", "article")
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    self.bad += 1


def blocks(html: str | None) -> list[Block]:
    """Text blocks in page order: decoded, white space made single spaces, empty ones left out."""
    if not html:
        return []
    stack = [Element("", 0, None, "")]
    out: list[Block] = []
    held: list[tuple[str, bool]] = []
    state = {"at": 0, "n": 0, "anchors": 0, "item": False, "heading": False, "ended": False}

    def flush():
        if held:
            text = " ".join(unescape("".join(t for t, _ in held)).split())
            if text:
                linked = sum(len(t) for t, a in held if a)
                where = stack[-1]
                out.append(Block(text, min(linked, len(text)), where, any(e.tag == "li" for e in stack[-3:]), where.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), state["ended"] and not where.in_article))
            held.clear()

    at, n, number, anchors, doubts = 0, len(html), 0, 0, 0
    unclosed: set[str] = set()  # raw elements without an end from here on, which are not searched for again
    while at < n:
        m = _MARK.search(html, at)
        if m is None:
            held.append((html[at:], anchors > 0))
            break
        if m.start() > at:
            held.append((html[at : m.start()], anchors > 0))
        at = m.start()
        if m.group() == "<!--":
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if m.group() in ("<!", "<?"):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        t = _TAG.match(html, at) if doubts < _DOUBT else None
        if t is None:
            doubts += 1
            t = _PLAIN_TAG.match(html, at)
            if t is None:  # a tag without an end: the rest is markup
                break
        at = t.end()
        closing, tag, attributes = t.group(1), t.group(2).lower(), t.group(3)
        if tag in _RAW and not closing:
            if not attributes.endswith("/"):
                end = None if tag in unclosed else re.compile(rf"(?i)</{re.escape(tag)}\b[^>]*+>").search(html, at)
                if end is None:
                    unclosed.add(tag)
                at = end.end() if end else n if tag in ("script", "style", "textarea", "title") else at
            if tag not in _INLINE:
                held.append((" ", False))
            continue
        if tag in _INLINE:
            if tag == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            elif tag in ("br", "img", "wbr"):
                held.append((" ", False) if tag != "wbr" else ("", False))
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in ("article", "main"):
                        state["ended"] = True
                    del stack[k:]
                    anchors = 0
                    break
            continue
        if stack[-1].tag == "p":  # any block ends a paragraph
            stack.pop()
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _LIMITS[tag] and stack[k].tag not in _CLOSES[tag]:
                    break
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    break
        if tag not in _VOID:
            number += 1
            stack.append(Element(tag, number, stack[-1], attributes))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    out = np.empty((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        out[i] = (
            1, math.log1p(len(b.text)), b.linked / max(1, len(b.text)), min(1.0, len(_SENTENCE.findall(b.text)) / words),
            b.in_article, min(b.good, 3), min(b.bad, 3), b.bad_element, b.heading, b.item, words < 6, b.after,
        )
    return out


#: Price of what markup forbids outright, and the weights of the strongest smoothness edge that training chooses from.
FORBIDDEN, SMOOTH = 50.0, (0.0, 0.5, 1.0, 2.0, 4.0, 8.0)


def edges(found: list[Block], smooth: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and consecutive blocks of one parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            same = 0
            for x, y in zip(a.path, b.path, strict=False):
                if x != y:
                    break
                same += 1
            out.append((i - 1, i, smooth / (1 + len(a.path) + len(b.path) - 2 * same)))
        above = b.path[-2] if len(b.path) > 1 else 0
        if (k := last.get(above)) is not None and k != i - 1:
            out.append((k, i, smooth / 3))
        last[above] = i
    return out


def min_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total price: a block with gain g pays g (or -g, if negative) for the label against it, a tie its weight if its ends differ.

    Blocks whose own gain outweighs all their ties are settled first, which changes no optimum; maximum flow decides the rest.
    """
    n = len(gain)
    gain, near = list(gain), [[] for _ in range(n)]
    for i, j, w in ties:
        near[i].append((j, w))
        near[j].append((i, w))
    label: list[bool | None] = [None] * n
    free = [sum(w for _, w in x) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) >= free[i]:
            label[i] = gain[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    free[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, gain, near, label)
        for i in rest:
            label[i] = i in side
    return label


def _max_flow(rest, gain, near, label) -> set[int]:
    """Dinic's algorithm over the unsettled blocks; returns those on the source's (content's) side of the cut."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: {} for i in [s, t, *rest]}
    for i in rest:
        if gain[i] > 0:
            cap[s][i], cap[i][s] = gain[i], 0.0
        else:
            cap[i][t], cap[t][i] = -gain[i], 0.0
        for j, w in near[i]:
            if label[j] is None:
                cap[i][j] = cap[i].get(j, 0.0) + w
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return set(level)
        todo = {i: iter(list(cap[i])) for i in level}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                push = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                path = [s]  # an edge skipped for that has its turn in the next phase
                continue
            for j in todo[i]:
                if cap[i][j] > 1e-12 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()


class Classifier:
    """Logistic regression over block features, by gradient descent, and the weight of smoothness."""

    smooth = 0.0

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 0.5, ridge: float = 1e-3):
        self.scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
        x = x / self.scale
        w = np.zeros(x.shape[1])
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        for k in range(steps):
            p = 1 / (1 + np.exp(-(x @ w)))
            w -= rate * (x.T @ (weight * (p - y)) / len(y) + ridge * w) * (2 if k < steps // 2 else 1)
        self.w = w

    def gains(self, found: list[Block]) -> list[float]:
        """Log odds of content; what the markup itself calls something else is forbidden."""
        z = np.clip((features(found) / self.scale) @ self.w, -8, 8).tolist()
        return [-FORBIDDEN if b.bad_element else g for b, g in zip(found, z, strict=True)]


_TRAIN_WORDS = "the of and to in a is that for on with as was by at from this are be it time people place year work house water light night story city river first long little great small under world".split()


def training_pages(n: int = 160, seed: int = 3, misled: bool = True) -> list[tuple[str, set[str]]]:
    """(html, texts of its content blocks) of pages made by a rule; every block's text is unique.

    If `misled`, some markup misleads: paragraphs of an article named like adverts or short as menu entries, boilerplate with whole
    sentences or names that promise content, pages without any telling names.
    """
    rng = np.random.default_rng(seed)
    one = lambda x: x[int(rng.integers(len(x)))]
    words = lambda a, b: " ".join(_TRAIN_WORDS[int(k)] for k in rng.integers(len(_TRAIN_WORDS), size=int(rng.integers(a, b))))
    count = iter(range(10**9))
    short = lambda: f"{words(1, 4)} x{next(count)}"
    sentence = lambda: ", ".join(words(3, 9) for _ in range(int(rng.integers(1, 4)))).capitalize() + "."
    out = []
    for k in range(n):
        content: set[str] = set()

        def good(tag: str, text: str, keep=content, names: str = "") -> str:
            keep.add(text)
            return f"<{tag}{names}>{text}</{tag}>"

        body = [good("h1", short())]
        for _ in range(int(rng.integers(2, 9))):
            kind = rng.random()
            if kind < 0.1:
                body.append(good("h2", short()))
            elif kind < 0.2:
                body.append("<ul>" + "".join(good("li", f"{words(4, 9)} y{next(count)}.") for _ in range(3)) + "</ul>")
            elif misled and kind < 0.3:  # a short line, or one named like something else
                body.append(good("p", short() if rng.random() < 0.5 else f"{words(4, 12)} t{next(count)}", names=one(["", ' class="promo"', ' class="side note"', ' id="share-of-voice"'])))
            else:
                body.append(good("p", " ".join(sentence() for _ in range(int(rng.integers(1, 6)))) + f" z{next(count)}."))
            if rng.random() < 0.15:
                body.append(f'<div class="{one(["ad", "promo", "related", "share"])}">{short()}</div>')
        links = lambda m: "".join(f'<li><a href="/{next(count)}">{short()}</a></li>' for _ in range(m))
        wrap = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry-content">', "</div>"), ('<div id="content">', "</div>"), ("<div>", "</div>")][k % 5]
        top = [f"<nav><ul>{links(5)}</ul></nav>", f'<div class="menu"><ul>{links(4)}</ul></div>', f"<header><p>{short()}</p></header>", f"<ul>{links(6)}</ul>"][k % 4]
        ad = ["", f'<div class="ad">{sentence()} w{next(count)}</div>', f'<div id="cookie-notice">{sentence()} w{next(count)}</div>'][k % 3]
        tail = [
            f"<footer>&copy; {short()}</footer>",
            f'<div class="sidebar"><p>{sentence()} v{next(count)}</p><ul>{links(3)}</ul></div><footer>{short()}</footer>',
            f'<section class="comments"><p>{sentence()} u{next(count)}</p><p>{sentence()} u{next(count)}</p></section>',
            f'<div class="comments"><div class="body"><p>{sentence()} {sentence()} u{next(count)}</p></div><div class="body"><p>{short()}</p></div><p>{sentence()} u{next(count)}</p></div>',
            f'<div class="related"><ul>{links(2)}<li class="story">{sentence()} r{next(count)}</li>{links(2)}</ul></div>',
        ][k % 7 % 5 if misled else k % 3]
        out.append((f"<html><body>{top}{ad}{wrap[0]}{''.join(body)}{wrap[1]}{tail}</body></html>", content))
    return out


def train(pages: list[tuple[str, set[str]]] | None = None) -> Classifier:
    """The classifier from three quarters of the pages; the smoothness that labels the others best, of equally good ones the least."""
    parsed = [(blocks(html), content) for html, content in pages or training_pages()]
    learn = [p for k, p in enumerate(parsed) if k % 4] or parsed
    model = Classifier(np.concatenate([features(found) for found, _ in learn]), np.array([b.text in content for found, content in learn for b in found], float))
    held = [(found, [b.text in content for b in found], model.gains(found)) for found, content in parsed[::4]]
    right = [sum(sum(map(bool.__eq__, min_cut(gain, edges(found, w)), truth)) for found, truth, gain in held) for w in SMOOTH]
    model.smooth = SMOOTH[right.index(max(right))]
    return model


def extract(html: str | None, model: Classifier) -> str:
    """The main text, blocks joined by an empty line; empty for a null page or one without content."""
    found = blocks(html)
    if not found:
        return ""
    label = min_cut(model.gains(found), edges(found, model.smooth))
    return "\n\n".join(b.text for b, keep in zip(found, label, strict=True) if keep)


def extract_pages(pages: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Per page row: page_id, url, text, n_chars (code points).

    A null or empty html, or one without content, gives an empty text; nothing of a very long one is left out. Of
    equally cheap labellings the one of least content wins. Repeated rows repeat their result; further columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    handle = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches):
        for batch in text_blocks(batches, "html"):
            found = [extract(h, handle.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return small_batches(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
