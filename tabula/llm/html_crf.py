"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags, with character references decoded. A block's features are its ancestors (tags, words of
their class, id and role), its own tag, and the form of its text (length, share of links,
punctuation, place). The field has two labels, article and other; it is trained on
labelled pages by its log-likelihood (forward-backward) and decoded by Viterbi.

Training is driver work on TRAIN_PAGES pages; extraction is one pass over the pages
without a shuffle, with the weights (a few hundred numbers) shipped along.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_PAGES = 600
EPOCHS, RATE, L2 = 150, 0.1, 1.0
BATCH_BYTES = 4 << 20

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "object math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle munder mover munderover mmultiscripts mtable mtr mtd mspace mpadded mphantom semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
"""Elements whose content is no text of the page; one left open goes on to the page's end."""
ASIDE = frozenset("template svg canvas audio video select annotation annotation-xml".split())
"""The same, but the tag of one left open is ignored."""

UNSEEN = frozenset("head noscript".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = re.compile(r"[.!?…:;\"”»)]$")
_MARKS = re.compile(r"[,.;!?]")
_RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)


def _words_of(attrs: str) -> frozenset[str]:
    """Features of an element's attributes."""
    out = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "itemprop"):
            out.update("name:" + w.lower().rstrip("s") for w in _PIECE.findall(html.unescape(value)))
        elif name == "role":
            out.add("role:" + value.lower())
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.add("hidden")
        elif name == "hidden" or value.lower() == "true":
            out.add("hidden")
    return frozenset(out)


class _Element:
    """An open element, with the features of all elements around it: those of ``known`` (all, if
    it is None). An element that adds none shares its parent's, so that depth costs nothing
    once a model's features are fixed."""

    __slots__ = ("tag", "around", "block", "unseen", "kids")

    def __init__(self, tag: str, attrs: str, parent: _Element | None, known: frozenset[str] | None = None):
        self.tag, self.kids = tag, {}
        own = frozenset({"in:" + tag}) | _words_of(attrs) if attrs else frozenset({"in:" + tag})
        own = own if known is None else own & known
        outer = parent.around if parent else frozenset()
        self.around = outer if own <= outer else outer | own
        self.block = tag if tag not in INLINE or parent is None else parent.block
        self.unseen = tag in UNSEEN or bool(parent and parent.unseen)


class Ancestry:
    """The elements met so far, below ``root``: elements of equal ancestry are one object."""

    __slots__ = ("root", "known", "made")

    def __init__(self, known: frozenset[str] | None = None):
        self.root, self.known, self.made = _Element("#", "", None, known), known, 0

    def child(self, parent: _Element, tag: str, attrs: str) -> _Element:
        got = parent.kids.get((tag, attrs))
        if got is None:
            got = parent.kids[tag, attrs] = _Element(tag, attrs, parent, self.known)
            self.made += 1
        return got


@dataclass
class Block:
    text: str
    element: _Element
    links: int


def blocks_of(page: str, ancestry: Ancestry | None = None) -> list[Block]:
    """The leaf blocks of a page in order. Time is linear in the page's length: every tag looks up
    where the elements that it may close stand on the stack."""
    ancestry = ancestry or Ancestry()
    stack, out = [ancestry.root], []
    places: defaultdict[str, list[int]] = defaultdict(list)
    """Where each tag's open elements stand on the stack."""
    blocks: list[int] = []
    """Where block-level elements stand."""
    pieces: list[str] = []
    state = {"at": None, "links": 0, "anchors": 0}

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, state["at"], state["links"]))
            pieces.clear()
        state["at"], state["links"] = None, 0

    def add(text: str) -> None:
        top = stack[-1]
        if top.unseen:
            return
        text = html.unescape(text) if "&" in text else text
        if not text.isspace():
            if state["at"] is None:
                state["at"] = top
            if state["anchors"]:
                state["links"] += len(text.strip())
        pieces.append(text)

    def pop_to(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()
            state["anchors"] -= tag == "a"

    at = 0
    unclosed: set[str] = set()
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if close:
            if places[tag]:
                pop_to(places[tag][-1])
            continue
        if tag in RAW or tag in ASIDE:
            if tag in unclosed or (attrs.endswith("/") and tag not in ("script", "style")):
                continue
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end is None and tag in ASIDE:
                unclosed.add(tag)
            else:
                at = end.end() if end else len(page)
                pieces.append(" " if pieces else "")
            continue
        if tag in VOID:
            continue
        if tag == "body":
            pop_to(1)  # a head left open ends here
        if tag not in INLINE:
            mine, scope = CLOSES.get(tag, ((), ()))
            if not mine and blocks and stack[blocks[-1]].tag == "p":
                pop_to(blocks[-1])
            elif mine:
                ends = max((places[t][-1] for t in ("p", *mine) if places[t]), default=0)
                if ends > max((places[t][-1] for t in scope if places[t]), default=0):
                    pop_to(ends)
                    while stack[-1].tag in mine:
                        pop_to(len(stack) - 1)
        places[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(ancestry.child(stack[-1], tag, attrs))
        state["anchors"] += tag == "a"
    flush()
    return out


_SIZES = (1, 2, 4, 7, 12, 20, 35, 60)


def text_features(block: Block, k: int, n: int) -> list[str]:
    words = block.text.count(" ") + 1
    size = sum(words > s for s in _SIZES)
    share = min(4, 4 * block.links // max(1, len(block.text)))
    out = [f"words:{size}", f"links:{share}", f"place:{min(9, 10 * k // n)}", f"tag:{block.element.block}"]
    out.append("ends" if _ENDS.search(block.text) else "open")
    out.append(f"marks:{min(3, len(_MARKS.findall(block.text)))}")
    if _RIGHTS.search(block.text):
        out.append("rights")
    if k == 0:
        out.append("first")
    if k == n - 1:
        out.append("last")
    return out


@dataclass
class Model:
    """``weights``: what a feature adds to the article label's score over the other's;
    ``bias`` of a block; ``change[i][j]``: from label i to j; ``start`` of the article label."""

    weights: dict[str, float]
    bias: float
    change: list[list[float]]
    start: float


def train(pages: list[tuple[str, dict[str, bool]]], epochs: int = EPOCHS) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over all pages at once. Texts without a
    label count as other."""
    names: dict[str, int] = {}
    flat, owner, place, labels, lengths = [], [], [], [], []
    block = 0
    for page, known in pages:
        got = blocks_of(page)
        lengths.append(len(got))
        for k, b in enumerate(got):
            for f in [*b.element.around, *text_features(b, k, len(got))]:
                flat.append(names.setdefault(f, len(names)))
                owner.append(block)
            place.append((len(lengths) - 1, k))
            labels.append(int(known.get(b.text, False)))
            block += 1
    n, longest = len(lengths), max(lengths, default=0)
    if not block:
        return Model({}, 0.0, [[0.0, 0.0], [0.0, 0.0]], 0.0)
    flat, owner, y = np.array(flat), np.array(owner), np.array(labels)
    row, col = np.array(place).T
    inside = np.arange(longest) < np.array(lengths)[:, None]
    truth = np.zeros((n, longest), int)
    truth[row, col] = y
    # sufficient counts of the labelled pages
    both = inside[:, 1:] if longest > 1 else np.zeros((n, 0), bool)
    want = np.array([[((truth[:, :-1] == i) & (truth[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        w, bias, start, change = theta[: len(names)], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
        unary = np.zeros((n, longest, 2))
        unary[row, col, 1] = np.bincount(owner, w[flat], block) + bias
        unary[:, 0, 1] += start
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = unary[:, 0]
        for t in range(1, longest):
            move = np.logaddexp.reduce(alpha[:, t - 1, :, None] + change, axis=1) + unary[:, t]
            alpha[:, t] = np.where(inside[:, t, None], move, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            move = np.logaddexp.reduce(change + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(inside[:, t + 1, None], move, 0.0)
        whole = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha[row, col, 1] + beta[row, col, 1] - whole[row])
        has = np.zeros((2, 2))
        for t in range(longest - 1):
            pair = alpha[:, t, :, None] + change + (unary[:, t + 1] + beta[:, t + 1])[:, None, :] - whole[:, None, None]
            has += np.exp(pair)[inside[:, t + 1]].sum(0)
        error = y - p
        first = col == 0
        grad = np.concatenate([np.bincount(flat, error[owner], len(names)), [error.sum(), error[first].sum()], (want - has).ravel()]) - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(theta[k]) for f, k in names.items()}, float(theta[-6]), theta[-4:].reshape(2, 2).tolist(), float(theta[-5]))


class Extractor:
    """Extraction with a trained model; ancestors' scores are kept per element."""

    MOST = 50_000

    def __init__(self, model: Model):
        self.model, self.known = model, frozenset(model.weights)
        self.ancestry, self.scores = Ancestry(self.known), {}

    def blocks(self, page: str) -> list[tuple[str, bool]]:
        """Every block's text and whether it is part of the article."""
        if self.ancestry.made > self.MOST:
            self.ancestry, self.scores = Ancestry(self.known), {}
        w, model = self.model.weights, self.model
        found = blocks_of(page, self.ancestry)
        if not found:
            return []
        (oo, oa), (ao, aa) = model.change
        other = article = 0.0
        back: list[tuple[bool, bool]] = []
        for k, b in enumerate(found):
            base = self.scores.get(b.element)
            if base is None:
                base = self.scores[b.element] = sum(w.get(f, 0.0) for f in b.element.around)
            u = base + model.bias + sum(w.get(f, 0.0) for f in text_features(b, k, len(found)))
            if k == 0:
                article = u + model.start
                continue
            back.append((article + ao > other + oo, article + aa > other + oa))
            other, article = max(other + oo, article + ao), max(other + oa, article + aa) + u
        label = article > other
        labels = [label]
        for from_other, from_article in reversed(back):
            label = from_article if label else from_other
            labels.append(label)
        return [(b.text, x) for b, x in zip(found, reversed(labels), strict=True)]

    def text(self, page: str | None) -> str:
        return "\n\n".join(t for t, main in self.blocks(page) if main) if page else ""


def extract(pages: DataFrame, model: Model, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the html by default) of every row, ``text`` and ``n_chars``.

    Blocks of the article in page order, white space inside a block turned into one space,
    joined by an empty line. A null or empty page, or one without an article, gives an empty
    text. Nothing is cut, whatever a page's length. Repeated rows are treated alike; columns
    of the two names are replaced; an empty table gives an empty result.
    """
    cols = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, "text", "n_chars")]
    src = pages.select(*[F.col(f"`{c}`") for c in cols], F.col(html_col).cast("string").alias("__html"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        extractor = Extractor(model)
        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [extractor.text(h) for h in part.column(len(cols)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)
