"""Main text of web pages by a tree-structured graphical model.

A page's tree holds its block elements and, as leaves, its blocks of text. Each node is content or
not; features of a node and the pair of parent and child have potentials. Messages passed up from
the leaves and down from the root (sum-product) give each block's exact marginal. The potentials are
trained on labelled pages by gradient ascent on the likelihood of their labels, with the same messages.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantfeed.llm.common import slices

SLICE_CHARS = 2_000_000
#: At most so many pages of the table, chosen by a hash of the id, join the built-in labelled pages.
TRAIN_PAGES = 200
#: Longest page in that sample, in characters; it bounds what the driver receives. Extraction takes pages of any length.
TRAIN_CHARS = 500_000

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Formulas are part of the sentence that they stand in.
INLINE |= frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mtable mtr mtd mspace mstyle mpadded mphantom semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup: it lasts to their own end tag.
RAW = frozenset("script style textarea title iframe".split())
#: Form controls, drawings, media and unused parts: what is inside isn't shown as text.
HIDDEN = frozenset("template svg select button option datalist canvas audio video".split())
#: Opening one of these ends a drawing or an option that was left open.
BREAKOUT = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table blockquote pre article section main body nav aside header footer figure form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening the tag closes an open element of one of these names first.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table body article section div nav aside main".split())
#: Kinds of parent in the pair potentials.
KINDS = {"html": 0, "body": 0, "nav": 2, "aside": 2, "footer": 2, "header": 2, "form": 2, "menu": 2, "article": 3, "p": 3, "blockquote": 3, "pre": 3, "main": 4}
N_KINDS = 6  # the last for other elements with a telling class, 1 for the rest

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*+(?:>|\Z)))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Nodes in page order, parents before children; blocks are nodes with text."""

    parent: list[int]
    tag: list[str]
    names: list[tuple[str, ...]]
    text: list[str | None]
    linked: list[int]  # characters of a block that are inside links


class Open:
    """Names of open elements, outermost first, and the depths at which each name stands: looking one up walks over no others."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes: list[int] = []
        self.depths: dict[str, list[int]] = {}

    def push(self, name: str, node: int = -1) -> None:
        self.depths.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Closes what stands at the depth and inside."""
        while len(self.names) > depth:
            self.depths[self.names.pop()].pop()
            self.nodes.pop()

    def last(self, name: str) -> int:
        """Depth of the innermost element of the name; -1 for none."""
        found = self.depths.get(name)
        return found[-1] if found else -1

    def outermost(self, names: Iterable[str], below: int) -> int:
        """Depth of the outermost element of the names deeper than ``below``; -1 for none."""
        firsts = [d[k] for d in (self.depths.get(n, []) for n in names) if (k := bisect_right(d, below)) < len(d)]
        return min(firsts, default=-1)


def parse(page: str | None) -> Tree:
    """The page's tree. Unclosed, crossed and truncated tags are taken as far as they go, in time that grows with the page.

    A hidden element that isn't closed ends with the element that it stands in, so it takes no text of others.
    """
    tree = Tree([-1], ["html"], [()], [None], [0])
    stack, hidden = Open(), Open()  # hidden: open elements from a hidden one on
    stack.push("html", 0)
    runs, links, in_link, pos = [], 0, 0, 0
    page = page or ""

    def add(tag: str, names: tuple[str, ...], text: str | None = None, linked: int = 0) -> None:
        tree.parent.append(stack.nodes[-1])
        tree.tag.append(tag)
        tree.names.append(names)
        tree.text.append(text)
        tree.linked.append(linked)

    def flush() -> None:
        nonlocal runs, links
        if runs:
            text = " ".join(entities.unescape("".join(runs)).split())
            if text:
                add("#", (), text, links)
        runs, links = [], 0

    while True:
        m = _TAG.search(page, pos)
        said = page[pos : m.start() if m else len(page)]
        if said and not hidden.names:
            runs.append(said)
            if in_link:
                links += len(said)
        if not m:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closed = m[0].endswith("/>")
        if tag in RAW and not m[1]:
            if not closed:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else len(page)
            continue
        if hidden.names:
            if m[1]:
                if hidden.last(tag) >= 0:
                    hidden.cut(hidden.last(tag))
                    continue
                if tag in INLINE or stack.last(tag) < 0:
                    continue
                hidden.cut(0)  # its parent ends, and so does what was left open
            elif tag in BREAKOUT and (hidden.names[-1] == "option" or hidden.names[0] == "svg" and hidden.last("foreignobject") < 0):
                hidden.cut(0)
            else:
                if not (closed or tag in VOID or tag in INLINE or tag == hidden.names[-1] == "option"):
                    hidden.push(tag)
                continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        if tag == "br":
            runs.append(" ")
        if tag in INLINE:
            continue
        if m[1]:
            if stack.last(tag) > 0:
                flush()
                stack.cut(stack.last(tag))
            continue
        if tag in HIDDEN:
            if not closed:
                hidden.push(tag)
            continue
        if tag == "head":
            continue
        flush()
        if tag in VOID or tag == "html":
            continue
        if stack.names[-1] == "p" or stack.names[-1] in HEADINGS and tag in HEADINGS:
            stack.cut(len(stack.names) - 1)
        if tag in CLOSES:
            depth = stack.outermost(CLOSES[tag], max(0, *map(stack.last, SCOPES)))
            if depth > 0:
                stack.cut(depth)
        if tag == "body" and stack.last("body") >= 0:
            continue
        names = tuple(dict.fromkeys(w for a in _ATTR.findall(m[3]) for w in _NAME.findall(" ".join(a[1:]).lower()))) if "=" in m[3] else ()
        add(tag, names)
        stack.push(tag, len(tree.parent) - 1)
        in_link = 0
    flush()
    return tree


def _features(tree: Tree, i: int) -> list[str]:
    text, up = tree.text[i], tree.parent[i]
    if text is None:
        return [f"tag {tree.tag[i]}", *(f"name {n}" for n in tree.names[i])]
    size, inner = len(text), tree.tag[up]
    share = min(3, int(4 * tree.linked[i] / size)) if tree.linked[i] else -1
    stops = sum(text.count(c) for c in ".!?")
    out = ["block", f"size {min(size.bit_length(), 11)}", f"links {share}", f"in {inner}", f"stops {min(stops, 3)}"]
    return [*out, "copyright"] if "©" in text else out


class Trees:
    """Many pages' trees as flat arrays, for messages level by level."""

    def __init__(self, trees: Sequence[Tree], vocabulary: dict[str, int], grow: bool = False):
        parent, kind, block, at, flat, depth = [], [], [], [0], [], []
        self.first = [0]
        for t in trees:
            base = len(parent)
            for i, p in enumerate(t.parent):
                parent.append(p + base if p >= 0 else -1)
                depth.append(0 if p < 0 else depth[p + base] + 1)
                is_block = t.text[i] is not None
                block.append(is_block)
                k = KINDS.get(t.tag[i], 1)
                kind.append(5 if k == 1 and t.names[i] else k)
                for f in _features(t, i):
                    n = vocabulary.setdefault(f, len(vocabulary)) if grow else vocabulary.get(f)
                    if n is not None:
                        flat.append(n)
                at.append(len(flat))
            self.first.append(len(parent))
        self.parent, self.block = np.array(parent), np.array(block)
        self.kind, self.depth = np.array(kind), np.array(depth)
        self.owner = np.repeat(np.arange(len(parent)), np.diff(at))
        self.flat = np.array(flat, int)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max() + 2)) if len(parent) else []
        self.levels = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        self.pair = self.kind[self.parent] * 2 + self.block  # of each node with its parent; the root's isn't used


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray  # for being content, by feature
    pairs: np.ndarray  # kinds of parent and child x parent's label x child's label

    def marginals(self, t: Trees) -> tuple[np.ndarray, np.ndarray]:
        """Each node's probability of being content, and that of each pair of labels with its parent."""
        n = len(t.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(t.owner, self.weights[t.flat], n) if len(t.flat) else 0
        theta = self.pairs[t.pair]
        up, sent = own.copy(), np.zeros((n, 2))
        for level in reversed(t.levels):
            sent[level] = np.logaddexp.reduce(theta[level] + up[level][:, None, :], axis=2)
            np.add.at(up, t.parent[level], sent[level])
        belief, both = up.copy(), np.zeros((n, 2, 2))
        for level in t.levels:
            p = t.parent[level]
            joint = (belief[p] - sent[level])[:, :, None] + theta[level] + up[level][:, None, :]
            belief[level] = np.logaddexp.reduce(joint, axis=1)
            both[level] = joint
        roots = t.parent < 0
        prob = np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))
        both = np.exp(both - np.logaddexp.reduce(both.reshape(n, 4), axis=1)[:, None, None])
        both[roots] = 0
        return prob[:, 1], both


def node_labels(tree: Tree, content: Sequence[bool]) -> np.ndarray:
    """Labels of all nodes from those of blocks: an element below the body is content if most of its text is."""
    n = len(tree.parent)
    good, size = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        if tree.text[i] is not None:
            size[i], good[i] = len(tree.text[i]), len(tree.text[i]) * content[i]
        if tree.parent[i] >= 0:
            size[tree.parent[i]] += size[i]
            good[tree.parent[i]] += good[i]
    out = (good > 0.5 * size).astype(int)
    for i, tag in enumerate(tree.tag):
        if tag in ("html", "body"):
            out[i] = 0
    return out


def train(pages: Iterable[tuple[Tree, Sequence[bool]]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Fit on trees whose blocks are labelled."""
    pages = list(pages)
    vocabulary: dict[str, int] = {}
    t = Trees([p[0] for p in pages], vocabulary, grow=True)
    y = np.concatenate([node_labels(*p) for p in pages])
    inner = np.flatnonzero(t.parent >= 0)
    model = Model(vocabulary, np.zeros(len(vocabulary)), np.zeros((2 * N_KINDS, 2, 2)))
    seen = np.zeros_like(model.pairs)
    np.add.at(seen, (t.pair[inner], y[t.parent[inner]], y[inner]), 1)
    found = np.bincount(t.flat, y[t.owner], len(vocabulary))
    scale_w, scale_p = np.full(len(vocabulary), 1e-8), np.full(model.pairs.shape, 1e-8)
    for _ in range(rounds):
        p, both = model.marginals(t)
        expected = np.zeros_like(seen)
        np.add.at(expected, t.pair[inner], both[inner])
        grad_w = (found - np.bincount(t.flat, p[t.owner], len(vocabulary))) / len(pages) - decay * model.weights
        grad_p = (seen - expected) / len(pages) - decay * model.pairs
        scale_w += grad_w**2
        scale_p += grad_p**2
        model.weights += rate * grad_w / np.sqrt(scale_w)
        model.pairs += rate * grad_p / np.sqrt(scale_p)
    return model


#: Labelled layouts: each line is a tag with its class, indented below its parent. "+n" and "-n" are a
#: block of n sentences that is content or not, "+t" and "-t" one of a few words, "-l" a list of links.
LAYOUTS = """
nav|-l;header|-t;article|h1|+t,p|+3,p|+2,h2|+t,p|+4;footer|-1
div.ad|-1;main|article|h1|+t,p|+3,p|+5,aside.related|-l,p|+2;footer|-t
header.site-header|div.logo|-t,nav.menu|-l;div.content|h1.title|+t,div.post-body|p|+2,p|+3,ul|li|+1,li|+1;div.sidebar|div.widget|-l,div.widget|-1;footer.footer|-1
div.header|-t;div.nav|-l;div.main|div.article|h1|+t,p|+4,p|+3,blockquote|+2,div.share|-l,p|+1;div.comments|h3|-t,div.comment|p|-2,div.comment|p|-3;div.footer|-t
div.cookie-notice|p|-2;div.container|div.entry-content|p|+3,p|+4,table|tr|td|+t,td|+t;form.newsletter-signup|label|-t,p|-1
div#masthead|-t;div#content|section.story|h1|+t,p|+2,p|+2,p|+2,section#comments.user-comments|article.comment|p|-2,article.comment|p|-1;div#banner.advert|p|-1
nav|-l;div.notice|p|-1;article|header|h1|+t;article|p|+3,div.advertisement|-1,p|+3,p|+1,footer|-1;aside|-1;section.comments|div|p|-3
div.banner.promo|-1;div.page|div.text|p|+5,p|+3,pre|+2,ol|li|+1,li|+2;div.related-posts|-l;div.breadcrumb|-l
header|h1|-t,p|-1;main|h1|+t,section|h2|+t,p|+3,section|h2|+t,p|+2,form.search|-t;aside.sidebar|h3|-t,p|-2,ul|-l;footer|p|-2
div.popup.modal|p|-1;div.top-bar|-l;div#main|div.body|+6,div.body|+3;div.disqus.replies|div.reply|-2,div.reply|-2;div.copyright|-t
ul.menu|-l;td.content|p|+3,p|+2;td.left-column|-l;p.disclaimer|-2;article|h1|+t,p|+1
div.alert.warning|-1;section.article-body|p|+2,p|+4,figure|figcaption|+t;div.tags|-l;div.author-bio|-1;div.pagination|-l;div.subscribe|-1
""".strip().split("\n")


def labelled_layouts(repeats: int = 6, seed: int = 5) -> list[tuple[Tree, list[bool]]]:
    """Trees of the layouts with made-up text, several times each."""
    rng = np.random.default_rng(seed)

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))

    def build(spec: str) -> list[tuple[Tree, list[bool]]]:
        tree, content = Tree([-1, 0], ["html", "body"], [(), ()], [None, None], [0, 0]), [False, False]

        def node(parent: int, tag: str, names: tuple[str, ...], text: str | None, linked: int, good: bool) -> int:
            for col, v in ((tree.parent, parent), (tree.tag, tag), (tree.names, names), (tree.text, text), (tree.linked, linked), (content, good)):
                col.append(v)
            return len(content) - 1

        for top in spec.split(";"):
            head, _, below = top.partition("|")
            root = _element(node, 1, head)
            if below[:1] in "+-":
                _leaf(node, root, below, words, rng)
                continue
            at, shape = root, None
            for chain in below.split(","):
                parts = chain.split("|")
                at = root
                for k, part in enumerate(parts):
                    if part[0] in "+-":
                        _leaf(node, at, part, words, rng)
                    else:
                        deeper = k < len(parts) - 2 and shape == part
                        at = holder if deeper else _element(node, at, part)
                        if k == 0 and len(parts) > 2:
                            shape, holder = part, at
        return [(tree, content)]

    return [x for _ in range(repeats) for spec in LAYOUTS for x in build(spec)]


def _element(node, parent: int, spec: str) -> int:
    names = tuple(_NAME.findall(" ".join(re.split(r"[.#]", spec)[1:])))
    return node(parent, re.split(r"[.#]", spec)[0], names, None, 0, False)


def _leaf(node, parent: int, spec: str, words, rng) -> None:
    good, kind = spec[0] == "+", spec[1:]
    if kind == "l":
        for _ in range(int(rng.integers(2, 7))):
            text = words(int(rng.integers(1, 4)))
            node(node(parent, "li", (), None, 0, False), "#", (), text, len(text), False)
    elif kind == "t":
        text = words(int(rng.integers(2, 9))) + rng.choice(["", "", ".", " ©" if not good else ""])
        node(parent, "#", (), text, 0, good)
    else:
        node(parent, "#", (), " ".join(words(int(rng.integers(3, 25))) + "." for _ in range(int(kind))), 0, good)


#: In pages whose markup names the article, a block under one of these isn't content.
ASIDE_TAGS = frozenset("nav aside footer header form menu".split())
ASIDE_NAMES = frozenset("ad ads advert advertisement sidebar comment comments reply replies share related promo banner cookie notice newsletter".split())


def labelled_by_markup(tree: Tree) -> list[bool] | None:
    """Labels of a page with exactly one article element, read off its markup; else None."""
    if tree.tag.count("article") != 1:
        return None
    state: list[int] = []  # 0 outside, 1 in the article, 2 in something set aside
    for i, p in enumerate(tree.parent):
        s = state[p] if p >= 0 else 0
        if tree.tag[i] in ASIDE_TAGS or ASIDE_NAMES & set(tree.names[i]):
            s = 2
        elif tree.tag[i] == "article" and s == 0:
            s = 1
        state.append(s)
    return [t is not None and s == 1 for t, s in zip(tree.text, state, strict=True)]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = TRAIN_PAGES) -> Model:
    """Train on the labelled layouts and on up to ``most`` pages that their own markup labels.

    The ids' smallest hashes choose the pages; only then are texts fetched, so tasks don't send theirs.
    """
    html = F.col(html_col)
    marked = pages.filter(html.contains("<article") & (F.length(html) <= TRAIN_CHARS)).select(F.xxhash64(id_col).alias("h"), html.alias("html"))
    last = marked.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    rows = [] if last is None else marked.filter(F.col("h") <= last).groupBy("h").agg(F.min("html").alias("html")).collect()
    rows.sort(key=lambda r: r["h"])
    trees = [parse(r["html"]) for r in rows]
    marked = [(t, y) for t in trees if (y := labelled_by_markup(t)) is not None]
    return train([*labelled_layouts(), *marked])


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id_col, url_col, text, n_chars), one per page: its content blocks in page order.

    Null and empty pages and pages without content give an empty text. Character references are
    decoded, white space inside a block becomes one space, blocks are joined by two line feeds. A page
    of any length is read whole. Repeated rows and null ids are treated like others; other columns are
    left out, whatever their names; an empty table gives no rows.
    """
    # Plain values, so that workers need no copy of this package.
    held = pages.sparkSession.sparkContext.broadcast((model.vocabulary, model.weights, model.pairs))
    ids = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"))

    def run(batches):
        at = Model(*held.value)
        for batch in batches:
            htmls, texts = batch.column(2).to_pylist(), []
            for i, j in slices([len(h or "") for h in htmls], SLICE_CHARS):
                trees = [parse(h) for h in htmls[i:j]]
                t = Trees(trees, at.vocabulary)
                content = at.marginals(t)[0] >= 0.5
                for tree, begin in zip(trees, t.first[:-1], strict=True):
                    texts.append("\n\n".join(s for k, s in enumerate(tree.text) if s is not None and content[begin + k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema.fields[:2])
    return ids.mapInArrow(run, f"{schema}, text string, n_chars long")
