"""Main text of web pages by a tree-structured graphical model.

Every element of a page's tree is a binary variable: content or not.  A
node's potential comes from its tag, its class and id words and the length
and link share of its subtree; each parent-child edge has potentials that
depend on the child's kind.  One pass of sum-product messages from the
leaves up and one down give the exact content marginals; text whose element
has a marginal above one half is kept.  The parameters are fitted by
maximum likelihood (the gradient needs the same messages) to labelled pages
of several layouts, written by ``labelled_pages``.

``extract`` decodes character references, drops comments, scripts and
styles, ends a block at block-level tags, turns white space inside a block
into one space and joins blocks in page order by one space.  Whole pages are
read.  Defined cases: null html is the empty page (empty text); unclosed and
stray tags are repaired by the usual implied-end rules; a page without tags
is one text of the root; repeated rows each keep a row; null ids pass; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_batches, text_bytes

_TOKEN = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>|[!?/a-zA-Z][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noembed", "noframes", "xmp", "iframe")}
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = set("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul""".split())
#: Opening one of these ends an open element of the group, unless a fence stands between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
_SKIPPED = {"script", "style", "template", "noembed", "noframes", "iframe", "xmp"}

_KINDS = {"root": "html body #root", "head": "head title meta link base", "script": "script style noscript template iframe svg", "article": "article main", "nav": "nav menu",
          "header": "header hgroup", "footer": "footer address", "aside": "aside", "form": "form fieldset input textarea select option button label legend",
          "heading": "h1 h2 h3 h4 h5 h6", "p": "p blockquote pre figcaption dd dt", "list": "ul ol dl", "li": "li", "table": "table tbody thead tfoot tr td th caption",
          "section": "section", "div": "div center details summary figure dialog", "a": "a"}
_KIND = {t: k for k, (_, tags) in enumerate(_KINDS.items()) for t in tags.split()}
_OTHER = len(_KINDS)
KINDS = _OTHER + 1
_CUE = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?=$|[\s_-])", re.I).search
_AWAY = _CUE(r"ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disqus|discussion|foot(?:er)?|gdpr|head(?:er)?"
             r"|links?|login|masthead|menu|modal|nav\w*|newsletter|notice|notification|pager|pagination|popup|promo\w*|related|replies|respond|search"
             r"|share|sharing|side|sidebar|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|top|widget|alert|contentinfo|complementary")
_HERE = _CUE(r"article|articlebody|body|content|entry|main|page|post|prose|story|text")
FEATURES = KINDS + 8


def parse(page: str, labelled: bool = True) -> tuple[list[int], list[int], list[int], list[tuple[int, str | None]], list[int]]:
    """(parent, kind, cues, pieces, given labels) of a page's tree; node 0 is the root.

    cues: 1 for words that point away from content, 2 for words that point
    to it.  A piece is (node, text); text None ends a block.  Labels are read
    from pages of ``labelled_pages`` only; elsewhere data-y is any attribute.
    """
    parent, kind, cues, given = [-1], [0], [0], [-1]
    pieces: list[tuple[int, str | None]] = []
    tags, nodes = ["#root"], [0]
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            text = page[at:end]
            pieces.append((nodes[-1], htmllib.unescape(text) if "&" in text else text))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if not inline:
            pieces.append((nodes[-1], None))
        if m[1]:  # an end tag
            if tag in ("html", "body"):
                continue
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] == tag:
                    del tags[i:], nodes[i:]
                    break
                if inline and tags[i] not in _INLINE:
                    break
            continue
        if tag in _ENDS_P and "p" in tags:
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] == "p":
                    del tags[i:], nodes[i:]
                    break
                if tags[i] in ("button", "td", "th", "caption", "table"):
                    break
        elif tag in _ENDS:
            group, fence = _ENDS[tag]
            cut = 0
            for i in range(len(tags) - 1, 0, -1):
                if tags[i] in fence:
                    break
                if tags[i] in group:
                    cut = i
            if cut:
                del tags[cut:], nodes[cut:]
        if tag in _VOID:
            continue
        cue, label = 0, -1
        if m[3]:
            for name, *values in _ATTR.findall(m[3]):
                value = values[0] or values[1] or values[2]
                if name.lower() == "data-y":
                    label = int(value) if labelled else -1
                else:
                    cue |= (1 if _AWAY(value) else 0) | (2 if _HERE(value) else 0)
        parent.append(nodes[-1])
        kind.append(_KIND.get(tag, _OTHER))
        cues.append(cue)
        given.append(label)
        if tag in _RAW:
            close = _RAW[tag].search(page, at)
            stop = close.start() if close else n
            if tag not in _SKIPPED and stop > at:
                pieces.append((len(parent) - 1, htmllib.unescape(page[at:stop])))
            pieces.append((nodes[-1], None))
            at = n if not close else (page.find(">", stop) + 1 or n)
            continue
        if not m[3].endswith("/") or tag not in ("svg", "path", "g"):
            tags.append(tag)
            nodes.append(len(parent) - 1)
    return parent, kind, cues, pieces, given


@dataclass
class Forest:
    parent: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    levels: list[np.ndarray]


def forest(pages: list[tuple]) -> tuple[Forest, np.ndarray]:
    """All trees of a batch side by side, and where each one starts."""
    sizes = np.array([len(p[0]) for p in pages], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.array(p[0], np.int64) + s for p, s in zip(pages, start)])
    kind = np.concatenate([np.array(p[1], np.int64) for p in pages])
    cue = np.concatenate([np.array(p[2], np.int64) for p in pages])
    parent[start[:-1]] = -1
    owner = [o + s for p, s in zip(pages, start) for o, t in p[3] if t]
    chars = np.bincount(np.array(owner, np.int64), weights=[len(t.strip()) for p in pages for _, t in p[3] if t], minlength=len(parent)) if owner else np.zeros(len(parent))
    linked = np.where(kind == _KIND["a"], chars, 0.0)
    depth = np.zeros(len(parent), np.int64)
    levels, at = [start[:-1]], start[:-1]
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(len(parent) + 1))
    while True:
        count = first[at + 1] - first[at]
        if not count.sum():
            break
        lead = np.repeat(first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        at = order[lead + np.arange(count.sum())]
        depth[at] = len(levels)
        levels.append(at)
    for at in levels[:0:-1]:
        np.add.at(chars, parent[at], chars[at])
        np.add.at(linked, parent[at], linked[at])
    x = np.zeros((len(parent), FEATURES), np.float64)
    x[np.arange(len(parent)), kind] = 1
    share = linked / np.maximum(chars, 1)
    x[:, KINDS] = (cue & 1) > 0
    x[:, KINDS + 1] = cue == 2
    x[:, KINDS + 2] = share
    x[:, KINDS + 3] = share > 0.5
    vague = (kind != _KIND["p"]) & (kind != _KIND["h1"])  # a short paragraph is as good as a long one
    x[:, KINDS + 4] = np.minimum(np.log1p(chars) / 5, 1.5) * vague
    x[:, KINDS + 5] = (chars < 25) & vague
    x[:, KINDS + 6] = depth <= 2
    x[:, KINDS + 7] = 1
    return Forest(parent, kind, x, levels), start


@dataclass
class Model:
    unary: np.ndarray  # FEATURES: log-odds of content
    edge: np.ndarray  # KINDS x parent's state x child's state


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(f: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(content marginal per node, joint marginals per node's edge to its parent), by messages up and down."""
    own = np.zeros((len(f.parent), 2))
    own[:, 1] = f.features @ model.unary
    pair = model.edge[f.kind]
    up = np.zeros_like(own)
    for at in f.levels[:0:-1]:
        up[at] = _logsum(pair[at] + own[at][:, None, :], 2)
        np.add.at(own, f.parent[at], up[at])
    belief, joint = own.copy(), np.zeros_like(pair)
    for at in f.levels[1:]:
        rest = (belief[f.parent[at]] - up[at])[:, :, None] + pair[at]
        joint[at] = rest + own[at][:, None, :]
        belief[at] = own[at] + _logsum(rest, 1)
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    return p, joint


def labels_of(pages: list[tuple]) -> np.ndarray:
    """Each node's label: its own, else its parent's; the roots are content."""
    out = []
    for parent, _, _, _, given in pages:
        y: list[int] = []
        for p, g in zip(parent, given):
            y.append(g if g >= 0 else y[p] if p >= 0 else 1)
        out += y
    return np.array(out, np.int64)


def train(pages: list[str], rounds: int = 200, l2: float = 5e-5) -> Model:
    """Maximum likelihood by Adam; the gradient is the difference of given and expected counts."""
    parsed = [parse(p) for p in pages]
    f, _ = forest(parsed)
    y = labels_of(parsed)
    child = np.flatnonzero(f.parent >= 0)
    n = len(y)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    theta = np.zeros(FEATURES + KINDS * 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        model = Model(theta[:FEATURES], theta[FEATURES:].reshape(KINDS, 2, 2))
        p, joint = marginals(f, model)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, f.kind[child], joint[child])
        g = np.concatenate([f.features.T @ (p - y), (expected - seen).ravel()]) / n + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(KINDS, 2, 2))


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """Pages of several layouts with labels in data-y attributes (1: content)."""
    r = random.Random(seed)
    words = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    say = lambda lo, hi: " ".join(r.choices(words, k=r.randint(lo, hi))).capitalize() + r.choice([".", ".", "!", ""])
    link = lambda lo=1, hi=3: f'<a href="/{r.choice(words)}">{say(lo, hi)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9))) + "</ul>"

    def away(tag: str, cues: list[str], inner: str) -> str:
        named = r.random() < 0.5 and tag != "div"
        attr = "" if named and r.random() < 0.6 else f' {r.choice(["class", "id"])}="{r.choice(cues)}"'
        use = tag if named else "div"
        return f'<{use}{attr} data-y="0">{inner}</{use}>'

    def menu() -> str:
        return away("nav", ["menu", "nav", "main-nav", "navbar", "breadcrumb"], links())

    def small() -> str:
        return r.choice([
            lambda: away("div", ["ad", "ads", "ad-slot", "advert", "sponsored", "promo"], say(3, 25)),
            lambda: away("div", ["cookie-notice", "notice", "consent", "gdpr-banner"], f"<p>{say(5, 20)}</p><button>{say(1, 2)}</button>"),
            lambda: away("form", ["search", "newsletter", "login", "signup"], f"<label>{say(1, 3)}</label><input><button>{say(1, 2)}</button>"),
            lambda: away("aside", ["sidebar", "widget", "related", "side"], f"<h3>{say(1, 4)}</h3>{links()}"),
            lambda: away("aside", ["sidebar", "widget"], f"<p>{say(8, 40)}</p>"),
            lambda: away("div", ["share", "social", "tags"], " ".join(link() for _ in range(4))),
        ])()

    def comments() -> str:
        one = lambda: r.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', "<li><i>{}</i> {}</li>", "<p><i>{}</i></p><p>{}</p>", "<div><h4>{}</h4><p>{}</p></div>"] + ["<article><h4>{}</h4><p>{}</p></article>"] * (r.random() < 0.3)).format(say(1, 2), say(5, 40))
        return f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "replies", "disqus"])}" data-y="0">' + "".join(one() for _ in range(r.randint(1, 4))) + f"</{t}>"

    def paragraph() -> str:
        return r.choice([
            lambda: f"<p>{say(8, 90)}</p>", lambda: f"<p>{say(8, 60)} {link()} {say(4, 30)}</p>", lambda: f"<p>{say(1, 4)}</p>",
            lambda: f"<p><b>{say(4, 30)}<br><p>{say(5, 30)}</p>", lambda: f"<h2>{say(1, 7)}</h2>", lambda: f"<blockquote><p>{say(5, 40)}</p></blockquote>",
            lambda: "<ul>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
            lambda: "<table>" + "".join(f"<tr><td>{say(1, 4)}<td>{say(1, 4)}</tr>" for _ in range(3)) + "</table>",
            lambda: f'<p>{say(3, 20)}<script data-y="0">track("{say(1, 3)}")</script> {say(1, 9)}</p>', lambda: '<style data-y="0">p{}</style>',
            lambda: f"<div>{say(8, 50)}</div>", lambda: f"<pre>{say(4, 20)}</pre>", lambda: f"<section><h3>{say(1, 5)}</h3><p>{say(10, 60)}</p></section>",
        ])()

    out = []
    for _ in range(n):
        if r.random() < 0.4:  # a page that says little
            body = [f"<p>{say(1, 4)}</p>" for _ in range(r.choice([0, 1, 2, 5, 12, 30]))] + [paragraph()] * r.randint(0, 1)
        else:
            body = [paragraph() for _ in range(r.randint(1, 9))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body.insert(r.randint(0, len(body)), small())
        if r.random() < 0.25:
            body.append(comments())
        title = f"<h1>{say(2, 10)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.2:
            title = f'<div class="entry-title" data-y="1">{title}</div>'
        inner = title + "".join(body)
        main = r.choice([
            *[lambda: f'<article data-y="1">{inner}</article>'] * 4, lambda: f'<main data-y="1">{inner}</main>',
            lambda: f'<main data-y="1"><article class="post">{inner}</article></main>', lambda: f'<div class="{r.choice(["content", "entry-content", "post-body", "article-text"])}" data-y="1">{inner}</div>',
            lambda: f'<div id="main" data-y="1">{inner}</div>', lambda: f'<div data-y="1">{inner}</div>', lambda: f'<section data-y="1">{inner}</section>',
        ])()
        before = [menu() for _ in range(r.choice([0, 1, 1, 2]))] + [small() for _ in range(r.choice([0, 1, 1, 2]))]
        if r.random() < 0.6:
            before.insert(0, away("header", ["header", "masthead", "top"], r.choice([f"<h1>{say(1, 3)}</h1>", f"<p>{say(2, 8)}</p>", links()])))
        after = [small() for _ in range(r.choice([0, 0, 1, 2]))] + ([comments()] if r.random() < 0.3 else [])
        after.append(away("footer", ["footer", "foot", "copyright"], r.choice([f"&copy; {say(3, 15)}", links(), f"<p>{say(3, 20)}</p>"])))
        page = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            page = f'<div class="{r.choice(["wrapper", "page", "container"])}" data-y="1">{page}</div>'
        head = f'<head data-y="0"><meta charset="utf-8"><title>{say(2, 9)}</title><style>p{{margin:0}}</style><script>track()</script></head>'
        out.append(f"<!DOCTYPE html><html>{head}<body>{page}</body></html>")
    return out


@lru_cache(maxsize=2)
def default_model(pages: int = 300) -> Model:
    """Trained once a process: about a second, and the same for every input."""
    return train(labelled_pages(pages))


def kept_text(pieces: list[tuple[int, str | None]], content: np.ndarray) -> str:
    """Kept pieces; a block's end is a space, and runs of white space are one."""
    return " ".join("".join(" " if t is None else t for o, t in pieces if t is None or content[o]).split())


def texts(pages: list[str], model: Model) -> list[str]:
    parsed = [parse(p, labelled=False) for p in pages]
    if not parsed:
        return []
    f, start = forest(parsed)
    content = marginals(f, model)[0] > 0.5
    return [kept_text(p[3], content[a:b]) for p, a, b in zip(parsed, start, start[1:])]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row."""
    held = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = texts([b.decode() for b in text_bytes(batch.column(2))], held.value)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(got, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string", sized_by=2).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
