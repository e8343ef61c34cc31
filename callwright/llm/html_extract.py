"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks (leaves of the block-level tree).  Each block is read as
its tag path (tags and the words of class, id and role of all its ancestors), its words (hashed) and a
few numbers.  A bidirectional LSTM in numpy reads the whole sequence and labels every block as article
or not, so a block is judged by all of its page.

Training takes a bounded sample of pages (``SAMPLE_PAGES``, smallest hashes of the page id): their texts are
laid out anew in many page layouts, where the layout tells the label of each block.  The weights
are a function of the sample and the seed; they have a fixed size and go out with the tasks.

Defined results: null or empty html gives an empty text; text outside of any tag is a block; unclosed and
stray tags are tolerated; scripts, styles, comments and unrendered elements are never text (an unrendered
element ends with its parent, svg and math also at a tag that cannot stand in them, and any other that is
never closed is empty; an unclosed script, style, textarea or title takes the rest of the page, as in browsers); very long pages are read whole; equal rows give equal results; columns other than id, url and html are not read.
"""
from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches

SAMPLE_PAGES = 150
SAMPLE_PAGE_BYTES = 65_536  # larger pages take no part in training
LAYOUTS = 700
EPOCHS = 10
HIDDEN = 20
SEED = 7

# Elements of HTML.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = set("script style noscript template svg math iframe object canvas head title select textarea datalist audio video".split())
RAW = ("script", "style", "textarea", "title")  # ended by their own tag alone, or by the page's end
FOREIGN = ("svg", "math")
#: start tags that end an open one of these
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
TAGS = "html body div section article main p span h1 h2 h3 h4 h5 h6 ul ol li a nav aside header footer form table tr td th blockquote pre figure figcaption button label dl dt dd details summary address fieldset dialog menu center".split()
NAMES = (
    "ad ads adv advert advertisement advertising promo promotion sponsor sponsored banner nav navbar navigation menu breadcrumb breadcrumbs header masthead top footer foot bottom "
    "sidebar side aside widget rail related recommended more comment comments respond reply replies discussion disqus notice alert cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "signup login form search contact share sharing social content article post entry body main text story page container wrapper title headline byline author date meta tag tags copyright legal disclaimer terms "
    "pagination pager toolbar toc skip hidden links link list feedback user users contentinfo complementary"
).split()
KNOWN = {t: i for i, t in enumerate([*(f"<{t}>" for t in TAGS), *NAMES])}
OTHER, WORDS = 24, 32  # hashed places for other path tokens and for words
NUMBERS = 7
WIDTH = len(KNOWN) + OTHER + WORDS + NUMBERS

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


# ---------------------------------------------------------------- blocks


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path tokens, text, characters in links) of each block with text, in page order."""
    out, path, texts, links = [], [], [], 0  # path: (tag, tokens)
    hidden = None  # the element whose content is not text
    within: list[str] = []  # elements open inside the hidden one
    last_end: dict[str, int] = {}  # where each kind of unseen element is closed for the last time

    def closes_after(tag: str, at: int) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}[\s/>]", page, re.I)), default=-1)
        return last_end[tag] >= at

    def end_block():
        nonlocal texts, links
        text = " ".join("".join(texts).split())
        if text:
            out.append((tuple(t for _, own in path for t in own), text, links))
        texts, links = [], 0

    at, n = 0, len(page)
    while at < n:
        if hidden in RAW:
            m = re.compile(rf"</{hidden}\s*>", re.I).search(page, at)
            at, hidden = (m.end() if m else n), None
            continue
        m = _PIECE.search(page, at)
        stop = m.start() if m else n
        if stop > at and hidden is None:
            text = entities.unescape(page[at:stop])
            texts.append(text)
            if any(t == "a" for t, _ in path):
                links += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if hidden:
            if m[1]:
                if tag in within:
                    del within[len(within) - 1 - within[::-1].index(tag) :]
                    continue
                if tag == hidden:
                    hidden = None
                    continue
                if all(t != tag for t, _ in path):
                    continue
                hidden = None  # its parent ends, so it ends as well
            elif hidden in FOREIGN and tag in BREAKOUT and "foreignobject" not in within:
                hidden = None
            else:
                if tag not in VOID and not m[3].rstrip().endswith("/"):
                    within.append(tag)
                continue
        if m[1]:
            where = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] == tag), None)
            if tag not in INLINE:
                end_block()
            if where is not None and (tag not in INLINE or all(t in INLINE for t, _ in path[where:])):
                del path[where:]
            continue
        if tag in UNSEEN:
            # one that is never closed counts as empty, except those that end by their own tag alone or by others
            if tag != "head" and not m[3].rstrip().endswith("/") and (tag in RAW or tag in FOREIGN or closes_after(tag, at)):
                hidden, within = tag, []
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag not in INLINE:
            end_block()
            if path and any(t == "p" for t, _ in path):  # a block ends an open paragraph
                del path[next(i for i, (t, _) in enumerate(path) if t == "p") :]
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                near = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] in (tag, "ul", "ol", "table", "dl")), None)
                if near is not None and path[near][0] == tag:
                    del path[near:]
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        own = [f"<{tag}>"]
        for a in _NAMED.findall(m[3]) if m[3] else ():
            own += [t for t in _SPLIT.split("".join(a).lower()) if t]
        path.append((tag, own))
    end_block()
    return out


_paths: dict[tuple, np.ndarray] = {}
_words: dict[str, int] = {}


def features(found: list[tuple]) -> np.ndarray:
    """One row for each block: path tokens, hashed words, numbers."""
    x = np.zeros((len(found), WIDTH), np.float32)
    base = len(KNOWN) + OTHER
    if len(_paths) > 50_000:
        _paths.clear()
    if len(_words) > 200_000:
        _words.clear()
    for i, (path, text, links) in enumerate(found):
        at = _paths.get(path)
        if at is None:
            at = _paths[path] = np.array(sorted({KNOWN.get(t, len(KNOWN) + zlib.crc32(t.encode()) % OTHER) for t in path}), np.int64)
        x[i, at] = 1
        words = text.lower().split()
        for w in words:
            if w not in _words:
                _words[w] = zlib.crc32(w.encode()) % WORDS
        counts = np.bincount([_words[w] for w in words], minlength=WORDS)
        x[i, base : base + WORDS] = counts / max(1, len(words)) * 4
        size = len(text)
        x[i, base + WORDS :] = (
            np.log1p(len(words)) / 4,
            min(1.0, links / max(1, size)),
            min(1.0, 20 * (text.count(".") + text.count(",")) / max(1, size)),
            text[-1] in ".!?:;",
            i / len(found),
            i == 0,
            i == len(found) - 1,
        )
    return x


# ---------------------------------------------------------------- bidirectional LSTM (numpy)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"x{d}"] = draw.normal(0, 0.15, (WIDTH, 4 * HIDDEN)).astype(np.float32)
        w[f"h{d}"] = draw.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
        w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
    w["out"] = draw.normal(0, 0.15, 2 * HIDDEN).astype(np.float32)
    w["bias"] = np.zeros(1, np.float32)
    return w


def _run(w, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """States (pages, blocks, HIDDEN) of one direction; padded blocks leave the state as it is."""
    n, steps = x.shape[:2]
    gates_in = x @ w[f"x{d}"] + w[f"c{d}"]
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((n, steps, HIDDEN), np.float32)
    tape = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = gates_in[:, t] + h @ w[f"h{d}"]
        i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN :])
        new = f * c + i * g
        th = np.tanh(new)
        m = mask[:, t, None]
        if keep:
            tape.append((t, i, f, o, g, c, th, h, m))
        c = m * new + (1 - m) * c
        h = m * (o * th) + (1 - m) * h
        out[:, t] = h
    return out, tape


def _back(w, d: str, x, tape, d_out, grads):
    dh = np.zeros_like(tape[0][7])
    dc = np.zeros_like(dh)
    d_gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
    for t, i, f, o, g, c, th, h, m in reversed(tape):
        dh = dh + d_out[:, t]
        own = m * dh
        d_new = m * dc + own * o * (1 - th**2)
        a = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), own * th * o * (1 - o), d_new * i * (1 - g**2)], 1)
        d_gates[:, t] = a
        grads[f"h{d}"] += h.T @ a
        dh = (1 - m) * dh + a @ w[f"h{d}"].T
        dc = (1 - m) * dc + d_new * f
    flat = d_gates.reshape(-1, 4 * HIDDEN)
    grads[f"x{d}"] += x.reshape(-1, WIDTH).T @ flat
    grads[f"c{d}"] += flat.sum(0)


def _padded(pages: list[np.ndarray]):
    steps = max(len(p) for p in pages)
    x = np.zeros((len(pages), steps, WIDTH), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
    return x, mask


def scores(w, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
    """Score of each block (article above zero); pages of like length go together."""
    out: list = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        n = max(1, min(len(order), cells // longest))
        part, order = order[-n:], order[:-n]
        x, mask = _padded([pages[i] for i in part])
        both = np.concatenate([_run(w, d, x, mask, False)[0] for d in "fb"], 2)
        s = both @ w["out"] + w["bias"]
        for row, i in enumerate(part):
            out[i] = s[row, : len(pages[i])]
    return out


def train(pages: list[np.ndarray], labels: list[np.ndarray], seed: int = SEED, epochs: int = EPOCHS, rate: float = 0.01, size: int = 32) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy of all blocks."""
    w, draw, step = fresh(seed), np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for epoch in range(epochs):
        for part in np.array_split(draw.permutation(len(pages)), max(1, len(pages) // size)):
            x, mask = _padded([pages[i] for i in part])
            y = np.zeros(mask.shape, np.float32)
            for r, i in enumerate(part):
                y[r, : len(labels[i])] = labels[i]
            (hf, tf), (hb, tb) = (_run(w, d, x, mask, True) for d in "fb")
            p = _sigmoid(hf @ w["out"][:HIDDEN] + hb @ w["out"][HIDDEN:] + w["bias"])
            d = (p - y) * mask / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in w.items()}
            grads["out"] = np.concatenate([(h * d[..., None]).sum((0, 1)) for h in (hf, hb)]).astype(np.float32)
            grads["bias"][0] = d.sum()
            _back(w, "f", x, tf, d[..., None] * w["out"][:HIDDEN], grads)
            _back(w, "b", x, tb, d[..., None] * w["out"][HIDDEN:], grads)
            step += 1
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                w[k] = w[k] - rate * (0.5 if epoch >= epochs * 2 // 3 else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


# ---------------------------------------------------------------- layouts for training


def layout(draw: random.Random, texts: list[str], words: list[str]) -> str:
    """A page in a random layout; the blocks of the article end with the mark \x01."""
    few = lambda lo, hi: " ".join(draw.choice(words) for _ in range(draw.randint(lo, hi)))
    pick = draw.choice

    def wrap(kind: str, inner: str) -> str:
        """An element that its tag or one of its names tells from others."""
        tag, names = {
            "header": ("header", "header masthead site-header top-header page-header"),
            "nav": ("nav", "nav menu navbar main-menu breadcrumb navigation nav-links pagination"),
            "ad": ("aside", "ad ads advert advertisement ad-box sponsored promo banner-ad promotion sponsor"),
            "side": ("aside", "sidebar side widget related right-rail recommended side-box"),
            "notice": ("div", "notice cookie-notice alert cookie-consent gdpr popup modal notice-bar newsletter disclaimer"),
            "form": ("form", "form search-form login signup-form newsletter subscribe contact-form"),
            "comments": ("section", "comments comment-list discussion replies comment reader-comments user-comments respond"),
            "footer": ("footer", "footer site-footer foot copyright legal bottom page-footer"),
        }[kind]
        name = pick(names.split())
        how = draw.random()
        if how < 0.35 and tag not in ("div", "section", "aside"):
            return f"<{tag}>{inner}</{tag}>"
        box = tag if how < 0.6 else pick(["div", "div", "section", "ul" if "<li>" in inner else "div"])
        return f'<{box} {pick(["class", "class", "id"])}="{name}">{inner}</{box}>'

    def items(n: int) -> str:
        return "".join(f'<li><a href="/{few(1, 1)}">{few(1, 3)}</a></li>' for _ in range(n))

    def prose(mark: str, most: int = 60) -> str:
        text = pick(texts)
        cut = text.split()
        lo = draw.randint(0, max(0, len(cut) - 2))
        body = " ".join(cut[lo : lo + draw.randint(1, most)]) if draw.random() < 0.6 else text
        return entities.escape(body) + mark

    def other(kind: str) -> str:
        if kind in ("nav", "side"):
            inner = f"<ul>{items(draw.randint(2, 7))}</ul>" if draw.random() < 0.7 else " ".join(f'<a href="#">{few(1, 3)}</a>' for _ in range(draw.randint(2, 6)))
            inner = (f"<h3>{few(1, 4)}</h3>" if draw.random() < 0.4 else "") + inner + (f"<p>{prose('')}</p>" if draw.random() < 0.4 else "")
        elif kind == "form":
            inner = f"<label>{few(1, 3)}</label><input name=q><p>{few(2, 20)}</p><button>{few(1, 2)}</button>"
        elif kind == "comments":
            inner = (f"<h3>{few(1, 3)}</h3>" if draw.random() < 0.5 else "") + "".join(pick(['<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<li>{}</li>", "<div><b>x</b> {}</div>"]).format(prose("")) for _ in range(draw.randint(1, 6)))
        elif kind == "footer":
            inner = pick(["&copy; {} &middot; {}", "<p>{}</p><p>{}</p>", "{}<br>{}"]).format(few(1, 3), prose("", 12))
        elif kind == "header":
            inner = pick(["<h1>{}</h1>{}", "<a href=/>{}</a><p>{}</p>", "<div>{}</div><div>{}</div>"]).format(few(1, 4), few(1, 8))
        else:
            inner = pick(["{}", "<p>{}</p>", "<p>{}</p><a href=#>more</a>", "<div>{}</div>", "<h4>x</h4><p>{}</p>"]).format(prose("", 40))
        return wrap(kind, inner)

    def article() -> str:
        parts = []
        if draw.random() < 0.8:
            title = f"<h1>{few(2, 10)}\x01</h1>"
            parts.append(f"<header>{title}</header>" if draw.random() < 0.1 else title)
        for _ in range(draw.randint(1, 14)):
            how = draw.random()
            if how < 0.7:
                parts.append(pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p><span>{}</span></p>"]).format(prose("\x01")))
            elif how < 0.78:
                parts.append(f"<h2>{few(1, 6)}\x01</h2>")
            elif how < 0.86:
                parts.append("<ul>" + "".join(f"<li>{prose(chr(1), 15)}</li>" for _ in range(draw.randint(1, 5))) + "</ul>")
            elif how < 0.9:
                parts.append(f"<blockquote><p>{prose(chr(1))}</p></blockquote>")
            elif how < 0.93:
                parts.append(f"<pre>{prose(chr(1), 20)}</pre>")
            elif how < 0.95:
                parts.append(f"<table><tr><td>{few(1, 3)}\x01</td><td>{few(1, 3)}\x01</td></tr></table>")
            else:
                parts.append(other(pick(["ad", "side", "form", "notice"])))
        inner = "".join(parts)
        if draw.random() < 0.5:
            return f"<article>{inner}</article>"
        return pick(['<main>{}</main>', '<div class="content">{}</div>', '<div id="main">{}</div>', '<div class="post">{}</div>', '<div class="article-body">{}</div>', '<section class="story">{}</section>', '<div class="entry-content">{}</div>', "<div>{}</div>"]).format(inner)

    before = [k for k in ("header", "nav", "notice", "ad", "side", "form") if draw.random() < 0.4]
    after = [k for k in ("comments", "side", "ad", "form", "nav", "notice", "footer") if draw.random() < 0.4]
    draw.shuffle(before)
    body = "".join(map(other, before)) + (article() if draw.random() < 0.97 else "") + "".join(map(other, after))
    body = f'<div class="{pick(["page", "container", "wrapper", "x7"])}">{body}</div>' if draw.random() < 0.3 else body
    return f"<html><body>{body}</body></html>"


@functools.lru_cache(maxsize=4)
def fit(sample: tuple[str, ...], seed: int = SEED, layouts: int = LAYOUTS, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights from the texts of sample pages in random layouts."""
    texts = [t for page in sample for _, t, _ in blocks(page) if len(t.split()) >= 8]
    texts = texts or ["this text stands in for a sample without any text of its own."]
    words = sorted({w for t in texts for w in t.split()[:200]})
    draw = random.Random(seed)
    pages, labels = [], []
    for _ in range(layouts):
        found = blocks(layout(draw, texts, words).replace("&#1;", "\x01"))
        if found:
            labels.append(np.array(["\x01" in t for _, t, _ in found], np.float32))
            pages.append(features([(p, t.replace("\x01", "") or "x", n) for p, t, n in found]))
    return train(pages, labels, seed, epochs)


def sample_of(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", n: int = SAMPLE_PAGES) -> tuple[str, ...]:
    """The pages that training takes: at most ``n`` of at most ``SAMPLE_PAGE_BYTES``, by the hash of their id.

    First some 4 n keys below a threshold reach the driver (more rounds where copies are many), then just
    the ``n`` pages themselves: no more for a larger table."""
    html = F.col(f"`{html_col}`")
    rows = pages.select(F.xxhash64(f"`{id_col}`", f"`{html_col}`").alias("k"), html.alias("html")).where(F.octet_length("html") <= SAMPLE_PAGE_BYTES)
    total, share = rows.count(), 1.0
    keys: list[int] = []
    if total > 4 * n:
        share = 4 * n / total
    while total:
        below = rows if share >= 1 else rows.where(F.col("k") < int(-(2**63) + share * 2**64))
        keys = [r["k"] for r in below.select("k").distinct().orderBy("k").limit(n).collect()]
        if len(keys) == n or share >= 1:
            break
        share *= 8
    if not keys:
        return ()
    chosen = rows.where(F.col("k") <= keys[-1]).groupBy("k").agg(F.first("html").alias("html"))
    return tuple(r["html"] for r in sorted(chosen.collect()))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, weights: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = fit(sample_of(pages, id_col, html_col, sample_pages)) if weights is None else weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batch):
        found = [blocks(x or "") for x in batch.column("html").to_pylist()]
        texts = ["\n\n".join(b[1] for b, s in zip(bs, ss) if s > 0) for bs, ss in zip(found, scores(weights, [features(b) for b in found]))]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    small_batches(pages.sparkSession, 256)
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return rows.mapInArrow(arrow_map(run, schema), "page_id bigint, url string, text string, n_chars bigint")
