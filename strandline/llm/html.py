"""Main text of HTML pages by a recurrent labeller of blocks.

A tolerant scanner cuts a page into leaf blocks, each with its path of tags and class words. A
bidirectional LSTM in numpy reads a page's blocks in order, each as hashed vectors of its path, of
its words and of a few counts, and gives every block the chance that it is main text, so that a
block is judged by what stands around it too. It is trained by backpropagation through time on
two kinds of pages: a bounded sample of the pages at hand, labelled by what their tags and class
words say, and pages put together from the sample's blocks in other layouts, with class words
renamed or left out at random, so that it learns position and wording as well as names.

Defined cases: null or empty html, and a page without main text, give an empty text; tags that
aren't closed end with what holds them; a character reference that is cut short stays as it is;
repeated rows and ids each get a result; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_slice

#: Elements by their place in HTML: fixed values of the language.
#: Their content is text up to the end tag, whatever it holds.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Their content isn't text of the page; they nest, and without an end tag they are passed over alone.
APART = frozenset("noscript template svg math object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: A new one of these ends an open one of the second set.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table ul ol dl td th div article section main body aside nav header footer form blockquote figure".split())
#: Quotes hold a value only right after the equals sign; anywhere else they are letters like others.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
NAMING = frozenset({"class", "id", "role"})
WORDS = re.compile(r"[a-z]+")
#: Words in class, id and role that say what isn't main text, and what is.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget related footer foot header masthead topbar"
    " cookie cookies consent notice alert popup modal overlay subscribe newsletter signup login share sharing social comment comments respond reply discussion disqus tags pagination pager"
    " search form copyright legal toolbar skip contentinfo complementary".split()
)
INSIDE = frozenset("article content main body post entry story text prose".split())
OUTSIDE_TAGS = frozenset("nav header footer aside form button menu dialog fieldset head".split())

WIDTH, UNITS, VECTOR = 4096, 24, 16
#: Pages that train the labeller, and pages put together besides.
SAMPLE, COMPOSED = 300, 500
#: Blocks of a page read at once; a longer page is read in stretches, which bound memory and not what a
#: block's label sees.
STRETCH = 512
#: What a page teaches with: so many neighbouring blocks, from a place that its hash gives, and so many
#: characters of each. These bound the sample on the driver, not what is extracted.
TAUGHT, TAUGHT_CHARS = 256, 1_000


class Block(NamedTuple):
    path: tuple[str, ...]  # tags from the outside in, then "." and class words after each
    text: str
    links: int  # characters inside links


@lru_cache(maxsize=64)
def end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE)


@lru_cache(maxsize=64)
def any_tag(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)>", re.IGNORECASE)


def element_ends(page: str, name: str) -> dict[int, int]:
    """Where each element of that name ends, by the end of its first tag; those never closed aren't there."""
    opened, ends = [], {}
    for tag in any_tag(name).finditer(page):
        if tag[1]:
            if opened:
                ends[opened.pop()] = tag.end()
        elif not tag[2].endswith("/"):
            opened.append(tag.end())
    return ends


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: white space is one space, ends are trimmed, none is empty."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    in_link, links, at = 0, 0, 0
    apart: dict[str, dict[int, int]] = {}
    without_end: set[str] = set()

    def close_block():
        nonlocal links
        text = " ".join("".join(held).split())
        if text:
            found.append(Block(tuple(x for tag, names in stack for x in (tag, *names)), text, links))
        held.clear()
        links = 0

    def pop_to(index: int):
        close_block()
        del stack[index:]

    while at < len(page):
        start = page.find("<", at)
        match = TAG.match(page, start) if start >= 0 else None
        if match is None:
            stop = len(page) if start < 0 else start + 1
            piece = references.unescape(page[at:stop])
            held.append(piece)
            links += len(piece) if in_link else 0
            at = stop
            continue
        if start > at:
            piece = references.unescape(page[at:start])
            held.append(piece)
            links += len(piece) if in_link else 0
        at = match.end()
        name = match[1]
        if name is None:
            continue
        name, closing = name.lower(), page[start + 1] == "/"
        if name == "br":
            held.append(" ")
        if name in VOID:
            if name == "hr":
                close_block()
            continue
        if name in RAW and not closing:
            end = end_tag(name).search(page, at) if name not in without_end else None
            if end is None:
                without_end.add(name)
            # An unfinished script shows nothing; one closed in its own tag shows what follows.
            at = end.end() if end else at if match[2].endswith("/") else len(page)
            continue
        if name in APART:
            if not closing and not match[2].endswith("/"):
                if name not in apart:
                    apart[name] = element_ends(page, name)
                at = apart[name].get(at, at)
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        in_link = 0
        if closing:
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if index is None:
                close_block()
            else:
                pop_to(index)
            continue
        close_block()
        ends = CLOSES.get(name, PARAGRAPH)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                pop_to(i)
                break
            if stack[i][0] in SCOPES:
                break
        names = []
        for kind, *values in ATTRIBUTE.findall(match[2] or ""):
            if kind.lower() in NAMING:
                names += dict.fromkeys(f".{w}" for w in WORDS.findall("".join(values).lower()))
        stack.append((name, tuple(names)))
    close_block()
    return found


def teacher(block: Block) -> float:
    """What the path's tags and class words say: 1 main text, 0 not, from the inside out."""
    for step in reversed(block.path):
        if step[0] == ".":
            if step[1:] in OUTSIDE:
                return 0.0
            if step[1:] in INSIDE:
                return 1.0
        elif step in OUTSIDE_TAGS:
            return 0.0
        elif step in ("article", "main"):
            return 1.0
    dense = len(block.text) > 60 and block.links < 0.3 * len(block.text) and block.path[-1:] != ("li",)
    return 1.0 if dense else 0.0


def slot(kind: str, what: str) -> int:
    return zlib.crc32(f"{kind} {what}".encode("utf-8", "surrogatepass")) % WIDTH


class Hashed(NamedTuple):
    path: list[np.ndarray]  # slots of each block's path
    word: list[np.ndarray]  # slots of each block's words
    dense: np.ndarray  # blocks x 5


def hashed(page: list[Block], known: dict) -> Hashed:
    path, word, dense = [], [], np.zeros((len(page), 5), np.float32)
    for i, block in enumerate(page):
        slots = known.get(block.path)
        if slots is None:
            slots = np.array([slot("path", s) for s in block.path] + [slot("last", block.path[-1] if block.path else "")], np.int64)
            if len(known) < 50_000:
                known[block.path] = slots
        path.append(slots)
        words = block.text.lower().split()
        word.append(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WIDTH for w in words], np.int64))
        n = len(block.text)
        ends = sum(map(block.text.count, ".!?"))
        dense[i] = np.log1p(n) / 8, block.links / n, min(1.0, 4 * ends / len(words)), len(words) < 5, block.text[-1] in ".!?…。:;\"”"
    return Hashed(path, word, dense)


class Labeller(NamedTuple):
    path: np.ndarray  # WIDTH x V
    word: np.ndarray
    enter: np.ndarray  # 2 x (2V + 5) x 4H
    again: np.ndarray  # 2 x H x 4H
    shift: np.ndarray  # 2 x 4H
    out: np.ndarray  # 2H
    bias: np.ndarray  # 1


def fresh(seed: int) -> Labeller:
    draw = np.random.default_rng(seed)
    normal = lambda scale, *shape: (scale * draw.standard_normal(shape)).astype(np.float32)
    shift = np.zeros((2, 4 * UNITS), np.float32)
    shift[:, UNITS : 2 * UNITS] = 1  # remember at first
    return Labeller(normal(0.3, WIDTH, VECTOR), normal(0.05, WIDTH, VECTOR), normal(0.2, 2, 2 * VECTOR + 5, 4 * UNITS), normal(0.15, 2, UNITS, 4 * UNITS), shift, normal(0.2, 2 * UNITS), np.zeros(1, np.float32))


def means(table: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    lengths = np.array([len(s) for s in slots])
    if not lengths.sum():
        return np.zeros((len(slots), table.shape[1]), np.float32)
    flat = np.concatenate(slots)
    sums = np.zeros((len(slots), table.shape[1]), np.float32)
    full = np.flatnonzero(lengths)
    sums[full] = np.add.reduceat(table[flat], np.r_[0, np.cumsum(lengths[full])[:-1]], axis=0)
    return sums / np.maximum(1, lengths)[:, None]


def inputs(net: Labeller, pages: list[Hashed]) -> tuple[np.ndarray, np.ndarray]:
    """T x B x inputs, padded with zeros, and the mask of what is real."""
    longest = max(len(p.path) for p in pages)
    x = np.zeros((longest, len(pages), 2 * VECTOR + 5), np.float32)
    real = np.zeros((longest, len(pages)), bool)
    lengths = [len(p.path) for p in pages]
    rows = np.concatenate([means(net.path, [s for p in pages for s in p.path]), means(net.word, [s for p in pages for s in p.word]), np.concatenate([p.dense for p in pages])], 1)
    at = 0
    for b, n in enumerate(lengths):
        x[:n, b] = rows[at : at + n]
        real[:n, b] = True
        at += n
    return x, real


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def run_lstm(net: Labeller, side: int, x: np.ndarray, real: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None):
    """Hidden states and what backpropagation needs, in the direction's own order; padding keeps the state.

    ``state`` holds h and c where a run goes on from another.
    """
    steps, lanes, _ = x.shape
    h, c = np.zeros((steps + 1, lanes, UNITS), np.float32), np.zeros((steps + 1, lanes, UNITS), np.float32)
    if state:
        h[0], c[0] = state
    gates = np.empty((steps, lanes, 4 * UNITS), np.float32)
    before = x @ net.enter[side] + net.shift[side]
    for t in range(steps):
        z = before[t] + h[t] @ net.again[side]
        z[:, : 3 * UNITS] = sigmoid(z[:, : 3 * UNITS])
        z[:, 3 * UNITS :] = np.tanh(z[:, 3 * UNITS :])
        i, f, o, g = np.split(z, 4, axis=1)
        live = real[t][:, None]
        c[t + 1] = np.where(live, f * c[t] + i * g, c[t])
        h[t + 1] = np.where(live, o * np.tanh(c[t + 1]), h[t])
        gates[t] = z
    return h, c, gates


def chances(net: Labeller, pages: list[Hashed]) -> list[np.ndarray]:
    """Each block's chance to be main text."""
    x, real = inputs(net, pages)
    ahead = run_lstm(net, 0, x, real)[0][1:]
    back = run_lstm(net, 1, x[::-1], real[::-1])[0][1:][::-1]
    p = sigmoid(ahead @ net.out[:UNITS] + back @ net.out[UNITS:] + net.bias[0])
    return [p[: len(page.path), b] for b, page in enumerate(pages)]


def gradient(net: Labeller, pages: list[Hashed], labels: list[np.ndarray]) -> tuple[float, Labeller]:
    x, real = inputs(net, pages)
    y = np.zeros(real.shape, np.float32)
    for b, some in enumerate(labels):
        y[: len(some), b] = some
    runs = [run_lstm(net, 0, x, real), run_lstm(net, 1, x[::-1], real[::-1])]
    after = [runs[0][0][1:], runs[1][0][1:][::-1]]
    p = sigmoid(after[0] @ net.out[:UNITS] + after[1] @ net.out[UNITS:] + net.bias[0])
    count = real.sum()
    loss = float(-(np.log(np.where(y > 0.5, p, 1 - p) + 1e-9) * real).sum() / count)
    error = (p - y) * real / count
    grads = Labeller(*[np.zeros_like(w) for w in net])
    grads.bias[0] = error.sum()
    d_x = np.zeros_like(x)
    for side in range(2):
        h, c, gates = runs[side]
        mine = slice(side * UNITS, (side + 1) * UNITS)
        grads.out[mine] = np.tensordot(error, after[side], ((0, 1), (0, 1)))
        arriving = error[:, :, None] * net.out[mine]
        own_x, own_real = (x, real) if side == 0 else (x[::-1], real[::-1])
        arriving = arriving if side == 0 else arriving[::-1]
        d_h, d_c = np.zeros_like(h[0]), np.zeros_like(c[0])
        d_z = np.zeros_like(gates)
        for t in range(len(x) - 1, -1, -1):
            live = own_real[t][:, None]
            i, f, o, g = np.split(gates[t], 4, axis=1)
            total = d_h + arriving[t]
            squashed = np.tanh(c[t + 1])
            at_c = np.where(live, d_c + total * o * (1 - squashed**2), d_c)
            z = np.concatenate([at_c * g * i * (1 - i), at_c * c[t] * f * (1 - f), total * squashed * o * (1 - o), at_c * i * (1 - g**2)], 1)
            d_z[t] = np.where(live, z, 0)
            d_h = np.where(live, d_z[t] @ net.again[side].T, total)
            d_c = np.where(live, at_c * f, d_c)
        grads.enter[side] = np.tensordot(own_x, d_z, ((0, 1), (0, 1)))
        grads.again[side] = np.tensordot(h[:-1], d_z, ((0, 1), (0, 1)))
        grads.shift[side] = d_z.sum((0, 1))
        back = d_z @ net.enter[side].T
        d_x += back if side == 0 else back[::-1]
    for b, page in enumerate(pages):
        for table, slots, where in ((grads.path, page.path, slice(0, VECTOR)), (grads.word, page.word, slice(VECTOR, 2 * VECTOR))):
            lengths = np.array([len(s) for s in slots])
            if lengths.sum():
                share = d_x[: len(slots), b, where] / np.maximum(1, lengths)[:, None]
                np.add.at(table, np.concatenate(slots), np.repeat(share, lengths, axis=0))
    return loss, grads


def train(pages: list[list[Block]], labels: list[np.ndarray], seed: int = 5, rounds: int = 6, lanes: int = 16, rate: float = 0.02) -> Labeller:
    draw = np.random.default_rng(seed)
    net, known = fresh(seed), {}
    ready = [hashed(page, known) for page in pages]
    m, v = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    step, total = 0, rounds * -(-len(ready) // lanes)
    for _ in range(rounds):
        order = draw.permutation(len(ready))
        for at in range(0, len(order), lanes):
            some = order[at : at + lanes]
            _, grads = gradient(net, [ready[i] for i in some], [labels[i] for i in some])
            step += 1
            for w, g, a, b in zip(net, grads, m, v):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                w -= rate * (1 - step / (total + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-5)
    return net


def composed(draw: np.random.Generator, main: list[str], other: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page in a layout of its own from texts of main blocks and of others."""
    # Generator.choice would copy the whole list into an array as wide as its longest text.
    word = lambda names: names[int(draw.integers(len(names)))]
    shell = ("html", "body") + (("div", f".{word(['page', 'wrapper', 'container', 'site'])}") if draw.random() < 0.5 else ())
    page: list[tuple[Block, float]] = []

    def section(kind: str, names: list[str], tags: list[str], count: int, linked: float, item: list[str]):
        tag = word(tags) if draw.random() < 0.6 else "div"
        label = (f".{word(names)}",) if draw.random() < (0.75 if tag == "div" else 0.4) else ()
        for _ in range(count):
            text = word(other)
            if draw.random() < 0.6:
                text = " ".join(text.split()[: draw.integers(1, 9)])
            path = (*shell, tag, *label, *word(item).split())
            page.append((Block(path, text, len(text) if draw.random() < linked else 0), 0.0))

    def body():
        tag, label = word(["article", "main", "div", "div", "section"]), ()
        if tag in ("div", "section") and draw.random() < 0.7 or draw.random() < 0.2:
            label = (f".{word(sorted(INSIDE))}",)
        inner = (*shell, tag, *label)
        if draw.random() < 0.7:
            page.append((Block((*inner, word(["h1", "h2"])), " ".join(word(main).split()[:8]), 0), 1.0))
        for _ in range(draw.integers(1, 16)):
            text = word(main)
            page.append((Block((*inner, word(["p", "p", "p", "p", "h2", "h3", "ul li", "blockquote"]).split()[-1]), text, int(draw.random() < 0.1) * min(10, len(text))), 1.0))
            if draw.random() < 0.06:
                page.append((Block((*inner, "div", f".{word(['ad', 'promo', 'share', 'related', 'newsletter'])}"), word(other), 0), 0.0))

    menu = lambda: section("nav", ["nav", "menu", "navbar", "topbar", "breadcrumb"], ["nav", "header", "div"], draw.integers(2, 10), 0.95, ["ul li", "ul li", "li", "div"])
    if draw.random() < 0.5:
        section("cookie", ["cookie", "consent", "notice", "banner", "alert"], ["div", "aside", "dialog"], draw.integers(1, 3), 0.2, ["p", "div", "button"])
    if draw.random() < 0.85:
        menu()
    if draw.random() < 0.5:
        section("ad", ["ad", "ads", "advert", "sponsored", "promo"], ["div", "aside"], draw.integers(1, 3), 0.4, ["div", "p"])
    if draw.random() < 0.3:
        section("side", ["sidebar", "widget", "related"], ["aside", "div"], draw.integers(2, 9), 0.7, ["ul li", "p", "div"])
    if draw.random() < 0.97:
        body()
    if draw.random() < 0.35:
        section("comments", ["comment", "comments", "discussion", "respond"], ["section", "div"], draw.integers(1, 8), 0.1, ["p", "div", "li"])
    if draw.random() < 0.3:
        section("side", ["sidebar", "widget", "related", "recommended"], ["aside", "div"], draw.integers(2, 9), 0.7, ["ul li", "p", "div"])
    if draw.random() < 0.25:
        section("form", ["form", "newsletter", "subscribe", "login"], ["form", "div"], draw.integers(1, 4), 0.1, ["p", "div", "button"])
    if draw.random() < 0.9:
        section("footer", ["footer", "copyright", "legal"], ["footer", "div"], draw.integers(1, 5), 0.4, ["p", "div", "ul li"])
    return [b for b, _ in page], np.array([y for _, y in page], np.float32)


def teaching_blocks(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(place, blocks) of about ``sample`` to twice as many pages(page_id, html): neighbouring blocks with their labels."""
    chance = min(1.0, 2 * sample / max(1, pages.count()))
    place = F.xxhash64(F.col("page_id").cast("long"), F.col("html").cast("string"))
    rows = pages.select(F.col("html").cast("string").alias("html"), place.alias("place")).where(F.col("html").isNotNull())
    kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("text", pa.string()), ("links", pa.int32()), ("label", pa.float32())]))
    schema = pa.schema([("place", pa.int64()), ("blocks", kind)])

    def run(batch):
        out = []
        for html, key in zip(batch["html"].to_pylist(), batch["place"].to_pylist()):
            found = blocks(html)
            at = key % max(1, len(found) - TAUGHT + 1)
            out.append([
                {"path": b.path, "text": b.text[:TAUGHT_CHARS], "links": min(b.links, TAUGHT_CHARS), "label": teacher(b)} for b in found[at : at + TAUGHT]
            ])
        return {"place": batch["place"], "blocks": out}

    # By hash first: else every task would send a whole sample of pages to the driver.
    some = rows.where(F.pmod("place", F.lit(1_000_000)) < int(1_000_000 * chance) + 1)
    return some.mapInArrow(per_slice(run, schema, 16), "place long, blocks array<struct<path:array<string>,text:string,links:int,label:float>>").where(F.size("blocks") > 0)


def fit(pages: DataFrame, sample: int = SAMPLE, extra: int = COMPOSED, seed: int = 5) -> Labeller | None:
    """Train on at most ``sample`` pages(page_id, html), by hash, of any length; None where no page has a block."""
    found = teaching_blocks(pages, sample).orderBy("place", F.to_json("blocks")).limit(sample).collect()
    if not found:
        # A sample by hash can miss the few pages that have a block.
        found = teaching_blocks(pages, 1 << 62).orderBy("place", F.to_json("blocks")).limit(sample).collect()
    if not found:
        return None
    cut = [[Block(tuple(b["path"]), b["text"], b["links"]) for b in r["blocks"]] for r in found]
    labels = [np.array([b["label"] for b in r["blocks"]], np.float32) for r in found]
    main = [b.text for some, y in zip(cut, labels) for b, k in zip(some, y) if k] or ["text"]
    other = [b.text for some, y in zip(cut, labels) for b, k in zip(some, y) if not k] or ["menu"]
    # Comments and notices look like prose: half of what isn't main text is taken from it.
    draw = np.random.default_rng(seed)
    prose = [main[int(draw.integers(len(main)))] for _ in range(len(other))]
    made = [composed(draw, main, other + prose) for _ in range(extra)]
    made = [(p, y) for p, y in made if p]
    return train(cut + [p for p, _ in made], labels + [y for _, y in made], seed)


def label_blocks(net: Labeller, page: list[Block], known: dict) -> np.ndarray:
    """Chances of all blocks of a page; both directions go on from stretch to stretch of a long one."""
    parts = [inputs(net, [hashed(page[at : at + STRETCH], known)]) for at in range(0, len(page), STRETCH)]
    z = np.full(len(page), net.bias[0])
    for side in range(2):
        state, own = None, slice(side * UNITS, (side + 1) * UNITS)
        for k in range(len(parts)) if side == 0 else reversed(range(len(parts))):
            turn = slice(None, None, -1 if side else 1)
            h, c, _ = run_lstm(net, side, parts[k][0][turn], parts[k][1][turn], state)
            state = h[-1], c[-1]
            z[k * STRETCH : (k + 1) * STRETCH] += (h[1:, 0] @ net.out[own])[turn]
    return sigmoid(z)


def main_texts(net: Labeller | None, htmls: list[str | None], known: dict) -> list[str]:
    pages = [blocks(h) for h in htmls]
    out = [""] * len(pages)
    if net is None:
        return out
    short = sorted((i for i, p in enumerate(pages) if p and len(p) <= STRETCH), key=lambda i: len(pages[i]))
    labelled = {i: label_blocks(net, p, known) for i, p in enumerate(pages) if len(p) > STRETCH}
    for at in range(0, len(short), 64):
        some = short[at : at + 64]
        labelled |= zip(some, chances(net, [hashed(pages[i], known) for i in some]))
    for i, p in labelled.items():
        out[i] = "\n".join(b.text for b, k in zip(pages[i], p) if k > 0.5)
    return out


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html)."""
    net = net if net is not None else fit(pages)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    known: dict = {}

    def run(batch):
        found = main_texts(net, batch["html"].to_pylist(), known)
        return {"page_id": batch["page_id"], "url": batch["url"], "text": found, "n_chars": list(map(len, found))}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(per_slice(run, schema), "page_id long, url string, text string, n_chars long")
