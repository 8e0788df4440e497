"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: stretches of text between
block-level tags. Each block has features of its ancestors (tags, and the words
of their class, id and role) and of its text (length, share inside links,
sentence marks, words of short blocks). The field gives each block the label
main or other; neighbours hold together through its transitions. It is trained
on labelled pages by the gradient of the log-likelihood (forward-backward) and
decoded by Viterbi.
"""

from __future__ import annotations

import html
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cadastra.llm.arrow import map_rows
from cadastra.session import stage

#: Pages, and the longest of them, that the field is trained on.
TRAINING_PAGES = 300
TRAINING_CHARS = 100_000
EPOCHS = 12
RATE = 0.3

# Fixed values of HTML: elements that end when they begin, whose text is no text of the page, and that go on inside a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template textarea select title svg iframe object canvas button head".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr img".split())
#: Elements that an element ends although they weren't closed, up to the nearest container.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"},
        "option": {"option"}}
#: Any other block-level element ends an open paragraph.
CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

#: Silent elements whose content holds no tags: only their own end tag ends them.
RAW = frozenset("script style noscript textarea title iframe".split())

#: A quote delimits only where a value begins, right after "=".
_ATTRIBUTES = r"(?:[^>=]++|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*|(?=>|\Z)))*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(>|\Z)", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*|'[^']*|[^\s\"'>]+)", re.I)
_LETTERS = re.compile(r"[a-z]+")
#: Names that say what an element lacks or how it looks, as in "no-sidebar".
_ABOUT = re.compile(r"(?:no|not|non|has|have|with|without|is|hide|hidden)(?![a-z])")
#: Elements that hold the whole page: their names say nothing about its parts.
WHOLE = frozenset({"html", "body"})
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """Text of a leaf block, white space already single, and what it stands in."""

    text: str
    path: tuple[str, ...]  # features of the ancestors, outermost first
    link_chars: int


def _names(attributes: str) -> set[str]:
    """Words of an element's class, id and role; names such as "no-sidebar" are left out."""
    tokens = (t for n in _NAMED.finditer(attributes) for t in n[2].lower().strip("\"'").split())
    return {w for t in tokens if not _ABOUT.match(t) for w in _LETTERS.findall(t)}


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Character references are decoded; a tag that the page breaks off in is left out."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []  # open elements that aren't inline, with their features
    inline: list[str] = []
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, open_[-1][1] if open_ else (), linked))
            parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        close_block()
        del open_[depth:]
        inline.clear()

    def behind(m: re.Match[str]) -> int:
        """Where reading goes on behind the start tag of an element without tags inside: at its end tag, or nowhere."""
        end = _RAW_END[m[2].lower()].search(page, m.end())
        return end.start() if end else len(page)

    at, silent, next_ = 0, "", 0
    while m := _TOKEN.search(page, next_):
        next_ = m.end()
        if silent:
            if m[1] and m[2].lower() == silent:
                silent, at = "", m.end()
            elif not m[1] and m[2] and m[2].lower() in RAW and silent != "svg" and not m[3].rstrip().endswith("/"):
                next_ = behind(m)  # inside svg these are elements as any other
            continue
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            parts.append(text)
            if "a" in inline:
                linked += len(text)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if tag in inline:
                    inline.remove(tag)
            else:
                for depth in range(len(open_) - 1, -1, -1):
                    if open_[depth][0] == tag:
                        leave(depth)
                        break
                else:
                    close_block()
        elif tag in SILENT:
            if tag != "head":  # what may stand in a head is silent itself, and its end tag is often left out
                close_block()
                if not m[3].rstrip().endswith("/"):
                    silent = tag
                    if tag in RAW:
                        next_ = behind(m)
        elif tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag not in VOID:
                inline.append(tag)
        else:
            close_block()
            inline.clear()
            ended = ENDS.get(tag, {"p"} if tag in CLOSERS else set())
            while open_ and open_[-1][0] in ended:
                open_.pop()
            if tag not in VOID:
                named = _names(m[3]) if m[3] and tag not in WHOLE else ()
                path = open_[-1][1] if open_ else ()
                open_.append((tag, (*path, f"in:{tag}", *sorted(f"as:{w}" for w in named))))
    if not silent and at < len(page):
        parts.append(html.unescape(page[at:]))
    close_block()
    return out


def block_features(block: Block) -> list[str]:
    """Names of the features a block has."""
    text = block.text
    words = text.split(" ")
    n = len(words)
    nearest = next((p for p in reversed(block.path) if p.startswith("in:")), "in:")
    linked = min(4, 4 * block.link_chars // max(1, len(text)))
    marks = sum(w.endswith((".", "!", "?")) for w in words[:50])
    out = [*set(block.path), f"is:{nearest[3:]}", f"words:{min(8, n.bit_length())}", f"links:{linked}", f"marks:{min(3, marks)}"]
    if "©" in text:
        out.append("sign")
    if n <= 12:
        out += {f"w:{w.lower().strip('.,:;!?')}" for w in words}
    return out


class ChainField:
    """Binary linear-chain CRF: weights of features for the label main, and a 2 x 2 table of transitions."""

    def __init__(self, weights: dict[str, float], transitions: Sequence[float] = (0.0, 0.0, 0.0, 0.0)):
        self.weights = weights
        self.transitions = list(transitions)  # from 0 to 0, 0 to 1, 1 to 0, 1 to 1

    def emissions(self, sequence: Sequence[Sequence[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in features) for features in sequence]

    def viterbi(self, emissions: Sequence[float]) -> list[int]:
        """The likeliest labels; of equally likely ones, other."""
        if not emissions:
            return []
        t00, t01, t10, t11 = self.transitions
        s0, s1 = 0.0, emissions[0]
        back: list[tuple[int, int]] = []
        for e in emissions[1:]:
            from0, from1 = (1 if s1 + t10 > s0 + t00 else 0), (1 if s1 + t11 > s0 + t01 else 0)
            s0, s1 = (s1 + t10 if from0 else s0 + t00), (s1 + t11 if from1 else s0 + t01) + e
            back.append((from0, from1))
        label = 1 if s1 > s0 else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def marginals(self, emissions: Sequence[float]) -> tuple[list[float], list[float]]:
        """Probability of main for each block, and the expected number of each transition."""
        t = self.transitions
        forward = [(0.0, emissions[0])]
        for e in emissions[1:]:
            a, b = forward[-1]
            forward.append((_log_add(a + t[0], b + t[2]), _log_add(a + t[1], b + t[3]) + e))
        backward = [(0.0, 0.0)]
        for e in reversed(emissions[1:]):
            a, b = backward[-1]
            backward.append((_log_add(t[0] + a, t[1] + e + b), _log_add(t[2] + a, t[3] + e + b)))
        backward.reverse()
        whole = _log_add(*forward[-1])
        main = [math.exp(f[1] + b[1] - whole) for f, b in zip(forward, backward)]
        counts = [0.0] * 4
        for f, b, e in zip(forward, backward[1:], emissions[1:]):
            for i in range(4):
                counts[i] += math.exp(f[i >> 1] + t[i] + (e if i & 1 else 0.0) + b[i & 1] - whole)
        return main, counts

    @classmethod
    def train(cls, pages: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], seed: int = 2) -> ChainField:
        """AdaGrad ascent on the log-likelihood; features of fewer than two pages are left out."""
        seen = Counter(f for sequence, _ in pages for f in {f for features in sequence for f in features})
        field = cls({f: 0.0 for f, n in seen.items() if n > 1})
        squares = {f: 1.0 for f in field.weights}
        transition_squares = [1.0] * 4
        order = random.Random(seed)
        at = list(range(len(pages)))
        for _ in range(EPOCHS):
            order.shuffle(at)
            for p in at:
                sequence, labels = pages[p]
                if not sequence:
                    continue
                main, expected = field.marginals(field.emissions(sequence))
                slope: dict[str, float] = {}
                for features, label, q in zip(sequence, labels, main):
                    if abs(label - q) > 1e-4:
                        for f in features:
                            if f in squares:
                                slope[f] = slope.get(f, 0.0) + label - q
                for f, g in slope.items():
                    squares[f] += g * g
                    field.weights[f] += RATE * g / math.sqrt(squares[f])
                real = [0] * 4
                for a, b in zip(labels, labels[1:]):
                    real[2 * a + b] += 1
                for i in range(4):
                    g = real[i] - expected[i]
                    transition_squares[i] += g * g
                    field.transitions[i] += RATE * g / math.sqrt(transition_squares[i])
        return field


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


#: What labelled pages call main text: inside one of these, outside all of those.
MAIN = frozenset({"in:article", "in:main"})
OTHER = frozenset(
    {"in:nav", "in:header", "in:footer", "in:aside", "in:form", "in:menu", "in:dialog"}
    | {f"as:{w}" for w in "ad ads advert promo banner sidebar menu nav cookie notice consent comment comments reply related share social subscribe newsletter breadcrumb".split()}
)


def page_labels(blocks: Sequence[Block]) -> list[int]:
    """Labels of a page that marks its parts by elements and plain class names."""
    return [int(not MAIN.isdisjoint(b.path) and OTHER.isdisjoint(b.path)) for b in blocks]


#: What a main block may stand in, and those of them that often hold a few words only.
INSIDE = ("in:ul in:li", "in:ol in:li", "in:ul in:li in:p", "in:ul in:li in:ul in:li", "in:table in:tr in:td", "in:table in:tbody in:tr in:td", "in:table in:thead in:tr in:th", "in:blockquote",
          "in:blockquote in:p", "in:pre", "in:dl in:dt", "in:dl in:dd", "in:figure in:figcaption", "in:h1", "in:h2", "in:h3", "in:h4", "in:section in:p", "in:div", "in:details in:summary")
SHORT = frozenset("in:li in:td in:th in:dt in:h1 in:h2 in:h3 in:h4 in:figcaption in:summary".split())


def rebuilt(blocks: Sequence[Block], labels: Sequence[int], strange: Sequence[str], draw: random.Random) -> tuple[list[Block], list[int]]:
    """A labelled page in another layout: the main blocks in another container, other parts around and inside it.

    ``strange`` has texts of other pages; they fill the added parts, comments
    among them, so that it is not the wording that gives a part away.
    """
    containers = ["in:article", "in:main", "in:div as:content", "in:div as:post as:body", "in:div as:entry as:content", "in:section as:article", "in:div as:story",
                  "in:main in:div as:content", "in:div as:main", "in:td as:content"]
    container = [p for name in draw.sample(containers, draw.randint(1, 2)) for p in name.split()]
    parts = {
        "in:nav": "li", "in:header": "p", "in:header in:nav": "li", "in:footer": "p", "in:div as:footer": "p", "in:aside": "p", "in:aside as:sidebar": "li",
        "in:div as:sidebar": "p", "in:div as:ad": "div", "in:div as:advert": "p", "in:div as:ads as:banner": "div", "in:div as:cookie as:notice": "p",
        "in:div as:notice": "p", "in:div as:consent as:banner": "p", "in:form": "p", "in:form as:newsletter as:subscribe": "div", "in:form as:search": "div",
        "in:div as:menu": "li", "in:div as:header": "p", "in:section as:comments": "p", "in:div as:comments in:div as:comment": "p", "in:section as:comments in:article": "p",
        "in:ol as:comment as:list in:li": "p", "in:div as:related": "li", "in:div as:share as:social": "li", "in:div as:breadcrumb": "li", "in:div as:promo": "p",
    }
    inner = ["in:div as:ad", "in:aside", "in:div as:share as:social", "in:form as:newsletter as:subscribe", "in:div as:comments in:div as:comment", "in:div as:related", "in:div as:notice"]

    def part(name: str, inside: Sequence[str] = ()) -> list[Block]:
        usual = parts.get(name, "p")
        made = []
        for _ in range(draw.randint(1, 4)):
            leaf = (f"in:{usual}" if draw.random() < 0.6 else draw.choice(INSIDE)).split()
            text, linked = draw.choice(strange), 0
            if usual == "li" or leaf[-1] in SHORT:
                text = " ".join(text.split()[: draw.randint(1, 3 if usual == "li" else 9)])
                linked = len(text) if usual == "li" or draw.random() < 0.3 else 0
            made.append(Block(text, ("in:html", "in:body", *inside, *name.split(), *leaf), linked))
        return [b for b in made if b.text]

    out: list[tuple[Block, int]] = []
    for name in draw.sample(sorted(parts), draw.randint(1, 5)):
        out += [(b, 0) for b in part(name)]
    # Runs of main blocks become lists, tables, quotes and the like; a list has short items as well.
    inside, going = (), 0
    main = [b for b, label in zip(blocks, labels) if label]
    for i, block in enumerate(main):
        leaf = next((p for p in reversed(block.path) if p.startswith("in:")), "in:p")
        if not going:
            inside, going = (draw.choice(INSIDE).split(), draw.randint(1, 4)) if draw.random() < 0.4 else ((leaf,), 1)
        going -= 1
        text, linked = block.text, block.link_chars
        if inside[-1] in SHORT and draw.random() < 0.6:
            text = " ".join(text.split(" ")[: draw.randint(1, 9)])
            linked = len(text) if draw.random() < 0.1 else min(linked, len(text))
        out.append((Block(text, ("in:html", "in:body", *container, *inside), linked), 1))
        if i and draw.random() < 0.3:
            out += [(b, 0) for b in part(draw.choice(inner), container)]
    for name in draw.sample(sorted(parts), draw.randint(1, 5)):
        out += [(b, 0) for b in part(name)]
    return [b for b, _ in out], [label for _, label in out]


def train_field(pages: Sequence[str], seed: int = 4) -> ChainField:
    """From pages that ``page_labels`` can label, each as it is and once rebuilt."""
    draw = random.Random(seed)
    read = [leaf_blocks(p) for p in pages]
    labelled = [(blocks, page_labels(blocks)) for blocks in read if blocks]
    labelled = [(b, y) for b, y in labelled if any(y)]
    if not labelled:
        return ChainField({**{f: 4.0 for f in MAIN}, **{f: -8.0 for f in OTHER}}, (0.5, -0.5, -0.5, 0.5))
    strange = [b.text for blocks, _ in labelled for b in blocks]
    made = labelled + [rebuilt(b, y, strange, draw) for b, y in labelled]
    return ChainField.train([([block_features(b) for b in blocks], y) for blocks, y in made])


def fit_on(pages: DataFrame, id_col: str, html_col: str, rows: int = TRAINING_PAGES) -> ChainField:
    """Field trained in one task on at most ``rows`` different pages of at most ``TRAINING_CHARS`` characters, the first by a hash of their text."""
    usable = pages.select(pages[f"`{html_col}`"].alias("html")).where(F.col("html").isNotNull() & (F.length("html") <= TRAINING_CHARS))
    drawn = usable.withColumn("draw", F.xxhash64("html"))
    first = stage(drawn.select("draw").distinct().orderBy("draw").limit(rows))
    sample = drawn.join(F.broadcast(first), "draw", "left_semi").groupBy("draw").agg(F.min("html").alias("html"))  # copies count once; at most ``rows`` keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"draw": [], "html": []}), *batches]).sort_values(["draw", "html"])
        field = train_field(rows["html"].tolist())
        yield pd.DataFrame({"model": [json.dumps([field.weights, field.transitions])]})

    found = sample.repartition(1).mapInPandas(run, "model string").first()  # nothing for an empty table
    if found is None:
        return train_field([])
    weights, transitions = json.loads(found["model"])
    return ChainField(weights, transitions)


def main_text(page: str | None, field: ChainField) -> str:
    blocks = leaf_blocks(page or "")
    labels = field.viterbi(field.emissions([block_features(b) for b in blocks]))
    return " ".join(b.text for b, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = ("url",), field: ChainField | None = None) -> DataFrame:
    """``id_col``, the columns of ``keep``, text and n_chars (code points) of every page.

    A null page counts as empty, and one without main text has an empty text.
    Pages are read whole; broken-off tags and unclosed elements are borne. Rows
    are kept as they are, repeated and null ids too, and other columns are not
    read. Without a ``field``, one is trained on pages of the table; if none of
    them marks its main text by an element, a field with fixed weights is used.
    """
    names = [id_col, *keep]
    model = field or fit_on(pages, id_col, html_col)
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.transitions))
    schema = T.StructType([*[pages.schema[n] for n in names], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        own = ChainField(*shared.value)

        def rows(chunk):
            texts = [main_text(page, own) for page in chunk[html_col]]
            return {n: chunk[n] for n in names} | {"text": texts, "n_chars": [len(t) for t in texts]}

        return rows

    return map_rows(pages, [*names, html_col], make, schema)
