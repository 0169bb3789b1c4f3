"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a run of tags and words. Every tag costs; every word has a score,
the log odds that it belongs to the main text, learnt by logistic regression
from labelled pages. Its features are the open elements and the words of their
class, id, role and aria-label and, where these say little, whether it is in a
link and how long the stretch of text is that it stands in. One linear scan
finds the contiguous run with the largest sum.

Elements that say something are judged by the same weights before the scan:
where these score below zero (a menu, an advert or the readers' comments), an
element's words are no part of the text. Within an element that scores above
zero they don't end the run either.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|select|math|object|canvas|audio|video)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em embed font i img input ins kbd label mark meta link param q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
PLAIN = frozenset("html body br hr b i em strong u small sub sup img wbr a font".split())
#: Elements that say little about what they hold, in which links and lengths count.
LOOSE = frozenset("p div section span heading ul ol li dl dt dd table tbody thead tr td th pre blockquote figure figcaption center details summary label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IMPLIED = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Words of class, id and role that the labelled pages are built with, by what they name there.
MENUS = "header topbar nav navbar navigation menu toolbar breadcrumb breadcrumbs pagination pager skip masthead sidebar side rail widget related recommended recommendations trending share sharing social follow".split()
NOTICES = "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup copyright disclaimer legal footer".split()
FORMS = "signin login search form respond reply".split()
REMARKS = "comment comments replies responses feedback disqus discussion".split()
TOPICS = "prices history items guide music weather recipe letters garden river table colour winter school theatre market health travel science family village animals".split()
BODIES = "content main article post entry story text body page container wrapper column figure caption quote section chapter lead intro summary".split()


def names(attrs: str) -> dict[str, float]:
    """The words of an element's class, id, role and label, each with its share of the name that it stands in."""
    out: dict[str, float] = {}
    for a in _ATTRIBUTE.finditer(attrs):
        for name in re.split(r"\s+", a.group(1) or a.group(2) or a.group(3) or ""):
            parts = [x.lower() for x in _PART.findall(name)]
            for x in parts:
                out[x] = max(out.get(x, 0.0), 1 / len(parts))
    return out


def walk(page: str, opened, closed) -> Iterator[tuple[str, str]]:
    """("text", text), ("tag", name) and ("break", name) in page order; ``opened(tag, attrs, tags)`` and ``closed()`` follow the open elements.

    An element left open ends where HTML implies it. The cost is linear in
    the page however deep its elements are: open elements are found by name.
    """
    stack: list[tuple[str, int]] = []  # element, place of the innermost block at or below it
    places: dict[str, list[int]] = defaultdict(list)

    def cut(to: int) -> None:
        while len(stack) > to:
            places[stack.pop()[0]].pop()
            closed()

    for m in _TOKEN.finditer(page):
        text = m.group("text")
        if text is not None:
            yield "text", text
            continue
        tag = (m.group("tag") or "").lower()
        if not tag:  # comments, declarations, scripts and the like leave the text around them whole
            continue
        if tag not in INLINE:
            yield "break", tag
        block = stack[-1][1] if stack else -1
        if m.group("close"):
            if places[tag] and (tag not in INLINE or places[tag][-1] > block):
                cut(places[tag][-1])
        elif tag not in VOID and not (m.group("attrs") or "").rstrip().endswith("/"):
            shut = _IMPLIED.get(tag, frozenset()) | (frozenset(["p"]) if tag in _ENDS_P else frozenset())
            while block >= 0 and stack[block][0] in shut:
                cut(block)
                block = stack[-1][1] if stack else -1
            opened(tag, m.group("attrs") or "", places)
            places[tag].append(len(stack))
            stack.append((tag, stack[-1][1] if tag in INLINE and stack else -1 if tag in INLINE else len(stack)))
        yield "tag", tag


def element_features(tag: str, attrs: str, places) -> dict[str, float]:
    """What an open element tells about the words in it."""
    out: dict[str, float] = {}
    inside = bool(places["article"] or places["main"])
    if tag in ("header", "footer"):
        out[f"{tag} within" if inside else tag] = 1.0
    elif tag in HEADINGS:
        out["heading"] = 1.0
    elif tag not in PLAIN:
        out[tag] = 1.0
    if tag not in ("html", "body", "article", "main"):
        out |= {"." + x: share for x, share in names(attrs).items()}
    return out


def stretch_features(words: int, link: bool) -> tuple[str, ...]:
    """What a stretch of text tells about its words where the open elements say little."""
    return (f"length {min(words, 32).bit_length()}", *(("in a link",) if link else ()))


#: The feature of all words within an element that says something; of its elements only such count.
TOLD = "told"


# --- labelled pages ---------------------------------------------------------

_LONG = "The river was high that spring and nobody in the village crossed it before the bells rang at noon."
_MIDDLE = "It rained until the evening came."
_SHORT = "A day out"
_LINKS = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>All news</a></li></ul><a>About us</a> <a>Contact</a>"


def labelled() -> list[str]:
    """Pages with the main text in {braces}, built by rule: layouts with and without sectioning elements, each name on an element of its kind."""
    junk = [
        *(f"<div class='{x}'>{_LINKS}</div>" for x in MENUS), *(f"<div id='{x}'>Share this on <a>one</a> {_SHORT}</div>" for x in MENUS),
        *(f"<div class='{x}'>{_MIDDLE}</div>" for x in NOTICES), *(f"<section class='site-{x}'><p>{_LONG}</p></section>" for x in NOTICES), *(f"<span id='{x}-box'>{_SHORT}</span>" for x in NOTICES),
        *(f"<div class='{x}'><label>Your name</label> <input> {_SHORT}</div>" for x in FORMS),
        *(f"<section class='{x}'><h3>{_SHORT}</h3><p>{_LONG}</p><div>{_LONG}</div></section>" for x in REMARKS), *(f"<div id='{x}-list'><p>{_MIDDLE}</p><p>{_LONG}</p></div>" for x in REMARKS),
        *(f"<div class='{x}-section'><p>{_LONG}</p></div>" for x in (*REMARKS, *NOTICES)), *(f"<div class='post-{x}'>{_MIDDLE}</div>" for x in (*REMARKS, *NOTICES, *MENUS)), *(f"<div class='{x} block'>{_LINKS}</div>" for x in MENUS),
        f"<nav>{_LINKS}</nav>", f"<nav><p>{_MIDDLE}</p></nav>", f"<aside><h3>{_SHORT}</h3><p>{_LONG}</p></aside>", f"<aside>{_LINKS}</aside>",
        f"<form><p>{_MIDDLE}</p><label>{_SHORT}</label><button>Send</button></form>", f"<menu>{_LINKS}</menu>", f"<dialog><p>{_LONG}</p></dialog>", f"<fieldset>{_MIDDLE}</fieldset>", f"<button>{_SHORT}</button>",
        f"<div role='navigation'>{_LINKS}</div>", f"<div role='search'>{_SHORT}</div>", f"<footer><p>{_LONG}</p>{_LINKS}</footer>", f"<footer>{_MIDDLE}</footer>",
    ]
    text = f"<h1>{{{_SHORT}}}</h1><p>{{{_LONG}}}</p><p>{{{_MIDDLE} <a>{_SHORT}</a> {_LONG}}}</p>"
    more = f"<ul><li>{{{_MIDDLE}}}</li><li>{{{_LONG}}}</li></ul><blockquote>{{{_LONG}}}</blockquote><table><tr><td>{{{_SHORT}}}</td><td>{{{_LONG}}}</td></tr></table><pre>{{{_MIDDLE}}}</pre><p>{{{_LONG}}}</p>"
    plain = f"<div>{{{_LONG} {_LONG}}}</div><div>{{{_LONG}}}<br>{{{_LONG}}}</div>"
    top = f"<header><a>{_SHORT}</a> {_MIDDLE}</header>"
    loose = f"<div>{_LINKS}</div>"
    frames = [
        lambda j: f"<body>{top}<article><header>{{{_SHORT}}}</header>{text}{j}{more}<footer>{_SHORT}</footer></article>{j}</body>",
        lambda j: f"<body>{j}<main><section>{text}</section>{j}<section>{more}</section></main>{loose}</body>",
        lambda j: f"<body>{loose}{j}<div>{text}{more}</div>{j}</body>",
        lambda j: f"<body>{loose}{j}{plain}{j}{loose}</body>",
    ]
    pages = [frame(j) for j in junk for frame in frames]
    for x in BODIES:
        pages += [f"<body>{loose}<div class='{x}'>{text}{junk[k % len(junk)]}{more}</div><div class='menu'>{_LINKS}</div></body>" for k in range(3)]
        pages.append(f"<body><nav>{_LINKS}</nav><div id='{x}-text'>{plain}</div></body>")
    pages += [f"<body><div class='header'>{_MIDDLE}</div><article><div class='{x}-header'><h1>{{{_SHORT}}}</h1><p>{{{_LONG}}}</p></div>{text}</article></body>" for x in ("article", "entry", "story", "content", "text")]
    # A name on the main text's own elements, in which a word is the same as one of a menu's.
    pages += [f"<body>{top}<article>{text}<div class='{x}-{y}'><p>{{{_LONG}}}</p></div>{more}</article></body>" for k, x in enumerate((*MENUS, *FORMS, *NOTICES)) for y in (TOPICS[k % len(TOPICS)], TOPICS[7 * k % len(TOPICS)])]
    return pages


class Model(NamedTuple):
    """Weights of features (elements and names; links and lengths) and what a tag costs."""

    bias: float
    elements: dict[str, float]
    stretch: dict[str, float]
    tag: float


def _examples(page: str) -> Iterator[tuple[bool, tuple[tuple[str, float], ...], int]]:
    """(is main text, features, words) of each stretch of a labelled page."""
    open_: list[tuple[str, dict[str, float]]] = []
    inside = False
    for kind, text in walk(page, lambda tag, attrs, places: open_.append((tag, element_features(tag, attrs, places))), lambda: open_.pop()):
        if kind != "text":
            continue
        features: dict[str, float] = {}
        for _, f in open_:
            for k, v in f.items():
                features[k] = max(v, features.get(k, 0.0))
        if LOOSE.issuperset(features):
            features |= dict.fromkeys(stretch_features(len(re.sub("[{}]", " ", text).split()), any(tag == "a" for tag, _ in open_)), 1.0)
        else:
            features = {TOLD: 1.0} | {f: v for f, v in features.items() if f not in LOOSE}
        for part in re.split(r"([{}])", text):
            if part in ("{", "}"):
                inside = part == "{"
            elif part.split():
                yield inside, tuple(sorted(features.items())), len(part.split())


def learn(pages: list[str] | None = None, penalty: float = 0.1, steps: int = 60) -> Model:
    """Logistic regression over the words of labelled pages, by Newton steps with a ridge; a tag costs a twentieth of a main word's mean score."""
    counts: Counter = Counter()
    for page in pages or labelled():
        for good, features, words in _examples(page):
            counts[good, features] += words
    index = {f: k for k, f in enumerate(sorted({f for _, features in counts for f, _ in features}))}
    x, y, w = np.zeros((len(counts), len(index) + 1)), np.array([good for good, _ in counts], float), np.array([*counts.values()], float)
    x[:, -1] = 1.0
    for k, (_, features) in enumerate(counts):
        for f, v in features:
            x[k, index[f]] = v
    beta, ridge = np.zeros(x.shape[1]), np.r_[np.full(len(index), penalty), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (w * (y - p)) - ridge * beta)
        beta += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    weight = {f: float(beta[k]) for f, k in index.items()}
    own = {f for f in weight if f == "in a link" or f.startswith("length ")}
    mean = float((x @ beta * y * w).sum() / (y * w).sum())
    return Model(float(beta[-1]), {f: b for f, b in weight.items() if f not in own}, {f: weight[f] for f in own}, max(0.0, mean) / 20)


#: What the scan does with an element's words: part of the text, left out at their cost, or passed over.
IN, OUT, OVER = range(3)


def scored(page: str | None, model: Model) -> list[tuple[float, str]]:
    """The page's tokens as (score, text that counts)."""
    held: Counter = Counter()  # open features with their shares
    frames: list[tuple[tuple, list[tuple[str, float]]]] = []  # the state before each open element, and what it added
    loose, firm, told, link, part = model.bias, model.bias + model.elements.get(TOLD, 0.0), 0, False, IN
    stream: list[tuple[float, str]] = []

    def opened(tag: str, attrs: str, places) -> None:
        nonlocal loose, firm, told, link, part
        before, added = (loose, firm, told, link, part), []
        for f, share in element_features(tag, attrs, places).items():
            if f in model.elements and share > held[f]:
                added.append((f, held[f]))
                gain = model.elements[f] * (share - held[f])
                held[f] = share
                if f in LOOSE:
                    loose += gain
                else:
                    firm, told = firm + gain, told + 1
        frames.append((before, added))
        link = link or tag == "a"
        if part == IN and told and firm < 0:  # an element out of the text is out with all it holds
            part = OVER if before[2] else OUT

    def closed() -> None:
        nonlocal loose, firm, told, link, part
        (loose, firm, told, link, part), added = frames.pop()
        for f, share in added:
            held[f] = share

    for kind, text in walk(page or "", opened, closed):
        if kind == "text":
            decoded = _html.unescape(text)
            n = len(decoded.split())
            word = firm if told else loose + sum(model.stretch.get(f, 0.0) for f in stretch_features(n, link))
            stream.append((n * word, decoded) if part == IN else (n * min(word, 0.0) if part == OUT else 0.0, ""))
        elif kind == "break":
            stream.append((0.0, " "))
        else:
            stream.append((0.0 if part == OVER else -model.tag, ""))
    return stream


def scan(stream: list[tuple[float, str]]) -> tuple[list[float], float, tuple[int, int]]:
    """The scores, the largest sum of a contiguous run, and that run."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, (points, _) in enumerate(stream):
        if total <= 0:
            total, start = 0.0, k
        total += points
        if total > best:
            best, span = total, (start, k + 1)
    return [x for x, _ in stream], best, span


def extract(page: str | None, model: Model) -> str:
    """The main text: its blocks in page order, white space made one space; empty if there is none."""
    stream = scored(page, model)
    _, _, (start, end) = scan(stream)
    return " ".join("".join(text for _, text in stream[start:end]).split())


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row; a null page has the empty text, repeated rows equal ones."""
    weights = model or learn()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
