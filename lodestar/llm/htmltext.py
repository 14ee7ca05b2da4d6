"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element, in page order. Lines of menus,
headers, footers, sidebars, notices, adverts, forms and reader comments go, as their
elements or class, id and role names tell. Names are judged as whole words, and an
element that wraps an article or nearly all of the page's text is no noise by its name.
Over what is left, text lengths are summed over sliding windows of lines; the text
surges where sums rise from nothing and dives where they fall to nothing again. All
lines from the first surge to the last dive are the main text, short ones between two
runs too, and those that share a block with its first or last line. Where the run with
most text lies in an ``article`` or ``main`` element, the lines between the first and
last such element are the page, and each of theirs counts as full; so short first and
last lines and sibling articles stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LineBlocks:
    """Windows of ``window`` lines; a window of fewer than ``least`` characters is empty."""

    window: int = 3
    least: int = 25


_RAW = "script|style|noscript|template|iframe|svg|math|object|canvas|title|textarea|xmp|noembed"
_TOKEN = re.compile(
    # A quote opens a value after an equals sign only; elsewhere it is a letter like others.
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]+|=)*+)(?:>|\Z)",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside menu dialog button select search head".split())
_MAIN = frozenset(("article", "main"))
#: Elements whose blocks belong together; the body's do not.
_HOLD = frozenset("article main section div td blockquote center fieldset form ul ol dl table".split())
#: A new one of these ends an open one, whatever inline elements are open within.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Names that are noise alone, before one of ``_HOLDERS``, or last in a compound.
_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright".split())
_HOLDERS = frozenset("area article articles banner bar block box button buttons card content container form icons inner items item label links link list media message nav notice outer overlay panel post posts row section slot stories text unit widget wrap wrapper".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: A name of a state says what its element is next to, not what it is.
_STATES = frozenset("has no with without is not".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SURE, _MAYBE, _TALK = 1, 2, 3


def _named(value: str, in_main: bool) -> int:
    """What the words of a class or id say: nothing, ``_MAYBE`` noise, or ``_TALK`` of readers."""
    found = 0
    for word in value.split():
        parts = _PARTS.findall(_CAMEL.sub("-", word).lower())
        if not parts or parts[0] in _STATES:
            continue
        if any(x in _COMMENTS and (len(parts) == 1 or x in (parts[0], parts[-1]) and (x == parts[-1] or parts[1] in _HOLDERS)) for x in parts):
            return _TALK
        last = parts[-1]
        if last in _NAMES or parts[0] in _NAMES and len(parts) > 1 and all(x in _HOLDERS or x in _NAMES for x in parts[1:]) or last == "header" and not in_main:
            found = _MAYBE
    return found


def _noise(name: str, attrs: str, in_main: bool) -> int:
    if name in _OUT or (name == "header" and not in_main):
        return _SURE
    found = _MAYBE if name == "form" else 0
    for m in _ATTR.finditer(attrs) if attrs and name not in ("html", "body") else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return _SURE
        told = _MAYBE if key == "role" and value.lower() in _NOISE_ROLES else _named(value, in_main) if key in ("class", "id") else 0
        found = max(found, told)
    # An article is noise by its names only where they name comments.
    return found if found == _TALK or name not in _MAIN else 0


@dataclass
class _Line:
    text: str
    main: int  # number of its article or main element, or 0
    noise: tuple[int, ...]  # its elements that may be noise
    block: int  # number of the element that holds its block


def _all_lines(page: str) -> tuple[list[_Line], list[int], list[bool]]:
    """Lines outside sure noise; of each element that may be noise its kind and whether it holds an article."""
    out: list[_Line] = []
    buffer: list[str] = []
    kinds: list[int] = []
    holds: list[bool] = []
    # Of an open element: name, sure noise, elements that may be noise, main element, holder of blocks.
    stack: list[tuple[str, bool, tuple[int, ...], int, int]] = []
    outside = ("", False, (), 0, 0)
    mains = blocks = at = 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                _, _, noise, main, block = stack[-1] if stack else outside
                out.append(_Line(text, main, noise, block))

    for m in _TOKEN.finditer(page):
        _, sure, noise, main, block = stack[-1] if stack else outside
        if m.start() > at and not sure:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            if not sure:
                buffer.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                # An inline end tag never closes a block it did not open.
                if name not in _BLOCK and stack[k][0] in _BLOCK:
                    break
        elif name not in _VOID and not m[4].rstrip().endswith("/"):
            ends = _CLOSES.get(name)
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
            _, sure, noise, main, block = stack[-1] if stack else outside
            kind = 0 if sure else _noise(name, m[4], main > 0)
            if kind == _SURE:
                sure = True
            elif kind:
                noise = (*noise, len(kinds))
                kinds.append(kind)
                holds.append(False)
            if name in _MAIN and not sure:
                for e in noise:
                    holds[e] = holds[e] or kind != _TALK
                if not main:
                    mains += 1
                    main = mains
            if name in _HOLD:
                blocks += 1
                block = blocks
            stack.append((name, sure, noise, main, block))
    if at < len(page) and not (stack and stack[-1][1]):
        buffer.append(page[at:])
    flush()
    return out, kinds, holds


def lines_of(page: str) -> list[_Line]:
    """The lines outside noise. What wraps an article, or nine tenths of the text, is no noise by its name."""
    lines, kinds, holds = _all_lines(page)
    total, own = 0, [0] * len(kinds)
    for x in lines:
        # Readers' talk is not weighed.
        if all(kinds[e] != _TALK for e in x.noise):
            total += len(x.text)
            for e in x.noise:
                own[e] += len(x.text)
    stays = [kinds[e] != _TALK and (holds[e] or 10 * own[e] >= 9 * total) for e in range(len(kinds))]
    return [x for x in lines if all(stays[e] for e in x.noise)]


def _runs(sizes: list[int], p: LineBlocks) -> list[tuple[int, int]]:
    """(surge, dive) of each run of lines over which any window holds enough text."""
    n = len(sizes)
    inside = [False] * n
    run = sum(sizes[: p.window])
    for i in range(max(1, n - p.window + 1)):
        if run >= p.least:
            inside[i : i + p.window] = [True] * min(p.window, n - i)
        if i + p.window < n:
            run += sizes[i + p.window] - sizes[i]
    edges = [i for i in range(n + 1) if (i > 0 and inside[i - 1]) != (i < n and inside[i])]
    return list(zip(edges[::2], edges[1::2], strict=True))


def main_text(page: str, p: LineBlocks = LineBlocks()) -> str:
    """The main text of a page; of runs with equally much text the first decides whether articles do."""
    lines = lines_of(page)
    runs = _runs([len(x.text) for x in lines], p)
    if runs:
        surge, dive = max(runs, key=lambda r: (sum(len(x.text) for x in lines[r[0] : r[1]]), -r[0]))
        if any(x.main for x in lines[surge:dive]):
            held = [k for k, x in enumerate(lines) if x.main]
            lines = lines[held[0] : held[-1] + 1]
            runs = _runs([max(len(x.text), p.least) if x.main else len(x.text) for x in lines], p)
        surge, dive = runs[0][0], runs[-1][1]
        # Lines that share a block with the first or last stay with it.
        while surge and lines[surge].block and lines[surge - 1].block == lines[surge].block:
            surge -= 1
        while dive < len(lines) and lines[dive].block and lines[dive].block == lines[dive - 1].block:
            dive += 1
        lines = lines[surge:dive]
    return "\n".join(x.text for x in lines)


def _extract(p: LineBlocks, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x or "", p) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    return run


def extract_text(pages: DataFrame, p: LineBlocks = LineBlocks()) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, in its place.

    Character references are decoded, white space inside a line becomes one space,
    lines are joined by one line feed. A null or empty page, or one without text,
    gives an empty text. Other columns stay; one named text is replaced. Cut-off
    markup (open comments, scripts, tags) reaches to the end of the page. Pages are
    independent of each other, so repeated rows give repeated rows.
    """
    names = [c for c in pages.columns if c not in ("html", "text")]
    src = pages.select(*[F.col(f"`{n}`") for n in names], "html")
    return src.mapInArrow(_extract(p, names), T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType())]))
