"""Main-text extraction from HTML by two-pass block rules.

First pass, on each block by itself: link density, stop-word density and length make it good, bad, near
(almost good) or short. Second pass: short and near blocks take the label of the nearest decided
neighbours; where they disagree a near block follows a good one, a short one does so only if both sides
are good or near it. The end of the page counts as bad.

A null page gives null text and no blocks; an empty page, or one with only markup, gives empty text. Unclosed
comments, titles and scripts end with the page, a head without its end tag where its last element ends; "<" that opens no tag is
text, ">" in a quoted attribute ends no tag. Cost is linear in the page's length, and whole pages are read, whatever their size. Rows are
independent: repeated pages give repeated results, a null page_id is carried along; an empty table gives no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .util import only

MAX_LINK_DENSITY, LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, HEADING_DISTANCE = 0.2, 70, 200, 0.30, 0.32, 200

_STOP = {
    "en": "a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how i if in into is it its like may more most my no not of on one only or other our out over s she so some such than that the their them then there these they this to two up was we were what when which who will with would you your",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et été être fait il ils je la le les leur lui mais me même n ne nous on ont ou par pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous y",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die dies durch ein eine einem einen einer er es für hat ich ihr im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was werden wie wird wir zu zum zur",
    "es": "a al como con cuando de del desde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por porque que qué se ser si sin sobre son su sus también te tiene todo un una y ya yo",
}
STOP_WORDS = {k: frozenset(v.split()) for k, v in _STOP.items()}
ALL_STOP_WORDS = frozenset().union(*STOP_WORDS.values())

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: A tag from its name on: quoted values may hold any sign. Nothing is tried twice, so that cost stays linear.
_REST = r"""\b(?:[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>"""
_PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title|textarea|iframe){_REST}.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*+){_REST}|<[!?][^<>]*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^<>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)
_TOKEN = re.compile(r"\w+")


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, whether it is a heading) of each block that has text."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = depth = at = 0
    heading, breaks = False, 0

    def close() -> None:
        nonlocal linked, parts
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, min(linked, len(text)), heading))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if depth:
                linked += len(" ".join(text.split()))
            if not raw.isspace():
                breaks = 0

    for m in _PIECE.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name in _BLOCK:
            close()
            breaks = 0
            if name in _HEADING:
                heading = not m[2]
            elif name in ("body", "article", "div", "section"):
                depth = 0
        elif name == "a":
            depth = 0 if m[2] else 1
        elif name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
        elif m[1]:
            parts.append(" ")
    add(page[at:])
    close()
    return out


def first_pass(text: str, linked: int, stop: frozenset[str]) -> str:
    density = linked / len(text)
    if density > MAX_LINK_DENSITY or "\xa9" in text:
        return "bad"
    if len(text) < LENGTH_LOW:
        return "bad" if linked else "short"
    tokens = _TOKEN.findall(text.lower())
    share = sum(t in stop for t in tokens) / len(tokens) if tokens else 0
    if share >= STOP_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "near"
    return "near" if share >= STOP_LOW else "bad"


def second_pass(labels: list[str], headings: list[bool], sizes: list[int]) -> list[str]:
    """Labels good and bad only. Neighbours are looked up in the first pass's labels, so order does not matter."""
    n = len(labels)
    before, after = ["bad"] * n, ["bad"] * n  # the nearest good or bad label on each side
    near_before, near_after = [False] * n, [False] * n  # whether a near block lies between
    for side, near, order in ((before, near_before, range(n)), (after, near_after, range(n - 1, -1, -1))):
        last, seen = "bad", False
        for i in order:
            side[i], near[i] = last, seen
            if labels[i] in ("good", "bad"):
                last, seen = labels[i], False
            elif labels[i] == "near":
                seen = True
    ahead: list[int | None] = [None] * n  # characters up to the next good block
    gap: int | None = None
    for i in range(n - 1, -1, -1):
        ahead[i] = gap
        gap = 0 if labels[i] == "good" else None if gap is None else gap + sizes[i]
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label)
        elif headings[i] and ahead[i] is not None and ahead[i] <= HEADING_DISTANCE:
            out.append("good")
        elif before[i] == after[i]:
            out.append(before[i])
        elif label == "near":
            out.append("good")
        else:
            bad_side_near = near_before[i] if before[i] == "bad" else near_after[i]
            out.append("good" if bad_side_near else "bad")
    return out


def extract(page: str | None) -> tuple[str | None, int, int]:
    """Text of the good blocks, one a line; how many blocks there are and how many are good."""
    if page is None:
        return None, 0, 0
    lang = _LANG.search(page)
    stop = STOP_WORDS.get(lang[1].lower(), ALL_STOP_WORDS) if lang else ALL_STOP_WORDS
    found = blocks(page)
    labels = second_pass([first_pass(t, k, stop) for t, k, _ in found], [h for _, _, h in found], [len(t) for t, _, _ in found])
    kept = [b[0] for b, label in zip(found, labels) if label == "good"]
    return "\n".join(kept), len(found), len(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_blocks, n_good) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(x) for x in batch.column(1).to_pylist()]
            text, n, good = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(good, pa.int32())], ["page_id", "text", "n_blocks", "n_good"])

    kind = pages.schema[id_col].dataType.simpleString()
    return only(pages, page_id=id_col, html=html_col).mapInArrow(run, f"page_id {kind}, text string, n_blocks int, n_good int")
