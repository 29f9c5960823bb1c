"""Problem 4: items over a size limit, cut into overlapping pieces at natural boundaries.

Recursive bisection: a span over its limit is cut at the strongest boundary near its midpoint, and
each half is cut on. Boundaries, strongest first: blank line, line end, sentence end, clause end,
word end. One in the middle half of the span is preferred, else the one of any strength nearest the
midpoint; a span without any is cut at its midpoint, but never inside a character with its marks or
joiners if such a place exists within reach. Then every piece after the first begins with up to
``overlap`` characters from the end of the one before it, from the start of a word on.

Pieces are spans of the stored text: leaving out the overlaps gives the text back, character for
character. Sizes count Unicode code points. A null or empty text has no piece; a text within the
limit is one piece; a blank text over the limit is cut like any other. Extra columns are left out.
Only items over the limit leave the JVM.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150

#: Short forms whose full stop ends no sentence (a fixed list of plain English and scholarly ones).
ABBREVIATIONS = frozenset("al approx ca cf dept dr ed eds e.g eq eqs est etc fig figs i.e inc jr ltd mr mrs ms no nos p pp prof ref refs sec st tab vol vs".split())

_PARAGRAPH = regex.compile(r"\n[ \t\r\f\v]*\n\s*")
_LINE = regex.compile(r"\n|\r(?!\n)| | |\f")
_SENTENCE = regex.compile(r"[.!?…][\"'”’»)\]*_]*\s+(?=[\"'“‘«(\[*_¿¡]*[\p{Lu}\p{Lt}\p{Lo}\p{N}#|>-])|[。！？｡؟]+[”’」』）]*\s*")
_CLAUSE = regex.compile(r"[;:,]\s+|[，；：、]")
_WORD = regex.compile(r"\s+")
_GLUED = regex.compile(r"[\p{M}‌‍︀-️\U0001F3FB-\U0001F3FF]")


def _sentence_ends(text: str) -> list[int]:
    ends = []
    for m in _SENTENCE.finditer(text):
        if text[m.start()] == ".":
            k = m.start()
            while k and not text[k - 1].isspace() and m.start() - k < 12:
                k -= 1
            word = text[k : m.start()].lstrip("([\"'“‘").lower()
            if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
                continue
        ends.append(m.end())
    return ends


def boundaries(text: str) -> list[list[int]]:
    """Places where a piece may end, by strength, the strongest first; each list ascends."""
    ends = [[m.end() for m in p.finditer(text)] for p in (_PARAGRAPH, _LINE)]
    return [*ends, _sentence_ends(text), *([m.end() for m in p.finditer(text)] for p in (_CLAUSE, _WORD))]


def _nearest(places: list[int], mid: int, low: int, high: int) -> int | None:
    """The place nearest to ``mid`` with low < place < high; the earlier one of a tie."""
    k = bisect_left(places, mid)
    found = [p for p in places[max(0, k - 1) : k + 1] if low < p < high]
    return min(found, key=lambda p: (abs(p - mid), p), default=None)


def _hard_cut(text: str, mid: int, low: int, high: int) -> int:
    for d in range(min(32, mid - low)):
        if not _GLUED.match(text[mid - d]) and text[mid - d - 1] != "‍":
            return mid - d
    return mid


def bisect(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces without overlaps, in order; together they are the text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    marks, room = boundaries(text), limit - overlap
    spans, todo = [], [(0, len(text))]
    while todo:
        low, high = todo.pop()
        # the first piece carries no overlap, so it may fill the limit
        if high - low <= (limit if low == 0 else room):
            spans.append((low, high))
            continue
        mid, quarter = (low + high) // 2, (high - low) // 4
        at = next((p for m in marks if (p := _nearest(m, mid, low + quarter, high - quarter)) is not None), None)
        if at is None:
            near = [p for m in marks if (p := _nearest(m, mid, low, high)) is not None]
            at = min(near, key=lambda p: (abs(p - mid), p)) if near else _hard_cut(text, mid, low, high)
        todo += [(at, high), (low, at)]
    return spans


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of every piece."""
    out = []
    for low, high in bisect(text, limit, overlap):
        start = low
        if out and overlap:
            first = max(out[-1][1], low - overlap)
            start = first
            if first > out[-1][1] and not text[first - 1].isspace():
                m = _WORD.search(text, first, low)
                if m and m.end() < low:
                    start = m.end()
                elif (glued := next((k for k in range(first, low) if not _GLUED.match(text[k])), None)) is not None:
                    start = glued
        out.append((start, low, high))
    return out


def split_items(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, keep_short: bool = True) -> DataFrame:
    """Pieces of every item: ``(row_id, piece_no, n_pieces, start, body_start, end, piece)``.

    ``start`` .. ``end`` is the piece in the item's text, ``body_start`` where its overlap ends; all
    count from 0. ``keep_short=False`` leaves out items within the limit.
    """
    src = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    id_type = src.schema["row_id"].dataType.simpleString()
    out = f"row_id {id_type}, piece_no int, n_pieces int, start int, body_start int, end int, piece string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ps = pieces(t, limit, overlap)
                rows += [(i, k, len(ps), s, body, e, t[s:e]) for k, (s, body, e) in enumerate(ps, 1)]
            if rows:
                cols = list(zip(*rows))
                kinds = [b.schema.field(0).type, *[pa.int32()] * 5, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row_id", "piece_no", "n_pieces", "start", "body_start", "end", "piece"])

    long = src.where(F.length("text") > limit).mapInArrow(cut, out)
    if not keep_short:
        return long
    one, zero = F.lit(1), F.lit(0)
    short = src.where(F.length("text") <= limit).select(
        "row_id", one.alias("piece_no"), one.alias("n_pieces"), zero.alias("start"), zero.alias("body_start"), F.length("text").alias("end"), F.col("text").alias("piece")
    )
    return long.unionByName(short)
