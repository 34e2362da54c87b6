"""Splitting oversized items at natural boundaries by content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks. From the start of a piece the
first landmark between the minimum and the maximum size is taken (the position of the largest hash if
there is none) and snapped to the nearest natural boundary of the best class that lies between these
sizes: paragraph, line, sentence, clause, word end. As hash and boundaries depend on nearby characters
only, an edit alters the pieces around it and the cuts fall back into step after it.

Rows are independent: sizes are tested in the JVM, only oversized items pass through Python, nothing
is shuffled but the keys of row copies.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrow import per_batch

LIMIT = 400
OVERLAP = 40
MINIMUM = 120
WINDOW = 12
#: one landmark in so many positions on average
SPACING = 64

# Boundary classes, best first; each pattern's match end is a place to cut.
CLASSES = (
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[。！？．｡।؟](?:[”’」』）)】》\"'])*\s*|[.!?](?:[”’»)\"'])*\s+(?=[^\sa-z])"),
    re.compile(r"[，、；：,;:،؛][”」』\"]?\s*(?![0-9])|[…—]+"),
    re.compile(r"\s+|(?<=[|/])(?=.)"),
)
_MARKS = re.compile(r"[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎‍︀-️]")
TRIMMED = " \t\r\n\v\f　   \u0085"


def trimmed(col: Column) -> Column:
    """Without blanks, tabs and line breaks at both ends."""
    return F.trim(col, F.lit(TRIMMED))


def _hashes(text: str) -> np.ndarray:
    """h[i]: mixed rolling hash of the WINDOW characters that end before position i."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes) + 1, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):  # polynomial over the window, all positions at once
            shifted = codes[: len(codes) - k] if k else codes
            h[k + 1 :] += shifted * np.uint64(pow(int(base), k, 1 << 64))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, in code points; consecutive pieces share ``overlap``.

    A text within the limit is one piece; an empty one has none.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    if not 0 <= overlap < minimum <= limit - overlap:
        raise ValueError("needs overlap < minimum <= limit - overlap")
    h = _hashes(text)
    marks = np.flatnonzero(h % np.uint64(SPACING) == 0)
    ends = [np.fromiter((m.end() for m in c.finditer(text)), np.int64) for c in CLASSES]
    out, start, fresh = [], 0, 0  # fresh: where the piece's own text begins
    while n - start > limit:
        low, high = fresh + minimum - overlap * bool(start), start + limit
        at = np.searchsorted(marks, low)
        goal = int(marks[at]) if at < len(marks) and marks[at] <= high else low + int(np.argmax(h[low : high + 1]))
        cut = goal
        for e in ends:
            a, b = np.searchsorted(e, low), np.searchsorted(e, high, "right")
            if a < b:
                c = e[a:b]
                cut = int(c[np.argmin(np.abs(c - goal))])
                break
        else:
            while cut > low and _MARKS.match(text, cut):
                cut -= 1
        out.append((start, cut))
        start, fresh = cut - overlap, cut
    out.append((start, n))
    return out


def pieces(df: DataFrame, key: str, content: str, page: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> DataFrame:
    """The pieces of every oversized item.

    (key, chunk_index, page_number, start_pos, end_pos, content): a running index from 0, the parent's
    page, the piece's place in the trimmed parent text. Items within the limit, NULL and blank ones
    have no pieces here. Row copies are one item; of different rows with one key the pieces of each
    come out, numbered on their own. Further columns are ignored.
    """
    big = df.select(F.col(key).cast("bigint").alias("k"), trimmed(F.col(content)).alias("t"), F.col(page).cast("int").alias("p")).where(F.char_length("t") > limit)

    def work(cols: dict[str, list]) -> dict[str, pa.Array]:
        rows = [(k, i, p, a, b, t[a:b]) for k, t, p in zip(cols["k"], cols["t"], cols["p"]) for i, (a, b) in enumerate(cut_points(t, limit, overlap, minimum))]
        r = list(zip(*rows)) if rows else [[]] * 6
        return {
            key: pa.array(r[0], pa.int64()),
            "chunk_index": pa.array(r[1], pa.int32()),
            "page_number": pa.array(r[2], pa.int32()),
            "start_pos": pa.array(r[3], pa.int32()),
            "end_pos": pa.array(r[4], pa.int32()),
            "content": pa.array(r[5], pa.string()),
        }

    return per_batch(big, work, f"`{key}` bigint, chunk_index int, page_number int, start_pos int, end_pos int, content string", 128)


def oversized(split: DataFrame, key: str) -> DataFrame:
    """Keys of items that were cut."""
    return split.where("chunk_index >= 0").select(key).distinct()
