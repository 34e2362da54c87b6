"""Evaluation texts that leaked into training text, found with an FM-index per shard of the corpus.

A shard is a run of documents of about ``SHARD`` folded characters within one task. Its FM-index is
asked for every phrase of K consecutive characters of every passage (all phrases at once, backward
search by wavelet ranks); occurrences are located by sampled suffix positions and counted per document,
item and diagonal. By the q-gram lemma a stretch of length L with at most L/10 changes keeps at least
L - K + 1 - K * (L // 10) of its phrases near one diagonal. K is the largest one for which that is
three tenths or more of the least stretch for every L from it up; pairs with fewer phrases are no case. For the
others the best stretch about each exact run is found by edit distance on both its sides.
Every place of an item in a document comes out; these are the spans to remove, merged per document.

The items are the stated query set: an index is built once and searched for blocks of ``BLOCK`` items.
Documents are never shuffled; a task holds one shard's index at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.fmindex import MOST, FmIndex
from docloom.llm.normal import byte_codes, fold, fold_positions

SHARD = 1 << 19
BLOCK = 2000
SHARE = 0.4
CHANGED = 10  # one character in ten
K_WIDE, K_SPACED = 6, 8
#: folded characters of a passage; of a shorter one a single character would be a stretch
SHORTEST = 3
#: folded characters of a passage; a longer one counts as several passages of one item
LONGEST = 1 << 20


def least_phrases(need: int, whole: int, k: int) -> int:
    """Phrases of k characters that any stretch of ``need`` to ``whole`` characters keeps under its changes."""
    at = {need, *range(need + -need % CHANGED, min(whole, need + 2 * CHANGED) + 1, CHANGED)}  # the bound falls at each tenth and rises from one to the next
    return min(n - k + 1 - k * (n // CHANGED) for n in at)


def phrase_size(need: int, whole: int, most: int) -> int:
    return next((k for k in range(most, 0, -1) if least_phrases(need, whole, k) >= max(2, 0.3 * need)), 1)


class Phrases:
    """The phrases of a block of passages: distinct ones by length, and where each stands."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        folded, starts = fold([t for _, t in items])
        parts = [(i, folded[a : min(a + LONGEST, e)]) for (i, _), s, e in zip(items, starts, starts[1:]) for a in range(int(s), int(e), LONGEST) if e - s >= SHORTEST]
        self.ids = np.array([i for i, _ in parts], np.int64)
        self.texts = [t for _, t in parts]
        self.need = np.array([max(1, -(-len(t) * 2 // 5)) for t in self.texts], np.int64)
        wide = [(t >= 0x0E00).mean() >= 0.5 for t in self.texts]
        self.k = np.array([phrase_size(int(n), len(t), K_WIDE if w else K_SPACED) for n, t, w in zip(self.need, self.texts, wide)], np.int64)
        self.least = np.array([max(1, least_phrases(int(n), len(t), int(k))) for n, t, k in zip(self.need, self.texts, self.k)], np.int64)
        #: diagonals of a stretch differ by at most its insertions and deletions
        self.band = np.array([len(t) // CHANGED + 1 for t in self.texts], np.int64)
        self.groups = []
        for k in sorted(set(self.k.tolist())):
            own = [i for i in range(len(parts)) if self.k[i] == k]
            codes = [byte_codes()[self.texts[i]] for i in own]
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, k) for c in codes])
            who = np.concatenate([np.full(len(c) - k + 1, i) for i, c in zip(own, codes)])
            at = np.concatenate([np.arange(len(c) - k + 1) for c in codes])
            flat = np.ascontiguousarray(rows).view(f"V{k}").ravel()
            _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            begin = np.searchsorted(inverse[order], np.arange(len(first) + 1))
            self.groups.append((rows[first], begin, who[order], at[order]))


def _expand(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of ``which`` all indices begin[which] .. begin[which + 1]: (source entry, index)."""
    n = begin[which + 1] - begin[which]
    src = np.repeat(np.arange(len(which)), n)
    inner = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
    return src, begin[which][src] + inner


def shard_hits(index: FmIndex, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text position, item, position in the passage) of all occurrences of all phrases."""
    out = []
    for rows, begin, who, at in phrases.groups:
        low, high = index.search(rows)
        live = np.flatnonzero(high > low)
        n = high[live] - low[live]
        src = np.repeat(np.arange(len(live)), n)
        sa_rows = low[live][src] + (np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n))
        pos = index.locate(sa_rows)
        occurrence, entry = _expand(begin, live[src])
        out.append((pos[occurrence], who[entry], at[entry]))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e
    return tuple(np.concatenate(x) for x in zip(*out))


def _profile(passage: np.ndarray, text: np.ndarray, most: int, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For l = 0, 1, ..: least edits between the first l characters of ``passage`` and any beginning of ``text``, and
    that beginning's length, as far as there are at most ``most`` edits and ten for each do not exceed ``worth[l]``.
    A row's cells are diagonals."""
    n, w = len(passage), most
    padded = np.full(n + 2 * w + 1, -1, np.int64)
    padded[w : w + min(len(text), n + w)] = text[: n + w]
    shifted = np.lib.stride_tricks.sliding_window_view(padded, 2 * w + 1)
    along = np.arange(2 * w + 1, dtype=np.int32)
    row = np.where(along >= w, -w, 1 << 20).astype(np.int32)  # less ``along``, so that insertions are a running minimum
    limit = np.minimum(most, worth[1:] // CHANGED).tolist()
    edits, ends = [0], [0]
    for l in range(n):
        if l % 32 == 0:
            changed = (shifted[l : min(n, l + 32)] != passage[l : l + 32, None]).astype(np.int32)
        new = row + changed[l % 32]
        np.minimum(new[:-1], row[1:] + 2, out=new[:-1])
        row = np.minimum.accumulate(new)
        whole = row + along
        x = int(whole.argmin())
        e = int(whole[x])
        if e > limit[l]:
            break
        edits.append(e)
        ends.append(min(len(text), max(0, l + 1 + x - w)))
    return np.array(edits), np.array(ends)


def _in_step(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(characters, changes) of the beginning with the most characters less ten for each one changed in place."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    changed = np.cumsum(a[:n] != b[:n])
    gain = np.arange(1, n + 1) - CHANGED * changed
    x = int(gain.argmax())
    return (x + 1, int(changed[x])) if gain[x] > 0 else (0, 0)


def _grown(passage: np.ndarray, text: np.ndarray, run: tuple[int, int, int], need: int, at: np.ndarray, k: int) -> tuple[int, int] | None:
    """Span of the text of a stretch about an exact run (begin, end, diagonal): at least ``need`` characters of
    the passage, edits at most a tenth of them. None if there is none.

    The run is grown in step first, as long as that pays, and by edit distance from there; if that does not do, the
    best stretch about the run itself is looked for."""
    q, e, d = run
    r, c = _in_step(passage[e:], text[e + d :])
    l, b = _in_step(passage[:q][::-1], text[: q + d][::-1])
    if r + l:
        if span := _about(passage, text, (q - l, e + r, d), b + c, need, at, k):
            return span
    return _about(passage, text, run, 0, need, at, k)


def _about(passage: np.ndarray, text: np.ndarray, run: tuple[int, int, int], cost: int, need: int, at: np.ndarray, k: int) -> tuple[int, int] | None:
    """Span of the text of the best stretch about a run with ``cost`` edits in it, or None. ``at``: the phrases found; a
    side's characters less ten for each edit are at most its phrases and k - 1, since an edit alters k < 10 phrases at most."""
    q, e, d = run
    most, core = len(passage) // CHANGED, e - q - CHANGED * cost
    before, after = np.arange(q + 1), np.arange(len(passage) - e + 1)
    ahead = len(at) - np.searchsorted(at, e - k + 1 + after) + k
    behind = np.searchsorted(at, q - before) + k
    right, r_ends = _profile(passage[e:], text[e + d :], most, after + ahead + (core + behind[0]))
    best = int((np.arange(len(right)) - CHANGED * right).max())
    left, l_ends = _profile(passage[:q][::-1], text[: q + d][::-1], most, before + behind + (core + best))
    # characters gained less ten for each edit, on either side; the best sum among those that are long enough
    r_gain, l_gain = np.arange(len(right)) - CHANGED * right, np.arange(len(left)) - CHANGED * left
    from_here = np.maximum.accumulate(r_gain[::-1])[::-1]  # best gain at this length or a longer one
    short = np.maximum(0, need - (e - q) - np.arange(len(left)))
    ok = np.flatnonzero(short < len(right))
    if not len(ok):
        return None
    x = int(ok[(l_gain[ok] + from_here[short[ok]]).argmax()])
    if core + l_gain[x] + from_here[short[x]] < 0:
        return None
    y = int(short[x] + r_gain[short[x] :].argmax())
    return q + d - int(l_ends[x]), e + d + int(r_ends[y])


def least_run(need: int, whole: int) -> int:
    """Characters of the longest exact run of any stretch of ``need`` to ``whole`` characters: c changes leave c + 1 runs."""
    at = {need, *range(need + -need % CHANGED, min(whole, need + 2 * CHANGED) + 1, CHANGED)}
    return min(-(-(n - n // CHANGED) // (n // CHANGED + 1)) for n in at)


def _steps(need: int, whole: int, k: int) -> list[tuple[int, int]]:
    """(window, phrases): a stretch has so many phrases in the first window that holds it."""
    out, n = [], need
    while True:
        wide = min(whole, n + max(1, n // 8))
        out.append((wide, max(1, least_phrases(n, whole, k))))
        if wide == whole:
            return out
        n = wide


def stretches(passage: np.ndarray, text: np.ndarray, at: np.ndarray, pos: np.ndarray, k: int, need: int) -> list[tuple[int, int]]:
    """The spans of ``text`` that hold at least ``need`` characters of the passage in one stretch with at most one
    character in ten changed, from the phrases at passage positions ``at`` and text positions ``pos``. Any such
    stretch is about one of the exact runs that the phrases lie in."""
    single = np.unique(at)
    inside = np.zeros(len(passage) + 2, np.int64)  # parts of the passage with phrases enough for a stretch
    for wide, least in _steps(need, len(passage), k):
        if len(single) >= least:
            first = np.flatnonzero(np.searchsorted(single, single + wide - k, "right") - np.arange(len(single)) >= least)
            np.add.at(inside, single[first], 1)
            np.add.at(inside, np.minimum(single[first] + wide, len(passage)), -1)
    inside = np.cumsum(inside) > 0
    keep = inside[at]
    at, pos = at[keep], pos[keep]
    if not len(at):
        return []
    order = np.lexsort((at, pos - at))
    at, diag = at[order], (pos - at)[order]
    new = np.flatnonzero(np.concatenate(([True], (diag[1:] != diag[:-1]) | (at[1:] > at[:-1] + k))))
    runs = set()
    for a, b in zip(new, np.append(new[1:], len(at))):
        q, d = int(at[a]), int(diag[a])
        e = int(at[b - 1]) + k
        # codes may be equal where characters are not: the parts between such places
        apart = np.flatnonzero(passage[q:e] != text[q + d : e + d]) + q
        for q, e in zip([q, *(apart + 1).tolist()], [*apart.tolist(), e]):
            if q == e:
                continue
            while q and q + d > 0 and passage[q - 1] == text[q + d - 1]:
                q -= 1
            while e < len(passage) and e + d < len(text) and passage[e] == text[e + d]:
                e += 1
            runs.add((q, e, d))
    spans: list[tuple[int, int]] = []
    long, most, few = least_run(need, len(passage)), len(passage) // CHANGED, least_phrases(need, len(passage), k)
    for q, e, d in sorted(runs, key=lambda r: r[0] - r[1]):
        if e - q < long or any(a <= q + d and e + d <= b for a, b in spans):
            continue
        near = np.unique(at[np.abs(diag - d) <= most])  # phrases that a stretch about this run may hold
        if len(near) >= few and (span := _grown(passage, text, (q, e, d), need, near, k)):
            spans.append(span)
    return spans


class Shard:
    """Folded texts with a code 0 after each, so that no phrase runs across, and their index."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.texts = texts
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = np.cumsum(size) - size
        codes = np.zeros(int(size.sum()), np.uint8)
        for a, t in zip(self.begin.tolist(), texts):
            codes[a : a + len(t)] = byte_codes()[t]
        self.index = FmIndex(codes)


def leaks_of_shard(shard: Shard, phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """(text number, item number, start, end): every place, in folded characters; overlapping places are one."""
    pos, item, at = shard_hits(shard.index, phrases)
    if not len(pos):
        return []
    doc = np.searchsorted(shard.begin, pos, "right") - 1
    pos = pos - shard.begin[doc]
    pair = doc * len(phrases.ids) + item
    pair &= (1 << 22) - 1  # pairs that fall together only count for more
    enough = np.bincount(pair)[pair] >= phrases.least[item]  # others have too few phrases anywhere
    doc, item, pos, at = doc[enough], item[enough], pos[enough], at[enough]
    diag = pos - at + LONGEST
    band = phrases.band[item]
    hot = []
    for half in (0, 1):  # bands twice as wide as a stretch's spread, overlapping by half
        box = (diag + half * band) // (2 * band)
        order = np.lexsort((at, box, item, doc))
        d, i, x, a = doc[order], item[order], box[order], at[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (x[1:] != x[:-1])))[: len(order)]
        # a phrase counts once in a band
        fresh = new | np.concatenate(([True], a[1:] != a[:-1]))[: len(order)]
        first = np.flatnonzero(new)
        if not len(first):
            break
        n = np.add.reduceat(fresh.astype(np.int64), first)
        ends = np.append(first[1:], len(order))
        hot += [(int(d[first[g]]), int(i[first[g]]), order[first[g] : ends[g]]) for g in np.flatnonzero(n >= phrases.least[i[first]])]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, i, rows in hot:
        spans = found.setdefault((d, i), [])
        rows = rows[[not any(a <= x < b for a, b in spans) for x in pos[rows].tolist()]] if spans else rows
        if len(rows):
            spans += stretches(phrases.texts[i], shard.texts[d], at[rows], pos[rows], int(phrases.k[i]), int(phrases.need[i]))
    out = []
    for (d, i), spans in found.items():
        joint: list[list[int]] = []
        for a, b in sorted(spans):
            if joint and a < joint[-1][1]:
                joint[-1][1] = max(b, joint[-1][1])
            else:
                joint.append([a, b])
        out += [(d, i, a, b) for a, b in joint]
    return out


def _shards(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[list[tuple[int, str, int, np.ndarray]]]:
    """Runs of texts of about SHARD folded characters: (key, text, offset, folded). Longer texts come in pieces that
    overlap by more than a stretch."""
    run: list[tuple[int, str, int, np.ndarray]] = []
    size = 0
    step = min(SHARD, MOST - 8 - overlap)
    for b in batches:
        keys, texts = b.column("k").to_pylist(), b.column("t").to_pylist()
        folded, starts = fold(texts)
        for k, t, s, e in zip(keys, texts, starts.tolist(), starts[1:].tolist()):
            for a in range(s, max(s + 1, e - overlap), step):
                piece = folded[a : min(e, a + step + overlap)]
                if not len(piece):
                    continue
                if size and size + len(piece) > SHARD:
                    yield run
                    run, size = [], 0
                run.append((k, t, a - s, piece))
                size += len(piece) + 1
    if run:
        yield run


def leaked_spans(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str) -> DataFrame:
    """(doc_key, item_key, start_pos, end_pos): every leaked stretch of each item in each document.

    NULL and empty passages and texts leak nothing; passages of one or two letters or digits neither. A passage of a
    few characters leaks wherever two fifths of it stand. Equal passages of several items each come out. Row copies give
    a row once. Other columns are ignored.
    """
    rows = docs.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_key).cast("bigint").alias("k"), F.col(text).alias("t"))
    schema = f"`{doc_key}` bigint, `{item_key}` bigint, start_pos int, end_pos int"
    asked = [(r[0], r[1]) for r in items.select(F.col(item_key).cast("bigint"), passage).where(F.col(item_key).isNotNull()).distinct().toLocalIterator() if r[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [p for a in range(0, len(asked), BLOCK) for p in [Phrases(asked[a : a + BLOCK])] if p.groups]
        if not blocks:
            return
        # room for the longest stretch: all of a passage, a tenth inserted
        overlap = max(len(t) for p in blocks for t in p.texts) * 11 // 10 + 64
        for shard in _shards(batches, overlap):
            index = Shard([x[3] for x in shard])
            out: list[tuple[int, int, int, int]] = []
            for p in blocks:
                for d, i, a, b in leaks_of_shard(index, p):
                    key, text, offset, _ = shard[d]
                    where = fold_positions(text)[1]
                    out.append((key, int(p.ids[i]), int(where[offset + a]), int(where[offset + b - 1]) + 1))
            r = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(r[0], pa.int64()), pa.array(r[1], pa.int64()), pa.array(r[2], pa.int32()), pa.array(r[3], pa.int32())], names=[doc_key, item_key, "start_pos", "end_pos"])

    return rows.mapInArrow(run, schema).distinct()


def leaks(spans: DataFrame, doc_key: str, item_key: str) -> DataFrame:
    return spans.select(item_key, doc_key).distinct()


def removal_spans(spans: DataFrame, doc_key: str, item_key: str) -> DataFrame:
    """(doc_key, start_pos, end_pos, items): overlapping spans of a document as one."""
    w = Window.partitionBy(doc_key).orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", (F.coalesce(reach, F.lit(-1)) < F.col("start_pos")).cast("int"))
    grouped = marked.withColumn("span", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(doc_key, "span").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count_distinct(item_key).alias("items")).drop("span")
