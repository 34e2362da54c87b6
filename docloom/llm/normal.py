"""Texts without spacing, punctuation, case and width, as arrays.

A table over all code points (built once a process) maps a character to its folded form; characters
that are no letter, digit or mark of a word are dropped. All texts of a batch are folded in one step.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

DROP = 0xFFFFFFFF


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Code point -> folded code point, DROP for spacing and punctuation. Planes above the first: kept."""
    table = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x10000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            table[cp] = DROP
            continue
        folded = [c for c in unicodedata.normalize("NFKC", ch).lower() if unicodedata.category(c)[0] in "LNM"]
        table[cp] = ord(folded[0]) if folded else DROP
    return table


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points of all texts one after the other, where each text begins and the end)."""
    joined = "\x00".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not texts:
        return cps, np.zeros(1, np.int64)
    folded = fold_table()[cps]
    keep = folded != DROP
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    before = np.concatenate(([0], np.cumsum(keep)))
    starts = before[np.append(begin, len(cps))]
    return folded[keep], starts


def fold_positions(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of one text and each one's place in it."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = fold_table()[cps]
    keep = np.flatnonzero(folded != DROP)
    return folded[keep], keep


@lru_cache(1)
def byte_codes() -> np.ndarray:
    """Folded code point -> 1..254: digits and Latin letters have their own code, others share the rest."""
    cp = np.arange(0x110000, dtype=np.uint64)
    with np.errstate(over="ignore"):
        table = (37 + ((cp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(218)).astype(np.uint8)
    for i, ch in enumerate("0123456789abcdefghijklmnopqrstuvwxyz"):
        table[ord(ch)] = i + 1
    return table


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    Bit-parallel over a band: a bit for each diagonal that a path of so few edits can reach. Along the last cell's
    diagonal the distance never falls, so the first value above ``most`` ends the search.
    """
    if abs(len(a) - len(b)) > most:
        return False
    lo = 0
    hi = min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    a, b = a[lo:ea], b[lo:eb]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if most == 0:
        return False
    n, m = len(a), len(b)
    aside = (most - abs(n - m)) // 2
    least = min(0, n - m) - aside  # row minus column of the band's first bit
    width = max(0, n - m) + aside - least + 1
    full, last = (1 << width) - 1, 1 << (n - m - least)
    pv = full >> -least << -least  # rows above the first are flat
    mv, score = 0, max(0, n - m)
    chunk = max(512, width)
    for begin in range(0, m, chunk):
        where: dict[str, int] = {}
        first = begin + least
        for i in range(max(0, first), min(n, first + chunk + width)):
            ch = a[i]
            where[ch] = where.get(ch, 0) | 1 << (i - first)
        for j in range(begin, min(m, begin + chunk)):
            x = where.get(b[j], 0) >> (j - begin) & full
            d0 = (((x & pv) + pv) ^ pv) | x | mv
            if not d0 & last:
                score += 1
                if score > most:
                    return False
            hp = mv | ~(d0 | pv) & full
            hn = d0 & pv
            d0 = (d0 & full) >> 1
            pv = (hn | ~(d0 | hp)) & full
            mv = d0 & hp
    return score <= most
