"""Sentence units of texts in any of the corpus's languages and scripts.

Spaced scripts: a lattice of terminators. Every end mark is a node; abbreviations, decimals, ordinals,
list marks and protected spans (quotations and brackets of a longer sentence, of any length) remove nodes, and the
surviving nodes cut the text.

Scripts without spaces: end marks cut as above. Where there is none, gaps (line breaks in Han, kana and Thai,
blanks in Thai) are classified: the cheapest path through a word lattice tells whether a word runs across
the gap, then the final particles before it and the opening words after it decide. The dictionary, its costs, the
opening words and the final particles are counted over the whole corpus (``learn``): words are what often stands
between marks, blanks and other scripts; opening words what often follows an end mark; final particles what often
precedes one. Closed classes of function words come with the module.

Rows are independent: one pass of counts in the JVM, one Arrow pass, no shuffle but that of the counts and of row
copies' positions. NULL, empty and blank texts have no units. A text without any boundary is one unit; a text is
never cut off, however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.arrow import per_batch

END = "。！？!?．｡।؟۔"
CLOSE = "”’」』）)】》〉»\"'］]"
_CLOSERS = re.compile(r"(?:[   ]?»|[”’」』）)】》〉\"'］\]])*(?:\[\d{1,3}\])*")
_NODE = re.compile(rf"[{END}]+[.。…]*|\.+|\n\s*")
_THAI_NODE = re.compile(rf"[{END}]+[.。…]*|\.+|\n\s*|(?<=\S)[  　]+(?=\S)")
_THAI = re.compile(r"[฀-๿]")
_SPACELESS = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
_PAIRS = re.compile(r"“[^“”]+”|「[^「」]+」|『[^『』]+』|（[^（）]+）|\([^()]+\)|«[^«»]+»|„[^„“”]+[“”]|\"[^\"\n]+\"|\[[^\[\]]+\]|【[^【】]+】")

# Abbreviations that never end a sentence, those that don't before a number, and those that do before a capital.
NEVER = frozenset("cf dr mr mrs ms prof st bzw ca vgl bspw ggf inkl zzgl evtl sog hrsg sr sra srs sras dª dña d. approx viz vs e.g i.e z z.b d.h u.a o.ä apr mme mlle mm ap".split())
NUMBERED = frozenset("no nos art arts sec secs nr abs pág págs núm núms ex fig figs vol vols pp p ch par para est dept ref refs reg av tel bd n.º nº cap jan feb mar jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic".split())
MAYBE = frozenset("etc p.m a.m usw u.s.w ltd inc co corp bros et al ph.d m.d b.v s.a".split())
_ORDINAL_NOUNS = re.compile(r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Lebensjahr|Tag|Monat|Geburtstag|Versicherungsjahr)")
_TOKEN = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]+$")
_DIGITS = re.compile(r"(?:^|(?<=[\s(]))\d{1,3}$")

_LIST = re.compile(r"[ \t　]*(?:\d{1,3}(?:、|[.．](?![\d.])|[)）])|\(\d{1,3}\)|（\d{1,3}）|[（(][一二三四五六七八九十]{1,3}[）)]|[一二三四五六七八九十]{1,3}、|[①-⑳]|[•●▪◦·]|[-*–—][ \t])")
_FOOTER = re.compile(r"[ \t　]*(?:第\s*\d+\s*[页頁](?:\s*[/／共]\s*.{0,8})?|(?:[Pp]age|PAGE|[Ss]eite|[Pp]ágina|หน้า|पृष्ठ|صفحة|페이지)\s*\d+(?:\s*(?:of|von|de|sur|/)\s*\d+)?|\d+\s*(?:쪽|페이지|ページ|頁)|[-–—]\s*\d+\s*[-–—]|\d{1,4}\s*/\s*\d{1,4})[ \t]*(?=\n|$)")
_NUM = r"[0-9０-９一二三四五六七八九十百零〇]{1,6}"
_HEADING = re.compile(
    rf"[ \t　﻿]*(?:第\s*{_NUM}\s*[条條章节節款編编](?:[ 　\t]+[^\n。，；：,;.]{{1,24}}|[^\n。，；：,;.、]{{0,14}})|제\s*\d+\s*[조장절][^\n.]{{0,30}}|(?:Section|SECTION|Article|ARTICLE|Clause|Chapter|Part|Artikel|Abschnitt|Artículo|Sección|Capítulo|Artigo|Cláusula|Seção|Cláusula|Annex|Schedule|§)\s*[\dIVX]+(?:\.\d+)*\s*[:.–—-]?\s*[^\n.!?;]{{0,60}}|(?:मद|धारा|अनुच्छेद|المادة|البند|ข้อ|มาตรา)\s*\d+\s*[:.–—-]?\s*[^\n।.]{{0,40}}|【[^】\n]{{1,20}}】|#{{1,6}}\s[^\n]{{1,60}})[ \t]*(?=\n|$)"
)
_LABEL = re.compile(r"[ \t　]*[^\W\d_][^\n：:，。,.；;？?！!“”\"「」（）()]{0,14}[：:](?![：:“\"「])[^\n。！？!?।]+(?=\n|$)")
_BARE_LABEL = re.compile(r"[ \t　]*[^\n：:，。,.；;？?！!“”\"「」]{1,14}[：:][ \t]*(?=\n|$)")

# Closed classes of Han script and kana: function words that open a sentence, and particles that end one.
_OPENS_HAN = re.compile(r"(?:除|在|如|若|依|就|经|自|当|于|以\d|因|对于|本|该|但|并且|同一|「|“|[A-Z])")
_FINAL_HAN = re.compile(r"(?:[了吗呢吧]|ます|です|ません|した|[%％])$")
# Thai: opening words, subject nouns, words that continue a sentence, predicates and final particles.
_OPENS_THAI = re.compile(r"(?:หาก|ถ้า|เมื่อ|ในระหว่าง|ระหว่างที่|สำหรับ|เว้นแต่|หลังพ้น|หลังจาก|ภายหลัง|ก่อน|กรณี|ในกรณี|อย่างไรก็ตาม|นอกจากนี้|ทั้งนี้|ดังนั้น|ตามข้อ|ตามมาตรา)")
_SUBJECT_THAI = re.compile(r"(?:ผู้|บริษัท|ฝ่าย|เรา|คุณ|ท่าน|กรมธรรม์|สัญญา|เอกสาร|ค่า|การ|ข้อ)")
_GOES_ON_THAI = re.compile(r"(?:วัน|ปี|เดือน|บาท|ครั้ง|สตางค์|เปอร์เซ็นต์|ชั่วโมง|ภายใน|โดย|และ|หรือ|ที่|ซึ่ง|แต่|ของ|จาก|ถึง|ต่อ|ตาม|แก่|ให้|เป็น|ต้อง|จะ|[0-9๐-๙０-９(/%])")
_PREDICATE_THAI = re.compile(r"จะ|ต้อง|มีสิทธิ|สามารถ|ไม่ได้|ครับ|ค่ะ|คะ|แล้ว")


#: words of the dictionary at most, and the least number of times that a word, opening or ending must occur
WORDS, OFTEN = 20_000, 3
#: share of all sentence ends (and beginnings) that makes an ending (opening) one
SHARE = 0.001


class Lexicon:
    """Words with their costs, opening words (two characters in Han and kana, four in Thai) and final particles."""

    def __init__(self, words: dict[str, int] | None = None, opens: Iterable[str] = (), finals: Iterable[str] = ()) -> None:
        words = words or {}
        total = sum(words.values()) or 1
        self.costs = {w: -math.log(n / total) for w, n in words.items()}
        self.longest = max(map(len, words), default=1)
        self.unknown = 1.0 + max(self.costs.values(), default=0.0)
        self.opens, self.finals = frozenset(opens), frozenset(finals)
        self._known: dict[tuple[str, str], bool] = {}

    def __reduce__(self) -> tuple:
        return _lexicon, (self.costs, self.longest, self.unknown, self.opens, self.finals)

    def across(self, left: str, right: str) -> bool:
        """Whether the cheapest path through the word lattice of left + right runs across the gap.

        Nodes are the characters' borders, edges the dictionary's words and single characters.
        """
        got = self._known.get((left, right))
        if got is None:
            if len(self._known) > 1 << 16:
                self._known.clear()
            got = self._known[left, right] = self._across(left + right, len(left))
        return got

    def _across(self, text: str, gap: int) -> bool:
        inf = float("inf")
        best = [[0.0, inf]] + [[inf, inf] for _ in text]
        for i in range(len(text)):
            if min(best[i]) == inf:
                continue
            for n in range(1, min(self.longest, len(text) - i) + 1):
                cost = self.costs.get(text[i : i + n], self.unknown if n == 1 else None)
                if cost is None:
                    continue
                over = i < gap < i + n
                for k in (0, 1):
                    to = 1 if over or k else 0
                    best[i + n][to] = min(best[i + n][to], best[i][k] + cost)
        return best[-1][1] < best[-1][0]


def _lexicon(costs: dict[str, float], longest: int, unknown: float, opens: frozenset[str], finals: frozenset[str]) -> Lexicon:
    out = Lexicon()
    out.costs, out.longest, out.unknown, out.opens, out.finals = costs, longest, unknown, opens, finals
    return out


PLAIN = Lexicon()


def learn(df: DataFrame, text: str) -> Lexicon:
    """The lexicon of a corpus, from counts over all its texts; at most WORDS words, openings and endings each."""
    t = F.coalesce(F.col(text), F.lit(""))
    find = lambda rx, g=0: F.regexp_extract_all(t, F.lit(rx), F.lit(g))
    kinds = {
        "word": F.concat(find(r"(?<![㐀-鿿])[㐀-鿿]{2,6}(?![㐀-鿿])"), find(r"(?<![぀-ヿ㐀-鿿])[぀-ヿ㐀-鿿]{2,8}(?![぀-ヿ㐀-鿿])"), find(r"(?<![฀-๿])[฀-๿]{2,12}(?![฀-๿])")),
        "open": F.concat(find(r"[。！？]\s*([぀-ヿ㐀-鿿]{2})", 1), find(r"(?:^|\n)([฀-๿]{4})", 1)),
        "final": find(r"([぀-ヿ㐀-鿿]{2})[。！？]", 1),
    }

    def marked(kind: str) -> Callable[[Column], Column]:
        return lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w"))

    rows = df.select(F.explode(F.concat(*(F.transform(a, marked(k)) for k, a in kinds.items()))).alias("x")).groupBy("x.kind", "x.w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "w")
    found = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= WORDS).select("kind", "w", "n").collect()
    by: dict[str, dict[str, int]] = {k: {} for k in kinds}
    for r in found:
        by[r["kind"]][r["w"]] = r["n"]

    def usual(counts: dict[str, int]) -> list[str]:
        total = sum(counts.values())
        return [x for x, n in counts.items() if n >= SHARE * total]

    thai = {k: n for k, n in by["open"].items() if "฀" <= k[0] <= "๿"}
    return Lexicon(by["word"], usual({k: n for k, n in by["open"].items() if k not in thai}) + usual(thai), usual(by["final"]))


def _thai_gap(before: str, after: str, lex: Lexicon) -> bool:
    """Whether a blank between Thai clauses ends a sentence; ``before`` is the sentence so far."""
    if _GOES_ON_THAI.match(after):
        return False
    if not _PREDICATE_THAI.search(before):
        return False
    return bool(_OPENS_THAI.match(after) or _SUBJECT_THAI.match(after) or after[:4] in lex.opens or "A" <= after[0] <= "Z" and before[-1:] in "ะคนบ")


def _line_gap(text: str, start: int, at: int, after: int, prev_line: int, lex: Lexicon) -> bool:
    """Whether a line break that no end mark precedes is a boundary between sentences."""
    right = text[after : after + 12]
    left = text[max(start, at - 12) : at]
    if _THAI.search(left[-4:]) or _THAI.match(right):
        return not lex.across(left, right) and _thai_gap(text[start:at], right, lex)
    if not (_SPACELESS.match(left[-1:]) or _SPACELESS.match(right[:1])):
        return False
    if lex.across(left[-8:], right[:8]):
        return False
    if not ((_FINAL_HAN.search(left) or left[-2:] in lex.finals) and (_OPENS_HAN.match(right) or right[:2] in lex.opens)):
        return False
    # a line that was wrapped is about as long as the one after it; a short one ended by itself
    nl = text.find("\n", after)
    nxt = (len(text) if nl < 0 else nl) - after
    return nl >= 0 and (at - prev_line) + 6 < nxt or (at - prev_line) < 8


def _period_ends(text: str, start: int, at: int, dots: int, after: int) -> bool:
    """Whether the full stop(s) at ``at`` end a sentence; ``after`` is past closing marks."""
    n = len(text)
    if dots >= 3 and after < n and not text[after].isspace():
        return False
    if after >= n:
        return True
    nxt = text[after]
    if not nxt.isspace():
        if nxt in ";；,，、:：":
            return False
        return after > at + dots and nxt.isupper() or (nxt > "⿿" and text[at - 1 : at].isalpha() and text[at - 1] < "ɐ" and not _TOKEN.search(text[max(0, at - 12) : at])[0].lower() in NEVER)
    if dots >= 2:
        return True
    k = after
    while k < n and text[k].isspace():
        k += 1
    if k >= n:
        return True
    first = text[k]
    line_end = "\n" in text[after:k]
    prev = text[at - 1] if at else ""
    if prev.isdigit():
        m = _DIGITS.search(text[max(0, at - 8) : at])
        if m and at - len(m[0]) >= 0:
            b = at - len(m[0])
            head = text[max(0, b - 40) : b]
            if not head.strip() and b <= 40 or "\n" in head and not head[head.rfind("\n") :].strip():
                return False  # a list mark
            if _ORDINAL_NOUNS.match(text, after):
                return False
        return not first.islower()
    m = _TOKEN.search(text[max(0, at - 14) : at])
    if m:
        token = m[0].lower()
        if token in NEVER or token in NUMBERED and (first.isdigit() or first in "IVXLC" and not text[k + 1 : k + 2].islower()):
            return False
        if token in MAYBE:
            return not (first.islower() or first.isdigit() or first in ",;(")
        if len(m[0]) == 1 and m[0].isupper() and m[0].isascii():
            return line_end
    return not first.islower() and first not in ",;:，；：、"


def _is_line(text: str, at: int, complete: bool) -> int:
    """End of the heading, footer or label line that begins at ``at``, or -1."""
    for rx in (_FOOTER, _HEADING):
        if m := rx.match(text, at):
            return m.end()
    if complete:
        for rx in (_LABEL, _BARE_LABEL):
            if m := rx.match(text, at):
                return m.end()
    return -1


def _heading_after(text: str, at: int, cuts: list[int]) -> int:
    """A heading may follow a sentence on its line; it is cut as a unit then. Where the next unit begins."""
    k = at
    while k < len(text) and text[k] in " \t\u3000":
        k += 1
    m = _HEADING.match(text, k) if k < len(text) and text[k] not in "\n" else None
    if not m or m.end() >= len(text):
        return at
    cuts.append(m.end())
    return m.end()


def boundaries(text: str, lex: Lexicon = PLAIN) -> list[int]:
    """Positions at which a unit ends (the text's end included)."""
    spans = [(m.start(), m.end()) for m in _PAIRS.finditer(text) if m.end() - m.start() > 3 and "\n\n" not in m[0] and not (m[0][0] in '"(' and "\n" in m[0] and _LIST.search(m[0]))]
    cuts: list[int] = []
    n, si, start, line = len(text), 0, 0, 0
    node = _THAI_NODE if _THAI.search(text) else _NODE
    pos = 0
    lead = len(text) - len(text.lstrip())
    e = _is_line(text, lead, True)
    if e >= 0 and e < n:
        cuts.append(e)
        start = pos = e
    while m := node.search(text, pos):
        a, b = m.span()
        mark = m[0]
        pos = b
        while si < len(spans) and spans[si][1] <= a:
            si += 1
        if mark[0] == "\n":
            nxt = text[b : b + 1]
            unit = text[start:a].strip()
            if not unit or not nxt:
                line = b
                if nxt and not unit and (e := _is_line(text, b, True)) >= 0:
                    cuts.append(e)
                    start = pos = e
                continue
            inside = si < len(spans) and spans[si][0] < a < spans[si][1]
            if inside:
                line = b
                continue
            if nxt in END or nxt in CLOSE and nxt not in "\"'" or nxt in ",，、；;：:.…":
                line = b
                continue
            e = -1
            cut = mark.count("\n") > 1 or bool(_LIST.match(text, b)) or (e := _is_line(text, b, False)) >= 0 or unit[-1] in ";；" and bool(_LIST.match(unit)) or _line_gap(text, start, a, b, line, lex)
            line = b
            if cut:
                cuts.append(a)
                start = a
                if e < 0:
                    e = _is_line(text, b, True)
                if e >= 0:
                    cuts.append(e)
                    start = pos = e
            continue
        if mark[0] in "  　":
            if si < len(spans) and spans[si][0] < a < spans[si][1]:
                continue
            if not (_THAI.match(text, b) or _THAI.search(text[max(0, a - 3) : a]) or text[a - 1].isdigit()):
                continue
            if _THAI.search(text[start:a]) and (_THAI.match(text, b) or "A" <= text[b] <= "Z") and _thai_gap(text[start:a], text[b : b + 16], lex):
                cuts.append(a)
                start = a
                pos = max(pos, _heading_after(text, start, cuts))
                start = max(start, cuts[-1])
            continue
        if si < len(spans) and spans[si][0] < a < spans[si][1]:
            s0, s1 = spans[si]
            if _CLOSERS.match(text, b).end() < s1 and text[b:s1].strip(CLOSE + "  "):
                continue  # inside a quotation or bracket
            end = _CLOSERS.match(text, max(b, s1)).end()
            follows = text[end : end + 24].lstrip("  \t")
            pos = max(b, end)
            if text[s0] in "(（[【" and text[start:s0].strip():
                continue
            if not follows:
                cuts.append(end)
                start = end
                continue
            if follows[0] == "\n":
                if text[start:s0].strip() and _SPACELESS.match(follows.lstrip()[:1]) and not (_OPENS_HAN.match(follows.lstrip()) or follows.lstrip()[:2] in lex.opens) and "\n\n" not in follows:
                    continue
                if follows.lstrip()[:1] in END or follows.lstrip()[:1].islower():
                    continue
            elif text[start:s0].strip():  # opened within the sentence
                spaced = text[end : end + 1].isspace() and not _SPACELESS.match(follows) and (follows[0].isupper() or follows[0] in "¿¡«„" or "֐" < follows[0] < "฀" and mark[0] in ".।؟")
                if not spaced or follows[0].isupper() and not text[end : end + 1].isspace():
                    continue
            elif follows[0] in "，,、；;：:的字とや라는高" or follows[0].islower() or follows[0] in END or follows.startswith(("という", "라고", "と")):
                continue
            cuts.append(end)
            start = pos = _heading_after(text, end, cuts)
            continue
        end = _CLOSERS.match(text, b).end()
        if mark[0] == ".":
            if text[a - 1 : a].isdigit() and text[b : b + 1].isdigit() or not _period_ends(text, start, a, len(mark), end):
                continue
        elif mark[0] == "．" and (text[a - 1 : a].isdigit() and text[b : b + 1].isdigit() or re.fullmatch(r"\s*\d{1,3}", text[text.rfind("\n", 0, a) + 1 : a] or "x")):
            continue
        elif mark[0] in "!?" and (text[end : end + 1] in tuple(",，、;；") or end > b and text[end : end + 12].lstrip()[:1].islower()):
            continue
        if text[end : end + 1] in (";", "；") and not text[end + 1 : end + 2].strip():
            end += 1
        cuts.append(end)
        start = pos = max(end, b)
        pos = start = _heading_after(text, start, cuts)
    cuts.append(n)
    return cuts


def units(text: str | None, lex: Lexicon = PLAIN) -> list[tuple[int, int]]:
    """(start, end) of each unit in code points, without outer white space."""
    if not text:
        return []
    out, s = [], 0
    for e in boundaries(text, lex):
        if e <= s:
            continue
        piece = text[s:e]
        body = piece.strip()
        if body:
            a = s + len(piece) - len(piece.lstrip())
            out.append((a, a + len(body)))
        s = e
    return out


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos), one row per unit; row copies give their units once."""
    lex = learn(df, text)

    def work(cols: dict[str, list]) -> dict[str, pa.Array]:
        ids, starts, ends = [], [], []
        for i, t in zip(cols["k"], cols["t"]):
            u = units(t, lex)
            ids += [i] * len(u)
            starts += [x[0] for x in u]
            ends += [x[1] for x in u]
        return {key: pa.array(ids, pa.int64()), "start_pos": pa.array(starts, pa.int32()), "end_pos": pa.array(ends, pa.int32())}

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return per_batch(rows, work, f"`{key}` bigint, start_pos int, end_pos int").distinct()
