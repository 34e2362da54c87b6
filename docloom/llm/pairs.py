"""Broken question-answer pairs, by a multi-label linear classifier.

Training. At most ``SAMPLE`` rows (by hash of the key; the bound of the fit) are the material. Defective answers are
made from them by an operation, which is the label: cut inside a sentence, replaced by the question, by an answer in
another language, by a refusal or by nothing. Sound ones are the rows that no exact feature speaks against, also with a
greeting before them, shortened to whole sentences, or in the language that the question is made to ask for. Features
are hashed character n-grams of the answer and of its last characters, and features of the pair (how it ends, open
brackets, overlap with the question, languages). One logistic regression per defect; its threshold is calibrated on
held-out pairs: the one with the best F1, nearest to the middle of those that are as good.

Scoring. Rows are independent: one Arrow pass with the weights (some 100 kB) in the function. ``defective_pairs`` gives
a row the defect that is over its threshold by most, or all that are over (``every``).
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import langid
from docloom.llm.arrow import per_batch

DEFECTS = ("empty", "copy", "refusal", "wrong_language", "truncated")
SAMPLE = 1000
WIDTH, TAIL, EXACT = 4096, 2048, 14

_HEADINGS = re.compile(r"【[^】]{0,12}】|\[[^\]\n]{0,12}\]\s*$|^\s*#{1,6}[^\n]*$|\*\*[^*\n]{0,16}\*\*|^\s*(?:answer|response|reply|result|conclusion|antwort|réponse|respuesta|resposta|答|回答|答案|回复|结论|答复|回答内容|答え|답변)\s*[:：]", re.I | re.M)
_CODE = re.compile(r"```\w*")
_PLACEHOLDERS = frozenset("null none nil na n/a nan tbd todo undefined empty blank noanswer unknown placeholder 无 暂无 空 待补充 待定 略 未填写 暂无回答 なし 未定 없음 keine leer ninguno aucun".split())
_INVISIBLE = re.compile("[​-‏⁠﻿­᠎]")
_ENDS = re.compile(r"(?:[。！？!?．।؟.]|……)[”’」』）)】》〉»\"'*_`~\s]*$")
_CITED = re.compile(r"(?:\[\d{1,3}\]|\[\^\d+\]|［\d+］|【\d+】|\(\d{1,2}\)|[①-⑳]|⁰?[¹²³⁴-⁹]+)\s*$")
_LIST_LINE = re.compile(r"^\s*(?:[-*•·●▪–]|\d{1,2}[.、)）]|[（(]\d{1,2}[)）])\s*\S.*$")
_CUT_TAIL = re.compile(r"(?:[，,、；;：:（(“‘「『《—-]|而且|并且|以及|但是|因为|and the|and|but|because|the|of|to|und|oder|weil|および|または|そして|（参见|\(cf|\(see)\s*$", re.I)
_OPEN = {"（": "）", "(": ")", "“": "”", "「": "」", "『": "』", "《": "》", "【": "】", "[": "]", "«": "»"}

_SHUT = frozenset(_OPEN.values())
_WHOLE = re.compile(r"[^。！？\n]+[。！？]|[^\n。]+?[.!?](?=\s[A-ZÄÖÜ]|$)")

# Ways to ask for an answer in a language, by the language's names.
ASKED = {
    "en": r"英文|英语|英語|\benglish\b|\benglisch|\banglais\b|\binglés\b|영어", "zh": r"中文|汉语|中国語|\bchinese\b|\bchinesisch|\bmandarin\b|중국어", "ja": r"日文|日语|日本語|\bjapanese\b|\bjapanisch|일본어", "de": r"德文|德语|ドイツ語|\bgerman\b|\bdeutsch|독일어",
    "fr": r"法文|法语|フランス語|\bfrench\b|\bfranzösisch|\bfrançais", "es": r"西班牙|スペイン語|\bspanish\b|\bspanisch|\bespañol", "pt": r"葡萄牙|ポルトガル語|\bportuguese\b|\bportugiesisch|\bportuguês", "ko": r"韩文|韩语|韓国語|\bkorean\b|\bkoreanisch|한국어", "th": r"泰文|泰语|タイ語|\bthai\b|\bthailändisch|ไทย", "hi": r"印地|ヒンディー|\bhindi\b|हिन्दी|हिंदी", "ar": r"阿拉伯|アラビア|\barabic\b|\barabisch|العربية",
}
_ASKED = {k: re.compile(v, re.I) for k, v in ASKED.items()}

# Refusals to learn from: {t} is the matter, {s} who speaks.
REFUSALS = {
    "zh": (
        "恕我不能就{t}给出答复", "现有材料不足以支持回答，无法给出结论", "该问题超出了我的能力范围，无法协助", "抱歉，暂时不能提供有关{t}的信息，请咨询人工客服", "您的提问涉及敏感信息，已被系统拦截，不予回应", "作为智能助手，我不便对{t}发表意见", "很抱歉，我无法回答这个问题", "对不起，这类内容我帮不上忙，建议您联系所在地的服务网点", "不好意思哈，这个我真的不清楚，没办法告诉您", "目前资料库里没有相关记录，请换个问法再试", "未检索到与{t}有关的内容，因此无法作答", "出于合规考虑，我们拒绝就{t}作出说明", "我没法给您一个说法", "我没有权限回复", "暂不支持解答", "不在服务范围之内", "我们不提供此类意见", "目前不便透露", "只能婉拒", "恐怕帮不了您", "关于{t}，本助手不作回应", "恕不奉告", "这个问题我答不上来", "我不能提供帮助", "本系统无法处理该请求", "根据规定不能对{t}予以答复", "还请另询他人", "很遗憾，无从判断，也就不作答复", "系统不予处理", "此问题暂不受理",
    ),
    "en": (
        "as for {t}, I am unable to say anything", "regarding your question, I have to pass on this one", "this assistant will not respond", "As an assistant I am not able to comment on {t}", "Sorry, I don't have any information on {t} and won't be able to answer", "We must decline to respond to this enquiry", "This request is outside what I am allowed to discuss", "I cannot assist with questions about {t}; please call the service desk", "I'm sorry, but I can't help with that", "I am afraid I cannot answer this", "Unfortunately we are not in a position to advise on {t}", "I do not have access to that information", "No relevant material was found, so no answer can be given", "For compliance reasons I cannot discuss {t}", "on this matter we give no opinion", "I would rather not say", "This is beyond my abilities", "I do not know the answer to that", "we do not offer advice of this kind", "no reply can be given", "that falls outside our service", "we do not give opinions here", "I must leave this unanswered",
    ),
    "de": (
        "Es tut mir leid, dazu kann ich keine Auskunft geben", "Leider kann ich zu {t} keine Antwort geben, bitte haben Sie Verständnis", "Leider können wir hierzu keine Antwort geben", "Zu {t} darf ich mich nicht äußern", "Diese Anfrage kann ich nicht bearbeiten", "Dazu liegen mir keine Informationen vor", "Hierzu möchte ich nichts sagen", "Als Assistent kann ich {t} nicht kommentieren", "Das liegt außerhalb meiner Zuständigkeit", "Aus Compliance-Gründen müssen wir die Antwort ablehnen", "Ich kann Ihnen dabei nicht helfen",
    ),
    "ja": (
        "申し訳ございませんが、{t}についてはお答えできません", "恐れ入りますが、この質問には回答いたしかねます", "その件についてはお答えできかねます", "ご質問の内容は対応範囲外です", "該当する資料が見つからないため、回答できません", "コンプライアンス上の理由により、{t}に関する説明は控えさせていただきます", "アシスタントとして{t}についてコメントすることはできません", "情報がないため分かりかねます", "お力になれません", "回答を差し控えます", "お役に立てず申し訳ありません", "対象外となっております", "恐れ入りますが、対応いたしかねます", "{t}については回答を差し控えさせていただきます", "お答えする立場にございません",
    ),
    "fr": ("Désolé, je ne peux pas répondre à cette question", "Je ne suis pas en mesure de commenter {t}", "Cette demande dépasse mes compétences", "Malheureusement, nous ne donnons pas d'avis sur {t}"),
    "es": ("Lo siento, no puedo responder a esta pregunta", "No puedo dar información sobre {t}", "Esta consulta está fuera de mi alcance", "Lamentablemente no damos opiniones sobre {t}"),
    "pt": ("Desculpe, não posso responder a esta pergunta", "Não tenho informações sobre {t}", "Infelizmente não podemos comentar {t}"),
    "ko": ("죄송합니다만 이 질문에는 답변드릴 수 없습니다", "{t}에 대해서는 말씀드리기 어렵습니다", "해당 정보를 제공할 수 없습니다"),
    "th": ("ขออภัย ไม่สามารถตอบคำถามนี้ได้", "เราไม่สามารถให้ข้อมูลเกี่ยวกับ {t} ได้", "คำถามนี้อยู่นอกเหนือขอบเขตการให้บริการ"),
    "hi": ("क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता", "{t} के बारे में जानकारी उपलब्ध नहीं है", "यह अनुरोध मेरी सीमा से बाहर है"),
    "ar": ("عذرا، لا يمكنني الإجابة عن هذا السؤال", "لا أستطيع تقديم معلومات عن {t}", "هذا الطلب خارج نطاق عملي"),
}
LEADS = {"zh": ("您好，", "很遗憾，", "十分抱歉，", "感谢提问。", "经评估，", "就您提到的情况，", "对于这个问题，", "关于{t}，", "涉及{t}的事项，", "【结论】\n", ""), "en": ("Hello, ", "After review, ", "Thank you for asking. ", "Regrettably, ", "regarding your question, ", "on this matter ", "as for {t}, ", ""), "de": ("Guten Tag, ", "Bedaure, ", "Zu Ihrer Frage: ",  "Nach Prüfung: ", "Leider: ", ""), "ja": ("あいにく、", "恐縮ですが、", "この件は", "ご質問の内容は", "お問い合わせありがとうございます。", "恐縮ですが、", "{t}については、", "")}
TAILS = {"zh": ("。", "", "，敬请谅解。", "，请拨打客服热线。", "，请见谅！", "。如需帮助请联系服务网点。"), "en": (".", "", "; please ask an adviser.", ", thank you for understanding.", ". Please contact the branch."), "de": (".", "", ". Bitte wenden Sie sich an die Filiale.", ", bitte haben Sie Verständnis."), "ja": ("。", "", "。担当窓口までお問い合わせください。", "。窓口へご相談ください。", "。ご了承ください。")}
TOPICS = {"zh": ("免赔额", "等待期", "退保", "续保条件", "理赔时效", "保单贷款"), "en": ("nursing care", "the deductible", "room charges", "dental repair"), "de": ("Pflege", "Hilfsmittel", "Rückkaufswert"), "ja": ("免責事由", "解約", "保険料", "告知義務")}
# Ways to ask for an answer in a language ({n}: its name in the question's language), to make sound pairs from.
ASK = {"zh": ("请用{n}回答", "（{n}答复即可）", "，麻烦给我{n}版的回答。"), "ja": ("{n}で答えてください", "（{n}でお願いします）"), "en": (" Please answer in {n}.", " (in {n}, please)"), "de": (" Bitte auf {n} antworten.", " (auf {n}, bitte)")}
NAMES = {"zh": {"en": "英文", "zh": "中文", "ja": "日文", "de": "德文", "fr": "法文", "es": "西班牙文"}, "ja": {"en": "英語", "zh": "中国語", "de": "ドイツ語", "fr": "フランス語"}, "en": {"en": "English", "zh": "Chinese", "ja": "Japanese", "de": "German", "fr": "French", "es": "Spanish"}, "de": {"en": "Englisch", "zh": "Chinesisch", "ja": "Japanisch", "fr": "Französisch"}}
QUESTION_LEADS = ("", "您问的是", "问：", "Q: ", "> ", "Your question: ", "You asked: ", "Ihre Frage: ", "ご質問：", "问题：", "“")
NOTHING = ("", " ", "null", "N/A", "-", "……", "...", "**", "{}", "[]", "None", "答：", "Answer: ", "【结论】\n\n【依据】\n\n【边界】\n", "```\n```", "　")
SHORT = ("27日", "能，最高50万元", "否，第52条已除外。", "可以，比例为8%。", "不可以，需满68天。", "71天。", "43 days.", "Yes, up to 80%.", "No, Section 12 excludes it.", "Ja, bis zu 50 Prozent.", "Nein.", "はい、30日以内です。", "是的", "可以", "不能。", "Yes.", "No")


def bare(text: str) -> str:
    """Letters and digits only, without case and width."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).lower())


def says_nothing(text: str | None) -> bool:
    """Nothing beyond blanks, marks, headings or a placeholder."""
    if text is None:
        return True
    body = _HEADINGS.sub(" ", _CODE.sub(" ", _INVISIBLE.sub("", text)))
    core = bare(body)
    return not core or core in _PLACEHOLDERS or unicodedata.normalize("NFKC", body).strip().lower().strip("<>[](){}\"'.-* ") in _PLACEHOLDERS


def repeats_question(question: str, answer: str) -> float:
    """1.0: only the question again after a lead-in; else the share of the answer that is the question."""
    q, a = bare(question), bare(answer)
    if not q or not a:
        return 0.0
    at = a.find(q)
    if at < 0:
        return 0.0
    lead = a[:at]
    rest = a[at:].replace(q, "")
    wide = any(c > "⺀" for c in lead)
    if (not lead or len(lead) <= (12 if wide else 30) and not any(c.isdigit() for c in lead)) and (not rest or rest == lead or lead and not rest.replace(lead, "")):
        return 1.0
    return min(0.8, len(q) / len(a))


def breaks_off(text: str) -> int:
    """0: the text ends well, 1: no end mark, 2: within a bracket or quotation, or at a word that goes on."""
    t = _INVISIBLE.sub("", text).rstrip()
    if not t:
        return 0
    if _CUT_TAIL.search(t) and not t.endswith("-") or t.endswith("-") and not t.endswith("\n-"):
        return 2
    last = t[t.rfind("\n") + 1 :]
    if _LIST_LINE.match(last):
        return 0
    if _CITED.search(t):
        return 0
    if _ENDS.search(t):
        stack: list[str] = []
        for ch in t:
            if ch in _OPEN:
                stack.append(_OPEN[ch])
            elif stack and ch in _SHUT and ch in stack:
                while stack.pop() != ch:
                    pass
        tail = t.rstrip("*_`~ ")
        if stack and stack[-1] not in tail[-3:]:
            return 2
        if t.endswith(".") and re.search(r"(?:\b(?:No|Art|Sec|Dr|cf|Nr|Abs|bzw|i\.e|e\.g|approx)\.)$", t):
            return 2
        return 0
    return 1


# Scripts that settle a language on their own, in the order they are looked at: (language, letters, share).
_SCRIPTS = (
    ("ja", re.compile("[぀-ヿ]"), 0.08),
    ("ko", re.compile("[가-힯]"), 0.3),
    ("th", re.compile("[฀-๿]"), 0.3),
    ("hi", re.compile("[ऀ-ॿ]"), 0.3),
    ("ar", re.compile("[؀-ۿ]"), 0.3),
    ("zh", re.compile("[㐀-鿿]"), 0.3),
)
_LATIN = ("de", "en", "es", "fr", "pt")


def _language(texts: list[str], profiles: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text and how clear it is (0..1); '' where there is too little to tell.

    A script that one language uses decides; Latin script goes to the nearest profile.
    """
    words = [langid._letters(t) for t in texts]
    d = langid.distances(words, profiles)[:, [langid.LANGS.index(c) for c in _LATIN]]
    two = np.partition(d, 1, axis=1)[:, :2]
    margin = np.minimum(1.0, 5 * (1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)))
    out = []
    for i, w in enumerate(words):
        n = len(w.replace(" ", ""))
        c = next((c for c, rx, share in _SCRIPTS if n and len(rx.findall(w)) >= share * n), None)
        if c:
            margin[i] = 1.0
        elif n >= 12 and margin[i] >= (0.1 if n >= 80 else 0.35):
            c = _LATIN[int(d[i].argmin())]
        out.append(c or "")
    return out, margin


def adapted_profiles(rows: list[tuple[str, str]]) -> np.ndarray:
    """Profiles that know the answers' own words: the seeds classify the long answers of the sample, and
    these are added to their language."""
    profiles = langid.fit([])
    long_ = [a for _, a in rows if a and len(a) >= 60]
    langs, _ = _language(long_, profiles)
    return langid.fit([(c, t) for c, t in zip(langs, long_) if c])


def _ngrams(text: str, salt: int, out: np.ndarray) -> None:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return
    with np.errstate(over="ignore"):
        h = c + np.uint64(salt)
        for n in (1, 2, 3, 4):
            if n > 1:
                if len(c) < n:
                    break
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
                g = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)
                np.add.at(out, g.astype(np.int64) % len(out), 1.0)


def features(questions: list[str], answers: list[str | None], profiles: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """(rows x features, exact facts of each row)."""
    texts = [a or "" for a in answers]
    ql, qm = _language(questions, profiles)
    al, am = _language(texts, profiles)
    x = np.zeros((len(texts), WIDTH + TAIL + EXACT), np.float32)
    facts = []
    for i, (q, a) in enumerate(zip(questions, texts)):
        nothing = says_nothing(answers[i])
        rep = 0.0 if nothing else repeats_question(q, a)
        cut = 0 if nothing else breaks_off(a)
        core = re.sub(r"\d[\d,.]*", "0", _INVISIBLE.sub("", a)).lower()
        asked = al[i] in _ASKED and bool(_ASKED[al[i]].search(q))
        other = bool(al[i] and ql[i] and al[i] != ql[i] )
        short = len(bare(a)) <= 24
        last = core.rstrip()[-10:] + "\x03"
        for part, text, salt in ((x[i, :WIDTH], core, 7), (x[i, WIDTH : WIDTH + TAIL], last, 11)):
            _ngrams(text, salt, part)
            np.sqrt(part, out=part)
            part /= max(1e-6, float(np.linalg.norm(part)))
        line = a.rstrip().rsplit("\n", 1)[-1]
        listed = bool(_LIST_LINE.match(line))
        # exact features weigh more than an n-gram
        x[i, WIDTH + TAIL :] = 5.0 * np.array((nothing, rep, rep == 1.0, cut == 1, cut == 2, cut == 1 and not short, other and not asked, other and asked, (other and not asked) * am[i], short, min(2.0, len(a) / 200), cut == 0, listed, listed and not _ENDS.search(line)))
        facts.append({"sound": not nothing and rep < 1.0 and cut == 0 and not (other and not asked)})
    return x, facts


class Model:
    """Weights (features + bias) and thresholds by defect."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))


def synthetic(rows: Iterable[tuple[str, str]], profiles: np.ndarray, seed: int = 7) -> tuple[list[str], list[str | None], np.ndarray]:
    """Labelled pairs made from rows: (questions, answers, rows x defects)."""
    rng = random.Random(seed)
    rows = [(q, a) for q, a in rows if q and a and not says_nothing(a) and breaks_off(a) == 0 and repeats_question(q, a) < 1.0]
    langs, _ = _language([a for _, a in rows], profiles) if rows else ([], None)
    asks, _ = _language([q for q, _ in rows], profiles) if rows else ([], None)
    q_out: list[str] = []
    a_out: list[str | None] = []
    y: list[list[int]] = []

    def put(q: str, a: str | None, *found: str | None) -> None:
        q_out.append(q)
        a_out.append(a)
        y.append([int(d in found) for d in DEFECTS])

    seeds = [(c, langid.SEEDS[c]) for c in langid.LANGS]
    in_language: dict[str, list[str]] = {}
    for (_, a), k in zip(rows, langs):
        in_language.setdefault(k, []).append(a)
    others = {c: [a for (_, a), k in zip(rows, langs) if k != c] for c in set(asks)}
    for (q, a), lang, ask in zip(rows, langs, asks):
        looks_refused = len(a) < 90 and not re.search(r"\d", a)
        if lang == ask and not looks_refused:
            put(q, a, None)
            parts = [p for p in _WHOLE.findall(a) if len(p) >= 10]
            if len(parts) > 1:  # a sentence of a longer answer is a short, complete answer
                put(q, rng.choice(parts).strip(), None)
            if rng.random() < 0.5:  # with any number, with or without an end mark
                short = re.sub(r"\d+", lambda m: str(rng.randrange(1, 400)), rng.choice(SHORT))
                put(q, short.rstrip("。.") if rng.random() < 0.5 else short, None)
            put(q, q + "\n" + a, None) if rng.random() < 0.1 else None
            if ask in LEADS and rng.random() < 0.2:
                put(q, rng.choice(LEADS[ask]).replace("{t}", rng.choice(TOPICS[ask])) + a, None)
            if rng.random() < 0.15:
                put(q, a + {"zh": "抱歉让您久等。", "en": " Sorry for the wait.", "de": " Entschuldigen Sie die Wartezeit.", "ja": "お待たせして申し訳ありません。"}.get(ask, ""), None)
        m = _WHOLE.search(a)
        end = m.end() if m and rng.random() < 0.3 else len(a.rstrip())  # the first sentence as often as another
        tries = [rng.randrange(4, end - 1) for _ in range(20)] if end > 6 else []
        k = next((k for k in tries if not _ENDS.search(a[max(0, k - 12) : k]) and not a[k].isspace() and a[k] not in "。！？.!?"), 0)
        if k:  # cut inside a sentence
            put(q, a[:k] + rng.choice(("", "", "", "", "，", ",", "，而且", " and the", "（参见")), "truncated")
        lead = rng.choice(QUESTION_LEADS)
        body = rng.choice((q, q.upper(), q + "\n" + q, f" {q} \n", q.rstrip("?？"), q + "！"))
        put(q, lead + body, "copy")
        c = ask if ask in REFUSALS and (ask in LEADS or rng.random() < 0.9) else rng.choice(list(REFUSALS))
        tongue = c if c in LEADS else "en"
        topic = rng.choice(TOPICS.get(c, TOPICS["en"]))
        if c in LEADS:
            text = rng.choice(LEADS[c]) + rng.choice(REFUSALS[c]) + rng.choice(TAILS[c])
        else:
            text = rng.choice(REFUSALS[c]) + "."
        put(q, text.replace("{t}", topic), "refusal")
        if others.get(ask) and rng.random() < 0.6:
            other = rng.choice(others[ask])
            put(q, other, "wrong_language")
            half = len(other) // 2 + rng.randrange(8)
            if rng.random() < 0.3 and len(other) > 40 and other[half].isalnum() and other[half - 1].isalnum():
                put(q, other[:half], "wrong_language", "truncated")
            wanted = rng.choice(list(NAMES[ask])) if ask in NAMES else None
            if wanted and wanted != ask and in_language.get(wanted):  # the question asks for that language, or for one and gets a third
                put(q.rstrip() + rng.choice(ASK[ask]).replace("{n}", NAMES[ask][wanted]), rng.choice(in_language[wanted]), None)
        elif tongue:
            s, t = rng.choice([x for x in seeds if x[0] != ask])
            put(q, t, "wrong_language")
        if rng.random() < 0.3:
            put(q, rng.choice(NOTHING), "empty")
    return q_out, a_out, np.array(y, np.float32).reshape(-1, len(DEFECTS))


def fit(rows: Iterable[tuple[str, str]], profiles: np.ndarray, seed: int = 7) -> tuple[Model, dict[str, float]]:
    """The model, and each defect's F1 on held-out synthetic pairs."""
    rows = list(rows)
    if len(rows) < 40:  # too few to learn from: the seeds answer built-in questions
        rows += [(SEED_QUESTIONS[c], langid.SEEDS[c]) for c in langid.LANGS for _ in range(6)]
    q, a, y = synthetic(rows, profiles, seed)
    x, _ = features(q, a, profiles)
    held = np.random.default_rng(seed).random(len(x)) < 0.25
    train, test = x[~held], x[held]
    w = np.zeros((x.shape[1] + 1, len(DEFECTS)), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    yt = y[~held]
    for step in range(1, 241):  # full-batch Adam with a little decay
        p = 1 / (1 + np.exp(-(train @ w[:-1] + w[-1])))
        e = (p - yt) / len(train)
        g = np.vstack((train.T @ e + 1e-6 * w[:-1], e.sum(axis=0, keepdims=True)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(w, np.full(len(DEFECTS), 0.5))
    s, f1 = model.scores(test), {}
    for j, d in enumerate(DEFECTS):
        tried = []
        for t in np.linspace(0.1, 0.9, 33):
            hit = (s[:, j] >= t) & (y[held][:, j] > 0)
            tried.append((round(float(2 * hit.sum() / max(1, (s[:, j] >= t).sum() + (y[held][:, j] > 0).sum())), 3), float(t)))
        f1[d] = max(f for f, _ in tried)
        good = [t for f, t in tried if f == f1[d]]
        model.thresholds[j] = good[len(good) // 2]
    return model, f1


SEED_QUESTIONS = {"en": "How many days do I have to notify the insurer?", "de": "Übernimmt die Gesellschaft Pflege bei Verbrennungen?", "fr": "La société prend-elle en charge les frais ?", "es": "¿Paga la compañía los gastos del hospital?", "pt": "A seguradora paga as despesas do hospital?", "zh": "保险人会在多少天内处理理赔申请书？", "ja": "領収書の提出期限を教えてください", "ko": "회사가 병원 비용을 지급합니까?", "th": "บริษัทจะจ่ายค่ารักษาพยาบาลหรือไม่", "hi": "क्या कंपनी अस्पताल का खर्च देगी?", "ar": "هل تدفع الشركة تكاليف المستشفى؟"}


def defects(questions: list[str], answers: list[str | None], model: Model, profiles: np.ndarray) -> list[dict[str, tuple[float, float]]]:
    """Of each pair the defects over their threshold: (score, how far over, of what is possible)."""
    s = model.scores(features(questions, answers, profiles)[0])
    over = (s - model.thresholds) / (1 - model.thresholds)
    return [{d: (round(float(s[i, j]), 4), float(over[i, j])) for j, d in enumerate(DEFECTS) if over[i, j] >= 0} for i in range(len(s))]


def judge(questions: list[str], answers: list[str | None], model: Model, profiles: np.ndarray) -> list[tuple[str, float] | None]:
    """The defect that is over its threshold by most, and its score; None for a sound pair."""
    best = [max(((v[1], d, v[0]) for d, v in found.items()), default=None) for found in defects(questions, answers, model, profiles)]
    return [b and (b[1], b[2]) for b in best]


def defective_pairs(df: DataFrame, key: str, question: str, answer: str, sample: int = SAMPLE, every: bool = False) -> DataFrame:
    """(key, defect, score), a row per defective pair; ``every``: one for each of its defects.

    A NULL answer is empty; a NULL question counts as one without words, so its answer can only be empty,
    refused or cut off. Row copies come out once. Other columns are ignored.
    """
    # a share of the rows by hash first, so that the sort below gets about four times the sample, not all rows
    share = min(1.0, 4.0 * sample / max(1, df.count()))
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20))))
    chosen = df.where(spread).where(F.col(question).isNotNull() & F.col(answer).isNotNull()).select(question, answer).orderBy(F.xxhash64(F.col(key)), key, question, answer).limit(sample)
    rows = [(r[0], r[1]) for r in chosen.collect()]  # at most ``sample``
    profiles = adapted_profiles(rows)
    model, _ = fit(rows, profiles)

    def work(cols: dict[str, list]) -> dict[str, pa.Array]:
        asked = [q or "" for q in cols["q"]]
        if every:
            rows = [(k, d, v[0]) for k, found in zip(cols["k"], defects(asked, cols["a"], model, profiles)) for d, v in found.items()]
        else:
            rows = [(k, *f) for k, f in zip(cols["k"], judge(asked, cols["a"], model, profiles)) if f]
        r = list(zip(*rows)) if rows else [[]] * 3
        return {key: pa.array(r[0], pa.int64()), "defect": pa.array(r[1], pa.string()), "score": pa.array(r[2], pa.float64())}

    asked = df.select(F.col(key).cast("bigint").alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"))
    return per_batch(asked, work, f"`{key}` bigint, defect string, score double", 256)
