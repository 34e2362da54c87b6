"""Languages of documents and of the segments of mixed documents, by rank-order profiles.

A profile is a language's most frequent character n-grams (one to three) in order. A segment's own
n-grams are ranked the same way and its language is the profile with the least out-of-place distance,
the sum over its n-grams of how far the two ranks lie apart (``DEPTH`` for an n-gram the profile lacks).

Profiles are fitted on at most ``SAMPLE`` labelled documents a language (the bound of the fit; labels
are noisy, so documents that a first fit contradicts are left out of the second) plus fixed seed
sentences, so languages without a labelled document still have one. They are some 200 kB and go to the
executors with the function. Documents are independent: one Arrow pass, n-grams of a batch are counted
and ranked with sorts over arrays, nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.arrow import per_batch

DEPTH = 1200
SAMPLE = 150
_BITS = 18

SEEDS = {
    "en": "The quick decision of the court was that all people have the right to be heard. When the weather is good, we will go to the market and buy some fresh bread with our friends. Does this company pay for the costs of the hospital? If you have not received the letter, please call us within ten days. The insured person should give notice of the accident as soon as this is possible, and the policyholder must pay the premium before the end of the month. There is no cover for damage that was caused on purpose. After the waiting period the benefit will be paid for each day of the stay in hospital, with the limits which are shown in the table.",
    "de": "Die schnelle Entscheidung des Gerichts war, dass alle Menschen das Recht haben, gehört zu werden. Wenn das Wetter gut ist, gehen wir auf den Markt und kaufen frisches Brot mit unseren Freunden. Übernimmt die Gesellschaft die Kosten für das Krankenhaus? Wir haben den Brief nicht erhalten und warten auf eine Antwort. Der Versicherungsnehmer muss den Unfall so bald wie möglich melden und der Beitrag ist vor dem Ende des Monats zu zahlen. Für Schäden, die mit Absicht verursacht wurden, besteht kein Schutz. Nach der Wartezeit wird das Tagegeld für jeden Tag des Aufenthalts innerhalb der Grenzen gezahlt, die sich aus der Tabelle ergeben. Der Versicherer prüft den Antrag und teilt das Ergebnis schriftlich mit.",
    "fr": "La décision rapide du tribunal était que toutes les personnes ont le droit d'être entendues. Quand il fait beau, nous allons au marché et nous achetons du pain frais avec nos amis. La société prend-elle en charge les frais de l'hôpital ? Si vous n'avez pas reçu la lettre, veuillez nous appeler dans les dix jours. L'assuré doit déclarer l'accident dès que possible et le souscripteur doit payer la prime avant la fin du mois. Il n'y a pas de garantie pour les dommages causés volontairement. Après le délai d'attente, l'indemnité est versée pour chaque jour de séjour à l'hôpital, dans les limites qui figurent au tableau.",
    "es": "La rápida decisión del tribunal fue que todas las personas tienen derecho a ser oídas. Cuando hace buen tiempo, vamos al mercado y compramos pan fresco con nuestros amigos. ¿Paga la compañía los gastos del hospital? Si usted no ha recibido la carta, llámenos en un plazo de diez días. El asegurado debe comunicar el accidente lo antes posible y el tomador debe pagar la prima antes del fin de mes. No hay cobertura para los daños que se causaron de forma intencionada. Después del período de espera, la indemnización se paga por cada día de estancia en el hospital, con los límites que figuran en la tabla. La aseguradora examina la solicitud desde el primer día.",
    "pt": "A rápida decisão do tribunal foi que todas as pessoas têm o direito de ser ouvidas. Quando o tempo está bom, vamos ao mercado e compramos pão fresco com os nossos amigos. A seguradora paga as despesas do hospital? Se você não recebeu a carta, ligue para nós no prazo de dez dias. Não há informações sobre a condição. O segurado deve comunicar o acidente logo que possível e o tomador deve pagar o prémio antes do fim do mês. Não há cobertura para os danos que foram causados de forma intencional. Após o período de carência, a indenização é paga por cada dia de internação no hospital, com os limites que constam da tabela. A seguradora analisa o pedido da pessoa desde o primeiro dia.",
    "zh": "法院的快速决定是所有人都有权陈述意见。天气好的时候，我们会和朋友一起去市场买新鲜的面包。公司是否支付住院的费用？如果您没有收到信件，请在十天内给我们打电话。被保险人应当在合同有效期内提出书面申请。",
    "ja": "裁判所の迅速な決定は、すべての人に意見を述べる権利があるというものでした。天気の良い日には、友達と一緒に市場へ行って新鮮なパンを買います。会社は病院の費用を支払いますか。手紙を受け取っていない場合は、十日以内にお電話ください。",
    "ko": "법원의 신속한 결정은 모든 사람이 의견을 말할 권리가 있다는 것이었습니다. 날씨가 좋은 날에는 친구들과 함께 시장에 가서 신선한 빵을 삽니다. 회사가 병원 비용을 지급합니까? 편지를 받지 못하셨다면 열흘 이내에 저희에게 전화해 주십시오.",
    "th": "คำตัดสินที่รวดเร็วของศาลคือทุกคนมีสิทธิที่จะแสดงความคิดเห็น เมื่ออากาศดีเราจะไปตลาดและซื้อขนมปังสดกับเพื่อนของเรา บริษัทจะจ่ายค่ารักษาพยาบาลหรือไม่ หากท่านยังไม่ได้รับจดหมายโปรดโทรหาเราภายในสิบวัน",
    "hi": "अदालत का त्वरित निर्णय यह था कि सभी लोगों को अपनी बात कहने का अधिकार है। जब मौसम अच्छा होता है तो हम अपने दोस्तों के साथ बाज़ार जाते हैं और ताज़ी रोटी खरीदते हैं। क्या कंपनी अस्पताल का खर्च देगी? यदि आपको पत्र नहीं मिला है तो कृपया दस दिनों के भीतर हमें फोन करें।",
    "ar": "كان القرار السريع للمحكمة أن لجميع الناس الحق في إبداء آرائهم. عندما يكون الطقس جيدا نذهب إلى السوق ونشتري الخبز الطازج مع أصدقائنا. هل تدفع الشركة تكاليف المستشفى؟ إذا لم تستلم الرسالة فيرجى الاتصال بنا خلال عشرة أيام.",
}
LANGS = tuple(sorted(SEEDS))
#: a language that has no profile, and the distance from which on a text is in one
NONE, FAR = "und", 0.985

# Other notations of the languages (ISO 639-2 codes, names), and words for an unknown language.
NOTATIONS = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "中文": "zh", "汉语": "zh", "cn": "zh",
    "jpn": "ja", "japanese": "ja", "日本語": "ja", "jp": "ja", "kor": "ko", "korean": "ko", "한국어": "ko", "kr": "ko", "tha": "th", "thai": "th", "ไทย": "th", "hin": "hi", "hindi": "hi", "हिन्दी": "hi", "ara": "ar", "arabic": "ar", "العربية": "ar",
}
UNKNOWN = ("", "und", "unknown", "unk", "un", "undetermined", "none", "null", "nil", "na", "n/a", "nan", "mul", "mis", "zxx", "xx", "xxx", "?", "-", "--", "other", "any", "auto", "未知", "不明", "missing", "undefined", "tbd", "not known")


def label_language(col: Column) -> Column:
    """ISO 639-1 code of a label in any notation; NULL if it is missing; an unknown word stays as it is."""
    text = F.lower(F.trim(F.regexp_replace(col, r"^\s+|\s+$", "")))
    head = F.regexp_extract(text, r"^([^-_\s]+)", 1)
    table = F.create_map(*(F.lit(x) for kv in NOTATIONS.items() for x in kv))
    return F.when(text.isNull() | text.isin(*UNKNOWN) | head.isin(*UNKNOWN), None).otherwise(F.coalesce(table[head], head))


_SPLIT = re.compile(r"[。！？!?।؟۔．]+[”’」』）)\"'»]*|\.[”’)\"'»]*(?=\s+[^\sa-z])|\.[”’)\"'»]*\s*$|\n+")
_NAMES = re.compile(r"(?:[A-Z][a-zà-ÿ’'-]+[ \t]+(?:(?:of|the|and|de|du|la|von|y|e)[ \t]+)?)+[A-Z][a-zà-ÿ’'-]+")
_WIDE = re.compile("[！-～]")
_JUNK = re.compile(r"[\W\d_]+")
_TERMINATED = frozenset("。！？!?।؟۔．.")


def _letters(text: str) -> str:
    """What the n-grams are counted on: lower-case words between single spaces, names left out."""
    if _WIDE.search(text):
        text = unicodedata.normalize("NFKC", text)
    names = _NAMES.sub(" ", text)
    kept = _JUNK.sub(" ", names)
    return kept.strip().lower()


def fragments(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, letters, whole) of the sentences of a text; short ones join the next of their line."""
    out, s = [], 0
    n = len(text)
    cuts = [m.end() for m in _SPLIT.finditer(text)]
    if not cuts or cuts[-1] != n:
        cuts.append(n)
    for e in cuts:
        if e <= s:
            continue
        words = _letters(text[s:e])
        if len(words) < 8 and text[e - 1] != "\n" and e < n:
            continue  # an abbreviation: goes with what follows
        body = text[s:e].rstrip()
        whole = bool(body) and (body[-1] in _TERMINATED or body[-1] in "”’」』）)\"'»" and body[-2:-1] in _TERMINATED)
        out.append((s, e, words, whole))
        s = e
    if s < n:
        out.append((s, n, _letters(text[s:]), False))
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed n-gram, count) of the n-grams of each text, sorted by text."""
    joined = "\x00 ".join(texts).join(("\x00 ", "\x00"))
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    which = np.cumsum(c == 0, dtype=np.int64) - 1
    c = c.astype(np.uint64)
    mask = np.uint64((1 << _BITS) - 1)
    keys = []
    with np.errstate(over="ignore"):
        h = c * np.uint64(0x9E3779B97F4A7C15)
        live = c != 0
        for n in (1, 2, 3):
            if n > 1:
                k = n - 1
                if len(c) <= k:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[k:] * np.uint64(0x94D049BB133111EB)
                live = live[:-1] & (c[k:] != 0)
            ok = live & ((c[: len(live)] != 32) if n == 1 else True)
            keys.append((which[: len(live)][ok].astype(np.uint64) << np.uint64(_BITS)) | ((h[ok] >> np.uint64(40)) & mask))
    key = np.sort(np.concatenate(keys))
    if not len(key):
        e = np.zeros(0, np.int64)
        return e, e, e
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    u = key[first]
    return (u >> np.uint64(_BITS)).astype(np.int64), (u & mask).astype(np.int64), count


def _ranked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, rank within the text by falling count), the DEPTH first of each text."""
    who, gram, count = grams(texts)
    order = np.argsort((who << 32) | (np.int64(0xFFFF) - np.minimum(count, 0xFFFF) << 16) | (gram & 0xFFFF), kind="stable")
    who, gram = who[order], gram[order]
    begin = np.searchsorted(who, np.arange(len(texts) + 1))
    rank = np.arange(len(who)) - begin[who]
    keep = rank < DEPTH
    return who[keep], gram[keep], rank[keep]


def profile(texts: list[str]) -> np.ndarray:
    """Rank of each hashed n-gram in the joint text; DEPTH where it is not among the first."""
    _, gram, rank = _ranked([" ".join(texts)])
    out = np.full(1 << _BITS, DEPTH, np.int16)
    out[gram] = rank
    return out


def distances(texts: list[str], profiles: np.ndarray) -> np.ndarray:
    """Mean out-of-place distance of each text to each profile, in 0..1 (1: nothing in common)."""
    out = np.ones((len(texts), len(profiles)))
    who, gram, rank = _ranked(texts)
    if not len(who):
        return out
    begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    size = np.diff(np.append(begin, len(who)))
    # a text's ranks are few where the profile has DEPTH: both are compared on the profile's scale
    scaled = rank.astype(np.float32) * np.repeat(np.minimum(DEPTH / 4, size).astype(np.float32) / np.maximum(size, 1), size)
    for j, p in enumerate(profiles):
        r = p[gram]
        d = np.where(r == DEPTH, np.float32(DEPTH), np.abs(r - scaled))
        out[who[begin], j] = np.add.reduceat(d, begin) / (size * DEPTH)
    return out


def labelled_sample(df: DataFrame, key: str, text: str, label: str, per_language: int = SAMPLE) -> DataFrame:
    """(lang, t): at most ``per_language`` documents of each label, by hash of the key.

    The window limits each partition before its shuffle and moves keys only; the chosen keys, at most
    ``per_language`` x the number of languages, are broadcast to fetch the texts.
    """
    rows = df.select(F.col(key).alias("k"), label_language(F.col(label)).alias("lang")).where(F.col("lang").isin(*LANGS))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k")
    chosen = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("k", "lang").distinct()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(chosen), "k").select("lang", "t")


def fit(sample: list[tuple[str, str]]) -> np.ndarray:
    """Profiles by LANGS from (language, text) pairs and the seeds."""
    texts = {c: [_letters(SEEDS[c])] for c in LANGS}
    first = np.stack([profile(texts[c]) for c in LANGS])
    docs = [(lang, _letters(t)) for lang, t in sample]
    for _ in range(2):
        if not docs:
            break
        best = distances([t for _, t in docs], first).argmin(axis=1)
        kept = {c: list(texts[c]) for c in LANGS}
        for (lang, t), b in zip(docs, best):
            if LANGS[b] == lang:
                kept[lang].append(t)
        first = np.stack([profile(kept[c]) for c in LANGS])
    return first


def classify(texts: list[str], profiles: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
    """Segments (start, end, language, confidence) of each text; texts without letters have none.

    A sentence is of another language than the text only if it is whole (it ends with an end mark or is
    long) and clearly nearer to that language; headings, names and other fragments follow their
    neighbours. Neighbouring sentences of one language are one segment. Sentences that have next to nothing in common
    with any profile are of the language ``und``.
    """
    parts = [fragments(t) for t in texts]
    flat = [(i, f) for i, p in enumerate(parts) for f in p if f[2]]
    d = distances([f[2] for _, f in flat], profiles) if flat else np.ones((0, len(profiles)))
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    at = 0
    for i, p in enumerate(parts):
        n = sum(1 for f in p if f[2])
        if not n:
            continue
        rows, own = d[at : at + n], [f for f in p if f[2]]
        at += n
        size = np.array([len(f[2]) for f in own], np.float64)
        total = (rows * size[:, None]).sum(axis=0) / size.sum()
        two = np.partition(rows, 1, axis=1)[:, :2]
        best, margin = rows.argmin(axis=1), 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
        strange = (two[:, 0] >= FAR) & (size >= 40)  # next to nothing in common with any profile
        best = np.where(strange, len(LANGS), best)
        sure = [bool((f[3] and len(f[2]) >= 8 or len(f[2]) >= 40) and m >= 0.03 and r < 0.93) for f, m, r in zip(own, margin, two[:, 0])]
        sure = [bool(s or x) for s, x in zip(sure, strange)]
        weight = np.zeros(len(LANGS) + 1)
        for b, s, z in zip(best, sure, size):
            if s:
                weight[b] += z
        main = int(weight.argmax()) if weight.any() else int(total.argmin())
        lang, near = [], main
        for b, s in zip(best, sure):
            near = int(b) if s else near
            lang.append(near)
        # what opens the text unsurely goes with the first sure sentence
        first = next((j for j, s in enumerate(sure) if s), None)
        for j in range(first or 0):
            lang[j] = lang[first]
        segs: list[list] = []
        for f, c, m, z in zip(own, lang, margin, size):
            if segs and segs[-1][2] == c:
                segs[-1][1] = f[1]
                segs[-1][3] += m * z
                segs[-1][4] += z
            else:
                segs.append([segs[-1][1] if segs else 0, f[1], c, m * z, z])
        segs[-1][1] = len(texts[i])
        out[i] = [(a, b, (*LANGS, NONE)[c], round(float(1 - np.exp(-12 * m / z)), 4) if c < len(LANGS) else 0.0) for a, b, c, m, z in segs]
    return out


def language_segments(df: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> DataFrame:
    """(key, label_lang, start_pos, end_pos, lang, confidence), a row per segment of one language.

    ``label_lang`` is the label as an ISO 639-1 code, NULL if it is missing. Documents that are NULL or
    have no letters have no segments. Row copies give their segments twice.
    """
    profiles = fit([(r["lang"], r["t"]) for r in labelled_sample(df, key, text, label, sample).collect()])  # at most sample x languages rows

    def work(cols: dict[str, list]) -> dict[str, pa.Array]:
        out: list[tuple] = []
        for a in range(0, len(cols["t"]), 64):
            found = classify([t or "" for t in cols["t"][a : a + 64]], profiles)
            out += [(k, lab, *s) for k, lab, segs in zip(cols["k"][a : a + 64], cols["lab"][a : a + 64], found) for s in segs]
        r = list(zip(*out)) if out else [[]] * 6
        return {key: pa.array(r[0], pa.int64()), "label_lang": pa.array(r[1], pa.string()), "start_pos": pa.array(r[2], pa.int32()), "end_pos": pa.array(r[3], pa.int32()), "lang": pa.array(r[4], pa.string()), "confidence": pa.array(r[5], pa.float64())}

    rows = df.select(F.col(key).cast("bigint").alias("k"), label_language(F.col(label)).alias("lab"), F.col(text).alias("t"))
    return per_batch(rows, work, f"`{key}` bigint, label_lang string, start_pos int, end_pos int, lang string, confidence double")


def document_languages(segments: DataFrame, key: str) -> DataFrame:
    """(key, label_lang, lang, chars, confidence), a row per document and language of its text."""
    n = F.col("end_pos") - F.col("start_pos")
    return segments.distinct().groupBy(key, "label_lang", "lang").agg(F.sum(n).alias("chars"), F.round(F.sum(F.col("confidence") * n) / F.sum(n), 4).alias("confidence"))


def unlabelled(segments: DataFrame, key: str) -> DataFrame:
    """(key, true_lang) of documents whose label is missing, names a language the text is not in, or
    whose text is in several languages. What is in no language with a profile has no true language here."""
    segments = segments.where(F.col("lang") != NONE)
    per = segments.groupBy(key, "label_lang").agg(F.collect_set("lang").alias("langs"))  # at most as many as languages
    bad = F.col("label_lang").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label_lang"))
    return per.where(bad).select(key, F.explode("langs").alias("true_lang")).distinct()
