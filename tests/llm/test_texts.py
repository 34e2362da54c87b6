import random

import numpy as np
import pytest


from docloom.llm import chunking, langid, leakage, sentences
from docloom.llm.fmindex import FmIndex, suffix_array
from docloom.llm.normal import byte_codes, distance_within, fold


def units(t):
    return [t[a:b] for a, b in sentences.units(t)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("See Art. 5 and No. 10, i.e. the table. Dr. Who came at 5 p.m. on 3 May. It cost 4.5.", ["See Art. 5 and No. 10, i.e. the table.", "Dr. Who came at 5 p.m. on 3 May.", "It cost 4.5."]),
        ('The wording "cover ends at once." in the note counts. Next.', ['The wording "cover ends at once." in the note counts.', "Next."]),
        ("Am 17. Januar zahlt er z. B. Geld bzw. Waren. Danach nicht.", ["Am 17. Januar zahlt er z. B. Geld bzw. Waren.", "Danach nicht."]),
        ("第二条 退保\n系数为4.9（见表2。另有约定除外），退还。“须同意。”字样的，\n应当申请。", ["第二条 退保", "系数为4.9（见表2。另有约定除外），退还。", "“须同意。”字样的，\n应当申请。"]),
        ("1、甲；\n2、乙。\n（三）丙\n第 3 页", ["1、甲；", "2、乙。", "（三）丙", "第 3 页"]),
        ("产品名称：甲险\n生效日期：2020-01-01", ["产品名称：甲险", "生效日期：2020-01-01"]),
        ("保险人应当\n承担责任。", ["保险人应当\n承担责任。"]),
        ("यह है। वह था।", ["यह है।", "वह था।"]),
        ("هل تدفع؟ نعم تدفع.", ["هل تدفع؟", "نعم تدفع."]),
        ("「終わる。」と記載された場合でも、支払います。次です。", ["「終わる。」と記載された場合でも、支払います。", "次です。"]),
        ("บริษัทจะจ่ายค่าห้อง 18 บาท หากผู้เรียกร้องตาย ฝ่ายสินไหมจะคืนเงิน", ["บริษัทจะจ่ายค่าห้อง 18 บาท", "หากผู้เรียกร้องตาย ฝ่ายสินไหมจะคืนเงิน"]),
        ("no boundary at all", ["no boundary at all"]),
        ("", []),
        (" \n\t ", []),
        ("。", ["。"]),
    ],
)
def test_sentences(text, want):
    assert units(text) == want


@pytest.mark.parametrize("n", [5, 500, 5000])
def test_quotations_and_brackets_of_any_length(n):
    for a, b in ("“”", "「」", "（）"):
        t = f"前文注明{a}{'须经同意。' * n}{b}字样的，应当申请。另一句。"
        assert units(t) == [t[:-4], "另一句。"]
    t = f'The wording "{"it ends. " * n}it does." in the note counts. Next.'
    assert units(t) == [t[:-6], "Next."]
    t = f"项目：{'甲' * n}\n生效日期：2020"
    assert units(t) == t.split("\n")


def test_the_lattice_decides_gaps():
    t = "申请人提交材料完成\n任务清单附后并由保险人审核，由保险人在三十日内作出书面答复\n"
    lex = lambda words: sentences.Lexicon(words, ["任务"], ["完成"])
    cut = ["申请人提交材料完成", "任务清单附后并由保险人审核，由保险人在三十日内作出书面答复"]
    assert [t[a:b] for a, b in sentences.units(t, lex({"完成": 9, "任务": 9}))] == cut
    assert [t[a:b] for a, b in sentences.units(t, lex({"完成": 9, "任务": 9, "完成任务": 90}))] == ["\n".join(cut)]
    assert sentences.Lexicon({"ab": 5, "bc": 1}).across("a", "b") and not sentences.Lexicon().across("a", "b")


def test_a_lexicon_is_learned_from_all_texts(spark):
    rows = [(i, f"材料：诊断证明、费用清单。申请人提交诊断证明。再保险方核定{i}。", None) for i in range(40)] + [(99, None, "x"), (100, "", "x")]
    lex = sentences.learn(spark.createDataFrame(rows, "id bigint, content string, w string"), "content")
    assert {"诊断证明", "费用清单"} <= set(lex.costs) and "申请" in lex.opens and {"清单", "证明"} <= lex.finals
    empty = sentences.learn(spark.createDataFrame([], "id bigint, content string"), "content")
    assert not empty.costs and not empty.opens


def test_units_cover_all_but_white_space(spark):
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab .。!？?\n“”\"（）()1、ก ข้จะ;；,:A") for _ in range(rng.randrange(60)))
        u = sentences.units(t)
        covered = {i for a, b in u for i in range(a, b)}
        assert all(t[i].isspace() for i in range(len(t)) if i not in covered), t
        assert all(a < b for a, b in u) and all(x[1] <= y[0] for x, y in zip(u, u[1:])), t
    df = spark.createDataFrame([(1, "A b. C d.", "x", "y"), (1, "A b. C d.", "x", "y"), (2, None, "x", "y"), (3, "x" * 300_000, "x", "y")], "id bigint, content string, k string, t string")
    assert sentences.sentence_units(df, "id", "content").count() == 3
    assert sentences.sentence_units(df.limit(0), "id", "content").count() == 0


def test_pieces(spark):
    rng = random.Random(2)
    t = "".join(rng.choice(["保险人应当承担责任。", "投保人申请复核，", "word ", "\n", "\n\n"]) for _ in range(900)).strip()
    p = chunking.cut_points(t)
    assert p[0][0] == 0 and p[-1][1] == len(t) and all(b - a <= 400 for a, b in p)
    assert all(x[1] - y[0] == 40 for x, y in zip(p, p[1:]))
    edited = t[:5000] + "插入" + t[5000:]
    q = chunking.cut_points(edited)
    same = {t[a:b] for a, b in p} & {edited[a:b] for a, b in q}
    assert len(same) >= len(p) - 6  # only pieces about the edit differ
    assert all(b - a <= 400 for a, b in chunking.cut_points("x" * 5000))
    df = spark.createDataFrame([(1, " " * 500, 1, "k"), (2, None, None, "k"), (3, t, 7, "k"), (3, t, 7, "k"), (4, "a" * 400 + "  \n", 0, "k")], "id bigint, content string, page_number int, k string")
    out = chunking.pieces(df, "id", "content", "page_number")
    assert {r[0] for r in chunking.oversized(out, "id").collect()} == {3}
    rows = out.distinct().orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(p))) and {r["page_number"] for r in rows} == {7}
    assert chunking.pieces(df.limit(0), "id", "content", "page_number").count() == 0
    with pytest.raises(ValueError):
        chunking.cut_points("x" * 500, 400, 300, 200)


def test_language(spark):
    en, de, zh = langid.SEEDS["en"], langid.SEEDS["de"], langid.SEEDS["zh"]
    rows = [(1, en, "en"), (2, de, "en"), (3, zh, None), (4, en + "\n" + zh, "zh_Hans"), (5, None, "en"), (6, "12 34", None), (7, zh + "\nHarbor Plus Plan", "zho"), (7, zh + "\nHarbor Plus Plan", "zho"), (8, en, " ENG ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seg = langid.language_segments(df, "doc_id", "text", "lang")
    assert {tuple(r) for r in langid.unlabelled(seg, "doc_id").collect()} == {(2, "de"), (3, "zh"), (4, "en"), (4, "zh")}
    assert all(0 <= r["confidence"] <= 1 for r in seg.collect())
    assert langid.unlabelled(langid.language_segments(df.limit(0), "doc_id", "text", "lang"), "doc_id").count() == 0


def test_language_held_out():
    p = langid.fit([])
    held = {"en": "the insurer must pay within thirty days after the claim was made by the holder", "fr": "l'assureur doit payer dans les trente jours suivant la demande du souscripteur", "es": "la aseguradora debe pagar en el plazo de treinta días desde la solicitud", "pt": "a seguradora deve pagar no prazo de trinta dias após o pedido da pessoa", "de": "der Versicherer muss innerhalb von dreißig Tagen nach dem Antrag zahlen"}
    got = langid.distances([langid._letters(t) for t in held.values()], p).argmin(axis=1)
    assert [langid.LANGS[i] for i in got] == list(held)


def test_suffix_array_and_fm_index():
    rng = random.Random(3)
    for _ in range(30):
        s = np.array([rng.choice([0, 1, 2, 3]) for _ in range(rng.randrange(1, 80))], np.uint8)
        b = s.tobytes()
        assert suffix_array(s).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        f = FmIndex(s)
        for _ in range(8):
            p = bytes(rng.choice([1, 2, 3]) for _ in range(rng.randrange(1, 5)))
            lo, hi = f.search(np.frombuffer(p, np.uint8)[None, :])
            assert sorted(f.locate(np.arange(lo[0], hi[0])).tolist()) == [i for i in range(len(b)) if b[i : i + len(p)] == p]


def test_leaks(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
    passage = " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(60))
    half, tenth = passage[: int(len(passage) * 0.55)], passage[: len(passage) // 5]
    changed = "".join("#" if i % 14 == 7 else c for i, c in enumerate(half.upper()))
    typos = "".join("q" if i % 15 == 7 and c.isalpha() else c for i, c in enumerate(half))
    docs = [(1, "xx " + half + " yy"), (2, tenth), (3, typos), (4, None), (5, ""), (6, changed.replace("#", " - ")), (7, "nothing " * 4000), (1, "xx " + half + " yy"), (8, ("filler text " * 100_000) + half)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage), (2, passage), (3, None), (4, "..."), (5, "a")], "item_id bigint, passage string")
    spans = leakage.leaked_spans(df, "doc_id", "text", items, "item_id", "passage")
    got = {tuple(r) for r in leakage.leaks(spans, "doc_id", "item_id").collect()}
    assert {g for g in got if g[0] == 1} >= {(1, 1), (1, 3), (1, 8)} and {g[1] for g in got} <= {1, 3, 6, 8} and {g[0] for g in got} == {1, 2}
    span = spans.where("doc_id = 1 AND item_id = 1").first()
    assert docs[0][1][span["start_pos"] : span["end_pos"]] == half
    merged = leakage.removal_spans(spans, "doc_id", "item_id").where("doc_id = 1").collect()
    assert len(merged) == 1 and merged[0]["items"] == 2
    assert leakage.leaked_spans(df, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def leaked(docs, items):
    p = leakage.Phrases(items)
    texts = [fold([t])[0] for t in docs]
    return leakage.leaks_of_shard(leakage.Shard(texts), p) if p.groups else []


def test_stretches_of_any_length_with_changes_evenly_spread():
    rng = random.Random(11)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", [chr(0x4E00 + i) for i in range(900)]):
        for whole in (5, 9, 12, 24, 45, 50, 61, 75, 88, 100, 120, 133, 250, 400, 801):
            passage = "".join(rng.choice(alphabet) for _ in range(whole))
            need = -(-whole * 2 // 5)
            for n in {need, need + 1, need + 3, min(whole, need + 9), min(whole, (need // 10 + 1) * 10), whole}:
                t = list(passage[:n])
                for i in range(n // 10):
                    t[int((i + 0.5) * n / (n // 10))] = "7"
                doc = "".join(rng.choice(alphabet) for _ in range(30)) + "".join(t) + "".join(rng.choice(alphabet) for _ in range(30))
                assert {x[:2] for x in leaked([doc], [(1, passage)])} == {(0, 0)}, (whole, n)


def test_every_place_of_an_item(spark):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    docs = [(1, f"x {passage} {'filler ' * 30}{passage[50:150]} y"), (2, passage[:70])]
    spans = leakage.leaked_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame([(7, passage)], "item_id bigint, passage string"), "item_id", "passage").collect()
    assert sorted((r["doc_id"], docs[0][1][r["start_pos"] : r["end_pos"]]) for r in spans) == [(1, passage[50:150]), (1, passage)]


def test_very_long_passages(monkeypatch):
    monkeypatch.setattr(leakage, "LONGEST", 300)
    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefgh") for _ in range(700))
    assert {x[0] for x in leaked([passage[310:500], "q" * 400], [(1, passage)])} == {0}


def test_a_stretch_holds_a_character_with_an_equal_code():
    codes = byte_codes()
    passage = np.arange(0x4E00, 0x4E00 + 60, dtype=np.uint32)
    other = next(c for c in range(0x6E00, 0x9000) if codes[c] == codes[passage[12]])
    text = passage[:26].copy()
    text[12] = other
    at = np.arange(len(text) - 5)
    assert leakage.stretches(passage, text, at, at, 6, 24) == [(0, 26)]


def test_distance_within():
    rng = random.Random(5)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in "ab")
        for most in range(5):
            assert distance_within(a, b, most) == (lev(a, b) <= most), (a, b, most)
    folded, starts = fold(["Ａ- b", "", "é！"])
    assert folded.tobytes().decode("utf-32-le") == "abé" and starts.tolist() == [0, 2, 2, 3]



def test_languages_without_a_profile(spark):
    ru = "Суд быстро решил, что все люди имеют право быть услышанными. Когда погода хорошая, мы пойдём на рынок и купим свежий хлеб вместе с друзьями."
    p = langid.fit([])
    assert [(c, k) for _, _, c, k in langid.classify([ru], p)[0]] == [("und", 0.0)]
    assert [c for *_, c, _ in langid.classify([langid.SEEDS["en"] + "\n" + ru], p)[0]] == ["en", "und"]
    df = spark.createDataFrame([(1, ru, None), (2, ru + "\n" + langid.SEEDS["en"], None), (3, langid.SEEDS["de"], None)], "doc_id bigint, text string, lang string")
    assert {tuple(r) for r in langid.unlabelled(langid.language_segments(df, "doc_id", "text", "lang"), "doc_id").collect()} == {(2, "en"), (3, "de")}
