import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import dedup, langid, mixing, pairs

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(rng, n=60):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(n))


def test_repeats_equal_brute_force(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for _ in range(60):
        t = text(rng, rng.choice((6, 15, 60)))
        for k in range(rng.randrange(1, 4)):
            i += 1
            u = t.upper().replace(" ", "  ,") if k == 1 else t
            for _ in range(rng.choice((0, 0, 1, 3)) if k else 0):
                j = rng.randrange(len(u))
                u = u[:j] + "q" + u[j + 1 :]
            rows.append((i, u, i // 20))
    rng.shuffle(rows)
    rows += [(900, None, 9), (901, " .,", 9), (902, "", None), (903, rows[0][1], None), rows[0]]
    df = spark.createDataFrame(rows, "id bigint, content string, ingest_batch int").withColumn("rec", F.lit("clash")).withColumn("t", F.lit(1))
    got = {r["dup_id"]: r["first_id"] for r in dedup.text_repeats(df, "id", "content", "ingest_batch").collect()}
    from docloom.llm.normal import distance_within, fold

    def norm(t):
        return fold([t or ""])[0].tobytes().decode("utf-32-le")

    accepted, want = {}, {}
    for k, t in sorted({(r[0], norm(r[1])) for r in rows}):
        if not t:
            continue
        first = next((a for a, u in accepted.items() if distance_within(t, u, max(len(t), len(u)) // 10)), None)
        if first is None:
            accepted[k] = t
        else:
            want[k] = first
    assert len(want) > 40
    assert got == want


def test_repeats_of_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, content string, ingest_batch int")
    assert dedup.text_repeats(df, "id", "content", "ingest_batch").count() == 0


def test_a_large_group_of_copies(spark):
    rng = random.Random(2)
    one = text(rng)
    df = spark.createDataFrame([(i, one if i % 3 == 0 else text(rng, 8), i % 5) for i in range(900)], "id bigint, content string, ingest_batch int")
    got = dedup.text_repeats(df, "id", "content", "ingest_batch").collect()
    assert {r["first_id"] for r in got} == {0} and len(got) == 299


def test_originals_in_a_crowded_family(spark):
    rng = random.Random(4)
    values = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(12)) for _ in range(20)]
    marks = ["".join(chr(0x6E00 + rng.randrange(900)) for _ in range(22)) for _ in range(8)]  # the template
    chosen = [[rng.choice(values) for _ in marks] for _ in range(300)]
    whole = ["".join(m + v for m, v in zip(marks, c)) for c in chosen]
    edited = ["".join(m + v[:5] + "々々" + v[7:] for m, v in zip(marks, c)) for c in chosen[200:]]
    df = spark.createDataFrame([(i, t, i // 100) for i, t in enumerate(whole + edited)], "id bigint, content string, ingest_batch int")
    got = dedup.text_repeats(df, "id", "content", "ingest_batch").collect()
    assert {(r["first_id"], r["dup_id"]) for r in got} == {(200 + i, 300 + i) for i in range(100)}


def test_repeats_with_edits_evenly_spread(spark):
    rng = random.Random(6)
    rows = []
    for alphabet in ([chr(0x4E00 + i) for i in range(800)], "abcdefghijklmnop"):
        for n in (10, 15, 20, 39, 40, 44, 45, 60, 99, 100, 250, 400):
            t = [rng.choice(alphabet) for _ in range(n)]
            rows.append((len(rows), "".join(t), 0))
            for i in range(n // 10):
                t[int((i + 0.5) * n / (n // 10))] = "z"
            rows.append((len(rows), "".join(t), 1))
    got = dedup.text_repeats(spark.createDataFrame(rows, "id bigint, content string, ingest_batch int"), "id", "content", "ingest_batch").collect()
    assert {(r["first_id"], r["dup_id"]) for r in got} == {(i, i + 1) for i in range(0, len(rows), 2)}


def in_turn(rows):
    """Repeats by comparing each row with all accepted ones in id order."""
    from docloom.llm.normal import distance_within

    accepted, want = [], {}
    for k, t in sorted(rows):
        first = next((a for a, u in accepted if distance_within(t, u, max(len(t), len(u)) // 10)), None)
        if first is None:
            accepted.append((k, t))
        else:
            want[k] = first
    return want


def chains(rng, n):
    """Texts that drift away from each other in small steps, across length bands, in random id order."""
    out = []
    for _ in range(n):
        t = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice((12, 18, 43, 60, 100, 150))))
        for _ in range(6):
            out.append(t)
            for _ in range(rng.randrange(1, 2 + len(t) // 12)):
                j = rng.randrange(len(t))
                t = rng.choice((t[:j] + "z" + t[j:], t[:j] + t[j + 1 :], t[:j] + "y" + t[j + 1 :]))
    rng.shuffle(out)
    return list(enumerate(out))


def test_rows_rejected_by_rejected_rows(spark, monkeypatch):
    rows = chains(random.Random(7), 80)
    want = in_turn(rows)
    df = spark.createDataFrame([(k, t, k // 100) for k, t in rows], "id bigint, content string, ingest_batch int")
    for units in (dedup.UNITS, 3000):  # also with bands split by heads
        monkeypatch.setattr(dedup, "UNITS", units)
        assert {r["dup_id"]: r["first_id"] for r in dedup.text_repeats(df, "id", "content", "ingest_batch").collect()} == want


def test_texts_of_a_large_band_are_written_once(spark, monkeypatch):
    for units in ({30: 40 * dedup.UNITS, 31: 40 * dedup.UNITS}, {30: 40 * dedup.UNITS, 31: 5, 32: 7}, {29: 5, 30: 40 * dedup.UNITS}):
        goes = dedup.Plan.meeting(units, 4).goes.values()
        assert all(sum(parts for _, parts, _ in where) <= 2 for where in goes)
    monkeypatch.setattr(dedup, "UNITS", 8000)
    rng = random.Random(10)
    rows = [(k, "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice((250, 260, 300))))) for k in range(200)]
    rows += [(k + 200, t[:100] + "z" + t[100:]) for k, t in rows[::5]] + [(k + 500, t) for k, t in rows[::3]]  # copies, in several map tasks
    texts = spark.createDataFrame(rows, "rec bigint, t string").repartition(5)
    groups = dedup._grouped(dedup.folded_rows(texts, "rec", "t"))
    units, _ = dedup._units(groups)
    files = dedup.Files(texts, groups, units, dedup.Plan.meeting(units, 4))
    stored = [dedup._unpack_texts(blobs)[0].rec.tolist() if (blobs := files.read(files.folder, f)) else [] for f in range(sum(files.parts.values()))]
    assert len(files.parts) == 3 and sum(map(bool, stored)) > 20
    assert sorted(r for own in stored for r in own) == sorted({t: k for k, t in reversed(rows)}.values())
    got = {r["dup"]: r["first"] for r in dedup.near_repeats(texts, groups, units, dedup.ranks([t for _, t in rows])).collect()}
    assert got == {k + 200: k for k in range(0, 200, 5)}


def test_stored_segments(spark, tmp_path):
    rows = chains(random.Random(8), 60) + [(1000, "q"), (1001, "Q!")]
    want = in_turn(rows[:-1]) | {1001: 1000}
    store = dedup.Segments(spark, f"file://{tmp_path}/history")
    got = {}
    for a, b in ((0, 150), (150, 250), (250, 300), (300, 330), (330, 2000), (2000, 3000)):
        part = spark.createDataFrame([r for r in rows if a <= r[0] < b], "id bigint, content string")
        got |= {r["dup_id"]: r["first_id"] for r in store.accept(part, "id", "content").collect()}
    assert got == want
    version, segments = store.listed()
    assert version == 6 and len(segments) <= 3 and sum(n for _, n in segments) == len(rows) - len(want)


def test_templates_with_shared_openings_and_borders(spark):
    rng = random.Random(9)
    opening = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(260))
    base = [opening + "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(140)) for _ in range(100)]
    half = ["".join(rng.choice((chr(0x4E00 + rng.randrange(900)), rng.choice("abcdefgh"))) for _ in range(300)) for _ in range(50)]
    copies = [t[:-1] + "Z" for t in half] + [t[:260] + "".join("々" if i % 4 == 1 and i < 120 else c for i, c in enumerate(t[260:])) for t in base]
    ids = list(range(300))
    rng.shuffle(ids)
    rows = list(zip(ids, base + half + copies))
    want = in_turn([(k, t.lower()) for k, t in rows])
    df = spark.createDataFrame([(k, t, k // 30) for k, t in rows], "id bigint, content string, ingest_batch int")
    assert len(want) == 150 and {r["dup_id"]: r["first_id"] for r in dedup.text_repeats(df, "id", "content", "ingest_batch").collect()} == want


def test_file_digests(spark):
    h = "ab" * 32
    rows = [(1, h), (2, f" SHA256:{h.upper()} "), (3, "0" * 64), (4, "0" * 64), (5, dedup.EMPTY_DIGEST), (6, dedup.EMPTY_DIGEST), (7, None), (8, "x"), (9, "x"), (2, f" SHA256:{h.upper()} ")]
    df = spark.createDataFrame(rows, "id bigint, file_hash string")
    assert {tuple(r) for r in dedup.file_repeats(df, "id", "file_hash").collect()} == {(1, 2)}


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    w, p = rng.integers(0, 50, 400).astype(float), rng.random(400)
    rec = np.arange(400)
    mean = np.zeros(400)
    for salt in range(300):
        out = mixing.pivotal(rec, w, p, salt)
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert abs((w * out).sum() - (w * p).sum()) < 1e-6 * 400 + 1e-6 or (w == 0).any()
        mean += out / 300
    assert np.abs(mean - p).mean() < 0.03


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    counts, quota = mixing.prepared(d, t, **kw)
    m = mixing.mixture(counts, quota)
    return m, {r["source"]: r for r in mixing.share_report(m, quota).collect()}


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, text(rng, rng.randrange(1, 40)), rng.choice([" A", "a ", "B", "c", None]), "x") for i in range(1500)]
    docs += [docs[0], (5000, None, "a", "x")]
    m, report = mix(spark, docs, [("a", 0.5, 1), ("b ", 0.3, 3), ("C", 0.1, 2), ("none", 0.1, 5), (None, 1.0, 1)])
    assert set(report) == {"a", "b", "c", "none"} and report["none"]["mix_tokens"] == 0
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert report[s]["actual_share"] == pytest.approx(share, abs=0.01)
        assert report[s]["most_copies"] <= report[s]["max_repeats"]
    again = {tuple(r) for r in m.collect()}
    assert again == {tuple(r) for r in m.collect()} and len({r[0] for r in again}) == len(again)


def test_empty_mixture(spark):
    m, report = mix(spark, [], [("a", 1.0, 1)])
    assert m.count() == 0 and report["a"]["actual_share"] == 0.0
    m, report = mix(spark, [(1, "x", "a", "")], [])
    assert m.count() == 0 and not report


def test_pair_features():
    assert pairs.says_nothing(None) and pairs.says_nothing("【结论】\n\n【依据】\n") and pairs.says_nothing("N/A") and not pairs.says_nothing("否。")
    assert pairs.repeats_question("免赔额是多少？", "您问的是：免赔额是多少") == 1.0
    assert pairs.repeats_question("免赔额是多少？", "免赔额是多少？27日") < 1.0
    assert [pairs.breaks_off(t) for t in ("完成。", "完成。[3]", "项目：\n- 床位费", "比例为", "见附表22.3（参见", "cost of", "注明“须经同意。")] == [0, 0, 0, 1, 2, 2, 2]


def test_long_answers_that_say_nothing():
    for t in (" " * 500, "\u200b" * 401, "……\n" * 200, "【结论】\n\n" * 100):
        assert pairs.says_nothing(t)
    assert not pairs.says_nothing("【结论】\n\n" * 100 + "可以。") and not pairs.says_nothing("a" * 500)


def test_classifier_held_out():
    rng = random.Random(5)
    zh = ["保险人收到{}后{}日内提交{}，赔付比例为{}%。", "受益人在{}接受治疗的，承保机构按{}%给付{}，以{}天为限。"]
    rows = [(f"{rng.choice(['免赔额', '等待期'])}是多少", "".join(rng.choice(zh).format(rng.choice(["批单", "医院"]), rng.randrange(99), rng.choice(["保险单", "床位费"]), rng.randrange(99)) for _ in range(3))) for _ in range(150)]
    rows += [("How many days do I have?", "".join(f"The insurer shall pay {rng.randrange(99)}% of room charges within {rng.randrange(99)} days. " for _ in range(3)).strip()) for _ in range(150)]
    profiles = pairs.adapted_profiles(rows)
    model, f1 = pairs.fit(rows, profiles)
    assert min(f1.values()) > 0.9
    q = ["免赔额是多少", "免赔额是多少", "免赔额是多少，请用英文回答", "How many days do I have?", "免赔额是多少"]
    a = ["The insurer shall pay 10% of room charges within 5 days. The insurer shall pay 20% of room charges within 9 days.", "抱歉，我无法回答这个问题。", "The insurer shall pay 10% of room charges within 5 days.", "The insurer shall pay 10% of room cha", rows[0][1]]
    got = [x[0] if x else None for x in pairs.judge(q, a, model, profiles)]
    assert got == ["wrong_language", "refusal", None, "truncated", None]


def test_ends_far_from_open_brackets_and_long_list_entries():
    assert pairs.breaks_off("（" + "保险人承担责任，" * 90 + "完成。") == 2 and pairs.breaks_off("（" + "保险人承担责任，" * 90 + "完成）。") == 0
    assert pairs.breaks_off("项目：\n- " + "床位费" * 90) == 0


def test_several_defects_of_a_pair():
    rng = random.Random(6)
    zh = ["保险人收到{}后{}日内提交{}，赔付比例为{}%。", "受益人在{}接受治疗的，承保机构按{}%给付{}，以{}天为限。"]
    rows = [(f"{rng.choice(['免赔额', '等待期'])}是多少", "".join(rng.choice(zh).format(rng.choice(["批单", "医院"]), rng.randrange(99), rng.choice(["保险单", "床位费"]), rng.randrange(99)) for _ in range(3))) for _ in range(150)]
    rows += [("How many days do I have?", "".join(f"The insurer shall pay {rng.randrange(99)}% of room charges within {rng.randrange(99)} days. " for _ in range(3)).strip()) for _ in range(150)]
    profiles = pairs.adapted_profiles(rows)
    model, _ = pairs.fit(rows, profiles)
    found = pairs.defects(["免赔额是多少"] * 3, ["The insurer shall pay 10% of room charges within 5 days. The insurer shall pay 20% of room cha", rows[1][1], None], model, profiles)
    assert set(found[0]) == {"wrong_language", "truncated"} and found[1] == {} and set(found[2]) == {"empty"}


def test_pairs_of_odd_tables(spark):
    schema = "id bigint, query string, response string, k string, q string"
    assert pairs.defective_pairs(spark.createDataFrame([], schema), "id", "query", "response").count() == 0
    rows = [(1, None, None, "", ""), (2, "免赔额是多少", "免赔额是多少", "", ""), (2, "免赔额是多少", "免赔额是多少", "", ""), (3, None, "可以。", "", ""), (4, "x", "a" * 100_000 + "。", "", "")]
    got = {(r["id"], r["defect"]) for r in pairs.defective_pairs(spark.createDataFrame(rows, schema), "id", "query", "response").collect()}
    assert got == {(1, "empty"), (2, "copy")}
    assert len(langid.LANGS) == 11
