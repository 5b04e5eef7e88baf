import random
import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import p1_leaks, p2_neardup, p3_sample, p4_personal, p5_abuse, p6_pairs, p7_pack, p8_mix, p9_sentences
from granary.llm.thresholds import find_thresholds, hash63
from granary.llm.words import hashes

VOCAB = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "te", "vi", "zu") for b in ("bat", "dor", "fin", "gul", "hem", "jak")]


# ---------------------------------------------------------------------------- 1


def test_leaks_are_found_and_usual_turns_are_not(spark):
    rng = random.Random(1)
    many = [a + b for a in VOCAB for b in VOCAB[::3]]
    items = [(i, " ".join(rng.choices(many, k=50)), "A") for i in range(12)]
    filler = lambda n: " ".join(rng.choices(many, k=n))
    texts = [("t", 1, filler(80) + " " + items[3][1].upper().replace(" ", "  ") + " " + filler(90)), ("t", 2, filler(200)), ("t", 3, None), ("t", 4, ""), ("t", 5, " ".join(items[5][1].split()[:30])), ("t", 6, " ".join(items[6][1].split()[:8]) + " " + filler(60))]
    w = items[7][1].split()
    for k in range(3, 50, 8):
        w[k] = rng.choice(many)
    texts.append(("t", 7, " ".join(w).replace("a", "а")))  # every eighth word differs, letters of another script
    texts += [("t", 100 + k, filler(120)) for k in range(40)]
    df = spark.createDataFrame([(*t, 0) for t in texts], "tbl string, rec_id bigint, text string, item_id int")
    held = spark.createDataFrame([*items, (99, items[3][1], None), (100, None, None), (101, "", None)], "item_id bigint, text string, answer string")
    got = {(r["rec_id"], r["item_id"]) for r in p1_leaks.find_leaks(df, held).collect()}
    assert got == {(1, 3), (1, 99), (5, 5), (7, 7)}
    assert p1_leaks.find_leaks(df, held.limit(0)).count() == 0


def test_half_of_an_item_is_found_in_long_texts(spark):
    rng = random.Random(4)
    rare = [a + b for a in VOCAB for b in VOCAB]
    words = lambda n: [w for _ in range(n // 2) for w in (rng.choice(VOCAB), rng.choice(rare))]
    items = [[*rng.choices(VOCAB, k=40), *rng.choices(rare, k=40)] for _ in range(30)]
    rows = [(1_000 + i, " ".join(words(400))) for i in range(200)]
    for i in range(120):  # the half that weighs less, among other words
        doc, at = words(400), rng.randrange(400)
        rows.append((i, " ".join(doc[:at] + items[i % 30][:40] + doc[at:])))
    df = spark.createDataFrame([("t", *r) for r in rows], "tbl string, rec_id bigint, text string")
    held = spark.createDataFrame([(k, " ".join(w), None) for k, w in enumerate(items)], "item_id bigint, text string, answer string")
    got = {(r["rec_id"], r["item_id"]) for r in p1_leaks.find_leaks(df, held).collect()}
    assert len({(i, i % 30) for i in range(120)} - got) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefx"), max_size=150), st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=90), min_size=1, max_size=3), st.sampled_from([0.45, 0.5]))
def test_blocks_lose_no_stretch(text, items, least):
    found, lengths = hashes([" ".join(text)])
    own = p1_leaks.Items([" ".join(i) for i in items], np.arange(p1_leaks.BUCKETS) % 7.0, [least] * len(items))
    at, g = own.places(found)
    _, start, item = own.possible(at, g, lengths[lengths > 0]) if len(text) else ([], [], [])
    blocks = set(zip(start, item))
    for k, i in enumerate(items):
        size = p1_leaks.stretch_of(len(i))
        for s in range(len(text)):
            common = p1_leaks.subsequence(i, text[s : s + size])
            if common >= own.least[k]:
                begin = s // p1_leaks.BLOCK // 2 * 2
                assert (begin, k) in blocks
                lo, hi = np.array([begin * p1_leaks.BLOCK]), np.array([min(len(text), (begin + own.span[k]) * p1_leaks.BLOCK)])
                assert hi[0] >= min(len(text), s + size)
                assert own.shared(np.array([k]), lo, hi, at, g)[0] >= common


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=140), min_size=1, max_size=4), st.lists(st.sampled_from("abcdz"), max_size=150), st.booleans())
def test_subsequences_of_many_equal_table(items, text, dense):
    letters = {c: k for k, c in enumerate("abcd")}
    masks = p1_leaks.Masks([np.array([letters[c] for c in i]) for i in items], 4)
    masks.dense = masks.dense if dense else None
    region = np.array([[letters.get(c, -1) for c in text]] * len(items)).reshape(len(items), -1)
    assert p1_leaks.lcs_lengths(masks, np.arange(len(items)), region).tolist() == [p1_leaks.subsequence(i, text) for i in items]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_subsequence_equals_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert p1_leaks.subsequence(a, b) == t[-1][-1]


def test_leaks_in_scripts_without_spaces(spark):
    rng = random.Random(3)
    zh, th = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经", "กขคงจฉชซญดตถทธนบปพฟภมยรลวศสหอ"
    make = lambda abc, n: "".join(rng.choices(abc, k=n))
    items = [(1, make(zh, 60), None), (2, make(th, 70), None), (3, make(zh, 50), None)]
    def edited(t, every):
        return "".join("x" if k % every == every - 1 else c for k, c in enumerate(t))
    rows = [("t", 1, make(zh, 80) + edited(items[0][1], 12) + make(zh, 90)), ("t", 2, make(th, 60) + " " + items[1][1][:50] + " " + make(th, 60)), ("t", 3, make(zh, 200)), ("t", 4, items[2][1][:12] + make(zh, 100))]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, text string")
    held = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    assert {(r["rec_id"], r["item_id"]) for r in p1_leaks.find_leaks(df, held).collect()} == {(1, 1), (2, 2)}


def test_the_answer_decides_where_words_fall_short(spark):
    rng = random.Random(8)
    many = [a + b for a in VOCAB for b in VOCAB]
    stem, right = rng.choices(many, k=46), rng.choices(many, k=4)
    item = " ".join(stem) + "\nA) " + " ".join(rng.choices(many, k=4)) + "\nB) " + " ".join(right)
    near = stem[:22]  # with the answer 26 of 56 words, under a half
    rows = [("t", 1, " ".join([*near, *right])), ("t", 2, " ".join([*near, *rng.choices(many, k=1), *right[:3], *rng.choices(many, k=1)])), ("t", 3, " ".join(stem))]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, text string")
    held = spark.createDataFrame([(5, item, "B")], "item_id bigint, text string, answer string")
    got = {r["rec_id"]: (r["share"], r["answer_found"]) for r in p1_leaks.find_leaks(df, held).collect()}
    assert set(got) == {1, 3} and got[1][0] < 0.5 and got[1][1] and not got[3][1]
    assert {r["rec_id"] for r in p1_leaks.find_leaks(df, held, with_answer=0.5).collect()} == {3}
    assert p1_leaks.answer_words("no options", "B") == [] and len(p1_leaks.answer_words("", "two words")) == 2


def test_held_out_sets_over_the_bound_take_several_passes(spark, monkeypatch):
    rng = random.Random(9)
    many = [a + b for a in VOCAB for b in VOCAB]
    items = [(k, " ".join(rng.choices(many, k=40)), None) for k in range(30)]
    rows = [("t", k, " ".join(rng.choices(many, k=60)) + " " + items[k][1]) for k in range(30)]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, text string")
    held = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    monkeypatch.setattr(p1_leaks, "MAX_ITEMS", 12)
    assert {(r["rec_id"], r["item_id"]) for r in p1_leaks.find_leaks(df, held).collect()} == {(k, k) for k in range(30)}


def test_hashed_words():
    one = lambda t: hashes([t])[0].tolist()
    assert one("The CAFÉ, Straße") == one("the cafe\u0301 strasse") == one("ｔｈｅ café—STRASSE")
    assert one("ﬁnd p\u0430y so\u00adft") == one("find pay soft") and one("") == one("_ - !") == []
    assert len(one("中文字")) == 2 and len(one("中 ไท x中")) == 4
    found, lengths = hashes(["a b", "", "中文 c"])
    assert lengths.tolist() == [2, 0, 2] and len(found) == 4
    assert one("w" * 400_000 + " a")[1] == one("a")[0] and one("\ud800 a") == one("a")


# ---------------------------------------------------------------------------- 2


def near_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
        else:
            w = rng.choices(VOCAB, k=rng.randrange(30, 80))
        rows.append((i % 2, i, " ".join(w)))
    return [*rows, (0, 100, None), (0, 101, ""), (0, 102, "abc"), (0, 103, "ABC!"), (0, 104, rows[0][2].upper() + "!!"), (1, 104, rows[1][2])]


def near_truth(rows, lo=0.8):
    s = {(t, i): p2_neardup.shingles(p2_neardup.normalise(x)) for t, i, x in rows if x}
    sim = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    return {(t, i, j): sim(s[t, i], s[u, j]) for t, i in s for u, j in s if t == u and i < j and sim(s[t, i], s[u, j]) > lo}


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    truth = near_truth(rows)
    clear = {k for k, v in truth.items() if v > 0.83}
    near = p2_neardup.NearDuplicates(spark.createDataFrame(rows, "tbl tinyint, id bigint, text string"))
    got = {tuple(r) for r in near.pairs().collect()}
    assert clear <= got <= set(truth)
    groups = {(r["tbl"], r["id"]): r["group_id"] for r in near.groups().collect()}
    assert all(groups[t, a] == groups[t, b] for t, a, b in got)
    assert groups[0, 104] == groups[0, 0] and (0, 102) not in groups


def test_groups_have_every_record(spark, tmp_path):
    from granary.llm.queries import QUERIES

    texts = ["A long enough question about ledgers.", None, "", "abc", "A long enough question, about LEDGERS", "?!"]
    spark.createDataFrame(list(enumerate(texts)), "seed_id bigint, question string").write.parquet(f"{tmp_path}/seed_questions.parquet")
    spark.createDataFrame([(7, None), (8, [(0, None)])], "seed_id bigint, messages array<struct<turn int, content string>>").write.parquet(f"{tmp_path}/seed_conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["p2_groups"](spark, str(tmp_path)).collect())
    q, c = "seed_questions", "seed_conversations"
    assert got == [(c, 7, 7, 0), (c, 8, 8, 0), (q, 0, 0, 0), (q, 1, 1, 0), (q, 2, 2, 0), (q, 3, 3, 0), (q, 4, 0, 0), (q, 5, 5, 0)]


def test_short_near_duplicates_pass_whatever_the_estimate(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(string.ascii_lowercase, k=rng.randrange(20, 36))) for _ in range(8_000)]
    others = [t + "".join(rng.choices(string.ascii_lowercase, k=len(t) // 8)) for t in texts]
    s, t = p2_neardup.samples(texts), p2_neardup.samples(others)
    zero = np.zeros(len(texts), dtype=np.int64)
    met = (p2_neardup.bands(s, zero) == p2_neardup.bands(t, zero)).any(axis=1)
    bits = [sum(int(x).bit_count() for x in r) for r in (p2_neardup.odd_sketch(s) ^ p2_neardup.odd_sketch(t)).view(np.uint64)]
    lost = [k for k in np.flatnonzero(met).tolist() if bits[k] > p2_neardup.MOST_BITS]
    rows = [(0, 2 * i + j, x) for i, k in enumerate(lost) for j, x in enumerate((texts[k], others[k]))]
    truth = {k for k, v in near_truth(rows).items() if v > 0.8}
    assert truth
    near = p2_neardup.NearDuplicates(spark.createDataFrame(rows, "tbl tinyint, id bigint, text string"))
    assert {tuple(r) for r in near.pairs().collect()} == truth


def test_near_duplicates_of_nothing(spark):
    near = p2_neardup.NearDuplicates(spark.createDataFrame([], "tbl tinyint, id bigint, text string"))
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_odd_sketch_estimates_similarity():
    rng = random.Random(5)
    a = "".join(rng.choices(string.ascii_lowercase, k=3000))
    b = a[:300] + "".join(rng.choices(string.ascii_lowercase, k=150)) + a[450:]
    s = p2_neardup.samples([a, b, ""])
    sk = p2_neardup.odd_sketch(s)
    bits = sum(int(x).bit_count() for x in (sk[0] ^ sk[1]).view(np.uint64))
    true = len(p2_neardup.shingles(a) & p2_neardup.shingles(b)) / len(p2_neardup.shingles(a) | p2_neardup.shingles(b))
    assert abs(p2_neardup.estimate(bits) - true) < 0.12


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 22), (21, 22), (5, 6), (6, 7), (7, 8), (8, 9)]
    got = {r["id"]: r["component"] for r in p2_neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}


# ---------------------------------------------------------------------------- 3 and 8


def by_priorities(counts, shares, floors, n):
    rows = [(r > f, (r - 0.5) / s, i) for i, (c, s, f) in enumerate(zip(counts, shares, floors)) for r in range(1, c + 1) if s > 0 or r <= f]
    out = [0] * len(counts)
    for _, _, i in sorted(rows)[:n]:
        out[i] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from([0.1, 0.2, 0.25, 0.45]), st.integers(0, 6)), min_size=1, max_size=5), st.integers(0, 60))
def test_seats_equal_smallest_priorities(cats, n):
    counts, shares, floors = zip(*cats)
    assert p3_sample.divisor_seats(list(counts), list(shares), list(floors), n) == by_priorities(counts, shares, floors, n)


def test_sample_rows_match_report(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        v = rng.choice(["Alpha one", " alpha-ONE", '"ALPHA_ONE"', "beta", "BETA ", "gamma", None, "other", ""])
        rows.append((i, f"k{i % 350}" if i % 17 else None, v, i))
    df = spark.createDataFrame(rows, "seed_id bigint, key string, level string, ingested_at int")
    targets = spark.createDataFrame([(1, "t", "level", "alpha_one", 0.5, 5, 60), (1, "t", "level", "Beta", 0.3, 5, 60), (1, "t", "level", "gamma", 0.2, 100, 60), (1, "t", "level", "none", 0.1, 0, 60)], "plan_id int, tbl string, field string, category string, target_share double, min_rows bigint, sample_rows bigint")
    s = p3_sample.sample_to_targets({"t": (df, "key")}, targets)
    report = {r["category"]: r for r in s.report.collect()}
    per = {r["category"]: r["n"] for r in s.rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(per.values()) == 60 and all(per.get(c, 0) == r["seats"] for c, r in report.items())
    assert report["gamma"]["unmet"] and report["none"]["unmet"] and not report["alpha_one"]["unmet"]
    ranks = sorted(r["rank"] for r in s.rows.filter("category = 'Beta'").collect())
    assert ranks == list(range(1, len(ranks) + 1))
    empty = p3_sample.sample_to_targets({"t": (df.limit(0), "key")}, targets)
    assert empty.rows.count() == 0 and empty.report.filter("available > 0").count() == 0


def test_thresholds_equal_sorted_prefix(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.randrange(1, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, id bigint, size bigint").withColumn("h", hash63(F.col("id")))
    budgets = [(("a",), 5000), (("a",), 0), (("b",), 10**9), (("c",), 5), (("b",), 777)]
    cuts = find_thresholds(df, ["g"], budgets)
    data = df.collect()
    for (g, budget), c in zip(budgets, cuts):
        took = 0
        for r in sorted((r for r in data if r["g"] == g[0]), key=lambda r: r["h"]):
            if took + r["size"] > budget:
                break
            took += r["size"]
        assert c.weight == took
        assert sum(r["size"] for r in data if r["g"] == g[0] and r["h"] < c.below) == took


def test_mix_shares_repeats_and_shortfall(spark):
    docs = [(i, "x" * (i % 90), ["web", "Web ", "books", "rare", None][i % 5]) for i in range(500)] + [(1000, None, "web"), (1001, "", "web")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id bigint, text string, source string, copies int")
    size = {s: sum(len(t or "") + 1 for _, t, x in docs if x and x.strip().lower() == s) for s in ("web", "books", "rare")}
    total = size["web"] + size["books"]
    targets = spark.createDataFrame([(1, "web", 0.5, 2, total), (1, "books", 0.3, 1, total), (1, "rare", 0.9, 3, total), (1, "gone", 0.1, 3, total)], "mix_id int, source string, target_weight double, max_repeats int, total_tokens bigint")
    mix = p8_mix.mix_sources(df, targets)
    report = {r["source"]: r for r in mix.report.collect()}
    assert {s for s, r in report.items() if r["is_short"]} == {s for s, w, m in (("web", 0.5, 2), ("books", 0.3, 1), ("rare", 0.9, 3), ("gone", 0.1, 3)) if size.get(s, 0) * m < total * w}
    for r in mix.rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.max("copies").alias("m")).collect():
        assert r["n"] == report[r["source"]]["mixed_tokens"] <= report[r["source"]]["target_tokens"] + 1e-6
        assert r["m"] <= report[r["source"]]["max_repeats"]
    assert report["web"]["target_tokens"] - report["web"]["mixed_tokens"] <= 91
    assert p8_mix.mix_sources(df.limit(0), targets).report.filter("not is_short").count() == 0


# ---------------------------------------------------------------------------- 4


NAMES = ["Petra", "Will", "Asha", "May"]


@pytest.mark.parametrize("text, want", [
    ("Write to a.b+c@mail.example, please.", [("email", "a.b+c@mail.example")]),
    ("Send it to jo [at] post.example. Call me.", [("email", "jo [at] post.example")]),
    ("mail jo (at) post (dot) example now", [("email", "jo (at) post (dot) example")]),
    ("Call (03) 5550 4364 ext. 12 today", [("phone", "(03) 5550 4364 ext. 12")]),
    ("text (+1 (202) 555-0172) once", [("phone", "+1 (202) 555-0172")]),
    ("Ticket 11739296 and receipt R-1157-2373 and shipment 39 707 671 597", []),
    ("Invoice no. 646 601 061 is due", []),
    ("my tax file number is 142 573 340 here", [("id_number", "142 573 340")]),
    ("passport NX4652929, Medicare card 4862 85111 7/1", [("id_number", "NX4652929"), ("id_number", "4862 85111 7/1")]),
    ("We moved to Unit 3, 12A Old Mill Rd, Upper Yarrin NSW 2999 and left", [("street_address", "Unit 3, 12A Old Mill Rd, Upper Yarrin NSW 2999")]),
    ("deliver to 39/364 old mill road upper yarrin.", [("street_address", "39/364 old mill road upper yarrin")]),
    ("the lease at 43 yarn way covers our rent", [("street_address", "43 yarn way")]),
    ("It was posted on 26 March by close of trade.", []),
    ("My name is Petra van Dorn and I run it", [("person_name", "Petra van Dorn")]),
    ("Ask for Will if you can", [("person_name", "Will")]),
    ("In May the bill rose and we will pay", []),
    ("According to Hollis, Asha, an analyst, it fell", [("person_name", "Hollis, Asha")]),
    ("It was signed by Dr O'Brack-Mott and Petra M. Lowe", [("person_name", "O'Brack-Mott"), ("person_name", "Petra M. Lowe")]),
    ("We run Asha Foundry Ltd in Gressa", []),
    ("", []),
    (None, []),
])
def test_pieces(text, want):
    got = [(p.kind, text[p.start : p.end]) for p in p4_personal.Finder(NAMES).pieces(text)]
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 3000), st.integers(0, 5))
def test_feistel_is_a_permutation(size, k):
    key = b"k%d" % k
    sample = range(size) if size < 400 else random.Random(k).sample(range(size), 200)
    out = [p4_personal.feistel(i, size, key) for i in sample]
    assert len(set(out)) == len(out) and all(0 <= x < size for x in out)


def test_pseudonyms_keep_format_validity_and_links():
    key = b"secret"
    a, b = p4_personal.pseudonym("51 824 753 556", "id_number", key), p4_personal.pseudonym("51-824-753-556", "id_number", key)
    assert re.fullmatch(r"\d\d \d{3} \d{3} \d{3}", a) and a.replace(" ", "") == b.replace("-", "")
    d = a.replace(" ", "")
    assert p4_personal._abn_digits(d[2:]) == d[:2]
    assert p4_personal.pseudonym("Jo@X.example", "email", key) == p4_personal.pseudonym("jo (at) x (dot) example", "email", key)
    assert re.fullmatch(r"[A-Z]{2}\d{7}", p4_personal.pseudonym("NX4652929", "id_number", key))
    assert p4_personal.permute_date("2001-02-03", key) != "2001-02-03" and p4_personal.permute_date("2001-02-33", key) == "2001-02-33"


@pytest.mark.parametrize("date, shape", [("1980-03-12", r"\d{4}-\d\d-\d\d"), ("12/03/1980", r"\d\d/\d\d/\d{4}"), ("3.12.80", r"\d+\.\d+\.\d\d"), ("12 March 1980", r"\d+ [A-Z][a-z]+ \d{4}"), ("March 12th, 1980", r"[A-Z][a-z]+ \d+th, \d{4}"), ("03/25/1980", r"\d\d/\d\d/\d{4}"), ("12. März 1980", r"\d+\. [A-Z][a-zä]+ \d{4}"), ("12 de marzo de 1980", r"\d+ de [a-z]+ de \d{4}")])
def test_dates_of_birth_are_permuted_in_their_format(date, shape):
    got = p4_personal.redact(f"I was born on {date}, not on 12/03/1970.", [], b"secret")
    assert date not in got and re.fullmatch(rf"I was born on {shape}, not on 12/03/1970\.", got)


def test_redaction_of_tables(spark):
    df = spark.createDataFrame([("t", 1, 0, "Call 0491 570 156 now", "x"), ("t", 2, None, None, "x"), ("t", 3, 1, "", "x")], "tbl string, rec_id bigint, turn int, text string, kind string")
    names = spark.createDataFrame([("Petra",), (None,)], "name string")
    got = {r["rec_id"]: r["text"] for r in p4_personal.redact_personal(df, names, b"k").collect()}
    assert re.fullmatch(r"Call \[phone \d{4} \d{3} \d{3}\] now", got[1]) and got[2] is None and got[3] == ""
    assert p4_personal.find_personal(df.limit(0), names, b"k").count() == 0


# ---------------------------------------------------------------------------- 5


def test_classifier_learns_and_normalises():
    rng = random.Random(9)
    calm = [" ".join(rng.choices(VOCAB, k=8)) + "." for _ in range(400)]
    bad = [f"You {rng.choice(['stupid', 'filthy', 'useless'])} {rng.choice(['moron', 'bastard', 'idiot'])}, go {rng.choice(VOCAB)}." for _ in range(60)]
    labelled = [(t, 1, 1) for t in bad[:40]] + [(t, 0, 0) for t in calm[:80]] + [(calm[90], 0, 1), (calm[91], None, None), (None, 1, 1)]
    net = p5_abuse.fit(labelled, calm[100:300])
    s = p5_abuse.Scorer(net)
    good, wrong = s.score([p5_abuse.clean(t) for t in calm[300:]]), s.score([p5_abuse.clean(t) for t in bad[40:]])
    assert (wrong > 0.5).mean() > 0.9 and (good < 0.5).mean() > 0.9
    assert s.score([]).shape == (0,)
    assert p5_abuse.tokens(p5_abuse.clean("sh1t b*****d s l u t ba​stаrds")) == ["shit", "*masked*", "slut", "bastard"]


# ---------------------------------------------------------------------------- 6

Q = "The ledger fell by 4% in the second half of the year. Which statement about the ledger is most accurate?\nA) It rises again\nB) It stays at par\nC) It falls further"


@pytest.mark.parametrize("response, want", [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("N/A", "empty"), ("(no response)", "empty"), ("​", "empty"), ("Answer:", "empty"),
    ("C", None), ("(b)", None), ("Answer: B\nReason: It stays where it is.", None), ("Reason: The ledger moves to par\nAnswer: B", None),
    ("I'm sorry, but I can't help with that.", "refusal"), ("Lo siento, no puedo ayudar con eso.", "refusal"),
    ("I can't say what suits any one client, but on these facts B is correct because it holds.", None),
    (Q, "copies_question"), ("You asked: The ledger fell by 4% in the second half of the year. Which statement about the ledger is most acurate?", "copies_question"),
    ("Reason: Die Bank erhöht den Zins, und die Rücklage deckt das Risiko nach der Inventur.\nAnswer: B", "other_language"),
    ("Reason: The reserve of the bank covers the ledg", "truncated"), ("Reason: The reserve is held (at the", "truncated"),
])
def test_defects(response, want):
    assert p6_pairs.defect(Q, response) == want


def test_defects_of_null_question_and_table(spark):
    assert p6_pairs.defect(None, "It is the second one.") is None
    df = spark.createDataFrame([(1, Q, None, "x"), (2, None, "Fine.", "x"), (3, Q, "C", "x")], "seed_id bigint, question string, response string, defect string")
    assert [tuple(r) for r in p6_pairs.find_defects(df).collect()] == [(1, "empty")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_suffix_automaton_runs(a, b):
    subs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i, len(a) + 1)}
    want = [max(k for k in range(i + 2) if tuple(b[i + 1 - k : i + 1]) in subs | {()}) for i in range(len(b))]
    assert p6_pairs.SuffixAutomaton(a).runs(b) == want


# ---------------------------------------------------------------------------- 7


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins_never_overflow(sizes):
    to = p7_pack.sum_of_squares(np.array(sizes, dtype=np.int64), 40)
    fill = np.bincount(to, weights=sizes) if sizes else np.zeros(0)
    assert (fill <= 40).all()
    assert len(fill) <= 2 * -(-sum(sizes) // 40) + 1


def test_packing_keeps_every_token(spark):
    rng = random.Random(11)
    docs = [(i, "é" * rng.randrange(0, 120), "x") for i in range(300)] + [(900, None, "x"), (1, "dup", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, pack_id string")
    cont = spark.createDataFrame([(1, 100), (2, 64), (3, 0), (4, None)], "pack_id int, capacity_tokens bigint")
    p = p7_pack.pack(df, cont, shard_docs=100)
    total = sum(len((t or "").encode()) + 1 for _, t, _ in docs)
    for r in p.rows.groupBy("pack_id").agg(F.sum("n_tokens").alias("n")).collect():
        assert r["pack_id"] in (1, 2) and r["n"] == total
    assert p.fill.filter("used_tokens > capacity_tokens").count() == 0
    split = {r["doc_id"] for r in p.rows.filter("pack_id = 1 and pieces > 1").collect()}
    assert split == {i for i, t, _ in docs if len((t or "").encode()) + 1 > 100}
    assert p.rows.filter("pack_id = 1 and pieces = 1").groupBy("doc_id").count().filter("count > 2").count() == 0
    assert p7_pack.pack(df.limit(0), cont).rows.count() == 0


# ---------------------------------------------------------------------------- 9


@pytest.fixture(scope="module")
def splitter(spark):
    rng = random.Random(13)
    out = []
    for i in range(300):
        a, b, c = (rng.choice(VOCAB) for _ in range(3))
        out.append((i, f"The {a} was approx. {i} of the {b}, cf. the {c} there now. Each {b} paid 4.5% p.a. on the {c}. The {c} and each {a} rose by 3. We saw the {b} of Mt. {a.capitalize()} then. It fell, and we know it."))
    return p9_sentences.Splitter(p9_sentences.learn(spark.createDataFrame(out, "doc_id bigint, text string")))


@pytest.mark.parametrize("text, want", [
    ("The rate was approx. 5 of it. Each rose.", ["The rate was approx. 5 of it.", "Each rose."]),
    ("It paid 4.5% p.a. on time.It fell.", ["It paid 4.5% p.a. on time.", "It fell."]),
    ("# Head\n\nOne line\nwraps now so. Two.\n- item one\n- item two", ["# Head", "One line\nwraps now so.", "Two.", "- item one", "- item two"]),
    ("Kim: Well then. Yes!\nLee: No?", ["Kim: Well then.", "Yes!", "Lee: No?"]),
    ("“Why was it cut?” is still asked. He said, “Go.” Then he left.", ["“Why was it cut?” is still asked.", "He said, “Go.”", "Then he left."]),
    ("The rate climbed to 4.87%... then slid. It fell; it rose.", ["The rate climbed to 4.87%... then slid.", "It fell; it rose."]),
    ("银行降低了余额。经理说：“好。”信用额度增加了。“可以吗？”客户问道。", ["银行降低了余额。", "经理说：“好。”", "信用额度增加了。", "“可以吗？”客户问道。"]),
    ("担当者は「支える。」と述べた。次だ。", ["担当者は「支える。」と述べた。", "次だ。"]),
    ("ธนาคารลดรายการซ้ำ 55 รายการ ผู้จัดส่งยืนยันบ่อยๆ และแจ้ง", ["ธนาคารลดรายการซ้ำ 55 รายการ", "ผู้จัดส่งยืนยันบ่อยๆ และแจ้ง"]),
    ("¿Qué pasa? ¡Nada!", ["¿Qué pasa?", "¡Nada!"]),
    (" \n\n ", []), ("", []), (None, []),
])
def test_sentences(splitter, text, want):
    assert [text[a:b] for a, b in splitter.sentences(text)] == want


@settings(max_examples=80, deadline=None)
@given(st.text("ab. !?\n\"“”()1「」。 A", max_size=60))
def test_sentences_cover_all_text_in_order(splitter, text):
    spans = splitter.sentences(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    left, at = "", 0
    for a, b in spans:
        left += text[at:a]
        at = b
    assert not (left + text[at:]).strip()


def test_sentences_of_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert p9_sentences.split_sentences(empty).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "One. Two.", "x"), (2, "One. Two.", "x"), (3, "a" * 200_000 + ". Next one.", "x"), (4, "﻿​", "x")], "doc_id bigint, text string, lang string")
    got = [tuple(r) for r in p9_sentences.split_sentences(odd).collect()]
    assert sorted(got) == [(2, 0, 4), (2, 0, 4), (2, 5, 9), (2, 5, 9), (3, 0, 200_001), (3, 200_002, 200_011)]


def test_thresholds_are_of_all_background_units(monkeypatch):
    class Known(p5_abuse.Scorer):
        def __init__(self, net):
            pass

        def score(self, segments):
            return np.array([0.75 * ("loud" in s) + 0.95 * ("vile" in s) for s in segments])

    monkeypatch.setattr(p5_abuse, "Scorer", Known)
    words = "the meadow is calm and this is the way to the house"
    units = [f"{words} {i}" for i in range(9_000)] + [f"{words} vile {i}" for i in range(200)] + [f"{words} loud {i}" for i in range(100)]
    known = [p5_abuse.Example([f"a vile word in the house {i}"], 1.0, 4.0, "en") for i in range(10)]
    one, other = (p5_abuse.calibrated([None, None], known, u) for u in (units, units[::-1]))
    assert one.thresholds == other.thresholds and one.thresholds["en"] == pytest.approx(0.76, abs=0.011)
    assert one.held_out["en"]["found"] == 1 and one.held_out["en"]["over"] == pytest.approx(200 / 9_300)
    assert one.threshold("it") == one.thresholds["*"]


def test_members_never_see_their_own_fold(monkeypatch):
    seen = []
    monkeypatch.setattr(p5_abuse, "fit_one", lambda known, background, seed: seen.append(({e.parts[0] for e in known}, set(background))))
    known = p5_abuse.examples([("A calm day.", 0, 0), ("You fool. Go away.", 1, 1), (None, 1, 1), ("x", None, None)])
    units = [f"unit {i}" for i in range(50)]
    for k in range(3):
        p5_abuse.fit_fold(known, units, k, 3)
    assert all(len([1 for e, _ in seen if x.parts[0] in e]) == 2 for x in known) and all(len([1 for _, b in seen if u in b]) == 2 for u in units)


def test_long_sentences_are_learnt_whole():
    words = [f"w{i}" for i in range(300)]
    parts = p5_abuse.pieces(words)
    assert all(len(p) <= p5_abuse.PIECE for p in parts)
    grams = {tuple(p[i : i + 3]) for p in parts for i in range(len(p) - 2)}
    assert grams == {tuple(words[i : i + 3]) for i in range(298)} and p5_abuse.pieces([]) == [[]] and p5_abuse.pieces(["a"]) == [["a"]]


def test_background_does_not_depend_on_the_order_of_tables(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(p5_abuse, "arrow_map", lambda df, *_: df.limit(0))
    monkeypatch.setattr(p5_abuse, "calibrated", lambda nets, known, background: seen.append(background))
    labels = spark.createDataFrame([], "text string, rater_a int, rater_b int")
    rows = [(t, i, f"Text {i} of {t}.") for t in "cadbe" for i in range(2)]
    for r, n in ((rows, 1), (rows[::-1], 3)):
        p5_abuse.fit_on(labels, spark.createDataFrame(r, "tbl string, rec_id bigint, text string").repartition(n))
    assert seen[0] == seen[1] and [u[-2] for u in seen[0]] == list("aabbccddee")


def test_scores_of_empty_and_odd_tables(spark):
    labels = spark.createDataFrame([], "text string, rater_a int, rater_b int")
    texts = spark.createDataFrame([("t", 1, None, 3.0), ("t", 1, "You are a worthless piece of shit.", 1.0), ("t", 2, "", 1.0), ("t", 3, "A calm day.", 1.0)], "tbl string, rec_id bigint, text string, score double")
    net = p5_abuse.fit_on(labels, texts)
    got = {r["rec_id"]: r for r in p5_abuse.score_records(texts, net).collect()}
    assert set(got) == {1, 2, 3} and got[1]["abusive"] and got[2]["score"] == 0 and not got[2]["abusive"]
    assert p5_abuse.score_records(texts.limit(0), net).count() == 0


def test_no_window_cuts_a_long_word():
    finder = p4_personal.Finder([])
    name = "a" * 90
    said = f"Write to {name} (at) {'b' * 120} (dot) example today."
    assert [said[p.start : p.end] for p in finder.pieces(said)] == [f"{name} (at) {'b' * 120} (dot) example"]
    street = "Shop 12, Level 3, 17 " + "W" + "e" * 80 + " Street, Hollin VIC 3000"
    found = [street[p.start : p.end] for p in finder.pieces("See " + street)] and finder.pieces("See " + street)[0]
    assert found.kind == "street_address" and ("See " + street)[found.start : found.end].startswith("Shop 12")
    assert p9_sentences._last_token("x " + "y" * 500 + ".", 0, 501)[-1] == "y" * 499
    assert p9_sentences._last_token("y" * 500, 3, 500) == ["y" * 497] and p9_sentences._last_token("", 0, 0) == []


def test_placeholders_count_words_not_characters():
    assert p6_pairs.defect("What is it?", "N/A" + " " * 80) == "empty" == p6_pairs.defect("What is it?", "\n" * 90 + "n/a")
    assert p6_pairs.defect("What is it?", "no response " * 20) != "empty"


def test_ids_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([(0, 1 << 61, "some text that is long enough")], "tbl int, id bigint, text string").withColumn("tbl", F.col("tbl").cast("tinyint"))
    with pytest.raises(Exception, match="61 bits"):
        p2_neardup.NearDuplicates(df)


def test_packing_invariants_in_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "x" * rng.choice([10, 50, 300, 900, 2500])) for i in range(400)], "doc_id bigint, text string")
    made = p7_pack.pack(docs, spark.createDataFrame([(1, 1000), (2, 4000)], "pack_id int, capacity_tokens bigint"))
    rows, fill, sizes = made.rows.toPandas(), made.fill.toPandas(), docs.select("doc_id", (F.length("text") + 1).alias("size")).toPandas()
    con = duckdb.connect()
    for name, frame in (("placed", rows), ("fill", fill), ("sizes", sizes)):
        con.register(name, frame)
    q = lambda s: con.sql(s).fetchall()
    assert q("SELECT count(*) FROM (SELECT pack_id, container_id, sum(n_tokens) AS n FROM placed GROUP BY ALL) JOIN (SELECT DISTINCT pack_id, capacity_tokens FROM fill) USING (pack_id) WHERE n > capacity_tokens") == [(0,)]
    assert q("SELECT count(*) FROM (SELECT pack_id, doc_id, sum(n_tokens) AS n, count(*) AS k, any_value(pieces) AS p FROM placed GROUP BY ALL) JOIN sizes USING (doc_id) WHERE n <> size OR k <> p") == [(0,)]
    assert q("SELECT count(*) FROM placed r JOIN sizes USING (doc_id) JOIN (SELECT DISTINCT pack_id, capacity_tokens FROM fill) USING (pack_id) WHERE pieces > 1 AND size <= capacity_tokens") == [(0,)]
    assert q("SELECT min(f) > 0.75 FROM (SELECT pack_id, avg(fill) AS f FROM fill GROUP BY 1)") == [(True,)]


def test_equal_values_have_equal_pseudonyms_in_all_documents(spark):
    names = spark.createDataFrame([("Petra",)], "name string")
    rows = [("t", i, 0, f"Hello {i}, call 0412 345 67{i % 2} or write to petra.q@mail.example about TFN 123 456 78{i % 3}.") for i in range(12)]
    df = spark.createDataFrame(rows, "tbl string, rec_id bigint, turn int, text string")
    found = p4_personal.find_personal(df, names, b"one").collect()
    text = {r[1]: r[3] for r in rows}
    by: dict = {}
    for p in found:
        by.setdefault((p["kind"], text[p["rec_id"]][p["start_pos"] : p["end_pos"]]), set()).add(p["pseudonym"])
    assert len(by) == 6 and all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == 6
    other = {r["pseudonym"] for r in p4_personal.find_personal(df, names, b"two").collect()}
    assert not other & {r["pseudonym"] for r in found}


def test_a_score_does_not_depend_on_the_next_sentence():
    rng = np.random.default_rng(2)
    words = ["calm", "vile", "day", "loud"]
    net = p5_abuse.Network({p5_abuse.bucket(w): rng.normal(0, 1, p5_abuse.DIM) for w in words}, [rng.normal(0, 0.2, (w * p5_abuse.DIM, p5_abuse.FILTERS)) for w in p5_abuse.WIDTHS], [np.zeros(p5_abuse.FILTERS) for _ in p5_abuse.WIDTHS], np.abs(rng.normal(0, 1, len(p5_abuse.WIDTHS) * p5_abuse.FILTERS)) / 8, -2.0, {"*": 0.5})
    s = p5_abuse.Scorer(net)
    texts = ["calm day", "vile loud vile", "", "day", "loud vile day calm"]
    alone = [float(s.score([t])[0]) for t in texts]
    assert len(set(alone)) == 5 and s.score(texts) == pytest.approx(alone, abs=1e-6) and s.score(texts[::-1]) == pytest.approx(alone[::-1], abs=1e-6)


def test_every_member_learns_all_examples_in_the_end():
    rng = random.Random(5)
    calm = [" ".join(rng.choices(VOCAB, k=8)) + "." for _ in range(300)]
    labelled = [(t, 0, 0) for t in calm[:60]] + [("Zorvath mulkin drane.", 1, 1)] * 4  # equal texts are in one fold
    net = p5_abuse.fit(labelled, calm[60:])
    assert min(p5_abuse.Scorer(m).score(["zorvath mulkin drane."])[0] for m in net.members) > 0.7


def plain_network(strength):
    """A network that adds up nothing: a sentence's score is that of its strongest word."""
    axis = np.eye(p5_abuse.DIM, dtype=np.float32)[0]
    filters = [np.zeros((w * p5_abuse.DIM, p5_abuse.FILTERS), dtype=np.float32) for w in p5_abuse.WIDTHS]
    filters[0][0, 0] = 1
    out = np.zeros(len(p5_abuse.WIDTHS) * p5_abuse.FILTERS, dtype=np.float32)
    out[0] = 1
    return p5_abuse.Network({p5_abuse.bucket(w): axis * v for w, v in strength.items()}, filters, [np.zeros(p5_abuse.FILTERS) for _ in p5_abuse.WIDTHS], out, -6.0, {"*": 0.5})


def test_every_sentence_is_counted_and_every_unsure_one_is_met(spark):
    net = plain_network({"loud": 6.0, "vile": 12.0, "rude": 7.0})  # scores 0.5, 0.998, 0.73
    rows = [("t", i, f"The meadow is calm. The {'loud' if i % 2 else 'vile' if i % 4 else 'rude'} road is by the house {i}. The end") for i in range(400)]
    rows += [("t", 900, None), ("t", 901, " "), ("t", 902, "El camino")]
    for n in (1, 5):
        over, common, near = p5_abuse.meet(p5_abuse.read_texts(spark.createDataFrame(rows, "tbl string, rec_id bigint, text string").repartition(n)), [net] * 3, [net] * 3)
        assert over["en"][0] == 1200 and over["en"][1] == 200 and over["en"][-1] == 100 and over["es"][0] == 1 and (over["*"] == over["en"] + over["es"]).all()
        assert {w for w in ("meadow", "loud", "calm", "end") if ("en", p5_abuse.bucket(w)) in common} == {"meadow", "loud", "calm", "end"} and ("es", p5_abuse.bucket("camino")) not in common
        want = np.array([p5_abuse.bucket(t) for t in p5_abuse.tokens("the loud road is by the house 7")], dtype=np.int32).tobytes()
        assert [(r["lang"], bytes(r["words"])) for r in near.collect()] == [("en", want)]  # numbers are one word


def test_thresholds_come_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(p5_abuse, "BACKGROUND_TEXTS", 10)
    monkeypatch.setattr(p5_abuse, "GROUP", 20, raising=False)
    labels = spark.createDataFrame([("You stupid moron.", 1, 1), ("A calm day.", 0, 0), ("A day.", None, None), (None, 1, 1)], "text string, rater_a int, rater_b int")
    rng = random.Random(3)
    rows = [("t", i, f"The {rng.choice(VOCAB)} is {rng.choice(VOCAB)} at the {rng.choice(VOCAB)}. You stupid {rng.choice(VOCAB)}!") for i in range(300)]
    texts = spark.createDataFrame(rows, "tbl string, rec_id bigint, text string")
    net = p5_abuse.fit_on(labels, texts)
    assert net.held_out["en"]["background"] == 600 and "en" in net.thresholds
    monkeypatch.setattr(p5_abuse, "MAX_LABELS", 2)
    with pytest.raises(ValueError, match="labelled rows"):
        p5_abuse.fit_on(labels, texts)


def test_networks_are_averaged_one_by_one():
    nets = [plain_network({"loud": v}) for v in (1.0, 3.0, 8.0)]
    mean = p5_abuse.mean_of(p5_abuse.mean_of(nets[0], nets[1], 1), nets[2], 2)
    assert mean.vectors[p5_abuse.bucket("loud")][0] == pytest.approx(4.0) and mean.bias == pytest.approx(-6.0) and mean.out == pytest.approx(nets[0].out)
