"""Near-duplicates, shared spans, leakage, mixing, splitting."""

import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataloom.llm import leakage, mixing, near_duplicates, shared_spans, splitting
from strataloom.session import written


def words(r, n):
    return [r.choice(string.ascii_lowercase) + str(r.randrange(400)) for _ in range(n)]


def edited(r, ws, share):
    out = list(ws)
    for k in r.sample(range(len(out)), int(len(out) * share)):
        out[k] = "new" + str(r.randrange(10**6))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = [words(r, r.randrange(30, 90)) for _ in range(40)]
    rows = [(f"r{i}", " ".join(w), None, 1) for i, w in enumerate(base)]
    rows += [(f"e{i}", " ".join(edited(r, base[i % 40], r.choice([0.02, 0.08, 0.4]))), "", 2) for i in range(60)]
    rows += [("copy", rows[0][1].upper().replace(" ", ",  "), None, 3), ("empty", "", None, 0), ("nulls", None, None, None), (None, "a b c", None, 0), rows[3], ("short", "a", None, 0), ("short2", None, "A!", 0)]
    df = spark.createDataFrame(rows, "id string, t string, u string, rep int")
    members, pairs = near_duplicates.near_duplicates(df, "id", ["t", "u"])
    got = {(x.a, x.b) for x in near_duplicates.record_pairs(members, pairs).collect()}
    bags = {(i, tuple(sorted(Counter(c for c in "".join(ch if ch.isalnum() else " " for ch in f"{t or ''} {u or ''}".lower()).split()).items()))) for i, t, u, _ in rows if i}
    bags = {i: Counter(dict(b)) for i, b in bags if b}
    expected = set()
    for a in bags:
        for b in bags:
            if a < b and sum((bags[a] & bags[b]).values()) * 10 >= 8 * max(sum(bags[a].values()), sum(bags[b].values())):
                expected.add((a, b))
    assert got <= expected
    assert len(expected - got) <= 0.02 * len(expected)
    assert ("short", "short2") in got and ("copy", "r0") in got


def test_near_duplicates_at_the_threshold(spark):
    r = random.Random(5)
    rows = []
    for i in range(500):
        ws = [f"w{r.randrange(10**9)}" for _ in range(120)]
        rows += [(f"a{i}", " ".join(ws[:100])), (f"b{i}", " ".join(ws[20:]))]
    members, pairs = near_duplicates.near_duplicates(spark.createDataFrame(rows, "id string, t string"), "id", ["t"])
    got = {(x.a, x.b) for x in near_duplicates.record_pairs(members, pairs).collect()}
    assert got <= {(f"a{i}", f"b{i}") for i in range(500)}
    assert len(got) >= 490  # of 500 pairs of overlap 0.80


def test_pairs_of_a_band_over_batches(monkeypatch):
    import pyarrow as pa

    r = random.Random(3)
    rows = sorted((r.randrange(12), r.randrange(30)) for _ in range(150))
    monkeypatch.setattr(near_duplicates, "PAIRS", 7)
    batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in part]), pa.array([y for _, y in part])], names=["band", "bag"]) for part in (rows[k : k + 9] for k in range(0, 150, 9))]
    got = [(x, y) for out in near_duplicates._met_rows(iter(batches)) for x, y in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    expected = [(y, z) for band in range(12) for y in {b for a, b in rows if a == band} for z in {b for a, b in rows if a == band} if y < z]
    assert sorted(got) == sorted(expected)


def test_hot_bands_lose_no_pair(spark, monkeypatch):
    r = random.Random(9)
    base = words(r, 60)
    rows = [(f"r{i}", " ".join([*base[:56], *(f"v{i}x{k}" for k in range(4))])) for i in range(150)]
    monkeypatch.setattr(near_duplicates, "SAMPLE", 1)
    records = near_duplicates.texts_of(spark.createDataFrame(rows, "id string, t string"), "id", ["t"])
    bags = written(records.mapInArrow(near_duplicates._bag_rows, "id string, bag long, signature binary, items binary"))
    hot = near_duplicates.bands_of(bags, 0, near_duplicates.BANDS).groupBy("band").count().where("count >= 40").count()
    found = near_duplicates.near_bags(bags, 0.8, hot_rows=40)
    assert hot > 0
    assert found.count() == 150 * 149 // 2 and found.where("round(similarity, 6) <> round(56 / 60, 6)").isEmpty()


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, t string")
    members, pairs = near_duplicates.near_duplicates(df, "id", ["t"])
    assert members.count() == 0 and pairs.count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    least = near_duplicates.least_matches(2 / 3)
    assert len(least) == near_duplicates.SIGNATURE // near_duplicates.BATCH
    assert all(m < (k + 1) * near_duplicates.BATCH * 2 / 3 for k, m in enumerate(least)) and sorted(least) == list(least)


def brute_shared(rows, span):
    where = {}
    for i, t in rows.items():
        for k in range(len(t) - span + 1):
            where.setdefault(t[k : k + span], set()).add(i)
    out = {}
    for i, t in rows.items():
        covered = [False] * len(t)
        for k in range(len(t) - span + 1):
            if len(where[t[k : k + span]]) > 1:
                covered[k : k + span] = [True] * span
        out[i] = sum(covered)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_against_brute_force(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé\n 𝒳") for _ in range(n))
    parts = [text(n) for n in (239, 240, 241, 300, 700)]
    rows = {f"b{i}": text(r.randrange(0, 900)) + r.choice(parts) + text(r.randrange(0, 300)) for i in range(25)}
    rows |= {"same": rows["b1"], "period": "ab" * 700, "period2": "x" + "ab" * 300, "own": (s := text(400)) + text(50) + s, "edge": rows["b2"][:260], "tiny": "a", "empty": ""}
    df = spark.createDataFrame([*[(k, v, "x") for k, v in rows.items()], ("same", rows["same"], "x"), ("null", None, "x"), (None, rows["b1"], "x")], "id string, t string, owner string")
    got = {x.id: (x.n_chars, x.shared_chars) for x in shared_spans.shared_spans(df, "id", "t").collect()}
    expected = brute_shared(rows, 240)
    assert got == {k: (len(rows[k]), v) for k, v in expected.items()} | {"null": (0, 0)}
    assert {x.id for x in shared_spans.sharing_ids(df, "id", "t").collect()} == {k for k, v in expected.items() if v}


def test_sharing_groups(spark):
    r = random.Random(9)
    text = lambda n: "".join(r.choice(string.ascii_letters) for _ in range(n))
    p, q = text(300), text(300)
    df = spark.createDataFrame([("a", text(50) + p), ("b", p + q), ("c", q + text(9)), ("d", text(600))], "id string, t string")
    assert {(x.id, x.group) for x in shared_spans.sharing_groups(df, "id", "t").collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_paragraph_clusters(spark):
    r = random.Random(2)
    p, q, z = " ".join(words(r, 40)), " ".join(words(r, 40)), " ".join(words(r, 40))
    near = " ".join(edited(r, p.split(), 0.05))
    df = spark.createDataFrame([("a", f"{p}\n\n{z}"), ("b", f"short\n\n{near}\n \n{q}"), ("c", f"{q}\n\n{p}"), ("c", f"{q}\n\n{p}"), ("n", None), (None, p), ("e", "")], "id string, t string")
    found = shared_spans.paragraph_clusters(df, "id", "t").collect()
    assert sorted((x.id, x.paragraph_no, x.removed) for x in found) == [("a", 0, False), ("b", 1, True), ("b", 2, False), ("c", 0, True), ("c", 1, True)]
    assert len({x.cluster for x in found}) == 2
    assert shared_spans.paragraph_clusters(df.limit(0), "id", "t").isEmpty()


def test_leakage(spark):
    r = random.Random(4)
    q = words(r, 40)
    cjk = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(60))
    items = spark.createDataFrame([(1, "en", " ".join(q)), (2, "zh", cjk), (3, "en", None), (4, "en", "too short"), (None, "en", " ".join(q)), (1, "en", " ".join(q))], "item_id int, lang string, text string")
    swap = q[5:30]
    swap[8] = swap[16] = "changed"
    docs = [
        (10, "x " + " ".join(q[3:15]).upper().replace(" ", " -- ") + " y"), (11, "x " + " ".join(q[3:14]) + " y"), (12, " ".join(swap)), (13, "。".join(cjk[10:40])), (14, cjk[10:39]), (15, None), (16, ""),
        (17, " ".join(words(r, 300))), (10, "x " + " ".join(q[3:15]).upper().replace(" ", " -- ") + " y"), (18, "ｘ ".join(["", *[w.translate({i: i + 0xFEE0 for i in range(33, 127)}) + " " for w in q[:13]]])),
    ]
    frame = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit(5)).withColumn("seed", F.lit(1))
    rows = leakage.leaks(frame, items)
    found = {(x.doc_id, x.item_id, x.exact) for x in leakage.leaked(rows).collect()}
    assert found == {(10, 1, True), (13, 2, True), (12, 1, False)}
    tolerant = {(x.doc_id, x.item_id): (x.longest_run, x.tolerant_span, x.tolerant_equal) for x in rows.collect()}
    assert tolerant[(12, 1)] == (8, 25, 23) and tolerant[(10, 1)][0] == 12
    blocks = {(x.doc_id, x.item_id, x.exact) for x in leakage.leaked(leakage.leaks(frame, items, block_chars=30)).collect()}
    assert blocks == found


def test_leakage_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    items = spark.createDataFrame([], "item_id int, lang string, text string")
    assert leakage.leaks(docs, items).count() == 0
    assert leakage.leaks(docs.limit(0), spark.createDataFrame([(1, "en", "a b")], "item_id int, lang string, text string")).count() == 0


def simple_mix(docs, targets, total):
    """Fair queueing one draw at a time."""
    draws = []
    for s, (share, cap) in targets.items():
        upto = 0
        for p in range(cap):
            for i, n in docs.get(s, []):
                upto += n
                draws.append((upto / share, i, p, n))
    out, used = Counter(), 0
    for _, i, _, n in sorted(draws):
        if used + n > total:
            break
        used += n
        out[i] += 1
    return out


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, s, " ".join(words(r, r.randrange(5, 40)))) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c "] * 20 + ["C"] * 5 + ["unused"] * 9)]
    rows += [(900, None, "x"), (901, "a", None), (902, "a", ""), (None, "a", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn("tokens", F.lit(1)).withColumn("share", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 4), ("missing", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(docs, targets)
    drawn, shares = drawn.collect(), {x.source: x for x in shares.collect()}
    assert [x.finish for x in drawn] == sorted(x.finish for x in drawn)
    cap = {"a": 1, "b": 4, "c": 4}
    assert all(1 <= x.repeats <= cap[x.source] for x in drawn) and len({x.id for x in drawn}) == len(drawn)
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(shares[s].actual_share - w / 0.95) < 0.02
    assert shares["missing"].drawn_tokens == 0 and abs(sum(x.actual_share for x in shares.values()) - 1) < 1e-9
    half, _ = mixing.mix(docs, targets, total=500.0)
    assert 300 <= sum(x.tokens * x.repeats for x in half.collect()) <= 500


def test_fair_times_equal_one_draw_at_a_time():
    caps, shares = {"a": 100.0, "b": 50.0, "c": 0.0}, {"a": 0.5, "b": 0.4, "c": 0.1}
    for total in (10, 90, 120, 149):
        t = mixing.finish_of(total, caps, shares)
        assert abs(sum(min(caps[s], shares[s] * t) for s in caps) - total) < 1e-6
    assert mixing.largest_total(caps, shares) == pytest.approx(50 / 0.4 * 0.9)
    assert mixing.largest_total({}, shares) == 0.0


def test_mixing_nothing(spark):
    docs = spark.createDataFrame([], "doc_id int, source string, text string")
    drawn, shares = mixing.mix(docs, spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int"))
    assert drawn.count() == 0 and [x.actual_share for x in shares.collect()] == [0.0]


@pytest.mark.parametrize("seed", range(6))
def test_split_round_trip(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "longerword ", "\n", "\n\n", "}\n", "def f():\n", "x" * r.randrange(1, 9000 if seed % 2 else 90)]) for _ in range(2000))
    parts = splitting.split(text)
    assert "".join(text[o:e] for _, o, e, _ in parts) == text
    for k, (s, o, e, _) in enumerate(parts):
        assert e - s <= 6000 and 0 <= o - s <= 200 and (k == 0) == (o == 0)
        assert k == 0 or o == parts[k - 1][2]


def test_split_prefers_strong_boundaries():
    body = "    x = 1\n" * 250
    text = "".join(f"def f{i}():\n{body}\n" for i in range(6))
    assert {splitting.KINDS[g] for *_, g in splitting.split(text)[:-1]} == {"function"}
    assert [p[:3] for p in splitting.split("a" * 13_000)][:2] == [(0, 0, 5800), (5600, 5800, 11600)]


def test_pieces(spark):
    df = spark.createDataFrame([("a", "é" * 6000), ("b", "é" * 6001), ("b", "é" * 6001), ("c", None), ("d", ""), (None, "x" * 9000)], "id string, t string").withColumn("content", F.lit("clash"))
    rows = splitting.pieces(df, "id", "t").orderBy("piece_no").collect()
    assert [(r.id, r.piece_no, r.start_char, r.own_char, r.end_char) for r in rows] == [("b", 0, 0, 0, 5800), ("b", 1, 5600, 5800, 6001)]


def test_sharing_groups_link_pairs_of_copies(spark):
    r = random.Random(11)

    def text(n):
        return "".join(r.choices(string.ascii_lowercase, k=n))

    rows = []
    for i, n in enumerate(range(240, 341, 10)):
        common = text(n)
        for side in "ab":
            before, after = text(500), text(500)
            rows += [(f"{i}{side}{c}", text(50) + before + common + after + text(50)) for c in "12"]
    df = spark.createDataFrame(rows, "id string, t string")
    groups = {x.id: x.group for x in shared_spans.sharing_groups(df, "id", "t").collect()}
    assert groups == {i: i[:-2] + "a1" for i, _ in rows}
