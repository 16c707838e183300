"""Leaks and cross-split pairs in the cases that earlier versions missed."""

import random

from lodestack.llm import leakage, splitleak


def test_leaks_of_equal_items_and_of_close_or_shifted_changes(spark):
    rng = random.Random(7)
    passage = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    same, close, moved, many = passage(60), passage(70), passage(70), passage(60)
    twins = [same + passage(1) for _ in range(6)]
    items = [(i, " ".join(same)) for i in range(6)] + [(6, " ".join(close)), (7, " ".join(moved))] + [(10 + i, " ".join(w)) for i, w in enumerate(twins)] + [(20, " ".join(many))]
    holed = [w if k % 9 not in (3, 5) else "changed" for k, w in enumerate(close)]  # one intact word between two changes
    shifted = [x for k, w in enumerate(moved) for x in ([] if k % 14 == 13 else [w, "added"] if k % 14 == 6 else [w])]
    docs = [(0, " ".join(passage(30) + same[10:40] + passage(30))), (1, " ".join(passage(20) + holed)), (2, " ".join(shifted + passage(20))), (3, " ".join(passage(90))), (4, " ".join(w for k in range(0, 60, 12) for w in many[k : k + 10] + passage(2)))]
    df = spark.createDataFrame(docs, "item long, text string")
    found = leakage.find_leaks(df, "item", "text", spark.createDataFrame(items, "key long, text string"), "key", "text").collect()
    assert {(r.key, r.item) for r in found} == {(0, i) for i in range(6)} | {(0, 10 + i) for i in range(6)} | {(1, 6), (2, 7)}


def test_leaks_with_many_single_changes_and_in_another_order(spark):
    rng = random.Random(3)
    passage = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    base = [passage(100) for _ in range(6)]
    holed = lambda w, step: [x if (k + 1) % step else "changed" for k, x in enumerate(w)]
    pieces = [base[3][k : k + 13] for k in range(0, 100, 13)]
    docs = [(0, " ".join(holed(base[0], 5))), (1, " ".join(passage(40) + holed(base[1], 4) + passage(9))), (2, " ".join(x if (k // 2) % 3 else "zz" for k, x in enumerate(base[2]))), (3, " ".join(w for p in reversed(pieces) for w in p)), (4, " ".join(passage(300))), (5, " ".join(holed(base[4][:60], 5)[:49]))]
    df = spark.createDataFrame(docs * 2, "id long, text string")
    items = spark.createDataFrame([(f"i{k}", " ".join(w)) for k, w in enumerate(base)] + [("null", None), ("short", "one two three"), ("i0", " ".join(base[0]))], "item string, text string")
    found = lambda **x: {(r.key, r.item) for r in leakage.find_leaks(df, "id", "text", items, "item", "text", **x).collect()}
    assert found() == {(0, "i0"), (1, "i1")}
    assert found(coverage=0.8) == {(0, "i0"), (1, "i1"), (3, "i3")}
    old, leakage.BLOCK_WORDS = leakage.BLOCK_WORDS, 150  # several blocks of items
    try:
        assert found() == {(0, "i0"), (1, "i1")}
    finally:
        leakage.BLOCK_WORDS = old


def test_cross_split_of_short_and_of_much_changed_texts(spark):
    rng = random.Random(9)
    w = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    runs = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    ev, tr = [], []
    for n in (3, 5, 7, 8, 9, 12, 13, 14, 20, 30, 60, 100):
        base = w(n)
        tr.append(base)
        ev += [base, ["x", *base[1:]], ["x", *base[1:-1], "y"], base[1:], base[:-1] + ["y", "z"], base[n // 2 :] + base[: n // 2]]
        sentences = [base[k : k + 12] for k in range(0, n, 12)]
        for _ in range(6):
            rng.shuffle(sentences)
            moved = [x for part in sentences for x in part]
            for _ in range(rng.randrange(4)):
                moved[rng.randrange(n)] = "zz"
            ev.append(moved)
    tr.append(["the", "same", "few", "words"] * 5)
    ev.append(["same", "few", "words", "the"] * 4)
    both = ((a, b, runs(ev[a]), runs(tr[b])) for a in range(len(ev)) for b in range(len(tr)))
    want = {(f"e{a}", f"t{b}") for a, b, x, y in both if x and y and len(x & y) / len(x | y) >= 0.65}
    frame = lambda rows, k: spark.createDataFrame([(f"{k}{i}", " ".join(t)) for i, t in enumerate(rows)], "id string, text string")
    got = {(r.e_key, r.t_key) for r in splitleak.cross_split_pairs(frame(ev, "e"), frame(tr, "t"), "id", "text").collect()}
    assert got == want and len(want) > 60
