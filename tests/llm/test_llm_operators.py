"""Small fixtures against brute force, exact round trips and defined edge cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import clusters, grams, groupsplit, leakage, mojibake, neardup, packing, pairdefects, splitleak, structure, topn, truncation

TOKEN = re.compile(r"\w+|[^\w\s]")


def _runs(text, pattern=TOKEN):
    t = pattern.findall(text)
    return {tuple(t[i : i + 3]) for i in range(len(t) - 2)}


def _agree(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def _programs(rng, n):
    names = [f"{a}_{b}" for a in "abcdefgh" for b in ("len", "sum", "idx", "key")]
    return "\n".join(f"{rng.choice(names)} = {rng.choice(names)} {rng.choice('+-*')} {rng.randrange(99)}" for _ in range(n))


def _edited(rng, text):
    lines = text.split("\n")
    for _ in range(rng.randrange(1, 4)):
        i = rng.randrange(len(lines))
        lines[i : i + 1] = rng.choice([[lines[i] + " + 1"], ["pass", lines[i]], []])
    return "\n".join(lines)


@pytest.mark.parametrize("size", [4, 30])
def test_near_duplicates_against_all_pairs(spark, size):
    rng = random.Random(size)
    texts = [_programs(rng, rng.randrange(size, size + 10)) for _ in range(30)]
    texts += [_edited(rng, t) for t in texts for _ in range(2)] + texts[:5] + [None, "", "  \n", "x", "a b", "y = 1"] + [texts[0]] * 40
    rows = [(f"r{i:03d}", t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:7] + [(None, texts[0], 0)], "id string, code string, key int")
    sets = {k: _runs(t) for k, t, _ in rows if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if _agree(sets[a], sets[b]) >= 0.65}
    assert {(r.a, r.b) for r in neardup.similar_pairs(df, "id", "code").collect()} == want
    members, links = neardup.similar_texts(df, "id", "code")
    assert members.count() == len([k for k in sets if sets[k]]) and members.select("key").distinct().count() == members.count()
    reps = {r.rep for r in members.collect()}
    assert {(r.a, r.b) for r in links.collect()} == {p for p in want if set(p) <= reps}


def test_near_duplicates_with_scattered_changes_and_moved_lines(spark):
    rng = random.Random(5)
    texts = []
    for n in (60, 64, 70, 90, 150, 400):
        lines = [[f"v{rng.randrange(5000)}" for _ in range(10)] for _ in range(n // 10)]
        flat = [t for line in lines for t in line]
        texts.append(flat)
        for step in (13, 14, 15, 16, 18):  # no long run stays whole
            texts.append([f"z{rng.randrange(10**6)}" if i % step == step // 2 else t for i, t in enumerate(flat)])
        for _ in range(3):  # runs of ten tokens in another order
            texts.append([t for line in rng.sample(lines, len(lines)) for t in line])
        texts.append([*flat, *(f"y{rng.randrange(10**6)}" for _ in range(n // 2))])
        texts.append([*(f"y{rng.randrange(10**6)}" for _ in range(n // 5)), *flat[: n * 9 // 10]])
    rows = [(f"r{i:03d}", " ".join(t)) for i, t in enumerate(texts)]
    sets = {k: _runs(t) for k, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if _agree(sets[a], sets[b]) >= 0.65}
    assert len(want) > 60
    assert {(r.a, r.b) for r in neardup.similar_pairs(spark.createDataFrame(rows, "id string, code string"), "id", "code").collect()} == want


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, code string")
    assert neardup.similar_pairs(df, "id", "code").count() == 0


def test_top_n_against_sorting(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"g{rng.randrange(40)}", f"id/{'é' if i % 7 == 0 else ''}{rng.randrange(10**6)}x{i}", rng.choice([1.0, 2.5, 2.5, 3.0, -0.0, 0.0, float("inf"), float("-inf"), float("nan"), None])) for i in range(900)]
    rows += [(None, "n", 1.0), ("g1", None, 9.0), ("p", "a", 1.0), ("p", "a\0", 1.0), ("p", "ab", 1.0), ("p", "b", 1.0)]
    got = {(r.grp, r.key) for r in topn.top_n(spark.createDataFrame(rows, "grp string, key string, code double"), "grp", "key", "code", 3).collect()}
    want = set()
    for g in {r[0] for r in rows if r[0]}:
        ok = sorted(((-s, k.encode()), k) for q, k, s in rows if q == g and k is not None and s is not None and s == s)
        want |= {(g, k) for _, k in ok[:3]}
    assert got == want
    assert topn.top_n(spark.createDataFrame([], "grp string, key string, code double"), "grp", "key", "code").count() == 0


CODE = "def f(a):\n    b = [a, 1]\n    for x in b:\n        a += x\n    return a"


@pytest.mark.parametrize("text,cut", [
    (CODE, False), (f"```python\n{CODE}\n```", False), (f"```python\n{CODE}", True), (CODE[:30], True), (CODE[:-9], True), (CODE + "\n# note", False), (CODE.replace("[a, 1]", "[a, 1"), False),
    ("def f(a):\n    return max(a, 1", True), ("def f(a):\n    return a if a >", True), ("def main():\n    print(1)\nmain()", False), ("def main():\n    print(1)", True), ("def f():\n    '''doc", True), ("def f():\n    return 'a", True),
    (CODE + "\n\nif __name__ == '__main__':\n    print(f(1))", False), ("import sys", True), ("", False), ("...", False), ("TODO", False), ("I would rather not.", False), (CODE[:40] + "<snip>", True), ("value = 1\ndef f(value):\n    return val", True), (CODE[:20] + "\ufffd", True),
    ("function f(x) {\n  return x;\n}", False), ("function f(x) {\n  return x", True), ("def f(a) )\n    return a", False),
    ("The function reads the list twice and then forgets the last ele", True), ('{"a": [1, 2', True), ('{"a": [1, 2]}', False), ('She said "it is wrong', True), ("<div><p>text", True), ("<p>text<br></p>", False), ("The value is \\u00", True), ("```python\nreturn [1,\n```", True), ("```python\nreturn [1, 2]\n```", False),
    ("```python\nx = 1\n```\nThen:\n```python\nfor x in", True), ("```python\nx = 1\n```\nIt works.", False), ("```python\nx = 1\n```\nIt works and (as", True), (CODE + "\n    print(f(1))", False), ("# Title", False), ("All is well, R&D.", False), ("# I would rather not.\npass", False), ("def f(x):\n    for y in x:\n        x += y\n    if x", True),
])
def test_structure(text, cut):
    assert (structure.answer_end(text)[0] != "complete") is cut


def test_truncation_baseline(spark):
    loose = "def g(x):\n    x.append(1)"
    rows = [(f"a{i}", "strict", f"```\n{CODE}\n```") for i in range(5)] + [(f"b{i}", "loose", f"```\n{loose}\n```") for i in range(5)]
    rows += [("a9", "strict", loose), ("b9", "loose", loose), ("c9", None, loose), ("d", "x", None), ("e", "x", ""), (None, "x", loose), ("long", "strict", CODE + "\n" + "# x\n" * 50_000), ("a9", "strict", loose)]
    ends = truncation.answer_ends(spark.createDataFrame(rows, "id string, model string, state string"), "id", "state", "model")
    assert {r.key for r in ends.where("cut").collect()} == {"a9", "c9"} and ends.count() == 16
    assert truncation.answer_ends(spark.createDataFrame([], "id string, model string, g string"), "id", "g", "model").count() == 0


def _prompts(rng, n):
    words = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 90))) for _ in range(n)]


def test_cross_split_against_all_pairs(spark):
    rng = random.Random(4)
    base = _prompts(rng, 60)

    def changed(t):
        w = t.split()
        for _ in range(max(1, len(w) // 25)):
            w[rng.randrange(len(w))] = "zz"
        if len(w) > 40 and rng.random() < 0.4:
            k = rng.randrange(10, 20)
            w = w[k:] + w[:k]
        return " ".join(w)

    ev = [(f"e{i}", t) for i, t in enumerate(base)] + [("en", None), ("eb", ""), ("e0", base[0])]
    tr = [(f"t{i}", changed(t).upper()) for i, t in enumerate(base)] + [(f"u{i}", t) for i, t in enumerate(base[:20])] + [(f"v{i}", t) for i, t in enumerate(_prompts(rng, 60))] + [(None, base[0]), ("tn", None)]
    schema = "id string, words string"
    got = {(r.e_key, r.t_key) for r in splitleak.cross_split_pairs(spark.createDataFrame(ev, schema), spark.createDataFrame(tr, schema), "id", "words").collect()}
    W = re.compile(r"\w+")
    want = {(a, b) for a, x in ev if x for b, y in tr if y and b and _agree(_runs(x.lower(), W), _runs(y.lower(), W)) >= 0.65}
    assert got == want and len(want) > 60
    assert splitleak.cross_split_pairs(spark.createDataFrame([], schema), spark.createDataFrame(tr, schema), "id", "words").count() == 0


def test_distances_against_the_plain_programme():
    rng = np.random.default_rng(2)
    texts = [(rng.integers(0, 6, rng.integers(0, 14)), rng.integers(0, 6, rng.integers(1, 14))) for _ in range(80)]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = np.array([plain(a, b) for a, b in texts])
    assert (splitleak.banded_distances(texts, np.full(80, 40)) == want).all()
    assert (splitleak.banded_distances(texts, np.full(80, 3)) == np.minimum(want, 4)).all()


def test_task_text_drops_the_template():
    p = "You are an expert Python developer. Work through the problem below.\n\nTask:\nAdd two numbers.\n\nThe evaluator calls:\naddTwo\n\nPython code:\n"
    assert splitleak.task_text(p).split() == "Add two numbers.".split() and splitleak.task_text(None) == ""
    assert splitleak.task_text('"""\nAdd.\n"""\n# implement addTwo').split() == ["Add."]


def test_components_and_splits(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a string, b string").repartition(9)
    assert {r.node: r.root for r in groupsplit.components(df).collect()} == want
    old, groupsplit.MERGE_ROWS = groupsplit.MERGE_ROWS, 20  # force the contraction rounds
    try:
        assert {r.node: r.root for r in groupsplit.components(df).collect()} == want
    finally:
        groupsplit.MERGE_ROWS = old
    assert groupsplit.components(spark.createDataFrame([], "a string, b string")).count() == 0
    groups = spark.createDataFrame([(f"r{i}", f"g{min(i // 3, 60)}") for i in range(400)], "record string, root string")
    out = groupsplit.assign_splits(groups, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert out.count() == 400 and out.groupBy("root").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    shares = {r["split"]: r["count"] / 400 for r in out.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["test"] - 0.1) < 0.02


def test_plan_is_the_greedy_run():
    rng = random.Random(7)
    for _ in range(60):
        shares = rng.choice([{"train": 0.8, "validation": 0.1, "test": 0.1}, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}])
        sizes = [(s, rng.choice([1, 2, 7, 50, 900])) for s in rng.sample(range(1, 60), rng.randrange(1, 6))]
        lack = {k: v * sum(s * c for s, c in sizes) for k, v in shares.items()}
        want = {}
        for size, count in sorted(sizes, reverse=True):
            for _ in range(count):
                k = max(lack, key=lambda x: lack[x])
                want[size, k] = want.get((size, k), 0) + 1
                lack[k] -= size
        got = {(s, k): c for s, take in groupsplit.plan_splits(sizes, shares).items() for k, c in take}
        placed = lambda plan: {k: sum(s * c for (s, q), c in plan.items() if q == k) for k in shares}
        a, b = placed(got), placed(want)
        assert all(abs(a[k] - b[k]) <= max(s for s, _ in sizes) for k in shares) and sum(a.values()) == sum(b.values())
        assert sum(got[x] != want.get(x) for x in got) <= 2  # equal lacks may fall to either split


def test_torn_groups(spark):
    md = "struct<pair_id: string, original_response_id: string, chosen_response_id: string, rejected_failure_type: string>"
    none = (None,) * 4
    rows = [
        ("apps/train/7__rs_1", None, "train", none), ("mix/1", "APPS-Train-007", " Test ", none), ("mix/2", None, "TEST", (None, "apps/train/7__sample3", "mbpp/4__sample1", None)), ("mbpp/4__x", None, None, none),
        ("mbpp/5__a", None, "train", none), ("mbpp-5__b", None, "TRAIN", none), ("mix/3", None, "test", none), ("mbpp/5__a", None, "train", none),
    ]
    df = spark.createDataFrame(rows, f"id string, problem_id string, eval_split string, metadata {md}")
    assert {tuple(r) for r in groupsplit.torn_groups(df).select("id", "group_id").collect()} == {(i, "apps/train/7__rs_1") for i in ("apps/train/7__rs_1", "mix/1", "mix/2", "mbpp/4__x")}
    assert groupsplit.torn_groups(df.limit(0)).count() == 0


PROMPT = "You are an expert Python developer. Work through the problem below.\n\nTask:\nAdd up the numbers of the list and print what is left after the last of them.\n\nPython code:\n"


def _sound():
    rng = random.Random(8)
    nouns = "list tree edge node path cell row key".split()
    pairs = []
    for i in range(160):
        task = f"Count the {rng.choice(nouns)} that follow each {rng.choice(nouns)} when the {rng.choice(nouns)} is {i}, and return it after the last {rng.choice(nouns)} has been read."
        if i % 2:
            pairs.append((f"Task:\n{task}\n\nPython code:\n", f"def f{i}(a):\n    b = {i}\n    for x in a:\n        b += x * {i}\n    return b"))
        else:
            pairs.append((f"Explain in prose why the program fails.\n\n{task}", f"The draft was reading the {rng.choice(nouns)} twice, so the sum ended up {i} too high. The reviewer asked for a test with {i} rows."))
    return pairs


@pytest.fixture(scope="module")
def defect_model(spark):
    rows = [(f"k{i}", p, a) for i, (p, a) in enumerate(_sound()[:120])]
    return pairdefects.train(spark.createDataFrame(rows, "key string, prompt string, answer string"))


def _held_out():
    rng, prose = random.Random(99), {k: list(v) for k, v in pairdefects._FOREIGN_PROSE.items()}
    return [x for p, a in _sound()[120:] for x in pairdefects.synthetic(p, a, rng, prose)]


def _right(model, held):
    return sum(g == w for (_, _, w), g in zip(held, model.label([p for p, _, _ in held], [a for _, a, _ in held]))) / len(held)


def test_pair_defects_on_held_out_pairs(defect_model):
    held = _held_out()
    assert _right(defect_model, held) > 0.96
    # the classifier decides: without its weights nothing is found, without its n-grams refusals of explanations go unseen
    mute = pairdefects.Model()
    mute.dense, mute.thresholds = defect_model.dense, defect_model.thresholds
    assert _right(pairdefects.Model(), held) < 0.5
    refused = [x for x in held if x[2] == "refusal" and x[0] and "Explain" in x[0]]
    assert _right(defect_model, refused) > _right(mute, refused) + 0.1


def test_pair_defects(spark, defect_model):
    model = defect_model
    task = "Add up the numbers of the list and print what is left after the last of them."
    cases = [(PROMPT, None), (PROMPT, "# your code here"), (PROMPT, PROMPT), (PROMPT, "function f(a) {\n  return a;\n}"), (PROMPT, CODE), (PROMPT, CODE[:-20]), (None, CODE), (f"Explain in prose why the program fails.\n\n{task}", "Die Funktion ist nicht für die Liste gedacht und wird nie durch den Prüfer erreicht.")]
    assert model.label([p for p, _ in cases], [a for _, a in cases]) == ["empty", "empty", "copy", "other_language", None, "truncated", None, "other_language"]
    judge = f"Decide whether the program passes (answer pass or fail).\n\n{task}"
    assert model.label([judge] * 5, ["pass", "Fail.", " PASS\n", "N/A", None]) == [None, None, None, "empty", "empty"]
    assert model.label([PROMPT, None], ["I cannot write this program for you.", CODE + "\n" + "x = 1\n" * 20_000 + "return x"]) == ["refusal", None]
    df = spark.createDataFrame([("s", str(i), p, a) for i, (p, a) in enumerate(cases)], "src string, key string, prompt string, answer string")
    assert pairdefects.find_defects(df, model).count() == 6 and pairdefects.find_defects(df.limit(0), model).count() == 0


def test_responses_are_looked_up_in_their_prompts(spark):
    sound = _sound()
    sft = spark.createDataFrame([(f"s{i}", p, a) for i, (p, a) in enumerate(sound)] + [("s0", *sound[0]), (None, "p", "a")], "id string, prompt string, completion string")
    problems = spark.createDataFrame([(f"p{i}", p) for i, (p, _) in enumerate(sound)] + [("null", None)], "id string, prompt string")
    programs = [a for p, a in sound if "def f" in a]
    quoted = PROMPT + "\nimport sys\n"  # a program's first line doesn't make a copied prompt an answer
    rows = [(f"r{i}", "p1", a) for i, a in enumerate(programs)] + [("c", "hot", quoted), ("n", "gone", programs[0]), ("n", "gone", programs[0]), ("e", None, " "), (None, "p1", "")]
    responses = spark.createDataFrame(rows, "response_id string, id string, generated_code string")
    found = pairdefects.sft_and_responses(sft, responses, problems.unionAll(spark.createDataFrame([("hot", PROMPT)], "id string, prompt string")))
    assert {tuple(r) for r in found.where("src = 'responses'").collect()} == {("responses", "c", "copy"), ("responses", "e", "empty")}
    assert found.where("src = 'sft_records'").count() <= 2
    assert pairdefects.sft_and_responses(sft.limit(0), responses.limit(0), problems.limit(0)).count() == 0


def _summaries(rng, causes):
    rows = []
    for c in range(causes):
        a, o, p, v, f, e = (f"{w}{c if k else c % 5}" for k, w in enumerate(("doing", "thing", "kind", "var", "func", "effect")))
        for k in range(rng.randrange(1, 7)):
            t = rng.choice([f"While {a} the {p} {o}, the code never refreshes {v} in {f}, hence {e}.", f"`{v}` is not guarded, so {f} goes on {a} when the {o} is {p}, with {e} as the effect", f'```json\n{{"summary": "The root cause is {a} a {p} {o}: {v} goes stale inside {f} and we see {e}."}}\n```'])
            t = t.replace(v, "a variable") if rng.random() < 0.2 else t
            rows.append((f"c{c:03d}_{k}", t.upper() if rng.random() < 0.1 else t))
    return rows


def test_clusters(spark):
    rows = _summaries(random.Random(3), 60) + [("n1", None), ("n2", ""), ("n3", "the of and"), (None, "x y z")]
    df = spark.createDataFrame(rows + rows[:5], "key string, cluster string")
    got = {r.key: r.cluster_id for r in clusters.shared_causes(df, "key", "cluster").collect()}
    groups = {}
    for k, t in rows[:-4]:
        groups.setdefault(k[:4], []).append(k)
    want = {k: min(v) for v in groups.values() if len(v) > 1 for k in v}
    assert got == want
    typical = clusters.typical_members(df, "key", "cluster")
    assert typical.where("rank = 1").count() == len(set(want.values())) and typical.where("size < 2").count() == 0
    assert clusters.shared_causes(df.limit(0), "key", "cluster").count() == 0


def test_modularity_keeps_two_cliques_apart(spark):
    links = [(a, b, 5) for g in (range(5), range(10, 15)) for a in g for b in g if a != b] + [(4, 10, 1), (10, 4, 1)]
    got = {r.node: r.community for r in clusters.communities(spark.createDataFrame(links, "v long, u long, w int")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([0, 10, 500, 1000, 1365, 2047, 4095, 4096, 9000, 20_000])) for i in range(300)] + [(1000, None), (1001, "é" * 2048)]
    df = spark.createDataFrame(rows, "tokens long, text string")
    out = packing.pack(df, "tokens", "text").collect()
    total = {}
    for r in out:
        total[r.context] = total.get(r.context, 0) + r.tokens
    assert max(total.values()) <= 4096
    size = {k: len((t or "").encode()) + 1 for k, t in rows}
    for k, n in size.items():
        parts = sorted((r.start, r.tokens) for r in out if r.key == k)
        assert sum(t for _, t in parts) == n and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and len(parts) == -(-n // 4096)
    assert {r.key for r in packing.split_documents(df, "tokens", "text").collect()} == {k for k, n in size.items() if n > 4096}
    assert packing.pack(df.limit(0), "tokens", "text").count() == 0


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [passage(90) for _ in range(12)]
    texts = ["Solve the task.\n" + " ".join(w) for w in items]
    noise = lambda: " ".join(passage(60))

    def holed(w, step):
        return [x if (i + 1) % step else "changed" for i, x in enumerate(w)]

    docs = [(0, noise()), (1, f"{noise()} {' '.join(items[0][10:30]).upper()}. {noise()}"), (2, f"{noise()} {' '.join(items[1][10:29])} {noise()}"), (3, " ".join(f"**{x}**,\n" for x in items[2])), (4, " ".join(holed(items[3], 9))), (5, " ".join(holed(items[4][:45], 9))), (6, None), (7, ""), (8, " ".join(items[5] + items[6])), (9, "Solve the task. " * 30), (10, noise() * 300 + " " + " ".join(items[7]))]
    df = spark.createDataFrame(docs, "item long, text string")
    found = leakage.find_leaks(df, "item", "text", spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key", "text")
    assert {(r.key, r.item) for r in found.collect()} == {(1, 0), (3, 2), (4, 3), (8, 5), (8, 6), (10, 7)}
    assert leakage.find_leaks(df.limit(0), "item", "text", spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "key", "text").count() == 0
    assert leakage.find_leaks(df, "item", "text", spark.createDataFrame([], "key long, text string"), "key", "text").count() == 0


def test_tiles_cover_reordered_passages():
    a, b = np.arange(40, dtype=np.uint64), np.concatenate([np.arange(20, 40), [99], np.arange(20)]).astype(np.uint64)
    assert sorted(leakage.tiles(a, b)) == [(0, 21, 20), (20, 0, 20)]
    c = a.copy()
    c[[7, 20, 33]] = 500
    found = leakage.tiles(a, c)
    assert leakage.chained(found) == 40 and leakage.tiles(a, np.zeros(0, dtype=np.uint64)) == []


SOUND = ["Größere Änderungen für Maßstäbe überprüft", "La fonction doit être appelée après l’été – déjà 3 €", "¿Qué ocurre cuando la señal está vacía? Sólo después", "ATENÇÃO: O ÂNGULO É SÓ UMA REFERÊNCIA, não há razões", "Функция должна вернуть количество её пар", "ВНИМАНИЕ: проверка", "“quoted” … 20 °C ≥ 3 × 4 → ∞", "ÄÖÜÉ TEST", "І з Ї Є", "C++ и Pythonом", "IT-отдел и PDFы", "ПРОВЕРКА ОКОНЧЕНА", "Усі рядки треба перевірити ще раз, бо їх кількість змінилася", "Ñandú y ÑU", "PDFы", "C++ и"]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_is_left_alone(text):
    assert mojibake.repair(text) == (text, 0, False)


@pytest.mark.parametrize("legacy", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251"])
@pytest.mark.parametrize("text", [SOUND[0], SOUND[1], SOUND[2], SOUND[4]])
def test_round_trip_repair(legacy, text):
    bad = "".join(bytes([b]).decode(legacy) if legacy != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode()) if legacy not in ("cp1251",) or 0x98 not in text.encode() else text
    if bad == text:
        pytest.skip("these bytes have no such reading")
    assert mojibake.repair("plain\n" + bad + "\nplain")[0] == "plain\n" + text + "\nplain"


def test_letter_pairs_come_from_the_collection(spark):
    greek = "Η συνάρτηση επιστρέφει το άθροισμα"
    df = spark.createDataFrame([(f"Größe wächst ständig {i}\n{greek}",) for i in range(3)] + [("żółw",), ("grÃ¶ÃŸer Ã¼ber",)], "text string")
    pairs = mojibake.sound_pairs(df)
    assert {"wä", "äc", "tä"} <= pairs and "żó" not in pairs and "¶ã" not in pairs and not any("η" in p for p in pairs)
    assert mojibake.sound_pairs(df.limit(0)) == mojibake._PRIOR


def test_other_damage():
    twice = SOUND[0].encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair(twice) == (SOUND[0], 2, False)
    assert mojibake.repair(SOUND[4].encode("cp1251").decode("latin-1"))[0] == SOUND[4]
    assert mojibake.repair("пустые строки нужно пропускать, не меняя порядок".encode("koi8_r").decode("cp1251"))[0] == "пустые строки нужно пропускать, не меняя порядок"
    assert mojibake.repair("Gr\ufffd\ufffde")[2] is True and mojibake.repair(None) == (None, 0, False) and mojibake.repair("") == ("", 0, False)
    assert mojibake.repair("It uses 48 њC")[:2] == ("It uses 48 °C", 1)
    mixed = "Größe ist sound, " + "aber größer nicht".encode().decode("cp1252")
    assert mojibake.repair(mixed)[0] == "Größe ist sound, aber größer nicht"


def test_garbled_frame(spark):
    df = spark.createDataFrame([(1, SOUND[0]), (2, SOUND[0].encode().decode("latin-1")), (3, None), (4, ""), (5, "a\ufffd"), (6, "x" * 100_000 + "Ã©")], "layers long, text string")
    got = {r.key: r for r in mojibake.find_garbled(df, "layers", "text").collect()}
    assert set(got) == {2, 5, 6} and got[2].restored == SOUND[0] and got[5].restored is None and got[6].restored.endswith("é")
    assert mojibake.find_garbled(df.limit(0), "layers", "text").count() == 0


def test_grams_stay_within_texts():
    ids, counts = grams.token_ids(["a b c d", "", None, "a b c", "x"])
    h, own, pos = grams.grams(ids, counts, 3)
    assert own.tolist() == [0, 0, 3] and pos.tolist() == [0, 1, 0] and h[0] == h[2] != h[1]
    low, owners = grams.winnow(h, own, 8)
    assert set(owners.tolist()) == {0, 3}
