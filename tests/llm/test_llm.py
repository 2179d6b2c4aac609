"""The numbered operators against brute force, round trips and their stated edge cases."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, nearduplicates, neighbours, packing, pairs, repeatedlines, sizes, splitting, textkinds

WORDS = [f"w{i}" for i in range(400)]


def grams(text, n):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(*(w[i:] for i in range(n))))


def classes(texts, n, threshold):
    sets = {k: grams(t, n) for k, t in texts.items() if t and grams(t, n)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = {k: find(k) for k in sets}
    groups = {}
    for k, r in out.items():
        groups.setdefault(r, set()).add(k)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def found_classes(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.class_id, set()).add(r.id)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("words, threshold", [(3, 0.5), (5, 0.8)])
def test_near_duplicates_against_all_pairs(spark, words, threshold):
    rng = random.Random(5)
    texts = {}
    for g in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.choice([6, 12, 40, 160, 300]))]
        for v in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 14))):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            if v == 3:
                t = t[len(t) // 2 :] + t[: len(t) // 2]
            texts[f"g{g}v{v}"] = " ".join(t)
    texts |= {"blank": " ", "blank2": " ", "two": "one two", "two2": "one two", "none": None, "long": " ".join(rng.choice(WORDS) for _ in range(20_000))}
    rows = [(k, t, "x", 1) for k, t in texts.items()] + [("g0v0", texts["g0v0"], "y", 2), (None, "text without key at all", "z", 3)]
    df = spark.createDataFrame(rows, "id string, text string, d string, entries int")
    got = nearduplicates.near_duplicates(df, words=words, threshold=threshold)
    assert found_classes(nearduplicates.near_duplicates(df, words=words, threshold=threshold, exact=True)) == classes(texts, words, threshold)
    assert found_classes(got) == classes(texts, words, threshold)
    assert sorted(r.id for r in got.collect()) == sorted(k for k, t in texts.items() if t is not None)


def test_a_large_family_is_one_class(spark):
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        t[rng.randrange(150)] = f"x{i}"
        rows.append((f"f{i:03d}", " ".join(t)))
    rows += [(f"c{i:03d}", " ".join(base)) for i in range(60)]
    got = nearduplicates.near_duplicates(spark.createDataFrame(rows, "id string, text string"), words=3, threshold=0.5)
    assert found_classes(got) == {frozenset(k for k, _ in rows)}


@pytest.mark.parametrize("length, changed, copies, block", [(152, 14, 1000, 2048), (62, 6, 300, 64)])
def test_copies_that_are_only_like_their_original(spark, monkeypatch, length, changed, copies, block):
    monkeypatch.setattr(nearduplicates, "BLOCK", block)
    rng = random.Random(21)
    base = [f"b{i}" for i in range(length)]
    texts = {"original": " ".join(base)}
    for k in range(copies):
        t = list(base)
        for at in rng.sample(range(length), changed):
            t[at] = f"x{k}n{at}"
        texts[f"copy{k:04d}"] = " ".join(t)
    names, sets = list(texts), [grams(t, 3) for t in texts.values()]
    place = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        held[i, [place[g] for g in s]] = 1
    shared, n = held @ held.T, held.sum(axis=1)
    truth = 2 * shared >= n[:, None] + n - shared
    got = {r.id: r.links for r in nearduplicates.near_duplicates(spark.createDataFrame(list(texts.items()), "id string, text string"), words=3, threshold=0.5).collect()}
    assert got == dict(zip(names, (truth.sum(axis=1) - 1).tolist())) and got["original"] > 0.9 * copies


def test_exact_search_finds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(nearduplicates, "CLASS_BLOCK", 3)
    rng = random.Random(31)
    base = [f"b{i}" for i in range(420)]
    texts = {}
    for k in range(60):  # similarities around one half, in sets far beyond NODES
        t = list(base)
        for at in rng.sample(range(420), rng.randint(28, 50)):
            t[at] = f"x{k}n{at}"
        texts[f"t{k:02d}"] = " ".join(t)
    sets = {k: grams(t, 3) for k, t in texts.items()}
    truth = {k: sum(2 * len(a & b) >= len(a | b) for j, b in sets.items() if j != k) for k, a in sets.items()}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = nearduplicates.near_duplicates(df, words=3, threshold=0.5, exact=True)
    assert {r.id: r.links for r in got.collect()} == truth and 0 < sum(truth.values())
    whole = classes(texts, 3, 0.5)
    assert {(r.id_a, r.id_b) for r in nearduplicates.group_pairs(got).collect()} == {(a, b) for g in whole for a in g for b in g if a < b}


def test_pair_that_shares_only_its_last_members(spark):
    words = spark.range(600).selectExpr("concat('v', id) as t").select("t", nearduplicates.word_hashes(F.col("t"))[0].alias("h")).collect()
    order = np.argsort(nearduplicates.mix64(np.array([r.h for r in words]).view(np.uint64)))
    by_hash = [words[i].t for i in order]
    texts = [("a", " ".join(by_hash[:300:2] + by_hash[300:])), ("b", " ".join(by_hash[1:300:2] + by_hash[300:]))]  # 300 of 600 shared
    got = nearduplicates.near_duplicates(spark.createDataFrame(texts, "id string, text string"), words=1, threshold=0.5)
    assert {r.id: r.links for r in got.collect()} == {"a": 1, "b": 1}


def test_pairs_looked_at_do_not_grow_with_the_square_of_common_runs(monkeypatch):
    rng, texts, looked = np.random.default_rng(4), 6000, []
    runs = np.sort(rng.integers(0, 1 << 40, 600, dtype=np.int64))  # every run is in a tenth of the texts
    sets = [np.sort(rng.choice(runs, 60, replace=False)) for _ in range(texts)]
    sets[-1] = np.sort(np.append(sets[0][:50], np.setdiff1d(runs, sets[0])[:10]))  # 50 of 70
    members = np.concatenate(sets).view(np.uint8).reshape(-1, 8)[:, :5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(texts)), nearduplicates._binary(members, np.array([5 * len(x) for x in sets]))], ["d", "s"])
    ranges = nearduplicates._ranges
    monkeypatch.setattr(nearduplicates, "_ranges", lambda *x: (looked.append(len(y[0])) or y for y in ranges(*x)))
    monkeypatch.setattr(nearduplicates.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    tree = pa.Table.from_batches(nearduplicates._tree_rows([batch], 4, np.array([1 << 62]), np.array([0])))
    found = set()
    for k in range(4):
        for rows in nearduplicates._meet(tree.filter(pa.compute.equal(tree["range"], k)).to_batches(), 0.5, 1 << 15):
            found |= set(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()))
    assert (0, texts - 1) in found and len(found) < 100
    assert sum(looked) < 12_000_000  # 30 million if every node were looked at as a whole


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert nearduplicates.near_duplicates(empty).count() == 0
    assert nearduplicates.group_pairs(nearduplicates.near_duplicates(empty)).count() == 0
    with pytest.raises(ValueError):
        nearduplicates.similar_pairs(empty.select(F.lit(1).cast("bigint").alias("d"), F.col("text").alias("t")), threshold=0.3)


def test_splitting_round_trip(spark):
    rng = random.Random(2)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    texts = {
        "para": "\n\n".join(sentence(20) for _ in range(40)),
        "line": "\r\n".join(sentence(25) for _ in range(40)),
        "sent": " ".join(sentence(15) for _ in range(60)),
        "word": " ".join(rng.choice(WORDS) for _ in range(900)),
        "none": "é😀" * 2000,
        "fits": "x" * 1600,
        "empty": "",
        "lines_in_long_paragraph": sentence(500) + "\n\n" + "short",
    }
    rows = [(k, t, "s", i) for i, (k, t) in enumerate(texts.items())] + [("para", texts["para"], "a", 9), ("null", None, "s", 1), (None, "keyless", "s", 1)]
    df = spark.createDataFrame(rows, "id string, text string, section string, piece int")
    got = splitting.split_oversized(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert "null" not in by and len(by[None]) == 1 and by["para"][0].section == "a"
    for k, t in texts.items():
        own = sorted(by[k], key=lambda r: r.piece_no)
        ends = [r.start for r in own[1:]] + [len(t)]
        for r, end in zip(own, ends):
            assert len(r.piece) <= 1600 and t[:end].endswith(r.piece) and len(r.piece) - (end - r.start) <= 200
        assert own[-1].cut == "end"
    kinds = {k: own[0].boundary for k, own in by.items()}
    assert [kinds[k] for k in ("para", "line", "sent", "word", "none", "fits", "lines_in_long_paragraph")] == ["paragraph", "line", "sentence", "word", "none", None, "word"]
    assert {r.cut for r in by["para"][:-1]} == {"paragraph"} and {r.cut for r in by["none"][:-1]} == {"character"}
    assert splitting.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, limit=100, overlap=100)


def brute(x, ids, k, floor):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {(ids[i], ids[j]) for i in range(len(x)) for j in np.lexsort((ids, -s[i]))[:k] if s[i, j] >= floor}


def test_neighbours_recall_and_floor(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(300, 16))
    x = centers[rng.integers(0, 300, 2500)] + 0.15 * rng.normal(size=(2500, 16))
    rows = [(i, "m", [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9001, "m", None), (9002, "m", []), (9003, "m", [1.0]), (9004, "m", [float("nan")] * 16), (9005, "m", [float("inf")] * 16), (9006, "m", [0.0] * 16), (9007, None, [1.0] * 16), (9008, "other", [1.0] * 16), (None, "m", [1.0] * 16)] + rows[:40]
    df = spark.createDataFrame(rows, "vec_id bigint, model string, embedding array<float>").withColumn("cell", F.lit("clash"))
    n = x.astype("f4").astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    for floor in (-1.0, 0.9):
        truth = brute(n, np.arange(2500), 5, floor)
        got = {(r.a, r.b) for r in neighbours.most_similar(df, {"m": 16}, k=5, floor=floor).collect()}
        assert len(got & truth) >= 0.9 * len(truth)
        if floor > 0:
            assert len(got - truth) <= 0.1 * len(truth)
    assert neighbours.most_similar(df.limit(0), {"m": 16}).count() == 0


def test_int8_bounds_lose_nothing():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 32)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(700)
    a, b, cos = neighbours.block_best(x, x, ids, ids, 5, -1.0)
    assert set(zip(a.tolist(), b.tolist())) == brute(x.astype(float), ids, 5, -1.0)


def test_large_cells_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, "m", [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, model string, embedding array<float>")
    n = x.astype("f4").astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    assert {(r.a, r.b) for r in neighbours.most_similar(df, {"m": 8}, k=3).collect()} == brute(n, np.arange(300), 3, -1.0)


def test_cells_are_divided_where_there_are_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 100)
    monkeypatch.setattr(neighbours, "MOST_CELLS", 4)
    rng = np.random.default_rng(14)
    centers = rng.normal(size=(150, 16))
    x = centers[rng.integers(0, 150, 4000)] + 0.2 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, "m", [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, model string, embedding array<float>")
    fitted, _ = neighbours._fit(neighbours.usable_vectors(df, {"m": 16}))
    assert fitted["m"].shape == (4, 10, 16) and len(np.unique(fitted["m"].reshape(40, 16), axis=0)) > 30
    n = x.astype("f4").astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    truth = brute(n, np.arange(4000), 5, -1.0)
    assert len({(r.a, r.b) for r in neighbours.most_similar(df, {"m": 16}, k=5).collect()} & truth) >= 0.9 * len(truth)


def test_repeated_lines(spark):
    rows = []
    for i in range(40):
        lines = [f"own text {i}", "  Share THIS page ", "", "All rights reserved" if i % 2 else "Rights", f"tail {i % 13}"]
        rows.append((f"a{i}", "\n".join(lines), f"https://www.Help.example:443/x/{i}"))
    rows += [(f"b{i}", "share this page", "http://other.example/") for i in range(4)]
    rows += [("a0", rows[0][1], rows[0][2]), ("n1", None, "http://help.example/"), ("n2", "share this page", None), ("n3", "share this page", "/relative"), (None, "share this page", "http://help.example/"), ("e", "", "http://help.example/")]
    df = spark.createDataFrame(rows, "id string, text string, url string").withColumn("line", F.lit("clash")).withColumn("site", F.lit(1))
    got = {(r.id, r.line_no) for r in repeatedlines.repeated_places(df).select("id", "line_no").collect()}
    assert got == {(f"a{i}", n) for i in range(40) for n in (2, 4)}
    blocks = {(r.length, r.documents) for r in repeatedlines.repeated_blocks(df).collect()}
    assert (2, 20) in blocks
    cleaned = {r.id: (r.cleaned, r.removed) for r in repeatedlines.without_repeated(df).collect()}
    assert cleaned["a1"] == ("own text 1\n\ntail 1", 2) and cleaned["n2"] == ("share this page", 0) and cleaned["n1"] == (None, 0)
    assert repeatedlines.repeated_places(df.limit(0)).count() == 0 and repeatedlines.without_repeated(df.limit(0)).count() == 0


def test_texts_that_are_long_runs_of_repeated_lines(spark):
    boiler = [f"notice {i}" for i in range(300)]
    rows = [(f"d{i}", "\n".join([*boiler, f"own {i}"]), "http://a.example/") for i in range(6)] + [("d0", "Notice 7\nother text", "http://a.example/")]
    df = spark.createDataFrame(rows, "id string, text string, url string")
    got = {(r.id, r.line_no) for r in repeatedlines.repeated_places(df).collect()}
    assert got == {(f"d{i}", n) for i in range(6) for n in range(1, 301)}
    assert max(r.length for r in repeatedlines.repeated_blocks(df).collect()) == repeatedlines.LONGEST
    cleaned = sorted((r.id, r.cleaned, r.removed) for r in repeatedlines.without_repeated(df).collect())
    assert cleaned == sorted([(f"d{i}", f"own {i}", 300) for i in range(6)] + [("d0", "other text", 1)])


def test_hosts(spark):
    urls = ["https://www.A.example:8080/x", "//b.example/y", "/relative", None, "http://user@c.example", "no url"]
    got = [r.s for r in spark.createDataFrame([(u,) for u in urls], "u string").select(repeatedlines.site_of(F.col("u")).alias("s")).collect()]
    assert got == ["a.example", "b.example", None, None, "c.example", None]


@pytest.mark.parametrize(
    "question, answer, expected",
    [
        ("How do I lock tags?", None, "empty"),
        ("How do I lock tags?", "​ \n", "empty"),
        ("How do I lock tags?", '{"answer": null, "sources_used": []}', "empty"),
        ("How do I lock tags?", "**Answer:** ", "empty"),
        ("How do I lock tags?", "<br/>", "empty"),
        ("How do I lock tags?", "Done 🙂", None),
        ("How do I lock tags?", "Hi there, I don't know.", "refusal"),
        ("How do I lock tags?", "I CANNOT SAY ANYTHING ABOUT TIME OFF ON THE BASIS OF THESE SOURCES.", "refusal"),
        ("Wie sperre ich das?", "Das weiss ich leider nicht.", "refusal"),
        ("How do I lock tags?", "I'm sorry for the trouble: sign out, sign in again, and the missing rows come back.", None),
        ("How do I lock tags?", "You asked: how do i lock tags", "echo"),
        ("How do I lock tags?", "How do I lock tags? How do I lock tags?", "echo"),
        ("How do I lock tags?", "How do I lock tags?\nOpen the tag page, choose a tag and press Lock.", None),
        ("How do I lock tags?", "Open the tag page. Then choose the", "truncated"),
        ("How do I lock tags?", '{"answer": "Open the tag page and', "truncated"),
        ("How do I lock tags?", 'Open the page.\n\n```json\n{"page": "Tags', "truncated"),
        ("How do I lock tags?", "Open these pages:\n- Tags\n- Team", None),
        ("How do I lock tags?", "Settings > Members > Tags", None),
        ("How do I lock tags?", "Öffnen Sie die Seite und wählen Sie den Eintrag, wenn er noch nicht gesperrt ist.", "language"),
        ("Please answer in German: how do I lock tags?", "Öffnen Sie die Seite und wählen Sie den Eintrag, wenn er noch nicht gesperrt ist.", None),
        (None, "Open the tag page.", None),
        ("How do I lock tags?", "I don't know. I cannot answer this question. " * 400, "refusal"),
        ("How do I lock tags?", "i don't know i can't help with that i'm not sure", "refusal"),
        ("How do I lock tags?", "How do I lock tags? " * 500, "echo"),
        ("How do I lock tags?", "I don't know. But you can open the tag page and press Lock.", None),
        ("How do I lock tags?", "Non posso rispondere a questa domanda.", "refusal"),
        ("How do I lock the tags when the page is open?", "Otwórz stronę i wybierz wpis, który nie jest jeszcze zablokowany, aby można go było zmienić.", "language"),
        (None, None, "empty"),
    ],
)
def test_defects(question, answer, expected):
    assert pairs.defect(question, answer) == expected


def test_flags(spark):
    df = spark.createDataFrame([(1, "How?", None, True), (1, "How?", None, True), (2, None, "Open the page. " * 20_000, False), (None, "x", "", None)], "response_id bigint, question string, answer string, defect boolean")
    assert sorted((r.response_id or 0, r.defect) for r in pairs.flag_pairs(df).collect()) == [(0, "empty"), (1, "empty"), (1, "empty")]
    assert pairs.flag_pairs(df.limit(0)).count() == 0
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [(before + 1) if x == y else max(row[j + 1], 0) for j, (y, before) in enumerate(zip(b, row))]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        assert pairs.longest_common(a, b) == row[-1]


def test_token_rule(spark):
    texts = ["a_b c-d!", "été — déjà…", None, "", "x" * 5000, "日本 12,5"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(sizes.token_count(F.col("t")).alias("n")).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t)) if t else 0 for t in texts]


def test_ordinals_are_whole(spark):
    rows = spark.range(500).select(F.col("id"), F.lit(1).alias("c"))
    rows = rows.union(spark.range(500, 510).select("id", F.lit(None).cast("int").alias("c")))
    got = sizes.ordinals(rows, ["c"], "id").collect()
    assert sorted(r.ordinal for r in got if r.c == 1) == list(range(500)) and sorted(r.ordinal for r in got if r.c is None) == list(range(10))


def test_containers(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * max(0, int(rng.lognormvariate(3.2, 1))))) for i in range(3000)] + [(9000, " ".join(["w"] * 700)), (9001, None), (9002, ""), (None, "w w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tokens", F.lit("clash"))
    got = packing.fill_containers(df, capacity=256).collect()
    used = {}
    for r in got:
        used.setdefault(r.container, []).append((r.start, r.tokens))
    for own in used.values():
        own = sorted(x for x in own if x[1])
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:])) and (not own or own[-1][0] + own[-1][1] <= 256)
    sizes_by = {}
    for r in got:
        sizes_by[r.doc_id] = sizes_by.get(r.doc_id, 0) + r.tokens
    assert sizes_by == {k: len((t or "").split()) for k, t in rows}
    total = sum(sizes_by.values())
    assert total / 256 / len(used) > 0.985
    cut = [r.doc_id for r in packing.cut_documents(packing.fill_containers(df, capacity=256)).collect()]
    assert sorted(cut) == sorted(k for k, t in rows if t and len(t.split()) > 256)
    assert packing.fill_containers(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "w " * 200) for i in range(10)], "doc_id bigint, text string")
    assert packing.fill_containers(same, capacity=256).select("container").distinct().count() == 10


def test_knapsack():
    counts = packing.knapsack(np.array([3.0, 5.0, 9.0]), np.array([2, 3, 5]), 11)
    assert (counts * [2, 3, 5]).sum() <= 11 and (counts * [3, 5, 9]).sum() == 19


@pytest.mark.parametrize("lengths, numbers, greedy_takes", [([508, 514, 516, 1026], [1200, 600, 600, 600], 1100), ([400, 410, 420, 700, 705, 710, 715, 920, 930], [1000] * 9, 3200)])
def test_the_program_beats_greedy_filling(lengths, numbers, greedy_takes):
    lengths, numbers = np.array(lengths), np.array(numbers)
    solution, bound = packing.configurations(lengths, numbers, 2048)
    assert all((counts * lengths).sum() <= 2048 for counts, _ in solution) and (sum(c * x for c, x in solution) >= numbers - 1e-6).all()
    assert packing._placed(lengths, numbers, 2048, [])[1] == greedy_takes
    table, containers, _ = packing.plan(lengths, numbers, 2048)
    assert bound - 1e-6 <= containers <= min(0.95 * greedy_takes, 1.05 * bound)
    items = {x: 0 for x in lengths.tolist()}
    for length, first, last in zip(table["length"].tolist(), table["first"].tolist(), table["last"].tolist()):
        items[length] += last - first
    assert items == dict(zip(lengths.tolist(), numbers.tolist()))


def test_subset_counts_are_exact():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.unique(rng.integers(2, 60, 12))
        free = rng.integers(0, 6, len(lengths))
        target = int(rng.integers(0, max(1, (lengths * free).sum())))
        reach = {0}
        for x, n in zip(lengths.tolist(), free.tolist()):
            reach = {r + k * x for r in reach for k in range(n + 1)}
        taken = mixing.subset_counts(lengths, free, target)
        assert (taken <= free).all() and (taken * lengths).sum() == max(r for r in reach if r <= target)


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), [" Forum", "wiki ", "small", "unlisted", None][rng.choice([0, 0, 0, 1, 1, 2, 3, 4])]) for i in range(2000)]
    rows += [(5000, "w " * 9000, "forum"), (5001, None, "forum"), (None, "w w", "wiki")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("forum", 0.3, 2), ("wiki", 0.45, 3), ("small", 0.15, 1), ("absent", 0.1, 5)], "source string, weight double, max_repeats int")
    mixed = mixing.mix(df, targets).collect()
    report = {r.source: r for r in mixing.mixture_report(df, targets).collect()}
    shares = report
    assert {k for k, r in shares.items() if r.short} >= {"absent"} and all(r.short == (r.target_tokens > r.max_repeats * r.own_tokens) for r in shares.values())
    most = {"forum": 2, "wiki": 3, "small": 1}
    reached = {}
    for r in mixed:
        assert 1 <= r.copies <= most[r.source]
        reached[r.source] = reached.get(r.source, 0) + r.copies * r.tokens
    for k in ("forum", "wiki", "small"):
        goal = most[k] * shares[k].own_tokens if shares[k].short else shares[k].target_tokens
        assert abs(reached[k] - goal) <= 1
    assert {k: r.reached_tokens for k, r in report.items()} == reached | {"absent": 0} and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3, 17])
def test_long_documents_are_fitted(spark, seed):
    sizes_of = [8_200, 8_950, 9_400, 10_111, 10_870, 11_600, 12_345, 12_800, 13_100]
    rows = [(i, "w " * n, "long") for i, n in enumerate(sizes_of)] + [(100, "w " * 3, "rest")]
    targets = spark.createDataFrame([("long", 48_442 / (sum(sizes_of) + 3), 1)], "source string, weight double, max_repeats int")
    targets = targets.union(spark.createDataFrame([("rest", 0.0, 1)], "source string, weight double, max_repeats int"))
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), targets, seed=seed).where("source = 'long'").collect()
    best = max(sum(x) for n in range(10) for x in itertools.combinations(sizes_of, n) if sum(x) <= 48_442)
    assert sum(r.tokens * r.copies for r in mixed) == best and all(r.copies == 1 for r in mixed)


def test_many_long_documents_meet_their_share(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LONG", 40)
    monkeypatch.setattr(mixing, "NEAR", 8)
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(30, 400)), rng.choice("ab")) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2)], "source string, weight double, max_repeats int")
    got = {r.source: r for r in mixing.mixture_report(df, targets).collect()}
    assert all(abs(r.target_tokens - r.reached_tokens) <= 1 for r in got.values()), got


PROSE = "The link copies all entries into the project every day. If you close the week while the page is open, the total is updated at once.\n"
CASES = {
    "prose": PROSE * 3 + "- one\n- two\n",
    "list": "Overview:\n" + "\n".join(f"- item {i} alpha" for i in range(20)),
    "plain_list": "\n".join(f"Team report {chr(97 + i)}" for i in range(20)),
    "table": "\n".join(f"| {WORDS[i]} | {i * 7} | open |" for i in range(15)),
    "csv": "Entries,Week,Page\n" + "\n".join(f"{w},{i},2024-01-0{i}" for i, w in enumerate("project link week page total entries day closed".split(), 1)),
    "symbols": "#@!%&*\n" * 20,
    "again": "login " * 80,
    "letters": "N o t e t h a t t h e r o w t u r n s g r e y " * 5,
}


def test_kinds(spark):
    rows = [(k, t) for k, t in CASES.items()] + [("null", None), ("blank", " \n "), ("long", "".join(f"If the {a} is at {b}, you and all of the {a} {b} stay into the {c}. " for a, b, c in zip(WORDS * 60, WORDS[7:] * 60, WORDS[3:] * 60))), ("prose", CASES["prose"]), (None, PROSE)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("kind", F.lit(1)).withColumn("words", F.lit("clash"))
    common = spark.createDataFrame([("en", w) for w in "the a all into every if you while is at to of and".split()] + [("en", None)], "lang string, word string")
    got = {r.doc_id: r for r in textkinds.text_statistics(df, common).collect()}
    kinds = {k: r.kind for k, r in got.items()}
    assert kinds == {"prose": "prose", "list": "list", "plain_list": "list", "table": "table", "csv": "table", "symbols": "junk", "again": "junk", "letters": "junk", "null": None, "blank": None, "long": "prose", None: "prose"}
    r = got[None]
    words = re.findall(r"[^\W_]+", PROSE.lower())
    assert r.words == len(words) and abs(r.mean_word - sum(map(len, words)) / len(words)) < 1e-9 and r.ended_lines == 1
    assert abs(r.common - sum(w in set("the a all into every if you while is at to of and".split()) for w in words) / len(words)) < 1e-9
    assert got["null"].words == 0 and got["null"].prose is None
    assert textkinds.text_statistics(df.limit(0), common).count() == 0


def test_most_likely_path_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        s = rng.normal(size=(n, 4)) * 2
        move = np.empty((4, 4))
        for i, kind in enumerate(textkinds.KINDS):
            move[i] = np.log((1 - textkinds.STAY[kind]) / 3)
            move[i, i] = np.log(textkinds.STAY[kind])
        best = max(itertools.product(range(4), repeat=n), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
        share = textkinds._kinds(s, np.zeros(n, int), np.ones(n), 1)[0]
        assert np.allclose(share, np.bincount(best, minlength=4) / n)
