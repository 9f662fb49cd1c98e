import random

import numpy as np
import pytest

pytest.importorskip("quern.llm")

from quern.llm import graph, ngram_join

SCHEMA = "doc_id long, text string, id string, a string, component string"


def words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "x").encode().split()]


def brute(texts, percent=85, n=4):
    sets = []
    for t in texts:
        w = words(t)
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(x), top(i)) for i, x in enumerate(sets)], links


def corpus(seed, families=25, most=14):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "é", "the", "The"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "two one", "a b c", "A b\tc ", "a b c d", "a b c d e"]
    for _ in range(families):
        base = [rng.choice(vocabulary) + rng.choice(["", "x", "y"]) for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.randrange(1, most)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] if rng.random() < 0.7 else []
            texts.append(" ".join(copy[: len(copy) - rng.randrange(0, 1 + len(copy) // 12)]))
    rng.shuffle(texts)
    return texts


def frame(spark, texts, parts=5):
    return spark.createDataFrame([(i, t, "i", "a", "c") for i, t in enumerate(texts)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = corpus(seed)
    want, links = brute(texts)
    assert links > 100
    got = ngram_join.jaccard_components(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_large_components_go_to_cells(spark, monkeypatch):
    texts = corpus(5, families=12, most=40)
    want, _ = brute(texts)
    monkeypatch.setattr(ngram_join, "DOCS", 6)
    got = ngram_join.jaccard_components(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == want


def test_keys_lose_no_link():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(1, 300)
        x = {rng.randrange(2**64) for _ in range(n)}
        y = set(x)
        for _ in range(rng.randrange(0, 1 + n // 6)):
            if rng.random() < 0.6 and y:
                y.discard(next(iter(y)))
            if rng.random() < 0.6:
                y.add(rng.randrange(2**64))
        if y and y != x and 100 * len(x & y) >= 85 * len(x | y):
            a, b = (ngram_join.keys(np.sort(np.fromiter(s, np.uint64)), 85) for s in (x, y))
            assert set(a.tolist()) & set(b.tolist())


def test_tree_links_equal_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        base = [rng.randrange(200) for _ in range(40)]
        found = []
        for _ in range(rng.randrange(2, 25)):
            own = {x for x in base if rng.random() < 0.93} | {rng.randrange(200) for _ in range(rng.randrange(4))}
            found.append(np.sort(np.array(sorted(own), np.uint64)))
        sides = np.array([rng.randrange(2) for _ in found])
        for side in (None, sides):
            got = ngram_join.links(found, np.array([len(x) for x in found]), side, 85)
            up, vp = (list(range(len(found))) for _ in range(2))

            def top(u, i):
                while u[i] != i:
                    i = u[i]
                return i

            for i, j in got:
                a, b = top(up, i), top(up, j)
                up[max(a, b)] = min(a, b)
            for i in range(len(found)):
                for j in range(i):
                    x, y = set(found[i].tolist()), set(found[j].tolist())
                    if (side is None or side[i] != side[j]) and 100 * len(x & y) >= 85 * len(x | y):
                        a, b = top(vp, i), top(vp, j)
                        vp[max(a, b)] = min(a, b)
            assert [top(up, i) for i in range(len(found))] == [top(vp, i) for i in range(len(found))]


def test_empty_and_repeated(spark):
    assert ngram_join.jaccard_components(frame(spark, ["a"]).limit(0)).count() == 0
    assert ngram_join.drop_near_copies(frame(spark, ["a"]).limit(0)).count() == 0
    got = ngram_join.jaccard_components(frame(spark, ["x y z a b"] * 200 + [None] * 50)).collect()
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id < 200} == {(2, 0)}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id >= 200)
    kept = ngram_join.drop_near_copies(frame(spark, ["x y z a b"] * 20 + [None, "c"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 20, 21] and kept.columns == ["doc_id", "text", "id", "a", "component"]


def test_graph(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 180)} == {100} and got[201] == 200


def test_names_that_clash(spark):
    from quern.llm.exact_dedup import drop_copies
    from quern.llm.ngram_join import drop_near_copies

    rows = spark.createDataFrame([(1, "a b c d e", 1, "x", 2), (2, "A b c d e", 1, "y", 2), (3, "other words than these", 1, "z", 2), (None, None, None, None, None)], "doc_id long, text string, _kept int, kept_id string, kept_sha int")
    for f, kept in ((lambda d: drop_copies(d, keep="largest"), {2, 3, None}), (lambda d: drop_near_copies(d, 5, 80), {1, 3, None})):
        got = f(rows)
        assert got.columns == rows.columns and {r.doc_id for r in got.collect()} == kept


def test_copies_of_one_id(spark):
    from quern.llm.exact_dedup import drop_copies

    rows = spark.createDataFrame([(5, "a"), (5, "b"), (7, "A"), (7, "A")], "doc_id long, text string")
    assert sorted(map(tuple, drop_copies(rows, keep="largest").collect())) == [(5, "b"), (7, "A"), (7, "A")]


def test_a_family_is_joined_in_steps_that_follow_its_size(monkeypatch):
    rng = random.Random(3)
    base = [rng.randrange(2**60) for _ in range(200)]
    plain, counts = np.searchsorted, []
    for n in (300, 600):
        found = [np.array(sorted({x for x in base if rng.random() < 0.98} | {rng.randrange(2**60)}), np.uint64) for _ in range(n)]
        looks = []
        monkeypatch.setattr(ngram_join.np, "searchsorted", lambda *a, looks=looks, **b: looks.append(1) or plain(*a, **b))
        assert len(ngram_join.links(found, np.array([len(x) for x in found]), None, 80)) == n - 1
        counts.append(len(looks))  # one for each node of the tree that is looked at
    assert counts[1] < 2.5 * counts[0]


def test_known_links_are_not_looked_for():
    found = [np.arange(i, i + 100, dtype=np.uint64) for i in (0, 1, 2, 3)]
    assert ngram_join.links(found, np.array([100] * 4), None, 85, ["a", "a", "a", "a"]) == []
    assert len(ngram_join.links(found, np.array([100] * 4), None, 85, ["a", "b", "a", "b"])) == 1


@pytest.mark.parametrize(("seed", "chosen"), [(11, 1), (12, 3)])
def test_groups_of_large_components(spark, monkeypatch, seed, chosen):
    texts = corpus(seed, families=8, most=40)
    want, _ = brute(texts, 80, 5)
    monkeypatch.setattr(ngram_join, "DOCS", 5)
    monkeypatch.setattr(ngram_join, "REPRESENTATIVES", chosen)
    got = ngram_join.jaccard_components(frame(spark, texts), 5, 80).collect()
    assert sorted(tuple(r) for r in got) == want


def test_only_texts_of_candidates_go_on(spark, monkeypatch):
    tables = {}
    write = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, what: tables.setdefault(what, write(df, what)))
    texts = [" ".join(f"a{i}b{k}" for k in range(60)) for i in range(30)]
    texts += [texts[0] + " more", texts[1] + " more", None, ""]
    got = ngram_join.jaccard_components(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == brute(texts)[0]
    assert {r["id"] for r in tables["texts"].select("id").collect()} == {0, 1, 30, 31}
