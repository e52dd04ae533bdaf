import random
import re

import numpy as np

from vozmark.llm import common, line_dedup, near_dedup


def brute(texts):
    """{id: (set size, component)} of {id: text}, by the contract alone."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def noisy(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


def test_groups_equal_brute_force(spark):
    rng = random.Random(2)
    texts, n = {}, 0
    for g in range(6):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(80)]
        for k in range(14):
            texts[n] = noisy(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 5])) + (" Tail" if k % 5 == 0 else "")
            n += 1
    texts |= {900: "", 901: None, 902: "a b", 903: "A  b", 904: "a b c", 905: " \n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(texts)


def test_blocks_and_hot_keys_equal_brute_force(spark, monkeypatch):
    """Groups of 300 in blocks of 24 rows, with every key above 20 rows hot."""
    monkeypatch.setattr(near_dedup, "BLOCK", 24)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = random.Random(3)
    texts, n = {}, 0
    for g, size in ((0, 300), (1, 60)):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(size):
            # Near the threshold: about half of the pairs pass, and some stand alone.
            texts[n] = noisy(rng, base, rng.choice([1, 2, 2, 3, 4, 6])) + " end" * rng.choice([1, 1, 25])
            n += 1
    for _ in range(30):
        texts[n] = texts[0]
        n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(texts)


def test_group_links_equal_all_pairs():
    """The kernel, above and below SMALL rows, against all pairs of full sets."""
    rng = random.Random(5)
    signer = near_dedup.Signer()
    for size in (40, 300):
        base = [f"w{rng.randrange(900)}" for _ in range(70)]
        sets = [near_dedup.shingle_set(noisy(rng, base, rng.choice([1, 2, 3, 5]))) for _ in range(size)]
        sig = np.array([(signer.sign(s) & np.uint32(0xFFFF)).astype(np.uint16) for s in sets])
        n = np.array([len(s) for s in sets])
        rep = np.arange(size) + 1000
        comp = np.where(np.arange(size) % 7 == 0, 0, rep)
        side = (np.arange(size) % 2).astype(np.int64)
        root = {int(c): int(c) for c in comp}

        def find(root, x):
            while root[x] != x:
                x = root[x]
            return x

        want = dict(root)
        for a in range(size):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if side[a] + side[b] and 100 * both >= 75 * (n[a] + n[b] - both):
                    want[find(want, int(comp[a]))] = find(want, int(comp[b]))
        links = near_dedup.confirmed_links(side, rep, comp, n, sig, sets, near_dedup.bounds())
        got = dict(root)
        for a, b in links:
            p, q = find(got, int(comp[a - 1000])), find(got, int(comp[b - 1000]))
            assert p != q, "a forest has no link within a component"
            got[p] = q
        parts = lambda r: sorted(sorted(c for c in r if find(r, c) == t) for t in {find(r, c) for c in r})
        assert parts(got) == parts(want)


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (3, b + " x")]
    got = near_dedup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in got) == [
        (1, 1, 36), (1, 1, 36), (2, 1, 37), (3, 1, 37), (3, 1, 37),
    ]
    rows = [(1, a), (7, b), (7, a + " x"), (9, b + " x")]
    got = near_dedup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (7, 1), (7, 7), (9, 7)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(500, i) for i in range(100, 160)] + [(i, 99) for i in (100, 130)]
    edges = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r["rep"]: r["comp"] for r in near_dedup.components(edges, common.Scratch(spark)).collect()}
    assert {got[i] for i in range(1, 61)} == {1}
    assert {got[i] for i in [99, 500, *range(100, 160)]} == {99}


def test_near_edge_cases(spark, documents):
    got = near_dedup.near_duplicates(documents).collect()
    assert len(got) == 8
    by = {r["doc_id"]: r for r in got}
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[5]["n_shingles"] == 0
    assert by[4]["n_shingles"] == 30_000 - 4 and all(r["kept"] for r in got)
    assert near_dedup.near_duplicates(documents.limit(0)).count() == 0


def test_thresholds_prune_only_the_unlikely():
    for _, k, least in near_dedup.bounds():
        assert 0 < least < k * 0.75


def test_lines_cut_later_occurrences(spark):
    a = "one x\ntwo x\nthree x\nfour x"
    rows = [
        (1, a, "k"),
        (2, f"start\n\n  two x\t\nthree x\n\nfour x\nend here", "k"),
        (3, a, "k"),
        (4, "two x\nthree x", "k"),
        (5, "r\nr\nr\nr\nr\ns", "k"),
        (6, None, "k"),
        (7, "", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1]["text"] == a and got[4]["n_removed"] == 0
    assert got[2]["text"] == "start\n\n\nend here"
    assert got[3]["text"] == "" and got[3]["n_removed"] == 4
    # Windows at 1 and 2 repeat the one at 0 and cover lines 1 to 4.
    assert got[5]["text"] == "r\ns" and [tuple(s) for s in got[5]["removed_spans"]] == [(1, 4)]
    assert got[6]["text"] is None and got[7]["text"] == ""
    assert got[1]["spans"] == "k"


def test_lines_edge_cases(spark, documents):
    assert line_dedup.dedup_lines(documents).count() == 8
    assert line_dedup.dedup_lines(documents.limit(0)).count() == 0
    assert all(r["n_removed"] == 0 for r in line_dedup.dedup_lines(documents).collect())


def test_batches_are_bounded_and_rows_beyond_the_bound_stay_whole(spark):
    from pyspark.sql import functions as F

    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    old = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        common.bound_batches(spark)
        assert [spark.conf.get(k) for k in keys] == [str(common.BATCH_ROWS), str(common.BATCH_BYTES)]
        spark.conf.set(keys[0], "7")
        spark.conf.set(keys[1], "4096")
        common.bound_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["7", "4096"]

        def lengths(batches):
            for b in batches:
                assert len(b) <= 7
                yield b.assign(n=b["text"].str.len())[["id", "n"]]

        rows = spark.range(40).withColumn("text", F.expr("repeat('ab ', cast(if(id % 10 = 3, 20000, id) as int))"))
        got = {r.id: r.n for r in rows.mapInPandas(common.tidy(lengths), "id long, n long").collect()}
        assert got == {i: 3 * (20000 if i % 10 == 3 else i) for i in range(40)}
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)


def test_tidy_gives_all_of_an_empty_and_a_full_input():
    assert list(common.tidy(lambda xs: (2 * x for x in xs))(iter([]))) == []
    assert list(common.tidy(lambda xs: (2 * x for x in xs))(iter([1, 2]))) == [2, 4]
