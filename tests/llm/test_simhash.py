import numpy as np
import pyarrow as pa

from corpuscule.llm import simhash


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_pairs(a, b, radius=simhash.RADIUS, confirm=simhash.CONFIRM):
    i, j = np.triu_indices(len(a), 1)
    near = (np.bitwise_count(a[i] ^ a[j]) <= radius) & (np.bitwise_count(b[i] ^ b[j]) <= confirm)
    return list(zip(i[near].tolist(), j[near].tolist(), strict=True))


def test_masks_cover_every_pair_within_the_radius():
    rng, tables = np.random.default_rng(3), simhash.masks(6)
    assert len(tables) == 127
    for _ in range(3_000):
        flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False))
        assert ((np.uint64(flips) & tables) == 0).any()


def edited(text, every):
    words = text.split()
    return " ".join("zzz" + w if i % every == 7 else w for i, w in enumerate(words))


def test_groups_equal_brute_force(spark, written):
    rows = []
    for g in range(30):
        base = written(100 + g, 150)
        rows += [(10 * g + k, edited(base, 40) if k == 1 else base) for k in range(g % 4 + 1)]
    rows += [(1_000 + i, edited(written(999, 300), 30 + i)) for i in range(40)]  # a group larger than a small bucket
    a, b = simhash.signatures(pa.array([t for _, t in rows]))
    root = roots(len(rows), near_pairs(a, b))
    expected = {i: min(j for j, r in zip([x for x, _ in rows], root, strict=True) if r == root[n]) for n, (i, _) in enumerate(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.group_id for r in got} == expected
    assert sorted(r.doc_id for r in got if r.keep) == sorted(set(expected.values()))
    assert len(set(expected.values())) < len(rows)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected.values()))


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    sig = np.concatenate([base ^ np.uint64(1 << int(rng.integers(0, 64))) for _ in range(20)])
    conf = np.zeros(len(sig), np.uint64)
    a, b = simhash.forest(sig, conf, 1, 0)
    assert roots(len(sig), zip(a.tolist(), b.tolist(), strict=True)) == roots(len(sig), near_pairs(sig, conf, 1, 0))
    h = np.zeros(len(sig), np.uint64)
    for small in (2, 12, 500):
        a, b = simhash.bucket_pairs(h, sig, conf, 1, 0, small)
        assert roots(len(sig), zip(a.tolist(), b.tolist(), strict=True)) == roots(len(sig), near_pairs(sig, conf, 1, 0))


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51))
    assert got[101] == got[102] == 100


def test_odd_rows(clashing, nothing):
    got = simhash.near_duplicates(clashing).collect()
    assert len(got) == clashing.count()
    one = [r for r in got if r.doc_id in (1, 10)]
    assert {r.group_id for r in one} == {1} and {r.group_size for r in one} == {3} and sum(r.keep for r in one) == 1
    assert all(r.keep for r in got if r.doc_id == 3)
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(r.keep for r in got)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_texts_without_words_group_by_text(spark):
    docs = spark.createDataFrame([(1, "..."), (2, "..."), (3, "!!!"), (4, ""), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_split_buckets_give_the_same_groups(spark, written, monkeypatch):
    """Every bucket of two nodes and more is taken for a hot one, from all nodes."""
    monkeypatch.setattr(simhash, "LOOKED_AT", 1)
    monkeypatch.setattr(simhash, "HOT", 2)
    rows = [(i, edited(written(999, 300), 30 + i)) for i in range(40)] + [(100 + i, written(i, 100)) for i in range(40)]
    nodes = spark.createDataFrame(rows, "doc_id long, text string")
    signed = simhash.sign(nodes).select("sig", "conf").distinct()
    assert len(simhash.hot_buckets(signed, 80, simhash.Tables(simhash.RADIUS))) > 10
    a, b = simhash.signatures(pa.array([t for _, t in rows]))
    root = roots(len(rows), near_pairs(a, b))
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(nodes).collect()}
    assert got == {i: rows[min(j for j, r in enumerate(root) if r == root[n])][0] for n, (i, _) in enumerate(rows)}


def test_entries_of_split_buckets_cover_every_pair():
    rng, tables = np.random.default_rng(4), simhash.Tables(6)
    for _ in range(200):
        sig = rng.integers(0, 2**63, 2, dtype=np.uint64)
        sig[1] = sig[0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 6, replace=False)))
        plain, h = simhash._entries(tables, sig, sig, np.zeros(0, np.uint64))
        _, split = simhash._entries(tables, sig, sig, np.unique(h))
        assert len(plain) == 254 and len(split) == 254 * 127
        assert (h == tables.of(plain)).all()
        assert set(split[: 127 * 127]) & set(split[127 * 127 :])


def test_large_buckets_are_split_in_memory(monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    sig = np.unique(np.concatenate([base ^ np.uint64((1 << int(i)) | (1 << int(j))) for i, j in rng.integers(0, 64, (20, 2))]))
    conf = np.zeros(len(sig), np.uint64)
    expected = roots(len(sig), near_pairs(sig, conf, 3, 0))
    monkeypatch.setattr(simhash, "HOT", 30)
    a, b = simhash.bucket_pairs(np.zeros(len(sig), np.uint64), sig, conf, 3, 0)
    assert roots(len(sig), zip(a.tolist(), b.tolist(), strict=True)) == expected
    monkeypatch.setattr(simhash, "HOT", 0)  # of equal signatures none can be split
    a, b = simhash.bucket_pairs(np.zeros(20, np.uint64), np.full(20, 5, np.uint64), np.arange(20, dtype=np.uint64), 3, 64)
    assert len(set(roots(20, zip(a.tolist(), b.tolist(), strict=True)))) == 1


def test_repeated_rows_leave_the_one_first_in_order(spark):
    rows = [(1, "same text here", x) for x in ("c", "a", None, "b")] + [(2, "same text here", "z"), (3, "all alone", "y")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, other string").repartition(3)
        kept = sorted((r.doc_id, r.other) for r in simhash.drop_near_duplicates(docs).collect())
        assert kept == [(1, "a"), (3, "y")]
