import random

from kgloom.llm import wide_simhash as wide


def test_keep_first_drops_near_copies_and_keeps_others(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, copies = [], set()
    for base in range(12):
        words = [word() for _ in range(300)]
        docs.append((base, " ".join(words), base))
        for k in range(3):
            changed = list(words)
            for at in rng.sample(range(300), 2 * k):
                changed[at] = word()
            copies.add(100 * (k + 1) + base)
            docs.append((100 * (k + 1) + base, " ".join(changed), base))
    docs += [(None, docs[0][1], 0), (None, "only here", 0), (None, "only here", 1), (500, None, 0), (501, "", 0), (0, docs[0][1], 0)]
    docs += [(600, "one text of this id", 0), (600, "and quite another text", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row int")
    got = wide.keep_first(df)
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(kept, key=str) == sorted([*range(12), 500, 600, 600, None], key=str)
    assert wide.keep_first(df.limit(0)).count() == 0


def test_links_join_what_brute_force_joins(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (3, wide.WORDS), dtype=np.uint64)
    fps = np.concatenate([base[k] ^ (np.uint64(1) << rng.integers(0, 64, (60, wide.WORDS)).astype(np.uint64)) for k in range(3)])
    rows = [([int(x) for x in fp.view(np.int64)], k) for k, fp in enumerate(fps)]
    # Blocks of 16 cut the crowded cells into pairs of blocks.
    links = wide.wide_links(spark.createDataFrame(rows, "fp array<long>, node long"), 8, block=16).collect()
    assert len(links) < 8 * len(rows)
    name = list(range(len(rows)))
    for _ in range(len(rows)):
        for u, v in links:
            name[u] = name[v] = min(name[u], name[v])
    assert name == [60 * (k // 60) for k in range(len(rows))]


def test_groups_are_those_of_exact_jaccard(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for size, changes in ((8, 4), (9, 4), (30, 5), (90, 8), (400, 25)):
        for _ in range(12):
            words = [word() for _ in range(size)]
            docs.append(" ".join(words))
            for k in range(1, changes):
                changed = list(words)
                for at in rng.sample(range(size), k):
                    changed[at] = word()
                # Cut ends and changed words, around 0.8 from both sides and below; chains among them.
                docs += [" ".join(changed), " ".join(words[: size - k])]
    sets = []
    for text in docs:
        parts = text.split()
        sets.append({" ".join(parts[k : k + 5]) for k in range(max(len(parts) - 4, 1))})
    name = list(range(len(docs)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    # The grids of a small and of a very large table find the same groups.
    for expect in (None, 10**8):
        assert {r.doc_id: r.component_id for r in wide.similar_groups(df, expect=expect).collect()} == {k: root(k) for k in range(len(docs))}


def test_sets_in_blocks_join_what_brute_force_joins(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 80)) for _ in range(80)]
    docs = spark.createDataFrame([(k, 0, k % 70) for k in range(80)], "node long, loose long, label long")
    rows = spark.createDataFrame([(k, " ".join(f"w{x}" for x in s)) for k, s in enumerate(sets)], "row long, text string")
    # Blocks of 300 shingles: sets of one word each, so that their similarity is the words'.
    links = wide.apart_links(docs, rows, 0.7, width=1, block=300).collect()
    name = list(range(80))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    def join(pairs):
        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            name[y] = x
        return [root(k) for k in range(80)]

    same = [(k, k + 70) for k in range(10)]
    got = join([*same, *links])
    name = list(range(80))
    alike = [(a, b) for a in range(80) for b in range(a) if 1.7 * len(np.intersect1d(sets[a], sets[b])) >= 0.7 * (len(sets[a]) + len(sets[b])) - 1e-9]
    assert got == join([*same, *alike]) and 20 < len(set(got)) < 70
