"""Classes of fingerprints: pairs are compared once, whatever the number of signatures that they share."""

from itertools import combinations

import numpy as np

from lexgrove.llm import common, spotsigs


def _classes(sets, threshold):
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        x, y = set(sets[i].tolist()), set(sets[j].tolist())
        if x == y or (x and y and len(x & y) >= threshold * len(x | y)):
            a, b = root(i), root(j)
            top[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def test_pairs_of_many_shared_signatures_are_compared_once(spark, monkeypatch):
    """Two families of near copies under the same 120 signatures, and sets that only share one of these: the rows made don't follow signatures times pairs."""
    rng = np.random.default_rng(4)
    family = [np.concatenate([np.arange(300 * k, 300 * k + 240), 10_000 + rng.choice(5000, 12, replace=False)]) for k in (0, 1) for _ in range(20)]
    sets = [np.unique(x).astype("<u4") for x in family + [np.append(20_000 + rng.choice(9000, 9, replace=False), 5) for _ in range(30)]]
    df = spark.createDataFrame([(i, spotsigs.fingerprint(s)) for i, s in enumerate(sets)], "doc_id long, fingerprint string")
    made = []

    def seen_cut(table, *args, **more):
        out = common.cut(table, *args, **more)
        made.append((set(out.columns), common.seen(out)["rows"]))
        return out

    monkeypatch.setattr(spotsigs, "cut", seen_cut)
    for few, pairs in ((100, 1000), (4, 400)):
        made.clear()
        assert sorted((r.doc_id, r.class_id) for r in spotsigs.alike(df, few=few).collect()) == list(enumerate(_classes(sets, 0.8)))
        # 2 x 190 pairs of near copies
        assert 40 <= next(n for names, n in made if names == {"a", "b"}) <= pairs


def test_classes_that_leaders_leave_apart(spark):
    """Chains of sets of which each is like its neighbours alone, all under common signatures: blocks of any size find every link."""
    rng = np.random.default_rng(5)
    sets = []
    for c in range(12):
        line = 1000 * (c + 1) + rng.permutation(400)
        sets += [np.append(line[4 * i : 4 * i + 30], np.arange(8)) for i in range(0, 25, 2 if c % 3 == 0 else 1)]
    sets = [np.unique(s).astype("<u4") for s in sets]
    wanted = list(enumerate(_classes(sets, 0.7)))
    df = spark.createDataFrame([(i, spotsigs.fingerprint(s)) for i, s in enumerate(sets)], "doc_id long, fingerprint string")
    for few, block_rows in ((2, 7), (2, 256), (32, 256)):
        assert sorted((r.doc_id, r.class_id) for r in spotsigs.alike(df, 0.7, block_rows=block_rows, few=few).collect()) == wanted


def test_prints_of_texts_alone(spark, docs=((1, "The fox is at rest"), (2, None), (None, ""), (4, "plain words only here"), (1, "The fox is at rest"))):
    df = spark.createDataFrame(list(docs), "doc_id long, text string")
    rows = lambda x: sorted(map(str, x.select("doc_id", "fingerprint").collect()))
    assert rows(spotsigs.text_prints(df)) == rows(spotsigs.fingerprints(df))
    assert spotsigs.text_prints(df.limit(0)).count() == 0
