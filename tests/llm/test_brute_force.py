"""The pipeline's stages, each on its own input, and SpotSigs chains against plain Python or SQL."""

from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
from test_operators import SF, brute_classes, brute_targets, encoder, texts

import corpus_pipeline
from lexgrove.llm import lines, spotsigs


def test_every_stage_on_what_its_predecessor_kept(spark, tmp_path):
    """Rows (with repeats) and texts of each stage: letters, boilerplate by SQL, classes of all pairs, targets and sizes, token ids."""
    stages, kept = dict(corpus_pipeline.STAGES), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(stages.items()):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == len(stages) - 1 or out.columns == columns
        kept[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        docs = out
    whole = lambda rows: Counter(tuple(r[c] for c in columns) for r in rows)

    before, after = kept["language ID"]
    assert whole(after) == whole(r for r in before if r["text"] and any(map(str.isalpha, r["text"])))

    before, after = kept["line dedup"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/0/*.parquet'")
    left = {i: (t, n) for i, t, n in con.sql(f"SELECT doc_id, text, n_removed FROM ({lines.OP5_SQL})").fetchall()}
    want = [{**r, "text": left[r["doc_id"]][0]} for r in before if not left[r["doc_id"]][1] or left[r["doc_id"]][0].strip()]
    assert whole(after) == whole(want) and any(n for _, n in left.values())

    before, after = kept["n-gram Jaccard join"]
    rows = sorted((r["doc_id"], r["text"]) for r in before)
    top, _ = brute_classes(rows)
    classes, ids = defaultdict(set), {r["doc_id"] for r in after}
    for (i, _), c in zip(rows, top):
        classes[c].add(i)
    assert all(len(c & ids) == 1 for c in classes.values()) and len(after) == len(classes) < len(rows)
    assert not whole(after) - whole(before)

    before, after = kept["mixing sources to target weights"]
    size, taken, times = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}, Counter(), Counter(r["doc_id"] for r in after)
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    targets = brute_targets(sizes, (1, 2, 3))
    assert set(whole(after)) <= set(whole(before)) and max(times.values()) <= 3
    assert all(abs(taken[s] - targets[s]) <= max(size[r["doc_id"]] for r in before if r["source"] == s) for s in targets)

    before, after = kept["packing"]
    full, pieces, sequences = encoder(), Counter(), defaultdict(list)
    for r in before:
        n = len(full.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        pieces[r["doc_id"], n] += n
    got = Counter()
    for r in after:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == pieces
    for s in sequences.values():
        s.sort()
        assert sum(n for _, n in s) <= 2048 and [o for o, _ in s] == list(np.cumsum([0, *[n for _, n in s]])[:-1])
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def chains(text, length=3, reach=spotsigs.REACH):
    """SpotSigs word by word: what an anchor and the content words after it are, with no hash and no array."""
    words = [w.strip(spotsigs._EDGE) or w for w in text.lower().split()]
    common = [w in spotsigs.ANCHORS for w in words]
    n = len(words)
    spot = [common[i] and not all(common[i + 1 : i + 1 + reach]) for i in range(n)]
    if n == 1:
        return {(words[0],)}
    out = set()
    for i in range(n):
        if spot[i] or not any(spot[i + 1 : i + 1 + reach]):
            after = [words[j] for j in range(i + 1, n) if not spot[j]][:length]
            if after:
                out.add((words[i], *after))
    return out


def test_spotsigs_word_by_word(spark):
    some = [t or "" for t in texts()] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").collect()]
    some = [t for t in some if len(t) < 40_000]
    found, plain = [set(s.tolist()) for s in spotsigs.signatures(some)], [chains(t) for t in some]
    assert [len(a) for a in found] == [len(b) for b in plain]
    for i, j in combinations(range(len(some)), 2):
        assert len(found[i] & found[j]) == len(plain[i] & plain[j])


def test_the_queries_of_spotsigs(spark):
    """near_edited, near_next and the classes at 0.8 of the whole table, from the chains of words."""
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    plain = {t: chains(t) for _, t in rows}
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    for r in spotsigs.op6_spotsigs(spark, SF).collect():
        k = next(k for k, (i, _) in enumerate(rows) if i == r.doc_id)
        own, after = rows[k][1], rows[(k + 1) % len(rows)][1]
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        assert abs(r.near_edited - like(plain[own], chains(edited))) < 1e-9 and abs(r.near_next - like(plain[own], plain[after])) < 1e-9
    classes = {r.doc_id: r.class_id for r in spotsigs.spotsigs_classes(spark, SF).collect()}
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(rows, 2):
        if plain[a] and plain[b] and like(plain[a], plain[b]) >= 0.8:
            parent[max(top(i), top(j))] = min(top(i), top(j))
    together = lambda of: {frozenset(k for k in parent if of(k) == c) for c in {of(k) for k in parent}}
    assert together(top) == together(lambda k: classes[k])
