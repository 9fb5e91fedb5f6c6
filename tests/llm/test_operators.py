"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import common, jaccard, language, lines, mixing, neighbours, packing, quality, sharding, spotsigs, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, slot int, shard string, _k int, h int"


def texts():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("aeioubcdlmnrst"), rng.integers(1, 9)))
    base = [" ".join(word() for _ in range(n)) for n in (60, 80, 120, 40, 200)]
    out = [None, "", " \n ", "a", "one two three four", "!!! ??", "Über straße. Été\x1c café", "日本語 の 文", "🙂 ok", "\n\nx\n\n", "long " * 30_000, "q" * 5000]
    for t in base:
        w = t.split()
        out += [t, t, t.upper(), " ".join(w[:-1] + ["changed"]), " ".join(w[: len(w) // 2] + ["other"] * 20)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "de", "fr"][i % 4], [None, "b", "a", "a", "é"][i % 5], None, 1, "s", 2, "x", 3, 4) for i, t in enumerate(texts())]
    rows += [rows[13], rows[13], (None, "a null id", None, None, None, 1, "s", 2, "x", 3, 4), (7, "same id, other text", "en", "a", 1, 1, "s", 2, "x", 3, 4)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def test_shards(docs, none):
    a = sharding.shard_documents(docs, [1.0] * 4).collect()
    assert Counter((r.doc_id, r.text) for r in a) == Counter((i, t) for i, t, _ in rows_of(docs))
    by = defaultdict(list)
    for r in a:
        by[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in a if r.doc_id == 7}) == 1
    assert sharding.shard_documents(none, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, [])
    clashing = "_start _b2 _g0 _bucket _rn _n row slot grown_shard".split()
    wide = docs.drop("slot", "shard").select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in clashing])
    for r in sharding.shard_documents(wide, [1.0] * 4).collect():
        assert all(r[c] == f"{c}:{'' if r.doc_id is None else r.doc_id}" for c in clashing[:-2]) and isinstance(r.slot, int) and r.shard in range(4)


def plain_xxhash64(value: int, seed: int) -> int:
    """xxHash64 of a number's 8 bytes, as the published algorithm has it."""
    p1, p2, p3, p4, p5, most = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> (64 - n)) & most
    h = (seed + p5 + 8) & most
    h ^= turn((value & most) * p2 & most, 31) * p1 & most
    h = (turn(h, 27) * p1 + p4) & most
    h = (h ^ h >> 33) * p2 & most
    h = (h ^ h >> 29) * p3 & most
    return h ^ h >> 32


def test_rendezvous_in_plain_python(spark):
    """Each shard bids weight / -ln(u), u from the hash of seed, shard and key; the highest bid wins."""
    import math

    import xxhash

    number = lambda x, seed: xxhash.xxh64_intdigest(int(x).to_bytes(4, "little"), seed)
    assert plain_xxhash64(77, 42) == xxhash.xxh64_intdigest((77).to_bytes(8, "little"), 42)
    weights, seed = [1.0, 2.5, 0.0, 1.0], 3

    def shard(key):
        bids = []
        for s, w in enumerate(weights):
            h = plain_xxhash64(key, number(s, number(seed, 42)))
            bids.append((w / -math.log(((h >> 11) + 0.5) / 2**53), -s))
        return -max(bids)[1]

    got = spark.range(3000).select("id", sharding.rendezvous(F.col("id"), weights, seed).alias("s")).collect()
    assert [r.s for r in got] == [shard(r.id) for r in got] and 2 not in {r.s for r in got}


def test_rates_of_any_size_pick_their_share(spark):
    """A rate of one in a thousand millions is no rate of 0, nor one of the next millionth."""
    h = lambda rate: common.hash_below(F.col("id"), rate, 5)
    n, rates = 4_000_000, [0.0, 1e-9, 9e-7, 1.9e-6, 0.25, 1.0, 7.0]
    got = spark.range(n).agg(*[F.sum(h(r).cast("long")) for r in rates], F.sum(h(F.lit(0.25)).cast("long"))).first()
    assert got[0] == 0 and got[5] == got[6] == n and abs(got[4] - n / 4) < 5000 and got[7] == got[4]
    assert 0 < got[2] < got[3] < 30


def test_a_frequent_key_is_slotted_in_many_buckets(spark, monkeypatch):
    most = []

    def spy(df, groups, order, bucket_key, buckets, slot):
        most.append(max(r["count"] for r in df.groupBy(F.pmod(F.xxhash64(bucket_key), F.lit(buckets))).count().collect()))
        return with_slots(df, groups, order, bucket_key, buckets, slot)

    with_slots = sharding.with_slots
    monkeypatch.setattr(sharding, "with_slots", spy)
    df = spark.createDataFrame([(None if i % 3 else i, f"text {i}") for i in range(900)], "doc_id long, text string")
    got = sharding.shard_documents(df, [1.0], rows_per_bucket=50).collect()
    assert sorted(r.slot for r in got) == list(range(900)) and most[0] < 150


def test_shard_weights(spark):
    n = 20_000
    got = Counter(r[0] for r in spark.range(n).select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0])).collect())
    assert abs(got[1] / n - 0.5) < 0.02 and abs(got[0] / n - 0.25) < 0.02
    moved = spark.range(n).where(sharding.rendezvous(F.col("id"), [1.0] * 9) != sharding.rendezvous(F.col("id"), [1.0] * 10)).count()
    assert abs(moved / n - 0.1) < 0.015


def brute_targets(sizes, weights, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = rest / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = most * sizes[s]
            rest -= out[s]
        free -= full
    return out


def test_mix(docs, none):
    a = mixing.mix(docs).collect()
    import re

    sizes = Counter()
    for _, t, s in rows_of(docs):
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes, (1, 2, 3)), Counter()
    for r in a:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert len(a) == docs.count() and sorted(map(tuple, a), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    longest = max(r.size for r in a)
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    assert mixing.mix(none).count() == 0
    staged = mixing.mix_stage(docs)
    assert staged.columns == docs.columns
    again = Counter((r.doc_id, r.text) for r in staged.collect())
    times = Counter()
    for r in a:
        times[r.doc_id] += r.taken // r.size if r.size else 0
    assert {k: v for k, v in times.items() if v} == {k: sum(c for (i, _), c in again.items() if i == k) for k in {i for i, _ in again}}


@pytest.mark.parametrize("seed", range(40))
def test_fit_is_the_nearest_sum(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 40, rng.integers(1, 6)))
    counts = rng.integers(1, 5, len(lengths))
    budget = float(rng.integers(0, int((lengths * counts).sum()) + 3)) + rng.random() * 0.4
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {0}
    for l, c in zip(lengths, counts):
        sums = {s + int(l) * k for s in sums for k in range(c + 1)}
    got, best = int((take * lengths).sum()), min(abs(s - budget) for s in sums)
    # the proportional share is taken first, so a sum as near as the shortest length is what is promised
    assert abs(got - budget) <= max(best, 0.5 + int(lengths.min()))


def test_fit_large_budget_exact():
    lengths, counts = np.array([3, 7, 1000, 54_321]), np.array([500, 500, 400, 90])
    assert int((mixing.fit_counts(lengths, counts, 2_345_678.0) * lengths).sum()) == 2_345_678


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_ids_equal_the_tokenizer():
    import public_tokenizers

    full, mine = encoder(), tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"), most_bytes=50 * tokens.CHUNK_BYTES)
    cases = [t or "" for t in texts()] + ["İstanbul it's we'll ΑΣ ΣΑΣ", "a\x1cb c\x85d", "<|endoftext|> x<|startoftext|>y", "123abc 4.5 don't. o'clock's", "été", "naïve—yes “q” foo_bar", "re. 's 'S THE'RE ﬁ ª µ ẞ Ǆ Ⅷ ½"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.of(cases)] == [full.encode(t, add_special_tokens=False).ids for t in cases]


def test_packing_round_trip(docs, none):
    full, a = encoder(), packing.pack_documents(docs, max_tokens=256, max_segments=3).collect()
    ids = Counter()
    for i, t, _ in rows_of(docs):
        x = np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(x), 256):
            ids[(i, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256].tobytes()), len(x))] += 1
    assert ids == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in a)
    by = defaultdict(list)
    for r in a:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert len(s) <= 3 and sum(n for _, n in s) <= 256 and [o for o, _ in s] == list(np.cumsum([0, *[n for _, n in s]])[:-1])
    assert packing.pack_documents(none).count() == 0


def test_packing_under_a_loss_limit(spark):
    """Where max_loss is under max_tokens it is the limit that binds: end marks bear no loss."""
    df = spark.createDataFrame([(i, "one two three four five six"[: 3 + 4 * (i % 6)]) for i in range(60)] + [(99, "word " * 200)], "doc_id long, text string")
    free, held = (packing.pack_documents(df, max_tokens=40, max_segments=39, **o).collect() for o in ({}, {"max_loss": 20}))
    sums = lambda rows, c: Counter([x for r in rows for x in [r.sequence_id] * r[c]])
    assert max(sums(free, "loss_tokens").values()) > 20 == max(sums(held, "loss_tokens").values())
    assert 20 < max(sums(held, "length").values()) <= 40
    assert sums(held, "length").total() == sums(free, "length").total() and sums(held, "loss_tokens").total() == sums(free, "loss_tokens").total()


def test_each_limit_of_the_query_binds(spark):
    """On the query's own table some sequences are full by tokens, some by loss-bearing tokens, and with tiny texts by segments."""
    tiny = spark.createDataFrame([(-i - 1, "a") for i in range(3000)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(tiny)
    rows = packing.pack_documents(docs, **packing.LIMITS).groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("n"), F.sum("loss_tokens").alias("l")).collect()
    most = packing.LIMITS
    assert max(r.t for r in rows) == most["max_tokens"] and max(r.n for r in rows) == most["max_segments"] and max(r.l for r in rows) == most["max_loss"]


def test_repeated_pieces_go_to_all_groups(spark):
    """Pieces repeated as a whole are dealt in turn, the same way whatever the partitions are."""
    rows = [(None, 0, 9)] * 3000 + [(7, 0, 5)] * 1000 + [(i, 0, i % 11) for i in range(100, 2100)]
    df = spark.createDataFrame(rows, "doc_id long, start long, ids_crc32 long")
    order = ["doc_id", "start", "ids_crc32"]
    got = [Counter(map(tuple, packing.dealt_pieces(packing.cut(df.repartition(n)), order, 20, 50, df.count()).collect())) for n in (2, 7)]
    assert got[0] == got[1] and Counter({k: v for k, v in Counter(rows).items()}) == Counter(x for (*k, _), v in got[0].items() for x in [tuple(k)] * v)
    sizes = Counter()
    for (*_, group), n in got[0].items():
        sizes[group] += n
    assert len(sizes) == 20 and max(sizes.values()) < 400
    docs = spark.createDataFrame([(None, "one two three")] * 400 + [(1, "four")], "doc_id long, text string")
    pieces = packing.token_pieces(docs)
    packed = packing.pack(packing.cut(pieces), "length", "loss_tokens", order, 64, 8, group_rows=40).collect()
    assert len(packed) == 401 and max(Counter(r.sequence_id >> 32 for r in packed).values()) < 80


@pytest.mark.parametrize("seed", range(10))
def test_fill_bins_takes_the_largest_dot_product(seed):
    rng = np.random.default_rng(seed)
    items, limits = rng.integers(1, 40, (150, 3)), np.array([100, 120, 90])
    bins, place = packing.fill_bins(items, limits)
    weight = (items / limits).mean(axis=0)
    free = set(range(len(items)))
    for b in range(bins.max() + 1):
        own = sorted(np.flatnonzero(bins == b), key=lambda i: place[i])
        left = limits.copy()
        for i in own:
            worth = lambda j: float((items[j] / limits * weight) @ (left / limits))
            fits = [j for j in free if (items[j] <= left).all()]
            assert worth(i) >= max(map(worth, fits)) - 1e-12
            free.discard(i)
            left = left - items[i]
        assert not any((items[j] <= left).all() for j in free)
    with pytest.raises(ValueError):
        packing.fill_bins(np.array([[101, 1, 1]]), limits)


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_section_counts_equal_offsets(docs, none, rule):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    got = defaultdict(dict)
    plain = docs.where("doc_id is not null and doc_id <> 7 and doc_id <> 13")
    for r in tokens.count_by_section(plain, rule=rule).collect():
        got[r.doc_id][r.section] = r
    for i, t, _ in rows_of(plain):
        t = t or ""
        whole = tokens._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
        ids = full.encode(t).ids
        ends = np.cumsum(whole[1][ids]).tolist() if ids else []
        cuts, at = [], 0
        for part in t.split("\n")[:-1]:
            at += len((part + "\n").encode())
            cuts.append(at)
        if not cuts or at < len(t.encode()):
            cuts.append(len(t.encode()))
        want, begin = [0] * len(cuts), 0
        for end in ends:
            shares = [max(0, min(end, c) - max(begin, b)) for b, c in zip([0, *cuts[:-1]], cuts)]
            touched = [k for k, s in enumerate(shares) if s]
            want[touched[0] if rule == "first" else touched[-1] if rule == "last" else shares.index(max(shares))] += 1
            begin = end
        assert [got[i][k].n_tokens for k in range(len(cuts))] == want and sum(want) == got[i][0].doc_tokens
        assert "".join(t[got[i][k].begin : got[i][k].begin + got[i][k].length] for k in range(len(cuts))) == t
    assert tokens.count_by_section(none).count() == 0


def test_line_dedup(spark, docs, none):
    rows = [(i, f"unique {i}\n  common line \nrare {i // 3}\n\nend", "en", f"s{i % 12}", 0, 1, "s", 2, "x", 3, 4) for i in range(60)]
    rows += [(100, "common line\nother", None, None, 0, 1, "s", 2, "x", 3, 4), (101, None, None, "s1", 0, 1, "s", 2, "x", 3, 4), (102, "", None, "s1", 0, 1, "s", 2, "x", 3, 4)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, SCHEMA)
    got = lines.dedup_lines(df, min_sites=10)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    sites, first = defaultdict(set), {}
    for i, t, s in sorted((r[0], r[1], r[3]) for r in rows if r[1] is not None and r[3] is not None) + [(100, "common line\nother", "")]:
        for p, x in enumerate(t.split("\n")):
            if x.strip(" "):
                sites[x.strip(" ")].add(s)
                first[x.strip(" ")] = min(first.get(x.strip(" "), (i, p)), (i, p))
    for r in got.collect():
        if r.text is None:
            assert (r.doc_id, r.n_lines, r.n_removed) == (101, 0, 0)
            continue
        src = next(x[1] for x in rows if x[0] == r.doc_id)
        keep = [x for p, x in enumerate(src.split("\n")) if len(sites.get(x.strip(" "), ())) < 10 or first[x.strip(" ")] == (r.doc_id, p)]
        assert r.text == "\n".join(keep) and r.n_removed == src.count("\n") + 1 - len(keep)
    assert got.count() == len(rows) and lines.dedup_lines(none).count() == 0 and lines.dedup_lines(docs).count() == docs.count()
    assert lines.line_stage(df).columns == df.columns


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
                links[a] += 1
                links[b] += 1
    return [top(i) for i in range(len(rows))], links


def test_near_duplicates(docs, none):
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    top, links = brute_classes(rows)
    got = defaultdict(list)
    for r in jaccard.near_duplicates(docs.drop("h"), "5" and 5).collect():
        got[r.doc_id].append((r.class_id, r.n_links))
    for k, (i, t, _) in enumerate(rows):
        if i is None or i == 7:
            continue
        assert (rows[top[k]][0], links[k]) in got[i], (i, t[:40] if t else t)
    assert sum(map(len, got.values())) == len(rows) and jaccard.near_duplicates(none).count() == 0
    kept = jaccard.near_duplicate_stage(docs)
    assert kept.columns == docs.columns
    groups = {top[k] for k in range(len(rows))}
    assert kept.count() == len(groups)


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    top, links = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.op1_forest_join(spark, SF).collect()}
    assert got == {i: (rows[top[k]][0], links[k]) for k, (i, _) in enumerate(rows)}


def test_links_of_large_classes_are_whole(spark):
    """Many texts under one prefix: some alike, some just below the threshold; no link is lost beyond the neighbours."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(0, 6)), replace=False):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[3][1]) for i in range(15)] + [(3, rows[3][1])]
    rows.sort()
    top, links = brute_classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"leaders": 1, "few": 2, "block_rows": 7}, {"block_shingles": 600}):
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df, **options).collect())
        assert got == sorted((i, rows[top[k]][0], links[k]) for k, (i, _) in enumerate(rows)), options


def test_prefixes_shorten_until_the_recall_is_met():
    """A text with company in more trees asks at shorter prefixes, and by its lengths meets a text at the threshold with the recall."""
    for threshold, trees in ((0.8, 20), (0.7, 30), (0.9, 10)):
        least = jaccard.forest_depth(threshold, trees, 0.99, 9)
        free = max(1, least - 2)
        depths = jaccard.ask_depths(threshold, trees, 0.99, 9, free)
        assert depths == sorted(depths, reverse=True) and depths[0] >= depths[-1] == least
        assert all((1 - threshold**free) ** (trees - c) * (1 - threshold**d) ** c <= 0.01 + 1e-12 for c, d in enumerate(depths))
    n = jaccard.least_agreement(0.8, 180)
    agree = np.random.default_rng(0).binomial(180, 0.9, 200_000)
    assert (agree < n).mean() <= 3e-4 and n > 140


def test_recall_near_the_threshold(spark):
    """Of planted pairs with a Jaccard of 0.80 to 0.85 at least 0.97 are found (0.99 are expected), and no pair under 0.8 is linked."""
    rng = np.random.default_rng(12)
    rows, near, far = [], set(), set()
    for i in range(400):
        w = [f"v{x}" for x in rng.integers(0, 1 << 30, 304)]
        k = int(rng.integers(24, 34)) if i % 4 else 36  # words replaced at the end take as many shingles and one in five more with them
        other = w[: 304 - k] + [f"u{x}" for x in rng.integers(0, 1 << 30, k)]
        both = 300 - k
        (near if both >= 0.8 * (600 - both) else far).add(2 * i)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i for i in range(0, 800, 2) if got[i] == (i, 1) and got[i + 1] == (i, 1)}
    assert len(near) > 250 and len(far) > 50 and not found & far and len(found & near) >= 0.97 * len(near)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150)], "a long, b long")
    assert {r.node: r.label for r in jaccard.components(common.cut(links)).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 150: 100, 200: 100}


def test_fingerprints(docs, none):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.where("doc_id is not null and doc_id not in (7, 13)").collect()), reverse=True)
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs.where("doc_id is not null and doc_id not in (7, 13)")).collect()}
    prints = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y, z = spotsigs.signatures([t, edited, after])
        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if len(a) or len(b) else 1.0
        assert got[i].near_edited == pytest.approx(like(x.tolist(), y.tolist())) and got[i].near_next == pytest.approx(like(x.tolist(), z.tolist()))
        prints[t].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert spotsigs.fingerprints(none).count() == 0 and spotsigs.fingerprints(docs).count() == docs.count()
    alone = spotsigs.fingerprints(docs.where("doc_id = 12")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_signatures_and_pruning():
    a, b, c = spotsigs.signatures(["The quick brown fox is at rest today", "Zebra! the quick brown fox is at rest today", "plain words only here"])
    assert len(a) and set(a) == set(b) and len(c)
    x, y = np.arange(100, dtype="<u4"), np.arange(10, 110, dtype="<u4")
    assert spotsigs.pruned_jaccard(x, y) == pytest.approx(90 / 110) and spotsigs.pruned_jaccard(x, y, 0.8) == pytest.approx(90 / 110)
    assert spotsigs.pruned_jaccard(x, y, 0.9) == 0.0 and spotsigs.pruned_jaccard(x[:10], x, 0.5) == 0.0 and spotsigs.pruned_jaccard(x[:0], x[:0]) == 1.0
    assert abs(spotsigs.length_class(80, 0.8) - spotsigs.length_class(100, 0.8)) <= 1


def test_anchors_are_local():
    """A passage keeps its chains, but for those near its end, whatever common words the rest of the text holds."""
    words = [f"w{i}" for i in range(120)]
    free, after = " ".join(words), "the cat of this house is on a mat and it sleeps for an hour in the sun"
    edited = " ".join(words[:80]) + " " + after
    one = " ".join([*words[:60], "the", *words[60:]])
    x, y, z = (set(s.tolist()) for s in spotsigs.signatures([free, edited, one]))
    assert len(x) > 100 and len(x & y) >= 60 and len(x & y) / len(x | y) > 0.4
    assert len(z) > 100 and len(x & z) / len(x | z) > 0.7
    one_edited = set(spotsigs.signatures([" ".join([*words[:60], "the", *words[60:80]]) + " " + after])[0].tolist())
    assert len(z & one_edited) / len(z | one_edited) > 0.4
    assert all(len(s) for s in spotsigs.signatures(["hello to", "to", "hello", "the of and", "the " * 30 + "end", "end" + " the" * 30]))


@pytest.mark.parametrize("hot", [None, 500])
def test_a_frequent_key_is_parted_in_order(spark, hot):
    """A key (or null) of a third of the rows is dealt to many ranges, and each row's next stays the next."""
    rows = [(i * 10, f"text {i}") for i in range(400)] + [(hot, f"other {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spotsigs.in_order(df, "doc_id", "text", 32, 4).collect()
    own = Counter(r.range for r in got if not r.copy and r.key == hot)
    assert sum(own.values()) >= 200 and max(own.values()) < 60
    tie = {r.text: r.tie for r in df.select("text", F.xxhash64("text").alias("tie")).collect()}
    line = [(r.key, r.text) for r in sorted((r for r in got if not r.copy), key=lambda r: (r.range, r.key is None, -(r.key or 0), tie[r.text]))]
    assert line == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    follows = {x[1]: y[1] for x, y in zip(line, line[1:] + line[:1])}
    by = defaultdict(list)
    for r in got:
        by[r.range].append(r)
    seen = {x.text: y.text for own in by.values() for x, y in zip(own, own[1:]) if not x.copy}
    assert seen == follows


def test_alike_fingerprints(spark, docs, none):
    """Classes of sets in one length class and in neighbouring ones, of a hot family too, equal brute force."""
    rng = np.random.default_rng(6)
    sets = [rng.choice(5000, int(n), replace=False) for n in rng.integers(3, 60, 40)]
    for s in sets[:40:2]:
        sets += [s[1:], s[: len(s) - len(s) // 5], np.append(s[len(s) // 4 :], [9001, 9002])]
    hot = np.arange(6000, 6050)
    sets += [np.concatenate([rng.choice(hot, int(n), replace=False), [7000]]) for n in rng.integers(38, 50, 60)] + [sets[0], sets[0], sets[1][:0], sets[1][:0]]
    sets = [np.unique(s).astype("<u4") for s in sets]
    top = list(range(len(sets)))

    def root(i):
        return i if top[i] == i else root(top[i])

    for i, a in enumerate(sets):
        for j in range(i):
            x, y = set(a.tolist()), set(sets[j].tolist())
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
                top[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame([(i, spotsigs.fingerprint(s)) for i, s in enumerate(sets)], "doc_id long, fingerprint string")
    for block_rows in (256, 9):
        assert sorted((r.doc_id, r.class_id) for r in spotsigs.alike(df, block_rows=block_rows).collect()) == [(i, root(i)) for i in range(len(sets))]
    prints = spotsigs.fingerprints(docs)
    assert spotsigs.alike(prints).count() == docs.count()
    assert spotsigs.alike(df.limit(0)).count() == 0


def test_equal_vectors_tie_by_id(spark):
    """Forty copies of one vector, near but not equal to the query: the smallest ids come first."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((600, 48))
    v[100:140] = v[0] + 0.01
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, lambda i: i == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [100, 101, 102, 103, 104] and len({r.score for r in got}) == 1


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["a", "b", "ab", "▁", "▁a", "bab"])
    prob = np.array([[0.2], [0.1], [0.3], [0.05], [0.15], [0.19], [language.UNKNOWN]])
    table = dict(zip(pieces.words, prob[:, 0]))

    def total(w):
        return 1.0 if not w else sum(table.get(w[:k], language.UNKNOWN if k == 1 else 0) * total(w[k:]) for k in range(1, len(w) + 1))

    words = ["▁abab", "▁b", "▁axb", "▁" + "ab" * 12]
    assert np.allclose(pieces.forward(words, prob)[:, 0], [np.log(total(w)) for w in words])
    counts = pieces.expected(["▁ab"], np.array([2.0]), np.array([0]), prob)
    z = total("▁ab")
    assert counts[2, 0] == pytest.approx(2 * 0.05 * 0.3 / z) and counts[4, 0] == pytest.approx(2 * 0.15 * 0.1 / z)


def test_words_of_any_length():
    """The window's sums with their sizes taken out equal a plain sum in logarithms, for long words among short ones and in many languages."""
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "ab", "abc", "bcab", "cabcabca", "▁", "▁a"]
    prob = rng.random((len(names) + 1, 20)) * 0.1
    prob[-1] = language.UNKNOWN
    pieces = language.Pieces(names)
    table = {w: np.log(prob[i]) for i, w in enumerate(names)}

    def plain(word):
        at = [np.zeros(20)]
        for t in range(1, len(word) + 1):
            terms = [at[t - k] + (table[word[t - k : t]] if word[t - k : t] in table else np.log(prob[-1])) for k in range(1, min(8, t) + 1) if word[t - k : t] in table or k == 1]
            at.append(np.logaddexp.reduce(terms, axis=0))
        return at[-1]

    for n in (3, 40):
        words = ["▁" + "".join(rng.choice(list("abcx"), int(k))) for k in [*rng.integers(1, 30, n), 700, 2500]]
        assert np.allclose(pieces.forward(words, prob), [plain(w) for w in words], rtol=1e-9)


def test_expected_counts_of_long_runs():
    """By logarithms as by plain sums where these hold, and whole where they don't."""
    pieces = language.Pieces(["▁a", "a", "b", "ab", "aba"])
    rng = np.random.default_rng(4)
    prob = rng.dirichlet(np.ones(6), 2).T
    prob[-1] = language.UNKNOWN
    words = ["▁" + "".join(rng.choice(list("abc"), n, p=[0.5, 0.4, 0.1])) for n in (1, 5, 20, 30)]
    counts, lang = np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 1, 0, 1])
    plain, logs = pieces.expected(words, counts, lang, prob), np.zeros_like(prob)
    for w, c, k in zip(words, counts, lang):
        pieces._expected_long(w, c, k, prob, logs)
    assert np.allclose(plain, logs)
    far = pieces.expected(["▁" + "ab" * 2000, "▁a"], np.array([2.0, 1.0]), np.array([0, 0]), prob)
    sizes = np.array([2, 1, 1, 2, 3, 1])
    assert np.isclose((far[:, 0] * sizes).sum(), 2 * 4001 + 2) and not far[:, 1].any()


def test_posterior_and_cut_by_plain_sums():
    """Language and score are prior times the product of all words' probabilities; no letter is und."""
    names, prob = ["a", "b", "ab", "▁", "▁a"], np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.05], [0.3, 0.3], [0.1, 0.25], [language.UNKNOWN] * 2])
    model = language.LanguageModel(["x", "y"], names, prob, np.array([0.25, 0.75]))
    table = [dict(zip(names, prob[:, k])) for k in (0, 1)]

    def total(w, k):
        return 1.0 if not w else sum(table[k].get(w[:j], language.UNKNOWN if j == 1 else 0) * total(w[j:], k) for j in range(1, len(w) + 1))

    texts = ["AB ab, b", "b", "ba1abab ab", "12 !", "", None]
    lang, score = model.scorer()(texts)
    for t, name, s in zip(texts, lang, score):
        words = ["▁" + w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
        both = [p * np.prod([total(w, k) for w in words]) for k, p in enumerate((0.25, 0.75))]
        assert (name, pytest.approx(s)) == ((["x", "y"][int(np.argmax(both))], max(both) / sum(both)) if words else ("und", 0.0))
    small = model.scorer(most_bytes=500)
    assert small(texts)[0] == lang and small(texts[::-1])[0] == lang[::-1]


def test_no_piece_is_too_long():
    """All letter pieces of the vocabulary are in the sum, the longest too."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    assert set(language.vocabulary(path)) == {p for p in found if p.strip("▁").isalpha() and "▁" not in p[1:]}
    pieces = language.Pieces(["s", "▁", "section", "subsection", "▁subsection"])
    prob = np.array([[0.1], [0.2], [0.05], [0.3], [0.15], [language.UNKNOWN]])
    whole = 0.15 + 0.2 * 0.3 + 0.2 * 0.1 * language.UNKNOWN**2 * 0.05
    assert pieces.forward(["▁subsection"], prob)[0, 0] == pytest.approx(np.log(whole), abs=1e-9)
    assert pieces.expected(["▁subsection"], np.array([1.0]), np.array([0]), prob)[4, 0] == pytest.approx(0.15 / whole)


def test_language_of_held_out_rows(spark, docs, none):
    docs2 = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(language.training_rows(docs2), rows_per_language=60, rounds=2)
    held = language.identify(docs2.where(language.fold(F.col("doc_id")) == 0), model).select("lang", "lang_pred", "score").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in held)
    odd = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 5)] == ["und"] * 4 and odd[3].lang_pred in model.languages
    assert language.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language.identify(none, model).count() == 0 and language.learn(language.training_rows(none)) is None
    assert language.language_stage(docs2).columns == docs2.columns


def test_language_stage_drops_only_und(spark):
    """Short clean documents between near languages stay, whatever their posterior."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = [(-1 - i, a) for i, a in enumerate("a e i o u n de es en la un no si me so".split())] + [(-100, "12 !"), (-101, None), (-102, "")]
    few = spark.createDataFrame(short, "doc_id long, text string")
    both = docs.unionByName(few, allowMissingColumns=True)
    scores = {r.doc_id: r.score for r in language.identify(few, language.learn(language.training_rows(both))).collect()}
    assert any(0 < s < 0.6 for s in scores.values())
    got = {r.doc_id for r in language.language_stage(both).where("doc_id < 0").collect()}
    assert got == {i for i, t in short if i > -100}


def test_risk_gradient_and_its_flipped_sign():
    """The step follows the numeric gradient of the risk, and where the part in max() is negative the opposite of that part's gradient."""
    loss = lambda z: np.logaddexp(0, -z)
    rng = np.random.default_rng(1)
    for shift, prior in ((0.0, 0.3), (-6.0, 0.9)):
        zp, zu = rng.standard_normal(7), rng.standard_normal(11) + shift
        inner = lambda a, b: loss(-b).mean() - prior * loss(-a).mean()
        risk = (lambda a, b: prior * loss(a).mean() + inner(a, b)) if inner(zp, zu) >= 0 else (lambda a, b: -inner(a, b))
        assert (inner(zp, zu) < 0) == (shift < 0)
        gp, gu = quality.nnpu_gradient(zp, zu, prior)
        step = lambda x, i: np.where(np.arange(len(x)) == i, 1e-6, 0)
        assert np.allclose(gp, [(risk(zp + step(zp, i), zu) - risk(zp - step(zp, i), zu)) / 2e-6 for i in range(7)], atol=1e-7)
        assert np.allclose(gu, [(risk(zp, zu + step(zu, i)) - risk(zp, zu - step(zu, i))) / 2e-6 for i in range(11)], atol=1e-7)


def test_prior_is_estimated_without_labels_of_0():
    rng = np.random.default_rng(2)
    draw = lambda n, mean: rng.standard_normal((n, 3)) + mean
    for share in (0.2, 0.6):
        unlabelled = np.concatenate([draw(int(4000 * share), 2.5), draw(4000 - int(4000 * share), -2.5)])[rng.permutation(4000)]
        assert abs(quality.estimated_prior(draw(2000, 2.5), unlabelled) - share) < 0.06
    assert quality.estimated_prior(draw(10, 1), draw(500, 0)) is None


def test_steps_over_all_unlabelled_rows(spark):
    """Spark's sums are those of the whole array: the same steps in plain numpy, and a lower risk on all rows than the sample's model has."""
    rng = np.random.default_rng(2)
    n, d = 3000, quality.N_FEATURES
    good, bad = rng.normal(1, 1, (n, d)), rng.normal(-1, 1, (n, d))
    positive, every = good[:300], np.concatenate([good[:1500], bad[:1500]])
    model = quality.fit_nnpu(positive, every[rng.choice(len(every), 60, replace=False)], 0.5, n_edges=3, steps=5)
    rows = spark.createDataFrame([(x.tolist(),) for x in every], "x array<double>").repartition(7)
    got = quality.refined(model, positive, rows, steps=4, rate=0.05)
    w, bias, p, u = model.weights, model.bias, model.design(positive), model.design(every)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, 5):
        gp, gu = quality.nnpu_gradient(p @ w + bias, u @ w + bias, 0.5)
        grad = np.append(p.T @ gp + u.T @ gu + 1e-3 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    assert np.allclose(got.weights, w, atol=1e-4) and abs(got.bias - bias) < 1e-4

    def risk(model):
        zp, zu = p @ model.weights + model.bias, u @ model.weights + model.bias
        return 0.5 * np.logaddexp(0, -zp).mean() + max(0, np.logaddexp(0, zu).mean() - 0.5 * np.logaddexp(0, zp).mean())

    assert risk(got) < risk(model)
    assert quality.refined(model, positive, rows.limit(0)) is model and quality.refined(quality.QualityModel(0.5), positive, rows).weights is None


def test_quality_learns_from_bounded_samples(spark, monkeypatch):
    """One doc_id, null or trusted, that a third of all rows share brings no more rows to the driver than others do; rows repeated as a whole count once."""
    rows = [(i, f"word {i} " * (i % 7 + 1)) for i in range(900)] + [(None, f"none {i}") for i in range(900)] + [(7, f"hot {i} " * (i % 5)) for i in range(900)]
    docs = spark.createDataFrame(rows + rows[:300] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0 or i == 7)) for i in range(900)], "doc_id long, quality int")
    sizes, fit = [], quality.fit_nnpu
    monkeypatch.setattr(quality, "fit_nnpu", lambda p, u, *args, **more: (sizes.append((len(p), len(u))), fit(p, u, *args, **more))[1])
    model = quality.learn_quality(docs, labels, rows=200)
    assert max(n for n, _ in sizes) < 260 and max(n for _, n in sizes) < 260 and min(sizes[-1]) > 120, sizes
    assert model.weights is not None and len(quality.score_quality(docs, model).collect()) == docs.count()
    sizes.clear()
    quality.learn_quality(docs, labels, rows=100_000)
    # every trusted id once, and every different row
    assert sizes[-1] == (len({i for i in range(900) if i % 3 > 0 or i == 7}), len(set(rows))), sizes


def test_quality_of_held_out_rows(spark, docs, none):
    got = {r.doc_id: r for r in quality.op3_pu_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if got[r.doc_id].held_out]
    assert sum(g.predicted == q for g, q in held) / len(held) > 0.9 and all(0 <= g.score <= 1 for g, _ in held)
    model = quality.learn_quality(none.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == docs.count() and {r.score for r in scored} == {0.5}
    assert all(len(quality.features(t or "")) == quality.N_FEATURES for t in texts()[:12])


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 32))
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows[1] = (1, rows[50][1], 1)
    rows[2] = (2, rows[50][1], 1)
    rows += [(2000, None, 1), (2050, [0.0] * 32, 1), (2100, [float("nan")] * 32, 1), (2150, [None] + [1.0] * 31, 1), (3000, [1.0, 2.0], 1), (3001, [2.0, 1.0], 1), (None, [1.0] * 32, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = defaultdict(dict)
    for r in neighbours.nearest(df, lambda i: i % 50 == 0, cell_rows=400).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    w = np.array([r[1] for r in rows[:1500]])
    u = w / np.linalg.norm(w, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        c = u @ u[q]
        c[q] = -2
        best = np.lexsort((np.arange(1500), -np.round(c, 12)))[:5]
        mine = [got[q][k][0] for k in range(1, 6)]
        hits += len(set(best) & set(mine))
        assert all(abs(got[q][k][1] - c[got[q][k][0]]) < 1e-12 for k in range(1, 6))
    assert hits >= 0.95 * 150 and [got[50][k][0] for k in (1, 2)] == [1, 2]
    assert got[3000] == {1: (3001, pytest.approx(0.8))} and not {2000, 2050, 2100, 2150} & set(got)
    assert neighbours.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert neighbours.chi_square(neighbours.chi_square_quantile(0.9, 6), 6) == pytest.approx(0.9)


@pytest.mark.parametrize("cell_rows", [16_384, 60])
def test_neighbours_of_repeated_rows(spark, cell_rows):
    """Repeated rows take one place, -1 is an id like any other, an id's several vectors give it its best score, nearly equal distances are not equal."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((400, 16))
    v[7] = v[50] + 1e-9 * rng.standard_normal(16)
    v[9] = v[50] * 3
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    near = int(np.argsort(-((v @ v[0]) / np.linalg.norm(v, axis=1)))[1])
    rows += [rows[near]] * 30 + [rows[50]] * 4 + [(-1, (v[0] + 0.01).tolist()), (-1, v[3].tolist()), (-50, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, lambda i: i % 50 == 0, cell_rows=cell_rows, sure=0.9999999).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    unit = lambda x: np.asarray(x) / np.linalg.norm(x)
    for q in {i for i, _ in rows if i % 50 == 0}:
        mine = [unit(x) for i, x in rows if i == q]
        score = {}
        for i, x in rows:
            if i != q:
                score[i] = max([score.get(i, -2.0), *[float(unit(x) @ m) for m in mine]])
        want = sorted(score.items(), key=lambda s: (-round(s[1], 13), s[0]))[:5]
        assert [r for r, *_ in got[q]] == [1, 2, 3, 4, 5] and [i for _, i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for *_, s in got[q]], [s for _, s in want], atol=1e-12)
    assert got[0][0][1] == -1


def test_line_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.sql(lines.OP5_SQL).select(*map(duckdb.ColumnExpression, ("doc_id", "text", "n_lines", "n_removed"))).fetchall())
    assert sorted(map(tuple, lines.op5_line_dedup(spark, "/root/testdata/sf0.01").collect())) == want


def test_stages_give_callers_their_columns_back(spark):
    """Whatever extra columns are called, their values come back as they were."""
    names = "lang_pred score n_lines n_removed tid keep row alone h taken size slot copy turn times _row _tid _h _n _turn parts gone text_".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in names])
    for stage in (language.language_stage, lines.line_stage, jaccard.near_duplicate_stage, mixing.mix_stage):
        got = stage(wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in names), stage


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        assert out.count() > 0 and (i == len(corpus_pipeline.STAGES) - 1 or out.columns == first)
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
