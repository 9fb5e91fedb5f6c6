"""Periodic runs of words: partition refinement by factor length, neighbours at the distance of the length, runs and collapsed texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import documents, lean, slices

#: Up to so many positions a step goes one by one.
FEW = 12
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Order by several columns of non-negative numbers, the first one first; packed into 63 bits where they fit."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    packed = keys[0].astype(np.int64)
    for key, width in zip(keys[1:], bits[1:]):
        packed = (packed << width) | key
    return np.argsort(packed, kind="stable")


def equal_factors(words: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose factor of `length` words is found again in their document, ascending, and their classes, numbered from 0.

    A hash rules out most positions, as equal factors have equal hashes; the classes themselves are exact.
    """
    n = len(words) - length + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[length - 1 :])
    code = doc.astype(np.uint64)[at] * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(length):
            code = (code ^ words[at + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            code ^= code >> np.uint64(32)
    values = np.sort(code)
    twice = np.unique(values[1:][values[1:] == values[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(twice, code), len(twice) - 1)
    at = at[twice[place] == code]
    name = doc[at].astype(np.int64)
    many = int(words.max()) + 1
    for k in range(length):
        # dense names times the number of words stays below 2**63
        name = np.unique(np.unique(name, return_inverse=True)[1] * many + words[at + k], return_inverse=True)[1]
    often = np.bincount(name)[name] > 1
    return at[often], np.unique(name[often], return_inverse=True)[1]


class Classes:
    """Classes of positions by equal factors, refined to factors of one word more at each step (Crochemore's partition refinement).

    at: positions, ascending, all those whose factor of `level` words is not unique; cls: their classes by that factor; limit: the
    longest period that counts at a position. A class is split by the classes in which the next positions are. Only parts that split
    off in the last step, all but the largest of each class, need to be looked at, so a position moves at most log2(n) times.
    A class is a segment of `perm`. Within it each position is linked to the next one. A link over a distance d that stands when
    classes are those of length d is a square with a primitive root: it is found when the link ends, from the levels between which it stood.
    """

    def __init__(self, at: np.ndarray, cls: np.ndarray, limit: np.ndarray, level: int) -> None:
        n = len(at)
        self.at, self.limit, self.first, self.level, self.cls = at, limit, level, level, cls.astype(np.int64)
        self.perm = perm = np.argsort(cls, kind="stable")
        self.where = np.empty(n, np.int64)
        self.where[perm] = np.arange(n)
        self.size = np.bincount(cls, minlength=n).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.many = int(cls.max(initial=-1)) + 1
        self.nxt, self.prv = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.born, self.moved = np.full(n, level, np.int64), np.zeros(n, bool)
        linked = self.cls[perm[1:]] == self.cls[perm[:-1]]
        self.nxt[perm[:-1][linked]], self.prv[perm[1:][linked]] = perm[1:][linked], perm[:-1][linked]
        follows = at[1:] == at[:-1] + 1
        self.preceded = np.concatenate([np.zeros(min(n, 1), bool), follows])
        self.starts: list[np.ndarray] = []
        self.periods: list[np.ndarray] = []
        # a next position whose factor is unique, or that is no more in the document, is a class of its own
        self.p, self.s = np.arange(n), n + np.arange(n)
        self.s[:-1][follows] = self.cls[1:][follows]

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and periods (above the first level) of all squares with a primitive root."""
        while True:
            some = (self.size[self.cls[self.p]] > 1) & (self.limit[self.p] > self.level)
            self.p, self.s = self.p[some], self.s[some]
            if not len(self.p):
                break
            self.level += 1
            (self.step_of_few if len(self.p) <= FEW else self.step)()
        x = np.flatnonzero(self.nxt >= 0)
        self.end(x, self.limit[x])
        return np.concatenate([*self.starts, np.zeros(0, np.int64)]), np.concatenate([*self.periods, np.zeros(0, np.int64)])

    def end(self, x: np.ndarray, last: np.ndarray | int) -> None:
        """The links of x stood up to level `last`."""
        d = self.at[self.nxt[x]] - self.at[x]
        ok = (self.born[x] <= d) & (d <= last) & (d > self.first)
        if ok.any():
            self.starts.append(self.at[x[ok]])
            self.periods.append(d[ok])

    def step_of_few(self) -> None:
        """step() position by position: with few of them, as at most levels of a long period, faster than with arrays."""
        cls, size, begin, nxt, prv, born, perm, where = self.cls, self.size, self.begin, self.nxt, self.prv, self.born, self.perm, self.where
        by: dict[int, dict[int, list[int]]] = {}
        for x, s in sorted(zip(self.p.tolist(), self.s.tolist())):
            by.setdefault(int(cls[x]), {}).setdefault(s, []).append(x)
        small: list[int] = []
        for c, parts in by.items():
            groups = list(parts.values())
            total, home = sum(map(len, groups)), int(begin[c])
            rest = int(size[c]) - total
            if not rest and len(groups) == 1:
                continue
            then = {x: y for g in groups for x, y in zip(g, [*g[1:], -1])}
            old = {x: int(nxt[x]) for x in then}
            ended = [x for x, y in old.items() if y >= 0 and y != then[x]] + [u for u in {int(prv[x]) for x in then} if u >= 0 and u not in then]
            for x in ended:
                d = int(self.at[nxt[x]] - self.at[x])
                if born[x] <= d < self.level and d > self.first:
                    self.starts.append(self.at[x : x + 1])
                    self.periods.append(np.array([d]))
            for x in then:
                u, v = prv[x], nxt[x]
                if u >= 0:
                    nxt[u] = v
                    if int(u) not in then:
                        born[u] = self.level
                if v >= 0:
                    prv[v] = u
            last = home + rest + total - 1
            for g in reversed(groups):
                before = -1
                for x in g:
                    nxt[x], prv[x], before = then[x], before, x
                    if old[x] != then[x]:
                        born[x] = self.level
                    i, y = where[x], perm[last]
                    perm[i], where[y], perm[last], where[x] = y, i, x, last
                    last -= 1
            largest = max(range(len(groups)), key=lambda i: len(groups[i]))
            members = None if rest >= len(groups[largest]) else perm[home : home + rest].tolist()
            first = home + rest
            for i, g in enumerate(groups):
                name = c
                if members is None or i != largest:
                    name, self.many = self.many, self.many + 1
                    small += g
                begin[name], size[name], cls[g] = first, len(g), name
                first += len(g)
            if members is None:
                size[c] = rest
            elif members:
                begin[self.many], size[self.many], cls[members] = home, rest, self.many
                self.many += 1
                small += members
        x = np.array(small, np.int64)
        x = x[self.preceded[x]]
        self.p, self.s = x - 1, cls[x]

    def step(self) -> None:
        """Split the classes of the positions p by the classes s of the positions after them; the parts that split off give the next p and s."""
        cls, size, begin, nxt, prv, born, perm, where, moved, level = self.cls, self.size, self.begin, self.nxt, self.prv, self.born, self.perm, self.where, self.moved, self.level
        by = ordered(cls[self.p], self.s, self.p)
        p, s = self.p[by], self.s[by]
        self.p = self.s = p[:0]
        c = cls[p]
        new = np.ones(len(p), bool)
        new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
        head = np.flatnonzero(new)
        count = np.diff(head, append=len(p))
        owner = c[head]
        lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        groups = np.diff(lead, append=len(head))
        split, total = owner[lead], np.add.reduceat(count, lead)
        rest = size[split] - total
        real = (groups > 1) | (rest > 0)
        if not real.all():
            kept = np.repeat(real, groups)
            p = p[np.repeat(kept, count)]
            if not len(p):
                return
            count, owner, groups, split, total, rest = count[kept], owner[kept], groups[real], split[real], total[real], rest[real]
            head, lead = np.cumsum(count) - count, np.cumsum(groups) - groups
        biggest = np.maximum.reduceat(count, lead)
        rest_stays = rest >= biggest
        most = np.flatnonzero(count == np.repeat(biggest, groups))
        most = most[np.searchsorted(np.repeat(np.arange(len(split)), groups)[most], np.arange(len(split)))]
        fresh = np.ones(len(count), bool)
        fresh[most[~rest_stays]] = False

        # links: around the moved positions, then among those of each group
        moved[p] = True
        a = p[ordered(np.repeat(split, total), p)]
        before, after = prv[a], nxt[a]
        heads, tails = (before < 0) | ~moved[before], (after < 0) | ~moved[after]
        u, v = before[heads], after[tails]
        self.end(u[u >= 0], level - 1)
        then = np.full(len(p), -1, np.int64)
        then[:-1] = p[1:]
        then[head[1:] - 1] = -1
        old = nxt[p]
        changed = old != then
        self.end(p[changed & (old >= 0)], level - 1)
        nxt[p] = then
        born[p[changed]] = level
        prv[p[1:]] = p[:-1]
        prv[p[head]] = -1
        has = u >= 0
        nxt[u[has]], born[u[has]] = v[has], level
        has = v >= 0
        prv[v[has]] = u[has]

        # a class's moved positions go to the end of its segment of perm, those that stand there to the places left
        tail = begin[split] + size[split] - total
        slots = ranges(tail, total)
        occupant = perm[slots]
        stay = occupant[~moved[occupant]]
        left = where[p]
        left = left[left < np.repeat(tail, total)]
        perm[left], where[stay] = stay, left
        perm[slots], where[p] = p, slots
        moved[p] = False

        # names: the largest part keeps its class's
        off = ~rest_stays & (rest > 0)
        members = perm[ranges(begin[split[off]], rest[off])]
        rest_id = self.many + np.arange(int(off.sum()))
        self.many += len(rest_id)
        begin[rest_id], size[rest_id], cls[members] = begin[split[off]], rest[off], np.repeat(rest_id, rest[off])
        size[split[rest_stays]] = rest[rest_stays]
        group_id = owner.copy()
        group_id[fresh] = self.many + np.arange(int(fresh.sum()))
        self.many += int(fresh.sum())
        begin[group_id], size[group_id], cls[p] = slots[head], count, np.repeat(group_id, count)
        small = np.concatenate([p[np.repeat(fresh, count)], members])
        small = small[self.preceded[small]]
        self.p, self.s = small - 1, cls[small]


def runs(words: np.ndarray, sizes: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of each run of at least `least` words and two periods, by start, then period.

    words: numbers of the words of several documents one after another, `sizes` of them each; no run reaches over a document's end.
    The first classes are those of factors of half of `least` words: a shorter period of a run of `least` words shows in them already,
    as neighbours at that distance. From there on classes are refined word by word.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    level = max(1, least // 2)
    at, cls = equal_factors(words, doc, level)
    by = np.argsort(cls, kind="stable")
    gap = np.where(cls[by][1:] == cls[by][:-1], at[by][1:] - at[by][:-1], level + 1)
    near = np.flatnonzero(gap <= level)
    start, period = Classes(at, cls, sizes[doc[at]] // 2, level).squares()
    start, period = np.concatenate([at[by][near], start]), np.concatenate([gap[near], period])
    by = np.lexsort((start, period))
    start, period = start[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(first)
    last = np.append(head[1:], len(start)) - 1 if len(head) else head
    q = period[head]
    length = start[last] - start[head] + q + np.maximum(q, level)
    ok = length >= max(1, least)
    begin, length, q = start[head][ok], length[ok], q[ok]
    by = np.lexsort((q, begin))
    return begin[by], length[by], q[by]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, batch_bytes: int = 8 << 20) -> DataFrame:
    """`key`, n_words, runs (start, length, period in words) and collapsed (what is left without repetitions) of each text.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch of at least `least` words with a smallest period of at most
    half its length that no neighbouring word extends; runs stand by start, then period. A word goes if any run holds it
    after its first period; the others are joined by one space. Whole texts are read; a text is one task's work, and
    memory follows batch_bytes and the longest text. Null and empty texts have no words, no runs and an empty collapsed text; repeated
    rows have a row each; an empty table gives none; other columns are left out.
    """
    if least < 2:
        raise ValueError("least: two words or more")
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", batch_bytes):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            number: defaultdict[bytes, int] = defaultdict(numbers().__next__)
            words = [np.fromiter(map(number.__getitem__, t.split()), np.int64) for t in texts]
            sizes = np.array([len(w) for w in words], np.int64)
            starts = np.cumsum(sizes) - sizes
            begin, length, period = runs(np.concatenate([*words, np.zeros(0, np.int64)]), sizes, least)
            del words, number
            over = np.zeros(int(sizes.sum()) + 1, np.int64)
            np.add.at(over, begin + period, 1)
            np.add.at(over, begin + length, -1)
            kept = np.cumsum(over)[:-1] == 0
            of = np.searchsorted(starts, begin, side="right") - 1 if len(begin) else begin
            # documents without words share a start with the next one; a run is of the last that starts there
            per = np.bincount(of, minlength=len(sizes))
            listed = pa.StructArray.from_arrays([pa.array(c) for c in (begin - starts[of], length, period)], fields=list(struct))
            runs_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), listed)
            left = []
            for t, a, n, r in zip(texts, starts, sizes, per):
                own = t.split()
                left.append(b" ".join([own[i] for i in np.flatnonzero(kept[a : a + n])] if r else own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), runs_of, pa.array(left, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    shown = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return shown.mapInArrow(run, f"key {kind}, n_words bigint, runs {RUN}, collapsed string").withColumnRenamed("key", key)


def tail_repeated(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, by the crc32 of their id, with their words from a place on replaced by repetitions of the first of them; the others as they are."""
    code = F.crc32(doc_id.cast("string").cast("binary"))
    word = F.when(code % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n, g = F.size(word), F.floor(code / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(word, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when(n > 0, F.array_join(F.concat(F.slice(word, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")).otherwise(text)


def op11_refined_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periodic_runs(docs.select("doc_id", tail_repeated(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
