"""Language identification by unigram pieces of a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import bounded, column, cut, documents, fold, hash_below, lean, seen, slices, unused

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Probability of a code point that no piece covers, alike in all languages.
UNKNOWN = 1e-7
#: Runs of more letters are summed one by one, by logarithms.
LONG_RUN = 33
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece file in lower case: letters, after a word mark or not."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in found if p.strip(MARK).isalpha() and p.rfind(MARK) <= 0)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return joined, np.fromiter(map(len, words), np.int64, len(words))


@dataclass
class Pieces:
    """Piece numbers by hash of their code points, a sorted table for each length."""

    words: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        by = [[] for _ in range(self.longest)]
        for i, w in enumerate(self.words):
            by[len(w) - 1].append(i)
        for k, own in enumerate(by):
            codes, _ = _codes([self.words[i] for i in own])
            h = np.zeros(len(own), np.uint64)
            for j in range(k + 1):
                h = h * _BASE + codes[j :: k + 1] + np.uint64(1)
            order = np.argsort(h)
            self.tables.append((h[order], np.array(own, np.int32)[order]))

    @property
    def longest(self) -> int:
        """Code points of the longest piece, its word mark included."""
        return max(map(len, self.words), default=1)

    @property
    def unknown(self) -> int:
        return len(self.words)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' starts and lengths, and for each piece length (row) the piece that begins at each place (-1: none)."""
        codes, lengths = _codes(words)
        starts = np.cumsum(lengths) - lengths
        room = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
        h, ids = np.zeros(len(codes), np.uint64), np.full((len(self.tables), len(codes)), -1, np.int32)
        for k, (keys, numbers) in enumerate(self.tables):
            if k:
                h = h[: len(codes) - k] if len(codes) > k else h[:0]
            h = h * _BASE + codes[k : k + len(h)] + np.uint64(1)
            if len(keys) and len(h):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = (keys[at] == h) & (room[: len(h)] > k)
                ids[k, : len(h)][hit] = numbers[at[hit]]
        ids[0][ids[0] < 0] = self.unknown
        return starts, lengths, ids

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log of each word's probability in each language (prob: pieces and the unknown one by languages).

        A word of any length keeps the sums of its last places alone, as many as the longest piece has, and
        takes their size out every so often. Languages and words go in blocks, so that memory follows neither.
        """
        out = np.empty((len(words), prob.shape[1]))
        width = max(1, min(prob.shape[1], 16))
        most = max(1, (8 << 20) // (8 * width * (self.longest + 1)))
        by = np.argsort([len(w) for w in words], kind="stable")
        for part in np.split(by, np.arange(most, len(by), most)):
            lattice = self.lattice([words[i] for i in part])
            for a in range(0, prob.shape[1], width):
                out[part, a : a + width] = self._forward(*lattice, np.ascontiguousarray(prob[:, a : a + width]))
        return out

    def _forward(self, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
        order, longest = np.argsort(-lengths, kind="stable"), len(ids)
        starts, lengths = starts[order], lengths[order]
        # place t of a word stands at t modulo the window
        window = longest + 1
        alpha, scale = np.zeros((window, len(order), prob.shape[1])), np.zeros((len(order), prob.shape[1]))
        alpha[0] = 1.0
        ended = np.empty((len(order), prob.shape[1]))
        ended[lengths == 0] = 0.0
        for t in range(1, int(lengths[0]) + 1 if len(order) else 0):
            n = int(np.searchsorted(-lengths, -t, side="right"))
            now, reach = alpha[t % window], np.arange(1, min(t, longest) + 1)
            if n <= 16:
                piece = ids[reach[None] - 1, starts[:n, None] + t - reach[None]]
                now[:n] = (alpha[(t - reach) % window, :n].transpose(1, 0, 2) * np.where(piece[..., None] < 0, 0.0, prob[piece])).sum(axis=1)
            else:
                now[:n] = 0.0
                for k in reach:
                    piece = ids[k - 1][starts[:n] + t - k]
                    at = np.flatnonzero(piece >= 0)
                    now[at] += alpha[(t - k) % window, at] * prob[piece[at]]
            if t % 16 == 0:  # no probability of a place is under UNKNOWN ** 16 of that 16 places before
                size = now[:n].copy()
                alpha[:, :n] /= size
                scale[:n] += np.log(size)
            done = slice(int(np.searchsorted(-lengths, -t, side="left")), n)
            ended[done] = np.log(now[done]) + scale[done]
        out = np.empty_like(ended)
        out[order] = ended
        return out

    def expected(self, words: list[str], counts: np.ndarray, lang: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected number of each piece in each language, of words with their language and count; of words of any length."""
        total = np.zeros_like(prob)
        long = np.array([len(w) > LONG_RUN for w in words], bool)
        for i in np.flatnonzero(long):
            self._expected_long(words[i], float(counts[i]), int(lang[i]), prob, total)
        words, counts, lang = [w for w in words if len(w) <= LONG_RUN], counts[~long], lang[~long]
        starts, lengths, ids = self.lattice(words)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, counts, lang = starts[order], lengths[order], counts[order], lang[order]
        n_all, longest = len(words), int(lengths.max(initial=0))
        rows = np.arange(n_all)
        alpha, beta = np.zeros((longest + 1, n_all)), np.zeros((longest + 1, n_all))
        alpha[0] = 1.0
        beta[lengths, rows] = 1.0
        steps = []
        for t in range(1, longest + 1):
            n = int(np.searchsorted(-lengths, -t, side="right"))
            for k in range(1, min(t, len(ids)) + 1):
                piece = ids[k - 1][starts[:n] + t - k]
                at = np.flatnonzero(piece >= 0)
                p = prob[piece[at], lang[at]]
                alpha[t, at] += alpha[t - k, at] * p
                steps.append((t, k, at, piece[at], p))
        whole = alpha[lengths, rows]
        for t, k, at, piece, p in sorted(steps, key=lambda s: -s[0]):
            beta[t - k, at] += beta[t, at] * p
        for t, k, at, piece, p in steps:
            np.add.at(total, (piece, lang[at]), alpha[t - k, at] * p * beta[t, at] / whole[at] * counts[at])
        return total


    def _expected_long(self, word: str, count: float, lang: int, prob: np.ndarray, total: np.ndarray) -> None:
        """Add a long word's share to `total`: sums over segmentations by logarithms, as its probability may be under any double."""
        _, _, ids = self.lattice([word])
        n, longest = ids.shape[1], len(ids)
        with np.errstate(divide="ignore"):
            log = np.where(ids < 0, -np.inf, np.log(prob[ids, lang]))
        # row t holds what begins at t, by length, of which only the places that a word has are finite
        alpha, beta, span = np.full(n + 1, -np.inf), np.full(n + 1 + longest, -np.inf), np.arange(1, longest + 1)
        alpha[0] = beta[n] = 0.0
        for t in range(1, n + 1):
            k = span[: min(t, longest)]
            alpha[t] = np.logaddexp.reduce(alpha[t - k] + log[k - 1, t - k])
        for t in range(n - 1, -1, -1):
            beta[t] = np.logaddexp.reduce(log[:, t] + beta[t + span])
        for k in range(longest):
            at = np.flatnonzero(ids[k] >= 0)
            np.add.at(total, (ids[k, at], lang), np.exp(alpha[at] + log[k, at] + beta[at + k + 1] - alpha[n]) * count)


def runs(text: str) -> list[str]:
    """Marked lower-case letter runs of a text, of any length."""
    return [MARK + w for w in LETTERS.findall(text.lower())]


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray
    prior: np.ndarray

    def scorer(self, most_bytes: int = 32 << 20):
        """A function of texts: a language (`und`: null, or no letter) and its posterior. Keeps words' values up to about `most_bytes`."""
        pieces, width = Pieces(self.pieces), len(self.languages)
        most = max(1, most_bytes // (160 + 8 * width))
        known, values = {}, np.empty((most, width))

        def score(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
            words = [runs(t) if t else [] for t in texts]
            flat = pa.array([w for own in words for w in own], pa.string()).dictionary_encode()
            distinct = flat.dictionary.to_pylist()
            new = [w for w in distinct if w not in known]
            if len(known) + len(new) > most:
                known.clear()
                new = distinct
            got = pieces.forward(new, self.prob)
            table = np.empty((len(distinct), width))
            if len(new) < len(distinct):
                place = np.array([known.get(w, -1) for w in distinct])
                table[place >= 0], table[place < 0] = values[place[place >= 0]], got
            else:
                table = got
            short = [i for i, w in enumerate(new) if len(w) <= 64][: most - len(known)]
            base = len(known)
            values[base : base + len(short)] = got[short]
            known.update((new[i], base + j) for j, i in enumerate(short))
            owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
            each = flat.indices.to_numpy()
            sums = np.stack([np.bincount(owner, table[each, k], len(texts)) for k in range(width)], axis=1)
            sums = sums + np.log(self.prior)
            post = np.exp(sums - sums.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            blank = np.array([not (t and any(map(str.isalpha, t))) for t in texts], bool)
            return ["und" if b else self.languages[k] for b, k in zip(blank, best)], np.where(blank, 0.0, post[np.arange(len(texts)), best])

        return score


def learn(labelled: DataFrame, vocabulary_path: str | None = None, rows_per_language: int = 1200, rounds: int = 3, smoothing: float = 0.1, seed: int = 2, most_languages: int = 2000) -> LanguageModel | None:
    """Piece probabilities of each language from columns doc_id, text and lang (none null), by expectation maximisation.

    About `rows_per_language` documents a language, picked by a hash of doc_id, give their
    word counts, of runs of any length; priors come from all rows. None if there is no labelled row.
    Repeated rows count as often as they stand. A model has a number for each piece and language, so more than `most_languages` are an error.
    """
    counts = cut(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if seen(counts)["rows"] > most_languages:
        raise ValueError("lang: more values than most_languages")
    have = {r["lang"]: r["n"] for r in counts.collect()}
    languages = sorted(have)
    if not languages:
        return None
    names = vocabulary(vocabulary_path or public_tokenizers.path("piece_bpe_32k.model"))
    rate = F.lit(0.0)
    for name in languages:
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, rows_per_language / have[name]))).otherwise(rate)
    picked = labelled.where(hash_below(F.col("doc_id"), rate, seed))
    number = {name: i for i, name in enumerate(languages)}

    @lean
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = {}
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()):
                mine = own.setdefault(lang, {})
                for w in runs(text or ""):
                    mine[w] = mine.get(w, 0) + 1
            for lang, mine in own.items():
                yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(mine), pa.int32()), pa.array(list(mine), pa.string()), pa.array(list(mine.values()), pa.int64())], ["lang", "word", "n"])

    counted = cut(bounded(picked).select("lang", "text").mapInArrow(words, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    prob = np.full((len(names) + 1, len(languages)), 1.0 / (len(names) + 1))
    prob[-1] = UNKNOWN
    for _ in range(rounds):

        @lean
        def expect(batches: Iterator[pa.RecordBatch], prob=prob) -> Iterator[pa.RecordBatch]:
            pieces, total = Pieces(names), np.zeros_like(prob)
            for batch in batches:
                for a in range(0, batch.num_rows, 5_000):
                    part = batch.slice(a, 5_000)
                    total += pieces.expected(column(part, "word").to_pylist(), column(part, "n").to_numpy().astype(float), column(part, "lang").to_numpy(), prob)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        sums = counted.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros_like(prob)
        found[sums["piece"], sums["lang"]] = sums["n"].round(6)
        found[-1] = 0.0
        pooled = found[:-1].sum(axis=1, keepdims=True) + smoothing
        found[:-1] += smoothing * len(names) ** 0.5 * pooled / pooled.sum() + smoothing / 100
        prob = found / found.sum(axis=0)
        prob[-1] = UNKNOWN
    prior = np.array([have[name] for name in languages], float)
    return LanguageModel(languages, names, prob, prior / prior.sum())


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns of `docs` with lang_pred and score (or as `names` calls them), from the text alone.

    lang_pred is `und` with score 0 for a null text, one without a letter, or without a
    model; else score is the language's posterior, of equal ones the language that is first by name. Columns of docs so named are replaced.
    Repeated rows give repeated results; an empty table gives no rows.
    """
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in slices(batches, text, 2 << 20):
            lang, value = score(column(batch, text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(value, pa.float64())], [*batch.schema.names, *names])

    return bounded(docs).mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(training_rows(docs))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def language_stage(docs: DataFrame) -> DataFrame:
    """Documents to which a language is given; `und` alone goes, whatever the posterior of the others."""
    names = (unused(docs, "lang_pred"), unused(docs, "score"))
    known = identify(docs, learn(training_rows(docs)), names=names)
    return known.where(F.col(names[0]) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])
