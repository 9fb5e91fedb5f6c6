"""Token ids of whole texts by a public vocabulary, and token counts by section from one encoding."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import bounded, column, documents, kept, lean, slices

#: Python takes the separators for white space, the vocabulary's patterns don't; special tokens begin with "<|".
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Latin letters with a mark after them or none.
_LATIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]{1,64})([.,;:!?]?)")
#: What a kept chunk takes: its string, its ids and its place in the table, of chunks of up to 64 characters.
CHUNK_BYTES = 240


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet as a rule: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
    return {b: 256 + i for i, b in enumerate(hidden)}


@kept(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _merger(path: str):
    """The merge model of a vocabulary without its own cache of words: here a word comes to it when it is new."""
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.pop("merges")]
    return BPE(model.pop("vocab"), merges, cache_capacity=0, **{k: v for k, v in model.items() if v is not None and k != "type"})


class _Chunks(dict):
    """Ids by chunk, learned when they are first asked for.

    Up to `most` are kept; when there are more they become the older ones, which are forgotten at the next
    such time unless they have been asked for since. Chunks of over 64 characters are not kept.
    """

    def __init__(self, learn: Callable[[str], bytes], most: int) -> None:
        self.learn, self.most, self.older = learn, most, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.learn(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class WordIds:
    """Ids of texts by a lower-casing vocabulary that never merges across white space, kept by chunk.

    A chunk is what stands between white space. Its ids don't depend on its neighbours, so a
    text's ids are its chunks' ids one after another. Latin letters, with one mark after them or
    none, go straight to the merge model; other chunks, and texts whose lower case is not
    settled (odd separators, final sigma, composition), to the whole tokenizer. Chunks are kept up to about
    `most_bytes`, each at CHUNK_BYTES, half of them as older ones.
    """

    def __init__(self, path: str, most_bytes: int = 128 << 20) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = _merger(path)
        self.known = _Chunks(self._learn, max(1, most_bytes // CHUNK_BYTES // 2))
        self.letters = _byte_letters()

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, chunk: str) -> bytes:
        parts = _LATIN.fullmatch(chunk)
        if parts is None:
            return self._encode(chunk)
        word, mark = parts.groups()
        if mark:
            return self.known[word] + self.known[mark]
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """Native 32-bit ids of each text."""
        get = self.known.__getitem__
        for t in texts:
            low = t.lower()
            settled = low.isascii() or (is_normalized("NFC", t) and is_normalized("NFC", low) and "\u03a3" not in t)
            yield b"".join(map(get, low.split())) if settled and not any(odd in t for odd in _ODD) else self._encode(t)


@kept(1)
def word_ids(path: str) -> WordIds:
    """One WordIds of a vocabulary for a Python worker's tasks of this kind, one after another: what a task has learned the next one knows."""
    return WordIds(path)


@kept(4)
def _ranks(path: str):
    """A byte-level vocabulary and each token's length in bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def section_counts(ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section: `ends` are the tokens' byte ends, `cuts` the sections' byte ends, the last at the text's end.

    A token inside one section counts there. A token over several counts where its first byte
    is ("first"), where its last byte is ("last"), or where most of its bytes are, of equals
    the first ("most").
    """
    begins = np.concatenate(([0], ends[:-1]))
    a = np.searchsorted(cuts, begins, side="right")
    b = np.searchsorted(cuts, ends - 1, side="right")
    home = {"first": a, "last": b, "most": a.copy()}[rule]
    if rule == "most":
        for t in np.flatnonzero(a != b):
            edges = np.concatenate(([begins[t]], cuts[a[t] : b[t]], [ends[t]]))
            home[t] = a[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(home, minlength=len(cuts))


def count_by_section(docs: DataFrame, vocabulary: str | None = None, separator: str = "\n", rule: str = "most", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per section of each text: key, section, begin, length (code points), n_tokens, doc_tokens.

    Sections are what a one-byte separator ends, itself included; a text is encoded once, and its tokens go
    to the sections by byte offsets under `rule` (see section_counts). A section may get no
    token. The sections' counts add up to doc_tokens. A null or empty text has one section
    with no token. Repeated rows give repeated results; other columns are left out.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[key].dataType.simpleString()

    @lean(uses=(_ranks,))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = _ranks(path)
        mark = separator.encode()
        for batch in slices(batches):
            rows, counts, begins, sizes, which, totals = [], [], [], [], [], []
            for i, value in enumerate(column(batch, "text").to_pylist()):
                value = value or ""
                raw = np.frombuffer(value.encode(), np.uint8)
                cuts = np.flatnonzero(raw == mark[0]) + 1
                if not len(cuts) or cuts[-1] < len(raw):
                    cuts = np.append(cuts, len(raw))
                n = section_counts(np.cumsum(lengths[coder.encode_to_numpy(value, disallowed_special=())]), cuts, rule) if value else np.zeros(1, np.int64)
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[np.concatenate(([0], cuts))]
                rows.append(np.full(len(cuts), i))
                which.append(np.arange(len(cuts)))
                counts.append(n)
                begins.append(points[:-1])
                sizes.append(np.diff(points))
                totals.append(np.full(len(cuts), n.sum()))
            flat = lambda x: pa.array(np.concatenate(x).astype(np.int64))
            keys = column(batch, "key").take(flat(rows))
            yield pa.RecordBatch.from_arrays([keys, *map(flat, (which, begins, sizes, counts, totals))], ["key", "section", "begin", "length", "n_tokens", "doc_tokens"])

    if len(separator.encode()) != 1:
        raise ValueError("separator: one byte")
    out = bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, section long, begin long, length long, n_tokens long, doc_tokens long")
    return out.withColumnRenamed("key", key)


def op9_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_section(documents(spark, sf_dir).select("doc_id", "text"))
