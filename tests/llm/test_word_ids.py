"""Chunks kept by WordIds: those in use stay when others are forgotten, over the tasks of a worker."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexgrove.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_in_use_are_learned_once():
    full, learned = Tokenizer.from_file(PATH), []

    class Watched(tokens.WordIds):
        def _learn(self, new):
            learned.append(new)
            return super()._learn(new)

    mine = Watched(PATH, most_bytes=200 * tokens.CHUNK_BYTES)
    name = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    words = ["the", "house,", "über", "it's", "3rd", "x" * 70]
    for i in range(60):
        texts = [" ".join([*words, *(name(40 * i + j) + "q" for j in range(40))]), " ".join(words)]
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.of(texts)] == [full.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(mine.known) + len(mine.known.older) <= 200
    # the chunk of 70 characters is not kept; a mark and the word before it are chunks too
    assert all(learned.count(w) == 1 for w in [*words[:-1], "house", ","]) and learned.count(words[-1]) == 120 and len(learned) == 60 * 40 + 7 + 120


def test_a_worker_keeps_what_its_tasks_learn():
    a, b = tokens.word_ids(PATH), tokens.word_ids(PATH)
    first = a.of(["one two"])
    assert a is b and len(list(b.of(["three"]))) == 1 and len(list(first)) == 1 and "two" in a.known
