"""Rows of chosen tags against those of whole trees."""

import json
import random

import pytest

from lexgrove.operators import outline as toc
from lexgrove.sources.nodes import COLUMNS, tagged_columns, tree_columns


def _tree(rng, depth=0):
    if depth and rng.random() < 0.3:
        return rng.choice(["text", "", None, 3, ["x"], "法"])
    node = {"tag": rng.choice([*toc.TAGS, "Paragraph", "ParagraphSentence", "Item", "LawBody", None, 5])}
    if rng.random() < 0.5:
        node["attr"] = rng.choice([{"Num": "1"}, {"Num": 2}, {}, None, "x"])
    if rng.random() < 0.9:
        node["children"] = rng.choice([None, "text", [], *[[_tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]] * 6]) if depth < 6 else ["end"]
    return node


def test_rows_of_tags_are_those_of_the_whole_tree():
    rng = random.Random(3)
    wanted = [c for c in COLUMNS if c not in ("head", "closes", "shut")]
    for tags in (frozenset(toc.TAGS), frozenset(["LawBody", "Item", "Paragraph", "ParagraphSentence"]), frozenset()):
        for _ in range(400):
            body = json.dumps(_tree(rng))
            whole, some = ({c: [] for c in wanted} for _ in range(2))
            tree_columns(body, wanted, whole)
            n = tagged_columns(body, wanted, some, tags)
            kept = [i for i, t in enumerate(whole["tag"]) if isinstance(t, str) and t in tags]
            assert n == len(kept)
            assert some == {c: [whole[c][i] for i in kept] for c in wanted}
    for bad in (None, "", "{", "[]", "3"):
        assert tagged_columns(bad, wanted, {c: [] for c in wanted}, frozenset(["Law"])) == 0


def test_deep_trees_and_json_of_some_rows():
    deep = '{"tag":"Chapter","children":[' * 900 + '"x"' + "]}" * 900
    rows = {c: [] for c in ("begin", "end", "level")}
    assert tagged_columns(deep, list(rows), rows, frozenset(["Chapter"])) == 900
    assert rows["end"] == [901] * 900 and rows["level"] == list(range(900))
    from lexgrove.sources.nodes import _checked

    with pytest.raises(ValueError, match="all its rows"):
        _checked(["begin", "head"], ["Chapter"])
