"""Token trees under many edits, odd edits and repeated ids."""

import random

import pytest

from tessera.llm import tokens


def test_leaves_stay_small_under_many_edits():
    r, encode = random.Random(1), tokens.byte_bpe()
    text = " ".join(f"word{r.randint(0, 99)}" for _ in range(2000))
    chars, count = tokens.trees_of(text, encode)
    for _ in range(150):
        at = sorted(r.randint(0, len(text)) for _ in range(2 * r.randint(1, 3)))
        steps = tokens.apart([(a, min(b, a + 30), " ".join("new words here"[: r.randint(0, 14)] for _ in range(r.randint(0, 60)))) for a, b in zip(at[::2], at[1::2])], len(text))
        read = tokens.edit(text, chars, count, steps, encode)
        text = tokens.edited(text, steps)
        assert count.total == len(encode(text)) and chars.total == len(text)
        assert read <= sum(len(new) for *_, new in steps) + len(steps) * 4 * 2 * tokens.LEAF
    assert max(chars.sums[chars.n :]) <= 4 * tokens.LEAF
    for _ in range(40):  # down to nothing
        steps = [(len(text) // 3, 2 * len(text) // 3, "")]
        tokens.edit(text, chars, count, steps, encode)
        text = tokens.edited(text, steps)
        assert count.total == len(encode(text))


def test_odd_edits():
    assert tokens.apart([(5, 9, "b"), (0, 3, None), (2, 6, "x"), (None, 1, "x"), (1, None, "x"), (7, 4, "x"), (-1, 2, "x"), (50, 60, "e")], 12) == [(0, 3, ""), (5, 9, "b"), (12, 12, "e")]


def test_edits_of_repeated_ids(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "another text here"), (2, None), (3, "left alone"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edits = spark.createDataFrame([(1, 0, 3, "1"), (1, 2, 5, "overlaps"), (1, None, 2, "x"), (2, 0, 0, "new"), (None, 0, 1, "x")], "doc_id long, start int, end int, replacement string")
    encode = tokens.byte_bpe()
    got = sorted((r.doc_id, r.n_tokens) for r in tokens.apply_edits(docs, tokens.count_trees(docs), edits).collect())
    want = sorted([(1, len(encode("1 two three")))] * 2 + [(1, len(encode("1ther text here"))), (2, len(encode("new")))])
    assert got == want


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_trees_of_odd_tables(request, table):
    docs = request.getfixturevalue(table)
    assert tokens.count_trees(docs).count() == docs.count()
