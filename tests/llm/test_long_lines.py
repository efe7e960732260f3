"""Personal data in lines longer than any bounded window."""

import random

from tessera.llm import pii


def test_entities_of_a_long_line_are_those_of_its_parts(spark):
    model, r = pii.field(), random.Random(31)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    cards = [pii._with_check(num(15)) for _ in range(300)]
    parts = [f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}" for c in cards]
    want = {s for p in parts[:1] for s in [(0, 2, len(p))]}
    assert set(pii.spans(parts[0], model)[1]) == want
    line = " x1 ".join(parts)
    got = set(pii.spans(line, model)[1])
    at = 0
    for part in parts:
        assert (at, 2, at + len(part)) in got
        at += len(part) + 4
    masked = pii.masked(line, model)
    assert not any(part in masked for part in parts)
    row = pii.scan(spark.createDataFrame([(1, line)], "doc_id long, text string")).collect()[0]
    assert row.spans.count("card:") == len(parts)


def test_streamed_programme_chooses_the_best_segmentation():
    model, r = pii.field(), random.Random(32)
    text = " ".join("".join(r.choice("0123456789-.()+a") for _ in range(r.randint(1, 14))) + r.choice("0123456789") for _ in range(400))
    (part,) = pii.regions(text)
    tokens = list(part)
    top = {}
    for i, j, start, end, found in pii.candidates(text, tokens):
        score, kind = max((model.score(k, found), -k) for k in range(4))
        if score > 0:
            top[i, j] = score, (start, -kind, end)
    value, chosen = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        value[j] = value[j - 1]
        for i in range(max(0, j - pii.MOST_TOKENS), j):
            if (i, j) in top and value[i] + top[i, j][0] > value[j]:
                value[j], chosen[j] = value[i] + top[i, j][0], i
    want, j = [], len(tokens)
    while j:
        if chosen[j] is None:
            j -= 1
        else:
            want.append(top[chosen[j], j][1])
            j = chosen[j]
    assert tokens[-1][1] == len(text) and model.best(text, iter(tokens)) == want[::-1]
