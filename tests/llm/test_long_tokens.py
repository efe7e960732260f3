"""Secrets in tokens of any length."""

import random

import pytest

from tessera.llm import secrets

ALPHABET = secrets.ALPHABETS["base64"]


def test_long_random_tokens_are_found_and_long_words_are_not(spark):
    r = random.Random(21)
    sizes = [257, 300, 511, 1024, 1025, 1026, 2049, 5000, 40_000]
    keys = ["".join(r.choice(ALPHABET) for _ in range(n)) for n in sizes * 4]
    rows = [(k, f"see {key} here") for k, key in enumerate(keys)]
    rows += [(100 + k, "internationalisation_of_the_settings_page_2_" * (10 + k)) for k in range(60)]
    got = {x.doc_id: x.spans for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(f"random:4:{4 + len(key)}" in got[k] for k, key in enumerate(keys)) >= 0.8 * len(keys)
    assert not any("random" in got[100 + k] for k in range(60))


def test_parts_of_a_long_token_sum_to_the_whole(spark):
    import math

    r = random.Random(22)
    tokens = ["".join(r.choice(ALPHABET + "-") for _ in range(n)) for n in (20, 1023, 1024, 1025, 1026, 2048, 2049, 2050, 7000)]
    tokens.append("abcd+efgh-ijkl_mnop/qrst0123")
    got = {x.token: x for x in secrets._tests(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    for token in tokens:
        x = got[token]
        alphabet = secrets.ALPHABETS[x.encoding]
        places = [alphabet.index(c) for c in token if c in alphabet]
        n, k = len(token), len(alphabet)
        counts = [places.count(p) for p in set(places)]
        chi = sum(c * c for c in counts) * k / n - n
        z = ((max(chi, 1e-9) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
        pairs = list(zip(places, places[1:]))
        runs = (sum((a < k / 2) != (b < k / 2) for a, b in pairs) - (n - 1) / 2) / (math.sqrt(n - 1) / 2)
        serial = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in pairs) / ((k * k - 1) / 12 * math.sqrt(n - 1))
        tail = lambda v: 2 / (1 + math.exp(1.5976 * min(abs(v), 12) + 0.070566 * min(abs(v), 12) ** 3))
        upper = tail(z) / 2 if z > 0 else 1 - tail(z) / 2
        assert x.p == pytest.approx(1 - (1 - min(upper, tail(runs), tail(serial), 1.0)) ** 3, rel=1e-6, abs=1e-15)
        assert x.bits == pytest.approx(sum(-c / n * math.log2(c / n) for c in counts))
