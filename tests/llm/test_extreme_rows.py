"""Rows that once ended a task or lost a result: endless blanks, padded digits, glued tokens, ids that repeat or lack."""

import base64
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, language_id, packing, pii, secrets, sharding, tokens


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def blanks():
    return ["a" + " " * 2_000_000 + "b", "\n" * 1_200_000, "x " + "\t \n" * 500_000 + "<|endoftext|> y", " " * 1_000_000 + " " * 200_000 + "end"]


def test_ids_of_endless_blanks(plain):
    encode = tokens.byte_bpe()
    for text in [*blanks(), "a" + " " * 99_999 + "b", " " * 100_000]:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_endless_blanks_pass_every_count(spark, plain):
    rows = [(k, text) for k, text in enumerate(blanks())] + [(9, "some words"), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: len(plain.encode(t or "", add_special_tokens=False).ids) for k, t in rows}
    pieces = packing.packed(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in pieces} == want  # less the separator
    assert {r.doc_id: r.n_tokens for r in tokens.counted(docs).collect()} == want
    assert sharding.sharded(docs, shards=2).count() == len(rows)


def test_padded_address_parts(spark):
    pad = "0" * 10_000
    texts = [pad + "1.2.3.4", f"1.{pad}.3.{pad}255", f"1.2.3.{pad}256", f"{pad}1.2.3.4567", "00.00.00.00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_ip for r in pii.scan(docs).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}
    assert pii.mask(docs).count() == len(texts)


def test_random_tokens_beside_failing_assignments(spark):
    r = random.Random(7)
    token = lambda: base64.urlsafe_b64encode(r.randbytes(30)).decode()
    forms = ["{}", "{} token = abc", "{}token = abc", "x token: a {}", "secret={{a}} {}"]
    rows = [(k, forms[k % len(forms)].format(token())) for k in range(600)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter(r.doc_id % len(forms) for r in got if "random" in r.spans)
    assert all(found[k] >= 115 for k in range(len(forms))), found


def links(rows):
    """Counter of (vec_id, n_links, component_id, kept) of (vec_id, vector, label), row by row."""
    fine = [label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    root, count = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if fine[i] and fine[j] and a == b and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= embedding_dedup.COSINE:
                    count[i] += 1
                    count[j] += 1
                    root[find(i)] = find(j)
    out = Counter()
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out[(vec_id, count[i], least, vec_id == least)] += 1
    return out


def test_vectors_without_ids_of_their_own(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = r.normal(size=8)
        for _ in range(int(r.integers(1, 6))):
            v = base + r.normal(scale=0.01, size=8)
            vec_id = [None, 1, 2, int(r.integers(0, 40)), 1000 + len(rows)][int(r.integers(0, 5))]
            rows.append((vec_id, v.tolist(), int(k % 2)))
            if r.random() < 0.2:
                rows.append((vec_id, v.tolist(), int(k % 2)))
    rows += [(None, [9.0] + [0.0] * 7, 0), (None, [0.0] * 8, 0), (1, None, 1), (3, [1.0] * 8, None)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in got.collect()) == links(rows)


def test_large_group_without_ids(spark):
    r = random.Random(2)
    same = "one text that three thousand rows share " * 3
    rows = [(None, same)] * 3000 + [(k % 50, " ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(5, 60)))) for k in range(1000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, slots = Counter(), {}
    for x in got:
        sizes[x.shard] += x.size
        slots.setdefault(x.shard, []).append(x.slot)
    mean = sum(sizes.values()) / 40
    assert len(got) == 4000 and len(sizes) == 40 and max(abs(s - mean) for s in sizes.values()) <= 0.01 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_two_hundred_languages(spark):
    r = random.Random(4)
    names = [f"l{k:03}" for k in range(200)]
    vocabulary = {n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for n in names}
    say = lambda n, k: " ".join(r.choice(vocabulary[n]) for _ in range(k))
    rows = [(len(names) * k + i, say(n, 40), n) for k in range(6) for i, n in enumerate(names)]
    mixed = [(100_000 + k, say(names[k], 25) + " " + say(names[199 - k], 45), None) for k in range(60)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.identified(docs).collect()}
    assert sum(got[i].lang_pred == n for i, _, n in rows) >= 0.98 * len(rows)
    assert sum(got[100_000 + k].lang_pred == names[199 - k] for k in range(60)) >= 57
    assert sum(got[100_000 + k].spans == f"0:25:{names[k]},25:70:{names[199 - k]}" for k in range(60)) >= 50


def test_scripts_by_block():
    words = {"latin": "Việt", "greek": "ἄνθρωπος", "cyrillic": "слово", "armenian": "բառ", "hebrew": "מילה", "arabic": "كلمة", "devanagari": "शब्द", "bengali": "শব্দ", "tamil": "சொல்", "thai": "คำ", "tibetan": "ཚིག", "georgian": "სიტყვა", "ethiopic": "ቃል", "khmer": "ពាក្យ", "hangul": "단어", "kana": "ことば", "cjk": "词语", "other": "ⵜⴰⵡⴰⵍ"}
    for script, word in words.items():
        plane = np.frombuffer(word.encode(), np.uint8)
        got = language_id.word_scripts(plane, np.array([0]), np.array([len(plane)]))
        assert language_id.SCRIPTS[got[0]] == script, (script, word)
    mixed = np.frombuffer("abcдеж漢字漢字".encode(), np.uint8)
    assert language_id.SCRIPTS[language_id.word_scripts(mixed, np.array([0]), np.array([len(mixed)]))[0]] == "cjk"


def test_scripts_tell_languages_of_one_alphabet_apart(spark):
    rows = [(k, text, lang) for k in range(40) for text, lang in (("शब्द और वाक्य", "hi"), ("শব্দ এবং বাক্য", "bn"), ("คำและประโยค", "th"))]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)] + [(900, "ประโยค", None), (901, "বাক্য", None), (902, "ℝ", None), (903, "々 〆", None), (904, "→ ★", None), (905, "12 €", None)]
    got = {x.doc_id: x for x in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[900].lang_pred, got[901].lang_pred) == ("th", "bn")
    assert got[902].lang_pred in ("hi", "bn", "th") and got[902].score == 0 and got[903].lang_pred in ("hi", "bn", "th")
    assert got[904].lang_pred == got[905].lang_pred == "und" and got[904].score == 1
