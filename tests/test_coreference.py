"""Scored antecedents against a plain version."""

import random
import re

from tessera.operators import coreference as c


def plain(text, lang, entities, back=3):
    """[(start, antecedent, score)] of a text's pronouns."""
    sentence = lambda at: sum(bool(re.search("[.!?]", m.group())) for m in re.finditer(r"[^\W\d_]+|[\W\d_]+", text[:at]))
    out = []
    for m in re.finditer(r"[^\W\d_]+", text):
        word = m.group().lower()
        if word not in c.PRONOUNS.get(lang or "en", ()):
            continue
        kinds = c.PERSONS + c.ORGANISATIONS if word in c.PERSON else c.ORGANISATIONS + c.THINGS if word in c.THING else c.PERSONS + c.ORGANISATIONS + c.THINGS
        best = None
        for start, end, name, kind in sorted(entities):
            away = sentence(m.start()) - sentence(start)
            if end < m.start() and away <= back:
                score = 10 * (kind in kinds) + 2 * (back - away) + 5 * (away == 0)
                if best is None or score > best[1]:
                    best = (name, score)
        if best:
            out.append((m.start(), *best))
    return out


def run(spark, rows, entities):
    runs = c.runs_of(spark.createDataFrame(rows, "id long, lang string, text string"))
    found = c.antecedents(runs, spark.createDataFrame(entities, "id long, start int, end int, name string, type string"))
    return runs, found


def test_literal_cases(spark):
    text = "Marie Curie met Acme. She liked it! They left. Nobody came. It rained? He slept."
    rows = [(1, "en", text), (2, "de", "Anna kam. Dann ging sie, und es war gut."), (3, None, None), (4, "en", ""), (5, "xx", "Anna. She")]
    entities = [(1, 0, 11, "Marie Curie", "PERSON"), (1, 16, 20, "Acme", "ORG"), (2, 0, 4, "Anna", "PERSON"), (5, 0, 4, "Anna", "PERSON")]
    runs, found = run(spark, rows, entities)
    got = {r.id: (r.text, r.n_resolved) for r in c.rewritten(runs, found).collect()}
    assert got[1] == ("Marie Curie met Acme. Marie Curie liked Acme! Marie Curie left. Nobody came. It rained? He slept.", 3)
    assert got[2] == ("Anna kam. Dann ging Anna, und Anna war gut.", 2) and got[5] == ("Anna. She", 0) and 3 not in got
    assert {(r.antecedent, r.n) for r in c.chains(found).filter("id = 1").collect()} == {("Marie Curie", 2), ("Acme", 1)}


def test_random_texts(spark):
    r, rows, entities = random.Random(8), [], []
    for k in range(80):
        lang = r.choice(["en", "de", "fr", "es", None])
        words = ["stone", "river", "Über", "Ña", "x1"] + list(c.PRONOUNS[lang or "en"])[:8]
        text = " ".join(r.choice(words).title() if r.random() < 0.1 else r.choice(words) + r.choice(["", "", ".", "!", " ?!", ","]) for _ in range(r.randint(1, 40)))
        rows.append((k, lang, text))
        for m in r.sample(list(re.finditer(r"[^\W\d_]+", text)), k=min(4, len(re.findall(r"[^\W\d_]+", text)))):
            entities.append((k, m.start(), m.end(), m.group(), r.choice(["PERSON", "ORG", "PRODUCT", "OTHER"])))
    _, found = run(spark, rows, entities)
    got = sorted((x.id, x.start, x.antecedent, x.score) for x in found.collect())
    want = sorted((k, *hit) for k, lang, text in rows for hit in plain(text, lang, [e[1:] for e in entities if e[0] == k]))
    assert got == want and len(got) > 200


def test_runs_stay_in_their_rows(spark):
    """only pronouns, entities and texts are shuffled, not a row for each run."""
    odd = "Marian \U00020000it \U0001f600it, It\u02b0 sit? IT."
    texts = spark.createDataFrame([(1, "en", "Marian came. She " + "stone " * 3000), (2, "en", None), (None, "en", "Marian? He"), (4, "en", "it"), (5, "en", odd), (6, "xx", "Marian it")], "id long, lang string, text string")
    runs = c.runs_of(texts)
    found = c.antecedents(runs, c.capitalised(runs))
    got = {r.id: (r.text[:40], r.n_resolved) for r in c.rewritten(runs, found).collect()}
    assert got == {1: ("Marian came. Marian stone stone stone stone stone"[:40], 1), None: ("Marian? He", 0), 4: ("it", 0), 5: ("Marian \U00020000it \U0001f600Marian, It\u02b0 sit? Marian.", 2), 6: ("Marian it", 0)}
    want = [(5, *hit) for hit in plain(odd, "en", [(0, 6, "Marian", "PERSON")])]
    assert sorted((r.id, r.start, r.antecedent, r.score) for r in found.filter("id = 5").collect()) == sorted(want) and len(want) == 2
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
