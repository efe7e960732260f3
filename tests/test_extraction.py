"""Table functions with failing extractors, and canonical records against a fold."""

import random

import pytest

from tessera.functions import extraction as x
from tessera.operators import entities

TEXTS = [(1, "Anna met Berta.\nThen Anna left with Carl Dora"), (2, None), (3, ""), (4, "bad Omen here"), (5, "nothing")]


def frame(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def test_rows_of_rules(spark):
    got = sorted((r.id, r.kind, r.name, r.target or "", r.start) for r in x.extracted(spark, frame(spark), {"rules": x.capitalised_words}).collect())
    assert got == [(1, "entity", "Anna", "", 0), (1, "entity", "Anna", "", 21), (1, "entity", "Berta", "", 9), (1, "entity", "Carl", "", 36), (1, "entity", "Dora", "", 41), (1, "entity", "Then", "", 16),
                   (1, "relation", "Anna", "Berta", 9), (1, "relation", "Anna", "Carl", 36), (1, "relation", "Carl", "Dora", 41), (1, "relation", "Then", "Anna", 21), (4, "entity", "Omen", "", 4)]


def test_a_failing_extractor_leaves_the_others(spark):
    def fails(text):  # local, so that it is shipped as a whole
        if text.startswith("bad"):
            raise ValueError("no such model")
        return [("entity", text[:3], None, 0)]

    rows = x.extracted(spark, frame(spark), {"rules": x.capitalised_words, "broken": fails}, "entity")
    assert "target" not in rows.columns
    got = {(r.id, r.model, r.kind, r.error) for r in rows.filter("id = 4").collect()}
    assert got == {(4, "rules", "entity", None), (4, "broken", "error", "ValueError: no such model")}
    merged = {(r.id, r.name, r.n_models, r.n) for r in x.merged_models(rows, 1).collect()}
    assert {(1, "Anna", 1, 2), (4, "Omen", 1, 1), (5, "not", 1, 1)} <= merged


def test_arguments_are_checked(spark):
    spark.udtf.register("extract_checked", x.table_function({"rules": x.capitalised_words}))
    for call in ("extract_checked(1)", "extract_checked('Anna', 'verbs')"):
        with pytest.raises(Exception, match="argument"):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert spark.sql("SELECT name FROM extract_checked('Anna', 'entity')").collect()[0].name == "Anna"


def test_records_equal_a_fold(spark):
    r, rows = random.Random(4), []
    for place in range(400):
        rows.append((f"c{r.randint(0, 12)}", place, r.choice("abcdef"), r.choice(["x", "y", None]), r.randint(0, 5), round(r.random(), 3)))
    want = {}
    for c, place, form, description, chunk, x_ in rows:
        w = want.setdefault(c, {"forms": [], "d": set(), "ch": set(), "n": 0, "first": place, "conf": 0.0})
        w["forms"] += [form] * (form not in w["forms"])
        w["d"] |= {description} - {None}
        w["ch"].add(chunk)
        w["n"] += 1
        k = len(w["forms"])
        w["conf"] = (w["conf"] * (k - 1) + x_) / k if k > 1 else x_
    got = entities.canonical_records(spark.createDataFrame(rows, "canonical string, place long, form string, description string, chunk int, confidence double").repartition(5))
    for q in got.collect():
        w = want.pop(q.canonical)
        assert (q.primary_name, q.n_forms, q.n_descriptions, q.n_chunks, q.n, q["first"]) == (w["forms"][0], len(w["forms"]), len(w["d"]), len(w["ch"]), w["n"], w["first"])
        assert q.confidence == pytest.approx(w["conf"], abs=1e-9)
    assert not want
