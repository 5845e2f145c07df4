import itertools
import unicodedata

import pytest

from tidewright.llm import lookalikes as L

SAME = [
    ("ABC 123", "ＡＢＣ　１２３"),
    ("a b", "a b"),
    ("a b", "a b"),
    ("café", "café"),
    ("café", "cаfе́"),
    ("йё", "йё"),
    ("word", "w​o­r⁠d﻿"),
    ("Kelvin", "Kelvin"),
    ("N(µ, σ)", "N(μ, σ)"),
    ("off file flow", "oﬀ ﬁle ﬂow"),
    ("BTCUSDT", "ВТСUSDΤ"),
    ("cop", "сор"),
    ("σT", "σΤ"),
    ("Δto", "Δtο"),
    ("суд", "cyд"),
    ("で", "で"),
    ("line\nend", "line\r\nend"),
    ("end", "end  \n"),
    ("warn ⚠", "warn ⚠️"),
]
DIFFERENT = ["abc", "Abc", "ábc", "abc2", "abc²", "abª", "aba", "a bc", "a  bc", "abç", "ab-c", "ab—c", "ab0", "abo", "ab1", "abl", "abI", "①", "1", "½", "1/2", "и", "й", "u", "ρ", "p", "σ", "\U0001f468‍\U0001f469", "\U0001f468\U0001f469"]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look_same_form(a, b):
    assert a != b and L.one_form(a) == L.one_form(b)
    assert L.one_form(L.one_form(b)) == L.one_form(b)


def test_different_look_different_form():
    for a, b in itertools.combinations(DIFFERENT, 2):
        assert L.one_form(a) != L.one_form(b), (a, b)


def test_scripts_stay_consistent():
    russian = "Сессия прошла проверку"
    assert L.one_form(russian) == russian
    assert L.one_form("прoвеpка") == "проверка"
    assert L.one_form("plain text") == "plain text"


def test_spelling_depends_on_classes_only():
    letters = "aоoеtдσΔ"
    classes = L.letter_classes()
    by_look = {}
    for token in itertools.product(letters, repeat=3):
        look = tuple(classes.get(ch, (ch,)) for ch in token)
        by_look.setdefault(look, set()).add(L.spell_token("".join(token)))
    assert all(len(v) == 1 for v in by_look.values())
    assert len({next(iter(v)) for v in by_look.values()}) == len(by_look)


def test_tables():
    assert all(len(row) == 3 for row in L.letter_classes().values())
    for ch, row in L.letter_classes().items():
        for script, x in zip(L.SCRIPTS, row):
            assert x is None or unicodedata.name(x).startswith(script) or x == "ϳ"
    plain = L.plain_forms()
    assert plain[0xFF21] == "A" and plain[0x00A0] == " " and plain[0x200B] == "" and 0x00B2 not in plain and 0x00AA not in plain


SCHEMA = "doc_id bigint, text string, __f string, form string"


def documents(spark):
    texts = ["same text", "ѕame text", "same text", "same text", "Same text", "other", None, "", " ​ ", " ", "long " * 30_000, "long " * 30_000, "same text"]
    return texts, spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("copies", [1, 10_000])
def test_pairs_by_brute_force(spark, monkeypatch, copies):
    monkeypatch.setattr(L, "BLOCK", copies)
    texts, df = documents(spark)
    got = sorted((r.doc_id_a, r.doc_id_b) for r in L.lookalike_pairs(df).collect())
    seen = [(i, t, L.one_form(t)) for i, t in enumerate(texts) if t is not None and L.is_visible(L.one_form(t))]
    want = sorted((i, j) for (i, a, fa), (j, b, fb) in itertools.combinations(seen, 2) if fa == fb and a != b)
    assert got == want and len(want) == 8
    assert sorted((r.doc_id_a, r.doc_id_b) for r in L.lookalike_pairs(df.unionByName(df)).collect()) == want
    assert L.lookalike_pairs(df.limit(0)).count() == 0


def test_classes_and_forms(spark):
    texts, df = documents(spark)
    classes = {r.doc_id: (r.class_id, r.spellings) for r in L.lookalike_classes(df).collect()}
    assert classes == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (0, 3), 12: (0, 3), 4: (4, 1), 5: (5, 1), 10: (10, 2), 11: (10, 2)}
    forms = {r.doc_id: r.form for r in L.unify_corpus(df).collect()}
    assert forms == {i: None if t is None else L.one_form(t) for i, t in enumerate(texts)}
