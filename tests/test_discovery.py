import hashlib
import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.operators import catalogue as C
from maskwright.operators.discovery import RegexGazetteer, resolved
from maskwright.operators.spelling import spelled, spelled_hits

SALT = "00112233445566778899aabbccddeeff"


def entities(spark, mentions, kind="X"):
    frame = spark.createDataFrame([(m, kind, 1) for m in mentions], "name string, entity_type string, n long")
    return {r.canonical_name: r.variations for r in resolved(frame).collect()}


def test_spellings_of_one_name_are_one_entity(spark):
    got = entities(spark, ["Sarah Adams", "Sarah Adams", "Dr. Sarah Adams", "S. Adams", "SARAH ADAMS", "Dr. Adams", "Sarah", "Mr. Doe", "Mr", "", "Johnathan Doe", "J Doe", "Sister"])
    assert got == {"Sarah Adams": ["Dr. Adams", "Dr. Sarah Adams", "S. Adams", "SARAH ADAMS", "Sarah"], "Johnathan Doe": ["J Doe", "Mr. Doe"], "Mr": [], "": [], "Sister": []}


def test_what_fits_two_names_stays_alone(spark):
    got = entities(spark, ["Jane Doe", "John Doe", "J. Doe", "J Doe", "Doe", "Jane", "John Smith"])
    assert got == {"Jane Doe": ["Jane"], "John Doe": [], "J. Doe": ["J Doe"], "Doe": [], "John Smith": []}
    frame = spark.createDataFrame([("Jane Doe", "A", 1), ("Doe", "B", 1)], "name string, entity_type string, n long")
    assert {(r.entity_type, r.canonical_name) for r in resolved(frame).collect()} == {("A", "Jane Doe"), ("B", "Doe")}
    assert resolved(frame.where("false")).count() == 0


def test_discovered_names_come_with_their_variations(spark):
    texts = spark.createDataFrame([("Dr. Adams saw Jane Doe; Jane was well, said Sarah Adams of x@y.org",)], "t string")
    names = spark.createDataFrame([(n, "PERSON") for n in ("Dr. Adams", "Sarah Adams", "Jane", "Jane Doe", "Bob")], "name string, entity_type string")
    got = {r.canonical_name: r.variations for r in RegexGazetteer({"EMAIL": r"[a-z]+@[a-z.]+"}, names).discover(texts, "t").collect()}
    assert got == {"Sarah Adams": ["Dr. Adams"], "Jane Doe": ["Jane"], "x@y.org": []}


def test_codes_that_would_meet_are_longer(spark):
    rows = [(i, f"name {i % 700}", "t", None, []) for i in range(900)]
    frame = spark.createDataFrame(rows, C.ENTITIES)
    got = C.with_distinct_pseudonym(frame, C.salt_frame(spark, SALT), digits=2).collect()
    hashes = {f"name {i}": hashlib.sha256((SALT + f"name {i}").encode()).hexdigest().upper() for i in range(700)}
    assert len(got) == 900
    assert len({r.pseudonym for r in got}) == 700
    for r in got:
        own, n = hashes[r.canonical_name], 2
        while sum(h[:n] == own[:n] for h in hashes.values()) > 1:
            n += 1
        assert r.pseudonym == f"T_{own[:n]}"
    plain = {r.ord: r.pseudonym for r in C.with_pseudonym(frame, C.salt_frame(spark, SALT)).collect()}
    assert {r.ord: r.pseudonym for r in C.with_distinct_pseudonym(frame, C.salt_frame(spark, SALT)).collect()} == plain


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from('aZéßİ\u0301\u200b&;\\"n\U0001f600 '), max_size=12))
def test_escapes_are_read_back(text):
    folded = lambda t: spelled(t)[0]
    bare = text.replace("\\", "").replace("&", "").replace("\u200b", "")
    assert folded(json.dumps(bare)[1:-1]) == folded(bare)
    assert folded("".join(f"&#{ord(c)};" for c in bare)) == folded(bare)
    assert folded(unicodedata.normalize("NFD", bare)) == folded(bare)
    form, places = spelled(text)
    assert len(form) == len(places)
    assert all(0 <= a < b <= len(text) for a, b in places)


@pytest.mark.parametrize("most", [100, 1])
def test_names_are_found_in_any_spelling_where_they_stand(spark, most):
    texts = ['{"who": "Ren\\u00e9e O\\"Hara"}', "RENE\u0301E o&quot;hara!", "Zo\u200bë and Zo&euml; &bogus;", None, "", "plain Zoe", "\\ud83d\\ude00 Bo"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    names = spark.createDataFrame([('Renée O"Hara',), ("Zoë",), ("Bo",), ("",), (None,), ("BO",)], "k string")
    found = {(r.id, r.key, texts[r.id][r.place : r.place + r.length]) for r in spelled_hits(frame, F.col("i"), F.col("t"), F.col("k"), names, most).collect()}
    assert found == {(0, 'Renée O"Hara', 'Ren\\u00e9e O\\"Hara'), (1, 'Renée O"Hara', "RENE\u0301E o&quot;hara"), (2, "Zoë", "Zo\u200bë"), (2, "Zoë", "Zo&euml;"), *((i, k, x) for k in ("Bo", "BO") for i, x in ((2, "bo"), (6, "Bo")))}
