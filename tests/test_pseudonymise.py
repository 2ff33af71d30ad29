import random
import timeit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import audit
from maskwright.operators import catalogue as C
from maskwright.operators.replace import Keys, apply_map, apply_pairs, apply_to_documents, pseudonymise, replaced, surroundings
from maskwright.operators.reidentify import codes_in, reidentify_records, reidentify_texts

SALT = "00112233445566778899aabbccddeeff"
PEOPLE = [
    (0, "Johnathan Doe", "PATIENT", "the case", ["Johnathan", ""]),
    (1, "Dr. Sarah Adams", "DOCTOR", "treats Johnathan", ["Sarah Adams", "Dr. Sarah"]),
    (2, "Jane Doe", "RELATIVE", "wife", ["Jane"]),
    (3, "Cape Town Medical Center", "FACILITY", "", []),
]


@pytest.fixture
def named(spark):
    return C.with_pseudonym(spark.createDataFrame(PEOPLE, C.ENTITIES), C.salt_frame(spark, SALT))


def test_golden_pseudonyms(named):
    got = {r.canonical_name: r.pseudonym for r in named.collect()}
    assert got == {"Johnathan Doe": "PATIENT_9E55E68B", "Dr. Sarah Adams": "DOCTOR_3DE9B2E4", "Jane Doe": "RELATIVE_6D7DF0EB", "Cape Town Medical Center": "FACILITY_A4CB0AC1"}


def test_salt_stays_out_of_plans(spark, named):
    assert SALT not in named._jdf.queryExecution().toString()


def test_white_space_around_names_does_not_matter(spark):
    rows = [(i, f"{a}Jane Doe{b}", "relative ", None, []) for i, (a, b) in enumerate([("", ""), (" ", "\t"), ("\n", "\x1c"), (" \x85", " ")])]
    found = C.with_pseudonym(spark.createDataFrame(rows, C.ENTITIES), C.salt_frame(spark, SALT))
    assert {r.pseudonym for r in found.collect()} == {"RELATIVE_6D7DF0EB"}


def test_key_order_is_longest_first_then_first_found(named):
    pairs = C.ordered_pairs(C.replacement_map(named)).first().pairs
    assert [p.k for p in pairs] == ["Cape Town Medical Center", "Dr. Sarah Adams", "Johnathan Doe", "Sarah Adams", "Johnathan", "Dr. Sarah", "Jane Doe", "Jane"]


def test_repeated_keys_keep_the_first_place_and_take_the_last_value(spark):
    rows = [(0, "A B", "P", "", ["x1", "shared"]), (1, "C D", "Q", "", ["shared", "x2"]), (2, "a b", "P", "later", ["other"])]
    named = C.with_pseudonym(spark.createDataFrame(rows, C.ENTITIES), C.salt_frame(spark, SALT))
    mapping = {r.k: r for r in C.replacement_map(named).collect()}
    assert (mapping["shared"].ord, mapping["shared"].place, mapping["shared"].v[0]) == (0, 1, "Q")
    catalogue = {r.pseudonym[0]: r for r in C.identity_catalogue(named).collect()}
    assert (catalogue["P"].ord, catalogue["P"].canonical_name, catalogue["P"].variations) == (0, "a b", ["other"])


def _pairs(spark, pairs):
    rows = [(k, v, i, 0) for i, (k, v) in enumerate(pairs)]
    return C.ordered_pairs(spark.createDataFrame(rows, "k string, v string, ord long, place int"))


@pytest.mark.parametrize(
    ("pairs", "text", "want"),
    [
        ([("BCD", "<2>"), ("AB", "<1>")], "ABCD", "A<2>"),
        ([("Dr. Eden", "DOCTOR_ED12AB34"), ("ED", "PATIENT_00000000")], "Dr. Eden", "DOCTOR_PATIENT_0000000012AB34"),
        ([("Jane", "R_1")], "Janet jane", "R_1t jane"),
        ([("a.c", "X"), ("", "Y")], "abc a.c", "abc X"),
        ([("é", "e")], None, None),
    ],
)
@pytest.mark.parametrize("form", [{}, {"switch": 0}])
def test_replacement_rules(spark, pairs, text, want, form):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert apply_pairs(df, _pairs(spark, pairs), ["t"], **form).first().t == want
    mapping = spark.createDataFrame([(k, v, i, 0) for i, (k, v) in enumerate(pairs)], "k string, v string, ord long, place int")
    assert apply_map(df, mapping, ["t"], most=1).first().t == want


def test_an_empty_map_changes_nothing(spark):
    df = spark.createDataFrame([("x",)], "t string")
    empty = C.ordered_pairs(spark.createDataFrame([], "k string, v string, ord long, place int"))
    assert apply_pairs(df, empty, ["t"]).first().t == "x"


def test_a_map_over_the_bound_is_an_error(spark):
    with pytest.raises(C.MapTooLarge):
        C.ordered_pairs(spark.createDataFrame([("a", "b", 0, 0), ("c", "d", 1, 0)], "k string, v string, ord long, place int"), most=1)


def fold(text, pairs):
    for k, v in pairs:
        text = text.replace(k, v)
    return text


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.text("abA", min_size=1, max_size=4), st.text("abAX", max_size=4)), max_size=8, unique_by=lambda p: p[0]), st.text("abA ", max_size=30))
def test_replacement_is_the_plain_fold_with_seams_and_cascades(pairs, text):
    pairs = sorted(pairs, key=lambda p: -len(p[0]))
    assert replaced(text, Keys(pairs)) == fold(text, pairs)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=20), st.text("ab", min_size=1, max_size=2), st.text("xy", max_size=3), st.integers(0, 4))
def test_surroundings_hold_all_that_is_new(text, key, value, reach):
    parts = text.split(key)
    new = value.join(parts)
    windows = list(surroundings(new, parts, value, reach))
    at = 0
    for part in parts[:-1]:
        at += len(part)
        assert any(new[max(0, at - reach) : at + len(value) + reach] in w for w in windows)
        at += len(value)
    assert sum(map(len, windows)) <= len(new)


def test_absent_keys_cost_no_passes():
    text = "nothing of it is here " * 200
    few, many = Keys([("here", "x")]), Keys([("here", "x"), *((f"absent{i}", "y") for i in range(50_000))])
    took = lambda keys: min(timeit.repeat(lambda: replaced(text, keys), number=20, repeat=3))
    assert took(many) < 20 * took(few)


def test_rounds_find_keys_that_come_up(spark):
    """Maps in parts, with chains in which each replacement brings the next key, within texts and at seams."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    for _ in range(3):
        pairs = sorted({word(4): word(4) for _ in range(9)}.items(), key=lambda p: -len(p[0]))
        texts = [(i, word(12), word(6) if i % 5 else None, "kept") for i in range(60)]
        df = spark.createDataFrame(texts, "id int, t string, u string, _pairs string")
        mapping = spark.createDataFrame([(k, v, i, 0) for i, (k, v) in enumerate(pairs)], "k string, v string, ord long, place int")
        got = {r.id: (r.t, r.u, r._pairs) for r in apply_map(df, mapping, ["t", "u"], most=3).collect()}
        assert got == {i: (fold(t, pairs), u and fold(u, pairs), x) for i, t, u, x in texts}
    assert apply_map(df.where("false"), mapping, ["t"], most=3).count() == 0


def test_expression_and_python_agree_on_many_texts(spark):
    pairs = _pairs(spark, [("ab", "<1>"), ("b", "2"), ("abc", "ab"), ("<1>", "!")])
    texts = spark.createDataFrame([("".join(c),) for c in __import__("itertools").product("abc<", repeat=4)], "t string")
    a = texts.transform(lambda d: apply_pairs(d, pairs, ["t"])).collect()
    b = texts.transform(lambda d: apply_pairs(d, pairs, ["t"], switch=0)).collect()
    assert a == b


def test_document_mode_renames_fields_and_breaks_loudly(spark):
    df = spark.createDataFrame([(("Al", "hi Al"),)], "r struct<speaker:string,text:string>")
    schema = df.schema["r"].dataType
    got = apply_to_documents(df, _pairs(spark, [("Al", "P_1")]), "r", schema).first().r
    assert (got.speaker, got.text) == ("P_1", "hi P_1")
    assert apply_to_documents(df, _pairs(spark, [("speaker", "P_1")]), "r", schema).first().r.speaker is None
    broken = spark.createDataFrame([(("Al", "line\nline"),)], "r struct<speaker:string,text:string>")
    with pytest.raises(Exception, match="(?i)malformed"):
        apply_to_documents(broken, _pairs(spark, [("n", "\\x")]), "r", schema).collect()


def test_round_trip_and_audits(spark, named):
    texts = spark.createDataFrame([(1, "Johnathan met Dr. Sarah Adams; Jane Doe waited at Cape Town Medical Center.")], "id int, t string")
    done, catalogue, mapping = pseudonymise(texts, ["t"], spark.createDataFrame(PEOPLE, C.ENTITIES), C.salt_frame(spark, SALT))
    assert audit.leaks(done, "t", mapping).count() == 0
    assert audit.missing_pseudonyms(done, "t", catalogue).count() == 0
    assert {r.key for r in audit.leaks(texts, "t", mapping).collect()} >= {"Johnathan", "Jane"}
    back = reidentify_texts(done, "t", catalogue)
    assert back.first().t == "Johnathan Doe met Dr. Sarah Adams; Jane Doe waited at Cape Town Medical Center."
    assert audit.unrestored_names(back, "t", catalogue).count() == 0
    assert audit.residual_pseudonyms(back, "t", catalogue).count() == 0
    legend = {r.pseudonym: r.relationship_context for r in audit.safe_legend(catalogue, mapping).collect()}
    assert "Johnathan" not in "".join(legend.values())


def test_type_suffixes_confuse_reports_in_catalogue_order(spark):
    catalogue = spark.createDataFrame([(0, "PATIENT_AA11BB22", "Jo Doe"), (1, "OUTPATIENT_AA11BB22", "Jo Doe")], "ord long, pseudonym string, canonical_name string")
    text = spark.createDataFrame([("OUTPATIENT_AA11BB22",)], "t string")
    assert reidentify_texts(text, "t", catalogue).first().t == "OUTJo Doe"
    kinds = spark.createDataFrame([("patient",), (" OUTPATIENT",)], "entity_type string")
    assert [tuple(r) for r in C.suffix_types(kinds).collect()] == [("OUTPATIENT", "PATIENT")]


def test_names_that_break_json_are_errors(spark):
    catalogue = spark.createDataFrame([(0, "P_1", 'Jo "J" Doe')], "ord long, pseudonym string, canonical_name string")
    df = spark.createDataFrame([(("P_1",),)], "r struct<t:string>")
    with pytest.raises(Exception, match="(?i)malformed"):
        reidentify_records(df, "r", catalogue, df.schema["r"].dataType).collect()


def test_collisions_and_cascading_keys(spark):
    named = spark.createDataFrame([("P_1", "A"), ("P_1", " a"), ("P_2", "B"), ("P_2", "C")], "pseudonym string, canonical_name string")
    assert [tuple(r) for r in C.collisions(named).collect()] == [("P_2", 2)]
    mapping = spark.createDataFrame([("ED", "PATIENT_0"), ("Eden", "DOCTOR_ED1"), ("T", "X")], "k string, v string")
    assert {tuple(r) for r in C.keys_in_pseudonyms(mapping).collect()} == {("ED", "DOCTOR_ED1"), ("T", "PATIENT_0"), ("T", "DOCTOR_ED1")}


@pytest.mark.parametrize("before", [0, 3, 4, 15, 28, 30])
def test_banner(spark, before):
    from maskwright.operators.chronology import BANNER

    text = "x\n" * before + BANNER + "  body\nmore \n"
    row = spark.createDataFrame([(text,)], "t string").select(X.without_banner(F.col("t")).alias("a"), X.without_banner_block(F.col("t")).alias("b")).first()
    assert row.b == "body\nmore"
    if before <= 3:
        assert row.a == "body\nmore"
    if before >= 30:
        assert row.a == text
    plain = spark.createDataFrame([("=" * 80 + "\nno mark",)], "t string")
    assert plain.select(X.without_banner(F.col("t"))).first()[0] == "=" * 80 + "\nno mark"


def test_names_of_files_and_routes(spark):
    rows = [("/a/Report.PDF",), ("/a/.hidden",), ("/a/x.tar.gz",), ("/a/noext",), ("/a/deidentified_b.docx",)]
    p = F.col("p")
    got = spark.createDataFrame(rows, "p string").select(X.extension(p), X.is_input(p), X.reidentified_name(p), X.route(p), X.stem(p)).collect()
    assert [r[0] for r in got] == [".pdf", "", ".gz", "", ".docx"]
    assert [r[1] for r in got] == [True, False, True, True, True]
    assert got[4][2] == "reidentified_b.docx"
    assert [r[3] for r in got] == ["document", "unsupported", "unsupported", "unsupported", "docx"]
    assert [r[4] for r in got] == ["Report", ".hidden", "x.tar", "noext", "deidentified_b"]


def test_codes_are_read_with_every_length_of_type():
    assert list(codes_in("OUTPATIENT_AA11BB22", [1, 7, 10, 11])) == ["T_AA11BB22", "PATIENT_AA11BB22", "OUTPATIENT_AA11BB22"]
    assert list(codes_in("X_00000000_11111111 _ab", [1, 10])) == ["X_00000000", "0_11111111", "X_00000000_11111111"]


def test_joined_codes_follow_the_catalogue_s_order(spark):
    rows = [(0, "PATIENT_AA11BB22", "Jo Doe"), (1, "OUTPATIENT_AA11BB22", "Jo Doe"), (2, "DOCTOR_00000001", "PATIENT"), (3, "NURSE_00000002", "see NURSE_00000003"), (4, "NURSE_00000003", "Ann"), (5, "odd code", "odd name")]
    catalogue = spark.createDataFrame(rows, "ord long, pseudonym string, canonical_name string")
    texts = ["OUTPATIENT_AA11BB22", "PATIENT_AA11BB22 and NURSE_00000002", "DOCTOR_00000001_AA11BB22", "odd code NURSE_00000003", "", None, "NURSE_99999999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    want = {r.id: r.t for r in reidentify_texts(df, "t", catalogue).collect()}
    assert {r.id: r.t for r in reidentify_texts(df, "t", catalogue, most=1).collect()} == want
    assert want[0] == "OUTJo Doe"
    assert want[1] == "Jo Doe and see Ann"


def test_a_million_people_come_back_and_are_audited(spark):
    people = spark.range(1_000_001).select(F.col("id").alias("ord"), F.concat(F.lit("person "), "id").alias("canonical_name"), F.lit("PATIENT").alias("entity_type"), F.lit("").alias("relationship_context"), F.array().cast("array<string>").alias("variations"))
    named = C.with_pseudonym(people, C.salt_frame(spark, SALT))
    catalogue = C.identity_catalogue(named)
    some = named.where("ord % 50000 = 7").select("ord", F.concat(F.lit("met "), "pseudonym", F.lit(", then PATIENT_"), F.lit("ZZ")).alias("t"))
    back = {r.ord: r.t for r in reidentify_texts(some, "t", catalogue).collect()}
    assert len(back) == 20
    assert back[50007] == "met person 50007, then PATIENT_ZZ"
    leaky = some.select(F.when(F.col("ord") == 7, F.concat("t", F.lit(" person 123456"))).otherwise(F.col("t")).alias("t"))
    found = audit.shared_leaks(leaky, "t", C.replacement_map(named), catalogue).collect()
    assert {r.key for r in found} == {"person 123456", "person 12345", "person 1234", "person 123", "person 12", "person 1"}
