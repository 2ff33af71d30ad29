import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.operators import audit, chronology, pages
from maskwright.operators import catalogue as C
from maskwright.operators.discovery import AgentOptions, RegexGazetteer, RuleCataloguer, StrictCataloguer, SuppliedEntities
from maskwright.operators.docx import docx_rewritten, docx_text, raw_docx, read_docx, replace_in_runs, rewrite_docx
from maskwright.operators.reidentify import reidentify_json
from maskwright.operators.replace import Keys
from maskwright.plans import catalogue, pipeline
from maskwright.plans.catalogue import docx_file
from maskwright.sources import files


MAP = "k string, v string, ord long, place int"


def plain_runs(runs, pairs):
    """Every key tried on every run, then on all runs together, character by character with the run that each stands in."""
    runs, made = list(runs), 0
    for i in range(len(runs)):
        for k, v in pairs:
            made += k in runs[i]
            runs[i] = runs[i].replace(k, v)
    held = [(c, i) for i, run in enumerate(runs) for c in run]
    for k, v in pairs:
        at = 0
        while (at := "".join(c for c, _ in held).find(k, at)) >= 0:
            first, last = held[at][1], held[at + len(k) - 1][1]
            rest = [(c, first if i == last else i) for c, i in held[at + len(k) :]]
            held = held[:at] + [(c, first) for c in v] + rest
            at += len(v)
            made += 1
    return ["".join(c for c, j in held if j == i) for i in range(len(runs))], made


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text("abc", max_size=4), max_size=6), st.lists(st.tuples(st.text("abc", min_size=1, max_size=3), st.text("abX", max_size=3)), max_size=6, unique_by=lambda p: p[0]))
def test_runs_are_those_of_trying_every_key(runs, pairs):
    pairs = sorted(pairs, key=lambda p: -len(p[0]))
    assert replace_in_runs(runs, Keys(pairs)) == plain_runs(runs, pairs)


def test_documents_meet_maps_of_any_size(spark):
    """A map in parts is cut down to the keys that the files have, and to one that editing brings up."""
    files_ = spark.createDataFrame([("a", bytearray(docx_file([["Ja", "ne met Bo"]], ["Bo"], "Jane"))), ("b", bytearray(b"no zip"))], "path string, content binary")
    rows = [("Jane", "QX", 0, 0), ("Bo", "P_2", 1, 0), ("QX", "R", 2, 0), *((f"absent {i}", "Z", i + 3, 0) for i in range(20))]
    mapping = spark.createDataFrame(rows, MAP)
    whole = {r.path: r for r in docx_rewritten(files_, mapping).collect()}
    parts = {r.path: r for r in docx_rewritten(files_, mapping, most=5).collect()}
    assert read_docx(bytes(parts["a"].content)) == read_docx(bytes(whole["a"].content)) == "R met P_2\nP_2"
    assert parts["b"].error
    with pytest.raises(C.MapTooLarge):
        docx_rewritten(files_, mapping, most=2)


def test_runs_inside_and_across():
    assert replace_in_runs(["Jane and Jane"], Keys([("Jane", "R_1")])) == (["R_1 and R_1"], 1)
    assert replace_in_runs(["Ja", "n", "e Doe!", " x"], Keys([("Jane Doe", "R_1")])) == (["R_1!", "", "", " x"], 1)
    runs, n = replace_in_runs(["Ja", "ne, Ja", "ne"], Keys([("Jane", "R_1")]))
    assert ("".join(runs), n) == ("R_1, R_1", 2)
    runs, n = replace_in_runs(["Ja", "ne, Ja", "ne"], Keys([("Jane", "R_1")]), all_crossing=False)
    assert ("".join(runs), n) == ("R_1, Jane", 1)
    assert replace_in_runs(["a", "b"], Keys([("ab", "abab")])) == (["abab", ""], 1)
    assert replace_in_runs([], Keys([("x", "y")])) == ([], 0)


def test_docx_is_read_and_rewritten():
    data = docx_file([["Hello ", "Ja", "ne"], ["& <b>"]], ["cell Jane", "two"], "head Jane")
    assert read_docx(data) == "Hello Jane\n& <b>\ncell Jane\ntwo"
    new, n = rewrite_docx(data, Keys([("Jane", "R_1")]))
    assert n == 3
    assert read_docx(new) == "Hello R_1\n& <b>\ncell R_1\ntwo"
    assert "Jane" not in raw_docx(new)
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert b"R_1" in z.read("word/header1.xml")


def test_broken_docx_is_read_raw_and_not_passed_on(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:p>Jane<br>  Doe")
    assert read_docx(out.getvalue()) == "Jane Doe"
    df = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"no zip"))], "path string, content binary")
    assert [r.text for r in docx_text(df).orderBy("path").collect()] == ["Jane Doe", None]
    for row in docx_rewritten(df, spark.createDataFrame([("Jane", "R", 0, 0)], MAP)).collect():
        assert row.content is None
        assert row.error


def test_styles_and_outcomes(spark):
    hits = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 0.0, 0.0, 1.0, 1.0)], "page int, hit int, hit_x0 double, hit_y0 double, hit_x1 double, hit_y1 double")
    spans = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 10.0, "A-Bold", 9.0, 255), (1, 1, 5.0, 0.0, 10.0, 10.0, "B", 9.0, 0), (1, 2, 10.0, 0.0, 20.0, 10.0, "C", 9.0, 0)], "page int, ord int, span_x0 double, span_y0 double, span_x1 double, span_y1 double, font string, size double, color int")
    got = {r.page: r for r in pages.best_styles(hits, spans).collect()}
    assert (got[1].font, got[1].base_font, got[1].color.b, got[1].color.r) == ("A-Bold", "hebo", 1.0, 0.0)
    assert (got[2].font, got[2].size) == ("helv", 11.0)
    row = spark.range(1).select(pages.outcome(F.lit(True), F.lit(False), F.lit(0))).first()
    assert row[0] == "withheld"


def test_agent_options():
    assert AgentOptions.resolve(env={}).backend == "supplied"
    assert AgentOptions.resolve("Ollama ", env={"OLLAMA_MODEL": "m"}).model == "m"
    with pytest.raises(ValueError, match="unknown"):
        AgentOptions.resolve(env={"AGENT_BACKEND": "mock"})
    with pytest.raises(ValueError, match="key"):
        AgentOptions.resolve("gemini", env={})


def test_gazetteer_finds_names_and_patterns(spark):
    texts = spark.createDataFrame([("write to a.b@c.org or call Jane",)], "t string")
    names = spark.createDataFrame([("Jane", "RELATIVE"), ("Bob", "X")], "name string, entity_type string")
    found = RegexGazetteer({"EMAIL": r"[a-z.]+@[a-z.]+"}, names).discover(texts, "t").collect()
    assert {(r.entity_type, r.canonical_name) for r in found} == {("EMAIL", "a.b@c.org"), ("RELATIVE", "Jane")}


def test_salt_is_made_once(spark, tmp_path):
    first = files.salt(spark, str(tmp_path)).first().salt
    assert len(first) == 32
    assert files.salt(spark, str(tmp_path)).first().salt == first


def test_files_are_never_overwritten(spark, tmp_path):
    files.write_pretty_json(spark, str(tmp_path / "a.json"), {"é": 1})
    assert (tmp_path / "a.json").read_text() == '{\n  "é": 1\n}'
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_text(spark, str(tmp_path / "a.json"), "other")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_text_that_is_not_utf8_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_texts(spark, str(tmp_path)).collect()


def test_unify_orders_undated_events_last(spark):
    rows = [("c", 0, "Intake Day", "x", "b", None, "u"), ("c", 1, "2026-05-27 10:00:00", "x", "a", "S", "v"), ("c", 2, "2026-05-26 10:00:00", "y", "a", "S", None)]
    events = spark.createDataFrame(rows, "chronology string, ord long, timestamp string, category string, source_file string, speaker string, event_details string")
    got = chronology.numbered(chronology.unify([events])).orderBy("number").collect()
    assert [r.ord for r in got] == [2, 1, 0]
    heads = spark.createDataFrame([("c", "sum", ["x", "y"]), ("d", "", None)], "chronology string, patient_summary string, categories_found array<string>")
    reports = {r.chronology: r.report for r in chronology.whole(chronology.transcription(heads, chronology.unify([events]))).collect()}
    assert "[3] Intake Day  |  Speaker: Unknown  |  Category: x\nu\n" in reports["c"]
    assert reports["d"].endswith("CHRONOLOGICAL EVENTS\n" + "-" * 72 + "\n\n")


def test_whole_run_and_back(spark, tmp_path):
    folders = {n: tmp_path / n for n in ("in", "secure", "out", "returned", "back")}
    folders["in"].mkdir()
    (folders["in"] / "session.txt").write_text("Dr. Adams: Jane Doe came at ten.\nJane: I slept badly.\n")
    (folders["in"] / "note.docx").write_bytes(docx_file([["Ja", "ne Doe is tired"]]))
    (folders["in"] / ".hidden").write_text("Jane")
    (folders["in"] / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0 an old kind of file")
    (folders["in"] / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (folders["in"] / "x.odd").write_bytes(b"?")
    (folders["in"] / "plan.yaml").write_text("who: Jane Doe\n")
    entities = spark.createDataFrame([(0, "Jane Doe", "PATIENT", "the case", ["Jane"]), (1, "Dr. Adams", "DOCTOR", "treats Jane", ["Adams"])], C.ENTITIES)
    paths = {k: str(v) for k, v in folders.items()}
    run = pipeline.deidentify(spark, paths["in"], paths["secure"], paths["out"], SuppliedEntities(entities), summary="Jane Doe sleeps badly")
    report = chronology.whole(run.transcriptions).first().report
    summary = chronology.whole(run.summaries).first().report
    for name, text in (("deidentified_transcription.txt", report), ("synthesis_summary.txt", summary)):
        assert "".join(f.read_text() for f in sorted((folders["out"] / name / "chronology=case").glob("part-*.txt"))) == text
    assert {r.path.rpartition("/")[2]: r.reason for r in run.unread.collect()} == {"old.doc": "it is not a ZIP file", "bad.txt": "its bytes are not UTF-8", "x.odd": "its kind is not known"}
    assert "Jane" not in report + summary
    assert "Adams" not in report + summary
    edited = spark.read.parquet(f"{paths['out']}/documents").collect()
    assert len(edited) == 1
    assert "Jane" not in read_docx(bytes(edited[0].content))
    folders["returned"].mkdir()
    (folders["returned"] / "deidentified_report.txt").write_text("Forwarded\n\n\n\n\n" + summary)
    (folders["returned"] / "deidentified_note.docx").write_bytes(bytes(edited[0].content))
    code = run.catalogue.where("entity_type = 'PATIENT'").first().pseudonym
    (folders["returned"] / "deidentified_b = c.json").write_text(json.dumps({"who": code}, indent=2))
    pipeline.reidentify(spark, paths["returned"], paths["secure"], paths["back"])
    text = (folders["back"] / "reidentified_files" / "reidentified_report.txt").read_text()
    assert text.startswith("PATIENT SYNTHESIS SUMMARY:\nJane Doe sleeps badly")
    assert json.loads((folders["back"] / "reidentified_files" / "reidentified_b = c.json").read_text()) == {"who": "Jane Doe"}
    with pytest.raises(ValueError, match="several"):
        files.write_texts(spark.createDataFrame([("a", "x"), ("a", "y")], "name string, text string"), str(tmp_path / "names"))
    docs = spark.read.parquet(f"{paths['back']}/reidentified_documents").collect()
    assert read_docx(bytes(docs[0].content)) == "Jane Doe is tired"
    (folders["returned"] / "x.pdf").write_bytes(b"%PDF")
    with pytest.raises(files.Unsupported):
        pipeline.reidentify(spark, paths["returned"], paths["secure"], paths["back"] + "2")
    with pytest.raises(ValueError, match="two folders"):
        pipeline.deidentify(spark, paths["in"], paths["out"], paths["out"], SuppliedEntities(entities))


def test_docx_queries_hold_every_word_of_a_turn(spark, tmp_path):
    words = [f"word{i}" for i in range(1000)]
    spark.createDataFrame([(1, 2, " ".join(words))], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for query in (catalogue.docx_extract, catalogue.docx_rewrite):
        assert query(spark, str(tmp_path)).first().text.split() == words


def test_leaks_in_documents_and_other_columns_stop_a_run(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "session.txt").write_text("Ed: fine\n")
    (folder / "note.docx").write_bytes(docx_file([["Ed is here"]]))
    entities = spark.createDataFrame([(0, "Ed", "DOCTOR", "", ["ED"])], C.ENTITIES)
    ok = pipeline.deidentify(spark, str(folder), str(tmp_path / "s1"), str(tmp_path / "o1"), SuppliedEntities(entities))
    assert ok.edited.count() == 1
    assert list((tmp_path / "o1" / "synthesis_summary.txt").glob("chronology=case/*.txt"))
    # A document that keeps a name is a leak, though the chronology has none.
    monkeypatch.setattr(pipeline, "docx_rewritten", lambda files, pairs: files.select("path", "content").withColumn("n_replaced", F.lit(0)).withColumn("error", F.lit(None).cast("string")))
    with pytest.raises(pipeline.LeakFound):
        pipeline.deidentify(spark, str(folder), str(tmp_path / "s2"), str(tmp_path / "o2"), SuppliedEntities(entities))
    assert not (tmp_path / "o2").exists()


def test_keys_beside_pseudonyms_are_leaks_and_inside_are_not(spark):
    catalogue_ = spark.createDataFrame([("DOCTOR_ED00ED00", 0), ("PATIENT_11", 1)], "pseudonym string, ord long")
    mapping = spark.createDataFrame([("ED", "DOCTOR_ED00ED00"), ("TIE", "PATIENT_11"), ("Jo", "PATIENT_11")], "k string, v string")
    texts = spark.createDataFrame([("DOCTOR_ED00ED00 met PATIENT_11",), ("ED met DOCTOR_ED00ED00ED",), (None,), ("",)], "text string")
    got = {r.key: (r.n_texts, r.n_hits) for r in audit.shared_leaks(texts, "text", mapping, catalogue_).collect()}
    assert got == {"ED": (1, 2)}
    parts = {r.key: (r.n_texts, r.n_hits) for r in audit.key_hits(texts, "text", mapping, "k", most=1).collect()}
    assert parts == {r.key: (r.n_texts, r.n_hits) for r in audit.key_hits(texts, "text", mapping, "k").collect()}
    assert parts == {"ED": (2, 6), "TIE": (1, 1), "Jo": (0, 0)}


def test_json_texts_get_names_with_quotes_and_stay_json(spark):
    catalogue_ = spark.createDataFrame([("PATIENT_11", 'Jo "the \\ fox" é', 0)], "pseudonym string, canonical_name string, ord long")
    texts = spark.createDataFrame([('{"who": "PATIENT_11", "n": [1, {"x": null}]}',), (None,)], "text string")
    done = [r.text for r in reidentify_json(texts, "text", catalogue_).collect()]
    assert json.loads(done[0]) == {"who": 'Jo "the \\ fox" é', "n": [1, {"x": None}]}
    assert done[1] is None
    with pytest.raises(Exception, match="not JSON"):
        reidentify_json(spark.createDataFrame([("{broken",)], "text string"), "text", catalogue_).collect()


def test_rules_give_categories(spark):
    events = spark.createDataFrame([("c", 0, "t", "transcript", "a.txt", s, d) for s, d in (("System", "Date of birth: 1"), ("Nurse", "blood pressure is fine"), ("Visual Action", "she"), ("Jo", "I slept"), (None, None))], "chronology string, ord long, timestamp string, category string, source_file string, speaker string, event_details string")
    got = [r.category for r in RuleCataloguer().catalogue([events]).orderBy("event_details").collect()]
    assert sorted(got) == ["Clinical Interview", "Clinical Interview", "Intake Form", "Physical Assessment", "Subject Activity"]


def test_outer_hits_over_lines(spark):
    """A hit that another contains goes, whatever line it begins on; of equal ones the longest key's stays."""
    rows = [(1, 0, "long key", 0, 0, 10, 10), (1, 1, "key", 2, 3, 5, 6), (1, 2, "key", 8, 8, 12, 9), (1, 3, "a", 20, 0, 22, 1), (1, 4, "ab", 20, 0, 22, 1), (2, 5, "key", 2, 3, 5, 6)]
    hits = spark.createDataFrame(rows, "page int, hit int, k string, hit_x0 int, hit_y0 int, hit_x1 int, hit_y1 int")
    assert {r.hit for r in pages.outer_hits(hits).collect()} == {0, 2, 4, 5}


def test_a_long_case_is_numbered_and_written_in_parts(spark, tmp_path):
    """One case over many ranges, most events alike in time: numbers without gaps, parts that make the report."""
    events = spark.range(5000).select(F.lit("case").alias("chronology"), F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "2026-01-01 10:00:00").otherwise("x").alias("timestamp"), F.lit("k").alias("category"), F.lit("f").alias("source_file"), F.lit("s").alias("speaker"), F.concat(F.lit("e"), "id").alias("event_details")).repartition(7)
    heads = spark.createDataFrame([("case", "s", ["k"])], "chronology string, patient_summary string, categories_found array<string>")
    lines = chronology.timeline_report(heads, chronology.unify([events]))
    rows = lines.orderBy("number").collect()
    assert [r.number for r in rows] == list(range(5001))
    assert [r.text.split("Details:   e")[1].split("\n")[0] for r in rows[1:]] == [str(i) for i in [*range(0, 5000, 2), *range(1, 5000, 2)]]
    files.write_report(lines, str(tmp_path / "r.txt"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "r.txt" / "chronology=case").glob("part-*.txt"))) == "".join(r.text for r in rows)


def test_untimed_events_stand_where_their_source_has_them(spark):
    rows = [("a", 0, "Intake Day"), ("a", 1, "2026-05-27 10:00:00"), ("a", 2, "page 2"), ("a", 3, "page 1"), ("a", 4, "2026-05-27 12:00:00"), ("a", 5, "later"), ("b", 0, "2026-05-27 11:00:00"), ("b", 1, "then"), ("c", 0, "page 3"), ("d", 0, "2026-05-27 10:00:00"), (None, 0, None)]
    events = spark.createDataFrame([("x", o, t, "k", f, "s", None) for f, o, t in rows], "chronology string, ord long, timestamp string, category string, source_file string, speaker string, event_details string").repartition(5)
    got = [(r.source_file, r.ord) for r in chronology.numbered(StrictCataloguer().catalogue([events])).orderBy("number").collect()]
    assert got == [("a", 0), ("a", 1), ("a", 3), ("a", 2), ("d", 0), ("b", 0), ("b", 1), ("a", 4), ("a", 5), (None, 0), ("c", 0)]


def test_values_are_carried_over_ranges(spark):
    from maskwright.operators.order import ranked

    rows = [(g, i, i if i % 97 == 5 else None) for g in ("a", None, "b") for i in range(700)]
    got = ranked(spark.createDataFrame(rows, "g string, i int, v int").repartition(6), "g", ["i"], into="n", carried=("v", "last")).collect()
    assert len(got) == 2100
    assert all(r.n == r.i and r["last"] == (None if r.i < 5 else (r.i - 5) // 97 * 97 + 5) for r in got)


def test_crowded_pages_make_few_pairs(spark):
    """A page with 40,000 spans and as many hits, held against what whole rows and columns of it say."""
    n = 200
    cell = lambda name, size: [F.col("x").cast("double").alias(f"{name}_x0"), F.col("y").cast("double").alias(f"{name}_y0"), (F.col("x") + size).alias(f"{name}_x1"), (F.col("y") + size).alias(f"{name}_y1")]
    places = spark.range(n * n).select("id", (F.col("id") % n * 10).alias("x"), F.floor(F.col("id") / n).cast("long").alias("y0")).withColumn("y", F.col("y0") * 10)
    spans = places.select(F.lit(1).alias("page"), F.col("id").alias("ord"), *cell("span", 9.0), F.col("id").cast("string").alias("font"), F.lit(1.0).alias("size"), F.lit(0).alias("color"))
    hits = places.select(F.lit(1).alias("page"), F.col("id").alias("hit"), *cell("hit", 12.0))
    best = pages.best_styles(hits, spans)
    assert best.where("font <> cast(hit as string)").count() == 0
    assert best.count() == n * n
    keyed = hits.withColumn("k", F.lit("key")).union(places.where("id % 100 = 0").select(F.lit(1), F.col("id") + n * n, (F.col("x") + 1).cast("double"), (F.col("y") + 1).cast("double"), F.col("x") + 5.0, F.col("y") + 5.0, F.lit("k")))
    outer = pages.outer_hits(keyed)
    assert outer.columns == keyed.columns
    assert {r.hit for r in outer.select("hit").collect()} == set(range(n * n))


def test_pages_are_searched_with_keys_in_parts(spark):
    texts = spark.createDataFrame([("a", "no"), ("a", "has Jane"), ("b", None), ("c", "nothing"), ("d", "")], "document string, text string")
    mapping = spark.createDataFrame([("Jane",), (" ",), ("Bo",), ("x1",)], "k string")
    for most in (100, 1):
        assert {r.document: r.searchable for r in pages.searchable(texts, mapping, most=most).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_python_holds_few_rows_at_a_time():
    """Whatever the size of Spark's batches: parts of bounded size, and a batch is let go before the next one."""
    import gc
    import weakref

    import pyarrow as pa

    from maskwright.sources.batches import AT_ONCE, in_parts, lists_in_parts

    alive = []

    def batches(make):
        for _ in range(3):
            gc.collect()
            assert all(r() is None for r in alive)
            batch = make()
            alive.append(weakref.ref(batch))
            yield batch
            del batch

    values = list(range(1000))
    parts = list(in_parts(batches(lambda: pa.record_batch({"a": values, "b": [str(v) for v in values]}))))
    assert all(len(p["a"]) == len(p["b"]) <= AT_ONCE for p in parts)
    assert [v for p in parts for v in p["a"]] == values * 3
    alive.clear()
    assert [v for p in lists_in_parts(batches(lambda: pa.array(values))) for v in p] == values * 3


def test_texts_are_written_by_tasks_and_their_folder_appears_when_all_are_there(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(f"é {i}=%.txt", t) for i, t in enumerate(["a", "b\n", "c\n\n", "", None, "d\re"])], "name string, text string")
    files.write_texts(texts.limit(2), str(tmp_path / "before"))
    files.write_texts(texts.where("name not like 'é 0%' and name not like 'é 1%'"), str(tmp_path / "before"))
    with pytest.raises(FileExistsError):
        files.write_texts(texts, str(tmp_path / "before"))
    monkeypatch.setattr(files, "_write_and_move", None)
    files.write_texts(texts, str(tmp_path / "in"))
    found = {p.name: p.read_bytes() for p in (tmp_path / "in").iterdir()}
    assert found == {f"é {i}=%.txt": t for i, t in enumerate([b"a\n", b"b\n", b"c\n\n", b"\n", b"\n", b"d\re\n"])}
    assert {p.name: p.read_bytes() for p in (tmp_path / "before").iterdir() if p.name.startswith("é")} == found
    broken = texts.withColumn("text", F.when(F.col("name").contains("3"), F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        files.write_texts(broken, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        files.write_texts(texts.select(F.lit("../x").alias("name"), "text").limit(1), str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["before", "in"]


def test_a_run_opens_its_inputs_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("doctor: Ann is here\n")
    entities = spark.createDataFrame([(0, "Ann", "DOCTOR", "", ["Ann"])], C.ENTITIES)
    run = pipeline.deidentify(spark, str(tmp_path / "in"), str(tmp_path / "secure"), str(tmp_path / "out"), SuppliedEntities(entities))
    assert [bytes(r.content) for r in spark.read.parquet(str(tmp_path / "secure" / "inputs")).collect()] == [b"doctor: Ann is here\n"]
    assert "Ann" not in run.events.first().event_details
