import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from maskwright.llm import decontamination, segment_sampling, toxicity

BAD = ["idiot", "moron", "scum", "trash"]


def corpus():
    random.seed(5)
    words = [f"w{random.randrange(10**6)}" for _ in range(4000)]
    docs, labels = [], []
    for i in range(240):
        text = random.choices(words, k=random.randint(60, 200))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                text[random.randrange(len(text))] = random.choice(BAD)
        docs.append((i, " ".join(text), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    item = " ".join(random.choices(words, k=30))
    docs += [(300, docs[1][1], "en", "s", 0), (301, docs[1][1].replace(docs[1][1].split()[30], "zzz"), "en", "s", 0)]
    docs += [(302, docs[2][1] + " extra " + item + " and more", "en", "s", 0), (303, "", "en", "s", 0), (304, None, None, None, None), (None, "kept without an id", "en", "s", 1)]
    return docs, labels, item


def test_stages_drop_what_they_should(spark, tmp_path):
    docs, labels, item = corpus()
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame = spark.read.parquet(f"{d}/documents.parquet")
    names = frame.columns
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, frame, d)
    assert kept.columns == names
    model = toxicity.fit(frame, spark.read.parquet(f"{d}/labels.parquet"), held_out=None)
    want = {i for (i, *_), s in zip(docs, model.score([t for _, t, *_ in docs]), strict=True) if s < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == want
    assert len([i for i in range(0, 240, 4) if i in want]) <= 2
    assert len([i for i in range(240) if i % 4 and i not in want]) <= 4

    kept = stages["near-duplicates"](spark, frame, d)
    assert kept.columns == names
    got = {r.doc_id for r in kept.collect()}
    assert got == {i for i, *_ in docs} - {300, 301, 304}

    kept = stages["decontamination"](spark, frame, d)
    assert kept.columns == names
    scanner = decontamination.Scanner([(1, item)])
    assert {r.doc_id for r in kept.collect()} == {i for i, t, *_ in docs if not scanner.scan(decontamination.folded_words(t))[0]} == {i for i, *_ in docs} - {302}

    v = segment_sampling.vocabulary(segment_sampling.default_model(), 1.0)
    texts = {i: t for i, t, *_ in docs}
    out = corpus_pipeline.run(spark, d).collect()
    assert all(v.decode(r.pieces) == (texts[r.doc_id] or "") for r in out)
    left = {r.doc_id for r in out}
    assert left & {300, 301, 302, 304} == set()
    assert {303, None} <= left
    assert corpus_pipeline.ORACLE_SQL is None
    for stage in stages.values():
        assert stage(spark, frame.where("false"), d).count() == 0


def test_stages_keep_columns_of_any_name_and_repeated_ids(spark, tmp_path):
    """Extra columns with the names that operators give their results, ids that stand on several rows, null and long texts."""
    d = str(tmp_path)
    long = " ".join(f"l{i}" for i in range(20_000))
    rows = [(1, "one text of a few words here", 7, 8.0, "a"), (1, "one text of a few words here", 7, 8.0, "a"), (2, long, 7, 8.0, "b"), (2, "another text with the same id as that", 7, 8.0, "c"), (3, None, 7, 8.0, "d"), (4, "idiot", 7, 8.0, "e")]
    schema = "doc_id long, text string, n_words int, toxicity double, hit_runs string"
    spark.createDataFrame([(i, 0, int(i == 4)) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    frame = spark.createDataFrame(rows, schema).withColumns({"component": F.lit(1), "group": F.lit(2), "rows": F.lit(3), "score": F.lit(4), "sample": F.lit(5), "pieces": F.lit(6)})
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, frame, d)
        assert kept.columns == frame.columns
        got = sorted((r.doc_id, len(r.text or ""), r.n_words, r.toxicity, r.hit_runs, r.component, r.score) for r in kept.collect())
        want = sorted((i, len(t or ""), n, x, h, 1, 4) for i, t, n, x, h in (rows if name != "near-duplicates" else rows[1:]))
        if name == "toxicity":  # four labels: whatever becomes of the one toxic text, the others stay
            got, want = ([r for r in rs if r[0] != 4] for rs in (got, want))
        assert got == want
    assert {r.doc_id for r in corpus_pipeline.encode(spark, frame, d).collect()} == {1, 2, 3, 4}
