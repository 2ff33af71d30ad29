import random

from pyspark.sql import functions as F

from maskwright.operators import catalogue as C
from maskwright.operators.incremental import Ledger
from maskwright.operators.replace import apply_map

SALT = "00112233445566778899aabbccddeeff"


def test_two_runs_are_one_run_and_few_texts_are_done_again(spark, tmp_path):
    """Entities that come again with other variations, keys that only come up at seams, and a key longer than what was kept."""
    random.seed(6)
    words = [f"word{i}" for i in range(200)]
    texts = [(i, " ".join(random.choices(words, k=12)) + (" Ann" if i % 10 == 0 else "") + (" Zed" if i % 40 == 3 else "")) for i in range(120)]
    texts += [(200, "Ann9 and more"), (201, None), (202, ""), (203, "xAnny"), (204, "nothing here")]
    salt = C.salt_frame(spark, SALT)
    code = C.with_pseudonym(spark.createDataFrame([(0, "Ann Lee", "P", "", [])], C.ENTITIES), salt).first().pseudonym
    first = [(0, "Ann Lee", "P", "", ["Ann"]), (1, "Bo", "Q", "", ["word7"])]
    # The second run's keys: a new name, one that only stands where a code meets the text after it, and word7 with another value.
    later = [(0, "Zed", "P", "", []), (1, "Seam", "S", "", [code[-1] + "9"]), (2, "Other", "R", "", ["word7"])]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    frame = spark.createDataFrame(texts, "id long, text string")
    assert ledger.add(frame.where("id < 100 or id >= 200"), spark.createDataFrame(first, C.ENTITIES), salt) == 0
    redone = ledger.add(frame.where("id >= 100 and id < 200"), spark.createDataFrame(later, C.ENTITIES), salt)
    changed = {i for i, t in texts if t and (i < 100 or i >= 200) and ("Zed" in t or "word7" in t or "Ann9" in t or code[-1] + "9" in t)}
    assert redone == len(changed) < 60
    every = spark.createDataFrame(first + [(o + 2, *rest) for o, *rest in later], C.ENTITIES)
    want = {r.id: r.text for r in apply_map(frame, C.replacement_map(C.with_pseudonym(every, salt)), ["text"]).collect()}
    assert {r.id: r.text for r in ledger.texts().collect()} == want
    assert want[200] == code[:-1] + C.with_pseudonym(every, salt).where("canonical_name = 'Seam'").first().pseudonym + " and more"
    assert {tuple(r) for r in ledger.catalogue(salt).drop("variations").collect()} == {tuple(r) for r in C.identity_catalogue(C.with_pseudonym(every, salt)).drop("variations").collect()}
    # A key longer than what was kept around codes: texts with codes are done again, the others are not.
    long = "y" * 300
    again = ledger.add(frame.where("false"), spark.createDataFrame([(0, long, "L", "", [])], C.ENTITIES), salt)
    assert again == ledger._all("replaced").where("version < 3").groupBy("id").agg(F.max_by(F.size("windows"), "version").alias("n")).where("n > 0").count()
    assert {r.id: r.text for r in ledger.texts().collect()} == want


def test_a_run_that_died_leaves_the_ledger_as_it_was(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    salt = C.salt_frame(spark, SALT)
    people = spark.createDataFrame([(0, "Ann", "P", "", [])], C.ENTITIES)
    ledger.add(spark.createDataFrame([(1, "Ann")], "id long, text string"), people, salt)
    spark.createDataFrame([(2, "left over")], "id long, text string").write.parquet(f"{tmp_path}/ledger/000002/texts")
    assert ledger.texts().count() == 1
    ledger.add(spark.createDataFrame([(3, "Ann")], "id long, text string"), people.where("false"), salt)
    assert {r.id for r in ledger.texts().collect()} == {1, 3}
