"""What is rare must be learnt too: terms where few labels are toxic, languages that few rows have."""

import random

from pyspark.sql import functions as F

from gazette.llm import language_id, toxicity


def test_terms_of_rare_toxic_texts(spark):
    rng = random.Random(13)
    words = ["".join(rng.choices("bcdfgklmnpaeiou", k=5)) for _ in range(200)]
    rows = [(i, " ".join([*rng.choices(words, k=20), *(["zqvorn"] if i < 30 or i % 40 == 0 else [])]), int(i < 30)) for i in range(2000)]
    held = [sum("zqvorn" in t for _, t, y in rows if y == k) for k in (1, 0)]
    assert held[0] == 30 < held[1]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert any(" zqvorn ".startswith(t) for t in lexicon.weight)


def test_rare_languages_are_in_the_sample(spark):
    rows = [(i, f"text number {i}", "rare" if i < 5 else "few" if i < 40 else "common") for i in range(3000)] + [(9000, "12", "digits"), (9001, None, "none"), (9002, "x", None)]
    found = language_id.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), at_most=300)
    count = {lang: sum(x == lang for _, x in found) for lang in {x for _, x in found}}
    assert count == {"rare": 5, "few": 35, "common": 260}
