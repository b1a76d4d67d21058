"""Rare toxicity: a word of all toxic documents counts, though some others have it too."""

import random

from tapeloom.llm import toxicity


def test_word_of_rare_toxic_documents_is_learned(spark):
    r = random.Random(5)
    usual = [f"w{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(4000):
        toxic = i % 100 == 0
        words = r.choices(usual, k=30)
        if toxic or i % 100 == 1 and i < 1000:  # 40 toxic documents with the word, 10 others
            words[r.randrange(30)] = "vile"
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.token)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, model).collect()}
    hit = sum(got[i] for i, n in labels if n) / 40
    clean = sum(got[i] for i, n in labels if not n) / 3960
    assert hit > 20 * clean
