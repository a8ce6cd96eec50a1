from __future__ import annotations

from factloom.llm.encode import encode, encoder, vocabulary_path


def test_long_texts_of_one_id_or_none(spark):
    a, b = "one two three " * 6, "four five " * 8
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b), (None, b), (2, "x")]
    want = sorted((i is None, i or 0, encoder(vocabulary_path()).direct(t)) for i, t in rows)
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    got = encode(df, "id", "text", leaf=10).collect()
    assert sorted((r["id"] is None, r["id"] or 0, list(r["ids"])) for r in got) == want
