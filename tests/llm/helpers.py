"""Awkward documents that every operator must handle: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, node long"


def awkward(spark):
    rows = [
        (1, "Hello there, this is a line of text.\nAnother line that is long enough to count.", "en"),
        (2, None, None), (3, "", "en"), (None, "text of a row without an id, long enough", "en"), (4, "Hello there, this is a line of text.\nAnother line that is long enough to count.", "de"),
        (5, "x" * 200_000, "en"), (6, "word " * 30_000, "en"), (7, "é😀 ünï\u0000 \t\n\n ", "fr"), (8, "+1 (663) 555-6869 a.b@c.de 4465758382889437, 10.0.0.1", None),
        (9, "一二三四五六七八九十一二三四五六七八九十一二三四五", "zh"), (9, "一二三四五六七八九十一二三四五六七八九十一二三四五", "zh"), (10, "same id, other text, long enough", "en"), (10, "same id, third text, long enough to count", "en"),
    ]
    data = [(i, t, g, None, None if t is None else len(t), "clash", "clash", 7) for i, t, g in rows]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
