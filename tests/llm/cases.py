"""Rows that every operator over documents must stand: nulls, empty and long texts, repeated rows, ties, clashing names."""

LONG = " ".join(f"word{i % 977} runs{i % 31}" for i in range(12_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, rank string, n string, token string, taken string, component_id string, spans string, `_rank` string, bucket string"
TAIL = ("x",) * 10


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, *TAIL)


ODD = [
    row(1, None), row(2, ""), row(3, "   \n\t "), row(4, LONG), row(5, LONG + " end"), row(6, "one two three"), row(7, "one two three"), row(8, "One TWO three"),
    row(9, "short", None, None), row(10, "é ß ñ 日本   x", "de", "ü"), row(11, "a b c d e f g h i j k l m n o p"), row(11, "a b c d e f g h i j k l m n o p"),
    row(None, "no id here at all"), row(12, "a b c d e f g h i j k l m n o p q"),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
