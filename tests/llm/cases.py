"""Rows that every operator of the folder must stand: nulls, empty and long texts, ties, repeats, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, part int, ids string"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))


def rows():
    t = ["The cat sat on the mat.", "", None, "one", "two words", " \t\n ", "café ñandú  é   \n\nx", "The cat sat on the mat.", LONG, "a b c " * 300, "<|endoftext|> it's 'll 12345 ___ 　 foo\x1c bar baz"]
    out = [(i, x, "en" if i % 3 else None, (None, "src0", "src1")[i % 3], None, -1, 7, "x") for i, x in enumerate(t)]
    return out + [(None, "no id", None, None, 3, 1, 1, None), (3, "one", "en", "src0", 1, 1, 1, ""), (3, "one", "en", "src0", 1, 1, 1, ""), (-5, "negative id", "de", "Ω", 1, None, None, None)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
