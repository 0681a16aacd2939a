"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp long, row long, key long, id long, score double, size long, word string, label string"
)
EXTRA = (1, 1, 1, 1, 0.5, 1, "w", "x")
WORDS = "the of and harbour lantern meadow quiet stone river morning copper".split()


def prose(n: int, salt: int = 0) -> str:
    return " ".join(WORDS[(k * k + salt * 3 + k // 7) % len(WORDS)] + str((k + salt) % 13) for k in range(n))


def rows():
    found = [
        (1, prose(60), "en", "a"),
        (2, prose(60), "en", "a"),
        (2, prose(60), "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (None, None, None, None),
        (None, prose(80, 5), "en", "b"),
        (5, "  \t\n ", "en", "b"),
        (6, "one", "de", "b"),
        (7, prose(30000, 9), "fr", "a"),
        (8, prose(70, 3) + " é ü 日本", "es", None),
        (9, prose(45, 8), None, "c"),
    ]
    return [(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in found]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def none(spark):
    return spark.createDataFrame([], DOCS)
