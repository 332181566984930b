"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, and columns with clashing names."""

WORDS = [f"word{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * (seed % 13 + 1) + i * i) % len(WORDS)] for i in range(n))


ROWS = [
    (1, prose(1, 60), "en", "a", 1), (2, prose(1, 60), "en", "a", 1), (3, None, "en", "a", None), (4, "", None, "b", 0), (5, " \n\t ", "en", None, 3),
    (6, prose(6, 20_000), "de", "b", 9), (7, "one", "en", "c", 3), (8, prose(1, 60) + " tail", "en", "a", 1), (None, prose(9, 30), "en", "b", 2), (10, prose(10, 90), "en", "c", 2),
    (10, prose(10, 90), "en", "c", 2), (11, "Ünïcode ünd “marks” \U0001f600 mixed\n\nwith  gaps", "de", "é", 4), (12, prose(12, 45), "fr", None, 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = {"size": "'x'", "row": "1", "score": "'y'", "fp": "2", "part": "3", "at": "4", "tie": "5", "keep_key": "6", "host": "7"}


def documents(spark, clashing: bool = False):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in CLASHES.items()]) if clashing else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
