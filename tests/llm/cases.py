"""Documents that hold the odd cases: nulls, empty and long texts, ties, repeats, clashing columns."""

WORDS = [f"w{k}" for k in range(400)]


def passage(start: int, n: int) -> str:
    return " ".join(WORDS[(start * 7 + k * (1 + start % 3)) % 400] for k in range(n))


def rows() -> list[tuple]:
    shared = passage(1, 60)
    out = [
        (1, passage(5, 80), "en", "a"),
        (2, passage(5, 80), "en", "a"),  # an exact copy
        (3, passage(5, 80).replace("w37", "x"), "en", "b"),  # a near copy
        (4, "own words " + shared + " and others " + passage(9, 30), "en", "b"),
        (5, shared + "\n" + passage(11, 50), "de", None),
        (6, None, "en", "a"),
        (7, "", None, "a"),
        (8, " \t\n ", "de", "a"),
        (9, "one", "de", "a"),
        (10, "ONE", "de", "a"),
        (11, "ab " * 6000, "fr", "c"),  # long, and repeats itself
        (12, "This line stands in two documents, word for word.\n" + passage(21, 40), "fr", "c"),
        (13, passage(23, 40) + "\nThis line stands in two documents, word for word!\n" + passage(25, 200), "fr", "c"),
        (14, "é中\U0001f600 <|endoftext|> don't  stop\r\n\x0b", "es", "d"),
        (15, "#### $$$$ %%%% &&&& " * 10, "en", "a"),
    ]
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(("id", "key", "_id", "_row", "_lines", "h", "n", "comp", "_bad", "order"))})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
