"""Small corpora with the awkward cases, and how results are read."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string"


def words(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    passage = " ".join(words(1, 70))
    texts = {
        0: " ".join(words(2, 120)), 1: " ".join(words(2, 120)), 2: " ".join([*words(2, 118), "x", "y"]),
        3: None, 4: "", 5: " \t\n ", 6: "one two", 7: "one two", 8: f"{' '.join(words(3, 40))} {passage} {' '.join(words(4, 30))}",
        9: f"{' '.join(words(5, 10))}\n{passage}", 10: "Erst, " * 90, 11: " ".join(words(6, 9000)),
        12: " ".join([*words(7, 60), *words(8, 50), *words(7, 60)]), 13: "é ñ  ü\x0bß " + " ".join(words(9, 55)), 14: "日本語 " * 40,
        15: f"ONE {passage.upper()}", 16: " ".join(words(7, 60)),
    }
    rows = [(k, t, "en", "s", None, "clash", "clash") for k, t in texts.items()]
    rows += [(8, texts[8], "de", "s", 1, "again", None), (None, texts[0], None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def by_id(df):
    """Rows by id; of repeated ids all rows, which must be equal but for carried columns."""
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out
