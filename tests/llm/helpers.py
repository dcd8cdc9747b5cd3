import random

WORDS = "the of and was slick vessel tide harbour north engine captain märz año été oil 12 2024".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randint(0, 99))]) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages and odd rows: (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(seed)
    shared = [sentence(rng, 60), sentence(rng, 80)]
    rows = []
    for i in range(n):
        t = "\n".join(sentence(rng, rng.randint(4, 40)) for _ in range(rng.randint(1, 6)))
        if i % 5 == 0:
            t += "\n" + rng.choice(shared)
        if i % 7 == 3 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if i % 11 == 5 and rows:
            t = (rows[rng.randrange(len(rows))][1] or "").replace("slick", "SLICK", 1)
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None]), len(t)))
    rows += [(1000, None, "en", None, None), (1001, "", "en", "a", 0), (None, "", None, "b", 0), (None, sentence(rng, 30), "en", "b", 9), (1002, "x" * 5000, "en", "a", 5000), (1003, "ab " * 900, "de", "b", 2700)]
    rows += [(1004, shared[0], "en", "a", 1), (1004, shared[0], "en", "a", 1), (1005, "   \n\t ", "en", "a", 3), (1006, "𝄞é " * 40, "en", "a", 3)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use inside.
CLASHING = "rid long, text_key long, size long, n long, key string, start int, label string, fp long, words string, spans string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")))
