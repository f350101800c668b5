import random
import string

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(spark, rows):
    """(doc_id, text) rows as a table with the other columns of documents."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)


def near_copies(seed=1, bases=6, copies=5, words=60):
    """Texts of which groups differ by a few words; some exact copies; the odd cases."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(1, 5)))
    rows = []
    for _ in range(bases):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(words)] = word()
            for at in range(9, words, 12):
                text[at] += "\n" if rnd.random() < 0.8 else "."
            rows.append(" ".join(text).replace("\n ", "\n"))
    odd = ["", " ", "\n\n", "one", "ONE", "one two three", "a b c d", "a b c d e", "É é ß", None, None, rows[0], rows[0].upper(), rows[3] + "\n" + rows[9], "x " * 9000, "x " * 9000 + "y"]
    rows += odd
    rnd.shuffle(rows)
    return [(i * 7, t) for i, t in enumerate(rows)]


def collect(df):
    return [r.asDict(recursive=True) for r in df.collect()]
