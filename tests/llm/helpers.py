"""Small tables on disk, as the queries read them."""

import random
import string

CLASH = ("start", "n_tokens", "n_bytes", "size", "target", "copies", "taken", "score", "fp", "key", "fingerprint", "component_id", "ids", "n", "queue", "pid", "_n", "digest", "content")


def documents(spark, folder, rows, clash=True):
    """rows: (doc_id, text[, source]); with columns whose names operators use themselves."""
    full = [(d, t, "en", (*more, "s")[0], None if t is None else len(t)) for d, t, *more in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        df = df.selectExpr("*", *(f"'clash' AS `{c}`" for c in CLASH))
    df.write.mode("overwrite").parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def words(r, n):
    return " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(1, 9))) for _ in range(n))


def odd_texts(seed=1):
    """Null, empty, blank, special, long and repeated texts."""
    r = random.Random(seed)
    long = words(r, 30_000)
    same = words(r, 40)
    return [None, "", " ", "\n\t\x0b", "a", "<|endoftext|> x", "naïve café — “quoted” 日本語 😀", "x" * 3000, "  two  spaces\n \n", long, same, same, same.upper(), "\x1c\x1d odd \x85 white space", *(words(r, k) for k in (1, 3, 4, 5, 200))]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
