"""Small corpora with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def text(rng: random.Random, n: int) -> str:
    out = []
    for w in words(rng, n):
        out += [w, rng.choice([" ", " ", " ", "\n", "  "])]
    return "".join(out).strip()


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.randint(1, 120)), rng.choice(["en", "de"]), f"s{rng.randint(0, 4)}", 0) for i in range(n)]
    base = rows[3][1] + " " + text(rng, 80)
    for i in range(n, n + 6):  # copies and near copies
        w = base.split(" ")
        if i % 2:
            w[i % len(w)] = "changed"
        rows.append((i, " ".join(w), "en", "s0", 0))
    rows += [
        (n + 10, None, None, None, None), (n + 11, "", "en", "s1", 0), (n + 12, "   \n ", "en", "s1", 0), (None, "no id here", "en", "s9", 1),
        (n + 13, text(rng, 6000), "en", "s2", 0), (n + 14, "zähl Ünïcode 漢字 🙂 words", "de", "s3", 0), rows[0], rows[0], (n + 15, rows[1][1], "en", "s3", 0),
    ]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def write(spark, tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def clashing(df):
    """Further columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "n", "copies", "shard", "slot", "node", "h", "tid", "key", "c", "score", "items", "n_words", "target", "label", "words", "place"]
    return df.select("*", *[F.lit(7).alias(x) for x in names])


#: Names that operators use themselves or that need quotes.
ODD_NAMES = [
    "a.b", "text.x", "`q`", "with space", "__n", "__id", "__text", "__h0", "__h1", "__bucket", "__row", "__x", "__j", "__s", "__d", "__w", "__h", "__copies",
    "__own", "__node", "__rows", "__words", "__logit", "__p", "__m", "__score", "__n_hit", "__from", "__items", "extra_0", "extra_5", "j", "up", "item", "held", "p",
]


def odd(df):
    """Further columns of such names, and values that have no hash: maps, also inside of structs and arrays."""
    from pyspark.sql import functions as F

    named = df.select("*", *[F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(x) for i, x in enumerate(ODD_NAMES)])
    held = F.create_map(F.lit("k"), F.col("doc_id"))
    return named.withColumns({"map": held, "deep": F.struct(F.array(held).alias("in.side"), F.lit(None).cast("int").alias("none")), "list": F.array(held)})
