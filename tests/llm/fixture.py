"""Documents with all that operators must bear, and helpers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 260)) for _ in range(14)]
    passage = prose(rng, 110)
    out = list(base)
    out += [base[0], base[0], base[1].upper(), base[2] + " and more", base[3].replace(" a", " b", 2)]  # copies
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 25)}" for _ in range(4)] + [passage]  # a shared passage
    out += [" ".join(w if k % 40 else "x" + w for k, w in enumerate(base[4].split())), base[5][:700] + base[6][:700]]
    out += [None, "", " ", "\n\t", "a", "a b", "a b c d e", "é" * 900, "ab" * 700, ("line one here\n" * 60).strip(), "%%% " * 80, "😀 x y \x1c z"]
    out += ["é " * 300 + prose(rng, 200), passage + "ß" + passage, prose(rng, 6000)]
    return out


def documents(spark, extra=True):
    rows = [(k * 3, t, ("en", "de", None)[k % 3], f"s{k % 2}", len(t) if t else None) for k, t in enumerate(texts())]
    rows.append(rows[7])  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if extra:  # names that operators use inside
        for name in ("id", "n", "a", "b", "key", "row", "spans", "bucket", "trusted", "kept", "x", "part"):
            df = df.selectExpr("*", f"'other' AS {name}")
    return df


def labels(spark):
    n = len(texts())
    return spark.createDataFrame([(k * 3, int(k % 5 != 0), 0) for k in range(0, n, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text")


def empty(df):
    return df.limit(0)


def rows(df):
    return {r[0]: r for r in df.collect()}
