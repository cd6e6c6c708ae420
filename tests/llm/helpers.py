"""Small tables with every awkward case, and brute-force versions of the operators."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside; a table may have columns of the same names.
CLASHING = "key row component bucket class size words band id hub target h _key _text _tokens share score kept position".split()


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    pool = ["".join(random.Random(f"{seed % 3}{i}").choices("abcdeéüß", k=2 + i % 6)) for i in range(vocabulary)]
    return " ".join(r.choice(pool) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def edited(text, seed, n=1):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def rows():
    base = [prose(i, 120) for i in range(6)]
    texts = [
        (0, base[0]), (1, base[1]), (2, base[0]), (3, edited(base[0], 1)), (4, edited(base[1], 2, 2)),
        (5, None), (6, ""), (7, " \n\t\r "), (8, "one"), (9, "two words"), (10, "two words"),
        (11, base[2] + " " + base[2]), (12, "x " * 300), (13, "🙂 日本 ▁ <s>\x00 é"), (14, base[3].upper()),
        (15, base[3]), (16, prose(8, 20_000)), (17, base[4]), (17, base[4]), (17, base[5]), (None, base[5]), (None, None),
        (18, "12 34 --- ..."), (19, edited(base[0], 5, 40)), (20, base[0] + " " + base[1]),
    ]
    return [(i, t, ["en", "de", None][n % 3], ["a", "b", "é", None][n % 4], None if t is None else len(t)) for n, (i, t) in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd(spark, with_clashes=True):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit(c) for c in CLASHING}) if with_clashes else docs


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
