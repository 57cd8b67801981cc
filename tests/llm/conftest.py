"""Small document tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, spans string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["er", "on", "th", "an", "re", "ti", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(60, 160)) for _ in range(24)]
    shared = sentence(rng, 60)
    near = base[0].split()
    near[30] = "CHANGED"
    out = base + [base[1], base[1], " ".join(near), f"{base[2]}\n{shared}", f"{shared} {base[3]}", f"{shared}\n{shared}"]
    out += [None, "", "   \n\t ", "one", "one two", "two one", "Ünï çödé ÀÉ " * 30, "spam ham " * 900, "x" * 5000, "a\x0bb\x0cc d\n\n\ne"]
    out += ["mail bob.x@mail.example.com now, call +1 (640) 555-0953 or 4111 1111 1111 1111; ip 10.0.0.255 and 300.1.1.1 id=4111111111111112", "token = \"4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e\" a@b a@@b.c @x.y"]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", "ü", None][i % 4], None if t is None else len(t), "k", 1, "s") for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, "text without an id " * 20, "en", "a", 1, "k", 1, "s"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *cols):
    out = [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
