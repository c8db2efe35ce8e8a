"""Small tables with the awkward cases: nulls, empty and very long texts, repeats, clashing columns."""

import random
import re

WORDS = "the of and to in that thtion erand ouble onnt shere inea tible anou erest whing lyed".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, item string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "x", "y", "z", "é"]) * r.randint(0, 2) for _ in range(n))


def texts(seed=1, n=120):
    r = random.Random(seed)
    shared = [sentence(r, 60) for _ in range(3)]
    base, out = [sentence(r, r.randint(30, 300)) for _ in range(12)], []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            out.append(r.choice(base))
        elif kind == 1:  # a near copy
            w = r.choice(base).split()
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = "edited" + str(r.randint(0, 99))
            out.append(" ".join(w))
        elif kind == 2:
            out.append(sentence(r, 30) + "\n" + r.choice(shared) + "\t" + sentence(r, 20))
        elif kind == 3:
            out.append(sentence(r, r.randint(1, 25)))
        elif kind == 4:
            out.append(r.choice(["", " \n", "one", "one two", "ONE two three", "a " * 50, "a b " * 40 + "c", "a " * 30 + "b " * 30]))
        else:
            out.append(sentence(r, r.randint(100, 400)))
    out[min(7, n - 1)] = None
    if n > 20:
        out[20] = sentence(r, 15_000)
    return out


def documents(spark, found):
    rows = [(i, t, "en", "s", len(t or ""), 1.0, i, "x") for i, t in enumerate(found)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
