"""Small fixtures and brute-force forms shared by the tests of this folder."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def corpus(seed=5, n=60):
    """Texts with exact copies, near copies, shared passages, nulls, empty and one-word texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 160)) for _ in range(n)]
    passage = prose(rng, 45)
    out = list(base)
    for i in range(0, n, 3):
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base[1], base[1].upper(), base[2] + " " + passage, passage + " " + base[3], base[4] + " " + passage + " " + base[5]]
    out += [passage + " " + passage, None, "", "   \n ", "one", "One", "é à ü " * 30, "a" * 1000, "ab " * 500]
    return list(enumerate(out))


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOC_SCHEMA)
