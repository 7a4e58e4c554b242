import base64
import random
from collections import Counter

from helpers import corpus, docs_frame, prose, words

from shelfrate.llm.quality_rules import compression_rules


def brute(text):
    text = text or ""
    w = words(text)
    count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i:i + 3])] > 1:
            repeated.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if words(x)]
    n_dup = len(lines) - len(set(lines))
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), n_dup, len(repeated), base


def test_counts_match_brute_force(spark):
    rows = corpus() + [(900, "x\ny\nx\n\n \n x\nx"), (901, "# * $ % & | < >\x0b\x0c\r a\u00a0b \u2003"), (None, "null id")]
    got = compression_rules(docs_frame(spark, rows)).collect()
    want = {i: brute(t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_bands(spark):
    rng = random.Random(1)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    clean = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randrange(33, 0x2000)) for _ in range(12)) for _ in range(800))
    pieces = [prose(rng, 40) for _ in range(2)]
    repetitive = "\n".join(rng.choice(pieces) for _ in range(400))
    got = {r.doc_id: r for r in compression_rules(docs_frame(spark, [(1, clean), (2, noise), (3, repetitive)])).collect()}
    assert got[1].kept
    assert got[2].band_failed and got[2].whole_ratio < 1.45
    assert got[3].band_failed and got[3].whole_ratio > 9


def test_encoded_text(spark):
    """Hex and base64 in lines, and prose mixed with them, fail; prose alone stays."""
    rng = random.Random(4)
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(700)]
    clean = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))[:n]
    lines = lambda t, k: "\n".join(t[i:i + k] for i in range(0, len(t), k))
    code = lambda n: lines(base64.b64encode(rng.randbytes(n)).decode(), 76)[:n]
    hexa = lambda n: rng.randbytes(n).hex()
    bad = [lines(hexa(n), 64)[:n] for n in (4096, 5000, 8191, 30000, 70000)]
    bad += [" ".join(lines(hexa(4000), 2).split("\n")), *map(code, (4096, 8191, 30000)), clean(20000) + "\n" + code(20000)]
    bad += [clean(4096) + code(4000), clean(20000) + "\n" + lines(hexa(5000), 64)]
    good = [clean(n) for n in (600, 2048, 4096, 6000, 30000)]
    got = {r.doc_id: r for r in compression_rules(docs_frame(spark, list(enumerate(bad + good)))).collect()}
    assert all(got[i].band_failed for i in range(len(bad))), [i for i in range(len(bad)) if not got[i].band_failed]
    assert not any(got[i].band_failed for i in range(len(bad), len(bad + good)))


def test_empty_table(spark):
    assert compression_rules(docs_frame(spark, [(1, "a")]).limit(0)).count() == 0
