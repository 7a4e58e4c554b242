"""Personal data: overlapping candidate spans scored by boosted trees.

High-recall generators (regular expressions) propose spans. Each proposal is
seen twice. Its check (address grammar, address groups, octets, check digits
and issuer, digit count with a telephone form or word) is the label; its shape and
context (lengths, separators, neighbouring characters and words) are the
features. No feature is the outcome of a check; the number of digits and of
groups, which some checks also bound, are among them. A check can be passed by
chance, as by one in ten order numbers, so passing it is not enough: boosted
trees for each generator learn how often proposals of a shape and context
pass, and a threshold, calibrated on a separate fold of documents, is the
lowest score at which at most one in five of those that pass would do so by
chance. Spans that pass and reach the threshold are added to the strict ones.
A generator's weights are scaled to one sum, so the amount of data does not
matter. Only DataFrame functions touch the rows; the driver sees the counts
of the feature grid, whose size is bounded by the number of feature values.

Positions count code points, ends are exclusive. The strict patterns are
written so that every search is linear in the length of the text: a match
may start where a run of its first characters starts, or where the previous
match ended, and inner repetitions are possessive.

Edge cases: a null text counts as empty and has no spans; repeated rows are
judged one by one; without any proposal nothing is added; a generator with
proposals of one label adds all or none of them; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrate.llm.boosted_trees import as_column, boost, margins, threshold
from shelfrate.llm.common import written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.8
CONTEXT = 24

# The strict patterns in linear-time form, in the order of KINDS.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators: (kind, pattern); a cheap text that a document must hold.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]{1,63}+"
              r"(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}+){1,6}+", "(?i)@|[\\[(]at[\\])]"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z]|:[0-9A-Fa-f:])",
     "[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?: ?[.,] ?[0-9]{1,3}){3}(?![0-9])", "[0-9] ?[.,] ?[0-9]"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", "[0-9]{13}"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}(?![0-9])", "[0-9]{4}[ ._/-]{1,2}[0-9]{4}"),
    ("phone", r"(?<![0-9+])(?:00[0-9]{1,3}|\([0-9]{2,4}\)|[0-9]{2,4})(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])",
     "[0-9)][ ./-]{1,2}[0-9]"),
    ("phone", r"(?<![0-9+])\+[0-9][ ()./0-9-]{6,20}[0-9](?![0-9])", r"\+[0-9]"),
)
# No pattern above matches a text without one of these.
ANY = r"(?i)[0-9@]|[\[(]at[\])]|[a-f]:[a-f]"
# Shape and context. Of features that separate a generator's proposals equally well the trees take the first.
FEATURES = ("alpha", "digits", "groups", "gaps", "sep", "plus", "left", "right", "prev", "word")
# How often something else of a generator's shape passes its check: a tenth of all numbers has a right check digit.
CHANCE = (0.02, 0.02, 0.02, 0.1, 0.1, 0.02, 0.02)
MIN_FOLD = 20
# Weight that a generator's proposals have together.
WEIGHT = 1000.0
_TEL = r"(?i)(phone|tel|call|mobile|cell|fax|contact)[^a-z]*$"
_ADDRESS = r"(?i)^[a-z0-9._%+-]+(?:@| ?[\[(]at[\])] ?)[a-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[a-z0-9-]+)*(?:\.| ?[\[(]dot[\])] ?)[a-z]{2,24}$"
# Card numbers of 13 to 15 digits have few issuers.
_SHORT_CARD = r"^(?:4[0-9]{12}|3[0689][0-9]{12}|3[47][0-9]{13}|(?:1800|2131)[0-9]{11})$"
_DATE = r"^(?:\(?(?:19|20)[0-9]{2}\)?[ ./-][0-9]{2}[ ./-][0-9]{2}|[0-9]{2}[ ./-][0-9]{2}[ ./-](?:19|20)[0-9]{2})"
# Eight groups, or fewer around one "::".
_GROUPS = r"(?i)^(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=[^0-9]*[0-9])(?!(?:[^:]*:){8})(?:[0-9a-f]{1,4}:)+(?::[0-9a-f]{1,4})+)$"
# The word before a span: what numbers of another kind go by, and what personal data goes by.
_OTHER = r"(?i)(order|number|item|invoice|code|ref|id|no|version|date|part|serial|isbn|on|at)[^a-z]*$"
_HINTS = r"(?i)(card|visa|credit|pay|mail|contact|address|host|server|ip)[^a-z]*$"


def _matches(text: Column, pattern: str, needs: str | None) -> tuple[Column, Column]:
    """Matched strings, and the lengths of the pieces between them."""
    p = F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.transform(F.split(text, pattern, -1), F.length)
    if needs is None:
        return found, gaps
    use = text.rlike(needs)
    return (F.when(use, found).otherwise(F.array().cast("array<string>")),
            F.when(use, gaps).otherwise(F.array(F.length(text))))


def _located(found: Column, gaps: Column) -> Column:
    """array of (start, end, match) from the matches and the gaps around them."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["g"]
        end = start + F.length(x["m"])
        item = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(item)).alias("out"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


_OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


def _valid(kind: str, match: Column) -> Column:
    """The check that a strict match of this kind must pass."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _format(gen: int, match: Column, after: Column) -> Column:
    """The format check of a generator's proposals; ``after`` is the text that follows."""
    digits = _digits(match)
    n = F.length(digits)
    if gen == 0:
        return match.rlike(_ADDRESS)
    if gen == 1:
        return match.rlike(_GROUPS)
    if gen == 2:
        return match.rlike(_OCTETS)
    if gen in (3, 4):
        return ((n >= 16) | digits.rlike(_SHORT_CARD)) & _luhn(digits)
    return n.between(8, 15) & ~after.rlike(r"^[ ().-]?[0-9]") & ~match.rlike(_DATE)


def _char_class(c: Column) -> Column:
    return (F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2)
            .otherwise(3))


def _described(text: Column, kind: str, gen: int, spans: Column) -> Column:
    """Candidate spans with their format and context features."""
    def one(s: Column) -> Column:
        match, digits = s["match"], _digits(s["match"])
        seps = F.regexp_replace(match, r"[\p{L}0-9()@]", "")
        n = F.length(digits)
        before = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        left = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise("")
        after = F.substring(text, s["end"] + 1, F.lit(2))
        right = F.substring(after, F.lit(1), F.lit(1))
        valid = F.coalesce(_format(gen, match, after), F.lit(False))
        form = F.when(match.startswith("("), 1).when(match.startswith("00"), 2).otherwise(0)
        tel = before.rlike(_TEL)
        # A number without + needs a telephone form or word.
        passes = valid & ((form > 0) | tel) if gen == 5 else valid
        prev = F.substring(F.rtrim(before), -1, 1)
        # An address may hold any number.
        number = F.lit(0) if kind == "email" else F.least(n, F.lit(20))
        groups = (F.lit(0) if kind == "email" else
                  F.least(F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))), F.lit(9)))
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.lit(gen).alias("gen"), number.alias("digits"),
            groups.alias("groups"),
            F.least(F.length(match) - F.length(F.translate(match, " ", "")), F.lit(3)).alias("gaps"),
            F.when(seps == "", 0).when(seps.rlike("^ +$"), 1).when(seps.rlike("^-+$"), 2).when(seps.rlike(r"^\.+$"), 3)
             .otherwise(4).alias("sep"),
            match.rlike(r"\p{L}").cast("int").alias("alpha"), match.startswith("+").cast("int").alias("plus"),
            _char_class(left).alias("left"), _char_class(right).alias("right"), _char_class(prev).alias("prev"),
            F.when(before.rlike(_HINTS), 2).when(before.rlike(_OTHER), 0).otherwise(1).alias("word"),
            passes.cast("int").alias("y"))
    return F.transform(spans, one)


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _joined(spans: list[Column]) -> Column:
    """kind:start:end of the arrays, comma-joined."""
    return F.concat_ws(",", *[F.transform(a, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for a in spans])


def _strict_spans(kind: str) -> Column:
    """The valid strict matches of a kind as spans."""
    found = F.filter(_located(F.col(f"_m_{kind}"), F.col(f"_g_{kind}")), lambda s: _valid(kind, s["match"]))
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                 s["end"].alias("end")))


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """Strict spans by kind, and described proposals, of every row (one narrow pass).

    ``carry`` names input columns to keep; they come out as _c0, _c1, ...
    """
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("_id"), F.when(whole.rlike(ANY), whole).otherwise("").alias("_t"),
                      *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
    t = F.col("_t")
    found = src
    for k in KINDS:
        m, g = _matches(t, STRICT[k], needs[k])
        found = found.withColumn(f"_m_{k}", m).withColumn(f"_g_{k}", g)
    for i, (_, pattern, need) in enumerate(GENERATORS):
        m, g = _matches(t, pattern, need)
        found = found.withColumn(f"_m{i}", m).withColumn(f"_g{i}", g)
    base = [_strict_spans(k).alias(f"_b_{k}") for k in KINDS]
    cands = F.concat(*[_described(t, k, i, _located(F.col(f"_m{i}"), F.col(f"_g{i}")))
                       for i, (k, _, _) in enumerate(GENERATORS)])
    return found.select("_id", *base, cands.alias("_cands"), *[f"_c{i}" for i in range(len(carry))])


def train_selector(candidates: DataFrame, precision: float = PRECISION, features: tuple[str, ...] = FEATURES) -> dict | None:
    """Trees and threshold by generator, from all proposals of all documents.

    Label 1: the proposal passes the check of its generator. Three quarters
    of the documents train, one quarter calibrates; a generator with fewer
    than ``MIN_FOLD`` proposals of a label in one of them uses all for both. Where a
    share r of proposals pass and others pass with probability c, a share
    c (1 - r) / (r (1 - c)) of what passes does so by chance; the threshold
    is where one less that share reaches ``precision``.
    """
    grid = (candidates.where(F.size("_cands") > 0).select("_id", F.explode("_cands").alias("c"))
            .groupBy(F.col("c.gen").alias("gen"), *[F.col(f"c.{f}").alias(f) for f in features], F.col("c.y").alias("y"),
                     (F.pmod(F.xxhash64("_id"), F.lit(4)) == 0).alias("calibrate"))
            .count().orderBy("gen", *features, "y", "calibrate").collect())
    out = {}
    for gen in sorted({r.gen for r in grid}):
        rows = [r for r in grid if r.gen == gen]
        x = np.array([[r[f] for f in features] for r in rows])
        y, w = np.array([r.y for r in rows], float), np.array([r["count"] for r in rows], float)
        cal = np.array([bool(r.calibrate) for r in rows])
        fit = ~cal
        if min(w[fold & (y == label)].sum() for fold in (fit, cal) for label in set(y)) < MIN_FOLD:
            cal = fit = np.ones(len(rows), bool)
        w *= WEIGHT / w.sum()
        model = boost(x[fit], y[fit], w[fit])
        score = margins(model, x)
        chance = CHANCE[gen]
        cut = threshold(score[cal], y[cal], w[cal], chance / (chance + (1 - chance) * (1 - precision)))
        if np.isfinite(cut):
            out[gen] = {"trees": model, "cut": cut, "features": features}
    return out or None


def select_spans(candidates: DataFrame, model: dict | None) -> DataFrame:
    """``candidates`` with _spans, an array of all selected spans by kind and place, and _n_added."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if model:
        def picked(c: Column) -> Column:
            high = F.lit(False)
            for gen, m in model.items():
                score = as_column(m["trees"], [c[f] for f in m["features"]])
                high = F.when(c["gen"] == gen, score >= m["cut"] - 1e-9).otherwise(high)
            return (c["y"] == 1) & high & ~F.exists("_base", lambda b: _overlaps(b, c))

        plain = F.transform(F.filter("_cands", picked),
                            lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        more = F.when(F.size("_cands") > 0, plain).otherwise(empty)
    else:
        more = empty
    rank = lambda s: F.struct(s["end"] - s["start"], -s["start"], s["kind"])
    # Of overlapping additions the longest stays, then the leftmost.
    longest = F.filter("_more", lambda s: ~F.exists("_more", lambda o: _overlaps(o, s) & (rank(o) > rank(s))))
    rows = (candidates.withColumn("_base", F.concat(*[F.col(f"_b_{k}") for k in KINDS])).withColumn("_more", more)
            .withColumn("_added", F.when(F.size("_more") > 1, F.array_distinct(longest)).otherwise(F.col("_more"))))
    by_kind = [F.array_sort(F.concat(F.col(f"_b_{k}"), _of_kind("_added", k))) for k in KINDS]
    return rows.withColumn("_spans", F.concat(*by_kind)).withColumn("_n_added", F.size("_added")).drop(
        "_base", "_more", "_added")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             candidates: DataFrame | None = None, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Counts by kind, digest of the strict spans, all spans as text and as an array, of every row."""
    cands = written(find_candidates(docs, id_col, text_col), "pii-candidates") if candidates is None else candidates
    rows = select_spans(cands, train_selector(cands, features=features))
    return rows.select(
        F.col("_id").alias(id_col), *[F.size(f"_b_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined([F.col(f"_b_{k}") for k in KINDS]).cast("binary"), 256).alias("base_sha256"),
        _joined([F.col("_spans")]).alias("spans"), F.col("_n_added").cast("long").alias("n_added"),
        F.col("_spans").alias("span_list"))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every selected span of the text replaced by its kind.

    Two narrow passes over the text (training counts, then spans), no join.
    """
    model = train_selector(find_candidates(docs, id_col, text_col))
    names = tuple(docs.columns)
    rows = select_spans(find_candidates(docs, id_col, text_col, names), model)
    return rows.select(*[(redact(F.col(f"_c{i}"), F.col("_spans")) if c == text_col else F.col(f"_c{i}")).alias(c)
                         for i, c in enumerate(names)])


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("z"),
                                                                  s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["a"] >= acc["pos"]
        piece = F.concat(F.substring(text, acc["pos"] + 1, s["a"] - acc["pos"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["pos"], s["z"]).alias("pos"),
                        F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(text.isNull() | (F.size(spans) <= 0), text).otherwise(done)
