"""Company names against domains."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alike, urls

# Legal suffixes in order of trial, penalised hosts.
COMPANY_SUFFIXES = [
    " inc", " inc.", " incorporated", " llc", " ltd", " ltd.", " limited",
    " gmbh", " ag", " corp", " corp.", " corporation", " co", " co.",
]
PENALTY_DOMAINS = [
    "linkedin.com", "facebook.com", "instagram.com", "twitter.com", "youtube.com", "medium.com",
    "github.com", "glassdoor.com", "indeed.com", "crunchbase.com", "bloomberg.com", "wikipedia.org",
]
#: Suffixes of two labels, by rule: a general label before a country's.
SECOND_LEVEL = r"(?:co|com|ne|net|or|org|ac|edu|go|gov|govt|id|mil|sch)\.[a-z]{2}"
PENALTY, SHORT_SCORE, SHORTEST, THRESHOLD = 25, 50, 3, 60


def clean_company_name(company: Column) -> Column:
    """Lower case, the first listed suffix that fits cut off, letters and digits only."""
    low = F.lower(F.coalesce(company, F.lit("")))
    out = low
    for s in reversed(COMPANY_SUFFIXES):
        out = F.when(F.endswith(low, F.lit(s)), F.substring(low, F.lit(1), F.length(low) - len(s))).otherwise(out)
    return F.regexp_replace(out, "[^a-z0-9]", "")


def split_domain(host: Column, suffixes: Sequence[str] | None = None) -> Column:
    """struct<subdomain, domain, suffix>: two labels of suffix where listed, else one; a lone label is the domain.

    Without a list of suffixes, those of two labels are told by ``SECOND_LEVEL``.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, "\\.")
    n = F.size(labels)
    two = F.substring_index(bare, ".", -2)
    listed = two.rlike(f"^{SECOND_LEVEL}$") if suffixes is None else two.isin(*suffixes)
    k = F.when(listed & (n > 2), 2).when(n > 1, 1).otherwise(0)
    domain = F.get(labels, n - k - 1)
    sub = F.array_join(F.slice(labels, F.lit(1), F.greatest(n - k - 1, F.lit(0))), ".")
    suffix = F.array_join(F.slice(labels, n - k + 1, k), ".")
    return F.struct(sub.alias("subdomain"), domain.alias("domain"), suffix.alias("suffix"))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def partial_similarity(a: str, b: str) -> float:
    """0 to 100: the shorter string against the best stretch of the longer, stretches at the ends included."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    m, best = len(a), 0.0
    for lo in range(1 - m, len(b)):
        part = b[max(0, lo) : lo + m]
        if part and (part[0] in a or part[-1] in a):
            best = max(best, 200.0 * lcs(a, part) / (m + len(part)))
    if len(a) == len(b):
        for lo in range(1 - m, m):
            part = a[max(0, lo) : lo + m]
            if part:
                best = max(best, 200.0 * lcs(b, part) / (m + len(part)))
    return best


def partial_ratio():
    """Arrow UDF of ``partial_similarity``."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple, float] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if (x, y) not in memo:
                memo[x, y] = partial_similarity(x or "", y or "")
            out.append(memo[x, y])
        return pd.Series(out)

    return run


def bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once."""
    return F.transform(F.array(x), f)[0]


#: Bits of a row that a sum cannot carry out of a bigint.
LIMB = 62


def common_length(marks: Column, m: Column) -> Column:
    """Length of the longest common subsequence of a string of at most 62 characters and one whose characters have ``marks``."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), m) - 1

    def step(row: Column, mark: Column) -> Column:
        u = row.bitwiseAND(mark)
        return (row + u).bitwiseOR(row - u).bitwiseAND(full)

    return m - F.bit_count(F.aggregate(marks, full, step))


def common_length_long(marks: Column, m: Column) -> Column:
    """The same for longer strings: rows of several limbs of 62 bits, with carries between them."""
    limb = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(LIMB)) - 1
    fulls = F.transform(
        F.sequence(F.lit(0), F.floor((m - 1) / LIMB).cast("int")),
        lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(m - k * LIMB, F.lit(LIMB))) - 1,
    )

    def step(row: Column, mark: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("row"))
        parts = F.arrays_zip(row.alias("r"), mark.alias("k"), fulls.alias("f"))

        def one(acc: Column, x: Column) -> Column:
            r, u = x["r"], x["r"].bitwiseAND(x["k"])
            total = r + u + acc["carry"]
            return F.struct(
                F.shiftright(total, LIMB).alias("carry"),
                F.concat(acc["row"], F.array(total.bitwiseAND(limb).bitwiseOR(r - u).bitwiseAND(x["f"]))).alias("row"),
            )

        return F.aggregate(parts, begin, one, lambda acc: acc["row"])

    last = F.aggregate(marks, fulls, step)
    return m - F.aggregate(last, F.lit(0), lambda n, x: n + F.bit_count(x))


def best_stretch(s: Column, t: Column, floor: float) -> Column:
    """The best ratio of ``s`` and a stretch of ``t`` of its length, or shorter at the ends; ``s`` is not the longer one.

    Stretches that cannot be better than the best so far, or than ``floor``, are passed over; the most promising go first.
    """

    def marked(p: Column) -> Column:
        s, m = p["s"], p["m"]
        one = F.lit(1).cast("long")
        places = F.sequence(F.lit(1), m)
        mark = lambda c: F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.when(F.substring(s, i, F.lit(1)) == c, acc.bitwiseOR(F.call_function("shiftleft", one, i - 1))).otherwise(acc))
        limbs = F.sequence(F.lit(0), F.floor((m - 1) / LIMB).cast("int"))
        long_mark = lambda c: F.transform(limbs, lambda k: F.aggregate(
            F.sequence(k * LIMB + 1, F.least(m, (k + 1) * LIMB)), F.lit(0).cast("long"),
            lambda acc, i: F.when(F.substring(s, i, F.lit(1)) == c, acc.bitwiseOR(F.call_function("shiftleft", one, i - 1 - k * LIMB))).otherwise(acc)))
        return F.struct(
            m.alias("m"), F.size(p["c"]).alias("n"),
            F.when(m <= LIMB, F.transform(p["c"], mark)).otherwise(F.array().cast("array<bigint>")).alias("short"),
            F.when(m > LIMB, F.transform(p["c"], long_mark)).otherwise(F.array().cast("array<array<bigint>>")).alias("long"),
            F.aggregate(p["c"], F.array(F.lit(0)), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + F.contains(s, c).cast("int"))).alias("shared"),
        )

    def ratios(q: Column) -> Column:
        m, n = q["m"], q["n"]
        first = lambda lo: F.greatest(lo, F.lit(0))
        size = lambda lo: F.least(lo + m, n) - first(lo)

        def most(lo: Column) -> Column:
            """What a stretch could reach if all its characters that the other string has were in common order."""
            shared = F.get(q["shared"], first(lo) + size(lo)) - F.get(q["shared"], first(lo))
            return F.struct((F.lit(-200.0) * shared / (m + size(lo))).alias("most"), lo.alias("lo"))

        def better(best: Column, x: Column) -> Column:
            lo = x["lo"]
            common = F.when(m <= LIMB, common_length(F.slice(q["short"], first(lo) + 1, size(lo)), m)).otherwise(common_length_long(F.slice(q["long"], first(lo) + 1, size(lo)), m))
            return F.when(-x["most"] <= best, best).otherwise(F.greatest(best, F.lit(200.0) * common / (m + size(lo))))

        return F.aggregate(F.array_sort(F.transform(F.sequence(1 - m, n - 1), most)), F.lit(float(floor)), better)

    own = F.struct(s.alias("s"), F.length(s).alias("m"), F.split(t, "").alias("c"))
    return bound(own, lambda p: bound(marked(p), ratios))


def similarity(a: Column, b: Column, floor: float = 0.0) -> Column:
    """``partial_similarity`` as a native expression: rows of the bit-parallel table are bigints, no Python worker.

    Null and empty strings have 0.  What is not above ``floor`` may come out as the floor.
    """
    swap = F.length(a) > F.length(b)
    pair = F.struct(F.when(swap, b).otherwise(a).alias("s"), F.when(swap, a).otherwise(b).alias("t"))

    def decided(p: Column) -> Column:
        s, t = p["s"], p["t"]
        turned = F.struct(t.alias("s"), s.alias("t"))
        ways = F.when(F.length(s) == F.length(t), F.array(p, turned)).otherwise(F.array(p))  # of equal length: each in the other
        return F.when(s == "", 0.0).when(F.contains(t, s), 100.0).otherwise(F.array_max(F.transform(ways, lambda x: best_stretch(x["s"], x["t"], floor))))

    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(bound(pair, decided))


def penalty(host: Column) -> Column:
    return F.when(F.exists(F.array(*[F.lit(p) for p in PENALTY_DOMAINS]), lambda p: F.contains(host, p)), PENALTY).otherwise(0)


def best_similarity():
    """Arrow UDF: the greater similarity of a string to two others, for all rows of a batch at once; no nulls."""

    @F.pandas_udf("double")
    def run(base: pd.Series, domain: pd.Series, subdomain: pd.Series) -> pd.Series:
        (i, a), (j, b) = pd.factorize(base), pd.factorize(pd.concat([domain, subdomain]))
        a, b = list(a), list(b)
        known = alike.letters(a, b)
        v = alike.ratios(alike.Strings(a, known), np.concatenate([i, i]), alike.Strings(b, known), j)
        return pd.Series(np.maximum(v[: len(i)], v[len(i) :]))

    return run


def score_parts(company: Column, url: Column, parts: Column) -> Column:
    """``score_domain`` with the host's subdomain and domain given, as a struct: by a table of suffixes, for instance."""
    base = clean_company_name(company)
    best = best_similarity()(base, F.coalesce(parts["domain"], F.lit("")), F.coalesce(parts["subdomain"], F.lit("")))
    score = F.when(F.length(base) < SHORTEST, float(SHORT_SCORE)).otherwise(F.greatest(F.lit(0.0), best - penalty(urls.normalise_domain(url))))
    empty = F.coalesce(F.length(company), F.lit(0)) * F.coalesce(F.length(url), F.lit(0)) == 0
    return F.when(empty, 0.0).otherwise(score)


def score_domain(company: Column, url: Column) -> Column:
    """0 to 100: best of domain and sub-domain, less a penalty for portals; short names 50, nothing to compare 0."""
    return score_parts(company, url, split_domain(urls.normalise_domain(url)))


def is_relevant(company: Column, url: Column, threshold: float = THRESHOLD) -> Column:
    return F.coalesce(score_domain(company, url) >= threshold, F.lit(False))
