"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document; the ledger keeps the measurements and one bit for each rule that
failed.  A policy is a versioned bitmask: a document is kept if it fails no rule of the policy.  Policies, ablations
and rule overlaps then need only bitwise operations over the ledger, never the texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Bit, name and condition of failure, over the measurements.
RULES = [
    (0, "too_few_words", "n_words < 10"),
    (1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    (2, "many_symbols", "10 * n_symbols > n_words"),
    (3, "short_words", "word_chars < 2 * n_words"),
    (4, "long_words", "word_chars > 20 * n_words"),
    (5, "duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    (6, "capitals", "n_words >= 10 and 2 * n_capital_words > n_words"),
]
BIT = {name: 1 << bit for bit, name, _ in RULES}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Policies by version; the query uses the latest.
POLICIES = {
    1: BASE,
    2: BASE | BIT["many_symbols"] | BIT["short_words"] | BIT["long_words"] | BIT["duplicate_lines"] | BIT["capitals"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words")
WINDOW = 5


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that are found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    if len(number) ** width < 1 << 63:
        key = ids[:n].copy()
        for i in range(1, width):
            key = key * np.uint64(len(number)) + ids[i : n + i]
    else:  # number the windows exactly, a word at a time
        key = ids[:n]
        for i in range(1, width):
            _, key = np.unique(key * np.uint64(len(number)) + ids[i : n + i], return_inverse=True)
            key = key.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[:n] += hit
    cover[width : n + width] -= hit
    return int((np.cumsum(cover) > 0).sum())


def make():
    def measure(text: str) -> tuple[int, ...]:
        raw = text.encode()
        words = raw.split()  # bytes split at the six ASCII white-space characters
        seen: set[bytes] = set()
        n_lines = n_dup = 0
        for line in raw.split(b"\n"):
            if line and not line.isspace():
                n_lines += 1
                n_dup += line in seen
                seen.add(line)
        blank = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
        return (
            len(words),
            len(text) - blank,
            len(raw) - len(raw.translate(None, b"#*$%&|<>")),
            n_dup,
            repeat_words(words),
            n_lines,
            sum(w.isupper() for w in words),
        )

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [measure(t or "") for t in cols["text"]]
        by = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
        return {"doc_id": cols["doc_id"]} | dict(zip(MEASURES, by, strict=True))

    return run


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, rule_bits (long), base_failed: one row per input row.

    Null text has no words: all measurements are zero and ``too_few_words`` fails.  Null doc_id stays null, repeated
    rows give repeated results, other columns are ignored.  A word counts as capital if it has ASCII letters and all
    of them are capitals.

    An empty table gives no rows; a very long text is measured whole, in one task.
    """
    out = map_columns(docs.select("doc_id", "text"), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES), make)
    bits = " | ".join(f"if({cond}, {1 << bit}L, 0L)" for bit, _, cond in RULES)
    return out.withColumn("rule_bits", F.expr(bits)).withColumn("base_failed", F.expr(f"(rule_bits & {BASE}) != 0"))


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return rows.withColumn("kept", F.expr(f"(rule_bits & {POLICIES[version]}) = 0"))


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that would be kept without it.

    The ledger is first counted by its bits (at most 2 to the number of rules), the rest is bitwise on those counts.
    """
    mask = POLICIES[version]
    masks = rows.groupBy((F.col("rule_bits").bitwiseAND(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << b).alias("bit")) for b, n, _ in RULES if mask >> b & 1])
    each = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.expr("coalesce(sum(n) filter (where (bits & bit) != 0), 0)").alias("failed"),
        F.expr("coalesce(sum(n) filter (where bits = bit), 0)").alias("failed_alone"),
        F.expr(f"coalesce(sum(n) filter (where (bits & ({mask} & ~bit)) = 0), 0)").alias("kept_without"),
    )
