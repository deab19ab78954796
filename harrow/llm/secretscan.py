"""Secret scans with Spark's own functions only.

Base patterns come first: assignments to secret-like names, access keys and long hexadecimal runs.  Then every other
stretch of key characters is held against two character Markov models, one of random strings and one of ordinary
identifiers; it is a secret if its mean log-likelihood ratio per character step is high.  Both models are counts of
character pairs over labelled samples: strings derived by hashing, labelled random, and the words of a bounded sample
of labelled documents, labelled ordinary.  The trained table of ratios has one entry for each pair of the alphabet, so its size
is fixed.

Positions are code points.  Java's split and match functions scan alike, so the pieces between matches and the matches
themselves, added up, give every start and end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
STRETCH = r"[A-Za-z0-9+/_=-]{20,}"
#: A stretch that the models judge has a digit and a letter.
WORTH = r"^(?=.*[0-9])(?=.*[A-Za-z]).*$"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Rows of labelled documents that give ordinary words, and strings that stand for random ones.
SAMPLE_ROWS = 2000
RANDOM_STRINGS = 4096
#: Mean log-likelihood ratio per step above which a stretch is a secret.
THRESHOLD = 0.7
KINDS = ["assign", "access", "hex", "markov"]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: start, end and string of each leftmost match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    step = F.zip_with(
        F.transform(F.slice(between, 1, F.size(found)), F.length), F.transform(found, F.length), lambda a, b: F.struct(a.alias("gap"), b.alias("len"))
    )
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("out"))
    spans = F.aggregate(
        step,
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["len"]).alias("e")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.zip_with(spans, found, lambda p, m: F.struct(p["s"].alias("s"), p["e"].alias("e"), m.alias("m")))


EMPTY = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def found_if(text: Column, quick: Column, pattern: str) -> Column:
    return F.when(quick, matches(text, pattern)).otherwise(F.expr(EMPTY))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each pair of characters, row by row of the alphabet.

    Learns from at most ``sample_rows`` labelled documents (smallest hash of doc_id): words of letters, joined
    identifiers and numbers that match no base pattern are ordinary.  Random strings are digests, written in
    hexadecimal, base 64 and base 36.  Without labelled documents the ordinary model is uniform.
    """
    spark = documents.sparkSession
    own = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    text = documents.join(F.broadcast(own), "doc_id").select(F.coalesce("text", F.lit("")).alias("t"))
    for p in (ASSIGN, ACCESS, HEX):
        text = text.select(F.regexp_replace("t", p, " ").alias("t"))
    words = text.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0))).alias("w")).where(~F.col("w").rlike(r"^.{24,}$") | F.col("w").rlike(r"^[A-Za-z]+$"))
    joined = words.select(F.explode(F.array("w", F.concat("w", F.lit("_"), F.lower("w")), F.concat("w", F.lit("-"), F.initcap("w")), F.concat(F.initcap("w"), F.lit("/"), "w"))).alias("w"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    binary = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    random = spark.range(RANDOM_STRINGS).select(F.explode(F.array(digest, binary, binary, F.regexp_replace(binary, "[+/]", ""), F.upper(F.regexp_replace(binary, "[+/]", "")))).alias("w"))

    def pairs(df: DataFrame, name: str) -> DataFrame:
        at = F.filter(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2))), lambda x: F.length(x) == 2)
        return df.where(F.length("w") >= 2).select(F.explode(at).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))

    # One row at most for each pair of the alphabet and kind.
    counts = {(r.kind, r.pair): r.n for r in pairs(joined, "ordinary").unionByName(pairs(random, "random")).collect()}
    out, size = [], len(ALPHABET)
    for a in ALPHABET:
        sums = {k: sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in ("ordinary", "random")}
        for b in ALPHABET:
            p, q = ((counts.get((k, a + b), 0) + 0.5) / (sums[k] + 0.5 * size) for k in ("random", "ordinary"))
            out.append(round(math.log(p / q), 6))
    return out


def spans_name(columns: list[str]) -> str:
    """``harrow_spans``, or with underscores until no column has that name."""
    name, taken = "harrow_spans", {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def scan(documents: DataFrame, ratios: list[float], *, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``harrow_spans`` (see ``spans_name``): array<struct<s, k, e>> of all spans by start and kind, to the rows of ``documents``.

    k is the number of the kind, in the order assign, access, hex, markov.  Null text has no spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, ""))
    assign = F.filter(found_if(text, text.rlike(r"(?i)pass|secret|token|api_?key"), ASSIGN), lambda x: value(x) >= 8)
    access = F.filter(found_if(text, F.contains(text, F.lit("AKIA")), ACCESS), lambda x: F.length(x["m"]) >= 16)
    hexes = found_if(text, text.rlike(HEX), HEX)
    worth = F.filter(found_if(text, text.rlike(STRETCH), STRETCH), lambda x: x["m"].rlike(WORTH))
    rows = documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row"), documents["text"].alias("text"))  # no name can clash
    base = rows.withColumns({"harrow_assign": assign, "harrow_access": access, "harrow_hex": hexes, "harrow_stretch": worth})
    table = F.array(*[F.lit(x) for x in ratios])
    size = len(ALPHABET)

    def mean_ratio(m: Column) -> Column:
        codes = F.transform(F.split(m, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        steps = F.zip_with(F.slice(codes, 1, F.length(m) - 1), F.slice(codes, 2, F.length(m) - 1), lambda a, b: (a - 1) * size + b)
        return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(F.col("harrow_table"), i - 1)) / (F.length(m) - 1)

    apart = lambda x: ~F.exists(F.concat("harrow_assign", "harrow_access", "harrow_hex"), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    base = base.withColumn("harrow_table", F.when(F.size("harrow_stretch") > 0, table))
    markov = F.filter("harrow_stretch", lambda x: apart(x) & (mean_ratio(x["m"]) > threshold))
    base = base.withColumn("harrow_markov", markov)

    def tagged_as(i: int) -> Column:  # a lambda with a second parameter would be given the index
        return F.transform(f"harrow_{KINDS[i]}", lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    tagged = [tagged_as(i) for i in range(len(KINDS))]
    return base.select("row.*", F.array_sort(F.concat(*tagged)).alias(spans_name(documents.columns)))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("harrow_spans", lambda x: x["k"] == i)).cast("long")
    base = F.filter("harrow_spans", lambda x: x["k"] < 3)
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("harrow_spans")).alias("spans")
    )


def redact(scanned: DataFrame, columns: list[str], mark: str = "[SECRET]") -> DataFrame:
    """The given columns, with each span of the text replaced by a mark (overlapping spans by one) and n_chars to match.

    Null and empty texts and texts without spans stay as they are, repeated rows stay repeated, an empty table stays empty.
    n_chars of another type than numbers and strings stays, whatever the text.
    """
    rows = scanned.select(
        F.struct(*[scanned[f"`{c}`"] for c in columns]).alias("row"), scanned[spans_name(columns)].alias("spans"), scanned["text"].alias("text")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(
        x["s"] >= acc["at"],
        F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)).alias("out")),
    ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))
    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = rows.withColumn("new", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    pick = {"text": F.col("new")}
    kind = scanned.schema["n_chars"].dataType if "n_chars" in columns else None
    if isinstance(kind, NumericType | StringType):
        pick["n_chars"] = F.when(F.size("spans") > 0, F.length("new").cast(kind)).otherwise(F.col("row.n_chars"))
    return rows.select(*[pick.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def scan_documents(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per input row.

    Null text counts as empty, null doc_id stays null, repeated rows give repeated results; other columns, whatever
    their names, change nothing.

    An empty table gives no rows; a very long text is scanned whole.
    """
    return digest_columns(scan(documents.select("doc_id", "text"), train(documents, labels), threshold=threshold))

