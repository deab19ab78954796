"""Exact substring deduplication by external induced sorting.

A window of ``window`` bytes that starts anywhere else is repeated, and every byte a repeated window covers goes.  Each
window is represented by the least of its k-grams by hash (a minimizer): equal windows have equal minimizers at equal
places.  So only places around minimizers that occur twice or more matter:

* if the whole surroundings of two occurrences are equal (a 64-bit digest beside the minimizer's 64-bit hash), everything there is repeated, and no sorting is needed;
* the distinct surroundings of one minimizer are laid side by side, aligned at it, and sorted from right to left by
  external induction (see ``induced``): tuples of suffix and common prefix in a disk-backed priority queue, recurring
  one place to the left at a time.  A suffix whose neighbour shares a whole window starts a repeated one.

Equal windows meet in one shard because they share a minimizer, at the same place; suffixes at different places are
never compared, which is what keeps the recursion to one queue a place.  A shard may be far larger than memory.  Only
minimizers so common that one shard would hold up the job are settled by counting digests instead (``hot_cover``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .induced import repeated_windows

WINDOW = 400
GRAM = 32
#: Strings sorted together, at least; a larger group stays whole and goes to disk.
SHARD_STRINGS = 1 << 15
#: A minimizer with more occurrences is not sorted in one shard.  Its windows are told apart by where it lies in them,
#: in this many ranges, by the bytes that all windows of a range have in common, and then one by one.
HOT_FORMS = 1 << 16
RANGES = 16
#: Copies of the totals of repeated minimizers that its surroundings are dealt to.
SALTS = 8
POSITION_BITS = np.uint64((1 << 32) - 1)


def tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 64, 256, dtype=np.uint64), rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTES, ODD = tables()


def gram_hashes(raw: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of each k-gram (k a power of two), by doubling."""
    h, size, i = BYTES[np.frombuffer(raw, dtype=np.uint8)], 1, 0
    while size < gram:
        h = h[:-size] * ODD[i] + h[size:]
        size, i = size * 2, i + 1
    h ^= h >> np.uint64(29)
    h *= ODD[7]
    return h ^ (h >> np.uint64(32))


def minimizers(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the least k-gram of each window, the leftmost of equals."""
    if len(raw) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(raw, gram)
    w, n = window - gram + 1, len(raw) - gram + 1
    key = (h & ~POSITION_BITS) | np.arange(n, dtype=np.uint64)
    pad = -n % w
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    least = least[np.r_[True, least[1:] != least[:-1]]]
    at = (least & POSITION_BITS).astype(np.int64)
    return at, h[at]


def surroundings(raw: bytes, at: int, window: int, gram: int) -> tuple[int, int]:
    """Bounds of all windows around the k-gram at a place."""
    return max(0, at - (window - gram)), min(len(raw), at + window)


def mark_schema(names: list[str], kinds: list) -> pa.Schema:
    return pa.schema(list(zip(names, kinds, strict=True)))


def anchor_rows(window: int, gram: int):
    """(key, text) to (key, a, r, at): minimizer and digest of its surroundings."""
    schema = mark_schema(["key", "a", "r", "at"], [pa.binary(), pa.int64(), pa.int64(), pa.int32()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for part in slices(batch):
                keys, hashes, digests, places = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    at, h = minimizers(raw, window, gram)
                    keys += [key] * len(at)
                    hashes.append(h)
                    places.append(at)
                    for i in at.tolist():
                        lo, hi = surroundings(raw, i, window, gram)
                        digests.append(xxh3_64_intdigest(raw[lo:hi], seed=i - lo))
                h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
                p = np.concatenate(places) if places else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(h.view(np.int64)), pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(p.astype(np.int32))], schema=schema
                )

    return run


def ranges(window: int, gram: int, parts: int = RANGES) -> list[tuple[int, int]]:
    """Bounds (both included) of the number of bytes that a window has before its minimizer."""
    edges = [(window - gram + 1) * i // parts for i in range(parts + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False) if b > a]


STRINGS = "a long, r long, lead int, s binary"
PARTS = "part int, core binary, head binary, tail binary, a long, r long"


def string_rows(window: int, gram: int):
    """(text, wanted list of (a, r, at)) to STRINGS: surroundings, and the number of bytes before the minimizer."""
    schema = mark_schema(["a", "r", "lead", "s"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2 << 20):
                rows = []
                for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    for x in wanted:
                        lo, hi = surroundings(raw, x["at"], window, gram)
                        rows.append((x["a"], x["r"], x["at"] - lo, raw[lo:hi]))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)], schema=schema)

    return run


def sort_shards(window: int, gram: int, shard_strings: int):
    """STRINGS, sorted by a, to (a, r, cover): bounds of repeated stretches around the minimizer, in pairs."""
    schema = mark_schema(["a", "r", "cover"], [pa.int64(), pa.int64(), pa.list_(pa.int32())])
    reach = window - gram

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        strings = [(reach - lead, s) for _, _, lead, s in rows]
        covers: dict[int, list[int]] = {}
        ids, first, last = repeated_windows(reach + window, window, reach, strings)
        for i in np.lexsort((first, ids)):
            covers.setdefault(int(ids[i]), []).extend((int(first[i]) - reach, int(last[i]) - reach + window))
        hits = sorted(covers)
        columns = [[rows[i][0] for i in hits], [rows[i][1] for i in hits], [covers[i] for i in hits]]
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= shard_strings and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield shard(rows)

    return run


def part_rows(window: int, gram: int):
    """(text, wanted) to PARTS: for each range of windows, a digest of the bytes all of them have, and those at the ends."""
    schema = mark_schema(["part", "core", "head", "tail", "a", "r"], [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])
    split = ranges(window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch, 2 << 20):
                rows = []
                for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    for x in wanted:
                        at = x["at"]
                        lo, hi = surroundings(raw, at, window, gram)
                        for k, (least, most) in enumerate(split):
                            a, b = at - least, at + window - most
                            if lo <= a and b <= hi:
                                rows.append((k, xxh3_128_digest(raw[a:b], seed=k), raw[max(lo, at - most) : a], raw[b : min(hi, at + window - least)], x["a"], x["r"]))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)], schema=schema)

    return run


def window_rows(window: int, gram: int):
    """PARTS to (w, before, a, r): a digest of each window, and the number of its bytes before the minimizer."""
    schema = mark_schema(["w", "before", "a", "r"], [pa.binary(), pa.int32(), pa.int64(), pa.int64()])
    split = ranges(window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for k, core, head, tail, a, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least, most = split[k]
                for d in range(max(least, most - len(tail)), min(most, least + len(head)) + 1):
                    own = core + head[len(head) - (d - least) :] + tail[: most - d]
                    rows.append((xxh3_128_digest(own, seed=d), d, a, r))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)], schema=schema)

    return run


def among(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with the count of rows of their key; counts are pre-aggregated, and a hot key's rows dealt by salt."""
    counts = rows.groupBy(*key).agg(F.count("*").alias(name)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("r", F.lit(SALTS)).cast("int")).join(counts, [*key, "salt"]).drop("salt")


def hot_cover(parts: DataFrame, window: int, gram: int) -> DataFrame:
    """(a, r, cover) for hot minimizers, by counting: a group of any size is spread over the cluster.

    Windows of a range share its core.  A core found once repeats no window; equal ends repeat all of its range; what
    is left, mostly the edges of a very common passage, is settled window by window.
    """
    split = F.array(*[F.array(F.lit(-most), F.lit(window - least)) for least, most in ranges(window, gram)])
    own = cut(among(among(parts, ["core"], "same_core").where("same_core > 1"), ["core", "head", "tail"], "same"))
    whole = own.where("same > 1").select("a", "r", F.get(split, F.col("part")).alias("cover"))
    open_parts = own.where("same = 1").select("part", "core", "head", "tail", "a", "r")
    # The other copies of an equal stretch count as one partner for these.
    partners = own.where("same > 1").groupBy("part", "core", "head", "tail").agg(F.min("a").alias("a"), F.min("r").alias("r"))
    windows = open_parts.unionByName(partners).mapInArrow(window_rows(window, gram), "w binary, before int, a long, r long")
    single = among(windows, ["w"], "same").where("same > 1").select("a", "r", F.array(-F.col("before"), window - F.col("before")).alias("cover"))
    return whole.unionByName(single).groupBy("a", "r").agg(F.flatten(F.collect_set("cover")).alias("cover"))


def repeated_cover(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, shard_strings: int = SHARD_STRINGS, hot_forms: int = HOT_FORMS) -> DataFrame:
    """(key, spans): for each distinct text (key: its MD5 digest) with repeats, places and bounds of repeated stretches."""
    texts = docs.select(F.unhex(F.md5("text")).alias("key"), "text").where(F.octet_length("text") >= window)
    # Cheap enough to make twice, and larger on disk than anything else here.
    anchors = texts.mapInArrow(anchor_rows(window, gram), "key binary, a long, r long, at int")
    # Copies of one place meet in counts, which are partly summed before the shuffle.
    forms = anchors.groupBy("a", "r").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("at"))
    forms = forms.withColumn("at", F.struct("at.key", "at.at"))
    totals = anchors.groupBy("a").agg(F.count("*").alias("total")).where("total > 1")
    # A minimizer may have a third of all surroundings: they are dealt by salt, the totals copied to each.
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    forms = cut(forms.withColumn("salt", F.pmod("r", F.lit(SALTS)).cast("int")).join(totals, ["a", "salt"]).drop("salt"))
    mixed = forms.where("n < total")  # others have the minimizer, with other surroundings

    def surroundings_of(places: DataFrame, make, schema: str) -> DataFrame:
        wanted = places.select(F.col("at.key").alias("key"), F.struct("a", "r", F.col("at.at").alias("at")).alias("x"))
        wanted = wanted.groupBy("key").agg(F.collect_list("x").alias("wanted"))  # no more than the places of one text
        once = texts.join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
        return once.select("text", "wanted").mapInArrow(make(window, gram), schema)

    strings = surroundings_of(mixed.where(F.col("total") <= hot_forms), string_rows, STRINGS)
    sorted_strings = strings.repartition("a").sortWithinPartitions("a")
    part = sorted_strings.mapInArrow(sort_shards(window, gram, shard_strings), "a long, r long, cover array<int>")
    hot = mixed.where(F.col("total") > hot_forms)
    if not hot.isEmpty():
        part = part.unionByName(hot_cover(cut(surroundings_of(hot, part_rows, PARTS)), window, gram))
    whole = F.array(F.lit(-(window - gram)), F.lit(window))  # bounds of the text cut these
    cover = forms.where("n > 1").select("a", "r", whole.alias("cover")).unionByName(
        part.join(forms.where("n = 1").select("a", "r"), ["a", "r"], "left_semi")
    )
    cover = cut(cover)
    # A set, so that copies of a text bring their places once for each task; no more than the places of one text.
    return anchors.join(cover, ["a", "r"]).groupBy("key").agg(F.collect_set(F.struct("at", "cover")).alias("spans"))


def removed_runs(n: int, spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered."""
    pairs = []
    for x in spans or ():
        at, cover = x["at"], x["cover"]
        pairs += [(max(0, at + cover[i]), min(n, at + cover[i + 1])) for i in range(0, len(cover), 2)]
    out: list[list[int]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def strip(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return b"".join(kept)


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with ``harrow_spans``; null for texts without repeats."""
    cover = repeated_cover(docs, **options).withColumnsRenamed({"key": "harrow_key", "spans": "harrow_spans"})
    return docs.withColumn("harrow_key", F.unhex(F.md5(F.coalesce("text", F.lit(""))))).join(cover, "harrow_key", "left").drop("harrow_key")


def deduplicate(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, shard_strings: int = SHARD_STRINGS, hot_forms: int = HOT_FORMS, with_runs: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and runs, the removed byte ranges, if asked for), a row per input row.

    Null text counts as empty; texts shorter than the window lose nothing.  A row repeated as a whole is a second
    place like any other, so it loses its text.  Null doc_id stays null; other columns are ignored.

    An empty table gives no rows.  A very long text is mapped by one task; its windows are dealt out like all others.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", runs array<array<int>>" if with_runs else "")
    rows = with_spans(docs.select("doc_id", "text"), window=window, gram=gram, shard_strings=shard_strings, hot_forms=hot_forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc_id, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "harrow_spans")), strict=True):
                    raw = (text or "").encode()
                    runs = removed_runs(len(raw), spans)
                    row = (doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(strip(raw, runs)).hexdigest())
                    out.append(row + ((runs,) if with_runs else ()))
                kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
                kinds += [("runs", pa.list_(pa.list_(pa.int32())))] if with_runs else []
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    return rows.mapInArrow(run, schema)


def strip_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without the repeated bytes; n_chars follows the text.

    Characters cut in the middle lose their other bytes too.  A document whose text was removed in full goes.

    Null texts and texts without repeats stay as they are, empty ones too; of a row repeated as a whole both lose a text of
    the window's length or more.  An empty table stays empty.
    """
    names = docs.columns
    rows = with_spans(docs.select(F.struct(*[docs[c] for c in names]).alias("row"), "text"), **options)
    rows = rows.select("row.*", "harrow_spans").toDF(*[f"c{i}" for i in range(len(names) + 1)])  # by place: no name can clash
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import NumericType, StringType, StructField, StructType

    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    kind = to_arrow_schema(schema)
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else -1
    counted = chars_at >= 0 and isinstance(schema[chars_at].dataType, NumericType | StringType)  # of another type it stays
    number = str if counted and isinstance(schema[chars_at].dataType, StringType) else int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, keep = [], []
                for text, spans in zip(part.column(text_at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    if text is None or not spans:
                        texts.append(text)
                        keep.append(True)
                        continue
                    raw = text.encode()
                    texts.append(strip(raw, removed_runs(len(raw), spans)).decode(errors="ignore"))
                    keep.append(bool(texts[-1]))
                columns = list(part.columns[: len(names)])
                columns[text_at] = pa.array(texts, kind.field(text_at).type)
                if counted:
                    old, spans = columns[chars_at].to_pylist(), part.column(len(names)).to_pylist()
                    columns[chars_at] = pa.array([o if not x else number(len(t)) for o, x, t in zip(old, spans, texts, strict=True)], kind.field(chars_at).type)
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, kind, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=kind).filter(pa.array(keep))

    return rows.mapInArrow(run, schema)
