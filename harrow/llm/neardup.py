"""Near duplicates by SimHash, checked by exact Jaccard similarity of word shingles; MinHash bands add candidates.

Texts with the same set of shingles are one class.  Classes whose SimHash fingerprints are joined by links of a few
differing bits (pivot distance tables, ``simhash.links``) meet in a bucket.  At a similarity of 0.8 fingerprints mostly
differ by more, so classes that share a band of minima meet in a bucket as well; buckets with
the same members are looked at once, and large ones are compared in blocks against blocks.  A bucket compares all its
pairs exactly and passes on a spanning forest of the links, never all pairs.  Of pairs at the threshold of 0.8 a share
of (1 - 0.8 ** ROWS) ** BANDS, 3e-6, has no band in common, and far fewer of more similar ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_columns
from .graph import components
from .simhash import LOWER, RADIUS, fingerprint, keep_first, signed
from .simhash import links as fingerprint_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
SEED = 42
#: Classes of a bucket that are compared at once; larger buckets are split.
BLOCK = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; shorter texts are one shingle, wordless ones the zero."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    g = np.full(n, min(len(h), width), dtype=np.uint64)
    for i in range(min(len(h), width)):
        g = mixed(g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(g)


def make_bands(width: int, bands: int, rows: int):
    salts = np.random.default_rng(SEED).integers(0, 1 << 64, bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(cols: dict[str, list]) -> dict[str, list]:
        from xxhash import xxh64_intdigest

        sids, out, fps = [], [], []
        for text in cols["text"]:
            fps.append(signed(fingerprint(text or "")))
            s = shingles(text or "", width)
            sids.append(signed(xxh64_intdigest(s.tobytes(), SEED)))
            low = np.full(len(salts), (1 << 64) - 1, dtype=np.uint64)
            for at in range(0, len(s), 512):
                x = s[at : at + 512, None] * salts
                low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=0))
            out.append([signed(xxh64_intdigest(x.tobytes(), b)) for b, x in enumerate(low.reshape(bands, rows))])
        return {"doc_id": cols["doc_id"], "text_key": cols["text_key"], "sid": sids, "fp": fps, "bands": out}

    return run


def make_sets(width: int):
    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"sid": cols["sid"], "set": [shingles(t or "", width).view(np.int64) for t in cols["text"]]}

    return run


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with at least this Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    label, out = np.arange(len(sets)), []
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    for i in range(len(sets) - 1):
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[own] = 0
        near = i + 1 + np.flatnonzero(both >= similarity * (sizes[i] + sizes[i + 1 :] - both) - 1e-9)
        for j in near:
            if label[i] != label[j]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
        if (label == label[0]).all():
            break
    return out


def bucket_links(similarity: float):
    """Over rows (key, sid, set) sorted by key: a spanning forest of each bucket's links."""

    def work(rows: list[tuple[int, np.ndarray]]) -> tuple[list[int], list[int]]:
        pairs = similar([s for _, s in rows], similarity) if len(rows) > 1 else []
        return [rows[i][0] for i, _ in pairs], [rows[j][0] for _, j in pairs]

    def batch_of(src: list[int], dst: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        last = None
        for batch in batches:
            src, dst = [], []
            keys, sids, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, key in enumerate(keys):
                if key != last and held:
                    a, b = work(held)
                    src, dst, held = src + a, dst + b, []
                last = key
                held.append((sids[i], sets[i].values.to_numpy()))
            yield batch_of(src, dst)
        yield batch_of(*work(held))

    return run


def fingerprint_groups(own: DataFrame, radius: int) -> DataFrame:
    """(sid, key): classes by the group of their fingerprints, those joined by links of at most ``radius`` bits."""
    classes = cut(own.select("sid", "fp").distinct())
    groups = components(fingerprint_links(classes.select("fp").distinct(), radius=radius))
    root = F.coalesce("root", "fp")
    return classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("sid", F.xxhash64(F.lit("fp"), root).alias("key")).distinct()


def links(docs: DataFrame, own: DataFrame, *, width: int, similarity: float, radius: int, block: int) -> DataFrame:
    """(src, dst): a spanning forest of the similar classes, from docs and their doc_id, text_key, sid, fp and bands."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep")
    classes = cut(own.groupBy("sid").agg(rep, F.first("bands").alias("bands")))
    rows = classes.select("sid", F.posexplode("bands").alias("band", "v")).select("sid", F.xxhash64("band", "v").alias("key"))
    rows = rows.unionByName(fingerprint_groups(own, radius))
    met = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("sid").alias("members"), F.sum(F.shiftright("sid", 20)).alias("more")).where("n > 1")
    met = met.groupBy("n", "members", "more").agg(F.min("key").alias("key")).select("key", "n")
    rows = cut(rows.join(met, "key"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sid", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    needed = classes.join(rows.select("sid").distinct(), "sid").select("sid", F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.text_key").alias("rep_text_key"))
    texts = docs.join(needed, (F.col("text_key") == F.col("rep_text_key")) & F.col("doc_id").eqNullSafe(F.col("rep_doc_id")))
    sets = map_columns(texts.select("sid", "text"), "sid long, set array<long>", make_sets, width).dropDuplicates(["sid"])
    dealt = rows.join(sets, "sid").select("key", "sid", "set").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(bucket_links(similarity), "src long, dst long")


def keep_one(docs: DataFrame, *, width: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row of each group of near duplicates, all columns: that of the smallest doc_id, then of the smallest text hash.

    Groups are joined by pairs with at least this Jaccard similarity of their sets of word shingles; words are split at
    ASCII white space and compared with A-Z lower-cased.  Null and wordless texts are equal.  Rows without doc_id come
    last; of rows equal in doc_id and text one stays.
    """
    slim = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    own = cut(map_columns(slim, "doc_id long, text_key long, sid long, fp long, bands array<long>", make_bands, width, bands, rows))
    found = cut(links(slim, own, width=width, similarity=similarity, radius=radius, block=block))
    comp = components(found).withColumnRenamed("node", "sid")
    own = own.select("doc_id", "text_key", "sid").join(comp, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return keep_first(docs, own)
