"""Alignment of two tokenizers: minimal groups by union-find, and corpus-wide counts of linked ids.

Both tokenizers see a space and the text.  Tokens of A and B whose byte ranges overlap are edges of a bipartite graph; its
connected components, by union-find, are exactly the shortest groups between offsets at which tokens of both end.  All
pairs of a group's A and B tokens are links.  A pair of ids counts once for each row of the corpus that links it.

Texts are cut before each space that follows a character other than white space: neither tokenizer has a token across such
a cut (A's pattern takes spaces only in front of other characters; B's vocabulary is searched for pieces that hold one
later on, and if there are any, whole texts are aligned), so what was worked out for a piece of text is remembered.  Rows
are worked on in chunks of at most ``CHUNK_BYTES`` of text, or one longer text.  A chunk keeps its different pairs once,
with the number of its rows that link them, and its rows as places in that list.  So what is shuffled is a chunk's
different pairs, not each document's: they are summed over the corpus (partly before the shuffle), marked if no pair of
their A id has more, and go back to their chunks.  A window over one A id sees at most one row for each entry of B's
vocabulary; a pair occurs once in a chunk, however often its documents hold it.

Null and empty texts, and texts whose bytes B does not give back (U+2581 in the text), have no tokens: zeros and an empty
string.  Each row counts for itself, also repeated ones; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import byte_symbols
from .common import cut, map_columns, ship, slices
from .packing import shared_encoder

CHUNK_BYTES = 8 << 20
#: Characters of remembered pieces of text, for each worker process; then memory starts afresh.
MEMORY = 4 << 20
PIECE = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = (
    "chunk string, codes array<long>, holds array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>,"
    " n_links array<long>, groups_sha256 array<string>, places binary"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>"


class Tokenizers:
    """Ids and bytes of both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True  # their strings are ordinary text
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.ranks = shared_encoder(a_path).fast
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes, self.divisible = {}, True
        for i in range(self.b.get_piece_size()):
            t = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()
            self.divisible &= "▁" not in t.lstrip("▁")
        self.b_space = self.b.piece_to_id("▁")
        self.a_sizes, self.b_sizes = (np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64) for of in (self.a_bytes, self.b_bytes))

    def pieces(self, text: str) -> list[str]:
        return PIECE.findall(" " + text) if self.divisible else [" " + text]

    def give_back(self, raw: list[bytes], ids: list[tuple[list[int], list[int]]]) -> list[bool]:
        """Whether both tokenizers' bytes are those of each piece: compared together, and singly only if that fails."""
        a, b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        whole = b"".join(raw)
        if whole == b"".join(map(a, chain.from_iterable(x for x, _ in ids))) == b"".join(map(b, chain.from_iterable(y for _, y in ids))):
            ends = set(np.cumsum([len(r) for r in raw]).tolist())
            if all(ends <= set(  # the bytes agree, and so do the places where pieces end
                np.cumsum(of[np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64)]).tolist()
            ) for k, of in enumerate((self.a_sizes, self.b_sizes))):
                return [True] * len(raw)
        return [b"".join(map(a, x)) == r == b"".join(map(b, y)) for r, (x, y) in zip(raw, ids)]

    def ids(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B for each piece, which begins with the space that B adds by itself."""
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        # the rank library agrees below U+0250, as the tests of packing show; special tokens' strings are ordinary to it
        fast = [p.isascii() or max(p) < "ɐ" for p in pieces]
        rest = iter(self.a.encode_batch([p for p, f in zip(pieces, fast) if not f], add_special_tokens=False))
        encode = self.ranks.encode_ordinary
        for p, f, y in zip(pieces, fast, b):
            yield encode(p) if f else next(rest).ids, [self.b_space] if p == " " else y


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over n nodes and edges u-v, many at once: the least node of each node's component.

    Every edge hooks the larger of its ends' roots to the smaller; paths are halved until they are flat.
    """
    parent = np.arange(n)
    while True:
        x, y = parent[u], parent[v]
        apart = x != y
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each A token and of each B token in the graph of overlaps, numbered from left to right.

    Both arrays are ascending ends of adjacent tokens, from 0 on, with the same last end.  Between two neighbouring ends
    of either kind lies one token of A and one of B: these are the edges.
    """
    cuts = np.union1d(a_ends, b_ends)
    u, v = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts) + len(a_ends)
    least = roots(len(a_ends) + len(b_ends), u, v)
    number = np.unique(least, return_inverse=True)[1]  # the least node is the component's first A token
    return number[: len(a_ends)], number[len(a_ends) :]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of several ranges, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Memory:
    """What is known of pieces of text: counts, groups as text, links."""

    def __init__(self, tokenizers: Tokenizers):
        self.tok = tokenizers
        self.clear()

    def clear(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__  # a new piece gets the next number
        self.size = 0
        self.texts: list[str] = []
        #: n_a, n_b, n_groups, n_links, whether the bytes come back, first link, links - a row for each piece
        self.table = np.zeros((0, 7), np.int64)
        self.codes = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts by number, and how many each text has; new pieces are learnt."""
        if self.size > MEMORY:
            self.clear()
        get, split = self.known.__getitem__, self.tok.pieces
        found = [np.fromiter(map(get, split(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        self.learn(list(islice(reversed(self.known), len(self.known) - len(self.texts)))[::-1])
        return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 50_000):
            self.learn_some(new[at : at + 50_000])

    def learn_some(self, new: list[str]) -> None:
        tok = self.tok
        ids = list(tok.ids(new))
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64) for k in (0, 1))
        na, nb = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
        raw = [p.encode() for p in new]
        same = np.array(tok.give_back(raw, ids))
        # tokens of pieces that do not come back take no part
        a, b = a[np.repeat(same, na)], b[np.repeat(same, nb)]
        na, nb = na * same, nb * same
        ga, gb = components(np.cumsum(tok.a_sizes[a]), np.cumsum(tok.b_sizes[b])) if len(a) else (a, b)
        n = int(ga[-1]) + 1 if len(a) else 0
        ca, cb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        of = np.repeat(np.arange(len(new)), na)[np.cumsum(ca) - ca]  # the piece of each group: no group crosses pieces
        n_groups, n_links = np.bincount(of, minlength=len(new)), np.bincount(of, ca * cb, minlength=len(new)).astype(np.int64)
        # every pair of A and B tokens in a group, summed by piece
        left = np.repeat(np.arange(len(a)), cb[ga])
        right = spread((np.cumsum(cb) - cb)[ga], cb[ga])
        code, piece = a[left] << 32 | b[right], of[ga[left]]
        order = np.lexsort((code, piece))
        code, piece = code[order], piece[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (piece[1:] != piece[:-1])
        where = np.flatnonzero(first)
        held = np.bincount(piece[first], minlength=len(new))
        begin = np.cumsum(held) - held + len(self.codes)
        self.codes = np.concatenate([self.codes, code[first]])
        self.times = np.concatenate([self.times, np.diff(np.append(where, len(code)))])
        self.table = np.concatenate([self.table, np.stack([na, nb, n_groups, n_links, same.astype(np.int64), begin, held], axis=1)])
        self.texts += self.written(a, b, ga, gb, na + nb)
        self.size += sum(map(len, new))

    def written(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, sizes: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each piece."""
        if not len(a):
            return [""] * len(sizes)
        group, side = np.concatenate([ga, gb]), np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        group, side, ids = group[order], side[order], np.concatenate([a, b])[order]
        mark = np.where(np.append(side[1:] == side[:-1], False) & np.append(group[1:] == group[:-1], False), ",", np.where(side == 0, "|", ";"))
        parts = list(map(str.__add__, map(str, ids.tolist()), mark.tolist()))
        ends = np.cumsum(sizes).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip([0, *ends], ends)]


@lru_cache(maxsize=1)
def shared_memory(a_path: str, b_path: str) -> Memory:
    return Memory(Tokenizers(a_path, b_path))


def aligned_chunk(memory: Memory, texts: list[str | None]) -> dict:
    """One row of ``CHUNKS``, without its name and ids."""
    pieces, sizes = memory.numbers(texts)
    n, doc = len(texts), np.repeat(np.arange(len(texts)), sizes)
    lost = np.bincount(doc, memory.table[pieces, 4] == 0, minlength=n) > 0  # bytes of the text do not come back
    at = np.cumsum(sizes) - sizes
    shas = [
        hashlib.sha256(";".join(map(memory.texts.__getitem__, pieces[x : x + k].tolist())).encode()).hexdigest() if k and not out else ""
        for x, k, out in zip(at.tolist(), sizes.tolist(), lost.tolist())
    ]
    keep = ~lost[doc]
    doc, pieces = doc[keep], pieces[keep]
    counts = [np.bincount(doc, memory.table[pieces, k], minlength=n).astype(np.int64) for k in range(4)]
    # different pieces of each document, then its different pairs
    wide = max(1, len(memory.texts))
    seen, often = np.unique(doc * wide + pieces, return_counts=True)
    doc, pieces = seen // wide, seen % wide
    begin, held = memory.table[pieces, 5], memory.table[pieces, 6]
    links = spread(begin, held)
    codes, pair = np.unique(memory.codes[links], return_inverse=True)
    key, back = np.unique(np.repeat(doc, held) * max(1, len(codes)) + pair, return_inverse=True)
    times = np.bincount(back, memory.times[links] * np.repeat(often, held)).astype(np.int64)
    doc, pair = key // max(1, len(codes)), key % max(1, len(codes))
    holds = np.bincount(pair, minlength=len(codes))
    # places rise within a document: their differences are small numbers
    steps = np.diff(pair, prepend=0)
    first = np.diff(doc, prepend=-1) != 0
    steps[first] = pair[first]
    per_doc = np.bincount(doc, minlength=n)
    packed = zlib.compress(b"".join(x.astype("<i4").tobytes() for x in (per_doc, steps, times)), 1)
    return {k: [c] for k, c in zip(COUNTS, counts)} | {"codes": [codes], "holds": [holds], "groups_sha256": [shas], "places": [packed]}


def summed(packed: bytes, n: int, seen: np.ndarray, best: np.ndarray) -> tuple[list[int], list[int]]:
    """For each of n documents the sum of counts over links, and the number of links whose count is its A id's highest."""
    raw = np.frombuffer(zlib.decompress(packed), "<i4").astype(np.int64)
    sizes, rest = raw[:n], raw[n:]
    steps, times = rest[: len(rest) // 2], rest[len(rest) // 2 :]
    last = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(steps)])
    at = total[1:] - np.repeat(total[last - sizes], sizes)
    out = []
    for weight in (seen, best):
        run = np.concatenate([[0], np.cumsum(times * weight[at])]) if len(at) else np.zeros(1, np.int64)
        out.append((run[last] - run[last - sizes]).tolist())
    return out[0], out[1]


def chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of the corpus, aligned, in chunks; written once, so that names of chunks are the same for whoever reads."""

    schema = StructType.fromDDL(CHUNKS)  # needs the session

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, kind, n = shared_memory(a_path, b_path), to_arrow_schema(schema), 0
        for batch in batches:
            for part in slices(batch, CHUNK_BYTES):
                if part.num_rows:
                    row = aligned_chunk(memory, part.column(1).to_pylist())
                    row |= {"chunk": [f"{TaskContext.get().partitionId()}-{n}"], "doc_id": [part.column(0).to_pylist()]}
                    n += 1
                    yield pa.RecordBatch.from_arrays([pa.array(row[f.name], type=f.type) for f in kind], schema=kind)

    ship(docs.sparkSession)
    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNKS))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code, seen, best: for each linked pair (A id << 32 | B id) the rows that link it, and whether no pair of A has more."""
    held = aligned.select(F.explode(F.arrays_zip("codes", "holds")).alias("p")).select("p.*")
    counts = held.groupBy(F.col("codes").alias("code")).agg(F.sum("holds").alias("seen"))
    most = F.max("seen").over(Window.partitionBy(F.shiftright("code", 32)))  # at most B's vocabulary in one partition
    return counts.withColumn("best", (F.col("seen") == most).cast("int"))


def translations(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, seen, best: the linked ids of the corpus."""
    code = F.col("code")
    return pair_counts(chunks(docs, a_path, b_path)).select(
        F.shiftright(code, 32).cast("int").alias("a_id"), code.bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "seen", F.col("best").cast("boolean").alias("best")
    )


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every minimal group: its byte range in space + text, and its ids."""

    def make():
        tok = shared_memory(a_path, b_path).tok

        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "end", "a_ids", "b_ids")}
            for doc_id, text in zip(cols["doc_id"], cols["text"]):
                at, rows = 0, []
                pieces = tok.pieces(text) if text else []
                ids = list(tok.ids(pieces))
                if all(tok.give_back([p.encode() for p in pieces], ids)) and pieces:
                    a, b = (np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64) for k in (0, 1))
                    last = np.cumsum(tok.a_sizes[a])
                    ga, gb = components(last, np.cumsum(tok.b_sizes[b]))
                    for x, y in zip(np.split(np.arange(len(a)), np.flatnonzero(np.diff(ga)) + 1), np.split(b, np.flatnonzero(np.diff(gb)) + 1)):
                        rows.append((doc_id, at, int(last[x[-1]]), a[x].tolist(), y.tolist()))
                        at = int(last[x[-1]])
                for row in rows:
                    for k, v in zip(out, row):
                        out[k].append(v)
            return out

        return run

    ship(docs.sparkSession)
    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), GROUPS, make)


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: tokens, groups, links, links whose count is their A id's highest, sum of counts over links."""
    aligned = chunks(docs, a_path, b_path)
    held = aligned.select("chunk", F.posexplode("codes").alias("at", "code"))
    known = held.join(pair_counts(aligned), "code").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "seen", "best"))).alias("p"))
    known = known.select("chunk", F.col("p.seen").alias("seen"), F.col("p.best").alias("best"))
    rows = aligned.drop("codes", "holds").join(known, "chunk", "left")  # chunks without any link stay

    def make():
        def run(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {f.split()[0]: [] for f in ALIGNED.split(", ")}
            for i, ids in enumerate(cols["doc_id"]):
                seen, best = (np.array(cols[k][i] or [], np.int64) for k in ("seen", "best"))
                count_sum, n_best = summed(cols["places"][i], len(ids), seen, best)
                out["doc_id"] += ids
                out["count_sum"] += count_sum
                out["n_best"] += n_best
                for k in (*COUNTS, "groups_sha256"):
                    out[k] += cols[k][i]
            return out

        return run

    return map_columns(rows, ALIGNED, make)
