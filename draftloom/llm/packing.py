"""Best-fit packing of tokenised documents into sequences by linear grouping.

Documents are tokenised once; what remains is a table of pieces with their lengths. Lengths are at
most LENGTH, so the problem is a histogram of at most LENGTH counts, at any number of documents, and
is solved on the driver:

* lengths above LENGTH / 5 are large: they are put in GROUPS groups of equal cardinality by size and
  rounded up to the largest of their group;
* all configurations of the rounded sizes that fit are enumerated; the linear programme of fewest
  sequences is solved exactly by a revised simplex method and rounded up;
* the actual lengths take the places of their group, longest first;
* small lengths, longest first, go to the sequence with the least room that holds them, in bulk: all
  sequences of equal content are one class with a count.

Then each piece finds its place by its rank among pieces of its length. Ranks need no task to hold a
whole length: pieces are dealt into about a square root of all by hash, counted, and ranked inside.

Cases: a null or empty text is one piece of length 1, the end token; pieces of LENGTH tokens have a
sequence of their own; very long texts are cut and otherwise whole; repeated rows are packed each;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations_with_replacement, islice, pairwise

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, tidy

LENGTH, END, GROUPS = 4096, 1, 20
#: Words whose tokens a worker remembers at a time, some 250 bytes each (a batch more before it forgets); it forgets for speed alone.
REMEMBERED = 200_000
#: Characters tokenised at a time.
CHARACTERS = 1 << 20

_WORD = re.compile(WORD)
#: Texts of these characters only are cut as the vocabulary cuts them, by one expression: letters of
#: Latin-1, single digits, runs of ASCII marks. An apostrophe can start a cut of its own; not here.
_PLAIN = re.compile(r"[\x20\x09-\x0D!-&(-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
_PIECE = re.compile(r"[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[!-/:-@\[-`{-~]+")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbers(dict):
    """Numbers words in the order they come; fresh holds those that have no tokens yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def merges_of(path: str):
    """The vocabulary's merges as an engine of bytes that is several times as fast, and its ids by the engine's.

    A piece goes in as its bytes and a last byte 255 that UTF-8 lacks; byte and end join first, as the
    vocabulary has them for one symbol. Then the engine joins whatever makes a known token, the
    vocabulary only the two halves it lists. Both do the same if each token's own text is encoded as
    that token: what happens inside of it does not depend on what is around it. A test checks that.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    vocab, ids, ranks = model["vocab"], {}, {}

    def put(token: str, rank: int) -> None:
        body = token.removesuffix("</w>")
        ranks[bytes(byte_of[c] for c in body) + (b"\xff" if body != token else b"")] = rank
        ids[rank] = vocab[token]

    for c, b in byte_of.items():
        put(c + "</w>", b)
    for i, (left, right) in enumerate(model["merges"], 256):
        put(left + right, i)
    for c, b in byte_of.items():
        put(c, len(model["merges"]) + 256 + b)
    table = np.zeros(max(ids) + 1, "<u4")
    table[list(ids)] = list(ids.values())
    return tiktoken._tiktoken.CoreBPE(ranks, {}, r"\S+").encode_single_piece, table


class WordTokens:
    """Tokens of texts as little-endian unsigned 32-bit numbers, word by word.

    The vocabulary drops white space, works in lower case and never joins across what it cuts at; the
    same words come again and again, so their tokens are kept. Words of other than plain characters,
    and those that name a special token, are left to the tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.remembered, self.tokenizer = path, remembered, None
        self.encode, self.ids = merges_of(path)
        self.numbers, self.known = _Numbers(), []

    def others(self, words: list[str]) -> list[list[int]]:
        if not self.tokenizer:
            # Workers fill the cores already; the tokenizer's own threads would only spin beside them.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self) -> None:
        """Tokens of the fresh words."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        ranks, stops, rest, encode = [], [0], [], self.encode
        for i, w in enumerate(fresh, len(self.known)):
            if _PLAIN.fullmatch(w) and "<|" not in w:
                for piece in _PIECE.findall(w.lower()):
                    ranks += encode(piece.encode() + b"\xff")
            else:
                rest.append(i)
            stops.append(len(ranks) * 4)
        ids, first = self.ids[np.array(ranks, np.int64)].tobytes(), len(self.known)
        self.known += [ids[s:e] for s, e in pairwise(stops)]
        for i, e in zip(rest, self.others([fresh[i - first] for i in rest]) if rest else (), strict=True):
            self.known[i] = np.array(e, "<u4").tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:  # words that came early come often: the first half stays
            half = self.remembered // 2
            old, self.numbers, self.known = self.numbers, _Numbers(), self.known[:half]
            self.numbers.update(islice(old.items(), half))
        number = self.numbers.__getitem__
        cut = [list(map(number, x.lower().split() if _PLAIN.fullmatch(x) and "<|" not in x else _WORD.findall(x))) for x in texts]
        self.learn()
        known = self.known
        return [b"".join([known[i] for i in c]) for c in cut]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


_kept: dict[str, WordTokens] = {}


def tokens_by(path: str, remembered: int = REMEMBERED) -> WordTokens:
    """One for each worker process, so that what it knows outlasts a task."""
    if path not in _kept:
        _kept[path] = WordTokens(path, remembered)
    _kept[path].remembered = remembered
    return _kept[path]


def some(column) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow column (null: empty), some CHARACTERS of them at a time, and the number of the first."""
    now, at, size = [], 0, 0
    for i, text in enumerate(column):
        now.append(text.as_py() or "")
        size += len(now[-1])
        if size >= CHARACTERS:
            yield at, now
            now, at, size = [], i + 1, 0
    if now:
        yield at, now


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; remembered: pieces a worker keeps the tokens of."""
    path = path or vocabulary()

    def run(batches):
        import pyarrow as pa

        tokens, end = tokens_by(path, remembered), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for at, texts in some(batch.column("text")):
                for i, ids in enumerate(tokens.many(texts), at):
                    ids += end
                    for k in range(0, len(ids), 4 * length):
                        part = ids[k : k + 4 * length]
                        rows.append((i, k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(cols[0], pa.int32())), "piece": pa.array(cols[1], pa.int32()), "start": pa.array(cols[2], pa.int64()), "length": pa.array(cols[3], pa.int64()), "ids_crc32": pa.array(cols[4], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], length: int) -> np.ndarray:
    """All multisets of sizes that fit in length, as counts."""
    out = set()
    for n in range(1, length // min(sizes) + 1):
        for c in combinations_with_replacement(range(len(sizes)), n):
            if sum(sizes[i] for i in c) <= length:
                out.add(c)
    a = np.zeros((len(out), len(sizes)))
    for r, c in enumerate(sorted(out)):
        for i in c:
            a[r, i] += 1
    return a


def fewest(sizes: list[int], need: list[int], length: int) -> list[tuple[list[int], int]]:
    """Configurations (counts by size) and how often each is used, covering need in the fewest by linear programme."""
    a = configurations(sizes, length)
    n = len(sizes)
    basis = np.zeros((n, n))
    for i, s in enumerate(sizes):
        basis[i, i] = length // s
    need_ = np.array(need, float)
    for _ in range(2000):
        inverse = np.linalg.inv(basis.T)  # basis rows are configurations: basis.T @ x = need
        x = inverse @ need_
        dual = np.ones(n) @ inverse
        gain = a @ dual - 1
        j = int(gain.argmax())
        if gain[j] <= 1e-9:
            break
        d = inverse @ a[j]
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[int(ratio.argmin())] = a[j]
    return [([int(c) for c in row], int(np.ceil(k - 1e-6))) for row, k in zip(basis, np.linalg.inv(basis.T) @ need_, strict=True) if k > 1e-6]


def plan(counts: dict[int, int], length: int = LENGTH, groups: int = GROUPS) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Classes of sequences (how many, room left, [(length, times)...]) that hold counts, a number for each length."""
    large = length // 5
    classes: list[list] = []
    if counts.get(length):
        classes.append([counts[length], 0, [(length, 1)]])
    # Groups of equal cardinality, longest first.
    sized = sorted(((n, k) for n, k in counts.items() if large < n < length and k), reverse=True)
    total = sum(k for _, k in sized)
    runs: list[list[list[int]]] = []
    if total:
        each = -(-total // groups)
        now: list[list[int]] = []
        room = each
        for n, k in sized:
            while k:
                t = min(k, room)
                now.append([n, t])
                k -= t
                room -= t
                if not room:
                    runs.append(now)
                    now, room = [], each
        if now:
            runs.append(now)
        merged: dict[int, list[list[int]]] = {}
        for g in runs:  # groups of the same largest length are one
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        for config, times in fewest(sizes, [sum(k for _, k in merged[s]) for s in sizes], length):
            open_ = [[times, length, []]]
            for s, a in zip(sizes, config, strict=True):
                queue = merged[s]
                for _ in range(a):
                    after = []
                    for m, room, items in open_:
                        while m and queue:
                            n, k = queue[0]
                            t = min(m, k)
                            after.append([t, room - n, [*items, (n, 1)]])
                            m -= t
                            queue[0][1] -= t
                            if not queue[0][1]:
                                queue.pop(0)
                        if m:
                            after.append([m, room, items])
                    open_ = after
            classes += [c for c in open_ if c[2]]
        for s in sizes:  # nothing is left but by rounding of numbers
            for n, k in merged[s]:
                classes.append([k, length - n, [(n, 1)]])
    # Best fit of the small ones.
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(c: list) -> None:
        if c[1] not in by_room:
            by_room[c[1]] = []
            insort(rooms, c[1])
        by_room[c[1]].append(c)

    for c in classes:
        put(c)
    for n in sorted((n for n, k in counts.items() if n <= large and n < length and k), reverse=True):
        k = counts[n]
        while k:
            i = bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                c = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
                m, room, items = c
            else:
                m, room, items = k, length, []
            q = min(room // n, k)
            t = min(m, k // q)
            put([t, room - q * n, [*items, (n, q)]])
            k -= t * q
            if m > t and items:
                put([m - t, room, items])
    return [(m, room, items) for cs in by_room.values() for m, room, items in cs]


def places(classes: list[tuple[int, int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, runs of ranks: first rank, first sequence, times in a sequence, first offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for m, _, items in classes:
        at = 0
        for n, q in items:
            out.setdefault(n, []).append((used.get(n, 0), base, q, at))
            used[n] = used.get(n, 0) + m * q
            at += n * q
        base += m
    return {n: np.array(r, np.int64).T.copy() for n, r in out.items()}


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, length, remembered).withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # LENGTH rows at most
    classes = plan(counts, length)
    shared = spark.sparkContext.broadcast(places(classes))  # runs of a number of classes that LENGTH bounds
    ways = max(1, int(np.sqrt(sum(counts.values()))))
    dealt = cut.withColumn("way", F.pmod("h", F.lit(ways)))
    sums = dealt.groupBy("length", "way").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("way").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sums = stored(sums.select(F.col("length").alias("l"), F.col("way").alias("w"), before.alias("before")), "ranks")
    rank = F.row_number().over(Window.partitionBy("length", "way").orderBy("h", "doc_id", "piece", "start")) - 1 + F.col("before")
    ranked = dealt.join(sums, (F.col("length") == F.col("l")) & (F.col("way") == F.col("w"))).select("doc_id", "piece", "start", "length", "ids_crc32", rank.alias("rank"))

    def run(batches):
        import pyarrow as pa

        where = shared.value
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for size in np.unique(n):
                rows = n == size
                first, base, times, at = where[int(size)]
                i = np.searchsorted(first, rank[rows], "right") - 1
                d = rank[rows] - first[i]
                seq[rows] = base[i] + d // times[i]
                off[rows] = at[i] + d % times[i] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
