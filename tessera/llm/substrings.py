"""Substring deduplication: Rabin-Karp hashes of every window of 20 words, counted in Spark.

Documents are dealt into blocks by runs of doc_id, so an earlier block holds only
smaller doc_ids.  Each block sends the sorted hashes of its distinct windows,
packed, to the parts of the hash space; each part finds which of them an earlier
block has too and answers with one bit for each hash.  With that, and with what
repeats inside it, each block marks its words.  A window that a third of all
documents share is one hash for each block, however often the block has it.

Two windows count as equal when a 64-bit hash and the part (from a second
polynomial) agree: a false match is expected once in 2**64 times the
number of parts pairs of windows. Both are of word hashes that have no known collisions.

What blocks and parts exchange is one row for each pair of them that has a window in common, so never more rows than windows:
at worst, in a very large corpus, the exchange is that of a plain shuffle of windows.

Defined cases: a null or empty text has no words; documents under 20 words have no
window and stay whole; rows with one doc_id count as documents in order of their
text; a null doc_id comes first; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import in_order, partitions, run_of, table, total_bytes
from tessera.llm.words import NOT_SPACE, Words, words

WINDOW = 20
BLOCK_BYTES = 4 << 20
PART_WINDOWS = 2_000_000


def _sorted_rows(block: pa.Table) -> tuple[list, list[bytes]]:
    ids = block.column("doc_id").to_pylist()
    texts = [t or b"" for t in block.column("text").cast(pa.binary()).to_pylist()]
    order = in_order(block)
    return [ids[i] for i in order], [texts[i] for i in order]


def _distinct(found: Words, size: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts; and, in order of part and hash, each distinct window's hash, part and first place among the starts."""
    at, hashes = found.runs(size)
    if not len(at):
        return at, hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(hashes)
    run = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    first = np.minimum.reduceat(order, starts)
    part = (found.runs(size, other=True)[1][first] % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    return at, run[starts][by], part[by], first[by]


def repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed (runs of words as start and end, maximal), kept (the other words, joined by a space) of each row.

    Removed is every word of a window whose words also start earlier: in a smaller doc_id, or before in the same document.
    """
    octets = total_bytes(docs)
    blocks = max(partitions(docs.sparkSession), octets // BLOCK_BYTES)
    parts = int(max(partitions(docs.sparkSession), octets // 6 // PART_WINDOWS))
    dealt = docs.select("doc_id", "text", run_of(docs, "doc_id", blocks).alias("block"))

    def send(block: pa.Table) -> pa.Table:
        _, texts = _sorted_rows(block)
        _, hashes, part, _ = _distinct(words(texts, NOT_SPACE, False), size, parts)
        edges = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edges)).tolist()
        number = block.column("block")[0].as_py()
        return pa.table({"block": pa.array([number] * len(some), pa.int32()), "part": pa.array(some, pa.int32()), "hashes": pa.array([hashes[edges[p] : edges[p + 1]].tobytes() for p in some], pa.binary())})

    def answer(part: pa.Table) -> pa.Table:
        numbers = part.column("block").to_numpy()
        sent = [np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()]
        sizes = np.fromiter(map(len, sent), np.int64, len(sent))
        hashes, block = np.concatenate(sent), np.repeat(numbers, sizes)
        order = np.lexsort((block, hashes))
        seen = np.zeros(len(hashes), bool)
        run = hashes[order]
        seen[order[1:][run[1:] == run[:-1]]] = True
        edges = np.concatenate([[0], np.cumsum(sizes)])
        some = [i for i in range(len(sent)) if seen[edges[i] : edges[i + 1]].any()]
        return pa.table({"block": pa.array(numbers[some], pa.int32()), "part": part.column("part").take(pa.array(some, pa.int64())).cast(pa.int32()), "bits": pa.array([np.packbits(seen[edges[i] : edges[i + 1]]).tobytes() for i in some], pa.binary())})

    def mark(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _sorted_rows(block)
        found = words(texts, NOT_SPACE, False)
        at, hashes, part, first = _distinct(found, size, parts)
        earlier = np.zeros(len(hashes), bool)
        edges = np.searchsorted(part, np.arange(parts + 1))
        for p, bits in zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            earlier[edges[p] : edges[p + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(edges[p + 1] - edges[p])).astype(bool)
        repeat = np.ones(len(at), bool)
        repeat[first[~earlier]] = False
        change = np.zeros(len(found.hash) + 1, np.int32)
        np.add.at(change, at[repeat], 1)
        np.add.at(change, at[repeat] + size, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept, runs = [], []
        for row, text in enumerate(texts):
            a, b = int(found.first[row]), int(found.first[row + 1])
            own = gone[a:b]
            split = text.split(None) if not own.all() else []
            kept.append(b" ".join(w for w, g in zip(split, own.tolist(), strict=True) if not g) if split else b"")
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            runs.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2], strict=True)])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(found.first).astype(np.int64)), "removed": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    sent = dealt.groupBy("block").applyInArrow(send, "block int, part int, hashes binary")
    answers = sent.groupBy("part").applyInArrow(answer, "block int, part int, bits binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(mark, "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))

