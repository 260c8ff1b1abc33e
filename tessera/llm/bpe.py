"""Byte-level BPE encoding and decoding over the corpus's distinct words.

Each task turns its documents into blocks of about 6 MB: the block's distinct
pre-tokens, and each document as positions into them.  The words of all blocks
meet in one shuffle by the word's hash, in which each block has one packed row for each
part of the hash space; each distinct word is encoded once, its ids go back to the
blocks that have it, and every block puts its documents together again by
position.  Only words and packed positions are shuffled, never the texts.

Decoding looks the ids up in the token-byte table, whose size is that of the
vocabulary (checked), not of the data.

Defined cases: a null text counts as empty; an empty text has no ids and the
hash of no bytes; repeated rows give repeated results; a null doc_id is kept; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate, count
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.frames import partitions, table, total_bytes

#: Characters of text in a block; one longer text is a block of its own.
BLOCK = 6 << 20

#: Vocabularies over this size (bytes of tokens) are refused: their table is sent to every executor.
MAX_TABLE = 64 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    if sum(map(len, found)) > MAX_TABLE:
        raise ValueError(f"the vocabulary {path} is too large to send to every executor")
    return found


def newer_characters(split: str) -> str:
    """Letters and numbers of the regex module's Unicode version that tiktoken's older one doesn't have, as a set's inside."""
    import regex
    import tiktoken

    kinds = [k for k in (r"\p{L}", r"\p{N}") if k in split]
    unassigned = "".join(c for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(c := chr(i)) == "Cn")
    single = {bytes([i]): i for i in range(256)}
    codes: set[int] = set()
    for kind in kinds:
        known = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={})
        codes |= {ord(c) for c in regex.findall(kind, unassigned) if not known.encode_ordinary(c)}
    ranges: list[list[int]] = []
    for c in sorted(codes):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


def finder(split: str, newer: str) -> Callable[[str], list[str]]:
    """Splits a text by the pattern as tiktoken does: characters in newer count as no letters and no numbers."""
    import regex

    usual = regex.compile(split).findall
    if not newer:
        return usual
    has = regex.compile(f"[{newer}]").search
    without = [(k, f"[{k}--[{newer}]]") for k in (r"\p{L}", r"\p{N}")]
    for kind, instead in without:
        split = split.replace(kind, instead)
    careful = regex.compile("(?V1)" + split).findall
    return lambda text: usual(text) if text.isascii() or not has(text) else careful(text)


class Decoder:
    """The token-byte table as one buffer, with each id's place in it."""

    def __init__(self, found: dict[bytes, int]) -> None:
        size = max(found.values(), default=-1) + 1
        by_id = [b""] * size
        for token, i in found.items():
            by_id[i] = token
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> Iterator[bytes]:
        """The bytes of ids, in pieces of step ids."""
        for a in range(0, len(ids), step):
            part = ids[a : a + step]
            n = self.lengths[part]
            shift = np.repeat(self.starts[part] - (np.cumsum(n) - n), n)
            yield self.data[shift + np.arange(len(shift))].tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], find: Callable[[str], list[str]], parts: int) -> Iterator[tuple[int, list, list[np.ndarray], list[tuple[int, list[bytes]]]]]:
    """(block, doc_ids, positions of each document, words by part) for runs of documents of about BLOCK characters.

    Positions count through the words of all parts, in order of part and of first use.
    """
    task = TaskContext.get()
    number = count((task.partitionId() if task else 0) << 32)

    def done(words: dict[str, int]) -> tuple[int, list, list[np.ndarray], list[tuple[int, list[bytes]]]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        part = np.fromiter(map(crc32, raw), np.uint32, len(raw)) % np.uint32(parts)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(raw), np.uint32)
        place[order] = np.arange(len(raw), dtype=np.uint32)
        edges = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        order = order.tolist()
        by_part = [(p, [raw[i] for i in order[edges[p] : edges[p + 1]]]) for p in range(parts) if edges[p] < edges[p + 1]]
        return next(number), ids, [place[s] for s in streams], by_part

    ids, streams, held, words = [], [], 0, defaultdict(count().__next__)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            ids.append(doc_id)
            streams.append(np.fromiter(map(words.__getitem__, find(text)), np.uint32))
            held += len(text)
            if held >= BLOCK:
                yield done(words)
                ids, streams, held, words = [], [], 0, defaultdict(count().__next__)
    if ids:
        yield done(words)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as compressed bytes, with their sizes before them."""
    raw = b"".join(a.tobytes() for a in arrays)
    return np.array([len(raw), *(a.nbytes for a in arrays)], "<i8").tobytes() + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(data: bytes, kinds: list) -> list[np.ndarray]:
    size, *sizes = np.frombuffer(data, "<i8", len(kinds) + 1).tolist()
    raw = pa.decompress(data[8 * (len(kinds) + 1) :], size, codec="zstd", asbytes=True) if size else b""
    edges = [0, *accumulate(sizes)]
    return [np.frombuffer(raw[a:b], kind) for a, b, kind in zip(edges, edges[1:], kinds, strict=False)]


def _pack_words(words: list[bytes]) -> bytes:
    return _pack([np.fromiter(map(len, words), "<u4", len(words)), np.frombuffer(b"".join(words), np.uint8)])


def _mark(words: list[bytes]) -> int:
    """Tells lists of words apart."""
    return crc32(b"\0".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    sizes, letters = _unpack(data, ["<u4", np.uint8])
    letters, edges = letters.tobytes(), [0, *accumulate(sizes.tolist())]
    return [letters[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def encode(docs: DataFrame, path: str | None = None, split: str | None = None) -> DataFrame:
    """doc_id, ids (unsigned 32-bit little-endian integers, packed) of each row of docs (doc_id, text).

    path: a rank file; split: the pattern of pre-tokens, each encoded by itself.
    """
    return _encoded(docs, path, split, None)


def encode_and_decode(docs: DataFrame, path: str | None = None, split: str | None = None, keep: bool = False) -> DataFrame:
    """digests() of encode(), made where a block's documents are put together: no second Python worker runs beside the first."""
    return _encoded(docs, path, split, keep)


def _encoded(docs: DataFrame, path: str | None, split: str | None, digested: bool | None) -> DataFrame:
    """digested: None: ids alone; else digests, with ids if true."""
    spark = docs.sparkSession
    split = split or pattern()
    held = ranks(path or vocabulary_path())
    found = spark.sparkContext.broadcast(held)
    kind = "<u2" if max(held.values(), default=0) < 1 << 16 else "<u4"
    newer = newer_characters(split)
    docs = docs.select("doc_id", "text")
    parts = int(max(partitions(spark), total_bytes(docs) // BLOCK))

    schema = "key long, block long, part int, mark long, ids array<long>, sizes array<long>, marks array<long>, data binary"
    fields = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("mark", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids", "sizes", "marks")), ("data", pa.binary())])

    def split_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part that a block has words of (key: the part) and one of its documents as positions (key: below 0, the block)."""
        for block, ids, streams, by_part in _blocks(batches, finder(split, newer), parts):
            marks = [_mark(w) for _, w in by_part]
            rows = [{"key": p, "block": block, "part": p, "mark": m, "data": _pack_words(w)} for (p, w), m in zip(by_part, marks, strict=True)]
            wide = np.uint16 if sum(len(w) for _, w in by_part) <= 1 << 16 else np.uint32
            rows.append({"key": -1 - block, "block": block, "part": np.dtype(wide).itemsize, "ids": ids, "sizes": list(map(len, streams)), "marks": marks, "data": _pack([np.concatenate(streams).astype(wide)])})
            yield pa.RecordBatch.from_pylist(rows, fields)

    made: dict = {}  # what a task makes once

    def encode_part(part: pa.Table) -> pa.Table:
        import tiktoken

        out, to = [], part.slice(0, 0) if part.column("key")[0].as_py() < 0 else part
        if len(to) and "single" not in made:
            made["single"] = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=found.value, special_tokens={})._encode_single_piece
        single = made.get("single")
        known: dict[bytes, np.ndarray] = {}
        for packed in to.column("data"):
            words = _unpack_words(packed.as_py())
            for w in words:
                if w not in known:
                    known[w] = np.array(single(w), kind)
            ids = [known[w] for w in words]
            out.append(_pack([np.fromiter(map(len, ids), "<u4", len(ids)), np.concatenate(ids)]))
        return pa.table({"key": pa.array([-1 - b for b in to.column("block").to_pylist()], pa.int64()), "part": to.column("part"), "mark": to.column("mark"), "ids": pa.array(out, pa.binary())})

    def together(words: pa.Table, blocks: pa.Table) -> pa.Table:
        doc_ids, out = [], []
        if len(blocks) and blocks.column("key")[0].as_py() < 0:
            rows = sorted(words.to_pylist(), key=itemgetter("part"))
            pieces = [_unpack(r["ids"], ["<u4", kind]) for r in rows]
            lengths = np.concatenate([np.zeros(0, "<u4"), *(p[0] for p in pieces)]).astype(np.int64)
            flat, starts = np.concatenate([np.zeros(0, kind), *(p[1] for p in pieces)]).astype("<u4"), np.cumsum(lengths) - lengths
            for b in blocks.to_pylist():
                if b["marks"] != [r["mark"] for r in rows]:
                    raise RuntimeError("a block's words differ between two readings of its documents")
                (stream,) = _unpack(b["data"], [np.uint16 if b["part"] == 2 else np.uint32])
                a = 0
                for doc_id, n in zip(b["ids"], b["sizes"], strict=True):
                    at = stream[a : a + n].astype(np.int64)
                    a += n
                    m = lengths[at]
                    shift = np.repeat(starts[at] - (np.cumsum(m) - m), m)
                    doc_ids.append(doc_id)
                    out.append(flat[shift + np.arange(len(shift))].tobytes())
        ids = pa.array(out, pa.binary())
        if digested is None:
            return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids})
        if "decoder" not in made:
            made["decoder"] = Decoder(found.value)
        return pa.table([pa.array(doc_ids, pa.int64()), *_digest(made["decoder"], out), *([ids] if digested else [])], _names(digested))

    # both groupings are by key, so the texts are split once and the one exchange of words and positions serves both
    dealt = docs.mapInArrow(split_up, schema)
    encoded = dealt.groupBy("key").applyInArrow(encode_part, "key long, part int, mark long, ids binary")
    return encoded.groupBy("key").cogroup(dealt.groupBy("key")).applyInArrow(together, "doc_id long, ids binary" if digested is None else _DIGESTS + ", ids binary" * digested)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data (binary) of each row of encoded (doc_id, ids): the bytes of its ids, joined."""
    found = encoded.sparkSession.sparkContext.broadcast(ranks(path or vocabulary_path()))

    def run(batches):
        table = Decoder(found.value)
        for batch in batches:
            out = [b"".join(table.decode(np.frombuffer(x, "<u4"))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _names(keep: bool) -> list[str]:
    return ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep else [])]


def _digest(table: Decoder, raw: list[bytes]) -> list[pa.Array]:
    """n_tokens, ids_sha256, decoded_sha256; decoded bytes are hashed in pieces."""
    decoded = []
    for x in raw:
        h = hashlib.sha256()
        for piece in table.decode(np.frombuffer(x, "<u4")):
            h.update(piece)
        decoded.append(h.hexdigest())
    return [pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array(decoded, pa.string())]


def digests(encoded: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of encoded, and its ids if they are to be kept."""
    found = encoded.sparkSession.sparkContext.broadcast(ranks(path or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Decoder(found.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_digest(table, batch.column(1).to_pylist()), *([batch.column(1)] if keep else [])], _names(keep))

    return encoded.select("doc_id", "ids").mapInArrow(run, _DIGESTS + ", ids binary" * keep)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))
