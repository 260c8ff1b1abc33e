"""Phrase collocation mining in the layout of external stream estimation.

Counting.  Each task turns its texts into blocks of about 16 MB, as positions into the block's words, with a gap at every end of a piece.
Blocks send their distinct words with counts, packed, to the parts of the word space; a part adds them up and answers each block with the
number of every frequent word (0 for the others).  From then on a phrase of k + 1 words is a pair of frequent phrases of k words
at neighbouring positions, since no phrase is more frequent than its parts: blocks send their distinct pairs, parts answer, order by order up to five.
A phrase that a third of all documents share is one pair for each block, however often the block has it.  Each order is written
before the next, so a lost executor costs one order's tasks at most.

Estimation.  The frequent phrases of all orders lie in one count stream, sorted twice: in prefix order (by language and words), where each phrase comes after
its prefixes, and in suffix order (by language and words from last to first), where it comes after its suffixes.  Both are cut into parts by ranges of whole phrases, so
no word is a hot key.  A walk over a part holds the counts of the present row's prefixes (at most four) in step with the rows, and looks one row ahead: the left counts of all
cuts, the right counts of all cuts, and whether an extension by one word is as frequent, without a hash table.  What a walk holds before a
part's first row, and what follows its last, is four counts and one row for each part; these come to the driver.

Scores are whole numbers of any size (Python's), so they are exact.

Defined cases: a null text is empty; a null lang is ``und`` and one with the lang ``und``; repeated rows count each; a phrase doesn't cross
a separator, nor a row's end; languages with fewer than two frequent words give no rows; an empty table gives an empty result; columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from math import isqrt
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.frames import partitions, table, total_bytes, written
from tessera.llm.words import mix

LEAST, LONGEST, TOP = 100, 5, 2000
#: Octets of text in a block (one longer text is a block of its own), and of the texts whose words or pairs make a part.
BLOCK, PART = 16 << 20, 16 << 20
#: Phrases in a part of the sorted streams.
STREAM = 100_000
NO_LANG = "und"

_READ = bytearray(range(256))
_READ[0x41:0x5B] = range(0x61, 0x7B)
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _READ[_b] = 0x0A
_READ[0x09] = 0x20
#: Lower-cases A to Z; every separator of pieces is a line feed, every separator of words a space.
_READ = bytes(_READ)

#: Rows between blocks and parts. key: the part, or -1 - block for the block's own row; data: what is sent, or the block's positions.
_ROW = "key long, block long, part int, data binary"
_FIELDS = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes, compressed: bytes of like weight lie together, so leading zeros vanish."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    head = np.array([len(raw), *(len(a) for a in arrays)], "<i8").tobytes()
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    size, *sizes = np.frombuffer(data, "<i8", len(kinds) + 1).tolist()
    raw, out, a = pa.decompress(data[8 * (len(kinds) + 1) :], size, codec="zstd", asbytes=True) if size else b"", [], 0
    for n, kind in zip(sizes, kinds, strict=True):
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * wide, a).reshape(wide, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        a += n * wide
    return out


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(order by part, edges of the parts in it, parts that have any)."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    return order, edges, np.flatnonzero(np.diff(edges)).tolist()


def _words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each block: its positions, and its words with counts by part.  Positions count from 1 through the words of all parts; 0 is a gap."""
    task = TaskContext.get()
    number = count((task.partitionId() if task else 0) << 32)
    by_lang: dict[str, dict[bytes, int]] = {}
    ids, streams, held = count(2), [], 0

    def done() -> pa.RecordBatch:
        block = next(number)
        raw = [w + b"\t" + lang.encode("unicode_escape") for lang, words in by_lang.items() for w in words if w not in (b"", b"\n")]
        local = np.fromiter((i for words in by_lang.values() for w, i in words.items() if w not in (b"", b"\n")), np.int64, len(raw))
        order, edges, some = _by_part(np.fromiter(map(crc32, raw), np.uint32, len(raw)) % np.uint32(parts), parts)
        place = np.zeros(len(raw) + 2, np.uint32)
        place[local[order]] = np.arange(1, len(raw) + 1, dtype=np.uint32)
        stream = place[np.concatenate(streams)]
        counts = np.bincount(stream, minlength=len(raw) + 1)[1:].astype("<u4")
        rows = [{"key": p, "block": block, "part": p, "data": _pack_words([raw[i] for i in order[edges[p] : edges[p + 1]]], counts[edges[p] : edges[p + 1]])} for p in some]
        return pa.RecordBatch.from_pylist([{"key": -1 - block, "block": block, "part": None, "data": _pack(stream)}, *rows], _FIELDS)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            read = (text.as_py() or b"").translate(_READ)
            if (words := by_lang.get(lang)) is None:
                words = by_lang[lang] = defaultdict(ids.__next__, {b"": 0, b"\n": 1})
            said = np.fromiter(map(words.__getitem__, [*read.replace(b"\n", b" \n ").split(b" "), b"\n"]), np.uint32)
            streams.append(said[said > 0])
            held += len(read)
            if held >= BLOCK:
                yield done()
                by_lang, ids, streams, held = {}, count(2), [], 0
    if streams:
        yield done()


def _pack_words(words: list[bytes], counts: np.ndarray) -> bytes:
    """Words (each with its language, escaped) and counts; neither has a line feed."""
    return _pack(np.frombuffer(b"\n".join(words), np.uint8), counts)


def _pairs(state: pa.Table, answers: pa.Table, parts: int, last: bool) -> pa.Table:
    """A block's next positions, and its distinct pairs of frequent phrases at neighbouring positions, with counts, by part."""
    rows = state.to_pylist()
    if not rows:
        return _FIELDS.empty_table()
    block = rows[0]["block"]
    known = [np.zeros(1, "<u8"), *(_unpack(r["data"], "<u8")[0] for r in sorted(answers.to_pylist(), key=itemgetter("part")))]
    stream = _unpack(rows[0]["data"], "<u4")[0]
    ids = np.concatenate(known)
    frequent = ids[stream] > 0
    at = np.flatnonzero(frequent[:-1] & frequent[1:])
    pair, inverse, counts = np.unique(stream[at].astype(np.uint64) << np.uint64(32) | stream[at + 1], return_inverse=True, return_counts=True)
    left, right = ids[(pair >> np.uint64(32)).astype(np.int64)], ids[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    order, edges, some = _by_part((mix(left ^ mix(right)) % np.uint64(parts)).astype(np.int64), parts)
    sent = [{"key": p, "block": block, "part": p, "data": _pack(left[o := order[edges[p] : edges[p + 1]]], right[o], counts[o].astype("<u4"))} for p in some]
    if last or not len(at):
        return pa.Table.from_pylist(sent, _FIELDS)
    place = np.empty(len(pair), np.uint32)
    place[order] = np.arange(1, len(pair) + 1, dtype=np.uint32)
    following = np.zeros(len(stream), "<u4")
    following[at] = place[inverse]
    return pa.Table.from_pylist([{"key": -1 - block, "block": block, "part": None, "data": _pack(following)}, *sent], _FIELDS)


def _next_order(parts: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda state, answers: _pairs(state, answers, parts, last)


_ANSWER = "key long, part int, data binary, id long, lang string, word string, left long, right long, f long"
_ANSWERED = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64())])


def _answered(sent: pa.Table, sizes: list[int], ids: np.ndarray, found: dict[str, pa.Array]) -> pa.Table:
    """Answers to the blocks (the numbers of what each sent, in its order) and, below them, the part's frequent entries."""
    part, edges = sent.column("part")[0].as_py(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
    data = [_pack(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    answers = {"key": pa.array([-1 - b for b in sent.column("block").to_pylist()], pa.int64()), "part": pa.array([part] * len(data), pa.int32()), "data": pa.array(data, pa.binary())}
    tables = [pa.table([of.get(f.name, pa.nulls(len(next(iter(of.values()))), f.type)) for f in _ANSWERED], schema=_ANSWERED) for of in (answers, found)]
    return pa.concat_tables(tables)


def _numbers(n: int, part: int, parts: int) -> np.ndarray:
    """n numbers above 0 that no other part gives."""
    return np.arange(n, dtype=np.uint64) * np.uint64(parts) + np.uint64(part + 1)


def _count_words(sent: pa.Table, parts: int, least: int) -> pa.Table:
    """A part's words added up: answers, frequent words, and (without a number) the occurrences of all words by language."""
    part = sent.column("part")[0].as_py()
    lists, counts = [], []
    for data in sent.column("data"):
        letters, n = _unpack(data.as_py(), "u1", "<u4")
        lists.append(letters.tobytes().split(b"\n"))
        counts.append(n)
    place: dict[bytes, int] = defaultdict(count().__next__)
    which = np.fromiter((place[w] for words in lists for w in words), np.int64)
    total = np.zeros(len(place), np.int64)
    np.add.at(total, which, np.concatenate(counts).astype(np.int64))
    frequent = total >= least
    ids = np.zeros(len(place), "<u8")
    ids[frequent] = _numbers(int(frequent.sum()), part, parts)
    by_lang: dict[bytes, int] = defaultdict(int)
    words, langs = [], []
    for key, f, often in zip(place, total.tolist(), frequent.tolist(), strict=True):
        word, lang = key.split(b"\t", 1)
        by_lang[lang] += f
        if often:
            words.append(word)
            langs.append(lang)
    none = [None] * len(by_lang)
    names = pa.array([x.decode("unicode_escape") for x in (*langs, *by_lang)], pa.string())
    found = {"id": pa.array([*ids[frequent].tolist(), *none], pa.int64()), "lang": names, "word": pa.array([*words, *none], pa.binary()).cast(pa.string()), "f": pa.array([*total[frequent].tolist(), *by_lang.values()], pa.int64())}
    return _answered(sent, list(map(len, lists)), ids[which], found)


def _count_pairs(sent: pa.Table, parts: int, least: int) -> pa.Table:
    """A part's pairs added up in order: answers and frequent pairs."""
    part = sent.column("part")[0].as_py()
    read = [_unpack(x.as_py(), "<u8", "<u8", "<u4") for x in sent.column("data")]
    left, right, counts = (np.concatenate(x) for x in zip(*read, strict=True))
    order = np.lexsort((right, left))
    a, b = left[order], right[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    total = np.add.reduceat(counts[order].astype(np.int64), starts)
    frequent = total >= least
    ids = np.zeros(len(starts), "<u8")
    ids[frequent] = _numbers(int(frequent.sum()), part, parts)
    mine = np.empty(len(order), "<u8")
    mine[order] = np.repeat(ids, np.diff(np.concatenate([starts, [len(order)]])))
    found = {"id": pa.array(ids[frequent].astype(np.int64)), "left": pa.array(a[starts][frequent].astype(np.int64)), "right": pa.array(b[starts][frequent].astype(np.int64)), "f": pa.array(total[frequent])}
    return _answered(sent, [len(x[0]) for x in read], mine, found)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a) of each phrase of one to longest words that occurs least times or more; (lang, n) of each language."""
    spark = docs.sparkSession
    parts = int(max(partitions(spark), total_bytes(docs) // PART))
    read = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    sent = written(read.mapInArrow(lambda batches: _words(batches, parts), _ROW), "positions-1")
    counted = lambda rows, of: written(rows.filter("key >= 0").groupBy("key").applyInArrow(lambda part: of(part, parts, least), _ANSWER), "answers")
    answers = counted(sent, _count_words)
    phrases = answers.filter("id is not null").select("id", "lang", F.array("word").alias("words"), "f")
    orders, sizes = [phrases], answers.filter("word is null and lang is not null").groupBy("lang").agg(F.sum("f").alias("n"))
    for k in range(2, longest + 1):
        pairs = _next_order(parts, k == longest)
        blocks, to = sent.filter("key < 0").groupBy("key"), answers.filter("key < 0").select("key", "part", "data").groupBy("key")
        sent = written(blocks.cogroup(to).applyInArrow(pairs, _ROW), f"positions-{k}")
        answers = counted(sent, _count_pairs)
        first, second = phrases.select(F.col("id").alias("left"), "lang", F.col("words").alias("start")), phrases.select(F.col("id").alias("right"), F.element_at("words", -1).alias("end"))
        phrases = written(answers.filter("id is not null").select("id", "left", "right", "f").join(first, "left").join(second, "right").select("id", "lang", F.concat("start", F.array("end")).alias("words"), "f"), f"phrases-{k}")
        orders.append(phrases)
    whole = orders[0]
    for more in orders[1:]:
        whole = whole.unionByName(more)
    return whole.select("lang", "words", F.col("f").alias("a")), sizes


def _walk(rows: list[dict], held: list[tuple[list[str], int]], following: tuple | None) -> Iterator[tuple[list[int], bool]]:
    """For each row of a sorted part: the counts of its shorter beginnings, and whether the next row is longer by one word and as frequent.

    held: beginnings of the first row, shortest first, that lie in earlier parts; following: (lang, key, count) of the row after the part.
    """
    lang = rows[0]["lang"]
    ahead = [*((r["lang"], r["key"], r["a"]) for r in rows[1:]), following]
    for row, after in zip(rows, ahead, strict=True):
        key = row["key"]
        if row["lang"] != lang:
            lang, held = row["lang"], []
        while held and (len(held[-1][0]) >= len(key) or key[: len(held[-1][0])] != held[-1][0]):
            held.pop()
        yield [n for _, n in held], after is not None and after[0] == lang and after[2] == row["a"] and len(after[1]) == len(key) + 1 and after[1][:-1] == key
        held.append((key, row["a"]))


def in_step(stream: DataFrame, name: str, extended: str, label: str) -> DataFrame:
    """stream (lang, key, a, ...) with two more columns: counts of each key's shorter beginnings (all are in the stream), shortest first, and whether a
    key longer by one word is as frequent.  The stream is sorted by lang and key and cut into parts of like size; each part is walked once.
    """
    spark = stream.sparkSession
    columns = [f for f in stream.schema if f.name not in ("lang", "key", "a")]
    parts = max(1, stream.count() // STREAM)
    dealt = written(stream.repartitionByRange(parts, "lang", "key").withColumn("part", F.spark_partition_id()), label)
    first = sorted(dealt.groupBy("part").agg(F.min(F.struct("lang", "key", "a")).alias("row")).collect())  # one row for each part
    wanted = [(r.part, r.row.lang, list(r.row.key[:k])) for r in first for k in range(1, len(r.row.key))]
    carried: dict[int, list[tuple[list[str], int]]] = defaultdict(list)
    if wanted:
        asked = spark.createDataFrame(wanted, "before int, lang string, key array<string>")
        for r in dealt.join(asked, ["lang", "key"]).select("before", "key", "a").collect():  # four rows for each part at most
            carried[r.before].append((list(r.key), r.a))
    after = {r.part: (n.row.lang, list(n.row.key), n.row.a) for r, n in zip(first, first[1:], strict=False)}
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)

    def walk(part: pa.Table) -> pa.Table:
        number = part.column("part")[0].as_py()
        rows = sorted(part.drop_columns(["part"]).to_pylist(), key=lambda r: (r["lang"].encode(), [w.encode() for w in r["key"]]))
        found = list(_walk(rows, sorted(carried.get(number, []), key=lambda x: len(x[0])), after.get(number)))
        out = {c: pa.array([r[c] for r in rows], part.column(c).type) for c in ("lang", "key", "a", *(f.name for f in columns))}
        return pa.table({**out, name: pa.array([n for n, _ in found], pa.list_(pa.int64())), extended: pa.array([x for _, x in found], pa.bool_())})

    return dealt.groupBy("part").applyInArrow(walk, f"lang string, key array<string>, a long, {kinds + ', ' if kinds else ''}{name} array<long>, {extended} boolean")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest-scoring cut of each phrase; whole numbers of any size."""
    for batch in batches:
        ls, rs, scores = [], [], []
        for a, n, lefts, rights in zip(*(batch.column(c).to_pylist() for c in ("a", "n", "lefts", "rights")), strict=True):
            cuts = [(1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(zip(lefts, reversed(rights), strict=True))]
            score, _, x, y = min(cuts)
            ls.append(x)
            rs.append(y)
            scores.append(score)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase"), batch.column("a"), pa.array(ls, pa.int64()), pa.array(rs, pa.int64()), batch.column("n"), pa.array(scores, pa.int64())], ["lang", "phrase", "a", "l", "r", "n", "score"])


def _first(scored: DataFrame, most: int, groups: int) -> DataFrame:
    """The first rows of each language with their rank: of each of groups parts of it, of fewer, then of all."""
    by = [F.desc("score"), F.desc("a"), "phrase"]
    for g in (groups, isqrt(groups)):
        if g > 1:
            salt = F.pmod(F.xxhash64("phrase"), F.lit(g))
            scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*by))).filter(F.col("rank") <= most).drop("rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two to longest words."""
    phrases, sizes = frequent_phrases(docs, least, longest)
    groups = max(64, partitions(docs.sparkSession))
    by_prefix = in_step(phrases.withColumnRenamed("words", "key"), "lefts", "longer_right", "prefix-order")
    turned = by_prefix.select("lang", F.reverse("key").alias("key"), "a", "lefts", "longer_right")
    by_suffix = in_step(turned, "rights", "longer_left", "suffix-order")
    kept = by_suffix.filter((F.size("key") > 1) & ~F.col("longer_right") & ~F.col("longer_left"))
    named = kept.join(sizes, "lang").select("lang", F.array_join(F.reverse("key"), " ").alias("phrase"), "a", "n", "lefts", "rights")
    scored = written(named.mapInArrow(_scored, "lang string, phrase string, a long, l long, r long, n long, score long"), "scored")
    return _first(scored, most, groups).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
