"""Benchmark decontamination by a hash set of normalised test n-grams.

The windows of all benchmark items (10 consecutive words, or all words of a
shorter item) are hashed.  The items' texts go to every executor if they are
within a checked bound (MAX_BENCHMARK octets); each Python worker makes their sorted hashes once (some ten times
the texts' size in memory), and each task scans its documents' windows against
them.  Hits are verified word by word before anything is decided.

Beyond the bound, the rows are numbered and written to the shared folder, and the hashes of the documents' windows meet
the benchmark's in a shuffle join; only hits are verified on words (hits_by_join). The results are equal, row by row.

Defined cases: a null or empty text has no words and is clean; an item without
words, or with a null text or item_id, has no window; repeated items count once by item_id; repeated documents
are scanned each by itself; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import fresh, table, written
from tessera.llm.words import LETTERS, Words, chunks, words

WINDOW = 10
#: Octets of benchmark text up to which it is sent to every executor.
MAX_BENCHMARK = 8 << 20

_SPANS = "array<struct<start:long,end:long>>"
_FOUND = f"n_hit long, n_items long, items string, spans {_SPANS}"
SCHEMA = f"doc_id long, n_words long, {_FOUND}"


def _said(found: Words, a: int, k: int) -> bytes:
    """Words a to a + k of a batch, lower-cased, joined by a space."""
    return b" ".join(found.data[found.start[j] : found.end[j]].lower() for j in range(a, a + k))


def _windows(found: Words, size: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first words, hashes) of the windows of a batch of items, by length: a shorter item is one window."""
    n = np.diff(found.first)
    for k in np.unique(np.minimum(n[n > 0], size)).tolist():
        at, hashes = found.runs(k)
        own = np.minimum(n[found.row[at]], size) == k
        yield k, at[own], hashes[own]


class Benchmark:
    """Items (id as text, text as UTF-8), sent to executors; the sorted hashes are made there, once for each worker."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.items = items

    def __getstate__(self) -> dict:
        return {"items": self.items}

    @cached_property
    def found(self) -> Words:
        return words([text for _, text in self.items], LETTERS, True)

    @cached_property
    def names(self) -> np.ndarray:
        """The distinct ids in order; windows name items by their place here."""
        return np.array(sorted({name for name, _ in self.items}), object)

    @cached_property
    def by_length(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, sorted hashes, the first word of each, edges, items) of the distinct windows: window i is of items[edges[i]:edges[i + 1]], in order."""
        place = {name: i for i, name in enumerate(self.names.tolist())}
        of_row = np.array([place[name] for name, _ in self.items], np.int32)
        out = []
        for k, at, hashes in _windows(self.found):
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order]
            # windows of one hash are told apart by their words
            said: dict[bytes, int] = {}
            number, first, n = np.empty(len(at), np.int64), [], 0
            for i, (h, a) in enumerate(zip(hashes.tolist(), at.tolist(), strict=True)):
                if not i or h != hashes[i - 1]:
                    said = {}
                alone = not said and (i + 1 == len(hashes) or hashes[i + 1] != h)
                words_ = b"" if alone else _said(self.found, a, k)
                if words_ not in said:
                    said[words_] = n
                    first.append(i)
                    n += 1
                number[i] = said[words_]
            pairs = np.unique(np.stack([number, of_row[self.found.row[at]]], 1), axis=0)
            edges = np.searchsorted(pairs[:, 0], np.arange(n + 1))
            out.append((k, hashes[first], at[first].astype(np.int32), edges, pairs[:, 1].astype(np.int32)))
        return out

    def scan(self, texts: list[bytes], with_items: bool = True) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(words, hit runs of words, items in order) of each text; without items: none are told."""
        mine, its = words(texts, LETTERS, True), self.found
        hits: dict[int, list[tuple[int, int]]] = {}
        met: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for k, known, at_item, edges, items in self.by_length:
            at, hashes = mine.runs(k)
            place = np.searchsorted(known, hashes)
            for i in np.flatnonzero(known[np.minimum(place, len(known) - 1)] == hashes).tolist():
                a, said = int(at[i]), None
                row = int(mine.row[a])
                for j in range(int(place[i]), len(known)):
                    if known[j] != hashes[i]:
                        break
                    said = said or _said(mine, a, k)
                    if _said(its, int(at_item[j]), k) == said:
                        hits.setdefault(row, []).append((a - int(mine.first[row]), a - int(mine.first[row]) + k))
                        met.setdefault(row, {})[k, j] = items[edges[j] : edges[j + 1]]
        named = {row: self.names[np.unique(np.concatenate(list(of.values())))].tolist() for row, of in met.items()} if with_items else {}
        return [(n, merged(hits.get(row, ())), named.get(row, [])) for row, n in enumerate(np.diff(mine.first).tolist())]


def merged(spans: list[tuple[int, int]] | tuple) -> list[tuple[int, int]]:
    """Spans as maximal runs."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def _columns(found: list[tuple[list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
    spans = pa.array([[{"start": a, "end": b} for a, b in runs] for runs, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return [pa.array([sum(b - a for a, b in runs) for runs, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([",".join(x) for _, x in found], pa.string()), spans]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("text")).filter("item is not null and text is not null")


def sent(benchmark: DataFrame, most: int = MAX_BENCHMARK) -> Benchmark | None:
    """The benchmark to be sent to executors, or None if its texts and ids are over most octets."""
    items = _items(benchmark)
    if (items.select(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0) > most:
        return None
    return Benchmark([(r.item, bytes(r.text)) for r in items.toLocalIterator()])


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = MAX_BENCHMARK) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted, comma-joined), spans (hit runs of words)."""
    held = sent(benchmark, most)
    if held is None:
        rows, hits, row = hits_by_join(docs.select("doc_id", "text"), benchmark)
        counted = rows.select("doc_id", "text", row).mapInArrow(_counted, "doc_id long, row long, n_words long")
        zero = F.lit(0).cast("long")
        missing = {"n_hit": zero, "n_items": zero, "items": F.lit(""), "spans": F.array().cast(_SPANS)}
        return counted.join(hits, "row", "left").select("doc_id", "n_words", *(F.coalesce(c, v).alias(c) for c, v in missing.items()))
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = shared.value.scan(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), *_columns([x[1:] for x in found])], ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def hits_by_join(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """docs with numbered rows (written), what contamination() says of each row that is hit, and the number's column."""
    number = fresh(docs, "row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    lengths = F.filter(F.split(F.translate("said", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")
    items = _items(benchmark).select("item", "text", F.decode("text", "UTF-8").alias("said"))
    asked = sorted(r.k for r in items.select(F.least(F.lit(WINDOW), F.size(lengths)).alias("k")).filter("k > 0").distinct().collect())  # WINDOW numbers at most

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = words(texts, LETTERS, True)
            for k, at, hashes in _windows(found):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found.row[at])), pa.array(np.full(len(at), k, np.int32)), pa.array(hashes.view(np.int64)), pa.array([_said(found, a, k) for a in at.tolist()], pa.binary())], ["item", "k", "hash", "said"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = words(texts, LETTERS, True)
            for k in asked:
                at, hashes = found.runs(k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found.row[at])), pa.array((at - found.first[found.row[at]]).astype(np.int64)), pa.array(np.full(len(at), k, np.int32)), pa.array(hashes.view(np.int64))], ["row", "at", "k", "hash"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found, rows_, ats, ks, said = words(texts, LETTERS, True), [], [], [], []
            for n, (row, spots) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for x in spots:
                    rows_.append(row)
                    ats.append(x["at"])
                    ks.append(x["k"])
                    said.append(_said(found, int(found.first[n]) + x["at"], x["k"]))
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.int64()), pa.array(ats, pa.int64()), pa.array(ks, pa.int32()), pa.array(said, pa.binary())], ["row", "at", "k", "said"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(merged([(x["at"], x["at"] + x["k"]) for x in spots]), sorted(set(names))) for spots, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(found)], ["row", "n_hit", "n_items", "items", "spans"])

    windows = written(items.select("item", "text").mapInArrow(of_items, "item string, k int, hash long, said binary").distinct(), "windows")
    spots = rows.select(F.col(number).alias("row"), "text").mapInArrow(of_rows, "row long, at long, k int, hash long").join(windows.select("k", "hash").distinct(), ["k", "hash"], "left_semi")
    by_row = spots.groupBy("row").agg(F.collect_list(F.struct("at", "k")).alias("spots"))
    candidates = rows.select(F.col(number).alias("row"), "text").join(by_row, "row").select("row", "text", "spots").mapInArrow(spelled, "row long, at long, k int, said binary")
    hits = candidates.join(windows.select("item", "k", "said"), ["k", "said"]).groupBy("row").agg(F.collect_set(F.struct("at", "k")).alias("spots"), F.collect_set("item").alias("names"))
    return rows, written(hits.mapInArrow(together, f"row long, {_FOUND}"), "hits"), number


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(words(texts, LETTERS, True).first).astype(np.int64))], ["doc_id", "row", "n_words"])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, most: int = MAX_BENCHMARK) -> DataFrame:
    """The rows of docs without an occurring window; each row is judged by itself, however its benchmark is met."""
    held = sent(benchmark, most)
    if held is None:
        rows, hits, row = hits_by_join(docs, benchmark)
        return rows.join(hits.select(F.col("row").alias(row)), row, "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array([not runs for _, runs, _ in shared.value.scan(texts, False)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
