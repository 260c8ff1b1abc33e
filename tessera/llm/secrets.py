"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once.  Base matches (assignments, access keys, long hex
runs) always stay.  Random-looking strings beside them are only candidates: the
hash of each is counted by distinct repositories and owners over the whole
corpus.  What few owners have looks live and is added as a span of kind "live";
what many have is a copied example and is not.  Base matches are judged in the same way, and say so.

The counting shuffles (hash, owner, repository) once for each task that has it,
so a candidate that a third of all rows hold is counted as a handful of rows; and only hashes that are copied examples
meet the candidates again, in SALTS parts each, so that a hot one is no hot task.

Defined cases: a null text counts as empty; an empty text has no spans; repeated
rows are scanned each by itself; a null owner or repository counts as one owner
or repository of its own; an empty table gives an empty result; a column named
like one of the operator's own does no harm, since only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import count
from math import log2

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import fresh, table, written

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "live")
#: A candidate: so many characters of this class, letters and digits, so many bits a character.
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS = 3.5
#: A candidate of more owners or repositories than these is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 3
SALTS = 16

_NAMES = re.compile(r"passw|secret|token|api_?key")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, secret) of the base matches."""
    found = []
    if _NAMES.search(text.lower()):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def random_looking(s: str) -> bool:
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return False
    n = len(s)
    return -sum(k / n * log2(k / n) for k in Counter(s).values()) >= LEAST_BITS


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, hash): base spans with the hash of their secret, and random-looking strings outside them."""
    found, i = [(a, k, b, _hash(s)) for a, k, b, s in base], 0
    taken = sorted((a, b) for a, _, b, _ in base)
    for m in RANDOM.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if not any(a < m.end() and b > m.start() for a, b in taken[i : i + 8]) and random_looking(m[0]):
            found.append((m.start(), 3, m.end(), _hash(m[0])))
    return found


_ROW = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())])


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, row: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): row, doc_id, found (array of start, kind, end, hash), owner, repository.

    row numbers the rows: a column of docs that does so, or a new number, which is fixed once the result has been written.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    number = F.lit(None) if row is None else F.col(row)
    read = docs.select("doc_id", "text", number.cast("long").alias("_row"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        following = count((task.partitionId() if task else 0) << 40)
        for batch in batches:
            found = []
            for value in batch.column(1):
                text = value.as_py() or ""
                found.append([dict(zip(("start", "kind", "end", "hash"), x, strict=True)) for x in candidates(text, base_spans(text))])
            rows = pa.array([next(following) for _ in found], pa.int64()) if row is None else batch.column(2)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(found, pa.list_(_ROW)), batch.column(3), batch.column(4)], ["row", "doc_id", "found", "owner", "repository"])

    return read.mapInArrow(run, "row long, doc_id long, found array<struct<start:long,kind:int,end:long,hash:long>>, owner string, repository string")


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, owners, repositories of every candidate of the corpus."""
    each = scanned.select(F.explode("found.hash").alias("hash"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository"))
    by_owner = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("times"))
    return by_owner.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.count(F.lit(1)).alias("repositories"), F.sum("times").alias("times"))


def copied(scanned: DataFrame) -> DataFrame:
    """The hashes of copied examples, each with all salts."""
    common = ownership(scanned).filter((F.col("owners") > MOST_OWNERS) | (F.col("repositories") > MOST_REPOSITORIES))
    return common.select("hash", F.lit(True).alias("common"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int")


def secret_spans(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Per row of docs: row, doc_id, spans (array of start, kind, end, live), in order of start and kind.

    Base spans always stay, with live saying what their ownership shows; of the other candidates the live ones stay.
    """
    scanned = written(scan(docs, owner, repository), "secrets")
    each = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumn("salt", _salt())
    judged = each.join(copied(scanned), ["hash", "salt"], "left").withColumn("live", F.col("common").isNull()).filter((F.col("kind") < 3) | F.col("live"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))
    return scanned.select("row", "doc_id").join(spans, "row", "left").select("row", "doc_id", F.coalesce("spans", F.array().cast("array<struct<start:long,kind:int,end:long,live:boolean>>")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(secret_spans(table(spark, sf_dir, "documents")))


def digests(found: DataFrame) -> DataFrame:
    """Per row of found: doc_id, counts by kind, base_sha256, spans (all, as text), and how many base spans are copied examples."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    count_of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    n_copied = F.size(F.filter(spans, lambda s: ~s["live"])).cast("long")
    return found.select("doc_id", count_of(0).alias("n_assign"), count_of(1).alias("n_access"), count_of(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), count_of(3).alias("n_live"), n_copied.alias("n_copied"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of its text replaced by mask and n_chars counted anew.

    The rows are numbered and written once. The spans are found again in place; which candidates are live comes from the corpus's ownership counts,
    sent back as the set of hashes that each row needs.
    """
    columns = docs.columns
    row, hashes = fresh(docs, "row"), fresh(docs, "live_hashes")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    scanned = written(scan(numbered, row=row), "secrets")
    others = scanned.select("row", F.explode(F.filter("found", lambda s: s["kind"] == 3)).alias("f")).select("row", "f.start", "f.hash").withColumn("salt", _salt())
    keys = others.join(copied(scanned), ["hash", "salt"], "left_anti").groupBy(F.col("row").alias(row)).agg(F.collect_set("hash").alias(hashes))
    both = numbered.join(keys, row, "left").drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for value, live_here in zip(batch.column("text"), batch.column(hashes), strict=True):
                text = value.as_py()
                if text:
                    wanted = set(live_here.as_py() or ())
                    base = base_spans(text)
                    spans = [(a, b) for a, k, b, h in candidates(text, base) if k < 3 or h in wanted] if wanted else [(a, b) for a, _, b, _ in base]
                    out, at = [], 0
                    for a, b in sorted(spans):
                        if b > at:
                            out += [text[at:a], mask] if a >= at else []
                            at = b
                    text = "".join(out) + text[at:]
                texts.append(text)
                sizes.append(None if text is None else len(text))
            held = {name: batch.column(name) for name in columns} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in held:
                held["n_chars"] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(list(held.values()), list(held))

    return both.mapInArrow(run, docs.schema)
