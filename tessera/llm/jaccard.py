"""N-gram Jaccard join with parity sketches.

A document's set holds its distinct runs of five words, hashed.  XOR-ing each hash
into one of q cells gives its sketch; the number of cells in which two sketches differ (their
Hamming distance over cells) is at most the sets' symmetric difference.  Sets with a
Jaccard similarity of 0.75 or more whose smaller one has b shingles differ in b / 3
shingles at most.  Sizes are banded by powers of two; in each band q is half as large again as the
largest such difference, so by the pigeonhole principle some cells of the two sketches
are equal.  Documents meet by equal cells and every meeting is verified on the sets, unless sizes
or parity sketches (one bit for each place, a place or more for each shingle), whose Hamming distance bounds
the difference in the same way, rule a link out.  A set is sketched for its own band and, if it may be the
larger of a pair, for the band below.

Copies: documents with equal sets are one class from the start; only one of each is sketched.

Frequent cells: a cell that more than FEW classes share is not expanded into pairs.  A link of a set with n shingles
differs in n // 3 cells at most, so of the set's cells, in order of how many classes share them, the first n // 3 + 1
hold the rarest cell that the link's two sets share (and likewise for the other set). Most sets have so many cells that are not frequent:
their links are all found. Of the others' frequent cells only those among the first n // 3 + 1 matter.  Within such a cell
what counts is that all linked members get connected: cells whose members are of one component are done, the others'
members are compared with the most central member and with the most central one outside its component (PIVOT_ROUNDS times),
and in cells that still hold several components, members of different ones are compared by their sketches, in tiles
of TILE members or so, and verified where sketches don't rule a link out.

Cells without a shingle say nothing and are left out, except for sets with so few others that a link might differ in all
of these.  Nothing is left to chance but the equality of 64-bit hashes, and no cell, pair or member is dropped for being frequent.

Defined cases: a null or empty text, or one without words, has an empty set and is linked
with nothing; under five words, all words are the one shingle; repeated rows form
a class; component_id is the smallest doc_id of the component other than null, or null if it has none (a row that is linked with
nothing has its own doc_id); an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.frames import fresh, in_order, partitions, table, total_bytes, written
from tessera.llm.words import NOT_SPACE, groups, mix, words

SHINGLE = 5
#: Sets are linked when PERCENT * union <= 100 * intersection.
PERCENT = 75
FEW = 8
SLACK = 16
PIVOT_ROUNDS = 2
#: Members of a frequent cell that are compared in one task, twice as many at most; rows of a frequent cell that are joined in one.
TILE, SALTED = 1024, 4096
BLOCK_BYTES = 4 << 20
PART_KEYS = 1_000_000
PLACE = 32
#: Places of a parity sketch at least.
SKETCH_BITS = 256
#: Places of the sketches that members of frequent cells are compared by.
WIDE_BITS = 4096


class Sets:
    """The shingle sets of a block's documents, in order: sorted hashes of document i are values[edge[i]:edge[i + 1]].

    only: numbers of the documents that are asked for; the others' sets are left empty.
    """

    def __init__(self, block: pa.Table, only: Iterable[int] | None = None) -> None:
        order = in_order(block)
        ids, texts = block.column("doc_id").to_pylist(), block.column("text").cast(pa.binary()).to_pylist()
        self.ids = [ids[i] for i in order]
        asked = None if only is None else set(only)
        kept = [texts[i] if asked is None or n in asked else b"" for n, i in enumerate(order)]
        del texts
        sets = []
        for first, last in groups(kept):
            found = words(kept[first:last], NOT_SPACE, True)
            at, hashes = found.runs(SHINGLE)
            edges = np.searchsorted(found.row[at], np.arange(last - first + 1))
            for i, n in enumerate(np.diff(found.first).tolist()):
                sets.append(np.unique(hashes[edges[i] : edges[i + 1]]) if n >= SHINGLE else np.array([found.whole(i)] if n else [], np.uint64))
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.values = np.concatenate([np.zeros(0, np.uint64), *sets])

    def of(self, i: int) -> np.ndarray:
        return self.values[self.edge[i] : self.edge[i + 1]]

    def mark(self, i: int) -> bytes:
        """128 bits that tell sets apart."""
        v = self.of(i)
        return np.array([np.add.reduce(mix(v)), np.bitwise_xor.reduce(mix(v ^ np.uint64(0x9E3779B97F4A7C15)))], np.uint64).tobytes()


def bound(band: int) -> int:
    """The largest symmetric difference of linked sets whose smaller one is in the band."""
    return ((2 << band) - 1) // 3


def cells_of(band: int) -> int:
    return bound(band) + 1 + max(bound(band) // 2, min(bound(band), SLACK))


def cells(sets: Sets, docs: np.ndarray, below: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sketches of documents docs in their own band or the one below; the document of each key; each document's number of keys."""
    size = sets.size[docs]
    band = np.frompyfunc(lambda n: int(n).bit_length() - 1, 1, 1)(size).astype(np.int64) - below
    ok = band >= 1
    if below:
        ok &= 3 * size <= 4 * ((2 << np.maximum(band, 0)) - 1)
    docs, size, band = docs[ok], size[ok], band[ok]
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    q = np.array([cells_of(int(k)) for k in band], np.int64)
    base = np.cumsum(q) - q
    who = np.repeat(np.arange(len(docs)), size)
    values = sets.values[np.repeat(sets.edge[docs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    spread = mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F))
    cell = base[who] + (((spread >> np.uint64(32)) * q[who].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    total = int(q.sum())
    content = np.zeros(total, np.uint64)
    np.bitwise_xor.at(content, cell, mix(values))
    held = np.bincount(cell, minlength=total) > 0
    owner = np.repeat(np.arange(len(docs)), q)
    n_held = np.bincount(owner[held], minlength=len(docs))
    # a link might differ in all cells with a shingle: equal ones without count too
    all_count = n_held <= np.minimum([bound(int(k)) for k in band], size // 3)
    keep = held | all_count[owner]
    number = np.arange(total) - base[owner]
    keys = mix(content ^ mix((band[owner] << 40 | number).astype(np.uint64)))[keep]
    return keys, docs[owner[keep]], np.stack([docs, np.where(all_count, q, n_held)])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are linked."""
    n = len(a) + len(b)
    if not n or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[place] == small).sum())
    return 100 * both >= PERCENT * (n - both)


def sketch(values: np.ndarray, places: int = 0) -> np.ndarray:
    """The parity of the number of shingles at each of so many places (0: as many as the set has shingles at least, a power of two)."""
    places = places or max(SKETCH_BITS, 1 << (len(values) - 1).bit_length() if len(values) else 0)
    return np.packbits((np.bincount((values & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8), bitorder="little")


def may_be_linked(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
    """False if sizes or the sketches' Hamming distance rule a link out: linked sets differ in (n + m) / 7 shingles at most."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    # the longer sketch is folded: places that agree modulo the shorter one's length fall together
    while len(a) != len(b):
        a, b = (b, a) if len(a) < len(b) else (a, b)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return (100 + PERCENT) * int(np.bitwise_count(a ^ b).sum()) <= (100 - PERCENT) * (n + m)


def _block(place: str) -> Column:
    return F.shiftright(place, PLACE).cast("int")


def _rows(schema: str, /, **columns: Iterable) -> pa.Table:
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    return pa.table({name: pa.array(columns[name], types[t]) for name, t in (x.split() for x in schema.split(", "))})


class Join:
    """The join over one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark = docs.sparkSession
        octets = total_bytes(docs)
        self.parts = int(max(partitions(self.spark), octets // 9 // PART_KEYS))
        blocks = int(max(partitions(self.spark), octets // BLOCK_BYTES))
        self.key = fresh(docs, "block")
        self.rows = docs.withColumn(self.key, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
        self.dealt = self.rows.select("doc_id", "text", F.col(self.key).alias("block"))

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """Documents (place, doc_id, n, mark) and classes (mark, place of the first document, n, block, least doc_id, place of the row to be kept)."""

        def run(block: pa.Table) -> pa.Table:
            sets, number = Sets(block), block.column("block")[0].as_py()
            return _rows("place long, doc_id long, n long, mark binary", place=[number << PLACE | i for i in range(len(sets.ids))], doc_id=sets.ids, n=sets.size, mark=[sets.mark(i) if n else None for i, n in enumerate(sets.size.tolist())])

        members = written(self.dealt.groupBy("block").applyInArrow(run, "place long, doc_id long, n long, mark binary"), "members")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("first")
        found = members.filter("mark is not null").groupBy("mark").agg(F.min("place").alias("place"), F.min("n").alias("n"), first)
        return members, written(found.withColumn("block", _block("place")), "classes")

    def meetings(self, classes: DataFrame) -> DataFrame:
        """kind, a, b, below, many: 0: a pair of places that share a cell; 1: a frequent cell a, of many members, and the place b of one; 2: b cells of place a."""
        parts = self.parts
        kind = "kind int, a long, b long, below int, many int"

        def send(block: pa.Table, firsts: pa.Table) -> pa.Table:
            out: list[tuple[int, bytes, bytes]] = []
            if not len(block) or not len(firsts):
                return _rows("block int, part int, keys binary, places binary", block=[], part=[], keys=[], places=[])
            number = block.column("block")[0].as_py()
            docs = np.sort(firsts.column("place").to_numpy() & ((1 << PLACE) - 1))
            sets = Sets(block, docs.tolist())
            found = [cells(sets, docs, below) for below in (False, True)]
            keys = np.concatenate([f[0] for f in found])
            place = np.concatenate([f[1] << 1 | below for below, f in enumerate(found)])
            part = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            wide = np.uint16 if len(sets.ids) < 1 << 14 else np.uint32
            keys, place = keys[order].astype(np.uint32), place[order].astype(wide)
            for p in np.flatnonzero(np.diff(edges)).tolist():
                out.append((p, keys[edges[p] : edges[p + 1]].tobytes(), place[edges[p] : edges[p + 1]].tobytes()))
            counts = np.concatenate([np.stack([f[2][0] << 1 | below, f[2][1]]) for below, f in enumerate(found)], 1)
            out.append((parts + number, counts[0].astype(np.uint32).tobytes(), counts[1].astype(np.uint32).tobytes()))
            return _rows("block int, part int, keys binary, places binary", block=[number] * len(out), part=[x[0] for x in out], keys=[x[1] for x in out], places=[x[2] for x in out])

        def meet(part: pa.Table) -> pa.Table:
            p, blocks = part.column("part")[0].as_py(), part.column("block").to_numpy().astype(np.int64)
            raw_keys, raw_places = part.column("keys").to_pylist(), part.column("places").to_pylist()
            keys = np.concatenate([np.frombuffer(x, np.uint32) for x in raw_keys])
            sizes = np.fromiter((len(x) // 4 for x in raw_keys), np.int64, len(raw_keys))
            place = np.concatenate([np.frombuffer(x, np.uint16 if len(x) * 2 == len(k) else np.uint32).astype(np.int64) for x, k in zip(raw_places, raw_keys, strict=True)])
            del raw_keys, raw_places
            block = np.repeat(blocks, sizes) << PLACE
            if p >= parts:
                kept = keys.astype(np.int64)
                return _rows(kind, kind=np.full(len(kept), 2), a=block | kept >> 1, b=place, below=kept & 1, many=np.zeros(len(kept), np.int32))
            order = np.argsort(keys, kind="stable")
            keys, gid, below = keys[order], (block | place >> 1)[order], (place & 1)[order].astype(np.int8)
            del order, place, block
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            length = np.diff(np.concatenate([start, [len(keys)]]))
            # two sets that are both sketched for the band below meet in their own band
            alone = np.repeat(np.minimum.reduceat(below, start) == 1, length)
            many = np.repeat(length.astype(np.int32), length)
            pairs = []
            for lag in range(1, FEW):
                i = np.flatnonzero((keys[lag:] == keys[:-lag]) & (many[lag:] <= FEW) & ((below[lag:] & below[:-lag]) == 0))
                pairs.append(np.stack([np.minimum(gid[i], gid[i + lag]), np.maximum(gid[i], gid[i + lag])]))
            found = np.concatenate(pairs, 1)
            del pairs
            found = found[:, found[0] != found[1]]
            found = found[:, np.lexsort(found)]
            if found.shape[1]:
                found = found[:, np.concatenate([[True], (found[:, 1:] != found[:, :-1]).any(0)])]
            hot = np.flatnonzero((many > FEW) & ~alone)
            n = found.shape[1]
            a, b = np.concatenate([found[0], p << PLACE | keys[hot].astype(np.int64)]), np.concatenate([found[1], gid[hot]])
            return _rows(kind, kind=np.repeat([0, 1], [n, len(hot)]), a=a, b=b, below=np.concatenate([np.zeros(n, np.int32), below[hot].astype(np.int32)]), many=np.concatenate([np.zeros(n, np.int32), many[hot]]))

        sent = self.dealt.groupBy("block").cogroup(classes.select("place", "block").groupBy("block")).applyInArrow(send, "block int, part int, keys binary, places binary")
        return written(sent.groupBy("part").applyInArrow(meet, kind), "meetings")

    def verify(self, pairs: DataFrame, sketched: bool = False) -> DataFrame:
        """The pairs (a, b) of places whose sets are linked: sketches meet first (unless they have), and only sets that they don't rule out."""
        return self._compared(pairs if sketched else self._compared(pairs, sketches=True), sketches=False)

    def _compared(self, pairs: DataFrame, sketches: bool) -> DataFrame:
        """The pairs (a, b) that pass. The sketch or set of a goes once to each block that has a partner, however many it has there."""
        kind = "block int, a long, b long, size long, data binary"
        inside = (1 << PLACE) - 1

        def ship(block: pa.Table, wanted: pa.Table) -> pa.Table:
            if not len(block) or not len(wanted):
                return _rows(kind, block=[], a=[], b=[], size=[], data=[])
            a = wanted.column("a").to_numpy()
            own = (a & inside).tolist()
            sets = Sets(block, own)
            data = {i: (sketch(sets.of(i)) if sketches else sets.of(i)).tobytes() for i in set(own)}
            return _rows(kind, block=wanted.column("to").to_numpy(), a=a, b=[None] * len(a), size=sets.size[own], data=[data[i] for i in own])

        def check(block: pa.Table, said: pa.Table) -> pa.Table:
            found_a, found_b = [], []
            if len(block) and len(said):
                data = said.filter(pc.is_valid(said.column("data")))
                row = {a: n for n, a in enumerate(data.column("a").to_pylist())}
                sizes, raw = data.column("size").to_pylist(), data.column("data")
                asked = said.filter(pc.is_valid(said.column("b")))
                a, b = asked.column("a").to_numpy(), asked.column("b").to_numpy()
                order = np.lexsort((b, a))
                sets = Sets(block, set((b & inside).tolist()))
                own: dict[int, np.ndarray] = {}
                now, its = None, np.zeros(0, np.uint8)
                for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                    if x != now:
                        now, its = x, np.frombuffer(raw[row[x]].as_py(), np.uint8 if sketches else np.uint64)
                    i = y & inside
                    if sketches and i not in own:
                        own[i] = sketch(sets.of(i))
                    if may_be_linked(sizes[row[x]], its, int(sets.size[i]), own[i]) if sketches else linked(its, sets.of(i)):
                        found_a.append(x)
                        found_b.append(y)
            return _rows("a long, b long", a=found_a, b=found_b)

        pairs = pairs.select("a", "b", _block("b").alias("block"))
        wanted = pairs.select("a", F.col("block").alias("to")).distinct().withColumn("block", _block("a"))
        shipped = self.dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(ship, kind)
        said = shipped.unionByName(pairs.select("block", "a", "b", F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("data")))
        return written(self.dealt.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(check, "a long, b long"), "compared")

    def links(self, classes: DataFrame) -> DataFrame:
        """node and root of the stars of the classes' components, by links enough to connect all that are connected."""
        met = self.meetings(classes)
        stars = components(self.verify(met.filter("kind = 0").select("a", "b").distinct()))
        left = written(self._decisive(met, classes), "frequent")
        if left.isEmpty():
            return stars
        tried = self.spark.createDataFrame([], "a long, b long")
        join_stars = lambda found: components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        for n in range(PIVOT_ROUNDS):
            pairs = written(self._with_pivots(left, stars).join(tried, ["a", "b"], "left_anti") if n else self._with_pivots(left, stars), "pivots")
            if pairs.isEmpty():
                break
            stars, tried = join_stars(self.verify(pairs, sketched=True)), tried.unionByName(pairs)
        members = self._open(left, stars)
        if members.isEmpty():
            return stars
        pairs = written(self._near(members, self._wide_sketches(members.select("place").distinct())), "near")
        return join_stars(self.verify(pairs, sketched=True)) if not pairs.isEmpty() else stars

    def _decisive(self, met: DataFrame, classes: DataFrame) -> DataFrame:
        """cell, place, many, central: the frequent cells of each place among the first n // 3 + 1 of its cells, rarest first; central: how many frequent cells it has."""
        hot = met.filter("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("place"), "below", "many")
        load = hot.groupBy("place", "below").agg(F.count(F.lit(1)).alias("central"))
        counts = met.filter("kind = 2").select(F.col("a").alias("place"), F.col("b").alias("cells"), "below")
        needed = (F.floor(F.col("n") / 3) + 1 - (F.col("cells") - F.col("central"))).alias("needed")
        needs = load.join(counts, ["place", "below"]).join(classes.select("place", "n"), "place").select("place", "below", "central", needed).filter("needed > 0")
        rank = F.row_number().over(W.partitionBy("place", "below").orderBy("many", "cell"))
        return hot.join(needs, ["place", "below"]).withColumn("rank", rank).filter("rank <= needed").select("cell", "place", "many", "central")

    @staticmethod
    def _rooted(left: DataFrame, stars: DataFrame) -> DataFrame:
        return left.join(stars.select(F.col("node").alias("place"), "root"), "place", "left").withColumn("root", F.coalesce("root", "place"))

    def _with_pivots(self, left: DataFrame, stars: DataFrame) -> DataFrame:
        """Pairs (pivot, place): members of each cell with its most central one, and with the most central one of another component than that, unless they are of one component."""
        rooted = written(self._rooted(left, stars), "rooted")
        best = rooted.groupBy("cell", "root").agg(F.max(F.struct("central", "place")).alias("best"))
        top = best.groupBy("cell").agg(F.max(F.struct("best", "root")).alias("top"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
        other = best.join(top, "cell").filter("root <> top.root").groupBy("cell").agg(F.first("top").alias("top"), F.max(F.struct("best", "root")).alias("other"))
        salts = F.sequence(F.lit(0), F.ceil(F.col("many") / SALTED).cast("int") - 1)
        pivots = other.select("cell", F.explode(F.array("top", "other")).alias("p")).select("cell", F.col("p.best.place").alias("a"), F.col("p.root").alias("pivot_root"))
        size = rooted.groupBy("cell").agg(F.first("many").alias("many"))
        salted = pivots.join(size, "cell").withColumn("salt", F.explode(salts)).drop("many")
        members = rooted.withColumn("salt", F.pmod(F.xxhash64("place"), F.ceil(F.col("many") / SALTED)).cast("int"))
        return members.join(salted, ["cell", "salt"]).filter("root <> pivot_root").select("a", F.col("place").alias("b")).distinct()

    def _open(self, left: DataFrame, stars: DataFrame) -> DataFrame:
        """cell, many, place, root: members of cells that hold more than one component."""
        rooted = written(self._rooted(left, stars), "rooted")
        several = rooted.groupBy("cell").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("cell")
        return written(rooted.join(several, "cell", "left_semi").select("cell", "many", "place", "root"), "open")

    def _wide_sketches(self, places: DataFrame) -> DataFrame:
        """place, size, bits of the places."""

        def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
            own = [int(p) & ((1 << PLACE) - 1) for p in wanted.column("place").to_pylist()]
            sets = Sets(block, own)
            return _rows("place long, size long, bits binary", place=wanted.column("place").to_pylist(), size=sets.size[own] if own else [], bits=[sketch(sets.of(i), WIDE_BITS).tobytes() for i in own])

        placed = places.select("place", _block("place").alias("block"))
        return written(self.dealt.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(run, "place long, size long, bits binary"), "wide")

    def _near(self, members: DataFrame, drawn: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of one cell that are in different components and that their sketches don't rule out. Members are dealt into
        tiles by hash, and each two tiles meet in one task."""

        def run(group: pa.Table) -> pa.Table:
            label = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
            order = np.argsort(label == np.bincount(label).argmax(), kind="stable")  # the largest component comes last
            label = label[order]
            rest = int((label != label[-1]).sum())
            place, size = group.column("place").to_numpy()[order], group.column("size").to_numpy()[order]
            bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(place), -1)[order]
            while bits.shape[1] > SKETCH_BITS // 16 and 64 * bits.shape[1] >= 8 * int(size.max()):
                bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]  # enough places for sets of these sizes
            rows = max(1, (1 << 18) // len(place))
            found = [np.zeros((2, 0), np.int64)]
            for x in range(0, rest, rows):
                mine, others = bits[x : min(rest, x + rows)], bits[x:]
                far = np.zeros((len(mine), len(others)), np.int32)
                for word in range(bits.shape[1]):
                    far += np.bitwise_count(mine[:, word, None] ^ others[None, :, word])
                n, m = size[x : x + len(mine), None], size[None, x:]
                ok = ((100 + PERCENT) * far <= (100 - PERCENT) * (n + m)) & (label[x : x + len(mine), None] != label[None, x:])
                ok &= 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
                i, j = np.nonzero(ok)
                i, j = i[i < j], j[i < j]
                found.append(np.stack([place[i + x], place[j + x]]))
            a, b = np.concatenate(found, 1)
            return _rows("a long, b long", a=np.minimum(a, b), b=np.maximum(a, b))

        tiles = F.ceil(F.col("many") / TILE).cast("int")
        own = F.pmod(F.xxhash64("place"), F.col("tiles")).cast("int")
        pairs_of = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j")))
        tiled = members.join(drawn, "place").withColumn("tiles", tiles).withColumn("t", F.explode(pairs_of)).select("cell", "t.i", "t.j", "place", "root", "size", "bits")
        return tiled.groupBy("cell", "i", "j").applyInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, place, root of each row of docs; place and root name rows, the root that of the component's row with the smallest doc_id (null last)."""
    made = Join(docs)
    return labelled(*made.classes(), made)


def labelled(members: DataFrame, classes: DataFrame, made: Join) -> DataFrame:
    stars = made.links(classes)
    roots = written(classes.join(stars, classes["place"] == stars["node"], "left").select("mark", "first", F.coalesce("root", "place").alias("own")), "roots")
    # written, so that Spark can split a large component's rows in the join
    first = written(roots.groupBy("own").agg(F.min("first").alias("first")), "firsts")
    named = written(roots.select("mark", "own").join(first, "own").select("mark", F.col("first.doc_id").alias("component_id"), F.col("first.place").alias("root")), "components")
    out = members.join(named, "mark", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "place", F.coalesce("root", "place").alias("root"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first (smallest doc_id, null last) of their component, with all columns."""
    made = Join(docs)
    members, classes = made.classes()
    kept = labelled(members, classes, made).filter("place = root").select("place", _block("place").alias("block"))
    columns = docs.columns

    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(block):
            return block.select(columns)
        order = in_order(block)
        return block.select(columns).take(pa.array([order[int(p) & ((1 << PLACE) - 1)] for p in wanted.column("place").to_pylist()], pa.int64()))

    return made.rows.groupBy(made.key).cogroup(kept.groupBy("block")).applyInArrow(run, docs.schema)
