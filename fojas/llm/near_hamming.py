"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A text's set of word shingles is sketched by ``POSITIONS`` minima, of which 8 bits each are kept. Two
signatures are near when at most ``max_errors`` positions differ. The positions are cut into chunks so
that, by the pigeonhole principle, a near pair has a chunk with at most ``floor(max_errors / chunks)``
errors. Each chunk is indexed under every allowed error: with that many positions masked, equal rests
are equal keys. So every pair under the threshold shares a key. Candidates are then confirmed on the
full sets, by exact Jaccard similarity.

A pair with similarity 0.8 has 0.2 * 64 = 12.8 errors on average; 25 is 3.9 deviations above, so such a
pair is over the threshold about once in 8,000 times, and more similar ones far more seldom.

No group's pairs are enumerated. Texts with equal sets are one class. In each key's bucket members are
first compared with one leader, twice with different leaders, and joined into components; then only
members of different components are compared, each member outside the bucket's largest component with
the others. Links inside a component cannot change it. Members outside are held in blocks of bounded size, and
the members that pass a block are dealt over several tasks, so a bucket of any size fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas.llm.common import SPACE_WORDS, mix, signed, text_chunks, word_hashes, written
from fojas.llm.components import components

POSITIONS = 64
MAX_ERRORS = 25
CHUNKS = 13
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHTS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIG = [f"s{i}" for i in range(POSITIONS // 8)]
#: Further minima of which one bit is kept, for members that need closer comparison. A pair with
#: similarity 0.8 differs in 102 of them on average, with a deviation of 9.6.
FINE = 1024
FINE_ERRORS = 141
FINE_COLUMNS = [f"t{i}" for i in range(FINE // 64)]
#: Members of a bucket that a task holds, and about how many it lets pass them.
HELD = 8192
PASSING = 65536
#: Shingles whose fine minima are taken in one step.
STRETCH = 16384
_FINE_FACTORS = _RNG.integers(1, 2**63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted hashes of the k-word shingles of one text; of all words when there are fewer."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        h += words[j : j + n] * _WEIGHTS[j]
    if len(words) < k:
        h += np.uint64(len(words))
    return np.unique(mix(h))


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in text_chunks(batch):
                words, first = word_hashes(texts, SPACE_WORDS)
                sets = [shingles(words[first[i] : first[i + 1]], k) for i in range(to - at)]
                sizes = np.array([len(s) for s in sets])
                sums, xors = np.zeros((2, to - at), np.uint64)
                sig = np.zeros((to - at, POSITIONS), np.uint8)
                full = np.flatnonzero(sizes)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    cuts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    sums[full] = np.add.reduceat(mix(flat), cuts)
                    xors[full] = np.bitwise_xor.reduceat(mix(flat + np.uint64(1)), cuts)
                    for j in range(POSITIONS):
                        sig[full, j] = np.minimum.reduceat(flat * _FACTORS[j], cuts).astype(np.uint8)
                longs = sig.view(np.int64)
                arrays = [*(batch.column(c).slice(at, to - at) for c in ("id", "th")), pa.array(sizes, pa.int64()), pa.array(signed(sums)), pa.array(signed(xors))]
                arrays += [pa.array(np.ascontiguousarray(longs[:, i])) for i in range(len(SIG))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "th", "n", "f1", "f2", *SIG])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in text_chunks(batch):
                words, first = word_hashes(texts, SPACE_WORDS)
                sets = [signed(shingles(words[first[i] : first[i + 1]], k)) for i in range(to - at)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def index_masks(positions: int = POSITIONS, chunks: int = CHUNKS, max_errors: int = MAX_ERRORS) -> list[tuple[int, tuple[int, ...]]]:
    """(chunk, positions kept) of every key of a signature."""
    allowed = max_errors // chunks
    cuts = [positions * c // chunks for c in range(chunks + 1)]
    return [
        (c, kept)
        for c in range(chunks)
        for kept in combinations(range(cuts[c], cuts[c + 1]), max(1, cuts[c + 1] - cuts[c] - allowed))
    ]


def signature_keys(sig: np.ndarray, masks: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Signatures (n, positions) of bytes to their keys (n, masks)."""
    out = np.empty((len(sig), len(masks)), np.int64)
    wide = sig.astype(np.uint64)
    for m, (_, kept) in enumerate(masks):
        h = np.full(len(sig), m + 1, np.uint64)  # the mask is part of the key
        for p in kept:
            h = h * np.uint64(257) + wide[:, p] + np.uint64(1)
        out[:, m] = signed(mix(h))
    return out


def _keys(masks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                longs = np.stack([part.column(s).to_numpy(zero_copy_only=False) for s in SIG], axis=1)
                keys = signature_keys(np.ascontiguousarray(longs).view(np.uint8), masks)
                ids = np.repeat(part.column("rep").to_numpy(zero_copy_only=False), len(masks))
                numbers = np.tile(np.arange(len(masks), dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(numbers)], names=["key", "rep", "mask"])

    return run


def errors(left: str, right: str) -> Column:
    """Positions (bytes) in which two signatures differ."""
    total = F.lit(0)
    for s in SIG:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def features(docs: DataFrame, k: int) -> DataFrame:
    """(id, text) to (id, hash of the text, n, fingerprint of the set, signature)."""
    columns = ", ".join(["id long", "th long", "n long", "f1 long", "f2 long", *(f"{s} long" for s in SIG)])
    return docs.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(_features(k), columns)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets (id, shingles) have at least ``percent`` % similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.filter(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, max_errors: int = MAX_ERRORS, chunks: int = CHUNKS) -> DataFrame:
    """(id, text) to (id, th, n_shingles, component_id, kept), a row for each row; th is xxhash64 of the text.

    Words are runs of other than ASCII white space, A-Z lower-cased; sets are of k-word shingles, or the
    whole sequence of a shorter text. Null and empty texts, and texts of white space, have an empty set
    and link with nothing. A null id links with nothing: its component is null and it is kept. Equal rows
    give equal rows. Rows with one id but different texts are judged each by its own text; such texts count
    as linked where that id is the smallest of both sets. An empty table gives none. Other columns of
    ``docs`` are not read.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), "text")
    found = written(features(docs, k), "features")
    set_key = ["f1", "f2", "n"]
    classes = written(
        found.filter("n > 0 and id is not null").groupBy(*set_key).agg(F.min("id").alias("rep"), *(F.min(s).alias(s) for s in SIG)), "classes"
    )
    masks = index_masks(POSITIONS, chunks, max_errors)
    keys = classes.select("rep", *SIG).mapInArrow(_keys(masks), "key long, rep long, mask int")
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key")
    members = written(keys.join(shared, "key").distinct().join(classes.select("rep", *SIG), "rep"), "members")

    wanted = members.select(F.col("rep").alias("id")).distinct()
    sets = docs.join(wanted, "id", "left_semi").mapInArrow(_sets(k), "id long, shingles array<long>")
    sets = written(sets, "sets")
    links = None
    for leader in (F.col("rep"), F.xxhash64(F.col("rep"))):
        first = members.groupBy("key").agg(F.min_by(F.struct("rep", *SIG), leader).alias("l")).select("key", "l.*")
        pairs = members.alias("m").join(first.alias("l"), "key").filter((F.col("m.rep") != F.col("l.rep")) & (errors("m", "l") <= max_errors))
        pairs = pairs.select(F.least("m.rep", "l.rep").alias("a"), F.greatest("m.rep", "l.rep").alias("b")).distinct()
        if links is not None:
            pairs = _apart(pairs, components(_edges(links)))
        new = written(confirmed(pairs, sets, percent), "links")
        links = new if links is None else links.unionByName(new)
    rest = _rest(members, sets, components(_edges(links)), max_errors, masks)
    links = links.unionByName(written(confirmed(rest, sets, percent), "links"))
    joined = components(_edges(links))
    of_set = classes.select(*set_key, "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_set = of_set.select(*set_key, F.coalesce("component", "rep").alias("component"))
    out = found.select("id", "th", *set_key).join(of_set, set_key, "left")
    component = F.when(F.col("id").isNull() | F.col("component").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").eqNullSafe(component)).alias("kept"))


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(members: DataFrame, joined: DataFrame) -> DataFrame:
    return members.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    for end in ("a", "b"):
        pairs = pairs.join(joined.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit each of FINE minima of a set."""
    for batch in batches:
        lists = batch.column("shingles")
        sets = [x.values.to_numpy().view(np.uint64) if len(x.values) else np.zeros(1, np.uint64) for x in lists]
        bits = np.zeros((len(sets), FINE), np.uint8)
        for d, own in enumerate(sets):
            for j in range(0, FINE, 64):
                least = np.full(64, np.iinfo(np.uint64).max)
                for i in range(0, len(own), STRETCH):
                    np.minimum(least, (own[i : i + STRETCH, None] * _FINE_FACTORS[None, j : j + 64]).min(axis=0), out=least)
                bits[d, j : j + 64] = least >> np.uint64(7) & np.uint64(1)
        longs = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(FINE // 64))], names=["id", *FINE_COLUMNS])


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) if len(names) > 1 else batch.column(names[0]).to_numpy(zero_copy_only=False)


class _Members:
    """Some members of a bucket as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.rep, self.component = _columns(batch, ["rep"]), _columns(batch, ["component"])
        self.sig = np.ascontiguousarray(_columns(batch, SIG)).view(np.uint8)
        self.bits = np.ascontiguousarray(_columns(batch, FINE_COLUMNS)).view(np.uint64)
        self.mask = int(batch.column("mask")[0].as_py())


def _near(x: _Members, y: _Members, max_errors: int, kept: np.ndarray, ordered: bool) -> Iterator[pa.RecordBatch]:
    """Near pairs of x and y in different components that have no key before this bucket's in common."""
    for i in range(0, len(x.rep), 32):
        for j in range(0, len(y.rep), 2048):
            far = np.bitwise_count(x.bits[i : i + 32, None, :] ^ y.bits[None, j : j + 2048, :]).sum(axis=2, dtype=np.int32)
            ok = (far <= FINE_ERRORS) & (x.component[i : i + 32, None] != y.component[None, j : j + 2048])
            if ordered:
                ok &= x.rep[i : i + 32, None] < y.rep[None, j : j + 2048]
            a, b = np.nonzero(ok)
            differ = x.sig[i + a] != y.sig[j + b]
            first = np.argmax(differ.astype(np.int16) @ kept.T == 0, axis=1)
            use = (differ.sum(axis=1) <= max_errors) & (first == x.mask)
            a, b = x.rep[i + a[use]], y.rep[j + b[use]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _compare(max_errors: int, masks):
    kept = np.zeros((len(masks), POSITIONS), np.int16)
    for m, (_, places) in enumerate(masks):
        kept[m, list(places)] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            groups, holds = _columns(batch, ["key", "block", "deal"]), _columns(batch, ["held"])
            turns = (groups[1:] != groups[:-1]).any(axis=1) | (holds[1:] != holds[:-1])
            turn = np.flatnonzero(np.concatenate(([True], turns))) if len(groups) else []
            for at, to in zip(turn, [*turn[1:], len(groups)]):
                if group is None or (groups[at] != group).any():
                    group, held = groups[at], []
                part = _Members(batch.slice(at, to - at))
                if not holds[at] or not group[2]:  # what is held meets itself in one of its tasks
                    for x in held:
                        yield from _near(x, part, max_errors, kept, False)
                if holds[at]:
                    if not group[2]:
                        yield from _near(part, part, max_errors, kept, True)
                    held.append(part)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, outside, n_outside, n_members) to those of each task (key, block, deal): members outside the
    largest component are held in one block by all its deals, and pass the later blocks, in one deal each, as the
    other members pass all blocks. With few members that is one task."""
    blocks, deals = (F.ceil(F.col(n) / size).cast("int") for n, size in (("n_outside", HELD), ("n_members", PASSING)))
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("rep"), blocks)).otherwise(F.lit(-1)).cast("int")
    one = F.pmod(F.xxhash64("rep", F.lit(1)), deals).cast("int")
    rows = rows.withColumn("own", own).withColumn("one", one).withColumn("deals", deals)
    rows = rows.withColumn("block", F.explode(F.sequence(F.greatest("own", F.lit(0)), blocks - 1)))
    rows = rows.withColumn("held", F.col("block") == F.col("own"))
    places = F.when(F.col("held"), F.sequence(F.lit(0), F.col("deals") - 1)).otherwise(F.array("one"))
    return rows.withColumn("deal", F.explode(places)).drop("own", "one", "deals", "n_outside", "n_members", "outside")


def _rest(members: DataFrame, sets: DataFrame, joined: DataFrame, max_errors: int, masks) -> DataFrame:
    """Near pairs of one bucket and different components: members outside its largest one with all others.

    Candidates get FINE more bits first, of which pairs over the similarity differ in few; so pairs that
    are somewhat below it need no look at their sets. A pair is given by one of its buckets.
    """
    rows = _labelled(members, joined)
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n_members"), F.max("n").alias("n_main")
    )
    main = main.filter("parts > 1").select("key", "main", "n_members", (F.col("n_members") - F.col("n_main")).alias("n_outside"))
    rows = written(rows.join(main, "key"), "rows")
    wanted = sets.join(rows.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    bits = wanted.mapInArrow(_bits, ", ".join(["id long", *(f"{c} long" for c in FINE_COLUMNS)])).dropDuplicates(["id"])
    rows = _dealt(rows.withColumn("outside", F.col("component") != F.col("main")).drop("main")).join(bits.withColumnRenamed("id", "rep"), "rep")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = ["key", "block", "deal"]
    sorted_rows = rows.repartition(n, *task).sortWithinPartitions(*task, F.col("held").desc())
    return sorted_rows.mapInArrow(_compare(max_errors, masks), "a long, b long").distinct()
