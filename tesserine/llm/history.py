"""Problem 3: new batches against everything accepted before.

A body is cut into passages at content-defined units; each passage has a
64-bit bit-difference fingerprint, and a sample of them is kept in two rotated
block tables. Edits in every passage hide a body from those, so a min-wise
sample of its runs of a few units is looked up too. The whole body has a wide
fingerprint of bit differences, its sketch. Equal block entries are candidates;
they are verified by the Hamming distance of the sketches and then by the text,
which must keep four fifths of the longer body in order.

The fingerprints are a stored table (append, stored): a new batch is looked up
in it and then appended. Of the history the lookup scans the fingerprints, and
reads as text the few bodies that hit.

Equal bodies (case, spacing, signs and Unicode form aside) form one class and
are looked up once. Members of a block meet its smallest one first; then all
pairs of the block are looked at in which an earlier match than the one at hand
may be, large blocks in bands of length and in shares.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.llm.arrow import map_columns, map_rows
from tesserine.llm.fingerprints import Texts, Units, grouped, hamming, shingles, wide_simhash, wide_simhashes, windows
from tesserine.runtime import exists, materialise

#: Mean units of a passage: words, or characters of scripts without spaces.
WORDS, CHARACTERS = 14, 36
#: Kinds of script: words, ideographs and kana, and Thai letters, of which a phrase takes twice as many.
SPACED, IDEOGRAPHS, LETTERS = 0, 1, 2
#: By script: units of a run, the runs kept of a body (those with the smallest hashes, so that similar bodies keep the same
#: ones), and the least and most units of the bodies that have such runs; ranges overlap by a fifth.
RUNS = (
    ((2, 24, 0, 6), (3, 24, 5, 60), (8, 24, 48, 1 << 40)),
    ((2, 24, 0, 6), (5, 56, 5, 72), (9, 48, 58, 300), (14, 56, 240, 1 << 40)),
    ((2, 24, 0, 6), (5, 56, 5, 72), (12, 56, 58, 300), (20, 56, 240, 1 << 40)),
)
#: Units of a body from which it is fingerprinted together with others; more than any run has.
LEAST = 32
#: Passages kept of a body, those with the smallest mixed fingerprints.
PASSAGES = 8
#: 64-bit words of a sketch; by script, the units of its features (different runs of so many), and the most bits by which
#: sketches of similar bodies differ. With every fifth word changed some 76 +- 7 of 256 bits do, with every fifth ideograph
#: 94 +- 8, with every tenth Thai letter 92 +- 8.
SKETCH, GRAM, BITS = 4, (2, 4, 8), (92, 98, 98)
#: Part of the longer body that must be kept in order.
KEPT = 0.8
#: Units of a body between two looks at whether enough can still be kept.
STEP = 32
#: Classes in a block up to which it is joined whole; larger ones are joined by bands of length and in shares of SHARE classes.
SMALL, SHARE = 24, 1_000
#: Bodies a task of the verification keeps at hand, with some 40 KB each.
STREAMS = 5_000
#: Least rows and columns of the grid of the verification, and the most tasks it is spread over.
GRID, TASKS = 5, 20_000
_MIX = 0x9E3779B97F4A7C15


def kept_in_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    at: dict = {}
    for i, u in enumerate(a):
        at[u] = at.get(u, 0) | 1 << i
    full = (1 << n) - 1
    v = full
    for u in b:
        m = at.get(u)
        if m is not None:
            x = v & m
            v = (v + x | v - x) & full
    return n - v.bit_count()


def similar(a: list, b: list, kept: float = KEPT) -> bool:
    """Whether at least `kept` of the longer stream of units is in the other, in order."""
    longest = max(len(a), len(b))
    return longest > 0 and min(len(a), len(b)) >= kept * longest and keeps(a, b, math.ceil(kept * longest))


def keeps(a: list, b: list, least: int) -> bool:
    """Whether kept_in_order(a, b) >= least.

    Then at most len(a) - least units of a stand unmatched before a match, so the
    first units of b meet only so many more of a; it ends where the rest of b is
    too short.
    """
    m, n = len(a), len(b)
    at: dict = {}
    v, known = 0, 0
    for i in range(0, n, STEP):
        end = min(m, i + STEP + m - least)
        for j in range(known, end):
            at[a[j]] = at.get(a[j], 0) | 1 << j
        if end > known:
            v |= (1 << end) - (1 << known)
            known = end
        full = (1 << known) - 1
        for u in b[i : i + STEP]:
            x = at.get(u)
            if x is not None:
                x &= v
                v = (v + x | v - x) & full
        if known - v.bit_count() + n - min(n, i + STEP) < least:
            return False
    return known - v.bit_count() >= least


class Stream:
    """The hashed units of a body, with counts of units and of pairs of units in buckets."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.singles = self._counts(hashes >> np.uint64(52))

    @cached_property
    def pairs(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self._counts((self.hashes[:-1] * np.uint64(_MIX) + self.hashes[1:]) >> np.uint64(52))

    @staticmethod
    def _counts(buckets: np.ndarray) -> np.ndarray:
        return np.bincount(buckets.astype(np.int64), minlength=4096).astype(np.int32)


def may_be_similar(x: Stream, y: Stream) -> bool:
    """False only for bodies that aren't similar().

    If `least` units are kept, each of the others parts at most one pair of
    neighbours among them, so the bodies share that many pairs less.
    """
    m, n = len(x.hashes), len(y.hashes)
    least = math.ceil(KEPT * max(m, n))
    return min(m, n) >= least and int(np.minimum(x.singles, y.singles).sum()) >= least and int(np.minimum(x.pairs, y.pairs).sum()) >= 3 * least - m - n - 1


def passages(hashes: np.ndarray, mean: int) -> list[int]:
    """Where the content-defined pieces of a stream of hashed units begin; they have about `mean` units."""
    return _pieces((np.flatnonzero(hashes % np.uint64(mean) == 0) + 1).tolist(), len(hashes), mean)


def _pieces(cuts: list[int], n: int, mean: int) -> list[int]:
    starts, start = [0], 0
    half = mean // 2
    for cut in cuts:
        while cut - start > 4 * mean:
            start += 2 * mean
            starts.append(start)
        if cut - start >= half and n - cut >= half:
            starts.append(cut)
            start = cut
    while n - start > 4 * mean:
        start += 2 * mean
        starts.append(start)
    return starts


def marks_of(hashes: np.ndarray, mean: int) -> np.ndarray:
    """Signed 64-bit fingerprints of all passages: for each bit the majority over their units and pairs of units."""
    return _marks(hashes, np.array(passages(hashes, mean)))


def _marks(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.append(starts[1:], len(hashes))
    pairs = hashes.copy()  # the last unit of a passage stands alone
    with np.errstate(over="ignore"):
        inner = np.ones(len(hashes), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        pairs[at] = (hashes[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    both = np.stack([hashes, pairs], axis=1)
    sums = np.add.reduceat(np.unpackbits(both.view(np.uint8), axis=1).view(np.uint64), starts, axis=0).view(np.uint8)  # bytes do: a passage has at most 4 x mean units
    sums = sums[:, :64].astype(np.uint16) + sums[:, 64:]
    return np.packbits(sums > (ends - starts)[:, None], axis=1).view(np.int64).ravel()


def runs_of(hashes: np.ndarray, script: int = SPACED) -> set[int]:
    """Signed hashes of the sampled runs of a stream of hashed units."""
    kept = set()
    for width, sample, least, most in RUNS[script]:
        if least <= len(hashes) <= most:
            kept.update(smallest(shingles(hashes, width), sample).view(np.int64).tolist())
    return kept


def smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The n smallest different values in order."""
    if len(values) > 8 * n:
        low = np.unique(np.partition(values, 2 * n)[: 2 * n])  # holds all copies but of its largest
        if len(low) >= n:
            return low[:n]
    return np.unique(values)[:n]


def script_of(words: Units) -> int:
    """Kind of script of most units."""
    single = words.first[(words.lengths() == 1) & (words.first > 127)]
    if len(single) * 2 <= len(words.hashes):
        return SPACED
    return LETTERS if 2 * int(((single >= 0x0E00) & (single <= 0x0E7F)).sum()) > len(single) else IDEOGRAPHS


def keys_of(hashes: np.ndarray, script: int) -> list[int]:
    """Entries of a stream of hashed units in the block tables: the two halves of sampled passage fingerprints, and sampled runs."""
    marks = np.unique(marks_of(hashes, WORDS if script == SPACED else CHARACTERS)).view(np.uint64)
    with np.errstate(over="ignore"):
        marks = marks[np.argsort(marks * np.uint64(_MIX))[:PASSAGES]]
    low, high = marks & np.uint64(0xFFFFFFFF), (marks >> np.uint64(32)) | np.uint64(1 << 32)
    return sorted({*low.view(np.int64).tolist(), *high.view(np.int64).tolist(), *runs_of(hashes, script)})


class _Lists:
    """Lists of numbers, one after the other: values and offsets."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.values, self.offsets = values, offsets

    def only(self, wanted: np.ndarray) -> _Lists:
        """The lists that are wanted (a mask)."""
        if wanted.all():
            return self
        sizes = np.diff(self.offsets)
        return _Lists(self.values.compress(np.repeat(wanted, sizes)), _offsets(sizes[wanted]))

    def different(self, most: int | None = None) -> _Lists:
        """The different values of each list in order, at most so many of the smallest. The values are sorted in place."""
        at = self.offsets.tolist()
        for a, b in zip(at, at[1:]):
            self.values[a:b].sort()
        new = np.ones(len(self.values), bool)
        np.not_equal(self.values[1:], self.values[:-1], out=new[1:])
        new[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(new)])
        sizes = np.diff(upto[self.offsets])
        values = self.values.compress(new)
        if most is None:
            return _Lists(values, _offsets(sizes))
        rank = np.arange(len(values)) - np.repeat(_offsets(sizes)[:-1], sizes)
        return _Lists(values.compress(rank < most), _offsets(np.minimum(sizes, most)))

    def smallest(self, n: int) -> _Lists:
        """smallest() of each list."""
        sizes = np.diff(self.offsets)
        likely = np.minimum(1.0, (2 * n + 24) / np.maximum(sizes, 1))  # of evenly spread hashes
        bound = np.where(likely < 1, (likely * float(1 << 62)).astype(np.uint64) << np.uint64(2), np.uint64((1 << 64) - 1))
        low = self.values <= np.repeat(bound, sizes)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(low)])
        found = _Lists(self.values.compress(low), upto[self.offsets]).different(n)
        short = (np.diff(found.offsets) < n) & (likely < 1)
        if not short.any():
            return found
        parts = [smallest(self.values[self.offsets[k] : self.offsets[k + 1]], n) if short[k] else found.values[found.offsets[k] : found.offsets[k + 1]] for k in range(len(sizes))]
        return _Lists(np.concatenate(parts), _offsets(np.array([len(p) for p in parts])))


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def sketches_and_keys(streams: _Lists, script: int) -> tuple[np.ndarray, _Lists]:
    """Sketches and keys_of() of streams of hashed units of one script, each of LEAST units or more."""
    hashes, offsets = streams.values, streams.offsets
    sizes = np.diff(offsets)
    grams = _Lists(*windows(hashes, offsets, GRAM[script])).different()
    sketch = wide_simhashes(grams.values, grams.offsets, SKETCH)
    mean = WORDS if script == SPACED else CHARACTERS
    cuts = np.flatnonzero(hashes % np.uint64(mean) == 0)
    at = np.searchsorted(cuts, offsets).tolist()
    cuts = (cuts + 1).tolist()
    starts, counts = [], []
    for a, b, lo, hi in zip(at, at[1:], offsets.tolist(), offsets[1:].tolist()):
        pieces = _pieces([c - lo for c in cuts[a:b]], hi - lo, mean)
        counts.append(len(pieces))
        starts += [lo + p for p in pieces]
    marks = _Lists(_marks(hashes, np.array(starts)).view(np.uint64) * np.uint64(_MIX), _offsets(np.array(counts))).different(PASSAGES)
    values = marks.values * np.uint64(pow(_MIX, -1, 1 << 64))
    owners = np.repeat(np.arange(len(sizes)), np.diff(marks.offsets))
    found = [(values & np.uint64(0xFFFFFFFF), owners), ((values >> np.uint64(32)) | np.uint64(1 << 32), owners)]
    for width, sample, least, most in RUNS[script]:
        wanted = (sizes >= least) & (sizes <= most)
        if wanted.any():
            some = streams.only(wanted)
            runs = _Lists(*windows(some.values, some.offsets, width)).smallest(sample)
            found.append((runs.values, np.repeat(np.flatnonzero(wanted), np.diff(runs.offsets))))
    owners = np.concatenate([o for _, o in found])
    keys = np.concatenate([v for v, _ in found])[np.argsort(owners, kind="stable")].view(np.int64)
    return sketch, _Lists(keys, _offsets(np.bincount(owners, minlength=len(sizes)))).different()


def prints_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Numbers of the texts that have units, and of these exact, size, script, sketch, keys and where the keys of each begin and end."""
    words = Texts(texts)
    sizes = np.diff(words.offsets)
    rows = np.flatnonzero(sizes)
    letters = words.letters()
    exact = np.array([xxhash.xxh3_64_intdigest(letters[k]) - (1 << 63) for k in rows.tolist()], np.int64)
    streams = _Lists(words.hashes, words.offsets).only(sizes > 0)
    sizes = sizes[rows]
    single = (words.lengths() == 1) & (words.first > 127)
    thai = single & (words.first >= 0x0E00) & (words.first <= 0x0E7F)
    single, thai = (np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])[streams.offsets]) for x in (single, thai))
    script = np.where(single * 2 <= sizes, SPACED, np.where(2 * thai > single, LETTERS, IDEOGRAPHS))
    sketch = np.zeros((len(rows), SKETCH), np.int64)
    keys: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
    for kind in np.unique(script).tolist():
        wanted = (script == kind) & (sizes >= LEAST)
        if wanted.any():
            sketch[wanted], found = sketches_and_keys(streams.only(wanted), kind)
            for k, a, b in zip(np.flatnonzero(wanted).tolist(), found.offsets.tolist(), found.offsets[1:].tolist()):
                keys[k] = found.values[a:b]
    for k in np.flatnonzero(sizes < LEAST).tolist():
        hashes = streams.values[streams.offsets[k] : streams.offsets[k + 1]]
        sketch[k] = wide_simhash(np.unique(shingles(hashes, GRAM[script[k]])), SKETCH)
        keys[k] = np.array(keys_of(hashes, script[k]), np.int64)
    return rows, exact, sizes, script, sketch, np.concatenate(keys) if keys else np.zeros(0, np.int64), _offsets(np.array([len(k) for k in keys], np.int64))


def fingerprint(bodies: DataFrame) -> DataFrame:
    """Fingerprints of bodies (rec_id, batch_no, body): rec_id, batch_no, exact (hash of the normal body), size (units),
    script (of most of them), sketch (SKETCH longs), keys (entries of the block tables).
    Bodies without letters or digits have none. Bodies of unlike script are never compared."""

    def make():
        def step(columns):
            recs, batches, texts = columns
            texts = [t or "" for t in texts.to_pylist()]
            for lo, hi in grouped(texts):
                rows, exact, sizes, script, sketch, keys, ends = prints_of(texts[lo:hi])
                if len(rows):
                    at = pa.array(lo + rows)
                    lists = (pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in ((np.arange(0, SKETCH * len(rows) + 1, SKETCH), sketch.ravel()), (ends, keys)))
                    yield [recs.take(at), batches.take(at), pa.array(exact), pa.array(sizes), pa.array(script), *lists]

        return step

    kinds = dict(bodies.dtypes)
    return map_columns(bodies.select("rec_id", "batch_no", "body"), f"rec_id {kinds['rec_id']}, batch_no {kinds['batch_no']}, exact long, size int, script int, sketch array<long>, keys array<long>", make)


def append(folder: str, prints: DataFrame) -> None:
    """Append fingerprints to the stored table in a folder all executors share."""
    prints.write.mode("append").option("compression", "zstd").parquet(folder)


def stored(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The stored fingerprints, with the columns of `like`; none if nothing was appended yet."""
    return spark.read.schema(like.schema).parquet(folder) if exists(spark, folder) else like.limit(0)


def accept(folder: str, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """Look a batch's fingerprints up in the stored table and append them; the repeats as a table."""
    known = stored(prints.sparkSession, folder, prints)
    found = materialise(lookup(prints, known, texts), "repeats")
    append(folder, prints.join(known.select("rec_id"), "rec_id", "left_anti"))
    return found


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bodies are similar. texts: rec_id, body; only those of the pairs are moved."""
    pairs = materialise(pairs, "pairs")
    hits = pairs.select(F.col("a").alias("rec_id")).unionAll(pairs.select(F.col("b").alias("rec_id"))).distinct()
    hit = materialise(texts.join(hits, "rec_id", "left_semi").dropDuplicates(["rec_id"]), "hits")
    # pairs are dealt to the squares of a grid by both bodies, in either order, so a body is moved once for each square of its row, not for each pair
    kind = dict(texts.dtypes)["rec_id"]
    grid = max(GRID, math.ceil(hit.count() / (STREAMS / 2)))
    x, y = (F.pmod(F.hash(c), F.lit(grid)) for c in ("a", "b"))
    square = F.least(x, y) * grid + F.greatest(x, y)
    pairs = pairs.select(square.alias("square"), "a", "b")
    needed = pairs.select("square", F.col("a").alias("rec_id")).unionAll(pairs.select("square", F.col("b").alias("rec_id"))).distinct()
    bodies = needed.join(hit, "rec_id").select("square", F.col("rec_id").alias("a"), F.lit(None).cast(kind).alias("b"), "body")
    rows = bodies.unionAll(pairs.select("square", "a", "b", F.lit(None).cast("string").alias("body")))
    rows = rows.repartition(min(grid * grid, TASKS), "square").sortWithinPartitions("square", F.col("b").isNotNull())

    def make():
        now, streams, bodies = None, {}, {}  # the bodies of a square come before its pairs

        def read():
            """Streams of the bodies met so far, of many at once."""
            for lo, hi in grouped(texts := list(bodies.values())):
                words = Texts(texts[lo:hi])
                at = words.offsets.tolist()
                streams.update((rec, Stream(words.hashes[a:b])) for rec, a, b in zip(list(bodies)[lo:hi], at, at[1:]))
            bodies.clear()

        def step(row):
            nonlocal now
            square, a, b, body = row
            if square != now:
                now = square
                streams.clear()
                bodies.clear()
            if b is None:
                bodies[a] = body or ""
                return
            if bodies:
                read()
            x, y = streams[a], streams[b]
            if may_be_similar(x, y) and similar(x.hashes.tolist(), y.hashes.tolist()):
                yield a, b

        return step

    return map_rows(rows, f"a {kind}, b {kind}", make)


def lookup(new: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """rec_id_first, rec_id_later: records of `new` that repeat an earlier one of `known` or `new`.

    new, known: fingerprint() rows; texts: rec_id and body of both, read for
    candidates only. rec_id_first is the smallest rec_id whose body is similar.
    Bodies without letters or digits repeat nothing; a rec_id given twice counts
    once.
    """
    columns = ["rec_id", "exact", "size", "script", "sketch", "keys"]
    index = known.select(*columns, F.lit(False).alias("new")).unionAll(new.select(*columns, F.lit(True).alias("new")))
    firsts = index.groupBy("exact").agg(F.min(F.struct("rec_id", "size", "script", "sketch", "keys")).alias("f"), F.max("new").alias("new"))
    classes = materialise(firsts.select("exact", "f.*", "new"), "classes")
    entries = classes.select("rec_id", F.explode("keys").alias("key"))
    asked = classes.filter("new").select(F.explode("keys").alias("key")).distinct()
    entries = entries.join(asked, "key", "left_semi").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / KEPT))).cast("int")
    rows = entries.join(classes.select("rec_id", "size", "script", "sketch", "new"), "rec_id")
    rows = materialise(rows.withColumn("band", F.when(F.col("n") > SMALL, band).otherwise(0)), "blocks")
    differ = sum((hamming(F.col("ka")[i], F.col("kb")[i]) for i in range(1, SKETCH)), hamming(F.col("ka")[0], F.col("kb")[0]))
    bound = F.element_at(F.array(*map(F.lit, BITS)), F.col("ta") + 1)
    alike = (F.col("a") < F.col("b")) & (F.col("ta") == F.col("tb")) & (F.least("sa", "sb") >= KEPT * F.greatest("sa", "sb")) & (differ <= bound)

    # The smallest member of a block (in large ones, of a band of length) is likely to be the match of most.
    asking = rows.filter("new").select("key", "band", "n", F.col("rec_id").alias("b"), F.col("size").alias("sb"), F.col("script").alias("tb"), F.col("sketch").alias("kb"))
    least = rows.groupBy("key", "band").agg(F.min(F.struct("rec_id", "size", "script", "sketch")).alias("m"))
    least = least.select("key", "band", F.col("m.rec_id").alias("a"), F.col("m.size").alias("sa"), F.col("m.script").alias("ta"), F.col("m.sketch").alias("ka"))
    tried = materialise(least.join(asking, ["key", "band"]).filter(alike).select("a", "b").distinct(), "tried")
    links = materialise(_verify(tried, texts), "links")

    # Then all pairs that may hold an earlier match: bands that touch, the asking side in shares.
    best = links.groupBy("b").agg(F.min("a").alias("best"))
    shares = F.ceil(F.col("n") / F.lit(SHARE)).cast("int")
    bands = F.when(F.col("n") > SMALL, F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(0)))
    left = rows.select("key", F.explode(bands).alias("band"), "n", F.col("rec_id").alias("a"), F.col("size").alias("sa"), F.col("script").alias("ta"), F.col("sketch").alias("ka"))
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("n")
    right = asking.join(best, "b", "left").withColumn("best", F.coalesce("best", "b")).withColumn("share", F.pmod(F.hash("b"), shares)).drop("n")
    pairs = left.join(right, ["key", "band", "share"]).filter(alike & (F.col("a") < F.col("best"))).select("a", "b").distinct()
    links = links.unionAll(_verify(pairs.join(tried, ["a", "b"], "left_anti"), texts))
    earlier = links.groupBy("b").agg(F.min("a").alias("earlier")).withColumnRenamed("b", "class_id")
    members = new.select("rec_id", "exact").dropDuplicates(["rec_id"]).join(classes.select("exact", F.col("rec_id").alias("class_id")), "exact").join(earlier, "class_id", "left")
    first = F.least(F.col("class_id"), F.coalesce("earlier", "class_id"))
    return members.select(first.alias("rec_id_first"), F.col("rec_id").alias("rec_id_later")).filter(F.col("rec_id_first") < F.col("rec_id_later"))


def repeats(prints: DataFrame, texts: DataFrame, first_new: int = 1) -> DataFrame:
    """lookup() of all records with batch_no >= first_new; rows with a null batch_no count as history."""
    is_new = F.coalesce("batch_no", F.lit(first_new - 1)) >= first_new
    return lookup(prints.filter(is_new), prints.filter(~is_new), texts)
