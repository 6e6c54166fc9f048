"""Operator 1: near-duplicates by HyperMinHash banding, confirmed on whole sets.

Each text becomes the set of its word shingles. A set's hashes are dealt to
registers by their first bits; a register stores the leading-zero count and some
mantissa bits of its smallest hash, and an empty register borrows from others in
an order that is the same for all sets. Bands of compressed registers are the
candidates' keys. A candidate pair whose collision-corrected Jaccard estimate is
far below the threshold is dropped; the rest is confirmed on the full sets.

Equal sets are one class, and only classes are compared. In every band key the
smallest class is tested against the others (a star). Linked classes are joined
into components; a key that still holds several components is cut into blocks of
bounded size, and its documents are compared across components block by block, a
pair at the first band it shares: first by registers alone, then on the full sets
of those documents whose estimates leave a link possible. So the links that matter
are all tested while a group of copies never becomes all its pairs.

Defined results: null texts and texts without words have the empty set and link
with nothing; a text of fewer words than a shingle has its whole sequence as one
shingle; rows with one id are one document; a row without an id links with nothing
and is kept, its component null; repeated rows stay; an empty table gives an empty
table; columns besides id and text are not read; texts of any length are cut into
words piece by piece and never shortened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.common import drop_staged, hold, mix64, odd_powers, staged, table, whole_groups
from lithos.llm.components import components

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random number for each byte, so that word hashes have no structure of the bytes'.
BYTE_CODE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
PIECE = 1 << 20


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and how many words lie before each cut."""
    n = len(data)
    sep = SEPARATOR[data]
    start = ~sep
    start[1:] &= sep[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    start[inner] = ~sep[inner]
    first = np.flatnonzero(start)
    stop = np.append(sep, True)
    stop[inner] = True
    ends = np.flatnonzero(stop)
    last = ends[np.searchsorted(ends, first, "right")]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[LOWER[data]] * odd_powers(n, BASE), out=sums[1:])
    return mix64((sums[last] - sums[first]) * odd_powers(n, INVERSE)[first]), np.searchsorted(first, cuts)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes.

    Words are runs of other bytes than blanks and line marks, A-Z lower-cased. A
    text of fewer words has its whole sequence as one shingle; none without words.
    """
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    null = np.asarray(texts.is_null())
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        upto = min(upto, n)
        cuts = ends[at : upto + 1] - ends[at]
        w, before = word_hashes(every[ends[at] : ends[upto]], cuts) if ends[upto] > ends[at] else (np.zeros(0, np.uint64), np.zeros(upto - at + 1, np.int64))
        total = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            total += w[k : len(w) - words + 1 + k] * STEP[k]
        total = mix64(total)
        for k in range(upto - at):
            a, b = int(before[k]), int(before[k + 1])
            if null[at + k] or a == b:
                yield np.zeros(0, np.uint64)
            elif b - a < words:
                yield mix64(np.array([int((w[a:b] * STEP[: b - a]).sum()) + (b - a)], np.uint64) * np.uint64(BASE))
            else:
                s = np.sort(total[a : b - words + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
        at = upto


#: Registers, registers a band, mantissa bits.
REGISTERS, IN_BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // IN_BAND
#: Register bits of a hash.
ROUTE = REGISTERS.bit_length() - 1
PROBES = np.stack([np.random.default_rng(k + 1).permutation(REGISTERS) for k in range(REGISTERS)])
#: Expected share of chance matches of two registers, times 2**MANTISSA, for sets of equal size.
COLLISION = 0.169919487159739
#: Standard deviations an estimate may lie below the threshold before a pair is dropped.
SIGMAS = 5.0
BLOCK = 512


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers (uint16) of sorted hash sets; of an empty set all zero."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if n and size.sum() else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(size)])
    low = np.zeros((n, REGISTERS), np.uint64)
    full = np.zeros((n, REGISTERS), bool)
    if len(every):
        owner = np.repeat(np.arange(n), size)
        slot = owner * REGISTERS + (every >> np.uint64(64 - ROUTE)).astype(np.int64)
        head = np.append(True, slot[1:] != slot[:-1])  # sorted, so the first of a register is its smallest
        low.ravel()[slot[head]] = every[head] << np.uint64(ROUTE)
        full.ravel()[slot[head]] = True
    value = low >> np.uint64(11)
    _, exponent = np.frexp(value.astype(np.float64))
    zeros = np.minimum(53 - exponent, 63)
    shifted = low << np.minimum(zeros + 1, 63).astype(np.uint64)
    reg = ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA))).astype(np.uint16)
    todo = np.flatnonzero((size > 0) & ~full.all(1))
    done = full.copy()
    for t in range(REGISTERS):
        if not len(todo):
            break
        rows = np.ix_(todo, np.arange(REGISTERS))
        at = PROBES[:, t]
        take = ~done[rows] & full[todo][:, at]
        got = reg[todo][:, at]
        part = reg[rows]
        part[take] = got[take]
        reg[rows] = part
        done[rows] |= take
        todo = todo[~done[todo].all(1)]
    reg[size == 0] = 0
    return reg


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows: matches less the matches expected by chance."""
    ratio = na / nb
    chance = COLLISION / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    match = (a == b).mean(-1)
    return np.clip((match - chance) / (1 - chance), 0, 1)


def least_estimate(threshold: float, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    own = np.minimum(REGISTERS, np.minimum(na, nb)) * 0.6  # registers that are not borrowed, at least about so many
    return threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / own)


SKETCH = "doc_id long, n long, s1 long, s2 long, regs binary"


def sketches(df: DataFrame, words: int) -> DataFrame:
    """Per document: set size, two sums that name the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sets")
        for b in batches:
            kept: list[np.ndarray] = []
            at = held = 0

            def flush(b=b) -> pa.RecordBatch:
                nonlocal at, held, kept
                reg = registers(kept)
                first = np.concatenate([[0], np.cumsum([len(s) for s in kept])])
                sums = []
                every = np.concatenate(kept)
                for salt in (0x1234567, 0x89ABCDE):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(every + np.uint64(salt)))])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                ids = b.column(0).slice(at, len(kept))
                at, held = at + len(kept), 0
                out = pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in reg], pa.binary())], ["doc_id", "n", "s1", "s2", "regs"])
                kept = []
                return out

            for s in shingle_sets(b.column(1), words):
                kept.append(s)
                held += len(s)
                if held > 500_000:
                    yield flush()
            if kept:
                yield flush()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def whole_sets(df: DataFrame, words: int) -> DataFrame:
    """(doc, s): each document's full set as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: list[bytes] = []
            at = held = 0
            for s in shingle_sets(b.column(1), words):
                kept.append(s.tobytes())
                held += len(kept[-1])
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(kept)), pa.array(kept, pa.binary())], ["doc", "s"])
                    at, held, kept = at + len(kept), 0, []
            if kept:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(kept)), pa.array(kept, pa.binary())], ["doc", "s"])

    return df.mapInArrow(run, "doc long, s binary")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            last, other = None, None
            for x, y in zip(b.column(2), b.column(3), strict=True):
                xs = np.frombuffer(x.as_buffer(), np.uint64)
                ys = np.frombuffer(y.as_buffer(), np.uint64)
                both = shared(xs, ys)
                keep.append(100 * both >= percent * (len(xs) + len(ys) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
    return with_b.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


MEMBER = "k long, i int, j int, block int, band int, doc long, label long, n long, regs binary"


def possible(rows: dict[str, np.ndarray], packed: np.ndarray, reg: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(x, others) of a block: across labels, pairs whose first shared band is the key's and whose estimate is high enough."""
    i, j, band = rows["i"][0], rows["j"][0], rows["band"][0]
    doc, label, n, block = rows["doc"], rows["label"], rows["n"], rows["block"]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left:
        ys = right[(label[right] != label[x]) & ((i != j) | (doc[right] > doc[x]))]
        if len(ys):
            same = packed[ys] == packed[x]
            ys = ys[same[:, band] & (same.argmax(1) == band)]
        if len(ys):
            ys = ys[estimate(reg[x][None], reg[ys], n[x], n[ys]) >= least_estimate(threshold, n[x], n[ys])]
        if len(ys):
            yield x, ys


def members_of(t: pa.RecordBatch, first: np.ndarray) -> Iterator[tuple[int, int, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(begin, end, columns, registers packed by band, registers) of every block of two rows or more."""
    cols = {c: np.asarray(t.column(c)) for c in ("i", "j", "block", "band", "doc", "label", "n")}
    every = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    for a, e in zip(first.tolist(), [*first[1:].tolist(), t.num_rows]):
        if e - a > 1:
            yield a, e, {c: v[a:e] for c, v in cols.items()}, every[a:e].view(np.uint64), every[a:e]


def links_across(open_keys: DataFrame, sketch_of: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Confirmed links that join different labels, from open keys (k, band, doc, label).

    Registers go to every pair of blocks of a key, sets only to those blocks
    where a pair is possible. A pair is confirmed unless links found in its block
    already join its labels, so a block gives fewer links than it has members.
    """

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_groups(batches, 3):
            keep = np.zeros(t.num_rows, bool)
            for a, _, rows, packed, reg in members_of(t, first):
                for x, ys in possible(rows, packed, reg, threshold):
                    keep[a + x] = True
                    keep[a + ys] = True
            yield t.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_groups(batches, 3):
            out_a, out_b = [], []
            for a, e, rows, packed, reg in members_of(t, first):
                doc, label = rows["doc"], rows["label"]
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s").slice(a, e - a)]
                root = {k: k for k in label.tolist()}

                def find(k: int, root=root) -> int:
                    while root[k] != k:
                        root[k] = k = root[root[k]]
                    return k

                for x, ys in possible(rows, packed, reg, threshold):
                    for y in ys.tolist():
                        if (fx := find(int(label[x]))) == (fy := find(int(label[y]))):
                            continue
                        both = shared(sets[x], sets[y])
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            root[max(fx, fy)] = min(fx, fy)
                            out_a.append(doc[x])
                            out_b.append(doc[y])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    large = open_keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("k", F.ceil(F.col("c") / BLOCK).cast("int").alias("of"))
    own = open_keys.join(large, "k", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("of")).cast("int")).join(sketch_of, "doc")
    spread = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    dealt = lambda d: d.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "doc")
    asked = dealt(spread.select("k", "i", "j", "block", F.col("band").cast("int").alias("band"), "doc", "label", "n", "regs")).mapInArrow(needed, MEMBER)
    return dealt(asked.join(sets, "doc").select("k", "i", "j", "block", "band", "doc", "label", "n", "regs", "s")).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * shared >= percent * union of their shingle
    sets; component_id is the smallest id reachable over links.
    """
    threshold = percent / 100
    sketch = staged(sketches(df, words), "sketches")
    classes = staged(sketch.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2", "regs").agg(F.min("doc_id").alias("rep")), "classes")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("regs", (k * (2 * IN_BAND) + 1).cast("int"), F.lit(2 * IN_BAND)))).alias("band", "v")
    keyed = classes.select(F.col("rep").alias("doc"), "n", at).select("doc", "n", "band", F.xxhash64("band", "v").alias("k"))
    heads = keyed.groupBy("k").agg(F.min("doc").alias("head"), F.max("doc").alias("tail")).where("head < tail").select("k", "head")
    shared_keys = staged(keyed.join(heads, "k").select("k", "band", "doc", "n", "head"), "keys")
    members = shared_keys.select("doc").distinct()
    rows = df.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(members, "doc", "left_semi")
    sets = staged(whole_sets(rows, words), "sets")
    sketch_of = classes.select(F.col("rep").alias("doc"), "n", "regs")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate leaves the threshold possible."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
                na, nb = (np.asarray(b.column(c)) for c in (4, 5))
                yield b.select([0, 1]).filter(pa.array(estimate(ra, rb, na, nb) >= least_estimate(threshold, na, nb)))

        s = sketch_of
        full = pairs.join(s.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b").join(s.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
        return full.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")

    star = staged(likely(shared_keys.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()), "star")
    links = staged(confirmed(star, sets, percent), "links")
    roots = components(links)
    labelled = shared_keys.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("label", F.coalesce("root", "doc"))
    mixed = labelled.groupBy("k").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("k")
    open_keys = staged(labelled.join(mixed, "k", "left_semi").select("k", "band", "doc", "label"), "open")
    more = staged(links_across(open_keys, sketch_of, sets, threshold, percent), "links")
    roots = components(links.unionByName(more))
    drop_staged(shared_keys, sets, star, links, open_keys, more)
    named = sketch.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
