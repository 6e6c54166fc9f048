"""Operator 2: removal of repeated byte strings, by deep-shallow suffix sorting of candidates.

A byte goes if a string of ``LENGTH`` bytes over it starts earlier as well. Of
each such string the smallest hash among its shorter grams is its anchor; runs of
neighbouring strings with one anchor are a segment. Equal strings have equal
anchors, so a string can only repeat inside the segments of one anchor:

* segments that have equal hashes throughout are a class; inside a batch their bytes
  are compared, between batches digests of their bytes are, and the first stays;
* an anchor with several classes sends the first of each, with its text, to one
  sorter, which orders their suffixes (see ``suffix_sort``); of suffixes that agree
  over ``LENGTH`` bytes the earliest start stays. So does an anchor of which a class
  turns out to hold different bytes.

Anchors that a bounded sample of documents shows to be very common are dealt by
segment; their strings, and those of any anchor with more than ``MANY`` different
segments, are dealt by their own content after each task has kept only its first of
each, so that a common line or passage is spread over tasks. Tasks read segments in
order and hold a bounded number of them.

Order is by document id, then start; strings are judged on the input. Defined
results: a null text counts as empty; texts under LENGTH bytes stay whole; an
empty table gives an empty table; columns besides id and text are not read; a row
without an id stays whole; ids are taken to be unique: repeated rows of one id and
text are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm.common import hold, mix64, odd_powers, staged, table
from lithos.llm.minhash import BASE, BYTE_CODE, INVERSE
from lithos.llm.suffix_sort import equal_classes

LENGTH, GRAM = 100, 24
PIECE = 1 << 20
INDEX_BITS = np.uint64(24)
#: Bits of a segment's hash.
HASH_BITS = 64
#: Documents sampled for very common anchors; different segments there that make an anchor common.
SAMPLE_DOCS, COMMON = 4000, 24
#: Different segments of an anchor whose strings are dealt one by one; segments that a task holds.
MANY, HELD = 20_000, 1 << 18
SORT_BYTES = 4 << 20


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, have = v, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, cuts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, start in it, strings, anchor hash, segment hash) of texts laid end to end."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * odd_powers(n, BASE), out=sums[1:])
    inverse = odd_powers(n, INVERSE)
    h = mix64((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = (np.uint64(1) << INDEX_BITS) - np.uint64(1)
    best = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)  # one for each string start
    sizes = np.diff(cuts)
    live = np.zeros(n + 1, np.int32)
    has = sizes >= length
    np.add.at(live, cuts[:-1][has], 1)
    np.add.at(live, cuts[1:][has] - length + 1, -1)
    ok = np.cumsum(live[: len(best)]) > 0
    change = np.append(True, best[1:] != best[:-1])
    begin = cuts[:-1][has]
    change[begin] = True
    starts = np.flatnonzero(change & ok)
    doc = np.searchsorted(cuts, starts, "right") - 1
    stop = np.minimum(np.append(starts[1:], n), cuts[doc + 1] - length + 1)
    count = stop - starts
    anchor = h[(best[starts] & low).astype(np.int64)]
    whole = mix64((sums[stop + length - 1] - sums[starts]) * inverse[starts] + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return doc, starts - cuts[doc], count, anchor, whole


def texts_of(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, cuts) of a column, in pieces of whole texts."""
    col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        upto = min(n, max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1))
        yield at, upto - at, data[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at]
        at = upto


def long_segments(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``segments`` for a piece of any size: a longer one is a single text and is taken in overlapping parts."""
    most = 1 << int(INDEX_BITS)
    if len(data) < most:
        return segments(data, cuts)
    got, step = [], most // 2
    for a in range(0, len(data) - LENGTH + 1, step):
        part = data[a : a + step + LENGTH - 1]
        d, s, *rest = segments(part, np.array([0, len(part)]))
        got.append((d, s + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


ROW = "key long, common boolean, ha long, hs long, doc long, lo int, n int"


def confirmed(raw: bytes, pos: np.ndarray, n: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Of segments with the hash of the one before them in order, those that have the bytes of their class's first."""
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
    i = np.flatnonzero(again)
    i = i[np.argsort(pos[i], kind="stable")]
    back = pos[i] - pos[head[i]]
    new = np.append(True, (back[1:] != back[:-1]) | (pos[i][1:] != pos[i][:-1] + n[i][:-1]))  # neighbours that repeat neighbours go together
    first = np.flatnonzero(new) if len(i) else i
    out = again & (n == n[head])
    for a, e in zip(first.tolist(), [*first[1:].tolist(), len(i)]):
        lo, hi, d = int(pos[i[a]]), int(pos[i[e - 1]] + n[i[e - 1]]) + LENGTH - 1, int(back[a])
        if raw[lo:hi] != raw[lo - d : hi - d]:
            for k in i[a:e].tolist():
                lo, hi = int(pos[k]), int(pos[k] + n[k]) + LENGTH - 1
                out[k] &= raw[lo:hi] == raw[lo - d : hi - d]
    return out


def anchors(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """Segments of every text. Of equal ones in a batch the first has its key, the others none: they go."""
    unused = np.uint64(64 - HASH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("repeats")
        for b in batches:
            ids, parts = np.asarray(b.column(0), np.int64), []
            texts = b.column(1).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for first, _, data, cuts in texts_of(texts):
                doc, *rest = long_segments(data, cuts)
                parts.append((first + doc, *rest))
            if not parts:
                continue
            row, lo, n, ha, hs = (np.concatenate(x) for x in zip(*parts, strict=True))
            hs >>= unused
            order = np.lexsort((lo, ids[row], hs))
            row, lo, n, ha, hs = (x[order] for x in (row, lo, n, ha, hs))
            doc, again = ids[row], np.append(False, hs[1:] == hs[:-1]) if len(hs) else np.zeros(0, bool)
            if again.any():
                again = confirmed(np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]].tobytes(), ends[row] - ends[0] + lo, n, again)
            hot = np.isin(ha, common)
            key = np.where(hot, mix64(ha ^ hs), ha).view(np.int64)
            for a in range(0, len(doc), 1 << 18):
                s = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(key[s], mask=again[s]), pa.array(hot[s]), pa.array(ha[s].view(np.int64)), pa.array(hs[s].view(np.int64)), pa.array(doc[s]), pa.array(lo[s].astype(np.int32)), pa.array(n[s].astype(np.int32))], ["key", "common", "ha", "hs", "doc", "lo", "n"])

    return rows.mapInArrow(run, ROW)


#: What becomes of a segment: it repeats one of its batch; it has a class to be confirmed, and is not that one's
#: first; its strings are sorted against the anchor's other segments, or (very common anchors) dealt one by one.
GONE, AGAIN, LATER, SORT, EACH = 1, 2, 4, 8, 16
VERDICT = "what int, ha long, doc long, lo int, n int"


def judged(dealt: DataFrame) -> DataFrame:
    """Of segments dealt by key and in the order of (ha, hs, doc, lo): those that may repeat, and how that is decided."""
    too_many, at_once = MANY, HELD

    def settle(ha: np.ndarray, hs: np.ndarray, hot: np.ndarray, before: tuple | None, cut: bool) -> np.ndarray:
        """``before``: anchor and class at the end of rows already settled; ``cut``: the last anchor goes on."""
        later = np.append(before == (ha[0], hs[0]), (hs[1:] == hs[:-1]) & (ha[1:] == ha[:-1]))
        head = np.flatnonzero(np.append(True, ha[1:] != ha[:-1]))
        size = np.diff(np.append(head, len(ha)))
        different = np.add.reduceat(~later, head, dtype=np.int64)
        many = different > too_many
        many[0] |= before is not None and before[0] == ha[0]
        many[-1] |= cut
        each, several = np.repeat(many, size) | hot, np.repeat(different > 1, size)
        again = later | np.append(later[1:], cut)
        return AGAIN * again + LATER * later + (SORT + EACH * each) * ((several | each) & ~later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = [np.zeros(0, t) for t in (bool, np.int64, np.int64, np.int64, np.int32, np.int32)], None

        def out(upto: int, cut: bool) -> pa.RecordBatch:
            nonlocal held, before
            hot, ha, hs, doc, lo, n = (x[:upto] for x in held)
            held = [x[upto:] for x in held]
            what = settle(ha, hs, hot, before, cut)
            before = (ha[-1], hs[-1]) if cut else None
            keep = what > 0
            return pa.RecordBatch.from_arrays([pa.array(what[keep].astype(np.int32)), pa.array(ha[keep]), pa.array(doc[keep]), pa.array(lo[keep]), pa.array(n[keep])], ["what", "ha", "doc", "lo", "n"])

        for b in batches:
            cols = [np.asarray(b.column(k)) for k in range(1, 7)]
            if b.column(0).null_count:
                local = np.asarray(b.column(0).is_null())
                here = b.filter(pa.array(local))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(here.num_rows, GONE, np.int32)), *here.select(["ha", "doc", "lo", "n"]).columns], ["what", "ha", "doc", "lo", "n"])
                cols = [c[~local] for c in cols]
            held = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[1]) >= at_once:
                ends = np.flatnonzero(held[1][1:] != held[1][:-1])
                yield out(int(ends[-1]) + 1, False) if len(ends) else out(len(held[1]), True)
        if len(held[1]):
            yield out(len(held[1]), False)

    return dealt.mapInArrow(run, VERDICT)


#: Kinds of rows: a span that goes; a segment's digest (in key and other); text to be sorted; one string.
PART = "kind int, key long, other long, later boolean, doc long, lo int, n int, part binary"
CUT, CLASS, TEXT = 0, 1, 2


def cut_out(rows: DataFrame) -> DataFrame:
    """From (doc, text, segs): spans, digests, and text by anchor, or string by string where the anchor is common."""

    def made(kind: int, key: np.ndarray, other: np.ndarray, later: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, part: list | None) -> pa.RecordBatch:
        cols = [np.full(len(doc), kind, np.int32), key.astype(np.int64), other.astype(np.int64), later.astype(bool), doc.astype(np.int64), lo.astype(np.int32), n.astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(doc), pa.binary()) if part is None else pa.array(part, pa.binary())], ["kind", "key", "other", "later", "doc", "lo", "n", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hot: dict[bytes, tuple[int, int]] = {}
            text_of: tuple[list, ...] = ([], [], [], [], [])
            gone: tuple[list, ...] = ([], [], [])
            same: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            lists = b.column(2)
            flat = lists.flatten()
            off = (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
            what, ha, lo, n = (np.asarray(flat.field(k)) for k in range(4))
            none = np.zeros(0, np.int64)

            def texts_out(text_of: tuple[list, ...] = text_of) -> pa.RecordBatch:
                key, doc, at, count, part = text_of
                out = made(TEXT, np.array(key, np.int64), np.zeros(len(key)), np.zeros(len(key)), np.array(doc, np.int64), np.array(at, np.int32), np.array(count, np.int32), part)
                for x in text_of:
                    x.clear()
                return out

            for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True)):
                raw = text.as_buffer()
                view = memoryview(raw) if raw is not None else memoryview(b"")
                own = slice(off[k], off[k + 1])
                w, p, c, h = what[own], lo[own], n[own], ha[own]
                if (g := (w & GONE) > 0).any():
                    cut = merged_spans(p[g].astype(np.int64), p[g] + c[g].astype(np.int64) + LENGTH - 1)
                    for x, v in zip(gone, (np.full(len(cut), doc), cut[:, 0], cut[:, 1] - cut[:, 0] - LENGTH + 1), strict=True):
                        x.append(v)
                if (g := (w & AGAIN) > 0).any():
                    d = [hashlib.blake2b(view[x : x + y + LENGTH - 1], digest_size=16).digest() for x, y in zip(p[g].tolist(), c[g].tolist())]
                    for x, v in zip(same, (np.frombuffer(b"".join(d), "<i8").reshape(-1, 2), (w[g] & LATER) > 0, np.full(len(d), doc), p[g], c[g]), strict=True):
                        x.append(v)
                for s in np.flatnonzero(w & SORT).tolist():
                    x, y = int(p[s]), int(c[s])
                    if not w[s] & EACH:
                        for z, v in zip(text_of, (h[s], doc, x, y, bytes(view[x : x + y + LENGTH - 1])), strict=True):
                            z.append(v)
                        size += y + LENGTH
                        continue
                    for q in range(x, x + y):
                        g, here = bytes(view[q : q + LENGTH]), (doc, q)
                        if (had := hot.get(g)) is None:
                            hot[g] = here
                        else:
                            hot[g] = min(had, here)
                            for z, v in zip(gone, max(had, here), strict=False):
                                z.append(np.array([v]))
                            gone[2].append(np.ones(1, np.int64))
                if size > 8 << 20:
                    yield texts_out()
                    size = 0
            for g, (doc, q) in hot.items():
                key = int.from_bytes(hashlib.blake2b(g, digest_size=8).digest(), "little", signed=True)
                for x, v in zip(text_of, (key, doc, q, 1, g), strict=True):
                    x.append(v)
            yield texts_out()
            if gone[0]:
                doc, p, c = map(np.concatenate, gone)
                yield made(CUT, np.zeros(len(doc)), np.zeros(len(doc)), np.zeros(len(doc)), doc, p, c, None)
            if same[0]:
                d, later, doc, p, c = map(np.concatenate, same)
                yield made(CLASS, d[:, 0], d[:, 1], later, doc, p, c, None)

    return rows.mapInArrow(run, PART)


SPAN = "doc long, a int, b int"


def repeated(parts: DataFrame) -> DataFrame:
    """Byte spans of strings that start earlier elsewhere, from segments dealt and sorted by key."""

    def settle(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"".join([r[4] for r in rows]), np.uint8)
        n = np.array([r[3] for r in rows])
        base = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(base, n) + inner
        doc = np.repeat(np.array([r[1] for r in rows]), n)
        pos = np.repeat(np.array([r[2] for r in rows]), n) + inner
        cls = equal_classes(data, starts, LENGTH)
        order = np.lexsort((pos, doc, cls))
        c, d, p = cls[order], doc[order], pos[order]
        gone = np.append(False, c[1:] == c[:-1])
        d, p = d[gone], p[gone]
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        if len(d):
            new = np.append(True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(d)) - 1
            yield d[first], p[first], p[last] + LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for d, a, b in settle(rows):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc", "a", "b"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > SORT_BYTES and row[0] != rows[-1][0]:
                    yield from out(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield from out(rows)

    return parts.mapInArrow(run, SPAN)


def common_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors that have many different segments in a bounded sample of documents."""
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("doc"), F.lit(max(1, n // SAMPLE_DOCS))) == 0)
    found = anchors(drawn, np.zeros(0, np.uint64)).where("key is not null").groupBy("ha").agg(F.count_distinct("hs").alias("c")).where(F.col("c") >= COMMON).select("ha").collect()
    return np.array([r[0] for r in found], np.int64).view(np.uint64)


def repeat_spans(df: DataFrame) -> DataFrame:
    """(doc, a, b): spans of bytes of (doc_id, text) that repeat earlier ones; they may overlap."""
    rows = df.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = anchors(rows, common_anchors(rows)).repartition(F.coalesce("key", F.xxhash64("doc"))).sortWithinPartitions("ha", "hs", "doc", "lo")
    verdicts = staged(judged(dealt), "verdicts")

    def cut(some: DataFrame) -> DataFrame:
        asked = some.groupBy("doc").agg(F.collect_list(F.struct("what", "ha", "lo", "n")).alias("segs"))
        return cut_out(rows.join(asked, "doc").select("doc", "text", "segs"))

    def span(some: DataFrame) -> DataFrame:
        return some.select("doc", F.col("lo").alias("a"), (F.col("lo") + F.col("n") + LENGTH - 1).alias("b"))

    def sorted_spans(some: DataFrame) -> DataFrame:
        return repeated(some.where(F.col("kind") == TEXT).select("key", "doc", "lo", "n", "part").repartition("key").sortWithinPartitions("key"))

    parts = staged(cut(verdicts), "parts")
    first = F.row_number().over(Window.partitionBy("key", "other").orderBy("doc", "lo")) == 1
    classes = staged(parts.where(F.col("kind") == CLASS).select("doc", "lo", "n", "later", first.alias("first")).where("later OR NOT first"), "classes")
    out = span(parts.where(F.col("kind") == CUT)).unionByName(span(classes.where("NOT first"))).unionByName(sorted_spans(parts))
    # a class whose hash stands for different bytes: all segments of its anchor are sorted
    clash = classes.where("later AND first")
    if not clash.isEmpty():
        which = verdicts.join(clash.select("doc", "lo"), ["doc", "lo"], "left_semi").select("ha").distinct()
        out = out.unionByName(sorted_spans(cut(verdicts.join(which, "ha", "left_semi").where(F.col("what") != GONE).withColumn("what", F.lit(SORT)))))
    return out


def merged_spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted spans without overlap or touch, of (a, b)."""
    order = np.argsort(a, kind="stable")
    a, top = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.append(True, a[1:] > top[:-1]))
    return np.stack([a[first], top[np.append(first[1:], len(a)) - 1]], 1)


def merged(spans: list[dict] | None, size: int) -> np.ndarray:
    """Sorted spans without overlap or touch, inside the text."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    x = np.array([(s["a"], min(s["b"], size)) for s in spans], np.int64)
    x = x[x[:, 0] < x[:, 1]]
    if not len(x):
        return x.reshape(0, 2)
    return merged_spans(x[:, 0], x[:, 1])


def kept_bytes(raw: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def with_spans(df: DataFrame) -> DataFrame:
    """(doc_id, text, spans): every row with its list of repeated spans, or null."""
    spans = repeat_spans(df).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(spans.withColumnRenamed("doc", "doc_id"), "doc_id", "left")


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).cast(pa.large_binary()), b.column(2).to_pylist(), strict=True):
                raw = text.as_py() or b""
                s = merged(spans, len(raw))
                out.append((len(raw), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(kept_bytes(raw, s)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(df).mapInArrow(run, DIGEST)


def without_repeats(df: DataFrame) -> DataFrame:
    """``df`` with repeated spans cut out of its texts; bytes of characters cut in two go as well."""
    spans = repeat_spans(df).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("_spans")).withColumnRenamed("doc", "_doc")

    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            if s is None or t is None:
                out.append(t)
            else:
                raw = t.encode()
                out.append(kept_bytes(raw, merged([{"a": x["a"], "b": x["b"]} for x in s], len(raw))).decode("utf-8", "ignore"))
        return pd.Series(out)

    joined = df.join(spans, F.col("doc_id").cast("long") == F.col("_doc"), "left")
    # a filter on the new text stays above it: pushed below, it would cut every text a second time, in a worker of its own
    left = F.pandas_udf(cut, "string").asNondeterministic()("text", "_spans")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(left)).select(*df.columns)


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that also start earlier."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
