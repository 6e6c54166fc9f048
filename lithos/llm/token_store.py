"""Operator 10: token ids in a content-addressed store.

``write_store`` encodes each whole text, cuts its id stream where a rolling hash
of the last ids says so, and writes three Parquet tables into one folder:

* ``chunks``: each different chunk once, under the digest of its bytes;
* ``recipes``: per document, in ascending order over shards, the digests of its
  chunks, their Merkle root and the count of ids;
* ``manifest``: per shard of recipes, counts and the Merkle root over documents.

Ids are little-endian unsigned integers of 16 bits where the vocabulary fits,
else of 32. ``read_documents`` rebuilds id lists; ``read_digests`` reads every
chunk once, checks it against its address and joins the chunks' checksums into
each document's, so no payload is moved twice. Both fail on a missing chunk, a
chunk that does not match its address or a root that does not match.

Defined results: a null or empty text has the end id only. Repeated rows give
repeated recipes and share their chunks; an empty table gives an empty store;
columns besides id and text are not read. A chunk that a third of all documents
share is stored by the first batch that meets it: batches and partitions drop
repeats before the shuffle, and checksums, not payloads, are joined back.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm.common import hold, mix64, shared_dir, table

KEEP_WORDS = 1_200_000
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 19
LONGEST_KEPT = 48
#: Chunks and documents of a partition, about; addresses of chunks met before that a task remembers.
PART_CHUNKS, PART_DOCS, KEEP_ADDRESSES = 200_000, 100_000, 1_000_000
#: Chunk lengths in ids: shortest, usual (a power of two), longest.
SHORTEST, USUAL, LONGEST = 64, 256, 2048
#: Ids that one rolling hash spans.
SPAN = 16
DIGEST_BYTES = 16
#: Texts of these Latin-1 characters alone need no normal form, and are cut as the tokenizer's own pattern cuts them.
PLAIN = bytes([*range(9, 14), *range(32, 127), *range(160, 256)])
LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
DIGITS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
WORDS = re.compile(rb"[" + LETTERS + rb"]+|'(?:s|t|re|ve|m|ll|d)|[" + DIGITS + rb"]|[^\t-\r \xa0" + LETTERS + DIGITS + rb"]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 or 192 <= b <= 222 and b != 215 else b for b in range(256))


def plain(text: str) -> bytes | None:
    """The text lower-cased in Latin-1, if it is plain and free of special tokens' marks."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, PLAIN) or b"<|" in raw else raw.translate(LOWER)


def cut_words(path: str):
    """The tokenizer's model alone, for words in normal form parted by spaces; none is met twice, so nothing is cached."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    tok = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": cut}}))
    tok.model._resize_cache(0)
    return tok


class WordIds:
    """Ids of whole texts; those of the tokenizer's words are remembered.

    The tokenizer lower-cases, drops white space and encodes each word of its
    pattern by itself, closing it with a token of the word-end kind. New words of
    a text are encoded together and parted at these tokens. A text that holds
    other characters than the plain ones, or the marks of special tokens, is
    encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.bare = cut_words(path)
        vocab = self.tok.get_vocab()
        self.wide = max(vocab.values()) >= 65536
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.end = np.array([end_id], self.kind).tobytes()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        ids = np.array(self.bare.encode_batch_fast([b" ".join(words).decode("latin-1")], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(self.closes[ids]) + 1
        if len(cuts) != len(words):  # a word that spells out the mark of word ends
            return {w: np.array(self.tok.encode(w.decode("latin-1"), add_special_tokens=False).ids, self.kind).tobytes() for w in words}
        raw, unit = ids.tobytes(), self.kind.itemsize
        return {w: raw[a * unit : b * unit] for w, a, b in zip(words, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)}

    def text(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if plain(text) is None:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + self.end
        return self.texts([text])[0]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of several texts with the end id each; their new words are encoded in one go."""
        kept, out, open_, new = self.kept, [b""] * len(texts), [], {}
        for k, text in enumerate(texts):
            if not text or (raw := plain(text)) is None:
                out[k] = self.text(text)
                continue
            words = WORDS.findall(raw)
            found = list(map(kept.get, words))
            if None in found:
                at = list(compress(range(len(found)), map(not_, found)))
                lacking = list(map(words.__getitem__, at))
                new.update(dict.fromkeys(lacking))
                open_.append((k, found, at, lacking))
            else:
                out[k] = b"".join(found) + self.end
        own = self.learn(list(new)) if new else {}
        for k, found, at, lacking in open_:
            for i, w in zip(at, lacking):
                found[i] = own[w]
            out[k] = b"".join(found) + self.end
        if len(kept) + len(own) > KEEP_WORDS:
            kept.clear()
        kept.update((w, b) for w, b in own.items() if len(w) <= LONGEST_KEPT)
        return out


@lru_cache(maxsize=1)
def _word_ids(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def word_ids(path: str, end_id: int) -> WordIds:
    hold("words", _word_ids.cache_clear)
    return _word_ids(path, end_id)


def in_groups(texts: pa.Array, words: WordIds) -> Iterator[bytes]:
    held, size = [], 0
    for x in texts:
        held.append(t := x.as_py())
        size += len(t or "")
        if size > TOGETHER:
            yield from words.texts(held)
            held, size = [], 0
    yield from words.texts(held)


def rolled(ids: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last SPAN ids asks for a cut."""
    if len(ids) < SPAN:
        return np.zeros(0, np.int64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    h = x
    have = 1
    while have < SPAN:  # of twice as many ids each time
        h = h[have:] + h[:-have] * np.uint64(pow(0x9E3779B97F4A7C15, have, 1 << 64))
        have *= 2
    return np.flatnonzero((h >> np.uint64(40)) % np.uint64(USUAL) == 0) + SPAN


def cut_points(n: int, asked: list[int]) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids, of the cuts its content asks for."""
    out, at = [], 0
    for e in (*asked, n):
        while e - at > LONGEST:
            at += LONGEST
            out.append(at)
        if e - at >= SHORTEST or e == n and e > at:
            out.append(e)
            at = e
    return out


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; an odd one is carried up."""
    if not leaves:
        return address(b"")
    while len(leaves) > 1:
        up = [address(b"\x01" + leaves[k] + leaves[k + 1]) for k in range(0, len(leaves) - 1, 2)]
        leaves = up + leaves[len(leaves) & ~1 :]
    return leaves[0]


class Tree:
    """The same root as ``merkle``, of leaves that come one by one; only the roots of whole subtrees are held."""

    def __init__(self):
        self.roots: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.roots and self.roots[-1][0] == level:
            level, leaf = level + 1, address(b"\x01" + self.roots.pop()[1] + leaf)
        self.roots.append((level, leaf))

    def root(self) -> bytes:
        if not self.roots:
            return merkle([])
        *left, (_, root) = self.roots
        for _, r in reversed(left):
            root = address(b"\x01" + r + root)
        return root


CHUNKS = "h binary, n int, payload binary"
MANIFEST = "shard int, documents long, ids long, root binary"
RECIPES = "doc_id long, n_tokens long, hashes binary, root binary"
#: ``spread`` tells repeated rows apart, so that they can be dealt to several partitions.
BOTH = f"{RECIPES}, {CHUNKS}, spread long"


def encoded(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Recipe rows and, for chunks a task meets first, chunk rows (the other columns null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, rows = word_ids(tokenizer_path, end_id), set(), 0
        unit = words.kind.itemsize
        for b in batches:
            if len(seen) > KEEP_ADDRESSES:
                seen.clear()
            docs: tuple[list, ...] = ([], [], [], [])
            chunks: tuple[list, ...] = ([], [], [])
            size = 0

            def flush(docs=docs, chunks=chunks) -> pa.RecordBatch:
                nonlocal rows
                d, c = len(docs[0]), len(chunks[0])
                rows += d
                spread = pa.array(mix64(np.arange(rows - d, rows + c, dtype=np.uint64)).view(np.int64))
                cols = [pa.array(x + [None] * c, t) for x, t in zip(docs, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                cols += [pa.array([None] * d + x, t) for x, t in zip(chunks, (pa.binary(), pa.int32(), pa.binary()), strict=True)]
                for x in (*docs, *chunks):
                    x.clear()
                return pa.RecordBatch.from_arrays([*cols, spread], ["doc_id", "n_tokens", "hashes", "root", "h", "n", "payload", "spread"])

            for doc, raw in zip(b.column(0), in_groups(b.column(1), words), strict=True):
                ids = np.frombuffer(raw, words.kind)
                at, own = 0, []
                for end in cut_points(len(ids), rolled(ids).tolist()):
                    chunk = raw[at * unit : end * unit]
                    h = address(chunk)
                    own.append(h)
                    if h not in seen:
                        seen.add(h)
                        for x, v in zip(chunks, (h, end - at, chunk), strict=True):
                            x.append(v)
                        size += len(chunk)
                    at = end
                for x, v in zip(docs, (doc.as_py(), len(ids), b"".join(own), merkle(own)), strict=True):
                    x.append(v)
                if size > 8 << 20:
                    yield flush()
                    size = 0
            yield flush()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BOTH)


def once(chunks: DataFrame) -> DataFrame:
    """One row per address; rows must already be dealt by address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for h in b.column(0).to_pylist():
                keep.append(h not in seen)
                seen.add(h)
            yield b.filter(pa.array(keep, pa.bool_()))

    return chunks.mapInArrow(run, CHUNKS)


def write_store(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode (doc_id, text) and write the store's three tables under ``path``."""
    spark = df.sparkSession
    both = f"{path}/_encoded"
    encoded(df, tokenizer_path, end_id).write.option("compression", "zstd").parquet(both)
    rows = spark.read.schema(BOTH).parquet(both)
    documents, pieces = rows.agg(F.count_if(F.col("h").isNull()), F.count("h")).first()
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.where("h is not null").select("h", "n", "payload").repartition(max(wide, -(-pieces // PART_CHUNKS)), "h")
    once(chunks).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = rows.where("h is null").select("doc_id", "n_tokens", "hashes", "root", "spread")
    dealt = recipes.repartitionByRange(max(wide, -(-documents // PART_DOCS)), "doc_id", F.xxhash64("root"), "spread")
    dealt.sortWithinPartitions("doc_id", F.xxhash64("root"), "root").select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "hashes", "root").write.parquet(f"{path}/recipes")

    manifest_of(read_recipes(spark, path)).write.parquet(f"{path}/manifest")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(both)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def manifest_of(recipes: DataFrame) -> DataFrame:
    """Per shard the counts of documents and ids and the Merkle root over its documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}
        for b in batches:
            for shard, doc, n, root in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                s = state.setdefault(shard, [0, 0, Tree()])
                s[0] += 1
                s[1] += n
                s[2].add(address(f"{doc} {n} ".encode() + root))
        yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array([s[0] for s in state.values()], pa.int64()), pa.array([s[1] for s in state.values()], pa.int64()), pa.array([s[2].root() for s in state.values()], pa.binary())], ["shard", "documents", "ids", "root"])

    ordered = recipes.repartition("shard").sortWithinPartitions("shard", "doc_id", "root").select("shard", "doc_id", "n_tokens", "root")
    return ordered.mapInArrow(run, MANIFEST)


def checked_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, after its counts and roots are compared with those of the recipes."""
    kept = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    sides = manifest_of(read_recipes(spark, path)).withColumn("side", F.lit(1)).unionByName(kept.withColumn("side", F.lit(-1)))
    wrong = sides.groupBy("shard", "documents", "ids", "root").agg(F.sum("side").alias("side")).where("side <> 0").select("shard").distinct().limit(5).collect()
    if wrong:
        raise ValueError(f"recipes and manifest differ in shards {sorted(r.shard for r in wrong)}: documents, ids or the Merkle root")
    return kept


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"shard int, {RECIPES}").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks")


def starts(recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recipes with the count of ids of all documents before each one.

    The manifest has one row per shard, so the running total over shards is over
    a bounded table; within a shard the rows are summed in order.
    """
    before = manifest.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("_before"))
    w = Window.partitionBy("shard").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    return recipes.join(before, "shard").withColumn("start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).drop("_before")


def pieces_of(recipes: DataFrame) -> DataFrame:
    """One row per document and chunk: its row's key, the chunk's place and address."""
    at = F.sequence(F.lit(0), (F.octet_length("hashes") / DIGEST_BYTES).cast("int") - 1)
    return recipes.select("*", F.posexplode(F.transform(at, lambda k: F.substring("hashes", (k * DIGEST_BYTES + 1).cast("int"), F.lit(DIGEST_BYTES)))).alias("at", "h"))



def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 registers carried over ``n_bytes`` zero bytes, by squared operators over GF(2)."""
    op = np.zeros(32, np.uint64)  # one zero bit
    op[0], op[1:] = 0xEDB88320, np.uint64(1) << np.arange(31, dtype=np.uint64)
    times = lambda m, v: np.bitwise_xor.reduce(np.where((v[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1), m[None, :], np.uint64(0)), axis=1)
    for _ in range(3):
        op = times(op, op)
    crc, left = crc.astype(np.uint64), n_bytes.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            crc[odd] = times(op, crc[odd])
        op, left = times(op, op), left >> 1
    return crc


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each run of pieces put together; runs start at ``first``, none is empty."""
    total = np.cumsum(sizes)
    ends = np.append(first[1:], len(sizes))
    after = np.repeat(total[ends - 1], ends - first) - total
    return np.bitwise_xor.reduceat(crc_shift(crcs, after), first).astype(np.int64)


def chunk_sums(chunks: DataFrame, wide: bool) -> DataFrame:
    """Per chunk read and checked against its address: crc32 and size of its ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u4" if wide else "<u2"
        for b in batches:
            crc, size = [], []
            for h, n, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(payload, kind)
                if address(payload) != h or len(ids) != n:
                    raise ValueError(f"chunk {h.hex()} does not match its address")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                size.append(4 * n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(size, pa.int64())], ["h", "crc", "size"])

    return chunks.mapInArrow(run, "h binary, crc long, size long")


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(spark: SparkSession, path: str, wide: bool) -> DataFrame:
    """Per document, from the files: start, count and crc32 of all its ids."""
    recipes = starts(read_recipes(spark, path), checked_manifest(spark, path))
    sums = chunk_sums(read_chunks(spark, path), wide)
    found = pieces_of(recipes).join(sums, "h", "left")
    rows = found.groupBy("doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("at", "h", "crc", "size"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            flat = lists.flatten()
            size, crc = flat.field("size"), flat.field("crc")
            first = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            ends = np.append(first[1:], len(flat))
            h = flat.field("h").to_pylist()
            whole = not crc.null_count and (np.add.reduceat(np.asarray(size), first) == 4 * np.asarray(b.column(2))).all() if len(first) else True
            if not whole or any(merkle(h[x:y]) != root for x, y, root in zip(first.tolist(), ends.tolist(), b.column(3).to_pylist(), strict=True)):
                raise ValueError("a document can't be rebuilt: a chunk is missing or its Merkle root differs")
            out = joined_crcs(np.asarray(crc).astype(np.uint64), np.asarray(size), first.astype(np.int64)) if len(first) else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, DIGESTS)


def read_documents(spark: SparkSession, path: str, wide: bool) -> DataFrame:
    """Per document, from the files and checked: doc_id, start and its ids in order."""
    recipes = starts(read_recipes(spark, path), checked_manifest(spark, path))
    rows = pieces_of(recipes).join(read_chunks(spark, path), "h", "left").groupBy("doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("at", "h", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for root, parts in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if any(p["payload"] is None or address(p["payload"]) != p["h"] for p in parts) or merkle([p["h"] for p in parts]) != root:
                    raise ValueError("a document can't be rebuilt: a chunk is missing or differs")
                out.append(np.frombuffer(b"".join(p["payload"] for p in parts), "<u4" if wide else "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids array<int>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a store in the shared folder and read back from it."""
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    tok = default_tokenizer()
    write_store(table(spark, sf_dir, "documents"), path, tok)
    return read_digests(spark, path, word_ids(tok, 1).wide)
