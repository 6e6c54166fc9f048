"""Operator 3: SentencePiece BPE encoding and decoding by a merge-type prefix table.

The classic encoder keeps a queue of merges. Here the pieces of a word are found
left to right: an Aho-Corasick automaton lists the pieces that end at each
position, and of these the table stores the one whose left neighbour (the last
piece stored for the prefix before it) is compatible with it. Two pieces are
compatible when merging their joined text by score gives just these two again.
Every prefix has one such last piece, so the ids are read backwards from the end
in linear time. Compatible pairs are remembered per worker.

No piece holds a space mark after another character and characters outside the
vocabulary never merge, so a text is cut at both; ids of short parts are kept
per worker in a table of bounded size.

Defined results: a null or empty text has the end id only and decodes to "".
Extra columns pass through ``encode`` and ``decode`` untouched, but for one that has
the name of the column asked for: it is replaced. Repeated rows give equal rows;
an empty table gives an empty table; a part of any length is handled in time
linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import hold, slices, table

SPACE = "▁"
#: Parts kept in each of two generations, and pairs: a worker's tables stay under some 120 MB.
KEEP_PARTS = 240_000
KEEP_PAIRS = 300_000
LONGEST_KEPT = 48
#: Bytes of texts whose ids are held at once.
TOGETHER = 1 << 18


class PrefixTable:
    """Encoder and decoder for one BPE model file with byte fallback."""

    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        self.end_id = sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown_id = sp.unk_id()
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in self.byte_of}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of) or any("\n" in p for p in self.id_of):
            raise ValueError("the model has pieces that cross a space mark or a line end")
        order = sorted(self.id_of.values(), key=lambda i: -sp.get_score(i))
        self.rank, at = [0] * n, -1
        for k, i in enumerate(order):  # equal scores share a rank
            at = k if k == 0 or sp.get_score(i) != sp.get_score(order[k - 1]) else at
            self.rank[i] = at
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self.merged(p, self.halves) == [i]:  # a piece that merging never reaches is no token
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def merged(self, text: str, halves: dict | None = None) -> list[int]:
        """Ids by the definition: the best-scored pair first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            if halves is not None and len(parts) == 2:
                halves[self.id_of[text]] = (self.id_of[parts[0]], self.id_of[parts[1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of.get(p, -1) for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a | b apart: undo their merges, latest first, and
        look for a pair across the border that would have been merged before."""
        got = self.pairs.get(key := a << 24 | b)
        if got is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.stay_apart(a, b)
        return got

    def stay_apart(self, a: int, b: int) -> bool:
        pieces, rank, halves, id_of = self.pieces, self.rank, self.halves, self.id_of
        limit = len(pieces) + 1
        while True:
            across = id_of.get(pieces[a] + pieces[b])
            if across is not None and rank[across] < limit:
                return False
            ra, rb = (rank[a] if a in halves else -1), (rank[b] if b in halves else -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:  # of equals the left one is merged first, also across the border
                limit, b = rb + 1, halves[b][0]

    def part_ids(self, part: str) -> list[int]:
        """Ids of a part without inner cuts, from the prefix table."""
        n = len(part)
        last: list[tuple[int, int] | None] = [None] * (n + 1)  # (length, id) of the last piece of each prefix
        compatible = self.compatible
        at = 0

        def unknown(upto: int) -> None:
            nonlocal at
            for j in range(at, upto):
                if last[j + 1] is None and part[j] not in self.id_of:
                    last[j + 1] = (1, -1 - ord(part[j]))
            at = upto

        for end, (size, piece) in self.automaton.iter(part):
            if end > at:
                unknown(end)
            start = end + 1 - size
            if last[end + 1] is not None:
                continue
            if start == 0:
                last[end + 1] = (size, piece)
            elif (before := last[start]) is not None and (before[1] < 0 or compatible(before[1], piece)):
                last[end + 1] = (size, piece)
        unknown(n)
        out: list[int] = []
        j = n
        while j:
            if (step := last[j]) is None:  # no chain of pieces: merge by the definition
                return self.spelled([i if i >= 0 else -1 - ord(c) for i, c in self.by_definition(part)])
            out.append(step[1])
            j -= step[0]
        return self.spelled(out[::-1])

    def by_definition(self, part: str) -> list[tuple[int, str]]:
        return [(i, self.pieces[i] if i >= 0 else c) for i, c in zip(self.merged(part), self.merged_text(part), strict=True)]

    def merged_text(self, part: str) -> list[str]:
        ids, out, at = self.merged(part), [], 0
        for i in ids:
            size = len(self.pieces[i]) if i >= 0 else 1
            out.append(part[at : at + size])
            at += size
        return out

    def spelled(self, ids: list[int]) -> list[int]:
        """Characters outside the vocabulary as byte ids, or as the unknown id."""
        if min(ids, default=0) >= 0:
            return ids
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in chr(-1 - i).encode()]
            else:
                out.append(self.unknown_id)
        return out

    def part(self, part: str) -> str:
        """The part's ids as decimal text; ``odd`` gets its decoded text where that differs from it."""
        got = self.older.get(part)
        if got is None:
            ids = self.part_ids(part)
            got = " ".join(map(str, ids))
            if (raw := self.raw_text(ids)) != part:
                self.odd[part] = raw
        if len(part) <= LONGEST_KEPT:
            if len(self.kept) >= KEEP_PARTS:  # what was not asked for since the last turn goes
                self.older, self.kept = self.kept, {}
                self.odd = {k: v for k, v in self.odd.items() if k in self.older}
            self.kept[part] = got
        return got

    def raw_text(self, ids: list[int]) -> str:
        """Text of ids, space marks kept."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.shown(self.raw_text(ids))

    def shown(self, raw: str) -> str:
        return raw.removeprefix(SPACE).replace(SPACE, " ")

    def encode_text(self, text: str | None) -> tuple[str, str]:
        """Ids (with the end id) as decimal text, and the decoded text."""
        if not text:
            return str(self.end_id), ""
        all_parts, found = [], []
        new_line = self.part("\n")
        for k, line in enumerate((SPACE + text.replace(" ", SPACE)).split("\n")):
            if k:
                found.append(new_line)
                all_parts.append("\n")
            if SPACE + SPACE in line or line.endswith(SPACE):
                parts = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)
            else:
                first, *rest = line.split(SPACE)
                parts = [SPACE + w for w in rest]
                if first:
                    parts.insert(0, first)
            kept = self.kept
            got = list(map(kept.get, parts))
            if not all(got):
                for i in list(compress(range(len(got)), map(not_, got))):
                    got[i] = self.part(parts[i])
            found += got
            all_parts += parts
        if self.odd:
            all_parts = [self.odd.get(p, p) for p in all_parts]
        return " ".join(found) + f" {self.end_id}", self.shown("".join(all_parts))


@lru_cache(maxsize=1)
def _prefix_table(model_path: str) -> PrefixTable:
    return PrefixTable(model_path)


def prefix_table(model_path: str) -> PrefixTable:
    hold("pieces", _prefix_table.cache_clear)
    return _prefix_table(model_path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with an array of ids for each row's whole text, the end id last.

    The text is sent to Python and the ids come back as a column; every other
    column stays where it is. Null and empty texts have the end id only.
    """

    ids = F.pandas_udf(_ids_of(model_path), T.ArrayType(T.IntegerType()))
    return df.withColumn(ids_col, ids(F.col(text_col)))


def _ids_of(model_path: str):
    def ids(texts: pd.Series) -> pd.Series:
        t = prefix_table(model_path)
        return pd.Series([np.array(t.encode_text(s)[0].split(" "), np.int32) for s in texts])

    return ids


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids; a null id list gives "" ."""
    def texts(lists: pd.Series) -> pd.Series:
        t = prefix_table(model_path)
        return pd.Series([t.decode([int(i) for i in x]) if x is not None else "" for x in lists])

    return df.withColumn(text_col, F.pandas_udf(texts, T.StringType())(F.col(ids_col)))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """Per row of (doc_id, text): count and digest of its ids, digest of its decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_table(model_path)
        for b in batches:
            rows = [(ids.count(" ") + 1, _sha(ids), _sha(back)) for ids, back in (t.encode_text(x.as_py()) for x in b.column(1))]
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)


def encoded(df: DataFrame, model_path: str) -> DataFrame:
    """Per row of (doc_id, source, text): its ids, their count, and the digests of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_table(model_path)
        for whole in batches:
            for at, n in slices(whole.column(2), TOGETHER):
                b = whole.slice(at, n)
                flat, sizes, of_ids, of_text = [], [0], [], []
                for x in b.column(2):
                    ids, back = t.encode_text(x.as_py())
                    flat.append(np.array(ids.split(" "), np.int32))
                    sizes.append(len(flat[-1]))
                    of_ids.append(_sha(ids))
                    of_text.append(_sha(back))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(flat)))
                cols = [lists, pa.array(sizes[1:], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again; digests of both."""
    return digests(table(spark, sf_dir, "documents"), default_model())
