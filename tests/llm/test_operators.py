"""Training-data operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.llm import components, exact_topk, language_id, minhash, mixing, nn_descent, quality, repeats, sharding, sp_bpe, suffix_sort, token_store

R = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Iota", "kappa", "ñandú", "été", "größe"]
LONG = " ".join(R.choice(WORDS) + str(R.randrange(50)) for _ in range(9000))
BASE = [" ".join(R.choice(WORDS) + str(R.randrange(40)) for _ in range(R.randrange(20, 90))) for _ in range(25)]


def near(text):
    w = text.split()
    w[R.randrange(len(w))] = "changed"
    return " ".join(w)


TEXTS = [None, "", "   ", "x", "one two", LONG, LONG, *BASE, *BASE[:6], *(near(t) for t in BASE[:12]), *(near(near(t)) for t in BASE[:12]), BASE[0] + "\n" + BASE[1], "\n".join(["same line of text that is rather long, over and over again, to the very end of it all, yes"] * 6), "ab" * 400, "漢字 emoji 😀 <|endoftext|> ▁ tab\t"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, R.choice(["s0", "s0", "s0", "s1", None]), "extra") for k, t in enumerate(TEXTS)]
    R.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, source string, hs string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ")
    w = [x for x in w if x]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, words, percent):
    s = [shingles(t, words) for t in TEXTS]
    root = list(range(len(s)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words, percent).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(s[k]), find(k), find(k) == k) for k in range(len(s))}
    assert minhash.near_duplicates(none, words, percent).count() == 0


def test_near_duplicates_of_rows_without_an_id_and_repeated_rows(spark):
    rows = [(1, BASE[0], 1), (None, BASE[0], 2), (2, BASE[0], 3), (2, BASE[0], 3), (None, None, 4), (3, near(BASE[1]), 5)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int"), 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large group whose documents are below the threshold from its first one: blocks find every link between them."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(40):  # a chain: neighbours are near, distant ones are not
        base[k * 4 : k * 4 + 3] = [f"c{k}a", f"c{k}b", f"c{k}c"]
        texts.append(" ".join(base))
    texts += [" ".join(f"z{j}" if r.random() < 0.05 else w for j, w in enumerate(base)) for _ in range(40)]
    s = [shingles(t, 3) for t in texts]
    root = list(range(len(s)))
    find = lambda k: k if root[k] == k else find(root[k])
    for a in range(len(s)):
        for b in range(a):
            if 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    assert got == {k: find(k) for k in range(len(s))} and 1 < len(set(got.values())) < len(s)


def test_components(spark):
    e = [(k, k + 1) for k in range(0, 40)] + [(100, 60), (60, 80)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 60, 60: 60, 80: 60}


def test_estimate_is_near_truth():
    r = np.random.default_rng(1)
    both = r.integers(0, 1 << 63, 1600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sets = [np.sort(both[:1300]), np.sort(both[300:])]
    reg = minhash.registers(sets)
    assert abs(minhash.estimate(reg[0], reg[1], 1300, 1300) - 1000 / 1600) < 0.15


def test_suffix_sort():
    for seed in range(6):
        r = np.random.default_rng(seed)
        data = r.integers(97, 99 if seed % 2 else 101, 9000, dtype=np.uint8)
        data[4000:4300] = data[1000:1300]
        starts = np.arange(len(data) - 100)
        got = suffix_sort.equal_classes(data, starts, 100)
        raw = data.tobytes()
        texts = [raw[s : s + 100] for s in starts]
        rank = {t: k for k, t in enumerate(sorted(set(texts)))}
        assert [rank[t] for t in texts] == got.tolist()


def brute_repeats():
    seen, out = set(), []
    for t in TEXTS:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            g = raw[p : p + 100]
            if g in seen:
                gone[p : p + 100] = True
            seen.add(g)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("common,many,held,bits", [(24, 20_000, 1 << 18, 64), (1, 20_000, 1 << 18, 64), (24, 1, 1 << 18, 64), (24, 20_000, 2, 64), (24, 20_000, 1 << 18, 1), (1, 20_000, 1 << 18, 1)])
def test_repeated_strings(docs, none, monkeypatch, common, many, held, bits):
    monkeypatch.setattr(repeats, "COMMON", common)  # 1: every anchor is dealt as a very common one
    monkeypatch.setattr(repeats, "MANY", many)  # 1: so are those with several segments, after they were dealt
    monkeypatch.setattr(repeats, "HELD", held)  # 2: tasks settle few segments at a time
    monkeypatch.setattr(repeats, "HASH_BITS", bits)  # 1: hashes stand for different bytes
    got = {r[0]: tuple(r[1:]) for r in repeats.digests(docs).collect()}
    assert got == dict(enumerate(brute_repeats()))
    assert repeats.digests(none).count() == 0
    cut = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert cut[0].text is None and cut[6].text == "" and cut[5].text == LONG and cut[5].hs == "extra"


def test_segments_are_confirmed_by_bytes():
    again = np.array([False, True, True])
    assert repeats.confirmed(b"ab" * 200, np.array([0, 2, 1]), np.array([3, 3, 3]), again).tolist() == [False, True, False]
    assert repeats.confirmed(b"ab" * 200, np.array([0, 2, 4]), np.array([3, 2, 3]), again).tolist() == [False, False, True]


def test_sentencepiece_round_trip(docs, none):
    import sentencepiece

    path = sp_bpe.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r[0]: tuple(r[1:]) for r in sp_bpe.digests(docs, path).collect()}
    for k, t in enumerate(TEXTS):
        ids = [*sp.encode(t or ""), sp.eos_id()]
        assert got[k] == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    both = {r.doc_id: r for r in sp_bpe.decode(sp_bpe.encode(docs, path), path).collect()}
    assert all(both[k].ids == [*sp.encode(t or ""), sp.eos_id()] and both[k].hs == "extra" for k, t in enumerate(TEXTS))
    assert sp_bpe.digests(none, path).count() == 0


def test_prefix_table_equals_library():
    import sentencepiece

    path = sp_bpe.default_model()
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), sp_bpe.prefix_table(path)
    for k in range(3000):
        s = "".join(R.choice("ab▁ thein \n\tÉé漢😀.,-1<s>") for _ in range(R.randrange(30))) if k % 2 else "".join(R.choice(t.pieces[259:]) for _ in range(R.randrange(1, 6)))
        ids = [*sp.encode(s), sp.eos_id()]
        assert t.encode_text(s) == (" ".join(map(str, ids)), sp.decode(ids))


def test_token_store(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = token_store.default_tokenizer()
    tok = Tokenizer.from_file(path)
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS]
    token_store.write_store(docs, f"{tmp_path}/s", path)
    start = np.concatenate([[0], np.cumsum([len(i) for i in ids])[:-1]])
    got = {r[0]: tuple(r[1:]) for r in token_store.read_digests(spark, f"{tmp_path}/s", False).collect()}
    assert got == {k: (int(start[k]), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in enumerate(ids)}
    assert {r.doc_id: r.ids for r in token_store.read_documents(spark, f"{tmp_path}/s", False).collect()} == dict(enumerate(ids))
    chunks = token_store.read_chunks(spark, f"{tmp_path}/s")
    assert chunks.count() == chunks.select("h").distinct().count()
    token_store.write_store(none, f"{tmp_path}/e", path)
    assert token_store.read_digests(spark, f"{tmp_path}/e", False).count() == 0


def test_missing_chunk_is_noticed(spark, docs, tmp_path):
    token_store.write_store(docs, f"{tmp_path}/s", token_store.default_tokenizer())
    few = token_store.read_chunks(spark, f"{tmp_path}/s").orderBy("h").limit(3).collect()
    spark.createDataFrame(few, token_store.CHUNKS).write.mode("overwrite").parquet(f"{tmp_path}/s/chunks2")
    import shutil

    shutil.rmtree(tmp_path / "s/chunks")
    shutil.move(tmp_path / "s/chunks2", tmp_path / "s/chunks")
    with pytest.raises(Exception, match="can't be rebuilt"):
        token_store.read_digests(spark, f"{tmp_path}/s", False).collect()


def test_manifest_tree_and_lost_recipe(spark, docs, tmp_path):
    for n in range(20):
        leaves, tree = [token_store.address(bytes([k])) for k in range(n)], token_store.Tree()
        for x in leaves:
            tree.add(x)
        assert tree.root() == token_store.merkle(leaves)
    path = f"{tmp_path}/s"
    token_store.write_store(docs, path, token_store.default_tokenizer())
    rows = token_store.read_recipes(spark, path).orderBy("doc_id").collect()
    shard = rows[0].shard
    own = sorted((r for r in rows if r.shard == shard), key=lambda r: (r.doc_id, r.root))
    kept = {r.shard: r for r in spark.read.parquet(f"{path}/manifest").collect()}[shard]
    assert kept.root == token_store.merkle([token_store.address(f"{r.doc_id} {r.n_tokens} ".encode() + r.root) for r in own])
    whole = spark.createDataFrame(rows, f"shard int, {token_store.RECIPES}")
    for lost in ("doc_id <> 0", "false"):
        whole.where(lost).write.mode("overwrite").parquet(f"{path}/recipes")
        for read in (token_store.read_digests, token_store.read_documents):
            with pytest.raises(ValueError, match="manifest"):
                read(spark, path, False).collect()



@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding(docs, none, shards):
    rows = sorted((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in enumerate(TEXTS))
    total, at, want, slots = sum(r[1] for r in rows), 0, {}, {}
    for k, size, crc in rows:
        s = min(shards - 1, at * shards // total)
        slots[s] = slots.get(s, -1) + 1
        want[k] = (size, crc, "bytes", s, slots[s], None)
        at += size
    assert {r[0]: tuple(r[1:]) for r in sharding.shard(docs, shards).collect()} == want
    assert sharding.shard(none, shards).count() == 0


@pytest.mark.parametrize("parts", [None, 5, 60])
def test_sharding_with_one_heavy_key(spark, parts):
    """One key, and one record repeated, hold a third of all rows each; shards are near equal and slots without gaps."""
    rows = [(5, f"text {k} " * (k % 9)) for k in range(200)] + [(7, "the same text")] * 200 + [(k, f"text {k} " * (k % 9)) for k in range(100, 300)] + [(None, "n")] * 3 + [(-4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard(df, 4, parts=parts).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((k is not None, k or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id is not None and r.doc_id for r in order] == sorted((k is not None and k for k, _ in rows), key=lambda k: (k is not False, k))
    for s in range(4):
        own = [r for r in order if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own))) and abs(sum(r.size for r in own) - total / 4) <= largest


def test_mixing(spark, docs, none):
    p = mixing.planned(docs, entropy_share=None, most_repeats=1.5, budget_share=None).collect()
    assert len(p) == len(TEXTS) and all(r["_mix_copies"] >= 1 for r in p)
    size = {s: sum(r[mixing.TOKENS] for r in p if r.source == s) for s in {r.source for r in p}}
    assert {r["_mix_copies"] for r in p if r.source == max(size, key=size.get)} == {1}
    out = mixing.mix(docs, entropy_share=None, most_repeats=1.5, budget_share=None)
    assert out.columns == docs.columns and out.count() == sum(r["_mix_copies"] for r in p)
    assert mixing.planned(none).count() == 0 and mixing.mix(none).count() == 0


@pytest.mark.parametrize("group", [1 << 16, 128])
def test_exact_topk(spark, monkeypatch, group):
    monkeypatch.setattr(exact_topk, "GROUP", group)  # 128: many groups for a task to hold one by one
    monkeypatch.setattr(exact_topk, "GROUP_LEAST", 256)
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 12)) * r.uniform(0.1, 4, (700, 1))
    v[50:90] = v[50]
    v[300:340] = v[10] * 0.99
    v[699] = 0
    rows = [(k, x.tolist()) for k, x in enumerate(v[:-1])] + [(699, []), (1000, None), (1001, [None, 1.0]), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12)]
    df = spark.createDataFrame([(*x, "more", 1.0) for x in rows], "vec_id long, embedding array<double>, id string, length double").repartition(3)
    for scale in (1024, None):
        i = np.floor(v * 1024).astype(np.int64) if scale else v
        want = []
        for q in [*range(0, 700, 10), 699]:
            s = i @ i[q]
            for rank, k in enumerate([k for k in np.lexsort((np.arange(700), -s)) if k != q][:10], 1):
                want.append((q, rank, int(k), pytest.approx(s[k]) if scale is None else int(s[k])))
        got = sorted(map(tuple, exact_topk.top_k(df, df.where("vec_id % 10 = 0 or vec_id = 699"), 10, scale=scale).collect()))
        if scale is None:  # scores of copies may differ in the last bit
            got, want = [x[::3] for x in got], [x[::3] for x in sorted(want, key=lambda x: x[:2])]
        else:
            want.sort()
        assert got == want
    assert exact_topk.top_k(df.where("false"), df.where("false"), 10).count() == 0
    few = df.where("vec_id < 4")
    assert exact_topk.top_k(few, few.where("vec_id = 0"), 10).count() == 3


def test_exact_topk_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_topk.top_k(df, df, 10, scale=1).collect()))
    assert got == [(1, 1, 2, 1), (1, 2, 2, 1), (1, 3, 3, 0), (2, 1, 1, 1), (2, 2, 1, 1), (2, 3, 3, -1), (3, 1, 1, 0), (3, 2, 1, -1), (3, 3, 2, -1), (3, 4, 2, -1)]


def test_nn_descent_recall(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=(1500, 24))
    v[100:260] = v[100]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got: dict[int, list] = {}
    for x in nn_descent.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -9
        best = set(np.lexsort((np.arange(1500), -s))[:20].tolist())
        hits += len(best & {k for k, _ in found})
        assert q not in dict(found) and len(found) == 20 and all(abs(s[k] - c) < 1e-12 for k, c in found)
    assert hits / 20 / len(got) >= 0.9
    assert nn_descent.nearest(df.where("false"), df.where("false"), 20).count() == 0


def test_rounds_make_the_graph(spark, monkeypatch):
    """Without rounds the start finds little; the shipped rounds reach nine tenths, on more vectors than any group holds."""
    v = np.random.default_rng(11).normal(size=(20000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = staged_vectors(spark, v)
    asked = df.where("vec_id % 200 = 0")
    true = {}
    for q in range(0, len(v), 200):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -9
        true[q] = set(np.argpartition(-s, 20)[:20].tolist())
    share = {}
    for rounds in (0, nn_descent.MOST_ROUNDS):
        monkeypatch.setattr(nn_descent, "MOST_ROUNDS", rounds)
        got = nn_descent.nearest(df, asked, 20).select("query_id", "vec_id").collect()
        assert len(got) == 20 * len(true)
        share[rounds] = sum(r.vec_id in true[r.query_id] for r in got) / len(got)
    assert share[0] < 0.5 and share[nn_descent.MOST_ROUNDS] >= 0.9, share


def staged_vectors(spark, v):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"vec_id": range(len(v)), "embedding": v.astype(float).tolist()}), "vec_id long, embedding array<double>").repartition(4).cache()


def test_neighbours_few_and_hot(spark):
    """Few candidates are all returned; a vector that a third of the rows hold; one id on very many vectors."""
    r = np.random.default_rng(2)
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(100)] + [(100 + k, r.normal(size=3).tolist()) for k in range(100)] + [(500, r.normal(size=3).tolist()) for _ in range(100)]
    df = spark.createDataFrame([(*x, "more") for x in rows], "vec_id long, embedding array<double>, node string")
    v = np.array([x for _, x in rows])
    ids = np.array([k for k, _ in rows])
    own = {k: min((x for i, x in rows if i == k)) for k in (0, 50, 120, 500)}
    got: dict[int, list] = {}
    for x in nn_descent.nearest(df, df.where("vec_id in (0, 50, 120, 500)"), 8).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, round(x.score, 9)))
    for q, a in own.items():
        s = v @ np.array(a)
        want = [(int(ids[k]), round(float(s[k]), 9)) for k in np.lexsort((ids, -s)) if ids[k] != q][:8]
        assert got[q] == want
    few = df.where("vec_id in (0, 1, 100)")
    assert nn_descent.nearest(few, few, 8).groupBy("query_id").count().select("count").distinct().collect() == [(2,)]


def test_neighbours_with_two_vectors_of_one_id(spark):
    v = np.random.default_rng(3).normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, v[k]) for k in range(1, 50)] + [(0, v[50]), (0, v[51])] + [(k, v[50]) for k in range(100, 105)] + [(k, v[51]) for k in range(200, 205)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in rows], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for x in nn_descent.nearest(df, df.where("vec_id in (0, 7, 100, 200)"), 12).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, round(x.score, 9)))
    asked = {0: min(v[50].tolist(), v[51].tolist()), 7: v[7], 100: v[50], 200: v[51]}
    want = {q: sorted(((k, round(float(x @ np.asarray(a)), 9)) for k, x in rows if k != q), key=lambda p: (-p[1], p[0]))[:12] for q, a in asked.items()}
    assert got == want


def test_folded_tables_equal_the_convolution():
    """The language network's tables against its definition: filters over embedded bytes, the largest of each, a softmax."""
    net = language_id.ByteConv(["a", "b", "c"], seed=3)
    net.prepare()
    x = np.random.default_rng(4).integers(0, 256, (70, 64), dtype=np.uint8)
    want = []
    for row in x:
        e = net.p["emb"][row].astype(float)
        h = np.concatenate([np.max([e[k : k + w].ravel() @ net.p[f"w{w}"] for k in range(len(row) - w + 1)], 0) for w in language_id.WIDTHS])
        z = np.maximum(h, 0) @ net.p["out"] + net.p["bias"]
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.abs(net.probabilities(x) - want).max() < 1e-5


def test_attention_equals_its_definition(spark):
    """Scores of whole texts against a plain forward pass over each document's passages, long and short ones."""
    net = quality.AttentionBags(seed=8)
    net.fitted = True
    texts = ["", None, "one line", LONG * 3, *BASE[:5], "x" * 511, "x" * 513]
    got = {r.k: r.score for r in quality.score(spark.createDataFrame([(k, t, 9.0) for k, t in enumerate(texts)], "k long, text string, score double"), net).collect()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        bag = [np.frombuffer(raw[a : a + quality.PASSAGE].ljust(quality.PASSAGE), np.uint8) for a in range(0, max(1, len(raw)), quality.PASSAGE)]
        p = {n: w.astype(float) for n, w in net.p.items()}
        hs = [np.tanh((quality.encode(b[None])[0] - net.mean) / net.scale @ p["w"] + p["b"]) for b in bag]
        e = np.array([((np.tanh(h @ p["v"]) * sig(h @ p["u"])) @ p["a"])[0] for h in hs])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert got[k] == pytest.approx(sig(sum(w * h for w, h in zip(a, hs)) @ p["o"] + p["c"])[0], abs=1e-5)


def test_training_without_two_classes(spark, none):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(9)] * 2 + [(3, None), (None, 0)], "doc_id long, quality int")
    one = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.where("false"))).collect()} == {0.5}
    hot = quality.train(docs.unionByName(docs), labels.unionByName(spark.createDataFrame([(4, 0)] * 50, labels.schema)))  # one id fills the labels
    assert all(0 <= r.score <= 1 for r in quality.score(docs, hot).collect())


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than the sample has windows for one each: those drawn are learned, none by rank."""
    rows = [(k, chr(97 + k % 26) * 40, f"l{k % 26}") for k in range(520)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(df)
    assert net.classes == sorted({x[2] for x in rows})
    monkeypatch.setattr(language_id, "TRAIN_TOTAL", 130)
    assert 20 <= len(language_id.train(df).classes) <= 26


def test_language_and_quality(spark, none):
    lang = {"aa": "kai mou tha den einai pros", "bb": "zwisch ung heit schön über der", "cc": "ción ñada por los que esta"}
    rows, labels = [], []
    for k in range(600):
        name = R.choice(list(lang))
        good = k % 4 != 0
        w = [R.choice(lang[name].split()) for _ in range(R.randrange(20, 120))]
        rows.append((k, " ".join(w) if good else "!! ".join(x.upper() for x in w), name))
        labels.append((k, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train, test = df.where("doc_id % 3 <> 0"), df.where("doc_id % 3 = 0").unionByName(spark.createDataFrame([(9001, None, None), (9002, "123 !!", None), (9003, "", None)], df.schema))
    found = language_id.label(test, language_id.train(train)).collect()
    assert np.mean([r.lang == r.lang_pred for r in found if r.doc_id < 9000]) > 0.95
    assert {r.lang_pred for r in found if r.doc_id > 9000} == {"und"}
    assert language_id.label(test, None).select("lang_pred").distinct().count() == 1
    net = quality.train(train, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score(test, net).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == test.count()
    assert np.mean([(r.score >= 0.5) == labels[r.doc_id][1] for r in got if r.doc_id < 9000]) > 0.95
    assert quality.score(none.select("doc_id", "text"), net).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, t, R.choice(["en", None]), R.choice(["s0", "s1"]), len(t or ""), "more") for k, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en", "s0", 1, "more"), (None, "no id here", "en", "s1", 1, "more")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    d = spark.createDataFrame(rows, schema)
    d.write.parquet(f"{tmp_path}/in/documents.parquet")
    one = corpus_pipeline.identify_language(spark, d, "")
    assert one.columns == d.columns and one.where("text is null or text = ''").count() == 0
    two = corpus_pipeline.drop_near_duplicates(spark, d, "")
    ids = [r.doc_id for r in two.collect()]
    assert two.columns == d.columns and len(set(ids)) == len(ids) and None in ids
    three = corpus_pipeline.cut_repeats(spark, d, "")
    assert three.columns == d.columns
    cut = {r.doc_id: r for r in three.collect()}
    seen: set[bytes] = set()
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            gone[p : p + 100] |= raw[p : p + 100] in seen
            seen.add(raw[p : p + 100])
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if k != 7 and t is not None:  # 7 is there twice
            assert ((cut[k].text, cut[k].n_chars) if k in cut else None) == ((left, len(left)) if left.strip() or not t.strip() else None), k
    four = corpus_pipeline.mix_sources(spark, d, "")
    assert four.columns == d.columns and {r.doc_id for r in four.collect()} == {r[0] for r in rows}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sp_bpe.default_model())
    five = corpus_pipeline.encode_pieces(spark, d, "").collect()
    assert len(five) == len(rows) and all(r.ids == [*sp.encode(dict((x[0], x[1]) for x in rows)[r.doc_id] or ""), sp.eos_id()] and r.n_tokens == len(r.ids) for r in five)
    assert corpus_pipeline.run(spark, f"{tmp_path}/in").count() > 0
    empty = d.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
