"""SentencePiece coding, the Merkle manifest and whitening against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries, sentencepieces, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("grp", "key", "leaf", "forged", "pos", "n", "nth", "part", "idx", "above", "ids", "x", "component", "root", "turn")


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and long texts, repeated ids and rows, a hot source."""
    rng = random.Random(4)
    out = [(1, None, "en", "a", 0), (2, "", None, "b", 0), (3, " \n\t", "en", None, 3), (None, "No id", "en", "a", None), (None, None, None, None, None)]
    out += [(4, "Twice the SAME", "de", "hot", 5)] * 3 + [(4, "other text", "de", "hot", 5), (5, "Ünï▁ 日本 😀 <0x41>", "xx", "é", 1), (6, "word " * 9000, "en", "z", 45000)]
    return out + [(k, " ".join(rng.choice(["Stone", "river", "HOUSE", "ß"]) for _ in range(rng.randrange(9))), "en", "hot" if k % 3 else f"s{k % 20}", k) for k in range(7, 700)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("q").alias(c) for c in CLASH]).repartition(5)


# --- sentencepiece ------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as public
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return sentencepieces.load_model()


def texts_of(library, seed=1):
    rng = random.Random(seed)
    vocabulary = library.id_to_piece(list(range(259, 32000)))
    out = ["", " ", "  a  b ", "▁a", "a\n\nb\tc", "　x y é é ﬁ", "<s>", "<unk>", "<0x41>", "a\x00b", "日本語", "😀👍🏽", "a" * 3000, " " * 5000, "ththth" * 500, "banana" * 400]
    for _ in range(600):
        s = "".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))
        out.append(s.replace("▁", " ") if rng.random() < 0.5 else s)
        out.append("".join(rng.choice("abcdefgthes  ingéß日\n▁x😀") for _ in range(rng.randrange(200))))
    return [*out, "".join(rng.choice("abcdefgthesing") for _ in range(5000))]


def test_ids_equal_the_librarys(library, model):
    own, texts = sentencepieces.Tables(model), texts_of(library)
    got = own.encode([own.codes(t, True) for t in texts])
    assert [g.tolist() for g in got] == [library.encode(t) for t in texts]


@pytest.mark.parametrize("long", [0, 3])
def test_queue_and_rounds_agree(library, model, monkeypatch, long):
    own, texts = sentencepieces.Tables(model), texts_of(library, 2)[:300]
    monkeypatch.setattr(sentencepieces, "LONG", long)  # no worker takes part
    got = own.encode([own.codes(t, True) for t in texts])
    assert [g.tolist() for g in got] == [library.encode(t) for t in texts]


@pytest.mark.parametrize("most", [3, 60])
def test_long_texts_are_cut_between_words(library, model, most):
    own = sentencepieces.Tables(model)
    for t in texts_of(library, 3)[:80]:
        ids = [i for p in own.parts(t, most) for i in own.encode([p])[0].tolist()]
        assert ids == library.encode(t)


def test_words_of_one_tag_are_kept_apart(library, model, monkeypatch):
    own, text = sentencepieces.Tables(model), "stone river stone house river"
    monkeypatch.setattr(sentencepieces, "mix64", lambda x: x * np.uint64(0))
    assert own.encode([own.codes(text, True)])[0].tolist() == library.encode(text)


def test_any_ids_decode_as_the_librarys(library, model):
    rng, own = random.Random(5), sentencepieces.Tables(model)
    lists = [[rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randrange(12))] for _ in range(4000)]
    got = own.decode(np.array([i for x in lists for i in x], np.int32), np.cumsum([len(x) for x in lists]))
    assert got == [library.decode(x) for x in lists]
    with pytest.raises(ValueError, match="outside"):
        own.decode(np.array([32000]), np.array([1]))


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1]))  # a trainer's field: the kind without merges
    with pytest.raises(ValueError, match="no BPE model"):
        sentencepieces.load_model(str(path))


def test_tables_are_coded_whole(spark, docs, rows, library, model):
    encoded = sentencepieces.encode(docs, model)
    back = sentencepieces.decode(encoded.withColumn("n", F.size("ids")), model, keep=["doc_id", "n"])
    assert encoded.columns == ["doc_id", "ids"] and back.columns == ["doc_id", "n", "text"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((r[0], tuple(library.encode(r[1] or ""))) for r in rows)
    assert Counter(tuple(r) for r in back.collect()) == Counter((r[0], len(library.encode(r[1] or "")), library.decode(library.encode(r[1] or ""))) for r in rows)
    assert sentencepieces.encode(docs.limit(0), model).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in sentencepieces.decode(nothing, model).collect()] == ["", ""]


def test_query_equals_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r["text"] or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


# --- Merkle manifest ----------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_paths(nodes):
    """The root of a list of nodes, and of each the runs' other nodes, level by level."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            lo = a // 16 * 16
            sides[k].append(("".join(nodes[lo:a]), "".join(nodes[a + 1 : lo + 16])))
        nodes, at = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [a // 16 for a in at]
    return nodes[0], sides


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_paths([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, tops = plain_paths([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, leaf, r), sides in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf(r[0], text, *r[2:])
            for before, after in sides + top:
                node = h(before, node, after)
            out.append((r[0], leaf, trees[s][0], root, h(*(b + a for b, a in sides + top)), node, node == root))
    return Counter(out)


@pytest.mark.parametrize("levels", [3, 1, 2])
def test_manifest_equals_a_plain_one(docs, rows, levels):
    got = merkle.manifest(docs, merkle.fifth(F.col("doc_id")), levels=levels).collect()
    assert Counter(tuple(r) for r in got) == plain_manifest(rows)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_many_levels(spark):
    """A source of more than one block of 4,096 leaves, in ranges that cut it anywhere."""
    many = [(k * 7919 % 9001, f"T{k}", None, "big" if k % 9 else "s", k) for k in range(9001)]
    got = merkle.manifest(spark.createDataFrame(many, SCHEMA).repartition(7), merkle.fifth(F.col("doc_id"))).collect()
    assert Counter(tuple(r) for r in got) == plain_manifest(many)


def test_manifest_of_one_row_and_of_none(spark, docs):
    alone = [(1, "A", "en", None, 1)]
    got = merkle.manifest(spark.createDataFrame(alone, SCHEMA)).collect()
    leaf = plain_leaf(*alone[0])
    assert [tuple(r) for r in got] == [(1, leaf, leaf, leaf, h(""), leaf, True)]
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_equal_rows_are_many_ranges(spark):
    same = [(1, "A", "en", "s", 1)] * 3000
    df = spark.createDataFrame(same, SCHEMA).repartition(4)
    placed = merkle.numbered(merkle.leaves(df))
    assert sorted(r["pos"] for r in placed.collect()) == list(range(3000))
    assert Counter(tuple(r) for r in merkle.manifest(df).collect()) == Counter({k: n for k, n in plain_manifest(same).items()})


def test_manifest_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_merkle_manifest"])
    names = [d[0] for d in want.description]
    got = queries.op12_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


# --- whitening ----------------------------------------------------------------------


def plain_whitening(rows, k=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (d - len(v))) for i, v in kept]
    x = sorted({tuple(v) for _, v in kept})
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array(x, float) - np.array(s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    total = np.trace(centred.T @ centred / n)
    of = {v: (np.array(v) - np.array(s) / n) @ u / np.sqrt(e) for v in x}
    return [(i, j + 1, n, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), of[tuple(v)][j], e[j] / total) for i, v in kept for j in range(k)], u


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    for j in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in x if r[1] == j]) for x in (got, want))
        assert np.allclose(a, b, atol=1e-9) or np.allclose(a, -b, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=12).astype(np.float32) * np.arange(1, 13)]) for k in range(300)]
    rows += [rows[0]] * 50 + [(900, rows[1][1]), (None, rows[2][1]), (901, [-0.0] * 12), (902, []), (903, [1.0] * 5)]
    return rows + [(910, None), (911, [None] + [1.0] * 11), (912, [math.nan] * 12), (913, [math.inf] * 12)]


def test_whitening_equals_a_plain_one(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("x", F.lit("q")).withColumn("n", F.lit(1)).repartition(6)
    got = whitening.whiten(df).collect()
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    close(got, plain_whitening(vectors)[0])


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    close(queries.op13_whitening(spark, "/root/testdata/sf0.001").collect(), plain_whitening(rows)[0])


def test_large_entries_stay_exact(spark):
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) * 2.0**30 for _ in range(3)]) for k in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=2).collect()
    want = {r[0]: r[3] for r in plain_whitening(rows, 2)[0]}
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in got)
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and {r["vec_id"]: r["deviation"] is None for r in got} == {1: True, 2: True, 3: False}


def test_whitening_without_variance(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(make(rows)).count() == 0
    two = whitening.whiten(make([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 1.0]), (3, [2.0, 2.0, 1.0])])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"] > 1 - 1e-9) for r in two) == [(k, 1, 1.0, True) for k in (1, 2, 3)]
