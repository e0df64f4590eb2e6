"""The training-data operators against brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import calibration, chat_format, common, components, decontaminate, language_id, mixing, ngram_join, packing, quality_classifier, quality_rules, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that is was for with house river stone walking quickly another mountain through because people water".split(),
    "de": "der die und das ist nicht haus fluß stein schnell gegangen wieder berg durch weil menschen wasser über größer zeitung".split(),
}


def sentence(rng, lang="en", n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties and
    columns whose names clash with inner ones."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(9999)}" for _ in range(30000))
    rows = [(1, None, "en", "a", 0), (2, "", None, "b", 0), (3, " \n\t", "en", None, 3), (4, long, "en", "a", None), (None, "no id here at all", "en", "a", 1), (5, "... 123 !!", "de", "b", 2)]
    rows += [(6, sentence(rng), "en", "a", 5)] * 2 + [(k, sentence(rng, "de" if k % 2 else "en"), "de" if k % 2 else "en", f"s{k % 3}", k) for k in range(7, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ("size", "rep", "key", "kept", "tag", "sig", "score", "lang_pred", "row", "id", "n", "part", "target", "comp", "shard", "rest", "slot")
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


# --- n-gram join --------------------------------------------------------------------


def brute_join(rows, threshold=0.8):
    """class_id and n_links of each id, by all pairs."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows}
    texts = dict(rows)
    near = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                same = texts[a] is not None and texts[a] == texts[b]
                if same or (both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9):
                    near[a].add(b)
                    near[b].add(a)
    out, todo = {}, set(sets)
    while todo:
        group, edge = set(), {min(todo)}
        while edge:
            group |= edge
            edge = set().union(*(near[i] for i in edge)) - group
        todo -= group
        out |= {i: (min(group), len(near[i]) - 1) for i in group}
    return out


def near_copies(seed=3, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, k = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k + i, rows[0][1]) for i in range(30)] + [(k + 40, ""), (k + 41, ""), (k + 42, None), (k + 43, None), (k + 44, "\n ")]
    return rows


def test_join_equals_all_pairs(spark):
    rows = near_copies()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_join(rows)


def test_join_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)


def test_join_odd_rows(spark, odd):
    got = ngram_join.join(odd).collect()
    assert len(got) == odd.count()
    assert [r["n_links"] for r in got if r["doc_id"] == 6] == [1, 1] and all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] in (1, 2, 3))
    assert ngram_join.keep_one(odd).columns == odd.columns
    assert ngram_join.join(odd.limit(0)).count() == 0


@pytest.mark.parametrize("centred", [False, True])
def test_links_of_sets_and_of_differences(centred):
    rng = np.random.default_rng(2)
    for threshold in (0.5, 0.8):
        base = np.unique(rng.integers(0, 900, 60).astype(np.uint64))
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(12)]
        sets += [np.unique(np.concatenate([rng.choice(base, len(base) - int(rng.integers(0, 9)), replace=False), rng.integers(1000, 1020, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(20)]
        centre = base if centred else base[:0]
        parts = [ngram_join.differences(s, centre) for s in sets]
        got = ngram_join.linked([d for d, _, _ in parts], np.array([a + threshold * b for _, a, b in parts]), (1 - threshold) * len(centre), threshold)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert got[i, j] == (i != j and len(np.intersect1d(a, b)) >= threshold * len(np.union1d(a, b)) - 1e-9)
        both = ngram_join.common_members(sets, width=7)
        assert all(both[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_unlike_texts_of_one_id(spark):
    """Ids that repeat over unlike texts, and null ids: every link is found, no text lost."""
    base = [[f"{k}w{i}" for i in range(60)] for k in range(3)]
    text = lambda k, extra="": " ".join(base[k]) + extra
    rows = [(1, text(0)), (1, text(1)), (2, text(0, " z")), (3, text(1, " z")), (None, text(2)), (None, text(2, " y")), (None, text(2)), (7, text(2, " q")), (8, None), (8, None), (9, ""), (10, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in ngram_join.join(df).collect())
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (0, 7, 3), (0, 7, 3), (0, 7, 3), (7, 7, 3), (8, 8, 0), (8, 8, 0), (9, 9, 0), (10, 10, 0)])
    assert [r["class_id"] for r in ngram_join.join(df.filter("doc_id is null")).collect()] == [None] * 3
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.keep_one(df).collect())
    assert kept == sorted([(1, text(0)), (1, text(1)), (7, text(2, " q")), (8, ""), (8, ""), (9, ""), (10, " ")])
    only = spark.createDataFrame([(1, text(0)), (1, text(1))] * 2, "doc_id long, text string")
    assert sorted(r["text"] for r in ngram_join.keep_one(only).collect()) == sorted([text(0), text(1)])


def test_forest_stops_early_only_where_recall_is_reached():
    """Texts in dense places stop at long prefixes, others go on to the shortest one."""
    assert ngram_join.shortest_prefix(0.8, 0.9999) == 4 and ngram_join.shortest_prefix(0.8, 0.99) == 6
    with pytest.raises(ValueError, match="cannot find"):
        ngram_join.shortest_prefix(0.1, 0.9999)
    dense, none = np.full((1, 400), 0.97), np.zeros((1, 400))
    assert ngram_join.unmet_share(dense, 6, 0.8)[0] <= 1e-4 < ngram_join.unmet_share(none, 6, 0.8)[0]
    assert ngram_join.unmet_share(none, 4, 0.8)[0] <= 1e-4
    # a pair that shares four values of a tree meets although both stand beside a dense group
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, ngram_join._HASHES).astype(np.uint16)
    sig = np.repeat(base[None], 202, axis=0)
    for i in range(200):
        sig[i, rng.integers(6, ngram_join._HASHES, 2)] += 1
    sig[200:, 4:26] += 7  # agrees with the group in four fifths, and in four values of the first tree
    sig[201, 110:] += 3
    key = ngram_join._prefixes(sig, np.zeros(202, int))
    order = ngram_join._in_order(key)
    mask = ngram_join.meet(key[order], sig[order], None, np.zeros(202, np.float32), 0.8, 0.9999, 4)
    place = np.argsort(order)
    assert mask[place[200], place[201]] and mask[place[200]][place[:200]].all() and mask[place[0], place[1]]


def test_recall_of_pairs_just_above_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85: the forest finds them as the target says."""
    rng = random.Random(31)
    rows = []
    for k in range(400):
        words = [f"{k}w{i}" for i in range(220)]
        other = list(words)
        for i in rng.sample(range(220), 4):
            other[i] = f"x{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    want = brute = {i: n for i, (_, n) in brute_join_in_pairs(rows).items()}
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want.values()) >= 300 and got == brute


def brute_join_in_pairs(rows):
    """:func:`brute_join` of each two rows by themselves (the others share no word)."""
    return {i: r for k in range(0, len(rows), 2) for i, r in brute_join(rows[k : k + 2]).items()}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- language -----------------------------------------------------------------------


def plain_viterbi(scores, switch):
    """Labels' total score by trying all sequences."""
    import itertools

    return max(sum(scores[t][p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False)) for path in itertools.product(range(len(scores[0])), repeat=len(scores)))


def test_labels_are_optimal():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        for _ in range(25):
            scores = rng.normal(0, 4, (n, 3)).astype(np.float32)
            for labels in (language_id.viterbi(scores, 3.0), language_id.label_words(scores, np.array([0, n]), 3.0)):
                total = scores[np.arange(n), labels].sum() - 3.0 * (np.diff(labels) != 0).sum()
                assert math.isclose(total, plain_viterbi(scores.tolist(), 3.0), abs_tol=1e-3)


def test_language_and_spans(spark, odd):
    model = language_id.fit(odd)
    rng = random.Random(8)
    mixed = sentence(rng, "en", 40) + ". " + sentence(rng, "de", 25)
    (lang, score, spans), (und, zero, none) = language_id.predict([mixed, "12 !"], model)
    assert lang == "en" and 0 < score <= 1 and [s["lang"] for s in spans] == ["en", "de"] and abs(spans[0]["end"] - 40) <= 2
    assert (und, zero, none) == ("und", 0.0, [])
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "und")} <= got and all(0 <= r["score"] <= 1 for r in language_id.identify(odd, model).collect())
    assert language_id.predict(["abc"], language_id.fit(odd.limit(0))) == [("und", 0.0, [])]
    assert all(lang == ("de" if i % 2 else "en") for i, lang in got if i and i >= 7)


def plain_language(text, model):
    """Language and spans of a text, letter by letter and word by word."""
    import unicodedata

    words, inside = [], False
    for ch in (text or "").lower():
        letter = unicodedata.category(ch)[0] in "LM"
        if letter and not inside:
            words.append("")
        if letter:
            words[-1] += ch
        inside = letter
    if not words:
        return "und", []
    m1, m2, m3, end, top = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 64 - language_id.SLOTS.bit_length() + 1
    cut = lambda x: (x % (1 << 64)) >> top
    scores = []
    for w in words:
        total = np.zeros(len(model["langs"]))
        for i, ch in enumerate(w):
            a, b, d = ord(ch), ord(w[i - 1]) if i else 32, ord(w[i - 2]) if i > 1 else 32
            slots = (cut(a * m1), cut((a * m1 + b * m2 + 1) * m1), cut((a * m1 + b * m2 + d * m3 + (i == len(w) - 1) * end) * m1))
            total += sum(model["logp"][n][x] for n, x in enumerate(slots))
        script = next((k for k, ranges in enumerate(language_id.SCRIPTS.values(), 1) if any(lo <= ord(w[0]) <= hi for lo, hi in ranges)), 0)
        scores.append(total - 1e4 * ~model["scripts"][:, script].astype(bool))
    labels = language_id.viterbi(np.array(scores, np.float32))
    letters = Counter()
    for w, k in zip(words, labels, strict=True):
        letters[k] += len(w)
    spans = [k for i, k in enumerate(labels) if not i or k != labels[i - 1]]
    return model["langs"][min(letters, key=lambda k: (-letters[k], k))], [model["langs"][k] for k in spans]


def test_predictions_equal_plain_ones(spark):
    rng = random.Random(19)
    texts = [" ".join(sentence(rng, rng.choice(["en", "de"]), rng.randrange(1, 30)) for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["", "1 2", "Ω λόγος and the", "a\u0301b", "\U00030000 字", "straße, 5x Über-haus"]
    model = language_id.fit(spark.createDataFrame([(sentence(rng, lang, 40), lang) for lang in ("en", "de") * 30], "text string, lang string"))
    for text, (lang, _, spans) in zip(texts, language_id.predict(texts, model), strict=True):
        assert (lang, [s["lang"] for s in spans]) == plain_language(text, model), text


def test_long_text_in_pieces(monkeypatch):
    text = "wort " * 900
    assert "".join(language_id._pieces(text, 100)) == text and "".join(language_id._pieces("x" * 500, 100)) == "x" * 500


# --- decontamination -------------------------------------------------------------------


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(2))
        assert decontaminate.lcs(a, b) == plain_lcs(a.tolist(), b.tolist())


def leaks_fixture():
    rng = random.Random(6)
    vocabulary = [f"word{i}x" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) if rng.random() < 0.6 else rng.choice(WORDS["en"]) for _ in range(n)]
    items = [(k, text(rng.choice([12, 25, 45, 150]))) for k in range(60)]
    docs, planted = [], set()
    for d in range(150):
        w = text(rng.randrange(5, 400))
        if d % 3 == 0:
            item, q = items[rng.randrange(60)]
            q = list(q)
            if d % 2:  # a paraphrase: a sixth of the words replaced, the end kept
                for i in rng.sample(range(max(len(q) // 6, len(q) - 12)), len(q) // 6):
                    q[i] = rng.choice(vocabulary)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in q]
            planted.add((d, item))
        docs.append((d, " ".join(w)))
    return [(k, " ".join(q)) for k, q in items], docs, planted


def test_leaks_are_found_and_clean_ones_left(spark, odd):
    items, docs, planted = leaks_fixture()
    benchmark = spark.createDataFrame([*items, (900, None), (901, "kurz"), items[0]], "item_id long, text string").withColumn("score", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got == planted
    assert decontaminate.find(odd, benchmark).count() == 0 and decontaminate.find(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.find(odd.limit(0), benchmark).count() == 0
    assert decontaminate.clean(odd, benchmark).columns == odd.columns and decontaminate.clean(odd, benchmark).count() == odd.count()


def test_rows_are_judged_by_their_own_text(spark):
    """Null and repeated ids over unlike texts; several scans, and an item that is too long for one."""
    items, docs, planted = leaks_fixture()
    leaking = {d for d, _ in planted}
    rows = [(None if d % 2 else 7, t, d) for d, t in docs]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    rng = random.Random(3)
    long = " ".join(f"long{rng.randrange(9000)}" for _ in range(3000))
    benchmark = spark.createDataFrame([(k, t, "yes") for k, t in items] + [(0, items[0][1], "no"), (77, long, None)], "item_id long, text string, answer string")
    for parts in ({}, {"size": 16, "number": 2, "stretch": 4}):
        few = benchmark.filter("item_id < 12 or item_id = 77") if parts else benchmark
        want = {d for d, i in planted if i < 12} if parts else leaking
        assert {r["kept"] for r in decontaminate.clean(table, few, **parts).collect()} == {d for d, _ in docs} - want
    # one match a row and item, in however many scans its stretches are found; equal rows have one each
    whole = spark.createDataFrame([(1, "x " + long + " y")] * 2 + [(1, long + " z"), (None, long)], "doc_id long, text string")
    item = benchmark.filter("item_id = 77")
    for parts in ({}, {"size": 4, "number": 2, "stretch": 4}):
        got = decontaminate.find(whole, item, **parts).collect()
        assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 77), (1, 77), (1, 77), (1, 77)]
        assert all(r["coverage"] == 1 and r["rare"] > 0.999 for r in got)


def test_short_items_and_long_answers(spark):
    _, docs, _ = leaks_fixture()
    answer = [f"ans{k}" for k in range(90)]
    question = [f"frage{k}" for k in range(20)]
    benchmark = spark.createDataFrame([(1, "Kurz gesagt", None), (2, "...", None), (3, " ".join(question), " ".join(answer)), (4, "kurz, gesagt!", None)], "item_id long, text string, answer string")
    half = [*question[:14], *(f"x{k}" for k in range(6))]
    rows = [(1, "was\nKURZ  gesagt.\nend"), (2, "kurz gesagt ist es so"), (3, " ".join([*half, *answer])), (4, " ".join([*half, *answer[:80]])), (5, " ".join(half + [docs[0][1]])), (6, None), (7, "...")]
    got = {(r["doc_id"], r["item_id"], r["answer"]) for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {(1, 1, False), (1, 4, False), (3, 3, True)}


@pytest.mark.parametrize("rank", [192, 24])
def test_recall_with_the_fitted_space(spark, monkeypatch, rank):
    """The space that power iteration finds, not the queries' whole span: every place that
    the checks on the words accept must be a candidate, nine of ten in a narrow space."""
    monkeypatch.setattr(decontaminate, "RANK", rank)  # read on the driver
    items, docs, planted = leaks_fixture()
    index = decontaminate.Index(decontaminate.query_passages([(i, t, None) for i, t in items]))
    decontaminate.fit(spark.createDataFrame(docs, "doc_id long, text string"), [index])
    assert index.basis.shape[1] <= rank and np.allclose(index.basis.T @ index.basis, np.eye(index.basis.shape[1]), atol=1e-4)
    held = (index.energy**2).mean()
    assert held >= 0.95 - 1e-6 if rank == 192 else held > 0.25
    found = {(text, item) for text, item, *_ in decontaminate.matches(index, [t for _, t in docs])}
    wanted = {(d, i) for d, i in planted if brute_leak(index, docs[d][1], i)}
    assert len(wanted) >= 45 and len(wanted & found) >= (1.0 if rank == 192 else 0.9) * len(wanted)


def index_of(items, docs, times=1):
    """An index with exact cosines, weighed as if the table were so many times as large."""
    index = decontaminate.Index(decontaminate.query_passages([(i, t, None) for i, t in items]))
    hashes, first = decontaminate.word_hashes(docs)
    block, start = decontaminate.blocks_of(first, decontaminate.WINDOW)
    term = index.terms(hashes)
    pairs = np.unique(np.stack([block[term >= 0], term[term >= 0]]), axis=1)
    index.weigh(np.bincount(pairs[1], minlength=len(index.vocabulary)) * times, int(start[-1]) * times)
    index.project(np.linalg.qr(index.query_matrix().T)[0])  # all of the queries' span, so cosines are exact
    return index


def brute_leak(index, text, item):
    """Whether the checks on the words pass at any place of a text."""
    hashes = decontaminate.word_hashes([text])[0]
    for q in (q for q in index.queries if q["item"] == item):
        w, m = q["words"], len(q["words"])
        idf = index.idf[index.terms(w)] + 1e-3
        for a in range(0, len(hashes), 16):
            region = hashes[max(0, a - m // 2) : a + decontaminate.WINDOW + m // 2]
            inside = np.isin(w, region)
            if decontaminate.lcs(w, region) >= decontaminate.COVER * m and idf[inside].sum() >= decontaminate.RARE * idf.sum():
                return True
    return False


@pytest.mark.parametrize("times", [1, 1000])
def test_recall_of_paraphrases_does_not_fall_with_the_table(times):
    rng = random.Random(21)
    inside, outside = [f"in{i}" for i in range(300)], [f"out{i}" for i in range(5000)]
    plain = lambda n: [rng.choice(inside if rng.random() < 0.2 else outside) for _ in range(n)]
    items = [(k, rng.sample(inside, 16)) for k in range(30)]
    docs, planted = [" ".join(plain(300)) for _ in range(200)], []
    for item, words in items:
        q, w = list(words), plain(200)
        for i in rng.sample(range(16), 3):
            q[i] = rng.choice(outside)
        at = rng.randrange(200)
        planted.append((item, " ".join([*w[:at], *q, *w[at:]])))
    index = index_of([(i, " ".join(t)) for i, t in items], docs + [t for _, t in planted], times)
    found = {(text, item) for text, item, *_ in decontaminate.matches(index, [t for _, t in planted])}
    wanted = {(k, item) for k, (item, t) in enumerate(planted) if brute_leak(index, t, item)}
    assert len(wanted) >= 20 and wanted <= found


@pytest.mark.parametrize(("copies", "others", "length"), [(2, 37, 20), (40, 80, 12)])
def test_items_that_leak_often_are_found(spark, copies, others, length):
    rng = random.Random(22)
    item = [f"leak{i}" for i in range(16)]
    second = [f"rare{i}" for i in range(30)]
    docs = [" ".join(rng.choice(WORDS["en"]) for _ in range(length)) for _ in range(others)]
    # the last leaks stand among words of another item, which weigh more
    docs += [" ".join([*item, *(second[:15] if k == copies - 1 else [])]) for k in range(copies)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(second))], "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"] for r in decontaminate.find(table, benchmark).collect() if r["item_id"] == 1}
    assert got == set(range(others, others + copies))
    assert decontaminate.clean(table, benchmark).count() == others


def test_candidates_against_exact_cosines(spark):
    """Recall of the latent search: windows whose exact cosine passes."""
    items, docs, _ = leaks_fixture()
    index = decontaminate.Index(decontaminate.query_passages([(i, t, None) for i, t in items]))
    decontaminate.fit(spark.createDataFrame(docs, "doc_id long, text string"), [index])
    hashes, first = decontaminate.word_hashes([t for _, t in docs])
    got = {(t, a, q) for t, a, q, _ in zip(*(x.tolist() for x in decontaminate.candidates(index, hashes, first)), strict=True)}
    wanted = set()
    queries = index.query_matrix()
    for t in range(len(docs)):
        words = hashes[first[t] : first[t + 1]]
        for a in range(0, len(words), 16):
            w = words[a : a + 32]
            term = index.terms(w)
            v = np.zeros(len(index.vocabulary))
            np.add.at(v, term[term >= 0], 1)
            v *= index.idf
            norm = math.sqrt(sum(float(index.idf[x]) ** 2 if x >= 0 else index.rarest**2 for x in term))
            wanted |= {(t, a, q) for q in np.flatnonzero(queries @ v >= 0.35 * max(norm, 1e-9)).tolist()}
    assert index.basis.shape[1] <= decontaminate.RANK < len(index.vocabulary)
    assert len(wanted) > 100 and len(wanted & got) >= 0.95 * len(wanted)


def test_latent_vectors_relate_words_of_one_topic(spark):
    """The corpus' directions bring windows of a query's topic near although the words
    differ, which plain cosines cannot."""
    rng = random.Random(4)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    docs = spark.createDataFrame([(d, " ".join(rng.choice(topics[d % 6]) for _ in range(300))) for d in range(120)], "doc_id long, text string")
    halves = [(k, " ".join(t[:6] * 2)) for k, t in enumerate(topics)] + [(k + 6, " ".join(t[6:] * 2)) for k, t in enumerate(topics)]
    index = decontaminate.Index(decontaminate.query_passages([(i, t, None) for i, t in halves]))
    decontaminate.fit(docs, [index])
    plain = index.query_matrix() @ index.query_matrix().T
    corpus = index.query_matrix() @ index.basis[:, :6]
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    near = corpus @ corpus.T
    for k in range(6):
        assert plain[k, k + 6] == 0 and near[k, k + 6] > 0.9 and max(abs(near[k, j]) for j in range(12) if j % 6 != k) < 0.5


# --- quality rules ---------------------------------------------------------------------


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_stats(spark, odd):
    rng = random.Random(2)
    texts = [None, "", "a\n\na\nb \nb\x0b", "a b c a b c a", "x\u00a0y #*|", *["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(80))) for _ in range(200)]]
    for t in texts:
        assert quality_rules.text_stats(t)[:5] == brute_stats(t)
    got = quality_rules.with_stats(odd).collect()
    assert len(got) == odd.count()


def brute_cutoff(good, bad, allowed, level):
    """Cutoffs from loose to strict while the bound, found by bisection of the plain
    sum, is under the risk; a stricter one only for enough bad texts."""
    total = sum(good)
    chosen, since = None, len(quality_rules.GRID)
    for k in reversed(range(len(quality_rules.GRID))):
        rejected = sum(good[k + 1 :])
        below = lambda p, r=rejected: sum(math.comb(total, i) * p**i * (1 - p) ** (total - i) for i in range(r + 1))
        if total == 0 or rejected >= total or below(allowed) > level:
            break
        more_bad, more_good = sum(bad[k + 1 : since + 1]), sum(good[k + 1 : since + 1])
        if more_bad and more_bad >= quality_rules.GAIN * more_good:
            chosen, since = quality_rules.GRID[k], k
    return chosen


def test_choice_of_cutoffs_equals_brute_force():
    rng = random.Random(14)
    steps, seen = len(quality_rules.GRID) + 1, set()
    for _ in range(300):
        good = [rng.choice([0, 0, 0, 0, 1, 2, 20]) for _ in range(steps)]
        good[0] = rng.choice([0, 400, 850])
        bad = [rng.choice([0, 0, 5, 60]) for _ in range(steps)]
        got = quality_rules.choose_cutoff(good, bad, 0.02, 0.01)
        assert got == brute_cutoff(good, bad, 0.02, 0.01)
        seen.add(got)
    assert len(seen) > 4


def test_bounds_of_large_holdouts_are_cheap():
    import time

    began = time.perf_counter()
    assert quality_rules.holds(9_000_000, 10**9, 0.01, 1e-3) and not quality_rules.holds(10_000_000, 10**9, 0.01, 1e-3)
    assert time.perf_counter() - began < 2


def test_null_and_empty_languages_are_two_strata(spark):
    rows = [(k, None if k % 2 else "", 100, 600, 60 if k % 2 and k % 3 == 0 else 0, 0, 0, 10, 90, 500) for k in range(4000)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, " + quality_rules.STATS)
    labels = spark.createDataFrame([(k, 0 if k % 2 and k % 3 == 0 else 1) for k in range(4000)], "doc_id long, quality int")
    cut = {r["stratum"]: r["symbols"] for r in quality_rules.thresholds(measured, labels).collect()}
    assert set(cut) == {"null", "="} and cut["null"] is not None and cut["="] is None


def test_binomial_bound():
    for k, n, level in ((0, 10, 0.05), (3, 50, 0.01), (20, 400, 0.001), (45, 50, 0.2)):
        p = quality_rules.binomial_upper(k, n, level)
        assert quality_rules.holds(k, n, p * 1.001, level) and not quality_rules.holds(k, n, p * 0.999, level)
        assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), level, rel_tol=1e-6)
    assert quality_rules.binomial_upper(5, 5, 0.1) == 1.0 and quality_rules.binomial_upper(0, 0, 0.1) == 1.0


def test_cutoffs_hold_their_risk(spark, odd):
    rng = np.random.default_rng(3)
    n = 6000
    bad = rng.random(n) < 0.3
    rows = [(i, "en" if i % 2 else None, 100, 600, int(60 if b else rng.integers(0, 3)), 0, 0, 10, 90, 500) for i, b in enumerate(bad.tolist())]
    names = "doc_id long, lang string, " + quality_rules.STATS
    measured = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad.tolist())] + [(None, 1), (3, None)], "doc_id long, quality int")
    judged = quality_rules.judge(measured, quality_rules.thresholds(measured, labels)).join(labels.filter("quality is not null"), "doc_id")
    got = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert got.get((0, True), 0) == 0 and got.get((1, False), 0) <= 0.05 * n
    stats = quality_rules.with_stats(odd)
    none = quality_rules.judge(stats, quality_rules.thresholds(stats, labels.limit(0)))
    assert none.count() == odd.count() and none.filter("kept is null or kept = base_failed").count() == 0


# --- mixing ------------------------------------------------------------------------------


def brute_targets(sizes):
    """source -> target by rounds of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.choice([0, 1, 7, 60, 900]), rng.choice(["a", "b", "b", "b", "c", "d", None, "é"])) for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_tokens=20000).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + 16 * 8


def test_tiny_sources_meet_their_targets(spark):
    rows = [(1, "w " * 5, "a"), (2, "w " * 7, "b"), (3, "w " * 9, "c"), (4, "w " * 40, "d"), (5, "w " * 4000, "e"), (6, "w " * 2, "f")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 6 and all(abs(r["taken"] - r["target"]) <= 1 + 0.01 * r["target"] for r in got)


def test_mix_with_one_row_a_third_of_all(spark):
    rows = [(None, "same words in all of these", "a")] * 600 + [(k, f"w{k} " * (1 + k % 90), f"s{k % 4}") for k in range(1200)] + [(7, None, "z")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (mixing.mix(d, shard_tokens=500).collect() for d in (df, df.repartition(7)))
    assert len(a) == len(rows) and sorted(map(str, a)) == sorted(map(str, b))
    taken, target = Counter(), {}
    for r in a:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 0.02 * t + 2 for s, t in target.items())
    # equal rows lie in many shards, and those without words in none
    groups = mixing._mix(df, shard_tokens=500)[0]
    assert groups.filter("doc_id is null").count() >= 7 and groups.filter("size = 0").count() == 0


def test_taken_words_equal_listed_blocks(spark):
    """The closed formula against blocks listed one by one."""
    rng = random.Random(12)
    rows = [(k, f"w{k} " * rng.choice([1, 3, 17, 200]), rng.choice("ab")) for k in range(300)]
    got = mixing._mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_tokens=3000)[0].collect()
    for (source, shard), own in {(r["source"], r["shard"]): [x for x in got if (x["source"], x["shard"]) == (r["source"], r["shard"])] for r in got}.items():
        total, size = sum(r["words_taken"] for r in own), sum(r["size"] for r in own)
        assert own[0]["whole"] * size <= total <= (own[0]["whole"] + 1) * size
        # what a document takes beyond the whole is within a block of its even share, the choice being evenly spread
        share = total / size
        assert all(abs(r["words_taken"] - share * r["size"]) <= 2 * 16 for r in own), (source, shard)


def test_mix_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.filter("doc_id < 4")).agg(F.sum("taken")).first()[0] == 0
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (odd, odd.repartition(5)))
    assert a == b
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixed_documents_meet_each_sources_target(spark):
    rng = random.Random(9)
    sources = [k % 5 for k in range(1500)]
    rows = [(i, " ".join(["w"] * min(20000, int(rng.lognormvariate(5, 1)))), f"s{s}" if s else None) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(docs, shard_tokens=20000).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("words")).collect()
    words = Counter()
    for r in got:
        words[r["source"]] += r["words"]
    want = {r["source"]: (r["target"], r["source_size"]) for r in mixing.mix(docs, shard_tokens=20000).select("source", "target", "source_size").distinct().collect()}
    assert len(want) == 5 and all(abs(words[s] - target) < 0.02 * target for s, (target, _) in want.items())
    # copies differ by one at most within a source, so none is taken in place of others
    for s, (target, size) in want.items():
        assert {r["n"] for r in got if r["source"] == s} <= {math.floor(target / size), math.floor(target / size) + 1}


def test_the_pipelines_mix_meets_targets_of_real_documents(spark):
    """Sources of ratios from a third to three on the documents of the test tables."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["source"]: r for r in mixing.mix(docs).select("source", "target", "source_size").distinct().collect()}
    got = {r["source"]: r["words"] for r in corpus_pipeline.mix(spark, docs, "").groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("words")).collect()}
    ratios = [r["target"] / r["source_size"] for r in want.values()]
    assert min(ratios) < 0.5 and max(ratios) > 1.2
    # a source's words come within its shortest documents of its target
    assert all(abs(got.get(s, 0) - r["target"]) <= 0.02 * r["target"] + 50 for s, r in want.items()), {s: (got.get(s), r["target"]) for s, r in want.items()}


def test_apportionment_is_by_highest_quotients(spark):
    targets = {f"s{i:02}": t for i, t in enumerate([1000.0, 371.0, 249.0, 88.0, 87.0, 40.0, 39.5, 8.0, 7.9, 0.5])}
    df = spark.createDataFrame([(s, t) for s, t in targets.items()], "source string, target double")
    rows = mixing.apportion(df, 16).collect()
    got, block = {r["source"]: r["blocks"] for r in rows}, rows[0]["block"]
    assert block == 1 and mixing.apportion(df.filter("target > 1000 or target = 371"), 16).first()["block"] == 5
    house, seats = math.floor(sum(targets.values()) / block + 0.5), Counter()
    for _ in range(house):
        best = max(sorted(targets), key=lambda s: targets[s] / (2 * seats[s] + 1))
        seats[best] += 1
    assert got == {s: seats[s] for s in targets}


# --- quality classifier --------------------------------------------------------------------


def test_compression_tells_junk(spark, odd):
    rng = random.Random(7)
    rows = [(k, sentence(rng, "en", 120) if k % 2 else " ".join(rng.choice("BUY!! NOW!! FREE### $$$ WIN!!".split()) for _ in range(120)), k % 2) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows if k % 3] + [(1, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    assert all((got[k] >= 0.3) == (q == 1) for k, _, q in rows)
    scores = [r["score"] for r in quality_classifier.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(docs.limit(3), none).collect()} == {0.5}
    assert len({r["score"] for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels.filter("quality = 1"))).collect()}) == 1


def test_scores_equal_a_plain_recomputation(spark, odd):
    """Every score from the sizes that the zstandard library gives, the pooled curve
    checked against least squares over all partitions of neighbours."""
    import zstandard

    rng = random.Random(17)
    rows = [(k, sentence(rng, "en" if k % 2 else "de", rng.randrange(1, 300)), k % 2) for k in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    good, bad = (zstandard.ZstdCompressionDict(d) for d in model["dicts"])
    size = lambda raw, d: sum(len(zstandard.compress(raw[i : i + 512], 3)) if not len(d) else len(zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[i : i + 512])) for i in range(0, len(raw), 512))
    curve = model["calibration"]
    every = docs.unionByName(odd.select("doc_id", "text").filter("doc_id is null or doc_id < 4"))
    for text, got in zip([r["text"] for r in every.collect()], [r["score"] for r in quality_classifier.score(every, model, ("text",)).collect()], strict=True):
        raw = (text or "").encode()
        x = (size(raw, bad) - size(raw, good)) / len(raw) if raw else 0.0
        assert math.isclose(got, float(np.interp(x, curve["at"], curve["share"])), abs_tol=1e-12)


def test_isotonic_pools_are_least_squares():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        x, y, w = np.sort(rng.normal(size=n)), rng.integers(0, 2, n).astype(float), rng.uniform(0.5, 2, n)
        best = None
        for mask in range(1 << (n - 1)):
            edges = [0, *[i + 1 for i in range(n - 1) if mask >> i & 1], n]
            means = [np.average(y[a:b], weights=w[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if all(a <= b for a, b in zip(means, means[1:], strict=False)):
                fit = np.repeat(means, np.diff(edges))
                cost = float((w * (y - fit) ** 2).sum())
                best = min(best, (cost, fit.tolist())) if best else (cost, fit.tolist())
        model = calibration.fit_isotonic(x, y, w)
        common, half = np.average(y, weights=w), 0.5 * w.mean()
        got = calibration.apply_isotonic(model, x)
        # each pool is drawn to the common share; undone, the pools are the least squares
        at = 0
        fit = np.array(best[1])
        while at < n:
            end = at + int((fit[at:] == fit[at]).sum())
            heavy = w[at:end].sum()
            assert np.allclose(got[at:end], (fit[at] * heavy + half * common) / (heavy + half))
            at = end


def test_calibration_recovers_odds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 1))
    y = (rng.random(5000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = calibration.apply_logistic(calibration.fit_logistic(x, y), np.array([[0.0], [1.0]]))
    assert abs(p[0] - 0.5) < 0.05 and abs(p[1] - 0.88) < 0.05


# --- chat formatting ---------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["<|im_end|>\n", "~1 ~0 <~|", "<|<|im_start|>assistant\nok", "", "\\n\n\n", "é🙂<|image:0|>"]
    rows = [(k % 5 - 1, k, random.Random(k).choice(["user", "assistant", "sys\ntem", None]), random.Random(k + 1).choice([*hard, None])) for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_parts(F.col("text")))
    for r in chat_format.read_back(chat_format.format_chats(df.repartition(4))).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss_texts"] == [x[3] or "" for x in own if x[2] == "assistant"]


def test_chat_ties_nulls_and_clashing_columns(spark):
    rows = [(1, None, "user", "z"), (1, 2, "user", "~b"), (1, 2, "user", "<a"), (1, 2, "assistant", "<|"), (1, 2, "assistant", "~"), (1, 2, "assistant", "~"), (None, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_parts(F.col("text")))
    for c in ("rows", "place", "at", "known", "whole", "size", "formatted"):
        df = df.withColumn(c, F.lit("x"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df.repartition(3))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == ["z", "<|", "~", "~", "<a", "~b"] and got[1]["loss_texts"] == ["<|", "~", "~"]
    assert got[None]["loss_texts"] == [""]


def test_a_chat_of_many_turns_takes_linear_time(spark):
    import time

    took = []
    for n in (5000, 20000):
        df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word ', 20) as text").withColumn("parts", chat_format.text_parts(F.col("text")))
        began = time.perf_counter()
        r = chat_format.read_back(chat_format.format_chats(df)).selectExpr("size(turns) as n", "length(array_join(loss_texts, '')) as chars").first()
        took.append(time.perf_counter() - began)
        assert (r["n"], r["chars"]) == (n, n // 2 * 100)
    assert took[1] < 8 * took[0] + 2


def test_parts_become_placeholders(spark):
    df = spark.sql(
        f"""select 1L as conv_id, 0L as turn, 'user' as role, cast(array(
          named_struct('type','text','text','see <|image:9|>','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
          named_struct('type','image','text',null,'ref','a.png','width',57,'height',28,'seconds',null,'pages',null),
          named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',1.5,'pages',null),
          named_struct('type','odd','text',null,'ref','c','width',null,'height',null,'seconds',null,'pages',2)) as array<{chat_format.PART}>) as parts
        union all select 2L, 0L, 'user', cast(null as array<{chat_format.PART}>)"""
    )
    got = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert got[1]["formatted"] == "<|im_start|>user\nsee ~1image:9|><|image:1|><|audio:2|><|document:3|><|im_end|>\n"
    assert [(a["part"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(1, "a.png", 3), (2, "b.wav", 38), (3, "c", 512)]
    assert got[1]["expanded_tokens"] == 553 and got[2]["formatted"] == "<|im_start|>user\n<|im_end|>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0


# --- WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 20 + "é\n\n"
    rows = [(9, "u", big), (3, "u\r\nX: y", big), (3, "u", big), (5, None, None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", big), (11, "u", "\r\n" * 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    got = warc.archive_pages(df, records_per_file=2).collect()
    assert len(got) == len(rows)
    for r in got:
        html = {i: h for i, _, h in rows}[r["page_id"]] or ""
        again = html == big and r["page_id"] != 3
        want = (len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", 3 if again else None)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archive_headers_say_when_they_were_written(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    rows = warc.headers(spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "a" * 200)], "page_id long, url string, html string"))
    records = warc.resolve(rows, warc.originals(rows))
    began = datetime.now(timezone.utc) - timedelta(seconds=1)
    for name, given in (("now", {}), ("then", {"date": "2020-02-03T04:05:06Z"})):
        warc.write_archives(records, str(tmp_path / name), **given)
        dates = {r["warc_date"] for r in warc.read_archives(spark, str(tmp_path / name)).collect()}
        if given:
            assert dates == {given["date"]}
        else:
            (one,) = dates
            assert began <= datetime.strptime(one, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc) <= datetime.now(timezone.utc)


def test_warc_of_many_originals_and_large_pages(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["x" * 120 + str(k) * rng.randrange(1, 4000) for k in range(30)]
    rows = [(k, "u", rng.choice(texts)) for k in range(80)] + [(None, "u", None), (200, None, texts[0]), (200, None, texts[0]), (201, "u", "long " * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    take = lambda **o: warc.archive_pages(df, **o).drop("record_id")
    plain = sorted(map(str, take().collect()))
    monkeypatch.setattr(warc, "FEW", 0)
    assert sorted(map(str, take().collect())) == plain == sorted(map(str, take(large=3000, file_bytes=5000).collect()))
    ids = [r["record_id"] for r in warc.archive_pages(df).collect()]
    assert len(set(ids)) == len(ids) - 1  # the page captured twice keeps its id


def test_warc_parser_on_members_and_faults():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    content = gzip.compress(record) + gzip.compress(record * 2)
    got = list(warc.parse_records(warc._unzip(content, 7)))
    assert [(f["warc-type"], b) for f, b in got] == [("response", b"ab\r\nc")] * 3
    for bad in (record[:-8], b"WARC/1.1\r\nContent", b"HTTP/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(iter([bad])))


# --- toxicity ----------------------------------------------------------------------------------------


def disguise(word, rng):
    way = rng.randrange(4)
    if way == 0:
        return " ".join(word)
    if way == 1:
        return "".join({"o": "0", "i": "1", "e": "3", "a": "@", "s": "$"}.get(c, c) for c in word)
    if way == 2:
        return word[0] + word[1] * 4 + word[2:]
    return ".".join(word)


def test_disguised_words_are_restored(spark, odd):
    rng = random.Random(3)
    toxic = ["idiot", "moron", "loser", "stupid", "pathetic"]
    rows = []
    for k in range(600):
        w = sentence(rng, "en", 50).split()
        if k % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(toxic) if k < 300 else disguise(rng.choice(toxic), rng))
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows if k < 300] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.restore(["You M0R0N, i d i o t and st.up.id or loooser"], model["logp"])[0].split()[-4:] and "moron" in toxicity.restore(["you m0r0n"], model["logp"])[0].split()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    plain = [(got[k] >= 0.7) == bool(t) for k, _, t in rows if k < 300]
    hidden = [(got[k] >= 0.7) == bool(t) for k, _, t in rows if k >= 300]
    assert all(plain) and sum(hidden) >= 0.95 * len(hidden)
    scores = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    none = toxicity.fit(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}


def test_scores_equal_a_plain_recomputation_from_the_lexicon(spark, odd):
    """Every score from the words of the restored text, one at a time."""
    rng = random.Random(13)
    rows = [(k, sentence(rng, "en", 30) + (" you idiot m0ron stupidest" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(120)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model["keys"].tolist(), model["weights"].tolist(), strict=True))
    every = docs.unionByName(odd.select("doc_id", "text"))
    for text, got in zip([r["text"] for r in every.collect()], [r["score"] for r in toxicity.score(every, model, ("text",)).collect()], strict=True):
        restored = toxicity.restore([text], model["logp"])[0].encode()
        found = set()
        for word in re.findall(rb"[a-z\x80-\xff]+", restored):
            data = np.frombuffer(word, np.uint8)
            found.add(int(common.span_hash(data, np.array([0]), np.array([len(word)]))[0]))
            for n in toxicity.PREFIXES:
                if len(word) > n:
                    data = np.frombuffer(word[:n], np.uint8)
                    found.add(int(common.span_hash(data, np.array([0]), np.array([n]))[0]) ^ (0x5BD1E995 * n))
        own = sorted((weight[f] for f in found if f in weight), reverse=True)
        x = np.array([[max([0.0, *own]), sum(own[:3]), math.log1p(sum(w > 1.5 for w in own))]])
        assert math.isclose(got, float(calibration.apply_logistic(model["calibration"], x)[0]), abs_tol=1e-9)


def test_long_and_neighbouring_disguises_are_restored():
    rng = random.Random(4)
    words = [*WORDS["en"], *WORDS["de"], "you", "are", "stupid", "really", "person", "such", "idiot", "a"]
    text = "\n\n" + " ".join(rng.choice(words) for _ in range(20000))
    c = toxicity.classes(text)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = np.concatenate(([0, 0], c[keep], [0]))
    logp = toxicity.language_model(np.bincount((c[:-2] * toxicity.SIZE + c[1:-1]) * toxicity.SIZE + c[2:], minlength=toxicity.SIZE**3))
    long = " ".join("youarereallysuchapersonbecausethewaterwaswithamountainandyouarestupidbecauseofthehouse")
    cases = {long: "stupid", "a s t u p i d": "stupid", "x st" + "u" * 60 + "pid": "stupid", "you_are_a_really_such_a_person_and_that_was_st.up.id": "stupid", "f l u ß": "fluß", "s ! l l y s t u p i d": "stupid"}
    got = toxicity.restore(list(cases), logp)
    for (case, word), forms in zip(cases.items(), got, strict=True):
        assert word in forms[len(case) :].split(), (case, forms)
    assert toxicity.disguised(*(lambda d: (d, *common.word_spans(d)))(np.frombuffer("д у р а к".encode(), np.uint8)))[1].tolist() == [[0, 5]]
    # a run ends with its text, a token of any length ends
    assert toxicity.restore(["a b", "c d"], logp) == ["a b", "c d"] and len(toxicity.restore(["x1" * 3000 + "a" * 9000], logp)) == 1


def test_signs_of_all_kinds_are_read():
    rng = random.Random(4)
    words = [*WORDS["en"], "you", "are", "shell", "really", "person", "idiot", "morons", "shit", "moron"]
    c = toxicity.classes(" ".join(rng.choice(words) for _ in range(20000)))
    c = np.concatenate(([0, 0], c, [0]))
    logp = toxicity.language_model(np.bincount((c[:-2] * toxicity.SIZE + c[1:-1]) * toxicity.SIZE + c[2:], minlength=toxicity.SIZE**3))
    cases = {"sh€££": "shell", "idio+": "idiot", "shi+!": "shit", "m0r0n$.": "morons", "ｉｄｉｏｔ": "idiot", "𝐢𝐝𝟏𝐨𝐭": "idiot", "id" + "i" * 200 + "ot": "idiot", "p€rson": "person"}
    for (case, word), forms in zip(cases.items(), toxicity.restore(list(cases), logp), strict=True):
        assert word in forms.split(), (case, forms)
    assert toxicity.restore(["p\x01rson"], logp) == ["p\x01rson"]
    # a run of one sign may be read as itself, however long, and plain words stay as they are
    assert toxicity.lattice("a" * 300)[0][-1] == ("a" * 300, 0.0)
    assert toxicity.restore(["you are! really 50 € ok", None], logp) == ["you are! really 50 € ok", ""]


def test_settled_readings_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    logp = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE)))
    tokens = ["".join(rng.choice(list("abc01!*€$|")) for _ in range(200)) for _ in range(6)]
    whole = [[toxicity.decode(t, logp, b) for b in (False, True)] for t in tokens]
    for settle in (1, 7):
        monkeypatch.setattr(toxicity, "SETTLE", settle)  # no worker takes part
        assert [[toxicity.decode(t, logp, b) for b in (False, True)] for t in tokens] == whole


def test_decoder_equals_all_readings():
    import itertools

    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE)))
    for token in ("m0r0n", "looo1", "a*b", "1d!0t", "x--y"):
        best = max(
            (sum(-c for _, c in path) + score(logp, "".join(t for t, _ in path)), "".join(t for t, _ in path)) for path in itertools.product(*toxicity.lattice(token))
        )
        assert toxicity.decode(token, logp) == best[1]


def score(logp, word):
    a = b = 0
    total = 0.0
    for c in [*toxicity.classes(word).tolist(), 0]:
        total += logp[a, b, c]
        a, b = b, c
    return total


# --- packing -------------------------------------------------------------------------------------------


def brute_best_fit(lengths, context):
    rows = []
    for n in sorted(lengths, reverse=True):
        open_rows = [r for r in rows if sum(r) + n <= context]
        (max(open_rows, key=sum) if open_rows else (rows.append([]), rows[-1])[1]).append(n)
    return rows


def test_best_fit_decreasing():
    rng = random.Random(1)
    for context in (5, 64, 100):
        lengths = [rng.randrange(1, context + 1) for _ in range(200)]
        got = packing.best_fit_decreasing(lengths, context)
        assert sorted(k for r in got for k in r) == list(range(200))
        # rows of equal remaining capacity are interchangeable, so sums are compared
        assert sorted(sum(lengths[k] for k in r) for r in got) == sorted(map(sum, brute_best_fit(lengths, context)))


def test_packing_is_lossless(spark, odd):
    vocabulary = packing.load_vocabulary()
    tokenizer = packing.Tokenizer(vocabulary)
    packed = packing.pack(odd, vocabulary, context=128, set_tokens=4000)
    for r in packed.collect():
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == len(positions) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128 and len(r["doc_ids"]) == r["n_segments"]
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
    parts = {}
    for r in packing.segments(packed).collect():
        parts.setdefault(r["doc_id"], []).append((r["doc_offset"], np.frombuffer(r["ids"], "<u2")))
    want, times = {r["doc_id"]: r["text"] or "" for r in odd.select("doc_id", "text").collect()}, Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert times[6] == 2
    for k, text in want.items():
        by_offset = {}
        for at, ids in parts[k]:
            by_offset.setdefault(at, []).append(ids.tolist())
        # a repeated row is packed as often as it occurs, each segment of it equally
        assert all(len(x) == times[k] and x == x[:1] * times[k] for x in by_offset.values())
        ids = np.concatenate([np.array(by_offset[at][0]) for at in sorted(by_offset)])
        assert ids[-1] == tokenizer.end and tokenizer.decode(ids) == text
    assert packing.pack(odd.limit(0), vocabulary).count() == 0


def test_packed_rows_do_not_depend_on_the_split(spark, monkeypatch):
    """Rows, repeated ones in many shards too, against the plain algorithm shard by shard."""
    vocabulary = packing.load_vocabulary()
    tokenizer = packing.Tokenizer(vocabulary)
    rng = random.Random(8)
    rows = [(k % 150, sentence(rng, "en", rng.randrange(0, 90))) for k in range(300)] + [(None, "again and again")] * 200 + [(5, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    take = lambda d: packing.pack(d, vocabulary, context=64, shard_chars=2000).drop("positions")
    a, b = (sorted(map(str, take(d).collect())) for d in (df, df.repartition(7)))
    assert a == b
    with monkeypatch.context() as m:
        m.setattr(packing, "FEW", 0)
        assert sorted(map(str, take(df).collect())) == a
    dealt = packing.shards(df, 2000).collect()
    assert len({r["shard"] for r in dealt if r["doc_id"] is None}) >= 2 and sum(r["copies"] for r in dealt) == len(rows)
    got = Counter((r["shard"], r["n_tokens"]) for r in take(df).collect())
    want = Counter()
    for shard in {r["shard"] for r in dealt}:
        lengths = []
        for r in (x for x in dealt if x["shard"] == shard):
            n = len(tokenizer.encode(r["text"]))
            lengths += [min(64, n - at) for _ in range(r["copies"]) for at in range(0, n, 64)]
        want.update((shard, sum(x)) for x in brute_best_fit(lengths, 64))
    assert got == want


def test_long_texts_tokenise_in_pieces():
    tokenizer = packing.Tokenizer(packing.load_vocabulary())
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdé1 .\n'") for _ in range(9)) for _ in range(3000))
    whole = tokenizer.encoding.encode_ordinary(text)
    got = [i for p in packing.cut(text, 500) for i in tokenizer.encoding.encode_ordinary(p)]
    assert got == whole and "".join(packing.cut(text, 500)) == text


# --- shared pieces and the pipeline ------------------------------------------------------------------------


def test_hashes_depend_on_the_span_alone():
    data, offsets = common.join_texts(["ab cd", None, "cd ab"])
    starts, ends = common.word_spans(data)
    h = common.span_hash(data, starts, ends)
    assert len(h) == 4 and h[0] == h[3] and h[1] == h[2] and h[0] != h[1] and offsets.tolist() == [0, 6, 7, 13]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialise(stage(spark, before, str(tmp_path)), name)
        assert after.columns == docs.columns and after.count() > 0
        before = after
    written = len(common._written)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = Counter(r["doc_id"] for r in before.collect())
    assert Counter(d for r in packed for d, at in zip(r["doc_ids"], r["doc_offsets"], strict=True) if at == 0) == kept
    # only the last stage's input and the heads of its documents are still there
    assert len(common._written) - written <= 2


def test_each_stage_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    lettered = {(r["doc_id"], r["text"]) for r in odd.collect() if any(c.isalpha() for c in r["text"] or "")}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
        got = stage(spark, odd, str(tmp_path))
        if name == "token_packing":
            assert sorted((d is None, d or 0) for r in got.collect() for d, at in zip(r["doc_ids"], r["doc_offsets"], strict=True) if at == 0) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect())
            continue
        assert got.columns == odd.columns
        rows = Counter((r["doc_id"], r["text"]) for r in got.collect())
        if name == "language_id":
            assert set(rows) == lettered and rows[[k for k in rows if k[0] == 6][0]] == 2
            unlabelled = stage(spark, odd.withColumn("lang", F.lit(None).cast("string")), str(tmp_path))
            assert {(r["doc_id"], r["text"]) for r in unlabelled.collect()} == lettered
        elif name == "ngram_jaccard_join":
            assert set(rows) == {(r["doc_id"], r["text"]) for r in odd.collect()} and max(rows.values()) == 1
        elif name == "benchmark_decontamination":
            assert rows == Counter((r["doc_id"], r["text"]) for r in odd.collect())
        else:
            assert set(rows) <= {(r["doc_id"], r["text"]) for r in odd.collect() if (r["text"] or "").split()}


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        def __init__(self, folder, master):
            self.conf, self.sparkContext = self, self
            self.folder, self.master = folder, master

        def get(self, name, default):
            return self.folder if name == "spark.checkpoint.dir" else default

    assert common.scratch_dir(Session("hdfs:/x/", "yarn")) == "hdfs:/x" and common.scratch_dir(Session(None, "local[2]")) == common.LOCAL_SCRATCH
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.scratch_dir(Session(None, "spark://host:7077"))


def test_latent_space_of_all_passages(spark, monkeypatch):
    """products of words are those of every passage, whatever their number and however little is held."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 90))) for _ in range(2300)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3)
    index = decontaminate.Index(decontaminate.query_passages([(k, " ".join(rng.choice(words[:40], 12)), None) for k in range(8)]))
    index.weigh(np.arange(len(index.vocabulary)) % 7 + 1, 5000)
    hashes, first = decontaminate.word_hashes(texts)
    block, start = decontaminate.blocks_of(first, decontaminate.WINDOW)
    term = index.terms(hashes)
    use = term >= 0
    a = np.zeros((int(start[-1]), len(index.vocabulary)))
    np.add.at(a, (block[use], term[use]), index.idf[term[use]])
    norm = np.zeros(len(a))
    np.add.at(norm, block[use], index.idf[term[use]].astype(float) ** 2)
    a = a[norm > 0] / np.sqrt(norm[norm > 0])[:, None]
    monkeypatch.setattr(decontaminate, "PAIRS", 500)
    got = {r["pair"]: r["value"] for r in decontaminate.products(docs, [index]).collect()}
    assert got.pop(-1) == len(a)
    want = a.T @ a
    assert all(abs(want[divmod(p, len(want))] - v) < 1e-3 for p, v in got.items()) and len(got) == np.count_nonzero(np.triu(want))
    basis = np.linalg.qr(rng.standard_normal((len(want), 5)))[0]
    table = pa.RecordBatch.from_arrays([pa.array([0] * len(got), pa.int32()), pa.array(list(got), pa.int64()), pa.array(list(got.values()))], names=["part", "pair", "value"])
    (out,) = decontaminate._times(iter([table]), [basis])
    assert np.allclose(np.frombuffer(out.column(1)[0].as_py())[:-1].reshape(basis.shape), want @ basis, atol=1e-2)


def test_products_travel_in_runs():
    """The sums of pairs go to their band as runs, not row by row; words are found as by plain search."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(200)]
    index = decontaminate.Index(decontaminate.query_passages([(k, " ".join(rng.choice(words[:300], 40)), None) for k in range(8)]))
    index.weigh(np.ones(len(index.vocabulary)), 5000)
    hashes = decontaminate.word_hashes(texts)[0]
    place, term = decontaminate.held_words(index.vocabulary, index.begun, hashes)
    assert place.tolist() == np.flatnonzero(np.isin(hashes, index.vocabulary)).tolist() and (index.vocabulary[term] == hashes[place]).all()
    sent = list(decontaminate._pairs(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]), [index]))
    pairs = sum(b.num_rows for b in decontaminate._add_runs(iter(sent)))
    assert sum(b.num_rows for b in sent) <= decontaminate.BANDS < pairs
