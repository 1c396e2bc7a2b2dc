"""Near duplicates, decontamination, toxicity and language, against brute force and planted cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, language_id, near_dedup, toxicity_chain
from fathomline.llm.words import shingles, word_hashes

DRAW = random.Random(11)
WORDS = ["".join(DRAW.choice("abcdefghij") for _ in range(DRAW.randint(2, 7))) for _ in range(400)]


def prose(n, draw=DRAW):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, key string, bands double")


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute_groups(texts, ids, size, num, den):
    sets, parent = [shingle_set(t, size) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[a if ids[a] > ids[b] else b] = b if ids[a] > ids[b] else a
    return {ids[i]: (len(sets[i]), ids[root(i)]) for i in range(len(texts))}


def edited(text, edits, draw):
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = draw.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, num):
    draw = random.Random(size)
    base = prose(120, draw)
    texts = [edited(base, draw.randint(0, 14), draw) for _ in range(60)]  # a chain of near copies, some linked only through others
    texts += [prose(draw.randint(1, 80), draw) for _ in range(60)]
    texts += [edited(texts[70], 1, draw), texts[71].upper(), texts[71], None, "", " \n\t ", "two words", "TWO  words", "one"]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    want = brute_groups(texts, ids, size, num, 100)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts, ids), size, num, 100).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    draw = random.Random(5)
    base = prose(100, draw)
    texts = [edited(base, draw.randint(0, 9), draw) for _ in range(50)]
    ids = list(range(50))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert got == brute_groups(texts, ids, 3, 85, 100)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    got = near_dedup.near_duplicates(docs_of(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [1, 1, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("None", "None", True)]
    kept = near_dedup.keep_one(docs_of(spark, ["a b c d e f", "a b c d e f", "other words stand here now", None], [1, 1, 2, 3]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == ["doc_id", "text", "key", "bands"]


def test_super_minhash_estimates_similarity():
    a, b = prose(300), prose(300)
    text = a + " " + b
    h, ends = word_hashes(pa.array([text, a, text]))
    element, ends = shingles(h, ends, 3)
    s = near_dedup.super_minhash(element, ends, 128)
    x, y = set(element[ends[0] : ends[1]].tolist()), set(element[ends[1] : ends[2]].tolist())
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.15
    assert sorted((s >> np.uint64(32)).max(axis=1).tolist())[-1] < 128


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 901)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in near_dedup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[901] == 900


def benchmark(spark):
    draw = random.Random(21)
    items = [prose(40, draw), prose(25, draw), "only four words here", None, "..."]
    return items, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


@pytest.mark.parametrize("ship_bytes", [1 << 20, 0])
def test_leaks_are_found_whole_and_reordered(spark, ship_bytes):
    items, bench = benchmark(spark)
    w = items[0].split()
    draw = random.Random(4)
    texts = [
        prose(50, draw) + " " + items[0] + ". " + prose(50, draw), prose(20, draw) + " ".join([""] + w[20:] + ["between", "them"] + w[:20]), items[0].upper(), " ".join(w[:12]) + " " + prose(60, draw),
        prose(200, draw), "said: ONLY four words, here!", None, "", items[1] + " " + items[0],
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(docs_of(spark, texts), bench, ship_bytes=ship_bytes).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 0), (5, 2), (8, 0), (8, 1)}
    assert got[0, 0].coverage == 1.0 and got[0, 0].tiles == 1 and got[1, 0].tiles == 2 and got[1, 0].covered == 40
    stay = decontaminate.clean(docs_of(spark, texts), bench, ship_bytes=ship_bytes)
    assert sorted(r.doc_id for r in stay.collect()) == [3, 4, 6, 7] and stay.columns == ["doc_id", "text", "key", "bands"]


def test_tiles_equal_a_plain_search():
    draw = random.Random(8)
    for _ in range(60):
        doc, item = ([draw.randrange(4) for _ in range(n)] for n in (40, 25))
        tiles = decontaminate.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 4)
        seen_d, seen_i = set(), set()
        for d, i, n in tiles:
            assert doc[d : d + n] == item[i : i + n] and n >= 4
            assert not seen_d & {*range(d, d + n)} and not seen_i & {*range(i, i + n)}
            seen_d |= {*range(d, d + n)}
            seen_i |= {*range(i, i + n)}
        longest = max((n for d in range(40) for i in range(25) for n in range(4, 26) if d + n <= 40 and i + n <= 25 and doc[d : d + n] == item[i : i + n]), default=0)
        assert (tiles[0][2] if tiles else 0) == longest
        assert [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)


def test_decontamination_of_nothing(spark):
    _, bench = benchmark(spark)
    assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0
    assert decontaminate.clean(docs_of(spark, ["a"]), bench.limit(0)).count() == 1


def labelled(spark):
    draw = random.Random(31)
    rows, labels = [], []
    for i in range(400):
        toxic, poor = i % 5 == 0, i % 4 == 0
        text = prose(60, draw) + (" you vile rotten scoundrel" if toxic else "") + (" junk junkier" if poor else "")
        rows.append((i, text, "p", 0))
        labels.append((i, 0 if poor else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, p_toxic string, y0 int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_learns_and_keeps_the_clean(spark):
    docs, labels = labelled(spark)
    chain = toxicity_chain.train(docs, labels, ["low_quality=1 - quality", "toxic"])
    assert [x.name for x in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    rows = {r.doc_id: r for r in toxicity_chain.predict(docs, chain).collect()}
    assert sum((r.p_toxic >= chain.links[1].threshold) == (i % 5 == 0) for i, r in rows.items()) == 400
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a VILE rotten scoundrel"), (3, "a vile rotten scoundrel"), (4, "x " * 100000)], "doc_id long, text string")
    p = {(r.doc_id): r.p_toxic for r in toxicity_chain.predict(odd, chain).collect()}
    assert p[1] == p[2] == 0.0 and p[3] > 0.5
    assert {r.doc_id for r in toxicity_chain.keep_clean(docs, chain).collect()} == {i for i in range(400) if i % 5}


def test_chain_without_labels(spark):
    docs, labels = labelled(spark)
    chain = toxicity_chain.train(docs, labels.limit(0), ["toxic"])
    assert toxicity_chain.predict(docs.limit(2), chain).where("p_toxic < 0.01").count() == 2
    one = toxicity_chain.train(docs, labels.withColumn("toxic", F.lit(0)), ["toxic"])
    assert toxicity_chain.keep_clean(docs, one).count() == 400


def speech(lang, n, draw):
    parts = {"aa": ["tha", "ing", "and", "oth", "ere"], "bb": ["eau", "oux", "ent", "que", "ille"], "cc": ["sch", "ung", "heit", "ein", "zu"]}[lang]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(n))


def spoken(spark):
    draw = random.Random(2)
    return spark.createDataFrame([(i, speech(("aa", "bb", "cc")[i % 3], 40, draw), ("aa", "bb", "cc")[i % 3], 1) for i in range(300)], "doc_id long, text string, lang string, score int")


def test_languages_on_held_out_texts(spark):
    docs = spoken(spark)
    out = language_id.held_out(docs)
    model = language_id.train(docs.where(~out))
    found = language_id.identify(docs.where(out), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert found and all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 4"), (4, "日本語"), (5, "eau " * 50000), (5, "eau " * 50000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, r.score > 0) for r in language_id.identify(odd, model).collect())
    assert got[:3] == [(1, "und", False), (2, "und", False), (3, "und", False)] and got[3][1] in ("aa", "bb", "cc") and got[4] == got[5] == (5, "bb", True)
    assert {r.doc_id for r in language_id.keep_known(odd, model).collect()} == {4, 5}


def test_filters_return_all_languages_of_a_gram():
    grams = np.array([11, 22, 33], np.uint64)
    model = language_id.build(["a", "b"], "a", {"a": grams[:2], "b": grams[1:]}, slot_bits=16)
    first, second = language_id._places(grams, 16)
    assert (model.slots[first] & model.slots[second])[:, 0].tolist() == [1, 3, 2]


def test_languages_of_nothing(spark):
    docs = spoken(spark)
    model = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), model).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.train(docs)).count() == 0


def test_rows_that_repeat_an_id_with_other_texts(spark):
    draw = random.Random(9)
    x, y = prose(40, draw), prose(90, draw)
    near_x, near_y = x + " tail", y + " tail"
    # id 5 stands over two texts; each is linked with another document, one of a smaller id and one of a larger
    docs = docs_of(spark, [x, y, near_x, near_y, y + " tail more"], [5, 5, 3, 8, 5])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 3, 85).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (8, 5, False)]
    stay = sorted((r.doc_id, r.text) for r in near_dedup.keep_one(docs, 3, 85).collect())
    assert stay == [(3, near_x), (5, y)]
    apart = docs_of(spark, [x, y, x, None, "", None], [5, 5, 5, 7, 7, None])
    assert sorted(str((r.doc_id, r.text)) for r in near_dedup.keep_one(apart, 3, 85).collect()) == sorted(str(p) for p in [(5, x), (5, y), (7, None), (None, None)])


def test_blocks_are_cut_by_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    draw = random.Random(6)
    base = prose(100, draw)
    texts = [edited(base, draw.randint(0, 9), draw) for _ in range(30)] + [" ".join(prose(20_000, draw).split()) + " end"] * 2
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert got == brute_groups(texts, list(range(32)), 3, 85, 100)


def plain_tiles(doc, item, least):
    """Greedy string tiling by comparing every pair of places: longest first; of equal ones, by place in doc, then in item."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n >= least:
                    best.append((-n, d, i))
        if not best:
            return tiles
        top = min(best)[0]
        for n, d, i in sorted(b for b in best if b[0] == top):
            if not used_d & {*range(d, d - n)} and not used_i & {*range(i, i - n)}:
                used_d |= {*range(d, d - n)}
                used_i |= {*range(i, i - n)}
                tiles.append((d, i, -n))


def test_tilings_equal_brute_force():
    draw = random.Random(18)
    for _ in range(80):
        doc, item = ([draw.randrange(5) for _ in range(n)] for n in (60, 40))
        assert decontaminate.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3) == plain_tiles(doc, item, 3)


def folded(text):
    return [w for w in (w.lower().strip(".,;:!?\"'()[]{}*#$%&|") for w in re.split(r"[\x20\x09-\x0D]+", text or "")) if w]


@pytest.mark.parametrize("ship_bytes", [1 << 20, 0])
def test_contamination_equals_brute_force_on_odd_rows(spark, ship_bytes):
    items, bench = benchmark(spark)
    draw = random.Random(40)
    pool = [w for t in items[:3] for w in t.split()]

    def mixed():
        parts = []
        for _ in range(draw.randint(1, 8)):
            at = draw.randrange(len(pool))
            parts += pool[at : at + draw.randint(1, 18)] if draw.random() < 0.7 else prose(draw.randint(1, 9), draw).split()
        return " ".join(parts)

    texts = [mixed() for _ in range(40)] + [None, "", items[0] + " " + prose(60_000, draw) + " " + items[1], items[0], prose(30, draw), items[1], "?!"]
    ids = [i % 9 if i % 4 else None for i in range(len(texts))]  # repeated and null ids, clean and not
    want, stay = [], []
    for i, t in zip(ids, texts, strict=True):
        found = []
        for k, item in enumerate(items):
            doc, tokens = folded(t), folded(item)
            if tokens and (len(doc) < 5000 or k < 2):
                covered = 40 if len(doc) > 5000 and k == 0 else 25 if len(doc) > 5000 else sum(n for *_, n in plain_tiles(doc, tokens, min(5, len(tokens))))
                if covered / len(tokens) >= 0.5:
                    found.append((i, k, covered, len(tokens)))
        want += found
        if not found:
            stay.append((i, t))
    docs = docs_of(spark, texts, ids)
    got = [(r.doc_id, r.item_id, r.covered, r.item_tokens) for r in decontaminate.contamination(docs, bench, ship_bytes=ship_bytes).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 15
    left = [(r.doc_id, r.text) for r in decontaminate.clean(docs, bench, ship_bytes=ship_bytes).collect()]
    assert sorted(map(str, left)) == sorted(map(str, stay)) and None in {i for i, _ in stay}


def test_chain_on_unseen_documents_and_repeated_ids(spark):
    docs, labels = labelled(spark)
    seen, unseen = docs.where("doc_id % 4 < 2"), docs.where("doc_id % 4 >= 2")
    repeated = seen.union(seen.where("doc_id = 0").withColumn("text", F.lit("zzz"))).union(seen.where("doc_id = 1"))
    chain = toxicity_chain.train(repeated, labels.union(labels), ["low_quality=1 - quality", "toxic"])
    rows = {r.doc_id: r.p_toxic for r in toxicity_chain.predict(unseen, chain).collect()}
    assert len(rows) == 200 and sum((p >= chain.links[1].threshold) == (i % 5 == 0) for i, p in rows.items()) >= 196
    again = toxicity_chain.train(repeated.repartition(7), labels, ["low_quality=1 - quality", "toxic"])
    assert np.allclose(again.links[1].weights, chain.links[1].weights)


def test_chain_equals_its_plain_form():
    """Applying the links to dense 0/1 word columns gives the same probabilities."""
    draw = np.random.default_rng(5)
    n, words = 300, 30
    x = draw.random((n, words)) < 0.3
    a = (x[:, 0] | x[:, 1]).astype(float)
    b = (x[:, 2] | (a > 0)).astype(float)
    doc, feature = np.nonzero(x)
    links = toxicity_chain.fit_chain(doc, feature, {"a": a, "b": b}, np.arange(n) % 3, 100)
    dense = np.zeros((n, 0))
    for link, want in zip(links, (a, b), strict=True):
        full = np.zeros(words)
        full[link.features] = link.weights
        z = x @ full + (dense @ link.earlier if dense.shape[1] else 0) + link.intercept
        p = toxicity_chain._apply(link, doc, feature, dense, n)
        assert np.allclose(p, 1 / (1 + np.exp(-z))) and ((p >= link.threshold) == (want > 0)).mean() > 0.97
        dense = np.column_stack([dense, toxicity_chain._logit(p)])


def test_languages_equal_exact_sets_of_grams(spark):
    """Predictions by the Bloom filters are those of exact n-gram sets."""
    docs = spoken(spark)
    model = language_id.train(docs)
    held = {}
    for r in docs.collect():
        raw = language_id._FOLD[np.frombuffer(r.text.encode(), np.uint8)]
        for order in language_id.ORDERS:
            own = held.setdefault(r.lang, set())
            own |= {int(g) for g in language_id.grams_of(raw, order).tolist() if g != language_id._blank(order)}
    draw = random.Random(77)
    texts = [" ".join([speech("aa", draw.randint(0, 30), draw), speech("bb", draw.randint(0, 30), draw), speech("cc", draw.randint(0, 30), draw)]) for _ in range(60)]
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        raw = language_id._FOLD[np.frombuffer(t.encode(), np.uint8)]
        grams = [g for order in language_id.ORDERS for g in language_id.grams_of(raw, order).tolist() if g != language_id._blank(order)]
        count = {name: sum(g in own for g in grams) for name, own in held.items()}
        first, second = sorted(count.values())[-1], sorted(count.values())[-2]
        if first - second > 0.05 * first:
            assert got[i].lang_pred == max(count, key=count.get) and abs(got[i].score - first / sum(count.values())) < 0.05


def test_language_ties_and_common_texts(spark):
    tied = spark.createDataFrame([(1, "abcabc", "yy"), (2, "abcabc", "xx")], "doc_id long, text string, lang string")
    model = language_id.train(tied)
    assert model.prior == "xx" and language_id.identify(tied, model).select("lang_pred").distinct().first()[0] == "xx"
    common = spark.createDataFrame([(i, "the same text", "aa") for i in range(4000)] + [(9000, "autre chose", "bb")], "doc_id long, text string, lang string")
    model = language_id.train(common, sample_docs=100)
    assert {r.lang_pred for r in language_id.identify(common.where("doc_id in (1, 9000)"), model).collect()} == {"aa", "bb"}
    assert language_id.train(common, most_languages=1).languages == ["aa"]


@pytest.mark.parametrize("words", [1, 2, 3])
def test_tiling_of_a_million_repeated_tokens_takes_seconds(words):
    import time

    draw = np.random.default_rng(words)
    doc, item = draw.integers(0, words, 1_000_000).astype(np.uint64), draw.integers(0, words, 400).astype(np.uint64)
    began = time.time()
    tiles = decontaminate.tile(doc, item, 5)
    assert time.time() - began < 30
    assert all((doc[d : d + n] == item[i : i + n]).all() for d, i, n in tiles) and sum(n for *_, n in tiles) >= (400 if words == 1 else 350)  # gaps shorter than a seed stay


def test_tiling_equals_plain_steps_on_texts_of_few_words():
    draw = np.random.default_rng(11)
    for _ in range(300):
        doc, item = (draw.integers(0, int(draw.integers(1, 4)), int(draw.integers(0, 60))).tolist() for _ in range(2))
        for seed in (1, 2, 5):
            got = decontaminate.tile(np.array(doc, np.uint64), np.array(item, np.uint64), seed)
            assert got == plain_tiles(doc, item, seed)
