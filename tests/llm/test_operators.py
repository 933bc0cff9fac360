"""Each operator against brute force on a small table, and on odd and empty ones."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, hashing_ann, langid, licenses, mixing, neardup, packing, recipes, rotation, suffixes, wrappers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gkey string, size string, row string"


def _rows(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(30, 200))) for _ in range(12)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(70))
    texts = [*base, base[0], base[0], base[1].upper(), "", None, "one two", "one two", "Under the MIT license. CC BY-NC, gnu", f"{base[2]} {passage} tail", f"head {passage} {base[3]}"]
    for k in range(3, 8):
        words = base[k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts.append(" ".join(draw.choice(vocabulary) for _ in range(20000)))
    return [(i, t, "en" if i % 2 else "de", f"s{i % 4}" if i % 5 else None, 0, "x", "y", "z") for i, t in enumerate(texts)] + [(None, base[0], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def test_near_duplicates(docs, empty):
    rows = [r for r in _rows()]
    sets = [_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    expected = sorted((str(r[0]), len(sets[i]), str(rows[find(i)][0])) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.near_duplicates(docs).collect())
    assert got == expected
    assert neardup.near_duplicates(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (5, 5)] + [(20 + i, 21 + i) for i in range(30)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 8, 8: 8} | {i: 20 for i in range(20, 51)}


def test_components_of_odd_tables(spark):
    links = spark.createDataFrame([(1, None), (None, 2), (None, None), (4, 4), (6, 5), (6, 5)], "a long, b long")
    assert {r.node: r.root for r in components.components(links).collect()} == {5: 5, 6: 5}
    assert components.components(links.filter("a > 99")).count() == 0


def test_exact_duplicates(docs, empty):
    got = recipes.exact_duplicates(docs, digest_bytes=1).collect()  # short digests must be noticed and lengthened
    by_text = {}
    for r in _rows():
        by_text.setdefault(r[1] or "", []).append(r[0])
    assert len(got) == len(_rows()) and sum(r.kept for r in got) == len(by_text)
    sizes = {i: (max((x for x in ids if x is not None), default=None), len(ids)) for ids in by_text.values() for i in ids}
    assert all((r.keep_id, r.group_size) == sizes[r.doc_id] for r in got)
    assert recipes.keep_one(docs).count() == len(by_text) and recipes.keep_one(docs).columns == docs.columns
    assert recipes.exact_duplicates(empty).count() == 0


def test_chunks_are_content_defined():
    data = random.Random(3).randbytes(50_000)
    a, b = recipes.chunks(data), recipes.chunks(b"inserted" + data)
    assert b"".join(a) == data and len(set(a) & set(b)) >= len(a) - 2 and max(map(len, a)) <= 16384


def test_repeated_rows_leave_one(spark):
    d = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", None)], "doc_id long, text string, other string")
    assert recipes.keep_one(d).count() == 2
    odd = d.selectExpr("doc_id", "text", "map(other, doc_id) AS __key", "1 AS id", "2 AS sha", "3 AS recipe").filter("other is not null")
    kept = recipes.keep_one(odd)
    assert kept.columns == odd.columns and [tuple(r) for r in kept.collect()] == [(1, "a", {"x": 1}, 1, 2, 3)]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(_rows())
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in _rows())
    targets = {(r.source, r.source_size, r.target) for r in got}
    assert sum(t for _, _, t in targets) == pytest.approx(total) and all(t <= 3 * s for _, s, t in targets)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert sorted((str(r.doc_id), r.copies) for r in mixing.mix(docs).collect()) == sorted((str(r.doc_id), r.copies) for r in got)
    assert mixing.mix(empty).count() == 0


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    row = next(r for r in got.values() if r.n_base)
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (2, 0, 4, "cc-by-nc,mit")
    assert sum(r.n_base > 0 for r in got.values()) == 1 and licenses.scan(empty).count() == 0


def _license_rows(docs):
    """Places of phrases, and spans of the other templates by votes for diagonals, told plainly."""
    out = {}
    for doc_id, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split(licenses.BREAK, lower) if w]
        base, labels, shares = [], set(), [0.0]
        for t in licenses.BASE:
            p = t.words.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            base += [(i, t.label) for i in at]
            shares += [1.0] * bool(at)
        for t in licenses.NOTICES:
            p = t.words.split()
            votes = {}
            for i in range(len(words) - 2):
                for j in range(len(p) - 2):
                    if words[i : i + 3] == p[j : j + 3]:
                        votes.setdefault(i - j, set()).add(j)
            groups = []
            for d in sorted(votes):
                if groups and d - groups[-1][-1] <= 3:
                    groups[-1].append(d)
                else:
                    groups.append([d])
            for g in groups:
                share = len(set().union(*(votes[d] for d in g))) / (len(p) - 2)
                span = max(d + max(votes[d]) + 3 for d in g) - min(d + min(votes[d]) for d in g)
                shares.append(share)
                if share >= t.least and span <= 1.5 * len(p):
                    labels.add(t.label)
        places = [i for i, _ in base]
        found = {label for _, label in base}
        out[doc_id] = (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(found | labels)), max(shares))
    return out


def test_licenses_against_brute_force(spark):
    draw = random.Random(12)
    fill = lambda n: " ".join(draw.choice(["the", "license", "Under", "MIT", "cc", "by", "nc", "version", "2", "word", "of", "licensed", "apache"]) for _ in range(n))
    rows = []
    for i in range(120):
        parts = [fill(draw.randrange(12))]
        for _ in range(draw.randrange(4)):
            words = draw.choice(licenses.BASE + licenses.NOTICES).words.split()
            for _ in range(draw.choice([0, 0, 1, 3])):
                k = draw.randrange(len(words))
                words = draw.choice([[*words[:k], "extra", *words[k:]], [*words[:k], *words[k + 1 :]], [*words[:k], "other", *words[k + 1 :]]])
            parts += [draw.choice([" ", "-", ".\n"]).join(words).title(), fill(draw.randrange(9))]
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "CC-BY-NC " * 3000), (503, "\u212aey MIT licen\u0130se under the m\u0131t license"), (504, rows[0][1])]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, row string, hash int, template int").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, pytest.approx(r.score)) for r in licenses.scan(d).collect()}
    expected = _license_rows(rows)
    assert {k: v[:6] for k, v in got.items()} == {k: v[:6] for k, v in expected.items()}
    assert all(got[k][6] == v[6] for k, v in expected.items())
    assert sum("," in v[5] for v in expected.values()) > 5 and expected[502][1] == 3000


def test_license_notice_with_a_word_put_in(spark):
    notice = licenses.NOTICES[0].words.replace("any person", "any other person")
    row = licenses.scan(spark.createDataFrame([(1, notice)], "doc_id long, text string")).first()
    assert row.labels == "mit" and 0.8 <= row.score < 1 and row.n_base == 0


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeated_passages(docs, empty, hot):
    words = {r[0]: (r[1] or "").split() for r in _rows()}
    holders = {}
    for k, w in words.items():
        for i in range(len(w) - 49):
            holders.setdefault(tuple(w[i : i + 50]), set()).add(k)
    expected = {(k, j) for k, w in words.items() for i in range(len(w) - 49) if len(holders[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}
    got = {(r.doc_id, j) for r in suffixes.repeated_passages(docs, hot_places=hot).collect() for j in range(r.start_word, r.start_word + r.n_words)}
    assert got == expected
    assert suffixes.repeated_passages(empty, hot_places=hot).count() == 0


def test_a_hot_anchor_over_many_ranges(spark):
    """Sorted over many tasks, places find what they find in one: also where the rows of one document (or of none)
    follow each other across ranges."""
    draw = random.Random(3)
    side = lambda n: b"".join(bytes([0, 0, 0, draw.choice((1, 1, 1, 2))]) for _ in range(n))
    rows = [(draw.choice((7, 7, 8)), draw.choice((0, 0, 0, 1, 2, None, None)), i, side(6), side(6), way) for i in range(400) for way in (0, 1)]
    ways = spark.createDataFrame(rows, "anchor long, doc_id long, place long, left binary, right binary, way int")
    seen = "doc_id long, start long, end long, first boolean, anchor long, left long, right long, noted_left long, noted_right long"

    def found(sorted_rows):
        most = [F.max(c) for c in ("left", "right", "noted_left", "noted_right")]
        matched = sorted_rows.mapInArrow(suffixes._match_rows(8), seen).groupBy("doc_id", "start", "end", "anchor").agg(F.min("first"), *most)
        return {tuple(r) for r in matched.collect()}

    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "60"}
    before = {x: spark.conf.get(x) for x in settings}
    try:
        for x, value in settings.items():
            spark.conf.set(x, value)
        dealt = suffixes._in_ranges(ways)
        parts, split = dealt.select("part").distinct().count(), found(dealt)
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)
    whole = ways.withColumn("part", F.lit(0)).coalesce(1).sortWithinPartitions(*suffixes._order(ways))
    assert parts > 30 and split == found(whole)


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeated_passages_among_decoys(spark, hot):
    """A passage around a common anchor whose holders are neighbours in neither order."""
    draw = random.Random(8)
    new = lambda n: [f"v{draw.randrange(10**6)}" for _ in range(n)]
    mark = lambda w: suffixes.kept_positions(suffixes.words([" ".join(w).encode()], lower=False)[0], 20, 20)[1][0]
    anchor, rows = min((new(20) for _ in range(300)), key=mark), []  # its hash is the least in nearly all windows
    for _ in range(20):
        left, right = new(40), new(60)
        held = [left[-15:], right[:15]]
        texts = [[*new(30), *held[0], *anchor, *held[1], *new(30)] for _ in range(2)]
        for own in texts:  # others share more on one side, too little in all
            p = 45
            texts = [*texts, [*new(50), *own[p : p + 45], *new(30)], [*new(50), *own[p - 29 : p + 20], *new(30)]]
        rows += texts
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    holders = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            holders.setdefault(tuple(w[j : j + 50]), set()).add(i)
    expected = {(i, x) for i, t in rows for j in range(len(t.split()) - 49) if len(holders[tuple(t.split()[j : j + 50])]) > 1 for x in range(j, j + 50)}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, j) for r in suffixes.repeated_passages(d, hot_places=hot).collect() for j in range(r.start_word, r.start_word + r.n_words)}
    assert expected and got == expected


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    full = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    ids = {r[0]: np.array([*full.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in _rows()}
    by_doc, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, ends in [(by_doc, {k: len(v) for k, v in ids.items()}), (by_sequence, None)]:
        for k, v in pieces.items():
            at = 0
            for a, n in sorted(v):
                assert a == at
                at += n
            assert at == ends[k] if ends else at <= 1024
    assert packing.pack(empty, path).count() == 0


def test_windows_fill_when_they_can():
    assert packing.plan_windows({600: 2, 424: 1, 212: 2}, 1024) == [(1, {600: 1, 424: 1}), (1, {600: 1, 212: 2})]


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    path, draw = packing.vocabulary(), random.Random(2)
    odd = ["".join(draw.choice("ab Z\n\t .,!1é漢½'") for _ in range(draw.randint(0, 30))) for _ in range(300)] + ["<|endoftext|>x", "", "  "]
    full = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.Encoder(path).encode_batch(odd)] == [full.encode(t, add_special_tokens=False).ids for t in odd]


def test_language(spark, empty):
    english, german = "the and of this that with house river", "der und das nicht schön straße größe fluß"
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice((german if i % 2 else english).split()) for _ in range(30)), "de" if i % 2 else "en") for i in range(80)]
    d = spark.createDataFrame([*rows, (100, None, "en"), (101, "12 !", None)], "doc_id long, text string, lang string").withColumn("held", langid.held_out(F.col("doc_id")))
    net = langid.train(d.filter("not held"), epochs=6)
    got = {r.doc_id: r for r in langid.predict(d, net).collect()}
    assert got[100].lang_pred == got[101].lang_pred == "und"
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert langid.predict(empty, langid.train(empty)).count() == 0


def test_gradients_agree_with_differences():
    texts = [b"the house by the river " * 9, "größe und straße".encode(), b"x"]
    net = langid.BiGRU(["de", "en"], 4)
    net.p = {n: x.astype(np.float64) for n, x in net.p.items()}
    buf, begin, length, first = langid.stretches(texts)
    label = np.repeat([1, 0, 1], np.diff(first))
    _, grads = net.gradients(buf, begin, length, label)
    draw = np.random.default_rng(3)
    for name, g in grads.items():
        largest = np.unravel_index(np.abs(g).argmax(), g.shape)
        for at in [largest, *(tuple(draw.integers(0, n) for n in g.shape) for _ in range(3))]:
            old, sides = net.p[name][at], []
            for step in (1e-2, -1e-2):
                net.p[name][at] = old + step
                sides.append(net.gradients(buf, begin, length, label)[0])
            net.p[name][at] = old
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-2, abs=2e-4)


def test_language_of_whole_texts(spark):
    """Stretches make up the text, the state crosses words, and the end of a very long text counts."""
    texts = ["é".encode() * 200, b"", b"a b", b"z" * 1000]
    buf, begin, length, first = langid.stretches(texts)
    for i, t in enumerate(texts):
        assert b"".join(buf[b : b + n].tobytes() for b, n in zip(begin[first[i] : first[i + 1]], length[first[i] : first[i + 1]], strict=True)) == t
    net = langid.BiGRU(["a", "b", "c"], 8)
    alone = net.document_probabilities([b"ab cd"])[0]
    whole = net.document_probabilities([b"ab cd" * 20_000, b"ab cd", b"", b"cd ab"])
    assert np.allclose(whole[1], alone, atol=1e-6) and not whole[2].any() and not np.allclose(whole[3], alone, atol=1e-5)
    draw = random.Random(5)
    said = lambda words, n: " ".join(draw.choice(words.split()) for _ in range(n))
    english, german = "the and of this that with house river", "der und das nicht schön straße größe fluß"
    rows = [(i, said(german if i % 2 else english, 30), "de" if i % 2 else "en", "x", 9) for i in range(60)]
    odd = [(100, said(english, 1000) + " " + said(german, 30_000), None, None, None), (101, rows[1][1], None, None, None), (101, rows[1][1], None, None, None)]
    d = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, lang_pred string, score int")
    net = langid.train(d, epochs=6)
    out = langid.predict(d, net)
    assert sorted(out.columns) == ["doc_id", "lang", "lang_pred", "score", "text"] and dict(out.dtypes)["score"] == "double"
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[100][0][0] == "de" and len(got[101]) == 2 and len(set(got[101])) == 1 and got[101][0][0] == "de"
    assert all(0 < s <= 1 for found in got.values() for _, s in found)


def test_ties_go_to_the_first_label(spark):
    net = langid.BiGRU(["x", "y"], 4)
    for name, x in net.p.items():
        net.p[name] = np.zeros_like(x)
    row = langid.predict(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), net).first()
    assert (row.lang_pred, row.score) == ("x", 0.5)


def test_neighbours(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400 + i, x[0].tolist()) for i in range(40)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hashing_ann.search(d, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    ids = [i for i, v in rows if i < 900]
    vectors = np.array([v for i, v in rows if i < 900])
    hits = 0
    for q, found in got.items():
        score = vectors @ vectors[ids.index(q)]
        best = [ids[j] for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        hits += len(set(best) & {v for _, v in found})
        assert sorted(r for r, _ in found) == list(range(1, 21))
    assert set(got) == {i for i in ids if i % 20 == 0} and hits >= 0.9 * 20 * len(got)
    assert hashing_ann.search(d.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_outlying_queries(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(8, 32))
    x = np.concatenate([centres[i % 8] + 0.01 * draw.normal(size=32) for i in range(800)] + [-3 * draw.normal(size=32) for _ in range(12)]).reshape(-1, 32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hashing_ann.search(d, F.col("vec_id") >= 796).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == set(range(796, 812)) and all(sorted(r for r, _ in v) == list(range(1, 21)) for v in got.values())
    few = d.filter("vec_id % 80 = 0 or vec_id >= 805")  # 18 vectors: all others are found
    found = hashing_ann.search(few, F.col("vec_id") >= 805).groupBy("query_id").count().collect()
    assert len(found) == 7 and all(r["count"] == 17 for r in found)


def test_neighbours_among_clusters(spark):
    """The radius of a clustered table is small, its substrings are long, and other columns don't matter."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 48))
    x = (centres[np.arange(3000) % 60] + 0.15 * draw.normal(size=(3000, 48))).astype(np.float32)
    rows = [(i, v.tolist(), "e", 1, 2.0, True) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, entry string, n int, score double, asks boolean").repartition(3)
    got = {}
    for r in hashing_ann.search(d, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    score = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(score, -np.inf)
    assert set(got) == set(range(0, 3000, 20))
    assert np.mean([len(set(got[q]) & set(np.argsort(-score[q])[:20].tolist())) / 20 for q in got]) >= 0.9
    entries = d.select(F.col("vec_id").alias("entry"), F.col("embedding").cast("array<double>").alias("vector"))
    codes, radius, _ = hashing_ann.learn(entries, 20, 0.97)
    assert radius < codes.bits // 3 and hashing_ann.best_substrings(codes.bits, radius, 16384) < hashing_ann.best_substrings(codes.bits, codes.bits // 2, 16384)


def test_index_finds_all_within_the_radius():
    codes = np.random.default_rng(1).integers(0, 1 << 32, 2000, dtype=np.uint64)
    index = hashing_ann.Index(codes, 32, 4)
    for radius in (3, 9):
        assert set(index.within(codes[5], radius)) == set(np.flatnonzero(np.bitwise_count(codes ^ codes[5]) <= radius))


def test_rotation(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 70, "ann", None), (None, None, None, "x")]
    got = {(r.conv_id, r.speaker, r.block): r for r in rotation.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (None, "unknown", 0)}
    ann = got[1, "ann", 0]
    assert ann.text == "<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo<|end|>\n" and ann.n_turns == 3
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["hi<|end|>"]
    assert rotation.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    # a very long text, and other columns with the names of the result
    long = "word " * 100_000
    odd = [(1, 0, "ann", long, "b", "s", 1, "m"), (1, 1, "bob", "", "b", "s", 1, "m")]
    got = {r.speaker: r for r in rotation.rotate(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string, block string, speaker string, parts int, conv string")).collect()}
    assert got["ann"].text == f"<|assistant|>\n{long}<|end|>\n<|user name=bob|>\n<|end|>\n" and [(m.start, m.end) for m in got["ann"].mask] == [(14, 14 + len(long) + 7)]


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a><li>Far</ul></nav><div class="cookie-notice">Ok?</div><article><h1>A &amp; B</h1><p><b>One  two<br><p>Three &#233;<form>go</form></p><div class="comments"><p>first!</p></div></article><aside>x</aside><footer>&copy;</footer></body></html>'


def test_extraction(spark):
    rows = [(1, "http://a.b/c", PAGE), (2, "http://a.b/d", PAGE.replace("One", "Uno")), (3, None, None), (4, "x", "plain &lt; text"), (5, "http://a.b/", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_texts(d).collect()}
    assert got == {1: "A & B\nOne two\nThree é", 2: "A & B\nUno two\nThree é", 3: "", 4: "plain < text", 5: ""}
    assert wrappers.main_texts(d.filter("page_id < 0")).count() == 0


def test_hints_never_drop_the_page():
    text = "Long enough a text to be most of what this page says to its readers."
    said = lambda page: wrappers.extract(wrappers.tree(page))
    for name in ("page has-sidebar", "no-comments", "header-fixed"):
        assert said(f'<body><div class="{name}"><div class="sidebar">s</div><article><p>{text}</article></div></body>') == text
        assert said(f'<body><div class="{name}"><div class="sidebar">s</div><p>{text}</div></body>') == text
    page = f'<body><article><div class="post-header"><h1>T</h1></div><p>{text}<h2 id="related-work">W</h2><p>a <math><mi>x</mi></math> b<object>o</object><xmp>&lt;<i></xmp><dialog>d</dialog><div class="comments"><article>{text}{text}</article></div></article></body>'
    assert said(page) == f"T\n{text}\nW\na x b\no\n&lt;<i>\nd"


def _words(draw, n):
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))


def test_two_templates_of_a_host(spark):
    """Pages of a rare template hold a teaser where the others hold their text."""
    draw = random.Random(11)
    rows, expected = [], {}
    for i in range(60):
        long, short = _words(draw, 60), _words(draw, 2)
        rare = i == 7
        rows.append((i, f"http://t.x/{i}", f'<body><div class="story">{short if rare else long}</div><div class="{"essay" if rare else "links"}">{long if rare else short}</div></body>'))
        expected[i] = f"{short}\n{long}" if rare else f"{long}\n{short}"
    # one page of the usual template whose text stands elsewhere for the most part
    rows.append((99, "http://t.x/99", f'<body><div class="story">{rows[0][2][27:40]}</div><div class="links">{_words(draw, 200)}</div></body>'))
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.main_texts(d).collect()}
    for i in range(60):
        wanted = expected[i].split("\n")
        assert max(wanted, key=len) in got[i].split("\n")
    assert len(got[99].split()) >= 200


def test_constants_fall_out(spark):
    draw = random.Random(4)
    texts = [[_words(draw, 20) for _ in range(1 + i % 3)] for i in range(30)]
    body = ["<p>Read our terms before you go on.</p>" + "".join(f"<p>{p}</p>" for p in t) + "<p>Tell a friend.</p>" * (i != 5) for i, t in enumerate(texts)]
    rows = [(i, f"http://c.x/{i}", f"<body><article>{b}</article></body>") for i, b in enumerate(body)]
    copies = [(100 + i, "http://copies.x/", rows[0][2]) for i in range(40)]
    d = spark.createDataFrame([*rows, *copies], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.main_texts(d).collect()}
    assert all(got[i] == "\n".join(t) for i, t in enumerate(texts))
    assert all(got[100 + i] == "Read our terms before you go on.\n" + texts[0][0] + "\nTell a friend." for i in range(40))


def _expression(body):
    return wrappers.expression_of(wrappers.tree(f"<div>{body}</div>")[1])


def test_wrapper_expressions():
    assert wrappers.shown(_expression("<ul><li>a<li>b</ul><p>x")) == "<ul>(<li>#</li>)+</ul><p>#</p>"
    # a stretch that follows itself is a repeated group
    assert wrappers.shown(_expression("<h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p>")) == "(<h2>#</h2>(<p>#</p>)+)+"
    aligned = wrappers.align(_expression("<h2>a</h2><p>b</p>"), _expression("<p>b</p><ul><li>c</ul>"))
    assert wrappers.shown(aligned) == "(<h2>#</h2>)?<p>#</p>(<ul><li>#</li></ul>)?"
    # a group meets the stretch that it repeats
    both = wrappers.align(_expression("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><ul><li>e</ul>"), _expression("<h2>a</h2><p>b</p><ul><li>f<li>g</ul>"))
    assert wrappers.shown(both) == "(<h2>#</h2><p>#</p>)+<ul>(<li>#</li>)+</ul>"
    # equal texts of other pages have the same places, whatever stands before them
    first, second = (wrappers.tree(f"<div>{x}</div>")[1] for x in ("<h2>a</h2><p>b</p>", "<p>b</p><ul><li>c</ul>"))
    places = [dict((t, p) for p, t in wrappers.match(x, aligned)) for x in (first, second)]
    assert places[0]["b"] == places[1]["b"] and places[0]["a"] != places[0]["b"]


def test_expressions_stay_bounded():
    draw = random.Random(3)
    names = [f"<div class={c}>x</div>" for c in "abcdefgh"]
    reads = ()
    for _ in range(300):
        reads = wrappers.align(reads, _expression("".join(draw.choice(names) for _ in range(draw.randrange(1, 120)))))
        assert len(reads) <= wrappers.LONGEST
    assert {m[0] for _, _, members in reads for m in members} == {f"div.{c}" for c in "abcdefgh"}


def test_alignment_decides(spark, monkeypatch):
    """A text before and after others, at one place only if the pages' streams are aligned."""
    draw = random.Random(6)
    rows = []
    for i in range(30):
        parts = [f"<div class=a>{_words(draw, 9)}</div>"] * (i % 2) + ["<div class=n>Read this notice.</div>", f"<div class=b>{_words(draw, 40)}</div>"]
        rows.append((i, f"http://n.x/{i}", f"<body><article>{''.join(parts)}</article></body>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text.split("\n") for r in wrappers.main_texts(d).collect()}
    assert all("Read this notice." not in t and len(t) == 1 + i % 2 for i, t in got.items())
    # a constant of one place is a slot's text at another
    rows = [(i, f"http://m.x/{i}", f"<body><article><p>{_words(draw, 9)}</p><ul><li>{_words(draw, 9)}</ul><p>Tell a friend.</p></article></body>") for i in range(40)]
    rows.append((40, "http://m.x/40", f"<body><article><p>Tell a friend.</p><ul><li>{_words(draw, 9)}</ul></article></body>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text.split("\n") for r in wrappers.main_texts(d).collect()}
    assert all(len(got[i]) == 2 and "Tell a friend." not in got[i] for i in range(40)) and got[40][0] == "Tell a friend."
    pages = [wrappers.tree(r[2]) for r in rows]
    place = lambda: {p for x in (pages[0], pages[40]) for p, t in wrappers.match(x, wrappers.align(*map(wrappers.expression_of, (pages[0], pages[40])))) if t == "Tell a friend."}
    assert len(place()) == 2
    monkeypatch.setattr(wrappers, "pairs", lambda a, b: [])
    assert len(place()) == 1


def test_odd_pages(spark):
    """Very long and deep pages, repeated rows, other columns with the names of the result."""
    long = "<body><article>" + "".join(f"<p>word{i} and more words</p>" for i in range(20_000)) + "</article></body>"
    deep = "<body>" + "<div>" * 3000 + "deep text" + "</div>" * 3000 + "</body>"
    rows = [(1, "http://o.x/1", long, "t", 5, "h"), (2, "http://o.x/2", deep, "t", 5, "h"), (3, "http://o.x/3", deep, None, None, None), (3, "http://o.x/3", deep, None, None, None), (None, None, "<p>x", None, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, host string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in wrappers.main_texts(d).collect()), key=str)
    whole = "\n".join(f"word{i} and more words" for i in range(20_000))
    assert got == sorted([(1, whole, len(whole)), (2, "deep text", 9), (3, "deep text", 9), (3, "deep text", 9), (None, "x", 1)], key=str)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en" if i % 2 else "de", s, n) for i, t, _, s, n, *_ in _rows() if i is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    spoken = [r for r in rows if r[1] and re.search(r"[a-zA-Z]", r[1])]
    assert counts[:3] == [len(rows), len(spoken), len({r[1] for r in spoken})]
    found = neardup.near_duplicates(docs).select("component_id").distinct().count()
    assert found == counts[3]


def test_pipeline_rows(spark, tmp_path):
    """run() against a plain version, with rows that share a doc_id or have none."""
    import hashlib
    import math

    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(i, t, "en" if (i or 0) % 2 else "de", s, n) for i, t, _, s, n, *_ in _rows()]
    draw = random.Random(9)
    base = [[f"n{draw.randrange(500)}" for _ in range(100)] for _ in range(3)]
    changed = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows += [(None, changed(base[0], k), "en", "s1", 0) for k in (20, 50, 80)]  # near copies without doc_id
    rows += [(70, changed(base[1], 30), "en", "s1", 0), (71, changed(base[1], 60), "en", "s2", 0), (71, " ".join(base[2]), "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    order = lambda r: (r[0] is None, r[0] or 0)
    kept = {}
    for r in sorted((r for r in rows if r[1] and re.search("[a-zA-Z]", r[1])), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept[r[1]] = r  # the largest doc_id of a text
    left, sets = sorted(kept.values(), key=order), {r[1]: _shingles(r[1]) for r in kept.values()}
    groups = []
    for r in left:
        near = [g for g in groups if any(100 * len(sets[r[1]] & sets[q[1]]) >= 80 * len(sets[r[1]] | sets[q[1]]) for q in g)]
        groups = [g for g in groups if g not in near] + [sorted([r, *(q for g in near for q in g)], key=order)]
    wanted = sorted((str(g[0][0]), len(sets[g[0][1]])) for g in groups)
    docs = spark.createDataFrame(sorted(kept.values(), key=order), schema)
    deduped = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), len(sets[r.text])) for r in deduped) == wanted
    assert sum(r.doc_id is None for r in deduped) == 1 and sum(r.doc_id == 71 for r in deduped) == 1

    sizes = {}
    for r in deduped:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    ranked, total, heft, level = sorted(sizes, key=lambda s: 3 * sizes[s] / weights[s]), sum(sizes.values()), sum(weights.values()), 0.0
    for s in ranked:
        level = max(level, total / heft)
        total, heft = total - 3 * sizes[s], heft - weights[s]
    full, tokens, copies = Tokenizer.from_file(packing.vocabulary()), {}, {}
    for r in deduped:
        rate = min(3 * sizes[r.source], level * weights[r.source]) / sizes[r.source]
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        drawn = int(md5(f"mix:{'' if r.doc_id is None else r.doc_id}:{md5(r.text)}")[:13], 16) / 2**52
        n = math.floor(rate) + (drawn < rate - math.floor(rate))
        if n:
            copies[r.doc_id] = copies.get(r.doc_id, 0) + n
            tokens[r.doc_id] = tokens.get(r.doc_id, 0) + n * (len(full.encode(r.text, add_special_tokens=False).ids) + 1)
    got_copies, got_tokens = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got_copies[r.doc_id] = got_copies.get(r.doc_id, 0) + (r.start == 0)
        got_tokens[r.doc_id] = got_tokens.get(r.doc_id, 0) + r.length
    assert got_copies == copies and got_tokens == tokens


def test_no_language_is_known(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, d, str(tmp_path)).collect()] == [1]


def test_the_network_decides_what_goes(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(1, "aaaa", "x", 5), (2, "bbbb", "y", 5), (3, "", "x", 5), (None, "bbbb", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    net = langid.BiGRU(["w", "x", "y"], 4)
    for name, x in net.p.items():
        net.p[name] = np.zeros_like(x)
    net.p["wf"][ord("a"), 8:] = net.p["wb"][ord("a"), 8:] = 9
    net.p["vf"][:, 1] = net.p["vb"][:, 1] = 9  # sure of a, at a loss about b
    monkeypatch.setattr(langid, "train", lambda labelled, **_: net)
    assert [tuple(r) for r in corpus_pipeline.identify_language(spark, d, str(tmp_path)).collect()] == rows[:1]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
