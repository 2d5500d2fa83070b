"""Fingerprint near-duplicates, vector codes and ranked search against brute force, with odd rows in every column."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marketloom.llm import balltree, codes, common, simhash

from .test_operators import FOLDER, ODD, odd_rows

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    spark.conf.set("spark.sql.caseSensitive", "true")
    frame = spark.createDataFrame(odd_rows(), ODD).coalesce(2)
    spark.conf.unset("spark.sql.caseSensitive")
    return frame


@pytest.fixture(scope="module")
def empty(spark):
    common.prepare(spark)
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def prose(spark):
    return common.table(spark, FOLDER, "documents")


def plain_fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [w[i : i + width] for i in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, limit):
    prints = np.array(prints, np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(prints[:a] ^ prints[a]) <= limit):
            root[find(a)] = find(int(b))
    least = collections.defaultdict(list)
    for i, doc_id in enumerate(ids):
        least[find(i)] += [doc_id] * (doc_id is not None)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def same_as_plain(frame, rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    wanted = zip([i for i, _ in rows], [f"{p:016x}" for p in prints], plain_components([i for i, _ in rows], prints, 4), strict=True)
    found = simhash.near_duplicates(frame)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(wanted)


def test_fingerprints_and_components_match_plain_ones(docs, prose, empty):
    same_as_plain(docs, [(r[0], r[1]) for r in odd_rows()])
    same_as_plain(prose, [(r["doc_id"], r["text"]) for r in prose.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprints_of_texts_over_many_slabs(monkeypatch):
    monkeypatch.setattr(simhash.words, "SLAB_BYTES", 50)
    monkeypatch.setattr(simhash, "_SHINGLES", 7)
    texts = ["a b c d e f g h i j", "", None, "x", "É  é\tA\x0bB c", " one two three ", "w " * 700, "A b C d"]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]


def test_every_word_is_near_one_codeword():
    table, sizes = simhash._patterns()
    assert sorted(set(sizes.tolist())) == [1, 6]
    assert (np.bitwise_count(table[:, 0]) <= 3).all() and (np.bitwise_count(table[sizes == 6][:, 1:]) == 4).all()
    rng = np.random.default_rng(3)
    word = rng.integers(0, 1 << 23, 500)
    near, count = simhash.indices(word)
    codewords = np.array([(i << 11) | int(simhash.syndromes(np.array([i << 11]))[0]) for i in range(1 << 12)])
    for w, indices, n in zip(word, near, count, strict=True):
        apart = np.bitwise_count(codewords ^ w)
        assert set(indices[:n].tolist()) == set(np.flatnonzero(apart <= 4).tolist()) and apart[indices[0]] <= 3


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_close_fingerprints_share_a_key(bits):
    rng = np.random.default_rng(bits)
    one = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1)
    other = one.copy()
    for i in range(len(one)):
        for b in rng.choice(64, bits, replace=False):
            other[i] ^= np.uint64(1 << int(b))
    (a, i), (b, j) = simhash.keys(one), simhash.keys(other)
    shared = set(zip(a.tolist(), i.tolist(), strict=True)) & set(zip(b.tolist(), j.tolist(), strict=True))
    assert {i for _, i in shared} == set(range(len(one)))


@pytest.mark.parametrize("strip", [6, 2048])
def test_crowded_keys_keep_all_links(spark, monkeypatch, strip):
    common.prepare(spark)
    monkeypatch.setattr(simhash, "STRIP_ROWS", strip)
    rng = np.random.default_rng(7)
    prints = {0, (1 << 64) - 1}
    for _ in range(400):
        prints.add(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)))
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    root = {p: p for p, in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        root[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for p, in signed:
        groups[find(p)].add(p % (1 << 64))
    wanted = collections.defaultdict(set)
    for p, label in zip(prints, plain_components(list(range(len(prints))), prints, 4), strict=True):
        wanted[label].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    with pytest.raises(ValueError, match="4"):
        simhash.links(spark.createDataFrame(signed, "fp long"), 5)


def plain_codes(rows, parts, entries, rounds):
    """Codes of (vec_id, label, vector) rows by trying every entry, with Python numbers."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = max(-(-max(len(v) for _, _, v in kept) // parts), 1)
    cut = [[(v + [0] * (parts * wide - len(v)))[p * wide : (p + 1) * wide] for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), n) for n, e in enumerate(books[p])) for p, part in enumerate(row)] for row in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            members = collections.defaultdict(list)
            for row, best in zip(cut, found, strict=True):
                members[best[p][1]].append(row[p])
            for n, own in members.items():
                books[p][n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in best) for best in found]
    by_label = collections.Counter()
    for (_, label, _), error in zip(kept, errors, strict=True):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    limit = (1 << 63) - 1
    return collections.Counter(
        (i, "".join(f"{n:02x}" for _, n in best), min(error, limit), min(by_label[label], limit), digest)
        for (i, label, _), best, error in zip(kept, found, errors, strict=True)
    )


VECTORS = "vec_id long, label int, embedding array<double>, code string, error string, terms int"


def vector_rows(seed, count, width):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i % 5) if i % 7 else None, [float(np.float32(x)) for x in rng.normal(0, 0.2, width)]) for i in range(count)]
    rows += [(count + i, 1, [0.25] * width) for i in range(40)]
    rows += [(3, 2, rows[5][2]), (3, 2, rows[5][2]), (None, None, [0.1] * width), (900, 1, None), (901, 1, [None] * width), (902, 1, [float("nan")] * width), (903, 1, [float("inf")] * width)]
    return rows


@pytest.mark.parametrize("width", [8, 16])
def test_vector_codes_match_trying_every_entry(spark, width):
    rows = vector_rows(width, 120, width)
    frame = spark.createDataFrame([(*r, "c", "e", 1) for r in rows], VECTORS).repartition(3)
    found = codes.compress(common.prepare(spark) and frame, entries=32, rounds=4)
    assert collections.Counter(map(tuple, found.collect())) == plain_codes(rows, 4, 32, 4)


def test_vector_codes_of_few_uneven_and_huge_vectors(spark):
    common.prepare(spark)
    rows = [(5, None, [0.5, -0.5, 1.0]), (2, 7, [1e10, 3.0, -1e12, 0.25, 0.125]), (9, 7, []), (4, None, [-0.3, 2e9])]
    frame = spark.createDataFrame([(*r, None, None, None) for r in rows], VECTORS)
    assert collections.Counter(map(tuple, codes.compress(frame).collect())) == plain_codes(rows, 4, 256, 4)
    assert codes.compress(frame.limit(0)).collect() == []
    beyond = spark.createDataFrame([(1, 0, [1e300, 0.0, 0.0, 0.0], "", "", 0), (2, 0, [0.0] * 4, "", "", 0)], VECTORS)
    assert [(r["vec_id"], r["error"]) for r in codes.compress(beyond).orderBy("vec_id").collect()] == [(1, 0), (2, 0)]


def test_bounds_leave_the_nearest_entry(monkeypatch):
    monkeypatch.setattr(codes, "FIRST_TRIED", 2)
    rng = np.random.default_rng(2)
    parts, entries = rng.integers(-300, 300, (500, 4)), rng.integers(-300, 300, (64, 4))
    entries[40] = entries[3]
    points = entries[codes.pivots(entries, 6)]
    number, distance = codes.nearest(parts, codes.distances(parts, points), entries, codes.distances(entries, points))
    all_ = ((parts[:, None] - entries[None]) ** 2).sum(-1)
    assert (number == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def plain_ranking(documents, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(text):
        return [t.translate(LOWER) for t in re.findall(pattern, text or "")]

    counted = [(i, collections.Counter(terms(t))) for i, t in documents]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    holding = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) for t in set(terms(text))}
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return collections.Counter(out)


ITEMS = "item_id long, text string, doc_id string, rank string"


def test_ranked_search_matches_scoring_everything(spark, docs, empty, prose):
    odd_items = [(0, "The quick BROWN fox"), (1, None), (2, ""), (2, "two words one"), (2, "two words one"), (None, "bank today word"), (7, "nothing here is known zzz"), (8, "é Ω tail x" + "x" * 49_999)]
    items = spark.createDataFrame([(*r, "d", "r") for r in odd_items], ITEMS)
    for k in (3, 50):
        found = balltree.search(docs, items, k)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert collections.Counter(map(tuple, found.collect())) == plain_ranking([(r[0], r[1]) for r in odd_rows()], odd_items, k)
    assert balltree.search(empty, items).count() == 0
    assert balltree.search(docs, items.limit(0)).count() == 0


def test_ranked_search_through_deep_trees_groups_and_passes(spark, prose, monkeypatch):
    monkeypatch.setattr(balltree, "LEAF_DOCS", 4)
    monkeypatch.setattr(balltree, "TREE_DOCS", 70)
    monkeypatch.setattr(balltree, "GROUP_QUERIES", 7)
    monkeypatch.setattr(balltree, "PASS_QUERIES", 17)
    monkeypatch.setattr(balltree, "_HELD", 30)
    items = common.table(spark, FOLDER, "benchmark")
    rows = [(r["doc_id"], r["text"]) for r in prose.collect()]
    rows += [(r, t) for r, t in rows[:40]] + [(1000 + i, rows[3][1]) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = balltree.search(frame, items, 10)
    assert collections.Counter(map(tuple, found.collect())) == plain_ranking(rows, [(r["item_id"], r["text"]) for r in items.collect()], 10)


def test_balls_hold_their_documents_and_bounds_their_scores():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 100)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([np.sort(rng.choice(30, n, replace=False)) for n in sizes])
    scores = rng.integers(1, 10**10, ends[-1])
    tree = balltree.Tree(ends, terms, scores)
    dense = np.zeros((100, 30))
    for d in range(100):
        dense[d, terms[ends[d] : ends[d + 1]]] = scores[ends[d] : ends[d + 1]]
    assert sorted(tree.order.tolist()) == list(range(100))
    for level, ((node_ends, node_terms, centre), radii) in enumerate(zip(tree.centroids, tree.radii, strict=True)):
        edges = (100 * np.arange((1 << level) + 1)) >> level
        for node in range(1 << level):
            own = np.zeros(30)
            own[node_terms[node_ends[node] : node_ends[node + 1]]] = centre[node_ends[node] : node_ends[node + 1]]
            inside = dense[tree.order[edges[node] : edges[node + 1]]] if level == tree.depth else None
            if inside is not None:
                assert (np.sqrt(((inside - own) ** 2).sum(1)) <= radii[node]).all()


def test_term_scores_of_long_documents_and_many_times():
    n, ends, terms, times = np.array([3, 1 << 40]), np.array([0, 1, 3]), np.array([0, 0, 1]), np.array([2, 1 << 35, 5])
    weights = np.array([11, 7])
    found = balltree.term_scores(n, ends, terms, times, weights, 1 << 34, 1 << 41)
    m = [50 + 50 * int(x) * (1 << 34) // (1 << 41) for x in n]
    wanted = [w * ((10**9 * int(t)) // (1000 * int(t) + 20 * x)) for w, t, x in zip([11, 11, 7], times, [m[0], m[1], m[1]], strict=True)]
    assert found.tolist() == wanted


def test_all_basic_and_extended_latin_encodes_as_the_tokenizer(monkeypatch):
    from marketloom.llm import packing

    rng = np.random.default_rng(9)
    latin = [chr(c) for c in range(0x250)]
    texts = ["ƏLI BAKI", "".join(latin), " ".join(latin), "it's we'll they're 'save \"'s 's't ''s don'tt I'MX y'vex 1's2 3've", "'", "s'", "'l", "x'r e", "İstanbul Ⱥ Ɓa"]
    texts += ["".join(rng.choice(latin + list("'''  stmdrevlX0.") * 20, n)) for n in rng.integers(0, 80, 3000)]
    texts += ["".join(rng.choice(latin + list("ЖяЩ中文é́ſK　Σς\U0001f600") * 20, n)) for n in rng.integers(0, 60, 800)]
    encoder = packing.PieceEncoder(packing.VOCABULARY)
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encoder.encode(texts)] == wanted
    monkeypatch.setattr(packing, "SLAB_CHARS", 31)
    monkeypatch.setattr(packing, "CACHED_PIECES", 500)
    assert [ids.tolist() for ids in encoder.encode(texts)] == wanted
