"""Training-text operators against brute force on small tables, with odd rows in every column."""

import base64
import collections
import hashlib
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import common, decontaminate, jaccard, licenses, lm_score, packing, quality, tokens, topk, toxicity, warc
from marketloom.llm.graph import components

FOLDER = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, n long, fp string, Text string, score double, label string"
TEXT = "the quick brown fox jumps over the lazy dog while seven green birds sing loudly near an old quiet river bank today"


def odd_rows():
    edited = TEXT.replace("seven", "eight")
    texts = [TEXT, TEXT, edited, TEXT + " again", None, "", " \n\t ", "one", "ONE", "two words", "x" * 50_000, "word " * 30_000, "é ü Ω \U0001f600 tail"]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None, 7, "fp", "other", 1.0, "l") for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, TEXT, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


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


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, width, pattern=r"[^\x20\x09-\x0D]+"):
    w = words_of(text, pattern)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(rows, t, width):
    """(doc_id, set size, smallest reachable id, links) by comparing all pairs."""
    sets = [shingles(x, width) for _, x in rows]
    root, degree = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and t.denominator * both >= t.numerator * len(sets[a] | sets[b]) and both:
                root[find(a)] = find(b)
                degree[a] += 1
                degree[b] += 1
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return collections.Counter((doc_id, len(sets[i]), least[find(i)], degree[i]) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize(("t", "width"), [(Fraction(9, 10), 3), (Fraction(4, 5), 5)])
def test_similar_documents_match_all_pairs(spark, docs, prose, t, width, monkeypatch):
    for frame in (docs, prose):
        rows = [(r[0], r[1]) for r in frame.select(frame.columns[:2]).collect()] if frame is prose else [(r[0], r[1]) for r in odd_rows()]
        found = jaccard.similar(frame, t, width).select("doc_id", "n_shingles", "component_id", "n_links").collect()
        assert collections.Counter(map(tuple, found)) == linked(rows, t, width)


def test_strips_of_a_large_block_find_all_links(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in range(i % 7):
            w[(i * 13 + j * 17) % 60] = f"v{i}-{j}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "STRIP_ROWS", 25)
    found = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), Fraction(4, 5), 3)
    found = found.select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert collections.Counter(map(tuple, found)) == linked(rows, Fraction(4, 5), 3)


def test_product_of_a_large_block_takes_the_memory_of_one_tile():
    numbers = np.random.default_rng(5)
    base = numbers.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(1200):
        own, other = base.copy(), numbers.random(60) < 0.25 * numbers.random()
        own[other] = numbers.integers(0, 2**63, other.sum(), dtype=np.uint64)
        sets.append(np.unique(own[: numbers.integers(40, 61)]))
    for rows, columns in ((np.arange(1200), np.arange(1200)), (np.arange(0, 1200, 2), np.arange(1, 1200, 2)), (np.arange(3), np.arange(0))):
        tracemalloc.start()
        found = jaccard.overlaps(sets, rows, columns, Fraction(4, 5))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 50e6
        both = np.array([[len(np.intersect1d(sets[r], sets[c], assume_unique=True)) for c in columns[:40]] for r in rows[-40:]]).reshape(len(rows[-40:]), -1)
        total = np.add.outer([len(sets[r]) for r in rows[-40:]], [len(sets[c]) for c in columns[:40]])
        linked_pairs = set(zip(*(x.tolist() for x in np.nonzero(5 * both >= 4 * (total - both))), strict=True)) if both.size else set()
        first = len(rows) - len(rows[-40:])
        assert {(r - first, c) for r, c in zip(*(x.tolist() for x in found), strict=True) if r >= first and c < 40} == linked_pairs


def test_one_of_each_class_stays(spark, docs, empty):
    rows = jaccard.one_per_class(docs, Fraction(4, 5), 3)
    assert rows.columns == docs.columns
    kept = [r[0] for r in rows.collect()]
    assert kept.count(0) == 1 and 1 not in kept and kept.count(2) == 1 and kept.count(None) == 1
    assert {4, 5, 6, 7, 9, 10, 11, 12} <= set(kept) and 8 not in kept
    assert jaccard.one_per_class(empty, Fraction(4, 5), 3).count() == 0


def test_components_of_paths_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(200, 260)] + [(300, 301), (301, 300), (5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    assert found == {i: 0 for i in range(41)} | {x: 100 for x in [100, *range(200, 260)]} | {300: 300, 301: 300}


def test_every_token_is_counted_in_one_section(docs, empty):
    rows = tokens.section_counts(docs, fields=("lang",)).collect()
    for r in rows:
        assert r["n_tokens"] >= 0
    for (doc_id, lang, text) in {(r[0], r[2], r[1]) for r in odd_rows() if r[0] is not None}:
        whole = (f"{lang}\n" if lang else "") + (f"{text}\n" if text else "")
        own = [r for r in rows if r["doc_id"] == doc_id]
        copies = sum(1 for r in odd_rows() if r[0] == doc_id)
        assert sum(r["n_tokens"] for r in own) == copies * len(tokens.encode(whole))
        assert all(r["doc_tokens"] == len(tokens.encode(whole)) for r in own)
    assert tokens.section_counts(empty).count() == 0


def test_crossing_tokens_go_to_the_larger_share():
    starts, ends = np.array([0, 2, 6, 9]), np.array([2, 6, 9, 12])
    assert tokens.attribute(starts, ends, np.array([0, 3, 8, 10])).tolist() == [0, 1, 1, 3]
    assert tokens.attribute(np.array([0]), np.array([4]), np.array([0, 2])).tolist() == [0]
    _, sizes = tokens.encoder(tokens.RANKS)
    text = "naïve \U0001f600 été\n"
    data = np.frombuffer(text.encode(), np.uint8)
    s, e = tokens.char_spans(data, sizes[tokens.encode(text)])
    assert s[0] == 0 and e[-1] == len(text) and (s[1:] <= e[:-1]).all()


def exact_top(rows, k, every):
    term, long = 1 << 62, np.iinfo(np.int64)
    good = [(i, [min(max(int(np.floor(64 * x)), -term), term) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, (i, a) in enumerate(good):
        if i % every == 0:
            scores = sorted(((-min(max(sum(x * y for x, y in zip(a, b)), int(long.min)), int(long.max)), j) for c, (j, b) in enumerate(good) if c != q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return collections.Counter(out)


def test_top_k_matches_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 360)]
    rows += [(5, [0.1]), (20, [0.3] * 8), (20, [0.3] * 8), (None, [0.1] * 8), (7, None), (40, [None] * 8), (41, [float("nan")] * 8), (60, []), (61, [1e300] * 8), (80, [1e14] * 8), (100, [1e20, 1.0])]
    monkeypatch.setattr(topk, "SHARD_ROWS", 128)
    monkeypatch.setattr(topk, "TILE_QUERIES", 8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = collections.Counter(map(tuple, topk.search(frame, 20, 20).collect()))
    assert found == exact_top(rows, 20, 20)
    assert topk.search(frame.limit(0), 20, 20).count() == 0


def check_packed(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = collections.Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            wanted[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    return len(used)


def test_packing_places_every_piece_once(docs, empty, prose):
    odd = [(r[0], r[1]) for r in odd_rows()]
    odd = [(i, t) for i, t in odd if t is None or len(t) < 100_000]
    small = common.where_column(docs, "text", lambda text: F.coalesce(F.length(text), F.lit(0)) < 100_000)
    check_packed(packing.pack(small).collect(), odd, 4096)
    texts = [(r["doc_id"], r["text"]) for r in prose.collect()]
    rows = packing.pack(prose, 512).collect()
    total = sum(r["length"] for r in rows)
    assert check_packed(rows, texts, 512) <= -(-total // 512) * 1.02 + 1
    assert packing.pack(empty).count() == 0


def test_piece_cache_encodes_as_the_tokenizer():
    rng = np.random.default_rng(3)
    alphabet = list("abcXYZ019 '\n\t.,!?éİª² \x85\x1ćΣ中-$") + ["'s", "'LL", "<|endoftext|>", "Don't "]
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 800)]
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    for text, ids in zip(texts, packing.PieceEncoder(packing.VOCABULARY).encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_contamination_is_exact_containment(spark, prose, docs, empty, monkeypatch):
    items = [(1, TEXT), (2, "seven green birds sing loudly near an old stone house"), (3, "one"), (4, None), (5, ""), (None, "an old quiet river bank today")]
    bench = common.table(spark, FOLDER, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame(items, "item_id long, text string"))
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 300)
    item_sets = [(r["item_id"], shingles(r["text"], 5, ALNUM)) for r in bench.collect()]
    for frame, rows in ((prose, [(r["doc_id"], r["text"]) for r in prose.collect()]), (docs, [(r[0], r[1]) for r in odd_rows()])):
        wanted = collections.Counter()
        for doc_id, text in rows:
            own = shingles(text, 5, ALNUM)
            for item_id, s in item_sets:
                if s and 5 * len(own & s) >= 4 * len(s):
                    wanted[doc_id, item_id, len(own & s), len(s)] += 1
        found = decontaminate.contaminated(frame, bench).collect()
        assert collections.Counter(tuple(r)[:4] for r in found) == wanted
        assert decontaminate.clean(frame, bench).count() == len(rows) - sum(1 for _, t in rows if any(s and 5 * len(shingles(t, 5, ALNUM) & s) >= 4 * len(s) for _, s in item_sets))
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(odd_rows())


def test_archives_return_every_page(spark, empty):
    trap = "x\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\ny WARC/1.0\r\n"
    rows = [(1, "u1", "hello é"), (2, None, "hello é"), (3, "u3", None), (4, "u4", ""), (5, "u5", trap), (6, "u\n6", trap), (None, "n", "hello é"), (None, "m", "solo")]
    rows += [(7, "z", "WARC/1.0\r\n"), (7, "z", "WARC/1.0\r\n"), (8, "q", "a" * 300_000)] + [(100 + i, f"h{i}", f"p{i % 40}" * (i % 7) + (trap if i % 5 == 0 else "")) for i in range(100)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).coalesce(2)
    folder = warc.archive_folder(spark)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        warc.write(frame, folder)
        found = warc.read(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

    def digest(html):
        return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()

    first = {}
    for page_id, _, html in rows:
        ids = first.setdefault(digest(html), [])
        ids.append(page_id)
    first = {d: min((i for i in ids if i is not None), default=None) for d, ids in first.items()}
    assert collections.Counter((r["key"], r["digest"], r["payload_length"]) for r in found) == collections.Counter((i, digest(h), len((h or "").encode())) for i, _, h in rows)
    heads = collections.Counter(r["digest"] for r in found if r["kind"] == "response")
    assert set(heads) == set(first) and set(heads.values()) == {1}
    for r in found:
        if r["kind"] == "response":
            assert r["payload_digest"] == r["digest"] and len(r["payload"]) == r["payload_length"] and r["key"] == first[r["digest"]]
        else:
            assert r["refers_to_key"] == first[r["digest"]] and bytes(r["payload"]) == b""


def labelled(spark):
    rows = [(i, ("You are such a stupid idiot and a moron, " if i % 4 == 0 else "") + f"green words {i} and {i * 7 % 13} birds {i % 11} " * 5) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, 1, None), (None, 1, 1), (9999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_separates_held_out_documents(spark, docs, empty):
    texts, labels = labelled(spark)
    model = toxicity.fit(texts, labels, keep=~toxicity.held_out())
    rows = toxicity.score(texts, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows if r["held_out"]]) > 0.95
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(empty, labels)).collect()} == {0.0}


def test_toxic_features_see_hidden_letters():
    lexicon = toxicity.Lexicon(np.array([toxicity.W.hash_word("idiot")], np.uint64), np.array([6.0]))
    import pyarrow as pa

    x = toxicity.features(pa.array(["you 1d10t now", "you i.d.i.o.t now", "plain text", None, "an IDIOT"]), lexicon)
    hidden, strong, near = (toxicity.FEATURES.index(n) for n in ("hidden_hits", "strong_hits", "second_person_near"))
    assert (x[:2, hidden] > 0).all() and x[2, hidden] == 0 and x[4, strong] > 0 and x[4, near] == 0 and not x[3].any()


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    m = rng.normal(size=500)
    knots, values = toxicity.isotonic(m, (rng.random(500) < 1 / (1 + np.exp(-3 * m))).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and 0 < values[0] < 0.3 and values[-1] > 0.8


def test_quality_orders_grades(spark, docs, empty):
    kinds = ["JUNK!! LINE!! AGAIN!!", "so so text | with | bars", "a fine calm sentence here"]
    rows = [(i, f"{kinds[i % 3]} {i} " * (3 + i % 5)) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(0, 300, 2)] + [(None, 1), (1, None)], "doc_id long, grade int")
    model = quality.fit(texts, ratings)
    found = {r["doc_id"]: r for r in quality.score(texts, model).collect()}
    assert (np.diff(model.thresholds) > 0).all()
    expected = [found[i]["expected_grade"] for i in range(1, 300, 2)]
    assert np.mean([round(e) == i % 3 for e, i in zip(expected, range(1, 300, 2))]) > 0.95
    assert all(r["tail_probability"][0] >= r["tail_probability"][1] for r in found.values())
    assert quality.score(docs, model).count() == len(odd_rows()) and quality.score(empty, model).count() == 0
    assert quality.fit(texts, ratings.limit(0)) is None
    assert {r["expected_grade"] for r in quality.score(docs, None).collect()} == {None}


def test_language_model_scores_match_plain_counts(spark, docs, empty, monkeypatch):
    rows = [(i, f"alpha beta gamma {i % 5}" if i % 2 else f"delta epsilon zeta {i % 3}") for i in range(60)] + [(60, None), (61, ""), (1, "alpha beta gamma 1")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(None,), (1,)], "doc_id long")
    found = lm_score.score(texts, targets).collect()
    vocabulary = len(tokens.encoder(tokens.RANKS)[1])
    models = []
    for chosen in ([r for r in rows if r[0] is not None and r[0] % 2 and r[0] < 60], rows):
        token, context, pair = collections.Counter(), collections.Counter(), collections.Counter()
        for _, text in chosen:
            ids = tokens.encode(text or "").tolist()
            for before, own in zip([vocabulary, *ids], ids):
                token[own] += 1
                context[before] += 1
                pair[before, own] += 1
        models.append((token, context, pair, sum(token.values())))
    share = models[0][3] / models[1][3]
    for r, (_, text) in zip(sorted(found, key=lambda r: (r["doc_id"], r["n_tokens"])), sorted(rows, key=lambda r: r[0])):
        ids = tokens.encode(text or "").tolist()
        assert r["n_tokens"] == len(ids)
        if not ids:
            assert r["difference"] == 0 and r["target_loss"] is None
            continue
        losses = []
        for (token, context, pair, total), scale in zip(models, (1, share)):
            loss = []
            for before, own in zip([vocabulary, *ids], ids):
                alone = (token[own] * scale + 0.5) / (total * scale + 0.5 * vocabulary)
                loss.append(-np.log((pair[before, own] * scale + lm_score.SMOOTHING * alone) / (context[before] * scale + lm_score.SMOOTHING)))
            losses.append(np.mean(loss))
        assert r["target_loss"] == pytest.approx(losses[0], rel=1e-4) and r["background_loss"] == pytest.approx(losses[1], rel=1e-4)
    assert all((r["difference"] < 0) == (r["doc_id"] % 2 == 1) for r in found if r["n_tokens"])
    assert lm_score.score(docs, targets.limit(0)).count() == len(odd_rows())
    assert {r["difference"] for r in lm_score.score(docs, targets.limit(0)).collect()} == {0.0}
    assert lm_score.score(empty, targets).count() == 0


def test_licences_match_plain_search(spark, docs, empty, prose):
    notes = ["MIT License; apache license", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "by cc by cc by", "All rights reserved.", "apache. License", "mit licenses", "Released under the MIT License."]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "doc_id long, text string").unionByName(prose.select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    wanted = collections.Counter()
    for doc_id, text in rows:
        w = words_of(text, ALNUM)
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        spots = [i for i, _ in places]
        wanted[doc_id, len(w), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted({x for _, x in places}))] += 1
    found = licenses.scan(frame).collect()
    assert collections.Counter(tuple(r)[:6] for r in found) == wanted
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan(frame.limit(len(notes))).collect()}
    assert labels[1] == "cc-by,cc-by-nc-4.0" and labels[2] == "gpl,gpl-3.0" and labels[4] == "all-rights-reserved" and labels[7] == "mit,mit-notice" and labels[6] == ""
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in found)
    assert licenses.scan(docs).count() == len(odd_rows()) and licenses.scan(empty).count() == 0


def test_texts_with_many_words_of_notices_keep_every_label(spark, prose):
    notices = {label: notice for label, notice, _ in licenses.TEMPLATES}
    texts = [f"all rights reserved {notices['bsd']}", f"released under the mit license {notices['mit-text']}", " and so on ".join(n for _, n, _ in licenses.TEMPLATES)]
    texts += [f"{a[1]} {b[1]}" for a in licenses.TEMPLATES for b in licenses.TEMPLATES]
    wanted = [{"all-rights-reserved", "bsd"}, {"mit", "mit-notice", "mit-text"}, {label for label, _, _ in licenses.TEMPLATES}]
    wanted += [{a[0], b[0]} for a in licenses.TEMPLATES for b in licenses.TEMPLATES]
    frame = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(frame.unionByName(prose.select("doc_id", "text"))).where("doc_id < 0").collect()}
    for i, labels in enumerate(wanted):
        assert labels <= set(found[-1 - i]["labels"].split(",")) and found[-1 - i]["score"] == 1.0


def exact_losses(rows, wanted_target):
    """Mean target and background loss of every row's text from plain counters of its pairs."""
    vocabulary = len(tokens.encoder(tokens.RANKS)[1])
    ids = [tokens.encode(text).tolist() for _, text in rows]
    models = []
    for chosen in ([x for x, (i, _) in zip(ids, rows) if i in wanted_target], ids):
        token, context, pair = collections.Counter(), collections.Counter(), collections.Counter()
        for x in chosen:
            token.update(x)
            context.update([vocabulary, *x[:-1]])
            pair.update(zip([vocabulary, *x], x))
        models.append((token, context, pair, sum(token.values())))
    share = models[0][3] / models[1][3]
    out = {}
    for x, (i, _) in zip(ids, rows):
        out[i] = []
        for (token, context, pair, total), scale in zip(models, (1, share)):
            alone = [(token[own] * scale + 0.5) / (total * scale + 0.5 * vocabulary) for own in x]
            joint = [pair[p] * scale + lm_score.SMOOTHING * a for p, a in zip(zip([vocabulary, *x], x), alone)]
            out[i].append(np.mean([-np.log(j / (context[b] * scale + lm_score.SMOOTHING)) for j, b in zip(joint, [vocabulary, *x])]))
    return out


@pytest.mark.parametrize("head", [1 << 20, 300, 0])
def test_language_model_counts_stay_exact_with_many_distinct_pairs(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD_PAIRS", head, raising=False)
    monkeypatch.setattr(lm_score, "RUN_TOKENS", 20_000, raising=False)
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = [(i, " ".join("".join(rng.choice(letters, 4)) if j % 3 else "the same words" for j in range(300))) for i in range(300)]
    chosen = set(range(0, 300, 3))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = lm_score.score(texts, spark.createDataFrame([(i,) for i in chosen], "doc_id long")).collect()
    wanted = exact_losses(rows, chosen)
    assert len(found) == len(rows)
    for r in found:
        assert [r["target_loss"], r["background_loss"]] == pytest.approx(wanted[r["doc_id"]], rel=1e-7)


def test_copies_are_dropped_however_later_scans_are_split(spark, tmp_path):
    rows = [(i, f"{TEXT} copy" if i % 2 else f"{i} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(400)]
    path, split = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16).write.parquet(path)
    spark.conf.set(split, "1000000000")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        kept = jaccard.one_per_class(spark.read.parquet(path), Fraction(4, 5), 5)
        spark.conf.set(split, "2000")
        found = sorted(r["doc_id"] for r in kept.collect())
    finally:
        spark.conf.unset(split)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found == sorted([1, *range(0, 400, 2)])


def test_archives_are_read_whole_however_later_scans_are_split(spark, tmp_path, monkeypatch):
    split, least = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"
    rows = [(i, f"u{i}", f"page {i % 150} " + "x" * (i % 150) + (warc.MAGIC + "y" if i % 3 == 0 else "")) for i in range(300)]
    path, folder = str(tmp_path / "pages"), warc.archive_folder(spark)
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(12).write.parquet(path)
    small = warc._small

    def other_splits(frame):
        spark.conf.set(split, "2000")
        return small(frame)

    try:
        spark.conf.set(split, "1000000000")
        spark.conf.set(least, "1")
        pages = spark.read.parquet(path)
        with monkeypatch.context() as patched:
            patched.setattr(warc, "_small", other_splits)  # the numbers of one scan are known, the next is not planned
            warc.write(pages, folder)
        spark.conf.set(split, "1000000000")
        found = warc.read(spark, folder)
        spark.conf.set(split, "2000")
        found = found.collect()
    finally:
        spark.conf.unset(split)
        spark.conf.unset(least)
    wanted = {i: base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() for i, _, html in rows}
    assert len(found) == len(rows) and {r["key"]: r["digest"] for r in found} == wanted
    for r in found:
        assert r["kind"] == ("response" if r["key"] < 150 else "revisit")
        assert r["refers_to_key"] == (None if r["key"] < 150 else r["key"] - 150)
        assert r["kind"] == "revisit" or r["payload_digest"] == r["digest"]
