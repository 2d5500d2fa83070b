"""Ranked lexical search: exact top scores of query texts over all documents, by ball trees of sparse vectors.

A document is a sparse vector with one whole number per query term that it holds: the term's part of the score.
A query is the set of its terms, and a score the sum of the document's numbers over the set. Texts are cut into
words once; what stays is a row per document with its length and the counts of query terms. Once the corpus counts
are known, documents of a task are arranged in ball trees of at most TREE_DOCS documents and written as an index.

Every node of a tree has a centroid and a radius that holds all its documents. For a query of q terms no
document of the node scores more than the centroid's sum over the terms plus the radius times the square root of
q. Radii and bounds are rounded up by more than their rounding errors. Trees are searched from the node of the best
bound on; a node serves the queries whose bound it still reaches, and its subtree is dropped when none is left.
Leaves are scored in whole numbers.

A first pass follows each query to one leaf per tree. The scores met there, counted by their leading digits, give
a score that at least k documents reach. The second pass starts from it, so that bounds are held against the
corpus and not against one tree or task alone. Tasks return the k best of what they saw at most.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import words
from marketloom.llm.common import longs, pick, stored, unsigned

TREE_DOCS, LEAF_DOCS = 512, 32
#: Queries that a node is held against at once, and terms and queries that are searched in one pass over the texts.
GROUP_QUERIES, PASS_TERMS, PASS_QUERIES = 256, 1 << 20, 1 << 14
_SLACK = 2.0**-36
_HELD = 1 << 18


def term_hashes(texts: pa.Array):
    """(rows, hashes) of all terms of pieces of a text column, and the number of terms of each row of the piece."""
    for first, buffer, offsets in words.slabs(texts):
        starts, ends, firsts = words.spans(words.lower(buffer), offsets, words.NOT_ALNUM)
        counts = np.diff(firsts)
        yield first + np.repeat(np.arange(len(counts)), counts), words.word_hashes(words.lower(buffer), starts, ends), first, counts


def query_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and the sorted distinct term hashes of every item that has a term."""

    def cut(batches):
        for batch in batches:
            found = [np.zeros(0, words.U64)] * batch.num_rows
            for row, hashes, first, counts in term_hashes(batch["text"]):
                for i, part in enumerate(np.split(hashes, np.cumsum(counts)[:-1]), first):
                    found[i] = np.unique(part)
            ends = np.cumsum([0, *map(len, found)])
            yield pa.record_batch({"item_id": batch["item_id"], "terms": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), longs(np.concatenate([*found, np.zeros(0, words.U64)])))})

    wanted = pick(items, item_id=(id_col, "long"), text=(text_col, "string"))
    return wanted.mapInArrow(cut, "item_id long, terms array<long>").where("size(terms) > 0")


class Vocabulary:
    """Numbers of known term hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.starts = np.zeros(1 << 16, bool)
        self.starts[self.hashes >> words.U64(48)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are known, and their numbers."""
        at = np.flatnonzero(self.starts[hashes >> words.U64(48)])
        number = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        known = self.hashes[number] == hashes[at]
        return at[known], number[known]


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def postings(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the number n of terms, and numbers and counts of the known terms of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        for batch in batches:
            for row, hashes, first, counts in term_hashes(batch["text"]):
                at, number = known.find(hashes)
                cell, times = np.unique((row[at] - first) * len(known.hashes) + number, return_counts=True)
                own, term = np.divmod(cell, len(known.hashes))
                ends = np.searchsorted(own, np.arange(len(counts) + 1))
                piece = pa.record_batch({
                    "doc_id": batch["doc_id"].slice(first, len(counts)), "n": pa.array(counts, pa.int64()),
                    "terms": _lists(term, ends, pa.int32()), "times": _lists(times, ends, pa.int64()),
                })
                yield piece.filter(pa.array(counts > 0))

    wanted = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return wanted.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>")


class Tree:
    """A ball tree: documents in the order of its leaves, and centroid and radius of every node.

    Node i has the children 2i+1 and 2i+2; the nodes of a level halve the documents of the one above.
    """

    def __init__(self, ends: np.ndarray, terms: np.ndarray, scores: np.ndarray):
        count = len(ends) - 1
        self.depth = max(math.ceil(math.log2(max(count, 1) / LEAF_DOCS)), 0)
        order = np.arange(count)
        own = np.repeat(np.arange(count), np.diff(ends))
        values, width = scores.astype(np.float64), int(terms.max(initial=0)) + 1
        norms = np.bincount(own, values * values, count)
        self.centroids, self.radii = [], []
        for level in range(self.depth + 1):
            edges = (count * np.arange((1 << level) + 1)) >> level
            node_of_place = np.repeat(np.arange(1 << level), np.diff(edges))
            node = np.empty(count, np.int64)
            node[order] = node_of_place
            cell, inverse = np.unique(node[own] * width + terms, return_inverse=True)
            of = cell // width
            centre = (np.bincount(inverse, values, len(cell)) / np.diff(edges)[of]).astype(np.float32)
            self.centroids.append((np.searchsorted(of, np.arange((1 << level) + 1)), cell % width, centre))
            centre = centre.astype(np.float64)
            square = np.bincount(of, centre * centre, 1 << level)[node]
            dot = np.bincount(own, values * centre[inverse], count)
            apart = np.maximum(norms - 2 * dot + square, 0)
            safe = np.sqrt(apart + (norms + 2 * dot + square) * _SLACK) * (1 + _SLACK)
            self.radii.append(np.maximum.reduceat(safe[order], edges[:-1]))
            if level < self.depth:
                # along the line between two documents that are far from each other, to its halves
                one = self._farthest(apart, order, edges)
                to_one = norms + norms[one][node] - 2 * self._dots(one, node, own, inverse, values, len(cell))
                two = self._farthest(to_one, order, edges)
                to_two = norms + norms[two][node] - 2 * self._dots(two, node, own, inverse, values, len(cell))
                order = order[np.lexsort(((to_one - to_two)[order], node_of_place))]
        self.order, self.edges = order, edges

    @staticmethod
    def _farthest(apart, order, edges):
        ranked = order[np.lexsort((apart[order], np.repeat(np.arange(len(edges) - 1), np.diff(edges))))]
        return ranked[edges[1:] - 1]

    @staticmethod
    def _dots(chosen, node, own, inverse, values, cells):
        """Products of all documents with the chosen document of their node."""
        line = np.zeros(cells)
        of_chosen = chosen[node[own]] == own
        line[inverse[of_chosen]] = values[of_chosen]
        return np.bincount(own, values * line[inverse], len(node))


_INDEX = "doc_ids array<long>, ends array<int>, terms array<int>, scores array<long>, edges array<int>, node_ends array<int>, node_terms array<int>, node_values array<float>, radii array<double>"


def term_scores(n: np.ndarray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Each posting's part of a score, in whole numbers: weight * (10**9 tf div (1000 tf + 20 m))."""
    m = np.array([50 + 50 * int(x) * documents // total for x in n], object)
    if m.max(initial=0) < 1 << 50 and times.max(initial=0) < 1 << 33:
        m = m.astype(np.int64)
    else:
        times = times.astype(object)
    each = np.repeat(m, np.diff(ends))
    return (weights[terms] * ((1000000000 * times) // (1000 * times + 20 * each))).astype(np.int64)


def index(rows: DataFrame, weights: np.ndarray, documents: int, total: int) -> DataFrame:
    """Ball trees of the documents of every task, one row a tree."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def tree(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table["terms"].combine_chunks()
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        terms, times = lists.flatten().to_numpy(), table["times"].combine_chunks().flatten().to_numpy()
        scores = term_scores(table["n"].to_numpy(), ends, terms, times, shared.value, documents, total)
        built = Tree(ends, terms, scores)
        sizes = np.diff(ends)[built.order]
        new_ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(new_ends[-1]) + np.repeat(ends[:-1][built.order] - new_ends[:-1], sizes)
        node_ends, before = [np.zeros(1, np.int64)], 0
        for node_end, _, _ in built.centroids:
            node_ends.append(node_end[1:] + before)
            before += node_end[-1]
        columns = {
            "ends": (new_ends, pa.int32()), "terms": (terms[take], pa.int32()), "scores": (scores[take], pa.int64()),
            "edges": (built.edges, pa.int32()), "node_ends": (np.concatenate(node_ends), pa.int32()),
            "node_terms": (np.concatenate([c[1] for c in built.centroids]), pa.int32()),
            "node_values": (np.concatenate([c[2] for c in built.centroids]), pa.float32()),
            "radii": (np.concatenate(built.radii), pa.float64()),
        }
        ids = table["doc_id"].combine_chunks().take(pa.array(built.order))
        rows = {"doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
        return pa.record_batch(rows | {k: _lists(v, np.array([0, len(v)]), kind) for k, (v, kind) in columns.items()})

    def build(batches):
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, TREE_DOCS - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == TREE_DOCS:
                    yield tree(held)
                    held, count = [], 0
        if count:
            yield tree(held)

    return rows.where("size(terms) > 0").select("doc_id", "n", "terms", "times").mapInArrow(build, _INDEX)


class Group:
    """Queries that are searched together, and which of them hold each term."""

    def __init__(self, first: int, sets: list[np.ndarray]):
        self.first, self.count = first, len(sets)
        term = np.concatenate(sets)
        query = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        by_term = np.argsort(term, kind="stable")
        self.terms, starts = np.unique(term[by_term], return_index=True)
        self.starts, self.query = np.append(starts, len(term)), query[by_term]
        self.roots = np.sqrt(np.array([len(s) for s in sets], np.float64)) * (1 + _SLACK)

    def spread(self, terms: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a term, query) for every active query that holds it."""
        number = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        place = np.flatnonzero(self.terms[number] == terms)
        number = number[place]
        sizes = self.starts[number + 1] - self.starts[number]
        ends = np.cumsum(sizes)
        query = self.query[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[number] - (ends - sizes), sizes)]
        place = np.repeat(place, sizes)
        kept = active[query]
        return place[kept], query[kept]


class ReadTree:
    """The tree of one index row, as read back."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def values(name):
            return batch[name].slice(row, 1).flatten().to_numpy()

        ids = batch["doc_ids"].slice(row, 1).flatten()
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.ends, self.terms, self.scores, self.edges = (values(c) for c in ("ends", "terms", "scores", "edges"))
        self.node_ends, self.node_terms, self.node_values, self.radii = (values(c) for c in ("node_ends", "node_terms", "node_values", "radii"))
        self.first_leaf = len(self.radii) // 2

    def bounds(self, group: Group, node: int, active: np.ndarray) -> np.ndarray:
        """What no document of the node exceeds, for the active queries."""
        part = slice(self.node_ends[node], self.node_ends[node + 1])
        place, query = group.spread(self.node_terms[part], active)
        sums = np.bincount(query, self.node_values[part].astype(np.float64)[place], group.count)
        return np.where(active, (sums + self.radii[node] * group.roots) * (1 + _SLACK) + 1, -1)

    def leaf(self, group: Group, node: int, active: np.ndarray) -> tuple[np.ndarray, slice]:
        """Exact scores (query, document) of a leaf for the active queries, zero elsewhere, and the leaf's documents."""
        docs = slice(*self.edges[node - self.first_leaf :][:2])
        part = slice(self.ends[docs.start], self.ends[docs.stop])
        place, query = group.spread(self.terms[part], active)
        own = np.repeat(np.arange(docs.stop - docs.start), np.diff(self.ends[docs.start : docs.stop + 1]))
        found = np.zeros((group.count, docs.stop - docs.start), np.int64)
        np.add.at(found, (query, own[place]), self.scores[part][place])
        return found, docs


def _probe(groups):
    """Follow each query to the leaf of its better child all the way down; count the scores there by leading digits."""

    def probe(batches):
        for batch in batches:
            for group in groups.value:
                met = []
                for row in range(batch.num_rows):
                    tree = ReadTree(batch, row)
                    todo = [(0, np.ones(group.count, bool))]
                    while todo:
                        node, active = todo.pop()
                        if node < tree.first_leaf:
                            left, right = (tree.bounds(group, child, active) for child in (2 * node + 1, 2 * node + 2))
                            better = left >= right
                            todo += [(child, some) for child, some in ((2 * node + 1, active & better), (2 * node + 2, active & ~better)) if some.any()]
                            continue
                        scores, _ = tree.leaf(group, node, active)
                        query, doc = np.nonzero(scores)
                        score = scores[query, doc]
                        low = np.maximum(np.frexp(score.astype(np.float64))[1] - 8, 0).astype(np.int64)
                        met.append(np.stack([query, score >> low << low]))
                pair, n = np.unique(np.concatenate(met, axis=1), axis=1, return_counts=True)
                yield pa.record_batch({"query": pa.array(pair[0] + group.first, pa.int64()), "reached": pa.array(pair[1]), "n": pa.array(n, pa.int64())})

    return probe


class _Best:
    """The k best documents of each query of a group so far, and the score that a document must reach."""

    def __init__(self, group: Group, k: int, least: np.ndarray):
        self.group, self.k, self.held = group, k, []
        self.rows = 0
        self.least = np.maximum(least[group.first : group.first + group.count], 1)
        self.top = np.zeros((group.count, k), np.int64)

    def add(self, tree: ReadTree, docs: slice, scores: np.ndarray) -> None:
        some = np.flatnonzero((scores >= self.least[:, None]).any(1))
        if not len(some):
            return
        both = np.concatenate([self.top[some], scores[some]], axis=1)
        both.partition(both.shape[1] - self.k, axis=1)
        self.top[some] = both[:, -self.k :]
        self.least[some] = np.maximum(self.least[some], self.top[some].min(1))
        query, doc = np.nonzero(scores[some] >= self.least[some, None])
        query = some[query]
        found = docs.start + doc
        self.held.append((query, scores[query, doc], tree.ids[found], tree.no_id[found]))
        self.rows += len(query)
        if self.rows > _HELD:
            self.held = [self.best()]
            self.rows = len(self.held[0][0])

    def best(self):
        query, score, ids, no_id = (np.concatenate([h[i] for h in self.held]) if self.held else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.int64, bool)))
        order = np.lexsort((ids, no_id, -score, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[(rank < self.k) & (score[order] >= self.least[query[order]])]
        return query[order], score[order], ids[order], no_id[order]


def _search(groups, least, k: int):
    """The k best documents of every query among the trees of a task, from the node of the best bound on."""

    def search(batches):
        task = TaskContext.get().partitionId()
        found = [_Best(group, k, least.value) for group in groups.value]
        for batch in batches:
            trees = [ReadTree(batch, row) for row in range(batch.num_rows)]
            for best in found:
                _search_trees(trees, best)
        for best in found:
            query, score, ids, no_id = best.best()
            yield pa.record_batch({"query": pa.array(query + best.group.first), "score": pa.array(score), "doc_id": pa.array(ids, mask=no_id), "task": pa.array(np.full(len(ids), task, np.int32))})

    return search


def _search_trees(trees: list[ReadTree], best: _Best) -> None:
    group, heap = best.group, []

    def push(number: int, node: int, active: np.ndarray) -> None:
        bound = trees[number].bounds(group, node, active)
        if (bound >= best.least).any():
            heapq.heappush(heap, (-float((bound / best.least).max()), number, node, bound))

    for number in range(len(trees)):
        push(number, 0, np.ones(group.count, bool))
    while heap:
        _, number, node, bound = heapq.heappop(heap)
        active = bound >= best.least
        if not active.any():
            continue
        tree = trees[number]
        if node < tree.first_leaf:
            push(number, 2 * node + 1, active)
            push(number, 2 * node + 2, active)
        else:
            scores, docs = tree.leaf(group, node, active)
            best.add(tree, docs, scores)


def _one_pass(docs: DataFrame, sets: list[tuple[int, np.ndarray]], k: int, id_col: str, text_col: str) -> DataFrame:
    """Columns set, rank, doc_id and score of some query sets, each a number and its term hashes."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(np.concatenate([s for _, s in sets]))
    rows = stored(postings(docs, vocabulary, id_col, text_col), "postings")
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary.hashes), np.int64)
    for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in holding], np.int64)
    trees = stored(index(rows, weights, documents, max(total, 1)), "trees")
    numbered = [vocabulary.find(s)[1] for _, s in sets]
    groups = spark.sparkContext.broadcast([Group(i, numbered[i : i + GROUP_QUERIES]) for i in range(0, len(sets), GROUP_QUERIES)])
    met = trees.mapInArrow(_probe(groups), "query long, reached long, n long").groupBy("query", "reached").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("query").orderBy(F.col("reached").desc())
    sure = met.withColumn("above", F.sum("n").over(above)).where(F.col("above") >= k).groupBy("query").agg(F.max("reached"))
    least = np.zeros(len(sets), np.int64)
    for query, reached in sure.collect():
        least[query] = reached
    found = trees.mapInArrow(_search(groups, spark.sparkContext.broadcast(least), k), "query long, score long, doc_id long, task int")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("query", "part").orderBy(*order)
    all_ = Window.partitionBy("query").orderBy(*order)
    parts = found.withColumn("part", F.col("task") % 64).withColumn("place", F.row_number().over(some)).where(F.col("place") <= k)
    ranked = parts.withColumn("rank", F.row_number().over(all_)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, number) for i, (number, _) in enumerate(sets)], "query long, set long")
    return ranked.join(F.broadcast(names), "query").select("set", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The k best documents of every item.

    Returns item_id long, rank int (from 1), doc_id long and score long; only scores above 0, fewer rows if there are fewer, equal
    scores by ascending doc_id, null ids last. Terms are compared as 64-bit hashes. Null and empty texts have no
    terms: as documents they count for nothing, as items they have no rows. Repeated documents are ranked each,
    repeated items have rows each, and null ids are returned as null. Empty tables give no rows, further columns are
    ignored. Items with the same terms are searched once. The items are a set of queries that tasks hold
    PASS_QUERIES or about PASS_TERMS terms at a time, whatever their number, each time with one pass over the texts.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    asked = stored(query_sets(items, item_id_col, item_text_col), "items")
    sets = stored(asked.select("terms").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
    size = sets.agg(F.count("*").alias("sets"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    passes = max(-(-size["sets"] // PASS_QUERIES), -(-size["terms"] // PASS_TERMS))
    found = spark.createDataFrame([], "set long, rank int, doc_id long, score long")
    for turn in range(passes):
        part = sets.where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == turn).select("set", "terms").toArrow()
        if part.num_rows:
            terms = [unsigned(row.values) for row in part["terms"]]
            found = found.unionByName(_one_pass(docs, list(zip(part["set"].to_pylist(), terms, strict=True)), k, id_col, text_col))
    owned = asked.join(sets, "terms").select("item_id", "set")
    return owned.join(found, "set").select("item_id", "rank", "doc_id", "score")
