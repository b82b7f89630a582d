"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages are projected on the leading right singular vectors of a passage matrix (distributed randomised SVD), and
every passage whose cosine with a benchmark item is high enough is a candidate. A passage is a run of 8-word blocks; an
item is held against runs that fit into it wherever it begins, so that words around it don't count. Into items of fewer than
two blocks no run need fit: they are also held, by their TF-IDF vectors, against runs of their own length that begin at any
word. On candidates, the
longest common subsequence of words decides, and for paraphrases whether the words of the item's last sentence (the
answer) are there.

Terms are the words of the benchmark: no other word can add to a product with an item. All other words count in the norms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.features import NO_WORD, buffers, pieces, words
from donorlens.llm.store import merged_vectors, release_memory, small_batches, summed_vectors, trimmed, written

#: Words of a block, and the most blocks of a passage; a passage begins at each block.
BLOCK, SPAN = 8, 6
#: Hash buckets in which document frequencies are counted, and the share of documents from which on a word has no weight.
DF_BITS, COMMON = 20, 0.05
#: Items of which less than this share of words keeps a weight have all of their words weighed: a passage that very many
#: documents hold makes its own words common.
KEEP = 0.4
#: Items of one index, singular vectors beyond one for each item, extra ones while iterating, and iterations. With fewer
#: vectors than items, some items would all but vanish in the projection.
ITEMS, BEYOND, EXTRA, ROUNDS = 256, 32, 16, 2
#: The sample that the singular vectors are fitted on: about so many documents, and all items.
SAMPLE_DOCS = 4000
#: A candidate has at least this share of the similarity that the item has with itself.
CANDIDATE = 0.35
#: Shares of an item's words in common order: enough alone, and enough if the answer is there too.
LCS_ALONE, LCS_ANSWER, ANSWER = 0.75, 0.5, 0.75
#: Share of an item's weight that the words of a region must have at all before the order is looked at.
BAG = 0.5
#: Items of fewer words say too little for a subsequence; all their words must be there in order, without gaps.
SHORT_ITEM = 8
#: Indexes that one pass over the documents searches.
INDEXES_AT_ONCE = 16


@dataclass(frozen=True)
class Item:
    """`weights`: of each word that has one, with its repeats, as a share of all of the item's weight."""

    item_id: object
    words: np.ndarray
    answer: frozenset
    weights: dict[int, float] = field(default_factory=dict)


def _weighted(item: Item, weights: np.ndarray) -> Item:
    value = weights[_bucket(item.words)].astype(float)
    shares: dict[int, float] = {}
    for w, v in zip(item.words.tolist(), value.tolist(), strict=True):
        if v:
            shares[w] = shares.get(w, 0.0) + v / value.sum()
    return replace(item, weights=shares)


@dataclass(frozen=True)
class Index:
    """`terms`: sorted hashes; `weights`: inverse document frequencies by bucket; `has_term`: buckets with terms;
    `vectors`: terms x rank; `items`: for each length of passages in blocks the numbers of its items, rank x items (each so
    that a product with a passage over the passage's norm is a share of the item's similarity with itself), and the least
    share of its norm that a passage must keep in the projection to reach CANDIDATE."""

    terms: np.ndarray
    weights: np.ndarray
    has_term: np.ndarray
    vectors: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray, float]]


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, first = words(*buffers(texts), between=NO_WORD)
    return hashes, first


def read_items(rows: list) -> list[Item]:
    """`rows`: (item_id, text). Null and empty texts are no items. The answer is the last sentence, if there are several."""
    items = []
    for item_id, text in rows:
        found, _ = _hashes(pa.array([text], pa.string()))
        if len(found):
            sentences = [s for s in text.replace("\n", " ").replace("? ", ". ").replace("! ", ". ").split(". ") if s.strip()]
            answer, _ = _hashes(pa.array([sentences[-1]], pa.string()))
            items.append(Item(item_id, found, frozenset(answer.tolist())))
    return items


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((1 << DF_BITS) + 1, np.int32)
    for batch in batches:
        for _, texts in pieces(batch.column(0)):
            hashes, first = _hashes(texts)
            counts[-1] += len(texts)
            buckets = _bucket(hashes).astype(np.int32)
            distinct = [np.unique(buckets[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            counts[:-1] += np.bincount(np.concatenate(distinct), minlength=1 << DF_BITS).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])


def _rarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverse document frequencies from the counts, negative for common words."""
    for batch in batches:
        for value in batch.column(0):
            counts = np.frombuffer(value.as_buffer(), np.int64)
            total, found = max(1, int(counts[-1])), counts[:-1]
            rarity = np.maximum(np.log((1 + total) / (1 + found)), 0.05).astype(np.float32)
            signed = np.where(found > max(COMMON * total, 10), -rarity, rarity)
            yield pa.RecordBatch.from_arrays([pa.array([signed.tobytes()], pa.binary())], names=["rarities"])


def _weights(texts: DataFrame, items: list[Item]) -> np.ndarray:
    """Inverse document frequency by bucket, over all documents; 0 for common words that no item depends on."""
    counted = written(texts.mapInArrow(trimmed(_frequencies), "counts binary"), "latent-counts")
    row = merged_vectors(counted, (1 << DF_BITS) + 1).mapInArrow(trimmed(_rarities), "rarities binary").first()
    signed = np.frombuffer(row["rarities"], np.float32)
    weights = np.maximum(signed, np.float32(0))
    for item in items:
        buckets = _bucket(item.words)
        if (signed[buckets] > 0).mean() < KEEP:
            weights[buckets] = np.abs(signed[buckets])
    return weights


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each text (one more entry than texts), and each word's block. Between texts lie SPAN - 1 empty
    blocks, so that no passage reaches into the next text."""
    n = np.diff(first)
    begins = np.concatenate([[0], np.cumsum(-(-n // BLOCK) + SPAN - 1)])
    text_of = np.repeat(np.arange(len(n)), n)
    return begins, begins[text_of] + (np.arange(first[-1]) - first[text_of]) // BLOCK


def _active(hashes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are terms with a weight, and their terms."""
    places = np.flatnonzero(index.has_term[_bucket(hashes)])
    at = np.minimum(np.searchsorted(index.terms, hashes[places]), len(index.terms) - 1)
    same = index.terms[at] == hashes[places]
    return places[same], at[same]


#: Rows of a matrix that are gathered at a time.
GATHERED = 1 << 13


def _sums(weights: np.ndarray, rows: np.ndarray, matrix: np.ndarray, groups: np.ndarray, size: int) -> np.ndarray:
    """For each of `size` groups the sum of its weights times their rows of the matrix; groups come in order.

    Groups of one size are multiplied at once: adding up row by row (`reduceat`) takes eighteen times as long."""
    out = np.zeros((size, matrix.shape[1]), np.result_type(weights, matrix))
    if not len(groups):
        return out
    begins = np.flatnonzero(np.concatenate([[True], np.diff(groups) != 0]))
    sizes = np.diff(np.append(begins, len(groups)))
    for n in np.unique(sizes).tolist():
        same = begins[sizes == n]
        for at in range(0, len(same), max(1, GATHERED // n)):
            some = same[at : at + max(1, GATHERED // n)]
            places = some[:, None] + np.arange(n)
            out[groups[some]] = np.matmul(weights[places][:, None, :], matrix[rows[places]])[:, 0]
    return out


def _multiplied(index: Index, basis: np.ndarray):
    """Sum over passages x of x (x basis): one step of the subspace iteration. A row is (text, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape, np.float64)
        for batch in batches:
            for at, texts in pieces(batch.column(0)):
                hashes, first = _hashes(texts)
                places, terms = _active(hashes, index)
                if not len(places):
                    continue
                begins, block = _blocks(first)
                scale = np.array(batch.column(1).slice(at, len(texts)).to_pylist(), np.float32)
                text_of = np.searchsorted(first, places, side="right") - 1
                passage = block[places] // SPAN + text_of  # passages that don't overlap, none with words of two texts
                passage = np.unique(np.stack([text_of, passage], 1), axis=0, return_inverse=True)[1].ravel()
                value = index.weights[_bucket(hashes[places])] * scale[text_of]
                projected = _sums(value, terms, basis, passage, passage[-1] + 1)
                order = np.argsort(terms, kind="stable")
                total += _sums(value[order], passage[order], projected, terms[order], len(basis))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def fit(documents: DataFrame, items: list[Item], item_texts: list[str], weights: np.ndarray, n_docs: int) -> Index:
    """`documents`: (doc_id, text). The items weigh four times as much as the sampled passages together."""
    spark = documents.sparkSession
    terms = np.unique(np.concatenate([item.words for item in items]))
    has_term = np.zeros(1 << DF_BITS, bool)
    has_term[_bucket(terms)] = weights[_bucket(terms)] > 0
    index = Index(terms, weights, has_term, np.zeros((0, 0)), [])
    share = F.pmod(F.xxhash64("doc_id", F.lit("latent")), F.lit(1 << 40)) < (SAMPLE_DOCS << 40) // max(n_docs, SAMPLE_DOCS)
    sampled = documents.where(share & F.col("text").isNotNull()).select("text", F.lit(1.0).cast("float").alias("weight"))
    sampled = written(sampled, "latent-sample")
    each = float(np.sqrt(4 * max(1, min(n_docs, SAMPLE_DOCS)) * 8 / len(items)))
    rows = spark.createDataFrame([(t, each) for t in item_texts], "text string, weight float")
    passages = written(sampled.union(rows), "latent-passages")
    rank = len(items) + BEYOND
    width = min(len(terms), rank + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((len(terms), width)))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(_step(passages, index, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ _step(passages, index, basis))
    vectors = (basis @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)
    del basis, turn
    release_memory()
    by_span: dict[int, list] = {}
    for i, item in enumerate(items):
        at, value = np.searchsorted(terms, item.words), weights[_bucket(item.words)]
        latent, norm = value @ vectors[at], float(np.sqrt((value**2).sum()))
        column = latent * norm / max(1e-9, float(latent @ latent))
        span = min(max((len(item.words) - BLOCK + 1) // BLOCK, 1), SPAN)
        by_span.setdefault(span, []).append((i, column, 1 / max(1e-9, float(np.sqrt(column @ column)))))
    groups = [
        (span, np.array([f[0] for f in found]), np.stack([f[1] for f in found], 1).astype(np.float32), CANDIDATE * min(f[2] for f in found))
        for span, found in sorted(by_span.items())
    ]
    return Index(terms, weights, has_term, vectors, groups)


def _step(passages: DataFrame, index: Index, basis: np.ndarray) -> np.ndarray:
    shared = passages.sparkSession.sparkContext.broadcast((index, basis.astype(np.float32)))
    sums = passages.mapInArrow(trimmed(lambda batches: _multiplied(*shared.value)(batches)), "sums binary")
    total = summed_vectors(sums, basis.size, "float64", "float64").reshape(basis.shape)
    shared.destroy()  # else the driver keeps each step's copy until it happens to collect its garbage
    return total


def lcs(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in region:
        if hit := row & masks.get(w, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def judge(item: Item, there: list[int]) -> tuple[float, float, bool]:
    """Shares of the item in common order and of its answer, and whether the region holds the item."""
    words_there = set(there)
    if item.weights and sum(v for w, v in item.weights.items() if w in words_there) < BAG:
        return 0.0, 0.0, False
    own = item.words.tolist()
    share = lcs(own, there) / len(own)
    answer = len(item.answer & words_there) / max(1, len(item.answer))
    if len(own) < SHORT_ITEM:
        n = len(own)
        return share, answer, any(there[i : i + n] == own for i in range(len(there) - n + 1))
    return share, answer, share >= LCS_ALONE or (share >= LCS_ANSWER and answer >= ANSWER)


def _found(hashes: np.ndarray, first: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, float]]:
    """Candidates: (text, first word of the passage, item, similarity)."""
    places, terms = _active(hashes, index)
    if not len(places):
        return
    begins, block = _blocks(first)
    n = int(begins[-1])
    weight = index.weights[_bucket(hashes)]
    norms = np.bincount(block, weight * weight, minlength=n)
    # Only passages near a term are formed.
    used = np.unique(block[places])
    sums = _sums(weight[places], terms, index.vectors, block[places], n + SPAN)
    norms = np.concatenate([norms, np.zeros(SPAN)])
    lengths = np.sqrt(np.einsum("ij,ij->i", sums, sums))
    for span, numbers, columns, least in index.items:
        near = np.unique((used[:, None] - np.arange(span)).ravel())
        near = near[near >= 0]
        # No sum is longer than the sum of the lengths, no product larger than the product of the lengths.
        longest = sum(lengths[near + k] for k in range(span))
        near = near[longest >= 0.999 * least * np.sqrt(sum(norms[near + k] for k in range(span)))]
        for at in range(0, len(near), 1 << 15):
            some = near[at : at + (1 << 15)]
            norm = np.sqrt(np.maximum(sum(norms[some + k] for k in range(span)), 1e-9)).astype(np.float32)
            latent = sum(sums[some + k] for k in range(span)) / norm[:, None]
            far = np.sqrt(np.einsum("ij,ij->i", latent, latent)) >= least * 0.999
            some, latent = some[far], latent[far]
            similar = latent @ columns
            rows, found = np.nonzero(similar >= CANDIDATE)
            texts = np.searchsorted(begins, some[rows], side="right") - 1
            firsts = first[texts] + np.maximum(0, some[rows] - begins[texts]) * BLOCK
            scores = similar[rows, found]
            yield from zip(texts.tolist(), firsts.tolist(), numbers[found].tolist(), scores.tolist(), strict=True)


def _found_short(hashes: np.ndarray, first: np.ndarray, index: Index, items: list[Item]) -> Iterator[tuple[int, int, int, float]]:
    """Candidates for items into which no block need fit wherever they begin, as `_found` gives them. A run has the item's
    length and one of its words in that word's place."""
    short = [j for j, item in enumerate(items) if len(item.words) < 2 * BLOCK - 1]
    if not short:
        return
    wanted = np.zeros(len(index.terms), bool)
    wanted[np.searchsorted(index.terms, np.concatenate([items[j].words for j in short]))] = True
    places, terms = _active(hashes, index)
    places, terms = places[wanted[terms]], terms[wanted[terms]]
    if not len(places):
        return
    order = np.argsort(terms, kind="stable")
    by_term, of_term = places[order], terms[order]
    norms = np.concatenate([[0.0], np.cumsum(index.weights[_bucket(hashes)].astype(float) ** 2)])
    for j in short:
        n, own = len(items[j].words), np.searchsorted(index.terms, items[j].words)
        value = index.weights[_bucket(items[j].words)].astype(float)
        distinct, of_word = np.unique(own, return_inverse=True)
        vector = np.bincount(of_word, value)
        ends = np.stack([np.searchsorted(of_term, distinct, "left"), np.searchsorted(of_term, distinct, "right")], 1)
        at = [by_term[a:b] for a, b in ends]
        near = np.concatenate(at)
        if not len(near):
            continue
        # A word adds its weight times its weight in the item, which has it as often as the item repeats it.
        times = np.repeat(vector * index.weights[_bucket(index.terms[distinct])], [len(a) for a in at])
        in_order = np.argsort(near, kind="stable")
        near, sums = near[in_order], np.concatenate([[0.0], np.cumsum(times[in_order])])
        # (text, begin): what would begin before its text begins with it.
        begins = []
        for offset, word in enumerate(of_word.tolist()):
            texts = np.searchsorted(first, at[word], side="right") - 1
            begins.append(np.stack([texts, np.maximum(at[word] - offset, first[texts])], 1))
        texts, starts = np.unique(np.concatenate(begins), axis=0).T
        stops = np.minimum(starts + n, first[texts + 1])
        product = sums[np.searchsorted(near, stops)] - sums[np.searchsorted(near, starts)]
        norm = np.sqrt(np.maximum((norms[stops] - norms[starts]) * (vector @ vector), 1e-9))
        hit = np.flatnonzero(product >= CANDIDATE * norm)
        for k in hit.tolist():
            yield int(texts[k]), int(starts[k]), j, float(product[k] / norm[k])


def _held(column: pa.Array, indexes: list[tuple[Index, list[Item]]]) -> list[tuple]:
    """(row, index, item, lcs share, answer share, similarity) of each item that a text of the column holds."""
    out = []
    for at, texts in pieces(column):
        hashes, first = _hashes(texts)
        best: dict[tuple[int, int, int], tuple] = {}
        tried = set()
        listed = hashes.tolist()
        for k, (index, items) in enumerate(indexes):
            for text, word, j, similarity in chain(_found(hashes, first, index), _found_short(hashes, first, index, items)):
                item = items[j]
                # The item may begin before the passage and end behind it; passages a block apart may share a region.
                low = max(int(first[text]), word - len(item.words))
                high = min(int(first[text + 1]), word + BLOCK * SPAN + len(item.words))
                if (text, k, j, low, high) in tried:
                    continue
                tried.add((text, k, j, low, high))
                share, answer, holds = judge(item, listed[low:high])
                if holds:
                    best[text, k, j] = max(best.get((text, k, j), (0.0,)), (share, answer, similarity))
        out += [(at + text, k, j, *scores) for (text, k, j), scores in sorted(best.items())]
    return out


def _searched(indexes: list[tuple[Index, list[Item]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _held(batch.column(1), indexes)
            docs = batch.column(0).take(pa.array([r[0] for r in out], pa.int64()))
            floats = [pa.array([r[k] for r in out], pa.float64()) for k in (5, 3, 4)]
            numbers = pa.array([r[1] * ITEMS + r[2] for r in out], pa.int32())
            yield pa.RecordBatch.from_arrays([docs, numbers, *floats], names=["doc_id", "item", "similarity", "lcs", "answer"])

    return run


def _clean(indexes: list[tuple[Index, list[Item]]], places: int):
    """Pass on the rows that hold no item, without the folded text in their last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in _held(batch.column(places), indexes)]] = False
            yield batch.select(range(places)).filter(pa.array(keep))

    return run


def _indexes(docs: DataFrame, benchmark: DataFrame, item_id_col: str, item_col: str) -> Iterator[list[tuple[Index, list[Item]]]]:
    """Indexes of the benchmark's items, as many as one pass searches. `docs`: (doc_id, folded text)."""
    all_items = benchmark.select(benchmark[item_id_col].alias("item_id"), F.lower(benchmark[item_col]).alias("text"))
    all_items = all_items.where(F.trim("text") != "")
    small_batches(docs.sparkSession)
    n_items, n_docs = all_items.count(), docs.count()
    if not n_items or not n_docs:
        return
    rounds = -(-n_items // (ITEMS * INDEXES_AT_ONCE))
    for k in range(rounds):
        rows = all_items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k).collect()
        rows = [r for r in sorted(rows, key=lambda r: (str(r["item_id"]), r["text"])) if read_items([r])]
        if not rows:
            continue
        items = read_items(rows)
        weights = _weights(docs.select("text"), items)
        items, found = [_weighted(item, weights) for item in items], []
        for at in range(0, len(items), ITEMS):
            part, texts = items[at : at + ITEMS], [r["text"] for r in rows[at : at + ITEMS]]
            found.append((fit(docs, part, texts, weights, n_docs), part))
        yield found


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_col: str = "text",
) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, similarity, lcs, answer.

    Words are runs of letters and digits (and of anything beyond ASCII), in lower case, so case and punctuation don't matter.
    Null and empty texts hold nothing, null and empty items are held by nothing. Repeated documents and items give a row
    each; null ids are kept. Other columns are not read. With no document or no item the result is empty.
    """
    spark = documents.sparkSession
    docs = documents.select(documents[id_col].alias("doc_id"), F.lower(documents[text_col]).alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType.simpleString()
    scores = "similarity double, lcs double, answer double"
    result = spark.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, {scores}")
    for indexes in _indexes(docs, benchmark, item_id_col, item_col):
        numbered = [(k * ITEMS + j, item.item_id) for k, (_, items) in enumerate(indexes) for j, item in enumerate(items)]
        names = spark.createDataFrame(numbered, f"item int, item_id {item_kind}")
        found = docs.mapInArrow(trimmed(_searched(indexes)), f"doc_id {kind}, item int, {scores}")
        result = result.union(found.join(F.broadcast(names), "item").select(*result.columns))
    return result


def clean(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_col: str = "text",
) -> DataFrame:
    """The rows of `documents`, with all their columns, that hold no benchmark item."""
    docs = documents.select(documents[id_col].alias("doc_id"), F.lower(documents[text_col]).alias("text"))
    kept, places = documents, len(documents.columns)
    for indexes in _indexes(docs, benchmark, item_id_col, item_col):
        folded = kept.select("*", F.lower(kept[text_col]).alias("_folded text"))
        kept = folded.mapInArrow(trimmed(_clean(indexes, places)), documents.schema)
    return kept
