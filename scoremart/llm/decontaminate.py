"""Benchmark decontamination by latent semantic retrieval.

1. Texts become sequences of lower-case token hashes, written once.
2. Document frequencies of the benchmark's terms are counted over all documents.
3. Items are cut into pieces of at most ``PIECE`` tokens.  The TF-IDF matrix of the pieces gets a randomised SVD: tasks
   multiply their rows with a random projection and send one partial product; power iterations sharpen the basis of
   ``DIMENSIONS`` directions, fewer than the pieces, whose size does not depend on the documents.
4. Every document is folded in as overlapping passages.  A passage is a candidate for a piece if the product of their
   latent vectors is as large as the confirmation rule can need, and if it holds as many of the piece's tokens.  What
   the basis leaves out lowers that product by no more than a bound that each token adds to, so no copy is lost by it.
5. A candidate is confirmed by the longest common subsequence of the whole item and the text around the passage, alone or
   together with the item's answer (its last sentence), so that paraphrases with replaced, dropped or added words are found.

Where the subsequence is a share of the item, it is as large a share of one of its pieces at least.  A passage holds that
piece whole while its tokens lie within ``STEP * (STEPS - 1) + 1`` tokens; copies spread wider than that may be missed.

The benchmark is the stated query set: its terms are counted in blocks of ``ITEMS`` items and it is searched in blocks of
``RANK`` pieces, so that what is sent to the tasks is bounded.  Null and empty texts match nothing, items of fewer than ``LEAST_TOKENS`` tokens are ignored; repeated documents
and items match each; ties of a document and item keep the best values; an empty table gives no pairs; other columns are
kept by ``drop_contaminated`` and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binaries, fresh_name, one_thread_each, pieces, stage
from .words import LETTERS, split_runs, word_hashes

#: Pieces searched together, and directions of their basis.
RANK, DIMENSIONS, EXTRA, ROUNDS = 512, 128, 16, 2
#: Tokens of a step, and steps of a passage; a passage starts at every step.
STEP, STEPS = 16, 4
#: Most tokens of a piece: a passage holds it whole wherever it stands, with 17 tokens between its own.
PIECE = 32
#: Passages projected at a time.
PASSAGES = 512
#: Items whose terms are counted at a time.
ITEMS = 4096
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.75, 0.6, 0.75
#: Least tokens of an item; shorter texts are no passages.
LEAST_TOKENS = 5


def token_rows(table: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry, tokens``: token hashes as little-endian unsigned 32-bit integers.  Tokens are runs of letters and digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in pieces(pc.utf8_lower(batch.column(0))):
                starts, ends, row = split_runs(data, bounds, LETTERS)
                hashes = (word_hashes(data, starts, ends) >> np.uint64(32)).astype("<u4")
                cut = np.searchsorted(row, np.arange(high - low + 1))
                values = [hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                kept = [c.slice(low, high - low) for c in batch.columns[1:]]
                yield pa.record_batch([*kept, binaries(values)], [*carry, "tokens"])

    kinds = [f"`{c}` {table.schema[c].dataType.simpleString()}, " for c in carry]
    return table.select(F.col(text).alias("text"), *carry).mapInArrow(run, "".join(kinds) + "tokens binary")


class Terms:
    """Numbers of the known token hashes; an array look-up sorts out most others before the binary search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint32(12)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known tokens, and their terms."""
        at = np.flatnonzero(self.maybe[tokens >> np.uint32(12)])
        own = tokens[at]
        term = np.searchsorted(self.hashes, own)
        hit = self.hashes[np.minimum(term, len(self.hashes) - 1)] == own
        return at[hit], term[hit]


def document_frequencies(tokens: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """Documents with each term, and documents; every task sends one row per term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for _, _, data, bounds in pieces(batch.column(0)):
                at, term = terms.find(data.view("<u4"))
                row = np.searchsorted(bounds, 4 * at, side="right") - 1
                total += np.bincount(np.unique(row * len(terms) + term) % len(terms), minlength=len(terms))
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([-1, *at], pa.int32()), pa.array([n, *total[at]], pa.int64())], ["term", "n"])

    rows = tokens.select("tokens").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms), np.int64)
    own = rows[rows["term"] >= 0]
    out[own["term"]] = own["n"]
    return out, int(rows.loc[rows["term"] < 0, "n"].sum())


def idf_weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.log((docs + 1) / (df + 1)) + 0.1


def tfidf(raw: bytes, terms: Terms, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of one piece."""
    own, n = np.unique(terms.find(np.frombuffer(raw, "<u4"))[1], return_counts=True)
    return own, n * idf[own]


def latent_basis(cut: DataFrame, terms: Terms, idf: np.ndarray) -> np.ndarray:
    """Terms x ``DIMENSIONS``: right singular vectors of the pieces' TF-IDF matrix by distributed randomised SVD."""
    width = min(DIMENSIONS + EXTRA, len(terms))
    schema = "term int, value binary"

    def gram_product(q: np.ndarray) -> np.ndarray:
        """A' A q, where A has the pieces of unit length as rows; a task sends one partial product."""

        def rows(at: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(at, pa.int32()), binaries([x.tobytes() for x in values])], ["term", "value"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(terms), q.shape[1]))
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    own, weight = tfidf(raw, terms, idf)
                    weight = weight / np.linalg.norm(weight)
                    total[own] += np.outer(weight, weight @ q[own])
            at = np.flatnonzero(total.any(axis=1))
            yield rows(at.tolist(), list(total[at]))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    value = np.frombuffer(raw, np.float64)
                    total[t] = total[t] + value if t in total else value
            yield rows(list(total), list(total.values()))

        out = np.zeros(q.shape)
        parts = cut.select("tokens").mapInArrow(run, schema).repartition("term").mapInArrow(add, schema)
        for r in parts.collect():  # terms x width numbers, bounded by the block of pieces
            out[r["term"]] = np.frombuffer(r["value"], np.float64)
        return out

    q = np.random.default_rng(5).standard_normal((len(terms), width))
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(gram_product(q))
    values, vectors = np.linalg.eigh(q.T @ gram_product(q))
    keep = np.argsort(-values)[:DIMENSIONS]
    return (q @ vectors[:, keep[values[keep] > 1e-9]]).astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        at = row & places.get(x, 0)
        if at:
            row = ((row + at) | (row - at)) & full
    return len(a) - row.bit_count()


def item_answers(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, tokens, answer``: items of enough tokens; the answer is the number of tokens of the last sentence."""
    whole = F.trim(F.coalesce(F.col(text), F.lit("")))
    last = F.element_at(F.split(F.regexp_replace(whole, r"[.!?\s]+$", ""), r"[.!?\n]"), -1)
    answer = F.regexp_count(last, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).alias("answer")
    rows = token_rows(benchmark.select(F.col(key).alias("item"), whole.alias("text"), answer), ["item", "answer"])
    return rows.where(F.octet_length("tokens") >= 4 * LEAST_TOKENS).select("item", "tokens", "answer")


def cut_items(items: list[tuple[object, bytes, int]]) -> list[tuple[int, np.ndarray]]:
    """Item and tokens of each piece: parts of nearly equal length."""
    out = []
    for i, (_, raw, _) in enumerate(items):
        own = np.frombuffer(raw, "<u4")
        out += [(i, part) for part in np.array_split(own, math.ceil(len(own) / PIECE))]
    return out


def search(
    tokens: DataFrame,
    items: list[tuple[object, bytes, int]],
    cut: list[tuple[int, np.ndarray]],
    terms: Terms,
    idf: np.ndarray,
    basis: np.ndarray,
    item_type: str,
) -> DataFrame:
    """Confirmed ``doc_id, item_id, cosine, lcs, answer`` for one block of pieces."""
    own_items = {i: np.frombuffer(items[i][1], "<u4") for i, _ in cut}
    answers = {i: max(0, min(items[i][2], len(s))) for i, s in own_items.items()}
    spans = {i: math.ceil(len(s) / STEP) for i, s in own_items.items()}  # steps that an item may reach beyond a passage
    names = {i: items[i][0] for i in own_items}
    owner = [i for i, _ in cut]
    index = np.zeros((len(cut), basis.shape[1]), np.float32)
    piece_terms = np.full((len(cut), PIECE), len(terms), np.int64)  # one more than the last term: never present
    least, need = np.zeros(len(cut), np.float32), np.zeros(len(cut), np.int64)
    below = np.zeros(len(terms))
    for j, (_, part) in enumerate(cut):
        own, weight = tfidf(part.tobytes(), terms, idf)
        index[j] = weight @ basis[own]
        adds = (basis @ index[j]) * idf  # what one token of each term adds to the product of a passage and the piece
        below = np.maximum(below, -adds)
        term = terms.find(part)[1]
        piece_terms[j, : len(term)] = term
        need[j] = math.ceil(LCS_WITH_ANSWER * len(part) - 1e-9)
        # The tokens that add least and can make up the least subsequence, where a term that the piece repeats may stand
        # once; a hundredth for rounding.
        _, back, count = np.unique(term, return_inverse=True, return_counts=True)
        least[j] = 0.99 * np.sort(np.maximum(adds[term], 0) / count[back])[: need[j]].sum()
    size = np.maximum(np.linalg.norm(index, axis=1), 1e-9)
    # The last column is the most that a token may lower a product with any piece.
    weights = np.column_stack([basis * idf[:, None], 1.01 * below]).astype(np.float32)
    schema = f"doc_id long, item_id {item_type}, cosine double, lcs double, answer double"

    def candidates(tokens: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """Document, negative cosine, step of a passage, item.  Documents are laid out by whole steps one after the other."""
        ends, steps = np.cumsum(sizes), np.maximum(-(-sizes // STEP), STEPS)
        base = np.cumsum(steps) - steps
        at, term = terms.find(tokens)
        doc = np.searchsorted(ends, at, side="right")
        step = base[doc] + (at - (ends - sizes)[doc]) // STEP
        of = np.repeat(np.arange(len(sizes)), steps)
        whole = np.arange(len(of)) + STEPS <= (base + steps)[of]  # a passage that starts here ends in its document
        for low in range(0, len(of), PASSAGES):
            many = min(PASSAGES, len(of) - low)
            a, b = np.searchsorted(step, [low, low + many + STEPS - 1])
            if a == b:
                continue
            s, t = step[a:b] - low, term[a:b]
            begin = np.flatnonzero(np.diff(s, prepend=-1))
            folded = np.zeros((many + STEPS - 1, weights.shape[1]), np.float32)
            folded[s[begin]] = np.add.reduceat(weights[t], begin)
            sums = folded[:many].copy()
            for k in range(1, STEPS):
                sums += folded[k : k + many]
            product = sums[:, :-1] @ index.T
            near = (product >= least - sums[:, -1:]) & whole[low : low + many, None]
            # Which documents hold as many of a piece's tokens, then which of their passages.
            owners = of[low : low + many] - of[low]
            cuts = np.flatnonzero(np.diff(owners, prepend=-1))
            own_doc = doc[a:b] - of[low]
            inside = own_doc < len(cuts)
            held = np.zeros((len(terms) + 1, len(cuts)), np.uint8)
            held[t[inside], own_doc[inside]] = 1
            enough = held.take(piece_terms.T, axis=0).sum(axis=0, dtype=np.uint8) >= need[:, None]
            hold = np.logical_or.reduceat(near, cuts, axis=0) & enough.T
            rows = np.flatnonzero(hold.any(axis=1)[owners])
            passage, piece = np.nonzero(near[rows] & hold[owners[rows]])
            passage = rows[passage]
            if not len(passage):
                continue
            present = np.zeros((many, len(terms) + 1), bool)
            for k in range(STEPS):
                inside = (s >= k) & (s < many + k)
                present[s[inside] - k, t[inside]] = True
            keep = present[passage[:, None], piece_terms[piece]].sum(axis=1) >= need[piece]
            for p, j in zip(passage[keep].tolist(), piece[keep].tolist(), strict=True):
                length = max(float(np.linalg.norm(sums[p, :-1])), 1e-9)
                own = int(of[low + p])
                yield own, -float(product[p, j] / (length * size[j])), int(low + p - base[own]), owner[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for low, _, data, bounds in pieces(batch.column(1)):
                tokens, cuts = data.view("<u4"), bounds // 4
                best: dict[tuple[int, int], tuple] = {}
                seen: set[tuple[int, int, int]] = set()
                for doc, cosine, step, i in sorted(candidates(tokens, np.diff(cuts))):
                    if best.get((doc, i), (0.0,) * 3)[1] >= LCS_ALONE or (doc, step, i) in seen:  # found by another piece
                        continue
                    seen.add((doc, step, i))
                    own, sequence, a, span = tokens[cuts[doc] : cuts[doc + 1]], own_items[i], answers[i], spans[i]
                    region = own[max(0, (step - span) * STEP) : (step + STEPS + span) * STEP]
                    if np.isin(sequence, region).mean() < LCS_WITH_ANSWER:
                        continue
                    common = lcs(sequence, region) / len(sequence)
                    part = lcs(sequence[len(sequence) - a :], region) / a if a else 0.0
                    if common >= LCS_ALONE or (common >= LCS_WITH_ANSWER and part >= ANSWER):
                        best[doc, i] = max(best.get((doc, i), (0.0,) * 3), (-cosine, common, part), key=lambda x: x[1:])
                found += [(ids[low + doc], names[i], *v) for (doc, i), v in best.items()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            columns = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch(columns, ["doc_id", "item_id", "cosine", "lcs", "answer"])

    item_kind = pa.int32() if item_type == "int" else pa.int64() if item_type == "bigint" else pa.string()
    kinds = [pa.int64(), item_kind, pa.float64(), pa.float64(), pa.float64()]
    return tokens.select("doc_id", "tokens").mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer``: confirmed pairs, one row each."""
    one_thread_each(docs.sparkSession)
    tokens = stage(token_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "doc-tokens")
    items = stage(item_answers(benchmark).withColumn("place", F.row_number().over(Window.orderBy("item", "tokens"))), "item-tokens")
    item_type = items.schema["item"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"doc_id long, item_id {item_type}, cosine double, lcs double, answer double")
    for low in range(0, items.count(), ITEMS):  # the query set, block by block
        block = items.where((F.col("place") > low) & (F.col("place") <= low + ITEMS))
        rows = [(r["item"], bytes(r["tokens"]), r["answer"]) for r in block.orderBy("place").collect()]
        terms = Terms(np.concatenate([np.frombuffer(raw, "<u4") for _, raw, _ in rows]))
        idf = idf_weights(*document_frequencies(tokens, terms))
        cut = cut_items(rows)
        for first in range(0, len(cut), RANK):
            part = cut[first : first + RANK]
            own = Terms(np.concatenate([x for _, x in part]))
            weight = idf[terms.find(own.hashes)[1]]
            table = docs.sparkSession.createDataFrame([(x.tobytes(),) for _, x in part], "tokens binary")
            out = out.unionByName(search(tokens, rows, part, own, weight, latent_basis(table, own, weight), item_type))
    best = F.max(F.struct("lcs", "answer", "cosine")).alias("v")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "v.cosine", "v.lcs", "v.answer")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a confirmed benchmark passage, all columns unchanged.  Null ids match nothing."""
    name = fresh_name(docs, "leaked")
    leaked = stage(contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "leaked-ids")
    return docs.join(leaked, docs["doc_id"].cast("long") == F.col(name), "left_anti")
