"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Equal sets form one class.  For the others, sizes are cut into bands; in a band, tokens (shingle hashes) are hashed into
segments.  Two sets of similarity t differ in at most H tokens, so that segments whose allowances add up to more than H
must contain one that differs by less than its allowance: segments of allowance 1 are matched on their subset of tokens,
those of allowance 2 also on each subset without one token.  Numbers and allowances of segments are chosen for each band
by the cost of signatures and of wrong matches at the band's number of documents.  Segments are more than needed by a
spare allowance, half of which each set may give away: it stays silent about its empty segments, and then about those
whose signatures most other sets have, so that words that very many documents share bring no pairs together.  Only a
set with more empty segments than its allowance covers emits them, and then it gives nothing away.

A set of size s emits the signatures of its own band and of each lower band that holds sizes of at least t * s.
Documents that share a signature are linked by stars around the most frequent set; exact checks on the texts turn
candidates into links, links into components, and pairs of a signature that lie in different components are then checked
too, so that no link that would join components is lost, while groups of copies never expand into all pairs.

Documents without words have no tokens and link with nothing; fewer words than a shingle count as one token; null text
is empty.  A set that only rows of null id have never links; a null id takes the component of equal sets with an id, else
null; rows that share an id are one document in links; an empty table gives an empty result; other columns are kept by ``one_of_each`` and ignored otherwise.
Sets are told apart by 64-bit hashes of their tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, fresh_name, pieces, stage
from .links import components
from .words import chain, lower_ascii, mix, split_words, word_hashes

#: Sets of a signature up to which pairs of different components are rows, and sets of a block of a larger family.
FEW = 24
BLOCK = 400


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link at ``percent`` / 100 or more."""

    words: int = 5
    percent: int = 80


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high`` - 1; ``ones`` and ``twos`` segments of allowance 1 and 2, the latter twice as large."""

    low: int
    high: int
    ones: int
    twos: int
    spare: int

    @property
    def segments(self) -> int:
        return self.ones + self.twos


def most_difference(total: int, percent: int) -> int:
    """Most differing tokens of two linked sets whose sizes add up to ``total`` or less."""
    return max(s - 2 * -(-percent * s // (100 + percent)) for s in range(max(0, total - 3), total + 1))


def band_edges(largest: int, percent: int) -> list[int]:
    """Band limits from the least size that can link with another set up to ``largest``."""
    edges = [-(-percent // (100 - percent))]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent))
    return edges


def allocate(low: int, high: int, percent: int, docs: int) -> Band:
    """The cheapest segments of a band: signatures per set, plus pairs that match only on an empty segment."""
    biggest = high - 1
    need = most_difference(biggest + biggest * 100 // percent, percent) + 1
    best, price = Band(low, high, need, 0, 0), math.inf
    spares = {0, 2, 4, 6, 8, 12, *(2 * math.ceil(need * share / 200) for share in range(5, 65, 5))}
    # Some spare is for frequent words, whatever the empty segments need.
    for spare in sorted(x for x in spares if x >= need // 8):
        units = need + spare
        for twos in sorted({0, 1, 2, 3, units // 8, units // 4, units // 2, (units + 1) // 2}):
            ones = max(0, units - 2 * twos)
            load = low / (ones + 2 * twos)
            signatures = ones + twos * (2 + 2 * load)
            empty = ones * math.exp(-load) + twos * math.exp(-2 * load)
            loud = above(empty, spare // 2 // (2 if twos else 1))  # at the sizes of least allowance
            cost = signatures + loud * (1 + docs * loud)
            if cost < price:
                best, price = Band(low, high, ones, twos, spare), cost
    return best


def above(mean: float, k: int) -> float:
    """Probability that a Poisson number exceeds ``k``."""
    if mean > 600:
        return 0.5 * math.erfc((k + 0.5 - mean) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct tokens of each text of a piece."""
    data = lower_ascii(data)
    starts, ends, row = split_words(data, bounds)
    hashes = word_hashes(data, starts, ends)
    cut = np.searchsorted(row, np.arange(len(bounds)))
    tokens = chain(hashes, words) if len(hashes) >= words else hashes[:0]
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(tokens[a : b - words + 1]))
        elif b > a:
            out.append(chain(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(hashes[:0])
    return out


def set_key(tokens: np.ndarray) -> int | None:
    """A signed 64-bit hash of a set; none for the empty set."""
    return int(mix(mix(tokens).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0]) if len(tokens) else None


def set_sizes(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n, key`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in pieces(batch.column(1)):
                sets = shingle_sets(data, bounds, rule.words)
                columns = [
                    batch.column(0).slice(low, high - low),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([set_key(x) for x in sets], pa.int64()),
                ]
                yield pa.record_batch(columns, ["doc_id", "n", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key long")


def allowance(size: int, own: bool, band: Band, percent: int) -> int:
    """What a set of ``size`` may give away in a band: half of what the segments allow beyond the differences that a
    linked set can have there.  ``own``: the band holds ``size``; else it holds the smaller set."""
    other = size * 100 // percent if own else band.high - 1
    return max(0, (band.ones + 2 * band.twos - most_difference(size + other, percent) - 1) // 2)


def signatures(tokens: np.ndarray, number: int, band: Band, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of one set in one band, the segment of each, and what the set may still give away."""
    scattered = mix(tokens + np.uint64(0x51ED2701 * (number + 1)))
    place = (scattered % np.uint64(band.ones + 2 * band.twos)).astype(np.int64)
    place = np.where(place < band.ones, place, band.ones + (place - band.ones) // 2)
    value = mix(scattered)
    sums = np.zeros(band.segments, np.uint64)
    np.add.at(sums, place, value)
    count = np.bincount(place, minlength=band.segments)
    salt = mix(np.arange(band.segments, dtype=np.uint64) + np.uint64((number + 1) << 32))
    empty = count == 0
    left = allowance(len(tokens), band.low <= len(tokens) < band.high, band, percent)
    left -= int(empty[: band.ones].sum() + 2 * empty[band.ones :].sum())
    at = np.flatnonzero(~empty) if left >= 0 else np.arange(band.segments)
    made, segment = [mix(sums + salt)[at]], [at]
    if band.twos:
        wide = place >= band.ones
        made.append(mix(sums[place[wide]] - value[wide] + salt[place[wide]]))
        segment.append(place[wide])
    return np.concatenate(made), np.concatenate(segment), max(0, left)


def bands_of(size: int, bands: list[Band], percent: int) -> list[int]:
    """The band that holds ``size`` and those below that hold sizes of at least the similarity times it."""
    least = -(-percent * size // 100)
    return [i for i, b in enumerate(bands) if b.low <= size and b.high > least]


def signature_rows(docs: DataFrame, rule: Rule, bands: list[Band]) -> DataFrame:
    """``signature, key, slot``: each set's signatures once per task.  The slot names band, segment and what may be given
    away, in 16, 24 and 24 bits."""
    lows = np.array([b.low for b in bands])
    names = ["signature", "key", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, _, data, bounds in pieces(batch.column(0)):
                made, keys, slots = [], [], []
                for tokens in shingle_sets(data, bounds, rule.words):
                    if not len(bands) or len(tokens) < lows[0]:
                        continue
                    key = set_key(tokens)
                    if key in seen:
                        continue
                    seen.add(key)
                    for i in bands_of(len(tokens), bands, rule.percent):
                        found, segment, left = signatures(tokens, i, bands[i], rule.percent)
                        made.append(found.view(np.int64))
                        keys.append(np.full(len(found), key, np.int64))
                        slots.append((i << 48) + (segment << 24) + left)
                if made:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (made, keys, slots)], names)

    return docs.select("text").mapInArrow(run, "signature long, key long, slot long")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """``signature, key, slot`` of the signatures that different sets share.  Rows arrive sorted and are passed through one
    by one, so that a signature of very many sets needs no memory."""
    names = ["signature", "key", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, ...] | None = None  # the last row, not yet known to be shared
        shared = False
        for batch in batches:
            columns = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(3)]
            if held is not None:
                columns = [np.concatenate([[h], c]) for h, c in zip(held, columns, strict=True)]
            s, k = columns[:2]
            if not len(s):
                continue
            first = np.ones(len(s), bool)
            first[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
            columns = [c[first] for c in columns]
            s = columns[0]
            left = np.zeros(len(s), bool)
            left[1:] = s[1:] == s[:-1]
            left[0] = held is not None and shared
            right = np.zeros(len(s), bool)
            right[:-1] = s[1:] == s[:-1]
            keep = left | right
            held, shared = tuple(int(c[-1]) for c in columns), bool(keep[-1])
            keep[-1] = False
            if keep.any():
                yield pa.record_batch([pa.array(c[keep]) for c in columns], names)
        if held is not None and shared:
            yield pa.record_batch([pa.array([x], pa.int64()) for x in held], names)

    dealt = rows.repartition("signature").sortWithinPartitions("signature", "key")
    return dealt.select(*names).mapInArrow(run, "signature long, key long, slot long")


def without_frequent(shared: DataFrame, bands: list[Band]) -> DataFrame:
    """``signature, key`` without the segments that sets give away: those whose signatures most sets have."""
    twos = F.coalesce(F.element_at(F.array(*(F.lit(b.ones) for b in bands)), F.col("band") + 1), F.lit(0)) if bands else F.lit(0)
    often = shared.groupBy("signature").agg(F.count("*").alias("sets"))
    rows = shared.join(often, "signature").select(
        "signature",
        "key",
        "sets",
        F.shiftright("slot", 48).cast("int").alias("band"),
        F.shiftright("slot", 24).bitwiseAND(F.lit((1 << 24) - 1)).alias("segment"),
        F.col("slot").bitwiseAND(F.lit((1 << 24) - 1)).alias("left"),
    )
    segments = rows.groupBy("key", "band", "segment").agg(F.max("sets").alias("sets"), F.max("left").alias("left"))
    units = F.when(F.col("segment") < twos, 1).otherwise(2)
    spent = F.sum(units).over(Window.partitionBy("key", "band").orderBy(F.col("sets").desc(), "segment"))  # one set's segments
    kept = segments.withColumn("spent", spent).where(F.col("spent") > F.col("left")).select("key", "band", "segment")
    return rows.join(kept, ["key", "band", "segment"], "left_semi").select("signature", "key")


def class_texts(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """``node, key, text``: one text for each set of ``wanted`` (``node, key``).  Rows that share an id arrive in order, so
    that texts are exchanged once; where a very frequent id is split over tasks, each may give its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for low, high, data, bounds in pieces(batch.column(2)):
                part, keep = batch.slice(low, high - low), []
                own = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                for pair, tokens in zip(own, shingle_sets(data, bounds, rule.words), strict=True):
                    keep.append(pair != last and set_key(tokens) == pair[1])
                    last = pair if keep[-1] else last
                yield part.filter(pa.array(keep, pa.bool_()))

    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    found = own.join(wanted, "node").select("node", "key", "text").sortWithinPartitions("node", "key")
    return found.mapInArrow(run, "node long, key long, text string")


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``a, b`` of the pairs of keys whose sets link, by the tokens of the two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in pieces(batch.column(3)):
                part = batch.slice(low, high - low)
                left = part.column(0).to_pylist()
                new = [i for i, x in enumerate(left) if i == 0 or x != left[i - 1]]
                first = shingle_sets(*binary_column(part.column(2).take(pa.array(new))), rule.words)
                second = shingle_sets(data, bounds, rule.words)
                keep, at = [], -1
                for i in range(len(left)):
                    at += at + 1 < len(new) and new[at + 1] == i
                    x, y = first[at], second[i]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= rule.percent * (len(x) + len(y) - common))
                yield pa.record_batch(part.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def linked_classes(docs: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """``key, component``: component (least document id) of every set that is linked with another one."""
    classes = sizes.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("n").alias("n")
    )
    classes = stage(classes.where(F.col("node").isNotNull()), "jaccard-classes")
    largest = classes.agg(F.max("n")).first()[0] or 0
    edges = band_edges(largest, rule.percent)
    number = F.lit(0)
    for e in edges[1:]:
        number = number + (F.col("n") >= e).cast("int")
    per_band = {r[0]: r[1] for r in classes.groupBy(number.alias("band")).count().collect()}  # some dozens of bands
    bands = [allocate(lo, hi, rule.percent, per_band.get(i, 0)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]

    met = stage(shared_signatures(signature_rows(docs, rule, bands)), "jaccard-signatures")
    shared = without_frequent(met, bands)
    groups = shared.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature")
    shared = stage(shared.join(groups, "signature", "left_semi"), "jaccard-shared")
    members = stage(classes.join(shared.select("key").distinct(), "key"), "jaccard-members")
    texts = stage(class_texts(docs, members.select("node", "key"), rule), "jaccard-texts")

    # Stars: the set with most copies of each signature against the others, seen in order and never collected.
    ordered = Window.partitionBy("signature").orderBy(F.col("copies").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = shared.join(members.select("key", "copies"), "key").withColumn("centre", F.first("key").over(ordered))
    stars = ranked.where(F.col("key") != F.col("centre")).select(
        F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")
    )
    stars = stage(stars.distinct(), "jaccard-stars")
    links = stage(verified(stars, texts, rule), "jaccard-links")

    # Pairs that share a signature but not yet a component.
    nodes = members.select("key", "node")
    by_key = lambda found: nodes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    ends = lambda found: (
        found.join(nodes.select(F.col("key").alias("a"), F.col("node").alias("x")), "a")
        .join(nodes.select(F.col("key").alias("b"), F.col("node").alias("y")), "b")
        .select("x", "y")
    )
    now = by_key(components(ends(links), "x", "y"))
    placed = stage(shared.join(now, "key"), "jaccard-placed")
    sizes_of = placed.groupBy("signature").agg(
        F.count("*").alias("sets"), (F.min("component") != F.max("component")).alias("mixed")
    )
    mixed = stage(placed.join(sizes_of.where("mixed"), "signature").drop("mixed"), "jaccard-mixed")
    few = mixed.where(F.col("sets") <= FEW)
    left = few.select("signature", F.col("component").alias("p"), F.col("key").alias("x"))
    right = few.select("signature", F.col("component").alias("q"), F.col("key").alias("y"))
    cross = left.join(right, "signature").where("p < q")
    cross = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = verified(cross.join(stars, ["a", "b"], "left_anti"), texts, rule)
    more = more.unionByName(family_links(mixed.where(F.col("sets") > FEW), texts, rule))
    return stage(by_key(components(ends(links.unionByName(more)), "x", "y")), "jaccard-components")


def family_links(rows: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: links between sets of different components that share a signature with many others.

    Sets that such signatures connect form families.  A family is cut into blocks of some ``BLOCK`` sets; every two
    blocks meet in one task, which counts common tokens as products of incidence matrices and passes on only links that
    join components, at most one for each set.  Pairs never become rows.
    """
    centre = rows.groupBy("signature").agg(F.min("key").alias("centre"))
    spokes = rows.join(centre, "signature").where("key <> centre").select("key", "centre").distinct()
    family = components(spokes, "key", "centre").select(F.col("node").alias("key"), F.col("component").alias("family"))
    blocks = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = rows.select("key", "component").distinct().join(family, "key").join(blocks, "family")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    met = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", F.col("component").alias("part")
    )

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        data, bounds = binary_column(pa.array(group["text"], pa.string()))
        sets = shingle_sets(data, bounds, rule.words)
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = count >= 2  # a token of one set is common to none
        number = np.cumsum(often) - 1
        use = often[column]
        row, column = row[use], number[column[use]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(often.sum()), 4096):
            here = (column >= low) & (column < low + 4096)
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[here], column[here] - low] = 1
            common += part @ part.T
        linked = 100 * common.astype(np.int64) >= rule.percent * (size[:, None] + size[None, :] - common.astype(np.int64))
        component = group["part"].to_numpy()
        linked &= component[:, None] < component[None, :]
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        keys, out = group["key"].tolist(), []
        for x, y in np.argwhere(linked).tolist():
            p, q = find(int(component[x])), find(int(component[y]))
            if p != q:
                root[p] = q
                out.append((keys[x], keys[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    joined = met.join(texts.select("key", "text"), "key")
    return joined.groupBy("family", "i", "j").applyInPandas(solve, "a long, b long")


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    sizes = stage(set_sizes(docs, rule), "jaccard-sizes")
    linked = linked_classes(docs, sizes, rule)
    # Equal sets share the least id of their class; sets that are linked, that of their component.
    least = sizes.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"))
    found = least.join(linked, "key", "left").select("key", F.coalesce("component", "least").alias("component"))
    joined = sizes.join(found, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, all columns unchanged.  Rows that share an id stay or
    go together; rows with a null id stay."""
    placed = jaccard_components(docs, rule)
    name = fresh_name(docs, "dropped")
    gone = placed.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stage(gone, "jaccard-dropped"), docs["doc_id"].cast("long") == F.col(name), "left_anti")
