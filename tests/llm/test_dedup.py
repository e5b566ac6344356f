"""Near duplicates, repeated strings and benchmark passages against brute force."""

import random
import re

import numpy as np
import pytest
from scoremart.llm import decontaminate, jaccard_join, links, suffix_dedup, suffix_sort

from .conftest import DOCS, odd_texts, prose


def table(spark, rows):
    return spark.createDataFrame([(i, x, "en", "a", None, "m", "k", "t", 1, 2) for i, x in rows], DOCS).repartition(3)


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(rows, n, percent):
    sets = [(i, shingles(x, n)) for i, x in rows]
    label = {k: k for k in {(i, s) for i, s in sets}}
    nodes = list(label)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            (i, x), (j, y) = nodes[a], nodes[b]
            same_row = i is not None and i == j
            if x and y and (same_row or 100 * len(x & y) >= percent * len(x | y)):
                label[root(nodes[a])] = root(nodes[b])
    out = []
    for i, s in sets:
        ids = [j for j, t in nodes if j is not None and s and root((j, t)) == root((i, s))]
        out.append((i, len(s), min(ids) if s and ids else i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rule", [jaccard_join.Rule(4, 85), jaccard_join.Rule(5, 80), jaccard_join.Rule(2, 60)])
def test_components_equal_all_pairs(spark, odd_docs, rule):
    found = jaccard_join.jaccard_components(odd_docs, rule).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_components(odd_texts(), rule.words, rule.percent)


@pytest.mark.parametrize("few", [24, 1])
def test_chains_and_small_sets(spark, monkeypatch, few):
    """With pairs as rows and as blocks of families: links at every size near the threshold, chains whose ends do not link, and a family without a common centre."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = random.Random(8)
    rows, i = [], 0
    for size in [*range(1, 30), 40, 55, 70, 111]:
        words = [f"v{rng.randrange(10**6)}" for _ in range(size + 3)]
        for _ in range(6):
            rows.append(((i * 37) % 1009, " ".join(words)))
            i += 1
            words = list(words)
            if rng.random() < 0.5:
                words[-1] = f"u{rng.randrange(10**6)}"
            else:
                words.append(f"u{rng.randrange(10**6)}")
    found = jaccard_join.jaccard_components(table(spark, rows), jaccard_join.Rule(4, 85)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_components(rows, 4, 85)


def left_over(tokens, bands, percent, frequent):
    """Signatures of a set after it gave segments away, those with ``frequent`` signatures first."""
    out = set()
    for i in jaccard_join.bands_of(len(tokens), bands, percent):
        made, segment, left = jaccard_join.signatures(tokens, i, bands[i], percent)
        first = sorted(set(segment.tolist()), key=lambda s: (not any(m in frequent for m in made[segment == s].tolist()), s))
        gone, spent = set(), 0
        for s in first:
            spent += 1 if s < bands[i].ones else 2
            if spent > left:
                break
            gone.add(s)
        out |= {m for m, s in zip(made.tolist(), segment.tolist(), strict=True) if s not in gone}
    return out


def test_every_linked_pair_shares_a_signature():
    """The pigeonhole itself, for pairs at the threshold, with few and with many empty segments."""
    rng = np.random.default_rng(3)
    for percent in (85, 80, 60):
        edges = jaccard_join.band_edges(400, percent)
        bands = [jaccard_join.allocate(a, b, percent, 1000) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for _ in range(400):
            a = rng.integers(0, 2**63, int(rng.integers(edges[0], 300))).astype(np.uint64)
            common = len(a)
            extra = int(rng.integers(0, common * (100 - percent) // percent + 1))
            drop = max(0, int((100 * common - percent * (common + extra)) // 100))
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, extra).astype(np.uint64)])
            both = len(a) - drop
            if 100 * both < percent * (len(a) + len(b) - both) or len(b) < edges[0]:
                continue
            x, y = (
                left_over(np.unique(t), bands, percent, common) for t in (a, b) for common in [set()]
            )
            assert x & y, (percent, len(a), len(b), both)
            # What both give away first is what they share: the worst choice.
            x, y = (left_over(np.unique(t), bands, percent, x & y) for t in (a, b))
            assert x & y, (percent, len(a), len(b), both)


def test_one_of_each_keeps_columns(spark, odd_docs, no_docs):
    rule = jaccard_join.Rule(5, 80)
    kept = jaccard_join.one_of_each(odd_docs, rule)
    assert kept.columns == odd_docs.columns
    gone = {i for i, _, c in brute_components(odd_texts(), 5, 80) if i is not None and c != i}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in odd_texts() if i not in gone)
    assert jaccard_join.one_of_each(no_docs, rule).count() == 0
    assert jaccard_join.jaccard_components(no_docs, rule).count() == 0


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(a, a + 1) for a in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs += [(5, 5), (None, 3), (7, None)]
    label = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = label.get(a, {a}), label.get(b, {b})
            for k in x | y:
                label[k] = x | y
    found = links.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in found} == {k: min(v) for k, v in label.items()} and len(found) == len(label)


def test_suffix_array_by_induced_sorting():
    rng = random.Random(1)
    for t in range(400):
        letters = rng.choice([1, 2, 3, 6])
        s = bytes(rng.randrange(letters) + rng.choice([0, 97]) for _ in range(rng.randint(1, 60))) * (4 if t % 5 == 0 else 1)
        text = np.frombuffer(s, np.uint8)
        assert suffix_sort.suffix_array(text, 300).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        cut = [s[i : i + 6] for i in suffix_sort.suffix_array(text, 6)]
        assert cut == sorted(cut)
        order = suffix_sort.suffix_array(text, 20)
        match = suffix_sort.permuted_match(text, order, 9)
        for a, b in zip(order[:-1], order[1:], strict=True):
            if max(a, b) + 9 <= len(s):
                assert match[b] == (s[a : a + 9] == s[b : b + 9])


def brute_removal(rows, characters=False):
    first = {}
    for i, x in rows:
        b = (x or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, x in rows:
        b = (x or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        if characters:
            at = 0
            for c in x or "":
                n = len(c.encode())
                gone[at : at + n] = [all(gone[at : at + n])] * n
                at += n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_removed_bytes_equal_all_pairs(spark, odd_docs, no_docs, monkeypatch, hot):
    import hashlib

    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    found = suffix_dedup.removal_digests(odd_docs).collect()
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_removal(odd_texts())]
    assert sorted((tuple(r) for r in found), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.removal_digests(no_docs).count() == 0


class Rows:
    """Batches that functions for Spark's tasks are run on at once."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))


def test_a_shard_is_sorted_in_pieces():
    """Memory of a shard: some times its bytes, not some 50 times; the same windows as by brute force."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    size, share = 2 << 20, 100_000
    old = rng.randbytes(size).hex().encode()[:size]
    new = rng.randbytes(size).hex().encode()[: size - share] + old[1000 : 1000 + share]
    part = pa.record_batch([pa.array([old, new, old]), pa.array([1, 2, 3])], ["text", "doc_id"])
    known = len(np.unique(np.concatenate([r.anchor for r in suffix_dedup.block_runs(part.column(0), np.ones(3, bool))])))
    codes = [{"codes": suffix_dedup.squeeze(bytes([suffix_dedup.SHARED]) * known)}]
    blocks = Rows(pa.record_batch([pa.array([0]), pa.array([suffix_dedup.write_batch(part)]), pa.array([codes])], ["block", "rows", "codes"]))
    (sent,) = suffix_dedup.cut_runs(blocks, 1, 1)
    row = tuple(sent.column(i)[0].as_py() for i in (1, 2, 3))
    contents = len(b"".join(suffix_dedup.part_words(row[1])))
    tracemalloc.start()
    found = suffix_dedup.solve_shard([row])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert contents > 8 << 20 and peak < 30 * contents
    (_, spans), covered = found[0], [set(), set(), set()]
    for line, start, n in zip(*(x.tolist() for x in suffix_dedup.unpack_numbers(spans)), strict=True):
        covered[line].update(range(start, start + n))
    assert covered == [set(), set(range(size - share, size - 49)), set(range(size - 49))]


def test_frequent_anchors_count_by_windows(monkeypatch):
    """Their runs are sent as single windows, which shards must have room for."""
    import pyarrow as pa

    def runs(hot):
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
        packed = suffix_dedup.pack_numbers(*(np.array([x], np.uint64) for x in (7, 60, 1)))
        sent = Rows(pa.record_batch([pa.array([0]), pa.array([0]), pa.array([packed])], ["block", "bucket", "packed"]))
        sent.repartition = lambda *a: sent
        sent.sortWithinPartitions = lambda *a: sent
        return suffix_dedup.shared_anchors(sent, 1)[0].column(3).to_pylist()

    assert runs(60) == [60]
    assert runs(59) == [60 * (suffix_dedup.REACH // 2)]


def test_a_bucket_is_compared_in_ranges_of_anchors():
    """Memory of a bucket: some 30 bytes for each anchor, not some 80; the same codes as one by one."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    blocks = [np.unique(rng.integers(1, 3_000_000, 600_000).astype(np.uint64)) for _ in range(6)]
    some = [rng.integers(0, 9, len(x)).astype(np.uint64) for x in blocks]
    packed = [suffix_dedup.pack_numbers(np.diff(x, prepend=np.uint64(0)), n * 1000 + 1, n == 8) for x, n in zip(blocks, some, strict=True)]
    sent = Rows(pa.record_batch([pa.array(range(6)), pa.array([0] * 6), pa.array(packed)], ["block", "bucket", "packed"]))
    sent.repartition = lambda *a: sent
    sent.sortWithinPartitions = lambda *a: sent
    tracemalloc.start()
    found = suffix_dedup.shared_anchors(sent, 1)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * sum(map(len, blocks))
    runs, times, several = np.zeros(3_000_000, np.int64), np.zeros(3_000_000, np.int64), np.zeros(3_000_000, bool)
    for x, n in zip(blocks, some, strict=True):
        at = x.astype(np.int64)
        runs[at] += n.astype(np.int64) * 1000 + 1
        times[at] += 1
        several[at] |= n == 8
    want = np.where((times > 1) | several, np.where(runs > suffix_dedup.HOT_RUNS, 2, 1), 0)
    for i, x in enumerate(blocks):
        codes = np.frombuffer(suffix_dedup.loosen(found.column(2)[i].as_py()), np.uint8)
        assert (codes == want[x.astype(np.int64)]).all()


def test_cut_texts_keep_whole_characters(spark, odd_docs, no_docs):
    found = suffix_dedup.without_repeats(odd_docs)
    assert found.columns == odd_docs.columns
    want = [(i, None if x is None else kept.decode()) for (i, x), (_, _, _, _, kept) in zip(odd_texts(), brute_removal(odd_texts(), True), strict=True)]
    rows = found.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["key"] == "k" for r in rows)
    assert suffix_dedup.without_repeats(no_docs).count() == 0


def test_lcs():
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.lcs(np.array(a), np.array(b)) == row[-1]


def test_decontamination_finds_copies_and_paraphrases(spark, odd_docs, no_docs):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.choice([12, 30, 50]), 10**6)) for k in range(12)]
    rows, want = [], set()
    for k, text in items:
        words = text.split()
        light = [w if j % 9 != 4 else "other" for j, w in enumerate(words)]
        loose = [w for j, w in enumerate(words) if j % 10 != 3]
        for d, own in enumerate((words, light, loose, [w.upper() + "!" for w in words])):
            rows.append((1000 + 10 * k + d, prose(rng, 80) + " " + " ".join(own) + " " + prose(rng, 200)))
            want.add((1000 + 10 * k + d, k))
    clean = [(2000 + k, prose(rng, 300)) for k in range(30)] + [(2100 + k, " ".join(items[k][1].split()[:4])) for k in range(12)]
    extra = [(50, None), (51, ""), (52, "a b"), (None, items[0][1])]
    benchmark = spark.createDataFrame([(k, x, 1) for k, x in items + extra], "item_id long, text string, doc_id long")
    docs = table(spark, rows + clean + odd_texts())
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["item_id"] is not None} == want
    assert len({(r["doc_id"], r["item_id"]) for r in found}) == len(found)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in clean + odd_texts())
    none = benchmark.where("item_id < 0")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.contaminated(no_docs, benchmark).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def decoys(rng, items):
    """Texts around the copies, and texts of the same words in another order."""
    words = [w for _, x in items for w in x.split()]
    return [(3000 + k, " ".join(rng.choice(words) for _ in range(300))) for k in range(20)]


def test_decontamination_finds_long_items(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, n, 3000)) for k, n in enumerate((70, 130, 200, 320, 500, 1000))]
    rows, want = decoys(rng, items), set()
    for k, text in items:
        words = text.split()
        replaced = [w if j % 5 != 4 else f"other{rng.randrange(10**6)}" for j, w in enumerate(words)]
        added = [x for j, w in enumerate(words) for x in ([w, f"more{rng.randrange(10**6)}"] if j % 6 == 5 else [w])]
        for d, own in enumerate((words, replaced, added)):
            rows.append((10 * k + d, prose(rng, 50 + 7 * d) + " " + " ".join(own) + " " + prose(rng, 90)))
            want.add((10 * k + d, k))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(table(spark, rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


@pytest.mark.parametrize("rank", [512, 7])
def test_decontamination_finds_items_without_their_rare_words(spark, monkeypatch, rank):
    """What the confirmation accepts stays a candidate, however little weight is left and in however many blocks it is searched."""
    monkeypatch.setattr(decontaminate, "RANK", rank)
    rng = random.Random(13)
    common = [f"c{i}" for i in range(150)]
    items = [(k, " ".join(f"rare{k}x{j}" if j % 4 == 1 else rng.choice(common) for j in range(n))) for k, n in enumerate([24, 32, 44, 60, 100] * 2)]
    filler = [(1000 + k, " ".join(rng.choice(common) for _ in range(300))) for k in range(60)]
    rows, want = [], set()
    for k, text in items:
        own = " ".join(w if not w.startswith("rare") else f"new{rng.randrange(10**6)}" for w in text.split())
        rows.append((k, " ".join(rng.choice(common) for _ in range(37 + k)) + " " + own + " " + prose(rng, 60)))
        want.add((k, k))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(table(spark, rows + filler), benchmark).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in found}


def test_decontamination_searches_in_fewer_directions_than_pieces(spark, monkeypatch):
    """The basis decides the cosines; whatever it leaves out, no pair is lost."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words) if j % 3 else f"own{k}x{j}" for j in range(24 + k))) for k in range(24)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(20 + 3 * k)) + " " + x + " " + x[:40] + " " + prose(rng, 70)) for k, x in items]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {}
    for directions in (3, 10, 500):
        monkeypatch.setattr(decontaminate, "DIMENSIONS", directions)
        result = decontaminate.contaminated(table(spark, rows + odd_texts()), benchmark).collect()
        found[directions] = {(r["doc_id"], r["item_id"]): (r["lcs"], r["answer"], round(r["cosine"], 4)) for r in result}
    want = {(k, k) for k, _ in items}
    assert want <= set(found[500]) and all({p: v[:2] for p, v in f.items()} == {p: v[:2] for p, v in found[500].items()} for f in found.values())
    assert any(found[3][p][2] != found[10][p][2] for p in want) and any(found[10][p][2] != found[500][p][2] for p in want)
