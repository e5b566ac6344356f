"""Filter audit, block mix and Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from scoremart.llm import filter_audit, merkle, mixing

from .conftest import DOCS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ── filter audit ─────────────────────────────────────────────────────────────────────


def plain_audit(docs, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], int(quality == 1)), max(marks[i][1], int(toxic == 1))]
    least = {}
    for d in docs:
        if d["doc_id"] is not None:
            key = d["text"] or ""
            least[key] = min(least.get(key, d["doc_id"]), d["doc_id"])
    parts = defaultdict(list)
    for d in docs:
        text = d["text"] or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": d["doc_id"] is not None and d["doc_id"] > least[text],
        }
        parts[d["source"] or ""].append(({k for k, v in fails.items() if v}, marks.get(d["doc_id"], [0, 0])))
    report = []
    for part, found in parts.items():
        total, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = list(found)
            for step, f in enumerate(order, 1):
                out, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in found)
                total[f] += len(out)
                alone = sum(x[0] == {f} for x in found)
                good, toxic = sum(x[1][0] for x in out), sum(x[1][1] for x in out)
                steps.append((part, "".join(order), step, len(left), len(out), failing - len(out), alone, good, toxic, f))
        report += [(*x[:9], total[x[9]]) for x in steps]
    return sorted(report)


def test_filter_audit(spark, odd_docs, no_docs, monkeypatch):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(90, 510)] + [(300, 1, 0), (None, 1, 1), (506, None, None), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    want = plain_audit(rows_of(odd_docs), labels)
    for held in (512, 1):
        monkeypatch.setattr(filter_audit, "PARTS_HELD", held)
        found = filter_audit.filter_audit(odd_docs, table)
        assert found.columns == [
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
        ]
        assert sorted(tuple(r) for r in found.collect()) == want
    assert len(want) == 3 * 600 and any(r[4] for r in want) and any(r[7] for r in want)
    assert filter_audit.filter_audit(no_docs, table).count() == 0
    bare = filter_audit.filter_audit(odd_docs, table.limit(0)).collect()
    assert len(bare) == len(want) and not any(r["good_lost"] or r["toxic_lost"] for r in bare)


def test_fields_hold_large_counts(spark):
    many = (1 << 62) - 1
    counts = spark.createDataFrame([("a", 31, 1, 0, many), ("a", 31, 0, 0, 1), ("a", 1, 0, 1, many)], "part string, mask long, good int, toxic int, n long")
    first = {r["filter_order"]: r for r in filter_audit.unpacked(filter_audit.added(filter_audit.packed(counts))).collect() if r["step"] == 1}
    assert first["ABCDE"]["removed"] == 2 * many + 1 and first["BACDE"]["removed"] == many + 1
    assert first["BACDE"]["good_lost"] == many and first["ABCDE"]["toxic_lost"] == many


# ── Merkle manifest ──────────────────────────────────────────────────────────────────


def sha(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def plain_leaf(d):
    return sha(*("-" if d[k] is None else f"{len(str(d[k]).encode())}:{d[k]}" for k in ("doc_id", "source", "lang", "n_chars", "text")))


def plain_tree(nodes):
    """Root, and for each node its siblings on every level."""
    ways, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, below = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in held[at + k]:
                    ways[i].append((run[:k], run[k + 1 :]))
            parents.append(sha(*run))
            below.append([i for x in held[at : at + 3] for i in x])
        nodes, held = parents, below
    return nodes[0], ways


def plain_manifest(docs):
    sources = defaultdict(list)
    for d in docs:
        sources[d["source"]].append((d["doc_id"] is not None, d["doc_id"] or 0, plain_leaf(d), d))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        rows = sorted(sources[name], key=lambda r: r[:3])
        trees[name] = (rows, *plain_tree([r[2] for r in rows]))
    root, tops = plain_tree([trees[name][1] for name in names])
    found = []
    for name, top in zip(names, tops, strict=True):
        rows, subroot, ways = trees[name]
        for (_, _, leaf, d), way in zip(rows, ways, strict=True):
            node = leaf
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 and d["text"] is not None:
                node = plain_leaf({**d, "text": d["text"].replace("\n", "")})
            steps = way + top
            for left, right in steps:
                node = sha(*left, node, *right)
            proof = sha(*(x for left, right in steps for x in left + right))
            found.append((d["doc_id"], leaf, subroot, root, proof, node, node == root))
    return sorted(found, key=repr)


def manifest_rows(docs):
    return sorted((tuple(r) for r in merkle.verified(merkle.manifest(docs)).collect()), key=repr)


def test_manifest(spark, odd_docs, no_docs, monkeypatch):
    want = plain_manifest(rows_of(odd_docs))
    assert any(r[6] for r in want) and not all(r[6] for r in want)
    assert manifest_rows(odd_docs) == want
    # Trees of more than one chunk, placed over several ranges.
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "PLACED", 7)
    assert manifest_rows(odd_docs) == want
    assert manifest_rows(no_docs) == []
    one = odd_docs.where("doc_id = 100")
    (row,) = manifest_rows(one)
    assert row[1] == row[2] == row[3] and row[4] == sha("")


def test_manifest_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    for sizes in ((1, 2, 3), (4, 9, 10), (27, 28, 30), (83,)):
        rows = [(i, f"t\n{i}", "en", "" if s == 1 else f"s{s}", None) for s, n in enumerate(sizes) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert manifest_rows(docs) == plain_manifest(rows_of(docs))


# ── block mix ────────────────────────────────────────────────────────────────────────


def plain_targets(sizes):
    """The level at which sources, each up to twice its size, take 150 % of all words together."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 10.0 * sum(sizes) + 1
    for _ in range(300):
        level = (low + high) / 2
        total = sum(min(2 * n, level * w) for n, w in zip(sizes, weights, strict=True))
        low, high = (level, high) if total < 1.5 * sum(sizes) else (low, level)
    return [min(2 * n, low * w) for n, w in zip(sizes, weights, strict=True)]


def test_targets():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 40):
        for _ in range(20):
            sizes = [rng.choice([0, 1, 10, 1000, 10**9]) * rng.randrange(1, 50) for _ in range(n)]
            assert mixing.targets(np.array(sizes, np.int64)) == pytest.approx(plain_targets(sizes), rel=1e-9, abs=1e-6)
    assert len(mixing.targets(np.zeros(0, np.int64))) == 0


def test_permutations_and_slots(monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 10)
    for n in (1, 2, 3, 64, 65, 1000):
        for turn in (0, 1):
            there = mixing.permuted(np.arange(n), n, 3, turn)
            assert sorted(there) == list(range(n)) and (mixing.inverse(there, n, 3, turn) == np.arange(n)).all()
    assert (mixing.permuted(np.arange(1000), 1000, 3, 0) != mixing.permuted(np.arange(1000), 1000, 3, 1)).any()
    for words in (1, 9, 10, 11, 47, 200):
        blocks = -(-words // 10)
        block_words = [min(10, words - 10 * b) for b in range(blocks)]
        for take in range(2 * words + 1):
            n, last = mixing.slots_for(1, words, take)
            order = [b for turn in (0, 1, 2) for b in mixing.permuted(np.arange(blocks), blocks, 1, turn)]
            given = [block_words[b] for b in order[:n]]
            assert not n or 0 < last and sum(given[:-1]) + min(last, given[-1]) == take
            assert n or not take


def mix_docs(spark, seed=4):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 200])), rng.choice(["a", "a", "a", "b", "c", "", None])) for i in range(150)]
    rows += [(500, None, "a"), (501, " ", "only empty"), (None, "x y z", "b"), (None, None, None), (7, "again and again", "b")]
    rows += [(900, "same row here", "c")] * 40 + [(901, prose(rng, 3000), "d")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mix(spark, monkeypatch):
    for name, value in (("BLOCK_WORDS", 16), ("SHARD_SLOTS", 8), ("BUCKET_DOCS", 20)):
        monkeypatch.setattr(mixing, name, value)
    docs, rows = mix_docs(spark)
    size = lambda text: len(WORD.findall(text or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(t) for _, t, s in rows if s == name) for name in sources]
    targets = dict(zip(sources, mixing.targets(np.array(sizes, np.int64)), strict=True))
    numbered, pieces = mixing.mix_sources(docs)
    pieces = pieces.cache()
    found = [r.asDict() for r in mixing.taken_words(numbered, pieces).collect()]
    key = lambda r: (str(r[0]), *r[1:])
    want = [(i, size(t), sizes[sources.index(s)], targets[s]) for i, t, s in rows]
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in found), key=key) == sorted(want, key=key)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    # Every slot by brute force: blocks cut from the pieces in order, taken as the permutations say.
    held = pieces.select("number", "block", "at", "doc_id", "content", "copy", "first", "words").distinct().collect()
    blocks = defaultdict(dict)
    for r in held:
        for k in range(r["words"]):
            place = (r["block"] * 16 + r["at"] + k)
            assert place not in blocks[r["number"]]
            blocks[r["number"]][place] = (r["doc_id"], r["content"], r["copy"], r["first"] + k)
    taken = Counter()
    for number, name in enumerate(sources):
        n, words = sizes[number], blocks[number]
        assert sorted(words) == list(range(n)) and len(set(words.values())) == n
        goal, count, turn = int(targets[name] + 0.5), -(-n // 16), 0
        while goal:
            for b in mixing.permuted(np.arange(count), count, number, turn):
                for place in range(b * 16, min(n, b * 16 + 16, b * 16 + goal)):
                    taken[(number, *words[place])] += 1
                    goal -= 1
            turn += 1
    given = Counter()
    for r in pieces.where("given > 0").collect():
        for k in range(r["given"]):
            given[(r["number"], r["doc_id"], r["content"], r["copy"], r["first"] + k)] += 1
    assert given == taken
    # Shards hold no more slots than they may, and sources come mixed.
    slots = pieces.where("shard is not null").select("shard", "slot", "number").distinct().collect()
    shards = Counter(r["shard"] for r in slots)
    assert max(shards.values()) <= 8 * len(sources) and sum(len({r["number"] for r in slots if r["shard"] == s}) > 1 for s in shards) > len(shards) / 2
    # Texts, word for word.
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(WORD.findall(t or ""))
    total = 0
    for r in mixing.mixed_texts(docs, pieces).collect():
        words = WORD.findall(r["text"])
        total += len(words)
        assert len(words) == r["words"] and any(" ".join(words) in " ".join(x) for x in texts[r["doc_id"]])
    assert total == sum(int(t + 0.5) for t in targets.values())
    # The same rows dealt out otherwise.
    other = [r.asDict() for r in mixing.taken_words(*mixing.mix_sources(docs.repartition(7))).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, other))


def test_mix_of_odd_tables(spark, odd_docs, no_docs):
    assert mixing.taken_words(*mixing.mix_sources(no_docs)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.taken_words(*mixing.mix_sources(empty)).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    found = mixing.taken_words(*mixing.mix_sources(odd_docs))
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = found.collect()
    assert len(rows) == odd_docs.count() and abs(sum(r["taken"] for r in rows) - 1.5 * sum(r["size"] for r in rows)) <= 3
