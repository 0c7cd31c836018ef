"""Hard negatives, spelling variants and packing against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from edge_cases import LONG, TEXTS, documents, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetledger.llm import hard_negatives, queries, sequence_packing, spelling_variants

# ---- hard negatives


def integers(vector):
    return [int(np.floor(256 * float(np.float32(x)))) for x in vector]


def negatives_by_loop(rows, is_anchor, positives=5, negatives=10, window=(30, 90)):
    good = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x) < 2**17 for x in v)]
    good = [(i, integers(v), y) for i, v, y in good]
    out = []
    for at, (i, v, y) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z) for k, (j, w, z) in enumerate(good) if k != at]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            fit = sorted(x for x in scored if x[2] != y and window[0] * -s <= 100 * -x[0] <= window[1] * -s)[:negatives]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(rng, n, width):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        v = [round(x + rng.gauss(0, 0.6), 2) for x in centre] if rng.random() < 0.8 else centres[0]
        rows.append((i, v, rng.choice([0, 1, 1, 1, 2, -5])))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string, block string, vector string"


@pytest.mark.parametrize("bounds", [(2048, 1 << 17), (37, 40)])
def test_hard_negatives(spark, monkeypatch, bounds):
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", bounds)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", (7, 9))
    rows = vectors(random.Random(1), 300, 6)
    odd = [(1000, None, 1), (1001, [1.0] * 6, None), (None, [1.0] * 6, 1), (1002, [1.0, None, 1.0], 1), (1003, [float("nan")] * 6, 1), (1004, [float("-inf")] * 6, 1), (1005, [1e9] * 6, 1), (1010, [2.0, -1.0], 1), (1020, [], 1), (20, [1.0] * 6, 1), rows[40], rows[40]]
    every = rows + odd
    frame = spark.createDataFrame([(*r, *"abcd") for r in every], SCHEMA).repartition(3)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()
    expected = negatives_by_loop(every, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == expected and len(expected) > 500


def test_hard_negatives_of_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, *"abcd")], SCHEMA)
    assert hard_negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, *"abcd"), (1, [1.0], 2, *"abcd"), (2, None, 1, *"abcd")], SCHEMA)
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0
    wide = [(i, [2.0**16, -(2.0**16)] * 40, i % 2) for i in range(0, 40)]  # products of 2 ** 48: no doubles
    got = hard_negatives.hard_negatives(spark.createDataFrame([(*r, *"abcd") for r in wide], SCHEMA), F.col("vec_id") == 0, window=(30, 100)).collect()
    assert sorted(map(tuple, got)) == negatives_by_loop(wide, lambda i: i == 0, window=(30, 100)) and len(got) == 50


def test_tree_search_is_best_first(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    monkeypatch.setattr(hard_negatives, "FANOUT", 3)
    rng = np.random.default_rng(3)
    for n in (1, 4, 5, 13, 200, 333):
        vector = rng.integers(-9, 9, (n, 3)).astype(float)
        label, ids = rng.integers(0, 3, n), rng.permutation(n)
        order = hard_negatives.str_order(vector, label)
        assert sorted(order.tolist()) == list(range(n))
        tree = hard_negatives.PackedTree(ids[order], ids[order], label[order], vector[order])
        for _ in range(20):
            q, y, windows = rng.integers(-9, 9, 3).astype(float), int(rng.integers(0, 3)), [(-30.0, 20.0), (5.0, 60.0)]
            for same in (True, False):
                for (low, high), (found, values) in zip(windows, tree.search(q, y, same, windows, 4)):
                    scored = sorted((-s, i) for s, i, z in zip(vector @ q, ids, label) if (z == y) == same and low <= s <= high)[:4]
                    assert [(-v, i) for v, i in zip(values, found)] == scored


# ---- spelling variants


def near_by_loop(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_loop(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if near_by_loop(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def spelled(rng, n):
    base = ["".join(rng.choices("abcdeéß÷", k=rng.randint(5, 9))) for _ in range(30)]
    words = []
    for w in base:
        chain = [w]
        for _ in range(rng.randint(0, 6)):
            v = list(rng.choice(chain))
            at = rng.randrange(len(v))
            rng.choice([lambda: v.insert(at, rng.choice("abcÿ")), lambda: v.pop(at), lambda: v.__setitem__(at, rng.choice("xyzà"))])()
            chain.append("".join(v))
        for k, v in enumerate(chain):
            words += [v] * rng.choice([1, 3, 3, 4, 7, 15, 40])
    rng.shuffle(words)
    parts = [words[i::n] for i in range(n)]
    return [(d, rng.choice([" ", "-", "\n", "0"]).join(w.upper() if rng.random() < 0.1 else w for w in part)) for d, part in enumerate(parts)]


def test_spelling_variants(spark, monkeypatch):
    chain = [(100 + k, " ".join([w] * 3**n)) for k, (w, n) in enumerate([("kkkkkk", 6), ("kkkkkm", 5), ("kkkkmm", 4), ("kkkmmm", 3), ("kkmmm", 2), ("kmmm", 4), ("Kmmmq", 1)])]
    docs = chain + spelled(random.Random(4), 60) + [(None, "abcde " * 300), (None, None), (7, ""), (7, LONG)] + [(i, t) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, n string").repartition(3)
    got = spelling_variants.spelling_variants(spelling_variants.word_counts(frame, queries.dropped_letter))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = variants_by_loop(docs)
    assert {tuple(r) for r in got.collect()} == expected == set(map(tuple, expected))
    assert sum(f is not None and f != r for _, f, r, *_ in expected) >= 3 and max(len(w) for w, *_ in expected) < 20_000
    assert spelling_variants.spelling_variants(spelling_variants.word_counts(empty(spark))).count() == 0
    assert {r.word: r.n for r in spelling_variants.word_counts(documents(spark)).collect()} == {"again": 8}


def test_near_pairs_of_blocks(monkeypatch):
    monkeypatch.setattr(spelling_variants, "CELL", 8)
    rng = random.Random(5)
    for length in (5, 6):
        sets = [sorted({"".join(rng.choices("abc語\U0001f600", k=n)) for _ in range(150)}) for n in (length, length + 1)]
        a, b = (spelling_variants.Block("".join(s), np.arange(len(s)).tobytes(), len(s[0])) for s in sets)
        for x, y, s, t, same in ((a, a, sets[0], sets[0], True), (a, b, *sets, False)):
            found = list(zip(*(v.tolist() for v in spelling_variants.near_pairs(x, y, same))))
            expected = {(i, j) for i, u in enumerate(s) for j, v in enumerate(t) if (i < j or not same) and near_by_loop(u, v)}
            assert len(found) == len(set(found)) and set(found) == expected


def test_long_words_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "PAIRS", 1)
    long = "ab" * 5000
    words = [(long, 9), (long[:-1], 4), (long[1:], 3), (long[:-1] + "c", 2), ("語語語語語", 8), ("語語語語", 3)] + [(f"word{c}{d}", ord(c)) for c in "abcdefghij" for d in "klmnopqrst"]
    frame = spark.createDataFrame(words, "word string, n long").repartition(5)
    got = {r.word: r for r in spelling_variants.spelling_variants(frame).collect()}
    n = dict(words)
    for word, r in got.items():
        near = [w for w in n if near_by_loop(word, w)]
        assert r.n_near == len(near) and r.n == n[word]
        best = min(near, key=lambda w: (-n[w], w), default=None)
        assert r.form == (best if best and n[best] >= 2 * n[word] else None)
    assert len(got) == len(words) and got["語語語語"].root == "語語語語語"


# ---- packing


def packed_by_loop(lengths, capacity):
    """Sequences of a packing piece by piece."""
    left, bins = sorted(lengths, reverse=True), []
    large, small = [x for x in left if 3 * x > capacity], [x for x in left if 3 * x <= capacity]
    while large:
        first = large.pop(0)
        partner = next((x for x in large if first + x <= capacity), None)
        if partner:
            large.remove(partner)
        bins.append(capacity - first - (partner or 0))
    for x in small:
        fits = [(room, k) for k, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits)[1]] -= x
        else:
            bins.append(capacity - x)
    return bins


@pytest.mark.parametrize("capacity", [1, 2, 3, 10, 64])
def test_plan_packs_like_one_by_one(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        sizes = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 5, 40, 400]))]
        if rng.random() < 0.5:
            sizes += [rng.choice(sizes or [1])] * 200
        steps, opened = sequence_packing.packing_plan(Counter(sizes), capacity)
        counts, room, filled = Counter(sizes), Counter(), Counter()
        for k, step in enumerate(steps):
            assert step.rank == filled[step.length]
            end = next((s.rank for s in steps[k + 1 :] if s.length == step.length), counts[step.length])
            for number in range(end - step.rank):
                sequence, offset = step.sequence + number // step.each, step.offset + number % step.each * step.length
                assert room[sequence] == offset  # gapless, front to back
                room[sequence] += step.length
            filled[step.length] = end
        assert filled == counts and set(room) == set(range(opened)) and max(room.values(), default=0) <= capacity
        assert sorted(capacity - x for x in room.values()) == sorted(packed_by_loop(sizes, capacity))


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packed_documents(spark, capacity):
    file = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    texts = [" ".join(rng.choices("the a cat and some more words é 日本".split(), k=rng.randint(1, 300))) for _ in range(150)] + TEXTS + ["x y " * 4000] * 2
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 2
    frame = spark.createDataFrame([(*r, "p", "l") for r in rows], "doc_id long, text string, part string, length string").repartition(4)
    pieces = sequence_packing.pack_documents(frame, file, capacity, 2).cache()
    library = Tokenizer.from_file(file)
    whole = Counter((i, b"".join(x.to_bytes(4, "little") for x in [*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    got, by_sequence = pieces.collect(), {}
    for r in got:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= capacity and (r.length == capacity or r.piece == 0)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    starts = Counter((r.doc_id, r.ids) for r in got if r.piece == 0 and r.length < capacity or r.start == 0)
    assert sum(starts.values()) == len(rows) and sum(r.length for r in got) == sum(len(p) // 4 * n for (_, p), n in whole.items())
    for (i, packed), n in whole.items():
        size = len(packed) // 4
        cuts = [0, *range((size - 1) % capacity + 1, size + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            assert sum((r.doc_id, r.piece, r.start, r.ids) == (i, k, a, packed[4 * a : 4 * b]) for r in got) >= n
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))] and sum(r.length for r in held) <= capacity
    assert len(by_sequence) == len(packed_by_loop([r.length for r in got], capacity))
    done = {r.sequence_id: r for r in sequence_packing.sequences(pieces).collect()}
    assert {s: (b"".join(r.ids for r in held), [r.length for r in held]) for s, held in by_sequence.items()} == {s: (bytes(r.ids), r.lengths) for s, r in done.items()}
    assert sequence_packing.pack_documents(empty(spark), file, capacity, 2).count() == 0
