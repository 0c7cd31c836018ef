"""Operators on texts against brute force."""

import hashlib
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from edge_cases import TEXTS, documents, empty
from pyspark.sql import functions as F

from fleetledger.llm import benchmark_leaks as leaks
from fleetledger.llm import chat_format as chat
from fleetledger.llm import components, line_neighbours, quality_ratio, rule_automaton, secret_scan, simhash_variants


# ---- secrets


def spans_by_re(text):
    out = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.expression.decode("latin-1"), text, rule.flags | re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), k, m.end()))
    return [(secret_scan.RULES[k].kind, a, b) for a, k, b in sorted(out)]


def secret_texts(n):
    rng = random.Random(1)
    parts = ["token", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "é", "\n", "api_key", "API-KEY", "passwd", "ghp_", "eyJ", ".", "x", "-----BEGIN PRIVATE KEY-----", "xoxb-", "ſecret", "a" * 30, ",", "AIza"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]


def test_secret_spans(monkeypatch):
    monkeypatch.setattr(secret_scan, "STRETCH", 16)
    texts = secret_texts(1500) + [t or "" for t in TEXTS] + ["token=" * 5000, "a" * 50_000]
    assert secret_scan.scanner().scan(texts) == [spans_by_re(t) for t in texts]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_secret_spans_over_blocks(monkeypatch, rounds):
    for name, value in {"STRETCH": 16, "LONGEST": 7, "ROUNDS": rounds}.items():
        monkeypatch.setattr(secret_scan, name, value)
    joins = [t.replace("\n", "").replace(",", "") for t in secret_texts(900)]  # few bytes are left that end a stretch
    texts = [*joins, "".join(joins[:100]), *secret_texts(100), "", "é"]
    assert secret_scan.scanner().scan(texts) == [spans_by_re(t) for t in texts]


def test_secrets_of_long_lines():
    rng = random.Random(5)
    words = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(180_000))
    digits, code = "".join(rng.choices("0123456789abcdef", k=1_000_000)), "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=1_000_000))
    texts = [words, digits, code, words[:500_000] + " " + digits[:30] + " " + words[500_000:], words[:700] + "secret=" + code, "eyJ" * 300_000, "token" + " " * 10**6]
    start = time.process_time()
    found = secret_scan.scanner().scan(texts)
    assert time.process_time() - start < sum(map(len, texts)) / 1e6  # a second a million bytes, four times what it takes
    # The plain search is too slow for the rule of assignments on some of these; the others are told by their making.
    assert found[1] == [("hex", 0, 10**6)] and found[0] == spans_by_re(words)
    assert [s for s in found[3] if s[0] == "hex"] == [("hex", 500_001, 500_031)]
    assert ("assign", 700, 700 + 7 + 10**6) in found[4] and found[5] == found[6] == []


def test_secret_column(spark):
    rows = documents(spark).withColumn("found", secret_scan.secret_spans(F.col("text"))).collect()
    assert len(rows) == len(TEXTS) + 2 and all([tuple(s) for s in r.found] == spans_by_re(r.text or "") for r in rows)
    assert empty(spark).select(secret_scan.secret_spans(F.col("text"))).count() == 0


@pytest.mark.parametrize("expression", [rb"a(b|cd)*e?", rb"[^a-c]{2,4}x", rb"(?:ab?|b+a){1,3}", rb"a.c|\x20+"])
def test_automaton_matches_like_re(expression):
    anchored = rule_automaton.Automaton([rule_automaton.Rule("r", expression)], searching=False)
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choices(b"abcdex \n", k=rng.randint(0, 12)))
        ends = [e for e in range(len(data) + 1) if re.fullmatch(expression, data[:e])]
        assert anchored.longest(data, 0) == (max([e for e in ends if e], default=-1))


def test_automaton_is_minimal():
    same = rule_automaton.Automaton([rule_automaton.Rule("r", rb"ax|bx|cx")], searching=False)
    assert same.n_states == 4  # start, after a letter, accepted, dead


# ---- quality


def counts_by_loop(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts():
    rng = random.Random(3)
    parts = ["a", "b", "the", "é", "#", " ", "  ", "\n", "\u00a0", "\x1c", "\x0b", "|x", "a b c d e f g h "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)] + ["", "a b c d e f g h a b c d e f g h", "x " * 300]
    for text in texts:
        assert quality_ratio.base_counts(text, text.encode()) == counts_by_loop(text), text


def test_likelihood_ratio(spark, monkeypatch):
    rng = random.Random(4)
    good = [" ".join(rng.choices("the cat sat on a mat near our house and slept".split(), k=30)) for _ in range(60)]
    poor = [" ".join(rng.choices("$$$ ### BUY!! || %%% CLICK &&&".split(), k=30)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(good + poor)] + [(None, good[0]), (200, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(60, 75)] + [(0, 1, 0), (999, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = quality_ratio.fit(frame, labels)
    chosen = [r.doc_id for r in labels.where("doc_id is not null and quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).collect()][::2]
    raw, trusted = Counter(), Counter()
    for i, text in docs:
        data = (text or "").encode()
        found = [data[at : at + quality_ratio.GRAM] for at in range(len(data) - quality_ratio.GRAM + 1)]
        raw.update(found)
        if i in chosen:
            trusted.update(found)
    share = sum(trusted.values()) / sum(raw.values())
    ratio = {g: np.log((trusted[g] + quality_ratio.SMOOTHING) / (raw[g] * share + quality_ratio.SMOOTHING)) for g in raw}
    for _, text in docs[:-1]:
        data = text.encode()
        expected = np.mean([ratio[data[at : at + quality_ratio.GRAM]] for at in range(len(data) - quality_ratio.GRAM + 1)])
        assert np.isclose(model.score(data), expected)
    # Few n-grams with counts of their own: the others are pooled by hash, and every occurrence counts.
    monkeypatch.setattr(quality_ratio, "COMMON_SHARE", 150)
    told = frame.selectExpr("text as _text", f"if(doc_id in ({','.join(map(str, chosen))}), 1, 0) as _trusted")
    whole, parts = (sorted(map(tuple, quality_ratio.gram_counts(told, *x).collect())) for x in ((), (200, 50)))
    assert whole == parts and [sum(r[k] for r in whole) for k in (1, 2)] == [sum(raw.values()), sum(trusted.values())]
    small = quality_ratio.fit(frame, labels)
    own = {g for g in raw if raw[g] * 150 >= sum(raw.values())}
    key = {g: int(quality_ratio.grams(g)[0]) for g in raw}
    assert set(small.common.tolist()) == {key[g] for g in own} and 0 < len(own) <= 150
    rest = {int(quality_ratio.pools(np.array([key[g]]))[0]): [0, 0] for g in raw if g not in own}
    for g in raw.keys() - own:
        both = rest[int(quality_ratio.pools(np.array([key[g]]))[0])]
        both[0] += raw[g]
        both[1] += trusted[g]
    for pool, (r, t) in rest.items():
        assert np.isclose(small.pooled[pool], np.log((t + quality_ratio.SMOOTHING) / (r * share + quality_ratio.SMOOTHING)))
    monkeypatch.undo()
    judged = {(r.doc_id, r.n_words): r for r in quality_ratio.quality_rules(frame, labels).collect()}
    assert len(judged) == len(docs)
    held_out = [judged[i, 30].kept for i in range(40, 60)], [judged[i, 30].kept for i in range(75, 80)]
    assert all(held_out[0]) and not any(held_out[1])
    assert judged[200, 0].base_failed and not judged[200, 0].kept


def test_threshold_and_odd_labels(spark):
    scores, good = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0, 0, 1, 0, 1, 1])
    assert quality_ratio.best_threshold(scores, good) == 1.5
    assert quality_ratio.best_threshold(scores, np.ones(6)) == -np.inf
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_ratio.quality_rules(documents(spark), none).collect()
    assert len(kept) == len(TEXTS) + 2 and all(r.kept == (not r.base_failed) for r in kept)
    assert quality_ratio.quality_rules(empty(spark), none).count() == 0


def test_all_labels_count(spark):
    """More labels than the 20,000 of a kind that were looked at before; thresholds as on one machine."""
    labels = spark.range(50_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    chosen = quality_ratio._labelled(labels, "doc_id")
    assert chosen.count() == 50_000 and chosen.where("_trusted = 1").count() == 12_500 and chosen.where("_trusted = 1 and _good = 0").count() == 0
    rng = np.random.default_rng(5)
    for n, digits in ((1, 1), (300, 1), (300, 6), (2000, 2)):
        scores, good = np.round(rng.normal(size=n), digits), rng.integers(0, 2, n)
        scores = scores + 2 * good
        frame = spark.createDataFrame([(float(x), int(g)) for x, g in zip(scores, good)], "score double, good int")
        assert quality_ratio.threshold_of(frame) == quality_ratio.best_threshold(scores, good)
    same = spark.createDataFrame([(1.0, 1), (1.0, 0)], "score double, good int")
    assert quality_ratio.threshold_of(same) == quality_ratio.best_threshold(np.ones(2), np.array([1, 0]))


@pytest.mark.parametrize("marks", [1, 64, 1 << 25])
def test_texts_do_not_move_to_their_labels(spark, monkeypatch, marks):
    """Texts without a trusted label are not shuffled, however the join is made; shared bits, null and repeated ids change no count."""
    monkeypatch.setattr(quality_ratio, "MARKS", marks)
    rows = [(i, f"text {i} of the corpus") for i in range(200)] + [(None, "null id"), (None, None), (7, "again")]
    own = spark.createDataFrame(rows, "_id long, _text string").repartition(3)
    trusted = spark.createDataFrame([(i, 1, 1) for i in range(0, 200, 10)] + [(7, 1, 1), (999, 1, 1)], "_id long, _good int, _trusted int")
    expected = Counter((t, 1 if i is not None and (i % 10 == 0 or i == 7) else None) for i, t in rows)
    for kind in ("bigint", "string"):  # of another type: no map, all ids are joined
        assert Counter(map(tuple, quality_ratio._told(own, trusted, kind).collect())) == expected
    near = own.where(quality_ratio._marked(trusted, "bigint")(F.col("_id"))).count()
    assert near == (201 if marks == 1 else 22 if marks > 64 else near)
    plan = quality_ratio._told(own, trusted, "bigint")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan[plan.index("Join LeftOuter") :].split("LogicalRDD")[0], "the map is looked at before texts meet their labels"


# ---- chat


def test_chat_round_trip(monkeypatch):
    monkeypatch.setattr(chat, "WINDOW", 4)
    rng = random.Random(0)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "a\\n\nb", "<|im_end|>", ""]), "".join(rng.choices(["<|im_end|>", "<", "|", "\\", "\n", "a", "<|im_start|>", "é"], k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 14))]
        done = chat.render(chat.chat_template, turns)
        assert chat.read_back(done["formatted"]) == turns and done["rewritten_at"] is None
        assert [chat.unescape(done["formatted"][a:b]) for a, b in done["mask"]] == [t for r, t in turns if r == "assistant"]
        assert "".join(done["formatted"][a:b] for a, b in done["spans"]) == done["formatted"] == chat.chat_template(turns)


def test_templates_that_rewrite_history_are_detected(monkeypatch):
    monkeypatch.setattr(chat, "WINDOW", 4)
    turns = [("user", "hello")] * 9
    shortens = lambda t: "".join(f"{i}:{x if i >= len(t) - 2 else x[:1]};" for i, (_, x) in enumerate(t))
    assert chat.render(shortens, turns)["rewritten_at"] == 2
    late = lambda t: chat.chat_template(t).upper() if len(t) > 7 else chat.chat_template(t)
    assert chat.render(late, turns)["rewritten_at"] == 7
    begins = lambda t: "<s>" + chat.chat_template(t)
    done = chat.render(begins, [*turns, ("assistant", "yes")])
    assert [done["formatted"][a:b] for a, b in done["mask"]] == ["yes"] and done["rewritten_at"] is None


def test_every_prefix_is_rendered_from_the_first_turn(monkeypatch):
    """Turns that a template places by the first turn, or rewrites for a while, deep in a conversation."""
    monkeypatch.setattr(chat, "WINDOW", 4)
    turns = [("system", "loud")] + [("user", "a"), ("assistant", "b")] * 10
    flips = lambda t: chat.chat_template(t).upper() if len(t) == 11 else chat.chat_template(t)
    assert chat.render(flips, turns)["rewritten_at"] == 10
    # Turns under another first turn are as long, but their texts stand elsewhere.
    by_first = lambda t: "".join(f"<{x}{'!' if t[0][1] == 'loud' else ''}>{'' if t[0][1] == 'loud' else '?'}" for _, x in t)
    places = lambda t: "".join(f"[{x}] " if t[0][0] == "system" else f" [{x}]" for _, x in t)
    for template in (by_first, places):
        done = chat.render(template, turns)
        assert [done["formatted"][a:b] for a, b in done["mask"]] == ["b"] * 10 and done["rewritten_at"] is None


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", "<|im_end|>"), (2, 0, "user", "y" * 50_000)]
    frame = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    assert chat.read_back(done[1].formatted) == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert chat.read_back(done[None].formatted) == [("", "x")] and len(done[2].spans) == 2
    read = chat.format_conversations(frame).select("conv_id", chat.digests(F.col("formatted"), F.col("mask")).alias("r")).collect()
    assert {r.conv_id: r.r.loss_sha256 for r in read}[2] == hashlib.sha256(b"<|im_end|>").hexdigest()
    assert chat.format_conversations(frame.limit(0)).count() == 0


# ---- leaks


def edits_by_table(item, words):
    column, best = list(range(len(item) + 1)), len(item)
    for w in words:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(new[-1] + 1, column[i] + 1, column[i - 1] + (x != w)))
        column, best = new, min(best, new[-1])
    return best


def test_nearest_part():
    rng = random.Random(2)
    for _ in range(500):
        item, words = ([rng.randint(1, 3) for _ in range(rng.randint(a, b))] for a, b in ((1, 8), (0, 12)))
        assert leaks.nearest(item, words)[0] == edits_by_table(item, words)


def test_stretches_with_too_few_words_hold_no_item():
    rng = random.Random(12)
    for _ in range(400):
        item, words = (" ".join(rng.choices("abcdefg", k=rng.randint(1, n))) for n in (25, 60))
        index = leaks.BenchmarkIndex([(0, item)])
        near = edits_by_table(index.items[0][1], leaks.words_of(words).tolist()) <= leaks.EDITS * len(item.split())
        assert index.may_hold(0, leaks.words_of(words)) or not near


def test_recall_against_all_windows(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(2000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60)))) for i in range(40)] + [(40, None), (41, ""), (42, "Short one")]
    docs, expected = [], set()
    for d in range(160):
        i, text = items[d % 40]
        words = text.split()
        for _ in range(int(len(words) * rng.choice([0, 0.05, 0.1, 0.15]))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        around = rng.choices(vocabulary, k=200)
        docs.append((d, " ".join(around[:70]) + ".\n" + " ".join(words).upper() + ", " + " ".join(around[70:])))
    docs += [(500, None), (501, ""), (502, "a short, one short ONE."), (503, " ".join(rng.choices(vocabulary, k=40_000)))]
    index = leaks.BenchmarkIndex(items)
    for d, text in docs:
        words = leaks.words_of(text).tolist()
        expected |= {(d, i) for i, item in index.items if d < 503 and edits_by_table(item, words) <= leaks.EDITS * len(item)}
    frame = spark.createDataFrame([(*r, "e") for r in docs], "doc_id long, text string, edits string").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(frame, bench).collect()}
    assert set(found) <= expected and len(found) >= 0.97 * len(expected)
    assert {(d, d % 40) for d in range(160) if items[d % 40][1].upper() in docs[d][1]} <= set(found) and (502, 42) in found
    hit = found[0, 0]
    assert leaks.nearest(leaks.words_of(items[0][1]).tolist(), leaks.words_of(docs[0][1][hit.start : hit.end]).tolist())[0] == hit.edits
    assert {r.doc_id for r in leaks.without_leaks(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_leak_edge_cases(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "same text again"), (2, "同じ")], "item_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK", 1)
    found = leaks.find_leaks(documents(spark), bench).collect()
    assert len(found) == 4 and {r.item_id for r in found} == {1}
    assert leaks.find_leaks(empty(spark), bench).count() == 0 and leaks.find_leaks(documents(spark), bench.limit(0)).count() == 0
    assert leaks.without_leaks(documents(spark), bench).columns == documents(spark).columns


def test_leaks_with_edits_in_the_first_half():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=300))) for i in range(30)]
    index, found = leaks.BenchmarkIndex(items), 0
    for i, text in items:
        words = text.split()
        for at in rng.sample(range(150), 60):
            words[at] = rng.choice(vocabulary)
        around = rng.choices(vocabulary, k=60)
        found += any(hit[0] == i for hit in next(index.hits([" ".join(around[:30] + words + around[30:])])))
    assert found >= 29


# ---- lines


def edits(a, b):
    column = list(range(len(a) + 1))
    for w in b:
        new = [column[0] + 1]
        for i, x in enumerate(a, 1):
            new.append(min(new[-1] + 1, column[i] + 1, column[i - 1] + (x != w)))
        column = new
    return column[-1]


def lines_by_loop(docs):
    seen, out = [], {}
    for d, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            words = line.strip(" ").split(" ")
            near = len(words) >= line_neighbours.NEAR_WORDS
            gone = len(words) >= line_neighbours.EXACT_WORDS and any(
                w == words or near and len(w) >= line_neighbours.NEAR_WORDS and edits(w, words) <= 1 for w in seen
            )
            seen.append(words)
            if not gone:
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


@pytest.mark.parametrize("rows", [500_000, 0])
def test_line_dedup(spark, monkeypatch, rows):
    monkeypatch.setattr(line_neighbours, "BROADCAST_ROWS", rows)
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") for _ in range(rng.choice([1, 4, 5, 9, 10, 11, 12, 15]))] for _ in range(25)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words) + 1)
                rng.choice([lambda: words.insert(at, rng.choice("abc")), lambda: words[at : at + 1] and words.pop(at), lambda: words.__setitem__(slice(at, at + 1), [rng.choice("xyz")])])()
            lines.append(" " * rng.randint(0, 1) + " ".join(words))
        docs.append((d, "\n".join(lines)))
    frame = spark.createDataFrame([(*r, "m") for r in docs], "doc_id long, text string, mark string").repartition(3)
    assert {r.doc_id: r.text for r in line_neighbours.dedup_lines(frame).collect()} == lines_by_loop(docs)


def test_line_dedup_edge_cases(spark):
    docs = documents(spark)
    done = line_neighbours.dedup_lines(docs)
    assert done.columns[: len(docs.columns)] == docs.columns and sorted(map(str, (r.text for r in done.collect()))) == sorted(map(str, (r.text for r in docs.collect())))
    line = "these are six words of text"
    rows = spark.createDataFrame([(None, line), (2, f"{line}\n"), (2, f"{line}\n"), (2, f"x\n{line}")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.text, r._dedup.emptied) for r in line_neighbours.dedup_lines(rows).collect())
    assert got == [(-1, "", True), (2, f"{line}\n", False), (2, f"{line}\n", False), (2, "x", True)]
    assert line_neighbours.dedup_lines(empty(spark)).count() == 0


def test_documents_with_short_lines_of_their_own_stay(spark):
    line = "these are six words of text"
    docs = [(1, f"{line}\nfruit"), (2, f"apple\n{line}\n\npear"), (3, f"pear\n{line}\n"), (4, f"fruit\n{line}\n apple "), (5, f"{line}\n \n"), (6, "pear"), (None, f"{line}\nplum"), (None, f"{line}\nfruit"), (7, None)]
    frame = spark.createDataFrame([(*d, "p") for d in docs], "doc_id long, text string, place string").repartition(3)
    got = sorted((r.doc_id or 99, r.text or "") for r in line_neighbours.with_own_lines(frame).collect())
    assert got == [(1, docs[0][1]), (2, "apple\n\npear"), (6, "pear"), (7, ""), (99, "plum")]
    assert line_neighbours.with_own_lines(frame).columns == [*frame.columns, "_dedup"]
    assert line_neighbours.with_own_lines(empty(spark)).count() == 0


# ---- near-duplicates


def simhash_by_loop(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_loop(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_fingerprints():
    for text in [*TEXTS[:7], "A b C d e", "É e\u00a0f G", "a b c " * 40]:
        assert simhash_variants.fingerprint(text) == simhash_by_loop(text)


@pytest.mark.parametrize("run", [2048, 3])
def test_components_of_fingerprints(spark, monkeypatch, run):
    monkeypatch.setattr(simhash_variants, "RUN", run)
    rng, prints = random.Random(7), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            near = centre
            for _ in range(rng.randint(0, 4)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    prints = sorted(prints)
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    got = simhash_variants.with_components(spark.createDataFrame(rows, "doc_id long, fingerprint long")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(groups_by_loop(prints)))


def test_chain_star_and_separate_nodes(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {k: 1000 for k in range(1000, 1400)} or got == {i: 0 for i in range(1, 301)} | {k: 1000 for k in range(1001, 1400)}


def test_near_duplicates_edge_cases(spark):
    got = simhash_variants.near_duplicates(documents(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    by_id = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by_id[0, "0" * 16] == by_id[1, "0" * 16] == by_id[2, "0" * 16] == 0
    assert {c for (i, _), c in by_id.items() if i == 5} == {5}
    nothing = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.component_id for r in simhash_variants.near_duplicates(nothing).collect()] == [None, None]
    assert simhash_variants.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("run", [2048, 5])
def test_one_of_each_component_stays(spark, monkeypatch, run):
    monkeypatch.setattr(simhash_variants, "RUN", run)
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    docs = []
    for centre in range(6):
        text = rng.choices(words, k=400)
        for k in range(rng.choice([1, 3, 40])):
            other = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 20]) if k else 0):
                other[rng.randrange(400)] = rng.choice(words)
            docs.append((100 * centre + k, " ".join(other)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (None, docs[0][1]), docs[0], (0, docs[0][1] + "\t")]
    rng.shuffle(docs)
    prints = sorted({simhash_by_loop(t) for _, t in docs})
    group = dict(zip(prints, groups_by_loop(prints)))
    expected = {}
    for d, t in docs:
        g = group[simhash_by_loop(t)]
        expected[g] = min(expected.get(g, 10**6), 10**6 if d is None else d)
    frame = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, root string").repartition(3)
    kept = simhash_variants.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(expected.values()) and len(expected) > 6
    whole = documents(spark)
    ids = {r.component_id for r in simhash_variants.near_duplicates(whole).collect()}
    left = simhash_variants.keep_one(whole)
    assert left.columns == whole.columns and {r.doc_id for r in left.collect()} == ids and left.count() == len(ids)
    assert simhash_variants.keep_one(empty(spark)).count() == 0
