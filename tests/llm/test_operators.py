"""Each corpus operator against a plain version, on rows with every special case."""

from __future__ import annotations

import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import centroids, components, debruijn_dedup, decontaminate, fill_middle, fm_index, line_dedup, maxent_lm, minhash, mixing, quality_rules, set_links, sharding, simhash, suffix_dedup, warc
from strata.llm.batches import Piece
from tests.llm.brute import LOWER, WORD, raw, repeated, sha, special_rows

ROWS = special_rows()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    return df.withColumns({"list": F.lit(1), "size": F.lit("x"), "shard": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"), "stats": F.lit(2), "n_words": F.lit(9)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def found(df, columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=str)


def test_suffix_dedup(docs, empty):
    texts = [raw(t) for _, t in ROWS]
    want = []
    for (i, _), text, gone in zip(ROWS, texts, repeated(texts, 200)):
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        want.append((i, len(text), sum(gone), runs, sha(bytes(b for b, g in zip(text, gone) if not g))))
    assert found(suffix_dedup.digest(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(want, key=str)
    assert suffix_dedup.digest(empty).count() == 0


def test_multikey_sort_orders_by_all_tokens():
    rng = np.random.default_rng(2)
    tokens = [rng.integers(0, 4, 500) for _ in range(3)]
    order = suffix_dedup.multikey_sort(tokens)
    assert [tuple(t[i] for t in tokens) for i in order] == sorted(zip(*tokens))


def test_debruijn_dedup(docs, empty):
    words = [tuple(WORD.findall(raw(t))) for _, t in ROWS]
    want = [(i, len(w), sum(g), sha(b" ".join(x for x, y in zip(w, g) if not y))) for (i, _), w, g in zip(ROWS, words, repeated(words, 35))]
    assert found(debruijn_dedup.digest(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"]) == sorted(want, key=str)
    assert debruijn_dedup.digest(empty).count() == 0


def test_debruijn_paths_cover_what_is_removed(docs):
    for row in debruijn_dedup.mark(docs).collect():
        covered = {k for p in row.paths for k in range(p.first, p.first + p.words)}
        assert len(covered) == row.n_removed


def test_line_dedup(docs, empty, spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n\nb\nc\ny"), (3, "b\nc\nd\nb\nc\nd"), (4, None), (5, "a\nb"), (5, "a\nb"), (None, "a\nb\nc")]
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed, r.kept) for r in line_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[(1, rows[0][1])] == (4, 0, "a\nb\nc\nd")
    assert got[(2, rows[1][1])] == (6, 3, "x\n\ny")
    assert got[(3, rows[2][1])] == (6, 6, "")
    assert got[(4, None)] == (1, 0, None) and got[(5, "a\nb")][1] == 0 and got[(None, "a\nb\nc")][1] == 3
    assert line_dedup.digest(docs).count() == len(ROWS) and line_dedup.digest(empty).count() == 0


def test_suffix_array_and_fm_index_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        seq = np.append(rng.integers(0, rng.integers(2, 6), rng.integers(1, 90)), 0)

        def suffix(i):
            stop = next(j for j in range(i, len(seq)) if seq[j] == 0)
            return [(1, int(x)) for x in seq[i:stop]] + [(0, stop)]

        assert list(fm_index.suffix_array(seq)) == sorted(range(len(seq)), key=suffix)
        index, patterns = fm_index.FmIndex(seq), rng.integers(1, 6, (5, int(rng.integers(1, 5))))
        for p, low, high in zip(patterns, *index.search(patterns)):
            want = [i for i in range(len(seq) - len(p) + 1) if list(seq[i:i + len(p)]) == list(p)]
            assert sorted(index.locate(np.arange(low, high))) == want


def _leaks(rows, items):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    owners = defaultdict(set)
    for name, text in items:
        w = tuple(word.findall(raw(text).translate(LOWER)))
        size = min(10, len(w))
        for p in range(len(w) - size + 1 if size else 0):
            owners[w[p:p + size]].add("" if name is None else str(name))
    for i, text in rows:
        w, hit, names = tuple(word.findall(raw(text).translate(LOWER))), set(), set()
        for size in {len(o) for o in owners}:
            for p in range(len(w) - size + 1):
                if w[p:p + size] in owners:
                    hit.update(range(p, p + size))
                    names |= owners[w[p:p + size]]
        yield i, len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit)


def test_decontaminate(docs, empty, spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, " ".join(re.findall(r"\w+", ROWS[rng.randrange(80)][1])[5:5 + rng.randrange(1, 30)]).upper() + "!") for k in range(12)] + [(3, ROWS[5][1]), (90, None), (91, ""), (92, "..."), (None, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(_leaks(ROWS, items), key=str)
    assert found(decontaminate.digest(docs, bench), columns) == want
    table, count = decontaminate.blocks(bench, block_words=40, part_words=13)
    assert count > 4 and table.count() > len(items)
    whole = sorted((str(r.doc_id), r.n_hit, r["items"], r.spans) for r in decontaminate.mark(docs.select("doc_id", "text"), bench).collect())
    small = decontaminate.mark(docs.select("doc_id", "text"), bench, block_words=40, part_words=13)  # many blocks of parts find the same
    assert sorted((str(r.doc_id), r.n_hit, r["items"], r.spans) for r in small.collect()) == whole
    monkeypatch.setattr(decontaminate, "SHARD", 500)
    assert found(decontaminate.digest(docs, bench), columns) == want
    monkeypatch.undo()
    clean = decontaminate.remove(docs, bench)
    assert clean.columns == docs.columns
    assert decontaminate.digest(clean, bench).where("contaminated").count() == 0
    assert decontaminate.digest(docs, bench.where("1 = 0")).where("contaminated").count() == 0
    assert decontaminate.digest(empty, bench).count() == 0


def _fingerprint(text):
    w = WORD.findall(raw(text).translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(docs, empty):
    prints = [_fingerprint(t) for _, t in ROWS]
    parent = list(range(len(ROWS)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(ROWS):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    want = sorted(((ROWS[i][0], f"{prints[i]:016x}", least.get(root(i))) for i in range(len(ROWS))), key=str)
    assert found(simhash.digest(docs), ["doc_id", "fingerprint", "component_id"]) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({root(i) for i in range(len(ROWS))})
    assert simhash.digest(empty).count() == 0


def test_simhash_keeps_one_row_of_each_component_under_null_and_shared_ids(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 6) for _ in range(60)) for _ in range(12)]
    near = texts[0].upper()  # another text with the same fingerprint
    rows = [(None, texts[k]) for k in range(1, 5)] + [(None, texts[1])]  # null ids alone in their components
    rows += [(7, texts[5]), (7, texts[6])]  # one id, texts that nothing links
    rows += [(1, texts[7]), (1, texts[0]), (0, near)]  # one id, one of its texts linked to a lesser id
    rows += [(None, texts[8]), (9, texts[8]), (5, texts[9]), (5, texts[9]), (4, texts[10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("own")).repartition(4)
    want = [(None, texts[k]) for k in range(1, 5)] + [(7, texts[5]), (7, texts[6]), (1, texts[7]), (0, near), (9, texts[8]), (5, texts[9]), (4, texts[10])]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert found(kept, df.columns) == sorted([(*r, "own") for r in want], key=str)


def test_tree_finds_all_links_at_any_leaf_size(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    tight = base[0] ^ np.array([sum(1 << int(b) for b in rng.choice(12, 6, replace=False)) for _ in range(400)], np.uint64)
    values = np.unique(np.concatenate([base, near, tight]))
    label = np.arange(len(values))
    for _ in range(60):
        for i in range(len(values)):
            label[i] = label[np.bitwise_count(values ^ values[i]) <= 2].min()
    tree = simhash.fit(values, len(values), leaf=20)
    leaves, which = tree.leaves(values)
    assert leaves.max() > 3
    links = [simhash.stars(values[which[leaves == k]], limit=30) for k in range(leaves.max() + 1)]
    df = spark.createDataFrame([(int(a), int(b)) for m, h in links for a, b in zip(m.view(np.int64), h.view(np.int64))], "a long, b long")
    group = {r.node: r.root for r in components.components(df).collect()}
    mine = [group.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len(set(zip(mine, label))) == len(set(mine)) == len(set(label))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (9, 8), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 150)}


def test_sharding(docs, empty):
    got = sharding.digest(docs).collect()
    want = Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    out = sharding.assign(docs)
    assert set(out.columns) == set(docs.columns) | {"shard", "slot", "grown_shard"} and out.count() == len(ROWS)
    assert sharding.digest(empty).count() == 0


def test_shards_follow_their_weights(spark):
    counts = Counter(r[0] for r in spark.range(8000).select(sharding.shard_of(F.col("id"), (1.0, 2.0, 5.0))).collect())
    assert all(abs(counts[k] / 8000 - w / 8) < 0.03 for k, w in enumerate((1, 2, 5)))


def test_water_fill(spark):
    rows = [("a", 10, 1.0), ("b", 100, 2.0), ("c", 5, 3.0), (None, 0, 1.0), ("d", 2000, 1.0), ("e", 7, 2.0)]
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight double")).collect()}
    cap, total, live, want = {s: 3 * n for s, n, _ in rows}, sum(n for _, n, _ in rows), list(rows), {}
    while True:  # clamp and share again
        rest, weight = total - sum(want.values()), sum(w for *_, w in live)
        over = [r for r in live if rest * r[2] / weight > cap[r[0]]]
        if not over:
            break
        want |= {r[0]: cap[r[0]] for r in over}
        live = [r for r in live if r not in over]
    want |= {s: rest * w / weight for s, _, w in live}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_sources_in_segments(spark, monkeypatch):
    """As many sources as documents: numbers, sums and the level are the same when no task has over 50 of them."""
    sources = spark.createDataFrame([(f"s{i * 7919 % 1009:04d}", i * i % 83) for i in range(400)] + [(None, 40), ("", 3)], "source string, source_size long")
    want = {(r.source, r.weight, r.target) for r in mixing.water_fill(mixing.weigh(sources)).collect()}
    monkeypatch.setattr(mixing, "NUMBERED_ROWS", 50)
    monkeypatch.setattr("strata.operators.windows.NUMBERED_ROWS", 50)
    weighed = mixing.weigh(sources)
    turns = {r.source: r.weight for r in weighed.collect()}
    assert [turns[s] for s in sorted(s for s in turns if s is not None)] + [turns[None]] == [float(i % 3 + 1) for i in range(402)]
    assert {(r.source, r.weight, r.target) for r in mixing.water_fill(weighed).collect()} == want
    assert mixing.water_fill(mixing.weigh(sources.where("1 = 0"))).count() == 0


def test_mixing(docs, empty):
    got = mixing.digest(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(raw(t)))) for i, t in ROWS)
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in got))
    assert found(mixing.digest(docs), ["doc_id", "taken"]) == sorted([(r.doc_id, r.taken) for r in got], key=str)
    out = mixing.repeat(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert {r["size"] for r in out.collect()} <= {"x"}
    assert mixing.digest(empty).count() == 0


def _quality(text):
    w = WORD.findall(raw(text))
    count, covered, lines, dups = Counter(tuple(w[p:p + 5]) for p in range(len(w) - 4)), set(), set(), 0
    for p in range(len(w) - 4):
        if count[tuple(w[p:p + 5])] > 1:
            covered.update(range(p, p + 5))
    for line in (text or "").split("\n"):
        if WORD.search(line.encode()):
            dups += line in lines
            lines.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_quality_rules(docs, empty, spark):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(90)] + [(None, 0, 0), (3, None, 0), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality_rules.digest(docs, labels)
    want = sorted(((i, *_quality(t)) for i, t in ROWS), key=str)
    assert found(got, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.kept or not r.base_failed)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality_rules.digest(empty, labels).count() == 0
    assert quality_rules.digest(docs, labels.where("1 = 0")).where("kept = base_failed").count() == 0


def test_decision_list_learns_conjunctions():
    rng = random.Random(5)
    rows = [{"a": rng.random(), "b": rng.random(), "c": rng.random()} for _ in range(3000)]
    bad = [r["a"] > 0.8 and r["b"] < 0.5 or r["c"] > 0.95 for r in rows]
    rules = quality_rules.learn_list(rows, bad)
    holds = lambda r: any(all((r[c.feature] >= c.bound) == c.over for c in rule) for rule in rules)
    assert sum(holds(r) == b for r, b in zip(rows, bad)) > 2900
    assert quality_rules.learn_list(rows, [False] * len(rows)) == [] and quality_rules.learn_list([], []) == []


def test_quality_rules_take_ids_of_any_type(spark):
    rows = [(i, (f"vile gunk {i} " if i % 3 == 0 else "plain kind words ") + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(90)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    named = [x.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))) for x in (df, labels)]
    want = sorted(r.doc_id for r in quality_rules.keep_good(df, labels).collect())
    assert [f"d{i}" for i in want] == sorted((r.doc_id for r in quality_rules.keep_good(*named).collect()), key=lambda x: int(x[1:]))
    assert want == [i for i in range(90) if i % 3]


def test_quality_rules_find_toxic_words(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join([*rng.sample(words, 60), *(["Nastyword!"] if i % 9 == 0 else [])])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    rejected = {r.doc_id for r in quality_rules.digest(df, labels).where("NOT kept").collect()}
    assert rejected == set(range(0, 600, 9))


def test_language_model(docs, empty):
    got = maxent_lm.score(docs).collect()
    own = {(i, t): [*WORD.findall(raw(t).translate(LOWER)), b" "] for i, t in ROWS}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    count = Counter(w for i, t in ROWS if not held(i) for w in own[(i, t)])
    total, distinct = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(own[(i, t)]), sum(count[w] > 0 for w in own[(i, t)]), total) for i, t in ROWS), key=str)
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got], key=str) == want
    base = sorted(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own[(i, t)]) for i, t in ROWS)
    assert sorted(r.base_score for r in got) == pytest.approx(base)
    assert all(r.score < 0 for r in got)
    assert maxent_lm.score(empty).count() == 0


def test_language_model_joins_counts_beyond_its_table(docs, monkeypatch):
    want = {(r.doc_id, r.n_tokens): r.base_score for r in maxent_lm.score(docs).collect()}
    monkeypatch.setattr(maxent_lm, "TABLE", 5)
    got = {(r.doc_id, r.n_tokens): r.base_score for r in maxent_lm.score(docs).collect()}
    assert got == pytest.approx(want)


def test_language_model_beats_its_base_on_held_out_text(spark):
    rng = random.Random(8)
    tongues = [["".join(rng.choice(letters) for _ in range(4)) for _ in range(400)] for letters in ("abcd", "wxyz")]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(80))) for i in range(400)]
    held = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.95


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    logs = maxent_lm._log_probabilities([rng.normal(size=(int(f.max()) + 1, maxent_lm.CLASSES)) for f in maxent_lm._features()], maxent_lm._features())
    assert np.allclose(np.exp(logs).sum(axis=1), 1)


def test_language_model_learns_which_token_follows(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    after = dict(zip(words, rng.sample(words, len(words))))
    rows = []
    for i in range(300):
        text = [rng.choice(words)]
        while len(text) < 60:
            text.append(after[text[-1]])
        rows.append((i, " ".join(text)))
    held = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.3  # features of classes alone gave 0.59 here


def test_language_model_steps_and_scores_by_brute_force(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(i % 9)) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    own = docs.where(maxent_lm.training())
    model = maxent_lm.fit(own, maxent_lm.counts(own))
    lines = {}
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        h, _, ending, _ = maxent_lm.tokens(Piece(None, data, np.array([0, len(data)])))
        lines[i] = (h & np.uint64(2**32 - 1)).astype(np.uint32), *model.look_up(h, ending)
    train = [i for i in lines if zlib.crc32(str(i).encode()) % 7 != 2]
    coded = spark.createDataFrame([(lines[i][0].tobytes(), lines[i][2].astype(np.int16).tobytes()) for i in train], "codes binary, units binary").repartition(3)
    end, end_kind = int(maxent_lm.END & np.uint64(2**32 - 1)), int(model.class_of[maxent_lm._end_unit(model)])

    def walk(i):
        """Level, rows of features, outcome and probabilities of each token of a text, one token at a time."""
        codes, _, units = lines[i]
        kind = model.class_of[units]
        tables = maxent_lm.feature_rows(codes, kind, np.array([0, len(codes)]), end, end_kind, model.buckets)
        for at in range(len(codes)):
            for level, outcome in enumerate((kind[at], model.slot_of[units[at]])):
                rows = [int(r[at]) for r in tables[level]]
                scores = [sum(float(model.weights[level][r, c]) for r in rows) for c in range(model.weights[level].shape[1])]
                whole = math.log(sum(map(math.exp, scores)))
                yield level, rows, int(outcome), [math.exp(s - whole) for s in scores]

    observed = maxent_lm._summed(coded, model, maxent_lm.observed_part)
    model.weights = maxent_lm.first_weights(observed, model.buckets)
    expected = maxent_lm._summed(coded, model, maxent_lm.expected_part)
    for got, seen in ((observed, True), (expected, False)):
        want = [np.zeros(t.shape) for t in got]
        for i in train:
            for level, rows, outcome, p in walk(i):
                for r in rows:
                    want[level][r] += np.eye(len(p))[outcome] if seen else p
        assert all(np.allclose(g, w, atol=1e-4) for g, w in zip(got, want))
    stepped = maxent_lm.step(model.weights, observed, expected)
    assert np.allclose(stepped[0], model.weights[0] + maxent_lm.RATE * (observed[0] - expected[0]) / (observed[0] + expected[0] + maxent_lm.PRIOR), atol=1e-5)
    model.weights = maxent_lm.train(coded, model)
    scores = {r.doc_id: r.score for r in maxent_lm.score(docs).collect()}
    for i, (_, count, units) in lines.items():
        want = sum(math.log10(p[outcome]) for _, _, outcome, p in walk(i))
        want += float((np.log10(count + 1.0) - model.slot_log[model.class_of[units] * maxent_lm.SLOTS + model.slot_of[units]]).sum())
        assert scores[i] == pytest.approx(want, abs=1e-3)


def test_language_model_trains_until_it_expects_what_was_observed(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(60)]
    after = {w: rng.sample(words, 5) for w in words}
    rows = []
    for i in range(120):
        text = [rng.choice(words)]
        while len(text) < 50:
            text.append(rng.choice(after[text[-1]]))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = maxent_lm.fit(docs, maxent_lm.counts(docs))
    lines = []
    for _, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        h, _, ending, _ = maxent_lm.tokens(Piece(None, data, np.array([0, len(data)])))
        lines.append(((h & np.uint64(2**32 - 1)).astype(np.uint32).tobytes(), model.look_up(h, ending)[1].astype(np.int16).tobytes()))
    coded = spark.createDataFrame(lines, "codes binary, units binary").repartition(2)
    observed = maxent_lm._summed(coded, model, maxent_lm.observed_part)
    first = maxent_lm.first_weights(observed, model.buckets)
    model.weights = maxent_lm.train(coded, model)
    expected = maxent_lm._summed(coded, model, maxent_lm.expected_part)
    for o, e, w, f in zip(observed, expected, model.weights, first):
        slopes = np.abs(o - e - maxent_lm.PRIOR * (w.astype(float) - f))
        assert slopes.sum() < 0.011 * o.sum()  # one step left 0.15 and 0.06


def test_ascent_goes_back_when_a_move_went_too_far():
    observed = np.full((1, 2), 500.0)
    path = maxent_lm.Ascent(observed, np.zeros((1, 2), np.float32))
    weights = path.next(path.first, np.array([[900.0, 100.0]]))
    assert weights[0, 0] < 0 < weights[0, 1]
    back = path.next(weights, np.array([[100.0, 900.0]]))  # now as far off on the other side
    assert np.allclose(back, weights / 2, atol=0.01)
    assert path.next(back, observed) is None


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/b\r\nX: y", "<title>T &amp; t</title><body><script>x<1</script><p>Ein<br>Wort &lt;b&gt;</p><a href='/l'>link</a><!-- no -->"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 6
    sources = {r.page_id: warc.read_record(bytes(r.response)) for r in warc.responses(pages).collect()}
    for r in rows:
        fields, block = warc.read_record(bytes(r.record))
        source = sources[r.page_id][0]
        assert fields["warc-type"] == r.kind and fields["warc-refers-to"] == r.refers_to == source["warc-record-id"]
        assert fields["warc-block-digest"] == warc.digest(block) == r.block_digest and "x" not in fields
        assert fields["warc-source-payload-digest"] == source["warc-payload-digest"] == r.payload_digest
    text = next(warc.read_record(bytes(r.record))[1].decode() for r in rows if r.page_id == 1 and r.kind == "conversion")
    assert text == "T & t\nEin\nWort <b>\nlink"
    notes = next(warc.read_record(bytes(r.record))[1].decode() for r in rows if r.page_id == 1 and r.kind == "metadata")
    assert "sourceHeader-Content-Type: text/html" in notes and "outlink: /l" in notes
    assert warc.derive(None) == warc.derive(b"no record") == warc.derive(warc.response("1", "u", "p")[:80]) == []


def _fill_middle(doc_id, text, unit):
    text = text or ""
    h = sha(f"7:{'' if doc_id is None else doc_id}".encode())
    draws = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    one, two = sorted(d % (len(units) + 1) for d in draws[:2])
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return (doc_id, len(units), "plain", None, None, text, text)
    if draws[3] % 100 < 50:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


FILL_ROWS = [*ROWS, (600, "\n"), (601, "\n\n\nä"), (602, "é\n€\n𝄞\nx\n" * 40), (603, "a <S> b\nc"), (604, "a\n<P\n>S>\n<\nM"), (605, "𝄞" * 300), (606, "ab€\r\n" * 50 + "end"), (606, "one\ntwo\n"), (607, "z" * 70_000 + "\n" + "é" * 70_000)]


@pytest.mark.parametrize("unit", fill_middle.UNITS)
@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_fill_middle(spark, monkeypatch, unit, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    df = spark.createDataFrame(FILL_ROWS, "doc_id long, text string").repartition(3).withColumns({"form": F.lit("own"), "N": F.lit(1), "draws": F.lit("d"), "draws_": F.lit(None).cast("string")})
    made = fill_middle.transform(df, unit=unit)
    assert {"doc_id", "text", "draws", "draws_", "n", "form", "output"} <= set(made.columns) and "N" not in made.columns
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    assert found(got, columns) == sorted((_fill_middle(i, t, unit) for i, t in FILL_ROWS), key=str)


def test_fill_middle_digest_and_empty_table(docs, empty):
    want = sorted(((*w[:5], sha(w[5].encode()), sha(w[6].encode())) for w in (_fill_middle(i, t, "line") for i, t in ROWS)), key=str)
    assert found(fill_middle.digest(docs), ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]) == want
    assert fill_middle.digest(empty).count() == 0
    assert fill_middle.transform(docs, cut=0).where("form <> 'plain' OR output <> coalesce(text, '')").count() == 0


def test_exceptions_turn_bytes_into_code_points_and_back():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("ab\né€𝄞") for _ in range(rng.randrange(0, 40)))
        index = fill_middle.Exceptions.of(np.frombuffer(text.encode(), np.uint8))
        places = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
        assert list(index.chars(places)) == list(range(len(text) + 1)) and list(index.bytes(np.arange(len(text) + 1))) == list(places)
        assert len(index.byte) == sum(len(c.encode()) > 1 for c in text)


def _centroids(rows, clusters, rounds):
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    now = [v for _, _, v in sorted((sha(f"3:{'' if i is None else i}".encode()), k, v) for k, (i, v) in enumerate(sorted(kept, key=lambda r: r[1])))][:clusters]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        now = [tuple(sum(x) // len(groups[k]) for x in zip(*groups[k])) if k in groups else c for k, c in enumerate(now)]
    placed = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in placed:
        inertia[k] += d
    return [(i, k, d, inertia[k], sum(inertia.values()), sha(",".join(map(str, now[k])).encode())) for i, d, k in placed]


def _vectors():
    rng = random.Random(12)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(middles)]) for i in range(120)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, rows[5][1]), (None, rows[7][1]), (202, None), (203, []), (204, [1.0] * 63), (205, [1.0] * 65)]
    return rows + [(206, [None] + [1.0] * 63), (207, [math.nan] * 64), (208, [math.inf] + [0.0] * 63), (209, [-0.0] * 64), (210, [1e-30] * 64)]


@pytest.mark.parametrize("large", [[], [(300, [1e9] * 64), (301, [-3e5] * 32 + [2.5e5] * 32)]])
def test_centroids(spark, large):
    rows = _vectors() + large
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"cluster": F.lit("own"), "__v": F.lit(1), "__v__": F.lit(2)})
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    fits = lambda r: tuple(None if isinstance(x, int) and x >= 2**63 else x for x in r)
    want = sorted((fits(r) for r in _centroids(rows, 8, 10)), key=str)
    assert found(centroids.digest(df), columns) == want
    model = centroids.fit(df)
    out = centroids.assign(df, model)
    assert set(out.columns) == {*df.columns, "distance"} and found(out, columns[:3]) == sorted([r[:3] for r in want], key=str)
    assert model.wide == bool(large)


def test_centroids_with_few_vectors_and_none(spark):
    df = spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>")
    few = df.where("vec_id IN (3, 9, 200)")
    assert len(centroids.fit(few).values) == 4 and centroids.digest(few).agg(F.sum("distance")).first()[0] == 0
    none = df.where("vec_id = 204")
    assert centroids.fit(none).values == () and centroids.digest(none).count() == 0 and centroids.assign(none, centroids.fit(none)).count() == 0
    assert centroids.digest(none).columns == centroids.digest(few).columns
    assert centroids.digest(df.where("1 = 0")).count() == 0


def _shingle_sets(rows, width):
    words = [tuple(WORD.findall(raw(t).translate(LOWER))) for _, t in rows]
    return [{w[k:k + width] for k in range(max(1, len(w) - width + 1))} if w else set() for w in words]


def _linked(sets, per_cent=80):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def _variants(seed, groups, copies, edits):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(rng.choice([2, 5, 30, 120, 300]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + int(len(words) * edits))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1000, " ".join(own)))
    return rows


def test_minhash(spark, empty):
    rows = [*_variants(3, 25, 8, 0.05), *ROWS, (2000, "Aa bB"), (2001, "AA  bb"), (2002, "aa bb cc dd"), (2003, "aa bb cc dd aa bb cc dd"), (None, "aa\x0bBB")]
    sets = _shingle_sets(rows, 4)
    roots, least = _linked(sets), {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[roots[i]] = min(name, least.get(roots[i], name))
    want = sorted(((rows[i][0], len(sets[i]), least.get(roots[i]), rows[i][0] == least.get(roots[i])) for i in range(len(rows))), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"node": F.lit("own"), "size": F.lit(1), "bands": F.lit(2)})
    assert found(minhash.digest(df), ["doc_id", "n_shingles", "component_id", "kept"]) == want
    assert len(set(roots)) < len(rows) - 100
    assert minhash.digest(empty).count() == 0


def test_bins_agree_like_the_similarity_of_small_and_large_sets():
    rng = np.random.default_rng(8)
    for size, low, high in ((9, 0.70, 0.90), (2000, 0.70, 0.90)):
        agree = []
        for _ in range(40):
            both = np.unique(rng.integers(0, 2**64 - 1, size, dtype=np.uint64))
            extra = np.unique(rng.integers(0, 2**64 - 1, size // 8, dtype=np.uint64))  # 8 of 9 and of 9 are common: 0.8
            one, two = np.sort(np.append(both[:-len(extra)], extra)), both
            values, starts = np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)])
            a, b = minhash.sketches(values, starts)
            agree.append((a == b).mean())
        assert low < np.mean(agree) < high


def test_a_head_that_few_members_resemble_hides_no_link(spark, monkeypatch):
    """One bucket for all: stars link each text to the least node only, the rest comes from rare shingles."""
    rows = _variants(9, 12, 6, 0.08)
    sets = _shingle_sets(rows, 4)
    monkeypatch.setattr(set_links, "SPLIT", 3)  # heads in many groups
    monkeypatch.setattr(minhash, "bands", lambda sketch: np.zeros((len(sketch), minhash.BANDS), np.uint64))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    roots, least = _linked(sets), {}
    for i, (name, _) in enumerate(rows):
        least[roots[i]] = min(name, least.get(roots[i], name))
    assert found(minhash.digest(df), ["doc_id", "component_id"]) == sorted([(rows[i][0], least[roots[i]]) for i in range(len(rows))], key=str)


def test_texts_of_a_template_do_not_meet(spark):
    """Texts of one template just under the limit share buckets, but no pair of them is made."""
    rng = random.Random(5)
    template = [f"t{k}" for k in range(400)]
    rows = []
    for i in range(150):
        own = list(template)
        for k in range(i % 33, len(own), 33):
            own[k] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    sets = _shingle_sets(rows, 4)
    assert all(0.55 < len(sets[0] & s) / len(sets[0] | s) < 0.8 for s in sets[1:])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = df.select(set_links.node_of(F.col("text")).alias("node"))
    whole = set_links.sets_of(df, nodes, 4)
    marks = minhash.marks(df.select("text")).select(F.col("node").alias("m"), "sketch")
    involved = whole.join(marks, F.col("node") == F.col("m")).select("node", F.size("set").cast("long").alias("size"), "sketch")
    posted = set_links.rare_shingles(involved, whole, 80)
    assert set_links.prefix_pairs(posted, spark.createDataFrame([], "m binary, root binary"), 80, minhash.BINS).count() == 0
    assert minhash.digest(df).where("kept").count() == len(rows)


def test_warc_pages_against_plain_patterns():
    title = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
    link = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
    bits = ["<title>", "</title >", "<a ", "href=", "HREF = 'x'", '"q>r"', '"', "'", ">", "<p>", "<", "a b", "&amp;", "\n", "<b", "/a>", "<title", "href", "<!-- ", "-->"]
    rng = random.Random(10)
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        want = title.search(page)
        assert warc.titles(page) == (want[1] if want else "", title.sub(" ", page))
        assert warc.links(page) == list(dict.fromkeys(html.unescape(a or b or c) for a, b, c in link.findall(page)))
        rest = title.sub(" ", warc.HIDDEN.sub(" ", page))
        lines = [want[1] if want else "", *warc.TAG.sub("", warc.BLOCK.sub("\n", rest)).split("\n")]
        assert warc.plain(page) == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in lines) if x)


@pytest.mark.parametrize("bit", ["<title>", "<title", "<a", "<a href='", "<p", "<!--", "<script>", '<a href="', "</title", "<a href"])
def test_warc_reads_long_broken_pages_in_one_pass(bit):
    page = bit * (1_000_000 // len(bit))
    began = time.process_time()
    warc.plain(page), warc.links(page), warc.titles(page + ">")
    assert time.process_time() - began < 4


def test_warc_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digests(none).count() == 0


def test_suffix_dedup_of_a_passage_that_very_many_texts_share(spark, monkeypatch):
    """No bucket may hold all blocks of a hot leading token; the result is that of the buckets and of brute force."""
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz é"
    passage = "".join(rng.choice(letters) for _ in range(390))
    around = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
    rows = [(i, around() + passage[rng.choice([0, 0, 0, 7]):] + around()) for i in range(400)] + [(900, passage[:250]), (901, passage[150:]), (None, passage), (902, None)]
    largest = []
    sort = suffix_dedup._sort_bucket

    def watched(batches):
        batches = list(batches)
        assert sum(b.num_rows for b in batches) <= 4 * 60
        return sort(iter(batches))

    monkeypatch.setattr(suffix_dedup, "BUCKET", 60)
    monkeypatch.setattr(suffix_dedup, "_sort_bucket", watched)
    hot_tokens = suffix_dedup.hot_tokens
    monkeypatch.setattr(suffix_dedup, "hot_tokens", lambda *a: largest.append(hot_tokens(*a)) or largest[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = [raw(t) for _, t in rows]
    want = sorted(((i, sum(g), sha(bytes(b for b, x in zip(t, g) if not x))) for (i, _), t, g in zip(rows, texts, repeated(texts, 200))), key=str)
    assert found(suffix_dedup.digest(df), ["doc_id", "n_removed", "kept_sha256"]) == want
    assert largest[0] is not None and largest[0].count() > 0
