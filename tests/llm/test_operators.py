"""Each operator on small tables against brute force, with nulls, empty texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.llm import components, decontaminate, html, licenses, line_dedup, near_dup, packing, quality, substring, token_output, warc
from skarn.llm.encode import Encoder

DOCS = "doc_id long, text string, row string, doc string, parts int"


def vocabulary(seed=0, n=300):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Documents with exact and near copies, shared passages, periodic text, repeated lines, nulls and empty texts."""
    r, words = random.Random(seed), vocabulary()
    make = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, texts = make(60), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and i > 6:
            texts.append(texts[i - 6])
        elif kind == 2 and i > 6:
            old = (texts[i - 1] or "").split(" ")
            old[r.randrange(len(old))] = "edited"
            texts.append(" ".join(old))
        elif kind == 3:
            texts.append(f"{make(r.randint(1, 50))} {passage} {make(5)}\n{make(12)}")
        elif kind == 4:
            texts.append("\n".join(make(r.randint(1, 14)) for _ in range(r.randint(1, 9))))
        else:
            texts.append(make(r.randint(1, 130)))
    return texts + [None, "", " \n\t ", "one", "a b c d", "ab ab ab " * 60, "Éé " * 3]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, f"r{i}", "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


def words(text, pattern=r"[^\x20\x09-\x0D]+", lower=False):
    text = text or ""
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if lower else text)


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(5, 5), (None, 3), (900, 901), (900, 901)] + [(1000 + k, 1001 + k) for k in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_id_with_very_many_links_is_split(spark):
    """A star: the join that moves its links is divided among tasks, as no aggregate stands between it and its exchange."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        star = components.written(spark.range(1, 400_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")), "star")
        moved = components._large_star(star)
        assert moved.count() == 400_000
        moved.write.format("noop").mode("overwrite").save()
        rows = moved.collect()
        assert len(rows) == 400_000 and "skew=true" in moved._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_near_duplicates(spark, docs, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    want = {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert len({w[1] for w in want.values()}) < len(texts) - 5
    # one block, and every limit so low that nodes branch and groups are cut into blocks
    for params in ({}, {"node_size": 3, "task_docs": 2, "task_shingles": 150}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, **params).collect()}
        assert got == want
    kept = near_dup.near_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_near_duplicates_at_the_edges(spark):
    rows = frame(spark, ["a b c d e f", "A b c d e f", None, "x", "x"], [3, 3, None, 7, 7])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(rows).collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (7, 7, True), (7, 7, True), (None, None, True)]
    assert near_dup.near_duplicates(rows.limit(0)).count() == 0
    assert near_dup.missed() < 1e-5 and near_dup.missed(levels=1) < 2e-5 and near_dup.missed(levels=4) < 2e-4
    with pytest.raises(ValueError):
        near_dup.near_duplicates(rows, trees=11)
    clash = rows.withColumnsRenamed({"row": "__gone", "doc": "__at"})
    assert near_dup.near_dedup(clash).columns == clash.columns and near_dup.near_dedup(clash).count() == 5


def test_substrings(spark, docs, texts):
    listed = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[k : k + 35]) for w in listed for k in range(len(w) - 34))
    want = {}
    for i, w in enumerate(listed):
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    assert sum(w[1] for w in want.values()) > 500
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_report(docs).collect()}
    assert got == want
    cut = {r.doc_id: r.text for r in substring.substring_dedup(docs).collect()}
    assert all(hashlib.sha256(" ".join(words(cut[i])).encode()).hexdigest() == want[i][2] for i in want)
    assert substring.substring_report(docs.limit(0)).count() == 0
    # each factor is a copy of what stands at its reference, and no other place of the same text
    by_row = substring.duplicate_spans(docs.select(F.col("doc_id").alias("row"), "text")).collect()
    made = [(r.row, *x) for r in by_row for x in zip(r.starts, r.sizes, r.ref_rows, r.ref_starts)]
    assert len(made) > 20 and max(size for _, _, size, _, _ in made) >= 60
    for row, start, size, ref, at in made:
        assert size >= 35 and (row, start) != (ref, at) and listed[row][start : start + size] == listed[ref][at : at + size]
    clash = docs.withColumnsRenamed({"row": "starts", "doc": "sizes", "parts": "__row"})
    assert substring.substring_dedup(clash).columns == clash.columns


def test_substrings_of_a_very_long_text(spark):
    r, words_of = random.Random(6), vocabulary(2, 5000)
    long = [r.choice(words_of) for _ in range(400_000)]
    texts = [" ".join(long), " ".join(long[1000:1100]), None, "short"]
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring.substring_report(frame(spark, texts)).collect()}
    assert got == {0: (400_000, 100), 1: (100, 100), 2: (0, 0), 3: (1, 0)}


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join(words(texts[3])[2:40])), (2, "one"), (3, None), (4, "absent words here"), (5, "--"), (10, " ".join(words(texts[3])[2:40]).upper()), (7, "ab")]
    table = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t, pattern, True)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t, pattern, True), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    assert 2 < sum(w[4] for w in want.values()) < len(texts) - 2
    for params in ({}, {"max_windows": 30}):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination_report(docs, table, **params).collect()}
        assert got == want
    kept = decontaminate.decontaminate(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[4]}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, table, "spans").collect()}
    assert all(len(words(cut[d], pattern, True)) == w[0] - w[1] for d, w in want.items()) and cut[len(texts) - 7] is None
    assert decontaminate.contamination_report(docs, table.limit(0)).where("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, table, "other")


def test_windows_in_bounded_memory():
    from skarn.llm.kernel import column_bytes

    r = random.Random(3)
    items = [(str(k), " ".join(str(r.randrange(10**6)) for _ in range(210))) for k in range(5000)]
    windows = decontaminate.WindowSet(items, 10)
    assert windows.nbytes() < 90e6 and sum(len(x[1]) for x in windows.by_size.values()) > 1_000_000
    data, offsets = column_bytes(pa.array([f"x {items[7][1]} y", "nothing here", " ".join(items[9][1].split(" ")[5:15])]))
    hits = windows.hits(decontaminate.Words(data, offsets, decontaminate.ALNUM, lower=True))
    assert {(t, tuple(i)) for t, _, _, i in hits} == {(0, ("7",)), (2, ("9",))} and len(hits) == 202


def test_token_output(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = Encoder(path).tokenizer
    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output.token_output(docs, path).collect())
    at, want = 0, []
    for i, t in enumerate(texts):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows == want
    one = token_output.token_output(docs, path).where("doc_id = 5").first()
    assert token_output.fetch(one.path, 5)[0].tolist() == [*enc.encode(texts[5], add_special_tokens=False).ids, 0]
    assert token_output.token_output(docs.limit(0), path).count() == 0
    # several files a task, a null key first, repeated keys kept
    odd = frame(spark, ["b", "a", "c", None], [2, None, 2, 1]).coalesce(1)
    manifest = token_output.write_tokens(odd, path, token_output.new_path(spark, "t"), file_bytes=1)
    got = sorted((r.at, r.doc_id) for r in token_output.read_tokens(spark, manifest).collect())
    assert manifest.count() == 4 and [k for _, k in got] == [None, 1, 2, 2]


def test_packing(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = Encoder(path).tokenizer
    rows = packing.pack(docs, path, capacity=64, with_ids=True).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), 64)):
            want[i, k] = (s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) <= 1.1 * -(-sum(w[1] for w in want.values()) // 64)
    made = packing.sequences(packing.pack(docs, path, capacity=64, with_ids=True)).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in made) and sum(r.n_tokens for r in made) == sum(w[1] for w in want.values())
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_plans_on_many_distributions():
    """Never more sequences than best-fit decreasing, written out here, nor fewer than the bound; all pieces, once."""
    rng = np.random.default_rng(3)
    cases = [rng.lognormal(m, s, n).astype(int) + 1 for m, s, n in ((7, 0.5, 4000), (6.5, 0.6, 4000), (6, 1, 8000), (5, 1.2, 8000))]
    cases += [rng.integers(1, 2049, 3000), rng.integers(650, 900, 3000), rng.integers(400, 1200, 3000), rng.choice([683, 684, 700, 1000, 300, 50], 2000), np.full(7, 2048), np.array([1])]
    gained = 0
    for lengths in cases:
        pieces = sorted([2048] * int((lengths // 2048).sum()) + [int(x) for x in lengths % 2048 if x], reverse=True)
        rooms, by_room = 0, [0] * 2049
        for x in pieces:
            room = next((r for r in range(x, 2049) if by_room[r]), None)
            if room is None:
                rooms, room = rooms + 1, 2048
                by_room[room] += 1
            by_room[room] -= 1
            by_room[room - x] += 1
        counts = collections.Counter(pieces)
        plan = packing.packing_plan(counts, 2048)
        held = collections.Counter()
        for pattern, count in plan:
            assert sum(pattern) <= 2048
            for x in pattern:
                held[x] += count
        made = sum(count for _, count in plan)
        assert held == counts and packing.lower_bound(counts, 2048) <= made <= rooms
        gained += rooms - made
    assert gained > 50


def test_quality(spark):
    r, vocab = random.Random(2), vocabulary()
    good = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 90))).capitalize() + "." for _ in range(300)]
    bad = [" ".join(r.choice(vocab) + r.choice(["%%%", "###"]) for _ in range(r.randint(20, 90))) for _ in range(40)]
    texts = good + bad + [None, "", "too few words", "x y z w v " * 30]
    docs = frame(spark, texts).cache()
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 340, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = {x.doc_id: x for x in quality.quality_report(docs, model).collect()}
    for i, t in enumerate(texts):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        five = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(got[i][1:6]) == base and got[i].base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (got[i].base_failed and got[i].kept)
    # held out: the odd rows had no label
    assert np.mean([got[i].kept for i in range(1, 300, 2)]) > 0.97 and not any(got[i].kept for i in range(301, 340, 2))
    kept = quality.quality_filter(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i in got if got[i].kept}
    # the verdict from path lengths found by walking each tree
    base, features = quality.statistics(pa.array(texts))
    forest = model.forest
    for i in range(0, len(texts), 7):
        lengths = []
        for tree in range(len(forest.feature)):
            node = 1
            while np.isfinite(forest.value[tree, node]):
                node = 2 * node + int(features[i, forest.feature[tree, node]] > forest.value[tree, node])
            lengths.append(forest.leaf[tree, node])
        score = 2.0 ** (-np.mean(lengths) / forest.scale)
        assert got[i].kept == (not got[i].base_failed and score <= model.threshold)
    # a key that documents have twice is one labelled row, and ties stay
    twice = quality.fit_quality(docs.union(docs), labels)
    assert np.array_equal(twice.forest.value, forest.value) and twice.threshold == model.threshold
    assert quality.QualityModel(forest, float(forest.scores(features)[0])).kept(base, features)[0]
    none = quality.fit_quality(docs, labels.limit(0))
    assert quality.quality_report(docs, none).where("kept = base_failed").count() == 0
    assert quality.quality_report(docs.limit(0), model).count() == 0


def edit_distance(a, b):
    """The textbook table, a row at a time."""
    y, at = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    row = at.copy()
    for i, c in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (y != ord(c)), row[1:] + 1)))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def normal_form(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in line)
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def line_groups(rows, similarity=0.85):
    """Brute force by edit similarity over all pairs of normal forms: (id, line) of each line that goes, and the pairs."""
    where = [(i, n, normal_form(x)) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    names = sorted({x for _, _, x in where if x}, key=len)
    up, pairs = {x: x for x in names}, []

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            limit = int((1 - similarity) * len(b) + 1e-9)
            if len(b) - len(a) > limit:
                break
            if sum(((collections.Counter(a) - collections.Counter(b)) | (collections.Counter(b) - collections.Counter(a))).values()) <= 2 * limit and edit_distance(a, b) <= limit:
                pairs.append((a, b))
                up[find(b)] = find(a)
    first = {}
    for i, n, x in sorted(where):
        if x:
            first.setdefault(find(x), (i, n))
    return {(i, n) for i, n, x in where if x and first[find(x)] != (i, n)}, pairs


def edited(r, line, vocab):
    """One word changed, one letter changed, or a word left out."""
    w, kind = line.split(" "), r.randrange(3)
    k = r.randrange(len(w))
    if kind == 0:
        w[k] = r.choice(vocab)
    elif kind == 1:
        j = r.randrange(len(w[k]))
        w[k] = w[k][:j] + r.choice("klmnop") + w[k][j + 1 :]
    else:
        w.pop(k)
    return " ".join(w)


def test_lines(spark):
    r, vocab = random.Random(8), vocabulary()
    lines = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 30))) for _ in range(40)]
    texts = []
    for _ in range(60):
        picked = [r.choice(lines) if r.random() < 0.5 else " ".join(r.choice(vocab) for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 4))]
        texts.append("\n".join(x.upper() + "!" if r.random() < 0.2 else edited(r, x, vocab) if r.random() < 0.4 and x.count(" ") > 11 else x for x in picked))
    texts += [None, "", "\n\n", "...\n...", "é\né", "page 12", "Page 97."]
    docs = frame(spark, texts).repartition(3).cache()
    gone, pairs = line_groups(list(enumerate(texts)))
    assert len(gone) > 40 and len(pairs) > 20
    want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)}
    for params in ({}, {"task_lines": 3, "task_chars": 500}):
        got = {x.doc_id: x for x in line_dedup.line_report(docs, **params).collect()}
        assert {i: x.text for i, x in got.items()} == want
    assert all(x.n_removed == len([1 for i, _ in gone if i == x.doc_id]) for x in got.values())
    clash = docs.withColumnsRenamed({"row": "__lines", "doc": "__doc", "parts": "lines"})
    kept = line_dedup.line_dedup(clash)
    assert kept.columns == clash.columns and {x.doc_id: x.text for x in kept.collect()} == want
    assert line_dedup.line_report(docs.limit(0)).count() == 0
    odd = frame(spark, ["same line here", "same line here", "same line here"], [None, 4, 4])
    assert [x.n_removed for x in line_dedup.line_report(odd).collect()] == [0, 0, 0]


def test_line_recall_by_length(spark):
    """Pairs of lines that the edit similarity alone decides, each apart from the others, by words in a line."""
    r, vocab = random.Random(18), vocabulary(9, 3000)
    lines, size = [], {}
    for n in (5, 8, 12, 20, 40, 90):
        for _ in range(60):
            a = " ".join(r.choice(vocab) for _ in range(n))
            b = edited(r, a, vocab)
            for _ in range(n // 20):
                b = edited(r, b, vocab)
            if edit_distance(a, b) <= int(0.15 * max(len(a), len(b)) + 1e-9):
                size[len(lines) + 1] = n
                lines += [a, b]
    gone = {x.doc_id for x in line_dedup.line_report(frame(spark, lines).repartition(3)).collect() if x.n_removed}
    found = collections.Counter(size[x] for x in gone)
    assert gone <= set(size)
    assert all(found[n] >= 0.93 * k and k > 20 for n, k in collections.Counter(size.values()).items())
    assert line_dedup.met(0.6) > 0.99 and line_dedup.met(0.5) > 0.96


def test_very_long_lines(spark):
    """Lines far over any block, similar and not, compared in time that does not grow with their square."""
    r, vocab = random.Random(5), vocabulary(4, 2000)
    long = [r.choice(vocab) for _ in range(60_000)]
    other = list(long)
    for k in range(0, 60_000, 3000):
        other[k] = "changed"
    texts = [" ".join(long), " ".join(other), " ".join(long[:30_000])]
    got = {x.doc_id: x.n_removed for x in line_dedup.line_report(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    for a, b in (("kitten", "sitting"), ("", "abc"), ("same", "same"), ("abcdef", "azced")):
        assert line_dedup.distance(a, b, 9) == edit_distance(a, b)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(2))
        assert line_dedup.distance(a, b, 99) == edit_distance(a, b) and (line_dedup.distance(a, b, 5) <= 5) == (edit_distance(a, b) <= 5)


def test_licenses(spark):
    filler = " ".join(vocabulary(3, 200))
    full = dict(licenses.TEMPLATES)
    most = full["MIT-full"].split(" ")
    texts = [f"{filler}. {full['MIT']} {filler}", f"{filler} {' '.join(most[:-4])} and more {filler}", f"{filler} {' '.join(most[:12])} {filler}", None, "", filler, full["Apache-2.0-header"], "RELEASED, under... the\nMIT license"]
    docs = frame(spark, texts)
    got = {(r.doc_id, r.template_id) for r in licenses.license_scan(docs, licenses.default_templates(spark)).collect()}
    assert got == {(0, "MIT"), (1, "MIT-full"), (1, "MIT-grant"), (6, "Apache-2.0-header"), (6, "Apache-2.0"), (7, "MIT")}
    short = spark.createDataFrame([("s", "Public Domain"), ("n", None), (None, "x"), ("e", "--")], "template_id string, text string")
    rows = spark.createDataFrame([(1, "in the public domain now"), (2, "public and domain")], "doc_id long, text string")
    assert [(r.doc_id, r.containment) for r in licenses.license_scan(rows, short).collect()] == [(1, 1.0)]
    assert licenses.license_scan(rows, short.limit(0)).count() == 0 and licenses.license_scan(rows.limit(0), short).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(rows, short, most=0)
    # several passes give what one gives
    whole = {tuple(r) for r in licenses.license_scan(docs, licenses.default_templates(spark)).collect()}
    assert {tuple(r) for r in licenses.license_scan(docs, licenses.default_templates(spark), most=9).collect()} == whole
    assert licenses.band_count(10, 14, 0.75, 1e-5) >= 12


PAGE = "<html><body><div class='menu'>Menu {0}</div><div class='c{0} story'><h2>Head {0}</h2><p>Body text of page {0}, long enough.</p></div><div class='foot'>{1}</div></body></html>"


def test_pages(spark):
    """A page whose own best container is furniture follows the path that its host's other pages voted for."""
    rows = [(i, f"http://h.example/{i}", PAGE.format(i, "Terms and conditions " * (30 if i == 0 else 1))) for i in range(8)]
    rows += [(8, None, "<p>alone</p>"), (9, "http://x.example/", None), (None, "http://h.example/n", PAGE.format(77, "")), (3, "http://h.example/3", rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert "Terms" in html.extract(rows[0][2])
    for params in ({}, {"broadcast_hosts": 0}):
        got = [(r.page_id, r.text, r.n_chars) for r in html.extract_pages(pages, **params).collect()]
        assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
        by = {k: t for k, t, _ in got}
        assert all(by[i] == f"Head {i}\n\nBody text of page {i}, long enough." for i in range(8)) and by[None].startswith("Head 77")
        assert by[8] == "alone" and by[9] == ""
    assert html.extract_pages(pages.limit(0)).count() == 0
    assert {r.host: r.path for r in html.host_paths(pages).collect()}["h.example"] == html.path_of("html", "body", "div.c.story")


LONG = "This sentence is running text, long enough to be told from a label or a link."
AROUND = (
    "<html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><header class='site-header'><a href=/>Home</a> Slogan</header><nav><ul><li><a href=/a>One</a></ul></nav>"
    "<div class='cookie-notice'><p>We use cookies, and say so at some length here.</p></div><div class=breadcrumbs><a href=/>Home</a> / here</div>{}"
    "<div class='sidebar-left'><p>Other things of interest, told at some length.</p></div><section id=comments><article class=comment><p>A reader says this and that, and more.</p></article></section>"
    "<form><label>Mail</label><input><button>Send</button></form><div class='share-buttons'>Share it</div><script>var p='<p>no</p>'</script><footer>&copy; nobody</footer></body></html>"
)
WRAPPED = ["<article>{}</article>", "<main>{}</main>", "<main><div class=x><article class='post'>{}</article></div></main>", "<div class='story'>{}</div>", "<div id=content><div class='post-body'>{}</div></div>", "<div role=main>{}</div>", "<section class=entry>{}</section>"]
BODIES = [
    (f"<h1>Head</h1><p>{LONG}</p><p>{LONG} Again.</p>", ["Head", LONG, f"{LONG} Again."]),
    (f"<h1>Head</h1><p>{LONG}</p><section><p>{LONG} {LONG}</p><p>{LONG} Third.</p></section>", ["Head", LONG, f"{LONG} {LONG}", f"{LONG} Third."]),
    (f"<h1>Head</h1><p>{LONG}</p><ul>" + f"<li>{LONG} Item.</li>" * 5 + "</ul>", ["Head", LONG, *[f"{LONG} Item."] * 5]),
    (f"<h2>Head</h2><p>{LONG}</p><table><tr><th>Key<th>Value<tr><td>{LONG}<td>{LONG} Cell.</table>", ["Head", LONG, "Key", "Value", LONG, f"{LONG} Cell."]),
    (f"<h1>Head</h1><p class='share-price'>{LONG}</p><p class='form-of-life'>{LONG} Two.</p><div class='response-rate'>{LONG} Three.</div>", ["Head", LONG, f"{LONG} Two.", f"{LONG} Three."]),
    (f"<header><h1>Head</h1></header><p>{LONG}<p>{LONG} <b>Bold<p>{LONG} End.</b>", ["Head", LONG, f"{LONG} Bold", f"{LONG} End."]),
    (f"<h1>A &amp; B</h1><p>{LONG} With <a href='/x'>a link</a>,<br>and a break&#33;</p><blockquote><p>{LONG} Quoted.</p></blockquote>", ["A & B", f"{LONG} With a link, and a break!", f"{LONG} Quoted."]),
    (f"<h1>Head</h1><div>{LONG}</div><div>{LONG} Two.</div><pre>{LONG}\n  code</pre>", ["Head", LONG, f"{LONG} Two.", f"{LONG} code"]),
    (f"<h1>Head</h1><p>{LONG}</p><div class='ad-slot'>Buy it</div><aside>Aside</aside><div class='social-share'>Share</div><p>{LONG} Last.</p>", ["Head", LONG, f"{LONG} Last."]),
    (f"<h1>Head</h1><dl><dt>Term<dd>{LONG}<dt>Other<dd>{LONG} Two.</dl><figure><img src=x><figcaption>A caption.</figcaption></figure><p>{LONG}</p>", ["Head", "Term", LONG, "Other", f"{LONG} Two.", "A caption.", LONG]),
]


def test_page_shapes(spark):
    """Seventy pages by wrapper and body, each on a host of its own and all of one wrapper on one host."""
    rows, want = [], {}
    for w, wrapper in enumerate(WRAPPED):
        for b, (body, blocks) in enumerate(BODIES):
            for host in (f"own-{w}-{b}", f"all-{w}"):
                want[len(rows)] = "\n\n".join(blocks)
                rows.append((len(rows), f"http://{host}/{b}", AROUND.format(wrapper.format(body))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    assert [k for k in want if got[k] != want[k]] == []


def test_page_ties_and_odd_markup():
    assert html.extract("<div class=a><p>same text here</p></div><div class=b><p>same text here</p></div>") == "same text here"
    assert html.extract("a < b and <3 &lt;p&gt;<!-- x --><![CDATA[y]]>") == "a < b and <3 <p>"
    assert html.extract("<p>one<p>two</span></div>three</p>") == "one\n\ntwothree"
    assert html.extract("<p title='unclosed>text</p><p>more</p>") != "" and html.extract("text <b") == "text <b"


def test_long_pages_in_linear_time():
    n = 100_000
    began = time.monotonic()
    assert html.extract("<div>" * n + "deep" + "</div>" * n) == "deep"
    assert html.extract("<p>start</p>" + "<a x=\"" * n).startswith("start")
    for page in ("<b>" * n, "<p " * n, "<li>x" * n, "<div>" * n + "<td>" * n + "</span>" * n, "<a\">\"" * n, "<a b='" * n + ">", "<!-" * n, "&amp" * n):
        html.extract(page)
    assert len(html.extract(f"<article><p>{'long text ' * n}</p></article>")) == 10 * n - 1
    assert time.monotonic() - began < 60


def test_warc(spark):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "other"), (4, "http://c", None), (7, "http://d", ""), (None, "http://e", "same"), (5, "http://b", "same"), (9, "http://ü/ x", "é" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.url) for r in warc.warc(pages).collect()), key=str)
    want = [(1, 4, "revisit", 5, "http://a"), (5, 4, "response", None, "http://b"), (5, 4, "response", None, "http://b"), (3, 5, "response", None, None), (4, 0, "revisit", 7, "http://c"), (7, 0, "response", None, "http://d"), (None, 4, "revisit", 5, "http://e"), (9, 6000, "response", None, "http://ü/ x")]
    assert got == sorted(want, key=str)
    manifest = warc.write_warc(pages, warc.new_path(spark, "w"), min_bytes=10, frame_bytes=200, file_bytes=1)
    assert warc.read_warc(manifest).where("record_type = 'revisit'").count() == 0
    one = warc.read_warc(manifest).where("page_id = 9").first()
    ids = []
    for r in warc.write_warc(pages, warc.new_path(spark, "ids"), file_bytes=1).collect():
        content = b"".join(warc.Reader(r.path).frames())
        at, kinds = 0, []
        while at < len(content):
            head, _, at = warc.parse(content, at)
            ids.append(head["WARC-Record-ID"])
            kinds.append(head["WARC-Type"])
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
    assert len(ids) == len(set(ids)) == 16 and all(warc.key_of(warc.record_id(k, 77)) == k for k in (None, 0, -1, 2**63 - 1, -(2**63)))
    assert warc.fetch(one.path, 9).partition(b"\r\n\r\n")[2].decode() == "é" * 3000 and warc.fetch(one.path, 12345) is None
    assert warc.warc(pages.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Texts of a million words or characters and more beside short ones, whole."""
    r, words_of = random.Random(11), vocabulary(7, 4000)
    long = [r.choice(words_of) for _ in range(300_000)]
    other = list(long)
    for k in range(0, 300_000, 100):
        other[k] = "edited"
    texts = [" ".join(long), " ".join(other), "short text of six words here", None]
    docs = frame(spark, texts)
    got = {x.doc_id: (x.component_id, x.kept) for x in near_dup.near_duplicates(docs).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (2, True), 3: (3, True)}
    items = spark.createDataFrame([(1, " ".join(long[299_900:299_915])), (2, "nothing of this")], "item_id long, text string")
    hits = {x.doc_id: (x.n_words, x.n_hit, x.n_items) for x in decontaminate.contamination_report(docs, items).collect()}
    assert hits[0] == (300_000, 15, 1) and hits[2] == (6, 0, 0) and hits[1][2] == 1
    pages = spark.createDataFrame([(1, "http://a", f"<p>{texts[0]}</p>"), (2, "http://b", f"<p>{texts[0]}</p>"), (3, None, "")], "page_id long, url string, html string")
    found = {x.page_id: (x.payload_bytes, x.record_type) for x in warc.warc(pages).collect()}
    size = len(texts[0]) + 7
    assert found == {1: (size, "revisit"), 2: (size, "response"), 3: (0, "response")}
    assert {x.page_id: x.n_chars for x in html.extract_pages(pages).collect()} == {1: len(texts[0]), 2: len(texts[0]), 3: 0}
    judged = {x.doc_id: x for x in quality.quality_report(docs, quality.QualityModel(None, 1.0)).collect()}
    assert judged[0].n_words == 300_000 and judged[3].base_failed and judged[2].n_words == 6
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(docs, path).collect()
    assert {x.doc_id for x in packed} == {0, 1, 2, 3} and sum(x.length for x in packed if x.doc_id == 0) > 300_000
