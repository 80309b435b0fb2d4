"""Pure functions against plain versions: hashes, encoding, packing, HTML, seekable files, records."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import html, kernel, line_dedup, packing, seekable, warc
from skarn.llm.encode import Encoder

TEXTS = st.lists(st.one_of(st.none(), st.text("ab é\n\t#1.", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, offsets = kernel.column_bytes(pa.array(texts, pa.string()))
    words = kernel.Words(data, offsets, kernel.BLACK)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [words.text(a, b).decode().split(" ") if b > a else [] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == want
    hashed, flat = words.hashes(), [w for ws in want for w in ws]
    assert len(set(hashed.tolist())) == len(set(flat)) and len({*zip(hashed.tolist(), flat, strict=True)}) == len(set(flat))
    for s, ws in zip(kernel.shingle_sets(words, 3), want, strict=True):
        assert len(s) == len({tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}) * bool(ws)


def test_rolling_hashes_depend_on_their_words_alone():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 5, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (2, 5, 12, 35):
        got = kernel.rolling(words, n)
        runs = [words[i : i + n].tobytes() for i in range(len(got))]
        assert len(set(zip(runs, got.tolist(), strict=True))) == len(set(runs)) == len(set(got.tolist()))


def test_blocks_hold_whole_texts():
    offsets = np.cumsum([0, 5, 0, 100, 3, 3, 3])
    assert list(kernel.blocks(offsets, 8)) == [(0, 2), (2, 3), (3, 5), (5, 6)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=80, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text("aB'st 1é\n\t.!\x1c\x85<|>", max_size=80)))
def test_encoding_equals_the_library(name, text):
    enc = _encoder(name)
    assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


_MADE: dict[str, Encoder] = {}


def _encoder(name):
    return _MADE.setdefault(name, Encoder(public_tokenizers.path(name)))


def test_encoding_of_odd_texts():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = _encoder(name)
        for t in ["", None, "  two  spaces ", "a\n\nb", "end <|endoftext|> of", "x" * 5000, "'s 's it's", "ΣΑΣ é é", " lead", "trail\n"]:
            assert enc.ids(t).tolist() == (enc.tokenizer.encode(t, add_special_tokens=False).ids if t else [])


def test_seekable_files(tmp_path):
    path = str(tmp_path / "a" / "f.zst")
    out = seekable.Writer(path)
    contents = [b"", b"x" * 100_000, b"last"]
    for c in contents:
        out.frame(c)
    out.close(b"directory")
    reader = seekable.Reader(path)
    assert list(reader.frames(step=10)) == contents and reader.frame(2) == b"last" and reader.directory == b"directory"
    # a plain reader passes over the tables
    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert whole == b"".join(contents)
    raw = bytearray(open(path, "rb").read())
    for place in (-20, 15):
        bad = bytearray(raw)
        bad[place] ^= 1
        open(path, "wb").write(bad)
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(seekable.Reader(path).frames())
    open(path, "wb").write(b"nothing here to read")
    with pytest.raises(ValueError):
        seekable.Reader(path)


@pytest.mark.parametrize("key", [0, 5, -3, 2**63 - 1, -(2**63), None])
def test_records(key):
    assert warc.key_of(warc.record_id(key)) == key
    url = "http://a b/%20?q=ü\r\nX: y"
    data = warc.record(key, url, "é\r\n\r\n".encode(), (False, None), "2000-01-01T00:00:00Z")
    assert warc.described(b"zz" + data, 2) == (key, url, 6, warc.digest("é\r\n\r\n".encode()), "response", None)
    data = warc.record(key, None, b"abc", (True, 9), "2000-01-01T00:00:00Z")
    assert warc.described(data, 0) == (key, None, 3, warc.digest(b"abc"), "revisit", 9)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_packing_plan(counts):
    plan = packing.packing_plan(counts, 64, ((6, 1 / 4), (0, 1.0)))
    assert sum(c for _, c in plan) >= packing.lower_bound(counts, 64)
    got: dict[int, int] = {}
    for pattern, count in plan:
        assert sum(pattern) <= 64 and count > 0
        for length in pattern:
            got[length] = got.get(length, 0) + count
    assert got == counts
    used, tokens = sum(c for _, c in plan), sum(k * c for k, c in counts.items())
    # never worse than first-fit's bound
    assert used <= 1.7 * -(-tokens // 64) + 1
    places, seen = packing.Places(plan) if plan else None, set()
    for length, count in counts.items():
        sequence, offset = places.find(np.full(count, length), np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            span = {(s, x) for x in range(o, o + length)}
            assert not span & seen and o + length <= 64
            seen |= span
    by: dict[int, int] = {}
    for s, _ in seen:
        by[s] = by.get(s, 0) + 1
    assert all({x for t, x in seen if t == s} == set(range(n)) for s, n in by.items())


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths, n = np.unique(np.minimum(rng.lognormal(6.0, 1.0, 60_000).astype(int) + 1, 2048), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    used = sum(c for _, c in packing.packing_plan(counts, 2048))
    assert used <= 1.002 * -(-int((lengths * n).sum()) // 2048)


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(1500):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 90)))
        b = "".join(c if r.random() > 0.05 else r.choice(["", "d", c + "a"]) for c in a)
        d = plain(a, b)
        assert all((line_dedup.distance(a, b, x) <= x) == (d <= x) for x in {0, max(0, d - 1), d, d + 1})
        assert line_dedup.distances(a, [b, a, "", b[::-1]]).tolist()[:3] == [d, 0, len(a)] and line_dedup._by_anchors(a, b, 999, 8) >= d
        some = [b, a[::-1], "d" * len(a), b + "dd"]
        limits = np.array([int(0.15 * max(len(a), len(x))) for x in some])
        near = (line_dedup.distances(a, some, limits, 5) <= limits).tolist()
        assert near == (line_dedup.distances(a, some) <= limits).tolist() == [plain(a, x) <= y for x, y in zip(some, limits)]


def test_simhash():
    data, offsets = kernel.column_bytes(pa.array(["Hello world, foo 12\n\nbar baz qux\n" + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)), "", "x"]))
    found = line_dedup.Lines(data, offsets)
    assert [found.normal(k)[:20] for k in range(4)] == ["hello world foo 00", "bar baz qux", "waa wba wca wda wea ", "x"]
    which, rows = found.pairs()
    assert which.tolist() == [2] and found.grams()[0].tolist() == [0, 1, 3]
    low, size = int(found.low[2]), int(found.size[2])
    h = found.hashed[low : low + size]
    features = kernel.mix(h[:-1] + np.uint64(0xA0761D6478BD642F) * h[1:])[:40]
    doubled = np.arange(40) % 4
    got = line_dedup.simhashes(features, np.array([0]), np.array([40]), np.array([7]), doubled)[0]
    assert got[48:].tolist() == [7, 0, 0, 0] and rows.shape == (1, 52)
    # the sign of each bit's sum over all features, whose weights double from rank to rank
    for k in range(line_dedup.WORDS):
        order = [((int(f) >> 32 ^ int(line_dedup._SEED[k])) * int(line_dedup._FACTOR[k]) % 2**32) >> int(d) for f, d in zip(features, doubled)]
        weights = {v: 2 ** (40 - rank) for rank, v in enumerate(sorted(order))}
        bits = {v: int(kernel.mix(np.array([v + (k << 32)], np.uint64))[0]) for v in order}
        word = sum(1 << b for b in range(16) if sum(weights[v] * (1 if bits[v] >> b & 1 else -1) for v in order) > 0)
        assert int(got[k]) + (int(got[line_dedup.WORDS + k]) << 8) == word


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><div class="site-header">Site</div>
<nav><ul><li><a href=x>Home</a><li>About</ul></nav><!-- <p>gone</p> --><main class="has-sidebar"><article class="post-12"><h1>Title &amp; more</h1><p>First <b>para</b>
graph.<p>Second<br>line &eacute; <a href="q">link</a><div class="ad">Buy</div><table><tr><td>one<td>two</table><form>Name <input></form><p><b>open<br><p>Last</article>
<section id="comments"><p>A reader comment that is rather long, so that it would win if it were scored at all, would it not?</p></section></main><aside>Side</aside><footer>(c)</footer></body></html>"""


def test_main_text():
    want = "Title & more\n\nFirst para graph.\n\nSecond line é link\n\none\n\ntwo\n\nopen\n\nLast"
    assert html.extract(PAGE) == want
    assert html.extract(PAGE, html.path_of("html", "body", "main.hassidebar", "article.post")) == want
    assert html.extract(PAGE, html.path_of("html", "body", "absent")) == want
    assert html.extract("") == "" and html.extract("<p") == "<p" and html.extract("just text") == "just text"
    assert html.extract("<div>" * 3000 + "deep") == "deep"
    assert html.container(html.parse("")) is None


def test_letters_bound_the_edit_distance():
    from skarn.llm.line_dedup import apart, distance, letters

    rng = np.random.default_rng(8)
    texts = ["", "a", "ä中😀", "aaaa", *("".join(rng.choice(list("abc ä中"), rng.integers(0, 30))) for _ in range(60))]
    bags = letters(texts)
    assert bags.sum(axis=1).tolist() == [len(t) for t in texts]
    bound = apart(bags[:, None], bags[None])
    assert all(bound[i, j] <= distance(a, b, 10**6) for i, a in enumerate(texts) for j, b in enumerate(texts))
    assert apart(*letters(["aaaa", "bbbbbb"])) == 6 and apart(*letters(["abc", "cba"])) == 0


def test_many_edit_distances_at_once():
    """As the distances one by one, with limits of up to several integers of bits."""
    r = random.Random(4)
    firsts, seconds, limits = [], [], []
    for letters in ("abcdefghij kl", "aä中😀"):
        for n in (0, 1, 5, 40, 150, 420, 430, 900, 2200):
            for _ in range(40):
                a = "".join(r.choice(letters) for _ in range(n))
                i, rate = r.randrange(n + 1), r.choice([0.01, 0.1, 0.4])
                b = "".join(c if r.random() > rate else r.choice(["", "d", c + "a"]) for c in a[:i]) + a[i:]
                b = b[r.randint(0, n // 12) :]
                firsts.append(a)
                seconds.append(b)
                limits.append(r.choice([int(0.15 * max(len(a), len(b))), 63, 64, line_dedup.distance(a, b, 10**6), max(0, line_dedup.distance(a, b, 10**6) - 1)]))
    want = [line_dedup.distance(a, b, k) <= k for a, b, k in zip(firsts, seconds, limits)]
    assert 200 < sum(want) < len(want) - 50
    for rows in (1024, 60):
        assert line_dedup.within(firsts, seconds, np.array(limits), rows).tolist() == want
    assert line_dedup.within([], [], np.zeros(0)).tolist() == []


def test_links_of_texts_join_what_is_similar():
    """Chains, stars and texts alone, of few and of many: the trees that grow side by side are joined."""
    r = random.Random(6)
    texts = []
    for _ in range(14):
        base = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(12)]
        for _ in range(r.randint(1, 9)):
            k = r.randrange(len(base))
            base[k] = "".join(r.choice("abcdefgh") for _ in range(7))
            texts.append(" ".join(base))
    for some in (texts[:40], texts):
        r.shuffle(some)
        found = line_dedup._of_lines(some)
        columns = [line_dedup._hash_column(len(some), *x) for x in (found.pairs(), found.grams())]
        out = []
        # no word of the hashes is asked for: all pairs of few texts, and those with a block in common of many
        line_dedup.side_by_side([line_dedup._verified(some, *columns, np.zeros(len(some), int), 0.85, out)], 0.85)
        tree = list(range(len(some)))
        for p, q in out:
            assert line_dedup.similar(some[p], some[q], 0.85) and tree[p] != tree[q]
            tree = [tree[p] if x == tree[q] else x for x in tree]
        rows = columns[0].to_pylist()
        agree = lambda a, b: sum(x == y for x, y in zip(rows[a][: line_dedup.WORDS], rows[b][: line_dedup.WORDS]))
        blocks = line_dedup._blocks_of(line_dedup._rows_of(columns[0])[1])
        for p in range(len(some)):
            for q in range(p):
                if agree(p, q) >= line_dedup.AGREE_PAIRS and any(v[p] == v[q] for v in blocks) and line_dedup.similar(some[p], some[q], 0.85):
                    assert tree[p] == tree[q]


def test_keys_dealt_many_to_a_row():
    """Rows of the buckets with several are found again, and of no others, however often a bucket comes at a time."""
    r = np.random.default_rng(5)
    bits = r.integers(0, 3, (400, 2 * line_dedup.WORDS + 4)).astype(np.uint8)
    bits[100:] = r.integers(0, 256, (300, 2 * line_dedup.WORDS + 4)).astype(np.uint8)
    bits[:60] = bits[0]
    order = r.permutation(400)
    column = line_dedup._hash_column(400, np.arange(400), bits[order])
    none = line_dedup._hash_column(400, np.arange(0), bits[:0])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(400)), column, none], names=["form", "pairs", "grams"])
    batches = [batch.slice(k, 50) for k in range(0, 400, 50)]
    keys = pa.Table.from_batches(line_dedup._keys(iter(batches))).to_pydict()
    times = collections.Counter(keys["bucket"])
    want = sorted((b, f) for b, f in zip(keys["bucket"], keys["form"]) if times[b] > 1)
    for most in (1, 700, 1 << 20):
        dealt = pa.Table.from_batches(line_dedup._dealt(iter(batches), 7, most)).sort_by("part").combine_chunks().to_batches(max_chunksize=9)
        got = pa.Table.from_batches(line_dedup._several(iter(dealt))).to_pydict()
        assert sorted(zip(got["bucket"], got["form"])) == want and len(want) > 700


def test_lines_are_counted_by_batch_and_brought_together():
    """Of a batch a form has one row with its SimHashes and the number of its copies; the first of all has them in the end."""
    texts = ["the same line\nno other is like this one", "the same line\n\n- -\nthe same line", "a line of its own\nTHE same, line"]
    data, offsets = kernel.column_bytes(pa.array(texts))
    batches = []
    for ids in ([5, 3, 9], [2, 2, 7]):
        found, parts = line_dedup.Lines(data, offsets), []
        parts.append((np.array(ids)[found.text], found.line.astype(np.int32), found.forms().view(np.int64), found.checks().view(np.int64), *found.pairs(), *found.grams()))
        batches.append(line_dedup._counted(parts))
    rows = batches[0].to_pylist()
    assert [(x["doc"], x["line"], x["copies"]) for x in rows] == [(5, 0, 0), (5, 1, 1), (3, 0, 4), (3, 3, 0), (9, 0, 1), (9, 1, 0)]
    assert all((x["grams"] is not None) == (x["copies"] > 0) for x in rows)
    assert pa.Table.from_batches(batches).column("pairs").null_count == 12
    counted = [b.filter(pa.array([x > 0 for x in b.column(4).to_pylist()])) for b in batches]
    (out,) = line_dedup._firsts(iter([*counted, counted[0].slice(0, 0)]))
    assert sorted((x["first"]["doc"], x["first"]["line"], x["copies"]) for x in out.to_pylist()) == [(2, 0, 8), (2, 1, 2), (7, 0, 2)]
    same = {x["form"]: x["grams"] for x in rows if x["copies"]}
    assert all(x["first"]["grams"] == same[x["form"]] and x["first"]["pairs"] is None for x in out.to_pylist())
    assert list(line_dedup._firsts(iter([counted[0].slice(0, 0)]))) == []


def test_line_words_are_hashed_eight_bytes_at_a_time():
    r = random.Random(5)
    some = ["".join(r.choices("ab0é", k=r.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 63, 64, 65, 200]))) for _ in range(3000)]
    text = " ".join(some)
    data, offsets = kernel.column_bytes(pa.array([text, "", "ab", "-"]))
    words = kernel.Words(line_dedup._NORMAL[data], offsets, kernel.ALNUM)
    spelled = [words.text(k, k + 1) for k in range(len(words.start))]
    got = line_dedup.word_hashes(words).tolist()
    assert len(spelled) == 3001 and len(set(got)) == len(set(zip(got, spelled))) == len(set(spelled))
    assert len(line_dedup.word_hashes(kernel.Words(data[:0], np.zeros(2, np.int64), kernel.ALNUM))) == 0


def test_normal_forms_of_many_lines_at_once():
    texts = ["One,  two\nTHREE 4 five-six", "", "\n \n", "é ü x", "end", "--a--\n--", "next"]
    found = line_dedup.Lines(*kernel.column_bytes(pa.array(texts)))
    assert found.normals().to_pylist() == [found.normal(k) for k in range(len(found.low))]
    assert found.normals().to_pylist()[:2] == ["one two", "three 0 five six"]
    assert line_dedup._of_lines([]).normals().to_pylist() == []


def test_texts_without_dropped_lines_stay_as_they_are():
    checks = line_dedup._of_lines(["b", "x"]).checks().view(np.int64).tolist()
    texts, lines = ["a\nb\nc", None, "a\nb", "", "q\nb\nx\nb"], [[1], [0], None, None, [1, 2, 3, 9]]
    own = [[checks[0]], [checks[0]], None, None, [checks[0], checks[0], checks[0], checks[0]]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(lines, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.int64()))], names=["text", "lines", "checks"])
    found, total, dropped = line_dedup._cleaned(batch, 0)
    assert found.to_pylist() == ["a\nc", None, "a\nb", "", "q\nx"]
    assert (total.tolist(), dropped.tolist()) == ([3, 0, 2, 1, 4], [1, 0, 0, 0, 2])
