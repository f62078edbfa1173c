"""The operators of the subpackage against brute force, on rows with every odd case."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bayes, bitpack, crf, licenses, minhash, mixing, neighbours, packing, suffixes, tokens, warc
from millrace.llm.common import CLEAN_UP, likely, materialize
from millrace.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, key string, n string, size string, component string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): nulls, empty, white space only, repeated rows and ids, copies, near copies, long."""
    rng = random.Random(3)
    base = [prose(rng, n) for n in (60, 80, 300, 120, 5000, 55, 70)]
    near = base[2].split()
    near[100] = "changed"
    passage = prose(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[0]), (11, base[0]), (12, " ".join(near)), (13, base[1] + "\n" + passage), (14, passage + " " + base[3]), (15, passage), (16, None), (17, ""), (18, " \n\t "), (19, "two words"), (20, "two words"), (21, "one"), (22, "é ü\x0bß\x1cx"), (None, base[5]), (None, None), (23, base[6]), (23, base[6]), (24, prose(rng, 30)), (24, prose(rng, 90)), (25, "word " * 400)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = ["a", "a", "a", "b", None, "c"]
    return spark.createDataFrame([(i, t, "en", sources[k % 6], len(t or ""), 7, "k", "n", "s", "c") for k, (i, t) in enumerate(texts)], SCHEMA).repartition(5)


def key(r):
    return tuple((x is None, str(x)) for x in r)


# shared parts


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {x: find(x) for e in links if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_crf_base_columns(docs, texts):
    chain = crf.Chain(np.vstack([[0.0, 1.0], np.zeros((len(crf.FEATURES) - 1, 2))]), np.zeros((2, 2)))
    got = sorted((tuple(r)[:7] for r in crf.line_labels(docs, chain).collect()), key=key)
    want = []
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want, key=key)


def test_crf_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    chain = crf.Chain(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    lines = np.array([5, 1, 7, 2])
    x = rng.normal(size=(lines.sum(), 3))
    got, at = chain.viterbi(x, lines), 0
    for n in lines:
        s = x[at : at + n] @ chain.emit
        best = max(range(2**n), key=lambda p: sum(s[k, p >> k & 1] for k in range(n)) + sum(chain.move[p >> k & 1, p >> k + 1 & 1] for k in range(n - 1)))
        assert got[at : at + n].tolist() == [best >> k & 1 for k in range(n)]
        at += n


def test_crf_learns_boilerplate(spark):
    rng = random.Random(5)
    clean = [(i, "\n".join(prose(rng, 15) for _ in range(6)), 1, 0) for i in range(40)]
    junk = [(100 + i, "\n".join(" ".join(w + "$$$" for w in prose(rng, 15).split()) for _ in range(6)), 0, 0) for i in range(40)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, quality int, toxic int")
    chain = crf.fit_on_labels(df.filter("doc_id % 2 = 0"), df.select("doc_id", "quality", "toxic"))
    out = {r.doc_id: r.kept for r in crf.line_labels(df, chain).collect()}
    assert all(out[i] == (i < 100) for i in out if i % 2)
    assert crf.fit_chain([], []).emit[0, 1] == 1 and crf.line_labels(df.limit(0), chain).count() == 0


def test_crf_marks_blocks_within_texts(spark):
    """Lines of junk inside clean texts, and clean lines inside junk, are told apart line by line."""
    rng = random.Random(15)
    junk = lambda: " ".join(w + rng.choice(["$$$", "%%", "###"]) for w in prose(rng, 12).split())
    clean = lambda: prose(rng, 15)
    rows = [(i, "\n".join((clean if i % 2 else junk)() for _ in range(rng.randint(4, 90))), i % 2, 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    chain = crf.fit_on_labels(df, df.select("doc_id", "quality", "toxic"))
    mixed, want = [], {}
    for i in range(60):
        marks = [1] * rng.randint(0, 9) + [0] * 4 + [1] * rng.randint(5, 9)
        mixed.append((i, "\n".join((clean if m else junk)() for m in marks)))
        want[i] = "".join(map(str, marks))
    got = {r.doc_id: (r.labels, r.kept) for r in crf.line_labels(spark.createDataFrame(mixed, "doc_id long, text string"), chain).collect()}
    assert sum(a == b for i in want for a, b in zip(got[i][0], want[i], strict=True)) >= 0.98 * sum(map(len, want.values()))
    assert all(got[i][1] for i in want if want[i].count("1") >= 10)


def test_long_texts_are_measured_in_bounded_memory():
    import tracemalloc

    text = "a few words and more\n" * 150_000  # 3 MB
    tracemalloc.start()
    got = crf.measure([text, None, ""])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.n_words.tolist() == [750_000, 0, 0] and got.lines.tolist() == [150_001, 1, 1] and got.n_dup_lines[0] == 149_999
    assert peak < 60 * len(text)


def test_labels_that_clash_and_ids_that_repeat(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, 1, 0), (3, 1, 0), (3, 1, 0), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.quality, r.toxic) for r in crf.labelled_sample(docs, labels, 10).collect()}
    assert got == {1: (0, 1), 3: (1, 0)} and crf.labelled_sample(docs, labels, 10).count() == 2


# 2 and 7


@pytest.fixture(scope="module")
def encoded(texts):
    tok = tokens.Encoder(tokens.tokenizer_path()).tok
    return [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts]


def test_encoder_is_exact():
    e = tokens.Encoder(tokens.tokenizer_path())
    parts = ["a", "Word", "don't", "'s", "«x»", "!«", "a.b", "...", "x\n", "\ny", "\n\n", "\r\n", "\t", " ", "  ", "日本", "д", "aд", "1", "½", "é", "***", "<|endoftext|>", "×", "\xa0", "_", "\x00"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(5000)] + [None, ""]
    assert [x.tolist() for x in e.encode(texts)] == [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_bits_round_trip(bits, tmp_path):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype("<u4") for n in (0, 1, 300, 7, 1000)]
    with open(tmp_path / "f", "wb") as f:
        w = bitpack.Writer(f, bits, block=128)
        for k, ids in enumerate(docs):
            w.add(None if k == 1 else k, ids)
        w.close()
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
        r = bitpack.Reader(f)
        every = np.concatenate(docs)
        assert r.lengths.tolist() == [0, 1, 300, 7, 1000] and r.nulls.tolist() == [False, True, False, False, False]
        for a, n in ((0, 1308), (127, 2), (128, 128), (1307, 1), (5, 0)):
            assert r.ids(a, n).tolist() == every[a : a + n].tolist()
    assert bitpack.min_bits(50257) == 16 and bitpack.min_bits(2) == 1


def test_packed_ids(spark, docs, encoded):
    got = sorted(map(tuple, bitpack.packed_digest(spark, docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in encoded), key=lambda i: (i is None, i or 0))
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in encoded)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert bitpack.packed_digest(spark, docs.limit(0)).count() == 0


def test_best_fit_plan_is_valid_and_tight():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 2049, 300), rng.integers(1, 50, 300), strict=True)}
    places, ranks = defaultdict(list), defaultdict(set)
    for length, rank, n, seq, offset in packing.plan_best_fit(counts):
        for i in range(n):
            places[seq + i].append((offset, length))
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
    assert {k: len(v) for k, v in ranks.items()} == counts
    for v in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) and min(v)[0] == 0 and sum(n for _, n in v) <= 2048
    # the same number of sequences as best-fit decreasing over single pieces
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - length)
        else:
            rooms.append(2048 - length)
    assert len(places) == len(rooms) and packing.plan_best_fit({}) == []


def test_packed_documents(docs, encoded):
    got = packing.packed_documents(docs, capacity=256).collect()
    want = Counter()
    for i, ids in encoded:
        end, start, piece = len(ids) % 256 or 256, 0, 0
        while start < len(ids):
            want[(i, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()))] += 1
            start, end, piece = end, end + 256, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 256
    assert len(seqs) <= 1.2 * math.ceil(sum(len(x) for _, x in encoded) / 256)
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_packed_sequences_hold_the_ids(docs, encoded):
    """Every document can be read back from the sequences, and no id is in them that isn't a document's."""
    packed = materialize(packing.packed_pieces(docs, capacity=256), "packed")
    seqs = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    got, pieces = defaultdict(list), packed.collect()
    for r in pieces:
        ids = seqs[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]
        assert ids == r.ids and r.offset in seqs[r.sequence_id].offsets
        got[r.doc_id].append((r.start, np.frombuffer(ids, "<u4").tolist()))
    once = {i for i, n in Counter(i for i, _ in encoded).items() if n == 1}
    for i, ids in encoded:
        if i in once:
            assert [x for _, part in sorted(got[i]) for x in part] == list(ids)
    assert all(len(r.ids) == 4 * r.length <= 4 * 256 and r.offsets[0] == 0 for r in seqs.values())
    assert sum(len(r.ids) for r in seqs.values()) == 4 * sum(len(ids) for _, ids in encoded) == 4 * sum(r.length for r in pieces)
    assert packing.sequences(packing.packed_pieces(docs.limit(0))).count() == 0


# 3


def brute_repeats(rows, least=50):
    words, first, out = defaultdict(list), {}, defaultdict(set)
    for i, t in rows:
        if i is not None and t:
            words[i].append(t.encode().split())
    for i in sorted(words):
        mine = set()
        for w in words[i]:
            for k in range(len(w) - least + 1):
                g = tuple(w[k : k + least])
                if g in first:
                    out[i].update(range(k, k + least))
                mine.add(g)
        for g in mine:
            first.setdefault(g, i)
    return out


def test_repeats(docs, texts):
    got = defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        assert r.other_doc_id < r.doc_id and r.n_words >= 50
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    assert got == brute_repeats(texts)
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0


def test_cut_repeats(docs, texts):
    out = suffixes.cut_repeats(docs)
    assert out.columns == docs.columns
    left = out.collect()
    assert not brute_repeats([(r.doc_id, r.text) for r in left])
    assert {r.doc_id for r in left} == {i for i, _ in texts} - {10, 11, 14, 15, 23}  # they have no word of their own
    by = {r.doc_id: r for r in left}
    old = dict(texts)
    assert by[13].text == old[13].split("\n")[1] and by[12].text == "changed "[:7] + by[12].text[7:] and by[12].n_chars == len(by[12].text)
    assert by[4].text == old[4] and by[17].text == "" and by[16].text is None


def test_texts_without_a_repeat_are_not_shuffled(spark):
    rng = random.Random(13)
    word = lambda: f"{rng.getrandbits(64):x}"
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(400)) + (f" {passage} {word()}" if i % 100 == 7 else "")) for i in range(500)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"), "t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {r.doc_id: r.text for r in suffixes.cut_repeats(docs).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: t.replace(f"{passage} ", "") if i > 7 else t for i, t in rows}
    assert moved < 0.6 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("parts", [1, 3, 23])
def test_repeats_across_borders(spark, parts):
    rng = random.Random(9)
    passage = prose(rng, 52)
    rows = [(i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.doc_id, r.n_words) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {i for i, _ in got} == set(range(1, 40)) and all(n >= 52 for _, n in got)


@pytest.mark.parametrize("parts", [5, 41])
def test_passages_far_apart_across_borders(spark, parts):
    """Documents that hold a passage three times are cut in all places, whatever the partitions."""
    rng = random.Random(22)
    passage = prose(rng, 56)
    rows = [(i, " ".join(f"{passage} {prose(rng, 70)}" for _ in range(3))) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = defaultdict(set)
        for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
            got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_repeats_in_frames(spark, parts):
    """Frames that go on differently, with the true copy far up."""
    rng = random.Random(21)
    frame, ends = prose(rng, 45), [prose(rng, 15) for _ in range(20)]
    rows = [(i, f"{prose(rng, 30)} {frame} {rng.choice(ends)} {prose(rng, 30)}") for i in range(150)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = defaultdict(set)
        for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
            assert r.other_doc_id < r.doc_id
            got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_repeats(rows)


# 4


def fill(sizes, weights, epochs=3.0):
    """Clamps and reshares until none is above."""
    total, done = float(sum(sizes)), {}
    while True:
        live = [i for i in range(len(sizes)) if i not in done]
        level = (total - sum(done.values())) / sum(weights[i] for i in live) if live else 0
        over = [i for i in live if weights[i] * level > epochs * sizes[i]]
        if not over:
            return [done.get(i, weights[i] * level) for i in range(len(sizes))]
        done |= {i: epochs * sizes[i] for i in over}


def test_mix(docs, texts):
    got = mixing.mix_plan(docs).collect()
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t in texts)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[n]) for n in names]
    targets = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    for n, size, target in zip(names, sizes, targets, strict=True):
        assert all(r.source_size == size and math.isclose(r.target, target, rel_tol=1e-12) for r in by[n])
        assert sum(r.taken for r in by[n]) == round(target)
    assert all(0 <= r.taken <= 3 * r.size for r in got) and math.isclose(sum(targets), sum(sizes))
    again = mixing.mix_plan(docs.repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix_plan(docs.filter("text is null or text = ''")).collect())


def test_mixed_rows(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
        assert r.n_chars == len(r.text or "")
    want = Counter()
    for r in mixing.mix_plan(docs).collect():
        want[r.source] += r.taken
    assert words == want


# 5


def test_archives(spark):
    long_one, other = "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n" * 80
    rows = [(1, "http://a/", long_one), (2, "http://b/ x\r\ny", long_one), (3, None, long_one), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (9, "u", other), (None, "u", other)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, record_type string, payload_digest string").repartition(3)
    got = warc.archived(spark, pages)
    import hashlib

    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((j for j, _, g in rows if g == h and j is not None), default=None)
        revisit = len(raw) >= 1000 and i is not None and i < top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert warc.archived(spark, pages.limit(0)).count() == 0


def test_record_ids_are_unique_and_dates_real(tmp_path, spark):
    from datetime import datetime, timezone

    rows = [(i, f"u{i}", "z" * 1500) for i in (1, 2, 3, 3, 3)] + [(None, None, "z" * 1500)] * 3 + [(None, None, None)] * 2 + [(4, "a b", "y"), (4, "a b", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write_archives(pages, str(tmp_path / "w"), date=datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)).collect()
    found = []
    for r in files:
        with open(tmp_path / "w" / r.file, "rb") as f:
            found += [fields for raw in warc.members(f) for fields, _ in warc.parse(raw)]
    ids = {x["WARC-Record-ID"]: x for x in found}
    assert len(ids) == len(found) == len(rows) and {x["WARC-Date"] for x in found} == {"2024-05-06T07:08:09Z"}
    revisits = [x for x in found if x["WARC-Type"] == "revisit"]
    assert sorted(x["X-Page-Id"] for x in revisits) == ["1", "2"]
    for x in revisits:
        to = ids[x["WARC-Refers-To"]]
        assert to["WARC-Type"] == "response" and to["X-Page-Id"] == "3" == x["X-Refers-To-Page-Id"] and x["WARC-Refers-To-Date"] == to["WARC-Date"]


def test_payloads_are_not_shuffled(spark):
    import re as r

    pages = spark.createDataFrame([(i, "u", "z" * 2000) for i in range(20)], "page_id long, url string, html string").repartition(3)
    from millrace.llm.common import fresh_path

    heads = warc.stored(pages, fresh_path(spark, "test"))
    assert "html" not in heads.columns and heads.agg({"size": "max"}).first()[0] < 200
    plan = warc.headers(heads)._jdf.queryExecution().toString()
    assert not r.search("html", plan)


def test_archive_members_are_records(tmp_path, spark):
    pages = spark.createDataFrame([(i, f"u{i}", "z" * (1000 + i % 2)) for i in range(10)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages, str(tmp_path / "w")).collect()
    found = []
    for r in files:
        with open(tmp_path / "w" / r.file, "rb") as f:
            for raw in warc.members(f):
                [(fields, block)] = list(warc.parse(raw))
                found.append((int(fields["X-Page-Id"]), fields["WARC-Type"]))
                assert fields["WARC-Type"] == "response" or fields["WARC-Refers-To"].startswith("<urn:uuid:")
    assert sorted(x for x, k in found if k == "response") == [8, 9] and len(found) == 10


# 6


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    clique = x[0] + rng.normal(size=(60, 16)) * 0.1
    x = np.concatenate([x, clique, x[:20] + rng.normal(size=(20, 16)) * 0.2, x[:5] * 3.0])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0, 2.0], 1), (905, [float("inf")] * 16, 1), (None, x[0].tolist(), 1)]
    got = {r.vec_id: r for r in neighbours.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == comp:
            break
        comp = new
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == comp
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, None))
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_links_between_saturated_groups(spark, monkeypatch):
    """Links of vectors whose lists are full of nearer ones, and of pairs that no bucket or list holds."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=64)
    one /= np.linalg.norm(one)
    side = rng.normal(size=64)
    side -= (side @ one) * one
    two = 0.95 * one + math.sqrt(1 - 0.95**2) * side / np.linalg.norm(side)
    x = np.concatenate([c + 0.15 / 8 * rng.normal(size=(40, 64)) for c in (one, two)] + [rng.normal(size=(600, 64))])
    x[100] = x[101] + 0.02 * rng.normal(size=64)
    true = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T >= 0.9
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(neighbours, "TABLES", 1)
    got = {r.vec_id: r for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert [got[i].n_links for i in range(len(x))] == (true.sum(axis=1) - 1).tolist()
    assert {got[i].component_id for i in range(80)} == {0} and got[101].component_id == 100


def brute_links(x):
    """Links of each vector, and the smallest place that links reach."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    n, pairs = np.zeros(len(x), int), []
    for a in range(0, len(x), 1000):
        i, j = np.nonzero(u[a : a + 1000] @ u.T >= 0.9)
        keep = i + a != j
        n += np.bincount(i[keep] + a, minlength=len(x))
        pairs += zip((i[keep] + a).tolist(), j[keep].tolist(), strict=True)
    parent = list(range(len(x)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return n, np.array([find(k) for k in range(len(x))])


def test_chains_and_cliques_of_many_vectors(spark):
    """20,000 vectors: cliques larger than lists, chains of many steps, pairs, and a third in one cone without links."""
    rng = np.random.default_rng(7)
    d = 48
    one = rng.normal(size=d)
    cone = 1.1 * one / np.linalg.norm(one) + rng.normal(size=(6500, d)) / math.sqrt(d)
    cliques = [c + 0.02 * rng.normal(size=(m, d)) for c, m in zip(rng.normal(size=(12, d)), rng.integers(5, 400, 12), strict=True)]
    chain = [rng.normal(size=d)]
    for _ in range(400):
        step = rng.normal(size=d)
        step -= (step @ chain[-1]) * chain[-1] / (chain[-1] @ chain[-1])
        chain.append(chain[-1] + 0.4 * np.linalg.norm(chain[-1]) * step / np.linalg.norm(step))
        chain[-1] /= np.linalg.norm(chain[-1])
    x = np.concatenate([cone, *cliques, np.array(chain)])
    x = np.concatenate([x, rng.normal(size=(20_000 - len(x) - 1000, d))])
    x = np.concatenate([x, x[-1000:] + 0.2 * rng.normal(size=(1000, d))])
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    n, component = brute_links(x)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(6)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(df).collect()}
    links = np.array([got[i][0] for i in range(len(x))])
    assert (links <= n).all()
    has = n > 0
    assert (links[has] / n[has]).mean() >= 0.98 and links.sum() >= 0.98 * n.sum()
    assert (np.array([got[i][1] for i in range(len(x))]) == component).mean() >= 0.99


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(50)] + [(100, [1.0, 2.0]), (101, [2.0, 4.0]), (102, [-1.0, 2.0]), (103, [5.0]), (104, [7.0]), (105, [-7.0]), (106, [])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(100, 107)] == [(1, 100), (1, 100), (0, 102), (1, 103), (1, 103), (0, 105), (0, 106)]


def test_audit_counts_what_was_found(spark):
    from millrace.llm.common import prepare

    prepare(spark)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(100, 8)), 3, axis=0) + 0.01 * rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    units = spark.createDataFrame([(i, v.tobytes(), 1) for i, v in enumerate(x)], "id long, unit binary, copies long")
    n, _ = brute_links(x)
    whole = spark.createDataFrame([(i, int(k)) for i, k in enumerate(n)], "id long, links long")
    assert neighbours.audit(units, whole, 0.9) == 1
    assert abs(neighbours.audit(units, whole.filter("id % 40 <> 0"), 0.9) - 7 / 15) < 0.01
    assert neighbours.audit(units.limit(0), whole, 0.9) == 1


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])]
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1)]


# 8


def test_licences(spark, docs):
    said = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    rows = [(1, "x y\nReleased under the MIT-License. mit LICENSE"), (2, said), (3, "Licensed under the Apache License, Version 2.0."), (4, "general public\nlicense général license"), (5, None), (6, ""), (7, "mit licenses the mit"), (8, "license " * 500)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, labels string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 5, 7, "mit", "MIT,mit")
    assert got[2].labels == "MIT" and got[2].base_labels == "" and got[2].score == 1
    assert got[3].labels == "Apache-2.0,apache" and got[4].base_labels == "gpl" and got[4].n_words == 5
    assert got[5].n_words == got[6].n_words == got[7].n_base == got[8].n_base == 0 and got[5].first_word is None and got[5].score == 0
    assert licenses.scan(docs.limit(0)).count() == 0


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licence_words(text):
    return LICENCE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    """n_words, n_base, first_word, last_word, base_labels by looking at each place."""
    w = licence_words(text)
    found = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_labels(text):
    """Labels of templates, by trying each place of each phrase."""
    w, out = licence_words(text), set()
    for label, phrases, body in licenses.TEXTS:
        template = licence_words(body)
        own, at = [], 0
        for phrase in map(licence_words, phrases):
            at = next(i for i in range(at, len(template)) if template[i : i + len(phrase)] == phrase)
            own.append((at, phrase))
            at += 1
        chains = [[i] for i in range(len(w)) if w[i : i + len(own[0][1])] == own[0][1]]
        for (p, _), (q, phrase) in zip(own, own[1:], strict=False):
            chains = [[*c, i] for c in chains for i in range(c[-1] + 1, len(w)) if w[i : i + len(phrase)] == phrase and abs(i - c[-1] - (q - p)) <= 8 + (q - p) // 4]
        for first in {c[0] for c in chains}:
            last = min(c[-1] for c in chains if c[0] == first)
            before, after = own[0][0], len(template) - own[-1][0]
            region = w[max(0, first - before - (8 + before // 4 if before else 0)) : last + after + 8 + after // 4]
            if longest_common(template, region) >= licenses.AGREE * len(template):
                out.add(label)
    return out


def test_licences_equal_brute_force(spark, docs, texts):
    """All base columns, and the labels, against every place of every text."""
    rng = random.Random(31)
    rows = [(i, t) for i, t in texts]
    said = [b for _, _, b in licenses.TEXTS]
    for i in range(120):
        w = rng.choice(said).split()
        for _ in range(rng.choice([0, 0, 1, 3, 8, 20])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = [rng.choice(["new", "the", "License,", "any"])] * rng.choice([0, 1, 3])
            w = w or ["x"]
        rows.append((1000 + i, f"{prose(rng, rng.randint(0, 30))} {' '.join(w)} {rng.choice(said)[: rng.randint(0, 200)]} mit\nLicense"))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = Counter((i, *brute_base(t), ",".join(sorted(brute_labels(t) | {x for x in brute_base(t)[4].split(",") if x}))) for i, t in rows)
    assert Counter(tuple(r)[:7] for r in got.collect()) == want


def test_licences_of_several_notices(spark):
    """Notices in one text are all found, whatever else it holds and however many they are."""
    said = [t for _, _, t in licenses.TEXTS]
    pairs = [(a, b) for a in range(len(said)) for b in range(len(said)) if a != b]
    rows = [(k, f"{said[a]} x y z {said[b]}") for k, (a, b) in enumerate(pairs)] + [(10_000, " x y z ".join(said))]
    got = {r.doc_id: {(m.label, m.first_word) for m in r.matches if m.share == 1} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = [len(licence_words(t)) for t in said]
    for k, (a, b) in enumerate(pairs):
        assert got[k] >= {(licenses.TEXTS[a][0], 0), (licenses.TEXTS[b][0], n[a] + 3)}
    assert got[10_000] >= {(licenses.TEXTS[k][0], sum(n[:k]) + 3 * k) for k in range(len(said))}


def test_licences_with_words_put_in(spark):
    """A word more, less or changed anywhere but in mandatory phrases loses no notice."""
    bsd = next(t for label, _, t in licenses.TEXTS if label == "BSD").split()
    rows = [(k, " ".join([*bsd[:k], "however", *bsd[k:]])) for k in (9, 11, 14, 17)] + [(100 + k, " ".join([*bsd[:k], *bsd[k + 1 :]])) for k in (10, 13, 16)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(x == "BSD" and s >= 0.9 for x, s in got.values()) and len(got) == len(rows)


# 9


def classes(rows, shingle, percent):
    sets, of = [], []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
        of.append(i)
    parent = {i: i for i in of if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if of[a] is not None and of[b] is not None and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(of[a]), find(of[b])
                    parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in zip(of, sets, strict=True)), key=key)


@pytest.mark.parametrize(("shingle", "threshold"), [(3, 0.85), (5, 0.8)])
def test_near_duplicates(docs, texts, shingle, threshold):
    got = sorted(map(tuple, minhash.near_duplicates(docs, shingle, threshold).collect()), key=key)
    assert got == classes(texts, shingle, round(100 * threshold))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_of_a_base_at_all_distances(spark):
    rng = random.Random(4)
    base = prose(rng, 150).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 7, 9])):
            w[rng.randrange(len(w))] = prose(rng, 1) + str(rng.randrange(4))
        rows.append((i + (500 if i % 3 else 0), " ".join(w)))
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()), key=key)
    assert got == classes(rows, 3, 85)


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_a_candidate_are_not_shuffled(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(400))) for i in range(500)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"), "t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = sorted(map(tuple, minhash.near_duplicates(docs, 3, 0.85).collect()), key=key)
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == classes(rows, 3, 85) and sum(not r[3] for r in got) == 5
    assert moved < 0.5 * sum(len(t) for _, t in rows)


def test_likely(spark):
    rows = spark.range(40_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    wanted = rows.filter("a % 10 = 3")
    got = {r.a for r in likely(rows, ["a", "b"], wanted, 4000).collect()}
    assert got >= {r.a for r in wanted.collect()} and len(got) < 4000 + 0.06 * 36_000
    assert likely(rows, ["a"], rows.limit(0), 0).count() == 0 == likely(rows.limit(0), ["a"], rows, 40_000).count()


def test_materialize_leaves_no_shuffle_files(spark):
    import glob
    import time

    files = lambda: set(glob.glob("/tmp/blockmgr-*/**/shuffle_*", recursive=True))
    before = files()
    materialize(spark.range(1000).withColumn("k", F.col("id") % 9).groupBy("k").count(), "t")
    for _ in range(50):  # executors are told and not waited for
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
    assert spark.conf.get(CLEAN_UP) == "false"


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    s = minhash.circulant_signatures([np.concatenate([common, a]), np.concatenate([common, b])], 512)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.07


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(40)] + [np.empty(0, np.uint64)]
    got = minhash._overlaps(sets[:25], sets[10:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[10:]] for x in sets[:25]]


# 10


def test_classifier_and_its_sites(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 7 == 0
        w = prose(rng, 60).split()
        if toxic:
            w[5] = w[30] = "nasty"
        rows.append((i, " ".join(x + "###" for x in w) if bad else " ".join(w), f"host{i % 4}" if i % 11 else None, "en"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(None, None, None, None), (1000, "", "new", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in bayes.classify(df, lab).collect()}
    assert len(got) == 402
    wrong = [i for i in range(400) if got[i].kept != (i % 5 != 0 and i % 7 != 0)]
    assert len(wrong) <= 4
    for i in range(0, 400, 2):
        assert 0 <= got[i].good_posterior <= 1 and 0 < got[i].good_path < 1
    assert bayes.classify(df, lab.limit(0)).filter("kept").count() == 402
    assert bayes.classify(df.limit(0), lab).count() == 0


def plain_posteriors(rows):
    """The same in loops over rows (doc_id, host, path, good)."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    p = [sig(r[3]) for r in rows]
    every = range(len(rows))

    def groups(key):
        out = defaultdict(list)
        for i in every:
            out[key(rows[i])].append(i)
        return out

    mean = lambda some: sum(p[i] for i in some) / len(some)
    hosts, paths = groups(lambda r: r[1]), groups(lambda r: r[1:3])
    n, top = len(rows), mean(list(every))
    strength = lambda within, between: min(max(within / between, 20), 1e6) if between > 0 else 1e6
    in_hosts = sum((p[i] - mean(h)) ** 2 for h in hosts.values() for i in h) / (n - len(hosts))
    in_paths = sum((p[i] - mean(h)) ** 2 for h in paths.values() for i in h) / (n - len(paths))
    between_hosts = (sum(len(h) * (mean(h) - top) ** 2 for h in hosts.values()) - (len(hosts) - 1) * in_hosts) / (n - sum(len(h) ** 2 for h in hosts.values()) / n)
    between_paths = (sum(len(g) * (mean(g) - mean(hosts[k[0]])) ** 2 for k, g in paths.items()) - (len(paths) - len(hosts)) * in_paths) / (n - sum(len(g) ** 2 / len(hosts[k[0]]) for k, g in paths.items()))
    k_host, k_path = strength(in_hosts, between_hosts), strength(in_paths, between_paths)
    out = []
    for i in every:
        h, g = hosts[rows[i][1]], paths[rows[i][1:3]]
        host = (sum(p[j] for j in h if j != i) + k_host * top) / (len(h) - 1 + k_host)
        path = (sum(p[j] for j in g if j != i) + k_path * host) / (len(g) - 1 + k_path)
        out.append((rows[i][0], host, path, sig(rows[i][3] - logit(top) + logit(path))))
    return sorted(out)


def test_posteriors_equal_a_plain_version(spark):
    rng = random.Random(12)
    rows = []
    for i in range(600):
        host = rng.choice(["a", "b", "b", "c", "d", None])
        path = rng.choice(["x", "y", None])
        rows.append((i, host, path, rng.gauss({"a": 2, "b": 0, "c": -2, "d": 1, None: 0}[host] + {"x": 1, "y": -1, None: 0}[path], 1), rng.gauss(-3, 1)))
    rows += [(1000, "lone", "z", 0.5, -3.0), (1001, "lone", "q", -0.5, -3.0)]
    got = sorted((r.doc_id, r.good_host, r.good_path, r.good_posterior) for r in bayes.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, good double, toxic double").repartition(5)).collect())
    np.testing.assert_allclose(got, plain_posteriors([r[:4] for r in rows]), rtol=1e-8)


def test_sparse_sites_shrink_to_the_level_above(spark):
    rows = [(i, "big", "p", 3.0 if i % 2 else -3.0, -5.0) for i in range(400)] + [(1000, "tiny", "q", -3.0, -5.0)] + [(2000 + i, "bad", "r", -3.0, -5.0) for i in range(400)]
    got = {(r.host, r.path): r for r in bayes.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, good double, toxic double")).collect()}
    glob = sum(1 / (1 + math.exp(-r[3])) for r in rows) / len(rows)
    assert abs(got[("tiny", "q")].good_path - glob) < 0.05 and got[("bad", "r")].good_path < 0.1 < got[("big", "p")].good_path


# the pipeline


def test_pipeline_stages(spark, tmp_path, texts):
    import corpus_pipeline as cp

    rng = random.Random(6)
    rows = [(100 + i, t) for i, (d, t) in enumerate(texts) if t and len(t.split()) > 50]
    rows += [(300 + i, prose(rng, 80) if i % 4 else " ".join(w + "$$$" for w in prose(rng, 80).split())) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(300 + i, int(bool(i % 4)), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(cp.STAGES)
    good = materialize(stages["quality_classifier"](spark, df, str(tmp_path)), "t")
    assert good.columns == df.columns
    ids = {r.doc_id for r in good.collect()}
    assert not ids & {300 + i for i in range(0, 120, 4)} and len(ids & {300 + i for i in range(120)}) == 90
    one = materialize(stages["minhash_near_dedup"](spark, good, str(tmp_path)), "t")
    kept = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in one.collect()} == {r[0] for r in classes(kept, 5, 80) if r[3]}
    cut = materialize(stages["suffix_array_dedup"](spark, one, str(tmp_path)), "t")
    assert cut.columns == df.columns and not brute_repeats([(r.doc_id, r.text) for r in cut.collect()])
    mixed = materialize(stages["source_mix"](spark, cut, str(tmp_path)), "t")
    assert mixed.columns == df.columns
    packed = stages["best_fit_packing"](spark, mixed, str(tmp_path))
    whole = cp.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def _write(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    _write(spark, tmp_path, [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name


def test_pipeline_on_odd_rows(spark, tmp_path, texts):
    """Nulls in any column, empty and long texts, repeated ids and rows: every stage has a row for what it keeps."""
    import corpus_pipeline as cp

    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else "s", None) for k, (i, t) in enumerate(texts)]
    _write(spark, tmp_path, rows, [(0, 1, 0), (0, 1, None), (1, 1, 0), (None, 0, 1), (2, None, 0)])
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clash = df.withColumns({c: F.lit("x") for c in ("_hash", "kept", "component_id", "_row", "spans", "host", "path", "piece", "_gone", "_least", "ids")})
    for docs in (df, clash):
        stages = dict(cp.STAGES)
        good = stages["quality_classifier"](spark, docs, str(tmp_path))
        assert good.columns == docs.columns and good.count() == len(rows)  # one kind of label only: nothing is told apart
        one = materialize(stages["minhash_near_dedup"](spark, good, str(tmp_path)), "t")
        assert one.columns == docs.columns
        ids = [r.doc_id for r in one.collect() if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and set(ids) == {r[0] for r in classes(texts, 5, 80) if r[3] and r[0] is not None}
        assert one.filter("doc_id is null").count() == 2
        again = materialize(stages["minhash_near_dedup"](spark, good.repartition(7), str(tmp_path)), "t")
        assert sorted(map(str, one.collect())) == sorted(map(str, again.collect()))
        cut = materialize(stages["suffix_array_dedup"](spark, one, str(tmp_path)), "t")
        assert cut.columns == docs.columns
        mixed = materialize(stages["source_mix"](spark, cut, str(tmp_path)), "t")
        assert mixed.columns == docs.columns and mixed.count() > 0
        packed = stages["best_fit_packing"](spark, mixed, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_run_leaves_only_what_it_returns(spark, tmp_path, texts):
    import corpus_pipeline as cp
    from millrace.llm import common

    _write(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in texts if t and len(t.split()) > 50], [(0, 1, 0)])
    mark = len(common.MADE)
    assert cp.run(spark, str(tmp_path)).count() > 0
    assert len(common.MADE) - mark <= 6


def test_long_texts(spark):
    """One text of some MB beside short ones, through every operator on texts."""
    rng = random.Random(2)
    words = prose(rng, 3000).split()
    long_text = " ".join(rng.choice(words) for _ in range(300_000)) + "\n" + "line and more words here\n" * 500 + "released under the MIT License"
    rows = [(0, long_text, "a", "en"), (1, long_text + " end", "a", "en"), (2, "short text", "a", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(2)
    chain = crf.fit_chain([], [])
    assert {r.doc_id: r.n_words for r in crf.line_labels(df, chain).collect()}[0] == len(long_text.split())
    assert [r.kept for r in sorted(minhash.near_duplicates(df).collect())] == [True, False, True]
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()}[0] == "MIT,mit"
    assert [(r.doc_id, r.first_word) for r in suffixes.repeated_passages(df).collect()] == [(1, 0)]
    assert bayes.classify(df, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")).filter("kept").count() == 3


def test_repeated_and_nameless_documents_are_dealt_out(spark):
    """Rows without an id, or with one that repeats, don't all come to one bucket."""
    df = spark.createDataFrame([(None if i % 2 else 7, f"w{i} " * (i % 5), "s") for i in range(400)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(df)
    assert df.select(mixing._place("mix-1")).distinct().count() > 300 and plan.count() == 400
    assert sum(r.taken for r in plan.collect()) == round(plan.first().target)


def test_package_reaches_workers_from_elsewhere(tmp_path):
    """A session started from another folder, with the package on sys.path only."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from millrace.llm import crf
df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
print("rows", crf.line_labels(df, crf.fit_chain([], [])).count(), crf.line_labels(df, crf.fit_chain([], [])).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=180)
    assert "rows 1 1" in out.stdout, out.stderr[-2000:]


def test_clashing_and_missing_parts(spark, docs):
    """Extra columns of any name don't disturb an operator."""
    clash = docs.withColumnsRenamed({"length": "_row", "key": "_id", "n": "print", "size": "spans", "component": "id"})
    assert mixing.mix(clash).columns == clash.columns and suffixes.cut_repeats(clash).columns == clash.columns
    assert minhash.near_duplicates(clash, 3, 0.85).count() == clash.count() == licenses.scan(clash).count()
