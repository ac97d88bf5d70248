"""Corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skymesh.llm import archive, decontaminate, langid, mixing, neardup, quality, queries, recompression, suffix, toxicity, urls

SF = "/root/testdata/sf0.001"
SPACED = r"[^\x20\x09-\x0D]+"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


ODD = [
    (0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (6, "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen y"), (7, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (8, "ä ö ü ß é " * 60), (9, "a " * 3000), (10, "a " * 40), (11, "\x00\x01 b\x0bc\x1d d e   f"), (12, "word" * 9000), (13, "lorem ipsum dolor " * 4000 + "end"), (14, "Line\nLine\n\nline\nLine"),
    (15, "ä ö ü ß é " * 60), (16, "..."), (17, "日本語 テキスト 漢字"), (18, "12 34 !!"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, a null id, and columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t or "")) for i, t in ODD]
    df = spark.createDataFrame(rows + [(None, "no id here at all", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"spans": F.lit(1), "cand": F.lit("x"), "label": F.lit(2.0), "node": F.lit(3), "score": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(docs, odd):
    return docs.select("doc_id", "text").unionByName(odd.filter("doc_id is not null").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_counts(docs, odd):
    own = both(docs, odd).withColumn("lang", F.lit("en"))
    got = by_id(quality.quality(own))
    for r in own.collect():
        text = r.text or ""
        w = re.findall(SPACED, text)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(SPACED, line):
                dup += line in seen
                seen.add(line)
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, r.doc_id
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert g.base_failed == failed and not (failed and g.kept)


def word_hash(word):
    b = word.encode()
    return int(quality._lower(np.frombuffer(b, np.uint8), np.array([0, len(b)])).hash[0])


def test_common_words_are_counted_over_all_rows(spark, docs):
    """Also words under 0.2 % of each slice, and a word that is frequent in one source only."""
    rare = [f"r{i}" for i in range(62)]
    rows = [("q", " ".join(["the"] * 940 + rare[k % 2 :: 2] + ["hot"] * 2 * (k < 8))) for k in range(40)]
    own = docs.select("lang", "text").unionByName(spark.createDataFrame(rows, "lang string, text string"))
    count = defaultdict(Counter)
    for r in own.collect():
        if r.lang is not None:
            count[r.lang].update(re.findall(SPACED, lower(r.text)))
    want = set()
    for c in count.values():
        ranked = sorted(c, key=lambda w: (-c[w], w.encode()))
        want |= {word_hash(w) for w in ranked[:64]}
    for parts in (1, 4, 211):
        common, _ = quality.references(own.select("text", "lang").repartition(parts))
        assert set(common.tolist()) == want


@pytest.mark.parametrize("held", [1 << 18, 3])
def test_word_totals_lose_nothing(monkeypatch, held):
    import pyarrow as pa

    monkeypatch.setattr(quality, "HELD", held)
    rows = [("a b a", "x"), ("a c", "y"), ("d e f g A", "x"), (None, "x"), ("a", None), ("b b", "y")]
    want = Counter((lang, w) for t, lang in rows if lang for w in re.findall(SPACED, lower(t)))
    got = Counter()
    for b in quality._word_totals(pa.RecordBatch.from_pylist([{"text": t, "lang": x}], pa.schema({"text": pa.string(), "lang": pa.string()})) for t, x in rows):
        for x, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[x, w] += n
    assert got == want


def thue_morse(rounds=10):
    word = "a"
    for _ in range(rounds):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_confuses(spark):
    """Different words of 1024 letters, whose polynomial hashes modulo 2^64 agree, stay different."""
    from skymesh.llm.kernel import NOT_SPACE, Words

    a, b = thue_morse()
    for x, y in ((a, b), (a[:500], b[:500])):
        data = np.frombuffer(f"{x} {y}".encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]), NOT_SPACE, lower=False)
        assert len(set(w.hash.tolist())) == 2
    rows = [(1, " ".join([a, *"cdefghijklmn"])), (2, " ".join([b, *"cdefghijklmn"])), (3, " ".join([*a])), (4, " ".join([*b]))]
    rows += [(5, a + "\n" + b + "\n" + a), (6, (a + " x ") * 5)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(recompression.remove_repeats(own))
    seen, want = set(), {}
    for k, t in rows:
        w = re.findall(SPACED, t)
        at = [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
        want[k] = len({j for i, x in enumerate(at) if x in seen for j in range(i, i + 13)})
        seen |= set(at)
    assert {k: r.n_removed for k, r in got.items()} == want
    assert by_id(quality.quality(own.withColumn("lang", F.lit("x"))))[5].n_dup_lines == 1


def test_js_distance():
    p, q = np.array([[4, 4, 0], [0, 0, 2], [0, 0, 0]]), np.array([1.0, 1.0, 0.0])
    assert np.allclose(quality.js_distance(p, q), [0, 1, 0])


@pytest.mark.parametrize("block_bytes", [1 << 22, 1500])
def test_contamination(spark, docs, odd, block_bytes):
    own = both(docs, odd)
    tests = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "One two"), (901, None), (902, ".."), (None, "the"), (903, "one two three"), (904, "seven eight nine"), (905, "seven eight nine")], "item_id long, text string"))
    words = lambda s: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(s))
    windows = defaultdict(set)
    for r in tests.collect():
        w = words(r.text)
        if w and r.item_id is not None:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(r.item_id))
    items_of = [(str(r.item_id), words(r.text)) for r in tests.collect() if r.item_id is not None and words(r.text)]
    got = by_id(decontaminate.contamination(own, tests, block_bytes=block_bytes))
    for r in own.collect():
        w, hit, items = words(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)), r.doc_id
        best = None
        for x, own_words in items_of:
            n = min(13, len(own_words))
            for i in range(len(w)):
                for j in range(len(own_words)) if w[i] in own_words else ():
                    m = 0
                    while i + m < len(w) and j + m < len(own_words) and w[i + m] == own_words[j + m]:
                        m += 1
                    if m >= n and (i == 0 or j == 0 or w[i - 1] != own_words[j - 1]) and (best is None or (-m, i, x) < best):
                        best = (-m, i, x)
        assert (g.longest_words, g.longest_start, g.longest_item) == ((-best[0], best[1], best[2]) if best else (None, None, None)), r.doc_id


def common_edges(spark):
    """A passage that most rows share, between words of their own; some rows have a few of these in common."""
    rng = np.random.default_rng(11)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage, after = some(30), [some(4) for _ in range(5)]
    rows = [(k, f"{some(20)} {passage} {after[k % 5] if k % 3 else ''} {some(20)}" if k % 4 else some(60)) for k in range(160)]
    # one word or two again and again, alone and inside other texts
    rows += [(200 + k, f"{some(k % 3)} {('la ' if k % 2 else 'do re ') * (5 + 7 * k)} {some(k % 4)}") for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")


def test_repeats_at_common_edges(spark):
    own = common_edges(spark)
    kinds = [r.kind for r in own.mapInArrow(lambda b: recompression._segments(b, 13), "anchor long, name long, check long, doc_id long, at long, kind tinyint").collect()]
    assert 3 in kinds and 2 in kinds  # marks, and segments dealt by name
    import pyarrow as pa

    one = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": ["la " * 500]})
    assert sum(b.num_rows for b in recompression._segments(iter([one]), 13)) == 1  # touching, so one segment
    check_words(own)
    check_bytes(own, 4096)
    check_bytes(own, 1)


def test_recompression(docs, odd):
    check_words(both(docs, odd))


def check_words(own):
    texts = {r.doc_id: re.findall(SPACED, r.text or "") for r in own.collect()}
    first = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - 12):
            first.setdefault(tuple(texts[k][i : i + 13]), k)
    got = by_id(recompression.remove_repeats(own, text=True))
    for k, w in texts.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256, got[k].kept_text) == (len(w), len(gone), sha(kept.encode()), kept), k


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n, k in itertools.product((1, 2, 3, 7, 60, 300), (1, 2, 4, 100)):
        text = [*rng.integers(1, k + 1, n).tolist(), 0]
        sa = suffix.suffix_array(np.array(text)).tolist()
        assert sa == sorted(range(n + 1), key=lambda i: text[i:])
        data = np.array(text[:-1], np.uint8)
        lcp = suffix.common_prefixes(data, np.array(sa[1:]), 16)
        for a, b in zip(sa[1:], sa[2:]):
            same = next((i for i, (x, y) in enumerate(zip(text[a:-1], text[b:-1])) if x != y), min(n - a, n - b))
            assert min(lcp[b], 16) == min(same, 16)


@pytest.mark.parametrize("most", [4096, 1])
def test_suffix_dedup(docs, odd, most):
    check_bytes(both(docs, odd), most)


def check_bytes(own, most):
    texts = {r.doc_id: (r.text or "").encode() for r in own.collect()}
    got = by_id(suffix.remove_repeats(own, most=most))
    seen = set()
    for k in sorted(texts):
        b = texts[k]
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            if (s := b[i : i + 100]) in seen:
                edge[i] += 1
                edge[i + 100] -= 1
            seen.add(s)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) and gone[0])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), int(gone.sum()), spans, sha(kept)), k


def test_runs_longer_than_a_span_are_cut_not_lost(monkeypatch):
    """A document that repeats itself over more windows than one span can name."""
    import pyarrow as pa

    from skymesh.llm import repeats

    monkeypatch.setattr(repeats, "MASK", 1023)
    doc, start, n = repeats.joined(np.array([1, 1, 0, 1]), np.array([5, 1000, 3, 9000]), np.array([1000, 3000, 2, 1]))
    assert list(zip(doc.tolist(), start.tolist(), n.tolist())) == [(0, 3, 2), (1, 5, 1023), (1, 1028, 1023), (1, 2051, 1023), (1, 3074, 926), (1, 9000, 1)]
    text = bytes(np.random.default_rng(3).integers(97, 123, 500, dtype=np.uint8)).decode() * 20
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([7], pa.int64()), "text": [text]})
    at = [x for b in suffix._segments(iter([batch]), size=100) for x, w in zip(b.column("at").to_pylist(), b.column("kind").to_pylist()) if w == repeats.WHOLE]
    own = batch.append_column("spans", pa.array([at], pa.list_(pa.int64())))
    (got,) = next(suffix._remove(iter([own]), 100, False, False)).to_pylist()
    assert got["n_spans"] == 1 and got["n_removed"] > len(text) - 1200


def groups(texts, size, similar):
    sets = {}
    for k, t in texts.items():
        w = re.findall(SPACED, lower(t))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    common, where = Counter(), defaultdict(list)
    for k, s in sets.items():
        for x in s:
            for other in where[x]:
                common[other, k] += 1
            where[x].append(k)
    least = {k: k for k in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= similar * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            least[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


@pytest.mark.parametrize(("size", "similar", "stars"), [(3, 85, 2), (5, 80, 1), (3, 85, 0)])
def test_near_duplicates(spark, docs, odd, size, similar, stars):
    """Also a chain: neighbours are linked, the ends are not."""
    base = [f"w{i}" for i in range(120)]
    chain = [(2_000_000 + k, " ".join([f"c{k}x{i}" if i < 2 * k else w for i, w in enumerate(base)])) for k in range(12)]
    own = both(docs, odd).unionByName(spark.createDataFrame(chain, "doc_id long, text string"))
    want = groups({r.doc_id: r.text for r in own.collect()}, size, similar)
    got = {k: (r.n_shingles, r.component_id, r.kept) for k, r in by_id(neardup.near_duplicates(own, size=size, similar=similar, stars=stars)).items()}
    assert got == want


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    true = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in true) >= 0.5 * len(true)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.03 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_nearest_examples_are_exact():
    """Block-max search finds what the full product finds."""
    rng = np.random.default_rng(1)
    n, m = 300, 40
    dense = rng.random((n, m)) * (rng.random((n, m)) < 0.1)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    example, term = np.nonzero(dense)
    order = np.lexsort((example, term))
    blocks = n // toxicity.BLOCK + 1
    cut = np.searchsorted((term * blocks + example // toxicity.BLOCK)[order], np.arange(m)[:, None] * blocks + np.arange(blocks + 1))
    top = np.zeros((m, blocks))
    np.maximum.at(top, (term, example // toxicity.BLOCK), dense[example, term])
    model = toxicity.Model(np.arange(m), np.ones(m), np.arange(n), np.zeros(n), cut, example[order], dense[example, term][order], top, np.zeros(4), 0.0, 15)
    for _ in range(30):
        at = np.sort(rng.choice(m, 6, replace=False))
        w = rng.random(6)
        near, cosine = model.nearest(at, w)
        full = dense[:, at] @ w
        want = np.lexsort((np.arange(n), -full))[:15]
        assert np.allclose(cosine, full[want][full[want] > 0]) and np.allclose(full[near], cosine)


def test_marginals_are_exact(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 3)
    rng = np.random.default_rng(0)
    score, t, count = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), np.array([7, 0, 2])
    got, _ = langid.marginals(score, count, t)
    want = []
    for lo, n in ((0, 7), (7, 2)):
        total, m = 0, np.zeros((n, 2))
        for y in itertools.product(range(2), repeat=n):
            w = sum(np.exp(sum(score[lo + i, y[i]] for i in range(n)) + t[s, y[0]] + sum(t[y[i], y[i + 1]] for i in range(n - 1))) for s in range(2))
            total += w
            for i in range(n):
                m[i, y[i]] += w
        want.append(m / total)
    assert np.allclose(got, np.concatenate(want))


def test_languages(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = langid.learn(docs, per_language=60)
    got = langid.languages(docs, field).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    und = {i for i, t in ODD if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in langid.languages(odd, field).collect() if r.lang_pred == "und"} == und
    assert all(r.lang_pred == "und" for r in langid.languages(odd, None).collect())


def test_switches_inside_a_text(spark):
    """Words of held-out texts, twenty of each language in turn."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = langid.learn(docs, per_language=60)
    held = docs.filter("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").orderBy("doc_id").collect()
    plain = defaultdict(list)
    for r in held:
        plain[r.lang] += re.findall(r"[a-z\x80-\U0010ffff]+", lower(r.text))
    langs = sorted(plain)
    want = [lang for k in range(60) for lang in [langs[k % len(langs)]] * 20]
    text = " ".join(w for k in range(60) for w in plain[langs[k % len(langs)]][k // len(langs) * 20 :][:20])
    (r,) = langid.languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).collect()
    got = [s.lang for s in r.spans for _ in range(s.words)]
    assert [s.first for s in r.spans] == list(itertools.accumulate((s.words for s in r.spans), initial=0))[:-1] and len(got) == len(want)
    assert sum(a == b for a, b in zip(got, want)) >= 0.9 * len(want), sum(a == b for a, b in zip(got, want)) / len(want)


def test_arc_to_warc(spark):
    big, other = "x" * 1500 + "\r\n\r\n", "é" * 700
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "http://q", None), (4, "u", ""), (5, "v", other), (6, "w", other), (7, "y", "small"), (8, "z", "small"), (9, "http://n\nl", "WARC/1.1\r\n\r\n" * 100), (None, "nil", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("value", F.lit("x"))
    got = archive.converted(pages).collect()
    assert len(got) == len(rows)
    at = {r.page_id: r for r in got}
    for i, _, html in rows:
        b = (html or "").encode()
        assert (at[i].payload_bytes, at[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
    assert {i: at[i].refers_to for i in at if at[i].record_type == "revisit"} == {None: 2, 1: 2, 5: 6}
    assert at[1].target_uri == "http://a/b%20c" and at[2].target_uri is None
    assert {i: at[i].refers_to_record for i in at if at[i].refers_to} == {None: at[2].record_id, 1: at[2].record_id, 5: at[6].record_id}


def test_archives_are_cut_by_bytes_and_read_from_any_record(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "z" * (3000 if i else 50_000)) for i in range(12)]
    archive.write_arcs(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/arc", 1, size=10_000)
    files = [p for p in (tmp_path / "arc").iterdir() if p.name.startswith("part-")]
    assert len(files) >= 4
    for p in files:
        data = p.read_bytes()
        starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", data)]
        members = [zlib.decompressobj(31).decompress(data[i:]) for i in starts]
        assert sum(map(len, members)) < 62_000 and members[0].startswith(b"filedesc:") and members[1].startswith(b"http://x/")
    archive.to_warc(spark, [f"{tmp_path}/arc"], f"{tmp_path}/warc", size=10_000)
    got = {r.page_id: r for r in archive.read_warcs(spark, f"{tmp_path}/warc").collect()}
    assert len(got) == 12 and {r.record_type for i, r in got.items() if i in (0, 11)} == {"response"} and all(r.refers_to == 11 for i, r in got.items() if 0 < i < 11)


def test_arcs_of_other_writers():
    """Other closing lines, line ends and heads, no HTTP at all, bytes that are no UTF-8, an address with spaces."""
    body = b"1 0 Other Archive\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://o.arc 0.0.0.0 19980101000000 text/plain %d\n" % len(body) + body + b"\n"
    one = b"HTTP/1.0 200 OK\nServer: x\n\nhello\n\nworld"
    two = b"only text, no head\r\n\r\nreally"
    data += b"http://a/b c\xe9 1.2.3.4 19980102030405 text/html %d\n" % len(one) + one + b"\n\n"
    data += b"dns:a.b 1.2.3.4 19980102030406 text/dns %d\r\n" % len(two) + two + b"\n"
    got = list(archive.read_arc(data))
    assert got == [("http://a/b c%E9", "1.2.3.4", "19980102030405", "text/html", one[: one.index(b"hello")], b"hello\n\nworld"), ("dns:a.b", "1.2.3.4", "19980102030406", "text/dns", b"", two)]


def test_arc_versions_round_trip():
    for version in (1, 2):
        data = archive.arc_version_block(version) + b"\n" + archive.arc_record(version, 7, "http://x/", b"a\n\nb") + b"\n" + archive.arc_record(version, 8, None, b"") + b"\n"
        got = list(archive.read_arc(data))
        assert [(g[0], g[5]) for g in got] == [("http://x/", b"a\n\nb"), ("-", b"")]


def test_url_rules_and_model(spark):
    cases = {
        "https://EXAMPLE.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://a.b.example.org/en/17?x": ("a.b.example.org", "/en/17", "example.org/en/1", "block"),
        "http://example.org": ("example.org", "", None, None),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://com/fr/#x": ("com", "/fr/", "com/fr/", "allow"),
        "ftp://x.com/de/?q": ("x.com", "/de/", "com/de/", "block"),
        "no scheme/com/de/": ("", "", None, None),
        "http://u:p@H.net:80?a/b": ("u:p@h.net:80", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.filtered(pages).collect()}
    for i, want in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == want[:3] and r.verdict == (want[3] or r.verdict) and r.verdict in ("allow", "block")


def test_url_model_learns(spark):
    rows = [(i, f"http://h{i % 7}.{'com' if i % 2 else 'org'}/{'de' if i % 2 else 'x'}/{i}") for i in range(200)] + [(1000, "http://q.com/en/5"), (1001, None), (1002, "http://q.com/" + "xä" * 50_000), (1000, "http://q.com/en/5")]
    got = urls.filtered(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and all((r.p_block is None) == (r.rule is not None) for r in got)


def test_url_rules_over_a_whole_table(spark):
    """Host, path and rule of every page by plain string work; and the model against hosts that it never saw."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in urls.filtered(pages).collect()}
    for r in pages.select("page_id", "url").collect():
        rest = r.url.split("://", 1)[1] if "://" in (r.url or "") else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = lower(host)
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, max(fits)[2] if fits else None)
        assert g.verdict == (max(fits)[3] if fits else "block" if g.p_block >= 0.5 else "allow")
    (r,) = urls.accuracy(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()
    assert r.urls > 50 and r.accuracy > r.commoner + 0.1, r


def test_entropy_is_of_all_characters(spark):
    import math

    rows = ["http://abc/日本日本", "", "aaaa", "http://x.y/%7E?q=1&r=éé"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r.entropy for r in urls.lexical(urls.judged(df)).collect()}
    for i, u in enumerate(rows):
        c = Counter(u.lower())
        assert abs(got[i] + sum(n / len(u) * math.log2(n / len(u)) for n in c.values())) < 1e-9


def test_mixing(spark, odd):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, F.concat(F.lit("b"), (F.col("id") % 5).cast("string"))).otherwise(None).alias("source"), F.lit("s").alias("slot"))
    got = mixing.mixed(docs, block=8, period=200, bin_rows=100).toPandas()
    assert set(got.doc_id) == set(range(3000))  # none is left out
    got["source"] = got.source.fillna("<null>")
    per = got.groupby("slot").agg(s=("source", "nunique"), b=("block_no", "nunique"))
    assert (per == 1).all().all() and list(per.index) == list(range(len(per)))
    order = got.drop_duplicates("slot").sort_values("slot").source.to_numpy()
    count = {(r.source or "<null>"): r["count"] for r in docs.groupBy("source").count().collect()}
    share = mixing.shares({k: n**0.7 for k, n in count.items()}, 200)
    for k, n in share.items():
        had = np.cumsum(order == k)
        assert np.abs(had - (np.arange(len(had)) + 1) * n / 200).max() < 1
    assert mixing.mixed(docs.limit(0)).isEmpty()
    assert mixing.mixed(odd).select("doc_id").distinct().count() == odd.count()


@pytest.mark.parametrize("weights", [[0.618034, 0.2, 0.17, 1e-5], [1e6, *range(1, 1500)]])
def test_schedule_keeps_exact_weights(weights):
    """At every slot each source is less than one block from its weight, also over a long mix."""
    w = list(mixing.whole(dict(enumerate(weights))).values())
    order = np.array(list(mixing.schedule(w, 60_000)))
    for i in range(min(len(w), 40)):
        had = np.cumsum(order[:, 0] == i)
        assert np.abs(had - (np.arange(len(had)) + 1) * (w[i] / sum(w))).max() < 1 + 1e-6
        assert (order[order[:, 0] == i, 1] == np.arange(had[-1])).all()


def test_mixing_of_more_than_a_thousand_sources(spark):
    """A hot source with a third of the rows gets its weight, and nobody is left out."""
    docs = spark.range(4500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 1500).cast("string"))).alias("source"))
    got = mixing.mixed(docs, block=2).toPandas()
    assert set(got.doc_id) == set(range(4500)) and not got.duplicated(["slot", "place"]).any()
    order = got.drop_duplicates("slot").sort_values("slot").source.to_numpy()
    share = 1500**0.7 / (1500**0.7 + 1500 * 2**0.7)
    assert len(order) == got.slot.max() + 1 == np.ceil(750 / share)
    had = np.cumsum(order == "hot")
    assert np.abs(had - (np.arange(len(had)) + 1) * share).max() < 1
    with pytest.raises(ValueError):
        mixing.mixed(docs, period=1000)


def test_mixing_of_many_epochs(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b")], "doc_id long, source string")
    got = mixing.mixed(docs, weights={"a": 1, "b": 1}, block=2, slots=600).toPandas()
    assert sorted(got.slot.unique()) == list(range(600)) and got[got.source == "b"].epoch.tolist() and set(got[got.source == "b"].epoch) == set(range(300))
    assert (got[got.source == "a"].groupby("epoch").doc_id.nunique() == 3).all()


def test_empty_and_odd_tables(spark, odd):
    empty, none = odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for table, n in ((empty, 0), (odd, odd.count())):
        for df in (
            quality.quality(table),
            decontaminate.contamination(table, bench),
            recompression.remove_repeats(table),
            suffix.remove_repeats(table),
            neardup.near_duplicates(table),
            toxicity.score(table, toxicity.learn(table, none)),
            langid.languages(table, langid.learn(table)),
        ):
            assert len(df.collect()) == n
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.converted(pages).isEmpty() and urls.filtered(pages).isEmpty()


def test_pipeline_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.count() <= own.count() and out.select("doc_id").subtract(own.select("doc_id")).isEmpty()
        own = out
    final = corpus_pipeline.STAGES[-1][1](spark, own, SF)
    assert final.select("doc_id").distinct().count() == own.count()
    assert own.count() > 0.6 * docs.count()


def test_pipeline_of_odd_rows(spark, odd):
    """Nulls, repeated rows and ids, very long texts, names that the operators use themselves, an empty table."""
    extra = {"n_bytes": F.lit(1), "n_removed": F.lit("r"), "kept_text": F.lit("k"), "carried": F.lit(None).cast("string"), "band": F.lit(1), "hub": F.lit(2), "text_key": F.lit(4), "a.b": F.lit(5), "held_out": F.lit(True)}
    odd = odd.unionByName(odd.filter("doc_id = 13")).unionByName(odd.filter("doc_id = 5").withColumn("text", F.lit("another text of the same id")))
    for own in (odd.withColumns(extra), odd.withColumns(extra).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, own, SF)
            assert out.schema.simpleString() == own.schema.simpleString(), name
            own = spark.createDataFrame(out.collect(), own.schema)
        final = corpus_pipeline.STAGES[-1][1](spark, own, SF)
        assert final.select("doc_id").distinct().count() == own.select("doc_id").distinct().count()


def test_rows_of_one_id_are_spread_over_bins(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("text"))
    got = mixing.mixed(docs, block=4, bin_rows=100)
    assert got.select("text").distinct().count() == got.count() == 4000


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES if k.startswith("op")) == list(range(1, 14))


def test_segments_are_judged_alike_however_the_rows_are_cut():
    import random

    import pyarrow as pa

    from skymesh.llm import repeats

    rng = random.Random(5)
    for _ in range(500):
        same_doc = rng.random() < 0.5
        kind = lambda: rng.choices([repeats.PLAIN, repeats.WHOLE, repeats.NAMED], [8, 1, 1])[0]
        rows = [(rng.randrange(4), -kind(), *(rng.randrange(k) for k in (3, 4, 3))) for _ in range(rng.randrange(1, 30))]
        # a mark has no name; rows are in order of anchor, kind (the last first), name and place
        rows = sorted(rows + [(rng.randrange(4), -repeats.MARK, -1, 0, 0) for _ in range(rng.randrange(3))])
        names, want = defaultdict(set), set()
        for a, k, m, _, _ in rows:
            if -k != repeats.WHOLE:
                names[a] |= {m} if -k == repeats.PLAIN else {m, "another"}
        newest = lead = None  # a name's first row, of those that follow each other
        for a, k, m, d, p in rows:
            if -k == repeats.WHOLE:
                want.add((a, d, p, True))
            elif -k != repeats.MARK:
                if newest != (a, m):
                    newest, lead = (a, m), (d, p)
                if (d, p) > lead if same_doc else d > lead[0]:
                    want.add((a, d, p, True))
                elif len(names[a]) > 1:
                    want.add((a, d, p, False))
        batches, i = [], 0
        while i < len(rows):
            k = i + rng.randrange(1, 6)
            part = [[r[0] for r in rows[i:k]], [r[2] // 2 for r in rows[i:k]], [r[2] % 2 for r in rows[i:k]], [r[3] for r in rows[i:k]], [r[4] for r in rows[i:k]]]
            batches.append(pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in part), pa.array([-r[1] for r in rows[i:k]], pa.int8())], repeats.columns(repeats.SEGMENT)))
            i = k
        got = {row for b in repeats._judge(iter(batches), same_doc) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        assert got == want
