"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymesh.llm import queries, variants

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(known):
    sized = {}
    for w in known:
        sized.setdefault(len(w), []).append(w)
    return {(a, b) for n, own in sized.items() for a in own for b in [*own, *sized.get(n + 1, [])] if one_apart(a, b) and (len(b) > n or a < b)}


def plain_variants(rows):
    known = plain_words(rows)
    near = {w: [] for w in known}
    for a, b in plain_near(known):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-known[v], v.encode()), default=None)
        form[w] = best if best and known[best] >= 10 * known[w] else None
    out = {}
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, known[w], len(near[w]), known[form[w]] if form[w] else None)
    return out


def shape(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_by_all_pairs(spark):
    got = queries.QUERIES["op11_gram_variants"](spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got.count() == len(shape(got)) and shape(got) == plain_variants(rows)


def variant(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abñ")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w])


@pytest.mark.parametrize("entries,few,at_most", [(1 << 18, 32, 256), (50, 1, 2), (1, 10**9, 1), (1 << 18, 0, 3)])
def test_no_near_pair_is_lost(spark, entries, few, at_most):
    rng = random.Random(entries + few)
    base = ["".join(rng.choices(rng.choice(["ab", "tionment", "abcdefghijklmnopqrstuvwxyzéü"]), k=rng.choice([7, 7, 8, 9, 10, 15, 31]))) for _ in range(150)]
    base += ["internat" + "".join(rng.choices("abc", k=4)) for _ in range(80)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaaaab", "aaabaaa"]
    own = {variant(rng, variant(rng, w)) for w in base for _ in range(6)} | set(base)
    own = {w for w in own if len(w) >= 7}
    df = spark.createDataFrame([(w, i + 2) for i, w in enumerate(sorted(own))], "word string, n long").repartition(3)
    got = variants.near_words(df, entries=entries, few=few, at_most=at_most).collect()
    pairs = [tuple(sorted((r.a_word, r.b_word), key=lambda w: (len(w), w))) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_near(own)


def test_odd_tables(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefg", k=20_000))
    rows = [(1, None), (2, ""), (None, "nobody nobodyy somebody"), (3, long), (4, long), (5, long[:-1] + " " + long[:-1]), (6, "short Ñandúes ÑANDÚES ñandúes x×xxxxx×x x÷xxxxxxxx")]
    rows += [(10 + i, "straight streight staight straightt " + "straight " * 30 + "strasght " * (i % 3)) for i in range(60)] + [(6, "straight")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "list": F.lit(0)}).repartition(4)
    got = shape(variants.variants(df))
    assert got == plain_variants(rows) and got["streight"][:2] == ("straight", "straight")
    assert variants.variants(df.limit(0)).count() == 0


def test_roots_follow_forms_to_the_last(spark):
    names = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji", "abcdlkji"]
    text = " ".join(" ".join([w] * 11**i * 2) for i, w in enumerate(names))
    rows = [(next(i for i in range(10**6) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in names)), text)]
    got = shape(variants.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_variants(rows) and got[names[0]][1] == names[-1]


def test_an_edit_affects_no_more_grams_than_the_bound():
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 101, (200, 9)).astype(np.uint64)
    gram = np.concatenate([x.ravel() for q, x in variants.grams(codes, 4) if q > 1])
    known, n = np.unique(gram, return_counts=True)
    frequent = known[n > 20], n[n > 20], 20
    own, size, _ = variants.decomposed(codes, 4, frequent)
    changed = codes.copy()
    at = rng.integers(0, 9, 200)
    changed[np.arange(200), at] = 120
    after, _, _ = variants.decomposed(changed, 4, frequent)
    assert (((own != after) & (size > 0)).sum(1) <= variants.bound(size)).all() and ((size > 0).sum(1) > variants.bound(size)).all()
