"""Language and quality models: held-out accuracy and odd rows."""

import math
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_documents import LONG, TEXTS, empty, odd, plain
from pyspark.sql import functions as F

from tidebars.llm.documents import read_table
from tidebars.llm.language import fit_language, grams, identify_language, word_counts
from tidebars.llm.quality import MARKS, fit_quality, keep_quality, score_quality, term_frequencies

SF = "/root/testdata/sf0.01"


def test_words_are_runs_of_letters():
    assert word_counts("It's ÉTÉ, x²y 12 _ été") == {"it": 1, "s": 1, "été": 2, "xy": 1}
    assert grams("ab", 3) == ["^ab", "ab$"]


def test_language(spark):
    docs = read_table(spark, SF, "documents")
    model = fit_language(docs)
    found = identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    strange = {(r.doc_id, r.lang_pred) for r in identify_language(odd(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (None, "und")} <= strange and (10, "und") not in strange
    assert identify_language(empty(spark), model).count() == 0
    nothing = fit_language(empty(spark))
    assert {r.lang_pred for r in identify_language(odd(spark), nothing).collect()} == {"und"}


def test_held_out_rows_do_not_teach(spark):
    docs = read_table(spark, SF, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    wrong = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in fit_language(wrong).languages


def test_quality(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = fit_quality(docs, labels)
    found = score_quality(docs, model).join(labels, "doc_id").collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    strange = score_quality(odd(spark), model).collect()
    assert len(strange) == len(plain(odd(spark))) and all(0 <= r.score <= 1 for r in strange)
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in score_quality(docs, model).filter("predicted = 1").collect()}
    assert keep_quality(odd(spark), model).columns == odd(spark).columns
    assert score_quality(empty(spark), model).count() == 0
    untaught = score_quality(odd(spark), fit_quality(docs, labels.limit(0))).collect()
    assert {r.score for r in untaught} == {0.5}


def test_neighbours_vote_by_similarity(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = fit_quality(docs, labels, per_label=20)
    assert len(model.labels) == 40
    text = docs.filter("doc_id = 7").first().text
    vector = model.embed(term_frequencies(text)[None])[0]
    order = sorted(range(40), key=lambda i: -(model.vectors[i] @ vector))[:15]
    weights = [max(model.vectors[i] @ vector, 1e-9) for i in order]
    want = sum(w * model.labels[i] for w, i in zip(weights, order, strict=True)) / sum(weights)
    got = score_quality(docs.filter("doc_id = 7"), model).first().score
    assert abs(got - want) < 1e-6


def test_all_letters_of_a_run_decide(spark):
    a, b, shared = "qxzvj" * 60, "mnlrw" * 60, "ooeea" * 60
    texts = [(i, shared + (a if i % 2 else b), "aa" if i % 2 else "bb") for i in range(40)]
    model = fit_language(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    found = identify_language(odd(spark, [(100, "u" + shared + a[1:]), (101, "u" + shared + b[1:])]), model)
    assert {(r.doc_id, r.lang_pred) for r in found.collect()} == {(100, "aa"), (101, "bb")}
    assert [*grams("ab" * 300, 5)][-1] == "abab$" and len([*grams("a" * 300, 1)]) == 302


def plain_language(rows, texts, share):
    """Words first, then n-grams from 5 letters down to 1, in plain Python over all rows."""
    words = defaultdict(Counter)
    for lang, text in rows:
        words[lang].update("".join(filter(str.isalpha, w)) for w in re.findall(r"[^\W\d_]+", text.lower()))
    languages = sorted(words)

    def most(counts):
        return {x for c in counts.values() for x, _ in sorted(c.items(), key=lambda i: (-i[1], i[0].encode()))[:share]}

    def logs(count, total, kinds):
        each = [math.log((count[g] + 0.5) / (total[g] + 0.5 * kinds)) for g in languages]
        return [x - sum(each) / len(each) for x in each]

    chosen = most(words)
    total = {g: sum(words[g][w] for w in chosen) for g in languages}
    own = {w: logs({g: words[g][w] for g in languages}, total, len(chosen)) for w in chosen if sum(words[g][w] for g in languages) > 1}
    grams_of = defaultdict(Counter)
    for g in languages:
        for w in chosen & words[g].keys():
            for n in range(1, 6):
                marked = f"^{w}$"
                for i in range(len(marked) - n + 1):
                    grams_of[g][marked[i : i + n]] += round(math.log1p(words[g][w]) * 2**20)
    every = {x for c in grams_of.values() for x in c}
    kinds = Counter(map(len, every))
    sums = {n: {g: sum(v for x, v in grams_of[g].items() if len(x) == n) / 2**20 for g in languages} for n in kinds}
    known = {x: logs({g: grams_of[g][x] / 2**20 for g in languages}, sums[len(x)], kinds[len(x)]) for x in most(grams_of)}

    def score(word):
        if word in own:
            return own[word]
        for n in range(5, 0, -1):
            marked = f"^{word}$"
            found = [known[x] for i in range(len(marked) - n + 1) if (x := marked[i : i + n]) in known]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * len(languages)

    memo = {}
    for text in texts:
        counts = Counter("".join(filter(str.isalpha, w)) for w in re.findall(r"[^\W\d_]+", text.lower()))
        counts.pop("", None)
        if not counts:
            yield "und", 0.0
            continue
        sums_ = [0.0] * len(languages)
        for word, times in counts.items():
            if word not in memo:
                memo[word] = score(word)
            sums_ = [a + times * b for a, b in zip(sums_, memo[word])]
        best = max(range(len(languages)), key=lambda i: sums_[i])
        yield languages[best], 1 / sum(math.exp(max(x - sums_[best], -700)) for x in sums_)


@pytest.mark.parametrize("most_words, share", [(50_000, None), (10, 250)])
def test_language_by_brute_force(spark, most_words, share):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "lang", "text").collect()
    taught = [(r.lang, r.text or "") for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None]
    share = share or most_words // len({g for g, _ in taught})
    want = dict(zip([r.doc_id for r in rows], plain_language(taught, [r.text or "" for r in rows], share)))
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs, fit_language(docs, max_words=most_words)).collect()}
    assert got.keys() == want.keys()
    for doc_id, (lang, score) in want.items():
        assert abs(got[doc_id][1] - score) < 1e-6 and (got[doc_id][0] == lang or score < 0.5 + 1e-6)


def test_every_label_is_a_language(spark):
    """Three hundred labels, and one of them with nearly all rows and words."""
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} own", f"l{i:03}") for i in range(300)] * 2
    rows += [(1000 + i, " ".join(f"big{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)), "big") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(docs, max_words=1000)
    taught = {g for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.languages) == taught
    for r in identify_language(docs, model).join(docs.select("doc_id", "lang").distinct(), "doc_id").filter("not held_out").collect():
        assert r.lang_pred == r.lang


def plain_terms(text):
    """Term frequencies of the text as one piece, character by character."""

    def kind(c):
        if c in MARKS or c == "\n":
            return 9 + MARKS.index(c) if c in MARKS else 8
        if ord(c) >= 0x3000:
            return 2
        category = unicodedata.category(c)
        return {"Lu": 1, "Lt": 1, "Nd": 3, "Zs": 4}.get(category) or {"L": 2, "P": 5, "S": 6}.get(category[0], 7)

    classes, base, out = [kind(c) for c in text], 9 + len(MARKS), np.zeros(1027)
    for a, b, c in zip(classes, classes[1:], classes[2:]):
        out[(((a * base + b) * base + c) * 2654435761 >> 7) % 1024] += 1
    out[:1024] /= max(1, out[:1024].sum())
    words, lines = text.split(), text.split("\n") if text else []
    out[1024] = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
    out[1025:] = 1 - len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines))
    return out


@pytest.mark.parametrize("size", [1, 2, 50, 1 << 20])
def test_blocks_do_not_show_in_terms(size):
    lines = "one two two three\nfour  five\n\none two two three\nlast last"
    for text in [t or "" for _, t in TEXTS if t is None or len(t) < 10_000] + [LONG[:4000], lines, lines + "\n", "\n", "a\na", lines * 9]:
        assert np.allclose(term_frequencies(text, size), plain_terms(text), atol=1e-6)


def test_long_equal_lines_are_repeated_lines():
    line = "some words in a long line " * 50_000
    assert abs(term_frequencies(line + "\n" + line)[-1] - 0.5) < 1e-6


def test_quality_by_brute_force(spark):
    """Latent vectors by singular values, and the vote, over all rows of the smallest tables."""
    docs, labels = (read_table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    rows, quality = docs.select("doc_id", "text").collect(), {r.doc_id: r.quality for r in labels.collect()}
    terms = np.stack([plain_terms(r.text or "") for r in rows])
    taught = [i for i, r in enumerate(rows) if quality.get(r.doc_id) in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    rooted = np.sqrt(terms)
    mean = rooted[taught].mean(0)
    weight = np.log((1 + len(taught)) / (1 + (rooted[taught] > 0).sum(0))) + 1
    weighed = (rooted - mean) * weight
    latent = weighed @ np.linalg.svd(weighed[taught], full_matrices=False)[2][:32].T
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    known = np.array([quality[rows[i].doc_id] for i in taught])
    got = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert len(got) == len(rows)
    for r, vector in zip(rows, latent):
        cosine = latent[taught] @ vector
        near = np.argsort(-cosine, kind="stable")[:15]
        votes = np.maximum(cosine[near], 1e-9)
        assert abs(got[r.doc_id] - votes @ known[near] / votes.sum()) < 1e-3


def test_the_fit_holds_term_vectors_as_bytes(spark):
    draw = random.Random(4)
    rows = [(i, "".join(draw.choices("ab C.1,-", k=60))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    tracemalloc.start()
    model = fit_quality(docs, labels)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n = len(model.labels)
    assert n == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)
    assert peak < 24 * n * len(model.mean) + (32 << 20)  # numbers of Python take 32 bytes and more for each term
