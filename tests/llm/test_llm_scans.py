"""Secret and license scans against plain Python."""

import random
import re
import string
from collections import Counter

import pytest
from odd_documents import empty, odd, plain
from pyspark.sql import functions as F

from tidebars.llm.documents import read_table
from tidebars.llm.licenses import BASE, RULES, _any_of, scan_licenses
from tidebars.llm.secret_scan import find_secrets
from tidebars.llm.spans import match_spans, running_sums

SMALL = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    counts = [sum(k == i for _, k, _ in spans) for i in range(3)]
    return *counts, ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_running_sums_of_any_length(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        values = list(range(n))
        df = spark.createDataFrame([(values,)], "v array<int>").select(running_sums(F.col("v")).alias("s"))
        assert df.first().s == [i * (i + 1) // 2 for i in values]


def test_match_spans_count_code_points(spark):
    text = "😀ab😀abab x"
    df = spark.createDataFrame([(text,), ("",), ("x",)], "t string").select(match_spans(F.col("t"), "ab+").alias("s"))
    assert [[(s.start, s.end) for s in r.s] for r in df.collect()] == [[m.span() for m in re.finditer("ab+", text)], [], []]


SECRETS = [
    "token=token:abcdefgh",
    "😀 password = 'abc.def' 😀 AKIA" + "A" * 16,
    "AKIAAKIA" + "0" * 12 + "x AKIA" + "0" * 15 + " deadbeef",
    "TOKEN: a token:: b==cdefgh secret\"  =  \"zzzzzzz\"",
    "apikey=1234567 api_key:  1234567890 " * 300,
    "0123456789abcdef0123456",
    "f" * 24,
]


def test_base_secrets(spark):
    texts = [(100 + i, t) for i, t in enumerate(SECRETS)]
    docs = odd(spark).unionByName(odd(spark, texts)).unionByName(
        read_table(spark, SMALL, "documents"), allowMissingColumns=True
    )
    found = find_secrets(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_spans) for r in found) == Counter((i, *_base(t)) for i, t in plain(docs))
    for r in found:
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))
        assert sum(s.startswith("random") for s in r.spans.split(",")) == r.n_random
    assert find_secrets(empty(spark)).count() == 0


def test_random_tokens_are_told_from_words(spark):
    draw = random.Random(11)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(draw.choices(base64, k=40)) for _ in range(60)] + ["".join(draw.choices("0123456789abcdef", k=40)) for _ in range(60)]
    words = "internationalization counterrevolutionaries electroencephalographically".split()
    rows = [(i, f"a key {k} in a text") for i, k in enumerate(keys)]
    rows += [(1000 + i, " ".join(words) + " 00000000000000000000000001 abcabcabcabcabcabcabcabc") for i in range(300)]
    found = {r.doc_id: r for r in find_secrets(odd(spark, rows)).collect()}
    caught = [i for i, k in enumerate(keys) if f"random:6:{6 + len(k)}" in found[i].spans]
    assert len(caught) >= 110
    assert not any(found[1000 + i].n_random for i in range(300))


def _licenses(text):
    words = WORD.findall(text.translate(LOWER))
    starts, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    joined, found = " ".join(words), []
    for place, rule in enumerate(RULES):
        if rule.keyword in joined:
            for m in re.finditer(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])", joined, re.A):
                found.append((m.start(), -m.end(), -rule.priority, place, rule.label))
    found.sort()
    kept = {d[4] for i, d in enumerate(found) if not any(o[1] <= d[1] and o[2] <= d[2] for o in found[:i])}
    return len(words), sorted(starts), sorted(labels), sorted(labels | kept)


LICENSES = [
    "Licensed under the MIT License (MIT). MIT license",
    "GNU General Public License v3.0 and Apache License, Version 2.0",
    "SPDX-License-Identifier: BSD-3-Clause ... mit license " * 200,
    "É license mit-license Apache/License general  public\nlicense",
    "license",
    "released under the terms of the GNU Lesser General Public License version 3; all rights reserved",
]


def test_licenses(spark):
    docs = odd(spark).unionByName(odd(spark, [(100 + i, t) for i, t in enumerate(LICENSES)])).unionByName(
        read_table(spark, SMALL, "documents"), allowMissingColumns=True
    )
    found = scan_licenses(docs).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1:])
    got = sorted(((r.doc_id, r.n_words, sorted(r.base_starts), r.base_labels, r.labels) for r in found), key=key)
    assert got == sorted(((i, *_licenses(t)) for i, t in plain(docs)), key=key)
    assert all((r.score > 0) == bool(r.labels) and 0 <= r.score <= 1 for r in found)
    assert scan_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.label}-{r.priority}")
def test_every_rule_can_match_only_with_its_keyword(rule):
    assert rule.keyword == rule.keyword.lower() and re.compile(rule.pattern)
    assert re.compile(f"(?:^| ){_any_of({r.keyword for r in RULES})}").search(f"a {rule.keyword} b")
    assert len(RULES) > 200


def test_a_long_list_of_holders_keeps_its_license(spark):
    holders = ", ".join(f"the Very Long Institute Number {i}" for i in range(9))
    text = f"Neither the name of {holders} nor the names of its contributors may be used to endorse or promote products"
    far = text.replace("may be used", "x " * 300 + "may be used")
    found = {r.doc_id: r.labels for r in scan_licenses(odd(spark, [(1, text), (2, far)])).collect()}
    assert "bsd-3-clause" in found[1] and "bsd-3-clause" not in found[2]


def test_identifiers_are_not_random(spark):
    """Words joined by marks, slashes and capitals beside real keys: few false ones, few lost."""
    draw = random.Random(5)
    words = "user column handler widget config value python name service index table request server client parser buffer".split()
    joined = [lambda w: "-".join(w), lambda w: "_".join(w), lambda w: "/".join(w), lambda w: w[0] + "".join(map(str.title, w[1:]))]
    rows = [(i, f"see {joined[i % 4](draw.choices(words, k=6))} here") for i in range(4000)]
    symbols = string.ascii_letters + string.digits
    rows += [(i, f"see {''.join(draw.choices(symbols + '_-' * (i % 2), k=40))} here") for i in range(4000, 6000)]
    found = find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_random").collect()
    false, true = (sum(r.n_random for r in found if (r.doc_id < 4000) == side) for side in (True, False))
    assert true >= 0.97 * 2000 and false <= 0.05 * (false + true)
