"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.documents import ascii_lower, ids_and_texts
from tidebars.llm.spans import let, match_spans

# Base phrases and their labels; separators of words.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# What a license is called in running text, as regular expressions over lower-case words
# joined by single spaces, and the label it gets; the more particular name comes first.
# Between the two stands a keyword every match must have at the start of a word.
NAMES: tuple[tuple[str, str, str], ...] = (
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: (?:version|v) ?3(?: 0)?)?|gnu affero gpl(?: v?3)?"),
    ("agpl-3.0", "agpl", r"agpl ?(?:v ?)?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?:,? (?:version|v) ?2 1)"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: (?:version|v) ?3(?: 0)?)"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public license"),
    ("lgpl-2.1", "lgpl", r"lgpl ?(?:v ?)?2 1"),
    ("lgpl-3.0", "lgpl", r"lgpl ?(?:v ?)?3(?: 0)?"),
    ("gpl-2.0", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?"),
    ("gpl-3.0", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?"),
    ("gpl-2.0", "gpl", r"gpl ?(?:v ?)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gpl ?(?:v ?)?3(?: 0)?"),
    ("gpl", "gnu", r"gnu general public license|gnu gpl"),
    ("gfdl", "documentation license", r"(?:gnu )?free documentation license"),
    ("apache-2.0", "apache", r"apache license(?: (?:version|v))? ?2(?: 0)?|apache 2(?: 0)? license"),
    ("apache-1.1", "apache", r"apache software license(?: (?:version|v))? ?1 1"),
    ("apache-1.0", "apache", r"apache license(?: (?:version|v))? ?1 0"),
    ("mit", "mit license", r"(?:the )?mit license(?: mit)?"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("mit-x11", "x11", r"(?:mit )?x11 license"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause|freebsd) bsd license|bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd license|bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd license|bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause|free public) bsd license"),
    ("0bsd", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd licen[cs]e"),
    ("bsd", "berkeley", r"berkeley software distribution license"),
    ("isc", "isc", r"isc license"),
    ("isc", "internet systems", r"internet systems consortium license"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: (?:version|v))? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: (?:version|v))? ?1 1"),
    ("mpl-1.0", "mozilla", r"mozilla public license(?: (?:version|v))? ?1 0"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: (?:version|v))? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: (?:version|v))? ?2(?: 0)?"),
    ("edl", "eclipse", r"eclipse distribution license"),
    ("cddl-1.0", "development and distribution", r"common development and distribution license(?: (?:version|v)? ?1 ?0)?"),
    ("cddl-1.1", "development and distribution", r"common development and distribution license (?:version|v)? ?1 1"),
    ("cpl-1.0", "common public", r"common public license"),
    ("ipl-1.0", "ibm", r"ibm public license"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: v? ?1 2)?"),
    ("bsl-1.0", "boost", r"boost software license"),
    ("busl-1.1", "business source", r"business source license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("libpng", "libpng", r"libpng license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the", r"do what the f\w* you want to public license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:s|atives)"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    ("cc-by", "creative", r"creative commons attribution"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("artistic-2.0", "artistic", r"artistic license 2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic license(?: 1 0)?"),
    ("perl", "perl", r"same terms as perl(?: itself)?|perl license"),
    ("python-2.0", "python", r"python (?:software foundation )?license(?: version 2)?"),
    ("php-3.01", "php", r"php license(?: (?:version|v)? ?3 01)?"),
    ("ruby", "ruby", r"ruby license|same terms as ruby(?: itself)?"),
    ("openssl", "openssl", r"openssl license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?license"),
    ("ofl-1.1", "open font", r"sil open font license(?: (?:version|v)? ?1 1)?|open font license"),
    ("afl-3.0", "academic free", r"academic free license"),
    ("osl-3.0", "open software license", r"open software license"),
    ("odbl-1.0", "database license", r"open (?:data commons open )?database license"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and license"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("sspl-1.0", "server side", r"server side public license"),
    ("elastic-2.0", "elastic", r"elastic license(?: 2 0)?"),
    ("vim", "vim", r"vim license"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?license"),
    ("json", "json license", r"json license"),
    ("beerware", "beer", r"beer ?ware license"),
    ("qpl-1.0", "q public", r"q public license"),
    ("upl-1.0", "universal permissive", r"universal permissive license"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model license"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software license)(?: v? ?2)?"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: license)?"),
    ("openrail", "open rail", r"(?:bigscience |creativeml )?open rail(?: m)?(?: license)?"),
    ("llama", "llama", r"llama ?[1-4]?(?: [0-9])? community license"),
)
# How a name is introduced; {} stands for it. A rule is a form of a name.
FORMS: tuple[tuple[int, str], ...] = (
    (3, r"spdx license identifier (?:{})"),
    (2, r"(?:licensed|released|distributed|available|published|redistributed) under (?:the )?(?:terms of )?(?:the )?(?:{})"),
    (1, r"(?:{})"),
)
# Sentences out of license texts and notices, most telling first: label, keyword, priority, pattern.
SENTENCES: tuple[tuple[str, str, int, str], ...] = (
    ("mit", "permission is hereby granted", 3, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "above copyright notice", 2, r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission to use copy", 3, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", 3, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", 3, r"neither the name of .{1,400}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", 3, r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache org", 3, r"(?:http|https) www apache org licenses license 2 0"),
    ("apache-2.0", "you may not use this file", 3, r"you may not use this file except in compliance with the license"),
    ("gpl", "gnu org", 3, r"(?:http|https) www gnu org licenses(?: gpl)?"),
    ("gpl", "free software", 3, r"this program is free software you can redistribute it and or modify it"),
    ("mpl-2.0", "mozilla org", 3, r"mozilla org mpl 2 0"),
    ("unlicense", "public domain", 3, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "as is without any express", 3, r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "boost org", 3, r"(?:http|https) www boost org license 1 0 txt"),
    ("cc-by", "creativecommons", 2, r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons", 3, r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc0-1.0", "creativecommons", 3, r"creativecommons org publicdomain zero"),
    ("public-domain", "public domain", 1, r"(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", 1, r"all rights reserved"),
    ("proprietary", "confidential", 2, r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "unauthorized", 2, r"unauthorized (?:copying|reproduction|distribution) (?:of this \w+ )?is (?:strictly )?prohibited"),
    ("copyright", "copyright", 1, r"copyright (?:c )?(?:by )?[12][0-9]{3}"),
)
CONFIDENCE = {1: 0.6, 2: 0.85, 3: 0.97}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    pattern: str


def _rules() -> tuple[Rule, ...]:
    formed = [Rule(label, word, rank, form.format(name)) for rank, form in FORMS for label, word, name in NAMES]
    written = [Rule(label, word, rank, pattern) for label, word, rank, pattern in SENTENCES]
    return tuple(sorted([*written, *formed], key=lambda r: -r.priority))


#: Every rule, by falling priority; of two rules with the same interval the first counts.
RULES = _rules()


def _whole_words(pattern: str) -> str:
    return rf"(?<![^ ])(?:{pattern})(?![^ ])"


def _detections(text: Column) -> Column:
    """Intervals of all rules that match, in order of start, the longer first.

    The forms of a name are tried where its keyword stands in the text and the bare name
    matches; a sentence where its keyword stands. The rules are one constant array, so
    the plan has a single matching expression.
    """
    places = {(r.priority, r.pattern): i for i, r in enumerate(RULES)}

    def constant(label: str, rank: int, pattern: str) -> Column:
        return F.struct(
            F.lit(-rank).alias("minus_priority"), F.lit(places[rank, pattern]).alias("place"), F.lit(label).alias("label"),
            F.lit(_whole_words(pattern)).alias("pattern"),
        )

    groups = [(word, name, [constant(label, rank, form.format(name)) for rank, form in FORMS]) for label, word, name in NAMES]
    groups += [(word, pattern, [constant(label, rank, pattern)]) for label, word, rank, pattern in SENTENCES]
    table = [
        F.struct(F.lit(word).alias("keyword"), F.lit(_whole_words(gate)).alias("gate"), F.array(*rules).alias("rules"))
        for word, gate, rules in groups
    ]
    wanted = F.filter(F.array(*table), lambda g: F.contains(text, g["keyword"]) & F.regexp_like(text, g["gate"]))

    def found(rule: Column) -> Column:
        return F.transform(
            match_spans(text, rule["pattern"]),
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("minus_end"), rule["minus_priority"].alias("minus_priority"),
                rule["place"].alias("place"), rule["label"].alias("label"),
            ),
        )

    return F.array_sort(F.flatten(F.transform(F.flatten(F.transform(wanted, lambda g: g["rules"])), found)))


def _kept(detections: Column) -> Column:
    """Labels left when each interval inside another of no lower priority is dropped.

    In order of start, longer first, an interval lies inside an earlier one exactly if
    the furthest end so far of its priority or above reaches its own; three ends are
    all that has to be remembered.
    """
    start = F.struct(
        F.lit(0).alias("e1"), F.lit(0).alias("e2"), F.lit(0).alias("e3"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best")
    )

    def step(done: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        reach = F.when(priority == 1, done["e1"]).when(priority == 2, done["e2"]).otherwise(done["e3"])
        inside = reach >= end
        sure = F.lit(0.0)
        for p, c in CONFIDENCE.items():
            sure = F.when(priority == p, F.lit(c)).otherwise(sure)
        grown = [F.when(priority >= p, F.greatest(done[f"e{p}"], end)).otherwise(done[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3)]
        labels = F.when(inside | F.array_contains(done["labels"], d["label"]), done["labels"]).otherwise(F.array_append(done["labels"], d["label"]))
        return F.struct(*grown, labels.alias("labels"), F.when(inside, done["best"]).otherwise(F.greatest(done["best"], sure)).alias("best"))

    return F.aggregate(detections, start, step)


def _any_of(words: set[str]) -> str:
    """A pattern of any of the words that looks at each letter once: alternatives by first letter."""
    if "" in words:
        return ""
    by_letter: dict[str, set[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], set()).add(word[1:])
    return "(?:" + "|".join(letter + _any_of(rest) for letter, rest in sorted(by_letter.items())) + ")"


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Word places where the phrase's words follow each other."""
    first, *rest = phrase.split(" ")
    places = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())

    def follows(i: Column) -> Column:
        right = F.lit(True)
        for k, w in enumerate(rest, 1):
            right = right & F.get(words, i + k).eqNullSafe(F.lit(w))
        return right

    return F.filter(places, follows)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base_starts, base_labels, method_labels, labels, score`` of every row.

    Base phrases are places of consecutive words. The rules, some hundreds, run over the
    words joined by single spaces, and only those whose keyword the text contains; a
    detection inside another of the same or a higher priority is dropped. ``labels``
    (sorted, distinct) are the base labels and those of the detections left; ``score`` is
    the confidence of the best of them (a base phrase counts as a bare name), or 0.

    A missing text counts as empty and has no words, labels or score; texts may be of
    any length. Repeated rows are scanned each; an empty table gives no rows; extra
    columns are ignored. One pass over the texts, no shuffle.
    """
    text = F.trim(F.regexp_replace(ascii_lower(F.col("text")), SEPARATORS, " "))
    normal = ids_and_texts(docs).select("doc_id", text.alias("text"))
    words = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ", -1))
    none = F.array().cast("array<int>")
    gated = F.contains(F.col("text"), F.lit("license"))
    starts = [F.when(gated & F.contains(F.col("text"), F.lit(p)), let(words, _starts_of(p))).otherwise(none).alias(label) for p, label in BASE]
    spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" ")))
    n_words = F.when(F.col("text") == "", 0).otherwise(spaces + 1).cast("long")
    some = F.col("text").rlike(f"(?:^| ){_any_of({r.keyword for r in RULES})}")
    nothing = F.array().cast("array<struct<start:int,minus_end:int,minus_priority:int,place:int,label:string>>")
    scanned = normal.select(
        "doc_id", n_words.alias("n_words"), *starts, F.when(some, _detections(F.col("text"))).otherwise(nothing).alias("detections")
    )
    kept = scanned.withColumn("kept", _kept(F.col("detections")))
    base = F.filter(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull())
    found = F.when(F.size("base_labels") > 0, F.greatest(F.lit(CONFIDENCE[1]), "kept.best")).otherwise(F.col("kept.best"))
    return kept.select(
        "doc_id", "n_words", F.concat(*[label for _, label in BASE]).alias("base_starts"), F.array_sort(base).alias("base_labels"), "kept"
    ).select(
        "doc_id", "n_words", "base_starts", "base_labels", F.array_sort("kept.labels").alias("method_labels"),
        F.array_sort(F.array_union("base_labels", "kept.labels")).alias("labels"), found.alias("score"),
    )


def _starts_of(phrase: str) -> Callable[[Column], Column]:
    return lambda words: _phrase_starts(words, phrase)
