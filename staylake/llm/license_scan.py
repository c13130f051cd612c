"""License scan with ordered signature rules, gated by keywords and settled by priority and containment."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

# Label, keywords of which a text must hold one (between bars), name as a pattern over lower-cased words joined by single spaces.
FAMILIES = [
    ("mit", "mit|expat", "(?:mit|expat)"),
    ("mit-0", "mit", "mit (?:no attribution|0)"),
    ("apache-1.1", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version)? 1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-1", "gnu general public|gpl", "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2", "gnu general public|gpl", "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gnu general public|gpl", "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: version| v)? ?3(?: 0)?"),
    ("gpl", "gnu general public|gpl", "(?:gnu general public licen[cs]e|gnu gpl|gpl)"),
    ("lgpl-2", "gnu l|lgpl", "(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "gnu l|lgpl", "(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?2 1"),
    ("lgpl-3", "gnu l|lgpl", "(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)(?: version| v)? ?3(?: 0)?"),
    ("lgpl", "gnu l|lgpl", "(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)"),
    ("agpl-3", "affero|agpl", "(?:gnu affero general public licen[cs]e|gnu agpl|agpl)(?:(?: version| v)? ?3(?: 0)?)?"),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e(?:(?: version)? 1 [123])?"),
    ("mpl-1.1", "mozilla|mpl", "(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?1 1"),
    ("mpl-2", "mozilla|mpl", "(?:mozilla public licen[cs]e|mpl)(?: version| v)? ?2(?: 0)?"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "(?:zlib libpng|zlib)"),
    ("boost-1", "boost", "boost software(?: licen[cs]e)?(?:(?: version)? 1 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0|creative commons", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc |creative commons", "(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc |creative commons", "(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc", "cc |creative commons", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: [1-4] [05])?"),
    ("cc-by-nd", "cc |creative commons", "(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc |creative commons", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc |creative commons", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("epl-1", "eclipse|epl", "(?:eclipse public licen[cs]e|epl)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse|epl", "(?:eclipse public licen[cs]e|epl)(?: version| v)? ?2(?: 0)?"),
    ("cddl-1", "common development|cddl", "(?:common development and distribution licen[cs]e|cddl)(?: version)?(?: 1 [01])?"),
    ("cpl-1", "common", "common public licen[cs]e(?:(?: version)? 1 0)?"),
    ("eupl", "european union|eupl", "(?:european union public licen[cs]e|eupl)(?:(?: version)? 1 [12])?"),
    ("artistic-1", "artistic", "artistic(?: licen[cs]e)?(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic", "artistic(?: licen[cs]e)?(?: version)? 2(?: 0)?"),
    ("ofl", "open font|ofl", "(?:sil open font licen[cs]e|ofl)(?:(?: version)? 1 [01])?"),
    ("odbl", "open database|odbl", "(?:open database licen[cs]e|odbl)(?:(?: version)? 1 0)?"),
    ("odc-by", "open data", "open data commons attribution"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2", "python", "(?:python software foundation|python)(?: licen[cs]e)?(?:(?: version)? 2(?: 0)?)?"),
    ("php-3", "php", "php(?: licen[cs]e)?(?: version)? 3(?: 0?1?)?"),
    ("ruby", "ruby", "ruby"),
    ("vim", "vim", "vim"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("upl-1", "universal", "universal permissive(?: licen[cs]e)?(?: 1 0)?"),
    ("zpl-2", "zope", "zope public(?: licen[cs]e)?(?: 2 [01])?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("x11", "x11", "x11"),
    ("cecill", "cecill", "cecill(?: [abc])?(?: [12] [01])?"),
    ("osl-3", "open software", "open software licen[cs]e(?:(?: version)? 3 0)?"),
    ("afl-3", "academic", "academic free(?: licen[cs]e)?(?:(?: version)? 3 0)?"),
]
# Forms in which a name is stated, strongest first, with the weight of the finding. All hold "licen" or "spdx".
FORMS = [
    ("spdx license identifier {}", 0.99),
    ("(?:licen[cs]ed|dual licen[cs]ed|relicen[cs]ed)(?: for use)? (?:under|by)(?: the)?(?: terms of(?: the)?)? {}(?: licen[cs]e)?", 0.97),
    ("(?:released|distributed|available|published|provided|covered|used|made available) (?:under|by)(?: the)?(?: terms of(?: the)?)? {} licen[cs]e", 0.95),
    ("subject to(?: the terms of)?(?: the)? {} licen[cs]e", 0.93),
    ("under(?: the)?(?: terms of(?: the)?)? {} licen[cs]e", 0.9),
    ("licen[cs]e (?:is|type|name|identifier) {}", 0.8),
    ("{} licen[cs]e", 0.6),
]
# Rules that need no name, and short names that stand for themselves: label, keyword, pattern, weight.
SINGLE = [
    ("apache-2", "apache", "apache licen[cs]e version 2(?: 0)?", 0.97),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?", 0.95),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?", 0.95),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?", 0.95),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] [05])?", 0.95),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] [05])?", 0.95),
    ("cc-by", "cc by", "cc by [1-4] [05]", 0.9),
    ("gpl-3", "gnu general public", "gnu general public licen[cs]e(?: v| version)? ?3(?: 0)?(?: or(?: \\(at your option\\))? any later version)?", 0.95),
    ("gpl-2", "gnu general public", "gnu general public licen[cs]e(?: v| version)? ?2(?: 0)?(?: or any later version)?", 0.95),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose", 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification", 0.9),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 0.97),
    ("public-domain", "public domain", "(?:released|placed|dedicated)(?: in| into| to) the public domain", 0.9),
    ("proprietary", "all rights reserved", "copyright (?:c )?[0-9]{4}[^\\n]{0,80}? all rights reserved", 0.7),
]
# Phrases whose every place is reported.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# At least one of these stands in every text that any rule can match.
GATES = ["licen", "spdx", "cc by", "public domain", "permission is hereby granted", "permission to use copy", "redistribution and use", "all rights reserved"]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_WEIGHT = 0.95


def rules() -> list[tuple[int, str, str, str, float]]:
    """All rules in order: (priority, label, keywords, pattern, weight). Forms come strongest first."""
    found = [(label, keyword, pattern, weight) for label, keyword, pattern, weight in SINGLE]
    found += [(label, keyword, form.format(name), weight) for form, weight in FORMS for label, keyword, name in FAMILIES]
    return [(i, label, keyword, f"(?<= ){pattern}(?= )", weight) for i, (label, keyword, pattern, weight) in enumerate(found)]


def _rule_array() -> Column:
    """The rules as one constant."""
    made = [{"rank": i, "label": label, "keywords": k.split("|"), "pattern": p, "weight": w} for i, label, k, p, w in rules()]
    return F.from_json(F.lit(json.dumps(made)), "array<struct<rank:int,label:string,keywords:array<string>,pattern:string,weight:double>>")


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _spans(padded: Column, rule: Column) -> Column:
    """Places of one rule as (from, neg_to, rank, to, label, weight); offsets count characters of the padded words."""
    pieces, hits = F.split(padded, rule["pattern"], F.lit(-1)), F.regexp_extract_all(padded, rule["pattern"], F.lit(0))

    def total(xs: Column, n: Column) -> Column:
        return F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))

    def place(hit: Column, i: Column) -> Column:
        start = total(pieces, i + 1) + total(hits, i)
        end = start + F.length(hit)
        return F.struct(start.alias("start"), (-end).alias("neg"), rule["rank"].alias("rank"), end.alias("end"), rule["label"].alias("label"), rule["weight"].alias("weight"))

    return F.transform(hits, place)


FINDING = "struct<start:int,neg:int,rank:int,end:int,label:string,weight:double>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find license statements in every text.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. A text that holds
    none of ``GATES`` is settled at once; otherwise a rule is tried only where its keyword stands. Of the rules'
    findings, sorted by start, longest first, then rule order, those inside an earlier one are suppressed.

    Returns per row: doc_id, n_words, the base phrases' places (n_base, first_word, last_word, base_labels),
    labels (of base phrases and kept findings, sorted, comma-joined), score (the largest weight, 0 without a finding),
    n_findings, and findings (start, end in the padded words, label, weight).

    All of it is one projection of each row, without a shuffle, so no source or copy can be hot.

    Null, empty and wordless texts have n_words 0 and no findings. Repeated rows are each answered; a null id stays
    null; an empty table gives an empty result. Other columns of the table are not looked at.
    """
    norm = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), NOT_WORD, " "))
    words = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), norm.alias("norm")).select(
        "doc_id", F.when(F.col("norm") == "", F.lit(0)).otherwise(_blanks(F.col("norm")) + 1).cast("bigint").alias("n_words"),
        F.concat(F.lit(" "), F.col("norm"), F.lit(" ")).alias("padded"),
    )
    padded = F.col("padded")
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains(padded, F.lit(word))
    nothing = F.array().cast("array<string>")
    parts = [F.when(F.contains(padded, F.lit(f" {p} ")), F.split(padded, f"(?<= ){p}(?= )", -1)).otherwise(nothing) for _, p in BASE]
    empty = F.from_json(F.lit("[]"), f"array<{FINDING}>")
    tried = F.filter(_rule_array(), lambda r: F.exists(r["keywords"], lambda k: F.contains(padded, k)))
    found = F.when(gate, F.array_sort(F.flatten(F.transform(tried, lambda r: _spans(padded, r))))).otherwise(empty)
    staged = words.select("doc_id", "n_words", *[p.alias(f"p{i}") for i, p in enumerate(parts)], found.cast(f"array<{FINDING}>").alias("found"))

    count, first, last, labels = [], [], [], []
    for i, (label, phrase) in enumerate(BASE):
        p = F.col(f"p{i}")
        there = F.size(p) > 1
        count.append(F.greatest(F.size(p) - 1, F.lit(0)))
        first.append(F.when(there, _blanks(F.get(p, F.lit(0))) - 1))
        last.append(F.when(there, F.col("n_words") - (_blanks(F.element_at(p, -1)) - 1) - (phrase.count(" ") + 1)))
        labels.append(F.when(there, F.lit(label)))
    swept = F.aggregate(
        "found", F.struct(F.lit(0).alias("reach"), empty.alias("kept")),
        lambda a, f: F.when(f["end"] > a["reach"], F.struct(f["end"].alias("reach"), F.concat(a["kept"], F.array(f)).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    kept = F.when(F.size("found") > 0, swept).otherwise(F.col("found"))
    out = staged.select(
        "doc_id", "n_words", sum(count[1:], count[0]).cast("bigint").alias("n_base"), F.least(*first).cast("bigint").alias("first_word"),
        F.greatest(*last).cast("bigint").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"), kept.alias("kept"),
    )
    own = F.transform("kept", lambda f: f["label"])
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("kept", lambda f: f["weight"])), F.lit(0.0))).alias("score"),
        F.size("kept").cast("bigint").alias("n_findings"),
        F.transform("kept", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["label"].alias("label"), f["weight"].alias("weight"))).alias("findings"),
    )
