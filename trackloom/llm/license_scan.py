"""License scans by ordered signature rules, in DataFrame functions alone and without any shuffle.

A text without any of a few word stems or pairs of words is let go after one look. In the others the words are laid out with single
spaces between them, a rule is tried only where its keyword is among the words, and every place it matches becomes an
interval of words. An interval inside another one is suppressed, and of equal ones the rule that comes first stays.
"""

from __future__ import annotations

import re
from re import _parser as parser
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Stems of words of licences.
STEMS = ["licens", "licenc", "copyright", "gpl", "spdx", "warrant", "permission", "redistribut", "commons", "domain", "wtfpl", "cc0", "endorse"]
#: Words whose pairs tell of a rule, where one of them alone stands in too many texts: one of the two, and the pair.
PAIRS = [("under", f"(?:released|distributed|available|provided|published){BETWEEN}+under"), ("cc", f"cc{BETWEEN}+0")]
#: Base phrases and their labels, as the contract fixes them.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Families: label, then names as words in a regex. Each name gives a rule for every form below.
FAMILIES = [
    ("mit", "mit"), ("mit", "expat"), ("mit-0", "mit no attribution"), ("x11", "x11"),
    ("apache-1.1", "apache(?: software)?(?: license)? (?:version |v)?1 1"), ("apache-2.0", "apache(?: software)?(?: license)? (?:version |v)?2(?: 0)?"), ("apache", "apache(?: software)?"),
    ("gpl-1.0", "(?:gnu )?(?:gpl|general public license) ?(?:version |v )?v?1(?: 0)?"), ("gpl-2.0", "(?:gnu )?(?:gpl|general public license) ?(?:version |v )?v?2(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?(?:gpl|general public license) ?(?:version |v )?v?3(?: 0)?"), ("gpl", "gnu (?:gpl|general public)"), ("gpl", "gpl"),
    ("lgpl-2.0", "(?:gnu )?(?:lgpl|library general public license) ?(?:version |v )?v?2(?: 0)?"), ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v )?v?2 1"),
    ("lgpl-3.0", "(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v )?v?3(?: 0)?"), ("lgpl", "(?:gnu )?(?:lesser|library) general public"), ("lgpl", "lgpl"),
    ("agpl-3.0", "(?:gnu )?(?:agpl|affero general public license) ?(?:version |v )?v?3(?: 0)?"), ("agpl", "(?:gnu )?affero general public"), ("agpl", "agpl"),
    ("gfdl", "gnu free documentation"), ("gfdl", "gfdl"),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause|bsd 2 clause)(?: bsd)?"), ("bsd-3-clause", "(?:modified|revised|new|3 clause|three clause|bsd 3 clause)(?: bsd)?"),
    ("bsd-4-clause", "(?:original|4 clause|four clause|bsd 4 clause)(?: bsd)?"), ("0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)"), ("bsd", "bsd(?: style)?"),
    ("mpl-1.1", "(?:mozilla public license|mpl) (?:version |v )?v?1 1"), ("mpl-2.0", "(?:mozilla public license|mpl) (?:version |v )?v?2(?: 0)?"), ("mpl", "mozilla public"), ("mpl", "mpl"),
    ("epl-1.0", "(?:eclipse public license|epl) (?:version |v )?v?1(?: 0)?"), ("epl-2.0", "(?:eclipse public license|epl) (?:version |v )?v?2(?: 0)?"), ("epl", "eclipse public"),
    ("cddl", "common development and distribution"), ("cpl", "common public"), ("ipl", "ibm public"), ("eupl", "european union public"), ("osl", "open software"), ("afl", "academic free"),
    ("artistic-2.0", "artistic license (?:version |v)?2(?: 0)?"), ("artistic", "(?:perl )?artistic"), ("isc", "isc"), ("zlib", "zlib(?: libpng)?"), ("libpng", "libpng"), ("boost", "boost software"), ("bsl-1.1", "business source"),
    ("psf", "(?:python software foundation|psf)"), ("python", "python"), ("ruby", "ruby"), ("php", "php"), ("openssl", "openssl"), ("ncsa", "(?:university of illinois )?ncsa(?: open source)?"), ("w3c", "w3c(?: software)?"),
    ("unlicense", "unlicense"), ("wtfpl", "(?:wtfpl|do what the fuck you want to public)"), ("beerware", "beerware"), ("unicode", "unicode"), ("icu", "icu"), ("ofl", "(?:sil )?open font"), ("odbl", "open (?:data commons )?(?:open )?database"),
    ("sspl", "server side public"), ("elastic", "elastic"), ("ms-pl", "microsoft public"), ("ms-rl", "microsoft reciprocal"), ("upl", "universal permissive"), ("vim", "vim"), ("curl", "curl"), ("hpnd", "historical permission notice and disclaimer"), ("ecl", "educational community"), ("cecill", "cecill"), ("bsl-1.0", "bsl 1 0"),
    ("cc-by-nc-nd", "(?:creative commons |cc )(?:attribution non ?commercial no ?deriv(?:ative)?s|by nc nd)(?: [1-4] [05])?"), ("cc-by-nc-sa", "(?:creative commons |cc )(?:attribution non ?commercial share ?alike|by nc sa)(?: [1-4] [05])?"),
    ("cc-by-nc", "(?:creative commons |cc )(?:attribution non ?commercial|by nc)(?: [1-4] [05])?"), ("cc-by-nd", "(?:creative commons |cc )(?:attribution no ?deriv(?:ative)?s|by nd)(?: [1-4] [05])?"),
    ("cc-by-sa", "(?:creative commons |cc )(?:attribution share ?alike|by sa)(?: [1-4] [05])?"), ("cc-by", "(?:creative commons |cc )(?:attribution|by)(?: [1-4] [05])?"), ("cc", "creative commons"),
]
#: Forms: what the name stands in, the keywords of which one must be among the words, the confidence.
FORMS = [
    ("spdx license identifier {}(?: only| or later)?", ["spdx"], 1.0),
    ("(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?{}(?: license| licence)?", ["under"], 0.95),
    ("(?:the )?{} (?:license|licence)(?: agreement)?", ["license", "licence"], 0.9),
]
#: Rules of their own: label, keyword, words, confidence; each is a sentence of a license's text or a notice.
NOTICES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1.0), ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1.0), ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software", 0.9),
    ("apache-2.0", "license", "you may not use this file except in compliance with the license", 0.9), ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0), ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 1.0),
    ("warranty-disclaimer", "warranty", "(?:provided )?as is without warranty of any kind", 0.6), ("warranty-disclaimer", "warranties", "as is without (?:any )?(?:express or implied )?warranties", 0.6), ("zlib", "warranty", "as is without any express or implied warranty", 0.8),
    ("public-domain", "domain", "(?:released|placed|dedicated|put)(?: in)?(?: to| into)? the public domain", 0.9), ("public-domain", "domain", "public domain", 0.5), ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9), ("cc0", "cc", "cc 0(?: 1 0)?", 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0), ("proprietary", "reserved", "copyright(?: c)?(?: [0-9]{{4}})*(?: [^ ]+){{0,6}} all rights reserved", 0.7), ("copyright", "copyright", "copyright(?: c)? [0-9]{{4}}", 0.4),
    ("wtfpl", "wtfpl", "wtfpl", 0.9), ("proprietary", "permission", "without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 0.4),
    ("mit", "sublicense", "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 1.0), ("mit", "substantial", "this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising", 1.0),
    ("isc", "arising", "arising out of or in connection with the use or performance of this software", 0.9), ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 1.0), ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 1.0),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 1.0), ("bsd-3-clause", "contributors", "nor the names of its contributors may be used", 1.0),
    ("apache-2.0", "copyright", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 1.0), ("apache-2.0", "patent", "no charge royalty free irrevocable (?:except as stated in this section )?patent license", 0.9),
    ("apache-2.0", "apache", "www apache org licenses license 2 0", 1.0), ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 0.9),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license", 1.0), ("lgpl", "gnu", "you should have received a copy of the gnu (?:lesser|library) general public license", 1.0), ("agpl", "gnu", "you should have received a copy of the gnu affero general public license", 1.0),
    ("gpl-2.0", "gnu", "gnu general public license (?:as published by the free software foundation )?(?:either )?version 2", 1.0), ("gpl-3.0", "gnu", "gnu general public license (?:as published by the free software foundation )?(?:either )?version 3", 1.0),
    ("gpl", "fitness", "without even the implied warranty of merchantability or fitness for a particular purpose", 0.7), ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document", 0.7),
    ("gpl-3.0", "propagate", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable", 1.0), ("agpl-3.0", "remotely", "all users interacting with it remotely through a computer network", 1.0),
    ("gfdl", "invariant", "with no invariant sections(?: no front cover texts)?", 1.0), ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license", 1.0), ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license", 1.0),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0), ("cddl", "cddl", "cddl", 0.8), ("cddl", "distribution", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("artistic", "artistic", "you may distribute under the terms of either the gnu general public license or the artistic license", 1.0), ("artistic", "perl", "under the same terms as perl(?: itself)?", 0.9), ("ruby", "ruby", "under the same terms as ruby(?: itself)?", 0.8),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 1.0), ("zlib", "altered", "altered source versions must be plainly marked as such", 1.0), ("libpng", "png", "the png reference library is supplied as is", 1.0),
    ("boost", "boost", "distributed under the boost software license version 1 0", 1.0), ("boost", "executable", "solely in the form of machine executable object code generated by a source language processor", 1.0),
    ("psf", "python", "psf is making python available to licensee on an as is basis", 1.0), ("openssl", "openssl", "this product includes software developed by the openssl project", 1.0), ("ncsa", "restriction", "to deal with the software without restriction", 0.8),
    ("w3c", "holders", "this work is being provided by the copyright holders under the following license", 0.7), ("unlicense", "unencumbered", "free and unencumbered software", 0.8), ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("beerware", "beer", "you can buy me a beer in return", 1.0), ("wtfpl", "fuck", "you just do what the fuck you want to", 1.0), ("unicode", "unicode", "to any person obtaining a copy of the unicode data files", 1.0), ("ofl", "reserved", "with reserved font name", 1.0), ("ofl", "font", "(?:original or modified versions of )?the font software", 0.9),
    ("odbl", "database", "made available under the open database license", 1.0), ("sspl", "functionality", "make the functionality of the program or a modified version available to third parties as a service", 1.0), ("bsl-1.1", "change", "(?:the )?change date(?: and)?(?: the)? change license", 0.8),
    ("elastic", "managed", "you may not provide the software to third parties as a hosted or managed service", 1.0), ("ms-pl", "governs", "this license governs use of the accompanying software", 0.6), ("upl", "contributed", "the larger works to which the software is contributed", 0.9), ("cc0", "waives", "overtly fully permanently irrevocably and unconditionally waives", 1.0),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] 0", 1.0), ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] 0", 1.0), ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] 0", 1.0), ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] 0", 1.0), ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] 0", 1.0), ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0", 1.0),
    ("gpl", "gnu", "www gnu org licenses(?: gpl)?", 0.8), ("mit", "opensource", "opensource org licenses mit", 1.0), ("bsd-3-clause", "opensource", "opensource org licenses bsd 3 clause", 1.0), ("bsd-2-clause", "opensource", "opensource org licenses bsd 2 clause", 1.0), ("apache-2.0", "opensource", "opensource org licenses apache 2 0", 1.0),
    ("proprietary", "confidential", "proprietary and confidential", 0.7), ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)(?: of this file| or distribution)?", 0.6), ("proprietary", "reserved", "all rights reserved", 0.5), ("proprietary", "evaluation", "for evaluation purposes only", 0.5), ("proprietary", "reproduced", "no part of this (?:publication|work|document|book) may be reproduced", 0.8),
]


#: Stems in texts that a rule can match: with those of notices that hold none of them, every match of a rule holds one, or
#: what PAIRS finds.
def stems() -> list[str]:
    return STEMS + sorted({keyword for _, keyword, words, _ in NOTICES if keyword not in dict(PAIRS) and not any(stem in words for stem in STEMS)})


#: Words that many names share, and so no anchor of any.
SHARED = frozenset("license licence version software public the of and or to style open source free".split())


def spellings(pattern: str) -> list[str]:
    """All texts that a pattern of groups, alternatives, optional parts and sets of characters matches."""
    def of(parts) -> list[str]:
        out = [""]
        for op, value in parts:
            if op is parser.LITERAL:
                found = [chr(value)]
            elif op is parser.IN:
                found = [chr(c) for kind, v in value for c in (range(v[0], v[1] + 1) if kind is parser.RANGE else [v])]
            elif op is parser.BRANCH:
                found = [x for part in value[1] for x in of(part)]
            elif op is parser.SUBPATTERN:
                found = of(value[3])
            elif op is parser.MAX_REPEAT and value[:2] == (0, 1):
                found = ["", *of(value[2])]
            else:
                raise ValueError(f"no finite list of spellings: {pattern}")
            out = [a + b for a in out for b in found]
        return out

    return sorted(set(of(parser.parse(pattern))))


def anchors(name: str) -> list[str]:
    """The longest word of each spelling of a name that tells it from others, so that every match of it holds one of
    them; none if a spelling has no such word."""
    told = [[w for w in s.split() if re.search("[a-z]", w) and len(w) > 1 and w not in SHARED] for s in spellings(name)]
    return sorted({max(words, key=len) for words in told}) if all(told) else []


def rules() -> list[tuple[int, list[str], list[str], str, str, float]]:
    """(priority, keywords, anchors, pattern, label, confidence), the rule that wins first: base phrases, notices, forms
    of families. A rule is tried where one of its keywords and one of its anchors are among the words."""
    found = [([phrase.split()[-1]], [phrase.split()[0]], phrase, label, 0.9) for phrase, label in BASE.items()]
    found += [([keyword], [keyword], words.replace("{{", "{").replace("}}", "}"), label, sure) for label, keyword, words, sure in NOTICES]
    found += [(keywords, anchors(name) or keywords, form.replace("{}", f"(?:{name})"), label, sure) for form, keywords, sure in FORMS for label, name in FAMILIES]
    return [(k, keywords, near, f"(?<= )(?:{words})(?= )", label, sure) for k, (keywords, near, words, label, sure) in enumerate(found)]


def worth_laying(lowered: Column) -> Column:
    """Whether a rule can match the text at all."""
    has = lambda w: F.contains(lowered, F.lit(w))
    return reduce(or_, [*map(has, stems()), *[has(word) & lowered.rlike(pair) for word, pair in PAIRS]])


def word_count(text: Column) -> Column:
    """Words of a text: the parts between separators, without the empty ones at its ends."""
    parts = F.size(F.split(text, f"{BETWEEN}+", -1))
    at_end = lambda c: (c.rlike(BETWEEN) | (c == "")).cast("int")
    return F.greatest(parts - at_end(F.left(text, F.lit(1))) - at_end(F.right(text, F.lit(1))), F.lit(0)).cast("long")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(laid: Column, rule: Column) -> Column:
    """Intervals of words where the rule matches: array of (first, reach, rank, label, sure), in order."""
    gaps, hits = F.split(laid, rule["pattern"], -1), F.regexp_extract_all(laid, rule["pattern"], F.lit(0))
    start = F.struct(F.lit(-1).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    walked = F.aggregate(
        F.transform(steps, lambda s: F.struct(spaces(s["gap"]).alias("gap"), spaces(s["hit"]).alias("hit"))),
        start,
        lambda acc, s: F.struct((acc["at"] + s["gap"] + s["hit"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + s["gap"])).alias("starts")),
    )["starts"]
    return F.transform(walked, lambda first, k: F.struct(first.alias("first"), (-(first + spaces(F.get(hits, k)))).alias("reach"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["sure"].alias("sure")))


def scan(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text has no words. Counts are 0, labels empty strings and score 0 where nothing is found; first_word and
    last_word are then null. Each row is scanned by itself, repeated or not. Columns of docs with those names give way."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in made]
    all_rules = rules()
    table = F.array(*[F.struct(F.lit(rank).alias("rank"), F.array(*map(F.lit, keys)).alias("keys"), F.array(*map(F.lit, near)).alias("near"), F.lit(pattern).alias("pattern"), F.lit(label).alias("label"), F.lit(sure).alias("sure")) for rank, keys, near, pattern, label, sure in all_rules])
    keywords = F.array(*map(F.lit, sorted({w for r in all_rules for w in (*r[1], *r[2])})))
    words = F.regexp_extract_all(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    rows = docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(*columns, word_count(F.col("_text")).alias("n_words"), F.when(worth_laying(F.lower("_text")), words).alias("_words"))
    rows = rows.select(*columns, "n_words", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).alias("_laid"), F.array_intersect(F.col("_words"), keywords).alias("_found"))
    tried = F.filter(table, lambda r: F.arrays_overlap(F.col("_found"), r["keys"]) & F.arrays_overlap(F.col("_found"), r["near"]))
    spans = F.when(F.size("_found") > 0, F.array_sort(F.flatten(F.transform(tried, lambda r: places(F.col("_laid"), r)))))
    rows = rows.select(*columns, "n_words", spans.alias("_spans"))
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    start = F.struct(F.lit(-1).alias("reach"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("sure"))
    left = F.aggregate(
        "_spans",
        start,
        lambda acc, s: F.when(-s["reach"] <= acc["reach"], acc).otherwise(F.struct((-s["reach"]).alias("reach"), F.array_union(acc["labels"], F.array(s["label"])).alias("labels"), F.greatest(acc["sure"], s["sure"]).alias("sure"))),
    )
    rows = rows.select(*columns, "n_words", base.alias("_base"), left.alias("_left"))
    base_labels = F.array_distinct(F.transform("_base", lambda s: s["label"]))
    return rows.select(
        *columns,
        "n_words",
        F.when(F.col("_base").isNull(), 0).otherwise(F.size("_base")).cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda s: s["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda s: s["first"])).cast("long").alias("last_word"),
        F.coalesce(F.array_join(F.array_sort(base_labels), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_union(base_labels, F.col("_left.labels"))), ","), F.lit("")).alias("labels"),
        F.coalesce(F.col("_left.sure"), F.lit(0.0)).alias("score"),
    )
