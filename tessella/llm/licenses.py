"""Licences by known sentences and ordered rules of them, in built-in functions only.

A text is cut into sentences three times: at line ends and sentence ends
(one-line notices), and at sentence ends and blank lines only (licence texts
whose lines are wrapped), once with any full stop as an end and once with those
within numbers and URLs as none.  "v." before a number and the tag of an SPDX
line are no ends.  Comment marks at the start of lines go first, and in the
clause that protects a holder's name the name is replaced.  A sentence is lower-cased, all but a-z and 0-9 becomes
single spaces, and "this work is licensed under the", "released under" and
their like become "under"; known ones have an identifier.  A rule is a sequence
of identifiers, and a text meets it when they occur in this order, other
sentences between them or not.  A rule with more in it (a clause, an exception,
a whole text) takes the place of the plainer one, and a clause that isn't known,
between the last known one and the disclaimer, withholds it.  All of it happens within the
row of a text, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule, SPDX identifier, names of the licence in notices, normalised.
NOTICES = [
    ("mit_notice", "MIT", ["mit license"]),
    ("apache_notice", "Apache-2.0", ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"]),
    ("bsd2_notice", "BSD-2-Clause", ["bsd 2 clause license", "2 clause bsd license"]),
    ("bsd3_notice", "BSD-3-Clause", ["bsd 3 clause license", "3 clause bsd license"]),
    ("isc_notice", "ISC", ["isc license"]),
    ("gpl2_notice", "GPL-2.0-only", ["gnu general public license version 2", "gnu general public license v2 0"]),
    ("gpl3_notice", "GPL-3.0-only", ["gnu general public license version 3", "gnu general public license v3 0"]),
    ("lgpl21_notice", "LGPL-2.1-only", ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"]),
    ("lgpl3_notice", "LGPL-3.0-only", ["gnu lesser general public license version 3", "gnu lesser general public license v3 0"]),
    ("agpl3_notice", "AGPL-3.0-only", ["gnu affero general public license version 3", "gnu affero general public license v3 0"]),
    ("mpl_short", "MPL-2.0", ["mozilla public license 2 0", "mozilla public license version 2 0"]),
    ("epl1_notice", "EPL-1.0", ["eclipse public license 1 0", "eclipse public license version 1 0"]),
    ("epl2_notice", "EPL-2.0", ["eclipse public license 2 0", "eclipse public license version 2 0"]),
    ("eupl_notice", "EUPL-1.2", ["eupl license version 1 2", "european union public license 1 2"]),
    ("boost_notice", "BSL-1.0", ["boost software license version 1 0", "boost software license 1 0"]),
    ("zlib_notice", "Zlib", ["zlib license"]),
    ("unlicense_notice", "Unlicense", ["unlicense license"]),
    ("ofl_notice", "OFL-1.1", ["sil open font license version 1 1", "sil open font license 1 1"]),
    ("llvm_notice", "Apache-2.0 WITH LLVM-exception", ["apache license v2 0 with llvm exceptions"]),
]
# The kinds of the Creative Commons 4.0 licences with their words.
COMMONS = {
    "by": "attribution",
    "by-sa": "attribution sharealike",
    "by-nc": "attribution noncommercial",
    "by-nd": "attribution noderivatives",
    "by-nc-sa": "attribution noncommercial sharealike",
    "by-nc-nd": "attribution noncommercial noderivatives",
}
# Rule, SPDX identifier without only or later, name, version in headers.
GNU = [
    ("gpl2", "GPL-2.0", "general public license", "2"),
    ("gpl3", "GPL-3.0", "general public license", "3"),
    ("lgpl21", "LGPL-2.1", "lesser general public license", "2 1"),
    ("lgpl3", "LGPL-3.0", "lesser general public license", "3"),
    ("agpl3", "AGPL-3.0", "affero general public license", "3"),
]
# Sentences of public licence texts and notices, normalised.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit0_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_header": "licensed under the apache license version 2 0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache_define": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "llvm_header": "part of the llvm project under the apache license v2 0 with llvm exceptions",
    "gpl2_title": "gnu general public license version 2 june 1991",
    "lgpl21_title": "gnu lesser general public license version 2 1 february 1999",
    "gpl2_preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl3_title": "gnu general public license version 3 29 june 2007",
    "gpl3_preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "lgpl3_title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl3_preamble": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "agpl3_title": "gnu affero general public license version 3 19 november 2007",
    "agpl3_preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "classpath_whole": "thus the terms and conditions of the gnu general public license cover the whole combination",
    "classpath_link": "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules and to copy and distribute the resulting executable under terms of your choice provided that you also meet for each linked independent module the terms and conditions of the license of that module",
    "gcc_runtime": "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception version 3 1 as published by the free software foundation",
    "bsd_permit": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "mpl2_title": "mozilla public license version 2 0",
    "mpl2_grant": "each contributor hereby grants you a world wide royalty free non exclusive license",
    "mpl11_title": "mozilla public license version 1 1",
    "mpl11_grant": "the initial developer hereby grants you a world wide royalty free non exclusive license subject to third party intellectual property claims",
    "artistic_intent": "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications",
    "artistic_embed": "you may embed this package s interpreter within an executable of yours by linking",
    "gpl1_title": "gnu general public license version 1 february 1989",
    "gpl1_preamble": "the license agreements of most software companies try to keep users at the mercy of those companies",
    "lgpl2_title": "gnu library general public license version 2 june 1991",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd0_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "postgresql_grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl1_title": "eclipse public license v 1 0",
    "epl2_title": "eclipse public license v 2 0",
    "epl_terms": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "epl2_header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cddl_header": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "zlib_warranty": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0_title": "cc0 1 0 universal",
    "cc0_laws": "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s each and all an owner of an original work of authorship and or a database each a work",
    "rust_dual": "licensed under the apache license version 2 0 license apache or http www apache org licenses license 2 0 or the mit license license mit or http opensource org licenses mit at your option",
    "mit_gpl2_dual": "dual licensed under the mit or gpl version 2 licenses",
}
# A sentence of three words or more that isn't known, and one that begins a disclaimer with its holder's name in it.
OTHER, AS_IS = "other", "as_is"
AS_IS_BEGINS = "this software is provided by "
# Rule, SPDX expression (none: the rule only withholds others), sentences in their order.
RULES = [
    ("mit_text", "MIT", ["mit_grant", "mit_keep", "mit_as_is"]),
    ("mit0_text", "MIT-0", ["mit0_grant", "mit_as_is"]),
    ("apache_header", "Apache-2.0", ["apache_header", "apache_use", "apache_copy"]),
    ("apache_text", "Apache-2.0", ["apache_title", "apache_define"]),
    ("llvm_header", "Apache-2.0 WITH LLVM-exception", ["llvm_header"]),
    ("gpl2_text", "GPL-2.0-only", ["gpl2_title", "gpl2_preamble"]),
    ("gpl3_text", "GPL-3.0-only", ["gpl3_title", "gpl3_preamble"]),
    ("lgpl21_text", "LGPL-2.1-only", ["lgpl21_title", "gpl2_preamble"]),
    ("lgpl3_text", "LGPL-3.0-only", ["lgpl3_title", "lgpl3_preamble"]),
    ("agpl3_text", "AGPL-3.0-only", ["agpl3_title", "agpl3_preamble"]),
    ("bsd2_text", "BSD-2-Clause", ["bsd_permit", "bsd_source", "bsd_binary"]),
    ("bsd3_text", "BSD-3-Clause", ["bsd_permit", "bsd_source", "bsd_binary", "bsd_name"]),
    ("bsd4_text", "BSD-4-Clause", ["bsd_permit", "bsd_source", "bsd_binary", "bsd_advert", "bsd_name"]),
    ("bsd_other", "", ["bsd_permit", "bsd_source", "bsd_binary", OTHER, AS_IS]),
    ("bsd_name_other", "", ["bsd_permit", "bsd_source", "bsd_binary", "bsd_name", OTHER, AS_IS]),
    ("mit_other", "", ["mit_grant", "mit_keep", OTHER, "mit_as_is"]),
    ("mpl2_text", "MPL-2.0", ["mpl2_title", "mpl2_grant"]),
    ("mpl11_text", "MPL-1.1", ["mpl11_title", "mpl11_grant"]),
    ("artistic_perl_text", "Artistic-1.0-Perl", ["artistic_intent", "artistic_embed"]),
    ("gpl1_text", "GPL-1.0-only", ["gpl1_title", "gpl1_preamble"]),
    ("lgpl2_text", "LGPL-2.0-only", ["lgpl2_title", "gpl2_preamble"]),
    ("isc_text", "ISC", ["isc_grant"]),
    ("bsd0_text", "0BSD", ["bsd0_grant"]),
    ("postgresql_text", "PostgreSQL", ["postgresql_grant"]),
    ("mpl_header", "MPL-2.0", ["mpl_notice", "mpl_copy"]),
    ("epl1_text", "EPL-1.0", ["epl1_title", "epl_terms"]),
    ("epl2_text", "EPL-2.0", ["epl2_title", "epl_terms"]),
    ("epl2_header", "EPL-2.0", ["epl2_header"]),
    ("cddl_header", "CDDL-1.0", ["cddl_header", "apache_use"]),
    ("zlib_text", "Zlib", ["zlib_warranty", "zlib_grant", "zlib_altered"]),
    ("unlicense_text", "Unlicense", ["unlicense"]),
    ("cc0_text", "CC0-1.0", ["cc0_title", "cc0_laws"]),
    ("rust_dual", "MIT OR Apache-2.0", ["rust_dual"]),
    ("mit_gpl2_dual", "MIT OR GPL-2.0-only", ["mit_gpl2_dual"]),
]
# A rule that is met takes the place of the second one.
INSTEAD = [("bsd3_text", "bsd2_text"), ("bsd4_text", "bsd2_text"), ("bsd4_text", "bsd3_text"), ("bsd_other", "bsd2_text"), ("bsd_name_other", "bsd3_text"), ("bsd_name_other", "bsd4_text"), ("mit_other", "mit_text")]
# The texts hold the notices that they propose, and the name of another licence that they may be joined with.
INSTEAD += [("mpl2_text", "mpl_header"), ("mpl2_text", "mpl_short")]
# Every rule has a sentence with one of these within a word, or with the word cc, so a text without any needs no more.
ANCHORS = ("licens", "permission", "software", "redistribut", "mpl", "later version", "cc0", "related rights", "artistic")
CC = "(^|[^a-z0-9])cc([^a-z0-9]|$)"
MARKS = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--|dnl\b|rem\b)[ \t]?"
HOLDER = r"neither\s+the\s+names?\s+of\s+[^;:]{1,200}?\s+nor\s+the\s+names\s+of\s+(?:(?:its|their|any|other|the)\s+)?contributors"
HOLDER_AS = "neither the name of the copyright holder nor the names of its contributors"
WAYS = ("lines", "wrapped", "dotted")
LEAD = r"(?m)^ ?(?:th(?:is|e) (?:(?:font )?software|work|project|library|program|code|file|document) is )?(?:licensed|released|distributed) under (?:the )?"


def _notices() -> None:
    """The rules of one-line notices, SPDX lines and dual notices."""
    for rule, spdx, names in NOTICES:
        for k, name in enumerate(names):
            SENTENCES[f"{rule}_{k}"] = f"under {name}"
            RULES.append((rule, spdx, [f"{rule}_{k}"]))
    for kind, words in COMMONS.items():
        rule = kind.replace("-", "_")
        SENTENCES[f"{rule}_notice"] = f"under cc {kind.replace('-', ' ')} 4 0"
        SENTENCES[f"{rule}_long"] = f"under a creative commons {words} 4 0 international license"
        RULES.extend((f"{rule}_{form}", f"CC-{kind.upper()}-4.0", [f"{rule}_{form}"]) for form in ("notice", "long"))
    (_, _, mit), (_, _, apache) = NOTICES[0], NOTICES[1]
    for k, (a, b) in enumerate([(x, y) for m in mit for p in apache for x, y in ((m, p), (p, m))]):
        for form, text in {"or": f"under {a} or the {b} at your option", "either": f"under either of {a} or {b} at your option", "and": f"dual licensed under the {a} and the {b}"}.items():
            SENTENCES[f"dual_{form}_{k}"] = text
            RULES.append(("mit_apache_dual", "MIT OR Apache-2.0", [f"dual_{form}_{k}"]))


def _gnu() -> None:
    """The rules of headers that name one version only, or it and any later one, and of exceptions to them."""
    for rule, spdx, name, version in GNU:
        terms = f"you can redistribute it and or modify it under the terms of the gnu {name}"
        family, number = rule.rstrip("0123456789"), version.replace(" ", "")
        SENTENCES.update(
            {
                f"{family}_terms": f"{terms} as published by the free software foundation",
                f"later_{number}": f"either version {version} of the license or at your option any later version",
                f"later_short_{number}": f"either version {version} or at your option any later version",
                f"{rule}_joined": f"{terms} as published by the free software foundation either version {version} of the license or at your option any later version",
                f"{rule}_after": f"{terms} as published by the free software foundation version {version}",
                f"{rule}_before": f"{terms} version {version} as published by the free software foundation",
            }
        )
        later = [[f"{rule}_joined"], [f"{family}_terms", f"later_{number}"], [f"{family}_terms", f"later_short_{number}"]]
        RULES.extend((f"{rule}_later", f"{spdx}-or-later", ids) for ids in later)
        RULES.extend((f"{rule}_only", f"{spdx}-only", [f"{rule}_{form}"]) for form in ("after", "before"))
        # The texts end with the header that they propose.
        INSTEAD.append((f"{rule}_text", f"{rule}_later"))
        for base, exception, ids in (("gpl2", "Classpath-exception-2.0", ["classpath_whole", "classpath_link"]), ("gpl3", "GCC-exception-3.1", ["gcc_runtime"])):
            if rule == base:
                RULES.extend((f"{rule}_exception", f"{spdx}-or-later WITH {exception}", header + ids) for header in later)
                INSTEAD.append((f"{rule}_exception", f"{rule}_later"))


def _tags() -> None:
    """The rules of SPDX lines, one for each expression that the other rules give."""
    for spdx in sorted({spdx for _, spdx, _ in RULES if spdx}):
        name = re.sub("[^a-z0-9]+", " ", spdx.lower())
        SENTENCES[f"spdx {name}"] = f"spdx license identifier {name}"
        RULES.append((f"spdx_{name.replace(' ', '_')}", spdx, [f"spdx {name}"]))


_notices()
_gnu()
_tags()
KNOWN = {re.sub(LEAD, "under ", sentence): name for name, sentence in SENTENCES.items()}


def _sentences(text: Column, way: str) -> Column:
    """Normalised sentences in order; but for "lines", lines go on unless a blank one follows."""
    low = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "\r\n", "\n"), MARKS, "$1"), HOLDER, HOLDER_AS)
    low = F.regexp_replace(F.regexp_replace(low, r"\bv\.(?=\s{0,3}[0-9])", "v"), "spdx-license-identifier:", "spdx-license-identifier")
    if way == "lines":
        low = F.regexp_replace(low, r"[.!?;:]+\s", "\n")
    elif way == "wrapped":
        low = F.regexp_replace(F.regexp_replace(low, r"\n[ \t\r]*\n", "."), "[\r\n]", " ")
        low = F.regexp_replace(low, r"[.!?;:]+(\s|$)|\.", "\n")
    else:
        low = F.regexp_replace(F.regexp_replace(low, "\r\n?", "\n"), r"\n[ \t]*\n\s*", "\n\n")
        low = F.regexp_replace(low, r"(?<!\n)\n(?!\n)", " ")
        low = F.regexp_replace(low, r"[.!?;:]+(?![a-z0-9/])", "\n")
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\n]+", " "), LEAD, "under "), "\n"), lambda s: F.trim(s))


def _met(ids: Column, rules: Column) -> Column:
    """Those of the rules whose sequence the identifiers hold in order."""

    def whole(rule: Column) -> Column:
        steps = F.aggregate(ids, F.lit(0), lambda k, x: F.when((k < F.size(rule.ids)) & (F.try_element_at(rule.ids, k + 1) == x), k + 1).otherwise(k))
        return steps == F.size(rule.ids)

    return F.filter(rules, whole)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` for an array of results, with the value evaluated a single time however often it is used."""
    return F.flatten(F.transform(F.array(value), of))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rule, license (an SPDX expression) and sentences (of the rule) for every rule that a whole text meets.

    Null and empty texts meet none; a row repeated gives its results again;
    a null key is kept; an empty table gives no rows; other columns are left
    alone.
    """
    strings = lambda values: f"CAST(array({', '.join(map(repr, values))}) AS array<string>)"
    known = F.expr(f"map({', '.join(repr(x) for pair in KNOWN.items() for x in pair)})")
    structs = [f"named_struct('rule', '{r}', 'license', '{spdx}', 'ids', {strings(ids)}, 'by', {strings([win for win, lose in INSTEAD if lose == r])})" for r, spdx, ids in RULES]
    rules = F.expr(f"array({', '.join(structs)})")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(" OR ".join([*(f"contains(lower(_text), '{a}')" for a in ANCHORS), f"(contains(lower(_text), 'cc') AND lower(_text) RLIKE '{CC}')"]))

    # The tables of sentences and rules stand in the plan once, each way of cutting goes through them.
    cut = F.array(*[_sentences(F.col("_text"), w) for w in WAYS])
    others = lambda x: F.when(x.startswith(AS_IS_BEGINS), AS_IS).when(x.rlike("[^ ]+ [^ ]+ [^ ]"), OTHER)
    ids = F.transform(cut, lambda s: F.filter(F.transform(s, lambda x: F.coalesce(F.try_element_at(known, x), others(x))), lambda x: x.isNotNull()))
    # A run of unknown sentences is as good as one.
    short = lambda found: F.filter(found, lambda x, i: (x != OTHER) | (i == 0) | (F.get(found, i - 1) != OTHER))
    some = F.filter(F.transform(ids, short), lambda found: F.exists(found, lambda x: x != OTHER))
    met = _once(F.array_distinct(F.flatten(F.transform(some, lambda found: _met(found, rules)))), lambda m: F.filter(m, lambda r: ~F.arrays_overlap(r.by, m.rule) & (r.license != "")))
    # The outer form is not filtered by its own array first, which would evaluate it twice.
    found = rows.select("_key", F.explode_outer(met).alias("_r")).where("_r IS NOT NULL")
    return found.select(F.col("_key").alias(key), F.col("_r.rule").alias("rule"), F.col("_r.license").alias("license"), F.size("_r.ids").alias("sentences"))


def oracle() -> str:
    """The same rows in DuckDB's SQL, whose patterns know no look-around: what follows an end is taken with it, and blank lines are put aside first."""
    known = ", ".join(f"('{s}', '{n}')" for s, n in KNOWN.items())
    rules = ", ".join(f"('{r}', '{spdx}', {ids!r}::VARCHAR[])" for r, spdx, ids in RULES)
    instead = ", ".join(f"('{a}', '{b}')" for a, b in INSTEAD)
    anchored = " OR ".join([*(f"contains(lower(text), '{a}')" for a in ANCHORS), f"regexp_matches(lower(text), '{CC}')"])
    step = "list_reduce(list_transform(ids_found, lambda x: {'k': 0, 'x': x}), lambda a, x: {'k': CASE WHEN a.k < len(r.ids) AND r.ids[a.k + 1] = x.x THEN a.k + 1 ELSE a.k END, 'x': ''}, {'k': 0, 'x': ''}).k"
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(rule, license, ids) AS (VALUES {rules}), instead(win, lose) AS (VALUES {instead}),
low AS (
  SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), chr(13) || chr(10), chr(10)), '{MARKS}', '\\1', 'g'), '{HOLDER}', '{HOLDER_AS}', 'g'), '\\bv\\.(\\s{{0,3}}[0-9])', 'v\\1', 'g'), 'spdx-license-identifier:', 'spdx-license-identifier') AS t FROM documents WHERE {anchored}
), ends AS (
  SELECT doc_id, 0 AS way, regexp_replace(t, '[.!?;:]+\\s', chr(10), 'g') AS t FROM low
  UNION ALL
  SELECT doc_id, 1, regexp_replace(regexp_replace(regexp_replace(t, '\\n[ \\t\\r]*\\n', '.', 'g'), '[\\r\\n]', ' ', 'g'), '[.!?;:]+(\\s|$)|\\.', chr(10), 'g') FROM low
  UNION ALL
  SELECT doc_id, 2, regexp_replace(replace(replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '\\n[ \\t]*\\n\\s*', chr(1), 'g'), chr(10), ' '), chr(1), chr(10)), '[.!?;:]+([^a-z0-9/]|$)', chr(10), 'g') FROM low
), cut AS (
  SELECT doc_id, way, string_split(regexp_replace(regexp_replace(t, '[^a-z0-9\\n]+', ' ', 'g'), '{LEAD}', 'under ', 'g'), chr(10)) AS s FROM ends
), each_ AS (
  SELECT doc_id, way, generate_subscripts(s, 1) AS pos, trim(unnest(s)) AS sentence FROM cut
), found AS (
  SELECT doc_id, way, list(id ORDER BY pos) AS ids_found FROM (
    SELECT doc_id, way, pos, coalesce(id, CASE WHEN starts_with(sentence, '{AS_IS_BEGINS}') THEN '{AS_IS}' WHEN regexp_matches(sentence, '[^ ]+ [^ ]+ [^ ]') THEN '{OTHER}' END) AS id FROM each_ LEFT JOIN known USING (sentence)
  ) WHERE id IS NOT NULL GROUP BY ALL
), met AS (
  SELECT DISTINCT doc_id, rule, license, len(r.ids) AS sentences FROM found, rules r WHERE {step} = len(r.ids)
)
SELECT * FROM met m WHERE license <> '' AND NOT EXISTS (SELECT 1 FROM instead i JOIN met o ON o.rule = i.win WHERE i.lose = m.rule AND o.doc_id = m.doc_id)
"""
