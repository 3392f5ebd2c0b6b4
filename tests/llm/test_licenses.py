import re
import textwrap
from pathlib import Path

import duckdb
import pandas as pd

from tessella.llm import licenses

from . import cases

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.rule) for r in rows)


def test_notices_and_wrapped_texts(spark):
    bsd = ". ".join(licenses.SENTENCES[k] for k in ("bsd_permit", "bsd_source", "bsd_binary"))
    texts = [
        "Some words.\nReleased under the MIT License.\nMore words.",
        "Licensed under the Apache License, Version 2.0.",
        MIT,
        bsd + ".",
        bsd + ". " + licenses.SENTENCES["bsd_name"] + ".",
        ". ".join(reversed([licenses.SENTENCES[k] for k in ("mit_grant", "mit_keep", "mit_as_is")])),
        "We talk about the MIT License and software here.",
        "Licensed under CC BY-NC 4.0.\n" * 500,
    ]
    assert found(spark, texts) == [(0, "mit_notice"), (1, "apache_notice"), (2, "mit_text"), (3, "bsd2_text"), (4, "bsd3_text"), (7, "by_nc_notice")]


def test_dotted_versions_and_urls_in_wrapped_texts(spark):
    notices = {
        "mpl_header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "apache_header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law',
        "apache_notice": "Licensed under the Apache License, Version 2.0.",
        "by_notice": "Licensed under CC BY 4.0.",
        "by_nc_notice": "Licensed under CC BY-NC 4.0.",
        "by_sa_notice": "Licensed under CC BY-SA 4.0.",
        "by_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    }
    wrap = lambda text, width: "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))
    cases = [(rule, f"Copyright of some one.\n\n{wrap(text, width)}\n\nMore words.") for rule, text in notices.items() for width in (17, 34, 40, 72, 300)]
    assert found(spark, [text for _, text in cases]) == [(i, rule) for i, (rule, _) in enumerate(cases)]
    assert found(spark, [f"words\n{notices['mpl_header']}\nwords", wrap(notices["apache_notice"], 34).replace("\n", "\r\n")]) == [(0, "mpl_header"), (1, "apache_notice")]


HEADER = "{program} is free software{colon} you can redistribute it and/or modify\nit under the terms of the GNU {name} as published by\nthe Free Software Foundation{comma} {which}.\n\n"
TITLES = {"gpl2": "General Public License", "gpl3": "General Public License", "lgpl21": "Lesser General Public License", "lgpl3": "Lesser General Public License", "agpl3": "Affero General Public License"}
VERSIONS = {"gpl2": "2", "gpl3": "3", "lgpl21": "2.1", "lgpl3": "3", "agpl3": "3"}


def header(rule, which, mark):
    colon, comma = (";", ";") if mark == ";" else (":", ",")
    return HEADER.format(program="This library", colon=colon, comma=comma, name=TITLES[rule], which=which.format(v=VERSIONS[rule]))


def rich():
    """Texts with the rules they meet: later or only, exceptions, dual notices, tags and near misses."""
    later, only = "either version {v} of the License, or (at your option) any later version", "version {v}"
    gpl2, gpl3 = header("gpl2", later, ";"), header("gpl3", later, ",")
    classpath = textwrap.fill(
        "Linking this library statically or dynamically with other modules is making a combined work based on this library. Thus, the terms and conditions of the GNU General Public License cover the whole combination. "
        "As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable, regardless of the license terms of these independent modules, "
        "and to copy and distribute the resulting executable under terms of your choice, provided that you also meet, for each linked independent module, the terms and conditions of the license of that module.",
        60,
    )
    texts = [(header(rule, later, mark), [f"{rule}_later"]) for rule in TITLES for mark in ",;"]
    texts += [(header(rule, only, ","), [f"{rule}_only"]) for rule in TITLES]
    texts += [
        (gpl2 + classpath, ["gpl2_exception"]),
        (classpath + "\n\n" + gpl2, ["gpl2_later"]),
        (classpath, []),
        (gpl3 + "Under Section 7 of GPL version 3, you are granted additional permissions described in the GCC Runtime Library Exception,\nversion 3.1, as published by the Free Software Foundation.", ["gpl3_exception"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nPreamble\n\nThe GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n" + gpl3, ["gpl3_text"]),
        ("Dual licensed under the MIT License and the Apache License, Version 2.0.", ["mit_apache_dual"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT License at your option.", ["mit_apache_dual"]),
        ("Dual licensed under the MIT or GPL Version 2 licenses.", ["mit_gpl2_dual"]),
        ("// SPDX-License-Identifier: MIT\ncode", ["spdx_mit"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\ncode", ["spdx_gpl_2_0_or_later_with_classpath_exception_2_0"]),
        ("SPDX-License-Identifier: MIT-ish", []),
        ("This project is licensed under the Eclipse Public License, version 2.0.", ["epl2_notice"]),
        ("Released under CC BY-NC-SA 4.0.", ["by_nc_sa_notice"]),
        ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["ofl_notice"]),
        ("Part of the LLVM Project, under the Apache License v2.0 with LLVM Exceptions.", ["llvm_header"]),
        (header("gpl3", "either version 3 of the License, or (at your option) any earlier version", ","), []),
        ("Licensed under the MIT Licence of some one else.", []),
        (MIT.replace("furnished to do so, subject to the following conditions:", "furnished to do so."), ["mit0_text"]),
        (". ".join(licenses.SENTENCES[k] for k in ("bsd_permit", "bsd_source", "bsd_binary", "bsd_advert", "bsd_name")), ["bsd4_text"]),
        ("words " * 60_000 + ".\n\n" + gpl2, ["gpl2_later"]),
    ]
    return texts


def test_only_and_later_exceptions_and_dual_licences(spark):
    texts = rich()
    assert found(spark, [t for t, _ in texts]) == [(i, rule) for i, (_, rules) in enumerate(texts) for rule in rules]


SENTENCES = licenses.SENTENCES | {licenses.OTHER: "a clause that nobody knows", licenses.AS_IS: licenses.AS_IS_BEGINS + "the authors as is"}


def test_every_rule_is_met_by_its_own_sentences_and_by_none_that_lacks_one(spark):
    joined = [". ".join(SENTENCES[i].replace("spdx license identifier", "spdx-license-identifier:").replace("under cc", "licensed under cc") for i in ids) + "." for _, _, ids in licenses.RULES]
    got = found(spark, joined)
    assert [i for i, (rule, spdx, _) in enumerate(licenses.RULES) if ((i, rule) in got) != bool(spdx)] == []
    without = [(rule, ". ".join(SENTENCES[i] for i in ids[:k] + ids[k + 1 :])) for rule, _, ids in licenses.RULES for k in range(len(ids)) if len(ids) > 1]
    got = found(spark, [t for _, t in without])
    assert [without[i] for i, rule in got if without[i][0] == rule] == []


BSD = """Copyright (c) 2009 Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{clause}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
NAMED = "   * Neither the name of {} nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
COMMENTS = {"plain": "{}", "hash": "# {}", "slashes": "// {}", "star": " * {}", "dnl": "dnl {}", "semicolons": ";; {}", "dashes": "-- {}"}


def commented(text, form):
    return "\n".join(COMMENTS[form].format(line).rstrip() for line in text.split("\n"))


def clauses():
    texts = [(BSD.format(clause=""), ["bsd2_text"])]
    texts += [(BSD.format(clause=NAMED.format(name)), ["bsd3_text"]) for name in ("Google Inc.", "the copyright holder", "the University", "Foo, Bar & Sons Ltd.", "the\nvery long named Organisation of St. Somewhere")]
    texts += [(BSD.format(clause=f"   * {clause}\n"), []) for clause in ("The name of the author may not be used to endorse products.", "This code may only be used for good.")]
    texts += [(BSD.format(clause=NAMED.format("Google Inc.") + "   * No part of it may be used in a nuclear plant.\n"), [])]
    texts += [(MIT, ["mit_text"]), (MIT.replace("THE SOFTWARE IS", "The Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS"), [])]
    return [(commented(t, form), rules) for t, rules in texts for form in COMMENTS]


def test_named_and_unknown_clauses_and_comment_marks(spark):
    texts = clauses()
    assert found(spark, [t for t, _ in texts]) == [(i, rule) for i, (_, rules) in enumerate(texts) for rule in rules]


INSTALLED = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": None, "GFDL-1.3": None, "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only",
    "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def test_installed_texts_give_their_own_name_or_none(spark):
    folder = Path("/usr/share/common-licenses")
    texts = [(commented((folder / name).read_text(errors="replace"), form), spdx) for name, spdx in INSTALLED.items() if (folder / name).exists() for form in COMMENTS]
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {i: {spdx} for i, (_, spdx) in enumerate(texts) if spdx}


def test_headers_behind_comment_marks(spark):
    texts = [(commented(t, form), rules) for t, rules in rich()[:15] for form in COMMENTS]
    assert found(spark, [t for t, _ in texts]) == [(i, rule) for i, (_, rules) in enumerate(texts) for rule in rules]


def test_rows_are_those_of_the_statement(spark):
    wrap = lambda text, width: "\n\n".join(textwrap.fill(p, width, break_long_words=False) for p in text.split("\n\n"))
    texts = [t for t, _ in rich()] + [wrap(t, w) for t, _ in rich()[:-1] for w in (23, 61)] + [t for t, _ in clauses()] + [MIT, wrap(MIT, 33).replace("\n", "\r\n"), "", None, "..licensed under the MIT license..."]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(licenses.oracle()).fetchall())
    got = sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == want and len(got) > 60


def test_anchors_are_in_all_rules():
    assert all(any(a in SENTENCES[i] for a in licenses.ANCHORS for i in ids) or any(re.search(licenses.CC, SENTENCES[i]) for i in ids) for _, _, ids in licenses.RULES)
    assert len({spdx for _, spdx, _ in licenses.RULES}) >= 40
    assert all(i in SENTENCES for _, _, ids in licenses.RULES for i in ids)


def test_awkward_rows(spark):
    assert licenses.scan(cases.table(spark)).count() == 0 and licenses.scan(cases.empty(spark)).count() == 0


def test_plan_has_no_shuffle_or_python(spark):
    plan = licenses.scan(cases.table(spark).coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Aggregate" not in plan
