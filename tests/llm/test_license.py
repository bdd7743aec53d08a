import re

from helpers import awkward, empty

from factloom.llm import license_scan as ls


KNOWN = {s: k for k, v in ls.SENTENCES.items() for s in v}


def slow(text):
    """By plain loops over words: no pattern but those of the rules."""
    low = text.lower().replace("|", " ").replace("~", " ")
    words, lines = [], low.split("\n")
    for k, line in enumerate(lines):
        if k:
            words.append("~" if k < len(lines) and not line.strip(" \t\r\f\x0b*#/;-") and k < len(lines) - 1 else "|")
        tokens, word = [], ""
        for c, nxt in zip(line, line[1:] + "\n"):
            if c.isascii() and c.isalnum():
                word += c
                continue
            if word:
                tokens.append(word)
            word = ""
            if c in ".!?;:" and nxt in " \t\r\f\x0b\n":
                tokens.append(c)
        tokens += [word] if word else []
        words += tokens
    return words


def known_id(sentence):
    for pattern, to in [("", ""), *ls.SLOTS]:
        x = re.sub(pattern, to.replace("$1", r"\1"), sentence) if pattern else sentence
        if x in KNOWN:
            return KNOWN[x]
    return "?"


def segments(text):
    out, now = [], []
    for w in slow(text):
        if w in ("|", "~") or not w.isalnum():
            out.append(" ".join(now))
            now = []
        else:
            now.append(w)
    return [x for x in [*out, " ".join(now)] if x]


def licenses(ids):
    seq, at, found = "".join(f"<{i}>" for i in ids), 0, []
    while at < len(seq):
        for name, p in ls.RULES:
            if m := re.compile(p).match(seq, at):
                found.append(name)
                at = m.end()
                break
        else:
            at = seq.index(">", at) + 1
    return found


def test_rules_are_ordered_and_complete(spark):
    s = ls.SENTENCES
    texts = [
        "Released under the MIT License.\nCode.", "MIT License\n" + s["MIT_GRANT"][0] + "\nother words\n" + s["ASIS"][0], "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nLicensed under CC BY-NC 4.0.",
        "the MIT license is nice", "", s["GPL3_FREE"][0], s["GPL3_TITLE"][0] + "!\n" + s["GPL3_FREE"][0], "Licensed   under -- CC BY 4.0;\tReleased under the MIT License",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ls.scan_licenses(df).collect():
        ids = [known_id(x) for x in segments(texts[r.doc_id])]
        known = [i for i in ids if i != "?"]
        assert (r.sentence_ids, r.licenses) == (",".join(known), ",".join(licenses(ids)) if known else ""), texts[r.doc_id]
    assert licenses(["MIT_TITLE"]) == ["MIT"] and licenses(["MIT_TITLE", "?", "MIT_GRANT"]) == ["MIT"]


def test_every_sentence_is_found_and_named(spark):
    rows = [(k, i, s) for k, (i, s) in enumerate((i, s) for i, v in ls.SENTENCES.items() for s in v)]
    df = spark.createDataFrame([(k, "Words before.\n" + s.upper().replace("*", "MY OWN LIBRARY") + ".\nWords after.") for k, _, s in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan_licenses(df).collect()}
    assert all(got[k].sentence_ids == i for k, i, _ in rows)
    assert {i for k, i, _ in rows if not got[k].n_licenses} == {"MIT_NOTICE", "ASIS", "MIT_LIABILITY", "APACHE2_USE", "APACHE2_COPY", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"}


def test_a_long_gap_parts_two_licenses(spark):
    filler = lambda n: "".join(f"line {k} of other words\n" for k in range(n))
    grant = ls.SENTENCES["MIT_GRANT"][0]
    texts = [f"MIT License\n{filler(3)}{grant}\n", f"MIT License\n{filler(500)}{grant}\n", f"Licensed under CC BY 4.0\n{filler(500)}Licensed under CC BY 4.0\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in ls.scan_licenses(df).collect()} == {0: "MIT", 1: "MIT,MIT", 2: "CC-BY-4.0,CC-BY-4.0"}


def test_whole_licenses_wrapped_at_72(spark):
    import textwrap

    s = ls.SENTENCES
    wrap = lambda *parts: "\n\n".join(textwrap.fill(p, 72) for p in parts)
    mit = wrap("MIT License", "Copyright (c) 2020 Someone", s["MIT_GRANT"][0] + ":", s["MIT_NOTICE"][0] + ".", s["ASIS"][0].upper() + ". " + s["MIT_LIABILITY"][0].upper() + ".")
    bsd2 = wrap("Copyright (c) 2020, Someone. All rights reserved.", s["BSD_REDIST"][0] + ":", "1. " + s["BSD_SOURCE"][0] + ".", "2. " + s["BSD_BINARY"][0] + ".")
    bsd3 = bsd2 + "\n\n" + wrap("3. " + s["BSD_NAMES"][0] + ".")
    isc = wrap("ISC License", "Copyright (c) 2020 Someone", s["ISC_GRANT"][0] + ".")
    rows = [(mit, "MIT"), (bsd2, "BSD-2-Clause"), (bsd3, "BSD-3-Clause"), (isc, "ISC"), *[(wrap(s[f"{k}_FREE"][0] + "."), n) for k, n in (("GPL2", "GPL-2.0"), ("GPL3", "GPL-3.0"), ("LGPL21", "LGPL-2.1"), ("LGPL3", "LGPL-3.0"), ("AGPL3", "AGPL-3.0"))]]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in ls.scan_licenses(df).collect():
        assert r.licenses == rows[r.doc_id][1], rows[r.doc_id][0]


def test_every_known_sentence_has_a_hint():
    assert all(any(h in s.replace("*", "x") for h in ls.HINTS) for v in ls.SENTENCES.values() for s in v)


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = ls.scan_licenses(docs)
    assert out.count() == docs.count() and {r.n_licenses for r in out.collect()} == {0}
    assert ls.scan_licenses(empty(spark)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Someone

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Copyright (c) 2020, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed."""


def test_wrapped_notices(spark):
    want = [
        (MIT, "MIT_TITLE,MIT_GRANT,MIT_NOTICE,ASIS", "MIT"), (BSD, "BSD_REDIST", "BSD"), (GPL, "GPL3_FREE", "GPL-3.0"), (GPL.replace("software: ", "software; "), "GPL3_FREE", "GPL-3.0"),
        (MPL, "MPL2_TITLE", "MPL-2.0"), (APACHE, "APACHE2_TITLE,APACHE2_USE,APACHE2_COPY", "Apache-2.0"),
        ("MIT\n\nLicense", "", ""), ("The MIT. License", "", ""), ("MIT License\nCC0 1.0\nLicensed under CC0 1.0\n\nMIT License", "MIT_TITLE,CC0_TITLE,MIT_TITLE", "MIT,CC0-1.0,MIT"),
    ]
    want += [("\n".join(mark + x for x in t.split("\n")), i, n) for t, i, n in want[:6] for mark in (" * ", "# ", "// ")] + [(t.replace("\n", "\r\n"), i, n) for t, i, n in want[:6]]
    df = spark.createDataFrame([(k, w[0]) for k, w in enumerate(want)], "doc_id long, text string")
    for r in ls.scan_licenses(df).collect():
        assert (r.sentence_ids, r.licenses) == want[r.doc_id][1:], want[r.doc_id][0]


def test_whole_texts_tags_names_and_further_licenses(spark):
    head = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"
    gpl3 = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Someone\n"
    foo = "Foo is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. " + ls.SENTENCES["BSD_SOURCE"][0] + ".\n2. " + ls.SENTENCES["BSD_BINARY"][0] + ".\n3. Neither the name of\nthe Institute of Many Things nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    want = [
        (head, "Apache-2.0"), (gpl3, "GPL-3.0"), ("// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */\n", "GPL-2.0-or-later"), (foo, "GPL-3.0"), (bsd, "BSD-3-Clause"),
        ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n", "EPL-2.0"),
        ("MIT No Attribution\n\nCopyright 2020 Someone\n\n" + ls.SENTENCES["MIT0_GRANT"][0] + ".\n", "MIT-0"), ("The Artistic License 2.0\n", "Artistic-2.0"), ("Microsoft Public License (Ms-PL)\n", "MS-PL"),
        ("SPDX-License-Identifier: Nobody-1.0\n", ""), ("a license is free software you can redistribute\n", ""),
    ]
    df = spark.createDataFrame([(k, w[0]) for k, w in enumerate(want)], "doc_id long, text string")
    for r in ls.scan_licenses(df).collect():
        assert r.licenses == want[r.doc_id][1], want[r.doc_id][0]
