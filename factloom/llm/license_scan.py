"""License scans by sentence rules, in DataFrame functions only.

A text is cut into segments at line ends and after . ! ? ; : before white space. Known license sentences are looked for from the
beginning of a segment to the end of one; breaks that a sentence has of its own (wrapped lines, a semicolon or colon
inside) don't end it, blank lines and sentence ends do. A segment that begins no known sentence is an unknown one. The identifiers
of all of them, in order, form a sequence; ordered license rules (patterns over identifiers) are matched against it, the first
rule that matches at a place winning. Between the parts of a license a rule lets a few unknown segments stand (a copyright line,
an item of a list); a longer gap ends the match. One pass over a row, no shuffle; the tables are a few kB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import text_or_empty

#: Fixed values. identifier -> normalised sentences (lower case, runs of other characters than letters and digits as one space).
SENTENCES = {
    "MIT_TITLE": ["released under the mit license", "licensed under the mit license", "mit license", "the mit license", "the mit license mit"],
    "MIT_GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT_NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "ASIS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MIT_LIABILITY": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "APACHE2_TITLE": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "apache license version 2 0", "released under the apache license version 2 0"],
    "APACHE2_USE": ["you may not use this file except in compliance with the license"],
    "APACHE2_COPY": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "GPL3_TITLE": ["this work is licensed under the gnu general public license version 3", "gnu general public license version 3"],
    "GPL2_TITLE": ["this work is licensed under the gnu general public license version 2", "gnu general public license version 2"],
    "LGPL3_TITLE": ["gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "LGPL21_TITLE": ["gnu lesser general public license version 2 1", "this work is licensed under the gnu lesser general public license version 2 1"],
    "AGPL3_TITLE": ["gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "CC0_TITLE": ["licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "BSD_REDIST": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD_SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD_BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD_NAMES": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "BSD2_TITLE": ["bsd 2 clause license", "licensed under the bsd 2 clause license"],
    "BSD3_TITLE": ["bsd 3 clause license", "licensed under the bsd 3 clause license"],
    "ISC_TITLE": ["isc license", "licensed under the isc license"],
    "ISC_GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "MPL2_TITLE": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0"],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "BSL1_TITLE": ["boost software license version 1 0"],
    "ZLIB_GRANT": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
}
# notices of the GNU licenses: identifier -> the license's name and its version
GNU = {"GPL2": ("general", "2"), "GPL3": ("general", "3"), "LGPL21": ("lesser general", "2 1"), "LGPL3": ("lesser general", "3"), "AGPL3": ("affero general", "3")}
SENTENCES |= {
    f"{k}_FREE": [
        f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation {either}version {v} of the license{later}"
        for what in ("program", "library", "software") for either, later in (("either ", " or at your option any later version"), ("", ""))
    ]
    for k, (name, v) in GNU.items()
}
# Creative Commons: the parts of a license's name by its code
CC_PARTS = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
CC_CODES = ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd")
SENTENCES |= {
    f"CC_{code.replace(' ', '_').upper()}_{v[0]}": [
        f"licensed under cc {code} {v}",
        f"this work is licensed under a creative commons {' '.join(CC_PARTS[c] for c in code.split())} {v} {'international' if v[0] == '4' else 'unported'} license",
    ]
    for code in CC_CODES for v in ("4 0", "3 0")
}
# titles of whole texts, short notices and grants of further licenses
SENTENCES["APACHE2_TITLE"] += ["apache license version 2 0 january 2004"]
SENTENCES["BSL1_TITLE"] += ["boost software license version 1 0 august 17th 2003", "distributed under the boost software license version 1 0"]
SENTENCES |= {
    "GPL3_HEAD": ["gnu general public license version 3 29 june 2007"], "GPL2_HEAD": ["gnu general public license version 2 june 1991"], "LGPL3_HEAD": ["gnu lesser general public license version 3 29 june 2007"],
    "LGPL21_HEAD": ["gnu lesser general public license version 2 1 february 1999"], "AGPL3_HEAD": ["gnu affero general public license version 3 19 november 2007"],
    "MIT0_TITLE": ["mit no attribution", "mit no attribution license", "licensed under the mit 0 license"],
    "MIT0_GRANT": [SENTENCES["MIT_GRANT"][0].removesuffix(" subject to the following conditions")],
    "ZERO_BSD_GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "EPL2_TITLE": ["eclipse public license v 2 0", "eclipse public license version 2 0", "licensed under the eclipse public license 2 0"],
    "EPL2_NOTICE": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution",
    ],
    "ARTISTIC2_TITLE": ["the artistic license 2 0", "artistic license 2 0", "licensed under the artistic license 2 0"],
    "MSPL_TITLE": ["microsoft public license ms pl", "licensed under the microsoft public license ms pl", "microsoft public license"],
    "WTFPL_TITLE": ["do what the fuck you want to public license"],
    "POSTGRES_GRANT": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
}
# a name in the middle: `*` stands for one to SLOT words
SENTENCES |= {f"{k}_FREE": [*SENTENCES[f"{k}_FREE"], *(x.replace("this program", "*", 1) for x in SENTENCES[f"{k}_FREE"] if x.startswith("this program"))] for k in GNU}
SENTENCES["BSD_NAMES"] += [
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission",
]
#: Most words that a name may have.
SLOT = 8
#: Names that a tag line `SPDX-License-Identifier: ..` may have.
TAGGED = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "Artistic-2.0", "MS-PL", "WTFPL", "PostgreSQL",
    *(f"CC-{c.replace(' ', '-').upper()}-{v}" for c in CC_CODES for v in ("4.0", "3.0")),
)
SENTENCES |= {"TAG_" + "".join(c if c.isalnum() else "_" for c in n.upper()): ["spdx license identifier " + " ".join("".join(c if c.isalnum() else " " for c in n.lower()).split())] for n in TAGGED}
#: Every known sentence holds one of these.
HINTS = ("licen", "permission", "copyright", "redistribution", "software", "disclaimer", "claim", "mit no attribution")
#: Unknown segments that may stand between two parts of a license.
GAP = r"(?:<\?>){0,5}"


def _parts(*parts: str) -> str:
    """Parts in their order, each after the first optional."""
    return f"<{parts[0]}>" + "".join(f"(?:{GAP}<{p}>)?" for p in parts[1:])


_GRANT = _parts("MIT_GRANT", "MIT_NOTICE", "ASIS", "MIT_LIABILITY")
_BSD = f"<BSD_REDIST>{GAP}<BSD_SOURCE>{GAP}<BSD_BINARY>"
#: (license, pattern over identifiers each written as "<ID>"); earlier rules win.
RULES = [
    *[(n, f"<TAG_{''.join(c if c.isalnum() else '_' for c in n.upper())}>") for n in TAGGED],
    ("MIT-0", f"(?:<MIT0_TITLE>{GAP})?<MIT0_GRANT>(?:{GAP}<ASIS>)?(?:{GAP}<MIT_LIABILITY>)?|<MIT0_TITLE>"),
    ("MIT", f"(?:<MIT_TITLE>{GAP})?{_GRANT}"),
    ("MIT", r"<MIT_TITLE>"),
    ("Apache-2.0", _parts("APACHE2_TITLE", "APACHE2_USE", "APACHE2_COPY")),
    ("BSD-3-Clause", f"(?:<BSD3_TITLE>{GAP})?{_BSD}{GAP}<BSD_NAMES>"),
    ("BSD-2-Clause", f"(?:<BSD2_TITLE>{GAP})?{_BSD}"),
    ("BSD-3-Clause", r"<BSD3_TITLE>"),
    ("BSD-2-Clause", r"<BSD2_TITLE>"),
    ("BSD", r"<BSD_REDIST>"),
    ("ISC", f"(?:<ISC_TITLE>{GAP})?<ISC_GRANT>|<ISC_TITLE>"),
    *[(f"{k.rstrip('0123456789')}-{v.replace(' ', '.')}{'.0' if ' ' not in v else ''}", f"<{k}_TITLE>(?:{GAP}<{k}_FREE>)?|<{k}_FREE>|<{k}_HEAD>") for k, (_, v) in GNU.items()],
    *[(f"CC-{code.replace(' ', '-').upper()}-{v}.0", f"<CC_{code.replace(' ', '_').upper()}_{v}>") for code in CC_CODES for v in "43"],
    ("CC0-1.0", r"<CC0_TITLE>"),
    ("MPL-2.0", r"<MPL2_TITLE>"),
    ("Unlicense", r"<UNLICENSE>"),
    ("BSL-1.0", r"<BSL1_TITLE>"),
    ("Zlib", r"<ZLIB_GRANT>"),
    ("0BSD", r"<ZERO_BSD_GRANT>"),
    ("EPL-2.0", f"<EPL2_TITLE>(?:{GAP}<EPL2_NOTICE>)?|<EPL2_NOTICE>"),
    ("Artistic-2.0", r"<ARTISTIC2_TITLE>"),
    ("MS-PL", r"<MSPL_TITLE>"),
    ("WTFPL", r"<WTFPL_TITLE>"),
    ("PostgreSQL", r"<POSTGRES_GRANT>"),
]
#: A sentence begins and ends at a line feed, or at . ! ? ; : followed by white space. Runs over the whole text.
BREAK = r"\n|[.!?;:]+[ \t\r\f\x0B]"
#: Breaks that no sentence runs across: blank lines (bare comment marks count as blank), and . ! ? followed by white space.
HARD = r"\n[ \t\r\f\x0B*#/;-]*(?=\n)|[.!?][.!?;:]*\s"
#: Words between which a known sentence may even have a hard break: "v. 2.0", and a URL in a paragraph of its own.
ACROSS = {("v", "2"), ("at", "http")}


def normalise(sentence: Column) -> Column:
    """Lower case; everything but ASCII letters and digits becomes single spaces; trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _pattern(sentence: str) -> str:
    """A known sentence in a text whose breaks are written as words of their own."""
    words = sentence.split()
    word = lambda w: rf"[a-z0-9]+(?:(?: [|])* [a-z0-9]+){{0,{SLOT - 1}}}?" if w == "*" else w
    return word(words[0]) + "".join(("(?: [|~]+)* " if pair in ACROSS else "(?: [|])* ") + word(pair[1]) for pair in zip(words, words[1:], strict=False))


#: Sentences with a slot, as patterns over normalised text: what stands for the slot is replaced by `*`, so that such a sentence is looked up
#: as any other.
_NAME = rf"[a-z0-9]+(?: [a-z0-9]+){{0,{SLOT - 1}}}?"
SLOTS = [
    (rf"^{_NAME} (is free software you can redistribute it and or modify it under the terms of .*)$", r"* $1"),
    (rf"^neither the name of {_NAME} (nor the names of its contributors may be used .*)$", r"neither the name of * $1"),
    (rf"^the names of {_NAME} (may not be used to endorse .*)$", r"the names of * $1"),
]


def named(sentence: Column, lookup: Column) -> Column:
    """The identifier of a normalised sentence: as it is, else with a name replaced by `*`; null if it isn't known."""
    slotted = sentence
    for pattern, to in SLOTS:
        slotted = F.regexp_replace(slotted, pattern, to)
    return F.coalesce(F.try_element_at(lookup, sentence), F.try_element_at(lookup, slotted))


def sentence_ids(text: Column, sentences: dict[str, list[str]] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order, and `?` for each unknown segment. A text without any known sentence
    has none of either."""
    known = [(s, k) for k, v in (sentences or SENTENCES).items() for s in v]
    lookup = F.create_map(*[F.lit(x) for pair in known for x in pair])
    # in lower case, breaks as words: ~ ends every sentence, | may stand inside one; these two characters of the text go first
    marked = F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), "|~", "  "), HARD, " ~\n"), BREAK, " | ")
    marked = F.regexp_replace(F.concat(F.lit("| "), marked, F.lit(" |")), "[^a-z0-9|~]+", " ")
    whole = "|".join(_pattern(s) for s, _ in sorted(known, key=lambda x: -len(x[0])))
    found = F.regexp_extract_all(marked, F.lit(rf"(?<=[|~] )((?:{whole})(?= [|~])|[a-z0-9][^|~]*+)"), 1)
    ids = F.transform(found, lambda s: F.coalesce(named(normalise(s), lookup), F.lit("?")))
    # a text without any of these holds no known sentence and is left out before the costly part
    ids = F.when(text.rlike("(?i)" + "|".join(HINTS)), ids).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(ids), lambda x: F.when(F.exists(x, lambda i: i != "?"), x).otherwise(F.array().cast("array<string>")))[0]


def match_rules(sequence: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Licenses of a "<ID><ID>" sequence in order of place; at one place the earliest rule wins; matches don't overlap."""
    rules = rules or RULES
    whole = "|".join(f"(?:{p})" for _, p in rules)
    found = F.regexp_extract_all(sequence, F.lit(f"({whole})"), 1)
    name = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), F.lit(n)) for n, p in rules])
    return F.transform(found, name)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, sentence_ids (string), licenses (comma-joined, in order), n_licenses, license_set.

    Null and empty texts have no licenses (empty strings); very long texts are read whole; an empty table gives an empty one.
    Repeated rows give repeated results; extra columns are ignored; a null id is carried. sentence_ids has the known sentences only;
    license_set has the distinct names, sorted. Of two rules that match at one place the earlier wins.
    """
    ids = docs.select(F.col(id_col).alias("id"), sentence_ids(text_or_empty(text_col)).alias("ids"))
    # of a gap only its first segments can matter
    gap = GAP[GAP.index("0,") + 2 : -1]
    seq = F.regexp_replace(F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">")))), rf"(?:<\?>){{{int(gap) + 1},}}", "<?>" * (int(gap) + 1))
    out = ids.select("id", F.array_join(F.filter("ids", lambda x: x != "?"), ",").alias("sentence_ids"), match_rules(seq).alias("found"))
    return out.select(
        F.col("id").alias(id_col), "sentence_ids", F.array_join("found", ",").alias("licenses"),
        F.size("found").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("license_set"),
    )
