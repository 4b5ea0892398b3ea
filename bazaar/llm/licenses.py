"""License notices in texts, in DataFrame functions only: ordered signature rules behind a keyword prefilter.

A text is reduced to its words (A-Z lower-cased, see WORDS), each written with a space on both sides, so a rule is a
regular expression over whole words, and what it finds begins and ends at words.

Rules are in four levels, the stronger first: texts of licenses, tags and addresses, grants ("licensed under ..."), and
mere names. A rule is tried only on texts that have all its keywords, which one search of each text finds. What a rule
finds is an interval of words. It is suppressed where an interval of the same or a stronger level holds it: another
one, or an equal one of an earlier rule. What overlaps otherwise stays.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import free

TEXT, TAG, GRANT, NAME = range(4)
#: How sure a level is that the license applies.
CONFIDENCE = [1.0, 0.95, 0.9, 0.6]
#: Words of a lower-cased text: maximal runs of what isn't in here.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of a text as it is.
_NO_WORD, _WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# Rules are written word by word: "a|b" one of both, "a?" may be absent, "~3" up to three words of any kind.
# [label, keywords, names]: the first name is what tags say. Names become a tag, a grant and a mention each.
NAMED = [
    ["mit", "mit", ["mit", "mit licen[sc]e|licen[sc]ed|licensing", "mit style|type licen[sc]e", "mit x11 licen[sc]e", "expat licen[sc]e"]],
    ["mit-0", "mit attribution", ["mit 0", "mit no attribution licen[sc]e?"]],
    ["x11", "x11", ["x11", "x11 licen[sc]e"]],
    ["apache-1.0", "apache", ["apache 1 0", "apache software? licen[sc]e v|version? 1 0"]],
    ["apache-1.1", "apache", ["apache 1 1", "apache software? licen[sc]e v|version? 1 1"]],
    ["apache-2.0", "apache", ["apache 2 0", "apache software? licen[sc]e v|version? 2 0?", "apache software? licen[sc]e v2", "apache v2 licen[sc]e"]],
    ["bsd", "bsd", ["bsd", "bsd style|type? licen[sc]e"]],
    ["bsd-2-clause", "bsd", ["bsd 2 clause", "2|two clause bsd", "simplified bsd", "freebsd licen[sc]e"]],
    ["bsd-3-clause", "bsd", ["bsd 3 clause", "3|three clause bsd", "new|modified|revised bsd"]],
    ["bsd-4-clause", "bsd", ["bsd 4 clause", "4|four clause bsd", "original bsd"]],
    ["0bsd", "0bsd", ["0bsd", "0bsd licen[sc]e"]],
    ["bsd-0-clause", "bsd", ["bsd 0 clause", "0|zero clause bsd"]],
    ["isc", "isc", ["isc", "isc licen[sc]e"]],
    ["zlib", "zlib", ["zlib", "zlib libpng? licen[sc]e"]],
    ["libpng", "libpng", ["libpng 2?", "libpng licen[sc]e"]],
    ["bsl-1.0", "boost", ["bsl 1 0", "boost software? licen[sc]e v|version? 1? 0?"]],
    ["unlicense", "unlicense", ["unlicense", "the unlicense"]],
    ["wtfpl", "wtfpl", ["wtfpl", "wtfpl v|version? 2?"]],
    ["beerware", "beerware", ["beerware", "beerware licen[sc]e"]],
    ["python", "python", ["python 2 0", "python software foundation licen[sc]e", "python licen[sc]e"]],
    ["psf-2.0", "psf", ["psf 2 0", "psf licen[sc]e v|version? 2?"]],
    ["php-3.01", "php", ["php 3 01", "php licen[sc]e v|version? 3? 0|01?"]],
    ["ruby", "ruby", ["ruby", "ruby licen[sc]e"]],
    ["vim", "vim", ["vim", "vim licen[sc]e"]],
    ["openssl", "openssl", ["openssl", "openssl licen[sc]e"]],
    ["curl", "curl", ["curl", "curl licen[sc]e"]],
    ["postgresql", "postgresql", ["postgresql", "postgresql licen[sc]e"]],
    ["ncsa", "ncsa", ["ncsa", "university of illinois ncsa open source licen[sc]e", "ncsa open source licen[sc]e"]],
    ["artistic-1.0", "artistic", ["artistic 1 0", "artistic licen[sc]e v|version? 1 0"]],
    ["artistic-2.0", "artistic", ["artistic 2 0", "artistic licen[sc]e v|version? 2 0"]],
    ["artistic", "artistic", ["artistic", "perl? artistic licen[sc]e"]],
    ["mpl-1.0", "mozilla", ["mpl 1 0", "mozilla public licen[sc]e v|version? 1 0"]],
    ["mpl-1.1", "mozilla", ["mpl 1 1", "mozilla public licen[sc]e v|version? 1 1"]],
    ["mpl-2.0", "mozilla", ["mpl 2 0", "mozilla public licen[sc]e v|version? 2 0?"]],
    ["epl-1.0", "eclipse", ["epl 1 0", "eclipse public licen[sc]e v|version? 1 0"]],
    ["epl-2.0", "eclipse", ["epl 2 0", "eclipse public licen[sc]e v|version? 2 0"]],
    ["cpl-1.0", "common", ["cpl 1 0", "common public licen[sc]e v|version? 1? 0?"]],
    ["cddl-1.0", "cddl", ["cddl 1 0", "cddl v|version? 1? 0?"]],
    ["cddl-1.1", "cddl", ["cddl 1 1", "cddl v|version? 1 1"]],
    ["eupl-1.1", "eupl", ["eupl 1 1", "eupl v|version? 1 1"]],
    ["eupl-1.2", "eupl", ["eupl 1 2", "eupl v|version? 1 2"]],
    ["ms-pl", "microsoft", ["ms pl", "microsoft public licen[sc]e"]],
    ["ms-rl", "microsoft", ["ms rl", "microsoft reciprocal licen[sc]e"]],
    ["afl-3.0", "academic", ["afl 3 0", "academic free licen[sc]e v|version? 3? 0?"]],
    ["osl-3.0", "open", ["osl 3 0", "open software licen[sc]e v|version? 3? 0?"]],
    ["ecl-2.0", "educational", ["ecl 2 0", "educational community licen[sc]e v|version? 2? 0?"]],
    ["cecill-2.1", "cecill", ["cecill 2 1", "cecill v|version? 2? 1?"]],
    ["cecill-b", "cecill", ["cecill b"]],
    ["cecill-c", "cecill", ["cecill c"]],
    ["upl-1.0", "universal", ["upl 1 0", "universal permissive licen[sc]e v|version? 1? 0?"]],
    ["mulanpsl-2.0", "mulan", ["mulanpsl 2 0", "mulan permissive software licen[sc]e v|v2|version? 2?"]],
    ["ofl-1.0", "sil", ["ofl 1 0", "sil open font licen[sc]e v|version? 1 0"]],
    ["ofl-1.1", "sil", ["ofl 1 1", "sil open font licen[sc]e v|version? 1? 1?"]],
    ["odbl-1.0", "database", ["odbl 1 0", "open database licen[sc]e odbl? v|version? 1? 0?"]],
    ["odc-by-1.0", "attribution", ["odc by 1 0", "open data commons attribution licen[sc]e"]],
    ["pddl-1.0", "domain", ["pddl 1 0", "public domain dedication and licen[sc]e"]],
    ["cc0-1.0", "cc0", ["cc0 1 0", "cc0 1? 0? universal?", "creative commons zero|cc0 v|v1|version? 1? 0?"]],
    ["sspl-1.0", "server", ["sspl 1 0", "server side public licen[sc]e v|version? 1?"]],
    ["busl-1.1", "business", ["busl 1 1", "business source licen[sc]e v|version? 1? 1?"]],
    ["elastic-2.0", "elastic", ["elastic 2 0", "elastic licen[sc]e v|version? 2? 0?"]],
    ["openrail-m", "openrail", ["openrail m?", "creativeml? bigscience? openrail m? licen[sc]e"]],
    ["llama-community", "llama", ["llama 2|3|4?", "llama 2|3|4? community licen[sc]e agreement?"]],
    ["proprietary", "proprietary", ["licenseref proprietary", "proprietary licen[sc]e", "proprietary and confidential"]],
    ["commercial", "commercial", ["licenseref commercial", "commercial licen[sc]e agreement?"]],
]
#: [label, keywords, rule]: sentences of the licenses and of the notices that their authors ask for.
TEXTS = [
    ["mit", "permission sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software ~40 sublicense"],
    ["mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    ["mit", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    ["x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used"],
    ["isc", "permission", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"],
    ["curl", "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided"],
    ["postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee"],
    ["bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"],
    ["bsd", "redistributions", "redistributions of source code must retain the above copyright notice"],
    ["bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"],
    ["bsd-3-clause", "endorse", "neither the names? of ~12 nor the names of its|their contributors may be used to endorse or promote products"],
    ["bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"],
    ["bsd", "contributors", "this software is provided by the ~8 contributors as is and any express or implied warranties"],
    ["apache-2.0", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    ["apache-2.0", "compliance", "you may not use this file except in compliance with the license"],
    ["apache-2.0", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"],
    ["apache-2.0", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    ["apache-1.1", "apache", "this product includes software developed by the apache software foundation"],
    ["zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    ["zlib", "event", "in no event will the authors be held liable for any damages arising from the use of this software"],
    ["bsl-1.0", "boost", "distributed under the boost software license version 1 0"],
    ["bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"],
    ["unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"],
    ["unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"],
    ["wtfpl", "want", "you just do what the fuck you want to"],
    ["beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"],
    ["gpl", "redistribute", "this program|library|file|software is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    ["gpl", "option", "gnu general public license as published by the free software foundation either version ~2 of the license or at your option any later version"],
    ["gpl-2.0", "option", "gnu general public license as published by the free software foundation either version 2 of the license"],
    ["gpl-3.0", "option", "gnu general public license as published by the free software foundation either version 3 of the license"],
    ["gpl-2.0", "general", "gnu general public license version 2 june 1991"],
    ["gpl-3.0", "general", "gnu general public license version 3 29 june 2007"],
    ["gpl", "warranty", "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"],
    ["gpl", "received", "you should have received a copy of the gnu general public license along with this program|library|file|software"],
    ["lgpl", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation"],
    ["lgpl-2.1", "lesser", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"],
    ["lgpl-3.0", "lesser", "gnu lesser general public license as published by the free software foundation either version 3 of the license"],
    ["lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this"],
    ["lgpl-2.0", "library", "under the terms of the gnu library general public license as published by the free software foundation"],
    ["agpl", "affero", "under the terms of the gnu affero general public license as published by the free software foundation"],
    ["agpl-3.0", "affero", "gnu affero general public license as published by the free software foundation either version 3 of the license"],
    ["agpl", "affero", "you should have received a copy of the gnu affero general public license along with this"],
    ["gfdl", "invariant", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"],
    ["gfdl-1.1", "invariant", "gnu free documentation license version 1 1 or any later version"],
    ["gfdl-1.2", "invariant", "gnu free documentation license version 1 2 or any later version"],
    ["gfdl-1.3", "invariant", "gnu free documentation license version 1 3 or any later version"],
    ["mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v|version 2 0"],
    ["mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"],
    ["epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v|version? 1 0"],
    ["epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v|version? 2 0"],
    ["cddl-1.0", "development", "common development and distribution license v|version? 1? 0?"],
    ["eupl-1.2", "union", "european union public licen[sc]e v|version? 1? 2?"],
    ["ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"],
    ["cc0-1.0", "waived", "to the extent possible under law ~12 has|have waived all copyright and related or neighboring rights"],
    ["cc-by", "unported", "licensed under a creative commons attribution ~4 unported license"],
    ["cc-by-4.0", "international", "licensed under a creative commons attribution 4 0 international license"],
    ["cc-by-sa-4.0", "international", "licensed under a creative commons attribution sharealike 4 0 international license"],
    ["cc-by-nc-4.0", "international", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    ["cc-by-nc-sa-4.0", "international", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    ["cc-by-sa-3.0", "sharealike", "text is available under the creative commons attribution sharealike license"],
    ["python", "psf", "psf is making python available to licensee on an as is basis"],
    ["ncsa", "illinois", "the names of ~12 university of illinois ~8 may be used to endorse or promote products"],
    ["openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"],
    ["vim", "vim", "there are no restrictions on distributing unmodified copies of vim"],
    ["public-domain", "domain", "this work|file|software|document|code is|was? in|placed|released|dedicated in|into|to? the public domain"],
    ["public-domain", "domain", "no copyright is claimed ~6 public domain"],
    ["public-domain", "government", "this is a work of the united|u states|s government and is not subject to copyright"],
    ["proprietary", "rights", "all rights reserved no part of this publication|document|book|work may be reproduced"],
    ["proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"],
    ["proprietary", "confidential", "this document|file|software contains confidential and proprietary information"],
    ["commercial", "purchased", "you may use this software only if you have purchased a licen[sc]e"],
    ["no-derivatives", "derivative", "you may not create derivative works"],
    ["non-commercial", "commercial", "for non commercial use|purposes only"],
    ["non-commercial", "noncommercial", "for noncommercial use|purposes only"],
    ["research-only", "research", "for research use|purposes only"],
    ["sspl-1.0", "side", "the terms of the server side public license version 1 as published by mongodb"],
    ["openrail-m", "restrictions", "use based restrictions as referenced in paragraph 5"],
    ["llama-community", "llama", "is licensed under the llama ~2 community license"],
]
#: [label, keywords, rule]: addresses, as the words in them.
ADDRESSES = [
    ["mit", "opensource", "opensource org licenses? mit"],
    ["mit", "mit", "licenses mit edu|html"],
    ["isc", "opensource", "opensource org licenses? isc"],
    ["bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause"],
    ["bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"],
    ["apache-2.0", "apache", "apache org licenses license 2 0 html|txt?"],
    ["apache-2.0", "opensource", "opensource org licenses? apache 2 0"],
    ["gpl", "gnu", "gnu org licenses gpl html|txt?"],
    ["gpl-2.0", "gnu", "gnu org licenses old licenses gpl 2 0"],
    ["gpl-3.0", "gnu", "gnu org licenses gpl 3 0"],
    ["lgpl", "gnu", "gnu org licenses lgpl html|txt?"],
    ["lgpl-2.1", "gnu", "gnu org licenses old licenses lgpl 2 1"],
    ["lgpl-3.0", "gnu", "gnu org licenses lgpl 3 0"],
    ["agpl", "gnu", "gnu org licenses agpl html|txt?"],
    ["agpl-3.0", "gnu", "gnu org licenses agpl 3 0"],
    ["gfdl", "gnu", "gnu org licenses fdl html|txt?"],
    ["gpl", "gnu", "gnu org licenses"],
    ["mpl-2.0", "mozilla", "mozilla org mpl 2 0"],
    ["epl-1.0", "eclipse", "eclipse org legal epl v10"],
    ["epl-2.0", "eclipse", "eclipse org legal epl v20|2 0?"],
    ["bsl-1.0", "boost", "boost org license 1 0"],
    ["unlicense", "unlicense", "unlicense org"],
    ["wtfpl", "wtfpl", "wtfpl net"],
    ["ofl-1.1", "sil", "scripts sil org ofl"],
    ["odbl-1.0", "odbl", "opendatacommons org licenses odbl"],
    ["pddl-1.0", "pddl", "opendatacommons org licenses pddl"],
    ["odc-by-1.0", "opendatacommons", "opendatacommons org licenses by"],
    ["cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"],
    ["public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"],
    ["php-3.01", "php", "php net license 3 01"],
    ["eupl-1.2", "eupl", "joinup ec europa eu ~6 eupl"],
]
#: The phrases that a caller counts on: [label, keywords, rule].
BASE = [["mit", "mit license", "mit license"], ["apache", "apache license", "apache license"], ["gpl", "general license", "general public license"]]


def _families() -> list[list]:
    """Named licenses that come in versions: of GNU, and of Creative Commons by their elements."""
    out = []
    for label, word, versions in (("gpl", "general", ["1", "2", "3"]), ("lgpl", "lesser|library", ["2", "2 1", "3"]), ("agpl", "affero", ["1", "3"])):
        full = "gnu? general public licen[sc]e" if label == "gpl" else f"gnu? {word} general public licen[sc]e"
        out.append([label, "general" if label == "gpl" else "public", [label, full]])
        for v in versions:
            named = f"{label}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            last = "0?" if " " not in v else ""
            out.append([named, label, [f"{label} {v} {last}".strip(), f"{label} v|version {v} {last}".strip(), f"gnu {label} v|version? {v} {last}".strip(), *([f"{label}v{v} {last}".strip()] if " " not in v else [])]])
            out.append([named, "public", [f"{full} {label}? v|version? {v} {last}".strip(), *([f"{full} {label}? v{v} {last}".strip()] if " " not in v else [])]])
    for v in ("1 1", "1 2", "1 3"):
        out.append([f"gfdl-{v.replace(' ', '.')}", "documentation", [f"gfdl {v}", f"gnu? free documentation licen[sc]e v|version? {v}"]])
    out.append(["gfdl", "documentation", ["gfdl", "gnu? free documentation licen[sc]e"]])
    words = {"by": "attribution", "sa": "share alike|sharealike", "nc": "non commercial|noncommercial", "nd": "no derivatives|noderivs|noderivatives"}
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        spelt = " ".join("no? derivatives|noderivs|noderivatives" if p == "nd" else "share? alike|sharealike" if p == "sa" else "non? commercial|noncommercial" if p == "nc" else words[p] for p in parts.split())
        label = "cc-" + parts.replace(" ", "-")
        for v in ("", "1 0", "2 0", "2 5", "3 0", "4 0"):
            named = f"{label}-{v.replace(' ', '.')}" if v else label
            out.append([named, "cc", [f"cc {parts} {v}".strip()]])
            out.append([named, "creative", [f"creative commons {parts} {v}".strip(), f"creative commons {spelt} {v}".strip()]])
    return out


def pattern(rule: str) -> str:
    """The regular expression of a rule, over words with a space on both sides."""
    out = []
    for word in rule.split():
        if word[0] == "~":
            out.append(f"(?: [^ ]+ ){{0,{int(word[1:])}}}")
        else:
            one = f" (?:{word.rstrip('?')}) " if "|" in word else f" {word.rstrip('?')} "
            out.append(f"(?:{one})?" if word.endswith("?") else one)
    return "".join(out)


def rules() -> list[tuple[str, int, list[str], str, bool]]:
    """(label, level, keywords, regular expression, whether it is one of BASE), in order."""
    out = [(label, TEXT, gate, rule, False) for label, gate, rule in TEXTS]
    names = [x for x in NAMED + _families()]
    out += [(label, TAG, f"spdx {gate if gate in names_[0].split() else ''}", f"spdx license identifier {names_[0]}", False) for label, gate, names_ in names]
    out += [(label, TAG, gate, rule, False) for label, gate, rule in ADDRESSES]
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        out += [("cc-" + parts.replace(" ", "-") + f"-{v.replace(' ', '.')}", TAG, "creativecommons", f"creativecommons org licenses {parts} {v}", False) for v in ("1 0", "2 0", "2 5", "3 0", "4 0")]
    # what a license is granted by; a name alone must be one that no other thing has
    out += [(label, GRANT, gate if gate in name.split() else "under", f"licen[sc]ed|released|distributed|available|published|provided|covered under|by|with the|a|an? terms? of? the? {name}", False) for label, gate, names_ in names for name in names_]
    out += [(label, NAME, gate if gate in name.split() else "", name, False) for label, gate, names_ in names for name in names_ if len(name.split()) > 1 or name in ("wtfpl", "unlicense", "0bsd", "agpl", "lgpl", "gfdl", "beerware")]
    out += [(label, NAME, gate, rule, True) for label, gate, rule in BASE]
    return [(label, level, _gate(gate, rule), pattern(rule), base) for label, level, gate, rule, base in out]


def _gate(wanted: str, rule: str) -> list[str]:
    """Words that every find of a rule has: those wanted, else its longest one."""
    sure = [x for x in rule.split() if x.isalnum()]
    return sorted({x for x in wanted.split() if x in sure} or {max(sure, key=len)})


RULES = rules()
KEYWORDS = sorted({k for r in RULES for k in r[2]})


def _wrapped(text: Column) -> Column:
    """The words of a text that has some, lower-cased, each with a space on both sides."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NO_WORD, "  ")), F.lit(" "))


def _words(pieces: Column) -> Column:
    """How many words a text has, cut at what is between them: the first and the last piece may be empty."""
    n = F.size(pieces)
    return (n - (F.get(pieces, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(pieces, n - 1) == "")).cast("int")).cast("long")


def _count(wrapped: Column) -> Column:
    """Words of what ``_wrapped`` made, or of a piece of it."""
    return ((F.length(wrapped) - F.length(F.translate(wrapped, " ", ""))) / 2).cast("long")


def _running(values: Column, combine) -> Column:
    """Running sums, or maxima, of an array of longs >= 0, in n log n steps: each round adds what stands 1, 2, 4, ... places before."""
    n = F.size(values)
    before = lambda a, k: F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("int")), a), F.lit(1), n)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int"))
    return F.when(n < 2, values).otherwise(F.aggregate(rounds, values, lambda a, k: F.zip_with(a, before(a, k), combine)))


def _keyword_search() -> str:
    """One search for all keywords, those of a first letter together."""
    by = {}
    for k in KEYWORDS:
        by.setdefault(k[0], []).append(re.escape(k[1:]))
    return f"(?i)(?<!{_WORD})(" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + f")(?!{_WORD})"


def _by_keyword() -> Column:
    """The rules by the first of their keywords: a map that Spark folds into one literal."""
    by: dict[str, list] = {}
    for i, (label, level, gate, x, base) in enumerate(RULES):
        by.setdefault(gate[0], []).append({"rule": i, "regex": x, "level": level, "label": label, "base": base, "gate": gate[1:]})
    return F.from_json(F.lit(json.dumps(by)), "map<string,array<struct<rule:int,regex:string,level:int,label:string,base:boolean,gate:array<string>>>>")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, found (array of struct<first, end, rule, level, label, base, kept>: all
    intervals of words [first, end) that rules find, in order; kept: not suppressed).

    Null and empty texts have no words and nothing found. Repeated rows are scanned each, and ids may be null; other
    columns aren't read, whatever their names. Whole texts: a row's work grows with its words, and with its finds
    by n log n. A word more than a rule has, or a different one, is no find: rules say all they allow.
    """
    w, k, h, n = free(docs.select(doc_id), "wrapped", "keywords", "hits", "n_words")
    rows = docs.select(F.col(doc_id).alias(doc_id), F.coalesce(F.col(text), F.lit("")).alias(w)).withColumn(n, F.split(w, _NO_WORD, -1))
    rows = rows.withColumn(n, _words(F.col(n))).withColumn(k, F.array_distinct(F.transform(F.regexp_extract_all(w, F.lit(_keyword_search()), F.lit(1)), F.lower)))
    rows = rows.withColumn(w, F.when(F.size(k) > 0, _wrapped(F.col(w))))
    gated = F.filter(F.flatten(F.transform(F.col(k), lambda x: F.coalesce(F.try_element_at(_by_keyword(), x), F.array()))), lambda r: F.size(F.array_except(r["gate"], F.col(k))) == 0)
    tried = F.transform(gated, lambda r: F.struct(r.alias("r"), F.regexp_extract_all(F.col(w), r["regex"], F.lit(0)).alias("hit")))
    rows = rows.withColumn(h, F.when(F.size(k) > 0, F.filter(tried, lambda t: F.size(t["hit"]) > 0)))

    def places(t: Column) -> Column:
        """The hits of one rule: each begins behind the pieces before it and the hits among them."""
        own = F.transform(t["hit"], _count)
        steps = F.zip_with(F.transform(F.slice(F.split(F.col(w), t["r"]["regex"], -1), F.lit(1), F.size(own)), _count), own, lambda p, o: p + o)
        ends = _running(steps, lambda a, b: a + b)
        return F.zip_with(ends, own, lambda e, o: F.struct((e - o).alias("first"), (-e).alias("last"), t["r"]["level"].alias("level"), t["r"]["rule"].alias("rule"), t["r"]["label"].alias("label"), t["r"]["base"].alias("base")))

    # in order, whatever holds an interval comes before it
    rows = rows.withColumn(h, F.sort_array(F.flatten(F.transform(h, places))))
    reach = F.array(*(_running(F.transform(h, lambda d: F.when(d["level"] <= level, -d["last"]).otherwise(0)), lambda a, b: F.greatest(a, b)) for level in range(NAME + 1)))
    rows = rows.withColumn(k, F.when(F.size(h) > 0, reach))
    found = F.transform(h, lambda d, i: F.struct(d["first"].alias("first"), (-d["last"]).alias("end"), d["rule"].alias("rule"), d["level"].alias("level"), d["label"].alias("label"), d["base"].alias("base"), ((i == 0) | (F.get(F.get(F.col(k), d["level"]), i - 1) < -d["last"])).alias("kept")))
    empty = F.array().cast("array<struct<first:bigint,end:bigint,rule:int,level:int,label:string,base:boolean,kept:boolean>>")
    return rows.select(F.col(doc_id), F.col(n).alias("n_words"), F.coalesce(found, empty).alias("found"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    label = lambda of: F.transform(F.filter("found", of), lambda d: d["label"])
    base, kept = lambda d: d["base"], lambda d: d["kept"]
    first = F.transform(F.filter("found", base), lambda d: d["first"])
    sure = F.transform(F.filter("found", kept), lambda d: F.get(F.array(*(F.lit(c) for c in CONFIDENCE)), d["level"]))
    return found.select(
        "doc_id", "n_words", F.size(first).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        _joined(label(base)).alias("base_labels"), _joined(F.concat(label(base), label(kept))).alias("labels"), F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )


def _sql_rules() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(label)}, {level}, {[f' {k} ' for k in gate]!r}::VARCHAR[], {quote(x)}, {base})" for i, (label, level, gate, x, base) in enumerate(RULES))


_SQL_WORDS = "length({0}) - length(replace({0}, ' ', ''))"
OP12_SQL = rf"""
WITH rule(rule, label, level, gate, regex, base) AS (VALUES {_sql_rules()}),
     d AS (SELECT row_number() OVER () AS n, doc_id, CASE WHEN len(w) = 0 THEN '' ELSE ' ' || array_to_string(w, '  ') || ' ' END AS t, len(w) AS n_words
           FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
     tried AS (SELECT n, t, rule.*, regexp_extract_all(t, regex) AS hit FROM d, rule WHERE len(list_filter(gate, lambda k: NOT contains(t, k))) = 0),
     cut AS (SELECT n, rule, label, level, base, hit, regexp_split_to_array(t, regex) AS piece, unnest(range(1, len(hit) + 1)) AS i FROM tried WHERE len(hit) > 0),
     found AS (SELECT n, rule, label, level, base,
                      ({_SQL_WORDS.format("array_to_string(piece[1:i], '')")} + {_SQL_WORDS.format("array_to_string(hit[1:i-1], '')")}) // 2 AS first,
                      ({_SQL_WORDS.format("array_to_string(piece[1:i], '')")} + {_SQL_WORDS.format("array_to_string(hit[1:i], '')")}) // 2 AS until FROM cut),
     kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.n = f.n AND g.level <= f.level AND g.first <= f.first AND g.until >= f.until
              AND (g.first < f.first OR g.until > f.until OR (g.level, g.rule) < (f.level, f.rule)))),
     b AS (SELECT n, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found WHERE base GROUP BY n),
     l AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT n, label FROM found WHERE base UNION ALL SELECT n, label FROM kept) GROUP BY n),
     s AS (SELECT n, max({CONFIDENCE}[level + 1])::DOUBLE AS score FROM kept GROUP BY n)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN b USING (n) LEFT JOIN l USING (n) LEFT JOIN s USING (n)
"""
