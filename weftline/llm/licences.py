"""License scans by ordered signature rules.

A rule is a regular expression with a label, keywords and a priority: families of
licenses by name, SPDX id, address and grant, and the wording of notices, headers
and disclaimers. The keyword gate lets a text's rules be tried only where a keyword of theirs occurs, and
leaves the many texts without any keyword after a single pass. Detections are
taken in order of their start; one inside another is dropped, of equal ones the
rule of higher priority (lower number) stays, and so it does of two that cross.

Only built-in functions; the rules travel as a literal array and each row is
scanned by itself, so nothing is shuffled.

Defined cases: a null text is an empty one, with no words and no labels; rows
that repeat a doc_id are scanned separately; a text of any length and any number
of detections is scanned whole; of equal detections of one priority the label
first in order stays; other columns are ignored, whatever their names; no rows
give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .spans import bound, distinct_sorted, find_all, fold

#: A word character is 0-9, a-z once lower-cased, or not ASCII.
WORD = r"[0-9A-Za-z[^\x00-\x7F]]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
#: Base phrases, as words, and their labels.
BASE = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
BASE_PATTERN = rf"(?i)(?<!{WORD})(?:" + "|".join(_GAP.join(words) for words in BASE) + rf")(?!{WORD})"

_B = r"[\s\xA0]"
#: Blanks of any number, line ends among them with the signs of a comment that goes on.
_S = rf"(?:{_B}++(?:(?:[*#;!|>%]|//|--)++{_B}*+)*+)"
_O = rf"(?:{_B}|-)*+"
#: label: (keywords, one of which begins a word of any name, its name as a pattern, its SPDX id as a pattern, part of its address).
FAMILIES: dict[str, tuple[str, str, str, str]] = {
    "gpl": ("gnu", rf"gnu{_S}(?:general{_S}public{_S}licen[sc]e|gpl)", r"gpl-[123]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    "lgpl": ("lesser library", rf"(?:gnu{_S})?(?:lesser|library){_S}general{_S}public{_S}licen[sc]e", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    "agpl": ("affero", rf"(?:gnu{_S})?affero{_S}general{_S}public{_S}licen[sc]e", r"agpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    "gfdl": ("documentation", rf"(?:gnu{_S})?free{_S}documentation{_S}licen[sc]e", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    "apache": ("apache", rf"apache{_S}(?:software{_S})?licen[sc]e", r"apache-[12]\.[01]", r"apache\.org/licenses"),
    "mit": ("mit", rf"mit{_S}licen[sc]e|mit-style{_S}licen[sc]e", r"mit(?:-0)?", r"opensource\.org/licenses/mit"),
    "bsd": ("bsd", rf"(?:[234]-clause{_S}|new{_S}|simplified{_S}|modified{_S})?bsd{_O}(?:[234]-clause{_S})?(?:style{_S})?licen[sc]e", r"bsd-[1234]-clause", r"opensource\.org/licenses/bsd"),
    "0bsd": ("0bsd bsd", rf"(?:bsd{_S}zero{_S}clause|0bsd){_S}licen[sc]e", r"0bsd", r"opensource\.org/licenses/0bsd"),
    "mpl": ("mozilla", rf"mozilla{_S}public{_S}licen[sc]e", r"mpl-[12]\.[01]", r"mozilla\.org/mpl"),
    "epl": ("eclipse", rf"eclipse{_S}public{_S}licen[sc]e", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    "edl": ("distribution", rf"eclipse{_S}distribution{_S}licen[sc]e", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    "cddl": ("cddl common", rf"common{_S}development{_S}and{_S}distribution{_S}licen[sc]e|cddl", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl"),
    "cpl": ("common", rf"common{_S}public{_S}licen[sc]e", r"cpl-1\.0", r"opensource\.org/licenses/cpl"),
    "ipl": ("ibm", rf"ibm{_S}public{_S}licen[sc]e", r"ipl-1\.0", r"opensource\.org/licenses/ipl"),
    "artistic": ("artistic", rf"artistic{_S}licen[sc]e", r"artistic-[12]\.0", r"opensource\.org/licenses/artistic"),
    "isc": ("isc", rf"isc{_S}licen[sc]e", r"isc", r"opensource\.org/licenses/isc"),
    "zlib": ("zlib", rf"zlib(?:/libpng)?{_S}licen[sc]e", r"zlib", r"zlib\.net/zlib_license"),
    "boost": ("boost", rf"boost{_S}software{_S}licen[sc]e", r"bsl-1\.0", r"boost\.org/license"),
    "busl": ("business", rf"business{_S}source{_S}licen[sc]e", r"busl-1\.1", r"mariadb\.com/bsl"),
    "unlicense": ("unlicense", r"(?:the\s)?unlicense", r"unlicense", r"unlicense\.org"),
    "wtfpl": ("wtfpl fuck", rf"wtfpl|do{_S}what{_S}the{_S}fuck{_S}you{_S}want", r"wtfpl", r"wtfpl\.net"),
    "cc0": ("cc0", rf"cc0(?:{_O}1\.0)?(?:{_S}universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    "cc-by": ("cc creative", rf"(?:cc|creative{_S}commons){_O}(?:by|attribution)(?!{_O}(?:nc|sa|nd|non|share|no))", r"cc-by-[1234]\.0", r"creativecommons\.org/licenses/by/"),
    "cc-by-sa": ("cc creative", rf"(?:cc|creative{_S}commons){_O}(?:by|attribution){_O}(?:sa|share-?alike)", r"cc-by-sa-[1234]\.0", r"creativecommons\.org/licenses/by-sa/"),
    "cc-by-nc": ("cc creative", rf"(?:cc|creative{_S}commons){_O}(?:by|attribution){_O}(?:nc|non-?commercial)(?!{_O}(?:sa|nd|share|no))", r"cc-by-nc-[1234]\.0", r"creativecommons\.org/licenses/by-nc/"),
    "cc-by-nd": ("cc creative", rf"(?:cc|creative{_S}commons){_O}(?:by|attribution){_O}(?:nd|no-?derivs|no-?derivatives)", r"cc-by-nd-[1234]\.0", r"creativecommons\.org/licenses/by-nd/"),
    "cc-by-nc-sa": ("cc creative", rf"(?:cc|creative{_S}commons){_O}(?:by|attribution){_O}(?:nc|non-?commercial){_O}(?:sa|share-?alike)", r"cc-by-nc-sa-[1234]\.0", r"creativecommons\.org/licenses/by-nc-sa/"),
    "cc-by-nc-nd": ("cc creative", rf"(?:cc|creative{_S}commons){_O}(?:by|attribution){_O}(?:nc|non-?commercial){_O}(?:nd|no-?deriv)", r"cc-by-nc-nd-[1234]\.0", r"creativecommons\.org/licenses/by-nc-nd/"),
    "ofl": ("font", rf"(?:sil{_S})?open{_S}font{_S}licen[sc]e", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    "psf": ("python", rf"python{_S}(?:software{_S}foundation{_S})?licen[sc]e", r"(?:psf|python)-2\.0", r"docs\.python\.org/[0-9.]*/?license"),
    "postgresql": ("postgresql", rf"postgresql{_S}licen[sc]e", r"postgresql", r"postgresql\.org/about/licence"),
    "openssl": ("openssl", rf"openssl{_S}licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    "php": ("php", rf"php{_S}licen[sc]e", r"php-3\.0[01]?", r"php\.net/license"),
    "ruby": ("ruby", rf"ruby{_S}licen[sc]e", r"ruby", r"ruby-lang\.org/[a-z]+/about/license"),
    "vim": ("vim", rf"vim{_S}licen[sc]e", r"vim", r"vimhelp\.org/uganda"),
    "x11": ("x11", rf"x11{_S}licen[sc]e", r"x11", r"xfree86\.org/[0-9.]*/?license"),
    "ncsa": ("ncsa uiuc university", rf"(?:uiuc|university{_S}of{_S}illinois)?/?(?:ncsa){_S}(?:open{_S}source{_S})?licen[sc]e", r"ncsa", r"opensource\.org/licenses/ncsa"),
    "upl": ("universal", rf"universal{_S}permissive{_S}licen[sc]e", r"upl-1\.0", r"opensource\.org/licenses/upl"),
    "eupl": ("union", rf"european{_S}union{_S}public{_S}licen[sc]e", r"eupl-1\.[012]", r"ec\.europa\.eu/[a-z/]*eupl"),
    "osl": ("open", rf"open{_S}software{_S}licen[sc]e", r"osl-[123]\.[01]", r"opensource\.org/licenses/osl"),
    "afl": ("academic", rf"academic{_S}free{_S}licen[sc]e", r"afl-[123]\.[012]", r"opensource\.org/licenses/afl"),
    "mulan": ("mulan", rf"mulan{_S}(?:psl|permissive{_S}software{_S}licen[sc]e)", r"mulanpsl-[12]\.0", r"license\.coscl\.org\.cn"),
    "ms-pl": ("microsoft", rf"microsoft{_S}public{_S}licen[sc]e", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    "ms-rl": ("microsoft", rf"microsoft{_S}reciprocal{_S}licen[sc]e", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    "odbl": ("database", rf"open{_S}database{_S}licen[sc]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "odc-by": ("commons", rf"open{_S}data{_S}commons{_S}attribution{_S}licen[sc]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    "pddl": ("dedication", rf"public{_S}domain{_S}dedication{_S}and{_S}licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    "json": ("json", rf"json{_S}licen[sc]e", r"json", r"json\.org/license"),
    "beerware": ("beer", rf"beer-?ware{_S}licen[sc]e", r"beerware", r"people\.freebsd\.org/~phk"),
    "public-domain": ("domain", rf"(?:in|into){_S}the{_S}public{_S}domain", r"(?:cc-pddc|licenseref-public-domain)", r"creativecommons\.org/licenses/publicdomain"),
    "proprietary": ("rights", rf"all{_S}rights{_S}reserved", r"licenseref-proprietary", ""),
}
_TAIL = rf"(?:,?{_S}(?:version|v\.?){_O}[0-9]+(?:\.[0-9]+)*|{_S}[0-9]+(?:\.[0-9]+)+)"
#: Families that are called by a short name as well; with a version's number it stands for itself (GPLv3, LGPL-2.1+).
BARE = {n: n for n in ("gpl", "lgpl", "agpl", "gfdl", "apache", "mit", "bsd", "mpl", "epl", "cddl", "isc", "zlib", "eupl", "wtfpl", "unlicense", "cc0", "ofl")}
VERSIONED = ("gpl", "lgpl", "agpl", "mpl", "epl", "eupl")
#: Forms in which each family is signed: (priority, confidence, pattern of name, id or address). An id is one after spdx-license-identifier, a
#: further one of an expression (at most 16 blanks and brackets after its operator), and, where it has a hyphen, one by itself.
FORMS = {
    "id": (1, 1.0, rf"spdx-license-identifier:{_B}*+\(*+{_B}*+(?:{{spdx}})(?![0-9A-Za-z.-])"),
    "expression": (1, 1.0, r"(?<=(?-i:OR|AND|WITH)[\s\xA0(]{1,16})(?:{spdx})(?![0-9A-Za-z-])"),
    "field": (1, 0.95, rf"licen[sc]e[\"'`]?{_B}*+[:=]{_B}*+[\"'`(\[]*+(?:the{_S})?(?:(?:{{spdx}})(?![0-9A-Za-z-])|(?:{{bare}})(?:{_O}v?[0-9]++(?:\.[0-9]++)*+)?\+?)"),
    "grant": (2, 0.95, rf"(?:licen[sc]ed|released|distributed|published|available|provided|covered){_S}under{_S}(?:the{_S})?(?:terms{_S}of{_S})?(?:the{_S})?(?:{{name}}|{{bare}}(?:{_S}licen[sc]e)?){_TAIL}?"),
    "short": (3, 0.9, r"{short}"),
    "version": (3, 0.9, rf"(?:{{name}}){_TAIL}"),
    "address": (4, 0.85, r"https?://(?:www\.)?{url}[0-9A-Za-z./_-]*"),
    "name": (5, 0.7, r"(?:{name})"),
}
#: Notices, headers and disclaimers: label, wording. A blank stands for any signs and white space, "..." for up to twelve words.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "software is provided as is without warranty of any kind express or implied including but not limited to"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "neither the name of ... nor the names of its contributors may be used to endorse or promote products"),
    ("bsd", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "either version 2 of the license or at your option any later version"),
    ("gpl", "either version 3 of the license or at your option any later version"),
    ("gpl", "this is free software and you are welcome to redistribute it under certain conditions"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "this license the lesser general public license applies to some specially designated software"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license"),
    ("agpl", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "this product includes software developed by the apache software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "the contents of this file are subject to the mozilla public license version"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl", "this program and the accompanying materials are made available under the terms of the eclipse distribution license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", "this program and the accompanying materials are made available under the terms of the common public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "to the extent possible under law ... has waived all copyright and related or neighboring rights to"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share alike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives"),
    ("cc-by-sa", "text is available under the creative commons attribution sharealike license"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("ofl", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "this is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("psf", "psf is making python available to licensee on an as is basis"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "this source file is subject to version ... of the php license"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("json", "the software shall be used for good not evil"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("upl", "the above copyright notice and either this complete permission notice or at a minimum a reference to the upl must be included"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("odbl", "is made available under the open database license"),
    ("pddl", "is made available under the public domain dedication and license"),
    ("odc-by", "is made available under the open data commons attribution license"),
    ("public-domain", "this file is in the public domain"),
    ("public-domain", "placed in the public domain"),
    ("public-domain", "no copyright is claimed in this work"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "no part of this ... may be reproduced stored in a retrieval system or transmitted"),
    ("proprietary", "you may not copy modify distribute sell or lease any part of"),
    ("proprietary", "reproduction in whole or in part without written permission is prohibited"),
    ("proprietary", "confidential and proprietary do not distribute"),
]
NOTICE = (2, 0.95)  # priority, confidence
RULES = "array<struct<priority:int,confidence:double,label:string,form:string,pattern:string>>"
DETECTION = "struct<start:int,end:int,priority:int,label:string,form:string,confidence:double>"


def _hyphen(spdx: str) -> bool:
    """Whether an id has a hyphen outside its optional parts, so that it can't be another word."""
    return "-" in re.sub(r"\(\?:[^)]*\)\??", "", spdx) and not spdx.startswith("(?:")


def rules() -> list[tuple[int, float, str, str, str, str]]:
    """(priority, confidence, label, form, keyword, pattern) of every rule: each family in each form that it has, for each of its keywords."""
    out = []
    for label, (keywords, name, spdx, url) in FAMILIES.items():
        bare = BARE.get(label, "(?!)")
        head = re.match(r"(?:\(\?:)?([0-9a-z]+)", spdx)[1]
        heads = sorted({head, BARE.get(label, head)})
        short = [f"(?:{spdx})"] * _hyphen(spdx) + [rf"{bare}{_O}v?[1-9](?:\.[0-9])?(?:\+|-or-later|-only)?"] * (label in VERSIONED)
        for form, (priority, confidence, pattern) in FORMS.items():
            if (form == "address" and not url) or (form == "short" and not short):
                continue
            body = pattern.replace("{short}", f"(?:{'|'.join(short)})(?![0-9A-Za-z-])")
            body = body.replace("{name}", name).replace("{spdx}", spdx).replace("{url}", url).replace("{bare}", bare)
            gates = {"id": ["spdx"], "address": ["http"], "short": heads, "expression": heads, "field": heads, "grant": sorted({*keywords.split(), BARE.get(label, keywords.split()[0])})}
            for word in gates.get(form, keywords.split()):
                out.append((priority, confidence, label, form, word, rf"(?i)(?<!{WORD})(?:{body})(?!{WORD})"))
    for label, wording in NOTICES:
        body = _GAP.join(rf"(?:{WORD}++{_GAP}){{0,11}}{WORD}++" if w == "..." else w for w in wording.split())
        out.append((*NOTICE, label, "notice", _gate_of(wording), rf"(?i)(?<!{WORD})(?:{body})(?!{WORD})"))
    return out


def _gate_of(wording: str) -> str:
    """The first words of a notice, which gate its rule."""
    return wording.split(" ... ")[0] if " ... " in wording[:24] else " ".join(wording.split()[:3])


def _gate() -> str:
    """Looks, at the start of each word, for the longest keyword that begins there; keywords are grouped by their first letter."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted({r[4] for r in rules()} | {w[0] for w in BASE}, key=lambda w: (-len(w), w)):
        by_letter.setdefault(word[0], []).append(_GAP.join(word.split())[1:])
    return rf"(?i)(?<!{WORD})(?=(" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + "))"


GATE = _gate()


def detections(text: Column, keywords: Column) -> Column:
    """The detections of a text that remain, in order: array of (start, end, priority, label, form, confidence)."""
    by_word: dict[str, list[Column]] = {}
    for p, c, label, form, word, rx in rules():
        one = F.struct(F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(label).alias("label"), F.lit(form).alias("form"), F.lit(rx).alias("pattern"))
        by_word.setdefault(word, []).append(one)
    every = F.create_map(*(x for word, some in by_word.items() for x in (F.lit(word), F.array(*some))))
    tried = F.array_distinct(F.flatten(F.transform(keywords, lambda k: F.coalesce(F.try_element_at(every, k), F.array().cast(RULES)))))

    def of(r: Column) -> Column:
        place = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["form"].alias("form"), r["confidence"].alias("confidence"))
        return F.transform(find_all(text, r["pattern"]), place)

    ordered = distinct_sorted(F.flatten(F.transform(tried, of)))
    none = F.array().cast(f"array<{DETECTION}>")

    def step(last: Column, d: Column) -> tuple[Column, Column]:
        """last: the detection that stays unless the next one takes its place."""
        end = -d["back"]
        one = F.struct(d["start"].alias("start"), end.alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["form"].alias("form"), d["confidence"].alias("confidence"))
        meets = d["start"] < last["end"]
        wins = (end > last["end"]) & (d["priority"] < last["priority"])
        return F.when(meets & ~wins, last).otherwise(one), F.when(meets | (last["end"] < 0), none).otherwise(F.array(last))

    first = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"), F.lit(99).alias("priority"), F.lit("").alias("label"), F.lit("").alias("form"), F.lit(0.0).alias("confidence"))
    keep_last = lambda last, out: F.concat(out, F.when(last["end"] < 0, none).otherwise(F.array(last)))
    return bound(ordered, lambda a: fold(a, first, step, DETECTION, keep_last))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (array of matched phrases), first_word, last_word, detections."""
    text = text_or_empty("text")
    found = F.regexp_extract_all(text, F.lit(GATE), F.lit(1))
    keywords = F.array_distinct(F.transform(found, lambda k: F.lower(F.regexp_replace(k, _GAP, " "))))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    src = src.select("doc_id", text.alias("text"), keywords.alias("keywords"), words(text).alias("n_words"))
    base = F.when(F.size("keywords") > 0, F.regexp_extract_all("text", F.lit(BASE_PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    src = src.withColumn("base", base)
    found = F.size("base") > 0
    pieces = F.split("text", F.lit(BASE_PATTERN), F.lit(-1))
    src = src.withColumns({
        "first_word": F.when(found, words(F.get(pieces, F.lit(0)))),
        "last_word": F.when(found, F.col("n_words") - words(F.element_at(pieces, -1)) - words(F.element_at("base", -1))),
        "detections": detections(F.col("text"), F.col("keywords")),
    })
    return src.select("doc_id", "n_words", "base", "first_word", "last_word", "detections")


def labelled(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from ``scan``."""
    label = lambda m: F.coalesce(*(F.when(F.lower(m).startswith(w[0]), F.lit(name)) for w, name in BASE.items()))
    base = F.array_sort(F.array_distinct(F.transform("base", label)))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"]))))
    top = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.when(F.size("base") > 0, F.lit(0.7)), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), top.alias("score"),
    )
