"""License scans: ordered signature rules over normalized words, in DataFrame functions only.

A text is lower-cased (A-Z) and reduced to its words, one space between them.
Base phrases are found by their exact words. Signatures are regular
expressions over that form, each with a priority and a confidence: those in
``WORDING`` are written by hand after the licenses' own grants, conditions,
disclaimers and headers; and for every license in ``NAMES`` there is one for
each way in ``WAYS`` to refer to it. A rule runs only where its keyword occurs,
and all rules only where a stem in ``STEMS`` occurs; no rule matches without
them. Of overlapping detections one survives: intervals inside others go, and
of those that partly overlap the one of better priority stays, on ties the
earlier.

Everything happens in one row: no shuffle, no Python. The rules are a constant
array in the plan.

Defined cases: a null text is empty and has no labels and score 0; positions
are null where no base phrase stands; equal rows are scanned each. Columns of
the names that ``scan`` adds are replaced, others are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (phrase, label): found wherever the words stand consecutively.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
BASE_CONFIDENCE = 0.9

#: A text without any of these is not scanned by signatures: every one has one. Parts of single words, as words may stand on different lines.
STEMS = (
    "licen", "copyright", "spdx", "released", "distributed", "published", "available", "provided", "dedicated",
    "hereby", "redistribut", "warrant", "endorse", "advertising", "misrepresented", "liable", "suitability", "invariant", "unencumbered", "fuck",
    "openssl", "waived", "creativecommons", "attribution", "universal", "evil", "compile", "charityware", "perl", "ruby", "copyleft", "apache", "mozilla", "eclipse", "confidential", "unauthorized",
)

#: (label, keyword, name): the keyword is a word of every text that the name matches, or with * an end of one.
NAMES = [
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("mit-0", "attribution", "mit no attribution"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? v?1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("bsd-2-clause", "*bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("gpl-1", "gpl*", r"(?:gnu )?gpl(?: version)? ?v?1(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl(?: version)? v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl(?: version)? v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gplv2", r"(?:gnu )?gplv2(?: only| or later)?"),
    ("gpl-3", "gplv3", r"(?:gnu )?gplv3(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2", "gnu", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?"),
    ("gpl-3", "gnu", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?"),
    ("gpl", "gnu", r"gnu general public license"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version)? v?2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl(?: version)? v?3(?: 0)?"),
    ("lgpl", "lesser", r"gnu lesser general public license"),
    ("lgpl", "library", r"gnu library general public license"),
    ("agpl-3", "affero", r"gnu affero general public license(?: version)?(?: v?3)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl(?: version)?(?: v?3(?: 0)?)?"),
    ("gfdl", "documentation", r"gnu free documentation license"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? v?1 1"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version)? v?2(?: 0)?"),
    ("mpl-2", "mpl*", r"mpl(?: version)? ?v?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license(?: version)? v?2(?: 0)?"),
    ("cddl-1", "cddl", r"cddl(?: version)?(?: v?1(?: 0)?)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version)? v?2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic"),
    ("bsl-1", "boost", r"boost software(?: license)?(?: version)?(?: v?1(?: 0)?)?"),
    ("psf-2", "python", r"python software foundation(?: license)?(?: version)?(?: v?2(?: 0)?)?"),
    ("ofl-1.1", "sil", r"sil open font(?: license)?(?: version)?(?: v?1 1)?"),
    ("eupl-1.2", "eupl", r"eupl(?: version)?(?: v?1 2)?"),
    ("odbl-1", "odbl", r"odbl(?: version)?(?: v?1(?: 0)?)?"),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "nd", r"(?:cc|creative commons) by nc nd(?: [234] [05])?"),
    ("cc-by-nc-sa", "sa", r"(?:cc|creative commons) by nc sa(?: [234] [05])?"),
    ("cc-by-nc", "nc", r"(?:cc|creative commons) by nc(?: [234] [05])?"),
    ("cc-by-nd", "nd", r"(?:cc|creative commons) by nd(?: [234] [05])?"),
    ("cc-by-sa", "sa", r"(?:cc|creative commons) by sa(?: [234] [05])?"),
    ("cc-by", "by", r"(?:cc|creative commons) by(?: [234] [05])?"),
    ("cc-by", "attribution", r"creative commons attribution(?: [234] [05])?"),
    ("cc-by-sa", "sharealike", r"creative commons attribution sharealike(?: [234] [05])?"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [234] [05])?"),
    ("public-domain", "domain", r"public domain"),
]

#: (priority, confidence, pattern around the name): lower priority numbers win.
WAYS = [
    (1, 1.0, r"spdx license identifier {}"),
    (2, 0.95, r"(?:is |are )?licensed under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (3, 0.9, r"(?:released|distributed|published|available|provided|redistributed|dedicated) (?:under|to|into|in) (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (4, 0.8, r"(?:under|see|subject to|governed by) (?:the )?(?:terms of )?(?:the )?{} licen[cs]e"),
    (5, 0.7, r"{} licen[cs]e"),
    (6, 0.6, r"licen[cs]e {}"),
]
#: Wording of licenses themselves and of the headers they ask for, as words in lower case.
#: (label, keyword, priority, confidence, pattern); a keyword as in ``NAMES``.
WORDING = [
    ("mit", "hereby", 2, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?"),
    ("mit", "hereby", 3, 0.9, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", 3, 0.9, r"(?:to )?use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", 4, 0.8, r"copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", 5, 0.7, r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "opensource", 2, 0.95, r"opensource org licenses mit(?: license)?"),
    ("mit-0", "hereby", 1, 0.98, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "advertising", 3, 0.85, r"name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", "hereby", 2, 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("isc", "hereby", 2, 0.95, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "hereby", 3, 0.85, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", 4, 0.8, r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("hpnd", "hereby", 4, 0.8, r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("ntp", "suitability", 5, 0.7, r"makes no representations about the suitability of this software for any purpose"),
    ("bsd", "redistribution", 3, 0.85, r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions", 4, 0.8, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", 4, 0.8, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", 2, 0.95, r"(?:nor the names of its contributors )?may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", 2, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "disclaimed", 5, 0.7, r"the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "regents", 4, 0.8, r"this software is provided by the regents and contributors as is"),
    ("bsd", "opensource", 2, 0.95, r"opensource org licenses bsd(?: license)?(?: php)?"),
    ("bsd-3-clause", "opensource", 1, 0.98, r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource", 1, 0.98, r"opensource org licenses bsd 2 clause"),
    ("bsd", "bsd", 3, 0.85, r"use of this source code is governed by a bsd style license"),
    ("gpl-2", "gnu", 1, 0.98, r"(?:(?:this (?:program|library) is )?free software you can redistribute it and or modify it )?under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3", "gnu", 1, 0.98, r"(?:(?:this (?:program|library) is )?free software you can redistribute it and or modify it )?under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2", "gnu", 1, 0.98, r"under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("gpl-2", "gnu", 1, 0.98, r"under the terms of version 2 of the gnu general public license"),
    ("gpl-3", "gnu", 1, 0.98, r"under the terms of version 3 of the gnu general public license"),
    ("gpl", "gnu", 2, 0.95, r"(?:this (?:program|library) is )?free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "gnu", 3, 0.9, r"you should have received a copy of the gnu general public license(?: along with this program)?"),
    ("gpl", "redistribute", 4, 0.75, r"this program is free software you can redistribute it and or modify it"),
    ("gpl", "warranty", 5, 0.7, r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "warranty", 5, 0.7, r"this program comes with absolutely no warranty"),
    ("gpl-2", "gnu", 2, 0.95, r"gnu general public license version 2 june 1991"),
    ("gpl-3", "gnu", 2, 0.95, r"gnu general public license version 3 29 june 2007"),
    ("gpl-2", "gnu", 2, 0.95, r"www gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3", "gnu", 2, 0.95, r"www gnu org licenses gpl 3 0"),
    ("gpl", "gnu", 4, 0.8, r"www gnu org (?:licenses|copyleft) gpl"),
    ("gpl", "copyleft", 5, 0.7, r"copyleft license for software and other kinds of works"),
    ("lgpl-2.1", "lesser", 1, 0.98, r"(?:(?:this (?:program|library) is )?free software you can redistribute it and or modify it )?under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "lesser", 1, 0.98, r"(?:(?:this (?:program|library) is )?free software you can redistribute it and or modify it )?under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "lesser", 2, 0.95, r"(?:this (?:program|library) is )?free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "library", 2, 0.95, r"(?:this (?:program|library) is )?free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl", "lesser", 3, 0.9, r"you should have received a copy of the gnu lesser general public license(?: along with this (?:library|program))?"),
    ("lgpl", "library", 5, 0.7, r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-2.1", "lesser", 2, 0.95, r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "lesser", 2, 0.95, r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "affero", 1, 0.98, r"(?:(?:this (?:program|library) is )?free software you can redistribute it and or modify it )?under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", "affero", 2, 0.95, r"(?:this (?:program|library) is )?free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", "affero", 3, 0.9, r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "gnu", 2, 0.95, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", 5, 0.7, r"with no invariant sections no front cover texts and no back cover texts"),
    ("apache-2", "apache", 1, 0.98, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache", 2, 0.95, r"you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2", "apache", 3, 0.9, r"www apache org licenses license 2 0"),
    ("apache-2", "basis", 4, 0.8, r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "compliance", 5, 0.7, r"you may not use this file except in compliance with the license"),
    ("apache-2", "asf", 2, 0.95, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "apache", 2, 0.95, r"apache license version 2 0 january 2004"),
    ("apache-1.1", "apache", 3, 0.9, r"this product includes software developed by the apache software foundation"),
    ("mpl-2", "mozilla", 1, 0.98, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl", 2, 0.95, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", 1, 0.98, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "mozilla", 3, 0.85, r"the contents of this file are subject to the mozilla public license"),
    ("mpl-2", "mozilla", 3, 0.9, r"mozilla org mpl 2 0"),
    ("mpl", "incompatible", 5, 0.7, r"this source code form is incompatible with secondary licenses"),
    ("epl-1", "eclipse", 1, 0.98, r"made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse", 1, 0.98, r"made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl", "eclipse", 3, 0.85, r"made available under the terms of the eclipse public license"),
    ("epl-1", "eclipse", 3, 0.9, r"www eclipse org legal epl v10"),
    ("epl-2", "eclipse", 3, 0.9, r"www eclipse org legal epl 2 0"),
    ("edl-1", "eclipse", 2, 0.95, r"eclipse distribution license(?: v)? 1 0"),
    ("cddl-1", "distribution", 2, 0.95, r"subject to the terms of the common development and distribution license"),
    ("cddl-1", "opensolaris", 5, 0.7, r"you can obtain a copy of the license at usr src opensolaris license"),
    ("cpl-1", "common", 2, 0.95, r"common public license(?: version)?(?: v)? 1 0"),
    ("unlicense", "unencumbered", 1, 0.98, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", 3, 0.9, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense", 3, 0.9, r"unlicense org"),
    ("wtfpl", "fuck", 2, 0.95, r"do what the fuck you want to public license"),
    ("wtfpl", "fuck", 4, 0.8, r"you just do what the fuck you want to"),
    ("beerware", "beerware", 3, 0.9, r"beerware licen[cs]e"),
    ("zlib", "altered", 2, 0.95, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", 3, 0.9, r"the origin of this software must not be misrepresented"),
    ("zlib", "liable", 4, 0.8, r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "warranty", 6, 0.6, r"this software is provided as is without any express or implied warranty"),
    ("bsl-1", "hereby", 2, 0.95, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1", "boost", 2, 0.95, r"distributed under the boost software license version 1 0"),
    ("bsl-1", "boost", 3, 0.9, r"www boost org license 1 0 txt"),
    ("psf-2", "psf", 2, 0.95, r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("psf-2", "psf", 4, 0.8, r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ofl-1.1", "font", 1, 0.98, r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font", 4, 0.8, r"the font software may be bundled redistributed and or sold with any software"),
    ("artistic-1", "perl", 2, 0.95, r"redistribute it and or modify it under the same terms as perl(?: 5)?(?: itself)?"),
    ("artistic-2", "artistic", 2, 0.95, r"redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("openssl", "openssl", 2, 0.95, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "openssl", 4, 0.8, r"products derived from this software may not be called openssl"),
    ("php-3.01", "php", 2, 0.95, r"this source file is subject to version 3 01 of the php license"),
    ("ms-pl", "microsoft", 2, 0.95, r"microsoft public license ms pl"),
    ("ms-rl", "microsoft", 2, 0.95, r"microsoft reciprocal license ms rl"),
    ("eupl-1.2", "eupl", 2, 0.95, r"licensed under the eupl version 1 2"),
    ("eupl-1.2", "european", 2, 0.95, r"european union public licence v 1 2"),
    ("odbl-1", "database", 2, 0.95, r"open data commons open database license(?: odbl)?"),
    ("odc-by-1", "attribution", 2, 0.95, r"open data commons attribution license"),
    ("cc0-1", "waived", 1, 0.98, r"has waived all copyright and related or neighboring rights to"),
    ("cc0-1", "publicdomain", 2, 0.95, r"creativecommons org publicdomain zero 1 0"),
    ("cc0-1", "cc0", 2, 0.95, r"cc0 1 0 universal"),
    ("cc-by-nc-nd", "creativecommons", 1, 0.98, r"creativecommons org licenses by nc nd [234] [05]"),
    ("cc-by-nc-sa", "creativecommons", 1, 0.98, r"creativecommons org licenses by nc sa [234] [05]"),
    ("cc-by-nc", "creativecommons", 2, 0.95, r"creativecommons org licenses by nc [234] [05]"),
    ("cc-by-nd", "creativecommons", 2, 0.95, r"creativecommons org licenses by nd [234] [05]"),
    ("cc-by-sa", "creativecommons", 2, 0.95, r"creativecommons org licenses by sa [234] [05]"),
    ("cc-by", "creativecommons", 3, 0.9, r"creativecommons org licenses by [234] [05]"),
    ("cc-by-nc-nd", "noderivatives", 2, 0.95, r"attribution noncommercial noderivatives [34] 0 international"),
    ("cc-by-nc-sa", "sharealike", 2, 0.95, r"attribution noncommercial sharealike [34] 0 international"),
    ("cc-by-nc", "noncommercial", 3, 0.9, r"attribution noncommercial [34] 0 international"),
    ("cc-by-sa", "sharealike", 3, 0.9, r"attribution sharealike [34] 0 international"),
    ("cc-by", "attribution", 4, 0.85, r"creative commons attribution [34] 0 international(?: license)?"),
    ("commons-clause", "clause", 2, 0.95, r"commons clause license condition v1 0"),
    ("sspl-1", "sspl", 2, 0.95, r"server side public license(?: version 1)? sspl"),
    ("busl-1.1", "business", 2, 0.95, r"business source license 1 1"),
    ("elastic-2", "elastic", 2, 0.95, r"elastic license 2 0"),
    ("json", "evil", 2, 0.95, r"the software shall be used for good not evil"),
    ("ecl-2", "educational", 2, 0.95, r"educational community license version 2 0"),
    ("afl-3", "academic", 2, 0.95, r"academic free license version 3 0"),
    ("osl-3", "open", 2, 0.95, r"open software license version 3 0"),
    ("qpl-1", "q", 2, 0.95, r"the q public license version 1 0"),
    ("vim", "vim", 2, 0.95, r"vim charityware|the vim license"),
    ("ruby", "ruby", 2, 0.95, r"under the same terms as ruby|the ruby license"),
    ("openldap", "openldap", 2, 0.95, r"the openldap public license"),
    ("postgresql", "postgresql", 2, 0.95, r"released under the postgresql licen[cs]e"),
    ("ncsa", "ncsa", 2, 0.95, r"university of illinois ncsa open source license"),
    ("w3c", "w3c", 2, 0.95, r"w3c software notice and license"),
    ("upl-1", "universal", 2, 0.95, r"universal permissive license(?: v)? 1 0"),
    ("icu", "unicode", 2, 0.95, r"unicode (?:inc )?license agreement data files and software"),
    ("proprietary", "confidential", 5, 0.6, r"confidential and proprietary"),
    ("proprietary", "unauthorized", 3, 0.85, r"unauthorized copying of this file via any medium is strictly prohibited"),
]


def _named() -> list[tuple]:
    return [(p, c, label, word, rf"(?<= ){way.format(name)}(?= )") for label, word, name in NAMES for p, c, way in WAYS]


#: (priority, confidence, label, keyword, pattern): license wording, and every way to name every license.
RULES = [(p, c, label, word, rf"(?<= )(?:{x})(?= )") for label, word, p, c, x in WORDING] + _named()


def _gate(word: str) -> str:
    """What stands in every padded text of words that has the keyword."""
    return f" {word} ".replace(" *", "").replace("* ", "")


def _rules() -> Column:
    """Rules by keyword: a keyword is looked for once."""
    by: dict[str, list[tuple]] = {}
    for p, c, label, word, x in RULES:
        by.setdefault(_gate(word), []).append((p, c, label, x))
    one = lambda p, c, la, x: F.struct(F.lit(p).alias("p"), F.lit(c).alias("c"), F.lit(la).alias("label"), F.lit(x).alias("regex"))
    return F.array(*(F.struct(F.lit(w).alias("word"), F.array(*(one(*r) for r in rules)).alias("rules")) for w, rules in by.items()))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _intervals(padded: Column, r: Column) -> Column:
    """Detections of one rule: (start, -end, priority, label, confidence), in characters."""
    between = F.split(padded, r["regex"], -1)
    found = F.regexp_extract_all(padded, r["regex"], F.lit(0))
    empty = F.lit(None).cast("array<struct<start:int,back:int,p:int,label:string,c:double>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,back:int,p:int,label:string,c:double>>")).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        one = F.struct(a.alias("start"), (-b).alias("back"), r["p"].alias("p"), r["label"].alias("label"), r["c"].alias("c"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _survivors(found: Column) -> Column:
    """Detections in order of start, after suppression: first those inside another go (of equal ones the better
    priority stays), then, from the best priority on and on ties from the earliest, those that overlap one that stays."""
    kind = "array<struct<start:int,back:int,p:int,label:string,c:double>>"
    none = F.array().cast(kind)
    # by start, longest first: one inside another comes after it
    outer = F.aggregate(
        F.sort_array(found),
        F.struct(F.lit(-1).alias("end"), none.alias("kept")),
        lambda acc, d: F.when(-d["back"] > acc["end"], F.struct((-d["back"]).alias("end"), F.concat(acc["kept"], F.array(d)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    ranked = F.sort_array(F.transform(outer, lambda d: F.struct(d["p"].alias("rank"), d["start"].alias("at"), d.alias("d"))))
    overlaps = lambda d: lambda k: (k["start"] < -d["back"]) & (d["start"] < -k["back"])
    kept = F.aggregate(ranked, none, lambda kept, r: F.when(F.exists(kept, overlaps(r["d"])), kept).otherwise(F.concat(kept, F.array(r["d"]))))
    return F.sort_array(kept)


def _words(clean: Column) -> Column:
    """How many words a text has that is its words with one space between."""
    return F.when(clean == "", F.lit(0).cast("long")).otherwise((F.octet_length(clean) - F.octet_length(F.replace(clean, F.lit(" "), F.lit(""))) + 1).cast("long"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections."""
    docs = store.without(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections", "__low", "__clean", "__norm", "__stems", "__gate", "__found", "__base")
    names = docs.columns
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), CAPITALS, SMALL)
    df = docs.withColumn("__low", lowered).withColumn("__clean", F.trim(F.regexp_replace("__low", GAP, " "))).withColumn("n_words", _words(F.col("__clean")))
    stems = F.lit(False)
    for s in STEMS:
        stems = stems | F.contains(F.col("__low"), F.lit(s))
    spaced = [GAP.join(p.split(" ")) for p, _ in BASE]
    phrases = F.lit(False)
    for p in spaced:
        phrases = phrases | F.col("__low").rlike(p)
    df = df.withColumn("__stems", stems).withColumn("__gate", F.col("__stems") | phrases)
    padded = F.concat(F.lit(" "), F.col("__clean"), F.lit(" "))
    df = df.withColumn("__norm", F.when(F.col("__gate"), padded))
    for k, (p, _) in enumerate(BASE):
        parts = F.split(F.col("__norm"), F.lit(rf"(?<= ){p}(?= )"), -1)
        df = df.withColumn(f"__parts{k}", F.when(F.contains(F.col("__norm"), F.lit(f" {p} ")), parts))
    count, first, last, labels = F.lit(0), [], [], []
    for k, (p, label) in enumerate(BASE):
        parts = F.col(f"__parts{k}")
        count = count + F.coalesce(F.size(parts) - 1, F.lit(0))
        first.append(_spaces(F.element_at(parts, 1)) - 1)
        last.append(F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - len(p.split(" ")))
        labels.append(F.when(parts.isNotNull(), F.lit(label)))
    base = F.array_compact(F.array(*labels))
    ran = F.flatten(F.transform(F.filter(_rules(), lambda g: F.contains(F.col("__norm"), g["word"])), lambda g: g["rules"]))
    found = F.flatten(F.transform(ran, lambda r: _intervals(F.col("__norm"), r)))
    df = df.withColumn("__found", F.when(F.col("__stems"), _survivors(found)))
    df = df.withColumn("__base", base)
    more = F.coalesce(F.transform("__found", lambda d: d["label"]), F.array().cast("array<string>"))
    sure = F.coalesce(F.array_max(F.transform("__found", lambda d: d["c"])), F.lit(0.0))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    detections = F.transform("__found", lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["p"].alias("priority")))
    return df.select(
        *names,
        "n_words",
        count.cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        join(F.col("__base")).alias("base_labels"),
        join(F.concat("__base", more)).alias("labels"),
        F.greatest(sure, F.when(F.size("__base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0)).alias("score"),
        detections.alias("detections"),
    )
