"""License scans: ordered signature rules, gated by keywords, with priority and interval containment.

A-Z of a text become lower case and it is cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Rules are regular expressions over
the words joined by one space, and match whole words. A rule runs only on texts that have its keyword among their words, by itself
or, for abbreviations, with a version's first digit joined to it (GPLv2, LGPL3). A detection that lies inside a kept
one of the same or a higher priority is suppressed. Four base phrases are counted besides; their labels always stay.

Scanning is one pass without a shuffle and without state between texts. Defined results: a null text counts as empty; with no
base phrase first_word and last_word are null; with no label the label strings are empty; repeated rows each get a row; of detections alike in priority
and length the first in the text, then in the alphabet, comes first; a long text is scanned whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.common import FOLD, by_chunk, small_batches, tidy

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, a word that every mention has, and a regular expression for the licence's name without "license" or a version.
NAMES = [
    ("gpl", "gnu", "gnu (?:general public|gpl)"),
    ("gpl", "gpl", "gpl"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public"),
    ("lgpl", "lgpl", "lgpl"),
    ("agpl", "gnu", "gnu affero general public"),
    ("agpl", "agpl", "agpl"),
    ("gfdl", "gnu", "gnu free documentation"),
    ("apache", "apache", "apache(?: software)?"),
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("x11", "x11", "x11"),
    ("bsd", "bsd", "(?:new |modified |revised |simplified |original )?bsd"),
    ("bsd", "freebsd", "freebsd"),
    ("isc", "isc", "isc"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl", "mpl", "mpl"),
    ("epl", "eclipse", "eclipse public"),
    ("epl", "epl", "epl"),
    ("cddl", "cddl", "cddl"),
    ("cddl", "distribution", "common development and distribution"),
    ("cpl", "public", "common public"),
    ("eupl", "eupl", "eupl"),
    ("eupl", "european", "european union public"),
    ("artistic", "artistic", "artistic"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost", "boost", "boost software"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("psf", "python", "python software foundation"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa"),
    ("ofl", "ofl", "(?:sil )?ofl"),
    ("ofl", "font", "sil open font"),
    ("odbl", "odbl", "odbl"),
    ("odbl", "database", "open database"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("cecill", "cecill", "cecill"),
    ("afl", "academic", "academic free"),
    ("osl", "osl", "osl"),
    ("cc0", "cc0", "cc0"),
    ("cc-by", "cc", "cc by"),
    ("cc-by-sa", "cc", "cc by sa"),
    ("cc-by-nc", "cc", "cc by nc"),
    ("cc-by-nd", "cc", "cc by nd"),
    ("cc-by-nc-sa", "cc", "cc by nc sa"),
    ("cc-by-nc-nd", "cc", "cc by nc nd"),
    ("cc-by", "creative", "creative commons attribution"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
]
#: Keywords that a version may be joined to.
ABBREVIATIONS = ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "osl", "ofl", "cecill")
#: A version after a space, and one that may be joined to the word before.
_SPACED, _JOINED = r"(?: (?:version |ver |v ?)?(\d(?: \d)?))", r"(?:(?: (?:version |ver |v ?)?|v?)(\d(?: \d)?))"
_END = "(?:licen[cs]e)"
#: Priority, weight and form of a rule; NAME is a name, VERSION a version after it. Later suffixes of a label come from the version.
FORMS = [
    (50, 0.99, r"spdx license identifier NAMEVERSION?(?: (only|or later))?"),
    (40, 0.95, rf"(?:licen[cs]ed|released|distributed|published|available|provided|made available) (?:under|with)(?: the)?(?: terms of)?(?: the)? NAME(?: {_END}{_SPACED}?|VERSION)?(?: (only|or(?: at your option)? any later version|or later))?"),
    (30, 0.90, rf"(?:terms|conditions|text|copy) of the NAME {_END}{_SPACED}?"),
    (20, 0.85, rf"NAME {_END}{_SPACED}(?: (only|or later))?"),
    (20, 0.80, r"NAMEVERSION(?: (only|or later))?"),
    (10, 0.70, rf"NAME {_END}"),
]
#: Label, keyword, priority, weight and pattern of texts that name no licence.
PLAIN = [
    ("mit", "permission", 35, 0.95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 35, 0.95, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", 35, 0.95, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "warranty", 35, 0.95, "this software is provided as is without any express or implied warranty"),
    ("unlicense", "unencumbered", 35, 0.95, "this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", 15, 0.6, "(?:in|into|to) the public domain"),
    ("public-domain", "dedicated", 35, 0.9, "dedicated to the public domain"),
    ("proprietary", "reserved", 15, 0.6, "all rights reserved"),
    ("proprietary", "confidential", 15, 0.6, "proprietary and confidential"),
    ("proprietary", "unauthorized", 15, 0.6, "unauthorized copying (?:of this file )?is (?:strictly )?prohibited"),
]
_LATER = r"(?: (or at your option any later version|or any later version|or later|only))?"
_FSF = "as published by the free software foundation"
#: Written by hand: label, keyword, priority, weight and pattern of notices, licence bodies, SPDX names and short names. A number in a group is a
#: version, "later" and "only" in a group say which versions else.
SIGNATURES = [
    # Notices and bodies of the GNU licences.
    ("gpl", "gnu", 45, 0.99, rf"under the terms of the gnu general public license {_FSF} (?:either )?version (\d(?: \d)?) of the license{_LATER}"),
    ("lgpl", "gnu", 45, 0.99, rf"under the terms of the gnu (?:lesser|library) general public license {_FSF} (?:either )?version (\d(?: \d)?) of the license{_LATER}"),
    ("agpl", "gnu", 45, 0.99, rf"under the terms of the gnu affero general public license {_FSF} (?:either )?version (\d(?: \d)?) of the license{_LATER}"),
    ("gpl", "gnu", 44, 0.98, rf"under the terms of (?:the )?gnu (?:general public license|gpl) (?:version |v ?)(\d(?: \d)?) {_FSF}"),
    ("gpl", "gnu", 44, 0.97, r"you should have received a copy of the gnu general public license"),
    ("lgpl", "gnu", 44, 0.97, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "gnu", 44, 0.97, r"you should have received a copy of the gnu affero general public license"),
    ("gpl", "gnu", 46, 0.99, r"gnu general public license version (\d) (?:june|29 june) (?:1991|2007)"),
    ("lgpl", "gnu", 46, 0.99, r"gnu (?:lesser|library) general public license version (\d(?: \d)?) (?:june|february|29 june) (?:1991|1999|2007)"),
    ("agpl", "gnu", 46, 0.99, r"gnu affero general public license version (\d) 19 november 2007"),
    ("gpl", "freedom", 43, 0.95, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "copyleft", 43, 0.95, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl", "affero", 43, 0.95, r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", "gnu", 45, 0.99, r"under the terms of the gnu free documentation license version (\d(?: \d)?)(?: (or any later version))?"),
    ("gfdl", "invariant", 36, 0.9, r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("gpl-with-linking-exception", "permission", 47, 0.9, r"as a special exception the copyright holders of this (?:library|program) give you permission to link"),
    ("gpl-with-classpath-exception", "classpath", 47, 0.95, r"(?:gnu )?classpath exception"),
    ("gpl-with-autoconf-exception", "configure", 47, 0.9, r"this configure script is free software the free software foundation gives unlimited permission to copy"),
    ("fsf-all-permissive", "royalty", 36, 0.9, r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("gpl", "copyleft", 12, 0.5, r"(?:strong )?copyleft licen[cs]e"),
    ("gpl", "gpl", 26, 0.9, r"gnu gpl(?: v ?(\d))?"),
    # Apache.
    ("apache-2.0", "apache", 45, 0.99, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", 46, 0.99, r"apache license version 2 0 january 2004"),
    ("apache-2.0", "contributor", 43, 0.95, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "apache", 43, 0.95, r"the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-1.1", "apache", 45, 0.95, r"the apache software license version 1 1"),
    ("apache-2.0", "asl", 26, 0.85, r"asl 2(?: 0)?"),
    ("apache-2.0", "apache2", 26, 0.9, r"apache2(?: licen[cs]ed?)?"),
    ("apache", "apache", 27, 0.9, r"apache(?: (\d(?: \d)?))? licensed"),
    ("apache", "asf", 36, 0.9, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    # MIT and its relatives.
    ("mit", "sublicense", 43, 0.97, r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "portions", 41, 0.95, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "mit", 26, 0.9, r"mit licen[cs]ed"),
    ("mit", "mit", 26, 0.85, r"mit style(?: licen[cs]e)?"),
    ("mit", "mit", 26, 0.85, r"mit x11(?: licen[cs]e)?"),
    ("mit", "mit", 26, 0.85, r"mit expat(?: licen[cs]e)?"),
    ("mit", "mit", 28, 0.9, r"licen[cs]e mit"),
    ("mit", "mit", 28, 0.95, r"the mit license mit"),
    ("mit-0", "mit", 29, 0.95, r"mit no attribution(?: licen[cs]e)?"),
    ("mit-0", "mit", 51, 0.99, r"spdx license identifier mit 0"),
    ("x11", "consortium", 43, 0.95, r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("hpnd", "advertising", 36, 0.85, r"shall not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("hpnd", "granted", 36, 0.9, r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("ntp", "suitability", 36, 0.85, r"makes no representations about the suitability (?:of )?this software for any purpose"),
    # BSD.
    ("bsd-3-clause", "endorse", 43, 0.95, r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", 42, 0.9, r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 43, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "binary", 38, 0.85, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-2-clause", "redistributions", 37, 0.85, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause-clear", "patent", 43, 0.9, r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("0bsd", "0bsd", 26, 0.95, r"0bsd"),
    ("0bsd", "bsd", 29, 0.95, r"bsd zero clause(?: licen[cs]e)?"),
    ("bsd-1-clause", "bsd", 29, 0.95, r"bsd (?:1|one) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", 29, 0.95, r"bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", 29, 0.95, r"bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", 29, 0.95, r"bsd (?:4|four) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", 29, 0.95, r"(?:2|two) clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", 29, 0.95, r"(?:3|three) clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", 29, 0.95, r"(?:4|four) clause bsd(?: licen[cs]e)?"),
    ("bsd", "bsd", 26, 0.8, r"bsd (?:style|type|like)(?: licen[cs]e)?"),
    ("bsd", "bsd", 26, 0.85, r"bsd licensed"),
    ("bsd-2-clause-patent", "bsd", 30, 0.95, r"bsd (?:2 clause plus patent|plus patent)(?: licen[cs]e)?"),
    # Other permissive licences.
    ("isc", "isc", 26, 0.85, r"isc licensed"),
    ("zlib", "altered", 43, 0.95, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", 42, 0.95, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png", 36, 0.85, r"the png reference library is supplied as is"),
    ("boost-1.0", "boost", 46, 0.99, r"boost software license version 1 0 august 17th 2003"),
    ("boost-1.0", "boost", 45, 0.99, r"distributed under the boost software license version 1 0"),
    ("boost-1.0", "bsl", 26, 0.8, r"bsl 1 0"),
    ("unlicense", "unlicense", 36, 0.95, r"for more information please refer to (?:https? )?unlicense org"),
    ("unlicense", "anyone", 42, 0.95, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "public", 43, 0.95, r"do what the fuck you want to public license"),
    ("beerware", "beer", 43, 0.95, r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("beerware", "beerware", 26, 0.9, r"(?:the )?beerware licen[cs]e"),
    ("curl", "curl", 26, 0.8, r"curl license"),
    ("openssl", "openssl", 43, 0.95, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", 43, 0.9, r"this product includes cryptographic software written by eric young"),
    ("php", "php", 43, 0.95, r"php license version (\d(?: \d\d)?)"),
    ("php", "php", 42, 0.9, r"this product includes php software freely available from"),
    ("zend", "zend", 43, 0.9, r"this product includes the zend engine freely available at"),
    ("psf-2", "python", 43, 0.95, r"python software foundation license version 2"),
    ("psf", "psf", 42, 0.95, r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    ("ncsa", "illinois", 43, 0.95, r"neither the names of the llvm team university of illinois at urbana champaign"),
    ("ncsa", "illinois", 26, 0.9, r"university of illinois open source license"),
    ("postgresql", "california", 43, 0.9, r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("tcl", "tcl", 36, 0.85, r"tcl tk license"),
    ("unicode", "unicode", 43, 0.9, r"unicode (?:data files and software|license agreement) data files and software"),
    ("unicode", "unicode", 26, 0.85, r"unicode license v ?(\d)"),
    ("icu", "icu", 26, 0.85, r"icu license"),
    ("w3c", "w3c", 43, 0.9, r"w3c software (?:notice and license|and document (?:notice and )?license)"),
    ("w3c", "w3c", 26, 0.8, r"w3c license"),
    ("ofl-1.1", "font", 46, 0.99, r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "font", 43, 0.9, r"the font software may be sold as part of a larger software package but no copy of one or more"),
    ("bitstream-vera", "bitstream", 43, 0.9, r"bitstream vera is a trademark of bitstream inc"),
    ("artistic-2.0", "artistic", 46, 0.98, r"the artistic license 2 0"),
    ("artistic-1.0", "artistic", 45, 0.95, r"the artistic license preamble the intent of this document is to state the conditions"),
    ("perl", "perl", 43, 0.95, r"under the same terms as perl(?: \d)? itself"),
    ("ruby", "ruby", 43, 0.95, r"under the same terms as ruby(?: itself)?"),
    ("vim", "vim", 36, 0.9, r"vim is charityware"),
    ("vim", "vim", 26, 0.85, r"vim license"),
    ("naumen", "naumen", 26, 0.9, r"naumen public license"),
    ("zpl", "zope", 43, 0.95, r"zope public license(?: zpl)? version (\d(?: \d)?)"),
    ("zpl", "zope", 26, 0.9, r"zope public license"),
    ("intel-acpi", "intel", 36, 0.7, r"intel grants recipient a non exclusive copyright license"),
    ("blueoak-1.0.0", "blue", 43, 0.95, r"blue oak model license(?: 1 0 0)?"),
    ("upl-1.0", "universal", 43, 0.95, r"the universal permissive license upl version 1 0"),
    ("upl-1.0", "upl", 26, 0.85, r"upl 1 0"),
    ("mulan-psl-2", "mulan", 43, 0.95, r"mulan psl v ?2"),
    ("mulan-psl", "mulan", 26, 0.9, r"mulan permissive software licen[cs]e"),
    # Weak copyleft.
    ("mpl-2.0", "mozilla", 46, 0.99, r"this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("mpl-1.1", "mozilla", 46, 0.99, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mpl", 43, 0.95, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-2.0", "eclipse", 46, 0.99, r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("epl-1.0", "eclipse", 46, 0.99, r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0"),
    ("epl", "eclipse", 36, 0.9, r"the accompanying program is provided under the terms of this eclipse public license"),
    ("edl-1.0", "eclipse", 43, 0.95, r"eclipse distribution license v? ?1 0"),
    ("cddl", "distribution", 43, 0.95, r"the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license"),
    ("cpl-1.0", "common", 45, 0.95, r"common public license version 1 0"),
    ("ipl-1.0", "ibm", 45, 0.95, r"ibm public license version 1 0"),
    ("apsl", "apple", 45, 0.95, r"subject to the apple public source license version (\d(?: \d)?)"),
    ("ms-pl", "microsoft", 45, 0.95, r"microsoft public license ms pl"),
    ("ms-rl", "microsoft", 45, 0.95, r"microsoft reciprocal license(?: ms rl)?"),
    ("nposl", "profit", 45, 0.9, r"non profit open software license(?: osl)? (?:version )?(\d \d)"),
    ("osl", "open", 43, 0.9, r"licensed under the open software license version (\d \d)"),
    ("afl", "academic", 43, 0.95, r"licensed under the academic free license version (\d \d)"),
    ("eupl", "eupl", 46, 0.98, r"licensed under the eupl version (\d \d)(?: (or as soon they will be approved by the european commission later versions))?"),
    ("cecill", "cecill", 45, 0.95, r"governed by the cecill(?: [bc])? license under french law"),
    ("qpl-1.0", "q", 43, 0.95, r"the q public license version 1 0"),
    ("sleepycat", "sleepycat", 26, 0.9, r"sleepycat license"),
    ("lppl", "latex", 43, 0.95, r"under the conditions of the latex project public license(?: either version (\d \d) of this license)?(?: (or at your option any later version))?"),
    ("lppl", "lppl", 26, 0.9, r"lppl(?: v?ersion)?(?: v? ?(\d \d))?"),
    ("netscape", "netscape", 43, 0.9, r"netscape public license(?: version (\d \d))?"),
    ("sun-bcl", "sun", 36, 0.85, r"sun microsystems inc binary code license agreement"),
    ("spl", "sun", 36, 0.85, r"sun public license(?: version (\d \d))?"),
    ("rpl", "reciprocal", 43, 0.9, r"reciprocal public license(?: version)?(?: (\d \d))?"),
    ("cpal-1.0", "attribution", 43, 0.95, r"common public attribution license(?: version)?(?: 1 0)?"),
    ("simpl", "simple", 36, 0.8, r"simple public license(?: (\d \d))?"),
    # Creative Commons and data.
    ("cc0-1.0", "cc0", 46, 0.98, r"cc0 1 0 universal(?: public domain dedication)?"),
    ("cc0-1.0", "waived", 43, 0.95, r"has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "creative", 45, 0.97, r"this work is licensed under (?:a|the) creative commons attribution (?:(\d \d) )?(?:international|unported|generic)? ?licen[cs]e"),
    ("cc-by-sa", "creative", 46, 0.97, r"creative commons attribution share ?alike (\d \d)(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    ("cc-by-nc", "creative", 46, 0.97, r"creative commons attribution non ?commercial (\d \d)(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    ("cc-by-nd", "creative", 46, 0.97, r"creative commons attribution no ?deriv(?:ative)?s (\d \d)(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "creative", 47, 0.97, r"creative commons attribution non ?commercial share ?alike (\d \d)(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", "creative", 47, 0.97, r"creative commons attribution non ?commercial no ?deriv(?:ative)?s (\d \d)(?: (?:international|unported|generic))?(?: licen[cs]e)?"),
    ("cc-by", "creativecommons", 36, 0.95, r"creativecommons org licenses by (\d \d)"),
    ("cc-by-sa", "creativecommons", 36, 0.95, r"creativecommons org licenses by sa (\d \d)"),
    ("cc-by-nc", "creativecommons", 36, 0.95, r"creativecommons org licenses by nc (\d \d)"),
    ("cc-by-nd", "creativecommons", 36, 0.95, r"creativecommons org licenses by nd (\d \d)"),
    ("cc-by-nc-sa", "creativecommons", 36, 0.95, r"creativecommons org licenses by nc sa (\d \d)"),
    ("cc-by-nc-nd", "creativecommons", 36, 0.95, r"creativecommons org licenses by nc nd (\d \d)"),
    ("cc0", "creativecommons", 36, 0.95, r"creativecommons org publicdomain zero (\d \d)"),
    ("public-domain", "creativecommons", 36, 0.9, r"creativecommons org publicdomain mark 1 0"),
    ("cc-pdm", "mark", 26, 0.85, r"public domain mark 1 0"),
    ("odbl-1.0", "database", 46, 0.97, r"made available under the open database license"),
    ("odc-by", "commons", 43, 0.95, r"open data commons attribution license(?: v ?(\d \d))?"),
    ("pddl", "commons", 43, 0.95, r"open data commons public domain dedication and licen[cs]e"),
    ("ogl-uk", "government", 43, 0.9, r"open government licence(?: v? ?(\d(?: \d)?))?"),
    ("cdla-permissive", "data", 43, 0.95, r"community data license agreement permissive(?: version)?(?: (\d \d))?"),
    ("cdla-sharing", "data", 43, 0.95, r"community data license agreement sharing(?: version)?(?: (\d \d))?"),
    ("etalab", "etalab", 26, 0.9, r"licence ouverte (?:open licence )?etalab"),
    ("free-art", "art", 43, 0.9, r"free art licen[cs]e(?: (\d \d))?"),
    # Source available, network and model licences.
    ("sspl-1.0", "side", 43, 0.95, r"server side public license(?: version 1)?"),
    ("bsl-1.1", "business", 45, 0.95, r"business source license 1 1"),
    ("elastic-2.0", "elastic", 43, 0.95, r"elastic license 2 0"),
    ("commons-clause", "commons", 43, 0.95, r"commons clause(?: license condition)?"),
    ("polyform", "polyform", 43, 0.95, r"polyform (?:noncommercial|small business|shield|strict|internal use|perimeter) license(?: (\d \d \d))?"),
    ("prosperity", "prosperity", 26, 0.9, r"prosperity public license"),
    ("parity", "parity", 26, 0.9, r"parity public license"),
    ("confluent", "confluent", 26, 0.9, r"confluent community license"),
    ("redis-source-available", "redis", 43, 0.9, r"redis source available license"),
    ("hippocratic", "hippocratic", 26, 0.9, r"hippocratic license"),
    ("anti-996", "996", 26, 0.9, r"anti 996 license"),
    ("json", "evil", 43, 0.95, r"the software shall be used for good not evil"),
    ("openrail", "openrail", 26, 0.9, r"(?:creativeml )?(?:bigscience )?openrail(?: m)?"),
    ("openrail", "responsible", 26, 0.85, r"responsible ai license"),
    ("llama", "llama", 43, 0.95, r"llama (?:(\d(?: \d)?) )?community license(?: agreement)?"),
    # Terms that aren't open licences.
    ("proprietary", "end", 16, 0.6, r"end user licen[cs]e agreement(?: eula)?"),
    ("proprietary", "reserves", 16, 0.6, r"reserves all rights not expressly granted"),
    ("proprietary", "trade", 16, 0.6, r"trade secrets? (?:and|or) (?:may|must|shall) not (?:be )?disclosed?"),
    ("proprietary", "reproduced", 16, 0.6, r"no part of this (?:publication|document|work|book) may be reproduced"),
    ("proprietary", "redistribute", 16, 0.6, r"you may not (?:copy modify or )?redistribute"),
    ("proprietary", "commercial", 16, 0.55, r"for (?:personal|internal) (?:and )?non commercial use only"),
    ("freeware", "freeware", 14, 0.5, r"freeware"),
    ("shareware", "shareware", 14, 0.5, r"shareware"),
    ("us-government-work", "government", 36, 0.8, r"(?:is )?a work of the (?:u s|united states) government"),
    ("public-domain", "domain", 36, 0.85, r"(?:is|are|was|been) (?:hereby )?(?:placed|released|put) (?:in|into) the public domain"),
]
#: Names that are also ordinary words count only with "license", after "licensed under" or with a version joined to them.
_WORDS = {"mit", "expat", "bsd", "freebsd", "isc", "mpl", "epl", "php", "ruby", "python", "boost", "artistic", "x11", "openssl", "postgresql", "osl", "ofl", "cc", "apache"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    priority: int
    weight: float
    pattern: re.Pattern


def _whole(form: str) -> re.Pattern:
    """A pattern that begins and ends where words do, also where a shorter match does."""
    return re.compile(rf"(?<![^ ])(?:{form})(?![^ ])".encode())


def rules() -> list[Rule]:
    """The signatures, the plain texts, and every name in every form that suits it: some five hundred, highest priority first."""
    made = [Rule(label, key.encode(), p, w, _whole(form)) for label, key, p, w, form in [*SIGNATURES, *PLAIN]]
    for label, key, name in NAMES:
        version = _JOINED if key in ABBREVIATIONS else _SPACED
        for p, w, form in FORMS:
            own = version
            if key in _WORDS and form.startswith("NAME") and "licen" not in form and not label.startswith("cc"):
                if key not in ABBREVIATIONS:
                    continue
                own = r"(?:v?(\d(?: \d)?))"
            made.append(Rule(label, key.encode(), p, w, _whole(form.replace("VERSION", own).replace("NAME", name))))
    return sorted(made, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


class Scanner:
    """Finds base phrases and licences in texts."""

    def __init__(self) -> None:
        self.by_keyword: dict[bytes, list[Rule]] = {}
        for rule in rules():
            self.by_keyword.setdefault(rule.keyword, []).append(rule)
        self.base = [(phrase.encode(), label) for phrase, label in BASE.items()]
        #: Words that open the gate, with the keyword that each stands for.
        self.words = {key: key for key in self.by_keyword} | {phrase.split()[0]: phrase.split()[0] for phrase, _ in self.base}
        self.words |= {f"{key}{v}{digit}".encode(): key.encode() for key in ABBREVIATIONS for v in ("", "v") for digit in range(10)}
        self.gate = frozenset(self.words)

    def base_places(self, line: bytes) -> list[tuple[int, str]]:
        """Where in the joined words a base phrase stands."""
        found = []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                end = at + len(phrase)
                if (at == 0 or line[at - 1] == 32) and (end == len(line) or line[end] == 32):
                    found.append((at, label))
                at = line.find(phrase, at + 1)
        return found

    def detections(self, line: bytes, keys: set[bytes]) -> list[tuple[int, int, Rule, str]]:
        """What the rules find and containment leaves: start, end, rule and label."""
        found = []
        for key in sorted(keys):
            for rule in self.by_keyword.get(key, ()):
                for m in rule.pattern.finditer(line):
                    lo, hi = m.span()
                    parts = [g.decode() for g in m.groups() if g]
                    version = next((g.replace(" ", ".") for g in parts if g[0].isdigit()), "")
                    later = "-or-later" if any("later" in g for g in parts) else "-only" if "only" in parts else ""
                    found.append((lo, hi, rule, rule.label + (f"-{version}" if version else "") + later))
        found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[3]))
        kept: list[tuple[int, int, Rule, str]] = []
        spans: list[tuple[int, int]] = []  # kept intervals that lie in no other, by start: their ends rise too
        for d in found:
            at = bisect_right(spans, (d[0], 1 << 62)) - 1
            if at >= 0 and spans[at][1] >= d[1]:
                continue
            kept.append(d)
            lo = at + 1
            hi = lo
            while hi < len(spans) and spans[hi][1] <= d[1]:
                hi += 1
            lo -= at >= 0 and spans[at][0] == d[0]
            spans[lo:hi] = [(d[0], d[1])]
        return kept

    def scan(self, raw: bytes | None) -> tuple:
        words = (raw or b"").translate(FOLD).split()
        if self.gate.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0
        keys, line = {self.words[w] for w in self.gate.intersection(words)}, b" ".join(words)
        places = self.base_places(line)
        found = self.detections(line, keys)
        base, rest = {label for _, label in places}, 1.0
        labels = base | {label for *_, label in found}
        for label in labels:
            rest *= 1 - max((rule.weight for _, _, rule, own in found if own == label), default=0.7)
        starts = [line.count(b" ", 0, at) for at in (min(places)[0], max(places)[0])] if places else [None, None]
        return len(words), len(places), *starts, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - rest


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (how sure a licence is named) of every row."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()

        def work(batch: pa.RecordBatch, raws: list[bytes | None]) -> pa.RecordBatch:
            made = zip(*map(scanner.scan, raws), strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, type=k) for x, k in zip(made, kinds, strict=True))], names=["doc_id", *names])

        return by_chunk(batches, "text", work)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
