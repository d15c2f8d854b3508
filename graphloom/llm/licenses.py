"""License scans by ordered signature rules.

Hundreds of regular expressions, each behind a keyword that is part of all it matches, give intervals. Taken by rank
(priority, then length, then start) an interval stays unless one that stays already covers part of it. Built-in
functions only, row by row: no shuffle.
"""

from __future__ import annotations

import functools
import operator
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str  # of lower-case text
    priority: int  # the smaller, the better
    weight: float


# Label, keyword, name as a pattern, SPDX id, address.
FAMILIES = (
    ("mit", "mit", r"(?:mit|expat)(?:/x11)?", "mit", "opensource.org/licenses/mit"),
    ("mit-0", "mit", r"mit no attribution", "mit-0", "opensource.org/licenses/mit-0"),
    ("x11", "x11", r"x11", "x11", "www.xfree86.org/3.3.6/copyright2.html"),
    ("isc", "isc", r"isc", "isc", "opensource.org/licenses/isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2[- ]clause|two[- ]clause|freebsd) bsd|bsd[- ]2[- ]clause", "bsd-2-clause", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3[- ]clause|three[- ]clause) bsd|bsd[- ]3[- ]clause", "bsd-3-clause", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4[- ]clause|four[- ]clause) bsd|bsd[- ]4[- ]clause", "bsd-4-clause", "spdx.org/licenses/bsd-4-clause"),
    ("bsd", "bsd", r"bsd(?:[- ]style)?", "0bsd", "www.linfo.org/bsdlicense"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?1\.1", "apache-1.1", "apache.org/licenses/license-1.1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?2(?:\.0)?", "apache-2.0", "apache.org/licenses/license-2.0"),
    ("apache", "apache", r"apache(?: software)?", "apache", "apache.org/licenses"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)1(?:\.0)?", "gpl-1.0(?:-only|-or-later)?", "gnu.org/licenses/gpl-1.0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)2(?:\.0)?", "gpl-2.0(?:-only|-or-later)?", "gnu.org/licenses/(?:old-licenses/)?gpl-2.0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)3(?:\.0)?", "gpl-3.0(?:-only|-or-later)?", "gnu.org/licenses/gpl-3.0"),
    ("gpl", "general public", r"(?:gnu )?general public|gnu gpl", "gpl", "gnu.org/licenses/gpl"),
    ("lgpl-2.0", "general public", r"(?:gnu )?library general public licen[cs]e,? (?:version |v)2(?:\.0)?", "lgpl-2.0(?:-only|-or-later)?", "gnu.org/licenses/(?:old-licenses/)?lgpl-2.0"),
    ("lgpl-2.1", "general public", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)2\.1", "lgpl-2.1(?:-only|-or-later)?", "gnu.org/licenses/(?:old-licenses/)?lgpl-2.1"),
    ("lgpl-3.0", "general public", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)3(?:\.0)?", "lgpl-3.0(?:-only|-or-later)?", "gnu.org/licenses/lgpl-3.0"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public|gnu lgpl", "lgpl", "gnu.org/licenses/lgpl"),
    ("agpl-3.0", "general public", r"(?:gnu )?affero general public licen[cs]e,? (?:version |v)3(?:\.0)?", "agpl-3.0(?:-only|-or-later)?", "gnu.org/licenses/agpl-3.0"),
    ("agpl", "general public", r"(?:gnu )?affero general public|gnu agpl", "agpl", "gnu.org/licenses/agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation", "gfdl-1.[123](?:-only|-or-later)?", "gnu.org/licenses/fdl"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?1\.1", "mpl-1.1", "mozilla.org/mpl/1.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?2(?:\.0)?", "mpl-2.0", "mozilla.org/mpl/2.0"),
    ("mpl", "mozilla", r"mozilla public", "mpl", "mozilla.org/mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,? (?:version |v)?1(?:\.0)?", "epl-1.0", "eclipse.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,? (?:version |v)?2(?:\.0)?", "epl-2.0", "eclipse.org/legal/epl-2.0"),
    ("epl", "eclipse", r"eclipse public", "epl", "eclipse.org/legal/epl"),
    ("eupl", "european union", r"european union public", "eupl-1.[12]", "joinup.ec.europa.eu/collection/eupl"),
    ("cddl", "common development", r"common development and distribution", "cddl-1.[01]", "opensource.org/licenses/cddl"),
    ("cpl", "common public", r"common public", "cpl-1.0", "opensource.org/licenses/cpl"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?1(?:\.0)?", "artistic-1.0", "opensource.org/licenses/artistic-1.0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?2(?:\.0)?", "artistic-2.0", "opensource.org/licenses/artistic-2.0"),
    ("artistic", "artistic", r"(?:perl )?artistic", "artistic", "dev.perl.org/licenses/artistic"),
    ("boost", "boost", r"boost(?: software)?", "bsl-1.0", "boost.org/license_1_0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", "zlib", "opensource.org/licenses/zlib"),
    ("psf", "python", r"python software foundation|psf", "psf-2.0", "docs.python.org/3/license"),
    ("openssl", "openssl", r"openssl(?:[- ]ssleay)?", "openssl", "openssl.org/source/license"),
    ("php", "php", r"php", "php-3.0[1]?", "php.net/license"),
    ("ruby", "ruby", r"ruby", "ruby", "ruby-lang.org/en/about/license"),
    ("unlicense", "unlicense", r"unlicen[cs]e", "unlicense", "unlicense.org"),
    ("wtfpl", "want to public", r"do what the f.{1,4} you want to public", "wtfpl", "wtfpl.net"),
    ("ofl", "open font", r"(?:sil )?open font", "ofl-1.[01]", "scripts.sil.org/ofl"),
    ("odbl", "open database", r"open database", "odbl-1.0", "opendatacommons.org/licenses/odbl"),
    ("ms-pl", "microsoft", r"microsoft public", "ms-pl", "opensource.org/licenses/ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", "ms-rl", "opensource.org/licenses/ms-rl"),
    ("osl", "open software", r"open software", "osl-3.0", "opensource.org/licenses/osl-3.0"),
    ("afl", "academic", r"academic free", "afl-3.0", "opensource.org/licenses/afl-3.0"),
    ("ecl", "educational", r"educational community", "ecl-2.0", "opensource.org/licenses/ecl-2.0"),
    ("ncsa", "illinois", r"(?:university of )?illinois(?:/ncsa)? open source", "ncsa", "opensource.org/licenses/ncsa"),
    ("postgresql", "postgresql", r"postgresql", "postgresql", "postgresql.org/about/licence"),
    ("sspl", "server side", r"server side public", "sspl-1.0", "mongodb.com/licensing/server-side-public-license"),
    ("busl", "business source", r"business source", "busl-1.1", "mariadb.com/bsl11"),
)
#: Families with names that lack their keyword; a text must have what stands around the name instead.
OTHER_NAMES = ("mit", "gpl", "lgpl", "agpl", "psf", "unlicense")
# Parts of Creative Commons names.
CC_PARTS = {"by": "attribution", "sa": "share[- ]?alike", "nc": "non[- ]?commercial", "nd": "no[- ]?deriv(?:ative)?s(?: works)?"}
CC = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# What only stands in a licence's own text or notice: label and words. Blanks stand for any white space.
SIGNATURES = (
    ("mit", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("mit", r"without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies"),
    ("mit", r"warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit-0", r"mit no attribution"),
    ("x11", r"except as contained in this notice, the name of the x consortium shall not be used"),
    ("x11", r"the name of the x\.org foundation shall not be used"),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"the author disclaims all warranties with regard to this software"),
    ("isc", r"internet (?:systems|software) consortium,? inc\.? disclaims"),
    ("0bsd", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.[^a-z]{0,9}the software is provided"),
    ("bsd", r"redistribution and use in source and binary forms,? with or without modification"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", r"neither the name of .{1,90} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", r"the names? of .{1,60} may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", r"those of the authors and should not be interpreted as representing official policies"),
    ("bsd-2-clause-patent", r"bsd[- ]2[- ]clause plus patent"),
    ("bsd-source-code", r"must retain the copyright notice, this list of conditions and the disclaimer"),
    ("apache-2.0", r"you may not use (?:this file|these files) except in compliance with the licen[cs]e"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e is distributed on an"),
    ("apache-2.0", r"apache licen[cs]e,? version 2\.0, january 2004"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free"),
    ("apache-2.0", r"licensed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements"),
    ("apache-2.0", r"to apply the apache licen[cs]e to your work, attach the following boilerplate notice"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", r"this product includes software developed by the apache group"),
    ("gpl", r"this program is free software[:;,]? you can redistribute it and/or modify"),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e along with"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document, but changing it is not allowed"),
    ("gpl", r"the gnu general public licen[cs]e is intended to guarantee your freedom to share and change"),
    ("gpl-1.0", r"gnu general public licen[cs]e version 1, february 1989"),
    ("gpl-2.0", r"gnu general public licen[cs]e version 2, june 1991"),
    ("gpl-2.0", r"the gnu general public licen[cs]e version 2 as published by the free software foundation"),
    ("gpl-2.0-or-later", r"gnu general public licen[cs]e as published by the free software foundation[;,]? either version 2 of the licen[cs]e, or \(at your option\) any later version"),
    ("gpl-3.0", r"gnu general public licen[cs]e version 3, 29 june 2007"),
    ("gpl-3.0", r"the gnu general public licen[cs]e is a free, copyleft licen[cs]e for software and other kinds of works"),
    ("gpl-3.0-or-later", r"gnu general public licen[cs]e as published by the free software foundation[;,]? either version 3 of the licen[cs]e, or \(at your option\) any later version"),
    ("gpl-2.0-with-classpath-exception", r"link this library with independent modules to produce an executable"),
    ("gpl-2.0-with-classpath-exception", r"classpath exception"),
    ("gpl-3.0-with-gcc-exception", r"gcc runtime library exception"),
    ("gpl-2.0-with-font-exception", r"if you create a document which uses this font, and embed this font"),
    ("lgpl", r"this library is free software[:;,]? you can redistribute it and/or modify"),
    ("lgpl", r"you should have received a copy of the gnu lesser general public licen[cs]e along with"),
    ("lgpl-2.0", r"gnu library general public licen[cs]e version 2, june 1991"),
    ("lgpl-2.0", r"you should have received a copy of the gnu library general public licen[cs]e along with"),
    ("lgpl-2.1", r"gnu lesser general public licen[cs]e version 2\.1, february 1999"),
    ("lgpl-2.1-or-later", r"gnu lesser general public licen[cs]e as published by the free software foundation[;,]? either version 2\.1 of the licen[cs]e, or \(at your option\) any later version"),
    ("lgpl-3.0", r"gnu lesser general public licen[cs]e version 3, 29 june 2007"),
    ("lgpl-3.0", r"this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3"),
    ("lgpl-3.0-or-later", r"gnu lesser general public licen[cs]e as published by the free software foundation[;,]? either version 3 of the licen[cs]e, or \(at your option\) any later version"),
    ("agpl-3.0", r"gnu affero general public licen[cs]e version 3, 19 november 2007"),
    ("agpl-3.0", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl-3.0", r"gnu affero general public licen[cs]e as published by the free software foundation[;,]? either version 3"),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("gfdl", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gfdl", r"under the terms of the gnu free documentation licen[cs]e,? version 1\.[123]"),
    ("gfdl", r"the purpose of this licen[cs]e is to make a manual, textbook, or other functional and useful document"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.0"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e,? v\. 2\.0"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("mpl-2.0", r"this source code form is \"?incompatible with secondary licen[cs]es\"?"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public licen[cs]e"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion )?1\.0"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v\. |v|version )?2\.0"),
    ("epl-1.0", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e"),
    ("edl-1.0", r"eclipse distribution licen[cs]e,? (?:v\. |v|version )?1\.0"),
    ("cpl", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("ipl-1.0", r"ibm public licen[cs]e,? version 1\.0"),
    ("eupl", r"licensed under the eupl"),
    ("eupl", r"european union public licen[cs]e (?:v|v\. |version )1\.[012]"),
    ("cddl-1.0", r"common development and distribution licen[cs]e \(cddl\) version 1\.0"),
    ("cddl-1.1", r"common development and distribution licen[cs]e \(cddl\) version 1\.1"),
    ("cddl", r"when distributing the software, include this licen[cs]e header notice in each file"),
    ("cddl", r"usr/src/opensolaris\.license"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document.{1,90}artistic"),
    ("artistic-2.0", r"this licen[cs]e establishes the terms under which a given free software package may be copied"),
    ("artistic-1.0-or-gpl", r"under the same terms as perl itself"),
    ("boost", r"free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost", r"distributed under the boost software licen[cs]e,? version 1\.0"),
    ("zlib", r"this software is provided 'as-is',? without any express(?:ed)? or implied warranty"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("libpng", r"the png reference library is supplied \"as is\""),
    ("libpng", r"this code is released under the libpng licen[cs]e"),
    ("psf", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide licen[cs]e"),
    ("psf", r"psf licen[cs]e agreement for python"),
    ("cnri-python", r"cnri hereby grants licensee a nonexclusive, royalty-free"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("php", r"this product includes php software, freely available from"),
    ("php", r"this source file is subject to version 3\.0[01]? of the php licen[cs]e"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", r"the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("beerware", r"you can buy me a beer in return"),
    ("beerware", r"the beer-ware licen[cs]e"),
    ("ofl", r"this font software is licensed under the sil open font licen[cs]e,? version 1\.[01]"),
    ("odbl", r"made available under the open database licen[cs]e"),
    ("odc-by", r"open data commons attribution licen[cs]e"),
    ("pddl", r"public domain dedication and licen[cs]e"),
    ("cc0-1.0", r"cc0(?: 1\.0)?(?: universal)?"),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights"),
    ("cc-by", r"except where otherwise noted, .{1,60} creative commons attribution"),
    ("ms-pl", r"microsoft public licen[cs]e \(ms-pl\)"),
    ("ms-pl", r"if you use the software, you accept this licen[cs]e\. if you do not accept the licen[cs]e, do not use the software"),
    ("osl", r"licensed under the open software licen[cs]e version"),
    ("afl", r"licensed under the academic free licen[cs]e version"),
    ("ecl", r"educational community licen[cs]e,? version 2\.0"),
    ("upl-1.0", r"universal permissive licen[cs]e,? (?:\(upl\),? )?version 1\.0"),
    ("ncsa", r"university of illinois/ncsa open source licen[cs]e"),
    ("postgresql", r"in no event shall the university of california be liable to any party"),
    ("postgresql", r"postgresql database management system \(formerly known as postgres"),
    ("curl", r"copyright \(c\) .{1,40}daniel stenberg"),
    ("json", r"the software shall be used for good, not evil"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("sqlite", r"in place of a legal notice, here is a blessing"),
    ("hpnd", r"permission notice appear in supporting documentation"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", r"the freetype project licen[cs]e"),
    ("icu", r"copyright \(c\) .{1,20}international business machines corporation and others"),
    ("unicode", r"unicode,? inc\.? licen[cs]e agreement"),
    ("unicode", r"unicode licen[cs]e(?: agreement)?(?: -)? data files and software"),
    ("w3c", r"w3c(?:\(r\))? software (?:notice and licen[cs]e|and document licen[cs]e)"),
    ("zpl-2.1", r"zope public licen[cs]e \(zpl\) version 2\.[01]"),
    ("python-ldap", r"the openldap public licen[cs]e version 2\.[0-9]"),
    ("qpl-1.0", r"the q public licen[cs]e version 1\.0"),
    ("sspl", r"server side public licen[cs]e version 1, october 16, 2018"),
    ("sspl", r"making the functionality of the program or modified version available to third parties as a service"),
    ("busl", r"additional use grant"),
    ("elastic-2.0", r"elastic licen[cs]e(?:,? version)? 2\.0"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"commons clause licen[cs]e condition"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) licen[cs]e"),
    ("blueoak-1.0.0", r"blue oak model licen[cs]e"),
    ("mulan-2.0", r"mulan (?:permissive software licen[cs]e|psl),? (?:version |v)?2"),
    ("openrail", r"(?:creativeml |bigscience )?open(?: )?rail(?:\+\+)?-?m"),
    ("llama", r"llama [234](?:\.[0-9])? community licen[cs]e"),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("proprietary", r"(?:proprietary(?: and confidential)?[.,]? )?all rights reserved"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution) of this file, via any medium is strictly prohibited"),
    ("proprietary", r"contains? (?:valuable )?(?:confidential information and )?trade secrets"),
    ("commercial", r"end user licen[cs]e agreement"),
    ("commercial", r"for evaluation purposes only"),
    ("non-commercial", r"for (?:non-?commercial|research|academic|educational) purposes only"),
)


#: Words that many texts have: a rule's keyword is one of them only if it has no other.
USUAL = {"software", "version", "document", "distributed", "distribute", "public", "general", "general public", "contain", "community", "copyright", "licensed", "available", "conditions", "return", "model", "open", "agreement", "library", "received", "developed", "contents", "released", "reference", "products", "subject", "distribution", "permission", "foundation", "february", "november", "under", "purpose", "copy", "condition", "december", "versions", "university", "international", "program", "independent", "documentation", "clause"}


def longest_word(pattern: str) -> str:
    """The longest word, a usual one last, that stands in a pattern outside groups, classes and what may be missing, so in all it matches."""
    bare = re.sub(r"\\.", " ", pattern)
    while (less := re.sub(r"\([^()]*\)", "()", bare.replace("()", " "))) != bare:
        bare = less
    bare = re.sub(r"\[[^]]*\]|\{[^}]*\}|[^ ]\?", " ", bare)
    return max(re.findall(r"[a-z0-9'-]+", bare), key=lambda w: (w not in USUAL and len(w) > 2, len(w)))


def rules() -> list[Rule]:
    """All rules, some hundreds: families by forms, Creative Commons by parts and versions, and signatures of licence texts."""
    out = []
    for label, keyword, name, spdx, address in FAMILIES:
        under, licence = ("under", "licen") if label in OTHER_NAMES else (keyword, keyword)
        spdx_word = r"(?![a-z0-9.-]*[a-z0-9])"
        out += [
            Rule(label, "spdx-license-identifier", rf"spdx-license-identifier:\s{{0,8}}\(?{spdx}{spdx_word}", 0, 1.0),
            Rule(label, under, rf"(?:licen[cs]ed|released|distributed|available|published|provided)\s{{1,4}}under\s{{1,4}}(?:the\s{{1,4}})?(?:terms\s{{1,4}}of\s{{1,4}}(?:the\s{{1,4}})?)?(?:{name})\b(?:\s{{1,4}}licen[cs]e)?", 1, 0.95),
            Rule(label, licence, rf"\b(?:{name})\b" if "licen" in name else rf"\b(?:{name})\s{{1,4}}licen[cs]e\b", 3, 0.8),
            Rule(label, address.split("/")[0], rf"{re.escape(address) if '(?:' not in address else address.replace('.', '[.]')}", 1, 1.0),
            Rule(label, "licen", rf"licen[cs]e:\s{{0,8}}(?:{name}|{spdx}){spdx_word}", 2, 0.9),
        ]
    for parts in CC:
        code, name = "-".join(parts), r"[-, ]{1,2}".join(CC_PARTS[p] for p in parts)
        for version in CC_VERSIONS:
            v, label = version.replace(".", r"\."), f"cc-{code}-{version}"
            out += [
                Rule(label, "spdx-license-identifier", rf"spdx-license-identifier:\s{{0,8}}\(?cc-{code}-{v}", 0, 1.0),
                Rule(label, "creativecommons.org", rf"creativecommons\.org/licenses/{code}/{v}", 1, 1.0),
                Rule(label, "creative commons", rf"creative commons {name} {v}(?: international| generic| unported)?(?: licen[cs]e)?", 2, 0.95),
                Rule(label, "cc", rf"\bcc[- ]{code}[- ]{v}", 3, 0.9),
            ]
        out.append(Rule(f"cc-{code}", "creative commons", rf"creative commons {name}(?: licen[cs]e)?", 4, 0.7))
    out += [Rule(label, longest_word(words), re.sub(r"\[[^]]*\]| ", lambda m: r"\s{1,8}" if m[0] == " " else m[0], words), 1 if "-" in label else 2, 0.9) for label, words in SIGNATURES]
    return out


# The base phrases' last two words before "license", and labels.
BASE_LABELS = (("mit", "mit"), ("apache", "apache"), ("public", "gpl"))
DETECTIONS = "array<struct<start:int,end:int,priority:int,label:string,weight:double>>"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A lower-case text without any of these has no base phrase, and no rule's pattern matches it.
GATE = (
    "licen", "under", "spdx-", "public", "permission", "redistribution", "cc0", "cc-", "cc b", "creative", "software", "as-is", "reserved",
    "proprietary", "copyright", "confidential", "warrant", "contributor", "granted", "grant", "font", "exception", "modules", "prohibited",
    "secrets", "agreement", "purposes", "source code", "provided", "beer", "rail", "blessing", "copies", "distribut", "attribution", "except", "disclaim",
    "interpreted", "clause", "sections", "altered", "supplied", "california", "postgresql", "functionality", "mulan", ".org", ".com", ".net", ".eu",
)


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _lic: n_words, starts and names of base phrases, and detections (start, end, priority, label, weight) in code points.

    Words of ASCII letters and digits, lower-cased, and of all other characters; a base phrase's start counts words
    from 0. Detections are of the lower-cased text (A-Z only), sorted by start;
    cost grows with the square of the longest chain of rules' matches that overlap, else in proportion. Null counts as empty; equal texts get
    equal results; an empty table gives no rows; other columns stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    count = let(F.split(whole, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: (F.size(w) - (w[0] == "").cast("int") - F.when(F.size(w) > 1, (F.element_at(w, -1) == "").cast("int")).otherwise(0)).cast("long"))
    gate = let(F.lower(whole), lambda x: functools.reduce(operator.or_, [x.contains(g) for g in GATE]))

    def base(words: Column) -> Column:
        before = lambda i, k: F.get(words, i - k)
        start = lambda w, i: F.when(w != "license", None).when(before(i, 1).isin("mit", "apache"), F.struct((i - 1).cast("long").alias("at"), before(i, 1).alias("label"))).when((before(i, 1) == "public") & (before(i, 2) == "general"), F.struct((i - 2).cast("long").alias("at"), F.lit("gpl").alias("label")))
        return F.filter(F.transform(words, start), lambda x: x.isNotNull())

    low = F.translate(whole, UPPER, LOWER)
    phrases = lambda low: F.when(low.contains("license"), let(F.filter(F.split(low, NOT_WORD), lambda w: w != ""), base))
    none = F.struct(F.lit(None).cast("array<struct<at:bigint,label:string>>").alias("phrases"), F.lit(None).cast(DETECTIONS).alias("detections"))
    found = let(gate, lambda g: F.when(g, let(low, lambda x: F.struct(phrases(x).alias("phrases"), _detections(x).alias("detections")))).otherwise(none))
    out = let(count, lambda n: let(found, lambda f: F.struct(n.alias("n_words"), f["phrases"].alias("phrases"), f["detections"].alias("detections"))))
    return df.withColumn("_lic", out)


#: Values that one step of a running sum adds to one array.
BLOCK = 256


def starts_of(gaps: Column, hits: Column) -> Column:
    """Places before each of the hits, which gaps and hits lead to in turn: sums by blocks, so long arrays aren't copied at each step."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))

    def within(block: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<int>").alias("found"))
        step = lambda s, x: F.struct((s["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(s["found"], F.array(s["at"] + x["gap"])).alias("found"))
        return F.aggregate(block, zero, step, lambda s: s["found"])

    def joined(blocks: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + x["hit"])
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        firsts = F.aggregate(blocks, zero, lambda s, b: F.struct((s["at"] + total(b)).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")), lambda s: s["found"])
        return F.flatten(F.zip_with(blocks, firsts, within))

    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda at: F.slice(v, at, F.lit(BLOCK)))
    return let(lengths, lambda v: let(cut(v), joined))


SPAN = "array<struct<start:int,end:int,priority:int,label:string,weight:double>>"


def _detections(low: Column) -> Column:
    by_keyword: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(rules()):
        by_keyword.setdefault(r.keyword, []).append((i, r))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority * 1000 + i).alias("priority"), F.lit(r.weight).alias("weight")) for i, r in own]).alias("rules")) for k, own in by_keyword.items()])
    open_ = F.flatten(F.transform(F.filter(table, lambda t: low.contains(t["keyword"])), lambda t: t["rules"]))

    def spans(rule: Column) -> Column:
        """Where the rule's pattern matches: what stands between matches and the matches themselves have these lengths."""

        def lay(hits: Column) -> Column:
            starts = starts_of(F.split(low, rule["pattern"], -1), hits)
            return F.zip_with(starts, hits, lambda at, h: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight")))

        return let(F.regexp_extract_all(low, rule["pattern"], F.lit(0)), lambda h: F.when(F.size(h) > 0, lay(h)).otherwise(F.array().cast(SPAN)))

    return let(F.array_sort(F.flatten(F.transform(open_, spans))), lambda every: F.when(F.size(every) < 2, every).otherwise(F.flatten(F.transform(chains(every), best_of))))


def chains(every: Column) -> Column:
    """Sorted intervals cut into arrays wherever none reaches over the place. The furthest end so far is carried over in blocks."""

    def reach(block: Column, so_far: Column) -> Column:
        zero = F.struct(so_far.alias("end"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(block, zero, lambda s, d: F.struct(F.greatest(s["end"], d["end"]).alias("end"), F.concat(s["found"], F.array(s["end"])).alias("found")), lambda s: s["found"])

    def reached(blocks: Column) -> Column:
        furthest = lambda b: F.aggregate(b, F.lit(0), lambda s, d: F.greatest(s, d["end"]))
        zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("found"))
        firsts = F.aggregate(blocks, zero, lambda s, b: F.struct(F.greatest(s["end"], furthest(b)).alias("end"), F.concat(s["found"], F.array(s["end"])).alias("found")), lambda s: s["found"])
        return F.flatten(F.zip_with(blocks, firsts, reach))

    blocks = F.transform(F.sequence(F.lit(1), F.size(every), F.lit(BLOCK)), lambda at: F.slice(every, at, F.lit(BLOCK)))
    opens = lambda ends: F.filter(F.transform(every, lambda d, i: F.when((i == 0) | (d["start"] >= F.get(ends, i)), i + 1)), lambda i: i.isNotNull())
    return let(let(let(blocks, reached), opens), lambda at: F.transform(at, lambda i, k: F.slice(every, i, F.coalesce(F.get(at, k + 1), F.size(every) + 1) - i)))


def best_of(chain: Column) -> Column:
    """The intervals of a chain that stay, by start: by priority class, then the longer, then the earlier, each if it overlaps none that stays."""
    ranked = F.array_sort(F.transform(chain, lambda d: F.struct(F.floor(d["priority"] / 1000).cast("int").alias("class"), (d["start"] - d["end"]).alias("length"), d["start"].alias("start"), d["priority"].alias("priority"), d["end"].alias("end"), d["label"].alias("label"), d["weight"].alias("weight"))))
    plain = lambda d: F.struct(*[d[x].alias(x) for x in ("start", "end", "priority", "label", "weight")])
    stays = lambda kept, d: F.when(F.exists(kept, lambda k: (k["start"] < d["end"]) & (d["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(plain(d))))
    return F.when(F.size(chain) < 2, chain).otherwise(F.array_sort(F.aggregate(ranked, F.array().cast(SPAN), stays)))
