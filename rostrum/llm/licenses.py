"""License scan: ordered signature rules over a text's words.  DataFrame functions only.

Words are runs of digits, a-z and characters from U+0080 on, A-Z lower-cased.  A rule is a regex over the words joined by
single spaces; it runs only where the rule's keyword occurs.  Of detections, one that lies within another of the same or a
higher rank is dropped; those that only overlap both stay.  Of equal spans the higher rank stays, then the earlier rule.  A null
text is empty; it has no detection and a score of 0.  Repeated rows each get their result.  A text's detections are held by its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.columns import aside, restored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: A text without any of these has no detection; CC_GATE stands for cc at a word's start.  They are looked for in the raw text, so each
#: is of one word: what is between words there can be anything.
GATES = ("licen", "copyright", "spdx", "domain", "reserved", "permission", "redistribution", "warrant", "creativecommons", "authorization")
CC_GATE = r"(?<![0-9a-z\x{80}-\x{10FFFF}])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]*(?:by|zero|0)"

VERSION = r"(?: (?:version |v )?\d+(?: \d+){0,2})?(?: (?:or|and) (?:any )?later(?: version)?)?"
UNDER = r"(?:licensed|released|distributed|available|published|provided|covered|governed) (?:to you )?(?:by|under) (?:the )?(?:terms of (?:the )?)?"

#: label: (keyword, names, SPDX and URL names), as words.  Names are regexes, hand-written.
FAMILIES = {
    "apache": ("apache", r"apache(?: software)? licen[cs]e", r"apache(?: \d(?: \d)?)?"),
    "mit": ("mit", r"(?:mit|mit x11|mit expat) licen[cs]e", r"mit(?: 0)?"),
    "isc": ("isc", r"isc licen[cs]e", r"isc"),
    "x11": ("x11", r"x11 licen[cs]e", r"x11"),
    "gpl": ("general public", r"gnu general public licen[cs]e", r"gpl(?: \d(?: \d)?)?(?: only| or later)?"),
    "lgpl": ("general public", r"gnu (?:lesser|library) general public licen[cs]e", r"lgpl(?: \d(?: \d)?)?(?: only| or later)?"),
    "agpl": ("affero", r"(?:gnu )?affero general public licen[cs]e", r"agpl(?: \d(?: \d)?)?(?: only| or later)?"),
    "gfdl": ("free documentation", r"gnu free documentation licen[cs]e", r"gfdl(?: \d(?: \d)?)?"),
    "bsd": ("bsd", r"(?:(?:new|modified|simplified|revised|\d clause|two clause|three clause) )?bsd(?: \d clause)? licen[cs]e", r"bsd(?: \d clause)?"),
    "mpl": ("mozilla", r"mozilla public licen[cs]e", r"mpl(?: \d(?: \d)?)?"),
    "epl": ("eclipse", r"eclipse public licen[cs]e", r"epl(?: \d(?: \d)?)?"),
    "edl": ("eclipse", r"eclipse distribution licen[cs]e", r"edl(?: \d(?: \d)?)?"),
    "eupl": ("european union", r"european union public licen[cs]e", r"eupl(?: \d(?: \d)?)?"),
    "cddl": ("common development", r"common development and distribution licen[cs]e", r"cddl(?: \d(?: \d)?)?"),
    "cpl": ("common public", r"common public licen[cs]e", r"cpl(?: \d(?: \d)?)?"),
    "cpal": ("common public attribution", r"common public attribution licen[cs]e", r"cpal(?: \d(?: \d)?)?"),
    "artistic": ("artistic", r"(?:perl )?artistic licen[cs]e", r"artistic(?: \d(?: \d)?)?"),
    "bsl-1": ("boost", r"boost software licen[cs]e", r"bsl 1 0"),
    "busl": ("business source", r"business source licen[cs]e", r"busl(?: \d(?: \d)?)?"),
    "elastic": ("elastic", r"elastic licen[cs]e", r"elastic(?: \d(?: \d)?)?"),
    "sspl": ("server side public", r"server side public licen[cs]e", r"sspl(?: \d(?: \d)?)?"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    "libpng": ("libpng", r"libpng licen[cs]e", r"libpng(?: \d(?: \d)?)?"),
    "openssl": ("openssl", r"openssl licen[cs]e", r"openssl"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e", r"postgresql"),
    "python": ("python", r"python(?: software foundation)? licen[cs]e", r"(?:psf|python)(?: \d(?: \d)?)?"),
    "php": ("php", r"php licen[cs]e", r"php(?: \d(?: \d+)?)?"),
    "ruby": ("ruby", r"ruby licen[cs]e", r"ruby"),
    "ms-pl": ("microsoft public", r"microsoft public licen[cs]e", r"ms pl"),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    "ofl": ("open font", r"(?:sil )?open font licen[cs]e", r"ofl(?: \d(?: \d)?)?"),
    "ogl": ("open government", r"open government licen[cs]e", r"ogl(?: uk)?(?: \d(?: \d)?)?"),
    "odbl": ("open database", r"open database licen[cs]e", r"odbl(?: \d(?: \d)?)?"),
    "odc-by": ("open data commons", r"open data commons attribution licen[cs]e", r"odc by(?: \d(?: \d)?)?"),
    "pddl": ("public domain dedication", r"public domain dedication and licen[cs]e", r"pddl(?: \d(?: \d)?)?"),
    "cecill": ("cecill", r"cecill(?: [bc])?(?: free software)? licen[cs]e", r"cecill(?: [bc])?(?: \d(?: \d)?)?"),
    "wtfpl": ("want to public", r"do what the \S+ you want to public licen[cs]e", r"wtfpl"),
    "unlicense": ("unlicense", r"(?:the )?unlicense", r"unlicense"),
    "ncsa": ("open source", r"(?:university of illinois (?:ncsa )?|ncsa )open source licen[cs]e", r"ncsa"),
    "qpl": ("q public", r"q public licen[cs]e", r"qpl(?: \d(?: \d)?)?"),
    "sleepycat": ("sleepycat", r"sleepycat(?: public)? licen[cs]e", r"sleepycat"),
    "vim": ("vim", r"vim licen[cs]e", r"vim"),
    "w3c": ("w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", r"w3c"),
    "upl": ("universal permissive", r"universal permissive licen[cs]e", r"upl(?: \d(?: \d)?)?"),
    "osl": ("open software", r"open software licen[cs]e", r"osl(?: \d(?: \d)?)?"),
    "afl": ("academic free", r"academic free licen[cs]e", r"afl(?: \d(?: \d)?)?"),
    "rail": ("rail", r"(?:open|bigscience|bigcode|creativeml)(?: open)? rail(?: m)? licen[cs]e", r"openrail"),
    "cc-by": ("cc by", r"cc by", r"cc by(?: \d \d)?"),
    "cc-by-sa": ("cc by", r"cc by sa", r"cc by sa(?: \d \d)?"),
    "cc-by-nc": ("cc by", r"cc by nc", r"cc by nc(?: \d \d)?"),
    "cc-by-nd": ("cc by", r"cc by nd", r"cc by nd(?: \d \d)?"),
    "cc-by-nc-sa": ("cc by", r"cc by nc sa", r"cc by nc sa(?: \d \d)?"),
    "cc-by-nc-nd": ("cc by", r"cc by nc nd", r"cc by nc nd(?: \d \d)?"),
    "cc0": ("cc", r"cc ?(?:0|zero)", r"cc0(?: \d \d)?"),
    "creative-commons": ("creative commons", r"creative commons(?: (?:attribution|zero|share ?alike|non ?commercial|no ?deriv\w*))*(?: \d \d)?(?: \w+)? licen[cs]e", r"cc"),
}
#: (label, keyword, regex): names of licences that stand for themselves, as words.  Hand-written.
NAMES = [
    ("apsl", "apple public", r"apple public source licen[cs]e"),
    ("bitstream", "bitstream", r"bitstream vera(?: fonts?)? licen[cs]e"),
    ("beerware", "beer", r"(?:the )?beer ?ware licen[cs]e"),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e"),
    ("cdla", "community data", r"community data licen[cs]e agreement(?: (?:permissive|sharing))?"),
    ("cern-ohl", "open hardware", r"cern open hardware licen[cs]e(?: (?:strongly|weakly) reciprocal| permissive)?"),
    ("cnri", "cnri", r"cnri(?: python| jython)?(?: open source)? licen[cs]e"),
    ("commons-clause", "commons clause", r"commons clause licen[cs]e condition"),
    ("confluent", "confluent", r"confluent community licen[cs]e"),
    ("crown", "crown copyright", r"crown copyright"),
    ("curl", "permission notice", r"copyright and permission notice copyright"),
    ("dl-de", "data licen", r"data licen[cs]e germany"),
    ("dsl", "design science", r"design science licen[cs]e"),
    ("ecl", "educational community", r"educational community licen[cs]e"),
    ("efl", "eiffel forum", r"eiffel forum licen[cs]e"),
    ("entessa", "entessa", r"entessa public licen[cs]e"),
    ("etalab", "etalab", r"(?:etalab open licen[cs]e|licen[cs]e ouverte etalab)"),
    ("fal", "free art", r"free art licen[cs]e"),
    ("fair", "fair licen", r"under the fair licen[cs]e"),
    ("fsl", "functional source", r"functional source licen[cs]e"),
    ("frameworx", "frameworx", r"frameworx open licen[cs]e"),
    ("freetype", "freetype", r"freetype(?: project)? licen[cs]e"),
    ("hdf5", "hdf5", r"hdf5 licen[cs]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("ijg", "jpeg", r"independent jpeg group licen[cs]e"),
    ("imagemagick", "imagemagick", r"imagemagick licen[cs]e"),
    ("info-zip", "info zip", r"info zip licen[cs]e"),
    ("intel", "intel", r"intel (?:simplified|open source|sample source code) (?:software )?licen[cs]e"),
    ("ipl", "ibm public", r"ibm public licen[cs]e"),
    ("jasper", "jasper", r"jasper licen[cs]e"),
    ("lal", "art libre", r"licen[cs]e art libre"),
    ("llama", "llama", r"llama(?: \d(?: \d)?)? community licen[cs]e(?: agreement)?"),
    ("lppl", "latex project", r"latex project public licen[cs]e"),
    ("lucent", "lucent public", r"lucent public licen[cs]e"),
    ("mit-cmu", "cmu", r"(?:mit )?cmu licen[cs]e"),
    ("motosoto", "motosoto", r"motosoto(?: open source)? licen[cs]e"),
    ("mulan", "mulan", r"mulan permissive software licen[cs]e(?: v?\d)?"),
    ("multics", "multics", r"multics licen[cs]e"),
    ("nasa", "nasa open", r"nasa open source agreement licen[cs]e"),
    ("naumen", "naumen", r"naumen public licen[cs]e"),
    ("nethack", "nethack", r"nethack general public licen[cs]e"),
    ("nlod", "open government data", r"norwegian licen[cs]e for open government data"),
    ("nokia", "nokia open", r"nokia open source licen[cs]e"),
    ("npl", "netscape", r"netscape public licen[cs]e"),
    ("ntp", "ntp licen", r"ntp licen[cs]e"),
    ("nvidia", "nvidia", r"nvidia (?:software|source code|open model) licen[cs]e"),
    ("oclc", "oclc", r"oclc research public licen[cs]e"),
    ("oldap", "openldap", r"openldap public licen[cs]e"),
    ("opl", "open publication", r"open publication licen[cs]e"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial) licen[cs]e"),
    ("prosperity", "prosperity", r"prosperity public licen[cs]e"),
    ("qt-commercial", "commercial qt", r"valid commercial qt licen[cs]es"),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e"),
    ("rpsl", "realnetworks", r"realnetworks public source licen[cs]e"),
    ("ricoh", "ricoh", r"ricoh source code public licen[cs]e"),
    ("rsal", "redis", r"redis source available licen[cs]e"),
    ("simpl", "simple public", r"simple public licen[cs]e"),
    ("sissl", "sun industry", r"sun industry standards source licen[cs]e"),
    ("spl", "sun public", r"sun public licen[cs]e"),
    ("solderpad", "solderpad", r"solderpad hardware licen[cs]e"),
    ("tapr", "tapr", r"tapr open hardware licen[cs]e"),
    ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e"),
    ("timescale", "timescale", r"timescale licen[cs]e"),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e"),
    ("vovida", "vovida", r"vovida software licen[cs]e"),
    ("watcom", "watcom", r"sybase open watcom public licen[cs]e"),
    ("xnet", "xnet", r"xnet licen[cs]e"),
    ("zpl", "zope", r"zope public licen[cs]e"),
]
#: (label, keyword, regex): sentences of the licences themselves, as words, and of the notices that they ask for.  Hand-written.
SENTENCES = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice (?:\S+ ){0,4}shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", "prior written authorization", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the (?:copyright holders?|\S+ consortium)"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "prior written permission", r"to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "implied warranties", r"this software is provided by the (?:copyright holders|regents|authors?)(?: and contributors)? as is and any express or implied warranties"),
    ("bsd", "special exemplary or consequential", r"in no event shall the copyright (?:owner|holder)s?(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("apache", "in compliance with", r"you may not use this (?:file|work|software) except in compliance with the licen[cs]e"),
    ("apache", "obtain a copy of", r"you may obtain a copy of the licen[cs]e at"),
    ("apache", "applicable law", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache", "specific language", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("apache", "contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache", "asf under", r"licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("gpl", "free software foundation", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl", "in the hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl", "verbatim copies of", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("gpl", "freedom to share", r"the licen[cs]es for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl", "free copyleft", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("gpl", "at your option", r"either version \d(?: \d)? of the licen[cs]e or at your option any later version"),
    ("lgpl", "lesser general public", r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation"),
    ("lgpl", "library general public", r"under the terms of the gnu library general public licen[cs]e as published by the free software foundation"),
    ("lgpl", "lesser general public", r"you should have received a copy of the gnu lesser general public licen[cs]e along with this library"),
    ("lgpl", "incorporates the terms", r"this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3"),
    ("agpl", "affero", r"under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("agpl", "affero", r"the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("agpl", "remote network", r"remote network interaction use with the gnu general public licen[cs]e notwithstanding any other provision of this licen[cs]e"),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("mpl", "covered software", r"covered software is provided under this licen[cs]e on an as is basis without warranty of any kind"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl", "eclipse", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e"),
    ("edl", "eclipse", r"made available under the terms of the eclipse distribution licen[cs]e"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("eupl", "eupl", r"this european union public licen[cs]e the eupl applies to the work"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cpl", "common public", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("cpal", "common public attribution", r"the contents of this file are subject to the common public attribution licen[cs]e"),
    ("artistic", "artistic", r"it under the same terms as perl itself or the artistic licen[cs]e"),
    ("artistic", "copyright holder maintains", r"such that the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("bsl-1", "organization obtaining", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("bsl-1", "derivative works of the software", r"the copyright notices in the software and this entire statement (?:\S+ ){0,20}all derivative works of the software"),
    ("busl", "licensor hereby grants", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic", "licensor grants", r"the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable licen[cs]e to use copy distribute make available and prepare derivative works of the software"),
    ("sspl", "as a service", r"making the functionality of the program or modified version available to third parties as a service (?:\S+ ){0,20}licen[cs]e"),
    ("zlib", "implied warranty", r"this software is provided as is without any express or implied warranty in no event"),
    ("zlib", "granted to anyone", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("openssl", "openssl", r"the openssl toolkit stays under a (?:dual|double) licen[cs]e"),
    ("postgresql", "written agreement", r"without fee and without a written agreement is hereby granted provided that the above copyright notice"),
    ("python", "licensee", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("python", "psf", r"this licen[cs]e agreement is between the python software foundation psf and the individual or organization licensee"),
    ("php", "php", r"this source file is subject to version \d(?: \d+)? of the php licen[cs]e"),
    ("ruby", "give away verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("ms-pl", "accompanying software", r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("ofl", "font software", r"this font software is licensed under the sil open font licen[cs]e"),
    ("ofl", "font software", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ogl", "public sector", r"contains public sector information licensed under the open government licen[cs]e"),
    ("odbl", "open database", r"is made available under the open database licen[cs]e"),
    ("odbl", "individual contents", r"any rights in individual contents of the database are licensed under the database contents licen[cs]e"),
    ("cc0", "neighboring rights", r"waived all copyright and related or neighboring rights"),
    ("cc0", "this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("creative-commons", "exercising the licensed", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("creative-commons", "creative commons", r"this work is licensed under (?:a|the) creative commons"),
    ("wtfpl", "modified copies of", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", "copyright interest", r"dedicate any and all copyright interest in the software to the public domain"),
    ("sleepycat", "redistributions in any", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("vim", "copies of vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this licen[cs]e text"),
    ("w3c", "the licensee", r"by obtaining (?:using )?and or copying this work you the licensee agree that you have read understood and will comply with"),
    ("upl", "associated documentation and or data", r"permission is hereby granted free of charge to any person obtaining a copy of this software associated documentation and or data"),
    ("osl", "open software", r"the licensor has placed the following licensing notice adjacent to the copyright notice for the original work licensed under the open software licen[cs]e"),
    ("afl", "academic free", r"the licensor has placed the following licensing notice adjacent to the copyright notice for the original work licensed under the academic free licen[cs]e"),
    ("rail", "complementary material", r"licen[cs]e to (?:\S+ ){0,12}the complementary material the model and derivatives of the model"),
    ("llama", "llama", r"llama \d(?: \d)? is licensed under the llama \d(?: \d)? community licen[cs]e"),
    ("blueoak", "you to do everything", r"each contributor licen[cs]es you to do everything with this software that would otherwise infringe that contributor s copyright in it"),
    ("mulan", "mulan", r"is licensed under mulan psl v?\d"),
    ("qt-commercial", "commercial qt", r"licensees holding valid commercial qt licen[cs]es may use this file in accordance with the commercial licen[cs]e agreement"),
    ("hpnd", "without fee is hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("freetype", "freetype", r"portions of this software are copyright \S+ the freetype project"),
    ("beerware", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff (?:\S+ ){0,20}licen[cs]e"),
]
#: (label, keyword, regex, rank): notices and hints that name no licence.
OTHERS = [
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain", 1),
    ("public-domain", "public domain", r"(?:is|are) in the public domain", 2),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 3),
    ("copyright", "copyright", r"copyright(?: c)? \d{4}(?: \d{4})*", 3),
    ("no-warranty", "warrant", r"without warrant(?:y|ies)(?: of any kind)?", 3),
    ("licensed", "licensed", r"licensed under", 3),
]


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, regex, rank), in order.  Rank 0: a licence's own words or tag; 1: a notice; 2: a name; 3: a hint."""
    out = [(*r, 0) for r in SENTENCES]
    for label, (key, name, tag) in FAMILIES.items():
        out += [
            (label, "spdx", rf"spdx licen[cs]e identifier {tag}", 0),
            (label, "licenses", rf"(?:opensource|gnu|apache|spdx|creativecommons) org licenses {tag}", 0),
            (label, key, rf"{UNDER}{name}{VERSION}", 1),
            (label, key, rf"(?:this|the) (?:program|software|work|file|library|document|code|dataset) is (?:free software |also )?{UNDER}{name}{VERSION}", 0),
            (label, key, rf"licen[cs]e {tag}" if tag.startswith("cc ") else rf"{name} notice", 2),
            (label, key, rf"{name}{VERSION}", 2),
        ]
    return out + [(*r, 2) for r in NAMES] + OTHERS


def _key(k: str) -> str:
    return f" {k}" if len(k) < 4 else k


def _table() -> Column:
    cells = [{"label": a, "key": _key(k), "regex": f"(?<= )(?:{x})(?= )", "rank": r, "rule": i} for i, (a, k, x, r) in enumerate(rules())]
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in cells])


def _starts(line: Column, regex: Column) -> Column:
    """Words, from 0, at which the regex's places in ' word word ' start."""
    marked = F.split(F.regexp_replace(line, regex, F.lit("\u0001$0")), F.lit(" "))
    at = F.transform(marked, lambda w, i: F.when(w.startswith("\u0001"), i - 1))
    return F.filter(at, lambda i: i.isNotNull())


def _found(line: Column, r: Column) -> Column:
    spans = F.regexp_extract_all(line, r["regex"], F.lit(0))
    return F.zip_with(
        _starts(line, r["regex"]), spans,
        lambda s, m: F.struct(s.alias("start"), (-(s + F.size(F.split(m, F.lit(" "))))).alias("minus_end"), r["rank"].alias("rank"), r["rule"].alias("rule"), r["label"].alias("label")),
    )


def _suppressed(hits: Column) -> Column:
    """Sorted by start, the longest first, a detection lies within an earlier one if that ends no earlier.  So it is enough to
    know, for each rank, the furthest end so far.  Detections are gone through in blocks of the square root of their number, so no array
    that grows by copying gets longer than that; the furthest ends before each block come first."""
    size = F.size(hits)
    step = F.ceil(F.sqrt(size)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), size, step), lambda i: F.slice(hits, i, step))
    named = lambda ends: F.struct(*[e.alias(f"e{k}") for k, e in enumerate(ends)])
    furthest = lambda b, k: F.coalesce(F.array_max(F.transform(F.filter(b, lambda h: h["rank"] == k), lambda h: -h["minus_end"])), F.lit(-1))
    further = lambda x, y: named([F.greatest(x[f"e{k}"], y[f"e{k}"]) for k in range(4)])
    nothing = named([F.lit(-1)] * 4)
    before = F.aggregate(
        F.transform(blocks, lambda b: named([furthest(b, k) for k in range(4)])),
        F.struct(F.filter(F.array(nothing), lambda e: F.lit(False)).alias("all"), nothing.alias("now")),
        lambda acc, e: F.struct(F.concat(acc["all"], F.array(acc["now"])).alias("all"), further(acc["now"], e).alias("now")),
        lambda acc: acc["all"],
    )

    def one(acc: Column, h: Column) -> Column:
        upto, end = [acc["ends"][f"e{k}"] for k in range(4)], -h["minus_end"]
        reach = F.when(h["rank"] == 0, upto[0])
        for k in (1, 2, 3):
            reach = reach.when(h["rank"] == k, F.greatest(*upto[: k + 1]))
        ends = named([F.when(h["rank"] == k, F.greatest(upto[k], end)).otherwise(upto[k]) for k in range(4)])
        return F.struct(F.when(reach >= end, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(h))).alias("kept"), ends.alias("ends"))

    none = lambda b: F.filter(b, lambda h: F.lit(False))
    kept = F.zip_with(blocks, before, lambda b, e: F.aggregate(b, F.struct(none(b).alias("kept"), e.alias("ends")), one, lambda acc: acc["kept"]))
    return F.when(size > 0, F.flatten(kept))


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``detections``, an array of
    (label, start, end, rank, rule), words from 0 and end excluded.  Columns of these names are replaced."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = aside(documents, text).withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_low", F.lower("_text"))
    gate = F.col("_low").contains("cc") & F.col("_low").rlike(CC_GATE)
    for g in GATES[::-1]:
        gate = F.col("_low").contains(g) | gate
    words = F.regexp_extract_all(F.translate("_text", upper, lower), F.lit(WORD), F.lit(0))
    df = df.withColumns({
        "n_words": F.regexp_count("_text", F.lit(ANY_CASE)).cast("long"),
        "_line": F.when(gate, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))),
    })
    line = F.col("_line")
    keys = F.array(*[F.lit(k) for k in sorted({_key(r[1]) for r in rules()})])
    df = df.withColumn("_keys", F.when(line.isNotNull(), F.filter(keys, lambda k: F.contains(line, k))))
    live = F.when(F.size("_keys") > 0, F.filter(_table(), lambda r: F.array_contains("_keys", r["key"]) & F.rlike(line, r["regex"])))
    base = [F.when(F.contains(line, F.lit(f" {p} ")), _starts(line, F.lit(f"(?<= ){p}(?= )"))) for p in BASE]
    df = df.withColumns({f"_b{k}": F.coalesce(b, F.array().cast("array<int>")) for k, b in enumerate(base)} | {"_live": live})
    df = df.withColumn("_hits", F.array_sort(F.flatten(F.transform("_live", lambda r: _found(line, r)))))
    df = df.withColumn("_kept", F.coalesce(_suppressed(F.col("_hits")), F.filter("_hits", lambda h: F.lit(False))))
    starts = F.concat(*[f"_b{k}" for k in range(len(BASE))])
    names = F.array_compact(F.array(*[F.when(F.size(f"_b{k}") > 0, F.lit(name)) for k, name in enumerate(BASE.values())]))
    more = F.coalesce(F.transform("_kept", lambda h: h["label"]), F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.array_min(F.transform("_kept", lambda h: h["rank"]))
    df = df.withColumns({
        "n_base": F.size(starts).cast("long"), "first_word": F.array_min(starts).cast("long"), "last_word": F.array_max(starts).cast("long"),
        "base_labels": joined(names), "labels": joined(F.concat(names, more)),
        "score": F.coalesce((4 - best) / 4.0, F.when(F.size(starts) > 0, F.lit(0.5)), F.lit(0.0)),
        "detections": F.coalesce(F.transform("_kept", lambda h: F.struct(h["label"].alias("label"), h["start"].alias("start"), (-h["minus_end"]).alias("end"), h["rank"].alias("rank"), h["rule"].alias("rule"))), F.array().cast("array<struct<label:string,start:int,end:int,rank:int,rule:int>>")),
    })
    return restored(df, documents, made)
