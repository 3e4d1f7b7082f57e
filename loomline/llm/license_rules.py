"""Signature rules of the license scan: patterns on words joined by one space, each with its gate words.

A rule is (name, label, priority, weight, gates, pattern). Higher priorities win; of equal ones the longer match.
Rules are written by hand for texts that only one license has, and from the license table below for the ways in
which texts name a license.
"""

from __future__ import annotations

import re

#: Label, names (patterns on words), SPDX identifier as words.
LICENSES = [
    ("mit", r"mit|expat|x11", "mit"),
    ("mit-0", r"mit no attribution|mit 0", "mit 0"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version| v)? 1 1", "apache 1 1"),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?|asl 2 0", "apache 2 0"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", "bsd 2 clause"),
    ("bsd-3-clause", r"(?:modified|new|revised|3 clause|three clause) bsd|bsd (?:3|three) clause", "bsd 3 clause"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", "bsd 4 clause"),
    ("0bsd", r"zero clause bsd|0bsd", "0bsd"),
    ("bsd", r"bsd(?: style)?", "bsd"),
    ("isc", r"isc|internet systems consortium", "isc"),
    ("gpl-1", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?", "gpl 1 0"),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?", "gpl 2 0"),
    ("gpl-3", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2", r"(?:gnu )?(?:lgpl|library general public license)(?: version| v)? ?2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1", "lgpl 2 1"),
    ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?", "lgpl 3 0"),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?", "agpl 3 0"),
    ("gpl", r"gnu (?:gpl|general public license)|gpl", "gpl"),
    ("lgpl", r"gnu lgpl|lgpl|gnu lesser general public license", "lgpl"),
    ("agpl", r"gnu agpl|agpl|gnu affero general public license", "agpl"),
    ("gfdl", r"(?:gnu )?free documentation license|gfdl", "gfdl 1 3"),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2", r"(?:mozilla public license|mpl)(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("epl-1", r"(?:eclipse public license|epl)(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2", r"(?:eclipse public license|epl)(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("cddl-1", r"(?:common development and distribution license|cddl)(?: version| v)? ?1?(?: [01])?", "cddl 1 0"),
    ("cpl-1", r"common public license(?: version| v)? ?1?(?: 0)?", "cpl 1 0"),
    ("artistic-1", r"artistic license(?: version| v)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", r"artistic license(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("bsl-1", r"boost software license(?: version| v)? ?1?(?: 0)?", "bsl 1 0"),
    ("zlib", r"zlib(?: libpng)?", "zlib"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", "wtfpl"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2", "eupl 1 2"),
    ("python-2", r"(?:python software foundation|psf)", "psf 2 0"),
    ("ruby", r"ruby license", "ruby"),
    ("php-3", r"php license(?: version)? 3(?: 0 1)?", "php 3 01"),
    ("openssl", r"openssl license", "openssl"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version| v)? ?1?(?: 1)?|ofl(?: 1 1)?", "ofl 1 1"),
    ("odbl-1", r"open (?:data commons )?open database license|open database license|odbl", "odbl 1 0"),
    ("cc0-1", r"cc0(?: 1 0)?|cc zero|creative commons zero", "cc0 1 0"),
    ("cc-by-nc-sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd 4 0"),
    ("cc-by-nc", r"cc by nc|creative commons attribution non ?commercial", "cc by nc 4 0"),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike", "cc by sa 4 0"),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s?", "cc by nd 4 0"),
    ("cc-by", r"cc by|creative commons attribution", "cc by 4 0"),
    ("elastic-2", r"elastic license(?: version)? ?2?(?: 0)?", "elastic 2 0"),
    ("busl-1.1", r"business source license(?: version)? ?1?(?: 1)?", "busl 1 1"),
    ("sspl-1", r"server side public license(?: version| v)? ?1?", "sspl 1 0"),
]

#: How a text names a license; {n} its names, {i} its identifier. (kind, priority, weight, gates, pattern)
FORMS = [
    ("identifier", 90, 1.0, ("spdx", "identifier"), r"spdx license identifier {i}(?: only| or later)?"),
    ("grant", 80, 0.95, ("license", "licence", "licensed", "released", "distributed", "available", "published", "covered", "governed"), r"(?:licensed|released|distributed|available|published|covered|governed)(?: to you)? (?:under|by|with) (?:(?:the|a) )?(?:terms of )?(?:the )?(?:{n})(?: licen[cs]e)?(?: \d+(?: \d+)?)?(?: or(?: any)? later(?: version)?)?"),
    ("under", 70, 0.9, ("under",), r"under (?:the )?(?:terms of )?(?:the )?(?:{n}) licen[cs]e"),
    ("notice", 65, 0.85, ("see",), r"see (?:the )?(?:{n}) licen[cs]e for (?:more )?(?:details|information)"),
    ("field", 60, 0.8, ("license", "licence"), r"licen[cs]e(?: is)? (?:the )?(?:{n})(?: licen[cs]e)?"),
    ("title", 50, 0.7, ("license", "licence"), r"(?:the )?(?:{n}) licen[cs]e"),
]

#: Texts that stand in one license only. (label, weight, gate words, pattern)
TEXTS = [
    ("mit", 1.0, ("permission",), r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 0.9, ("copies",), r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", 1.0, ("permission",), r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", 0.9, ("permission",), r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", 0.9, ("redistribution",), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 1.0, ("endorse",), r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 1.0, ("advertising",), r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", 1.0, ("apache",), r"apache license version 2 0 january 2004"),
    ("apache-2", 1.0, ("apache",), r"licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2", 0.9, ("apache",), r"www apache org licenses license 2 0"),
    ("gpl-2", 1.0, ("gnu",), r"gnu general public license version 2 june 1991"),
    ("gpl-3", 1.0, ("gnu",), r"gnu general public license version 3 29 june 2007"),
    ("gpl", 0.8, ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 0.8, ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", 0.8, ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 0.8, ("gnu",), r"www gnu org (?:licenses|copyleft) gpl"),
    ("lgpl", 0.8, ("gnu",), r"www gnu org licenses lgpl"),
    ("mpl-2", 1.0, ("mozilla",), r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 0.9, ("mozilla",), r"mozilla org mpl 2 0"),
    ("epl-2", 0.9, ("eclipse",), r"www eclipse org legal epl (?:v )?2(?:0| 0)"),
    ("epl-1", 0.9, ("eclipse",), r"www eclipse org legal epl v10"),
    ("unlicense", 1.0, ("unencumbered",), r"this is free and unencumbered software released into the public domain"),
    ("zlib", 1.0, ("warranty",), r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1", 1.0, ("permission",), r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("cc0-1", 0.9, ("creativecommons",), r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", 0.9, ("creativecommons",), r"creativecommons org licenses by \d"),
    ("cc-by-sa", 0.9, ("creativecommons",), r"creativecommons org licenses by sa \d"),
    ("cc-by-nc", 0.9, ("creativecommons",), r"creativecommons org licenses by nc \d"),
    ("cc-by-nd", 0.9, ("creativecommons",), r"creativecommons org licenses by nd \d"),
    ("cc-by-nc-sa", 0.9, ("creativecommons",), r"creativecommons org licenses by nc sa \d"),
    ("cc-by-nc-nd", 0.9, ("creativecommons",), r"creativecommons org licenses by nc nd \d"),
    ("ofl-1.1", 1.0, ("font",), r"sil open font license version 1 1 26 february 2007"),
    ("wtfpl", 1.0, ("fuck",), r"you just do what the fuck you want to"),
    ("public-domain", 0.7, ("domain",), r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    # MIT, X11 and their relatives
    ("mit", 0.9, ("merchantability",), r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 0.9, ("liability",), r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("mit", 0.8, ("deal",), r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit-0", 1.0, ("furnished",), r"to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", 0.9, ("consortium",), r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", 0.8, ("advertising",), r"except as contained in this notice the names? of (?:the )?(?:above )?copyright holders? shall not be used in advertising or otherwise to promote the sale"),
    ("hpnd", 0.9, ("advertising",), r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("hpnd", 0.8, ("supporting",), r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("ncsa", 1.0, ("illinois",), r"university of illinois ncsa open source license"),
    ("ncsa", 0.8, ("permission",), r"permission is hereby granted free of charge .{1,200}? redistributions of source code must retain"),
    ("jasper", 0.9, ("jasper",), r"jasper license version 2 0"),
    ("curl", 0.9, ("stenberg",), r"copyright and permission notice copyright c \d{4}(?: \d{4})? daniel stenberg"),
    ("icu", 0.9, ("icu",), r"icu license icu 1 8 1 and later"),
    ("unicode", 0.9, ("unicode",), r"unicode inc license agreement data files and software"),
    ("unicode", 0.8, ("unicode",), r"permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files"),
    ("beerware", 1.0, ("beer",), r"you can buy me a beer in return"),
    ("json", 1.0, ("evil",), r"the software shall be used for good not evil"),
    ("mit-cmu", 0.8, ("mellon",), r"carnegie mellon university requests users of this software to return"),
    # BSD
    ("bsd-2-clause", 0.8, ("redistributions",), r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 0.8, ("redistributions",), r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", 0.8, ("disclaimed",), r"any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", 0.7, ("procurement",), r"procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-3-clause", 0.9, ("contributors",), r"neither the names? of the copyright holders? nor the names of (?:its|their|any) contributors may be used"),
    ("bsd-3-clause", 0.9, ("university",), r"neither the name of the university nor the names of its contributors may be used"),
    ("bsd-4-clause", 0.9, ("berkeley",), r"this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-3-clause-clear", 1.0, ("patent",), r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", 0.9, ("contributor",), r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants"),
    ("bsd-2-clause-views", 0.9, ("views",), r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-1-clause", 0.7, ("redistributions",), r"1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    # Apache
    ("apache-2", 0.9, ("apache",), r"you may obtain a copy of the license at http www apache org licenses"),
    ("apache-2", 0.8, ("governing",), r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", 0.7, ("basis",), r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", 0.9, ("apache",), r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 0.9, ("perpetual",), r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2", 0.8, ("prominent",), r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-1.1", 1.0, ("apache",), r"the apache software license version 1 1"),
    ("apache-1.1", 0.9, ("apache",), r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", 0.9, ("apache",), r"this product includes software developed by the apache group"),
    ("llvm-exception", 1.0, ("llvm",), r"llvm exceptions to the apache 2 0 license"),
    # GPL family
    ("gpl", 0.8, ("gnu",), r"you should have received a copy of the gnu general public license along with this (?:program|library|software|package)"),
    ("lgpl", 0.8, ("gnu",), r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software|package)"),
    ("agpl", 0.8, ("gnu",), r"you should have received a copy of the gnu affero general public license along with this (?:program|library|software|package)"),
    ("gpl-2-or-later", 1.0, ("option",), r"either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", 1.0, ("option",), r"either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", 1.0, ("option",), r"either version 2 1 of the license or at your option any later version"),
    ("gpl-2", 0.9, ("published",), r"the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", 0.9, ("published",), r"the gnu general public license version 3 as published by the free software foundation"),
    ("gpl-1", 1.0, ("gnu",), r"gnu general public license version 1 february 1989"),
    ("lgpl-2", 1.0, ("gnu",), r"gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", 1.0, ("gnu",), r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", 1.0, ("gnu",), r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", 1.0, ("gnu",), r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-1", 1.0, ("affero",), r"affero general public license version 1 march 2002"),
    ("gfdl-1.1", 1.0, ("gnu",), r"gnu free documentation license version 1 1 march 2000"),
    ("gfdl-1.2", 1.0, ("gnu",), r"gnu free documentation license version 1 2 november 2002"),
    ("gfdl-1.3", 1.0, ("gnu",), r"gnu free documentation license version 1 3 3 november 2008"),
    ("gfdl", 0.9, ("invariant",), r"with no invariant sections no front cover texts and no back cover texts"),
    ("gpl", 0.6, ("hope",), r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 0.7, ("temple",), r"free software foundation inc 59 temple place suite 330 boston ma"),
    ("gpl", 0.7, ("franklin",), r"free software foundation inc 51 franklin (?:street|st) fifth floor boston ma"),
    ("gpl", 0.7, ("mass",), r"free software foundation inc 675 mass ave cambridge ma"),
    ("gpl", 0.9, ("verbatim",), r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("classpath-exception", 1.0, ("linking",), r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", 1.0, ("gcc",), r"gcc runtime library exception version 3 1"),
    ("bison-exception", 1.0, ("bison",), r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", 1.0, ("autoconf",), r"this file may be distributed as part of a program that contains a configuration script generated by autoconf"),
    ("font-exception", 1.0, ("font",), r"if you create a document which uses this font and embed this font or unaltered portions of this font"),
    ("linux-syscall-note", 1.0, ("kernel",), r"this copyright does not cover user programs that use kernel services by normal system calls"),
    ("agpl", 0.8, ("agpl",), r"www gnu org licenses agpl"),
    ("gfdl", 0.8, ("gnu",), r"www gnu org (?:licenses|copyleft) fdl"),
    # Mozilla, Eclipse, Sun, IBM
    ("mpl-1.0", 1.0, ("mozilla",), r"mozilla public license version 1 0"),
    ("mpl-1.1", 1.0, ("mozilla",), r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", 0.9, ("mpl",), r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", 0.9, ("incompatible",), r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("npl-1.1", 1.0, ("netscape",), r"netscape public license version 1 1"),
    ("epl-2", 1.0, ("eclipse",), r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1", 1.0, ("eclipse",), r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("edl-1", 0.9, ("eclipse",), r"eclipse distribution license v(?:ersion)? ?1 0"),
    ("cddl-1", 0.9, ("subject",), r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.1", 1.0, ("cddl",), r"common development and distribution license cddl version 1 1"),
    ("cpl-1", 1.0, ("common",), r"common public license version 1 0 the accompanying program is provided under the terms of this"),
    ("ipl-1", 1.0, ("ibm",), r"ibm public license version 1 0"),
    ("spl-1", 1.0, ("sun",), r"sun public license version 1 0"),
    ("sissl", 1.0, ("sun",), r"sun industry standards source license"),
    ("apsl-2", 1.0, ("apple",), r"apple public source license version 2 0"),
    ("cpal-1", 1.0, ("attribution",), r"common public attribution license version 1 0"),
    ("qpl-1", 1.0, ("public",), r"the q public license version 1 0"),
    ("rpl-1.5", 1.0, ("reciprocal",), r"reciprocal public license(?: version)? 1 5"),
    ("ms-pl", 1.0, ("microsoft",), r"microsoft public license ms pl"),
    ("ms-rl", 1.0, ("microsoft",), r"microsoft reciprocal license ms rl"),
    ("osl-3", 1.0, ("open",), r"licensed under the open software license version 3 0"),
    ("afl-3", 1.0, ("academic",), r"licensed under the academic free license version 3 0"),
    ("ecl-2", 1.0, ("educational",), r"educational community license version 2 0"),
    ("eupl-1.1", 1.0, ("european",), r"european union public licen[cs]e v(?:ersion)? ?1 1"),
    ("cecill-2.1", 1.0, ("cecill",), r"cecill free software license agreement version 2 1"),
    ("cecill-b", 0.9, ("cecill",), r"cecill b free software license agreement"),
    ("cecill-c", 0.9, ("cecill",), r"cecill c free software license agreement"),
    ("cecill", 0.8, ("cecill",), r"governed by the cecill licen[cs]e under french law"),
    ("mulan-psl-2", 1.0, ("mulan",), r"mulan psl v2"),
    ("upl-1", 1.0, ("universal",), r"the universal permissive license upl version 1 0"),
    ("artistic-2", 0.9, ("artistic",), r"the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("artistic-1", 0.9, ("intent",), r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl-5", 1.0, ("perl",), r"(?:under|on) the same terms as perl(?: 5)? itself"),
    ("python-2", 1.0, ("python",), r"python software foundation license version 2"),
    ("cnri-python", 1.0, ("cnri",), r"cnri open source (?:gpl compatible )?license agreement"),
    ("php-3", 0.9, ("php",), r"this source file is subject to version 3 01? of the php license"),
    ("php-3", 0.9, ("php",), r"this product includes php software freely available from"),
    ("zend-2", 0.9, ("zend",), r"this source file is subject to version 2 00 of the zend license"),
    ("ruby", 0.9, ("ruby",), r"ruby is copyrighted free software by yukihiro matsumoto"),
    ("vim", 0.9, ("vim",), r"vim license(?: i)? there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", 0.9, ("authors",), r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("postgresql", 0.9, ("postgresql",), r"postgresql (?:database management system|license)"),
    ("postgresql", 0.9, ("agreement",), r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("openssl", 1.0, ("openssl",), r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 1.0, ("cryptographic",), r"this product includes cryptographic software written by eric young"),
    ("zlib", 0.9, ("misrepresented",), r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 0.8, ("altered",), r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 1.0, ("png",), r"the png reference library is supplied as is"),
    ("ijg", 1.0, ("jpeg",), r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", 1.0, ("freetype",), r"portions of this software are copyright c \d{4} the freetype project"),
    ("bzip2", 0.9, ("seward",), r"bzip2 and libbzip2 version .{1,40}? julian seward"),
    ("blessing", 1.0, ("forgiveness",), r"may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("info-zip", 1.0, ("info",), r"this is version .{1,40}? of the info zip license"),
    ("w3c", 0.9, ("w3c",), r"w3c software(?: and document)? notice and license"),
    ("wxwindows", 1.0, ("wxwindows",), r"wxwindows library licen[cs]e version 3 1"),
    ("sleepycat", 0.9, ("redistributions",), r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("zpl-2.1", 1.0, ("zope",), r"zope public license zpl version 2 1"),
    ("nist", 0.8, ("standards",), r"this software was developed (?:at|by) the national institute of standards and technology"),
    ("blueoak-1", 1.0, ("blue",), r"blue oak model license version 1 0 0"),
    ("parity-7", 1.0, ("parity",), r"the parity public license 7 0 0"),
    ("hippocratic-2.1", 1.0, ("hippocratic",), r"hippocratic license(?: version)? 2 1"),
    # Content and data
    ("cc0-1", 0.9, ("cc0",), r"cc0 1 0 universal(?: cc0 1 0)? public domain dedication"),
    ("cc0-1", 0.9, ("waived",), r"to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights"),
    ("cc-by", 0.9, ("attribution",), r"creative commons attribution [1-4] \d(?: international| unported| generic)?(?: public)? licen[cs]e"),
    ("cc-by-sa", 0.9, ("sharealike",), r"creative commons attribution sharealike [1-4] \d(?: international| unported| generic)?(?: public)? licen[cs]e"),
    ("cc-by-nc", 0.9, ("noncommercial",), r"creative commons attribution noncommercial [1-4] \d(?: international| unported| generic)?(?: public)? licen[cs]e"),
    ("cc-by-nd", 0.9, ("noderivatives",), r"creative commons attribution noderivatives [1-4] \d(?: international| unported| generic)?(?: public)? licen[cs]e"),
    ("cc-by-nc-sa", 0.9, ("sharealike",), r"creative commons attribution noncommercial sharealike [1-4] \d(?: international| unported| generic)?(?: public)? licen[cs]e"),
    ("cc-by-nc-nd", 0.9, ("noderivatives",), r"creative commons attribution noncommercial noderivatives [1-4] \d(?: international| unported| generic)?(?: public)? licen[cs]e"),
    ("cc-pd", 0.8, ("creativecommons",), r"creativecommons org (?:licenses|publicdomain) (?:publicdomain|mark 1 0)"),
    ("odbl-1", 0.9, ("opendatacommons",), r"opendatacommons org licenses odbl"),
    ("odc-by-1", 0.9, ("opendatacommons",), r"opendatacommons org licenses by"),
    ("pddl-1", 0.9, ("opendatacommons",), r"opendatacommons org licenses pddl"),
    ("ogl-uk-3", 0.9, ("government",), r"open government licen[cs]e(?: for public sector information)?(?: version| v)? ?3 0"),
    ("dl-de-by-2", 0.9, ("datenlizenz",), r"datenlizenz deutschland namensnennung version 2 0"),
    ("etalab-2", 0.9, ("ouverte",), r"licence ouverte(?: open licence)?(?: version)? ?2 0"),
    ("fal-1.3", 0.9, ("art",), r"free art license 1 3"),
    ("ofl-1.1", 0.9, ("font",), r"this font software is licensed under the sil open font license version 1 1"),
    ("bitstream-vera", 1.0, ("vera",), r"bitstream vera is a trademark of bitstream inc"),
    ("apafml", 0.9, ("afm",), r"this file and the \d+ postscript afm files it accompanies may be used"),
    ("lppl-1.3c", 1.0, ("latex",), r"latex project public license(?: either)? version 1 3c?"),
    ("openrail", 0.9, ("rail",), r"(?:creativeml|bigscience|bigcode) open ?rail(?: m)?(?: v1)?"),
    ("llama-community", 0.9, ("llama",), r"llama \d(?: \d)? community license agreement"),
    # Source available and proprietary
    ("busl-1.1", 0.9, ("change",), r"change date .{1,60}? change license"),
    ("sspl-1", 0.9, ("october",), r"server side public license version 1 october 16 2018"),
    ("elastic-2", 0.9, ("managed",), r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 1.0, ("commons",), r"commons clause license condition v1 0"),
    ("polyform-noncommercial", 1.0, ("polyform",), r"polyform noncommercial license 1 0 0"),
    ("polyform-shield", 1.0, ("polyform",), r"polyform shield license 1 0 0"),
    ("fsl-1.1", 1.0, ("functional",), r"functional source license version 1 1"),
    ("proprietary", 0.8, ("unauthorized",), r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 0.7, ("reproduced",), r"no part of this (?:publication|document|work|book) may be reproduced .{1,80}? without (?:the )?(?:prior )?(?:written )?permission"),
    ("proprietary", 0.7, ("trade",), r"contains (?:confidential|proprietary) information and trade secrets"),
    ("proprietary", 0.7, ("eula",), r"end user license agreement eula"),
    ("proprietary", 0.7, ("software",), r"you may not (?:copy|modify|distribute|reverse engineer|decompile|disassemble) (?:or (?:copy|modify|distribute|reverse engineer|decompile|disassemble) )?the software"),
    ("proprietary", 0.7, ("evaluation",), r"for evaluation purposes only not for (?:production|commercial) use"),
    ("non-commercial", 0.7, ("commercial",), r"(?:for|free for) (?:personal and )?non ?commercial use only"),
    ("non-commercial", 0.7, ("commercial",), r"may not be used for commercial purposes"),
    ("research-only", 0.7, ("research",), r"for (?:academic )?research (?:and educational )?(?:use|purposes) only"),
    ("public-domain", 0.8, ("domain",), r"this (?:software|work|file|code) is (?:hereby )?(?:in|released (?:in)?to|dedicated to) the public domain"),
    ("public-domain", 0.8, ("disclaims",), r"the authors? (?:hereby )?disclaims? copyright to this source code"),
    ("public-domain", 0.7, ("government",), r"(?:this is )?a work of the (?:u s|united states) government and is not subject to copyright"),
    ("proprietary", 0.6, ("rights",), r"all rights reserved"),
    ("proprietary", 0.8, ("confidential",), r"proprietary and confidential"),
]

#: The base phrases, each of which keeps its label whatever else is found.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def rules() -> list[tuple[str, str, int, float, tuple[str, ...], re.Pattern]]:
    """All rules, by falling priority."""
    out = [(f"text:{i}", label, 100, weight, gates, re.compile(rf"(?<![^ ]){p}(?![^ ])")) for i, (label, weight, gates, p) in enumerate(TEXTS)]
    for label, names, ident in LICENSES:
        for kind, priority, weight, gates, form in FORMS:
            out.append((f"{kind}:{label}", label, priority, weight, gates, re.compile(rf"(?<![^ ]){form.format(n=names, i=ident)}(?![^ ])")))
    return sorted(out, key=lambda r: -r[2])
