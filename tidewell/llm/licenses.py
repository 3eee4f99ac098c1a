"""License scans by ordered signature rules.

Rules are regular expressions over a text's normalised words, each with a label, a priority and a keyword. One
Aho-Corasick pass finds the keywords that occur; only their rules run. Of overlapping detections, one that lies within
a kept detection of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Every byte that ends a word, as a space; A-Z as a-z. Bytes over 7F belong to words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Label, name as it stands in prose (a regular expression over normalised words), SPDX words, versions.
FAMILIES: list[tuple[str, str, str, str]] = [
    ("mit", r"mit|expat", "mit", ""),
    ("apache", r"apache(?: software)?", "apache", "1 0|1 1|2 0|2"),
    ("bsd-2-clause", r"(?:simplified|two clause|2 clause) bsd|bsd 2 clause", "bsd 2 clause", ""),
    ("bsd-3-clause", r"(?:new|modified|revised|three clause|3 clause) bsd|bsd 3 clause", "bsd 3 clause", ""),
    ("bsd-4-clause", r"(?:original|four clause|4 clause) bsd|bsd 4 clause", "bsd 4 clause", ""),
    ("bsd", r"bsd", "0bsd", ""),
    ("gpl", r"gnu general public|gnu gpl|gpl", "gpl", "1 0|2 0|3 0|1|2|3"),
    ("lgpl", r"gnu (?:lesser|library) general public|gnu lgpl|lgpl", "lgpl", "2 0|2 1|3 0|2|3"),
    ("agpl", r"gnu affero general public|affero general public|agpl", "agpl", "1 0|3 0|3"),
    ("gfdl", r"gnu free documentation|gfdl", "gfdl", "1 1|1 2|1 3"),
    ("mpl", r"mozilla public|mpl", "mpl", "1 0|1 1|2 0"),
    ("epl", r"eclipse public|epl", "epl", "1 0|2 0"),
    ("edl", r"eclipse distribution", "edl", "1 0"),
    ("cddl", r"common development and distribution|cddl", "cddl", "1 0|1 1"),
    ("cpl", r"common public", "cpl", "1 0"),
    ("eupl", r"european union public|eupl", "eupl", "1 1|1 2"),
    ("artistic", r"artistic", "artistic", "1 0|2 0"),
    ("isc", r"isc", "isc", ""),
    ("zlib", r"zlib(?: libpng)?", "zlib", ""),
    ("unlicense", r"unlicense", "unlicense", ""),
    ("wtfpl", r"do what the \w+ you want to public|wtfpl", "wtfpl", "2"),
    ("boost", r"boost software", "bsl", "1 0"),
    ("python", r"python software foundation|psf", "python", "2 0|2"),
    ("postgresql", r"postgresql", "postgresql", ""),
    ("openssl", r"openssl", "openssl", ""),
    ("openldap", r"openldap public", "oldap", "2 8"),
    ("php", r"php", "php", "3 0|3 01"),
    ("ruby", r"ruby", "ruby", ""),
    ("vim", r"vim", "vim", ""),
    ("w3c", r"w3c(?: software)?", "w3c", ""),
    ("ncsa", r"university of illinois ncsa|ncsa", "ncsa", ""),
    ("ofl", r"sil open font|open font|ofl", "ofl", "1 0|1 1"),
    ("odbl", r"open database|odbl", "odbl", "1 0"),
    ("odc-by", r"open data commons attribution", "odc by", "1 0"),
    ("pddl", r"public domain dedication and", "pddl", "1 0"),
    ("ms-pl", r"microsoft public", "ms pl", ""),
    ("ms-rl", r"microsoft reciprocal", "ms rl", ""),
    ("osl", r"open software", "osl", "1 0|2 0|2 1|3 0"),
    ("afl", r"academic free", "afl", "2 1|3 0"),
    ("ecl", r"educational community", "ecl", "1 0|2 0"),
    ("ipl", r"ibm public", "ipl", "1 0"),
    ("lppl", r"latex project public|lppl", "lppl", "1 2|1 3|1 3c"),
    ("qpl", r"q public", "qpl", "1 0"),
    ("spl", r"sun public", "spl", "1 0"),
    ("zpl", r"zope public", "zpl", "1 1|2 0|2 1"),
    ("sspl", r"server side public|sspl", "sspl", "1|1 0"),
    ("busl", r"business source", "busl", "1 1"),
    ("elastic", r"elastic", "elastic", "2 0|2"),
    ("commons-clause", r"commons clause", "commons clause", ""),
    ("json", r"json", "json", ""),
    ("beerware", r"beer ?ware", "beerware", ""),
    ("upl", r"universal permissive", "upl", "1 0"),
    ("cecill", r"cecill", "cecill", "1 0|2 0|2 1"),
    ("llama", r"llama(?: \d)* community", "llama", "2|3"),
    ("openrail", r"(?:big(?:science|code) )?open ?rail(?: m)?", "openrail", ""),
    ("cc0", r"cc0|creative commons zero", "cc0", "1 0"),
    ("cc-by-nc-nd", r"cc by nc nd|(?:creative commons )?attribution non ?commercial no ?deriv\w*", "cc by nc nd", "2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", r"cc by nc sa|(?:creative commons )?attribution non ?commercial share ?alike", "cc by nc sa", "2 0|2 5|3 0|4 0"),
    ("cc-by-nc", r"cc by nc|(?:creative commons )?attribution non ?commercial", "cc by nc", "2 0|2 5|3 0|4 0"),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv\w*", "cc by nd", "2 0|2 5|3 0|4 0"),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike", "cc by sa", "2 0|2 5|3 0|4 0"),
    ("cc-by", r"cc by|creative commons attribution", "cc by", "2 0|2 5|3 0|4 0"),
]

#: Label, priority, keywords (one stands in whatever the expression matches), expression of sentences, notices and short references of one license.
SENTENCES: list[tuple[str, int, str, str]] = [
    ("mit", 80, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 75, "without restriction", r"deal in the software without restriction including without limitation"),
    ("mit", 75, "permission notice", r"above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 70, "opensource org", r"opensource org licenses mit(?: license)?(?: php)?"),
    ("mit", 70, "in no event shall", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 55, "mit", r"mit style licen[sc]e|mit x11(?: licen[sc]e)?|x11 mit"),
    ("mit", 45, "mit", r"(?:see|under|is|the) (?:the )?mit (?:terms|file|text)"),
    ("isc", 80, "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 72, "author disclaims", r"software is provided as is and the author disclaims all warranties"),
    ("isc", 70, "opensource org", r"opensource org licenses isc(?: license)?"),
    ("bsd", 70, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 68, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 68, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 55, "bsd", r"bsd style licen[sc]e"),
    ("bsd", 55, "berkeley", r"berkeley software distribution"),
    ("bsd-2-clause", 70, "opensource org", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", 70, "opensource org", r"opensource org licenses bsd 3 clause"),
    ("bsd-3-clause", 75, "endorse or promote", r"neither the name of .{1,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", 76, "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", 80, "redistribute it", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 74, "gnu general public", r"you should have received a copy of the gnu general public license"),
    ("gpl", 74, "gnu general public", r"see the gnu general public license for more details"),
    ("gpl", 60, "gnu org", r"gnu org licenses gpl(?: html)?"),
    ("gpl-2", 76, "gnu org", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", 76, "gnu org", r"gnu org licenses gpl 3 0"),
    ("gpl-2", 66, "gplv2", r"gplv2(?: (?:or later|only))?"),
    ("gpl-3", 66, "gplv3", r"gplv3(?: (?:or later|only))?"),
    ("lgpl", 80, "redistribute it", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", 74, "general public", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", 66, "lgplv2", r"lgplv2 1(?: (?:or later|only))?"),
    ("lgpl-3", 66, "lgplv3", r"lgplv3(?: (?:or later|only))?"),
    ("lgpl", 60, "gnu org", r"gnu org licenses lgpl(?: html)?"),
    ("agpl", 80, "affero", r"under the terms of the gnu affero general public license"),
    ("agpl-3", 66, "agplv3", r"agplv3(?: (?:or later|only))?"),
    ("agpl", 60, "gnu org", r"gnu org licenses agpl(?: html)?"),
    ("gfdl", 78, "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", 80, "mozilla public", r"this source code form is subject to the terms of the mozilla public license(?: v(?:ersion)? 2 0)?"),
    ("mpl-2", 72, "mozilla org", r"mozilla org mpl 2 0"),
    ("mpl-1.1", 74, "mozilla org", r"mozilla org mpl 1 1"),
    ("epl", 78, "eclipse public", r"accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-2", 72, "eclipse org", r"eclipse org legal epl (?:2 0|v20)"),
    ("epl-1", 72, "eclipse org", r"eclipse org legal epl (?:1 0|v10)"),
    ("cddl", 78, "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("apache-2", 80, "apache license", r"licensed under the apache license version 2 0 the license"),
    ("apache-2", 74, "apache org", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", 72, "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 60, "apache", r"apache ?2(?: 0)?"),
    ("apache-2", 60, "asl", r"asl ?2(?: 0)?"),
    ("zlib", 80, "provided as is without", r"this software is provided as is without any express or implied warranty"),
    ("zlib", 76, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 74, "altered source versions", r"altered source versions must be plainly marked as such"),
    ("unlicense", 80, "unencumbered software", r"free and unencumbered software released into the public domain"),
    ("unlicense", 70, "unlicense org", r"unlicense org"),
    ("wtfpl", 80, "you want to", r"you just do what the \w+ you want to"),
    ("wtfpl", 70, "wtfpl net", r"wtfpl net"),
    ("beerware", 78, "beer in return", r"you can buy me a beer in return"),
    ("boost-1", 78, "boost software", r"distributed under the boost software license version 1 0"),
    ("boost-1", 72, "boost org", r"boost org license 1 0(?: txt)?"),
    ("python", 76, "psf", r"psf license agreement(?: for python)?"),
    ("postgresql", 78, "without a written agreement", r"without fee and without a written agreement is hereby granted"),
    ("openssl", 78, "openssl toolkit", r"software developed by the openssl project for use in the openssl toolkit"),
    ("php", 76, "php net", r"php net license(?: \d \d\d)?"),
    ("ncsa", 78, "with the software without restriction", r"to deal with the software without restriction"),
    ("artistic-2", 76, "artistic", r"under the (?:terms of the )?artistic license(?: version)? 2 0"),
    ("artistic", 70, "perl itself", r"under the same terms as perl itself"),
    ("ruby", 70, "ruby s license", r"ruby s license"),
    ("vim", 74, "vim license", r"distribute(?:d)? under the vim license"),
    ("ofl-1.1", 78, "sil open font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl", 70, "scripts sil org", r"scripts sil org ofl"),
    ("odbl", 74, "opendatacommons", r"opendatacommons org licenses odbl(?: \d \d)?"),
    ("odc-by", 74, "opendatacommons", r"opendatacommons org licenses by(?: \d \d)?"),
    ("pddl", 74, "opendatacommons", r"opendatacommons org licenses pddl(?: \d \d)?"),
    ("sspl", 76, "server side public", r"under the terms of the server side public license"),
    ("busl", 76, "change date", r"on the change date .{0,60}? under the terms of the change license"),
    ("elastic-2", 72, "elastic co", r"elastic co licensing elastic license"),
    ("commons-clause", 76, "right to sell", r"does not grant to you the right to sell the software"),
    ("json", 80, "good not evil", r"shall be used for good not evil"),
    ("eupl", 74, "joinup", r"joinup ec europa eu (?:software|collection) (?:page )?eupl"),
    ("cecill", 74, "cecill info", r"cecill info(?: licences)?"),
    ("llama", 74, "llama", r"llama \d(?: \d)? (?:is|materials are) licensed under the llama"),
    ("openrail", 72, "use based restrictions", r"use based restrictions (?:as )?(?:referenced|set forth) in"),
    ("public-domain", 60, "public domain", r"(?:released|dedicated|placed|put) (?:in|in to|into|to) the public domain"),
    ("public-domain", 58, "public domain", r"this (?:work|file|software|text|document) is in the public domain"),
    ("public-domain", 58, "no known copyright", r"no known copyright (?:restrictions?)?"),
    ("proprietary", 60, "rights reserved", r"all rights reserved"),
    ("proprietary", 60, "confidential", r"proprietary and confidential"),
    ("proprietary", 60, "unauthori", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:of this \w+ )?(?:\w+ ){0,6}?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", 58, "may not be reproduced", r"may not be reproduced (?:\w+ ){0,8}?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    ("proprietary", 56, "end user licen", r"end user licen[sc]e agreement"),
    ("non-commercial", 56, "commercial", r"for non ?commercial (?:use|purposes) only"),
    ("non-commercial", 56, "personal use", r"for personal use only"),
    ("research-only", 56, "research", r"for (?:academic )?research (?:use|purposes) only"),
    ("cc-by", 65, "creativecommons", r"creativecommons org licenses by(?: \d \d)?"),
    ("cc-by-nc", 66, "creativecommons", r"creativecommons org licenses by nc(?: \d \d)?"),
    ("cc-by-sa", 66, "creativecommons", r"creativecommons org licenses by sa(?: \d \d)?"),
    ("cc-by-nd", 66, "creativecommons", r"creativecommons org licenses by nd(?: \d \d)?"),
    ("cc-by-nc-sa", 67, "creativecommons", r"creativecommons org licenses by nc sa(?: \d \d)?"),
    ("cc-by-nc-nd", 67, "creativecommons", r"creativecommons org licenses by nc nd(?: \d \d)?"),
    ("cc0", 66, "creativecommons", r"creativecommons org publicdomain zero(?: \d \d)?"),
    ("cc0", 68, "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("mit-0", 82, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .{0,700}? to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("mit", 66, "choosealicense", r"choosealicense com licenses mit"),
    ("mit", 66, "mit license org", r"mit license org"),
    ("mit", 58, "license mit|licence mit", r"license mit(?: expat)?|licence mit(?: expat)?"),
    ("mit-modern-variant", 76, "without written agreement", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute"),
    ("hpnd", 78, "its documentation for any", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("hpnd", 70, "in supporting documentation", r"above copyright notice appears? in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("x11", 76, "x consortium", r"name of the x consortium shall not be used in advertising"),
    ("bsd-0", 82, "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-1-clause", 72, "redistribution of source code", r"redistribution of source code must retain the above copyright notice this condition and the following disclaimer"),
    ("bsd-2-clause", 66, "freebsd", r"freebsd licen[sc]e|freebsd documentation licen[sc]e"),
    ("bsd-3-clause", 74, "to endorse or promote", r"names? of (?:its|the) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", 78, "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-patent", 76, "patent", r"each copyright holder and contributor hereby grants to (?:those|you) .{0,120}? a perpetual worldwide non exclusive no charge royalty free irrevocable .{0,60}? patent license"),
    ("bsd-4-clause", 74, "university of california", r"this product includes software developed by the university of california berkeley"),
    ("bsd", 66, "as is and any express", r"this software is provided by the .{0,80}? as is and any express or implied warranties including but not limited to"),
    ("bsd-protection", 70, "bsd protection", r"bsd protection license"),
    ("apache-1.1", 78, "apache software foundation", r"this product includes software developed by the apache software foundation http www apache org"),
    ("apache-1", 76, "apache group", r"this product includes software developed by the apache group"),
    ("apache-1.1", 70, "apache org", r"apache org licenses license 1 1"),
    ("apache-2", 76, "applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 74, "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2", 66, "opensource org", r"opensource org licenses apache 2 0"),
    ("apache-2-llvm-exception", 84, "llvm", r"apache license v? ?2 0 with llvm exceptions?"),
    ("gpl", 72, "this program is free", r"this program is free software you can redistribute it and or modify"),
    ("gpl", 70, "any warranty", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", 62, "copyleft", r"gnu copyleft"),
    ("gpl-2-only", 82, "version 2 of the gnu|public license version 2", r"under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2) (?:only|as published by the free software foundation)(?! either)"),
    ("gpl-2-or-later", 83, "either version 2", r"either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", 83, "either version 3", r"either version 3 of the license or at your option any later version"),
    ("gpl-2-with-classpath-exception", 84, "classpath", r"(?:gpl|gnu general public license) .{0,40}? with (?:the )?classpath exception"),
    ("gpl-2-with-classpath-exception", 78, "independent modules", r"permission to link this library with independent modules to produce an executable"),
    ("gpl-with-gcc-exception", 78, "gcc runtime", r"gcc runtime library exception"),
    ("gpl-with-font-exception", 76, "which uses this font", r"as a special exception if you create a document which uses this font"),
    ("gpl-with-autoconf-exception", 76, "configuration script", r"as a special exception .{0,120}? configuration script generated by autoconf"),
    ("gpl-with-bison-exception", 76, "bison", r"as a special exception .{0,120}? bison parser skeleton"),
    ("linux-syscall-note", 80, "syscall", r"linux syscall note"),
    ("lgpl-2-or-later", 83, "either version 2", r"gnu library general public license .{0,80}? either version 2 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", 84, "either version 2 1", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl", 72, "this library is free", r"this library is free software you can redistribute it and or modify"),
    ("agpl-3-or-later", 84, "affero", r"gnu affero general public license .{0,80}? either version 3 of the license or at your option any later version"),
    ("agpl", 74, "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", 76, "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gnu-all-permissive", 78, "any medium without royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsf-unlimited", 78, "unlimited permission", r"(?:this \w+ is free software the )?free software foundation .{0,40}? gives unlimited permission to copy and or distribute it"),
    ("mpl-1.1", 76, "mozilla public", r"contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2-no-copyleft-exception", 78, "incompatible with secondary", r"incompatible with secondary licenses as defined by the mozilla public license"),
    ("npl", 74, "netscape public", r"netscape public license(?: version)?(?: 1 [01])?"),
    ("epl", 74, "eclipse foundation", r"eclipse foundation software user agreement"),
    ("edl", 74, "eclipse org", r"eclipse org org documents edl v10"),
    ("cddl", 72, "opensolaris", r"opensolaris org os licensing"),
    ("cpal", 76, "attribution license", r"common public attribution license(?: version)?(?: 1 0)?"),
    ("apsl", 76, "apple public source", r"apple public source license(?: version)?(?: \d \d)?"),
    ("apple-sample", 74, "apple software", r"in consideration of your agreement to abide by the following terms .{0,120}? apple software"),
    ("aladdin", 74, "aladdin", r"aladdin free public license"),
    ("intel", 72, "intel", r"intel open source license|intel simplified software license"),
    ("nasa", 74, "nasa open source", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("rpl", 74, "reciprocal public", r"reciprocal public license(?: version)?(?: 1 \d)?"),
    ("motosoto", 72, "motosoto", r"motosoto open source license"),
    ("nokia", 72, "nokia open source", r"nokia open source license"),
    ("sleepycat", 76, "sleepycat|accompanied by information", r"sleepycat (?:public )?license|redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("watcom", 72, "watcom", r"sybase open watcom public license"),
    ("xnet", 72, "x net", r"x net license"),
    ("sgi-b", 74, "sgi free software", r"sgi free software license b"),
    ("curl", 76, "curl|hereby granted provided", r"curl license|permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("libpng", 76, "libpng|png reference library", r"libpng license|the png reference library is supplied as is"),
    ("libtiff", 74, "sam leffler", r"names of sam leffler and silicon graphics may not be used"),
    ("ijg", 76, "independent jpeg", r"based in part on the work of the independent jpeg group"),
    ("bzip2", 74, "bzip2", r"bzip2 (?:and libbzip2 )?license|this program bzip2 the associated library libbzip2"),
    ("info-zip", 74, "info zip", r"info zip license|for the purposes of this copyright and license info zip is defined"),
    ("freetype", 76, "freetype", r"freetype (?:project )?licen[sc]e|portions of this software are copyright .{0,30}? the freetype project"),
    ("imagemagick", 74, "imagemagick", r"imagemagick licen[sc]e"),
    ("icu", 76, "unicode|icu license", r"icu license|unicode terms of use|unicode inc license agreement"),
    ("tcl", 74, "tcl|copyrighted by the regents", r"tcl tk license|this software is copyrighted by the regents of the university of california sun microsystems"),
    ("tex", 70, "knuth", r"copyright .{0,20}? donald e knuth"),
    ("lppl-1.3c", 78, "latex project public", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("perl", 74, "perl", r"same terms as (?:the )?perl(?: ?5)?(?: programming language)?(?: system)?(?: itself)?"),
    ("clarified-artistic", 74, "clarified artistic", r"clarified artistic license"),
    ("python-cnri", 76, "cnri", r"cnri (?:open source )?(?:python )?licen[sc]e agreement"),
    ("python-beopen", 74, "beopen", r"beopen (?:com )?(?:python )?open source license agreement"),
    ("zpl", 74, "zope", r"zope public license zpl(?: version)?(?: \d \d)?"),
    ("w3c", 76, "w3c", r"w3c software (?:and document )?notice and license"),
    ("oasis", 70, "oasis", r"oasis intellectual property rights policy"),
    ("ietf", 74, "ietf trust", r"ietf trust s legal provisions relating to ietf documents"),
    ("blue-oak", 76, "blue oak", r"blue oak model license(?: 1 0 0)?"),
    ("parity", 74, "parity public", r"parity public license(?: \d 0 0)?"),
    ("polyform-noncommercial", 78, "polyform", r"polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-small-business", 76, "polyform", r"polyform small business license"),
    ("polyform", 70, "polyform", r"polyform (?:strict|shield|internal use|perimeter|free trial) license"),
    ("hippocratic", 76, "hippocratic", r"hippocratic license(?: version)?(?: \d \d)?"),
    ("anti-996", 74, "996", r"anti 996 license"),
    ("mulan", 76, "mulan", r"mulan (?:permissive|public) (?:software )?license(?: v?\d)?"),
    ("cecill-b", 76, "cecill b", r"cecill b(?: free software)?(?: license)?"),
    ("cecill-c", 76, "cecill c", r"cecill c(?: free software)?(?: license)?"),
    ("etalab", 76, "licence ouverte", r"licence ouverte(?: etalab)?(?: version)?(?: 2 0)?"),
    ("ogl", 76, "open government", r"open government licen[sc]e(?: v?\d(?: 0)?)?"),
    ("open-game", 72, "open game", r"open game license(?: version)?(?: 1 0a?)?"),
    ("dbcl", 74, "database contents", r"database contents license(?: dbcl)?"),
    ("cdla-permissive", 76, "cdla|community data license", r"community data license agreement permissive|cdla permissive(?: \d 0)?"),
    ("cdla-sharing", 76, "cdla|community data license", r"community data license agreement sharing|cdla sharing(?: 1 0)?"),
    ("c-uda", 74, "computational use", r"computational use of data agreement"),
    ("gemma", 74, "gemma", r"gemma terms of use|gemma is provided under and subject to the gemma terms"),
    ("falcon", 72, "falcon", r"falcon llm license|tii falcon llm license"),
    ("stability", 72, "stability ai", r"stability ai (?:non ?commercial research )?community license(?: agreement)?"),
    ("openai-terms", 70, "openai", r"openai (?:terms of use|model license)"),
    ("research-only", 60, "research licen", r"non ?commercial (?:bespoke )?research licen[sc]e"),
    ("evaluation-only", 58, "evaluation", r"for (?:internal )?evaluation (?:use|purposes) only"),
    ("non-commercial", 60, "commercial use", r"commercial use (?:of this \w+ )?is (?:strictly )?(?:prohibited|not (?:permitted|allowed))"),
    ("no-ai-training", 66, "may not be used", r"may not be used (?:to train|for training|in the training of) (?:any )?(?:machine learning|artificial intelligence|ai|language) (?:models?|systems?)"),
    ("no-ai-training", 64, "text and data mining", r"rights? (?:to|for|of) text and data mining (?:is|are) (?:expressly )?reserved"),
    ("proprietary", 62, "information of", r"contains (?:confidential (?:and|or) )?(?:proprietary|trade secret) information of"),
    ("proprietary", 58, "internal use", r"for internal use only(?: not for distribution)?"),
    ("proprietary", 58, "subject to the terms", r"use of this (?:software|document|site) is subject to the terms of (?:the|a|your) (?:license|subscription|service) agreement"),
    ("us-government", 74, "work of the|not subject to copyright", r"work of the (?:united states|u s) government|not subject to copyright (?:protection )?in the united states"),
    ("us-government", 70, "title 17", r"title 17 (?:section|united states code section) 105"),
    ("public-domain", 62, "public domain|disclaim", r"(?:author|authors) (?:hereby )?(?:disclaims? copyright|dedicate \w+ .{0,40}? to the public domain)"),
    ("public-domain", 62, "disclaims copyright", r"the author disclaims copyright to this source code"),
    ("public-domain", 58, "public domain", r"public domain (?:work|mark|dedication|software|file|image|text)s?"),
    ("public-domain-mark", 70, "creativecommons", r"creativecommons org publicdomain mark(?: \d \d)?"),
    ("public-domain", 30, "public domain", r"public domain"),
    ("cc0", 72, "to the extent possible", r"to the extent possible under law .{0,80}? has waived"),
    ("cc-by", 58, "creative commons", r"creative commons (?:licen[sc]e )?by(?: \d \d)?"),
    ("cc-sampling", 66, "creativecommons", r"creativecommons org licenses (?:nc )?sampling"),
    ("cc-devnations", 66, "creativecommons", r"creativecommons org licenses devnations"),
    ("fair-license", 74, "usage of the works", r"usage of the works is permitted provided that this instrument is retained"),
    ("wordnet", 74, "wordnet", r"wordnet \d(?: \d)? license|wordnet release \d \d license"),
    ("ubuntu-font", 74, "ubuntu font", r"ubuntu font licen[sc]e(?: version)?(?: 1 0)?"),
    ("bitstream-vera", 74, "bitstream", r"bitstream vera (?:is a trademark|fonts? (?:copyright|license))"),
    ("liberation-font", 72, "liberation font", r"liberation font(?:s| software)? license"),
    ("gust-font", 72, "gust font", r"gust font (?:source )?license"),
    ("ssl-leay", 78, "eric young", r"this product includes cryptographic software written by eric young"),
    ("oracle-bcl", 74, "binary code", r"oracle binary code license agreement|sun binary code license agreement"),
    ("upl-1", 76, "universal permissive", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software .{0,80}? universal permissive license"),
    ("ms-pl", 74, "ms pl", r"microsoft public license ms pl"),
    ("ms-limited", 72, "microsoft limited", r"microsoft limited (?:public|reciprocal|community) license"),
    ("zero-bsd", 60, "0bsd|zero clause bsd", r"0bsd(?: license)?|zero clause bsd"),
    ("unlicense", 72, "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("copyfree", 60, "copyfree", r"copyfree (?:open innovation )?license"),
    ("isc", 60, "openbsd", r"openbsd (?:isc )?licen[sc]e"),
    ("gpl", 50, "copyleft", r"copyleft"),
]

#: Verbs that introduce a license, and words that deny it.
_VERBS = "licensed released distributed available published provided covered governed".split()
_DENIALS = ("not", "never", "no longer", "neither", "not being", "not be")
#: Above every rule but phrases: what a denial holds is no detection, and it is none itself.
DENIED = 95


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    confidence: float
    #: Places of a phrase are all reported, also where they overlap or lie within other detections.
    phrase: bool = False


#: Words that introduce a license: "released under the terms of the ...".
_UNDER = r"(?:licensed|released|distributed|available|published|provided|covered|governed) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
#: How a version stands after a name.
_VERSION = r"(?:public )?(?:license |licence |licenses )?(?:version |ver |v ?)?"
#: How later versions are allowed after one.
_LATER = r" (?:or (?:any )?(?:later|newer|greater|higher)(?: versions?)?|or at your option any later version|and later|plus)"


def _versioned(label: str, version: str) -> str:
    """One label a license: the major version, with what follows it unless that is 0; Creative Commons has no versions."""
    return label if label.startswith("cc") else f"{label}-" + version.replace(" ", ".").removesuffix(".0")


@lru_cache(4)
def rules(phrases: tuple[tuple[str, str], ...] = ()) -> tuple[Rule, ...]:
    """The ordered rules: the phrases, denials, forms of the names and versions, then the sentences by hand. GNU licenses of a
    version only, and of a version or later, have labels of their own."""
    out = []

    def add(label: str, priority: int, keyword: str, pattern: str, confidence: float) -> None:
        out.append(Rule(label, priority, keyword, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), confidence))

    for phrase, label in phrases:
        out.append(Rule(label, 100, phrase, re.compile(rf"(?<![^ ])(?={re.escape(phrase)}(?![^ ]))"), 0.9, True))
    for label, name, spdx, versions in FAMILIES:
        words = _keywords(name)
        for v in [*versions.split("|")] if versions else []:
            major = _versioned(label, v)
            kept = label in ("gpl", "lgpl", "agpl", "gfdl")
            ends = ((major, ""), (f"{major}-or-later", _LATER), (f"{major}-only", " only")) if kept else ((major, f"(?:{_LATER}| only)?"),)
            for k in words:
                for of, end in ends:
                    add(of, 60 + (end == " only") + (end == _LATER), k, rf"(?:{name}) {_VERSION}{v}{end}", 0.9)
                    add(of, 70 + (end == " only") + (end == _LATER), k, rf"{_UNDER}(?:{name}) {_VERSION}{v}{end}", 0.98)
            for of, end in ends:
                add(of, 90 + (end == " only") + (end == _LATER), "spdx license identifier", rf"spdx license identifier {spdx} {v}{end}", 1.0)
        for k in words:
            add(label, 40, k, rf"(?:{name}) (?:public )?licen[sc]ed?", 0.8)
            add(label, 50, k, rf"{_UNDER}(?:{name})(?: licen[sc]e)?", 0.95)
        add(label, 85, "spdx license identifier", rf"spdx license identifier {spdx}", 0.99)
    names = "|".join(name for _, name, _, _ in FAMILIES)
    under = _UNDER.partition(") ")[2]  # what follows the verb
    for denial in _DENIALS:
        for verb in _VERBS:
            add("", DENIED, f"{denial} {verb}", rf"{denial} {verb} {under}(?:{names})(?: {_VERSION}\d(?: \d)?(?:{_LATER}| only)?)?(?: (?:public )?licen[sc]es?)?", 0.0)
    for label, priority, keyword, pattern in SENTENCES:
        add(label, priority, keyword, pattern, 0.9)
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern.pattern)))


def _keywords(name: str) -> list[str]:
    """A literal from every alternative of a name: its longest run of plain words."""
    plain, depth, parts = [], 0, [""]
    for c in name:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    for p in parts:
        p = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)[?*]?|\\\w[+*]?|. ?\?", "#", p)
        plain.append(max((x.strip() for x in p.split("#")), key=len))
    return list(dict.fromkeys(plain))


@lru_cache(4)
def _automaton(phrases: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for i, r in enumerate(rules(phrases)):
        for k in [r.keyword] if r.phrase else r.keyword.split("|"):
            found.setdefault(k, []).append(i)
    auto = ahocorasick.Automaton()
    for k, ids in found.items():
        auto.add_word(k, tuple(ids))
    auto.make_automaton()
    return auto


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    confidence: float


def normalised(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class _Cover:
    """The furthest end of any interval that starts at or before a place (a Fenwick tree of maxima over starts)."""

    def __init__(self, starts: list[int]) -> None:
        self.starts = sorted(set(starts))
        self.ends = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i

    def end_from(self, start: int) -> int:
        i, best = bisect_left(self.starts, start) + 1, -1
        while i:
            best = max(best, self.ends[i])
            i -= i & -i
        return best


def detect(words: Sequence[str], phrases: tuple[tuple[str, str], ...] = ()) -> tuple[list[tuple[str, int]], list[Detection]]:
    """Places of the phrases (label, word number), and the other rules' detections after suppression, in word numbers.

    A detection goes where an earlier one contains it: of higher priority, or the same and longer. Keywords are looked
    for once; a rule of a found keyword runs once over the text; suppression and numbering are n log n.
    """
    joined = " ".join(words)
    every = rules(phrases)
    gated = sorted({i for _, ids in _automaton(phrases).iter(joined) for i in ids})
    at = np.cumsum([0, *(len(w) + 1 for w in words)])
    places, raw = [], []
    for i in gated:
        r = every[i]
        if r.phrase:
            places += [(r.label, int(w)) for w in np.searchsorted(at, [m.start() for m in r.pattern.finditer(joined)])]
        else:
            raw += [(r.priority, m.start(), m.end(), r.label, r.confidence) for m in r.pattern.finditer(joined)]
    raw = sorted(set(raw), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3], -x[4]))
    cover, kept = _Cover([d[1] for d in raw]), []
    for d in raw:
        if cover.end_from(d[1]) < d[2]:
            kept.append(d)
            cover.add(d[1], d[2])
    first, last = (np.searchsorted(at, [d[k] for d in kept], "right") for k in (1, 2))
    found = [Detection(int(s) - 1, int(e), label, p, c) for s, e, (p, _, _, label, c) in zip(first, last, kept) if label]
    return places, sorted(found, key=lambda d: (d.start, d.end, d.label))


def scan_licenses(docs: DataFrame, phrases: Sequence[tuple[str, str]], id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, n_words, base (label, places), detections and score.

    ``phrases`` are (phrase, label), in normalised words: rules whose places are all kept. Null and empty texts have no
    words, no detections and score 0. Whole texts are read; columns other than id and text are not.
    """
    wanted = tuple((p, label) for p, label in phrases)
    detection = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())])
    base = pa.struct([("label", pa.string()), ("word", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bases, found, score = [], [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                words = [w.decode("utf-8") for w in normalised(text)]
                places, hits = detect(words, wanted)
                n.append(len(words))
                bases.append([{"label": a, "word": w} for a, w in places])
                found.append([vars(h) for h in hits])
                score.append(max([h.confidence for h in hits] + [0.9] * bool(places), default=0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(bases, pa.list_(base)), pa.array(found, pa.list_(detection)), pa.array(score, pa.float64())],
                names=[batch.schema.names[0], "n_words", "base", "detections", "score"],
            )

    kind = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_words long, base array<struct<label:string,word:long>>, detections array<struct<start:long,end:long,label:string,priority:int,confidence:double>>, score double"
    return docs.select(id_column, "text").mapInArrow(scan, kind)
