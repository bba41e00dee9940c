"""Hand-written license signatures: (label, regex) by kind.

In name forms and texts a blank stands for any run of non-word bytes and `` ?`` for at
most two of them; texts are matched in lower case.
"""

from __future__ import annotations

#: Names by which a license is called.
NAMES: list[tuple[str, str]] = [
    # GNU
    ("gpl-1.0", r"gnu general public license (?:version |v ?)?1(?:\.0)?"),
    ("gpl-1.0", r"gpl (?:version |ver )?v?1(?:\.0)?"),
    ("gpl-2.0", r"gnu general public license (?:version |v ?)?2(?:\.0)?"),
    ("gpl-2.0", r"gpl ?(?:version |ver |v)? ?2(?:\.0)?"),
    ("gpl-2.0", r"version 2 of the (?:gnu )?(?:general public license|gpl)"),
    ("gpl-3.0", r"gnu general public license (?:version |v ?)?3(?:\.0)?"),
    ("gpl-3.0", r"gpl ?(?:version |ver |v)? ?3(?:\.0)?"),
    ("gpl-3.0", r"version 3 of the (?:gnu )?(?:general public license|gpl)"),
    ("lgpl-2.0", r"gnu library general public license(?: (?:version |v ?)?2(?:\.0)?)?"),
    ("lgpl-2.0", r"lgpl ?(?:version |ver |v)? ?2(?:\.0)?"),
    ("lgpl-2.1", r"gnu lesser general public license (?:version |v ?)?2\.1"),
    ("lgpl-2.1", r"lgpl ?(?:version |ver |v)? ?2\.1"),
    ("lgpl-2.1", r"version 2\.1 of the (?:gnu )?(?:lesser general public license|lgpl)"),
    ("lgpl-3.0", r"gnu lesser general public license (?:version |v ?)?3(?:\.0)?"),
    ("lgpl-3.0", r"lgpl ?(?:version |ver |v)? ?3(?:\.0)?"),
    ("agpl-1.0", r"affero general public license (?:version |v ?)?1(?:\.0)?"),
    ("agpl-3.0", r"gnu affero general public license(?: (?:version |v ?)?3(?:\.0)?)?"),
    ("agpl-3.0", r"agpl ?(?:version |ver |v)? ?3(?:\.0)?"),
    ("gfdl-1.1", r"gnu free documentation license (?:version |v ?)?1\.1"),
    ("gfdl-1.2", r"gnu free documentation license (?:version |v ?)?1\.2"),
    ("gfdl-1.3", r"gnu free documentation license(?: (?:version |v ?)?1\.3)?"),
    ("gfdl-1.3", r"gfdl ?v?1\.3"),
    ("classpath-exception-2.0", r"gnu classpath exception"),
    # permissive
    ("apache-1.0", r"apache (?:software )?license (?:version |v ?)?1\.0"),
    ("apache-1.1", r"apache (?:software )?license (?:version |v ?)?1\.1"),
    ("apache-2.0", r"apache (?:software )?license (?:version |v ?)?2(?:\.0)?"),
    ("apache-2.0", r"apache (?:v ?)?2(?:\.0)? license"),
    ("apache-2.0", r"asl ?v?2(?:\.0)?"),
    ("mit", r"(?:the )?mit license"),
    ("mit", r"(?:the )?expat license"),
    ("mit", r"mit style license"),
    ("mit-0", r"mit no attribution(?: license)?"),
    ("mit-modern", r"mit license modern variant"),
    ("x11", r"(?:the )?x11 license"),
    ("x11", r"mit x11 license"),
    ("xfree86-1.1", r"xfree86 license(?: 1\.1)?"),
    ("isc", r"(?:the )?isc license"),
    ("isc", r"internet (?:systems|software) consortium license"),
    ("bsd-1-clause", r"bsd 1 clause(?: license)?"),
    ("bsd-1-clause", r"one clause bsd license"),
    ("bsd-2-clause", r"bsd 2 clause(?: license)?"),
    ("bsd-2-clause", r"2 clause bsd license"),
    ("bsd-2-clause", r"(?:simplified|two clause|freebsd) (?:bsd )?license"),
    ("bsd-3-clause", r"bsd 3 clause(?: license)?"),
    ("bsd-3-clause", r"3 clause bsd license"),
    ("bsd-3-clause", r"(?:new|modified|revised|three clause) bsd license"),
    ("bsd-3-clause-clear", r"(?:clear bsd|bsd 3 clause clear) license"),
    ("bsd-4-clause", r"bsd 4 clause(?: license)?"),
    ("bsd-4-clause", r"(?:original|old|four clause) bsd license"),
    ("bsd-patent", r"bsd (?:2 clause )?plus patent license"),
    ("bsd", r"bsd style license"),
    ("0bsd", r"bsd zero clause license"),
    ("0bsd", r"0bsd"),
    ("zlib", r"(?:the )?zlib license"),
    ("zlib", r"zlib libpng license"),
    ("libpng", r"(?:the )?libpng license(?: (?:version |v ?)?2)?"),
    ("bsl-1.0", r"boost software license(?: (?:version |v ?)?1\.0)?"),
    ("unlicense", r"(?:the )?unlicense"),
    ("wtfpl", r"do what the fuck you want to public license"),
    ("wtfpl", r"wtfpl"),
    ("beerware", r"(?:the )?beer ?ware license"),
    ("python-2.0", r"python software foundation license(?: (?:version |v ?)?2)?"),
    ("python-2.0", r"psf license(?: agreement)?"),
    ("cnri-python", r"cnri python license"),
    ("php-3.0", r"php license (?:version |v ?)?3(?:\.0)?"),
    ("php-3.01", r"php license (?:version |v ?)?3\.01"),
    ("zend-2.0", r"zend (?:engine )?license(?: (?:version |v ?)?2\.0)?"),
    ("ruby", r"ruby license"),
    ("postgresql", r"postgresql licen[cs]e"),
    ("openssl", r"openssl license"),
    ("ssleay", r"(?:original )?ssleay license"),
    ("curl", r"curl license"),
    ("json", r"json license"),
    ("icu", r"icu license"),
    ("unicode-dfs", r"unicode (?:data files and software )?license(?: agreement)?"),
    ("ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("ntp", r"ntp license"),
    ("hpnd", r"historical permission notice and disclaimer"),
    ("w3c", r"w3c software (?:notice and )?(?:document )?license"),
    ("vim", r"vim license"),
    ("tcl", r"tcl tk license"),
    ("afl-2.1", r"academic free license (?:version |v ?)?2\.1"),
    ("afl-3.0", r"academic free license(?: (?:version |v ?)?3(?:\.0)?)?"),
    ("ecl-2.0", r"educational community license(?: (?:version |v ?)?2\.0)?"),
    ("efl-2.0", r"eiffel forum license(?: (?:version |v ?)?2)?"),
    ("upl-1.0", r"universal permissive license(?: (?:version |v ?)?1\.0)?"),
    ("mulanpsl-2.0", r"mulan permissive software license(?: (?:version |v ?)?2)?"),
    ("blueoak-1.0.0", r"blue oak model license(?: 1\.0\.0)?"),
    ("fair", r"fair license"),
    ("miros", r"miros licen[cs]e"),
    ("zpl-2.0", r"zope public license (?:version |v ?)?2\.0"),
    ("zpl-2.1", r"zope public license(?: (?:version |v ?)?2\.1)?"),
    ("ms-pl", r"microsoft public license"),
    ("ftl", r"freetype (?:project )?license"),
    ("ijg", r"independent jpeg group license"),
    ("imagemagick", r"imagemagick license"),
    # copyleft
    ("mpl-1.0", r"mozilla public license (?:version |v ?)?1\.0"),
    ("mpl-1.0", r"mpl ?v?1\.0"),
    ("mpl-1.1", r"mozilla public license (?:version |v ?)?1\.1"),
    ("mpl-1.1", r"mpl ?v?1\.1"),
    ("mpl-2.0", r"mozilla public license (?:version |v ?)?2(?:\.0)?"),
    ("mpl-2.0", r"mpl ?v?2(?:\.0)?"),
    ("npl-1.1", r"netscape public license(?: (?:version |v ?)?1\.1)?"),
    ("epl-1.0", r"eclipse public license (?:version |v ?)?1(?:\.0)?"),
    ("epl-1.0", r"epl ?v?1\.0"),
    ("epl-2.0", r"eclipse public license (?:version |v ?)?2(?:\.0)?"),
    ("epl-2.0", r"epl ?v?2\.0"),
    ("edl-1.0", r"eclipse distribution license(?: (?:version |v ?)?1\.0)?"),
    ("cddl-1.0", r"common development and distribution license(?: (?:version |v ?)?1\.0)?"),
    ("cddl-1.0", r"cddl ?v?1\.0"),
    ("cddl-1.1", r"common development and distribution license (?:version |v ?)?1\.1"),
    ("cddl-1.1", r"cddl ?v?1\.1"),
    ("cpl-1.0", r"common public license(?: (?:version |v ?)?1\.0)?"),
    ("cpal-1.0", r"common public attribution license(?: (?:version |v ?)?1\.0)?"),
    ("ipl-1.0", r"ibm public license(?: (?:version |v ?)?1\.0)?"),
    ("lpl-1.02", r"lucent public license(?: (?:version |v ?)?1\.02)?"),
    ("spl-1.0", r"sun public license(?: (?:version |v ?)?1\.0)?"),
    ("sissl", r"sun industry standards source license"),
    ("apsl-2.0", r"apple public source license(?: (?:version |v ?)?2\.0)?"),
    ("rpsl-1.0", r"realnetworks public source license"),
    ("nosl", r"nokia open source license"),
    ("nasa-1.3", r"nasa open source agreement(?: (?:version |v ?)?1\.3)?"),
    ("rpl-1.5", r"reciprocal public license(?: (?:version |v ?)?1\.5)?"),
    ("sleepycat", r"sleepycat (?:public )?license"),
    ("watcom-1.0", r"sybase open watcom public license"),
    ("cecill-2.0", r"cecill(?: (?:version |v ?)?2(?:\.0)?)?"),
    ("cecill-2.1", r"cecill (?:version |v ?)?2\.1"),
    ("cecill-2.0", r"cecill free software license agreement"),
    ("cecill-b", r"cecill b(?: license)?"),
    ("cecill-c", r"cecill c(?: license)?"),
    ("eupl-1.1", r"european union public licen[cs]e (?:version |v ?)?1\.1"),
    ("eupl-1.1", r"eupl ?v?1\.1"),
    ("eupl-1.2", r"european union public licen[cs]e(?: (?:version |v ?)?1\.2)?"),
    ("eupl-1.2", r"eupl ?v?1\.2"),
    ("osl-2.1", r"open software license (?:version |v ?)?2\.1"),
    ("osl-3.0", r"open software license(?: (?:version |v ?)?3(?:\.0)?)?"),
    ("nposl-3.0", r"non profit open software license(?: (?:version |v ?)?3\.0)?"),
    ("artistic-1.0", r"artistic license (?:version |v ?)?1(?:\.0)?"),
    ("artistic-2.0", r"artistic license(?: (?:version |v ?)?2(?:\.0)?)?"),
    ("qpl-1.0", r"q public license(?: (?:version |v ?)?1\.0)?"),
    ("ms-rl", r"microsoft reciprocal license"),
    ("lppl-1.3c", r"latex project public license(?: (?:version |v ?)?1\.3c?)?"),
    ("lppl-1.3c", r"lppl ?v?1\.3c?"),
    ("ofl-1.0", r"sil open font license (?:version |v ?)?1\.0"),
    ("ofl-1.1", r"sil open font license(?: (?:version |v ?)?1\.1)?"),
    ("ofl-1.1", r"ofl ?v?1\.1"),
    ("cern-ohl-1.2", r"cern open hardware licen[cs]e(?: (?:version |v ?)?1\.2)?"),
    ("cern-ohl-s-2.0", r"cern ohl s(?: (?:version |v ?)?2(?:\.0)?)?"),
    ("tapr-ohl-1.0", r"tapr open hardware license"),
    ("shl-0.51", r"solderpad hardware licen[cs]e"),
    # source available
    ("bsl-1.1", r"business source license(?: (?:version |v ?)?1\.1)?"),
    ("sspl-1.0", r"server side public license(?: (?:version |v ?)?1)?"),
    ("elastic-2.0", r"elastic license(?: (?:version |v ?)?2(?:\.0)?)?"),
    ("commons-clause", r"commons clause(?: license condition)?"),
    ("confluent-community-1.0", r"confluent community license(?: agreement)?"),
    ("polyform-noncommercial-1.0.0", r"polyform noncommercial license"),
    ("polyform-shield-1.0.0", r"polyform shield license"),
    ("parity-7.0.0", r"parity public license"),
    ("prosperity-3.0.0", r"prosperity public license"),
    ("hippocratic-2.1", r"hippocratic license"),
    ("bigscience-openrail-m", r"big ?science (?:open ?)?rail(?: m)? license"),
    ("creativeml-openrail-m", r"creativeml open ?rail m"),
    ("llama2", r"llama 2 community license(?: agreement)?"),
    ("llama3", r"llama 3(?:\.\d)? community license(?: agreement)?"),
    # data and documents
    ("odbl-1.0", r"open (?:data commons )?(?:open )?database license(?: (?:version |v ?)?1\.0)?"),
    ("odc-by-1.0", r"open data commons attribution license(?: (?:version |v ?)?1\.0)?"),
    ("pddl-1.0", r"public domain dedication and license(?: (?:version |v ?)?1\.0)?"),
    ("cdla-permissive-1.0", r"community data license agreement permissive (?:version )?1\.0"),
    ("cdla-permissive-2.0", r"community data license agreement permissive(?: (?:version )?2\.0)?"),
    ("cdla-sharing-1.0", r"community data license agreement sharing"),
    ("ogl-uk-2.0", r"open government licen[cs]e (?:version |v ?)?2\.0"),
    ("ogl-uk-3.0", r"open government licen[cs]e(?: (?:version |v ?)?3\.0)?"),
    ("etalab-2.0", r"etalab open licen[cs]e"),
    ("dl-de-by-2.0", r"data licen[cs]e germany attribution(?: version 2\.0)?"),
    ("opl-1.0", r"open publication license(?: v ?1\.0)?"),
    ("lal-1.3", r"licence art libre(?: 1\.3)?"),
    ("lal-1.3", r"free art license(?: 1\.3)?"),
    ("dsl", r"design science license"),
    ("cc0-1.0", r"cc0(?: 1\.0)?(?: universal)?"),
    ("cc0-1.0", r"creative commons zero(?: (?:version |v ?)?1\.0)?"),
    ("cc-by-1.0", r"creative commons attribution 1\.0"),
    ("cc-by-2.0", r"cc by 2\.0"),
    ("cc-by-2.0", r"creative commons attribution 2\.0(?: generic)?"),
    ("cc-by-2.5", r"cc by 2\.5"),
    ("cc-by-2.5", r"creative commons attribution 2\.5"),
    ("cc-by-3.0", r"cc by 3\.0"),
    ("cc-by-3.0", r"creative commons attribution 3\.0(?: unported)?"),
    ("cc-by-4.0", r"cc by 4\.0"),
    ("cc-by-4.0", r"creative commons attribution 4\.0(?: international)?"),
    ("cc-by-sa-2.0", r"cc by sa 2\.0"),
    ("cc-by-sa-2.0", r"creative commons attribution share ?alike 2\.0"),
    ("cc-by-sa-2.5", r"cc by sa 2\.5"),
    ("cc-by-sa-3.0", r"cc by sa 3\.0"),
    ("cc-by-sa-3.0", r"creative commons attribution share ?alike 3\.0(?: unported)?"),
    ("cc-by-sa-4.0", r"cc by sa 4\.0"),
    ("cc-by-sa-4.0", r"creative commons attribution share ?alike 4\.0(?: international)?"),
    ("cc-by-nc-2.0", r"cc by nc 2\.0"),
    ("cc-by-nc-3.0", r"cc by nc 3\.0"),
    ("cc-by-nc-3.0", r"creative commons attribution non ?commercial 3\.0"),
    ("cc-by-nc-4.0", r"cc by nc 4\.0"),
    ("cc-by-nc-4.0", r"creative commons attribution non ?commercial 4\.0(?: international)?"),
    ("cc-by-nd-3.0", r"cc by nd 3\.0"),
    ("cc-by-nd-3.0", r"creative commons attribution no ?deriv(?:ative)?s 3\.0"),
    ("cc-by-nd-4.0", r"cc by nd 4\.0"),
    ("cc-by-nd-4.0", r"creative commons attribution no ?deriv(?:ative)?s 4\.0(?: international)?"),
    ("cc-by-nc-sa-3.0", r"cc by nc sa 3\.0"),
    ("cc-by-nc-sa-3.0", r"creative commons attribution non ?commercial share ?alike 3\.0"),
    ("cc-by-nc-sa-4.0", r"cc by nc sa 4\.0"),
    ("cc-by-nc-sa-4.0", r"creative commons attribution non ?commercial share ?alike 4\.0(?: international)?"),
    ("cc-by-nc-nd-3.0", r"cc by nc nd 3\.0"),
    ("cc-by-nc-nd-4.0", r"cc by nc nd 4\.0"),
    ("cc-by-nc-nd-4.0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 4\.0(?: international)?"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", r"this (?:work|file|code|program) is in the public domain"),
    ("proprietary", r"all rights reserved"),
    ("proprietary", r"no part of this (?:publication|work|book) may be reproduced"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution) of this file"),
]

#: Sentences of license texts and notices.
TEXTS: list[tuple[str, str]] = [
    # GNU notices; the suffix tells which versions are meant
    ("gpl-2.0-or-later", r"(?:gnu )?general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", r"(?:gnu )?general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", r"(?:gnu )?general public license (?:version 2 )?as published by the free software foundation version 2 only"),
    ("gpl-2.0-only", r"general public license version 2 only as published by the free software foundation"),
    ("gpl-2.0-only", r"under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0-only", r"under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("lgpl-2.0-or-later", r"gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", r"gnu lesser general public license as published by the free software foundation either version 2\.1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-2.1", r"gnu lesser general public license version 2\.1 february 1999"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl-1.3", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1\.3"),
    ("gfdl-1.2", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1\.2"),
    ("classpath-exception-2.0", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception-3.1", r"additional permissions described in the gcc runtime library exception"),
    # permissive
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", r"permission is hereby granted free of charge .{1,400}? to do so the software is provided as is"),
    ("x11", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", r"with or without fee is hereby granted the software is provided as is"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", r"the name .{1,60}? not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("bsd-1-clause", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software"),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of (?:its|the|their) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", r"the names? of (?:the )?(?:author|copyright holder|contributors?)s? may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"use of this source code is governed by a bsd style license that can be found in the license file"),
    ("mit", r"use of this source code is governed by an mit style license that can be found in the license file"),
    ("apache-2.0", r"licensed under the apache license version 2\.0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", r"the png reference library is supplied as is"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("json", r"the software shall be used for good not evil"),
    ("python-2.0", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("cnri-python", r"this license agreement is between the corporation for national research initiatives"),
    ("php-3.01", r"products derived from this software may not be called php nor may php appear in their name"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages including lost profits"),
    ("curl", r"except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale"),
    ("icu", r"copyright c \d{4}(?: \d{4})? international business machines corporation and others"),
    ("unicode-dfs", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use"),
    ("w3c", r"this work and any related materials are being provided by the copyright holders under the following license"),
    ("afl-3.0", r"licensed under the academic free license version 3\.0"),
    ("upl-1.0", r"the universal permissive license upl"),
    ("blueoak-1.0.0", r"each contributor licenses you to do everything with this software that would otherwise infringe"),
    ("mulanpsl-2.0", r"you can use this software according to the terms and conditions of the mulan psl v2"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ftl", r"portions of this software are copyright .{1,30}? the freetype project"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    # copyleft
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2\.0"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license"),
    ("epl-1.0", r"made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", r"made available under the terms of the eclipse public license (?:v ?)?2\.0"),
    ("edl-1.0", r"made available under the terms of the eclipse distribution license v ?1\.0"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("sissl", r"the contents of this file are subject to the sun (?:industry )?standards license"),
    ("apsl-2.0", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("eupl-1.2", r"licensed under the eupl(?: version 1\.2)? or as soon they will be approved by the european commission"),
    ("osl-3.0", r"licensed under the open software license version 3\.0"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("qpl-1.0", r"you may copy this license but not change it this license applies to any software containing a notice placed by the copyright holder"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("lppl-1.3c", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1\.1"),
    ("ofl-1.1", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("cern-ohl-s-2.0", r"you may redistribute and modify this source and make products using it under the terms of the cern ohl s v2"),
    # source available
    ("bsl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"the license does not grant to you the right to sell the software"),
    ("llama2", r"llama 2 is licensed under the llama 2 community license"),
    ("creativeml-openrail-m", r"you agree not to use the model or derivatives of the model"),
    # data and documents
    ("cc0-1.0", r"to the extent possible under law .{1,120}? waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", r"this (?:work|article|dataset|content|site) is licensed under a creative commons attribution 4\.0 international license"),
    ("cc-by-sa-3.0", r"text is available under the creative commons attribution share ?alike license"),
    ("cc-by-sa-4.0", r"this (?:work|article|dataset|content|site) is licensed under a creative commons attribution share ?alike 4\.0 international license"),
    ("cc-by-nc-4.0", r"this (?:work|article|dataset|content|site) is licensed under a creative commons attribution non ?commercial 4\.0 international license"),
    ("cc-by-4.0", r"open access article distributed under the terms of the creative commons attribution license"),
    ("odbl-1.0", r"made available under the open database license"),
    ("ogl-uk-3.0", r"contains public sector information licensed under the open government licence v3\.0"),
    ("public-domain", r"the author disclaims copyright to this source code"),
    ("public-domain", r"this (?:file|work) is (?:hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", r"this is a work of the u ?s ?government and is not subject to copyright protection"),
    ("proprietary", r"this software is the confidential and proprietary information of"),
    ("proprietary", r"you may not (?:copy|modify|distribute|reverse engineer) .{1,60}? without (?:the )?(?:express |prior )?written (?:permission|consent)"),
]

#: Addresses of license texts; blanks have no meaning here.
ADDRESSES: list[tuple[str, str]] = [
    ("apache-2.0", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0"),
    ("apache-1.1", r"https?://(?:www\.)?apache\.org/licenses/license-1\.1"),
    ("gpl-3.0", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-3\.0"),
    ("gpl-2.0", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("lgpl-3.0", r"https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("agpl-3.0", r"https?://(?:www\.)?gnu\.org/licenses/agpl"),
    ("gfdl-1.3", r"https?://(?:www\.)?gnu\.org/licenses/fdl"),
    ("mit", r"https?://(?:www\.)?opensource\.org/licenses?/mit"),
    ("bsd-2-clause", r"https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", r"https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause"),
    ("isc", r"https?://(?:www\.)?opensource\.org/licenses?/isc"),
    ("apache-2.0", r"https?://(?:www\.)?opensource\.org/licenses?/apache-2\.0"),
    ("mpl-2.0", r"https?://(?:www\.)?opensource\.org/licenses?/mpl-2\.0"),
    ("mpl-2.0", r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", r"https?://(?:www\.)?mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("epl-1.0", r"https?://(?:www\.)?eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"https?://(?:www\.)?eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("bsl-1.0", r"https?://(?:www\.)?boost\.org/license_1_0\.txt"),
    ("ofl-1.1", r"https?://(?:scripts\.sil\.org/ofl|openfontlicense\.org)"),
    ("unlicense", r"https?://(?:www\.)?unlicense\.org"),
    ("wtfpl", r"https?://(?:www\.)?wtfpl\.net"),
    ("php-3.01", r"https?://(?:www\.)?php\.net/license/3_01"),
    ("zlib", r"https?://(?:www\.)?zlib\.net/zlib_license"),
    ("elastic-2.0", r"https?://(?:www\.)?elastic\.co/licensing/elastic-license"),
    ("cc0-1.0", r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", r"https?://creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by-2.0", r"https?://creativecommons\.org/licenses/by/2\.0"),
    ("cc-by-2.5", r"https?://creativecommons\.org/licenses/by/2\.5"),
    ("cc-by-3.0", r"https?://creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-4.0", r"https?://creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-sa-2.0", r"https?://creativecommons\.org/licenses/by-sa/2\.0"),
    ("cc-by-sa-2.5", r"https?://creativecommons\.org/licenses/by-sa/2\.5"),
    ("cc-by-sa-3.0", r"https?://creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-sa-4.0", r"https?://creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-nc-2.0", r"https?://creativecommons\.org/licenses/by-nc/2\.0"),
    ("cc-by-nc-3.0", r"https?://creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-nc-4.0", r"https?://creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nd-3.0", r"https?://creativecommons\.org/licenses/by-nd/3\.0"),
    ("cc-by-nd-4.0", r"https?://creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nc-sa-3.0", r"https?://creativecommons\.org/licenses/by-nc-sa/3\.0"),
    ("cc-by-nc-sa-4.0", r"https?://creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-nd-3.0", r"https?://creativecommons\.org/licenses/by-nc-nd/3\.0"),
    ("cc-by-nc-nd-4.0", r"https?://creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("odbl-1.0", r"https?://(?:www\.)?opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", r"https?://(?:www\.)?opendatacommons\.org/licenses/by"),
    ("pddl-1.0", r"https?://(?:www\.)?opendatacommons\.org/licenses/pddl"),
    ("ogl-uk-3.0", r"https?://(?:www\.)?nationalarchives\.gov\.uk/doc/open-government-licence/version/3"),
    ("cdla-permissive-2.0", r"https?://cdla\.dev/permissive-2-0"),
]
