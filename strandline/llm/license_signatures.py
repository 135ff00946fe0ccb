"""Hand-written signatures of license texts and notices, over words joined by single spaces.

Each group states the priority (1 is best) and weight of its signatures; a
signature is (label, keyword, pattern), and the keyword stands in the pattern as
it is, outside any choice, so that it stands in all that the pattern accepts.
"""

#: priority, weight, signatures
SIGNATURES = (
    # Tags and fields that name a license to machines.
    (1, 1.0, (
        ("gpl-2.0", "spdx", r"spdx licen[sc]e identifier gpl 2 0(?: only| or later)?(?: with classpath exception 2 0)?"),
        ("gpl-3.0", "spdx", r"spdx licen[sc]e identifier gpl 3 0(?: only| or later)?"),
        ("gpl-1.0", "spdx", r"spdx licen[sc]e identifier gpl 1 0(?: only| or later)?"),
        ("lgpl-2.0", "spdx", r"spdx licen[sc]e identifier lgpl 2 0(?: only| or later)?"),
        ("lgpl-2.1", "spdx", r"spdx licen[sc]e identifier lgpl 2 1(?: only| or later)?"),
        ("lgpl-3.0", "spdx", r"spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?"),
        ("agpl-3.0", "spdx", r"spdx licen[sc]e identifier agpl 3 0(?: only| or later)?"),
        ("gfdl", "spdx", r"spdx licen[sc]e identifier gfdl 1 [1-3](?: only| or later)?"),
        ("apache-2.0", "spdx", r"spdx licen[sc]e identifier apache 2 0(?: with llvm exception)?"),
        ("apache-1.1", "spdx", r"spdx licen[sc]e identifier apache 1 1"),
        ("apache-1.0", "spdx", r"spdx licen[sc]e identifier apache 1 0"),
        ("mit-0", "spdx", r"spdx licen[sc]e identifier mit 0"),
        ("mit", "spdx", r"spdx licen[sc]e identifier mit"),
        ("isc", "spdx", r"spdx licen[sc]e identifier isc"),
        ("x11", "spdx", r"spdx licen[sc]e identifier x11"),
        ("bsd-2-clause", "spdx", r"spdx licen[sc]e identifier bsd 2 clause(?: patent| views)?"),
        ("bsd-3-clause", "spdx", r"spdx licen[sc]e identifier bsd 3 clause(?: clear| lbnl)?"),
        ("bsd-4-clause", "spdx", r"spdx licen[sc]e identifier bsd 4 clause(?: uc)?"),
        ("0bsd", "spdx", r"spdx licen[sc]e identifier 0bsd"),
        ("mpl-1.1", "spdx", r"spdx licen[sc]e identifier mpl 1 1"),
        ("mpl-2.0", "spdx", r"spdx licen[sc]e identifier mpl 2 0(?: no copyleft exception)?"),
        ("epl-1.0", "spdx", r"spdx licen[sc]e identifier epl 1 0"),
        ("epl-2.0", "spdx", r"spdx licen[sc]e identifier epl 2 0"),
        ("cddl-1.0", "spdx", r"spdx licen[sc]e identifier cddl 1 [01]"),
        ("cpl-1.0", "spdx", r"spdx licen[sc]e identifier cpl 1 0"),
        ("eupl", "spdx", r"spdx licen[sc]e identifier eupl 1 [0-2]"),
        ("artistic-1.0", "spdx", r"spdx licen[sc]e identifier artistic 1 0(?: perl| cl8)?"),
        ("artistic-2.0", "spdx", r"spdx licen[sc]e identifier artistic 2 0"),
        ("bsl-1.0", "spdx", r"spdx licen[sc]e identifier bsl 1 0"),
        ("busl-1.1", "spdx", r"spdx licen[sc]e identifier busl 1 1"),
        ("sspl-1.0", "spdx", r"spdx licen[sc]e identifier sspl 1 0"),
        ("elastic-2.0", "spdx", r"spdx licen[sc]e identifier elastic 2 0"),
        ("zlib", "spdx", r"spdx licen[sc]e identifier zlib(?: acknowledgement)?"),
        ("libpng", "spdx", r"spdx licen[sc]e identifier libpng(?: 2 0)?"),
        ("openssl", "spdx", r"spdx licen[sc]e identifier openssl"),
        ("psf-2.0", "spdx", r"spdx licen[sc]e identifier (?:psf|python) 2 0(?: 1)?"),
        ("php-3.0", "spdx", r"spdx licen[sc]e identifier php 3 01?"),
        ("ruby", "spdx", r"spdx licen[sc]e identifier ruby"),
        ("unlicense", "spdx", r"spdx licen[sc]e identifier unlicense"),
        ("wtfpl", "spdx", r"spdx licen[sc]e identifier wtfpl"),
        ("ms-pl", "spdx", r"spdx licen[sc]e identifier ms pl"),
        ("ms-rl", "spdx", r"spdx licen[sc]e identifier ms rl"),
        ("ofl-1.1", "spdx", r"spdx licen[sc]e identifier ofl 1 [01](?: rfn| no rfn)?"),
        ("odbl-1.0", "spdx", r"spdx licen[sc]e identifier odbl 1 0"),
        ("odc-by-1.0", "spdx", r"spdx licen[sc]e identifier odc by 1 0"),
        ("pddl-1.0", "spdx", r"spdx licen[sc]e identifier pddl 1 0"),
        ("cc0-1.0", "spdx", r"spdx licen[sc]e identifier cc0 1 0"),
        ("cc-by", "spdx", r"spdx licen[sc]e identifier cc by [1-4] [05]"),
        ("cc-by-sa", "spdx", r"spdx licen[sc]e identifier cc by sa [1-4] [05]"),
        ("cc-by-nd", "spdx", r"spdx licen[sc]e identifier cc by nd [1-4] [05]"),
        ("cc-by-nc", "spdx", r"spdx licen[sc]e identifier cc by nc [1-4] [05]"),
        ("cc-by-nc-sa", "spdx", r"spdx licen[sc]e identifier cc by nc sa [1-4] [05]"),
        ("cc-by-nc-nd", "spdx", r"spdx licen[sc]e identifier cc by nc nd [1-4] [05]"),
        ("ncsa", "spdx", r"spdx licen[sc]e identifier ncsa"),
        ("postgresql", "spdx", r"spdx licen[sc]e identifier postgresql"),
        ("upl-1.0", "spdx", r"spdx licen[sc]e identifier upl 1 0"),
        ("json", "spdx", r"spdx licen[sc]e identifier json"),
        ("beerware", "spdx", r"spdx licen[sc]e identifier beerware"),
        ("osl-3.0", "spdx", r"spdx licen[sc]e identifier osl 3 0"),
        ("afl-3.0", "spdx", r"spdx licen[sc]e identifier afl 3 0"),
        ("ecl-2.0", "spdx", r"spdx licen[sc]e identifier ecl 2 0"),
        ("w3c", "spdx", r"spdx licen[sc]e identifier w3c(?: 20150513)?"),
        ("bsd", "osi approved", r"licen[sc]e osi approved bsd licen[sc]e"),
        ("mit", "osi approved", r"licen[sc]e osi approved mit licen[sc]e"),
        ("apache", "osi approved", r"licen[sc]e osi approved apache software licen[sc]e"),
        ("gpl", "osi approved", r"licen[sc]e osi approved gnu general public licen[sc]e(?: v[23])?(?: or later)?"),
        ("lgpl", "osi approved", r"licen[sc]e osi approved gnu (?:lesser|library) general public licen[sc]e(?: v[23])?(?: or later)?"),
        ("mpl-2.0", "osi approved", r"licen[sc]e osi approved mozilla public licen[sc]e 2 0"),
        ("psf-2.0", "osi approved", r"licen[sc]e osi approved python software foundation licen[sc]e"),
        ("public-domain", "public domain", r"licen[sc]e public domain"),
        ("proprietary", "other proprietary", r"licen[sc]e other proprietary licen[sc]e"),
    )),
    # Addresses of license texts.
    (2, 0.95, (
        ("apache-2.0", "apache org licenses", r"apache org licenses license 2 0(?: txt| html)?"),
        ("gpl", "gnu org licenses", r"gnu org licenses gpl(?: [123] 0)?(?: html| txt| en html)?"),
        ("lgpl", "gnu org licenses", r"gnu org licenses lgpl(?: [23] [01])?(?: html| txt| en html)?"),
        ("agpl-3.0", "gnu org licenses", r"gnu org licenses agpl(?: 3 0)?(?: html| txt| en html)?"),
        ("gfdl", "gnu org licenses", r"gnu org licenses fdl(?: 1 [1-3])?(?: html| txt)?"),
        ("gpl", "gnu org copyleft", r"gnu org copyleft gpl html"),
        ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0"),
        ("mpl", "mozilla org mpl", r"mozilla org mpl"),
        ("epl-1.0", "eclipse org legal", r"eclipse org legal epl v10(?: html)?"),
        ("epl-2.0", "eclipse org legal", r"eclipse org legal epl (?:2 0|v20)(?: html)?"),
        ("mit", "opensource org licenses", r"opensource org licenses mit(?: license)?(?: php)?"),
        ("bsd-2-clause", "opensource org licenses", r"opensource org licenses bsd 2 clause"),
        ("bsd-3-clause", "opensource org licenses", r"opensource org licenses bsd 3 clause"),
        ("apache-2.0", "opensource org licenses", r"opensource org licenses apache 2 0"),
        ("isc", "opensource org licenses", r"opensource org licenses isc"),
        ("artistic-2.0", "opensource org licenses", r"opensource org licenses artistic(?: license)? 2 0"),
        ("bsl-1.0", "boost org license", r"boost org license 1 0 txt"),
        ("unlicense", "unlicense org", r"unlicense org"),
        ("wtfpl", "wtfpl net", r"wtfpl net"),
        ("ofl-1.1", "scripts sil org", r"scripts sil org ofl"),
        ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
        ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
        ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [05]"),
        ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [05]"),
        ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1-4] [05]"),
        ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1-4] [05]"),
        ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1-4] [05]"),
        ("cc-by", "creativecommons org", r"creativecommons org licenses by [1-4] [05]"),
        ("odbl-1.0", "opendatacommons org", r"opendatacommons org licenses odbl(?: 1 0)?"),
        ("odc-by-1.0", "opendatacommons org", r"opendatacommons org licenses by(?: 1 0)?"),
        ("pddl-1.0", "opendatacommons org", r"opendatacommons org licenses pddl(?: 1 0)?"),
    )),
    # Sentences of license texts and of the notices that licenses ask for.
    (3, 0.9, (
        ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("mit", "included in all copies or substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("mit", "copies of the software and to permit persons", r"to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
        ("x11", "used in advertising or otherwise to promote the sale", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
        ("mit", "or other dealings in the software", r"arising from out of or in connection with the software or the use or other dealings in the software"),
        ("isc", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
        ("isc", "disclaims all warranties with regard to this software", r"the author disclaims all warranties with regard to this software"),
        ("hpnd", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
        ("postgresql", "without a written agreement is hereby granted", r"for any purpose without fee and without a written agreement is hereby granted"),
        ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
        ("bsd-3-clause", "used to endorse or promote products derived from this software", r"neither the names? of .{1,120} nor the names of (?:its|any|their) contributors may be used to endorse or promote products derived from this software"),
        ("bsd-4-clause", "all advertising materials mentioning features", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
        ("bsd", "copyright holders and contributors as is", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
        ("bsd-2-clause-freebsd", "freebsd project", r"official policies either expressed or implied of the freebsd project"),
        ("bsd-3-clause-clear", "no express or implied licenses to any party", r"no express or implied licenses to any party s patent rights are granted by this licen[sc]e"),
        ("0bsd", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
        ("apache-2.0", "licensed under the apache license version 2", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
        ("apache-2.0", "you may obtain a copy of the license at", r"you may obtain a copy of the license at(?: https?)?(?: www)? apache org licenses license 2 0"),
        ("apache", "distributed under the license is distributed on an as is basis", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
        ("apache-2.0", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
        ("apache-2.0", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
        ("apache-1.1", "includes software developed by the apache software foundation", r"this product includes software developed by the apache software foundation"),
        ("apache-1.1", "products derived from this software may not be called apache", r"products derived from this software may not be called apache"),
        ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public", r"(?:this (?:program|library|file|package) is )?free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
        ("gpl-2.0", "either version 2 of the license", r"either version 2 of the license or at your option any later version"),
        ("gpl-3.0", "either version 3 of the license", r"either version 3 of the license or at your option any later version"),
        ("gpl-2.0", "under the terms of the gnu general public license version 2", r"under the terms of the gnu general public license version 2(?: as published by the free software foundation| only)?"),
        ("gpl-3.0", "under the terms of the gnu general public license version 3", r"under the terms of the gnu general public license version 3(?: as published by the free software foundation| only)?"),
        ("gpl", "distributed in the hope that it will be useful", r"(?:program|file|package|software) is distributed in the hope that it will be useful but without any warranty"),
        ("gpl", "you should have received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with this"),
        ("gpl-2.0", "51 franklin", r"free software foundation inc 51 franklin (?:street|st)"),
        ("gpl-2.0", "59 temple place", r"free software foundation inc 59 temple place"),
        ("gpl-1.0", "675 mass", r"free software foundation inc 675 mass ave"),
        ("gpl-3.0", "is a free copyleft license for software", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
        ("gpl-2.0", "designed to take away your freedom to share", r"the licenses for most software are designed to take away your freedom to share and change it"),
        ("gpl-2.0", "everyone is permitted to copy and distribute verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
        ("gpl-2.0-classpath", "linking this library statically or dynamically", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
        ("gpl-2.0-classpath", "permission to link this library with independent modules", r"give you permission to link this library with independent modules to produce an executable"),
        ("gpl-gcc-exception", "gcc runtime library exception", r"under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
        ("gpl-autoconf-exception", "configuration script generated by autoconf", r"a configuration script generated by autoconf you may include it under the same distribution terms"),
        ("gpl-bison-exception", "part or all of the bison parser skeleton", r"you may create a larger work that contains part or all of the bison parser skeleton"),
        ("gpl-font-exception", "embed this font or unaltered portions of this font", r"as a special exception if you create a document which uses this font and embed this font or unaltered portions of this font"),
        ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public", r"(?:free software )?you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
        ("lgpl", "you can redistribute it and or modify it under the terms of the gnu library general public", r"(?:free software )?you can redistribute it and or modify it under the terms of the gnu library general public licen[sc]e"),
        ("lgpl-2.1", "either version 2 1 of the license", r"either version 2 1 of the license or at your option any later version"),
        ("lgpl", "you should have received a copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license"),
        ("lgpl", "you should have received a copy of the gnu library general public license", r"you should have received a copy of the gnu library general public license"),
        ("lgpl-3.0", "incorporates the terms and conditions of version 3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
        ("agpl-3.0", "under the terms of the gnu affero general public", r"under the terms of the gnu affero general public licen[sc]e"),
        ("agpl-3.0", "you should have received a copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license"),
        ("agpl-3.0", "interacting with it remotely through a computer network", r"all users interacting with it remotely through a computer network"),
        ("gfdl", "modify this document under the terms of the gnu free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
        ("gfdl", "no front cover texts", r"with no invariant sections no front cover texts and no back cover texts"),
        ("mpl-2.0", "source code form is subject to the terms of the mozilla public", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0"),
        ("mpl-2.0", "if a copy of the mpl was not distributed with this file", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
        ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1"),
        ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0", r"the contents of this file are subject to the mozilla public license version 1 0"),
        ("mpl-2.0", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses"),
        ("mpl-1.1", "alternatively the contents of this file may be used under the terms of", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
        ("npl-1.1", "netscape public license", r"subject to the netscape public license(?: version)? 1 [01]"),
        ("epl-1.0", "eclipse public license v1 0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
        ("epl-2.0", "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
        ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license"),
        ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", r"the accompanying program is provided under the terms of this common public license"),
        ("ipl-1.0", "ibm public license", r"provided under the terms of this ibm public license"),
        ("cddl-1.0", "subject to the terms of the common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license"),
        ("cddl-1.0", "when distributing covered code include this cddl header", r"when distributing covered code include this cddl header notice in each file"),
        ("eupl", "licensed under the eupl", r"licensed under the eupl(?: version)? 1 [0-2](?: or as soon they will be approved by the european commission subsequent versions)?"),
        ("artistic-1.0", "some semblance of artistic control", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
        ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms"),
        ("perl", "same terms as perl itself", r"(?:redistribute|distributed|modify|used) (?:it )?(?:and or modify it )?under the same terms as perl itself"),
        ("bsl-1.0", "distributed under the boost software license", r"distributed under the boost software license version 1 0"),
        ("bsl-1.0", "machine executable object code generated by a source language processor", r"in the form of machine executable object code generated by a source language processor"),
        ("zlib", "without any express or implied warranty in no event will the authors be held liable", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
        ("zlib", "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such"),
        ("libpng", "png reference library", r"the png reference library is supplied as is"),
        ("unlicense", "free and unencumbered software released into the public domain", r"this is free and unencumbered software released into the public domain"),
        ("unlicense", "relinquishment in perpetuity", r"an overt act of relinquishment in perpetuity of all present and future rights"),
        ("wtfpl", "do what the fuck you want to", r"do what the fuck you want to(?: public licen[sc]e)?"),
        ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
        ("json", "the software shall be used for good not evil", r"the software shall be used for good not evil"),
        ("ncsa", "university of illinois", r"university of illinois ncsa open source licen[sc]e"),
        ("ncsa", "deal with the software without restriction", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish"),
        ("openssl", "includes software developed by the openssl project", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
        ("openssl", "includes cryptographic software written by eric young", r"this product includes cryptographic software written by eric young"),
        ("php-3.0", "this product includes php software", r"this product includes php software freely available from"),
        ("psf-2.0", "psf is making python", r"psf is making python available to licensee on an as is basis"),
        ("psf-2.0", "nonexclusive royalty free world wide license", r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test"),
        ("zpl-2.1", "zope public license", r"subject to the provisions of the zope public license(?: version)? 2 [01]"),
        ("w3c", "w3c software notice", r"w3c software notice and licen[sc]e"),
        ("icu", "unicode data files", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
        ("curl", "name of a copyright holder shall not be used in advertising", r"except as contained in this notice the name of a copyright holder shall not be used in advertising"),
        ("freetype", "freetype project", r"portions of this software are copyright .{1,40}the freetype project"),
        ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
        ("tcl", "the authors hereby grant permission to use copy modify", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
        ("vim", "vim is charityware", r"vim is charityware"),
        ("ofl-1.1", "sil open font license", r"this font software is licensed under the sil open font license version 1 1"),
        ("ofl-1.1", "reserved font name", r"with reserved font names?"),
        ("ms-pl", "if you use the software you accept this license", r"this license governs use of the accompanying software if you use the software you accept this license"),
        ("ms-limited-public", "runs on a microsoft windows operating system", r"only if your software runs on a microsoft windows operating system"),
        ("upl-1.0", "universal permissive license", r"universal permissive license(?: upl)?(?: version)? 1 0"),
        ("osl-3.0", "open software license version 3 0", r"licensed under the open software license version 3 0"),
        ("afl-3.0", "academic free license version 3 0", r"licensed under the academic free license version 3 0"),
        ("ecl-2.0", "educational community license", r"licensed under the educational community license version 2 0"),
        ("cpal-1.0", "common public attribution license", r"common public attribution license(?: version)? 1 0"),
        ("apsl-2.0", "apple public source license", r"apple public source license(?: version)? 2 0"),
        ("sspl-1.0", "server side public license", r"under the terms of the server side public license(?: version 1)?"),
        ("sspl-1.0", "making the functionality of the program", r"making the functionality of the program or modified version available to third parties as a service"),
        ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
        ("busl-1.1", "effective on the change date", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
        ("busl-1.1", "non production use of the licensed work", r"make non production use of the licensed work"),
        ("commons-clause", "commons clause", r"commons clause licen[sc]e condition v1 0"),
        ("commons-clause", "provided to you by the licensor under the license", r"the software is provided to you by the licensor under the license as defined below subject to the following condition"),
        ("polyform", "polyform", r"polyform (?:noncommercial|small business|perimeter|shield|strict|internal use) licen[sc]e(?: 1 0 0)?"),
        ("openrail", "openrail", r"(?:creativeml|bigscience|bigcode|responsible ai)(?: licen[sc]e)? openrail(?: m| ml)?(?: licen[sc]e)?"),
        ("llama-community", "community license", r"llama [234](?: [1-3])? community license(?: agreement)?"),
        ("cc0-1.0", "has waived all copyright and related or", r"has waived all copyright and related or neighbou?ring rights to"),
        ("cc0-1.0", "no copyright", r"to the extent possible under law .{1,160} no copyright"),
        ("cc0-1.0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
        ("creative-commons", "creative commons public licen", r"the work as defined below is provided under the terms of this creative commons public licen[sc]e"),
        ("cc-by-sa", "share alike", r"creative commons attribution share alike(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e"),
        ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[sc]e"),
        ("creative-commons", "you are free to share", r"you are free to share copy and redistribute the material in any medium or format"),
        ("cc-by", "you must give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
        ("cc-by-sa", "distribute your contributions under the same license", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
        ("cc-by-nc", "you may not use the material for commercial purposes", r"you may not use the material for commercial purposes"),
        ("cc-by-nd", "you may not distribute the modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
        ("odbl-1.0", "made available under the open database license", r"made available under the open database license"),
        ("odbl-1.0", "database contents license", r"individual contents of the database are licensed under the database contents license"),
        ("openstreetmap", "openstreetmap contributors", r"openstreetmap contributors"),
        ("ogl-uk", "open government licence", r"contains public sector information licensed under the open government licence(?: v[123] 0)?"),
        ("us-government", "united states government work", r"united states government works? (?:and )?(?:is|are) (?:not subject to|in the public domain)"),
        ("public-domain", "public domain", r"(?:released|placed|dedicated|belongs?|put) (?:in|into|to) the public domain"),
        ("public-domain", "public domain", r"this (?:work|file|code|software|program|text|image|article) is in the public domain"),
        ("public-domain", "no known copyright restrictions", r"no known copyright restrictions"),
        ("gutenberg", "project gutenberg", r"under the terms of the project gutenberg licen[sc]e"),
        ("qpl-1.0", "q public license", r"(?:the )?q public license(?: version)? 1 0"),
        ("sleepycat", "sleepycat", r"sleepycat software inc all rights reserved redistribution and use"),
        ("latex-lppl", "latex project public license", r"latex project public license(?: version)? 1 [0-3][abc]?"),
        ("ruby", "ruby is copyrighted free software", r"ruby is copyrighted free software by yukihiro matsumoto"),
        ("erlang", "erlang public license", r"subject to the erlang public license(?: version)? 1 1"),
        ("sun-bcl", "binary code license", r"sun microsystems inc binary code license agreement"),
        ("oracle", "oracle technology network", r"oracle technology network (?:development and distribution )?licen[sc]e"),
        ("nvidia", "nvidia", r"nvidia corporation and its licensors retain all intellectual property and proprietary rights"),
        ("amazon", "amazon software license", r"licensed under the amazon software license"),
        ("cecill", "cecill", r"(?:governed by|under) the cecill(?: [abc])? licen[sc]e"),
        ("mulan-2.0", "mulan psl", r"licensed under (?:the )?mulan psl v2"),
        ("hippocratic", "hippocratic", r"hippocratic licen[sc]e"),
        ("anti-996", "anti 996", r"anti 996 licen[sc]e"),
    )),
    # Notices that reserve rights.
    (6, 0.6, (
        ("proprietary", "rights reserved", r"(?:all|some) rights reserved"),
        ("proprietary", "proprietary and confidential", r"(?:this (?:document|file|software) is )?proprietary and confidential"),
        ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?"),
        ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document)(?: via any medium)?(?: is strictly prohibited)?"),
        ("proprietary", "may not be reproduced", r"may not be reproduced (?:in whole or in part |in any form )?without (?:the )?(?:prior |express )?(?:written )?permission"),
        ("proprietary", "no part of this", r"no part of this (?:publication|book|document|work) may be (?:reproduced|copied|distributed|stored)"),
        ("proprietary", "end user license agreement", r"(?:this )?end user license agreement"),
        ("proprietary", "licensed not sold", r"(?:the )?software is licensed not sold"),
        ("proprietary", "reverse engineer", r"(?:you may not |not to )reverse engineer decompile or disassemble"),
        ("proprietary", "for evaluation purposes only", r"for evaluation purposes only"),
        ("non-commercial", "non commercial use only", r"for non commercial use only"),
        ("non-commercial", "personal use only", r"for personal use only"),
        ("academic", "academic use only", r"for academic use only"),
        ("academic", "research purposes only", r"for (?:academic |scientific )?research purposes only"),
    )),
    # Weak signs.
    (8, 0.3, (
        ("copyright", "copyright", r"copyright (?:c )?(?:1[89]|20)[0-9]{2}"),
        ("licensed", "licensed under", r"licensed under"),
        ("licensed", "licenced under", r"licenced under"),
        ("licensed", "released under", r"released under"),
        ("licensed", "see the license", r"see the license(?: file)?(?: for details)?"),
        ("licensed", "subject to the terms of", r"subject to the terms of (?:the|this) licen[sc]e"),
        ("permitted", "with permission", r"(?:reprinted|printed|used|reproduced) with permission"),
    )),
)
