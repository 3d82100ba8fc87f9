"""Rules of the license scan written by hand: (label, keyword, regex over words joined by single blanks, priority).

Short names and SPDX ids of licenses, and sentences of their texts. A keyword is one or more whole words that every match of its rule holds.
"""

_ONLY = r"(?: only| or later)?"
_OR = r"(?: (?:only|or later|or newer|or any later version))?"

#: Short names and SPDX ids: NAME in a text counts as the license where nothing else goes by it.
SHORT = (
    ("gpl", "gpl", r"(?:gnu )?gpl(?: version)?(?: v?[123](?: 0)?)?" + _OR, 58),
    ("gpl", "gplv1", r"gplv1" + _OR, 58),
    ("gpl", "gplv2", r"gplv2(?: 0)?" + _OR, 58),
    ("gpl", "gplv3", r"gplv3(?: 0)?" + _OR, 58),
    ("gpl", "gpl2", r"gpl2", 58),
    ("gpl", "gpl3", r"gpl3", 58),
    ("gpl", "gnu public", r"gnu public licen[cs]e", 56),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: version)?(?: v?(?:2 1|2 0|3 0|2|3))?" + _OR, 59),
    ("lgpl", "lgplv2", r"lgplv2(?: [01])?" + _OR, 59),
    ("lgpl", "lgplv3", r"lgplv3(?: 0)?" + _OR, 59),
    ("lgpl", "lgpl2", r"lgpl2(?: 1)?", 59),
    ("lgpl", "lgpl3", r"lgpl3", 59),
    ("lgpl", "gnu lesser", r"gnu lesser public licen[cs]e", 57),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: version)?(?: v?[13](?: 0)?)?" + _OR, 59),
    ("agpl", "agplv3", r"agplv3(?: 0)?" + _OR, 59),
    ("agpl", "agpl3", r"agpl3", 59),
    ("agpl", "affero gpl", r"affero gpl(?: v?3)?", 60),
    ("fdl", "gfdl", r"(?:gnu )?gfdl(?: v?1 [123])?" + _OR, 59),
    ("fdl", "fdl", r"(?:gnu )?fdl(?: v?1 [123])?" + _OR, 59),
    ("mpl", "mpl", r"mpl(?: v?[12] [01])(?: no copyleft exception)?", 58),
    ("mpl", "mplv2", r"mplv2(?: 0)?", 58),
    ("mpl", "mpl2", r"mpl2", 58),
    ("mpl", "mpl", r"mpl licen[cs]e", 56),
    ("epl", "epl", r"epl v?[12] 0", 58),
    ("edl", "eclipse distribution", r"eclipse distribution licen[cs]e(?: v?1 0)?", 58),
    ("cpl", "cpl", r"cpl 1 0", 58),
    ("cpl", "common public", r"common public licen[cs]e(?: version)?(?: 1 0)?", 58),
    ("ipl", "ibm public", r"ibm public licen[cs]e(?: version)?(?: 1 0)?", 58),
    ("cddl", "cddl", r"cddl(?: v?1 [01])?", 58),
    ("apache", "apache 2", r"apache 2(?: 0)?(?! [0-9])", 56),
    ("apache", "apache 1", r"apache 1(?: [01])?(?! [0-9])", 56),
    ("apache", "apache2", r"apache2(?: 0)?", 56),
    ("apache", "asl 2", r"asl 2(?: 0)?", 56),
    ("apache", "apachev2", r"apachev2", 56),
    ("bsd", "bsd 2", r"bsd 2 clause(?: patent| views)?", 56),
    ("bsd", "bsd 3", r"bsd 3 clause(?: clear| attribution| lbnl| modification)?", 56),
    ("bsd", "bsd 4", r"bsd 4 clause(?: uc| shortened)?", 56),
    ("bsd", "bsd 1", r"bsd 1 clause", 56),
    ("bsd", "clause bsd", r"(?:[1234]|two|three|four) clause bsd", 56),
    ("bsd", "bsd2", r"bsd2", 54),
    ("bsd", "bsd3", r"bsd3", 54),
    ("bsd", "bsd style", r"bsd style", 54),
    ("bsd", "freebsd", r"freebsd (?:licen[cs]e|copyright)", 56),
    ("0bsd", "0bsd", r"0bsd", 60),
    ("0bsd", "zero clause", r"zero clause bsd", 60),
    ("mit", "expat", r"expat licen[cs]e", 56),
    ("mit", "mit x11", r"mit x11", 56),
    ("mit", "x11", r"x11 licen[cs]e", 56),
    ("mit", "mit style", r"mit style licen[cs]e", 56),
    ("mit", "mit licensed", r"mit licen[cs]ed", 56),
    ("mit-0", "mit 0", r"mit 0", 60),
    ("mit-0", "mit no", r"mit no attribution", 60),
    ("isc", "isc licensed", r"isc licen[cs]ed", 56),
    ("boost", "bsl 1", r"bsl 1 0", 58),
    ("busl", "busl", r"busl(?: 1 1)?", 58),
    ("busl", "business source", r"business source licen[cs]e(?: 1 1)?", 58),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 58),
    ("unlicense", "unlicense org", r"unlicense org", 60),
    ("wtfpl", "wtfpl", r"wtfpl", 52),
    ("wtfpl", "do what", r"do what the fuck you want to public licen[cs]e", 90),
    ("cc", "cc by", r"cc by(?: (?:nc sa|nc nd|sa|nd|nc))?(?: [1-4] [05])?(?: (?:international|unported))?", 72),
    ("cc0", "cc0", r"cc0(?: 1 0)?", 74),
    ("cc", "cc sa", r"cc sa 1 0", 72),
    ("cc0", "creative commons", r"creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?", 76),
    ("cc", "creativecommons org", r"creativecommons org licenses (?:by|nc|nd|sa)(?: (?:nc|nd|sa))*(?: [1-4] [05])?", 78),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero(?: 1 0)?", 78),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark(?: 1 0)?", 78),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal(?: licen[cs]e)?", 70),
    ("ms-rl", "ms rl", r"ms rl", 60),
    ("ms-pl", "ms pl", r"ms pl", 60),
    ("eupl", "eupl", r"eupl(?: v?1 [012])?", 58),
    ("osl", "osl", r"osl v?[123] [01]", 58),
    ("afl", "afl", r"afl v?[123] [012]", 58),
    ("ofl", "ofl", r"(?:sil )?ofl(?: v?1 [01])?", 58),
    ("psf", "psf", r"psf(?: licen[cs]e(?: agreement)?| 2 0)", 58),
    ("artistic", "artistic 2", r"artistic 2 0", 56),
    ("artistic", "artistic 1", r"artistic 1 0(?: perl| cl8)?", 56),
    ("perl", "same terms", r"same terms as perl(?: itself)?", 70),
    ("odbl", "odbl", r"odbl(?: v?1 0)?", 58),
    ("odc-by", "odc by", r"odc by(?: 1 0)?", 58),
    ("odc-by", "open data", r"open data commons attribution licen[cs]e", 60),
    ("pddl", "pddl", r"pddl(?: 1 0)?", 58),
    ("pddl", "public domain", r"public domain dedication and licen[cs]e", 64),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", 58),
    ("sspl", "sspl", r"sspl(?: v?1(?: 0)?)?", 58),
    ("sspl", "server side", r"server side public licen[cs]e(?: version)?(?: v?1)?", 60),
    ("elastic", "elastic license", r"elastic license(?: (?:version )?v?2(?: 0)?)?", 58),
    ("upl", "universal permissive", r"universal permissive licen[cs]e(?: v?1 0)?", 58),
    ("upl", "upl 1", r"upl 1 0", 58),
    ("beerware", "beer ware", r"beer ware(?: licen[cs]e)?", 60),
    ("beerware", "beerware", r"beerware(?: licen[cs]e)?", 60),
    ("zpl", "zope public", r"zope public licen[cs]e(?: version)?(?: [12] [01])?", 58),
    ("zpl", "zpl", r"zpl [12] [01]", 58),
    ("w3c", "w3c software", r"w3c software(?: notice and)?(?: and document)? licen[cs]e", 58),
    ("qpl", "q public", r"q public licen[cs]e", 58),
    ("lppl", "lppl", r"lppl(?: 1 [0-3][abc]?)?", 58),
    ("lppl", "latex project", r"latex project public licen[cs]e", 60),
    ("blueoak", "blueoak", r"blueoak 1 0 0", 60),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e", 60),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v?2)?", 60),
    ("mulan", "mulanpsl", r"mulanpsl [12] 0", 60),
    ("cecill", "cecill", r"cecill(?: [bc]| [12] [01])?", 58),
    ("parity", "parity", r"parity public licen[cs]e", 58),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|free trial|strict|internal use)(?: licen[cs]e)?", 60),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e)?", 60),
    ("apsl", "apple public", r"apple public source licen[cs]e", 60),
    ("apsl", "apsl", r"apsl [12] [0-2]", 58),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e", 58),
    ("sleepycat", "sleepycat", r"sleepycat(?: public)? licen[cs]e", 58),
    ("npl", "netscape public", r"netscape public licen[cs]e", 58),
    ("spl", "sun public", r"sun public licen[cs]e", 58),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e", 58),
    ("ecl", "educational community", r"educational community licen[cs]e", 58),
    ("ijg", "independent jpeg", r"independent jpeg group licen[cs]e", 58),
    ("icu", "icu license", r"icu license", 56),
    ("unicode", "unicode", r"unicode(?: inc)?(?: data files and software)? licen[cs]e(?: agreement)?", 58),
    ("curl", "curl license", r"curl license", 56),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", 60),
    ("libpng", "libpng", r"libpng(?: 2 0| licen[cs]e)", 58),
    ("bzip2", "bzip2", r"bzip2 (?:licen[cs]e|1 0 6)", 58),
    ("ftl", "freetype", r"freetype(?: project)? licen[cs]e", 58),
    ("vim", "charityware", r"vim is charityware", 80),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m| rail m)?(?: licen[cs]e)?", 58),
    ("llama", "llama", r"llama [234](?: [123])? community licen[cs]e", 60),
)

#: Names of licenses with the word license, versions before or after it.
NAMES = (
    ("mit", "mit", r"(?:x11 )?mit(?: expat)? (?:public )?licen[cs]e", 58),
    ("apache", "apache", r"(?:asf )?apache(?: software)? (?:public )?licen[cs]e(?:(?: version)? v?[12](?: [01])?)?", 58),
    ("apache", "apache", r"apache(?: software)? v?[12](?: [01])? licen[cs]e", 58),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e(?:(?: version)? v?[123](?: 0)?)?", 58),
    ("gpl", "general public", r"(?:gnu )?general public v?[123](?: 0)? licen[cs]e", 58),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e(?:(?: version)? v?(?:2 1|3 0|2|3))?", 62),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e(?:(?: version)? v?2(?: 0)?)?", 62),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e(?:(?: version)? v?[13](?: 0)?)?", 62),
    ("bsd", "bsd", r"(?:new |modified |simplified |revised |original |berkeley )?bsd(?: style)?(?: [1234] clause)? (?:public )?licen[cs]e", 58),
    ("bsd", "bsd", r"(?:[1234]|two|three|four) clause bsd licen[cs]e", 58),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e(?:(?: version)? v?[12] [01])?", 60),
    ("epl", "eclipse public", r"eclipse public licen[cs]e(?:(?: version)? v?[12](?: 0)?)?", 60),
    ("cddl", "common development", r"common development and distribution licen[cs]e(?:(?: version)? v?1 [01])?", 60),
    ("cc", "creative commons", r"creative commons(?: attribution)?(?: (?:non ?commercial|share ?alike|no ?deriv(?:ative)?s?))* licen[cs]e", 62),
    ("cc", "creative commons", r"creative commons attribution(?: (?:non ?commercial|share ?alike|no ?deriv(?:ative)?s?))*(?: [1-4] [05])?(?: (?:international|unported|generic))?", 61),
    ("isc", "isc", r"isc licen[cs]e", 58),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", 58),
    ("boost", "boost", r"boost(?: software)? licen[cs]e(?:(?: version)? v?1 0)?", 58),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e(?:(?: version)? v?[12](?: 0)?)?", 58),
    ("eupl", "european union", r"european union public licen[cs]e(?:(?: version)? v?1 [012])?", 60),
    ("osl", "open software", r"open software licen[cs]e(?:(?: version)? v?[123] [01])?", 58),
    ("afl", "academic free", r"academic free licen[cs]e(?:(?: version)? v?[123] [012])?", 58),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e(?:(?: version)? v?1 [01])?", 58),
    ("psf", "python", r"(?:python software foundation|psf python|python) licen[cs]e(?: agreement)?(?:(?: version)? v?2(?: 0)?)?", 58),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?(?:(?: version)? v?2)?", 58),
    ("fdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?:(?: version)? v?1 [123])?", 60),
    ("odbl", "open database", r"open database licen[cs]e(?:(?: version)? v?1 0)?", 58),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", 60),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", 58),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e", 58),
    ("php", "php", r"php licen[cs]e(?:(?: version)? v?3 01?)?", 58),
    ("ruby", "ruby", r"ruby licen[cs]e", 58),
    ("vim", "vim", r"vim licen[cs]e", 58),
    ("mit", "mit", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?mit(?: expat)?", 55),
    ("apache", "apache", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?apache", 55),
    ("bsd", "bsd", r"(?:licensed|released|distributed) under (?:a |the )?(?:terms of (?:the )?)?(?:new |modified |simplified )?bsd", 55),
    ("isc", "isc", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?isc", 55),
    ("zlib", "zlib", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?zlib", 55),
    ("artistic", "artistic", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:perl )?artistic", 55),
    ("php", "php", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?php", 55),
    ("ruby", "ruby", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?ruby", 55),
    ("psf", "python", r"(?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?python", 54),
)

#: `License: NAME` and the like, for names that are too short to stand alone.
NAMED = (
    ("mit", "license mit", r"license mit", 62),
    ("mit", "licence mit", r"licence mit", 62),
    ("mit", "under mit", r"under mit", 55),
    ("apache", "license apache", r"license apache(?: software license)?(?: (?:version )?v?[12](?: [01])?)?", 62),
    ("apache", "licence apache", r"licence apache(?: v?[12](?: [01])?)?", 62),
    ("bsd", "license bsd", r"license bsd(?: [1234] clause)?", 62),
    ("bsd", "licence bsd", r"licence bsd(?: [1234] clause)?", 62),
    ("isc", "license isc", r"license isc", 62),
    ("mpl", "license mpl", r"license mpl(?: v?[12](?: [01])?)?", 62),
    ("mpl", "under mpl", r"under mpl", 55),
    ("mpl", "the mpl", r"under the mpl", 55),
    ("epl", "license epl", r"license epl(?: v?[12](?: 0)?)?", 62),
    ("zlib", "license zlib", r"license zlib", 62),
    ("boost", "license bsl", r"license bsl(?: 1 0)?", 62),
    ("boost", "license boost", r"license boost(?: software)?", 62),
    ("artistic", "license artistic", r"license artistic(?: [12] 0)?", 62),
    ("psf", "license psf", r"license psf", 62),
    ("postgresql", "license postgresql", r"license postgresql", 62),
    ("proprietary", "license proprietary", r"license proprietary", 62),
    ("proprietary", "license unlicensed", r"license unlicensed", 62),
    ("public-domain", "license public", r"license public domain", 64),
)

#: SPDX tags by the license that they name; any other tag stays `spdx`.
SPDX = tuple(
    (label, "spdx license", r"spdx license identifier " + regex, 90)
    for label, regex in (
        ("mit", r"mit(?! 0 )"), ("mit-0", r"mit 0"), ("apache", r"apache [12] [01]"), ("gpl", r"gpl [123] 0" + _ONLY), ("lgpl", r"lgpl [23] [01]" + _ONLY), ("agpl", r"agpl [13] 0" + _ONLY),
        ("bsd", r"bsd [1234] clause"), ("0bsd", r"0bsd"), ("mpl", r"mpl [12] [01]"), ("epl", r"epl [12] 0"), ("cddl", r"cddl 1 [01]"), ("isc", r"isc"), ("zlib", r"zlib"), ("boost", r"bsl 1 0"),
        ("unlicense", r"unlicense"), ("wtfpl", r"wtfpl"), ("cc0", r"cc0 1 0"), ("cc", r"cc by(?: (?:nc|nd|sa))* [1-4] [05]"), ("artistic", r"artistic [12] 0"), ("ofl", r"ofl 1 [01]"),
        ("psf", r"(?:psf|python) 2 0"), ("eupl", r"eupl 1 [012]"), ("osl", r"osl [123] [01]"), ("afl", r"afl [123] [012]"), ("ms-pl", r"ms pl"), ("ms-rl", r"ms rl"), ("fdl", r"gfdl 1 [123]" + _ONLY),
        ("odbl", r"odbl 1 0"), ("postgresql", r"postgresql"), ("openssl", r"openssl"), ("php", r"php 3 01?"), ("ruby", r"ruby"), ("vim", r"vim"), ("ncsa", r"ncsa"), ("upl", r"upl 1 0"), ("busl", r"busl 1 1"),
    )
)

#: Sentences of the licenses' own texts.
BODIES = (
    ("mit", "the above copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 90),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 90),
    ("bsd", "redistributions of", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 90),
    ("bsd", "redistributions in", r"redistributions in binary form must reproduce the above copyright notice", 88),
    ("bsd", "endorse or", r"may be used to endorse or promote products derived from this software without specific prior written permission", 88),
    ("bsd", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 90),
    ("isc", "provided as", r"the software is provided as is and the author disclaims all warranties with regard to this software", 88),
    ("apache", "apache org", r"apache org licenses license [12] [01](?: txt| html)?", 86),
    ("apache", "except in", r"you may not use this file except in compliance with the license", 60),
    ("apache", "contributor hereby", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 88),
    ("apache", "limitations under", r"see the license for the specific language governing permissions and limitations under the license", 60),
    ("gpl", "along with", r"you should have received a copy of the gnu general public license along with", 90),
    ("lgpl", "along with", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 91),
    ("agpl", "along with", r"you should have received a copy of the gnu affero general public license along with", 91),
    ("gpl", "gnu org", r"gnu org licenses (?:old licenses )?gpl(?: [123] 0)?(?: html| txt)?", 86),
    ("lgpl", "gnu org", r"gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?(?: html| txt)?", 86),
    ("agpl", "gnu org", r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 86),
    ("gpl", "guarantee your", r"the gnu general public license is intended to guarantee your freedom to share and change", 90),
    ("fdl", "granted to", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 92),
    ("mpl", "source code", r"this source code form is subject to the terms of the mozilla public license(?: v 2 0)?", 92),
    ("mpl", "mozilla org", r"mozilla org mpl(?: [12] [01])?", 86),
    ("mpl", "contents of", r"the contents of this file are subject to the mozilla public license", 92),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 92),
    ("epl", "eclipse org", r"eclipse org legal epl(?: v10| v20| 2 0)?", 86),
    ("cddl", "contents of", r"the contents of this file are subject to the terms of the common development and distribution license", 92),
    ("zlib", "without any", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 90),
    ("zlib", "origin of", r"the origin of this software must not be misrepresented", 90),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 90),
    ("boost", "boost org", r"boost org license 1 0(?: txt)?", 86),
    ("boost", "organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 91),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software", 88),
    ("unlicense", "compiled binary", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", 90),
    ("ofl", "font software", r"this font software is licensed under the sil open font license", 92),
    ("ofl", "reserved font", r"with reserved font name", 80),
    ("artistic", "the intent", r"the intent of this document is to state the conditions under which a package may be copied", 60),
    ("postgresql", "written agreement", r"without fee and without a written agreement is hereby granted", 88),
    ("cc", "creative commons", r"this work is licensed under (?:a|the) creative commons attribution", 80),
    ("cc0", "waived all", r"waived all copyright and related or neighboring rights", 88),
    ("public-domain", "public domain", r"this (?:file|work|code|software|program) is in the public domain", 70),
    ("openssl", "openssl project", r"software developed by the openssl project", 86),
    ("ssleay", "eric young", r"cryptographic software written by eric young", 86),
    ("php", "php software", r"includes php software", 84),
    ("beerware", "buy me", r"you can buy me a beer in return", 88),
    ("ijg", "independent jpeg", r"based in part on the work of the independent jpeg group", 86),
    ("ftl", "freetype team", r"portions of this software are copyright (?:[0-9]+ )?the freetype", 84),
    ("proprietary", "confidential and", r"(?:confidential and proprietary|proprietary and confidential)", 50),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 70),
)

HAND = (*NAMES, *SHORT, *NAMED, *SPDX, *BODIES)
