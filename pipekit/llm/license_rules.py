"""The signatures of the license scan, by kind; kinds listed first have the higher priority.

A pattern is a regular expression over lower-case words that are one space apart, and begins with a
word. A label that ends in `*` takes the version that the pattern met, as 2.0 or 2.0-or-later.
"""

from __future__ import annotations

# Identifiers after "SPDX-License-Identifier:".
SPDX = """MIT MIT-0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD GPL-1.0-only GPL-2.0-only GPL-2.0-or-later
GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only
AGPL-3.0-or-later MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 CDDL-1.0 Artistic-2.0 ISC Zlib BSL-1.0 PSF-2.0 PHP-3.01 OFL-1.1
Unlicense WTFPL CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 ODbL-1.0 MS-PL NCSA PostgreSQL OpenSSL Vim Ruby CECILL-2.1""".split()

# Sentences that only the text of a license has.
BODIES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,6}nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual"),
    ("apache-2.0", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing (?:software|licensor)"),
    ("apache-1.1", "products derived from this software may not be called apache"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "the gnu general public license is a free copyleft license for software"),
    ("gpl", "you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl", "this license applies to any program or other work which contains a notice placed by the copyright holder"),
    ("gpl", "you may convey a covered work in object code form"),
    ("lgpl", "this license applies to any software library or other program which contains a notice"),
    ("lgpl", "a program that contains no derivative of any portion of the library"),
    ("agpl", "if you modify the program your modified version must prominently offer all users"),
    ("agpl", "the gnu affero general public license is a free copyleft license"),
    ("fdl", "the purpose of this license is to make a manual textbook or other functional and useful document free"),
    ("mpl", "this source code form is incompatible with secondary licenses"),
    ("mpl", "covered software is provided under this license on an as is basis"),
    ("epl", "each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license"),
    ("epl", "any use reproduction or distribution of the program constitutes recipient s acceptance"),
    ("eupl", "the licensor grants you a worldwide royalty free non exclusive sublicensable licence"),
    ("cddl", "this license shall be governed by the law of the jurisdiction specified in a notice"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "this license establishes the terms under which a given free software package may be copied"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("ofl", "the fonts? (?:is|are) licensed under the sil open font license"),
    ("ofl", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc", "the work as defined below is provided under the terms of this creative commons public license"),
    ("cc", "by exercising the licensed rights defined below you accept and agree to be bound by the terms"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("python", "this license agreement is between the python software foundation"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ncsa", "permission is hereby granted free of charge to any person (?:[^ ]+ ){1,6}to deal with the software"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "the software shall be used for good not evil"),
    ("odbl", "the open database license odbl is a license agreement intended to allow users to freely share"),
]

# Notices at the head of a file.
HEADERS = [
    ("apache-*", "licensed under the apache licen[cs]e version [0-9](?: [0-9])?"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-*", "(?:http|https) www apache org licenses license [0-9] [0-9]"),
    ("gpl-*", "under the terms of the gnu general public licen[cs]e as published by the free software foundation (?:either )?version [0-9]"),
    ("gpl", "under the terms of the gnu general public licen[cs]e"),
    ("gpl", "this program is free software you can redistribute it and or modify"),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "(?:http|https) www gnu org licenses gpl"),
    ("lgpl-*", "under the terms of the gnu (?:lesser|library) general public licen[cs]e version [0-9](?: [0-9])?"),
    ("lgpl", "under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "this library is free software you can redistribute it and or modify"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "(?:http|https) www gnu org licenses lgpl"),
    ("agpl", "under the terms of the gnu affero general public licen[cs]e"),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl", "(?:http|https) www gnu org licenses agpl"),
    ("fdl-*", "under the terms of the gnu free documentation licen[cs]e version [0-9] [0-9]"),
    ("mpl-*", "this source code form is subject to the terms of the mozilla public licen[cs]e v [0-9] [0-9]"),
    ("mpl-*", "the contents of this file are subject to the mozilla public licen[cs]e version [0-9] [0-9]"),
    ("mpl", "(?:http|https) (?:www )?mozilla org mpl"),
    ("epl-*", "made available under the terms of the eclipse public licen[cs]e v ?[0-9] [0-9]"),
    ("epl", "(?:http|https) www eclipse org legal epl"),
    ("eupl", "licensed under the eupl"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("mit", "licensed under the mit licen[cs]e"),
    ("mit", "released under the (?:terms of the )?mit licen[cs]e"),
    ("mit", "distributed under the (?:terms of the )?mit licen[cs]e"),
    ("mit", "(?:http|https) (?:www )?opensource org licenses mit"),
    ("mit", "use of this source code is governed by an mit style licen[cs]e"),
    ("bsd", "use of this source code is governed by a bsd style licen[cs]e"),
    ("bsd", "licensed under the bsd licen[cs]e"),
    ("bsd", "released under the (?:terms of the )?bsd licen[cs]e"),
    ("bsd", "(?:http|https) (?:www )?opensource org licenses bsd license"),
    ("isc", "licensed under the isc licen[cs]e"),
    ("zlib", "licensed under the zlib licen[cs]e"),
    ("boost-*", "distributed under the boost software licen[cs]e version [0-9] [0-9]"),
    ("boost", "(?:http|https) www boost org license"),
    ("artistic", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic", "(?:http|https) (?:www )?opensource org licenses artistic"),
    ("unlicense", "(?:http|https) (?:www )?unlicense org"),
    ("cc0-1.0", "(?:http|https) creativecommons org publicdomain zero"),
    ("public-domain", "(?:http|https) creativecommons org publicdomain mark"),
    ("cc-by-*", "(?:http|https) creativecommons org licenses by [0-9] [0-9]"),
    ("cc-by-sa-*", "(?:http|https) creativecommons org licenses by sa [0-9] [0-9]"),
    ("cc-by-nd-*", "(?:http|https) creativecommons org licenses by nd [0-9] [0-9]"),
    ("cc-by-nc-*", "(?:http|https) creativecommons org licenses by nc [0-9] [0-9]"),
    ("cc-by-nc-sa-*", "(?:http|https) creativecommons org licenses by nc sa [0-9] [0-9]"),
    ("cc-by-nc-nd-*", "(?:http|https) creativecommons org licenses by nc nd [0-9] [0-9]"),
    ("ofl", "(?:http|https) scripts sil org ofl"),
    ("odbl", "(?:http|https) opendatacommons org licenses odbl"),
    ("copyleft", "copyleft all wrongs reserved"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited without permission"),
    ("proprietary", "this software is the confidential and proprietary information of (?:[^ ]+ ){1,6}license agreement"),
]

# Names with a version.
VERSIONED = [
    ("gpl-*", "(?:gnu )?general public licen[cs]e (?:version |v )?[0-9](?: 0)?(?: or (?:later|newer)| or any later version| only)?"),
    ("gpl-*", "(?:gnu )?general public licen[cs]e v[0-9](?: 0)?(?: or (?:later|newer)| only)?"),
    ("gpl-*", "gnu gpl (?:version |v )?v?[0-9](?: 0)?(?: or (?:later|newer)| only)?"),
    ("gpl-*", "gpl (?:version |v )?v?[0-9](?: 0)?(?: or (?:later|newer)| only)?"),
    ("gpl-*", "gplv[0-9](?: or (?:later|newer)| only)?"),
    ("lgpl-*", "(?:gnu )?lesser general public licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?(?: or (?:later|newer)| only)?"),
    ("lgpl-*", "(?:gnu )?library general public licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?(?: or (?:later|newer)| only)?"),
    ("lgpl-*", "lgpl (?:version |v )?v?[0-9](?: [0-9])?(?: or (?:later|newer)| only)?"),
    ("lgpl-*", "lgplv[0-9](?: [0-9])?(?: or (?:later|newer)| only)?"),
    ("agpl-*", "(?:gnu )?affero general public licen[cs]e (?:version |v )?v?[0-9](?: 0)?(?: or (?:later|newer)| only)?"),
    ("agpl-*", "agpl (?:version |v )?v?[0-9](?: 0)?(?: or (?:later|newer)| only)?"),
    ("agpl-*", "agplv[0-9](?: or (?:later|newer)| only)?"),
    ("fdl-*", "(?:gnu )?free documentation licen[cs]e (?:version |v )?v?[0-9] [0-9](?: or (?:later|newer)| only)?"),
    ("apache-*", "apache (?:software )?licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("apache-*", "asl [0-9] [0-9] licen[cs]e"),
    ("mpl-*", "mozilla public licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("mpl-*", "mpl [0-9] [0-9] licen[cs]e"),
    ("epl-*", "eclipse public licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("eupl-*", "european union public licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("cddl-*", "common development and distribution licen[cs]e (?:cddl )?(?:version |v )?v?[0-9](?: [0-9])?"),
    ("artistic-*", "artistic licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("ofl-*", "(?:sil )?open font licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("afl-*", "academic free licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("osl-*", "open software licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("boost-*", "boost software licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("php-*", "php licen[cs]e (?:version |v )?v?[0-9](?: [0-9]+)?"),
    ("cecill-*", "cecill licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("zpl-*", "zope public licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("qpl-*", "q public licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("lppl-*", "latex project public licen[cs]e (?:version |v )?v?[0-9](?: [0-9])?"),
    ("cc-by-*", "creative commons attribution [0-9](?: [0-9])?"),
    ("cc-by-sa-*", "creative commons attribution share ?alike [0-9](?: [0-9])?"),
    ("cc-by-nd-*", "creative commons attribution no ?deriv(?:s|atives) [0-9](?: [0-9])?"),
    ("cc-by-nc-*", "creative commons attribution non ?commercial [0-9](?: [0-9])?"),
    ("cc-by-nc-sa-*", "creative commons attribution non ?commercial share ?alike [0-9](?: [0-9])?"),
    ("cc-by-nc-nd-*", "creative commons attribution non ?commercial no ?deriv(?:s|atives) [0-9](?: [0-9])?"),
    ("cc-by-*", "cc by [0-9](?: [0-9])? licen[cs]e"),
    ("cc-by-sa-*", "cc by sa [0-9](?: [0-9])? licen[cs]e"),
    ("cc-by-nd-*", "cc by nd [0-9](?: [0-9])? licen[cs]e"),
    ("cc-by-nc-*", "cc by nc [0-9](?: [0-9])? licen[cs]e"),
    ("cc-by-nc-sa-*", "cc by nc sa [0-9](?: [0-9])? licen[cs]e"),
    ("cc-by-nc-nd-*", "cc by nc nd [0-9](?: [0-9])? licen[cs]e"),
    ("cc0-1.0", "cc0 1 0(?: universal)?"),
]

# Names alone.
NAMES = [
    ("mit", "mit licen[cs]e"),
    ("mit", "mit x11 licen[cs]e"),
    ("mit", "expat licen[cs]e"),
    ("mit", "mit style licen[cs]e"),
    ("x11", "x11 licen[cs]e"),
    ("apache", "apache (?:software )?licen[cs]e"),
    ("apache", "asf licen[cs]e"),
    ("gpl", "(?:gnu )?general public licen[cs]e"),
    ("gpl", "gnu gpl(?: licen[cs]e)?"),
    ("gpl", "gpl licen[cs]ed?"),
    ("lgpl", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "(?:gnu )?library general public licen[cs]e"),
    ("lgpl", "lgpl licen[cs]ed?"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl licen[cs]ed?"),
    ("fdl", "(?:gnu )?free documentation licen[cs]e"),
    ("bsd", "bsd licen[cs]ed?"),
    ("bsd", "berkeley software distribution licen[cs]e"),
    ("bsd", "bsd style licen[cs]e"),
    ("bsd-2-clause", "(?:simplified|freebsd) bsd licen[cs]e"),
    ("bsd-2-clause", "bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "(?:two|2) clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-3-clause", "bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "(?:three|3) clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "(?:original|old) bsd licen[cs]e"),
    ("bsd-4-clause", "bsd 4 clause(?: licen[cs]e)?"),
    ("0bsd", "zero clause bsd(?: licen[cs]e)?"),
    ("mpl", "mozilla public licen[cs]e"),
    ("epl", "eclipse public licen[cs]e"),
    ("eupl", "european union public licen[cs]e"),
    ("cddl", "common development and distribution licen[cs]e"),
    ("cpl", "common public licen[cs]e"),
    ("ipl", "ibm public licen[cs]e"),
    ("artistic", "(?:perl )?artistic licen[cs]e"),
    ("isc", "isc licen[cs]e"),
    ("isc", "internet systems consortium licen[cs]e"),
    ("zlib", "zlib (?:libpng )?licen[cs]e"),
    ("boost", "boost software licen[cs]e"),
    ("python", "python (?:software foundation )?licen[cs]e"),
    ("php", "php licen[cs]e"),
    ("ofl", "(?:sil )?open font licen[cs]e"),
    ("osl", "open software licen[cs]e"),
    ("afl", "academic free licen[cs]e"),
    ("odbl", "open (?:data commons open )?database licen[cs]e"),
    ("ms-pl", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal licen[cs]e"),
    ("ncsa", "university of illinois ncsa open source licen[cs]e"),
    ("postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl licen[cs]e"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e"),
    ("wtfpl", "wtfpl"),
    ("vim", "vim licen[cs]e"),
    ("ruby", "ruby licen[cs]e"),
    ("cecill", "cecill licen[cs]e"),
    ("zpl", "zope public licen[cs]e"),
    ("qpl", "q public licen[cs]e"),
    ("lppl", "latex project public licen[cs]e"),
    ("beerware", "beerware licen[cs]e"),
    ("unlicense", "unlicense"),
    ("cc0-1.0", "creative commons zero"),
    ("cc0-1.0", "cc0 licen[cs]e"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution share ?alike"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)"),
    ("cc-by-nc", "creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)"),
    ("cc-by", "cc by licen[cs]e"),
    ("cc-by-sa", "cc by sa licen[cs]e"),
    ("cc-by-nc", "cc by nc licen[cs]e"),
]

# What hints at a kind of license.
HINTS = [
    ("cc", "creative commons(?: licen[cs]e)?"),
    ("public-domain", "released (?:in|into) the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "public domain dedication"),
    ("copyleft", "copyleft licen[cs]e"),
    ("permissive", "permissive (?:free software |open source )?licen[cs]e"),
    ("open-source", "open source licen[cs]e"),
    ("open-source", "osi approved licen[cs]e"),
    ("proprietary", "proprietary licen[cs]e"),
    ("proprietary", "commercial licen[cs]e"),
    ("proprietary", "end user licen[cs]e agreement"),
    ("proprietary", "software licen[cs]e agreement"),
    ("proprietary", "reproduction without (?:prior )?(?:written )?permission is (?:strictly )?prohibited"),
    ("no-warranty", "provided as is without warranty of any kind"),
    ("no-warranty", "the software is provided as is without warranty"),
    ("dual", "dual licen[cs]ed under"),
    ("see-file", "see (?:the )?(?:file )?licen[cs]e (?:file|txt|md) for (?:more )?(?:details|information)"),
    ("see-file", "see (?:the )?accompanying licen[cs]e file"),
]

__all__ = ["BODIES", "HEADERS", "HINTS", "NAMES", "SPDX", "VERSIONED"]
