"""License scan: ordered signature rules over normalised text, DataFrame functions only.

Text is reduced to words joined by single blanks, A-Z in lower case.  Rules are hand-written: identifiers in SPDX
expressions, sentences of licence bodies and file headers, shared clauses, short forms and addresses, mentions; and the
names of licences in notices, pointers and titles.  Each has its keyword, expression, priority, label and weight.
A keyword's rules run only on texts that hold it, and no rule runs on texts without any anchor word.  Every detection
is an interval.  An interval that lies inside one of an earlier (stronger) priority, or inside a longer one of
the same priority, is suppressed; of equal intervals of a priority the first rule's stays.

The whole job is one projection: no shuffle, no Python.  Defined results: null or
empty text has zero words, no labels and score 0; texts of any length are scanned whole; repeated rows are scanned alike; an
empty table gives no rows; other columns of the input are kept and a clash with an output name replaces the input's column.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed values).
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: label, keyword that must stand in the text, name as a regular expression over words.
#: Every match of a name holds its keyword.
LICENSES = (
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version |v )?2(?: 0)?"),
    ("mit", " mit ", r"mit license"),
    ("mit-0", "no attribution", r"mit no attribution(?: license)?"),
    ("isc", " isc ", r"isc license"),
    ("bsd-2-clause", " bsd ", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: license)?"),
    ("bsd-3-clause", " bsd ", r"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?"),
    ("bsd-4-clause", " bsd ", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: license)?"),
    ("0bsd", " bsd ", r"(?:zero clause bsd|bsd zero clause)(?: license)?"),
    ("gpl-1.0", "general public license", r"(?:gnu )?general public license (?:version |v )?1(?: 0)?"),
    ("gpl-2.0", "general public license", r"(?:gnu )?general public license (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", "general public license", r"(?:gnu )?general public license (?:version |v )?3(?: 0)?"),
    ("lgpl-2.0", "general public license", r"(?:gnu )?(?:lesser|library) general public license (?:version |v )?2(?: 0)?"),
    ("lgpl-2.1", "general public license", r"(?:gnu )?(?:lesser|library) general public license (?:version |v )?2 1"),
    ("lgpl-3.0", "general public license", r"(?:gnu )?lesser general public license (?:version |v )?3(?: 0)?"),
    ("agpl-3.0", "general public license", r"(?:gnu )?affero general public license (?:version |v )?3(?: 0)?"),
    ("gfdl-1.2", "documentation license", r"(?:gnu )?free documentation license (?:version |v )?1 2"),
    ("gfdl-1.3", "documentation license", r"(?:gnu )?free documentation license (?:version |v )?1 3"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v )?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v )?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v )?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license (?:version |v )?2(?: 0)?"),
    ("cddl-1.0", "development and distribution", r"common development and distribution license(?: (?:version |v )?1(?: 0)?)?"),
    ("cpl-1.0", "common public", r"common public license(?: (?:version |v )?1(?: 0)?)?"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e (?:version |v )?1 2"),
    ("artistic-2.0", "artistic", r"artistic license (?:version |v )?2(?: 0)?"),
    ("bsl-1.0", "boost", r"boost software license(?: (?:version |v )?1(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public license"),
    ("python-2.0", "python software foundation", r"python software foundation license(?: (?:version |v )?2)?"),
    ("php-3.01", " php ", r"php license(?: (?:version |v )?3 0?1)?"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("openssl", "openssl", r"openssl license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: (?:version |v )?1 1)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("odbl-1.0", "open data", r"open (?:data commons open )?database license(?: (?:version |v )?1 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: (?:version |v )?1 0)?(?: universal)?"),
    *(
        (f"cc-{kind.replace(' ', '-')}-{major}.0", kw, rf"{name}(?: license)?(?: (?:version |v )?{major} 0)(?: international| unported)?")
        for kind, long in (
            ("by", r"attribution"),
            ("by sa", r"attribution share ?alike"),
            ("by nd", r"attribution no ?deriv(?:ative)?s"),
            ("by nc", r"attribution non ?commercial"),
            ("by nc sa", r"attribution non ?commercial share ?alike"),
            ("by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s"),
        )
        for kw, name in ((f" cc {kind} ", f"cc {kind}"), ("creative commons attribution", f"creative commons {long}"))
        for major in (2, 3, 4)
    ),
)

#: priority (0 strongest), name of the form, keyword of the form, template, weight.
FORMS = (
    (1, "notice", " under ", r"(?:licensed|released|distributed|available|published|provided|redistributed|covered) under (?:the )?(?:terms of (?:the )?)?{name}", 0.95),
    (1, "subject", "subject to", r"subject to (?:the )?(?:terms of (?:the )?)?{name}", 0.9),
    (2, "pointer", " see ", r"see (?:also )?(?:the )?{name}(?: for (?:more )?details)?", 0.8),
    (2, "governed", " by ", r"(?:governed|covered) by (?:the )?(?:terms of (?:the )?)?{name}", 0.8),
    (3, "title", " ", r"{name}", 0.7),
)

#: How notices give a licence by its short name; each way holds "licen".
NOTICE = (
    r"(?:licen[cs]ed under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})(?: licen[cs]e)?"
    r"|under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name}) licen[cs]e"
    r"|licen[cs]es? (?:is |type |name )?(?:the )?(?:{name})|(?:{name}) licen[cs]ed)"
)

#: label, short name as a regular expression over words; versions before families, as the first of equal intervals stays.
SHORT_NAMES = (
    ("mit", r"mit(?: x11| expat)?"),
    ("mit", r"expat"),
    ("x11", r"x11(?: mit)?"),
    ("isc", r"isc"),
    ("apache-2.0", r"apache ?(?:license )?(?:version |v )?2(?: 0)?"),
    ("apache-2.0", r"asl ?2(?: 0)?"),
    ("bsd-2-clause", r"bsd 2(?: clause)?|2 clause bsd|simplified bsd|freebsd"),
    ("bsd-3-clause", r"bsd 3(?: clause)?|3 clause bsd|(?:new|revised|modified) bsd"),
    ("gpl-2.0", r"(?:gnu )?gpl ?(?:version ?|v ?)?2(?: 0)?(?: or later| only)?"),
    ("gpl-3.0", r"(?:gnu )?gpl ?(?:version ?|v ?)?3(?: 0)?(?: or later| only)?"),
    ("lgpl-2.1", r"(?:gnu )?lgpl ?(?:version ?|v ?)?2 1(?: or later| only)?"),
    ("lgpl-3.0", r"(?:gnu )?lgpl ?(?:version ?|v ?)?3(?: 0)?(?: or later| only)?"),
    ("agpl-3.0", r"(?:gnu )?agpl ?(?:version ?|v ?)?3(?: 0)?(?: or later| only)?"),
    ("mpl-2.0", r"mpl ?(?:version ?|v ?)?2(?: 0)?"),
    ("epl-1.0", r"epl ?(?:version ?|v ?)?1(?: 0)?"),
    ("epl-2.0", r"epl ?(?:version ?|v ?)?2(?: 0)?"),
    ("bsl-1.0", r"bsl ?1(?: 0)?"),
    ("zlib", r"zlib(?: libpng)?"),
    ("unlicense", r"(?:the )?unlicense"),
    ("cc0-1.0", r"cc0(?: 1 0)?"),
    ("cc-by-4.0", r"cc by 4(?: 0)?"),
    ("cc-by-sa-4.0", r"cc by sa 4(?: 0)?"),
    ("bsd", r"bsd(?: style)?"),
    ("apache", r"apache"),
    ("gpl", r"(?:gnu )?gpl"),
    ("lgpl", r"(?:gnu )?lgpl"),
    ("agpl", r"(?:gnu )?agpl"),
    ("mpl", r"mpl"),
    ("wtfpl", r"wtfpl"),
)

#: SPDX identifiers (fixed values) as words, and the label if it is not the identifier joined by dashes.
SPDX = """
apache 1 0 = apache-1.0
apache 1 1 = apache-1.1
apache 2 0 = apache-2.0
mit = mit
mit 0 = mit-0
isc = isc
0bsd = 0bsd
bsd 1 clause = bsd-1-clause
bsd 2 clause = bsd-2-clause
bsd 2 clause patent = bsd-2-clause-patent
bsd 3 clause = bsd-3-clause
bsd 3 clause clear = bsd-3-clause-clear
bsd 4 clause = bsd-4-clause
gpl 1 0(?: only| or later)? = gpl-1.0
gpl 2 0(?: only| or later)? = gpl-2.0
gpl 3 0(?: only| or later)? = gpl-3.0
lgpl 2 0(?: only| or later)? = lgpl-2.0
lgpl 2 1(?: only| or later)? = lgpl-2.1
lgpl 3 0(?: only| or later)? = lgpl-3.0
agpl 3 0(?: only| or later)? = agpl-3.0
gfdl 1 1(?: only| or later)? = gfdl-1.1
gfdl 1 2(?: only| or later)? = gfdl-1.2
gfdl 1 3(?: only| or later)? = gfdl-1.3
gpl [23] 0(?: only| or later)? with classpath exception 2 0 = classpath-exception-2.0
gpl [23] 0(?: only| or later)? with gcc exception [23] [01] = gcc-exception
gpl 2 0(?: only| or later)? with linux syscall note = linux-syscall-note
apache 2 0 with llvm exception = llvm-exception
mpl 1 0 = mpl-1.0
mpl 1 1 = mpl-1.1
mpl 2 0 = mpl-2.0
mpl 2 0 no copyleft exception = mpl-2.0-no-copyleft-exception
epl 1 0 = epl-1.0
epl 2 0 = epl-2.0
cddl 1 0 = cddl-1.0
cddl 1 1 = cddl-1.1
cpl 1 0 = cpl-1.0
cpal 1 0 = cpal-1.0
eupl 1 1 = eupl-1.1
eupl 1 2 = eupl-1.2
osl 3 0 = osl-3.0
afl 3 0 = afl-3.0
artistic 1 0 = artistic-1.0
artistic 2 0 = artistic-2.0
bsl 1 0 = bsl-1.0
busl 1 1 = busl-1.1
sspl 1 0 = sspl-1.0
elastic 2 0 = elastic-2.0
zlib = zlib
libpng 2 0 = libpng-2.0
unlicense = unlicense
wtfpl = wtfpl
python 2 0 = python-2.0
psf 2 0 = psf-2.0
php 3 0 = php-3.0
php 3 01 = php-3.01
postgresql = postgresql
openssl = openssl
curl = curl
x11 = x11
ntp = ntp
hpnd = hpnd
ncsa = ncsa
icu = icu
beerware = beerware
blueoak 1 0 0 = blueoak-1.0.0
ofl 1 1 = ofl-1.1
ms pl = ms-pl
ms rl = ms-rl
upl 1 0 = upl-1.0
mulanpsl 2 0 = mulanpsl-2.0
cecill 2 1 = cecill-2.1
cecill b = cecill-b
cecill c = cecill-c
vim = vim
ruby = ruby
w3c = w3c
zpl 2 1 = zpl-2.1
odbl 1 0 = odbl-1.0
odc by 1 0 = odc-by-1.0
pddl 1 0 = pddl-1.0
cdla permissive 2 0 = cdla-permissive-2.0
cc0 1 0 = cc0-1.0
cc by 2 0 = cc-by-2.0
cc by 3 0 = cc-by-3.0
cc by 4 0 = cc-by-4.0
cc by sa 2 0 = cc-by-sa-2.0
cc by sa 3 0 = cc-by-sa-3.0
cc by sa 4 0 = cc-by-sa-4.0
cc by nd 3 0 = cc-by-nd-3.0
cc by nd 4 0 = cc-by-nd-4.0
cc by nc 3 0 = cc-by-nc-3.0
cc by nc 4 0 = cc-by-nc-4.0
cc by nc sa 3 0 = cc-by-nc-sa-3.0
cc by nc sa 4 0 = cc-by-nc-sa-4.0
cc by nc nd 3 0 = cc-by-nc-nd-3.0
cc by nc nd 4 0 = cc-by-nc-nd-4.0
"""

#: Hand-written signatures by (priority, weight): label ; keyword that every match holds ; expression over words.
SIGNATURES = {
    # Sentences that grant or open a licence: bodies and file headers.
    (1, 0.95): r"""
mit ; hereby granted ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit ; without restriction ; to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit ; above copyright notice ; the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit ; in no event ; in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
x11 ; hereby granted ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction (?:[^ ]+ ){1,120}x consortium
x11 ; x consortium ; except as contained in this notice the name of the x consortium shall not be used in advertising
mit-0 ; mit no attribution ; mit no attribution
bsl-1.0 ; hereby granted ; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl-1.0 ; boost ; distributed under the boost software license version 1 0
isc ; hereby granted ; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that
0bsd ; hereby granted ; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)
postgresql ; hereby granted ; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd ; hereby granted ; permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)?(?: is hereby granted)? without fee is hereby granted
ntp ; hereby granted ; permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
curl ; hereby granted ; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied
ncsa ; hereby granted ; developed by (?:[^ ]+ ){1,30}permission is hereby granted free of charge
ncsa ; ncsa ; university of illinois ncsa open source license
icu ; icu license ; icu license icu 1 8 1 and later
upl-1.0 ; universal permissive ; universal permissive license(?: upl)? version 1 0
blueoak-1.0.0 ; blue oak ; blue oak model license version 1 0 0
bsd-3-clause ; neither the name ; neither the names? of (?:[^ ]+ ){1,20}?nor the names of (?:its|the|their) contributors may be used to endorse or promote products derived from this software
bsd-3-clause ; may not be used ; the names? of (?:[^ ]+ ){1,12}?may not be used to endorse or promote products derived from this software without
bsd-3-clause-clear ; patent rights ; no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause ; advertising materials ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause-patent ; each copyright holder ; subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide
apache-1.0 ; apache group ; this product includes software developed by the apache group for use in the apache http server project
apache-1.1 ; apache software foundation ; this product includes software developed by the apache software foundation
apache-2.0 ; terms and conditions ; apache license version 2 0 january 2004(?: https? www apache org licenses)? terms and conditions for use reproduction and distribution
apache-2.0 ; apache license ; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 ; apache org licenses ; you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 ; asf ; licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 ; grant of patent license ; grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
apache-2.0 ; grant of copyright license ; grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
llvm-exception ; llvm exceptions ; apache license v?2 0 with llvm exceptions
gpl-1.0 ; general public license ; gnu general public license version 1 february 1989
gpl-2.0 ; general public license ; gnu general public license version 2 june 1991
gpl-3.0 ; general public license ; gnu general public license version 3 29 june 2007
lgpl-2.0 ; general public license ; gnu library general public license version 2 june 1991
lgpl-2.1 ; general public license ; gnu lesser general public license version 2 1 february 1999
lgpl-3.0 ; general public license ; gnu lesser general public license version 3 29 june 2007
agpl-3.0 ; general public license ; gnu affero general public license version 3 19 november 2007
gpl-1.0 ; free software foundation ; terms of the gnu general public license as published by the free software foundation either version 1
gpl-2.0 ; free software foundation ; terms of the gnu general public license(?: version 2)? as published by the free software foundation(?: either)? version 2(?: of the license)?
gpl-2.0 ; free software foundation ; gnu general public license version 2(?: only)? as published by the free software foundation
gpl-3.0 ; free software foundation ; terms of the gnu general public license as published by the free software foundation(?: either)? version 3(?: of the license)?
lgpl-2.0 ; free software foundation ; terms of the gnu library general public license as published by the free software foundation(?: either)? version 2(?: of the license)?
lgpl-2.1 ; free software foundation ; terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1(?: of the license)?
lgpl-3.0 ; free software foundation ; terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3(?: of the license)?
agpl-3.0 ; free software foundation ; terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3(?: of the license)?
gpl ; are designed to ; the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change(?: it| the works)
lgpl ; general public license ; this license the lesser general public license applies to some specially designated software packages
gpl-3.0 ; conveying ; conveying verbatim copies you may convey verbatim copies of the program s source code as you receive it
gpl-2.0 ; verbatim copies ; you may copy and distribute verbatim copies of the program s source code as you receive it in any medium
agpl-3.0 ; remote network ; remote network interaction use with the gnu general public license
classpath-exception-2.0 ; special exception ; as a special exception the copyright holders of this library give you permission to link this library with independent modules
gcc-exception ; runtime library exception ; gcc runtime library exception
gfdl ; document ; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.1 ; documentation license ; gnu free documentation license version 1 1
mpl-1.1 ; mozilla ; the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 ; mozilla ; the contents of this file are subject to the mozilla public license version 1 0
mpl-2.0 ; mozilla ; this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-2.0 ; mpl ; if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0
mpl-2.0 ; incompatible with secondary ; this source code form is incompatible with secondary licenses as defined by the mozilla public license
epl-1.0 ; eclipse ; made available under the terms of the eclipse public license v(?:ersion)? ?1 0 which accompanies this distribution
epl-2.0 ; eclipse ; made available under the terms of the eclipse public license v(?:ersion)? ?2 0
epl ; accompanying program ; the accompanying program is provided under the terms of this eclipse public license
cpl-1.0 ; accompanying program ; the accompanying program is provided under the terms of this common public license
cddl-1.0 ; common development ; the contents of this file are subject to the terms of the common development and distribution license
cddl-1.1 ; cddl ; cddl version 1 1
eupl ; eupl ; licensed under the eupl
eupl-1.2 ; eupl ; eupl v ?1 2
osl-3.0 ; open software license ; licensed under the open software license version 3 0
afl-3.0 ; academic free ; licensed under the academic free license version 3 0
artistic-1.0 ; artistic ; the artistic license preamble
artistic-2.0 ; artistic ; the artistic license 2 0 copyright
zlib ; held liable ; in no event will the authors be held liable for any damages arising from the use of this software
zlib ; altered source ; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib ; misrepresented ; the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng-2.0 ; png reference ; png reference library license version 2
unlicense ; unencumbered ; this is free and unencumbered software released into the public domain
unlicense ; unlicense ; for more information please refer to https? unlicense org
unlicense ; jurisdictions ; in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
wtfpl ; what the fuck ; you just do what the fuck you want to
wtfpl ; what the fuck ; do what the fuck you want to public license version 2
beerware ; beer ; the beer ware license revision 42
beerware ; beer ; you can buy me a beer in return
cc0-1.0 ; public domain ; the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 ; cc0 ; creative commons cc0 1 0 universal
cc0-1.0 ; affirmer ; affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc-by-4.0 ; creative commons ; creative commons attribution 4 0 international public license
cc-by-sa-4.0 ; creative commons ; creative commons attribution share ?alike 4 0 international public license
cc-by-nc-4.0 ; creative commons ; creative commons attribution non ?commercial 4 0 international public license
cc-by-nd-4.0 ; creative commons ; creative commons attribution no ?derivatives 4 0 international public license
cc-by-nc-sa-4.0 ; creative commons ; creative commons attribution non ?commercial share ?alike 4 0 international public license
cc-by-nc-nd-4.0 ; creative commons ; creative commons attribution non ?commercial no ?derivatives 4 0 international public license
creative-commons ; ccpl ; this creative commons public license ccpl or license
cc-by ; creativecommons ; creativecommons org licenses by [1-4] [05]
cc-by-sa ; creativecommons ; creativecommons org licenses by sa [1-4] [05]
cc-by-nc ; creativecommons ; creativecommons org licenses by nc [1-4] [05]
cc-by-nd ; creativecommons ; creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa ; creativecommons ; creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd ; creativecommons ; creativecommons org licenses by nc nd [1-4] [05]
cc0-1.0 ; creativecommons ; creativecommons org publicdomain zero 1 0
python-2.0 ; psf ; psf license agreement for python
python-2.0 ; psf ; psf hereby grants licensee a nonexclusive royalty free world wide license
php-3.01 ; php license ; this source file is subject to version 3 01 of the php license
php-3.0 ; php license ; this source file is subject to version 3 0 of the php license
openssl ; openssl ; this product includes software developed by the openssl project for use in the openssl toolkit
ofl-1.1 ; open font ; this font software is licensed under the sil open font license version 1 1
ofl-1.1 ; font software ; the font software may not be sold by itself
ms-pl ; microsoft ; microsoft public license ms pl
ms-rl ; microsoft ; microsoft reciprocal license ms rl
busl-1.1 ; business source ; business source license 1 1
sspl-1.0 ; server side public ; server side public license version 1
elastic-2.0 ; elastic license ; elastic license(?: v| version)? ?2(?: 0)?
mulanpsl-2.0 ; mulan ; mulan psl v2
cecill ; cecill ; governed by the cecill(?: [bc])? license under french law
vim ; vim license ; vim license
w3c ; w3c ; w3c software (?:and document )?(?:notice and )?license
zpl-2.1 ; zope ; zope public license zpl version 2 1
odbl-1.0 ; open database ; made available under the open database license
odc-by-1.0 ; open data commons ; open data commons attribution license
pddl-1.0 ; public domain dedication ; open data commons public domain dedication and licen[cs]e
cdla-permissive-2.0 ; community data ; community data license agreement permissive version 2 0
openrail ; rail ; (?:open|bigscience|creativeml) (?:open ?)?rail(?: m| [ms])? licen[cs]e
llama ; community license ; llama [23](?: [0-9])? community license(?: agreement)?
json ; good not evil ; the software shall be used for good not evil
""",
    # Clauses that several licences share, short forms and pointers.
    (2, 0.8): r"""
bsd ; redistribution and use ; redistribution and use in source and binary forms with or without modification are permitted(?: provided that)?
bsd ; redistributions of source ; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd ; redistributions in binary ; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd ; bsd style ; bsd style licen[cs]e(?: that can be found in the license file)?
mit ; mit style ; mit style licen[cs]e
mit ; mit licensed ; mit licensed
mit ; expat license ; expat license
mit ; opensource org ; (?:www )?opensource org licenses mit(?: license)?(?: php)?
apache-2.0 ; opensource org ; (?:www )?opensource org licenses apache 2 0
bsd-2-clause ; opensource org ; (?:www )?opensource org licenses bsd 2 clause
bsd-3-clause ; opensource org ; (?:www )?opensource org licenses bsd 3 clause
isc ; opensource org ; (?:www )?opensource org licenses isc
apache-2.0 ; apache org licenses ; (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 ; apache ; apache 2(?: 0)? licen[cs]ed?
apache-2.0 ; asl ; asl 2 0
apache-2.0 ; alv2 ; alv2
gpl ; gnu org ; (?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?
lgpl ; gnu org ; (?:www )?gnu org (?:licenses|copyleft) lgpl(?: html| txt)?
agpl ; gnu org ; (?:www )?gnu org licenses agpl(?: html| txt)?
gpl-2.0 ; gnu org ; (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0 ; gnu org ; (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
gpl-2.0 ; gplv2 ; gplv2(?: 0)?(?: or later| only)?
gpl-3.0 ; gplv3 ; gplv3(?: 0)?(?: or later| only)?
lgpl-2.1 ; lgplv2 ; lgplv2(?: 1)?(?: or later| only)?
lgpl-3.0 ; lgplv3 ; lgplv3(?: 0)?(?: or later| only)?
agpl-3.0 ; agplv3 ; agplv3(?: 0)?(?: or later| only)?
gpl-2.0 ; gpl 2 ; gpl 2(?: 0)?(?: licen[cs]ed?)?(?: or later| only)?
gpl-3.0 ; gpl 3 ; gpl 3(?: 0)?(?: licen[cs]ed?)?(?: or later| only)?
gpl-2.0 ; gpl v ; gpl v 2(?: 0)?
gpl-2.0 ; gpl v2 ; gpl v2(?: 0)?(?: or later| only)?
gpl-3.0 ; gpl v3 ; gpl v3(?: 0)?(?: or later| only)?
gpl-2.0 ; gpl version ; gpl version 2(?: 0)?(?: or later| only| or any later version)?
gpl-3.0 ; gpl version ; gpl version 3(?: 0)?(?: or later| only| or any later version)?
lgpl-2.1 ; lgpl ; lgpl (?:version |v )?2 1(?: or later| only)?
lgpl-3.0 ; lgpl ; lgpl (?:version |v )?3(?: 0)?(?: or later| only)?
lgpl-3.0 ; lgpl v3 ; lgpl v3(?: 0)?
lgpl-2.1 ; lgpl v2 ; lgpl v2(?: 1)?
agpl-3.0 ; agpl ; agpl (?:version |v )?3(?: 0)?(?: or later| only)?
agpl-3.0 ; agpl v3 ; agpl v3(?: 0)?
gpl ; licence ; gnu general public licence
lgpl ; licence ; gnu lesser general public licence
gpl ; either version ; either version [123] of the license or at your option any later version
gpl ; received a copy ; you should have received a copy of the gnu general public license along with this (?:program|library|software|file|package)
lgpl ; received a copy ; you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software|file|package)
agpl ; received a copy ; you should have received a copy of the gnu affero general public license along with this (?:program|library|software|file|package)
gpl ; merchantability ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
lgpl ; merchantability ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license for more details
mpl-2.0 ; mplv2 ; mplv2(?: 0)?
mpl-2.0 ; mpl 2 ; mpl 2(?: 0)?(?: licen[cs]ed?)?
mpl-1.1 ; mpl 1 ; mpl 1 1(?: gpl 2 0 lgpl 2 1)?
mpl ; mozilla org mpl ; (?:www )?mozilla org mpl
epl-1.0 ; eclipse org ; (?:www )?eclipse org legal epl v10(?: html)?
epl-2.0 ; eclipse org ; (?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?
boost ; boost org ; (?:www )?boost org license 1 0(?: txt)?
cc-by-4.0 ; cc by 4 ; cc by 4 0
cc-by-sa-4.0 ; cc by sa 4 ; cc by sa 4 0
cc-by-sa-3.0 ; cc by sa 3 ; cc by sa 3 0
cc-by-nc ; commercial licen ; attribution non ?commercial licen[cs]e
cc-by-sa ; share ; attribution share ?alike licen[cs]e
cc0-1.0 ; cc0 ; cc0 public domain dedication
public-domain ; public domain ; (?:dedicated|released|placed|contributed|donated) (?:in|in ?to|to) the public domain
public-domain ; public domain ; (?:is|are) in the public domain
public-domain ; public domain ; public domain dedication
dual ; dual licen ; dual licen[cs]ed(?: under)?
dual ; either the ; under either the (?:[^ ]+ ){1,6}?or the (?:[^ ]+ ){1,6}?at your option
license-file ; license file ; (?:see|found in) the license file(?: in the root directory)?(?: for (?:details|more information|the full license text))?
license-file ; copying ; see the (?:file )?copying(?: file)? for (?:more )?(?:details|copying conditions|license terms)
""",
    # Families without a version, and notices of no licence at all.
    (4, 0.5): r"""
gpl ; general public license ; (?:gnu )?general public license
lgpl ; general public license ; (?:gnu )?(?:lesser|library) general public license
agpl ; affero ; (?:gnu )?affero general public license
gfdl ; documentation license ; (?:gnu )?free documentation license
apache ; apache license ; apache license
apache ; apache software license ; apache software license
bsd ; bsd license ; bsd license
bsd ; bsd licen ; bsd licensed
mpl ; mozilla ; mozilla public license
epl ; eclipse ; eclipse public license
cddl ; common development ; common development and distribution license
cc-by ; creative commons ; creative commons attribution(?: license)?
creative-commons ; creative commons ; creative commons(?: licen[cs]ed?)?
public-domain ; public domain ; (?:in|into|to) the public domain
copyleft ; copyleft ; copyleft(?:ed)?(?: licen[cs]e)?
free-software ; free software ; this (?:program|library|software|package) is free software
open-source ; open source license ; (?:an )?(?:osi approved )?open source license
all-rights-reserved ; all rights reserved ; all rights reserved
all-rights-reserved ; alle rechte ; alle rechte vorbehalten
all-rights-reserved ; tous droits ; tous droits réservés
all-rights-reserved ; todos los derechos ; todos los derechos reservados
proprietary ; proprietary ; proprietary and confidential
proprietary ; proprietary ; (?:is|contains) (?:the )?(?:confidential and )?proprietary (?:information|software|property)
proprietary ; unauthorized copying ; unauthorized copying of this file via any medium is strictly prohibited
proprietary ; may not be ; may not be (?:reproduced|copied|distributed)(?: or [a-z]+){0,3} without (?:the )?(?:express |prior ){0,2}written (?:permission|consent)
evaluation-only ; evaluation ; for (?:internal )?evaluation purposes only
non-commercial ; commercial ; for non ?commercial use only
no-derivatives ; derivative ; no derivative works (?:are )?(?:permitted|allowed)
warranty-disclaimer ; without warranty ; (?:is |are )?(?:provided|distributed|supplied) as is(?:,)? without warranty(?: of any kind)?
warranty-disclaimer ; without any warranty ; in the hope that it will be useful but without any warranty
warranty-disclaimer ; merchantability ; implied warranties? of merchantability(?: and| or)?(?: non ?infringement)?(?: fitness for a particular purpose)?
warranty-disclaimer ; as is ; provided as is with(?:out| no) (?:express or implied )?warrant(?:y|ies)
liability-disclaimer ; consequential damages ; (?:indirect )?incidental special exemplary or consequential damages
patent-grant ; patent ; royalty free irrevocable patent license
trademark ; trademark ; does not grant (?:permission|rights) to use the trade names trademarks
copyright-notice ; copyright ; copyright c (?:19|20)[0-9]{2}
copyright-notice ; copyright ; copyright (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
""",
}

#: Any rule's match holds one of these.
ANCHORS = ("licen", "spdx", "cc0", " cc by ", "creative commons", "creativecommons", "public domain", "all rights reserved", "rechte vorbehalten",
           "droits réservés", "derechos reservados", "propriet", "warrant", "bsd", "mit no attribution", "hereby granted", "without restriction",
           "copyright", "in no event", "x consortium", "redistribution", "neither the name", "may not be", "advertising materials", "apache",
           "the software", "special exception", "runtime library", "mpl", "accompanying program", "cddl", "eupl", "misrepresented", "altered source",
           "what the fuck", "beer", "affirmer", "psf", "openssl", "font software", "mulan", "alv2", "asl 2 0", "gnu org", "gpl", "either version",
           "mozilla", "boost org", "eclipse org", "dual ", "copying", "copyleft", "free software", "unauthorized", "evaluation", "commercial use",
           "derivative", "damages", "trademark", "at your option", "held liable", "remote network", "verbatim", "unencumbered", "jurisdictions", "secondary")

LEVELS = 5

Rule = tuple[int, str, str, str, str, float]


#: Stands for the blank before each operand of an SPDX expression but the first.
MARK = "\x01"


def _operand() -> str:
    """An identifier, the longest that fits, or an unknown one of a few words with an operator after it."""
    known = sorted((line.split(" = ")[0] for line in SPDX.strip().split("\n")), key=len, reverse=True)
    return f"(?:(?:{'|'.join(known)})(?= )|[^ ]+(?: (?!or |and |spdx )[^ ]+){{0,5}}?(?= (?:or|and) ))"


def marked(norm: Column) -> Column:
    """norm with MARK for the blank before each later operand of an SPDX expression, however many there are.

    A match goes on where the last one ended, so an expression has no length limit; nothing changes its place.
    """
    step = f"((?<= )spdx license identifiers?|(?!^)\\G (?:or|and)) ({_operand()})"
    both = F.regexp_replace(norm, step, f"$1{MARK}$2")
    return F.when(F.contains(norm, F.lit("spdx license")), F.regexp_replace(both, f"(spdx license identifiers?){MARK}", "$1 ")).otherwise(norm)


def rules() -> list[Rule]:
    """(priority, label, keyword, second keyword, regex, weight), strongest first.

    Identifiers count after an SPDX tag, and within its expression after OR and AND.
    """
    out: list[Rule] = []
    for line in SPDX.strip().split("\n"):
        words, label = line.split(" = ")
        out += [(0, label, "spdx license", " ", f"spdx license identifiers? {words}", 1.0), (0, label, "spdx license", " ", f"(?<={MARK}){words}", 1.0)]
    for (prio, weight), block in SIGNATURES.items():
        for line in block.strip().split("\n"):
            label, kw, rx = line.split(" ; ")
            out.append((prio, label, kw, " ", rx, weight))
    out += [(1, label, "licen", " ", NOTICE.format(name=name), 0.85) for label, name in SHORT_NAMES]
    out += [(prio, label, kw, form_kw, template.format(name=name), weight) for prio, _, form_kw, template, weight in FORMS for label, kw, name in LICENSES]
    return sorted(out, key=lambda r: r[0])


def normalise(text: Column) -> Column:
    """Words (runs of digits, letters and everything beyond ASCII), A-Z in lower case, with a blank on each side."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


RULE = "array<struct<id:int,prio:int,label:string,kw2:string,rx:string,weight:double>>"


def _rule_array(rule_list: list[tuple[int, Rule]]) -> Column:
    """Rules as one literal, which Spark parses once, while it plans."""
    left = lambda rx: rx if rx.startswith(f"(?<={MARK})") else f"(?<= ){rx}"
    return F.from_json(F.lit(json.dumps([
        {"id": i, "prio": p, "label": label, "kw2": kw2, "rx": f"{left(rx)}(?= )", "weight": float(w)} for i, (p, label, _, kw2, rx, w) in rule_list
    ])), RULE)


def _candidates(norm: Column, rule_list: list[Rule]) -> Column:
    """Rules whose keyword stands in the text, of keywords of which some rule matches.

    The alternation of a keyword's rules is one literal, compiled once; single rules run only where it has found something.
    """
    by: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(rule_list):
        by.setdefault(r[2], []).append((i, r))
    none = F.array().cast(RULE)

    def group(kw: str, own: list[tuple[int, Rule]]) -> Column:
        there = F.contains(norm, F.lit(kw))
        if not any(MARK in r[4] for _, r in own):  # later operands match in the marked text alone
            there = there & norm.rlike("(?<= )(?:" + "|".join(dict.fromkeys(r[4] for _, r in own)) + ")(?= )")
        return F.when(there, _rule_array(own)).otherwise(none)

    groups = [group(kw, own) for kw, own in by.items()]
    return F.filter(F.flatten(F.array(*groups)) if groups else none, lambda r: F.contains(norm, r["kw2"]))


def _intervals(norm: Column, marks: Column, rule: Column) -> Column:
    """All matches of a rule as (start, -end, prio, id, label, weight), characters from 0; places are the same in either text."""
    norm = F.when(F.contains(rule["rx"], F.lit(MARK)), marks).otherwise(norm)
    pieces = F.arrays_zip(
        F.split(norm, rule["rx"], -1).alias("a"), F.regexp_extract_all(norm, rule["rx"], F.lit(0)).alias("b")
    )
    kind = "array<struct<start:int,stop:int,prio:int,id:int,label:string,weight:double>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["a"])
        end = start + F.coalesce(F.length(x["b"]), F.lit(0))
        one = F.array(
            F.struct(start.alias("start"), (-end).alias("stop"), rule["prio"].alias("prio"), rule["id"].alias("id"),
                     rule["label"].alias("label"), rule["weight"].alias("weight"))
        )
        return F.struct(end.alias("at"), F.when(x["b"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def _unsuppressed(found: Column) -> Column:
    """Detections in order of start, those inside an interval of the same or a stronger level dropped."""
    kind = "array<struct<start:int,stop:int,prio:int,id:int,label:string,weight:double>>"
    zero = F.struct(F.array(*[F.lit(-1)] * LEVELS).alias("far"), F.array().cast(kind).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["stop"]
        inside = F.array_max(F.slice(acc["far"], F.lit(1), d["prio"] + 1)) >= end
        far = F.transform(acc["far"], lambda e, i: F.when(i == d["prio"], F.greatest(e, end)).otherwise(e))
        return F.struct(far.alias("far"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"))

    return F.aggregate(F.array_sort(found), zero, step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame, text: str = "text", rule_list: list[Rule] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections: the kept intervals (label, priority, rule, start and end in the normalised text, weight).
    """
    rule_list = rules() if rule_list is None else rule_list
    names = ("_norm", "_marked", "_base", "_found", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    src = docs.drop(*[c for c in names if c != text])
    norm = F.col("_norm")
    df = src.withColumn("_norm", normalise(F.col(text))).withColumn("_marked", marked(norm))
    n_words = F.when(F.length(norm) == 2, F.lit(0)).otherwise(_blanks(norm) - 1).cast("long")

    def phrase_places(phrase: str, label: str) -> Column:
        """(label, places, words before the first, words after the last) of one phrase."""
        n = len(phrase.split())
        return F.when(
            F.contains(norm, F.lit(f" {phrase} ")),
            F.transform(
                F.array(F.split(norm, f"(?<= ){phrase}(?= )", -1)),
                lambda p: F.struct(
                    F.lit(label).alias("label"),
                    (F.size(p) - 1).cast("long").alias("n"),
                    (_blanks(F.element_at(p, 1)) - 1).cast("long").alias("first"),
                    (_blanks(F.element_at(p, -1)) - 1 + n).cast("long").alias("rest"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<label:string,n:bigint,first:bigint,rest:bigint>>"))

    anchored = F.lit(False)
    for a in ANCHORS:
        anchored = anchored | F.contains(norm, F.lit(a))
    found = F.when(anchored, F.flatten(F.transform(_candidates(norm, rule_list), lambda r: _intervals(norm, F.col("_marked"), r)))).otherwise(
        F.array().cast("array<struct<start:int,stop:int,prio:int,id:int,label:string,weight:double>>")
    )
    df = df.select(
        *[F.col(f"`{c}`") for c in src.columns],
        n_words.alias("n_words"),
        F.when(F.contains(norm, F.lit(" license ")), F.concat(*[phrase_places(p, x) for p, x in BASE_PHRASES]))
        .otherwise(F.array().cast("array<struct<label:string,n:bigint,first:bigint,rest:bigint>>")).alias("_base"),
        _unsuppressed(found).alias("_found"),
    )
    base, kept = F.col("_base"), F.col("_found")
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    return df.select(
        *[F.col(f"`{c}`") for c in src.columns],
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
        (F.col("n_words") - F.array_min(F.transform(base, lambda b: b["rest"]))).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform(kept, lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform(kept, lambda d: d["weight"])), F.lit(0.0)),
            F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0)),
        ).alias("score"),
        F.transform(
            kept,
            lambda d: F.struct(d["label"].alias("label"), d["prio"].alias("priority"), d["id"].alias("rule"),
                               d["start"].alias("start"), (-d["stop"]).alias("end"), d["weight"].alias("weight")),
        ).alias("detections"),
    )
