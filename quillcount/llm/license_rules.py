"""Hand-written license rules.

A line of a table is ``label : pattern``. Patterns are over lower-case words joined by single spaces. Abbreviations in
capitals: V an optional word or letter before a version number, UNDER the words of a grant, LIC license or licence,
GPL and its kin the spellings of a family's name, ANY some words in between. Every match starts and ends with a word.
"""

from __future__ import annotations

import re

_SHORT = {
    "UNDER": r"(?:licen[cs]ed|released|distributed|available|provided|published|offered|shared|covered|redistributed) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:an? )?",
    "LIC": r"licen[cs]e",
    "AGPL": r"(?:(?:gnu )?agpl|(?:gnu )?affero (?:gnu )?(?:gpl|general public LIC))",
    "LGPL": r"(?:(?:gnu )?lgpl|(?:gnu )?(?:lesser|library) (?:gpl|general public LIC))",
    "GFDL": r"(?:(?:gnu )?gfdl|gnu fdl|(?:gnu )?free documentation LIC)",
    "GPL": r"(?:(?:gnu )?gpl|(?:gnu )?general public LIC)",
    "MPL": r"(?:mpl|mozilla public LIC)",
    "EPL": r"(?:epl|eclipse public LIC)",
    "CCL": r"(?:cc|creative commons)",
    "BYSA": r"(?:by sa|attribution share ?alike)",
    "BYNCSA": r"(?:by nc sa|attribution non ?commercial share ?alike)",
    "BYNCND": r"(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)",
    "BYNC": r"(?:by nc|attribution non ?commercial)",
    "BYND": r"(?:by nd|attribution no ?deriv(?:ative)?s?)",
    "BY": r"(?:by|attribution)",
    "V": r"(?:version |ver |v |LIC |LIC version |LIC v )?v?",
    "ANY": r"(?:[^ ]+ ){0,12}?",
}

#: License tags as words; the label is the tag with its marks.
TAGS = """
mit, mit-0, mit-cmu, x11, isc, 0bsd, bsd-1-clause, bsd-2-clause, bsd-2-clause-patent, bsd-3-clause, bsd-3-clause-clear,
bsd-4-clause, bsd-source-code, apache-1.0, apache-1.1, apache-2.0, gpl-1.0-only, gpl-1.0-or-later, gpl-2.0-only,
gpl-2.0-or-later, gpl-3.0-only, gpl-3.0-or-later, gpl-1.0, gpl-2.0, gpl-3.0, lgpl-2.0-only, lgpl-2.0-or-later, lgpl-2.1-only,
lgpl-2.1-or-later, lgpl-3.0-only, lgpl-3.0-or-later, lgpl-2.0, lgpl-2.1, lgpl-3.0, agpl-1.0, agpl-3.0-only, agpl-3.0-or-later, agpl-3.0,
gfdl-1.1, gfdl-1.2, gfdl-1.3, mpl-1.0, mpl-1.1, mpl-2.0, epl-1.0, epl-2.0, cddl-1.0, cddl-1.1, cpl-1.0, eupl-1.1, eupl-1.2,
artistic-1.0, artistic-2.0, bsl-1.0, busl-1.1, sspl-1.0, zlib, libpng-2.0, psf-2.0, python-2.0, php-3.0, php-3.01, ruby, postgresql,
openssl, ncsa, ofl-1.1, odbl-1.0, odc-by-1.0, pddl-1.0, wtfpl, unlicense, beerware, cc0-1.0, cc-by-1.0, cc-by-2.0, cc-by-2.5, cc-by-3.0,
cc-by-4.0, cc-by-sa-2.0, cc-by-sa-2.5, cc-by-sa-3.0, cc-by-sa-4.0, cc-by-nc-2.0, cc-by-nc-3.0, cc-by-nc-4.0, cc-by-nd-3.0, cc-by-nd-4.0,
cc-by-nc-sa-2.0, cc-by-nc-sa-3.0, cc-by-nc-sa-4.0, cc-by-nc-nd-3.0, cc-by-nc-nd-4.0, ecl-2.0, efl-2.0, afl-3.0, osl-3.0, ms-pl, ms-rl,
mulanpsl-2.0, blueoak-1.0.0, unicode-dfs-2016, vim, w3c, curl, hpnd, ijg, icu, intel, json, ftl, lppl-1.3c, cecill-2.1, cecill-b, cecill-c,
elastic-2.0, polyform-noncommercial-1.0.0, polyform-small-business-1.0.0, upl-1.0, zpl-2.1, sleepycat, tcl, qpl-1.0, naist-2003, nposl-3.0
"""

#: Names of licenses.
NAMES = r"""
mit : mit LIC
mit : mit (?:expat|x11) LIC
mit : the expat LIC
mit : mit style LIC
mit : (?:LIC|licen[cs]ing) (?:is )?mit
mit-0 : mit no attribution LIC
mit-0 : mit 0 LIC
x11 : x11 LIC
isc : isc LIC
isc : internet systems consortium LIC
0bsd : (?:zero clause|0 clause) bsd(?: LIC)?
0bsd : 0bsd(?: LIC)?
0bsd : free public LIC 1 0 0
bsd-1-clause : (?:1|one) clause bsd(?: LIC)?
bsd-2-clause : (?:2|two) clause bsd(?: LIC)?
bsd-2-clause : bsd (?:2|two) clause(?: LIC)?
bsd-2-clause : (?:simplified|freebsd) bsd LIC
bsd-2-clause : simplified bsd
bsd-3-clause : (?:3|three) clause bsd(?: LIC)?
bsd-3-clause : bsd (?:3|three) clause(?: LIC)?
bsd-3-clause : (?:new|modified|revised) bsd(?: LIC)?
bsd-3-clause-clear : clear bsd LIC
bsd-4-clause : (?:4|four) clause bsd(?: LIC)?
bsd-4-clause : bsd (?:4|four) clause(?: LIC)?
bsd-4-clause : original bsd(?: LIC)?
bsd : bsd(?: style| type)? LIC
bsd : berkeley software distribution LIC
apache-1.0 : apache (?:software )?V1 0
apache-1.1 : apache (?:software )?V1 1
apache-2.0 : apache (?:software )?V2(?: 0)?
apache-2.0 : apache (?:software )?LIC (?:version )?2(?: 0)?
apache-2.0 : asl2(?: 0)?
apache-2.0 : asl (?:version )?2 0
apache-2.0 : apache2 LIC
apache : apache (?:software )?LIC
gpl-1.0 : GPL V1(?: 0)?
gpl-2.0 : GPL V2(?: 0)?
gpl-2.0 : gplv2
gpl-2.0-or-later : GPL V2(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-2.0-or-later : gplv2 or (?:any )?later
gpl-3.0 : GPL V3(?: 0)?
gpl-3.0 : gplv3
gpl-3.0-or-later : GPL V3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-3.0-or-later : gplv3 or (?:any )?later
gpl : gnu gpl
gpl : gpl LIC
gpl : gnu general public LIC
gpl : general public licence
lgpl-2.0 : LGPL V2(?: 0)?
lgpl-2.1 : LGPL V2 1
lgpl-2.1-or-later : LGPL V2 1 or (?:any )?later(?: version)?
lgpl-3.0 : LGPL V3(?: 0)?
lgpl-3.0 : lgplv3
lgpl-3.0-or-later : LGPL V3(?: 0)? or (?:any )?later(?: version)?
lgpl : gnu lgpl
lgpl : lgpl LIC
lgpl : (?:gnu )?(?:lesser|library) general public LIC
agpl-1.0 : AGPL V1(?: 0)?
agpl-3.0 : AGPL V3(?: 0)?
agpl-3.0 : agplv3
agpl-3.0-or-later : AGPL V3(?: 0)? or (?:any )?later(?: version)?
agpl : gnu agpl
agpl : agpl LIC
agpl : (?:gnu )?affero general public LIC
gfdl-1.1 : GFDL V1 1
gfdl-1.2 : GFDL V1 2
gfdl-1.3 : GFDL V1 3
gfdl : GFDL
mpl-1.0 : MPL V1 0
mpl-1.1 : MPL V1 1
mpl-2.0 : MPL V2(?: 0)?
mpl : mozilla public LIC
mpl : mpl LIC
npl-1.1 : netscape public LIC(?: V1 1)?
epl-1.0 : EPL V1(?: 0)?
epl-2.0 : EPL V2(?: 0)?
epl : eclipse public LIC
edl-1.0 : eclipse distribution LIC(?: V1 0)?
cddl-1.0 : (?:cddl|common development and distribution LIC) V1 0
cddl-1.1 : (?:cddl|common development and distribution LIC) V1 1
cddl : common development and distribution LIC
cpl-1.0 : common public LIC(?: V1 0)?
cpal-1.0 : common public attribution LIC(?: V1 0)?
ipl-1.0 : ibm public LIC(?: V1 0)?
eupl-1.1 : (?:eupl|european union public LIC) V1 1
eupl-1.2 : (?:eupl|european union public LIC) V1 2
eupl : european union public LIC
eupl : eupl LIC
osl-3.0 : open software LIC V3 0
osl : open software LIC
afl-3.0 : academic free LIC V3 0
afl : academic free LIC
ecl-2.0 : educational community LIC(?: V2 0)?
efl-2.0 : eiffel forum LIC(?: V2)?
artistic-1.0 : artistic LIC V1 0
artistic-2.0 : artistic LIC V2(?: 0)?
artistic-2.0 : perl artistic LIC 2(?: 0)?
artistic : (?:perl )?artistic LIC
bsl-1.0 : boost software LIC(?: V1 0)?
bsl-1.0 : boost LIC V1 0
busl-1.1 : business source LIC(?: V1 1)?
sspl-1.0 : server side public LIC(?: V1)?
elastic-2.0 : elastic LIC V2(?: 0)?
elastic : elastic LIC
commons-clause : commons clause(?: LIC)?(?: condition)?
polyform-noncommercial-1.0.0 : polyform noncommercial LIC(?: V1 0 0)?
polyform-small-business-1.0.0 : polyform small business LIC(?: V1 0 0)?
polyform-strict-1.0.0 : polyform strict LIC(?: V1 0 0)?
zlib : zlib(?: libpng)? LIC
libpng : libpng LIC
psf-2.0 : python software foundation LIC(?: V2)?
psf-2.0 : psf LIC(?: V2)?
python-2.0 : python LIC(?: V2 0)?
php-3.0 : php LIC V3 0
php-3.01 : php LIC(?: V3 01)?
zend-2.0 : zend engine LIC
ruby : ruby LIC
postgresql : postgresql LIC
openssl : openssl(?: ssleay)? LIC
ncsa : (?:ncsa|university of illinois(?: ncsa)?)(?: open source)? LIC
ofl-1.1 : (?:sil )?open font LIC(?: V1 1)?
ofl-1.1 : sil ofl
odbl-1.0 : open (?:data commons open )?database LIC(?: V1 0)?
odc-by-1.0 : open data commons attribution LIC
pddl-1.0 : (?:open data commons )?public domain dedication and LIC
cdla-permissive : community data LIC agreement permissive
cdla-sharing : community data LIC agreement sharing
ogl-uk-3.0 : open government LIC(?: V3 0)?
etalab-2.0 : (?:etalab|licence ouverte)(?: open LIC)?(?: V2 0)?
dl-de : datenlizenz deutschland
wtfpl : wtfpl(?: LIC)?
wtfpl : do what the fuck you want to public LIC
unlicense : (?:the )?unlicense(?: LIC)?
beerware : beer ware LIC
beerware : beerware LIC
cc0-1.0 : cc0(?: 1 0)?(?: universal)?
cc0-1.0 : creative commons (?:zero|cc0)(?: 1 0)?
cc-by-4.0 : CCL BY 4 0
cc-by-3.0 : CCL BY 3 0
cc-by-2.5 : CCL BY 2 5
cc-by-2.0 : CCL BY 2 0
cc-by : creative commons BY
cc-by : cc by LIC
cc-by-sa-4.0 : CCL BYSA 4 0
cc-by-sa-3.0 : CCL BYSA 3 0
cc-by-sa-2.5 : CCL BYSA 2 5
cc-by-sa-2.0 : CCL BYSA 2 0
cc-by-sa : CCL BYSA
cc-by-nc-4.0 : CCL BYNC 4 0
cc-by-nc-3.0 : CCL BYNC 3 0
cc-by-nc-2.0 : CCL BYNC 2 0
cc-by-nc : CCL BYNC
cc-by-nd-4.0 : CCL BYND 4 0
cc-by-nd-3.0 : CCL BYND 3 0
cc-by-nd-2.0 : CCL BYND 2 0
cc-by-nd : CCL BYND
cc-by-nc-sa-4.0 : CCL BYNCSA 4 0
cc-by-nc-sa-3.0 : CCL BYNCSA 3 0
cc-by-nc-sa-2.0 : CCL BYNCSA 2 0
cc-by-nc-sa : CCL BYNCSA
cc-by-nc-nd-4.0 : CCL BYNCND 4 0
cc-by-nc-nd-3.0 : CCL BYNCND 3 0
cc-by-nc-nd-2.0 : CCL BYNCND 2 0
cc-by-nc-nd : CCL BYNCND
creative-commons : creative commons LIC
ms-pl : (?:microsoft public|ms pl) LIC
ms-pl : microsoft public LIC
ms-rl : microsoft reciprocal LIC
mulanpsl-2.0 : mulan psl V2
mulanpsl-2.0 : mulan permissive software LIC(?: V2)?
blueoak-1.0.0 : blue oak model LIC(?: 1 0 0)?
unicode : unicode (?:data files and software )?LIC
vim : vim LIC
w3c : w3c (?:software (?:and document )?)?(?:notice and )?LIC
curl : curl LIC
hpnd : historical permission notice and disclaimer
ijg : independent jpeg group(?: s)? LIC
icu : icu LIC
json : json LIC
ftl : freetype (?:project )?LIC
lppl : latex project public LIC
lppl : lppl LIC
cecill-2.1 : cecill (?:free software )?LIC(?: V2 1)?
cecill-b : cecill b(?: LIC)?
cecill-c : cecill c(?: LIC)?
upl-1.0 : universal permissive LIC(?: V1 0)?
zpl-2.1 : zope public LIC(?: V2 1)?
sleepycat : sleepycat LIC
tcl : tcl(?: tk)? LIC
qpl-1.0 : q public LIC(?: V1 0)?
rpl-1.5 : reciprocal public LIC(?: V1 5)?
cua-opl-1.0 : cua office public LIC
lucent-1.02 : lucent public LIC(?: V1 02)?
apsl-2.0 : apple public source LIC(?: V2 0)?
sun-bcl : sun binary code LIC agreement
oracle-bcl : oracle binary code LIC agreement
openrail : (?:open )?rail m? ?LIC
bigscience-rail-1.0 : bigscience rail LIC(?: V1 0)?
creativeml-openrail-m : creativeml open rail m
llama-community : llama (?:[0-9]+ )*community LIC
hippocratic : hippocratic LIC
ethical-source : anti 996 LIC
coil : copyfree open innovation LIC
opl-1.0 : open publication LIC(?: V1 0)?
eula : end user LIC agreement
proprietary : proprietary (?:software )?LIC
commercial : commercial LIC (?:agreement|required)
"""

#: Grants: a license is named as the one that applies.
GRANTS = r"""
mit : UNDERmit (?:x11 |expat )?LIC
mit : licen[cs]ed (?:under|by|with) (?:the )?(?:terms of (?:the )?)?mit
isc : UNDERisc LIC
isc : licen[cs]ed (?:under|by|with) (?:the )?(?:terms of (?:the )?)?isc
bsd : UNDERbsd(?: style)?(?: LIC)?
bsd-2-clause : UNDER(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: LIC)?
bsd-3-clause : UNDER(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: LIC)?
apache-2.0 : UNDERapache (?:software )?V2(?: 0)?(?: LIC)?
apache : UNDERapache(?: software)?(?: foundation)? LIC
gpl : UNDERGPL
gpl-2.0 : UNDERGPL V2(?: 0)?(?: LIC)?
gpl-2.0-or-later : UNDERGPL V2(?: 0)? or (?:any )?later
gpl-3.0 : UNDERGPL V3(?: 0)?(?: LIC)?
gpl-3.0-or-later : UNDERGPL V3(?: 0)? or (?:any )?later
gpl-2.0 : UNDERversion 2 (?:only )?of the GPL
gpl-3.0 : UNDERversion 3 (?:only )?of the GPL
lgpl : UNDERLGPL
lgpl-2.1 : UNDERLGPL V2 1(?: LIC)?
lgpl-3.0 : UNDERLGPL V3(?: 0)?(?: LIC)?
agpl : UNDERAGPL
agpl-3.0 : UNDERAGPL V3(?: 0)?(?: LIC)?
gfdl : UNDERGFDL
mpl : UNDERMPL
mpl-2.0 : UNDERMPL V2(?: 0)?
epl : UNDEREPL
epl-2.0 : UNDEREPL V2(?: 0)?
cddl : UNDERcddl(?: LIC)?
artistic : UNDER(?:perl )?artistic LIC
artistic : UNDERsame terms as perl(?: itself)?
zlib : UNDERzlib(?: libpng)? LIC
zlib : licen[cs]ed (?:under|by|with) (?:the )?(?:terms of (?:the )?)?zlib
bsl-1.0 : UNDERboost(?: software)? LIC
ofl-1.1 : UNDER(?:sil )?(?:ofl|open font LIC)
cc0-1.0 : UNDER(?:creative commons )?cc0
cc-by : UNDERCCL BY(?: LIC)?
cc-by-4.0 : UNDERCCL BY(?: international)? 4 0(?: international)?(?: LIC)?
cc-by-sa : UNDERCCL BYSA(?: LIC)?
cc-by-sa-4.0 : UNDERCCL BYSA(?: international)? 4 0(?: international)?(?: LIC)?
cc-by-nc : UNDERCCL BYNC(?: LIC)?
cc-by-nc-4.0 : UNDERCCL BYNC(?: international)? 4 0(?: international)?(?: LIC)?
cc-by-nc-sa-4.0 : UNDERCCL BYNCSA(?: international)? 4 0(?: international)?(?: LIC)?
cc-by-nc-nd-4.0 : UNDERCCL BYNCND(?: international)? 4 0(?: international)?(?: LIC)?
creative-commons : UNDERcreative commons LIC
unlicense : UNDERunlicense
proprietary : UNDERproprietary LIC
dual : dual licen[cs]ed under
"""

#: Phrases of licenses' own texts and of the notices they ask for.
TEXTS = r"""
mit : permission is hereby granted free of charge to any person obtaining a copy of this software
mit : the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0 : permission is hereby granted free of charge ANYwithout restriction ANYsubject to no conditions
isc : permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd : permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
bsd : redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause : redistributions in binary form must reproduce the above copyright notice
bsd-3-clause : neither the name of ANY(?:nor the names of )?its contributors may be used to endorse
bsd-4-clause : all advertising materials mentioning features or use of this software must display
apache-2.0 : licensed under the apache LIC version 2 0 the LIC you may not use this file except in compliance
apache-2.0 : apache LIC version 2 0 january 2004
apache-2.0 : you may obtain a copy of the LIC at http www apache org licenses LIC 2 0
apache-1.1 : this product includes software developed by the apache software foundation
gpl : free software you can redistribute it and or modify it under the terms of the gnu general public LIC
gpl-2.0 : gnu general public LIC ANYeither version 2 of the LIC
gpl-3.0 : gnu general public LIC ANYeither version 3 of the LIC
gpl-2.0-or-later : gnu general public LIC ANYeither version 2 of the LIC or (?:at your option )?any later version
gpl-3.0-or-later : gnu general public LIC ANYeither version 3 of the LIC or (?:at your option )?any later version
gpl-2.0 : gnu general public LIC version 2 june 1991
gpl-3.0 : gnu general public LIC version 3 29 june 2007
gpl : you should have received a copy of the gnu general public LIC
gpl : without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public LIC
lgpl : under the terms of the gnu (?:lesser|library) general public LIC
lgpl : you should have received a copy of the gnu (?:lesser|library) general public LIC
lgpl-2.1 : gnu lesser general public LIC version 2 1 february 1999
lgpl-3.0 : gnu lesser general public LIC version 3 29 june 2007
agpl : under the terms of the gnu affero general public LIC
agpl : you should have received a copy of the gnu affero general public LIC
agpl-3.0 : gnu affero general public LIC version 3 19 november 2007
gfdl : permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
mpl-1.1 : subject to the mozilla public LIC version 1 1
mpl-2.0 : subject to the terms of the mozilla public LIC v 2 0
mpl-2.0 : if a copy of the mpl was not distributed with this file
epl-1.0 : accompanying materials are made available under the terms of the eclipse public LIC v1 0
epl-2.0 : accompanying materials are made available under the terms of the eclipse public LIC (?:v )?2 0
cddl-1.0 : subject to the terms of the common development and distribution LIC
artistic-2.0 : the artistic LIC 2 0 copyright
bsl-1.0 : permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
busl-1.1 : the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
zlib : this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib : altered source versions must be plainly marked as such
libpng : the png reference library is supplied as is
unlicense : this is free and unencumbered software released into the public domain
unlicense : anyone is free to copy modify publish use compile sell or distribute this software
wtfpl : everyone is permitted to copy and distribute verbatim or modified copies of this LIC document and changing it is allowed
beerware : you can buy me a beer in return
cc0-1.0 : waived all copyright and related or neighboring rights
cc0-1.0 : to the extent possible under law ANYhas waived all copyright
creative-commons : this work is licensed under a creative commons
ofl-1.1 : this font software is licensed under the sil open font LIC
openssl : this product includes software developed by the openssl project
psf-2.0 : this LIC agreement is between the python software foundation
php-3.01 : this product includes php software freely available
postgresql : permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
ncsa : to deal with the software without restriction including without limitation
curl : copyright (?:c )?ANYdaniel stenberg
ijg : this software is based in part on the work of the independent jpeg group
ftl : portions of this software are copyright ANYthe freetype project
ms-pl : this LIC governs use of the accompanying software if you use the software you accept this LIC
upl-1.0 : subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software
json : the software shall be used for good not evil
public-domain : (?:released|placed|put|donated) (?:in|into|to) the public domain
public-domain : dedicated to the public domain
public-domain : (?:is|are) (?:hereby )?in the public domain
public-domain : public domain software
public-domain : no copyright is claimed
proprietary : all rights reserved
proprietary : all rights reserved unauthori[sz]ed (?:copying|use|reproduction|distribution)
proprietary : unauthori[sz]ed copying of this file
proprietary : confidential and proprietary
proprietary : proprietary and confidential
proprietary : may not be (?:reproduced|copied|distributed|used) ANYwithout (?:the )?(?:prior )?(?:express )?(?:written )?permission
commercial : for non ?commercial use only
commercial : free for non ?commercial use
evaluation : for evaluation purposes only licen[cs]e
"""

#: Every match of a rule or a base phrase holds one of these words.
GATES = tuple(
    """
    license licence licensed licenced licenses licences licensing licencing unlicense lizenz datenlizenz spdx granted permission
    permitted redistribution redistributions contributors advertising unencumbered domain copyright reserved warranty gpl gplv2
    gplv3 lgpl lgplv3 agpl agplv3 gnu apache apache2 asl asl2 bsd 0bsd mozilla mpl eclipse epl cddl eupl creative cc cc0 ofl fdl gfdl
    clause etalab wtfpl cecill mulan altered png anyone beer beerware openssl php restriction jpeg freetype evil proprietary
    unauthorised unauthorized commercial noncommercial rail historical
    perl licensor
    """.split()
)

#: Where a pattern has one of these abbreviations, one of the words stands in every match.
_FAMILY = {
    "AGPL": ("agpl", "affero"),
    "LGPL": ("lgpl", "lesser", "library"),
    "GFDL": ("fdl", "gfdl", "documentation"),
    "GPL": ("gpl", "general"),
    "MPL": ("mpl", "mozilla"),
    "EPL": ("epl", "eclipse"),
    "CCL": ("cc", "creative"),
}


def _expanded(pattern: str) -> str:
    pattern = pattern.replace("UNDER", _SHORT["UNDER"])
    for _ in range(2):  # an abbreviation may stand in another's words
        for short, full in _SHORT.items():
            pattern = re.sub(rf"(?<![A-Za-z]){short}(?![A-Z])", lambda m, full=full: full, pattern)
    return pattern


def _literal(pattern: str) -> str:
    """The longest word of a pattern without groups that every match holds, or nothing."""
    return max((w for w in pattern.split(" ") if re.fullmatch("[a-z0-9]{2,}", w)), key=len, default="")


def _alternatives(group: str) -> list[str]:
    """What stands between the bars of a group, bars of groups inside it aside."""
    out, depth = [""], 0
    for c in group:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def _keywords(pattern: str) -> tuple[str, ...]:
    """Words, one of which every match of an unexpanded pattern holds."""
    pattern = pattern.replace("UNDER", "A ")
    for short, words in _FAMILY.items():
        if re.search(rf"(?<![A-Z]){short}(?![A-Z])", pattern):
            return words
    flat, groups, depth = "", [], 0  # flat has \x00 for a group, with the spaces that all its alternatives start or end with
    for c in pattern:
        depth += c == "("
        if depth == 0:
            flat += c
        elif depth == 1 and c == "(":
            groups.append("")
        else:
            groups[-1] += c
        depth -= c == ")"
        if c == ")" and depth == 0:
            inside = _alternatives(groups[-1][2:-1])
            flat += " " * all(w[:1] == " " for w in inside) + "\x00" + " " * all(w[-1:] == " " for w in inside)
    needed = [not re.match(r" ?[?*]", flat[m.end() :]) for m in re.finditer("\x00", flat)]
    word = _literal(re.sub("(?<=\x00)( ?)[?*]", r"\1", flat))
    if word:
        return (word,)
    for group, always in zip(groups, needed, strict=True):
        words = tuple(_literal(re.sub(r"\([^()]*\)\??", "\x00", w)) for w in _alternatives(group[2:-1]))
        if always and all(words):
            return words
    raise ValueError(pattern)


def rules() -> list[tuple[str, str, tuple[str, ...], int, float]]:
    """(label, pattern, keywords, priority, score): tags 4, texts 3, grants 2, names 1."""
    tags = "\n".join(f"{t} : spdx license identifier {re.sub(r'[-.]', ' ', t)}" for t in re.split(r",\s*", TAGS.strip()))
    out = []
    for table, priority, score in ((tags, 4, 1.0), (TEXTS, 3, 0.95), (GRANTS, 2, 0.9), (NAMES, 1, 0.7)):
        for line in table.strip().splitlines():
            label, pattern = line.split(" : ", 1)
            out.append((label, rf"(?<![^ ])(?:{_expanded(pattern)})(?![^ ])", _keywords(pattern), priority, score))
    return out
