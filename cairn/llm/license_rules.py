"""The signature rules of license detection, written by hand.

Patterns are held against texts in lower case whose words (runs of digits, letters and non-ASCII characters) are joined by
single blanks: "Apache-2.0" stands there as "apache 2 0". A pattern matches whole words. `#3` stands for " version 3", " v 3", " v3" or " 3". Each line is `label: pattern`; a
line of its own priority is `= number`. Of two rules with equal priority the earlier one goes first.
"""

from __future__ import annotations

#: Names of licenses. Each is a rule of priority 60, and one of priority 95 behind UNDER.
NAMES = r"""
0bsd: 0bsd|zero clause bsd|bsd zero clause(?: licen[cs]e)?|free public licen[cs]e 1 0 0
afl-3.0: academic free licen[cs]e#3(?: 0)?|afl 3 0
afl-2.1: academic free licen[cs]e#2(?: [01])?|afl 2 [01]
agpl-3.0: agpl#3(?: 0)?(?: or (?:any )?later| only)?|agplv3
agpl-3.0: (?:gnu )?affero general public licen[cs]e(?:#3(?: 0)?)?(?: or (?:any )?later(?: version)?| only)?
apache-1.0: apache(?: software)? licen[cs]e#1 0
apache-1.1: apache(?: software)? licen[cs]e#1 1
apache-2.0: apache(?: software)? licen[cs]e#2(?: 0)?
apache-2.0: apache 2(?: 0)?(?: licen[cs]e)?|asl 2 0|apache v2
apsl-2.0: apple public source licen[cs]e(?:#2(?: 0)?)?
artistic-1.0: artistic licen[cs]e#1(?: 0)?
artistic-2.0: artistic licen[cs]e#2(?: 0)?
beerware: beerware licen[cs]e|beer ware licen[cs]e
bsd-1-clause: bsd 1 clause|1 clause bsd|one clause bsd
bsd-2-clause: bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd licen[cs]e
bsd-3-clause: bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd
bsd-4-clause: bsd 4 clause|4 clause bsd|four clause bsd|original bsd|bsd old
bsd-2-clause-patent: bsd 2 clause(?: plus)? patent
bsd-3-clause-clear: clear bsd licen[cs]e|bsd 3 clause clear
bsd: bsd(?: style| like| type)? licen[cs]e
bsl-1.0: boost software licen[cs]e(?:#1(?: 0)?)?|bsl 1 0
busl-1.1: business source licen[cs]e(?: 1 1)?|busl 1 1
bzip2-1.0.6: bzip2(?: and libbzip2)? licen[cs]e
cal-1.0: cryptographic autonomy licen[cs]e(?: 1 0)?
cc0-1.0: cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?(?: universal)?
cc-by-1.0: cc by 1 0|creative commons attribution 1 0(?: generic)?
cc-by-2.0: cc by 2 0|creative commons attribution 2 0(?: generic)?
cc-by-2.5: cc by 2 5|creative commons attribution 2 5(?: generic)?
cc-by-3.0: cc by 3 0|creative commons attribution 3 0(?: unported)?
cc-by-4.0: cc by 4 0|creative commons attribution 4 0(?: international)?
cc-by: cc by|creative commons attribution(?: (?:international|unported|generic))?
cc-by-sa-2.0: cc by sa 2 0|creative commons attribution share ?alike 2 0(?: generic)?
cc-by-sa-2.5: cc by sa 2 5|creative commons attribution share ?alike 2 5(?: generic)?
cc-by-sa-3.0: cc by sa 3 0|creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa-4.0: cc by sa 4 0|creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa: cc by sa|creative commons attribution share ?alike
cc-by-nc-2.0: cc by nc 2 0|creative commons attribution non ?commercial 2 0(?: generic)?
cc-by-nc-3.0: cc by nc 3 0|creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nc-4.0: cc by nc 4 0|creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc: cc by nc|creative commons attribution non ?commercial
cc-by-nd-3.0: cc by nd 3 0|creative commons attribution no ?deriv(?:ative)?s 3 0(?: unported)?
cc-by-nd-4.0: cc by nd 4 0|creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nd: cc by nd|creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa-3.0: cc by nc sa 3 0|creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-sa-4.0: cc by nc sa 4 0|creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa: cc by nc sa|creative commons attribution non ?commercial share ?alike
cc-by-nc-nd-3.0: cc by nc nd 3 0|creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)?
cc-by-nc-nd-4.0: cc by nc nd 4 0|creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-nd: cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s
cddl-1.0: common development and distribution licen[cs]e(?:#1 0)?|cddl 1 0|cddl
cddl-1.1: common development and distribution licen[cs]e#1 1|cddl 1 1
cecill-1.0: cecill(?: licen[cs]e)?#1(?: 0)?
cecill-2.0: cecill(?: licen[cs]e)?#2 0
cecill-2.1: cecill(?: licen[cs]e)?#2 1
cecill-b: cecill b
cecill-c: cecill c
clarified-artistic: clarified artistic licen[cs]e
cpal-1.0: common public attribution licen[cs]e(?:#1 0)?|cpal 1 0
cpl-1.0: common public licen[cs]e(?:#1 0)?
curl: curl licen[cs]e|mit x derivate licen[cs]e
ecl-2.0: educational community licen[cs]e(?:#2 0)?
elastic-2.0: elastic licen[cs]e(?:#2(?: 0)?)?
epl-1.0: eclipse public licen[cs]e#1(?: 0)?|epl 1 0
epl-2.0: eclipse public licen[cs]e#2(?: 0)?|epl 2 0
epl: eclipse public licen[cs]e
eupl-1.1: european union public licen[cs]e#1 1|eupl#1 1|eupl1 1
eupl-1.2: european union public licen[cs]e(?:#1 2)?|eupl#1 2|eupl1 2
freetype: freetype(?: project)? licen[cs]e
fsl-1.1: functional source licen[cs]e(?:#1 1)?
gfdl-1.1: (?:gnu )?free documentation licen[cs]e#1 1(?: or (?:any )?later(?: version)?| only)?
gfdl-1.2: (?:gnu )?free documentation licen[cs]e#1 2(?: or (?:any )?later(?: version)?| only)?
gfdl-1.3: (?:gnu )?free documentation licen[cs]e#1 3(?: or (?:any )?later(?: version)?| only)?
gfdl: (?:gnu )?free documentation licen[cs]e|gfdl
gpl-1.0: (?:gnu )?general public licen[cs]e#1(?: 0)?(?: or (?:any )?later(?: version)?| only)?
gpl-2.0: (?:gnu )?general public licen[cs]e#2(?: 0)?(?: or (?:any )?later(?: version)?| only)?
gpl-3.0: (?:gnu )?general public licen[cs]e#3(?: 0)?(?: or (?:any )?later(?: version)?| only)?
gpl-2.0: gpl#2(?: 0)?(?: or (?:any )?later| only)?|gplv2
gpl-3.0: gpl#3(?: 0)?(?: or (?:any )?later| only)?|gplv3
gpl: (?:gnu )?general public licen[cs]e|gnu gpl
hpnd: historical permission notice and disclaimer
icu: icu licen[cs]e
ijg: independent jpeg group licen[cs]e|ijg licen[cs]e
imagemagick: imagemagick licen[cs]e
intel: intel open source licen[cs]e
ipl-1.0: ibm public licen[cs]e(?:#1 0)?
isc: isc licen[cs]e|internet systems consortium licen[cs]e
json: json licen[cs]e
lgpl-2.0: (?:gnu )?library general public licen[cs]e(?:#2(?: 0)?)?(?: or (?:any )?later(?: version)?| only)?
lgpl-2.1: (?:gnu )?lesser general public licen[cs]e#2 1(?: or (?:any )?later(?: version)?| only)?
lgpl-3.0: (?:gnu )?lesser general public licen[cs]e#3(?: 0)?(?: or (?:any )?later(?: version)?| only)?
lgpl-2.1: lgpl#2(?: 1)?(?: or (?:any )?later| only)?|lgplv2 1|lgplv2
lgpl-3.0: lgpl#3(?: 0)?(?: or (?:any )?later| only)?|lgplv3
lgpl: (?:gnu )?lesser general public licen[cs]e|gnu lgpl
libpng-2.0: libpng licen[cs]e(?:#2)?|png reference library licen[cs]e
llama2: llama 2 community licen[cs]e
llama3: llama 3(?: [123])? community licen[cs]e
lppl-1.3c: latex project public licen[cs]e(?:#1 3c?)?|lppl
mit: (?:the )?mit licen[cs]e|expat licen[cs]e|mit expat
mit-0: mit 0(?: licen[cs]e)?|mit no attribution(?: licen[cs]e)?
mit-modern: mit licen[cs]e modern variant
mpl-1.0: mozilla public licen[cs]e#1 0|mpl 1 0
mpl-1.1: mozilla public licen[cs]e#1 1|mpl 1 1
mpl-2.0: mozilla public licen[cs]e(?:#2(?: 0)?)?|mpl 2 0
ms-pl: microsoft public licen[cs]e|ms pl
ms-rl: microsoft reciprocal licen[cs]e|ms rl
mulan-psl-2.0: mulan permissive software licen[cs]e(?: v?2)?|mulan psl(?: v?2)
ncsa: (?:university of illinois )?ncsa(?: open source)? licen[cs]e
npl-1.1: netscape public licen[cs]e(?:#1 [01])?
odbl-1.0: open (?:data commons open )?database licen[cs]e(?:#1(?: 0)?)?|odbl
odc-by-1.0: open data commons attribution licen[cs]e(?:#1 0)?|odc by(?: 1 0)?
ofl-1.1: (?:sil )?open font licen[cs]e(?:#1 1)?|ofl 1 1
openldap: openldap public licen[cs]e(?:#2 8)?
openrail: (?:creativeml |bigscience |bigcode )open rail(?: m)?(?: licen[cs]e)?|openrail(?: m)?
openssl: openssl licen[cs]e|ssleay licen[cs]e
osl-3.0: open software licen[cs]e(?:#3 0)?|osl 3 0
pddl-1.0: public domain dedication and licen[cs]e|pddl(?: 1 0)?
php-3.01: php licen[cs]e(?:#3 01)?
polyform-noncommercial: polyform non ?commercial licen[cs]e(?: 1 0 0)?
polyform-small-business: polyform small business licen[cs]e(?: 1 0 0)?
postgresql: postgresql licen[cs]e
psf-2.0: python software foundation licen[cs]e(?:#2(?: 0)?)?|psf licen[cs]e
python-2.0: python licen[cs]e 2 0
qpl-1.0: q public licen[cs]e(?:#1 0)?
ruby: ruby licen[cs]e
sleepycat: sleepycat(?: public)? licen[cs]e
sspl-1.0: server side public licen[cs]e(?:#1(?: 0)?)?|sspl
tcl: tcl tk licen[cs]e
unicode: unicode(?: data files and software)? licen[cs]e(?: v3)?
unlicense: (?:the )?unlicense
upl-1.0: universal permissive licen[cs]e(?:#1 0)?|upl 1 0
vim: vim licen[cs]e
w3c: w3c software(?: and document)?(?: notice and)? licen[cs]e
wtfpl: wtfpl|do what the fuck you want to public licen[cs]e
x11: x11 licen[cs]e|mit x11
zlib: zlib(?: libpng)? licen[cs]e
zpl-2.1: zope public licen[cs]e(?:#2 [01])?
"""

UNDER = "(?:dual |re)?(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|made available) (?:to you )?(?:under|by|subject to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"

#: Sentences and headings of license texts, notices, addresses and tags.
SIGNATURES = r"""
= 100
0bsd: spdx license identifier 0bsd
agpl-3.0: spdx license identifier agpl 3 0(?: only| or later)?
apache-2.0: spdx license identifier apache 2 0
artistic-2.0: spdx license identifier artistic 2 0
bsd-2-clause: spdx license identifier bsd 2 clause
bsd-3-clause: spdx license identifier bsd 3 clause
bsl-1.0: spdx license identifier bsl 1 0
cc0-1.0: spdx license identifier cc0 1 0
cc-by-4.0: spdx license identifier cc by 4 0
cc-by-sa-4.0: spdx license identifier cc by sa 4 0
cddl-1.0: spdx license identifier cddl 1 0
epl-1.0: spdx license identifier epl 1 0
epl-2.0: spdx license identifier epl 2 0
eupl-1.2: spdx license identifier eupl 1 2
gfdl-1.3: spdx license identifier gfdl 1 3(?: only| or later)?
gpl-2.0: spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0: spdx license identifier gpl 3 0(?: only| or later)?
isc: spdx license identifier isc
lgpl-2.1: spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0: spdx license identifier lgpl 3 0(?: only| or later)?
mit: spdx license identifier mit
mit-0: spdx license identifier mit 0
mpl-2.0: spdx license identifier mpl 2 0
ofl-1.1: spdx license identifier ofl 1 1
postgresql: spdx license identifier postgresql
unlicense: spdx license identifier unlicense
wtfpl: spdx license identifier wtfpl
zlib: spdx license identifier zlib
= 94
mit: (?:license|licence) mit
apache-2.0: (?:license|licence) apache 2 0
gpl-3.0: (?:license|licence) gpl 3 0
bsd-3-clause: (?:license|licence) bsd 3 clause
isc: (?:license|licence) isc
mit: license osi approved mit license
apache-2.0: license osi approved apache software license
bsd: license osi approved bsd license
gpl-3.0: license osi approved gnu general public license v3(?: or later)?(?: gplv3)?
lgpl-3.0: license osi approved gnu lesser general public license v3(?: or later)?(?: lgplv3)?
mpl-2.0: license osi approved mozilla public license 2 0(?: mpl 2 0)?
= 92
bsd-3-clause: neither the name of .{1,120}? may be used to endorse or promote products derived from this software
bsd-3-clause: neither the names? of .{1,120}? may be used to endorse or promote products
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
unlicense: this is free and unencumbered software released into the public domain
apache-1.1: the end user documentation included with the redistribution if any must include the following acknowledge?ment
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0: terms and conditions for use reproduction and distribution
agpl-3.0: your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3.0: remote network interaction use with the gnu general public license
lgpl-2.1: a program that contains no derivative of any portion of the library but is designed to work with the library
lgpl-3.0: this version of the gnu lesser general public license incorporates the terms and conditions of version 3
mpl-2.0: this source code form is subject to the terms of the mozilla public license (?:v|version) 2 0
mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
epl-1.0: the accompanying program is provided under the terms of this eclipse public license
epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public license(?: (?:v|version) 2 0)?
cddl-1.0: the contents of this file are subject to the terms of the common development and distribution license
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl-1.0: unless such copies or derivative works are solely in the form of machine executable object code
mit-0: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
= 90
mit: permission is hereby granted free of charge to any person obtaining a copy
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
x11: except as contained in this notice the name of .{1,120}? shall not be used in advertising or otherwise to promote the sale
isc: permission to use copy modify and or distribute this software for any purpose
isc: the author disclaims all warranties with regard to this software
hpnd: permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions of source code must retain the above copyright notice
bsd: redistributions in binary form must reproduce the above copyright notice
bsd: this software is provided by the copyright holders and contributors as is
bsd: this software is provided by the (?:regents|authors?)(?: and contributors)? as is
apache-2.0: licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0: you may not use this file except in compliance with the license
apache-2.0: you may obtain a copy of the license at
apache-2.0: see the license for the specific language governing permissions and limitations under the license
gpl: this program is free software you can redistribute it and or modify it
gpl: redistribute it and or modify it under the terms of the gnu general public license
gpl: you should have received a copy of the gnu general public license along with
gpl: the gnu general public license does not permit incorporating your program into proprietary programs
gpl: this program comes with absolutely no warranty
gpl-2.0: as published by the free software foundation either version 2 of the license
gpl-3.0: as published by the free software foundation either version 3 of the license
gpl-2.0: as published by the free software foundation version 2
gpl-2.0: you may not copy modify sublicense or distribute the program except as expressly provided under this license
gpl-3.0: you may not propagate or modify a covered work except as expressly provided under this license
gpl: when we speak of free software we are referring to freedom not price
lgpl: redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl: you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl-2.0: you should have received a copy of the gnu library general public license
agpl-3.0: redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3.0: you should have received a copy of the gnu affero general public license along with
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl: with no invariant sections no front cover texts and no back cover texts
mpl-2.0: if a copy of the mpl was not distributed with this file
mpl-1.1: software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license
epl-2.0: this program and the accompanying materials are made available
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib: permission is granted to anyone to use this software for any purpose including commercial applications
zlib: the origin of this software must not be misrepresented
zlib: altered source versions must be plainly marked as such
zlib: this notice may not be removed or altered from any source distribution
wtfpl: you just do what the fuck you want to
unlicense: anyone is free to copy modify publish use compile sell or distribute this software
unlicense: we make this dedication for the benefit of the public at large
cc0-1.0: the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0: to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights
cc0-1.0: affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-by: you are free to share copy and redistribute the material in any medium or format
cc-by: you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa: if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc: you may not use the material for commercial purposes
cc-by-nd: if you remix transform or build upon the material you may not distribute the modified material
artistic-2.0: this license establishes the terms under which a given free software package may be copied
artistic-1.0: the intent of this document is to state the conditions under which a package may be copied
ofl-1.1: this font software is licensed under the sil open font license
ofl-1.1: the fonts and derivatives however cannot be released under any other type of license
ofl-1.1: reserved font name
postgresql: in no event shall the university of california be liable to any party for direct indirect special
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
openssl: this product includes cryptographic software written by eric young
psf-2.0: this license agreement is between the python software foundation psf
php-3.01: this product includes php software freely available from
ncsa: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
busl-1.1: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl-1.1: effective on the change date or the fourth anniversary of the first publicly available distribution
sspl-1.0: offering the program as a service
elastic-2.0: you may not provide the software to third parties as a hosted or managed service
json: the software shall be used for good not evil
beerware: if we meet some day and you think this stuff is worth it you can buy me a beer
vim: there are no restrictions on distributing unmodified copies of vim except that they must include this license text
sleepycat: redistributions in any form must be accompanied by information on how to obtain complete source code
eupl-1.2: licensed under the eupl
odbl-1.0: this .{1,80}? is made available under the open database license
unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c: this work is being provided by the copyright holders under the following license
llama2: llama 2 is licensed under the llama 2 community license
openrail: use restrictions you agree not to use the model or derivatives of the model
= 88
apache-2.0: apache org licenses license 2 0
apache-1.1: apache org licenses license 1 1
agpl-3.0: gnu org licenses agpl(?: 3 0)?
gfdl: gnu org (?:licenses|copyleft) fdl(?: 1 [123])?
gpl: gnu org (?:licenses|copyleft) gpl
gpl-2.0: gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0: gnu org licenses gpl 3 0
lgpl: gnu org (?:licenses|copyleft) lgpl
lgpl-2.1: gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0: gnu org licenses lgpl 3 0
mit: opensource org licenses? mit(?: license)?
mit: mit license org
bsd-2-clause: opensource org licenses? bsd 2 clause
bsd-3-clause: opensource org licenses? bsd 3 clause
isc: opensource org licenses? isc
zlib: opensource org licenses? zlib
artistic-2.0: opensource org licenses? artistic(?: license)? 2 0
mpl-2.0: mozilla org mpl 2 0
mpl-1.1: mozilla org mpl(?: mpl)? 1 1
epl-1.0: eclipse org legal epl v10
epl-2.0: eclipse org legal epl 2 0
bsl-1.0: boost org license 1 0
cc0-1.0: creativecommons org publicdomain zero 1 0
cc-by-2.0: creativecommons org licenses by 2 0
cc-by-2.5: creativecommons org licenses by 2 5
cc-by-3.0: creativecommons org licenses by 3 0
cc-by-4.0: creativecommons org licenses by 4 0
cc-by-sa-2.0: creativecommons org licenses by sa 2 0
cc-by-sa-2.5: creativecommons org licenses by sa 2 5
cc-by-sa-3.0: creativecommons org licenses by sa 3 0
cc-by-sa-4.0: creativecommons org licenses by sa 4 0
cc-by-nc-2.0: creativecommons org licenses by nc 2 0
cc-by-nc-3.0: creativecommons org licenses by nc 3 0
cc-by-nc-4.0: creativecommons org licenses by nc 4 0
cc-by-nd-3.0: creativecommons org licenses by nd 3 0
cc-by-nd-4.0: creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0: creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0: creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0: creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0: creativecommons org licenses by nc nd 4 0
odbl-1.0: opendatacommons org licenses odbl
odc-by-1.0: opendatacommons org licenses by
pddl-1.0: opendatacommons org licenses pddl
ofl-1.1: scripts sil org ofl
unlicense: unlicense org
wtfpl: wtfpl net
= 50
public-domain: (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain: public domain(?: dedication)?
copyleft: copyleft
= 45
creative-commons: creative commons licen[cs]e|licensed under creative commons
open-source: (?:released|available) as open source
source-available: source available licen[cs]e
= 40
proprietary: copyright .{0,80}?all rights reserved
proprietary: all rights reserved
proprietary: (?:strictly )?confidential and proprietary
proprietary: unauthorized copying of this file via any medium is strictly prohibited
proprietary: no part of this (?:publication|document|book|work) may be reproduced
proprietary: this software is the proprietary information of
proprietary: for internal use only
non-commercial: for non ?commercial use only
non-commercial: (?:personal|academic|research) use only
= 30
warranty-disclaimer: (?:is provided |distributed )?as is without warranty of any kind
warranty-disclaimer: without even the implied warranty of merchantability or fitness for a particular purpose
warranty-disclaimer: in no event shall .{1,120}? be liable for any
"""


def written() -> list[tuple[str, str, str, int]]:
    """(label, what may stand before, pattern, priority) of every rule, in order."""
    out = []
    for line in NAMES.strip().splitlines():
        label, _, name = line.partition(": ")
        out += [(label, UNDER, name, 95), (label, "", name, 60)]
    priority = 0
    for line in SIGNATURES.strip().splitlines():
        if line.startswith("= "):
            priority = int(line[2:])
        else:
            label, _, pattern = line.partition(": ")
            out.append((label, "", pattern, priority))
    return out
