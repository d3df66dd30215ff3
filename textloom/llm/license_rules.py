"""Signature rules of the licence scan, in order: label, priority, keyword, regex.

Regexes are written by hand on normalized words (lower-case a-z, digits and non-ASCII, one space between words).
The keyword must be in the text before the regex is tried. Priorities: 4 licence tags and identifiers, 3 sentences
of licence texts, 2 notices and names with versions, 1 bare names and clues.
"""

RULES = tuple(
    tuple(part.strip() for part in line.split("|", 3))
    for line in r"""
mit | 4 | spdx | spdx license identifier mit
mit | 3 | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | 3 | without restriction | deal in the software without restriction including without limitation the rights
mit | 3 | copyright notice | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies
mit | 2 | mit license | (?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?mit license
mit | 2 | mit license | under the terms of the mit license
mit | 2 | mit license | see the mit license for (?:more )?details
mit | 2 | mit licence | (?:under )?the mit licence
mit | 2 | opensource org | opensource org licenses mit(?: license)?(?: php| html)?
mit | 1 | mit license | (?:the )?mit license
mit | 1 | expat | (?:the )?expat license
mit-0 | 4 | spdx | spdx license identifier mit 0
mit-0 | 2 | no attribution | mit no attribution(?: license)?
x11 | 4 | spdx | spdx license identifier x11
x11 | 3 | x consortium | except as contained in this notice the name of the x consortium shall not be used
x11 | 2 | x11 | (?:the )?(?:mit )?x11 license
isc | 4 | spdx | spdx license identifier isc
isc | 3 | permission to use copy modify | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc license | (?:under |released under )?(?:the )?(?:terms of the )?isc license
0bsd | 4 | spdx | spdx license identifier 0bsd
0bsd | 2 | zero clause | (?:bsd )?zero clause (?:bsd )?license
apache-2.0 | 4 | spdx | spdx license identifier apache 2 0
apache-2.0 | 3 | apache license | licensed under the apache license version 2 0 the license
apache-2.0 | 3 | in compliance with the license | you may not use this (?:file|work|software) except in compliance with the license
apache-2.0 | 3 | applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 3 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | 2 | apache | apache license version 2(?: 0)?
apache-2.0 | 2 | apache | apache license 2(?: 0)?
apache-2.0 | 2 | apache | apache software license (?:version )?2(?: 0)?
apache-2.0 | 2 | apache | apache 2(?: 0)? license
apache-2.0 | 2 | apache org | apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 1 | apache | apache v?2(?: 0)?
apache-1.1 | 4 | spdx | spdx license identifier apache 1 1
apache-1.1 | 2 | apache | apache (?:software )?license (?:version )?1 1
apache-1.0 | 4 | spdx | spdx license identifier apache 1 0
apache-1.0 | 2 | apache | apache (?:software )?license (?:version )?1 0
apache | 1 | apache | (?:the )?apache (?:software )?license
apache-1.1 | 3 | apache | this product includes software developed by the apache software foundation
gpl-1.0 | 4 | spdx | spdx license identifier gpl 1 0(?: only)?
gpl-1.0-plus | 4 | spdx | spdx license identifier gpl 1 0 or later
gpl-2.0 | 4 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-plus | 4 | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0 | 4 | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-plus | 4 | spdx | spdx license identifier gpl 3 0 or later
gpl-2.0-plus | 3 | general public license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-plus | 3 | general public license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0 | 3 | general public license | gnu general public license version 2 as published by the free software foundation
gpl-3.0 | 3 | general public license | gnu general public license version 3 as published by the free software foundation
gpl | 3 | general public license | you should have received a copy of the gnu general public license along with this program
gpl | 3 | fitness for a particular purpose | without even the implied warranty of merchantability or fitness for a particular purpose
gpl-2.0-plus | 2 | general public license | (?:gnu )?general public license (?:version )?v?2 (?:0 )?or (?:any )?later(?: version)?
gpl-3.0-plus | 2 | general public license | (?:gnu )?general public license (?:version )?v?3 (?:0 )?or (?:any )?later(?: version)?
gpl-1.0 | 2 | general public license | (?:gnu )?general public license (?:version )?v?1(?: 0)?
gpl-2.0 | 2 | general public license | (?:gnu )?general public license (?:version )?v?2(?: 0)?
gpl-3.0 | 2 | general public license | (?:gnu )?general public license (?:version )?v?3(?: 0)?
gpl-2.0 | 2 | gpl | (?:gnu )?gpl (?:version )?v?2(?: 0)?(?: only)?
gpl-3.0 | 2 | gpl | (?:gnu )?gpl (?:version )?v?3(?: 0)?(?: only)?
gpl-2.0-plus | 2 | gpl | (?:gnu )?gpl (?:version )?v?2(?: 0)? or later
gpl-3.0-plus | 2 | gpl | (?:gnu )?gpl (?:version )?v?3(?: 0)? or later
gpl-2.0 | 2 | gplv2 | (?:gnu )?gplv2(?: only)?
gpl-3.0 | 2 | gplv3 | (?:gnu )?gplv3(?: only)?
gpl-2.0-plus | 2 | gplv2 | (?:gnu )?gplv2 or later
gpl-3.0-plus | 2 | gplv3 | (?:gnu )?gplv3 or later
gpl | 2 | gnu org | gnu org licenses gpl(?: html| txt| 2 0| 3 0)?
gpl | 1 | gnu general public | (?:the )?gnu general public license
gpl | 1 | gpl | (?:under )?(?:the )?gpl license
gpl | 1 | gnu gpl | gnu gpl
gpl-classpath | 3 | linking this library | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-classpath | 2 | classpath exception | (?:with )?(?:the )?classpath exception
gpl-gcc-exception | 2 | runtime library exception | gcc runtime library exception(?: version 3 1)?
lgpl-2.0 | 4 | spdx | spdx license identifier lgpl 2 0(?: only)?
lgpl-2.0-plus | 4 | spdx | spdx license identifier lgpl 2 0 or later
lgpl-2.1 | 4 | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-plus | 4 | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3.0 | 4 | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-plus | 4 | spdx | spdx license identifier lgpl 3 0 or later
lgpl-2.1-plus | 3 | lesser general public | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-plus | 3 | lesser general public | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-plus | 3 | library general public | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl | 3 | lesser general public | you should have received a copy of the gnu lesser general public license along with this (?:library|program)
lgpl-2.1 | 2 | lesser general public | (?:gnu )?lesser general public license (?:version )?v?2 1
lgpl-3.0 | 2 | lesser general public | (?:gnu )?lesser general public license (?:version )?v?3(?: 0)?
lgpl-2.0 | 2 | library general public | (?:gnu )?library general public license (?:version )?v?2(?: 0)?
lgpl-2.1 | 2 | lgpl | (?:gnu )?lgpl (?:version )?v?2 1
lgpl-3.0 | 2 | lgpl | (?:gnu )?lgpl (?:version )?v?3(?: 0)?
lgpl-2.1 | 2 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | 2 | lgplv3 | lgplv3
lgpl | 1 | lesser general public | (?:the )?(?:gnu )?lesser general public license
lgpl | 1 | library general public | (?:the )?(?:gnu )?library general public license
lgpl | 1 | lgpl | (?:gnu )?lgpl(?: license)?
agpl-3.0 | 4 | spdx | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-plus | 4 | spdx | spdx license identifier agpl 3 0 or later
agpl-3.0-plus | 3 | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0 | 2 | affero | (?:gnu )?affero general public license (?:version )?v?3(?: 0)?
agpl-3.0 | 2 | agpl | (?:gnu )?agpl (?:version )?v?3(?: 0)?
agpl-3.0 | 2 | agplv3 | agplv3
agpl | 1 | affero | (?:the )?(?:gnu )?affero general public license
agpl | 1 | agpl | (?:gnu )?agpl(?: license)?
gfdl-1.3 | 4 | spdx | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.2 | 4 | spdx | spdx license identifier gfdl 1 2(?: only| or later)?
gfdl | 3 | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.3 | 2 | free documentation | (?:gnu )?free documentation license version 1 3
gfdl-1.2 | 2 | free documentation | (?:gnu )?free documentation license version 1 2
gfdl | 1 | free documentation | (?:the )?gnu free documentation license
bsd-2-clause | 4 | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | 4 | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | 4 | spdx | spdx license identifier bsd 4 clause
bsd | 3 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 3 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 3 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | 3 | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 3 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause | 2 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) license
bsd-3-clause | 2 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) license
bsd-4-clause | 2 | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd) license
bsd | 2 | bsd style | (?:a )?bsd style license(?: that can be found in the license file)?
bsd | 1 | bsd | (?:the )?bsd license
bsd | 1 | bsd licence | (?:the )?bsd licence
mpl-1.0 | 4 | spdx | spdx license identifier mpl 1 0
mpl-1.1 | 4 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | 4 | spdx | spdx license identifier mpl 2 0
mpl-2.0 | 3 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 3 | mozilla public | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | 2 | mozilla | mozilla public license (?:version |v )?2(?: 0)?
mpl-1.1 | 2 | mozilla | mozilla public license (?:version |v )?1 1
mpl-1.0 | 2 | mozilla | mozilla public license (?:version |v )?1 0
mpl-2.0 | 2 | mozilla org | mozilla org mpl 2 0
mpl-2.0 | 2 | mpl | mpl (?:version |v )?2(?: 0)?
mpl | 1 | mozilla | (?:the )?mozilla public license
epl-1.0 | 4 | spdx | spdx license identifier epl 1 0
epl-2.0 | 4 | spdx | spdx license identifier epl 2 0
epl-1.0 | 3 | eclipse public | made available under the terms of the eclipse public license v1 0
epl-2.0 | 3 | eclipse public | made available under the terms of the eclipse public license (?:v 2 0|2 0|v2 0)
epl-2.0 | 2 | eclipse | eclipse public license (?:version |v )?v?2(?: 0)?
epl-1.0 | 2 | eclipse | eclipse public license (?:version |v )?v?1(?: 0)?
epl | 1 | eclipse public | (?:the )?eclipse public license
edl-1.0 | 2 | eclipse distribution | eclipse distribution license (?:version |v )?v?1 0
cddl-1.0 | 4 | spdx | spdx license identifier cddl 1 0
cddl-1.1 | 4 | spdx | spdx license identifier cddl 1 1
cddl-1.0 | 3 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 | 2 | common development | common development and distribution license (?:version )?1 0
cddl-1.1 | 2 | common development | common development and distribution license (?:version )?1 1
cddl | 1 | common development | common development and distribution license
cpl-1.0 | 2 | common public license | common public license (?:version |v )?v?1 0
cpl | 1 | common public license | (?:the )?common public license
ipl-1.0 | 2 | ibm public | ibm public license (?:version |v )?1 0
eupl-1.1 | 4 | spdx | spdx license identifier eupl 1 1
eupl-1.2 | 4 | spdx | spdx license identifier eupl 1 2
eupl-1.2 | 2 | eupl | (?:the )?eupl (?:version |v )?1 2
eupl-1.1 | 2 | eupl | (?:the )?eupl (?:version |v )?1 1
eupl | 1 | european union public | european union public licence
osl-3.0 | 4 | spdx | spdx license identifier osl 3 0
osl-3.0 | 2 | open software license | open software license (?:version |v )?3 0
afl-3.0 | 4 | spdx | spdx license identifier afl 3 0
afl-3.0 | 2 | academic free | academic free license (?:version |v )?3 0
afl | 1 | academic free | academic free license
artistic-1.0 | 4 | spdx | spdx license identifier artistic 1 0
artistic-2.0 | 4 | spdx | spdx license identifier artistic 2 0
artistic-2.0 | 2 | artistic | artistic license (?:version |v )?2(?: 0)?
artistic-1.0 | 2 | artistic | artistic license (?:version |v )?1(?: 0)?
artistic | 1 | artistic | (?:the )?(?:perl )?artistic license
perl | 3 | as perl itself | (?:you can redistribute it and or modify it )?under the same terms as perl itself
zlib | 4 | spdx | spdx license identifier zlib
zlib | 3 | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 3 | altered source | altered source versions must be plainly marked as such
zlib | 2 | zlib | (?:the )?zlib license
libpng | 2 | libpng | (?:the )?libpng license
bzip2 | 2 | bzip2 | (?:the )?bzip2 license
boost-1.0 | 4 | spdx | spdx license identifier bsl 1 0
boost-1.0 | 3 | boost | distributed under the boost software license version 1 0
boost-1.0 | 2 | boost | boost software license(?: version)?(?: 1 0)?
bsl-1.1 | 4 | spdx | spdx license identifier busl 1 1
bsl-1.1 | 2 | business source | business source license (?:version )?1 1
bsl | 1 | business source | business source license
sspl-1.0 | 4 | spdx | spdx license identifier sspl 1 0
sspl-1.0 | 2 | server side public | server side public license(?: v 1| version 1)?
elastic-2.0 | 2 | elastic license | elastic license (?:version |v )?2(?: 0)?
elastic | 1 | elastic license | (?:the )?elastic license
commons-clause | 2 | commons clause | commons clause (?:license condition )?(?:v1 0|version 1 0)?
polyform | 2 | polyform | polyform (?:noncommercial|shield|small business|strict|perimeter|free trial) license
python-2.0 | 4 | spdx | spdx license identifier (?:psf 2 0|python 2 0)
python-2.0 | 2 | python software foundation | python software foundation license(?: version 2)?
php-3.01 | 2 | php license | php license (?:version )?(?:3 01|3 0)
php | 1 | php license | (?:the )?php license
ruby | 2 | ruby license | (?:the )?ruby license
ruby | 3 | as ruby | under the same terms as ruby
openssl | 2 | openssl | (?:the )?openssl license
openssl | 3 | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
curl | 2 | curl license | (?:the )?curl license
vim | 2 | vim license | (?:the )?vim license
tcl | 2 | tcl | (?:the )?tcl (?:tk )?license
postgresql | 4 | spdx | spdx license identifier postgresql
postgresql | 2 | postgresql | (?:the )?postgresql licen[cs]e
ntp | 3 | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose
ncsa | 4 | spdx | spdx license identifier ncsa
ncsa | 2 | ncsa | (?:university of illinois )?ncsa open source license
unicode | 2 | unicode | unicode (?:license agreement|data files and software license)
icu | 2 | icu license | (?:the )?icu license
w3c | 2 | w3c | w3c software (?:notice and )?(?:document )?license
wtfpl | 4 | spdx | spdx license identifier wtfpl
wtfpl | 2 | wtfpl | (?:the )?wtfpl(?: license)?
wtfpl | 3 | what the fuck | do what the fuck you want to public license
unlicense | 4 | spdx | spdx license identifier unlicense
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (?:the )?unlicense
beerware | 3 | beer | buy me a beer in return
beerware | 2 | beerware | (?:the )?beerware license
json | 3 | good not evil | the software shall be used for good not evil
ms-pl | 4 | spdx | spdx license identifier ms pl
ms-pl | 2 | microsoft public | microsoft public license(?: ms pl)?
ms-rl | 2 | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
ofl-1.1 | 4 | spdx | spdx license identifier ofl 1 1
ofl-1.1 | 3 | open font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | 2 | open font | (?:sil )?open font license(?: version)?(?: 1 1)?
ubuntu-font | 2 | ubuntu font | ubuntu font licence(?: version)?(?: 1 0)?
cc0-1.0 | 4 | spdx | spdx license identifier cc0 1 0
cc0-1.0 | 2 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 2 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by-1.0 | 4 | spdx | spdx license identifier cc by 1 0
cc-by-2.0 | 4 | spdx | spdx license identifier cc by 2 0
cc-by-3.0 | 4 | spdx | spdx license identifier cc by 3 0
cc-by-4.0 | 4 | spdx | spdx license identifier cc by 4 0
cc-by-4.0 | 2 | cc by | cc by 4 0
cc-by-3.0 | 2 | cc by | cc by 3 0
cc-by-sa-4.0 | 2 | cc by sa | cc by sa 4 0
cc-by-sa-3.0 | 2 | cc by sa | cc by sa 3 0
cc-by-nd-4.0 | 2 | cc by nd | cc by nd 4 0
cc-by-nc-4.0 | 2 | cc by nc | cc by nc 4 0
cc-by-nc-3.0 | 2 | cc by nc | cc by nc 3 0
cc-by-nc-sa-4.0 | 2 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 2 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-nd-4.0 | 2 | cc by nc nd | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 2 | cc by nc nd | cc by nc nd 3 0
cc-by-sa | 1 | cc by sa | cc by sa
cc-by-nd | 1 | cc by nd | cc by nd
cc-by-nc-sa | 1 | cc by nc sa | cc by nc sa
cc-by-nc-nd | 1 | cc by nc nd | cc by nc nd
cc-by-nc | 1 | cc by nc | cc by nc
cc-by-nc-sa-4.0 | 2 | creative commons | creative commons attribution non(?: )?commercial share(?: )?alike 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0 | 2 | creative commons | creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s 4 0(?: international)?(?: license)?
cc-by-nc-4.0 | 2 | creative commons | creative commons attribution non(?: )?commercial 4 0(?: international)?(?: license)?
cc-by-sa-4.0 | 2 | creative commons | creative commons attribution share(?: )?alike 4 0(?: international)?(?: license)?
cc-by-nd-4.0 | 2 | creative commons | creative commons attribution no(?: )?deriv(?:ative)?s 4 0(?: international)?(?: license)?
cc-by-4.0 | 2 | creative commons | creative commons attribution 4 0(?: international)?(?: license)?
cc-by-sa-3.0 | 2 | creative commons | creative commons attribution share(?: )?alike 3 0(?: unported)?(?: license)?
cc-by-3.0 | 2 | creative commons | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by | 1 | creativecommons org | creativecommons org licenses by(?: [1-4] 0)?
cc-by-sa | 1 | creativecommons org | creativecommons org licenses by sa(?: [1-4] 0)?
cc-by-nc | 1 | creativecommons org | creativecommons org licenses by nc(?: [1-4] 0)?
cc-by-nd | 1 | creativecommons org | creativecommons org licenses by nd(?: [1-4] 0)?
cc-by-nc-sa | 1 | creativecommons org | creativecommons org licenses by nc sa(?: [1-4] 0)?
cc-by-nc-nd | 1 | creativecommons org | creativecommons org licenses by nc nd(?: [1-4] 0)?
cc | 1 | creative commons | (?:a )?creative commons license
odbl-1.0 | 2 | open database | open (?:data commons open )?database license(?: v1 0| 1 0)?
odc-by-1.0 | 2 | open data commons | open data commons attribution license(?: v1 0| 1 0)?
pddl-1.0 | 2 | public domain dedication | public domain dedication and license(?: v1 0| 1 0)?
ogl-uk-3.0 | 2 | open government | open government licence (?:version |v )?v?3 0
ogl-uk | 1 | open government | open government licence
dl-de-by-2.0 | 2 | datenlizenz | datenlizenz deutschland namensnennung (?:version )?2 0
etalab-2.0 | 2 | etalab | (?:licence ouverte )?etalab 2 0
openrail | 2 | rail | (?:creativeml )?open(?: )?rail(?:(?: )?m)? license
public-domain | 2 | public domain | (?:is |are |was )?(?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | 1 | public domain | (?:is |are )in the public domain
proprietary | 2 | all rights reserved | copyright (?:c )?(?:[12][0-9]{3} )?(?:by )?(?:[^ ]+ ){0,4}all rights reserved
proprietary | 1 | all rights reserved | all rights reserved
proprietary | 2 | proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | 2 | no part of this | no part of this (?:publication|work|document) may be reproduced
warranty-disclaimer | 1 | warranty | (?:provided )?as is without warranty of any kind
""".strip().splitlines()
)
