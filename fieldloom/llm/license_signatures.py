"""Signatures of license texts, grants, headers, notices and addresses, written by hand.

One line each: label, priority, then the expression. It is matched against the
words of a text, A-Z lowered and joined by one space, so addresses and versions
read "apache org licenses license 2 0". ``~n`` stands for up to n words of any
kind. The plain words before the first operator or ``~`` are the rule's keyword:
without them in the line, the expression is not tried.
"""

#: Sentences of public license texts.
SIGNATURES = """
mit 6 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ~4 to deal in the software
mit 5 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 4 opensource org licenses mit
mit 4 mit style licen[sc]e
mit 4 under the mit licen[sc]e
mit-0 5 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ~40 subject to the following no conditions
ncsa 6 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ~4 to deal with the software
bsl 6 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl 4 boost org license 1 0
upl 6 subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
upl 4 oss oracle com licenses upl
isc 6 permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc 4 opensource org licenses isc
hpnd 6 permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
postgresql 6 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql 4 postgresql org about licen[sc]e
w3c 6 permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
w3c 4 w3 org consortium legal
bsd 6 redistribution and use in source and binary forms with or without modification are permitted
bsd 6 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 6 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd 6 neither the name of ~14 may be used to endorse or promote products derived from this software
bsd 6 all advertising materials mentioning features or use of this software must display the following acknowledg
bsd 5 this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties
bsd 4 bsd style licen[sc]e
bsd 4 opensource org licenses bsd
bsd 4 under the (?:new |modified |simplified |[0-4] clause )?bsd
bsd 4 governed by a bsd
zlib 6 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 6 the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib 6 altered source versions must be plainly marked as such
zlib 4 opensource org licenses zlib
unlicense 6 this is free and unencumbered software released into the public domain
unlicense 6 anyone is free to copy modify publish use compile sell or distribute this software
unlicense 4 unlicense org
wtfpl 6 you just do what the fuck you want to
wtfpl 4 wtfpl net
apache 6 terms and conditions for use reproduction and distribution 1 definitions
apache 6 grant of patent license subject to the terms and conditions of this license
apache 6 licensed to the apache software foundation asf under one
apache 6 licensed under the apache license version 2 0 the license
apache 5 you may not use this file except in compliance with the license
apache 5 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache 6 this product includes software developed (?:by|at) the apache software foundation
apache 4 apache org licenses(?: license)?(?: 2 0)?
apache 4 opensource org licenses apache
apache 4 under the apache(?: software)?(?: licen[sc]e(?: v(?:ersion)?)?(?: ?2(?: 0)?)?| v(?:ersion)? ?2(?: 0)?| 2(?: 0)?)
gpl 6 this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl 6 is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl 6 the licenses for most software are designed to take away your freedom to share and change it
gpl 6 the gnu general public license is a free copyleft license
gpl 5 you should have received a copy of the gnu general public licen[sc]e
gpl 4 gnu org licenses(?: old licenses)? gpl
gpl 4 gnu org copyleft gpl
gpl 4 under the(?: terms of the)?(?: gnu)? gpl(?: ?v?[123])?
lgpl 6 is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e
lgpl 6 this license the (?:lesser|library) general public license applies to some specially designated software packages
lgpl 6 this version of the gnu lesser general public license incorporates the terms and conditions
lgpl 5 you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
lgpl 4 gnu org licenses(?: old licenses)? lgpl
agpl 6 is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
agpl 6 if your software can interact with users remotely through a computer network
agpl 5 you should have received a copy of the gnu affero general public licen[sc]e
agpl 4 gnu org licenses agpl
fdl 6 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
fdl 6 the purpose of this license is to make a manual textbook or other functional and useful document free
fdl 4 gnu org licenses fdl
fsf 5 everyone is permitted to copy and distribute verbatim copies of this license document
all-permissive 6 copying and distribution of this file with or without modification are permitted in any medium without royalty
mpl 6 this source code form is subject to the terms of the mozilla public licen[sc]e
mpl 6 the contents of this file are subject to the mozilla public licen[sc]e
mpl 5 if a copy of the mpl was not distributed with this file you can obtain one
mpl 4 mozilla org mpl
mpl 4 opensource org licenses mpl
npl 6 the contents of this file are subject to the netscape public licen[sc]e
epl 6 this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
epl 6 the accompanying program is provided under the terms of this eclipse public licen[sc]e
epl 4 eclipse org legal epl
edl 5 eclipse distribution licen[sc]e
cpl 6 the accompanying program is provided under the terms of this common public licen[sc]e
cpl 4 opensource org licenses cpl
ipl 6 the accompanying program is provided under the terms of this ibm public licen[sc]e
cddl 6 the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cddl 4 opensource org licenses cddl
cc-by 4 creativecommons org licenses by [0-9]
cc-by-sa 4 creativecommons org licenses by sa
cc-by-nd 4 creativecommons org licenses by nd
cc-by-nc 4 creativecommons org licenses by nc [0-9]
cc-by-nc-sa 4 creativecommons org licenses by nc sa
cc-by-nc-nd 4 creativecommons org licenses by nc nd
cc0 4 creativecommons org publicdomain zero
cc0 6 the person who associated a work with this deed has dedicated the work to the public domain
cc0 5 to the extent possible under law ~12 waived all copyright and related or neighboring rights
public-domain 4 creativecommons org publicdomain mark
cc 6 by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons
cc 6 the work as defined below is provided under the terms of this creative commons public license
ofl 6 this font software is licensed under the sil open font licen[sc]e
ofl 6 the goals of the open font license ofl are to stimulate worldwide development
ofl 5 neither the font software nor any of its individual components in original or modified versions may be sold by itself
ofl 4 scripts sil org ofl
bitstream-vera 6 permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license
psf 6 psf (?:hereby grants|is making) ~12 licensee
psf 6 this license agreement is between the python software foundation psf
psf 4 docs python org ~3 license
php 6 products derived from this software may not be called php
php 6 this product includes php software freely available
php 4 php net license
openssl 6 this product includes software developed by the openssl project
openssl 6 the names openssl toolkit and openssl project must not be used
ssleay 6 this product includes cryptographic software written by eric young
artistic 6 the intent of this document is to state the conditions under which a package may be copied
artistic 6 this license establishes the terms under which a given free software package may be copied
artistic 5 under the same terms as perl itself
artistic 4 opensource org licenses artistic
ruby 6 you can redistribute it and or modify it under either the terms of the 2 clause bsdl
vim 6 there are no restrictions on distributing unmodified copies of vim
json 6 the software shall be used for good not evil
beerware 6 as long as you retain this notice you can do whatever you want with this stuff
mspl 6 this license governs use of the accompanying software if you use the software you accept this license
mspl 4 opensource org licenses ms pl
eupl 6 licensed under the eupl
eupl 4 joinup ec europa eu ~6 eupl
afl 6 licensed under the academic free licen[sc]e
osl 6 licensed under the open software licen[sc]e
ecl 6 licensed under the educational community licen[sc]e
cecill 6 this software is governed by the cecill
cecill 4 cecill info
odbl 6 is made available under the open database licen[sc]e
odbl 4 opendatacommons org licenses odbl
odc-by 4 opendatacommons org licenses by
pddl 4 opendatacommons org licenses pddl
pddl 5 public domain dedication and licen[sc]e
sspl 6 if you make the functionality of the program or a modified version available to third parties as a service
sspl 4 mongodb com licensing server side public
busl 6 make non production use of the licensed work
busl 4 mariadb com bsl11
elastic 6 you may not provide the software to third parties as a hosted or managed service
elastic 4 elastic licen[sc]e(?: 2 0)?
commons-clause 6 the software is provided to you by the licensor under the license as defined below subject to the following condition
commons-clause 4 commons clause
polyform 4 polyformproject org licenses
llama 5 llama ~3 community licen[sc]e
openrail 5 (?:bigscience|creativeml) open rail
blueoak 6 each contributor licenses you to do everything with this software that would otherwise infringe
blueoak 4 blueoakcouncil org licen[sc]e
mulan 4 license coscl org cn mulan
zpl 6 this software is subject to the provisions of the zope public licen[sc]e
qpl 6 the intent of this license is to establish freedom to share and change the software regulated by this license
lppl 6 this work may be distributed and or modified under the conditions of the latex project public licen[sc]e
lppl 4 latex project org lppl
sleepycat 6 redistributions in any form must be accompanied by information on how to obtain complete source code
x11 6 except as contained in this notice the name of ~8 shall not be used in advertising or otherwise to promote the sale
nist 6 this software was developed (?:by|at) ~4 national institute of standards and technology
public-domain 6 (?:author|authors) disclaims? copyright to this source code
public-domain 5 this (?:file|code|software|work|program) (?:is|has been) (?:hereby )?(?:in|placed in|put into|released into|dedicated to) the public domain
public-domain 5 work of the (?:united states|u s|us) government
curl 6 name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
icu 6 icu license icu 1 8 1 and later
unicode 6 unicode data files and software ~20 without restriction
libpng 6 the png reference library is supplied as is
ijg 6 this software is based in part on the work of the independent jpeg group
freetype 6 portions of this software are copyright ~6 the freetype project
"""
