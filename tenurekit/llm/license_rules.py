"""Signature rules of licences, in order.

Rules are matched on a text's words, lower-cased and parted by single blanks ("v2.0" reads ``v2 0``). Each line is
``label | regex``; the part in angle brackets is literal and is the rule's keyword: a text without it is not searched for
the rule. A name gives two rules: one for a notice that grants by it, one for the name alone. ``{v}`` stands for an
optional word for version.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Kinds in order of priority, and the confidence a detection of each gives.
KINDS = {"text": 1.0, "tag": 0.95, "notice": 0.9, "name": 0.8, "hint": 0.3}

_V = r"(?:version )?(?:v ?)?"
_GRANT = (
    r"(?:(?:dual |multi )?licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|shared|governed|covered|contributed)"
    r"(?: [^ ]+){0,3}? (?:under|by|per|subject to|according to|with)(?: the)?(?: terms and conditions of| terms of| conditions of)?(?: the| a| an)? "
)

_NAMES = r"""
gpl-1.0 | <gnu general public> licen[sc]e {v}1(?: 0)?
gpl-2.0 | <gnu general public> licen[sc]e {v}2(?: 0)?
gpl-3.0 | <gnu general public> licen[sc]e {v}3(?: 0)?
gpl-2.0-or-later | <gnu general public> licen[sc]e {v}2(?: 0)? or(?: \(?at your option\)?)? (?:any )?later(?: version)?
gpl-3.0-or-later | <gnu general public> licen[sc]e {v}3(?: 0)? or(?: at your option)? (?:any )?later(?: version)?
gpl-2.0-only | <gnu general public> licen[sc]e {v}2(?: 0)? only
gpl-3.0-only | <gnu general public> licen[sc]e {v}3(?: 0)? only
gpl-2.0 | gnu <gpl> {v}2(?: 0)?
gpl-3.0 | gnu <gpl> {v}3(?: 0)?
gpl | <gnu general public> licen[sc]e
gpl | <gnu gpl>
gpl-2.0 | <gplv2>(?: 0)?
gpl-3.0 | <gplv3>(?: 0)?
gpl-2.0 | <gpl 2 0>
gpl-3.0 | <gpl 3 0>
gpl-2.0-or-later | <gplv2> or later
gpl-3.0-or-later | <gplv3> or later
gpl-with-classpath-exception | <classpath exception>
gpl-with-gcc-exception | <gcc runtime library exception>
gpl-with-linking-exception | <linking exception>
gpl-with-font-exception | gpl(?: [^ ]+){0,4} <font exception>
lgpl-2.0 | gnu <library general public> licen[sc]e(?: {v}2(?: 0)?)?
lgpl-2.1 | gnu <lesser general public> licen[sc]e {v}2 1
lgpl-3.0 | gnu <lesser general public> licen[sc]e {v}3(?: 0)?
lgpl-2.1-or-later | gnu <lesser general public> licen[sc]e {v}2 1 or(?: at your option)? (?:any )?later(?: version)?
lgpl-3.0-or-later | gnu <lesser general public> licen[sc]e {v}3(?: 0)? or(?: at your option)? (?:any )?later(?: version)?
lgpl | gnu <lesser general public> licen[sc]e
lgpl | <gnu lgpl>
lgpl-2.1 | <lgplv2 1>
lgpl-3.0 | <lgplv3>(?: 0)?
lgpl-2.1 | <lgpl 2 1>
lgpl-3.0 | <lgpl 3>(?: 0)?
agpl-3.0 | gnu <affero general public> licen[sc]e(?: {v}3(?: 0)?)?
agpl-3.0 | <agplv3>(?: 0)?
agpl-3.0 | <agpl 3>(?: 0)?
agpl-1.0 | <affero general public> licen[sc]e {v}1(?: 0)?
agpl | <gnu agpl>
gfdl-1.1 | gnu <free documentation> licen[sc]e {v}1 1
gfdl-1.2 | gnu <free documentation> licen[sc]e {v}1 2
gfdl-1.3 | gnu <free documentation> licen[sc]e {v}1 3
gfdl | gnu <free documentation> licen[sc]e
gfdl | <gnu fdl>
apache-1.0 | <apache> (?:software )?licen[sc]e {v}1(?: 0)?
apache-1.1 | <apache> (?:software )?licen[sc]e {v}1 1
apache-2.0 | <apache> (?:software )?licen[sc]e {v}2(?: 0)?
apache-2.0 | <apache 2 0>(?: licen[sc]e)?
apache-2.0 | <apache 2> licen[sc]e
apache-2.0 | <apache v2>(?: 0)?(?: licen[sc]e)?
apache-2.0 | <asl 2 0>
apache-2.0-with-llvm-exception | <llvm exceptions?>
apache | <apache license>
apache | <apache software license>
mit | <mit license>
mit | <mit licence>
mit | <expat> licen[sc]e
mit | <mit x11> licen[sc]e
mit | mit <style> licen[sc]e
mit-0 | <mit no attribution>
mit-0 | <mit 0> licen[sc]e
x11 | <x11> licen[sc]e
isc | <isc> licen[sc]e
isc | <internet systems consortium> licen[sc]e
0bsd | (?:zero clause|0 clause|free public) <bsd> licen[sc]e
0bsd | <0bsd>
bsd-1-clause | (?:1|one) <clause bsd>(?: licen[sc]e)?
bsd-2-clause | (?:2|two) <clause bsd>(?: licen[sc]e)?
bsd-3-clause | (?:3|three) <clause bsd>(?: licen[sc]e)?
bsd-4-clause | (?:4|four) <clause bsd>(?: licen[sc]e)?
bsd-2-clause | <bsd> (?:2|two) clause(?: licen[sc]e)?
bsd-3-clause | <bsd> (?:3|three) clause(?: licen[sc]e)?
bsd-2-clause | simplified <bsd> licen[sc]e
bsd-2-clause | <freebsd> licen[sc]e
bsd-3-clause | (?:new|modified|revised) <bsd> licen[sc]e
bsd-4-clause | (?:original|old) <bsd> licen[sc]e
bsd | <bsd license>
bsd | <bsd licence>
bsd | bsd <style> licen[sc]e
mpl-1.0 | <mozilla public> licen[sc]e {v}1(?: 0)?
mpl-1.1 | <mozilla public> licen[sc]e {v}1 1
mpl-2.0 | <mozilla public> licen[sc]e {v}2(?: 0)?
mpl-2.0 | <mpl 2 0>
mpl-1.1 | <mpl 1 1>
mpl | <mozilla public license>
epl-1.0 | <eclipse public> licen[sc]e {v}1(?: 0)?
epl-2.0 | <eclipse public> licen[sc]e {v}2(?: 0)?
epl | <eclipse public license>
edl-1.0 | <eclipse distribution> licen[sc]e(?: {v}1(?: 0)?)?
cddl-1.0 | <common development and distribution> licen[sc]e(?: {v}1(?: 0)?)?
cddl-1.1 | <common development and distribution> licen[sc]e {v}1 1
cddl | <cddl>
cpl-1.0 | <common public> licen[sc]e(?: {v}1(?: 0)?)?
cpal-1.0 | <common public attribution> licen[sc]e(?: {v}1(?: 0)?)?
ipl-1.0 | <ibm public> licen[sc]e(?: {v}1(?: 0)?)?
eupl-1.1 | <european union public> licen[sc]e {v}1 1
eupl-1.2 | <european union public> licen[sc]e {v}1 2
eupl | <european union public> licen[sc]e
eupl-1.2 | <eupl> {v}1 2
cecill-2.1 | <cecill> {v}2 1
cecill-b | <cecill b>
cecill-c | <cecill c>
cecill | <cecill>
artistic-1.0 | <artistic> licen[sc]e {v}1(?: 0)?
artistic-2.0 | <artistic> licen[sc]e {v}2(?: 0)?
artistic | <artistic license>
bsl-1.0 | <boost software> licen[sc]e(?: {v}1(?: 0)?)?
zlib | <zlib> (?:libpng )?licen[sc]e
libpng | <libpng> licen[sc]e
unlicense | <the unlicense>
unlicense | <unlicense> (?:org|licen[sc]e|dedication)
wtfpl | <do what the f[^ ]* you want to> public licen[sc]e
wtfpl | <wtfpl>
cc0-1.0 | <cc0>(?: {v}1(?: 0)?)?(?: universal)?
cc0-1.0 | creative commons <zero>(?: {v}1(?: 0)?)?(?: universal)?
cc-by-1.0 | <cc by> 1 0
cc-by-2.0 | <cc by> 2 0
cc-by-2.5 | <cc by> 2 5
cc-by-3.0 | <cc by> 3 0
cc-by-4.0 | <cc by> 4 0
cc-by-sa-2.0 | <cc by sa> 2 0
cc-by-sa-2.5 | <cc by sa> 2 5
cc-by-sa-3.0 | <cc by sa> 3 0
cc-by-sa-4.0 | <cc by sa> 4 0
cc-by-nc-2.0 | <cc by nc> 2 0
cc-by-nc-3.0 | <cc by nc> 3 0
cc-by-nc-4.0 | <cc by nc> 4 0
cc-by-nd-3.0 | <cc by nd> 3 0
cc-by-nd-4.0 | <cc by nd> 4 0
cc-by-nc-sa-2.0 | <cc by nc sa> 2 0
cc-by-nc-sa-3.0 | <cc by nc sa> 3 0
cc-by-nc-sa-4.0 | <cc by nc sa> 4 0
cc-by-nc-nd-3.0 | <cc by nc nd> 3 0
cc-by-nc-nd-4.0 | <cc by nc nd> 4 0
cc-by-sa | <cc by sa>
cc-by-nc | <cc by nc>
cc-by-nd | <cc by nd>
cc-by-nc-sa | <cc by nc sa>
cc-by-nc-nd | <cc by nc nd>
cc-by | <cc by>
cc-by-4.0 | <creative commons attribution> 4 0(?: international)?(?: licen[sc]e)?
cc-by-3.0 | <creative commons attribution> 3 0(?: unported| [a-z]+)?(?: licen[sc]e)?
cc-by-2.0 | <creative commons attribution> 2 [05](?: generic)?(?: licen[sc]e)?
cc-by-sa-4.0 | <creative commons attribution> share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-sa-3.0 | <creative commons attribution> share ?alike 3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa | <creative commons attribution> share ?alike(?: licen[sc]e)?
cc-by-nc-4.0 | <creative commons attribution> non ?commercial 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc | <creative commons attribution> non ?commercial(?: licen[sc]e)?
cc-by-nc-sa-4.0 | <creative commons attribution> non ?commercial share ?alike 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-sa | <creative commons attribution> non ?commercial share ?alike(?: licen[sc]e)?
cc-by-nc-nd-4.0 | <creative commons attribution> non ?commercial no ?deriv[a-z]* 4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-nd | <creative commons attribution> non ?commercial no ?deriv[a-z]*(?: licen[sc]e)?
cc-by-nd-4.0 | <creative commons attribution> no ?deriv[a-z]* 4 0(?: international)?(?: licen[sc]e)?
cc-by-nd | <creative commons attribution> no ?deriv[a-z]*(?: licen[sc]e)?
cc-by | <creative commons attribution>(?: licen[sc]e)?
cc | <creative commons> licen[sc]e
ofl-1.1 | <sil open font> licen[sc]e(?: {v}1 1)?
ofl-1.0 | <sil open font> licen[sc]e {v}1 0
ofl | <open font> licen[sc]e
ubuntu-font-1.0 | <ubuntu font> licen[sc]e(?: {v}1(?: 0)?)?
psf-2.0 | <python software foundation> licen[sc]e(?: {v}2(?: 0)?)?
psf-2.0 | <psf> licen[sc]e(?: agreement)?
php-3.01 | <php> licen[sc]e {v}3 0(?:1|1)
php-3.0 | <php> licen[sc]e {v}3 0
ruby | <ruby> licen[sc]e
perl | same terms as <perl>(?: itself| 5)?
postgresql | <postgresql> licen[sc]e
openssl | <openssl> licen[sc]e
ssleay | <ssleay> licen[sc]e
curl | <curl> licen[sc]e
ncsa | <university of illinois> ncsa open source licen[sc]e
ncsa | <ncsa> open source licen[sc]e
osl-3.0 | <open software> licen[sc]e(?: {v}3(?: 0)?)?
afl-3.0 | <academic free> licen[sc]e(?: {v}3(?: 0)?)?
afl-2.1 | <academic free> licen[sc]e {v}2 1
ecl-2.0 | <educational community> licen[sc]e(?: {v}2(?: 0)?)?
ms-pl | <microsoft public> licen[sc]e
ms-rl | <microsoft reciprocal> licen[sc]e
zpl-2.1 | <zope public> licen[sc]e(?: {v}2 1)?
w3c | <w3c> (?:software|document)(?: notice and)? licen[sc]e
unicode | <unicode> (?:inc )?licen[sc]e(?: agreement)?
odbl-1.0 | <open database> licen[sc]e(?: {v}1(?: 0)?)?
odbl-1.0 | <odbl>(?: {v}1(?: 0)?)?
odc-by-1.0 | <open data commons attribution> licen[sc]e(?: {v}1(?: 0)?)?
pddl-1.0 | <public domain dedication and> licen[sc]e
ogl-3.0 | <open government> licen[sc]e(?: {v}3(?: 0)?)?
ogl-2.0 | <open government> licen[sc]e {v}2(?: 0)?
cdla-permissive-2.0 | <community data license> agreement permissive(?: {v}2(?: 0)?)?
cdla-sharing-1.0 | <community data license> agreement sharing(?: {v}1(?: 0)?)?
cern-ohl | <cern open hardware> licen[sc]e
mulanpsl-2.0 | <mulan> (?:psl|permissive software licen[sc]e)(?: {v}2(?: 0)?)?
vim | <vim> licen[sc]e
sleepycat | <sleepycat> (?:public )?licen[sc]e
qpl-1.0 | <q public> licen[sc]e(?: {v}1(?: 0)?)?
lppl-1.3c | <latex project public> licen[sc]e(?: {v}1 3[a-c]?)?
tcl | <tcl tk> licen[sc]e
hpnd | <historical permission notice and disclaimer>
ftl | <freetype> (?:project )?licen[sc]e
ijg | <independent jpeg group>
info-zip | <info zip> licen[sc]e
bzip2 | <bzip2> licen[sc]e
ntp | <ntp> licen[sc]e
efl-2.0 | <eiffel forum> licen[sc]e(?: {v}2(?: 0)?)?
beerware | <beerware> licen[sc]e
beerware | <beer ware> licen[sc]e
json | <json> licen[sc]e
sspl-1.0 | <server side public> licen[sc]e(?: {v}1(?: 0)?)?
busl-1.1 | <business source> licen[sc]e(?: {v}1 1)?
elastic-2.0 | <elastic> licen[sc]e(?: {v}2(?: 0)?)?
commons-clause | <commons clause>(?: licen[sc]e)?(?: condition)?
polyform-noncommercial | <polyform> non ?commercial licen[sc]e
polyform-shield | <polyform> shield licen[sc]e
upl-1.0 | <universal permissive> licen[sc]e(?: {v}1(?: 0)?)?
blueoak-1.0.0 | <blue oak model> licen[sc]e(?: 1 0 0)?
nasa-1.3 | <nasa open source> agreement(?: {v}1 3)?
netcdf | <netcdf> licen[sc]e
python-2.0 | <python> licen[sc]e 2(?: 0)?
sgi-b-2.0 | <sgi free software> licen[sc]e b(?: {v}2(?: 0)?)?
sissl | <sun industry standards source> licen[sc]e
spl-1.0 | <sun public> licen[sc]e(?: {v}1(?: 0)?)?
apsl-2.0 | <apple public source> licen[sc]e(?: {v}2(?: 0)?)?
npl-1.1 | <netscape public> licen[sc]e(?: {v}1 1)?
rpl-1.5 | <reciprocal public> licen[sc]e(?: {v}1 5)?
openrail | <openrail>(?: m)?(?: licen[sc]e)?
gust-font | <gust font> licen[sc]e
free-art-1.3 | <free art> licen[sc]e(?: {v}1 3)?
public-domain | <public domain> dedication
"""

_TEXTS = r"""
mit | <permission is hereby granted free of charge> to any person obtaining a copy of this software and associated documentation files(?: the software)?
mit | <the above copyright notice and this permission notice> shall be included in all copies or substantial portions of the software
isc | <permission to use copy modify and> or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | <permission to use copy modify and> or distribute this software for any purpose with or without fee is hereby granted(?! provided)
bsd | <redistribution and use in source and binary forms> with or without modification are permitted(?: provided that the following conditions are met)?
bsd-3-clause | <neither the name of> (?:[^ ]+ ){1,20}?nor the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-4-clause | <all advertising materials mentioning features> or use of this software must display the following acknowledge?ment
apache-2.0 | <you may not use this file except in compliance> with the license
apache-2.0 | <unless required by applicable law or agreed to in writing> software distributed under the license is distributed on an as is basis
apache-2.0 | www <apache org licenses license 2 0>
gpl | <this program is free software> you can redistribute it and or modify it under the terms of the gnu general public license
gpl | <this program is distributed in the hope that it will be useful> but without any warranty
gpl-3.0 | <everyone is permitted to copy and distribute verbatim> copies of this license document but changing it is not allowed
lgpl | <this library is free software> you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl-3.0 | <interact with it remotely through a computer network>
mpl-2.0 | <this source code form is subject to the terms> of the mozilla public license v 2 0
mpl-1.1 | <the contents of this file are subject to the mozilla public> license
epl | <this program and the accompanying materials are made available> under the terms of the eclipse public license
cddl | <the contents of this file are subject to the terms> of the common development and distribution license
bsl-1.0 | <permission is hereby granted free of charge to any person or organization> obtaining a copy of the software and accompanying documentation covered by this license
zlib | <this software is provided as is without any express> or implied warranty in no event will the authors be held liable
unlicense | <this is free and unencumbered software> released into the public domain
cc0-1.0 | <to the extent possible under law>(?: [^ ]+){1,12}? waived all copyright and related or neighboring rights
cc-by-4.0 | <creativecommons org licenses by 4 0>
cc-by-3.0 | <creativecommons org licenses by 3 0>
cc-by-sa-4.0 | <creativecommons org licenses by sa 4 0>
cc-by-sa-3.0 | <creativecommons org licenses by sa 3 0>
cc-by-nc-4.0 | <creativecommons org licenses by nc 4 0>
cc-by-nc-sa-4.0 | <creativecommons org licenses by nc sa 4 0>
cc-by-nc-nd-4.0 | <creativecommons org licenses by nc nd 4 0>
cc-by-nd-4.0 | <creativecommons org licenses by nd 4 0>
cc0-1.0 | <creativecommons org publicdomain zero 1 0>
gpl | <gnu org licenses gpl>(?: html| txt)?
lgpl | <gnu org licenses lgpl>(?: html| txt)?
gfdl | <permission is granted to copy distribute and or modify this document> under the terms of the gnu free documentation license
ofl-1.1 | <this font software is licensed under the sil open font license>
wtfpl | <you just do what the f[^ ]* you want to>
json | <the software shall be used for good not evil>
ssleay | <this product includes cryptographic software written by>
openssl | <this product includes software developed by the openssl project>
postgresql | <permission to use copy modify and distribute this software and its documentation> for any purpose without fee and without a written agreement
beerware | <buy me a beer> in return
"""

_TAGS = """
0bsd, afl-2.1, afl-3.0, agpl-3.0, agpl-3.0-only, agpl-3.0-or-later, apache-1.1, apache-2.0, artistic-2.0, bsd-2-clause, bsd-3-clause, bsd-4-clause,
bsl-1.0, cc0-1.0, cc-by-3.0, cc-by-4.0, cc-by-nc-4.0, cc-by-nd-4.0, cc-by-sa-3.0, cc-by-sa-4.0, cc-by-nc-sa-4.0, cc-by-nc-nd-4.0, cddl-1.0, ecl-2.0,
epl-1.0, epl-2.0, eupl-1.2, gpl-2.0, gpl-2.0-only, gpl-2.0-or-later, gpl-3.0, gpl-3.0-only, gpl-3.0-or-later, isc, lgpl-2.1, lgpl-2.1-only,
lgpl-2.1-or-later, lgpl-3.0, lgpl-3.0-only, lgpl-3.0-or-later, mit, mit-0, mpl-1.1, mpl-2.0, ms-pl, ncsa, ofl-1.1, osl-3.0, postgresql, python-2.0,
unlicense, upl-1.0, wtfpl, x11, zlib
"""

_HINTS = r"""
proprietary | <all rights reserved>
proprietary | <proprietary and confidential>
proprietary | <unauthorized copying> of this (?:file|software|document)
proprietary | <this software is the confidential and proprietary> information of
copyright | <copyright> (?:c )?(?:19|20)[0-9][0-9]
copyright | <copyright c> [^ ]+
non-commercial | for <non commercial> (?:use|purposes)(?: only)?
non-commercial | for <noncommercial> (?:use|purposes)(?: only)?
research-only | for <research purposes> only
public-domain | (?:released|placed|dedicated|is) (?:in|into|to) the <public domain>
license | see the <license file>
license | see (?:the )?<license> (?:for|in|txt|md)
license | <licence agreement>
license | <license agreement>
license | <terms of use>
license | <open source> licen[sc]e
license | <free software> licen[sc]e
license | <permissive> licen[sc]e
license | <copyleft>
license | <source available> licen[sc]e
"""


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keyword: str
    pattern: str


def _rule(label: str, kind: str, marked: str, grant: str = "") -> Rule:
    body = marked.replace("{v}", _V)
    at, end = body.index("<"), body.index(">")
    keyword = body[at + 1 : end]
    literal = re.split(r"[\[(?+*{.\\]", keyword)
    if len(literal) > 1:  # a keyword with a variable part is looked for by the whole words before it
        keyword = literal[0].rpartition(" ")[0]
    return Rule(label, kind, keyword, f"(?<= ){grant}{body[:at]}{body[at + 1 : end]}{body[end + 1 :]}(?= )")


def _lines(table: str) -> list[tuple[str, str]]:
    return [tuple(x.strip() for x in line.split("|", 1)) for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules, by priority and then in the order of the tables."""
    texts = [_rule(label, "text", body) for label, body in _lines(_TEXTS)]
    labels = [x.strip() for x in _TAGS.replace("\n", " ").split(",")]
    tags = [_rule(x, "tag", f"<spdx license identifier> {re.sub('[-.]', ' ', x)}") for x in labels]
    notices = [_rule(label, "notice", body, _GRANT) for label, body in _lines(_NAMES)]
    names = [_rule(label, "name", body) for label, body in _lines(_NAMES)]
    return texts + tags + notices + names + [_rule(label, "hint", body) for label, body in _lines(_HINTS)]
