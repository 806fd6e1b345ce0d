"""Signature rules of the license scan: ordered, hand-written regular expressions over words.

A line is ``label: pattern``.  A pattern is matched against lower-cased words joined by single
blanks, from the start of a word to the end of a word.  The word in ``<...>`` is its keyword: only
places where this very word stands are tried, and everything around it may be an expression.
Earlier rules have priority over later ones.  A section's number is the weight of its rules.

Patterns keep to what Java and RE2 read alike and reach at most ``REACH`` words to either side.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Most words of a match before its keyword, and after it.
REACH = 12

#: The phrases that every scan reports, whatever the rules above them say.
BASE = (0.5, """
cc-by: <cc> by
gpl: general <public> license
reserved: all <rights> reserved
""")

SECTIONS = ((1.0, """
apache-2.0: spdx license identifier <apache> 2 0
apache-1.1: spdx license identifier <apache> 1 1
mit: spdx license identifier <mit>
mit-0: spdx license identifier <mit> 0
bsd-2-clause: spdx license identifier <bsd> 2 clause
bsd-3-clause: spdx license identifier <bsd> 3 clause
bsd-4-clause: spdx license identifier <bsd> 4 clause
0bsd: spdx license identifier <0bsd>
gpl-2.0-only: spdx license identifier <gpl> 2 0(?: only)?
gpl-2.0-or-later: spdx license identifier <gpl> 2 0 or later
gpl-3.0-only: spdx license identifier <gpl> 3 0(?: only)?
gpl-3.0-or-later: spdx license identifier <gpl> 3 0 or later
lgpl-2.1-only: spdx license identifier <lgpl> 2 1(?: only)?
lgpl-2.1-or-later: spdx license identifier <lgpl> 2 1 or later
lgpl-3.0-only: spdx license identifier <lgpl> 3 0(?: only)?
lgpl-3.0-or-later: spdx license identifier <lgpl> 3 0 or later
agpl-3.0-only: spdx license identifier <agpl> 3 0(?: only)?
agpl-3.0-or-later: spdx license identifier <agpl> 3 0 or later
mpl-2.0: spdx license identifier <mpl> 2 0
mpl-1.1: spdx license identifier <mpl> 1 1
epl-1.0: spdx license identifier <epl> 1 0
epl-2.0: spdx license identifier <epl> 2 0
eupl-1.2: spdx license identifier <eupl> 1 2
cddl-1.0: spdx license identifier <cddl> 1 0
cddl-1.1: spdx license identifier <cddl> 1 1
isc: spdx license identifier <isc>
zlib: spdx license identifier <zlib>
unlicense: spdx license identifier <unlicense>
wtfpl: spdx license identifier <wtfpl>
bsl-1.0: spdx license identifier <bsl> 1 0
cc0-1.0: spdx license identifier <cc0> 1 0
cc-by: spdx license identifier <cc> by [1-4] [05]
cc-by-sa: spdx license identifier <cc> by sa [1-4] [05]
cc-by-nc: spdx license identifier <cc> by nc [1-4] [05]
cc-by-nd: spdx license identifier <cc> by nd [1-4] [05]
cc-by-nc-sa: spdx license identifier <cc> by nc sa [1-4] [05]
cc-by-nc-nd: spdx license identifier <cc> by nc nd [1-4] [05]
postgresql: spdx license identifier <postgresql>
ncsa: spdx license identifier <ncsa>
artistic-2.0: spdx license identifier <artistic> 2 0
ofl-1.1: spdx license identifier <ofl> 1 1
odbl-1.0: spdx license identifier <odbl> 1 0
"""), (0.95, """
apache-2.0: (?:may be |is |are )?licen[cs]ed under (?:the )?(?:terms of the )?<apache> licen[cs]e(?: version)?(?: v)? ?2(?: 0)?
apache-1.1: (?:is |are )?licen[cs]ed under (?:the )?<apache> (?:software )?licen[cs]e(?: version)? 1 1
apache: (?:is |are )?(?:licen[cs]ed|released|distributed) under (?:the )?<apache> licen[cs]e
mit: (?:is |are )?(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?<mit> licen[cs]e
mit: released (?:under|as) <mit>
bsd-2-clause: (?:licen[cs]ed|released|distributed) under (?:the )?(?:2 clause|simplified|freebsd) <bsd> licen[cs]e
bsd-3-clause: (?:licen[cs]ed|released|distributed) under (?:the )?(?:3 clause|new|modified|revised) <bsd> licen[cs]e
bsd: (?:licen[cs]ed|released|distributed) under (?:the |a )?<bsd>(?: style)? licen[cs]e
agpl-3.0: (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?gnu <affero> general public licen[cs]e(?: version)?(?: v)? ?3
agpl: (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?gnu <affero> general public licen[cs]e
lgpl-3.0: (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?gnu <lesser> general public licen[cs]e(?: version)?(?: v)? ?3
lgpl-2.1: (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?gnu <lesser> general public licen[cs]e(?: version)?(?: v)? ?2 1
lgpl: (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?gnu <lesser> general public licen[cs]e
gpl-3.0: (?:is |are )?(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?<gnu> general public licen[cs]e(?: version)?(?: v)? ?3(?: 0)?
gpl-2.0: (?:is |are )?(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?<gnu> general public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?
gpl-3.0: (?:licen[cs]ed|released|distributed) under (?:the )?<gpl>(?: version)? (?:v)?3(?: 0)?
gpl-2.0: (?:licen[cs]ed|released|distributed) under (?:the )?<gpl>(?: version)? (?:v)?2(?: 0)?
gpl: (?:licen[cs]ed|released|distributed) under (?:the )?<gpl>
gpl-3.0: (?:licen[cs]ed|released) under (?:the )?<gplv3>
gpl-2.0: (?:licen[cs]ed|released) under (?:the )?<gplv2>
mpl-2.0: (?:this source code form is )?subject to the terms of the <mozilla> public licen[cs]e v ?2 0
mpl-2.0: (?:licen[cs]ed|released|distributed) under (?:the )?<mozilla> public licen[cs]e(?: version)? 2(?: 0)?
mpl: (?:licen[cs]ed|released|distributed) under (?:the )?<mozilla> public licen[cs]e
epl-2.0: (?:made available|licen[cs]ed|released) under (?:the )?(?:terms of the )?<eclipse> public licen[cs]e(?: v| version)? ?2(?: 0)?
epl-1.0: (?:made available|licen[cs]ed|released) under (?:the )?(?:terms of the )?<eclipse> public licen[cs]e(?: v| version)? ?1(?: 0)?
eupl: (?:licen[cs]ed|released) under the <eupl>
cddl: (?:licen[cs]ed|released) under (?:the )?common development and <distribution> licen[cs]e
cc-by-nc-sa: licen[cs]ed under (?:a )?(?:the )?<cc> by nc sa(?: [1-4] [05])?
cc-by-nc-nd: licen[cs]ed under (?:a )?(?:the )?<cc> by nc nd(?: [1-4] [05])?
cc-by-nc: licen[cs]ed under (?:a )?(?:the )?<cc> by nc(?: [1-4] [05])?
cc-by-nd: licen[cs]ed under (?:a )?(?:the )?<cc> by nd(?: [1-4] [05])?
cc-by-sa: licen[cs]ed under (?:a )?(?:the )?<cc> by sa(?: [1-4] [05])?
cc-by: licen[cs]ed under (?:a )?(?:the )?<cc> by(?: [1-4] [05])?
cc-by-nc-sa: <creative> commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd: <creative> commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc: <creative> commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd: <creative> commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-sa: <creative> commons attribution share ?alike(?: [1-4] [05])?
cc-by: <creative> commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e
cc0: <creative> commons (?:zero|cc0)(?: 1 0)?(?: universal)?
cc0: (?:dedicated|released|placed) (?:in|in ?to|to) the public <domain>(?: under cc0(?: 1 0)?)?
isc: (?:licen[cs]ed|released) under (?:the )?<isc> licen[cs]e
zlib: (?:licen[cs]ed|released) under (?:the )?<zlib>(?: libpng)? licen[cs]e
unlicense: (?:licen[cs]ed|released) under (?:the )?<unlicense>
wtfpl: (?:licen[cs]ed|released) under (?:the )?<wtfpl>
bsl-1.0: distributed under the <boost> software licen[cs]e(?: version)? 1 0
ofl-1.1: licen[cs]ed under the sil open <font> licen[cs]e(?: version)? 1 1
odbl-1.0: (?:licen[cs]ed|available) under the open <database> licen[cs]e
artistic-2.0: (?:licen[cs]ed|released|distributed) under (?:the )?<artistic> licen[cs]e(?: version)? 2(?: 0)?
perl: under the same terms as <perl>(?: 5)? itself
postgresql: (?:licen[cs]ed|released) under (?:the )?<postgresql> licen[cs]e
python-2.0: (?:licen[cs]ed|released) under (?:the )?<python> software foundation licen[cs]e
ms-pl: (?:licen[cs]ed|released) under (?:the )?<microsoft> public licen[cs]e
ms-rl: (?:licen[cs]ed|released) under (?:the )?<microsoft> reciprocal licen[cs]e
bsl-1.1: (?:licen[cs]ed|released) under (?:the )?<business> source licen[cs]e(?: 1 1)?
sspl-1.0: (?:licen[cs]ed|released) under (?:the )?server <side> public licen[cs]e
elastic-2.0: (?:licen[cs]ed|released) under (?:the )?<elastic> licen[cs]e(?: 2 0)?
"""), (0.9, """
mit: permission is hereby <granted> free of charge to any person obtaining a copy
mit: without restriction including without limitation the rights to use copy modify merge publish distribute <sublicense>
mit: the above copyright <notice> and this permission notice shall be included in all copies
isc: permission to use copy modify and or <distribute> this software for any purpose with or without fee
bsd: <redistribution> and use in source and binary forms with or without modification are permitted
bsd: <redistributions> of source code must retain the above copyright notice
bsd: <redistributions> in binary form must reproduce the above copyright notice
bsd-3-clause: may be used to <endorse> or promote products derived from this software
bsd-4-clause: all <advertising> materials mentioning features or use of this software must display
apache-2.0: you may not use this file except in <compliance> with the licen[cs]e
apache-2.0: http www <apache> org licenses license 2 0
apache-2.0: unless required by applicable law or <agreed> to in writing software
gpl: you can <redistribute> it and or modify it under the terms of the gnu general public licen[cs]e
lgpl: you can <redistribute> it and or modify it under the terms of the gnu lesser general public
agpl: you can <redistribute> it and or modify it under the terms of the gnu affero general public
gpl: everyone is permitted to copy and distribute <verbatim> copies of this licen[cs]e document
gpl: you should have <received> a copy of the gnu general public licen[cs]e
lgpl: you should have <received> a copy of the gnu lesser general public licen[cs]e
gpl: gnu <org> licenses gpl(?: [23] 0)?
lgpl: gnu <org> licenses lgpl(?: [23] [01])?
agpl: gnu <org> licenses agpl(?: 3 0)?
mpl-2.0: <mozilla> org mpl 2 0
boost: boost <org> license 1 0 txt
cc-by: <creativecommons> org licenses by [1-4] [05]
cc-by-sa: <creativecommons> org licenses by sa [1-4] [05]
cc-by-nc: <creativecommons> org licenses by nc [1-4] [05]
cc-by-nd: <creativecommons> org licenses by nd [1-4] [05]
cc-by-nc-sa: <creativecommons> org licenses by nc sa [1-4] [05]
cc-by-nc-nd: <creativecommons> org licenses by nc nd [1-4] [05]
cc0: <creativecommons> org publicdomain zero 1 0
public-domain: <creativecommons> org publicdomain mark 1 0
mit: <opensource> org licenses? mit(?: license)?
bsd: <opensource> org licenses? bsd(?: license| [234] clause)?
apache-2.0: <opensource> org licenses? apache 2 0
unlicense: this is free and <unencumbered> software released into the public domain
unlicense: <unlicense> org
wtfpl: do what the fuck you <want> to public licen[cs]e
zlib: this software is provided as is without any express or implied <warranty> in no event
zlib: <altered> source versions must be plainly marked as such
ofl-1.1: with <reserved> font name
epl: <eclipse> org legal epl v(?:10|20)
beerware: the <beerware> licen[cs]e(?: revision 42)?
beerware: buy me a <beer> in return
json: the software shall be used for <good> not evil
postgresql: without a written <agreement> is hereby granted provided that the above copyright
x11: in this software without prior written <authorization>
"""), (0.8, """
agpl-3.0: gnu <affero> general public licen[cs]e(?: version)?(?: v)? ?3(?: 0)?(?: or(?: at your option any)? later(?: version)?)?
agpl: gnu <affero> general public licen[cs]e
lgpl-3.0: gnu <lesser> general public licen[cs]e(?: version)?(?: v)? ?3(?: 0)?(?: or(?: at your option any)? later(?: version)?)?
lgpl-2.1: gnu <lesser> general public licen[cs]e(?: version)?(?: v)? ?2 1(?: or(?: at your option any)? later(?: version)?)?
lgpl: gnu <lesser> general public licen[cs]e
lgpl-2.0: gnu <library> general public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?
lgpl: gnu <library> general public licen[cs]e
gfdl: gnu free <documentation> licen[cs]e(?: version 1 [123])?
gpl-3.0: <gnu> general public licen[cs]e(?: version)?(?: v)? ?3(?: 0)?(?: or(?: at your option any)? later(?: version)?)?
gpl-2.0: <gnu> general public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?(?: or(?: at your option any)? later(?: version)?)?
gpl-1.0: <gnu> general public licen[cs]e(?: version)?(?: v)? ?1(?: 0)?
gpl: <gnu> general public licen[cs]e
gpl: <gnu> gpl(?: v[123]| [23] 0)?
lgpl: <gnu> lgpl(?: v[23]| [23] [01])?
agpl: <gnu> agpl(?: v3| 3 0)?
gpl-3.0: <gplv3>
gpl-2.0: <gplv2>
lgpl-3.0: <lgplv3>
lgpl-2.1: <lgplv2>(?: 1)?
agpl-3.0: <agplv3>
gpl-classpath: <classpath> exception(?: to the gpl)?
apache-2.0: <apache> licen[cs]e(?: version)?(?: v)? ?2(?: 0)?
apache-2.0: <apache> 2 0(?: licen[cs]e)?
apache-1.1: <apache> (?:software )?licen[cs]e(?: version)? 1 1
apache-1.0: <apache> (?:software )?licen[cs]e(?: version)? 1 0
apache: <apache> (?:software )?licen[cs]e
mit-0: <mit> no attribution
mit: the <mit> licen[cs]e(?: mit)?
mit: <mit> (?:x11 )?licen[cs]ed?
mit: x11 <mit> licen[cs]e
bsd-2-clause: <bsd> 2 clause(?: licen[cs]e)?
bsd-3-clause: <bsd> 3 clause(?: licen[cs]e)?
bsd-4-clause: <bsd> 4 clause(?: licen[cs]e)?
bsd-2-clause: (?:two|2) clause <bsd>(?: licen[cs]e)?
bsd-3-clause: (?:three|3) clause <bsd>(?: licen[cs]e)?
bsd-2-clause: simplified <bsd>(?: licen[cs]e)?
bsd-3-clause: (?:new|modified|revised) <bsd>(?: licen[cs]e)?
0bsd: zero clause <bsd>(?: licen[cs]e)?
bsd: <bsd>(?: style| like)? licen[cs]e
mpl-2.0: <mozilla> public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?
mpl-1.1: <mozilla> public licen[cs]e(?: version)?(?: v)? ?1 1
mpl: <mozilla> public licen[cs]e
epl-2.0: <eclipse> public licen[cs]e(?: version| v)? ?2(?: 0)?
epl-1.0: <eclipse> public licen[cs]e(?: version| v)? ?1(?: 0)?
epl: <eclipse> public licen[cs]e
edl-1.0: <eclipse> distribution licen[cs]e(?: v)? ?1(?: 0)?
cpl-1.0: <common> public licen[cs]e(?: version| v)? ?1(?: 0)?
eupl: <european> union public licen[cs]e(?: version| v)?(?: 1 [12])?
cddl: common development and <distribution> licen[cs]e(?: version)?(?: 1 [01])?
isc: the <isc> licen[cs]e
zlib: the <zlib>(?: libpng)? licen[cs]e
libpng: <libpng> licen[cs]e(?: version 2)?
bsl-1.0: <boost> software licen[cs]e(?: version)?(?: 1 0)?
ofl-1.1: sil open <font> licen[cs]e(?: version)?(?: 1 1)?
odbl: open data commons open <database> licen[cs]e
odc-by: open data <commons> attribution licen[cs]e
pddl: open data commons public <domain> dedication
artistic: <artistic> licen[cs]e(?: [12](?: 0)?)?
psf: <python> software foundation licen[cs]e(?: version 2)?
php: <php> licen[cs]e(?: version)?(?: 3 0[01]?)?
ruby: <ruby> licen[cs]e
openssl: <openssl> licen[cs]e
ncsa: <illinois> ncsa open source licen[cs]e
afl: <academic> free licen[cs]e(?: version| v)?(?: [123] [01])?
osl: <open> software licen[cs]e(?: version| v)? ?[123] [01]
qpl: q <public> licen[cs]e(?: version)?(?: 1 0)?
upl-1.0: <universal> permissive licen[cs]e(?: version| v)?(?: 1 0)?
ms-pl: <microsoft> public licen[cs]e
ms-rl: <microsoft> reciprocal licen[cs]e
ibmpl: <ibm> public licen[cs]e
npl: <netscape> public licen[cs]e
sunpl: <sun> public licen[cs]e
zpl: <zope> public licen[cs]e
lppl: <latex> project public licen[cs]e
vim: <vim> licen[cs]e
cecill: <cecill>(?: [abc])?(?: licen[cs]e)?(?: version)?(?: [12] [01])?
mulan: <mulan> permissive software licen[cs]e(?: v[12])?
bsl-1.1: <business> source licen[cs]e(?: 1 1)?
sspl-1.0: server <side> public licen[cs]e
polyform: <polyform> (?:noncommercial|small business|strict|shield) licen[cs]e
commons-clause: <commons> clause(?: licen[cs]e condition)?
elastic-2.0: <elastic> licen[cs]e(?: 2 0)?
openrail: (?:creativeml )?open <rail>(?: m)?(?: licen[cs]e)?
openrail: <openrail>(?: m)?(?: licen[cs]e)?
llama: <llama> (?:2 |3 )?community licen[cs]e(?: agreement)?
etalab: licence ouverte <etalab>
ogl: open <government> licen[cs]e(?: v(?:ersion)? ?[123])?
"""), (0.7, """
cc-by-nc-sa: <cc> by nc sa(?: [1-4] [05])?
cc-by-nc-nd: <cc> by nc nd(?: [1-4] [05])?
cc-by-nc: <cc> by nc(?: [1-4] [05])?
cc-by-nd: <cc> by nd(?: [1-4] [05])?
cc-by-sa: <cc> by sa(?: [1-4] [05])?
cc-by: <cc> by(?: [1-4] [05])
cc0: <cc0>(?: 1 0)?
creative-commons: <creative> commons(?: licen[cs]e)?
public-domain: in the public <domain>
public-domain: public <domain> dedication
gpl: <gpl>(?: v?[23](?: 0)?)?(?: or later)?
lgpl: <lgpl>(?: v?[23](?: [01])?)?(?: or later)?
agpl: <agpl>(?: v?3(?: 0)?)?(?: or later)?
dual: dual <licensed> under(?: the)?
"""), (0.6, """
proprietary: (?:this software is )?<proprietary> and confidential
proprietary: <confidential> and proprietary
proprietary: <unauthorized> (?:copying|use|reproduction)(?: or distribution)?(?: of this (?:file|software|document|material))?
proprietary: may not be <reproduced>(?: in any form)?(?: copied)?(?: or distributed)? without (?:prior |the )?(?:written |express )?(?:written )?permission
proprietary: no part of this <publication> may be reproduced
proprietary: for <internal> use only
eula: end user <license> agreement
eula: end user <licence> agreement
commercial: <commercial> licen[cs]e(?: agreement)?
noncommercial: for non ?<commercial> (?:use|purposes?) only
noncommercial: for <noncommercial> (?:use|purposes?)(?: only)?
copyright: <copyright> (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?(?: by)?
copyright: <copyrighted> material
copyleft: <copyleft>
no-warranty: (?:provided )?as is without <warranty> of any kind(?: express or implied)?
no-warranty: <merchantability>(?: and| or)? fitness for a particular purpose
"""))


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    before: str
    after: str
    weight: float
    base: bool


def _lines(block: str) -> list[tuple[str, str]]:
    return [tuple(line.split(": ", 1)) for line in block.strip().splitlines()]


def rules(sections=SECTIONS, base=BASE) -> list[Rule]:
    """All rules in order; those of ``base`` come last, and nothing suppresses them.

    ``before`` is matched at the end of the words before the keyword, ``after`` at the start of those
    behind it, both with the blanks around them."""
    out = []
    for weight, block, is_base in [(w, b, False) for w, b in sections] + [(*base, True)]:
        for label, pattern in _lines(block):
            head, keyword, tail = re.fullmatch(r"(.*)<([a-z0-9]+)>(.*)", pattern).groups()
            out.append(Rule(len(out), label, keyword, f" (?:{head})$", f"^(?:{tail}) ", weight, is_base))
    return out
