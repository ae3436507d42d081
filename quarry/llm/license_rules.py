"""License signatures, best priority first, and the phrases that are always found.

One rule a line: label | confidence | regular expression over lower-cased words parted by single blanks.  @ stands before the
word by which the rule is gated; every match holds that word at that place.  LIC, VER and GNU stand for the expressions in PARTS.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Phrases that are always found, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

PARTS = {"LIC": "(?:license|licence)", "VER": "(?:version |v ?)?", "GNU": "(?:gnu )?"}

SIGNATURES = """
mit-0 | 1.0 | spdx license identifier @mit 0
mit | 1.0 | spdx license identifier @mit
apache-2 | 1.0 | spdx license identifier @apache 2 0
apache-1.1 | 1.0 | spdx license identifier @apache 1 1
agpl-3 | 1.0 | spdx license identifier @agpl 3 0(?: only| or later)?
lgpl-3 | 1.0 | spdx license identifier @lgpl 3 0(?: only| or later)?
lgpl-2.1 | 1.0 | spdx license identifier @lgpl 2 1(?: only| or later)?
gpl-3 | 1.0 | spdx license identifier @gpl 3 0(?: only| or later)?
gpl-2 | 1.0 | spdx license identifier @gpl 2 0(?: only| or later)?
bsd-4-clause | 1.0 | spdx license identifier @bsd 4 clause
bsd-3-clause | 1.0 | spdx license identifier @bsd 3 clause
bsd-2-clause | 1.0 | spdx license identifier @bsd 2 clause
0bsd | 1.0 | spdx license identifier @0bsd
isc | 1.0 | spdx license identifier @isc
mpl-2 | 1.0 | spdx license identifier @mpl 2 0
mpl-1.1 | 1.0 | spdx license identifier @mpl 1 1
epl-2 | 1.0 | spdx license identifier @epl 2 0
epl-1 | 1.0 | spdx license identifier @epl 1 0
cddl | 1.0 | spdx license identifier @cddl 1 [01]
boost-1 | 1.0 | spdx license identifier @bsl 1 0
zlib | 1.0 | spdx license identifier @zlib
unlicense | 1.0 | spdx license identifier @unlicense
wtfpl | 1.0 | spdx license identifier @wtfpl
cc0 | 1.0 | spdx license identifier @cc0 1 0
cc-by-nc-nd | 1.0 | spdx license identifier @cc by nc nd [1-4] [05]
cc-by-nc-sa | 1.0 | spdx license identifier @cc by nc sa [1-4] [05]
cc-by-nc | 1.0 | spdx license identifier @cc by nc [1-4] [05]
cc-by-nd | 1.0 | spdx license identifier @cc by nd [1-4] [05]
cc-by-sa | 1.0 | spdx license identifier @cc by sa [1-4] [05]
cc-by | 1.0 | spdx license identifier @cc by [1-4] [05]
artistic-2 | 1.0 | spdx license identifier @artistic 2 0
eupl | 1.0 | spdx license identifier @eupl 1 [12]
ofl-1.1 | 1.0 | spdx license identifier @ofl 1 1
python-2 | 1.0 | spdx license identifier @python 2 0
postgresql | 1.0 | spdx license identifier @postgresql
mit | 1.0 | @permission is hereby granted free of charge to any person obtaining a copy
mit | 1.0 | the above copyright notice and this @permission notice shall be included in all copies or substantial portions
mit | 0.9 | without restriction including without limitation the rights to use copy modify merge publish distribute @sublicense and or sell copies
isc | 1.0 | @permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.8 | @permission to use copy modify and or distribute this software
hpnd | 0.9 | @permission to use copy modify and distribute this software and its documentation for any purpose
x11 | 0.9 | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written @authorization
bsd | 1.0 | @redistribution and use in source and binary forms with or without modification(?: are permitted)?
bsd | 0.9 | @redistributions of source code must retain the above copyright notice
bsd | 0.9 | @redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 1.0 | (?:neither the name of (?:the )?(?:copyright holder|university|organization|company|author|project) nor )?the names of its @contributors may be used to endorse or promote
bsd-4-clause | 1.0 | all @advertising materials mentioning features or use of this software must display
apache-2 | 1.0 | licensed under the @apache LIC VER2(?: 0)?
apache-2 | 1.0 | (?:released|distributed|available|published|provided|offered) under the (?:terms of the )?@apache(?: software)? LIC VER2(?: 0)?
apache-2 | 1.0 | you may not use this file except in compliance with the LIC you may obtain a copy of the LIC at(?: https?)?(?: www)? @apache org licenses LIC 2 0
apache-2 | 0.9 | (?:www )?@apache org licenses LIC 2 0
apache-2 | 0.9 | @apache(?: software)?(?: foundation)? LIC VER2(?: 0)?
apache-2 | 0.8 | LIC (?:is |type |name )?@apache 2(?: 0)?
apache-2 | 0.8 | @apache VER2(?: 0)? LIC
apache-2 | 0.8 | @apache 2 0
apache-1.1 | 0.9 | @apache(?: software)? LIC VER1 1
apache-1 | 0.9 | @apache(?: software)? LIC VER1 0
apache | 0.8 | licensed to the @apache software foundation
apache | 0.8 | (?:licensed|released|distributed|available|published) under (?:the |an )?(?:terms of the )?@apache(?: software)?(?: LIC)?
apache | 0.7 | @apache(?: software)? LIC
agpl-3 | 1.0 | GNU@affero general public LIC(?: as published by the free software foundation)? (?:either )?VER3(?: 0)?
agpl-3 | 1.0 | (?:www )?gnu org licenses @agpl 3 0
agpl-3 | 0.9 | GNU@agpl VER3(?: 0)?
agpl-3 | 0.9 | @agplv3
agpl | 0.8 | GNU@affero general public LIC
agpl | 0.7 | GNU@agpl(?: LIC)?
lgpl-3 | 1.0 | GNU@lesser general public LIC(?: as published by the free software foundation)? (?:either )?VER3(?: 0)?
lgpl-2.1 | 1.0 | GNU@lesser general public LIC(?: as published by the free software foundation)? (?:either )?VER2 1
lgpl-2 | 1.0 | GNU@library general public LIC(?: as published by the free software foundation)? (?:either )?VER2(?: 0)?
lgpl-3 | 1.0 | (?:www )?gnu org licenses @lgpl 3 0
lgpl-2.1 | 1.0 | (?:www )?gnu org licenses @lgpl 2 1
lgpl-3 | 0.9 | GNU@lgpl VER3(?: 0)?
lgpl-2.1 | 0.9 | GNU@lgpl VER2 1
lgpl-3 | 0.9 | @lgplv3
lgpl-2.1 | 0.9 | @lgplv2 1
lgpl | 0.8 | GNU@lesser general public LIC
lgpl | 0.8 | GNU@library general public LIC
lgpl | 0.7 | GNU@lgpl(?: LIC)?
gpl-3 | 1.0 | it under the terms of the GNU@general public LIC as published by the free software foundation either version 3 of the LIC
gpl-2 | 1.0 | it under the terms of the GNU@general public LIC as published by the free software foundation either version 2 of the LIC
gpl-3 | 1.0 | GNU@general public LIC(?: as published by the free software foundation)? (?:either )?VER3(?: 0)?
gpl-2 | 1.0 | GNU@general public LIC(?: as published by the free software foundation)? (?:either )?VER2(?: 0)?
gpl-1 | 1.0 | GNU@general public LIC(?: as published by the free software foundation)? (?:either )?VER1(?: 0)?
gpl-3 | 1.0 | (?:www )?gnu org licenses @gpl 3 0
gpl-2 | 1.0 | (?:www )?gnu org licenses (?:old licenses )?@gpl 2 0
gpl-3 | 0.9 | GNU@gpl VER3(?: 0)?
gpl-2 | 0.9 | GNU@gpl VER2(?: 0)?
gpl-3 | 0.9 | @gplv3
gpl-2 | 0.9 | @gplv2
gpl | 0.9 | you should have received a copy of the GNU@general public LIC along with this program
gpl | 0.8 | (?:licensed|released|distributed|available|published|redistributed|covered) under (?:the )?(?:terms of the )?GNU@general public LIC
gpl | 0.8 | (?:licensed|released|distributed|available|published|redistributed|covered) under (?:the )?(?:terms of the )?GNU@gpl(?: LIC)?
gpl | 0.7 | GNU@general public LIC
gpl | 0.7 | gnu @gpl(?: LIC)?
gpl | 0.7 | @gpl LIC
gfdl-1.3 | 1.0 | gnu free @documentation LIC VER1 3
gfdl-1.2 | 1.0 | gnu free @documentation LIC VER1 2
gfdl | 0.9 | GNUfree @documentation LIC
gfdl | 0.8 | (?:gnu )?@gfdl(?: 1 [0-3])?
gfdl | 0.8 | gnu org (?:copyleft|licenses) @fdl(?: 1 [0-3])?
mit-0 | 0.9 | @mit no attribution(?: LIC)?
mit | 1.0 | (?:licensed|released|distributed|available|published|provided|redistributed|offered) under (?:the |an )?(?:terms of the )?@mit(?: x11| expat)?(?: LIC)?
mit | 1.0 | (?:www )?opensource org licenses @mit(?: license)?(?: php| html)?
mit | 0.9 | (?:use|used|covered|governed|permitted) (?:it )?(?:under|by) (?:the )?(?:terms of the )?@mit LIC
mit | 0.8 | LIC (?:is |type |name |the )?@mit
mit | 0.8 | @mit(?: x11| expat| style)? LIC
mit | 0.8 | @expat LIC
x11 | 1.0 | (?:licensed|released|distributed|available) under the x @consortium LIC
x11 | 0.9 | @x11 LIC
x11 | 0.9 | x @consortium LIC
bsd-4-clause | 0.9 | (?:the )?(?:4 clause|four clause|original|old) @bsd(?: LIC)?
bsd-4-clause | 0.9 | @bsd (?:4|four) clause(?: LIC)?
bsd-3-clause | 0.9 | (?:the )?(?:3 clause|three clause|new|modified|revised) @bsd(?: LIC)?
bsd-3-clause | 0.9 | @bsd (?:3|three) clause(?: LIC)?
bsd-2-clause | 0.9 | (?:the )?(?:2 clause|two clause|simplified) @bsd(?: LIC)?
bsd-2-clause | 0.9 | @bsd (?:2|two) clause(?: LIC)?
bsd-2-clause | 1.0 | (?:licensed|released|distributed|available) under the @freebsd LIC
bsd-2-clause | 0.9 | @freebsd LIC
0bsd | 0.9 | (?:zero clause|0 clause|free public LIC) @bsd(?: LIC)?
0bsd | 0.9 | @0bsd(?: LIC)?
bsd-3-clause | 1.0 | opensource org licenses @bsd 3 clause
bsd-2-clause | 1.0 | opensource org licenses @bsd 2 clause
bsd | 0.9 | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?(?:berkeley )?@bsd(?: style| type)?(?: LIC)?
bsd | 0.8 | (?:berkeley )?@bsd(?: style| type)? LIC
bsd | 0.6 | LIC (?:is |type |name )?@bsd
isc | 0.9 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?@isc(?: LIC)?
isc | 0.8 | @isc LIC
isc | 0.7 | LIC (?:is |type |name )?@isc
mpl-2 | 1.0 | this source code form is subject to the terms of the @mozilla public LIC v 2 0
mpl-2 | 1.0 | @mozilla public LIC VER2(?: 0)?
mpl-1.1 | 1.0 | the contents of this file are subject to the @mozilla public LIC VER1 1
mpl-1.1 | 1.0 | @mozilla public LIC VER1 1
mpl-1 | 0.9 | @mozilla public LIC VER1 0
mpl-2 | 0.9 | @mozilla org mpl 2 0
mpl-2 | 0.9 | @mozilla org en us mpl 2 0
mpl | 0.8 | @mozilla public LIC
mpl-2 | 0.8 | @mpl VER2(?: 0)?
mpl-1.1 | 0.8 | @mpl VER1 1
mpl | 0.6 | @mpl LIC
epl-2 | 1.0 | @eclipse public LIC VER2(?: 0)?
epl-1 | 1.0 | @eclipse public LIC VER1(?: 0)?
epl-2 | 0.9 | (?:www )?@eclipse org legal epl 2 0
epl-1 | 0.9 | (?:www )?@eclipse org legal epl v10
epl | 0.8 | @eclipse public LIC
edl-1 | 0.9 | @eclipse distribution LIC(?: VER1(?: 0)?)?
epl-2 | 0.8 | @epl VER2(?: 0)?
epl-1 | 0.8 | @epl VER1(?: 0)?
cpl-1 | 0.9 | @common public LIC(?: VER1(?: 0)?)?
ipl-1 | 0.9 | @ibm public LIC(?: VER1(?: 0)?)?
cddl-1.1 | 1.0 | common development and @distribution LIC VER1 1
cddl-1 | 1.0 | common development and @distribution LIC VER1(?: 0)?
cddl | 0.9 | common development and @distribution LIC
cddl | 0.8 | @cddl(?: VER1 [01])?(?: LIC)?
artistic-2 | 1.0 | @artistic LIC VER2(?: 0)?
artistic-1 | 0.9 | (?:perl |clarified )?@artistic LIC VER1(?: 0)?
artistic | 0.8 | (?:perl |clarified |the )?@artistic LIC
artistic | 0.8 | under the same terms as @perl(?: itself)?
boost-1 | 1.0 | distributed under the @boost software LIC(?: VER1(?: 0)?)?
boost-1 | 0.9 | @boost(?: software)? LIC(?: VER1(?: 0)?)?
boost-1 | 0.9 | (?:www )?@boost org license 1 0
zlib | 1.0 | @altered source versions must be plainly marked as such
zlib | 0.9 | the origin of this software must not be @misrepresented
zlib | 0.9 | @zlib(?: libpng)? LIC
libpng | 0.9 | @libpng LIC(?: VER2)?
python-2 | 1.0 | @python software foundation LIC(?: agreement)?(?: VER[23](?: [0-9])?)?
python-2 | 0.9 | @psf LIC(?: agreement)?(?: VER2)?
python-2 | 0.7 | @python LIC
php-3 | 0.9 | @php LIC(?: VER3(?: 0?[01])?)?
ruby | 0.8 | (?:same terms as |the )@ruby(?: LIC)?
ruby | 0.8 | @ruby LIC
openssl | 0.9 | @openssl(?: ssleay)? LIC
openssl | 0.9 | this product includes software developed by the @openssl project
postgresql | 0.9 | @postgresql LIC
ncsa | 0.9 | (?:university of illinois )?@ncsa(?: open source)? LIC
w3c | 0.9 | @w3c software(?: notice)?(?: and)?(?: document)? LIC
unicode | 0.9 | @unicode(?: inc)? LIC agreement
ntp | 0.8 | @ntp LIC
curl | 0.8 | @curl LIC
wtfpl | 1.0 | do what the @fuck you want to public LIC
wtfpl | 0.9 | @wtfpl(?: VER2(?: 0)?)?
beerware | 0.9 | the @beerware LIC
beerware | 0.9 | beer @ware LIC
unlicense | 1.0 | this is free and @unencumbered software released into the public domain
unlicense | 0.9 | (?:the )?@unlicense(?: org)?
eupl-1.2 | 1.0 | european @union public LIC VER1 2
eupl-1.1 | 1.0 | european @union public LIC VER1 1
eupl | 0.9 | european @union public LIC
eupl | 0.8 | @eupl(?: VER1 [12])?
cecill | 0.9 | @cecill(?: [abc])?(?: LIC)?(?: VER[12](?: [01])?)?
ofl-1.1 | 1.0 | (?:sil )?open @font LIC(?: VER1 1)?
ofl-1.1 | 0.9 | scripts @sil org ofl
ofl-1.1 | 0.8 | @ofl(?: VER1 1)? LIC
ms-pl | 0.9 | @microsoft public LIC
ms-rl | 0.9 | @microsoft reciprocal LIC
ms-pl | 0.7 | @ms pl
afl-3 | 0.9 | @academic free LIC(?: VER[123](?: [01])?)?
osl-3 | 0.9 | @osl VER3(?: 0)?
lppl | 0.9 | @latex project public LIC(?: VER1 [0-3][abc]?)?
lppl | 0.8 | @lppl(?: VER1 [0-3][abc]?)?
qpl | 0.8 | @q public LIC
sleepycat | 0.9 | @sleepycat LIC
bsl-1.1 | 0.9 | @business source LIC(?: VER1 1)?
sspl-1 | 0.9 | server @side public LIC(?: VER1)?
elastic-2 | 0.9 | @elastic LIC(?: VER2(?: 0)?)?
commons-clause | 0.9 | commons @clause(?: LIC)?(?: condition)?
odbl | 1.0 | open @database LIC(?: VER1(?: 0)?)?
odbl | 0.8 | @odbl(?: VER1(?: 0)?)?
odc-by | 0.9 | open data commons @attribution LIC(?: VER1(?: 0)?)?
pddl | 0.9 | public domain @dedication and LIC
cdla | 0.9 | community data LIC agreement (?:permissive|sharing) @version [12] 0
llama | 0.8 | @llama(?: [234])?(?: [0-9])? community LIC(?: agreement)?
openrail | 0.8 | @openrail(?: m)?(?: LIC)?
ogl-3 | 0.9 | open @government LIC(?: VER[123](?: 0)?)?
cc0 | 1.0 | (?:creative commons )?@cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0 | 1.0 | @creativecommons org publicdomain zero 1 0
cc-by-nc-nd | 1.0 | @creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 1.0 | @creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc | 1.0 | @creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 1.0 | @creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa | 1.0 | @creativecommons org licenses by sa(?: [1-4] [05])?
cc-by | 1.0 | @creativecommons org licenses by(?: [1-4] [05])?
cc-by-nc-nd | 1.0 | creative commons @attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: VER[1-4] [05])?
cc-by-nc-sa | 1.0 | creative commons @attribution non ?commercial share ?alike(?: VER[1-4] [05])?
cc-by-nc | 1.0 | creative commons @attribution non ?commercial(?: VER[1-4] [05])?
cc-by-nd | 1.0 | creative commons @attribution no ?deriv(?:s|atives|ative works)(?: VER[1-4] [05])?
cc-by-sa | 1.0 | creative commons @attribution share ?alike(?: VER[1-4] [05])?
cc-by | 1.0 | creative commons @attribution(?: VER[1-4] [05])?
cc-by-nc-nd | 0.9 | @cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 0.9 | @cc by nc sa(?: [1-4] [05])?
cc-by-nc | 0.9 | @cc by nc(?: [1-4] [05])?
cc-by-nd | 0.9 | @cc by nd(?: [1-4] [05])?
cc-by-sa | 0.9 | @cc by sa(?: [1-4] [05])?
cc-by | 0.8 | @cc by(?: [1-4] [05])?
creative-commons | 0.7 | (?:licensed |released |published |available )?under a @creative commons LIC
public-domain | 0.8 | (?:in|into|to) the public @domain
public-domain | 0.8 | public @domain dedication
proprietary | 0.8 | @proprietary and confidential
proprietary | 0.8 | confidential and @proprietary
proprietary | 0.6 | @confidential and confidential
proprietary | 0.7 | @unauthorized (?:copying|use|reproduction|distribution)(?: and distribution)? of this (?:file|software|document|work) (?:via any medium )?is (?:strictly )?prohibited
proprietary | 0.7 | end user LIC @agreement
proprietary | 0.6 | for @internal use only
all-rights-reserved | 0.6 | all rights (?:are )?@reserved
all-rights-reserved | 0.6 | alle rechte @vorbehalten
all-rights-reserved | 0.6 | tous droits (?:de reproduction )?@réservés
all-rights-reserved | 0.6 | todos los derechos @reservados
"""


class Rule(NamedTuple):
    prio: int
    label: str
    confidence: float
    keyword: str
    regex: str
    base: bool


def _rule(prio: int, label: str, confidence: float, shape: str, base: bool = False) -> Rule:
    for name, part in PARTS.items():
        shape = shape.replace(name, part)
    keyword = re.search(r"@(\w+)", shape)[1]
    return Rule(prio, label, confidence, keyword, shape, base)


def rules() -> list[Rule]:
    """Base phrases, by their first unusual word, then the signatures.  regex still holds @."""
    gate = {"mit": "under the @mit license", "apache-2": "@apache license version 2", "cc-by-nc": "@cc by nc"}
    out = [_rule(k, label, 1.0, gate[label], True) for k, (_, label) in enumerate(BASE)]
    for line in SIGNATURES.strip().splitlines():
        label, confidence, shape = line.split(" | ")
        out.append(_rule(len(out), label, float(confidence), shape))
    return out
