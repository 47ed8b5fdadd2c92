"""Signature rules of the license scan, in order of authority.

A line is ``label | keyword | pattern``; the text is lower-cased first.  In a pattern a blank
stands for any number of separators, and both ends must not touch a letter or digit.
A rule is tried only in texts that contain its keyword.  Tiers go from explicit
identifiers to weak hints; within a tier longer detections come first, then earlier rules.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Confidence of a detection by tier.
CONFIDENCE = {1: 0.99, 2: 0.9, 3: 0.7, 4: 0.4}

_TIERS = {
    1: r"""
apache-2.0 | spdx | spdx license identifier apache 2\.0
apache-1.1 | spdx | spdx license identifier apache 1\.1
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
gpl-1.0 | spdx | spdx license identifier gpl 1\.0(?: only| or later)?
gpl-2.0 | spdx | spdx license identifier gpl 2\.0(?: only| or later)?
gpl-3.0 | spdx | spdx license identifier gpl 3\.0(?: only| or later)?
lgpl-2.0 | spdx | spdx license identifier lgpl 2\.0(?: only| or later)?
lgpl-2.1 | spdx | spdx license identifier lgpl 2\.1(?: only| or later)?
lgpl-3.0 | spdx | spdx license identifier lgpl 3\.0(?: only| or later)?
agpl-3.0 | spdx | spdx license identifier agpl 3\.0(?: only| or later)?
mpl-1.1 | spdx | spdx license identifier mpl 1\.1
mpl-2.0 | spdx | spdx license identifier mpl 2\.0
epl-1.0 | spdx | spdx license identifier epl 1\.0
epl-2.0 | spdx | spdx license identifier epl 2\.0
eupl-1.2 | spdx | spdx license identifier eupl 1\.[12]
cddl-1.0 | spdx | spdx license identifier cddl 1\.[01]
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
boost-1.0 | spdx | spdx license identifier bsl 1\.0
busl-1.1 | spdx | spdx license identifier busl 1\.1
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
artistic-2.0 | spdx | spdx license identifier artistic 2\.0
postgresql | spdx | spdx license identifier postgresql
python-2.0 | spdx | spdx license identifier p(?:ython|sf) 2\.0
cc0-1.0 | spdx | spdx license identifier cc0 1\.0
cc-by-3.0 | spdx | spdx license identifier cc by 3\.0
cc-by-4.0 | spdx | spdx license identifier cc by 4\.0
cc-by-sa-3.0 | spdx | spdx license identifier cc by sa 3\.0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4\.0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4\.0
cc-by-nd-4.0 | spdx | spdx license identifier cc by nd 4\.0
cc-by-nc-sa-4.0 | spdx | spdx license identifier cc by nc sa 4\.0
cc-by-nc-nd-4.0 | spdx | spdx license identifier cc by nc nd 4\.0
odbl-1.0 | spdx | spdx license identifier odbl 1\.0
ofl-1.1 | spdx | spdx license identifier ofl 1\.1
ms-pl | spdx | spdx license identifier ms pl
ms-rl | spdx | spdx license identifier ms rl
spdx-other | spdx | spdx license identifier [a-z0-9.+-]+
cc-by-2.0 | commons | creativecommons org licenses by 2\.0
cc-by-2.5 | commons | creativecommons org licenses by 2\.5
cc-by-3.0 | commons | creativecommons org licenses by 3\.0
cc-by-4.0 | commons | creativecommons org licenses by 4\.0
cc-by-sa-2.0 | commons | creativecommons org licenses by sa 2\.0
cc-by-sa-2.5 | commons | creativecommons org licenses by sa 2\.5
cc-by-sa-3.0 | commons | creativecommons org licenses by sa 3\.0
cc-by-sa-4.0 | commons | creativecommons org licenses by sa 4\.0
cc-by-nc-2.0 | commons | creativecommons org licenses by nc 2\.[05]
cc-by-nc-3.0 | commons | creativecommons org licenses by nc 3\.0
cc-by-nc-4.0 | commons | creativecommons org licenses by nc 4\.0
cc-by-nd-3.0 | commons | creativecommons org licenses by nd 3\.0
cc-by-nd-4.0 | commons | creativecommons org licenses by nd 4\.0
cc-by-nc-sa-3.0 | commons | creativecommons org licenses by nc sa 3\.0
cc-by-nc-sa-4.0 | commons | creativecommons org licenses by nc sa 4\.0
cc-by-nc-nd-3.0 | commons | creativecommons org licenses by nc nd 3\.0
cc-by-nc-nd-4.0 | commons | creativecommons org licenses by nc nd 4\.0
cc0-1.0 | commons | creativecommons org publicdomain zero 1\.0
cc-pdm-1.0 | commons | creativecommons org publicdomain mark 1\.0
apache-2.0 | licen | apache org licenses license 2\.0
gpl-2.0 | licen | gnu org licenses (?:old licenses )?gpl 2\.0
gpl-3.0 | licen | gnu org licenses gpl 3\.0
lgpl-3.0 | licen | gnu org licenses lgpl 3\.0
agpl-3.0 | licen | gnu org licenses agpl 3\.0
fdl-1.3 | licen | gnu org licenses fdl 1\.3
mit | licen | opensource org licenses mit
bsd-3-clause | licen | opensource org licenses bsd 3 clause
bsd-2-clause | licen | opensource org licenses bsd 2 clause
mpl-2.0 | mpl | mozilla org mpl 2\.0
epl-2.0 | legal | eclipse org legal epl 2\.0
odbl-1.0 | licen | opendatacommons org licenses odbl
odc-by-1.0 | licen | opendatacommons org licenses by
pddl-1.0 | licen | opendatacommons org licenses pddl
""",
    2: r"""
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:version )?v?1\.0
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version )?v?1\.1
apache-2.0 | apache | apache (?:software )?licen[cs]e (?:version )?v?2(?:\.0)?
apache-2.0 | apache | licen[cs]ed under apache 2(?:\.0)?
mit | licen | (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e
mit | licen | the mit licen[cs]e(?: mit)?
mit | licen | mit x11 licen[cs]e
mit-0 | licen | mit no attribution(?: licen[cs]e)?
bsd-2-clause | licen | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[cs]e
bsd-3-clause | licen | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e
bsd-4-clause | licen | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd) licen[cs]e
bsd-3-clause-clear | licen | (?:bsd 3 clause clear|clear bsd) licen[cs]e
gpl-1.0 | general | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?v(?:ersion )? ?1(?:\.0)?(?: or \(?at your option\)? any later version)?
gpl-2.0 | general | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?v(?:ersion )?2(?:\.0)?(?: or later)?
gpl-3.0 | general | gnu general public licen[cs]e (?:as published by the free software foundation )?(?:either )?v(?:ersion )?3(?:\.0)?(?: or later)?
gpl-2.0 | gpl | (?:gnu )?gpl ?v(?:ersion )?2(?:\.0)?(?: only| or later)?
gpl-3.0 | gpl | (?:gnu )?gpl ?v(?:ersion )?3(?:\.0)?(?: only| or later)?
gpl-2.0 | gpl | gpl 2(?:\.0)?(?: only| or later)?
gpl-3.0 | gpl | gpl 3(?:\.0)?(?: only| or later)?
lgpl-2.0 | general | gnu library general public licen[cs]e(?: v(?:ersion )?2(?:\.0)?)?
lgpl-2.1 | general | gnu lesser general public licen[cs]e v(?:ersion )?2\.1
lgpl-3.0 | general | gnu lesser general public licen[cs]e v(?:ersion )?3(?:\.0)?
lgpl-2.1 | gpl | lgpl ?(?:v|version )?2\.1
lgpl-3.0 | gpl | lgpl ?(?:v|version )?3(?:\.0)?
agpl-3.0 | general | gnu affero general public licen[cs]e(?: v(?:ersion )?3(?:\.0)?)?
agpl-3.0 | gpl | agpl ?(?:v|version )?3(?:\.0)?
fdl-1.1 | licen | gnu free documentation licen[cs]e v(?:ersion )?1\.1
fdl-1.2 | licen | gnu free documentation licen[cs]e v(?:ersion )?1\.2
fdl-1.3 | licen | gnu free documentation licen[cs]e v(?:ersion )?1\.3
mpl-1.0 | mozilla | mozilla public licen[cs]e v?(?:ersion )?1\.0
mpl-1.1 | mozilla | mozilla public licen[cs]e v?(?:ersion )?1\.1
mpl-2.0 | mozilla | mozilla public licen[cs]e v?(?:ersion )?2\.0
epl-1.0 | eclipse | eclipse public licen[cs]e v?(?:ersion )?1\.0
epl-2.0 | eclipse | eclipse public licen[cs]e v?(?:ersion )?2\.0
edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: v?(?:ersion )?1\.0)?
eupl-1.1 | european | european union public licen[cs]e v?(?:ersion )?1\.1
eupl-1.2 | european | european union public licen[cs]e v?(?:ersion )?1\.2
cddl-1.0 | licen | common development and distribution licen[cs]e v?(?:ersion )?1\.0
cddl-1.1 | licen | common development and distribution licen[cs]e v?(?:ersion )?1\.1
cpl-1.0 | licen | common public licen[cs]e(?: v?(?:ersion )?1\.0)?
ipl-1.0 | licen | ibm public licen[cs]e(?: v?(?:ersion )?1\.0)?
apsl-2.0 | licen | apple public source licen[cs]e(?: v?(?:ersion )?2\.0)?
artistic-1.0 | artistic | artistic licen[cs]e v?(?:ersion )?1\.0
artistic-2.0 | artistic | artistic licen[cs]e v?(?:ersion )?2\.0
boost-1.0 | boost | boost software licen[cs]e(?: v?(?:ersion )?1\.0)?
busl-1.1 | business | business source licen[cs]e(?: v?(?:ersion )?1\.1)?
sspl-1.0 | server | server side public licen[cs]e(?: v?(?:ersion )?1(?:\.0)?)?
elastic-2.0 | elastic | elastic licen[cs]e(?: v?(?:ersion )?2(?:\.0)?)?
osl-3.0 | licen | open software licen[cs]e(?: v?(?:ersion )?3\.0)?
afl-3.0 | licen | academic free licen[cs]e(?: v?(?:ersion )?[123]\.[0-9])?
ecl-2.0 | licen | educational community licen[cs]e(?: v?(?:ersion )?2\.0)?
ofl-1.1 | licen | (?:sil )?open font licen[cs]e(?: v?(?:ersion )?1\.1)?
ms-pl | licen | microsoft public licen[cs]e
ms-rl | licen | microsoft reciprocal licen[cs]e
ncsa | licen | (?:university of illinois )?ncsa open source licen[cs]e
w3c | licen | w3c (?:software )?(?:notice and )?licen[cs]e
python-2.0 | licen | (?:python software foundation|psf) licen[cs]e(?: v?(?:ersion )?2(?:\.0)?)?
php-3.01 | licen | php licen[cs]e(?: v?(?:ersion )?3\.0?1)?
zpl-2.1 | licen | zope public licen[cs]e(?: v?(?:ersion )?2\.[01])?
postgresql | licen | postgresql licen[cs]e
openssl | licen | openssl licen[cs]e
vim | licen | vim licen[cs]e
ruby | licen | ruby licen[cs]e
unicode-dfs | licen | unicode licen[cs]e agreement(?: data files and software)?
upl-1.0 | licen | universal permissive licen[cs]e(?: v?(?:ersion )?1\.0)?
mulan-2.0 | licen | mulan (?:permissive software licen[cs]e|psl) ?v?2
cecill-2.1 | licen | cecill free software licen[cs]e(?: agreement)?
openrail-m | rail | (?:creativeml )?open ?rail ?\+?\+? m(?: licen[cs]e)?
llama-2 | licen | llama 2 community licen[cs]e(?: agreement)?
llama-3 | licen | llama 3(?:\.[0-9])? community licen[cs]e(?: agreement)?
gemma | terms | gemma terms of use
cdla-permissive-2.0 | licen | community data licen[cs]e agreement permissive(?: v?(?:ersion )?[12]\.0)?
cdla-sharing-1.0 | licen | community data licen[cs]e agreement sharing(?: v?(?:ersion )?1\.0)?
odbl-1.0 | licen | open (?:data commons open )?database licen[cs]e(?: odbl)?
odc-by-1.0 | licen | open data commons attribution licen[cs]e
pddl-1.0 | licen | (?:open data commons )?public domain dedication and licen[cs]e
ogl-uk-3.0 | licen | open government licen[cs]e v?(?:ersion )?3\.0
ogl-uk-2.0 | licen | open government licen[cs]e v?(?:ersion )?2\.0
etalab-2.0 | licen | (?:etalab )?(?:open licen[cs]e|licence ouverte)(?: v?(?:ersion )?2\.0)
cc0-1.0 | cc0 | cc0 1\.0(?: universal)?
cc0-1.0 | commons | creative commons zero(?: v?1\.0)?
cc-by-1.0 | cc | cc by 1\.0
cc-by-2.0 | cc | cc by 2\.0
cc-by-2.5 | cc | cc by 2\.5
cc-by-3.0 | cc | cc by 3\.0
cc-by-4.0 | cc | cc by 4\.0
cc-by-sa-2.0 | cc | cc by sa 2\.0
cc-by-sa-2.5 | cc | cc by sa 2\.5
cc-by-sa-3.0 | cc | cc by sa 3\.0
cc-by-sa-4.0 | cc | cc by sa 4\.0
cc-by-nc-2.0 | cc | cc by nc 2\.[05]
cc-by-nc-3.0 | cc | cc by nc 3\.0
cc-by-nc-4.0 | cc | cc by nc 4\.0
cc-by-nd-3.0 | cc | cc by nd 3\.0
cc-by-nd-4.0 | cc | cc by nd 4\.0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3\.0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4\.0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3\.0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4\.0
cc-by-4.0 | commons | creative commons attribution 4\.0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-3.0 | commons | creative commons attribution 3\.0(?: unported)?(?: licen[cs]e)?
cc-by-sa-4.0 | commons | creative commons attribution share ?alike 4\.0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-sa-3.0 | commons | creative commons attribution share ?alike 3\.0(?: unported)?(?: licen[cs]e)?
cc-by-nc-4.0 | commons | creative commons attribution non ?commercial 4\.0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nd-4.0 | commons | creative commons attribution no ?deriv(?:ative)?s 4\.0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-sa-4.0 | commons | creative commons attribution non ?commercial share ?alike 4\.0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-nd-4.0 | commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4\.0(?: international)?(?: public)?(?: licen[cs]e)?
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission | permission to use copy modify and distribute this software and its documentation for any purpose
bsd-style | redistribut | redistribution and use in source and binary forms with or without modification are permitted
zlib | permission | permission is granted to anyone to use this software for any purpose including commercial applications
unlicense | domain | this is free and unencumbered software released into the public domain
wtfpl | want | do what the f[a-z*]+ you want to public licen[cs]e
bsd-4-clause | advertis | all advertising materials mentioning features or use of this software must display
bsd-3-clause | endorse | neither the name of [^\n]{1,80}? may be used to endorse or promote products
""",
    3: r"""
apache | apache | apache (?:software )?licen[cs]e
apache | apache | apache licen[cs]ed
mit | licen | mit licen[cs]e[ds]?
bsd | licen | bsd(?: style)? licen[cs]e[ds]?
isc | licen | isc licen[cs]e
zlib | licen | zlib(?: libpng)? licen[cs]e
gpl | general | (?:gnu )?general public licen[cs]e
gpl | gpl | (?:gnu )?gpl(?:ed|'d)?
lgpl | general | (?:gnu )?lesser general public licen[cs]e
lgpl | gpl | (?:gnu )?lgpl
agpl | general | affero general public licen[cs]e
agpl | gpl | (?:gnu )?agpl
fdl | licen | (?:gnu )?free documentation licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
mpl | licen | mpl licen[cs]ed?
epl | eclipse | eclipse public licen[cs]e
eupl | european | european union public licen[cs]e
cddl | cddl | cddl
artistic | artistic | artistic licen[cs]e
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
cc0 | cc0 | cc0
cc-by | cc | cc by
cc-by-sa | cc | cc by sa
cc-by-nc | cc | cc by nc
cc-by-nd | cc | cc by nd
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-nd | cc | cc by nc nd
cc-by | commons | creative commons attribution(?: licen[cs]e)?
cc-by-sa | commons | creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-nc | commons | creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by-nd | commons | creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)?
cc | commons | creative commons(?: licen[cs]e)?
public-domain | domain | (?:in|into|to) the public domain
public-domain | domain | public domain dedication
ogl | licen | open government licen[cs]e
odbl | odbl | odbl
ofl | licen | open font licen[cs]e
reserved | reserved | all rights reserved
reserved | derechos | todos los derechos reservados
reserved | droits | tous droits r(?:é|e)serv(?:é|e)s
reserved | rechte | alle rechte vorbehalten
some-rights | reserved | some rights reserved
no-rights | reserved | no rights reserved
proprietary | proprietary | proprietary and confidential
proprietary | proprietary | proprietary licen[cs]e
commercial | commercial | commercial licen[cs]e
non-commercial | commercial | for non ?commercial (?:use|purposes) only
non-commercial | personal | for personal use only
research-only | research | for (?:academic|research) (?:use|purposes) only
evaluation | evaluation | evaluation licen[cs]e
shareware | shareware | shareware licen[cs]e
freeware | freeware | freeware(?: licen[cs]e)?
eula | licen | end user licen[cs]e agreement
""",
    4: r"""
license-mention | licen | licen[cs]ed under (?:the )?(?:terms of )?(?:the )?
license-mention | licen | released under (?:the )?[a-z0-9.-]{1,30} licen[cs]e
license-mention | licen | see (?:the )?licen[cs]e(?: file)?(?: for details)?
license-mention | licen | licen[cs]e agreement
license-mention | licen | licen[cs]e terms
license-mention | licen | this work is licen[cs]ed
license-mention | licen | this (?:software|program|file|library|document) is licen[cs]ed
license-mention | licen | subject to (?:the )?licen[cs]e
license-mention | licen | open source licen[cs]e
copyleft | copyleft | copyleft
copyright | copyright | copyright (?:\(?c\)? )?(?:19|20)[0-9]{2}(?: ?- ?(?:19|20)[0-9]{2})?
copyright | copyright | copyright (?:holder|owner|notice)s?
copyright | © | © ?(?:19|20)[0-9]{2}
warranty | warrant | without warranty of any kind
warranty | warrant | without any warranty
warranty | warrant | provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)
liability | liab | in no event shall the (?:authors|copyright holders)(?: or copyright holders)? be liable
redistribution | redistribut | may (?:not )?be redistributed
redistribution | reproduc | may not be reproduced(?: or transmitted)?
permission | permission | reproduced (?:here )?(?:with|by) permission(?: of)?
permission | permission | without (?:the )?(?:prior )?(?:express )?(?:written )?permission(?: of)?
permission | permission | permission is (?:hereby )?granted
trademark | trademark | (?:registered )?trademarks? of (?:their|its) respective owners?
patent | patent | patent (?:pending|rights|licen[cs]e)
terms | terms | terms of (?:use|service)
terms | terms | terms and conditions apply
""",
}


def expanded(pattern: str) -> str:
    """The pattern with its blanks and ends written out: any number of separators, with a question mark perhaps none."""
    some = pattern.replace("(?: ", "(?:␣").replace(" ?", SEPARATOR + "*?").replace(" ", "␣").replace("␣", SEPARATOR + "+")
    # what it may start with is looked at first, as looking behind is slow
    whole = regex.compile(some)
    first = "".join(regex.escape(c) for c in sorted({*map(chr, range(128)), *pattern}) if whole.fullmatch(c, partial=True))
    return f"(?=[{first}])(?<!{WORD})(?:{some})(?!{WORD})"


#: Words in too many rules to tell them apart.
_COMMON = {"licen", "license", "spdx", "identifier", "the", "under", "version", "org", "licenses", "public", "software", "open"}


def required(pattern: str) -> str:
    """The longest telling literal that every match contains; empty if there is none."""
    group = re.compile(r"\((?:\?:)?[^()]*\)[?*+]?")
    while group.search(pattern):
        pattern = group.sub(" ", pattern)
    for optional in (r"\[[^\]]*\][?*+]?(?:\{[^}]*\})?", r"\\.[?*+]?", r"[^ ][?*]"):
        pattern = re.sub(optional, " ", pattern)
    return max((w for w in re.findall(r"[a-z0-9]{3,}", pattern) if w not in _COMMON), key=len, default="")


@lru_cache(maxsize=1)
def rules() -> tuple[dict, ...]:
    """id, label, tier, keyword, also and regex of every rule, in order.

    A rule is tried where both its keyword and ``also`` occur; the second follows from the pattern.
    """
    out = []
    for tier, block in _TIERS.items():
        for line in block.strip().splitlines():
            label, keyword, pattern = (x.strip(" ") for x in line.split(" | ", 2))
            pattern = pattern.rstrip(" ")
            out.append({"id": len(out), "label": label, "tier": tier, "keyword": keyword, "also": required(pattern), "regex": expanded(pattern)})
    return tuple(out)
