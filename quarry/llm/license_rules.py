"""The signatures of the license scan, by hand, in their order of precedence.

A line is ``keyword | label | expression``. Expressions run over the lower-cased words of
a text with one space between them, from word border to word border; a plus behind a number
stays with it as U+207A. The keyword has to occur in the words before the expression is
tried. In an expression ``<1|2.1>`` stands for an optional version, one of those listed,
with or without "or later"; ``<1|2.1>!`` for a version that has to be there. A leading
``*`` marks a short name that may follow the tag of a file header, a leading ``~`` a
loose mention.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The ordered signatures.
SIGNATURES = r"""
gpl | gpl | *(?:gnu )?gpl<1|2|3>
general public | gpl | (?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?<1|2|3>
under the terms of | gpl | you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
copy of the gnu general public | gpl | you should have received a copy of the gnu general public licen[cs]e
classpath | gpl-classpath-exception | (?:with )?(?:the )?(?:gnu )?classpath (?:linking )?exception
library exception | gpl-library-exception | gcc runtime library exception(?: version 3 1)?
bison | gpl-bison-exception | as a special exception you may create a larger work that contains part or all of the bison
autoconf | gpl-autoconf-exception | autoconf (?:configure script )?exception
font exception | gpl-font-exception | (?:gpl )?font exception
font embedding | gpl-font-exception | (?:gpl )?font embedding exception
linking this library | linking-exception | linking this library statically or dynamically with other modules
lgpl | lgpl | *(?:gnu )?lgpl<2|2.1|3>
lesser general public | lgpl | (?:gnu )?(?:library or )?lesser general public licen[cs]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)?<2|2.1|3>
library general public | lgpl | (?:gnu )?library general public licen[cs]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)?<2>
lgpllr | lgpllr | *lgpllr
agpl | agpl | *(?:gnu )?agpl<1|3>
affero | agpl | (?:gnu )?affero (?:gnu )?general public licen[cs]e(?: agpl)?(?: as published by the free software foundation)?(?: either)?<1|3>
gfdl | gfdl | *(?:gnu )?gfdl<1.1|1.2|1.3>
free documentation | gfdl | (?:gnu )?free documentation licen[cs]e(?: gfdl)?<1.1|1.2|1.3>
copying and distribution of this file | gnu-all-permissive | copying and distribution of this file with or without modification are permitted in any medium without royalty
verbatim copies of this licen | gnu-license-text | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
apache | apache | *(?:asl|apache)<1|1.1|2>!
apache | apache | apache (?:software )?licen[cs]e(?: asl)?<1|1.1|2>
apache license | apache-2.0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache org licenses | apache-2.0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache software foundation | apache-contributed | licensed to the apache software foundation asf under one or more contributor license agreements
llvm exception | apache-llvm-exception | *(?:apache 2 0 with )?llvm exception
mozilla | mpl | mozilla public licen[cs]e(?: mpl)?<1|1.1|2>
mpl | mpl | *mpl<1|1.1|2>!
mozilla org mpl | mpl | (?:https? )?(?:www )?mozilla org mpl<1|1.1|2>
incompatible with secondary | mpl-no-copyleft-exception | incompatible with secondary licenses as defined by the mozilla public license(?: v 2 0)?
netscape | npl | netscape public licen[cs]e<1|1.1>
npl | npl | *npl<1|1.1>!
eclipse | epl | eclipse public licen[cs]e(?: epl)?<1|2>
epl | epl | *epl<1|2>!
eclipse distribution | edl | eclipse distribution licen[cs]e<1>
edl | edl | *edl<1>!
common public | cpl | common public licen[cs]e(?: cpl)?<0.5|1>
cpl | cpl | *cpl<0.5|1>!
ibm public | ipl | ibm public licen[cs]e<1>
ipl | ipl | *ipl<1>!
common development | cddl | common development and distribution licen[cs]e(?: cddl)?<1|1.1>
cddl | cddl | *cddl<1|1.1>
european union public | eupl | european union public licen[cs]e(?: eupl)?<1|1.1|1.2>
eupl | eupl | *eupl<1|1.1|1.2>
open software | osl | open software licen[cs]e<1|1.1|2|2.1|3>
osl | osl | *osl<1|1.1|2|2.1|3>!
academic free | afl | academic free licen[cs]e<1.1|1.2|2|2.1|3>
afl | afl | *afl<1.1|1.2|2|2.1|3>!
artistic | artistic | (?:the )?(?:perl )?artistic licen[cs]e<1|2>
artistic | artistic | *artistic<1|2>!
clarified artistic | artistic-clarified | (?:the )?clarified artistic licen[cs]e
same terms as perl | perl | under the same terms as perl(?: itself)?
python software foundation | psf | python software foundation licen[cs]e(?: psf)?<2>
psf | psf | *(?:psf|psfl)<2>!
psf | psf | psf licen[cs]e(?: agreement)?<2>
python license | python | (?:the )?python license(?: 2 0)?
cnri | cnri-python | *cnri (?:open source )?(?:python )?(?:gpl compatible )?licen[cs]e(?: agreement)?
open font | ofl | (?:sil )?open font licen[cs]e(?: ofl)?<1|1.1>
ofl | ofl | *ofl<1|1.1>!
microsoft public | ms-pl | microsoft public licen[cs]e(?: ms pl)?
ms pl | ms-pl | *ms pl
microsoft reciprocal | ms-rl | microsoft reciprocal licen[cs]e(?: ms rl)?
ms rl | ms-rl | *ms rl
microsoft software license | ms-eula | microsoft software licen[cs]e terms
boost | boost | boost software licen[cs]e<1>
bsl 1 0 | boost-1.0 | *bsl 1 0
business source | busl | business source licen[cs]e<1|1.1>
busl | busl | *busl<1|1.1>!
zope | zpl | zope public licen[cs]e(?: zpl)?<1.1|2|2.1>
zpl | zpl | *zpl<1.1|2|2.1>!
latex project | lppl | latex project public licen[cs]e(?: lppl)?<1|1.1|1.2|1.3>
lppl | lppl | *lppl<1|1.1|1.2|1.3>!
0bsd | 0bsd | *0bsd(?: licen[cs]e)?
zero clause | 0bsd | (?:bsd zero clause licen[cs]e|zero clause bsd(?: licen[cs]e)?)
bsd | bsd-1-clause | *(?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
bsd | bsd-2-clause | *(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)?
bsd | bsd-2-clause | (?:simplified bsd|freebsd) licen[cs]e
bsd | bsd-2-clause-patent | *bsd 2 clause patent(?: licen[cs]e)?
bsd | bsd-3-clause | *(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)?
bsd | bsd-3-clause | (?:new|modified|revised) bsd licen[cs]e
bsd | bsd-3-clause-clear | *(?:bsd 3 clause clear|clear bsd)(?: licen[cs]e)?
bsd | bsd-4-clause | *(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)?
bsd | bsd-4-clause | (?:original|old) bsd licen[cs]e
bsd | bsd | bsd (?:style |type |like )?licen[cs]ed?
berkeley software | bsd | berkeley software distribution licen[cs]e
redistribution and use | bsd | redistribution and use in source and binary forms with or without modification are permitted
neither the name | bsd-3-clause | neither the name of .{1,80}? nor the names of (?:its|any|the) contributors
advertising materials | bsd-4-clause | all advertising materials mentioning features or use of this software must display
licen | mit | *(?:the )?mit (?:x11 |x )?(?:style |type |like )?licen[cs]ed?
identifier mit | mit | spdx license identifier mit
expat | mit | (?:the )?expat licen[cs]e
opensource org licenses mit | mit | (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
permission is hereby granted | mit | permission is hereby granted free of charge to any person obtaining a copy of this software
mit 0 | mit-0 | *mit 0(?: licen[cs]e)?
mit no attribution | mit-0 | mit no attribution(?: licen[cs]e)?
x11 | x11 | *(?:the )?x11 licen[cs]e
name of the x consortium | x11 | except as contained in this notice the name of the x consortium shall not be used
isc | isc | *(?:the )?isc licen[cs]e
identifier isc | isc | spdx license identifier isc
permission to use copy modify | isc | permission to use copy modify and or distribute this software for any purpose
historical permission | hpnd | historical permission notice and disclaimer
documentation for any purpose | hpnd | permission to use copy modify and distribute this software and its documentation for any purpose
zlib | zlib | *(?:the )?zlib(?: libpng)? licen[cs]e
identifier zlib | zlib | spdx license identifier zlib
express or implied warranty in no event | zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | libpng | *(?:the )?libpng licen[cs]e(?: version 2)?
unlicense | unlicense | *(?:the )?unlicense
free and unencumbered | unlicense | this is free and unencumbered software released into the public domain
what the fuck | wtfpl | do what the fuck you want to public licen[cs]e(?: wtfpl)?<2>
wtfpl | wtfpl | *wtfpl<2>
beerware | beerware | *(?:the )?beerware(?: licen[cs]e)?
beer ware | beerware | the beer ware licen[cs]e(?: revision 42)?
ncsa | ncsa | *(?:university of illinois )?ncsa(?: open source)? licen[cs]e
postgresql | postgresql | *(?:the )?postgresql licen[cs]e
openssl | openssl | *(?:the )?openssl licen[cs]e
ssleay | ssleay | (?:the )?(?:original )?ssleay licen[cs]e
php licen | php | *(?:the )?php licen[cs]e<3|3.1>
php | php | *php<3|3.1>!
ruby license | ruby | *(?:the )?ruby license
json licen | json | *(?:the )?json licen[cs]e
for good not evil | json | the software shall be used for good not evil
w3c | w3c | *w3c(?: software)?(?: notice and)? licen[cs]e
vim licen | vim | *(?:the )?vim license
sleepycat | sleepycat | *(?:the )?sleepycat licen[cs]e
qpl | qpl | *qpl<1>!
q public | qpl | q public licen[cs]e
cecill | cecill | *cecill(?: free software licen[cs]e)?(?: agreement)?<1|1.1|2|2.1>
cecill b | cecill-b | *cecill b
cecill c | cecill-c | *cecill c
reciprocal public | rpl | reciprocal public licen[cs]e<1.1|1.5>
apple public | apsl | apple public source licen[cs]e<1|1.1|1.2|2>
apsl | apsl | *apsl<1|1.1|1.2|2>!
non profit open | nposl | non profit open software licen[cs]e<3>
educational community | ecl | educational community licen[cs]e<1|2>
ecl | ecl | *ecl<1|2>!
universal permissive | upl | (?:the )?universal permissive licen[cs]e(?: upl)?<1>
upl | upl | *upl<1>!
blue oak | blueoak | *blue oak model licen[cs]e<1>
blueoak | blueoak | *blueoak<1>!
server side public | sspl | server side public licen[cs]e(?: sspl)?<1>
sspl | sspl | *sspl<1>
elastic license | elastic | *elastic license<1|2>
elastic 2 | elastic-2.0 | *elastic 2 0
confluent | confluent | confluent community licen[cs]e<1>
timescale | timescale | timescale licen[cs]e(?: agreement)?
redis source | rsal | redis source available licen[cs]e<1|2>
commons clause | commons-clause | commons clause(?: licen[cs]e)?(?: condition)?(?: v1 0)?
polyform | polyform | *polyform (?:noncommercial|small business|strict|shield|perimeter|internal use|free trial)(?: licen[cs]e)?<1>
prosperity | prosperity | (?:the )?prosperity public licen[cs]e<2|3>
parity | parity | (?:the )?parity public licen[cs]e<6|7>
mulan | mulan-psl | *mulan(?: permissive software licen[cs]e| psl)<1|2>
cryptographic autonomy | cal | cryptographic autonomy licen[cs]e<1>
openldap | openldap | *(?:the )?openldap public licen[cs]e<2.7|2.8>
oldap | openldap | *oldap<2.7|2.8>!
freetype | ftl | (?:the )?freetype (?:project )?licen[cs]e
independent jpeg | ijg | (?:this software is based in part on the work of )?the independent jpeg group(?: s)?(?: licen[cs]e)?
imagemagick | imagemagick | *(?:the )?imagemagick licen[cs]e
unicode license | unicode | *unicode license(?: agreement)?(?: v3)?
unicode dfs | unicode-dfs | *unicode dfs (?:2015|2016)
icu license | icu | *(?:the )?icu license
curl license | curl | *(?:the )?curl license
tcl tk | tcl | (?:the )?tcl tk licen[cs]e
xfree86 | xfree86 | *(?:the )?xfree86 licen[cs]e<1|1.1>
ntp license | ntp | *(?:the )?ntp license
net snmp | net-snmp | *(?:the )?net snmp licen[cs]e
info zip | info-zip | (?:the )?info zip licen[cs]e
bzip2 | bzip2 | *(?:the )?bzip2(?: and libbzip2)? licen[cs]e
interacting with it remotely | agpl | all users interacting with it remotely through a computer network
intel | intel | intel (?:simplified software|open source) licen[cs]e
nvidia | nvidia-eula | nvidia (?:software|cuda toolkit)? ?(?:end user )?licen[cs]e agreement
oracle binary | oracle-bcl | oracle binary code licen[cs]e agreement
binary code | sun-bcl | sun(?: microsystems)?(?: inc)? binary code licen[cs]e agreement
sun industry | sissl | sun industry standards source licen[cs]e<1.1|1.2>
sissl | sissl | *sissl<1.1|1.2>!
open data commons | odbl | open data commons open database licen[cs]e(?: odbl)?<1>
odbl | odbl | *odbl<1>
open data commons | odc-by | open data commons attribution licen[cs]e<1>
odc by | odc-by | *odc by<1>
open data commons | pddl | open data commons public domain dedication and licen[cs]e(?: pddl)?<1>
pddl | pddl | *pddl<1>
community data | cdla-permissive | community data licen[cs]e agreement permissive<1|2>
community data | cdla-sharing | community data licen[cs]e agreement sharing<1>
cdla permissive | cdla-permissive | *cdla permissive<1|2>
cdla sharing | cdla-sharing | *cdla sharing<1>
open government | ogl | open government licen[cs]e<1|2|3>
openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?<1>
open rail | openrail | (?:creativeml |bigscience |bigcode )?open rail(?: m)?<1>
llama | llama | llama(?: 2| 3| 3 1)? community licen[cs]e(?: agreement)?
free art | lal | free art licen[cs]e<1.2|1.3>
licence art libre | lal | licence art libre<1.2|1.3>
design science | dsl | design science licen[cs]e
open publication | opl | open publication licen[cs]e<1>
cc0 | cc0 | *cc0<1>
creative commons zero | cc0 | creative commons zero<1>
cc by nc sa | cc-by-nc-sa | *cc by nc sa<1|2|2.5|3|4>
cc by nc nd | cc-by-nc-nd | *cc by nc nd<1|2|2.5|3|4>
cc by nc | cc-by-nc | *cc by nc<1|2|2.5|3|4>
cc by nd | cc-by-nd | *cc by nd<1|2|2.5|3|4>
cc by sa | cc-by-sa | *cc by sa<1|2|2.5|3|4>
cc by | cc-by | *cc by<1|2|2.5|3|4>
creative commons attribution | cc-by-nc-sa | creative commons attribution non ?commercial share ?alike<1|2|2.5|3|4>
creative commons attribution | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s?<1|2|2.5|3|4>
creative commons attribution | cc-by-nc | creative commons attribution non ?commercial<1|2|2.5|3|4>
creative commons attribution | cc-by-nd | creative commons attribution no ?deriv(?:ative)?s?<1|2|2.5|3|4>
creative commons attribution | cc-by-sa | creative commons attribution share ?alike<1|2|2.5|3|4>
creative commons attribution | cc-by | creative commons attribution<1|2|2.5|3|4>
creativecommons org licenses | cc-by | (?:https? )?(?:www )?creativecommons org licenses by<1|2|2.5|3|4>
creativecommons org licenses | cc-by-sa | (?:https? )?(?:www )?creativecommons org licenses by sa<1|2|2.5|3|4>
creativecommons org publicdomain | cc0 | (?:https? )?(?:www )?creativecommons org publicdomain zero<1>
creative commons | creative-commons | ~creative commons(?: licen[cs]ed?)?
public domain | public-domain | ~(?:in|into|to) the public domain
public domain | public-domain | ~public domain (?:dedication|work|mark)
all rights reserved | all-rights-reserved | ~all rights reserved
proprietary | proprietary | ~proprietary (?:and confidential|licen[cs]e|software|information)
confidential | proprietary | ~confidential and proprietary
open source licen | open-source | ~(?:licen[cs]ed|released|distributed|available|published) under (?:an? |the )?open source licen[cs]e
end user licen | eula | ~end user licen[cs]e agreement
shareware | shareware | ~(?:this (?:program|software) is )?shareware
freeware | freeware | ~(?:this (?:program|software) is )?freeware
purposes only | non-commercial | ~for (?:educational|research|academic) purposes only
commercial use | non-commercial | ~(?:for )?non commercial use only
commercial use | non-commercial | ~not for commercial use
"""

#: Fixed value: what stands before a short name in the header of a file.
TAG = "spdx license identifier "
#: Priorities: of a tag, a versioned name, a name or text, a loose mention.
TAGGED, VERSIONED, NAMED, LOOSE = 4, 3, 2, 1
PLUS = "⁺"
_LATER = rf"((?: of the licen[cs]e)?(?:{PLUS}| plus| or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?))?"


@dataclass(frozen=True)
class Rule:
    """``regex`` has the version as its first group and "or later" as its second if ``versioned``."""

    keyword: str
    label: str
    regex: str
    versioned: bool
    priority: int


def _version(listed: re.Match) -> str:
    """A version as words: ``3`` is also ``3 0``, and ``2.1`` is ``2 1``."""
    # dotted ones first, so that 2.1 isn't taken for a 2
    numbers = [v.replace(".", " ") if "." in v else f"{v}(?: 0)?" for v in sorted(listed[1].split("|"), key=lambda v: "." not in v)]
    found = rf"(?: licen[cs]e)?(?: international| unported)?(?: version | ver | v ?|v| )({'|'.join(numbers)})(?!(?: [0-9])+{PLUS}? )(?: international| unported| only)?{_LATER}"
    return found if listed[2] else f"(?:{found})?"


def parsed(lines: str = SIGNATURES) -> tuple[Rule, ...]:
    made = []
    for line in lines.strip().split("\n"):
        keyword, label, regex = line.split(" | ")
        loose, tagged = regex.startswith("~"), regex.startswith("*")
        body = re.sub(r"<([^>]*)>(!?)", _version, regex.lstrip("*~"))
        made.append(Rule(keyword, label, f"(?:{TAG})?(?:{body})" if tagged else body, "<" in regex.replace("(?<", ""), LOOSE if loose else NAMED))
    return tuple(made)


RULES = parsed()
