"""Signature rules of the license scan, in order of priority.

A line is `priority | label | keyword | pattern`.  Patterns run over lower-case
words joined by single blanks, so `GPL-2.0` reads `gpl 2 0`.  The keyword is a
literal part of every match and gates the pattern.  Priority 1 is a phrase of the
license text or an explicit tag, 2 a name with version, 3 a name, 4 a hint.
"""

from __future__ import annotations

from dataclasses import dataclass

TABLE = r"""
1 | gpl-3.0 | spdx license identifier gpl | spdx license identifier gpl 3 0(?: only| or later)?
1 | gpl-2.0 | spdx license identifier gpl | spdx license identifier gpl 2 0(?: only| or later)?
1 | gpl-1.0 | spdx license identifier gpl | spdx license identifier gpl 1 0(?: only| or later)?
1 | lgpl-2.0 | spdx license identifier lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
1 | lgpl-2.1 | spdx license identifier lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
1 | lgpl-3.0 | spdx license identifier lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
1 | agpl-3.0 | spdx license identifier agpl | spdx license identifier agpl 3 0(?: only| or later)?
1 | apache-1.1 | spdx license identifier apache | spdx license identifier apache 1 1
1 | apache-2.0 | spdx license identifier apache | spdx license identifier apache 2 0
1 | mit | spdx license identifier mit | spdx license identifier mit
1 | mit-0 | spdx license identifier mit 0 | spdx license identifier mit 0
1 | bsd-2-clause | spdx license identifier bsd | spdx license identifier bsd 2 clause
1 | bsd-3-clause | spdx license identifier bsd | spdx license identifier bsd 3 clause
1 | bsd-4-clause | spdx license identifier bsd | spdx license identifier bsd 4 clause
1 | 0bsd | spdx license identifier 0bsd | spdx license identifier 0bsd
1 | isc | spdx license identifier isc | spdx license identifier isc
1 | zlib | spdx license identifier zlib | spdx license identifier zlib
1 | mpl-1.1 | spdx license identifier mpl | spdx license identifier mpl 1 1
1 | mpl-2.0 | spdx license identifier mpl | spdx license identifier mpl 2 0
1 | epl-1.0 | spdx license identifier epl | spdx license identifier epl 1 0
1 | epl-2.0 | spdx license identifier epl | spdx license identifier epl 2 0
1 | cddl-1.0 | spdx license identifier cddl | spdx license identifier cddl 1 0
1 | cc0-1.0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
1 | unlicense | spdx license identifier unlicense | spdx license identifier unlicense
1 | bsl-1.0 | spdx license identifier bsl | spdx license identifier bsl 1 0
1 | artistic-2.0 | spdx license identifier artistic | spdx license identifier artistic 2 0
1 | wtfpl | spdx license identifier wtfpl | spdx license identifier wtfpl
1 | eupl-1.2 | spdx license identifier eupl | spdx license identifier eupl 1 2
1 | ofl-1.1 | spdx license identifier ofl | spdx license identifier ofl 1 1
1 | postgresql | spdx license identifier postgresql | spdx license identifier postgresql
1 | python-2.0 | spdx license identifier python | spdx license identifier python 2 0
1 | ncsa | spdx license identifier ncsa | spdx license identifier ncsa
1 | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 | bsl-1.0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
1 | isc | permission to use copy modify and | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
1 | postgresql | permission to use copy modify and distribute | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
1 | hpnd | permission to use copy modify and distribute | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
1 | ofl-1.1 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of the font software
1 | bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
1 | bsd-3-clause | may be used to endorse or promote products | neither the names? of .{1,80}? may be used to endorse or promote products derived from this software
1 | bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display
1 | zlib | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented
1 | apache-2.0 | licensed under the apache license version 2 0 the license | licensed under the apache license version 2 0 the license you may not use this file except in compliance
1 | apache-2.0 | subject to the terms and conditions of this license each contributor | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual
1 | gpl | this program is free software you can redistribute it | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
1 | lgpl | this library is free software you can redistribute it | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
1 | agpl-3.0 | under the terms of the gnu affero general public license | under the terms of the gnu affero general public license
1 | gpl-3.0 | the gnu general public license is a free copyleft license | the gnu general public license is a free copyleft license
1 | gpl-2.0 | the licenses for most software are designed to take away | the licenses for most software are designed to take away your freedom
1 | mpl-2.0 | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
1 | mpl-1.1 | subject to the mozilla public license version 1 1 | subject to the mozilla public license version 1 1
1 | epl-1.0 | made available under the terms of the eclipse public license v1 0 | made available under the terms of the eclipse public license v1 0
1 | epl-2.0 | available under the terms of the eclipse public license 2 0 | available under the terms of the eclipse public license 2 0
1 | unlicense | this is free and unencumbered software | this is free and unencumbered software released into the public domain
1 | wtfpl | do what the fuck you want to public license | do what the fuck you want to public license
1 | cc0-1.0 | to the extent possible under law | to the extent possible under law .{0,120}?waived all copyright
1 | vim | vim is charityware | vim is charityware
1 | json | the software shall be used for good not evil | the software shall be used for good not evil
1 | beerware | the beer ware license | the beer ware license
1 | openssl | this product includes software developed by the openssl project | this product includes software developed by the openssl project
1 | php-3.01 | this product includes php software | this product includes php software
1 | ms-pl | this license governs use of the accompanying software | this license governs use of the accompanying software if you use the software you accept this license
1 | sspl-1.0 | making the functionality of the program available to third parties as a service | making the functionality of the program available to third parties as a service
1 | elastic-2.0 | you may not provide the software to third parties as a hosted | you may not provide the software to third parties as a hosted or managed service
1 | busl-1.1 | the licensor hereby grants you the right to copy modify | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
2 | gpl-1.0 | gnu general public license | gnu general public license(?: gpl)? (?:version |v )?1(?: 0)?(?: or (?:later|any later version))?
2 | gpl-2.0 | gnu general public license | gnu general public license(?: gpl)? (?:version |v )?2(?: 0)?(?: or (?:later|any later version))?
2 | gpl-3.0 | gnu general public license | gnu general public license(?: gpl)? (?:version |v )?3(?: 0)?(?: or (?:later|any later version))?
2 | gpl-2.0 | gnu general public license v2 | gnu general public license v2(?: 0)?
2 | gpl-3.0 | gnu general public license v3 | gnu general public license v3(?: 0)?
2 | lgpl-2.0 | gnu library general public license | gnu library general public license (?:version |v )?2(?: 0)?
2 | lgpl-2.1 | gnu lesser general public license | gnu lesser general public license (?:version |v )?2 1
2 | lgpl-3.0 | gnu lesser general public license | gnu lesser general public license (?:version |v )?3(?: 0)?
2 | lgpl-2.1 | gnu lesser general public license v2 1 | gnu lesser general public license v2 1
2 | lgpl-3.0 | gnu lesser general public license v3 | gnu lesser general public license v3(?: 0)?
2 | agpl-3.0 | gnu affero general public license | gnu affero general public license (?:version |v )?3(?: 0)?
2 | agpl-3.0 | gnu affero general public license v3 | gnu affero general public license v3(?: 0)?
2 | agpl-1.0 | affero general public license | affero general public license (?:version |v )?1(?: 0)?
2 | gfdl-1.1 | gnu free documentation license | gnu free documentation license (?:version |v )?1 1
2 | gfdl-1.2 | gnu free documentation license | gnu free documentation license (?:version |v )?1 2
2 | gfdl-1.3 | gnu free documentation license | gnu free documentation license (?:version |v )?1 3
2 | gpl-1.0 | gpl | gpl (?:version |v )?1(?: 0)?
2 | gpl-2.0 | gpl | gpl (?:version |v )?2(?: 0)?
2 | gpl-3.0 | gpl | gpl (?:version |v )?3(?: 0)?
2 | gpl-2.0 | gplv2 | gplv2
2 | gpl-3.0 | gplv3 | gplv3
2 | lgpl-2.1 | lgpl | lgpl (?:version |v )?2 1
2 | lgpl-3.0 | lgpl | lgpl (?:version |v )?3(?: 0)?
2 | lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
2 | lgpl-3.0 | lgplv3 | lgplv3
2 | agpl-3.0 | agpl | agpl (?:version |v )?3(?: 0)?
2 | agpl-3.0 | agplv3 | agplv3
2 | apache-1.0 | apache | apache(?: software)? license (?:version |v )?1 0
2 | apache-1.1 | apache | apache(?: software)? license (?:version |v )?1 1
2 | apache-2.0 | apache | apache(?: software)? license (?:version |v )?2(?: 0)?
2 | apache-2.0 | apache 2 0 | apache 2 0(?: license)?
2 | apache-2.0 | apache license v2 | apache license v2(?: 0)?
2 | asl-2.0 | asl 2 0 | asl 2 0
2 | bsd-2-clause | 2 clause bsd | 2 clause bsd(?: license)?
2 | bsd-3-clause | 3 clause bsd | 3 clause bsd(?: license)?
2 | bsd-4-clause | 4 clause bsd | 4 clause bsd(?: license)?
2 | bsd-2-clause | bsd 2 clause | bsd 2 clause(?: license)?
2 | bsd-3-clause | bsd 3 clause | bsd 3 clause(?: license)?
2 | bsd-4-clause | bsd 4 clause | bsd 4 clause(?: license)?
2 | bsd-2-clause | simplified bsd license | simplified bsd license
2 | bsd-2-clause | freebsd license | freebsd license
2 | bsd-3-clause | new bsd license | new bsd license
2 | bsd-3-clause | modified bsd license | modified bsd license
2 | bsd-3-clause | revised bsd license | revised bsd license
2 | bsd-4-clause | original bsd license | original bsd license
2 | 0bsd | zero clause bsd | zero clause bsd(?: license)?
2 | mpl-1.0 | mozilla public license | mozilla public license (?:version |v )?1 0
2 | mpl-1.1 | mozilla public license | mozilla public license (?:version |v )?1 1
2 | mpl-2.0 | mozilla public license | mozilla public license (?:version |v )?2(?: 0)?
2 | mpl-1.1 | mpl | mpl (?:version |v )?1 1
2 | mpl-2.0 | mpl | mpl (?:version |v )?2(?: 0)?
2 | epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1(?: 0)?
2 | epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2(?: 0)?
2 | cddl-1.0 | common development and distribution license | common development and distribution license(?: cddl)? (?:version |v )?1 0
2 | cddl-1.1 | common development and distribution license | common development and distribution license(?: cddl)? (?:version |v )?1 1
2 | eupl-1.1 | european union public licen | european union public licen[cs]e (?:version |v )?1 1
2 | eupl-1.2 | european union public licen | european union public licen[cs]e (?:version |v )?1 2
2 | artistic-1.0 | artistic license | artistic license (?:version |v )?1(?: 0)?
2 | artistic-2.0 | artistic license | artistic license (?:version |v )?2(?: 0)?
2 | bsl-1.0 | boost software license | boost software license (?:version |v )?1(?: 0)?
2 | ofl-1.1 | sil open font license | sil open font license (?:version |v )?1 1
2 | osl-3.0 | open software license | open software license (?:version |v )?3(?: 0)?
2 | afl-3.0 | academic free license | academic free license (?:version |v )?3(?: 0)?
2 | ecl-2.0 | educational community license | educational community license (?:version |v )?2(?: 0)?
2 | upl-1.0 | universal permissive license | universal permissive license (?:version |v )?1(?: 0)?
2 | cpl-1.0 | common public license | common public license (?:version |v )?1(?: 0)?
2 | ipl-1.0 | ibm public license | ibm public license (?:version |v )?1(?: 0)?
2 | lppl-1.3c | latex project public license | latex project public license (?:version |v )?1 3c?
2 | zpl-2.1 | zope public license | zope public license (?:version |v )?2 1
2 | php-3.01 | php license | php license (?:version |v )?3 01
2 | python-2.0 | python license | python license (?:version |v )?2(?: 0)?
2 | psf-2.0 | psf license | psf license (?:version |v )?2(?: 0)?
2 | apsl-2.0 | apple public source license | apple public source license (?:version |v )?2(?: 0)?
2 | sspl-1.0 | server side public license | server side public license (?:version |v )?1(?: 0)?
2 | elastic-2.0 | elastic license | elastic license (?:version |v )?2(?: 0)?
2 | busl-1.1 | business source license | business source license (?:version |v )?1 1
2 | cecill-2.1 | cecill | cecill (?:version |v )?2 1
2 | mulan-2.0 | mulan psl | mulan psl v2
2 | odbl-1.0 | open database license | open database license(?: odbl)? (?:version |v )?1(?: 0)?
2 | odc-by-1.0 | open data commons attribution license | open data commons attribution license (?:version |v )?1(?: 0)?
2 | cdla-permissive-2.0 | community data license agreement | community data license agreement permissive (?:version |v )?2(?: 0)?
2 | cdla-sharing-1.0 | community data license agreement | community data license agreement sharing (?:version |v )?1(?: 0)?
2 | ogl-3.0 | open government licen | open government licen[cs]e (?:version |v )?3(?: 0)?
2 | etalab-2.0 | licence ouverte | licence ouverte (?:version |v )?2(?: 0)?
2 | openrail-m | openrail m | openrail m(?: license)?
2 | cc0-1.0 | cc0 1 0 | cc0 1 0(?: universal)?
2 | cc-by-1.0 | cc by 1 0 | cc by 1 0
2 | cc-by-2.0 | cc by 2 0 | cc by 2 0
2 | cc-by-2.5 | cc by 2 5 | cc by 2 5
2 | cc-by-3.0 | cc by 3 0 | cc by 3 0
2 | cc-by-4.0 | cc by 4 0 | cc by 4 0
2 | cc-by-sa-2.0 | cc by sa 2 0 | cc by sa 2 0
2 | cc-by-sa-2.5 | cc by sa 2 5 | cc by sa 2 5
2 | cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0
2 | cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
2 | cc-by-nc-2.0 | cc by nc 2 0 | cc by nc 2 0
2 | cc-by-nc-3.0 | cc by nc 3 0 | cc by nc 3 0
2 | cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
2 | cc-by-nd-3.0 | cc by nd 3 0 | cc by nd 3 0
2 | cc-by-nd-4.0 | cc by nd 4 0 | cc by nd 4 0
2 | cc-by-nc-sa-3.0 | cc by nc sa 3 0 | cc by nc sa 3 0
2 | cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa 4 0
2 | cc-by-nc-nd-3.0 | cc by nc nd 3 0 | cc by nc nd 3 0
2 | cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd 4 0
2 | cc-by-2.0 | creative commons attribution 2 0 | creative commons attribution 2 0(?: generic)?
2 | cc-by-3.0 | creative commons attribution 3 0 | creative commons attribution 3 0(?: unported)?
2 | cc-by-4.0 | creative commons attribution 4 0 | creative commons attribution 4 0(?: international)?
2 | cc-by-sa-3.0 | creative commons attribution share | creative commons attribution share ?alike 3 0(?: unported)?
2 | cc-by-sa-4.0 | creative commons attribution share | creative commons attribution share ?alike 4 0(?: international)?
2 | cc-by-nc-3.0 | creative commons attribution non | creative commons attribution non ?commercial 3 0(?: unported)?
2 | cc-by-nc-4.0 | creative commons attribution non | creative commons attribution non ?commercial 4 0(?: international)?
2 | cc-by-nd-4.0 | creative commons attribution no | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
2 | cc-by-4.0 | creativecommons org licenses by 4 0 | creativecommons org licenses by 4 0
2 | cc-by-3.0 | creativecommons org licenses by 3 0 | creativecommons org licenses by 3 0
2 | cc-by-sa-4.0 | creativecommons org licenses by sa 4 0 | creativecommons org licenses by sa 4 0
2 | cc-by-sa-3.0 | creativecommons org licenses by sa 3 0 | creativecommons org licenses by sa 3 0
2 | cc-by-nc-4.0 | creativecommons org licenses by nc 4 0 | creativecommons org licenses by nc 4 0
2 | cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
2 | cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
2 | cc0-1.0 | creativecommons org publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0
3 | gpl | gnu general public license | gnu general public license
3 | gpl | gnu gpl | gnu gpl
3 | lgpl | gnu lesser general public license | gnu lesser general public license
3 | lgpl | gnu library general public license | gnu library general public license
3 | lgpl | gnu lgpl | gnu lgpl
3 | agpl | affero general public license | (?:gnu )?affero general public license
3 | gfdl | gnu free documentation license | gnu free documentation license
3 | apache | apache license | apache license
3 | apache | apache software license | apache software license
3 | mit | mit license | mit license
3 | mit | expat license | expat license
3 | mit | x11 license | x11 license
3 | bsd | bsd license | bsd license
3 | bsd | bsd style license | bsd style license
3 | isc | isc license | isc license
3 | zlib | zlib license | zlib license
3 | zlib | zlib libpng license | zlib libpng license
3 | mpl | mozilla public license | mozilla public license
3 | epl | eclipse public license | eclipse public license
3 | cddl | common development and distribution license | common development and distribution license
3 | eupl | european union public licen | european union public licen[cs]e
3 | artistic | artistic license | artistic license
3 | bsl-1.0 | boost software license | boost software license
3 | ofl | open font license | open font license
3 | osl | open software license | open software license
3 | afl | academic free license | academic free license
3 | unlicense | the unlicense | the unlicense
3 | ncsa | university of illinois ncsa open source license | university of illinois ncsa open source license
3 | postgresql | postgresql license | postgresql license
3 | psf | python software foundation license | python software foundation license
3 | php | php license | php license
3 | ruby | ruby license | ruby license
3 | perl | same terms as perl itself | same terms as perl itself
3 | openssl | openssl license | openssl license
3 | curl | curl license | curl license
3 | libpng | libpng license | libpng license
3 | unicode | unicode license agreement | unicode license agreement
3 | w3c | w3c software notice and license | w3c software notice and license
3 | ms-pl | microsoft public license | microsoft public license
3 | ms-rl | microsoft reciprocal license | microsoft reciprocal license
3 | sspl | server side public license | server side public license
3 | elastic | elastic license | elastic license
3 | busl | business source license | business source license
3 | commons-clause | commons clause | commons clause
3 | odbl | open database license | open database license
3 | ogl | open government licen | open government licen[cs]e
3 | llama | community license | llama(?: [0-9]){0,3} community license
3 | openrail | openrail | (?:creativeml |bigscience )?openrail
3 | cc0 | cc0 | cc0
3 | cc-by | cc by | cc by
3 | cc-by-sa | cc by sa | cc by sa
3 | cc-by-nc | cc by nc | cc by nc
3 | cc-by-nd | cc by nd | cc by nd
3 | cc-by-nc-sa | cc by nc sa | cc by nc sa
3 | cc-by-nc-nd | cc by nc nd | cc by nc nd
3 | cc-by | creative commons attribution | creative commons attribution(?: license)?
3 | cc | creative commons license | creative commons license
4 | public-domain | public domain | (?:released|dedicated|placed|is) (?:to|into|in) the public domain
4 | all-rights-reserved | all rights reserved | all rights reserved
4 | proprietary | proprietary and confidential | proprietary and confidential
4 | proprietary | unauthorized copying of this file | unauthorized copying of this file
4 | open-source | open source license | open source license
4 | permissive | permissive license | permissive license
4 | copyleft | copyleft | copyleft(?: license)?
4 | dual | dual licensed under | dual licensed under
4 | free-software | free software license | free software license
4 | unknown | ed under | licen[cs]ed under
4 | unknown | released under the | released under the [a-z0-9]{1,40} licen[cs]e
"""

BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
# Short literals, at least one of which every keyword holds: most texts hold none and are done after these.
ANCHORS = (" licen", "license", " spdx ", "gpl ", "gplv2", "gplv3", " apache ", " bsd", " mpl ", " permission is hereby", " permission to use copy",
           " redistribution and use", " endorse or promote", " advertising materials", " misrepresented", " free software you can",
           " unencumbered", " extent possible under law", " charityware", " good not evil", " includes software",
           " includes php", " third parties as a", " asl 2 0", " cecill", " mulan psl",
           " cc by", " cc0", " creativecommons", " creative commons", " openrail", " same terms as perl", " commons clause",
           " rights reserved", " proprietary and", " unauthorized copying", " copyleft", " public domain", "ed under ")

CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.3}


@dataclass(frozen=True)
class Rule:
    number: int
    priority: int
    label: str
    keyword: str
    pattern: str
    base: bool


def load() -> list[Rule]:
    """Base phrases first, then the table in its order."""
    base = [(0, label, phrase, phrase) for label, phrase in BASE.items()]
    lines = [tuple(x.strip() for x in line.split(" | ")) for line in TABLE.strip().splitlines()]
    return [Rule(i, int(p), label, keyword, pattern, int(p) == 0)
            for i, (p, label, keyword, pattern) in enumerate([*base, *lines])]
