"""Signature rules of the licence scan.

Every licence has a label and hand-written patterns; a pattern is tried where its longest plain text
occurs. Patterns are for normalised text: words in lower case with single blanks between them. Each pattern
gives five rules, from the most to the least telling: an identifier line, a grant ("licensed under
..."), the licence called by name ("... license") or by a label line ("license: ..."), and the bare name, which names in
``WORDS`` don't have, as they are words of ordinary language or of other things.
"""

from __future__ import annotations

import re

V = lambda n: rf"(?: ?version| ?ver| ?v)? ?{n}(?: 0)?"
LICENSES: list[tuple[str, list[str]]] = [
    ("mit", ["mit", "mit x11", "expat"]),
    ("mit-0", ["mit 0", "mit no attribution"]),
    ("apache-1", [rf"apache(?: software)?(?: license)?{V('1')}(?: 1)?"]),
    ("apache-2", [rf"apache(?: software)?(?: license)?{V('2')}", rf"asl{V('2')}"]),
    ("gpl-1", [rf"(?:gnu )?general public license{V('1')}", rf"(?:gnu )?gpl{V('1')}"]),
    ("gpl-2", [rf"(?:gnu )?general public license{V('2')}", rf"(?:gnu )?gpl{V('2')}"]),
    ("gpl-3", [rf"(?:gnu )?general public license{V('3')}", rf"(?:gnu )?gpl{V('3')}"]),
    ("lgpl-2", [rf"(?:gnu )?(?:lesser|library) general public license{V('2')}(?: 1)?", rf"(?:gnu )?lgpl{V('2')}(?: 1)?"]),
    ("lgpl-3", [rf"(?:gnu )?lesser general public license{V('3')}", rf"(?:gnu )?lgpl{V('3')}"]),
    ("agpl-3", [rf"(?:gnu )?affero general public license{V('3')}", rf"(?:gnu )?agpl{V('3')}"]),
    ("gfdl", ["(?:gnu )?free documentation license(?: version)?(?: 1 [123])?", "gfdl(?: 1 [123])?"]),
    ("bsd-0", ["0 ?bsd", "zero clause bsd"]),
    ("bsd-2", ["bsd 2(?: clause)?", "(?:2|two) clause bsd", "simplified bsd", "freebsd"]),
    ("bsd-3", ["bsd 3(?: clause)?", "(?:3|three) clause bsd", "(?:new|modified|revised) bsd"]),
    ("bsd-4", ["bsd 4(?: clause)?", "(?:4|four) clause bsd", "original bsd"]),
    ("isc", ["isc"]),
    ("mpl-1", [rf"mozilla public license{V('1')}(?: 1)?", rf"mpl{V('1')}(?: 1)?"]),
    ("mpl-2", [rf"mozilla public license{V('2')}", rf"mpl{V('2')}"]),
    ("epl-1", [rf"eclipse public license{V('1')}", rf"epl{V('1')}"]),
    ("epl-2", [rf"eclipse public license{V('2')}", rf"epl{V('2')}"]),
    ("edl-1", [rf"eclipse distribution license{V('1')}"]),
    ("cddl-1", [rf"common development and distribution license{V('1')}", rf"cddl{V('1')}(?: 1)?"]),
    ("cpl-1", [rf"common public license{V('1')}", rf"cpl{V('1')}"]),
    ("eupl", ["european union public licen[cs]e(?: v)?(?: 1 [12])?", "eupl(?: v)?(?: 1 [12])?"]),
    ("artistic-1", [rf"artistic license{V('1')}"]),
    ("artistic-2", [rf"artistic license{V('2')}"]),
    ("bsl-1", [rf"boost software license{V('1')}"]),
    ("zlib", ["zlib", "zlib libpng"]),
    ("libpng", ["libpng(?: version)?(?: 2)?"]),
    ("unlicense", ["unlicense"]),
    ("wtfpl", ["wtfpl", "do what the f(?:uck)? you want to public license"]),
    ("python", [rf"python software foundation license(?:{V('2')})?", "psf(?: license)?(?: 2)?"]),
    ("php-3", ["php license(?: version)?(?: 3)?(?: 01)?"]),
    ("ruby", ["ruby license"]),
    ("perl", ["same terms as perl(?: itself)?"]),
    ("openssl", ["openssl(?: license)?"]),
    ("postgresql", ["postgresql(?: license)?"]),
    ("ofl-1", ["sil open font license(?: version)?(?: 1 1)?", "open font license(?: version)?(?: 1 1)?", "ofl 1 1"]),
    ("odbl", ["open database license", "odbl(?: 1 0)?"]),
    ("odc-by", ["open data commons attribution", "odc by(?: 1 0)?"]),
    ("pddl", ["public domain dedication and license", "pddl(?: 1 0)?"]),
    ("cc0", ["cc0(?: 1 0)?(?: universal)?", "creative commons zero(?: v1 0)?"]),
    ("cc-by", ["cc by(?: [1234] [05])?", "creative commons attribution(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-sa", ["cc by sa(?: [1234] [05])?", "creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-nd", ["cc by nd(?: [1234] [05])?", "creative commons attribution no ?deriv(?:ative|ativ)?e?s?(?: [1234] [05])?"]),
    ("cc-by-nc", ["cc by nc(?: [1234] [05])?", "creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-nc-sa", ["cc by nc sa(?: [1234] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"]),
    ("cc-by-nc-nd", ["cc by nc nd(?: [1234] [05])?", "creative commons attribution non ?commercial no ?deriv(?:ative|ativ)?e?s?(?: [1234] [05])?"]),
    ("ms-pl", ["microsoft public license", "ms pl"]),
    ("ms-rl", ["microsoft reciprocal license", "ms rl"]),
    ("upl-1", [rf"universal permissive license{V('1')}", rf"upl{V('1')}"]),
    ("ncsa", ["university of illinois ncsa(?: open source)?", "ncsa"]),
    ("afl-3", [rf"academic free license{V('3')}", rf"afl{V('3')}"]),
    ("osl-3", [rf"open software license{V('3')}", rf"osl{V('3')}"]),
    ("qpl-1", [rf"q public license(?:{V('1')})?", rf"qpl{V('1')}"]),
    ("sleepycat", ["sleepycat"]),
    ("vim", ["vim license"]),
    ("x11", ["x11"]),
    ("hpnd", ["historical permission notice and disclaimer", "hpnd"]),
    ("w3c", ["w3c software(?: notice and)?"]),
    ("sspl-1", [rf"server side public license(?:{V('1')})?", rf"sspl{V('1')}"]),
    ("busl-1", ["business source license(?: 1 1)?", "busl 1 1"]),
    ("elastic-2", [rf"elastic license{V('2')}"]),
    ("commons-clause", ["commons clause"]),
    ("openrail", ["openrail(?: m| s)?", "creativeml openrail m"]),
    ("llama", ["llama(?: [23])? community license(?: agreement)?"]),
    ("beerware", ["beer ?ware"]),
    ("json", ["json license"]),
    ("curl", ["curl license"]),
    ("ecl-2", [rf"educational community license{V('2')}", rf"ecl{V('2')}"]),
    ("naist", ["naist(?: 2003)?"]),
    ("ipl-1", [rf"ibm public license{V('1')}"]),
    # families without a version: a longer name of a version that lies around them takes their place
    ("gpl", ["gnu gpl", "gpl", "gnu general public"]),
    ("lgpl", ["gnu lgpl", "lgpl", "gnu lesser general public"]),
    ("agpl", ["gnu agpl", "agpl", "(?:gnu )?affero general public license"]),
    ("bsd", ["bsd", "bsd style", "berkeley software distribution"]),
    ("mpl", ["mpl", "mozilla public license", "mozilla"]),
    ("epl", ["epl", "eclipse public license", "eclipse"]),
    ("cddl", ["cddl", "common development and distribution license"]),
    ("artistic", ["artistic license", "artistic"]),
    ("apache", ["apache software license", "apache"]),
    ("boost", ["boost software license", "boost"]),
    ("mit", ["mit style", "mit like"]),
    ("perl", ["perl 5", "perl"]),
    ("python", ["python"]),
    ("aladdin", ["aladdin free public license"]),
    ("amazon", ["amazon software license"]),
    ("apsl", [rf"apple public source license(?:{V('[12]')})?", rf"apsl{V('[12]')}"]),
    ("apl-1", [rf"adaptive public license(?:{V('1')})?"]),
    ("bitstream-vera", ["bitstream vera"]),
    ("blue-oak", ["blue oak model license(?: 1 0 0)?", "blueoak 1 0 0"]),
    ("cecill", ["cecill(?: b| c)?(?: 2 [01])?"]),
    ("cpal", [rf"common public attribution license(?:{V('1')})?", rf"cpal{V('1')}"]),
    ("cua", [rf"cua office public license(?:{V('1')})?"]),
    ("ecos", [rf"ecos license(?:{V('2')})?"]),
    ("efl", [rf"eiffel forum license(?:{V('[12]')})?"]),
    ("entessa", ["entessa"]),
    ("fair", ["fair"]),
    ("frameworx", ["frameworx"]),
    ("ftl", ["freetype project license", "freetype license"]),
    ("gl2ps", ["gl2ps license"]),
    ("ijg", ["independent jpeg group(?: s)? license"]),
    ("imagemagick", ["imagemagick"]),
    ("intel", ["intel open source"]),
    ("ipa", ["ipa font"]),
    ("jasper", ["jasper"]),
    ("lucent", [rf"lucent public license(?:{V('1')})?"]),
    ("miros", ["miros"]),
    ("motosoto", ["motosoto"]),
    ("mulan", ["mulan permissive software license", "mulanpsl(?: 2 0)?"]),
    ("multics", ["multics"]),
    ("nasa", ["nasa open source agreement(?: 1 3)?", "nasa"]),
    ("naumen", ["naumen"]),
    ("nosl", [rf"netizen open source license(?:{V('1')})?"]),
    ("npl", [rf"netscape public license(?:{V('1')})?(?: 1)?"]),
    ("npol", [rf"non profit open software license(?:{V('3')})?"]),
    ("oclc", [rf"oclc research public license(?:{V('2')})?"]),
    ("ogl", ["open government licen[cs]e(?: ?v)?(?: ?[123])?(?: 0)?"]),
    ("oset", ["oset public license"]),
    ("oldap", ["openldap public license(?: 2 [0-8])?", "openldap"]),
    ("parity", ["parity public license"]),
    ("polyform", ["polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use)(?: license)?(?: 1 0 0)?"]),
    ("rpl", [rf"reciprocal public license(?:{V('1')})?(?: [15])?"]),
    ("rpsl", [rf"realnetworks public source license(?:{V('1')})?"]),
    ("rscpl", ["ricoh source code public license"]),
    ("sgi-b", ["sgi free software license b(?: 2 0)?"]),
    ("simpl", [rf"simple public license(?:{V('2')})?"]),
    ("sissl", ["sun industry standards source license"]),
    ("spl", [rf"sun public license(?:{V('1')})?"]),
    ("tcl", ["tcl tk license", "tcl"]),
    ("unicode", ["unicode license agreement", "unicode"]),
    ("vsl", [rf"vovida software license(?:{V('1')})?"]),
    ("watcom", ["sybase open watcom public license", "watcom"]),
    ("wxwindows", ["wxwindows library licen[cs]e", "wxwindows"]),
    ("xnet", ["xnet"]),
    ("zend", ["zend engine license", "zend"]),
    ("zpl", [rf"zope public license(?:{V('2')})?(?: 1)?", "zope"]),
    ("lppl-1", [rf"latex project public license{V('1')}(?: 3[ac]?)?", rf"lppl{V('1')}(?: 3[ac]?)?"]),
]

#: Labels of licences whose versions have labels of their own.
FAMILIES = {"gpl", "lgpl", "agpl", "bsd", "mpl", "epl", "cddl", "artistic", "apache", "boost"}

#: Names that stand for a licence beside the word alone.
WORDS = {"mit", "expat", "artistic", "ruby", "perl", "vim", "json", "curl", "python", "apache", "boost", "eclipse", "mozilla", "x11", "glide", "intel", "info zip", "nokia", "plexus", "crossword", "docbook", "doc", "dotseqn", "entessa", "frameworx", "imagemagick", "jasper", "latex2e", "mup", "nasa", "net snmp", "nunit", "sendmail", "spencer", "tcl", "xpp", "zend", "zope", "unicode", "fsf all permissive", "intel open source", "ipa font", "bitstream vera", "bittorrent", "borceux", "caldera", "condor", "eurosym", "fair", "motosoto", "multics", "naumen", "watcom", "xnet"}

#: Notices that name no licence by themselves.
NOTICES: list[tuple[str, str, int]] = [
    ("public-domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 3),
    ("public-domain", "public domain", 1),
    ("all-rights-reserved", "all rights reserved", 1),
    ("copyright", "copyright(?: c)? [12][0-9]{3}(?: [12][0-9]{3})*", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 4),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("gpl", "general public license", 0),
    ("lgpl", "(?:lesser|library) general public license", 0),
    ("creative-commons", "creative commons(?: license)?", 0),
    ("warranty-disclaimer", "without warranty of any kind", 1),
    ("proprietary", "proprietary and confidential", 3),
]

GRANT = "(?:licensed|released|distributed|available|provided|published|covered|redistributed) (?:under|by|according to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


def keyword(pattern: str) -> str:
    """The longest plain text that each match of ``pattern`` holds."""
    plain = pattern
    while (shorter := re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]\??|[a-z0-9 ]\?|\{\d\}|\*", "|", plain)) != plain:
        plain = shorter
    return max(re.split(r"\|", plain), key=len).strip()


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, priority) in the order in which ties are resolved."""
    made = []
    for label, patterns in LICENSES:
        for p in patterns:
            made.append((label, keyword(p), f"spdx license identifier {p}", 5))
            made.append((label, keyword(p), f"{GRANT}{p}(?: licen[cs]e)?", 4))
            named = 2 if label in FAMILIES else 3  # a versioned name around it is at least as telling
            made.append((label, keyword(p), f"(?:the )?{p} licen[cs]e", named))
            made.append((label, keyword(p), f"licen[cs]es? {p}", named))
            if p not in WORDS:
                made.append((label, keyword(p), p, named - 1))
    return [*made, *((label, keyword(p), p, priority) for label, p, priority in NOTICES)]
