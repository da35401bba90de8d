"""License scans by sentence rules.

A text is cut into sentences, each normalised to its lower-case letters and digits; known sentences get their
identifiers, and the sequence of a document's identifiers is matched against ordered rules. Of rules that match
in one place the longest counts. A sentence that isn't known gets the identifier of the known one that it is near
to: an inverted index over the known sentences' five-word shingles gives the candidates. Sentences and rules are
parameters; those here are the texts and notices of common public licences, and references to them, which are built
from names and phrases.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabulon.llm.common import BLANK, small, text_of

# Sentences of public licences and notices, normalised.
TEXTS = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2-grant", "licensed under the apache license version 2 0 the license"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2-copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("apache-2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2-limits", "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-liability", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense-domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mpl-2-terms", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("epl-2-terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("bsl-1-reference", "distributed under the boost software license version 1 0"),
    ("gnu-received", "if not see https www gnu org licenses"),
    ("gnu-received", "if not see http www gnu org licenses"),
    ("all-rights", "all rights reserved"),
    ("mit-0-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("ncsa-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("x11-name", "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium"),
    ("json-good", "the software shall be used for good not evil"),
    ("apache-2-title", "apache license version 2 0 january 2004 http www apache org licenses"),
    ("apache-2-title", "apache license version 2 0 january 2004"),
    ("apache-2-terms", "terms and conditions for use reproduction and distribution"),
    ("apache-2-means", "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"),
    ("apache-2-licensor", "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license"),
    ("gnu-verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2-title", "gnu general public license version 2 june 1991"),
    ("gpl-2-applies", "this general public license applies to most of the free software foundation s software and to any other program whose authors commit to using it"),
    ("gpl-3-title", "gnu general public license version 3 29 june 2007"),
    ("gpl-3-preamble", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3-designed", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("lgpl-2.1-title", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.1-first", "this is the first released version of the lesser gpl"),
    ("lgpl-3-title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-3-incorporates", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("agpl-3-title", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3-preamble", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl-1.3-grant", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation"),
    ("fsfap-grant", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("psf-between", "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation"),
    ("psf-grant", "subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly prepare derivative works distribute and otherwise use python alone or in any derivative version"),
    ("cc0-laws", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s each and all an owner of an original work of authorship and or a database each a work"),
    ("mpl-2-covered", "covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory including without limitation warranties that the covered software is free of defects merchantable fit for a particular purpose or non infringing"),
    ("epl-accompanying", "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl-acceptance", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("bsl-1-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("artistic-2-establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("wtfpl-copy", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("0bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("postgresql-grant", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ofl-1.1-terms", "this font software is licensed under the sil open font license version 1 1"),
    ("eupl-applies", "this european union public licence the eupl applies to the work as defined below which is provided under the terms of this licence"),
    ("cddl-1-terms", "the contents of this file are subject to the terms of the common development and distribution license the license"),
    ("ms-pl-governs", "this license governs use of the accompanying software"),
    ("ms-pl-accept", "if you use the software you accept this license"),
    ("openssl-includes", "this product includes software developed by the openssl project for use in the openssl toolkit http www openssl org"),
    ("afl-3-terms", "licensed under the academic free license version 3 0"),
    ("osl-3-terms", "licensed under the open software license version 3 0"),
    ("upl-1-title", "the universal permissive license upl version 1 0"),
    ("blue-oak-purpose", "this license gives everyone as much permission to work with this software as possible while protecting contributors from liability"),
    ("beerware-retain", "as long as you retain this notice you can do whatever you want with this stuff"),
]

# Rules in their order, with the licence that each tells of.
TEXT_RULES = [
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("mit-text-short", "MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("apache-2-header", "Apache-2.0", ["apache-2-grant", "apache-2-comply", "apache-2-copy", "apache-2-as-is", "apache-2-limits"]),
    ("apache-2-header-short", "Apache-2.0", ["apache-2-grant", "apache-2-comply"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    ("bsd-3-conditions", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("bsd-2-conditions", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("isc-grant", "ISC", ["isc-grant"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("unlicense-text", "Unlicense", ["unlicense-domain", "unlicense-grant"]),
    ("unlicense-domain", "Unlicense", ["unlicense-domain"]),
    ("mpl-2-header", "MPL-2.0", ["mpl-2-terms", "mpl-2-copy"]),
    ("mpl-2-terms", "MPL-2.0", ["mpl-2-terms"]),
    ("epl-2-terms", "EPL-2.0", ["epl-2-terms"]),
    ("bsl-1-reference", "BSL-1.0", ["bsl-1-reference"]),
    ("all-rights-reserved", "Proprietary", ["all-rights"]),
    ("mit-0-grant", "MIT-0", ["mit-0-grant"]),
    ("ncsa-grant", "NCSA", ["ncsa-grant"]),
    ("x11-text", "X11", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability", "x11-name"]),
    ("x11-name", "X11", ["x11-name"]),
    ("json-text", "JSON", ["mit-grant", "mit-notice", "json-good"]),
    ("apache-2-text", "Apache-2.0", ["apache-2-title", "apache-2-terms"]),
    ("apache-2-title", "Apache-2.0", ["apache-2-title"]),
    ("apache-2-definitions", "Apache-2.0", ["apache-2-means", "apache-2-licensor"]),
    ("apache-2-means", "Apache-2.0", ["apache-2-means"]),
    ("gpl-2-title", "GPL-2.0", ["gpl-2-title"]),
    ("gpl-2-preamble", "GPL-2.0", ["gpl-2-applies"]),
    ("gpl-3-title", "GPL-3.0", ["gpl-3-title"]),
    ("gpl-3-text", "GPL-3.0", ["gnu-verbatim", "gpl-3-preamble", "gpl-3-designed"]),
    ("gpl-3-preamble-and-purpose", "GPL-3.0", ["gpl-3-preamble", "gpl-3-designed"]),
    ("gpl-3-preamble", "GPL-3.0", ["gpl-3-preamble"]),
    ("lgpl-2.1-title", "LGPL-2.1", ["lgpl-2.1-title"]),
    ("lgpl-2.1-text", "LGPL-2.1", ["gnu-verbatim", "lgpl-2.1-first"]),
    ("lgpl-2.1-first", "LGPL-2.1", ["lgpl-2.1-first"]),
    ("lgpl-3-title", "LGPL-3.0", ["lgpl-3-title"]),
    ("lgpl-3-incorporates", "LGPL-3.0", ["lgpl-3-incorporates"]),
    ("agpl-3-title", "AGPL-3.0", ["agpl-3-title"]),
    ("agpl-3-preamble", "AGPL-3.0", ["agpl-3-preamble"]),
    ("gfdl-1.3-grant", "GFDL-1.3-or-later", ["gfdl-1.3-grant"]),
    ("fsfap-grant", "FSFAP", ["fsfap-grant"]),
    ("psf-text", "PSF-2.0", ["psf-between", "psf-grant"]),
    ("psf-between", "PSF-2.0", ["psf-between"]),
    ("psf-grant", "PSF-2.0", ["psf-grant"]),
    ("cc0-laws", "CC0-1.0", ["cc0-laws"]),
    ("mpl-2-covered", "MPL-2.0", ["mpl-2-covered"]),
    ("epl-text", "EPL", ["epl-accompanying", "epl-acceptance"]),
    ("epl-accompanying", "EPL", ["epl-accompanying"]),
    ("bsl-1-grant", "BSL-1.0", ["bsl-1-grant"]),
    ("artistic-2-establishes", "Artistic-2.0", ["artistic-2-establishes"]),
    ("wtfpl-copy", "WTFPL", ["wtfpl-copy"]),
    ("0bsd-grant", "0BSD", ["0bsd-grant"]),
    ("bsd-4-conditions", "BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("postgresql-grant", "PostgreSQL", ["postgresql-grant"]),
    ("ofl-1.1-terms", "OFL-1.1", ["ofl-1.1-terms"]),
    ("eupl-applies", "EUPL", ["eupl-applies"]),
    ("cddl-1-terms", "CDDL-1.0", ["cddl-1-terms"]),
    ("ms-pl-text", "MS-PL", ["ms-pl-governs", "ms-pl-accept"]),
    ("openssl-includes", "OpenSSL", ["openssl-includes"]),
    ("afl-3-terms", "AFL-3.0", ["afl-3-terms"]),
    ("osl-3-terms", "OSL-3.0", ["osl-3-terms"]),
    ("upl-1-title", "UPL-1.0", ["upl-1-title"]),
    ("blue-oak-purpose", "BlueOak-1.0.0", ["blue-oak-purpose"]),
    ("beerware-retain", "Beerware", ["beerware-retain"]),
]

# How licences are called.
NAMES = [
    ("MIT", ["mit license", "mit licence"]), ("Apache-2.0", ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0"]),
    ("BSD", ["bsd license"]), ("BSD-2-Clause", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"]), ("BSD-3-Clause", ["bsd 3 clause license", "3 clause bsd license", "new bsd license"]),
    ("GPL-2.0", ["gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2", "gplv2"]), ("GPL-3.0", ["gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3", "gplv3"]),
    ("LGPL-2.1", ["gnu lesser general public license version 2 1", "gnu lgpl v2 1"]), ("LGPL-3.0", ["gnu lesser general public license version 3", "gnu lgpl v3"]), ("AGPL-3.0", ["gnu affero general public license version 3", "gnu agpl v3"]),
    ("MPL-2.0", ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"]), ("EPL-2.0", ["eclipse public license 2 0", "eclipse public license version 2 0"]), ("ISC", ["isc license"]), ("Zlib", ["zlib license"]),
    ("BSL-1.0", ["boost software license"]), ("Unlicense", ["unlicense"]), ("CC0-1.0", ["cc0 1 0 universal", "cc0 1 0", "creative commons zero v1 0 universal license"]), ("WTFPL", ["wtfpl"]),
]
PHRASES = ["licensed under", "released under", "distributed under", "available under"]
SUBJECTS = ["this project is", "this work is", "this software is"]
CC_PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
CC_KINDS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
GNU = [("GPL", "gnu general public license", ["2", "3"]), ("LGPL", "gnu lesser general public license", ["2 1", "3"]), ("AGPL", "gnu affero general public license", ["3"])]
SPDX = ["MIT", "MIT-0", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "WTFPL", "CC0-1.0", "Artistic-2.0"]


def spelled(name: str) -> str:
    """A name as sentences are normalised."""
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def known_tables() -> tuple[list[tuple[str, str]], list[tuple[str, str, list[str]]]]:
    """(sentence identifier, words) and (rule, licence, identifiers): the texts, and what names, phrases and versions give."""
    sentences, rules = {w: s for s, w in TEXTS}, list(TEXT_RULES)

    def add(identifier: str, words: str) -> None:
        sentences.setdefault(words, identifier)

    names = {k: list(v) for k, v in NAMES}
    for kind in CC_KINDS:
        for version in ("3.0", "4.0"):
            long = " ".join(CC_PARTS[x] for x in kind.split("-"))
            names[f"CC-{kind.upper()}-{version}"] = [f"cc {spelled(kind)} {spelled(version)}", f"creative commons {long} {spelled(version)} international license", f"creative commons {long} {spelled(version)} license"]
        long = " ".join(CC_PARTS[x] for x in kind.split("-"))
        key = f"cc-{kind}-4.0-accept"
        rules.append((key, f"CC-{kind.upper()}-4.0", [key]))
        add(key, f"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons {long} 4 0 international public license public license")
    for licence, called in names.items():
        key = f"{licence.lower()}-reference"
        rules.append((key, licence, [key]))
        for name in called:
            for phrase in PHRASES:
                for subject in ("", *SUBJECTS):
                    add(key, f"{subject} {phrase} {name}".strip())
                    add(key, f"{subject} {phrase} the {name}".strip())
    for short, name, versions in GNU:
        add(f"{short.lower()}-details", f"see the {name} for more details")
        for version in versions:
            number = version.replace(" ", ".") if " " in version else f"{version}.0"
            for which, kind in ((f"version {version} of the license", "only"), (f"either version {version} of the license or at your option any later version", "or-later")):
                key = f"{short.lower()}-{number}-{kind}"
                for work in ("program", "library", "software", "file"):
                    add(key, f"this {work} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation {which}")
                licence = f"{short}-{number}-{kind}"
                rules += [(f"{key}-notice", licence, [key, "gnu-hope", f"{short.lower()}-details"]), (f"{key}-grant", licence, [key])]
                rules.append((f"{licence.lower()}-spdx", licence, [f"spdx-{licence.lower()}"]))
                add(f"spdx-{licence.lower()}", f"spdx license identifier {spelled(licence)}")
    for work in ("program", "library", "software", "file"):
        add("gnu-hope", f"this {work} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose")
    for licence in [*SPDX, *(f"CC-{k.upper()}-4.0" for k in CC_KINDS)]:
        rules.append((f"{licence.lower()}-spdx", licence, [f"spdx-{licence.lower()}"]))
        add(f"spdx-{licence.lower()}", f"spdx license identifier {spelled(licence)}")
    return [(s, w) for w, s in sentences.items()], rules


SENTENCES, RULES = known_tables()


GRAM = 5  # words of a shingle
NEAR = 80  # per cent of the shingles of two sentences that both have, for them to be near


def grams(words: str) -> list[str]:
    """The different shingles of a sentence, in their order; one of fewer words has none, so nothing is near it."""
    w = words.split()
    return list(dict.fromkeys(" ".join(w[k : k + GRAM]) for k in range(len(w) - GRAM + 1)))


def _covering(texts: set[str], least: int = 6) -> list[str]:
    """Few words, one of which is in each text: of `least` letters, or its longest."""
    left, chosen = set(texts), []
    while left:
        counts: Counter[str] = Counter()
        for words in left:
            parts = words.split()
            counts.update({p for p in parts if len(p) >= least} or {max(parts, key=len)})
        best = max(sorted(counts), key=counts.get)
        chosen.append(best)
        left = {w for w in left if best not in w}
    return chosen


def probes(sentences: list[tuple[str, str]], near: int = NEAR) -> list[tuple[str, str]]:
    """(shingle, words): the inverted index. Of a sentence's n shingles a near one has near % at least, so one of any n - that + 1 is in it.

    Those are taken that hold a word of `hints` anyway, then those with the longest words, which other texts seldom have.
    """
    told, counts = _covering({w for _, w in sentences}), Counter(g for _, w in sentences for g in grams(w))
    found = []
    for _, words in sentences:
        of = sorted(grams(words), key=lambda g: (not any(x in g for x in told), -max(map(len, g.split())), counts[g], g))
        found += [(g, words) for g in of[: len(of) + near * len(of) // -100 + 1]]
    return found


def hints(sentences: list[tuple[str, str]], near: int | None = NEAR) -> str:
    """A pattern of few words: a lower-cased text without any can't hold a known sentence, or (unless near is None) one that is near it."""
    told = _covering({w for _, w in sentences})
    if near is not None:
        told += _covering({g for g, _ in probes(sentences, near) if not any(x in g for x in told)}, 8)
    return "|".join(told)


SENTENCE_END = f"[.!?:;]+[{BLANK}]+"
#: For cutting 3: a sentence end as marked, or lines without letters and digits.
BLANK_LINE = "\u0001|\n[^A-Za-z0-9\u0001\n]*\n"
SPAN = 3  # parts of a known sentence at most, if it is given without its marks


def span_of(sentences: list[tuple[str, str]]) -> int:
    """Into how many parts a known sentence may be cut: as many as its own marks make where it is given with them, `SPAN` at least."""
    return max([SPAN, *(len(re.split(r"[.!?:;]+[\x20\x09-\x0D]+", w.strip())) for _, w in sentences)])


def _holds(text: Column, told: list[str]) -> Column:
    """Whether a text holds one of a few words: plain searches, as an alternation of them would be tried in each place."""
    return F.exists(F.array(text), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in told], F.lit(False)))  # an array of one, so that the text is made once


def _asking(words: Column, told: list[str]) -> Column:
    """The different shingles of `words` that hold one of the words `told`, as each of `probes` does."""
    some = lambda w, held: F.filter(F.transform(w, lambda x, i: F.when(F.exists(F.slice(held, i + 1, GRAM), lambda y: y), F.slice(w, i + 1, GRAM))), lambda g: F.size(g) == GRAM)
    of = lambda w: F.transform(F.array(F.transform(w, lambda x: _holds(x, told))), lambda held: F.transform(some(w, held), lambda g: F.array_join(g, " ")))
    return F.array_distinct(F.get(F.get(F.transform(F.array(F.split(words, " ")), of), 0), 0))


def _shingles(words: Column) -> Column:
    begins = lambda w: F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - GRAM + 1, F.lit(1))), lambda i: i + GRAM - 1 <= F.size(w))
    of = lambda w: F.transform(begins(w), lambda i: F.array_join(F.slice(w, i, GRAM), " "))
    return F.array_distinct(F.get(F.transform(F.array(F.split(words, " ")), of), 0))  # an array of one, so that the words are split once, not for each shingle


def _numbers(words: Column) -> Column:
    return F.filter(F.split(words, " "), lambda x: x.rlike("[0-9]"))


def sentence_ids(docs: DataFrame, sentences: list[tuple[str, str]] | None = None, near: int | None = NEAR) -> DataFrame:
    """doc_id, row, cutting, at, last (the numbers of its first and last part), sentence, score: the known sentences of each row of `docs`.

    cutting 1 takes line ends and sentence ends as ends of a part; cutting 2 sentence ends only, for texts whose
    sentences run over lines; cutting 3 sentence ends and lines without letters and digits, so that a heading
    above a wrapped text stays apart. A known sentence may have marks inside: neighbouring parts (`span_of`) make
    one. An identifier takes the place of each known sentence. `sentences` are (identifier, words), of which equal
    ones get the first's identifier.

    score is 2 for the words of a known sentence. Parts with other words are near a known sentence of 80 to 125 % as
    many words and the same numbers in the same order, if `near` % of the shingles of both are common; of several
    the most similar counts, then the first in the alphabet, and score is the similarity. None: no near ones.
    """
    spark = docs.sparkSession
    sentences = SENTENCES if sentences is None else sentences
    span = span_of(sentences)
    spelt: dict[str, str] = {}
    for name, w in sentences:
        spelt.setdefault(spelled(w), name)
    sentences = [(name, w) for w, name in spelt.items() if w]
    known = small(spark.createDataFrame(sentences, "sentence string, words string"))
    told = [x for x in hints(sentences, near).split("|") if x]
    hinted = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).filter(_holds(F.lower("text"), told))
    marked = F.regexp_replace("text", SENTENCE_END, "\u0001")
    by_line = F.split(F.regexp_replace(marked, "[\u0001\n]", "\n"), "\n")
    cuttings = F.array(*[F.struct(F.lit(k).alias("cutting"), c.alias("parts")) for k, c in enumerate((by_line, F.split(marked, "\u0001"), F.split(marked, BLANK_LINE)), 1)])
    # the id numbers rows that share a doc_id; a checkpoint isn't needed, as it is used in one pass
    rows = hinted.withColumn("row", F.xxhash64("text")).select("doc_id", "row", F.inline(cuttings))
    parts = rows.withColumn("parts", F.transform("parts", lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))))
    parts = parts.withColumn("held", F.transform("parts", lambda x: _holds(x, told)))
    # whole runs are made inside the row, so that no list of parts is repeated for each of them; runs that begin or end in an empty part would repeat a shorter run,
    # and a hint is a piece of one word, so runs without a part that holds one are neither known nor near
    hint_in = lambda i, j: F.exists(F.slice("held", i + 1, j - i + 1), lambda x: x)
    words = lambda i, j: F.array_join(F.filter(F.slice("parts", i + 1, j - i + 1), lambda x: x != ""), " ")
    ends = lambda i: F.filter(F.sequence(i, F.least(i + span, F.size("parts")) - 1), lambda j: (F.get("parts", j) != "") & hint_in(i, j))
    begins = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: (F.get("parts", i) != "") & hint_in(i, i + span - 1))
    runs = F.flatten(F.transform(begins, lambda i: F.transform(ends(i), lambda j: F.struct(i.alias("at"), j.alias("last"), words(i, j).alias("words")))))
    named = parts.select("doc_id", "row", "cutting", F.inline(runs)).join(known, "words", "left")
    place = ["doc_id", "row", "cutting", "at", "last"]
    exact = F.col("sentence").isNotNull()
    sizes = [len(w.split()) for _, w in sentences if grams(w)]
    if near is None or not sizes:
        return named.filter(exact).select(*place, "sentence", F.lit(2.0).alias("score")).distinct()
    # only parts that could be near are cut into shingles; each shingle asks the index, and what it finds is compared once
    n = F.size(F.split("words", " "))
    could = n.between((80 * min(sizes) + 99) // 100, 125 * max(sizes) // 100) & (n >= GRAM)
    asked = named.filter(exact | could).select(*place, "words", "sentence", F.explode(F.when(exact, F.array(F.lit(""))).otherwise(_asking(F.col("words"), told))).alias("gram"))
    index = small(spark.createDataFrame(probes(sentences, near), "gram string, like string"))
    pairs = asked.join(index, "gram", "left").filter(exact | F.col("like").isNotNull()).select(*place, "words", "sentence", "like").distinct()
    listed = small(spark.createDataFrame([(name, w) for name, w in sentences if grams(w)], "name string, like string"))
    met = pairs.join(listed, "like", "left")
    both = F.size(F.array_intersect(_shingles(F.col("words")), _shingles(F.col("like"))))
    either = F.size(_shingles(F.col("words"))) + F.size(_shingles(F.col("like"))) - both
    alike = met.filter(exact | (F.size(F.split("like", " ")) * 80 <= n * 100) & (n * 100 <= F.size(F.split("like", " ")) * 125) & (_numbers(F.col("words")) == _numbers(F.col("like"))))
    scored = alike.select(*place, "like", F.coalesce("sentence", "name").alias("name"), F.when(exact, 1).otherwise(both).alias("both"), F.when(exact, 1).otherwise(either).alias("either"), F.when(exact, 2.0).otherwise(both / either).alias("score"))
    best = scored.filter(F.col("both") * 100 >= F.col("either") * near).groupBy(*place).agg(F.min(F.struct((-F.col("score")).alias("less"), "like", "name")).alias("best"))
    return best.select(*place, F.col("best.name").alias("sentence"), (-F.col("best.less")).alias("score"))


def _outermost(seq: Column, span: int) -> Column:
    """The sentences of `seq` (in order of their first parts): known ones that are not inside a longer one, and near ones that share no part with a known one or a nearer one, of equally near ones the first and shortest."""
    around = 2 * span * span + 1  # further ones share no part
    close = lambda i: F.slice(seq, F.greatest(i - span * span, F.lit(0)) + 1, around)
    inside = lambda s, o: (s["score"] == 2) & (o["score"] == 2) & (o["at"] <= s["at"]) & (o["last"] >= s["last"]) & (o["last"] - o["at"] > s["last"] - s["at"])
    before = lambda s, o: (o["at"] < s["at"]) | (o["at"] == s["at"]) & (o["last"] < s["last"])
    beaten = lambda s, o: (s["score"] < 2) & (o["at"] <= s["last"]) & (o["last"] >= s["at"]) & ((o["score"] > s["score"]) | (o["score"] == s["score"]) & before(s, o))
    return F.filter(seq, lambda s, i: ~F.exists(close(i), lambda o: inside(s, o) | beaten(s, o)))


def licenses(docs: DataFrame, gap: int = 2, sentences: list[tuple[str, str]] | None = None, rules: list[tuple[str, str, list[str]]] | None = None, near: int | None = NEAR) -> DataFrame:
    """A row for each place in which a document tells of a licence: doc_id, license, rule, place (its first sentence's number), n_sentences.

    A rule matches identifiers that follow each other in its order, with less than `gap` other parts between
    two. A match inside a longer one doesn't count. For each licence, the cutting counts that shows most sentences of
    it, the first if equal. A row that is repeated counts once; rows that share a doc_id but not the text each count.
    Null and empty texts have none; an empty table gives no rows. Other columns are not read. `sentences`
    (identifier, words) and `rules` (name, licence, identifiers) may be others than the tables here. `near` as in
    `sentence_ids`.
    """
    spark = docs.sparkSession
    rules = RULES if rules is None else rules
    longest = max((len(r[2]) for r in rules), default=1)
    listed = spark.createDataFrame([(*r, r[2][0]) for r in rules], "rule string, license string, ids array<string>, first string")
    found = sentence_ids(docs, sentences, near).groupBy("doc_id", "row", "cutting").agg(F.array_sort(F.collect_list(F.struct("at", "last", "sentence", "score"))).alias("seq"))
    found = found.withColumn("seq", _outermost(F.col("seq"), span_of(SENTENCES if sentences is None else sentences)))
    # as many sentences as a rule may have, not all, go with each
    ahead = F.transform("seq", lambda x, k: F.struct(k.alias("k"), x["at"].alias("place"), x["sentence"].alias("first"), F.slice("seq", k + 1, longest).alias("ahead")))
    placed = found.select("doc_id", "row", "cutting", F.inline(ahead))
    window = F.slice("ahead", F.lit(1), F.size("ids"))
    near = F.forall(F.sequence(F.lit(1), F.size("ids")), lambda i: (i == 1) | (F.get(window, i - 1)["at"] - F.get(window, i - 2)["last"] <= gap))
    matched = placed.join(F.broadcast(listed), "first").filter((F.transform(window, lambda s: s["sentence"]) == F.col("ids")) & near)
    spans = matched.select("doc_id", "row", "cutting", "license", "rule", "place", "k", (F.col("k") + F.size("ids")).alias("past"))
    # a longer match starts earlier, or at the same place and ends later
    order = W.partitionBy("doc_id", "row", "cutting").orderBy("k", F.desc("past"), "rule")
    furthest = F.max("past").over(order.rowsBetween(W.unboundedPreceding, -1))
    outer = spans.withColumn("before", F.coalesce(furthest, F.lit(0))).filter(F.col("past") > F.col("before"))
    n = (F.col("past") - F.col("k")).alias("n_sentences")
    hits = outer.groupBy("doc_id", "row", "license", "cutting").agg(F.sum(n).alias("n"), F.collect_list(F.struct("rule", "place", n)).alias("hits"))
    best = hits.groupBy("doc_id", "row", "license").agg(F.max(F.struct("n", (-F.col("cutting")).alias("c"), "hits")).alias("best"))
    return best.select("doc_id", "license", F.inline("best.hits"))


def _values(rows: list[tuple]) -> str:
    text = lambda x: "[" + ", ".join(map(text, x)) + "]" if isinstance(x, list) else str(x) if isinstance(x, int) else f"'{x}'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


ORACLE = rf"""
WITH known(sentence, words) AS (VALUES {_values(SENTENCES)}),
rules(rule, license, ids) AS (VALUES {_values(RULES)}),
marked AS (
  SELECT doc_id, hash(text) AS r, regexp_replace(text, '{SENTENCE_END}', chr(1), 'g') AS t FROM documents
), cuts AS (
  SELECT doc_id, r, 1 AS c, string_split(replace(t, chr(1), chr(10)), chr(10)) AS parts FROM marked
  UNION ALL SELECT doc_id, r, 2, string_split(t, chr(1)) FROM marked
  UNION ALL SELECT doc_id, r, 3, string_split(regexp_replace(t, '\n[^A-Za-z0-9\x01\n]*\n', chr(1), 'g'), chr(1)) FROM marked
), lists AS (
  SELECT DISTINCT doc_id, r, c, list_transform(parts, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS ps FROM cuts
), parts AS (
  SELECT doc_id, r, c, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS place FROM lists
), ahead AS (
  SELECT *, lead(p) OVER w AS q, lead(p, 2) OVER w AS s FROM parts WINDOW w AS (PARTITION BY doc_id, r, c ORDER BY place)
), runs AS (
  SELECT doc_id, r, c, place, place AS past_place, p AS words FROM ahead WHERE p != ''
  UNION ALL SELECT doc_id, r, c, place, place + 1, p || ' ' || q FROM ahead WHERE p != '' AND q != ''
  UNION ALL SELECT doc_id, r, c, place, place + 2, concat_ws(' ', p, nullif(q, ''), s) FROM ahead WHERE p != '' AND s != ''
), texts AS (
  SELECT words, string_split(words, ' ') AS ws FROM (SELECT DISTINCT words FROM runs WHERE words NOT IN (SELECT words FROM known))
), sized AS (
  SELECT words, len(ws) AS n, list_filter(ws, lambda x: regexp_matches(x, '[0-9]')) AS numbers, ws FROM texts WHERE len(ws) BETWEEN {GRAM} AND 200
), likes AS (
  SELECT sentence, words, string_split(words, ' ') AS ws FROM known
), shingles AS (
  SELECT DISTINCT words, unnest(list_transform(range(1, len(ws) - {GRAM - 2}), lambda i: array_to_string(ws[i:i + {GRAM - 1}], ' '))) AS g FROM sized
), known_shingles AS (
  SELECT DISTINCT words AS w, unnest(list_transform(range(1, len(ws) - {GRAM - 2}), lambda i: array_to_string(ws[i:i + {GRAM - 1}], ' '))) AS g FROM likes
), shared AS (
  SELECT words, w, count(*) AS common FROM shingles JOIN known_shingles USING (g) GROUP BY ALL
), n_shingles AS (SELECT words, count(*) AS n FROM shingles GROUP BY words
), n_known AS (SELECT w, count(*) AS n FROM known_shingles GROUP BY w
), alike AS (
  SELECT words, sentence, common / (a.n + b.n - common) AS score FROM shared JOIN n_shingles a USING (words) JOIN n_known b USING (w)
  JOIN sized s USING (words) JOIN likes k ON k.words = w
  WHERE common * 100 >= (a.n + b.n - common) * {NEAR} AND len(k.ws) * 80 <= s.n * 100 AND s.n * 100 <= len(k.ws) * 125
    AND s.numbers = list_filter(k.ws, lambda x: regexp_matches(x, '[0-9]'))
  QUALIFY row_number() OVER (PARTITION BY words ORDER BY score DESC, w) = 1
), ids AS (
  SELECT DISTINCT doc_id, r, c, place, past_place, sentence, score FROM runs JOIN (SELECT words, sentence, 2.0::DOUBLE AS score FROM known UNION ALL FROM alike) USING (words)
), outermost AS (
  SELECT * FROM ids s WHERE NOT EXISTS (SELECT 1 FROM ids o WHERE o.doc_id = s.doc_id AND o.r = s.r AND o.c = s.c AND (
    (s.score = 2 AND o.score = 2 AND o.place <= s.place AND o.past_place >= s.past_place AND o.past_place - o.place > s.past_place - s.place)
    OR (s.score < 2 AND o.place <= s.past_place AND o.past_place >= s.place AND (o.score > s.score OR o.score = s.score AND (o.place, o.past_place) < (s.place, s.past_place)))))
), seqs AS (
  SELECT doc_id, r, c, list(sentence ORDER BY place, past_place, sentence) AS seq, list(place ORDER BY place, past_place, sentence) AS locs,
    list(past_place ORDER BY place, past_place, sentence) AS ends FROM outermost GROUP BY ALL
), places AS (
  SELECT *, unnest(range(1, len(seq) + 1)) AS k FROM seqs
), spans AS (
  SELECT doc_id, r, c, license, rule, locs[k] AS place, k, k + len(ids) AS past FROM places JOIN rules ON seq[k] = ids[1] AND seq[k:k + len(ids) - 1] = ids
  WHERE len(list_filter(range(k + 1, k + len(ids)), lambda i: locs[i] - ends[i - 1] > 2)) = 0
), hits AS (
  SELECT * FROM spans
  QUALIFY past > coalesce(max(past) OVER (PARTITION BY doc_id, r, c ORDER BY k, past DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
), best AS (
  SELECT doc_id, r, license, c FROM hits GROUP BY doc_id, r, license, c
  QUALIFY row_number() OVER (PARTITION BY doc_id, r, license ORDER BY sum(past - k) DESC, c) = 1
)
SELECT doc_id, license, rule, place::INT AS place, (past - k)::INT AS n_sentences FROM hits JOIN best USING (doc_id, r, license, c)
"""
