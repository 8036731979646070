"""License scan.

One Aho-Corasick automaton finds identifier tags and the notice phrases of
known licenses in lower-cased text whose white space is single blanks; of
overlapping matches the leftmost longest counts, and a phrase must stand
between non-word characters.  The expression after a tag is read by a
shunting-yard parser (``WITH`` binds before ``AND``, that before ``OR``;
parentheses) to reverse Polish form and evaluated: ``OR`` takes the freer side,
``AND`` the stricter, ``WITH`` an exception lowers strong copyleft to weak.
All findings of a document hold together (``AND``).

Defined results: documents with a null text, an empty one or without findings
have no row.  An expression that can't be read is ``LicenseRef-unreadable``,
an unknown identifier stays as it is; both are of category ``unknown``.  After
an operator in capitals any word is an identifier; at a tag's start and after
other operators a word that isn't on the SPDX list is prose where more follows.
An expression goes on in the next line after an operator or within parentheses;
a comment's mark before it doesn't count.  Identifiers with a version count as
notices outside tags, too, and what a tag's expression names counts there alone.
Texts of any length are read whole; equal findings count once.  Each row of ``docs`` is scanned for itself, so
repeated rows repeat and a null doc_id stays null.  Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K

#: From free to strict.
CATEGORIES = ("public-domain", "permissive", "weak-copyleft", "copyleft", "restricted", "unknown")

LICENSES = {
    "CC0-1.0": 0, "Unlicense": 0, "0BSD": 0,
    "MIT": 1, "Apache-2.0": 1, "BSD-2-Clause": 1, "BSD-3-Clause": 1, "ISC": 1, "Zlib": 1, "BSL-1.0": 1, "CC-BY-4.0": 1, "CC-BY-3.0": 1,
    "LGPL-2.1-only": 2, "LGPL-2.1-or-later": 2, "LGPL-3.0-only": 2, "LGPL-3.0-or-later": 2, "MPL-2.0": 2, "EPL-2.0": 2, "CC-BY-SA-4.0": 2,
    "GPL-2.0-only": 3, "GPL-2.0-or-later": 3, "GPL-3.0-only": 3, "GPL-3.0-or-later": 3, "AGPL-3.0-only": 3, "AGPL-3.0-or-later": 3,
    "CC-BY-NC-4.0": 4, "CC-BY-ND-4.0": 4, "CC-BY-NC-SA-4.0": 4, "CC-BY-NC-ND-4.0": 4,
}
_BY_LOWER = {k.lower(): k for k in LICENSES} | {"gpl-2.0": "GPL-2.0-only", "gpl-3.0": "GPL-3.0-only", "lgpl-2.1": "LGPL-2.1-only", "lgpl-3.0": "LGPL-3.0-only", "agpl-3.0": "AGPL-3.0-only", "gpl-2.0+": "GPL-2.0-or-later", "gpl-3.0+": "GPL-3.0-or-later"}

#: Lower-case notice phrase -> identifier.
PHRASES = {
    "mit license": "MIT",
    "permission is hereby granted, free of charge, to any person": "MIT",
    "apache license, version 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "gnu general public license, version 3": "GPL-3.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu general public license v3": "GPL-3.0-only",
    "gnu general public license, version 2": "GPL-2.0-only",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license v2": "GPL-2.0-only",
    "gnu lesser general public license, version 3": "LGPL-3.0-only",
    "gnu lesser general public license version 3": "LGPL-3.0-only",
    "gnu lesser general public license, version 2.1": "LGPL-2.1-only",
    "gnu lesser general public license version 2.1": "LGPL-2.1-only",
    "gnu affero general public license, version 3": "AGPL-3.0-only",
    "gnu affero general public license version 3": "AGPL-3.0-only",
    "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license version 2.0": "MPL-2.0",
    "eclipse public license 2.0": "EPL-2.0",
    "bsd 2-clause": "BSD-2-Clause",
    "bsd 3-clause": "BSD-3-Clause",
    "isc license": "ISC",
    "boost software license": "BSL-1.0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "cc0 1.0": "CC0-1.0",
    "cc by 4.0": "CC-BY-4.0",
    "cc by-sa 4.0": "CC-BY-SA-4.0",
    "cc by-nc 4.0": "CC-BY-NC-4.0",
    "cc by-nd 4.0": "CC-BY-ND-4.0",
    "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0",
    "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0",
    "creative commons attribution 4.0": "CC-BY-4.0",
    "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0",
    "licensed under mit": "MIT", "licensed under the mit": "MIT", "mit-licensed": "MIT", "expat license": "MIT",
    "apache license version 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0", "apache license v2.0": "Apache-2.0", "apache software license 2.0": "Apache-2.0",
    "gplv3": "GPL-3.0-only", "gpl v3": "GPL-3.0-only", "gplv3+": "GPL-3.0-or-later", "gplv2": "GPL-2.0-only", "gpl v2": "GPL-2.0-only", "gplv2+": "GPL-2.0-or-later", "lgplv3": "LGPL-3.0-only", "lgplv2.1": "LGPL-2.1-only", "agplv3": "AGPL-3.0-only",
    "zlib license": "Zlib", "the unlicense": "Unlicense",
}
#: Identifiers that no prose has by chance.
PHRASES |= {k.lower(): k for k in LICENSES if any(c.isdigit() for c in k) and "-" in k and k.lower() not in PHRASES}
PHRASES |= {"gpl-2.0": "GPL-2.0-only", "gpl-3.0": "GPL-3.0-only", "gpl-2.0+": "GPL-2.0-or-later", "gpl-3.0+": "GPL-3.0-or-later", "lgpl-2.1": "LGPL-2.1-only", "lgpl-3.0": "LGPL-3.0-only", "agpl-3.0": "AGPL-3.0-only"}
TAG = "spdx-license-identifier:"
UNREADABLE = "LicenseRef-unreadable"

#: The identifiers of the SPDX list that have neither hyphen nor digit and so look like words.
WORD_IDS = frozenset(
    """
    AAL Abstyles ADSL Afmparse Aladdin AMDPLPA AML AMPAS APAFML Baekmuk Bahyph Barr Beerware blessing Borceux Caldera Catharon CFITSIO checkmk ClArtistic
    Clips Cronyx Crossword CryptoSwift CrystalStacker Cube curl diffmark DOC Dotseqn DSDP dtoa dvipdfm eGenix Entessa EPICS EUDatagrid Eurosym Fair FBM
    FreeImage FSFAP FSFUL FSFULLR FSFULLRSD FSFULLRWD FTL Furuseth fwlw GD Giftware Glide Glulxe GLWTPL gnuplot gtkbook Gutmann HaskellReport hdparm
    HIDAPI HPND HTMLTIDY ICU IJG ImageMagick iMatix InnoSetup Intel IPA ISC Jam jove JPNIC JSON Kastrup Kazlib Leptonica LGPLLR Libpng libtiff LLGPL LOOP
    lsof magaz mailprio MakeIndex metamail Minpack MIPS MirOS MIT MITNFA MMIXware Motosoto mplus MTLL Multics Mup Naumen NCL NCSA NetCDF Newsletr NGPL
    ngrep NLPL Nokia NOSL Noweb NRL NTP Nunit OAR OFFIS OGTSL OML OpenSSL OpenVision PADL Pixar pkgconf Plexus pnmstitch PostgreSQL PPL psfrag psutils
    Qhull radvd Rdisc RSCPL Ruby Saxpath SCEA SchemeReport Sendmail SISSL SL Sleepycat SMLNJ SMPPL SNIA snprintf SOFA softSurfer Soundex SunPro SWL swrule
    Symlinks TCL TermReadKey ThirdEye threeparttable TMate TOSL TPDL TrustedQSL TTWL UCAR ulem UnixCrypt Unlicense Vim VOSTROM Wsuipa WTFPL wwl wxWindows
    Xerox Xfig xinetd xlock Xnet xpp XSkat xzoom Zed Zeeff Zlib
    """.lower().split()
)

_STRENGTH = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[0-9A-Za-z.+:\-]+")
_EXPRESSION = re.compile(r"[ \t]*((?:[0-9A-Za-z.+:\-]|\(|\)|[ \t])*)")

#: After an operand: the line's end, a closing parenthesis, comment, quote or tag, or an operator.
_AFTER = re.compile(r"""\s*(?:$|[)"'`<}\]]|\*+[/)]|-->|#\}|(?i:and|or|with)\s)""")


def parse(expression: str) -> list[str]:
    """The expression in reverse Polish form; ValueError if it isn't one."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand must follow
    at = 0
    for m in _TOKEN.finditer(expression):
        if expression[at : m.start()].strip():
            raise ValueError(expression)
        at, token = m.end(), m.group()
        low = token.lower()
        if token == "(":
            if not operand:
                raise ValueError(expression)
            stack.append(token)
        elif token == ")":
            if operand:
                raise ValueError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(expression)
            stack.pop()
        elif low in _STRENGTH:
            if operand:
                raise ValueError(expression)
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                raise ValueError(expression)
            out.append(_BY_LOWER.get(low, token))
            operand = False
    if operand or expression[at:].strip():
        raise ValueError(expression)
    while stack:
        if stack[-1] == "(":
            raise ValueError(expression)
        out.append(stack.pop())
    return out


def evaluate(polish: list[str]) -> tuple[str, int]:
    """The normal form of the expression and its category's number."""
    stack: list[tuple[str, int, int]] = []  # text, category, strength of the outermost operator
    for token in polish:
        if token not in _STRENGTH:
            stack.append((token, LICENSES.get(token, len(CATEGORIES) - 1), 4))
            continue
        if len(stack) < 2:
            raise ValueError(polish)
        (b, kb, sb), (a, ka, sa) = stack.pop(), stack.pop()
        if token == "with":
            if sa < 4 or sb < 4:
                raise ValueError(polish)
            stack.append((f"{a} WITH {b}", 2 if ka == 3 else ka, 3))
            continue
        s = _STRENGTH[token]
        a, b = (f"({x})" if sx < s else x for x, sx in ((a, sa), (b, sb)))
        stack.append((f"{a} {token.upper()} {b}", min(ka, kb) if token == "or" else max(ka, kb), s))
    if len(stack) != 1:
        raise ValueError(polish)
    return stack[0][:2]


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, name in PHRASES.items():
        a.add_word(phrase, (len(phrase), name))
    a.add_word(TAG, (len(TAG), None))
    a.make_automaton()
    return a


def _is_identifier(low: str, rest: str) -> bool:
    """Whether a word is no prose: it is known, has a hyphen or a digit, or the expression goes on or ends after it."""
    return low[0].isalnum() and (low in _BY_LOWER or low in WORD_IDS or any(c in "-0123456789" for c in low) or bool(_AFTER.match(rest)))


#: A line's end within an expression: what stands before it, and a comment's marks before what follows.
_WRAP = re.compile(r"[ \t]*\r?\n[ \t]*(?:(?:#+|//+|\*+(?!/)|;+|--+|%+|REM\b)[ \t]*)?")


def _logical_line(text: str, begin: int) -> tuple[str, list[int]]:
    """What follows a tag up to the end of its expression's last line, and each character's place in the text."""
    parts, places, at, depth, inside = [], [], begin, 0, True
    while True:
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop].rstrip("\r")
        parts.append(line)
        places += range(at, at + len(line))
        depth += line.count("(") - line.count(")")
        inside = inside and bool(_INSIDE.fullmatch(line))
        if stop == len(text) or not (_GOES_ON.search(line.rstrip()) or depth > 0 and inside):
            return "".join(parts), places
        parts.append(" ")
        places.append(stop)
        at = _WRAP.match(text, stop - (text[stop - 1 : stop] == "\r")).end()


_GOES_ON = re.compile(r"(?:^|\s)(?:AND|OR|WITH|and|or|with)$")
_INSIDE = re.compile(r"[0-9A-Za-z.+:\-() \t]*")


def _tag(line: str) -> tuple[str, int, int]:
    """The longest beginning of a tag's line that can be read, its category and where it ends; prose may follow it."""
    expression = _EXPRESSION.match(line)
    words, begin = expression.group(1), expression.start(1)
    ends: list[int] = []
    depth, operand, sure = 0, True, False
    for m in _TOKEN.finditer(words):
        low = m.group().lower()
        if operand and low == "(":
            depth += 1
        elif operand and low not in _STRENGTH and low != ")" and (sure and low[0].isalnum() or _is_identifier(low, line[begin + m.end() :])):
            operand = False
        elif not operand and low == ")" and depth:
            depth -= 1
        elif not operand and low in _STRENGTH:
            operand, sure = True, m.group().isupper()
        else:
            break
        if not operand and not depth:
            ends.append(m.end())
    for end in reversed(ends):
        try:
            return *evaluate(parse(words[:end].strip())), begin + end
        except ValueError:  # an exception after a parenthesis
            continue
    return UNREADABLE, len(CATEGORIES) - 1, 0


_TAGS = re.compile(r"(?i)(?<!\w)SPDX-License-Identifier:")


def findings(text: str) -> dict[str, int]:
    """Each license expression of a text with its category's number."""
    found: dict[str, int] = {}
    low = " ".join(text.lower().split())
    if TAG in low:  # the original lines say where an expression ends; what it names isn't a notice
        parts, last = [], 0
        for m in _TAGS.finditer(text):
            if m.start() < last:
                continue
            line, places = _logical_line(text, m.end())
            name, category, end = _tag(line)
            found[name] = category
            parts += [text[last : m.start()], " ; "]
            last = places[end - 1] + 1 if end else m.end()
        low = " ".join("".join([*parts, text[last:]]).lower().split())
    for end, (size, name) in _automaton().iter_long(low):
        begin = end - size + 1
        if begin and (low[begin - 1].isalnum() or low[begin - 1] in "_-+"):
            continue
        if name is not None and (end + 1 == len(low) or not (low[end + 1].isalnum() or low[end + 1] in "_-+" or low[end + 1] == "." and low[end + 2 : end + 3].isdigit())):
            found[name] = LICENSES[name]
    return found


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and (found := findings(text)):
                names = sorted(found)
                whole = names[0] if len(names) == 1 else " AND ".join(f"({n})" if " OR " in n else n for n in names)
                rows.append((i, whole, len(names), CATEGORIES[max(found.values())]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["doc_id", "expression", "n_licenses", "category"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, expression, n_licenses, category) of every document with a finding."""
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_run, "doc_id long, expression string, n_licenses long, category string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(K.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """For texts without tags: phrases replaced from the longest on, so a phrase within another doesn't count."""
    text = "regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '^', ' ') || ' '"
    for k, phrase in sorted(enumerate(PHRASES), key=lambda x: -len(x[1])):
        pattern = re.sub(r"([.+()])", r"\\\1", phrase)
        text = f"regexp_replace({text}, '([^0-9a-z_+\\-\\x{{80}}-\\x{{10FFFF}}]){pattern}([^0-9a-z_+.\\-\\x{{80}}-\\x{{10FFFF}}]|\\.[^0-9])', '\\1#{k}#\\2', 'g')"
    names = ", ".join(f"({k}, '{n}', {LICENSES[n]})" for k, n in enumerate(PHRASES.values()))
    cases = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CATEGORIES))
    return f"""
WITH marked AS (SELECT doc_id, {text} AS t FROM documents WHERE text IS NOT NULL),
names(k, name, category) AS (VALUES {names}),
found AS (SELECT DISTINCT doc_id, name, category FROM marked, names WHERE contains(t, '#' || k || '#'))
SELECT doc_id, string_agg(name, ' AND ' ORDER BY name) AS expression, count(*) AS n_licenses, CASE max(category) {cases} END AS category FROM found GROUP BY doc_id
"""


ORACLE = _oracle()
