"""License scans: notice phrases and SPDX tags by Aho-Corasick, tag expressions by shunting-yard.

A text's words are joined by single spaces, so a phrase stands in consecutive words exactly where the
automaton finds it between spaces. Texts in which it finds the words of an SPDX tag are read again for
the expression after it, which is parsed with the precedence with > and > or and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.scratch import table

#: The phrases of the base labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases, in words as the scan makes them.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
}
TAG_PHRASE = "spdx license identifier"
#: SPDX identifiers that a tag expression may name, as license_label() writes them. NONE and NOASSERTION name no license.
IDENTIFIERS = frozenset(
    """0bsd aal afl agpl aladdin amdplpa antlr-pd apache apafml apl apsl artistic artistic-cl8 artistic-perl beerware blueoak bsd bsl
    busl bzip2 c-uda caldera cal catosl cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cc-pddc cc0 cddl cdla-permissive
    cdla-sharing cecill cecill-b cecill-c cern-ohl cern-ohl-p cern-ohl-s cern-ohl-w clartistic cnri-python cpal cpl cpol cua-opl curl
    ecl ecos efl elastic entessa epl erlpl eudatagrid eupl fair frameworx freetype ftl gfdl gl2ps glulxe gnuplot gpl hpnd icu ijg
    imagemagick intel ipa ipl isc json lal latex2e libpng libtiff liliq-p liliq-r liliq-rplus linux-openib lgpl lgpllr lpl lppl
    mirros mit mit-advertising mit-cmu mit-enna mit-feh mit-modern-variant motosoto mpl mpl-2.0-no-copyleft-exception ms-pl ms-rl mtll
    mulanpsl multics naist nasa naumen ncsa ngpl nokia nosl npl nposl ntp nunit oclc odbl odc-by ofl ogl-uk ogtsl oldap oml openssl osl
    parity pddl php polyform-noncommercial polyform-small-business postgresql psf python qpl ricoh rpl rpsl rscpl ruby saxpath
    sgi-b simpl sissl sleepycat smlnj snia spl sspl sugarcrm tcl tcp-wrappers tmate unicode unicode-dfs unlicense upl vim vostrom vsl
    w3c watcom wtfpl x11 xfree86 xnet xpp zend zimbra zlib zlib-acknowledgement zpl""".split()
)
#: SPDX identifiers of exceptions, which stand to the right of `with` and nowhere else.
EXCEPTIONS = frozenset(
    """389-exception asterisk-exception asterisk-linking-protocols-exception autoconf-exception-2.0 autoconf-exception-3.0 autoconf-exception-generic
    autoconf-exception-generic-3.0 autoconf-exception-macro bison-exception-1.24 bison-exception-2.2 bootloader-exception classpath-exception-2.0
    clisp-exception-2.0 cryptsetup-openssl-exception digirule-foss-exception ecos-exception-2.0 erlang-otp-linking-exception fawkes-runtime-exception
    fltk-exception fmt-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-2.0-note gcc-exception-3.1 gmsh-exception
    gnat-exception gnome-examples-exception gnu-compiler-exception gnu-javamail-exception gpl-3.0-interface-exception gpl-3.0-linking-exception
    gpl-3.0-linking-source-exception gpl-cc-1.0 gstreamer-exception-2005 gstreamer-exception-2008 i2p-gpl-java-exception kicad-libraries-exception
    lgpl-3.0-linking-exception libpri-openh323-exception libtool-exception linux-syscall-note llgpl llvm-exception lzma-exception mif-exception
    nokia-qt-exception-1.1 ocaml-lgpl-linking-exception occt-exception-1.0 openjdk-assembly-exception-1.0 openvpn-openssl-exception pcre2-exception
    ps-or-pdf-font-exception-20170817 qpl-1.0-inria-2004-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 romic-exception
    rrdtool-floss-exception-2.0 sane-exception shl-2.0 shl-2.1 stunnel-exception swi-exception swift-exception texinfo-exception u-boot-exception-2.0
    ubdl-exception universal-foss-exception-1.0 vsftpd-openssl-exception wxwindows-exception-3.1 x11vnc-openssl-exception""".split()
)
#: Identifiers that their own document defines.
OWN_IDENTIFIER = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", re.IGNORECASE)
OWN_EXCEPTION = re.compile(r"(?:documentref-[a-z0-9.-]+:)?additionref-[a-z0-9.-]+", re.IGNORECASE)
#: How free the label's terms leave a user, from 0 to 1; other labels count as UNKNOWN_FREEDOM.
FREEDOM = {
    "cc0": 1.0, "mit": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "apache": 0.9, "cc-by": 0.9, "mpl": 0.6, "epl": 0.6,
    "lgpl": 0.5, "cc-by-sa": 0.4, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.1, "cc-by-nc": 0.1,
}
UNKNOWN_FREEDOM = 0.5
#: Evidence of one place of a phrase; a parsed tag expression is certain.
PHRASE_EVIDENCE = 0.5

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_TAG = re.compile(r"SPDX-License-Identifier\s*:", re.IGNORECASE)
_BREAK = re.compile(r"[\r\n]")
#: A slash between two identifiers is an older way to write `or`.
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*|[()]|(?<=[A-Za-z0-9.+])/(?=[A-Za-z0-9])")
_VERSION = re.compile(r"(?:-v?\d[\w.]*)?(?:-(?:only|or-later|clause|clear))*\+?$")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def license_label(identifier: str) -> str:
    """The label of an SPDX identifier: lower-cased, without version and variant (BSD-3-Clause: bsd)."""
    name = identifier.lower()
    while (shorter := _VERSION.sub("", name, count=1)) != name and shorter:
        name = shorter
    return name


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands and operators in postfix order; ValueError if the expression is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        lower = token.lower()
        if token == "(":
            if not operand_next:
                raise ValueError("operator expected")
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting or operand_next:
                raise ValueError("unbalanced parenthesis")
            waiting.pop()
        elif lower in _PRECEDENCE:
            if operand_next:
                raise ValueError("operand expected")
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[lower]:
                out.append(waiting.pop())
            waiting.append(lower)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("operator expected")
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        raise ValueError("incomplete expression")
    return out + waiting[::-1]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels that the expression names, and its freedom: `or` lets the user choose, `and` binds to both.

    ValueError if it is malformed, names what is no license, or has an exception anywhere but right of `with`.
    """
    stack: list[tuple[set[str], float] | None] = []
    for token in to_postfix(tokens):
        if token == "with":
            if stack.pop() is not None or stack[-1] is None:
                raise ValueError("`with` stands between a license and an exception")
            # an exception only adds to what its license permits
        elif token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if left is None or right is None:
                raise ValueError("an exception without its license")
            stack.append((left[0] | right[0], max(left[1], right[1]) if token == "or" else min(left[1], right[1])))
        elif token.lower() in EXCEPTIONS or OWN_EXCEPTION.fullmatch(token):
            stack.append(None)
        else:
            label = token.lower() if OWN_IDENTIFIER.fullmatch(token) else license_label(token)
            if label not in IDENTIFIERS and not OWN_IDENTIFIER.fullmatch(token):
                raise ValueError(f"no license: {token}")
            stack.append(({label}, FREEDOM.get(label, UNKNOWN_FREEDOM)))
    if (found := stack.pop()) is None:
        raise ValueError("an exception without its license")
    return found


def tag_expressions(text: str) -> list[list[str]]:
    """Tokens of the expression after each SPDX tag.

    An expression ends where two operands meet, at the next tag, and at the end of a line unless a parenthesis is open.
    """
    found = []
    tags = [m.span() for m in _TAG.finditer(text)]
    for (_, at), (stop, _) in zip(tags, [*tags[1:], (len(text), 0)], strict=True):
        tokens: list[str] = []
        depth, operand_next = 0, True
        for m in _TOKEN.finditer(text, at, stop):
            token = "or" if m[0] == "/" else m[0]
            opens = token == "("
            joins = token.lower() in _PRECEDENCE or token == ")"
            if opens + (not joins) and not operand_next or token == ")" and not depth:
                break
            if not depth and _BREAK.search(text, at, m.start()):
                break
            at = m.end()
            depth += opens - (token == ")")
            operand_next = opens or (joins and token != ")")
            tokens.append(token)
        if tokens:
            found.append(tokens)
    return found


class Scanner:
    """Finds phrases in texts; build one for each task."""

    def __init__(self, base: dict[str, str], more: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in {TAG_PHRASE, *base, *more}:
            labels = base.get(phrase), more.get(phrase)
            self.automaton.add_word(f" {phrase} ".encode().decode("latin-1"), (len(phrase) + 2, *labels, phrase == TAG_PHRASE))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, freedom of a whole text."""
        words = (text or "").encode().translate(_FOLD).split()
        joined = b" %b " % b" ".join(words)
        base, labels, places, doubt, tagged = [], set(), 0, 1.0, False
        for end, (size, label, other, tag) in self.automaton.iter(joined.decode("latin-1")):
            if label:
                base.append((end - size + 1, label))
            if label or other:
                labels |= {label, other} - {None}
                places += 1
            tagged |= tag
        freedom = min((FREEDOM.get(x, UNKNOWN_FREEDOM) for x in labels), default=None)
        if places:
            doubt = (1 - PHRASE_EVIDENCE) ** min(places, 50)
        for tokens in tag_expressions(text) if tagged else ():
            try:
                named, free = evaluate(tokens)
            except ValueError:
                continue
            labels |= named
            freedom, doubt = free if freedom is None else min(freedom, free), 0.0
        starts = [joined.count(b" ", 0, at + 1) - 1 for at in ((min(base)[0], max(base)[0]) if base else ())]
        first, last = starts or (None, None)
        return len(words), len(base), first, last, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 - doubt, freedom


SCAN_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"
)


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = NOTICE_PHRASES) -> DataFrame:
    """License findings of every whole text of docs (doc_id, text), without a shuffle.

    score is the evidence that the text carries a license, freedom the least freedom that its licenses
    leave (null without any). Defined cases: a null text counts as empty and has no words, labels "" and
    score 0; a tag expression that is malformed or names what is no license adds nothing; a text of any
    length is scanned whole; a null doc_id is kept; repeated rows are scanned each; other columns are
    ignored; an empty table gives an empty result.
    """
    names = [x.split()[0] for x in SCAN_SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()] * 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, more)
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column(1)]
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds[1:], strict=True))] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCAN_SCHEMA)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
