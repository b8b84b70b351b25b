"""Code-point classes, written once and used by every regex and scan.

Offsets everywhere are Unicode code points, ends are exclusive. White space is
one explicit set because Java, RE2 and Python disagree about ``\\s``.
"""

from __future__ import annotations

# The classes that boundaries, rules and reports are defined by.
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = "。！？；!?;…．﹖﹗‥⋯"
SENTENCE_CLOSERS = "」』”）)》】〉>'\""
ZH_SENTENCE = "。！？；…"
ZH_CLAUSE = "，、"
OPENERS = "「『“《（〔［｛'"
CLOSERS = "」』”）》】〉，。！？；：、…!?;,."
SNAP_CLOSERS = "」』”）)》】〉"
RULE_SENTENCE = "。！？；!?;…"
RULE_CLAUSE = "，、,:："
REPORT_PUNCT = "。！？；…!?;"
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
CJK = "\u2e80-\u9fff\uf900-\ufaff\uff00-\uff60"


def char_class(members: str, negated: bool = False) -> str:
    """A regex class of exactly these characters, the same in Java, RE2 and Python."""
    body = "".join(f"\\x{{{ord(c):X}}}" if ord(c) < 0x21 or c in r"\^-[]&|~\"'`$" or c.isspace() or ord(c) == 0x85 else c for c in members)
    return f"[{'^' if negated else ''}{body}]"


WS_CLASS = char_class(WS)


def _complement(members: str, ranges: str) -> str:
    """A class of all code points but these, as ranges, ASCII's printable ones first.

    A negated class makes Java test every member for every character; here the
    first range settles most of them.
    """
    taken = sorted([(ord(c), ord(c)) for c in members] + [(ord(r[0]), ord(r[2])) for r in (ranges[i : i + 3] for i in range(0, len(ranges), 3))])
    out, at = [], 0
    for low, high in [*taken, (0x110000, 0x110000)]:
        if low > at:
            out.append((at, low - 1))
        at = max(at, high + 1)
    out.sort(key=lambda r: not r[0] <= 0x41 <= r[1])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


#: Neither CJK nor white space.
OTHER_CLASS = _complement(WS, CJK)
