"""Counts that describe one text; shared by the quality rules and the quality classifier.

Words are maximal runs of bytes outside space and 0x09-0x0D, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

from collections import Counter

_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0xC0, 0x100))
_DIGITS = b"0123456789"
_STOPS = b".?!"
_MARKS = b"!?,;:.\"'()-"

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for was on are as with be by at this have from or had not but an a "
        "le la les de des du et en un une est que qui dans pour sur au aux par avec il elle ne pas ce "
        "der die das und ist in den von zu mit sich auf für nicht ein eine als auch im dem es des "
        "el los las y del se por con una su para lo al como más o pero sus"
    ).split()
)

FIELDS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_function",
    "n_upper",
    "n_letters",
    "n_digits",
    "n_marks",
    "n_shout",
    "n_ended",
    "n_long",
    "n_top",
)


def text_stats(data: bytes) -> tuple[int, ...]:
    """The counts named in ``FIELDS`` for one UTF-8 text; an empty text has only zeros.

    n_dup_lines: lines with a word that equal an earlier line.  n_repeat_words: word places inside
    three-word windows that occur at least twice, the first occurrence included.
    """
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(FIELDS)
    seen: set[bytes] = set()
    lines = dups = ended = 0
    for line in data.split(b"\n"):
        if not line or line.isspace():
            continue
        lines += 1
        if line in seen:
            dups += 1
        else:
            seen.add(line)
        ended += line[-1] in _STOPS
    repeated = 0
    counts = Counter(words)
    if n >= 3 and len(counts) < n:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            inside = bytearray(n)
            for i, w in enumerate(windows):
                if often[w] > 1:
                    inside[i] = inside[i + 1] = inside[i + 2] = 1
            repeated = sum(inside)
    size = len(data)
    joined = b"".join(words)
    return (
        n,
        len(joined.translate(None, _CONTINUATION)),
        size - len(data.translate(None, _SYMBOLS)),
        dups,
        repeated,
        lines,
        len(counts),
        sum(counts[w] for w in FUNCTION_WORDS & counts.keys()),
        size - len(data.translate(None, _UPPER)),
        size - len(data.translate(None, _LETTERS)),
        size - len(data.translate(None, _DIGITS)),
        size - len(data.translate(None, _MARKS)),
        data.count(b"!!"),
        ended,
        sum(len(w) > 25 for w in words),
        max(counts.values()),
    )
