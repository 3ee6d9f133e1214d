"""Python-dialect regular expressions as Java (Spark ``rlike``) patterns."""
from __future__ import annotations

import re
from re import _constants as K
from re import _parser

# Python re.search(..., MULTILINE | DOTALL) with str patterns (Unicode classes).
# UNIX_LINES (d) keeps ``$`` from matching before a bare ``\r`` as Python does.
PY_SEARCH_FLAGS = "(?smdU)"


def to_java(pattern: str) -> str:
    """Rewrite the Python-only constructs that Java spells differently."""
    out = re.sub(r"\(\?P<([A-Za-z_][A-Za-z0-9_]*)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    return out


def search_pattern(pattern: str) -> str:
    """Pattern for ``rlike`` that behaves like ``re.search(p, s, re.M | re.S)``."""
    return PY_SEARCH_FLAGS + to_java(pattern)


# ---- what a pattern needs ----------------------------------------------------------

def shortest(literals: list[str]) -> int:
    return min(map(len, literals), default=0)


def needed_sets(items) -> list[list[str]]:
    """Sets of literals (lower case): every match of the parsed pattern holds one of each set."""
    sets, run = [], ""

    def end():
        nonlocal run
        if run:
            sets.append([run])
        run = ""
    for op, arg in items:
        if op is K.LITERAL and arg < 128:
            run += chr(arg).lower()
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue  # holds no character, so what stands around it stays adjacent
        else:
            end()
            if op is K.SUBPATTERN:
                sets.append(needed(arg[3]))
            elif op is K.ATOMIC_GROUP:
                sets.append(needed(arg))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
                sets.append(needed(arg[2]))
            elif op is K.BRANCH:
                ways = [needed(w) for w in arg[1]]
                sets.append([x for w in ways for x in w] if all(ways) else [])
    end()
    return [x for x in sets if x]


def needed(items) -> list[str]:
    """The set whose shortest literal is longest, empty if there is none."""
    return max(needed_sets(items), key=shortest, default=[])


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost ``|``: it is found where one of the parts is. Whole where the parts
    would not mean the same alone (flags, references, comments)."""
    parts, start, depth, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            # a bracket that comes first is a member
            i += 2 if pattern[i + 1:i + 2] == "^" else 1
            i = i + 1 if pattern[i:i + 1] == "]" else i
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    parts.append(pattern[start:])
    try:
        whole = _parser.parse(pattern)
        alone = whole.state.flags == re.UNICODE.value and "(?" not in pattern.replace("(?:", "") and not re.search(r"\\[1-9]", pattern)
        for part in parts:
            _parser.parse(part)
        return parts if alone else [pattern]
    except re.error:
        return [pattern]


def _word_class(items) -> bool:
    for op, arg in items:
        if op is K.LITERAL:
            ok = arg < 128 and (chr(arg).isalnum() or arg == 95)
        elif op is K.RANGE:
            ok = all(x < 128 and (chr(x).isalnum() or x == 95) for x in range(arg[0], arg[1] + 1))
        else:
            ok = op is K.CATEGORY and arg in (K.CATEGORY_WORD, K.CATEGORY_DIGIT)
        if not ok:
            return False
    return True


def _word_only(items) -> bool:
    for op, arg in items:
        if op is K.LITERAL:
            ok = _word_class([(op, arg)])
        elif op is K.IN:
            ok = _word_class(arg)
        elif op is K.AT:
            ok = arg in (K.AT_BOUNDARY, K.AT_NON_BOUNDARY)
        elif op is K.SUBPATTERN:
            ok = not arg[1] and not arg[2] and _word_only(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            ok = _word_only(arg[2])
        elif op is K.BRANCH:
            ok = all(map(_word_only, arg[1]))
        else:
            ok = False
        if not ok:
            return False
    return True


def inside_a_word(parsed) -> bool:
    """Whether a match is one or more word characters, judged by these and the edges of the word alone: then
    the pattern is found in a text just where it is found in one of its words (runs of ``\\w``)."""
    return parsed.state.flags == re.UNICODE.value and parsed.getwidth()[0] > 0 and _word_only(parsed)
