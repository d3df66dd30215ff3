"""Transforms: a registry of named ones, and a rule language compiled when a plan is made.

Rules: ``$name = text;`` variables, ``:: [set];`` filters, ``:: Name (Inverse);`` transforms, and conversions
``before { text } after > left | right;`` with sets, quantifiers, captures, ``$1``, functions ``&Any-Lower($1)`` and a
cursor. ``<`` rules serve the inverse, ``<>`` both. At each place the first rule that fits is applied; without one the cursor moves on.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F, types as T

from textloom.functions import chars, normalize as _n
from textloom.functions.batches import sliced

_HEX = {"unicode": "unicode", "java": "java", "c": "c", "xml": "xml", "xml10": "decimal", "perl": "perl"}


def _py_hex(kind: str) -> Callable[[str], str]:
    bmp, beyond = chars._NOTATION[kind]

    def one(c: str) -> str:
        p = ord(c)
        if p > 0xFFFF and kind == "java":
            return beyond % (0xD800 + (p - 0x10000 >> 10), 0xDC00 + (p - 0x10000 & 1023))
        return (beyond or bmp) % p if p > 0xFFFF else bmp % p

    return lambda t: "".join(map(one, t))


def _py_unhex(t: str) -> str:
    found = regex.compile(r"U\+([0-9A-Fa-f]{4,6})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|&#x([0-9A-Fa-f]+);|\\x\{([0-9A-Fa-f]+)\}|&#(\d+);")
    made = found.sub(lambda m: chr(int(m[6])) if m[6] else chr(int(next(x for x in m.groups()[:5] if x), 16)), t)
    return made.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


#: On Python strings, for use inside rules and as the one definition of each built-in.
PYTHON: dict[str, Callable[[str], str]] = {
    "any-nfc": lambda t: unicodedata.normalize("NFC", t), "any-nfd": lambda t: unicodedata.normalize("NFD", t),
    "any-nfkc": lambda t: unicodedata.normalize("NFKC", t), "any-nfkd": lambda t: unicodedata.normalize("NFKD", t),
    "any-fcd": lambda t: t if _n.is_fcd(t) else unicodedata.normalize("NFD", t), "any-fcc": lambda t: unicodedata.normalize("NFC", t),
    "any-lower": str.lower, "any-upper": str.upper, "any-title": str.title, "any-casefold": str.casefold, "any-null": lambda t: t, "any-remove": lambda t: "",
    "any-name": lambda t: "".join(f"\\N{{{unicodedata.name(c, f'<control-{ord(c):04X}>')}}}" for c in t),
    "name-any": lambda t: regex.sub(r"\\N\{([^}]+)\}", lambda m: _named(m[1], m[0]), t),
    "any-breakinternal": lambda t: regex.sub(r"(?<=\w)\b(?=\w)", "-", t),
    **{f"any-hex/{k}": _py_hex(v) for k, v in _HEX.items()}, "any-hex": _py_hex("java"), "any-hex/plain": lambda t: "".join(f"{ord(c):04X}" for c in t),
    **{f"hex-any/{k}": _py_unhex for k in _HEX}, "hex-any": _py_unhex,
}


def _named(name: str, otherwise: str) -> str:
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return chr(int(name[9:-1], 16)) if name.startswith("<control-") else otherwise


def _key(name: str) -> str:
    key = name.strip().lower()
    return key if key in PYTHON or "-" in key else f"any-{key}"


_JVM: dict[str, Callable[[Column], Column]] = {
    "any-null": lambda c: c, "any-remove": lambda c: F.when(c.isNotNull(), ""), "any-lower": F.lower, "any-upper": F.upper,
    "any-nfc": lambda c: _n.normalize(c, "NFC"), "any-nfd": lambda c: _n.normalize(c, "NFD"), "any-nfkc": lambda c: _n.normalize(c, "NFKC"),
    "any-nfkd": lambda c: _n.normalize(c, "NFKD"), "any-casefold": _n.casefold, **{f"any-hex/{k}": (lambda v: lambda c: chars.escape(c, v))(v) for k, v in _HEX.items()},
}


def transform(column: Column, name: str) -> Column:
    """A built-in transform; JVM expressions where there are any."""
    key = _key(name)
    if key in _JVM:
        return _JVM[key](column)
    if key not in PYTHON:
        raise ValueError(f"transform {name}")
    return _n._focused(column, r"(?s).", PYTHON[key])


def names() -> list[str]:
    return sorted(PYTHON)


# -- rules


@dataclass
class Rule:
    """One conversion in one direction."""

    find: regex.Pattern
    left: list
    right: list
    cursor: bool


@dataclass
class Phase:
    """A named transform or a group of conversions."""

    name: str | None = None
    rules: list[Rule] = field(default_factory=list)
    _scan: list = field(default_factory=list)

    def scan(self) -> regex.Pattern | None:
        """Where some rule may apply; none if a rule looks back or puts its cursor before what it made, for then results are matched again."""
        if not self._scan:
            free = not any(r.right or regex.search(r"\(\?<[=!]|\\[bB1-9]|\\m|\\M|\^", r.find.pattern) for r in self.rules)
            self._scan.append(regex.compile("|".join(f"(?:{r.find.pattern})" for r in self.rules), regex.V1) if free and self.rules else None)
        return self._scan[0]


def _split_statements(text: str) -> list[str]:
    out, now, quote, depth, i = [], [], False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            now.append(text[i : i + 2])
            i += 2
            continue
        if c == "'":
            quote = not quote
        elif c == "#" and not quote and not depth:
            while i < len(text) and text[i] != "\n":
                i += 1
            continue
        elif not quote and c in "[]":
            depth += 1 if c == "[" else -1
        if c == ";" and not quote and not depth:
            out.append("".join(now).strip())
            now = []
        else:
            now.append(c)
        i += 1
    if "".join(now).strip():
        out.append("".join(now).strip())
    return [s for s in out if s]


def _tokens(side: str, variables: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, text): lit, set, op, ref, var, func."""
    out, i = [], 0
    while i < len(side):
        c = side[i]
        if c.isspace():
            i += 1
        elif c == "'":
            end = side.find("'", i + 1)
            out += [("lit", x) for x in (side[i + 1 : end] or "'")]
            i = end + 1
        elif c == "\\":
            if side[i + 1] == "u":
                out.append(("lit", chr(int(side[i + 2 : i + 6], 16))))
                i += 6
            else:
                out.append(("lit", side[i + 1]))
                i += 2
        elif c == "[":
            depth, k = 0, i
            while True:
                depth += {"[": 1, "]": -1}.get(side[k], 0)
                k += 2 if side[k] == "\\" else 1
                if not depth:
                    break
            out.append(("set", _set(side[i:k], variables)))
            i = k
        elif c == "$" and (m := regex.compile(r"\$(\d)").match(side, i)):
            out.append(("ref", m[1]))
            i = m.end()
        elif c == "$" and (m := regex.compile(r"\$([\p{L}_]\w*)").match(side, i)):
            if m[1] not in variables:
                raise ValueError(f"variable ${m[1]}")
            out += _tokens(variables[m[1]], variables)
            i = m.end()
        elif c == "&" and (m := regex.compile(r"&([\w/-]+)\s*\(\s*\$(\d)\s*\)").match(side, i)):
            out.append(("func", f"{m[1]} {m[2]}"))
            i = m.end()
        elif c in "(){}|*+?^$@":
            out.append(("op", c))
            i += 1
        else:
            out.append(("lit", c))
            i += 1
    return out


def _set(text: str, variables: dict[str, str]) -> str:
    """A set expression as a class of the ``regex`` module (version 1)."""
    for name in sorted(variables, key=len, reverse=True):
        text = text.replace(f"${name}", variables[name])
    text = regex.sub(r"\[:\^?([\w=\s]+):\]", lambda m: rf"\{'P' if '^' in m[0] else 'p'}{{{m[1].strip()}}}", text)
    text = regex.sub(r"(?<!\\)\s", "", text)
    text = regex.sub(r"(?<=\])-(?=\[)", "--", text)
    text = regex.sub(r"(?<=\])&(?=\[)", "&&", text)
    return regex.sub(r"\{([^{}])\}(?<!\\[pP]\{.\})", r"\1", text)


def _pattern(tokens: list[tuple[str, str]]) -> str:
    out = []
    for kind, x in tokens:
        out.append(regex.escape(x) if kind == "lit" else x if kind == "set" else {"^": r"\A", "$": r"\Z"}.get(x, x) if kind == "op" else "")
    return "".join(out)


def _conversion(source: str, target: str, variables: dict[str, str]) -> Rule:
    tokens = _tokens(source, variables)
    ops = [k for k, t in enumerate(tokens) if t[0] == "op" and t[1] in "{}"]
    opens = next((k for k in ops if tokens[k][1] == "{"), None)
    closes = next((k for k in ops if tokens[k][1] == "}"), None)
    before = tokens[:opens] if opens is not None else []
    after = tokens[closes + 1 :] if closes is not None else []
    middle = [t for t in tokens[(opens + 1 if opens is not None else 0) : (closes if closes is not None else len(tokens))] if t != ("op", "|")]
    find = (f"(?<={_pattern(before)})" if before else "") + f"({_pattern(middle)})" + (f"(?={_pattern(after)})" if after else "")
    made = _tokens(target, variables)
    made = [t for t in made if t[0] != "op" or t[1] == "|"]
    cut = next((k for k, t in enumerate(made) if t == ("op", "|")), None)
    left, right = (made[:cut], made[cut + 1 :]) if cut is not None else (made, [])
    # group 1 is the whole middle, and captures of the context before come first
    shift = sum(t == ("op", "(") for t in before)
    moved = lambda part: [(k, str(int(x) + 1 if int(x) > shift else int(x)) if k == "ref" else x) for k, x in part]
    return Rule(regex.compile(find, regex.V1), moved(left), moved(right), cut is not None)


class Transform:
    """A compiled list of rules, called on strings or applied to a column."""

    def __init__(self, rules: str, inverse: bool = False):
        variables: dict[str, str] = {}
        self.phases: list[Phase] = []
        self.filter: regex.Pattern | None = None
        for s in _split_statements(rules):
            if m := regex.fullmatch(r"\$([\p{L}_]\w*)\s*=\s*(.*)", s, regex.S):
                variables[m[1]] = m[2]
            elif s.startswith("::"):
                body = s[2:].strip()
                if body.startswith("["):
                    self.filter = regex.compile(_set(body, variables), regex.V1)
                    continue
                m = regex.fullmatch(r"([^()]*?)\s*(?:\(\s*([^()]*)\s*\))?", body)
                name = (m[2] if inverse and m[2] is not None else m[1]) if m else body
                if m and inverse and m[2] is None:
                    a, _, b = m[1].partition("-")
                    name = f"{b}-{a}" if b else {"nfd": "NFC", "nfc": "NFD", "nfkd": "NFKC", "nfkc": "NFKD", "lower": "Upper", "upper": "Lower"}.get(m[1].lower(), m[1])
                if name:
                    self.phases.append(Phase(_key(name)))
            else:
                m = regex.fullmatch(r"((?:[^<>'\\\[]|'[^']*'|\\.|\[(?:[^\[\]\\]|\\.|\[[^\]]*\])*\])*)(<>|>|<|→|←|↔)(.*)", s, regex.S)
                if not m:
                    raise ValueError(f"rule {s!r}")
                op = {"→": ">", "←": "<", "↔": "<>"}.get(m[2], m[2])
                if op == "<>" or op == ("<" if inverse else ">"):
                    source, target = (m[3], m[1]) if inverse else (m[1], m[3])
                    if op == "<>":  # the other side's context is none of the result's
                        target = regex.sub(r"^.*?(?<!\\)\{|(?<!\\)\}.*$", "", target)
                    if not self.phases or self.phases[-1].name is not None:
                        self.phases.append(Phase())
                    self.phases[-1].rules.append(_conversion(source, target, variables))
        if inverse:
            self.phases.reverse()

    def __call__(self, text: str) -> str:
        if self.filter is None:
            return self._all(text)
        out, at = [], 0
        for m in regex.finditer(f"(?:{self.filter.pattern})+", text, regex.V1):
            out += [text[at : m.start()], self._all(m[0])]
            at = m.end()
        return "".join([*out, text[at:]])

    def _all(self, text: str) -> str:
        for phase in self.phases:
            if phase.name is not None:
                if phase.name not in PYTHON:
                    raise ValueError(f"transform {phase.name}")
                text = PYTHON[phase.name](text)
            else:
                text = self._convert(phase, text)
        return text

    @staticmethod
    def _convert(phase: Phase, text: str) -> str:
        rules = phase.rules
        if (scan := phase.scan()) is not None:  # one pass over the text as it stands
            out, at = [], 0
            while found := scan.search(text, at):
                out.append(text[at : found.start()])
                at = found.start()
                for rule in rules:
                    m = rule.find.match(text, at)
                    if m and (m.end(1) > at or rule.left):
                        out.append(_made(rule.left, m))
                        if m.end(1) > at:
                            at = m.end(1)
                            break
                        # nothing was taken: the next character goes on as it is
                        out.append(text[at : at + 1])
                        at += 1
                        break
                else:
                    out.append(text[at : at + 1])
                    at += 1
                if at >= len(text):
                    break
            return "".join([*out, text[at:]])
        at, budget = 0, 16 * len(text) + 1024
        while at < len(text):
            if not budget:
                raise ValueError("rules that revisit their own results do not come to an end")
            budget -= 1
            for rule in rules:
                m = rule.find.match(text, at)
                if m and (m.end(1) > at or rule.left or rule.right):
                    left, right = (_made(part, m) for part in (rule.left, rule.right))
                    text = text[:at] + left + right + text[m.end(1) :]
                    step = len(left)
                    at += step if step or m.end(1) > m.start(1) else 1
                    break
            else:
                at += 1
        return text

    def column(self, column: Column) -> Column:
        """Distinct values of a slice are converted once."""

        def convert(part: pa.Array) -> list[str | None]:
            values = part.to_pylist()
            made = {v: None if v is None else self(v) for v in set(values)}
            return [made[v] for v in values]

        return sliced(T.StringType(), lambda: convert)(column)


def _made(part: list, m: regex.Match) -> str:
    out = []
    for kind, x in part:
        if kind == "lit":
            out.append(x)
        elif kind == "ref":
            out.append(m[int(x)] or "")
        elif kind == "func":
            name, ref = x.split()
            out.append(PYTHON[_key(name)](m[int(ref) + 1] or ""))
    return "".join(out)
