r"""Regular-expression front ends: each syntax becomes one Java pattern when a plan is made.

Meaning of the source language: ``\w \d \s \b`` are Unicode; ``^`` and ``$`` are line edges; laziness does not matter to a
search; unknown letter escapes are the letter itself; ``{,m}`` starts at zero; ``\A{...}`` is a permutation; bracket
classes have ``&&`` and ``--``. What Java can't express raises ``UnsupportedPattern``.
"""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Iterator

from textloom.plans import charset


class UnsupportedPattern(ValueError):
    """A construct without a translation, or a malformed pattern."""


_POSIX = set("alpha digit alnum upper lower space blank punct cntrl graph print xdigit word ascii".split())
_META = set(r"\.[]{}()*+?^$|&-~#")
DIGIT, SPACE = r"\p{Nd}", r"\p{IsWhite_Space}"
DOT, NOT_BREAK = r"[^\n\x0B\x0C\r\x85\x{2028}\x{2029}]", r"[^\n]"
BREAK = DOT.replace("^", "")
WORD = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}]"


def quote(text: str) -> str:
    return "".join("\\" + c if c in _META else c if c in string.printable and c not in "\n\r\t\x0b\x0c" else f"\\x{{{ord(c):X}}}" if ord(c) < 0x80 else c for c in text)


def negated(cls: str) -> str:
    return f"[^{cls}]"


class _Pcre:
    """Recursive descent from the default syntax to a Java pattern."""

    def __init__(self, text: str):
        self.s, self.i, self.groups, self.depth_look = text, 0, 0, 0
        self.map: dict[int, int] = {}

    def peek(self, what: str) -> bool:
        return self.s.startswith(what, self.i)

    def take(self, what: str) -> bool:
        if self.peek(what):
            self.i += len(what)
            return True
        return False

    def until(self, end: str) -> str:
        k = self.s.find(end, self.i)
        if k < 0:
            raise UnsupportedPattern(f"missing {end!r} in {self.s!r}")
        out, self.i = self.s[self.i : k], k + len(end)
        return out

    def whole(self) -> str:
        out = self.alternatives()
        if self.i < len(self.s):
            raise UnsupportedPattern(f"unbalanced parenthesis in {self.s!r}")
        return out

    def alternatives(self, reset: bool = False) -> str:
        first, most = self.groups, self.groups
        out = [self.sequence()]
        while self.take("|"):
            if reset and self.groups > first:
                raise UnsupportedPattern("captures in a branch reset")
            most = max(most, self.groups)
            out.append(self.sequence())
        return "|".join(out)

    def sequence(self) -> str:
        out = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            item = self.item()
            out.append(self.quantified(item) if item else "")
        return "".join(out)

    def quantified(self, item: str) -> str:
        while self.i < len(self.s):
            c = self.s[self.i]
            if c in "*+?":
                self.i += 1
                bounds = c
            elif c == "{" and (m := re.compile(r"\{(\d*)(,?)(\d*)\}").match(self.s, self.i)) and (m[1] or m[3]):
                self.i = m.end()
                low = m[1] or "0"
                if m[2] and m[3] and int(low) > int(m[3]):
                    raise UnsupportedPattern(f"bounds {m[0]}")
                bounds = f"{{{low}{m[2]}{m[3]}}}"
            else:
                return item
            if self.take("?"):
                pass  # laziness makes no difference to what is found
            elif self.take("+"):
                bounds += "+"
            item = f"{item}{bounds}" if not item.endswith(("*", "+", "?", "}")) or re.fullmatch(r"(?:\\[pP]\{[^}]*\}|\\x\{[^}]*\}|\\.|\[.*\]|\(.*\))", item, re.S) else f"(?:{item}){bounds}"
        return item

    def item(self) -> str:
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        if c == ".":
            return DOT
        if c == "^":
            return "^"
        if c == "$":
            return "$"
        if c == "\\":
            return self.escape()
        if c in "*+?":
            raise UnsupportedPattern(f"nothing to repeat in {self.s!r}")
        return quote(c)

    def close(self, inner: str) -> str:
        if not self.take(")"):
            raise UnsupportedPattern(f"missing ) in {self.s!r}")
        return inner

    def group(self) -> str:
        if not self.take("?"):
            self.groups += 1
            if self.depth_look > 0:
                raise UnsupportedPattern("capture inside a look-ahead")
            return "(" + self.close(self.alternatives()) + ")"
        if self.take("#"):
            self.until(")")
            return ""
        if self.take(":"):
            return "(?:" + self.close(self.alternatives()) + ")"
        if self.take("|"):
            return "(?:" + self.close(self.alternatives(reset=True)) + ")"
        if self.take(">"):
            return "(?>" + self.close(self.alternatives()) + ")"
        for mark in ("=", "!", "<=", "<!"):
            if self.take(mark):
                ahead = "<" not in mark
                self.depth_look += ahead
                out = f"(?{mark}" + self.close(self.alternatives()) + ")"
                self.depth_look -= ahead
                return out
        if m := re.compile(r"<([A-Za-z][A-Za-z0-9]*)>").match(self.s, self.i):
            self.i = m.end()
            self.groups += 1
            if self.depth_look > 0:
                raise UnsupportedPattern("capture inside a look-ahead")
            return f"(?<{m[1]}>" + self.close(self.alternatives()) + ")"
        if m := re.compile(r"([igKmxd]*)(-[igKmxd]+)?([:)])").match(self.s, self.i):
            self.i = m.end()
            on, off = m[1], (m[2] or "-")[1:]
            if "g" in on or "K" in on:
                raise UnsupportedPattern("grapheme and equivalence modes: use the mode arguments of the search")
            keep = lambda f: "".join("iu" if x == "i" else x for x in f if x in "im")
            flags = keep(on) + (f"-{keep(off)}" if keep(off) else "")
            if m[3] == ")":
                return f"(?{flags})" if flags else ""
            return (f"(?{flags}:" if flags else "(?:") + self.close(self.alternatives()) + ")"
        raise UnsupportedPattern(f"group at {self.i} in {self.s!r}")

    # -- escapes

    def code(self, c: str) -> str | None:
        """Escapes that name one character."""
        simple = {"a": 7, "e": 27, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
        if c in simple:
            return chr(simple[c])
        if c == "c":
            self.i += 1
            return chr(ord(self.s[self.i - 1].upper()) ^ 64)
        if c == "0":
            m = re.compile(r"[0-7]{0,3}").match(self.s, self.i)
            self.i = m.end()
            return chr(int(m[0] or "0", 8))
        if c == "o" and self.take("{"):
            return chr(int(self.until("}"), 8))
        if c in "xu" and self.take("{"):
            return chr(int(self.until("}"), 16))
        for letter, least, most in (("x", 1, 2), ("u", 4, 4), ("U", 8, 8)):
            if c == letter:
                m = re.compile(rf"[0-9A-Fa-f]{{{least},{most}}}").match(self.s, self.i)
                if not m:
                    raise UnsupportedPattern(f"escape \\{c}")
                self.i = m.end()
                return chr(int(m[0], 16))
        return None

    def property(self) -> str:
        body = self.until("}")
        m = re.fullmatch(r"\^?([\w\s-]+?)\s*(?:(!?[=:])\s*(.*))?", body, re.S)
        if not m:
            raise UnsupportedPattern(f"property {body}")
        name, op, value = m.groups()
        if value is None:
            out = charset.property_class(name.strip())
        elif len(value) > 1 and value[0] == value[-1] == "/":
            out = charset.matching_class(name, value[1:-1])
        elif len(value) > 1 and value[0] == value[-1] == "@":
            out = charset.property_equals(name, value[1:-1]).java()
        elif value.startswith("\\"):
            raise UnsupportedPattern("property of a captured character")
        else:
            out = charset.property_class(name, value)
        return negated(out) if body.startswith("^") != bool(op and op[0] == "!") else out

    def class_escape(self, c: str) -> str | None:
        """Escapes that name a set."""
        sets = {"d": DIGIT, "s": SPACE, "w": WORD}
        if c.lower() in sets:
            return sets[c.lower()] if c.islower() else negated(sets[c.lower()])
        if c in "pP" and self.take("{"):
            out = self.property()
            return out if c == "p" else negated(out)
        if c == "N" and self.take("{"):
            return charset.named(self.until("}")).java()
        return None

    def escape(self) -> str:
        if self.i >= len(self.s):
            raise UnsupportedPattern("a backslash at the end")
        c = self.s[self.i]
        self.i += 1
        if c in "123456789":
            return f"\\{c}"
        if (out := self.class_escape(c)) is not None:
            return out
        before, after = f"(?<={WORD})", f"(?={WORD})"
        if c in "bB":
            if self.take("{"):
                kind = self.until("}")
                if kind == "g":
                    edge = r"\b{g}"
                elif kind == "w":
                    raise UnsupportedPattern("word boundaries of level 2 in a pattern")
                else:
                    name, _, value = kind.partition("=")
                    p = charset.property_class(name, value or None)
                    edge = f"(?:(?<={p})(?!{p})|(?<!{p})(?={p}))"
                return edge if c == "b" else f"(?!{edge})"
            edge = f"(?:{before}(?!{WORD})|(?<!{WORD}){after})"
            return edge if c == "b" else f"(?!{edge})"
        if c == "<":
            return f"(?<!{WORD}){after}"
        if c == ">":
            return f"{before}(?!{WORD})"
        if c == "X":
            return r"\X"
        if c == "A" and self.take("{"):
            return self.permutation()
        if c == "q":
            raise UnsupportedPattern(r"\q")
        out = self.code(c)
        return quote(c if out is None else out)

    def permutation(self) -> str:
        r"""\A{a|b|c}: every order; ``a<b`` keeps a before b."""
        parts, chains = [], []
        while True:
            chain = [len(parts)]
            parts.append(self._part())
            while self.take("<"):
                chain.append(len(parts))
                parts.append(self._part())
            chains.append(chain)
            if self.take("}"):
                break
            if not self.take("|"):
                raise UnsupportedPattern("permutation")
        if len(parts) > 8:
            raise UnsupportedPattern("a permutation of more than 8 parts")
        ok = [p for p in itertools.permutations(range(len(parts))) if all(p.index(a) < p.index(b) for ch in chains for a, b in itertools.pairwise(ch))]
        return "(?:" + "|".join("".join(parts[k] for k in p) for p in ok) + ")"

    def _part(self) -> str:
        out = []
        while self.i < len(self.s) and self.s[self.i] not in "|}<":
            out.append(self.quantified(self.item()))
        return "".join(out)

    # -- bracket classes

    def bracket(self) -> str:
        if self.take("|"):
            body = self.until("|]")
            if len(body) > 8:
                raise UnsupportedPattern("a permutation of more than 8 characters")
            return "(?:" + "|".join(quote("".join(p)) for p in itertools.permutations(body)) + ")"
        not_ = self.take("^")
        out = self.set_items(first=True)
        while not self.take("]"):
            if self.take("&&"):
                out = f"[{out}]&&[{self.set_items()}]"
            elif self.take("--"):
                out = f"[{out}]&&[^{self.set_items()}]"
            else:
                raise UnsupportedPattern(f"class in {self.s!r}")
        return f"[^{out}]" if not_ and "&&" not in out else f"[^[{out}]]" if not_ else f"[{out}]"

    def set_items(self, first: bool = False) -> str:
        out = []
        while True:
            if self.i >= len(self.s):
                raise UnsupportedPattern(f"missing ] in {self.s!r}")
            if self.peek("]") and not (first and not out):
                return "".join(out)
            if self.peek("&&") or self.peek("--") and out and not self.peek("--]"):
                return "".join(out)
            first_code, text = self.set_item()
            if first_code is not None and self.peek("-") and not self.peek("-]") and not self.peek("--"):
                self.i += 1
                last, _ = self.set_item()
                if last is None or last < first_code:
                    raise UnsupportedPattern("range")
                text = f"{quote(chr(first_code))}-{quote(chr(last))}"
            out.append(text)

    def set_item(self) -> tuple[int | None, str]:
        c = self.s[self.i]
        self.i += 1
        if c == "[":
            if self.take(":"):
                name = self.until(":]")
                key = name.lstrip("^")
                cls = charset.property_class(key) if key.lower() in _POSIX else charset.property_class(*key.split("=", 1))
                return None, negated(cls) if name.startswith("^") else cls
            if self.take("."):
                name = self.until(".]")
                return (ord(name), quote(name)) if len(name) == 1 else (None, charset.named(name).java())
            if self.take("="):
                name = self.until("=]")
                base = charset.value_of("nfd")(name)[0]
                return None, charset.property_set("nfd", lambda v: v[:1] == base).java()
            return None, self.bracket()
        if c == "\\":
            e = self.s[self.i]
            self.i += 1
            if (cls := self.class_escape(e)) is not None:
                return None, cls
            if e == "b":
                return 8, r"\x08"
            out = self.code(e)
            out = e if out is None else out
            return ord(out), quote(out)
        return ord(c), quote(c)


def pcre(pattern: str) -> str:
    return _Pcre(pattern).whole()


def ere(pattern: str) -> str:
    r"""POSIX extended: ``\<``, ``\>`` and ``\b`` as there, no other letter escapes, a literal brace where no bounds stand."""
    return pcre(re.sub(r"\\([^<>bBwWsS0-9\W])", r"\1", pattern))


def bre(pattern: str) -> str:
    r"""POSIX basic: ``\( \) \{ \} \| \+ \?`` are operators, the bare characters are literal; a leading ``*`` is literal."""
    out, i, start = [], 0, True
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            out.append(e if e in "(){}|+?" else c + e)
            i, start = i + 2, e in "(|"
            continue
        if c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
            while end > 0 and pattern[i:end].rfind("[:") > pattern[i:end].rfind(":]"):
                end = pattern.find("]", end + 1)
            if end < 0:
                raise UnsupportedPattern(f"missing ] in {pattern!r}")
            out.append(pattern[i : end + 1])
            i, start = end + 1, False
            continue
        if c in "(){}|+?" or c == "*" and start or c == "^" and not start or c == "$" and i + 1 < len(pattern) and not pattern.startswith(("\\)", "\\|"), i + 1):
            out.append("\\" + c)
        else:
            out.append(c)
        start = start and c == "^"
        i += 1
    return pcre("".join(out))


def fixed(pattern: str) -> str:
    """Lines of literal text, any of which may match."""
    return "|".join(quote(line) for line in pattern.split("\n"))


def glob(pattern: str, kind: str = "file") -> str:
    """Shell patterns over paths. ``file``: wildcards stop at ``/`` and don't match a leading dot; ``git``: so do they, ``**`` spans
    folders, a pattern without ``/`` fits at any depth; ``grep``: wildcards match anything in a line."""
    i, out, start = 0, [], True
    slash, dot = ("[^/]", "(?![.])" if kind == "file" else "") if kind != "grep" else (NOT_BREAK, "")
    while i < len(pattern):
        c = pattern[i]
        if kind == "git" and pattern.startswith("**/", i) and start:
            out.append("(?:[^/]*/)*")
            i += 3
            continue
        if kind == "git" and pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append(f"{dot if start else ''}{slash}*")
            i += 1
        elif c == "?":
            out.append(f"{dot if start else ''}{slash}")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] in ("!", "^") else 2))) > 0:
            body = pattern[i + 1 : end]
            no = body[:1] in ("!", "^")
            inner = "".join("\\" + x if x in "\\[]&^~" else x for x in (body[1:] if no else body))
            out.append(f"{dot if start else ''}(?!/)[{'^' if no else ''}{inner}]")
            i = end + 1
        elif c == "{" and (end := pattern.find("}", i)) > 0 and kind != "grep":
            out.append("(?:" + "|".join(quote(x) for x in pattern[i + 1 : end].split(",")) + ")")
            i = end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out.append(quote(pattern[i + 1]))
            i += 2
        else:
            out.append(quote(c))
            i += 1
        start = pattern[i - 1] == "/"
    body = "".join(out)
    if kind == "git":
        if "/" in pattern.rstrip("/"):
            body = body.lstrip("/")
        else:
            body = "(?:[^/]*/)*" + body
    return body if kind == "grep" else f"^(?:{body})$"


_AMINO = "ACDEFGHIKLMNPQRSTVWY"


def prosite(pattern: str) -> str:
    """Protein motifs: ``A-x(2,4)-[ST]-{P}``, ``<`` and ``>`` for the ends, a final full stop."""
    out = []
    for part in pattern.strip().rstrip(".").split("-"):
        m = re.fullmatch(r"(<?)(x|[A-Z]|\[[A-Z>]+\]|\{[A-Z]+\})(?:\((\d+)(?:,(\d+))?\))?(>?)", part)
        if not m:
            raise UnsupportedPattern(f"motif {part!r}")
        one = m[2]
        if one == "x":
            one = f"[{_AMINO}]"
        elif one[0] == "{":
            one = "[" + "".join(a for a in _AMINO if a not in one) + "]"
        elif ">" in one:
            one = f"(?:[{one[1:-1].replace('>', '')}]|$)"
        out.append(("^" if m[1] else "") + one + (f"{{{m[3]}{',' + m[4] if m[4] else ''}}}" if m[3] else "") + ("$" if m[5] else ""))
    return "".join(out)


SYNTAXES = {"pcre": pcre, "ere": ere, "bre": bre, "fixed": fixed, "glob": lambda p: glob(p, "grep"), "prosite": prosite}


def translate(pattern: str | list[str], syntax: str = "pcre", ignore_case: bool = False, word: bool = False, line: bool = False) -> str:
    """One Java pattern for a pattern or several (any may match)."""
    if syntax not in SYNTAXES:
        raise UnsupportedPattern(f"syntax {syntax}")
    each = [SYNTAXES[syntax](p) for p in ([pattern] if isinstance(pattern, str) else pattern)]
    body = each[0] if len(each) == 1 else "|".join(f"(?:{p})" for p in each)
    if word:
        body = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))(?:{body})(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
    if line:
        body = f"^(?:{body})$"
    return f"(?iu){body}" if ignore_case else body


#: One character that is no line break, of a width that doesn't vary: a literal or a plain class.
_ONE = re.compile(r"[^\\.\[\]{}()*+?^$|\n\x0B\x0C\r\x85\u2028\u2029]|\\[^A-Za-z0-9\s]|\[(?:[A-Za-z0-9 _,;:=!/]|\\[^A-Za-z0-9\s])(?:-(?=[A-Za-z0-9])|[A-Za-z0-9 _,;:=!/]|\\[^A-Za-z0-9\s])*\]")


def _marks(java: str) -> Iterator[tuple[int, str, int]]:
    """Parentheses and bars outside of classes and escapes: place, character, depth after it."""
    depth, inside, i = 0, 0, 0
    while i < len(java):
        c = java[i]
        if c == "\\":
            i += 1
        elif c == "[":
            inside += 1
        elif c == "]" and inside:
            inside -= 1
        elif c in "()|" and not inside:
            depth += {"(": 1, ")": -1}.get(c, 0)
            yield i, c, depth
        i += 1


def _linear(java: str) -> list[str]:
    """One alternative; see ``for_test``."""
    for dot, edge in ((DOT, BREAK), (NOT_BREAK, r"\n")):
        heads, head, i = [], "", 0
        while i < len(java):
            if java.startswith(dot, i):
                i += len(dot)
                mark = java[i : i + 1]
                if mark in ("*", "+") and java[i + 1 : i + 2] not in ("+", "?", "*", "{"):
                    i += 1
                    heads.append(head + (dot if mark == "+" else ""))
                    head, rest = "", java[i:]
                    continue
                head += dot
            elif m := _ONE.match(java, i):
                head += m[0]
                i = m.end()
            else:
                break
            if java[i : i + 1] in ("*", "+", "?", "{"):
                break
        if heads:
            return [rest] * bool(rest) + [rf"(?:\A|{edge})" + "".join(f"(?>{dot}*?{h})" for h in heads if h) + f"{dot}*?(?:{rest})"]
    return [java]


def for_test(java: str) -> list[str]:
    """Java patterns that are all found in just the texts in which ``java`` is, at other places: for tests only.

    ``a.*b`` looks from every ``a`` to the end of its line where no ``b`` follows. What follows one of them follows the first of its line
    too, if all are equally wide; so only that is tried, from the start of the line, and time is linear in the line. ``b`` alone
    is looked up first, as that is fastest.
    """
    flags = "(?iu)" if java.startswith("(?iu)") else ""
    body = java.removeprefix(flags)
    if re.search(r"\(\?[a-z]*(?:-[a-z]+)?\)|\\[QE]", body):  # settings that hold from their place on
        return [java]
    marks = list(_marks(body))
    cuts = [i for i, c, depth in marks if c == "|" and not depth]
    if cuts:
        return [flags + "|".join(f"(?:{for_test(body[a + 1 : b])[-1]})" for a, b in itertools.pairwise([-1, *cuts, len(body)]))]
    if body.startswith("(?:") and next((i for i, _, depth in marks if not depth), -1) == len(body) - 1:
        return [flags + p for p in for_test(body[3:-1])]
    return [flags + p for p in _linear(body)]


_REPLACE = re.compile(r"\$\$|\$(\d+)|\$\{(\d+)\}|\$\{(\w+)\}|\$(\w+)|\\(\d)|\\x\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{1,2})|\\(.)|([\\$])|([^\\$]+)", re.S)


def replacement(text: str) -> str:
    """A replacement in the source language as Java's; line breaks are refused."""
    controls = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v", "e": "\x1b", "a": "\a"}
    out = []
    for m in _REPLACE.finditer(text):
        number, braced, name, bare, back, hex_, short, other, _, plain = m.groups()
        if number or braced or back:
            out.append(f"${number or braced or back}")
            continue
        if name or bare:
            out.append(f"${{{name or bare}}}")
            continue
        char = plain if plain is not None else "$" if m[0] == "$$" else chr(int(hex_ or short, 16)) if hex_ or short else controls.get(other, other) if other else None
        if char is None:
            raise UnsupportedPattern(f"replacement {text!r}")
        if "\n" in char or "\r" in char:
            raise UnsupportedPattern("a line break in the replacement")
        out.append(char.replace("\\", "\\\\").replace("$", "\\$"))
    return "".join(out)
