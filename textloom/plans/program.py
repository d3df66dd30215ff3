"""Bit-stream programs: kernels written as text, compiled to window expressions over a position table.

::

    kernel quoted :: [<i1> q, <i1> x] -> [<i1> inside] {
        start = Advance(q, 1) & ~q
        inside = ScanThru(start, ~q) | x
    }

Expressions have ``& | ^ ~``, parentheses, names and the functions of ``FUNCTIONS``; ``if (e) { ... }`` runs its
statements in texts in which ``e`` has a mark. Loops have no plan of fixed size and are refused.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, Window, functions as F

from textloom.operators import positional as P

_TOKEN = re.compile(r"\s*(?:(//[^\n]*|#[^\n]*)|([A-Za-z_]\w*)|(\d+)|(::|->|[\[\](){}<>,=&|^~:;]))")


class ProgramError(ValueError):
    """A program that can't be read or planned."""


def _read(text: str) -> list[str]:
    out, i = [], 0
    while i < len(text.rstrip()):
        m = _TOKEN.match(text, i)
        if not m:
            raise ProgramError(f"at {text[i : i + 20]!r}")
        if not m[1]:
            out.append(m[2] or m[3] or m[4])
        i = m.end()
    return out


class Kernel:
    """A compiled kernel: ``kernel(df)`` adds the outputs to a position table that has the inputs."""

    FUNCTIONS = ("Advance", "Lookahead", "MatchStar", "ScanThru", "ScanTo", "AdvanceThenScanThru", "AdvanceThenScanTo", "Sel", "Count", "InFile", "AtEOF", "SpanUpTo", "InclusiveSpan", "ExclusiveSpan", "EveryNth", "And3", "Or3", "Xor3", "Majority3")

    def __init__(self, text: str):
        self.t, self.i = _read(text), 0
        self.want("kernel")
        self.name = self.next()
        self.want("::")
        self.inputs = self.streams()
        self.want("->")
        self.outputs = self.streams()
        self.body = self.block()

    def next(self) -> str:
        if self.i >= len(self.t):
            raise ProgramError("the program ends early")
        self.i += 1
        return self.t[self.i - 1]

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def want(self, x: str) -> None:
        if (got := self.next()) != x:
            raise ProgramError(f"{x!r} is expected, not {got!r}")

    def streams(self) -> list[str]:
        self.want("[")
        out = []
        while self.peek() != "]":
            self.want("<")
            self.next()
            self.want(">")
            if self.peek() == "[":
                self.next(), self.next()
                self.want("]")
            out.append(self.next())
            if self.peek() == ",":
                self.next()
        self.want("]")
        return out

    def block(self) -> list:
        self.want("{")
        out = []
        while self.peek() != "}":
            if self.peek() == ";":
                self.next()
            elif self.peek() == "while":
                raise ProgramError("loops have no plan of fixed size")
            elif self.peek() == "if":
                self.next()
                out.append(("if", self.expression(), self.block()))
            else:
                name = self.next()
                self.want("=")
                out.append(("set", name, self.expression()))
        self.want("}")
        return out

    def expression(self, level: int = 0):
        ops = ("|", "^", "&")
        if level == len(ops):
            return self.unary()
        left = self.expression(level + 1)
        while self.peek() == ops[level]:
            self.next()
            left = (ops[level], left, self.expression(level + 1))
        return left

    def unary(self):
        x = self.next()
        if x == "~":
            return ("~", self.unary())
        if x == "(":
            inner = self.expression()
            self.want(")")
            return inner
        if x.isdigit():
            return int(x)
        if self.peek() != "(":
            return x
        if x not in self.FUNCTIONS:
            raise ProgramError(f"function {x}")
        self.next()
        args = []
        while self.peek() != ")":
            args.append(self.expression())
            if self.peek() == ",":
                self.next()
        self.want(")")
        return (x, *args)

    def __call__(self, df: DataFrame, key: str = P.KEY) -> DataFrame:
        names = (f"_k{n}" for n in itertools.count())
        known = {n: n for n in self.inputs}
        made: list[str] = []

        def put(col) -> str:
            nonlocal df
            name = next(names)
            made.append(name)
            df = df.withColumn(name, col)
            return name

        def emit(e) -> str:
            nonlocal df
            if isinstance(e, int):
                return put(F.lit(bool(e)))
            if isinstance(e, str):
                if e not in known:
                    raise ProgramError(f"name {e}")
                return known[e]
            op, *args = e
            ints = [a for a in args if isinstance(a, int)]
            cols = [emit(a) for a in args if not isinstance(a, int)]
            c = [F.col(x) for x in cols]
            if op == "~":
                return put(~c[0])
            if op in "&|^":
                return put({"&": lambda: c[0] & c[1], "|": lambda: c[0] | c[1], "^": lambda: c[0] != c[1]}[op]())
            simple = {
                "Advance": lambda: P.advance(c[0], *ints, key=key), "Lookahead": lambda: P.lookahead(c[0], *ints, key=key), "Sel": lambda: P.select_by(*c),
                "InFile": lambda: c[0], "AtEOF": lambda: c[0] & P.at_eof(key), "SpanUpTo": lambda: P.span_up_to(cols[0], cols[1], key),
                "InclusiveSpan": lambda: P.inclusive_span(cols[0], cols[1], key), "ExclusiveSpan": lambda: P.exclusive_span(cols[0], cols[1], key), "EveryNth": lambda: P.every_nth(c[0], ints[0], key),
                "Count": lambda: F.sum(F.when(c[0], 1).otherwise(0)).over(Window.partitionBy(key)), "And3": lambda: c[0] & c[1] & c[2], "Or3": lambda: c[0] | c[1] | c[2],
                "Xor3": lambda: (c[0] != c[1]) != c[2], "Majority3": lambda: P.majority3(*c),
            }
            if op in simple:
                return put(simple[op]())
            name = next(names)
            made.append(name)
            step = {"MatchStar": P.match_star, "ScanThru": P.scan_thru, "ScanTo": P.scan_to, "AdvanceThenScanThru": P.advance_then_scan_thru, "AdvanceThenScanTo": P.advance_then_scan_to}[op]
            df = step(df, cols[0], cols[1], name, key)
            return name

        def run(body: list, when: str | None) -> None:
            for s in body:
                if s[0] == "if":
                    test = emit(s[1])
                    any_ = put(F.max(F.col(test)).over(Window.partitionBy(key)))
                    run(s[2], any_ if when is None else put(F.col(any_) & F.col(when)))
                    continue
                value = emit(s[2])
                if when is not None:
                    old = F.col(known[s[1]]) if s[1] in known else F.lit(False)
                    value = put(F.when(F.col(when), F.col(value)).otherwise(old))
                known[s[1]] = value

        run(self.body, None)
        for out in self.outputs:
            if out not in known:
                raise ProgramError(f"output {out} is never set")
            df = df.withColumn(f"_out_{out}", F.col(known[out]))
        return df.drop(*made).withColumnsRenamed({f"_out_{o}": o for o in self.outputs}) if not set(self.outputs) & set(df.columns) else df.drop(*made, *self.outputs).withColumnsRenamed({f"_out_{o}": o for o in self.outputs})
