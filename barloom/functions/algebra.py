"""The factor algebra: formula text to an expression tree.

Notation. Columns O H L C V VW AMT RET CAP BMC BMO; E is 1e-10. Cross-section (per
date): RANK SCALE INDNEUT. Row windows (per code, by date): DELAY DELTA SUM MEAN STD
TSMIN TSMAX CORR COV ADV COUNT SUMIF CUMSUM CUMPROD REGBETA(y, x, n[, least]). Array windows: ARGMIN ARGMAX TSRANK PROD
DECAY WMA HIGHDAY LOWDAY SLOPE. Recursive: EMA(x, n, m). Element-wise: SIGN ABS LOG
SPOW MAX2 MIN2 NUM IF, arithmetic with ^, comparisons, AND OR NOT. `WITH a=...; b=...`
names shared parts.

Trees are tuples, equal if their formulas are, so shared parts are found by equality.
"""

from __future__ import annotations

import re

Node = tuple

CROSS = {"RANK", "SCALE", "INDNEUT"}
ROLLING = {"DELAY", "SUM", "MEAN", "STD", "TSMIN", "TSMAX", "COUNT", "SUMIF", "CUMSUM", "CUMPROD", "CORR", "COV", "REGBETA"}
ARRAY = {"ARGMIN", "ARGMAX", "TSRANK", "PROD", "DECAY", "WMA", "HIGHDAY", "LOWDAY", "SLOPE"}
RECURSIVE = {"EMA"}
WINDOWED = CROSS | ROLLING | ARRAY | RECURSIVE
COLUMNS = {"O": "open", "H": "high", "L": "low", "C": "close", "V": "volume", "VW": "vwap", "AMT": "amount", "RET": "ret", "CAP": "cap", "BMC": "bm_close", "BMO": "bm_open"}
_TOKEN = re.compile(r"\s*(?:([0-9]+\.?[0-9]*(?:e-?[0-9]+)?)|([A-Za-z_][A-Za-z_0-9]*)|(<=|>=|[-+*/^(),<>=]))")


def parse(text: str) -> Node:
    body, _, shared = text.partition("WITH")
    names: dict[str, Node] = {}
    for item in filter(None, (x.strip() for x in shared.split(";"))):
        name, _, formula = item.partition("=")
        names[name.strip()] = _Parser(formula, names).whole()
    return _Parser(body, names).whole()


class _Parser:
    def __init__(self, text: str, names: dict[str, Node]):
        self.tokens, self.names, at = [], names, 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"left over: {self.tokens[self.at:]}")
        return node

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1]
        return ""

    def chain(self, below, **ops: str) -> Node:
        node = below()
        while op := self.take(*ops):
            node = (ops[op], node, below())
        return node

    def either(self) -> Node:
        return self.chain(self.both, OR="or")

    def both(self) -> Node:
        return self.chain(self.compared, AND="and")

    def compared(self) -> Node:
        return self.chain(self.added, **{"<": "lt", ">": "gt", "<=": "le", ">=": "ge", "=": "eq"})

    def added(self) -> Node:
        return self.chain(self.multiplied, **{"+": "add", "-": "sub"})

    def multiplied(self) -> Node:
        return self.chain(self.signed, **{"*": "mul", "/": "div"})

    def signed(self) -> Node:
        return ("neg", self.signed()) if self.take("-") else self.powered()

    def powered(self) -> Node:
        node = self.atom()
        return ("pow", node, self.signed()) if self.take("^") else node

    def atom(self) -> Node:
        token = self.peek()
        self.at += 1
        if token == "(":
            node = self.either()
            self.take(")")
            return node
        if token[0].isdigit():
            return ("num", float(token))
        if token == "E":
            return ("num", 1e-10)
        if self.take("("):
            args = [self.either()]
            while self.take(","):
                args.append(self.either())
            if not self.take(")"):
                raise ValueError(f"{token} is not closed")
            return called(token, *args)
        if token in self.names:
            return self.names[token]
        if token in COLUMNS:
            return ("col", COLUMNS[token])
        raise ValueError(f"unknown name {token}")


def called(name: str, *args: Node) -> Node:
    """A call, with the short forms written out."""
    if name == "DELTA":
        return ("sub", args[0], ("DELAY", args[0], args[1]))
    if name == "ADV":
        return ("MEAN", ("col", "volume"), args[0])
    if name == "NOT":
        return ("not", args[0])
    if name in WINDOWED | {"SIGN", "ABS", "LOG", "SPOW", "MAX2", "MIN2", "NUM", "IF"}:
        return (name, *args)
    raise ValueError(f"unknown operator {name}")


def depth(node: Node) -> int:
    """Window layers in the tree."""
    below = max((depth(x) for x in node[1:] if isinstance(x, tuple)), default=0)
    return below + (node[0] in WINDOWED)


def windows(node: Node, found: dict[Node, int] | None = None) -> dict[Node, int]:
    """The window nodes of a tree with their layers."""
    found = {} if found is None else found
    if node not in found:
        for x in node[1:]:
            if isinstance(x, tuple):
                windows(x, found)
        if node[0] in WINDOWED:
            found[node] = depth(node)
    return found


def exponents(node: Node) -> frozenset[Node]:
    """The correlations that are exponents of signed powers. With gaps in one series they are not between -1 and 1, so such a power may have any size."""
    below = frozenset().union(*[exponents(x) for x in node[1:] if isinstance(x, tuple)])
    return below | {node[2]} if node[0] == "SPOW" and node[2][0] == "CORR" else below
