"""Hexadecimal, bit and constant-expression helpers. Nothing here evaluates code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_hex(text: Column) -> Column:
    """`0x1F` or `1F` -> 31 as bigint; null if it is no hexadecimal number."""
    plain = F.regexp_replace(F.trim(text), "^0[xX]", "")
    return F.when(plain.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(plain, 16, 10).cast("bigint"))


def to_hex(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(number))


def mask_width(mask: Column) -> Column:
    """Number of bits from the lowest set bit of a mask to its highest."""
    return F.when(mask == 0, 0).otherwise(F.length(F.regexp_replace(F.bin(mask), "0+$", "")))


def bit_range(text: Column) -> Column:
    """`31-16`, `31:16` or `7` -> the bits it names, ascending, both ends included."""
    ends = F.transform(F.split(text, "[-:]"), lambda x: F.trim(x).cast("int"))
    return F.when(text.rlike(r"^\s*\d+(\s*[-:]\s*\d+)?\s*$"), F.sequence(F.array_min(ends), F.array_max(ends))).otherwise(F.array().cast("array<int>"))


def bit_range_compat(text: Column) -> Column:
    """The compatible form: bounds sorted as strings, upper bound excluded."""
    ends = F.transform(F.sort_array(F.split(F.replace(text, F.lit(" "), F.lit("")), "[-:]")), lambda x: x.cast("int"))
    lo, hi = F.get(ends, F.lit(0)), F.get(ends, F.size(ends) - 1)
    return F.when(F.size(ends) == 1, F.array(lo)).when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))


_TOKEN = re.compile(r"\s*(?:(0[xX][0-9A-Fa-f]+|\d+)([uUlL]*)(?![\w.])|([A-Za-z_]\w*)|(<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%|&^~!<>?:()]))")
_CAST = re.compile(r"\s*\(\s*(u?)int(8|16|32|64)_t\s*(\*?)\s*\)")
#: Binary operators from the loosest to the tightest.
_LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
_WORD = 1 << 64


class _Number:
    """A 64-bit integer as C sees it: bits and whether they are unsigned."""

    __slots__ = ("bits", "unsigned")

    def __init__(self, value: int, unsigned: bool = False):
        self.bits, self.unsigned = value % _WORD, unsigned

    @property
    def value(self) -> int:
        return self.bits if self.unsigned or self.bits < _WORD // 2 else self.bits - _WORD

    def cast(self, width: int, unsigned: bool) -> _Number:
        low = self.bits % (1 << width)
        return _Number(low if unsigned or low < 1 << (width - 1) else low - (1 << width), unsigned)


def _binary(op: str, a: _Number, b: _Number) -> _Number:
    if op in ("<<", ">>"):
        if not 0 <= b.value < 64:
            raise ValueError(f"shift by {b.value}")
        return _Number(a.bits << b.value if op == "<<" else a.value >> b.value, a.unsigned)
    unsigned = a.unsigned or b.unsigned
    x, y = _Number(a.bits, unsigned).value, _Number(b.bits, unsigned).value
    if op in ("/", "%"):
        if y == 0:
            raise ZeroDivisionError(op)
        quotient = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        return _Number(quotient if op == "/" else x - quotient * y, unsigned)
    if op in ("==", "!=", "<", ">", "<=", ">="):
        return _Number(int({"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]))
    return _Number({"+": x + y, "-": x - y, "*": x * y, "|": x | y, "&": x & y, "^": x ^ y}[op], unsigned)


class _Expression:
    """Parser by precedence; what is not chosen by `?:`, `&&` or `||` is parsed but not computed."""

    def __init__(self, text: str, names: dict, depth: int):
        if depth == 0:
            raise ValueError(f"names refer to each other without end: {text}")
        self.text, self.names, self.depth, self.at, self.tokens = text, names, depth, 0, []
        at, text = 0, text.strip()
        while at < len(text):
            if m := _CAST.match(text, at):
                # Addresses are numbers: a cast to a pointer changes nothing.
                if not m[3]:
                    self.tokens.append(("cast", (int(m[2]), m[1] == "u")))
            elif m := _TOKEN.match(text, at):
                if m[1]:
                    value = int(m[1], 16 if m[1][:2] in ("0x", "0X") else 8 if m[1][0] == "0" else 10)
                    self.tokens.append(("number", _Number(value, "u" in m[2].lower() or value >= _WORD // 2)))
                else:
                    self.tokens.append(("name", m[3]) if m[3] else ("sign", m[4]))
            else:
                raise ValueError(f"not a constant expression: {self.text}")
            at = m.end()

    def peek(self):
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" else None

    def expect(self, sign: str) -> None:
        if self.peek() != sign:
            raise ValueError(f"missing {sign} in {self.text}")
        self.at += 1

    def whole(self) -> _Number:
        found = self.choice(True)
        if self.at < len(self.tokens):
            raise ValueError(f"left over {self.tokens[self.at][1]!r} in {self.text}")
        return found

    def choice(self, live: bool) -> _Number:
        test = self.level(0, live)
        if self.peek() != "?":
            return test
        self.at += 1
        yes = self.choice(live and bool(test.bits))
        self.expect(":")
        no = self.choice(live and not test.bits)
        return _Number((yes if test.bits else no).bits, yes.unsigned or no.unsigned)

    def level(self, k: int, live: bool) -> _Number:
        if k == len(_LEVELS):
            return self.unary(live)
        left = self.level(k + 1, live)
        while (op := self.peek()) in _LEVELS[k]:
            self.at += 1
            if op in ("&&", "||"):
                decided = bool(left.bits) == (op == "||")
                right = self.level(k + 1, live and not decided)
                left = _Number(int(bool(left.bits) if decided else bool(right.bits)))
            else:
                right = self.level(k + 1, live)
                left = _binary(op, left, right) if live else left
        return left

    def unary(self, live: bool) -> _Number:
        if self.at == len(self.tokens):
            raise ValueError(f"ends too early: {self.text}")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return token
        if kind == "cast":
            return self.unary(live).cast(*token)
        if kind == "name":
            if token not in self.names:
                raise ValueError(f"unknown {token!r} in {self.text}")
            value = self.names[token]
            return _Number(value) if isinstance(value, int) else _Expression(value, self.names, self.depth - 1).whole() if live else _Number(0)
        if token == "(":
            found = self.choice(live)
            self.expect(")")
            return found
        if token in ("-", "+", "~", "!"):
            x = self.unary(live)
            return {"-": lambda: _Number(-x.value, x.unsigned), "+": lambda: x, "~": lambda: _Number(~x.value, x.unsigned), "!": lambda: _Number(int(not x.bits))}[token]()
        raise ValueError(f"unexpected {token!r} in {self.text}")


def evaluate(text: str, names: dict[str, int | str] | None = None, depth: int = 40) -> int:
    """A constant integer expression by C's rules in 64 bits; names may stand for further expressions.

    Division truncates, `010` is octal, a `u` suffix makes a number unsigned and arithmetic wraps. Casts to integer types
    cut; those to pointers are skipped. Unknown names, other syntax and endless recursion raise ValueError.
    """
    return _Expression(text, names or {}, depth).whole().value


def evaluate_uint64(text: str, names: dict[str, int | str] | None = None) -> int:
    """The value as an unsigned 64-bit number, as a header's macros are printed."""
    return evaluate(text, names) % _WORD


def linear_offset(formula: Column, x: Column) -> Column:
    """Value of `base + x*step (+ more)`; parts in any order, decimal or hexadecimal, blanks ignored."""
    terms = F.split(F.regexp_replace(formula, r"\s+|[()]", ""), r"\+")
    number = lambda t: F.when(t.rlike("^0[xX]"), from_hex(t)).otherwise(t.cast("bigint"))

    def value(t: Column) -> Column:
        # The x of a hexadecimal prefix is no variable.
        variable = F.regexp_replace(t, "0[xX][0-9A-Fa-f]+", "").contains("x")
        plain = F.regexp_replace(F.regexp_replace(t, r"^x\*|\*x$", ""), r"^x$", "1")
        return F.when(variable, x * number(plain)).otherwise(number(t))

    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(value(t), F.lit(0)))
