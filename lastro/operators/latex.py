"""LaTeX equations to expressions, and expressions back to values: a small computer algebra.

Expressions are written as nested constructors, e.g. ``Equality(Symbol('K'), Mul(Symbol('L'), ...))``,
in the order in which the formula is written.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys

#: Greek letters that name symbols.
GREEK = frozenset(
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
)
#: LaTeX functions and their expression heads; relations and their heads.
FUNCTIONS = {"ln": "log", "log": "log", "exp": "exp", "sqrt": "sqrt", "sin": "sin", "cos": "cos", "tan": "tan", "min": "Min", "max": "Max"}
RELATIONS = {"=": "Equality", "<": "StrictLessThan", ">": "StrictGreaterThan", "\\le": "LessThan", "\\leq": "LessThan", "\\ge": "GreaterThan", "\\geq": "GreaterThan", "\\neq": "Unequality", "\\ne": "Unequality"}
#: Layout commands without meaning.
LAYOUT = frozenset("left right displaystyle textstyle nonumber notag quad qquad big Big bigl bigr Bigl Bigr".split())
_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\d+(?:\.\d+)?|[A-Za-z]|\S")
PRIME = (1 << 61) - 1


class Loss(ValueError):
    """A formula that cannot be read honestly; the message is the declared reason."""


#: Commands and forms refused before reading, first in precedence first ("..." and "accent" stand for their lists).
REFUSED = ("\\Pr", "\\mathrm{d}", "\\forall", "\\begin{aligned}", "\\begin", "\\exists", "...", "\\\\", "accent", "\\{", "^{(", "_{(", "\\Delta")
DOTS = frozenset("dots cdots ldots vdots ddots".split())
ACCENTS = frozenset("overline underline widehat widetilde hat bar tilde check breve dot ddot vec acute grave mathring overrightarrow overleftarrow underbrace overbrace".split())
BIG_OPERATORS = frozenset("sum prod int oint lim max min sup inf bigcup bigcap".split())
MARKUP = frozenset("mathbb mathrm mathit mathbf mathcal mathsf boldsymbol operatorname text textrm mbox".split())
COMPARISONS = frozenset("= < > \\le \\leq \\ge \\geq \\ne \\neq \\lt \\gt \\approx \\equiv \\sim \\simeq \\ll \\gg \\propto".split())
_RANK = {x: i for i, x in enumerate(REFUSED)}
_CLOSES = {"{": "}", "(": ")", "[": "]"}


class _Stream:
    """The tokens of a formula with what stands around them."""

    def __init__(self, latex: str):
        found = list(_TOKEN.finditer(latex))
        self.t = [m[0] for m in found]
        # A letter right after a letter is part of a word.
        self.lone = [not (i and found[i - 1].end() == m.start() and found[i - 1][0][-1].isalpha()) for i, m in enumerate(found)]

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def shut(self, i: int) -> int:
        """Where the bracket at i is closed, or -1."""
        a, depth = self.at(i), 0
        for j in range(i, len(self.t)):
            depth += (self.t[j] == a) - (self.t[j] == _CLOSES[a])
            if not depth:
                return j
        return -1

    def inner(self, i: int) -> str | None:
        """Text of the group without braces inside that opens at i."""
        j = self.shut(i) if self.at(i) == "{" else -1
        return "".join(self.t[i + 1:j]) if j > 0 and "{" not in self.t[i + 1:j] else None

    def star(self, i: int) -> int:
        """Last token of the star exponent at i (``^*`` or ``^{*}``), or 0."""
        if self.at(i) != "^":
            return 0
        stars = ("*", "\\ast", "\\star")
        return i + 1 if self.at(i + 1) in stars else i + 3 if self.inner(i + 1) in stars else 0

    def base(self, i: int) -> bool:
        """A lone letter or a Greek letter."""
        x = self.at(i)
        return len(x) == 1 and x.isascii() and x.isalpha() and self.lone[i] or x[1:] in GREEK and x[:1] == "\\"


def _refused(s: _Stream) -> str | None:
    """The refused form of the highest precedence."""
    best: tuple[int, str] | None = None
    for i, x in enumerate(s.t):
        name, then = x[1:], s.at(i + 1)
        form, said = x, x
        if name in DOTS and x[0] == "\\":
            form = "..."
        elif name in ACCENTS and x[0] == "\\":
            form = "accent"
        elif x == "\\mathrm" and s.inner(i + 1) == "d":
            form = said = "\\mathrm{d}"
        elif x == "\\begin":
            kind = s.inner(i + 1)
            if kind is None:
                continue
            form, said = "\\begin{aligned}" if kind in ("aligned", "aligned*") else x, f"\\begin{{{kind}}}"
        elif x in ("^", "_") and then == "{" and s.at(i + 2) == "(":
            form = said = f"{x}{{("
        elif x.startswith("\\Delta"):
            if len(x) == 6 and not (then[:1].isalpha() or then[1:] in GREEK and then[:1] == "\\"):
                continue
            form = said = "\\Delta"
        rank = _RANK.get(form, len(REFUSED))
        if rank < (best[0] if best else len(REFUSED)):
            best = (rank, said)
    return best and best[1]


def _scripted(s: _Stream) -> bool:
    """Is there a subscript with an exponent after it that is no limit of an operator?"""
    for i, x in enumerate(s.t):
        if x != "_":
            continue
        if s.at(i + 1) == "{":
            end = s.shut(i + 1) + 1 if s.inner(i + 1) is not None else 0
        else:
            end = i + 2 if len(s.at(i + 1)) == 1 and s.at(i + 1).isalnum() or re.fullmatch(r"\\[A-Za-z]+", s.at(i + 1)) else 0
        before = s.at(i - 1)
        if before in ("\\limits", "\\nolimits"):
            before = s.at(i - 2)
        if end and s.at(end) == "^" and not (before[:1] == "\\" and before[1:] in BIG_OPERATORS):
            return True
    return False


def _symbols_of_several_signs(s: _Stream) -> tuple[list[tuple[str, int]], set[int]]:
    """(name, last token) of symbols like ``x^*``, ``T_{max}`` or ``\\mathit{ab}``, and the markup that has a meaning."""
    found, used = [], set()
    for i, x in enumerate(s.t):
        name, end, word = None, i, s.inner(i + 1)
        plain = re.fullmatch(r"[A-Za-z]+", word or "")
        if s.base(i) and (mark := s.star(i + 1)):
            name, end = "star", mark
        elif s.base(i) and s.at(i + 1) == "_" and s.at(i + 2) == "{":
            end, k = s.shut(i + 2), i + 3
            wrapped = s.at(k) in ("\\text", "\\mathrm", "\\mathit") and s.shut(k + 1) + 1 == end > 0
            name = s.inner(k + 1 if wrapped else i + 2) or ""
            name = name if re.fullmatch(r"[A-Za-z0-9]{2,}", name) else None
            used.update([k] if wrapped and name else [])
        elif x == "\\mathit" and plain:
            name, end = word, s.shut(i + 1)
            used.add(i)
        elif x == "\\operatorname" and plain and s.at(s.shut(i + 1) + 1) == "(" or x == "\\mathbb" and word == "E" and s.at(i + 4) in ("(", "[") and s.shut(i + 4) > 0:
            used.add(i)
        if name:
            found.append((name if x == "\\mathit" else f"{x.lstrip(chr(92))}_{name}", end))
    return found, used


def _applied_bracket(s: _Stream) -> str | None:
    """A lone letter before ``[``: neither product nor application is clear, but for the expectation E[...]."""
    for i, x in enumerate(s.t):
        letter = len(x) == 1 and x.isascii() and x.isalpha() and s.lone[i]
        if letter and s.at(i + 1) == "[" and not (x == "E" and s.shut(i + 1) > 0):
            return f"{x}["
    return None


def _after_power(s: _Stream) -> str | None:
    """An exponent with a subscript or a bracket after it."""
    for i, x in enumerate(s.t):
        then = s.at(i + 1)
        if x != "^" or s.base(i - 1) and s.star(i):
            continue
        end = s.shut(i + 1) if then == "{" else i + 1 if then[:1] == "\\" or len(then) == 1 else -1
        if end > 0 and s.at(end + 1) in ("_", "("):
            return "^{…}" + s.at(end + 1)
    return None


def _chained(s: _Stream) -> bool:
    """More than one relation outside braces?"""
    depth = count = 0
    for x in s.t:
        depth = depth + 1 if x == "{" else max(0, depth - 1) if x == "}" else depth
        count += depth == 0 and x in COMPARISONS
    return count > 1


def _transposed(s: _Stream) -> bool:
    """``e^{T}``: a power of e, or a transposed vector?"""
    for i, x in enumerate(s.t):
        if x == "e" and s.lone[i] and s.at(i + 1) == "^":
            word = s.at(i + 3)[:1].isalnum() and not s.lone[i + 3]
            if s.inner(i + 2) in ("T", "\\top") or s.at(i + 2) == "\\top" or s.at(i + 2) == "T" and not word:
                return True
    return False


def early_loss(latex: str) -> str | None:
    """Why a formula is not read at all, or None: refused forms first, then ambiguous ones in a fixed order."""
    s = _Stream(latex)
    why = _refused(s)
    if not why:
        named, used = _symbols_of_several_signs(s)
        why = (
            next((f"{name}(…)" for name, end in named if s.at(end + 1) == "("), None) or _applied_bracket(s) or _after_power(s) or ("_{…}^" if _scripted(s) else None)
            or next((x for i, x in enumerate(s.t) if x[0] == "\\" and x[1:] in MARKUP and i not in used), None)
            or ("relacao_encadeada" if _chained(s) else None) or ("e^{T}" if _transposed(s) else None)
        )
    return f"nao_suportado:{why}" if why else None


class _Reader:
    """Recursive descent over the tokens of one formula."""

    def __init__(self, latex: str, functions: frozenset[str]):
        self.t = [x for x in _TOKEN.findall(latex) if not (x[0] == "\\" and (x[1:] in LAYOUT or x[1:] in ",;:! "))]
        while self.t and self.t[-1] in (",", ".", ";"):
            self.t.pop()
        self.i = 0
        self.functions = functions

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        x = self.peek()
        if not x or want and x != want:
            raise Loss(f"sintaxe:{want or 'fim'}")
        self.i += 1
        return x

    def formula(self) -> str:
        left = self.sum()
        if self.peek() in RELATIONS:
            head = RELATIONS[self.take()]
            left = f"{head}({left}, {self.sum()})"
            if self.peek() in RELATIONS:
                raise Loss("nao_suportado:relacao_encadeada")
        if self.peek():
            raise Loss(f"nao_suportado:{self.peek()}")
        return left

    def sum(self) -> str:
        minus = self.peek() in ("-", "+") and self.take() == "-"
        terms = [_negative(self.product()) if minus else self.product()]
        while self.peek() in ("+", "-"):
            minus = self.take() == "-"
            x = self.product()
            terms.append(_negative(x) if minus else x)
        return terms[0] if len(terms) == 1 else f"Add({', '.join(terms)})"

    def product(self) -> str:
        factors = [self.power()]
        while True:
            x = self.peek()
            if x in ("\\cdot", "\\times", "*"):
                self.take()
                factors.append(self.power())
            elif x == "/":
                self.take()
                factors.append(f"Pow({self.power()}, Integer(-1))")
            elif x and (x[0].isalnum() or x in ("(", "{", "[") or x[0] == "\\" and (x[1:] in GREEK or x[1:] in FUNCTIONS or x[1:] in ("frac", "mathbb", "operatorname", "mathit", "infty", "dfrac", "tfrac"))):
                factors.append(self.power())
            else:
                return factors[0] if len(factors) == 1 else f"Mul({', '.join(factors)})"

    def power(self) -> str:
        base = self.atom()
        if self.peek() == "^":
            self.take()
            base = f"Pow({base}, {self.script()})"
            if self.peek() in ("_", "("):
                raise Loss(f"nao_suportado:^{{…}}{self.peek()}")
        return base

    def script(self) -> str:
        if self.peek() == "{":
            return self.group("{", "}")
        x = self.peek()
        if x.isdigit() and len(x) > 1:  # an unbraced exponent is one digit
            self.t[self.i:self.i + 1] = [x[0], x[1:]]
        return self.atom()

    def group(self, a: str, b: str) -> str:
        self.take(a)
        x = self.sum()
        self.take(b)
        return x

    def subscript(self, name: str) -> str:
        if self.peek() != "_":
            return f"Symbol('{name}')"
        self.take()
        if self.peek() == "{":
            self.take()
            part = ""
            while self.peek() != "}":
                x = self.take()
                if x in ("\\text", "\\mathrm", "\\mathit"):
                    self.take("{")
                    while self.peek() != "}":
                        part += self.take()
                    self.take("}")
                elif x.isalnum():
                    part += x
                else:
                    raise Loss("nao_suportado:_{(")
            self.take("}")
        else:
            part = self.take().lstrip("\\")
        if self.peek() == "^":
            raise Loss("nao_suportado:_{…}^")
        return f"Symbol('{name}_{part}')"

    def applied(self, name: str) -> str:
        a = self.peek()
        inner = self.group(a, {"(": ")", "[": "]", "{": "}"}[a])
        return f"Function('{name}')({inner})"

    def atom(self) -> str:
        x = self.take()
        if x[0].isdigit():
            return f"Integer({x})" if x.isdigit() else f"Float('{x}')"
        if x in ("(", "{", "["):
            inner = self.sum()
            self.take({"(": ")", "{": "}", "[": "]"}[x])
            return inner
        if x.isalpha():
            if x == "E" and self.peek() == "[":
                return self.applied("E")
            if self.peek() in ("(", "[") and x in self.functions:
                return self.applied(x)
            if self.peek() in ("(", "["):
                raise Loss(f"nao_suportado:{x}{self.peek()}")
            if self.peek() == "^" and self.t[self.i + 1:self.i + 2] in (["*"], ["\\ast"], ["\\star"]):
                self.i += 2
                return f"Symbol('{x}_star')"
            return "E" if x == "e" and self.peek() == "^" else self.subscript(x)
        name = x[1:] if x[0] == "\\" else ""
        if name == "pi":
            return "pi"
        if name in GREEK:
            if self.peek() == "(":
                raise Loss(f"nao_suportado:{name}(")
            return self.subscript(name)
        if name in ("frac", "dfrac", "tfrac"):
            a, b = self.group("{", "}"), self.group("{", "}")
            ints = [re.fullmatch(r"Integer\((\d+)\)", v) for v in (a, b)]
            return f"Rational({ints[0][1]}, {ints[1][1]})" if all(ints) else f"Mul({a}, Pow({b}, Integer(-1)))"
        if name in FUNCTIONS:
            if self.peek() in ("(", "{", "["):
                a = self.peek()
                inner = self.group(a, {"(": ")", "[": "]", "{": "}"}[a])
            else:
                inner = self.atom()
            return f"{FUNCTIONS[name]}({inner})"
        if name == "infty":
            return "oo"
        if name == "mathbb" and self.t[self.i:self.i + 3] == ["{", "E", "}"]:
            self.i += 3
            return self.applied("E")
        if name in ("operatorname", "mathit"):
            self.take("{")
            word = ""
            while self.peek() != "}":
                word += self.take()
            self.take("}")
            return self.applied(word) if name == "operatorname" and self.peek() in ("(", "[") else f"Symbol('{word}')"
        raise Loss(f"nao_suportado:{x}")


def _negative(x: str) -> str:
    m = re.fullmatch(r"Integer\((\d+)\)", x)
    return f"Integer(-{m[1]})" if m else f"Mul(Integer(-1), {x})"


def parse(latex: str, functions: frozenset[str] = frozenset()) -> str:
    """The expression of a formula; raises :class:`Loss` with the declared reason."""
    why = early_loss(latex)
    if why:
        raise Loss(why)
    r = _Reader(latex, functions)
    out = r.formula()
    return re.sub(r"Mul\(Integer\(-1\), Integer\((\d+)\)\)", r"Integer(-\1)", re.sub(r"Pow\((.*?), Mul\(Integer\(-1\), Integer\((\d+)\)\)\)", r"Pow(\1, Integer(-\2))", out))


def serve() -> None:
    """Answer [formula, functions] lines with [read, expression or reason] lines until the input ends."""
    print("ok", flush=True)
    for line in sys.stdin:
        latex, functions = json.loads(line)
        try:
            out = [True, parse(latex, frozenset(functions))]
        except Loss as e:
            out = [False, str(e)]
        except RecursionError:
            out = [False, "profundidade"]
        print(json.dumps(out), flush=True)


_PIECE = re.compile(r"\s*([A-Za-z_][\w]*|-?\d+|'[^']*'|[(),])")


def tree(srepr: str):
    """Nested (head, arguments) of a written expression; strings and whole numbers are leaves."""
    pieces, at = _PIECE.findall(srepr), 0

    def read():
        nonlocal at
        x = pieces[at]
        at += 1
        if x[0] == "'":
            return x[1:-1]
        if x.lstrip("-").isdigit():
            return int(x)
        node = (x, [])
        while at < len(pieces) and pieces[at] == "(":
            at += 1
            args = []
            while pieces[at] != ")":
                args.append(read())
                if pieces[at] == ",":
                    at += 1
            at += 1
            node = (x, args) if not node[1] else (f"{x}:{node[1][0]}", args)
        return node

    out = read()
    if at != len(pieces):
        raise ValueError("expressao malformada")
    return out


def symbols(node) -> set[str]:
    if not isinstance(node, tuple):
        return set()
    return {node[1][0]} if node[0] == "Symbol" else set().union(*map(symbols, node[1])) if node[1] else set()


def substitute(node, values: dict):
    """Replace symbols by trees."""
    if not isinstance(node, tuple):
        return node
    if node[0] == "Symbol":
        return values.get(node[1][0], node)
    return (node[0], [substitute(a, values) for a in node[1]])


def value(node, point: dict[str, int]) -> int:
    """Value modulo PRIME; functions and irrational powers are opaque values of their arguments."""
    if isinstance(node, int):
        return node % PRIME
    head, args = node
    if head == "Symbol":
        return point[args[0]]
    if head == "Integer":
        return args[0] % PRIME
    if head == "Rational":
        return args[0] * pow(args[1], -1, PRIME) % PRIME
    if head == "Add":
        return sum(value(a, point) for a in args) % PRIME
    if head == "Mul":
        out = 1
        for a in args:
            out = out * value(a, point) % PRIME
        return out
    if head == "Pow" and isinstance(args[1], tuple) and args[1][0] == "Integer":
        base = value(args[0], point)
        if args[1][1][0] < 0 and base == 0:
            raise ZeroDivisionError
        return pow(base, args[1][1][0], PRIME)
    text = f"{head}|" + "|".join(str(value(a, point)) for a in args)
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % PRIME


def derives(parent: str, child: str, target: str, replaced: dict[str, str]) -> tuple[str, str]:
    """(verdict, detail): does the child follow from the parent, solved for ``target``?

    Both are equations; the parent must be linear in the target. Equality is tested exactly at
    several points modulo a large prime. What cannot be decided is ``indeterminado``.
    """
    try:
        p, c = tree(parent), tree(child)
        change = {k: tree(parse(v)) for k, v in replaced.items()}
    except (ValueError, IndexError, KeyError) as e:
        return "indeterminado", f"nao lida: {e}"
    if p[0] != "Equality" or c[0] != "Equality":
        return "indeterminado", "nao e igualdade"
    if c[1][0] != ("Symbol", [target]):
        return "indeterminado", "filha nao isola o alvo"
    p = substitute(p, change)
    if target not in symbols(p):
        return "indeterminado", "alvo fora da mae"
    names = sorted(symbols(p) | symbols(c))
    for trial in range(4):
        point = {n: int.from_bytes(hashlib.sha256(f"{trial}:{n}".encode()).digest()[:7], "big") for n in names}
        try:
            f = [(value(p[1][0], point | {target: x}) - value(p[1][1], point | {target: x})) % PRIME for x in (0, 1, 2)]
            if (f[2] - 2 * f[1] + f[0]) % PRIME or (f[1] - f[0]) % PRIME == 0:
                return "indeterminado", "mae nao e linear no alvo"
            root = -f[0] * pow(f[1] - f[0], -1, PRIME) % PRIME
            if value(c[1][1], point) != root:
                return "vermelho", "diferenca nao nula"
        except (ZeroDivisionError, ValueError, KeyError, TypeError):
            return "indeterminado", "sem valor"
    return "verde", "diferenca = 0"
