"""Symbols, calls and data flow of TypeScript and JavaScript, from a stream of tokens.

A file is split into tokens; brackets are matched once; declarations are read off the tokens at the outer
level of a range, and bodies are scanned for calls, assignments and returns. Functions inside functions
are ranges that a scan jumps over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|\.\.\.|\?\.|[-+*/%&|^!=<>]=+|&&|\|\||\?\?|\+\+|--|[^\s\w]|\n", re.S)
#: What a token is, by its first character; else a number, if that is a digit, or a mark.
KINDS = dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$", "name")
PAIRS = {"(": ")", "[": "]", "{": "}"}
CLOSING = frozenset(PAIRS.values())
#: Tokens at which a nested function or class may begin, and those that may follow a called name or its parts.
NESTED, LINKS = frozenset(("=>", "function", "class")), frozenset(("(", ".", "?."))
KEYWORDS = frozenset("if for while switch catch return typeof new await delete void function class do else try in of instanceof case throw yield super import export const let var async".split())
MODIFIERS = frozenset("public private protected static async override readonly get set abstract".split())
# Calls that are not told, properties that take callbacks, and those that emit and hear events.
BUILTINS = frozenset(
    "console Math JSON Object Array String Number Boolean Promise Date RegExp Map Set WeakMap WeakSet Symbol Error parseInt parseFloat isNaN isFinite setTimeout setInterval clearTimeout "
    "clearInterval require encodeURIComponent decodeURIComponent fetch".split()
)
CALLBACKS = frozenset("then catch finally use get post put patch delete map filter forEach reduce".split())
TIMERS = frozenset(("setTimeout", "setInterval"))
LISTENERS = frozenset(("on", "once", "addEventListener"))


class Script:
    """``symbols``: (name, kind, exported, first line, last line). ``edges``: (source, target, type).
    ``flow``: (source, target, type), where EMITS and LISTENS name an event as target or source."""

    def __init__(self, text: str):
        self.text: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.symbols: list[tuple] = []
        self.edges: list[tuple[str, str, str]] = []
        self.flow: list[tuple[str, str, str]] = []
        line = 1
        for t in TOKEN.findall(text):
            if t == "\n":
                line += 1
                continue
            first = t[0]
            if first == "/" and t[1:2] in ("/", "*"):  # a comment
                line += t.count("\n")
                continue
            self.text.append(t)
            self.line.append(line)
            if first in "'\"`" and len(t) > 1:
                self.kind.append("string")
                line += t.count("\n")
            else:
                self.kind.append(KINDS.get(first) or ("number" if first.isdecimal() else "mark"))
        self.close: dict[int, int] = {}
        open_: list[int] = []
        for k, t in enumerate(self.text):
            if t in PAIRS:
                open_.append(k)
            elif t in CLOSING:
                while open_ and PAIRS[self.text[open_[-1]]] != t:
                    open_.pop()  # an unclosed bracket
                if open_:
                    self.close[open_.pop()] = k
        self.declarations(0, len(self.text))

    def end_of(self, k: int) -> int:
        """The closing bracket of the one at ``k``; the last token if there is none."""
        return self.close.get(k, len(self.text) - 1)

    def is_name(self, k: int) -> bool:
        return k < len(self.text) and self.kind[k] == "name"

    def seek(self, k: int, end: int, *marks: str) -> int:
        """The first of ``marks`` from ``k`` on that is in no bracket; ``end`` if there is none."""
        while k < end and self.text[k] not in marks:
            k = self.end_of(k) + 1 if self.text[k] in PAIRS else k + 1
        return min(k, end)

    # --- declarations ---------------------------------------------------------------------------------

    def declarations(self, k: int, end: int) -> None:
        exported = False
        while k < end:
            word = self.text[k]
            if word == "export":
                exported = True
            elif word in ("default", "abstract", "declare", "async"):
                pass
            elif word == "class" and self.is_name(k + 1):
                k = self.a_class(k, end, exported)
                exported = False
            elif word in ("interface", "enum") and self.is_name(k + 1):
                body = self.seek(k, end, "{")
                if word == "interface":
                    self.heritage(self.text[k + 1], k + 2, body)
                self.add(self.text[k + 1], word, exported, k, self.end_of(body) if body < end else k + 1)
                k, exported = self.end_of(body) if body < end else k, False
            elif word == "type" and self.is_name(k + 1) and self.text[k + 2 : k + 3] in (["="], ["<"]):
                stop = self.expression_end(self.seek(k, end, "=") + 1, end)
                self.add(self.text[k + 1], "type", exported, k, stop - 1)
                k, exported = stop - 1, False
            elif word == "function":
                name = k + 1 + (self.text[k + 1 : k + 2] == ["*"])
                opened = self.seek(name, end, "(")
                body = self.seek(self.end_of(opened) + 1, end, "{", ";") if opened < end else end
                if self.is_name(name) and body < end:
                    self.add(self.text[name], "function", exported, k, self.end_of(body))
                    self.body(self.text[name], "", body + 1, self.end_of(body), self.names(opened + 1, self.end_of(opened)))
                k, exported = self.end_of(body) if body < end else opened, False
            elif word in ("const", "let", "var") and self.is_name(k + 1) and self.text[k + 1] != "enum":
                k = self.a_variable(k, end, exported and word == "const" or word == "const", exported)
                exported = False
            elif word == "{" and exported:  # export { a, b }
                k, exported = self.end_of(k), False
            elif word in PAIRS:
                self.declarations(k + 1, self.end_of(k)) if word == "{" else None
                k = self.end_of(k)
            elif word == ";":
                exported = False
            k += 1

    def add(self, name: str, kind: str, exported: bool, first: int, last: int) -> None:
        self.symbols.append((name, kind, exported, self.line[first], self.line[min(last, len(self.line) - 1)]))

    def dotted(self, k: int) -> tuple[str, int]:
        """A chain of names joined by dots from ``k`` on, and the token after it."""
        name = self.text[k]
        while self.text[k + 1 : k + 2] in (["."], ["?."]) and self.is_name(k + 2):
            name, k = f"{name}.{self.text[k + 2]}", k + 2
        return name, k + 1

    def heritage(self, name: str, k: int, body: int) -> None:
        kind = ""
        while k < body:
            if self.text[k] in ("extends", "implements"):
                kind = self.text[k].upper()
            elif self.text[k] == "<":
                depth = 0
                while k < body:  # type arguments
                    depth += self.text[k].count("<") - self.text[k].count(">") * (self.text[k] != "=>")
                    if depth <= 0:
                        break
                    k += 1
            elif kind and self.is_name(k):
                target, k = self.dotted(k)
                self.edges.append((name, target, kind))
                continue
            k += 1

    def a_class(self, k: int, end: int, exported: bool) -> int:
        name, body = self.text[k + 1], self.seek(k, end, "{")
        if body >= end:
            return k
        self.heritage(name, k + 2, body)
        self.add(name, "class", exported, k, self.end_of(body))
        at, stop = body + 1, self.end_of(body)
        while at < stop:
            first = at
            while self.text[at] in MODIFIERS and self.is_name(at + 1):
                at += 1
            opened = at + 1
            if self.is_name(at) and self.text[opened : opened + 1] == ["<"]:
                opened = self.seek(opened, stop, "(")
            if self.is_name(at) and opened < stop and self.text[opened] == "(":
                inner = self.seek(self.end_of(opened) + 1, stop, "{", ";")
                if inner < stop and self.text[inner] == "{":
                    method = f"{name}.{self.text[at]}"
                    self.add(method, "method", exported and not {"private", "protected"} & set(self.text[first:at]), first, self.end_of(inner))
                    self.edges.append((name, method, "HAS_METHOD"))
                    self.body(method, name, inner + 1, self.end_of(inner), self.names(opened + 1, self.end_of(opened)))
                    at = self.end_of(inner) + 1
                    continue
            at = self.expression_end(at, stop) + 1  # a field
        return stop

    def a_variable(self, k: int, end: int, told: bool, exported: bool) -> int:
        name, sign = self.text[k + 1], self.seek(k + 2, end, "=", ";")
        if sign >= end or self.text[sign] == ";":
            return k + 1
        stop = self.expression_end(sign + 1, end)
        arrow = self.seek(sign + 1, stop, "=>")
        plain = self.text[sign + 1 : sign + 3]
        function = arrow < stop or "function" in plain[: 1 + (plain[:1] == ["async"])]
        if told:
            self.add(name, "function" if function else "const", exported, k, stop - 1)
        if function:
            begin = self.seek(sign + 1, stop, "(")
            params = self.names(begin + 1, self.end_of(begin)) if begin < min(arrow, stop) else set(self.text[sign + 1 : arrow])
            inner = arrow + 1 if arrow < stop else self.seek(sign + 1, stop, "{")
            if inner < stop and self.text[inner] == "{":
                self.body(name, "", inner + 1, self.end_of(inner), params)
            elif inner < stop:
                self.body(name, "", inner, stop, params)
        return stop - 1

    def names(self, k: int, end: int) -> set[str]:
        """Parameters: names that begin one or stand inside a pattern, types left out."""
        out, typed = set(), False
        while k < end:
            if self.text[k] == ":" and self.text[k - 1] != "}":
                typed = True
            elif self.text[k] == ",":
                typed = False
            elif self.text[k] in PAIRS and typed:
                k = self.end_of(k)
            elif self.is_name(k) and not typed:
                out.add(self.text[k])
            k += 1
        return out

    # --- bodies ---------------------------------------------------------------------------------------

    def expression_end(self, k: int, end: int) -> int:
        """Where an expression stops: a semicolon, a comma, or a new line that can't continue it."""
        begin = k
        while k < end and self.text[k] not in (";", ",", "}", ")", "]"):
            after = k > begin and self.line[k] > self.line[k - 1]
            if after and self.kind[k] != "mark" and (self.kind[k - 1] != "mark" or self.text[k - 1] in ")]}"):
                break
            k = self.end_of(k) + 1 if self.text[k] in PAIRS else k + 1
        return min(k, end)

    def jump(self, k: int, end: int) -> int:
        """The token after a nested function or class that begins at ``k``; ``k`` if none does."""
        if self.text[k] == "=>":
            return self.end_of(k + 1) + 1 if self.text[k + 1 : k + 2] == ["{"] else self.expression_end(k + 1, end)
        if self.text[k] in ("function", "class"):
            body = self.seek(k, end, "{")
            return self.end_of(body) + 1 if body < end else k
        return k

    def callee(self, k: int) -> tuple[str, int] | None:
        """The called name that begins at ``k``, without ``this`` and ``super``, and its bracket."""
        if not self.is_name(k) or self.text[k - 1 : k] in (["."], ["?."], ["function"]):
            return None
        name, after = self.dotted(k)
        if self.text[after : after + 1] != ["("] or name in KEYWORDS and name != "super":
            return None
        head, _, rest = name.partition(".")
        return (rest if head in ("this", "super") and rest else name), after

    def arguments(self, opened: int) -> Iterator[tuple[int, int]]:
        k, end = opened + 1, self.end_of(opened)
        while k < end:
            stop = self.seek(k, end, ",")
            yield k, stop
            k = stop + 1

    def producer(self, k: int, end: int, origins: dict[str, str]) -> str | None:
        """The function whose result an expression is, or that a variable got it from."""
        while k < end and self.text[k] == "await":
            k += 1
        if k < end and self.text[k] == "(" and self.end_of(k) == end - 1:
            return self.producer(k + 1, end - 1, origins)
        if end - k == 1 and self.is_name(k):
            return origins.get(self.text[k])
        called = self.callee(k) if k < end else None
        return called[0] if called and self.end_of(called[1]) == end - 1 else None

    def callback(self, k: int, end: int) -> str | None:
        if k < end and self.is_name(k):
            name, after = self.dotted(k)
            head, _, rest = name.partition(".")
            if after == end:
                return rest if head in ("this", "super") and rest else name
        return None

    def body(self, scope: str, owner: str, k: int, end: int, params: set[str]) -> None:
        origins: dict[str, str] = {}
        while k < end:
            word = self.text[k]
            if word in NESTED and (after := self.jump(k, end)) > k:
                k = after
                continue
            if not self.is_name(k):
                k += 1
                continue
            follows = self.text[k + 1] if k + 1 < len(self.text) else ""
            if follows in ("=", ":") and self.text[k - 1 : k] not in (["."], ["?."]):
                sign = k + 1 if follows == "=" else self.seek(k + 1, end, "=", ";", ",", "}")
                if sign < end and self.text[sign] == "=" and (made := self.producer(sign + 1, self.expression_end(sign + 1, end), origins)):
                    origins[word] = made
            elif word == "return" and k + 1 < end and follows not in (";", "}") and self.line[k + 1] == self.line[k]:
                self.flow.append((scope, scope, "PRODUCES"))
                if made := self.producer(k + 1, self.expression_end(k + 1, end), origins):
                    self.flow.append((made, scope, "DATA_FLOWS_TO"))
            if follows in LINKS and (called := self.callee(k)):
                self.call(scope, called[0], called[1], params, origins)
            k += 1

    def call(self, scope: str, name: str, opened: int, params: set[str], origins: dict[str, str]) -> None:
        if name == "super":
            return
        if name.split(".")[0] not in BUILTINS:
            self.edges.append((scope, name, "CALLS"))
        args, last = list(self.arguments(opened)), name.rpartition(".")[2]
        dotted = self.text[opened - 2 : opened - 1] in (["."], ["?."])
        for a, b in args:
            if b - a == 1 and self.text[a] in params:
                self.flow.append((scope, name, "CONSUMES"))
            made = self.producer(a, b, origins)
            if made and made != name:
                self.flow.append((made, name, "DATA_FLOWS_TO"))
            if (dotted and last in CALLBACKS or name in TIMERS) and (back := self.callback(a, b)):
                self.flow.append((scope, back, "TRIGGERS"))
        event = self.text[args[0][0]].strip("'\"`") if args and args[0][1] - args[0][0] == 1 and self.kind[args[0][0]] == "string" else ""
        if dotted and event and last == "emit":
            self.flow.append((scope, event, "EMITS"))
        if dotted and event and last in LISTENERS and len(args) > 1 and (back := self.callback(*args[1])):
            self.flow.append((event, back, "LISTENS"))
