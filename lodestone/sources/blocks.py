"""Symbols and edges of Go, Rust and Java from texts whose comments and strings are blanked.

One scanner serves all: a table per language says what a comment, a string and a character are, and whether
comments nest. What is left is plain declarations and balanced brackets.
"""

from __future__ import annotations

import re

#: Per language: does ``/* */`` nest, and what else is blanked (``//`` comments are everywhere).
LEXIS = {
    "go": (False, r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'"),
    "rust": (True, r"\bb?r(?P<hash>#*)\".*?\"(?P=hash)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:u\{\w+\}|x\w\w|.)|[^'\\\n])'"),
    "java": (False, r"\"\"\".*?(?<!\\)\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'"),
}
SCANNERS = {k: re.compile(r"//[^\n]*|(?P<block>/\*)|" + rest, re.S) for k, (_, rest) in LEXIS.items()}
VIS = r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?"
MODS = r"(?P<mods>(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|default|synchronized|native|strictfp)\s+)*)"
GENERIC = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"
RULES = {
    "go": [(None, re.compile(r"^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?\(", re.M)), (None, re.compile(r"^(?:type\s+|(?P<group>[ \t]+))(?P<name>\w+)(?:\[[^\]\n]*\])?[ \t]+=?[ \t]*(?P<what>struct|interface)?", re.M))],
    "rust": [("function", re.compile(rf"^[ \t]*{VIS}(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)", re.M)), (None, re.compile(rf"^[ \t]*{VIS}(?:unsafe\s+)?(?P<what>struct|enum|trait)\s+(?P<name>\w+)", re.M)), ("impl", re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b(?P<head>[^{;]*)\{", re.M))],
    "java": [(None, re.compile(rf"{MODS}\b(?P<what>class|interface|enum)\s+(?P<name>\w+)(?P<head>[^{{;]*)\{{")), ("method", re.compile(rf"{MODS}(?:{GENERIC}\s*)?(?P<type>[\w.]+(?:{GENERIC})?(?:\s*\[\s*\])*)\s+(?P<name>\w+)\s*\((?P<args>[^()]*)\)\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])"))],
}
NO_CALLS = frozenset("if for while switch match return func fn catch synchronized super this new else loop do try assert throw async await move where in".split())


def blank(language: str, text: str) -> str:
    """``text`` with comments, strings and characters blanked; lines and columns stay."""
    nests, out, at = LEXIS[language][0], [], 0
    while m := SCANNERS[language].search(text, at):
        end = m.end()
        if m.group("block"):
            depth = 1
            while depth and (b := re.compile(r"/\*|\*/").search(text, end)):
                end = b.end()
                depth += -1 if b.group() == "*/" else 1 if nests else 0
            end = end if not depth else len(text)
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = end
    return "".join([*out, text[at:]])


def bare(name: str) -> str:
    """A type's last name without generics, references and pointers."""
    while "<" in name and (less := re.sub(r"<[^<>]*>", "", name)) != name:
        name = less
    return re.sub(r"[^\w$]", "", re.split(r"::|\.", re.sub(r"\b(const|mut|dyn)\b|\[.*", "", name).strip())[-1])


class Blocks:
    """``symbols``: (name, kind, exported, first line, last line); ``edges``: (source, target, type)."""

    def __init__(self, language: str, text: str):
        self.text = blank(language, text)
        self.close: dict[int, int] = {}
        self.inside: list[tuple[int, int]] = []
        open_: list[int] = []
        for m in re.finditer(r"[{}]", self.text):
            if m.group() == "{":
                open_.append(m.start())
            elif open_:
                self.close[open_.pop()] = m.start()
        self.symbols: list[tuple] = []
        self.edges: list[tuple[str, str, str]] = []
        self.bodies: list[tuple[str, int, int]] = []
        getattr(self, language)()
        for name, begin, end in self.bodies:
            inner = [(b, e) for n, b, e in self.bodies if begin < b and e <= end and (b, e) != (begin, end)]
            body = "".join(" " if any(b <= k < e for b, e in inner) else c for k, c in enumerate(self.text[begin:end], begin)) if inner else self.text[begin:end]
            for m in re.finditer(r"(\bnew\s+)?\b([A-Za-z_$][\w$]*)\s*(?:::)?(?:" + GENERIC + r")?\s*\(", body):
                if m.group(2) not in NO_CALLS and not re.search(r"\bfn\s+$", body[: m.start(2)][-20:]):
                    self.edges.append((name, m.group(2), "CALLS"))
        self.edges = list(dict.fromkeys(self.edges))

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def end(self, at: int) -> int:
        """Where the declaration at ``at`` ends: at the close of its first brace outside of brackets, else at its
        semicolon, or, where neither comes on its line or the next open one, at the line's end."""
        depth = 0
        for k in range(at, len(self.text)):
            c = self.text[k]
            depth += (c in "([") - (c in ")]")
            if c == "{" and depth <= 0:
                return self.close.get(k, len(self.text) - 1)
            if c == ";" and depth <= 0:
                return k
            if c == "\n" and depth <= 0 and self.ends_at_line:
                return k - 1
        return len(self.text) - 1

    ends_at_line = False

    def owner(self, at: int, blocks: list[tuple[str, int, int]]) -> str | None:
        """The innermost of ``blocks`` (name, begin, end) around ``at``, if it is directly in it."""
        around = [b for b in blocks if b[1] < at < b[2]]
        if not around:
            return None
        name, begin, _ = max(around, key=lambda b: b[1])
        direct = sum(1 for o, c in self.close.items() if begin < o < at < c) == 0
        return name if direct else ""

    def add(self, name: str, kind: str, exported: bool, begin: int, end: int, body: bool = False) -> None:
        self.symbols.append((name, kind, exported, self.line(begin), self.line(end)))
        if body:
            at = self.text.find("{", begin, end)
            if at >= 0:
                self.bodies.append((name, at, end))

    def go(self) -> None:
        self.ends_at_line = True
        (_, function), (_, type_) = RULES["go"]
        for m in function.finditer(self.text):
            end, name = self.end(m.end() - 1), m.group("name")
            if m.group("recv") is not None:
                owner = bare(re.sub(r"\[.*", "", m.group("recv")).replace("*", " ").split()[-1]) if m.group("recv").strip() else ""
                full = f"{owner}.{name}" if owner else name
                self.add(full, "method", name[:1].isupper(), m.start(), end, True)
                if owner:
                    self.edges.append((owner, full, "HAS_METHOD"))
            else:
                self.add(name, "function", name[:1].isupper(), m.start(), end, True)
        groups = [(m.end(), self._paren(m.end() - 1)) for m in re.finditer(r"^type\s*\(", self.text, re.M)]
        for m in type_.finditer(self.text):
            grouped = m.group("group") is not None
            if grouped and not any(b <= m.start() < e and not any(b < o < m.start() < c for o, c in self.close.items()) for b, e in groups):
                continue
            self.add(m.group("name"), m.group("what") or "type", m.group("name")[:1].isupper(), m.start("name"), self.end(m.end()))

    def _paren(self, at: int) -> int:
        depth = 0
        for k in range(at, len(self.text)):
            depth += (self.text[k] == "(") - (self.text[k] == ")")
            if not depth:
                return k
        return len(self.text)

    def rust(self) -> None:
        (_, function), (_, type_), (_, impl) = RULES["rust"]
        impls, traits = [], []
        for m in impl.finditer(self.text):
            head = re.split(r"\bwhere\b", m.group("head"))[0]
            while (less := re.sub(r"<[^<>]*>", "", head.replace("->", "  "))) != head:
                head = less
            trait, for_, own = head.rpartition(" for ") if " for " in head else ("", "", head)
            owner = bare(own)
            if for_:
                self.edges.append((owner, bare(trait), "IMPLEMENTS"))
            impls.append((owner, m.end() - 1, self.close.get(m.end() - 1, len(self.text))))
        for m in type_.finditer(self.text):
            end = self.end(m.end())
            self.add(m.group("name"), m.group("what"), bool(m.group("vis")), m.start() + len(m.group()) - len(m.group().lstrip()), end)
            if m.group("what") == "trait":
                traits.append(("", m.end(), end))
        for m in function.finditer(self.text):
            owner, end, name = self.owner(m.start("name"), impls), self.end(m.end()), m.group("name")
            if self.owner(m.start("name"), traits) is not None and owner is None:
                continue  # what a trait asks for
            full = f"{owner}.{name}" if owner else name
            self.add(full, "method" if owner else "function", bool(m.group("vis")), m.start("name"), end, True)
            if owner:
                self.edges.append((owner, full, "HAS_METHOD"))

    def java(self) -> None:
        (_, type_), (_, method) = RULES["java"]
        types = []
        for m in type_.finditer(self.text):
            name, end = m.group("name"), self.close.get(m.end() - 1, len(self.text) - 1)
            self.add(name, m.group("what"), "public" in m.group("mods").split(), m.start() if m.group("mods") else m.start("what"), end)
            types.append((name, m.end() - 1, end))
            head = m.group("head")
            while (less := re.sub(r"<[^<>]*>", "", head)) != head:
                head = less
            for word, kind in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
                if found := re.search(rf"\b{word}\s+([\w.,\s]+?)(?=\b(?:implements|permits|extends)\b|$)", head.strip()):
                    self.edges += [(name, bare(x), kind) for x in found.group(1).split(",") if x.strip()]
        for m in method.finditer(self.text):
            owner = self.owner(m.start("name"), types)
            if not owner or m.group("type") in NO_CALLS or re.fullmatch(MODS, m.group("type") + " "):
                continue
            full, end = f"{owner}.{m.group('name')}", self.end(m.end())
            self.add(full, "method", "public" in m.group("mods").split(), m.start() if m.group("mods") else m.start("type"), end, True)
            self.edges.append((owner, full, "HAS_METHOD"))
