"""Java sources as rows of syntax nodes, in pre-order.

Only the node types that facts need are emitted.  Declarations are parsed in
full; code is scanned for chains of calls and creations, whose outermost call
comes first, as it starts where the chain starts.  Nothing recurses on the
nesting of code: pending ranges are on an explicit stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"""
    r'''|(?P<text>"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)'''
    r"""|(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>::|->|\.\.\.|.)""",
    re.DOTALL,
)
_KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements "
    "import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
_TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}
_OPEN = {"(": ")", "[": "]", "{": "}"}


class _Parser:
    def __init__(self, source: str) -> None:
        self.source = source
        self.tokens: list[tuple[str, str, int, int]] = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(source) if m.lastgroup != "skip"]
        self.n = len(self.tokens)
        self.close = self._pairs()
        self.nodes: list[tuple[str, str | None, str | None, list[str] | None]] = []
        self.todo: list[tuple] = []

    def _pairs(self) -> dict[int, int]:
        """Place of the closing bracket of each opening one."""
        out, stack = {}, []
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "mark" and t in _OPEN:
                stack.append(i)
            elif kind == "mark" and t in ")]}":
                while stack and _OPEN[self.tokens[stack[-1]][1]] != t:
                    out[stack.pop()] = i
                if stack:
                    out[stack.pop()] = i
        out.update(dict.fromkeys(stack, self.n))
        return out

    def at(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < self.n and self.tokens[i][0] in ("word", "mark") else ""

    def word(self, i: int) -> bool:
        return 0 <= i < self.n and self.tokens[i][0] == "word" and self.tokens[i][1] not in _KEYWORDS

    def text(self, i: int, j: int) -> str:
        """Source from token i to before token j."""
        return self.source[self.tokens[i][2] : self.tokens[j - 1][3]] if i < j <= self.n else ""

    def emit(self, kind: str, name: str | None, superclass: str | None = None, interfaces: list[str] | None = None) -> None:
        self.nodes.append((kind, name, superclass, interfaces))

    def angles(self, i: int) -> int:
        """Past the type arguments that start at i, or i."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < self.n:
            t = self.at(i)
            depth += (t == "<") - (t == ">")
            if t in (";", "{", "}", "("):
                return i
            i += 1
            if depth <= 0:
                break
        return i

    def type_end(self, i: int) -> int:
        """Past a type with its arguments and array marks."""
        while self.at(i) == "@":
            i = self.annotation(i)
        if self.tokens[i : i + 1] and self.tokens[i][0] == "word":
            i = self.angles(i + 1)
            while self.at(i) == "." and i + 1 < self.n:
                i = self.angles(i + 2)
            while self.at(i) == "[" and self.at(i + 1) == "]":
                i += 2
        return i

    def annotation(self, i: int) -> int:
        i += 2
        while self.at(i) == ".":
            i += 2
        return self.close[i] + 1 if self.at(i) == "(" else i

    def run(self) -> list[tuple[str, str | None, str | None, list[str] | None]]:
        self.todo = [("body", 0, self.n, None)]
        while self.todo:
            step, i, end, extra = self.todo.pop()
            getattr(self, "_" + step)(i, min(end, self.n), extra)
        return self.nodes

    def _later(self, *steps: tuple) -> None:
        """To do next, in this order."""
        self.todo += reversed(steps)

    def _node(self, i: int, end: int, node: tuple) -> None:
        self.emit(*node)

    # Declarations

    def _body(self, i: int, end: int, owner: tuple[str, str] | None) -> None:
        """One member of a body (owner: kind and name of its type; None at the top of a file), then the rest."""
        while i < end and self.at(i) in (";", "}", ","):
            i += 1
        if i >= end:
            return
        word = self.at(i)
        if owner is None and word in ("package", "import"):
            stop = i + 1
            while stop < end and self.at(stop) != ";":
                stop += 1
            first = i + 1 + (self.at(i + 1) == "static")
            last = stop - 2 if self.at(stop - 1) == "*" else stop
            self.emit(f"{word}_declaration", self.text(first, last))
            self._later(("body", stop, end, owner))
            return
        start = i
        while i < end:
            if self.at(i) == "@" and self.at(i + 1) != "interface":
                i = self.annotation(i)
            elif self.at(i) in _MODIFIERS and not (self.at(i) == "default" and self.at(i + 1) in (":", "->")):
                i += 1
            elif self.at(i) == "non" and self.at(i + 2) == "sealed":
                i += 3
            else:
                break
        if self.declares_type(i):
            self._later(*self.type_declaration(i, end), ("body", self.past_type(i, end), end, owner))
            return
        if self.at(i) == "{":  # initializer
            self._later(("code", i + 1, self.close[i], None), ("body", self.close[i] + 1, end, owner))
            return
        i = self.angles(i)
        compact = owner and owner[0] == "record" and self.at(i) == owner[1] and self.at(i + 1) == "{"
        if compact or (self.word(i) and self.at(i + 1) == "("):  # constructor
            opening = i + 1 if compact else self._signature_end(self.close[i + 1] + 1, end)
            self._later(*self.block(opening, end), ("body", self.past_block(opening, end), end, owner))
            return
        name = self.type_end(i)
        if name == i or not self.word(name):
            self._later(("body", max(i + 1, start + 1), end, owner))
            return
        if self.at(name + 1) == "(":
            if owner is not None and owner[0] != "@interface":
                self.emit("method_declaration", self.at(name))
            opening = self._signature_end(self.close[name + 1] + 1, end)
            self._later(*self.block(opening, end), ("body", self.past_block(opening, end), end, owner))
            return
        if owner is not None:
            self.emit("constant_declaration" if owner[0] in ("interface", "@interface") else "field_declaration", self.at(name))
        stop = name + 1
        while stop < end and self.at(stop) != ";":
            stop = self.close.get(stop, stop) + 1
        self._later(("code", name + 1, stop, None), ("body", stop, end, owner))

    def _signature_end(self, i: int, end: int) -> int:
        """The block of a method, or the semicolon without one."""
        while i < end and self.at(i) not in ("{", ";"):
            i += 1
        return i

    def block(self, i: int, end: int) -> list[tuple]:
        return [("code", i + 1, self.close[i], None)] if i < end and self.at(i) == "{" else []

    def past_block(self, i: int, end: int) -> int:
        return self.close[i] + 1 if i < end and self.at(i) == "{" else i + 1

    def declares_type(self, i: int) -> bool:
        word = self.at(i)
        if word == "@" and self.at(i + 1) == "interface":
            return True
        return (word in ("class", "interface", "enum") or (word == "record" and self.word(i + 1) and self.at(self.angles(i + 2)) == "(")) and self.word(i + 1) and self.at(i - 1) != "."

    def _opening(self, i: int, end: int) -> int:
        while i < end and self.at(i) != "{":
            i = self.close[i] + 1 if self.at(i) == "(" else i + 1
        return i

    def past_type(self, i: int, end: int) -> int:
        opening = self._opening(i, end)
        return self.close.get(opening, end) + 1

    def type_declaration(self, i: int, end: int) -> list[tuple]:
        """Emits the node of the type declared at i; the steps for its body."""
        kind = "@interface" if self.at(i) == "@" else self.at(i)
        i += kind == "@interface"
        name = self.at(i + 1)
        opening = self._opening(i, end)
        superclass, interfaces = None, None
        j = self.angles(i + 2)
        while j < opening:
            word = self.at(j)
            if word == "(":
                j = self.close[j] + 1
            elif word in ("extends", "implements", "permits"):
                listed, j = [], j + 1
                while j < opening:
                    stop = self.type_end(j)
                    if stop == j:
                        break
                    listed.append(self.text(j, stop))
                    j = stop + 1 if self.at(stop) == "," else stop
                    if self.at(stop) != ",":
                        break
                if word == "extends" and kind == "class" and listed:
                    superclass = listed[0]
                elif word == "implements" and kind == "class":
                    interfaces = listed
            else:
                j += 1
        self.emit("annotation_type_declaration" if kind == "@interface" else _TYPES[kind], name, superclass, interfaces)
        if opening >= end:
            return []
        return [("constants" if kind == "enum" else "body", opening + 1, self.close[opening], (kind, name))]

    def _constants(self, i: int, end: int, owner: tuple[str, str]) -> None:
        """Constants of an enum: arguments and bodies, then the members after the semicolon."""
        steps = []
        while i < end and self.at(i) != ";":
            if self.at(i) == "@":
                i = self.annotation(i)
            elif self.at(i) in ("(", "{"):
                steps.append(("code" if self.at(i) == "(" else "body", i + 1, self.close[i], None if self.at(i) == "(" else owner))
                i = self.close[i] + 1
            else:
                i += 1
        self._later(*steps, ("body", i + 1, end, owner))

    # Code

    def _code(self, i: int, end: int, _) -> None:
        """Scans statements and expressions up to the next thing that has nodes, then the rest."""
        while i < end:
            word = self.at(i)
            if word == "@" and self.word(i + 1):
                i = self.annotation(i)
            elif self.declares_type(i):
                self._later(*self.type_declaration(i, end), ("code", self.past_type(i, end), end, None))
                return
            elif word == "new" or word in ("this", "super", "(") or self.word(i) or (i < self.n and self.tokens[i][0] == "text"):
                steps, stop = self.chain(i, end)
                self._later(*steps, ("code", stop, end, None))
                return
            elif word in ("{", "["):
                self._later(("code", i + 1, self.close[i], None), ("code", self.close[i] + 1, end, None))
                return
            else:
                i += 1

    def chain(self, i: int, end: int) -> tuple[list[tuple], int]:
        """A primary with what follows it: the steps for its nodes, and where it ends."""
        primary: list[tuple] = []
        rest: list[tuple] = []
        calls: list[str] = []
        word = self.at(i)
        if word == "new":
            stop = i + 1
            while self.at(stop) == "@":
                stop = self.annotation(stop)
            first = stop
            if self.tokens[stop : stop + 1] and self.tokens[stop][0] == "word":
                stop = self.angles(stop + 1)
                while self.at(stop) == "." and stop + 1 < end:
                    stop = self.angles(stop + 2)
            if self.at(stop) == "(":
                primary.append(("node", 0, 0, ("object_creation_expression", self.text(first, stop), None, None)))
                primary.append(("code", stop + 1, self.close[stop], None))
                stop = self.close[stop] + 1
                if self.at(stop) == "{":
                    primary.append(("body", stop + 1, self.close[stop], ("class", "")))
                    stop = self.close[stop] + 1
            i = max(stop, i + 1)
        elif word == "(":
            primary.append(("code", i + 1, self.close[i], None))
            i = self.close[i] + 1
        elif self.word(i) and self.at(i + 1) == "(":
            calls.append(word)
            rest.append(("code", i + 2, self.close[i + 1], None))
            i = self.close[i + 1] + 1
        elif word in ("this", "super") and self.at(i + 1) == "(":
            primary.append(("code", i + 2, self.close[i + 1], None))
            i = self.close[i + 1] + 1
        else:
            i += 1
        while i < end:
            if self.at(i) == "[":
                rest.append(("code", i + 1, self.close[i], None))
                i = self.close[i] + 1
            elif self.at(i) == ".":
                j = self.angles(i + 1)
                if self.at(j) == "new":
                    inner, i = self.chain(j, end)
                    rest += inner
                elif self.word(j) and self.at(j + 1) == "(":
                    calls.append(self.at(j))
                    rest.append(("code", j + 2, self.close[j + 1], None))
                    i = self.close[j + 1] + 1
                elif j < self.n and self.tokens[j][0] == "word":
                    i = j + 1
                else:
                    i = j
                    break
            else:
                break
        return [("node", 0, 0, ("method_invocation", name, None, None)) for name in reversed(calls)] + primary + rest, i


def parse(source: str) -> list[tuple[str, str | None, str | None, list[str] | None]]:
    """type, name, superclass and interfaces of each node, in pre-order."""
    return _Parser(source).run()


@udtf(returnType="pre long, type string, name string, superclass string, interfaces array<string>")
class JavaAst:
    def eval(self, content: str) -> Iterator[tuple]:
        if content is not None:
            for pre, node in enumerate(parse(content)):
                yield (pre, *node)


def ast_nodes(sources: DataFrame, file_col: str = "path", content_col: str = "content") -> DataFrame:
    """file, pre, type, name, superclass and interfaces of each node of each Java source."""
    spark = sources.sparkSession
    spark.udtf.register("java_ast", JavaAst)
    own = sources.select(F.col(file_col).alias("file"), F.col(content_col).alias("content"))
    return spark.sql("select s.file, n.* from {sources} s, lateral java_ast(s.content) n", sources=own)
