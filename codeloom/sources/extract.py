"""Source files to graph rows: a lexical reader of a JavaScript/TypeScript subset, and a registry of such readers.

A reader turns one file's text into records (declarations, uses, imports, re-exports); it knows nothing of other
files. What needs them, where an import leads and which stand-ins it makes, is one relational step over all records.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import model
from codeloom.operators import changes, resolve

RECORD = "record string, id string, fromId string, kind string, name string, qualifiedName string, filePath string, startLine int, startCol int, endLine int, endCol int, signature string, exported boolean, docComment string, nativeKind string, hasBody boolean, specifier string, imported string, statement int, broken boolean"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_TOKEN = re.compile(
    r"(?P<doc>/\*\*(?!/).*?\*/)|(?P<skip>/\*.*?\*/|//[^\n]*|\s+)|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<tpl>`(?:\\.|[^`\\])*`)"
    r"|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>\.\.\.|=>|\?\.|[{}()\[\];,.<>=:?!+\-*/%&|^~@#])|(?P<bad>.)",
    re.S,
)
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "readonly", "static", "override"}
_KEYWORDS = set("as async await break case catch class const continue default delete do else enum export extends false finally for from function get if implements import in instanceof interface is keyof let namespace module new null of return set static super switch this throw true try type typeof undefined var void while with yield any boolean number string symbol unknown never object".split())


def make_id(file: str, kind: str, qualified: str, native: str | None = None) -> str:
    return hashlib.sha256("\0".join(("node", file, kind, qualified, native or "")).encode()).hexdigest()[:32]


class Reader:
    """One file. ``records`` after ``read``; a file that can't be read whole gives what was met, flagged as broken."""

    def __init__(self, file: str, text: str):
        self.file, self.text, self.records, self.broken = file, text, [], False
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.t: list[tuple[str, str, int, int]] = []
        self.docs: dict[int, str] = {}
        for m in _TOKEN.finditer(text):
            if m.lastgroup == "doc":
                self.docs[len(self.t)] = re.sub(r"^\s*\* ?|^/\*\*|\*/$", "", m[0], flags=re.M).strip()
            elif m.lastgroup == "bad":
                self.broken = True
            elif m.lastgroup != "skip":
                self.t.append((m.lastgroup, m[0], m.start(), m.end()))
        self.t.append(("end", "", len(text), len(text)))
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, v, _, _) in enumerate(self.t):
            if kind == "op" and v in "([{":
                stack.append(i)
            elif kind == "op" and v in ")]}":
                if stack and "([{".index(self.t[stack[-1]][1]) == ")]}".index(v):
                    self.close[stack.pop()] = i
                else:
                    self.broken = True
        if stack:
            self.broken = True
            self.close.update(dict.fromkeys(stack, len(self.t) - 1))
        self.file_id = make_id(file, "File", file)
        self.own: dict[str, str] = {}  # names declared in this file -> id
        self.imports: dict[str, tuple[str, str]] = {}  # local name -> (specifier, imported name or *)
        self.constants: dict[str, str] = {}
        self.uses: list[tuple[int, int, str, set[str]]] = []  # token ranges to search, their owner and its local names
        self.statement = 0

    def v(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "id"

    def at(self, pos: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, pos) - 1
        return line, pos - self.starts[line]

    def emit(self, record: str, **fields) -> None:
        self.records.append(dict.fromkeys(_NAMES) | {"record": record, "filePath": self.file, "statement": self.statement} | fields)

    def read(self) -> list[dict]:
        last = self.at(len(self.text))
        self.emit("node", id=self.file_id, kind="File", name=self.file.rpartition("/")[2], qualifiedName=self.file, startLine=0, startCol=0, endLine=last[0], endCol=last[1], exported=True, hasBody=True)
        self.block(0, len(self.t) - 1, self.file_id, "", set())
        for lo, hi, owner, hidden in self.uses:
            self.search(lo, hi, owner, hidden)
        for r in self.records:
            r["broken"] = self.broken
        return self.records

    def declare(self, begin: int, end: int, kind: str, name: str, prefix: str, sep: str = ".", native: str | None = None, exported: bool = False, signature: str | None = None, body: bool = True) -> str:
        qualified = f"{prefix}{sep}{name}" if prefix else name
        i = make_id(self.file, kind, qualified, native)
        a, b = self.at(self.t[begin][2]), self.at(self.t[end][3])
        self.emit("node", id=i, kind=kind, name=name, qualifiedName=qualified, nativeKind=native, exported=exported, signature=signature, docComment=self.docs.get(begin), hasBody=body, startLine=a[0], startCol=a[1], endLine=b[0], endCol=b[1])
        if not prefix:
            self.own[name] = i
        return i

    def until(self, i: int, hi: int, stops: str) -> int:
        """The next of some signs at this depth."""
        while i < hi and not (self.t[i][0] == "op" and self.v(i) in stops):
            i = self.close.get(i, i) + 1
        return min(i, hi)

    def line_end(self, i: int, hi: int) -> int:
        """Where a statement without a semicolon ends: at a line that begins a new one."""
        while i < hi and self.v(i) != ";":
            step = self.close.get(i, i) + 1
            if step < hi and self.at(self.t[step][2])[0] > self.at(self.t[step - 1][3])[0] and self.v(step) not in (".", "?", ":", "=", "+", "&", "|", "=>", ",", ")", "?.") and self.v(step - 1) not in (",", "=", "=>", "+", "&", "|", "?", ":", "(", "<"):
                return step
            i = step
        return min(i, hi)

    def block(self, i: int, hi: int, owner: str, prefix: str, hidden: set[str]) -> None:
        """The statements of a file or namespace."""
        while i < hi:
            begin, flags = i, set()
            self.statement += 1
            while self.v(i) in _MODIFIERS and self.is_id(i) and self.v(i + 1) not in ("(", "=", ".", ";"):
                flags.add(self.v(i))
                i += 1
            word, exported = self.v(i), "export" in flags
            if "export" in flags and word in ("*", "{") or "export" in flags and word == "type" and self.v(i + 1) in ("{", "*"):
                i = self.export(i + (word == "type"), hi)
            elif word == "import" and self.v(i + 1) not in ("(", "."):
                i = self.import_(i + 1, hi)
            elif word == "function":
                i = self.function(begin, i + 1, hi, prefix, exported, "default" in flags)
            elif word == "class" or word == "interface":
                i = self.type(begin, i + 1, hi, prefix, exported, word, "default" in flags)
            elif word in ("type", "enum") and self.is_id(i + 1) or word == "const" and self.v(i + 1) == "enum":
                i = self.alias(begin, i + 1 + (word == "const"), hi, prefix, exported, word != "type")
            elif word in ("namespace", "module") and (self.is_id(i + 1) or self.t[i + 1][0] == "str") and not (self.v(i + 1) in ("=", ".")):
                name, at = self.v(i + 1).strip("\"'"), self.until(i + 1, hi, "{;")
                end = self.close.get(at, at)
                self.declare(begin, end, "Module", name, prefix, native="namespace", exported=exported)
                self.block(at + 1, end, owner, f"{prefix}.{name}" if prefix else name, hidden)
                i = end + 1
            elif word in ("const", "let", "var"):
                i = self.variables(begin, i + 1, hi, prefix, exported, owner)
            elif exported and "default" in flags:
                end = self.line_end(i, hi)
                if self.is_id(i) and self.v(i) in self.own:
                    self.emit("reexport", name="default", specifier=None, imported=self.v(i))
                else:
                    self.declare(begin, max(end - 1, i), "Variable", "default", prefix, exported=True)
                self.uses.append((i, end, owner, hidden))
                i = end + 1
            else:
                end = self.line_end(i, hi)
                self.uses.append((i, end, owner, hidden))
                i = max(end + (self.v(end) == ";"), i + 1)

    def names(self, i: int, end: int) -> Iterator[tuple[str, str]]:
        """(name, alias) of a braced list."""
        for part in " ".join(self.v(k) for k in range(i + 1, end)).split(","):
            words = [w for w in part.split() if w != "type"] or part.split()
            if words:
                yield words[0], words[-1]

    def import_(self, i: int, hi: int) -> int:
        end = self.line_end(i, hi)
        if self.v(i) == "type" and self.v(i + 1) not in ("from", ","):
            i += 1
        spec = next((self.v(k)[1:-1] for k in range(i, end + 1) if self.t[k][0] == "str"), None)
        if spec is None:
            self.broken = True
            return max(end, i) + 1
        self.emit("import", fromId=self.file_id, specifier=spec)
        k = i
        while k < end and self.v(k) != "from" and self.t[k][0] != "str":
            if self.v(k) == "{":
                for name, alias in self.names(k, self.close.get(k, end)):
                    self.imports[alias] = (spec, name)
                k = self.close.get(k, end)
            elif self.v(k) == "*" and self.v(k + 1) == "as":
                self.imports[self.v(k + 2)] = (spec, "*")
                k += 2
            elif self.is_id(k) and self.v(k + 1) in ("from", ",", "="):
                self.imports[self.v(k)] = (spec, "*" if self.v(k + 1) == "=" else "default")
            k += 1
        return end + (self.v(end) == ";")

    def export(self, i: int, hi: int) -> int:
        end = self.line_end(i, hi)
        spec = next((self.v(k)[1:-1] for k in range(i, end + 1) if self.t[k][0] == "str"), None)
        if spec is not None:
            self.emit("import", fromId=self.file_id, specifier=spec)
        if self.v(i) == "*":
            if self.v(i + 1) != "as":  # a named whole-module export is an object, not a barrel
                self.emit("reexport", name="*", specifier=spec, imported="*")
        else:
            for name, alias in self.names(i, self.close.get(i, end)):
                source, imported = (spec, name) if spec is not None else self.imports.get(name, (None, name))
                self.emit("reexport", name=alias, specifier=source, imported=imported)
        return max(end, i) + (self.v(end) == ";") or i + 1

    def params(self, i: int) -> set[str]:
        """Names that a parameter list binds."""
        end = self.close.get(i, i)
        return {self.v(k) for k in range(i + 1, end) if self.is_id(k) and self.v(k - 1) in ("(", ",", "{", "[", "...") and self.v(k) not in _KEYWORDS}

    def generics(self, i: int) -> tuple[int, set[str]]:
        """Behind a list of type parameters, and their names."""
        if self.v(i) != "<":
            return i, set()
        depth, names, k = 0, set(), i
        while k < len(self.t) - 1:
            depth += (self.v(k) == "<") - (self.v(k) == ">" and self.v(k - 1) != "=")
            if self.is_id(k) and depth == 1 and self.v(k - 1) in ("<", ","):
                names.add(self.v(k))
            k += 1
            if depth == 0:
                break
        return k, names

    def locals(self, lo: int, hi: int) -> set[str]:
        return {self.v(k + 1) for k in range(lo, hi) if self.v(k) in ("const", "let", "var", "function", "class") and self.is_id(k + 1)}

    def body(self, i: int, hi: int, owner: str, hidden: set[str]) -> tuple[int, int, bool]:
        """Reads parameters and body from ``(`` on; returns where the signature and all of it end, and if there is a body."""
        hidden = hidden | self.params(i)
        at = self.close.get(i, i) + 1
        if self.v(at) == ":":
            while at < hi and self.v(at) not in ("{", ";", "=>") or self.v(at) == "{" and self.v(at - 1) in (":", "|", "&", "<"):
                at = self.close.get(at, at) + 1
                if self.at(self.t[at][2])[0] > self.at(self.t[at - 1][3])[0] and self.v(at) != "{":
                    break
        has = self.v(at) == "{"
        end = self.close.get(at, at) if has else at - (self.v(at) != ";")
        self.uses.append((i, end, owner, hidden | (self.locals(at, end) if has else set())))
        return at, end, has

    def function(self, begin: int, i: int, hi: int, prefix: str, exported: bool, default: bool) -> int:
        i += self.v(i) == "*"
        name = self.v(i) if self.is_id(i) else "default"
        i += self.is_id(i)
        i, generic = self.generics(i)
        owner = make_id(self.file, "Function", f"{prefix}.{name}" if prefix else name)
        stop, end, has = self.body(i, hi, owner, generic)
        self.declare(begin, end, "Function", name, prefix, exported=exported, signature=self.text[self.t[begin][2] : self.t[stop - 1][3]], body=has)
        if default and name != "default":
            self.emit("reexport", name="default", specifier=None, imported=name)
        return end + 1

    def type(self, begin: int, i: int, hi: int, prefix: str, exported: bool, word: str, default: bool) -> int:
        name = self.v(i) if self.is_id(i) and self.v(i) not in ("extends", "implements") else "default"
        i += name != "default"
        i, generic = self.generics(i)
        at = self.until(i, hi, "{")
        end = self.close.get(at, at)
        owner = self.declare(begin, end, "Type", name, prefix, native=None, exported=exported, signature=self.text[self.t[begin][2] : self.t[at - 1][3]])
        k, depth = i, 0
        while k < at:
            depth += (self.v(k) == "<") - (self.v(k) == ">")
            if self.is_id(k) and self.v(k) not in _KEYWORDS and depth == 0 and self.v(k - 1) in ("extends", "implements", ","):
                self.emit("use", fromId=owner, kind="SUPERTYPE_OF", name=self.v(k))
            k += 1
        self.uses.append((i, at, owner, generic))
        self.members(at + 1, end, f"{prefix}.{name}" if prefix else name, owner, generic, exported)
        if default and name != "default":
            self.emit("reexport", name="default", specifier=None, imported=name)
        return end + 1

    def members(self, i: int, hi: int, qualified: str, owner: str, generic: set[str], exported: bool) -> None:
        while i < hi:
            begin, static, native = i, False, None
            while self.v(i) in _MODIFIERS | {"get", "set", "*", "#"} and self.v(i + 1) not in ("(", "=", ":", ";", "?"):
                static |= self.v(i) == "static"
                native = {"get": "getter", "set": "setter"}.get(self.v(i), native)
                i += 1
            name = self.v(i)
            at, own = self.generics(i + 1 + (self.v(i + 1) == "?"))
            if self.is_id(i) and self.v(at) == "(":
                who = make_id(self.file, "Function", f"{qualified}{'.' if static else '#'}{name}", native)
                stop, end, has = self.body(at, hi, who, generic | own)
                self.declare(begin, end, "Function", name, qualified, "." if static else "#", native, exported, self.text[self.t[begin][2] : self.t[stop - 1][3]], has)
                i = end + 1
            else:
                end = self.line_end(i, hi)
                self.uses.append((i + 1, end, owner, generic))
                i = max(end + (self.v(end) == ";"), i + 1)

    def alias(self, begin: int, i: int, hi: int, prefix: str, exported: bool, enum: bool) -> int:
        name = self.v(i)
        at, generic = self.generics(i + 1)
        end = self.close.get(self.until(at, hi, "{"), at) if enum else self.line_end(at, hi) - 1
        owner = self.declare(begin, max(end, i), "Type", name, prefix, exported=exported, signature=None if enum else self.text[self.t[begin][2] : self.t[max(end, i)][3]])
        if enum:
            for k in range(at, end):
                if self.is_id(k) and self.v(k + 1) == "=" and self.t[k + 2][0] == "str":
                    self.constants[f"{name}.{self.v(k)}"] = self.v(k + 2)[1:-1]
        else:
            self.uses.append((at, end + 1, owner, generic))
        return max(end, i) + 1 + (self.v(end + 1) == ";")

    def variables(self, begin: int, i: int, hi: int, prefix: str, exported: bool, owner: str) -> int:
        end = self.line_end(i, hi)
        while i < end:
            stop = self.until(i, end, ",")
            if self.is_id(i):
                eq = self.until(i, stop, "=")
                arrow = next((k for k in range(eq + 1, stop) if self.v(k) == "=>"), None)
                made = self.v(eq) == "=" and (self.v(eq + 1) == "function" or self.v(eq + 1) == "async" and self.v(eq + 2) == "function" or arrow is not None and (self.v(arrow - 1) == ")" or arrow == eq + 2))
                who = self.declare(begin, max(stop - 1, i), "Function" if made else "Variable", self.v(i), prefix, exported=exported, signature=self.text[self.t[i][2] : self.t[eq - 1][3]])
                if eq + 1 < stop and (value := self.fold(eq + 1, stop)) and len(value) == 1:
                    self.constants[self.v(i)] = value[0]
                if eq + 2 < stop and self.v(eq + 1) == "require" and self.v(eq + 2) == "(" and (spec := self.fold(eq + 3, self.close.get(eq + 2, eq))):
                    self.imports[self.v(i)] = (spec[0], "*")
                hidden = {self.v(i)}
                if made:
                    at = next((k for k in range(eq + 1, stop) if self.v(k) == "("), None)
                    hidden |= (self.params(at) if at is not None else set()) | self.locals(eq, stop) | ({self.v(eq + 1)} if arrow == eq + 2 else set())
                self.uses.append((i + 1, stop, who, hidden))
            else:
                self.uses.append((i, stop, owner, set()))
            i = stop + 1
        return end + (self.v(end) == ";") if end > begin else begin + 1

    def fold(self, lo: int, hi: int) -> list[str] | None:
        """The strings that an expression of constants may be; None if any part isn't constant."""
        if hi - lo == 1:
            kind, v = self.t[lo][:2]
            if kind == "str":
                return [v[1:-1]]
            if kind == "tpl":
                parts = re.split(r"\$\{\s*([\w.$]+)\s*\}", v[1:-1])
                if any("${" in p for p in parts[::2]) or any(p not in self.constants for p in parts[1::2]):
                    return None
                return ["".join(p if n % 2 == 0 else self.constants[p] for n, p in enumerate(parts))]
            return [self.constants[v]] if v in self.constants else None
        name = "".join(self.v(k) for k in range(lo, hi))
        if name in self.constants:
            return [self.constants[name]]
        ask = self.until(lo, hi, "?")
        if ask < hi:
            colon = self.until(ask + 1, hi, ":")
            a, b = self.fold(ask + 1, colon), self.fold(colon + 1, hi)
            return a + b if a and b else None
        if name.startswith("path.join(__dirname,") or name.startswith("path.resolve(__dirname,"):
            out, k = [], lo + 6
            while k < hi - 1:
                stop = self.until(k, hi - 1, ",")
                if (one := self.fold(k, stop)) is None or len(one) != 1:
                    return None
                out.append(one[0])
                k = stop + 1
            joined = "/".join(out)
            return [joined if joined.startswith(".") else f"./{joined}"]
        return None

    def search(self, lo: int, hi: int, owner: str, hidden: set[str]) -> None:
        """Calls and mentions of names that the file declares or imports."""
        for k in range(lo, hi):
            if not self.is_id(k) or self.v(k - 1) in (".", "?.") or (self.v(k) in _KEYWORDS and self.v(k) not in ("import",)):
                continue
            name = self.v(k)
            if name in ("require", "import") and self.v(k + 1) == "(" and name not in hidden:
                for spec in self.fold(k + 2, self.close.get(k + 1, k + 2)) or []:
                    self.emit("import", fromId=self.file_id, specifier=spec)
                continue
            if name in hidden or self.v(k + 1) == ":" and self.v(k - 1) in ("{", ","):
                continue
            member = self.v(k + 2) if self.v(k + 1) == "." and self.imports.get(name, ("", ""))[1] == "*" else None
            after, _ = self.generics(k + 1) if self.v(k + 1) == "<" and self.v(k - 1) != "<" else (k + 1, None)
            call = self.v(k + 3 if member else after) == "(" and self.v(k - 1) != "new" and owner != self.file_id
            if member:
                self.emit("member", fromId=owner, kind="CALLS" if call else "REFERENCES", name=member, specifier=self.imports[name][0], imported=member)
            elif name in self.own and self.own[name] != owner or name in self.imports:
                self.emit("use", fromId=owner, kind="CALLS" if call else "REFERENCES", name=name)


def read_script(file: str, text: str) -> list[dict]:
    """Records of one file, with uses told apart: of names of the file itself, and of imported ones."""
    reader = Reader(file, text)
    records = reader.read()
    for r in records:
        if r["record"] == "use":
            if r["name"] in reader.imports and r["name"] not in reader.own:
                r["specifier"], r["imported"] = reader.imports[r["name"]]
            else:
                r["id"] = reader.own.get(r["name"])
        elif r["record"] == "reexport" and r["specifier"] is None and r["name"] == r["imported"]:
            for d in records:
                if d["record"] == "node" and d["qualifiedName"] == r["imported"]:
                    d["exported"] = True
            r["record"] = "exported"
    return records


class Registry:
    """Readers by file extension. An extension of two readers is an error."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable[[str, str], list[dict]]] = {}

    def add(self, extensions: list[str], reader: Callable[[str, str], list[dict]]) -> Registry:
        for e in extensions:
            if e.lower() in self.readers:
                raise ValueError(f"two readers for {e}")
            self.readers[e.lower()] = reader
        return self

    def extract(self, files: DataFrame) -> DataFrame:
        """Records of files (filePath, content); files of other extensions give none, files that fail are broken and empty."""
        readers = self.readers

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for file, content in zip(pdf["filePath"], pdf["content"], strict=True):
                    reader = readers.get("." + file.rpartition(".")[2].lower())
                    if reader is None:
                        continue
                    try:
                        rows = reader(file, bytes(content).decode("utf-8", "replace"))
                    except Exception:
                        rows = [dict.fromkeys(_NAMES) | {"record": "node", "id": make_id(file, "File", file), "kind": "File", "name": file.rpartition("/")[2], "qualifiedName": file, "filePath": file, "startLine": 0, "startCol": 0, "endLine": 0, "endCol": 0, "exported": True, "hasBody": True, "broken": True}]
                    yield pd.DataFrame(rows, columns=_NAMES)

        return files.select("filePath", "content").mapInPandas(run, RECORD)


def default_registry() -> Registry:
    return Registry().add(resolve.SUPPORTED, read_script)


def build(records: DataFrame, rules: DataFrame | None = None, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, declarations) of records. ``files`` (filePath) are those that imports may lead to, by default the records' own."""
    rows = records.where("record = 'node'").withColumn("hasSyntaxErrors", F.col("broken")).withColumn("language", F.lit("typescript"))
    nodes, declarations = changes.group_declarations(rows.select("id", "kind", "name", "qualifiedName", "filePath", "startLine", "startCol", "endLine", "endCol", "signature", "exported", "docComment", "language", "nativeKind", "hasSyntaxErrors", "hasBody"))
    nodes = model.conform(nodes, model.NODES)
    known = nodes.where("kind = 'File'").select("filePath") if files is None else files
    spec = records.where("specifier is not null").select(F.col("filePath").alias("importer"), "specifier").distinct()
    paths = resolve.resolve(spec, known, rules).withColumnRenamed("importer", "filePath")
    placed = records.where("specifier is not null").join(paths, ["filePath", "specifier"])
    base = [F.lit(False).alias("exported"), F.lit("typescript").alias("language"), F.lit(False).alias("hasSyntaxErrors")]

    def standing(df: DataFrame, name, qualified, native) -> DataFrame:
        i = model.node_id(F.col("filePath"), F.lit("Module"), qualified, native)
        return df.withColumn("toId", i).withColumn("_name", name).withColumn("_q", qualified).withColumn("_native", native)

    modules = standing(placed.where("record = 'import'"), F.coalesce("path", "specifier"), F.coalesce("path", "specifier"), F.when(F.col("path").isNotNull(), model.RESOLVED_MODULE).otherwise(model.EXTERNAL_MODULE))
    named = placed.where("record in ('use', 'member') and path is not null and imported != '*'")
    pending = standing(named, F.col("imported"), F.concat_ws("#", "path", "imported"), F.lit(model.PENDING_SYMBOL))
    local = records.where("record = 'reexport' and specifier is null").select("filePath", "name", F.concat_ws("#", "filePath", "imported").alias("address"))
    barrel = placed.where("record = 'reexport' and path is not null").select("filePath", "name", F.concat_ws("#", "path", "imported").alias("address")).unionByName(local)
    barrel = standing(barrel, F.col("name"), F.col("address"), F.lit(model.REEXPORT))
    extra = [df.select(F.col("toId").alias("id"), F.lit("Module").alias("kind"), F.col("_name").alias("name"), F.col("_q").alias("qualifiedName"), "filePath", F.col("_native").alias("nativeKind"), *base).distinct() for df in (modules, pending, barrel)]
    all_nodes = changes.union([nodes, *[model.conform(e, model.NODES) for e in extra]])
    file = nodes.where("kind = 'File'").select("filePath", F.col("id").alias("fromId"))
    symbols = nodes.where("kind != 'File'").join(file, "filePath")
    pairs = [
        symbols.select("fromId", F.col("id").alias("toId"), F.lit("DEFINES").alias("kind"), F.lit(True).alias("resolved")),
        symbols.where("exported").select("fromId", F.col("id").alias("toId"), F.lit("EXPORTS").alias("kind"), F.lit(True).alias("resolved")),
        modules.select("fromId", "toId", F.lit("IMPORTS").alias("kind"), F.lit(False).alias("resolved")),
        records.where("record = 'use' and id is not null").select("fromId", F.col("id").alias("toId"), "kind", F.lit(True).alias("resolved")),
        pending.select("fromId", "toId", "kind", F.lit(False).alias("resolved")),
    ]
    edges = changes.union(pairs).distinct().withColumn("source", F.lit("tree-sitter")).withColumn("id", model.edge_id(F.col("fromId"), F.col("kind"), F.col("toId")))
    return all_nodes, model.conform(edges, model.EDGES), declarations
