"""Graphs from files: N-Triples in Catalyst, Turtle and RDF/XML by a parser over whole files.

All give (s, p, o, is_lit, o_dt, o_lang), distinct, as a graph is a set. Names of blank nodes start with `_:`. The
datatype of a plain literal is null.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string, is_lit boolean, o_dt string, o_lang string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_LINE = r"^\s*(<[^<>\"{}|^`\x00-\x20]*>|_:\S+)\s*<([^<>\"{}|^`\x00-\x20]*)>\s*(?:(<[^<>\"{}|^`\x00-\x20]*>|_:[^\s\"]*[^\s\".])|(\"(?:[^\"\\]|\\.)*\")(?:@([A-Za-z][A-Za-z0-9-]*)|\^\^<([^<>]*)>)?)\s*\.\s*(?:#.*)?$"
# The letters after a backslash that stand for control characters.
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(text: Column) -> Column:
    r"""Escapes of N-Triples resolved: \t \n ... \" \\ \uXXXX \UXXXXXXXX."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def one(piece: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(piece, 3, 8), 8, "0")), "UTF-32")
        out = F.when(piece.rlike(r"^\\(u.{4}|U.{8})$"), code)
        for letter, char in _LETTERS.items():
            out = out.when(piece == "\\" + letter, char)
        return out.when(piece.startswith("\\"), F.substring(piece, 2, 1)).otherwise(piece)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def ntriples(spark: SparkSession, path: str, bad_lines: str = "raise") -> DataFrame:
    """The triples of an N-Triples file. Lines that are neither triples nor blank nor comments raise, or are left out with bad_lines="skip"; `bad_ntriples` gives them."""
    if bad_lines not in ("raise", "skip"):
        raise ValueError("bad_lines is raise or skip")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    fits = F.col("value").rlike(_LINE)
    if bad_lines == "skip":
        lines = lines.where(fits)
    else:
        lines = lines.select(F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))).alias("value"))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    rows = lines.select(*[part(k).alias(c) for k, c in enumerate(("s", "p", "iri", "lit", "lang", "dt"), 1)])
    bare = lambda c: F.when(F.startswith(F.col(c), F.lit("<")), F.expr(f"substring({c}, 2, length({c}) - 2)")).otherwise(F.col(c))
    is_lit = F.col("lit") != ""
    lexical = unescaped(F.expr("substring(lit, 2, length(lit) - 2)"))
    null = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select(unescaped(bare("s")).alias("s"), unescaped(F.col("p")).alias("p"), F.when(is_lit, lexical).otherwise(unescaped(bare("iri"))).alias("o"), is_lit.alias("is_lit"), null("dt").alias("o_dt"), F.lower(null("lang")).alias("o_lang")).distinct()


def bad_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that `ntriples` takes no triple from though they are neither blank nor comments."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$") & ~F.col("value").rlike(_LINE))


_TOKEN = re.compile(
    r'(?P<skip>\s+|#[^\n]*)|<(?P<iri>[^<>"{}|^`\s]*)>|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')'
    r'|(?P<short>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|@(?P<at>[A-Za-z][A-Za-z0-9-]*)|(?P<mark>\^\^|[;,.\[\]()](?!\d))'
    r"|(?P<blank>_:[\w·-](?:[\w·.-]*[\w·-])?)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w:]))|(?P<name>(?:[^\W\d][\w-]*)?:(?:[\w:-](?:[\w:.%-]|\\.)*(?<!\.))?|[A-Za-z]+)",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _LETTERS.get(m[3], m[3]), text)


class _Turtle:
    """A recursive reader of one Turtle document: prefixes, base, lists of predicates and objects, blank nodes, collections."""

    def __init__(self, text: str, mark: str):
        self.tokens, self.at, at = [], 0, 0
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found or found.end() == at:
                raise ValueError(f"not Turtle: {text[at:at + 40]!r}")
            at = found.end()
            if found.lastgroup != "skip":
                self.tokens.append((found.lastgroup, found[found.lastgroup]))
        self.prefixes, self.base, self.out = {}, "", []
        self.fresh = (f"_:{mark}b{k}" for k in itertools.count())

    def peek(self, *marks: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] in [("mark", m) for m in marks]

    def take(self, mark: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("Turtle ends in a statement")
        token, self.at = self.tokens[self.at], self.at + 1
        if mark and token != ("mark", mark):
            raise ValueError(f"{mark!r} expected, not {token[1]!r}")
        return token

    def iri(self, kind: str, value: str) -> str:
        if kind == "iri":
            value = _plain(value)
            return value if not self.base or re.match(r"[A-Za-z][\w+.-]*:", value) else self.base + value
        prefix, colon, local = value.partition(":")
        if kind != "name" or not colon or prefix not in self.prefixes:
            raise ValueError(f"unknown name {value!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def read(self) -> list[tuple]:
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            word = value.lower() if kind in ("at", "name") else ""
            if word in ("prefix", "base"):
                self.at += 1
                if word == "prefix":
                    name = self.take()[1]
                    self.prefixes[name.rstrip(":")] = self.iri(*self.take())
                else:
                    self.base = self.take()[1]
                if kind == "at":
                    self.take(".")
                continue
            subject = self.node()
            if not (subject.startswith("_:") and self.peek(".")):
                self.predicates(subject)
            self.take(".")
        return self.out

    def predicates(self, subject: str) -> None:
        while True:
            kind, value = self.take()
            p = RDF + "type" if (kind, value) == ("name", "a") else self.iri(kind, value)
            while True:
                self.out.append((subject, p, *self.object()))
                if not self.peek(","):
                    break
                self.take()
            while self.peek(";"):
                self.take()
                if self.peek(".", "]", ";"):
                    continue
                break
            else:
                return
            if self.peek(".", "]"):
                return

    def node(self) -> str:
        kind, value = self.take()
        if kind == "blank":
            return value
        if (kind, value) == ("mark", "["):
            name = next(self.fresh)
            if not self.peek("]"):
                self.predicates(name)
            self.take("]")
            return name
        if (kind, value) == ("mark", "("):
            items = []
            while not self.peek(")"):
                items.append(self.object())
            self.take()
            rest = RDF + "nil"
            for item in reversed(items):
                cell = next(self.fresh)
                self.out += [(cell, RDF + "first", *item), (cell, RDF + "rest", rest, False, None, None)]
                rest = cell
            return rest
        return self.iri(kind, value)

    def object(self) -> tuple:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind in ("short", "long"):
            self.at += 1
            text = _plain(value[3:-3] if kind == "long" else value[1:-1])
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "at":
                return text, True, None, self.take()[1].lower()
            if self.peek("^^"):
                self.take()
                return text, True, self.iri(*self.take()), None
            return text, True, None, None
        if kind == "number":
            self.at += 1
            return value, True, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if (kind, value) in (("name", "true"), ("name", "false")):
            self.at += 1
            return value, True, XSD + "boolean", None
        return self.node(), False, None, None


def parse_turtle(text: str, mark: str = "") -> list[tuple]:
    """The triples of a Turtle document; `mark` tells its unnamed blank nodes from those of other documents."""
    return _Turtle(text, mark).read()


def parse_rdfxml(text: str, mark: str = "") -> list[tuple]:
    """The triples of an RDF/XML document: node and property elements and attributes, nested nodes, collections, datatypes and languages."""
    out: list[tuple] = []
    fresh = (f"_:{mark}x{k}" for k in itertools.count())
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    rdf = f"{{{RDF}}}"
    plain = {rdf + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}

    def whole(ref: str, base: str) -> str:
        return ref if re.match(r"[A-Za-z][\w+.-]*:", ref) else base + ref

    def node(element, base: str, lang: str | None) -> str:
        base, lang = element.get(_XML + "base", base), element.get(_XML + "lang", lang)
        if element.get(rdf + "about") is not None:
            subject = whole(element.get(rdf + "about"), base)
        elif element.get(rdf + "ID") is not None:
            subject = f"{base}#{element.get(rdf + 'ID')}"
        else:
            subject = "_:" + element.get(rdf + "nodeID") if element.get(rdf + "nodeID") else next(fresh)
        if element.tag != rdf + "Description":
            out.append((subject, RDF + "type", name(element.tag), False, None, None))
        for key, value in element.attrib.items():
            if key not in plain and not key.startswith(_XML):
                out.append((subject, name(key), value, key != rdf + "type", None, lang if key != rdf + "type" else None))
        members = itertools.count(1)
        for child in element:
            prop(subject, child, base, lang, members)
        return subject

    def prop(subject: str, element, base: str, lang: str | None, members) -> None:
        base, lang = element.get(_XML + "base", base), element.get(_XML + "lang", lang)
        p = f"{RDF}_{next(members)}" if element.tag == rdf + "li" else name(element.tag)
        kind = element.get(rdf + "parseType")
        if element.get(rdf + "resource") is not None:
            o = whole(element.get(rdf + "resource"), base)
        elif element.get(rdf + "nodeID") is not None:
            o = "_:" + element.get(rdf + "nodeID")
        elif kind == "Resource":
            o, inner = next(fresh), itertools.count(1)
            for child in element:
                prop(o, child, base, lang, inner)
        elif kind == "Collection":
            o = RDF + "nil"
            for item in reversed([node(child, base, lang) for child in element]):
                cell = next(fresh)
                out.extend([(cell, RDF + "first", item, False, None, None), (cell, RDF + "rest", o, False, None, None)])
                o = cell
        elif kind == "Literal":
            inside = (element.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in element)
            out.append((subject, p, inside, True, RDF + "XMLLiteral", None))
            return
        elif len(element):
            o = node(element[0], base, lang)
        else:
            dt = element.get(rdf + "datatype")
            out.append((subject, p, element.text or "", True, dt, None if dt else lang and lang.lower()))
            return
        out.append((subject, p, o, False, None, None))

    root = ElementTree.fromstring(text)
    base = root.get(_XML + "base", "")
    for element in root if root.tag == rdf + "RDF" else [root]:
        node(element, base, root.get(_XML + "lang"))
    return out


_PARSERS = {"ttl": parse_turtle, "turtle": parse_turtle, "n3": parse_turtle, "xml": parse_rdfxml, "rdf": parse_rdfxml, "owl": parse_rdfxml}


def parsed_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Triples of Turtle or RDF/XML files. Names hold over a whole document, so a file is one row's work; many files go in parallel."""
    parse = _PARSERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mark, content in zip(batch["mark"], batch["content"], strict=True):
                yield pd.DataFrame(parse(bytes(content).decode("utf-8-sig"), mark), columns=["s", "p", "o", "is_lit", "o_dt", "o_lang"])

    files = spark.read.format("binaryFile").load(path).select(F.substring(F.md5("path"), 1, 8).alias("mark"), "content")
    return files.mapInPandas(run, SCHEMA).distinct()


def load_graph(spark: SparkSession, path: str, kind: str = "nt", bad_lines: str = "raise") -> DataFrame:
    """The triples of a file or folder in one of the formats nt, ttl, n3, xml."""
    if kind == "nt":
        return ntriples(spark, path, bad_lines)
    if kind not in _PARSERS:
        raise ValueError(f"unknown format {kind}")
    return parsed_files(spark, path, kind)


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Writes (s, p, o, is_lit [, o_dt, o_lang]) as N-Triples text."""
    esc = F.col("o")
    for char, by in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(char), F.lit(by))
    ref = lambda c: F.when(F.startswith(F.col(c), F.lit("_:")), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    lit = F.concat(F.lit('"'), esc, F.lit('"'))
    if "o_lang" in triples.columns:
        lit = F.concat(lit, F.coalesce(F.concat(F.lit("@"), "o_lang"), F.concat(F.lit("^^<"), "o_dt", F.lit(">")), F.lit("")))
    line = F.concat(ref("s"), F.lit(" <"), F.col("p"), F.lit("> "), F.when(F.col("is_lit"), lit).otherwise(ref("o")), F.lit(" ."))
    triples.select(line.alias("value")).write.mode("overwrite").text(path)
