"""A table function for Spark SQL: the printed lines of documents to entity rows."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..sources import extract, parse

_KEY = re.compile(parse.key_pattern(), re.ASCII)
_COVERAGE = re.compile(parse.COVERAGE_ROW, re.ASCII)
_ENDORSEMENT = re.compile(parse.ENDORSEMENT_ROW, re.ASCII)
_TERM = re.compile(parse.TERM, re.ASCII)
_NUMBER = re.compile(r"-?\d+(\.\d+)?", re.ASCII)


def _filled(pairs: dict[str, str | None]) -> dict[str, str]:
    return {k: v for k, v in pairs.items() if v}


def _amounts(pairs: dict[str, str]) -> dict[str, str]:
    """Amounts of a table's row without signs of money; what is no number is left out."""
    plain = {k: re.sub("[$,]", "", v) for k, v in pairs.items()}
    return {k: v for k, v in plain.items() if _NUMBER.fullmatch(v)}


class PrintedEntities:
    """``printed_entities(table(lines), source => 'doc_id', position => 'pos', line => 'line', hint => 'file')``.

    The function asks for a partition by document, in the lines' order, whatever the table's; further
    columns are not read.  A row holds a line, or an array of lines that follow each other, which costs a call a document
    where whole documents are at hand.  Its result follows the table: the first column has the name and type of
    ``source``, then come ``record_id, label, id, texts, numbers``, numbers as they are printed.  ``hint``,
    the column of a file's name, may be left out.  A task holds one document's fields and rows of its
    tables.  Lines without a source are left out, null and blank ones too; a document of no known type and an
    entity without an id give nothing.
    """

    def __init__(self):
        self.source = self.kind = self.hinted = None
        self.places: list[int] | None = None
        self.head: list[str] = []
        self.cells: dict[str, str] = {}
        self.told: list[str] | None = None
        self.coverages: list[re.Match] = []
        self.endorsements: list[re.Match] = []

    @staticmethod
    def analyze(lines: AnalyzeArgument, source: AnalyzeArgument | None = None, position: AnalyzeArgument | None = None, line: AnalyzeArgument | None = None, hint: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("printed_entities takes a table of lines")
        names = {"source": (source, "doc_id"), "position": (position, "pos"), "line": (line, "line"), "hint": (hint, None)}
        found = {}
        for role, (given, usual) in names.items():
            name = usual if given is None else given.value
            fields = [f for f in lines.dataType.fields if name is not None and f.name.lower() == name.lower()]
            if name is not None and len(fields) != 1:
                raise ValueError(f"{role}: the table has {len(fields)} columns {name}")
            found[role] = fields[0] if fields else None
        kind = found["line"].dataType
        if not isinstance(kind.elementType if isinstance(kind, ArrayType) else kind, StringType):
            raise ValueError("line: not a column of text")
        pairs = MapType(StringType(), StringType())
        schema = StructType([found["source"]])
        for name, kind in (("record_id", StringType()), ("label", StringType()), ("id", StringType()), ("texts", pairs), ("numbers", pairs)):
            schema = schema.add(StructField(name, kind))
        quoted = lambda f: "`" + f.name.replace("`", "``") + "`"
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(quoted(found["source"]))], orderBy=[OrderingColumn(quoted(found["position"]))])

    def eval(self, lines, source="doc_id", position="pos", line="line", hint=None):
        if self.places is None:
            names = [f.lower() for f in lines.__fields__]
            self.places = [names.index(c.lower()) for c in (source, line)]
        self.source, held = lines[self.places[0]], lines[self.places[1]]
        if hint is not None and self.hinted is None:
            by_name = {k.lower(): v for k, v in lines.asDict().items()}
            name = re.search(extract.HINT, by_name[hint.lower()] or "", re.ASCII)
            self.hinted = name.group(1) if name else None
        for text in held if isinstance(held, list) else [held]:
            if text := (text or "").strip(" "):
                self._read(text)

    def _read(self, text: str) -> None:
        if len(self.head) < extract.HEAD_LINES:
            self.head.append(text)
        # a search costs more than a look at the four letters that both patterns begin with
        if text.startswith(("COV-", "END-")):
            for pattern, rows in ((_COVERAGE, self.coverages), (_ENDORSEMENT, self.endorsements)):
                if row := pattern.search(text):
                    rows.append(row)
                    return
        if text in extract.SECTIONS:
            return
        if field := _KEY.search(text):
            self.cells[field.group(1)] = (field.group(2) or "").strip(" ")
            if field.group(1) == "Cause" and self.told is None:
                self.told = []
        elif self.told is not None:
            self.told.append(text)

    def terminate(self):
        head = " ".join(self.head)
        kind = next((k for k, title in extract.TITLES.items() if title in head), None)
        if kind is None or self.source is None:
            return
        own = self.cells.get(extract.OWN_KEY[kind]) or self.hinted
        for label, entity, texts, numbers in self._entities(kind, own):
            if entity:
                yield self.source, own, label, entity, _filled(texts), _filled(numbers)

    def _entities(self, kind: str, own: str | None):
        for rule in extract.RULES:
            if rule.kind != kind:
                continue
            texts = {p: self.cells.get(k) for p, k in rule.text.items()}
            if rule.label == "Policy" and (term := _TERM.search(self.cells.get("Term", ""))):
                texts |= {"start_date": term.group(1), "end_date": term.group(2)}
            if rule.label == "Claim":
                texts["description"] = " ".join(self.told or [])
            if rule.to_document:
                texts[rule.to_document] = own
            yield rule.label, self.cells.get(rule.key) if rule.key else own, texts, {p: self.cells.get(k) for p, k in rule.numbers.items()}
        if kind != "policy":
            return
        for row in self.coverages:
            entity, code, category, limit, deductible, rest = row.groups()
            without = "; ".join(s for s in (part.strip(" ") for part in rest.split(";")) if s)
            yield "Coverage", entity, {"policy_id": own, "code": code, "category": category, "exclusions": without}, _amounts({"limit": limit, "deductible": deductible})
        for row in self.endorsements:
            entity, number, rider, day, change = row.groups()
            yield "Endorsement", entity, {"policy_id": own, "endorsement_number": number, "type": rider, "effective_date": day}, _amounts({"premium_adjustment": change})


def register(spark: SparkSession) -> list[str]:
    """Make ``printed_entities`` known, with ``entity_props`` and ``entity_nums`` that type what it gives."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("printed_entities", udtf(PrintedEntities))
    # a function of SQL may not be called in a lambda, so that both spell a plain number out
    number = r"case when regexp_replace(trim(v), '[$,]', '') rlike '^-?\\d+(\\.\\d+)?$' then try_cast(regexp_replace(trim(v), '[$,]', '') as double) end"
    bodies = [
        f"entity_nums(numbers map<string,string>) returns map<string,double> return map_filter(transform_values(numbers, (k, v) -> {number}), (k, v) -> v is not null)",
        f"entity_props(texts map<string,string>, numbers map<string,string>) returns map<string,string> return map_concat(texts, map_filter(numbers, (k, v) -> ({number}) is null))",
    ]
    for body in bodies:
        spark.sql(f"create or replace temporary function {body}")
    return ["printed_entities", *[b.split("(", 1)[0] for b in bodies]]
