"""Declarations of collections: text fields, virtual fields, attributes and enumerations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"integer": T.LongType(), "enum": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "time": T.TimestampType(), "double": T.DoubleType()}


@dataclass(frozen=True)
class Field:
    """A text field: its number, whether it is indexed, how it is analysed, and its weight in the relevance."""

    name: str
    number: int
    indexed: bool = True
    analyzer: str = "word"
    weight: float = 1.0


@dataclass(frozen=True)
class Collection:
    """What a table of documents holds. id_col identifies a document; fields and attributes are columns."""

    name: str
    fields: tuple[Field, ...]
    attributes: Mapping[str, str] = field(default_factory=dict)
    enums: Mapping[str, int] = field(default_factory=dict)
    virtual: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    id_col: str = "doc_id"

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name.lower():
                return f
        raise KeyError(f"unknown field {name}")

    def scope(self, name: str) -> tuple[Field, ...]:
        """Fields that a field name or virtual field name stands for."""
        if name.lower() in self.virtual:
            return tuple(self.field(n) for n in self.virtual[name.lower()])
        return (self.field(name),)

    @property
    def indexed(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.indexed)

    def struct(self) -> T.StructType:
        """Schema of the collection, with the declarations as metadata."""
        out = T.StructType([T.StructField(self.id_col, T.LongType(), False)])
        for f in self.fields:
            out.add(T.StructField(f.name, T.StringType(), True, {"field_id": f.number, "indexed": f.indexed, "analyzer": f.analyzer, "weight": f.weight}))
        for name, kind in self.attributes.items():
            out.add(T.StructField(name, TYPES[kind.lower()], True, {"kind": kind.lower()}))
        return out


def parse_declarations(text: str) -> Collection:
    """A collection from lines such as ``DocAttrField date Integer``, ``Enum KOR 6``, ``Field 0 title yes 10 10 no``."""
    fields, attributes, enums = [], {}, {}
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if not words:
            continue
        if words[0] == "DocAttrField" and len(words) == 3:
            attributes[words[1].lower()] = words[2].lower()
        elif words[0] == "Enum" and len(words) == 3:
            enums[words[1].upper()] = int(words[2])
        elif words[0] == "Field" and len(words) >= 4:
            fields.append(Field(words[2].lower(), int(words[1]), words[3].lower() == "yes", ANALYZERS.get(words[4] if len(words) > 4 else "10", "word")))
        else:
            raise ValueError(f"cannot read {line!r}")
    if [f.number for f in fields] != sorted({f.number for f in fields}):
        raise ValueError("field numbers must ascend")
    return Collection("declared", tuple(fields), attributes, enums)


#: Analyser numbers of declarations.
ANALYZERS = {"0": "whitespace", "2": "concat", "10": "noun", "11": "compound", "12": "part", "20": "bigram", "21": "bigram", "30": "bigram", "100": "morpheme"}


def enum_code(column: Column, enums: Mapping[str, int]) -> Column:
    """Code of an enumeration's name; null for other names."""
    pairs = [F.lit(x) for item in enums.items() for x in item]
    return F.create_map(*pairs)[F.upper(column)] if pairs else F.lit(None).cast("int")


DOCUMENTS = Collection(
    "documents",
    (Field("title", 0, weight=2.0), Field("body", 1, weight=1.0)),
    {"lang": "string", "source": "string", "n_chars": "integer", "lang_code": "enum", "pub_ymd": "integer"},
    {"EN": 1, "FR": 2, "DE": 3, "ES": 4},
    {"all": ("title", "body")},
)


def documents(raw: DataFrame) -> DataFrame:
    """The documents table as a collection: the first line is the title, the rest the body."""
    title = F.substring_index("text", "\n", 1)
    body = F.substring(F.col("text"), F.length(title) + 2, F.length("text"))
    return raw.select("doc_id", title.alias("title"), body.alias("body"), "lang", "source", "n_chars", enum_code(F.col("lang"), DOCUMENTS.enums).alias("lang_code"))
