"""Words of conclusion in texts, and result columns that would state one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stems of words that state a conclusion, and words that only look like one.
STEMS = ("conclu", "exclud", "exclus", "identif", "inconclu", "match")
NOT_MEANT = ("identifier", "identifiers")
#: Line ends as a text reader knows them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: A line that says where its words come from.
ATTRIBUTED = r"\[(cited:|measured over)\s*[^\]\s][^\]]*\]"


def conclusion_words(texts: DataFrame, source: str, text: str, stems=STEMS, names: tuple[str, ...] = (), not_meant=NOT_MEANT) -> DataFrame:
    """(source, line, column, word), counted from 1, of each word that begins with a stem.

    Attributed lines are skipped; declared names are blanked first, the longest first. Runs inside the
    JVM: each line is split at the words that count, and one walk along the pieces adds up their lengths.
    """
    lines = texts.select(F.col(source).alias("source"), F.posexplode(F.split(F.coalesce(text, F.lit("")), LINE_END, -1)).alias("_line", "body"))
    body = F.col("body")
    pattern = _meant(stems, not_meant)
    lines = lines.where(body.rlike(pattern)).where(~body.rlike(ATTRIBUTED))
    for name in sorted(names, key=len, reverse=True):
        body = F.regexp_replace(body, re.escape(name), " " * len(name))
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("_words")
    parts = lines.select("source", (F.col("_line") + 1).alias("line"), found, F.split(body, pattern, -1).alias("_between"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("columns"))

    def step(state: Column, piece: Column) -> Column:
        column = state["at"] + F.length(piece["_between"])
        return F.struct((column + F.coalesce(F.length(piece["_words"]), F.lit(0))).alias("at"), F.concat(state["columns"], F.array(column)).alias("columns"))

    columns = F.aggregate(F.arrays_zip("_between", "_words"), start, step)["columns"]  # one more than words: the line's end
    placed = F.arrays_zip(F.slice(columns, F.lit(1), F.size("_words")).alias("column"), F.col("_words").alias("word"))
    return parts.select("source", "line", F.explode(placed).alias("found")).select("source", "line", "found.column", "found.word")


def _meant(stems, not_meant) -> str:
    """A word, whole, that begins with a stem in either case and isn't one of ``not_meant``."""
    stem, other = ("|".join(map(re.escape, words)) for words in (stems, not_meant))
    return rf"(?<![A-Za-z])(?i:{f'(?!(?:{other})(?![A-Za-z]))' if other else ''}(?:{stem})[A-Za-z]*)"


def conclusion_fields(schema: T.StructType, stems=STEMS, not_meant=NOT_MEANT) -> list[str]:
    """Boolean columns, nested ones too, one of whose name's parts begins with a stem."""
    out = []
    for field in schema:
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += [f"{field.name}.{x}" for x in conclusion_fields(kind, stems, not_meant)]
        elif isinstance(kind, T.BooleanType) and any(p.startswith(tuple(stems)) and p not in not_meant for p in field.name.lower().split("_")):
            out.append(field.name)
    return out
