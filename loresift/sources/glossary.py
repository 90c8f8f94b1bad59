"""Glossary tables in Markdown as alias suggestions: ``term -> significant words of its meaning``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loresift.sources.parsers import slug

# Words too general to stand for a term.
GENERIC = frozenset(
    """
    thing type kind way name value item items system systems framework platform tool tools library module code data file
    files list set based via etc also still default main primary secondary common typical important specific general
    other another same different various internal external public private shared open close open-source standard custom
    service services
    """.split()
)
FUNCTION_WORDS = frozenset(
    """
    the a an and or but of in on at to for from with by as is are was were be been being has have had do does did this
    that these those it its into out across per if than when while until after before
    """.split()
)
PATH_HINTS = ("glossary", "dictionary", "terms", "vocabulary", "acronyms")
# Headings of glossaries, table rows and what ends a meaning's head.
_TITLE = re.compile(r"#{1,3}\s+(glossary|domain[\s_-]+terms?|acronyms?|terminology|system[\s_-]+names?|common[\s_-]+terms?|abbreviations?)\s*:?\s*$", re.I)
_ROW = re.compile(r"\|\s*([^|]+?)\s*\|\s*(.+?)\s*\|\s*$")
_DIVIDER = re.compile(r"\s*\|[\s|:-]+\|\s*$")
_ASIDE = re.compile(r"[.;(—]|\s--?\s")
WORDS, LONGEST_TERM = 4, 40


def is_glossary(path: str, content: str) -> bool:
    """By its path, or by a heading among its first 80 lines."""
    return any(h in path.lower() for h in PATH_HINTS) or any(_TITLE.match(x) for x in content.splitlines()[:80])


def significant(meaning: str, most: int = WORDS) -> list[str]:
    """Up to four telling words of the meaning's head: what stands before a sentence end or an aside."""
    head = re.sub(r"[*_`\[\]]", " ", _ASIDE.split(meaning, maxsplit=1)[0]).lower()
    words = (w for w in re.findall(r"[a-z][a-z0-9_-]+", head) if len(w) >= 4 and w not in GENERIC | FUNCTION_WORDS)
    return list(dict.fromkeys(words))[:most]


def rows(content: str) -> Iterator[tuple[str, str]]:
    """Cells of two-column table bodies; fences and header rows are passed over."""
    fenced = body = False
    for line in content.splitlines():
        if line.lstrip().startswith("```"):
            fenced, body = not fenced, False
        elif not fenced:
            if _DIVIDER.match(line):
                body = True
            elif not line.lstrip().startswith("|"):
                body = False
            elif body and (m := _ROW.match(line)):
                yield m[1].strip(), m[2].strip()


def terms(content: str) -> Iterator[tuple[str, list[str]]]:
    for term, meaning in rows(content):
        key = slug(term) if re.search("[A-Za-z]", term) else ""
        words = [w for w in significant(meaning) if w != key] if key and len(key) <= LONGEST_TERM else []
        if words:
            yield key, words


def suggested(files: DataFrame, least: int = 1) -> DataFrame:
    """``(term, aliases)`` of the glossaries among ``files(pos, path, content)``: words merged in order of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pos, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if content and is_glossary(path or "", content):
                    out += [(pos, i, t, j, w) for i, (t, ws) in enumerate(terms(content)) for j, w in enumerate(ws)]
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["pos", "line", "term", "place", "word"])

    words = files.select(F.col("pos").cast("long"), "path", "content").mapInArrow(run, "pos long, line long, term string, place long, word string")
    first = F.row_number().over(Window.partitionBy("term", "word").orderBy("pos", "line", "place"))
    words = words.withColumn("k", first).where("k = 1").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "place", "word"))).alias("w"))
    return words.select("term", F.col("w.word").alias("aliases")).where(F.size("aliases") >= least)
