"""Many literal terms at once: one automaton over all of them, so a text is read once however many terms there are.

Terms come as a table of at most ``MOST_BYTES`` of text, an error beyond. They make automata of at most ``BLOCK_BYTES`` of
text, each of which travels to the executors once; texts are read once for each automaton. Counts are those of a search for one term
after the other: whatever the case, line by line, occurrences of one term do not overlap, those of different terms may.

Defined cases. Blank and null terms are ignored; terms that differ in case alone are one, under the smallest spelling. A term
with a line end is never found. Null texts have no lines. Repeated names add up their own rows, each with its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
MOST_BYTES = 256 << 20


def term_table(terms: DataFrame) -> DataFrame:
    """(low, term): each term in lower case, and as it is shown."""
    return terms.where("trim(term) <> '' and not contains(term, '\n')").groupBy(F.lower("term").alias("low")).agg(F.min("term").alias("term"))


def _blocks(terms: DataFrame, size: int) -> list[list[tuple[str, str]]]:
    """The terms in lists of at most ``size`` bytes."""
    table = term_table(terms)
    whole = table.agg(F.sum(F.octet_length("low") + F.octet_length("term"))).first()[0] or 0
    if whole > MOST_BYTES:
        raise ValueError(f"{whole} bytes of terms, over the {MOST_BYTES} that automata may hold")
    out, held = [[]], 0
    for r in table.toLocalIterator():
        n = len(r.low.encode()) + len(r.term.encode())
        if out[-1] and held + n > size:
            out, held = [*out, []], 0
        out[-1].append((r.low, r.term))
        held += n
    return [b for b in out if b]


def search_terms(payloads: DataFrame, terms: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(name, term, line, n) of ``payloads`` (name, text): how often each term of ``terms`` (term) stands on a line."""
    spark = payloads.sparkSession
    schema = "name string, term string, line int, n long"
    rows = payloads.where("text is not null").select("name", F.lower("text").alias("low"))
    out = spark.createDataFrame([], schema)
    for block in _blocks(terms, size):
        machine = ahocorasick.Automaton()
        for low, term in block:
            machine.add_word(low, (len(low), term))
        machine.make_automaton()
        sent = spark.sparkContext.broadcast(machine)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = sent.value
            for batch in batches:
                made = ([], [], [], [])
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for number, line in enumerate(text.split("\n"), 1):
                        count, after = {}, {}
                        for end, (length, term) in machine.iter(line):
                            if end - length + 1 >= after.get(term, 0):
                                count[term] = count.get(term, 0) + 1
                                after[term] = end + 1
                        for term, n in count.items():
                            for column, value in zip(made, (name, term, number, n), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.string()), pa.array(made[1], pa.string()), pa.array(made[2], pa.int32()), pa.array(made[3], pa.int64())], ["name", "term", "line", "n"])

        out = out.union(rows.mapInArrow(find, schema))
    return out
