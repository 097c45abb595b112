"""Text functions: normalisation, shingles, strict answers, prompts."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed: what ``normalise_exact`` gives for ASCII, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x20]+", " "))


#: Texts that Python holds as strings at once.
SLICE = 64


@F.arrow_udf(StringType())
def _folded(text: pa.Array) -> pa.Array:
    """Besides a batch and what becomes of it, only a slice of the texts is held."""
    fold = lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    parts = [pa.array([fold(t) for t in text.slice(a, SLICE).to_pylist()], pa.string()) for a in range(0, len(text), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalise_exact(text: Column) -> Column:
    """NFKC, case folding, Unicode white space collapsed and trimmed. Texts of ASCII alone do not leave the JVM."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x1C-\x20]+", " "))).otherwise(_folded(F.when(~plain, text)))


def words(norm: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(norm, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def shingles(word_array: Column, n: int = 5) -> Column:
    """Distinct runs of n words, as 64-bit hashes. Pass a materialised array of words: the lambda reads it many times.

    Words are taken one by one: a slice would copy the whole array for every run.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size(word_array) - n), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(word_array, i + k) for k in range(n)])))
    return F.when(F.size(word_array) >= n, F.array_distinct(grams)).otherwise(F.expr("cast(array() as array<bigint>)"))


def parse_answer(raw: Column, choices: Column) -> Column:
    """The index of a single letter among the choices, else -1; nothing but white space may stand around it."""
    bare = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    index = F.ascii(bare) - 65
    return F.when((F.length(bare) == 1) & index.between(0, choices - 1), index).otherwise(-1)


def prompt(question: Column, subquestion: Column, answers: Column, text: Column) -> Column:
    """Question, clause, lettered choices and passage."""
    lines = F.array_join(F.transform(answers, lambda a, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), a)), "\n")
    clause = F.when(subquestion == "<NONE>", "").otherwise(F.concat(F.lit("\nClause: "), subquestion))
    return F.concat(F.lit("Question: "), question, clause, F.lit("\n"), lines, F.lit("\nPassage: "), text)
