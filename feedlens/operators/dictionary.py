"""J3 (and J4, F4, F6) with the dictionary as a table.

The distinct terms become one Aho-Corasick automaton, which finds all of them in a single pass over a text,
however many there are. At most ``SLICE_BYTES`` of terms, counted first, are made into one; a larger dictionary is
dealt to slices by hash. The terms of all slices are broadcast, and a task holds one automaton at a time: it
scans a bounded number of texts for one slice after the other, so a row has all its terms together, however many
slices there are.

A term is contained where its lower-cased characters stand in the lower-cased text, inside of words as well. Null
and empty terms are left out; a null text holds no term; a row gives each of its terms once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of the terms in one automaton, which takes about fifty times as much.
SLICE_BYTES = 2 << 20
#: UTF-8 bytes of texts that are scanned for all slices together, so that often an automaton is made.
HELD_BYTES = 32 << 20


def _ship_by_value() -> None:
    import sys

    from pyspark import cloudpickle

    mod = sys.modules[__name__]
    if mod.__name__ not in getattr(cloudpickle.cloudpickle, "_PICKLE_BY_VALUE_MODULES", set()):
        cloudpickle.register_pickle_by_value(mod)


def slices_of(terms: DataFrame, term_col: str, slice_bytes: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The distinct lower-cased terms, in lists of about ``slice_bytes`` bytes."""
    distinct = terms.select(F.lower(F.col(term_col)).alias("t")).where(F.length("t") > 0).distinct()
    total = distinct.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-int(total) // slice_bytes)
    for k in range(n):
        yield distinct.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).toArrow()["t"].to_pylist()


def automaton_of(terms: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t, t)
    automaton.make_automaton()
    return automaton


def held_together(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of neighbouring batches, with about ``most`` bytes in a column."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def dictionary_hits(rows: DataFrame, terms: DataFrame, text_col: str, term_col: str = "term", keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(kept columns, terms): one row per row that holds any term, with the sorted array of all terms found.

    ``keep``: all columns but the text.
    """
    _ship_by_value()
    keep = [c for c in rows.columns if c != text_col] if keep is None else keep
    source = rows.select(*keep, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_lower"))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["terms array<string>"])
    refs = [rows.sparkSession.sparkContext.broadcast(pickle.dumps(part)) for part in slices_of(terms, term_col, slice_bytes) if part]
    if not refs:
        return rows.sparkSession.createDataFrame([], ddl)
    text, most = len(keep), HELD_BYTES if len(refs) > 1 else 0  # one automaton stays: a batch needs no company

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, automaton = None, None
        order = list(range(len(refs)))
        for held in held_together(batches, text, most):
            found = [[()] * b.num_rows for b in held]
            for k in order:
                if made != k:
                    automaton = None  # two at once would take twice the memory
                    made, automaton = k, automaton_of(pickle.loads(refs[k].value))
                for b, of_batch in zip(held, found):
                    # one text at a time: a batch of whole texts as strings takes several times its own size
                    for n, x in enumerate(b.column(text)):
                        hits = {t for _, t in automaton.iter(x.as_py())}
                        if hits:
                            of_batch[n] = hits.union(of_batch[n])
            order.reverse()  # the next texts begin with the automaton that is there
            for b, of_batch in zip(held, found):
                hit = pa.array([n for n, f in enumerate(of_batch) if f], pa.int64())
                arrays = [b.column(k).take(hit) for k in range(text)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([sorted(f) for f in of_batch if f], pa.list_(pa.string()))], names=[*keep, "terms"])

    return source.mapInArrow(run, ddl)


def rows_with_terms(rows: DataFrame, terms: DataFrame, text_col: str, key: str, term_col: str = "term") -> DataFrame:
    """the rows whose text holds any term, known by their unique ``key``."""
    return rows.join(dictionary_hits(rows, terms, text_col, term_col, [key]).select(key).distinct(), key, "left_semi")
