"""Which of many keywords stand in a text: one pass a text by an automaton of all keywords.

Keywords are taken in parts of at most ``KEYWORDS``: a part is sent to the tasks, which
build its automaton once a batch run; more keywords mean more passes, not larger tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords that one automaton holds: about 100 bytes each.
KEYWORDS = 100_000


def found_in(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """``texts`` without ``text``, with each of the ``words`` (lower-cased) that the text contains in column ``word``.

    Null texts and null words are passed over; the empty word stands in every text; repeated words count once.
    """
    asked = words.select(F.col(word).alias("w")).filter("w IS NOT NULL").distinct()
    parts = asked.count() // KEYWORDS + 1
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(parts)))
    kept = [c for c in texts.columns if c != text]
    packed = texts.filter(F.col(text).isNotNull()).select(F.struct(*kept).alias("all"), F.col(text).alias("t"))
    schema = T.StructType([packed.schema["all"], T.StructField(word, T.StringType())])
    out = None
    for part in range(parts):
        sent = texts.sparkSession.sparkContext.broadcast([r.w for r in dealt.filter(F.col("part") == part).select("w").collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            spelled: dict[str, set[str]] = {}
            for w in sent.value:
                spelled.setdefault(w.lower(), set()).add(w)
            for low, all_ in spelled.items():
                if low:
                    automaton.add_word(low, all_)
            if len(automaton):
                automaton.make_automaton()
            for batch in batches:
                at, said = [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    hits = set(spelled.get("", ()))
                    if len(automaton):
                        for _, all_ in automaton.iter(value):
                            hits |= all_
                    at += [i] * len(hits)
                    said += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(said, pa.string())], names=["all", word])

        made = packed.mapInArrow(run, schema).select("all.*", word)
        out = made if out is None else out.unionByName(made)
    return out
