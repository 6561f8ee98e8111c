"""A stored index of names by what is in them: substring searches without a scan of all names.

A name is listed under each run of one to three of its characters, case ignored. A text of up to
three characters has one list, which is its answer. A longer one is looked for in the list of the
rarest of its runs; names that the next ones list too are confirmed by reading them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: Characters of the longest runs; lists of a text that are intersected before names are read.
RUN, LISTS_READ = 3, 3


@dataclass
class NameIndex:
    """runs: (run, id), sorted by run. lengths: (run, n). names: (id, folded), sorted by id."""

    runs: DataFrame
    lengths: DataFrame
    names: DataFrame


def build(names: DataFrame, id: str = "id", name: str = "name") -> NameIndex:
    """The index of (id, name), written to the shared folder.

    Null names are in no list, and an empty one is only in the empty text's. Rows with one id are names of it. The lists are
    dealt by run and id, so that the list of a frequent run is spread over several files.
    """
    folded = written(names.select(F.col(id).alias("id"), F.lower(name).alias("folded")).where("folded IS NOT NULL").distinct().sortWithinPartitions("id"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("folded"), F.lit(1)))
    runs = F.array_distinct(F.flatten(F.transform(starts, lambda k: F.transform(F.array(*(F.lit(n) for n in range(1, RUN + 1))), lambda n: F.substring("folded", k, n)))))
    listed = folded.select(F.explode(runs).alias("run"), "id").where("run <> ''").distinct()
    stored = written(listed.repartitionByRange("run", "id").sortWithinPartitions("run", "id"))
    lengths = written(stored.groupBy("run").agg(F.count("*").alias("n")).repartitionByRange("run").sortWithinPartitions("run"))
    return NameIndex(stored, lengths, folded)


def containing(index: NameIndex, text: str) -> DataFrame:
    """(id) of the names that have a text in them, case ignored, once each; all of them for an empty text."""
    folded = text.lower()
    if not folded:
        return index.names.select("id").distinct()
    if len(folded) <= RUN:
        return index.runs.where(F.col("run") == folded).select("id")
    runs = sorted({folded[k : k + RUN] for k in range(len(folded) - RUN + 1)})
    # a row for each run of a request's text
    known = {r["run"]: r["n"] for r in index.lengths.where(F.col("run").isin(runs)).collect()}
    if len(known) < len(runs):
        return index.runs.where("false").select("id")
    rarest = sorted(runs, key=lambda r: (known[r], r))[:LISTS_READ]
    found = index.runs.where(F.col("run") == rarest[0]).select("id")
    for run in rarest[1:]:
        found = found.join(index.runs.where(F.col("run") == run).select("id"), "id", "left_semi")
    return index.names.join(found, "id", "left_semi").where(F.contains("folded", F.lit(folded))).select("id").distinct()
