r"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without blanks (space, 9-13) at both ends and with A-Z lower-cased; its hash has 128 bits.
Documents arrive in batches. A batch's hashes are summed up to one entry each, merge-anti-joined with the runs of all
earlier batches, so that the lines nobody held before come back, and stored as a sorted run of level 0; a level that
holds ``fanout`` runs is merged into one run of the next level. Reading therefore meets few runs, and each entry is
rewritten only once for each level.

``dedup_lines`` keeps a key of at least ``min_chars`` code points in at least ``min_docs`` documents in the largest
doc_id only. It hands over the batches by falling doc_id: what the anti-join lets through has its keeper in this batch,
and the runs add up how many documents hold a key. What a row loses is then a join of its keys with these verdicts.

Defined results: a null or empty text is one empty line (too short to be dropped); rows are documents, so repeated
rows count each, and all rows with the keeper's id keep the line; null ids are smaller than any id; an empty table
gives no rows. Hot lines are summed before they are shuffled; verdicts on lines that more than a thousandth of all rows
hold are broadcast, fewer than ``HEAVY`` for each line of a row. Lines are gathered by row, never by id. Only doc_id
and text are read; ``deduplicated`` keeps all other columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, release
from .common import keyed, text_slices

MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 5, 3
HEAVY = 1000
_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The hash of a line's key; None where the key is too short."""
    key = line.strip(_BLANKS).lower()  # of bytes: A-Z only
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh128_digest(key)


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rid, doc_id, h): each different key of each row (rid, doc_id, text) once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            keys, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {line_key(x, min_chars) for x in _encoded(text).split(b"\n")} - {None}
                keys += own
                rows += [i] * len(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(at), batch.column("doc_id").take(at), pa.array(keys, pa.binary())], ["rid", "doc_id", "h"])

    return docs.select("rid", docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(emit, "rid long, doc_id long, h binary")


class LineRuns:
    """Runs by level, each a table (h, n_docs) sorted by h inside its files, under the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def _store(self, entries: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(materialise(entries.sortWithinPartitions("h"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._store(self._merged(old), level + 1)
            self.levels[level] = []
            for run in old:
                release(run)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return every.groupBy("h").agg(F.sum("n_docs").alias("n_docs"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def admit(self, keys: DataFrame) -> DataFrame:
        """(h, keeper): the hashes of the batch (doc_id, h) that no earlier run holds, with their largest doc_id here.

        Written down; the batch's own run is added and full levels are compacted.
        """
        summed = materialise(keys.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")), "line-batch")
        fresh = summed.select("h", "keeper")
        for run in self.runs():
            fresh = fresh.join(run.select("h").hint("merge"), "h", "left_anti")
        fresh = materialise(fresh, "line-fresh")
        self._store(summed.select("h", "n_docs"), 0)
        release(summed)
        return fresh

    def entries(self) -> DataFrame | None:
        """All runs as one table with one entry for each key; one run is returned as it is."""
        runs = self.runs()
        return None if not runs else runs[0] if len(runs) == 1 else self._merged(runs)


def _falling_batches(keys: DataFrame, n: int) -> list[DataFrame]:
    """About equal ranges of doc_id from the largest to the smallest; null ids go with the last."""
    cuts = keys.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 1000)).first()[0] or []
    out, rest, key = [], keys, keys["doc_id"]
    for low in sorted(set(cuts), reverse=True):
        out.append(rest.where(key > low))
        rest = keys.where((key <= low) | key.isNull())
    return [*out, rest]


def _dropped(rows: DataFrame, min_chars: int, min_docs: int, n_batches: int) -> DataFrame:
    """(drop_rid, keys): the hashes that each row loses."""
    keys = materialise(line_keys(rows, min_chars), "line-keys")
    runs, kept = LineRuns(rows.sparkSession), []
    for batch in _falling_batches(keys, n_batches):
        kept.append(runs.admit(batch))
    keepers = kept[0]
    for more in kept[1:]:
        keepers = keepers.unionByName(more)
    often = runs.entries().where(F.col("n_docs") >= min_docs)
    verdicts = materialise(often.join(keepers, "h").select(F.col("h").alias("vh"), "n_docs", "keeper"), "line-verdicts")
    for table in [*runs.runs(), *kept]:
        release(table)
    heavy = F.broadcast(verdicts.where(F.col("n_docs") > max(min_docs, rows.count() // HEAVY)))
    same = F.col("h") == F.col("vh")
    held = keys.join(heavy, same).unionByName(keys.join(heavy, same, "left_anti").join(verdicts, same))
    return held.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("rid").alias("drop_rid")).agg(F.collect_list("h").alias("keys"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text without the lines whose key is listed; the key's length was checked when the list was made."""
    for batch in text_slices(batches):
        texts, counts, drops = [], [], []
        for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist()):
            lines = (text or "").split("\n")
            left = lines
            if keys:
                dead = set(keys)
                left = [x for x in lines if line_key(_encoded(x), 0) not in dead]
            texts.append("\n".join(left))
            counts.append(len(lines))
            drops.append(len(lines) - len(left))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_batches: int = BATCHES, carry: list[str] | None = None) -> DataFrame:
    """row (struct of ``carry``, doc_id by default), kept (the text that stays), n_lines, n_dropped.

    Rows get numbers, which are written down with them, so that equal or null ids are nobody's group. A text travels
    once, and no column that is not carried does.
    """
    carry = carry or ["doc_id"]
    rows = keyed(docs.select(*dict.fromkeys([*carry, "doc_id", "text"])))
    text = F.col("row.text").alias("text")
    drops = _dropped(rows.select("rid", F.col("row.doc_id").alias("doc_id"), text), min_chars, min_docs, n_batches)
    lean = rows.select("rid", F.struct(*[F.col("row")[c].alias(c) for c in carry if c != "text"]).alias("row"), text)
    joined = lean.join(drops, F.col("rid") == F.col("drop_rid"), "left").select("row", "text", "keys")
    schema = joined.select("row", F.lit("").alias("kept"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    return joined.mapInArrow(_kept, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with deduplicated texts; ``n_chars``, where there is one, follows the text."""
    out = dedup_lines(docs, carry=[c for c in docs.columns if c != "text"])
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
