r"""Benchmark decontamination by word windows.

Both sides are lower-cased (A-Z) and cut into words. The benchmark's windows (``WIDTH`` words; a shorter item is one
window) form a broadcast hash set whose size is measured first. A training text is scanned inside its row: window
hashes come from array expressions, a bit table derived from the benchmark discards nearly all, the rest probe the
hash set and are verified word by word. Only candidates and one small row per document are shuffled, never texts.

Defined results: null or empty text has no words and no hits; items without words have no windows; equal items all
count; repeated rows are judged one by one, whatever their ids; empty tables give no rows or no hits. Only doc_id, text
and item_id, text are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import ascii_lower, keyed, spread, without_rows
from .windows import covered, with_window_hashes, words_of

WIDTH = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The hash set is broadcast up to this many bytes of window texts and item ids; beyond, the same join is left to shuffle.
BROADCAST_BYTES = 64 << 20
#: Bits in the table for each window, and most bits; a fuller table only lets more candidates through to the join.
BITS_PER_WINDOW, MOST_BITS = 32, 1 << 20


def _hashed(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    df = df.select(*keep, words_of(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS).alias("__w"))
    return df.withColumn("__n", F.size("__w")).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))


def _window_text(at: Column, width: int) -> Column:
    return F.array_join(F.slice("__w", at + 1, F.lit(width)), " ")


def _spots(width: int, test) -> Column:
    """struct(at, width, hash, text) of the windows of a row whose hash passes ``test``."""
    at = F.filter(F.sequence(F.lit(0), F.col("__n") - width), lambda i: test(F.get(f"__x{width}", i)))
    found = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(width).alias("width"), F.get(f"__x{width}", i).alias("h"), _window_text(i, width).alias("text")))
    return F.when(F.col("__n") >= width, found).otherwise(F.array().cast("array<struct<at:int,width:int,h:bigint,text:string>>"))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """width, h, text, items (ids as strings): one row for each different window."""
    df = _hashed(benchmark, benchmark["text"], [benchmark["item_id"].cast("string").alias("__id")])
    df = with_window_hashes(df, "__h", list(range(1, width + 1)), "__x")
    spots = _spots(width, lambda h: F.lit(True))
    for w in range(width - 1, 0, -1):
        spots = F.when(F.col("__n") == w, _spots(w, lambda h: F.lit(True))).otherwise(spots)
    return df.select("__id", F.explode(spots).alias("s")).groupBy("s.width", "s.h", "s.text").agg(F.collect_set("__id").alias("items"))


def _bit_table(windows: DataFrame, n_windows: int) -> tuple[list[int], int]:
    """A bit for each window hash, as 64-bit numbers: at most MOST_BITS / 64 rows reach the driver."""
    size = 64
    while size < n_windows * BITS_PER_WINDOW and size < MOST_BITS:
        size *= 2
    slot = F.col("h").bitwiseAND(F.lit(size - 1))
    words = windows.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {size - 1}) & 63 as int))")).alias("bits"))
    table = [0] * (size // 64)
    for r in words.collect():
        table[r["at"]] = r["bits"]
    return table, size


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), hits (sorted, struct<at, width>): one row per document."""
    windows = materialise(benchmark_windows(benchmark, width), "windows")
    facts = windows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 64 + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)).alias("b")).collect()
    widths = sorted(r["width"] for r in facts) or [width]
    n_windows, n_bytes = sum(r["n"] for r in facts), sum(r["b"] for r in facts)
    bits, size = _bit_table(windows, n_windows)
    table = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def test(h: Column) -> Column:
        slot = h.bitwiseAND(F.lit(size - 1))
        word = F.get(table, F.shiftright(slot, 6).cast("int"))
        return F.call_function("getbit", word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    docs = spread(docs.select("doc_id", "text"))
    rows = _hashed(docs, docs["text"], [docs["doc_id"].alias("doc_id"), F.monotonically_increasing_id().alias("__rid")])
    rows = with_window_hashes(rows, "__h", widths, "__x")
    spots = F.concat(*[_spots(w, test) for w in widths]) if len(widths) > 1 else _spots(widths[0], test)
    spots = rows.select("__rid", "doc_id", F.col("__n").cast("long").alias("n_words"), F.explode_outer(spots).alias("s"))
    spots = spots.select("__rid", "doc_id", "n_words", F.col("s.at").alias("at"), F.col("s.width").alias("width"), F.col("s.h").alias("h"), F.col("s.text").alias("text"))
    wins = windows.select(F.col("width").alias("__bw"), F.col("h").alias("__bh"), F.col("text").alias("__bt"), "items")
    wins = F.broadcast(wins) if n_bytes <= BROADCAST_BYTES else wins
    met = spots.join(wins, (F.col("h") == F.col("__bh")) & (F.col("width") == F.col("__bw")) & (F.col("text") == F.col("__bt")), "left")
    hit = F.when(F.col("__bh").isNotNull(), F.struct("at", "width"))
    out = met.groupBy("__rid", "doc_id", "n_words").agg(F.sort_array(F.collect_set(hit)).alias("hits"), F.collect_set("items").alias("sets"))
    return out.select("doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"), "hits")


def _hits(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(hit, hits) of the rows (row, rid) with a benchmark window."""
    found = scan(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), benchmark)
    return found.where("n_hit > 0").select(F.col("doc_id").alias("hit"), "hits")


def drop_contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; null and repeated ids take no other row along."""
    rows = keyed(docs)
    return without_rows(rows, _hits(rows, benchmark).select(F.col("hit").alias("rid"))).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every hit word, and what separates it from the next word, cut out of ``text``."""
    names, rows = docs.columns, keyed(docs)
    rows = rows.join(_hits(rows, benchmark), F.col("rid") == F.col("hit"), "left")
    text = F.col("row.text")
    rows = rows.withColumn("__gaps", F.when(F.col("hits").isNotNull(), F.split(text, WORD))).withColumn("__words", F.when(F.col("hits").isNotNull(), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    dead = lambda i: F.exists("hits", lambda x: (i >= x["at"]) & (i < x["at"] + x["width"]))
    left = F.concat(F.get("__gaps", F.lit(0)), F.array_join(F.transform("__words", lambda w, i: F.when(dead(i), F.lit("")).otherwise(F.concat(w, F.get("__gaps", i + 1)))), ""))
    return rows.select(*[F.coalesce(left, text).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names])
