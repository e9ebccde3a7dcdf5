r"""Quality rules whose cutoffs carry a statistical guarantee.

Every document gets text statistics. A level of strictness is a cutoff for each rule; a document fails a level when
any rule exceeds its cutoff. On labelled documents (label 1: good) the good ones that a level would reject are counted
in each stratum (language), and the strictest level is chosen whose false-rejection rate is proven to be at most
``ALPHA``: the exact binomial probability of seeing so few rejections at rate ALPHA must be at most
DELTA / (levels x strata), the Bonferroni share of the total error. Strata without such a proof get no cutoffs and
only the base rules apply there.

Base rules, always on: fewer than 10 words, or over 20 % of the words in repeated 5-word windows.

Defined results: null text has no words (base_failed); a null language is the stratum ''; rows with a null document
id never count as labelled; repeated rows are judged one by one and repeated labels count once (label 1 only where all
agree); an empty table gives no rows and empty labels give no cutoffs. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, release
from .common import BLANKS, UPPER, inline_rows, spread
from .windows import covered, with_window_hashes, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
ALPHA, DELTA = 0.05, 0.05
#: Most bytes of labelled ids that are broadcast, and what one of them takes in a hash set.
BROADCAST_BYTES, ID_BYTES = 64 << 20, 64
#: Cutoffs of each rule from the most lenient level to the strictest.
LEVELS = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1],
    "bangs_per_word": [1.5, 1.2, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2],
    "capital_share": [0.70, 0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25],
    "stutter_share": [0.80, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15],
    "dup_line_share": [0.90, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50],
}


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def text_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' measures.

    A filter that also names ``tag`` stays above this plan; pushed below, it would repeat each step's expressions
    inside the next one's until they fill the memory.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    df = docs.select(*keep, text.alias("__t"), words_of(text, r"[\x20\x09-\x0D]+").alias("__w"))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("__w").cast("long"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("__lines", lines)
    df = df.select(
        *[c for c in df.columns if c not in ("__t", "__w", "__lines")],
        (F.length("__t") - _count_of(F.col("__t"), BLANKS)).cast("long").alias("word_chars"), _count_of(F.col("__t"), SYMBOLS).alias("n_symbols"),
        _count_of(F.col("__t"), "!").alias("__bangs"), _count_of(F.col("__t"), UPPER).alias("__capitals"),
        F.size("__lines").cast("long").alias("__n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    df = with_window_hashes(df, "__h", [WINDOW], "__x")
    df = df.withColumn("__v", F.slice(f"__x{WINDOW}", F.lit(1), F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("__dup", F.size(F.array_distinct("__v")) < F.size("__v"))
    df = df.withColumn("__s", F.when(F.col("__dup"), F.sort_array(F.transform("__v", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    same = lambda s, i: (F.get("__s", i - 1)["h"] == s["h"]) | (F.get("__s", i + 1)["h"] == s["h"])
    again = F.transform("__s", lambda s, i: F.when(F.coalesce(same(s, i), F.lit(False)), F.struct(s["at"].alias("at"), F.lit(WINDOW).alias("width"))))
    df = df.withColumn("__a", F.sort_array(F.filter(again, lambda x: x.isNotNull())))
    stutter = F.size(F.filter(F.zip_with("__h", F.slice("__h", F.lit(2), F.size("__h")), lambda a, b: a == b), lambda same: same))
    share = lambda n, total: F.coalesce(F.try_divide(n, total), F.lit(0.0))
    return df.withColumn("n_repeat_words", F.when(F.col("__dup"), covered(F.col("__a"))).otherwise(F.lit(0).cast("long"))).select(
        *[c for c in df.columns if not c.startswith("__")], "n_repeat_words",
        share(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"), share(F.col("__bangs"), F.col("n_words")).alias("bangs_per_word"),
        share(F.col("__capitals"), F.col("word_chars")).alias("capital_share"), share(stutter, F.col("n_words")).alias("stutter_share"),
        share(F.col("n_dup_lines"), F.col("__n_lines")).alias("dup_line_share"), F.monotonically_increasing_id().alias("tag"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    # Below the mode terms fall off geometrically, so sum from k down until they no longer count.
    total, i = 0.0, k
    while i >= 0:
        term = math.exp(log(i))
        total += term
        if i < n * p and term < total * 1e-17:
            break
        i -= 1
    return min(1.0, total)


def _fails(level: Column) -> Column:
    """Whether a document exceeds a cutoff of the level (1, 2, ...; null: no cutoffs)."""
    over = [F.col(rule) > F.get(F.array(*[F.lit(c) for c in cuts]), level - 1) for rule, cuts in LEVELS.items()]
    out = over[0]
    for o in over[1:]:
        out = out | o
    return F.coalesce(out, F.lit(False))


def certified_levels(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[dict]:
    """[{stratum, level}] with a proof. ``measured``: doc_id, stratum, base_failed and the rules' measures.

    A stratum comes to the driver only when it has the labelled documents that any proof needs, so their number is
    bounded by the labelled rows over that minimum. Each level's count is a sum with map-side partial results.
    """
    n_levels = len(next(iter(LEVELS.values())))
    need = math.log(delta / n_levels) / math.log(1 - alpha)
    good = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1")
    held = measured.join(good, measured["doc_id"] == good["__id"], "left_semi").where(~F.col("base_failed"))
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(_fails(F.lit(v))).alias(f"k{v}") for v in range(1, n_levels + 1)])
    rows = counts.where(F.col("n") >= need).collect()
    tests = n_levels * max(1, len(rows))
    out = []
    for r in rows:
        proven = [v for v in range(1, n_levels + 1) if binomial_tail(r[f"k{v}"], r["n"], alpha) <= delta / tests]
        if proven:
            out.append({"stratum": r["stratum"], "level": max(proven)})
    return out


def stratum_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"], F.lit(""))


def judged(measured: DataFrame, levels: list[dict]) -> DataFrame:
    """Add ``kept``. The level table has a row for each certified stratum and is a literal."""
    table = inline_rows(measured.sparkSession, json.dumps(levels), "stratum string, level int").select(F.col("stratum").alias("__st"), "level")
    return measured.join(F.broadcast(table), F.col("stratum") == F.col("__st"), "left").withColumn("kept", ~F.col("base_failed") & ~_fails(F.col("level"))).drop("__st", "level")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: statistics, base_failed, kept. The text is read once; its statistics are written down."""
    docs = spread(docs.select("doc_id", "text", "lang"))
    measured = materialise(text_statistics(docs, [docs["doc_id"].alias("doc_id"), stratum_of(docs).alias("stratum")]), "rules")
    return judged(measured, certified_levels(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were.

    Statistics are computed twice, for the labelled documents and then beside all rows: texts are never shuffled. The
    labelled ids are broadcast when their measured number fits ``BROADCAST_BYTES``; beyond, statistics of all documents
    are written and joined.
    """
    cols, docs = docs.columns, spread(docs)
    ids = labels.where(labels["doc_id"].isNotNull() & (labels["quality"] == 1)).select(labels["doc_id"].alias("__lid")).distinct()
    taught = docs.select("doc_id", "text", "lang")
    if ids.count() * ID_BYTES <= BROADCAST_BYTES:
        taught = taught.join(F.broadcast(ids), taught["doc_id"] == ids["__lid"], "left_semi")
    measured = materialise(text_statistics(taught, [taught["doc_id"].alias("doc_id"), stratum_of(taught).alias("stratum")]), "rules")
    levels = certified_levels(measured, labels)
    release(measured)
    whole = text_statistics(docs, [F.struct(*[docs[c] for c in cols]).alias("row"), stratum_of(docs).alias("stratum")])
    return judged(whole, levels).where("kept AND tag >= 0").select("row.*")
