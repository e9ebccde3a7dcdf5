"""The pipeline's stages against plain versions, stage by stage on its own input."""

import sentencepiece

import corpus_pipeline
from rowloom.llm import rules
from rowloom.scratch import materialise

from . import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in rules.quality_verdicts(docs, labels).collect()}
    expect = [
        lambda d: [(i, t) for i, t in d if verdict[i]],
        lambda d: [(i, k) for i, _, _, k in brute.lines(d)],
        brute.one_of_each,
        lambda d: [(i, t) for (i, t), (_, _, n, _) in zip(d, brute.contamination(d, bench)) if not n],
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expect):
        before = rows(docs)
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns and rows(docs) == sorted(want(before)), name
        assert docs.where("n_chars <> length(text)").isEmpty()
    known = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    last = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert last == {i: known.encode(t) for i, t in rows(docs)}
    assert {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()} == last


def test_stages_decide_by_row(spark, tmp_path):
    """Null and repeated ids: a row's fate is its own."""
    spark.createDataFrame([(1, "alpha bravo charlie delta echo foxtrot golf hotel india juliett")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad, good = "so alpha bravo charlie delta echo foxtrot golf hotel india juliett ends", [" ".join(f"{w}{k}" for k in range(40)) for w in ("one", "two", "red", "sea")]
    docs = spark.createDataFrame([(None, bad), (None, good[0]), (7, bad), (7, good[1]), (8, good[2])], "doc_id long, text string")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r["text"] for r in left.collect()) == sorted(good[:3])
    docs = spark.createDataFrame([(7, good[0]), (7, good[1]), (None, good[2]), (None, good[2]), (None, good[3]), (9, good[3]), (6, good[1])], "doc_id long, text string")
    left = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(7, good[0]), (6, good[1]), (0, good[2]), (9, good[3])])


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    """Nulls, repeated ids, empty and long texts, columns with clashing names; and no rows at all."""
    import random

    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n))
    shared, bad = "a line that several documents have in common", "so alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo ends"
    one, two, long = prose(40), prose(50), prose(20_000)
    texts = [(1, one), (1, two), (None, prose(30)), (None, bad), (None, None), (2, ""), (3, one), (4, f"{prose(15)}\n{shared}"), (5, f"{prose(15)}\n{shared}"), (None, f"{shared}\n{prose(15)}"), (6, long), (16, long + " end"), (7, bad), (8, "few words only"), (9, "again and again " * 30)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, rid string, row int, h binary, kept boolean, gone long, fp string"
    rows = [(i, t, rng.choice(["en", None]), None, len(t or ""), "x", 1, b"h", None, 5, "f") for i, t in texts]
    bench = [(1, bad), (2, None), (None, "Only Nine Words stand here in this short item"), (3, "")]
    for name, docs, items in (("odd", rows, bench), ("empty", [], []), ("no_items", rows, [])):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        want = [r for r, s in zip(texts, brute.statistics(texts)) if docs and not s[6]]
        want = [(i, k) for i, _, _, k in brute.lines(want)]
        want = brute.one_of_each(want)
        want = [r for r, c in zip(want, brute.contamination(want, items)) if not c[2]]
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id", "decoded").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str), name
        assert bool(want) == bool(docs)
