import sentencepiece
from test_chunk_dedup import brute as brute_chunks
from test_decontaminate import words
from test_sentencepiece import FILE
from test_superminhash import brute as brute_groups

import corpus_pipeline as cp
from marlstone.llm.common import stored

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
    assert [name for name, _ in cp.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "decontamination", "sentencepiece"] and cp.ORACLE_SQL is None
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF))
        after = {r.doc_id: r for r in docs.collect()}
        rows = sorted((i, r.text) for i, r in before.items())
        assert after.keys() <= before.keys() and docs.count() == len(after)
        if name != "sentencepiece":
            assert docs.columns == cp.COLUMNS
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = [i for i in before if labels.get(i) == 0]
            assert 0 < len(after) < len(before) and sum(i in after for i in clean) > 0.97 * len(clean)
        elif name == "minhash_near_dedup":
            assert sorted(after) == sorted(i for i, _, _, kept in brute_groups(rows, 5) if kept)
        elif name == "substring_dedup":
            want = {i: t for i, _, _, t in brute_chunks(rows)}
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "decontamination":
            leak = lambda t: any(tuple(w[k : k + 10]) in windows for w in [words(t)] for k in range(len(w) - 9))
            assert sorted(after) == sorted(i for i, t in rows if not leak(t))
        else:
            assert all(r.ids == library.encode(before[i].text) and r.decoded == library.decode(r.ids) and r.n_tokens == len(r.ids) for i, r in after.items())


def test_odd_documents(spark):
    docs = spark.createDataFrame([(None, "a b c", None, None, 3, 1), (5, None, "en", "s", None, 2), (5, None, "en", "s", None, 2), (6, "", "xx", None, 0, 3)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for some in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            some = stored(stage(spark, some, "/root/testdata/sf0.001"))
        assert some.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"]
        assert some.count() in (0, 3)
