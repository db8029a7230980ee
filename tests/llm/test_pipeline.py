import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.llm.sentencepiece_codec import DEFAULT_MODEL, Codec, Vocabulary

from .test_dedup_and_mix import brute_lines
from .test_ngram_join import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows after each stage, over a whole small table with odd rows added."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9000, None, "en", "src1", 0), (9001, "", None, None, 0), (9002, "ЖЩЪ ЫЮЖ ЩЩЪ " * 30, None, "src2", 360)]
    docs = docs.unionAll(spark.createDataFrame(odd, DOCS)).unionAll(docs.where("doc_id = 5"))
    out = [docs.collect()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs = pipeline.stored(docs, name)
        out.append(docs.collect())
    return out


def test_stages_are_the_five_asked_for():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mix_sources", "sentencepiece"]


def test_language_id_keeps_clean_documents(stages):
    before, after = stages[0], stages[1]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {9000, 9001, 9002}
    assert 9002 not in {r.doc_id for r in after}
    lang = {r.doc_id: r.lang for r in before if r.lang}
    assert all(r.lang == lang[r.doc_id] for r in after if r.doc_id in lang and r.doc_id < 9000)


def test_line_dedup_is_the_plain_one(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[1]]
    want = {i: t for (i, _), t in brute_lines(rows).items()}
    lost = {i for i, t in want.items() if not t}
    got = {r.doc_id: r.text for r in stages[2]}
    assert all(want[i] == (t or "") for i, t in got.items())
    assert {r.doc_id for r in stages[1]} - set(got) <= lost
    assert all(r.n_chars == len(r.text) for r in stages[2] if r.text is not None)


def test_near_dedup_keeps_one_of_each_class(stages):
    want = brute([(r.doc_id, r.text) for r in stages[2]])
    kept = [r.doc_id for r in stages[3]]
    assert len(kept) == len(set(kept)) and set(kept) == {v[0] for v in want.values()}


def test_mix_takes_words_of_what_was_kept(stages):
    """All words of a document's rows are its own, in order, and no document gives more than three times its size."""
    texts = {r.doc_id: (r.text or "").split() for r in stages[3]}
    taken = {}
    for r in stages[4]:
        words, own = iter(texts[r.doc_id]), r.text.split()
        assert own and all(w in words for w in own)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(own)
    assert all(n <= 3 * len(texts[i]) for i, n in taken.items())
    total = sum(map(len, texts.values()))
    assert abs(sum(taken.values()) - total) < 0.03 * total


def test_tokens_give_every_text_back(stages):
    codec = Codec(Vocabulary.load(DEFAULT_MODEL))
    texts = sorted((r.doc_id, r.text) for r in stages[4])
    got = sorted((r.doc_id, codec.decode(np.array(r.token_ids, dtype="int32"))) for r in stages[5])
    assert got == texts and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in stages[5])


def test_run_and_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).agg(F.sum("n_tokens")).head()[0] is None


def test_scratch_is_cleared(spark):
    from orebed.llm.common import clear_scratch, stored

    kept = stored(spark.range(3).toDF("k"), "gone")
    assert kept.count() == 3
    clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)not exist|no such|FileNotFound"):
        spark.catalog.clearCache()
        kept.agg(F.sum("k")).collect()


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as `a.b`", "'x' as `Path Ü`")
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert "a.b" in out.columns and out.count() > 0, name
