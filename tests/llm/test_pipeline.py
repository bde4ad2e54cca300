import sys
from pathlib import Path

import pytest
import sentencepiece
import public_tokenizers
from pyspark.sql import functions as F

from tests.parity import compare, duck
from tidemark.llm import decontaminate as dec
from tidemark.llm import queries

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from tests.llm.test_naming import brute as exact  # noqa: E402
from tests.llm.test_simhash import brute as near  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert not compare(queries.QUERIES[name](spark, sf).toPandas(), duck(sf).sql(queries.ORACLES[name]).df())


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The smallest tables, with a benchmark passage, copies and documents without letters among the documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    base = docs.filter("n_chars > 600").orderBy("doc_id").first().text
    more = [(9001, f"{base} and then {item}", "en", "x", 1), (9002, base.replace(" ", "  "), "en", "x", 1), (9003, base + " end", "en", "x", 1), (9004, "12 !!", "en", "x", 1), (9005, None, None, None, None)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept = {i for i, _, _, kept, _ in exact(letters) if kept}
    first = [r for r in letters if r[0] in kept]
    kept = {i for i, _, component in near(first) if i == component}
    items = [dec.words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = lambda t: any(f" {' '.join(p)} " in f" {' '.join(dec.words_of(t))} " for p in items)
    want = {i for i, t in first if i in kept and not held(t)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert not {9001, 9002, 9003, 9004, 9005} & want
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows)
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id])) + 1 for r in got)


def test_stages_keep_columns_and_take_extra_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"lang_pred": F.lit("x"), "_row": F.lit(1), "kept": F.lit(True), "fp": F.lit("y")})
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() and function(spark, docs.limit(0), folder).count() == 0
