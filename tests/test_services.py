"""Tables, settings, windows, training pairs, streams and the service functions that no SQL stands for."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom import api, config
from textloom.operators.analytics import hard_negatives
from textloom.operators.chunks import sliding_windows, subword_windows
from textloom.sources import tables


def test_tables(spark, tmp_path):
    """Creating, filling from both kinds of frames, emptying, replacing and dropping a table."""
    name = "textloom_test_table"
    tables.drop(spark, name)
    try:
        tables.create(spark, name, "a long, b string")
        tables.create(spark, name, "a long, b string")
        tables.append(pd.DataFrame({"b": ["x"], "a": [1]}), name, spark)
        tables.append(spark.createDataFrame([("y", 2)], "b string, a int"), name)
        assert sorted(map(tuple, spark.table(name).collect())) == [(1, "x"), (2, "y")] and api.table_exists(spark, name)
        tables.truncate(spark, name)
        assert spark.table(name).columns == ["a", "b"] and spark.table(name).count() == 0
        tables.create_as(spark.range(3), name)
        api.reload(spark, name)
        assert spark.table(name).count() == 3
    finally:
        tables.drop(spark, name)
    assert not api.table_exists(spark, name)


def test_batches_are_there_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "batches")

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        tables.committed([lambda: spark.range(2), fails], folder)
    assert tables.committed([lambda: spark.range(2), lambda: spark.range(3)], folder) == [1]
    assert spark.read.parquet(folder).count() == 5


def test_settings():
    held = config.from_yaml("search:\n  k1: 1.5  # saturation\n  top_k_rerank: 7\n# b: 3\nunknown: 1\nexpansion_term: 'town'\n")
    assert (held.k1, held.top_k_rerank, held.b, held.expansion_term) == (1.5, 7, 0.75, "town")
    given = {"llm": {"api_key": "abc", "url": "u"}, "token": ""}
    assert config.view(given) == {"llm": {"api_key": "***", "url": "u"}, "token": ""} and given["llm"]["api_key"] == "abc"
    assert api.config_view()["k1"] == 1.2


def test_windows_of_titles_and_subwords(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = Tokenizer(models.WordLevel({c: k for k, c in enumerate(["[U]", *"abcdefgh"])}, unk_token="[U]"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "words.json")
    model.save(path)
    docs = spark.createDataFrame([(1, "a b c", "t"), (2, "a  b c d e f g h", None), (3, None, None)], "doc_id long, text string, title string")
    got = sorted((r.doc_id, r.pos, r.start, r.n_tokens, r.chunk_text) for r in subword_windows(docs, path, 4, 3).collect())
    assert got == [(1, 0, 0, 3, "a b c"), (2, 0, 0, 4, "a  b c d"), (2, 1, 3, 4, "d e f g"), (2, 2, 4, 4, "e f g h")]
    assert sorted(r.chunk_text for r in sliding_windows(docs, 4, 3, title_col="title").where("doc_id = 1").collect()) == ["t a b c"]


def test_hard_negatives_by_rank_and_margin(spark):
    """Neighbours on a line: ranks cut the list, the margin drops wrong rows as near as a right one."""
    rows = [(k, [1.0, k / 10], k % 2) for k in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    anchor = df.where("vec_id = 0")
    ids = lambda **more: [r.vec_id for r in hard_negatives(anchor, df, **more).orderBy("rank").collect()]
    assert ids() == [1, 3, 5, 7, 9] and ids(most=2) == [1, 3] and ids(ranks=(1, 3)) == [3, 5] and ids(margin=1e-9) == [3, 5, 7, 9]


def test_a_whole_search(spark, tmp_path):
    texts = {1: "old town castle castle", 2: "river walk along the old walls", 3: "castle ruins by the river"}
    docs = spark.createDataFrame([(k, f"https://s{k}.de/p", f"Title {k}", t) for k, t in texts.items()], "doc_id long, url string, title string, text string")
    held, chunks = api.index_all(docs, str(tmp_path / "index"), title="title")
    found = api.find("castle ruins", held, docs, chunks)
    rows = found.orderBy("rank").collect()
    assert [r.doc_id for r in rows] and {r.doc_id for r in rows} == {3} | ({1} & {r.doc_id for r in rows})
    assert rows[0].title == "Title 3" and rows[0].domain == "s3"
    context = api.answer_context(found, docs)
    answers = api.summarised(context, lambda c: "<think>hm</think> " + c.str.slice(0, 13)).collect()
    assert [r.answer for r in answers] == ["Text Window 1"]
    assert "title" in held.terms.select("term").toPandas()["term"].tolist()
    asked = tables.requests(spark.createDataFrame([('{"query": "x", "top_k": 3}',), ("{}",)], "value string")).collect()
    assert {(r.query_text, r.top_k, len(r.query_num)) for r in asked} == {("x", 3, 32), ("", 100, 32)}
    assert held.documents.agg(F.count("*")).first()[0] == 3
